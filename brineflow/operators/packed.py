"""Several values packed in one field: infer the delimiters of each source, split, explode with position.

Two passes over the data. The first scores every candidate delimiter per source, on how consistently it yields
two or more pieces where it occurs and on how regular the types of those pieces are; sums are made per Arrow
batch, so only (source, candidate) counters are shuffled. The second splits each field by the delimiters accepted
for its source and explodes natively.

Defined results: null, empty and blank fields hold no values; text in closed quotes or brackets belongs to one
value; an opening quote or bracket that is never closed is an ordinary character; a field without an accepted
delimiter holds one value. The scan is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.runtime.session import bounded_rows, ship_code, spread

#: Candidate delimiters; those the data does not support are rejected by their score.
CANDIDATES = (
    "newline", "tab", "semicolon", "bar", "comma", "slash", "plus", "ampersand", "dash", "bullet",
    "word_and", "word_plus", "colon", "word_at", "word_in", "stop",
)
#: Candidates that always bound the pieces while another one is scored.
FRAME = frozenset(["newline", "tab", "semicolon", "bar", "comma"])
MIN_SCORE = 0.5
#: Occurrences of the whole collection that count beside those of a source, so that a rare source has a steady score.
PRIOR_OCCURRENCES = 200.0
#: Sources whose rules are kept in memory; beyond it the rules are joined to the rows.
MAX_SOURCES_IN_MEMORY = 50_000

_BREAKS = "\r\n\v\f\x85\u2028\u2029"
_SPECIAL = re.compile(rf"[\"'“«(\[{{{_BREAKS}\t;|,/+&\-–—•·▪:.]|(?<=\s)(?:[aA][nN][dD]|[pP][lL][uU][sS]|[aA][tT]|[iI][nN])(?=\s)")
_CONNECTIVE = re.compile(r"\s(?:and|plus|at|in)\s", re.I)
_PLAIN = re.compile(rf"[\"'“«(\[{{{_BREAKS}\t;|,/+&\-–—•·▪:.]")
_ALWAYS = {"\t": "tab", ";": "semicolon", "|": "bar", "•": "bullet", "·": "bullet", "▪": "bullet"} | dict.fromkeys(_BREAKS, "newline")
_SPACED = {"/": "slash", "+": "plus", "&": "ampersand", "-": "dash", "–": "dash", "—": "dash"}
_WORD = {"and": "word_and", "plus": "word_plus", "at": "word_at", "in": "word_in"}
_QUOTED = re.compile(r'"(?:[^"]|"")*"|“[^”]*”|«[^»]*»')
_SINGLE = re.compile(r"'((?:[^']|'')*)'(?=\s*(?:[;|,&/+\n\r\t.]|--|(?i:and|plus)\s|\(?\w{1,5}[.)]\s|$))")
_BULLET = re.compile(r"(?:[*•·▪]|-|–)\s+")
_MARK = re.compile(r"(\(?)(\d{1,3}|[A-Za-z]|[ivxIVX]{1,7})([.)])\s+")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}
_ROMAN = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
_CODE = re.compile(r"\b(?=\w*\d)(?=\w*[^\W\d_])\w{5,}\b|\b\d{6,}\b")
_NAME = re.compile(r"[^\W\d_]{2,}|\d-[^\W\d_]+")
#: Words that state a unit or a scale and so are no name.
_UNIT_WORDS = frozenset("mm um nm mol mmol umol nmol mg ug ml ul wt vol ph per".split())


def _roman(n: int) -> str:
    return "x" * (n // 10) + _ROMAN[n % 10]


def _ordinal(n: int, kind: str) -> str:
    return str(n) if kind == "number" else _roman(n) if kind == "roman" else chr(96 + n) if n <= 26 else ""


def _brackets(text: str) -> dict[int, int]:
    """Place after the closing bracket, by place of each bracket that is closed."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group()
        if c in _CLOSES:
            stack.append((_CLOSES[c], m.start()))
        elif stack and stack[-1][0] == c:
            found[stack.pop()[1]] = m.end()
    return found


def _scan(text: str) -> list[tuple[str, int, int]]:
    """Every candidate delimiter outside quotes and brackets as (name, start, end), in one pass."""
    found: list[tuple[str, int, int]] = []
    closed = _brackets(text) if "(" in text or "[" in text or "{" in text else {}
    skip, last = 0, len(text) - 1
    for m in (_SPECIAL if _CONNECTIVE.search(text) else _PLAIN).finditer(text):
        i = m.start()
        if i < skip:
            continue
        c = m.group()
        if len(c) > 1:
            found.append((_WORD[c.lower()], i, m.end()))
        elif c in "([{":
            skip = closed.get(i, skip)
        elif c in '"“«':
            if q := _QUOTED.match(text, i):
                skip = q.end()
        elif c == "'":
            if (i == 0 or text[i - 1].isspace() or text[i - 1] in ";|,") and (q := _SINGLE.match(text, i)):
                skip = q.end()
        elif name := _ALWAYS.get(c):
            found.append((name, i, i + 1))
        elif c == ",":
            if not (0 < i < last and text[i - 1].isdigit() and text[i + 1].isdigit()):
                found.append(("comma", i, i + 1))
        elif name := _SPACED.get(c):
            end = i + 2 if text.startswith("--", i) else i + 1
            if 0 < i and end <= last and text[i - 1].isspace() and text[end].isspace():
                found.append((name, i, end))
                skip = end
        elif i < last and text[i + 1].isspace():
            found.append(("colon" if c == ":" else "stop", i, i + 1))
    return found


def _pieces(text: str, accepted: frozenset[str]) -> list[str]:
    """Raw pieces between accepted delimiters outside quotes and brackets."""
    out, start = [], 0
    for name, a, b in _scan(text):
        if name in accepted:
            out.append(text[start:a])
            start = b
    out.append(text[start:])
    return out


def _without_marks(pieces: list[str]) -> list[str]:
    """Drops bullets and list marks; marks in ascending order also divide where only a blank stands before them."""
    pieces = [p.strip() for p in pieces]
    pieces = [p for p in pieces if p]
    if not pieces:
        return pieces
    if _BULLET.match(pieces[0]):
        return [_BULLET.sub("", p, count=1) if _BULLET.match(p) else p for p in pieces]
    first = _MARK.match(pieces[0])
    if not first or (first[1] and first[3] != ")"):
        return pieces
    mark = first[2].lower()
    kind = "number" if mark == "1" else "roman" if mark == "i" else "letter" if mark == "a" else ""
    if not kind:
        return pieces
    before, after = first[1], first[3]
    out, n = [], 1
    for piece in pieces:
        rest = piece
        head = _MARK.match(rest)
        if head and (head[1], head[2].lower(), head[3]) == (before, _ordinal(n, kind), after):
            rest, n = rest[head.end() :], n + 1
        while (label := _ordinal(n, kind)) and (m := re.search(rf"\s{re.escape(before)}{label}{re.escape(after)}\s", rest, re.I)) and not _inside(rest, m.start()):
            out.append(rest[: m.start()])
            rest, n = rest[m.end() :], n + 1
        out.append(rest)
    return out


def _inside(text: str, place: int) -> bool:
    """Whether a place lies inside closed quotes or brackets."""
    if any(a < place < b for a, b in _brackets(text).items()):
        return True
    return any(m.start() < place < m.end() for m in re.finditer(r'"(?:[^"]|"")*"', text))


def _value(piece: str) -> str:
    piece = " ".join(piece.split())
    if len(piece) > 1 and _QUOTES.get(piece[0]) == piece[-1]:
        inner, q = piece[1:-1], piece[0]
        if q not in "\"'" or q not in inner.replace(q + q, ""):
            piece = " ".join((inner.replace(q + q, q) if q in "\"'" else inner).split())
    return piece


def split_values(text: str | None, accepted: frozenset[str]) -> list[str]:
    """The values of one field in order; empty list for null and blank text."""
    if not text:
        return []
    text = text.strip()
    if text.endswith("."):
        text = text[:-1]
    return [v for p in _without_marks(_pieces(text, accepted)) if (v := _value(p))]


def _regular(piece: str) -> bool:
    """Whether a piece reads as a whole value: a name together with an amount or a code."""
    rest = _CODE.sub(" ", piece)
    return (len(rest) < len(piece) or any(c.isdigit() for c in rest)) and any(w.lower() not in _UNIT_WORDS for w in _NAME.findall(rest))


def _score_batch(sources: list, texts: list, totals: dict[tuple[str | None, str], list[int]]) -> None:
    """Adds up fields, fields with two or more pieces, occurrences between pieces, and those between two regular pieces."""
    for source, text in zip(sources, texts):
        if not text:
            continue
        text = text.strip().removesuffix(".")
        tokens = _scan(text)
        known: dict[tuple[int, int], bool] = {}
        for name in {t[0] for t in tokens}:
            cuts = [t for t in tokens if t[0] == name or t[0] in FRAME]
            occurred = between = regular = 0
            for k, (kind, a, b) in enumerate(cuts):
                if kind != name:
                    continue
                left, right = (cuts[k - 1][2] if k else 0, a), (b, cuts[k + 1][1] if k + 1 < len(cuts) else len(text))
                occurred += 1
                if not text[slice(*left)].strip() or not text[slice(*right)].strip():
                    continue
                between += 1
                for side in (left, right):
                    if side not in known:
                        known[side] = _regular(text[slice(*side)])
                regular += known[left] and known[right]
            edges = sum(not text[:a].strip() or not text[b:].strip() for kind, a, b in cuts if kind == name)
            if edges == occurred:  # only before the first or after the last value
                continue
            t = totals.setdefault((source, name), [0, 0, 0, 0])
            t[0] += 1
            t[1] += between > 0 or all(_BULLET.match(text, a) for kind, a, b in cuts if kind == name)
            t[2] += between
            t[3] += regular


def delimiter_scores(df: DataFrame, text: str, source: str) -> DataFrame:
    """(source, delimiter, n_fields, consistency, regularity, score, accepted) for every source and candidate that occurs."""
    ship_code(df.sparkSession)
    schema = "src string, delimiter string, n_fields bigint, n_multi bigint, n_between bigint, n_regular bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            _score_batch(b.column(0).to_pylist(), b.column(1).to_pylist(), totals)
        rows = [(*k, *v) for k, v in totals.items()]
        names = ["src", "delimiter", "n_fields", "n_multi", "n_between", "n_regular"]
        types = [pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names=names)

    counts = df.select(F.col(source).cast("string").alias("src"), F.col(text).alias("txt")).where(F.col("txt").isNotNull()).mapInArrow(run, schema)
    sums = counts.groupBy("src", "delimiter").agg(*[F.sum(c).alias(c) for c in ("n_fields", "n_multi", "n_between", "n_regular")])
    all_sources = Window.partitionBy("delimiter")
    prior = F.sum("n_regular").over(all_sources) / F.greatest(F.sum("n_between").over(all_sources), F.lit(1))
    out = sums.select(
        "src", "delimiter", "n_fields",
        (F.col("n_multi") / F.col("n_fields")).alias("consistency"),
        ((F.col("n_regular") + PRIOR_OCCURRENCES * prior) / (F.col("n_between") + PRIOR_OCCURRENCES)).alias("regularity"),
    )
    out = out.withColumn("score", F.col("consistency") * F.col("regularity"))
    return out.withColumn("accepted", F.col("score") >= MIN_SCORE)


def values_column(df: DataFrame, text: str, source: str, out: str = "values", scores: DataFrame | None = None) -> DataFrame:
    """Adds the array of values of `text`, split by the delimiters inferred for the row's source."""
    return _by_rules(df, text, source, out, "array<string>", split_values, scores)


def _by_rules(df: DataFrame, text: str, source: str, out: str, kind: str, use: Callable[[str | None, frozenset[str]], object], scores: DataFrame | None = None) -> DataFrame:
    """Adds `use` of each text and the delimiters accepted for its source.

    The Arrow functions are marked nondeterministic so that a filter on their result doesn't run them a second time.
    """
    ship_code(df.sparkSession)
    scores = delimiter_scores(df, text, source) if scores is None else scores
    rules = scores.where("accepted").groupBy("src").agg(F.collect_set("delimiter").alias("rules"))
    kept = bounded_rows(rules, MAX_SOURCES_IN_MEMORY)
    if kept is None:
        joined = df.join(rules, df[source].cast("string").eqNullSafe(rules["src"]), "left").drop("src")

        @F.pandas_udf(kind)
        def by_row(texts: pd.Series, names: pd.Series) -> pd.Series:
            return pd.Series([use(t, frozenset(() if r is None else r)) for t, r in zip(texts, names)], dtype=object)

        return joined.withColumn(out, by_row.asNondeterministic()(F.col(text), F.col("rules"))).drop("rules")
    by_source = {r["src"]: frozenset(r["rules"]) for r in kept}

    @F.pandas_udf(kind)
    def known(texts: pd.Series, sources: pd.Series) -> pd.Series:
        none = frozenset()
        return pd.Series([use(t, by_source.get(s, none)) for t, s in zip(texts, sources)], dtype=object)

    return df.withColumn(out, known.asNondeterministic()(F.col(text), F.col(source).cast("string")))


def explode_values(df: DataFrame, key: str, text: str, source: str, least: int = 2) -> DataFrame:
    """One row per value with its position from 1, of each field with at least `least` values."""
    narrow = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source")))
    split = values_column(narrow, "_text", "_source", "_values")
    return (
        split.where(F.size("_values") >= least)
        .select(F.col("_key").alias(key), F.posexplode("_values").alias("_pos", "value"))
        .select(key, (F.col("_pos") + 1).cast("int").alias("position"), "value")
    )


_DROP = re.compile(r"(?:(?<!\d)[.,]|[.,](?!\d)|[^\w.,]|_)+")


def canonical_value(value: str) -> str:
    """A value without letter case and without characters that are neither letter nor digit; a point or comma between two digits stays."""
    return _DROP.sub("", value.casefold())


def canonical_content(text: str | None, accepted: frozenset[str]) -> str | None:
    """The multiset of canonical values as one text; None where there is no content."""
    values = sorted(filter(None, map(canonical_value, split_values(text, accepted))))
    return "\x1f".join(values) or None


def content_column(df: DataFrame, text: str, source: str, out: str = "content") -> DataFrame:
    """Adds the canonical content of `text`: null for null and blank text and for text without letters and digits."""
    return _by_rules(df, text, source, out, "string", canonical_content)


def as_column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name
