"""Free-entered names mapped to a reference list.

Names and list are brought to one normal form (case, punctuation, units, spelling variants of the domain). A
multi-pattern automaton over all display names, aliases and ids finds embedded mentions at word bounds; the longest
non-overlapping match wins, unless it is only a part of another name: what stands right before it looks like chemistry,
or it is followed by a noun that it only qualifies (a kinase, an inhibitor). Words behind a function word or a verb form
("in water", "used as", "from ...") say nothing about the name. Values without a mention go to token-set similarity: word order does not matter, words pair
with their closest counterpart by edits, numbers must agree. Values below the threshold, and those about as close to
two entries, are unmatched.

The list is a bounded dimension: above MAX_ENTRIES entries the operator raises rather than broadcasting it. Rows are
first counted per name, combined before the shuffle, so each distinct name is resolved once, in Arrow batches; the result
is joined to the rows with the names that hold many rows split off.

Defined results: null and blank names are left out; a name that is only numbers, units or codes is unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.operators.joins import HEAVY_SHARE, heavy_light_join
from brineflow.operators.units import common, parse_unit
from brineflow.runtime.session import bounded_rows, parallelism, ship_code, written

UNMATCHED = "UNMATCHED"
MAX_ENTRIES = 50_000
MIN_SIMILARITY = 0.78
#: A second entry must be behind the best by this much.
MIN_LEAD = 0.02
_MOST_NAMES = 300_000

#: Other spellings of words of the domain.
WORD_FORMS = {
    "natrium": "sodium", "kalium": "potassium", "lithium": "lithium", "ammoniak": "ammonium", "magnesio": "magnesium", "sodio": "sodium", "potasio": "potassium",
    "kalzium": "calcium", "calcio": "calcium", "zink": "zinc", "cinc": "zinc", "nickel": "nickel", "kobalt": "cobalt", "mangan": "manganese", "caesium": "cesium",
    "chlorid": "chloride", "chlorure": "chloride", "cloruro": "chloride", "sulfat": "sulfate", "sulphate": "sulfate", "sulfato": "sulfate", "nitrat": "nitrate", "nitrato": "nitrate",
    "acetat": "acetate", "azetat": "acetate", "acetato": "acetate", "formiat": "formate", "formiate": "formate", "formiato": "formate", "citrat": "citrate", "zitrat": "citrate",
    "citrato": "citrate", "bromid": "bromide", "bromure": "bromide", "bromuro": "bromide", "iodid": "iodide", "jodid": "iodide", "iodure": "iodide", "yoduro": "iodide",
    "phosphat": "phosphate", "fosfato": "phosphate", "tartrat": "tartrate", "tartrato": "tartrate", "malonat": "malonate", "malonato": "malonate", "thiocyanat": "thiocyanate",
    "tiocianato": "thiocyanate", "fluorid": "fluoride", "fluorure": "fluoride", "fluoruro": "fluoride", "ethylenglykol": "ethylene glycol", "glykol": "glycol",
    "glicerol": "glycerol", "glycerin": "glycerol", "polyethylenglykol": "peg", "polyethyleneglycol": "peg", "polyethylenglycol": "peg",
    "polietilenglicol": "peg", "kaliumchlorid": "potassium chloride",
}
#: Symbols of cations.
CATIONS = {
    "na": "sodium", "k": "potassium", "nh4": "ammonium", "li": "lithium", "mg": "magnesium", "ca": "calcium", "zn": "zinc", "cd": "cadmium", "ni": "nickel",
    "co": "cobalt", "mn": "manganese", "cs": "cesium",
}
#: Words of preparation beside a name that do not belong to it.
FILLERS = frozenset(
    "of de der die das du la le des and fresh buffered buffer solution stock sterile filtered hydrate anhydrous adjusted see note reagent grade ultra pure ph free acid "
    "salt cold new final approx overnight saturated crystalline powder naoh hcl koh".split()
)
#: Function words of four languages; what follows one is another phrase.
FUNCTION_WORDS = frozenset(
    "of in from as for with by to at on per via into within under after before without using plus or than about ca "
    "mit aus von zu zum zur im am bei nach vor ohne als oder auf dans par pour avec sans sur dont ou au aux en "
    "de du des con por para sin sobre del al como desde hasta el los las".split()
)
#: Endings of words of chemistry and biochemistry.
_CHEMICAL = re.compile(r"(?:ol|yl|ate|ite|ide|ine|ane|ene|yne|one|ose|ase|oic|ium|amide|idase|onic|uric|at|id|ato|uro|ure)$")
_VERB_FORM = re.compile(r"[a-z]{2,}(?:ed|ing)$")
#: Mentions of up to this many letters are also words of other languages and count in running text only if written with a capital.
_SHORT = 4
_MORE = frozenset(["mme", "monomethyl", "ether", "propane"])
_CATION_WORDS = sorted({*CATIONS.values(), *(w for w, form in WORD_FORMS.items() if form in CATIONS.values())})
_COMPOUND = re.compile(rf"({'|'.join(_CATION_WORDS)})([a-z]{{5,}})$")
_TOKEN = re.compile(r"[a-z]+\d*\+?|\d+")
_PEG = re.compile(r"\bp\.\s?e\.\s?g\.|\bpoly\s?\(?\s?ethylene?[\s-]*glyc?k?ol\)?|\bpolyethylen?e?[\s-]*gly[ck]ol")


def normal(name: str, family: bool = True) -> list[str]:
    """Words of a name in the common form; without `family` spelled-out polymer names and other spellings stay, so that misspelled ones can be compared."""
    text = unicodedata.normalize("NFKD", name).lower().replace("μ", "u").replace("_", " ")
    text = "".join(c for c in text if not unicodedata.combining(c))
    if family:
        text = _PEG.sub("peg ", text)
        text = re.sub(r"\bpeg[\s-]*(?:mr|mw|m\.?w\.?)\b", "peg ", text)
        text = re.sub(r"monomethyl\s*ether", "mme", text)
    text = re.sub(r"(?<=\d)[,.](?=\d{3}\b)", "", text)
    text = re.sub(r"\b(peg|mme)[\s-]*\(?(\d+k?)\b\)?", r"\1 \2", text)
    text = re.sub(r"\b(\d+)k\b", lambda m: m[1] + "000", text)
    text = re.sub(r"\b([a-z]{1,2}\d?)\+(?=[\s-])", r"\1 ", text)
    words: list[str] = []
    for w in _TOKEN.findall(text):
        if not family:
            words.append(w)
        elif len(w) > 8 and (m := _COMPOUND.match(w)):
            words += [WORD_FORMS.get(m[1], m[1]), WORD_FORMS.get(m[2], m[2])]
        else:
            words += WORD_FORMS.get(w, w).split()
    if "mme" in words and "peg" in words:  # one order: peg mme number
        a = z = words.index("peg")
        while a > 0 and (words[a - 1] == "mme" or words[a - 1].isdigit()):
            a -= 1
        while z + 1 < len(words) and (words[z + 1] == "mme" or words[z + 1].isdigit()):
            z += 1
        if "mme" in words[a : z + 1]:
            words[a : z + 1] = ["peg", "mme", *[w for w in words[a : z + 1] if w not in ("peg", "mme")]]
        else:
            words = ["peg", "mme", *[w for w in words if w not in ("peg", "mme")]]
    return words


def _is_concentration(text: str) -> bool:
    kind = common(parse_unit(text))
    return kind is not None and kind[0] != "kelvin"


def without_unit(name: str) -> str:
    """The name without an amount and unit before it or a unit behind it."""
    if m := re.search(r"\s*(?:\(([^()]*(?:\([^()]*\)[^()]*)?)\)|\[([^\[\]]*)\]|,\s*in\s+(\S.*))\s*$", name):
        inner = next(g for g in m.groups() if g is not None)
        if m.start() > 0 and _is_concentration(inner):
            name = name[: m.start()]
    rest = name.lstrip()
    number = re.match(r"\d+(?:[.,]\d+)?(?![\w^.,-])\s*", rest)
    body = rest[number.end() :] if number else rest
    words = body.split()
    for n in range(min(4, len(words) - 1), 0, -1):
        if _is_concentration(" ".join(words[:n])):
            return " ".join(words[n:])
    return name


def _edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours swapped as one edit, or most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2 = row, before
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before2[j - 2] + 1)
        before = last
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=500_000)
def _word_score(a: str, b: str) -> float:
    d = _edits(a, b, 3)
    return 0.0 if d > 3 else 1 - d / max(len(a), len(b))


def _numbers(words) -> tuple[str, ...]:
    return tuple(sorted(re.findall(r"\d+", " ".join(words))))


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), minlength=128)[:128].astype(np.int32)


class Matcher:
    def __init__(self, entries: list[tuple[str, list[str]]]):
        """`entries`: (id, names) of every entry of the list; earlier entries win ties."""
        self.automaton = ahocorasick.Automaton()
        self.forms: list[tuple[str, tuple[str, ...], str]] = []
        taken: dict[str, str] = {}
        for cid, names in entries:
            for name in names:
                words = normal(name)
                if not words:
                    continue
                key = " ".join(words)
                taken.setdefault(key, cid)
                raw = normal(name, family=False)
                if raw != words:
                    self.forms.append((cid, tuple(raw), "".join(raw)))
                core = [w for w in words if w not in FILLERS]
                if core and core != words and not any(c.isdigit() for c in "".join(core)):
                    taken.setdefault(" ".join(core), cid)
        for key, cid in taken.items():
            self.automaton.add_word(f" {key} ", (cid, key))
            self.forms.append((cid, tuple(key.split()), key.replace(" ", "")))
        for symbol, cation in CATIONS.items():  # symbol for cation, also where the list has no such alias
            for key, cid in list(taken.items()):
                if key.startswith(cation + " ") and f"{symbol}{key[len(cation):]}" not in taken:
                    self.automaton.add_word(f" {symbol}{key[len(cation):]} ", (cid, f"{symbol}{key[len(cation):]}"))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str, str | None] = {}
        self.words = {w for _, words, _ in self.forms for w in words}
        self.by_digits: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}
        self.by_start: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        groups: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, (_, words, _) in enumerate(self.forms):
            groups[_numbers(words)].append(i)
        for digits, members in groups.items():
            self.by_digits[digits] = np.array(members), np.array([_letters(self.forms[i][2]) for i in members])
            self.by_start[digits] = sorted((w, i) for i in members for w in set(self.forms[i][1]))

    def mentioned(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Longest non-overlapping mentions as (start, length, id)."""
        text = f" {' '.join(words)} "
        found = [(len(key), end - len(key), cid) for end, (cid, key) in self.automaton.iter(text)] if len(self.automaton) else []
        chosen: list[tuple[int, int, str]] = []
        for length, start, cid in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(start + length <= a or a + n <= start for a, n, _ in chosen):
                chosen.append((start, length, cid))
        return chosen

    def closest(self, name: str) -> str | None:
        """The entry most similar as a set of words, if it is similar enough and alone."""
        best: dict[str, float] = {}
        for family in (True, False):
            words = normal(name, family)
            for core in ([w for w in words if w not in FILLERS or w in self.words], [w for w in words if w not in FILLERS]):
                self._compare([CATIONS.get(w, w) for w in core], best)
        ranked = sorted(best.items(), key=lambda x: -x[1])
        if not ranked or ranked[0][1] < MIN_SIMILARITY or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < MIN_LEAD):
            return None
        return ranked[0][0]

    def _compare(self, core: list[str], best: dict[str, float]) -> None:
        joined = "".join(core)
        digits = _numbers(core)
        if len(joined) < 3 or not any(c.isalpha() for c in joined) or (known := self.by_digits.get(digits)) is None:
            return
        members, letters = known
        difference = letters - _letters(joined)
        # no fewer edits than letters to add or to drop
        least = np.maximum(np.clip(difference, 0, None).sum(axis=1), np.clip(-difference, 0, None).sum(axis=1))
        near = set(members[least <= 0.36 * np.maximum(letters.sum(axis=1), len(joined))].tolist())
        # an abbreviated word may leave out more letters than edits allow
        for i in sorted(near | self._abbreviated(core, digits)):
            cid, form, flat = self.forms[i]
            score = max(self._flat(joined, flat) if i in near else 0.0, self._sets(core, form))
            if score > best.get(cid, 0.0):
                best[cid] = score

    def _abbreviated(self, core: list[str], digits: tuple[str, ...]) -> set[int]:
        """Forms with a longer word that starts with a word of the name, as `_sets` counts abbreviations."""
        starts, found = self.by_start[digits], set()
        for w in core:
            if len(w) > 3:
                for k in range(bisect_left(starts, (w,)), len(starts)):
                    word, i = starts[k]
                    if not word.startswith(w):
                        break
                    if word != w:
                        found.add(i)
        return found

    @staticmethod
    def _flat(a: str, b: str) -> float:
        longest = max(len(a), len(b))
        most = int(longest * (1 - MIN_SIMILARITY)) + 1
        d = _edits(a, b, most)
        return 0.0 if d > most else 1 - d / longest

    @staticmethod
    def _sets(a: list[str], b: tuple[str, ...]) -> float:
        """Similarity of two sets of words, each word paired with its closest free counterpart; abbreviated words count by their start."""
        free, total, weight = list(b), 0.0, 0
        for w in sorted(a, key=len, reverse=True):
            scored = [(1.0 if w == x else 0.9 if len(w) > 3 and x.startswith(w) else _word_score(w, x), x) for x in free]
            if not scored:
                weight += len(w)
                continue
            score, x = max(scored, key=lambda y: y[0])
            size = max(len(w), len(x))
            weight += size
            if score >= 0.5:
                total += score * size
                free.remove(x)
        return total / (weight + sum(map(len, free)))

    def match(self, name: str) -> str | None:
        if name in self.known:
            return self.known[name]
        if len(self.known) >= _MOST_NAMES:
            self.known.clear()
        bare = without_unit(name)
        words = normal(bare)
        found = self.mentioned(words)
        result = found[0][2] if found and self._names(name, words, found) else self.closest(bare)
        self.known[name] = result
        return result

    def _names(self, name: str, words: list[str], found: list[tuple[int, int, str]]) -> bool:
        """Whether the mentions are what the name is about, not parts of another name."""
        text = f" {' '.join(words)} "
        spans = sorted((start, start + length) for start, length, _ in found)
        rest = [text[a:b].split() for a, b in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(text)])]
        before, others = rest[0], rest[1:]
        plain = lambda w: w in FILLERS or w not in self.words and not w.isdigit() and (not w.isalpha() or len(w) < 3)
        if all(plain(w) for part in rest for w in part):
            return True
        mention = text[found[0][0] : found[0][0] + found[0][1]].strip()
        if len(mention) <= _SHORT and not any(w.lower() == mention and w != mention for w in re.findall(r"(?<![\w-])\w+(?![\w-])", name) if not name.isupper()):
            return False
        for w in reversed(before):
            if w in FUNCTION_WORDS or _VERB_FORM.match(w):
                break
            if not plain(w) and (w in self.words or w.isdigit() or _CHEMICAL.search(w)):
                return False
        for part in others:
            for w in part:
                if w in FUNCTION_WORDS or _VERB_FORM.match(w):
                    break
                if not plain(w):
                    return False
        return True


def map_names(df: DataFrame, key: str, name: str, canonical: str, reagents: DataFrame) -> DataFrame:
    """(key, canonical_id) of every row with a name whose `canonical` is not an id of the list."""
    ship_code(df.sparkSession)
    rows = bounded_rows(reagents.select("canonical_id", "display_name", "aliases").orderBy("canonical_id"), MAX_ENTRIES)
    if rows is None:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    entries = [(r["canonical_id"], [r["display_name"] or "", *(r["aliases"] or []), r["canonical_id"]]) for r in rows if r["canonical_id"]]
    shared = df.sparkSession.sparkContext.broadcast(entries)
    ids = [e[0] for e in entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([matcher.match(n) or UNMATCHED for n in b.column(0).to_pylist()], pa.string())], names=["_name", "_n", "canonical_id"])

    open_rows = df.where(F.col(name).rlike(r"(?U)[^\s]") & ~F.coalesce(F.col(canonical).isin(ids), F.lit(False))).select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    counted = open_rows.groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).repartition(parallelism(df.sparkSession))
    matched = written(counted.mapInArrow(run, "_name string, _n bigint, canonical_id string"), "matched")
    total = matched.agg(F.sum("_n")).first()[0] or 0
    heavy = [r["_name"] for r in matched.where(F.col("_n") >= max(2, HEAVY_SHARE * total)).orderBy(F.desc("_n")).limit(int(1 / HEAVY_SHARE)).collect()]
    return heavy_light_join(open_rows, matched.drop("_n"), "_name", "inner", heavy=heavy).select(F.col("_key").alias(key), "canonical_id")
