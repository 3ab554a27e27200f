"""Language-model corpora from parsed records: routing, chat rows, de-duplication, mixing, answer checks and grounding."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions.quantity import is_implausible
from brineflow.functions.text import dedup_key, flat_alnum
from brineflow.runtime.session import bounded_rows, spread, written
from brineflow.schemas import ANSWER, ROLES, UNITS

#: Characters of the shortest spelling that is sought in a text.
SHORTEST = 3
#: Known names are broadcast up to this number, and shuffled beyond it.
MOST_SENT = 100_000


def usable_example(df: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    """(keys) of records that can teach: confident, not discarded, every component named or known to be none. Columns of both grains joined."""
    named = F.col("name_canonical").isNotNull() | F.coalesce(F.col("role") == "not_a_component", F.lit(False))
    g = df.groupBy(*keys).agg(F.min(named).alias("all_named"), F.min("parse_confidence").alias("c"), F.max("discard_reason").alias("d"))
    return g.where(F.col("all_named") & (F.col("c") >= least) & F.col("d").isNull()).select(*keys)


def route(usable: Column, held_out: Column, fold: Column, n_components: Column) -> Column:
    """residual, empty_answer, valid or train; a held-out record is never trained on."""
    return F.when(~usable, "residual").when(held_out, "held_out").when(n_components == 0, "empty_answer").when(fold == "val", "valid").when(fold == "test", "test").otherwise("train")


def target_json(components: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, target): the components of a record as compact JSON in order."""
    item = F.struct(F.col(order).alias("_o"), F.struct(F.col("role"), F.col("name_canonical").alias("name"), F.col("concentration").alias("amount"), F.col("unit")).alias("x"))
    return components.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda z: z["x"]), {"ignoreNullFields": "false"}).alias("target"))


def chat_rows(df: DataFrame, system: str, user: str, assistant: str) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col(user)), message("assistant", F.col(assistant))))


def distinct_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per normalised text, the first in order, with its number of copies; combined before the shuffle."""
    rest = [c for c in df.columns if c != text]
    g = df.where(F.col(text).rlike(r"[^ \t\n\r\f\x0B]")).groupBy(dedup_key(F.col(text)).alias("text_key")).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(order)).alias("r"), F.count(F.lit(1)).alias("n_copies"))
    return g.select("text_key", "n_copies", *[F.col(f"r.{c}").alias(c) for c in [text, *rest]])


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times`, with the number of the repeat."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.greatest(times.cast("int"), F.lit(1)))).alias("repeat"))


def mixing_repeats(n_base: int, n_extra: int, share: float) -> int:
    """Repeats of the extra rows that bring them to a share of the mix."""
    return max(1, round(n_base * share / (1 - share) / max(1, n_extra)))


def add_teacher_rows(base: DataFrame, teacher: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(union, conflicts): teacher rows whose text the base already has are dropped and counted."""
    known = base.select(dedup_key(F.col(text)).alias("_k")).distinct()
    keyed = teacher.withColumn("_k", dedup_key(F.col(text)))
    return base.unionByName(keyed.join(known, "_k", "left_anti").drop("_k"), allowMissingColumns=True), keyed.join(known, "_k", "left_semi").agg(F.count(F.lit(1)).alias("n_conflicts"))


def answer_error(answer: Column) -> Column:
    """Why an answer text is no valid list of components: unparseable, not_a_list, element_not_object, bad_role or bad_unit; null if it is valid."""
    parsed = F.try_parse_json(answer)
    kind = F.schema_of_variant(parsed)
    items = F.from_json(answer, ANSWER)
    # the schema of a list of objects reads ARRAY<OBJECT<...>>, an empty list ARRAY<VOID>
    bad_role = F.exists(items, lambda x: ~F.coalesce(x["role"].isin(*ROLES), F.lit(False)))
    bad_unit = F.exists(items, lambda x: x["unit"].isNotNull() & ~x["unit"].isin(*UNITS))
    return (
        F.when(answer.isNull() | parsed.isNull(), "unparseable")
        .when(~kind.startswith("ARRAY"), "not_a_list")
        .when(~kind.startswith("ARRAY<OBJECT") & ~kind.startswith("ARRAY<VOID"), "element_not_object")
        .when(F.coalesce(bad_role, F.lit(False)), "bad_role")
        .when(F.coalesce(bad_unit, F.lit(False)), "bad_unit")
    )


def repaired(answer: Column) -> Column:
    """An answer's components with the text null as null, and without amounts on what is no component."""
    clean = lambda c: F.when(F.lower(c) != "null", c)
    none = lambda x: x["role"] == "not_a_component"
    return F.transform(F.from_json(answer, ANSWER), lambda x: F.struct(
        clean(x["role"]).alias("role"), clean(x["name"]).alias("name"), F.when(~none(x), x["amount"]).alias("amount"), F.when(~none(x), clean(x["unit"])).alias("unit")
    ))


def repair_unit(unit: Column) -> Column:
    """A unit's closed name from its synonyms; a bare percentage is never guessed."""
    table = {"mm": "millimolar", "m": "molar", "um": "micromolar", "nm": "nanomolar", "% w/v": "percent_w_v", "%w/v": "percent_w_v", "% v/v": "percent_v_v", "%v/v": "percent_v_v", "mg/ml": "mg_ml", "g/l": "g_l", "%": "percent_unspecified"}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(unit.isin(*UNITS), unit).otherwise(F.try_element_at(known, F.lower(F.trim(unit))))


def last_json_array(text: Column) -> Column:
    """The last top-level JSON array in noisy text, null if none parses."""
    found = F.regexp_extract_all(text, F.lit(r"\[(?:[^\[\]]|\[[^\[\]]*\])*+\]"), F.lit(0))
    valid = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return F.try_element_at(valid, F.lit(-1))


def component_key(role: Column, name: Column, amount: Column, unit: Column) -> Column:
    """Identity of a component with the amount to four places; a missing amount or unit is empty, a missing role or name left out."""
    return F.concat_ws("|", role, name, F.when(amount.isNotNull(), F.format_string("%.4f", amount)).otherwise(""), F.coalesce(unit, F.lit("")))


def grounded(mentions: DataFrame, key: str, name: str, text: str, spellings: DataFrame) -> DataFrame:
    """(key, name, grounded, longest_hit): whether a spelling of the name stands in the text, and not only as the start of a longer known spelling there.

    `spellings` is (name, flat); both sides are compared without punctuation.
    """
    rows = mentions.select(key, name, flat_alnum(F.col(text)).alias("_t"))
    hit = rows.join(spellings, name).where(F.contains(F.col("_t"), F.col("flat")))
    others = spellings.select(F.col("flat").alias("longer"), F.col(name).alias("_other"))
    longer = spellings.join(others, (F.substring("longer", 1, SHORTEST) == F.substring("flat", 1, SHORTEST)) & F.col("longer").startswith(F.col("flat")) & (F.length("longer") > F.length("flat"))).where(F.col("_other") != F.col(name))
    # the longest are taken out first
    by_length = lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)
    longer = longer.groupBy("flat").agg(F.array_sort(F.collect_set("longer"), by_length).alias("longer"))
    free = hit.join(longer, "flat", "left").withColumn("_rest", F.aggregate(F.coalesce("longer", F.array().cast("array<string>")), F.col("_t"), lambda acc, w: F.replace(acc, w, F.lit("#"))))
    ok = free.where(F.contains(F.col("_rest"), F.col("flat"))).groupBy(key, name).agg(F.max(F.length("flat")).alias("longest_hit"))
    return mentions.select(key, name).join(ok, [key, name], "left").select(key, name, F.col("longest_hit").isNotNull().alias("grounded"), "longest_hit")


def spellings_of(reagents: DataFrame, name: str = "canonical_id") -> DataFrame:
    """(name, flat): every spelling without punctuation, of at least three characters."""
    all_names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return reagents.select(name, F.explode(all_names).alias("s")).select(name, flat_alnum(F.col("s")).alias("flat")).where(F.length("flat") >= SHORTEST).distinct()


def best_ratio(df: DataFrame, name: str, text: str, out: str = "similarity") -> DataFrame:
    """Adds the best matching-blocks ratio of a name against the windows of its length in a text; Arrow batches, no native equivalent."""

    @F.pandas_udf("double")
    def ratio(names: pd.Series, texts: pd.Series) -> pd.Series:
        def one(n: str | None, t: str | None) -> float | None:
            if not n or not t:
                return None
            n, t = n.lower(), t.lower()
            if n in t:
                return 1.0
            matcher = difflib.SequenceMatcher(None, autojunk=False)
            matcher.set_seq2(n)
            best = 0.0
            for i in range(max(1, len(t) - len(n) + 1)):
                matcher.set_seq1(t[i : i + len(n)])
                if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                    best = max(best, matcher.ratio())
            return best

        return pd.Series([one(a, b) for a, b in zip(names, texts)], dtype="float64")

    return df.withColumn(out, ratio(F.col(name), F.col(text)))


def close_matches(names: DataFrame, name: str, known: DataFrame, candidate: str, cutoff: float, n: int) -> DataFrame:
    """(name, candidate, ratio, rank): the n closest known names at or above a cutoff, of all known names.

    Every distinct name meets every known name, which are few; pairs are left out only by upper bounds of the ratio: the
    lengths, in the join, and the common letters, before the blocks are matched.
    """
    a, b = names.select(name).distinct(), known.select(candidate).distinct()
    if bounded_rows(b, MOST_SENT) is not None:
        b = F.broadcast(b)
    both = F.length(name) + F.length(candidate)
    pairs = spread(a).join(b, 2 * F.least(F.length(name), F.length(candidate)) >= (cutoff - 1e-9) * both)

    @F.pandas_udf("double")
    def ratio(xs: pd.Series, ys: pd.Series) -> pd.Series:
        matchers: dict[str, difflib.SequenceMatcher] = {}

        def one(x: str, y: str) -> float | None:
            if (m := matchers.get(y)) is None:
                m = matchers[y] = difflib.SequenceMatcher(None, "", y, autojunk=False)
            m.set_seq1(x)
            return m.ratio() if m.quick_ratio() >= cutoff else None

        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype="float64")

    scored = pairs.withColumn("ratio", ratio(F.col(name), F.col(candidate))).where(F.col("ratio") >= cutoff)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("ratio"), F.asc(candidate)))).where(F.col("rank") <= n)


def rules_win(rules: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rule components and those of the model the rules do not have, with their provenance; repeated model rows count once."""
    known = rules.select(*keys).distinct()
    extra = model.dropDuplicates(keys)
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    extra = extra.alias("m").join(known.alias("r"), same, "left_anti")
    return rules.withColumn("provenance", F.lit("rules")).unionByName(extra.withColumn("provenance", F.lit("model")), allowMissingColumns=True)


def replace_gaps(rules: DataFrame, model: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """A record's components from the model, all of them, where the rules left a gap; else those of the rules."""
    gaps = rules.groupBy(*keys).agg(F.max(gap).alias("_gap")).where("_gap").select(*keys)
    replaced = gaps.join(model.select(*keys).distinct(), keys, "left_semi")
    return rules.join(replaced, keys, "left_anti").withColumn("provenance", F.lit("rules")).unionByName(model.join(replaced, keys, "left_semi").withColumn("provenance", F.lit("model")), allowMissingColumns=True)


def length_percentiles(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.where(F.col(text).isNotNull()).agg(F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.99)).alias("p99"), F.max(n).alias("longest"), F.count(F.lit(1)).alias("n"))


def mixed(base: DataFrame, extra: DataFrame, share: float) -> DataFrame:
    """`base` and `extra`, the latter repeated until it has about a share of the mix; `repeat` numbers the copies."""
    times = mixing_repeats(base.count(), extra.count(), share)
    return base.withColumn("repeat", F.lit(1)).unionByName(oversample(extra, F.lit(times)), allowMissingColumns=True)


def teacher_components(components: DataFrame, key: str, name: str, amount: str, text: str, spellings: DataFrame, least: int = 8) -> DataFrame:
    """Components a teacher may be believed: with an amount, and named by a spelling of at least `least` characters in the text."""
    found = grounded(components.select(key, name, text).distinct(), key, name, text, spellings).where(F.col("longest_hit") >= least)
    return components.where(F.col(amount).isNotNull()).join(found.select(key, name), [key, name], "left_semi")


def recanonicalised(snapshot: DataFrame, name: str, lookup: DataFrame, key: Callable[[Column], Column] = lambda c: F.lower(F.trim(c))) -> DataFrame:
    """A stale snapshot with today's ids in `name_now` and what became of each name: kept, remapped or dropped. `lookup` is (key, canonical_id), ids among the keys."""
    ids = lookup.select(F.col("canonical_id").alias("_id")).distinct()
    j = snapshot.join(ids, F.col(name) == F.col("_id"), "left").withColumn("_key", key(F.col(name))).join(lookup.select(F.col("key").alias("_key"), F.col("canonical_id").alias("_now")), "_key", "left")
    now = F.coalesce("_id", "_now")
    return j.select(*snapshot.columns, now.alias("name_now"), F.when(now.isNull(), "dropped").when(now == F.col(name), "kept").otherwise("remapped").alias("fate"))


def guarded_answers(
    items: DataFrame, texts: DataFrame, keys: list[str], lookup: DataFrame, spellings: DataFrame, fuzzy: float | None = 0.75, key: Callable[[Column], Column] = lambda c: F.lower(F.trim(c)),
) -> DataFrame:
    """Answers of a model (keys, ordinal, role, name, amount, unit, valid) with what each guard says.

    In order: `stale` if the record is not among `texts` (keys, text) any more, `invalid` if the answer did not parse,
    `unknown` if the name resolves to nothing, `ungrounded` if no spelling of it stands in the text, nor a near miss
    of at least `fuzzy`; else `kept`. What is no component needs neither name nor place. Impossible amounts are cleared
    and marked; `rescued` says whether an alias or a near miss saved a row. Ratios are computed for rows only that are
    not grounded as they stand.
    """
    j = items.join(texts.select(*keys, F.col("text").alias("_text"), F.lit(True).alias("_there")), keys, "left")
    resolved = recanonicalised(j, "name", lookup, key).withColumn("_row", F.xxhash64(*keys, "ordinal"))
    none = F.coalesce(F.col("role") == "not_a_component", F.lit(False))
    open_rows = written(resolved.withColumn("_none", none), "answers")
    sought = open_rows.where("_there AND valid AND NOT _none AND name_now IS NOT NULL").select("_row", "name_now", "_text").distinct()
    found = grounded(sought, "_row", "name_now", "_text", spellings.withColumnRenamed(spellings.columns[0], "name_now")).select("_row", "name_now", F.col("grounded").alias("_grounded"))
    out = open_rows.join(found, ["_row", "name_now"], "left")
    near = F.lit(False)
    if fuzzy is not None:
        missed = out.where("_there AND valid AND NOT _none AND NOT _grounded").select("_row", "name_now", "_text")
        named = missed.join(spellings.withColumnRenamed(spellings.columns[0], "name_now"), "name_now").withColumn("_flat", flat_alnum(F.col("_text")))
        scored = best_ratio(named, "flat", "_flat", "_ratio").groupBy("_row", "name_now").agg(F.max("_ratio").alias("_ratio"))
        out = out.join(scored, ["_row", "name_now"], "left")
        near = F.coalesce(F.col("_ratio") >= fuzzy, F.lit(False))
    outcome = (
        F.when(F.col("_there").isNull(), "stale").when(~F.coalesce(F.col("valid"), F.lit(False)), "invalid").when(F.col("_none"), "kept")
        .when(F.col("name_now").isNull(), "unknown").when(~(F.coalesce(F.col("_grounded"), F.lit(False)) | near), "ungrounded").otherwise("kept")
    )
    impossible = is_implausible(F.col("amount"), F.col("unit"))
    rescued = F.when(F.col("outcome") == "kept", F.when(~F.col("_none") & ~F.coalesce(F.col("_grounded"), F.lit(False)), "typo").when(~F.col("_none") & (F.col("fate") == "remapped"), "alias"))
    done = out.withColumn("outcome", outcome).withColumn("implausible", impossible)
    return done.select(
        *keys, "ordinal", "role", "name", F.when((F.col("outcome") == "kept") & ~F.col("_none"), F.col("name_now")).alias("name_canonical"),
        F.when(~F.col("implausible"), F.col("amount")).alias("amount"), F.when(~F.col("implausible"), F.col("unit")).alias("unit"), "implausible", "outcome", rescued.alias("rescued"),
    )


def guard_counts(guarded: DataFrame) -> DataFrame:
    """(outcome, n, n_rescued, n_implausible) of `guarded_answers`."""
    return guarded.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("rescued").alias("n_rescued"), F.count_if("implausible").alias("n_implausible"))


def answered(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], list[str]]], done: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(key, answer) of every row that `done` (key, ...) does not have yet, so a run that was cut short goes on where its output ends.

    `model` makes the callable in each task, once; it gets lists of at most `batch` texts. Null text is not asked.
    """
    rows = df.select(key, text).where(F.col(text).isNotNull())
    if done is not None:
        rows = rows.join(done.select(key).distinct(), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for f in frames:
            answers = [a for at in range(0, len(f), batch) for a in ask(f.iloc[at : at + batch, 1].tolist())]
            yield pd.DataFrame({key: f.iloc[:, 0], "answer": answers})

    return spread(rows).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, answer string")
