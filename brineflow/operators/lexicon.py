"""The lexicon as a dimension: validation, alias index, lookups with fallbacks, coverage and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions.text import match_key, normalise, strip_prose, tidy_name, titrant_stripped, without_trailing_ph
from brineflow.operators.ranks import running_sums
from brineflow.runtime.session import bounded_rows


def violations(reagents: DataFrame) -> DataFrame:
    """(rule, canonical_id) for every broken rule: id shape, repeated id, weight without polymer or the reverse, alias owned twice."""
    shape = reagents.where(~F.col("canonical_id").rlike("^[A-Z0-9]+(_[A-Z0-9]+)*$")).select(F.lit("id_shape").alias("rule"), "canonical_id")
    repeated = reagents.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_id").alias("rule"), "canonical_id")
    weight = reagents.where((F.col("chem_class") == "peg") != F.col("peg_mw").isNotNull()).select(F.lit("weight").alias("rule"), "canonical_id")
    owned = alias_index(reagents, first_only=False).groupBy("norm_name").agg(F.countDistinct("canonical_id").alias("n"), F.min("canonical_id").alias("canonical_id"))
    return shape.unionByName(repeated).unionByName(weight).unionByName(owned.where("n > 1").select(F.lit("alias_owned_twice").alias("rule"), "canonical_id"))


def alias_index(reagents: DataFrame, first_only: bool = True) -> DataFrame:
    """(norm_name, canonical_id, ...): ids, display names and aliases in the form of parsed names; the first claim wins."""
    names = F.array_compact(F.concat(F.array("display_name", F.lower(F.translate("canonical_id", "_", " "))), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = reagents.select("*", F.posexplode(names).alias("claim", "alias")).withColumn("norm_name", tidy_name(normalise(F.col("alias")))).where("norm_name <> ''")
    rows = rows.drop("aliases", "alias", "display_name")
    if not first_only:
        return rows.drop("claim").distinct()
    first = Window.partitionBy("norm_name").orderBy("claim", "canonical_id")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "claim")


def with_premixes(reagents: DataFrame) -> DataFrame:
    """Adds `only_buffers`: whether a premix, by its column `premix_components` if the list has one, is made of buffers only; null if unknown."""
    if "premix_components" not in reagents.columns:
        return reagents.withColumn("only_buffers", F.lit(None).cast("boolean"))
    classes = reagents.select(F.col("canonical_id").alias("_part"), (F.col("chem_class") == "buffer").alias("_buffer"))
    parts = reagents.select("canonical_id", F.explode("premix_components").alias("_part")).join(classes, "_part")
    made = parts.groupBy("canonical_id").agg(F.min("_buffer").alias("only_buffers"))
    return reagents.join(made, "canonical_id", "left").drop("premix_components")


def local_index(reagents: DataFrame, most: int = 200_000) -> DataFrame:
    """The alias index as a local table, so that each of several lookups broadcasts it without computing it again; raises above `most` aliases."""
    index = alias_index(reagents)
    rows = bounded_rows(index, most)
    if rows is None:
        raise ValueError(f"the lexicon has more than {most} aliases")
    return reagents.sparkSession.createDataFrame(rows, index.schema)


def lookup_cascade(df: DataFrame, name: str, index: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `columns` of the index by the full name, else without titrant, else without trailing pH, else without prose.

    The four keys of a row become one array; the index is joined once per key and is small, so each join is a
    broadcast if its size allows it.
    """
    keys = [F.col(name), titrant_stripped(F.col(name)), tidy_name(without_trailing_ph(F.col(name))), tidy_name(strip_prose(F.col(name)))]
    out = df
    for i, key in enumerate(keys):
        part = index.select(F.col("norm_name").alias(f"_k{i}"), F.struct(*columns).alias(f"_r{i}"))
        missing = F.coalesce(*[F.col(f"_r{j}") for j in range(i)]).isNull() if i else F.lit(True)
        # a key is built only for names not found so far
        out = out.withColumn(f"_key{i}", F.when(missing, key)).join(part, F.col(f"_key{i}") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = F.coalesce(*[F.col(f"_r{i}") for i in range(4)])
    step = F.when(F.col("_r0").isNotNull(), "name").when(F.col("_r1").isNotNull(), "titrant").when(F.col("_r2").isNotNull(), "ph").when(F.col("_r3").isNotNull(), "prose")
    out = out.withColumn("_found", found).withColumn("match_step", step)
    return out.select(*df.columns, "match_step", *[F.col(f"_found.{c}").alias(c) for c in columns])


def running_coverage(df: DataFrame, name: str, mass: str) -> DataFrame:
    """Adds rank, share and cumulative coverage by descending mass, ties by name. `df` is one row per name; ranges are summed by themselves."""
    total = df.agg(F.sum(mass).alias("_total"))  # one row
    summed = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [F.desc(mass), F.asc(name)], [mass, "_one"]).join(F.broadcast(total))
    coverage = (F.col(f"{mass}_before") + F.col(mass)) / F.col("_total")
    return summed.select(*df.columns, (F.col("_one_before") + 1).cast("int").alias("rank"), coverage.alias("coverage"))


def names_to_cover(ranked: DataFrame, targets: list[float]) -> DataFrame:
    """(target, n_names): how many of the most frequent names cover each share of the mass."""
    goals = ranked.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    return goals.join(ranked.select("rank", "coverage"), F.col("coverage") >= F.col("target") - F.lit(1e-12)).groupBy("target").agg(F.min("rank").alias("n_names"))


def candidates(components: DataFrame, name: str, entry: str) -> DataFrame:
    """(norm_name, n_uses, n_entries, example) of every name; an example is the smallest raw form."""
    named = components.withColumn("norm_name", tidy_name(normalise(F.col(name)))).where("norm_name <> ''")
    return named.groupBy("norm_name").agg(F.count(F.lit(1)).alias("n_uses"), F.countDistinct(entry).alias("n_entries"), F.min(name).alias("example"))


def coverage_by_class(candidate_rows: DataFrame, index: DataFrame) -> DataFrame:
    """(chem_class, n_names, n_uses): mass of names by class of the reagent they resolve to; unresolved names are one class."""
    joined = candidate_rows.join(index.select("norm_name", "chem_class"), "norm_name", "left")
    return joined.groupBy(F.coalesce("chem_class", F.lit("unresolved")).alias("chem_class")).agg(F.count(F.lit(1)).alias("n_names"), F.sum("n_uses").alias("n_uses"))


def mode_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, share, rank): shares of each value within its group, the most frequent first, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), F.asc(value))))


def merged_queue(proposals: DataFrame, corpus: DataFrame, name: str, weight: str) -> DataFrame:
    """One row per comparison key from two sources: a proposal absorbs the corpus forms of its key, with the larger weight."""
    a = proposals.groupBy(match_key(F.col(name)).alias("key")).agg(F.min(name).alias("proposed"), F.sum(weight).alias("w_proposed"))
    b = corpus.groupBy(match_key(F.col(name)).alias("key")).agg(F.min(name).alias("seen"), F.sum(weight).alias("w_seen"))
    both = a.join(b, "key", "full_outer")
    return both.select("key", F.coalesce("proposed", "seen").alias("name"), F.greatest(F.coalesce("w_proposed", F.lit(0)), F.coalesce("w_seen", F.lit(0))).alias("weight"), F.col("proposed").isNotNull().alias("is_proposal"))


def unanswered(questions: DataFrame, answers: DataFrame, key: str, reask: DataFrame | None = None) -> DataFrame:
    """Questions without an answer, and those to be asked again."""
    open_ones = questions.join(answers.select(key).distinct(), key, "left_anti")
    return open_ones if reask is None else open_ones.unionByName(questions.join(reask.select(key).distinct(), key, "left_semi")).dropDuplicates([key])


def apply_answers(questions: DataFrame, answers: DataFrame, key: str, recommended: str) -> DataFrame:
    """The decision on each question: the answer, or the recommendation where there is none, with its outcome."""
    joined = questions.join(answers.select(key, F.col("chosen")), key, "left")
    return joined.withColumn("decision", F.coalesce("chosen", recommended)).withColumn(
        "outcome", F.when(F.col("chosen").isNull(), "default").when(F.col("chosen") == F.col(recommended), "confirmed").otherwise("changed")
    )


def decision_bucket(resolved: Column, reason: Column, chemistry: Column) -> Column:
    return F.when(resolved.isNotNull(), "map").when(reason.isNotNull(), "not_a_reagent").when(chemistry, "new").otherwise("leave")


def unit_anomalies(df: DataFrame, name: str, unit: str, low: float = 0.005, high: float = 0.15, least: int = 50) -> DataFrame:
    """Minority units of a reagent: a share between `low` and `high` among at least `least` uses."""
    shares = mode_share(df, name, unit)
    total = Window.partitionBy(name)
    return shares.withColumn("n_total", F.sum("n").over(total)).where((F.col("share") > low) & (F.col("share") < high) & (F.col("n_total") >= least)).drop("rank")


def distinct_ids(names: DataFrame, base: str) -> DataFrame:
    """Adds `id`: the base with a numeric suffix on collision, in order of the base's rows by name."""
    same = Window.partitionBy(base).orderBy(*[F.asc(c) for c in names.columns if c != base])
    rank = F.row_number().over(same)
    return names.withColumn("_r", rank).withColumn("id", F.when(F.col("_r") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("_r").cast("string")))).drop("_r")
