"""Splits, stratified samples, hold-outs and their audits. Draws are by hash, so they do not depend on order or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions.stats import hash_fold
from brineflow.functions.text import dedup_key
from brineflow.operators.graph import connected_components
from brineflow.operators.joins import heavy_light_join
from brineflow.operators.ranks import band_of_rank, global_rank, smallest


def component_folds(df: DataFrame, key: str, relations: list[str]) -> DataFrame:
    """(key, component, fold): components over several cluster relations, each named by its smallest node; rows without any relation are left out."""
    first = relations[0]
    node = lambda c: F.concat(F.lit(c + ":"), F.col(c))
    has = F.coalesce(*[node(c) for c in relations])
    edges = None
    for c in relations:
        part = df.where(F.col(c).isNotNull()).select(has.alias("a"), node(c).alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    found = connected_components(edges.distinct())
    rows = heavy_light_join(df.where(has.isNotNull()).select(key, has.alias("node")), found, "node", "inner")
    return rows.select(key, "component", hash_fold(F.col("component")).alias("fold"))


def leaks(df: DataFrame, fold: str, levels: list[str]) -> DataFrame:
    """(level, n_clusters, n_leaking): clusters whose rows lie in more than one fold."""
    out = None
    for c in levels:
        part = df.where(F.col(c).isNotNull() & F.col(fold).isNotNull()).groupBy(c).agg(F.countDistinct(fold).alias("n")).agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_leaking"))
        part = part.select(F.lit(c).alias("level"), "n_clusters", "n_leaking")
        out = part if out is None else out.unionByName(part)
    return out


def allocation(df: DataFrame, strata: list[str], size: int, floor: int = 3) -> DataFrame:
    """(strata, n, take): a floor for every stratum, the rest in proportion and rounded down, never more than there is."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    total, groups = F.sum("n").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    rest = F.greatest(F.lit(size) - floor * groups, F.lit(0))
    return counts.withColumn("take", F.least(F.col("n"), (F.lit(floor) + F.floor(rest * F.col("n") / total)).cast("bigint")))


def drawn(df: DataFrame, key: str, strata: list[str], take: Column | int, seed: str = "s") -> DataFrame:
    """The first `take` rows of each stratum by the SHA-256 of seed and key, ties by key."""
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return smallest(df.withColumn("_h", h), strata, [F.asc("_h"), F.asc(key)], F.col(key), take).drop("_h", "_rank")


def stratified(df: DataFrame, key: str, strata: list[str], size: int, floor: int = 3, seed: str = "s") -> DataFrame:
    """A draw from each stratum of the size that `allocation` gives it; the strata are few beside the rows and are sent to them if their number allows it."""
    takes = allocation(df, strata, size, floor)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in strata]
    joined = df.alias("l").join(takes.alias("r"), same).select("l.*", F.col("r.take").alias("_take"))
    return drawn(joined, key, strata, F.col("_take"), seed).drop("_take")


def banded_sample(df: DataFrame, key: str, value: str, bands: int, per_band: int, seed: str = "s") -> DataFrame:
    """A draw from each of `bands` bands of equal count by value."""
    ranked = global_rank(df, [F.asc(value), F.asc(key)], "_global")
    banded = ranked.withColumn("band", band_of_rank(F.col("_global"), F.lit(df.count()), bands)).drop("_global")
    return drawn(banded, key, ["band"], per_band, seed)


def topped_up_sample(df: DataFrame, key: str, value: str, bands: int, size: int, seed: str = "s") -> DataFrame:
    """`size` rows, the same number from each band of equal count by value; what that leaves open is filled with further rows in hash order."""
    first = banded_sample(df, key, value, bands, size // bands, seed).drop("band")
    rest = drawn(df.join(first.select(key), key, "left_anti").withColumn("_all", F.lit(1)), key, ["_all"], size, seed).drop("_all")
    both = first.withColumn("_turn", F.lit(0)).unionByName(rest.withColumn("_turn", F.lit(1)))
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return both.orderBy("_turn", h, key).limit(size).drop("_turn")


def forced_sample(df: DataFrame, key: str, rare: Column, size: int, n_rare: int, seed: str = "s") -> DataFrame:
    """A sample with a fixed number of rows of a rare kind."""
    marked = df.withColumn("_is", F.coalesce(rare, F.lit(False)))
    return drawn(marked, key, ["_is"], F.when(F.col("_is"), n_rare).otherwise(size - n_rare), seed).drop("_is")


def balanced_texts(df: DataFrame, key: str, text: str, by: str, per_group: int, low: int = 20, high: int = 220, seed: str = "s") -> DataFrame:
    """Texts of bounded length, one per distinct text, the same number from each provenance."""
    kept = df.where(F.length(text).between(low + 1, high - 1)).withColumn("_k", dedup_key(F.col(text)))
    first = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("_k").orderBy(key))).where("_rn = 1").drop("_rn", "_k")
    return drawn(first, key, [by], per_group, seed)


def hold_out(df: DataFrame, held: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that share neither the key nor the normalised text with the held-out rows."""
    keys = held.select(key).distinct()
    texts = held.select(dedup_key(F.col(text)).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return df.join(keys, key, "left_anti").withColumn("_k", dedup_key(F.col(text))).join(texts, "_k", "left_anti").drop("_k")


def frozen_set(df: DataFrame, key: str, text: str, size: int, seed: str = "s") -> DataFrame:
    """(key, ordinal): a benchmark of distinct texts in hash order."""
    first = df.withColumn("_k", dedup_key(F.col(text))).where("_k <> ''").groupBy("_k").agg(F.min(key).alias(key))
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    top = first.select(key, h.alias("h")).orderBy("h", key).limit(size)
    return top.select(key, F.row_number().over(Window.orderBy("h", key)).cast("int").alias("ordinal"))


def merged_proposals(sources: list[tuple[str, DataFrame]], keys: list[str], name: str) -> DataFrame:
    """Names proposed by several sources, once per key and name, credited to the first source that has it."""
    out = None
    for rank, (label, df) in enumerate(sources):
        part = df.select(*keys, name, F.lit(rank).alias("_rank"), F.lit(label).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, name).agg(F.min_by("source", "_rank").alias("source"))


def disagreement(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, stratum, only_a, only_b): records on whose names two sources differ, by who has more: both, a_only or b_only; agreements are left out."""
    side = lambda df, c: df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.collect_set(name).alias(c))
    j = side(a, "_a").join(side(b, "_b"), keys, "full_outer")
    empty = F.array().cast("array<string>")
    x, y = F.coalesce("_a", empty), F.coalesce("_b", empty)
    d = j.select(*keys, F.size(F.array_except(x, y)).alias("only_a"), F.size(F.array_except(y, x)).alias("only_b"))
    return d.withColumn("stratum", F.when((F.col("only_a") > 0) & (F.col("only_b") > 0), "both").when(F.col("only_a") > 0, "a_only").when(F.col("only_b") > 0, "b_only")).where("stratum IS NOT NULL")
