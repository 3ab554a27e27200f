"""Join helpers: heavy-light joins for skewed keys, reconciliation, cascades and merges with precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this share of the left rows, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.005


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Keys that hold at least `share` of the rows; at most 1/share of them, found with a bounded sketch per task."""
    most = int(2 / share)
    found = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {most * 16})").alias("top")).first()
    return [t["item"] for t in found["top"] or [] if t["count"] >= max(2, share * found["n"])]


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: Sequence | None = None) -> DataFrame:
    """Joins on a skewed left key: `right` is unique by `key`, so the rows of the few heavy keys are a bounded broadcast; the rest is shuffled."""
    heavy = heavy_keys(left, key) if heavy is None else list(heavy)
    if not heavy:
        return left.join(right, key, how)
    hot = F.col(key).isin(heavy)
    is_hot = F.coalesce(hot, F.lit(False))
    first = left.where(is_hot).join(F.broadcast(right.where(hot)), key, how)  # at most len(heavy) rows
    return first.unionByName(left.where(~is_hot).join(right.where(~hot), key, how))


def where_if(df: DataFrame, condition: Column, wanted: bool) -> DataFrame:
    """`df` filtered if `wanted`; the plan has no filter otherwise."""
    return df.where(condition) if wanted else df


def beside(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables side by side, by their ranks in stated orders; the longer one's rest has nulls. Positions never depend on how rows lie in files."""
    from brineflow.operators.ranks import global_rank

    return global_rank(left, left_order, "_place").join(global_rank(right, right_order, "_place"), "_place", "full_outer").drop("_place")


def first_by_name(df: DataFrame, keys: list[str], name: str, order: str, value: str) -> DataFrame:
    """(keys, by_name): for each key a map from name to the value of its first row."""
    first = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min_by(value, order).alias("_v"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias("by_name"))


def bridge(accessions: DataFrame, sequences: DataFrame, clusters: DataFrame, accession: str, via: str, cluster: str) -> DataFrame:
    """(accession, cluster): from one key space to another over a middle key: the smallest cluster of any of an accession's `via` keys."""
    pairs = accessions.select(accession, via).distinct().join(sequences.select(via, "middle").distinct(), via)
    return pairs.join(clusters.select("middle", cluster).distinct(), "middle").groupBy(accession).agg(F.min(cluster).alias(cluster))
