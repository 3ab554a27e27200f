"""Global ranks without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.runtime.session import parallelism, written


def running_sums(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds `<c>_before` for each of `sums`: its total over all rows before in a total order. Ranges are summed by themselves and shifted by the totals before them, so no task holds more than a range."""
    ranged = written(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])  # one row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}
    joined = ranged.withColumns(own).join(F.broadcast(offsets), "_range")
    return joined.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in sums}).drop("_range", *[f"_{c}" for c in sums])


def smallest(df: DataFrame, groups: list[str], order: list[Column], salt: Column, take: Column | int, out: str = "_rank") -> DataFrame:
    """The first `take` rows of each group with their rank; every salt of a group keeps its first ones before the group is brought together, so a group of any size is never in one task."""
    parts = F.pmod(F.xxhash64(salt), F.lit(max(8, parallelism(df.sparkSession)))).cast("int")
    take = take if isinstance(take, Column) else F.lit(take)
    first = df.withColumn("_salt", parts).withColumn(out, F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))).where(F.col(out) <= take)
    return first.drop("_salt").withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(out) <= take)


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the rank from 1 in a total order: rows are range-partitioned and written once, so ranges and counts agree; each range is ranked by itself and shifted by the rows before it."""
    ranged = written(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def band_of_rank(rank: Column, total: Column, bands: int) -> Column:
    """The band of equal count that a rank falls in, as ntile numbers them: the first bands hold one row more."""
    size, larger = F.floor(total / bands), total % bands
    head = larger * (size + 1)
    return F.when(rank <= head, F.ceil(rank / (size + 1))).otherwise(larger + F.ceil((rank - head) / F.greatest(size, F.lit(1)))).cast("int")
