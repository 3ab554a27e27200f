"""Screen libraries from page text: continuation lines, headings, completeness guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_wrapped(lines: DataFrame, page: str, line: str, text: str) -> DataFrame:
    """(page, number, condition): numbered lines with the unnumbered lines that continue them."""
    order = Window.partitionBy(page).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col(text).rlike(r"^\s*\d{1,3}[.)]?\s+\S")
    rows = lines.withColumn("_item", F.sum(start.cast("int")).over(order)).where("_item > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: F.trim(x[text])), " ")
    g = rows.groupBy(page, "_item").agg(joined.alias("t"))
    return g.select(page, F.regexp_extract("t", r"^(\d{1,3})", 1).cast("int").alias("number"), F.trim(F.regexp_replace("t", r"^\d{1,3}[.)]?\s+", "")).alias("condition"))


def carry_heading(lines: DataFrame, page: str, line: str, text: str, heading: str) -> DataFrame:
    """Adds the last heading before each line."""
    order = Window.partitionBy(page).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col(text).rlike(heading), F.trim(text))
    return lines.withColumn("heading", F.last(found, ignorenulls=True).over(order)).where(~F.coalesce(F.col(text).rlike(heading), F.lit(False)))


def rebuild_columns(cells: DataFrame, page: str, column: str, position: str, value: str, required: str) -> DataFrame:
    """(page, position, parts): parallel columns joined by position; pages whose columns differ in length or lack the required one are rejected."""
    sizes = cells.groupBy(page, column).agg(F.count(F.lit(1)).alias("n"))
    good = sizes.groupBy(page).agg(F.countDistinct("n").alias("d"), F.max(F.col(column) == required).alias("has")).where("d = 1 AND has").select(page)
    return cells.join(good, page, "left_semi").groupBy(page, position).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, value))), lambda x: x[value]), ", ").alias("parts"))


def complete_numbering(wells: DataFrame, screen: str, number: str) -> DataFrame:
    """(screen, n, complete): whether numbers run from 1 without gap or repeat."""
    g = wells.groupBy(screen).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return g.select(screen, "n", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("complete"))


def rectangular(wells: DataFrame, screen: str, well: str) -> DataFrame:
    """(screen, n_rows, n_columns, n, rectangular) of plates with wells like A1."""
    w = wells.select(screen, F.substring(well, 1, 1).alias("r"), F.substring(well, 2, 3).try_cast("int").alias("c"))
    g = w.groupBy(screen).agg(F.countDistinct("r").alias("n_rows"), F.countDistinct("c").alias("n_columns"), F.countDistinct("r", "c").alias("n"))
    return g.withColumn("rectangular", F.col("n_rows") * F.col("n_columns") == F.col("n"))


def plausible_screens(wells: DataFrame, screen: str, text: str, least: int = 24) -> DataFrame:
    """(screen, n, accepted): at least `least` wells, most of which state an amount."""
    g = wells.groupBy(screen).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(text).rlike(r"\d\s*(?:%|m\b|mm\b|M\b|mM\b|mmol|mol)").cast("double")).alias("stated"))
    return g.withColumn("accepted", (F.col("n") >= least) & (F.col("stated") >= 0.5))


def best_reading(readings: DataFrame, keys: list[str], text: str, priority: str) -> DataFrame:
    """One reading per well: one that states an amount before one that doesn't, then by priority."""
    order = Window.partitionBy(*keys).orderBy(F.when(F.col(text).rlike(r"\d"), 0).otherwise(1), priority, text)
    return readings.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def witness(counts: DataFrame, found: str, declared: str) -> DataFrame:
    """Adds the verdict of an independent count: a shortfall rejects, an excess is noted."""
    return counts.withColumn("verdict", F.when(F.col(declared).isNull(), "no_witness").when(F.col(found) < F.col(declared), "rejected").when(F.col(found) > F.col(declared), "excess").otherwise("agrees"))


def natural_order(well: str) -> list:
    return [F.substring(well, 1, 1), F.substring(well, 2, 3).try_cast("int")]


def filled_pages(lines: DataFrame, screen: str, page: str, number: str, text: str, shortest: int = 8) -> DataFrame:
    """(screen, number, text, page): the page with the most whole lines (at least `shortest` characters), and from the others the numbers it does not have; the first page by name decides ties. A number that was read is never replaced."""
    whole = lines.where(F.length(text) >= shortest)
    counts = whole.groupBy(screen, page).agg(F.countDistinct(number).alias("_n"))
    order = F.row_number().over(Window.partitionBy(screen).orderBy(F.desc("_n"), F.asc(page)))
    ranked = whole.join(counts.withColumn("_order", order), [screen, page])
    return ranked.groupBy(screen, number).agg(F.min_by(F.struct(text, page), F.struct("_order", text)).alias("x")).select(screen, number, f"x.{text}", f"x.{page}")
