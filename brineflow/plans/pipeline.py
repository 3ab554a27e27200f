"""Queries of the general training-data operators: packed values (p1) and units (p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brineflow.operators import packed, units
from brineflow.runtime.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.explode_values(table(spark, sf_dir, "conditions"), "record_id", "raw_details", "source")


def p1_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.delimiter_scores(table(spark, sf_dir, "conditions"), "raw_details", "source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.convert(table(spark, sf_dir, "components"), "component_id", "concentration", "unit", "unit_inferred", "name_raw")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_delimiters": p1_delimiters, "p7_found": p7_found}
ORACLES: dict[str, str] = {}
