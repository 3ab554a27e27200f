"""Duplicates hidden by formatting differences.

Byte-identical rows collapse first, with map-side partial counts; only the distinct survivors are canonicalised in
Arrow batches; a second aggregation on the full canonical text sums the counts. Both aggregations combine before
they shuffle, so a text that holds a third of all rows is one row per task before it moves.

Defined results: null and blank text and text without any letter or digit are no cases; ties take the smallest id;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.operators.packed import content_column
from brineflow.runtime.session import written


def collapse(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(content, record_id, n_copies): every distinct content with its smallest key and its number of rows.

    The delimiter rules of a field depend on its source, so identical rows are collapsed per text and source.
    """
    raw = (
        df.select(F.col(key).alias("record_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
        .where(F.col("text").rlike(r"[\p{L}\p{N}]"))
        .groupBy("text", "source")
        .agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n"))
    )
    # both passes of the splitter read the survivors, so they are collapsed once
    return (
        content_column(written(raw, "distinct"), "text", "source")
        .where(F.col("content").isNotNull())
        .groupBy("content")
        .agg(F.min("record_id").alias("record_id"), F.sum("n").alias("n_copies"))
    )


def duplicate_sets(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per set of two or more records with equal content: its smallest key and its size."""
    return collapse(df, key, text, source).where(F.col("n_copies") >= 2).select("record_id", "n_copies")
