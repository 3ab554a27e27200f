"""Incremental plans: new files only, each record once, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the files of a folder; the checkpoint of the query remembers which are done."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def process_available(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `each` on what is new and stops. A batch that is repeated after a loss has the same number, by which `each` must be idempotent."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, by: str, value: str, width: str, late: str | None = None) -> DataFrame:
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
