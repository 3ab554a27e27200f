"""Exact nearest vectors of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brineflow.runtime.session import ship_code

#: Queries held by a worker at once; more queries take several passes over the rows.
BLOCK = 20_000
#: Similarities a worker holds at once: a batch of rows is taken in pieces of this many queries times rows.
CELLS = 4_000_000


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, target, similarity, rank): the k rows with the largest cosine to each query, the query itself left out, ties to the smaller key.

    Query ids and vectors of one block are a broadcast of known size; each task multiplies its rows with them and keeps
    the best k per query, so at most k rows per query and task are shuffled. Null and zero vectors have no neighbours.
    """
    ship_code(queries.sparkSession)
    spark = queries.sparkSession
    numbered = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))
    blocks = max(1, -(-numbered.count() // BLOCK))
    out = None
    for n in range(blocks):
        block = numbered.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == n).collect() if blocks > 1 else numbered.collect()
        if not block:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["k"] for r in block], dtype=np.int64), _unit(np.array([r["v"] for r in block], dtype=np.float64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s = np.full((len(ids), 0), 0.0)
            best_t = np.zeros((len(ids), 0), dtype=np.int64)
            for b in _pieces(batches, max(1, CELLS // len(ids))):
                valid = b.column(1).is_valid().to_numpy(zero_copy_only=False)
                if not valid.any():
                    continue
                b = b.filter(pa.array(valid))
                t = b.column(0).to_numpy()
                v = _unit(np.asarray(b.column(1).to_pylist(), dtype=np.float64))
                s = q @ v.T
                s[ids[:, None] == t[None, :]] = -np.inf
                s[:, ~np.isfinite(v).all(axis=1)] = -np.inf
                s = np.round(s, 12)
                all_s, all_t = np.concatenate([best_s, s], axis=1), np.concatenate([best_t, np.broadcast_to(t, s.shape)], axis=1)
                order = np.lexsort((all_t, -all_s), axis=1)[:, :k]
                best_s, best_t = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_t, order, 1)
            keep = np.isfinite(best_s)
            rows_q = np.repeat(ids, keep.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows_q), pa.array(best_t[keep]), pa.array(best_s[keep])], names=["query", "target", "similarity"])

        part = rows.select(F.col(key).cast("bigint"), F.col(vector)).mapInArrow(run, "query bigint, target bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query bigint, target bigint, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("target")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)
