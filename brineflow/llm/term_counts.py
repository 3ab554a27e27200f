"""Frequency of every distinct term, by heavy-light aggregation.

A frequent-items sketch over all rows detects heavy terms (at most HEAVY_TERMS a field, so what is broadcast is
bounded). Heavy terms are counted exactly in local counter arrays in each Arrow task, which emits its counters and,
for distinct records, Roaring-like chunks of record ids (a bitmap or a sorted array per 65,536 ids, whichever is
smaller); chunks of one term are united in a tree of groups of at most FAN_IN tasks. Only the remaining light terms are
shuffled as rows, and no light term is hot; most of their rows are the only one of their term and record, so counting
them before the shuffle would not make them fewer. Both tables are united.
The sketch decides the route of a term only; counts on either route are exact.

Defined results: null and blank are no terms; a null record id counts as a row and not as a record; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brineflow.runtime.session import ship_code, spread

HEAVY_TERMS = 512
#: A term is heavy if it holds at least this share of the rows of its field.
HEAVY_SHARE = 0.001
_CHUNK = 1 << 16
#: Chunks of one term and range of ids that are united in one call.
FAN_IN = 64
_BLANKS = "[\\s\\u001c-\\u001f]+"


def normal_term(column: Column) -> Column:
    """Lower case, trimmed, runs of any white space as one blank; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(column), f"(?U){_BLANKS}", " ")), F.lit(""))


def heavy_terms(terms: DataFrame) -> dict[tuple[str, str], int]:
    """Index of each heavy (field, term); found by one aggregation with a bounded sketch per task."""
    sketch = terms.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(term, {HEAVY_TERMS}, {HEAVY_TERMS * 16})").alias("top")
    )
    found = [(r["field"], t["item"]) for r in sketch.collect() for t in r["top"] if t["count"] >= max(2, HEAVY_SHARE * r["n"])]
    return {k: i for i, k in enumerate(sorted(found))}


def _chunk_bytes(low: np.ndarray) -> bytes:
    """Ids of one chunk, by their low 16 bits, as a bitmap of 8 KiB or as a sorted array."""
    if len(low) >= _CHUNK // 16:
        bits = np.zeros(_CHUNK, dtype=bool)
        bits[low] = True
        return b"b" + np.packbits(bits).tobytes()
    return b"a" + low.astype("<u2").tobytes()


def _chunk_bits(data: bytes) -> np.ndarray:
    bits = np.zeros(_CHUNK, dtype=bool)
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1)).astype(bool)
    bits[np.frombuffer(data, dtype="<u2", offset=1)] = True
    return bits


def count_terms(df: DataFrame, fields: list[str], record: str) -> DataFrame:
    """(field, term, n_rows, n_records) over all rows of `df`."""
    ship_code(df.sparkSession)
    narrow = spread(df.select(record, *fields)).select(F.col(record).cast("bigint").alias("record"), *[normal_term(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t{i}").alias("term")) for i, f in enumerate(fields)])).alias("p")
    terms = narrow.select("record", pairs).select("record", "p.field", "p.term").where(F.col("term").isNotNull())
    heavy = heavy_terms(terms.select("field", "term"))
    keys = sorted(heavy, key=heavy.get)
    by_field = {f: [t for g, t in keys if g == f] for f in fields}
    is_heavy = F.lit(False)
    for f in fields:
        if by_field[f]:
            is_heavy = is_heavy | ((F.col("field") == f) & F.col("term").isin(by_field[f]))

    light = (
        terms.where(~is_heavy)
        .repartition("field", "term")  # the one shuffle of rows; the distinct count below needs no other
        .groupBy("field", "term")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record").alias("n_records"))
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(len(keys), dtype=np.int64)
        task = TaskContext.get().partitionId()
        seen: dict[int, list[np.ndarray]] = {}
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            index = np.fromiter((heavy[p] for p in pairs), dtype=np.int64, count=b.num_rows)
            counters += np.bincount(index, minlength=len(keys))
            present = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            record = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            order = np.argsort(index[present], kind="stable")
            index, record = index[present][order], record[present][order]
            places = np.flatnonzero(np.diff(index, prepend=-1)) if len(index) else []
            for a, z in zip(places, [*places[1:], len(index)]):
                seen.setdefault(int(index[a]), []).append(np.unique(record[a:z]))
        out: list[tuple[int, int | None, int, bytes | None]] = [(k, None, int(counters[k]), None) for k in np.flatnonzero(counters)]
        for k, parts in seen.items():
            ids = np.unique(np.concatenate(parts))
            high = ids >> 16
            places = np.flatnonzero(np.diff(high, prepend=high[0] - 1))
            out += [(k, int(high[a]), 0, _chunk_bytes(ids[a:z] & 0xFFFF)) for a, z in zip(places, [*places[1:], len(ids)])]
            if len(out) > 4096:
                yield _batch(out, task)
                out = []
        yield _batch(out, task)

    def both(chunks: pd.Series) -> bytes:
        bits = np.zeros(_CHUNK, dtype=bool)
        for c in chunks:
            bits |= _chunk_bits(c)
        return _chunk_bytes(np.flatnonzero(bits))

    def ones(chunks: pd.Series) -> int:
        return int(_chunk_bits(both(chunks)).sum())

    hot = terms.where(is_heavy)
    parts = hot.mapInArrow(local, "task bigint, k bigint, chunk bigint, n_rows bigint, ids binary")
    n_rows = parts.where(F.col("ids").isNull()).groupBy("k").agg(F.sum("n_rows").alias("n_rows"))
    # a group of either step holds at most FAN_IN chunks of 8 KiB
    chunks, tasks = parts.where(F.col("ids").isNotNull()), hot.rdd.getNumPartitions()
    while tasks > FAN_IN:
        chunks = chunks.groupBy("k", "chunk", F.floor(F.col("task") / FAN_IN).alias("task")).agg(F.pandas_udf(both, "binary")(F.col("ids")).alias("ids"))
        tasks = -(-tasks // FAN_IN)
    per_chunk = chunks.groupBy("k", "chunk").agg(F.pandas_udf(ones, "bigint")(F.col("ids")).alias("n"))
    n_records = per_chunk.groupBy("k").agg(F.sum("n").alias("n_records"))
    names = df.sparkSession.createDataFrame([(i, f, t) for i, (f, t) in enumerate(keys)], "k bigint, field string, term string")
    heavy_counts = n_rows.join(n_records, "k", "left").join(F.broadcast(names), "k").select("field", "term", "n_rows", F.coalesce("n_records", F.lit(0)).alias("n_records"))
    return heavy_counts.unionByName(light)


def _batch(rows: list[tuple], task: int) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array([task] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]]
    return pa.RecordBatch.from_arrays(columns, names=["task", "k", "chunk", "n_rows", "ids"])


def marked_terms(df: DataFrame, fields: list[str], record: str, rare: int = 2, common: float = 0.05) -> DataFrame:
    """count_terms with a mark: rare (at most `rare` records), common (more than the share `common` of all records) or useful."""
    n_all = df.agg(F.countDistinct(record)).first()[0]
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * F.lit(n_all), "common").otherwise("useful")
    return count_terms(df, fields, record).withColumn("mark", mark)
