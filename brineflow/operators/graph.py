"""Connected components by minimum-label propagation with shortcuts; the label of a component is its smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.operators.joins import heavy_keys, heavy_light_join
from brineflow.runtime.session import discard, ship_code, written

MAX_ROUNDS = 100
#: Edges that one task joins by itself.
SMALL_GRAPH = 500_000


def _component_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        following = label.copy()
        np.minimum.at(following, label[u], low)
        np.minimum.at(following, label[v], low)
        while not np.array_equal(hop := following[following], following):
            following = hop
        if np.array_equal(following, label):
            return label
        label = following


def _small_components(edges: DataFrame) -> DataFrame:
    """(node, component) of at most SMALL_GRAPH edges (u, v), in one task; nodes keep their type and order."""
    ship_code(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            names = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
            order = pa.compute.sort_indices(names.dictionary).to_numpy()
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            codes = place[names.indices.to_numpy()]
            nodes = names.dictionary.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(_component_labels(codes[: table.num_rows], codes[table.num_rows :], len(nodes))))], names=["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one, then every
    node links its smaller neighbours to the smallest. Rounds grow with the logarithm of the nodes; each is cut through
    the shared folder, and the driver sees only checksums. Hubs are split off in the joins. A graph of at most
    SMALL_GRAPH edges is finished in one task.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    alone = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    if e.count() <= SMALL_GRAPH:
        return alone.join(written(_small_components(e), "components"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    last = None
    for turn in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = heavy_light_join(both, low, "u", "inner", heavy=heavy_keys(both, "u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = heavy_light_join(large, low2, "u", "inner", heavy=heavy_keys(large, "u")).select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        following = written(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), f"edges{turn}")
        discard(e)
        e = following
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == mark:
            break
        last = mark
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return alone.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
