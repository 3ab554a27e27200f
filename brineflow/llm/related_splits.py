"""Splits that keep related records together, by random-mate contraction.

Records tie the values they hold: two clusters seen with one entry are an edge. Each round every vertex tosses a
coin (a hash of the vertex and the round); a tail joins its smallest head neighbour, edges are relabelled by SQL
joins, loops and repeated edges vanish; a constant share of the vertices is contracted each round. Hubs are split
off in these joins. Once at most SMALL_GRAPH edges are left, one task runs the remaining rounds on arrays. When no edge
is left the maps of the rounds are unwound from the last to the first, each level written before the next. Graph, maps
and labels stay distributed and are cut through the shared checkpoint folder; the driver sees counts only. Groups are
then split by cumulative weight.

Defined results: null and blank values tie nothing; a record without either value is a group of its own with a null
key and is left out of `related_groups`; ties in choosing are broken by value; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.operators.joins import heavy_keys, heavy_light_join
from brineflow.runtime.session import discard, ship_code, written

MAX_ROUNDS = 400
#: Edges, in both directions, that one task contracts by itself.
SMALL_GRAPH = 500_000
#: A group above this share of all rows is placed by itself; there are at most 1 / LARGE_SHARE such groups.
LARGE_SHARE = 0.001


def _filled(column: Column) -> Column:
    """The value as stored, null if blank."""
    return F.when(column.rlike(r"(?U)[^\s]"), column)


def entry_key(column: Column) -> Column:
    """Upper case without outer blanks."""
    return F.upper(F.regexp_replace(_filled(column), r"(?U)^\s+|\s+$", ""))


def _coins(n: int, turn: int) -> np.ndarray:
    """A coin for each of n vertices, another one each round."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn * 0xD1B54A32D192ED03 % 2**64)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(1) == 1


def contract_arrays(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The label of each of n vertices under edges given in both directions; the rounds of `contract` on arrays."""
    into = np.arange(n)
    for turn in range(MAX_ROUNDS):
        if not len(a):
            break
        head = _coins(n, turn)
        chosen = np.full(n, n)
        joins = ~head[a] & head[b]
        np.minimum.at(chosen, a[joins], b[joins])
        step = np.where(chosen < n, chosen, np.arange(n))
        into = step[into]
        a, b = step[a], step[b]
        edges = np.unique(a[a != b] * n + b[a != b])
        a, b = edges // n, edges % n
    else:
        raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
    return into


def _contract_small(edges: DataFrame) -> DataFrame:
    """(a, into) of every vertex of at most SMALL_GRAPH edges, in one task."""
    ship_code(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            names = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
            codes = names.indices.to_numpy().astype(np.int64)
            label = contract_arrays(codes[: table.num_rows], codes[table.num_rows :], len(names.dictionary))
            yield pa.RecordBatch.from_arrays([names.dictionary, names.dictionary.take(pa.array(label))], names=["a", "into"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "a string, into string")


def contract(edges: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex of the undirected edges (a, b); the label is a vertex of its component."""
    both = edges.where("a <> b")
    current = written(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        left = current.count()
        if left <= SMALL_GRAPH:
            if left or not maps:
                maps.append(written(_contract_small(current), "map"))
            break
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 1
        chosen = written(current.where(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("into")), f"map{turn}")
        # edges are kept in both directions, so hubs and the map are the same for either end
        hubs = heavy_keys(current, "a")
        renamed = heavy_light_join(current, chosen, "a", heavy=hubs).select(F.coalesce("into", "a").alias("a"), "b")
        renamed = heavy_light_join(renamed, chosen.withColumnRenamed("a", "b"), "b", heavy=hubs).select("a", F.coalesce("into", "b").alias("b"))
        following = written(renamed.where("a <> b").distinct(), f"edges{turn}")
        discard(current)
        current = following
        maps.append(chosen)
    else:
        raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
    discard(current)
    labels = maps.pop().select(F.col("a").alias("vertex"), F.col("into").alias("label"))
    unwound = bool(maps)
    for chosen in reversed(maps):
        up = labels.select(F.col("vertex").alias("into"), F.col("label").alias("up"))
        level = chosen.join(up, "into", "left").select(F.col("a").alias("vertex"), F.coalesce("up", "into").alias("label"))
        following = written(labels.unionByName(level), "labels")
        discard(labels)
        labels = following
    if not unwound:
        return labels
    # a vertex that was joined by others only, and by none of the last rounds, is its own label
    roots = labels.select(F.col("label").alias("vertex")).distinct().join(labels.select("vertex"), "vertex", "left_anti")
    return written(labels.unionByName(roots.select("vertex", F.col("vertex").alias("label"))), "labels")


def keyed_groups(df: DataFrame, record: str, cluster: str, entry: str) -> tuple[DataFrame, DataFrame]:
    """(records with the key of each, groups by key): records (record_id, key), groups (key, label, group_key, n_group)."""
    rows = df.select(F.col(record).alias("record_id"), _filled(F.col(cluster)).alias("c"), entry_key(F.col(entry)).alias("p"))
    pairs = written(rows.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n")), "pairs")  # pre-aggregated
    both = pairs.where("c IS NOT NULL AND p IS NOT NULL")
    of_entry = both.groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    # an entry ties its clusters to its smallest one; entries of one cluster need no edge
    linking = of_entry.where("low <> high").select("p", "low")
    edges = heavy_light_join(both, linking, "p", "inner").where("c <> low").select(F.concat(F.lit("c"), "low").alias("a"), F.concat(F.lit("c"), "c").alias("b")).distinct()
    labels = contract(edges)

    clusterless = pairs.where("c IS NULL AND p IS NOT NULL").join(of_entry.select("p", "low"), "p", "left")
    keys = both_keys(pairs, clusterless)
    named = keys.join(labels.withColumnRenamed("vertex", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = written(named, "keys")
    discard(labels)
    stats = named.groupBy("label").agg(F.sum("n").alias("n_group"), F.min("c").alias("c"), F.min("p").alias("p"))
    stats = stats.select("label", "n_group", F.coalesce("c", "p").alias("group_key"))
    groups = heavy_light_join(named.select("key", "label"), stats, "label")
    entry_to_key = clusterless.select("p", F.coalesce(F.concat(F.lit("c"), "low"), F.concat(F.lit("p"), "p")).alias("via"))
    direct = rows.where("c IS NOT NULL").select("record_id", F.concat(F.lit("c"), "c").alias("key"))
    indirect = heavy_light_join(rows.where("c IS NULL AND p IS NOT NULL").select("record_id", "p"), entry_to_key, "p").select("record_id", F.col("via").alias("key"))
    free = rows.where("c IS NULL AND p IS NULL").select("record_id", F.lit(None).cast("string").alias("key"))
    groups = written(groups, "groups")
    discard(named)
    return direct.unionByName(indirect).unionByName(free), groups


def both_keys(pairs: DataFrame, clusterless: DataFrame) -> DataFrame:
    """(key, n, c, p): weight and smallest values of every key; keys of clusters and of entries do not clash."""
    first = pairs.where("c IS NOT NULL").select(F.concat(F.lit("c"), "c").alias("key"), "n", "c", "p")
    second = clusterless.select(F.coalesce(F.concat(F.lit("c"), "low"), F.concat(F.lit("p"), "p")).alias("key"), "n", F.lit(None).cast("string").alias("c"), "p")
    return first.unionByName(second).groupBy("key").agg(F.sum("n").alias("n"), F.min("c").alias("c"), F.min("p").alias("p"))


def related_groups(df: DataFrame, record: str, cluster: str, entry: str) -> DataFrame:
    """(record_id, group_key) of every record that shares its group with another record."""
    records, groups = keyed_groups(df, record, cluster, entry)
    shared = groups.where("n_group > 1").select("key", "group_key")
    return heavy_light_join(records.where("key IS NOT NULL"), shared, "key", "inner").select("record_id", "group_key")


def split_records(df: DataFrame, record: str, cluster: str, entry: str, shares: dict[str, float]) -> DataFrame:
    """(record_id, group_key, split): groups fill the splits by cumulative weight in hash order; the few large groups go first, to the split that lacks most."""
    records, groups = keyed_groups(df, record, cluster, entry)
    free = records.where("key IS NULL").select("record_id", F.lit(None).cast("string").alias("group_key"), F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("label"))
    free_weights = free.select("label", F.lit(1).cast("bigint").alias("n_group"))
    weights = written(groups.groupBy("label").agg(F.max("n_group").alias("n_group")).unionByName(free_weights), "weights")
    total = weights.agg(F.sum("n_group")).first()[0] or 0
    lacking = {name: share * total for name, share in shares.items()}
    large = weights.where(F.col("n_group") > LARGE_SHARE * total).orderBy(F.desc("n_group"), "label").collect()  # at most 1 / LARGE_SHARE rows
    placed = []
    for row in large:
        name = max(lacking, key=lacking.get)
        lacking[name] -= row["n_group"]
        placed.append((row["label"], name))
    small = weights.where(F.col("n_group") <= LARGE_SHARE * total).withColumn("h", F.xxhash64("label")).withColumn("bucket", F.pmod("h", F.lit(1024)))
    sums = small.groupBy("bucket").agg(F.sum("n_group").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows
    offsets = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("h", "label").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("offset") + F.sum("n_group").over(inside) - F.col("n_group") / 2
    placed_small = small.join(F.broadcast(offsets), "bucket").withColumn("middle", middle)
    room = {name: max(0.0, x) for name, x in lacking.items()}
    left = sum(room.values()) or 1.0
    n_small = total - sum(r["n_group"] for r in large)
    chosen, upto = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        upto -= room[list(shares)[list(shares).index(name) + 1]] / left
        chosen = F.when(F.col("middle") <= upto * n_small, name).otherwise(chosen)
    labels = placed_small.select("label", chosen.alias("split"))
    if placed:
        labels = labels.unionByName(df.sparkSession.createDataFrame(placed, "label string, split string"))
    by_key = heavy_light_join(groups.select("key", "label", "group_key"), labels, "label", "inner").select("key", "group_key", "split")
    tied = heavy_light_join(records.where("key IS NOT NULL"), by_key, "key", "inner").select("record_id", "group_key", "split")
    return tied.unionByName(free.join(labels, "label").select("record_id", "group_key", "split"))
