"""Filling fixed-capacity containers with items, by Martello-Toth dominance reduction and best fit.

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most `capacity` numbers, however
many items there are. The driver solves that. For the largest open item it looks for a set of companions that
dominates every other set that fits beside it: each of those could be swapped against the chosen one without needing
a container more, so the choice is fixed, with its whole multiplicity, and the instance shrinks. What no set dominates
is filled by best fit in descending order, a run of equal items at a time. The result is a list of patterns (which
sizes, how often). Each item then looks up its container by its rank among the items of its size; ranks come from
counts per (size, salt), so a size that holds a third of all items is ranked in many tasks.

Defined results: an item above the capacity is cut into full containers and one rest, and no other item is divided;
items of size zero or null size get no container; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brineflow.runtime.session import parallelism, ship_code, written

Pattern = tuple[dict[int, int], int]
ROWS_PER_SALT = 100_000


def _beyond(sizes: list[int], rest: dict[int, int], low: int, room: int) -> bool:
    """Whether some items together take more than `low` and at most `room`; sums are the bits of one number."""
    sums, limit = 1, (1 << room + 1) - 1
    for s in sizes:
        n, step = min(rest[s], room // s), 1
        while n > 0:  # counts in powers of two, so that every number of items up to n is reached
            take = min(step, n)
            sums |= (sums << s * take) & limit
            n, step = n - take, step * 2
        if sums >> low + 1:
            return True
    return False


def dominating(j: int, counts: dict[int, int], capacity: int) -> list[int] | None:
    """The companions of an item of size j that dominate every other set that fits beside it, None if there are none of up to two.

    A set dominates another if the other can be cut into parts, each no larger than an item of its own of the first.
    """
    room = capacity - j
    rest = {s: n - (s == j) for s, n in counts.items() if s <= room and n - (s == j) > 0}
    if not rest:
        return []
    sizes = sorted(rest)
    largest = sizes[-1]
    # one item: no set of any number of items takes more than it
    if largest == room or not _beyond(sizes, rest, largest, room):
        return [largest]
    # two items: three never fit, so only pairs are left to compare, x >= y
    three = [s for s in sizes[:3] for _ in range(min(3, rest[s]))][:3]
    if len(three) == 3 and sum(three) <= room:
        return None
    fits = lambda x, y: rest.get(y, 0) > (x == y)
    second = next((y for y in reversed(sizes) if y <= room - largest and fits(largest, y)), None)
    if second is None:
        return None
    for y in sizes[bisect_left(sizes, second + 1) :]:
        at = bisect_left(sizes, room - y + 1) - 1
        if at >= 0 and sizes[at] == y and rest[y] < 2:
            at = -1  # the pair would need a second item of this size
        if at >= 0 and sizes[at] >= y and sizes[at] + y > largest:
            return None  # both are too large for `second`, and together for `largest`
    return [largest, second]


def _reduce(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Takes all items out of `counts` whose container a dominating set fixes. A set that dominates goes on doing so while items vanish, as fewer others are left to beat."""
    patterns: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while j in counts and (beside := dominating(j, counts, capacity)) is not None:
                pattern: dict[int, int] = {}
                for s in (j, *beside):
                    pattern[s] = pattern.get(s, 0) + 1
                n = min(counts[s] // k for s, k in pattern.items())
                for s, k in pattern.items():
                    counts[s] -= k * n
                    if not counts[s]:
                        del counts[s]
                patterns.append((pattern, n))
                again = True
    return patterns


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Items in descending order, each into the fullest container that has room; containers filled alike are one entry.

    An item put into a container leaves less room there than in any other that could take one more of its size, so the
    next item of the size goes there too: each container takes as many as it has room for before another is used.
    """
    rooms: list[tuple[int, int]] = []  # (room, number of the entry), ascending
    filled: list[list] = []  # pattern, multiplicity

    def add(pattern: dict[int, int], n: int, room: int) -> None:
        if n:
            insort(rooms, (room, len(filled)))
            filled.append([pattern, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, (s, -1))
            if at < len(rooms):
                room, entry = rooms.pop(at)
                pattern, n = filled[entry]
                filled[entry][1] = 0
            else:
                most = capacity // s
                room, pattern, n = capacity, {}, -(-left // most)
            most = room // s
            whole = min(n, left // most)
            add({**pattern, s: most}, whole, room - most * s)
            left -= whole * most
            if whole < n and left:  # fewer than `most` are left: one container takes them
                add({**pattern, s: left}, 1, room - left * s)
                whole, left = whole + 1, 0
            add(pattern, n - whole, room)
    return [(p, n) for p, n in filled if n]


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """Patterns with multiplicities that use every item once, and how many containers the reduction fixed."""
    counts = {int(s): int(n) for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    fixed = _reduce(counts, capacity)
    return fixed + _best_fit(counts, capacity), sum(n for _, n in fixed)


def _slots(patterns: list[Pattern], first: int) -> dict[int, np.ndarray]:
    """By size the columns low rank, first container, uses per container, start in the container; sorted by low rank."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for pattern, n in patterns:
        start = 0
        for s, k in sorted(pattern.items(), reverse=True):
            slots.setdefault(s, []).append((used.get(s, 0), first, k, start))
            used[s] = used.get(s, 0) + k * n
            start += s * k
        first += n
    return {s: np.array(x, dtype=np.int64).T for s, x in slots.items()}


def fill_containers(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, n_tokens, container_id, start): the place of every piece of every item."""
    spark = df.sparkSession
    ship_code(spark)
    sizes = df.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_n")).where(F.col("_n") > 0)
    cuts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1)).alias("part")
    pieces = written(sizes.select("_key", "_n", cuts).select("_key", "part", F.least(F.lit(capacity), F.col("_n") - F.col("part").cast("bigint") * capacity).alias("size")), "pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    patterns, _ = plan_containers(histogram, capacity)
    slots = spark.sparkContext.broadcast(_slots(patterns, 0))
    salts = max(1, -(-sum(histogram.values()) // ROWS_PER_SALT), parallelism(spark))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("_key", "part"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "salt").orderBy("_key", "part")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["size", "salt"]).select("_key", "part", "size", (F.col("inside") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            container, start = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                low, first, uses, begin = table[int(s)]
                k = np.searchsorted(low, rank[at], side="right") - 1
                turn = rank[at] - low[k]
                container[at] = first[k] + turn // uses[k]
                start[at] = begin[k] + (turn % uses[k]) * s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container), pa.array(start.astype(np.int32))], names=[key, "part", "n_tokens", "container_id", "start"])

    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, part int, n_tokens bigint, container_id bigint, start int")
