"""Per-position sequence operators: spans, coverage, descriptors, filters, islands and segment proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.operators.ranks import global_rank

from brineflow.functions import stats as S


def spans(positions: DataFrame, keys: list[str], position: str, observed: Column | None = None) -> DataFrame:
    """(keys, start, end, n_positions, n_observed, is_contiguous, observed_fraction) of a set of positions; repeats count once."""
    seen = F.coalesce(observed, F.lit(True)) if observed is not None else F.lit(True)
    g = positions.groupBy(*keys).agg(
        F.min(position).alias("start"), F.max(position).alias("end"), F.countDistinct(position).alias("n_positions"), F.countDistinct(F.when(seen, F.col(position))).alias("n_observed")
    )
    width = F.col("end") - F.col("start") + 1
    return g.withColumn("span_length", width).withColumn("is_contiguous", F.col("n_positions") == width).withColumn("observed_fraction", F.col("n_observed") / F.col("n_positions"))


def coverage_steps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, depth): runs of equal coverage by ±1 events and a running sum, so long intervals are never expanded."""
    up = intervals.select(key, F.col(start).cast("bigint").alias("at"), F.lit(1).alias("d"))
    down = intervals.select(key, (F.col(end) + 1).cast("bigint").alias("at"), F.lit(-1).alias("d"))
    events = up.unionByName(down).groupBy(key, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("at")
    steps = events.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(order))
    return steps.where((F.col("depth") > 0) & F.col("next").isNotNull()).select(key, F.col("at").alias("start"), (F.col("next") - 1).alias("end"), "depth")


def inside_share(steps: DataFrame, key: str, totals: DataFrame, at: float = 0.5) -> DataFrame:
    """(key, start, end, inside_length): the consensus region, where at least a share `at` of the key's intervals agree; totals is (key, n)."""
    j = steps.join(totals, key).where(F.col("depth") >= at * F.col("n"))
    return j.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start") + 1).alias("inside_length"))


def descriptors(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Composition and physico-chemical measures of sequences; null for sequences without standard residues."""
    rows = df.select(key, F.upper(sequence).alias("_s")).withColumn("_c", S.residue_counts(F.col("_s")))  # counted once
    counts, at = F.col("_c"), {c: F.col("_c")[i] for i, c in enumerate(S.RESIDUES)}
    n = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    of = lambda letters: sum((at[c] for c in letters[1:]), at[letters[0]])
    groups = {"aromatic": "FWY", "charged": "DEKR", "small": "AGSTC", "proline": "P"}
    return rows.select(
        key, F.length("_s").alias("length"), n.alias("n_standard"), S.entropy_of(counts).alias("entropy"), S.hydropathy_mean_of(counts).alias("gravy"), S.hydropathy_deviation_of(counts).alias("gravy_sd"),
        (of("KR") - of("DE")).alias("net_charge"), S.longest_run(F.col("_s")).alias("longest_run"), *[F.when(n > 0, of(g) / n).alias(f"fraction_{name}") for name, g in groups.items()],
    )


def median_filter(df: DataFrame, key: str, position: str, value: str, window: int = 15, out: str = "smooth") -> DataFrame:
    """Adds the running median of odd width with repeated ends; sequences shorter than the window stay unchanged."""
    half = window // 2
    order = Window.partitionBy(key).orderBy(position)
    whole = Window.partitionBy(key)
    values = F.collect_list(value).over(order.rowsBetween(-half, half))
    first, last = F.first(value).over(order), F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.greatest(F.lit(half + 1) - F.row_number().over(order), F.lit(0))
    after = F.greatest(F.lit(half) - (F.count(F.lit(1)).over(whole) - F.row_number().over(order)).cast("int"), F.lit(0))
    padded = F.array_sort(F.concat(values, F.array_repeat(first, before), F.array_repeat(last, after)))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(whole) < window, F.col(value)).otherwise(F.element_at(padded, half + 1)))


def islands(df: DataFrame, key: str, position: str, inside: Column, merge_gap: int = 0) -> DataFrame:
    """(key, start, end, length): runs of positions inside; runs with at most `merge_gap` positions between them are one."""
    rows = df.where(inside)
    order = Window.partitionBy(key).orderBy(position)
    new = F.coalesce(F.col(position) - F.lag(position).over(order) > merge_gap + 1, F.lit(True))
    numbered = rows.withColumn("_island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(position).alias("start"), F.max(position).alias("end")).withColumn("length", F.col("end") - F.col("start") + 1).drop("_island")


def propose(df: DataFrame, key: str, position: str, value: str, threshold: float = 0.5, merge_gap: int = 12, least: int = 50, window: int = 15, confident: float = 0.85) -> DataFrame:
    """(key, start, end, length, mean, confident): the longest merged region above the threshold after the median filter, refused below `least`; ties to the first."""
    smooth = median_filter(df, key, position, value, window)
    longest = islands(smooth, key, position, F.col("smooth") >= threshold, merge_gap).groupBy(key).agg(F.min(F.struct((-F.col("length")).alias("l"), "start", "end")).alias("m"))
    kept = longest.where(-F.col("m.l") >= least).select(key, F.col("m.start").alias("start"), F.col("m.end").alias("end"), (-F.col("m.l")).alias("length"))
    inside = smooth.join(kept, key).where(F.col(position).between(F.col("start"), F.col("end")))
    return inside.groupBy(key, "start", "end", "length").agg(F.avg(value).alias("mean")).withColumn("confident", F.col("mean") >= confident)


def status_eligibility(df: DataFrame, statuses: str, eligible: list[str], positive: list[str]) -> DataFrame:
    """Adds whether a status set makes a target eligible, and positive."""
    has = lambda names: F.coalesce(F.arrays_overlap(F.col(statuses), F.array(*map(F.lit, names))), F.lit(False))
    return df.withColumn("eligible", has(eligible)).withColumn("positive", has(positive))


def length_batches(df: DataFrame, key: str, length: str, budget: int) -> DataFrame:
    """(key, width, batch): batches of equal padded width with at most `budget` padded positions."""
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(length), F.lit(16))))).cast("int")
    per = F.greatest(F.floor(F.lit(budget) / F.col("width")), F.lit(1))
    sized = df.select(key, width.alias("width"))
    ranked = global_rank(sized, [F.asc("width"), F.asc(key)], "_r")
    before = Window.orderBy("width").rowsBetween(Window.unboundedPreceding, -1)  # widths are powers of two, so some thirty
    offsets = sized.groupBy("width").agg(F.count(F.lit(1)).alias("_n")).select("width", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranked.join(F.broadcast(offsets), "width")
    return placed.select(key, "width", F.floor((F.col("_r") - 1 - F.col("_before")) / per).cast("bigint").alias("batch"))


def mean_vector(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, mean): element-wise mean of vectors, by position, combined before the shuffle."""
    parts = df.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("mean"))


def ranked_labels(scores: Column, labels: list[str], k: int) -> Column:
    """The k labels with the highest scores, ties to the earlier label."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.element_at(F.array(*map(F.lit, labels)), p["i"].cast("int") + 1))


def boosted_trees(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7):
    """A fitted pipeline of gradient-boosted trees; a null feature takes its median, so every row is used and scored. Its impurity importances are in the last stage."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    whole = [f"_{f}" for f in features]
    stages = [Imputer(inputCols=features, outputCols=whole, strategy="median"), VectorAssembler(inputCols=whole, outputCol="features"), GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(train)


def permutation_importance(model, rows: DataFrame, features: list[str], label: str, seed: str = "s") -> DataFrame:
    """(feature, accuracy, drop): the accuracy with one feature dealt anew among the rows, and how much it is below the accuracy as it is.

    Values are dealt by two hash orders: the row of one rank gets the value of the other's, so the draw is repeatable.
    """
    right = lambda df: df.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    base, out = right(model.transform(rows)), []
    keyed = rows.withColumn("_k", F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("map", "struct"))]))
    for f in features:
        order = lambda s: [F.sha2(F.concat(F.lit(seed + s + f), F.col("_k").cast("string")), 256), F.col("_k")]
        values = global_rank(keyed.select(F.col(f).alias("_v"), "_k"), order("v"), "_r").select("_r", "_v")
        dealt = global_rank(keyed, order("r"), "_r").join(values, "_r").withColumn(f, F.col("_v"))
        accuracy = right(model.transform(dealt))
        out.append((f, accuracy, base - accuracy))
    return rows.sparkSession.createDataFrame(out, "feature string, accuracy double, drop double")
