"""Scores of predictions, rankings and audits; every rate has a guard for zero and a total order behind each rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions import stats as S
from brineflow.operators.joins import heavy_light_join
from brineflow.operators.ranks import global_rank, running_sums
from brineflow.runtime.session import bounded_rows

#: Labels of a prior that are sent to every query.
MAX_LABELS = 10_000


def set_scores(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1, f05) over rows of two label arrays."""
    t, p = F.coalesce(truth, F.array().cast("array<string>")), F.coalesce(predicted, F.array().cast("array<string>"))
    g = df.agg(F.sum(F.size(F.array_intersect(t, p))).alias("tp"), F.sum(F.size(F.array_except(p, t))).alias("fp"), F.sum(F.size(F.array_except(t, p))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("tp", "fp", "fn", S.precision(tp, fp).alias("precision"), S.recall(tp, fn).alias("recall"), S.f_score(tp, fp, fn).alias("f1"), S.f_score(tp, fp, fn, 0.5).alias("f05"))


def multiset_matches(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn) of two multisets: an item counts as often as both have it."""
    a, b = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    j = a.alias("a").join(b.alias("b"), same, "full_outer").select(F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_m", F.lit(0)).alias("m"))
    both = F.least("n", "m")
    return j.agg(F.sum(both).alias("tp"), F.sum(F.col("m") - both).alias("fp"), F.sum(F.col("n") - both).alias("fn"))


def frequency_prior(train: DataFrame, label: str) -> DataFrame:
    """(label, n, rank): labels by frequency, ties by label."""
    g = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return global_rank(g, [F.desc("n"), F.asc(label)], "rank").withColumn("rank", F.col("rank").cast("int"))


def votes(hits: DataFrame, labels: DataFrame, query: str, target: str, weight: str, label: str, most: int = 25) -> DataFrame:
    """(query, label, score, rank): weighted votes of the best hits of each query."""
    top = hits.where(F.col(query) != F.col(target)).withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(weight), F.asc(target)))).where(F.col("_r") <= most)
    g = top.join(labels, target).groupBy(query, label).agg(F.sum(weight).alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(label))))


def hybrid(ranked: DataFrame, queries: DataFrame, prior: DataFrame, query: str, label: str) -> DataFrame:
    """Votes first, then the prior's labels that have no vote; the prior is one row per label and becomes a literal, so it is read once."""
    first = ranked.select(query, label, F.lit(0).alias("_o"), F.col("rank").alias("_p"))
    listed = bounded_rows(prior.select(F.col("rank").alias("_p"), F.col(label).alias("l")), MAX_LABELS)
    if listed is None:
        raise ValueError(f"the prior has more than {MAX_LABELS} labels")
    literal = F.array(*[F.struct(F.lit(int(r["_p"])).alias("_p"), F.lit(r["l"]).alias("l")) for r in listed])
    rest = queries.select(query).distinct().select(query, F.explode(literal).alias("x")).select(query, F.col("x.l").alias(label), F.lit(1).alias("_o"), F.col("x._p").alias("_p"))
    once = first.unionByName(rest).groupBy(query, label).agg(F.min(F.struct("_o", "_p")).alias("m"))
    return once.select(query, label, F.row_number().over(Window.partitionBy(query).orderBy("m._o", "m._p", label)).alias("rank"))


def top_k(ranked: DataFrame, truth: DataFrame, query: str, label: str, ks: list[int], n_classes: int) -> DataFrame:
    """(k, accuracy, coverage, n): share of queries whose true label is among the first k; null where k is no restriction."""
    true = truth.select(query, F.col(label).alias("_t"))
    at = true.join(ranked.select(query, F.col(label).alias("_t"), "rank"), [query, "_t"], "left")
    answered = true.join(ranked.select(query).distinct().withColumn("_a", F.lit(True)), query, "left")
    share = answered.agg(F.avg(F.coalesce("_a", F.lit(False)).cast("double")).alias("coverage"))
    coverage = share.first()["coverage"]
    g = at.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") if k < n_classes else F.lit(None).cast("double")).alias("accuracy")) for k in ks])).alias("x")
    return g.select("n", rows).select("x.k", "x.accuracy", F.lit(coverage).cast("double").alias("coverage"), "n")


def weighted_accuracy(sample: DataFrame, population: DataFrame, stratum: str, correct: str) -> DataFrame:
    """(raw, reweighted, n, low, high): sample accuracy as it is and post-stratified to the population, with a score interval."""
    s = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("k"))
    p = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("pop"))
    g = s.join(p, stratum).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), (F.sum(F.col("k") / F.col("n") * F.col("pop")) / F.sum("pop")).alias("reweighted"))
    w = S.wilson(F.col("k"), F.col("n"))
    return g.select((F.col("k") / F.col("n")).alias("raw"), "reweighted", "n", w["low"].alias("low"), w["high"].alias("high"))


def auc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """(auc, average_precision, n_pos, n): by sums over distinct scores, so ties count half and no row ranks are needed."""
    g = df.groupBy(score.alias("s")).agg(F.sum(F.when(label, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("m", F.col("n") - F.col("p"))
    total = g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    r = running_sums(g, [F.asc("s")], ["m", "p", "n"]).join(F.broadcast(total))
    r = r.withColumnRenamed("m_before", "below").withColumn("tp", F.col("all_p") - F.col("p_before")).withColumn("seen", F.col("all_n") - F.col("n_before"))
    t = r.agg(F.sum(F.col("p") * (F.col("below") + F.col("m") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("ap"))
    return t.select(F.when((F.col("n_pos") > 0) & (F.col("n") > F.col("n_pos")), F.col("u") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("auc"), (F.col("ap") / F.col("n_pos")).alias("average_precision"), "n_pos", "n")


def lift(df: DataFrame, label: Column, score: Column, key: str, shares: list[float]) -> DataFrame:
    """(share, n_top, rate, base): rate of positives among the top shares by score, ties by key."""
    n, base = df.agg(F.count(F.lit(1)), F.avg(label.cast("double"))).first()
    ranked = global_rank(df.select(label.cast("double").alias("_y"), score.alias("_s"), F.col(key).alias("_k")), [F.desc("_s"), F.asc("_k")], "_r")
    tops = {s: max(1, int(n * s)) for s in shares}
    g = ranked.where(F.col("_r") <= max(tops.values())).agg(*[f for i, t in enumerate(tops.values()) for f in (F.avg(F.when(F.col("_r") <= t, F.col("_y"))).alias(f"rate{i}"), F.count_if(F.col("_r") <= t).alias(f"n{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"n{i}").alias("n_top"), F.col(f"rate{i}").alias("rate")) for i, s in enumerate(tops)])).alias("x")
    return g.select(each).select("x.share", "x.n_top", "x.rate", F.lit(base).cast("double").alias("base"))


def gates(df: DataFrame, successes: str, n: str, least: float) -> DataFrame:
    """Adds the interval and whether its lower bound passes."""
    w = S.wilson(F.col(successes), F.col(n))
    return df.withColumn("low", w["low"]).withColumn("high", w["high"]).withColumn("passes", F.coalesce(w["low"] >= least, F.lit(False)))


def margin(a: Column, b: Column, least: float) -> Column:
    """Whether a beats b by at least the margin below which a model is dropped."""
    return F.coalesce(a - b >= least, F.lit(False))


def label_sets(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, labels): the set of labels seen with each value, combined before the shuffle; labels are a closed vocabulary."""
    return rows.where(F.col(by).isNotNull() & F.col(label).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def multilabel_hits(records: DataFrame, key: str, label: str, clusters: list[str], ranked: DataFrame, ks: list[int], n_classes: int) -> DataFrame:
    """(mode, k, n, hit, coverage, mean_labels): whether a label that is true for a record is among its first k, for truth by record and by each cluster.

    `ranked` is (key, ranked array). Records without a true label do not count; hit is null where k is no restriction.
    """
    out = None
    base = records.join(ranked.select(key, "ranked"), key, "left")
    for mode in ["record", *clusters]:
        if mode == "record":
            true = base.withColumn("labels", F.array_compact(F.array(label)))
        else:
            true = heavy_light_join(base, label_sets(records, mode, label), mode)
        counted = true.where(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0).withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
        hits = [F.avg(F.arrays_overlap("labels", F.slice("ranked", 1, k)).cast("double")).alias(f"k{k}") for k in ks]
        g = counted.agg(F.count(F.lit(1)).alias("n"), F.avg((F.size("ranked") > 0).cast("double")).alias("coverage"), F.avg(F.size("labels")).alias("mean_labels"), *hits)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") if k < n_classes else F.lit(None).cast("double")).alias("hit")) for k in ks])).alias("x")
        part = g.select("n", "coverage", "mean_labels", each).select(F.lit(mode).alias("mode"), "x.k", "n", "x.hit", "coverage", "mean_labels")
        out = part if out is None else out.unionByName(part)
    return out


def gold_scores(gold: DataFrame, sources: dict[str, DataFrame], combined: dict[str, tuple[str, list[str]]], keys: list[str], name: str) -> DataFrame:
    """(source, tp, fp, fn, precision, recall, f1, f05): names of each source, and of unions and agreements, against gold (keys, name).

    `combined` names (union or agreement, sources). A record with a gold name of null is incomplete and judges nobody;
    a record that no source mentions counts as missed.
    """
    named = gold.groupBy(*keys).agg(F.collect_set(name).alias("_gold"), F.max(F.col(name).isNull()).alias("_incomplete")).where("NOT _incomplete").drop("_incomplete")
    for label, df in sources.items():
        found = df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.collect_set(name).alias(f"_{label}"))
        named = named.join(found, keys, "left")
    empty = F.array().cast("array<string>")
    sets = {label: F.coalesce(f"_{label}", empty) for label in sources}
    for label, (how, parts) in combined.items():
        one = sets[parts[0]]
        for p in parts[1:]:
            one = F.array_union(one, sets[p]) if how == "union" else F.array_intersect(one, sets[p])
        sets[label] = one
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("source"), s.alias("found")) for label, s in sets.items()])).alias("x")
    rows = named.select("_gold", each).select("x.source", "_gold", "x.found")
    g = rows.groupBy("source").agg(F.sum(F.size(F.array_intersect("_gold", "found"))).alias("tp"), F.sum(F.size(F.array_except("found", "_gold"))).alias("fp"), F.sum(F.size(F.array_except("_gold", "found"))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("source", "tp", "fp", "fn", S.precision(tp, fp).alias("precision"), S.recall(tp, fn).alias("recall"), S.f_score(tp, fp, fn).alias("f1"), S.f_score(tp, fp, fn, 0.5).alias("f05"))


def unresolved(gold: DataFrame, raw: str, name: str) -> DataFrame:
    """(raw, n): gold labels that resolve to nothing, the most frequent first."""
    return gold.where(F.col(name).isNull() & F.col(raw).isNotNull()).groupBy(raw).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), raw)


def audit_scores(sample: DataFrame, correct: str, by: list[str], tags: str | None = None) -> DataFrame:
    """(dimension, value, n, n_correct, accuracy, low, high): accuracy over all, by each dimension and, for wrong rows, by error tag (whose accuracy is null)."""
    dims = F.array(F.struct(F.lit("all").alias("d"), F.lit("all").alias("v")), *[F.struct(F.lit(c).alias("d"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("v")) for c in by])
    ok = F.coalesce(F.col(correct), F.lit(False))
    g = sample.select(F.explode(dims).alias("x"), ok.alias("ok")).groupBy(F.col("x.d").alias("dimension"), F.col("x.v").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"))
    w = S.wilson(F.col("n_correct"), F.col("n"))
    out = g.select("dimension", "value", "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"), w["low"].alias("low"), w["high"].alias("high"))
    if tags is None:
        return out
    none = F.lit(None).cast("double")
    wrong = sample.where(~ok).select(F.explode(tags).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(wrong.select(F.lit("error").alias("dimension"), "value", "n", F.lit(0).cast("bigint").alias("n_correct"), none.alias("accuracy"), none.alias("low"), none.alias("high")))
