"""Queries of splits, samples, scores and rankings, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.functions import stats as S
from brineflow.operators import evaluation, sampling
from brineflow.plans.registry import Registry, Tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

_EDGES = """
    WITH RECURSIVE rows AS (SELECT record_id, CASE WHEN trim(cluster_30) <> '' THEN cluster_30 END AS c, CASE WHEN trim(pdb_id) <> '' THEN upper(trim(pdb_id)) END AS p FROM conditions),
    e AS (SELECT DISTINCT 'c:' || c AS a, 'p:' || p AS b FROM rows WHERE c IS NOT NULL AND p IS NOT NULL), ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT 'p:' || p, 'p:' || p FROM rows WHERE p IS NOT NULL UNION SELECT 'c:' || c, 'c:' || c FROM rows WHERE c IS NOT NULL),
    reach AS (SELECT a AS node, b AS other FROM ee UNION SELECT r.node, t.b FROM reach r JOIN ee t ON r.other = t.a),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def _relations(t: Tables) -> DataFrame:
    return t.conditions.select("record_id", F.when(F.trim("cluster_30") != "", F.col("cluster_30")).alias("c"), F.when(F.trim("pdb_id") != "", F.upper(F.trim("pdb_id"))).alias("p"), "split")


@registry.add(_EDGES + """
    SELECT record_id, component, CASE WHEN substr(sha256(component), 1, 16) < '2666666666666666' THEN 'test' WHEN substr(sha256(component), 1, 16) < '4ccccccccccccccc' THEN 'val' ELSE 'train' END AS fold
    FROM rows JOIN comp ON node = coalesce('c:' || c, 'p:' || p)""")
def q_component_folds(t: Tables) -> DataFrame:
    return sampling.component_folds(_relations(t), "record_id", ["c", "p"])


@registry.add("""
    WITH r AS (SELECT split, CASE WHEN trim(cluster_30) <> '' THEN cluster_30 END AS c, CASE WHEN trim(pdb_id) <> '' THEN upper(trim(pdb_id)) END AS p FROM conditions WHERE split IS NOT NULL)
    SELECT 'c' AS level, count(*) AS n_clusters, count(*) FILTER (n > 1) AS n_leaking FROM (SELECT c, count(DISTINCT split) AS n FROM r WHERE c IS NOT NULL GROUP BY c)
    UNION ALL SELECT 'p', count(*), count(*) FILTER (n > 1) FROM (SELECT p, count(DISTINCT split) AS n FROM r WHERE p IS NOT NULL GROUP BY p)""")
def q_leak_audit(t: Tables) -> DataFrame:
    return sampling.leaks(_relations(t), "split", ["c", "p"])


_ALLOCATION = """
    g AS (SELECT source, method, count(*) AS n FROM conditions GROUP BY ALL),
    a AS (SELECT *, least(n, 3 + CAST(floor(greatest(200 - 3 * count(*) OVER (), 0) * n / sum(n) OVER ()) AS BIGINT)) AS take FROM g)"""


@registry.add(f"WITH {_ALLOCATION} SELECT source, method, n, take FROM a")
def q_stratified_allocation(t: Tables) -> DataFrame:
    return sampling.allocation(t.conditions, ["source", "method"], 200)


@registry.add(f"""
    WITH {_ALLOCATION}, r AS (SELECT record_id, source, method, row_number() OVER (PARTITION BY source, method ORDER BY sha256('s' || record_id), record_id) AS rk FROM conditions)
    SELECT r.record_id, r.source, r.method FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source AND r.method IS NOT DISTINCT FROM a.method WHERE rk <= take""")
def q_stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified(t.conditions.select("record_id", "source", "method"), "record_id", ["source", "method"], 200)


@registry.add("""
    WITH b AS (SELECT doc_id, n_chars, CAST(ntile(3) OVER (ORDER BY n_chars, doc_id) AS INTEGER) AS band FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id, n_chars, band FROM b QUALIFY row_number() OVER (PARTITION BY band ORDER BY sha256('s' || doc_id), doc_id) <= 15""")
def q_banded_sample(t: Tables) -> DataFrame:
    return sampling.banded_sample(t.documents.where("n_chars IS NOT NULL").select("doc_id", "n_chars"), "doc_id", "n_chars", 3, 15)


@registry.add("""
    WITH r AS (SELECT record_id, crystal_id = '2' AS is2, row_number() OVER (PARTITION BY coalesce(crystal_id = '2', false) ORDER BY sha256('s' || record_id), record_id) AS rk FROM conditions)
    SELECT record_id FROM r WHERE rk <= CASE WHEN coalesce(is2, false) THEN 25 ELSE 75 END""")
def q_forced_sample(t: Tables) -> DataFrame:
    return sampling.forced_sample(t.conditions.select("record_id", "crystal_id"), "record_id", F.col("crystal_id") == "2", 100, 25).select("record_id")


_KEY = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))"


@registry.add(f"""
    WITH k AS (SELECT record_id, source, {_KEY.format("raw_details")} AS k FROM conditions WHERE length(raw_details) BETWEEN 21 AND 219),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY record_id) = 1)
    SELECT record_id, source FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('s' || record_id), record_id) <= 20""")
def q_balanced_texts(t: Tables) -> DataFrame:
    return sampling.balanced_texts(t.conditions.select("record_id", "source", "raw_details"), "record_id", "raw_details", "source", 20).select("record_id", "source")


@registry.add(f"""
    WITH h AS (SELECT record_id, {_KEY.format("raw_details")} AS k FROM conditions WHERE split = 'test')
    SELECT record_id FROM conditions c WHERE split = 'train' AND record_id NOT IN (SELECT record_id FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.k = {_KEY.format("c.raw_details")})""")
def q_hold_out(t: Tables) -> DataFrame:
    c = t.conditions.select("record_id", "split", "raw_details")
    return sampling.hold_out(c.where("split = 'train'"), c.where("split = 'test'"), "record_id", "raw_details").select("record_id")


@registry.add(f"""
    WITH k AS (SELECT min(doc_id) AS doc_id, {_KEY.format("text")} AS k FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING k <> '')
    SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('s' || doc_id), doc_id) AS INTEGER) AS ordinal FROM k QUALIFY ordinal <= 50""")
def q_frozen_set(t: Tables) -> DataFrame:
    return sampling.frozen_set(t.documents.where("text IS NOT NULL"), "doc_id", "text", 50)


@registry.add("""
    WITH a AS (SELECT DISTINCT record_id, name_canonical AS n, 0 AS rk, 'first' AS source FROM components WHERE component_index < 2 UNION ALL SELECT DISTINCT record_id, name_canonical, 1, 'second' FROM components WHERE component_index >= 1)
    SELECT source, count(*) AS n_names FROM (SELECT record_id, n, min_by(source, rk) AS source FROM a GROUP BY record_id, n) GROUP BY source""")
def q_merged_proposals(t: Tables) -> DataFrame:
    k = t.components.select("record_id", "name_canonical", "component_index")
    merged = sampling.merged_proposals([("first", k.where("component_index < 2")), ("second", k.where("component_index >= 1"))], ["record_id"], "name_canonical")
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n_names"))


_W = """WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (discard_reason IS NULL) AS k FROM conditions GROUP BY source), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g)"""


@registry.add(_W + """
    SELECT source, n, k, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low,
           round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high,
           (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) >= 0.9 AS passes FROM p""")
def q_wilson_gates(t: Tables) -> DataFrame:
    g = t.conditions.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("discard_reason").isNull()).alias("k"))
    return evaluation.gates(g, "k", "n", 0.9).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@registry.add("""
    WITH s AS (SELECT source, count(*) AS n, sum(CASE WHEN parse_confidence >= 0.9 THEN 1 ELSE 0 END) AS k FROM conditions WHERE parse_confidence IS NOT NULL AND split = 'test' GROUP BY source), p AS (SELECT source, count(*) AS pop FROM conditions GROUP BY source)
    SELECT round(sum(k) / sum(n), 6) AS raw, round(sum(k / n * pop) / sum(pop), 6) AS reweighted, CAST(sum(n) AS BIGINT) AS n FROM s JOIN p USING (source)""")
def q_weighted_accuracy(t: Tables) -> DataFrame:
    sample = t.conditions.where("parse_confidence IS NOT NULL AND split = 'test'").select("source", (F.col("parse_confidence") >= 0.9).alias("ok"))
    return evaluation.weighted_accuracy(sample, t.conditions, "source", "ok").select(F.round("raw", 6).alias("raw"), F.round("reweighted", 6).alias("reweighted"), "n")


_SETS = """
    WITH a AS (SELECT record_id, list(DISTINCT name_canonical) FILTER (name_canonical IS NOT NULL) AS truth, list(DISTINCT name_canonical) FILTER (name_canonical IS NOT NULL AND component_index < 3) AS guess FROM components GROUP BY record_id),
    c AS (SELECT CAST(sum(coalesce(len(list_intersect(truth, guess)), 0)) AS BIGINT) AS tp, CAST(sum(coalesce(len(list_filter(guess, lambda x: NOT list_contains(truth, x))), 0)) AS BIGINT) AS fp, CAST(sum(coalesce(len(list_filter(truth, lambda x: NOT list_contains(coalesce(guess, []), x))), 0)) AS BIGINT) AS fn FROM a)"""


@registry.add(_SETS + " SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fn + fp), 6) AS f1, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6) AS f05 FROM c")
def q_precision_recall(t: Tables) -> DataFrame:
    named = F.col("name_canonical").isNotNull()
    g = t.components.groupBy("record_id").agg(F.collect_set(F.when(named, F.col("name_canonical"))).alias("truth"), F.collect_set(F.when(named & (F.col("component_index") < 3), F.col("name_canonical"))).alias("guess"))
    s = evaluation.set_scores(g, F.col("truth"), F.col("guess"))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "f05")})


@registry.add("SELECT name_canonical, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, name_canonical) AS INTEGER) AS rank FROM components WHERE name_canonical IS NOT NULL GROUP BY name_canonical")
def q_frequency_prior(t: Tables) -> DataFrame:
    return evaluation.frequency_prior(t.components, "name_canonical")


_HITS = """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), h AS (SELECT a.vec_id AS q, b.vec_id AS t, round(list_cosine_similarity(a.e, b.e), 9) AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    top AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, t) <= 10), s AS (SELECT q, label, sum(w) AS score FROM top JOIN v ON v.vec_id = top.t GROUP BY ALL),
    r AS (SELECT q, label, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, label) AS INTEGER) AS rank FROM s), p AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS pr FROM v GROUP BY label)"""


def _hits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Hits of the stated queries (ids divisible by 20) against all vectors. The queries are collected in blocks and sent to the scan, so every vector is read once and only the best of each task are shuffled."""
    from brineflow.operators.vectors import nearest_vectors

    v = t.embeddings.select("vec_id", "embedding")
    return nearest_vectors(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10).withColumn("w", F.round("similarity", 9)), t.embeddings.select(F.col("vec_id").alias("t"), "label")


def _votes(t: Tables) -> DataFrame:
    hits, labels = _hits(t)
    return evaluation.votes(hits.select(F.col("query").alias("q"), F.col("target").alias("t"), "w"), labels, "q", "t", "w", "label", 10)


@registry.add(_HITS + " SELECT q, label, rank FROM r")
def q_neighbour_votes(t: Tables) -> DataFrame:
    return _votes(t).select("q", "label", "rank")


@registry.add(_HITS + """, x AS (SELECT q, label, 0 AS o, rank AS k FROM r UNION ALL SELECT d.q, p.label, 1, p.pr FROM (SELECT DISTINCT q FROM r) d, p),
    u AS (SELECT q, label, min(struct_pack(o := o, k := k)) AS m FROM x GROUP BY ALL) SELECT q, label, CAST(row_number() OVER (PARTITION BY q ORDER BY m, label) AS INTEGER) AS rank FROM u""")
def q_hybrid_ranking(t: Tables) -> DataFrame:
    ranked = _votes(t).select("q", "label", "rank")
    return evaluation.hybrid(ranked, ranked, evaluation.frequency_prior(t.embeddings, "label"), "q", "label")


@registry.add(_HITS + """, a AS (SELECT v.vec_id AS q, rank FROM v LEFT JOIN r ON r.q = v.vec_id AND r.label = v.label WHERE v.vec_id % 20 = 0), n AS (SELECT count(DISTINCT label) AS n FROM v)
    SELECT CAST(k AS INTEGER) AS k, CASE WHEN k < 10 THEN round((SELECT avg(CASE WHEN coalesce(rank <= k, false) THEN 1.0 ELSE 0.0 END) FROM a), 6) END AS accuracy, 1.0::DOUBLE AS coverage, (SELECT count(*) FROM a) AS n FROM (SELECT unnest([1, 3, 10]) AS k)""")
def q_topk_accuracy(t: Tables) -> DataFrame:
    truth = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label")
    return evaluation.top_k(_votes(t), truth, "q", "label", [1, 3, 10], 10).withColumn("accuracy", F.round("accuracy", 6))


@registry.add("""
    WITH d AS (SELECT discard_reason IS NULL AS y, n_components AS s FROM conditions WHERE n_components IS NOT NULL)
    SELECT round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) FROM d a, d b WHERE a.y AND NOT b.y) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc, count(*) FILTER (y) AS n_pos, count(*) AS n FROM d""")
def q_auc(t: Tables) -> DataFrame:
    d = t.conditions.where("n_components IS NOT NULL")
    return evaluation.auc(d, F.col("discard_reason").isNull(), F.col("n_components")).select(F.round("auc", 6).alias("auc"), "n_pos", "n")


@registry.add("""
    WITH d AS (SELECT record_id, CASE WHEN discard_reason IS NULL THEN 1.0 ELSE 0.0 END AS y, parse_confidence AS s FROM conditions WHERE parse_confidence IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS rk, count(*) OVER () AS n FROM d)
    SELECT CAST(share AS DOUBLE) AS share, count(*) AS n_top, round(avg(y), 6) AS rate, round((SELECT avg(y) FROM d), 6) AS base FROM r, (SELECT unnest([0.05, 0.1, 0.25]) AS share) WHERE rk <= greatest(1, CAST(floor(n * share) AS BIGINT)) GROUP BY share""")
def q_lift(t: Tables) -> DataFrame:
    d = t.conditions.where("parse_confidence IS NOT NULL")
    return evaluation.lift(d, F.col("discard_reason").isNull().cast("int"), F.col("parse_confidence"), "record_id", [0.05, 0.1, 0.25]).withColumns({"rate": F.round("rate", 6), "base": F.round("base", 6)})


@registry.add("""
    WITH c AS (SELECT source, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn
               FROM (SELECT source, coalesce(n_components > 4, false) AS a, coalesce(n_components_identified > 4, false) AS b FROM conditions) GROUP BY source)
    SELECT source, tp, fp, fn, tn, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c WHERE (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0""")
def q_matthews(t: Tables) -> DataFrame:
    a, b = F.coalesce(F.col("n_components") > 4, F.lit(False)), F.coalesce(F.col("n_components_identified") > 4, F.lit(False))
    g = t.conditions.groupBy("source").agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    return g.withColumn("mcc", F.round(S.matthews(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), 6)).where("mcc IS NOT NULL")
