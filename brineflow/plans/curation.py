"""Queries of curation, answer guards, scores by source, homology and bridges, over whole tables and with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.functions import quantity as Q
from brineflow.functions import stats as S
from brineflow.functions import text as X
from brineflow.operators import assign, corpus, curation, evaluation, joins, lexicon, link, release, sampling, screens
from brineflow.plans.registry import Registry, Tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

_FLAT = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_SPELLINGS = f"s AS (SELECT DISTINCT canonical_id, {_FLAT.format('a')} AS flat FROM (SELECT canonical_id, unnest(list_concat([display_name], coalesce(aliases, []))) AS a FROM reagents) WHERE length({_FLAT.format('a')}) >= 3)"
_GROUNDED = f"""{_SPELLINGS}, g AS (SELECT flat, list(longer ORDER BY length(longer) DESC, longer) AS longer FROM (SELECT DISTINCT a.flat, b.flat AS longer FROM s a JOIN s b ON starts_with(b.flat, a.flat) AND length(b.flat) > length(a.flat) AND a.canonical_id <> b.canonical_id) GROUP BY flat)"""
_HIT = "contains(list_reduce(list_prepend({t}, coalesce(g.longer, [])), lambda acc, w: replace(acc, w, '#')), s.flat)"
_LOOKUP = "lk AS (SELECT key, min(canonical_id) AS canonical_id FROM (SELECT canonical_id, lower(trim(unnest(list_concat([display_name, canonical_id], coalesce(aliases, []))))) AS key FROM reagents) GROUP BY key)"


def _lookup(t: Tables) -> DataFrame:
    names = F.concat(F.array("display_name", "canonical_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    return t.reagents.select("canonical_id", F.explode(names).alias("a")).groupBy(F.lower(F.trim("a")).alias("key")).agg(F.min("canonical_id").alias("canonical_id"))


# answers of models


@registry.add(f"""
    WITH {_GROUNDED}, {_LOOKUP}, i AS (SELECT component_id, record_id, role, coalesce(name_canonical, name_raw) AS name, concentration, unit, coalesce(parse_confidence, 0) >= 0.3 AS valid FROM components),
    n AS (SELECT i.*, coalesce(r.canonical_id, lk.canonical_id) AS now, c.raw_details AS text, c.record_id IS NOT NULL AS there, coalesce(role = 'not_a_component', false) AS none
          FROM i LEFT JOIN reagents r ON r.canonical_id = i.name LEFT JOIN lk ON lk.key = lower(trim(i.name)) LEFT JOIN (SELECT record_id, raw_details FROM conditions WHERE discard_reason IS NULL) c ON c.record_id = i.record_id),
    h AS (SELECT DISTINCT n.component_id FROM n JOIN s ON s.canonical_id = n.now AND contains({_FLAT.format('n.text')}, s.flat) LEFT JOIN g ON g.flat = s.flat WHERE {_HIT.format(t=_FLAT.format('n.text'))}),
    o AS (SELECT n.*, CASE WHEN NOT there THEN 'stale' WHEN NOT valid THEN 'invalid' WHEN none THEN 'kept' WHEN now IS NULL THEN 'unknown' WHEN h.component_id IS NULL THEN 'ungrounded' ELSE 'kept' END AS outcome,
          coalesce(concentration > 0 AND CASE WHEN unit LIKE 'percent%' THEN concentration > 100 ELSE concentration * CASE unit WHEN 'molar' THEN 1.0 WHEN 'millimolar' THEN 1e-3 WHEN 'micromolar' THEN 1e-6 WHEN 'nanomolar' THEN 1e-9 END > 8 END, false) AS implausible FROM n LEFT JOIN h USING (component_id))
    SELECT component_id, outcome, CASE WHEN outcome = 'kept' AND NOT none THEN now END AS name_canonical, implausible, CASE WHEN outcome = 'kept' AND NOT none AND now <> name THEN 'alias' END AS rescued FROM o""".replace("coalesce(parse_confidence, 0) >= 0.3", "component_id % 50 <> 0"))
def q_answer_guards(t: Tables) -> DataFrame:
    """The components as answers of a model, against the texts of usable records; near misses, which SQL lacks, are off."""
    k = t.components.select(
        "record_id", F.col("component_id").alias("ordinal"), "role", F.coalesce("name_canonical", "name_raw").alias("name"), F.col("concentration").alias("amount"), "unit", (F.col("component_id") % 50 != 0).alias("valid")
    )
    texts = t.conditions.where("discard_reason IS NULL").select("record_id", F.col("raw_details").alias("text"))
    g = corpus.guarded_answers(k, texts, ["record_id"], _lookup(t), corpus.spellings_of(t.reagents), fuzzy=None)
    return g.select(F.col("ordinal").alias("component_id"), "outcome", "name_canonical", "implausible", "rescued")


@registry.add(f"""
    WITH {_GROUNDED}, m AS (SELECT DISTINCT k.record_id, k.name_canonical AS canonical_id, {_FLAT.format('c.raw_details')} AS t FROM components k JOIN conditions c ON c.record_id = k.record_id WHERE k.name_canonical IS NOT NULL AND c.raw_details IS NOT NULL),
    h AS (SELECT m.record_id, m.canonical_id FROM m JOIN s ON s.canonical_id = m.canonical_id AND contains(m.t, s.flat) LEFT JOIN g ON g.flat = s.flat WHERE {_HIT.format(t='m.t')} GROUP BY ALL HAVING max(length(s.flat)) >= 8)
    SELECT k.component_id FROM components k JOIN h ON h.record_id = k.record_id AND h.canonical_id = k.name_canonical WHERE k.concentration IS NOT NULL""")
def q_teacher_components(t: Tables) -> DataFrame:
    k = t.components.where("name_canonical IS NOT NULL").join(t.conditions.where("raw_details IS NOT NULL").select("record_id", "raw_details"), "record_id")
    k = k.select("component_id", "record_id", F.col("name_canonical").alias("canonical_id"), "concentration", "raw_details")
    return corpus.teacher_components(k, "record_id", "canonical_id", "concentration", "raw_details", corpus.spellings_of(t.reagents)).select("component_id")


@registry.add(f"""
    WITH {_LOOKUP}, n AS (SELECT name_canonical, coalesce(r.canonical_id, lk.canonical_id) AS now FROM components k LEFT JOIN reagents r ON r.canonical_id = k.name_canonical LEFT JOIN lk ON lk.key = lower(trim(k.name_canonical)) WHERE name_canonical IS NOT NULL)
    SELECT CASE WHEN now IS NULL THEN 'dropped' WHEN now = name_canonical THEN 'kept' ELSE 'remapped' END AS fate, count(*) AS n, count(DISTINCT name_canonical) AS n_names FROM n GROUP BY 1""")
def q_recanonicalised(t: Tables) -> DataFrame:
    r = corpus.recanonicalised(t.components.where("name_canonical IS NOT NULL").select("name_canonical"), "name_canonical", _lookup(t))
    return r.groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name_canonical").alias("n_names"))


@registry.add("""
    WITH n AS (SELECT count(*) FILTER (source = 'rules') AS b, count(*) FILTER (source <> 'rules') AS e FROM conditions), x AS (SELECT greatest(1, CAST(round(b * 0.6 / 0.4 / greatest(1, e)) AS INTEGER)) AS times FROM n)
    SELECT record_id, 1 AS repeat FROM conditions WHERE source = 'rules' UNION ALL SELECT record_id, CAST(unnest(range(1, times + 1)) AS INTEGER) FROM conditions, x WHERE source <> 'rules'""")
def q_mixed(t: Tables) -> DataFrame:
    c = t.conditions.select("record_id", "source")
    return corpus.mixed(c.where("source = 'rules'"), c.where("source <> 'rules'"), 0.6).select("record_id", "repeat")


@registry.add("""
    WITH g AS (SELECT k.record_id, min(CASE WHEN name_canonical IS NOT NULL OR coalesce(role = 'not_a_component', false) THEN 1 ELSE 0 END) AS named, min(c.parse_confidence) AS conf, max(c.discard_reason) AS why FROM components k JOIN conditions c USING (record_id) GROUP BY 1)
    SELECT record_id FROM g WHERE named = 1 AND conf >= 0.95 AND why IS NULL""")
def q_usable_examples(t: Tables) -> DataFrame:
    both = t.components.select("record_id", "name_canonical", "role").join(t.conditions.select("record_id", "parse_confidence", "discard_reason"), "record_id")
    return corpus.usable_example(both, ["record_id"])


@registry.add("""
    SELECT component_id, concat_ws('|', role, name_canonical, coalesce(printf('%.4f', concentration), ''), coalesce(unit, '')) AS key,
           CASE WHEN unit IN ('molar', 'millimolar', 'micromolar', 'nanomolar') THEN 'molar' WHEN unit IN ('mg_ml', 'g_l') THEN 'mass' ELSE unit END AS family,
           trim(name_raw) IN ('a', 'an', 'and', 'at', 'buffer', 'drop', 'for', 'from', 'in', 'of', 'on', 'or', 'protein', 'reservoir', 'solution', 'the', 'to', 'well', 'with', 'crystal', 'crystals', 'plus', 'solutions', 'was', 'were', 'by', 'contain', 'containing') OR length(trim(name_raw)) < 2 AS noise,
           lower(unit) AS low FROM components""".replace("lower(unit) AS low", "CASE WHEN unit IN ('molar', 'millimolar', 'micromolar', 'nanomolar', 'percent_w_v', 'percent_v_v', 'percent_unspecified', 'mg_ml', 'g_l', 'unitless') THEN unit WHEN lower(trim(unit)) IN ('m') THEN 'molar' WHEN lower(trim(unit)) = 'mm' THEN 'millimolar' WHEN lower(trim(unit)) = 'um' THEN 'micromolar' WHEN lower(trim(unit)) = 'nm' THEN 'nanomolar' WHEN lower(trim(unit)) IN ('% w/v', '%w/v') THEN 'percent_w_v' WHEN lower(trim(unit)) IN ('% v/v', '%v/v') THEN 'percent_v_v' WHEN lower(trim(unit)) = 'mg/ml' THEN 'mg_ml' WHEN lower(trim(unit)) = 'g/l' THEN 'g_l' WHEN lower(trim(unit)) = '%' THEN 'percent_unspecified' END AS repaired"))
def q_component_values(t: Tables) -> DataFrame:
    return t.components.select(
        "component_id", corpus.component_key(F.col("role"), F.col("name_canonical"), F.col("concentration"), F.col("unit")).alias("key"), Q.comparable(F.col("concentration"), F.col("unit"))["family"].alias("family"),
        X.is_noise(F.col("name_raw")).alias("noise"), corpus.repair_unit(F.col("unit")).alias("repaired"),
    )


# curation


@registry.add("""
    WITH q AS (SELECT name_raw AS name, count(*) AS n_uses FROM components WHERE name_raw IS NOT NULL AND name_canonical IS NULL GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT *, row_number() OVER (ORDER BY n_uses DESC, name) AS rank FROM q),
    e AS (SELECT name_raw AS name, list(DISTINCT record_id ORDER BY record_id)[1:3] AS examples FROM components WHERE name_canonical IS NULL GROUP BY 1)
    SELECT x.name, n_uses, CAST(rank AS INTEGER) AS rank, array_to_string(examples, ',') AS examples FROM x JOIN e USING (name) WHERE rank <= 40""")
def q_questions(t: Tables) -> DataFrame:
    q = curation.questions(t.components.where("name_canonical IS NULL").withColumnRenamed("name_raw", "name"), "name", "record_id", least=2)
    return q.select("name", "n_uses", "rank", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


_QUEUE = """q AS (SELECT name_raw AS name, max(name_canonical) AS target, max(chem_class) AS chem_class, count(*) AS weight, CASE WHEN max(name_canonical) IS NULL THEN 'new:' ELSE 'map:' END || coalesce(max(chem_class), 'none') AS bucket FROM components WHERE trim(name_raw) <> '' GROUP BY 1)"""


def _queue(t: Tables) -> DataFrame:
    q = t.components.where("trim(name_raw) <> ''").groupBy(F.col("name_raw").alias("name")).agg(F.max("name_canonical").alias("target"), F.max("chem_class").alias("chem_class"), F.count(F.lit(1)).alias("weight"))
    return q.withColumn("bucket", F.concat(F.when(F.col("target").isNull(), "new:").otherwise("map:"), F.coalesce("chem_class", F.lit("none"))))


@registry.add(f"WITH {_QUEUE} SELECT CASE WHEN target IS NULL THEN 'new' ELSE 'map' END || ':' || coalesce(chem_class, 'none') AS bucket, count(*) AS n_names, CAST(sum(weight) AS BIGINT) AS weight FROM q GROUP BY 1")
def q_buckets(t: Tables) -> DataFrame:
    q = _queue(t)
    return curation.buckets(q, F.when(F.col("target").isNull(), "new").otherwise("map"), F.coalesce("chem_class", F.lit("none")))


@registry.add(f"""
    WITH {_QUEUE}, al AS (SELECT lower(trim(unnest(list_concat([display_name], coalesce(aliases, []))))) AS low, canonical_id FROM reagents), own AS (SELECT low, min(canonical_id) AS owner FROM al GROUP BY 1),
    a AS (SELECT bucket, CASE WHEN bucket LIKE 'map:%' THEN 'accept' WHEN bucket LIKE 'new:%' THEN 'new' END AS chosen FROM (SELECT DISTINCT bucket FROM q) WHERE bucket <> 'map:buffer'),
    j AS (SELECT q.*, chosen, owner, target IN (SELECT owner FROM own) AS there, regexp_matches(lower(name), '^[0-9]+$') AS digits FROM q LEFT JOIN a USING (bucket) LEFT JOIN own ON own.low = lower(trim(q.name))),
    o AS (SELECT *, CASE WHEN chosen IN ('accept', 'new') AND owner IS NOT NULL THEN 'already an alias of ' || owner WHEN chosen = 'accept' AND NOT coalesce(there, false) THEN 'target not in the lexicon'
               WHEN chosen = 'new' AND trim(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = '' THEN 'no legal id' END AS why FROM j)
    SELECT name, weight, CASE WHEN chosen IS NULL THEN 'left' WHEN why IS NOT NULL THEN 'skipped' WHEN chosen = 'new' THEN 'new' ELSE 'alias' END AS outcome, why FROM o""")
def q_bucket_answers(t: Tables) -> DataFrame:
    q = _queue(t)
    answers = q.select("bucket").distinct().where("bucket <> 'map:buffer'").withColumn("chosen", F.when(F.col("bucket").startswith("map:"), "accept").otherwise("new"))
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    aliases = t.reagents.select("canonical_id", F.explode(names).alias("a")).groupBy(F.lower(F.trim("a")).alias("name")).agg(F.min("canonical_id").alias("owner"))
    return curation.apply_bucket_answers(q, answers, aliases).select("name", "weight", "outcome", "why")


@registry.add("""
    WITH m AS (SELECT name_raw AS subject, name_canonical AS decision, count(*) AS n FROM components WHERE name_raw IS NOT NULL AND name_canonical IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, subject || chr(31) || decision ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS coverage FROM m)
    SELECT 'mapping' AS kind, subject, decision, n, round(coverage, 9) AS coverage FROM c UNION ALL
    SELECT 'unmapped', name_raw, NULL, count(*), NULL FROM components WHERE name_raw IS NOT NULL AND name_canonical IS NULL GROUP BY name_raw UNION ALL
    SELECT 'unit', name_canonical, unit, count(*), NULL FROM components WHERE name_canonical IS NOT NULL AND unit IS NOT NULL GROUP BY 2, 3""")
def q_audit_worklist(t: Tables) -> DataFrame:
    return curation.audit_worklist(t.components, "name_raw", "name_canonical", "unit").withColumn("coverage", F.round("coverage", 9))


@registry.add("""
    WITH k AS (SELECT * FROM components WHERE name_canonical IS NOT NULL), u AS (SELECT name_canonical, unit, count(*) AS n FROM k WHERE unit IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY name_canonical) AS share, sum(n) OVER (PARTITION BY name_canonical) AS t, row_number() OVER (PARTITION BY name_canonical ORDER BY n DESC, unit) AS r FROM u)
    SELECT 'ambiguous_name' AS anomaly, lower(trim(name_raw)) AS subject, string_agg(DISTINCT name_canonical, '|' ORDER BY name_canonical) AS detail, count(*) AS n FROM k WHERE name_raw IS NOT NULL GROUP BY 2 HAVING count(DISTINCT name_canonical) > 1 UNION ALL
    SELECT 'minority_unit', name_canonical, unit, n FROM s WHERE share > 0.005 AND share < 0.15 AND t >= 50 UNION ALL
    SELECT 'contradictory_unit', name_canonical, default_unit || '|' || unit, n FROM s JOIN reagents r ON r.canonical_id = s.name_canonical WHERE s.r = 1 AND default_unit <> unit UNION ALL
    SELECT 'missing_reagent', name_canonical, NULL, count(*) FROM k WHERE name_canonical NOT IN (SELECT canonical_id FROM reagents) GROUP BY 2 UNION ALL
    SELECT 'unused_reagent', canonical_id, NULL, 0 FROM reagents WHERE canonical_id NOT IN (SELECT name_canonical FROM k)""")
def q_anomalies(t: Tables) -> DataFrame:
    return curation.anomalies(t.components, t.reagents, "name_raw", "name_canonical", "unit")


_CELLS = """cell AS (SELECT 2 AS level, source AS cell, CAST(NULL AS VARCHAR) AS parent, count(*) AS n_records FROM conditions WHERE source IS NOT NULL GROUP BY 2 UNION ALL
    SELECT 3, source || ':' || coalesce(method, '-'), source, count(*) FROM conditions WHERE source IS NOT NULL GROUP BY 2, 3)"""


def _cells(t: Tables) -> DataFrame:
    c = t.conditions.where("source IS NOT NULL")
    second = c.groupBy(F.col("source").alias("cell")).agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(2).alias("level"), "cell", F.lit(None).cast("string").alias("parent"), "n_records")
    third = c.groupBy(F.concat_ws(":", "source", F.coalesce("method", F.lit("-"))).alias("cell"), F.col("source").alias("parent")).agg(F.count(F.lit(1)).alias("n_records"))
    return second.unionByName(third.withColumn("level", F.lit(3)))


@registry.add(f"""
    WITH {_CELLS}, two AS (SELECT * FROM cell WHERE level = 2 AND n_records >= 5 ORDER BY n_records DESC, cell LIMIT 3), three AS (SELECT * FROM cell WHERE level = 3 AND n_records >= 5 AND parent IN (SELECT cell FROM two) ORDER BY n_records DESC, cell LIMIT 3)
    SELECT * FROM two UNION ALL SELECT * FROM three""")
def q_selected_cells(t: Tables) -> DataFrame:
    return curation.select_cells(_cells(t), 5, 3)


@registry.add(f"""
    WITH {_CELLS}, g AS (SELECT cell AS group_id, n_records FROM cell WHERE level = 2 AND cell <> 'rules'), a AS (SELECT 'teacher' AS group_id), o AS (SELECT * FROM cell WHERE n_records >= 2 AND cell NOT IN (SELECT group_id FROM g) ORDER BY n_records DESC, cell LIMIT 8),
    b AS (SELECT * FROM g WHERE group_id NOT IN (SELECT group_id FROM a) ORDER BY n_records DESC, group_id LIMIT 8)
    SELECT 'orphan' AS gap, cell AS subject, n_records AS n FROM o UNION ALL SELECT 'anchorless', group_id, n_records FROM b""")
def q_group_gaps(t: Tables) -> DataFrame:
    cells = _cells(t)
    groups = cells.where("level = 2 AND cell <> 'rules'").select(F.col("cell").alias("group_id"), "n_records")
    return curation.group_gaps(cells, groups, t.spark.createDataFrame([("teacher",)], "group_id string"), 2)


@registry.add(f"""
    WITH {_CELLS}, g AS (SELECT upper(regexp_replace(cell, '[^A-Za-z0-9]+', '_', 'g')) AS id, CASE WHEN n_records % 5 = 0 THEN 4 ELSE level END AS level, CASE WHEN n_records % 3 = 0 THEN 'peg' WHEN n_records % 3 = 1 THEN 'salt' ELSE 'tea' END AS l1_class, upper(parent) AS parent, CASE WHEN n_records % 7 <> 0 THEN n_records::DOUBLE END AS ph FROM cell
                     UNION ALL SELECT 'bad id', 3, 'peg', NULL, 1.0 UNION ALL SELECT 'LOST', 3, 'peg', 'NOBODY', 1.0),
    p AS (SELECT id, min(level) AS l, min(l1_class) AS c FROM g GROUP BY 1)
    SELECT 'id_shape' AS rule, id FROM g WHERE NOT regexp_full_match(id, '[A-Z0-9]+(_[A-Z0-9]+)*') UNION ALL SELECT 'level', id FROM g WHERE level NOT IN (2, 3) UNION ALL SELECT 'unknown_class', id FROM g WHERE l1_class NOT IN ('peg', 'salt') UNION ALL
    SELECT 'empty_centroid', id FROM g WHERE ph IS NULL UNION ALL SELECT 'no_parent', id FROM g WHERE level = 3 AND parent IS NULL UNION ALL SELECT 'repeated_id', id FROM g GROUP BY id HAVING count(*) > 1 UNION ALL
    SELECT CASE WHEN p.id IS NULL THEN 'parent_missing' WHEN p.l <> 2 THEN 'parent_level' ELSE 'parent_class' END, g.id FROM g LEFT JOIN p ON p.id = g.parent WHERE g.parent IS NOT NULL AND (p.id IS NULL OR p.l <> 2 OR p.c <> g.l1_class)""")
def q_group_violations(t: Tables) -> DataFrame:
    """Groups made of the cells, with faults dealt among them by their size, and two faulty ones."""
    n = F.col("n_records")
    g = _cells(t).select(
        F.upper(F.regexp_replace("cell", "[^A-Za-z0-9]+", "_")).alias("id"), F.when(n % 5 == 0, 4).otherwise(F.col("level")).alias("level"),
        F.when(n % 3 == 0, "peg").when(n % 3 == 1, "salt").otherwise("tea").alias("l1_class"), F.upper("parent").alias("parent"), F.when(n % 7 != 0, n.cast("double")).alias("ph"),
    )
    bad = t.spark.createDataFrame([("bad id", 3, "peg", None, 1.0), ("LOST", 3, "peg", "NOBODY", 1.0)], "id string, level int, l1_class string, parent string, ph double")
    return curation.group_violations(g.unionByName(bad), ["peg", "salt"], ["ph"])


@registry.add("""
    WITH m AS (SELECT c.source, c.record_id, k.name_canonical AS name FROM conditions c JOIN components k USING (record_id)), z AS (SELECT source, count(DISTINCT record_id) AS size FROM m GROUP BY 1),
    h AS (SELECT source, name, count(DISTINCT record_id) AS n FROM m WHERE name IS NOT NULL GROUP BY 1, 2), r AS (SELECT h.*, row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS r FROM h JOIN z USING (source) WHERE n >= 0.10 * size)
    SELECT source, string_agg(name, ' + ' ORDER BY r) AS label FROM r WHERE r <= 5 GROUP BY 1""")
def q_member_names(t: Tables) -> DataFrame:
    m = t.conditions.select("record_id", "source").join(t.components.select("record_id", F.col("name_canonical").alias("name")), "record_id")
    return curation.member_names(m, "source", "record_id", "name")


@registry.add("""
    WITH l AS (SELECT CASE WHEN ph IS NULL THEN NULL WHEN ph < 7 THEN 2 ELSE 3 END AS level, split = 'train' AS anchored FROM conditions)
    SELECT count(*) FILTER (level = 2) AS n_level2, count(*) FILTER (level = 3) AS n_level3, count(*) FILTER (level IS NULL) AS n_unassigned, count(*) FILTER (anchored) AS n_anchored, (SELECT count(DISTINCT record_id) FROM components WHERE premix_id IS NOT NULL OR chem_class = 'premix') AS n_premix FROM l""")
def q_strategy_counts(t: Tables) -> DataFrame:
    assigned = t.conditions.select(F.when(F.col("ph") < 7, 2).when(F.col("ph").isNotNull(), 3).alias("level"), (F.col("split") == "train").alias("anchored"))
    return curation.strategy_counts(assigned, t.components, "record_id")


@registry.add("""
    WITH g AS (SELECT source, avg(ph) AS ph, avg(protein_concentration_mg_ml) AS organic FROM conditions GROUP BY 1)
    SELECT source, concat_ws(', ', CASE WHEN organic IS NOT NULL THEN printf('%.1f %% organic', round(organic, 6)) END, CASE WHEN ph IS NOT NULL THEN printf('pH %.1f', round(ph, 6)) END) AS label FROM g""")
def q_centroid_texts(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    g = t.conditions.groupBy("source").agg(F.round(F.avg("ph"), 6).alias("ph"), F.round(F.avg("protein_concentration_mg_ml"), 6).alias("organic_percent"))
    return g.withColumns({"peg_log_mw": none, "peg_percent": none, "salt_log_molar": none}).select("source", assign.centroid_text().alias("label"))


# scores


@registry.add("""
    WITH p AS (SELECT source, method, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, method) AS r FROM conditions WHERE method IS NOT NULL GROUP BY 1, 2), ranked AS (SELECT source, list(method ORDER BY r) AS ranked FROM p WHERE source <> 'teacher' GROUP BY 1),
    sets AS (SELECT cluster_30, list(DISTINCT method) AS labels FROM conditions WHERE cluster_30 IS NOT NULL AND method IS NOT NULL GROUP BY 1),
    x AS (SELECT 'record' AS mode, CASE WHEN method IS NULL THEN [] ELSE [method] END AS labels, coalesce(ranked, []) AS ranked FROM conditions LEFT JOIN ranked USING (source) UNION ALL
          SELECT 'cluster_30', coalesce(labels, []), coalesce(ranked, []) FROM conditions LEFT JOIN ranked USING (source) LEFT JOIN sets USING (cluster_30)),
    k AS (SELECT unnest([1, 3, 99]) AS k)
    SELECT mode, CAST(k AS INTEGER) AS k, count(*) AS n, CASE WHEN k < 50 THEN round(avg(CASE WHEN list_has_any(labels, ranked[1:k]) THEN 1.0 ELSE 0.0 END), 9) END AS hit, round(avg(CASE WHEN len(ranked) > 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(len(labels)), 9) AS mean_labels
    FROM x, k WHERE len(labels) > 0 GROUP BY mode, k""")
def q_multilabel_hits(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    c = t.conditions.select("record_id", "source", "method", "cluster_30")
    counts = c.where("method IS NOT NULL").groupBy("source", "method").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.asc("method")))
    lists = counts.withColumn("r", order).where("source <> 'teacher'").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "method"))), lambda x: x["method"]).alias("ranked"))
    ranked = c.select("record_id", "source").join(F.broadcast(lists), "source").select("record_id", "ranked")  # one row a source
    hits = evaluation.multilabel_hits(c, "record_id", "method", ["cluster_30"], ranked, [1, 3, 99], 50)
    return hits.select("mode", "k", "n", *[F.round(x, 9).alias(x) for x in ("hit", "coverage", "mean_labels")])


_GOLD = """named AS (SELECT record_id, list(DISTINCT name_canonical) AS gold FROM components GROUP BY 1 HAVING count(*) FILTER (name_canonical IS NULL) = 0),
    a AS (SELECT record_id, list(DISTINCT name_canonical) AS f FROM components WHERE concentration IS NOT NULL AND name_canonical IS NOT NULL GROUP BY 1), b AS (SELECT record_id, list(DISTINCT name_canonical) AS f FROM components WHERE chem_class <> 'salt' AND name_canonical IS NOT NULL GROUP BY 1),
    n AS (SELECT gold, coalesce(a.f, []) AS a, coalesce(b.f, []) AS b FROM named LEFT JOIN a USING (record_id) LEFT JOIN b USING (record_id)),
    x AS (SELECT 'amounts' AS source, gold, a AS f FROM n UNION ALL SELECT 'unsalted', gold, b FROM n UNION ALL SELECT 'either', gold, list_distinct(list_concat(a, b)) FROM n UNION ALL SELECT 'agreed', gold, list_intersect(a, b) FROM n),
    s AS (SELECT source, sum(len(list_intersect(gold, f))) AS tp, sum(len(f) - len(list_intersect(gold, f))) AS fp, sum(len(gold) - len(list_intersect(gold, f))) AS fn FROM x GROUP BY 1)"""


@registry.add(f"WITH {_GOLD} SELECT source, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6) AS f05 FROM s")
def q_gold_scores(t: Tables) -> DataFrame:
    k = t.components.select("record_id", F.col("name_canonical").alias("name"), "concentration", "chem_class")
    sources = {"amounts": k.where("concentration IS NOT NULL"), "unsalted": k.where("chem_class <> 'salt'")}
    g = evaluation.gold_scores(k, sources, {"either": ("union", ["amounts", "unsalted"]), "agreed": ("agreement", ["amounts", "unsalted"])}, ["record_id"], "name")
    return g.select("source", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")])


@registry.add("SELECT name_raw, count(*) AS n FROM components WHERE name_canonical IS NULL AND name_raw IS NOT NULL GROUP BY 1")
def q_unresolved(t: Tables) -> DataFrame:
    return evaluation.unresolved(t.components, "name_raw", "name_canonical")


@registry.add("""
    WITH c AS (SELECT *, coalesce(parse_confidence >= 0.5, false) AS ok FROM conditions), d AS (SELECT 'all' AS dimension, 'all' AS value, ok FROM c UNION ALL SELECT 'source', coalesce(source, 'unknown'), ok FROM c UNION ALL SELECT 'era', CASE WHEN deposited_at IS NULL THEN 'unknown' WHEN year(deposited_at) < 2000 THEN 'before 2000' WHEN year(deposited_at) < 2010 THEN '2000s' WHEN year(deposited_at) < 2020 THEN '2010s' ELSE '2020s' END, ok FROM c)
    SELECT dimension, value, count(*) AS n, count(*) FILTER (ok) AS n_correct, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM d GROUP BY 1, 2 UNION ALL
    SELECT 'error', f, count(*), 0, NULL FROM (SELECT unnest(flags) AS f FROM c WHERE NOT ok) GROUP BY f""")
def q_audit_scores(t: Tables) -> DataFrame:
    c = t.conditions.select("source", Q.era(F.col("deposited_at")).alias("era"), "flags", (F.col("parse_confidence") >= 0.5).alias("ok"))
    return evaluation.audit_scores(c, "ok", ["source", "era"], "flags").select("dimension", "value", "n", "n_correct", F.round("accuracy", 9).alias("accuracy"))


@registry.add("""
    WITH a AS (SELECT record_id, list(DISTINCT name_canonical) AS f FROM components WHERE concentration IS NOT NULL AND name_canonical IS NOT NULL GROUP BY 1), b AS (SELECT record_id, list(DISTINCT name_canonical) AS f FROM components WHERE chem_class <> 'salt' AND name_canonical IS NOT NULL GROUP BY 1),
    d AS (SELECT record_id, len(list_filter(coalesce(a.f, []), lambda x: NOT list_contains(coalesce(b.f, []), x))) AS only_a, len(list_filter(coalesce(b.f, []), lambda x: NOT list_contains(coalesce(a.f, []), x))) AS only_b FROM a FULL JOIN b USING (record_id))
    SELECT record_id, CAST(only_a AS INTEGER) AS only_a, CAST(only_b AS INTEGER) AS only_b, CASE WHEN only_a > 0 AND only_b > 0 THEN 'both' WHEN only_a > 0 THEN 'a_only' ELSE 'b_only' END AS stratum FROM d WHERE only_a > 0 OR only_b > 0""")
def q_disagreement(t: Tables) -> DataFrame:
    return sampling.disagreement(t.components.where("concentration IS NOT NULL"), t.components.where("chem_class <> 'salt'"), ["record_id"], "name_canonical")


# sequences and key spaces


_KMERS = "SELECT id, list_distinct(list_transform(range(1, CAST(length(seq) AS BIGINT) - 3), lambda i: substr(upper(seq), i, 5))) AS w FROM (SELECT pdb_id || '_' || entity_id AS id, seq_can AS seq FROM entities) WHERE length(seq) >= 5"


@registry.add(f"""
    WITH w AS ({_KMERS}), a AS (SELECT id AS query, len(w) AS na, unnest(w) AS k FROM w WHERE id LIKE '%0_1'), b AS (SELECT id AS target, len(w) AS nb, unnest(w) AS k FROM w),
    g AS (SELECT query, target, count(*) AS shared, any_value(na) AS na, any_value(nb) AS nb FROM a JOIN b USING (k) WHERE query <> target GROUP BY 1, 2), x AS (SELECT *, shared / (na + nb - shared) AS identity FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, target) AS rank FROM x WHERE identity >= 0.1) SELECT query, target, shared, round(identity, 9) AS identity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 300""")
def q_homology_hits(t: Tables) -> DataFrame:
    """Hits of a stated set of query sequences, entities 1 of entries ending in 0, among all sequences."""
    e = t.entities.select(F.concat_ws("_", "pdb_id", "entity_id").alias("id"), "seq_can")
    return link.kmer_hits(e.where(F.col("id").like("%0_1")), e, "id", "seq_can").withColumn("identity", F.round("identity", 9))


@registry.add("""
    WITH e AS (SELECT unnest(uniprot_ids) AS accession, sha1(seq_can) AS via, pdb_id FROM entities WHERE seq_can IS NOT NULL), m AS (SELECT DISTINCT sha1(seq_can) AS via, pdb_id FROM entities WHERE seq_can IS NOT NULL), c AS (SELECT DISTINCT upper(trim(pdb_id)) AS pdb_id, cluster_30 FROM conditions WHERE cluster_30 IS NOT NULL)
    SELECT accession, min(cluster_30) AS cluster FROM (SELECT DISTINCT accession, via FROM e) x JOIN m USING (via) JOIN c ON c.pdb_id = m.pdb_id GROUP BY 1""")
def q_accession_clusters(t: Tables) -> DataFrame:
    e = t.entities.where("seq_can IS NOT NULL").withColumn("via", F.sha1("seq_can"))
    clusters = t.conditions.where("cluster_30 IS NOT NULL").select(F.upper(F.trim("pdb_id")).alias("middle"), F.col("cluster_30").alias("cluster"))
    return joins.bridge(e.select(F.explode("uniprot_ids").alias("accession"), "via"), e.select("via", F.col("pdb_id").alias("middle")), clusters, "accession", "via", "cluster")


@registry.add("SELECT cluster_30, string_agg(DISTINCT method, ',' ORDER BY method) AS labels FROM conditions WHERE cluster_30 IS NOT NULL AND method IS NOT NULL GROUP BY 1")
def q_cluster_labels(t: Tables) -> DataFrame:
    return evaluation.label_sets(t.conditions, "cluster_30", "method").select("cluster_30", F.array_join("labels", ",").alias("labels"))


@registry.add("""
    WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier) SELECT c_custkey, s_suppkey FROM c FULL JOIN s USING (i)""")
def q_beside(t: Tables) -> DataFrame:
    return joins.beside(t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), [F.asc("c_custkey")], [F.desc("s_suppkey")])


@registry.add("""
    WITH f AS (SELECT record_id, name_raw, min_by(component_id, component_index) AS v FROM components WHERE name_raw IS NOT NULL GROUP BY 1, 2) SELECT record_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, string_agg(name_raw, '|' ORDER BY name_raw) AS names FROM f GROUP BY 1""".replace("min_by(component_id, component_index)", "min_by(component_id, component_index::BIGINT * 1000000000 + component_id)"))
def q_first_by_name(t: Tables) -> DataFrame:
    k = t.components.withColumn("o", F.struct("component_index", "component_id"))
    m = joins.first_by_name(k, ["record_id"], "name_raw", "o", "component_id")
    return m.select("record_id", F.size("by_name").cast("bigint").alias("n"), F.aggregate(F.map_values("by_name"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_join(F.array_sort(F.map_keys("by_name")), "|").alias("names"))


@registry.add("SELECT record_id FROM conditions WHERE discard_reason IS NULL")
def q_where_if(t: Tables) -> DataFrame:
    return joins.where_if(joins.where_if(t.conditions, F.col("discard_reason").isNull(), True), F.lit(False), False).select("record_id")


_PAGES = "l AS (SELECT screen, CASE WHEN substr(well, 1, 1) IN ('A', 'B') THEN 'p1' ELSE 'p2' END AS page, TRY_CAST(substr(well, 2, 3) AS INTEGER) AS number, condition_text AS text FROM screen_wells)"


@registry.add(f"""
    WITH {_PAGES}, w AS (SELECT * FROM l WHERE length(text) >= 8), c AS (SELECT screen, page, row_number() OVER (PARTITION BY screen ORDER BY count(DISTINCT number) DESC, page) AS o FROM w GROUP BY 1, 2),
    r AS (SELECT w.*, row_number() OVER (PARTITION BY screen, number ORDER BY o, text) AS i FROM w JOIN c USING (screen, page)) SELECT screen, number, text, page FROM r WHERE i = 1""")
def q_filled_pages(t: Tables) -> DataFrame:
    page = F.when(F.substring("well", 1, 1).isin("A", "B"), "p1").otherwise("p2")
    lines = t.screen_wells.select("screen", page.alias("page"), F.substring("well", 2, 3).try_cast("int").alias("number"), F.col("condition_text").alias("text"))
    return screens.filled_pages(lines, "screen", "page", "number", "text")


@registry.add("""
    SELECT pdb_id, entity_id, len(regexp_extract_all(seq_can, '.')) AS n FROM entities WHERE seq_can IS NOT NULL""".replace("len(regexp_extract_all(seq_can, '.')) AS n", "CAST(coalesce(list_max(list_transform(regexp_extract_all(upper(seq_can), '" + "|".join(f"{c}+" for c in "ACDEFGHIKLMNPQRSTVWYBXZUOJ") + "'), lambda x: length(x))), 0) AS INTEGER) AS longest"))
def q_longest_runs(t: Tables) -> DataFrame:
    return t.entities.where("seq_can IS NOT NULL").select("pdb_id", "entity_id", S.longest_run(F.upper("seq_can")).cast("int").alias("longest"))


@registry.add("""
    WITH k AS (SELECT canonical_id, lower(trim(unnest(list_concat([display_name], coalesce(aliases, []))))) AS alias, chem_class FROM reagents), c AS (SELECT alias, min(chem_class) AS chem_class FROM k GROUP BY 1),
    n AS (SELECT lower(trim(name_raw)) AS name, count(*) AS n_uses FROM components WHERE trim(name_raw) <> '' GROUP BY 1) SELECT coalesce(c.chem_class, 'unresolved') AS chem_class, count(*) AS n_names, CAST(sum(n_uses) AS BIGINT) AS n_uses FROM n LEFT JOIN c ON c.alias = n.name GROUP BY 1""")
def q_class_mass(t: Tables) -> DataFrame:
    names = t.components.where("trim(name_raw) <> ''").groupBy(F.lower(F.trim("name_raw")).alias("norm_name")).agg(F.count(F.lit(1)).alias("n_uses"))
    each = t.reagents.select("chem_class", F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    return lexicon.coverage_by_class(names, each.groupBy(F.lower(F.trim("a")).alias("norm_name")).agg(F.min("chem_class").alias("chem_class")))


@registry.add("""
    WITH t AS (SELECT doc_id, n_chars, ntile(3) OVER (ORDER BY n_chars, doc_id) AS band FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256('s' || doc_id), doc_id) AS i FROM t),
    a AS (SELECT doc_id, 0 AS turn FROM r WHERE i <= 6), b AS (SELECT doc_id, 1 AS turn FROM t WHERE doc_id NOT IN (SELECT doc_id FROM a)) SELECT doc_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY turn, sha256('s' || doc_id), doc_id LIMIT 20""")
def q_topped_up_sample(t: Tables) -> DataFrame:
    return sampling.topped_up_sample(t.documents.where("n_chars IS NOT NULL").select("doc_id", "n_chars"), "doc_id", "n_chars", 3, 20).select("doc_id")


@registry.add("""
    SELECT c.record_id, c.source, s.n_of_source, w.n_of_split FROM conditions c LEFT JOIN (SELECT source, count(*) AS n_of_source FROM conditions GROUP BY 1) s ON s.source = c.source LEFT JOIN (SELECT split, count(*) AS n_of_split FROM conditions GROUP BY 1) w ON w.split = c.split""")
def q_flat_records(t: Tables) -> DataFrame:
    c = t.conditions
    dims = [(c.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_of_{k}")), [k]) for k in ("source", "split")]
    return release.flat_records(c.select("record_id", "source", "split"), dims).select("record_id", "source", "n_of_source", "n_of_split")
