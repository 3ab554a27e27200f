"""Queries of parsing, lexicon, classification, screens, corpora, sequences and release, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.functions import quantity as Q
from brineflow.functions import stats as S
from brineflow.functions import text as X
from brineflow.operators import assign, corpus, lexicon, link, parse, release, screens, sequence
from brineflow.operators.joins import heavy_light_join
from brineflow.plans.registry import Registry, Tables
from brineflow.runtime.session import written
from brineflow.streaming import incremental

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles


# parsing: the grammar needs look-around and state, so these have no SQL and are tested on fixtures


_PART = ["clause_index", "clause", "name_raw", "name_canonical", "role", "concentration", "unit", "unit_inferred", "concentration_is_range", "range_low", "range_high", "cryo_evidence", "non_component_reason", "match_step"]


@registry.add()
def q_parse_components(t: Tables) -> DataFrame:
    c = t.conditions.select("record_id", "raw_details")
    _, components = parse.parse(c, t.reagents)
    return parse.of_records(c, components.select("text", *_PART), ["record_id"])


@registry.add()
def q_parse_records(t: Tables) -> DataFrame:
    records, _ = parse.parse(t.conditions.select("record_id", "raw_details", "temperature_k", "ph_reported"), t.reagents)
    fixed = Q.reconcile_temperature(Q.to_kelvin(F.col("temperature_k")), F.col("parsed_temperature_text"))
    return records.select(
        "record_id", "parsed_n_components", "parsed_n_components_identified", "parsed_parse_confidence", "parsed_discard_reason", F.coalesce("parsed_ph_text_value", "ph_reported").alias("ph"), "parsed_ph_source",
        (F.abs(F.col("parsed_ph_text_value") - F.col("ph_reported")) > 0.5).alias("ph_conflicts"), fixed["temperature_k"].alias("temperature_k"), fixed["source"].alias("temperature_source"),
        F.array_join("parsed_flags", ",").alias("flags"), "parsed_drop_ratio",
    )


@registry.add()
def q_class_distribution(t: Tables) -> DataFrame:
    """Records by class or by what keeps them from having one; records without components have no precipitant."""
    c = t.conditions.select("record_id", "raw_details")
    _, components = parse.parse(c, t.reagents)
    of_text = assign.classify(components, ["text"], "clause_index").select(F.col("text").alias("raw_details"), F.coalesce("class", "reason").alias("class"))
    each = heavy_light_join(c, of_text, "raw_details").select(F.coalesce("class", F.lit("no_precipitant")).alias("class"))
    return each.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class")


@registry.add()
def q_parse_wells(t: Tables) -> DataFrame:
    records, _ = parse.parse(t.screen_wells, t.reagents, "condition_text")
    return records.select("screen", "well", "parsed_n_components", "parsed_n_components_identified", "parsed_ph_text_value")


@registry.add()
def q_screen_match(t: Tables) -> DataFrame:
    """The well of every distinct recipe, by its names, amounts and pH."""
    parsed, a = parse.parse(t.conditions.select("raw_details").distinct(), t.reagents)
    wells, b = parse.parse(t.screen_wells, t.reagents, "condition_text")
    ph = parsed.select(F.col("raw_details").alias("text"), F.col("parsed_ph_text_value").alias("ph"))
    named = wells.select(F.concat_ws(" ", "screen", "well").alias("well_id"), F.col("condition_text").alias("text"), F.col("parsed_ph_text_value").alias("ph"))
    return assign.match_screens(assign.fingerprints(a, ["text"]).join(ph, "text"), "text", named.join(assign.fingerprints(b, ["text"]), "text"))


@registry.add("SELECT screen, well, condition_text, CASE WHEN trim(condition_text) = '' THEN 'empty' ELSE NULL END AS empty_kind, regexp_matches(lower(condition_text), '^[0-9.]+ ?k$') AS is_temperature FROM screen_wells")
def q_well_kinds(t: Tables) -> DataFrame:
    kind = X.clause_kind(X.normalise(F.col("condition_text")))
    return t.screen_wells.select("screen", "well", "condition_text", F.when(kind == "empty", kind).alias("empty_kind"), (kind == "temperature").alias("is_temperature"))


@registry.add()
def q_amounts_in_names(t: Tables) -> DataFrame:
    body = X.normalise(F.col("name_raw"))
    k = t.components.where("name_raw IS NOT NULL").select("component_id", "name_raw", Q.extract_amount(body).alias("a"), X.strip_amount(body).alias("name"))
    return k.select("component_id", "name_raw", "name", "a.value", "a.unit", "a.unit_explicit", "a.is_range", "a.low", "a.high", Q.peg_weight(F.col("name")).alias("peg_mw"))


@registry.add()
def q_name_verdicts(t: Tables) -> DataFrame:
    name = X.tidy_name(X.normalise(F.col("name_raw")))
    k = t.components.where("name_canonical IS NULL AND name_raw IS NOT NULL").select(name.alias("name"), F.col("concentration").isNotNull().alias("has_amount")).distinct()
    return k.select("name", "has_amount", X.non_component_reason(F.col("name"), F.col("has_amount")).alias("reason"), X.guess_class(F.col("name")).alias("guess"), X.looks_like_chemistry(F.col("name")).alias("chemistry"), X.expand_formula(F.col("name")).alias("formula"), X.is_family_name(F.col("name")).alias("family"))


# lexicon


@registry.add("""
    WITH a AS (SELECT canonical_id, unnest(list_concat([display_name, lower(replace(canonical_id, '_', ' '))], coalesce(aliases, []))) AS alias FROM reagents)
    SELECT canonical_id, count(DISTINCT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g')) AS n_flat FROM a GROUP BY canonical_id""")
def q_spellings(t: Tables) -> DataFrame:
    all_names = F.concat(F.array("display_name", F.lower(F.translate("canonical_id", "_", " "))), F.coalesce("aliases", F.array().cast("array<string>")))
    return t.reagents.select("canonical_id", F.explode(all_names).alias("alias")).groupBy("canonical_id").agg(F.countDistinct(X.flat_alnum(F.col("alias"))).alias("n_flat"))


@registry.add("""
    SELECT 'weight' AS rule, canonical_id FROM reagents WHERE (chem_class = 'peg') <> (peg_mw IS NOT NULL) UNION ALL SELECT 'id_shape', canonical_id FROM reagents WHERE NOT regexp_full_match(canonical_id, '[A-Z0-9]+(_[A-Z0-9]+)*')
    UNION ALL SELECT 'repeated_id', canonical_id FROM reagents GROUP BY canonical_id HAVING count(*) > 1""")
def q_lexicon_violations(t: Tables) -> DataFrame:
    """The rules the SQL states; `q_lexicon_violations_all` has all four."""
    return lexicon.violations(t.reagents).where("rule <> 'alias_owned_twice'")


@registry.add()
def q_lexicon_violations_all(t: Tables) -> DataFrame:
    """(rule, canonical_ids) of all four rules, also of those that nothing breaks."""
    rules = t.reagents.sparkSession.createDataFrame([(r,) for r in ("id_shape", "repeated_id", "weight", "alias_owned_twice")], "rule string")
    broken = lexicon.violations(t.reagents).groupBy("rule").agg(F.array_sort(F.collect_list("canonical_id")).alias("canonical_ids"))
    return rules.join(broken, "rule", "left").select("rule", F.coalesce("canonical_ids", F.array().cast("array<string>")).alias("canonical_ids"))


@registry.add()
def q_lookup_cascade(t: Tables) -> DataFrame:
    names = t.components.where("name_raw IS NOT NULL").select(X.tidy_name(X.strip_amount(X.normalise(F.col("name_raw")))).alias("norm_name")).groupBy("norm_name").agg(F.count(F.lit(1)).alias("n_uses"))
    return lexicon.lookup_cascade(names, "norm_name", lexicon.local_index(t.reagents), ["canonical_id", "chem_class"])


@registry.add()
def q_coverage_by_class(t: Tables) -> DataFrame:
    return lexicon.coverage_by_class(lexicon.candidates(t.components, "name_raw", "pdb_id"), lexicon.alias_index(t.reagents))


@registry.add("""
    WITH p AS (SELECT trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g')) AS key, min(display_name) AS name, CAST(sum(1) AS BIGINT) AS w FROM reagents WHERE display_name NOT LIKE '%hydrate%' GROUP BY 1),
    c AS (SELECT trim(regexp_replace(lower(name_canonical), '[^a-z0-9]+', ' ', 'g')) AS key, min(name_canonical) AS name, CAST(sum(1) AS BIGINT) AS w FROM components WHERE name_canonical IS NOT NULL AND name_canonical NOT LIKE '%hydrate%' GROUP BY 1)
    SELECT coalesce(p.key, c.key) AS key, coalesce(p.name, c.name) AS name, greatest(coalesce(p.w, 0), coalesce(c.w, 0)) AS weight, p.key IS NOT NULL AS is_proposal FROM p FULL OUTER JOIN c ON p.key = c.key""")
def q_merged_queue(t: Tables) -> DataFrame:
    """Names on which the SQL agrees; `q_merged_queue_all` has all of them."""
    plain = lambda df, c: df.where(~F.col(c).contains("hydrate"))
    return _merged_queue(plain(t.reagents, "display_name"), plain(t.components, "name_canonical"))


@registry.add()
def q_merged_queue_all(t: Tables) -> DataFrame:
    return _merged_queue(t.reagents, t.components)


def _merged_queue(reagents: DataFrame, components: DataFrame) -> DataFrame:
    weighed = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).alias("name"), F.lit(1).cast("bigint").alias("w"))
    return lexicon.merged_queue(weighed(reagents, "display_name"), weighed(components, "name_canonical"), "name", "w")


@registry.add("""
    SELECT r.canonical_id AS id, CASE WHEN r.peg_mw > 3000 THEN 'keep' ELSE r.default_unit END AS recommended, a.chosen, coalesce(a.chosen, CASE WHEN r.peg_mw > 3000 THEN 'keep' ELSE r.default_unit END) AS decision,
           CASE WHEN a.chosen IS NULL THEN 'default' WHEN a.chosen = CASE WHEN r.peg_mw > 3000 THEN 'keep' ELSE r.default_unit END THEN 'confirmed' ELSE 'changed' END AS outcome
    FROM reagents r LEFT JOIN (SELECT canonical_id, chem_class AS chosen FROM reagents WHERE chem_class IN ('salt', 'buffer')) a USING (canonical_id)""")
def q_apply_answers(t: Tables) -> DataFrame:
    q = t.reagents.select(F.col("canonical_id").alias("id"), F.when(F.col("peg_mw") > 3000, "keep").otherwise(F.col("default_unit")).alias("recommended"))
    a = t.reagents.where(F.col("chem_class").isin("salt", "buffer")).select(F.col("canonical_id").alias("id"), F.col("chem_class").alias("chosen"))
    return lexicon.apply_answers(q, a, "id", "recommended")


@registry.add("SELECT DISTINCT name_canonical FROM components WHERE name_canonical IS NOT NULL AND name_canonical NOT IN (SELECT canonical_id FROM reagents)")
def q_unanswered(t: Tables) -> DataFrame:
    names = t.components.where("name_canonical IS NOT NULL").select("name_canonical").distinct()
    return lexicon.unanswered(names, t.reagents.select(F.col("canonical_id").alias("name_canonical")), "name_canonical")


@registry.add()
def q_close_matches(t: Tables) -> DataFrame:
    names = t.components.where("name_canonical IS NULL").select(X.match_key(F.col("name_raw")).alias("name")).where("name <> ''")
    known = t.reagents.select(X.match_key(F.col("display_name")).alias("known"))
    found = corpus.close_matches(names, "name", known, "known", 0.82, 3)
    return found.withColumn("safe", X.compatible(F.col("name"), F.col("known")))


# classification and features


@registry.add("""
    WITH k AS (SELECT record_id, component_index, component_id, coalesce(role = 'not_a_component' OR cryo_evidence = 'explicit' OR role IN ('protein_buffer', 'soak'), false) AS skip, chem_class, name_canonical, concentration, peg_mw FROM components),
    m AS (SELECT *, CASE WHEN NOT skip THEN CASE WHEN chem_class = 'premix' THEN 'mixture' WHEN name_canonical IS NULL THEN 'unidentified_reagent' WHEN chem_class IN ('peg', 'organic', 'polyol', 'salt') AND concentration IS NULL THEN 'no_amount' END END AS b,
                 CASE WHEN NOT skip THEN CASE WHEN chem_class IN ('organic', 'polyol') OR (chem_class = 'peg' AND peg_mw <= 600) THEN 'organic' WHEN chem_class = 'peg' THEN 'peg' WHEN chem_class = 'salt' THEN 'salt' END END AS f FROM k),
    g AS (SELECT record_id, min_by(b, component_id) FILTER (b IS NOT NULL) AS reason, coalesce(string_agg(DISTINCT f, '+' ORDER BY f), '') AS class FROM m GROUP BY record_id)
    SELECT record_id, CASE WHEN reason IS NULL AND class <> '' THEN class END AS class, CASE WHEN reason IS NOT NULL THEN reason WHEN class = '' THEN 'no_precipitant' END AS reason FROM g""")
def q_classify(t: Tables) -> DataFrame:
    return assign.classify(t.components, ["record_id"], "component_id")


@registry.add("""
    WITH p AS (SELECT a.canonical_id AS premix, b.canonical_id AS part, b.chem_class, b.peg_mw FROM reagents a JOIN reagents b ON substr(a.canonical_id, 1, 1) = substr(b.canonical_id, 1, 1) WHERE a.chem_class = 'detergent' AND b.chem_class <> 'detergent'),
    x AS (SELECT k.component_id, k.record_id, k.role, k.cryo_evidence, k.concentration, coalesce(p.part, k.name_canonical) AS name_canonical, CASE WHEN p.part IS NULL THEN k.chem_class ELSE p.chem_class END AS chem_class, CASE WHEN p.part IS NULL THEN k.peg_mw ELSE p.peg_mw END AS peg_mw, p.premix FROM components k LEFT JOIN p ON k.name_canonical = p.premix)
    SELECT record_id, count(*) AS n, count(premix) AS n_expanded, string_agg(DISTINCT CASE WHEN chem_class IN ('organic', 'polyol') OR (chem_class = 'peg' AND peg_mw <= 600) THEN 'organic' WHEN chem_class IN ('peg', 'salt') THEN chem_class END, '+' ORDER BY CASE WHEN chem_class IN ('organic', 'polyol') OR (chem_class = 'peg' AND peg_mw <= 600) THEN 'organic' WHEN chem_class IN ('peg', 'salt') THEN chem_class END) AS families
    FROM x GROUP BY record_id""")
def q_premix_families(t: Tables) -> DataFrame:
    """Families of the records once detergents are taken for premixes of what shares their first letter; the tables hold no premix of their own."""
    a = t.reagents.where("chem_class = 'detergent'").select(F.col("canonical_id").alias("premix"), F.substring("canonical_id", 1, 1).alias("c"))
    b = t.reagents.where("chem_class <> 'detergent'").select(F.col("canonical_id").alias("part"), F.substring("canonical_id", 1, 1).alias("c"))
    x = assign.expand_premixes(t.components, a.join(b, "c").drop("c"), t.reagents)
    small = F.col("chem_class").isin("organic", "polyol") | ((F.col("chem_class") == "peg") & (F.col("peg_mw") <= 600))
    family = F.when(small, "organic").when(F.col("chem_class").isin("peg", "salt"), F.col("chem_class"))
    g = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count("expanded_from").alias("n_expanded"), F.array_join(F.array_sort(F.collect_set(family)), "+").alias("families"))
    return g.withColumn("families", F.nullif("families", F.lit("")))


_FAMILY = """CASE WHEN coalesce(cryo_evidence <> 'explicit', true) AND NOT coalesce(role IN ('protein_buffer', 'soak', 'not_a_component'), false) THEN
    CASE WHEN (chem_class IN ('organic', 'polyol') OR (chem_class = 'peg' AND peg_mw <= {w})) AND pct >= 4 THEN 'organic' WHEN chem_class = 'peg' AND pct >= 4 THEN 'peg' WHEN chem_class = 'salt' AND mol >= {m} THEN 'salt'
         WHEN chem_class = 'buffer' AND hofmeister_rank IS NOT NULL AND mol >= {m} THEN 'salt' END END"""
_SCALED = """SELECT *, CASE WHEN unit LIKE 'percent%' THEN concentration END AS pct, concentration * CASE WHEN unit = 'molar' THEN 1.0 WHEN unit = 'millimolar' THEN 1e-3 WHEN unit = 'micromolar' THEN 1e-6 WHEN unit = 'nanomolar' THEN 1e-9 END AS mol FROM components"""


@registry.add(f"""
    WITH k AS ({_SCALED}), f AS (SELECT record_id, {_FAMILY.format(w=600, m=0.2)} AS f FROM k)
    SELECT record_id, CASE WHEN count(f) = 0 THEN 'Unassigned' ELSE string_agg(DISTINCT f, '+' ORDER BY f) END AS l1_class, count(DISTINCT f) AS n_families FROM f GROUP BY record_id""")
def q_family_classes(t: Tables) -> DataFrame:
    return assign.classes(t.components, ["record_id"])


@registry.add("WITH k AS (" + _SCALED + ") " + " UNION ALL ".join(
    f"SELECT {w}::DOUBLE AS peg_max_mw, {m}::DOUBLE AS salt_min_molar, l1_class, count(*) AS n FROM (SELECT record_id, CASE WHEN count(f) = 0 THEN 'Unassigned' ELSE string_agg(DISTINCT f, '+' ORDER BY f) END AS l1_class FROM (SELECT record_id, {_FAMILY.format(w=w, m=m)} AS f FROM k) GROUP BY record_id) GROUP BY l1_class"
    for w in (400, 600, 1000) for m in (0.1, 0.2, 0.5)))
def q_threshold_sweep(t: Tables) -> DataFrame:
    return assign.threshold_sweep(t.components, ["record_id"], [400, 600, 1000], [0.1, 0.2, 0.5])


def _features(t: Tables) -> DataFrame:
    f = assign.features(t.components, ["record_id"]).drop("ph").join(t.conditions.select("record_id", "ph"), "record_id")
    return f.withColumns({a: F.round(a, 9) for a in assign.AXES})


_AXES_SQL = f"""
    k AS ({_SCALED}), c AS (SELECT *, chem_class = 'peg' AND coalesce(peg_mw, 601) > 600 AS big, chem_class IN ('organic', 'polyol') OR (chem_class = 'peg' AND peg_mw <= 600) AS org,
        mol > 0 AND (chem_class = 'salt' OR (chem_class = 'buffer' AND hofmeister_rank IS NOT NULL AND mol >= 0.2)) AS slt FROM k WHERE coalesce(cryo_evidence <> 'explicit', true) AND NOT coalesce(role IN ('protein_buffer', 'soak', 'not_a_component'), false)),
    f0 AS (SELECT record_id, sum(CASE WHEN big AND peg_mw IS NOT NULL THEN coalesce(pct, 1.0) * log10(peg_mw) END) / sum(CASE WHEN big AND peg_mw IS NOT NULL THEN coalesce(pct, 1.0) END) AS peg_log_mw, sum(CASE WHEN big THEN pct END) AS peg_percent,
        sum(CASE WHEN slt AND hofmeister_rank IS NOT NULL THEN mol * hofmeister_rank END) / sum(CASE WHEN slt AND hofmeister_rank IS NOT NULL THEN mol END) AS salt_rank, log10(sum(CASE WHEN slt THEN mol END)) AS salt_log_molar, sum(CASE WHEN org THEN pct END) AS organic_percent FROM c GROUP BY record_id),
    f AS (SELECT f0.record_id, round(peg_log_mw, 9) AS peg_log_mw, round(peg_percent, 9) AS peg_percent, round(salt_rank, 9) AS salt_rank, round(salt_log_molar, 9) AS salt_log_molar, round(organic_percent, 9) AS organic_percent, round(ph, 9) AS ph FROM f0 JOIN conditions USING (record_id))"""


@registry.add(f"WITH {_AXES_SQL} SELECT record_id, round(peg_log_mw, 6) AS peg_log_mw, round(peg_percent, 6) AS peg_percent, round(salt_rank, 6) AS salt_rank, round(salt_log_molar, 6) AS salt_log_molar, round(organic_percent, 6) AS organic_percent, ph FROM f")
def q_featurise(t: Tables) -> DataFrame:
    return _features(t).withColumns({a: F.round(a, 6) for a in assign.AXES[:-1]})


_DIST = "sqrt((" + " + ".join(f"CASE WHEN {{a}}.{x} IS NOT NULL AND {{b}}.{x} IS NOT NULL THEN {assign.WEIGHTS[x]} * power(({{a}}.{x} - {{b}}.{x}) / {assign.SCALES[x]}, 2) ELSE 0.0 END" for x in assign.AXES) + ") / (" + " + ".join(f"CASE WHEN {{a}}.{x} IS NOT NULL AND {{b}}.{x} IS NOT NULL THEN {assign.WEIGHTS[x]} ELSE 0.0 END" for x in assign.AXES) + "))"
_SHARE = "(" + " OR ".join(f"({{a}}.{x} IS NOT NULL AND {{b}}.{x} IS NOT NULL)" for x in assign.AXES[:-1]) + ")"
_GROUPS_SQL = ", ".join(f"round(avg({x}), 9) AS {x}" for x in assign.AXES)


def _groups(t: Tables) -> DataFrame:
    """Groups for the queries: centroids of the features by source and kind of method, a bounded dimension."""
    f = _features(t).join(t.conditions.select("record_id", "source", "method"), "record_id")
    g = assign.centroids(f, ["source", "method"]).withColumns({a: F.round(a, 9) for a in assign.AXES})
    return g.withColumn("group_id", F.concat_ws(":", "source", F.coalesce("method", F.lit("-"))))


@registry.add(f"WITH {_AXES_SQL} SELECT source || ':' || coalesce(method, '-') AS group_id, {_GROUPS_SQL.replace(', 9)', ', 6)')}, count(*) AS n_records FROM (SELECT f.*, c.source, c.method FROM f JOIN conditions c USING (record_id)) GROUP BY source, method")
def q_centroids(t: Tables) -> DataFrame:
    return _groups(t).select("group_id", *[F.round(a, 6).alias(a) for a in assign.AXES], "n_records")


@registry.add(f"""
    WITH {_AXES_SQL}, r AS (SELECT f.*, c.source FROM f JOIN conditions c USING (record_id)), g AS (SELECT c.source, c.source || ':' || coalesce(c.method, '-') AS group_id, {_GROUPS_SQL} FROM f JOIN (SELECT record_id, source, method FROM conditions) c USING (record_id) GROUP BY c.source, c.method),
    d AS (SELECT r.record_id, g.group_id, {_DIST.format(a="r", b="g")} AS d FROM r JOIN g ON r.source = g.source WHERE {_SHARE.format(a="r", b="g")})
    SELECT record_id, round(min(d), 6) AS distance FROM d GROUP BY record_id""")
def q_nearest_group(t: Tables) -> DataFrame:
    r = _features(t).join(t.conditions.select("record_id", "source"), "record_id")
    return assign.nearest(r, "record_id", _groups(t), "source").select("record_id", F.round("distance", 6).alias("distance"))


@registry.add(f"""
    WITH {_AXES_SQL}, r AS (SELECT f.*, c.source, c.method FROM f JOIN conditions c USING (record_id)), g2 AS (SELECT source, {', '.join(f'avg({x}) AS {x}' for x in assign.AXES)} FROM r GROUP BY source),
    g3 AS (SELECT source, source || ':' || coalesce(method, '-') AS group_id, {_GROUPS_SQL} FROM r GROUP BY source, method),
    a AS (SELECT r.record_id, g.source AS parent, {_DIST.format(a="r", b="g")} AS d2 FROM r JOIN g2 g ON r.source = g.source WHERE {_SHARE.format(a="r", b="g")}),
    t AS (SELECT r.record_id, g.group_id, {_DIST.format(a="r", b="g")} AS d3 FROM r JOIN a ON a.record_id = r.record_id JOIN g3 g ON g.source = a.parent WHERE {_SHARE.format(a="r", b="g")}),
    b AS (SELECT record_id, arg_min(group_id, row(d3, group_id)) AS child, min(d3) AS d3 FROM t GROUP BY record_id),
    o AS (SELECT r.record_id, CASE WHEN d3 < 0.5 THEN 3 WHEN d2 < 1.0 THEN 2 END AS level, child, parent, d2, d3 FROM r LEFT JOIN a ON a.record_id = r.record_id LEFT JOIN b ON b.record_id = r.record_id),
    d AS (SELECT record_id, level, CASE level WHEN 3 THEN child WHEN 2 THEN parent END AS group_id, CASE level WHEN 3 THEN d3 WHEN 2 THEN d2 END AS distance FROM o)
    SELECT record_id, level, group_id, round(distance, 6) AS distance, CASE WHEN distance <= 0.25 THEN 'exact' WHEN distance <= 0.5 THEN 'near' WHEN distance <= 1.0 THEN 'loose' WHEN distance IS NOT NULL THEN 'far' END AS band FROM d""")
def q_assign_groups(t: Tables) -> DataFrame:
    f = _features(t).join(t.conditions.select("record_id", "source", "method"), "record_id")
    level2 = assign.centroids(f, ["source"]).withColumn("group_id", F.col("source"))
    level3 = _groups(t).withColumn("parent_id", F.col("source")).drop("source", "method")
    return assign.assign_groups(f.drop("method"), "record_id", level2, level3, "source").withColumn("distance", F.round("distance", 6))


@registry.add(f"""
    WITH {_AXES_SQL}, g AS (SELECT c.source, c.source || ':' || coalesce(c.method, '-') AS group_id, {_GROUPS_SQL} FROM f JOIN (SELECT record_id, source, method FROM conditions) c USING (record_id) GROUP BY c.source, c.method),
    d AS (SELECT x.group_id AS a, y.group_id AS b, {_DIST.format(a="x", b="y")} AS d FROM g x JOIN g y ON x.source = y.source AND x.group_id < y.group_id WHERE {_SHARE.format(a="x", b="y")}) SELECT a, b, round(d, 6) AS distance FROM d WHERE d < 0.25""")
def q_merge_candidates(t: Tables) -> DataFrame:
    return assign.merge_candidates(_groups(t), "source").withColumn("distance", F.round("distance", 6))


@registry.add(f"""
    WITH {_AXES_SQL}, l AS (SELECT concat_ws(' · ', CASE WHEN peg_log_mw IS NULL THEN NULL WHEN power(10.0, peg_log_mw) <= 600 THEN 'PEG low' WHEN power(10.0, peg_log_mw) <= 3000.0001 THEN 'PEG mid' WHEN power(10.0, peg_log_mw) <= 6000.0001 THEN 'PEG high' ELSE 'PEG very high' END,
        CASE WHEN salt_log_molar IS NOT NULL THEN 'salt' END, CASE WHEN organic_percent IS NOT NULL THEN 'organic' END) AS cell FROM f)
    SELECT cell, count(*) AS n FROM l GROUP BY cell""")
def q_grid_cells(t: Tables) -> DataFrame:
    f = _features(t).withColumn("peg_log_mw", F.col("peg_log_mw") - 1e-8)
    return f.select(assign.cell_label(2).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@registry.add("""
    WITH k AS (SELECT record_id, coalesce(name_canonical, '?' || substr(lower(name_raw), 1, 24)) AS name FROM components WHERE coalesce(cryo_evidence <> 'explicit', true) AND NOT coalesce(role = 'not_a_component', false)),
    f AS (SELECT record_id, coalesce(string_agg(DISTINCT name, '|' ORDER BY name), '') AS fp FROM k GROUP BY record_id) SELECT sha256(fp) AS digest, count(*) AS n_records FROM f GROUP BY fp HAVING count(*) > 1""")
def q_fingerprints(t: Tables) -> DataFrame:
    f = assign.fingerprints(t.components, ["record_id"]).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
    return f.select(F.sha2("fingerprint", 256).alias("digest"), "n_records")


# screens


@registry.add("""
    WITH w AS (SELECT screen, CAST(row_number() OVER (PARTITION BY screen ORDER BY well) AS INTEGER) + CASE WHEN screen LIKE '%A' THEN 1 ELSE 0 END AS number FROM screen_wells)
    SELECT screen, count(*) AS n, min(number) = 1 AND max(number) = count(*) AND count(DISTINCT number) = count(*) AS complete FROM w GROUP BY screen""")
def q_complete_numbering(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("screen").orderBy("well")) + F.when(F.col("screen").endswith("A"), 1).otherwise(0)
    return screens.complete_numbering(t.screen_wells.withColumn("number", number), "screen", "number")


@registry.add("SELECT screen, count(DISTINCT substr(well, 1, 1)) AS n_rows, count(DISTINCT TRY_CAST(substr(well, 2, 3) AS INTEGER)) AS n_columns, count(DISTINCT well) AS n, count(DISTINCT substr(well, 1, 1)) * count(DISTINCT TRY_CAST(substr(well, 2, 3) AS INTEGER)) = count(DISTINCT well) AS rectangular FROM screen_wells GROUP BY screen")
def q_rectangular_plates(t: Tables) -> DataFrame:
    return screens.rectangular(t.screen_wells, "screen", "well")


@registry.add("""
    WITH w AS (SELECT screen, regexp_matches(condition_text, '[0-9]\\s*(%|m\\b|mm\\b|M\\b|mM\\b|mmol|mol)') AS s FROM screen_wells) SELECT screen, count(*) AS n, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 6) AS stated, count(*) >= 24 AND avg(CASE WHEN s THEN 1.0 ELSE 0.0 END) >= 0.5 AS accepted FROM w GROUP BY screen""")
def q_plausible_screens(t: Tables) -> DataFrame:
    return screens.plausible_screens(t.screen_wells, "screen", "condition_text").withColumn("stated", F.round("stated", 6))


@registry.add("""
    SELECT screen, n, declared, CASE WHEN declared IS NULL THEN 'no_witness' WHEN n < declared THEN 'rejected' WHEN n > declared THEN 'excess' ELSE 'agrees' END AS verdict
    FROM (SELECT screen, count(*) AS n, CASE WHEN screen LIKE '%A' THEN 97 WHEN screen LIKE '%B' THEN NULL ELSE 96 END::BIGINT AS declared FROM screen_wells GROUP BY screen)""")
def q_witness_counts(t: Tables) -> DataFrame:
    declared = F.when(F.col("screen").endswith("A"), 97).when(F.col("screen").endswith("B"), None).otherwise(96).cast("bigint")
    return screens.witness(t.screen_wells.groupBy("screen").agg(F.count(F.lit(1)).alias("n")).withColumn("declared", declared), "n", "declared")


@registry.add("SELECT screen, well, condition_text AS text FROM screen_wells")
def q_best_reading(t: Tables) -> DataFrame:
    w = t.screen_wells.select("screen", "well", F.col("condition_text").alias("text"), F.lit(1).alias("priority"))
    blank = w.select("screen", "well", F.lit("unreadable").alias("text"), F.lit(0).alias("priority"))
    return screens.best_reading(w.unionByName(blank), ["screen", "well"], "text", "priority").select("screen", "well", "text")


# corpora


@registry.add("""
    SELECT record_id, count(*) AS n, sha256(string_agg(component_index || ':' || coalesce(role, '') || ':' || coalesce(name_canonical, '') || ':' || coalesce(unit, ''), ';' ORDER BY component_index, role, name_canonical, unit)) AS digest
    FROM components WHERE name_canonical IS NOT NULL AND role IS NOT NULL GROUP BY record_id""")
def q_target_answers(t: Tables) -> DataFrame:
    k = t.components.where("name_canonical IS NOT NULL AND role IS NOT NULL")
    target = corpus.target_json(k, ["record_id"], "component_index")
    part = F.struct("component_index", "role", "name_canonical", "unit")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat_ws(":", x["component_index"].cast("string"), x["role"], x["name_canonical"], F.coalesce(x["unit"], F.lit("")))), ";")
    digest = k.groupBy("record_id").agg(F.sha2(text, 256).alias("digest"))
    return target.select("record_id", F.size(F.from_json("target", "array<struct<role:string>>")).cast("bigint").alias("n")).join(digest, "record_id")


@registry.add("SELECT doc_id, 3 AS n_messages, 'user' AS second_role, text AS content FROM documents WHERE text IS NOT NULL")
def q_chat_messages(t: Tables) -> DataFrame:
    d = corpus.chat_rows(t.documents.where("text IS NOT NULL"), "Read the text.", "text", "lang")
    return d.select("doc_id", F.size("messages").alias("n_messages"), F.col("messages")[1]["role"].alias("second_role"), F.col("messages")[1]["content"].alias("content"))


_KEY = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))"


@registry.add(f"SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]') GROUP BY {_KEY.format('text')}")
def q_distinct_texts(t: Tables) -> DataFrame:
    return corpus.distinct_texts(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", "n_copies")


@registry.add("SELECT record_id, CAST(unnest(range(1, CASE WHEN discard_reason IS NULL THEN 2 ELSE 4 END)) AS INTEGER) AS repeat FROM conditions")
def q_oversample(t: Tables) -> DataFrame:
    return corpus.oversample(t.conditions.select("record_id", "discard_reason"), F.when(F.col("discard_reason").isNull(), 1).otherwise(3)).select("record_id", "repeat")


@registry.add(f"""
    WITH b AS (SELECT DISTINCT {_KEY.format('raw_details')} AS k FROM conditions WHERE source = 'rules') SELECT record_id FROM conditions WHERE source = 'rules' UNION ALL
    SELECT record_id FROM conditions c WHERE source = 'teacher' AND NOT EXISTS (SELECT 1 FROM b WHERE b.k = {_KEY.format('c.raw_details')})""")
def q_add_teacher_rows(t: Tables) -> DataFrame:
    c = t.conditions.select("record_id", "raw_details", "source")
    return corpus.add_teacher_rows(c.where("source = 'rules'"), c.where("source = 'teacher'"), "raw_details")[0].select("record_id")


@registry.add("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'unparseable' WHEN 1 THEN 'not_a_list' WHEN 2 THEN 'element_not_object' WHEN 3 THEN 'bad_role' WHEN 4 THEN 'bad_unit' END AS error FROM events""")
def q_answer_errors(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    answer = (
        F.when(k == 0, F.lit("[{")).when(k == 1, F.col("props")).when(k == 2, F.lit("[1, 2]")).when(k == 3, F.lit('[{"role": "chef", "name": "X", "amount": 1.0, "unit": "molar"}]'))
        .when(k == 4, F.lit('[{"role": "salt", "name": "X", "amount": 1.0, "unit": "cup"}]')).otherwise(F.lit('[{"role": "salt", "name": "X", "amount": 1.0, "unit": "molar"}]'))
    )
    return t.events.select("event_id", corpus.answer_error(answer).alias("error"))


@registry.add("SELECT quantile_cont(length(text), 0.5)::DOUBLE AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99, CAST(max(length(text)) AS INTEGER) AS longest, count(*) AS n FROM documents WHERE text IS NOT NULL")
def q_length_percentiles(t: Tables) -> DataFrame:
    return corpus.length_percentiles(t.documents, "text").withColumn("p99", F.round("p99", 6))


@registry.add("""
    SELECT record_id, CASE WHEN NOT (coalesce(parse_confidence, 0) >= 0.95 AND discard_reason IS NULL) THEN 'residual' WHEN crystal_id = '2' THEN 'held_out' WHEN n_components = 0 THEN 'empty_answer' WHEN split = 'val' THEN 'valid' WHEN split = 'test' THEN 'test' ELSE 'train' END AS route FROM conditions""")
def q_route(t: Tables) -> DataFrame:
    usable = (F.coalesce("parse_confidence", F.lit(0.0)) >= 0.95) & F.col("discard_reason").isNull()
    return t.conditions.select("record_id", corpus.route(usable, F.coalesce(F.col("crystal_id") == "2", F.lit(False)), F.col("split"), F.col("n_components")).alias("route"))


@registry.add("""
    WITH s AS (SELECT DISTINCT canonical_id, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS flat FROM (SELECT canonical_id, unnest(list_concat([display_name], coalesce(aliases, []))) AS a FROM reagents) WHERE length(regexp_replace(lower(a), '[^a-z0-9]', '', 'g')) >= 3),
    g AS (SELECT flat, list(longer ORDER BY length(longer) DESC, longer) AS longer FROM (SELECT DISTINCT a.flat, b.flat AS longer FROM s a JOIN s b ON starts_with(b.flat, a.flat) AND length(b.flat) > length(a.flat) AND a.canonical_id <> b.canonical_id) GROUP BY flat),
    m AS (SELECT DISTINCT k.record_id, k.name_canonical AS canonical_id, regexp_replace(lower(c.raw_details), '[^a-z0-9]', '', 'g') AS t FROM components k JOIN conditions c ON c.record_id = k.record_id WHERE k.name_canonical IS NOT NULL AND c.raw_details IS NOT NULL),
    h AS (SELECT m.record_id, m.canonical_id, max(length(s.flat)) AS longest_hit FROM m JOIN s ON s.canonical_id = m.canonical_id AND contains(m.t, s.flat) LEFT JOIN g ON g.flat = s.flat
          WHERE contains(list_reduce(list_prepend(m.t, coalesce(g.longer, [])), lambda acc, w: replace(acc, w, '#')), s.flat) GROUP BY ALL)
    SELECT m.record_id, m.canonical_id, h.longest_hit IS NOT NULL AS grounded, CAST(h.longest_hit AS INTEGER) AS longest_hit FROM m LEFT JOIN h ON h.record_id = m.record_id AND h.canonical_id = m.canonical_id""")
def q_grounding(t: Tables) -> DataFrame:
    c = t.conditions.where(F.col("raw_details").isNotNull()).select("record_id", "raw_details")
    k = t.components.where("name_canonical IS NOT NULL").select("record_id", F.col("name_canonical").alias("canonical_id")).distinct()
    return corpus.grounded(k.join(c, "record_id"), "record_id", "canonical_id", "raw_details", corpus.spellings_of(t.reagents))


@registry.add()
def q_best_ratio(t: Tables) -> DataFrame:
    k = t.components.where("name_canonical IS NULL AND name_raw IS NOT NULL").join(t.conditions.select("record_id", "raw_details"), "record_id")
    return corpus.best_ratio(k.select("component_id", "name_raw", "raw_details"), "name_raw", "raw_details").select("component_id", F.round("similarity", 6).alias("similarity"))


# sequences


@registry.add("""
    SELECT record_id, min(component_index) AS start, max(component_index) AS "end", count(DISTINCT component_index) AS n_positions, CAST(max(component_index) - min(component_index) + 1 AS INTEGER) AS span_length,
           count(DISTINCT component_index) = max(component_index) - min(component_index) + 1 AS is_contiguous, count(DISTINCT component_index) FILTER (name_canonical IS NOT NULL) AS n_observed FROM components GROUP BY record_id""")
def q_spans(t: Tables) -> DataFrame:
    return sequence.spans(t.components, ["record_id"], "component_index", F.col("name_canonical").isNotNull()).drop("observed_fraction")


@registry.add("""
    WITH i AS (SELECT l_suppkey AS k, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::BIGINT AS a, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::BIGINT + l_quantity::BIGINT AS b FROM lineitem),
    e AS (SELECT k, a AS pos, 1 AS d FROM i UNION ALL SELECT k, b + 1, -1 FROM i), g AS (SELECT k, pos, sum(d) AS d FROM e GROUP BY ALL),
    s AS (SELECT k, pos, sum(d) OVER (PARTITION BY k ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS nx FROM g)
    SELECT k, pos AS start, nx - 1 AS "end", CAST(depth AS BIGINT) AS depth FROM s WHERE depth > 0 AND nx IS NOT NULL""")
def q_coverage_steps(t: Tables) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("bigint")
    i = t.lineitem.select(F.col("l_suppkey").alias("k"), day.alias("a"), (day + F.col("l_quantity").cast("bigint")).alias("b"))
    return sequence.coverage_steps(i, "k", "a", "b")


_COUNTS = {c: f"(length(s) - length(replace(s, '{c}', '')))" for c in S.RESIDUES}
_N = "(" + " + ".join(_COUNTS.values()) + ")"


@registry.add(f"""
    WITH x AS (SELECT pdb_id, entity_id, upper(seq_can) AS s FROM entities WHERE seq_can IS NOT NULL AND seq_can <> ''), n AS (SELECT *, {_N}::DOUBLE AS n FROM x)
    SELECT pdb_id, entity_id, CAST(length(s) AS INTEGER) AS length, round({" + ".join(f"CASE WHEN {c} > 0 THEN -({c} / n) * log2({c} / n) ELSE 0 END" for c in _COUNTS.values())}, 6) AS entropy,
           round(({" + ".join(f"{_COUNTS[c]} * ({v})" for c, v in S.HYDROPATHY.items())}) / n, 6) AS gravy, CAST({_COUNTS["K"]} + {_COUNTS["R"]} - {_COUNTS["D"]} - {_COUNTS["E"]} AS INTEGER) AS net_charge,
           round(({_COUNTS["F"]} + {_COUNTS["W"]} + {_COUNTS["Y"]}) / n, 6) AS fraction_aromatic FROM n WHERE n > 0""")
def q_descriptors(t: Tables) -> DataFrame:
    e = t.entities.where("seq_can IS NOT NULL AND seq_can <> ''").withColumn("k", F.struct("pdb_id", "entity_id"))
    d = sequence.descriptors(e, "k", "seq_can").where("n_standard > 0")
    return d.select("k.pdb_id", "k.entity_id", "length", *[F.round(c, 6).alias(c) for c in ("entropy", "gravy")], "net_charge", F.round("fraction_aromatic", 6).alias("fraction_aromatic"))


def _daily(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return g


_DAILY = "d AS (SELECT user_id, CAST(datediff('day', DATE '2024-01-01', ts::DATE) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY ALL)"


@registry.add(f"""
    WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM d),
    w AS (SELECT r.user_id, r.day, r.n, r.c, (SELECT list_sort(list(o.n)) FROM (SELECT x.n FROM r x, (SELECT unnest(range(-2, 3)) AS k) WHERE x.user_id = r.user_id AND x.i = least(greatest(r.i + k, 1), r.c)) o)[3] AS m FROM r)
    SELECT user_id, day, CASE WHEN c < 5 THEN n ELSE m END AS smooth FROM w""")
def q_median_filter(t: Tables) -> DataFrame:
    return sequence.median_filter(_daily(t), "user_id", "day", "n", 5).select("user_id", "day", "smooth")


@registry.add(f"""
    WITH {_DAILY}, r AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d WHERE n >= 2), g AS (SELECT *, sum(CASE WHEN coalesce(gap > 3, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS island FROM r)
    SELECT user_id, min(day) AS start, max(day) AS "end", CAST(max(day) - min(day) + 1 AS INTEGER) AS length FROM g GROUP BY user_id, island""")
def q_islands(t: Tables) -> DataFrame:
    return sequence.islands(_daily(t), "user_id", "day", F.col("n") >= 2, 2)


@registry.add()
def q_propose_segments(t: Tables) -> DataFrame:
    d = _daily(t).withColumn("p", F.least(F.col("n") / 4, F.lit(1.0)))
    return sequence.propose(d, "user_id", "day", "p", least=5, merge_gap=3, window=5).withColumn("mean", F.round("mean", 6))


@registry.add("""
    SELECT user_id, list_has_any(list(DISTINCT event_type), ['purchase', 'signup']) AS eligible, list_has_any(list(DISTINCT event_type), ['purchase']) AS positive FROM events GROUP BY user_id""")
def q_status_eligibility(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return sequence.status_eligibility(g, "s", ["purchase", "signup"], ["purchase"]).select("user_id", "eligible", "positive")


@registry.add("""
    WITH w AS (SELECT doc_id, CAST(power(2, ceil(log2(greatest(n_chars, 16)))) AS INTEGER) AS width FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id, width, CAST(floor((row_number() OVER (PARTITION BY width ORDER BY doc_id) - 1) / greatest(floor(8192 / width), 1)) AS BIGINT) AS batch FROM w""")
def q_length_batches(t: Tables) -> DataFrame:
    return sequence.length_batches(t.documents.where("n_chars IS NOT NULL"), "doc_id", "n_chars", 8192)


@registry.add("""
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, round(avg(v), 6) AS m FROM x GROUP BY ALL) SELECT label, count(*) AS n, round(sum(m), 4) AS total, round(max(m), 5) AS largest FROM m GROUP BY label""")
def q_mean_vectors(t: Tables) -> DataFrame:
    m = sequence.mean_vector(t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>")), "label", "embedding").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("m"))
    return m.select("label", F.size("m").cast("bigint").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("m"), 5).alias("largest"))


@registry.add()
def q_sequence_clusters(t: Tables) -> DataFrame:
    e = t.entities.where("seq_can IS NOT NULL").withColumn("id", F.concat_ws("_", "pdb_id", "entity_id"))
    return link.cluster_sequences(e, "id", "seq_can", 0.5)


@registry.add()
def q_boosted_trees(t: Tables) -> DataFrame:
    e = t.entities.where("seq_can IS NOT NULL").withColumn("k", F.concat_ws("_", "pdb_id", "entity_id"))
    d = sequence.descriptors(e, "k", "seq_can").join(e.select("k", (F.col("formula_weight") > 30).cast("int").alias("y")), "k").where("y IS NOT NULL")
    d = written(d, "descriptors")  # the trees read it many times
    features = ["length", "entropy", "gravy", "net_charge", "longest_run"]
    scored = sequence.boosted_trees(d, features, "y", trees=5, depth=3).transform(d)
    return scored.select("k", F.col("prediction").alias("prediction"))


# release and its SQL surface


@registry.add("SELECT k.name_canonical, count(*) AS uses, count(DISTINCT c.cluster_30) AS families FROM conditions c JOIN components k ON c.record_id = k.record_id WHERE c.discard_reason IS NULL AND k.name_canonical IS NOT NULL GROUP BY 1 ORDER BY families DESC, uses DESC, 1 LIMIT 10")
def q_reagent_families(t: Tables) -> DataFrame:
    release.register_views(t.spark, t.conditions, t.components)
    return t.spark.sql("""
        SELECT v.name_canonical, count(*) AS uses, count(DISTINCT u.cluster_30) AS families FROM condition_components v JOIN usable_conditions u ON u.record_id = v.record_id
        WHERE v.name_canonical IS NOT NULL GROUP BY v.name_canonical ORDER BY families DESC, uses DESC, v.name_canonical LIMIT 10""")


@registry.add("SELECT c.record_id, CAST(count(k.component_id) AS INTEGER) AS n_components, any_value(c.discard_reason) IS NULL AS is_usable FROM conditions c LEFT JOIN components k ON k.record_id = c.record_id GROUP BY c.record_id")
def q_assembled_records(t: Tables) -> DataFrame:
    return release.assemble(t.conditions.withColumn("pdb_id", F.upper(F.trim("pdb_id"))), t.components, t.entities).select("record_id", F.size("components").alias("n_components"), "is_usable")


@registry.add("SELECT count(*) AS n FROM (SELECT upper(trim(pdb_id)), crystal_id FROM conditions GROUP BY ALL)")
def q_unique_records(t: Tables) -> DataFrame:
    return release.unique_records(t.conditions).agg(F.count(F.lit(1)).alias("n"))


@registry.add("SELECT count(*) AS n, count(name) AS n_named, count(ordinal) AS n_ordinal FROM (SELECT canonical_id AS name, CAST(peg_mw AS BIGINT) AS ordinal FROM reagents UNION ALL SELECT well, NULL FROM screen_wells)")
def q_evolving_union(t: Tables) -> DataFrame:
    a = t.reagents.select(F.col("canonical_id").alias("name"), F.col("peg_mw").cast("bigint").alias("ordinal"))
    return release.union_evolving(a, t.screen_wells.select(F.col("well").alias("name"), F.col("well").alias("ordinal"), "screen")).agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_named"), F.count("ordinal").alias("n_ordinal"))


# extras beyond the reference: windows over events


@registry.add("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_tumbling(t: Tables) -> DataFrame:
    return incremental.tumbling(t.events, "ts", "event_type", "value", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@registry.add("""
    WITH g AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes', true) THEN 1 ELSE 0 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM n GROUP BY user_id, k""")
def x_sessions(t: Tables) -> DataFrame:
    return incremental.sessions(t.events, "ts", "user_id", "30 minutes").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))
