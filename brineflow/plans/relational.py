"""Queries of the relational operators on the condition tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions import quantity as Q
from brineflow.functions import stats as S
from brineflow.functions import text as X
from brineflow.operators import corpus, flatten, lexicon, link
from brineflow.plans.registry import Registry, Tables

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles


@registry.add("""
    SELECT pdb_id, entity_id, CAST(length(seq_can) AS INTEGER) AS n, CASE WHEN length(seq_can) < 100 THEN 'short' WHEN length(seq_can) < 250 THEN 'medium' ELSE 'long' END AS size_label,
           substr(coalesce(description, 'unknown'), 1, 20) AS description
    FROM entities WHERE seq_can IS NOT NULL AND regexp_full_match(upper(seq_can), '[ACDEFGHIKLMNPQRSTVWY]+') AND length(seq_can) BETWEEN 60 AND 400""")
def q_select_filter(t: Tables) -> DataFrame:
    n = F.length("seq_can")
    kept = t.entities.where(F.upper("seq_can").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$") & n.between(60, 400))
    label = F.when(n < 100, "short").when(n < 250, "medium").otherwise("long")
    return kept.select("pdb_id", "entity_id", n.alias("n"), label.alias("size_label"), F.substring(F.coalesce("description", F.lit("unknown")), 1, 20).alias("description"))


@registry.add("""
    SELECT pdb_id, entity_id, CAST(len(uniprot_ids) AS INTEGER) AS n_accessions, list_has_any(source_taxids, [9606, 562]) AS is_model_organism
    FROM entities WHERE len(uniprot_ids) > 0 AND source_taxids IS NOT NULL""")
def q_array_predicates(t: Tables) -> DataFrame:
    common = F.arrays_overlap("source_taxids", F.array(F.lit(9606).cast("bigint"), F.lit(562).cast("bigint")))
    return t.entities.where((F.size("uniprot_ids") > 0) & F.col("source_taxids").isNotNull()).select("pdb_id", "entity_id", F.size("uniprot_ids").alias("n_accessions"), F.coalesce(common, F.lit(False)).alias("is_model_organism"))


@registry.add("""
    SELECT chem_class, count(*) AS n FROM components WHERE record_id IN (SELECT record_id FROM conditions WHERE split = 'test' AND trim(raw_details) <> '') GROUP BY chem_class""")
def q_semi_join(t: Tables) -> DataFrame:
    test = t.conditions.where((F.col("split") == "test") & (F.trim("raw_details") != "")).select("record_id")
    return t.components.join(test, "record_id", "left_semi").groupBy("chem_class").agg(F.count(F.lit(1)).alias("n"))


@registry.add("""
    SELECT DISTINCT e.pdb_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM conditions c WHERE upper(trim(c.pdb_id)) = e.pdb_id)""")
def q_anti_join(t: Tables) -> DataFrame:
    known = t.conditions.select(F.upper(F.trim("pdb_id")).alias("pdb_id"))
    return t.entities.select("pdb_id").distinct().join(known, "pdb_id", "left_anti")


@registry.add("""
    WITH a AS (SELECT DISTINCT upper(trim(pdb_id)) AS pdb_id FROM conditions), b AS (SELECT DISTINCT pdb_id FROM entities)
    SELECT CASE WHEN a.pdb_id IS NOT NULL AND b.pdb_id IS NOT NULL THEN 'agree' WHEN a.pdb_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status, count(*) AS n
    FROM a FULL OUTER JOIN b ON a.pdb_id = b.pdb_id GROUP BY 1""")
def q_reconcile(t: Tables) -> DataFrame:
    return link.reconcile(t.conditions.select(F.upper(F.trim("pdb_id")).alias("pdb_id")), t.entities.select("pdb_id"), ["pdb_id"])


@registry.add("""
    SELECT k.component_id, c.split, r.display_name FROM components k JOIN conditions c ON c.record_id = k.record_id LEFT JOIN reagents r ON r.canonical_id = k.name_canonical
    WHERE k.concentration > 1.5""")
def q_left_dimensions(t: Tables) -> DataFrame:
    big = t.components.where(F.col("concentration") > 1.5).select("component_id", "record_id", F.col("name_canonical").alias("canonical_id"))
    return big.join(t.conditions.select("record_id", "split"), "record_id").join(t.reagents.select("canonical_id", "display_name"), "canonical_id", "left").select("component_id", "split", "display_name")


def _sourced(t: Tables) -> DataFrame:
    return t.components.join(t.conditions.select("record_id", "source"), "record_id").where("name_canonical <> ''")


@registry.add("""
    WITH s AS (SELECT k.pdb_id, k.name_canonical, c.source FROM components k JOIN conditions c USING (record_id) WHERE k.name_canonical <> ''),
    r AS (SELECT pdb_id, name_canonical FROM s WHERE source = 'rules'), m AS (SELECT DISTINCT pdb_id, name_canonical FROM s WHERE source = 'slm')
    SELECT name_canonical, provenance, count(*) AS n FROM (
        SELECT name_canonical, 'rules' AS provenance FROM r UNION ALL
        SELECT m.name_canonical, 'model' FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pdb_id = m.pdb_id AND r.name_canonical = m.name_canonical)) GROUP BY ALL""")
def q_rules_win_merge(t: Tables) -> DataFrame:
    s = _sourced(t).select("pdb_id", "name_canonical", "source")
    merged = corpus.rules_win(s.where("source = 'rules'").drop("source"), s.where("source = 'slm'").drop("source"), ["pdb_id", "name_canonical"])
    return merged.groupBy("name_canonical", "provenance").agg(F.count(F.lit(1)).alias("n"))


@registry.add("""
    WITH r AS (SELECT * FROM components WHERE component_index < 3), m AS (SELECT * FROM components WHERE component_index >= 1),
    g AS (SELECT record_id FROM r GROUP BY 1 HAVING max(CASE WHEN name_canonical IS NULL THEN 1 ELSE 0 END) = 1), x AS (SELECT record_id FROM g WHERE record_id IN (SELECT record_id FROM m))
    SELECT provenance, count(*) AS n, CAST(sum(component_id) AS BIGINT) AS id_sum FROM (
        SELECT 'rules' AS provenance, component_id FROM r WHERE record_id NOT IN (SELECT record_id FROM x) UNION ALL SELECT 'model', component_id FROM m WHERE record_id IN (SELECT record_id FROM x)) GROUP BY 1""")
def q_replace_gaps(t: Tables) -> DataFrame:
    k = t.components
    out = corpus.replace_gaps(k.where("component_index < 3"), k.where("component_index >= 1"), ["record_id"], F.col("name_canonical").isNull())
    return out.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.sum("component_id").alias("id_sum"))


@registry.add("""
    SELECT coalesce(discard_reason, 'USABLE') AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM conditions), 6) AS share FROM conditions GROUP BY 1""")
def q_counts_and_shares(t: Tables) -> DataFrame:
    g = t.conditions.groupBy(F.coalesce("discard_reason", F.lit("USABLE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@registry.add("""
    SELECT count(*) AS n_records, count(DISTINCT pdb_id) AS n_entries, count(*) FILTER (discard_reason IS NULL) AS n_usable,
           round(count(*) FILTER (discard_reason IS NULL) / greatest(count(*), 1), 6) AS usable_share, CAST(sum(n_components) AS BIGINT) AS n_components,
           CAST(sum(n_components_identified) AS BIGINT) AS n_identified, round(median(parse_confidence), 6) AS median_confidence FROM conditions""")
def q_statistics(t: Tables) -> DataFrame:
    from brineflow.operators.release import statistics

    s = statistics(t.conditions)
    return s.withColumns({"usable_share": F.round("usable_share", 6), "median_confidence": F.round("median_confidence", 6)})


@registry.add("""
    SELECT source, count(ph) AS n, round(quantile_cont(ph, 0.1), 6) AS p10, round(quantile_cont(ph, 0.5), 6) AS p50, round(quantile_cont(ph, 0.9), 6) AS p90
    FROM conditions WHERE ph IS NOT NULL GROUP BY source HAVING count(ph) >= 20""")
def q_quantiles(t: Tables) -> DataFrame:
    g = t.conditions.where("ph IS NOT NULL").groupBy("source").agg(F.count("ph").alias("n"), F.percentile("ph", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return g.where("n >= 20").select("source", "n", *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("p10", "p50", "p90"))])


@registry.add("""
    WITH m AS (SELECT trim(lower(name_canonical)) AS norm_name, record_id FROM components WHERE trim(name_canonical) <> ''),
    g AS (SELECT norm_name, count(*) AS n_uses, count(DISTINCT record_id) AS n_records FROM m GROUP BY 1)
    SELECT norm_name, n_uses, n_records, CAST(row_number() OVER (ORDER BY n_uses DESC, norm_name) AS INTEGER) AS rank,
           round(sum(n_uses) OVER (ORDER BY n_uses DESC, norm_name ROWS UNBOUNDED PRECEDING) / sum(n_uses) OVER (), 6) AS coverage FROM g""")
def q_coverage_ranking(t: Tables) -> DataFrame:
    g = t.components.where(F.trim("name_canonical") != "").groupBy(F.trim(F.lower("name_canonical")).alias("norm_name")).agg(F.count(F.lit(1)).alias("n_uses"), F.countDistinct("record_id").alias("n_records"))
    return lexicon.running_coverage(g, "norm_name", "n_uses").withColumn("coverage", F.round("coverage", 6))


@registry.add("""
    WITH g AS (SELECT name_canonical AS x, count(*) AS n FROM components WHERE trim(name_canonical) <> '' GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY n DESC, x) AS rank, sum(n) OVER (ORDER BY n DESC, x ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS c FROM g), t AS (SELECT unnest([0.5, 0.75, 0.9]) AS target)
    SELECT CAST(target AS DOUBLE) AS target, CAST(min(rank) AS INTEGER) AS n_names FROM t JOIN r ON c >= target - 1e-12 GROUP BY target""")
def q_names_to_cover(t: Tables) -> DataFrame:
    g = t.components.where(F.trim("name_canonical") != "").groupBy("name_canonical").agg(F.count(F.lit(1)).alias("n"))
    return lexicon.names_to_cover(lexicon.running_coverage(g, "name_canonical", "n"), [0.5, 0.75, 0.9])


@registry.add("""
    WITH g AS (SELECT name_canonical, unit, count(*) AS n FROM components WHERE unit IS NOT NULL AND name_canonical IS NOT NULL GROUP BY ALL)
    SELECT name_canonical, unit, n, round(n / sum(n) OVER (PARTITION BY name_canonical), 6) AS share, CAST(row_number() OVER (PARTITION BY name_canonical ORDER BY n DESC, unit) AS INTEGER) AS rank FROM g""")
def q_mode_share(t: Tables) -> DataFrame:
    return lexicon.mode_share(t.components.where("name_canonical IS NOT NULL"), "name_canonical", "unit").withColumn("share", F.round("share", 6))


@registry.add("""
    WITH g AS (SELECT name_canonical, unit, count(*) AS n FROM components WHERE unit IS NOT NULL AND name_canonical IS NOT NULL GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY name_canonical) AS share, CAST(sum(n) OVER (PARTITION BY name_canonical) AS BIGINT) AS n_total FROM g)
    SELECT name_canonical, unit, n, round(share, 6) AS share, n_total FROM s WHERE share > 0.005 AND share < 0.15 AND n_total >= 50""")
def q_unit_anomalies(t: Tables) -> DataFrame:
    return lexicon.unit_anomalies(t.components.where("name_canonical IS NOT NULL"), "name_canonical", "unit").withColumn("share", F.round("share", 6))


@registry.add("""
    SELECT discard_reason, record_id, raw_details FROM conditions WHERE discard_reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY discard_reason ORDER BY record_id) <= 3""")
def q_examples_per_group(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("discard_reason").orderBy("record_id"))
    return t.conditions.where("discard_reason IS NOT NULL").withColumn("_r", rank).where("_r <= 3").select("discard_reason", "record_id", "raw_details")


@registry.add("""
    SELECT record_id, name_canonical, component_id, n_copies FROM (
        SELECT record_id, name_canonical, component_id, count(*) OVER (PARTITION BY record_id, name_canonical) AS n_copies, row_number() OVER (PARTITION BY record_id, name_canonical ORDER BY component_index, component_id) AS rn
        FROM components WHERE name_canonical IS NOT NULL) WHERE rn = 1""")
def q_first_wins(t: Tables) -> DataFrame:
    return flatten.first_wins(t.components.where("name_canonical IS NOT NULL"), ["record_id", "name_canonical"], ["component_index", "component_id"]).select("record_id", "name_canonical", "component_id", "n_copies")


@registry.add("""
    SELECT pdb_id, entity_id, CAST(position AS INTEGER) AS position, accession, CAST(n AS INTEGER) AS n FROM (
        SELECT pdb_id, entity_id, unnest(range(1, len(uniprot_ids) + 1)) AS position, unnest(uniprot_ids) AS accession, len(uniprot_ids) AS n FROM entities WHERE len(uniprot_ids) > 0
        UNION ALL SELECT pdb_id, entity_id, 1, NULL, 0 FROM entities WHERE coalesce(len(uniprot_ids), 0) = 0)""")
def q_outer_elements(t: Tables) -> DataFrame:
    keyed = t.entities.select(F.struct("pdb_id", "entity_id").alias("k"), "uniprot_ids")
    return flatten.outer_elements(keyed, "k", "uniprot_ids", "accession").select("k.pdb_id", "k.entity_id", "position", "accession", "n")


@registry.add("""
    SELECT c.record_id, coalesce(string_agg(k.component_index || ':' || coalesce(k.name_canonical, '?'), ';' ORDER BY k.component_index, k.component_id), '') AS parts, CAST(count(k.component_id) AS INTEGER) AS n
    FROM conditions c LEFT JOIN components k ON k.record_id = c.record_id GROUP BY c.record_id""")
def q_nest_children(t: Tables) -> DataFrame:
    nested = flatten.nest(t.components, ["record_id"], "component_index", ["component_id", "name_canonical"], "components")
    out = flatten.attach(t.conditions.select("record_id"), nested, ["record_id"], "components")
    parts = F.transform("components", lambda x: F.concat(x["component_index"].cast("string"), F.lit(":"), F.coalesce(x["name_canonical"], F.lit("?"))))
    return out.select("record_id", F.array_join(parts, ";").alias("parts"), F.size("components").alias("n"))


@registry.add("""
    WITH x AS (SELECT pdb_id, entity_id, unnest(source_organisms) AS o, unnest(range(len(source_organisms))) AS i FROM entities),
    f AS (SELECT pdb_id, o, min(struct_pack(e := entity_id, i := i)) AS first FROM x GROUP BY ALL)
    SELECT e.pdb_id, coalesce(string_agg(o, '|' ORDER BY first), '') AS organisms FROM (SELECT DISTINCT pdb_id FROM entities) e LEFT JOIN f ON f.pdb_id = e.pdb_id GROUP BY e.pdb_id""")
def q_ordered_union(t: Tables) -> DataFrame:
    return flatten.ordered_union(t.entities, ["pdb_id"], "entity_id", "source_organisms", "organisms").select("pdb_id", F.array_join("organisms", "|").alias("organisms"))


@registry.add("SELECT screen, well, CAST(row_number() OVER (PARTITION BY screen ORDER BY substr(well, 1, 1), CAST(substr(well, 2) AS INTEGER)) AS INTEGER) AS ordinal FROM screen_wells")
def q_natural_order(t: Tables) -> DataFrame:
    from brineflow.operators.screens import natural_order

    return t.screen_wells.select("screen", "well", F.row_number().over(Window.partitionBy("screen").orderBy(*natural_order("well"))).alias("ordinal"))


@registry.add("SELECT record_id, n_components, parse_confidence FROM conditions ORDER BY n_components DESC NULLS LAST, parse_confidence, record_id LIMIT 25")
def q_top_rows(t: Tables) -> DataFrame:
    return t.conditions.select("record_id", "n_components", "parse_confidence").orderBy(F.desc_nulls_last("n_components"), F.asc_nulls_last("parse_confidence"), "record_id").limit(25)


@registry.add("SELECT max_by(record_id, loaded_at) AS record_id, max(loaded_at)::VARCHAR[1:19] AS loaded_at FROM conditions WHERE loaded_at IS NOT NULL AND record_id = (SELECT max(record_id) FROM conditions WHERE loaded_at = (SELECT max(loaded_at) FROM conditions))".replace("max(loaded_at)::VARCHAR[1:19]", "strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S')"))
def q_latest_snapshot(t: Tables) -> DataFrame:
    best = t.conditions.agg(F.max_by("record_id", F.struct("loaded_at", "record_id")).alias("record_id"), F.max("loaded_at").alias("loaded_at"))
    return best.select("record_id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


@registry.add("""
    WITH k AS (SELECT record_id, trim(raw_details) AS t FROM conditions)
    SELECT record_id, CASE WHEN t IS NULL OR t = '' THEN true ELSE false END AS blank, length(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'))::INTEGER AS n_alnum, substr(sha256(lower(trim(regexp_replace(t, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))), 1, 16) AS key_digest
    FROM k WHERE t IS NULL OR NOT regexp_matches(t, '[^\\x00-\\x7f]')""")
def q_text_keys(t: Tables) -> DataFrame:
    """Texts on which the SQL agrees; `q_text_keys_all` has all of them."""
    return _text_keys(t.conditions.where(F.trim("raw_details").isNull() | ~F.trim("raw_details").rlike(r"[^\x00-\x7f]")))


@registry.add()
def q_text_keys_all(t: Tables) -> DataFrame:
    return _text_keys(t.conditions)


def _text_keys(conditions: DataFrame) -> DataFrame:
    c = conditions.withColumn("t", F.trim("raw_details"))
    return c.select("record_id", X.is_blank(F.col("t")).alias("blank"), F.length(X.flat_alnum(F.col("t"))).alias("n_alnum"), F.substring(F.sha2(X.dedup_key(F.col("t")), 256), 1, 16).alias("key_digest"))


@registry.add("""
    SELECT canonical_id, regexp_replace(regexp_replace(upper(CASE WHEN regexp_matches(trim(display_name), '^[0-9]+(,[0-9]+)*-') THEN regexp_replace(trim(display_name), '^[0-9]+(,[0-9]+)*-', '') || '_' || regexp_extract(trim(display_name), '^([0-9]+(,[0-9]+)*)-', 1) ELSE trim(display_name) END), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS built_id,
           trim(regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS words, lower(replace(canonical_id, '_', ' ')) AS readable, lower(substr(canonical_id, 2, 2)) AS folder FROM reagents WHERE display_name NOT LIKE '%hydrate%'""")
def q_id_builders(t: Tables) -> DataFrame:
    """Names on which the SQL agrees; `q_id_builders_all` has all of them."""
    return _id_builders(t.reagents.where(~F.col("display_name").contains("hydrate")))


@registry.add()
def q_id_builders_all(t: Tables) -> DataFrame:
    return _id_builders(t.reagents)


def _id_builders(r: DataFrame) -> DataFrame:
    name = F.col("display_name")
    return r.select("canonical_id", X.canonical_id(name).alias("built_id"), X.match_key(name).alias("words"), X.readable_id(F.col("canonical_id")).alias("readable"), X.middle_path(F.col("canonical_id")).alias("folder"))


_UNIT_CASE = """CASE WHEN unit = 'molar' THEN 1.0 WHEN unit = 'millimolar' THEN 1e-3 WHEN unit = 'micromolar' THEN 1e-6 WHEN unit = 'nanomolar' THEN 1e-9 END"""


@registry.add(f"""
    SELECT component_id, round(concentration * {_UNIT_CASE}, 12) AS molar, CASE WHEN unit LIKE 'percent%' THEN concentration END AS percent,
           coalesce(concentration > 0 AND (CASE WHEN unit LIKE 'percent%' THEN concentration > 100 ELSE concentration * {_UNIT_CASE} > 8 END), false) AS implausible FROM components""")
def q_amount_scales(t: Tables) -> DataFrame:
    v, u = F.col("concentration"), F.col("unit")
    return t.components.select("component_id", F.round(Q.molar(v, u), 12).alias("molar"), Q.percent(v, u).alias("percent"), Q.is_implausible(v, u).alias("implausible"))


@registry.add("""
    WITH j AS (SELECT k.component_id, CASE WHEN k.unit IN ('percent_w_v', 'percent_v_v', '%', 'percent_unspecified') THEN 'percent_unspecified' ELSE k.unit END AS unit, r.chem_class, r.peg_mw, r.default_unit FROM components k JOIN reagents r ON r.canonical_id = k.name_canonical)
    SELECT component_id, CASE WHEN unit = 'percent_unspecified' THEN CASE WHEN chem_class = 'peg' AND peg_mw <= 600 THEN 'percent_v_v' WHEN chem_class IN ('organic', 'polyol') THEN 'percent_v_v' ELSE 'percent_w_v' END ELSE coalesce(unit, default_unit) END AS unit,
           coalesce(unit, '') = 'percent_unspecified' OR (unit IS NULL AND default_unit IS NOT NULL) AS inferred FROM j""")
def q_infer_unit(t: Tables) -> DataFrame:
    unit = F.when(F.col("unit").isin("percent_w_v", "percent_v_v", "%", "percent_unspecified"), "percent_unspecified").otherwise(F.col("unit"))
    j = t.components.select("component_id", unit.alias("unit"), F.col("name_canonical").alias("canonical_id")).join(t.reagents.select("canonical_id", "chem_class", "peg_mw", "default_unit"), "canonical_id")
    return j.select("component_id", Q.infer_unit(F.col("unit"), F.col("chem_class"), F.col("peg_mw"), F.col("default_unit")).alias("u")).select("component_id", "u.unit", "u.inferred")


@registry.add("""
    SELECT record_id, round(CASE WHEN temperature_k <= 45 THEN temperature_k + 273.15 ELSE temperature_k END, 6) AS kelvin,
           CASE WHEN ph <= 5.5 THEN 'acid' WHEN ph <= 7.0 THEN 'mild' WHEN ph <= 8.5 THEN 'basic' WHEN ph IS NOT NULL THEN 'strong' END AS ph_band,
           CASE WHEN ph BETWEEN 4 AND 6 THEN 'low' WHEN ph BETWEEN 7 AND 9 THEN 'high' END AS gapped, abs(ph - ph_reported) > 0.5 AS ph_conflict,
           CASE WHEN year(deposited_at) < 2000 THEN 'before 2000' WHEN year(deposited_at) < 2010 THEN '2000s' WHEN year(deposited_at) < 2020 THEN '2010s' WHEN deposited_at IS NOT NULL THEN '2020s' END AS era FROM conditions""")
def q_bands(t: Tables) -> DataFrame:
    return t.conditions.select(
        "record_id", F.round(Q.to_kelvin(F.col("temperature_k")), 6).alias("kelvin"), Q.band(F.col("ph"), [5.5, 7.0, 8.5], ["acid", "mild", "basic", "strong"]).alias("ph_band"),
        Q.closed_band(F.col("ph"), [(4, 6, "low"), (7, 9, "high")]).alias("gapped"), (F.abs(F.col("ph") - F.col("ph_reported")) > 0.5).alias("ph_conflict"), Q.era(F.col("deposited_at")).alias("era"),
    )


@registry.add("""
    SELECT component_id, CASE WHEN chem_class IN ('peg', 'organic', 'polyol') THEN 'precipitant' WHEN chem_class IN ('salt', 'buffer') THEN chem_class WHEN chem_class = 'premix' THEN 'precipitant' WHEN chem_class IS NOT NULL THEN 'additive' ELSE 'unknown' END AS role,
           CASE WHEN name_canonical IN ('GLYCEROL', 'ETHYLENE_GLYCOL', 'MPD', 'PEG_200', 'PEG_400', 'SUCROSE', 'TREHALOSE', 'XYLITOL', 'DMSO') AND unit LIKE 'percent%' AND concentration <= 15 THEN 'inferred' END AS cryo
    FROM components WHERE name_raw NOT LIKE '%cryo%'""")
def q_roles(t: Tables) -> DataFrame:
    """The rows and the list of capable reagents that the SQL states; `q_role_evidence` has all rows and the whole list."""
    stated = ("GLYCEROL", "ETHYLENE_GLYCOL", "MPD", "PEG_200", "PEG_400", "SUCROSE", "TREHALOSE", "XYLITOL", "DMSO")
    return _roles(t.components.where(~F.col("name_raw").contains("cryo")), stated)


@registry.add(f"""
    SELECT component_id, CASE WHEN chem_class IN ('peg', 'organic', 'polyol', 'other') THEN 'precipitant' WHEN chem_class IN ('salt', 'buffer') THEN chem_class WHEN chem_class IN ('detergent', 'additive') THEN 'additive' WHEN chem_class = 'premix' THEN 'precipitant' ELSE 'unknown' END AS role,
           CASE WHEN regexp_matches(name_raw, 'cryo|\\bfor freezing\\b|\\bflash[- ]?(cool|fr[eo]e?z)') THEN 'explicit' WHEN name_canonical IN {Q.CRYO_CAPABLE} AND unit LIKE 'percent%' AND concentration <= 15 THEN 'inferred' END AS cryo
    FROM components""")
def q_role_evidence(t: Tables) -> DataFrame:
    return _roles(t.components)


@registry.add()
def q_roles_all(t: Tables) -> DataFrame:
    return _roles(t.components)


def _roles(k: DataFrame, capable: tuple[str, ...] = Q.CRYO_CAPABLE) -> DataFrame:
    return k.select("component_id", Q.role_of(F.col("chem_class")).alias("role"), Q.cryo_evidence(F.col("name_raw"), F.col("name_canonical"), F.col("concentration"), F.col("unit"), capable).alias("cryo"))


@registry.add("""
    SELECT pdb_id, entity_id, substr(sha1(seq_can), 1, 16) AS seq_id, md5(seq_can) AS digest,
           CASE WHEN substr(sha256(pdb_id), 1, 16) < '2666666666666666' THEN 'test' WHEN substr(sha256(pdb_id), 1, 16) < '4ccccccccccccccc' THEN 'val' ELSE 'train' END AS fold,
           CAST(CAST('0x' || substr(sha256(pdb_id), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM entities""")
def q_hashes(t: Tables) -> DataFrame:
    p = F.col("pdb_id")
    return t.entities.select("pdb_id", "entity_id", S.sequence_id(F.col("seq_can")).alias("seq_id"), F.md5("seq_can").alias("digest"), S.hash_fold(p).alias("fold"), S.hash_bucket(p).alias("bucket"))


@registry.add("""
    WITH r AS (SELECT pdb_id, entity_id, poly_type, seq_length, row_number() OVER (PARTITION BY pdb_id ORDER BY coalesce(seq_length, 0) DESC, entity_id) AS a,
               CASE WHEN poly_type LIKE 'polypeptide%' THEN row_number() OVER (PARTITION BY pdb_id, poly_type LIKE 'polypeptide%' ORDER BY coalesce(seq_length, 0) DESC, entity_id) END AS b FROM entities)
    SELECT pdb_id, max(entity_id) FILTER (a = 1) AS representative_entity_id, max(poly_type) FILTER (a = 1) AS representative_type, max(seq_length) FILTER (a = 1) AS representative_length, count(*) AS n_polymer_entities,
           max(entity_id) FILTER (b = 1) AS protein_entity_id, count(b) AS n_protein_entities, count(*) > 1 AS is_complex FROM r GROUP BY pdb_id""")
def q_representatives(t: Tables) -> DataFrame:
    return link.representatives(t.entities).select("pdb_id", "representative_entity_id", "representative_type", "representative_length", "n_polymer_entities", "protein_entity_id", "n_protein_entities", "is_complex")


@registry.add("""
    WITH a AS (SELECT upper(trim(pdb_id)) AS pdb_id, raw_details, record_id, crystal_id FROM conditions),
    l AS (SELECT pdb_id, count(*) AS n, string_agg(sha256(coalesce(raw_details, chr(0))), '' ORDER BY record_id, coalesce(raw_details, chr(0))) AS d FROM a GROUP BY 1),
    r AS (SELECT pdb_id, count(*) AS n, string_agg(sha256(coalesce(lower(raw_details), chr(0))), '' ORDER BY record_id, coalesce(lower(raw_details), chr(0))) AS d FROM a WHERE crystal_id <> '2' GROUP BY 1)
    SELECT coalesce(l.pdb_id, r.pdb_id) AS pdb_id, CASE WHEN l.n IS NULL OR r.n IS NULL THEN 'missing' WHEN l.n <> r.n THEN 'row_count_mismatch' WHEN l.d <> r.d THEN 'text_mismatch' ELSE 'agree' END AS status FROM l FULL OUTER JOIN r ON l.pdb_id = r.pdb_id""")
def q_compare_sources(t: Tables) -> DataFrame:
    a = t.conditions.select(F.upper(F.trim("pdb_id")).alias("pdb_id"), "raw_details", "record_id", "crystal_id")
    return link.compare_sources(a, a.where("crystal_id <> '2'").withColumn("raw_details", F.lower("raw_details")), "pdb_id", "raw_details", "record_id")


@registry.add("SELECT count(DISTINCT pdb_id) AS n, CAST(max(size) AS BIGINT) AS largest, count(DISTINCT batch) AS n_batches FROM (SELECT pdb_id, batch, count(*) OVER (PARTITION BY batch) AS size FROM (SELECT pdb_id, (row_number() OVER (ORDER BY pdb_id) - 1) // 300 AS batch FROM (SELECT DISTINCT pdb_id FROM entities)))")
def q_batches(t: Tables) -> DataFrame:
    b = link.batches(t.entities, "pdb_id", 300)
    sized = b.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("batch")))
    return sized.agg(F.countDistinct("pdb_id").alias("n"), F.max("size").alias("largest"), F.countDistinct("batch").alias("n_batches"))


@registry.add("""
    SELECT level, n_distinct, n_entries FROM (SELECT count(*) AS n_entries, count(DISTINCT cluster_30) AS a, count(DISTINCT pdb_id) AS b FROM conditions), LATERAL (SELECT 'cluster_30' AS level, a AS n_distinct UNION ALL SELECT 'pdb_id', b)""")
def q_redundancy(t: Tables) -> DataFrame:
    return link.redundancy(t.conditions, ["cluster_30", "pdb_id"])


@registry.add("SELECT cluster_30, n, source FROM (SELECT cluster_30, source, count(*) AS k, sum(count(*)) OVER (PARTITION BY cluster_30)::BIGINT AS n, row_number() OVER (PARTITION BY cluster_30 ORDER BY count(*) DESC, source) AS rn FROM conditions WHERE trim(cluster_30) <> '' GROUP BY cluster_30, source) WHERE rn = 1 ORDER BY n DESC, cluster_30 LIMIT 10")
def q_largest_clusters(t: Tables) -> DataFrame:
    m = lexicon.mode_share(t.conditions.where(F.trim("cluster_30") != ""), "cluster_30", "source").withColumn("total", F.sum("n").over(Window.partitionBy("cluster_30")))
    return m.where("rank = 1").select("cluster_30", F.col("total").alias("n"), "source").orderBy(F.desc("n"), "cluster_30").limit(10)


@registry.add("""
    WITH x AS (SELECT record_id, lower(trim(name_canonical)) AS n, unit FROM components WHERE name_canonical IS NOT NULL AND record_id % 2 = record_id % 2),
    a AS (SELECT record_id, n, count(*) AS c FROM x WHERE unit = 'molar' GROUP BY ALL), b AS (SELECT record_id, n, count(*) AS c FROM x WHERE unit = 'millimolar' GROUP BY ALL),
    j AS (SELECT coalesce(a.c, 0) AS p, coalesce(b.c, 0) AS q FROM a FULL OUTER JOIN b ON a.record_id = b.record_id AND a.n = b.n)
    SELECT CAST(sum(least(p, q)) AS BIGINT) AS tp, CAST(sum(q - least(p, q)) AS BIGINT) AS fp, CAST(sum(p - least(p, q)) AS BIGINT) AS fn FROM j""".replace(" AND record_id % 2 = record_id % 2", ""))
def q_multiset_match(t: Tables) -> DataFrame:
    from brineflow.operators.evaluation import multiset_matches

    x = t.components.where("name_canonical IS NOT NULL").select("record_id", F.lower(F.trim("name_canonical")).alias("n"), "unit")
    return multiset_matches(x.where("unit = 'molar'"), x.where("unit = 'millimolar'"), ["record_id", "n"])
