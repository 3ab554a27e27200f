"""Record parser: condition texts to components and records.

Distinct texts are split into clauses once, in Arrow batches (the grammar needs left-to-right state); amounts, names,
lookups, units, roles, pH and temperature are native columns over clause rows, and one shuffle on the text brings
them back to records. Records with the same text share one parse.

Defined results: null and blank texts give a record with discard reason EMPTY and no components; ties between clauses
are broken by position; repeated keys give repeated records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions import quantity as Q
from brineflow.functions import text as X
from brineflow.functions.clauses import detailed_clauses, reagent_gate
from brineflow.operators.joins import heavy_light_join
from brineflow.operators.lexicon import local_index, lookup_cascade, with_premixes
from brineflow.runtime.session import bounded_rows, parallelism, ship_code

#: Aliases held by each Python worker for the gates of the splitter.
MAX_ALIASES = 200_000
_CLAUSE = "array<struct<clause:string,depth:int,scope:string,slash:boolean>>"
#: Acids and bases that set the pH of the buffer before them.
TITRANTS = ("sodium hydroxide", "potassium hydroxide", "naoh", "koh", "hydrochloric acid", "hcl", "acetic acid", "phosphoric acid", "nitric acid")
#: Unidentified names kept with a record.
MOST_UNIDENTIFIED = 10


def clause_rows(texts: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """(text, clause_index, clause, depth, scope, slash): clauses of every distinct text in order; `slash` if one stands before."""
    ship_code(texts.sparkSession)
    rows = bounded_rows(index.select("norm_name").distinct(), MAX_ALIASES)
    if rows is None:
        raise ValueError(f"the lexicon has more than {MAX_ALIASES} aliases")
    names = [r["norm_name"] for r in rows]

    @F.pandas_udf(_CLAUSE)
    def split(batch: pd.Series) -> pd.Series:
        gate = reagent_gate(names)
        return pd.Series([[{"clause": c, "depth": d, "scope": s, "slash": x} for c, d, s, x in detailed_clauses(t, gate)] for t in batch], dtype=object)

    # an explicit number of partitions: the parse costs far more than the bytes by which partitions would be merged
    distinct = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().repartition(parallelism(texts.sparkSession))
    found = distinct.select("text", split.asNondeterministic()(F.col("text")).alias("c"))
    return found.select("text", F.posexplode("c").alias("clause_index", "c")).select("text", "clause_index", "c.clause", "c.depth", "c.scope", "c.slash")


def parse_clauses(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every clause with its kind and, for reagent clauses, the parsed component."""
    r = (
        rows.withColumn("kind", X.clause_kind(F.col("clause")))
        .withColumn("ph_text", X.trailing_ph(F.col("clause")))
        .withColumn("body", F.when(F.col("kind") == "reagent", X.without_trailing_ph(F.col("clause"))))  # other kinds name nothing
        .withColumn("amount", Q.extract_amount(F.col("body")))
        .withColumn("name_raw", X.strip_amount(F.col("body")))
        .withColumn("norm_name", X.tidy_name(F.lower("name_raw")))
    )
    columns = ["canonical_id", "chem_class", "peg_mw", "is_mme", "default_unit", "buffer_pka", "only_buffers"]
    r = lookup_cascade(r, "norm_name", index, columns).withColumnRenamed("canonical_id", "name_canonical")
    unit = Q.infer_unit(F.col("amount.unit"), F.col("chem_class"), F.col("peg_mw"), F.when(F.col("amount.value").isNotNull(), F.col("default_unit")))
    r = r.withColumn("u", unit).withColumn("implausible", Q.is_implausible(F.col("amount.value"), F.col("u.unit")))
    value = F.when(~F.col("implausible"), F.col("amount.value"))
    titrant = F.col("slash") & F.col("norm_name").isin(*TITRANTS) & F.col("amount.value").isNull()
    reason = F.when(F.col("name_canonical").isNull(), X.non_component_reason(F.col("norm_name"), F.col("amount.value").isNotNull()))
    cryo = Q.cryo_evidence(F.col("clause"), F.col("name_canonical"), value, F.col("u.unit"))
    in_scope = F.col("scope").isNotNull() & F.col("name_canonical").isNotNull()
    role = (
        F.when(in_scope, F.col("scope")).when(titrant, "not_a_component").when(reason.isNotNull(), "not_a_component")
        .when(cryo.isNotNull(), "cryo").otherwise(Q.role_of(F.col("chem_class"), F.col("only_buffers")))
    )
    return r.select(
        "text", "clause_index", "clause", "depth", "kind", "ph_text", "scope",
        ((F.col("kind") == "reagent") & ~((F.col("depth") > 0) & F.col("amount.value").isNull())).alias("is_component"),
        "name_raw", "norm_name", *[F.when(~titrant, F.col(c)).alias(c) for c in ("name_canonical", "chem_class", "peg_mw", "is_mme", "buffer_pka")], "match_step",
        value.alias("concentration"), F.when(~F.col("implausible"), F.col("u.unit")).alias("unit"), F.col("u.inferred").alias("unit_inferred"),
        F.col("amount.is_range").alias("concentration_is_range"), F.col("amount.low").alias("range_low"), F.col("amount.high").alias("range_high"),
        F.when(~in_scope, cryo).alias("cryo_evidence"), role.alias("role"), F.when(titrant, "buffer_titrant").otherwise(reason).alias("non_component_reason"), "implausible",
        F.when(F.col("name_canonical").isNotNull(), 1.0).otherwise(0.2).alias("parse_confidence"),
    )


def records(parsed: DataFrame) -> DataFrame:
    """One row per distinct text: counts, pH with its source, temperature in the text, confidence, flags, discard reason."""
    order = Window.partitionBy("text").orderBy("clause_index").rowsBetween(Window.unboundedPreceding, -1)
    stateful = F.when(F.col("is_component"), F.col("role") == "buffer").when(F.col("kind") == "ph", False)
    p = parsed.withColumn("after_buffer", F.coalesce(F.last(stateful, ignorenulls=True).over(order), F.lit(False)))
    ph_numbers = X.numbers_of(F.col("ph_text"))
    ph_value, ph_high = F.get(ph_numbers, F.lit(0)), F.get(ph_numbers, F.lit(1))
    free = F.col("scope").isNull()
    component = F.col("is_component") & (F.coalesce("role", F.lit("")) != "not_a_component")
    first_of = lambda what, cond: F.min_by(what, F.when(cond, F.col("clause_index")))
    on_buffer = F.col("is_component") & (F.col("role") == "buffer") & F.col("ph_text").isNotNull() & free
    # the pH behind a titrant is the pH of the buffer on the other side of the slash
    of_titrant = F.col("is_component") & (F.col("non_component_reason") == "buffer_titrant") & F.col("ph_text").isNotNull() & F.col("after_buffer") & free
    on_buffer = on_buffer | of_titrant
    standalone = (F.col("kind") == "ph") & free
    final = standalone & F.col("clause").startswith("final")
    g = p.groupBy("text").agg(
        F.count_if(F.col("is_component")).alias("n_reagent_clauses"),
        F.count_if(component).alias("n_components"),
        F.count_if(component & F.col("name_canonical").isNotNull()).alias("n_components_identified"),
        F.sum(F.when(component & F.col("name_canonical").isNotNull(), F.length("clause")).otherwise(0)).alias("covered"),
        F.sum(F.when(component, F.length("clause")).otherwise(0)).alias("total"),
        F.max(F.col("kind") == "reference_only").alias("has_reference"),
        first_of(ph_value, final).alias("ph_final"), first_of(ph_value, on_buffer).alias("ph_buffer"),
        first_of(ph_value, standalone & F.col("after_buffer")).alias("ph_after"), first_of(ph_value, standalone).alias("ph_alone"),
        first_of(ph_high, (on_buffer | standalone) & ph_high.isNotNull()).alias("ph_high"),
        first_of(F.regexp_extract("clause", r"protein.*?(\d+(?:\.\d+)?)\s*mg\s*/\s*ml", 1).try_cast("double"), F.col("clause").rlike(r"protein.*\d\s*mg\s*/\s*ml")).alias("protein_concentration_mg_ml"),
        F.max("implausible").alias("any_implausible"), F.max(F.coalesce("unit_inferred", F.lit(False))).alias("any_inferred"), F.max("concentration_is_range").alias("any_range"),
        F.max(F.col("is_component") & (F.col("non_component_reason") == "buffer_titrant")).alias("any_titrant"),
        F.array_sort(F.collect_list(F.when(component & F.col("name_canonical").isNull(), F.struct("clause_index", "norm_name")))).alias("open"),
    )
    ratio = F.nullif(F.regexp_extract(F.lower("text"), r"(?:^|[^\d:])(\d+:\d+)(?![\d:])", 1), F.lit(""))
    confidence = Q.confidence(F.col("n_components_identified"), F.col("n_components"), F.col("covered"), F.col("total"))
    flags = F.array_sort(F.array_compact(F.array(
        F.when(F.col("any_implausible"), "implausible_amount"), F.when(F.col("any_inferred"), "unit_inferred"), F.when(F.col("any_range"), "concentration_range"),
        F.when(F.col("n_reagent_clauses") >= 8, "multi_condition"), F.when(F.col("any_titrant"), "buffer_titrant"),
    )))
    return g.select(
        "text", "n_reagent_clauses", "n_components", "n_components_identified", "protein_concentration_mg_ml", ratio.alias("drop_ratio"),
        F.coalesce("ph_final", "ph_buffer", "ph_after", "ph_alone").alias("ph_text_value"),
        F.when(F.col("ph_final").isNotNull(), "final").when(F.coalesce("ph_buffer", "ph_after").isNotNull(), "buffer").otherwise("unstated").alias("ph_source"),
        F.col("ph_high").isNotNull().alias("ph_is_range"), Q.temperature(F.col("text")).alias("temperature_text"),
        confidence.alias("parse_confidence"), flags.alias("flags"), F.slice("open.norm_name", 1, MOST_UNIDENTIFIED).alias("unidentified"),
        Q.discard_reason(F.col("text"), F.col("n_reagent_clauses"), F.col("n_components_identified"), confidence, F.col("has_reference")).alias("discard_reason"),
    )


def parse(conditions: DataFrame, reagents: DataFrame, text: str = "raw_details") -> tuple[DataFrame, DataFrame]:
    """(records, components by text). Records keep all columns of `conditions` and get the parsed ones with a prefix.

    The join back is a sort-merge join on the text, whose skewed partitions the adaptive execution splits.
    """
    index = local_index(with_premixes(reagents), MAX_ALIASES)
    parsed = parse_clauses(clause_rows(conditions, text, index), index)
    per_text = records(parsed)
    out = conditions.join(per_text.select(F.col("text").alias(text), *[F.col(c).alias(f"parsed_{c}") for c in per_text.columns if c != "text"]), text, "left")
    blank = F.when(X.is_blank(F.col(text)), "EMPTY")
    return out.withColumn("parsed_discard_reason", F.coalesce(blank, "parsed_discard_reason")), parsed.where("is_component")


def of_records(conditions: DataFrame, components: DataFrame, keys: list[str], text: str = "raw_details") -> DataFrame:
    """The components of every record: `keys` of `conditions` beside the columns of `components` but the text.

    The components of a text are one array, as long as the text has clauses, so a text that many records share moves
    as one row; records without components have no rows.
    """
    columns = [c for c in components.columns if c != "text"]
    nested = components.groupBy(F.col("text").alias(text)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_parts"))
    joined = heavy_light_join(conditions.select(*keys, text), nested, text, "inner")
    return joined.select(*keys, F.explode("_parts").alias("_part")).select(*keys, "_part.*")
