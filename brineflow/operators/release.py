"""Release of records: assembly, flat tables, statistics, SQL views, sinks and the datasheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow.operators.flatten import attach, nest, optional, ordered_union

KEY = ["pdb_id", "crystal_id"]
COMPONENT_FIELDS = ["component_index", "role", "name_raw", "name_canonical", "chem_class", "concentration", "unit", "unit_inferred", "cryo_evidence", "premix_id"]


def unique_records(conditions: DataFrame) -> DataFrame:
    """One row per record key in common form, the one loaded last, ties to the larger id."""
    c = conditions.withColumn("pdb_id", F.upper(F.trim("pdb_id")))
    fields = F.struct(*[F.col(x) for x in c.columns])
    return c.groupBy(*KEY).agg(F.max_by(fields, F.struct("loaded_at", "record_id")).alias("r")).select("r.*")


def assemble(conditions: DataFrame, components: DataFrame, entities: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Nested records: components in order, sequence accessions, an optional screen match that is null where there is none."""
    keep = [c for c in conditions.columns if c not in ("record_id", "flags")]
    nested = nest(components, ["record_id"], "component_index", COMPONENT_FIELDS, "components")
    out = attach(conditions, nested, ["record_id"], "components")
    accessions = ordered_union(entities, ["pdb_id"], "entity_id", "uniprot_ids", "uniprot_ids")
    organisms = ordered_union(entities, ["pdb_id"], "entity_id", "source_organisms", "organisms")
    out = out.join(accessions.join(organisms, "pdb_id"), "pdb_id", "left")
    if matches is not None:
        out = out.join(matches, "record_id", "left").withColumn("screen_match", optional(F.col("well_id").isNotNull(), F.col("well_id"), F.col("kind"))).drop("well_id", "kind", "score")
        keep = [*keep, "screen_match"]
    return out.select("record_id", *keep, F.coalesce("flags", F.array()).alias("flags"), F.coalesce("uniprot_ids", F.array()).alias("uniprot_ids"), F.coalesce("organisms", F.array()).alias("organisms"), "components", F.col("discard_reason").isNull().alias("is_usable"))


def flat_records(conditions: DataFrame, dimensions: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Records with any number of dimensions by left joins; a dimension is broadcast only if Spark's size limit allows it."""
    out = conditions
    for dim, keys in dimensions:
        out = out.join(dim, keys, "left")
    return out


def statistics(conditions: DataFrame) -> DataFrame:
    """One row of counts in a single pass."""
    usable = F.col("discard_reason").isNull()
    return conditions.agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("pdb_id").alias("n_entries"), F.count_if(usable).alias("n_usable"),
        (F.count_if(usable) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("usable_share"), F.coalesce(F.sum("n_components"), F.lit(0)).alias("n_components"),
        F.coalesce(F.sum("n_components_identified"), F.lit(0)).alias("n_identified"), F.median("parse_confidence").alias("median_confidence"),
    )


def union_evolving(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; missing columns become typed nulls, shared ones are cast to the left type, values that cannot be cast become null."""
    kinds = dict(left.dtypes)
    cast = [F.col(c).cast("string").try_cast(kinds[c]).alias(c) if c in kinds and kind != kinds[c] else F.col(c) for c, kind in right.dtypes]
    return left.unionByName(right.select(*cast), allowMissingColumns=True)


VIEWS = {
    "usable_conditions": "SELECT * FROM conditions WHERE discard_reason IS NULL",
    "condition_components": """
        SELECT c.record_id, c.pdb_id, c.crystal_id, c.ph, c.temperature_k, k.component_index, k.role, k.name_canonical, k.chem_class, k.concentration, k.unit, k.unit_inferred, k.cryo_evidence
        FROM conditions c JOIN components k ON c.record_id = k.record_id WHERE c.discard_reason IS NULL""",
}


def register_views(spark: SparkSession, conditions: DataFrame, components: DataFrame) -> None:
    """The release's SQL surface: two tables and two views, for any query in Spark SQL."""
    conditions.createOrReplaceTempView("conditions")
    components.createOrReplaceTempView("components")
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def datasheet(stats: DataFrame, by_reason: DataFrame, title: str = "Datasheet") -> str:
    """A Markdown datasheet from live aggregates."""
    row = stats.first().asDict()
    lines = [f"# {title}", "", "| Figure | Value |", "|---|---|", *[f"| {k} | {v:,} |" if isinstance(v, (int, float)) else f"| {k} | {v} |" for k, v in row.items()]]
    lines += ["", "## Records set aside", "", "| Reason | Records |", "|---|---|", *[f"| {r['discard_reason']} | {r['n']:,} |" for r in by_reason.orderBy(F.desc("n"), "discard_reason").collect()]]
    return "\n".join(lines) + "\n"
