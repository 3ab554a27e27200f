"""Semi-structured records to tables and back; nothing empty or repeated is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow.functions.quantity import to_number


def entries(raw: DataFrame) -> DataFrame:
    """One row per growth record of each entry; an entry without any still gives one row with id 1, null fields and count 0."""
    forms = F.col("exptl_crystal_grow")
    rows = raw.select("*", F.posexplode_outer(forms).alias("_pos", "_form"))
    info = F.col("rcsb_entry_info")
    return rows.select(
        F.col("rcsb_id").alias("pdb_id"),
        F.coalesce(F.nullif(F.trim("_form.crystal_id"), F.lit("")), (F.coalesce("_pos", F.lit(0)) + 1).cast("string")).alias("crystal_id"),
        F.coalesce(F.size(forms), F.lit(0)).cast("int").alias("n_crystal_forms"),
        F.exists(F.coalesce("exptl", F.array().cast("array<struct<method:string>>")), lambda x: F.coalesce(x["method"] == "X-RAY DIFFRACTION", F.lit(False))).alias("is_xray"),
        info["experimental_method"].alias("experimental_method"),
        F.transform("exptl", lambda x: x["method"]).alias("exptl_methods"),
        F.col("_form.method").alias("grow_method"),
        to_number(F.col("_form.temp")).alias("temp_k"),
        F.col("_form.temp_details").alias("temp_details"),
        to_number(F.col("_form.pH")).alias("ph_reported"),
        F.col("_form.pdbx_pH_range").alias("ph_range"),
        F.col("_form.pdbx_details").alias("raw_details"),
        F.col("_form.details").alias("grow_details"),
        F.coalesce(F.try_element_at(info["resolution_combined"], F.lit(1)), F.try_element_at(info["identification_combined"], F.lit(1))).alias("resolution_a"),
        info["polymer_entity_count"].alias("polymer_entity_count"),
        *[F.col(f"rcsb_accession_info.{c}").alias(c) for c in ("deposit_date", "initial_release_date", "revision_date", "major_revision", "minor_revision")],
    )


def entities(raw: DataFrame) -> DataFrame:
    """One row per polymer; absent sub-objects give nulls, nulls inside arrays are dropped."""
    rows = raw.select("*", F.explode("polymer_entities").alias("e"))
    ids = "e.rcsb_polymer_entity_container_identifiers"
    organisms = F.col("e.rcsb_entity_source_organism")
    sequence = F.col("e.entity_poly.pdbx_seq_one_letter_code_can")
    return rows.select(
        F.col("rcsb_id").alias("pdb_id"),
        F.coalesce(F.col(f"{ids}.entity_id"), F.substring_index("e.rcsb_id", "_", -1)).alias("entity_id"),
        F.exists(F.coalesce("exptl", F.array().cast("array<struct<method:string>>")), lambda x: F.coalesce(x["method"] == "X-RAY DIFFRACTION", F.lit(False))).alias("is_xray"),
        F.col("e.entity_poly.type").alias("poly_type"),
        F.col("e.entity_poly.pdbx_seq_one_letter_code").alias("seq"),
        sequence.alias("seq_can"),
        F.coalesce(F.col("e.entity_poly.rcsb_sample_sequence_length"), F.length(sequence)).cast("bigint").alias("seq_length"),
        F.col("e.entity_poly.pdbx_strand_id").alias("strand_ids"),
        F.col("e.rcsb_polymer_entity.pdbx_description").alias("description"),
        F.col("e.rcsb_polymer_entity.formula_weight").alias("formula_weight"),
        *[F.col(f"{ids}.{c}").alias(c) for c in ("uniprot_ids", "asym_ids", "auth_asym_ids")],
        not_null(F.transform(organisms, lambda x: x["ncbi_scientific_name"])).alias("source_organisms"),
        not_null(F.transform(organisms, lambda x: x["ncbi_taxonomy_id"])).alias("source_taxids"),
    )


def not_null(values: Column) -> Column:
    return F.coalesce(F.array_compact(values), F.array())


def outer_elements(df: DataFrame, key: str, values: str, out: str) -> DataFrame:
    """(key, position from 1, value, n): one row per element, and one for a null or empty array."""
    return df.select(key, F.coalesce(F.size(values), F.lit(0)).alias("n"), F.posexplode_outer(values).alias("_p", out)).select(
        key, (F.coalesce("_p", F.lit(0)) + 1).cast("int").alias("position"), out, F.greatest("n", F.lit(0)).cast("int").alias("n")
    )


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order, with the number of rows it stands for."""
    by_key = Window.partitionBy(*keys)
    return df.withColumn("_rn", F.row_number().over(by_key.orderBy(*order))).withColumn("n_copies", F.count(F.lit(1)).over(by_key)).where("_rn = 1").drop("_rn")


def nest(children: DataFrame, keys: list[str], order: str, fields: list[str], out: str) -> DataFrame:
    """Children as one array per key, in order."""
    element = F.struct(F.col(order), *[F.col(f) for f in fields if f != order])
    return children.groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias(out))


def attach(parents: DataFrame, nested: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Parents with their nested children; those without any get an empty array."""
    return parents.join(nested, keys, "left").withColumn(out, F.coalesce(out, F.array()))


def ordered_union(df: DataFrame, keys: list[str], order: str, values: str, out: str) -> DataFrame:
    """Distinct union of arrays per key in order of first occurrence."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(values).alias("v")))), lambda x: x["v"])
    return df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull()))).alias(out))


def optional(present: Column, *fields: Column) -> Column:
    """A nested object that is null, not empty, where it is absent."""
    return F.when(present, F.struct(*fields))
