"""Queries of the operators of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow.llm import containers, format_duplicates, personal_data, reagent_mapping, related_splits, split_overlap, term_counts, tokenizer_automaton
from brineflow.runtime.session import table

CONTAINER_TOKENS = 2048
SPLIT_SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.duplicate_sets(table(spark, sf_dir, "conditions"), "record_id", "raw_details", "source")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlap.cross_split_pairs(table(spark, sf_dir, "conditions"), "record_id", "raw_details", "pdb_id", "split", "source")
    return pairs.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, sf_dir, "conditions"), "record_id", "raw_details", "pdb_id", "split", "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, sf_dir, "components"), ["name_raw", "name_canonical"], "record_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reagent_mapping.map_names(table(spark, sf_dir, "components"), "component_id", "name_raw", "name_canonical", table(spark, sf_dir, "reagents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.related_groups(table(spark, sf_dir, "conditions"), "record_id", "cluster_30", "pdb_id")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.split_records(table(spark, sf_dir, "conditions"), "record_id", "cluster_30", "pdb_id", SPLIT_SHARES)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_automaton.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    sizes = tokenizer_automaton.token_counts(documents, "doc_id", "text")
    return containers.fill_containers(sizes, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.mentions(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redact(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_TERM = r"trim(regexp_replace(lower({0}), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "p4_found": f"""
        WITH stacked AS (
            SELECT 'name_raw' AS field, {_TERM.format("name_raw")} AS term, record_id FROM components
            UNION ALL
            SELECT 'name_canonical' AS field, {_TERM.format("name_canonical")} AS term, record_id FROM components
        ), counted AS (
            SELECT field, term, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM stacked WHERE term <> '' GROUP BY field, term
        )
        SELECT field, term, n_rows, n_records,
               CASE WHEN n_records <= 2 THEN 'rare'
                    WHEN n_records > 0.05 * (SELECT count(DISTINCT record_id) FROM components) THEN 'common'
                    ELSE 'useful' END AS mark
        FROM counted
    """,
}
