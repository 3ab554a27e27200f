"""Readers with explicit schemas. Types are never inferred from data."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brineflow.schemas import ANSWER, RAW_ENTRY


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_batches(spark: SparkSession, path: str, schema: str = RAW_ENTRY) -> DataFrame:
    """Files that hold one JSON array each, gzipped or not, with the file name of each row."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -1))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The rows of an array field of whole-file objects."""
    return spark.read.schema(f"{field} array<{element}>").option("multiLine", True).json(path).select(F.inline(field))


def answers(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, "answers", "struct<id:string,chosen:string,free_text:string>")


def components_of_answers(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("components", F.from_json(text, ANSWER))


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with comment lines and a header, every column a string."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("inferSchema", False).csv(path)
    return rows.select(*columns)


def tsv_behind_header(spark: SparkSession, path: str, prefix: str, columns: list[str]) -> DataFrame:
    """Tab-separated text whose header is the first line that starts with `prefix`, whatever stands before it; every column a string.

    Lines with another number of fields than the header, and repeats of the header, are no rows; without a header the
    table is empty. Only the header comes to the driver.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith(prefix)).orderBy(F.length("value")).first()
    names = head["value"].rstrip("\r\n").split("\t") if head else columns
    fields = F.split(F.rtrim(F.regexp_replace("value", "\r$", "")) if len(names) == 1 else F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith(prefix)).select(fields.alias("f")).where(F.size("f") == len(names))
    return rows.select(*[F.col("f")[names.index(c)].alias(c) for c in columns]) if head else rows.select(*[F.lit(None).cast("string").alias(c) for c in columns]).limit(0)


def verified(found: DataFrame, published: DataFrame) -> DataFrame:
    """(name, status) of files (path, length, md5) against published ones (name, length, md5): ok, size_differs, checksum_differs, missing or unknown."""
    here = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_length"), F.col("md5").alias("_md5"))
    j = published.join(here, "name", "full_outer")
    status = (
        F.when(F.col("_md5").isNull(), "missing").when(F.col("md5").isNull(), "unknown").when(F.col("length") != F.col("_length"), "size_differs")
        .when(F.lower("md5") != F.col("_md5"), "checksum_differs").otherwise("ok")
    )
    return j.select("name", status.alias("status"))


def tsv_pairs(spark: SparkSession, path: str, first: str = "representative", second: str = "member") -> DataFrame:
    return spark.read.schema(f"{first} string, {second} string").option("sep", "\t").csv(path)


def search_hits(spark: SparkSession, path: str, most: int = 25) -> DataFrame:
    """The best hits of each query; short lines and hits of a query on itself are skipped."""
    rows = spark.read.schema("query string, target string, identity double, evalue double, bits double").option("sep", "\t").csv(path)
    rows = rows.where(F.col("bits").isNotNull() & (F.col("query") != F.col("target")))
    best = Window.partitionBy("query").orderBy(F.desc("bits"), F.asc("target"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, sequence): of a header with bars the accession, else its first word; lines joined, upper case."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.upper(F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s+", ""))
    accession = F.when(F.contains(head, F.lit("|")), F.element_at(F.split(head, r"\|"), 2)).otherwise(F.element_at(F.split(F.trim(head), r"\s+"), 1))
    return records.select(accession.alias("id"), F.trim(head).alias("header"), body.alias("sequence"))


def targets_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per <target>: first id, sequence and organism, sets of labs and statuses; the reader streams row tags and never holds a file."""
    schema = (
        "id string, target_id string, sequence string, targetSequence struct<sequence:string>, organism array<string>, "
        "labList struct<lab:array<string>>, lab array<string>, statusList struct<status:array<string>>, status array<string>"
    )
    rows = spark.read.format("xml").option("rowTag", "target").schema(schema).load(path)
    both = lambda a, b: F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))))
    return rows.select(
        F.coalesce("id", "target_id").alias("target_id"), F.upper(F.regexp_replace(F.coalesce("sequence", "targetSequence.sequence"), r"\s+", "")).alias("sequence"),
        F.try_element_at("organism", F.lit(1)).alias("organism"), both(F.col("labList.lab"), F.col("lab")).alias("labs"), both(F.col("statusList.status"), F.col("status")).alias("statuses"),
    )


def residues_xml(spark: SparkSession, path: str) -> DataFrame:
    """(chain, accession, position, observed): residues of <entity> elements with their cross references."""
    schema = "_entityId string, segment array<struct<listResidue:struct<residue:array<struct<_dbResNum:int,crossRefDb:array<struct<_dbSource:string,_dbAccessionId:string,_dbResNum:int>>,residueDetail:array<string>>>>>>"
    rows = spark.read.format("xml").option("rowTag", "entity").schema(schema).load(path)
    r = rows.select(F.col("_entityId").alias("chain"), F.explode("segment").alias("s")).select("chain", F.explode("s.listResidue.residue").alias("r"))
    refs = r.select("chain", F.explode("r.crossRefDb").alias("x"), ~F.coalesce(F.array_contains("r.residueDetail", "Not_Observed"), F.lit(False)).alias("observed"))
    return refs.where(F.col("x._dbSource") == "UniProt").select("chain", F.col("x._dbAccessionId").alias("accession"), F.col("x._dbResNum").alias("position"), "observed")


def html_lines(df: DataFrame, page: str, html: str) -> DataFrame:
    """(page, line, text): visible lines of HTML in order; scripts, styles and comments are dropped."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    lines = df.select(page, F.posexplode(F.split(x, r"\n")).alias("line", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return lines.where("text <> ''")


def page_lines(spark: SparkSession, path: str) -> DataFrame:
    """(page, line, text) of text files, one page per file."""
    whole = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page"), "value")
    return whole.select("page", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of files, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def latest_by_name(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), name).alias("r")).select("r.*")


def mmcif_loops(spark: SparkSession, path: str, category: str, columns: list[str]) -> DataFrame:
    """(path, row, columns) of one category of mmCIF files, as a loop or as key-value pairs; ? and . are null. Arrow batches of whole files."""
    names = [f"_{category}.{c}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], *[[] for _ in columns]]
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, row in enumerate(cif_rows(content.decode("utf-8", "replace"), category)):
                    for column, value in zip(out, (file, n + 1, *[row.get(x) for x in names])):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), *[pa.string()] * len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["path", "row", *columns])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(run, "path string, row int, " + ", ".join(f"`{c}` string" for c in columns))


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of a CIF text: bare words, quoted words and text blocks."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            block = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                block.append(more)
            yield "\n".join(block).strip("\n"), True
            continue
        i, n = 0, len(line)
        while i < n:
            c = line[i]
            if c.isspace():
                i += 1
            elif c == "#":
                break
            elif c in "'\"":
                end = i + 1
                while end < n and not (line[end] == c and (end + 1 == n or line[end + 1].isspace())):
                    end += 1
                yield line[i + 1 : end], True
                i = end + 1
            else:
                end = i
                while end < n and not line[end].isspace():
                    end += 1
                yield line[i:end], False
                i = end


def cif_rows(text: str, category: str) -> list[dict[str, str | None]]:
    prefix = f"_{category}."
    value = lambda t, q: None if not q and t in "?." else t
    tokens = list(cif_tokens(text))
    rows: list[dict[str, str | None]] = []
    single: dict[str, str | None] = {}
    i = 0
    while i < len(tokens):
        token, quoted = tokens[i]
        if not quoted and token.lower() == "loop_":
            heads = []
            i += 1
            while i < len(tokens) and not tokens[i][1] and tokens[i][0].startswith("_"):
                heads.append(tokens[i][0])
                i += 1
            cells = []
            while i < len(tokens) and (tokens[i][1] or not (tokens[i][0].startswith("_") or tokens[i][0].lower() == "loop_" or tokens[i][0].lower().startswith("data_"))):
                cells.append(value(*tokens[i]))
                i += 1
            if heads and heads[0].startswith(prefix):
                rows += [dict(zip(heads, cells[k : k + len(heads)])) for k in range(0, len(cells) - len(heads) + 1, len(heads))]
        elif not quoted and token.startswith(prefix) and i + 1 < len(tokens):
            single[token] = value(*tokens[i + 1])
            i += 2
        else:
            i += 1
    return rows or ([single] if single else [])


def yaml_documents(spark: SparkSession, folder: str, schema: str, field: str | None = None) -> DataFrame:
    """Curated YAML files as a small table; they are read on the driver because they are a hand-kept dimension."""
    import yaml

    rows = []
    for p in sorted(Path(folder).glob("*.yaml")):
        loaded = yaml.safe_load(p.read_text(encoding="utf-8"))
        rows += loaded[field] if field else loaded if isinstance(loaded, list) else [loaded]
    names = [part.split()[0] for part in _columns(schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]
