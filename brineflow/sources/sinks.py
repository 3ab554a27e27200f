"""Writers. Spark's committers make every write atomic."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.runtime.manifest import write_atomically
from brineflow.schemas import json_schema


def parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    df.write.mode(mode).option("compression", compression).option("header", True).csv(path)


def worklist(df: DataFrame, path: str, to_fill: list[str], mode: str = "errorifexists") -> None:
    """A CSV with blank columns to be filled by hand."""
    csv(df.withColumns({c: F.lit("") for c in to_fill}), path, mode, "none")


def fasta(df: DataFrame, key: str, sequence: str, path: str, mode: str = "errorifexists") -> None:
    df.where(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")).write.mode(mode).text(path)


def tables(df_by_name: dict[str, DataFrame], views: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Tables of the session's catalogue with views over them."""
    spark = next(iter(df_by_name.values())).sparkSession
    for name, df in df_by_name.items():
        df.write.mode(mode).saveAsTable(name)
    for name, sql in (views or {}).items():
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")


def bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """A table whose later joins on `key` need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def schema_file(df: DataFrame, path: str | Path, title: str) -> None:
    write_atomically(path, json.dumps(json_schema(df.schema, title), indent=1))


def yaml_file(payload: dict, path: str | Path, dry_run: bool = False) -> str:
    import yaml

    text = yaml.safe_dump(payload, allow_unicode=True, sort_keys=False)
    if not dry_run:
        write_atomically(path, text)
    return text


def payload(df: DataFrame, path: str | Path, meta: dict, most: int = 100_000) -> int:
    """A bounded table as one JSON document for a review tool."""
    rows = [json.loads(r) for r in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one document")
    write_atomically(path, json.dumps({**meta, "records": rows}, ensure_ascii=False))
    return len(rows)


def rewrite_yaml(path: str | Path, change: Callable[[dict], dict], dry_run: bool = False) -> dict:
    """A YAML document changed by `change`, with the last number of its `version` raised and the comments before its first key kept; nothing is written in a dry run."""
    import yaml

    text = Path(path).read_text(encoding="utf-8")
    comments = "".join(itertools.takewhile(lambda x: x.startswith("#") or not x.strip(), text.splitlines(keepends=True)))
    payload = change(yaml.safe_load(text))
    head, _, last = str(payload.get("version", "0")).rpartition(".")
    payload["version"] = f"{head}.{int(last) + 1}" if head else str(int(last) + 1)
    if not dry_run:
        write_atomically(path, comments + yaml.safe_dump(payload, allow_unicode=True, sort_keys=False))
    return payload
