"""Provenance and checks: manifests written even on failure, fingerprints of inputs, expectations on tables."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import tempfile
import time
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import brineflow

LARGEST_HASHED = 4 << 30


def file_digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def describe(path: str | Path) -> dict:
    """Size and digest of a file, or of the listing of a folder; a missing path is described as such."""
    p = Path(path)
    if p.is_dir():
        listing = "\n".join(f"{f.relative_to(p)}\t{f.stat().st_size}" for f in sorted(p.rglob("*")) if f.is_file())
        return {"path": str(p), "kind": "folder", "n_files": listing.count("\n") + bool(listing), "sha256_listing": hashlib.sha256(listing.encode()).hexdigest()}
    if not p.exists():
        return {"path": str(p), "kind": "missing"}
    size = p.stat().st_size
    return {"path": str(p), "kind": "file", "bytes": size, "sha256": file_digest(p) if size <= LARGEST_HASHED else None}


def git_state(folder: str | Path = ".") -> dict | None:
    run = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True)
    head = run("rev-parse", "HEAD")
    return None if head.returncode else {"commit": head.stdout.strip(), "dirty": bool(run("status", "--porcelain").stdout.strip())}


def write_atomically(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


@contextmanager
def manifest(stage: str, path: str | Path, params: dict | None = None, inputs: list[str] = (), outputs: list[str] = ()):
    """Yields a dict for notes; the manifest is written whether the stage ends or raises."""
    record: dict = {"stage": stage, "status": "ok", "error": None, "started_at": datetime.now(UTC).isoformat(), "versions": {"brineflow": brineflow.__version__}, "params": params or {}, "notes": {}}
    record["environment"] = {"python": platform.python_version(), "system": platform.system()}
    record["git"] = git_state()
    record["inputs"] = [describe(p) for p in inputs]
    began = time.monotonic()
    try:
        yield record["notes"]
    except BaseException as e:
        record["status"], record["error"] = "failed", f"{type(e).__name__}: {e}"
        raise
    finally:
        record["wall_seconds"] = round(time.monotonic() - began, 3)
        record["outputs"] = [describe(p) for p in outputs]
        write_atomically(path, json.dumps(record, indent=1, sort_keys=True))


def latest(folder: str | Path, pattern: str) -> Path | None:
    """The last file by sorted name."""
    files = sorted(Path(folder).glob(pattern))
    return files[-1] if files else None


def expect_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` if its key is unique; Spark has no enforced keys."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*keys)).alias("d")).first()
    if row["n"] != row["d"]:
        raise ValueError(f"{row['n'] - row['d']} repeated keys {keys}")
    return df


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`df` if every rule holds on every row; one aggregate counts the violations of all rules."""
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    broken = {k: v for k, v in row.asDict().items() if v}
    if broken:
        raise ValueError(f"violated: {broken}")
    return df
