"""Network services as Spark data sources. The transport is injected, so everything runs and is tested without a network.

One partition is one batch of ids; batches have names by content, so a repeated run skips those already written.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Transport = Callable[[str, bytes | None], bytes]
RETRIED = (429, 500, 502, 503, 504)


class StatusError(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP status {status}")
        self.status = status


def http(url: str, body: bytes | None = None, timeout: float = 60) -> bytes:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"} if body else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read()
    except urllib.error.HTTPError as e:
        raise StatusError(e.code) from e


def retrying(transport: Transport, tries: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Transport:
    """Repeats on busy and server errors with doubled waits; other errors pass at once."""

    def call(url: str, body: bytes | None = None) -> bytes:
        for n in range(tries):
            try:
                return transport(url, body)
            except StatusError as e:
                if e.status not in RETRIED or n == tries - 1:
                    raise
            except OSError:
                if n == tries - 1:
                    raise
            sleep(first_wait * 2**n)
        raise AssertionError

    return call


def id_batches(ids: Sequence[str], size: int) -> list[tuple[str, ...]]:
    return [tuple(ids[i : i + size]) for i in range(0, len(ids), size)]


def batch_name(index: int, ids: Sequence[str]) -> str:
    """A name by content: a changed batch gets another one."""
    return f"{index:05d}-{hashlib.sha256(','.join(ids).encode()).hexdigest()[:16]}"


def graphql(transport: Transport, url: str, query: str, variables: dict) -> dict:
    reply = json.loads(transport(url, json.dumps({"query": query, "variables": variables}).encode()))
    if reply.get("errors"):
        raise ValueError(f"query failed: {reply['errors']}")
    return reply["data"]


def search_all(transport: Transport, url: str, query: dict) -> list[str]:
    """Every id of a search; raises if fewer are returned than counted."""
    reply = json.loads(transport(url, json.dumps(query).encode()))
    found = [r["identifier"] for r in reply["result_set"]]
    if len(found) != reply["total_count"]:
        raise ValueError(f"{len(found)} of {reply['total_count']} ids returned")
    return found


def fetch_bisecting(fetch: Callable[[Sequence[str]], list], ids: Sequence[str]) -> tuple[list, list[str]]:
    """(results, bad ids): a batch refused as malformed is halved until the bad ids are alone."""
    if not ids:
        return [], []
    try:
        return fetch(ids), []
    except StatusError as e:
        if e.status != 400:
            raise
    if len(ids) == 1:
        return [], list(ids)
    middle = len(ids) // 2
    a, bad_a = fetch_bisecting(fetch, ids[:middle])
    b, bad_b = fetch_bisecting(fetch, ids[middle:])
    return a + b, bad_a + bad_b


class _Batch(InputPartition):
    def __init__(self, index: int, ids: tuple[str, ...]):
        super().__init__(index)
        self.index, self.ids = index, ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.url, self.query = options["url"], options.get("query", "")
        self.ids = json.loads(options["ids"])
        self.size = int(options.get("batchsize", options.get("batchSize", 300)))
        self.done = frozenset(json.loads(options.get("done", "[]")))
        self.transport = transport

    def partitions(self) -> list[InputPartition]:
        """One for each batch whose name is not among those done, so a run goes on where another ended."""
        return [_Batch(i, b) for i, b in enumerate(id_batches(self.ids, self.size)) if batch_name(i, b) not in self.done]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        def fetch(ids: Sequence[str]) -> list:
            return graphql(self.transport, self.url, self.query, {"ids": list(ids)})["entries"] or []

        found, bad = fetch_bisecting(fetch, partition.ids)
        name = batch_name(partition.index, partition.ids)
        yield from ((name, json.dumps(entry), None) for entry in found)
        yield from ((name, None, i) for i in bad)


def entry_source(transport: Transport | None = None) -> type[DataSource]:
    """A data source `entries` with options url, query, ids (a JSON list), batchSize and done (a JSON list of batch names to skip); rows are (batch, json, bad_id)."""
    used = retrying(transport or http)

    class EntrySource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "entries"

        def schema(self) -> str:
            return "batch string, json string, bad_id string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(self.options, used)

    return EntrySource


def fetch_files(ids, key: str, url: Callable[[str], str], transport: Transport, known: Callable[[str], bool] = lambda i: False):
    """(key, status, content) of one file per id of a DataFrame: ok, skipped, missing or failed; runs in as many tasks as the ids have partitions."""
    import pyarrow as pa

    call = retrying(transport, tries=3, first_wait=0.1)

    def run(batches):
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                if known(i):
                    rows.append((i, "skipped", None))
                    continue
                try:
                    rows.append((i, "ok", call(url(i), None)))
                except StatusError as e:
                    rows.append((i, "missing" if e.status == 404 else "failed", None))
                except OSError:
                    rows.append((i, "failed", None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=[key, "status", "content"])

    return ids.select(key).mapInArrow(run, f"`{key}` string, status string, content binary")


def transfer_stats(output: str) -> dict[str, int]:
    """Figures of a mirror tool's summary: lines of a label, a colon and a number with commas."""
    import re

    return {m[1].strip().lower().replace(" ", "_"): int(m[2].replace(",", "")) for m in re.finditer(r"^([A-Za-z ]+):\s*([\d,]+)", output, re.M)}


def download(transport: Transport, url: str, path: str, md5: str | None = None) -> str:
    """ok or skipped: one file fetched to `path` by way of a temporary name, so a broken transfer leaves nothing; a file that is there with the right checksum is not fetched again."""
    target = Path(path)
    if target.exists() and (md5 is None or hashlib.md5(target.read_bytes()).hexdigest() == md5):
        return "skipped"
    content = transport(url, None)
    if md5 is not None and hashlib.md5(content).hexdigest() != md5:
        raise ValueError(f"{url}: checksum differs")
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "wb") as f:
        f.write(content)
    os.replace(name, target)
    return "ok"
