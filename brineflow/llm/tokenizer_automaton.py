"""Byte-level BPE as a deterministic automaton over tokens, compiled from the merge list.

One gadget is applied per merge (u, v), in order: the state that u-arcs lead to is copied without its v-arc, the
u-arcs are led to the copy, and every state that had a u-arc gets an arc for the merged token into the state v-arcs
lead to. A path from the start state spells a text exactly if its labels are the BPE tokens of that text, so each
prefix of a word has one path. Each gadget adds one state, a copy that lacks one arc, so a state is kept as the
token its arcs come from and the number of gadgets applied when it arose; whether it has an arc follows from those
two numbers and is entered in a transition table on first use. Encoding a pre-split word runs over its bytes once
with table look-ups; decoding emits the labels of the arcs.

Defined results: null and empty text give an empty list. Vocabulary files are read from a path given as parameter,
on the driver only; executors get the compiled tables.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.runtime.session import ship_code, spread

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before the merges, with white space in the Unicode sense.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and transitions remembered per Python worker.
_MOST_WORDS = 300_000
_MOST_ARCS = 2_000_000
_LATER = 1 << 60


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    folder = folder or os.environ.get("BRINEFLOW_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The compiled tables: for each token its bytes, its two parts, and the number of its merge (-1 for a byte)."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, born: np.ndarray):
        self.tokens = tokens
        self.left, self.right, self.born = left.tolist(), right.tolist(), born.tolist()
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.longest = max(map(len, tokens))
        self.merge = {(a, b): n for a, b, n in zip(self.left, self.right, self.born) if n >= 0}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)

    @classmethod
    def compile(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        size = max(model["vocab"].values()) + 1
        tokens = [b""] * size
        for text, i in model["vocab"].items():
            if all(c in letters for c in text):
                tokens[i] = bytes(letters[c] for c in text)
        left, right, born = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = model["vocab"][a + b]
            left[i], right[i], born[i] = model["vocab"][a], model["vocab"][b], n
        for i, t in enumerate(tokens):  # what no merge makes, such as special tokens, has no arc
            if len(t) > 1 and born[i] < 0:
                tokens[i] = b""
        return cls(tokens, left, right, born)

    def __getstate__(self):
        return self.tokens, np.array(self.left), np.array(self.right), np.array(self.born)

    def __setstate__(self, state):
        self.__init__(*state)

    def _usable(self, token: int) -> bool:
        """Whether the gadget of a token had an arc to build on; a merge whose parts never meet has none."""
        known = self.whole.get(token)
        if known is None:
            n = self.born[token]
            known = n < 0 or (self._usable(self.left[token]) and self._usable(self.right[token]) and self._has(self.left[token], n, self.right[token]))
            self.whole[token] = known
        return known

    def _has(self, owner: int, gadgets: int, token: int) -> bool:
        """Whether the state that `owner`-arcs led to after that many gadgets has an arc for `token`."""
        while True:
            if self.merge.get((owner, token), _LATER) < gadgets:
                return False  # this gadget took the arc away
            if self.born[owner] <= self.born[token] and self.born[token] >= 0:
                if not self._usable(token):
                    return False
                gadgets, token = min(gadgets, self.born[token] + 1), self.left[token]
            elif self.born[owner] < 0:
                return True
            else:
                owner, gadgets = self.right[owner], self.born[owner]

    def arc(self, last: int, token: int) -> bool:
        key = (last, token)
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= _MOST_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._usable(token) and self._has(last, _LATER, token)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells `word`."""
        whole = self.ids.get(word)
        if whole is not None and self._usable(whole):
            return [whole]
        ids, arc, longest = self.ids, self.arc, self.longest
        n = len(word)
        last = [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(word[start:end])
                if token is not None and (self._usable(token) if start == 0 else arc(last[start], token)):
                    last[end] = token
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(self.tokens[last[n]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for word in self.split.findall(text):
            found = words.get(word)
            if found is None:
                found = self.encode_word(word.encode())
                if len(word) <= 64:
                    if len(words) >= _MOST_WORDS:
                        words.clear()
                    words[word] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def compiled(path: str) -> Automaton:
    return Automaton.compile(path)


def _shared(df: DataFrame, path: str | None):
    ship_code(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(compiled(path or vocabulary_path()))


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row."""
    shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    narrow = spread(df.select(F.col(key), F.col(text)))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; only the counts leave the Python worker."""
    shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    narrow = spread(df.select(F.col(key), F.col(text)))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) by the labels of the arcs; null and empty lists give an empty text."""
    shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    narrow = df.select(F.col(key), F.col(ids))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, text string")
