"""Problem 8: every text as ids of a public byte-level BPE vocabulary.

A word of the pre-tokenizer is a doubly linked list of byte symbols; a heap holds the ranks of neighbouring pairs.
The lowest rank is merged first, the leftmost of equal ones; entries whose symbols have changed since are skipped.
Each worker keeps the ids of words it has seen, up to ``CACHE_WORDS``, so that a word is merged once per worker.

Null and empty texts give an empty list. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a text is cut before merging (fixed value: the published pattern of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHE_CHARS = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: per line a base64 string and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, in O(n log n) for n bytes."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or parts[i] + parts[j] != pair:
            continue  # stale: one of the two has been merged since
        parts[i], parts[j] = pair, None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair + parts[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + pair))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.ranks = load_ranks(path)
        self.cut = regex.compile(PATTERN).findall
        self.seen: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen, ranks = self.seen, self.ranks
        for word in self.cut(text or ""):
            ids = seen.get(word)
            if ids is None:
                ids = merge_word(word.encode(), ranks)
                if len(word) <= CACHE_CHARS:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "strings"):
            self.strings = {v: k for k, v in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shipped(path: str) -> str:
    """Where this worker has the file: at its path, or where the session has put it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of ``text``. The vocabulary file goes out with the session, so ``path`` need only be there on the driver."""
    df.sparkSession.sparkContext.addFile(path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(shipped(path))
        for batch in batches:
            offsets, values = [0], []
            for t in batch.to_pylist():
                values += own.encode(t)
                offsets.append(len(values))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with ``out``: the text of ``ids``; null ids give null."""
    df.sparkSession.sparkContext.addFile(path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(shipped(path))
        for batch in batches:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.string())

    return df.withColumn(out, texts(F.col(ids)))
