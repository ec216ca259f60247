"""Interfaces of models that a service would provide, and local ones that need none (RT10, RT7, MD9, CD13).

An embedder, a context writer and a reranker are each a function from Columns to a Column, so that any Arrow function or
built-in expression can take their place.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class ContextWriter(Protocol):
    def __call__(self, document: Column, chunk: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed counts of hashed words, of unit length; the zero vector for null and for texts without words."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed


def template_writer(limit: int = 25_000) -> ContextWriter:
    """The kind of a chunk's document and its size, from the first ``limit`` characters of the document."""

    def write(document: Column, chunk: Column) -> Column:
        head = F.regexp_extract(F.substring(document, 1, limit), r"(?m)^#+[ \t]+([^\r\n]+)", 1)
        return F.when(chunk.isNull(), None).when(head == "", chunk).otherwise(F.concat(F.lit("[DOCUMENT] "), head, F.lit("\n---\n"), chunk))

    return write


def overlap_reranker() -> Reranker:
    """The share of the query's words that the text has; 0 without words."""

    def score(query: Column, text: Column) -> Column:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
        return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query))), F.lit(0.0))

    return score
