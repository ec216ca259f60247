"""Exact vector match (RT1, WN2): similarity is 1 plus the inner product, larger first, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def usable(vector: Column, dim: int = DIM) -> Column:
    """Not null, of the right length, no null or NaN inside; never null itself."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def query_vector(df: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """One row ``_q``: the vector of the smallest key that has a usable one. Stands in for an embedding model."""
    return df.filter(usable(F.col(vector))).orderBy(key).limit(1).select(F.col(vector).alias("_q"))


def match(df: DataFrame, query: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows of ``df`` most similar to the one query row, with ``similarity``.

    Rows without a usable vector never match. An empty query matches nothing. The query is a single row and is
    broadcast; the top k is taken per partition first.
    """
    scored = df.filter(usable(F.col(vector))).crossJoin(F.broadcast(query.limit(1)))
    scored = scored.withColumn("similarity", F.round(1.0 + inner_product(F.col(vector), F.col("_q")), 9)).drop("_q")
    return scored.orderBy(F.desc("similarity"), key).limit(k)
