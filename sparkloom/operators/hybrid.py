"""Reciprocal rank fusion of a text arm and a vector arm (RT3-RT6, JN1, JN2, WN1, WN2, TK1), reranking (RT7), overlap search (RT9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.text import word_array
from sparkloom.operators import fulltext, vector

#: Smoothing of the reciprocal ranks: of pages and of code (fixed values).
K_PAGES, K_CODE = 50, 60
MOST = 30


def fuse(pages: DataFrame, text: str, query_text: str, query: DataFrame, count: int, smooth: int, text_weight: float = 1.0, vector_weight: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, text_rank, vector_rank, rrf_score, similarity`` of the best rows of both arms, and the columns ``carry``, which ride along so that the table isn't read again.

    Each arm gives min(count, 30) * 2 rows. A row that only one arm has keeps a null for the other. Ties go to the
    smaller id. Rows with a null id take no part.
    """
    depth = min(count, MOST) * 2
    rows = pages.filter(F.col("id").isNotNull())
    arm_t = fulltext.rank(rows.select("id", text, *[c for c in carry if c != text]), text, query_text, depth).select("id", "text_score", F.struct(*(carry or ("id",))).alias("_t"))
    arm_v = vector.match(rows.select("id", "embedding", *carry), query, depth).select("id", "similarity", F.struct(*(carry or ("id",))).alias("_v"))
    a = arm_t.select("id", "_t", F.row_number().over(W.orderBy(F.desc("text_score"), "id")).cast("long").alias("text_rank"))
    b = arm_v.select("id", "similarity", "_v", F.row_number().over(W.orderBy(F.desc("similarity"), "id")).cast("long").alias("vector_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(1.0) / (F.lit(float(smooth)) + F.col(rank)), F.lit(0.0)) * F.lit(weight)
    both = a.join(b, "id", "full").withColumn("_c", F.coalesce("_t", "_v"))
    return both.select("id", *[F.col("_c")[c].alias(c) for c in carry], "text_rank", "vector_rank", F.round(part("text_rank", text_weight) + part("vector_rank", vector_weight), 9).alias("rrf_score"), "similarity")


def search_pages(pages: DataFrame, query_text: str, query: DataFrame, count: int = 10, source: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Hybrid search over pages; ``source`` (a host in the metadata) restricts both arms before they rank. ``more``: further columns of the found rows."""
    rows = pages if source is None else pages.filter(F.col("metadata.source") == source)
    found = fuse(rows, "content", query_text, query, count, K_PAGES, carry=("url", "chunk_number", *more))
    return found.orderBy(F.desc("rrf_score"), "id").limit(min(count, MOST)).select("id", "url", "chunk_number", *more, "text_rank", "vector_rank", "rrf_score")


def search_code(code: DataFrame, query_text: str, query: DataFrame, count: int = 10, language: str | None = None, least: int = 1, most: int = 10) -> DataFrame:
    """Hybrid search over code: language and the upper bound of complexity filter both arms, the lower bound the result.

    Bounds are clamped to 1..10 and the count to 1..30. Null scores never pass a bound. ``similarity`` is null for rows
    that only the text arm has.
    """
    count, least, most = min(max(count, 1), MOST), min(max(least, 1), 10), min(max(most, 1), 10)
    rows = code.filter(F.col("complexity_score") <= most)
    if language is not None:
        rows = rows.filter(F.col("programming_language") == language)
    rows = rows.withColumn("_text", F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("summary", F.lit(""))))
    top = fuse(rows, "_text", query_text, query, count, K_CODE, carry=("url", "programming_language", "complexity_score")).orderBy(F.desc("rrf_score"), "id").limit(count)
    found = top.filter(F.col("complexity_score") >= least)
    place = F.row_number().over(W.orderBy(F.desc("rrf_score"), "id"))  # at most MOST rows
    return found.select(
        place.cast("int").alias("position"), "id", "url", "programming_language", "complexity_score", F.round("similarity", 4).alias("similarity"), F.round("rrf_score", 4).alias("rrf_score"), "text_rank", "vector_rank"
    )


def word_overlap(query_text: str, text: Column) -> Column:
    """The share of a query's words that a text has; stands in for a cross-encoder."""
    words = sorted(set(fulltext._WORD.findall(query_text.lower())))
    own = F.array_distinct(word_array(F.coalesce(text, F.lit(""))))
    hit = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    return hit / F.lit(float(max(1, len(words))))


Scorer = Callable[[str, Column], Column]


def rerank(found: DataFrame, text: str, query_text: str, keep: int = 5, consider: int = 20, score: str = "rrf_score", scorer: Scorer | None = word_overlap) -> DataFrame:
    """The ``consider`` best rows ordered anew by a scorer of (query, text), ties in the old order; ``keep`` of them (RT7).

    A scorer gives a Column: a built-in expression or an Arrow function of a model. Without one, or where it gives null,
    the old order stays: such rows have no ``rerank_score`` and come after those that have.
    """
    first = found.withColumn("prev_rank", F.row_number().over(W.orderBy(F.desc(score), "id")).cast("int")).filter(F.col("prev_rank") <= consider)
    scored = first.withColumn("rerank_score", F.round(scorer(query_text, F.col(text)), 6) if scorer else F.lit(None).cast("double"))
    return scored.withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last("rerank_score"), "prev_rank")).cast("int")).filter(F.col("position") <= keep)


#: Queries that ride on one broadcast row at most; more are joined by word.
SENT_QUERIES = 10_000


def overlap_search(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """``query, key, relevance, place``: per query the k documents with the largest share of its words (RT9).

    Up to ``SENT_QUERIES`` distinct queries go to the documents as one row: a document keeps the wanted words alone and
    is held against each query where it lies, so only hits move, the best k of a partition first. Null queries and
    texts take no part.
    """
    wanted = queries.filter(F.col("query").isNotNull()).select("query").distinct().withColumn("_words", F.array_distinct(word_array(F.col("query")))).filter(F.size("_words") > 0)
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.array_distinct(word_array(F.col(text))).alias("_own"))
    if wanted.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES:
        sent = wanted.agg(F.collect_list(F.struct("query", "_words")).alias("_qs"), F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_all"))
        rows = texts.crossJoin(F.broadcast(sent)).withColumn("_own", F.array_intersect("_own", "_all")).filter(F.size("_own") > 0)  # one row
        shares = F.transform("_qs", lambda q: F.struct(q["query"].alias("query"), (F.size(F.array_intersect(q["_words"], F.col("_own"))) / F.size(q["_words"])).alias("_s")))
        hits = rows.select("_key", F.inline(F.filter(shares, lambda x: x["_s"] > 0)))
    else:
        by_word = wanted.select("query", F.size("_words").alias("_n"), F.explode("_words").alias("_w"))
        hits = texts.select("_key", F.explode("_own").alias("_w")).join(by_word, "_w").groupBy("query", "_n", "_key").agg(F.count(F.lit(1)).alias("_h")).select("_key", "query", (F.col("_h") / F.col("_n")).alias("_s"))
    scored = hits.select("query", F.col("_key").alias(key), F.round("_s", 6).alias("relevance"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("relevance"), key))
    return scored.withColumn("place", place.cast("int")).filter(F.col("place") <= k)
