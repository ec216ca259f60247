"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import fulltext, hybrid, vector
from sparkloom.session import table

TEXT_QUERY, CODE_QUERY, WEB_QUERY = "cache replica", "return", 'token or secret "data center" -gateway'
LANGUAGE, SOURCE = "python", "docs.cobeleflow.example"


def rt1_vector_match(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return vector.match(pages.select("id", "url", "embedding"), vector.query_vector(pages), 20).select("id", "url", "similarity")


def rt1_vector_match_filtered(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    own = pages.filter((F.col("metadata.source") == SOURCE) & (F.col("chunk_number") == 0))
    return vector.match(own.select("id", "url", "embedding"), vector.query_vector(pages), 20).select("id", "url", "similarity")


def rt2_fulltext_rank(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.rank(table(spark, d, "crawled_pages").select("id", "url", "content"), "content", TEXT_QUERY, 30).select("id", "url", "text_score")


def flt11_websearch_match(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.rank(table(spark, d, "crawled_pages").select("id", "content"), "content", WEB_QUERY).select("id", "text_score")


def rt3_hybrid_rrf_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return hybrid.search_pages(pages, TEXT_QUERY, vector.query_vector(pages), 10)


def rt5_hybrid_rrf_source(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return hybrid.search_pages(pages, TEXT_QUERY, vector.query_vector(pages), 5, source=SOURCE)


def rt6_code_search(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "code_examples")
    return hybrid.search_code(code, CODE_QUERY, vector.query_vector(code), 20, language=LANGUAGE, least=2, most=8)


def rt7_rerank(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    found = hybrid.search_pages(pages, TEXT_QUERY, vector.query_vector(pages), 30, more=("content",))
    return hybrid.rerank(found, "content", TEXT_QUERY).select("position", "id", "rerank_score", "prev_rank", "text_rank", "vector_rank")


def rt8_contextual_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of RT5 over contextual rows, marked as such."""
    return rt3_hybrid_rrf_pages(spark, d).withColumn("contextual", F.lit(True))


def rt9_overlap_relevance(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.overlap_search(table(spark, d, "search_metrics"), table(spark, d, "crawled_pages"), "id", "content").select("query", "id", "relevance", "place")


QUERIES = {f.__name__: f for f in (rt1_vector_match, rt1_vector_match_filtered, rt2_fulltext_rank, flt11_websearch_match, rt3_hybrid_rrf_pages, rt5_hybrid_rrf_source, rt6_code_search, rt7_rerank, rt8_contextual_search, rt9_overlap_relevance)}


def _usable(t: str, where: str = "true") -> str:
    return f"SELECT * FROM {t} WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND {where}"


def _query(t: str) -> str:
    return f"SELECT embedding AS q FROM ({_usable(t)}) ORDER BY id LIMIT 1"


def _similar(t: str, where: str = "true") -> str:
    return f"SELECT u.*, round(1.0 + list_inner_product(CAST(u.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), 9) AS similarity FROM ({_usable(t, where)}) u, ({_query(t)}) q"


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _text(t: str, text: str, words: list[str], where: str = "true") -> str:
    every = " AND ".join(f"list_contains(tok, '{w}')" for w in words)
    some = ", ".join(f"'{w}'" for w in words)
    return f"SELECT *, round(len(list_filter(tok, lambda x: x IN ({some}))) / len(tok), 9) AS text_score FROM (SELECT *, {TOKENS.format(text)} AS tok FROM {t} WHERE {where}) WHERE {every}"


def _fused(t: str, text: str, words: list[str], depth: int, smooth: int, where: str = "true") -> str:
    return f"""
        a AS (SELECT id, row_number() OVER (ORDER BY text_score DESC, id) AS text_rank FROM ({_text(t, text, words, where)}) ORDER BY text_score DESC, id LIMIT {depth}),
        b AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS vector_rank FROM ({_similar(t, where)}) ORDER BY similarity DESC, id LIMIT {depth}),
        f AS (SELECT coalesce(a.id, b.id) AS id, text_rank, vector_rank, similarity,
                     round(coalesce(1.0::DOUBLE / ({smooth} + text_rank), 0) + coalesce(1.0::DOUBLE / ({smooth} + vector_rank), 0), 9) AS rrf_score FROM a FULL JOIN b ON a.id = b.id)"""


_WORDS = TEXT_QUERY.split()
_BY_SOURCE = f"metadata.source = '{SOURCE}'"

SQL = {
    "rt1_vector_match": f"SELECT id, url, similarity FROM ({_similar('crawled_pages')}) ORDER BY similarity DESC, id LIMIT 20",
    # The query row is that of the whole table, the searched rows are filtered.
    "rt1_vector_match_filtered": f"SELECT id, url, similarity FROM ({_similar('crawled_pages', _BY_SOURCE + ' AND chunk_number = 0')}) ORDER BY similarity DESC, id LIMIT 20",
    "rt2_fulltext_rank": f"SELECT id, url, text_score FROM ({_text('crawled_pages', 'content', _WORDS)}) ORDER BY text_score DESC, id LIMIT 30",
    "flt11_websearch_match": f"""SELECT id, round(len(list_filter(tok, lambda x: x IN ('token', 'secret', 'data', 'center'))) / len(tok), 9) AS text_score
        FROM (SELECT id, {TOKENS.format('content')} AS tok FROM crawled_pages)
        WHERE (list_contains(tok, 'token') OR list_contains(tok, 'secret')) AND NOT list_contains(tok, 'gateway') AND contains(' ' || array_to_string(tok, ' ') || ' ', ' data center ')""",
    "rt3_hybrid_rrf_pages": f"""WITH {_fused('crawled_pages', 'content', _WORDS, 20, 50)}
        SELECT f.id, url, chunk_number, text_rank, vector_rank, rrf_score FROM (SELECT * FROM f ORDER BY rrf_score DESC, id LIMIT 10) f JOIN crawled_pages USING (id)""",
    "rt5_hybrid_rrf_source": f"""WITH {_fused('crawled_pages', 'content', _WORDS, 10, 50, _BY_SOURCE)}
        SELECT f.id, url, chunk_number, text_rank, vector_rank, rrf_score FROM (SELECT * FROM f ORDER BY rrf_score DESC, id LIMIT 5) f JOIN crawled_pages USING (id)""",
    "rt6_code_search": f"""WITH {_fused('code_examples', "coalesce(content, '') || ' ' || coalesce(summary, '')", [CODE_QUERY], 40, 60, f"programming_language = '{LANGUAGE}' AND complexity_score <= 8")}
        SELECT CAST(row_number() OVER (ORDER BY f.rrf_score DESC, f.id) AS INTEGER) AS position, f.id, url, programming_language, complexity_score, round(similarity, 4) AS similarity,
               round(rrf_score, 4) AS rrf_score, text_rank, vector_rank
        FROM (SELECT * FROM f ORDER BY rrf_score DESC, id LIMIT 20) f JOIN code_examples USING (id) WHERE complexity_score >= 2""",
    "rt7_rerank": f"""WITH {_fused('crawled_pages', 'content', _WORDS, 60, 50)},
        t AS (SELECT *, CAST(row_number() OVER (ORDER BY rrf_score DESC, id) AS INTEGER) AS prev_rank FROM f ORDER BY rrf_score DESC, id LIMIT 20),
        s AS (SELECT t.*, round(len(list_intersect(list_distinct({TOKENS.format("coalesce(content, '')")}), ['cache', 'replica'])) / 2.0, 6) AS rerank_score FROM t JOIN crawled_pages USING (id)),
        r AS (SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, prev_rank) AS INTEGER) AS position FROM s)
        SELECT position, id, rerank_score, prev_rank, text_rank, vector_rank FROM r WHERE position <= 5""",
    "rt9_overlap_relevance": f"""
        WITH q AS (SELECT query, list_distinct({TOKENS.format('query')}) AS w FROM (SELECT DISTINCT query FROM search_metrics WHERE query IS NOT NULL)),
             qw AS (SELECT query, len(w) AS n, unnest(w) AS word FROM q),
             dw AS (SELECT id, unnest(list_distinct({TOKENS.format('content')})) AS word FROM crawled_pages WHERE content IS NOT NULL),
             s AS (SELECT query, id, round(count(*) / any_value(n), 6) AS relevance FROM qw JOIN dw USING (word) GROUP BY query, id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY relevance DESC, id) AS INTEGER) AS place FROM s)
        SELECT query, id, relevance, place FROM r WHERE place <= 10""",
}
SQL["rt8_contextual_search"] = f"SELECT *, true AS contextual FROM ({SQL['rt3_hybrid_rrf_pages']})"
