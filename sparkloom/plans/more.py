"""Queries of chunks, links, searches and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunking, performance
from sparkloom.sources import crawl
from sparkloom.session import table


def ch5_markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_rows(table(spark, d, "crawled_pages").select("id", "content"))
    return rows.select("id", "chunk_index", F.length("chunk").alias("chars"), "token_count")


def ch9_semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_rows(table(spark, d, "crawled_pages").select("id", "content"), size=2000, semantic=True)
    return rows.select("id", "chunk_index", F.length("chunk").alias("chars"), "token_count")


def ch6_chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages").filter(F.col("content").isNotNull())
    return chunking.check_chunks(rows, "content").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd_fence").alias("n_odd"), F.count_if("empty_fence").alias("n_empty"))


def ch7_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull() & F.col("content").isNotNull())
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("content")), 6).alias("avg_chars"), F.sum(F.floor(F.length("content") / 4)).alias("tokens"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    urls = table(spark, d, "crawled_pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("dst")).filter("dst is not null").distinct()
    parts = urls.select(F.explode(F.array("dst", F.regexp_replace("dst", "/[^/]+/?$", ""), F.regexp_replace(F.regexp_replace("dst", "/[^/]+/?$", ""), "/[^/]+/?$", ""))).alias("dst")).distinct()
    edges = parts.select(F.regexp_replace("dst", "/[^/]+/?$", "").alias("src"), "dst").filter("src rlike '^https?://' and src <> dst")
    roots = parts.filter(F.col("dst").rlike("^https?://[^/]+$")).select(F.col("dst").alias("url"))
    return edges, roots


def src8_link_walk(spark: SparkSession, d: str) -> DataFrame:
    """Addresses reached from the sites' roots over the tree of paths."""
    edges, roots = _edges(spark, d)
    return crawl.walk(edges, roots, 3)


def src8_page_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, FLT14: what the links of the pages lead to from the sources' addresses and first pages, inside the sources alone, in three steps."""
    pages, sources = table(spark, d, "crawled_pages"), table(spark, d, "sources")
    links = crawl.within(crawl.page_links(pages), sources.select(F.col("url").alias("prefix")))
    seeds = pages.filter(F.col("chunk_number") == 0).select("url").union(sources.select("url"))
    return crawl.walk(links, seeds, 3)


def snk9_unmatched_view(spark: SparkSession, d: str) -> DataFrame:
    """SNK9: pages without a source as a temporary view, counted by host."""
    from sparkloom.functions.text import host
    from sparkloom.operators import store

    rows = table(spark, d, "crawled_pages").filter(F.col("source_id").isNull()).select(host(F.col("url")).alias("host"))
    store.register(rows, "sparkloom_unmatched")
    return spark.sql("SELECT host, count(*) AS n FROM sparkloom_unmatched GROUP BY host")


def src6_successful_pages(spark: SparkSession, d: str) -> DataFrame:
    return crawl.successful(table(spark, d, "crawled_pages")).select("id", "url")


def ag16_latency(spark: SparkSession, d: str) -> DataFrame:
    return performance.latency(table(spark, d, "search_metrics"), ["query"])


def rt11_baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Searches after the middle of the measured time against those before."""
    m = table(spark, d, "search_metrics").filter(F.col("query").isNotNull())
    middle = F.lit("2024-07-01").cast("timestamp")
    return performance.compare(performance.latency(m.filter(F.col("measured_at") >= middle), ["query"]), performance.latency(m.filter(F.col("measured_at") < middle), ["query"]), "query")


def ag21_memory_slope(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "search_metrics").filter(F.col("memory_delta_mb").isNotNull() & F.col("measured_at").isNotNull())
    days = F.unix_timestamp("measured_at") / 86400.0
    return m.agg(F.round(F.regr_slope(F.col("memory_delta_mb"), days), 9).alias("mb_per_day"), F.count(F.lit(1)).alias("n"))


def qe2_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of all pairs of a label's vectors without any pair: from the sum of the unit vectors."""
    e = table(spark, d, "embeddings")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = e.withColumn("_l", length).select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / F.col("_l"))).alias("i", "x"))
    sums = parts.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("label").agg(F.max("n").alias("n"), F.round(F.try_divide(F.sum(F.col("s") * F.col("s")) - F.max("n"), F.max("n") * (F.max("n") - 1)), 6).alias("avg_cosine"))


QUERIES = {f.__name__: f for f in (ch5_markdown_chunks, ch9_semantic_chunks, ch6_chunk_checks, ch7_chunk_sizes, src8_link_walk, src8_page_links, snk9_unmatched_view, src6_successful_pages, ag16_latency, rt11_baseline_comparison, ag21_memory_slope, qe2_coherence)}


def _latency(where: str) -> str:
    return f"""SELECT query, count(*) AS n, round(avg(total_time_ms), 6) AS avg_ms, round(median(total_time_ms), 6) AS median_ms, min(total_time_ms) AS min_ms, max(total_time_ms) AS max_ms, round(var_samp(total_time_ms), 6) AS var_ms,
        round(avg(result_count), 6) AS avg_results, round(avg(memory_delta_mb), 6) AS avg_memory FROM search_metrics WHERE {where} GROUP BY query"""


def _pct(c: str) -> str:
    return f"CASE WHEN b.{c} > 0 THEN round(100.0::DOUBLE * (a.{c} - b.{c}) / b.{c}, 6) END"


SQL = {
    "ch6_chunk_checks": r"""SELECT count(*) AS n, count(*) FILTER (WHERE len(regexp_extract_all(content, '```')) % 2 = 1) AS n_odd, count(*) FILTER (WHERE regexp_matches(content, '```[a-zA-Z0-9_]*\n\s*```')) AS n_empty FROM crawled_pages WHERE content IS NOT NULL""",
    "ch7_chunk_sizes": "SELECT url, count(*) AS n_chunks, round(avg(length(content)), 6) AS avg_chars, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM crawled_pages WHERE url IS NOT NULL AND content IS NOT NULL GROUP BY url",
    "src6_successful_pages": "SELECT id, url FROM crawled_pages WHERE length(trim(content)) > 0",
    "src8_link_walk": r"""WITH RECURSIVE u AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS u FROM crawled_pages WHERE url IS NOT NULL),
        p AS (SELECT u AS dst FROM u UNION SELECT regexp_replace(u, '/[^/]+/?$', '') FROM u UNION SELECT regexp_replace(regexp_replace(u, '/[^/]+/?$', ''), '/[^/]+/?$', '') FROM u),
        e AS (SELECT regexp_replace(dst, '/[^/]+/?$', '') AS src, dst FROM p WHERE regexp_matches(regexp_replace(dst, '/[^/]+/?$', ''), '^https?://') AND regexp_replace(dst, '/[^/]+/?$', '') <> dst),
        w(url, depth) AS (SELECT dst, 0 FROM p WHERE regexp_matches(dst, '^https?://[^/]+$') UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3)
        SELECT url, min(depth) AS depth FROM w GROUP BY url""",
    "src8_page_links": r"""WITH RECURSIVE l AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, unnest(regexp_extract_all(content, '\[[^\]]*\]\(([^)\s]+)\)', 1)) AS u FROM crawled_pages WHERE url IS NOT NULL),
        a AS (SELECT DISTINCT src, regexp_replace(CASE WHEN starts_with(u, '/') AND regexp_extract(src, '^([a-zA-Z]+://[^/?#]+)', 1) <> '' THEN regexp_extract(src, '^([a-zA-Z]+://[^/?#]+)', 1) || u WHEN regexp_matches(u, '^https?://') THEN u END, '#.*$', '') AS dst FROM l),
        e AS (SELECT DISTINCT src, dst FROM a JOIN (SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS p FROM sources WHERE url IS NOT NULL) ON starts_with(dst, p)),
        w(url, depth) AS (SELECT regexp_replace(url, '#.*$', ''), 0 FROM (SELECT url FROM crawled_pages WHERE chunk_number = 0 UNION ALL SELECT url FROM sources) WHERE url IS NOT NULL UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3)
        SELECT url, min(depth) AS depth FROM w GROUP BY url""",
    "snk9_unmatched_view": "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM crawled_pages WHERE source_id IS NULL GROUP BY 1",
    "ag16_latency": _latency("true"),
    "rt11_baseline_comparison": f"""WITH a AS ({_latency("query IS NOT NULL AND measured_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00'")}), b AS ({_latency("query IS NOT NULL AND measured_at < TIMESTAMPTZ '2024-07-01 00:00:00+00'")}),
        c AS (SELECT a.query, {_pct('avg_ms')} AS time_pct, {_pct('avg_memory')} AS memory_pct, {_pct('avg_results')} AS results_pct, b.query IS NOT NULL AS has FROM a LEFT JOIN b ON a.query = b.query)
        SELECT query, time_pct, memory_pct, results_pct, CASE WHEN NOT has THEN 'no_baseline' WHEN coalesce(time_pct > 25, false) OR coalesce(memory_pct > 50, false) OR coalesce(results_pct < -20, false) THEN 'regression_detected' WHEN coalesce(time_pct < -10, false) THEN 'improvement_detected' ELSE 'stable' END AS status FROM c""",
    "ag21_memory_slope": "SELECT round(regr_slope(memory_delta_mb, floor(epoch(measured_at)) / 86400.0::DOUBLE), 9) AS mb_per_day, count(*) AS n FROM search_metrics WHERE memory_delta_mb IS NOT NULL AND measured_at IS NOT NULL",
    "qe2_coherence": """SELECT a.label, CAST(any_value(n) AS BIGINT) AS n, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS avg_cosine
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON c.label = a.label GROUP BY a.label""",
}
