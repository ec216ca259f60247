"""Queries of the store and of its reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import host
from sparkloom.operators import store
from sparkloom.session import table

PREFIX = "https://docs.cobeleflow.example/en/latest/api/"


def _t(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "crawled_pages"), table(spark, d, "sources"), table(spark, d, "code_examples")


def snk1_replace_by_url(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    own = pages.select("id", "url", "chunk_number")
    batch = own.filter(F.startswith("url", F.lit(PREFIX))).groupBy("url").agg((F.min("id") + 1_000_000_000).alias("id"), F.lit(0).cast("int").alias("chunk_number"))
    return store.replace_by_url(own, batch.select("id", "url", "chunk_number"))


def snk2_insert_code(spark: SparkSession, d: str) -> DataFrame:
    _, _, code = _t(spark, d)
    old = code.filter("id % 2 = 0").select("url", "chunk_number")
    new = code.filter("id % 2 = 1").select("url", "chunk_number")
    held = old.dropDuplicates()
    return store.append_new_keys(held, new, ["url", "chunk_number"])


def snk3_get_or_create_source(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    return store.upsert_sources(sources, store.source_totals(pages), overwrite=False)


def snk4_upsert_source_totals(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    return store.upsert_sources(sources, store.source_totals(pages), overwrite=True)


def snk5_fill_source_ids(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    return store.fill_source_ids(pages.select("id", "url", "source_id"), sources).select("id", "source_id")


def snk6_rollback_source_ids(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.select("id", F.lit(None).cast("int").alias("source_id"))


def snk7_delete_prefix(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return store.delete_prefix(pages.select("id", "url"), PREFIX)


def snk8_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, code = _t(spark, d)
    gone = sources.filter(F.col("summary").isNull())
    parent, kids = store.delete_cascade(sources.select("source_id"), {"p": pages.select("source_id", "id"), "c": code.select("source_id", "id")}, "source_id", gone)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
    return count(parent, "sources").unionByName(count(kids["p"], "crawled_pages")).unionByName(count(kids["c"], "code_examples"))


def jn3_source_page_counts(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    counts = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("url").alias("n_urls"))
    return sources.join(counts, "source_id", "left").select("source_id", "url", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


def jn4_two_way_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Pages and code per source; each side is counted before the join, so they do not multiply."""
    return jn4_all_sources(spark, d).filter(F.col("source_id").between(1, 100))


def jn4_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same for every source; jn4_two_way_fanout and its SQL hold the ids 1 to 100."""
    pages, sources, code = _t(spark, d)
    p = pages.groupBy("source_id").agg(F.count("id").alias("n_pages"))
    c = code.groupBy("source_id").agg(F.count("id").alias("n_code"))
    joined = sources.join(p, "source_id", "left").join(c, "source_id", "left")
    return joined.select("source_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_code", F.lit(0)).alias("n_code"))


def jn5_sample_matches(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    joined = pages.select("source_id", "url").join(sources.select("source_id", F.col("url").alias("site")), "source_id")
    return joined.groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.min("url").alias("sample_url")).orderBy(F.desc("n_rows"), "site").limit(10)


def jn6_orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    return store.orphans(pages.select("id", "source_id"), sources, "source_id").select("id", "source_id")


def jn7_sources_with_code(spark: SparkSession, d: str) -> DataFrame:
    _, sources, code = _t(spark, d)
    return sources.join(code.select("source_id"), "source_id", "left_semi").select("source_id", "url")


def flt5_like(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.filter(F.col("url").like("%/glossary/%")).select("id", "url")


def flt1_metadata_contains(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.filter((F.col("metadata.crawl_type") == "webpage") & (F.col("metadata.chunk_index") == 0)).select("id", F.col("metadata.source").alias("source"))


def flt2_json_text(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k >= 50")


def flt9_exists_checks(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, code = _t(spark, d)
    has = lambda df, name: df.agg((F.count(F.lit(1)) > 0).alias("found")).select(F.lit(name).alias("name"), "found")
    return (
        has(pages.filter(F.col("source_id").isNull()), "pages without source")
        .unionByName(has(store.orphans(pages.select("source_id"), sources, "source_id"), "orphan pages"))
        .unionByName(has(code.filter(~F.col("complexity_score").between(1, 10)), "scores out of range"))
        .unionByName(has(sources.groupBy("source_id").count().filter("count > 1"), "source ids that repeat"))
    )


def flt10_coverage_bands(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    n = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("full"))
    share = F.round(100.0 * F.col("full") / F.col("n"), 2)
    band = F.when(share >= 99, "complete").when(share >= 95, "good").when(share >= 80, "partial").otherwise("poor")
    return sources.select("source_id").join(n, "source_id").select("source_id", share.alias("pct"), band.alias("band"))


def ag1_null_counts(spark: SparkSession, d: str) -> DataFrame:
    pages, _, code = _t(spark, d)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("source_id").alias("with_source"), (F.count(F.lit(1)) - F.count("source_id")).alias("without_source"), F.countDistinct("url").alias("n_urls")).withColumn("name", F.lit(name))

    return part(pages, "crawled_pages").unionByName(part(code, "code_examples"))


def ag3_distinct_filtered(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.agg(F.countDistinct("url").alias("n_urls"), F.countDistinct(F.when(F.col("source_id").isNotNull(), F.col("url"))).alias("n_mapped_urls"))


def ag5_grouped_bands(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    per = pages.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("n") == 1, "single").when(F.col("n") <= 3, "few").otherwise("many")
    total = per.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_rows"))
    return total


def ag7_available_sources(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.filter(F.col("metadata.source").isNotNull()).groupBy(F.col("metadata.source").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))


def ag8_domain_distribution(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    per_url = pages.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_number").alias("last"))
    return per_url.groupBy(host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_rows"), F.round(F.avg("n"), 6).alias("avg_chunks"), F.max("last").alias("last_chunk"))


def ag9_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_id").alias("n_sources"), F.round(F.avg(F.length("content")), 6).alias("avg_chars"))


def ag20_storage(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.groupBy("source_id").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).cast("long").alias("vector_bytes"))


def set1_union_summary(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, code = _t(spark, d)
    row = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
    return row(sources, "sources").unionByName(row(pages, "crawled_pages")).unionByName(row(code, "code_examples"))


def set2_urls_without_code(spark: SparkSession, d: str) -> DataFrame:
    pages, _, code = _t(spark, d)
    return pages.filter(F.col("url").isNotNull()).select("url").distinct().join(code.select("url"), "url", "left_anti")


def tk2_largest_sources(spark: SparkSession, d: str) -> DataFrame:
    pages, sources, _ = _t(spark, d)
    n = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return sources.select("source_id", "url").join(n, "source_id").orderBy(F.desc("n_rows"), "url").limit(10)


def tk6_page_of_rows(spark: SparkSession, d: str) -> DataFrame:
    pages, _, _ = _t(spark, d)
    return pages.select("id", "url").orderBy("id").offset(500).limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        snk1_replace_by_url, snk2_insert_code, snk3_get_or_create_source, snk4_upsert_source_totals, snk5_fill_source_ids, snk6_rollback_source_ids, snk7_delete_prefix, snk8_delete_cascade,
        jn3_source_page_counts, jn4_two_way_fanout, jn4_all_sources, jn5_sample_matches, jn6_orphan_pages, jn7_sources_with_code, flt1_metadata_contains, flt2_json_text, flt5_like, flt9_exists_checks, flt10_coverage_bands,
        ag1_null_counts, ag3_distinct_filtered, ag5_grouped_bands, ag7_available_sources, ag8_domain_distribution, ag9_corpus_stats, ag20_storage, set1_union_summary, set2_urls_without_code,
        tk2_largest_sources, tk6_page_of_rows,
    )
}

_TOTALS = r"""SELECT regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS url, CAST(sum(CASE WHEN content IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) END) AS BIGINT) AS total_words
    FROM crawled_pages WHERE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) <> '' GROUP BY 1"""


def _upsert(words: str) -> str:
    return f"""WITH t AS ({_TOTALS}), o AS (SELECT url, min(source_id) AS source_id, max(total_word_count) AS old FROM sources GROUP BY url),
        b AS (SELECT coalesce(o.url, t.url) AS url, source_id, old, total_words FROM o FULL JOIN t ON o.url = t.url),
        n AS (SELECT *, row_number() OVER (PARTITION BY source_id IS NULL ORDER BY url) AS r FROM b)
        SELECT url, CAST(coalesce(source_id, (SELECT coalesce(max(source_id), 0) FROM sources) + r) AS INTEGER) AS source_id, CAST({words} AS BIGINT) AS total_words FROM n"""


_SITE = r"lower(regexp_replace(regexp_extract({}, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\.', ''))"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"

SQL = {
    "snk1_replace_by_url": f"""WITH n AS (SELECT min(id) + 1000000000 AS id, url, CAST(0 AS INTEGER) AS chunk_number FROM crawled_pages WHERE starts_with(url, '{PREFIX}') GROUP BY url)
        SELECT id, url, chunk_number FROM crawled_pages WHERE url IS NULL OR url NOT IN (SELECT url FROM n) UNION ALL SELECT * FROM n""",
    "snk2_insert_code": """WITH o AS (SELECT DISTINCT url, chunk_number FROM code_examples WHERE id % 2 = 0), n AS (SELECT url, chunk_number FROM code_examples WHERE id % 2 = 1)
        SELECT url, chunk_number FROM o UNION ALL
        (SELECT DISTINCT url, chunk_number FROM n WHERE url IS NOT NULL AND chunk_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.url = n.url AND o.chunk_number = n.chunk_number)) UNION ALL
        (SELECT url, chunk_number FROM n WHERE url IS NULL OR chunk_number IS NULL)""",
    "snk3_get_or_create_source": _upsert("coalesce(old, total_words)"),
    "snk4_upsert_source_totals": _upsert("coalesce(total_words, old)"),
    "snk5_fill_source_ids": f"""WITH k AS (SELECT {_SITE.format('url')} AS site, min(source_id) AS sid FROM sources WHERE url IS NOT NULL GROUP BY 1 HAVING site <> '')
        SELECT id, coalesce(source_id, sid) AS source_id FROM crawled_pages LEFT JOIN k ON k.site = {_SITE.format('url')}""",
    "snk6_rollback_source_ids": "SELECT id, CAST(NULL AS INTEGER) AS source_id FROM crawled_pages",
    "snk7_delete_prefix": f"SELECT id, url FROM crawled_pages WHERE url IS NULL OR url NOT LIKE '{PREFIX}%'",
    "snk8_delete_cascade": """WITH g AS (SELECT source_id FROM sources WHERE summary IS NULL)
        SELECT 'sources' AS name, count(*) AS n_rows FROM sources WHERE source_id NOT IN (SELECT source_id FROM g)
        UNION ALL SELECT 'crawled_pages', count(*) FROM crawled_pages WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM g)
        UNION ALL SELECT 'code_examples', count(*) FROM code_examples WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM g)""",
    "jn3_source_page_counts": """SELECT s.source_id, s.url, count(p.id) AS n_pages, count(DISTINCT p.url) AS n_urls FROM sources s LEFT JOIN crawled_pages p ON p.source_id = s.source_id GROUP BY s.source_id, s.url""",
    "jn4_two_way_fanout": """SELECT s.source_id, count(DISTINCT p.id) AS n_pages, count(DISTINCT c.id) AS n_code FROM sources s LEFT JOIN crawled_pages p ON p.source_id = s.source_id
        LEFT JOIN code_examples c ON c.source_id = s.source_id WHERE s.source_id BETWEEN 1 AND 100 GROUP BY s.source_id""",
    "jn4_all_sources": """SELECT source_id, coalesce(n_pages, 0) AS n_pages, coalesce(n_code, 0) AS n_code FROM sources LEFT JOIN (SELECT source_id, count(id) AS n_pages FROM crawled_pages GROUP BY source_id) USING (source_id)
        LEFT JOIN (SELECT source_id, count(id) AS n_code FROM code_examples GROUP BY source_id) USING (source_id)""",
    "jn5_sample_matches": "SELECT s.url AS site, count(*) AS n_rows, min(p.url) AS sample_url FROM crawled_pages p JOIN sources s ON s.source_id = p.source_id GROUP BY s.url ORDER BY n_rows DESC, site LIMIT 10",
    "jn6_orphan_pages": "SELECT p.id, p.source_id FROM crawled_pages p LEFT JOIN sources s ON s.source_id = p.source_id WHERE p.source_id IS NOT NULL AND s.source_id IS NULL",
    "jn7_sources_with_code": "SELECT source_id, url FROM sources WHERE source_id IN (SELECT source_id FROM code_examples)",
    "flt1_metadata_contains": "SELECT id, metadata.source AS source FROM crawled_pages WHERE metadata.crawl_type = 'webpage' AND metadata.chunk_index = 0",
    "flt2_json_text": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50",
    "flt5_like": "SELECT id, url FROM crawled_pages WHERE url LIKE '%/glossary/%'",
    "flt9_exists_checks": """SELECT 'pages without source' AS name, EXISTS (SELECT 1 FROM crawled_pages WHERE source_id IS NULL) AS found
        UNION ALL SELECT 'orphan pages', EXISTS (SELECT 1 FROM crawled_pages WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources))
        UNION ALL SELECT 'scores out of range', EXISTS (SELECT 1 FROM code_examples WHERE complexity_score NOT BETWEEN 1 AND 10)
        UNION ALL SELECT 'source ids that repeat', EXISTS (SELECT 1 FROM sources GROUP BY source_id HAVING count(*) > 1)""",
    "flt10_coverage_bands": """SELECT source_id, pct, CASE WHEN pct >= 99 THEN 'complete' WHEN pct >= 95 THEN 'good' WHEN pct >= 80 THEN 'partial' ELSE 'poor' END AS band
        FROM (SELECT s.source_id, round(100.0::DOUBLE * count(p.content) / count(*), 2) AS pct FROM sources s JOIN crawled_pages p ON p.source_id = s.source_id GROUP BY s.source_id)""",
    "ag1_null_counts": """SELECT count(*) AS n_rows, count(source_id) AS with_source, count(*) - count(source_id) AS without_source, count(DISTINCT url) AS n_urls, 'crawled_pages' AS name FROM crawled_pages
        UNION ALL SELECT count(*), count(source_id), count(*) - count(source_id), count(DISTINCT url), 'code_examples' FROM code_examples""",
    "ag3_distinct_filtered": "SELECT count(DISTINCT url) AS n_urls, count(DISTINCT url) FILTER (WHERE source_id IS NOT NULL) AS n_mapped_urls FROM crawled_pages",
    "ag5_grouped_bands": """SELECT CASE WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'few' ELSE 'many' END AS band, count(*) AS n_urls, CAST(sum(n) AS BIGINT) AS n_rows
        FROM (SELECT url, count(*) AS n FROM crawled_pages GROUP BY url) GROUP BY 1""",
    "ag7_available_sources": "SELECT metadata.source AS source, count(*) AS n_rows FROM crawled_pages WHERE metadata.source IS NOT NULL GROUP BY 1",
    "ag8_domain_distribution": f"""SELECT {_HOST} AS domain, count(*) AS n_urls, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 6) AS avg_chunks, max(last) AS last_chunk
        FROM (SELECT url, count(*) AS n, max(chunk_number) AS last FROM crawled_pages WHERE url IS NOT NULL GROUP BY url) GROUP BY 1""",
    "ag9_corpus_stats": "SELECT count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, round(avg(length(content)), 6) AS avg_chars FROM crawled_pages",
    "ag20_storage": "SELECT source_id, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS content_bytes, CAST(coalesce(sum(len(embedding) * 4), 0) AS BIGINT) AS vector_bytes FROM crawled_pages GROUP BY source_id",
    "set1_union_summary": "SELECT 'sources' AS name, count(*) AS n_rows FROM sources UNION ALL SELECT 'crawled_pages', count(*) FROM crawled_pages UNION ALL SELECT 'code_examples', count(*) FROM code_examples",
    "set2_urls_without_code": "SELECT DISTINCT url FROM crawled_pages WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM code_examples WHERE url IS NOT NULL)",
    "tk2_largest_sources": "SELECT s.source_id, s.url, count(*) AS n_rows FROM sources s JOIN crawled_pages p ON p.source_id = s.source_id GROUP BY s.source_id, s.url ORDER BY n_rows DESC, s.url LIMIT 10",
    "tk6_page_of_rows": "SELECT id, url FROM crawled_pages ORDER BY id LIMIT 100 OFFSET 500",
}
