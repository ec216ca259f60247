"""Queries of chunk checks, code patterns and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunkcheck as K
from sparkloom.operators import code as C
from sparkloom.plans import code as code_plans
from sparkloom.session import table


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return K.check(table(spark, d, "crawled_pages").select("id", "content"), "id", "content")


def qd_chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


def ag11_corpus_score(spark: SparkSession, d: str) -> DataFrame:
    return K.corpus_score(_checked(spark, d))


def ag12_category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).groupBy("kind", "category").agg(F.count(F.lit(1)).alias("n"))


def ag13_common_issues(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select(F.explode(K.issues()).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue").limit(10)


def cd15_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_examples").filter(F.col("content").isNotNull()).withColumn("language", C.language(F.col("programming_language"), F.col("content")))
    terms = K.context_terms(F.coalesce("summary", F.lit("")))
    return rows.select("id", F.array_join(K.patterns(F.col("content"), F.col("language")), ",").alias("patterns"), F.array_join(terms, ",").alias("terms"))


def cd19_embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_examples")
    return rows.select("id", F.concat("content", F.lit("\n\nSummary: "), F.coalesce("summary", F.lit(""))).alias("text")).filter(F.length(F.trim("text")) >= 10)


def md9_contextual_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a context line made of their headers; chunks without headers stay as they are."""
    rows = table(spark, d, "crawled_pages").filter(F.col("content").isNotNull())
    head = F.regexp_extract("content", r"(?m)^#+[ \t]+([^\r\n]+)", 1)
    text = F.when(head != "", F.concat(F.lit("[SECTION] "), head, F.lit("\n---\n"), F.col("content"))).otherwise(F.col("content"))
    return rows.select("id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def rt12_performance_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score per query of speed, memory and results; parts without a positive value don't count."""
    m = table(spark, d, "search_metrics").filter(F.col("query").isNotNull()).groupBy("query").agg(F.avg("total_time_ms").alias("t"), F.avg("memory_delta_mb").alias("m"), F.avg("result_count").alias("r"))
    part = lambda c, v, w: (F.when(c > 0, v * w).otherwise(0.0), F.when(c > 0, w).otherwise(0.0))
    speed, memory, results = part(F.col("t"), F.least(F.lit(1.0), F.try_divide(F.lit(100.0), F.col("t"))), 0.3), part(F.col("m"), F.greatest(F.lit(0.0), 1 - F.col("m") / 100.0), 0.25), part(F.col("r"), F.least(F.lit(1.0), F.col("r") / 20.0), 0.25)
    score = F.coalesce(F.try_divide(speed[0] + memory[0] + results[0], speed[1] + memory[1] + results[1]), F.lit(0.0))
    return m.select("query", F.round(score, 6).alias("score"))


def ag19_crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages")
    return rows.groupBy(F.col("metadata.crawl_type").alias("crawl_type")).agg(F.countDistinct("url").alias("n_urls"), F.count(F.lit(1)).alias("n_chunks"), F.min("metadata.crawl_time").alias("first"), F.max("metadata.crawl_time").alias("last"), F.sum("metadata.word_count").alias("stated_words"))


QUERIES = {f.__name__: f for f in (qd_chunk_checks, ag11_corpus_score, ag12_category_distribution, ag13_common_issues, cd15_patterns, cd19_embedding_texts, md9_contextual_texts, rt12_performance_score, ag19_crawl_summary)}

_rx, _q = code_plans._rx, code_plans._q
_W = r"list_filter(regexp_split_to_array(lower(content), '\s+'), lambda w: w <> '')"
_TECH = ", ".join(map(_q, K.TECHNICAL))
_I = "CAST({} AS INTEGER)"
_CHECK = rf"""(
    WITH t AS (SELECT id, content, lower(content) AS low, {_W} AS w FROM crawled_pages WHERE length(content) > 0),
         a AS (SELECT id, length(content) AS chars, len(w) AS words, len(regexp_extract_all(content, '(?m)^#+\s+.+$')) > 0 AS headings,
                      len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) >= 10)) > 0 AS paragraphs, {_rx('content', K.CODE)} AS code,
                      {', '.join(f"{_rx('low', p)} AS {n}" for n, p in K.KINDS.items())}, {_rx('content', K.GLOSSARY)} AS glossary, {_rx('low', K.EXPLAINING)} AS explains, len(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)')) AS links,
                      len(list_filter(w, lambda x: x IN ({_TECH}))) AS tech FROM t),
         b AS (SELECT * EXCLUDE (tech), round(least(1.0::DOUBLE, CASE WHEN words > 0 THEN tech::DOUBLE / words + 0.1::DOUBLE * {_I.format('code')} + 0.05::DOUBLE * {_I.format('headings')} ELSE 0 END), 6) AS technical,
                      {_I.format('breadcrumbs')} + {_I.format('menu')} + {_I.format('footer')} + {_I.format('sidebar')} AS n_kinds FROM a),
         c AS (SELECT *, CASE WHEN breadcrumbs OR menu OR n_kinds >= 2 THEN 'navigation' WHEN footer THEN 'footer' WHEN paragraphs AND words >= 15 AND technical > 0.1 THEN (CASE WHEN n_kinds >= 1 THEN 'mixed' ELSE 'content' END)
                      WHEN headings AND NOT paragraphs THEN 'header' ELSE 'unknown' END AS kind FROM b),
         d AS (SELECT *, chars >= 100 AND words >= 15 AND kind IN ('content', 'mixed') AND (paragraphs OR code) AS substantive FROM c),
         e AS (SELECT *, substantive AND n_kinds <= 2 AS valid, round(0.2::DOUBLE * {_I.format('paragraphs')} + 0.2::DOUBLE * {_I.format('code')} + 0.2::DOUBLE * {_I.format('glossary')} + 0.1::DOUBLE * {_I.format('explains')} + 0.2::DOUBLE * technical - 0.1::DOUBLE * n_kinds, 6) AS score FROM d)
    SELECT *, CASE WHEN NOT valid THEN 'poor' WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS category FROM e)"""

SQL = {
    "qd_chunk_checks": f"SELECT * FROM {_CHECK}",
    "ag11_corpus_score": f"""SELECT n, round(v, 6) AS valid_share, round(c, 6) AS content_share, round(g, 6) AS navigation_share, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * v + 0.3::DOUBLE * c - 0.5::DOUBLE * g + least(0.1::DOUBLE, 0.5::DOUBLE * s) + least(0.1::DOUBLE, 0.3::DOUBLE * k) + least(0.1::DOUBLE, 0.2::DOUBLE * l))), 6) AS score
        FROM (SELECT count(*) AS n, coalesce(avg(CAST(valid AS INTEGER)), 0) AS v, coalesce(avg(CAST(kind IN ('content', 'mixed') AS INTEGER)), 0) AS c, coalesce(avg(CAST(kind = 'navigation' AS INTEGER)), 0) AS g, coalesce(avg(CAST(glossary AS INTEGER)), 0) AS s, coalesce(avg(CAST(code AS INTEGER)), 0) AS k, coalesce(avg(links), 0) AS l FROM {_CHECK})""",
    "ag12_category_distribution": f"SELECT kind, category, count(*) AS n FROM {_CHECK} GROUP BY kind, category",
    "ag13_common_issues": f"""SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN chars < 100 THEN 'too short' END, CASE WHEN breadcrumbs THEN 'breadcrumbs' END, CASE WHEN menu THEN 'menu items' END, CASE WHEN footer THEN 'footer' END,
        CASE WHEN NOT paragraphs AND NOT code THEN 'no paragraphs or code' END, CASE WHEN technical < 0.1 THEN 'little technical text' END]) AS issue FROM {_CHECK}) WHERE issue IS NOT NULL GROUP BY issue ORDER BY n DESC, issue LIMIT 10""",
    "cd15_patterns": f"""SELECT id, array_to_string(list_slice(list_filter([{', '.join([f"CASE WHEN regexp_matches(content, {_q(p)}) THEN {_q(n)} END" for n, p in K.SHOWN] + [f"CASE WHEN language IN ({', '.join(map(_q, names))}) AND regexp_matches(content, {_q(p)}) THEN {_q(n)} END" for names, rules in K.SHOWN_BY.items() for n, p in rules])}], lambda x: x IS NOT NULL), 1, 8), ',') AS patterns,
        array_to_string(list_slice(list_filter([{', '.join(map(_q, K.TERMS))}], lambda t: contains(lower(coalesce(summary, '')), t)), 1, 6), ',') AS terms
        FROM (SELECT id, content, summary, {code_plans._lang('programming_language', 'content')} AS language FROM code_examples WHERE content IS NOT NULL)""",
    "cd19_embedding_texts": "SELECT * FROM (SELECT id, content || chr(10) || chr(10) || 'Summary: ' || coalesce(summary, '') AS text FROM code_examples) WHERE length(trim(text)) >= 10",
    "md9_contextual_texts": r"""SELECT id, length(t) AS chars, md5(t) AS digest FROM (SELECT id, CASE WHEN h <> '' THEN '[SECTION] ' || h || chr(10) || '---' || chr(10) || content ELSE content END AS t
        FROM (SELECT id, content, regexp_extract(content, '(?m)^#+[ \t]+([^\r\n]+)', 1) AS h FROM crawled_pages WHERE content IS NOT NULL))""",
    "rt12_performance_score": """WITH m AS (SELECT query, avg(total_time_ms) AS t, avg(memory_delta_mb) AS m, avg(result_count) AS r FROM search_metrics WHERE query IS NOT NULL GROUP BY query),
        p AS (SELECT query, CASE WHEN t > 0 THEN 0.3::DOUBLE * least(1.0::DOUBLE, 100.0::DOUBLE / t) ELSE 0 END + CASE WHEN m > 0 THEN 0.25::DOUBLE * greatest(0.0::DOUBLE, 1 - m / 100.0::DOUBLE) ELSE 0 END + CASE WHEN r > 0 THEN 0.25::DOUBLE * least(1.0::DOUBLE, r / 20.0::DOUBLE) ELSE 0 END AS s,
                     CASE WHEN t > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN m > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN r > 0 THEN 0.25::DOUBLE ELSE 0 END AS w FROM m)
        SELECT query, round(CASE WHEN w > 0 THEN s / w ELSE 0 END, 6) AS score FROM p""",
    "ag19_crawl_summary": "SELECT metadata.crawl_type AS crawl_type, count(DISTINCT url) AS n_urls, count(*) AS n_chunks, min(metadata.crawl_time) AS first, max(metadata.crawl_time) AS last, CAST(sum(metadata.word_count) AS BIGINT) AS stated_words FROM crawled_pages GROUP BY 1",
}
