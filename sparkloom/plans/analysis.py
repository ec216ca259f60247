"""Queries of links, combined scores and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import analysis, models, quality
from sparkloom.plans import pages as P
from sparkloom.session import table


def qe3_link_categories(spark: SparkSession, d: str) -> DataFrame:
    return P._pages(spark, d).select("id", *[c.alias(n) for n, c in analysis.link_categories(F.col("content")).items()])


def qe4_similar_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar blocks of a page; qe4_duplicate_blocks and its SQL count exact repeats alone."""
    found = table(spark, d, "crawled_pages").select("id", analysis.duplicate_blocks(F.col("content")).alias("_d"))
    return found.select("id", "_d.blocks", "_d.pairs")


def qe6_combined_scores(spark: SparkSession, d: str) -> DataFrame:
    base = P._qa(spark, d).select("id", F.col("score").alias("base"))
    check = P.qb_extraction_check(spark, d).select("id", F.col("score").alias("validation"))
    blocks = P.qe4_duplicate_blocks(spark, d).select("id", F.coalesce(F.try_divide(F.col("repeats"), F.col("blocks")), F.lit(0.0)).alias("duplication"))
    both = base.join(check, "id").join(blocks, "id")
    score = analysis.combined_score(F.col("base"), F.col("validation"), F.col("duplication"), F.lit(None).cast("double"))
    both = both.select("id", score.alias("score"))
    return both.select("id", "score", analysis.improvement(F.col("score")).alias("improvement"), (F.col("score") >= 0.75).alias("meets"))


def qe6_whole_scores(spark: SparkSession, d: str) -> DataFrame:
    """QE6, QE7 with similar blocks and the part of links (the share of a page's links that are not broken); qe6_combined_scores and its SQL leave both out."""
    base = P._qa(spark, d).select("id", F.col("score").alias("base"))
    check = P.qb_extraction_check(spark, d).select("id", F.col("score").alias("validation"))
    links = analysis.link_categories(F.col("content"))
    own = P._pages(spark, d).withColumn("_b", analysis.duplicate_blocks(F.col("content"))).select("id", (F.col("_b.pairs") / F.greatest(F.lit(1), F.col("_b.blocks"))).alias("duplication"), (1 - F.try_divide(links["broken"], links["links"])).alias("kept"))
    both = base.join(check, "id").join(own, "id")
    score = analysis.combined_score(F.col("base"), F.col("validation"), F.col("duplication"), F.col("kept"))
    both = both.select("id", "duplication", "kept", score.alias("score"))
    # QE7: links and duplication have bars of their own.
    meets = (F.col("score") >= 0.75) & F.coalesce(F.col("kept") >= 0.8, F.lit(True)) & (F.col("duplication") <= 0.3)
    return both.select("id", "score", analysis.improvement(F.col("score")).alias("improvement"), meets.alias("meets"))


def ag18_regression_summary(spark: SparkSession, d: str) -> DataFrame:
    return analysis.regression_summary(P.rt13_stored_again(spark, d))


def ag22_score_entropy(spark: SparkSession, d: str) -> DataFrame:
    """How mixed the content ratios of a source's pages are; not AG22, which qe2_pair_statistics has."""
    rows = table(spark, d, "crawled_pages").filter((F.length("content") > 0) & F.col("source_id").isNotNull())
    ratio = quality.markdown_quality(F.col("content"))["content_ratio"]
    return analysis.entropy_of_bins(rows.select("source_id", ratio.alias("ratio")), "source_id", "ratio")


def qe2_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    """QE2 with AG22 and AG23 over the vectors of a label; qe2_coherence and its SQL have the average alone, and ag22_score_entropy is a statistic of rows."""
    return analysis.pair_statistics(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def rt10_embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages")
    return rows.select("id", models.hashed_embedder()(F.col("content")).alias("embedding"))


QUERIES = {f.__name__: f for f in (qe3_link_categories, qe4_similar_blocks, qe6_combined_scores, qe6_whole_scores, ag18_regression_summary, ag22_score_entropy, qe2_pair_statistics, rt10_embedded_texts)}

_URLS = r"regexp_extract_all(content, '\[([^\]]*)\]\(([^)]*)\)', 2)"


def _links(p: str) -> str:
    return f"len(list_filter(u, lambda x: regexp_matches(x, '{p}')))"


SQL = {
    "qe3_link_categories": rf"""SELECT id, len(u) AS links, {_links(r'^(/|#|\.\./|\./)')} AS internal, {_links('^https?://')} AS external, {_links(r'^\s*$|[<>"]|\s')} AS broken, {_links('(?i)github|gitlab|/api/')} AS code, {_links('(?i)glossary|definition')} AS glossary, {_links('^#.')} AS sections
        FROM (SELECT id, {_URLS} AS u FROM {P._ROWS})""",
    "qe6_combined_scores": f"""WITH a AS ({P.SQL['qa_markdown_quality']}), b AS ({P.SQL['qb_extraction_check']}), c AS ({P.SQL['qe4_duplicate_blocks']}),
        s AS (SELECT a.id, round((0.4::DOUBLE * a.score + 0.2::DOUBLE * b.score + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1 - coalesce(c.repeats::DOUBLE / nullif(c.blocks, 0), 0))) / 0.7::DOUBLE, 6) AS score FROM a JOIN b USING (id) JOIN c USING (id))
        SELECT id, score, round(greatest(0.0::DOUBLE, (score - 0.6::DOUBLE) / 0.4::DOUBLE), 8) AS improvement, score >= 0.75 AS meets FROM s""",
    "ag18_regression_summary": f"""SELECT CASE WHEN similarity >= 0.95 THEN 'same' WHEN similarity >= 0.8 THEN 'close' WHEN similarity >= 0.5 THEN 'changed' ELSE 'other' END AS band, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed, round(avg(similarity), 6) AS avg_similarity
        FROM ({P.SQL['rt13_stored_again']}) GROUP BY 1""",
    "ag22_score_entropy": f"""WITH r AS (SELECT source_id, q.content_ratio AS x FROM ({P.SQL['qa_markdown_quality']}) q JOIN crawled_pages p USING (id) WHERE source_id IS NOT NULL),
        b AS (SELECT source_id, CASE WHEN x <= 0.3 THEN 0 WHEN x <= 0.6 THEN 1 ELSE 2 END AS b, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT source_id, sum(n) AS t FROM b GROUP BY 1)
        SELECT source_id, round(sum(-(n::DOUBLE / t) * log2(n::DOUBLE / t)), 6) AS entropy FROM b JOIN t USING (source_id) GROUP BY source_id""",
}
