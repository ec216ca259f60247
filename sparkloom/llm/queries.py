"""The queries of the ten problems, over whole tables and with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import layout, lines, moderation, neardup, overlap, pieces, quality, residue, tokens, vectors
from sparkloom.session import table

#: Where the public vocabularies lie on every machine.
TOKENIZERS = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come out in pieces; every piece is emitted and measured."""
    cut = p1_pieces(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("most"))
    return cut.filter((F.col("n") > 1) & (F.col("most") <= pieces.LIMIT)).select("id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return pieces.split_column(table(spark, d, "crawled_pages"), "id", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.find_repeated(table(spark, d, "crawled_pages"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every row without its repeated lines."""
    return lines.remove_repeated(table(spark, d, "crawled_pages")).select("id", "source_id", "content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages, code = table(spark, d, "crawled_pages"), table(spark, d, "code_examples")
    both = pages.select(F.concat(F.lit("p"), "id").alias("key"), "embedding").union(code.select(F.concat(F.lit("c"), "id").alias("key"), "embedding"))
    return vectors.close_pairs(both, "key", "embedding", least=0.9, k=5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_pages")
    return neardup.near_pairs(pages, "id", "content", width=3, threshold=0.6, min_words=30).select("id_a", "id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of near-duplicates: each member with the smallest of its group."""
    return neardup.groups(p4_found(spark, d), "id_a", "id_b")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tokens.encode_column(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    # What aligns with at least 13 words' worth, and holds 13 words in a row.
    return found.filter("score >= 26 AND run_words >= 13").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item by alignment, changed or not."""
    return overlap.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("share >= 0.5")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "crawled_pages")).select("id")


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    """How well the classifier does on hosts it has not seen."""
    return residue.validation(table(spark, d, "crawled_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return layout.site_lines(table(spark, d, "crawled_pages"))


def p6_body(spark: SparkSession, d: str) -> DataFrame:
    """Every row's own text."""
    return layout.main_text(table(spark, d, "crawled_pages")).select("id", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_not_prose(table(spark, d, "crawled_pages"))


def p7_source_words(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_words(table(spark, d, "crawled_pages"), table(spark, d, "sources"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = moderation.score_documents(docs, table(spark, d, "moderation_samples"))
    return scored.filter(F.col("score") >= moderation.BAR).select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "text")
    return moderation.source_rates(moderation.score_documents(docs, table(spark, d, "moderation_samples")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_clean, p3_found, p4_found, p4_groups, p5_found, p5_validation, p6_found, p6_body, p7_found, p7_source_words, p8_ids, p9_found, p9_edited, p10_found, p10_source_rates)}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can state over whole tables."""
    folded = r"regexp_replace(regexp_replace(lower(content), '[\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g')"
    return {
        "p1_found": "SELECT id FROM crawled_pages WHERE length(content) > 5000",
        "p2_found": rf"""
            WITH l AS (SELECT id, source_id, unnest(string_split({folded}, chr(10))) AS line, generate_subscripts(string_split({folded}, chr(10)), 1) AS line_no
                       FROM crawled_pages WHERE source_id IS NOT NULL AND content IS NOT NULL),
                 t AS (SELECT id, source_id, trim(line, ' ') AS line, line_no FROM l),
                 n AS (SELECT source_id, count(*) AS n FROM crawled_pages WHERE source_id IS NOT NULL GROUP BY source_id),
                 k AS (SELECT source_id, line, count(DISTINCT id) AS k FROM t WHERE length(line) >= 20 GROUP BY source_id, line)
            SELECT t.id, CAST(t.line_no AS INTEGER) AS line_no FROM t JOIN k USING (source_id, line) JOIN n USING (source_id) WHERE k.k >= 5 AND k.k * 10 >= n.n""",
        "p2_clean": rf"""
            WITH l AS (SELECT id, source_id, unnest(string_split({folded}, chr(10))) AS line, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
                       FROM crawled_pages WHERE source_id IS NOT NULL AND content IS NOT NULL),
                 t AS (SELECT id, source_id, trim(line, ' ') AS line, raw, line_no FROM l),
                 n AS (SELECT source_id, count(*) AS n FROM crawled_pages WHERE source_id IS NOT NULL GROUP BY source_id),
                 k AS (SELECT source_id, line FROM t JOIN n USING (source_id) WHERE length(line) >= 20 GROUP BY source_id, line HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) * 10 >= any_value(n)),
                 c AS (SELECT t.id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE k.line IS NULL) AS content FROM t LEFT JOIN k ON k.source_id = t.source_id AND k.line = t.line GROUP BY t.id)
            SELECT p.id, p.source_id, CASE WHEN p.source_id IS NULL OR p.content IS NULL THEN p.content ELSE coalesce(c.content, '') END AS content FROM crawled_pages p LEFT JOIN c ON c.id = p.id""",
        "p3_found": """
            WITH v AS (SELECT 'p' || id AS key, embedding FROM crawled_pages UNION ALL SELECT 'c' || id, embedding FROM code_examples),
                 u AS (SELECT key, CAST(embedding AS DOUBLE[]) AS e FROM v WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 s AS (SELECT a.key AS a, b.key AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.key <> b.key),
                 r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS n FROM s WHERE c >= 0.89)
            SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM r WHERE n <= 5 AND c >= 0.9""",
        "p4_found": r"""
            WITH w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM crawled_pages WHERE content IS NOT NULL),
                 g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM w WHERE len(w) >= 30),
                 n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
                 p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
            SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k * 10 >= 6 * (x.n + y.n - k)""",
        "p9_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
                 i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
                 dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(list_slice(w, k, k + 12), ' '))) AS g FROM d WHERE len(w) >= 13),
                 ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(list_slice(w, k, k + 12), ' '))) AS g FROM i WHERE len(w) >= 13)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p7_source_words": r"""
            WITH c AS (SELECT source_id, count(*) AS n_rows, coalesce(sum(len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))), 0) AS words FROM crawled_pages GROUP BY source_id),
                 s AS (SELECT source_id, max(total_word_count) AS stated FROM sources GROUP BY source_id)
            SELECT coalesce(c.source_id, s.source_id) AS source_id, coalesce(n_rows, 0) AS n_rows, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(stated AS BIGINT) AS stated,
                   CAST(coalesce(words, 0) - stated AS BIGINT) AS difference
            FROM c FULL JOIN s ON c.source_id IS NOT DISTINCT FROM s.source_id""",
    }
