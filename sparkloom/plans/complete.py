"""Queries of advice, contexts, chunks of documents, reports and regression bands, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import host, white_words
from sparkloom.operators import advice, analysis, chunking, chunkcheck, metadata, quality
from sparkloom.operators import code as C
from sparkloom.plans import checks, pages
from sparkloom.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select("id", "content").filter(F.length("content") > 0)


def cd1_block_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.block_contexts(table(spark, d, "crawled_pages").select("id", "content"), "id", "content")
    return rows.select("id", "block", "hint", "start_line", "end_line", F.md5("before").alias("before"), F.md5("after").alias("after"), F.length("code").alias("chars"))


def cd2_indented_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", F.posexplode(C.indented_blocks(F.col("content"))).alias("block", "code")).select("id", "block", F.length("code").alias("chars"), F.md5("code").alias("digest"))


def cd17_block_metadata(spark: SparkSession, d: str) -> DataFrame:
    """CD16, CD17: metadata of every block of a page."""
    rows = C.block_contexts(table(spark, d, "crawled_pages").select("id", "content"), "id", "content").withColumn("language", C.language(F.col("hint"), F.col("code")))
    made = C.block_metadata(F.col("code"), F.col("language"), F.col("before"), F.col("after"))
    lists = ("identifiers", "surrounding_headers")
    terms = F.array_join(chunkcheck.context_terms(F.concat_ws(" ", "before", "after")), ",")
    return rows.select("id", "block", *[(F.array_join(c, "|") if n in lists else F.length(c) if n.startswith("context_") else c).alias(n) for n, c in made.items()], terms.alias("context_keywords"))


def qd2_chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", *[c.alias(n) for n, c in advice.chunk_links(F.col("content")).items()])


def qd5_glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = advice.glossary_terms(F.col("content"))
    return _texts(spark, d).select("id", F.size(terms).alias("n"), F.array_join(F.array_sort(terms), "|").alias("terms")).filter("n > 0")


def qd10_chunk_recommendations(spark: SparkSession, d: str) -> DataFrame:
    links = advice.chunk_links(F.col("content"))["broken"]
    rows = checks._checked(spark, d).join(_texts(spark, d).select("id", links.alias("broken")), "id")
    made = advice.chunk_recommendations(*[F.col(c) for c in ("kind", "n_kinds", "chars", "paragraphs", "code", "broken", "technical")])
    return rows.select("id", F.array_join(made, "|").alias("recommendations"))


def qd11_corpus_result(spark: SparkSession, d: str) -> DataFrame:
    """QD11: the corpus' score, whether it reaches 0.7 of valid and 0.8 of substantial chunks, and what to do first."""
    checked = checks._checked(spark, d).cache()
    score = chunkcheck.corpus_score(checked)
    sums = checked.agg(F.count_if("code").alias("code"), F.count_if("glossary").alias("glossary"))
    both = score.crossJoin(sums)  # one row each
    made = advice.corpus_recommendations(F.col("n"), F.col("valid_share"), F.col("navigation_share"), F.col("code"), F.col("glossary"), F.col("score"))
    return both.select("n", "score", (F.col("valid_share") >= 0.7).alias("enough_valid"), (F.col("content_share") >= 0.8).alias("enough_content"), F.array_join(made, "|").alias("recommendations"))


def qa13_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """QA6, QA13: all navigation elements of a page, and suggestions."""
    elements = pages.qa_navigation_elements(spark, d).select("id", quality.total([F.col(c) for c in ("named", "streaks", "heavy", "repeated")]).alias("elements"))
    rows = pages.qa_markdown_quality(spark, d).join(elements, "id")
    made = advice.markdown_suggestions(*[F.col(c) for c in ("content_ratio", "link_density", "words", "elements")])
    return rows.select("id", "elements", F.array_join(made, "|").alias("suggestions"))


def qb8_issues(spark: SparkSession, d: str) -> DataFrame:
    made = advice.extraction_issues(*[F.col(c) for c in ("artifacts", "script", "ratio", "words")])
    return pages.qb_extraction_check(spark, d).select("id", F.array_join(made, "|").alias("issues"), "passed")


def qc7_suggestions(spark: SparkSession, d: str) -> DataFrame:
    made = advice.selector_suggestions(*[F.col(c) for c in ("links", "keys", "item_words", "tags", "short", "few")])
    return pages.qc_selector_check(spark, d).select("id", "valid", F.array_join(made, "|").alias("suggestions"))


def md3_document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The keys of MD3 that md3_document_numbers leaves out: address, host, texts of headers, languages, labels."""
    heads = F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}[ \t]+([^\r\n]+)"), 1)
    langs = F.array_distinct(F.filter(F.regexp_extract_all("content", F.lit(r"```([a-zA-Z0-9_]+)?\n[\s\S]*?```"), 1), lambda x: x != ""))
    rows = pages._pages(spark, d)
    return rows.select("id", F.col("url").alias("source_url"), host(F.col("url")).alias("domain"), F.array_join(heads, "|").alias("headers"), F.array_join(F.array_sort(langs), ",").alias("programming_languages"), F.array_join(metadata.labels(F.col("content")), ",").alias("content_types"))


def md10_prompts(spark: SparkSession, d: str) -> DataFrame:
    """MD10: which template a chunk's context is asked for with, and how much of its document goes along."""
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull() & F.col("content").isNotNull())
    whole = rows.groupBy("url").agg(F.sum(F.length("content")).alias("_n"), F.count(F.lit(1)).alias("_k"))
    asked = rows.join(whole, "url").select("id", metadata.content_type(F.col("content"), F.col("url")).alias("template"), F.length("content").alias("chunk_chars"), F.least(F.lit(25_000), F.col("_n") + 2 * (F.col("_k") - 1)).alias("document_chars"))
    return asked


def md9_labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """MD9: chunks with a context line that begins with their type, as the local context writer gives it; chunks without headers stay as they are."""
    rows = pages._pages(spark, d)
    kind, head = metadata.content_type(F.col("content"), F.col("url")), F.regexp_extract("content", r"(?m)^#+[ \t]+([^\r\n]+)", 1)
    rows = rows.select("id", "content", F.upper(kind).alias("_k"), head.alias("_h"))
    text = F.when(F.col("_h") != "", F.concat(F.lit("["), "_k", F.lit("] "), "_h", F.lit("\n---\n"), "content")).otherwise(F.col("content"))
    return rows.select("id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def rt13_golden_ranges(spark: SparkSession, d: str) -> DataFrame:
    """RT13: rows stored again against their first version: words within 0.9 to 1.2 of it, score within -0.1 to +0.05, similarity of 0.95 or more."""
    again = pages.rt13_stored_again(spark, d).select("first_id", "id", "similarity")
    now = pages.qa_markdown_quality(spark, d).select("id", "words", "score")
    both = again.join(now, "id").join(now.select(F.col("id").alias("first_id"), F.col("words").alias("_w"), F.col("score").alias("_s")), "first_id")
    words = F.col("words").between(F.floor(F.col("_w") * 0.9), F.floor(F.col("_w") * 1.2))
    score = F.round(F.col("score") - F.col("_s"), 6).between(-0.1, 0.05)
    return both.select("first_id", "id", words.alias("words_in_range"), score.alias("score_in_range"), (words & score & (F.col("similarity") >= 0.95)).alias("passed"))


def ag4_stated_totals(spark: SparkSession, d: str) -> DataFrame:
    """AG4: per url the stated words and the first crawl."""
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull())
    return rows.groupBy("url").agg(F.coalesce(F.sum("metadata.word_count"), F.lit(0)).alias("total_words"), F.min("metadata.crawl_time").alias("first_crawl"))


def ag9_corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG9: rows and sources of all, and the mean length of the first hundred rows by id (the sample is the feature)."""
    rows = table(spark, d, "crawled_pages")
    first = rows.orderBy("id").limit(100).agg(F.round(F.avg(F.length("content")), 6).alias("avg_chars"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_id").alias("n_sources")).crossJoin(first)  # one row each


def ag14_standard_report(spark: SparkSession, d: str) -> DataFrame:
    """AG14: mean score and share of rows that meet the standard (0.7), by type of page."""
    rows = pages.qa_markdown_quality(spark, d).join(pages.md8_content_types(spark, d), "id")
    return rows.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(100 * F.avg((F.col("score") >= 0.7).cast("int")), 6).alias("percent_met"))


def ag18_regression_bands(spark: SparkSession, d: str) -> DataFrame:
    """AG18, RT13: rows stored again beside their first version, by band of similarity and of the change in score."""
    again = pages.rt13_stored_again(spark, d)
    score = pages.qa_markdown_quality(spark, d).select("id", "score")
    both = again.join(score, "id").join(score.select(F.col("id").alias("first_id"), F.col("score").alias("_first")), "first_id")
    return both.groupBy(analysis.similarity_band(F.col("similarity")).alias("band"), analysis.change_band(F.round(F.col("score") - F.col("_first"), 6)).alias("change")).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


def ag20_storage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """AG20: bytes of contents and of what is stored beside them (address and names of the metadata), and their ratios."""
    rows = table(spark, d, "crawled_pages")
    own, beside = F.sum(F.octet_length(F.coalesce("content", F.lit("")))), F.sum(F.octet_length(F.concat_ws(",", "url", "metadata.headers", "metadata.source", "metadata.crawl_type")))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), own.alias("content_bytes"), beside.alias("metadata_bytes"))
    return sums.select("*", F.round(F.try_divide("content_bytes", "metadata_bytes"), 6).alias("content_to_metadata"), F.round(F.try_divide(F.col("content_bytes"), F.col("content_bytes") + F.col("metadata_bytes")), 6).alias("content_to_total"))


def ch6_fence_faults(spark: SparkSession, d: str) -> DataFrame:
    faults = ["orphan_open", "orphan_close", "empty_fence", "merged"]
    rows = chunking.check_chunks(_texts(spark, d), "content")
    return rows.select("id", *faults).filter(" OR ".join(faults))


def ch7_preservation(spark: SparkSession, d: str) -> DataFrame:
    """CH7: chunks of a text, their mean size, and the share of its characters that they keep."""
    rows = chunking.chunk_rows(_texts(spark, d))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("chunk")), 6).alias("avg_chars"), F.round(F.sum(F.length("chunk")) / F.max(F.length("content")), 6).alias("preserved"))


def ch13_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """CH8-CH13: chunks of whole documents with their places."""
    rows = chunking.document_rows(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "chunk_index", "total_chunks", "start", "end", "token_count", F.md5("chunk").alias("digest"))


def qe1_semantic_sections(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("_s", analysis.section_counts(F.col("content"))).select("id", "_s.*")


def qe5_duplicate_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("_k", analysis.duplicate_kinds(F.col("content"))).select("id", "_k.*")


def qe8_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """QE7, QE8: recommendations from the markdown and extraction checks, links and similar blocks; a page alone has no coherence."""
    scores = pages.qa_markdown_quality(spark, d).select("id", "score")
    passed = pages.qb_extraction_check(spark, d).select("id", "passed")
    broken = analysis.link_categories(F.col("content"))["broken"]
    own = _texts(spark, d).withColumn("_b", analysis.duplicate_blocks(F.col("content"))).select("id", broken.alias("broken"), (F.col("_b.pairs") / F.greatest(F.lit(1), F.col("_b.blocks"))).alias("duplication"))
    first, second = advice.analyzer_recommendations(F.col("score"), F.col("passed"), F.lit(None).cast("double"), F.col("broken"), F.col("duplication"))
    rows = own.join(scores, "id").join(passed, "id")
    return rows.select("id", F.array_join(first, "|").alias("priority"), F.array_join(second, "|").alias("technical"))


def rt12_performance_summary(spark: SparkSession, d: str) -> DataFrame:
    """RT12: score of speed (0.3), memory (0.25), storage (0.2) and results (0.25) per query, its 95 % interval at an error of 5 %, and what lies below the aims (fixed values of the docstring of ``checks.rt12``)."""
    share = ag20_storage_ratio(spark, d).select(F.col("content_to_total").alias("_db"))
    m = table(spark, d, "search_metrics").filter(F.col("query").isNotNull()).groupBy("query").agg(F.avg("total_time_ms").alias("t"), F.avg("memory_delta_mb").alias("m"), F.avg("result_count").alias("r")).crossJoin(F.broadcast(share))  # one row
    parts = [(F.col("t"), F.least(F.lit(1.0), F.try_divide(F.lit(100.0), F.col("t"))), 0.3), (F.col("m"), F.greatest(F.lit(0.0), 1 - F.col("m") / 100.0), 0.25), (F.col("_db"), F.least(F.lit(1.0), F.col("_db") / 0.7), 0.2), (F.col("r"), F.least(F.lit(1.0), F.col("r") / 20.0), 0.25)]
    top = quality.total([F.when(c > 0, v * w).otherwise(0.0) for c, v, w in parts])
    weight = quality.total([F.when(c > 0, w).otherwise(0.0) for c, _, w in parts])
    score = F.coalesce(F.try_divide(top, weight), F.lit(0.0))
    issues = advice.said([(F.col("t") > 100, "slow"), (F.col("m") > 100, "memory"), (F.col("_db") < 0.7, "storage"), (F.col("r") < 20, "results")])
    return m.select("query", F.round(score, 6).alias("score"), F.round(score * (1 - 1.96 * 0.05), 6).alias("low"), F.round(score * (1 + 1.96 * 0.05), 6).alias("high"), F.array_join(issues, ",").alias("issues"))


QUERIES = {
    f.__name__: f
    for f in (cd1_block_contexts, cd2_indented_blocks, cd17_block_metadata, qd2_chunk_links, qd5_glossary_terms, qd10_chunk_recommendations, qd11_corpus_result, qa13_suggestions, qb8_issues, qc7_suggestions, md3_document_metadata, md10_prompts, md9_labelled_texts, rt13_golden_ranges, ag4_stated_totals, ag9_corpus_statistics, ag14_standard_report,
              ag18_regression_bands, ag20_storage_ratio, ch6_fence_faults, ch7_preservation, ch13_document_chunks, qe1_semantic_sections, qe5_duplicate_kinds, qe8_recommendations, rt12_performance_summary)
}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _said(pairs: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN {_q(s)} END" for t, s in pairs) + "], lambda x: x IS NOT NULL), '|')"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_T = "(SELECT id, content FROM crawled_pages WHERE length(content) > 0)"
_URLS = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(content, {_q(p)}, {g})" for p, g in advice.LINK_FORMS[:2]) + f"), regexp_extract_all(content, {_q(advice.LINK_FORMS[2][0])}))"
_BROKEN = r"""len(list_filter(u, lambda x: regexp_matches(x, '^\s*$|[<>"]|\s+')))"""
_FIRST = _STRIP.format(r"regexp_extract(p[i + 1], '^([^\n]*)\n', 1)")
_BLOCKS = rf"""
    p0 AS (SELECT id, string_split(content, '```') AS p FROM crawled_pages WHERE contains(content, '```')),
    p1 AS (SELECT id, p, unnest(range(1, len(p) - 1, 2)) AS i FROM p0),
    p2 AS (SELECT id, i, p, {_FIRST} AS f FROM p1),
    p3 AS (SELECT *, f <> '' AND NOT contains(f, ' ') AND length(f) < 20 AS named, array_to_string(p[1:i], '```') AS head FROM p2),
    p4 AS (SELECT id, i, CASE WHEN named THEN f ELSE '' END AS hint, {_STRIP.format("CASE WHEN named THEN regexp_replace(p[i + 1], '^[^" + chr(92) + "n]*" + chr(92) + "n', '') ELSE p[i + 1] END")} AS code, head, array_to_string(p[i + 2:], '```') AS tail FROM p3),
    blocks AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS block, hint, code, {_STRIP.format('right(head, 1000)')} AS before, {_STRIP.format('left(tail, 1000)')} AS after, length(head) - length(replace(head, chr(10), '')) AS start_line,
                      length(head) - length(replace(head, chr(10), '')) + length(code) - length(replace(code, chr(10), '')) AS end_line FROM p4 WHERE length(code) >= 25)"""
_DEFS = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(content, {_q(p)}, 1)" for p in advice.DEFINITIONS[:2]) + f"), regexp_extract_all(content, {_q(advice.DEFINITIONS[2])}, 1))"
_QC_SAID = [
    ("links > 0.4", "Critical: link density indicates navigation content"), ("links > 0.25 AND links <= 0.4", "High link density suggests navigation elements"), ("links > 0.15 AND links <= 0.25", "Moderate link density may include navigation"), ("keys > 0.05", "High navigation keyword density indicates navigation content"),
    ("keys > 0.02 AND keys <= 0.05", "Moderate navigation keywords detected"), ("item_words < 3", "List items too short - likely navigation"), ("item_words >= 3 AND item_words < 5", "Short list items may be navigation"), ("tags > 0.3", "High tag-to-text ratio indicates link-heavy navigation"),
    ("tags > 0.2 AND tags <= 0.3", "Moderate tag-to-text ratio"), ("short > 0.7", "High ratio of short lines indicates navigation"), ("short > 0.5 AND short <= 0.7", "Many short lines may indicate navigation"), ("few", "Word count below the minimum of the tier"),
]
_STORAGE = """SELECT n, content_bytes, metadata_bytes, round(content_bytes::DOUBLE / nullif(metadata_bytes, 0), 6) AS content_to_metadata, round(content_bytes::DOUBLE / nullif(content_bytes + metadata_bytes, 0), 6) AS content_to_total
    FROM (SELECT count(*) AS n, CAST(sum(strlen(coalesce(content, ''))) AS BIGINT) AS content_bytes, CAST(sum(strlen(concat_ws(',', url, metadata.headers, metadata.source, metadata.crawl_type))) AS BIGINT) AS metadata_bytes FROM crawled_pages)"""

SQL = {
    "cd1_block_contexts": f"WITH {_BLOCKS} SELECT id, block, hint, start_line, end_line, md5(before) AS before, md5(after) AS after, length(code) AS chars FROM blocks",
    "cd2_indented_blocks": rf"""WITH r AS (SELECT id, list_filter(list_transform(regexp_extract_all(content || chr(10), '(?m)((?:^(?:    |\t)[^\n]*\n)+)', 1), lambda x: {_STRIP.format("regexp_replace(x, '(?m)^(?:    |" + chr(92) + "t)', '', 'g')")}), lambda x: x <> '') AS b FROM {_T}),
        e AS (SELECT id, unnest(b) AS code, generate_subscripts(b, 1) - 1 AS block FROM r) SELECT id, CAST(block AS INTEGER) AS block, length(code) AS chars, md5(code) AS digest FROM e""",
    "qd2_chunk_links": rf"""SELECT id, len(u) AS links, len(list_filter(u, lambda x: regexp_matches(x, '^(?:/|#|\.\./|\./)'))) AS internal, len(list_filter(u, lambda x: regexp_matches(x, '^https?://'))) AS external, {_BROKEN} AS broken FROM (SELECT id, {_URLS} AS u FROM {_T})""",
    "qd5_glossary_terms": rf"""SELECT id, len(t) AS n, array_to_string(list_sort(t), '|') AS terms FROM (SELECT id, list_distinct(list_filter(list_transform({_DEFS}, lambda x: {_STRIP.format('x')}), lambda x: length(x) > 2)) AS t FROM {_T}) WHERE len(t) > 0""",
    "qd10_chunk_recommendations": f"""SELECT id, {_said([("kind = 'navigation'", "Exclude this chunk - contains only navigation elements"), ("n_kinds > 2", "Review CSS selectors to better exclude navigation elements"), ("chars < 100", "Combine with adjacent chunks to meet minimum content requirements"),
        ("NOT paragraphs AND NOT code", "Verify this chunk contains meaningful content"), ("broken > 0", "Fix broken or malformed links in the source content"), ("technical < 0.1", "Consider if this chunk provides valuable technical information")])} AS recommendations
        FROM {checks._CHECK} c JOIN (SELECT id, {_BROKEN} AS broken FROM (SELECT id, {_URLS} AS u FROM {_T})) USING (id)""",
    "qd11_corpus_result": f"""WITH s AS ({checks.SQL['ag11_corpus_score']}), k AS (SELECT count(*) FILTER (WHERE code) AS code, count(*) FILTER (WHERE glossary) AS glossary FROM {checks._CHECK})
        SELECT n, score, valid_share >= 0.7 AS enough_valid, content_share >= 0.8 AS enough_content, {_said([("navigation_share > 0.2", "High navigation contamination detected - review CSS exclusion selectors"), ("valid_share < 0.7", "Many chunks below quality standards - review chunking strategy"),
        ("code = 0 AND n > 5", "No code examples found - verify technical content is being preserved"), ("glossary = 0", "No glossary definitions detected - check if definitions are being preserved"), ("score < 0.6", "Overall quality below acceptable threshold - comprehensive review needed")])} AS recommendations FROM s, k""",
    "qa13_suggestions": f"""WITH j AS (SELECT q.*, CAST(named + streaks + heavy + repeated AS INTEGER) AS elements FROM ({pages._QA}) q JOIN ({pages.SQL['qa_navigation_elements']}) USING (id)),
        s AS (SELECT id, elements, {_said([("content_ratio < 0.5", "Content-to-navigation ratio is low. Consider using more specific CSS selectors to target main content areas."), ("link_density > 0.3", "High link density detected. Try excluding navigation elements and sidebars."),
        ("elements > 20", "High navigation element count. Add navigation-specific exclusion selectors."), ("words < 100", "Low word count. Check if main content areas are being targeted correctly.")])} AS s FROM j)
        SELECT id, elements, CASE WHEN s = '' THEN 'Quality metrics look good. Consider fine-tuning thresholds if needed.' ELSE s END AS suggestions FROM s""",
    "qb8_issues": f"""SELECT id, {_said([("artifacts > 5", "html artifacts"), ("script", "script contamination"), ("ratio < 0.6", "low content ratio"), ("words < 50", "too few words")])} AS issues, passed FROM ({pages.SQL['qb_extraction_check']})""",
    "qc7_suggestions": f"SELECT id, valid, {_said(_QC_SAID)} AS suggestions FROM ({pages.SQL['qc_selector_check']})",
    "md3_document_metadata": rf"""SELECT p.id, p.url AS source_url, {pages._HOST.replace('url', 'p.url')} AS domain, array_to_string(regexp_extract_all(p.content, '(?m)^#{{1,6}}[ \t]+([^\r\n]+)', 1), '|') AS headers,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(p.content, '```([a-zA-Z0-9_]+)?\n[\s\S]*?```', 1), lambda x: x <> ''))), ',') AS programming_languages, l.labels AS content_types FROM {pages._ROWS} p JOIN ({pages.SQL['md4_labels']}) l USING (id)""",
    "md10_prompts": f"""WITH w AS (SELECT url, sum(length(content)) AS n, count(*) AS k FROM crawled_pages WHERE url IS NOT NULL AND content IS NOT NULL GROUP BY url)
        SELECT p.id, CASE WHEN t.content_type IS NULL THEN e.content_type ELSE t.content_type END AS template, length(p.content) AS chunk_chars, CAST(least(25000, n + 2 * (k - 1)) AS BIGINT) AS document_chars
        FROM crawled_pages p JOIN w USING (url) LEFT JOIN ({pages.SQL['md8_content_types']}) t ON t.id = p.id LEFT JOIN ({pages.SQL['md8_content_types'].replace(pages._ROWS, "(SELECT id, url, '' AS content FROM crawled_pages WHERE content = '')")}) e ON e.id = p.id WHERE p.content IS NOT NULL""",
    "md9_labelled_texts": rf"""SELECT id, length(t) AS chars, md5(t) AS digest FROM (SELECT id, CASE WHEN h <> '' THEN '[' || upper(content_type) || '] ' || h || chr(10) || '---' || chr(10) || content ELSE content END AS t
        FROM (SELECT id, content, regexp_extract(content, '(?m)^#+[ \t]+([^\r\n]+)', 1) AS h FROM {pages._ROWS}) JOIN ({pages.SQL['md8_content_types']}) USING (id))""",
    "rt13_golden_ranges": f"""WITH q AS (SELECT id, words, score FROM ({pages._QA})), b AS (SELECT a.first_id, a.id, a.similarity, x.words BETWEEN floor(y.words * 0.9::DOUBLE) AND floor(y.words * 1.2::DOUBLE) AS w, round(x.score - y.score, 6) BETWEEN -0.1::DOUBLE AND 0.05::DOUBLE AS s FROM ({pages.SQL['rt13_stored_again']}) a JOIN q x ON x.id = a.id JOIN q y ON y.id = a.first_id)
        SELECT first_id, id, w AS words_in_range, s AS score_in_range, w AND s AND similarity >= 0.95 AS passed FROM b""",
    "ag4_stated_totals": "SELECT url, CAST(coalesce(sum(metadata.word_count), 0) AS BIGINT) AS total_words, min(metadata.crawl_time) AS first_crawl FROM crawled_pages WHERE url IS NOT NULL GROUP BY url",
    "ag9_corpus_statistics": "SELECT (SELECT count(*) FROM crawled_pages) AS n_rows, (SELECT count(DISTINCT source_id) FROM crawled_pages) AS n_sources, (SELECT round(avg(length(content)), 6) FROM (SELECT content FROM crawled_pages ORDER BY id LIMIT 100)) AS avg_chars",
    "ag14_standard_report": f"SELECT content_type, count(*) AS n, round(avg(score), 6) AS avg_score, round(100 * avg(CAST(score >= 0.7 AS INTEGER)), 6) AS percent_met FROM ({pages._QA}) JOIN ({pages.SQL['md8_content_types']}) USING (id) GROUP BY content_type",
    "ag18_regression_bands": f"""WITH q AS (SELECT id, score FROM ({pages._QA})), b AS (SELECT a.similarity, a.passed, round(x.score - y.score, 6) AS d FROM ({pages.SQL['rt13_stored_again']}) a JOIN q x ON x.id = a.id JOIN q y ON y.id = a.first_id)
        SELECT CASE WHEN similarity >= 0.95 THEN 'excellent' WHEN similarity >= 0.9 THEN 'good' WHEN similarity >= 0.8 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN d > 0.1 THEN 'improved' WHEN d < -0.1 THEN 'degraded' ELSE 'stable' END AS change, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM b GROUP BY 1, 2""",
    "ag20_storage_ratio": _STORAGE,
    "ch6_fence_faults": r"""SELECT * FROM (SELECT id, n % 2 = 1 AND NOT closes AS orphan_open, n % 2 = 1 AND closes AS orphan_close, regexp_matches(content, '```[a-zA-Z0-9_]*\n\s*```') AS empty_fence, n > 0 AND regexp_matches(content, '(async|function|def)([a-zA-Z_][a-zA-Z0-9_]*)') AS merged
        FROM (SELECT id, content, len(regexp_extract_all(content, '```')) AS n, regexp_matches(content, '```\s*\z') AS closes FROM crawled_pages WHERE length(content) > 0)) WHERE orphan_open OR orphan_close OR empty_fence OR merged""",
    "rt12_performance_summary": f"""WITH d AS ({_STORAGE}), m AS (SELECT query, avg(total_time_ms) AS t, avg(memory_delta_mb) AS m, avg(result_count) AS r FROM search_metrics WHERE query IS NOT NULL GROUP BY query),
        p AS (SELECT query, t, m, r, content_to_total AS c, CASE WHEN t > 0 THEN 0.3::DOUBLE * least(1.0::DOUBLE, 100.0::DOUBLE / t) ELSE 0 END + CASE WHEN m > 0 THEN 0.25::DOUBLE * greatest(0.0::DOUBLE, 1 - m / 100.0::DOUBLE) ELSE 0 END + CASE WHEN content_to_total > 0 THEN 0.2::DOUBLE * least(1.0::DOUBLE, content_to_total / 0.7::DOUBLE) ELSE 0 END + CASE WHEN r > 0 THEN 0.25::DOUBLE * least(1.0::DOUBLE, r / 20.0::DOUBLE) ELSE 0 END AS s,
                     CASE WHEN t > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN m > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN content_to_total > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r > 0 THEN 0.25::DOUBLE ELSE 0 END AS w FROM m, d),
        z AS (SELECT *, CASE WHEN w > 0 THEN s / w ELSE 0 END AS score FROM p)
        SELECT query, round(score, 6) AS score, round(score * (1 - 1.96::DOUBLE * 0.05::DOUBLE), 6) AS low, round(score * (1 + 1.96::DOUBLE * 0.05::DOUBLE), 6) AS high, concat_ws(',', CASE WHEN t > 100 THEN 'slow' END, CASE WHEN m > 100 THEN 'memory' END, CASE WHEN c < 0.7 THEN 'storage' END, CASE WHEN r < 20 THEN 'results' END) AS issues FROM z""",
}
