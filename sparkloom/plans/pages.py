"""Queries of page metadata and quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import host
from sparkloom.operators import metadata, quality
from sparkloom.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select("id", "url", "content").filter(F.length("content") > 0)


def src1_url_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_pages").select("id", metadata.url_kind(F.col("url")).alias("kind"))


def md6_md7_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull())
    return rows.select("id", metadata.defragmented(F.col("url")).alias("url"), metadata.document_id(F.col("url")).alias("document_id"), metadata.framework(host(F.col("url"))).alias("framework"))


def md1_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", metadata.heading_title(F.col("content")).alias("title"))


def md1_title_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of MD1, for every row; md1_titles and its SQL hold its first step alone, which is MD2."""
    return table(spark, d, "crawled_pages").select("id", metadata.title(F.col("content")).alias("title"))


def md3_document_numbers(spark: SparkSession, d: str) -> DataFrame:
    numbers = metadata.document_numbers(F.col("content"), host(F.col("url")))
    rows = _pages(spark, d).select("id", *[c.alias(n) for n, c in numbers.items()])
    score = metadata.complexity(F.col("words"), F.col("headers"), F.col("fences"), F.col("links"))
    return rows.withColumn("complexity", score).withColumn("category", F.when(F.col("complexity") >= 70, "high").when(F.col("complexity") >= 40, "medium").otherwise("low"))


def md4_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", F.array_join(metadata.labels(F.col("content")), ",").alias("labels"))


def md8_content_types(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", metadata.content_type(F.col("content"), F.col("url")).alias("content_type"))


def ch14_sections(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", metadata.headers(F.col("content")).alias("headers"), F.length("content").alias("chars"))


def _qa(spark: SparkSession, d: str) -> DataFrame:
    m = quality.markdown_quality(F.col("content"))
    rows = _pages(spark, d).select("id", *[c.alias(n) for n, c in m.items()])
    score = quality.markdown_score(F.col("link_density"), F.col("content_ratio"), F.col("words"), F.col("paragraphs"), F.col("code_blocks"), F.col("coherence"))
    rows = rows.withColumn("score", score)
    return rows.withColumn("category", quality.category(F.col("score"), [(0.8, "excellent"), (0.7, "good"), (0.5, "fair")], "poor")).withColumn("retry", F.col("score") < 0.3)


def qa_markdown_quality(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d)


def qa_navigation_elements(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", *[c.alias(n) for n, c in quality.navigation_elements(F.col("content")).items()])


def ag10_quality_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return _qa(spark, d).groupBy("category").agg(n.alias("n_rows"), F.count_if(F.col("retry")).alias("n_retry"), F.round(F.avg("score"), 6).alias("avg_score"))


def qb_extraction_check(spark: SparkSession, d: str) -> DataFrame:
    m = quality.extraction_check(F.col("content"))
    rows = _pages(spark, d).select("id", *[c.alias(n) for n, c in m.items()])
    rows = rows.withColumn("score", quality.extraction_score(*[F.col(n) for n in ("words", "artifacts", "script", "space", "ratio", "density", "golden")]))
    rows = rows.withColumn("category", quality.category(F.col("score"), [(0.9, "excellent"), (0.75, "good"), (0.6, "fair")], "poor"))
    return rows.withColumn("passed", (F.col("artifacts") <= 5) & ~F.col("script") & (F.col("ratio") >= 0.6) & (F.col("words") >= 50) & (F.col("score") >= 0.6))


def qc_selector_check(spark: SparkSession, d: str) -> DataFrame:
    m = quality.selector_check(F.col("content"), tier=1)
    rows = _pages(spark, d).select("id", *[c.alias(n) for n, c in m.items()])
    rows = rows.withColumn("score", quality.selector_score(*[F.col(n) for n in ("links", "keys", "item_words", "tags", "short", "few")]))
    return rows.withColumn("valid", F.col("score") >= 0.5)


def qe4_duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of at least five words that a page repeats word for word."""
    blocks = F.filter(F.transform(F.split("content", "\n\n"), lambda b: F.lower(F.trim(F.regexp_replace(b, r"\s+", " ")))), lambda b: (F.size(F.split(b, " ")) >= 5) & ~F.startswith(b, F.lit("#")))
    return _pages(spark, d).select("id", F.size(blocks).alias("blocks"), (F.size(blocks) - F.size(F.array_distinct(blocks))).alias("repeats"))


def rt13_stored_again(spark: SparkSession, d: str) -> DataFrame:
    """Rows stored again under a new id beside their first version: Jaccard similarity of their words (QB9, RT13, SET3)."""
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull() & F.col("chunk_number").isNotNull() & F.col("content").isNotNull())
    first = rows.groupBy("url", "chunk_number").agg(F.min("id").alias("first_id"), F.max("id").alias("id")).filter("id > first_id")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    both = first.join(rows.select(F.col("id").alias("first_id"), F.col("content").alias("_a")), "first_id").join(rows.select("id", F.col("content").alias("_b")), "id")
    a, b = words(F.col("_a")), words(F.col("_b"))
    union = F.size(F.array_union(a, b))
    sim = F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union), 6)
    return both.select("first_id", "id", sim.alias("similarity"), (sim >= 0.8).alias("passed"))


QUERIES = {
    f.__name__: f
    for f in (src1_url_kinds, md6_md7_addresses, md1_titles, md1_title_chain, md3_document_numbers, md4_labels, md8_content_types, ch14_sections, qa_markdown_quality, qa_navigation_elements, ag10_quality_report, qb_extraction_check, qc_selector_check, qe4_duplicate_blocks, rt13_stored_again)
}

_ROWS = "(SELECT id, url, content FROM crawled_pages WHERE length(content) > 0)"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_WW = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_N = "len(regexp_extract_all({}, '{}'))"


def _words(x: str) -> str:
    return f"len({_WW.format(x)})"


def _n(pattern: str, x: str = "content") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _occ(x: str, word: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{word}', ''))) / {len(word)} AS INTEGER)"


def _band(x: str, op: str, steps: list[tuple[float, float]]) -> str:
    return "(CASE " + " ".join(f"WHEN {x} {op} {a} THEN {b}::DOUBLE" for a, b in steps) + " ELSE 1.0::DOUBLE END)"


def _has(words: list[str], x: str) -> str:
    return " + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in words)


_NAV = "|".join(quality.NAVIGATION)
_LINES = r"list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '^[\t\r ]+|[\t\r ]+$', '', 'g'))), lambda x: x <> '')"
_LINKS = r"list_concat(list_concat(regexp_extract_all(content, '\[([^\]]*)\]\(([^)]*)\)', 2), regexp_extract_all(content, '\[([^\]]*)\]\[([^\]]*)\]', 2)), regexp_extract_all(content, 'https?://[^\s\]]+'))"
_CLEAN_WORDS = _n(r"[\p{L}\p{N}_]+", r"regexp_replace(content, '[#*`\[\]()_~]', '', 'g')")
_QA = rf"""
    WITH l AS (SELECT id, content, lower(content) AS low, {_LINKS} AS links, {_LINES} AS lines, {_CLEAN_WORDS} AS words,
                      {_n(r'(?m)^#+\s+.+$')} AS headings, len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: {_words('p')} >= 11)) AS paragraphs,
                      {_n(r'```[\s\S]*?```')} + {_n('`[^`\\n]+`')} // 5 AS code_blocks FROM {_ROWS}),
         m AS (SELECT id, words, len(links) AS links, len(list_distinct(links)) AS unique_links, round(len(links)::DOUBLE / greatest(words, 1), 6) AS link_density, headings, paragraphs, code_blocks,
                      round(CASE WHEN len(lines) = 0 THEN 0 ELSE len(list_filter(lines, lambda x: NOT (regexp_matches(lower(x), '{_NAV}') OR (regexp_matches(x, '^[-*+]\s+.*\[.*\]') AND {_words('x')} <= 8)
                             OR ({_words('x')} <= 3 AND (contains(x, '>') OR contains(x, '/')))))) / len(lines) END, 6) AS content_ratio,
                      round((CASE WHEN headings > 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN contains(content, chr(10) || chr(10)) THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN contains(content, '`') THEN 0.2::DOUBLE ELSE 0 END)
                             + (CASE WHEN ({_has(quality.TECHNICAL, 'low')}) >= 3 THEN 0.2::DOUBLE ELSE 0 END), 6) AS coherence FROM l),
         b AS (SELECT *, {_band('link_density', '>', [(0.4, 0.05), (0.3, 0.15), (0.2, 0.4), (0.1, 0.7)])} * {_band('content_ratio', '<', [(0.3, 0.1), (0.5, 0.3), (0.7, 0.6), (0.9, 0.8)])} * {_band('words', '<', [(20, 0.05), (50, 0.2), (100, 0.5)])} AS base FROM m),
         s AS (SELECT * EXCLUDE (base), round(CASE WHEN base > 0.3 THEN least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, base * (CASE WHEN paragraphs >= 3 THEN 1.2::DOUBLE WHEN paragraphs >= 2 THEN 1.1::DOUBLE ELSE 1 END))
                      * (CASE WHEN code_blocks > 0 THEN 1.1::DOUBLE ELSE 1 END)) * (CASE WHEN coherence > 0.7 THEN 1.15::DOUBLE ELSE 1 END)) ELSE base END, 6) AS score FROM b)
    SELECT *, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS category, score < 0.3 AS retry FROM s"""
_TYPES_WHERE = {name: places for name, places, _ in metadata.TYPES}


def _sql_words(words: list[str], x: str) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({x}, w)))"


SQL = {
    "src1_url_kinds": r"""SELECT id, CASE WHEN url IS NULL THEN NULL WHEN url LIKE '%.txt' THEN 'text' WHEN url LIKE '%sitemap.xml' OR contains(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), 'sitemap') THEN 'sitemap' ELSE 'page' END AS kind FROM crawled_pages""",
    "md6_md7_addresses": rf"""SELECT id, regexp_replace(url, '#.*$', '') AS url, replace(regexp_extract(url, '^[a-zA-Z]+://([^?#]*)', 1), '/', '_') AS document_id,
        CASE WHEN regexp_matches({_HOST}, '{metadata.FRAMEWORKS[0][1]}') THEN 'material_design' WHEN regexp_matches({_HOST}, '{metadata.FRAMEWORKS[1][1]}') THEN 'readme_io' WHEN regexp_matches({_HOST}, '{metadata.FRAMEWORKS[2][1]}') THEN 'gitbook' ELSE 'generic' END AS framework
        FROM crawled_pages WHERE url IS NOT NULL""",
    "md1_titles": rf"""SELECT id, CASE WHEN t <> '' THEN trim(regexp_replace(t, '[#*_`]', '', 'g')) END AS title FROM (SELECT id, regexp_extract(content, '(?m)^[ \t]*# ([^\r\n]*\S)', 1) AS t FROM {_ROWS})""",
    "md3_document_numbers": rf"""
        WITH l AS (SELECT id, content, {_HOST} AS h, {_WW.format('content')} AS w, regexp_extract_all(content, '(?m)^(#{{1,6}})[ \t]+[^\r\n]+', 1) AS m, regexp_extract_all(content, '\[([^\]]*)\]\(([^)]+)\)', 2) AS k FROM {_ROWS}),
             n AS (SELECT id, len(w) AS words, length(content) AS chars, len(m) AS headers, coalesce(list_max(list_transform(m, lambda x: length(x))), 0) AS depth, {_n(r'```([a-zA-Z0-9_]+)?\n([\s\S]*?)```')} AS fences, len(k) AS links,
                          len(list_filter(k, lambda u: regexp_matches(u, '^https?://') AND regexp_extract(u, '^https?://([^/?#]*)', 1) <> coalesce(h, ''))) AS external, greatest(1, CAST(round_even(len(w) / 200.0, 0) AS INTEGER)) AS minutes FROM l),
             c AS (SELECT *, links - external AS internal, (CASE WHEN words > 5000 THEN 30 WHEN words > 2000 THEN 20 WHEN words > 500 THEN 10 ELSE 0 END) + (CASE WHEN headers > 10 THEN 25 WHEN headers > 5 THEN 15 WHEN headers > 2 THEN 10 ELSE 0 END)
                          + (CASE WHEN fences > 10 THEN 25 WHEN fences > 5 THEN 15 WHEN fences > 1 THEN 10 ELSE 0 END) + (CASE WHEN links > 20 THEN 20 WHEN links > 10 THEN 15 WHEN links > 3 THEN 10 ELSE 0 END) AS complexity FROM n)
        SELECT *, CASE WHEN complexity >= 70 THEN 'high' WHEN complexity >= 40 THEN 'medium' ELSE 'low' END AS category FROM c""",
    "md4_labels": f"""SELECT id, coalesce(nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN {_sql_words(w, 'low')} > 0 THEN '{n}' END" for n, w in metadata.LABELS)}], lambda x: x IS NOT NULL), ','), ''), 'general') AS labels
        FROM (SELECT id, lower(content) AS low FROM {_ROWS})""",
    "md8_content_types": f"""WITH s AS (SELECT id, lower(coalesce(url, '')) AS u, {', '.join(f"{_sql_words(w, 'lower(content)')} AS s_{n}" for n, _, w in metadata.TYPES)} FROM {_ROWS}),
        b AS (SELECT *, greatest({', '.join(f's_{n}' for n, _, _ in metadata.TYPES)}) AS best FROM s)
        SELECT id, CASE {' '.join(f"WHEN {_sql_words(_TYPES_WHERE[n], 'u')} > 0 THEN '{n}'" for n in metadata.ADDRESS_ORDER)} WHEN best < 2 THEN 'general' {' '.join(f"WHEN s_{n} = best THEN '{n}'" for n, _, _ in metadata.TYPES)} END AS content_type FROM b""",
    "ch14_sections": rf"""SELECT id, array_to_string(regexp_extract_all(content, '(?m)^(#+[ \t]+[^\r\n]+)', 1), '; ') AS headers, length(content) AS chars FROM {_ROWS}""",
    "qa_markdown_quality": _QA,
    "qa_navigation_elements": rf"""
        WITH t AS (SELECT id, content, lower(content) AS low, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^[\t\r ]+|[\t\r ]+$', '', 'g')) AS lines FROM {_ROWS}),
             e AS (SELECT id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM t),
             h AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM e WHERE regexp_matches(x, '^[-*+]\s+.*\[.*\]\(.*\)')),
             r AS (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY i) AS run FROM h),
             s AS (SELECT id, sum((CASE WHEN regexp_matches(lower(x), '{"|".join(quality.INTEGRATION)}') THEN 2 ELSE 1 END) + (CASE WHEN run >= 5 THEN 2 * run ELSE 0 END)) AS streaks FROM r GROUP BY id),
             p AS (SELECT id, regexp_replace(regexp_replace(x, '\[[^\]]*\]', '[T]', 'g'), '\([^)]*\)', '(U)', 'g') AS shape, count(*) AS n FROM e WHERE contains(x, '[') AND contains(x, '](') GROUP BY 1, 2),
             q AS (SELECT id, sum(2 * n) AS repeated FROM p WHERE n >= 3 GROUP BY id),
             d AS (SELECT *, {_words('content')} AS words, {_n(r'\[([^\]]*)\]\([^)]*\)')}::DOUBLE / nullif({_words('content')}, 0) AS density FROM t)
        SELECT d.id, {' + '.join(_n(p, 'low') for p in quality.NAVIGATION)} AS named, CAST(coalesce(streaks, 0) AS INTEGER) AS streaks,
               CAST(CASE WHEN words < 10 THEN 0 WHEN density > 0.4 THEN floor(density * 50) WHEN density > 0.2 THEN floor(density * 20) ELSE 0 END AS INTEGER) AS heavy, CAST(coalesce(repeated, 0) AS INTEGER) AS repeated
        FROM d LEFT JOIN s USING (id) LEFT JOIN q USING (id)""",
    "ag10_quality_report": f"SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE retry) AS n_retry, round(avg(score), 6) AS avg_score FROM ({_QA}) GROUP BY category",
    "qb_extraction_check": rf"""
        WITH t AS (SELECT id, content, lower(content) AS low, {_words('content')} AS words FROM {_ROWS}),
             m AS (SELECT id, words, {' + '.join(_occ('low', a) for a in quality.ARTIFACTS)} + {_n('<[^>]+>')} AS artifacts,
                          {' OR '.join(f"contains(low, '{s}')" for s in quality.SCRIPTS)} OR regexp_matches(low, 'function\s*\([^)]*\)\s*\{{') OR regexp_matches(low, 'var\s+[a-z0-9_]+\s*=') OR regexp_matches(low, 'document\.[a-z0-9_]+') OR regexp_matches(low, 'window\.[a-z0-9_]+') AS script,
                          {_n(r'\n\s*\n\s*\n\s*\n')} > 3 OR {_n(r'\s')}::DOUBLE / length(content) > 0.15 AS space,
                          round(CASE WHEN words = 0 THEN 0 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - least(({' + '.join(_occ('low', w) for w in quality.NOISE)})::DOUBLE / words, 1.0::DOUBLE) * 2) END, 6) AS ratio,
                          round(CASE WHEN words = 0 THEN 0 ELSE ({_n(r'\[([^\]]+)\]\(([^)]+)\)')} + {_n(r'https?://[^\s]+')})::DOUBLE / words END, 6) AS density,
                          greatest(0.0::DOUBLE, (CAST(regexp_matches(content, '(?m)^# .+') AS INTEGER) + CAST(regexp_matches(content, '(?m)^## .+') AS INTEGER) + CAST(regexp_matches(content, '\[.+\]\(.+\)') AS INTEGER) + CAST(regexp_matches(content, '```[a-zA-Z0-9_]*\n[^\n]*\n```') AS INTEGER)) / 4.0::DOUBLE
                                   - (CAST(regexp_matches(content, '<[a-zA-Z0-9_]+[^>]*>') AS INTEGER) + CAST(regexp_matches(content, 'javascript:') AS INTEGER) + CAST(regexp_matches(content, 'onclick=') AS INTEGER) + CAST(regexp_matches(content, '\n\s*\n\s*\n\s*\n') AS INTEGER)) / 4.0::DOUBLE) AS golden FROM t),
             s AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.8::DOUBLE + 0.2::DOUBLE * (CASE WHEN words >= 50 THEN least(1.0::DOUBLE, words / 200.0::DOUBLE) ELSE words / 50.0::DOUBLE END)) * (CASE WHEN artifacts > 0 THEN 1 - least(0.5::DOUBLE, artifacts / 10.0::DOUBLE) ELSE 1 END)
                          * (CASE WHEN script THEN 0.7::DOUBLE ELSE 1 END) * (0.7::DOUBLE + 0.3::DOUBLE * ratio) * (CASE WHEN density > 0.3 THEN 1 - least(0.2::DOUBLE, (density - 0.3::DOUBLE) * 2) ELSE 1 END) * (CASE WHEN space THEN 0.9::DOUBLE ELSE 1 END) * (0.8::DOUBLE + 0.2::DOUBLE * golden))), 6) AS score FROM m)
        SELECT *, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.75 THEN 'good' WHEN score >= 0.6 THEN 'fair' ELSE 'poor' END AS category, artifacts <= 5 AND NOT script AND ratio >= 0.6 AND words >= 50 AND score >= 0.6 AS passed FROM s""",
    "qc_selector_check": rf"""
        WITH t AS (SELECT id, content, lower(content) AS low, {_words('content')} AS words, regexp_extract_all(content, '(?m)^[ \t]*[-*+][ \t]+([^\r\n]+)', 1) AS items, list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$')) AS lines FROM {_ROWS}),
             m AS (SELECT id, words, round(CASE WHEN words > 0 THEN {_n(r'\[([^\]]*)\]\([^)]*\)')}::DOUBLE / words ELSE 0 END, 6) AS links, round(CASE WHEN words > 0 THEN ({' + '.join(_occ('low', w) for w in quality.KEYWORDS)})::DOUBLE / words ELSE 0 END, 6) AS keys,
                          round(CASE WHEN len(items) > 0 THEN list_sum(list_transform(items, lambda x: {_words('x')}))::DOUBLE / len(items) END, 6) AS item_words, round({_n(r'[#*`\[\]()_~]')}::DOUBLE / length(content), 6) AS tags,
                          round(CASE WHEN len(lines) > 5 THEN len(list_filter(lines, lambda x: {_words('x')} <= 4))::DOUBLE / len(lines) END, 6) AS short, words < 40 AS few FROM t),
             s AS (SELECT *, round({_band('links', '>', [(0.4, 0.1), (0.25, 0.3), (0.15, 0.6)])} * {_band('keys', '>', [(0.05, 0.2), (0.02, 0.5)])} * {_band('tags', '>', [(0.3, 0.3), (0.2, 0.6)])} * {_band('item_words', '<', [(3, 0.15), (5, 0.4)])} * {_band('short', '>', [(0.7, 0.15), (0.5, 0.4)])} * (CASE WHEN few THEN 0.2::DOUBLE ELSE 1 END), 6) AS score FROM m)
        SELECT *, score >= 0.5 AS valid FROM s""",
    "qe4_duplicate_blocks": rf"""SELECT id, len(b) AS blocks, len(b) - len(list_distinct(b)) AS repeats FROM (SELECT id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda b: lower(trim(regexp_replace(b, '\s+', ' ', 'g')))),
        lambda b: len(string_split(b, ' ')) >= 5 AND NOT starts_with(b, '#')) AS b FROM {_ROWS})""",
    "rt13_stored_again": rf"""WITH r AS (SELECT * FROM crawled_pages WHERE url IS NOT NULL AND chunk_number IS NOT NULL AND content IS NOT NULL), f AS (SELECT min(id) AS first_id, max(id) AS id FROM r GROUP BY url, chunk_number HAVING max(id) > min(id)),
        w AS (SELECT first_id, f.id, list_distinct({_WW.format('lower(a.content)')}) AS x, list_distinct({_WW.format('lower(b.content)')}) AS y FROM f JOIN r a ON a.id = first_id JOIN r b ON b.id = f.id),
        s AS (SELECT first_id, id, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similarity FROM w)
        SELECT *, similarity >= 0.8 AS passed FROM s""",
}
