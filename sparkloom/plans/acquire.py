"""Queries of acquisition: markup to markdown, tiers of extraction, frameworks, the fallback loop; and their SQL.

Stored rows hold no markup, so the queries put it around them first, by one of five site skeletons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import host, occurrences, white_words
from sparkloom.operators import html, metadata, quality
from sparkloom.plans import pages
from sparkloom.session import table

#: Invented skeletons: what stands before and after a page's text. A row takes the one of its source.
SKELETONS = [
    ('<html><head><meta name="generator" content="mkdocs"><title>t</title></head><body><nav class="md-nav"><a href="/">Home</a> <a href="/docs">Docs</a></nav><div class="md-sidebar">Menu one</div><main class="md-main"><article class="md-content"><h1>Page<a class="headerlink" href="#p">#</a></h1>', "</article></main><footer>About us</footer></body></html>"),
    ('<html><body><div class="hub-sidebar"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div><main class="rm-Guides"><p class="breadcrumb">Home / Docs</p>', '</main><aside>Related pages</aside><script>track("x")</script></body></html>'),
    ('<html><head><meta name="generator" content="gitbook"></head><body><div class="book-summary">Summary</div><div class="book-body content">', '</div><!-- end of page --><footer>Terms &amp; more</footer></body></html>'),
    ('<html><body><header><a class="button" href="/login">Log in</a></header><div role="main">', '</div><div class="toc">On this page</div></body></html>'),
    ("<body><div>", '</div><div class="share social">Share this</div></body>'),
]
TIERS = range(4)


def page_html(source: Column, text: Column) -> Column:
    """The markup of a row; null for null text."""
    k = F.pmod(F.coalesce(source, F.lit(0)), F.lit(len(SKELETONS)))
    body = F.concat(F.lit("<p>"), F.replace(text, F.lit("\n\n"), F.lit("</p>\n<p>")), F.lit("</p>"))
    out = None
    for i, (before, after) in enumerate(SKELETONS):
        whole = F.concat(F.lit(before), body, F.lit(after))
        out = F.when(k == i, whole) if out is None else out.when(k == i, whole)
    return out


def _html(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawled_pages").filter(F.length("content") > 0)
    return rows.select("id", "url", page_html(F.col("source_id"), F.col("content")).alias("html"))


def htm1_markdown(spark: SparkSession, d: str) -> DataFrame:
    """HTM1, HTM2, HTM3, HTM5: main part, markdown, clean-up."""
    text = html.clean(html.to_markdown(html.main_part(F.col("html"))))
    rows = _html(spark, d).select("id", text.alias("t"))
    return rows.select("id", F.length("t").alias("chars"), F.md5("t").alias("digest"), F.regexp_count("t", F.lit(r"\[[^\]]*\]\([^)]*\)")).alias("links"), html.is_dynamic(F.col("t")).alias("dynamic"))


def htm4_tiers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(html.tier_table(), "tier int, least_words int, excluded string, links_dropped boolean")


def htm3_tier_texts(spark: SparkSession, d: str) -> DataFrame:
    """How much of a page each tier keeps."""
    return _html(spark, d).select("id", *[F.length(html.to_markdown(F.col("html"), t)).alias(f"chars_{t}") for t in range(5)])


def htm7_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """HTM7, HTM8, HTM9: framework by markup with its thresholds, and by host."""
    limits = spark.createDataFrame([(f.name, f.least_ratio, f.most_links, f.least_words) for f in html.FRAMEWORKS], "framework string, least_ratio double, most_links double, least_words int")
    rows = _html(spark, d).select("id", html.framework(F.col("html")).alias("framework"), html.framework_of_host(host(F.col("url"))).alias("of_host"))
    return rows.join(F.broadcast(limits), "framework").select("id", "framework", "of_host", "least_ratio", "most_links", "least_words")


#: Registrations of the query, after the fixed ones: suffixes of invented hosts.
MORE_DOMAINS = [("example", "main"), ("test", "article"), ("example.org", ".content")]


def htm10_registry(spark: SparkSession, d: str) -> DataFrame:
    """HTM10, HTM11, JN11: the selector registered for the host of every source."""
    registry = spark.createDataFrame([(x, s, i) for i, (x, s) in enumerate(html.REGISTRY + MORE_DOMAINS)], "registered string, selector string, ordinal int")
    return html.registered(table(spark, d, "sources").select("source_id", host(F.col("url")).alias("host")), "host", registry)


def htm12_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    found = html.diagnostic(F.col("html"))
    lists = ("nav_marks", "content_marks", "issues")
    return _html(spark, d).select("id", *[(F.array_join(c, ",") if n in lists else c).alias(n) for n, c in found.items()])


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every page once per tier, with the measures of its text there."""
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), html.clean(html.to_markdown(F.col("html"), t)).alias("content")) for t in TIERS])
    rows = _html(spark, d).select("id", F.inline(tiers))
    checks = quality.selector_check(F.col("content"))
    least = F.element_at(F.array(*[F.lit(x) for x in quality.TIER_WORDS]), F.col("tier") + 1)
    rows = rows.select("id", "tier", *[c.alias(n) for n, c in checks.items() if n != "few"], *[c.alias(f"qa_{n}") for n, c in quality.markdown_quality(F.col("content")).items()])
    score = quality.selector_score(*[F.col(n) for n in ("links", "keys", "item_words", "tags", "short")], F.col("words") < least)
    enhanced = quality.markdown_score(*[F.col(f"qa_{n}") for n in ("link_density", "content_ratio", "words", "paragraphs", "code_blocks", "coherence")])
    bar = F.element_at(F.array(*[F.lit(x) for x in quality.TIER_BARS]), F.col("tier") + 1)
    return rows.select("id", "tier", "words", score.alias("score"), enhanced.alias("enhanced"), (score >= bar).alias("valid"))


def htm14_fallback(spark: SparkSession, d: str) -> DataFrame:
    """HTM14: the first attempt that the selector check accepts and whose quality is at least 0.3, else the last one."""
    rows = _attempts(spark, d)
    passed = F.col("valid") & (F.col("enhanced") >= 0.3)
    place = F.when(passed, F.col("tier")).otherwise(F.lit(100) - F.col("tier"))
    best = rows.groupBy("id").agg(F.min_by(F.struct("tier", "words", "score", "enhanced", passed.alias("passed")), place).alias("b"))
    return best.select("id", "b.*")


def qc8_content_ratio(spark: SparkSession, d: str) -> DataFrame:
    """QC8: a rough share of content, from words that name navigation."""
    rows = pages._pages(spark, d)
    words, n = F.size(white_words(F.col("content"))), quality.total([occurrences(F.lower("content"), w) for w in html.GUIDING])
    return rows.select("id", F.round(F.when(words == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - n / words * 2)), 6).alias("ratio"))


def qc9_decisions(spark: SparkSession, d: str) -> DataFrame:
    """QC9: the quality by the enhanced score where it is known, else by the extraction check, for each row; and what holds if both are off or missing."""
    enhanced = pages.qa_markdown_quality(spark, d).select("id", F.col("score").alias("e"), F.col("retry").alias("r"))
    legacy = pages.qb_extraction_check(spark, d).select(F.col("id").alias("_id"), F.col("score").alias("l"), F.col("passed").alias("p"))
    # Empty rows have neither: they fail closed. Rows without a url are stored pieces that were not extracted: not checked.
    rows = table(spark, d, "crawled_pages").select("id", F.col("url").isNotNull().alias("wanted"), F.col("chunk_number").isNotNull().alias("measured"))
    both = rows.join(enhanced, "id", "left").join(legacy, F.col("id") == F.col("_id"), "left")
    how = F.when(F.col("e").isNotNull() & F.col("measured"), "enhanced").when(F.col("wanted") & F.col("l").isNotNull(), "legacy").when(~F.col("wanted"), "disabled").otherwise("failed")
    score = F.when(how == "enhanced", F.col("e")).when(how == "legacy", F.col("l")).when(how == "disabled", 1.0).otherwise(0.0)
    passed = F.when(how == "enhanced", ~F.col("r")).when(how == "legacy", F.col("p")).when(how == "disabled", True).otherwise(False)
    return both.select("id", how.alias("method"), score.alias("score"), passed.alias("passed"))


def src5_single_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: fetched pages of a url, pieces in order; the stored table stands for the network."""
    rows = table(spark, d, "crawled_pages").filter(F.col("url").isNotNull() & (F.length("content") > 0))
    first = rows.groupBy(metadata.defragmented(F.col("url")).alias("url")).agg(F.min_by(F.struct("id", F.length("content").alias("chars")), F.struct(F.coalesce("chunk_number", F.lit(2147483647)), "id")).alias("f"), F.count(F.lit(1)).alias("n_rows"))
    return first.select("url", "f.id", "f.chars", "n_rows")


QUERIES = {f.__name__: f for f in (htm1_markdown, htm3_tier_texts, htm4_tiers, htm7_frameworks, htm10_registry, htm12_diagnostic, htm14_fallback, qc8_content_ratio, qc9_decisions, src5_single_pages)}


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        x = f"regexp_replace({x}, '{_q(pattern)}', '{_q(by.replace('$', chr(92)))}', 'g')"
    return x


_BODY = "concat('<p>', replace(content, chr(10) || chr(10), '</p>' || chr(10) || '<p>'), '</p>')"
_HTML = f"(SELECT id, url, CASE (coalesce(source_id, 0) % {len(SKELETONS)} + {len(SKELETONS)}) % {len(SKELETONS)} " + " ".join(f"WHEN {i} THEN concat('{_q(a)}', {_BODY}, '{_q(b)}')" for i, (a, b) in enumerate(SKELETONS)) + " END AS html FROM crawled_pages WHERE length(content) > 0)"
_MAIN = f"coalesce(nullif(regexp_extract(regexp_extract(html, '{_q(html.MAIN[0])}', 1), '{_q(html.MAIN[1])}', 1), ''), " + ", ".join(f"nullif(regexp_extract(html, '{_q(p)}', 1), '')" for p in html.MAIN) + ", html)"


def _held(low: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({low}, w))"


def _sql_points(f: html.Framework) -> str:
    has = lambda x: f"contains(low, '{x}')"
    parts = [f"2 * CAST({has(c)} AS INTEGER)" for c in f.classes]
    quote = chr(34)
    parts += [f"3 * CAST({has(f'content={quote}{m}{quote}')} OR {has(f'name={quote}{m}{quote}')} AS INTEGER)" for m in f.metas]
    parts += [f"5 * CAST({has(f'name={quote}generator{quote}')} AND {has(g)} AS INTEGER)" for g in f.generators]
    strong = {"material_design": f"{has('md-main')} AND {has('md-sidebar')}", "readme_io": f"{has('rm-guides')} OR {has('hub-sidebar')}"}
    if f.name in strong:
        parts.append(f"10 * CAST({strong[f.name]} AS INTEGER)")
    return " + ".join(parts)


_FRAMEWORK = "CASE " + " ".join(f"WHEN {_sql_points(f)} >= 8 THEN '{f.name}'" for f in html.FRAMEWORKS[:-1]) + " ELSE 'generic' END"
_OF_HOST = "CASE " + " ".join(f"WHEN contains(lower({pages._HOST}), '{p}') THEN '{n}'" for p, n in html.HOST_PARTS) + " ELSE 'generic' END"
_ATTEMPT = " UNION ALL ".join(f"SELECT id, {t} AS tier, {sql_replaced(sql_replaced('html', html.extraction_rules(t)), html.CLEAN_RULES)} AS content FROM h" for t in TIERS)


def _tier_sql(t: int) -> str:
    """Selector check and markdown quality of one tier, by the SQL of those queries."""
    rows = f"(SELECT id, content FROM a WHERE tier = {t})"
    check = pages.SQL["qc_selector_check"].replace(pages._ROWS, rows).replace("words < 40 AS few", f"words < {quality.TIER_WORDS[t]} AS few").replace("score >= 0.5 AS valid", f"score >= {quality.TIER_BARS[t]} AS valid").replace("/ length(content)", "/ nullif(length(content), 0)")
    return f"SELECT c.id, {t} AS tier, c.words, c.score, q.score AS enhanced, c.valid FROM ({check}) c JOIN ({pages._QA.replace(pages._ROWS, rows)}) q USING (id)"


SQL = {
    "htm1_markdown": rf"""SELECT id, length(t) AS chars, md5(t) AS digest, {pages._n(r'\[[^\]]*\]\([^)]*\)', 't')} AS links, len({_held('lower(t)', html.DYNAMIC)}) > 0 AS dynamic
        FROM (SELECT id, {sql_replaced(sql_replaced('m', html.extraction_rules(0)), html.CLEAN_RULES)} AS t FROM (SELECT id, {_MAIN} AS m FROM {_HTML}))""",
    "htm3_tier_texts": f"SELECT id, {', '.join(f'length({sql_replaced("html", html.extraction_rules(t))}) AS chars_{t}' for t in range(5))} FROM {_HTML}",
    "htm4_tiers": "SELECT * FROM (VALUES " + ", ".join(f"({t}, {w}, '{x}', {str(k).lower()})" for t, w, x, k in html.tier_table()) + ") AS v(tier, least_words, excluded, links_dropped)",
    "htm7_frameworks": f"""WITH f AS (SELECT id, {_FRAMEWORK} AS framework, of_host FROM (SELECT id, lower(html) AS low, {_OF_HOST} AS of_host FROM {_HTML})),
        l AS (SELECT * FROM (VALUES {', '.join(f"('{f.name}', {f.least_ratio}::DOUBLE, {f.most_links}::DOUBLE, {f.least_words})" for f in html.FRAMEWORKS)}) AS v(framework, least_ratio, most_links, least_words))
        SELECT id, framework, of_host, least_ratio, most_links, least_words FROM f JOIN l USING (framework)""",
    "htm10_registry": f"""WITH s AS (SELECT source_id, {pages._HOST} AS host FROM sources), r AS (SELECT * FROM (VALUES {', '.join(f"('{x}', '{s}', {i})" for i, (x, s) in enumerate(html.REGISTRY + MORE_DOMAINS))}) AS v(registered, selector, ordinal)),
        m AS (SELECT source_id, registered, selector, row_number() OVER (PARTITION BY source_id ORDER BY trim(host) <> registered, ordinal) AS n FROM s JOIN r ON ends_with(trim(host), registered))
        SELECT s.source_id, s.host, registered, selector FROM s LEFT JOIN (SELECT * FROM m WHERE n = 1) k USING (source_id)""",
    "htm12_diagnostic": f"""WITH l AS (SELECT id, lower(html) AS low FROM {_HTML}), m AS (SELECT id, low, {_FRAMEWORK} AS framework, {_held('low', html.NAV_MARKS)} AS nav, {_held('low', html.CONTENT_MARKS)} AS con FROM l)
        SELECT id, framework, CASE WHEN framework <> 'generic' THEN 'high' ELSE 'low' END AS confidence, len({_held('low', html.NAV_WORDS)}) > 0 AS has_navigation, array_to_string(nav, ',') AS nav_marks, array_to_string(con, ',') AS content_marks,
               concat_ws(',', CASE WHEN len(nav) > 3 THEN 'High navigation complexity detected' END, CASE WHEN len(con) = 0 THEN 'No clear content containers found' END) AS issues FROM m""",
    "htm14_fallback": f"""WITH h AS (SELECT * FROM {_HTML}), a AS ({_ATTEMPT}), t AS ({' UNION ALL '.join(map(_tier_sql, TIERS))}),
        p AS (SELECT *, valid AND enhanced >= 0.3 AS passed FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN passed THEN tier ELSE 100 - tier END) AS n FROM p)
        SELECT id, tier, words, score, enhanced, passed FROM o WHERE n = 1""",
    "qc8_content_ratio": f"""SELECT id, round(CASE WHEN w = 0 THEN 0 ELSE greatest(0.0::DOUBLE, 1 - n::DOUBLE / w * 2) END, 6) AS ratio
        FROM (SELECT id, {pages._words('content')} AS w, {' + '.join(pages._occ('lower(content)', x) for x in html.GUIDING)} AS n FROM {pages._ROWS})""",
    "qc9_decisions": f"""WITH e AS ({pages._QA}), l AS ({pages.SQL['qb_extraction_check']}), b AS (SELECT p.id, p.url IS NOT NULL AS wanted, p.chunk_number IS NOT NULL AS measured, e.score AS e, e.retry AS r, l.score AS l, l.passed AS p FROM crawled_pages p LEFT JOIN e USING (id) LEFT JOIN l USING (id)),
        m AS (SELECT *, CASE WHEN e IS NOT NULL AND measured THEN 'enhanced' WHEN wanted AND l IS NOT NULL THEN 'legacy' WHEN NOT wanted THEN 'disabled' ELSE 'failed' END AS method FROM b)
        SELECT id, method, CASE method WHEN 'enhanced' THEN e WHEN 'legacy' THEN l WHEN 'disabled' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE method WHEN 'enhanced' THEN NOT r WHEN 'legacy' THEN p WHEN 'disabled' THEN true ELSE false END AS passed FROM m""",
    "src5_single_pages": """SELECT url, f.id AS id, f.chars AS chars, n_rows FROM (SELECT regexp_replace(url, '#.*$', '') AS url, arg_min({'id': id, 'chars': length(content)}, {'c': coalesce(chunk_number, 2147483647), 'i': id}) AS f, count(*) AS n_rows
        FROM crawled_pages WHERE url IS NOT NULL AND length(content) > 0 GROUP BY 1)""",
}
