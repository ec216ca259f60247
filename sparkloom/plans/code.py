"""Queries of code blocks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import code as C
from sparkloom.session import table


def cd1_fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.fenced_blocks(table(spark, d, "crawled_pages").select("id", "content"), "id", "content")


def _code(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_examples").filter(F.col("content").isNotNull()).select("id", "content", F.col("programming_language").alias("hint"))
    return rows.withColumn("language", C.language(F.col("hint"), F.col("content")))


def cd4_languages(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("id", "language", C.from_content(F.col("content")).alias("seen"))


def cd6_complexity(spark: SparkSession, d: str) -> DataFrame:
    rows = _code(spark, d).withColumn("nesting", C.nesting(F.col("content"), F.col("language")))
    return rows.select("id", "language", "nesting", C.cyclomatic(F.col("content")).alias("cyclomatic"), C.algorithmic(F.col("content")).alias("algorithmic"), C.complexity(F.col("content"), F.col("language"), F.col("nesting")).alias("complexity"))


def cd12_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("id", C.summary(F.col("content"), F.col("language")).alias("summary"), F.array_join(C.identifiers(F.col("content"), F.col("language")), ",").alias("identifiers"))


def cd18_processed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Valid blocks of all pages with language and complexity, as rows ready for the store."""
    rows = C.fenced_blocks(table(spark, d, "crawled_pages").select("id", "content"), "id", "content").withColumn("language", C.language(F.col("hint"), F.col("code")))
    rows = rows.filter(C.valid(F.col("code"), F.col("language"))).withColumn("nesting", C.nesting(F.col("code"), F.col("language")))
    return rows.select("id", "block", "language", F.length("code").alias("chars"), C.complexity(F.col("code"), F.col("language"), F.col("nesting")).alias("complexity"))


def cd20_language_counts(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (cd1_fenced_blocks, cd4_languages, cd6_complexity, cd12_summaries, cd18_processed_blocks, cd20_language_counts)}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _rx(x: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_q(flags + p)})" for p in patterns) + ")"


def _seen(x: str) -> str:
    out = []
    for name, patterns, literals in C.RULES:
        test = _rx(x, patterns) + (f" OR {_has(x, literals)}" if literals else "") + (f" OR (contains({x}, ': ') AND {_has(x, ['interface ', 'type '])})" if name == "typescript" else "")
        value = f"(CASE WHEN {_has(x, ['std::', 'cout <<', 'cin >>'])} THEN 'cpp' ELSE 'c' END)" if name == "c" else _q(name)
        out.append(f"WHEN {test} THEN {value}")
    bare = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return (
        "(CASE " + " ".join(out) + rf" WHEN regexp_matches({x}, '<\w+[^>]*>') AND regexp_matches({x}, '</\w+>') THEN 'html' WHEN regexp_matches({x}, '\w+\s*\{{[^}}]*\}}') AND contains({x}, ':') AND contains({x}, ';') THEN 'css'"
        rf" WHEN starts_with({x}, '#!/bin/') OR regexp_matches({x}, '\$\w+') OR {_has(x, [' && ', ' || '])} THEN 'shell'"
        rf""" WHEN starts_with({bare}, '{{') AND ends_with({bare}, '}}') AND contains({x}, '"') AND contains({x}, ':') THEN 'json' ELSE 'unknown' END)"""
    )


def _lang(hint: str, x: str) -> str:
    alias = " ".join(f"WHEN lower({hint}) = {_q(a)} THEN {_q(b)}" for a, b in C.ALIASES.items())
    return f"(CASE WHEN lower({hint}) IN ({', '.join(map(_q, C.LANGUAGES))}) THEN lower({hint}) {alias} ELSE {_seen(x)} END)"


_CODE = f"(SELECT id, content, {_lang('programming_language', 'content')} AS language FROM code_examples WHERE content IS NOT NULL)"
_BLOCKS = r"""(SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS block, hint, code FROM (
    SELECT id, i, CASE WHEN named THEN first ELSE '' END AS hint, regexp_replace(CASE WHEN named THEN regexp_replace(part, '^[^\n]*\n', '') ELSE part END, '^\s+|\s+$', '', 'g') AS code FROM (
        SELECT *, first <> '' AND NOT contains(first, ' ') AND length(first) < 20 AS named FROM (
            SELECT id, i, part, trim(regexp_replace(regexp_extract(part, '^([^\n]*)\n', 1), '\s+$', '')) AS first FROM (
                SELECT id, unnest(p) AS part, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT id, string_split(content, '```') AS p FROM crawled_pages WHERE contains(content, '```')))
            WHERE i % 2 = 0 AND i < n))) WHERE length(code) >= 25)"""


def _sum(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {_q(p)}) AS INTEGER)" for p in patterns) + ")"


def _algo(x: str) -> str:
    return f"CAST(least(2, floor(least(1.0::DOUBLE, {' + '.join(f'(CASE WHEN regexp_matches({x}, {_q(p)}) THEN 0.5::DOUBLE ELSE 0 END)' for p in C.CONTROL)}) + (CASE WHEN {_sum(x, C.ADVANCED)} >= 3 THEN 1.0::DOUBLE WHEN {_sum(x, C.ADVANCED)} >= 1 THEN 0.5::DOUBLE ELSE 0 END))) AS INTEGER)"


def _complexity(x: str) -> str:
    """Over columns language, nesting and the text."""
    share = f"(CASE WHEN language IN ('json', 'yaml', 'xml') THEN 0.5::DOUBLE WHEN language IN ('html', 'css') THEN 0.7::DOUBLE WHEN language = 'sql' THEN 0.8::DOUBLE WHEN language IN ({', '.join(map(_q, C.PROGRAMS))}) THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END)"
    n = f"len(string_split({x}, chr(10)))"
    lines = rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"
    some = lambda p: f"CAST(len(list_filter({lines}, lambda l: regexp_matches(l, {_q(p)}))) > 0 AS INTEGER)"
    json = rf"(CASE WHEN NOT coalesce(json_valid({x}) AND json_type(TRY_CAST({x} AS JSON)) = 'OBJECT', false) THEN 0 WHEN len(regexp_extract_all({x}, '\{{')) - 1 > 3 OR len(regexp_extract_all({x}, '\[')) > 2 THEN 2 WHEN len(regexp_extract_all({x}, '\{{')) - 1 > 1 OR len(regexp_extract_all({x}, '\[')) > 0 THEN 1 ELSE 0 END)"
    yaml = f"least(10, 1 + {some(':')} + {some(r'\[|^-')} + {some('[&*]|<<')} * 2 + {some('[|>]')} + CAST(contains({x}, '---') AS INTEGER))"
    hits = "(CASE " + " ".join(f"WHEN language = {_q(k)} THEN least(4, {_sum(x, v)})" for k, v in C.DEMANDING.items()) + " ELSE 0 END)"
    return f"""CAST(least(10, greatest(1, (CASE WHEN language IN ('json', 'yaml', 'xml', 'html', 'css') THEN 0 ELSE 1 END) + CAST(floor((CASE WHEN {n} > 50 THEN 3 WHEN {n} > 30 THEN 2 WHEN {n} > 15 THEN 1 ELSE 0 END) * {share}) AS INTEGER)
        + CAST(floor(least(3, nesting) * {share}) AS INTEGER) + (CASE WHEN language IN ({', '.join(map(_q, [*C.PROGRAMS, 'sql']))}) THEN {_algo(x)} ELSE 0 END) + {hits} + (CASE WHEN language = 'json' THEN {json} WHEN language = 'yaml' THEN {yaml} ELSE 0 END))) AS INTEGER)"""


def _nest(x: str) -> str:
    """Brace depth with a floor at zero: the running balance less the smallest balance so far, at its highest."""
    indent = rf"list_transform(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, '^\s*$')), lambda l: length(l) - length(regexp_replace(l, '^\s+', '')))"
    signs = rf"list_transform(regexp_extract_all({x}, '[{{}}]'), lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END)"
    run = f"list_transform(range(0, len({signs}) + 1), lambda i: CAST(coalesce(list_sum(list_slice({signs}, 1, i)), 0) AS INTEGER))"
    deep = f"list_max(list_transform(range(1, len({run}) + 1), lambda j: list_extract({run}, j) - list_min(list_slice({run}, 1, j))))"
    return f"(CASE WHEN language = 'python' THEN CAST(floor(coalesce(list_max({indent}), 0) / 4) AS INTEGER) ELSE CAST(coalesce({deep}, 0) AS INTEGER) END)"


_WW = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_VALID = rf"""length(code) BETWEEN 25 AND 10000 AND contains(code, chr(10)) AND NOT {_has('code', C.TREES)} AND NOT (n >= 3 AND len(list_filter(lines, lambda x: {_has('x', C.CODE_SIGNS)}))::DOUBLE / n < 0.3)
    AND NOT (n > 3 AND language NOT IN ('json', 'yaml', 'xml') AND len(list_filter(lines, lambda x: regexp_matches(x, '^[^:]*[^:\s][^:]*:[^:]*[^:\s][^:]*$') AND NOT {_has('x', ['(', ')', '{', '}', ';', 'function', 'def ', 'class ', 'if ', 'for ', 'while '])}))::DOUBLE / n > 0.8)
    AND NOT {_has('lower(code)', C.DIAGRAMS)} AND ({_rx('code', C.CONSTRUCTS, '(?i)')} OR language IN ('json', 'yaml', 'xml'))
    AND NOT (length(code) < 200 AND (NOT {_has('code', ['(', ')', '{', '}', '[', ']', '=', ';'])} OR (len(list_filter(lines, lambda x: {_WW.format('x')} >= 5)) = 0 AND NOT {_rx('code', C.SHORT_CONSTRUCTS, '(?i)')})))"""


def _name(p: str) -> str:
    return f"regexp_extract(content, {_q(p)}, 1)"


_LINES = "' with ' || len(string_split(content, chr(10))) || ' lines'"
_TITLE = "upper(language[1]) || language[2:]"

SQL = {
    "cd1_fenced_blocks": f"SELECT id, block, hint, code FROM {_BLOCKS}",
    "cd4_languages": f"SELECT id, language, {_seen('content')} AS seen FROM {_CODE}",
    "cd6_complexity": f"""SELECT id, language, nesting, CAST(least(20, 1 + {' + '.join(f"len(regexp_extract_all(content, {_q('(?i)' + p)}))" for p in C.DECISIONS)}) AS INTEGER) AS cyclomatic, {_algo('content')} AS algorithmic, {_complexity('content')} AS complexity
        FROM (SELECT *, {_nest('content')} AS nesting FROM {_CODE})""",
    "cd12_summaries": rf"""SELECT id, CASE WHEN language = 'python' AND {_name(r'class\s+(\w+)')} <> '' THEN 'Python class ''' || {_name(r'class\s+(\w+)')} || ''' definition' || {_LINES}
        WHEN language = 'python' AND {_name(r'def\s+(\w+)')} <> '' THEN 'Python function ''' || {_name(r'def\s+(\w+)')} || '''' || {_LINES}
        WHEN language IN ('javascript', 'typescript') AND {_name(r'function\s+(\w+)')} <> '' THEN {_TITLE} || ' function ''' || {_name(r'function\s+(\w+)')} || '''' || {_LINES}
        WHEN language IN ('javascript', 'typescript') AND {_name(r'const\s+(\w+)\s*=')} <> '' THEN {_TITLE} || ' constant/function ''' || {_name(r'const\s+(\w+)\s*=')} || '''' || {_LINES}
        ELSE {_TITLE} || ' code block' || {_LINES} END AS summary,
        array_to_string(list_slice(CASE WHEN language = 'python' THEN list_concat(list_concat(regexp_extract_all(content, 'def\s+(\w+)', 1), regexp_extract_all(content, 'class\s+(\w+)', 1)), list_concat(regexp_extract_all(content, 'import\s+(\w+)', 1), regexp_extract_all(content, 'from\s+(\w+)', 1)))
            WHEN language IN ('javascript', 'typescript') THEN list_concat(list_concat(regexp_extract_all(content, 'function\s+(\w+)', 1), regexp_extract_all(content, '(?:const|let|var)\s+(\w+)', 1)), regexp_extract_all(content, 'class\s+(\w+)', 1))
            WHEN language = 'java' THEN list_concat(regexp_extract_all(content, 'class\s+(\w+)', 1), regexp_extract_all(content, '(?:public|private|protected)?\s*\w+\s+(\w+)\s*\(', 1))
            WHEN language = 'sql' THEN list_concat(regexp_extract_all(content, '(?i)FROM\s+(\w+)', 1), regexp_extract_all(content, '(?i)JOIN\s+(\w+)', 1)) ELSE [] END, 1, 10), ',') AS identifiers FROM {_CODE}""",
    "cd18_processed_blocks": rf"""WITH b AS (SELECT *, {_lang('hint', 'code')} AS language, list_filter(list_transform(string_split(code, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM {_BLOCKS}),
        v AS (SELECT *, {_nest('code')} AS nesting FROM (SELECT *, len(lines) AS n FROM b) WHERE {_VALID}) SELECT id, block, language, length(code) AS chars, {_complexity('code')} AS complexity FROM v""",
    "cd20_language_counts": f"SELECT language, count(*) AS n FROM {_CODE} GROUP BY language",
}
