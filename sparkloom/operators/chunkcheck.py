"""Checks of stored chunks: navigation, substance, kind, category, corpus score (QD1-QD11, AG11-AG13), code patterns (CD15, CD16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import white_words
from sparkloom.operators.quality import paragraphs

L = F.lit
#: Kinds of navigation and their patterns on lower case (fixed values).
KINDS = {
    "breadcrumbs": [r"\bhome\s*[>/]\s*[a-z0-9_]+", r"[a-z0-9_]+\s*[>/]\s*[a-z0-9_]+\s*[>/]\s*[a-z0-9_]+", r"you\s+are\s+here", r"current\s+page", r"path:?\s*home"],
    "menu": [r"\b(menu|navigation|nav)\b", r"\b(skip\s+to|jump\s+to)\b", r"\b(toggle|hamburger|mobile\s+menu)\b", r"\b(search|filter|sort\s+by)\b", r"\b(previous|next|back|forward)\b\s*(page|section)?"],
    "footer": [r"\b(copyright|©|\(c\))\b", r"\ball\s+rights\s+reserved\b", r"\bprivacy\s+policy\b", r"\bterms\s+of\s+(service|use)\b", r"\bcontact\s+us\b", r"\bfooter\b"],
    "sidebar": [r"\btable\s+of\s+contents\b", r"\bon\s+this\s+page\b", r"\bin\s+this\s+(section|chapter)\b", r"\brelated\s+(topics|articles|links)\b", r"\bsidebar\b"],
}
#: Forms of code, of explanations and of definitions (fixed values).
CODE = [r"```[a-z0-9_]*\n[\s\S]*?\n```", r"`[^`\n]+`", r"(?m)^    [a-zA-Z0-9_]", r"<code>[\s\S]*?</code>", r"(?:function|class|def|const|let|var)\s+[a-zA-Z0-9_]+"]
EXPLAINING = [r"\b(for example|such as|this means|in other words)\b", r"\b(to understand|to learn|to configure|to setup)\b", r"\b(step [0-9]+|first|second|third|finally|next)\b", r"\b(note:|important:|warning:|tip:)\b", r"\b(explanation|description|overview|introduction)\b"]
GLOSSARY = [r"(?m)^[A-Z][a-zA-Z ]+:\s+[^.\n]+\.", r"(?m)^\*\*[A-Z][a-zA-Z ]+\*\*:?\s+[^.\n]+\."]
#: Words of technical text (fixed values).
TECHNICAL = [
    "api", "endpoint", "method", "function", "parameter", "argument", "return", "response", "request", "header", "payload", "schema", "configuration",
    "setting", "option", "property", "attribute", "example", "tutorial", "guide", "documentation", "reference", "install", "setup", "configure",
    "initialize", "implement", "workflow", "node", "trigger", "action", "execution", "pipeline",
]
#: Patterns that code shows: in any language, then by language (fixed values).
SHOWN = [("async", r"(?i)async"), ("await", r"(?i)await"), ("error_handling", r"(?i)\btry\b"), ("oop", r"(?i)\bclass\b"), ("interface", r"(?i)\binterface\b"), ("imports", r"(?i)\bimport\b")]
SHOWN_BY = {
    ("python",): [("decorators", "@"), ("generator", "yield"), ("context_manager", "with ")],
    ("javascript", "typescript"): [("promises", "Promise"), ("arrow_functions", "=>"), ("functional_programming", r"\.(map|filter|reduce)\(")],
    ("sql",): [("joins", r"(?i)\bJOIN\b"), ("aggregation", r"(?i)\bGROUP\s+BY\b"), ("cte", r"(?i)\bWITH\b")],
}
#: Terms looked for around code (fixed values).
TERMS = ["api", "function", "method", "class", "example", "usage", "tutorial", "configuration", "setup", "installation", "documentation", "guide", "implementation", "algorithm", "pattern", "framework", "library", "utility", "helper", "tool", "service", "component", "module"]


def _any(text: Column, patterns: list[str]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return out


def check(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` with the metrics of each chunk; null and empty texts are left out."""
    t, low = F.col(text), F.lower(F.col(text))
    words = white_words(low)
    rows = df.filter(F.length(t) > 0).select(
        key, F.length(t).alias("chars"), F.size(words).alias("words"), (F.regexp_count(t, L(r"(?m)^#+\s+.+$")) > 0).alias("headings"), (paragraphs(t, 10) > 0).alias("paragraphs"), _any(t, CODE).alias("code"),
        *[_any(low, p).alias(n) for n, p in KINDS.items()], _any(t, GLOSSARY).alias("glossary"), _any(low, EXPLAINING).alias("explains"), F.regexp_count(t, L(r"\[([^\]]+)\]\(([^)]+)\)")).alias("links"),
        F.size(F.filter(words, lambda w: w.isin(TECHNICAL))).alias("_technical"),
    )
    yes = lambda c: F.col(c).cast("int")
    density = F.coalesce(F.try_divide(F.col("_technical"), F.col("words")), L(0.0)) + 0.1 * yes("code") + 0.05 * yes("headings")
    rows = rows.withColumn("technical", F.round(F.least(L(1.0), F.when(F.col("words") > 0, density).otherwise(0.0)), 6)).drop("_technical")
    rows = rows.withColumn("n_kinds", yes("breadcrumbs") + yes("menu") + yes("footer") + yes("sidebar"))
    full = F.col("paragraphs") & (F.col("words") >= 15) & (F.col("technical") > 0.1)
    kind = F.when(F.col("breadcrumbs") | F.col("menu") | (F.col("n_kinds") >= 2), "navigation").when(F.col("footer"), "footer").when(full & (F.col("n_kinds") >= 1), "mixed").when(full, "content")
    rows = rows.withColumn("kind", kind.when(F.col("headings") & ~F.col("paragraphs"), "header").otherwise("unknown"))
    rows = rows.withColumn("substantive", (F.col("chars") >= 100) & (F.col("words") >= 15) & F.col("kind").isin("content", "mixed") & (F.col("paragraphs") | F.col("code")))
    rows = rows.withColumn("valid", F.col("substantive") & (F.col("n_kinds") <= 2))
    score = 0.2 * yes("paragraphs") + 0.2 * yes("code") + 0.2 * yes("glossary") + 0.1 * yes("explains") + 0.2 * F.col("technical") - 0.1 * F.col("n_kinds")
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("category", F.when(~F.col("valid"), "poor").when(F.col("score") >= 0.8, "excellent").when(F.col("score") >= 0.6, "good").when(F.col("score") >= 0.4, "fair").otherwise("poor"))


def issues() -> Column:
    """What is wrong with a checked chunk, as an array."""
    return F.array_compact(F.array(
        F.when(F.col("chars") < 100, "too short"), F.when(F.col("breadcrumbs"), "breadcrumbs"), F.when(F.col("menu"), "menu items"), F.when(F.col("footer"), "footer"), F.when(~F.col("paragraphs") & ~F.col("code"), "no paragraphs or code"), F.when(F.col("technical") < 0.1, "little technical text"),
    ))


def corpus_score(checked: DataFrame) -> DataFrame:
    """One row: shares and the score of the whole (AG11); 0 for no chunks."""
    n = F.count(L(1))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), n), L(0.0))
    small = lambda c, w: F.least(L(0.1), w * share(c))
    good, content, nav = share(F.col("valid")), share(F.col("kind").isin("content", "mixed")), share(F.col("kind") == "navigation")
    links = F.least(L(0.1), 0.2 * F.coalesce(F.try_divide(F.sum("links"), n), L(0.0)))
    total = 0.5 * good + 0.3 * content - 0.5 * nav + small(F.col("glossary"), 0.5) + small(F.col("code"), 0.3) + links
    return checked.agg(n.alias("n"), F.round(good, 6).alias("valid_share"), F.round(content, 6).alias("content_share"), F.round(nav, 6).alias("navigation_share"), F.round(F.greatest(L(0.0), F.least(L(1.0), total)), 6).alias("score"))


def patterns(code: Column, lang: Column) -> Column:
    """Names of patterns that a block shows, eight at most (CD15)."""
    own = [F.when(code.rlike(p), n) for n, p in SHOWN]
    for names, rules in SHOWN_BY.items():
        own += [F.when(lang.isin(*names) & code.rlike(p), n) for n, p in rules]
    return F.slice(F.array_compact(F.array(*own)), 1, 8)


def context_terms(context: Column) -> Column:
    """Technical terms around a block, six at most (CD16)."""
    return F.slice(F.filter(F.array(*[L(t) for t in TERMS]), lambda t: F.contains(F.lower(context), t)), 1, 6)
