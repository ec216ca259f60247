"""Quality scores of one page as Column expressions: markdown quality (QA), extraction check (QB), selector check (QC), chunk check (QD).

Every function takes the text Column and gives named Columns; nothing leaves the JVM. Null text gives null metrics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import occurrences, white_words

L = F.lit
#: Patterns that mark navigation (fixed values).
NAVIGATION = [
    r"\b(home|back|next|previous|prev|skip|menu|navigation|nav)\b",
    r"\b(table of contents|toc|contents|index)\b",
    r"\b(breadcrumb|breadcrumbs)\b",
    r"\b(sidebar|footer|header)\b",
    r"\b(edit|edit page|edit this page)\b",
    r"\b(search|search docs|search documentation)\b",
]
#: Words that mark technical text (fixed values).
TECHNICAL = ["function", "method", "class", "variable", "parameter", "return", "example", "usage", "configuration", "installation", "api", "endpoint", "request", "response", "error", "exception"]
#: Words of integration lists (fixed values).
INTEGRATION = ["integration", "credential", "connector", "node", "service", "api", "webhook", "plugin", "extension", "app"]
#: Strings that should not be left of HTML (fixed values).
ARTIFACTS = ["</script>", "<footer>", "<nav>", "<header>", "<aside>", "</div>", "</span>", "<iframe", "onclick=", "javascript:", "&nbsp;", "&amp;", "&lt;", "&gt;"]
#: Strings that show scripts (fixed values).
SCRIPTS = ["function(", "var ", "let ", "const ", "document.", "window.", "alert(", "console.", "addeventlistener", "getelementbyid", "$(", "jquery"]
#: Words of navigation noise (fixed values).
NOISE = ["menu", "navigation", "sidebar", "breadcrumb", "toc", "table of contents", "next page", "previous page", "home", "back to top", "skip to", "toggle", "hamburger"]
#: Keywords of the selector check (fixed values).
KEYWORDS = ["next", "previous", "prev", "home", "back", "menu", "navigation", "nav", "breadcrumb", "sidebar", "toc", "table of contents", "edit", "edit page"]


#: QC6: words that a tier needs at least, and the score from which it is accepted, by tier (fixed values).
TIER_WORDS, TIER_BARS = [50, 40, 30, 20, 15], [0.6, 0.5, 0.4, 0.3, 0.2]


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def band(value: Column, steps: list[tuple[float, float]], below: bool, rest: float = 1.0) -> Column:
    """The factor of the first step that the value is above (or below)."""
    out = None
    for limit, factor in steps:
        test = value < limit if below else value > limit
        out = F.when(test, factor) if out is None else out.when(test, factor)
    return out.otherwise(rest)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, L(pattern))


def paragraphs(text: Column, least: int) -> Column:
    """Blocks between empty lines with at least so many words."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: F.size(white_words(p)) >= least))


def markdown_quality(text: Column) -> dict[str, Column]:
    """QA1-QA5, QA10-QA13 (the names say which measure)."""
    words = count(F.regexp_replace(text, r"[#*`\[\]()_~]", ""), r"[\p{L}\p{N}_]+")
    marked, bare = r"\[([^\]]*)\]\(([^)]*)\)", r"https?://[^\s\]]+"
    links = F.concat(F.regexp_extract_all(text, L(marked), 2), F.regexp_extract_all(text, L(r"\[([^\]]*)\]\[([^\]]*)\]"), 2), F.regexp_extract_all(text, L(bare), 0))
    density = F.size(links) / F.greatest(words, L(1))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\t\r ]+|[\t\r ]+$", ""))), lambda x: x != "")

    def guides(x: Column) -> Column:
        n = F.size(white_words(x))
        named = F.lower(x).rlike("|".join(NAVIGATION))
        item = x.rlike(r"^[-*+]\s+.*\[.*\]") & (n <= 8)
        return named | item | ((n <= 3) & (F.contains(x, L(">")) | F.contains(x, L("/"))))

    n_lines = F.size(lines)
    ratio = F.when(n_lines == 0, 0.0).otherwise(F.size(F.filter(lines, lambda x: ~guides(x))) / n_lines)
    low = F.lower(text)
    hits = total([F.contains(low, L(w)).cast("int") for w in TECHNICAL])
    headings = count(text, r"(?m)^#+\s+.+$")
    coherence = F.when(headings > 0, 0.3).otherwise(0.0) + F.when(F.contains(text, L("\n\n")), 0.3).otherwise(0.0) + F.when(F.contains(text, L("`")), 0.2).otherwise(0.0) + F.when(hits >= 3, 0.2).otherwise(0.0)
    code = count(text, r"```[\s\S]*?```") + F.floor(count(text, r"`[^`\n]+`") / 5).cast("int")
    paras = paragraphs(text, 11)
    return {"words": words, "links": F.size(links), "unique_links": F.size(F.array_distinct(links)), "link_density": F.round(density, 6), "headings": headings, "paragraphs": paras, "code_blocks": code, "content_ratio": F.round(ratio, 6), "coherence": F.round(coherence, 6)}


def markdown_score(density: Column, ratio: Column, words: Column, paras: Column, code: Column, coherence: Column) -> Column:
    """QA12: factors for links, navigation and length, then bonuses of what is left if it is above 0.3, each capped at 1."""
    base = band(density, [(0.4, 0.05), (0.3, 0.15), (0.2, 0.4), (0.1, 0.7)], below=False) * band(ratio, [(0.3, 0.1), (0.5, 0.3), (0.7, 0.6), (0.9, 0.8)], below=True)
    base = base * band(words, [(20, 0.05), (50, 0.2), (100, 0.5)], below=True)
    cap = lambda x: F.least(L(1.0), x)
    better = cap(base * F.when(paras >= 3, 1.2).when(paras >= 2, 1.1).otherwise(1.0))
    better = cap(better * F.when(code > 0, 1.1).otherwise(1.0))
    better = cap(better * F.when(coherence > 0.7, 1.15).otherwise(1.0))
    return F.round(F.when(base > 0.3, better).otherwise(base), 6)


def category(score: Column, names: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for limit, name in names:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise(rest)


def navigation_elements(text: Column) -> dict[str, Column]:
    """QA6-QA9: pattern hits, streaks of linked list items, link-heavy text, and line shapes that repeat."""
    low = F.lower(text)
    named = total([count(low, p) for p in NAVIGATION])
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\t\r ]+|[\t\r ]+$", ""))

    def step(acc: Column, x: Column) -> Column:
        hit = x.rlike(r"^[-*+]\s+.*\[.*\]\(.*\)")
        worth = F.when(F.lower(x).rlike("|".join(INTEGRATION)), 2).otherwise(1)
        run = F.when(hit, acc["run"] + 1).otherwise(0)
        return F.struct((acc["score"] + F.when(hit, worth).otherwise(0) + F.when(run >= 5, run * 2).otherwise(0)).alias("score"), run.alias("run"))

    streaks = F.aggregate(lines, F.struct(L(0).alias("score"), L(0).alias("run")), step, lambda acc: acc["score"])
    words = F.size(white_words(text))
    density = F.try_divide(count(text, r"\[([^\]]*)\]\([^)]*\)"), words)
    heavy = F.when(words < 10, 0).when(density > 0.4, F.floor(density * 50)).when(density > 0.2, F.floor(density * 20)).otherwise(0).cast("int")
    shapes = F.transform(F.filter(lines, lambda x: F.contains(x, L("[")) & F.contains(x, L("]("))), lambda x: F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", "[T]"), r"\([^)]*\)", "(U)"))
    repeated = F.aggregate(F.array_distinct(shapes), L(0), lambda acc, s: acc + F.when(F.size(F.filter(shapes, lambda x: x == s)) >= 3, F.size(F.filter(shapes, lambda x: x == s)) * 2).otherwise(0))
    return {"named": named, "streaks": streaks, "heavy": heavy, "repeated": repeated}


def extraction_check(text: Column) -> dict[str, Column]:
    """QB1-QB8: remains of HTML and scripts, white space, navigation, links, structure; score, category, pass."""
    low, words = F.lower(text), F.size(white_words(text))
    artifacts = total([occurrences(low, a) for a in ARTIFACTS]) + count(text, r"<[^>]+>")
    script = any_of([F.contains(low, L(s)) for s in SCRIPTS] + [low.rlike(p) for p in (r"function\s*\([^)]*\)\s*\{", r"var\s+[a-z0-9_]+\s*=", r"document\.[a-z0-9_]+", r"window\.[a-z0-9_]+")])
    space = (count(text, r"\n\s*\n\s*\n\s*\n") > 3) | (F.try_divide(count(text, r"\s"), F.length(text)) > 0.15)
    noise = total([occurrences(low, w) for w in NOISE])
    ratio = F.when(words == 0, 0.0).otherwise(F.greatest(L(0.0), 1.0 - F.least(noise / words, L(1.0)) * 2))
    density = F.when(words == 0, 0.0).otherwise((count(text, r"\[([^\]]+)\]\(([^)]+)\)") + count(text, r"https?://[^\s]+")) / words)
    good = total([text.rlike(p).cast("int") for p in (r"(?m)^# .+", r"(?m)^## .+", r"\[.+\]\(.+\)", r"```[a-zA-Z0-9_]*\n[^\n]*\n```")])
    bad = total([text.rlike(p).cast("int") for p in (r"<[a-zA-Z0-9_]+[^>]*>", r"javascript:", r"onclick=", r"\n\s*\n\s*\n\s*\n")])
    return {"words": words, "artifacts": artifacts, "script": script, "space": F.coalesce(space, L(False)), "ratio": F.round(ratio, 6), "density": F.round(density, 6), "golden": F.greatest(L(0.0), good / 4.0 - bad / 4.0)}


def extraction_score(words: Column, artifacts: Column, script: Column, space: Column, ratio: Column, density: Column, golden: Column) -> Column:
    ws = F.when(words >= 50, F.least(L(1.0), words / 200.0)).otherwise(words / 50.0)
    score = (0.8 + 0.2 * ws) * F.when(artifacts > 0, 1 - F.least(L(0.5), artifacts / 10.0)).otherwise(1.0) * F.when(script, 0.7).otherwise(1.0) * (0.7 + 0.3 * ratio)
    score = score * F.when(density > 0.3, 1 - F.least(L(0.2), (density - 0.3) * 2)).otherwise(1.0) * F.when(space, 0.9).otherwise(1.0) * (0.8 + 0.2 * golden)
    return F.round(F.greatest(L(0.0), F.least(L(1.0), score)), 6)


def selector_check(text: Column, tier: int = 0) -> dict[str, Column]:
    """QC1-QC7: link and keyword density, list items, markup, short lines, length by tier; score and whether it passes."""
    low, words = F.lower(text), F.size(white_words(text))
    per_word = lambda n: F.when(words > 0, n / words).otherwise(0.0)
    links = per_word(count(text, r"\[([^\]]*)\]\([^)]*\)"))
    keys = per_word(total([occurrences(low, w) for w in KEYWORDS]))
    items = F.regexp_extract_all(text, L(r"(?m)^[ \t]*[-*+][ \t]+([^\r\n]+)"), 1)
    item_words = F.aggregate(items, L(0), lambda a, x: a + F.size(white_words(x)))
    item_words = F.try_divide(item_words, F.size(items))
    tags = F.try_divide(count(text, r"[#*`\[\]()_~]"), F.length(text))
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*$"))
    short = F.try_divide(F.size(F.filter(lines, lambda x: F.size(white_words(x)) <= 4)), F.size(lines))
    least = TIER_WORDS[min(tier, 4)]
    return {"words": words, "links": F.round(links, 6), "keys": F.round(keys, 6), "item_words": F.round(F.when(F.size(items) > 0, item_words), 6), "tags": F.round(F.coalesce(tags, L(0.0)), 6), "short": F.round(F.when(F.size(lines) > 5, short), 6), "few": words < least}


def selector_score(links: Column, keys: Column, item_words: Column, tags: Column, short: Column, few: Column) -> Column:
    score = band(links, [(0.4, 0.1), (0.25, 0.3), (0.15, 0.6)], below=False) * band(keys, [(0.05, 0.2), (0.02, 0.5)], below=False) * band(tags, [(0.3, 0.3), (0.2, 0.6)], below=False)
    score = score * F.coalesce(band(item_words, [(3, 0.15), (5, 0.4)], below=True), L(1.0)) * F.coalesce(band(short, [(0.7, 0.15), (0.5, 0.4)], below=False), L(1.0))
    return F.round(score * F.when(few, 0.2).otherwise(1.0), 6)
