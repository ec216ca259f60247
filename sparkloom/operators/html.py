"""HTML to markdown as a chain of Column expressions, selection of the main part, clean-up, frameworks by markup (HTM1-HTM14).

Rules are kept as (pattern, replacement) pairs that Java's and RE2's regular expressions read alike. Null markup gives null
text and the generic framework.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L = F.lit
#: Where the main part stands: an article in the main element, then the first of these that is there (HTM2, fixed order).
MAIN = [
    r"(?is)<main\b[^>]*>(.*?)</main>",
    r"(?is)<article\b[^>]*>(.*?)</article>",
    r'(?is)<(?:div|section)\b[^>]*class="[^"]*\bcontent\b[^"]*"[^>]*>(.*?)</(?:div|section)>',
    r'(?is)<[a-z]+\b[^>]*role="main"[^>]*>(.*?)</[a-z]+>',
]
#: Classes that every tier leaves out, and those that tiers add to the ones before (HTM3, fixed values).
TIER_CLASSES = [["sidebar", "navigation", "menu"], ["nav", "breadcrumb"], ["toc", "table-of-contents", "pagination"], ["related", "recommended", "social", "share", "comments"], ["widget", "advertisement", "ad", "banner", "promo"]]
#: What is removed from markdown that still holds markup (HTM5, fixed values, in order).
LEFTOVERS = [
    r"(?is)<nav\b[^>]*>.*?</nav>",
    r"(?is)<footer\b[^>]*>.*?</footer>",
    r'(?is)<div\b[^>]*class="[^"]*(?:sidebar|menu|navigation)[^"]*"[^>]*>.*?</div>',
    r"(?is)<header\b[^>]*>.*?</header>",
    r'(?is)<[^>]*class="[^"]*(?:breadcrumb|path|crumb)[^"]*"[^>]*>.*?</[^>]*>',
    r'(?is)<a\b[^>]*class="[^"]*(?:button|btn|edit|action)[^"]*"[^>]*>.*?</a>',
    r'(?is)<a\b[^>]*class="[^"]*headerlink[^"]*"[^>]*>\s*#\s*</a>',
    r'(?is)<[^>]*class="[^"]*(?:toc|table-of-contents)[^"]*"[^>]*>.*?</[^>]*>',
]


@dataclass(frozen=True)
class Framework:
    """What tells a framework by its markup (HTM7), and its thresholds (HTM9): all fixed values."""

    name: str
    classes: tuple[str, ...] = ()
    metas: tuple[str, ...] = ()
    generators: tuple[str, ...] = ()
    least_ratio: float = 0.6
    most_links: float = 0.3
    least_words: int = 15


FRAMEWORKS = [
    Framework("material_design", ("md-main", "md-content", "md-sidebar", "md-nav"), ("mkdocs", "material"), ("mkdocs",), 0.7, 0.25),
    Framework("readme_io", ("rm-guides", "rm-sidebar", "rm-content", "hub-sidebar"), ("readme", "readme.io"), (), 0.65, 0.3, 20),
    Framework("gitbook", ("gitbook-content", "book-summary", "book-body"), ("gitbook",), ("gitbook",), 0.65),
    Framework("docusaurus", ("docmaincontainer", "docitemcontainer"), ("docusaurus",), ("docusaurus",), 0.7),
    Framework("sphinx", ("sphinxsidebar", "sphinx-content"), ("sphinx",), ("sphinx",), 0.7),
    Framework("vuepress", ("theme-default-content", "sidebar-links"), ("vuepress",), ("vuepress",), 0.7),
    Framework("jekyll", ("post-content", "site-nav"), ("jekyll",), ("jekyll",), 0.65),
    Framework("generic", least_ratio=0.5, most_links=0.4),
]
#: Parts of a host that name a framework (HTM8, fixed values, in order).
HOST_PARTS = [("n8n.io", "material_design"), ("readme.io", "readme_io"), ("gitbook", "gitbook"), ("github.io", "github_pages")]
#: Words of pages that scripts fill (HTM13), of navigation (QC8), marks of navigation and of content (HTM12): fixed values.
DYNAMIC = ["loading", "please wait", "javascript", "enable js", "dynamic content"]
GUIDING = ["menu", "navigation", "sidebar", "toc", "breadcrumb"]
NAV_MARKS = ["md-nav", "md-sidebar", "rm-sidebar", "hub-sidebar", "gitbook", "navbar"]
CONTENT_MARKS = ["md-main", "md-content", "rm-guides", "article", "main", ".content"]
NAV_WORDS = ["nav>", "navigation", "sidebar", "menu"]
#: Domains with selectors of their own, in the order of registration (HTM10, fixed values).
REGISTRY = [("n8n.io", "main.md-main .md-content"), ("docs.n8n.io", "main.md-main .md-content"), ("readme.io", "main.rm-Guides"), ("gitbook.io", ".gitbook-content"), ("gitbook.com", ".gitbook-content")]


def word_threshold(tier: int) -> int:
    return max(5, 20 - 3 * tier)


def tier_table() -> list[tuple[int, int, str, bool]]:
    """HTM4: tier, words a block needs, tags left out, whether links are dropped. Tier 0 is the first attempt."""
    return [(t, word_threshold(t), ",".join(excluded_tags(t)), t >= 3) for t in range(5)]


def excluded_tags(tier: int) -> list[str]:
    """HTM3: tags whose elements are left out."""
    return {0: ["nav", "footer", "aside"], 1: [], 2: [], 3: ["nav"]}.get(tier, ["nav", "header", "footer", "aside"])


def extraction_rules(tier: int = 0, links: bool | None = None) -> list[tuple[str, str]]:
    """HTM1, HTM3: (pattern, replacement) in order, with ``$1`` for groups. ``links``: kept or not; by tier if None. Images never are."""
    kept = tier < 3 if links is None else links
    classes = "|".join(c for part in TIER_CLASSES[: tier + 1] for c in part)
    pairs = [(r"(?s)<!--.*?-->", "")]
    pairs += [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in ["script", "style", "template", "noscript", *excluded_tags(tier)]]
    pairs += [(rf'(?is)<(?:div|ul|section|nav)\b[^>]*class="(?:[^"]*[ -])?(?:{classes})(?:[ -][^"]*)?"[^>]*>.*?</(?:div|ul|section|nav)>', " ")]
    pairs += [(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)]
    pairs += [(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)" if kept else "$2")]
    pairs += [
        (r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", "\n\n```\n$1\n```\n\n"), (r"(?is)<code\b[^>]*>(.*?)</code\s*>", "`$1`"), (r"(?is)<li\b[^>]*>", "\n- "), (r"(?is)<br\s*/?>", "\n"),
        (r"(?is)</?(?:p|div|section|table|tr|ul|ol|blockquote|article)\b[^>]*>", "\n\n"), (r"(?s)<[a-zA-Z/!][^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
        (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\r\n]+|[ \t\r\n]+$", ""),
    ]
    return pairs


CLEAN_RULES = [(p, "") for p in LEFTOVERS] + [(r"\n[ \t\r\n]*\n[ \t\r\n]*\n+", "\n\n"), (r"^[ \t\r\n]+|[ \t\r\n]+$", "")]


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def main_part(html: Column) -> Column:
    """HTM2: the article in the main element, else the first part of ``MAIN`` that is there and not empty, else all."""
    parts = [F.regexp_extract(F.regexp_extract(html, MAIN[0], 1), MAIN[1], 1)] + [F.regexp_extract(html, p, 1) for p in MAIN]
    return F.when(html.isNotNull(), F.coalesce(*[F.when(p != "", p) for p in parts], html))


def to_markdown(html: Column, tier: int = 0, links: bool | None = None) -> Column:
    """Markdown of a page (HTM1): headings, links, list items, code; scripts, styles, comments and the tier's parts are left out.

    Null stays null; text without markup comes out with its white space closed up.
    """
    return replaced(html, extraction_rules(tier, links))


def clean(markdown: Column) -> Column:
    """Elements of markup left in markdown are taken out (HTM5); empty lines closed up."""
    return replaced(markdown, CLEAN_RULES)


def _points(low: Column, f: Framework) -> Column:
    has = lambda x: F.contains(low, L(x))
    score = L(0)
    for c in f.classes:
        score = score + has(c).cast("int") * 2
    for m in f.metas:
        score = score + (has(f'content="{m}"') | has(f'name="{m}"')).cast("int") * 3
    for g in f.generators:
        score = score + (has('name="generator"') & has(g)).cast("int") * 5
    if f.name == "material_design":
        score = score + (has("md-main") & has("md-sidebar")).cast("int") * 10
    if f.name == "readme_io":
        score = score + (has("rm-guides") | has("hub-sidebar")).cast("int") * 10
    return score


def framework(html: Column) -> Column:
    """The first framework whose classes, meta names and generator give 8 points (HTM7); generic if none does."""
    low, out = F.lower(html), None
    for f in FRAMEWORKS[:-1]:
        test = _points(low, f) >= 8
        out = F.when(test, f.name) if out is None else out.when(test, f.name)
    return out.otherwise("generic")


def framework_of_host(host: Column) -> Column:
    """HTM8: by parts of the host; generic for null."""
    out = None
    for part, name in HOST_PARTS:
        test = F.contains(F.lower(host), L(part))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def marks(low: Column, words: list[str]) -> Column:
    """Those of ``words`` that the text holds, in order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, L(w)), w) for w in words]))


def diagnostic(html: Column) -> dict[str, Column]:
    """HTM12: framework and how sure it is, whether there is navigation, marks of navigation and content, issues."""
    low = F.lower(html)
    nav, content, name = marks(low, NAV_MARKS), marks(low, CONTENT_MARKS), framework(html)
    issues = F.array_compact(F.array(F.when(F.size(nav) > 3, "High navigation complexity detected"), F.when(F.size(content) == 0, "No clear content containers found")))
    return {"framework": name, "confidence": F.when(name != "generic", "high").otherwise("low"), "has_navigation": F.coalesce(F.size(marks(low, NAV_WORDS)) > 0, L(False)), "nav_marks": nav, "content_marks": content, "issues": issues}


def is_dynamic(markdown: Column) -> Column:
    """HTM13: whether scripts seem to fill the page."""
    return F.coalesce(F.size(marks(F.lower(markdown), DYNAMIC)) > 0, L(False))


def registered(df: DataFrame, host: str, registry: DataFrame) -> DataFrame:
    """HTM10, JN11: ``df`` with ``registered`` and ``selector`` of its host: the exact domain, else the first in order that the host ends with.

    ``registry`` (``registered, selector, ordinal``) is a small dimension table; hosts are matched once each and joined back.
    """
    hosts = df.select(F.lower(F.trim(F.col(host))).alias("_host")).filter(F.col("_host").isNotNull()).distinct()
    near = hosts.join(F.broadcast(registry), F.endswith(F.col("_host"), F.col("registered")))
    order = F.struct((F.col("_host") != F.col("registered")).cast("int"), "ordinal")
    best = near.groupBy("_host").agg(F.min_by(F.struct("registered", "selector"), order).alias("_best")).select("_host", "_best.registered", "_best.selector")
    return df.join(best, F.lower(F.trim(F.col(host))) == F.col("_host"), "left").drop("_host")
