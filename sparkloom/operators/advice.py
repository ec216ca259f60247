"""What the checks of a page or chunk say in words: issues, suggestions, recommendations (QA13, QB8, QC7, QD2, QD5, QD10, QD11, QE8).

Each function gives an array Column of fixed sentences in a fixed order; nulls in a measure count as not met.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit


def said(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, text) for test, text in pairs]))


def markdown_suggestions(ratio: Column, density: Column, words: Column, elements: Column) -> Column:
    """QA13."""
    own = said([
        (ratio < 0.5, "Content-to-navigation ratio is low. Consider using more specific CSS selectors to target main content areas."),
        (density > 0.3, "High link density detected. Try excluding navigation elements and sidebars."),
        (elements > 20, "High navigation element count. Add navigation-specific exclusion selectors."),
        (words < 100, "Low word count. Check if main content areas are being targeted correctly."),
    ])
    return F.when(F.size(own) == 0, F.array(L("Quality metrics look good. Consider fine-tuning thresholds if needed."))).otherwise(own)


def extraction_issues(artifacts: Column, script: Column, ratio: Column, words: Column) -> Column:
    """QB8: why a text fails."""
    return said([(artifacts > 5, "html artifacts"), (script, "script contamination"), (ratio < 0.6, "low content ratio"), (words < 50, "too few words")])


def selector_suggestions(links: Column, keys: Column, item_words: Column, tags: Column, short: Column, few: Column) -> Column:
    """QC7."""
    return said([
        (links > 0.4, "Critical: link density indicates navigation content"), ((links > 0.25) & (links <= 0.4), "High link density suggests navigation elements"), ((links > 0.15) & (links <= 0.25), "Moderate link density may include navigation"),
        (keys > 0.05, "High navigation keyword density indicates navigation content"), ((keys > 0.02) & (keys <= 0.05), "Moderate navigation keywords detected"),
        (item_words < 3, "List items too short - likely navigation"), ((item_words >= 3) & (item_words < 5), "Short list items may be navigation"),
        (tags > 0.3, "High tag-to-text ratio indicates link-heavy navigation"), ((tags > 0.2) & (tags <= 0.3), "Moderate tag-to-text ratio"),
        (short > 0.7, "High ratio of short lines indicates navigation"), ((short > 0.5) & (short <= 0.7), "Many short lines may indicate navigation"), (few, "Word count below the minimum of the tier"),
    ])


#: Links of a chunk: of markdown (group 2 is the address), of markup (in the check of chunks, group 2 is the text: a known quirk that is kept) and bare ones.
LINK_FORMS = [(r"\[([^\]]+)\]\(([^)]+)\)", 2), (r"""<a[^>]+href=["']([^"']+)["'][^>]*>([^<]+)</a>""", 2), (r"https?://[^\s\)]+", 0)]


def chunk_links(text: Column) -> dict[str, Column]:
    """QD2: number of links, and how many lead inside, outside or are broken."""
    urls = F.concat(*[F.regexp_extract_all(text, L(p), L(g)) for p, g in LINK_FORMS])
    n = lambda test: F.size(F.filter(urls, test))
    return {"links": F.size(urls), "internal": n(lambda u: u.rlike(r"^(?:/|#|\.\./|\./)")), "external": n(lambda u: u.rlike("^https?://")), "broken": n(lambda u: u.rlike(r"""^\s*$|[<>"]|\s+"""))}


#: Forms of definitions; the first group is the term (fixed values).
DEFINITIONS = [r"(?:^|\n)([A-Z][a-zA-Z\s]+):\s+([^.\n]+\.)", r"(?:^|\n)\*\*([A-Z][a-zA-Z\s]+)\*\*:?\s+([^.\n]+\.)", r"(?:^|\n)###?\s+([A-Z][a-zA-Z\s]+)\n([^#\n]+)"]


def glossary_terms(text: Column) -> Column:
    """QD5: distinct defined terms of more than two characters, in order of the forms."""
    terms = F.concat(*[F.regexp_extract_all(text, L(p), 1) for p in DEFINITIONS])
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: F.length(t) > 2))


def chunk_recommendations(kind: Column, n_kinds: Column, chars: Column, paragraphs: Column, code: Column, broken: Column, technical: Column) -> Column:
    """QD10."""
    return said([
        (kind == "navigation", "Exclude this chunk - contains only navigation elements"), (n_kinds > 2, "Review CSS selectors to better exclude navigation elements"),
        (chars < 100, "Combine with adjacent chunks to meet minimum content requirements"), (~paragraphs & ~code, "Verify this chunk contains meaningful content"),
        (broken > 0, "Fix broken or malformed links in the source content"), (technical < 0.1, "Consider if this chunk provides valuable technical information"),
    ])


def corpus_recommendations(n: Column, valid: Column, navigation: Column, code: Column, glossary: Column, score: Column) -> Column:
    """QD11: for a whole corpus, from its shares; five at most."""
    return F.slice(said([
        (navigation > 0.2, "High navigation contamination detected - review CSS exclusion selectors"), (valid < 0.7, "Many chunks below quality standards - review chunking strategy"),
        ((code == 0) & (n > 5), "No code examples found - verify technical content is being preserved"), (glossary == 0, "No glossary definitions detected - check if definitions are being preserved"),
        (score < 0.6, "Overall quality below acceptable threshold - comprehensive review needed"),
    ]), 1, 5)


def analyzer_recommendations(score: Column, passed: Column, coherence: Column, broken: Column, duplication: Column) -> tuple[Column, Column]:
    """QE8: improvements in order of weight, and technical recommendations; five at most of each."""
    first = said([
        (score < 0.7, "Base quality below 0.7 - see the suggestions of the markdown check"), (~passed, "Extraction check failed - see its issues"),
        (coherence < 0.4, "Low semantic coherence detected - review content structure and topic flow"), (duplication > 0.2, "High duplicate content detected - likely navigation contamination"),
    ])
    second = said([
        (coherence < 0.4, "Consider using more specific CSS selectors to target coherent content sections"), (broken > 0, "Fix broken or malformed links"),
        (duplication > 0.2, "Add more aggressive navigation and sidebar exclusion selectors"),
    ])
    return F.slice(first, 1, 5), F.slice(second, 1, 5)
