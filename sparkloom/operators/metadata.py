"""Metadata of pages as Column expressions: kinds of addresses, frameworks, titles, sections, content types (SRC1, HTM6, MD1-MD8, CH14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import white_words

L = F.lit
#: Content types: words of an address that decide, then words of the text, in order (fixed values).
TYPES: list[tuple[str, list[str], list[str]]] = [
    ("technical", ["github.com", "docs.", "api.", "developer."], ["api", "function", "class", "method", "parameter", "returns", "example:", "installation", "configuration", "setup", "import", "usage", "```", "endpoint", "request", "response", "library", "framework"]),
    ("academic", ["arxiv.org", "scholar.google", "pubmed", "jstor"], ["abstract", "methodology", "hypothesis", "conclusion", "references", "study", "research", "analysis", "findings", "literature review", "experiment", "data", "results", "discussion", "journal"]),
    ("forum", ["reddit.com", "stackoverflow", "forum", "discourse"], ["posted by", "reply", "comment", "question:", "answer:", "solved", "upvoted", "downvoted", "thread", "forum", "discussion", "feedback", "opinion", "experience", "issue", "problem", "help"]),
    ("news", ["news.", "cnn.com", "bbc.com", "reuters"], ["published", "editor", "reporter", "breaking", "update", "announced", "statement", "press release", "interview", "according to", "sources say", "reuters", "bloomberg", "cnn"]),
    ("blog", ["medium.com", "substack", "blog"], ["i think", "in my opinion", "personally", "i believe", "my experience", "thoughts on", "reflection", "perspective", "author:", "written by", "blog", "post"]),
    ("social_media", ["twitter.com", "linkedin.com", "instagram.com", "facebook.com", "x.com"], ["shared", "retweet", "like", "follow", "followers", "trending", "hashtag", "#", "@", "posted on", "social media", "tweet", "linkedin post", "instagram", "facebook", "twitter", "thread", "viral", "engagement", "influencer"]),
    ("legal", ["law.", "legal", "court", "gov", "laws", "legislation"], ["whereas", "therefore", "hereby", "pursuant to", "section", "subsection", "clause", "contract", "agreement", "terms and conditions", "legal", "law", "statute", "regulation", "court", "jurisdiction", "plaintiff", "defendant", "attorney", "counsel", "liability", "damages", "breach", "compliance", "shall", "may not", "provided that"]),
    ("educational", ["tutorial", "course", "learn", "education", "training", "udemy", "coursera", "khan"], ["tutorial", "how to", "step by step", "lesson", "guide", "course", "learn", "instruction", "exercise", "practice", "assignment", "module", "chapter", "beginner", "intermediate", "advanced", "skill", "training", "workshop", "walkthrough", "demo", "example", "tip:", "note:", "important:", "remember:", "quick start", "getting started"]),
]
#: In which order addresses are tried (fixed value).
ADDRESS_ORDER = ["technical", "forum", "academic", "news", "blog", "social_media", "legal", "educational"]
#: Labels of a document and the words that give them (fixed values).
LABELS = [
    ("technical", ["api", "function", "class", "method", "parameter", "usage", "```", "installation"]),
    ("tutorial", ["step", "tutorial", "guide", "how to", "getting started"]),
    ("reference", ["reference", "documentation", "spec", "specification"]),
    ("academic", ["abstract", "methodology", "research", "study", "analysis"]),
]
#: Frameworks by the host of a site (fixed values).
FRAMEWORKS = [("material_design", r"^.*(\.n8n\.io|docs\.n8n\.io)$|^.*\.mkdocs\..*$"), ("readme_io", r"^.*\.readme\.(io|com)$"), ("gitbook", r"^.*\.gitbook\.(io|com)$")]


def url_kind(url: Column) -> Column:
    """``text``, ``sitemap`` or ``page`` (SRC1); null for null."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull(), None).when(F.endswith(url, L(".txt")), "text").when(F.endswith(url, L("sitemap.xml")) | F.contains(path, L("sitemap")), "sitemap").otherwise("page")


def defragmented(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def document_id(url: Column) -> Column:
    """Host and path with slashes as underscores (MD6)."""
    return F.translate(F.regexp_extract(url, r"^[a-zA-Z]+://([^?#]*)", 1), "/", "_")


def framework(domain: Column) -> Column:
    out = None
    for name, pattern in FRAMEWORKS:
        test = F.lower(domain).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def content_type(text: Column, url: Column) -> Column:
    """The address decides first; else the type with most words of its list in the text, two at least, the earlier one in a tie (MD8)."""
    by_name = {name: places for name, places, _ in TYPES}

    def decide(low: Column, where: Column) -> Column:
        out = None
        for name in ADDRESS_ORDER:
            test = F.exists(F.array(*[L(p) for p in by_name[name]]), lambda p: F.contains(where, p))
            out = F.when(test, name) if out is None else out.when(test, name)
        scores = [F.size(F.filter(F.array(*[L(w) for w in words]), lambda w: F.contains(low, w))) for _, _, words in TYPES]
        # The best of all in one pass: each score is counted once, the earlier type wins a tie.
        best = F.array_max(F.array(*[F.struct(score.alias("score"), L(-k).alias("order"), L(name).alias("name")) for k, ((name, _, _), score) in enumerate(zip(TYPES, scores))]))
        by_text = F.transform(F.array(best), lambda b: F.when(b["score"] < 2, "general").otherwise(b["name"]))[0]
        return out.otherwise(by_text)

    # Lower case is made once per row: a lambda's variable is a value, an expression in it would be made per word.
    both = F.array(F.struct(F.lower(F.coalesce(text, L(""))).alias("low"), F.lower(F.coalesce(url, L(""))).alias("where")))
    return F.transform(both, lambda r: decide(r["low"], r["where"]))[0]


def labels(text: Column) -> Column:
    """All labels that apply, in order, or general (MD4)."""
    each = lambda low: F.array_compact(F.array(*[F.when(F.exists(F.array(*[L(w) for w in words]), lambda w: F.contains(low, w)), name) for name, words in LABELS]))
    own = F.transform(F.array(F.lower(text)), each)[0]
    return F.when(F.size(own) == 0, F.array(L("general"))).otherwise(own)


def headers(text: Column) -> Column:
    """Headers with their marks, joined (CH14)."""
    return F.array_join(F.regexp_extract_all(text, L(r"(?m)^(#+[ \t]+[^\r\n]+)"), 1), "; ")


def heading_title(text: Column) -> Column:
    """The first heading of the first level, without marks; null if there is none (MD2)."""
    first = F.regexp_extract(text, r"(?m)^[ \t]*# ([^\r\n]*\S)", 1)
    return F.when(first != "", F.trim(F.regexp_replace(first, r"[#*_`]", "")))


def title(text: Column) -> Column:
    """MD1: the first heading of the first level; else the first line that is underlined with ``=`` or names a title, name or subject; else the first
    line of more than 5 characters, cut at 50; else Untitled Document, as for null and empty texts. Lines end at ``\\n``; marks are taken out."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    clean = lambda c: strip(F.regexp_replace(c, r"[#*_`]", ""))
    filled = lambda c: F.when(c != "", c)

    def underlined_or_named(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            under = F.when(~F.startswith(line, L("#")) & F.startswith(F.get(lines, i + 1), L("=")), filled(clean(line)))
            named = F.when(F.lower(line).rlike("title|name|subject"), clean(filled(strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)))))
            return F.coalesce(under, named)

        return F.get(F.array_compact(F.transform(lines, one)), L(0))

    def chain(lines: Column) -> Column:
        heading = F.get(F.filter(lines, lambda x: F.startswith(x, L("# "))), L(0))
        first = clean(F.get(F.filter(lines, lambda x: (F.length(x) > 5) & ~x.rlike("^(?:#|```|---)")), L(0)))
        cut = F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 50), L("..."))).otherwise(first)
        return F.coalesce(clean(heading), underlined_or_named(lines), cut, L("Untitled Document"))

    # Lines are stripped once per row: a lambda's variable is a value.
    return F.transform(F.array(F.transform(F.split(F.coalesce(text, L("")), "\n"), strip)), chain)[0]


def document_numbers(text: Column, domain: Column) -> dict[str, Column]:
    """MD3: counts of a document. Links that name another host are external, all others internal."""
    words = F.size(white_words(text))
    marks = F.regexp_extract_all(text, L(r"(?m)^(#{1,6})[ \t]+[^\r\n]+"), 1)
    links = F.regexp_extract_all(text, L(r"\[([^\]]*)\]\(([^)]+)\)"), 2)
    outside = F.size(F.filter(links, lambda u: u.rlike("^https?://") & (F.regexp_extract(u, "^https?://([^/?#]*)", 1) != F.coalesce(domain, L("")))))
    return {
        "words": words, "chars": F.length(text), "headers": F.size(marks), "depth": F.coalesce(F.array_max(F.transform(marks, lambda m: F.length(m))), L(0)), "fences": F.regexp_count(text, L(r"```([a-zA-Z0-9_]+)?\n([\s\S]*?)```")),
        "links": F.size(links), "external": outside, "internal": F.size(links) - outside, "minutes": F.greatest(L(1), F.bround(words / 200.0).cast("int")),
    }


def complexity(words: Column, heads: Column, fences: Column, links: Column) -> Column:
    """MD5: 0..100 by steps."""

    def steps(value: Column, table: list[tuple[int, int]]) -> Column:
        out = None
        for limit, worth in table:
            out = F.when(value > limit, worth) if out is None else out.when(value > limit, worth)
        return out.otherwise(0)

    return (
        steps(words, [(5000, 30), (2000, 20), (500, 10)]) + steps(heads, [(10, 25), (5, 15), (2, 10)]) + steps(fences, [(10, 25), (5, 15), (1, 10)]) + steps(links, [(20, 20), (10, 15), (3, 10)])
    )
