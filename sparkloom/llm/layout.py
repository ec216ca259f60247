"""Problem 6: the page's own text apart from what the site puts around and between it.

A page is rendered by its layout. HTML is parsed into a tree with implied end tags; what is hidden (scripts, styles,
templates, hidden or invisible elements) is dropped and the visible rest is emitted as text: blocks apart, list items
marked, table cells aligned. Markdown and plain text, which is what the stored rows hold, are read into the same kinds
of blocks (headings, paragraphs, lists, tables, fences). Every block line then gets a visibility: it belongs to the
body, or to the site. A line is the site's if

* the site repeats it across its rows (document frequency per source), or many sites repeat it (a shared widget);
* it has the form of a menu, breadcrumb, control, cookie notice, byline, share, promotion or legal line;
* it stands in a side box: a box title followed by titles or links.

A list, table or junk that is all a page has stays its body, and so does everything on an error or filler page.

Nulls and blank texts have no lines to report. Lines are split at ``\\n`` and numbered from 1; code blocks are body, and a
fence that is never closed is one line of code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import folded_lines
from sparkloom.llm import residue
from sparkloom.session import cut_lineage

# --------------------------------------------------------------------------------------------- HTML to visible text

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript", "head", "title", "svg", "iframe", "object"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "body", "html", "fieldset", "address", "caption"}
ROWS = {"li", "tr", "dt", "dd"}
#: Start tags that end an open element, if it is the nearest one inside the given scopes (fixed values of the HTML standard).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class _Node:
    __slots__ = ("tag", "hidden", "parts", "order")

    def __init__(self, tag: str, hidden: bool, order: int | None = None):
        self.tag, self.hidden, self.parts, self.order = tag, hidden, [], order


class TreeBuilder(HTMLParser):
    """A tree of visible and hidden nodes; unclosed elements end where the standard lets them end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", False)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.open[-1].tag == "p":
            self.open.pop()
        if tag in IMPLIED:
            ends, scopes = IMPLIED[tag]
            first = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in scopes:
                    break
                if self.open[i].tag in ends:
                    first = i
            if first is not None:
                del self.open[first:]
        given = dict(attrs)
        style = re.sub(r"\s", "", (given.get("style") or "").lower())
        hidden = self.open[-1].hidden or tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        node = _Node(tag, hidden)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _emit(node: _Node, out: list[str], pre: bool = False, depth: int = 0) -> None:
    if node.hidden:
        return
    tag = node.tag
    if tag == "br":
        out.append("\n")
        return
    if tag == "table":
        rows: list[list[str]] = []

        def collect(n: _Node) -> None:
            for p in n.parts:
                if isinstance(p, _Node) and not p.hidden:
                    if p.tag == "tr":
                        rows.append([" ".join(render_node(c).split()) for c in p.parts if isinstance(c, _Node) and c.tag in ("td", "th") and not c.hidden])
                    else:
                        collect(p)

        collect(node)
        rows = [r for r in rows if r]
        widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
        out.append("\n\n" + "\n".join("| " + " | ".join(c.ljust(widths[i]) for i, c in enumerate(r)) + " |" for r in rows) + "\n\n")
        return
    if tag in BLOCKS:
        out.append("\n" if tag in ROWS else "" if tag in ("ul", "ol") and depth else "\n\n")
    if re.fullmatch("h[1-6]", tag):
        out.append("#" * int(tag[1]) + " ")
    if tag == "li":
        out.append("  " * max(0, depth - 1) + "- ")
    if tag == "pre":
        out.append("```\n")
    for p in node.parts:
        if isinstance(p, str):
            if pre or tag == "pre":
                out.append(p)
            else:
                shown = re.sub(r"\s+", " ", p)
                out.append(shown.lstrip() if not out or out[-1].endswith("\n") else shown)
        else:
            _emit(p, out, pre or tag == "pre", depth + (tag in ("ul", "ol")))
    if tag == "pre":
        out.append("\n```")
    if tag in BLOCKS and tag not in ROWS:
        out.append("" if tag in ("ul", "ol") and depth else "\n\n")


def render_node(node: _Node) -> str:
    out: list[str] = []
    _emit(node, out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def render_html(html: str | None) -> str | None:
    """All visible text of a page; null stays null."""
    if html is None:
        return None
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render_node(builder.root)


# ------------------------------------------------------------------------------------------------ lines of a page

#: Sections that sites have; a menu names them (fixed values).
SECTIONS = set(
    "about api blog careers changelog cloud community contact docs documentation downloads enterprise events examples faq forum glossary guides help home "
    "imprint integrations jobs legal login news partners press pricing privacy products reference register roadmap search security services shop "
    "sitemap solutions status support team terms tutorials videos".split()
) | {"contact us", "about us", "sign up", "sign in", "log in", "privacy policy", "terms of service", "terms of use", "cookie policy"}
#: Titles of side boxes (fixed values).
BOXES = set(
    "on this page|in this section|in this article|table of contents|contents|see also|related articles|related pages|related links|related|popular right now|popular|"
    "you may also like|you might also like|read next|more articles|further reading|more from this section|recent posts|latest posts|trending|recommended|suggested pages|quick links|most read".split("|")
)
#: Controls: whole lines, digits read as 0 (fixed values).
CONTROLS = set(
    "search|search ⌘k|search docs…|search docs...|☰ menu|menu|english ▾|dark mode|light mode|sign in|log in|login|log in / register|sign up|register|get started|get started free|skip to content|"
    "skip to main content|toggle navigation|back to top|back to top ↑|edit this page|report a problem with this page|was this page helpful? yes no|was this page helpful?|👍 👎|print this page|"
    "accept all|reject all|only necessary|manage preferences|cookie settings|got it|ok|alle akzeptieren|alle ablehnen|tout accepter|aceptar todo|[accept](#) [decline](#)|accept|decline|close|share|advertisement".split("|")
)
#: Forms of site lines that begin in a fixed way, on the folded line (fixed values).
HEADS = re.compile(
    r"""(?:last\ (?:updated|reviewed|modified|changed|edited)\b.{0,60}
    |(?:reviewed|written|edited|posted|published|translated|approved|maintained)(?:\ and\ \w+)?\ by\ .{2,90}
    |by\ .{2,60}(?:\ desk\b|,\ for\ the\ readers\ of).*
    |(?:©|\(c\)|copyright\b).{0,160}
    |licensed\ to\ .{5,160}
    |disclaimer:.*|the\ information\ on\ this\ page\ is\ provided\ without.*|all\ rights\ reserved\.?
    |\**(?:advertisement|sponsored|promoted)\**\ *[-–:].*|\*\*advertisement\*\*
    |powered\ by\ \S+(?:\ \S+)?
    |follow\ us\b.{0,120}|share\ this\ (?:article|page|post|guide)\b.{0,120}|found\ this\ useful\?.{0,120}|like\ what\ you\ read\?.{0,120}|click\ to\ copy\ the\ link.{0,120}
    |0\ people\ saved\ this\ page.{0,80}|join\ 0\ .{2,80}(?:community|newsletter)\b.*|subscribe\ to\ .{2,120}|register\ now\ for\ .{2,120}|try\ .{2,60}\ free\ for\ 0\ days.*
    |need\ help\?\ talk\ to\ .{2,100}|sign\ up\ for\ .{2,80}newsletter.*
    |(?:only\ necessary|accept\ all|reject\ all|manage\ preferences|cookie\ settings|got\ it|ok|alle\ akzeptieren|\[accept\]\(\#\)|\[decline\]\(\#\)|\ )+
    |(?:see|read)\ the\ (?:privacy\ statement|cookie\ policy)\ .{0,40}|optional\ ones\ stay\ off.{0,40}|you\ can\ change\ your\ choice\ at\ any\ time.{0,40}
    |[←‹«⟵]\ ?\w.{0,200}|[→›»⟶]\ ?\w.{0,120}
    |(?:previous|prev|next)(?:\ (?:page|article|up|chapter))?\ ?[:→←»«|-].{0,200}
    |tags?:\ .{2,160}
    |\[[^\]]{1,60}\]\(/\)(?:\ .*)?)$""",
    re.X,
)
#: Forms told by a word inside, which is looked for first (fixed values).
INSIDE = [
    (" trademark of ", re.compile(r".{2,60} is a trademark of .*$")),
    (", 0 ", re.compile(r"[\w .&'-]{2,60}, 0 [\w ]{2,40} (?:street|road|avenue|lane)\b,?.*$")),
    ("cookies", re.compile(r"(?:we|by browsing|this site|this website|your privacy matters|wir|nous|este sitio|usamos|utilizamos|usiamo|\S+ and its partners)\b[^.]{0,80}\bcookies\b.{0,240}$")),
    ("→", re.compile(r"\w.{2,140}\w →$")),
    ("»", re.compile(r"\w.{2,140}\w »$")),
    ("▾", re.compile(r"(?:\S+ v?0(?:\.0)+ ▾|.{1,30}▾)$")),
    ("⌘k", re.compile(r".{0,40}⌘k$")),
]


@lru_cache(maxsize=100_000)
def site_form(folded: str) -> bool:
    """Whether a folded line has a form that only site lines have."""
    return folded in CONTROLS or HEADS.match(folded) is not None or any(word in folded and form.match(folded) is not None for word, form in INSIDE)


_CRUMB = re.compile(r"^[^.!?。|]{1,60}(?: (?:>|›|»|→|/|::|\\) [^.!?。|]{1,120}){1,8}$")
_LOCAL = re.compile(r"\[[^\]]*\]\((?:/|#|\.)[^)]*\)")
_ANY_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")
_ITEM = re.compile(r"^(?:[-*+•‣▪]|\d{1,3}[.)])\s+")
_RULE = re.compile(r"^(?:[-=_*~`|:+ ]{3,})$")
_FENCE_LINE = re.compile(r"(?:```[^`]*|~~~ ?[\w+#.-]*)$")
_SPLIT = re.compile(r"\s*[|•·‧∙/]\s*|\s{2,}")
_END = re.compile(r"[.!?:;。！？…]['\")\]*_]*$")

BLANK, BODY, SITE, CODE, TABLE, HEADING, ITEM = range(7)


def fold(line: str) -> str:
    """A line as the frequency tables have it."""
    return re.sub("[0-9]+", "0", " ".join(line.split()).lower())


def fold_hash(folded: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(folded, 42)
    return h - (1 << 64) if h >= 1 << 63 else h


@lru_cache(maxsize=100_000)
def _menu_words(folded: str) -> bool:
    if len(folded) > 400:
        return False
    bare = _ITEM.sub("", folded)
    bare = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1 | ", bare).strip(" |")
    parts = [p for p in _SPLIT.split(bare) if p]
    return bool(parts) and all(p in SECTIONS for p in parts)


def _titleish(line: str) -> bool:
    """Could be the title of another page: short, no sentence end."""
    return len(line) <= 400 and not _END.search(line) and not line.startswith(("|", "`", "#", ">")) and len(line.split()) <= 60


def label(text: str, known: Container[int], whole_body: bool = False) -> list[int]:
    """A kind for each line: BLANK, SITE, or what it is of the body.

    ``known``: hashes of folded lines that the site or many sites repeat.
    """
    lines = text.split("\n")
    kinds = [BLANK] * len(lines)
    bare = [" ".join(x.split()) for x in lines]
    marks = [i for i, line in enumerate(bare) if line[:3] in ("```", "~~~") and _FENCE_LINE.match(line)]
    alone = marks[-1] if len(marks) % 2 else -1  # never closed: what follows is read as text
    fence = False
    box = 0  # 0: outside; 1: just after a box title; 2: inside, something read
    for i, line in enumerate(bare):
        if not line:
            if box == 2:
                box = 0
            continue
        if line[:3] in ("```", "~~~") and _FENCE_LINE.match(line):
            fence = not fence and i != alone
            kinds[i], box = CODE, 0
            continue
        if fence:
            kinds[i] = CODE
            continue
        if _RULE.match(line):
            kinds[i] = TABLE if "|" in line else HEADING
            box = 0
            continue
        folded = re.sub("[0-9]+", "0", line.lower())
        if line.startswith("|") and line.count("|") > 2:
            kinds[i], box = TABLE, 0
            continue
        title = folded.strip("#*_:[] ").strip()
        if title in BOXES and len(title) > 3:
            kinds[i], box = SITE, 1
            continue
        if line.startswith("#") and not folded.strip("# ") in CONTROLS:
            kinds[i], box = HEADING, 0
            continue
        item = bool(_ITEM.match(line))
        if box:
            rest = _ITEM.sub("", line)
            if (_titleish(rest) or _ANY_LINK.search(rest) and not _ANY_LINK.sub("", rest).strip(" ·•|,-")) and not site_form(folded):
                kinds[i], box = SITE, 2
                continue
            box = 0
        if site_form(folded) or _menu_words(folded) and (len(line.split()) > 1 or item or folded not in ("search", "menu")):
            kinds[i] = SITE
            continue
        links = _ANY_LINK.findall(line)
        if links and len(_LOCAL.findall(line)) == len(links) and not _ANY_LINK.sub("", line).strip(" ·•|,/>›»→-*+"):
            kinds[i] = SITE  # nothing but links within the site
            continue
        if _CRUMB.match(line) and folded.split(" ")[0] in SECTIONS:
            kinds[i] = SITE
            continue
        if known and fold_hash(folded) in known:
            kinds[i] = SITE
            continue
        kinds[i] = ITEM if item else BODY
    # A setext underline belongs to the line above it.
    for i, line in enumerate(bare):
        if kinds[i] == HEADING and line and set(line) <= set("=-") and i and bare[i - 1]:
            if kinds[i - 1] in (BODY, SITE) and len(bare[i - 1].split()) <= 30:
                kinds[i - 1] = HEADING
    if whole_body:
        return [BODY if k == SITE else k for k in kinds]
    return kinds


def body_of(text: str, kinds: list[int]) -> str:
    """The lines that are not the site's; runs of blank lines are closed up."""
    kept = "\n".join(line for line, k in zip(text.split("\n"), kinds) if k != SITE)
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", kept).strip()


# ------------------------------------------------------------------------------------------- the tree of a stored page

_TAGS = {BODY: "p", CODE: "pre", TABLE: "table", HEADING: "heading", ITEM: "ul", SITE: "site", BLANK: "space"}


def page_tree(text: str, kinds: list[int]) -> _Node:
    """Markdown lines as the same tree that markup gives: blocks with a leaf per line, which knows its number (``order``, from 1).

    A block ends with the lines of its kind; its end is implied, as markdown has no end tags. Deeper list items stand in
    lists of their own. Blocks of site lines are hidden.
    """
    root = _Node("root", False)
    lists: list[tuple[int, _Node]] = []
    for i, (line, kind) in enumerate(zip(text.split("\n"), kinds)):
        tag = _TAGS[kind]
        if tag != "ul":
            lists = []
            if not root.parts or root.parts[-1].tag != tag:
                root.parts.append(_Node(tag, tag == "site"))
            block = root.parts[-1]
        else:
            depth = len(line) - len(line.lstrip())
            while lists and lists[-1][0] > depth:
                lists.pop()
            if not lists or lists[-1][0] < depth:
                block = _Node("ul", False)
                (lists[-1][1] if lists else root).parts.append(block)
                lists.append((depth, block))
            block = lists[-1][1]
        leaf = _Node("line", block.hidden, i + 1)
        leaf.parts.append(line)
        block.parts.append(leaf)
    return root


def leaves(node: _Node) -> Iterator[_Node]:
    for p in node.parts:
        if isinstance(p, _Node):
            if p.tag == "line":
                yield p
            else:
                yield from leaves(p)


def _aligned(lines: list[str]) -> list[str]:
    """Rows of a table with cells padded to the width of their column; a line that isn't a row stays as it is."""
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] if "|" in x else None for x in lines]
    most = max((len(r) for r in rows if r), default=0)
    rule = [r is not None and all(set(c) <= set("-: ") for c in r) for r in rows]
    widths = [max((len(r[k]) for r, ruled in zip(rows, rule) if r and not ruled and k < len(r)), default=3) for k in range(most)]
    fill = lambda r, ruled: [(c[:1] + "-" * max(1, widths[k] - 2) + c[-1:] if ruled and c else c.ljust(widths[k])) for k, c in enumerate(r)]
    return [x if r is None else "| " + " | ".join(fill(r, ruled)) + " |" for x, r, ruled in zip(lines, rows, rule)]


def render_page(root: _Node) -> str:
    """The visible text of a page's tree: blocks spaced as they were (one empty line at most), lists as they stood, cells of tables aligned."""
    out: list[str] = []
    for block in root.parts:
        if block.hidden:
            continue
        own = [leaf.parts[0] for leaf in leaves(block) if not leaf.hidden]
        if block.tag == "space":
            out += [""] if out and out[-1] else []
        else:
            out += _aligned(own) if block.tag == "table" and sum(x.lstrip().startswith("|") for x in own) > 1 else own
    return "\n".join(out).strip("\n")


# ------------------------------------------------------------------------------------------------- known site lines


def known_lines(df: DataFrame, source: str, text: str, min_rows: int = 5, min_share: float = 0.05, min_sources: int = 3) -> DataFrame:
    """``_src, _h``: per source the hashes of folded lines that it repeats, and with a null source those that many sources repeat.

    A source repeats a line that stands in at least ``min_rows`` and ``min_share`` of its rows; many sources do if it stands
    in ``min_sources`` or more of them, ``min_rows`` times each on average.
    """
    rows = df.filter(F.col(text).isNotNull())
    lines = rows.select(F.coalesce(F.col(source).cast("long"), F.lit(-1)).alias("_src"), F.explode(F.array_distinct(folded_lines(F.col(text)))).alias("_line"))
    # Markup that any page may have says nothing about its site.
    plain = lines.filter((F.col("_line") != "") & ~F.col("_line").rlike(r"^(?:```.*|~~~.*|[-=_*~`|:+ ]+|\|.*)$"))
    counts = plain.select("_src", F.xxhash64("_line").alias("_h")).groupBy("_src", "_h").agg(F.count(F.lit(1)).alias("_k"))
    counts = cut_lineage(counts.filter("_k > 1"))
    totals = rows.groupBy(F.coalesce(F.col(source).cast("long"), F.lit(-1)).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    own = counts.join(totals, "_src").filter((F.col("_src") != -1) & (F.col("_k") >= min_rows) & (F.col("_k") >= min_share * F.col("_n"))).select("_src", "_h")
    shared = counts.groupBy("_h").agg(F.count(F.lit(1)).alias("_s"), F.sum("_k").alias("_k")).filter((F.col("_s") >= min_sources) & (F.col("_k") >= min_rows * F.col("_s")))
    return own.unionByName(shared.select(F.lit(None).cast("long").alias("_src"), "_h"))


#: Known lines are sent to all workers up to so many (8 bytes each), and matched by joins beyond.
SENT_LINES = 2_000_000


class Known:
    """The hashes of a site's lines and of those that many sites repeat, looked at as one set."""

    def __init__(self, own: frozenset[int] | set[int], shared: frozenset[int] | set[int]):
        self.own, self.shared = own, shared

    def __contains__(self, h: int) -> bool:
        return h in self.own or h in self.shared

    def __bool__(self) -> bool:
        return bool(self.own or self.shared)


def with_known(df: DataFrame, source: str, text: str) -> tuple[DataFrame, Callable[[pd.DataFrame], Iterator[Known]]]:
    """``df`` with what says which lines are the site's, and a function that reads it from a batch.

    With up to ``SENT_LINES`` known lines the rows carry their source alone (``_site``) and the lines are broadcast. Beyond,
    line hashes are joined with the known ones, and a row carries those of its own lines that are known (``_known``).
    """
    lines = cut_lineage(known_lines(df, source, text))
    if lines.count() <= SENT_LINES:
        sets: dict[int | None, set[int]] = {}
        for r in lines.toLocalIterator():
            sets.setdefault(r["_src"], set()).add(r["_h"])
        sent = df.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in sets.items()})

        def read(batch: pd.DataFrame) -> Iterator[Known]:
            every = sent.value
            shared = every.get(None, frozenset())
            for site in batch["_site"]:
                yield Known(frozenset() if pd.isna(site) else every.get(int(site), frozenset()), shared)

        return df.withColumn("_site", F.col(source).cast("long")), read
    row = [F.xxhash64(F.col(source).isNull(), source, text).alias("_r1"), F.xxhash64(F.lit("second"), F.col(source).isNull(), source, text).alias("_r2")]
    found = df.select(*row, F.coalesce(F.col(source).cast("long"), F.lit(-1)).alias("_src"), F.explode(F.array_distinct(folded_lines(F.col(text)))).alias("_line"))
    found = found.select("_r1", "_r2", "_src", F.xxhash64("_line").alias("_h"))
    own, shared = lines.filter(F.col("_src").isNotNull()), lines.filter(F.col("_src").isNull()).select("_h")
    hits = found.join(own, ["_src", "_h"], "left_semi").unionByName(found.join(shared, "_h", "left_semi"))
    hits = hits.groupBy("_r1", "_r2").agg(F.collect_set("_h").alias("_known"))

    def read_own(batch: pd.DataFrame) -> Iterator[Known]:
        for own_ in batch["_known"]:
            yield Known(frozenset(() if own_ is None else own_.tolist()), frozenset())

    return df.select("*", *row).join(hits, ["_r1", "_r2"], "left").drop("_r1", "_r2"), read_own


def site_lines(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content") -> DataFrame:
    """``key, line_no`` of the non-blank lines that are not the main body."""
    kind = dict(df.dtypes)[key]
    rows, known_of = with_known(df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text")), "_source", "_text")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, numbers = [], []
            for k, t, known in zip(batch["_key"], batch["_text"], known_of(batch)):
                if residue.is_residue(t, known):
                    continue
                for leaf in leaves(page_tree(t, label(t, known))):
                    if leaf.hidden:
                        keys.append(k)
                        numbers.append(leaf.order)
            yield pd.DataFrame({key: pd.Series(keys, dtype=batch["_key"].dtype), "line_no": pd.Series(numbers, dtype="int32")})

    return rows.drop("_source").mapInPandas(mark, f"{key} {kind}, line_no int")


_MARKUP = re.compile(r"\s*(?:<!doctype html|<html\b|<body\b|<(?:div|main|article|section|p|h1)\b[^>]*>)", re.I)


def _own_text(text: str, known: Container[int]) -> str:
    if _MARKUP.match(text):
        text = render_html(text) or ""
    return text if residue.is_residue(text, known) else render_page(page_tree(text, label(text, known)))


def main_text(df: DataFrame, source: str = "source_id", text: str = "content", out: str = "body") -> DataFrame:
    """``df`` with ``out``: the visible text of each page (see :func:`render_page`); null for null text. Stored markup is rendered first."""
    names = df.columns
    rows, known_of = with_known(df, source, text)
    carried = "_site" if "_site" in rows.columns else "_known"

    @F.pandas_udf("string")
    def own(texts: pd.Series, known: pd.Series) -> pd.Series:
        known_ = known_of(pd.DataFrame({carried: known}))
        return pd.Series([None if t is None else _own_text(t, k) for t, k in zip(texts, known_)], dtype="object")

    return rows.withColumn(out, own(F.col(text), F.col(carried))).select(*[c for c in names if c != out], out)
