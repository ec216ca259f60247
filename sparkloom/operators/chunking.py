"""Structure-aware chunks of markdown (CH1-CH13): fences stay whole where they can, else paragraphs, sentences, lines.

The scan of a text is sequential, so it runs per row inside an Arrow function; everything around it is relational.
Null and empty texts give no chunks; a text of at most ``size`` characters is one chunk as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LEAD, REACH = 5000, 0.3, 200


def fences(text: str) -> list[tuple[int, int]]:
    """Start and end of complete fenced blocks. A closing run not followed by a line end closes nothing; an unclosed block ends the search."""
    out, at = [], 0
    while (start := text.find("```", at)) >= 0:
        line = text.find("\n", start)
        if line < 0:
            at = start + 3
            continue
        end = text.find("```", line + 1)
        if end < 0:
            break
        at = end + 3
        if at >= len(text) or text[at] in "\r\n":
            out.append((start, at))
    return out


def _near_paragraph(text: str, start: int, wanted: int, size: int) -> int:
    """After the empty line nearest to ``wanted`` (the earlier of two), within reach; ``wanted`` if there is none."""
    lo = max(start + int(size * LEAD), wanted - REACH)
    spots = [m.start() for m in re.finditer(r"(?=\n\n)", text[lo : min(len(text), wanted + REACH)])]
    # Places are taken two by two, as a search that goes on after each empty line finds them.
    seen: list[int] = []
    for s in spots:
        if not seen or s >= seen[-1] + 2:
            seen.append(s)
    return min((lo + s for s in seen), key=lambda x: abs(x - wanted)) + 2 if seen else wanted


def next_cut(text: str, start: int, size: int, blocks: list[tuple[int, int]]) -> int:
    """Where the chunk that begins at ``start`` ends."""
    limit = start + size
    for a, b in blocks:
        if start <= a < limit < b:
            return _near_paragraph(text, start, a if a > start + int(size * LEAD) else b, size)
        if a < start < b < limit:
            return _near_paragraph(text, start, b, size)
    window = text[start:limit]
    for mark, skip in (("\n\n", 2), (". ", 2), ("\n", 1)):
        at = window.rfind(mark)
        if at > len(window) * LEAD:
            return start + at + skip
    return limit


def chunk(text: str | None, size: int = SIZE) -> list[str]:
    if not text:
        return []
    if len(text) <= size:
        return [text]
    blocks, out, start = fences(text), [], 0
    while start < len(text):
        if start + size >= len(text):
            out.append(text[start:].strip())
            break
        end = next_cut(text, start, size, blocks)
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        start = end if end > start else start + size
    return out


def sections(text: str) -> list[str]:
    """Paragraphs joined into sections: a header, list, number or fence at the start of a paragraph begins a new one (CH8)."""
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if not p:
            continue
        if not out or re.match(r"(#{1,6}\s|[-*+]\s|\d+\.\s|```)", p):
            out.append(p)
        else:
            out[-1] += "\n\n" + p
    return out


_STOP = re.compile(r"[.!?]+\s+")


def rule_split(text: str, size: int) -> list[str]:
    """Words packed up to ``size`` characters, each counted with one space (CH11).

    A full piece keeps its whole sentences, written again with ``. `` between them and a closing ``.``; the words of the last,
    open sentence begin the next piece. A piece without a sentence end goes out as it is.
    """
    out: list[str] = []
    held: list[str] = []
    length = 0
    for word in text.split():
        if held and length + len(word) + 1 > size:
            *whole, rest = _STOP.split(" ".join(held))
            out.append(". ".join(whole) + "." if whole else rest)
            held = rest.split() if whole else []
            length = len(rest) if whole else 0
        held.append(word)
        length += len(word) + 1
    return out + ([" ".join(held)] if held else [])


#: What a splitting model puts between its pieces (fixed value).
SEPARATOR = "---CHUNK_SEPARATOR---"
Splitter = Callable[[str, int], "str | None"]


def split_section(section: str, size: int, most: int, splitter: Splitter | None = None) -> list[str]:
    """CH10: the pieces a model gives, those over ``most`` split by rule; by rule alone without a model or an answer."""
    answer = splitter(section, size) if splitter else None
    pieces = [p.strip() for p in (answer or "").split(SEPARATOR) if p.strip()]
    checked = [x for p in pieces for x in ([p] if len(p) <= most else rule_split(p, size))]
    return checked or rule_split(section, size)


def semantic_chunks(text: str | None, size: int = SIZE, most: int | None = None, splitter: Splitter | None = None) -> list[str]:
    """Sections packed greedily up to ``size``; one that is larger than ``most`` is split (CH9)."""
    out: list[str] = []
    held = ""
    for s in sections(text or ""):
        if len(s) > (most or size):
            out += [held] if held else []
            held = ""
            out += split_section(s, size, most or size, splitter)
        elif held and len(held) + 2 + len(s) > size:
            out.append(held)
            held = s
        else:
            held = f"{held}\n\n{s}" if held else s
    return out + ([held] if held else [])


def document_chunks(text: str | None, size: int = 1000, most: int = 2000, semantic: bool = True, splitter: Splitter | None = None) -> list[str]:
    """CH12: nothing for blank texts; sections for texts over ``size`` if wanted, by rule otherwise or if sections give nothing."""
    if not (text or "").strip():
        return []
    if semantic and len(text) > size and (found := semantic_chunks(text, size, most, splitter)):
        return found
    return rule_split(text, size)


def positions(text: str, chunks: list[str]) -> list[tuple[int, int]]:
    """CH13: where each chunk stands, looked for after the one before; from there on where it can't be found."""
    out, at = [], 0
    for c in chunks:
        start = text.find(c, at)
        start = at if start < 0 else start
        at = start + len(c)
        out.append((start, at))
    return out


def document_rows(df: DataFrame, text: str = "content", size: int = 1000, most: int = 2000, semantic: bool = True) -> DataFrame:
    """``df`` once per chunk (CH12, CH13): ``chunk_index, total_chunks, chunk, start, end, token_count``."""

    @F.pandas_udf("array<struct<chunk: string, start: int, end: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            found = document_chunks(t, size, most, semantic)
            return [{"chunk": c, "start": a, "end": b} for c, (a, b) in zip(found, positions(t or "", found))]

        return texts.map(one)

    rows = df.withColumn("_cut", cut(F.col(text)))
    rows = rows.select(*df.columns, F.size("_cut").alias("total_chunks"), F.posexplode("_cut").alias("chunk_index", "_c")).select(*df.columns, "chunk_index", "total_chunks", "_c.*")
    return rows.withColumn("token_count", F.floor(F.length("chunk") / 4).cast("int"))


def chunk_rows(df: DataFrame, text: str = "content", size: int = SIZE, semantic: bool = False) -> DataFrame:
    """``df`` once per chunk, with ``chunk_index`` (from 0), ``chunk``, ``token_count`` (a quarter of the characters)."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (semantic_chunks if semantic else chunk)(t, size))

    rows = df.select("*", F.posexplode(cut(F.col(text))).alias("chunk_index", "chunk"))
    return rows.withColumn("token_count", F.floor(F.length("chunk") / 4).cast("int"))


def check_chunks(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """``chunks`` with what is wrong with their fences (CH6).

    ``odd_fence``: a fence without its partner, ``orphan_close`` where the chunk ends with one and ``orphan_open`` elsewhere;
    ``empty_fence``: a block without text; ``merged``: a definition run together with its keyword, in chunks with fences.
    """
    t = F.col(text)
    runs = F.regexp_count(t, F.lit("```"))
    odd, closes = runs % 2 == 1, t.rlike(r"```\s*\z")
    merged = (runs > 0) & t.rlike(r"(async|function|def)([a-zA-Z_][a-zA-Z0-9_]*)")
    return chunks.withColumns({"odd_fence": odd, "orphan_close": odd & closes, "orphan_open": odd & ~closes, "empty_fence": t.rlike(r"```[a-zA-Z0-9_]*\n\s*```"), "merged": merged})
