"""Problem 1: oversized items cut into pieces at natural boundaries, with an overlap.

A text is handled as ranges of ``range_chars`` characters, each read with a small halo, so that no worker needs the
whole of it: (1) workers list the boundaries in their range and count its characters and code fences; (2) the tables
of ranges are stitched: running sums over a text turn local places into offsets and say which boundaries lie inside a
code block; (3) pieces are planned on boundaries alone, in segments of ``segment`` ranges that start at a boundary of
their own, so the plan of a giant text runs in parallel; (4) pieces are emitted by offset from the range they start in.
Files are read by byte range in the same way (:func:`split_files`); nothing holds a whole file.

Null texts and texts of at most ``limit`` characters have no pieces. Rows that repeat a key and its text give their
pieces once. A text without any boundary is cut at the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.session import cut_lineage

LIMIT, OVERLAP, RANGE_CHARS, SEGMENT, HALO = 5_000, 200, 65_536, 64, 256
#: What a boundary is worth: end of a paragraph or code block, of a sentence, of a line, of a word.
BLOCK, SENTENCE, LINE, WORD = 3, 2, 1, 0
_MARKS = re.compile(
    r"(?P<fence>^[ \t]*(?:```[^`\n]*|~~~[ \t]*[\w+#.-]*[ \t\r]*)(?:\n|\Z))|(?P<para>\n(?:[ \t\r]*\n)+)|(?P<sent>[.!?…][\"')\]”»]*[ \t\r]*\n|[.!?…][\"')\]”»]*[ \t]+|[。！？]+)|(?P<line>\n)|(?P<word>[ \t]+)", re.M
)


_LINE_START = re.compile(r"(?<=\n)(?=\S)")


def scan(text: str, lo: int, hi: int) -> tuple[list[int], list[int], list[int], int]:
    """Boundaries whose mark ends in (lo, hi]: places from ``lo``, worth, fences before each; and the fences of the range.

    The text before ``lo`` and after ``hi`` is the halo: reading starts at the last line that begins before ``lo`` with
    text, so a range sees the marks that a reading of the whole would see. Words are listed once per 256 characters at
    most: they matter only where there is nothing else.
    """
    places, worth, fences, seen, last = [], [], [], 0, lo
    at = 0
    if lo:
        starts = [m.start() for m in _LINE_START.finditer(text, 1, lo + 1) if m.start() <= lo]
        at = starts[-1] if starts else 1
    for m in _MARKS.finditer(text, at):
        end, kind = m.end(), m.lastgroup
        if end <= lo:
            continue
        if end > hi:
            break
        if kind == "fence":
            # Before an opening fence; before a closing one the place counts as inside.
            places.append(m.start() - lo), worth.append(BLOCK), fences.append(seen)
            seen += 1
            places.append(end - lo), worth.append(BLOCK), fences.append(seen)
        elif kind == "word" and end - last < 256:
            continue
        else:
            places.append(end - lo), worth.append({"para": BLOCK, "sent": SENTENCE, "line": LINE, "word": WORD}[kind]), fences.append(seen)
        last = end
    return places, worth, fences, seen


def plan(places: list[int], worth: list[int], start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (from, to) that cover start..end: each at most ``limit`` long, beginning about ``overlap`` before the last one's end."""
    out = []
    at = start
    while end - at > limit:
        lo, hi = bisect_right(places, at + limit // 2), bisect_right(places, at + limit)
        if lo == hi:
            lo = bisect_right(places, at + overlap + overlap // 2)
        cut = max(range(lo, hi), key=lambda i: (worth[i], places[i]), default=None)
        to = at + limit if cut is None else places[cut]
        out.append((at, to))
        lo, hi = bisect_left(places, to - overlap - overlap // 4), bisect_right(places, to - overlap + overlap // 4)
        near = min((i for i in range(lo, hi) if worth[i] > WORD), key=lambda i: abs(places[i] - to + overlap), default=None)
        at = to - overlap if near is None else places[near]
    out.append((at, end))
    return out


def _stitched(tables: DataFrame, segment: int) -> DataFrame:
    """``_rid, _range, _off, _open, _seg``: running sums over the ranges of a text, characters and fences before each range.

    Only numbers go through the windows: sums over the ranges of a segment first, then over the segments of a text, so
    that the ranges of a giant text don't meet in one task.
    """
    parts = tables.select("_rid", "_range", "_chars", "_fences", F.floor(F.col("_range") / segment).alias("_seg"))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    segments = parts.groupBy("_rid", "_seg").agg(F.sum("_chars").alias("_c"), F.sum("_fences").alias("_f"))
    segments = segments.select("_rid", "_seg", total("_c", before("_rid", "_seg")).alias("_c0"), total("_f", before("_rid", "_seg")).alias("_f0"))
    inside = before("_rid", "_seg", "_range")
    sums = parts.select("_rid", "_seg", "_range", total("_chars", inside).alias("_c1"), total("_fences", inside).alias("_f1")).join(segments, ["_rid", "_seg"])
    return sums.select("_rid", "_range", (F.col("_c0") + F.col("_c1")).alias("_off"), ((F.col("_f0") + F.col("_f1")) % 2).alias("_open"), "_seg")


def _planned(tables: DataFrame, limit: int, overlap: int, segment: int) -> DataFrame:
    """``_rid, _seg, _no, _from, _to, _range``: pieces by character offsets, and the range each begins in."""
    stitched = tables.drop("_fences").join(cut_lineage(_stitched(tables, segment)), ["_rid", "_range"])

    def first(pdf: pd.DataFrame) -> int:
        """Where a segment starts: the best boundary in its first half limit of characters, and the start of the text for the first."""
        row = pdf.sort_values("_range").iloc[0]
        if row["_range"] == 0:
            return 0
        near = [(w if (f + row["_open"]) % 2 == 0 else -1, -p) for p, w, f in zip(row["_places"], row["_worth"], row["_before"]) if p <= limit // 2]
        return int(row["_off"]) + (-max(near)[1] if near else 0)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_rid": [pdf["_rid"].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "_start": [first(pdf)]})

    heads = stitched.filter(F.col("_range") % segment == 0).groupBy("_rid", "_seg").applyInPandas(starts, "_rid string, _seg long, _start long")
    total = tables.groupBy("_rid").agg(F.sum("_chars").alias("_total"))
    w = W.partitionBy("_rid").orderBy("_seg")
    heads = heads.join(total, "_rid").withColumn("_end", F.coalesce(F.lead("_start").over(w), F.col("_total"))).drop("_total")
    # Segments end where the next one starts: its first range's boundaries belong to both.
    shared = stitched.filter((F.col("_range") % segment == 0) & (F.col("_seg") > 0)).withColumn("_seg", F.col("_seg") - 1)
    rows = stitched.unionByName(shared).join(heads, ["_rid", "_seg"])

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range").drop_duplicates("_range")
        places, worth = [], []
        for off, open_, p, w_, f in zip(pdf["_off"], pdf["_open"], pdf["_places"], pdf["_worth"], pdf["_before"]):
            for place, value, before in zip(p, w_, f):
                places.append(int(off) + int(place))
                worth.append(int(value) if (before + open_) % 2 == 0 else min(int(value), LINE) - 2)
        start, end = int(pdf["_start"].iloc[0]), int(pdf["_end"].iloc[0])
        seg = pdf["_seg"].iloc[0]
        # A later segment begins with the overlap as well, in the range before its own.
        found = plan(places, worth, start, end, limit - overlap if seg else limit, overlap)
        if seg:
            found[0] = (max(0, found[0][0] - overlap), found[0][1])
        offs = pdf["_off"].to_numpy()
        at = np.searchsorted(offs, [a for a, _ in found], "right") - 1
        out = pd.DataFrame({"_rid": pdf["_rid"].iloc[0], "_seg": seg, "_no": range(len(found)), "_from": [a for a, _ in found], "_to": [b for _, b in found]})
        # The overlap of a first piece may begin before the segment's first range.
        return out.assign(_range=np.where(at < 0, pdf["_range"].iloc[0] - 1, pdf["_range"].to_numpy()[at]))

    return rows.groupBy("_rid", "_seg").applyInPandas(pieces, "_rid string, _seg long, _no long, _from long, _to long, _range long")


_TABLE = "_rid string, _range long, _chars long, _fences long, _places array<int>, _worth array<int>, _before array<int>"


def _numbered(plan_: DataFrame) -> DataFrame:
    """``plan_`` with ``chunk_number``: pieces of the segments before, and the place within the segment."""
    counts = plan_.groupBy("_rid", "_seg").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_rid").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return plan_.join(counts.select("_rid", "_seg", before.alias("_c")), ["_rid", "_seg"]).withColumn("chunk_number", (F.col("_c") + F.col("_no")).cast("int"))


def split_column(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, segment: int = SEGMENT) -> DataFrame:
    """``key, chunk_number`` (from 0), ``start`` (character offset), ``text``: the pieces of every text over the limit."""
    kind = dict(df.dtypes)[key]
    long = df.filter(F.length(text) > limit).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    long = long.withColumn("_rid", F.md5(F.concat_ws("\x00", F.coalesce(F.col("_key").cast("string"), F.lit("\x01")), "_text")))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, t in zip(batch["_rid"], batch["_text"]):
                for no, start in enumerate(range(0, len(t), range_chars)):
                    lo, hi = max(0, start - HALO), min(len(t), start + range_chars)
                    places, worth, before, fences = scan(t[lo : hi + HALO], start - lo, hi - lo)
                    out.append((rid, no, hi - start, fences, places, worth, before))
            yield pd.DataFrame(out, columns=["_rid", "_range", "_chars", "_fences", "_places", "_worth", "_before"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, k, t in zip(batch["_rid"], batch["_key"], batch["_text"]):
                starts = range(0, len(t), range_chars)
                yield pd.DataFrame({"_rid": rid, "_key": pd.Series([k] * len(starts), dtype=batch["_key"].dtype), "_range": range(len(starts)), "_part": [t[s : s + range_chars + limit] for s in starts]})

    # Boundary tables are small beside the texts and needed several times: they are written once. Rows that repeat a key
    # and its text fall together here and, by the keys of the last join, there.
    read = cut_lineage(long.select("_rid", "_text").mapInPandas(tables, _TABLE).dropDuplicates(["_rid", "_range"]))
    pieces = _numbered(cut_lineage(_planned(read, limit, overlap, segment)))
    texts = long.mapInPandas(parts, f"_rid string, _key {kind}, _range long, _part string").dropDuplicates(["_rid", "_range"])
    cut = F.substring(F.col("_part"), (F.col("_from") - F.col("_range") * range_chars + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))
    return pieces.join(texts, ["_rid", "_range"]).select(F.col("_key").alias(key), "chunk_number", F.col("_from").alias("start"), cut.alias(text))


def _read_bytes(path: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(place) as f:
        return f.read_at(size, start)


def _whole_characters(raw: bytes, lo: int, hi: int) -> tuple[int, int]:
    """``lo`` and ``hi`` moved on to the first byte of a character."""
    while lo < len(raw) and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi += 1
    return lo, hi


def split_files(spark: SparkSession, files: list[tuple[str, int]], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20, segment: int = SEGMENT) -> DataFrame:
    """``path, chunk_number, start, text``: the pieces of UTF-8 files given as (path, size in bytes), read by byte range.

    Malformed bytes come out as U+FFFD. Files of at most ``limit`` characters give one piece, empty files none.
    """
    listed = spark.createDataFrame(pd.DataFrame({"_rid": [p for p, _ in files], "_size": [s for _, s in files]}).astype({"_rid": "object", "_size": "int64"}), "_rid string, _size long").filter("_size > 0")
    ranges = listed.select("_rid", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(range_bytes).cast("long"))).alias("_start"))
    ranges = ranges.withColumn("_range", (F.col("_start") / range_bytes).cast("long")).repartition("_rid", "_range")

    def own(path: str, start: int, before: int, after: int) -> tuple[str, str, str]:
        """The characters before the range, of the range and after it."""
        at = max(0, start - before)
        raw = _read_bytes(path, at, start - at + range_bytes + after + 4)
        head, _ = _whole_characters(raw, 0, 0) if at else (0, 0)
        lo, hi = _whole_characters(raw, start - at, min(len(raw), start - at + range_bytes))
        return raw[head:lo].decode(errors="replace"), raw[lo:hi].decode(errors="replace"), raw[hi:].decode(errors="ignore")

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rid, no, start in zip(batch["_rid"], batch["_range"], batch["_start"]):
                before, text, after = own(rid, start, 4 * HALO, 4 * HALO)
                places, worth, fences_before, fences = scan(before + text + after, len(before), len(before) + len(text))
                yield pd.DataFrame({"_rid": [rid], "_range": [no], "_chars": [len(text)], "_fences": [fences], "_places": [places], "_worth": [worth], "_before": [fences_before]})

    read = cut_lineage(ranges.mapInPandas(tables, _TABLE))
    planned = cut_lineage(_planned(read, limit, overlap, segment))
    located = _numbered(planned).join(_stitched(read, segment).select("_rid", "_range", "_off"), ["_rid", "_range"])
    located = located.repartition("_rid", "_range").sortWithinPartitions("_rid", "_range", "_from")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, text = None, ""
        for batch in batches:
            out = []
            for rid, no, off, a, b, k in zip(batch["_rid"], batch["_range"], batch["_off"], batch["_from"], batch["_to"], batch["chunk_number"]):
                if held != (rid, no):
                    _, body, after = own(rid, int(no) * range_bytes, 0, 4 * limit)
                    held, text = (rid, no), body + after
                out.append((rid, k, a, text[a - off : b - off]))
            yield pd.DataFrame(out, columns=["path", "chunk_number", "start", "text"])

    return located.mapInPandas(emit, "path string, chunk_number int, start long, text string")
