"""Link categories, combined scores, regression summaries, statistics of pairs (QE1-QE7, AG18, AG22, AG23)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

L = F.lit


def link_categories(text: Column) -> dict[str, Column]:
    """QE3: how many links lead inside, outside, to code or a glossary, to a part of the page, or are broken."""
    urls = F.regexp_extract_all(text, L(r"\[([^\]]*)\]\(([^)]*)\)"), 2)
    n = lambda test: F.size(F.filter(urls, test))
    return {
        "links": F.size(urls), "internal": n(lambda u: u.rlike(r"^(/|#|\.\./|\./)")), "external": n(lambda u: u.rlike(r"^https?://")), "broken": n(lambda u: u.rlike(r"^\s*$|[<>\"]|\s")),
        "code": n(lambda u: u.rlike(r"(?i)github|gitlab|/api/")), "glossary": n(lambda u: u.rlike(r"(?i)glossary|definition")), "sections": n(lambda u: u.rlike("^#.")),
    }


def text_blocks(text: str | None) -> list[str]:
    """Blocks of at least five words that are neither code nor headers (QE4)."""
    blocks = [b.strip() for b in (text or "").split("\n\n")]
    return [b for b in blocks if len(b.split()) >= 5 and not b.startswith(("```", "#"))]


def _common(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence, one bit for each of the ``size`` characters whose ``places`` are given."""
    every = (1 << size) - 1
    left = every
    for c in other:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & every
    return size - left.bit_count()


def similar_pairs(blocks: list[str], least: float = 0.8) -> int:
    """How many pairs have a SequenceMatcher ratio of ``least`` or more."""
    return sum(1 for _ in similar_places(blocks, least))


def similar_places(blocks: list[str], least: float = 0.8) -> Iterator[tuple[int, int]]:
    """The pairs with a SequenceMatcher ratio of ``least`` or more, by their places.

    The matches of a ratio are a common subsequence, so that characters in common (counted in 256 classes) and the
    longest common subsequence bound it from above: no pair is passed over, few are left to compare.
    """
    if len(blocks) < 2:
        return
    sizes = np.array([len(b) for b in blocks])
    counts = np.array([np.bincount(np.frombuffer(b.encode("utf-32-le", "replace"), np.uint32) % 256, minlength=256) for b in blocks])
    for j in range(1, len(blocks)):
        later = blocks[j]
        both = sizes[:j] + sizes[j]
        near = np.nonzero(2.0 * np.minimum(sizes[:j], sizes[j]) / both >= least)[0]
        near = near[2.0 * np.minimum(counts[near], counts[j]).sum(1) / both[near] >= least]
        places: dict[str, int] = {}
        for i in near.tolist():
            earlier = blocks[i]
            if earlier == later:
                yield i, j
                continue
            if not places:
                for k, c in enumerate(later):
                    places[c] = places.get(c, 0) | 1 << k
            if 2.0 * _common(places, len(later), earlier) / (len(later) + len(earlier)) >= least:
                if SequenceMatcher(None, earlier, later).ratio() >= least:
                    yield i, j


def duplicate_blocks(text: Column) -> Column:
    """QE4: ``blocks`` of a text and ``pairs`` of them with a similarity of at least 0.8."""

    @F.pandas_udf("struct<blocks: int, pairs: int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [text_blocks(t) for t in batch]
            yield pd.DataFrame({"blocks": pd.Series([len(x) for x in own], dtype="int32"), "pairs": pd.Series([similar_pairs(x) for x in own], dtype="int32")})

    return count(text)


def semantic_sections(text: str | None) -> list[str]:
    """QE1: text between headers, its paragraphs packed under 300 characters; those of ten words or more."""
    out: list[str] = []
    for part in re.split(r"(?m)^#+\s+.+$", text or ""):
        held = ""
        for p in filter(None, (p.strip() for p in part.split("\n\n"))):
            if len(held) + len(p) < 300:
                held = f"{held}\n\n{p}" if held else p
            else:
                out += [held] if held else []
                held = p
        out += [held] if held else []
    return [c for c in out if len(c.split()) >= 10]


def section_counts(text: Column) -> Column:
    """``sections, chars`` of QE1."""

    @F.pandas_udf("struct<sections: int, chars: int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [semantic_sections(t) for t in batch]
            yield pd.DataFrame({"sections": pd.Series([len(x) for x in own], dtype="int32"), "chars": pd.Series([sum(map(len, x)) for x in own], dtype="int32")})

    return count(text)


#: Words that tell where a duplicate comes from; kinds may overlap (fixed values).
DUPLICATE_KINDS = {
    "navigation": ["menu", "navigation", "nav", "home", "back", "next", "previous"],
    "frame": ["footer", "header", "copyright", "©", "all rights reserved"],
    "sidebar": ["sidebar", "table of contents", "toc", "on this page"],
}


def duplicate_kinds(text: Column) -> Column:
    """QE5: ``pairs`` of similar blocks, and how many come from navigation, frame (header and footer) or a sidebar; ``content``: the rest, which is negative where kinds overlap."""

    @F.pandas_udf("struct<pairs: int, navigation: int, frame: int, sidebar: int, content: int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                blocks = text_blocks(t)
                found = [f"{blocks[i]} {blocks[j]}".lower() for i, j in similar_places(blocks)]
                own = [sum(any(w in both for w in words) for both in found) for words in DUPLICATE_KINDS.values()]
                out.append((len(found), *own, len(found) - sum(own)))
            yield pd.DataFrame(out, columns=["pairs", *DUPLICATE_KINDS, "content"]).astype("int32")

    return count(text)


def combined_score(base: Column, validation: Column, duplication: Column, links: Column) -> Column:
    """QE6: weighted mean of the parts that are there: 0.4, 0.2, 0.1 (less duplication) and 0.15."""
    parts = [(base, 0.4), (validation, 0.2), (F.when(duplication.isNotNull(), F.greatest(L(0.0), 1.0 - duplication)), 0.1), (links, 0.15)]
    top, weight = L(0.0), L(0.0)
    for value, w in parts:
        top = top + F.coalesce(value * w, L(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.round(F.coalesce(F.try_divide(top, weight), L(0.0)), 6)


def improvement(score: Column) -> Column:
    """QE7: how far a score lies above 0.6, as a share of what is left."""
    return F.round(F.greatest(L(0.0), (score - 0.6) / 0.4), 8)


#: AG18: names of similarities, from which on; changes of a score by more than 0.1 (fixed values).
SIMILARITY_BANDS = [(0.95, "excellent"), (0.9, "good"), (0.8, "fair")]


def similarity_band(similarity: Column) -> Column:
    out = None
    for limit, name in SIMILARITY_BANDS:
        out = F.when(similarity >= limit, name) if out is None else out.when(similarity >= limit, name)
    return out.otherwise("poor")


def change_band(difference: Column) -> Column:
    return F.when(difference > 0.1, "improved").when(difference < -0.1, "degraded").otherwise("stable")


def regression_summary(compared: DataFrame, similarity: str = "similarity") -> DataFrame:
    """AG18: rows by band of similarity, with how many pass."""
    band = F.when(F.col(similarity) >= 0.95, "same").when(F.col(similarity) >= 0.8, "close").when(F.col(similarity) >= 0.5, "changed").otherwise("other")
    return compared.groupBy(band.alias("band")).agg(F.count(L(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg(similarity), 6).alias("avg_similarity"))


def entropy_of_bins(df: DataFrame, group: str, value: str) -> DataFrame:
    """Entropy in bits of a value's three bins (up to 0.3, to 0.6, above) per group; nulls in no bin. AG22 is that of pairs: ``pair_statistics``."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(group, F.when(F.col(value) <= 0.3, 0).when(F.col(value) <= 0.6, 1).otherwise(2).alias("_b")).agg(F.count(L(1)).alias("_n"))
    total = bins.groupBy(group).agg(F.sum("_n").alias("_t"), F.collect_list("_n").alias("_ns"))
    return total.select(group, F.round(F.aggregate("_ns", L(0.0), lambda a, n: a - (n / F.col("_t")) * F.log2(n / F.col("_t"))), 6).alias("entropy"))


def pair_statistics(df: DataFrame, group: str, order: str, vector: str, block: int = 1024) -> DataFrame:
    """QE2, AG22, AG23: the cosines of all pairs of a group's vectors.

    ``n, avg, min, max, variance`` of the pairs, ``entropy`` in bits of their bins (up to 0.3, to 0.7, above), and
    ``topics``: vectors to which no earlier one has a cosine over 0.5. Vectors of length 0 have a cosine of 0. A group of
    one vector has no pairs: null statistics, no entropy, one topic. Null groups and null vectors are left out.

    Vectors are compared in blocks of ``block`` against ``block``, so no task holds a group; the work grows with the
    square of a group.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(vector).cast("array<double>").alias("_v"))
    placed = rows.withColumn("_i", F.row_number().over(W.partitionBy("_g").orderBy("_o")) - 1)
    packed = placed.groupBy("_g", F.floor(F.col("_i") / block).cast("int").alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_m"))
    left = packed.select("_g", F.col("_b").alias("_a"), F.col("_m").alias("_l"))
    both = packed.join(left, "_g").filter("_a <= _b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(rows: object) -> np.ndarray:
            m = np.stack([np.asarray(r, float) for r in rows])
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(size == 0, 1.0, size)

        for batch in batches:
            out = []
            for g, a, b, earlier, later in zip(batch["_g"], batch["_a"], batch["_b"], batch["_l"], batch["_m"]):
                cosines = unit(later) @ unit(earlier).T
                held = np.tri(*cosines.shape, -1, dtype=bool) if a == b else np.ones(cosines.shape, bool)
                near = np.nonzero(((cosines > 0.5) & held).any(1))[0].astype(np.int32)
                c = cosines[held]
                bins = [int((c <= 0.3).sum()), int(((c > 0.3) & (c <= 0.7)).sum()), int((c > 0.7).sum())]
                mean = float(c.mean()) if len(c) else 0.0
                out.append((g, b, len(later), len(c), mean, float(((c - mean) ** 2).sum()), float(c.min()) if len(c) else None, float(c.max()) if len(c) else None, *bins, near))
            yield pd.DataFrame(out, columns=["_g", "_b", "_n", "_k", "_mean", "_ss", "_lo", "_hi", "_x", "_y", "_z", "_near"])

    kind = dict(rows.dtypes)["_g"]
    parts = both.mapInPandas(compare, f"_g {kind}, _b int, _n long, _k long, _mean double, _ss double, _lo double, _hi double, _x long, _y long, _z long, _near array<int>")
    per_block = parts.groupBy("_g", "_b").agg(
        F.max("_n").alias("_n"), F.size(F.array_distinct(F.flatten(F.collect_list("_near")))).alias("_old"), F.collect_list(F.struct("_k", "_mean", "_ss")).alias("_p"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(c).alias(c) for c in ("_x", "_y", "_z")],
    )
    total = per_block.groupBy("_g").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") - F.col("_old")).alias("topics"), F.flatten(F.collect_list("_p")).alias("_p"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        *[F.sum(c).alias(c) for c in ("_x", "_y", "_z")],
    )
    add = lambda f: F.aggregate("_p", L(0.0), lambda s, p: s + f(p))
    k = F.col("_x") + F.col("_y") + F.col("_z")
    total = total.withColumn("_k", k).withColumn("_avg", F.try_divide(add(lambda p: p["_k"] * p["_mean"]), F.col("_k")))
    # The spread within the parts and that of their means.
    total = total.withColumn("_var", F.try_divide(add(lambda p: p["_ss"] + p["_k"] * (p["_mean"] - F.col("_avg")) * (p["_mean"] - F.col("_avg"))), F.col("_k")))
    share = lambda c: F.when(F.col(c) > 0, -(F.col(c) / F.col("_k")) * F.log2(F.col(c) / F.col("_k"))).otherwise(0.0)
    return total.select(
        F.col("_g").alias(group), "n", F.round("_avg", 6).alias("avg"), F.round("_lo", 6).alias("min"), F.round("_hi", 6).alias("max"), F.round("_var", 6).alias("variance"),
        F.round(share("_x") + share("_y") + share("_z"), 6).alias("entropy"), "topics",
    )
