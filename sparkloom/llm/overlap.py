"""Problem 9: passages of held-out items inside a corpus.

Words are runs of letters and digits in lower case. Every window of ``run`` words of an item is represented by the one
of its ``seed`` -grams that is rarest in the corpus, so a document holding the window holds that seed: rare n-gram
seeds lose no passage of ``run`` words, and common phrases start no alignment. Documents are joined with items on the
hash of the seed and aligned by Smith-Waterman over words around the seeds they share; a passage of ``run`` words scores
at least twice ``run``, edited and paraphrased copies less of the item's own score. The longest exact run is taken from
the same stretches.

The corpus is read once for any number of items: a bitmap of their seeds' hashes, of at most ``BITS`` bits, goes to the
workers, and only seeds that it knows leave the scan; what it lets through by chance falls out in the join. Texts are
read again for the documents of a pair alone: pairs are broadcast with their items' texts up to ``SENT_PAIRS`` and joined
beyond.

Null and empty texts hold nothing. Items of fewer than ``run`` words, and null keys, are never reported. Repeated rows
are reported once per key, with the best of their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.neardup import shingle_hashes, word_hashes
from sparkloom.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
#: Largest bitmap of seeds, in bits (16 MB), and bits for each seed below it; pairs of keys that are broadcast.
BITS, BITS_A_SEED, SENT_PAIRS = 1 << 27, 32, 50_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def seeds_of(text: str, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``seed`` words, in order."""
    return shingle_hashes(word_hashes(text), seed).view(np.int64)


def align(a: list, b: list, match: int = 2, miss: int = -1, gap: int = -1) -> int:
    """The Smith-Waterman score of two word sequences, one row of the table at a time.

    Gaps along the row are resolved with a running maximum, so a row is a few vector operations.
    """
    if not a or not b:
        return 0
    number: dict = {}
    x = np.array([number.setdefault(w, len(number)) for w in a])
    y = np.array([number.setdefault(w, len(number)) for w in b])
    steps = np.arange(len(y) + 1) * -gap
    row, best = np.zeros(len(y) + 1, np.int64), 0
    for w in x:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(y == w, match, miss), row[1:] + gap)
        new = np.maximum(new, 0)
        new = np.maximum.accumulate(new + steps) - steps
        row, best = new, max(best, int(new.max()))
    return best


def longest_run(a: list, b: list) -> int:
    """The most consecutive words that stand in both in the same order."""
    number: dict = {}
    x = np.array([number.setdefault(w, len(number)) for w in a], np.int64)
    y = np.array([number.setdefault(w, len(number)) for w in b], np.int64)
    if not len(x) or not len(y):
        return 0
    row, best = np.zeros(len(y) + 1, np.int64), 0
    for w in x:
        new = np.zeros_like(row)
        new[1:] = np.where(y == w, row[:-1] + 1, 0)
        row, best = new, max(best, int(new.max()))
    return best


def stretches(own: np.ndarray, hits: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Where a document (seeds ``own``) may hold an item (seeds ``hits``, ``width`` words): twice its words around each shared seed, joined where they meet."""
    out: list[tuple[int, int]] = []
    for at in np.nonzero(np.isin(own, hits))[0]:
        lo, hi = max(0, int(at) - 2 * width), int(at) + 3 * width
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ``_seed``; its size goes with their number, up to ``BITS``."""
    n = max(1, seeds.count())
    bits = min(BITS, 1 << int(np.ceil(np.log2(n * BITS_A_SEED))))
    place = F.col("_seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.groupBy(F.shiftrightunsigned(place, 5).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_seed & 31 AS INT))")).alias("w")).toPandas()
    out = np.zeros(max(1, bits // 32), np.uint32)
    out[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64).astype(np.uint32)
    return out


def _item_seeds(items: DataFrame, kind: str, run: int, seed: int) -> DataFrame:
    """``_item, _at, _seed``: the seeds of every window of ``run`` words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"_item": [], "_at": [], "_seed": []}
            for item, text in zip(batch["_item"], batch["_text"]):
                h = seeds_of(text, seed)
                inside = run - seed + 1
                for at in range(len(h) - inside + 1):
                    out["_item"] += [item] * inside
                    out["_at"] += [at] * inside
                    out["_seed"] += h[at : at + inside].tolist()
            yield pd.DataFrame(out)

    return items.mapInPandas(cut, f"_item {kind}, _at int, _seed long")


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    run: int = 13, seed: int = 6,
) -> DataFrame:
    """``key, item, run_words, score, share``: documents and the items of which they hold a window's seed.

    ``score``: Smith-Waterman (2 for a word, -1 for a change or gap); ``share``: the score against that of the whole item;
    ``run_words``: the longest exact run.
    """
    kinds, kind = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    held = items.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).distinct()
    windows = cut_lineage(_item_seeds(held, kind, run, seed))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(windows.select("_seed").distinct()))
    texts = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        last = len(bits) * 32 - 1
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch["_key"], batch["_text"]):
                h = seeds_of(t, seed)
                if len(h):
                    place = h & last
                    met = np.unique(h[(bits[place >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1])
                    keys += [k] * len(met)
                    found += met.tolist()
            yield pd.DataFrame({"_key": pd.Series(keys, dtype=batch["_key"].dtype), "_seed": pd.Series(found, dtype="int64")})

    # Only seeds that an item has go on; how many documents hold one decides which seed stands for a window.
    met = cut_lineage(texts.mapInPandas(scan, f"_key {kinds}, _seed long").join(windows.select("_seed").distinct(), "_seed", "left_semi").distinct())
    frequency = met.groupBy("_seed").agg(F.count(F.lit(1)).alias("_df"))
    # Seeds that stand in no document are passed over: a window that a document holds has none, an edited one may.
    rare = windows.join(frequency, "_seed").groupBy("_item", "_at").agg(F.min(F.struct("_df", "_seed"))["_seed"].alias("_seed")).select("_item", "_seed").distinct()
    pairs = cut_lineage(met.join(rare, "_seed").select("_key", "_item").distinct())
    return _judged(pairs, texts, held, kinds, kind, key, item, seed)


def _judged(pairs: DataFrame, texts: DataFrame, held: DataFrame, kinds: str, kind: str, key: str, item: str, seed: int) -> DataFrame:
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, i, t, own in zip(batch["_key"], batch["_item"], batch["_text"], batch["_own"]):
                a, b = words_of(own), words_of(t)
                near = stretches(seeds_of(t, seed), seeds_of(own, seed), len(a))
                score, longest = max((align(a, b[lo:hi]) for lo, hi in near), default=0), max((longest_run(a, b[lo:hi]) for lo, hi in near), default=0)
                out.append((k, i, longest, score, score / (2.0 * max(1, len(a)))))
            yield pd.DataFrame(out, columns=[key, item, "run_words", "score", "share"])

    owns = held.withColumnRenamed("_text", "_own").join(pairs.select("_item").distinct(), "_item", "left_semi")
    wide = pairs.join(owns, "_item")
    # With few pairs the texts stay where they are.
    joined = texts.join(F.broadcast(wide) if pairs.count() <= SENT_PAIRS else wide, "_key")
    judged = joined.select("_key", "_item", "_text", "_own").mapInPandas(judge, f"{key} {kinds}, {item} {kind}, run_words int, score int, share double")
    # A key may have several texts: the best of them counts.
    return judged.groupBy(key, item).agg(F.max("run_words").alias("run_words"), F.max("score").alias("score"), F.max("share").alias("share"))
