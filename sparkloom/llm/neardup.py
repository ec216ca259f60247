"""Problem 4: near-duplicate records by SuperMinHash signatures, banding, verification and union-find grouping.

SuperMinHash gives each element a random permutation of the signature's slots and, at step j, offers the slot of rank
j a value in [j, j + 1). A signature is finished as soon as every slot holds a value below the next step, so long
texts need few steps; the steps run over all texts of a batch at once.

Exact copies are collapsed before the signatures: one representative per distinct word sequence goes on. A banded
signature only proposes pairs; each is checked on its distinct shingles. Pairs are expanded to copies afterwards,
see :func:`near_pairs`. A band of more than ``HOT`` texts (a template on a million pages) is not joined with itself: it is
cut into blocks of ``BLOCK``, block meets block in tasks of their own, and of their pairs only those go on whose
signatures agree in as many slots as a similar pair's do, less ``SLACK``.

Null texts and texts under ``min_words`` words take no part. Repeated rows (same key and text) count once. Shuffled are
bands (16 bytes each) and, for proposed pairs, shingle hashes; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
SLOTS, ROWS_PER_BAND = 128, 4
#: Texts of a band from which it is cut into blocks, texts of a block, and how far the share of equal slots may lie under the threshold (five standard deviations).
HOT, BLOCK, SLACK = 512, 1024, 0.22
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_WORDS = _WordHash()


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mix(h + words[k : k + n] + _GOLDEN)
    return h


def superminhash(elements: np.ndarray, owner: np.ndarray, owners: int, slots: int = SLOTS) -> np.ndarray:
    """The signatures of ``owners`` sets at once; ``owner`` says whose each element is. An empty set stays at infinity."""
    sig = np.full(owners * slots, np.inf, np.float64)
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
    todo = np.arange(len(elements))
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(todo):
                break
            rnd = mix(elements[todo] + np.uint64(j + 1) * _GOLDEN)
            k = j + ((rnd & np.uint64(0xFFFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
            slot = perm[todo, k].astype(np.int64)
            perm[todo, k] = perm[todo, j]
            value = j + (rnd >> np.uint64(32)).astype(np.float64) / 4294967296.0
            np.minimum.at(sig, owner[todo] * slots + slot, value)
            open_ = sig.reshape(owners, slots).max(axis=1) >= j + 1
            todo = todo[open_[owner[todo]]]
    return sig.reshape(owners, slots)


def bands_of(sig: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit hash per band and signature; the band's number is part of it."""
    raw = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, rows)
    h = np.zeros(raw.shape[:2], np.uint64) + np.arange(raw.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix(h + raw[:, :, k] + _GOLDEN)
    return h.view(np.int64)


def _signed(df: DataFrame, key: str, text: str, kind: str, width: int, min_words: int, slots: int, rows: int) -> DataFrame:
    """``_key, _c1, _c2, _bands, _sketch`` of the rows with enough words; rows of equal words share the class (_c1, _c2). ``_sketch``: a byte of each slot."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                words = [word_hashes(t) for t in batch["_text"].iloc[at : at + 256]]
                keep = [i for i, w in enumerate(words) if len(w) >= max(min_words, width)]
                if not keep:
                    continue
                sets = [shingle_hashes(words[i], width) for i in keep]
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                sig = superminhash(np.concatenate(sets), owner, len(sets), slots)
                whole = [xxhash.xxh128_digest(words[i].tobytes()) for i in keep]
                yield pd.DataFrame(
                    {
                        "_key": batch["_key"].iloc[at : at + 256].to_numpy()[keep],
                        "_c1": [int.from_bytes(x[:8], "little", signed=True) for x in whole],
                        "_c2": [int.from_bytes(x[8:], "little", signed=True) for x in whole],
                        "_bands": list(bands_of(sig, rows)),
                        "_sketch": [x.tobytes() for x in (mix(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)],
                    }
                )

    rows_ = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows_.mapInPandas(sign, f"_key {kind}, _c1 long, _c2 long, _bands array<long>, _sketch binary")


def near_pairs(
    df: DataFrame, key: str = "id", text: str = "content", width: int = 5, threshold: float = 0.8, min_words: int = 30,
    slots: int = SLOTS, rows: int = ROWS_PER_BAND, expand_limit: int = 32,
) -> DataFrame:
    """``<key>_a, <key>_b, similarity`` with a < b: pairs of rows whose shingle sets are similar enough.

    Between classes of copies one pair of representatives (their smallest keys) is compared. It is then stated for all
    members of classes of at most ``expand_limit`` rows and for the representative of a larger class; within a larger
    class every copy is paired with its representative. So no link between different texts is lost, and a class of a
    third of all rows costs a row per copy.
    """
    kind = dict(df.dtypes)[key]
    signed = cut_lineage(_signed(df, key, text, kind, width, min_words, slots, rows))
    classes = signed.select("_key", "_c1", "_c2").distinct()
    sizes = classes.groupBy("_c1", "_c2").agg(F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    copied = sizes.filter("_n > 1")
    members = cut_lineage(classes.join(copied, ["_c1", "_c2"]).select("_rep", "_key", "_n"))
    later = members.filter(F.col("_key") != F.col("_rep")).select("_key")
    # Every row is a representative unless it is a later copy.
    bands = signed.join(later, "_key", "left_anti").select(F.col("_key").alias("_rep"), F.explode("_bands").alias("_band"))
    texts = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_rep"), F.col(text).alias("_text"))
    met = bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    busy = cut_lineage(bands.join(met, "_band"))
    cold = busy.filter(F.col("_m") <= HOT).select("_rep", "_band")
    a, b = cold.withColumnRenamed("_rep", "_a"), cold.withColumnRenamed("_rep", "_b")
    proposed = a.join(b, "_band").filter("_a < _b").select("_a", "_b")
    sketches = signed.select(F.col("_key").alias("_rep"), "_sketch")
    hot = busy.filter(F.col("_m") > HOT).join(sketches, "_rep")
    proposed = proposed.unionByName(_hot_pairs(hot, kind, threshold - SLACK)).distinct()
    links = _verified(proposed, texts, kind, width, threshold)
    return _expanded(links, members, key, expand_limit)


def _hot_pairs(hot: DataFrame, kind: str, least: float) -> DataFrame:
    """``_a, _b`` of the pairs in bands (``_rep, _band, _m, _sketch``) whose sketches have a share of ``least`` equal bytes."""
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    own = hot.withColumn("_x", F.pmod(F.xxhash64(F.lit("block"), "_rep"), blocks).cast("int"))
    # A row goes to every pair of blocks that its own is part of.
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    sent = own.select("_rep", "_band", "_sketch", "_x", other.alias("_y")).select("_rep", "_band", "_sketch", "_x", F.least("_x", "_y").alias("_lo"), F.greatest("_x", "_y").alias("_hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        left, right = pdf[pdf["_x"] == lo], pdf[pdf["_x"] == hi]
        one, two = (np.frombuffer(b"".join(p["_sketch"]), np.uint8).reshape(len(p), -1) for p in (left, right))
        keys, others, out = left["_rep"].to_numpy(), right["_rep"].to_numpy(), []
        for i in range(len(one)):
            near = np.nonzero((two == one[i]).mean(1) >= least)[0]
            a, b = np.minimum(keys[i], others[near]), np.maximum(keys[i], others[near])
            differ = a != b
            out.append(pd.DataFrame({"_a": a[differ], "_b": b[differ]}))
        return pd.concat(out) if out else pd.DataFrame({"_a": [], "_b": []})

    return sent.groupBy("_band", "_lo", "_hi").applyInPandas(compare, f"_a {kind}, _b {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, kind: str, width: int, threshold: float) -> DataFrame:
    pairs = cut_lineage(pairs)
    needed = pairs.select(F.col("_a").alias("_rep")).union(pairs.select(F.col("_b").alias("_rep"))).distinct()

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t), width)).view(np.int64) for t in batch["_text"]]
            yield pd.DataFrame({"_rep": batch["_rep"], "_set": sets})

    sets = texts.join(needed, "_rep", "left_semi").mapInPandas(shingle, f"_rep {kind}, _set array<long>")
    joined = pairs.join(sets.select(F.col("_rep").alias("_a"), F.col("_set").alias("_sa")), "_a")
    joined = joined.join(sets.select(F.col("_rep").alias("_b"), F.col("_set").alias("_sb")), "_b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    similarity = common / F.greatest(F.size("_sa") + F.size("_sb") - common, F.lit(1))
    return joined.select("_a", "_b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold).groupBy("_a", "_b").agg(F.max("similarity").alias("similarity"))


def _expanded(links: DataFrame, members: DataFrame, key: str, expand_limit: int) -> DataFrame:
    small = members.filter(F.col("_n") <= expand_limit).select("_rep", "_key")

    def side(name: str) -> DataFrame:
        return small.select(F.col("_rep").alias(name), F.col("_key").alias(f"{name}k"))

    wide = links.join(side("_a"), "_a", "left").join(side("_b"), "_b", "left")
    x, y = F.coalesce("_ak", "_a"), F.coalesce("_bk", "_b")
    across = wide.select(F.least(x, y).alias(f"{key}_a"), F.greatest(x, y).alias(f"{key}_b"), "similarity")
    star = members.filter(F.col("_n") > expand_limit).filter(F.col("_key") != F.col("_rep"))
    star = star.select(F.col("_rep").alias(f"{key}_a"), F.col("_key").alias(f"{key}_b"), F.lit(1.0).alias("similarity"))
    one, two = small.withColumnRenamed("_key", f"{key}_a"), small.withColumnRenamed("_key", f"{key}_b")
    within = one.join(two, "_rep").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b", F.lit(1.0).alias("similarity"))
    return across.unionByName(star).unionByName(within)


def groups(pairs: DataFrame, a: str, b: str, out: str = "group_id", rounds: int = 40) -> DataFrame:
    """``member, <out>``: the smallest member reachable over the pairs, for all that stand in a pair.

    Union-find over DataFrames: each round hooks every root to the smallest root among its neighbours and then halves
    the paths, so the rounds grow with the logarithm of the longest chain. Only changed edges go on.
    """
    edges = pairs.select(F.col(a).alias("_u"), F.col(b).alias("_v"))
    edges = cut_lineage(edges.union(edges.select("_v", "_u")).distinct())
    label = edges.groupBy("_u").agg(F.least(F.min("_v"), F.first("_u")).alias("_l"))
    for _ in range(rounds):
        label = cut_lineage(label)
        near = edges.join(label.select(F.col("_u").alias("_v"), F.col("_l").alias("_lv")), "_v").groupBy("_u").agg(F.min("_lv").alias("_m"))
        hooked = label.join(near, "_u").select("_u", "_l", F.least("_l", "_m").alias("_m"))
        # The root that a member leaves is hooked as well, or chains would only shrink by one member a round.
        roots = hooked.groupBy(F.col("_l").alias("_u")).agg(F.min("_m").alias("_rm"))
        new = hooked.join(roots, "_u", "left").select("_u", F.least("_m", F.coalesce("_rm", "_m")).alias("_n"), "_l")
        jump = new.select(F.col("_u").alias("_n"), F.col("_n").alias("_nn"))
        new = cut_lineage(new.join(jump, "_n", "left").select("_u", F.least("_n", F.coalesce("_nn", "_n")).alias("_n"), "_l"))
        done = new.filter("_n < _l").isEmpty()
        label = new.select("_u", F.col("_n").alias("_l"))
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return label.select(F.col("_u").alias("member"), F.col("_l").alias(out))
