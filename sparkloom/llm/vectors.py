"""Problem 3: the most similar vectors of every vector, by additive quantisation.

A vector is written as a sum of codewords from full-dimensional codebooks, each trained on what the ones before leave
(the residual). Encoding is a beam search: after each book the ``BEAM`` best sums go on. The first two words of a sum
name its cell; their number grows with the collection so that a cell keeps about ``CELL`` vectors. A vector is stored
in the cell of its best sum and looks into the cells of all sums in its beam, so a query costs the same at any size.

Inside a cell codes are scored by a lookup table: for a query the inner products of its own sum with all codewords
are read from their table, and the score of a stored vector is the sum over its words, divided by the stored norms.
What scores well is compared exactly on the full vectors.

Shuffled are codes and norms (about 40 bytes per probe), and full vectors for proposed pairs only. Cells of any size
are cut into blocks of ``BLOCK`` stored vectors and ``BLOCK`` queries, one task group each. Copies (equal vectors) are
collapsed before the search and come back as members of their representative.

The books are trained on the driver on about ``TRAIN`` vectors chosen by the hash of their key; all vectors are indexed.
Vectors that are null, of another length, zero, or hold a NaN or an infinity take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import sampling
from sparkloom.session import cut_lineage

TRAIN, BEAM, CELL, BLOCK, BOOKS, WORDS = 12_000, 12, 24, 2048, 10, 64
#: Width of the beam after the cell is chosen; pairs that a query keeps of a block, by estimate, before they are compared exactly.
REFINE, KEEP = 3, 64


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part; never null."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = (F.size(vector) == dim) & F.forall(vector, real) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


@dataclass
class Books:
    """Codebooks; ``words[m]`` has a row per codeword. ``table[i, j]``: inner products of all codewords, by their places."""

    words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.start = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        self.flat = np.concatenate(self.words)
        self.norms = [(w * w).sum(1) for w in self.words]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best sum's codes (n, books), the beam's first two codes (n, beam, 2), and the norm of the best sum."""
        n = len(x)
        codes, sums, error = np.zeros((n, 1, 0), np.int32), np.zeros((n, 1, x.shape[1]), np.float32), np.zeros((n, 1), np.float32)
        cells = None
        for m, book in enumerate(self.words):
            b = codes.shape[1]
            rest = x[:, None, :] - sums
            cost = error[:, :, None] + self.norms[m] - 2 * (rest.reshape(n * b, -1) @ book.T).reshape(n, b, -1)
            flat = cost.reshape(n, -1)
            keep = min(beam if m < 2 else REFINE, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost_ = np.take_along_axis(flat, best, 1)
            order = np.argsort(cost_, axis=1, kind="stable")
            best, error = np.take_along_axis(best, order, 1), np.take_along_axis(cost_, order, 1)
            of, word = best // len(book), best % len(book)
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
            sums = np.take_along_axis(sums, of[:, :, None], 1) + book[word]
            if m == 1:
                cells = codes.copy()
        return codes[:, 0], cells, np.linalg.norm(sums[:, 0], axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = (((centres * centres).sum(1)) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.nonzero(count)[0]
        sums = np.zeros_like(centres)
        sums[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[filled])[:-1]]))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres.astype(np.float32)


def train(sample: np.ndarray, total: int, books: int = BOOKS, words: int = WORDS, cell: int = CELL) -> Books:
    """Codebooks for a collection of ``total`` unit vectors; the first two have about sqrt(total / cell) words."""
    rng = np.random.default_rng(7)
    first = int(np.clip(round((max(total, 1) / cell) ** 0.5), 4, 4096))
    rest, out = sample.astype(np.float32).copy(), []
    for m in range(books):
        book = _kmeans(rest, first if m < 2 else words, rng)
        out.append(book)
        rest = rest - book[((book * book).sum(1) - 2 * rest @ book.T).argmin(1)]
    return Books(out)


def _unit(batch: pd.Series) -> np.ndarray:
    x = np.stack(batch.to_numpy()).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def score_block(books: Books, gram: np.ndarray, q_codes: np.ndarray, q_norm: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Estimated cosines of queries (rows) and stored vectors (columns), by lookup.

    ``gram`` holds the inner products of all codewords: the table of a query is the sum of the rows of its own words.
    """
    lut = gram[q_codes[:, 0]].copy()
    for m in range(1, q_codes.shape[1]):
        lut += gram[q_codes[:, m]]
    score = lut[:, codes[:, 0]]
    for m in range(1, codes.shape[1]):
        score += lut[:, codes[:, m]]
    return score / np.maximum(q_norm[:, None] * norm[None, :], 1e-9)


def propose(vectors: DataFrame, kind: str, least: float, keep: int | None, queries: Column | None = None) -> DataFrame:
    """``_q, _x``: pairs of representatives (``_key, _vec``) whose estimated cosine is at least ``least``.

    With ``keep``, also at most so many best of a block for each query; None keeps all.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    sample = sampling.by_hash(vectors, F.col("_key"), TRAIN, total).toPandas().sort_values("_key")["_vec"]
    if not len(sample):
        return spark.createDataFrame([], f"_q {kind}, _x {kind}")
    books = train(_unit(sample), total)
    shared = spark.sparkContext.broadcast(books.words)
    side = len(books.words[0])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Books(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                codes, beams, norm = own.encode(_unit(part["_vec"]))
                cell = (beams[:, :, 0] * side + beams[:, :, 1]).astype(np.int64)
                home = (codes[:, 0] * side + codes[:, 1]).astype(np.int64)
                flat = (codes + own.start[:-1]).astype(np.uint16)
                yield pd.DataFrame({"_key": part["_key"].to_numpy(), "_asks": part["_asks"].to_numpy(), "_home": home, "_cells": list(cell), "_norm": norm.astype(np.float32), "_codes": [c.tobytes() for c in flat]})

    asked = vectors.withColumn("_asks", queries if queries is not None else F.lit(True))
    coded = cut_lineage(asked.mapInPandas(encode, f"_key {kind}, _asks boolean, _home long, _cells array<long>, _norm float, _codes binary"))
    blocks = coded.groupBy("_home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    place = lambda salt: F.abs(F.xxhash64(F.lit(salt), "_key")) % F.col("_blocks")
    stored = coded.join(blocks, "_home").select(F.col("_home").alias("_cell"), place(1).alias("_xb"), F.col("_key"), "_norm", "_codes", F.lit(False).alias("_ask"), F.lit(0).cast("long").alias("_qb"), "_blocks")
    probes = coded.filter("_asks").select("_key", "_norm", "_codes", F.explode(F.array_distinct("_cells")).alias("_home"))
    probes = probes.join(blocks, "_home").select(F.col("_home").alias("_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)).alias("_xb"), "_key", "_norm", "_codes", F.lit(True).alias("_ask"), (F.abs(F.xxhash64(F.lit(2), "_key")) % F.col("_blocks")).alias("_qb"), "_blocks")
    # A stored block meets each block of queries: it is repeated once per block of queries of its cell.
    stored = stored.withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1)))
    both = stored.drop("_blocks").unionByName(probes.drop("_blocks"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell and block; a group is scored when the next one begins."""
        own = Books(shared.value)
        gram = (own.flat @ own.flat.T).astype(np.float32)
        state: list[pd.DataFrame] = []
        last = None

        def flush(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
            group = pd.concat(parts) if len(parts) > 1 else parts[0]
            ask = group["_ask"].to_numpy()
            if ask.all() or not ask.any():
                return []
            codes = np.frombuffer(b"".join(group["_codes"]), np.uint16).reshape(len(group), -1).astype(np.int64)
            keys, norm = group["_key"].to_numpy(), group["_norm"].to_numpy()
            out = []
            qs, xs = np.nonzero(ask)[0], np.nonzero(~ask)[0]
            for at in range(0, len(qs), 512):
                q = qs[at : at + 512]
                score = score_block(own, gram, codes[q], norm[q], codes[xs], norm[xs])
                score[keys[q][:, None] == keys[xs][None, :]] = -2
                hit = score >= least
                if keep is not None and len(xs) > keep:
                    bar = np.partition(score, len(xs) - keep, axis=1)[:, len(xs) - keep]
                    hit &= score >= bar[:, None]
                i, j = np.nonzero(hit)
                out.append(pd.DataFrame({"_q": keys[q][i], "_x": keys[xs][j]}))
            return out

        for batch in batches:
            names = batch["_cell"].to_numpy(), batch["_xb"].to_numpy(), batch["_qb"].to_numpy()
            change = np.nonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))[0] + 1
            for lo, hi in zip([0, *change], [*change, len(batch)]):
                if lo == hi:
                    continue
                name = tuple(x[lo] for x in names)
                if name != last and state:
                    yield from flush(state)
                    state = []
                last = name
                state.append(batch.iloc[lo:hi])
        if state:
            yield from flush(state)

    parts = both.repartition("_cell", "_xb", "_qb").sortWithinPartitions("_cell", "_xb", "_qb")
    return parts.mapInPandas(match, f"_q {kind}, _x {kind}")


def collapse(df: DataFrame, key: str, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """``_key, _vec`` of one representative (the smallest key) per distinct usable vector, and ``_rep, _member``."""
    rows = df.filter(usable(F.col(vector), dim) & F.col(key).isNotNull()).select(F.col(key).alias("_member"), F.col(vector).cast("array<float>").alias("_vec"))
    own = cut_lineage(rows.select("_member", F.xxhash64("_vec").alias("_h1"), F.xxhash64(F.lit("second"), "_vec").alias("_h2")).distinct())
    reps = own.groupBy("_h1", "_h2").agg(F.min("_member").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    members = own.join(reps.filter("_n > 1"), ["_h1", "_h2"]).select("_rep", "_member")
    later = members.filter("_member <> _rep").select("_member")
    return rows.join(later, "_member", "left_anti").dropDuplicates(["_member"]).select(F.col("_member").alias("_key"), "_vec"), members


def exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (``_a, _b``) with ``cosine`` on the full vectors, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = vectors.select(F.col("_key").alias("_a"), F.col("_vec").alias("_va")), vectors.select(F.col("_key").alias("_b"), F.col("_vec").alias("_vb"))
    joined = pairs.join(a, "_a").join(b, "_b")
    return joined.select("_a", "_b", (dot("_va", "_vb") / F.sqrt(dot("_va", "_va") * dot("_vb", "_vb"))).alias("cosine"))


def _ranked(near: DataFrame, reps: DataFrame, members: DataFrame, key: str, k: int, queries: Column | None) -> DataFrame:
    """Directed neighbours of representatives, carried over to all members."""
    few = members.withColumn("_r", F.row_number().over(W.partitionBy("_rep").orderBy("_member"))).filter(F.col("_r") <= k + 1).drop("_r")
    wide = near.join(few.select(F.col("_rep").alias("_b"), F.col("_member").alias("_bm")), "_b", "left").select("_a", F.coalesce("_bm", "_b").alias("_n"), "cosine")
    askers = wide.join(members.select(F.col("_rep").alias("_a"), F.col("_member").alias("_am")), "_a", "left").select(F.coalesce("_am", "_a").alias("_key"), "_n", "cosine")
    copies = members.select("_rep", F.col("_member").alias("_key")).join(few.select("_rep", F.col("_member").alias("_n")), "_rep").filter("_key <> _n").select("_key", "_n", F.lit(1.0).alias("cosine"))
    both = askers.unionByName(copies)
    if queries is not None:
        both = both.filter(queries)
    order = W.partitionBy("_key").orderBy(F.desc("cosine"), "_n")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_key").alias(key), F.col("_n").alias("neighbour"), "cosine", "rank")


def similar(df: DataFrame, key: str, vector: str, least: float = 0.9, k: int = 5, dim: int = 64, slack: float = 0.25) -> DataFrame:
    """``key, neighbour, cosine, rank``: of every usable vector the k most similar others with a cosine of at least ``least``.

    Ties go to the smaller key. ``slack``: how far the estimate of a true pair may lie below ``least``; of what lies above
    it, a query's ``KEEP`` best of each block are compared exactly, so dense cells don't give all their pairs. A true
    neighbour is lost if ``KEEP`` others of its block look nearer by estimate; a test measures the recall in a dense cell.
    """
    kind = dict(df.dtypes)[key]
    reps, members = collapse(df, key, vector, dim)
    reps, members = cut_lineage(reps), cut_lineage(members)
    found = propose(reps, kind, least - slack, KEEP)
    pairs = found.select(F.least("_q", "_x").alias("_a"), F.greatest("_q", "_x").alias("_b")).distinct()
    near = cut_lineage(exact(cut_lineage(pairs), reps).filter(F.col("cosine") >= least))
    directed = near.unionByName(near.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "cosine"))
    return _ranked(directed, reps, members, key, k, None)


def close_pairs(df: DataFrame, key: str, vector: str, **settings: float) -> DataFrame:
    """``key_a, key_b`` (a < b): the pairs of :func:`similar`, each once."""
    ranked = similar(df, key, vector, **settings)
    return ranked.select(F.least(key, "neighbour").alias("key_a"), F.greatest(key, "neighbour").alias("key_b")).distinct()
