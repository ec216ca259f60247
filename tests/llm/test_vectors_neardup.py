"""Problems 3 and 4, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import neardup, vectors


def clustered(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 3, 64))
    x = np.repeat(centres, 3, 0) + rng.normal(size=(n // 3 * 3, 64)) * rng.choice([0.2, 0.35, 0.8], size=(n // 3 * 3, 1))
    return x.astype(np.float32)


def best_pairs(keys, x, least=0.9, k=5):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    out = set()
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-s[i, j], keys[j]))[:k]
        out |= {tuple(sorted((key, keys[j]))) for j in order if s[i, j] >= least}
    return out


def test_close_pairs_against_brute_force(spark):
    x = clustered()
    x = np.concatenate([x, x[:40], x[:1].repeat(30, 0), x[5:6] * 3])
    keys = [f"p{i}" for i in range(len(x))]
    bad = [("b1", None), ("b2", []), ("b3", [0.0] * 64), ("b4", [float("nan")] * 64), ("b5", [1.0] * 63), ("b6", [float("inf")] * 64), ("b7", [None] * 64)]
    rows = [(k, [float(v) for v in r]) for k, r in zip(keys, x)] + bad
    df = spark.createDataFrame(rows, "key string, embedding array<float>").withColumn("cosine", F.lit(0))
    got = {tuple(r) for r in vectors.close_pairs(df, "key", "embedding").collect()}
    want = best_pairs(keys, x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_a_hot_class_of_copies_stays_linear(spark):
    x = [(f"p{i:04d}", [1.0] + [0.5] * 63) for i in range(900)] + [("q", [1.0] * 64)]
    df = spark.createDataFrame(x, "key string, embedding array<float>")
    n = vectors.close_pairs(df, "key", "embedding").count()
    assert 895 * 5 <= n <= 902 * 6


def test_no_vectors(spark):
    df = spark.createDataFrame([("a", None)], "key string, embedding array<float>")
    assert vectors.close_pairs(df, "key", "embedding").count() == 0


def test_lookup_scores_are_those_of_the_sums():
    x = clustered(300)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = vectors.train(x, 300, books=4)
    codes, cells, norm = books.encode(x, 4)
    assert (cells[:, 0] == codes[:, :2]).mean() > 0.6 and cells.shape[1] <= 4
    sums = sum(books.words[m][codes[:, m]] for m in range(4))
    flat = (codes + books.start[:-1]).astype(np.int64)
    score = vectors.score_block(books, books.flat @ books.flat.T, flat[:9], norm[:9], flat, norm)
    want = sums[:9] @ sums.T / (norm[:9, None] * norm[None])
    assert np.allclose(score, want, atol=1e-4) and np.allclose(norm, np.linalg.norm(sums, axis=1), atol=1e-4)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        common = rng.integers(0, 2**63, int(600 * share), dtype=np.uint64)
        rest = [rng.integers(0, 2**63, (600 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.concatenate([common, r]) for r in rest]
        sig = neardup.superminhash(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2, 256)
        assert abs((sig[0] == sig[1]).mean() - share) < 0.1
    one = neardup.superminhash(np.array([7], np.uint64), np.array([0]), 2, 16)
    assert sorted(np.floor(one[0]).tolist()) == list(range(16)) and np.isinf(one[1]).all()


def near_by_hand(rows, width, least, min_words):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= min_words:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited(text, places):
    w = text.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def test_near_pairs_against_brute_force(spark, words):
    rows = []
    for s in range(60):
        base = words(s, 80)
        rows += [(10 * s, base), (10 * s + 1, edited(base, range(s % 12))), (10 * s + 2, base.upper().replace(" ", " , ") if s % 7 == 0 else words(s + 5000, 40))]
    rows += [(9001, None), (9002, ""), (9003, "too short"), (9004, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, content string").withColumn("similarity", F.lit(0))
    for width, least in ((3, 0.6), (5, 0.8)):
        got = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(df, width=width, threshold=least).collect()}
        want = near_by_hand(rows, width, least, 30)
        assert not got - want and len(got) >= 0.98 * len(want)


def test_large_class_of_copies_is_a_star(spark, words):
    text = words(1, 50)
    df = spark.createDataFrame([(i, text) for i in range(100)] + [(500, edited(text, [3]))], "id long, content string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(df, width=3, threshold=0.6).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 500)}
    assert neardup.near_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["member"]: r["group_id"] for r in neardup.groups(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_hot_bands_lose_no_pair(spark, words, monkeypatch):
    """A template on most rows: bands far over the bound, cut into several blocks."""
    base = words(1, 60)
    rows = []
    for i in range(90):
        own = base.split()
        for j in range(i % 7):
            own[(i * 11 + j * 13) % 60] = f"w{i}x{j}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, words(i + 50, 60)) for i in range(10)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "id long, content string").withColumn("_m", F.lit(1))
    want = {tuple(r)[:2] for r in neardup.near_pairs(df, width=3, threshold=0.6).collect()}
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = {tuple(r)[:2] for r in neardup.near_pairs(df, width=3, threshold=0.6).collect()}
    sets = {i: neardup.shingle_hashes(neardup.word_hashes(t), 3) for i, t in rows if t and len(t.split()) >= 30}
    brute = set()
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and both >= 0.6 * len(np.union1d(sets[a], sets[b])):
                brute.add((a, b))
    assert len(brute) > 500 and got <= brute and want <= brute and len(got) >= 0.99 * len(brute) and len(got) >= len(want) - 2


def test_a_dense_cell_keeps_its_nearest(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    x = centre + 0.2 * rng.normal(size=(700, 64))
    df = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)], "key string, embedding array<float>")
    got = {(r["key"], r["neighbour"]) for r in vectors.similar(df, "key", "embedding").collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(f"k{i:03}", f"k{j:03}") for i in range(700) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.9}
    assert len(want) > 3000 and len(want & got) >= 0.9 * len(want)
