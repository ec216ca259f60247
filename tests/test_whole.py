"""What the registered queries leave to others: checked by brute force, not by SQL."""

import difflib
import itertools
import re

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F

from sparkloom.operators import analysis, metadata
from sparkloom.plans import analysis as analysis_plans
from sparkloom.plans import admin, pages
from sparkloom.session import table


def chain(text):
    """MD1 line by line."""
    clean = lambda x: re.sub(r"[#*_`]", "", x).strip()
    lines = [x.strip() for x in (text or "").split("\n")]
    for x in lines:
        if x.startswith("# "):
            return clean(x[2:])
    for x, below in zip(lines, lines[1:] + [""]):
        if x and not x.startswith("#") and below.startswith("=") and clean(x):
            return clean(x)
        if ":" in x and re.search("title|name|subject", x.lower()) and x.split(":", 1)[1].strip():
            return clean(x.split(":", 1)[1])
    for x in lines:
        if len(x) > 5 and not x.startswith(("#", "```", "---")):
            return clean(x)[:50] + ("..." if len(clean(x)) > 50 else "")
    return "Untitled Document"


def test_title_chain(spark):
    cases = [
        ("text here\n# A *b* title\n# C", "A b title"), ("words\n\nThe *Head*\n=====\nmore", "The Head"), ("long enough\nPage name: `x: y`", "x: y"), ("title:\nA short first line", "title:"), ("## Sub\n```py\n---\nshort\n" + "w" * 60, "w" * 50 + "..."), ("abc\n## x", "Untitled Document"),
        ("", "Untitled Document"), (None, "Untitled Document"), (" \t# Indented \n", "Indented"), ("***\n===\nSubject: the rest", "the rest"),
    ]
    df = spark.createDataFrame(cases, "t string, want string").select("t", "want", metadata.title(F.col("t")).alias("got"))
    for t, want, got in df.collect():
        assert got == want == chain(t), t


def test_title_chain_of_the_table(spark):
    texts = {r["id"]: r["content"] for r in table(spark, SMALL, "crawled_pages").select("id", "content").collect()}
    got = pages.md1_title_chain(spark, SMALL).collect()
    assert len(got) >= len(texts) and all(r["title"] == chain(texts[r["id"]]) for r in got)


def test_pairs_of_similar_blocks(spark):
    a, b = "one two three four five six seven", "one two three four five six eight"
    cases = [("\n\n".join([a, a, a]), 3, 3), ("\n\n".join([a, b, "quite other words stand in this block"]), 3, 1), ("```\n" + a + "\n```\n\n```\n" + a + "\n```\n\n# " + a + "\n\nfew words", 0, 0), (None, 0, 0), ("", 0, 0)]
    df = spark.createDataFrame(cases, "t string, blocks int, pairs int")
    assert all(r["d"] == (r["blocks"], r["pairs"]) for r in df.withColumn("d", analysis.duplicate_blocks(F.col("t"))).collect())


def test_pairs_of_similar_blocks_of_the_table(spark):
    texts = {r["id"]: r["content"] or "" for r in table(spark, SMALL, "crawled_pages").select("id", "content").collect()}
    got = {r["id"]: (r["blocks"], r["pairs"]) for r in analysis_plans.qe4_similar_blocks(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:40]:
        own = [x.strip() for x in texts[i].split("\n\n")]
        own = [x for x in own if len(x.split()) >= 5 and x[0] != "#" and x[:3] != "```"]
        assert got[i] == (len(own), sum(difflib.SequenceMatcher(None, x, y).ratio() >= 0.8 for x, y in itertools.combinations(own, 2)))


def test_fanout_of_every_source(spark, tmp_path):
    for name, data, kinds in [("sources", [(1,), (101,), (1386,)], "source_id int"), ("crawled_pages", [(1, 101), (2, 101), (3, None)], "id int, source_id int"), ("code_examples", [(1, 101), (2, 1), (3, 1386)], "id int, source_id int")]:
        spark.createDataFrame(data, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(tuple(r) for r in admin.jn4_all_sources(spark, str(tmp_path)).collect()) == [(1, 0, 1), (101, 2, 1), (1386, 0, 1)]


def pair_numbers(vectors):
    """QE2, AG22 and AG23 pair by pair."""
    c = [[float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1)) for a in vectors[:j]] for j, b in enumerate(vectors)]
    every = [x for row in c for x in row]
    topics = sum(not any(x > 0.5 for x in row) for row in c)
    if not every:
        return None, None, None, None, 0.0, topics
    bins = np.bincount([(x > 0.3) + (x > 0.7) for x in every])
    p = bins[bins > 0] / len(every)
    return np.mean(every), min(every), max(every), np.var(every), float(-(p * np.log2(p)).sum()), topics


def test_pair_statistics(spark):
    r = np.random.default_rng(1)
    groups = {1: r.normal(size=(23, 4)), 2: r.normal(size=(1, 4)), 3: np.vstack([np.zeros((1, 4)), r.normal(size=(6, 4)) + 1])}
    data = [(g, i, v.tolist()) for g, m in groups.items() for i, v in enumerate(m)] + [(1, 99, None), (None, 1, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "g int, i int, v array<double>").repartition(3)
    for block in (4, 1024):  # several blocks a group, and one
        got = {x["g"]: x for x in analysis.pair_statistics(df, "g", "i", "v", block).collect()}
        assert got.keys() == groups.keys()
        for g, m in groups.items():
            assert got[g]["n"] == len(m)
            for a, b in zip(tuple(got[g])[2:], pair_numbers(m)):
                assert a is b is None or abs(a - b) < 2e-6, (g, block)
