"""Problems 1 and 2."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import lines, pieces


def covered(parts, text, limit):
    """Pieces are within the limit, in order, and overlap or touch."""
    assert parts[0][1] == 0 and parts[-1][1] + len(parts[-1][2]) == len(text)
    for (_, s, t), (_, s2, _) in zip(parts, parts[1:]):
        assert s < s2 <= s + len(t)
    for _, s, t in parts:
        assert len(t) <= limit and text[s : s + len(t)] == t


def test_split_column(spark):
    prose = "This is a sentence. Another one follows here!\n\n" * 400
    fence = "Intro.\n\n```\n" + "code line\n" * 900 + "```\nAfter.\n" + "More words follow. " * 200
    cases = [(1, prose), (2, fence), (3, "x" * 12_001), (4, None), (5, ""), (6, "y" * 5000), (7, "日本語。" * 3000), (1, prose), (None, "z " * 4000)]
    df = spark.createDataFrame(cases, "id long, content string").withColumn("chunk_number", F.lit(9))
    got = pieces.split_column(df.drop("chunk_number"), "id", "content", range_chars=1000, segment=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["chunk_number"], r["start"], r["content"]))
    assert set(by) == {1, 2, 3, 7, None}
    texts = dict(cases)
    for key, parts in by.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        covered(parts, texts[key], 5000)
    assert all(len(a[2]) - (b[1] - a[1]) >= 150 for k in (1, 7) for a, b in zip(by[k], by[k][1:]))
    assert all(re.search(r"[.!。]\s*$", p[2]) for k in (1, 7) for p in by[k])


def test_ranges_do_not_change_boundaries():
    text = ("Word one. Line two\nline three\n\n```py\nx = 1\n\ny = 2\n```\n\n") * 40
    whole = pieces.scan(text, 0, len(text))
    places, before = [], 0
    for lo in range(0, len(text), 97):
        a, b = max(0, lo - pieces.HALO), min(len(text), lo + 97)
        p, w, f, n = pieces.scan(text[a : b + pieces.HALO], lo - a, b - a)
        places += [(lo + x, y, before + z) for x, y, z in zip(p, w, f) if y > pieces.WORD]
        before += n
    assert [x for x in zip(*whole[:3]) if x[1] > pieces.WORD] == places and before == whole[3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=40), st.integers(300, 900))
def test_plan_always_covers(gaps, limit):
    places = [sum(gaps[: i + 1]) for i in range(len(gaps))]
    end = (places[-1] if places else 0) + 500
    out = pieces.plan(places, [i % 4 for i in range(len(places))], 0, end, limit, 50)
    assert out[0][0] == 0 and out[-1][1] == end
    assert all(0 < b - a <= limit for a, b in out) and all(a2 <= b and b2 > b for (_, b), (a2, b2) in zip(out, out[1:]))


def test_split_files(spark, tmp_path):
    text = "Ein Satz mit Ümlaut. Noch einer – hier.\n\n" * 900 + "```\ncode\n```\n" + "日本語の文。" * 500
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    files = [(str(p), p.stat().st_size) for p in sorted(tmp_path.iterdir())]
    got = pieces.split_files(spark, files, range_bytes=7001, segment=3).orderBy("path", "chunk_number").collect()
    covered([(r["chunk_number"], r["start"], r["text"]) for r in got], text, 5000)


def repeated_by_hand(rows, min_rows=5, share=0.1):
    n, seen, all_ = {}, {}, []
    for i, s, t in rows:
        if s is None:
            continue
        n[s] = n.get(s, 0) + 1
        for k, line in enumerate((t or "").split("\n")):
            f = re.sub("[0-9]+", "0", " ".join(line.split()).lower())
            if len(f) >= 20:
                seen.setdefault((s, f), set()).add(i)
                all_.append((i, k + 1, s, f))
    return {(i, k) for i, k, s, f in all_ if len(seen[s, f]) >= min_rows and len(seen[s, f]) >= share * n[s]}


LEGAL = "Copyright {} Example Works, all rights reserved"


def site_rows(words):
    rows = []
    for i in range(60):
        body = words(i, 30) + "\r\n" + ("  " + LEGAL.format(2000 + i) if i % 3 else LEGAL.format(7).upper()) + " \n" + words(i + 900, 12)
        rows.append((i, 1 if i < 40 else 2, body))
    rows += [(100 + i, 3, words(5, 9) if i < 4 else words(i + 40, 9)) for i in range(12)]  # four rows only
    return rows + [(200, 1, None), (201, None, LEGAL), (202, 2, ""), (203, 4, LEGAL.format(1))]


def test_repeated_lines(spark, words):
    rows = site_rows(words)
    df = spark.createDataFrame(rows, "id long, source_id int, content string")
    got = {tuple(r) for r in lines.find_repeated(df).collect()}
    assert got == repeated_by_hand(rows) and len(got) == 60
    assert lines.find_repeated(df.limit(0)).count() == 0


def test_a_line_of_many_sources_is_found_in_each(spark, words):
    rows = [(100 * s + i, s, words(100 * s + i, 10) + "\nLast updated on 2020-01-0" + str(i)) for s in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, source_id int, content string")
    assert {tuple(r) for r in lines.find_repeated(df).collect()} == {(r[0], 2) for r in rows}


def test_rows_that_share_a_key_keep_their_own_lines(spark, words):
    foot = "Footer of this site, all year long"
    rows = [(1, 1, words(1, 9) + "\n" + foot), (1, 1, foot + "\n" + words(2, 9)), (1, 2, words(3, 9) + "\n" + foot), (None, 1, foot), (1, 1, None), (1, None, foot)]
    rows += [(10 + i, 1, words(i + 20, 9) + "\n" + foot) for i in range(6)] + [(30 + i, 2, words(i + 40, 9)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, source_id int, content string")
    got = sorted(((r["id"], r["source_id"], r["content"]) for r in lines.remove_repeated(df).collect()), key=repr)
    want = [(i, s, t if s != 1 or t is None else "\n".join(x for x in t.split("\n") if x != foot)) for i, s, t in rows]
    assert got == sorted(want, key=repr)
    assert lines.remove_repeated(df.limit(0)).columns == df.columns


def test_lines_of_the_only_site_are_found(spark, words):
    rows = [(i, 1, words(i, 12) + ("\nA line on a tenth of all rows" if i % 10 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, source_id int, content string")
    assert {tuple(r) for r in lines.find_repeated(df).collect()} == {(i, 2) for i in range(0, 300, 10)}


def test_remove_repeated(spark, words):
    rows = site_rows(words)
    df = spark.createDataFrame(rows, "id long, source_id int, content string").withColumn("line_no", F.lit(1)).withColumn("n_rows", F.lit(2))
    got = {r["id"]: r["content"] for r in lines.remove_repeated(df).collect()}
    gone = repeated_by_hand(rows)
    for i, _, t in rows:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k + 1) not in gone)
        assert got[i] == want
