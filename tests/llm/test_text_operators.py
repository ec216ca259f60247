"""Problems 5 to 10."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import layout, linear, moderation, overlap, quality, residue, tokens

TOKENIZERS = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")
PROSE = "The service keeps a record of every session. When the limit is reached, the oldest one is removed and a line is written to the log.\n\nYou can change this limit in the settings, but it is not needed often."


@pytest.mark.parametrize(
    "text, kind",
    [
        ("# Page not found\n\nThe page you asked for does not exist.", "error"), ("404 | Not Found", "error"), ("Please enable JavaScript to continue.", "script"), ("Acme is down for maintenance\nWe expect to be back in 5 minutes.", "error"),
        ("## Setup\n\nTODO: write this section", "unwritten"), (PROSE + "\n\nWelcome to {{ user_name }}.", "placeholder"), (PROSE + "\n\nLorem ipsum dolor sit amet consectetur adipiscing elit.", "dummy"),
        (PROSE, None), (PROSE + "\n\n```\nhello {{ name }}\n```", None), (PROSE + " Write `{{ name }}` there.", None), ("When a link is broken the server answers with a 404 Not Found page, and the reader goes back to the start of the manual.", None),
        ("Filler text such as lorem ipsum is handy while a page is being designed, but remove it before it goes live.", None), (None, None), ("", None), (" \n ", None),
    ],
)
def test_evidence(text, kind):
    assert residue.evidence(text) == kind


def test_residue_is_learned_and_found(spark, words):
    bad = ["Error 404: Not Found", "Access denied", "TBD", "Please turn on JavaScript in your browser.", "Welcome to ${name_here}. " + PROSE]
    rows = [(i, f"https://h{i % 9}.example/a", f"# {words(i, 2)}\n\n{bad[i % 5]}") for i in range(60)]
    rows += [(100 + i, f"https://h{i % 9}.example/b", words(i, 60) + ". " + PROSE) for i in range(200)] + [(900, None, None), (901, None, "  "), (902, None, "")]
    df = spark.createDataFrame(rows, "id long, url string, content string").withColumn("score", F.lit("x"))
    assert {r["id"] for r in residue.find_residue(df).collect()} == set(range(60))
    assert residue.train(df)[2]["f1"] > 0.8
    assert residue.find_residue(df.limit(0)).count() == 0


def test_linear_fit():
    import numpy as np

    rows = [np.array([0, 2 + i % 5]) for i in range(50)] + [np.array([1, 2 + i % 5]) for i in range(50)]
    w, b = linear.fit(rows, np.array([1] * 50 + [0] * 50), 8)
    assert linear.probability(np.array([0]), w, b) > 0.9 > 0.1 > linear.probability(np.array([1]), w, b)


PAGE = """Search ⌘K
Home > Guides > Sessions

# Sessions

On this page
- First part
- Second part

The service keeps a record. It is removed later.
We use cookies to improve your visit. Accept all

```
Last updated on nothing
```
- A list item that is a sentence.

Reviewed by Acme staff, reading time 7 min
← One page    Another page →
© 2020 Acme Works. All rights reserved.
"""


def test_site_lines(spark):
    lines = PAGE.split("\n")
    want = {k + 1 for k, x in enumerate(lines) if x.startswith(("Search", "Home", "On this", "- First", "- Second", "We use", "Reviewed", "←", "©"))}
    rows = [(1, 1, PAGE), (2, 1, None), (3, None, ""), (4, 2, "- [A](https://a.example)\n- [B](https://b.example)"), (5, 2, "404 | Not Found\nHome > Docs")]
    df = spark.createDataFrame(rows, "id long, source_id int, content string").withColumn("_known", F.lit(0)).drop("_known")
    assert {tuple(r) for r in layout.site_lines(df).collect()} == {(1, k) for k in want}
    body = layout.main_text(df).filter("id = 1").first()["body"]
    with_join = pytest.MonkeyPatch()
    with_join.setattr(layout, "SENT_LINES", -1)
    assert {tuple(r) for r in layout.site_lines(df).collect()} == {(1, k) for k in want} and layout.main_text(df).filter("id = 1").first()["body"] == body
    with_join.undo()
    assert body.startswith("# Sessions") and "cookies" not in body and "Last updated on nothing" in body
    assert layout.site_lines(df.limit(0)).count() == 0


def test_lines_a_site_repeats(spark, words, monkeypatch):
    rows = [(i, 1, words(i, 12) + ".\nA motto nobody else has\n" + words(i + 99, 9) + ".") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, source_id int, content string")
    df = df.union(df.limit(0)).withColumn("_h", F.lit(1)).withColumn("_src", F.lit("x"))
    for sent in (layout.SENT_LINES, -1):
        monkeypatch.setattr(layout, "SENT_LINES", sent)
        assert {tuple(r) for r in layout.site_lines(df).collect()} == {(i, 2) for i in range(30)}


def test_fold_hash_is_sparks(spark):
    texts = ["", "a", "last updated on 0", "日本語 ↑", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.xxhash64("t")).collect()] == [layout.fold_hash(t) for t in texts]


def test_render_html():
    page = "<html><head><title>t</title></head><body><p>One<p>Two <b>bold</b><ul><li>a<li>b<ul><li>c</ul></ul><div style='display: none'>no</div><script>no</script><span hidden>no</span><table><tr><td>x<td>yy<tr><td>zzz<td>w</table><pre>  keep\n   this</pre>"
    out = layout.render_html(page)
    assert "no" not in out.split() and "One\n\nTwo bold" in out and "- a\n- b\n" in out and "| x   | yy |\n| zzz | w  |" in out and "```\n  keep\n   this\n```" in out
    assert layout.render_html(None) is None and layout.render_html("") == ""


def test_page_tree_keeps_every_line_and_its_kind():
    text = "# T\n\n- a\n  - b\n  - c\n- d\n\n\n| x | yyyy |\n|--|:--|\n| zz | q |\n\n```\n  code\n```\nlast\n© 2020 Acme. All rights reserved."
    tree = layout.page_tree(text, layout.label(text, frozenset()))
    found = list(layout.leaves(tree))
    assert [x.order for x in found] == list(range(1, text.count("\n") + 2)) and [x.parts[0] for x in found] == text.split("\n")
    assert [x.order for x in found if x.hidden] == [17] and [b.tag for b in tree.parts] == ["heading", "space", "ul", "space", "table", "space", "pre", "p", "site"]
    assert [p.tag for p in tree.parts[2].parts] == ["line", "ul", "line"]
    assert layout.render_page(tree) == "# T\n\n- a\n  - b\n  - c\n- d\n\n| x  | yyyy |\n| --- | :--- |\n| zz | q    |\n\n```\n  code\n```\nlast"
    assert layout.render_page(layout.page_tree("", [layout.BLANK])) == ""


def test_stored_markup_is_rendered(spark):
    df = spark.createDataFrame([(1, None, "<div><p>Own words of the page, long enough.<ul><li>one<li>two</ul><p hidden>gone</div>")], "id long, source_id int, content string")
    assert layout.main_text(df).first()["body"] == "Own words of the page, long enough.\n\n- one\n- two"


def test_quality_classes(spark):
    rows, k = [], 0
    for c, text in quality.EXAMPLES:
        for i in range(60 if c == "prose" else 8):
            rows.append((k, None, text.replace("cache", f"cache{i}") + ("" if c != "prose" else f"\n\nThis is part {i} of the text, and it ends here."), c))
            k += 1
    rows += [(9001, 1, None, None), (9002, 1, "", None), (9003, 1, " \n", None), (9004, 1, "Error 404: Not Found", None)]
    df = spark.createDataFrame(rows, "id long, source_id int, content string, truth string")
    got = {r["id"] for r in quality.find_not_prose(df.drop("truth")).collect()}
    want = {r[0] for r in rows if r[3] not in (None, "prose")}
    assert not got - want and len(got) >= 0.95 * len(want)
    assert quality.find_not_prose(df.limit(0)).count() == 0


def test_source_words(spark):
    pages = spark.createDataFrame([(1, "two words"), (1, None), (None, "x"), (9, "")], "source_id int, content string")
    sources = spark.createDataFrame([(1, 5), (2, None)], "source_id int, total_word_count int")
    got = {r["source_id"]: (r["n_rows"], r["words"], r["stated"], r["difference"]) for r in quality.source_words(pages, sources).collect()}
    assert got == {1: (2, 2, 5, -3), 2: (0, 0, None, None), None: (1, 1, None, None), 9: (1, 0, None, None)}


def reference_encoder():
    import tiktoken

    own = tokens.encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return own, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_tokens_round_trip_and_agree(text):
    own, ref = reference_encoder()
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == ref.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_token_columns(spark):
    own, ref = reference_encoder()
    texts = [None, "", " ", "Hello, world 123", "a" * 3000, "日本 <|endoftext|>", "\x00\r\n\t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("extra", F.lit(1))
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_column(df, path).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = tokens.decode_column(tokens.encode_column(df, path).drop("text"), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_smith_waterman_and_runs():
    a, b = "a b c d e f".split(), "x b c y d e z".split()
    assert overlap.longest_run(a, b) == 2 and overlap.align(a, b) == 7  # b c, a gap, d e
    assert overlap.align([], b) == 0 and overlap.longest_run(a, []) == 0 and overlap.align(a, a) == 12


def test_leaks_against_brute_force(spark, words, monkeypatch):
    items = [(i, words(i, 30)) for i in range(20)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for i in range(80):
        w = dict(items)[i % 20].split()
        cut = w[i % 9 : i % 9 + 10 + i % 8]
        docs.append((i, words(i + 500, 20) + " " + (", ".join(cut).upper() if i % 2 else "_".join(cut)) + " " + words(i + 900, 10)))
    docs += [(900, None), (901, ""), (902, dict(items)[3])]
    grams = {}
    for i, t in items:
        w = overlap.words_of(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [overlap.words_of(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    df, it = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for pairs in (overlap.SENT_PAIRS, 0):
        monkeypatch.setattr(overlap, "SENT_PAIRS", pairs)
        got = {(r["doc_id"], r["item_id"]) for r in overlap.find_leaks(df, it).filter("score >= 26 AND run_words >= 13").collect()}
        assert got == want and (902, 3) in got
    monkeypatch.setattr(overlap, "BITS", 64)  # a bitmap that knows every seed loses nothing
    assert {(r["doc_id"], r["item_id"]) for r in overlap.find_leaks(df, it).filter("run_words >= 13").collect()} == want
    assert overlap.find_leaks(df, it.limit(0)).count() == 0 and overlap.find_leaks(df.limit(0), it).count() == 0


def test_edited_copies_score_by_alignment(spark, words):
    own = words(1, 60).split()
    edited = [w if i % 9 else "changed" for i, w in enumerate(own)]
    docs = [(1, words(7, 300) + " " + " ".join(edited) + " " + words(8, 300)), (2, words(9, 400)), (3, " ".join(own[:20]))]
    items = spark.createDataFrame([(5, " ".join(own))], "item_id long, text string")
    got = {r["doc_id"]: (r["run_words"], round(r["share"], 2)) for r in overlap.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: (8, round((53 * 2 - 6) / 120, 2)), 3: (20, 0.33)}


def test_readings_undo_disguises():
    assert any("stupid idiot" in r for r in moderation.readings("you 57up1d 1d10t"))
    assert any("idiot" in r for r in moderation.readings("such an i d i o t!")) and any("moron" in r for r in moderation.readings("a m.o.r.o.n"))
    assert any("clown" in r for r in moderation.readings("CLLLLOWN".replace("LLLL", "LLL").lower() + " cllllown"))


SAMPLES = [(f"You are a {w} and everybody knows it.", "abuse") for w in "stupid loser idiot worm fool pig moron clown".split()] + [(f"The {w} report is ready for the reader to open.", "none") for w in "daily weekly blue old new plain long short large small".split()]


def test_moderation(spark):
    docs = [(i, "s1" if i % 2 else None, f"The {i} report is ready. It can be opened by the reader at any time.") for i in range(60)]
    docs += [(100, "s1", "Thanks for the help.\nYou are a lazy idiot and everybody knows it."), (101, "s1", "You are a 57up1d m0r0n and everybody knows it."), (102, None, None), (103, "s1", ""), (104, "s1", "```\nx = 1\n```")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("category", F.lit("x"))
    scored = moderation.score_documents(df, spark.createDataFrame(SAMPLES + [(None, "abuse"), ("", None)], "text string, category string")).cache()
    score = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert {k for k, v in score.items() if v >= moderation.BAR} == {100, 101} and score[102] == 0 == score[103]
    rates = {r["source"]: (r["n_docs"], r["n_cases"]) for r in moderation.source_rates(scored).collect()}
    assert rates == {"s1": (34, 2), None: (31, 0)}
    scored.unpersist()


def test_held_out_accuracy():
    """Trained on two thirds of the labelled texts, the rest is told apart."""
    import duckdb

    rows = duckdb.sql("SELECT text, category FROM '/root/testdata/sf0.01/moderation_samples.parquet' ORDER BY sample_id").fetchall()
    model = moderation.train([r for i, r in enumerate(rows) if i % 3], [])
    held = [r for i, r in enumerate(rows) if i % 3 == 0]
    right = sum((z >= moderation.BAR) == (c != "none") for z, (_, c) in zip(model.documents([t for t, _ in held]), held))
    assert right >= 0.93 * len(held)


def test_words_of():
    assert overlap.words_of("A_b C1—d\né") == re.findall(r"[a-zé0-9]+", "a b c1 d é")
