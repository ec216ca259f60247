"""Parts of a text or table that were passed over before."""

from sparkloom.llm import layout, moderation, queries, residue
from sparkloom.session import table


def test_lines_after_a_fence_that_is_never_closed_are_labelled():
    kinds = layout.label("Words of the page.\n```py\nx = 1\n```\n```\nMore words here.\n© 2022 Some Press. All rights reserved.", frozenset())
    assert kinds == [layout.BODY, layout.CODE, layout.CODE, layout.CODE, layout.CODE, layout.BODY, layout.SITE]


def test_text_after_a_fence_that_is_never_closed_is_outside_code():
    assert residue.outside_code("a\n```\nx\n```\nb\n```\nc\n").split() == ["a", "b", "c"]
    assert residue.outside_code("a\n~~~\nc").split() == ["a", "c"]
    assert residue.evidence("Some words.\n```\nMore words.\n\nTBD") == "unwritten"


def test_all_passages_are_scored():
    said = moderation.passages("Oh. You idiot!\n| a | you stupid idiot |\n```py\nx = 'some rude words'  # you 57up1d i d i o t\n```\nSee `what an idiot` there now. s****d")
    flat = "".join(said)
    for words in (" oh ", " you idiot ", " you stupid idiot ", "some rude words", "you stupid idiot", "what an idiot", f"s{moderation._STAR}d"):
        assert words in flat, words
    assert moderation.passages(None) == moderation.passages("") == moderation.passages("123 | --- |") == []
    assert moderation.passages("One two.\nOne two.\nOne\ntwo.") == [" one two "]
    long = " ".join(["word"] * 300)
    assert " ".join("".join(moderation.parts(long)).split()) == long and max(map(len, moderation.parts(long))) <= moderation.LONG + 2


def test_short_insults_and_a_few_words_in_a_long_line_reach_the_bar():
    bad = [f"You {a} {b}, go away." for a in ("stupid", "useless", "worthless") for b in ("idiot", "moron", "idiot fool")]
    good = ["You can change the limit here.", "The service keeps a record.", "Go to the settings and look.", "A line is written to the log.", "The oldest one is removed.", "You may read the manual first."]
    model = moderation.train([(t, "insult") for t in bad * 2] + [(t, "none") for t in good * 3], [])
    line = "the service keeps a record of every session and writes a line to the log when the limit is reached "
    scores = model.documents(["You stupid idiot!", "| a | stupid idiot |", "```\n# you stupid idiot\n```", line * 4 + "you stupid idiot, go away " + line * 4, "The log. | Limit |", line * 8, None, ""])
    assert (scores[:4] >= moderation.BAR).all() and (scores[4:] < moderation.BAR).all() and scores[6] == scores[7] == 0


def test_grams_stay_inside_their_passage():
    import numpy as np

    texts = [" ab ", " abc ", " ab "]
    f, of = moderation.Grams(texts).flat()
    sets = [sorted(f[of == k]) for k in range(3)]
    assert sets[0] == sets[2] and [len(x) for x in sets] == [sum(max(0, len(t) - n + 1) for n in moderation.GRAMS) for t in texts]
    model = moderation.Model(np.random.default_rng(1).normal(size=moderation.DIM), 0.0)
    assert np.allclose(model.log_odds(texts * 3), np.tile(model.log_odds(texts), 3)) and len(model.log_odds([])) == 0


def test_unseen_wording_and_disguises_beside_unlabelled_documents():
    """Of the registered kind of fit: labelled table, invented sentences, and unlabelled passages a few of which are abusive."""
    import random

    import duckdb

    rows = duckdb.sql("SELECT text, category FROM '/root/testdata/sf0.01/moderation_samples.parquet' WHERE text IS NOT NULL ORDER BY sample_id").fetchall()
    r = random.Random(5)
    words = "the service record session limit table driver window report folder node cluster value entry worker queue stores reads moves checks when before every old new".split()
    sampled = [f" {' '.join(r.choice(words) for _ in range(9))} " for _ in range(1500)] + [" get lost you worthless halfwit before i slap you "] * 2
    model = moderation.train(rows, sampled)
    bad = ["Get lost, you worthless halfwit, before I slap you.", "Nobody needs such an ugly 1d10t around.", "All those people are v e r m i n, throw them out.", "You are a f.i.l.t.h.y moron.", "She was naked and wanted his hard c**k."]
    good = ["The old window stores every record before the limit.", "Three brothers built the bridge in the year 1402.", "Kill the child process first, then let the parent read the queue.", "Das Fenster wird im Garten geöffnet.", "I felt like an idiot when I saw that the value was wrong."]
    assert (model.documents(bad) >= moderation.BAR).sum() >= 4 and (model.documents(good) < moderation.BAR).sum() >= 4


def test_whole_results_of_problems_1_2_4_and_6(spark):
    small = "/root/testdata/sf0.001"
    got = {n: queries.queries()[n](spark, small).collect() for n in ("p1_found", "p1_pieces", "p2_clean", "p4_found", "p4_groups", "p6_body")}
    texts = {r["id"]: r["content"] for r in table(spark, small, "crawled_pages").select("id", "content").collect()}
    assert {r["id"] for r in got["p1_pieces"]} == {r["id"] for r in got["p1_found"]}
    assert all(r["content"] == texts[r["id"]][r["start"] : r["start"] + len(r["content"])] and len(r["content"]) <= 5000 for r in got["p1_pieces"])
    assert {r["member"] for r in got["p4_groups"]} == {x for r in got["p4_found"] for x in r}
    for n in ("p2_clean", "p6_body"):
        assert len(got[n]) == table(spark, small, "crawled_pages").count()
