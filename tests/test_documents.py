"""Chunks of documents, sections, kinds of duplicates, contexts of blocks, advice: small cases worked out by hand."""

from pyspark.sql import functions as F

from sparkloom.operators import advice, analysis, chunking, code


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_rule_split_writes_sentences_again_and_carries_the_open_one():
    text = "One two three! Four five?  Six seven eight nine ten eleven."
    assert chunking.rule_split(text, 30) == ["One two three. Four five.", "Six seven eight nine ten", "eleven."]
    assert chunking.rule_split("", 10) == [] and chunking.rule_split("a" * 50, 10) == ["a" * 50]
    for size in (10, 25, 80):
        words = " ".join(chunking.rule_split("word " * 60, size)).split()
        assert words == ["word"] * 60


def test_document_chunks_and_their_places():
    long = "# A\n\n" + "one two three. " * 20 + "\n\n# B\n\n" + "four five six. " * 20
    assert chunking.document_chunks(None) == chunking.document_chunks(" \n") == []
    found = chunking.document_chunks(long, 200, 250)
    assert all(len(c) <= 250 for c in found) and "".join(found).count("one") == 20
    assert chunking.document_chunks(long, 200, 250, semantic=False) == chunking.rule_split(long, 200)
    model = lambda s, size: chunking.SEPARATOR.join([s[:30], s[30:60], "", s[60:]])
    assert chunking.split_section("x" * 90, 40, 40, model) == ["x" * 30] * 3
    assert chunking.split_section("x " * 90, 40, 40, lambda s, n: None) == chunking.rule_split("x " * 90, 40)
    assert chunking.positions("ab cd ab", ["ab", "ab", "zz"]) == [(0, 2), (6, 8), (8, 10)]


def test_document_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "id int, text string").withColumn("total", F.lit(1))
    rows = chunking.document_rows(df, "text").collect()
    assert [(r["id"], r["chunk_index"], r["total_chunks"], r["chunk"], r["start"], r["end"], r["token_count"]) for r in rows] == [(1, 0, 1, "a b c", 0, 5, 1)]


def test_fence_faults(spark):
    texts = {"a ``` b": "orphan_open", "a\n```\n \n": "orphan_close", "```py\n```": "empty_fence", "```\nasyncdef x\n```": "merged"}
    for t, what in texts.items():
        row = chunking.check_chunks(spark.createDataFrame([(t,)], "chunk string")).first()
        assert [n for n in ("orphan_open", "orphan_close", "empty_fence", "merged") if row[n]] == [what], t


def test_semantic_sections():
    ten = "one two three four five six seven eight nine ten"
    text = f"{ten}\n\nshort\n\n# Header\n\n" + "\n\n".join([ten] * 7) + "\n\n# Last\n\ntoo short"
    got = analysis.semantic_sections(text)
    assert got[0] == f"{ten}\n\nshort" and [c.count("ten") for c in got[1:]] == [6, 1] and len(got) == 3
    assert analysis.semantic_sections(None) == []


def test_duplicate_kinds(spark):
    text = "\n\n".join(["Back to the menu of our pages", "Back to the menu of our pagez", "The copyright of all of this here", "The copyright of all of this here", "Words that nobody else would ever say"])
    got = one(spark, text, analysis.duplicate_kinds)
    assert got.asDict() == {"pairs": 2, "navigation": 1, "frame": 1, "sidebar": 0, "content": 0}
    assert one(spark, None, analysis.duplicate_kinds)["pairs"] == 0


def test_blocks_with_contexts(spark):
    text = "# Title\nIntro words here.\n```py\nprint('a long enough block')\nprint(2)\n```\n## After\nText ``` open"
    df = spark.createDataFrame([(1, text), (2, None), (3, "``` x")], "id int, t string")
    row = code.block_contexts(df, "id", "t").collect()
    assert [(r["block"], r["hint"], r["start_line"], r["end_line"], r["before"], r["after"]) for r in row] == [(1, "py", 2, 3, "# Title\nIntro words here.", "## After\nText ``` open")]
    heads = df.filter("id = 1").select(code.context_headers(F.lit("# T \nx"), F.lit("  ## U"))).first()[0]
    assert heads == ["h1: T", "h1: T", "h2: U"]
    assert one(spark, "a\n    x = 1\n\ty = 2\nb\n\n    \n    z\n", code.indented_blocks) == ["x = 1\ny = 2", "z"]


def test_links_and_terms_of_chunks(spark):
    t = "[a](/x) [b](https://y) [c](bad link) <a href='u'>txt</a> https://z\nTerm here: It is a thing.\n**Bold**: Another one.\n### Head\nwords"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(*[c.alias(n) for n, c in advice.chunk_links(F.col("t")).items()]).first().asDict() == {"links": 6, "internal": 1, "external": 3, "broken": 1}
    assert df.select(advice.glossary_terms(F.col("t"))).first()[0] == ["Term here", "Bold", "Head"]


def test_rerank_takes_any_scorer_and_falls_back(spark):
    df = spark.createDataFrame([(1, "a b", 0.9), (2, "b c", 0.8), (3, None, 0.7)], "id long, t string, rrf_score double")
    from sparkloom.operators import hybrid

    order = lambda scorer: [r["id"] for r in hybrid.rerank(df, "t", "c", keep=3, scorer=scorer).orderBy("position").collect()]
    assert order(hybrid.word_overlap) == [2, 1, 3] and order(None) == [1, 2, 3]
    assert order(lambda q, t: F.length(t).cast("double") * F.when(F.contains(t, F.lit("a")), 2.0).otherwise(-1.0)) == [1, 2, 3]


def test_overlap_search_by_row_and_by_word(spark, monkeypatch):
    from sparkloom.operators import hybrid

    queries = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,), ("--",)], "query string")
    docs = spark.createDataFrame([(1, "a x"), (2, "B a!"), (3, None), (4, "zz"), (5, "c a")], "id int, t string")
    got = []
    for sent in (hybrid.SENT_QUERIES, 0):
        monkeypatch.setattr(hybrid, "SENT_QUERIES", sent)
        got.append(sorted(tuple(r) for r in hybrid.overlap_search(queries, docs, "id", "t", 2).collect()))
    assert got[0] == got[1] == [("a b", 1, 0.5, 2), ("a b", 2, 1.0, 1), ("c", 5, 1.0, 1)]


def test_new_sources_are_numbered_in_order_of_their_urls(spark):
    from sparkloom.operators import store

    old = spark.createDataFrame([("u05", 7, 1)], "url string, source_id int, total_word_count int")
    new = spark.createDataFrame([(f"u{i:02}", i) for i in range(40)], "url string, total_words long")
    got = {r["url"]: r["source_id"] for r in store.upsert_sources(old, new, False).collect()}
    rest = [f"u{i:02}" for i in range(40) if i != 5]
    assert got == {"u05": 7} | {u: 8 + i for i, u in enumerate(rest)}


def test_files_links_and_prefixes(spark, tmp_path):
    import pytest

    from sparkloom.sources import crawl

    (tmp_path / "g.md").write_text("<!--\nscore: 1\n-->\n# Text\n--> stays\n")
    (tmp_path / "n.md").write_text("# No comment\n")
    assert {r["name"]: r["content"] for r in crawl.golden_files(spark, str(tmp_path)).collect()} == {"g": "# Text\n--> stays\n", "n": "# No comment\n"}
    (tmp_path / "u.txt").write_text("https://a\nplain\n\n http://b \n")
    assert [r[0] for r in crawl.url_list(spark, str(tmp_path / "u.txt"), None).collect()] == ["https://a", "http://b"]
    assert crawl.url_list(spark, str(tmp_path / "u.txt"), None, any_line=True).count() == 3
    pages = spark.createDataFrame([("https://s.x/a#f", "[t](/b#q) [u](https://o.x/c) [v](rel) [w](https://s.x/z)"), (None, "[t](/b)")], "url string, content string")
    links = crawl.page_links(pages)
    assert sorted(tuple(r) for r in links.collect()) == [("https://s.x/a", "https://o.x/c"), ("https://s.x/a", "https://s.x/b"), ("https://s.x/a", "https://s.x/z")]
    own = crawl.within(links, spark.createDataFrame([("https://s.x/b",), (None,)], "prefix string"))
    assert [r["dst"] for r in own.collect()] == ["https://s.x/b"]
    maps = spark.createDataFrame([(f"m{i}", f"<loc>m{i + 1}</loc>") for i in range(9)], "url string, xml string")
    with pytest.raises(ValueError):
        crawl.expand_sitemaps(maps, maps.filter("url = 'm0'").select("url"))


def test_fetching(spark):
    from sparkloom.sources import fetch

    def local(url):
        if "bad" in url:
            raise OSError(url)
        return None if "gone" in url else "<main> </main>" if "blank" in url else f"<nav>x</nav><main><h1>{url}</h1></main>"

    urls = spark.createDataFrame([("u1",), ("u1",), ("bad",), ("gone",), (None,), ("blank",)], "url string")
    assert {(r["url"], r["success"]) for r in fetch.fetch(urls, local, partitions=3).collect()} == {("u1", True), ("bad", False), ("gone", False), ("blank", True)}
    assert [tuple(r) for r in fetch.fetched_pages(urls, local).collect()] == [("u1", "# u1")]


def test_switches():
    import pytest

    from sparkloom.settings import Switches

    assert Switches().tools() == Switches.of({}).tools() and "search_code_examples" not in Switches().tools()
    assert Switches.of({"USE_AGENTIC_RAG": " True ", "USE_RERANKING": "0"}).tools()[-1] == "search_code_examples"
    with pytest.raises(ValueError):
        Switches(code_summaries=True)
