"""Small fixtures: nulls, empty and odd values, ties, repeated rows."""

from pyspark.sql import functions as F

from sparkloom.operators import chunking, code, fulltext, html, hybrid, metadata, performance, quality, store, vector
from sparkloom.sources import crawl

PAGE = "id long, url string, chunk_number int, content string, embedding array<float>, source_id int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_vector_match_leaves_out_unusable_vectors_and_breaks_ties_by_id(spark):
    data = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0])]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    df = df.withColumn("embedding", F.when(F.size("embedding") == 2, F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 62))).otherwise(F.col("embedding")))
    got = vector.match(df, vector.query_vector(df), 2).select("id", "similarity").collect()
    assert [tuple(r) for r in got] == [(1, 2.0), (3, 2.0)]
    assert vector.match(df, df.limit(0).select(F.col("embedding").alias("_q")), 2).count() == 0


def test_web_query_syntax():
    q = fulltext.parse('red or blue "big house" -old car')
    assert (q.groups, q.phrases, q.without) == ([["red", "blue"], ["car"]], [["big", "house"]], ["old"])
    assert not fulltext.parse("-only").words
    assert not fulltext.parse(None).words


def test_fulltext_rank(spark):
    df = spark.createDataFrame([(1, "Red car in a big house"), (2, "old red car big house"), (3, None), (4, ""), (5, "blue CAR, big-house")], "id long, content string")
    assert rows(fulltext.rank(df, "content", 'red or blue car "big house" -old').select("id")) == [(1,), (5,)]
    assert fulltext.rank(df, "content", "").count() == 0


def test_hybrid_keeps_rows_of_one_arm(spark):
    pad = lambda x: x + [0.0] * 62
    data = [(1, "u", 0, "cache here", None, 1), (2, "u", 1, "nothing", pad([1.0, 0.0]), 1), (3, None, 0, None, pad([0.5, 0.0]), None)]
    df = spark.createDataFrame(data, PAGE)
    got = {r["id"]: r for r in hybrid.fuse(df, "content", "cache", vector.query_vector(df), 10, 50).collect()}
    assert got[1]["vector_rank"] is None and got[1]["text_rank"] == 1 and got[2]["text_rank"] is None and got[3]["vector_rank"] == 2


def test_rerank_is_stable(spark):
    df = spark.createDataFrame([(1, "x", 0.3), (2, "cache", 0.2), (3, None, 0.1)], "id long, content string, rrf_score double")
    assert [r["id"] for r in hybrid.rerank(df, "content", "cache").orderBy("position").collect()] == [2, 1, 3]


def test_replace_by_url(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, url string")
    new = spark.createDataFrame([(9, "a"), (8, None)], "id long, url string")
    assert sorted(r[0] for r in store.replace_by_url(old, new).collect()) == [2, 3, 8, 9]
    assert store.replace_by_url(old.limit(0), new.limit(0)).count() == 0


def test_append_new_keys(spark):
    old = spark.createDataFrame([("a", 1)], "url string, n int")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 1), (None, 1)], "url string, n int")
    assert store.append_new_keys(old, new, ["url", "n"]).count() == 4


def test_cascade_and_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, "x"), (None, "y"), (7, "z")], "k int, v string")
    assert rows(store.orphans(child, parent, "k").select("v")) == [("z",)]
    left, kids = store.delete_cascade(parent, {"c": child}, "k", parent.filter("k = 1"))
    assert rows(left) == [(2,)] and sorted(r["v"] for r in kids["c"].collect()) == ["y", "z"]


def test_chunks_keep_all_words_and_fences():
    fence = "```python\n" + "x = 1\n" * 40 + "```"
    text = ("A sentence here. " * 30 + "\n\n") * 4 + fence + "\n\n" + "Tail words. " * 60
    parts = chunking.chunk(text, 1000)
    assert " ".join(" ".join(parts).split()) == " ".join(text.split())
    assert any(fence in p for p in parts)
    assert chunking.chunk(None) == [] and chunking.chunk("") == [] and chunking.chunk(" a ") == [" a "]
    assert chunking.chunk("a" * 2500, 1000) == ["a" * 1000, "a" * 1000, "a" * 500]


def test_unclosed_fence_ends_the_search():
    assert chunking.fences("```a\nx\n```\n\n```b\ny") == [(0, 10)]


def test_semantic_chunks():
    text = "# A\n\nfirst words\n\n# B\n\n" + "Many words here. " * 40
    parts = chunking.semantic_chunks(text, 200)
    assert parts[0].startswith("# A") and all(len(p) <= 200 for p in parts)
    assert chunking.semantic_chunks(None) == []


def test_quality_of_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("# T\n\n" + "word " * 120,)], "t string")
    got = df.select(*[c.alias(n) for n, c in quality.markdown_quality(F.col("t")).items()]).collect()
    assert got[0]["words"] is None and got[1]["words"] == 0 and got[2]["words"] == 121
    assert df.select(quality.navigation_elements(F.col("t"))["streaks"]).collect()[1][0] == 0
    df.select(*[c.alias(n) for n, c in quality.selector_check(F.col("t")).items()]).collect()
    df.select(*[c.alias(n) for n, c in quality.extraction_check(F.col("t")).items()]).collect()


def test_integration_list_scores_low(spark):
    text = "\n".join(f"- [Service {i} integration](https://x.example/{i})" for i in range(20))
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in quality.markdown_quality(F.col("t")).items()])
    row = df.select("link_density", quality.markdown_score(F.col("link_density"), F.col("content_ratio"), F.col("words"), F.col("paragraphs"), F.col("code_blocks"), F.col("coherence")).alias("s")).first()
    assert row["link_density"] > 0.15 and row["s"] < 0.3


def test_content_type(spark):
    cases = [("x", "https://docs.a.example/", "technical"), ("posted by reply solved", "https://a.example/", "forum"), ("api", "https://a.example/", "general"), (None, None, "general")]
    df = spark.createDataFrame(cases, "t string, u string, want string")
    assert all(r[0] == r[1] for r in df.select(metadata.content_type(F.col("t"), F.col("u")), "want").collect())


def test_titles(spark):
    assert one(spark, "text\n# A *b* title\n# C", metadata.heading_title) == "A b title"
    assert one(spark, "no heading", metadata.heading_title) is None


def test_code_blocks(spark):
    text = "a\n```py\ndef f(x):\n    return x + 1\n```\nb\n```\nshort\n```\n```\nunclosed block that is long enough"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, content string")
    got = code.fenced_blocks(df, "id", "content").withColumn("l", code.language(F.col("hint"), F.col("code"))).collect()
    assert [(r["id"], r["block"], r["l"]) for r in got] == [(1, 1, "python")]


def test_code_language_and_complexity(spark):
    cases = [("def f(a):\n    return a", "python"), ("const a = 1;\nlet b = 2;", "javascript"), ("interface A { b: string }", "typescript"), ("#include <x>\nstd::cout", "cpp"), ("SELECT a FROM b", "sql"), ("<p>x</p>", "html"), ("echo $HOME", "shell"), ('{"a": 1}', "json"), ("plain words", "unknown")]
    df = spark.createDataFrame(cases, "c string, want string")
    assert [r[0] for r in df.select(code.from_content(F.col("c"))).collect()] == [w for _, w in cases]
    deep = spark.createDataFrame([("if (a) { while (b) { } } } {",)], "c string").select(code.nesting(F.col("c"), F.lit("java"))).first()[0]
    assert deep == 2


def test_html_to_markdown(spark):
    page = '<html><nav>menu</nav><article><h1>T</h1><p>Some <a href="/x">link</a>.</p><ul><li>one<li>two</ul><script>x()</script><!-- c --></article><footer>f</footer></html>'
    assert one(spark, page, html.to_markdown) == "# T\n\nSome [link](/x).\n\n- one\n- two"
    assert one(spark, None, html.to_markdown) is None
    assert "menu" in one(spark, page, lambda c: html.to_markdown(c, 1)) and "menu" not in one(spark, page, lambda c: html.to_markdown(c, 3))
    assert "(/x)" not in one(spark, page, lambda c: html.to_markdown(c, 3)) and "(/x)" in one(spark, page, lambda c: html.to_markdown(c, 3, links=True))
    assert one(spark, page, html.main_part).startswith("<h1>") and one(spark, None, html.main_part) is None
    for part in ("<main><p>a</p><article>X</article></main>", "<main>X</main><article>y</article>", "<article>X</article>", '<div class="big content">X</div>', '<p role="main">X</p>', "X"):
        assert one(spark, part, html.main_part) == "X", part
    assert one(spark, '<div class="md-main"><div class="md-sidebar">', html.framework) == "material_design"
    assert one(spark, "<p>", html.framework) == "generic"
    assert one(spark, '<div class="hub-sidebar">', html.framework) == "readme_io" and one(spark, '<meta name="generator" content="jekyll"><i class="site-nav">', html.framework) == "jekyll"
    left = '<nav>x</nav><div class="a menu">x</div><p class="crumb">x</p><a class="btn" href="u">x</a><a class="headerlink"> # </a><ul class="toc">x</ul>\n\n\n\ntext with <a href="u">link</a>'
    assert one(spark, left, html.clean) == 'text with <a href="u">link</a>'
    assert [t[1] for t in html.tier_table()] == [20, 17, 14, 11, 8] and html.word_threshold(9) == 5


def test_registry_of_domains(spark):
    reg = spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate(html.REGISTRY)], "registered string, selector string, ordinal int")
    df = spark.createDataFrame([("docs.n8n.io",), ("x.n8n.io",), (" GITBOOK.io ",), ("other.org",), (None,), ("x.n8n.io",)], "host string")
    got = sorted(((r["host"], r["registered"]) for r in html.registered(df, "host", reg).collect()), key=repr)
    assert got == sorted([("docs.n8n.io", "docs.n8n.io"), ("x.n8n.io", "n8n.io"), (" GITBOOK.io ", "gitbook.io"), ("other.org", None), (None, None), ("x.n8n.io", "n8n.io")], key=repr)


def test_sitemaps(spark):
    docs = spark.createDataFrame([("a.xml", "<s><loc> b.xml </loc><loc>p1</loc></s>"), ("b.xml", '<x:u xmlns:x="y"><x:loc>p2</x:loc><x:loc>a.xml</x:loc></x:u>'), ("c.xml", None)], "url string, xml string")
    got = crawl.expand_sitemaps(docs, spark.createDataFrame([("a.xml",)], "url string"))
    assert rows(got) == [("p1",), ("p2",)]


def test_walk(spark):
    links = spark.createDataFrame([("a", "b#x"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "z"), ("d", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a#top",), (None,)], "url string")
    assert rows(crawl.walk(links, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(crawl.walk(links, seeds.limit(0), 2)) == []


def test_url_list(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://b.example\nnot one\n http://a.example \n\n")
    assert [r[0] for r in crawl.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://b.example", "http://a.example"]
    assert crawl.text_files(spark, str(tmp_path / "u.txt")).count() == 1


def test_performance_status(spark):
    df = spark.createDataFrame([(30.0, None, None), (-20.0, 60.0, None), (-20.0, 0.0, 0.0), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(performance.status(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["regression_detected", "regression_detected", "improvement_detected", "stable"]


def test_stream(spark, tmp_path):
    from sparkloom.streaming import ingest

    data = spark.createDataFrame([("u", 0, "x", 1, "2024-01-01 00:00:00"), ("u", 0, "x", 1, "2024-01-01 00:01:00"), ("u", 1, "y", 1, "2024-01-03 00:00:00")], "url string, chunk_number int, content string, source_id int, t string").withColumn("crawl_time", F.to_timestamp("t")).drop("t")
    data.write.parquet(str(tmp_path / "in"))
    stream = ingest.first_versions(ingest.read_pages(spark, str(tmp_path / "in"), data.schema))
    out = str(tmp_path / "out")
    ingest.write_replacing(stream, str(tmp_path / "cp"), lambda df, n: df.write.mode("append").parquet(out)).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    counts = ingest.arrivals(ingest.read_pages(spark, str(tmp_path / "in"), data.schema))
    query = counts.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n_rows) from arrivals").first()[0] == 3


def test_models_of_null_and_empty(spark):
    from sparkloom.operators import models

    df = spark.createDataFrame([(None, None), ("", ""), ("# Head\n\nwords here", "words")], "t string, c string")
    got = df.select(models.hashed_embedder(8)(F.col("t")).alias("v"), models.template_writer()(F.col("t"), F.col("c")).alias("x"), models.overlap_reranker()(F.col("c"), F.col("t")).alias("s")).collect()
    assert got[0]["v"] == [0.0] * 8 == got[1]["v"] and abs(sum(v * v for v in got[2]["v"]) - 1) < 1e-6
    assert (got[0]["x"], got[1]["x"], got[2]["x"]) == (None, "", "[DOCUMENT] Head\n---\nwords")
    assert [r["s"] for r in got] == [0.0, 0.0, 1.0]


def test_combined_score_leaves_out_missing_parts(spark):
    from sparkloom.operators import analysis

    df = spark.createDataFrame([(1.0, None), (None, None), (0.5, 1.0)], "a double, b double")
    none = F.lit(None).cast("double")
    assert [r[0] for r in df.select(analysis.combined_score(F.col("a"), F.col("b"), none, none)).collect()] == [1.0, 0.0, 0.666667]
