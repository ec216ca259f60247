"""Acquisition without a network: pages from tables and files, sitemaps, url lists, and the walk over links (SRC2-SRC10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage


def sitemap_urls(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``url``: the texts of all ``loc`` elements, whatever their namespace (SRC2). Null and empty documents give none."""
    found = F.regexp_extract_all(F.col(xml), F.lit(r"<(?:\w+:)?loc\s*>\s*([^<]*?)\s*</(?:\w+:)?loc\s*>"), 1)
    return df.select(F.explode(found).alias("url")).filter("url <> ''")


def expand_sitemaps(documents: DataFrame, roots: DataFrame, limit: int = 50, depth: int = 5) -> DataFrame:
    """``url``: pages of the ``roots`` (``url``) by the stored sitemaps (``url, xml``), indexes followed; the first ``limit`` by name (SRC3).

    A sitemap met again is not read again, so a cycle ends. Indexes nested deeper than ``depth`` raise an error.
    """
    frontier, seen, pages = roots.select("url").distinct(), roots.select("url").distinct(), None
    for _ in range(depth):
        found = sitemap_urls(frontier.join(documents, "url")).distinct()
        maps = found.join(documents.select("url"), "url", "left_semi")
        own = found.join(documents.select("url"), "url", "left_anti")
        pages = own if pages is None else pages.union(own)
        frontier = cut_lineage(maps.join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.union(frontier))
    else:
        raise ValueError(f"sitemap indexes are nested deeper than {depth}")
    return pages.distinct().orderBy("url").limit(limit)


def url_list(spark: SparkSession, path: str, limit: int | None = 50, any_line: bool = False) -> DataFrame:
    """``url``: the lines of a text file that are http addresses (or ``any_line`` that isn't blank), in order, ``limit`` of them or all (SRC4)."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("_n"))
    own = lines.filter(F.col("url") != "" if any_line else F.col("url").rlike("^https?://"))
    return own.select("url") if limit is None else own.orderBy("_n").limit(limit).select("url")


def golden_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, content``: markdown files without the comment of metadata that they begin with, up to a line ``-->`` (SRC10)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("_f"), "value")
    name = F.regexp_extract("_f", r"([^/]+)\.md$", 1)
    return files.select(name.alias("name"), F.regexp_replace("value", r"(?s)\A[^\n]*\n(?:.*?\n)??[ \t\r]*-->[ \t\r]*(?:\n|\z)", "").alias("content"))


def page_links(pages: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """``src, dst``: the links of markdown pages that lead to web addresses; those that begin with ``/`` belong to the page's site."""
    found = F.explode(F.regexp_extract_all(F.col(content), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1))
    rows = pages.filter(F.col(url).isNotNull()).select(F.regexp_replace(url, "#.*$", "").alias("src"), found.alias("_u"))
    site = F.regexp_extract("src", r"^([a-zA-Z]+://[^/?#]+)", 1)
    whole = F.when(F.startswith("_u", F.lit("/")) & (site != ""), F.concat(site, "_u")).when(F.col("_u").rlike("^https?://"), F.col("_u"))
    return rows.select("src", F.regexp_replace(whole, "#.*$", "").alias("dst")).filter("dst is not null").distinct()


def within(links: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``links`` whose ``dst`` starts with one of the ``prefixes`` (``prefix``: addresses of sites, FLT14): matched by site first, so it is an equi-join."""
    site = lambda c: F.regexp_extract(c, r"^([a-zA-Z]+://[^/?#]+)", 1)
    own = prefixes.filter(F.col("prefix").isNotNull()).select(F.regexp_replace("prefix", "[#?].*$", "").alias("_p")).distinct().withColumn("_site", site(F.col("_p")))
    return links.withColumn("_site", site(F.col("dst"))).join(own, "_site").filter(F.startswith("dst", F.col("_p"))).select("src", "dst").distinct()


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``url, content``: whole text files (SRC7)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))


def walk(links: DataFrame, seeds: DataFrame, depth: int, allowed: Column | None = None) -> DataFrame:
    """``url, depth``: what the links (``src, dst``) lead to from the seeds in at most ``depth`` steps (SRC8), seeds at 0.

    Fragments are cut off. Each round joins the last level to the links and leaves out what was seen; levels are
    written to the checkpoint folder, so the plan doesn't grow.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    edges = links.select(bare(F.col("src")).alias("src"), bare(F.col("dst")).alias("dst")).filter("src is not null and dst is not null").distinct()
    if allowed is not None:
        edges = edges.filter(allowed)
    seen = cut_lineage(seeds.select(bare(F.col("url")).alias("url")).filter("url is not null").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for step in range(1, depth + 1):
        found = level.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        level = cut_lineage(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(level))
    return seen


def successful(pages: DataFrame, content: str = "content") -> DataFrame:
    """Rows with content that is not blank (SRC6, FLT13)."""
    return pages.filter(F.length(F.trim(F.col(content))) > 0)
