"""Store operators: replace by url, get-or-create, insert-or-update, mapping of sources, cascades (SNK1-SNK9, JN3-JN8, FLT7-FLT9).

All take the current table and the change and return the new table; writing it is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.text import white_words
from sparkloom.session import cut_lineage


def replace_by_url(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` without the rows of any url in ``new``, and ``new`` (SNK1). Rows with a null url stay; null urls of ``new`` replace nothing."""
    urls = new.filter(F.col("url").isNotNull()).select("url").distinct()
    return existing.join(urls, "url", "left_anti").select(existing.columns).unionByName(new)


def append_new_keys(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys it has not (SNK2); of new rows with equal keys all but one are left out.

    A null key is equal to no other.
    """
    held = existing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = None
    for k in keys:
        one = F.col(k) == F.col(f"_{k}")
        same = one if same is None else same & one
    fresh = new.join(held, same, "left_anti")
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    first = fresh.filter(~null_key).dropDuplicates(keys)
    return existing.unionByName(first.unionByName(fresh.filter(null_key)))


def source_totals(pages: DataFrame) -> DataFrame:
    """``url`` (the address of the site), ``total_words``, ``first_crawled`` per site, from pages (SNK3, AG4). Pages without a host are left out."""
    site = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    rows = pages.select(site.alias("url"), F.coalesce(F.size(white_words(F.col("content"))), F.lit(0)).alias("_w"), F.col("metadata.crawl_time").alias("_t"), F.col("content").isNull().alias("_null"))
    words = F.sum(F.when(F.col("_null"), 0).otherwise(F.col("_w"))).cast("long")
    return rows.filter("url <> ''").groupBy("url").agg(words.alias("total_words"), F.min("_t").alias("first_crawled"))


def upsert_sources(existing: DataFrame, totals: DataFrame, overwrite: bool) -> DataFrame:
    """``url, source_id, total_words``: existing sources and those of ``totals`` (SNK3 keeps an existing total, SNK4 overwrites it).

    New sources get ids after the largest existing one, in the order of their urls: they are ranged by url, counted per range
    and numbered within it, so no task sees them all.
    """
    old = existing.groupBy("url").agg(F.min("source_id").alias("source_id"), F.max("total_word_count").cast("long").alias("_old"))
    both = old.join(totals.select("url", "total_words"), "url", "full")
    new_first = both.filter(F.col("source_id").isNull())
    most = existing.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("_m"))
    ranged = cut_lineage(new_first.repartitionByRange("url").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row per partition
    before = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_m") + F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("url"))
    numbered = ranged.join(F.broadcast(before), "_part").crossJoin(F.broadcast(most)).withColumn("source_id", place.cast("int")).drop("_m", "_part", "_before")  # one row
    every = both.filter(F.col("source_id").isNotNull()).unionByName(numbered)
    words = F.coalesce("total_words", "_old") if overwrite else F.coalesce("_old", "total_words")
    return every.select("url", "source_id", words.alias("total_words"))


def fill_source_ids(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``pages`` with null source ids filled by the site of their url, www. apart (SNK5, JN8). Rows without a match keep null."""
    site = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#]+)", 1), r"^www\.", ""))
    known = sources.filter(F.col("url").isNotNull()).groupBy(site("url").alias("_site")).agg(F.min("source_id").alias("_sid")).filter("_site <> ''")
    return pages.withColumn("_site", site("url")).join(known, "_site", "left").withColumn("source_id", F.coalesce("source_id", "_sid")).drop("_site", "_sid")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key is not null and missing in ``parent`` (JN6, referential check)."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent and children without the keys of ``gone`` (SNK8). Children with a null key stay."""
    keys = gone.select(key).distinct()
    return parent.join(keys, key, "left_anti"), {n: c.join(keys, key, "left_anti").select(c.columns) for n, c in children.items()}


def delete_prefix(df: DataFrame, prefix: str, column: str = "url") -> DataFrame:
    """Rows whose column does not start with the prefix (SNK7); null stays."""
    return df.filter(F.coalesce(~F.startswith(F.col(column), F.lit(prefix)), F.lit(True)))


def register(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a temporary view (SNK9), read back from it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
