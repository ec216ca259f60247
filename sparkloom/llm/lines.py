"""Problem 2: lines that a site repeats across its documents.

Per source the document frequency of every folded line is compared with its frequency outside the source by the
log-likelihood ratio of the two binomial rates; the Benjamini-Hochberg rule bounds the share of false discoveries.
A line that recurs in other sources as well (one footer on many sites) would hide behind them, so only chance counts
outside: a source's occurrence is one if the line does not recur there, and all its rows are exposure. The exact
definition of a repeated line (rows, share and length) is checked last.

Only 16-byte line hashes are shuffled, pre-aggregated per partition; texts never are, except where cleaned texts are
asked for.

Null keys and texts pass through unchanged; null sources have no repeated lines; repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.text import folded_lines

#: Bins of the log-likelihood ratio, from which the discovery threshold is read: width and number bound their table.
BIN_WIDTH, BINS = 0.05, 40_000
#: Rows that are added to those outside a source, with half a chance occurrence: where few rows lie outside, a line is compared with this rate.
PRIOR_ROWS = 1_000


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit("second"), line).alias("_h2")]


def line_counts(df: DataFrame, source: str, text: str, min_chars: int = 20) -> DataFrame:
    """``_src, _h1, _h2, _k``: in how many rows of a source each folded line stands."""
    lines = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(source).alias("_src"), F.explode(F.array_distinct(folded_lines(F.col(text)))).alias("_line")
    )
    return (
        lines.filter(F.length("_line") >= min_chars)
        .select("_src", *_hashes(F.col("_line")))
        .groupBy("_src", "_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_k"))
    )


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Twice the log of the likelihood ratio of two binomial rates against one common rate; 0 unless the first is higher."""
    p = (k1 + k2) / (n1 + n2)

    def part(k: Column, n: Column) -> Column:
        own = k / n
        hit = F.when(k > 0, k * F.log(own / p)).otherwise(0.0)
        return hit + F.when(n > k, (n - k) * F.log((F.lit(1.0) - own) / (F.lit(1.0) - p))).otherwise(0.0)

    return F.when(k1 / n1 > k2 / n2, 2.0 * (part(k1, n1) + part(k2, n2))).otherwise(F.lit(0.0))


def excess_lines(
    df: DataFrame, source: str, text: str, min_chars: int = 20, min_rows: int = 5, min_share: float = 0.1, fdr: float = 0.05
) -> DataFrame:
    """``_src, _h1, _h2, n_rows, share, llr``: the lines found to be repeated excessively in their source.

    All (source, line) pairs of at least two rows are tested. The tail probability of a ratio is bounded by
    ``exp(-llr / 2) / 2``; with m tests, r of which reach the ratio, it is a discovery if m * p / r <= ``fdr``.
    """
    totals = df.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    every = totals.agg(F.sum("_n").alias("_all"))
    tested = line_counts(df, source, text, min_chars).join(totals, "_src")
    # Chance occurrences of a line: those in sources where it stands once. Lines of a single row anywhere are not tested.
    per_line = tested.groupBy("_h1", "_h2").agg(F.count_if(F.col("_k") == 1).alias("_once"), F.max("_k").alias("_max_k")).filter("_max_k > 1")
    scored = (
        tested.filter("_k > 1")
        .join(per_line, ["_h1", "_h2"])
        .crossJoin(F.broadcast(every))  # one row
        .withColumn("_n2", F.col("_all") - F.col("_n") + F.lit(float(PRIOR_ROWS)))
        .withColumn("_k2", F.least(F.col("_once") + F.lit(0.5), F.col("_n2")))
        .withColumn("llr", _llr(F.col("_k").cast("double"), F.col("_n").cast("double"), F.col("_k2"), F.col("_n2")))
        .withColumn("_bin", F.least(F.floor(F.col("llr") / BIN_WIDTH), F.lit(BINS)))
    )
    bins = scored.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    ranked = bins.select(  # at most BINS + 1 rows
        "_bin", F.sum("_c").over(W.orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, 0)).alias("_r"), F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_m")
    )
    found = ranked.filter(F.lit(0.5) * F.exp(-F.col("_bin") * BIN_WIDTH / 2) * F.col("_m") / F.col("_r") <= fdr)
    repeated = (F.col("_k") >= min_rows) & (F.col("_k") >= min_share * F.col("_n"))
    limit = found.agg(F.coalesce(F.min("_bin"), F.lit(BINS + 1)).alias("_limit"))
    return (
        scored.crossJoin(F.broadcast(limit))  # one row
        .filter((F.col("_bin") >= F.col("_limit")) & repeated)
        .select("_src", "_h1", "_h2", F.col("_k").alias("n_rows"), (F.col("_k") / F.col("_n")).alias("share"), "llr")
    )


def _numbered(df: DataFrame, key: str, source: str, text: str, min_chars: int) -> DataFrame:
    lines = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(source).alias("_src"), F.posexplode(folded_lines(F.col(text))).alias("_pos", "_line")
    )
    return lines.filter(F.length("_line") >= min_chars).select("_key", "_src", "_pos", *_hashes(F.col("_line")))


def find_repeated(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content", min_chars: int = 20, **rule: float) -> DataFrame:
    """``key, line_no`` (from 1) of every line that is repeated in its source."""
    found = excess_lines(df, source, text, min_chars, **rule).select("_src", "_h1", "_h2")
    return (
        _numbered(df, key, source, text, min_chars)
        .join(found, ["_src", "_h1", "_h2"], "left_semi")
        .select(F.col("_key").alias(key), (F.col("_pos") + 1).cast("int").alias("line_no"))
    )


def _row(key: str, source: str, text: str) -> list[Column]:
    """Two hashes of what a row is told by: its key, source and text, nulls told from each other."""
    parts = [F.col(key).isNull(), F.col(key), F.col(source), F.col(text)]
    return [F.xxhash64(*parts).alias("_r1"), F.xxhash64(F.lit("second"), *parts).alias("_r2")]


def remove_repeated(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content", min_chars: int = 20, **rule: float) -> DataFrame:
    """``df`` with its repeated lines taken out of ``text``; rows without such lines come out as they are.

    The (source, line) hashes of every line are matched with the excess lines, which gives the positions to be removed in
    each row; a row is its key, source and text, so rows that share a key and differ in source or text don't touch each
    other. The lines of a row are anti-joined with its positions inside the row and put together again by position, so
    texts are shuffled once and lines never.
    """
    names = df.columns
    rows = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull())
    lines = rows.select(*_row(key, source, text), F.col(source).alias("_src"), F.posexplode(folded_lines(F.col(text))).alias("_pos", "_line"))
    lines = lines.filter(F.length("_line") >= min_chars).select("_r1", "_r2", "_src", "_pos", *_hashes(F.col("_line")))
    found = excess_lines(df, source, text, min_chars, **rule).select("_src", "_h1", "_h2")
    gone = lines.join(found, ["_src", "_h1", "_h2"], "left_semi").groupBy("_r1", "_r2").agg(F.collect_set("_pos").alias("_gone"))
    own = F.split(F.col(text), "\n")
    kept = F.filter(own, lambda line, i: ~F.array_contains(F.col("_gone"), i))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    marked = df.select("*", *_row(key, source, text)).join(gone, ["_r1", "_r2"], "left")
    return marked.withColumn(text, clean).select(*names)
