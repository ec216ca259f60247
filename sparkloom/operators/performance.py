"""Statistics of measured searches (AG16, AG17, AG21, RT11, RT12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency(df: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, median, bounds and sample variance of the total time per group, nulls left out of all but the count."""
    t = F.col("total_time_ms")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(t), 6).alias("avg_ms"), F.round(F.median(t), 6).alias("median_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"), F.round(F.var_samp(t), 6).alias("var_ms"),
        F.round(F.avg("result_count"), 6).alias("avg_results"), F.round(F.avg("memory_delta_mb"), 6).alias("avg_memory"),
    )


def change(now: Column, base: Column) -> Column:
    """Percent; null without a positive base."""
    return F.when(base > 0, F.round(100.0 * (now - base) / base, 6))


def status(time: Column, memory: Column, results: Column) -> Column:
    """Regression beats improvement beats stable; checks without a base are left out."""
    worse = F.coalesce(time > 25, F.lit(False)) | F.coalesce(memory > 50, F.lit(False)) | F.coalesce(results < -20, F.lit(False))
    return F.when(worse, "regression_detected").when(F.coalesce(time < -10, F.lit(False)), "improvement_detected").otherwise("stable")


def compare(current: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """``current`` beside ``base`` (both from :func:`latency`) with changes and a status; ``no_baseline`` where base has no row."""
    b = base.select(key, *[F.col(c).alias(f"b_{c}") for c in ("avg_ms", "avg_memory", "avg_results")], F.lit(True).alias("_has"))
    both = current.join(b, key, "left")
    both = both.withColumns({"time_pct": change(F.col("avg_ms"), F.col("b_avg_ms")), "memory_pct": change(F.col("avg_memory"), F.col("b_avg_memory")), "results_pct": change(F.col("avg_results"), F.col("b_avg_results"))})
    what = F.when(F.col("_has").isNull(), "no_baseline").otherwise(status(F.col("time_pct"), F.col("memory_pct"), F.col("results_pct")))
    return both.select(key, "time_pct", "memory_pct", "results_pct", what.alias("status"))
