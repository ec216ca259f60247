"""A bounded, repeatable sample of rows, taken where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1_000_000_000


def by_hash(df: DataFrame, value: Column, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more): those whose hash of ``value`` falls below a threshold.

    One count and a filter: nothing is sorted or shuffled, and a task's share doesn't grow with the table. Equal values
    are taken or left together, so a value that makes up a third of all rows may add that much; ``distinct`` first
    where that matters.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), value), F.lit(_STEPS)) < int(_STEPS * rows / total))
