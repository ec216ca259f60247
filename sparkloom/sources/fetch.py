"""Fetching of pages (SRC5, SRC6) behind an interface: a service provides a fetcher, tests and offline runs a local one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives the markup of an address, or None where there is none; errors count as None. Must be picklable.
Fetcher = Callable[[str], "str | None"]
AT_ONCE = 10


def fetch(urls: DataFrame, fetcher: Fetcher, at_once: int = AT_ONCE, partitions: int | None = None) -> DataFrame:
    """``url, html, success`` of the distinct non-null addresses of ``urls`` (``url``), at most ``at_once`` in flight per task."""

    def get(url: str) -> str | None:
        try:
            return fetcher(url)
        except Exception:  # noqa: BLE001  a page that fails is a row without success
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(get, batch["url"]))
                yield pd.DataFrame({"url": batch["url"], "html": pd.Series(found, dtype="object"), "success": [x is not None for x in found]})

    own = urls.filter(F.col("url").isNotNull()).select("url").distinct()
    spread = own.repartition(partitions, "url") if partitions else own
    return spread.mapInPandas(run, "url string, html string, success boolean")


def fetched_pages(urls: DataFrame, fetcher: Fetcher, at_once: int = AT_ONCE) -> DataFrame:
    """``url, markdown`` of the pages that came with content that is not blank (SRC6, FLT13), as the first tier of extraction gives it."""
    from sparkloom.operators import html

    text = html.clean(html.to_markdown(html.main_part(F.col("html"))))
    return fetch(urls, fetcher, at_once).filter("success").select("url", text.alias("markdown")).filter("markdown <> ''")
