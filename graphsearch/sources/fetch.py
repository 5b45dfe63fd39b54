"""Pages from the web, by any function that fetches one; the engine itself has no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphsearch.functions.constants import CATEGORIES

#: Tries, seconds of a try and of the first pause, and pages of a listing.
TRIES, TIMEOUT, PAUSE, PAGES = 3, 15, 1.5, 50


def fetch(url: str, get: Callable[[str, float], str], tries: int = TRIES, timeout: float = TIMEOUT, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """What get(url, timeout) gives, tried so often with longer and longer pauses; None if it never does."""
    for n in range(1, tries + 1):
        try:
            return get(url, timeout)
        except Exception:  # noqa: BLE001  whatever a fetcher raises
            if n < tries:
                sleep(pause * n)
    return None


def fetch_pages(urls: DataFrame, get: Callable[[str, float], str], **options) -> DataFrame:
    """(url, html) of urls(url); html is null where fetching failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("url").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([fetch(url, get, **options)], pa.string())], ["url", "html"])

    return urls.select("url").mapInArrow(run, "url string, html string")


def list_articles(listing: DataFrame, get_links: Callable[[int, str, str, int], list[str]], pages: int = PAGES) -> DataFrame:
    """Distinct urls of listing(category_id, from, to): each row's pages are read until one has no new link; get_links(category, from, to, page) gives a page's article links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen: dict[str, None] = {}
                for page in range(1, pages + 1):
                    fresh = [u for u in dict.fromkeys(get_links(row["category_id"], str(row["from"]), str(row["to"]), page)) if u not in seen]
                    if not fresh:
                        break
                    seen.update(dict.fromkeys(fresh))
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["url"])

    return listing.select("category_id", "from", "to").mapInArrow(run, "url string").dropDuplicates(["url"])


def categories(spark) -> DataFrame:
    """(category, category_id) of the listing."""
    return spark.createDataFrame(list(CATEGORIES.items()), "category string, category_id int")
