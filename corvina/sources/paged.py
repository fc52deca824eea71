"""Pages of JSON lines files as a Python data source: one input partition a slice of pages.

The folder must be one that driver and executors share. ``fetch(page, options)`` is a picklable function.
A page that can't be read is retried, and after ``max_failures`` failures the read raises, so that a partial
result is never taken for a whole one.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(InputPartition):
    def __init__(self, pages: list):
        self.pages = pages


def fetch_file(page: str, options: dict) -> Iterator[tuple[str, str]]:
    """(source_id, raw_data) of each line of a page file; unreadable lines keep an empty id."""
    with open(page, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if not line:
                continue
            try:
                ident = json.loads(line).get(options.get("id_field", "id"))
            except (ValueError, AttributeError):
                ident = None
            yield "" if ident is None else str(ident), line


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.options, self.fetch = dict(options), fetch

    def partitions(self) -> list[Pages]:
        pages = sorted(glob.glob(os.path.join(self.options["path"], "*.jsonl")))
        n = max(1, min(len(pages), int(self.options.get("slices", "8"))))
        return [Pages(pages[i::n]) for i in range(n)]

    def read(self, partition: Pages):
        most = int(self.options.get("max_failures", "3"))
        for page in partition.pages:
            for attempt in range(1, most + 1):
                try:
                    rows = list(self.fetch(page, self.options))  # one page
                    break
                except OSError as e:
                    if attempt == most:
                        raise RuntimeError(f"page {page} failed {most} times") from e
            for ident, raw in rows:
                yield self.options.get("source", ""), ident, raw


class PagedSource(DataSource):
    """``spark.read.format("paged").option("path", dir).option("source", name)``: source, source_id, raw_data."""

    fetch = staticmethod(fetch_file)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "source string, source_id string, raw_data string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, type(self).fetch)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
