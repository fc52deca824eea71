"""Extraction of five catalogues page by page, as a Python data source.

A slice (a year, a set of collections, an institution) is one input partition and is paged in order, since
each page names the next; slices run side by side on the executors. The transport is a picklable function
``(source, request) -> dict`` given by the caller, so nothing here needs a network. A request that fails is
retried; after ``max_failures`` failures in a row the read raises ``SourceUnavailable``, so a partial result
is never taken for a whole one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], dict]
SCHEMA = "source string, source_id string, doi string, raw_data string, slice string"
# Fixed value: the highest first record that one WoS query may ask for.
WOS_LAST = 100_000


class SourceUnavailable(RuntimeError):
    """A source failed too often in a row."""


class Breaker:
    """Calls a transport; counts failures in a row, and raises at the threshold."""

    def __init__(self, source: str, transport: Transport, threshold: int = 10):
        self.source, self.transport, self.threshold, self.failures = source, transport, threshold, 0

    def __call__(self, request: dict) -> dict:
        while True:
            try:
                page = self.transport(self.source, request)
            except OSError as e:
                self.failures += 1
                if self.failures >= self.threshold:
                    raise SourceUnavailable(f"{self.source}: {self.failures} failures in a row") from e
                continue
            self.failures = 0
            return page


def _marked(get: Breaker, first: dict, items, following) -> Iterator[dict]:
    """Pages that name the next one by a mark; ends at an empty page, without a mark, or when the mark repeats."""
    mark = first["mark"]
    while True:
        page = get(first | {"mark": mark})
        got = items(page)
        yield from got
        after = following(page, got)
        if not got or after is None or after == mark:
            return
        mark = after


def hal(get: Breaker, part: dict) -> Iterator[dict]:
    """The union of collections, for years or since a date. Wide slices of several collections ask for smaller pages, since their records are long."""
    rows = int(part.get("rows", 500 if len(part.get("collections", [])) <= 1 else 100))
    first = {"collections": part.get("collections", []), "years": part.get("years"), "since": part.get("since"), "rows": rows, "mark": "*"}
    return _marked(get, first, lambda p: p.get("response", {}).get("docs", []), lambda p, _: p.get("nextCursorMark"))


def openalex(get: Breaker, part: dict) -> Iterator[dict]:
    """S3: by year, or changed since a date."""
    first = {"institutions": part.get("institutions", []), "year": part.get("year"), "since": part.get("since"), "mark": "*"}
    return _marked(get, first, lambda p: p.get("results", []), lambda p, _: (p.get("meta") or {}).get("next_cursor"))


def scanr(get: Breaker, part: dict) -> Iterator[dict]:
    """A year, each page after the sort value of the last hit."""
    first = {"year": part.get("year"), "affiliations": part.get("affiliations", []), "mark": None}
    hits = _marked(get, first, lambda p: p["hits"]["hits"], lambda _, got: got[-1].get("sort") if got else None)
    return (h["_source"] for h in hits)


def theses(get: Breaker, part: dict) -> Iterator[dict]:
    """An institution by offset; with a year only the theses whose number starts with it."""
    start, total = 0, 1
    while start < total:
        page = get({"ppn": part["ppn"], "start": start, "rows": int(part.get("rows", 500))})
        total, got = int(page.get("totalHits", 0)), page.get("theses", [])
        if not got:
            if start < total:
                raise SourceUnavailable(f"theses: an empty page at {start} of {total}")
            return
        start += len(got)
        year = part.get("year")
        yield from (t for t in got if year is None or str(t.get("nnt") or t.get("id") or "").startswith(str(year)))


def wos(get: Breaker, part: dict) -> Iterator[dict]:
    """A year by the number of the first record, within the quota ``budget`` of requests; a slice that can't be read whole raises."""
    first, total, used, empty = 1, 1, 0, 0
    budget = part.get("budget")
    while first <= total:
        if budget is not None and used >= budget:
            raise SourceUnavailable(f"wos: quota of {budget} requests used at record {first} of {total}")
        if first > WOS_LAST:
            raise ValueError(f"wos: a slice of {total} records is longer than {WOS_LAST}; split it")
        page = get({"year": part.get("year"), "affiliations": part.get("affiliations", []), "first": first})
        used += 1
        total, got = int(page.get("found", 0)), page.get("records", [])
        if not got and first <= total:
            empty += 1
            if empty >= 3:
                raise SourceUnavailable(f"wos: 3 empty pages at record {first} of {total}")
            continue
        empty = 0
        first += len(got)
        yield from got
        if not total:
            return


#: Each source: how a slice is paged, and where a record has its id and DOI.
SOURCES: dict[str, tuple[Callable[[Breaker, dict], Iterator[dict]], Callable[[dict], object], Callable[[dict], object]]] = {
    "hal": (hal, lambda r: r.get("halId_s"), lambda r: r.get("doiId_s")),
    "openalex": (openalex, lambda r: (r.get("id") or "").rsplit("/", 1)[-1], lambda r: r.get("doi")),
    "scanr": (scanr, lambda r: r.get("id"), lambda r: next((e.get("id") for e in r.get("externalIds") or [] if e.get("type") == "doi"), None)),
    "theses": (theses, lambda r: r.get("nnt") or r.get("id"), lambda r: r.get("doi")),
    "wos": (wos, lambda r: r.get("UID"), lambda r: None),
}


class Slice(InputPartition):
    def __init__(self, part: dict):
        self.part = part


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.source, self.transport = options["source"], transport
        if self.source not in SOURCES:
            raise ValueError(f"unknown source {self.source!r}")
        self.slices, self.most = json.loads(options["slices"]), int(options.get("max_failures", "10"))

    def partitions(self) -> list[Slice]:
        return [Slice(p) for p in self.slices]

    def read(self, partition: Slice):
        pages, ident, doi = SOURCES[self.source]
        name = json.dumps(partition.part, sort_keys=True)
        for record in pages(Breaker(self.source, self.transport, self.most), partition.part):
            if i := ident(record):
                d = doi(record)
                yield self.source, str(i), None if d is None else str(d), json.dumps(record, ensure_ascii=False), name


def catalogue(transport: Transport) -> type[DataSource]:
    """A data source over ``transport``: ``spark.read.format("catalogue").option("source", ...).option("slices", json)``; records without id are left out."""

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return "catalogue"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> CatalogueReader:
            return CatalogueReader(dict(self.options), transport)

    return Catalogue


def register(spark: SparkSession, transport: Transport) -> None:
    spark.dataSource.register(catalogue(transport))


def fetch_all(keys, fetch: Callable[[str], dict | None], key: str, workers: int = 8, most: int = 10):
    """(key, raw_data, status) of one request for each distinct key: ``found``, ``missing``, or ``failed`` once the source is given up.

    Keys are spread over ``workers`` tasks, so at most so many requests run at a time. A task that fails
    ``most`` times in a row fails the rest of its keys without asking, to be tried by the next run.
    """
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        row = 0
        for pdf in batches:
            out = []
            for k in pdf[key]:
                if row >= most:
                    out.append((k, None, "failed"))
                    continue
                try:
                    got, row = fetch(k), 0
                    out.append((k, None if got is None else json.dumps(got, ensure_ascii=False), "missing" if got is None else "found"))
                except OSError:
                    row += 1
                    out.append((k, None, "failed"))
            yield pd.DataFrame(out, columns=[key, "raw_data", "status"])

    return keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().repartition(workers).mapInPandas(run, f"`{key}` string, raw_data string, status string")
