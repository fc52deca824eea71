"""Self-excluding facets: each facet applies every filter but its own.

All facets come from one scan: each filter becomes a flag, each row the set of filters it fails, and a
row counts for a facet if it fails none or only the facet's own. Rows are exploded into (facet, value)
pairs and pre-aggregated before one shuffle, so the number of facets costs no further scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.filters import Filter


def facets(df: DataFrame, dims: dict[str, Column], filters: list[Filter | None], key: Column | None = None) -> DataFrame:
    """(facet, value, n) with n the rows (or distinct ``key``) under all filters but the facet's own.

    Filters must be predicates named after the dimension they constrain. A null value is a facet value.
    """
    live = [f for f in filters if f is not None]
    flags = [(f.name, F.coalesce(f.predicate, F.lit(False))) for f in live]
    failed = F.array_compact(F.array(*[F.when(~p, F.lit(n)) for n, p in flags])) if flags else F.array().cast("array<string>")
    rows = df.select(
        failed.alias("failed"),
        *([key.alias("key")] if key is not None else []),
        F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in dims.items()]).alias("fs"),
    ).where(F.size("failed") <= 1)
    rows = rows.select(*(["key"] if key is not None else []), "failed", F.explode("fs").alias("f")).where(
        (F.size("failed") == 0) | (F.col("failed")[0] == F.col("f.facet"))
    )
    n = F.count(F.lit(1)) if key is None else F.count_distinct("key")
    return rows.groupBy("f.facet", "f.value").agg(n.alias("n"))


def zero_filled(counts: DataFrame, options: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """One row for each option of a fixed list, 0 where none was counted."""
    opts = counts.sparkSession.createDataFrame([(o,) for o in options], f"{value} string")
    return opts.join(counts, value, "left").select(value, F.coalesce(n, F.lit(0)).alias(n))


def top_entities(df: DataFrame, entity: str, label: str, limit: int, counted: Column | None = None) -> DataFrame:
    """The ``limit`` entities with most rows (or distinct ``counted``), ties by label."""
    n = F.count(F.lit(1)) if counted is None else F.count_distinct(counted)
    return df.groupBy(entity, label).agg(n.alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(label)).limit(limit)
