"""Aggregations of the serving and resolution layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_set(c: Column) -> Column:
    """Distinct non-null values in order."""
    return F.array_sort(F.collect_set(c))


def joined_set(c: Column, sep: str = ", ") -> Column:
    """Distinct non-null texts in order, joined."""
    return F.array_join(sorted_set(c.cast("string")), sep)


def rank_of(c: Column, order: Sequence[str]) -> Column:
    """Position of a value in a declared order (an enum, a list of priorities); others come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order) + 1).otherwise(at)


def first_by_priority(value: Column, *order: Column) -> Column:
    """The value of the first row, by ``order``, that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def consensus(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smaller: (keys, value, n). Null values don't vote."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(best, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(value).alias(value)).select(*keys, value, "n")


def modes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All most frequent values of each key, sorted: (keys, values, n)."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(best, [*keys, "n"]).groupBy(*keys, "n").agg(sorted_set(F.col(value)).alias("values")).select(*keys, "values", "n")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes partitions with a rank limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. One aggregate of a struct, so no group is sorted or held whole.

    ``order`` must be plain columns, ascending with nulls last, or ``neg`` columns made by the caller.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"o{i}"))])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("r")).select(*keys, "r.*")


def co_occurrence(df: DataFrame, item: str, group: str, least: int = 2) -> DataFrame:
    """(a, b, n) of items a < b that share at least ``least`` groups; repeated rows count once.

    Pairs are made per group by an equi-join, counted with map-side combine.
    """
    d = df.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    pairs = d.select("g", F.col("i").alias("a")).join(d.select("g", F.col("i").alias("b")), "g").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def usage(df: DataFrame, item: str, group: str) -> DataFrame:
    """Distinct groups of each item: (item, n)."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(group).alias("n"))


def rollup_counts(facts: DataFrame, fact_key: str, child: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Counts of facts by child and, from those, by parent; children and parents without facts have 0."""
    n = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias(child_key)).agg(F.count(F.lit(1)).alias("n"))
    by_child = child.select(child_key, parent_key).join(n, child_key, "left").select(child_key, parent_key, F.coalesce("n", F.lit(0)).alias("n"))
    by_parent = by_child.where(F.col(parent_key).isNotNull()).groupBy(parent_key).agg(F.sum("n").alias("n"))
    return by_child, by_parent


def confusion(truth: Column, guess: Column) -> list[Column]:
    """Counts of true/false positives and negatives, and of rows not yet decided (null truth)."""
    when = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return [when(truth & guess, "tp"), when(~truth & ~guess, "tn"), when(~truth & guess, "fp"), when(truth & ~guess, "fn"), when(truth.isNull(), "pending")]


def with_total(df: DataFrame, n: str = "n") -> DataFrame:
    """A share of the total beside each count; the total is a one-row aggregate, not a window over one partition."""
    total = df.agg(F.sum(n).alias("total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col(n), F.col("total")))
