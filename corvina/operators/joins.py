"""Joins beyond plain equality, each as an equi-join with residual conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_within(df: DataFrame, key: str, ident: str, keep: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs (a.id < b.id) of rows with the same non-null key; ``keep`` columns get _a and _b."""
    d = df.where(F.col(key).isNotNull())
    side = lambda s: d.select(key, F.col(ident).alias(f"{ident}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in keep])
    return side("a").join(side("b"), key).where(F.col(f"{ident}_a") < F.col(f"{ident}_b"))


def endings(c: Column, least: int = 1) -> Column:
    """All endings of a text with ``least`` characters or more, the whole text included; none of shorter texts."""
    n = F.length(c)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - (least - 1)), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def suffix_join(left: DataFrame, text: str, right: DataFrame, ending: str, least: int = 1) -> DataFrame:
    """Rows of ``left`` whose ``text`` ends with ``ending`` of ``right``, of ``least`` characters or more, at any place.

    The endings are exploded as hashes and met by equality, so no nested loop is needed; the texts are
    compared after that. Empty endings meet nothing.
    """
    l = left.withColumn("__h", F.explode(F.transform(endings(F.col(text), least), lambda x: F.xxhash64(x))))  # noqa: E741
    r = right.where((F.col(ending) != "") & (F.length(ending) >= least)).withColumn("__h", F.xxhash64(ending))
    return l.join(r, "__h").where(F.endswith(F.col(text), F.col(ending))).drop("__h")


def unique_match(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Matches of a child only if it has exactly one distinct parent."""
    one = df.groupBy(child).agg(F.count_distinct(parent).alias("__n"), F.min(parent).alias(parent)).where("__n = 1")
    return one.select(child, parent)


def range_join(left: DataFrame, right: DataFrame, key: str, lcol: str, rcol: str, lo: int, hi: int) -> DataFrame:
    """Equal ``key`` and ``rcol`` within [lcol + lo, lcol + hi]. The range is bucketed into the equi-key, so a hot key is spread."""
    width = max(1, hi - lo + 1)
    l = left.withColumn("__b", F.explode(F.sequence(F.floor((F.col(lcol) + lo) / width), F.floor((F.col(lcol) + hi) / width))))  # noqa: E741
    r = right.withColumn("__b", F.floor(F.col(rcol) / width))
    return l.join(r, [key, "__b"]).where((F.col(rcol) >= F.col(lcol) + lo) & (F.col(rcol) <= F.col(lcol) + hi)).drop("__b")


def element_join(left: DataFrame, larr: str, right: DataFrame, rarr: str) -> DataFrame:
    """Rows whose arrays share an element: explode and equi-join; the element is kept as ``element``."""
    return left.withColumn("element", F.explode(F.array_distinct(larr))).join(right.withColumn("element", F.explode(F.array_distinct(rarr))), "element")


def element_counts(df: DataFrame, ident: str, arr: str, chosen: Column) -> DataFrame:
    """(element, n): pairs of a row and another ``chosen`` one that share the element, counted without listing them.

    Each chosen row of an element meets all rows of it but itself. Rows of one ``ident`` are one row, chosen if any is.
    """
    e = df.where(F.col(ident).isNotNull()).select(ident, F.explode(arr).alias("element"), F.coalesce(chosen, F.lit(False)).alias("__c")).where("element is not null")
    e = e.groupBy(ident, "element").agg(F.max("__c").alias("__c"))
    n = e.groupBy("element").agg(F.count(F.lit(1)).alias("all"), F.count_if("__c").alias("some"))
    return n.select("element", (F.col("some") * (F.col("all") - 1)).alias("n")).where("n > 0")


def map_entries(df: DataFrame, ident: str, m: Column) -> DataFrame:
    """(ident, kind, value) of a JSON or map column."""
    return df.select(ident, F.explode(m).alias("kind", "value")).where("value is not null")


def null_safe_key(*cols: Column) -> Column:
    """An md5 key under which nulls are equal and differ from empty texts."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x01")) for c in cols]))


def longest_prefix(df: DataFrame, text: str, prefixes: DataFrame, prefix: str, target: str) -> DataFrame:
    """``target`` of the longest ``prefix`` that ``text`` starts with; null if none, or if two targets tie.

    Prefix lengths are few, so each text is cut to those lengths and met by equality.
    """
    p = prefixes.where(F.col(prefix).isNotNull() & (F.col(prefix) != "")).groupBy(prefix).agg(F.min(target).alias(target), F.count_distinct(target).alias("__t"))
    lengths = F.array_sort(F.collect_set(F.length(prefix)))
    sizes = p.agg(lengths.alias("__l"))
    d = df.crossJoin(F.broadcast(sizes)).withColumn("__p", F.explode_outer(F.transform("__l", lambda n: F.substring(F.col(text), F.lit(1), n))))
    hit = d.join(p.withColumnRenamed(prefix, "__p"), "__p").where(F.startswith(F.col(text), F.col("__p")))
    best = hit.groupBy(text).agg(F.max_by(F.struct(target, "__t"), F.length("__p")).alias("b"))
    best = best.select(text, F.when(F.col("b.__t") == 1, F.col(f"b.{target}")).alias(target))
    return df.join(best, text, "left")


def conditional_columns(df: DataFrame, key: str, by: str, values: Sequence[str], agg: Column) -> DataFrame:
    """One column for each value of ``by``: what a lateral join per row would fetch, in one aggregate."""
    return df.groupBy(key).pivot(by, list(values)).agg(agg)


def shared_values(pairs: DataFrame, a: str, b: str, facts: DataFrame, ident: str, value: str) -> DataFrame:
    """Number of distinct values that both members of each pair have (0 included)."""
    f = facts.select(F.col(ident).alias("__i"), F.col(value).alias("__v")).where("__v is not null").distinct()
    fa, fb = f.select(F.col("__i").alias(a), "__v"), f.select(F.col("__i").alias(b), F.col("__v").alias("__w"))
    n = pairs.join(fa, a).join(fb, b).where("__v = __w").groupBy(a, b).agg(F.count_distinct("__v").alias("shared"))
    return pairs.join(n, [a, b], "left").fillna(0, ["shared"])
