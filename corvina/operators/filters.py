"""A composable filter algebra.

A ``Filter`` is a name with either a Column predicate or a semi-/anti-join against key rows. A list of
filters folds into one DataFrame; ``skip`` leaves one out, which is what self-excluding facets need.
None anywhere means "no constraint"; a filter on an empty list of values keeps nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access levels and the statuses they cover; an unknown status counts as closed.
ACCESS_LEVELS = {
    "open": ("diamond", "gold", "hybrid", "bronze", "green"),
    "embargo": ("embargoed",),
    "closed": ("closed", "unknown"),
}


@dataclass(frozen=True)
class Filter:
    """One constraint: a predicate, or membership (``anti``: absence) of ``key`` in ``rows``."""

    name: str
    predicate: Column | None = None
    rows: DataFrame | None = None
    key: str | None = None
    anti: bool = False


def fold(df: DataFrame, filters: Iterable[Filter | None], skip: str | None = None) -> DataFrame:
    """``df`` under all filters but those named ``skip``; predicates first, so they reach the scan."""
    live = [f for f in filters if f is not None and f.name != skip]
    for f in live:
        if f.predicate is not None:
            df = df.where(f.predicate)
    for f in live:
        if f.rows is not None:
            df = df.join(f.rows.select(f.key).distinct(), f.key, "left_anti" if f.anti else "left_semi")
    return df


def one_of(name: str, c: Column, values: Sequence | None) -> Filter | None:
    """The value is one of a list; nulls never are."""
    return None if values is None else Filter(name, F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False))


def none_of(name: str, c: Column, values: Sequence | None) -> Filter | None:
    """P5: the value is none of a list; as in SQL, a null value is dropped."""
    return None if not values else Filter(name, ~c.isin(*values))


def access_level(name: str, c: Column, level: str | None) -> Filter | None:
    """A status of the level; a missing status counts as closed."""
    if level is None:
        return None
    hit = c.isin(*ACCESS_LEVELS[level])
    return Filter(name, F.coalesce(hit, F.lit(False)) | (c.isNull() if level == "closed" else F.lit(False)))


def has_row(name: str, rows: DataFrame, key: str, present: bool | None = True) -> Filter | None:
    """A row with the key exists (``present`` False: does not)."""
    return None if present is None else Filter(name, rows=rows.where(F.col(key).isNotNull()), key=key, anti=not present)


def toggle(name: str, flag: Column, yes: bool, no: bool) -> Filter | None:
    """P10: a yes/no pair of boxes; both or neither ticked is no constraint."""
    if yes == no:
        return None
    return Filter(name, F.coalesce(flag, F.lit(False)) if yes else ~F.coalesce(flag, F.lit(False)))


def in_array(name: str, arr: Column, value: str, wanted: bool | None) -> Filter | None:
    """Three states of membership in an array column; a null array has no member."""
    if wanted is None:
        return None
    hit = F.coalesce(F.array_contains(arr, value), F.lit(False))
    return Filter(name, hit if wanted else ~hit)


def overlaps(name: str, arr: Column, values: Sequence[str] | None) -> Filter | None:
    """A common element; a null element on either side matches nothing."""
    if values is None:
        return None
    return Filter(name, F.coalesce(F.exists(arr, lambda x: F.coalesce(x.isin(*values), F.lit(False))), F.lit(False)) if values else F.lit(False))


def search(name: str, c: Column, text: str | None) -> Filter | None:
    """Every word of the text stands in the (folded) column."""
    words = (text or "").split()
    if not words:
        return None
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(c, F.lit(w))
    return Filter(name, F.coalesce(hit, F.lit(False)))


def contains_all(name: str, c: Column, wanted: Sequence[str] = (), unwanted: Sequence[str] = ()) -> Filter | None:
    """Text holds all of ``wanted`` and none of ``unwanted`` (case-insensitive)."""
    if not wanted and not unwanted:
        return None
    low, hit = F.lower(c), F.lit(True)
    for w in wanted:
        hit = hit & F.contains(low, F.lit(w.lower()))
    for w in unwanted:
        hit = hit & ~F.contains(low, F.lit(w.lower()))
    return Filter(name, F.coalesce(hit, F.lit(False)))


def changed(old: Sequence[Column], new: Sequence[Column]) -> Column:
    """Null-safe ``IS DISTINCT FROM`` of two rows."""
    return ~F.struct(*old).eqNullSafe(F.struct(*new))
