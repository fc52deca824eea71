"""The declarative pivot: one measure by whitelisted dimensions.

A ``Registry`` binds names to expressions and to the joins they need; a request is validated against it
and only the joins of the requested dimensions are made. No dimension gives one total row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    expr: Column
    join: str | None = None
    ordinal: bool = False
    groupable: bool = True


@dataclass(frozen=True)
class Registry:
    measures: dict[str, Column]
    dimensions: dict[str, Dimension]
    joins: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def validate(self, measure: str, by: list[str]) -> None:
        """Raises ValueError for unknown, repeated or non-groupable names."""
        if measure not in self.measures:
            raise ValueError(f"unknown measure {measure!r}")
        for d in by:
            if d not in self.dimensions:
                raise ValueError(f"unknown dimension {d!r}")
            if not self.dimensions[d].groupable:
                raise ValueError(f"dimension {d!r} can't be grouped")
        if len(set(by)) != len(by):
            raise ValueError("a dimension is repeated")


def pivot(base: DataFrame, registry: Registry, measure: str, by: list[str]) -> DataFrame:
    """Rows (dimensions, value) ordered by ordinal dimensions, then by value from high to low, then by the rest."""
    registry.validate(measure, by)
    for j in dict.fromkeys(registry.dimensions[d].join for d in by if registry.dimensions[d].join):
        base = registry.joins[j](base)
    agg = registry.measures[measure].alias("value")
    if not by:
        return base.agg(agg)
    out = base.groupBy(*[registry.dimensions[d].expr.alias(d) for d in by]).agg(agg)
    ordinal = [F.asc_nulls_last(d) for d in by if registry.dimensions[d].ordinal]
    rest = [F.asc_nulls_last(d) for d in by if not registry.dimensions[d].ordinal]
    return out.orderBy(*ordinal, F.desc_nulls_last("value"), *rest)
