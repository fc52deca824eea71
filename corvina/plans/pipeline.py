"""Ordered phases over a dict of tables: selection by ``only`` / ``start``, timing, run log."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvina.sources.io import RunLog

Tables = dict[str, DataFrame]
Phase = Callable[[SparkSession, Tables], Tables]


def select(phases: dict[str, Phase], only: list[str] | None = None, start: str | None = None) -> dict[str, Phase]:
    """The phases to run, in declared order; unknown names raise ValueError."""
    for n in [*(only or []), *([start] if start else [])]:
        if n not in phases:
            raise ValueError(f"unknown phase {n!r}")
    names = list(phases)
    if start:
        names = names[names.index(start) :]
    return {n: phases[n] for n in names if only is None or n in only}


def run(spark: SparkSession, tables: Tables, phases: dict[str, Phase], log: RunLog | None = None, only: list[str] | None = None, start: str | None = None) -> Tables:
    """Runs the phases; a failing one is logged and ends the run. Phases are lazy, so tables can be chained without a write."""
    run_id = uuid.uuid4().hex
    for name, phase in select(phases, only, start).items():
        began = time.time()
        try:
            new = phase(spark, tables)
            tables = {**tables, **new}
            status, metrics = "ok", {"tables": sorted(new)}
        except Exception as e:
            if log:
                log.add(run_id, name, "failed", time.time() - began, {"error": str(e)[:500]})
            raise
        if log:
            log.add(run_id, name, status, time.time() - began, metrics)
    return tables
