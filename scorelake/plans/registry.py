"""All queries of the engine with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from scorelake.plans.common import Query

MODULES = ("sequences", "metrics", "catalogue", "models", "files", "report", "runs")


def _catalogues():
    return [importlib.import_module(f"scorelake.plans.{name}").C for name in MODULES]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for c in _catalogues():
        if both := out.keys() & c.queries.keys():
            raise ValueError(f"queries named twice: {sorted(both)}")
        out |= c.queries
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in _catalogues() for name, sql in c.sql.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Next-token prediction by an interpolated back-off Markov model, scored per piece."""
    return queries()["m0_vomm_piece_nll"](spark, folder)
