"""Catalogue of the core queries and of the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamiz.plans import analysis, capture, exchange, governance, more, profiles, records, reports, scoring, temporal
from tamiz.session import table

Query = Callable[[SparkSession, str], DataFrame]
ALL = {**analysis.QUERIES, **records.QUERIES, **temporal.QUERIES, **more.QUERIES, **scoring.QUERIES, **reports.QUERIES, **governance.QUERIES, **capture.QUERIES, **exchange.QUERIES, **profiles.QUERIES}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.operators.timestamps import p7_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "medios"))


def queries() -> dict[str, Query]:
    return {"p7_found": p7_found} | {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
