"""Queries over the operators of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamiz.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.residue import p1_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "prospectos"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.names import p2_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "prospectos"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.boilerplate import p3_found as op

    return op(table(spark, d, "prospectos"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.truncation import p4_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "medios"))


def p4_tasas(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.truncation import p4_tasas as op

    return op(table(spark, d, "evidencias"), table(spark, d, "medios"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.batchdedup import p5_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "medios"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.encoding import p6_found as op

    return op(table(spark, d, "evidencias"), table(spark, d, "prospectos"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.tokenizer import p8_ids as op

    return op(table(spark, d, "documents"))


def p9_asignacion(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.packing import p9_asignacion as op

    return op(table(spark, d, "documents"), table(spark, d, "capacidades"))


def p9_resumen(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.packing import p9_resumen as op

    return op(table(spark, d, "documents"), table(spark, d, "capacidades"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from tamiz.llm.sentences import p10_found as op

    return op(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_tasas": p4_tasas, "p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_asignacion": p9_asignacion, "p9_resumen": p9_resumen, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {}
