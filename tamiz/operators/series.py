"""Time series per key: sparse counts, trend, stability, inflections, volatility, scenarios, maturity.

A series is long-form (``clave``, ``periodo``, ``n``). Empty periods are not filled unless asked. Every measure is one
window pass and one aggregation per key; a key has as many rows as periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def monthly(rows: DataFrame, key: str, month: str) -> DataFrame:
    """Counts by key and month; rows without key or month are left out."""
    return rows.where(F.col(key).isNotNull() & F.col(month).isNotNull()).groupBy(F.col(key).alias("clave"), F.col(month).alias("periodo")).agg(F.count("*").alias("n"))


def measures(series: DataFrame) -> DataFrame:
    """Per key: periods, first, last, slope of least squares, mean, deviation, range, and how often the direction turns.

    Keys with one period have slope 0 and no turns.
    """
    w = W.partitionBy("clave").orderBy("periodo")
    s = series.withColumn("x", F.row_number().over(w) - 1).withColumn("delta", F.col("n") - F.lag("n").over(w))
    s = s.withColumn("previa", F.lag("delta").over(w)).withColumn("giro", (F.col("delta") * F.col("previa") < 0).cast("long"))
    return s.groupBy("clave").agg(
        F.count("*").alias("periodos"), F.min_by("n", "periodo").alias("primero"), F.max_by("n", "periodo").alias("ultimo"), F.sum("n").alias("total"), F.max("n").alias("maximo"), F.min("n").alias("minimo"),
        F.coalesce(F.regr_slope(F.col("n").cast("double"), F.col("x").cast("double")), F.lit(0.0)).alias("pendiente"), F.coalesce(F.stddev_pop("n"), F.lit(0.0)).alias("desviacion"), F.coalesce(F.sum("giro"), F.lit(0)).alias("giros"),
    )


def profile(series: DataFrame) -> DataFrame:
    """Trend, stability (0 to 100), volatility (0 to 100) and three scenarios for the next period."""
    m = measures(series)
    mean = F.col("total") / F.col("periodos")
    cv = F.when(mean > 0, F.col("desviacion") / mean).otherwise(0.0)
    stable = F.when(F.col("periodos") < 2, 100.0).otherwise(100.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)))
    turns = F.when(F.col("periodos") > 2, F.col("giros") / (F.col("periodos") - 2)).otherwise(0.0)
    span = F.when(F.col("maximo") > 0, (F.col("maximo") - F.col("minimo")) / F.col("maximo")).otherwise(0.0)
    volatile = F.when(F.col("periodos") < 3, 0.0).otherwise(100.0 * F.least(F.lit(1.0), 0.6 * turns + 0.4 * span))
    fixed = lambda c: F.floor(c + 0.5 + 1e-9)
    m = m.withColumn("estabilidad", fixed(stable)).withColumn("volatilidad", fixed(volatile)).withColumn("pendiente_mil", fixed(F.col("pendiente") * 1000))
    swing = F.col("volatilidad") / 100.0 * (F.col("maximo") - F.col("minimo"))
    base = F.greatest(F.lit(0.0), F.col("ultimo") + F.col("pendiente_mil") / 1000.0)
    trend = F.when(F.col("pendiente_mil") > 50, "creciente").when(F.col("pendiente_mil") < -50, "decreciente").otherwise("estable")
    return m.select(
        "clave", "periodos", "primero", "ultimo", "giros", trend.alias("tendencia"), "pendiente_mil", "estabilidad", "volatilidad", fixed(base * 10).alias("base10"), fixed((base + swing) * 10).alias("alto10"), fixed(F.greatest(F.lit(0.0), base - swing) * 10).alias("bajo10")
    )


def turning_points(series: DataFrame) -> DataFrame:
    """(``clave``, ``periodo``) before which the direction turns."""
    w = W.partitionBy("clave").orderBy("periodo")
    s = series.withColumn("delta", F.col("n") - F.lag("n").over(w)).withColumn("siguiente", F.lead("n").over(w) - F.col("n"))
    return s.where(F.col("delta") * F.col("siguiente") < 0).select("clave", "periodo")
