"""Positions within groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.session import cut


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (which must be unique within the group).

    The rows are range-partitioned by group and order, so that a hot group is split over many tasks; each piece is
    numbered on its own and shifted by what lies before it. Rows with a null group form a group.
    """
    pieces = cut(df.repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()))
    size = pieces.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    shift = size.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    local = F.row_number().over(W.partitionBy(group, "__p").orderBy(*order)) - 1
    out = pieces.withColumn("__l", local).join(shift, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return out.withColumn(name, (F.col("__l") + F.col("__s")).cast("long")).select(*df.columns, name)
