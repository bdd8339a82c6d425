"""Streaming forms of the capture operators: deduplication and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as a file stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """First arrivals by key; state is kept for ``delay`` only, later repeats may pass."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, by: str, width: str, delay: str = "1 day") -> DataFrame:
    """Counts per tumbling window and value of ``by``."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by)
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("inicio"), by, "n")


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result from the shared folder."""
    spark = stream.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    if mode == "complete":

        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/salida")

        q = stream.writeStream.outputMode("complete").foreachBatch(write)
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/salida")
    q.option("checkpointLocation", f"{path}/punto").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/salida")
