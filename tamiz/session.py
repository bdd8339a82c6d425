"""Session helpers: input tables, and the shared folder where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` of the dataset folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is local (single-machine
    tests) a temporary folder is made. On a cluster without the setting this is an error, as executors share no such folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must be set for a local cluster, too")
    folder = named or tempfile.mkdtemp(prefix="tamiz-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
