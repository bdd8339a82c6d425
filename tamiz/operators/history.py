"""Versions, changes, upserts, retention and health: keyed histories as window expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.session import cut


def versions(snapshots: DataFrame, keys: list[str], order: list[str], hash_col: str) -> DataFrame:
    """Snapshots that differ from the one before them of the same key, numbered, with the previous hash."""
    w = W.partitionBy(*keys).orderBy(*order)
    s = snapshots.withColumn("__antes", F.lag(hash_col).over(w)).where(F.col("__antes").isNull() | (F.col("__antes") != F.col(hash_col)))
    return s.withColumn("version", F.row_number().over(w).cast("long")).withColumn("hash_previo", F.lag(hash_col).over(w)).drop("__antes")


def previous(snapshots: DataFrame, keys: list[str], order: list[str], value: str, ok: Column) -> DataFrame:
    """Each snapshot with the last earlier one that was ``ok`` (an as-of join on itself)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return snapshots.withColumn("anterior", F.last(F.when(ok, F.col(value)), ignorenulls=True).over(w))


def insert_if_absent(new: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is neither stored nor carried by an earlier new row; null keys are dropped."""
    first = new.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
    return first.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def coalescing_upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key: new values replace old ones unless null or blank. ``accion`` tells what happened."""
    n = new.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields], F.lit(True).alias("__n"))
    o = old.select(key, *fields, F.lit(True).alias("__o"))
    j = o.join(n, key, "full_outer")
    keep = lambda f: F.coalesce(F.when(F.trim(F.col(f"__n_{f}")) != "", F.col(f"__n_{f}")), F.col(f)).alias(f)
    action = F.when(F.col("__o").isNull(), "insertado").when(F.col("__n").isNotNull(), "actualizado").otherwise("igual")
    return j.select(key, *[keep(f) for f in fields], action.alias("accion"))


def failure_runs(runs: DataFrame, source: str, order: list[str], ok: Column, threshold: int = 2) -> DataFrame:
    """Consecutive failures after each run of a source (reset by success), and whether that raises an alert.

    Gaps and islands: the number of successes so far names the island. A source may have any number of runs: they are
    range-partitioned by source and order, each piece is counted on its own, and what a piece ends with is carried over to the
    next ones, of which there are as many as partitions.
    """
    pieces = cut(runs.repartitionByRange(source, *order).withColumn("__p", F.spark_partition_id()).withColumn("__ok", ok.cast("long")))
    w = W.partitionBy(source, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    r = pieces.withColumn("__isla", F.sum("__ok").over(w))
    r = r.withColumn("__local", F.sum(1 - F.col("__ok")).over(W.partitionBy(source, "__p", "__isla").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = r.groupBy(F.col(source).alias("__s"), F.col("__p").alias("__q"), "__isla").agg(F.sum(1 - F.col("__ok")).alias("f"))
    last = last.groupBy("__s", "__q").agg(F.max(F.struct("__isla", "f")).alias("m")).select("__s", "__q", (F.col("m.__isla") > 0).cast("long").alias("hubo"), "m.f")
    before = W.partitionBy("__s").orderBy("__q")
    last = last.withColumn("g", F.sum("hubo").over(before))
    last = last.withColumn("acumulado", F.sum("f").over(W.partitionBy("__s", "g").orderBy("__q"))).withColumn("trae", F.coalesce(F.lag("acumulado").over(before), F.lit(0)))
    out = r.join(last.select("__s", "__q", "trae"), F.col(source).eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__q")))
    streak = F.col("__local") + F.when(F.col("__isla") == 0, F.col("trae")).otherwise(0)
    return out.select(*runs.columns, streak.cast("long").alias("fallos_seguidos"), (streak >= threshold).alias("alerta"))


def accept_by_keys(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Order-dependent deduplication: a row is accepted unless an earlier accepted row shares one of its keys.

    Rounds: every undecided row that is first among the undecided in all its keys is accepted; undecided rows that share
    a key with an accepted one are dropped. Blank and null keys are ignored. ``order`` must be unique. Only rows with a
    shared key take part; the others are accepted at once.
    """
    base = rows.select(F.col(order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(k).cast("string").alias("v")) for k in keys])).alias("x")).select("__o", "x.t", "x.v").where("v <> ''")
    shared = base.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1").select("t", "v")
    k = cut(base.join(shared, ["t", "v"]))
    undecided = k.select("__o").distinct()
    dropped = None
    while not undecided.isEmpty():
        live = k.join(undecided, "__o")
        first = live.groupBy("t", "v").agg(F.min("__o").alias("m"))
        blocked = live.join(first, ["t", "v"]).where("m < __o").select("__o").distinct()
        won = cut(undecided.join(blocked, "__o", "left_anti"))
        lost = cut(live.join(k.join(won, "__o").select("t", "v").distinct(), ["t", "v"]).select("__o").distinct().join(won, "__o", "left_anti"))
        dropped = lost if dropped is None else dropped.unionByName(lost)
        undecided = cut(undecided.join(won, "__o", "left_anti").join(lost, "__o", "left_anti"))
    if dropped is None:
        return rows
    return rows.join(dropped.withColumnRenamed("__o", order), order, "left_anti")


def concept_pairs(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct pairs of neighbouring words (neither a stop word, together longer than five characters with the blank), sorted."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " "), lambda x: x != "")
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(F.get(words, i - 1).alias("a"), F.get(words, i).alias("b")))
    good = F.filter(pair, lambda p: p["b"].isNotNull() & ~p["a"].isin(*stop) & ~p["b"].isin(*stop) & (F.length(p["a"]) + F.length(p["b"]) > 4))
    return F.array_sort(F.array_distinct(F.transform(good, lambda p: F.concat_ws(" ", p["a"], p["b"]))))
