"""Timestamps in mixed formats, precisions and time zones, brought to one instant in UTC (problem 7).

Every format is a pattern with named parts; all work is done by built-in expressions. Where the digits allow two
readings (day and month, both at most 12), the reading is chosen by expectation-maximisation over a mixture of formats
per source: a value contributes its likelihood under each valid parse (how far the instant lies from the record's
loading time), the share of each order within the source is re-estimated until it settles, and the posterior chooses.
An order stated for the source enters as a prior. Values whose posterior stays undecided are marked ``ambiguo``.

Defined results: null, non-dates and impossible dates or times give no instant. A local time that occurs twice means
the first; one that is skipped is read with the offset before the change. Two-digit years are 20yy. Digits beyond
microseconds are dropped. Bare numbers are seconds, milliseconds or microseconds since 1970 according to size.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
MONTHS = {
    1: "enero janeiro january ene jan",
    2: "febrero fevereiro february feb fev",
    3: "marzo março marco march mar",
    4: "abril april abr apr",
    5: "mayo maio may mai",
    6: "junio junho june jun",
    7: "julio julho july jul",
    8: "agosto august ago aug",
    9: "septiembre setiembre setembro september sep sept set",
    10: "octubre outubro october oct out",
    11: "noviembre novembro november nov",
    12: "diciembre dezembro december dic dez dec",
}
#: Zone abbreviations with their offsets in minutes.
ZONE_ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "bst": 60,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "art": -180, "brt": -180, "brst": -120, "clt": -240, "clst": -180, "cot": -300, "pet": -300,
}
# ---- end of the fixed values --------------------------------------------------------------------------------------

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"
_ZONE = r"(?:\s*(z|[a-z]{3,4}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|\[?[a-z_]+(?:/[a-z_+-]+)+\]?))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_HALF = r"(?:\s*([ap])\.?\s?m\.?)?"
ISO = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[t ]\s*{_CLOCK})?{_ZONE}$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,12}}))?{_ZONE}$"
NAMED = rf"^(?:[^\d\s,]+,?\s+)?(\d{{1,2}})[ -](?:de )?([^\d\s-]+?)\.?[ -](?:de )?(\d{{4}})(?:,?\s+(?:às |as |a las |at )?(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,12}}))?)?{_HALF}(?:\s*h(?:rs?)?\.?)?)?{_ZONE}$"
ENGLISH = rf"^(?:[^\d\s,]+,\s+)?([^\d\s]+)\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at )?(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,12}}))?)?{_HALF})?{_ZONE}$"
DIGITS = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_HALF}(?:\s*h(?:rs?)?\.?)?)?{_ZONE}$"
EPOCH = r"^\d{1,17}$"

#: Weight of the order stated for a source, and of any other order, as shares of the source's ambiguous values, so that the prior carries alike at every size.
STATED, UNSTATED = 10.0, 0.001
ROUNDS = 30


#: Where each pattern has its parts: year, month, day, hour, minute, second, fraction, half of the day, zone.
_LAYOUT = {
    "iso": (ISO, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact": (COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "digits": (DIGITS, "$4|$3|$1|$5|$6|$7|$8|$9|$10"),
    "named": (NAMED, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "english": (ENGLISH, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}


def _zones(spark: SparkSession) -> DataFrame:
    """Dimension of the zone names the JVM knows (a few hundred), keyed by lower case."""
    names = [z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray() if "/" in z]
    return spark.createDataFrame([(z.lower(), z) for z in names], "clave string, nombre_zona string")


def _lookup(key: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, n in table.items() for x in (F.lit(k), F.lit(n))]), key)


def _lag_bin(utc: Column, near: Column) -> Column:
    """Distance in days between a reading and the loading time, on a coarse scale."""
    days = F.abs(utc - near) / 86_400_000_000.0
    return F.when(utc.isNull(), -1).when(days <= 2, 0).when(days <= 8, 1).when(days <= 40, 2).when(days <= 120, 3).when(days <= 400, 4).otherwise(5)


#: Density of each bin under "published about when it was loaded", blended with a flat background.
_BIN_DAYS = (2, 6, 32, 80, 280, 2000)
_LIKELIHOOD = [0.5 * math.exp(-sum(_BIN_DAYS[:k]) / 10) / 10 + 0.5 / 1200 for k in range(6)]


def _em(pdf: pd.DataFrame) -> pd.DataFrame:
    """Posterior of day-first per pair of bins within one source; ``pdf`` has a row per pair with its count."""
    prior = pdf["orden"].iloc[0]
    total = max(float(pdf["n"].sum()), 1.0)
    a = total * (STATED if prior == "dmy" else UNSTATED)
    b = total * (STATED if prior == "mdy" else UNSTATED)
    l_d = pdf["bin_d"].map(lambda k: 0.0 if k < 0 else _LIKELIHOOD[k]).to_numpy()
    l_m = pdf["bin_m"].map(lambda k: 0.0 if k < 0 else _LIKELIHOOD[k]).to_numpy()
    n = pdf["n"].to_numpy()
    share = a / (a + b)
    for _ in range(ROUNDS):
        p_d = share * l_d
        post = p_d / (p_d + (1 - share) * l_m).clip(1e-300)
        new = (a + (n * post).sum()) / (a + b + n.sum())
        if abs(new - share) < 1e-9:
            break
        share = new
    p_d = share * l_d
    out = pdf[["fuente", "bin_d", "bin_m"]].copy()
    out["p_dia_primero"] = p_d / (p_d + (1 - share) * l_m).clip(1e-300)
    return out


def normalise_timestamps(values: DataFrame, sources: DataFrame) -> DataFrame:
    """One instant for each value.

    ``values``: ``id``, ``campo``, ``valor``, ``fuente``, ``zona`` (zone for values without one; UTC if null) and
    ``cerca_us`` (microseconds of the loading time; may be null). ``sources``: ``fuente``, ``zona_horaria``, ``orden``
    (dmy, mdy or null), one row per source. Adds ``utc_us``, ``formato`` and ``ambiguo``. A repeated value gives a
    repeated row; other columns, whatever their names, are dropped.
    """
    zones = _zones(values.sparkSession)
    v = F.lower(F.trim(F.regexp_replace("valor", "[\\s\u00a0]+", " ")))
    df = values.select("id", "campo", "valor", "fuente", "zona", "cerca_us", v.alias("v")).where(F.col("valor").isNotNull())
    v, f, a = F.col("v"), F.col("formato"), F.col("a")
    kind = F.when(v.rlike(EPOCH), "epoch")
    parts = F.when(f == "epoch", F.lit(""))
    for name in ("iso", "compact", "digits", "named", "english"):
        pattern, layout = _LAYOUT[name]
        kind = kind.when(v.rlike(pattern), name)
        parts = parts.when(f == name, F.regexp_replace(v, pattern, layout))
    df = df.withColumn("formato", kind).where(f.isNotNull()).withColumn("a", F.split(parts, r"\|", -1))
    number = F.when(f == "epoch", v.try_cast("long"))
    months = {w: n for n, words in MONTHS.items() for w in words.split()}
    part = lambda k: F.get(a, F.lit(k))
    num = lambda k: part(k).try_cast("int")
    z = F.regexp_replace(F.coalesce(part(8), F.lit("")), r"[\[\]]", "")
    df = df.select(
        "id", "campo", "valor", "fuente", "cerca_us", "formato", F.lower(F.coalesce("zona", F.lit("utc"))).alias("zona"),
        F.when(number < 100_000_000_000, number * 1_000_000).when(number < 100_000_000_000_000, number * 1000).otherwise(number).alias("epoch"),
        F.when(F.length(part(0)) == 2, num(0) + 2000).otherwise(num(0)).alias("y"),
        F.when(f.isin("named", "english"), _lookup(part(1), months)).otherwise(num(1)).alias("mo"),
        num(2).alias("d"), F.coalesce(num(3), F.lit(0)).alias("h"), F.coalesce(num(4), F.lit(0)).alias("mi"), F.coalesce(num(5), F.lit(0)).alias("s"),
        F.coalesce(F.substring(F.rpad(part(6), 6, "0"), 1, 6).try_cast("int"), F.lit(0)).alias("us"), part(7).alias("half"), z.alias("z"),
    )
    h, mi, half, z = F.col("h"), F.col("mi"), F.col("half"), F.col("z")
    h24 = F.when(half == "", h).when(~h.between(1, 12), 99).when(half == "p", F.pmod(h, F.lit(12)) + 12).otherwise(F.pmod(h, F.lit(12)))
    hours, minutes = F.regexp_extract(z, r"[+-](\d{1,2})", 1).try_cast("int"), F.coalesce(F.regexp_extract(z, r"[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    offset = F.when((hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * F.when(z.contains("-"), -1).otherwise(1))
    numeric = z.rlike(r"^(?:utc|gmt)?[+-]\d")
    df = df.withColumn("h24", h24).withColumn("fija", F.when(z == "", F.lit(None).cast("int")).when(numeric, offset).when(~z.contains("/"), _lookup(z, ZONE_ABBREVIATIONS)))
    df = df.withColumn("clave", F.when(z == "", F.col("zona")).when(~numeric & z.contains("/"), z))
    df = df.join(F.broadcast(zones), "clave", "left")
    # no zone anywhere means UTC; a zone that is written but unknown gives no instant
    df = df.withColumn("fija", F.when(F.col("nombre_zona").isNull() & (F.col("clave") == "utc"), 0).otherwise(F.col("fija")))
    y, mo, d, s = F.col("y"), F.col("mo"), F.col("d"), F.col("s")
    fine = (F.col("h24") <= 23) & (mi <= 59) & (s <= 59) & y.between(1, 9999)
    second = (s + F.col("us") / F.lit(1_000_000)).cast("decimal(8,6)")
    digits = f == "digits"
    local = lambda m, dd: F.try_make_timestamp(y, m, dd, F.col("h24"), mi, second, F.lit("UTC"))
    df = df.withColumn("local_d", F.when(fine & mo.between(1, 12), local(mo, d))).withColumn("local_m", F.when(digits & fine & d.between(1, 12), local(d, mo)))

    def instant(column: str) -> Column:
        c, name = F.col(column), F.col("nombre_zona")
        return F.when(name.isNotNull(), F.unix_micros(F.to_utc_timestamp(c, name))).otherwise(F.unix_micros(c) - F.col("fija").cast("long") * 60_000_000)

    df = df.withColumn("us_d", F.coalesce("epoch", instant("local_d"))).withColumn("us_m", instant("local_m"))
    near = F.coalesce("cerca_us", F.lit(0).cast("long"))
    open_ = df.where(digits & (F.col("us_d").isNotNull() | F.col("us_m").isNotNull()))
    bins = open_.select("fuente", _lag_bin(F.col("us_d"), near).alias("bin_d"), _lag_bin(F.col("us_m"), near).alias("bin_m"))
    orders = sources.groupBy("fuente").agg(F.max("orden").alias("orden"))
    counts = bins.groupBy("fuente", "bin_d", "bin_m").agg(F.count("*").cast("double").alias("n")).join(orders, "fuente", "left")
    post = counts.groupBy("fuente").applyInPandas(_em, "fuente string, bin_d int, bin_m int, p_dia_primero double")
    df = df.withColumn("bin_d", F.when(digits, _lag_bin(F.col("us_d"), near))).withColumn("bin_m", F.when(digits, _lag_bin(F.col("us_m"), near)))
    df = df.join(post, ["fuente", "bin_d", "bin_m"], "left")
    chosen = F.when(~digits, F.col("us_d")).when(F.coalesce("p_dia_primero", F.lit(0.5)) >= 0.5, F.coalesce("us_d", "us_m")).otherwise(F.coalesce("us_m", "us_d"))
    unsure = digits & F.col("us_d").isNotNull() & F.col("us_m").isNotNull() & (F.col("us_d") != F.col("us_m")) & F.col("p_dia_primero").between(0.1, 0.9)
    return df.select("id", "campo", "valor", "fuente", "formato", chosen.alias("utc_us"), F.coalesce(unsure, F.lit(False)).alias("ambiguo")).where("utc_us is not null")


def p7_instants(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    """All readable values of ``fecha_publicacion`` and ``fecha_extraccion`` with their instants."""
    dim = medios.select(F.col("nombre_medio").alias("fuente"), "zona_horaria", F.col("orden_fecha").alias("orden"))
    near = F.unix_micros(F.try_to_timestamp(F.col("creado_en")))
    both = F.array(F.struct(F.lit("fecha_publicacion").alias("campo"), F.col("fecha_publicacion").alias("valor")), F.struct(F.lit("fecha_extraccion").alias("campo"), F.col("fecha_extraccion").alias("valor")))
    rows = evidencias.select("id", F.col("nombre_medio").alias("fuente"), near.alias("cerca_us"), F.explode(both).alias("x")).select("id", "fuente", "cerca_us", "x.campo", "x.valor")
    rows = rows.where(F.col("valor").isNotNull() & ~F.col("valor").rlike(CANONICAL))
    rows = rows.join(dim.select("fuente", "zona_horaria"), "fuente", "left").withColumn("zona", F.when(F.col("campo") == "fecha_publicacion", F.col("zona_horaria")))
    return normalise_timestamps(rows.select("id", "campo", "valor", "fuente", "zona", "cerca_us"), dim)


def p7_found(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    """(``id``, ``campo``, ``utc_us``) of every value that denotes an instant and isn't yet in canonical form."""
    return p7_instants(evidencias, medios).select("id", "campo", "utc_us")
