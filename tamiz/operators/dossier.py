"""Dossiers: all evidence of one organisation, its hypothesis, and how well the evidence carries it.

Two aggregations: per (organisation, source) and per organisation. Both combine map-side, so that an organisation with a
third of all rows never gathers in one task: tags and dates are folded into sets of bounded size and extremes, not lists.
Null names form no dossier; null tags count as none; ties of the best row go to the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L


def dossiers(items: DataFrame, entities: DataFrame | None = None, keys: tuple[str, ...] = ("org",)) -> DataFrame:
    """One row per ``org`` from items (``org``, ``id``, ``fuente``, ``fecha``, ``confianza_cent``, ``tags``, ``tipo``, ``categoria``, ``calidad``).

    ``fuente`` names the independent source; rows with a blank one are each their own in ``confianza``, a noisy-or over
    sources (each with its best confidence), which rises with every independent source, but don't count as sources.
    ``entities``: (``org``, ``vertical``), one row each; without it there is no vertical. ``keys``: more columns make one dossier each.
    """
    flags = [F.max(F.coalesce(F.array_contains("tags", t), F.lit(False))).alias(f"__{t}") for t in L.PRIORITY]
    events = [F.max(F.col("tipo") == t).alias(f"__e_{t}") for t in L.EVENT_TYPES]
    best = F.max(F.struct("confianza_cent", (-F.col("id")).alias("i"), "calidad")).alias("mejor")
    doubt = 1 - F.col("confianza_cent") / 100.0
    per_source = items.where("org is not null").groupBy(*keys, "fuente").agg(
        F.count("*").alias("n"), F.when(F.col("fuente") != "", F.min(doubt)).otherwise(F.product(doubt)).alias("duda"), F.count_if(F.col("fecha").isNotNull()).alias("fechadas"),
        F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), best, F.min(F.struct("id", "categoria")).alias("primera"), *flags, *events,
    )
    tag_set = F.array_compact(F.array(*[F.when(F.max(f"__{t}"), F.lit(t)) for t in L.PRIORITY]))
    event_set = F.array_compact(F.array(*[F.when(F.max(f"__e_{t}"), F.lit(t)) for t in L.EVENT_TYPES]))
    d = per_source.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count_if(F.col("fuente") != "").alias("fuentes"), (F.floor((1 - F.product("duda")) * 1_000_000 + 0.5) / 1_000_000.0).alias("confianza"), F.sum("fechadas").alias("fechadas"),
        F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.max("mejor").alias("mejor"), F.min("primera")["categoria"].alias("categoria"), tag_set.alias("tags"), event_set.alias("eventos"),
    )
    d = d.withColumn("calidad", F.col("mejor.calidad")).withColumn("mejor_cent", F.col("mejor.confianza_cent")).drop("mejor")
    if entities is None:
        d = d.withColumn("vertical", F.lit(""))
    else:
        d = d.join(entities.select("org", F.lower(F.trim("vertical")).alias("vertical")), "org", "left").withColumn("vertical", F.coalesce("vertical", F.lit("")))
    return with_hypothesis(d)


def dominant(tags: Column) -> Column:
    """The signal of highest priority; null if there is none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(t) for t in L.PRIORITY]), lambda t: F.array_contains(tags, t)), F.lit(1))


def patterns(tags: Column) -> Column:
    """Labels of all combinations whose signals are present, in order of precedence."""
    return F.array_compact(F.array(*[F.when(F.array_contains(tags, a) & F.array_contains(tags, b), F.lit(label)) for (a, b), label in L.COMBINATIONS]))


def lookup(table: dict, key: Column) -> Column:
    """Value of a constant table for a key; null for keys that it doesn't have."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def with_hypothesis(d: DataFrame) -> DataFrame:
    """Adds ``patrones``, ``dominante``, ``hipotesis``, ``dolor``, ``cambio``, ``clase`` (A, B, C), ``profundidad`` and the scoring of ``scored``."""
    any_of = lambda names: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in names]))
    d = d.withColumn("patrones", patterns(F.col("tags"))).withColumn("dominante", dominant(F.col("tags")))
    amplifier = F.coalesce(lookup({f"{v}|{t}": x for v, ts in L.AMPLIFIER.items() for t, x in ts.items()}, F.concat_ws("|", "vertical", "dominante")), F.lit(1.0))
    depth = F.least(F.floor(F.coalesce(lookup(L.DEPTH, F.col("dominante")), F.lit(0)) * amplifier), F.lit(100))
    return scored(
        d.withColumn("hipotesis", F.coalesce(F.try_element_at("patrones", F.lit(1)), lookup(L.HYPOTHESIS, F.col("dominante")), F.lit("")))
        .withColumn("dolor", any_of(L.PAIN)).withColumn("cambio", any_of(L.CHANGE))
        .withColumn("clase", F.when(F.col("dolor"), "A").when(F.col("cambio") | (F.col("dominante") == "lanzamiento"), "B").otherwise("C"))
        .withColumn("profundidad", depth.cast("long"))
    )


def scored(d: DataFrame) -> DataFrame:
    """Adds ``icp`` (interest, 0 to 100), ``intensidad``, ``secundaria`` (next distinct hypothesis, '' if none), ``viabilidad`` and ``decisor``.

    The confidence is that of the best row, in whole hundredths; its tenth is rounded half to even.
    """
    pains = F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in L.PAIN])))
    cents = F.greatest(F.lit(0), F.least(F.col("mejor_cent"), F.lit(100)))
    tenth, rest = F.floor(cents / 10), cents % 10
    tenth = tenth + F.when((rest > 5) | ((rest == 5) & (tenth % 2 == 1)), 1).otherwise(0)
    of_vertical = F.col("vertical").isin(*L.VERTICALS)
    icp = (
        F.lit(10) + F.floor(F.col("profundidad") * 0.4) + F.when(of_vertical, 15).otherwise(0) + F.when(pains >= 2, 20).when(pains == 1, 15).when(F.col("cambio"), 5).otherwise(0) + tenth
        + F.coalesce(lookup(L.QUALITY_POINTS, F.coalesce("calidad", F.lit(""))), F.lit(0))
    )
    intensity = F.when((pains >= 2) | ((pains >= 1) & (F.col("mejor_cent") >= 80)), "Alta").when((pains >= 1) | (F.col("cambio") & (F.col("mejor_cent") >= 70)), "Media").otherwise("Baja")
    labels = F.array_compact(F.array(*[F.when(F.array_contains("tags", t), F.lit(L.HYPOTHESIS[t])) for t in L.PRIORITY]))
    second = F.coalesce(F.try_element_at(F.filter(labels, lambda x: x != F.col("hipotesis")), F.lit(1)), F.lit(""))
    depth, kind = F.col("profundidad"), F.col("clase")
    viable = (
        F.when((kind == "A") & ((depth >= 50) | ((depth >= 70) & of_vertical)), "alta").when((kind == "A") | ((kind == "B") & (depth >= 30) & of_vertical), "media")
        .when((kind == "B") | (depth > 0), "baja").otherwise("descartable")
    )
    return (
        d.withColumn("icp", F.least(icp, F.lit(100)).cast("long")).withColumn("intensidad", intensity).withColumn("secundaria", second)
        .withColumn("viabilidad", viable).withColumn("decisor", F.coalesce(lookup(L.DECIDER, F.col("dominante")), F.lit(L.ANY_DECIDER)))
    )


def validated(d: DataFrame) -> DataFrame:
    """Adds sufficiency, contradictions, gaps, solidity, level of evidence, motives for blocking, reproducibility and the verdict."""
    n, src, ntags = F.col("n"), F.col("fuentes"), F.size("tags")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    suf = F.lit(40.0) * F.least(n, F.lit(3)) / 3 + F.lit(30.0) * F.least(src, F.lit(2)) / 2 + F.lit(20.0) * F.col("fechadas") / n + F.lit(10.0) * F.least(ntags, F.lit(3)) / 3
    d = d.withColumn("suficiencia", F.floor(clamp(suf) + 0.5))
    contra = F.array_compact(
        F.array(
            F.when(F.col("dolor") & F.col("cambio") & (F.size("patrones") == 0), "dolor_y_crecimiento_sin_patron"),
            F.when(F.array_contains("eventos", "despido") & F.array_contains("eventos", "contratacion"), "eventos_opuestos"),
            F.when((F.col("clase") == "A") & (F.col("viabilidad") == "descartable"), "prioridad_vs_viabilidad"),
        )
    )
    gaps = F.array_compact(
        F.array(
            F.when(F.col("vertical") == "", "sin_vertical"), F.when(src < 2, "fuente_unica"), F.when(n < 3, "corpus_escaso"), F.when(F.col("fechadas") < n, "evidencia_sin_fecha"), F.when(ntags <= 1, "senal_unica"),
            F.when(F.size("patrones") == 0, "sin_convergencia"), F.when((F.col("profundidad") >= 70) & (n <= 1), "profundidad_sin_volumen"),
        )
    )
    d = d.withColumn("contradicciones", contra).withColumn("vacios", gaps)
    sol = (
        F.lit(25.0) * F.least(n, F.lit(6)) / 6 + F.lit(20.0) * F.least(src, F.lit(3)) / 3 + F.lit(15.0) * F.least(F.size("patrones"), F.lit(2)) / 2 + F.lit(0.2) * F.col("profundidad") + F.lit(20.0) * F.col("confianza")
        - F.least(F.lit(10) * F.size("contradicciones"), F.lit(30)) - F.least(F.lit(3) * F.size("vacios"), F.lit(15))
    )
    d = d.withColumn("solidez", F.floor(clamp(sol) + 0.5))
    s, u, c = F.col("solidez"), F.col("suficiencia"), F.size("contradicciones")
    level = F.when((s >= 65) & (u >= 60) & (c == 0) & (src >= 2), "I").when((s >= 45) & (u >= 45) & (c == 0), "II").when((s >= 25) | (u >= 25), "III").otherwise("IV")
    motives = F.array_compact(F.array(F.when(n < 3, "corpus"), F.when(src < 2, "corroboracion"), F.when(u < 40, "suficiencia"), F.when(s < 40, "solidez")))
    verdict = (
        F.when(F.col("hipotesis") == "", "SIN_HIPOTESIS").when(F.size("motivos") > 0, "BLOQUEADA").when(c > 0, "NO_VALIDADA")
        .when((s >= 65) & (u >= 60), "VALIDADA").when((s >= 40) & (u >= 40), "VALIDADA_PARCIAL").otherwise("NO_VALIDADA")
    )
    blocked = (F.col("hipotesis") == "") | (F.size("motivos") > 0)
    return d.withColumn("nivel", level).withColumn("motivos", motives).withColumn("bloqueada", blocked).withColumn("veredicto", verdict)


def reproduced(d: DataFrame) -> DataFrame:
    """(``org``, ``discrepancias``): declared fields (``clase``, ``hipotesis``) that a fresh inference from the signals doesn't give again."""
    again = with_hypothesis(d.select("org", "tags", "vertical", "mejor_cent", "calidad", F.col("clase").alias("__clase"), F.col("hipotesis").alias("__hipotesis")))
    differ = [F.when(~F.col(f"__{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in ("clase", "hipotesis")]
    return again.select("org", F.array_compact(F.array(*differ)).alias("discrepancias"))
