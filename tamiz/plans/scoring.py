"""Queries over the scoring of dossiers and single records, and over what the validation finds in detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions.text import company_key
from tamiz.operators.dossier import reproduced, with_hypothesis
from tamiz.plans.analysis import battery, build
from tamiz.plans.base import CARDS, COMPANY, DOSSIERS, ITEMS, VALIDATED, entities, items
from tamiz.session import table


def cards(spark, d):
    """One analysis per evidence row that names an organisation."""
    i = items(spark, d).where("org is not null").withColumn("mejor_cent", F.col("confianza_cent"))
    e = entities(spark, d).select("org", F.lower(F.trim("vertical")).alias("vertical"))
    return with_hypothesis(i.join(e, "org", "left").withColumn("vertical", F.coalesce("vertical", F.lit(""))))


def entity_cards(spark, d):
    """One analysis per directory entity: no signals, confidence 0.4, quality Baja."""
    p = table(spark, d, "prospectos").select(
        "id", F.nullif(company_key(F.col("nombre")), F.lit("")).alias("org"), F.lower(F.trim(F.coalesce("vertical", F.lit("")))).alias("vertical"),
        F.array().cast("array<string>").alias("tags"), F.lit(40).cast("long").alias("mejor_cent"), F.lit("Baja").alias("calidad"),
    )
    return with_hypothesis(p)


def icp(spark, d):
    return build(spark, d).select("org", "vertical", "profundidad", "icp")


def intensity(spark, d):
    return build(spark, d).select("org", "intensidad")


def secondary(spark, d):
    return build(spark, d).select("org", "hipotesis", "secundaria")


def viability(spark, d):
    return build(spark, d).select("org", "viabilidad", "decisor")


def evidence_cards(spark, d):
    return cards(spark, d).select("id", "org", "clase", "icp", "hipotesis", "viabilidad")


def directory_cards(spark, d):
    return entity_cards(spark, d).select("id", "clase", "icp", "viabilidad")


def best_card(spark, d):
    """The best evidence of each organisation: class, then interest, then the least id; a map-side minimum, no sort."""
    m = cards(spark, d).groupBy("org").agg(F.min(F.struct("clase", (-F.col("icp")).alias("i"), "id")).alias("m"))
    return m.select("org", "m.clase", (-F.col("m.i")).alias("icp"), "m.id")


def report_cards(spark, d):
    """The best card of each organisation in the news, and of each directory entity that isn't in the news."""
    news = best_card(spark, d).select(F.lit("evidencia").alias("origen"), "org", "clase", "icp", "id")
    rest = entity_cards(spark, d).where("org is not null").groupBy("org").agg(F.min(F.struct("clase", (-F.col("icp")).alias("i"), "id")).alias("m"))
    rest = rest.join(news.select("org"), "org", "left_anti")
    return news.unionByName(rest.select(F.lit("directorio").alias("origen"), "org", "m.clase", (-F.col("m.i")).alias("icp"), "m.id"))


def dominant_hypothesis(spark, d):
    """Over the single cards of each organisation: the most frequent hypothesis (ties: the first to arrive), the best class, the highest interest, the last date."""
    c = cards(spark, d)
    votes = c.where("hipotesis <> ''").groupBy("org", "hipotesis").agg(F.count("*").alias("n"), F.min("id").alias("primera"))
    top = votes.groupBy("org").agg(F.max(F.struct("n", (-F.col("primera")).alias("orden"), "hipotesis")).alias("m")).select("org", F.col("m.hipotesis").alias("hipotesis"), F.col("m.n").alias("votos"))
    rest = c.groupBy("org").agg(F.min("clase").alias("clase"), F.max("icp").alias("icp"), F.max("fecha").alias("ultima"))
    return rest.join(top, "org", "left").select("org", "clase", "icp", "ultima", F.coalesce("hipotesis", F.lit("")).alias("hipotesis"), F.coalesce("votos", F.lit(0).cast("long")).alias("votos"))


def reproducibility(spark, d):
    return reproduced(build(spark, d)).select("org", F.array_join("discrepancias", "|").alias("discrepancias"))


def sufficiency_levels(spark, d):
    u, s = F.col("suficiencia"), F.col("solidez")
    return battery(spark, d).select(
        "org", F.when(u >= 60, "suficiente").when(u >= 40, "parcial").otherwise("insuficiente").alias("nivel"), ((F.col("n") >= 3) & (F.col("fuentes") >= 2) & (u >= 60)).alias("suficiente"),
        F.when(s >= 65, "alta").when(s >= 40, "media").otherwise("baja").alias("solidez_nivel"),
    )


def trace_gaps(spark, d):
    """Rows that can't be traced to a source, and what they lack."""
    lacking = F.array_compact(F.array(F.when(F.col("url") == "", "url_fuente"), F.when(F.col("medio") == "", "nombre_medio")))
    return items(spark, d).select("id", F.array_join(lacking, "|").alias("faltan")).where("faltan <> ''")


def trace_ratios(spark, d):
    """Per organisation: rows, traceable and dated ones, in thousandths."""
    i = items(spark, d).where("org is not null").groupBy("org").agg(F.count("*").alias("total"), F.count_if((F.col("url") != "") & (F.col("medio") != "")).alias("trazables"), F.count("fecha").alias("fechadas"))
    return i.select("org", "total", "trazables", "fechadas", F.floor(F.col("trazables") * 1000 / F.col("total")).alias("trazables_mil"), F.floor(F.col("fechadas") * 1000 / F.col("total")).alias("fechadas_mil"), (F.col("trazables") == F.col("total")).alias("completa"))


def verdict_statements(spark, d):
    """The verdict on each organisation with its figures and the recommended step, as codes."""
    step = {"VALIDADA": "escalar", "VALIDADA_PARCIAL": "ampliar", "NO_VALIDADA": "resolver", "BLOQUEADA": "capturar", "SIN_HIPOTESIS": "capturar"}
    code = F.create_map(*[x for k, v in step.items() for x in (F.lit(k), F.lit(v))])[F.col("veredicto")]
    return battery(spark, d).select("org", "hipotesis", "veredicto", "bloqueada", "nivel", F.size("contradicciones").cast("long").alias("contradicciones"), F.size("vacios").cast("long").alias("vacios"), code.alias("paso"))


_card = f"WITH {CARDS}, c AS (SELECT * FROM d WHERE org IS NOT NULL), b AS (SELECT org, clase, icp, id FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY clase, icp DESC, id) AS r FROM c) WHERE r = 1)"
_entity_icp = f"14 + CASE WHEN lower(trim(coalesce(vertical, ''))) IN ({', '.join(repr(v) for v in L.VERTICALS)}) THEN 15 ELSE 0 END"
QUERIES = {
    "icp": (icp, f"WITH {DOSSIERS} SELECT org, vertical, profundidad, icp FROM d"),
    "intensity": (intensity, f"WITH {DOSSIERS} SELECT org, intensidad FROM d"),
    "secondary_hypothesis": (secondary, f"WITH {DOSSIERS} SELECT org, hipotesis, secundaria FROM d"),
    "viability": (viability, f"WITH {DOSSIERS} SELECT org, viabilidad, decisor FROM d"),
    "evidence_cards": (evidence_cards, f"{_card} SELECT id, org, clase, icp, hipotesis, viabilidad FROM c"),
    "directory_cards": (directory_cards, f"SELECT id, 'C' AS clase, CAST({_entity_icp} AS BIGINT) AS icp, 'descartable' AS viabilidad FROM prospectos"),
    "best_card_per_org": (best_card, f"{_card} SELECT * FROM b"),
    "report_cards": (report_cards, f"""{_card}, p AS (SELECT org, 'C' AS clase, icp, id FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY icp DESC, id) AS r FROM (SELECT id, {COMPANY.format(c="nombre")} AS org, CAST({_entity_icp} AS BIGINT) AS icp FROM prospectos) WHERE org IS NOT NULL) WHERE r = 1)
        SELECT 'evidencia' AS origen, * FROM b UNION ALL SELECT 'directorio', * FROM p WHERE org NOT IN (SELECT org FROM b)"""),
    "dominant_hypothesis": (dominant_hypothesis, f"""{_card}, h AS (SELECT org, hipotesis, count(*) AS n, min(id) AS primera FROM c WHERE hipotesis <> '' GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, primera) AS r FROM h) WHERE r = 1),
        g AS (SELECT org, min(clase) AS clase, max(icp) AS icp, max(fecha) AS ultima FROM c GROUP BY 1) SELECT g.*, coalesce(t.hipotesis, '') AS hipotesis, coalesce(t.n, 0) AS votos FROM g LEFT JOIN t USING (org)"""),
    "reproducibility": (reproducibility, f"WITH {DOSSIERS} SELECT org, '' AS discrepancias FROM d"),
    "sufficiency_levels": (sufficiency_levels, f"WITH {VALIDATED} SELECT org, CASE WHEN suficiencia >= 60 THEN 'suficiente' WHEN suficiencia >= 40 THEN 'parcial' ELSE 'insuficiente' END AS nivel, n >= 3 AND fuentes >= 2 AND suficiencia >= 60 AS suficiente, CASE WHEN solidez >= 65 THEN 'alta' WHEN solidez >= 40 THEN 'media' ELSE 'baja' END AS solidez_nivel FROM v"),
    "trace_gaps": (trace_gaps, f"WITH {ITEMS}, f AS (SELECT id, concat_ws('|', CASE WHEN url = '' THEN 'url_fuente' END, CASE WHEN medio = '' THEN 'nombre_medio' END) AS faltan FROM items) SELECT * FROM f WHERE faltan <> ''"),
    "trace_ratios": (trace_ratios, f"WITH {ITEMS}, g AS (SELECT org, count(*) AS total, count(*) FILTER (url <> '' AND medio <> '') AS trazables, count(fecha) AS fechadas FROM items WHERE org IS NOT NULL GROUP BY 1) SELECT *, CAST(floor(trazables * 1000 / total) AS BIGINT) AS trazables_mil, CAST(floor(fechadas * 1000 / total) AS BIGINT) AS fechadas_mil, trazables = total AS completa FROM g"),
    "verdict_statements": (verdict_statements, f"WITH {VALIDATED} SELECT org, hipotesis, veredicto, bloqueada, nivel, len(contradicciones) AS contradicciones, len(vacios) AS vacios, CASE veredicto WHEN 'VALIDADA' THEN 'escalar' WHEN 'VALIDADA_PARCIAL' THEN 'ampliar' WHEN 'NO_VALIDADA' THEN 'resolver' ELSE 'capturar' END AS paso FROM v"),
}
