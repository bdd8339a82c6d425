"""Queries on single entities and sources: profiles from texts, consolidated views, state of sources, listings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import history as H
from tamiz.operators import tagging as G
from tamiz.plans.analysis import battery, build
from tamiz.plans.base import COMPANY, DOSSIERS, ITEMS, VALIDATED, entities, items, quoted, sql_any
from tamiz.plans.reports import _points, composite
from tamiz.session import table

#: Last year that counts as a founding year, and batch from which signals are new.
LAST_YEAR, NEW_FROM = 2026, 13


def verticals(spark, d):
    """Vertical that the corporate text suggests: the first whose hints it has."""
    low = F.lower(F.col("discurso_corporativo"))
    first = F.coalesce(*[F.when(T.contains_any(low, hints), F.lit(v)) for v, hints in L.VERTICAL_HINTS.items()])
    return table(spark, d, "prospectos").select("id", first.alias("vertical"))


def changelogs(spark, d):
    """Documents by kind, and how many of each open like a changelog."""
    first = F.lower(F.split(F.trim(F.coalesce("text", F.lit(""))), "\n")[0])
    return table(spark, d, "documents").groupBy("tipo_doc").agg(F.count("*").alias("n"), F.count_if(T.contains_any(first, L.CHANGELOG_MARKS)).alias("de_version"))


def profile(spark, d):
    """What a corporate text declares: size band, founding year, mailboxes and leading discourse."""
    t = F.col("discurso_corporativo")
    p = table(spark, d, "prospectos").select("id", T.declared_size(t).alias("personas"), T.declared_year(t, LAST_YEAR).cast("long").alias("anio"), F.coalesce(F.size(T.mailboxes(t)), F.lit(0)).cast("long").alias("correos"))
    return p.select("id", T.size_band(F.col("personas")).alias("escala"), "anio", "correos")


def source_health(spark, d):
    """State of each source after its last run: consecutive failures and whether that raises an alert."""
    r = table(spark, d, "rechazos").select("connector", "creado_en", "id", F.lit(False).alias("ok"))
    e = table(spark, d, "evidencias").select("connector", "creado_en", "id", F.lit(True).alias("ok"))
    f = H.failure_runs(r.unionByName(e), "connector", ["creado_en", "ok", "id"], F.col("ok"))
    last = f.groupBy("connector").agg(F.max(F.struct("creado_en", "ok", "id", "fallos_seguidos", "alerta")).alias("m"))
    return last.select("connector", F.col("m.creado_en").alias("ultima"), F.col("m.fallos_seguidos").alias("fallos_seguidos"), F.col("m.alerta").alias("alerta"))


def org_overview(spark, d):
    """Each organisation over five sources: news, directory, page captures, alerts and validation."""
    i = items(spark, d).where("org is not null")
    alerts = i.select("org", G.rule_alert(F.col("texto"))["puntos"].alias("p")).groupBy("org").agg(F.count_if(F.col("p") > 0).alias("senales"))
    s = table(spark, d, "drift_snapshots").groupBy(T.company_key(F.col("org_nombre")).alias("org")).agg(F.count("*").alias("capturas"), F.max("capturado_en").alias("ultima_captura"))
    v = battery(spark, d).select("org", "n", "hipotesis", "veredicto", "solidez")
    j = v.join(entities(spark, d).select("org", "sitio", "escala"), "org", "left").join(s, "org", "left").join(alerts, "org", "left")
    return j.select("org", "n", "hipotesis", "veredicto", "solidez", "sitio", "escala", F.coalesce("capturas", F.lit(0).cast("long")).alias("capturas"), "ultima_captura", F.coalesce("senales", F.lit(0).cast("long")).alias("senales"))


def dossier_json(spark, d):
    """Dossiers as JSON documents with keys in order."""
    b = build(spark, d)
    doc = F.to_json(F.struct(F.col("icp").alias("interes"), F.col("hipotesis"), F.col("n"), F.col("org"), F.array_sort("tags").alias("senales"), F.col("vertical")), {"ignoreNullFields": "false"})
    return b.select("org", doc.alias("documento"))


def best_sourced(spark, d):
    """The evidence with an address of the highest confidence of each organisation, ties to the least id; a map-side maximum."""
    i = items(spark, d).where("org is not null and url <> ''").groupBy("org").agg(F.max(F.struct("confianza_cent", (-F.col("id")).alias("o"), "url")).alias("m"))
    return i.select("org", (-F.col("m.o")).alias("id"), "m.confianza_cent", "m.url")


def objectives(spark, d, category: str = "Startup", sizes: tuple[str, ...] = ("11-50", "51-200")):
    """Organisations in the news that a sweep would take: those of a category and size, and those that the directory doesn't know."""
    seed = table(spark, d, "prospectos").groupBy(T.company_key(F.col("nombre")).alias("org")).agg(F.min(F.struct("id", "categoria", "escala")).alias("e")).select("org", "e.categoria", "e.escala")
    j = items(spark, d).where("org is not null").select("org").distinct().join(seed.withColumn("hay", F.lit(True)), "org", "left")
    return j.where(F.col("hay").isNull() | ((F.col("categoria") == category) & F.col("escala").isin(*sizes))).select("org", F.coalesce("hay", F.lit(False)).alias("conocida"))


def resolved(spark, d):
    """Raw captures of evidence by record hash, else by raw hash: two left joins, the first that fits."""
    e = table(spark, d, "evidencias").select("id", "hash_dedup", "raw_hash")
    raw = table(spark, d, "raw_store").groupBy(F.col("hash_dedup").alias("k")).agg(F.min("id").alias("crudo"))
    j = e.join(raw.select(F.col("k").alias("hash_dedup"), F.col("crudo").alias("a")), "hash_dedup", "left").join(raw.select(F.col("k").alias("raw_hash"), F.col("crudo").alias("b")), "raw_hash", "left")
    return j.select("id", F.coalesce("a", "b").alias("crudo")).where("crudo is not null")


def listing(spark, d):
    """All organisations in order of their composite score, with their place by bands of it."""
    b = build(spark, d).select("org", composite().alias("puntos10"))
    return b.groupBy((F.floor(F.col("puntos10") / 100) * 100).alias("banda")).agg(F.count("*").alias("n"), F.min("org").alias("primera"), F.max("puntos10").alias("mejor"))


def panel(spark, d):
    """The dashboard's figures in one row."""
    v = battery(spark, d)
    f = v.agg(
        F.count("*").alias("organizaciones"), F.sum("n").alias("evidencias"), F.count_if("dolor").alias("con_dolor"), F.count_if(F.size("patrones") > 0).alias("con_patron"), F.count_if("bloqueada").alias("bloqueadas"), F.min("desde").alias("desde"), F.max("hasta").alias("hasta"),
        F.count_distinct(F.nullif("hipotesis", F.lit(""))).alias("hipotesis"), F.count_if(F.col("dolor") & (F.col("profundidad") >= 70) & (F.col("n") <= 2)).alias("centinelas"),
    )
    return f


def new_signals(spark, d):
    """Keyword signals of the newer batches that no earlier batch has for the same text and keyword, each once."""
    e = table(spark, d, "evidencias").select("id", "lote", "cita_textual")
    hits = G.rule_hits(e.withColumn("k", F.struct("lote", "id")), "k", "cita_textual").select(F.col("k.lote").alias("lote"), F.sha1(F.concat_ws("|", "tipo", "palabra", "fragmento")).alias("senal"), F.col("k.id").alias("id"))
    first = hits.groupBy("senal").agg(F.min(F.struct("lote", "id")).alias("m"))
    return first.where(F.col("m.lote") >= NEW_FROM).select("senal", F.col("m.lote").alias("lote"), F.col("m.id").alias("id"))


def event_order(spark, d):
    """Kinds of events of each organisation in the order in which they first came, as pairs of neighbours."""
    f = items(spark, d).where("org is not null and tipo <> ''").groupBy("org", "tipo").agg(F.min("id").alias("primera"))
    w = W.partitionBy("org").orderBy("primera")
    return f.withColumn("sigue", F.lead("tipo").over(w)).where("sigue is not null").groupBy("tipo", "sigue").agg(F.count("*").alias("n"))


_low = "lower(discurso_corporativo)"
_size = f"coalesce(CASE WHEN try_cast(regexp_replace(regexp_extract({_low}, '{T._NUMBER}\\s*[-–a]\\s*{T._NUMBER}\\s*\\+?\\s*{T._PEOPLE}', 2), '[.,]', '', 'g') AS BIGINT) > 0 THEN try_cast(regexp_replace(regexp_extract({_low}, '{T._NUMBER}\\s*[-–a]\\s*{T._NUMBER}\\s*\\+?\\s*{T._PEOPLE}', 2), '[.,]', '', 'g') AS BIGINT) END, list_max(list_filter(list_transform(regexp_extract_all({_low}, '{T._NUMBER}\\s*\\+?\\s*{T._PEOPLE}', 1), lambda x: try_cast(regexp_replace(x, '[.,]', '', 'g') AS BIGINT)), lambda n: n BETWEEN 1 AND 5000000)))"
_marks = ", ".join(f"({quoted([t])}, {quoted([k])})" for t, (_, ks) in L.RULES.items() for k in ks)
_hits = f"h AS (SELECT lote, sha1(tipo || '|' || palabra || '|' || substring(cita_textual, 1, 200)) AS senal, id FROM evidencias, (VALUES {_marks}) r(tipo, palabra) WHERE contains(lower(cita_textual), palabra))"
QUERIES = {
    "verticals_suggested": (verticals, "SELECT id, CASE " + " ".join(f"WHEN {sql_any(_low, hints)} THEN '{v}'" for v, hints in L.VERTICAL_HINTS.items()) + " END AS vertical FROM prospectos"),
    "changelog_titles": (changelogs, f"SELECT tipo_doc, count(*) AS n, count(*) FILTER ({sql_any('f', L.CHANGELOG_MARKS)}) AS de_version FROM (SELECT tipo_doc, lower(string_split(trim(coalesce(text, ''), ' '), chr(10))[1]) AS f FROM documents) GROUP BY 1"),
    "declared_profile": (profile, f"""WITH p AS (SELECT id, {_size} AS m, list_filter(list_transform(regexp_extract_all({_low}, '{T.FOUNDED}', 1), lambda y: try_cast(y AS INT)), lambda y: y BETWEEN 1900 AND {LAST_YEAR})[1] AS anio, coalesce(len(list_distinct(list_transform(regexp_extract_all(discurso_corporativo, '{T.MAILBOX}'), lambda x: lower(x)))), 0) AS correos FROM prospectos)
        SELECT id, CASE WHEN m IS NULL OR m < 1 THEN 'indeterminada' WHEN m <= 10 THEN '1-10' WHEN m <= 50 THEN '11-50' WHEN m <= 200 THEN '51-200' WHEN m <= 500 THEN '201-500' ELSE '501+' END AS escala, CAST(anio AS BIGINT) AS anio, correos FROM p"""),
    "source_health": (source_health, """WITH r AS (SELECT connector, creado_en, id, false AS ok FROM rechazos UNION ALL SELECT connector, creado_en, id, true FROM evidencias), i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY connector ORDER BY creado_en, ok, id ROWS UNBOUNDED PRECEDING) AS isla FROM r),
        f AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY connector, isla ORDER BY creado_en, ok, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k, row_number() OVER (PARTITION BY connector ORDER BY creado_en DESC, ok DESC, id DESC) AS z FROM i) SELECT connector, creado_en AS ultima, k AS fallos_seguidos, k >= 2 AS alerta FROM f WHERE z = 1"""),
    "org_overview": (org_overview, f"""WITH {VALIDATED}, s AS (SELECT coalesce({COMPANY.format(c="org_nombre")}, '') AS org, count(*) AS capturas, max(capturado_en) AS ultima_captura FROM drift_snapshots GROUP BY 1), a AS (SELECT org, count(DISTINCT id) AS senales FROM items, (VALUES {_marks}) r(tipo, palabra) WHERE org IS NOT NULL AND contains(lower(texto), palabra) GROUP BY 1),
        e AS (SELECT t.org, p.sitio_web AS sitio, p.escala FROM entidades t JOIN prospectos p ON p.id = t.primero) SELECT v.org, v.n, v.hipotesis, v.veredicto, v.solidez, e.sitio, e.escala, coalesce(s.capturas, 0) AS capturas, s.ultima_captura, coalesce(a.senales, 0) AS senales FROM v LEFT JOIN e USING (org) LEFT JOIN s USING (org) LEFT JOIN a USING (org)"""),
    "dossier_json": (dossier_json, f"WITH {DOSSIERS} SELECT org, CAST(json_object('interes', icp, 'hipotesis', hipotesis, 'n', n, 'org', org, 'senales', list_sort(tags), 'vertical', vertical) AS VARCHAR) AS documento FROM d"),
    "best_sourced": (best_sourced, f"WITH {ITEMS} SELECT org, id, confianza_cent, url FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY confianza_cent DESC, id) AS r FROM items WHERE org IS NOT NULL AND url <> '') WHERE r = 1"),
    "objectives": (objectives, f"WITH {ITEMS}, k AS (SELECT {COMPANY.format(c='nombre')} AS org, arg_min(categoria, id) FILTER (TRUE) AS c_, min(id) AS id FROM prospectos GROUP BY 1), o AS (SELECT DISTINCT org FROM items WHERE org IS NOT NULL) SELECT o.org, k.org IS NOT NULL AS conocida FROM o LEFT JOIN k USING (org) LEFT JOIN prospectos p ON p.id = k.id WHERE k.org IS NULL OR (p.categoria = 'Startup' AND p.escala IN ('11-50', '51-200'))"),
    "raw_resolved": (resolved, "WITH r AS (SELECT hash_dedup AS k, min(id) AS crudo FROM raw_store GROUP BY 1) SELECT e.id, coalesce(a.crudo, b.crudo) AS crudo FROM evidencias e LEFT JOIN r a ON a.k = e.hash_dedup LEFT JOIN r b ON b.k = e.raw_hash WHERE coalesce(a.crudo, b.crudo) IS NOT NULL"),
    "ranking_bands": (listing, f"WITH {DOSSIERS}, p AS (SELECT org, {_points} AS puntos10 FROM d) SELECT CAST(floor(puntos10 / 100) * 100 AS BIGINT) AS banda, count(*) AS n, min(org) AS primera, max(puntos10) AS mejor FROM p GROUP BY 1"),
    "panel": (panel, f"WITH {VALIDATED} SELECT count(*) AS organizaciones, CAST(sum(n) AS BIGINT) AS evidencias, count(*) FILTER (dolor) AS con_dolor, count(*) FILTER (len(patrones) > 0) AS con_patron, count(*) FILTER (bloqueada) AS bloqueadas, min(desde) AS desde, max(hasta) AS hasta, count(DISTINCT nullif(hipotesis, '')) AS hipotesis, count(*) FILTER (dolor AND profundidad >= 70 AND n <= 2) AS centinelas FROM v"),
    "signals_to_store": (new_signals, f"WITH {_hits}, f AS (SELECT senal, lote, id, row_number() OVER (PARTITION BY senal ORDER BY lote, id) AS r FROM h) SELECT senal, lote, id FROM f WHERE r = 1 AND lote >= {NEW_FROM}"),
    "event_order": (event_order, f"WITH {ITEMS}, f AS (SELECT org, tipo, min(id) AS primera FROM items WHERE org IS NOT NULL AND tipo <> '' GROUP BY 1, 2), s AS (SELECT tipo, lead(tipo) OVER (PARTITION BY org ORDER BY primera) AS sigue FROM f) SELECT tipo, sigue, count(*) AS n FROM s WHERE sigue IS NOT NULL GROUP BY 1, 2"),
}
