"""Queries over single records: contract, identity, tags, rules, relevance, reads and rejects."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import tagging as G
from tamiz.plans.base import TITLE, URL, quoted, sql_any
from tamiz.session import table


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidencias")


def contract_status(spark, d):
    e = ev(spark, d)
    return e.select(G.contract_status(e).alias("resultado")).groupBy("resultado").agg(F.count("*").alias("n"))


def rejects_by_reason(spark, d):
    return table(spark, d, "rechazos").groupBy("motivo").agg(F.count("*").alias("n"), F.count_distinct("payload_json").alias("distintos"))


def reject_payloads(spark, d):
    """Payloads by connector: readable, cut short, and without address."""
    r = table(spark, d, "rechazos").withColumn("j", F.from_json("payload_json", "map<string,string>", {"mode": "PERMISSIVE"}))
    whole = F.trim("payload_json").rlike(r"\}$")
    return r.groupBy("connector").agg(F.count("*").alias("n"), F.count_if(whole).alias("enteros"), F.count_if(~whole).alias("cortados"), F.count_if(whole & F.col("j")["url_fuente"].isNull()).alias("sin_url"))


def url_norm_groups(spark, d):
    return ev(spark, d).select(T.normal_url(F.col("url_fuente")).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


def url_host_counts(spark, d):
    return ev(spark, d).select(T.host_of(F.col("url_fuente")).alias("dominio")).groupBy("dominio").agg(F.count("*").alias("n"))


def title_hash(spark, d):
    return ev(spark, d).select("id", T.content_hash(F.col("cita_textual")).alias("hash"))


def title_hash_dups(spark, d):
    h = T.content_hash(F.col("cita_textual"))
    return ev(spark, d).select("id", h.alias("hash")).where("hash <> ''").groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("primero")).where("n > 1")


def content_keys(spark, d):
    return ev(spark, d).select("id", T.content_key(F.col("url_fuente"), F.col("cita_textual")).alias("clave"))


def contract_hash(spark, d):
    return ev(spark, d).select("id", T.contract_hash(F.col("empresa_mencionada"), F.col("url_fuente")).alias("hash"))


def tag_frequency(spark, d):
    return ev(spark, d).select(F.explode(G.tags(F.col("cita_textual"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def rule_hits(spark, d):
    hits = G.rule_hits(ev(spark, d), "id", "cita_textual")
    return hits.select("id", "tipo", "palabra", "peso", F.substring(F.sha1(F.concat_ws("|", F.col("id").cast("string"), "tipo", "palabra")), 1, 16).alias("senal_id"))


def rule_alerts(spark, d):
    a = ev(spark, d).select(G.rule_alert(F.col("cita_textual")).alias("a"))
    return a.groupBy("a.alerta").agg(F.count("*").alias("n"), F.sum("a.puntos").alias("puntos")).select("alerta", "n", "puntos")


def relevance_reasons(spark, d):
    e = ev(spark, d)
    reason = G.relevance(F.col("cita_textual"), F.size(G.tags(F.col("cita_textual"))) > 0, F.col("empresa_mencionada").isNotNull())
    return e.select(reason.alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


def capture_confidence(spark, d):
    dated, tagged = F.col("fecha_publicacion").isNotNull(), F.size(G.tags(F.col("cita_textual"))) > 0
    c = G.capture_confidence_hundredths(dated, G.named_source(F.col("nombre_medio")), tagged)
    return ev(spark, d).select(c.alias("centesimas")).groupBy("centesimas").agg(F.count("*").alias("n"))


def capture_quality(spark, d):
    q = G.capture_quality(F.col("empresa_mencionada").isNotNull(), F.size(G.tags(F.col("cita_textual"))) > 0, G.named_source(F.col("nombre_medio")))
    return ev(spark, d).select(q.alias("calidad")).groupBy("calidad").agg(F.count("*").alias("n"))


def vertical_histogram(spark, d):
    return table(spark, d, "prospectos").groupBy(F.coalesce("vertical", F.lit("sin_vertical")).alias("vertical")).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("discurso_corporativo", F.lit(""))) != "").alias("con_discurso"))


def filtered(e: DataFrame, company: str | None = None, event: str | None = None, category: str | None = None, since: str | None = None, until: str | None = None, least: float | None = None) -> DataFrame:
    """Consumable evidence under optional conditions, all of which must hold; they reach the scan. Dates compare as text."""
    e = e.where("estado = 'ok'")
    for column, value in (("empresa_mencionada", company), ("tipo_evento", event), ("categoria", category)):
        if value is not None:
            e = e.where(F.col(column) == value)
    if since is not None:
        e = e.where(F.col("fecha_publicacion") >= since)
    if until is not None:
        e = e.where(F.col("fecha_publicacion") <= until)
    return e if least is None else e.where(F.col("confianza") >= least)


def evidence_page(spark, d, offset: int = 100, limit: int = 50, **conditions):
    """A page of filtered evidence, newest first."""
    e = filtered(ev(spark, d), **(conditions or {"event": "queja"}))
    return e.orderBy(F.desc("creado_en"), F.desc("id")).offset(offset).limit(limit).select("id", "creado_en", "nombre_medio", "empresa_mencionada")


def evidence_count(spark, d, **conditions):
    """How many rows the pages of a filter have, by category."""
    return filtered(ev(spark, d), **(conditions or {"event": "queja"})).groupBy("categoria").agg(F.count("*").alias("n"))


def evidence_point(spark, d, key: int = 100):
    """One record by id, if it is consumable."""
    return filtered(ev(spark, d)).where(F.col("id") == key).select("id", "cita_textual", "url_fuente", "confianza")


def corpus_page(spark, d, offset: int = 0, limit: int = 200, **conditions):
    """The corpus contract: by confidence, date and id."""
    e = filtered(ev(spark, d), **(conditions or {"least": 0.7}))
    return e.orderBy(F.desc("confianza"), F.desc("creado_en"), F.desc("id")).offset(offset).limit(limit).select("id", "confianza", "creado_en", "tipo_evento", "url_fuente")


def entity_search(spark, d, text: str = "grupo", category: str | None = None, size: str | None = None, told: bool | None = True):
    """Entities by part of the name, category, size and whether they have a discourse, by name."""
    p = table(spark, d, "prospectos").where(F.contains(F.lower("nombre"), F.lit(text.lower())))
    has = F.trim(F.coalesce("discurso_corporativo", F.lit(""))) != ""
    for condition in (category is not None and F.col("categoria") == category, size is not None and F.col("escala") == size, told is not None and (has if told else ~has)):
        if condition is not False:
            p = p.where(condition)
    return p.select("id", "nombre", "categoria")


def table_counts(spark, d):
    """Rows of each table of the project."""
    names = ("evidencias", "prospectos", "drift_snapshots", "rechazos", "raw_store", "documents")
    one = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("tabla"), "n") for n in names]
    return functools.reduce(DataFrame.unionByName, one)


def latest_signals(spark, d, limit: int = 100):
    """The newest critical alerts of the keyword rules."""
    a = ev(spark, d).select("id", "creado_en", G.rule_alert(F.col("cita_textual")).alias("a")).where("a.puntos > 0")
    return a.orderBy(F.desc("a.puntos"), F.desc("creado_en"), F.desc("id")).limit(limit).select("id", "a.puntos", "a.alerta")


def daily_centre(spark, d, day: str = "2024-06-01", stale: int = 7):
    """What a day looks like per organisation: rows of the day, rows ever, and whether it has gone stale by then."""
    e = ev(spark, d).select(T.company_key(F.col("empresa_mencionada")).alias("org"), F.substring("creado_en", 1, 10).alias("dia")).where((F.col("org") != "") & (F.col("dia") <= day))
    g = e.groupBy("org").agg(F.count("*").alias("n"), F.count_if(F.col("dia") == day).alias("hoy"), F.max("dia").alias("ultimo"))
    return g.select("org", "n", "hoy", "ultimo", (F.date_diff(F.lit(day), F.col("ultimo")) > stale).alias("vencida"))


def entity_keys(spark, d):
    """Keys of entities: by name and category, the stable one by name, and the short one by name alone."""
    name = T.company_key(F.col("nombre"))
    return table(spark, d, "prospectos").select("id", F.sha2(F.concat_ws("|", name, F.coalesce("categoria", F.lit(""))), 256).alias("clave"), F.sha2(F.concat(F.lit("candidato:v1|"), name), 256).alias("estable"), F.substring(F.sha2(F.lower(F.trim("nombre")), 256), 1, 32).alias("corta"))


def signal_keys(spark, d):
    """Identity of a signal: address and company, else the title's hash."""
    url, h = T.normal_url(F.col("url_fuente")), T.content_hash(F.col("cita_textual"))
    k = F.when(url != "", F.concat(F.lit("url:"), F.sha2(url, 256), F.lit("|"), h)).when(h != "", F.concat(F.lit("txt:"), h)).otherwise(F.concat(F.lit("dup:"), F.sha2(T.company_key(F.col("empresa_mencionada")), 256)))
    return ev(spark, d).select("id", k.alias("clave"))


def seeded_sample(spark, d, seed: int = 7, size: int = 100):
    """A repeatable sample: the rows with the least seeded hash of their id; the feature is the sample."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256)
    return ev(spark, d).select("id", h.alias("h")).orderBy("h", "id").limit(size)


def first_ids_by_url(spark, d):
    """The evidence that stands for an address: its least id."""
    return ev(spark, d).where(F.trim("url_fuente") != "").groupBy(F.col("url_fuente").alias("url")).agg(F.min("id").alias("id"))


def task_plan(spark, d):
    """The capture plan: every category with every kind of event and every query variant; a product of small fixed vocabularies."""
    dim = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return dim("categoria", L.CATEGORIES).crossJoin(dim("tipo_evento", L.EVENT_TYPES)).crossJoin(dim("variante", ("exacta", "amplia")))


def entity_contract(spark, d):
    """Outcome of the entity contract: name, category and size in their vocabularies."""
    p = table(spark, d, "prospectos")
    bands = ("1-10", "11-50", "51-200", "201-500", "501+", "indeterminada")
    r = F.when(F.trim(F.coalesce("nombre", F.lit(""))) == "", "campo_obligatorio_vacio:nombre").when(~F.coalesce("categoria", F.lit("")).isin(*L.CATEGORIES), "categoria_invalida").when(~F.coalesce("escala", F.lit("indeterminada")).isin(*bands), "escala_invalida").otherwise("ok")
    return p.select(r.alias("resultado")).groupBy("resultado").agg(F.count("*").alias("n"))


def stats_counts(spark, d):
    e = ev(spark, d)
    return e.agg(
        F.count("*").alias("evidencias"), F.count_if(F.col("estado") == "ok").alias("consumibles"), F.count("persona_citada").alias("con_persona"), F.count_distinct("nombre_medio").alias("medios"),
        F.count_distinct("empresa_mencionada").alias("empresas"), F.count("raw_hash").alias("con_crudo"),
    )


def category_zero_fill(spark, d):
    dim = spark.createDataFrame([(c, k) for k, c in enumerate((*L.CATEGORIES, "Fondo"))], "categoria string, posicion int")
    n = table(spark, d, "prospectos").groupBy("categoria").agg(F.count("*").alias("n"))
    return dim.join(n, "categoria", "left").select("categoria", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def quality_histogram(spark, d):
    return ev(spark, d).groupBy(F.coalesce("calidad_captura", F.lit("sin_calidad")).alias("calidad")).agg(F.count("*").alias("n"))


def mailbox_sources(spark, d):
    """Mailboxes of the corporate texts with the number of entities that state them; two or more confirm one another."""
    p = table(spark, d, "prospectos").select("id", F.explode(T.mailboxes(F.col("discurso_corporativo"))).alias("correo"))
    return p.groupBy("correo").agg(F.count_distinct("id").alias("fuentes")).select("correo", "fuentes", (F.col("fuentes") >= 2).alias("confirmado"), T.mailbox_generic(F.col("correo")).alias("generico"))


def headcount_bands(spark, d):
    n = F.array_max(T.numbers_before(F.col("discurso_corporativo"), "empleados|personas|staff|funcionários"))
    return table(spark, d, "prospectos").select(T.size_band(n).alias("banda")).groupBy("banda").agg(F.count("*").alias("n"))


def founding_years(spark, d):
    y = F.regexp_extract("discurso_corporativo", r"fundada en ((?:19|20)[0-9]{2})", 1)
    return table(spark, d, "prospectos").select(y.alias("anio")).where("anio <> ''").groupBy("anio").agg(F.count("*").alias("n"))


def slugs(spark, d):
    return table(spark, d, "prospectos").select("id", T.slug(F.col("nombre")).alias("slug"))


_tags_sql = "list_filter([" + ", ".join(f"CASE WHEN {sql_any('lower(cita_textual)', ps)} THEN '{t}' END" for t, ps in L.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_fold = "lower(strip_accents(cita_textual))"
_reason = (
    f"CASE WHEN {sql_any(_fold, L.OPINION_MARKS)} OR regexp_matches({_fold}, '{L.LIST_TITLE}') THEN 'relevancia:opinion' WHEN {sql_any(_fold, L.FOREIGN)} THEN 'relevancia:no_latam' "
    f"WHEN {sql_any(_fold, L.NOT_A_COMPANY)} OR regexp_matches({_fold}, '{L.REPORT_TITLE}') THEN 'relevancia:no_empresa' WHEN {sql_any(_fold, L.MEDIA_NOISE)} THEN 'relevancia:ruido_mediatico' "
    f"WHEN {sql_any(_fold, L.GIANTS)} THEN 'relevancia:gigante' WHEN {sql_any(_fold, L.SHALLOW_EVENTS)} THEN 'relevancia:sin_profundidad_estructural' "
    f"WHEN empresa_mencionada IS NULL THEN 'relevancia:sin_empresa' WHEN len({_tags_sql}) = 0 THEN 'relevancia:sin_evento' ELSE '' END"
)
_rules_values = ", ".join(f"('{t}', '{k}', CAST({w} AS DOUBLE))" for t, (w, ks) in L.RULES.items() for k in ks)
_points = " + ".join(f"CASE WHEN contains(lower(cita_textual), '{k}') THEN CAST({w} AS DOUBLE) ELSE 0 END" for w, ks in L.RULES.values() for k in ks)
_named = f"lower(trim(coalesce(nombre_medio, ''))) NOT IN ({quoted(L.GENERIC_SOURCES)})"
_url, _title, _company = URL.format(c="url_fuente"), TITLE.format(c="cita_textual"), "lower(trim(regexp_replace(empresa_mencionada, '\\s+', ' ', 'g')))"
_title_hash = f"CASE WHEN coalesce({_title}, '') = '' THEN '' ELSE sha256({_title}) END"
_iso = G.ISO
_blank = " ".join(f"WHEN trim(coalesce({c}, '')) = '' THEN 'campo_obligatorio_vacio:{c}'" for c in ("cita_textual", "fecha_extraccion", "url_fuente", "nombre_medio", "empresa_mencionada", "tipo_evento", "origen_declaracion", "hash_dedup"))
_name = "lower(trim(regexp_replace(nombre, '\\s+', ' ', 'g')))"
_has_text = "trim(coalesce(discurso_corporativo, '')) <> ''"
_numbers = "list_transform(regexp_extract_all(lower(discurso_corporativo), '([0-9][0-9.]*)\\s+(?:empleados|personas|staff|funcionários)', 1), lambda x: try_cast(replace(x, '.', '') AS BIGINT))"

QUERIES = {
    "ev_contract_status": (contract_status, f"""SELECT resultado, count(*) AS n FROM (SELECT CASE {_blank} WHEN tipo_evento NOT IN ({quoted(L.EVENT_TYPES)}) THEN 'tipo_evento_invalido:' || tipo_evento
        WHEN origen_declaracion NOT IN ({quoted(L.ORIGINS)}) THEN 'origen_declaracion_invalido:' || origen_declaracion WHEN NOT regexp_matches(fecha_extraccion, '{_iso}') THEN 'fecha_extraccion_no_iso8601'
        WHEN trim(coalesce(fecha_publicacion, '')) = '' THEN 'no_fechado' WHEN NOT regexp_matches(fecha_publicacion, '{_iso}') THEN 'fecha_publicacion_no_iso8601' ELSE 'ok' END AS resultado FROM evidencias) GROUP BY 1"""),
    "ev_rejects_by_reason": (rejects_by_reason, "SELECT motivo, count(*) AS n, count(DISTINCT payload_json) AS distintos FROM rechazos GROUP BY motivo"),
    "reject_payloads": (reject_payloads, """SELECT connector, count(*) AS n, count(*) FILTER (entero) AS enteros, count(*) FILTER (NOT entero) AS cortados, count(*) FILTER (entero AND url IS NULL) AS sin_url
        FROM (SELECT connector, regexp_matches(trim(payload_json), '\\}$') AS entero, CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.url_fuente') END AS url FROM rechazos) GROUP BY connector"""),
    "url_norm_groups": (url_norm_groups, f"SELECT coalesce({_url}, '') AS url, count(*) AS n FROM evidencias GROUP BY 1"),
    "url_host_counts": (url_host_counts, "SELECT regexp_replace(regexp_extract(lower(trim(url_fuente)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\\.', '') AS dominio, count(*) AS n FROM evidencias GROUP BY 1"),
    "title_hash": (title_hash, f"SELECT id, {_title_hash} AS hash FROM evidencias"),
    "title_hash_dups": (title_hash_dups, f"SELECT hash, count(*) AS n, min(id) AS primero FROM (SELECT id, {_title_hash} AS hash FROM evidencias) WHERE hash <> '' GROUP BY hash HAVING count(*) > 1"),
    "content_keys": (content_keys, f"SELECT id, CASE WHEN coalesce({_url}, '') <> '' THEN 'url:' || {_url} WHEN {_title_hash} <> '' THEN 'txt:' || {_title_hash} ELSE '' END AS clave FROM evidencias"),
    "contract_hash": (contract_hash, f"SELECT id, sha256(coalesce({_company}, '') || '|' || coalesce({_url}, '')) AS hash FROM evidencias"),
    "tag_frequency": (tag_frequency, f"SELECT tag, count(*) AS n FROM (SELECT unnest({_tags_sql}) AS tag FROM evidencias) GROUP BY tag"),
    "rule_hits": (rule_hits, f"SELECT id, tipo, palabra, peso, substring(sha1(CAST(id AS VARCHAR) || '|' || tipo || '|' || palabra), 1, 16) AS senal_id FROM evidencias, (VALUES {_rules_values}) r(tipo, palabra, peso) WHERE contains(lower(cita_textual), palabra)"),
    "rule_alerts": (rule_alerts, f"SELECT CASE WHEN puntos >= {L.CRITICAL_FROM} THEN 'Crítica' ELSE 'Normal' END AS alerta, count(*) AS n, sum(puntos) AS puntos FROM (SELECT {_points} AS puntos FROM evidencias) GROUP BY 1"),
    "relevance_reasons": (relevance_reasons, f"SELECT {_reason} AS motivo, count(*) AS n FROM evidencias GROUP BY 1"),
    "capture_confidence": (capture_confidence, f"SELECT CAST(40 + CASE WHEN fecha_publicacion IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN {_named} THEN 20 ELSE 0 END + CASE WHEN len({_tags_sql}) > 0 THEN 15 ELSE 0 END AS BIGINT) AS centesimas, count(*) AS n FROM evidencias GROUP BY 1"),
    "capture_quality": (capture_quality, f"SELECT CASE WHEN k >= 3 THEN 'Alta' WHEN k = 2 THEN 'Media' ELSE 'Baja' END AS calidad, count(*) AS n FROM (SELECT CAST(empresa_mencionada IS NOT NULL AS INT) + CAST(len({_tags_sql}) > 0 AS INT) + CAST({_named} AS INT) AS k FROM evidencias) GROUP BY 1"),
    "vertical_histogram": (vertical_histogram, f"SELECT coalesce(vertical, 'sin_vertical') AS vertical, count(*) AS n, count(*) FILTER ({_has_text}) AS con_discurso FROM prospectos GROUP BY 1"),
    "evidence_page": (evidence_page, "SELECT id, creado_en, nombre_medio, empresa_mencionada FROM evidencias WHERE estado = 'ok' AND tipo_evento = 'queja' ORDER BY creado_en DESC, id DESC LIMIT 50 OFFSET 100"),
    "corpus_page": (corpus_page, "SELECT id, confianza, creado_en, tipo_evento, url_fuente FROM evidencias WHERE confianza >= 0.7 AND estado = 'ok' ORDER BY confianza DESC, creado_en DESC, id DESC LIMIT 200"),
    "entity_search": (entity_search, f"SELECT id, nombre, categoria FROM prospectos WHERE contains(lower(nombre), 'grupo') AND {_has_text}"),
    "evidence_count": (evidence_count, "SELECT categoria, count(*) AS n FROM evidencias WHERE estado = 'ok' AND tipo_evento = 'queja' GROUP BY 1"),
    "evidence_point": (evidence_point, "SELECT id, cita_textual, url_fuente, confianza FROM evidencias WHERE estado = 'ok' AND id = 100"),
    "table_counts": (table_counts, " UNION ALL ".join(f"SELECT '{t}' AS tabla, count(*) AS n FROM {t}" for t in ("evidencias", "prospectos", "drift_snapshots", "rechazos", "raw_store", "documents"))),
    "latest_signals": (latest_signals, f"SELECT id, puntos, CASE WHEN puntos >= {L.CRITICAL_FROM} THEN 'Crítica' ELSE 'Normal' END AS alerta FROM (SELECT id, creado_en, {_points} AS puntos FROM evidencias) WHERE puntos > 0 ORDER BY puntos DESC, creado_en DESC, id DESC LIMIT 100"),
    "daily_centre": (daily_centre, f"WITH e AS (SELECT coalesce({_company}, '') AS org, substring(creado_en, 1, 10) AS dia FROM evidencias) SELECT org, count(*) AS n, count(*) FILTER (dia = '2024-06-01') AS hoy, max(dia) AS ultimo, date_diff('day', CAST(max(dia) AS DATE), DATE '2024-06-01') > 7 AS vencida FROM e WHERE org <> '' AND dia <= '2024-06-01' GROUP BY 1"),
    "entity_keys": (entity_keys, f"SELECT id, sha256({_name} || '|' || coalesce(categoria, '')) AS clave, sha256('candidato:v1|' || {_name}) AS estable, substring(sha256(lower(trim(nombre))), 1, 32) AS corta FROM prospectos"),
    "signal_keys": (signal_keys, f"SELECT id, CASE WHEN coalesce({_url}, '') <> '' THEN 'url:' || sha256({_url}) || '|' || {_title_hash} WHEN {_title_hash} <> '' THEN 'txt:' || {_title_hash} ELSE 'dup:' || sha256(coalesce({_company}, '')) END AS clave FROM evidencias"),
    "seeded_sample": (seeded_sample, "SELECT id, sha256('7|' || id) AS h FROM evidencias ORDER BY h, id LIMIT 100"),
    "first_ids_by_url": (first_ids_by_url, "SELECT url_fuente AS url, min(id) AS id FROM evidencias WHERE trim(url_fuente) <> '' GROUP BY 1"),
    "task_plan": (task_plan, f"SELECT * FROM (VALUES {', '.join(f'({quoted([c])})' for c in L.CATEGORIES)}) a(categoria), (VALUES {', '.join(f'({quoted([c])})' for c in L.EVENT_TYPES)}) b(tipo_evento), (VALUES ('exacta'), ('amplia')) c(variante)"),
    "entity_contract": (entity_contract, f"SELECT CASE WHEN trim(coalesce(nombre, '')) = '' THEN 'campo_obligatorio_vacio:nombre' WHEN coalesce(categoria, '') NOT IN ({quoted(L.CATEGORIES)}) THEN 'categoria_invalida' WHEN coalesce(escala, 'indeterminada') NOT IN ('1-10', '11-50', '51-200', '201-500', '501+', 'indeterminada') THEN 'escala_invalida' ELSE 'ok' END AS resultado, count(*) AS n FROM prospectos GROUP BY 1"),
    "stats_counts": (stats_counts, "SELECT count(*) AS evidencias, count(*) FILTER (estado = 'ok') AS consumibles, count(persona_citada) AS con_persona, count(DISTINCT nombre_medio) AS medios, count(DISTINCT empresa_mencionada) AS empresas, count(raw_hash) AS con_crudo FROM evidencias"),
    "category_zero_fill": (category_zero_fill, f"SELECT c.categoria, count(p.id) AS n FROM (VALUES {', '.join(f'({quoted([c])})' for c in (*L.CATEGORIES, 'Fondo'))}) c(categoria) LEFT JOIN prospectos p ON p.categoria = c.categoria GROUP BY 1"),
    "quality_histogram": (quality_histogram, "SELECT coalesce(calidad_captura, 'sin_calidad') AS calidad, count(*) AS n FROM evidencias GROUP BY 1"),
    "mailbox_sources": (mailbox_sources, f"SELECT correo, count(DISTINCT id) AS fuentes, count(DISTINCT id) >= 2 AS confirmado, regexp_matches(split_part(correo, '@', 1), '{T.GENERIC_LOCAL}') AS generico FROM (SELECT id, lower(unnest(regexp_extract_all(discurso_corporativo, '{T.MAILBOX}'))) AS correo FROM prospectos) GROUP BY correo"),
    "headcount_bands": (headcount_bands, f"SELECT CASE WHEN m IS NULL OR m < 1 THEN 'indeterminada' WHEN m <= 10 THEN '1-10' WHEN m <= 50 THEN '11-50' WHEN m <= 200 THEN '51-200' WHEN m <= 500 THEN '201-500' ELSE '501+' END AS banda, count(*) AS n FROM (SELECT list_max({_numbers}) AS m FROM prospectos) GROUP BY 1"),
    "founding_years": (founding_years, "SELECT anio, count(*) AS n FROM (SELECT regexp_extract(discurso_corporativo, 'fundada en ((?:19|20)[0-9]{2})', 1) AS anio FROM prospectos) WHERE anio <> '' GROUP BY anio"),
    "entity_slugs": (slugs, "SELECT id, regexp_replace(regexp_replace(lower(strip_accents(nombre)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM prospectos"),
}
