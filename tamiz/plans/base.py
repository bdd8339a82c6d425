"""Canonical inputs of the plans, and the SQL of the same inputs for the independent check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions.text import company_key, host_of
from tamiz.session import table


def items(spark: SparkSession, d: str) -> DataFrame:
    """Evidence items of ``evidencias``: undated where the row is not consumable. ``fuente`` is the independent source: the address's host, else the outlet."""
    e = table(spark, d, "evidencias")
    host, outlet = host_of(F.col("url_fuente")), F.trim(F.coalesce("nombre_medio", F.lit("")))
    return e.select(
        F.nullif(company_key(F.col("empresa_mencionada")), F.lit("")).alias("org"), "id", F.when(host != "", host).otherwise(F.lower(outlet)).alias("fuente"), outlet.alias("medio"),
        F.when(F.col("estado") == "ok", F.substring("creado_en", 1, 10)).alias("fecha"), F.floor(F.col("confianza") * 100 + 0.5).alias("confianza_cent"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("tags"), F.col("tipo_evento").alias("tipo"), "categoria", F.coalesce("calidad_captura", F.lit("")).alias("calidad"),
        "lote", F.trim(F.coalesce("url_fuente", F.lit(""))).alias("url"), F.trim(F.coalesce("cita_textual", F.lit(""))).alias("texto"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(``org``, ``vertical``, ``sitio``, ``escala``): the directory's entities by name; of several rows the first vertical that is stated, and site and size of the first."""
    p = table(spark, d, "prospectos").select(F.nullif(company_key(F.col("nombre")), F.lit("")).alias("org"), "id", "vertical", "sitio_web", "escala").where("org is not null")
    stated = F.when(F.trim(F.coalesce("vertical", F.lit(""))) != "", F.struct("id", "vertical"))
    return p.groupBy("org").agg(F.min(stated)["vertical"].alias("vertical"), F.min(F.struct("id", "sitio_web", "escala")).alias("e")).select("org", "vertical", F.col("e.sitio_web").alias("sitio"), "e.escala")


def quoted(values) -> str:
    """A list of SQL string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_any(column: str, phrases) -> str:
    """SQL: whether the column contains one of the phrases."""
    return "coalesce(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ", false)"


HOST = "regexp_replace(regexp_extract(lower(trim({c})), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\\.', '')"
COMPANY = "nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"
ITEMS = f"""items AS (
  SELECT {COMPANY.format(c="empresa_mencionada")} AS org, id, CASE WHEN coalesce({HOST.format(c="url_fuente")}, '') <> '' THEN {HOST.format(c="url_fuente")} ELSE lower(trim(coalesce(nombre_medio, ''))) END AS fuente,
         trim(coalesce(nombre_medio, '')) AS medio, CASE WHEN estado = 'ok' THEN substring(creado_en, 1, 10) END AS fecha, CAST(floor(confianza * 100 + 0.5) AS BIGINT) AS confianza_cent,
         coalesce(keywords, []) AS tags, tipo_evento AS tipo, categoria, coalesce(calidad_captura, '') AS calidad, lote, trim(coalesce(url_fuente, '')) AS url, trim(coalesce(cita_textual, '')) AS texto
  FROM evidencias)"""
ENTITIES = f"""entidades AS (
  SELECT org, arg_min(vertical, id) FILTER (trim(coalesce(vertical, '')) <> '') AS vertical, min(id) AS primero FROM (SELECT *, {COMPANY.format(c="nombre")} AS org FROM prospectos) WHERE org IS NOT NULL GROUP BY 1)"""


def listed(*cases: tuple[str, str]) -> str:
    """SQL: the list of the values whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in cases) + "], lambda x: x IS NOT NULL)"


def chosen(column: str, table: dict, other: str) -> str:
    """SQL: the value of a constant table."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + f" ELSE {other} END"


_flag = ", ".join(f"bool_or(list_contains(tags, '{t}')) AS f_{t}" for t in L.PRIORITY)
_flag += ", " + ", ".join(f"bool_or(tipo = '{t}') AS e_{t}" for t in L.EVENT_TYPES)
_set = lambda prefix, names: listed(*[(f"bool_or({prefix}{t})", f"'{t}'") for t in names])
_dominant = "CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN '{t}'" for t in L.PRIORITY) + " END"
_pat = listed(*[(f"list_contains(tags, '{a}') AND list_contains(tags, '{b}')", f"'{label}'") for (a, b), label in L.COMBINATIONS])
_amplifier = "CASE " + " ".join(f"WHEN vertical = '{v}' AND dominante = '{t}' THEN CAST({x} AS DOUBLE)" for v, ts in L.AMPLIFIER.items() for t, x in ts.items()) + " ELSE CAST(1 AS DOUBLE) END"
_labels = listed(*[(f"list_contains(tags, '{t}')", f"'{L.HYPOTHESIS[t]}'") for t in L.PRIORITY])
_dossiers = """, por_fuente AS (
  SELECT {k}, fuente, count(*) AS n, CASE WHEN fuente <> '' THEN min(1 - confianza_cent / 100.0) ELSE product(1 - confianza_cent / 100.0) END AS duda, count(fecha) AS fechadas, min(fecha) AS desde, max(fecha) AS hasta,
         arg_max(calidad, (confianza_cent, -id)) AS calidad, max((confianza_cent, -id)) AS clave, arg_min(categoria, id) FILTER (TRUE) AS cat_, min(id) AS primera, {flag}
  FROM items WHERE org IS NOT NULL GROUP BY {k}, fuente),
d00 AS (
  SELECT {k}, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) FILTER (fuente <> '') AS BIGINT) AS fuentes,
         floor((1 - product(duda)) * 1000000 + 0.5) / 1000000.0 AS confianza, CAST(sum(fechadas) AS BIGINT) AS fechadas,
         min(desde) AS desde, max(hasta) AS hasta, arg_max(calidad, clave) AS calidad, max(clave[1]) AS mejor_cent, min(primera) AS primera, {tags} AS tags, {events} AS eventos
  FROM por_fuente GROUP BY {k}),
d0 AS (SELECT d00.*, lower(trim(coalesce(t.vertical, ''))) AS vertical, (SELECT any_value(e.categoria) FROM evidencias e WHERE e.id = d00.primera) AS categoria FROM d00 LEFT JOIN entidades t ON t.org = d00.org),
d1 AS (SELECT *, {pat} AS patrones, {dominant} AS dominante FROM d0),
d2 AS (
  SELECT *, coalesce(patrones[1], {hyp}) AS hipotesis, CAST(least(floor(({depth}) * ({amplifier})), 100) AS BIGINT) AS profundidad,
         list_has_any(tags, [{pain}]) AS dolor, list_has_any(tags, [{change}]) AS cambio, len(list_filter(tags, lambda x: x IN ({pain}))) AS ndolor,
         CASE WHEN list_has_any(tags, [{pain}]) THEN 'A' WHEN list_has_any(tags, [{change}]) OR dominante = 'lanzamiento' THEN 'B' ELSE 'C' END AS clase
  FROM d1),
d AS (
  SELECT *, CAST(least(100, 10 + floor(profundidad * CAST(0.4 AS DOUBLE)) + CASE WHEN vertical IN ({verticals}) THEN 15 ELSE 0 END + CASE WHEN ndolor >= 2 THEN 20 WHEN ndolor = 1 THEN 15 WHEN cambio THEN 5 ELSE 0 END
           + round_even(greatest(0, least(100, mejor_cent)) / 10.0, 0) + {quality}) AS BIGINT) AS icp,
         CASE WHEN ndolor >= 2 OR (ndolor >= 1 AND mejor_cent >= 80) THEN 'Alta' WHEN ndolor >= 1 OR (cambio AND mejor_cent >= 70) THEN 'Media' ELSE 'Baja' END AS intensidad,
         coalesce(list_filter({labels}, lambda x: x <> hipotesis)[1], '') AS secundaria,
         CASE WHEN clase = 'A' AND profundidad >= 50 THEN 'alta' WHEN clase = 'A' THEN 'media' WHEN clase = 'B' AND profundidad >= 30 AND vertical IN ({verticals}) THEN 'media'
              WHEN clase = 'B' OR profundidad > 0 THEN 'baja' ELSE 'descartable' END AS viabilidad, {decider} AS decisor
  FROM d2)"""
_parts = {
    "flag": _flag, "tags": _set("f_", L.PRIORITY), "events": _set("e_", L.EVENT_TYPES), "pat": _pat, "dominant": _dominant, "hyp": chosen("dominante", L.HYPOTHESIS, "''"), "depth": chosen("dominante", L.DEPTH, "0"), "amplifier": _amplifier,
    "pain": quoted(L.PAIN), "change": quoted(L.CHANGE), "verticals": quoted(L.VERTICALS), "quality": chosen("calidad", L.QUALITY_POINTS, "0"), "labels": _labels, "decider": chosen("dominante", L.DECIDER, f"'{L.ANY_DECIDER}'"),
}
_built, _inferred = _dossiers.format(k="org", **_parts).split(",\nd1 AS", 1)
_inferred = ",\nd1 AS" + _inferred
DOSSIERS = ITEMS + ",\n" + ENTITIES + _built + _inferred
#: One analysis per evidence row.
CARDS = ITEMS + ",\n" + ENTITIES + ", d0 AS (SELECT i.*, i.confianza_cent AS mejor_cent, lower(trim(coalesce(t.vertical, ''))) AS vertical FROM items i LEFT JOIN entidades t ON t.org = i.org)" + _inferred
#: Dossiers of each batch apart.
BY_BATCH = ITEMS + ",\n" + ENTITIES + _dossiers.format(k="org, lote", **_parts)
_validated = f"""v0 AS (
  SELECT *, CAST(floor(greatest(0.0, least(100.0, 40.0 * least(n, 3) / 3 + 30.0 * least(fuentes, 2) / 2 + 20.0 * fechadas / n + 10.0 * least(len(tags), 3) / 3)) + 0.5) AS BIGINT) AS suficiencia,
    {listed(("dolor AND cambio AND len(patrones) = 0", "'dolor_y_crecimiento_sin_patron'"), ("list_contains(eventos, 'despido') AND list_contains(eventos, 'contratacion')", "'eventos_opuestos'"), ("clase = 'A' AND viabilidad = 'descartable'", "'prioridad_vs_viabilidad'"))} AS contradicciones,
    {listed(("vertical = ''", "'sin_vertical'"), ("fuentes < 2", "'fuente_unica'"), ("n < 3", "'corpus_escaso'"), ("fechadas < n", "'evidencia_sin_fecha'"), ("len(tags) <= 1", "'senal_unica'"), ("len(patrones) = 0", "'sin_convergencia'"), ("profundidad >= 70 AND n <= 1", "'profundidad_sin_volumen'"))} AS vacios
  FROM d),
v1 AS (
  SELECT *, CAST(floor(greatest(0.0, least(100.0, 25.0 * least(n, 6) / 6 + 20.0 * least(fuentes, 3) / 3 + 15.0 * least(len(patrones), 2) / 2 + CAST(0.2 AS DOUBLE) * profundidad + 20.0 * confianza
    - least(10 * len(contradicciones), 30) - least(3 * len(vacios), 15))) + 0.5) AS BIGINT) AS solidez FROM v0),
v2 AS (
  SELECT *, CASE WHEN solidez >= 65 AND suficiencia >= 60 AND len(contradicciones) = 0 AND fuentes >= 2 THEN 'I'
                 WHEN solidez >= 45 AND suficiencia >= 45 AND len(contradicciones) = 0 THEN 'II' WHEN solidez >= 25 OR suficiencia >= 25 THEN 'III' ELSE 'IV' END AS nivel,
    {listed(("n < 3", "'corpus'"), ("fuentes < 2", "'corroboracion'"), ("suficiencia < 40", "'suficiencia'"), ("solidez < 40", "'solidez'"))} AS motivos
  FROM v1),
v AS (
  SELECT *, hipotesis = '' OR len(motivos) > 0 AS bloqueada, CASE WHEN hipotesis = '' THEN 'SIN_HIPOTESIS' WHEN len(motivos) > 0 THEN 'BLOQUEADA' WHEN len(contradicciones) > 0 THEN 'NO_VALIDADA'
                 WHEN solidez >= 65 AND suficiencia >= 60 THEN 'VALIDADA' WHEN solidez >= 40 AND suficiencia >= 40 THEN 'VALIDADA_PARCIAL' ELSE 'NO_VALIDADA' END AS veredicto FROM v2)"""
VALIDATED = DOSSIERS + ", " + _validated
VALIDATED_BY_BATCH = BY_BATCH + ", " + _validated
#: SQL of the normal address, title and accents, for use as f-string parts.
URL = "regexp_replace(lower(regexp_extract(regexp_replace(trim({c}), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) || substring(regexp_replace(trim({c}), '[?#].*$', ''), length(regexp_extract(regexp_replace(trim({c}), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) + 1), '/+$', '')"
TITLE = "trim(regexp_replace(lower(strip_accents(CASE WHEN trim(regexp_replace({c}, '\\s+-\\s+[^-]+$', '')) = '' THEN {c} ELSE trim(regexp_replace({c}, '\\s+-\\s+[^-]+$', '')) END)), '[^a-z0-9]+', ' ', 'g'))"
