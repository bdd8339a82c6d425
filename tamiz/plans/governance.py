"""Queries over versions, fingerprints, integrity, certificates and the longitudinal memory of dossiers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz import lexicon as L
from tamiz.operators import governance as G
from tamiz.operators.dossier import dossiers, validated
from tamiz.operators.ordering import positions
from tamiz.plans.base import ITEMS, VALIDATED, VALIDATED_BY_BATCH, entities, items, listed
from tamiz.session import table


def identified(spark, d):
    """Items with the hash of their identity."""
    i = items(spark, d).join(table(spark, d, "evidencias").select("id", F.col("fecha_publicacion").alias("fecha_declarada")), "id")
    return i.withColumn("h", G.identity_hash(i))


def printed(spark, d, until: int | None = None):
    """Fingerprinted dossiers over the batches up to ``until``, all by default."""
    i = identified(spark, d).where("org is not null")
    if until is not None:
        i = i.where(F.col("lote") <= until)
    roots = G.hash_tree(i, ["org"], "h").select("org", "raiz")
    traced = i.groupBy("org").agg(F.count_if((F.col("url") != "") & (F.col("medio") != "")).alias("trazables"))
    return G.fingerprints(validated(dossiers(i, entities(spark, d))).join(roots, "org").join(traced, "org"))


#: Batch up to which the earlier fingerprints of ``integrity_check`` and ``version_diff`` reach.
EARLIER = 12


def identity_hashes(spark, d):
    return identified(spark, d).select("id", F.col("h").alias("hash"))


def corpus_version(spark, d):
    """Version of each batch: the root over the record hashes."""
    return G.hash_tree(table(spark, d, "evidencias").select("lote", "hash_dedup"), ["lote"], "hash_dedup").select("lote", "n", F.col("raiz").alias("version"))


def org_corpus_version(spark, d):
    return G.hash_tree(identified(spark, d).where("org is not null"), ["org"], "h").select("org", "n", F.col("raiz").alias("version"))


def component_versions(spark, d):
    return spark.createDataFrame(G.component_versions(), "componente string, version string, hash string")


def dossier_versions(spark, d):
    return printed(spark, d).select("org", "contenido")


def fingerprint(spark, d):
    return printed(spark, d).select("org", "huella", "huella_id")


def integrity(spark, d):
    """Organisations of the earlier fingerprints: whether dossier, corpus and taxonomy still are what was signed."""
    old, new = printed(spark, d, EARLIER).select("org", "contenido", "raiz"), printed(spark, d).select("org", F.col("contenido").alias("c2"), F.col("raiz").alias("r2"))
    j = old.join(new, "org", "left")
    return j.select("org", F.col("contenido").eqNullSafe(F.col("c2")).alias("expediente_ok"), F.col("raiz").eqNullSafe(F.col("r2")).alias("corpus_ok"), F.lit(True).alias("taxonomia_ok"))


def consistency(spark, d):
    """Three checks of each dossier against its validation."""
    v = printed(spark, d)
    blocked = F.col("bloqueada").eqNullSafe(F.col("veredicto").isin("BLOQUEADA", "SIN_HIPOTESIS"))
    return v.select("org", F.lit(True).alias("reproducibilidad_declarada"), blocked.alias("bloqueo_coherente"), F.col("veredicto").isin(*L.VERDICTS).alias("veredicto_conocido"))


def version_diff(spark, d):
    """What differs between the earlier and the present fingerprint of each organisation, by component; new and vanished ones too."""
    fields = ("contenido", "raiz", "veredicto", "huella")
    long = lambda df, name: df.select("org", F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias(name)) for f in fields])).alias("x")).select("org", "x.*")
    j = long(printed(spark, d, EARLIER), "antes").join(long(printed(spark, d), "despues"), ["org", "campo"], "full_outer")
    return j.where(~F.col("antes").eqNullSafe(F.col("despues"))).select("org", "campo", "antes", "despues")


def timeline(spark, d):
    """Evidence of each organisation in order of time, undated last, then by outlet and address."""
    i = items(spark, d).where("org is not null").select("org", F.col("fecha").isNull().alias("sin"), F.coalesce("fecha", F.lit("sin_fecha")).alias("fecha"), "medio", "url", "id", F.when(F.coalesce("tipo", F.lit("")) == "", "evidencia").otherwise(F.col("tipo")).alias("tipo"))
    return positions(i, "org", ["sin", "fecha", "medio", "url", "id"], "posicion").select("org", "posicion", "fecha", "tipo", "id")


def decision_log(spark, d):
    log = G.decisions(printed(spark, d), items(spark, d).where("org is not null").select("org", "medio", "url"))
    return log.groupBy("org", "tipo", "regla", "resultado", "detalle").agg(F.count("*").alias("n"))


def certificates(spark, d):
    return G.certificates(printed(spark, d))


def audit_summary(spark, d):
    """One line per organisation: what an audit of it shows."""
    p = printed(spark, d)
    return p.select("org", "veredicto", "huella_id", "n", F.col("fechadas"), "trazables", F.size("motivos").cast("long").alias("reglas_bloqueo"), F.col("huella").alias("hash"))


def memory(spark, d):
    """Versions of each organisation's dossier over the batches: a batch's dossier is a new version if its content differs from the last one's."""
    i = items(spark, d).where("org is not null")
    v = validated(dossiers(i, entities(spark, d), keys=("org", "lote")))
    text = F.concat_ws("|", "hipotesis", "clase", "veredicto", F.col("solidez").cast("string"), F.col("suficiencia").cast("string"), "nivel", F.array_join(F.array_sort("tags"), ","), F.array_join(F.array_sort("patrones"), ","))
    v = v.withColumn("hash", F.sha2(text, 256)).withColumn("nivel_confianza", G.confidence_band(F.col("confianza")))
    w = W.partitionBy("org").orderBy("lote")
    v = v.withColumn("antes", F.lag("hash").over(w)).where(F.col("antes").isNull() | (F.col("antes") != F.col("hash")))
    return v.withColumn("version", F.row_number().over(w).cast("long")).withColumn("hash_previo", F.coalesce(F.lag("hash").over(w), F.lit("")))


def memory_snapshots(spark, d):
    return memory(spark, d).select("org", "version", "lote", "hipotesis", "clase", "veredicto", "solidez", "suficiencia", "nivel", "nivel_confianza", F.array_join(F.array_sort("tags"), "|").alias("senales"), "hash", "hash_previo")


#: Fields that are compared between versions.
COMPARED = ("hipotesis", "clase", "veredicto", "solidez", "suficiencia", "nivel", "nivel_confianza", "patrones", "tags", "viabilidad")


def memory_diff(spark, d):
    """Fields that differ between consecutive versions."""
    m = memory(spark, d)
    shown = lambda c: F.array_join(F.array_sort(c), "|") if c in ("patrones", "tags") else F.col(c).cast("string")
    w = W.partitionBy("org").orderBy("version")
    m = m.select("org", "version", *[F.struct(F.lit(c).alias("campo"), F.lag(shown(c)).over(w).alias("antes"), shown(c).alias("despues")).alias(f"x_{c}") for c in COMPARED])
    changed = F.filter(F.array(*[f"x_{c}" for c in COMPARED]), lambda x: ~x["antes"].eqNullSafe(x["despues"]))
    return m.where("version > 1").select("org", "version", F.explode(changed).alias("x")).select("org", "version", "x.campo", "x.antes", "x.despues")


def memory_evolution(spark, d):
    """First and last version of each organisation: change of solidity and sufficiency, their direction, changes of verdict and hypothesis."""
    ends = lambda c: (F.min_by(c, "version").alias(f"{c}_i"), F.max_by(c, "version").alias(f"{c}_f"))
    g = memory(spark, d).groupBy("org").agg(F.count("*").alias("versiones"), *ends("solidez"), *ends("suficiencia"), *ends("veredicto"), *ends("hipotesis"))
    way = lambda c: F.when(F.col(f"{c}_f") > F.col(f"{c}_i"), "ascendente").when(F.col(f"{c}_f") < F.col(f"{c}_i"), "descendente").otherwise("estable")
    return g.select(
        "org", "versiones", (F.col("solidez_f") - F.col("solidez_i")).alias("solidez_delta"), way("solidez").alias("solidez_tendencia"), (F.col("suficiencia_f") - F.col("suficiencia_i")).alias("suficiencia_delta"),
        way("suficiencia").alias("suficiencia_tendencia"), (F.col("veredicto_i") != F.col("veredicto_f")).alias("veredicto_cambio"), (F.col("hipotesis_i") != F.col("hipotesis_f")).alias("dolor_cambio"),
    )


def insert_versions(spark, d):
    """Fingerprints that an earlier run hasn't stored yet, inserted if absent."""
    old, new = printed(spark, d, EARLIER).select("huella"), printed(spark, d).select("org", "huella")
    return new.join(old, "huella", "left_anti").select("org", "huella")


# ---- SQL of the same, for the independent check -----------------------------------------------------------------------
_declared = ITEMS.replace("trim(coalesce(cita_textual, '')) AS texto", "trim(coalesce(cita_textual, '')) AS texto, trim(coalesce(fecha_publicacion, '')) AS declarada")
_identity = "sha256(CAST(json_object('fecha', declarada, 'fuente', medio, 'texto', texto, 'tipo_evento', trim(coalesce(tipo, '')), 'url', url) AS VARCHAR))"


def _tree(source: str, key: str, h: str, name: str) -> str:
    return f"""{name}_1 AS (SELECT {key}, substring({h}, 1, 6) AS p, sha256(string_agg({h}, '|' ORDER BY {h})) AS h, count(*) AS n FROM {source} GROUP BY 1, 2),
      {name}_2 AS (SELECT {key}, substring(p, 1, 3) AS p, sha256(string_agg(h, '|' ORDER BY p, h)) AS h, sum(n) AS n FROM {name}_1 GROUP BY 1, 2),
      {name} AS (SELECT {key}, sha256(string_agg(h, '|' ORDER BY p, h)) AS raiz, CAST(sum(n) AS BIGINT) AS n FROM {name}_2 GROUP BY 1)"""


_slug = "regexp_replace(regexp_replace(translate(lower(org), 'áéíóúüñãõâêôàç', 'aeiouunaoaeoac'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_joined = lambda c: f"array_to_string(list_sort({c}), '|')"
_versions_json = json.dumps(G.VERSIONS, sort_keys=True, separators=(",", ":"))


def _printed(where: str = "true") -> str:
    base = VALIDATED.replace(ITEMS, _declared.replace("FROM evidencias)", f"FROM evidencias WHERE {where})"))
    return f"""WITH {base}, ident AS (SELECT *, {_identity} AS h FROM items WHERE org IS NOT NULL), {_tree("ident", "org", "h", "raices")},
      traza AS (SELECT org, count(*) FILTER (url <> '' AND medio <> '') AS trazables FROM items WHERE org IS NOT NULL GROUP BY 1),
      f0 AS (SELECT v.*, r.raiz, t.trazables FROM v JOIN raices r USING (org) JOIN traza t USING (org)),
      f1 AS (SELECT *, sha256(CAST(json_object('evidencias', raiz, 'keywords', {_joined('tags')}, 'nombre', org, 'patrones', {_joined('patrones')}, 'profundidad_dolor', profundidad, 'score_icp', icp, 'scoring', clase, 'tipo_deuda', hipotesis) AS VARCHAR)) AS contenido FROM f0),
      f2 AS (SELECT *, sha256(CAST(json_object('corpus', raiz, 'expediente', contenido, 'motor', '{G.ENGINE}', 'taxonomia', '{G.taxonomy_hash()}', 'veredicto', veredicto, 'versiones', '{_versions_json}') AS VARCHAR)) AS huella FROM f1),
      f AS (SELECT *, 'HD-' || CASE WHEN {_slug} = '' THEN 'org' ELSE {_slug} END || '-' || substring(huella, 1, 12) AS huella_id FROM f2)"""


_now = _printed()
_both = f"a AS ({_printed(f'lote <= {EARLIER}')} SELECT * FROM f), b AS ({_now} SELECT * FROM f)"
_band = "CASE WHEN confianza >= 0.8 THEN 'Alta' WHEN confianza >= 0.5 THEN 'Media' ELSE 'Baja' END"
_sign = f"'TAMIZ::' || substring(sha256('{G.ENGINE}|{G.VERSIONS['gobernanza']}|' || huella || '|' || veredicto), 1, 32)"
_state = "CASE veredicto " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CERTIFICATE_OF.items()) + " END"
_log = [
    ("evidencia_aceptada", "consumibilidad", "CAST(least(trazables, fechadas) AS VARCHAR)", "true"), ("evidencia_descartada", "consumibilidad", "CAST(n - least(trazables, fechadas) AS VARCHAR)", "n > least(trazables, fechadas)"),
    ("regla_ejecutada", "trazabilidad", "CASE WHEN trazables = n THEN 'completa' ELSE 'incompleta' END", "true"),
    ("regla_ejecutada", "suficiencia_corpus", "CASE WHEN suficiencia >= 60 THEN 'suficiente' WHEN suficiencia >= 40 THEN 'parcial' ELSE 'insuficiente' END", "true"),
    ("regla_ejecutada", "solidez", "CASE WHEN solidez >= 65 THEN 'alta' WHEN solidez >= 40 THEN 'media' ELSE 'baja' END", "true"),
    ("regla_ejecutada", "contradicciones", "CAST(len(contradicciones) AS VARCHAR)", "true"), ("regla_ejecutada", "vacios", "CAST(len(vacios) AS VARCHAR)", "true"), ("regla_ejecutada", "reproducibilidad", "'reproducible'", "true"),
]
_log_sql = " UNION ALL ".join(f"SELECT org, '{t}' AS tipo, '{r}' AS regla, {x} AS resultado, '' AS detalle FROM f WHERE {c}" for t, r, x, c in _log)
_memory = f"""WITH {VALIDATED_BY_BATCH}, m0 AS (SELECT *, {_band} AS nivel_confianza, sha256(concat_ws('|', hipotesis, clase, veredicto, solidez, suficiencia, nivel, array_to_string(list_sort(tags), ','), array_to_string(list_sort(patrones), ','))) AS hash FROM v),
  m1 AS (SELECT *, lag(hash) OVER (PARTITION BY org ORDER BY lote) AS antes FROM m0), m AS (SELECT *, row_number() OVER w AS version, coalesce(lag(hash) OVER w, '') AS hash_previo FROM m1 WHERE antes IS NULL OR antes <> hash WINDOW w AS (PARTITION BY org ORDER BY lote))"""
_shown = lambda c: _joined(c) if c in ("patrones", "tags") else f"CAST({c} AS VARCHAR)"
_fields = " UNION ALL ".join(f"SELECT org, version, '{c}' AS campo, lag({_shown(c)}) OVER (PARTITION BY org ORDER BY version) AS antes, {_shown(c)} AS despues FROM m" for c in COMPARED)
_way = lambda c: f"CASE WHEN {c}_f > {c}_i THEN 'ascendente' WHEN {c}_f < {c}_i THEN 'descendente' ELSE 'estable' END AS {c}_tendencia"
_ends = ", ".join(f"arg_min({c}, version) AS {c}_i, arg_max({c}, version) AS {c}_f" for c in ("solidez", "suficiencia", "veredicto", "hipotesis"))
QUERIES = {
    "identity_hashes": (identity_hashes, f"WITH {_declared} SELECT id, {_identity} AS hash FROM items"),
    "corpus_version": (corpus_version, f"WITH {_tree('evidencias', 'lote', 'hash_dedup', 'raices')} SELECT lote, n, raiz AS version FROM raices"),
    "org_corpus_version": (org_corpus_version, f"WITH {_declared}, ident AS (SELECT *, {_identity} AS h FROM items WHERE org IS NOT NULL), {_tree('ident', 'org', 'h', 'raices')} SELECT org, n, raiz AS version FROM raices"),
    "component_versions": (component_versions, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in G.component_versions()) + ") t(componente, version, hash)"),
    "dossier_versions": (dossier_versions, f"{_now} SELECT org, contenido FROM f"),
    "fingerprint_sha256": (fingerprint, f"{_now} SELECT org, huella, huella_id FROM f"),
    "integrity_check": (integrity, f"WITH {_both} SELECT a.org, a.contenido IS NOT DISTINCT FROM b.contenido AS expediente_ok, a.raiz IS NOT DISTINCT FROM b.raiz AS corpus_ok, true AS taxonomia_ok FROM a LEFT JOIN b USING (org)"),
    "consistency_checks": (consistency, f"{_now} SELECT org, true AS reproducibilidad_declarada, bloqueada = (veredicto IN ('BLOQUEADA', 'SIN_HIPOTESIS')) AS bloqueo_coherente, true AS veredicto_conocido FROM f"),
    "version_diff": (version_diff, f"WITH {_both}, x AS (UNPIVOT (SELECT org, contenido, raiz, veredicto, huella FROM a) ON contenido, raiz, veredicto, huella INTO NAME campo VALUE antes), y AS (UNPIVOT (SELECT org, contenido, raiz, veredicto, huella FROM b) ON contenido, raiz, veredicto, huella INTO NAME campo VALUE despues) SELECT org, campo, antes, despues FROM x FULL JOIN y USING (org, campo) WHERE antes IS DISTINCT FROM despues"),
    "evidence_timeline": (timeline, f"WITH {ITEMS} SELECT org, row_number() OVER (PARTITION BY org ORDER BY fecha IS NULL, fecha, medio, url, id) - 1 AS posicion, coalesce(fecha, 'sin_fecha') AS fecha, CASE WHEN coalesce(tipo, '') = '' THEN 'evidencia' ELSE tipo END AS tipo, id FROM items WHERE org IS NOT NULL"),
    "decision_log": (decision_log, f"{_now} SELECT org, tipo, regla, resultado, detalle, count(*) AS n FROM (SELECT org, 'evidencia_recibida' AS tipo, 'captura' AS regla, 'recibida' AS resultado, medio || ' · ' || url AS detalle FROM items WHERE org IS NOT NULL UNION ALL {_log_sql} UNION ALL SELECT org, 'regla_bloqueo', 'bloqueo_hipotesis', 'bloqueada', unnest(CASE WHEN hipotesis = '' THEN ['sin_hipotesis'] ELSE motivos END) FROM f) GROUP BY ALL"),
    "certificates": (certificates, f"{_now} SELECT org, 'CERT-' || huella_id AS certificado_id, {_state} AS estado, veredicto, nivel, {_band} AS nivel_confianza, solidez, suficiencia, {_sign} AS firma FROM f"),
    "audit_summary": (audit_summary, f"{_now} SELECT org, veredicto, huella_id, n, fechadas, trazables, len(motivos) AS reglas_bloqueo, huella AS hash FROM f"),
    "fingerprints_to_store": (insert_versions, f"WITH {_both} SELECT org, huella FROM b WHERE huella NOT IN (SELECT huella FROM a)"),
    "memory_snapshots": (memory_snapshots, f"{_memory} SELECT org, version, lote, hipotesis, clase, veredicto, solidez, suficiencia, nivel, nivel_confianza, {_joined('tags')} AS senales, hash, hash_previo FROM m"),
    "memory_diff": (memory_diff, f"{_memory}, c AS ({_fields}) SELECT org, version, campo, antes, despues FROM c WHERE version > 1 AND antes IS DISTINCT FROM despues"),
    "memory_evolution": (memory_evolution, f"{_memory}, g AS (SELECT org, count(*) AS versiones, {_ends} FROM m GROUP BY 1) SELECT org, versiones, solidez_f - solidez_i AS solidez_delta, {_way('solidez')}, suficiencia_f - suficiencia_i AS suficiencia_delta, {_way('suficiencia')}, veredicto_i <> veredicto_f AS veredicto_cambio, hipotesis_i <> hipotesis_f AS dolor_cambio FROM g"),
}
