"""Versions, fingerprints and audits of dossiers: hashes of canonical content, independent of order and partitions.

Canonical content is JSON with sorted keys, no blanks and nulls kept. What an organisation's evidence contributes is a
hash tree over the identities of its rows: the sorted hashes of each six-digit prefix are hashed, these by three-digit
prefix, these by organisation; so no organisation's hashes ever gather in one row, however many it has.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L

ENGINE = "tamiz"
VERSIONS = {"corpus": "1.0", "dictamen": "1.0", "expediente": "1.0", "gobernanza": "1.0", "motor": "2.0", "pipeline": "1.0", "taxonomia": "1.0", "validacion": "1.0"}
STAGES = ("captura", "contrato", "relevancia", "deduplicacion", "expediente", "validacion", "huella")


def canonical(**fields: Column) -> Column:
    """JSON of the fields with sorted keys."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def constant_hash(content: object) -> str:
    """Hash of constant content (vocabularies, versions), worked out once on the driver."""
    return hashlib.sha256(json.dumps(content, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def taxonomy_hash() -> str:
    """Hash of the vocabularies from which hypotheses follow."""
    return constant_hash({"dolor": sorted(L.PAIN), "cambio": sorted(L.CHANGE), "hipotesis": L.HYPOTHESIS, "combinaciones": sorted([sorted(c), label] for c, label in L.COMBINATIONS)})


def component_versions() -> list[tuple[str, str, str]]:
    """(component, version, hash) of what doesn't depend on the data."""
    return [
        ("motor", VERSIONS["motor"], constant_hash({"motor": ENGINE, "version": VERSIONS["motor"]})),
        ("pipeline", VERSIONS["pipeline"], constant_hash({"version": VERSIONS["pipeline"], "etapas": STAGES})),
        ("taxonomia", VERSIONS["taxonomia"], taxonomy_hash()),
    ]


def identity_hash(df: DataFrame) -> Column:
    """Hash of the identity of an evidence row (``url``, ``medio``, ``fecha_declarada``, ``tipo``, ``texto``); null fields count as empty."""
    none = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.sha2(canonical(url=none("url"), fuente=none("medio"), fecha=none("fecha_declarada"), tipo_evento=none("tipo"), texto=none("texto")), 256)


def hash_tree(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """(``keys``, ``n``, ``raiz``): the root over the hex digests in column ``h`` of each key; equal digests count each."""
    level = rows.select(*keys, F.substring(h, 1, 6).alias("__p"), F.col(h).alias("__h"), F.lit(1).cast("long").alias("__n"))
    for digits in (6, 3, 0):
        node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__h"))), lambda x: x["__h"]), "|"), 256)
        ordered = level.withColumn("__o", F.col("__h") if digits == 6 else F.col("__p")).withColumn("__q", F.substring("__p", 1, digits) if digits else F.lit(""))
        level = ordered.groupBy(*keys, "__q").agg(node.alias("__h"), F.sum("__n").alias("__n")).withColumnRenamed("__q", "__p")
    return level.select(*keys, F.col("__n").alias("n"), F.col("__h").alias("raiz"))


def content_hash(d: DataFrame) -> Column:
    """Hash of the analytic content of a dossier with the root of its evidence (``raiz``)."""
    return F.sha2(
        canonical(
            nombre=F.col("org"), scoring=F.col("clase"), score_icp=F.col("icp"), tipo_deuda=F.col("hipotesis"), profundidad_dolor=F.col("profundidad"), keywords=F.array_join(F.array_sort("tags"), "|"),
            patrones=F.array_join(F.array_sort("patrones"), "|"), evidencias=F.col("raiz"),
        ), 256,
    )


def fingerprints(d: DataFrame) -> DataFrame:
    """Adds ``contenido``, ``huella`` (without any date) and ``huella_id`` to validated dossiers with ``raiz``."""
    slug = F.regexp_replace(F.regexp_replace(F.translate(F.lower("org"), "áéíóúüñãõâêôàç", "aeiouunaoaeoac"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    d = d.withColumn("contenido", content_hash(d))
    versions = F.lit(json.dumps(VERSIONS, sort_keys=True, separators=(",", ":")))
    h = F.sha2(canonical(corpus=F.col("raiz"), expediente=F.col("contenido"), motor=F.lit(ENGINE), taxonomia=F.lit(taxonomy_hash()), veredicto=F.col("veredicto"), versiones=versions), 256)
    d = d.withColumn("huella", h)
    return d.withColumn("huella_id", F.concat(F.lit("HD-"), F.when(slug == "", "org").otherwise(slug), F.lit("-"), F.substring("huella", 1, 12)))


def confidence_band(c: Column) -> Column:
    """Alta, Media or Baja of a confidence between 0 and 1."""
    return F.when(c >= 0.8, "Alta").when(c >= 0.5, "Media").otherwise("Baja")


def signature(h: Column, verdict: Column) -> Column:
    """Deterministic signature of the engine on a conclusion."""
    return F.concat(F.lit("TAMIZ::"), F.substring(F.sha2(F.concat_ws("|", F.lit(ENGINE), F.lit(VERSIONS["gobernanza"]), h, verdict), 256), 1, 32))


def certificates(d: DataFrame) -> DataFrame:
    """Certificates of fingerprinted dossiers."""
    state = F.create_map(*[x for k, v in L.CERTIFICATE_OF.items() for x in (F.lit(k), F.lit(v))])[F.col("veredicto")]
    return d.select(
        "org", F.concat(F.lit("CERT-"), "huella_id").alias("certificado_id"), state.alias("estado"), "veredicto", "nivel", confidence_band(F.col("confianza")).alias("nivel_confianza"), "solidez", "suficiencia",
        signature(F.col("huella"), F.col("veredicto")).alias("firma"),
    )


def decisions(d: DataFrame, received: DataFrame) -> DataFrame:
    """The decision log (``org``, ``tipo``, ``regla``, ``resultado``, ``detalle``): evidence received, accepted and discarded, rules run, rules that blocked.

    ``d``: validated dossiers with ``trazables``; ``received``: the evidence rows (``org``, ``medio``, ``url``).
    """
    accepted = F.least("trazables", "fechadas")
    row = lambda kind, rule, result, detail="": F.struct(F.lit(kind).alias("tipo"), F.lit(rule).alias("regla"), result.cast("string").alias("resultado"), F.lit(detail).alias("detalle"))
    u, s = F.col("suficiencia"), F.col("solidez")
    rules = F.array(
        row("evidencia_aceptada", "consumibilidad", accepted),
        F.when(F.col("n") > accepted, row("evidencia_descartada", "consumibilidad", F.col("n") - accepted)),
        row("regla_ejecutada", "trazabilidad", F.when(F.col("trazables") == F.col("n"), "completa").otherwise("incompleta")),
        row("regla_ejecutada", "suficiencia_corpus", F.when(u >= 60, "suficiente").when(u >= 40, "parcial").otherwise("insuficiente")),
        row("regla_ejecutada", "solidez", F.when(s >= 65, "alta").when(s >= 40, "media").otherwise("baja")),
        row("regla_ejecutada", "contradicciones", F.size("contradicciones")),
        row("regla_ejecutada", "vacios", F.size("vacios")),
        row("regla_ejecutada", "reproducibilidad", F.lit("reproducible")),
    )
    blocks = F.transform(F.when(F.col("hipotesis") == "", F.array(F.lit("sin_hipotesis"))).otherwise(F.col("motivos")), lambda m: F.struct(F.lit("regla_bloqueo").alias("tipo"), F.lit("bloqueo_hipotesis").alias("regla"), F.lit("bloqueada").alias("resultado"), m.alias("detalle")))
    log = d.select("org", F.explode(F.concat(F.array_compact(rules), blocks)).alias("x")).select("org", "x.tipo", "x.regla", "x.resultado", "x.detalle")
    seen = received.select("org", F.lit("evidencia_recibida").alias("tipo"), F.lit("captura").alias("regla"), F.lit("recibida").alias("resultado"), F.concat_ws(" · ", "medio", "url").alias("detalle"))
    return seen.unionByName(log)
