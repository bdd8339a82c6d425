"""The capture pipeline as one plan: derive, filter by relevance, validate, deduplicate, grade; nothing is written here.

Each record gets one outcome: ``filtrado`` (not relevant), ``rechazado`` (breaks the contract), ``duplicado`` (an earlier
record that was accepted has its content key or title hash, or its record hash is stored) or ``escrito``. Records arrive in
order of ``id``; what was filtered or rejected takes no part in the deduplication. Null texts are rejected by the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import tagging as G
from tamiz.operators.history import accept_by_keys
from tamiz.session import cut

PAYLOAD = ("cita_textual", "url_fuente", "nombre_medio", "fecha_publicacion")


def derived(records: DataFrame, exact: bool) -> DataFrame:
    """Adds signals, confidence, the company (in discovery the one detected in the headline), record hash and content keys."""
    text = F.col("cita_textual")
    found = T.detected_company(text, L.CAPITALISED, L.SECTOR_WORDS)
    r = records.withColumn("senales", G.tags(text)).withColumn("detectada", found)
    company = F.col("empresa_mencionada") if exact else F.coalesce("detectada", F.lit(""))
    r = r.withColumn("empresa_mencionada", company).withColumn("hash_dedup", T.contract_hash(F.col("empresa_mencionada"), F.col("url_fuente")))
    dated = F.trim(F.coalesce("fecha_publicacion", F.lit(""))) != ""
    r = r.withColumn("confianza_cent", G.capture_confidence_hundredths(dated, G.named_source(F.col("nombre_medio")), F.size("senales") > 0))
    return r.withColumn("clave", T.content_key(F.col("url_fuente"), text)).withColumn("hash_titulo", T.content_hash(text))


def captured(records: DataFrame, exact: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Every record with ``resultado``, ``motivo`` and ``calidad``.

    ``exact``: the query names the company, so nothing is filtered by relevance. ``stored``: (``hash_dedup``) of records
    that are kept already.
    """
    r = derived(records, exact)
    relevant = F.lit("") if exact else G.relevance(F.col("cita_textual"), F.size("senales") > 0, F.col("detectada").isNotNull())
    r = cut(r.withColumn("__fuera", F.coalesce(relevant, F.lit(""))).withColumn("__contrato", G.contract_status(r)))
    fine = r.where("__fuera = '' and __contrato in ('ok', 'no_fechado')").select("id", "clave", "hash_titulo", "hash_dedup")
    if stored is not None:
        fine = fine.join(stored.select("hash_dedup").distinct(), "hash_dedup", "left_anti")
    kept = accept_by_keys(fine, "id", ["clave", "hash_titulo", "hash_dedup"]).select("id", F.lit(True).alias("__queda"))
    out = r.join(kept, "id", "left")
    result = F.when(F.col("__fuera") != "", "filtrado").when(~F.col("__contrato").isin("ok", "no_fechado"), "rechazado").when(F.col("__queda"), "escrito").otherwise("duplicado")
    reason = F.when(F.col("__fuera") != "", F.col("__fuera")).otherwise(F.col("__contrato"))
    named = F.lit(exact) | F.col("detectada").isNotNull()
    quality = G.capture_quality(named, F.size("senales") > 0, G.named_source(F.col("nombre_medio")))
    return out.withColumn("resultado", result).withColumn("motivo", reason).withColumn("calidad", quality).drop("__fuera", "__contrato", "__queda")


def quarantined(outcomes: DataFrame) -> DataFrame:
    """Filtered and rejected records with the payload that came, as JSON."""
    payload = F.to_json(F.struct(*PAYLOAD), {"ignoreNullFields": "false"})
    return outcomes.where("resultado in ('filtrado', 'rechazado')").withColumn("payload_json", payload)
