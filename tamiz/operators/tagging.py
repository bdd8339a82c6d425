"""Tags, rules and relevance of single records: one pass of expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions.text import contains_any, strip_accents


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tags(text: Column, signals: dict[str, tuple[str, ...]] = L.SIGNALS) -> Column:
    """Signals whose phrases the text contains, in order of the vocabulary; accents count. Empty for null."""
    return once(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(contains_any(low, phrases), F.lit(tag)) for tag, phrases in signals.items()])))


def named_source(outlet: Column) -> Column:
    """Whether the outlet is a named one."""
    return ~F.coalesce(F.lower(F.trim(outlet)), F.lit("")).isin(*L.GENERIC_SOURCES)


def capture_confidence_hundredths(dated: Column, named: Column, tagged: Column) -> Column:
    """40, and 25 for a date, 20 for a named source, 15 for signals."""
    return (F.lit(40) + F.when(dated, 25).otherwise(0) + F.when(named, 20).otherwise(0) + F.when(tagged, 15).otherwise(0)).cast("long")


def capture_quality(company: Column, event: Column, source: Column) -> Column:
    """Alta, Media or Baja by how many of the three criteria hold."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (company, event, source)), F.lit(0))
    return F.when(n >= 3, "Alta").when(n == 2, "Media").otherwise("Baja")


def rule_hits(df: DataFrame, key: str, text: str, rules: dict[str, tuple[float, tuple[str, ...]]] = L.RULES) -> DataFrame:
    """One row per rule that fires: ``key``, ``tipo``, ``palabra``, ``peso``, ``fragmento`` (200 characters)."""
    low = F.lower(F.col(text))
    table = F.array(*[F.struct(F.lit(t).alias("tipo"), F.lit(k).alias("palabra"), F.lit(w).alias("peso")) for t, (w, ks) in rules.items() for k in ks])
    hits = F.filter(table, lambda r: F.contains(low, r["palabra"]))
    return df.select(key, F.substring(F.col(text), 1, 200).alias("fragmento"), F.explode(hits).alias("r")).select(key, "r.tipo", "r.palabra", "r.peso", "fragmento")


def rule_alert(text: Column, rules: dict[str, tuple[float, tuple[str, ...]]] = L.RULES, critical: float = L.CRITICAL_FROM) -> Column:
    """Struct of the summed weight and the alert; 0 and Normal for null."""
    low = F.lower(text)
    total = F.lit(0.0)
    for weight, keywords in rules.values():
        for k in keywords:
            total = total + F.when(F.contains(low, F.lit(k)), weight).otherwise(0.0)
    return F.struct(total.alias("puntos"), F.when(total >= critical, "Crítica").otherwise("Normal").alias("alerta"))


def relevance(title: Column, has_event: Column, has_company: Column, need_event: bool = True) -> Column:
    """Reason for dropping a headline; '' if it is kept. The order of the rules decides the reason."""

    def of(t: Column) -> Column:
        opinion = contains_any(t, L.OPINION_MARKS) | F.coalesce(t.rlike(L.LIST_TITLE), F.lit(False))
        chain = (
            F.when(opinion, "relevancia:opinion")
            .when(contains_any(t, L.FOREIGN), "relevancia:no_latam")
            .when(contains_any(t, L.NOT_A_COMPANY) | F.coalesce(t.rlike(L.REPORT_TITLE), F.lit(False)), "relevancia:no_empresa")
            .when(contains_any(t, L.MEDIA_NOISE), "relevancia:ruido_mediatico")
            .when(contains_any(t, L.GIANTS), "relevancia:gigante")
            .when(contains_any(t, L.SHALLOW_EVENTS), "relevancia:sin_profundidad_estructural")
            .when(~has_company, "relevancia:sin_empresa")
        )
        if need_event:
            chain = chain.when(~has_event, "relevancia:sin_evento")
        return chain.otherwise("")

    return once(F.lower(strip_accents(title)), of)


ISO = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def contract_status(df: DataFrame) -> Column:
    """Outcome of the evidence contract: ``ok``, ``no_fechado`` or the first reason for quarantine."""
    chain = None
    for c in ("cita_textual", "fecha_extraccion", "url_fuente", "nombre_medio", "empresa_mencionada", "tipo_evento", "origen_declaracion", "hash_dedup"):
        blank = F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
        reason = F.lit(f"campo_obligatorio_vacio:{c}")
        chain = F.when(blank, reason) if chain is None else chain.when(blank, reason)
    undated = F.trim(F.coalesce(F.col("fecha_publicacion"), F.lit(""))) == ""
    return (
        chain.when(~F.col("tipo_evento").isin(*L.EVENT_TYPES), F.concat(F.lit("tipo_evento_invalido:"), "tipo_evento"))
        .when(~F.col("origen_declaracion").isin(*L.ORIGINS), F.concat(F.lit("origen_declaracion_invalido:"), "origen_declaracion"))
        .when(~F.col("fecha_extraccion").rlike(ISO), "fecha_extraccion_no_iso8601")
        .when(undated, "no_fechado")
        .when(~F.col("fecha_publicacion").rlike(ISO), "fecha_publicacion_no_iso8601")
        .otherwise("ok")
    )


def discourse_hits(text: Column, framework: dict[str, tuple[str, ...]] = L.DISCOURSE) -> Column:
    """Types of discourse with the number of markers each has, most first, ties in the framework's order; empty for null."""
    def of(t: Column) -> Column:
        count = lambda ms: F.size(F.filter(F.array(*[F.lit(m) for m in ms]), lambda m: F.contains(t, m)))
        each = F.array(*[F.struct((-count(ms)).alias("orden"), F.lit(k).alias("posicion"), F.lit(kind).alias("tipo")) for k, (kind, ms) in enumerate(framework.items())])
        hits = F.filter(F.array_sort(each), lambda x: x["orden"] < 0)
        return F.transform(hits, lambda x: F.struct(x["tipo"].alias("tipo"), (-x["orden"]).cast("long").alias("marcas")))

    return once(F.lower(strip_accents(F.coalesce(text, F.lit("")))), of)
