"""Queries over capture: detected companies, the capture pipeline as one plan, its counters and its quarantine, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import tagging as G
from tamiz.operators.capture import captured
from tamiz.plans.base import HOST, quoted
from tamiz.plans.records import _reason, _tags_sql
from tamiz.session import table


def detected(c: Column) -> Column:
    return T.detected_company(c, L.CAPITALISED, L.SECTOR_WORDS)


def companies(spark, d):
    """How often each company is detected in headlines; null where none is."""
    return table(spark, d, "evidencias").select(detected(F.col("cita_textual")).alias("empresa")).groupBy("empresa").agg(F.count("*").alias("n"))


def relevance_detected(spark, d):
    """Reasons of the relevance cascade with the company detected in the headline."""
    text = F.col("cita_textual")
    reason = G.relevance(text, F.size(G.tags(text)) > 0, detected(text).isNotNull())
    return table(spark, d, "evidencias").select(reason.alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


def pipeline(spark, d) -> DataFrame:
    return captured(table(spark, d, "evidencias"), exact=False)


def capture_outcomes(spark, d):
    """What the capture pipeline makes of each record: kept, filtered, rejected or a duplicate."""
    return pipeline(spark, d).select("id", "resultado", "motivo")


def capture_counts(spark, d):
    """Counters of the capture pipeline by connector."""
    p = pipeline(spark, d)
    is_ = lambda v: F.count_if(F.col("resultado") == v)
    undated = F.count_if((F.col("resultado") == "escrito") & (F.col("motivo") == "no_fechado"))
    return p.groupBy("connector").agg(F.count("*").alias("vistos"), is_("escrito").alias("escritos"), is_("duplicado").alias("duplicados"), is_("filtrado").alias("filtrados"), is_("rechazado").alias("rechazados"), undated.alias("no_fechados"))


def quarantine(spark, d):
    """Rejected and filtered records with their reason and payload, as they would be appended to the quarantine."""
    from tamiz.operators.capture import quarantined

    return quarantined(pipeline(spark, d)).select("id", "connector", "motivo", "payload_json")


def _mailboxes(spark, d):
    p = table(spark, d, "prospectos")
    return p.select("id", "sitio_web", T.mailboxes(F.col("discurso_corporativo")).alias("vistos"), F.col("nombre"))


def usable(spark, d):
    """Usable mailboxes of each corporate text, normalised, each once."""
    return _mailboxes(spark, d).select("id", F.explode(T.usable_mailboxes(F.col("vistos"))).alias("correo"))


def summary(spark, d):
    """Of each corporate text: mailboxes seen, usable and rejected."""
    u = F.size(T.usable_mailboxes(F.col("vistos")))
    return _mailboxes(spark, d).select("id", F.coalesce(F.size("vistos"), F.lit(0)).cast("long").alias("n"), u.cast("long").alias("validos")).where("n > 0").select("id", "n", "validos", (F.col("n") - F.col("validos")).alias("rechazados"))


def by_domain(spark, d):
    """Usable mailboxes that belong to the entity's own site."""
    host = T.host_of(F.col("sitio_web"))
    m = _mailboxes(spark, d).select("id", host.alias("host"), F.explode(T.usable_mailboxes(F.col("vistos"))).alias("correo"))
    return m.select("id", "correo", ((F.col("host") != "") & (F.split_part("correo", F.lit("@"), F.lit(2)) == F.col("host"))).alias("confirmado"))


def candidates(spark, d):
    """Candidate mailboxes of each entity with a site, most likely first, with the reason why one can't be used."""
    host = T.host_of(F.col("sitio_web"))
    c = table(spark, d, "prospectos").select("id", F.posexplode(T.tried_mailboxes(host, F.lit(None).cast("string"), L.TRIED_MAILBOXES)).alias("puesto", "correo"))
    return c.select("id", F.col("puesto").cast("long").alias("puesto"), "correo", T.mailbox_reason(F.col("correo")).alias("motivo"))


def consolidation(spark, d):
    """Each usable mailbox with the number of entities that state it and the first of them by name."""
    m = _mailboxes(spark, d).select("nombre", F.explode(T.usable_mailboxes(F.col("vistos"))).alias("correo"))
    return m.groupBy("correo").agg(F.count_distinct("nombre").alias("entidades"), F.min("nombre").alias("primera"))


ENDINGS = ("com", "mx", "com.mx", "io", "co", "ai", "app", "la", "net")


def domain_guesses(spark, d):
    """Domains that an entity might have: its whole label and its first word with each ending, each once."""
    label = F.regexp_replace(F.lower(T.strip_accents(F.col("nombre"))), r"[^a-z0-9 ]+", "")
    first = F.split(F.trim(label), " +")[0]
    whole = F.replace(label, F.lit(" "), F.lit(""))
    pairs = F.flatten(F.transform(F.array_distinct(F.filter(F.array(whole, first), lambda x: x != "")), lambda x: F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat(x, F.lit("."), e))))
    return table(spark, d, "prospectos").select("id", F.explode(pairs).alias("dominio"))


SOCIAL = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "crunchbase.com", "wikipedia.org")


def official_site(spark, d):
    """The first address of each entity that is no social page: site, profile, network page."""
    urls = F.array_compact(F.array("sitio_web", "url_perfil", "linkedin"))
    social = lambda u: F.exists(F.array(*[F.lit(s) for s in SOCIAL]), lambda s: (T.host_of(u) == s) | F.endswith(T.host_of(u), F.concat(F.lit("."), s)))
    return table(spark, d, "prospectos").select("id", F.try_element_at(F.filter(urls, lambda u: (F.trim(u) != "") & ~social(u)), F.lit(1)).alias("sitio"))


_bare = "CASE WHEN trim(regexp_replace(trim(cita_textual), '\\s+[-–|]\\s+[^-–|]+$', '')) = '' THEN trim(cita_textual) ELSE trim(regexp_replace(trim(cita_textual), '\\s+[-–|]\\s+[^-–|]+$', '')) END"
_detected = f"list_filter(regexp_extract_all({_bare}, '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: (regexp_matches(w, '^\\p{{Lu}}{{2,}}$') OR (length(w) >= 3 AND regexp_matches(w, '^\\p{{Lu}}'))) AND lower(strip_accents(w)) NOT IN ({quoted((*L.CAPITALISED, *L.SECTOR_WORDS))}))[1]"
_reason_detected = _reason.replace("WHEN empresa_mencionada IS NULL THEN 'relevancia:sin_empresa'", f"WHEN {_detected} IS NULL THEN 'relevancia:sin_empresa'")
_m = f"m AS (SELECT id, nombre, sitio_web, list_sort(list_distinct(list_transform(regexp_extract_all(discurso_corporativo, '{T.MAILBOX}'), lambda x: lower(x)))) AS vistos FROM prospectos)"
_why = lambda m: f"""CASE WHEN NOT regexp_matches({m}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') THEN 'sintaxis' WHEN split_part({m}, '@', 2) IN ({quoted(T.PLACEHOLDER_DOMAINS)}) THEN 'dominio_de_ejemplo' WHEN regexp_extract(split_part({m}, '@', 2), '\\.([^.]+)$', 1) IN ({quoted(T.RESERVED_ENDINGS)}) THEN 'terminacion_reservada'
  WHEN regexp_extract(split_part({m}, '@', 2), '\\.([^.]+)$', 1) IN ({quoted(T.IMAGE_ENDINGS)}) THEN 'imagen' WHEN regexp_matches(split_part({m}, '@', 1), '\\.\\.|^\\.|\\.$') THEN 'puntos' WHEN regexp_matches(split_part({m}, '@', 1), '^[^a-z]') THEN 'inicio' WHEN regexp_matches(split_part({m}, '@', 1), '{T.GENERIC_LOCAL}') THEN 'generico' ELSE '' END"""  # noqa: E731
_norm = lambda m: f"lower(regexp_replace({m}, '[.,]+$', ''))"
_usable = f"{_m}, n AS (SELECT id, nombre, sitio_web, vistos, list_filter(list_distinct(list_transform(vistos, lambda x: {_norm('x')})), lambda x: {_why('x')} = '') AS buenos FROM m)"
_host = HOST.format(c="sitio_web")
_label = "regexp_replace(lower(strip_accents(nombre)), '[^a-z0-9 ]+', '', 'g')"
_social = " OR ".join(f"h = '{s}' OR h LIKE '%.{s}'" for s in SOCIAL)
QUERIES = {
    "companies_detected": (companies, f"SELECT {_detected} AS empresa, count(*) AS n FROM evidencias GROUP BY 1"),
    "relevance_detected": (relevance_detected, f"SELECT {_reason_detected} AS motivo, count(*) AS n FROM evidencias GROUP BY 1"),
    "capture_outcomes": (capture_outcomes, None),
    "capture_counts": (capture_counts, None),
    "quarantine": (quarantine, None),
    "mailbox_usable": (usable, f"WITH {_usable} SELECT id, unnest(buenos) AS correo FROM n"),
    "mailbox_summary": (summary, f"WITH {_usable} SELECT id, len(vistos) AS n, len(buenos) AS validos, len(vistos) - len(buenos) AS rechazados FROM n WHERE len(vistos) > 0"),
    "mailbox_by_domain": (by_domain, f"WITH {_usable}, u AS (SELECT id, {_host} AS host, unnest(buenos) AS correo FROM n) SELECT id, correo, coalesce(host, '') <> '' AND split_part(correo, '@', 2) = coalesce(host, '') AS confirmado FROM u"),
    "mailbox_candidates": (candidates, f"WITH h AS (SELECT id, {_host} AS host FROM prospectos), c AS (SELECT id, unnest(range(0, {len(L.TRIED_MAILBOXES)})) AS puesto, unnest([{', '.join(f'{chr(39)}{b}@{chr(39)} || host' for b in L.TRIED_MAILBOXES)}]) AS correo FROM h WHERE contains(host, '.')) SELECT id, puesto, correo, {_why('correo')} AS motivo FROM c"),
    "contact_consolidation": (consolidation, f"WITH {_usable}, u AS (SELECT nombre, unnest(buenos) AS correo FROM n) SELECT correo, count(DISTINCT nombre) AS entidades, min(nombre) AS primera FROM u GROUP BY 1"),
    "domain_guesses": (domain_guesses, f"WITH l AS (SELECT id, unnest(list_distinct(list_filter([replace({_label}, ' ', ''), string_split(trim({_label}), ' ')[1]], lambda x: x <> ''))) AS x FROM prospectos) SELECT id, x || '.' || e AS dominio FROM l, (VALUES {', '.join(f'({quoted([e])})' for e in ENDINGS)}) t(e)"),
    "official_site": (official_site, f"WITH u AS (SELECT id, unnest([1, 2, 3]) AS k, unnest([sitio_web, url_perfil, linkedin]) AS u FROM prospectos), h AS (SELECT *, {HOST.format(c='u')} AS h FROM u WHERE u IS NOT NULL AND trim(u) <> ''), g AS (SELECT id, arg_min(u, k) AS sitio FROM h WHERE NOT ({_social}) GROUP BY 1) SELECT p.id, g.sitio FROM prospectos p LEFT JOIN g USING (id)"),
}
