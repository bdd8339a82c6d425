"""Queries over readers and exports: payloads are made of the tables' rows and read back, so that every reader runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.plans.base import URL
from tamiz.sources import exports as X
from tamiz.sources import feeds as S
from tamiz.sources import normalise as N
from tamiz.session import table


def _ev(spark, d):
    return table(spark, d, "evidencias").select("id", F.trim(F.regexp_replace("cita_textual", r"[\s\x00-\x1f\x7f-\x9f�]+", " ")).alias("t"), F.trim("url_fuente").alias("u"), F.trim("nombre_medio").alias("m"), "creado_en", "empresa_mencionada", "tipo_evento").where("t <> '' and u <> ''")


def _rss(e):
    """One feed with one item per row."""
    when = F.date_format(F.to_timestamp(F.substring("creado_en", 1, 19)), "dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<rss><channel><item><title>"), X.escaped(F.col("t")), F.lit("</title><link>"), X.escaped(F.col("u")), F.lit("</link><pubDate>"), when, F.lit("</pubDate><source>"), X.escaped(F.col("m")), F.lit("</source></item></channel></rss>"))
    return e.select(F.col("id").cast("string").alias("origen"), item.alias("cuerpo"))


def read_feeds(spark, d):
    """Items of feeds: title, address, outlet and date as they were written."""
    r = S.rss(_rss(_ev(spark, d)))
    return r.select(F.col("origen").cast("long").alias("id"), "titulo", "url", "medio", F.date_format("fecha", "yyyy-MM-dd HH:mm:ss").alias("fecha"))


def _articles(e):
    when = F.date_format(F.to_timestamp(F.substring("creado_en", 1, 19)), "yyyyMMdd'T'HHmmss'Z'")
    a = F.struct(F.col("u").alias("url"), F.col("t").alias("title"), when.alias("seendate"), F.col("m").alias("domain"), F.lit("es").alias("language"))
    return e.select(F.col("id").cast("string").alias("origen"), F.to_json(F.struct(F.array(a).alias("articles"))).alias("cuerpo"))


def read_articles(spark, d):
    """Article lists as contract records: outlet, record hash and publication date."""
    r = S.articles(_articles(_ev(spark, d)))
    c = N.records(r.withColumn("k", F.col("origen")), "articulos", F.lit("Clara"), F.lit("ronda"), F.lit("2024-06-01T00:00:00+00:00"))
    return c.select("cita_textual", "url_fuente", "nombre_medio", "hash_dedup", "fecha_publicacion")


def read_boards(spark, d):
    """Job boards as contract records: the kind of event and the origin are structural."""
    e = _ev(spark, d)
    job = F.struct(F.col("t").alias("title"), F.col("u").alias("absolute_url"), F.concat(F.substring("creado_en", 1, 19), F.lit("Z")).alias("updated_at"))
    b = e.select(F.col("id").cast("string").alias("origen"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("cuerpo"))
    c = N.records(S.job_boards(b).where("titulo <> ''").withColumn("medio", F.lit("")), "vacantes", F.lit("Clara"), F.lit("ronda"), F.lit("2024-06-01T00:00:00+00:00"))
    return c.groupBy("tipo_evento", "origen_declaracion", "connector").agg(F.count("*").alias("n"), F.count_distinct("url_fuente").alias("direcciones"), F.max("fecha_publicacion").alias("ultima"))


def feed_mentions(spark, d):
    """Items of feeds that mention a name in title or summary, whatever case and accents."""
    return S.mentions(S.rss(_rss(_ev(spark, d))), F.lit("lima")).select(F.col("origen").cast("long").alias("id"))


def payload_health(spark, d):
    """Reject payloads that give a record and those that give none."""
    r = table(spark, d, "rechazos").select(F.col("id").cast("string").alias("origen"), F.col("payload_json").alias("cuerpo"), "connector")
    whole = F.trim("cuerpo").rlike(r"\}$")
    rows = r.where(whole).select("origen")
    return S.health(r.select("origen"), rows).join(r.select("origen", "connector"), "origen").groupBy("connector", "ok").agg(F.count("*").alias("n"))


def retained(spark, d):
    """Raw captures that a purge at an instant keeps, by format."""
    return S.kept_raw(table(spark, d, "raw_store"), F.lit("2024-06-01")).groupBy("formato").agg(F.count("*").alias("n"), F.sum("tamano").alias("octetos"))


def cache(spark, d):
    """The newest entry of each cached capture that is still fresh at an instant; an older entry gives way to a newer one."""
    c = table(spark, d, "raw_store").groupBy("hash_dedup").agg(F.max(F.struct("creado_en", "id", "path")).alias("m")).select("hash_dedup", "m.*")
    return c.where(F.col("creado_en") >= "2024-03-01").select("hash_dedup", "creado_en", "id")


def captures(spark, d):
    """States of page captures by what came back: derived from the state that was observed."""
    s = table(spark, d, "drift_snapshots")
    http = F.when(F.col("estado_observable") == "ok", 200).when(F.col("estado_observable").contains("bloque"), 403).when(F.col("estado_observable").contains("http"), 500)
    r = S.capture_state(s.select("id", "url", F.col("url").alias("url_final"), http.alias("estado_http"), "texto"))
    return r.groupBy("estado").agg(F.count("*").alias("n"))


def markdown(spark, d):
    """The directory as Markdown lines, grouped by category."""
    p = table(spark, d, "prospectos")
    return X.markdown_lines(p, "categoria", "id", F.concat_ws(" · ", "nombre", F.coalesce("sitio_web", F.lit("")))).select("grupo", "nivel", "clave", "linea")


def html(spark, d):
    """Evidence as rows of an HTML table."""
    return X.html_lines(table(spark, d, "evidencias"), "id", ["nombre_medio", "url_fuente", "cita_textual"])


def feed_pushes(spark, d):
    """Payloads of feed items for the signal engine."""
    i = S.rss(_rss(_ev(spark, d)))
    return N.pushes(i, F.lit("Clara")).groupBy("org_name").agg(F.count("*").alias("n"), F.count_distinct("url").alias("direcciones"))


def query_addresses(spark, d):
    """Search addresses of each entity: letters and digits only, so that both encoders agree."""
    name = F.regexp_replace(F.lower(T.strip_accents(F.col("nombre"))), "[^a-z0-9]+", "")
    return table(spark, d, "prospectos").select("id", N.article_query("https://a.example/doc", name, F.lit(False), None, 500).alias("direccion"))


_e = "e AS (SELECT id, trim(regexp_replace(cita_textual, '[\\s\\p{C}�]+', ' ', 'g')) AS t, trim(url_fuente) AS u, trim(nombre_medio) AS m, creado_en, CAST(substring(creado_en, 1, 19) AS TIMESTAMP) AS ts FROM evidencias)"
_e = _e.replace("\\p{C}", "\\x00-\\x1f\\x7f-\\x9f")
_where = "WHERE t <> '' AND u <> ''"
_esc = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
QUERIES = {
    "read_feeds": (read_feeds, f"WITH {_e} SELECT id, t AS titulo, u AS url, m AS medio, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fecha FROM e {_where}"),
    "read_articles": (read_articles, f"WITH {_e} SELECT t AS cita_textual, u AS url_fuente, m AS nombre_medio, sha256('clara|' || coalesce({URL.format(c='u')}, '')) AS hash_dedup, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS fecha_publicacion FROM e {_where}"),
    "read_boards": (read_boards, f"WITH {_e} SELECT 'contratacion' AS tipo_evento, 'operador' AS origen_declaracion, 'vacantes' AS connector, count(*) AS n, count(DISTINCT u) AS direcciones, strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS ultima FROM e {_where}"),
    "feed_mentions": (feed_mentions, f"WITH {_e} SELECT id FROM e {_where} AND contains(lower(strip_accents(t)), 'lima')"),
    "payload_health": (payload_health, "SELECT connector, regexp_matches(trim(payload_json), '\\}$') AS ok, count(*) AS n FROM rechazos GROUP BY 1, 2"),
    "raw_kept": (retained, "SELECT formato, count(*) AS n, CAST(sum(tamano) AS BIGINT) AS octetos FROM raw_store WHERE expira_en IS NULL OR expira_en >= '2024-06-01' GROUP BY 1"),
    "cache_fresh": (cache, "SELECT hash_dedup, creado_en, id FROM (SELECT *, row_number() OVER (PARTITION BY hash_dedup ORDER BY creado_en DESC, id DESC) AS r FROM raw_store) WHERE r = 1 AND creado_en >= '2024-03-01'"),
    "capture_states": (captures, "SELECT CASE WHEN h IS NULL THEN 'timeout' WHEN h = 403 THEN 'bloqueado' WHEN h >= 400 THEN 'error_http' WHEN length(coalesce(texto, '')) < 20 THEN 'contenido_vacio' ELSE 'ok' END AS estado, count(*) AS n FROM (SELECT *, CASE WHEN estado_observable = 'ok' THEN 200 WHEN contains(estado_observable, 'bloque') THEN 403 WHEN contains(estado_observable, 'http') THEN 500 END AS h FROM drift_snapshots) GROUP BY 1"),
    "export_markdown": (markdown, "SELECT coalesce(categoria, '') AS grupo, 1 AS nivel, id AS clave, '- ' || trim(regexp_replace(concat_ws(' · ', nombre, coalesce(sitio_web, '')), '\\s+', ' ', 'g')) AS linea FROM prospectos UNION ALL SELECT DISTINCT coalesce(categoria, ''), 0, 0, '## ' || coalesce(categoria, '') FROM prospectos"),
    "export_html": (html, f"SELECT id AS clave, '<tr><td>' || {_esc('nombre_medio')} || '</td><td>' || {_esc('url_fuente')} || '</td><td>' || {_esc('cita_textual')} || '</td></tr>' AS linea FROM evidencias"),
    "feed_pushes": (feed_pushes, f"WITH {_e} SELECT 'Clara' AS org_name, count(*) AS n, count(DISTINCT u) AS direcciones FROM e {_where}"),
    "query_addresses": (query_addresses, "SELECT id, 'https://a.example/doc?query=' || regexp_replace(lower(strip_accents(nombre)), '[^a-z0-9]+', '', 'g') || '&mode=ArtList&format=json&maxrecords=250&sort=DateDesc' AS direccion FROM prospectos"),
}
