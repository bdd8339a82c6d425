"""Queries over time: series, versions, drift, retention, health, upserts, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import drift as D
from tamiz.operators import history as H
from tamiz.operators import series as S
from tamiz.plans.base import ITEMS, items
from tamiz.session import table
from tamiz.streaming import capture as C


def _series(spark, d):
    i = items(spark, d).where("fecha is not null").select("org", F.substring("fecha", 1, 7).alias("mes"))
    return S.monthly(i, "org", "mes")


def _orders(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return S.monthly(o.select("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("mes")), "c_mktsegment", "mes")


def monthly_series(spark, d):
    return _series(spark, d)


def series_profile(spark, d):
    return S.profile(_series(spark, d))


def orders_profile(spark, d):
    return S.profile(_orders(spark, d))


def inflections(spark, d):
    return S.turning_points(_orders(spark, d))


def maturity(spark, d):
    i = items(spark, d).where("org is not null").groupBy("org").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("medio", F.lit(""))).alias("f"), F.count_distinct(F.substring("fecha", 1, 7)).alias("m"))
    v = F.lit(40.0) * F.least("n", F.lit(6)) / 6 + F.lit(30.0) * F.least("f", F.lit(4)) / 4 + F.lit(30.0) * F.least("m", F.lit(6)) / 6
    p = F.floor(v + 0.5 + 1e-9)
    return i.select("org", p.alias("puntos"), F.when(p >= 75, "maduro").when(p >= 50, "consolidado").when(p >= 25, "en_desarrollo").otherwise("naciente").alias("nivel"))


def event_mix(spark, d):
    """Events by day and type, pivoted."""
    e = table(spark, d, "events").withColumn("dia", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("dia").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


def version_changes(spark, d):
    v = H.versions(table(spark, d, "drift_snapshots").where("estado_observable = 'ok'"), ["org_nombre", "tipo_pagina"], ["id"], "hash_contenido")
    return v.select("id", "org_nombre", "tipo_pagina", "version", "hash_previo")


def version_evolution(spark, d):
    v = version_changes(spark, d)
    return v.groupBy("org_nombre", "tipo_pagina").agg(F.max("version").alias("versiones"), F.min("id").alias("primera"), F.max("id").alias("ultima"))


def asof_previous(spark, d):
    s = H.previous(table(spark, d, "drift_snapshots"), ["org_nombre", "tipo_pagina"], ["id"], "hash_contenido", F.col("estado_observable") == "ok")
    return s.select("id", "hash_contenido", "anterior")


def concept_diff(spark, d):
    return D.concept_changes(table(spark, d, "drift_snapshots"))


def drift_types(spark, d):
    return D.line_changes(table(spark, d, "drift_snapshots"))


def drift_concepts(spark, d):
    return D.first_concepts(table(spark, d, "drift_snapshots"))


def drift_evidence(spark, d):
    return D.evidence(table(spark, d, "drift_snapshots"))


def drift_timeline(spark, d):
    """Captures of each organisation in order of time, with the page and whether its text changed."""
    s = H.previous(table(spark, d, "drift_snapshots"), ["org_nombre", "tipo_pagina"], ["id"], "hash_contenido", F.col("estado_observable") == "ok")
    state = F.when(F.col("estado_observable") != "ok", F.col("estado_observable")).when(F.col("anterior").isNull(), "primera").when(F.col("anterior") == F.col("hash_contenido"), "igual").otherwise("cambio")
    return s.select("org_nombre", "capturado_en", "id", "tipo_pagina", state.alias("estado"))


def observable_states(spark, d):
    return table(spark, d, "drift_snapshots").groupBy("estado_observable", "tipo_pagina").agg(F.count("*").alias("n"), F.max("capturado_en").alias("ultima"))


def retention(spark, d):
    """Raw captures by format that a purge at a given instant keeps and removes."""
    gone = F.col("expira_en") < "2024-06-01"
    return table(spark, d, "raw_store").groupBy("formato").agg(F.count_if(~gone).alias("quedan"), F.count_if(gone).alias("purgados"), F.sum(F.when(gone, F.col("tamano")).otherwise(0)).alias("liberado"))


def health_runs(spark, d):
    """Consecutive failures per source: rejects are failed runs, stored records successful ones, in order of time."""
    r = table(spark, d, "rechazos").select("connector", "creado_en", F.col("id"), F.lit(False).alias("ok"))
    e = table(spark, d, "evidencias").select("connector", "creado_en", F.col("id"), F.lit(True).alias("ok"))
    f = H.failure_runs(r.unionByName(e), "connector", ["creado_en", "ok", "id"], F.col("ok"))
    return f.groupBy("connector").agg(F.max("fallos_seguidos").alias("peor"), F.count_if("alerta").alias("alertas"))


def dangling_raw(spark, d):
    """Evidence whose raw capture isn't in the store."""
    e = table(spark, d, "evidencias").where("raw_hash is not null").select("id", "raw_hash")
    return e.join(table(spark, d, "raw_store").select(F.col("hash_dedup").alias("raw_hash")).distinct(), "raw_hash", "left_anti").select("id", "raw_hash")


def insert_if_absent(spark, d):
    """Records that the raw store would still have to take."""
    new = table(spark, d, "evidencias").select("hash_dedup", "id", "connector")
    return H.insert_if_absent(new, table(spark, d, "raw_store").select("hash_dedup"), "hash_dedup", "id").select("hash_dedup", "id")


def coalescing_upsert(spark, d):
    """The earliest row of each name, completed by the latest one."""
    p = table(spark, d, "prospectos")
    side = lambda f: p.groupBy("nombre").agg(f(F.struct("vertical", "linkedin", "url_perfil"), "id").alias("r")).select("nombre", "r.*")
    return H.coalescing_upsert(side(F.min_by), side(F.max_by), "nombre", ["vertical", "linkedin", "url_perfil"])


def content_dedup(spark, d):
    e = table(spark, d, "evidencias").select("id", "clave_contenido", "hash_contenido")
    return H.accept_by_keys(e, "id", ["clave_contenido", "hash_contenido"])


def stream_windows(spark, d):
    w = C.windowed(C.event_stream(spark, d), "ts", "event_type", "6 hours")
    return C.drained(w, "ventanas", "complete").select(F.date_format("inicio", "yyyy-MM-dd HH:mm").alias("inicio"), "event_type", "n")


def stream_dedup(spark, d):
    """Events that reach a sink through streaming deduplication, per user; equal to the batch result."""
    s = C.drained(C.deduplicated(C.event_stream(spark, d), "event_id", "ts"), "unicos", "append")
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("ultimo"))


def sessions(spark, d):
    """Sessions of users: events less than two hours apart."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sesiones"), F.max("n").alias("mayor"))


_series_sql = ITEMS + ", serie AS (SELECT org AS clave, substring(fecha, 1, 7) AS periodo, count(*) AS n FROM items WHERE org IS NOT NULL AND fecha IS NOT NULL GROUP BY 1, 2)"
_orders_sql = "serie AS (SELECT c_mktsegment AS clave, strftime(o_orderdate, '%Y-%m') AS periodo, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_profile_sql = """, x1 AS (SELECT *, row_number() OVER w - 1 AS x, n - lag(n) OVER w AS delta FROM serie WINDOW w AS (PARTITION BY clave ORDER BY periodo)),
  x2 AS (SELECT *, lag(delta) OVER (PARTITION BY clave ORDER BY periodo) AS previa FROM x1),
  m AS (SELECT clave, count(*) AS periodos, arg_min(n, periodo) AS primero, arg_max(n, periodo) AS ultimo, sum(n) AS total, max(n) AS maximo, min(n) AS minimo,
        coalesce(CASE WHEN count(*) > 1 THEN regr_slope(CAST(n AS DOUBLE), CAST(x AS DOUBLE)) END, 0.0) AS pendiente, coalesce(stddev_pop(n), 0.0) AS desviacion, count(*) FILTER (delta * previa < 0) AS giros FROM x2 GROUP BY clave),
  p AS (SELECT *, CAST(floor(CASE WHEN periodos < 2 THEN 100.0 ELSE 100.0 * greatest(0.0, least(1.0, 1 - CASE WHEN total > 0 THEN desviacion / (total / periodos) ELSE 0.0 END)) END + 0.5 + 1e-9) AS BIGINT) AS estabilidad,
        CAST(floor(CASE WHEN periodos < 3 THEN 0.0 ELSE 100.0 * least(1.0, CAST(0.6 AS DOUBLE) * giros / (periodos - 2) + CAST(0.4 AS DOUBLE) * CASE WHEN maximo > 0 THEN (maximo - minimo) / maximo ELSE 0 END) END + 0.5 + 1e-9) AS BIGINT) AS volatilidad,
        CAST(floor(pendiente * 1000 + 0.5 + 1e-9) AS BIGINT) AS pendiente_mil FROM m),
  q AS (SELECT *, greatest(0.0, ultimo + pendiente_mil / 1000.0) AS base, volatilidad / 100.0 * (maximo - minimo) AS swing FROM p)
  SELECT clave, periodos, primero, ultimo, giros, CASE WHEN pendiente_mil > 50 THEN 'creciente' WHEN pendiente_mil < -50 THEN 'decreciente' ELSE 'estable' END AS tendencia, pendiente_mil, estabilidad, volatilidad,
         CAST(floor(base * 10 + 0.5 + 1e-9) AS BIGINT) AS base10, CAST(floor((base + swing) * 10 + 0.5 + 1e-9) AS BIGINT) AS alto10, CAST(floor(greatest(0.0, base - swing) * 10 + 0.5 + 1e-9) AS BIGINT) AS bajo10 FROM q"""
_versions_sql = """WITH s AS (SELECT *, lag(hash_contenido) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id) AS antes FROM drift_snapshots WHERE estado_observable = 'ok'),
  v AS (SELECT id, org_nombre, tipo_pagina, row_number() OVER w AS version, lag(hash_contenido) OVER w AS hash_previo FROM s WHERE antes IS NULL OR antes <> hash_contenido WINDOW w AS (PARTITION BY org_nombre, tipo_pagina ORDER BY id))"""
_stop = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
_words = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: x <> '')"
_pairs = "list_distinct(list_transform(list_filter(range(1, len({w})), lambda i: {w}[i] NOT IN ({s}) AND {w}[i + 1] NOT IN ({s}) AND length({w}[i]) + length({w}[i + 1]) > 4), lambda i: {w}[i] || ' ' || {w}[i + 1]))"

QUERIES = {
    "monthly_series": (monthly_series, f"WITH {_series_sql} SELECT * FROM serie"),
    "series_profile": (series_profile, f"WITH {_series_sql} {_profile_sql}"),
    "orders_profile": (orders_profile, f"WITH {_orders_sql} {_profile_sql}"),
    "inflections": (inflections, f"WITH {_orders_sql}, x AS (SELECT *, n - lag(n) OVER w AS a, lead(n) OVER w - n AS b FROM serie WINDOW w AS (PARTITION BY clave ORDER BY periodo)) SELECT clave, periodo FROM x WHERE a * b < 0"),
    "maturity": (maturity, f"WITH {ITEMS}, m AS (SELECT org, CAST(floor(40.0 * least(count(*), 6) / 6 + 30.0 * least(count(DISTINCT nullif(medio, '')), 4) / 4 + 30.0 * least(count(DISTINCT substring(fecha, 1, 7)), 6) / 6 + 0.5 + 1e-9) AS BIGINT) AS puntos FROM items WHERE org IS NOT NULL GROUP BY org) SELECT org, puntos, CASE WHEN puntos >= 75 THEN 'maduro' WHEN puntos >= 50 THEN 'consolidado' WHEN puntos >= 25 THEN 'en_desarrollo' ELSE 'naciente' END AS nivel FROM m"),
    "event_mix_pivot": (event_mix, "SELECT strftime(ts, '%Y-%m-%d') AS dia, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"),
    "version_changes_lag": (version_changes, f"{_versions_sql} SELECT * FROM v"),
    "version_evolution": (version_evolution, f"{_versions_sql} SELECT org_nombre, tipo_pagina, max(version) AS versiones, min(id) AS primera, max(id) AS ultima FROM v GROUP BY 1, 2"),
    "asof_previous_snapshot": (asof_previous, "SELECT id, hash_contenido, last_value(CASE WHEN estado_observable = 'ok' THEN hash_contenido END IGNORE NULLS) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM drift_snapshots"),
    "concept_bigrams_diff": (concept_diff, f"""WITH s AS (SELECT *, last_value(CASE WHEN estado_observable = 'ok' THEN texto END IGNORE NULLS) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM drift_snapshots),
        p AS (SELECT id, {_words.format(c='anterior')} AS wa, {_words.format(c='texto')} AS wb FROM s WHERE estado_observable = 'ok' AND anterior IS NOT NULL AND anterior <> texto),
        c AS (SELECT id, {_pairs.format(w='wa', s=_stop)} AS a, {_pairs.format(w='wb', s=_stop)} AS b FROM p)
        SELECT id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS nuevos, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS perdidos FROM c"""),
    "drift_types": (drift_types, None),
    "drift_evidence": (drift_evidence, None),
    "drift_first_concepts": (drift_concepts, f"""WITH s AS (SELECT *, last_value(CASE WHEN estado_observable = 'ok' THEN texto END IGNORE NULLS) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM drift_snapshots),
        p AS (SELECT id, {_words.format(c='anterior')} AS wa, {_words.format(c='texto')} AS wb FROM s WHERE estado_observable = 'ok' AND anterior IS NOT NULL AND anterior <> texto),
        c AS (SELECT id, {_pairs.format(w='wa', s=_stop)} AS a, {_pairs.format(w='wb', s=_stop)} AS b FROM p)
        SELECT id, 'concepto_nuevo' AS tipo_cambio, unnest(list_sort(list_filter(b, lambda x: NOT list_contains(a, x)))[1:5]) AS concepto FROM c
        UNION ALL SELECT id, 'concepto_eliminado', unnest(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:5]) FROM c"""),
    "drift_timeline": (drift_timeline, """WITH s AS (SELECT *, last_value(CASE WHEN estado_observable = 'ok' THEN hash_contenido END IGNORE NULLS) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM drift_snapshots)
        SELECT org_nombre, capturado_en, id, tipo_pagina, CASE WHEN estado_observable <> 'ok' THEN estado_observable WHEN anterior IS NULL THEN 'primera' WHEN anterior = hash_contenido THEN 'igual' ELSE 'cambio' END AS estado FROM s"""),
    "observable_states": (observable_states, "SELECT estado_observable, tipo_pagina, count(*) AS n, max(capturado_en) AS ultima FROM drift_snapshots GROUP BY 1, 2"),
    "raw_retention": (retention, "SELECT formato, count(*) FILTER (expira_en >= '2024-06-01') AS quedan, count(*) FILTER (expira_en < '2024-06-01') AS purgados, CAST(coalesce(sum(tamano) FILTER (expira_en < '2024-06-01'), 0) AS BIGINT) AS liberado FROM raw_store GROUP BY 1"),
    "health_islands": (health_runs, """WITH r AS (SELECT connector, creado_en, id, false AS ok FROM rechazos UNION ALL SELECT connector, creado_en, id, true FROM evidencias),
        i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY connector ORDER BY creado_en, ok, id ROWS UNBOUNDED PRECEDING) AS isla FROM r),
        f AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY connector, isla ORDER BY creado_en, ok, id ROWS UNBOUNDED PRECEDING) AS k FROM i) SELECT connector, CAST(max(k) AS BIGINT) AS peor, count(*) FILTER (k >= 2) AS alertas FROM f GROUP BY 1"""),
    "dangling_raw": (dangling_raw, "SELECT id, raw_hash FROM evidencias WHERE raw_hash IS NOT NULL AND raw_hash NOT IN (SELECT hash_dedup FROM raw_store)"),
    "insert_if_absent": (insert_if_absent, "SELECT hash_dedup, min(id) AS id FROM evidencias WHERE hash_dedup NOT IN (SELECT hash_dedup FROM raw_store) GROUP BY 1"),
    "coalescing_upsert": (coalescing_upsert, """WITH k AS (SELECT nombre, min(id) AS a, max(id) AS b FROM prospectos GROUP BY 1) SELECT k.nombre, coalesce(CASE WHEN trim(n.vertical) <> '' THEN n.vertical END, o.vertical) AS vertical, coalesce(CASE WHEN trim(n.linkedin) <> '' THEN n.linkedin END, o.linkedin) AS linkedin,
        coalesce(CASE WHEN trim(n.url_perfil) <> '' THEN n.url_perfil END, o.url_perfil) AS url_perfil, 'actualizado' AS accion FROM k JOIN prospectos o ON o.id = k.a JOIN prospectos n ON n.id = k.b"""),
    "content_dedup_fixpoint": (content_dedup, None),
    "stream_windows": (stream_windows, "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS inicio, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_dedup_equals_batch": (stream_dedup, "SELECT user_id, count(DISTINCT event_id) AS n, max(event_id) AS ultimo FROM events GROUP BY 1"),
    "user_sessions": (sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS nueva FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sesiones, max(n) AS mayor FROM c GROUP BY 1"""),
}
