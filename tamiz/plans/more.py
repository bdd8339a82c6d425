"""Further queries: integrity, mentions, findings, directories, mailboxes, periods."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import tagging as G
from tamiz.operators.drift import pairs
from tamiz.plans.analysis import battery, build
from tamiz.plans.base import DOSSIERS, ITEMS, VALIDATED, items, quoted
from tamiz.session import table


def shared_hashes(spark, d):
    """Record hashes that two or more organisations share: an integrity fault."""
    e = table(spark, d, "evidencias").select("hash_dedup", T.company_key(F.col("empresa_mencionada")).alias("org"))
    return e.groupBy("hash_dedup").agg(F.count_distinct("org").alias("organizaciones"), F.count("*").alias("n")).where("organizaciones >= 2")


PLACES = ("bogota", "sao paulo", "mexico", "cordoba", "lima")


def mentions_by_place(spark, d, names: tuple[str, ...] = PLACES):
    """Organisations of which any quote mentions a place, whatever case and accents."""
    low = F.lower(T.strip_accents(F.col("cita_textual")))
    places = F.array(*[F.lit(p) for p in names])
    e = table(spark, d, "evidencias").select(T.company_key(F.col("empresa_mencionada")).alias("org"), F.explode(F.filter(places, lambda p: F.contains(low, p))).alias("lugar"))
    return e.groupBy("lugar").agg(F.count_distinct("org").alias("organizaciones"), F.count("*").alias("citas"))


def findings(spark, d):
    """The five most frequent signals with the share of organisations that have them, in thousandths."""
    b = build(spark, d)
    total = b.count()
    tags = b.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)
    return tags.select("tag", "n", F.floor(F.col("n") * 1000 / max(total, 1)).alias("milesimas"))


def segment_shares(spark, d):
    """Of each class: organisations, with pain, with change, blocked, mean depth in tenths."""
    v = battery(spark, d)
    return v.groupBy("clase").agg(
        F.count("*").alias("n"), F.count_if("dolor").alias("con_dolor"), F.count_if("cambio").alias("con_cambio"), F.count_if(F.size("motivos") > 0).alias("bloqueadas"), F.floor(F.sum("profundidad") * 10 / F.count("*")).alias("profundidad10")
    )


def systemic_gaps(spark, d):
    return battery(spark, d).select(F.explode("vacios").alias("vacio")).groupBy("vacio").agg(F.count("*").alias("n"))


def periods(spark, d):
    """First and last date of each organisation and of all, with grouping sets."""
    i = items(spark, d).where("fecha is not null")
    return i.groupingSets([["org"], []], "org").agg(F.grouping_id().alias("nivel"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.count("*").alias("n"))


def union_report(spark, d):
    """Entities in the news and entities only in the directory, in one report."""
    news = build(spark, d).select(F.lit("noticias").alias("origen"), "org", "clase", "n")
    p = table(spark, d, "prospectos").select(T.company_key(F.col("nombre")).alias("org")).distinct()
    rest = p.join(news.select("org"), "org", "left_anti").select(F.lit("directorio").alias("origen"), "org", F.lit("C").alias("clase"), F.lit(0).cast("long").alias("n"))
    return news.unionByName(rest)


def mailbox_reasons(spark, d):
    m = table(spark, d, "prospectos").select(F.explode(T.mailboxes(F.col("discurso_corporativo"))).alias("m"))
    return m.select(T.mailbox_reason(F.col("m")).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


def speakers(spark, d):
    """Who is quoted by how many outlets, most first."""
    e = table(spark, d, "evidencias").where(F.trim(F.coalesce("persona_citada", F.lit(""))) != "")
    return e.groupBy(F.lower(T.collapse(F.col("persona_citada"))).alias("persona")).agg(F.count("*").alias("n"), F.count_distinct("nombre_medio").alias("medios"), F.min("creado_en").alias("primera"))


def source_overlap(spark, d):
    """Pairs of outlets by the organisations that both report on; an outlet table is small, the pairs are bounded by it."""
    o = items(spark, d).where("org is not null").select("org", F.col("medio").alias("fuente")).distinct()
    a = o.groupBy("org").agg(F.array_sort(F.collect_set("fuente")).alias("f")).where(F.size("f") > 1)
    one = a.select("f", F.posexplode("f").alias("k", "a"))
    return one.select("a", F.explode(F.slice("f", F.col("k") + 2, F.size("f"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("organizaciones"))


def quantiles(spark, d):
    """Exact quartiles of evidence per organisation, by class."""
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by n)").cast("long")
    return build(spark, d).groupBy("clase").agg(q(0.25).alias("q1"), q(0.5).alias("mediana"), q(0.75).alias("q3"), F.max("n").alias("maximo"))


def revenue_share(spark, d):
    """Revenue by market segment and priority, with totals, as a cube in whole cents."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return o.withColumn("c", cents).cube("c_mktsegment", "o_orderpriority").agg(F.grouping_id().alias("nivel"), F.sum("c").alias("centavos"), F.count("*").alias("n"))


def discourse(spark, d):
    """The leading type of discourse of each corporate text, and how many markers it has."""
    h = F.try_element_at(G.discourse_hits(F.col("discurso_corporativo")), F.lit(1))
    return table(spark, d, "prospectos").select("id", F.coalesce(h["tipo"], F.lit("requiere_campo")).alias("tipo"), F.coalesce(h["marcas"], F.lit(0).cast("long")).alias("marcas"))


def discourse_types(spark, d):
    h = table(spark, d, "prospectos").select(F.explode(G.discourse_hits(F.col("discurso_corporativo"))).alias("h"))
    return h.groupBy(F.col("h.tipo").alias("tipo")).agg(F.count("*").alias("n"), F.sum("h.marcas").alias("marcas"))


def actors(spark, d):
    """People and their roles in each organisation's evidence."""
    e = table(spark, d, "evidencias").where("persona_citada is not null")
    org, who = T.company_key(F.col("empresa_mencionada")), F.lower(T.collapse(F.col("persona_citada")))
    return e.select(org.alias("org"), who.alias("persona"), F.coalesce("cargo", F.lit("")).alias("cargo"), "id").groupBy("org", "persona", "cargo").agg(F.min("id").alias("primera"), F.count("*").alias("n"))


def field_changes(spark, d):
    """Fields that differ between consecutive rows of one name, as (name, id, field, before, after)."""
    w = W.partitionBy("nombre").orderBy("id")
    fields = ("vertical", "sitio_web", "linkedin", "escala")
    p = table(spark, d, "prospectos").select("nombre", "id", *[F.struct(F.lit(f).alias("campo"), F.lag(f).over(w).alias("antes"), F.col(f).alias("despues")).alias(f) for f in fields], F.lag("id").over(w).alias("previo"))
    changed = F.filter(F.array(*fields), lambda x: ~x["antes"].eqNullSafe(x["despues"]))
    return p.where("previo is not null").select("nombre", "id", F.explode(changed).alias("x")).select("nombre", "id", "x.campo", "x.antes", "x.despues")


def narrative_overlap(spark, d):
    """Overlap of the words longer than three letters of each capture with those of the one before, in thousandths."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), " "), lambda x: F.length(x) > 3))
    p = pairs(table(spark, d, "drift_snapshots")).select("id", words(F.col("anterior")).alias("a"), words(F.col("texto")).alias("b"))
    u = F.size(F.array_union("a", "b"))
    return p.select("id", F.when(u == 0, 1000).otherwise(F.floor(F.size(F.array_intersect("a", "b")) * 1000 / F.greatest(u, F.lit(1)))).cast("long").alias("milesimas"))


def tag_directory(spark, d):
    """For each signal: how many organisations have it, and the first and last of them by name."""
    return build(spark, d).select("org", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("org").alias("primera"), F.max("org").alias("ultima"))


def continuity(spark, d):
    """Continuity of each organisation's presence, 0 to 100, from items and sources."""
    i = items(spark, d).where("org is not null").groupBy("org").agg(F.count("*").alias("n"), F.count_distinct("fuente").alias("f"))
    p = F.least(F.lit(100), 40 + 10 * F.least("n", F.lit(4)) + 5 * F.least("f", F.lit(3))).cast("long")
    return i.select("org", p.alias("puntos"), F.when(p >= 80, "continua").when(p >= 60, "parcial").otherwise("debil").alias("banda"))


def relaxation(spark, d, vertical: str = "fintech", category: str = "VC"):
    """Entities for a request by vertical and category, relaxed to the vertical alone, then to all; the level that was needed."""
    level = F.when((F.col("vertical") == vertical) & (F.col("categoria") == category), 0).when(F.col("vertical") == vertical, 1).otherwise(2)
    tagged = table(spark, d, "prospectos").select("id", level.cast("long").alias("nivel"))
    return tagged.join(F.broadcast(tagged.agg(F.min("nivel").alias("nivel"))), "nivel", "left_semi").select("id", "nivel")


_url = "lower(trim(regexp_replace(coalesce(empresa_mencionada, ''), '\\s+', ' ', 'g')))"
_places = "(VALUES ('bogota'), ('sao paulo'), ('mexico'), ('cordoba'), ('lima')) p(lugar)"
_disc = "lower(strip_accents(discurso_corporativo))"
_hits = "[" + ", ".join("struct_pack(n := " + " + ".join(f"CAST(contains({_disc}, '{m}') AS BIGINT)" for m in ms) + f", k := {k}, tipo := '{kind}')" for k, (kind, ms) in enumerate(L.DISCOURSE.items())) + "]"
_hits_sql = f"WITH h AS (SELECT id, unnest({_hits}) AS h FROM prospectos), x AS (SELECT id, h.n AS n, h.k AS k, h.tipo AS tipo FROM h WHERE h.n > 0)"
_words = "list_distinct(list_filter(string_split(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), ' '), lambda x: length(x) > 3))"
_fields = " UNION ALL ".join(f"SELECT nombre, id, '{f}' AS campo, lag({f}) OVER w AS antes, {f} AS despues, lag(id) OVER w AS previo FROM prospectos WINDOW w AS (PARTITION BY nombre ORDER BY id)" for f in ("vertical", "sitio_web", "linkedin", "escala"))
QUERIES = {
    "discourse_leading": (discourse, f"{_hits_sql}, b AS (SELECT id, tipo, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, k) AS r FROM x) WHERE r = 1) SELECT p.id, coalesce(b.tipo, 'requiere_campo') AS tipo, coalesce(b.n, 0) AS marcas FROM prospectos p LEFT JOIN b ON b.id = p.id"),
    "discourse_types": (discourse_types, f"{_hits_sql} SELECT tipo, count(*) AS n, CAST(sum(n) AS BIGINT) AS marcas FROM x GROUP BY 1"),
    "actors": (actors, f"SELECT {_url} AS org, lower(trim(regexp_replace(persona_citada, '\\s+', ' ', 'g'))) AS persona, coalesce(cargo, '') AS cargo, min(id) AS primera, count(*) AS n FROM evidencias WHERE persona_citada IS NOT NULL GROUP BY 1, 2, 3"),
    "field_changes": (field_changes, f"SELECT nombre, id, campo, antes, despues FROM ({_fields}) WHERE previo IS NOT NULL AND antes IS DISTINCT FROM despues"),
    "narrative_overlap": (narrative_overlap, f"""WITH s AS (SELECT *, last_value(CASE WHEN estado_observable = 'ok' THEN texto END IGNORE NULLS) OVER (PARTITION BY org_nombre, tipo_pagina ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anterior FROM drift_snapshots),
        p AS (SELECT id, {_words.format(c='anterior')} AS a, {_words.format(c='texto')} AS b FROM s WHERE estado_observable = 'ok' AND anterior IS NOT NULL)
        SELECT id, CAST(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1000 ELSE floor(len(list_intersect(a, b)) * 1000 / len(list_distinct(a || b))) END AS BIGINT) AS milesimas FROM p"""),
    "tag_directory": (tag_directory, f"WITH {DOSSIERS} SELECT tag, count(*) AS n, min(org) AS primera, max(org) AS ultima FROM (SELECT org, unnest(tags) AS tag FROM d) GROUP BY 1"),
    "continuity": (continuity, f"WITH {ITEMS}, c AS (SELECT org, CAST(least(100, 40 + 10 * least(count(*), 4) + 5 * least(count(DISTINCT fuente), 3)) AS BIGINT) AS puntos FROM items WHERE org IS NOT NULL GROUP BY 1) SELECT org, puntos, CASE WHEN puntos >= 80 THEN 'continua' WHEN puntos >= 60 THEN 'parcial' ELSE 'debil' END AS banda FROM c"),
    "relaxation_cascade": (relaxation, "WITH t AS (SELECT id, CAST(CASE WHEN vertical = 'fintech' AND categoria = 'VC' THEN 0 WHEN vertical = 'fintech' THEN 1 ELSE 2 END AS BIGINT) AS nivel FROM prospectos) SELECT id, nivel FROM t WHERE nivel = (SELECT min(nivel) FROM t)"),
    "shared_hashes": (shared_hashes, f"SELECT hash_dedup, count(DISTINCT {_url}) AS organizaciones, count(*) AS n FROM evidencias GROUP BY 1 HAVING count(DISTINCT {_url}) >= 2"),
    "mentions_by_place": (mentions_by_place, f"SELECT lugar, count(DISTINCT {_url}) AS organizaciones, count(*) AS citas FROM evidencias, {_places} WHERE contains(lower(strip_accents(cita_textual)), lugar) GROUP BY 1"),
    "findings_top_tags": (findings, f"WITH {DOSSIERS}, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM d) GROUP BY 1 ORDER BY n DESC, tag LIMIT 5) SELECT tag, n, CAST(floor(n * 1000 / (SELECT count(*) FROM d)) AS BIGINT) AS milesimas FROM t"),
    "segment_shares": (segment_shares, f"WITH {VALIDATED} SELECT clase, count(*) AS n, count(*) FILTER (dolor) AS con_dolor, count(*) FILTER (cambio) AS con_cambio, count(*) FILTER (len(motivos) > 0) AS bloqueadas, CAST(floor(sum(profundidad) * 10 / count(*)) AS BIGINT) AS profundidad10 FROM v GROUP BY 1"),
    "systemic_gaps": (systemic_gaps, f"WITH {VALIDATED} SELECT vacio, count(*) AS n FROM (SELECT unnest(vacios) AS vacio FROM v) GROUP BY 1"),
    "period_bounds": (periods, f"WITH {ITEMS} SELECT org, CAST(grouping(org) AS BIGINT) AS nivel, min(fecha) AS desde, max(fecha) AS hasta, count(*) AS n FROM items WHERE fecha IS NOT NULL GROUP BY GROUPING SETS ((org), ())"),
    "union_report": (union_report, f"WITH {DOSSIERS} SELECT 'noticias' AS origen, org, clase, n FROM d UNION ALL SELECT DISTINCT 'directorio', lower(trim(regexp_replace(nombre, '\\s+', ' ', 'g'))), 'C', 0 FROM prospectos WHERE lower(trim(regexp_replace(nombre, '\\s+', ' ', 'g'))) NOT IN (SELECT org FROM d)"),
    "mailbox_reasons": (mailbox_reasons, f"""WITH m AS (SELECT id, lower(unnest(regexp_extract_all(discurso_corporativo, '{T.MAILBOX}'))) AS m FROM prospectos), u AS (SELECT DISTINCT id, m, split_part(m, '@', 1) AS l, split_part(m, '@', 2) AS d, regexp_extract(split_part(m, '@', 2), '\\.([^.]+)$', 1) AS e FROM m)
        SELECT CASE WHEN NOT regexp_matches(m, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') THEN 'sintaxis' WHEN d IN ({quoted(T.PLACEHOLDER_DOMAINS)}) THEN 'dominio_de_ejemplo' WHEN e IN ({quoted(T.RESERVED_ENDINGS)}) THEN 'terminacion_reservada' WHEN e IN ({quoted(T.IMAGE_ENDINGS)}) THEN 'imagen'
        WHEN regexp_matches(l, '\\.\\.|^\\.|\\.$') THEN 'puntos' WHEN regexp_matches(l, '^[^a-z]') THEN 'inicio' WHEN regexp_matches(l, '{T.GENERIC_LOCAL}') THEN 'generico' ELSE '' END AS motivo, count(*) AS n FROM u GROUP BY 1"""),
    "speakers": (speakers, "SELECT lower(trim(regexp_replace(persona_citada, '\\s+', ' ', 'g'))) AS persona, count(*) AS n, count(DISTINCT nombre_medio) AS medios, min(creado_en) AS primera FROM evidencias WHERE trim(coalesce(persona_citada, '')) <> '' GROUP BY 1"),
    "source_overlap": (source_overlap, f"WITH {ITEMS}, o AS (SELECT DISTINCT org, medio AS fuente FROM items WHERE org IS NOT NULL) SELECT x.fuente AS a, y.fuente AS b, count(*) AS organizaciones FROM o x JOIN o y ON x.org = y.org AND x.fuente < y.fuente GROUP BY 1, 2"),
    "evidence_quartiles": (quantiles, f"WITH {DOSSIERS} SELECT clase, CAST(quantile_disc(n, 0.25) AS BIGINT) AS q1, CAST(quantile_disc(n, 0.5) AS BIGINT) AS mediana, CAST(quantile_disc(n, 0.75) AS BIGINT) AS q3, max(n) AS maximo FROM d GROUP BY 1"),
    "revenue_cube": (revenue_share, "SELECT c_mktsegment, o_orderpriority, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS nivel, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS centavos, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)"),
}
