"""Queries over dossiers: hypotheses, validation, comparison, observatory, ranking, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.operators.dossier import dossiers, validated
from tamiz.operators.ordering import positions
from tamiz.plans.base import DOSSIERS, ITEMS, VALIDATED, entities, items
from tamiz.session import table

joined = lambda c: F.array_join(c, "|")


def build(spark, d):
    return dossiers(items(spark, d), entities(spark, d))


def battery(spark, d):
    return validated(build(spark, d))


def dossier_build(spark, d):
    return build(spark, d).select("org", "n", "fuentes", "fechadas", "desde", "hasta", "calidad", joined("tags").alias("tags"), joined("eventos").alias("eventos"))


def noisy_or(spark, d):
    return build(spark, d).select("org", F.floor(F.col("confianza") * 1_000_000 + 0.5).alias("millonesimas"))


def hypothesis_scoring(spark, d):
    return build(spark, d).select("org", "clase", "hipotesis", F.coalesce("dominante", F.lit("")).alias("dominante"), "profundidad", joined("patrones").alias("patrones"))


def pattern_frequency(spark, d):
    return build(spark, d).select(F.explode(F.array_distinct("patrones")).alias("patron")).groupBy("patron").agg(F.count("*").alias("n"))


def validation_battery(spark, d):
    return battery(spark, d).select("org", "suficiencia", "solidez", "nivel", "veredicto", joined("contradicciones").alias("contradicciones"), joined("vacios").alias("vacios"))


def verdicts(spark, d):
    return battery(spark, d).groupBy("veredicto").agg(F.count("*").alias("n"), F.min("solidez").alias("min_solidez"), F.max("solidez").alias("max_solidez"))


def block_motives(spark, d):
    return battery(spark, d).select(F.explode("motivos").alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


def traceability(spark, d):
    e = table(spark, d, "evidencias")
    return e.groupBy("connector").agg(F.count("*").alias("n"), F.count_if(F.trim("url_fuente") != "").alias("con_url"), F.count_if(F.col("fecha_publicacion").isNotNull()).alias("con_fecha"), F.count("raw_hash").alias("con_crudo"))


def directory_anti(spark, d):
    """Entities that no evidence mentions."""
    from tamiz.functions.text import company_key

    p = table(spark, d, "prospectos").select("id", "nombre", company_key(F.col("nombre")).alias("org"))
    return p.join(items(spark, d).select("org").distinct(), "org", "left_anti").select("id", "nombre")


def directory_left(spark, d):
    """Dossiers with the site of their entity (least id of a name wins)."""
    from tamiz.functions.text import company_key

    p = table(spark, d, "prospectos").select("id", "sitio_web", "escala", company_key(F.col("nombre")).alias("org"))
    p = p.groupBy("org").agg(F.min_by(F.struct("sitio_web", "escala"), "id").alias("e")).select("org", "e.sitio_web", "e.escala")
    return build(spark, d).join(p, "org", "left").select("org", "n", "sitio_web", "escala")


def indicators(spark, d):
    """Indicators of all segments at once: by category, by event, both, and in total."""
    i = items(spark, d).withColumn("dolor", F.arrays_overlap("tags", F.array(*[F.lit(t) for t in ("friccion_retencion", "reduccion_personal", "cierre_operaciones", "regulacion")])))
    g = i.groupingSets([["categoria", "tipo"], ["categoria"], ["tipo"], []], "categoria", "tipo")
    return g.agg(F.grouping_id().alias("nivel"), F.count("*").alias("n"), F.count_if("dolor").alias("con_dolor"), F.count_distinct("org").alias("organizaciones"))


def tensions(spark, d):
    return build(spark, d).where("hipotesis <> ''").groupBy("hipotesis").agg(F.count("*").alias("n"), F.count_if(F.col("dolor") & F.col("cambio")).alias("convergentes")).where("n >= 2")


def sentinels(spark, d):
    return build(spark, d).where("dolor and profundidad >= 70 and n <= 2").select("org", "profundidad", "n")


def corpus_quality(spark, d):
    return items(spark, d).groupBy("calidad").agg(F.count("*").alias("n"), F.sum("confianza_cent").alias("suma"), F.count("fecha").alias("fechadas"))


def compare_segments(spark, d, first: str = "Startup", second: str = "Corporativo"):
    """Tags of two categories side by side."""
    i = items(spark, d).select("categoria", F.explode("tags").alias("tag"))
    side = lambda c: i.where(F.col("categoria") == c).groupBy("tag").agg(F.count("*").alias("n"))
    a, b = side(first).withColumnRenamed("n", "a"), side(second).withColumnRenamed("n", "b")
    zero = F.lit(0).cast("long")
    return a.join(b, "tag", "full_outer").select("tag", F.coalesce("a", zero).alias("startup"), F.coalesce("b", zero).alias("corporativo"), (F.coalesce("a", zero) - F.coalesce("b", zero)).alias("delta"))


def compare_periods(spark, d, cut: str = "2024-06-01"):
    """Evidence of each organisation before and after a date; undated rows count as after."""
    after = F.col("fecha").isNull() | (F.col("fecha") >= cut)
    return items(spark, d).where("org is not null").groupBy("org").agg(F.count_if(~after).alias("antes"), F.count_if(after).alias("despues"))


def convergences(spark, d):
    i = items(spark, d)
    return i.where("tipo = 'despido'").select("org").intersect(i.where("tipo = 'contratacion'").select("org"))


def divergences(spark, d, a: str = "ronda", b: str = "queja"):
    """Organisations with one kind of event and not the other, both ways."""
    side = lambda t: items(spark, d).where(F.col("tipo") == t).select("org")
    only = lambda x, y, name: side(x).subtract(side(y)).select(F.lit(name).alias("lado"), "org")
    return only(a, b, "solo_a").unionByName(only(b, a, "solo_b"))


def tag_jaccard(spark, d):
    """Similarity of the tag sets of each organisation and the next one by name within its class, in thousandths."""
    b = positions(build(spark, d).select("org", "clase", "tags"), "clase", ["org"], "p")
    other = b.select("clase", (F.col("p") - 1).alias("p"), F.col("org").alias("otra"), F.col("tags").alias("t2"))
    u, i = F.size(F.array_union("tags", "t2")), F.size(F.array_intersect("tags", "t2"))
    return b.join(other, ["clase", "p"]).select("org", "otra", F.when(u == 0, 0).otherwise(F.floor(i * 1000 / F.greatest(u, F.lit(1)))).cast("long").alias("milesimas"))


def evidence_chain(spark, d):
    """Items of each organisation numbered by date (undated first), outlet and text."""
    i = items(spark, d).where("org is not null").select("org", "id", "medio", "texto", F.coalesce("fecha", F.lit("")).alias("f"))
    return positions(i, "org", ["f", "medio", "texto", "id"], "posicion").select("org", "id", "posicion")


def org_tag_matrix(spark, d):
    return items(spark, d).where("org is not null").select("org", F.explode("tags").alias("tag")).groupBy("org", "tag").agg(F.count("*").alias("n"))


def substance(spark, d):
    """Substance index in thousandths: volume, sources, months covered and confidence."""
    i = items(spark, d).where("org is not null")
    m = F.substring("fecha", 1, 4).cast("int") * 12 + F.substring("fecha", 6, 2).cast("int")
    s = i.groupBy("org").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("medio", F.lit(""))).alias("f"), F.coalesce(F.max(m) - F.min(m) + 1, F.lit(0)).alias("meses"), F.sum("confianza_cent").alias("c"))
    v = 0.4 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.3 * F.least(F.col("f") / 6, F.lit(1.0)) + 0.2 * F.least(F.col("meses") / 6, F.lit(1.0)) + 0.1 * F.col("c") / F.col("n") / 100
    return s.select("org", "n", "f", F.col("meses").cast("long").alias("meses"), F.floor(v * 1000 + 0.5 + 1e-9).alias("milesimas"))


def pattern_vote(spark, d):
    """Dominant signal of each organisation by weighted vote: 1.0 per tag, ties by name."""
    t = items(spark, d).where("org is not null").select("org", F.explode("tags").alias("tag")).groupBy("org", "tag").agg(F.count("*").alias("n"))
    w = W.partitionBy("org").orderBy(F.desc("n"), "tag")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("org", F.col("tag").alias("dominante"), "n")


def dossier_core(spark, d):
    """Flagship: dossiers per user and day over the event stream, with verdicts."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 7
    i = e.select(F.concat(F.lit("org_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd")).alias("org"), F.concat(F.lit("m"), k.cast("string")).alias("fuente"), (F.col("event_id") % 100).alias("c"), "event_type")
    s = i.groupBy("org", "fuente").agg(F.count("*").alias("n"), F.max("c").alias("mc"), F.collect_set("event_type").alias("t"))
    b = s.groupBy("org").agg(F.sum("n").alias("n"), F.count("*").alias("srcs"), F.product(1 - F.col("mc") / 100.0).alias("p"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    conf = F.floor((1 - F.col("p")) * 1_000_000 + 0.5) / 1_000_000.0
    b = b.select("org", "n", "srcs", F.size("t").cast("long").alias("tags"), conf.alias("conf"), F.array_contains("t", "error").alias("pain"), F.arrays_overlap("t", F.array(F.lit("purchase"), F.lit("signup"))).alias("chg"))
    b = b.withColumn("depth", F.when(F.col("pain"), 90).when(F.col("chg"), 35).otherwise(0)).withColumn("contra", F.col("pain") & F.col("chg"))
    suf = F.lit(40.0) * F.least("n", F.lit(3)) / 3 + F.lit(30.0) * F.least("srcs", F.lit(2)) / 2 + 20 + F.lit(10.0) * F.least("tags", F.lit(3)) / 3
    gaps = F.when(F.col("srcs") < 2, 1).otherwise(0) + F.when(F.col("n") < 3, 1).otherwise(0) + F.when(F.col("tags") <= 1, 1).otherwise(0) + 1
    sol = F.lit(25.0) * F.least("n", F.lit(6)) / 6 + F.lit(20.0) * F.least("srcs", F.lit(3)) / 3 + F.lit(0.2) * F.col("depth") + F.lit(20.0) * F.col("conf") - F.when(F.col("contra"), 10).otherwise(0) - F.least(3 * gaps, F.lit(15))
    b = b.withColumn("suf", F.floor(suf + 0.5)).withColumn("sol", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), sol)) + 0.5))
    v = (
        F.when(~F.col("pain") & ~F.col("chg"), "SIN_HIPOTESIS").when((F.col("n") < 3) | (F.col("srcs") < 2) | (F.col("suf") < 40) | (F.col("sol") < 40), "BLOQUEADA").when(F.col("contra"), "NO_VALIDADA")
        .when((F.col("sol") >= 65) & (F.col("suf") >= 60), "VALIDADA").otherwise("VALIDADA_PARCIAL")
    )
    return b.select("org", "n", "srcs", "tags", "suf", "sol", v.alias("verdict"))


_j = lambda c: f"array_to_string({c}, '|')"
_company = "lower(trim(regexp_replace(nombre, '\\s+', ' ', 'g')))"
_core = """WITH i AS (SELECT 'org_' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS org, 'm' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 AS VARCHAR) AS fuente, event_id % 100 AS c, event_type FROM events),
  s AS (SELECT org, fuente, count(*) AS n, max(c) AS mc FROM i GROUP BY 1, 2),
  b AS (SELECT s.org, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS srcs, floor((1 - product(1 - mc / 100.0)) * 1000000 + 0.5) / 1000000.0 AS conf, any_value(t.tags) AS tags, any_value(t.pain) AS pain, any_value(t.chg) AS chg
        FROM s JOIN (SELECT org, count(DISTINCT event_type) AS tags, bool_or(event_type = 'error') AS pain, bool_or(event_type IN ('purchase', 'signup')) AS chg FROM i GROUP BY org) t USING (org) GROUP BY s.org),
  q AS (SELECT *, CAST(floor(40.0 * least(n, 3) / 3 + 30.0 * least(srcs, 2) / 2 + 20 + 10.0 * least(tags, 3) / 3 + 0.5) AS BIGINT) AS suf,
        CAST(floor(greatest(0.0, least(100.0, 25.0 * least(n, 6) / 6 + 20.0 * least(srcs, 3) / 3 + CAST(0.2 AS DOUBLE) * CASE WHEN pain THEN 90 WHEN chg THEN 35 ELSE 0 END + 20.0 * conf - CASE WHEN pain AND chg THEN 10 ELSE 0 END
          - least(3 * (CAST(srcs < 2 AS INT) + CAST(n < 3 AS INT) + CAST(tags <= 1 AS INT) + 1), 15))) + 0.5) AS BIGINT) AS sol FROM b)
  SELECT org, n, srcs, tags, suf, sol, CASE WHEN NOT pain AND NOT chg THEN 'SIN_HIPOTESIS' WHEN n < 3 OR srcs < 2 OR suf < 40 OR sol < 40 THEN 'BLOQUEADA' WHEN pain AND chg THEN 'NO_VALIDADA' WHEN sol >= 65 AND suf >= 60 THEN 'VALIDADA' ELSE 'VALIDADA_PARCIAL' END AS verdict FROM q"""

QUERIES = {
    "dossier_core": (dossier_core, _core),
    "dossier_build": (dossier_build, f"WITH {DOSSIERS} SELECT org, n, fuentes, fechadas, desde, hasta, calidad, {_j('tags')} AS tags, {_j('eventos')} AS eventos FROM d"),
    "noisy_or_confidence": (noisy_or, f"WITH {DOSSIERS} SELECT org, CAST(floor(confianza * 1000000 + 0.5) AS BIGINT) AS millonesimas FROM d"),
    "hypothesis_scoring": (hypothesis_scoring, f"WITH {DOSSIERS} SELECT org, clase, hipotesis, coalesce(dominante, '') AS dominante, profundidad, {_j('patrones')} AS patrones FROM d"),
    "pattern_frequency": (pattern_frequency, f"WITH {DOSSIERS} SELECT patron, count(*) AS n FROM (SELECT unnest(list_distinct(patrones)) AS patron FROM d) GROUP BY 1"),
    "validation_battery": (validation_battery, f"WITH {VALIDATED} SELECT org, suficiencia, solidez, nivel, veredicto, {_j('contradicciones')} AS contradicciones, {_j('vacios')} AS vacios FROM v"),
    "verdicts": (verdicts, f"WITH {VALIDATED} SELECT veredicto, count(*) AS n, min(solidez) AS min_solidez, max(solidez) AS max_solidez FROM v GROUP BY 1"),
    "block_motives": (block_motives, f"WITH {VALIDATED} SELECT motivo, count(*) AS n FROM (SELECT unnest(motivos) AS motivo FROM v) GROUP BY 1"),
    "traceability": (traceability, "SELECT connector, count(*) AS n, count(*) FILTER (trim(url_fuente) <> '') AS con_url, count(fecha_publicacion) AS con_fecha, count(raw_hash) AS con_crudo FROM evidencias GROUP BY 1"),
    "directory_anti_join": (directory_anti, f"WITH {ITEMS} SELECT id, nombre FROM prospectos WHERE {_company} NOT IN (SELECT org FROM items WHERE org IS NOT NULL)"),
    "directory_left_join": (directory_left, f"WITH {DOSSIERS}, p AS (SELECT {_company} AS o, arg_min(sitio_web, id) FILTER (TRUE) AS sw, min(id) AS i FROM prospectos GROUP BY 1) SELECT d.org, d.n, q.sitio_web, q.escala FROM d LEFT JOIN p ON p.o = d.org LEFT JOIN prospectos q ON q.id = p.i"),
    "eco_indicators": (indicators, f"WITH {ITEMS} SELECT categoria, tipo, CAST(grouping(categoria, tipo) AS BIGINT) AS nivel, count(*) AS n, count(*) FILTER (list_has_any(tags, ['friccion_retencion', 'reduccion_personal', 'cierre_operaciones', 'regulacion'])) AS con_dolor, count(DISTINCT org) AS organizaciones FROM items GROUP BY GROUPING SETS ((categoria, tipo), (categoria), (tipo), ())"),
    "eco_tensions": (tensions, f"WITH {DOSSIERS} SELECT hipotesis, count(*) AS n, count(*) FILTER (dolor AND cambio) AS convergentes FROM d WHERE hipotesis <> '' GROUP BY 1 HAVING count(*) >= 2"),
    "sentinels": (sentinels, f"WITH {DOSSIERS} SELECT org, profundidad, n FROM d WHERE dolor AND profundidad >= 70 AND n <= 2"),
    "corpus_quality": (corpus_quality, f"WITH {ITEMS} SELECT calidad, count(*) AS n, CAST(sum(confianza_cent) AS BIGINT) AS suma, count(fecha) AS fechadas FROM items GROUP BY 1"),
    "compare_segments": (compare_segments, f"WITH {ITEMS}, t AS (SELECT categoria, unnest(tags) AS tag FROM items) SELECT tag, count(*) FILTER (categoria = 'Startup') AS startup, count(*) FILTER (categoria = 'Corporativo') AS corporativo, count(*) FILTER (categoria = 'Startup') - count(*) FILTER (categoria = 'Corporativo') AS delta FROM t WHERE categoria IN ('Startup', 'Corporativo') GROUP BY 1"),
    "compare_periods": (compare_periods, f"WITH {ITEMS} SELECT org, count(*) FILTER (fecha < '2024-06-01') AS antes, count(*) FILTER (fecha IS NULL OR fecha >= '2024-06-01') AS despues FROM items WHERE org IS NOT NULL GROUP BY 1"),
    "convergence_intersect": (convergences, f"WITH {ITEMS} SELECT org FROM items WHERE tipo = 'despido' INTERSECT SELECT org FROM items WHERE tipo = 'contratacion'"),
    "divergence_except": (divergences, f"WITH {ITEMS} SELECT 'solo_a' AS lado, org FROM (SELECT org FROM items WHERE tipo = 'ronda' EXCEPT SELECT org FROM items WHERE tipo = 'queja') UNION ALL SELECT 'solo_b', org FROM (SELECT org FROM items WHERE tipo = 'queja' EXCEPT SELECT org FROM items WHERE tipo = 'ronda')"),
    "tag_jaccard": (tag_jaccard, f"WITH {DOSSIERS}, p AS (SELECT org, tags, lead(org) OVER w AS otra, lead(tags) OVER w AS t2 FROM d WINDOW w AS (PARTITION BY clase ORDER BY org)) SELECT org, otra, CAST(CASE WHEN len(list_distinct(tags || t2)) = 0 THEN 0 ELSE floor(len(list_intersect(tags, t2)) * 1000 / len(list_distinct(tags || t2))) END AS BIGINT) AS milesimas FROM p WHERE otra IS NOT NULL"),
    "evidence_chain": (evidence_chain, f"WITH {ITEMS} SELECT org, id, row_number() OVER (PARTITION BY org ORDER BY coalesce(fecha, ''), medio, texto, id) - 1 AS posicion FROM items WHERE org IS NOT NULL"),
    "matrix_long": (org_tag_matrix, f"WITH {ITEMS} SELECT org, tag, count(*) AS n FROM (SELECT org, unnest(tags) AS tag FROM items WHERE org IS NOT NULL) GROUP BY 1, 2"),
    "substance_index": (substance, f"""WITH {ITEMS}, s AS (SELECT org, count(*) AS n, count(DISTINCT nullif(medio, '')) AS f, CAST(coalesce(max(m) - min(m) + 1, 0) AS BIGINT) AS meses, sum(confianza_cent) AS c FROM (SELECT *, CAST(substring(fecha, 1, 4) AS INT) * 12 + CAST(substring(fecha, 6, 2) AS INT) AS m FROM items WHERE org IS NOT NULL) GROUP BY 1)
        SELECT org, n, f, meses, CAST(floor((CAST(0.4 AS DOUBLE) * least(n / 10, 1.0) + CAST(0.3 AS DOUBLE) * least(f / 6, 1.0) + CAST(0.2 AS DOUBLE) * least(meses / 6, 1.0) + CAST(0.1 AS DOUBLE) * c / n / 100) * 1000 + 0.5 + 1e-9) AS BIGINT) AS milesimas FROM s"""),
    "synthesis_pattern_vote": (pattern_vote, f"WITH {ITEMS}, t AS (SELECT org, tag, count(*) AS n FROM (SELECT org, unnest(tags) AS tag FROM items WHERE org IS NOT NULL) GROUP BY 1, 2) SELECT org, tag AS dominante, n FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, tag) AS r FROM t) WHERE r = 1"),
}
