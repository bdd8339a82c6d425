"""Queries over all dossiers: ranking, findings, alerts, risks, curation, comparison of segments and organisations.

Texts of reports are given as codes and figures; wording is left to whoever prints them. Reports of the best k are limits
over a total order, so they are taken without sorting everything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz import lexicon as L
from tamiz.operators import series as S
from tamiz.operators.ordering import positions
from tamiz.plans.analysis import battery, build
from tamiz.plans.base import DOSSIERS, ITEMS, VALIDATED, items, listed, quoted

#: Length of the reports of the best.
TOP = 50
joined = lambda c: F.array_join(c, "|")
zero = lambda: F.lit(0).cast("long")


def composite() -> Column:
    """Composite score in tenths: class, interest, volume, patterns, hypotheses and intensity."""
    return (
        F.when(F.col("clase") == "A", 400).when(F.col("clase") == "B", 200).otherwise(50) + 3 * F.col("icp") + 15 * F.least("n", F.lit(20)) + 50 * F.size("patrones") + F.when(F.col("hipotesis") != "", 100).otherwise(0)
        + F.when(F.col("secundaria") != "", 30).otherwise(0) + F.when(F.col("intensidad") == "Alta", 100).when(F.col("intensidad") == "Media", 50).otherwise(0)
    ).cast("long")


def motives() -> Column:
    """Why an organisation ranks where it does, as codes."""
    return F.array_compact(
        F.array(
            F.when(F.col("clase").isin("A", "B"), F.concat(F.lit("clase_"), "clase")), F.when(F.col("n") >= 5, "volumen_alto").when(F.col("n") >= 2, "volumen"), F.when(F.col("hipotesis") != "", "hipotesis"),
            F.when(F.col("intensidad") == "Alta", "intensidad_alta"), F.when(F.size("patrones") > 0, "patrones"), F.when(F.col("icp") >= 70, "interes_alto").when(F.col("icp") >= 50, "interes_medio"),
        )
    )


def _confidence() -> Column:
    return F.when(F.col("nivel") == "I", "Alta").when(F.col("nivel") == "II", "Media").otherwise("Baja")


def _priority() -> Column:
    return F.when(F.col("puntos10") >= 600, "Alta").when(F.col("puntos10") >= 350, "Media").otherwise("Baja")


def _numbered(top, *order):
    """Positions from 1 over a report of the best k."""
    return top.withColumn("posicion", F.row_number().over(W.orderBy(*order)).cast("long"))


def composite_score(spark, d):
    return build(spark, d).select("org", composite().alias("puntos10"), joined(motives()).alias("motivos"))


def ranking(spark, d, top: int = TOP):
    """The organisations with the highest composite score, ties by name, with priority, motives and confidence."""
    r = battery(spark, d).withColumn("puntos10", composite())
    order = (F.desc("puntos10"), "org")
    return _numbered(r.orderBy(*order).limit(top), *order).select("posicion", "org", "puntos10", _priority().alias("prioridad"), joined(motives()).alias("motivos"), "n", "hipotesis", _confidence().alias("nivel_confianza"), "veredicto")


def priorities(spark, d, top: int = TOP):
    """As the ranking, but validated hypotheses first."""
    weight = F.array_position(F.array(*[F.lit(v) for v in L.VERDICTS]), F.col("veredicto"))
    r = battery(spark, d).withColumn("puntos10", composite()).withColumn("peso", weight)
    order = ("peso", F.desc("puntos10"), "org")
    return _numbered(r.orderBy(*order).limit(top), *order).select("posicion", "org", "veredicto", "puntos10")


def opportunities(spark, d, top: int = TOP):
    """Hypotheses with support that aren't blocked, by interest."""
    v = battery(spark, d).where("not bloqueada and veredicto in ('VALIDADA', 'VALIDADA_PARCIAL')")
    return v.orderBy(F.desc("icp"), "org").limit(top).select("org", "hipotesis", "veredicto", "solidez", "n", "nivel", _confidence().alias("nivel_confianza"), "icp")


def action() -> Column:
    return F.when((F.col("clase") == "A") & (F.col("icp") >= 50), "profundizar").when(F.col("clase") == "A", "corroborar").when((F.col("clase") == "B") & (F.col("icp") >= 40), "vigilar").otherwise("observar")


def alerts(spark, d, top: int = 20):
    """The first organisations by name with strong signals, the reasons and the suggested step."""
    reasons = F.array_compact(
        F.array(
            F.when((F.col("clase") == "A") & (F.col("intensidad") == "Alta"), "dolor_intenso"), F.when((F.col("hipotesis") != "") & (F.col("secundaria") != ""), "dos_hipotesis"),
            F.when(F.col("n") >= 5, "evidencias_acumuladas"), F.when(F.size("patrones") >= 2, "patrones_convergentes"),
        )
    )
    return build(spark, d).withColumn("razones", reasons).where(F.size("razones") > 0).orderBy("org").limit(top).select("org", "clase", "hipotesis", "intensidad", joined("razones").alias("razones"), action().alias("accion"))


def suggested_actions(spark, d):
    return build(spark, d).select("org", action().alias("accion"))


def _percent(n: Column, total: Column) -> Column:
    """Whole per cent, half to even."""
    return F.bround(100 * n / F.greatest(total, F.lit(1)), 0).cast("long")


def findings(spark, d):
    """Findings over all organisations: the five most frequent signals, pain, change, the three leading hypotheses, the three leading verticals of two or more."""
    b = build(spark, d).select("org", "tags", "dolor", "cambio", "hipotesis", "vertical")
    facts = b.select(
        F.explode(
            F.concat(
                F.transform("tags", lambda t: F.struct(F.lit("senales_frecuentes").alias("tipo"), t.alias("clave"))), F.array_compact(F.array(F.when(F.col("dolor"), F.struct(F.lit("dolor_ecosistema").alias("tipo"), F.lit("").alias("clave"))),
                F.when(F.col("cambio"), F.struct(F.lit("cambio_ecosistema").alias("tipo"), F.lit("").alias("clave"))), F.when(F.col("hipotesis") != "", F.struct(F.lit("deuda_dominante").alias("tipo"), F.col("hipotesis").alias("clave"))),
                F.when(F.col("vertical") != "", F.struct(F.lit("concentracion_vertical").alias("tipo"), F.col("vertical").alias("clave"))), F.struct(F.lit("total").alias("tipo"), F.lit("").alias("clave")))),
            )
        ).alias("x")
    ).groupBy("x.tipo", "x.clave").agg(F.count("*").alias("n"))
    r = facts.withColumn("puesto", F.row_number().over(W.partitionBy("tipo").orderBy(F.desc("n"), "clave")))
    most = F.when(F.col("tipo") == "senales_frecuentes", 5).when(F.col("tipo").isin("deuda_dominante", "concentracion_vertical"), 3).otherwise(1)
    total = facts.where("tipo = 'total'").select(F.col("n").alias("total"))
    r = r.where((F.col("puesto") <= most) & (F.col("tipo") != "total") & ((F.col("tipo") != "concentracion_vertical") | (F.col("n") > 1)))
    return r.join(F.broadcast(total)).select("tipo", "clave", "n", _percent(F.col("n"), F.col("total")).alias("pct"))


def central_hypothesis(spark, d):
    """The most frequent hypothesis, its share, and how far that carries: alta from 40 %, media from 20 %."""
    f = build(spark, d).agg(F.count("*").alias("organizaciones"))
    h = build(spark, d).where("hipotesis <> ''").groupBy("hipotesis").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hipotesis").limit(1)
    p = _percent(F.col("n"), F.col("organizaciones"))
    return h.join(F.broadcast(f)).select("hipotesis", "n", "organizaciones", p.alias("pct"), F.when(p >= 40, "alta").when(p >= 20, "media").otherwise("baja").alias("confianza"))


def risks(spark, d):
    """Cultural, narrative and global risk of each organisation (0 to 100) and its level."""
    i = items(spark, d).where("org is not null")
    series = S.profile(S.monthly(i.select("org", F.substring("fecha", 1, 7).alias("mes")), "org", "mes")).select(F.col("clave").alias("org"), "volatilidad")
    kinds = i.groupBy("org").agg(F.count_distinct(F.coalesce("tipo", F.lit(""))).alias("tipos"))
    v = battery(spark, d).join(series, "org", "left").join(kinds, "org")
    pains = F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in L.PAIN])))
    cultural = F.bround(F.least(F.lit(100.0), F.col("profundidad") * 0.5 + pains * 15 + F.when(F.col("bloqueada"), 10).otherwise(0)), 0).cast("long")
    told = F.bround(F.least(F.lit(100.0), (7 * F.coalesce("volatilidad", F.lit(0)) + 50 * F.col("tipos")) / 10.0), 0).cast("long")
    both = F.bround((F.col("cultural") + F.col("narrativo")) / 2.0, 0).cast("long")
    level = F.when(F.col("global") >= 66, "alto").when(F.col("global") >= 33, "medio").otherwise("bajo")
    return v.select("org", "hipotesis", cultural.alias("cultural"), told.alias("narrativo")).withColumn("global", both).withColumn("nivel", level)


def risk_histogram(spark, d):
    return risks(spark, d).groupBy("nivel").agg(F.count("*").alias("n"))


def cultural_risks(spark, d, top: int = TOP):
    return risks(spark, d).orderBy(F.desc("global"), "org").limit(top).select("org", "hipotesis", "global", "nivel")


def eco_maturity(spark, d):
    """Organisations by maturity, and the mean in tenths."""
    from tamiz.plans.temporal import maturity

    return maturity(spark, d).groupBy("nivel").agg(F.count("*").alias("n"), F.floor(F.sum("puntos") * 10 / F.count("*")).alias("media10"))


def tension(spark, d):
    """What prevails over all organisations: pain and growth from 20 % each, and the step that follows."""
    a = build(spark, d).agg(F.count("*").alias("n"), F.count_if("dolor").alias("con_dolor"), F.count_if("cambio").alias("con_cambio"), F.count_if(F.col("dolor") & F.col("cambio")).alias("convergentes"), F.count_if(F.col("clase") == "A").alias("clase_a"))
    pain, change = 5 * F.col("con_dolor") >= F.col("n"), 5 * F.col("con_cambio") >= F.col("n")
    kind = F.when(F.col("n") == 0, "estancamiento").when(pain & change, "dolor_y_crecimiento").when(pain, "dolor_dominante").when(change, "crecimiento_dominante").otherwise("estancamiento")
    step = F.when(F.col("convergentes") >= 2, "observar_convergentes").when(F.col("clase_a") >= 3, "peritaje").when(F.col("con_dolor") > 0, "ampliar_dolor").when(F.col("n") > 0, "vigilar_cambio").otherwise("ampliar_captura")
    return a.select("n", "con_dolor", "con_cambio", "convergentes", kind.alias("tension"), step.alias("paso"))


def _only(names) -> Column:
    return joined(F.array_sort(F.array_intersect("tags", F.array(*[F.lit(t) for t in names]))))


def convergences(spark, d, top: int = 5):
    """Organisations with pain and change at once, by interest, with what the pair says."""
    has = lambda t: F.array_contains("tags", t)
    reading = (
        F.when(has("friccion_retencion") & has("crecimiento"), "crece_y_pierde").when(has("reduccion_personal") & has("ronda_inversion"), "capital_y_recorte").when(has("friccion_retencion") & has("expansion"), "expande_y_friccion")
        .when(has("cierre_operaciones"), "cierra_y_mueve").when(has("regulacion"), "regulacion_y_cambio").otherwise("cruzadas")
    )
    return build(spark, d).where("dolor and cambio").orderBy(F.desc("icp"), "org").limit(top).select("org", "icp", "hipotesis", _only(L.PAIN).alias("senales_dolor"), _only(L.CHANGE).alias("senales_cambio"), reading.alias("lectura"))


def curated(spark, d, top: int = 5):
    """The organisations to read first: class A, then B, by interest and volume; any if there are none of these."""
    b = build(spark, d).withColumn("grupo", F.when(F.col("clase") == "A", 0).when(F.col("clase") == "B", 1).otherwise(2))
    first = b.orderBy("grupo", F.desc("icp"), F.desc("n"), "org").limit(top)
    some = F.min("grupo").over(W.partitionBy()) <= 1
    return first.withColumn("hay", some).where((F.col("grupo") <= 1) | ~F.col("hay")).select("org", "clase", "icp", "n", "hipotesis", "viabilidad", _only(L.PAIN).alias("senales_dolor"), _only(L.CHANGE).alias("senales_cambio"))


def observed(spark, d):
    """Each observed organisation: alert level, consistency by sources, quality by confidence, operational and narrative evidence, subtype."""
    viable = F.col("viabilidad")
    alert = F.when((viable == "alta") & (F.col("intensidad") == "Alta"), "Crítica").when(viable == "alta", "Alta").when(viable == "media", "Media").otherwise("")
    outlets = items(spark, d).where("org is not null and medio <> ''").groupBy("org").agg(F.count_distinct("medio").alias("medios"))
    has = lambda *ts: F.arrays_overlap("eventos", F.array(*[F.lit(t) for t in ts]))
    m = F.coalesce("medios", F.lit(0))
    return build(spark, d).join(outlets, "org", "left").select(
        "org", alert.alias("alerta"), F.when(m >= 3, "Sólida").when(m == 2, "Moderada").otherwise("Débil").alias("consistencia"), F.when(F.col("mejor_cent") >= 80, "Alta").when(F.col("mejor_cent") >= 50, "Media").otherwise("Baja").alias("calidad_evidencia"),
        has("contratacion", "cambio_sitio", "ronda").alias("operativa"), has("queja", "lanzamiento", "despido").alias("narrativa"), F.regexp_replace("hipotesis", "^Deuda ", "").alias("subtipo"), F.initcap("viabilidad").alias("viabilidad"),
    )


def observed_summary(spark, d):
    return observed(spark, d).groupBy("alerta", "consistencia").agg(F.count("*").alias("n"), F.count_if("operativa").alias("operativas"), F.count_if("narrativa").alias("narrativas"))


def narrative_drift(spark, d):
    """Narrative events of each organisation: how many and the last date."""
    i = items(spark, d).where(F.col("org").isNotNull() & F.col("tipo").isin("queja", "lanzamiento", "despido"))
    return i.groupBy("org", "tipo").agg(F.count("*").alias("n"), F.max("fecha").alias("ultima"))


def dense_ids(spark, d):
    """Organisations numbered from 0 by name."""
    return positions(build(spark, d).select(F.lit("").alias("g"), "org"), "g", ["org"], "org_id").select("org", "org_id")


def clusters(spark, d):
    """Groups of two or more organisations by hypothesis and vertical, with their five most frequent signals."""
    b = build(spark, d).select(F.when(F.col("hipotesis") == "", "sin_deuda").otherwise(F.col("hipotesis")).alias("deuda"), F.when(F.col("vertical") == "", "sin_vertical").otherwise(F.col("vertical")).alias("vertical"), "org", "tags")
    g = b.groupBy("deuda", "vertical").agg(F.count("*").alias("tamano"), F.min("org").alias("primera"), F.max("org").alias("ultima")).where("tamano >= 2")
    t = b.select("deuda", "vertical", F.explode("tags").alias("tag")).groupBy("deuda", "vertical", "tag").agg(F.count("*").alias("n"))
    t = t.groupBy("deuda", "vertical").agg(joined(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag"))), 1, 5), lambda x: x["tag"])).alias("senales"))  # twelve signals at most
    return g.join(t, ["deuda", "vertical"], "left").select("deuda", "vertical", "tamano", "primera", "ultima", F.coalesce("senales", F.lit("")).alias("senales"))


def outliers(spark, d):
    """Atypical organisations: interest more than one deviation from the mean, the only one with its hypothesis, or depth carried by one item."""
    b = build(spark, d).select("org", "icp", "hipotesis", "profundidad", "n")
    s = b.agg(F.sum("icp").alias("s"), F.sum(F.col("icp") * F.col("icp")).alias("q"), F.count("*").alias("k"))
    h = b.where("hipotesis <> ''").groupBy("hipotesis").agg(F.count("*").alias("iguales"))
    dev = F.col("icp") * F.col("k") - F.col("s")
    var = F.col("q") * F.col("k") - F.col("s") * F.col("s")  # |icp - mean| > deviation, in whole numbers
    why = F.array_compact(F.array(F.when((var > 0) & (dev * dev > var), "interes_desviado"), F.when(F.col("iguales") == 1, "hipotesis_unica"), F.when((F.col("profundidad") >= 70) & (F.col("n") <= 1), "profundidad_sin_volumen")))
    return b.join(h, "hipotesis", "left").join(F.broadcast(s)).withColumn("r", why).where(F.size("r") > 0).select("org", "icp", "hipotesis", joined("r").alias("razones"))


def context(spark, d):
    """Each organisation among its cluster: size, and how many sentinels and outliers stand in the same cluster."""
    key = lambda df: df.withColumn("deuda", F.when(F.col("hipotesis") == "", "sin_deuda").otherwise(F.col("hipotesis")))
    b = key(build(spark, d).select("org", "hipotesis", "vertical", "dolor", "profundidad", "n"))
    odd = outliers(spark, d).select("org", F.lit(True).alias("atipica"))
    b = b.join(odd, "org", "left")
    g = b.groupBy("deuda", "vertical").agg(F.count("*").alias("tamano"), F.count_if(F.col("dolor") & (F.col("profundidad") >= 70) & (F.col("n") <= 2)).alias("centinelas"), F.count("atipica").alias("atipicas"))
    return b.join(g.where("tamano >= 2"), ["deuda", "vertical"], "left").select("org", F.coalesce("tamano", zero()).alias("tamano"), F.coalesce("centinelas", zero()).alias("centinelas"), F.coalesce("atipicas", zero()).alias("atipicas"))


def segments(spark, d):
    """Indicators of all organisations by category, vertical, both and in total: counts, pain, change, blocked, mean interest in hundredths."""
    v = battery(spark, d).select(F.coalesce("categoria", F.lit("")).alias("categoria"), "vertical", "dolor", "cambio", "bloqueada", "icp")
    g = v.groupingSets([["categoria", "vertical"], ["categoria"], ["vertical"], []], "categoria", "vertical")
    return g.agg(F.grouping_id().alias("nivel"), F.count("*").alias("n"), F.count_if("dolor").alias("con_dolor"), F.count_if("cambio").alias("con_cambio"), F.count_if("bloqueada").alias("bloqueadas"), F.floor(F.sum("icp") * 100 / F.count("*")).alias("icp100"))


def segment_mix(spark, d):
    """Classes, hypotheses and verticals by category: the distributions of each ecosystem."""
    b = build(spark, d)
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in ("clase", "hipotesis", "vertical")])).alias("x")
    return b.select(F.coalesce("categoria", F.lit("")).alias("categoria"), x).where("x.valor <> ''").groupBy("categoria", "x.campo", "x.valor").agg(F.count("*").alias("n"))


def compare_ecosystems(spark, d, a: str = "Startup", b: str = "Corporativo"):
    """Two categories side by side: organisations, pain and change in thousandths, mean interest in hundredths, and the differences."""
    v = build(spark, d).where(F.col("categoria").isin(a, b))
    g = v.groupBy("categoria").agg(F.count("*").alias("n"), F.floor(F.count_if("dolor") * 1000 / F.count("*")).alias("dolor"), F.floor(F.count_if("cambio") * 1000 / F.count("*")).alias("cambio"), F.floor(F.sum("icp") * 100 / F.count("*")).alias("icp"))
    long = g.select("categoria", F.explode(F.array(*[F.struct(F.lit(c).alias("medida"), F.col(c).alias("valor")) for c in ("n", "dolor", "cambio", "icp")])).alias("x")).select("categoria", "x.*")
    side = lambda c: F.coalesce(F.max(F.when(F.col("categoria") == c, F.col("valor"))), zero())
    return long.groupBy("medida").agg(side(a).alias("a"), side(b).alias("b")).select("medida", "a", "b", (F.col("a") - F.col("b")).alias("delta"))


def compare_sets(spark, d, a: str = "Startup", b: str = "Corporativo"):
    """Hypotheses, patterns and signals of two categories: counts, and whether they are common or stand on one side only."""
    v = build(spark, d).where(F.col("categoria").isin(a, b))
    things = F.concat(
        F.when(F.col("hipotesis") != "", F.array(F.struct(F.lit("dolor").alias("clase"), F.col("hipotesis").alias("valor")))).otherwise(F.array().cast("array<struct<clase:string,valor:string>>")),
        F.transform(F.array_distinct("patrones"), lambda p: F.struct(F.lit("patron").alias("clase"), p.alias("valor"))), F.transform("tags", lambda t: F.struct(F.lit("senal").alias("clase"), t.alias("valor"))),
    )
    g = v.select("categoria", F.explode(things).alias("x")).groupBy("x.clase", "x.valor").agg(F.count_if(F.col("categoria") == a).alias("a"), F.count_if(F.col("categoria") == b).alias("b"))
    return g.withColumn("lado", F.when((F.col("a") > 0) & (F.col("b") > 0), "comun").when(F.col("a") > 0, "solo_a").otherwise("solo_b"))


def compare_neighbours(spark, d):
    """Each organisation against the next one by name: fields that are equal, signals in common and on one side, differences of the validation."""
    b = positions(battery(spark, d).select(F.lit("").alias("g"), "org", "clase", "hipotesis", "intensidad", "vertical", "viabilidad", "icp", "tags", "solidez", "suficiencia", "veredicto"), "g", ["org"], "p").drop("g")
    other = b.select((F.col("p") - 1).alias("p"), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "p"])
    j = b.join(other, "p")
    same = sum((F.col(c).eqNullSafe(F.col(f"{c}_b")).cast("long") for c in ("clase", "hipotesis", "intensidad", "vertical", "viabilidad")), zero())
    return j.select(
        "org", F.col("org_b").alias("otra"), same.alias("iguales"), joined(F.array_sort(F.array_intersect("tags", "tags_b"))).alias("comunes"), joined(F.array_sort(F.array_except("tags", "tags_b"))).alias("solo_a"),
        joined(F.array_sort(F.array_except("tags_b", "tags"))).alias("solo_b"), (F.col("veredicto") == F.col("veredicto_b")).alias("mismo_veredicto"), (F.col("solidez") - F.col("solidez_b")).alias("delta_solidez"), (F.col("suficiencia") - F.col("suficiencia_b")).alias("delta_suficiencia"),
    )


def org_matrix(spark, d):
    """Organisations by dimensions, wide."""
    return build(spark, d).select("org", "clase", "icp", "hipotesis", "intensidad", "n", "profundidad", F.size("patrones").cast("long").alias("patrones"))


def period_kinds(spark, d, cut: str = "2024-06-01"):
    """Kinds of events of each organisation before a date and after it, undated ones after."""
    after = F.col("fecha").isNull() | (F.col("fecha") >= cut)
    return items(spark, d).where("org is not null and tipo <> ''").groupBy("org", F.when(after, "despues").otherwise("antes").alias("lado"), "tipo").agg(F.count("*").alias("n"))


def synthesis(spark, d):
    """Structural synthesis of each organisation: state, leading behaviour by weighted vote (two per signal, one per event, ties by precedence), and the first tense evidence by confidence and text."""
    i = items(spark, d).where("org is not null and texto <> ''")
    tags = F.array_intersect("tags", F.array(*[F.lit(t) for t in L.SIGNALS]))
    i = i.withColumn("tags", tags)
    of_tag, of_event = (F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]) for m in (L.BEHAVIOUR_OF_SIGNAL, L.BEHAVIOUR_OF_EVENT))
    ballots = F.concat(F.transform("tags", lambda t: F.struct(F.element_at(of_tag, t).alias("c"), F.lit(2).alias("w"))), F.when(F.col("tipo").isin(*L.EVENT_TYPES), F.array(F.struct(of_event[F.col("tipo")].alias("c"), F.lit(1).alias("w")))).otherwise(F.array().cast("array<struct<c:string,w:int>>")))
    order = list(dict.fromkeys([*L.BEHAVIOUR_OF_SIGNAL.values(), *L.BEHAVIOUR_OF_EVENT.values()]))
    votes = i.select("org", F.explode(ballots).alias("x")).groupBy("org", "x.c").agg(F.sum("x.w").alias("w"))
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("c"))
    top = votes.groupBy("org").agg(F.max(F.struct("w", (-place).alias("o"), "c"))["c"].alias("patron"))
    tense = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in L.TENSE_SIGNALS])) | F.col("tipo").isin(*L.TENSE_EVENTS)
    g = i.groupBy("org").agg(F.count("*").alias("n"), F.min(F.when(tense, F.struct((-F.col("confianza_cent")).alias("o"), "texto", "id"))).alias("t"))
    state = F.when(F.col("n") < 3, "insuficiente").when(F.col("patron").isNull(), "sin_marcador").otherwise("sintetizado")
    return g.join(top, "org", "left").select("org", "n", state.alias("estado"), "patron", F.col("t").isNotNull().alias("tension"), F.substring("t.texto", 1, 280).alias("cita"))


def grounding(spark, d):
    """Literal phrases of the signals that the evidence carries, per row: what the tags rest on."""
    low = F.lower(F.col("texto"))
    table = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(p).alias("frase")) for t, ps in L.SIGNALS.items() for p in ps])
    hits = F.filter(table, lambda r: F.array_contains("tags", r["tag"]) & F.contains(low, r["frase"]))
    return items(spark, d).select("id", F.explode(hits).alias("r")).groupBy("r.tag", "r.frase").agg(F.count("*").alias("n"))


def address_counts(spark, d):
    """Distinct addresses behind each organisation, and the first one by confidence and text."""
    i = items(spark, d).where("org is not null and url <> ''").groupBy("org", "url").agg(F.min(F.struct((-F.col("confianza_cent")).alias("o"), "texto", "id")).alias("m"))
    return i.groupBy("org").agg(F.count("*").alias("direcciones"), F.min(F.struct("m", "url"))["url"].alias("primera"))


_j = lambda c: f"array_to_string({c}, '|')"
_points = "CAST(CASE clase WHEN 'A' THEN 400 WHEN 'B' THEN 200 ELSE 50 END + 3 * icp + 15 * least(n, 20) + 50 * len(patrones) + CASE WHEN hipotesis <> '' THEN 100 ELSE 0 END + CASE WHEN secundaria <> '' THEN 30 ELSE 0 END + CASE intensidad WHEN 'Alta' THEN 100 WHEN 'Media' THEN 50 ELSE 0 END AS BIGINT)"
_motives = _j(listed(("clase IN ('A', 'B')", "'clase_' || clase"), ("n >= 2", "CASE WHEN n >= 5 THEN 'volumen_alto' ELSE 'volumen' END"), ("hipotesis <> ''", "'hipotesis'"), ("intensidad = 'Alta'", "'intensidad_alta'"), ("len(patrones) > 0", "'patrones'"), ("icp >= 50", "CASE WHEN icp >= 70 THEN 'interes_alto' ELSE 'interes_medio' END")))
_conf = "CASE nivel WHEN 'I' THEN 'Alta' WHEN 'II' THEN 'Media' ELSE 'Baja' END"
_action = "CASE WHEN clase = 'A' AND icp >= 50 THEN 'profundizar' WHEN clase = 'A' THEN 'corroborar' WHEN clase = 'B' AND icp >= 40 THEN 'vigilar' ELSE 'observar' END"
_reasons = listed(("clase = 'A' AND intensidad = 'Alta'", "'dolor_intenso'"), ("hipotesis <> '' AND secundaria <> ''", "'dos_hipotesis'"), ("n >= 5", "'evidencias_acumuladas'"), ("len(patrones) >= 2", "'patrones_convergentes'"))
_deuda = "CASE WHEN hipotesis = '' THEN 'sin_deuda' ELSE hipotesis END"
_vert = "CASE WHEN vertical = '' THEN 'sin_vertical' ELSE vertical END"
_only_sql = lambda names: f"array_to_string(list_sort(list_filter(tags, lambda x: x IN ({quoted(names)}))), '|')"
_has = lambda t: f"list_contains(tags, '{t}')"
_outliers = f"""o AS (SELECT b.org, b.icp, b.hipotesis, {listed(("s.q * s.k - s.s * s.s > 0 AND (b.icp * s.k - s.s) * (b.icp * s.k - s.s) > s.q * s.k - s.s * s.s", "'interes_desviado'"), ("h.iguales = 1", "'hipotesis_unica'"), ("b.profundidad >= 70 AND b.n <= 1", "'profundidad_sin_volumen'"))} AS r
  FROM d b LEFT JOIN (SELECT hipotesis, count(*) AS iguales FROM d WHERE hipotesis <> '' GROUP BY 1) h USING (hipotesis), (SELECT CAST(sum(icp) AS BIGINT) AS s, CAST(sum(icp * icp) AS BIGINT) AS q, count(*) AS k FROM d) s)"""


def _risks() -> str:
    from tamiz.plans.temporal import _profile_sql, _series_sql

    serie = _series_sql.replace(ITEMS + ", ", "")
    # the profile's own selection is kept as one more step
    steps, final = _profile_sql.rsplit("\n  SELECT clave", 1)
    return f"""WITH {VALIDATED}, {serie} {steps.replace(", x1", ", x1", 1).replace("v AS", "v AS")}, perfil AS (SELECT clave{final}), tipos AS (SELECT org, count(DISTINCT coalesce(tipo, '')) AS tipos FROM items WHERE org IS NOT NULL GROUP BY 1),
      r0 AS (SELECT v.org, v.hipotesis, CAST(round_even(least(100.0, v.profundidad * CAST(0.5 AS DOUBLE) + v.ndolor * 15 + CASE WHEN v.bloqueada THEN 10 ELSE 0 END), 0) AS BIGINT) AS cultural,
        CAST(round_even(least(100.0, (7 * coalesce(s.volatilidad, 0) + 50 * t.tipos) / 10.0), 0) AS BIGINT) AS narrativo FROM v LEFT JOIN perfil s ON s.clave = v.org JOIN tipos t ON t.org = v.org),
      r1 AS (SELECT *, CAST(round_even((cultural + narrativo) / 2.0, 0) AS BIGINT) AS global FROM r0), r AS (SELECT *, CASE WHEN global >= 66 THEN 'alto' WHEN global >= 33 THEN 'medio' ELSE 'bajo' END AS nivel FROM r1)"""


_order = list(dict.fromkeys([*L.BEHAVIOUR_OF_SIGNAL.values(), *L.BEHAVIOUR_OF_EVENT.values()]))
_case = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
QUERIES = {
    "composite_score": (composite_score, f"WITH {DOSSIERS} SELECT org, {_points} AS puntos10, {_motives} AS motivos FROM d"),
    "ranking_topn": (ranking, f"WITH {VALIDATED}, p AS (SELECT *, {_points} AS puntos10 FROM v) SELECT row_number() OVER (ORDER BY puntos10 DESC, org) AS posicion, org, puntos10, CASE WHEN puntos10 >= 600 THEN 'Alta' WHEN puntos10 >= 350 THEN 'Media' ELSE 'Baja' END AS prioridad, {_motives} AS motivos, n, hipotesis, {_conf} AS nivel_confianza, veredicto FROM p ORDER BY puntos10 DESC, org LIMIT {TOP}"),
    "priorities": (priorities, f"WITH {VALIDATED}, p AS (SELECT *, {_points} AS puntos10, list_position([{quoted(L.VERDICTS)}], veredicto) AS peso FROM v) SELECT row_number() OVER (ORDER BY peso, puntos10 DESC, org) AS posicion, org, veredicto, puntos10 FROM p ORDER BY 1 LIMIT {TOP}"),
    "opportunities": (opportunities, f"WITH {VALIDATED} SELECT org, hipotesis, veredicto, solidez, n, nivel, {_conf} AS nivel_confianza, icp FROM v WHERE NOT bloqueada AND veredicto IN ('VALIDADA', 'VALIDADA_PARCIAL') ORDER BY icp DESC, org LIMIT {TOP}"),
    "alerts": (alerts, f"WITH {DOSSIERS}, a AS (SELECT *, {_reasons} AS razones FROM d) SELECT org, clase, hipotesis, intensidad, {_j('razones')} AS razones, {_action} AS accion FROM a WHERE len(razones) > 0 ORDER BY org LIMIT 20"),
    "suggested_actions": (suggested_actions, f"WITH {DOSSIERS} SELECT org, {_action} AS accion FROM d"),
    "findings": (findings, f"""WITH {DOSSIERS}, x AS (SELECT 'senales_frecuentes' AS tipo, unnest(tags) AS clave, 5 AS tope FROM d UNION ALL SELECT 'dolor_ecosistema', '', 1 FROM d WHERE dolor UNION ALL SELECT 'cambio_ecosistema', '', 1 FROM d WHERE cambio
        UNION ALL SELECT 'deuda_dominante', hipotesis, 3 FROM d WHERE hipotesis <> '' UNION ALL SELECT 'concentracion_vertical', vertical, 3 FROM d WHERE vertical <> ''), g AS (SELECT tipo, clave, tope, count(*) AS n FROM x GROUP BY ALL)
        SELECT tipo, clave, n, CAST(round_even(100 * n / (SELECT count(*) FROM d), 0) AS BIGINT) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY tipo ORDER BY n DESC, clave) AS r FROM g) WHERE r <= tope AND (tipo <> 'concentracion_vertical' OR n > 1)"""),
    "central_hypothesis": (central_hypothesis, f"WITH {DOSSIERS}, h AS (SELECT hipotesis, count(*) AS n FROM d WHERE hipotesis <> '' GROUP BY 1 ORDER BY n DESC, hipotesis LIMIT 1), p AS (SELECT *, (SELECT count(*) FROM d) AS organizaciones FROM h), q AS (SELECT *, CAST(round_even(100 * n / organizaciones, 0) AS BIGINT) AS pct FROM p) SELECT *, CASE WHEN pct >= 40 THEN 'alta' WHEN pct >= 20 THEN 'media' ELSE 'baja' END AS confianza FROM q"),
    "risks": (risks, f"{_risks()} SELECT * FROM r"),
    "risk_histogram": (risk_histogram, f"{_risks()} SELECT nivel, count(*) AS n FROM r GROUP BY 1"),
    "cultural_risks_topk": (cultural_risks, f"{_risks()} SELECT org, hipotesis, global, nivel FROM r ORDER BY global DESC, org LIMIT {TOP}"),
    "eco_maturity": (eco_maturity, f"WITH {ITEMS}, m AS (SELECT org, CAST(floor(40.0 * least(count(*), 6) / 6 + 30.0 * least(count(DISTINCT nullif(medio, '')), 4) / 4 + 30.0 * least(count(DISTINCT substring(fecha, 1, 7)), 6) / 6 + 0.5 + 1e-9) AS BIGINT) AS puntos FROM items WHERE org IS NOT NULL GROUP BY org), n AS (SELECT *, CASE WHEN puntos >= 75 THEN 'maduro' WHEN puntos >= 50 THEN 'consolidado' WHEN puntos >= 25 THEN 'en_desarrollo' ELSE 'naciente' END AS nivel FROM m) SELECT nivel, count(*) AS n, CAST(floor(sum(puntos) * 10 / count(*)) AS BIGINT) AS media10 FROM n GROUP BY 1"),
    "tension_class": (tension, f"""WITH {DOSSIERS}, a AS (SELECT count(*) AS n, count(*) FILTER (dolor) AS con_dolor, count(*) FILTER (cambio) AS con_cambio, count(*) FILTER (dolor AND cambio) AS convergentes, count(*) FILTER (clase = 'A') AS clase_a FROM d)
        SELECT n, con_dolor, con_cambio, convergentes, CASE WHEN n = 0 THEN 'estancamiento' WHEN 5 * con_dolor >= n AND 5 * con_cambio >= n THEN 'dolor_y_crecimiento' WHEN 5 * con_dolor >= n THEN 'dolor_dominante' WHEN 5 * con_cambio >= n THEN 'crecimiento_dominante' ELSE 'estancamiento' END AS tension,
        CASE WHEN convergentes >= 2 THEN 'observar_convergentes' WHEN clase_a >= 3 THEN 'peritaje' WHEN con_dolor > 0 THEN 'ampliar_dolor' WHEN n > 0 THEN 'vigilar_cambio' ELSE 'ampliar_captura' END AS paso FROM a"""),
    "convergences_top": (convergences, f"""WITH {DOSSIERS} SELECT org, icp, hipotesis, {_only_sql(L.PAIN)} AS senales_dolor, {_only_sql(L.CHANGE)} AS senales_cambio, CASE WHEN {_has('friccion_retencion')} AND {_has('crecimiento')} THEN 'crece_y_pierde' WHEN {_has('reduccion_personal')} AND {_has('ronda_inversion')} THEN 'capital_y_recorte'
        WHEN {_has('friccion_retencion')} AND {_has('expansion')} THEN 'expande_y_friccion' WHEN {_has('cierre_operaciones')} THEN 'cierra_y_mueve' WHEN {_has('regulacion')} THEN 'regulacion_y_cambio' ELSE 'cruzadas' END AS lectura FROM d WHERE dolor AND cambio ORDER BY icp DESC, org LIMIT 5"""),
    "curated_orgs": (curated, f"WITH {DOSSIERS}, t AS (SELECT *, CASE clase WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS grupo FROM d ORDER BY grupo, icp DESC, n DESC, org LIMIT 5) SELECT org, clase, icp, n, hipotesis, viabilidad, {_only_sql(L.PAIN)} AS senales_dolor, {_only_sql(L.CHANGE)} AS senales_cambio FROM t WHERE grupo <= 1 OR (SELECT min(grupo) FROM t) > 1"),
    "observed_orgs": (observed, f"""WITH {DOSSIERS}, m AS (SELECT org, count(DISTINCT medio) AS medios FROM items WHERE org IS NOT NULL AND medio <> '' GROUP BY 1) SELECT d.org, CASE WHEN viabilidad = 'alta' AND intensidad = 'Alta' THEN 'Crítica' WHEN viabilidad = 'alta' THEN 'Alta' WHEN viabilidad = 'media' THEN 'Media' ELSE '' END AS alerta,
        CASE WHEN coalesce(m.medios, 0) >= 3 THEN 'Sólida' WHEN m.medios = 2 THEN 'Moderada' ELSE 'Débil' END AS consistencia, CASE WHEN mejor_cent >= 80 THEN 'Alta' WHEN mejor_cent >= 50 THEN 'Media' ELSE 'Baja' END AS calidad_evidencia, list_has_any(eventos, ['contratacion', 'cambio_sitio', 'ronda']) AS operativa,
        list_has_any(eventos, ['queja', 'lanzamiento', 'despido']) AS narrativa, regexp_replace(hipotesis, '^Deuda ', '') AS subtipo, upper(viabilidad[1]) || viabilidad[2:] AS viabilidad FROM d LEFT JOIN m USING (org)"""),
    "narrative_drift": (narrative_drift, f"WITH {ITEMS} SELECT org, tipo, count(*) AS n, max(fecha) AS ultima FROM items WHERE org IS NOT NULL AND tipo IN ('queja', 'lanzamiento', 'despido') GROUP BY 1, 2"),
    "dense_ids": (dense_ids, f"WITH {DOSSIERS} SELECT org, row_number() OVER (ORDER BY org) - 1 AS org_id FROM d"),
    "clusters": (clusters, f"""WITH {DOSSIERS}, b AS (SELECT {_deuda} AS deuda, {_vert} AS vertical, org, tags FROM d), g AS (SELECT deuda, vertical, count(*) AS tamano, min(org) AS primera, max(org) AS ultima FROM b GROUP BY 1, 2 HAVING count(*) >= 2),
        t AS (SELECT deuda, vertical, tag, count(*) AS n FROM (SELECT deuda, vertical, unnest(tags) AS tag FROM b) GROUP BY ALL), s AS (SELECT deuda, vertical, string_agg(tag, '|' ORDER BY n DESC, tag) AS senales FROM (SELECT *, row_number() OVER (PARTITION BY deuda, vertical ORDER BY n DESC, tag) AS r FROM t) WHERE r <= 5 GROUP BY 1, 2)
        SELECT g.*, coalesce(s.senales, '') AS senales FROM g LEFT JOIN s USING (deuda, vertical)"""),
    "outliers_sigma": (outliers, f"WITH {DOSSIERS}, {_outliers} SELECT org, icp, hipotesis, {_j('r')} AS razones FROM o WHERE len(r) > 0"),
    "org_context": (context, f"""WITH {DOSSIERS}, {_outliers}, b AS (SELECT d.org, {_deuda.replace('hipotesis', 'd.hipotesis')} AS deuda, vertical, dolor AND profundidad >= 70 AND n <= 2 AS centinela, len(o.r) > 0 AS atipica FROM d JOIN o USING (org)),
        g AS (SELECT deuda, vertical, count(*) AS tamano, count(*) FILTER (centinela) AS centinelas, count(*) FILTER (atipica) AS atipicas FROM b GROUP BY 1, 2 HAVING count(*) >= 2) SELECT b.org, coalesce(g.tamano, 0) AS tamano, coalesce(g.centinelas, 0) AS centinelas, coalesce(g.atipicas, 0) AS atipicas FROM b LEFT JOIN g USING (deuda, vertical)"""),
    "segment_indicators": (segments, f"WITH {VALIDATED}, c AS (SELECT * REPLACE (coalesce(categoria, '') AS categoria) FROM v) SELECT categoria, vertical, CAST(grouping(categoria, vertical) AS BIGINT) AS nivel, count(*) AS n, count(*) FILTER (dolor) AS con_dolor, count(*) FILTER (cambio) AS con_cambio, count(*) FILTER (bloqueada) AS bloqueadas, CAST(floor(sum(icp) * 100 / count(*)) AS BIGINT) AS icp100 FROM c GROUP BY GROUPING SETS ((categoria, vertical), (categoria), (vertical), ())"),
    "segment_mix": (segment_mix, f"WITH {DOSSIERS} SELECT coalesce(categoria, '') AS categoria, campo, valor, count(*) AS n FROM (SELECT categoria, 'clase' AS campo, clase AS valor FROM d UNION ALL SELECT categoria, 'hipotesis', hipotesis FROM d UNION ALL SELECT categoria, 'vertical', vertical FROM d) WHERE valor <> '' GROUP BY ALL"),
    "compare_ecosystems": (compare_ecosystems, f"""WITH {DOSSIERS}, g AS (SELECT categoria, count(*) AS n, CAST(floor(count(*) FILTER (dolor) * 1000 / count(*)) AS BIGINT) AS dolor, CAST(floor(count(*) FILTER (cambio) * 1000 / count(*)) AS BIGINT) AS cambio, CAST(floor(sum(icp) * 100 / count(*)) AS BIGINT) AS icp FROM d WHERE categoria IN ('Startup', 'Corporativo') GROUP BY 1),
        l AS (UNPIVOT g ON n, dolor, cambio, icp INTO NAME medida VALUE valor), s AS (SELECT medida, coalesce(max(valor) FILTER (categoria = 'Startup'), 0) AS a, coalesce(max(valor) FILTER (categoria = 'Corporativo'), 0) AS b FROM l GROUP BY 1) SELECT *, a - b AS delta FROM s"""),
    "compare_sets": (compare_sets, f"""WITH {DOSSIERS}, e AS (SELECT * FROM d WHERE categoria IN ('Startup', 'Corporativo')), x AS (SELECT categoria, 'dolor' AS clase, hipotesis AS valor FROM e WHERE hipotesis <> '' UNION ALL SELECT categoria, 'patron', unnest(list_distinct(patrones)) FROM e UNION ALL SELECT categoria, 'senal', unnest(tags) FROM e),
        g AS (SELECT clase, valor, count(*) FILTER (categoria = 'Startup') AS a, count(*) FILTER (categoria = 'Corporativo') AS b FROM x GROUP BY 1, 2) SELECT *, CASE WHEN a > 0 AND b > 0 THEN 'comun' WHEN a > 0 THEN 'solo_a' ELSE 'solo_b' END AS lado FROM g"""),
    "compare_neighbours": (compare_neighbours, f"""WITH {VALIDATED}, p AS (SELECT *, row_number() OVER (ORDER BY org) AS p FROM v) SELECT a.org, b.org AS otra, CAST(a.clase = b.clase AS BIGINT) + CAST(a.hipotesis = b.hipotesis AS BIGINT) + CAST(a.intensidad = b.intensidad AS BIGINT) + CAST(a.vertical = b.vertical AS BIGINT) + CAST(a.viabilidad = b.viabilidad AS BIGINT) AS iguales,
        array_to_string(list_sort(list_filter(a.tags, lambda x: list_contains(b.tags, x))), '|') AS comunes, array_to_string(list_sort(list_filter(a.tags, lambda x: NOT list_contains(b.tags, x))), '|') AS solo_a, array_to_string(list_sort(list_filter(b.tags, lambda x: NOT list_contains(a.tags, x))), '|') AS solo_b,
        a.veredicto = b.veredicto AS mismo_veredicto, a.solidez - b.solidez AS delta_solidez, a.suficiencia - b.suficiencia AS delta_suficiencia FROM p a JOIN p b ON b.p = a.p + 1"""),
    "org_matrix": (org_matrix, f"WITH {DOSSIERS} SELECT org, clase, icp, hipotesis, intensidad, n, profundidad, len(patrones) AS patrones FROM d"),
    "period_kinds": (period_kinds, f"WITH {ITEMS} SELECT org, CASE WHEN fecha IS NULL OR fecha >= '2024-06-01' THEN 'despues' ELSE 'antes' END AS lado, tipo, count(*) AS n FROM items WHERE org IS NOT NULL AND tipo <> '' GROUP BY ALL"),
    "synthesis": (synthesis, f"""WITH {ITEMS}, i AS (SELECT * REPLACE (list_filter(tags, lambda x: x IN ({quoted(L.SIGNALS)})) AS tags) FROM items WHERE org IS NOT NULL AND texto <> ''), b AS (SELECT org, {_case('tag', L.BEHAVIOUR_OF_SIGNAL)} AS c, 2 AS w FROM (SELECT org, unnest(list_distinct(tags)) AS tag FROM i) UNION ALL SELECT org, {_case('tipo', L.BEHAVIOUR_OF_EVENT)}, 1 FROM i WHERE tipo IN ({quoted(L.EVENT_TYPES)})),
        s AS (SELECT org, c, sum(w) AS w FROM b GROUP BY 1, 2), t AS (SELECT org, c AS patron FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY w DESC, list_position([{quoted(_order)}], c)) AS r FROM s) WHERE r = 1),
        g AS (SELECT org, count(*) AS n, arg_min(texto, (-confianza_cent, texto, id)) FILTER (list_has_any(tags, [{quoted(L.TENSE_SIGNALS)}]) OR tipo IN ({quoted(L.TENSE_EVENTS)})) AS cita FROM i GROUP BY 1)
        SELECT org, n, CASE WHEN n < 3 THEN 'insuficiente' WHEN patron IS NULL THEN 'sin_marcador' ELSE 'sintetizado' END AS estado, patron, cita IS NOT NULL AS tension, substring(cita, 1, 280) AS cita FROM g LEFT JOIN t USING (org)"""),
    "grounding": (grounding, f"WITH {ITEMS} SELECT r.tag, r.frase, count(*) AS n FROM items, (VALUES " + ", ".join(f"({quoted([t])}, {quoted([p])})" for t, ps in L.SIGNALS.items() for p in ps) + ") r(tag, frase) WHERE list_contains(tags, r.tag) AND contains(lower(texto), r.frase) GROUP BY 1, 2"),
    "address_counts": (address_counts, f"WITH {ITEMS} SELECT org, count(DISTINCT url) AS direcciones, arg_min(url, (-confianza_cent, texto, id, url)) AS primera FROM items WHERE org IS NOT NULL AND url <> '' GROUP BY 1"),
}
