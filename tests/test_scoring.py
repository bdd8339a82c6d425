"""Scoring, validation, capture pipeline and fingerprints against golden values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions import text as T
from tamiz.operators import capture as C
from tamiz.operators import drift as D
from tamiz.operators import governance as G
from tamiz.operators.dossier import dossiers, reproduced, validated, with_hypothesis
from tamiz.operators.history import failure_runs

CASES = [
    (["friccion_retencion"], "fintech", 85, "Alta", dict(clase="A", hipotesis="Deuda Relacional", profundidad=100, icp=98, intensidad="Alta", viabilidad="alta")),
    (["reduccion_personal"], "edtech", 60, "Media", dict(clase="A", hipotesis="Deuda Moral", decisor="Director/a de RRHH / People")),
    (["ronda_inversion"], "fintech", 70, "Media", dict(clase="B", hipotesis="Deuda de Escalamiento", profundidad=38, viabilidad="media")),
    ([], "", 40, "Baja", dict(clase="C", hipotesis="", viabilidad="descartable", profundidad=0, icp=14, decisor="CEO / Fundador/a")),
    (["ronda_inversion", "reduccion_personal"], "", 90, "Alta", dict(clase="A", hipotesis="Deuda de Escalamiento mal gestionado")),
    (["crecimiento", "friccion_retencion"], "fintech", 80, "Alta", dict(clase="A", hipotesis="Deuda de Experiencia en escala")),
    (["reduccion_personal", "regulacion"], "", 0, "Baja", dict(clase="A", hipotesis="Deuda Moral", secundaria="Deuda de Gobernanza")),
    (["friccion_retencion", "reduccion_personal"], "", 50, "Baja", dict(clase="A", hipotesis="Deuda Relacional", intensidad="Alta")),
    (["reduccion_personal"], "hrtech", 25, "Baja", dict(profundidad=100)), (["cierre_operaciones"], "fintech", 45, "Baja", dict(profundidad=100)), (["expansion"], "logística agrícola", 55, "Baja", dict(profundidad=39)),
]


def test_scoring(spark):
    df = spark.createDataFrame([(k, t, v, c, q) for k, (t, v, c, q, _) in enumerate(CASES)], "k int, tags array<string>, vertical string, mejor_cent long, calidad string")
    got = {r.k: r for r in with_hypothesis(df).collect()}
    for k, case in enumerate(CASES):
        for name, value in case[4].items():
            assert got[k][name] == value, (case, name, got[k][name])


ITEM = "org string, id long, fuente string, fecha string, confianza_cent long, tags array<string>, tipo string, categoria string, calidad string"


def test_validation(spark):
    tags = ["friccion_retencion", "crecimiento"]
    rows = [("a", k, f"m{k}.example", "2024-01-01", 80, tags, "queja", "Startup", "Alta") for k in range(4)]
    rows += [("b", 10 + k, "", None, 50, ["reduccion_personal", "expansion"], t, None, "Baja") for k, t in enumerate(("despido", "contratacion"))]
    entities = spark.createDataFrame([("a", "fintech")], "org string, vertical string")
    d = {r.org: r for r in validated(dossiers(spark.createDataFrame(rows, ITEM), entities)).collect()}
    a, b = d["a"], d["b"]
    assert (a.confianza, a.suficiencia, a.vacios, a.contradicciones, a.nivel, a.bloqueada, a.veredicto) == (0.9984, 97, [], [], "I", False, "VALIDADA")
    # 25*4/6 + 20 + 7.5 + 20 (depth 100 by the vertical) + 20*.9984
    assert a.solidez == round(25 * 4 / 6 + 20 + 7.5 + 20 + 20 * 0.9984)
    assert (b.fuentes, b.confianza) == (0, 0.75)  # rows without a source are each their own, and none counts
    assert b.contradicciones == ["dolor_y_crecimiento_sin_patron", "eventos_opuestos"]
    assert b.vacios == ["sin_vertical", "fuente_unica", "corpus_escaso", "evidencia_sin_fecha", "sin_convergencia"] and b.veredicto == "BLOQUEADA"
    declared = dossiers(spark.createDataFrame(rows, ITEM)).withColumn("hipotesis", F.when(F.col("org") == "b", "otra").otherwise(F.col("hipotesis")))
    assert {r.org: r.discrepancias for r in reproduced(declared).collect()} == {"a": [], "b": ["hipotesis"]}


@pytest.mark.parametrize(
    "title,name",
    [("Nubank anuncia nueva ronda de inversión", "Nubank"), ("La fintech Clara levanta capital serie B", "Clara"), ("BBVA lanza un nuevo producto", "BBVA"), ("las startups enfrentan un año difícil", None), ("El País - Reforma", None), (None, None), ("", None), ("México y BQ crecen", "BQ")],
)
def test_detected_company(spark, title, name):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(T.detected_company(F.col("t"), L.CAPITALISED, L.SECTOR_WORDS).alias("c")).first().c == name


POOL = {
    "E1": ("Zuvara adquiere una fintech de cobros - Diario Uno", "Diario Uno", "2024-07-01"), "E1r": ("Zuvara adquiere una fintech de cobros - Gaceta Dos", "Gaceta Dos", "2024-07-01"), "E2": ("Plicle prepara despidos y reestructura - Gaceta Dos", "Gaceta Dos", "2024-07-02"),
    "E3": ("Kemar cierra operaciones en un mercado - Tres", "Tres", "2024-07-03"), "E4": ("Bener firma una alianza con un banco - Uno", "Uno", "2024-07-04"), "E5": ("La fintech Farcar levanta capital - Cuatro", "Cuatro", None), "E6": ("Tofer duplica ingresos", "Google News", "2024-07-05"),
    "O1": ("Opinión: las fintech van a caer - Columna", "X", "2024-07-01"), "O2": ("5 claves sobre el churn - Blog", "Y", "2024-07-01"), "O3": ("El futuro de la banca - Nota", "Z", "2024-07-01"), "S1": ("Las startups temen despidos - Nota", "W", "2024-07-01"),
    "S2": ("El sector fintech vive una ola de quiebra - Nota", "V", "2024-07-01"), "N1": ("Zuvara celebra su aniversario - Nota", "U", "2024-07-01"), "N2": ("Bener participa en un foro de datos - Nota", "T", "2024-07-01"),
}
ORDER = "E1 E1r O3 S2 N1 N2 E6 E2 E3 O1 S1 N1 E1 O2 E4 E5 S1".split()


def test_capture_pipeline(spark):
    rows = [(k, POOL[n][0], f"https://n.example/{n}", POOL[n][1], POOL[n][2], "2024-07-09T00:00:00+00:00", "", "queja", "prensa", n) for k, n in enumerate(ORDER)]
    df = spark.createDataFrame(rows, "id long, cita_textual string, url_fuente string, nombre_medio string, fecha_publicacion string, fecha_extraccion string, empresa_mencionada string, tipo_evento string, origen_declaracion string, clave_propia string")
    out = C.captured(df, exact=False)
    got = sorted((r.id, r.clave_propia, r.resultado, r.motivo, r.calidad) for r in out.collect())
    kinds = [r[2] for r in got]
    assert (len(got), kinds.count("escrito"), kinds.count("duplicado"), kinds.count("filtrado"), kinds.count("rechazado")) == (17, 6, 2, 9, 0)
    kept = {n: (m, q) for _, n, k, m, q in got if k == "escrito"}
    assert set(kept) == {"E1", "E2", "E3", "E4", "E5", "E6"} and kept["E5"][0] == "no_fechado"
    assert [n for n, (_, q) in kept.items() if q == "Media"] == ["E6"] and sum(q == "Alta" for _, q in kept.values()) == 5
    q = {r.clave_propia: (r.motivo, r.payload_json) for r in C.quarantined(out).collect()}
    assert q["O1"][0] == "relevancia:opinion" and '"url_fuente":"https://n.example/O1"' in q["O1"][1]
    # the same records again: nothing new
    again = C.captured(df, exact=False, stored=out.where("resultado = 'escrito'").select("hash_dedup"))
    assert again.where("resultado = 'escrito'").select("clave_propia").distinct().count() == 1  # the republication, whose first form is stored
    assert C.captured(df.limit(0), exact=True).count() == 0


def test_hash_tree_and_fingerprints(spark):
    hs = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)]
    df = spark.createDataFrame([("a", h) for h in hs] + [("b", hs[0]), ("b", hs[0])], "org string, h string")
    sha = lambda xs: hashlib.sha256("|".join(xs).encode()).hexdigest()

    def root(digests):
        level = sorted((h[:6], h) for h in digests)
        for size in (6, 3, 0):
            groups: dict[str, list[str]] = {}
            for p, h in sorted(level):
                groups.setdefault(p[:size], []).append(h)
            level = [(p, sha(x)) for p, x in groups.items()]
        return level[0][1]

    got = {r.org: (r.n, r.raiz) for r in G.hash_tree(df.repartition(7), ["org"], "h").collect()}
    assert got == {"a": (300, root(hs)), "b": (2, root([hs[0], hs[0]]))}
    assert G.taxonomy_hash() == G.taxonomy_hash() and len({h for _, _, h in G.component_versions()}) == 3


def test_drift_types(spark):
    cases = [("", "Ahora con pagos", 0.0, "concepto_nuevo"), ("Antes con pagos", "", 0.0, "concepto_eliminado"), ("Somos una casa", "Otra", 0.5, "identidad"), ("La plataforma", "El sitio", 0.9, "posicionamiento"), ("Todo para pymes", "Todo", 0.9, "audiencia"), ("abc", "xyz", 0.1, "cambio_ontologico"), ("abc d", "abc e", 0.8, "lenguaje")]
    df = spark.createDataFrame(cases, "a string, b string, r double, t string")
    assert all(x.t == x.g for x in df.select("t", D.change_type(F.col("a"), F.col("b"), F.col("r")).alias("g")).collect())
    s = spark.createDataFrame([(1, "o", "p", "ok", "línea uno\nlínea dos de prueba"), (2, "o", "p", "ok", "línea uno\nsomos otra cosa ahora"), (3, "o", "p", "ok", "Línea uno\nsomos otra cosa, ahora"), (4, "o", "p", "fallo", "")], "id long, org_nombre string, tipo_pagina string, estado_observable string, texto string")
    got = D.evidence(s).where("tipo_cambio = 'identidad'").collect()
    assert [(r.id, r.despues) for r in got] == [(2, "somos otra cosa ahora")]  # the third capture differs in form only
    assert D.evidence(s.limit(0)).count() == 0


def test_failure_runs_over_pieces(spark):
    import random

    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.random() < 0.3) for k in range(400)] + [(1000 + k, "c", False) for k in range(100)]
    got = {r.t: r.fallos_seguidos for r in failure_runs(spark.createDataFrame(rows, "t long, f string, ok boolean").repartition(5), "f", ["t"], F.col("ok")).collect()}
    streak: dict[str, int] = {}
    for t, f, ok in rows:
        streak[f] = 0 if ok else streak.get(f, 0) + 1
        assert got[t] == streak[f]
