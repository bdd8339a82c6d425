"""Core operators against brute force and golden values."""

import random

import pytest
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import history as H
from tamiz.operators import series as S
from tamiz.operators import tagging as G
from tamiz.operators.dossier import dossiers, validated
from tamiz.operators.ordering import positions


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url,out",
    [("HTTPS://Ex.COM/A/b/?q=1#z", "https://ex.com/A/b"), ("http://x.example///", "http://x.example"), (None, ""), ("", ""), ("nota/1?x", "nota/1")],
)
def test_normal_url(spark, url, out):
    assert one(spark, T.normal_url, url) == out


@pytest.mark.parametrize("title,out", [("¿Núbank crece? - El Diario", "nubank crece"), (" - Medio", "medio"), (None, ""), ("ÀÉ ñ", "ae n")])
def test_normal_title(spark, title, out):
    assert one(spark, T.normal_title, title) == out


def test_plain_text(spark):
    assert one(spark, T.plain_text, "<p>a&nbsp;&lt;b<script>x<y</script> c</p>") == "a <b c"
    assert one(spark, T.plain_text, None) == ""


def test_relevance_order(spark):
    cases = {
        "Opinión: el futuro de Nubank": "relevancia:opinion", "Wendy's abre su primera sucursal en Jalisco": "relevancia:gigante", "Venture Capital LATAM 2025: la inversión cae": "relevancia:no_empresa",
        "Promoción 2x1 por tiempo limitado": "relevancia:ruido_mediatico", "Nubank celebra su aniversario": "relevancia:sin_profundidad_estructural", "Konfío levanta una ronda serie C en México": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.m for r in df.select("t", G.relevance(F.col("t"), F.size(G.tags(F.col("t"))) > 0, F.lit(True)).alias("m")).collect()}
    assert got == cases


def test_rule_engine(spark):
    a = one(spark, G.rule_alert, "down round y hay que evangelizar al mercado, down round")
    assert (a.puntos, a.alerta) == (5.0, "Crítica")
    assert one(spark, G.rule_alert, None).puntos == 0.0


def item(org, k, source, date, conf, tags, kind):
    return (org, k, source, date, conf, tags, kind, None, "Alta")


ITEM = "org string, id long, fuente string, fecha string, confianza_cent long, tags array<string>, tipo string, categoria string, calidad string"


def test_dossier_and_validation(spark):
    rows = [item("a", k, f"m{k}", "2024-01-01", 80, ["friccion_retencion", "crecimiento"], "queja") for k in range(4)] + [item("b", 9, "m", None, 50, [], "ronda"), item(None, 10, "m", None, 50, None, "ronda")]
    d = {r.org: r for r in validated(dossiers(spark.createDataFrame(rows, ITEM))).collect()}
    a, b = d["a"], d["b"]
    assert (a.n, a.fuentes, a.confianza, a.clase, a.hipotesis, a.profundidad) == (4, 4, 0.9984, "A", "Deuda de Experiencia en escala", 90)
    assert (a.suficiencia, a.veredicto, a.nivel) == (97, "VALIDADA", "I")
    assert (b.clase, b.hipotesis, b.veredicto) == ("C", "", "SIN_HIPOTESIS") and set(d) == {"a", "b"}


def test_series_golden(spark):
    s = spark.createDataFrame([("x", "2026-01", 1), ("x", "2026-02", 2), ("x", "2026-04", 1), ("y", "2026-01", 5)], "clave string, periodo string, n long")
    p = {r.clave: r for r in S.profile(s).collect()}
    assert (p["x"].pendiente_mil, p["x"].estabilidad, p["x"].volatilidad, p["x"].giros) == (0, 65, 80, 1)
    assert (p["x"].base10, p["x"].alto10, p["x"].bajo10) == (10, 18, 2)
    assert (p["y"].estabilidad, p["y"].volatilidad) == (100, 0)
    assert [r.periodo for r in S.turning_points(s).collect()] == ["2026-02"]


def brute_accept(rows):
    seen, out = set(), []
    for o, a, b in sorted(rows):
        keys = {("a", a) if a else None, ("b", b) if b else None} - {None}
        if not keys & seen:
            out.append(o)
            seen |= keys
    return out


def test_accept_by_keys_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", None, *"abcdefgh"]), rng.choice(["", None, *"stuvwxyz"])) for k in range(60)]
    got = H.accept_by_keys(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"])
    assert sorted(r.id for r in got.collect()) == brute_accept(rows)
    assert H.accept_by_keys(spark.createDataFrame([], "id long, a string, b string"), "id", ["a", "b"]).count() == 0


def test_upsert_insert_versions_health(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "z")], "k string, x string, y string")
    new = spark.createDataFrame([("a", " ", "n"), ("c", "3", None)], "k string, x string, y string")
    got = {r.k: (r.x, r.y, r.accion) for r in H.coalescing_upsert(old, new, "k", ["x", "y"]).collect()}
    assert got == {"a": ("1", "n", "actualizado"), "b": ("2", "z", "igual"), "c": ("3", None, "insertado")}
    n = spark.createDataFrame([("h", 1), ("h", 2), ("g", 3), (None, 4)], "k string, o long")
    assert [r.o for r in H.insert_if_absent(n, spark.createDataFrame([("g",)], "k string"), "k", "o").collect()] == [1]
    s = spark.createDataFrame([(k, "o", h) for k, h in enumerate("aabbab")], "i long, org string, h string")
    assert [(r.i, r.version, r.hash_previo) for r in H.versions(s, ["org"], ["i"], "h").orderBy("i").collect()] == [(0, 1, None), (2, 2, "a"), (4, 3, "b"), (5, 4, "a")]
    r = spark.createDataFrame([(k, "s", c == "1") for k, c in enumerate("0010001")], "t long, f string, ok boolean")
    assert [x.fallos_seguidos for x in H.failure_runs(r, "f", ["t"], F.col("ok")).orderBy("t").collect()] == [1, 2, 0, 1, 2, 3, 0]


def test_positions_split_hot_groups(spark):
    rows = [("hot", k) for k in range(500)] + [("z", 3), (None, 7)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(4)
    got = positions(df, "g", ["o"], "p").collect()
    assert sorted((r.o, r.p) for r in got if r.g == "hot") == [(k, k) for k in range(500)]
    assert {(r.g, r.p) for r in got if r.g != "hot"} == {("z", 0), (None, 0)}


def test_concept_pairs(spark):
    assert one(spark, lambda c: H.concept_pairs(c, ("de",)), "Fuga de clientes leales, hoy ya no") == ["clientes leales", "hoy ya", "leales hoy"]
    assert one(spark, lambda c: H.concept_pairs(c, ()), "") == []
