"""Readers on small payloads, broken ones included."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.sources import exports as X
from tamiz.sources import feeds as S
from tamiz.sources import normalise as N

RSS = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>Núbank levanta capital - Medio</title><link>http://a/1</link><pubDate>Sat, 27 May 2023 05:08:32 GMT</pubDate><source url="x">Medio</source><description>d</description></item>
<item><title>Otra</title><link>http://a/2</link></item><item><title>sin enlace</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>v2</title><link href="http://b/1"/><updated>2023-07-22T04:26:40Z</updated></entry></feed>"""


def load(spark, *bodies):
    return spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "origen string, cuerpo string")


def test_feeds(spark):
    got = sorted((r.titulo, r.url, r.medio, r.fecha) for r in S.rss(load(spark, RSS, ATOM, "<rss><broken", "", None), "Fuente").collect())
    assert got == [("Núbank levanta capital - Medio", "http://a/1", "Medio", dt.datetime(2023, 5, 27, 5, 8, 32)), ("Otra", "http://a/2", "Fuente", None), ("v2", "http://b/1", "Fuente", dt.datetime(2023, 7, 22, 4, 26, 40))]
    assert [r.url for r in S.mentions(S.rss(load(spark, RSS)), F.lit("nubank")).collect()] == ["http://a/1"]


def test_articles_and_health(spark):
    df = load(spark, '{"articles":[{"url":"u","title":"t","seendate":"20230901T235703Z","domain":"d","language":"es"},{"url":"v","title":"x","seendate":""}]}', "<html>limit</html>")
    rows = S.articles(df)
    assert sorted((r.url, r.fecha) for r in rows.collect()) == [("u", dt.datetime(2023, 9, 1, 23, 57, 3)), ("v", None)]
    assert {r.origen: r.ok for r in S.health(df, rows).collect()} == {"0": True, "1": False}


def test_job_boards(spark):
    df = load(spark, '{"jobs":[{"title":"a","absolute_url":"u","updated_at":"2023-07-22T04:26:40Z"}]}', '[{"text":"b","hostedUrl":"v","createdAt":1690000000000}]', '{"jobs":[{"title":"c","applyUrl":"w","publishedAt":null}]}', "nada")
    got = sorted((r.titulo, r.url, r.fecha) for r in S.job_boards(df).where("titulo <> ''").collect())
    t = dt.datetime(2023, 7, 22, 4, 26, 40)
    assert got == [("a", "u", t), ("b", "v", t), ("c", "w", None)]


def test_directory_repositories_stories(spark):
    b = lambda n: '{"empresaLabel":{"value":"%s"},"sitio":{"value":"s"}}' % n
    df = load(spark, '{"results":{"bindings":[%s]}}' % ",".join(map(b, ("Clara", "CLARA", "Q12", "Google Chile", "Konfío"))))
    assert sorted(r.nombre for r in S.directory(df, ("google",)).collect()) == ["Clara", "Konfío"]
    r = S.repositories(load(spark, '[{"name":"a","language":"Go","stargazers_count":2,"pushed_at":"2023"},{"name":"b","language":null,"stargazers_count":1,"pushed_at":"2024"}]')).first()
    assert (r.repos, r.estrellas, r.lenguajes, r.ultimo) == (2, 3, ["Go"], "2024")
    hits = ",".join('{"title":"t%d","points":1}' % k for k in range(9))
    assert S.stories(load(spark, '{"nbHits":40,"hits":[%s]}' % hits)).count() == 5


def test_subtitles(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:04.000\nhola <b>a</b> todos\nhola a todos\n00:00:50.000 --> 00:00:52.000\nsigue\n00:01:02.000 --> 00:01:03.000\nnuevo bloque\nhola a todos\n"
    c = S.cues(load(spark, vtt, ""))
    assert [(r.segundo, r.linea) for r in c.orderBy("pos").collect()][:2] == [(1, "hola a todos"), (1, "hola a todos")]
    assert [(r.segundo, r.texto) for r in S.cue_blocks(c).orderBy("segundo").collect()] == [(1, "hola a todos sigue"), (62, "nuevo bloque hola a todos")]


def test_pages_and_markdown(spark, tmp_path):
    html = "<html><head><meta name='description' content='Una descripción bastante larga de la empresa'><style>x</style></head><body><nav>menu</nav><p>Texto&nbsp;visible de la página</p><script>1<2</script></body></html>"
    got = {r.origen: r for r in S.pages(load(spark, html, "<p>x</p>", None, '<div id="app">cargando la aplicación ahora</div>')).collect()}
    assert got["0"].texto == "Texto visible de la página" and "descripción" in got["0"].discurso
    assert [got[str(k)].estado for k in range(4)] == ["ok", "contenido_vacio", "contenido_vacio", "spa"]
    lines = X.markdown_lines(spark.createDataFrame([("A", 2, "b"), ("A", 1, "a"), (None, 3, "c")], "g string, k int, l string"), "g", "k", F.col("l"))
    X.write_lines(lines, ["grupo", "nivel", "clave"], str(tmp_path / "md"))
    text = [open(p, encoding="utf-8").read() for p in sorted(glob.glob(str(tmp_path / "md" / "part-*")))]
    assert "".join(text) == "## \n- c\n## A\n- a\n- b\n"
    X.to_csv(spark.createDataFrame([("a,b", ["x", "y"])], "g string, l array<string>").coalesce(1), str(tmp_path / "csv"))
    X.to_json(spark.createDataFrame([(None, 1)], "g string, n int").coalesce(1), str(tmp_path / "json"))
    read = lambda d: open(glob.glob(str(tmp_path / d / "part-*"))[0], encoding="utf-8").read()
    assert read("csv") == '\ufeffg,l\n"a,b",x|y\n' and read("json") == '{"g":null,"n":1}\n'
    assert X.html_lines(spark.createDataFrame([(1, "<b>&'")], "k int, t string"), "k", ["t"]).first().linea == "<tr><td>&lt;b&gt;&amp;&#x27;</td></tr>"
    S.retain(spark.createDataFrame([("abc", 1)], "h string, x int"), str(tmp_path / "r"), "h")
    assert spark.read.json(str(tmp_path / "r")).first().prefijo == "ab"


def test_mailboxes(spark):
    cases = {"Ana.Ruiz@x-y.com": "", "a..b@x.com": "puntos", "info@x.com": "generico", "info.mx@x.com": "generico", "ana@example.com": "dominio_de_ejemplo", "f@a.png": "imagen", "1a@x.com": "inicio", "x@y.test": "terminacion_reservada", "nada": "sintaxis", "(<luis@x.com>),": ""}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.m for r in df.select("c", T.mailbox_reason(F.col("c")).alias("m")).collect()} == cases


def test_query_url(spark):
    u = spark.range(1).select(S.query_url("http://s", F.lit("a b"), F.lit(True), {"hl": "es"}).alias("u")).first().u
    assert u == "http://s?q=%22a+b%22&hl=es"


def test_normalise(spark):
    items = spark.createDataFrame([(" T ", "http://a/1 ", None, None, "<p>r</p>"), ("U", "http://a/2", "M", dt.datetime(2024, 1, 2, 3, 4, 5), None)], "titulo string, url string, medio string, fecha timestamp, resumen string")
    got = {r.cita_textual: r for r in N.records(items, "noticias", F.lit("Clara"), F.lit("ronda"), F.lit("now")).collect()}
    assert (got["T"].nombre_medio, got["T"].fecha_publicacion, got["T"].url_fuente) == ("Google News", None, "http://a/1")
    assert (got["U"].nombre_medio, got["U"].fecha_publicacion, got["U"].tipo_evento) == ("M", "2024-01-02T03:04:05+00:00", "ronda")
    assert N.records(items, "vacantes", F.lit("C"), F.lit("x"), F.lit("n")).first().tipo_evento == "contratacion"
    assert {r.texto for r in N.pushes(items, F.lit("C")).collect()} == {"T. r", "U"}
    assert N.region_clause("Costa Rica") == '("Costa Rica")' and N.region_clause("Toda") == "" and N.region_clause("LATAM").count(" OR ") == 7


def test_states(spark):
    r = spark.createDataFrame([(404,), (200,), (500,)], "estado_http int")
    assert [x.estado for x in S.board_state(r).collect()] == ["ausente", "ok", "fallo"]
    c = spark.createDataFrame([(None, "u", "u", ""), (403, "u", "u", ""), (500, "u", "u", ""), (200, "u", "v", ""), (200, "u", "u", "x"), (200, "u", "v", "x" * 30)], "estado_http int, url string, url_final string, texto string")
    assert [x.estado for x in S.capture_state(c).collect()] == ["timeout", "bloqueado", "error_http", "redirigido", "contenido_vacio", "ok"]
    i = spark.createDataFrame([("f", f"t{k}", f"u{k}", "m", dt.datetime(2024, 1, 1 + k)) for k in range(25)], "origen string, titulo string, url string, medio string, fecha timestamp")
    assert sorted(x.url for x in S.first_items(i, 3).collect()) == ["u22", "u23", "u24"]
