"""Readers of captured payloads: feeds, article lists, job boards, directories, subtitles, pages, story searches.

Payloads come as rows of text (one whole document per row), from files or a stream; nothing here opens a connection.
A broken payload yields no rows and is counted by ``health``. Every reader returns (``origen``, ``titulo``, ``url``,
``medio``, ``fecha``) or what its docstring says; ``fecha`` is a UTC timestamp or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions.text import strip_accents


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``origen`` (its path) and ``cuerpo``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("origen"), F.col("value").alias("cuerpo"))


def query_url(base: str, text: Column, exact: Column, extra: dict[str, str]) -> Column:
    """Search address: the text quoted if exact, encoded, with further parameters."""
    q = F.when(exact, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    tail = "".join(f"&{k}={v}" for k, v in extra.items())
    return F.concat(F.lit(f"{base}?q="), F.url_encode(q), F.lit(tail))


_ITEM = "array<struct<title:string,link:string,pubDate:string,description:string,source:string>>"
_ENTRY = "array<struct<title:string,link:struct<_href:string>,updated:string,published:string,summary:string>>"
RFC = "EEE, d MMM yyyy HH:mm:ss z"


def _rfc(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), r"\bGMT$|\bUT$|\bZ$", "+0000"), F.lit("d MMM yyyy HH:mm:ss xx"))


def rss(df: DataFrame, default_outlet: str = "") -> DataFrame:
    """Items of RSS feeds, else entries of Atom feeds; items without title or link are dropped."""
    ok = df.where(F.col("cuerpo").rlike(r"(?s)<(rss|feed)\b.*</(rss|feed)>\s*$"))
    d = ok.withColumn("x", F.expr(f"from_xml(cuerpo, 'channel struct<item:{_ITEM}>, entry {_ENTRY}')"))
    items = d.select("origen", F.explode("x.channel.item").alias("i")).select(
        "origen", F.trim("i.title").alias("titulo"), F.trim("i.link").alias("url"), F.coalesce(F.nullif(F.trim("i.source"), F.lit("")), F.lit(default_outlet)).alias("medio"), _rfc(F.col("i.pubDate")).alias("fecha"), "i.description",
    )
    entries = d.select("origen", F.explode("x.entry").alias("e")).select(
        "origen", F.trim("e.title").alias("titulo"), F.col("e.link._href").alias("url"), F.lit(default_outlet).alias("medio"), F.try_to_timestamp(F.coalesce("e.published", "e.updated")).alias("fecha"), F.col("e.summary").alias("description"),
    )
    return items.unionByName(entries).withColumnRenamed("description", "resumen").where("titulo <> '' and url <> ''")


def first_items(items: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` items of each feed (one document) by date, newest first, then by address."""
    w = Window.partitionBy("origen").orderBy(F.desc("fecha"), "url")
    return items.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def mentions(items: DataFrame, name: Column) -> DataFrame:
    """Items that mention the name in title or summary, whatever case and accents."""
    low = lambda c: F.lower(strip_accents(c))
    return items.where(F.contains(low(F.concat_ws(" ", "titulo", "resumen")), low(name)))


def articles(df: DataFrame) -> DataFrame:
    """Article lists: ``{"articles": [{url, title, seendate, domain, language}]}``; dates as ``yyyyMMddTHHmmssZ``.

    A body that isn't such a list (a limit notice, say) gives no rows, so that ``health`` counts it as a failure.
    """
    j = F.from_json("cuerpo", "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string>>")
    a = df.select("origen", F.explode(j["articles"]).alias("a"))
    when = F.try_to_timestamp(F.regexp_replace("a.seendate", "Z$", "+0000"), F.lit("yyyyMMdd'T'HHmmssxx"))
    return a.select("origen", F.col("a.title").alias("titulo"), F.col("a.url").alias("url"), F.col("a.domain").alias("medio"), when.alias("fecha"), F.col("a.language").alias("idioma"))


def job_boards(df: DataFrame) -> DataFrame:
    """Open posts of three kinds of boards, told apart by their fields; event and origin are structural."""
    kind_a = "jobs array<struct<title:string,absolute_url:string,updated_at:string,jobUrl:string,applyUrl:string,publishedAt:string,updatedAt:string>>"
    a = df.select("origen", F.explode(F.from_json("cuerpo", kind_a)["jobs"]).alias("j")).select(
        "origen", F.coalesce("j.title", F.lit("")).alias("titulo"), F.coalesce("j.absolute_url", "j.jobUrl", "j.applyUrl", F.lit("")).alias("url"), F.try_to_timestamp(F.coalesce("j.updated_at", "j.publishedAt", "j.updatedAt")).alias("fecha"),
    )
    list_ = df.where(F.trim("cuerpo").startswith("["))
    b = list_.select("origen", F.explode(F.from_json("cuerpo", "array<struct<text:string,hostedUrl:string,createdAt:bigint>>")).alias("j")).select(
        "origen", F.coalesce("j.text", F.lit("")).alias("titulo"), F.coalesce("j.hostedUrl", F.lit("")).alias("url"), F.timestamp_millis("j.createdAt").alias("fecha")
    )
    return a.unionByName(b).withColumn("tipo_evento", F.lit("contratacion")).withColumn("origen_declaracion", F.lit("operador"))


def directory(df: DataFrame, giants: tuple[str, ...] = ()) -> DataFrame:
    """Companies of query results (``results.bindings``): without unlabelled ids and giants, first of each name in any case."""
    value = "struct<value:string>"
    j = F.from_json("cuerpo", f"results struct<bindings:array<struct<empresaLabel:{value},sitio:{value},descripcion:{value}>>>")
    b = df.select("origen", F.posexplode(j["results"]["bindings"]).alias("pos", "b"))
    b = b.select("origen", "pos", F.trim("b.empresaLabel.value").alias("nombre"), F.coalesce(F.trim("b.sitio.value"), F.lit("")).alias("sitio_web"), F.coalesce(F.trim("b.descripcion.value"), F.lit("")).alias("descripcion"))
    b = b.where((F.col("nombre") != "") & ~F.col("nombre").rlike(r"^Q\d+$"))
    for g in giants:
        b = b.where(~F.contains(F.lower(strip_accents(F.col("nombre"))), F.lit(g)))
    return b.groupBy(F.lower("nombre").alias("clave")).agg(F.min_by(F.struct("nombre", "sitio_web", "descripcion"), F.struct("origen", "pos")).alias("r")).select("r.*")


def repositories(df: DataFrame) -> DataFrame:
    """One row per list of repositories: how many, their stars, the most used languages and the last pushes."""
    r = "array<struct<name:string,language:string,stargazers_count:bigint,pushed_at:string,html_url:string>>"
    e = df.select("origen", F.explode(F.from_json("cuerpo", r)).alias("r")).select("origen", "r.*")
    lang = e.where("language is not null").groupBy("origen", "language").agg(F.count("*").alias("n"))
    lang = lang.groupBy("origen").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "language"))), 1, 5), lambda x: x["language"]).alias("lenguajes"))
    total = e.groupBy("origen").agg(F.count("*").alias("repos"), F.sum("stargazers_count").alias("estrellas"), F.max("pushed_at").alias("ultimo"))
    return total.join(lang, "origen", "left")


def stories(df: DataFrame) -> DataFrame:
    """Hits of a story search, the first five of each payload; a story without address gets none."""
    j = F.from_json("cuerpo", "nbHits bigint, hits array<struct<title:string,url:string,objectID:string,points:bigint,num_comments:bigint,created_at:string>>")
    return df.select("origen", j.alias("j")).select("origen", F.col("j.nbHits").alias("total"), F.explode(F.slice("j.hits", 1, 5)).alias("h")).select(
        "origen", "total", F.col("h.title").alias("titulo"), "h.url", F.col("h.points").alias("puntos"), F.col("h.num_comments").alias("comentarios"), F.try_to_timestamp("h.created_at").alias("fecha")
    )


def kept_raw(captures: DataFrame, now: Column) -> DataFrame:
    """What a purge at ``now`` keeps: captures that haven't expired; those without an instant stay."""
    return captures.where(F.col("expira_en").isNull() | (F.col("expira_en") >= now))


def board_state(responses: DataFrame) -> DataFrame:
    """State of job boards by the status of their answer: 404 means there is no such board, other errors are failures."""
    s = F.col("estado_http")
    return responses.withColumn("estado", F.when(s == 404, "ausente").when((s >= 200) & (s < 300), "ok").otherwise("fallo"))


def capture_state(responses: DataFrame) -> DataFrame:
    """State of page captures: timeout, blocked, HTTP error, redirected away, no content, application shell, ok; the first that holds."""
    s, t = F.col("estado_http"), F.coalesce("texto", F.lit(""))
    gone = F.coalesce(F.col("url_final"), F.col("url")) != F.col("url")
    state = (
        F.when(s.isNull(), "timeout").when(s.isin(401, 403, 429), "bloqueado").when(s >= 400, "error_http").when(gone & (F.length(t) < 20), "redirigido")
        .when(F.length(t) < 20, "contenido_vacio").otherwise("ok")
    )
    return responses.withColumn("estado", state)


def health(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Payloads and how many rows each gave; those without any are failures."""
    n = rows.groupBy("origen").agg(F.count("*").alias("filas"))
    return df.select("origen").join(n, "origen", "left").select("origen", F.coalesce("filas", F.lit(0).cast("long")).alias("filas")).withColumn("ok", F.col("filas") > 0)


def cues(df: DataFrame) -> DataFrame:
    """Lines of VTT or SRT subtitles with the time of their cue, in order: (``origen``, ``pos``, ``segundo``, ``linea``)."""
    lines = df.select("origen", F.posexplode(F.split("cuerpo", r"\r?\n")).alias("pos", "l")).withColumn("l", F.trim("l"))
    stamp = F.regexp_extract("l", r"(\d{2}):(\d{2}):(\d{2})[.,]\d{3}", 0)
    part = lambda k: F.substring(stamp, k, 2).try_cast("int")
    second = F.when(F.contains("l", F.lit("-->")) & (stamp != ""), part(1) * 3600 + part(4) * 60 + part(7))
    w = Window.partitionBy("origen").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("segundo", F.last(second, ignorenulls=True).over(w))
    text = F.trim(F.regexp_replace("l", r"<[^>]+>", ""))
    keep = ~F.contains("l", F.lit("-->")) & (text != "") & (F.upper("l") != "WEBVTT") & ~F.col("l").rlike(r"^\d+$") & F.col("segundo").isNotNull()
    return lines.where(keep).select("origen", "pos", "segundo", text.alias("linea"))


def cue_blocks(c: DataFrame, width: int = 60) -> DataFrame:
    """Blocks of at least ``width`` seconds, anchored at their first cue, without lines repeated inside a block.

    The anchor depends on the block before, so each video (a bounded group) is folded in one pass.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, buffer = [], None, []
        for s, line in pdf.sort_values("pos")[["segundo", "linea"]].itertuples(index=False):
            if line in buffer:
                continue
            if start is not None and s - start >= width:
                out.append((start, " ".join(buffer)))
                start, buffer = None, []
            start = s if start is None else start
            buffer.append(line)
        if buffer:
            out.append((start, " ".join(buffer)))
        return pd.DataFrame([(pdf["origen"].iloc[0], int(s), t) for s, t in out], columns=["origen", "segundo", "texto"])

    return c.groupBy("origen").applyInPandas(fold, "origen string, segundo long, texto string")


class _Visible(HTMLParser):
    """Text of a page by block, without what isn't content."""

    HIDDEN = frozenset("script style noscript nav footer header svg form button iframe template".split())
    BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr td th section article main br title".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.meta = 0, [""], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.HIDDEN:
            self.depth += 1
        elif tag in self.BLOCK:
            self.lines.append("")
        elif tag == "meta":
            a = dict(attrs)
            if (a.get("name") or a.get("property") or "").lower() in ("description", "og:description") and a.get("content"):
                self.meta.append(a["content"])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCK:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.lines[-1] += data


def _parse(html: str | None) -> tuple[str, str]:
    p = _Visible()
    p.feed(html or "")
    p.close()
    lines = [" ".join(x.split()) for x in p.lines]
    lines = [x for x in lines if x]
    speech = list(dict.fromkeys([*(" ".join(m.split()) for m in p.meta), *(x for x in lines if len(x) >= 40)]))
    return "\n".join(lines), " ".join(speech)


# ---- fixed values -------------------------------------------------------------------------------------------------
APP_MARKS = ("window.__next_data__", "window.__nuxt__", 'id="__next"', 'id="app"', "please enable javascript")
# ---- end of the fixed values --------------------------------------------------------------------------------------


def pages(df: DataFrame) -> DataFrame:
    """Visible text, discourse (descriptions and long lines) and state (ok, contenido_vacio, spa) of HTML pages."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_parse(h) for h in pdf["cuerpo"]]
            yield pd.DataFrame({"origen": pdf["origen"], "texto": [a for a, _ in rows], "discurso": [b for _, b in rows], "bajo": [(h or "").lower() for h in pdf["cuerpo"]]})

    p = df.select("origen", "cuerpo").mapInPandas(scan, "origen string, texto string, discurso string, bajo string")
    app = F.lit(False)
    for m in APP_MARKS:
        app = app | F.contains("bajo", F.lit(m))
    state = F.when(F.length("texto") < 20, "contenido_vacio").when(app & (F.length("texto") < 100), "spa").otherwise("ok")
    return p.select("origen", F.when(state == "ok", F.col("texto")).otherwise("").alias("texto"), "discurso", state.alias("estado"))


def retain(df: DataFrame, path: str, key: str, days: int = 90) -> None:
    """Write raw captures compressed, in folders by the first two characters of the key, with the instant at which they expire."""
    df.withColumn("prefijo", F.substring(key, 1, 2)).withColumn("expira_en", F.date_format(F.current_timestamp() + F.make_dt_interval(F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").option("compression", "gzip").partitionBy("prefijo").json(path)
