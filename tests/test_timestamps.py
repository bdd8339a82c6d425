"""Timestamps: formats, zones, daylight saving, impossible values, ambiguous orders, empty and odd tables."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tamiz.operators.timestamps import normalise_timestamps, p7_found

SCHEMA = "id long, nombre_medio string, fecha_publicacion string, fecha_extraccion string, creado_en string"
MEDIA = [("A", "Europe/Madrid", "dmy"), ("B", "America/New_York", "mdy"), ("C", "America/Sao_Paulo", "dmy")]


def us(text, zone="UTC", fold=0):
    t = dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


CASES = [
    ("A", "Sat, 27 May 2023 05:08:32 GMT", us("2023-05-27T05:08:32")),
    ("A", "01 Sep 2023 03:33:21 -0300", us("2023-09-01T06:33:21")),
    ("A", "20230901T235703Z", us("2023-09-01T23:57:03")),
    ("A", "29/03/2023 23:57", us("2023-03-29T23:57", "Europe/Madrid")),
    ("B", "3/9/2025 2:09 a. m.", us("2025-03-09T03:09", "America/New_York")),
    ("B", "12/14/2023 10:54 p. m.", us("2023-12-14T22:54", "America/New_York")),
    ("A", "29 de agosto de 2023, 13:37", us("2023-08-29T13:37", "Europe/Madrid")),
    ("C", "15 de junho de 2023 às 22h03", us("2023-06-15T22:03", "America/Sao_Paulo")),
    ("A", "domingo 26 de octubre de 2025, 02:33 h", us("2025-10-26T02:33", "Europe/Madrid", 0)),
    ("A", "2024-03-31 02:15:00", us("2024-03-31T01:15:00")),
    ("A", "2023-08-30T03:32:14[America/Santiago]", us("2023-08-30T03:32:14", "America/Santiago")),
    ("A", "2023-09-01 15:57:02 America/Argentina/Buenos_Aires", us("2023-09-01T15:57:02", "America/Argentina/Buenos_Aires")),
    ("A", "30 Aug 2023 06:47 CEST", us("2023-08-30T04:47:00")),
    ("A", "2023-08-31 03:58:53 UTC-4", us("2023-08-31T07:58:53")),
    ("A", "2023-09-02 17:45:11 GMT+02:00", us("2023-09-02T15:45:11")),
    ("A", "2023-09-02T00:32:00.043218298Z", us("2023-09-02T00:32:00.043218")),
    ("A", "25-Ago-2023 07:15", us("2023-08-25T07:15", "Europe/Madrid")),
    ("A", "01.09.23 08:52:08", us("2023-09-01T08:52:08", "Europe/Madrid")),
    ("B", "September 15, 2023 12:17 PM", us("2023-09-15T12:17", "America/New_York")),
    ("A", "2023-09-02", us("2023-09-02T00:00", "Europe/Madrid")),
    ("A", "1693437184", 1693437184_000_000),
    ("A", "1693469139184", 1693469139184_000),
    ("A", "1674657140427136", 1674657140427136),
]
NOT = ["N/D", "", "   ", "0000-00-00", "30/02/2023 21:44", "2023-13-19 11:24:00", "2025-06-22 25:57:10", "1e400", "Invalid Date", "-", "2023-08-30T03:32:14[Nada/Aqui]", "13:00"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_formats(spark):
    rows = [(k, m, v, "2023-09-02T10:00:00.000000+00:00", "2023-09-02T10:00:01.000000+00:00") for k, (m, v, _) in enumerate(CASES)]
    media = spark.createDataFrame(MEDIA, "nombre_medio string, zona_horaria string, orden_fecha string")
    got = {r.id: r.utc_us for r in p7_found(frame(spark, rows), media).where("campo = 'fecha_publicacion'").collect()}
    assert {k: got.get(k) for k in range(len(CASES))} == {k: c[2] for k, c in enumerate(CASES)}


def test_non_dates_nulls_repeats_and_canonical(spark):
    rows = [(k, "A", v, None, None) for k, v in enumerate(NOT)] + [(100, "A", None, "2023-09-02T10:00:00.000001+00:00", None), (101, "Z", "2023-09-02T10:00:00", "2023-09-02 10:00:00", None)]
    media = spark.createDataFrame(MEDIA, "nombre_medio string, zona_horaria string, orden_fecha string")
    got = sorted((r.id, r.campo, r.utc_us) for r in p7_found(frame(spark, rows), media).collect())
    t = us("2023-09-02T10:00:00")
    assert got == [(101, "fecha_extraccion", t), (101, "fecha_publicacion", t)]  # an unknown outlet is read in UTC
    assert p7_found(frame(spark, []), media).count() == 0


def test_order_is_learned_without_a_stated_one(spark):
    near = us("2023-06-20T00:00:00")
    rows = [(k, "f", f"{6}/{10 + k}/2023 10:00", "X", "UTC", near) for k in range(5, 12)] + [(99, "f", "6/5/2023 10:00", "X", "UTC", us("2023-06-06T00:00:00")), (98, "f", "6/5/2023 10:00", "Y", None, us("2023-05-07T00:00:00"))]
    values = spark.createDataFrame(rows, "id long, campo string, valor string, fuente string, zona string, cerca_us long").withColumn("v", F.lit("clash"))
    sources = spark.createDataFrame([("X", "UTC", None)], "fuente string, zona_horaria string, orden string")
    got = {r.id: r.utc_us for r in normalise_timestamps(values, sources).collect()}
    assert got[99] == us("2023-06-05T10:00:00") and got[98] == us("2023-05-06T10:00:00")


@pytest.mark.parametrize("text", ["x" * 200_000, "9" * 40])
def test_long_values(spark, text):
    media = spark.createDataFrame(MEDIA, "nombre_medio string, zona_horaria string, orden_fecha string")
    assert p7_found(frame(spark, [(1, "A", text, None, None)]), media).count() == 0
