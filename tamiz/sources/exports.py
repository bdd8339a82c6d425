"""Exports: CSV with a byte-order mark, JSON, Markdown and HTML, written by the tasks; nothing is gathered in one row or task.

Markdown and HTML are lines in order: (``orden`` columns, ``linea``), range-partitioned by that order, so that the part files
read one after another are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import collapse


def to_csv(rows: DataFrame, path: str) -> None:
    """CSV whose header begins with a byte-order mark, as spreadsheets want; arrays are joined by bars."""
    flat = rows.select(*[F.array_join(F.col(f"`{c}`"), "|").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in rows.dtypes])
    first = flat.columns[0]
    flat.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def escaped(c: Column) -> Column:
    """Text for HTML: the five signs replaced; '' for null."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def markdown_lines(rows: DataFrame, group: str, key: str, line: Column) -> DataFrame:
    """(``grupo``, ``nivel``, ``clave``, ``linea``): a heading per group (``nivel`` 0) and its lines (1) in order of ``key``."""
    g = F.coalesce(F.col(group), F.lit(""))
    body = rows.select(g.alias("grupo"), F.lit(1).alias("nivel"), F.col(key).cast("long").alias("clave"), F.concat(F.lit("- "), collapse(line)).alias("linea"))
    heads = rows.select(g.alias("grupo")).distinct().select("grupo", F.lit(0).alias("nivel"), F.lit(0).cast("long").alias("clave"), F.concat(F.lit("## "), "grupo").alias("linea"))
    return heads.unionByName(body)


def html_lines(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(``clave``, ``linea``): one table row per row, in order of ``key``."""
    cells = F.concat(*[x for c in columns for x in (F.lit("<td>"), escaped(F.col(c)), F.lit("</td>"))])
    return rows.select(F.col(key).cast("long").alias("clave"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("linea"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The lines as text files in order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("linea").write.mode("overwrite").text(path)
