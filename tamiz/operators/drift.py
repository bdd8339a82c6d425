"""Changes between consecutive captures of a page."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz import lexicon as L
from tamiz.functions.text import contains_any
from tamiz.operators.history import concept_pairs, previous

STOP_WORDS = L.NO_CONCEPTS


def pairs(snapshots: DataFrame) -> DataFrame:
    """Each observable capture with the text of the last observable one of the same organisation and page."""
    ok = F.col("estado_observable") == "ok"
    s = previous(snapshots, ["org_nombre", "tipo_pagina"], ["id"], "texto", ok)
    return s.where(ok & F.col("anterior").isNotNull()).select("id", "org_nombre", "tipo_pagina", "anterior", "texto")


def concept_changes(snapshots: DataFrame) -> DataFrame:
    """New and vanished word pairs of each capture, by number."""
    p = pairs(snapshots).where("anterior <> texto")
    a, b = concept_pairs(F.col("anterior"), STOP_WORDS), concept_pairs(F.col("texto"), STOP_WORDS)
    return p.select("id", F.size(F.array_except(b, a)).cast("long").alias("nuevos"), F.size(F.array_except(a, b)).cast("long").alias("perdidos"))


def first_concepts(snapshots: DataFrame, most: int = 5) -> DataFrame:
    """(``id``, ``tipo_cambio``, ``concepto``): of each capture the ``most`` first new and vanished word pairs by alphabet."""
    p = pairs(snapshots).where("anterior <> texto")
    p = p.select("id", concept_pairs(F.col("anterior"), STOP_WORDS).alias("a"), concept_pairs(F.col("texto"), STOP_WORDS).alias("b"))
    first = lambda x, y, kind: F.transform(F.slice(F.array_sort(F.array_except(x, y)), 1, most), lambda c: F.struct(F.lit(kind).alias("tipo_cambio"), c.alias("concepto")))
    both = F.concat(first("b", "a", "concepto_nuevo"), first("a", "b", "concepto_eliminado"))
    return p.select("id", F.explode(both).alias("c")).select("id", "c.tipo_cambio", "c.concepto")


def comparable(text: str) -> str:
    """Lower case, only words, single blanks."""
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


FRAGMENTS = "id long, antes string, despues string, parecido double"


def fragments(snapshots: DataFrame) -> DataFrame:
    """Changed line ranges (``id``, ``antes``, ``despues``) of consecutive captures, with the similarity of the words; ranges that differ in form only are left out.

    The matcher works on lines; it can't be built in.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, before, after in zip(pdf["id"], pdf["anterior"], pdf["texto"], strict=True):
                a, b = ([x.strip() for x in t.splitlines() if x.strip()] for t in (before, after))
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
                    x, y = "\n".join(a[i1:i2]), "\n".join(b[j1:j2])
                    if tag == "equal" or len(x + y) < 10 or (tag == "replace" and comparable(x) == comparable(y)):
                        continue
                    rows.append((i, x, y, difflib.SequenceMatcher(None, comparable(x), comparable(y)).ratio() if x and y else 0.0))
            yield pd.DataFrame(rows, columns=["id", "antes", "despues", "parecido"])

    changed = pairs(snapshots).where("anterior <> texto")
    return changed.select("id", "anterior", "texto").mapInPandas(scan, FRAGMENTS)


def change_type(before: Column, after: Column, alike: Column) -> Column:
    """What a changed range is about: new, gone, identity, position, audience, another subject altogether (``alike`` below 0.3), or wording."""
    either = lambda marks: contains_any(F.lower(before), marks) | contains_any(F.lower(after), marks)
    return (
        F.when(before == "", "concepto_nuevo").when(after == "", "concepto_eliminado").when(either(L.IDENTITY_MARKS), "identidad").when(either(L.POSITION_MARKS), "posicionamiento")
        .when(either(L.AUDIENCE_MARKS), "audiencia").when(alike < 0.3, "cambio_ontologico").otherwise("lenguaje")
    )


def evidence(snapshots: DataFrame) -> DataFrame:
    """Drift evidence of captures, each once by its content: (``clave``, ``org_nombre``, ``tipo_pagina``, ``tipo_cambio``, ``antes``, ``despues``, ``id`` of the first capture).

    The key covers both fragments, so that different new concepts of one page stay apart.
    """
    typed = fragments(snapshots).select("id", change_type(F.col("antes"), F.col("despues"), F.col("parecido")).alias("tipo_cambio"), F.substring("antes", 1, 500).alias("antes"), F.substring("despues", 1, 500).alias("despues"))
    c = first_concepts(snapshots)
    gone = F.col("tipo_cambio") == "concepto_eliminado"
    more = c.select("id", "tipo_cambio", F.when(gone, F.col("concepto")).otherwise("").alias("antes"), F.when(gone, "").otherwise(F.col("concepto")).alias("despues"))
    rows = typed.unionByName(more).join(snapshots.select("id", "org_nombre", "tipo_pagina"), "id")
    key = F.sha2(F.concat_ws("|", "org_nombre", "tipo_pagina", "tipo_cambio", "antes", "despues"), 256)
    return rows.groupBy(key.alias("clave"), "org_nombre", "tipo_pagina", "tipo_cambio", "antes", "despues").agg(F.min("id").alias("id"))


def line_changes(snapshots: DataFrame) -> DataFrame:
    """Changed line ranges of each capture with a similarity in thousandths; a matcher over lines can't be built in."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, before, after in zip(pdf["id"], pdf["anterior"], pdf["texto"], strict=True):
                m = difflib.SequenceMatcher(None, before.splitlines(), after.splitlines())
                ops = [o for o in m.get_opcodes() if o[0] != "equal"]
                rows.append((i, len(ops), int(1000 * m.ratio()), "cambio_total" if m.ratio() < 0.3 else "cambio_parcial" if ops else "igual"))
            yield pd.DataFrame(rows, columns=["id", "cambios", "parecido", "tipo"])

    return pairs(snapshots).select("id", "anterior", "texto").mapInPandas(scan, "id long, cambios long, parecido long, tipo string")
