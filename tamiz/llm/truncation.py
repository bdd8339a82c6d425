"""Texts cut off by field limits or in transfer (problem 4).

A backward character n-gram model is trained on all values: for contexts of growing length, read backwards from a place
in a text, it counts how often a word ends there and how often it goes on, and, in a second view of the text in which
each capitalised word is one sign, how often the text ends there and how often it goes on. Contexts are counted one by
one, as 60-bit fingerprints, in the cluster; only those in which some value ends are ever looked up, so others are dropped
where they are read (a bitmap drops most of them, and the join with the values' own contexts the rest, so that its size
doesn't change a count). For the final context of each value the chances of both are interpolated
from short to long contexts; values whose odds of an end lie below a threshold are cut. The threshold is set per language (the
column is one) on all its values, each as it is and cut on purpose at a place that a hash of it gives. Lengths at which one source ends suspiciously often
(in characters or in bytes) lower the odds. Marks of a cut (``[+198 chars]``, a broken entity or tag) decide alone;
``...`` and ``[…]``, which headlines also use on purpose, only raise the bar.

Null and blank values are whole. Repeated values are decided alike. Only the end is judged, but texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.batchdedup import outlets_of
from tamiz.llm.encoding import repaired
from tamiz.llm.residue import is_residue_quote
from tamiz.llm.textutil import fold, strip_accents
from tamiz.session import cut

#: Lengths of the contexts, for the view by words and for that by signs.
WORD_ORDERS = (3, 4, 6, 8, 11)
SIGN_ORDERS = (2, 4, 6, 9, 14)
SLOTS = len(WORD_ORDERS) + len(SIGN_ORDERS)
#: Bits of the number of a place in the bitmap of wanted contexts, and bytes of one block of it.
BITMAP, BLOCK = 27, 1 << 19
#: Counts that a task keeps before it passes them on.
KEPT = 1_000_000
#: Longest context of a text that ends in a full stop, question or exclamation mark.
CLOSED = 6
#: Marks and outlet names stand among the last characters.
TAIL = 80
#: Confidence in a context that was seen n times is n / (n + SMOOTH).
SMOOTH = 3.0
#: A language with fewer values for it has no threshold of its own.
LEAST_ROWS = 50
#: Thresholds that are tried, and how many values cut on purpose a whole value taken for a cut one weighs.
GRID, WHOLE_WEIGHT = np.arange(-9.0, -2.0, 0.1), 8
#: Values up to this length are not cut on purpose, so no threshold is set on them.
SHORT = 60
#: Odds (log) that a value with a soft mark must have to count as whole.
SOFT = -2.5
#: A length counts as a limit when a source has so many times more ends there than around it.
LIMIT_RATIO, LIMIT_LEAST = 4.0, 6

# ---- fixed values -------------------------------------------------------------------------------------------------
HARD_MARK = re.compile(
    r"(?:\[\+\d+ ?chars?\]|\b(?:leer más|seguir leyendo|ver más|leia mais|continue lendo|read more|continue reading)\W*|(?<=\w)&#?\w{0,8}|(?<=[\w ])</?[a-zA-Z]\w*[^<>]{0,40}|\\u[0-9a-fA-F]{0,3}|\[(?:…|\.{2,3})?)\s*$", re.I
)
SOFT_MARK = re.compile(r"\s*(?:\[(?:…|\.{3})\]|…|\.{3})\s*$")
# ---- end of the fixed values --------------------------------------------------------------------------------------

_SUFFIX = re.compile(r"\s+[|–—-]\s+((?:(?!\s+[|–—-]\s)[^\n]){3,60}?)[\s.!?]*$")
_MORE = re.compile(r"[.!?…][\"”»’)]*\s+[—–-]?\s?[A-ZÁÉÍÓÚÑÀÃÂÇÊÔÕ¿¡“«(—\d]|\n|[^\s.] — ")
_SIC = re.compile(r"\s*[\[(]\s*(?:sic|actualizado|atualizado|updated)\s*[\])][\s.!?]*$", re.I)
_DIGIT = str.maketrans("123456789", "000000000")
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
WHOLE, HARD, SOFT_CLASS, OPEN = 0, 1, 2, 3


def prepare(text: str | None, outlets: frozenset[str]) -> tuple[str, int]:
    """The text as the model reads it, and what its end shows: a hard mark, a soft mark (removed), or nothing.

    The model reads without accents, quotation marks and repeated end punctuation, with each figure as 0, since copies
    of one statement differ in these. A label after the text (an outlet's name, ``(sic)``) shows that its end was kept.
    """
    if not text or not text.strip():
        return "", WHOLE
    lost = text.count("�")
    text = repaired(text).rstrip()
    if text.endswith("�") and lost == 1:
        return text, HARD
    labelled = False
    while True:
        tail = max(0, len(text) - TAIL)
        m = _SUFFIX.search(text, tail)
        if not (m and fold(m.group(1)) in outlets):
            m = _SIC.search(text, tail)
        if not m:
            break
        text, labelled = text[: m.start()], True
    if HARD_MARK.search(text, tail):
        return text, HARD
    kind = OPEN
    m = SOFT_MARK.search(text, tail)
    if m:
        text, kind = text[: m.start()], SOFT_CLASS
    if labelled or (lost > 1 and text[-1:] in ".!?)»”"):
        kind = WHOLE
    capitals = sum(map(str.isupper, text))
    if 2 * capitals > sum(map(str.isalpha, text)):
        text = text.lower()
    text = strip_accents(_QUOTES.sub("", text)).translate(_DIGIT)
    text = _DOUBLED.sub(r"\1", re.sub(r"\s+", " ", text).strip())
    if text.endswith("!") and "¡" not in text[-160:]:
        text = text[:-1] + "."
    return text, kind


_QUOTES = re.compile("[“”\"'‘’«»]")
_DOUBLED = re.compile(r" ?([.!?])[.!?]*$")
_CAPITAL = re.compile(r"[A-Z][^\W_]*(?:-[^\W_]+)*")


def signs(text: str) -> str:
    """The text with each capitalised word as one sign."""
    return _CAPITAL.sub("§", text)


def _arrays(texts: list[str], more: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array; distance from each text's start; whether a place is its end; its seed."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    start = np.repeat(ends - lengths, lengths)
    place = np.arange(len(codes)) - start
    last = np.zeros(len(codes), dtype=bool)
    last[ends[lengths > 0] - 1] = True
    seed = np.repeat(np.array(more, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D), lengths)
    return codes, place, last, seed


def _contexts(codes: np.ndarray, place: np.ndarray, seed: np.ndarray, orders: tuple[int, ...], first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its slot, the places with so long a context, and the fingerprint of each, with the slot in its last four bits."""
    h = np.zeros(len(codes), dtype=np.uint64)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, orders[-1] + 1):
            h[k - 1 :] += (codes[: len(codes) - k + 1] + np.uint64(7)) * weight
            weight *= _P
            if k in orders:
                slot = first + orders.index(k)
                ok = place >= k - 1
                x = (h[ok] ^ seed[ok]) * _MIX
                x ^= x >> np.uint64(29)
                yield slot, ok, ((x * _P) & ~np.uint64(15)) | np.uint64(slot)


def _views(texts: list[str]) -> Iterator[tuple[list[str], tuple[int, ...], int]]:
    yield texts, WORD_ORDERS, 0
    yield [signs(t) for t in texts], SIGN_ORDERS, len(WORD_ORDERS)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | (codes == 48) | ((codes >= 0xC0) & (codes < 0x250) & (codes != 0xD7) & (codes != 0xF7))


def _word_ends(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether no letter or digit follows."""
    following = np.append(_is_letter(codes)[1:], False)
    return last | ~following


def _bit(contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # mixed once more with the slot
        return ((contexts * _MIX) >> np.uint64(64 - BITMAP)).astype(np.int64)


def mark(contexts: np.ndarray, bitmap: np.ndarray) -> None:
    """Mark ``contexts`` as wanted in ``bitmap``."""
    at = _bit(contexts)
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def count_contexts(texts: list[str], more: list[bool], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of the texts in both views that ``bitmap`` marks: fingerprints, ends and continuations; none twice."""
    out = []
    for view, orders, first in _views(texts):
        codes, place, last, seed = _arrays(view, more)
        if not len(codes):
            continue
        ends = last if first else _word_ends(codes, last)
        if not first:
            seed = np.zeros_like(seed)
        for _, ok, x in _contexts(codes, place, seed, orders, first):
            at = _bit(x)
            use = ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            out.append(merged(x[use], ends[ok][use].astype(np.int64), (~ends[ok][use]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def merged(contexts: np.ndarray, ends: np.ndarray, goes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by context."""
    code, own = pd.factorize(contexts)
    return own, np.bincount(code, ends, len(own)).astype(np.int64), np.bincount(code, goes, len(own)).astype(np.int64)


def final_contexts(texts: list[str], more: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts at the end of each text: numbers of the texts, and fingerprints."""
    numbers, found = [], []
    for view, orders, first in _views(texts):
        tails = [t[-16:] for t in view]
        codes, place, last, seed = _arrays(tails, more)
        if not len(codes):
            continue
        if not first:
            seed = np.zeros_like(seed)
        number = np.repeat(np.arange(len(tails)), [len(t) for t in tails])
        for _, ok, x in _contexts(codes, place, seed, orders, first):
            use = last[ok]
            numbers.append(number[ok][use])
            found.append(x[use])
    return (np.concatenate(numbers), np.concatenate(found)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))


def end_signs(texts: list[str]) -> np.ndarray:
    """What the odds need of each text besides counts, as bits: it ends in a letter or digit, in end punctuation, has no capitals."""
    letter = _is_letter(np.array([ord(t[-1]) if t else 0 for t in texts], dtype=np.uint32))
    return np.array([bool(t) and int(x) + 2 * (t[-1] in ".!?") + 4 * t.islower() for t, x in zip(texts, letter, strict=True)], dtype=np.int32)


def end_odds(kind: np.ndarray, counts: np.ndarray, leave_out: bool) -> np.ndarray:
    """Log-odds of an end against a continuation at the end of each text, by its ``end_signs`` and its contexts' ends and continuations.

    ``counts``: texts x (ends, continuations) x slots; zeros change nothing. ``leave_out``: the texts were counted
    themselves, so their own ends are taken off. Texts without capitals are judged by their last word only.
    """
    chance = np.ones(len(kind))
    for orders, first in ((WORD_ORDERS, 0), (SIGN_ORDERS, len(WORD_ORDERS))):
        p = np.full(len(kind), 0.01 if first else 0.2)
        for n, order in enumerate(orders):
            end, goes = counts[:, 0, first + n].astype(float), counts[:, 1, first + n]
            if leave_out:
                end = np.maximum(0.0, end - 1)
            new = (end + SMOOTH * p) / (end + goes + SMOOTH)
            # after end punctuation only the word before it matters
            p = np.where((kind & 2) > 0, p, new) if first and order > CLOSED else new
        chance *= np.where((kind & 4) > 0, 1.0, p) if first else np.where((kind & 1) > 0, p, 1.0)
    chance = np.clip(chance, 1e-9, 1 - 1e-9)
    return np.log(chance / (1 - chance))


def place_of_cut(text: str) -> int:
    """Where ``text`` is cut on purpose: in its second half, by its hash, so the same in every run and partition."""
    n = len(text)
    return n // 2 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (n - 2 - n // 2) if n > 5 else n


def prepared_rows(rows: DataFrame, outlets: frozenset[str]) -> DataFrame:
    """(``id``, ``fuente``, ``idioma``, ``texto``, ``marca``, ``varias``, ``clase``, ``largo``, ``octetos``, ``corte``, ``varias_corte``, ``clase_corte``), without residue rows.

    ``corte``: where the value is cut on purpose for the thresholds, -1 if it isn't; ``varias`` and ``clase`` tell of the whole
    text whether more sentences stand in it and its ``end_signs``, those with ``_corte`` of the text cut there.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[t is not None and not is_residue_quote(t) for t in pdf["t"]]]
            ready = [prepare(t, outlets) for t in pdf["t"]]
            texts = [t for t, _ in ready]
            places = [place_of_cut(t) if kind == OPEN and len(own) > SHORT else -1 for (t, kind), own in zip(ready, pdf["t"], strict=True)]
            yield pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy(), "fuente": pdf["fuente"].to_numpy(), "idioma": pdf["idioma"].to_numpy(), "texto": texts, "marca": [k for _, k in ready],
                    "varias": [bool(_MORE.search(t, 12)) for t in texts], "clase": end_signs(texts), "largo": [len(t) for t in pdf["t"]], "octetos": [len(t.encode()) for t in pdf["t"]],
                    "corte": places, "varias_corte": [bool(_MORE.search(t, 12, max(k, 0))) for t, k in zip(texts, places, strict=True)], "clase_corte": end_signs([t[: max(k, 0)] for t, k in zip(texts, places, strict=True)]),
                }
            )

    return rows.mapInPandas(scan, "id long, fuente string, idioma string, texto string, marca int, varias boolean, clase int, largo int, octetos int, corte int, varias_corte boolean, clase_corte int")


def with_cut_ones(ready: DataFrame) -> DataFrame:
    """(``id``, ``aposta``, ``texto``, ``varias``): all values as they are, and those for the thresholds also as cut on purpose."""
    own = F.struct(F.lit(False).alias("aposta"), "texto", "varias")
    chopped = F.struct(F.lit(True).alias("aposta"), F.substring("texto", F.lit(1), F.col("corte")).alias("texto"), F.col("varias_corte").alias("varias"))
    return ready.select("id", F.explode(F.when(F.col("corte") >= 0, F.array(own, chopped)).otherwise(F.array(own))).alias("x")).select("id", "x.*")


def wanted_contexts(ready: DataFrame, more: np.ndarray) -> np.ndarray:
    """Bitmap of the contexts in which the texts of ``ready`` end, and of ``more``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.zeros(1 << (BITMAP - 3), dtype=np.uint8)
        for pdf in batches:
            mark(final_contexts(pdf["texto"].tolist(), pdf["varias"].tolist())[1], bitmap)
        rows = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(bitmap.reshape(-1, BLOCK)) if x.any()]
        yield pd.DataFrame(rows, columns=["bloque", "bits"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(zlib.decompress(x), dtype=np.uint8)
        return pd.DataFrame({"bloque": [pdf["bloque"].iloc[0]], "bits": [zlib.compress(total.tobytes(), 1)]})

    bitmap = np.zeros(1 << (BITMAP - 3), dtype=np.uint8)
    for r in ready.select("texto", "varias").mapInPandas(scan, "bloque int, bits binary").groupBy("bloque").applyInPandas(add, "bloque int, bits binary").collect():
        bitmap[r.bloque * BLOCK : (r.bloque + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    mark(more, bitmap)
    return bitmap


def train(ready: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(``contexto``, ``fin``, ``sigue``): ends and continuations of each context that ``bitmap`` marks, over all values."""
    shared = ready.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat = lambda: merged(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        frame = lambda x: pd.DataFrame({"contexto": x[0].view(np.int64), "fin": x[1], "sigue": x[2]})
        for pdf in batches:
            kept.append(count_contexts(pdf["texto"].tolist(), pdf["varias"].tolist(), shared.value))
            if sum(len(x[0]) for x in kept) > KEPT:
                kept = [flat()]
                if 2 * len(kept[0][0]) > KEPT:
                    yield frame(kept.pop())
        if kept:
            yield frame(flat())

    each = ready.where("marca <> 1").select("texto", "varias").mapInPandas(count, "contexto long, fin long, sigue long")
    return cut(each.groupBy("contexto").agg(F.sum("fin").alias("fin"), F.sum("sigue").alias("sigue")))


def thresholds(scored: DataFrame) -> dict[str | None, float]:
    """Threshold of the odds per language, and of the pool of all under None: least weighted error on values cut on purpose against values as they are.

    ``scored``: (``idioma``, ``paso``, ``paso_corte``) of all values for the thresholds, the first step of ``GRID`` that isn't below the odds of the
    value as it is and as cut on purpose; what is collected are counts by steps. Languages with less than ``LEAST_ROWS`` have the pool's.
    """
    steps: dict[str | None, np.ndarray] = {None: np.zeros((2, len(GRID) + 1), dtype=np.int64)}
    for r in scored.groupBy(F.coalesce("idioma", F.lit("")).alias("idioma"), "paso", "paso_corte").agg(F.count("*").alias("n")).collect():
        for lang in (r.idioma, None):
            table = steps.setdefault(lang, np.zeros_like(steps[None]))
            table[0, r.paso] += r.n
            table[1, r.paso_corte] += r.n
    out: dict[str | None, float] = {}
    for lang, (whole, broken) in steps.items():
        n = int(whole.sum())
        if lang is None and not n:
            out[lang] = -np.inf
        elif lang is None or n >= LEAST_ROWS:
            # at GRID[k]: whole values of odds up to it are taken for cut ones, broken ones above it are missed
            cost = (n - np.cumsum(broken)[:-1]) / n + WHOLE_WEIGHT * np.cumsum(whole)[:-1] / n
            out[lang] = float(GRID[int(np.argmin(cost))])
    return out


def limits(ready: DataFrame) -> DataFrame:
    """(``fuente``, ``medida``, ``valor``, ``peso``): lengths at which a source ends far more often than around, with the log of how much more."""
    open_ends = ready.where(~F.col("texto").rlike("[.!?”»)]$") | (F.col("marca") == SOFT_CLASS))
    sizes = open_ends.select("fuente", F.explode(F.array(F.struct(F.lit("largo").alias("medida"), F.col("largo").alias("valor")), F.struct(F.lit("octetos").alias("medida"), F.col("octetos").alias("valor")))).alias("x"))
    n = sizes.select("fuente", "x.medida", "x.valor").groupBy("fuente", "medida", "valor").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    around = W.partitionBy("fuente", "medida").orderBy("valor").rangeBetween(-8, 8)
    mean = (F.sum("n").over(around) - F.col("n")) / 16
    ratio = F.col("n") / (mean + 0.5)
    return n.withColumn("peso", F.when((F.col("n") >= LIMIT_LEAST) & (ratio >= LIMIT_RATIO), F.log(ratio))).where("peso is not null").select("fuente", "medida", "valor", "peso")


def scored_rows(ready: DataFrame) -> DataFrame:
    """(``id``, ``fuente``, ``idioma``, ``marca``, ``indicio``, ``paso``, ``paso_corte``) of the rows of ``prepared_rows``: log-odds of an end less what the length tells; steps as in ``thresholds``, null where the value isn't for them."""
    pieces = with_cut_ones(ready)
    counts = train(ready, wanted_contexts(pieces, np.empty(0, np.uint64)))
    near = F.broadcast(limits(ready).groupBy("fuente").agg(F.collect_list(F.struct("medida", "valor", "peso")).alias("limites")))  # sources by lengths below the longest limit
    df = ready.join(near, "fuente", "left")
    weight = F.aggregate(
        F.coalesce("limites", F.array().cast("array<struct<medida:string,valor:int,peso:double>>")), F.lit(0.0),
        lambda acc, x: F.greatest(acc, F.when(((x.medida == "largo") & (x.valor == F.col("largo"))) | ((x.medida == "octetos") & (x.valor == F.col("octetos"))), x.peso).otherwise(0.0)),
    )

    def finals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of, x = final_contexts(pdf["texto"].tolist(), pdf["varias"].tolist())
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[of], "aposta": pdf["aposta"].to_numpy()[of], "contexto": x.view(np.int64)})

    # slots of the value as it is, then of the value as cut on purpose
    slot = F.col("contexto").bitwiseAND(F.lit(15)) + F.when(F.col("aposta"), SLOTS).otherwise(0)
    names = [f"{c}{k}" for c in ("fin", "sigue") for k in range(2 * SLOTS)]
    found = pieces.mapInPandas(finals, "id long, aposta boolean, contexto long").join(counts, "contexto").select("id", slot.alias("lugar"), "fin", "sigue")
    own = found.repartition("id").groupBy("id").agg(*[F.sum(F.when(F.col("lugar") == k, F.col(c))).alias(f"{c}{k}") for c in ("fin", "sigue") for k in range(2 * SLOTS)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = pdf[names].fillna(0).to_numpy(dtype=np.int64).reshape(len(pdf), 2, 2 * SLOTS)
            odds = end_odds(pdf["clase"].to_numpy(), table[:, :, :SLOTS], leave_out=True)
            broken = end_odds(pdf["clase_corte"].to_numpy(), table[:, :, SLOTS:], leave_out=False)
            rest = ~pdf["prueba"].to_numpy(dtype=bool)
            step = lambda x: pd.Series(np.searchsorted(GRID, x), dtype="Int32").mask(rest)  # noqa: E731, B023
            yield pd.DataFrame({"id": pdf["id"], "fuente": pdf["fuente"], "idioma": pdf["idioma"], "marca": pdf["marca"], "indicio": odds - pdf["peso"].to_numpy(), "paso": step(odds), "paso_corte": step(broken)})

    info = df.select("id", "fuente", "idioma", "marca", "clase", "clase_corte", (F.col("corte") >= 0).alias("prueba"), weight.alias("peso"))
    return info.join(own, "id", "left").mapInPandas(score, "id long, fuente string, idioma string, marca int, indicio double, paso int, paso_corte int")


def cut_rows(rows: DataFrame, outlets: frozenset[str]) -> DataFrame:
    """(``id``, ``fuente``, ``cortado``, ``indicio``) of all rows (``id``, ``fuente``, ``idioma``, ``t``) that are no residue."""
    scored = cut(scored_rows(cut(prepared_rows(rows, outlets))))
    least = thresholds(scored.where("paso is not null"))
    own = F.create_map(*[F.lit(x) for lang, limit in least.items() if lang is not None for x in (lang, limit)]) if len(least) > 1 else F.lit(None).cast("map<string,double>")
    limit = F.when(F.col("marca") == SOFT_CLASS, F.lit(SOFT)).otherwise(F.coalesce(own[F.coalesce("idioma", F.lit(""))], F.lit(float(least[None]))))
    is_cut = (F.col("marca") == HARD) | ((F.col("marca") != WHOLE) & (F.col("indicio") < limit))
    return scored.select("id", "fuente", is_cut.alias("cortado"), "indicio")


def _rows(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    dim = medios.select(F.col("nombre_medio").alias("fuente"), "idioma").dropDuplicates(["fuente"])
    return evidencias.select(F.col("id").cast("long").alias("id"), F.col("nombre_medio").alias("fuente"), F.col("cita_textual").alias("t")).join(F.broadcast(dim), "fuente", "left").select("id", "fuente", "idioma", "t")


def p4_found(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    """(``id``) of the rows whose quote was cut; residue rows are no cases."""
    return cut_rows(_rows(evidencias, medios), outlets_of(medios)).where("cortado").select("id")


def p4_tasas(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    """For each ``nombre_medio``: its rows, how many are cut, and the share."""
    found = cut_rows(_rows(evidencias, medios), outlets_of(medios)).groupBy("fuente").agg(F.count_if("cortado").alias("c"))
    rows = evidencias.groupBy(F.col("nombre_medio")).agg(F.count("*").alias("filas"))
    n = F.coalesce("c", F.lit(0).cast("long"))
    return rows.join(found, rows.nombre_medio.eqNullSafe(found.fuente), "left").select("nombre_medio", "filas", n.alias("cortadas"), F.round(n / F.col("filas"), 6).alias("proporcion"))
