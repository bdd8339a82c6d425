"""Text that was decoded with the wrong character encoding (problem 6).

A smoothed character n-gram model is trained on clean records: n-grams are counted over all of them in the cluster. For each suspicious text every encode-decode chain of bounded length is scored: UTF-8 bytes read in a
single-byte code page, up to ``CHAIN`` times and in any mixture of code pages, over the whole text; then, token by token,
because a text may be garbled in part only, the same and bytes of one code page read in another, in any order. The
likeliest candidate is accepted when its log-likelihood exceeds that of the text as it stands by a margin, which is
validated with the same chains on all clean records, those of each part under a model of the other parts. What remains garbled (replacement characters) is reported as
not recoverable; a damaged last character, which comes from a cut, is no case.

Null, empty and blank texts are clean. Texts are processed whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Code pages in which UTF-8 bytes are found to be read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
#: (read as, really): bytes of a single-byte code page read in another one.
CONFUSED = (("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"))
#: Characters beyond ASCII that clean records of these languages contain.
CLEAN = "áéíóúüñÁÉÍÓÚÜÑãõâêôçàÃÕÂÊÔÇÀ¿¡«»“”‘’…—–ªº°•·®©€£™\xa0↑↓→←✕✓✉☰≡▶★½−±×⁻⁶"
# ---- end of the fixed values --------------------------------------------------------------------------------------

#: Parts of the clean records, by hash of the text, so that the margin is validated on all of them and by no model that has seen them.
PARTS = 4
#: About so many records are held out by ``train``, which no query uses.
VALIDATION_ROWS = 4_000
#: Steps in which gains on clean records are counted, rounded up.
GAIN_STEP = 0.01
#: Tokens whose candidates, and tokens after a character whose gains, a task keeps; longer ones are worked out anew each time.
KEPT_CHAINS, KEPT_GAINS, KEPT_LENGTH = 1 << 13, 1 << 17, 64
#: Most steps of an encode-decode chain: over the whole text, and over a token.
CHAIN, TOKEN_CHAIN = 3, 2

_LOW = "a-záéíóúñãõç"
SUSPICIOUS = re.compile(
    rf"[^\x00-\x7f{re.escape(CLEAN)}]|[ÃÂ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]|(?<=[ {_LOW}])Ã (?=[{_LOW}])|[{_LOW}][·ÁÉÍÓÚÑÀÇÃÕÂÊÔ±](?![A-Z])|(?<= )[ÚÓ](?= [{_LOW}])"
    rf"|[{_LOW}]\?[{_LOW}]"
)
_LOST = re.compile(rf"�|(?<![\w/.:?=&-])[{_LOW}A-Z]*[{_LOW}]\?[{_LOW}]+(?![\w/=])")
#: Marks of a cut at the very end.
END_MARK = re.compile(r"\s*(?:\[(?:…|\.\.\.|\+\d+ chars)\]?|…|\.{3}|leer más|seguir leyendo|read more|leia mais)?\s*$", re.I)


def _bytes_of(codec: str) -> dict[str, int]:
    """Characters to bytes; bytes the code page leaves undefined are taken as the C1 controls, as decoders do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _class(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


def _utf8_reader(codec: str) -> tuple[re.Pattern[str], dict[str, int]]:
    to_byte = _bytes_of(codec)
    of = lambda lo, hi: _class([c for c, b in to_byte.items() if lo <= b <= hi])
    more = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}"), to_byte


_READERS = {codec: _utf8_reader(codec) for codec in READ_AS}


def _confusion(read_as: str, really: str) -> dict[int, str]:
    out = {}
    for c, b in _bytes_of(read_as).items():
        try:
            out[ord(c)] = bytes([b]).decode(really)
        except UnicodeDecodeError:
            continue
    return out


_SWAPS = [_confusion(a, b) for a, b in CONFUSED]
_SPLIT = re.compile(r"([ \n\t]+)")
#: What UTF-8 sequences of these languages stand for: Latin letters, punctuation, symbols, emoji, C1 controls of a second garbling.
_EXPECTED = re.compile("[\u0080-\u024f\u0400-\u045f\u2010-\u2bff\ufffd\U0001f000-\U0001faff]")
_LOST_NBSP = re.compile(rf"(?<=[ {_LOW}])Ã (?=[{_LOW}])")


def _reread(text: str, codec: str) -> str:
    pattern, to_byte = _READERS[codec]
    if codec in ("cp1252", "latin-1") and "Ã " in text:
        text = _LOST_NBSP.sub("Ã\xa0", text)

    def fix(m: re.Match[str]) -> str:
        try:
            out = bytes(to_byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        return out if _EXPECTED.fullmatch(out) else m.group()

    return pattern.sub(fix, text)


Score = Callable[[str], float]


def plain_score(text: str) -> float:
    """Score without a trained model: characters outside the clean alphabet, and letters of odd case, cost."""
    return -4.0 * (len(_FOREIGN.findall(text)) + len(_ODD.findall(text)))


_FOREIGN = re.compile(rf"[^\x00-\x7e{re.escape(CLEAN)}]")
_ODD = re.compile(rf"[{_LOW}][·±ÁÉÍÓÚÑÀÇÃÕÂÊÔªº°](?=[{_LOW} ,.;:?!”»)]|$)|[ÃÂ][\xa0-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]|(?<= )[ÚÓ](?= [{_LOW}])")


def _chains(text: str, steps: list[Callable[[str], str]], length: int) -> list[str]:
    """Everything that chains of up to ``length`` steps make of ``text``, each once, in order of discovery; what isn't suspicious any more goes no further."""
    seen, front = {text}, [text]
    out: list[str] = []
    for _ in range(length):
        front = [c for t in front if t is text or SUSPICIOUS.search(t) for c in dict.fromkeys(step(t) for step in steps) if c not in seen and not seen.add(c)]
        out += front
    return out


_REREADS: list[Callable[[str], str]] = [lambda t, c=c: _reread(t, c) for c in READ_AS]
_STEPS: list[Callable[[str], str]] = [*_REREADS, *(lambda t, m=m: t.translate(m) for m in _SWAPS)]


@lru_cache(KEPT_CHAINS)
def _token_chains(token: str) -> tuple[str, ...]:
    return tuple(_chains(token, _STEPS, TOKEN_CHAIN))


def _likeliest(candidates: list[str], text: str, score: Score, margin: float, left: str = "", right: str = "") -> str:
    """The candidate of the highest score if it exceeds that of ``text`` by the margin, else ``text``; the first of equals."""
    if not candidates:
        return text
    have = score(left + text + right)
    best, gain = text, margin
    for cand in candidates:
        more = score(left + cand + right) - have
        if more > gain:
            best, gain = cand, more
    return best


def _tokens(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(position, all parts, last character before with a blank) of the tokens that aren't ASCII."""
    parts = _SPLIT.split(text)
    for k, part in enumerate(parts):
        if part and not part.isascii():
            yield k, parts, (parts[k - 2][-1:] + " " if k > 1 else " ")


def repair(text: str, score: Score = plain_score, margin: float = 2.0) -> tuple[str, bool, bool]:
    """The likeliest original, whether anything was repaired, and whether unrecoverable damage remains inside."""
    if not SUSPICIOUS.search(text):
        return text, False, False
    before = text
    text = _likeliest(_chains(text, _REREADS, CHAIN), text, score, margin)
    if SUSPICIOUS.search(text):
        parts: list[str] = []
        for k, parts, left in _tokens(text):  # noqa: B007
            parts[k] = _likeliest(_chains(parts[k], _STEPS, TOKEN_CHAIN), parts[k], score, margin, left, " ")
        text = "".join(parts) or text
    body = END_MARK.sub("", text)
    lost = any(m.end() < len(body) for m in _LOST.finditer(body))
    return text, text != before, lost


@lru_cache(64)
def repaired(text: str) -> str:
    """``text`` as ``repair`` restores it without a model; the last texts are kept, as several steps look at one text."""
    return repair(text)[0]


class CharModel:
    """Smoothed character n-gram model (interpolated over orders 1 to 3) from counts of trigrams, with the validated margin."""

    def __init__(self, trigrams: dict[str, int], margin: float = 2.0):
        pairs: Counter[str] = Counter()
        single: Counter[str] = Counter()
        follow: Counter[str] = Counter()
        for g, c in trigrams.items():
            pairs[g[1:]] += c
            follow[g[:2]] += c
            single[g[2]] += c
        start: Counter[str] = Counter()
        for g, c in pairs.items():
            start[g[0]] += c
        total = sum(single.values()) + 1
        self.floor = math.log(1e-6)
        self.logp = {g: math.log(0.7 * c / follow[g[:2]] + 0.2 * pairs[g[1:]] / start[g[1]] + 0.1 * single[g[2]] / total) for g, c in trigrams.items()}
        self.pairs = {g: math.log(0.1 * c / start[g[0]]) for g, c in pairs.items()}
        self.single = {g: math.log(0.01 * c / total) for g, c in single.items()}
        self.margin = margin
        self.gains: dict[tuple[str, str], float] = {}

    def score(self, text: str) -> float:
        t, logp, pairs, single, floor = f"  {text} ", self.logp, self.pairs, self.single, self.floor
        out = 0.0
        for i in range(len(t) - 2):
            g = t[i : i + 3]
            v = logp.get(g)
            if v is None:
                v = pairs.get(g[1:])
                if v is None:
                    v = single.get(g[2], floor) - 1
            out += v
        return out

    def gain(self, text: str) -> float:
        """The most that any chain, over the text or over one of its tokens, gains on ``text``."""
        if text.isascii():
            return 0.0
        out = self._most(_chains(text, _REREADS, CHAIN), text)
        for k, parts, left in _tokens(text):
            out = max(out, self.token_gain(left, parts[k]))
        return out

    def token_gain(self, left: str, token: str) -> float:
        """The most that any chain over ``token`` gains after ``left``; the last ones are kept, as texts share most of their tokens."""
        if len(token) > KEPT_LENGTH:
            return self._most(_chains(token, _STEPS, TOKEN_CHAIN), token, left, " ")
        have = self.gains.get((left, token))
        if have is None:
            if len(self.gains) >= KEPT_GAINS:
                self.gains.clear()
            have = self.gains[left, token] = self._most(_token_chains(token), token, left, " ")
        return have

    def _most(self, candidates: Iterable[str], text: str, left: str = "", right: str = "") -> float:
        if not candidates:
            return 0.0
        have = self.score(left + text + right)
        return max(0.0, *(self.score(left + c + right) - have for c in candidates))


def trigram_counts(texts: Iterable[pd.Series]) -> Counter[str]:
    """Counts of the trigrams of texts, each with two blanks before it and one behind; counted in bulk."""
    out: Counter[int] = Counter()
    for series in texts:
        joined = "".join(f"  {t} \0" for t in series)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if len(cp) < 3:
            continue
        grams = (cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:]
        grams = grams[(cp[:-2] > 0) & (cp[1:-1] > 0) & (cp[2:] > 0)]
        values, counts = np.unique(grams, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            out[v] += c
    return Counter({chr(v >> 42) + chr(v >> 21 & 0x1FFFFF) + chr(v & 0x1FFFFF): c for v, c in out.items()})


def _fit(texts: DataFrame, part: Column, parts: Iterable[int], whole: bool) -> CharModel:
    """Model of the clean records of ``texts`` (``t``), or but for ``parts`` if not ``whole``, with a margin validated on those of ``parts``.

    The records of each of ``parts`` are judged by a model of all other records. The margin lies above every gain that a
    chain reaches on them, but for one in a thousand (to ``GAIN_STEP``). Trigrams with a zero character are left out. Clean
    records have few different characters, which bounds the number of trigrams.
    """
    clean = texts.select("t", part.alias("parte")).where(~F.col("t").rlike(SUSPICIOUS.pattern))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[int, Counter[str]] = {}
        records: Counter[int] = Counter()
        for pdf in batches:
            for k, own in pdf.groupby("parte")["t"]:
                by.setdefault(k, Counter()).update(trigram_counts([own]))
                records[k] += len(own)
        yield pd.DataFrame([(k, g, n) for k, own in by.items() for g, n in own.items()] + [(k, "", n) for k, n in records.items()], columns=["parte", "g", "n"])

    counted: dict[int, dict[str, int]] = {}
    for r in clean.mapInPandas(count, "parte int, g string, n long").groupBy("parte", "g").agg(F.sum("n").alias("n")).collect():
        counted.setdefault(r.parte, {})[r.g] = r.n
    records = {k: own.pop("", 0) for k, own in counted.items()}  # stands for the number of records

    def model(left_out: set[int]) -> CharModel:
        total: Counter[str] = Counter()
        for k, own in counted.items():
            if k not in left_out:
                total.update(own)
        return CharModel(total or {"   ": 1})

    judges = {k: model({k}) for k in parts}

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter[int] = Counter()
        for pdf in batches:
            out.update(math.ceil(judges[k].gain(t) / GAIN_STEP) for k, t in zip(pdf["parte"], pdf["t"], strict=True))
        yield pd.DataFrame(list(out.items()), columns=["paso", "n"])

    # nothing is gained on ASCII
    asked = clean.where(F.octet_length("t") > F.length("t")).where(F.col("parte").isin(*judges))
    reached = asked.mapInPandas(gains, "paso long, n long").groupBy("paso").agg(F.sum("n").alias("n")).collect()
    steps = sorted([(round(2.0 / GAIN_STEP), 1), *((r.paso, r.n) for r in reached)])
    above = int(0.001 * sum(records.get(k, 0) for k in judges))
    out = model(set() if whole else set(judges))
    while steps and above >= steps[-1][1]:
        above -= steps.pop()[1]
    out.margin = max(2.0, steps[-1][0] * GAIN_STEP + 0.5 if steps else 2.0)
    return out


def train(texts: DataFrame, text_col: str) -> CharModel:
    """One split: trained on all clean records of ``texts`` but about ``VALIDATION_ROWS`` held-out ones (by hash of the text), which set the margin."""
    texts = texts.select(F.col(text_col).alias("t"))
    share = min(0.5, VALIDATION_ROWS / max(texts.count(), 1))
    held = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)
    return _fit(texts, F.when(held, 0).otherwise(1), [0], whole=False)


def train_whole(texts: DataFrame, text_col: str) -> CharModel:
    """Trained on all clean records of ``texts``, with a margin validated on all of them by ``PARTS`` parts; equal texts are in one part."""
    texts = texts.select(F.col(text_col).alias("t"))
    return _fit(texts, F.pmod(F.xxhash64("t", F.lit(7)), F.lit(PARTS)).cast("int"), range(PARTS), whole=True)


SCHEMA = "texto_original string, recuperado boolean, perdido boolean"


def repair_texts(df: DataFrame, id_col: str, text_col: str, model: CharModel) -> DataFrame:
    """Affected rows of ``df``: id, the restored text, whether it was repaired and whether damage remains.

    Rows without any suspicious character never leave the JVM.
    """
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [repair(t, model.score, model.margin) for t in pdf["__text"]]
            res = pd.DataFrame(out, columns=["texto_original", "recuperado", "perdido"])
            res.insert(0, "__id", pdf["__id"].to_numpy())
            yield res[res.recuperado.astype(bool) | res.perdido.astype(bool)]

    return (
        df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .where(F.col("__text").isNotNull() & F.col("__text").rlike(SUSPICIOUS.pattern))
        .mapInPandas(scan, f"__id {kind}, {SCHEMA}")
        .withColumnRenamed("__id", id_col)
    )


def p6_repaired(evidencias: DataFrame, prospectos: DataFrame) -> DataFrame:
    """Affected rows of both tables with the restored text."""
    both = evidencias.select(F.col("cita_textual").alias("t")).unionByName(prospectos.select(F.col("discurso_corporativo").alias("t")))
    model = train_whole(both, "t")
    a = repair_texts(evidencias, "id", "cita_textual", model).withColumn("tabla", F.lit("evidencias"))
    b = repair_texts(prospectos, "id", "discurso_corporativo", model).withColumn("tabla", F.lit("prospectos"))
    return a.unionByName(b)


def p6_found(evidencias: DataFrame, prospectos: DataFrame) -> DataFrame:
    """(``tabla``, ``id``) of the rows that were wholly or partly decoded wrongly, recoverable or not."""
    return p6_repaired(evidencias, prospectos).select("tabla", "id")
