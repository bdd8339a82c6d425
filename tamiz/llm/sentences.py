"""Sentence boundaries across languages and scripts (problem 10).

A text is cut into blocks at blank lines and into list items; the remaining paragraphs are segmented by semi-Markov
dynamic programming: whole spans between candidate boundaries are scored by their closing word (does it end sentences,
or is it an abbreviation?), by the opening word of what follows, by their length, and by whether quotations and
brackets are balanced inside; the best sequence of spans wins. How often words open and close paragraphs, and how often
a word with a full stop is followed by more of the sentence, is counted over all documents, as if there
were ``MODEL_DOCS``. Thai, which has no full stop, is cut at spaces except beside numbers and between Latin words.

Offsets count code points; ``fin`` is exclusive; surrounding white space and a leading byte-order mark are left out.
Null, empty and blank texts have no rows; repeated texts give the same rows for each document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Documents to which counts of words are brought, so that scores depend on shares and not on the size of the input.
MODEL_DOCS = 20_000
#: Least share of the documents in which a counted word occurs.
WORD_SHARE = 1e-5

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Abbreviations after which a sentence goes on (without the last full stop, lower case).
NEVER_FINAL = frozenset(
    "sr sra srta sres dr dra lic ing arq mtro mtra prof profa gral mr mrs ms st sto sta fr d dña ud uds núm num no nº n pág pag págs "
    "p pp art arts frac fracc fig figs cap caps vol vols ed eds tel av avda blvd cf vs v approx aprox i.e e.g p. ej ej p.ej ee exmo exma "
    "eng sec inc.º ca cca máx mín min max jr sr.ª डॉ पृ श्री सं د ص أ م".split()
)
#: Abbreviations that may also end one.
MAY_FINAL = frozenset("etc s.a s.l s.a.s inc ltd ltda co corp cía cia c.v r.l uu u.s u.s.a u.k m p.m a.m a.c d.c".split())
SPEECH_ZH = re.compile(r"(?:说|表示|补充道|解释说|指出|认为|说道|强调|称|回应|透露)。$")
# ---- end of the fixed values --------------------------------------------------------------------------------------

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_ITEM = re.compile(r"[ \t﻿]*(?:[-*•·▪‣–]|(\d{1,3})[.)]|[a-zA-Z]\))[ \t]+(?=\S)")
_THAI = re.compile("[฀-๿]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_END = re.compile(r"([.!?…。！？।؟۔｡]+)([\"”»’)\]」』）】》]*)")
_OPEN = "“«([「『（【《"
_CLOSE = "”»)]」』）】》"
_PAIR = {c: k for k, pair in enumerate(zip(_OPEN, _CLOSE, strict=True)) for c in pair}
_BRACKETS = re.compile("[“”«»()\\[\\]「」『』（）【】《》\"]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_TOKEN_BACK = re.compile(r"[^\s“”«»()\[\]¿¡\"]+$")
_WORD_AHEAD = re.compile(r"[\"“«(\[¿¡—–\-'‘「『（]*([^\W_][\w’'.-]*)?")
_URL = re.compile(r"(?:https?://|www\.)\S*$|\S+@\S*$")

Span = tuple[int, int]


class SentenceModel:
    """Counts of words at paragraph ends and starts, and of words whose full stop is followed by more of the sentence."""

    def __init__(self) -> None:
        self.opens: Counter[str] = Counter()
        self.closes: Counter[str] = Counter()
        self.goes_on: Counter[str] = Counter()

    def learn(self, text: str) -> None:
        for a, b, kind in blocks(text):
            part = text[a:b]
            if kind != "paragraph":
                continue
            first = _WORD_AHEAD.match(part)
            if first and first.group(1):
                self.opens[first.group(1)] += 1
            last = None
            for m in _END.finditer(part):
                last = m
                after = part[m.end() : m.end() + 2].lstrip()
                if after[:1].islower() or after[:1] in ",;:":
                    self.goes_on[_before(part, m.start())] += 1
            if last and last.end() == len(part):
                self.closes[_before(part, last.start())] += 1

    def prune(self) -> SentenceModel:
        for name in ("opens", "closes", "goes_on"):
            setattr(self, name, Counter({w: n for w, n in getattr(self, name).items() if n >= 2}))
        return self

    def close_score(self, word: str) -> float:
        on, end = self.goes_on[word], self.closes[word]
        return max(-4.0, min(1.5, math.log((end + 1) / (on + 1)))) if on or end else 0.0

    def open_score(self, word: str) -> float:
        return min(1.5, 0.3 * math.log1p(self.opens[word]))


def _before(text: str, at: int) -> str:
    """The token before a full stop, lower case, with its inner full stops."""
    m = _TOKEN_BACK.search(text, max(0, at - 40), at)
    return m.group().lower() if m else ""


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Paragraphs and list items with their offsets, without surrounding white space."""
    start: int | None = None
    end = 0
    kind = "paragraph"
    number = 0
    prev_last = ""
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        line = text[a:b].strip("﻿ \t\r\n\f\v\xa0　")
        if not line:
            if start is not None:
                yield from _trim(text, start, end, kind)
            start, number = None, 0
            continue
        item = _ITEM.match(text, a, b)
        if item and start is not None:
            n = item.group(1)
            if n:
                item = item if int(n) == number + 1 and (kind == "item" or _ends(prev_last)) else None
            elif kind != "item" and not _ends(prev_last):
                item = None if text[item.start() : item.end()].strip()[:1].isalpha() else item
        if item:
            if start is not None:
                yield from _trim(text, start, end, kind)
            start, kind = a, "item"
            number = int(item.group(1)) if item.group(1) else 0
        elif start is None:
            start, kind = a, "paragraph"
        elif kind == "item" and _ends(prev_last):
            yield from _trim(text, start, end, kind)
            start, kind, number = a, "paragraph", 0
        end = b
        prev_last = line
    if start is not None:
        yield from _trim(text, start, end, kind)


def _ends(line: str) -> bool:
    """Whether a line ends like a sentence or an introduction of a list."""
    if line.endswith(":"):
        return True
    m = None
    for m in _END.finditer(line):
        pass
    return bool(m) and m.end() == len(line) and _before(line, m.start()) not in NEVER_FINAL


def _trim(text: str, a: int, b: int, kind: str) -> Iterator[tuple[int, int, str]]:
    while a < b and (text[a].isspace() or text[a] == "﻿"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] == "﻿"):
        b -= 1
    if a < b:
        yield a, b, kind


def _thai(text: str, a: int, b: int) -> list[Span]:
    out, start = [], a
    for m in re.compile(r"\s+|(?<=[?!])(?=\S)").finditer(text, a, b):
        left, right = text[m.start() - 1], text[m.end()]
        if m.start() < m.end():
            if left.isdigit() or right.isdigit() or (_LATIN.match(left) and _LATIN.match(right)):
                continue
            if left in ",:;(" or right in "”»),;:":
                continue
        elif not _THAI.match(right) and not right.isupper():
            continue
        out.append((start, m.start()))
        start = m.end()
    out.append((start, b))
    return out


def _candidates(text: str, a: int, b: int, model: SentenceModel) -> list[tuple[int, int, float]]:
    """(end, start of the next, score) of each place inside the block where a sentence could end."""
    out = []
    for m in _END.finditer(text, a, b):
        end = m.end()
        nxt = end
        while nxt < b and text[nxt].isspace():
            nxt += 1
        if nxt >= b:
            continue
        marks, closers = m.group(1), m.group(2)
        c = text[nxt]
        spaced = nxt > end
        word = _WORD_AHEAD.match(text, nxt, b).group(1) or ""
        head = _WORD_AHEAD.match(text, nxt, b)
        first = text[head.start(1)] if head.group(1) else c
        if c in ",;:、，；：）)]」』”»…?!.。！？":
            continue
        wide = marks[-1] in "。！？｡"
        camel = bool(re.match(r"[a-z][A-Z]", word))
        if first.islower() and not camel and not wide and ord(first) < 0x250:
            continue
        if marks[0] == "." and len(marks) == 1:
            before = _before(text, m.start())
            bare = before.lstrip("(—-–'‘")
            if not spaced and not closers:
                if not (first.isupper() and len(bare) >= 3 and bare.isalpha() and not _URL.search(text[max(a, m.start() - 200) : m.start()])):
                    continue
                if bare in NEVER_FINAL:
                    continue
            # a unit after a figure ends sentences like any word
            unit = len(bare) <= 3 and re.search(rf"[\d⁰-₉%°][ \xa0]{re.escape(bare)}$", text[max(a, m.start() - 6) : m.start()], re.I)
            if unit and (first.isupper() or c in "¿¡“«—("):
                score = 3.0
            elif bare in NEVER_FINAL:
                score = -8.0
            elif bare in MAY_FINAL:
                score = 1.5
            elif len(bare) == 1 and bare.isalpha() and text[m.start() - 1].isupper():
                score = 3.0 if c in "¿¡“«—(" else -7.0
            elif re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", bare):
                score = 0.5
            else:
                score = 3.0
            score += model.close_score(before) * (0.5 if score > 0 else 0.0)
        elif set(marks) <= set(".…"):
            if _CJK.match(c) and not closers:
                score = -4.0
            else:
                score = 2.0 if first.isupper() or c in "¿¡“«—" or not first.isalpha() else 0.5
        elif not spaced and not wide and not closers:
            if not (first.isupper() or c in "¿¡“«—" or _CJK.match(c)) or _URL.search(text[max(a, m.start() - 200) : m.start()]):
                continue
            score = 3.0
        else:
            score = 4.0
        if c in "—–" and head.group(1) and first.islower():
            continue
        if wide and closers and c in "とっとのとい":
            continue
        if camel and not model.opens[word] and not model.opens:
            score -= 1.0
        score += model.open_score(word)
        out.append((end, nxt, score))
    return out


def _balance(text: str, a: int, cuts: list[int]) -> list[tuple[int, ...]]:
    """Open quotations and brackets of each kind before each cut."""
    depth = [0] * (len(_OPEN) + 1)
    out, pos = [], a
    for cut in cuts:
        for m in _BRACKETS.finditer(text, pos, cut):
            c = m.group()
            if c == '"':
                depth[-1] ^= 1
            elif c in _OPEN:
                depth[_PAIR[c]] += 1
            elif depth[_PAIR[c]]:
                depth[_PAIR[c]] -= 1
        pos = cut
        out.append(tuple(depth))
    return out


#: Scores of a span: unbalanced quotation or bracket; a quotation alone whose speaker follows; excess length per character.
UNBALANCED, SPEAKER_FOLLOWS, LONG_FROM, LONG = -7.0, -12.0, 600, 0.004


def _quote_begins_sentence(text: str, a: int, end: int) -> bool:
    """Whether the quotation that closes at ``end`` opened where a sentence can begin, and not after an introduction."""
    q = text.rfind(_OPEN[_PAIR[text[end - 1]]], a, end - 1)
    before = text[a:q].rstrip() if q > a else ""
    return q >= 0 and (not before or before[-1] in "。！？!?.…”」』")


def _paragraph(text: str, a: int, b: int, model: SentenceModel) -> list[Span]:
    cand = _candidates(text, a, b, model)
    if not cand:
        return [(a, b)]
    starts = [a] + [n for _, n, _ in cand]
    ends = [e for e, _, _ in cand] + [b]
    scores = [s for _, _, s in cand] + [0.0]
    depth = _balance(text, a, [a, *ends])
    best = [0.0] + [-math.inf] * len(ends)
    top = [0.0] * (len(ends) + 1)
    back = [0] * (len(ends) + 1)
    for j in range(1, len(ends) + 1):
        end, gain = ends[j - 1], scores[j - 1]
        if j < len(ends) and text[end - 1] in "”」』" and _CJK.search(text, starts[j - 1], end) and text[starts[j]] not in _OPEN:
            if SPEECH_ZH.search(text[starts[j] : ends[j]]) and _quote_begins_sentence(text, a, end):
                gain += SPEAKER_FOLLOWS
        for i in range(j - 1, -1, -1):
            length = end - starts[i]
            penalty = LONG * max(0, length - LONG_FROM)
            if top[i] + gain - penalty <= best[j]:
                break  # longer spans only lose: exact
            v = best[i] + gain - penalty
            if depth[i] != depth[j]:
                v += UNBALANCED
            if v > best[j]:
                best[j], back[j] = v, i
        top[j] = max(top[j - 1], best[j])
    out, j = [], len(ends)
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def sentences(text: str | None, model: SentenceModel) -> list[Span]:
    """Spans of the sentences of a text."""
    if not text:
        return []
    out: list[Span] = []
    for a, b, kind in blocks(text):
        if kind == "item":
            out.append((a, b))
            continue
        thai = len(_THAI.findall(text, a, b))
        if thai and thai > len(_LATIN.findall(text, a, b)):
            out += _thai(text, a, b)
        else:
            out += _paragraph(text, a, b, model)
    return out


def fit(documents: DataFrame, key: str, text_col: str) -> SentenceModel:
    """Count openers and closers over all documents, by word in the cluster, and bring the counts to ``MODEL_DOCS`` documents.

    A word must occur twice and in ``WORD_SHARE`` of the documents, so that what reaches the driver is bounded.
    """
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    docs = texts.count()
    least = max(2, math.ceil(WORD_SHARE * docs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = SentenceModel()
        for pdf in batches:
            for t in pdf["t"]:
                m.learn(t)
        rows = [(k, w, n) for k, c in (("o", m.opens), ("c", m.closes), ("g", m.goes_on)) for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["k", "w", "n"])

    model = SentenceModel()
    named = {"o": model.opens, "c": model.closes, "g": model.goes_on}
    for r in texts.mapInPandas(count, "k string, w string, n long").groupBy("k", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect():
        named[r.k][r.w] = r.n * MODEL_DOCS / docs
    return model


def split_documents(documents: DataFrame, key: str, text_col: str, model: SentenceModel) -> DataFrame:
    """(key, ``inicio``, ``fin``) of every sentence. Other columns are dropped."""
    kind = dict(documents.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, a, b = [], [], []
            for i, t in zip(pdf["__id"], pdf["__text"], strict=True):
                for x, y in sentences(t, model):
                    ids.append(i)
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"__id": pd.Series(ids, dtype=pdf["__id"].dtype), "inicio": pd.Series(a, dtype="int64"), "fin": pd.Series(b, dtype="int64")})

    return (
        documents.select(F.col(key).alias("__id"), F.col(text_col).alias("__text"))
        .where(F.col("__text").isNotNull())
        .mapInPandas(scan, f"__id {kind}, inicio long, fin long")
        .withColumnRenamed("__id", key)
    )


def p10_found(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``inicio``, ``fin``) of every sentence of every document."""
    return split_documents(documents, "doc_id", "text", fit(documents, "doc_id", "text"))
