"""Page boilerplate mixed with main content (problem 3).

A page is a sequence of lines. Words score by weights fitted on labelled lines (log-odds of body against furniture,
smoothed), and the marks of page furniture (separators of menus, link lists, copyright signs, telephone numbers ...)
score negative like tags. A linear scan finds the maximum-scoring contiguous region of lines; inside it, lines whose own
score is clearly negative (notices, share bars, side blocks) are cut out as well.

The lines are labelled by a grammar of furniture line types (high precision, below); the fitted weights carry over to
furniture that the grammar does not know. The fit uses a bounded sample of pages (``FIT_PAGES``).

Null and blank texts have no lines. A page of furniture only has no body: all its lines are furniture.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.sampling import bounded_sample
from tamiz.llm.textutil import WORD, fold

#: Pages of the sample on which word weights are fitted.
FIT_PAGES = 20_000

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Words of menus, folded.
MENU_WORDS = (
    "inicio|menu|nosotros|quienes somos|equipo|blog|prensa|sala de prensa|clientes|productos|soluciones|servicios|recursos|precios|"
    "contacto|ayuda|eventos|carreras|portafolio|inversionistas|sostenibilidad|mi cuenta|iniciar sesion|buscar|solicita una demo|es / en|"
    "pt / en|en / es|home|about|about us|team|press|newsroom|customers|products|solutions|services|resources|pricing|contact|help|events|"
    "careers|portfolio|investors|sustainability|my account|log in|sign in|search|get a demo|sobre nos|sobre|equipe|imprensa|produtos|"
    "solucoes|servicos|precos|contato|ajuda|carreiras|investidores|sustentabilidade|minha conta|entrar|peca uma demo|idioma|noticias|news|recursos humanos"
)
COOKIE = (
    r"\bcookies?\b.*(?:medir|recordar|personalizar|analitic|audiencia|consulta|acept|rechaz|config|tailor|measure|remember|policy|reject|accept|preferenc|politica|opt out|lembrar)"
    r"|(?:nosotros|nos|we) (?:y|e|and) (?:nuestros |our )?\d+ (?:socios|parceiros|partners) (?:guardamos|guardam|armazen|store)"
    r"|^(?:tu|sua|your) (?:privacidad|privacidade|privacy) (?:nos )?(?:importa|matters)"
)
BUTTONS = (
    "aceptar todas|aceptar todo|aceptar y cerrar|aceptar|rechazar|rechazar todas|solo necesarias|configurar|gestionar|aceitar tudo|aceitar|"
    "recusar|preferencias|so o necessario|accept all|accept|reject|reject all|manage choices|got it|only necessary|settings|enviar|suscribirme|"
    "submit|subscribe|assinar|tu correo electronico|tu correo|seu e-?mail|your email|leer mas|read more|ver mas|cerrar|close"
)
WHOLE_LINES = (
    r"(?:saltar al contenido|skip to (?:main )?content|ir para o conteudo|ir al contenido)",
    r"(?:volver arriba|voltar ao topo|back to top|subir)",
    r"(?:siguenos|follow us|siga-nos|sigam-nos)(?: en redes| nas redes| on social media)?",
    r"(?:suscribete|sign up|assine|inscreva-se|subscribe)\b.{0,70}",
    r"(?:dejanos tu correo|deixe seu e-?mail|leave your email).{0,60}",
    r"(?:compartir|compartilhe|compartilhar|share)\b(?: this)?:?[^.]{0,50}",
    r"(?:etiquetas|tags|temas|marcadores|filed under|topics):? [^.]{0,140}",
    r"\d+ (?:comentarios|comments)\b.{0,40}",
    r"(?:tiempo de lectura:?|leitura de|lectura de) \d+ ?min(?:utos)?|\d+ min(?:utos)? (?:read|de lectura|de leitura)",
    r"ver (?:las |as )?\d+ fotos|see (?:all )?\d+ photos|(?:veja|ver) as \d+ fotos",
    r"(?:vacantes abiertas|vagas abertas|open roles|open positions) \(\d+\)",
    r"[-—– ]*(?:anuncio|publicidad|publicidade|advertisement|anuncio publicitario|contenido patrocinado|conteudo patrocinado|sponsored(?: content)?)[-—– ]*",
    r"(?:chatea con nosotros|fale conosco|chat with us).{0,50}",
    r"(?:sitio desarrollado por|site desenvolvido por|powered by|desarrollado por|site by|hecho por)\b.{0,60}",
    r"(?:activa|ative|enable) java ?script para uma? .*|activa java ?script para una mejor experiencia",
    r"(?:tel|telefono|telefone|phone|fax)\b[. :]*\+?[\d ()+-]{6,}",
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    r"(?:calle|blvd|av|avenida|rua|street|carrera|paseo|plaza|praca|calz|r)\b\.? [\w' ]{2,40} \d+,? ?[\w ]{0,40}",
    r"(?:©|\(c\)|copyright)\s*(?:\d{4}).{0,90}",
    r".{2,60}[®©] ?\d{4}\b.{0,60}",
    r"(?:aviso de privacidad|politica de privacidade?|privacy|terminos y condiciones|termos de uso|terms|mapa del sitio|sitemap|mapa do site|aviso legal|legal)(?:[ |·•/-]+(?:aviso de privacidad|politica de privacidade?|privacy|privacy policy|terminos y condiciones|termos de uso|terms|terms of use|mapa del sitio|mapa do site|sitemap|aviso legal|legal))+",
    r"(?:pagina|page) \d+ (?:de|of) \d+",
    r"(?:imprimir|print|descargar pdf|download pdf)",
    r"contato@.*",
)
RELATED = r"(?:relacionad[oa]s|contenido relacionado|lo mas leido|mas leidas|te puede interesar|tambien en este sitio|tambem neste site|leia tambem|mais lidas|veja tambem|related stories|related|most read|also on this site|you may also like|articulos relacionados|notas relacionadas|voce tambem pode gostar)"
# ---- end of the fixed values --------------------------------------------------------------------------------------

_SEP = r"[ \t]*(?:[|·•/>»]|  |\t|,|:| - )[ \t]*"
_MENU = re.compile(rf"[☰≡ :]*(?:{MENU_WORDS})(?:[ |·•/>»:☰≡-]+(?:{MENU_WORDS}))*[ ☰≡:]*")
_CRUMB = re.compile(rf"(?:{MENU_WORDS})(?: ?[>»/|·•] ?(?:{MENU_WORDS}))* ?[>»/] ?[^.>»/]{{2,60}}")
_COOKIE = re.compile(COOKIE)
_BUTTON = re.compile(rf"(?:{BUTTONS})(?:[ ✕x|·/.]+(?:{BUTTONS}))*[ ✕x.]*")
_WHOLE = re.compile("(?:" + "|".join(WHOLE_LINES) + r")[ ↑✕.:]*")
_ANY = re.compile("|".join(f"(?:{p.pattern})" for p in (_MENU, _CRUMB, _BUTTON, _WHOLE)))
_RELATED = re.compile(RELATED + r"[:. ]*")
_BULLET = re.compile(r"\s*[-*•–]\s")
_NUMBERED = re.compile(r"\s*\d{1,2}[.)]\s")
_END = re.compile(r"[.!?…。][”»\"')\]]*\s*$")


def is_furniture_line(line: str) -> bool:
    """Whether the grammar of furniture line types covers the line. Lines of furniture come again on many pages, so the last ones are kept."""
    return _furniture(line) if len(line) < SHORT else _furniture.__wrapped__(line)


@lru_cache(1 << 15)
def _furniture(line: str) -> bool:
    f = folded(line)
    if not f:
        return False
    if _ANY.fullmatch(f) or _RELATED.fullmatch(f):
        return True
    return len(f) < 220 and ("cookie" in f or "privaci" in f or "privacy" in f or "soci" in f or "partner" in f or "parceir" in f) and bool(_COOKIE.search(f)) and not speaks_of_notices(line, f)


#: Lines up to this length are kept when they were judged, as furniture is short.
SHORT = 240
_folded = lru_cache(1 << 15)(fold)


def folded(line: str) -> str:
    """The folded line; each is asked for several times."""
    return _folded(line) if len(line) < SHORT else fold(line)


#: Words by which a notice addresses the reader or names its own page, folded.
_READER = re.compile(r"\b(?:tu|tus|nosotros|nos|nuestr[oa]s?|usamos|utilizamos|empleamos|este sitio|este site|esta pagina|seu|sua|seus|suas|voce|nosso|nossa|we|our|your|you|this (?:site|website|page))\b")
#: A capitalised word inside a sentence.
_NAMED = re.compile(r"(?<=[^\s.!?…:;] )[A-ZÁÉÍÓÚÑÂÊÔÃÕÇ][\w'’]+")


def speaks_of_notices(line: str, folded: str) -> bool:
    """Whether a line about notices is a sentence on somebody: it names someone and doesn't address the reader."""
    return bool(_NAMED.search(line)) and not _READER.search(folded)


def looks_like_content(line: str) -> bool:
    """Whether a line that is no known furniture reads as content: a sentence, a list item, or many words."""
    words = WORD.findall(line)
    return len(words) >= 7 or (len(words) >= 4 and bool(_END.search(line))) or bool(_BULLET.match(line) and len(words) >= 3)


class LineModel:
    """Word weights: smoothed log-odds of body against furniture."""

    def __init__(self, body: Counter[str], furniture: Counter[str]):
        nb, nf = sum(body.values()) + 1, sum(furniture.values()) + 1
        vocab = set(body) | set(furniture)
        self.weight = {}
        for w in vocab:
            b, f = body[w], furniture[w]
            if b + f >= 5:
                self.weight[w] = max(-4.0, min(4.0, math.log((b + 0.5) / nb) - math.log((f + 0.5) / nf)))

    def line_score(self, line: str) -> float:
        """Sum of word weights and of the negative marks of furniture, about per word, so that no line outweighs a page."""
        words = WORD.findall(folded(line))
        if not words:
            return 0.0
        score = sum(self.weight.get(w, 0.15) for w in words)
        marks = sum(line.count(c) for c in "|·»>©®☰≡✕↑✉#@")
        score -= 2.5 * marks
        if _END.search(line) and len(words) >= 4:
            score += 3.0
        if _BULLET.match(line) and len(words) >= 3:
            score += 2.0
        return score


def scored_lines(lines: list[str], model: LineModel) -> list[float]:
    """Score of each line; 0 for blank ones. Grammar hits are negative whatever their words; so are the items under a header of related stories."""
    out: list[float] = []
    related = False
    for line in lines:
        s = line.strip()
        if not s:
            out.append(0.0)
            continue
        if _RELATED.fullmatch(folded(s)):
            related = True
            out.append(FURNITURE)
            continue
        if is_furniture_line(s):
            related = False
            out.append(FURNITURE)
            continue
        if related:
            words = len(WORD.findall(s))
            if words >= 6 and not _BULLET.match(s) and (_NUMBERED.match(s) or not _END.search(s)):
                out.append(FURNITURE)
                continue
            related = False
        v = model.line_score(s)
        words = len(WORD.findall(s))
        if words <= 6 and not _END.search(s):  # headings and unknown menu entries
            v = 1.0 if v >= -1.5 * words and not (words == 1 and v < 0) else FURNITURE
        out.append(max(-12.0, min(40.0, v)))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of lines with the greatest sum, by one linear scan; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += v
        if total > best:
            best, region = total, (start, k + 1)
    return region


def furniture_lines(text: str, model: LineModel) -> list[int]:
    """Numbers of the lines of ``text`` that are not part of the main body; blank lines never are."""
    from tamiz.llm.encoding import repaired

    lines = repaired(text).split("\n")
    if len(lines) != text.count("\n") + 1:
        lines = text.split("\n")
    scores = scored_lines(lines, model)
    a, b = best_region(scores)
    return [k for k, line in enumerate(lines) if line.strip() and (not a <= k < b or scores[k] <= HOLE)]


#: Score of a line that the grammar knows as furniture: small, so that a notice between two paragraphs doesn't part the body.
FURNITURE = -2.5
#: A line inside the region with this score or less is cut out.
HOLE = -2.0


def fit(pages: DataFrame, key: str, text_col: str) -> LineModel:
    """Fit word weights on lines labelled by the grammar, over a bounded sample of ``FIT_PAGES`` pages chosen by hash."""
    sample = bounded_sample(pages.where(F.col(text_col).isNotNull()), key, FIT_PAGES).select(F.col(text_col).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        body: Counter[str] = Counter()
        furniture: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["t"]:
                for line in text.split("\n"):
                    s = line.strip()
                    if not s:
                        continue
                    if is_furniture_line(s):
                        furniture.update(WORD.findall(folded(s)))
                    elif looks_like_content(s):
                        body.update(WORD.findall(folded(s)))
        rows = [(w, body[w], furniture[w]) for w in set(body) | set(furniture)]
        yield pd.DataFrame(rows, columns=["w", "b", "f"])

    words = (
        sample.mapInPandas(count, "w string, b long, f long")
        .groupBy("w")
        .agg(F.sum("b").alias("b"), F.sum("f").alias("f"))
        .where(F.col("b") + F.col("f") >= 5)
        .collect()
    )
    return LineModel(Counter({r.w: r.b for r in words}), Counter({r.w: r.f for r in words}))


def furniture_of_pages(pages: DataFrame, id_col: str, text_col: str, model: LineModel, skip_residue: bool = True) -> DataFrame:
    """(id, ``linea``) of every furniture line; pages that are residue are left out."""
    from tamiz.llm.residue import is_residue_page

    kind = dict(pages.dtypes)[id_col]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, numbers = [], []
            for i, text in zip(pdf["__id"], pdf["__text"], strict=True):
                if not text.strip() or (skip_residue and is_residue_page(text)):
                    continue
                for k in furniture_lines(text, model):
                    ids.append(i)
                    numbers.append(k)
            yield pd.DataFrame({"__id": pd.Series(ids, dtype=pdf["__id"].dtype), "linea": pd.Series(numbers, dtype="int64")})

    return (
        pages.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .where(F.col("__text").isNotNull())
        .mapInPandas(scan, f"__id {kind}, linea long")
        .withColumnRenamed("__id", id_col)
    )


def main_body(pages: DataFrame, id_col: str, text_col: str, model: LineModel) -> DataFrame:
    """(id, ``cuerpo``): the page without its furniture; null stays null."""

    def body(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            drop = set(furniture_lines(text, model))
            return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop).strip("\n")

        return texts.map(one)

    return pages.select(id_col, F.pandas_udf(body, "string")(F.col(text_col)).alias("cuerpo"))


def p3_found(prospectos: DataFrame) -> DataFrame:
    """(``id``, ``linea``) of the lines that are not part of the main body."""
    return furniture_of_pages(prospectos, "id", "discurso_corporativo", fit(prospectos, "id", "discurso_corporativo"))
