"""Template residue, filler, error pages and access notices in place of content (problem 1).

Unfilled placeholders are found by one grammar per delimiter. Strong delimiters (``{{ }}``, ``<%= %>``, ``${ }`` ...)
need an identifier inside; weak ones that ordinary prose also uses (``[ ]``, ``< >``, ``# #`` ...) need field words,
an upper-case or compound identifier, or an "insert here" mark. A placeholder inside a code block, inside back-ticks or
right after words of a tutorial is discounted unless placeholders make up much of the text.

Whole-text residue (filler, error messages, notices) is measured as density: the share of the folded text that residue units
cover, wherever they stand. Real texts that merely speak of such things have low density.

Null, empty and blank texts are no residue. Very long texts are processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.textutil import fold

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Words that name a field of a record or page.
FIELD_WORDS = frozenset(
    """
    nombre nombres nome name first last full apellido apellidos sobrenome empresa company organizacion organizacao
    organization org compania razon razao social ciudad cidade city pais country estado region cargo puesto role
    position job fecha data date hora time monto valor amount importe precio preco price link url enlace web sitio
    site quote cita citacao citation titulo title headline titular manchete lema tagline slogan mision missao mission
    vision vertical sector setor industry industria autor author usuario user id persona person pessoa descripcion
    descricao description corta curta short larga long correo email mail telefono telefone phone direccion endereco
    address texto text contenido conteudo content categoria category marca brand producto product numero number
    logo imagen image foto resumen summary
    """.split()
)
#: Words that tell the writer to fill something in.
INSERT_WORDS = frozenset("insertar insert inserir tu tus your su seu sua aqui here completar fill rellenar preencher poner".split())
#: Bracketed words of ordinary prose.
PROSE_BRACKETS = frozenset("sic video foto fotos audio infografia galeria nota risas aplausos musica inaudible pausa ndr nt etc".split())
HTML_TAGS = frozenset(
    "a b i u p br hr em h1 h2 h3 h4 h5 h6 li ul ol td th tr div img pre sub sup span code body head html form input "
    "strong small table script style iframe section article blockquote".split()
)
#: Words that show that a text explains placeholders.
TUTORIAL_WORDS = re.compile(
    r"(?:sintaxis|sintaxe|syntax|variable|variavel|marcador|placeholder|etiqueta|escrib[ea]|use|usa|utiliza|reemplaza"
    r"|substitua|replace|handlebars|mustache|jinja|liquid|snippet|codigo|code|template literal)s?\W*$"
)
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
MASHED_WORDS = r"(?:x{3,}|z{3,}|a{3,}|asdf\w*|asdasd\w*|qwerty\w*|test\d*|prueba\d*|foo|bar|abc|123)"
#: What error pages say, folded; ``…`` stands as in the source.
ERROR_MESSAGES = (
    "la pagina que buscas no existe o cambio de lugar",
    "la nota ya no esta disponible",
    "este contenido fue retirado",
    "no tienes permiso para ver este recurso",
    "acceso denegado",
    "servicio no disponible por mantenimiento",
    "estamos realizando mejoras, vuelve en unos minutos",
    "algo salio mal de nuestro lado",
    "error interno del servidor",
    "el servidor de origen no respondio",
    "puerta de enlace incorrecta",
    "tiempo de espera agotado",
    "limite de consultas alcanzado",
    "demasiadas solicitudes",
    "pagina no encontrada",
    "no encontramos la pagina",
    "pagina nao encontrada",
    "ops! nao achamos esse endereco",
    "nao achamos esse endereco",
    "acesso negado",
    "erro interno",
    "erro interno do servidor",
    "servico indisponivel",
    "page not found",
    "not found",
    "bad gateway",
    "gateway timed out",
    "gateway timeout",
    "service temporarily unavailable",
    "service unavailable",
    "internal server error",
    "the server encountered an unexpected condition",
    "too many requests from your network",
    "too many requests",
    "access to this resource is forbidden",
    "access denied",
    "forbidden",
    "unauthorized",
    "request timeout",
)
ERROR_TAILS = (
    r"intenta de nuevo mas tarde",
    r"intentalo de nuevo mas tarde",
    r"tente novamente mais tarde",
    r"(?:please )?try again later",
    r"request blocked\. ray [0-9a-f]+",
    r"volver al inicio",
    r"voltar ao inicio",
    r"return to the home ?page",
    r"contacta al administrador del sitio",
    r"contact the site administrator",
    r"id de referencia: ?[0-9a-f]+",
    r"reference id: ?[0-9a-f]+",
    r"puede usar el buscador o revisar la direccion escrita",
    r"gracias",
    r"obrigado",
    r"thank you",
)
SCRIPTS = r"(?:los scripts|os scripts|scripts|java ?script)(?: (?:y las|e os|and|&) cookies)?"
NOTICES = (
    rf"necesitas activar {SCRIPTS} para usar este sitio",
    rf"para continuar, habilita {SCRIPTS}(?: en tu navegador)?",
    rf"sin {SCRIPTS} no podemos mostrar el contenido",
    rf"este sitio requiere {SCRIPTS}",
    rf"tu navegador tiene desactivado {SCRIPTS}\. activalos? y recarga",
    rf"cargando…? ?(?:\.\.\.)? ?si no ves nada, activa {SCRIPTS}",
    rf"activa {SCRIPTS}(?: para (?:una mejor experiencia|continuar|ver esta pagina))?",
    rf"e preciso ativar {SCRIPTS} para ver esta pagina",
    rf"ative {SCRIPTS} para continuar",
    rf"you need to enable {SCRIPTS} to run this app",
    rf"please (?:turn on|enable) {SCRIPTS}(?: and reload the page| to continue)?",
    r"comprueba que no eres un robot(?: para seguir en [\w.-]+)?",
    r"verificando que eres humano; esto puede tardar \d+ segundos",
    r"verifying you are human(?:[.;] this may take \w+ (?:more )?seconds)?",
    r"checking your browser before you visit [\w-]+(?:\.[\w-]+)*",
    r"estamos validando a sua conexao segura(?:…|\.\.\.)?(?: codigo \d+)?",
    r"(?:tu|su|sua|your) (?:sesion expiro|sesion ha caducado|sessao expirou|session (?:has )?expired)",
    r"(?:inicia sesion|faca login|log in|sign in)(?: para (?:ver|continuar|ler)| to (?:continue|read))?(?: (?:la|a|the) (?:nota|article|materia))?(?: \d+)?",
    r"contenido exclusivo para suscriptores(?:: te quedan \d+ de \d+ notas)?",
    r"conteudo exclusivo para assinantes",
    r"(?:this content is )?(?:for|exclusive to) subscribers(?: only)?",
    r"(?:este video|este contenido|este conteudo|this video|this content) (?:no esta disponible en tu region|nao esta disponivel na sua regiao|is not available in your region)",
    r"contenido no disponible",
    r"conteudo indisponivel",
    r"content not available",
)
WRITE_HERE = (
    r"aqui va (?:el|la|los|las|tu|o|a)? ?[\w ]{2,40}",
    r"(?:escriba|escribe|inserte|insira aqui|escreva aqui|write|insert) (?:el|la|los|las|o|a|the) [\w ]{2,60}",
    r"your text goes here:? ?(?:(?:el|la|a|o|the) [\w ]{2,40})?",
    r"pendiente de redactar:? ?[\w ]{0,40}",
    r"pendente de redacao:? ?[\w ]{0,40}",
    r"(?:to be written|tbd):? ?[\w ]{0,40}",
    r"todo (?:el|la|a|o|the) [\w ]{2,40} // completar antes del dia \d+",
    r"\[?(?:borrador|rascunho|draft)\]? ?:?(?:falta|missing) (?:el|la|a|o|the) [\w ]{2,40}, (?:no publicar|nao publicar|do not publish)",
    r"titulo \d+ . subtitulo \d+ . descripcion de ejemplo",
)
# ---- end of the fixed values --------------------------------------------------------------------------------------

_NAME = r"[^\W\d][\w .\-]{0,48}"
STRONG = re.compile(
    rf"\{{\{{\{{?\s*[#/^&>]?({_NAME}?)\s*\}}?\}}\}}"
    rf"|\{{%-?\s*({_NAME}?)\s*-?%\}}"
    rf"|<%[=-]?\s*({_NAME}?)\s*-?%>"
    rf"|\$\{{\s*({_NAME}?)\s*\}}"
    rf"|\[\[\s*({_NAME}?)\s*\]\]"
    rf"|<<\s*({_NAME}?)\s*>>"
    rf"|@@\s*({_NAME}?)\s*@@"
    r"|(?<![\w/])__([^\W\d_](?:[\w .\-]{0,48}?[^\W_])?)__(?![\w/])"
)
WEAK = re.compile(
    rf"(?<![{{$\w])\{{({_NAME})\}}(?!\}})"
    rf"|(?<!\[)\[({_NAME})\](?![\](])"
    rf"|(?<!<)<({_NAME})>(?!>)"
    r"|(?<![\w#])#([^\W\d](?:[\w .\-]{0,48}[^\W])?)#(?![\w#])"
    r"|(?<![\w%])%([^\W\d](?:[\w .\-]{0,48}[^\W])?)%(?![\w%])"
)
_HINT = re.compile(r"[{}\[\]<>#%@_$]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPLIT = re.compile(r"[\s_.\-]+")
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
#: A tutorial has few placeholders for its length; residue is made of them.
TUTORIAL_DENSITY = 0.25


def _field_like(inner: str, strong: bool) -> bool:
    words = [fold(w) for w in _SPLIT.split(_CAMEL.sub(" ", inner)) if w]
    if not words or len(words) > 6:
        return False
    if strong:
        return True
    if words[0] in PROSE_BRACKETS or inner.lower() in HTML_TAGS:
        return False
    known = sum(w in FIELD_WORDS for w in words)
    if known and known + sum(w in INSERT_WORDS or w in ("de", "del", "da", "do", "la", "el", "of") for w in words) == len(words):
        return True
    if words[0] in ("insertar", "insert", "inserir") or words[-1] in ("aqui", "here") and len(words) > 1:
        return True
    if re.search(r"[^\W\d]_[^\W\d]", inner) or known and _CAMEL.search(inner):
        return True
    letters = [c for c in inner if c.isalpha()]
    return len(letters) >= 3 and all(c.isupper() for c in letters) and known > 0


def has_placeholder(text: str) -> bool:
    """Whether an unfilled placeholder stands in ``text`` outside code and tutorials."""
    if not _HINT.search(text):
        return False
    found = [(m, True) for m in STRONG.finditer(text)] + [(m, False) for m in WEAK.finditer(text)]
    found = [m for m, strong in found if _field_like(next(g for g in m.groups() if g is not None), strong)]
    if not found:
        return False
    dense = sum(m.end() - m.start() for m in found) >= TUTORIAL_DENSITY * len(text)
    code = [m.span() for m in _CODE.finditer(text)] if "`" in text else []
    for m in found:
        if any(a <= m.start() and m.end() <= b for a, b in code):
            continue
        if not dense and TUTORIAL_WORDS.search(fold(text[max(0, m.start() - 24) : m.start()])):
            continue
        return True
    return False


_MSG = "|".join(sorted(map(re.escape, ERROR_MESSAGES), key=len, reverse=True))
_CODES = r"(?:[1-5]\d\d)"
_OWNER = r"(?:(?<=\| )[^|.]{2,60}?(?=$| (?:{t}))|(?<=\()[\w-]+(?:\.[\w-]+)+\)|(?<=\()(?:codigo|code) \d+\))".replace("{t}", "|".join(ERROR_TAILS))
UNIT = re.compile(
    "(?:"
    + "|".join(
        [
            rf"(?:(?:error|erro|http|status)[ :]*{_CODES}:?|{_CODES} ?[–-]?|[¡!]?(?:ups|oops|ops)!?…?(?:\.\.\.)?) ?(?:{_MSG})",
            rf"(?:{_MSG})(?= ?[(\d|.!]|$| (?:{'|'.join(ERROR_TAILS)}))",
            *ERROR_TAILS,
            *NOTICES,
            *WRITE_HERE,
            rf"(?:(?:{'|'.join(FILLER_WORDS)})\b[ ,.;]*){{3,}}",
            rf"(?:{MASHED_WORDS}\b[ ,.]*){{3,}}",
            r"(?P<rep>\b[\w ]{2,40}?\w)(?:[ ,.]+(?P=rep)\b){1,}(?: \d+)?",
            rf"\({_CODES}\)",
            rf"{_CODES}\b",
            _OWNER,
            r"\(?(?:max\. )?\d+ (?:caracteres|words|palabras|palavras|characters)(?: max)?\)?",
            r"/ (?=titulo \d)",
        ]
    )
    + r")"
)
_GAP = re.compile(r"[\s.,;:!?…|/()\[\]–—-]*")
#: Share of the letters and digits of a text that units must cover.
RESIDUE_DENSITY = 0.85


_TOKEN = re.compile(r"\w+|\W")
_TWICE = re.compile(r"(\b[\w ]{2,40}?\w)[ ,.]+\1\b")
#: How residue units begin, so that ``UNIT`` is tried only where one may stand.
_OPENERS = tuple(
    dict.fromkeys(
        (
            *(m[:9] for m in ERROR_MESSAGES), *FILLER_WORDS, *"error erro http status ups oops ops cargando escriba escribe inserte tbd borrador rascunho draft gracias obrigado xxx zzz aaa asdf asdasd qwerty test prueba foo bar abc 123".split(),
            "necesitas activar", "para continuar", "sin los sc", "sin os sc", "sin scr", "sin jav", "este sitio req", "tu navegador", "activa ", "e preciso", "ative ", "you need to", "please ", "comprueba que", "verificando", "verifying", "checking your",
            "estamos validando", "tu s", "su s", "sua s", "your s", "inicia sesion", "faca login", "log in", "sign in", "contenido exc", "contenido no", "conteudo exc", "conteudo ind", "content not", "this content", "for subscribers", "exclusive to",
            "este video", "este contenido", "este conteudo", "this video", "aqui va", "insira aqui", "escreva aqui", "write ", "insert ", "your text", "pendiente de", "pendente de", "to be written", "todo el ", "todo la ", "todo a ", "todo o ", "todo the ",
            "titulo ", "intenta de", "intentalo de", "tente nov", "try again", "request blocked", "volver al", "voltar ao", "return to", "contacta al", "contact the", "id de ref", "reference id", "puede usar el", "thank you", "max. ", "[",
        )
    )
)


def _unit_at(folded: str, pos: int, end: int) -> re.Match[str] | None:
    """The residue unit that begins at ``pos``, where a token ends at ``end``."""
    if folded.startswith(_OPENERS, pos) or folded[pos].isdigit() or folded.endswith(("| ", "("), 0, pos):
        return UNIT.match(folded, pos)
    if folded.find(folded[pos:end], end, end + 60) >= 0 and _TWICE.match(folded, pos):
        return UNIT.match(folded, pos)
    return None


def residue_density(folded: str) -> float:
    """Share of the letters and digits of a folded text that residue units cover, wherever they stand in it.

    0 as soon as more is uncovered than ``RESIDUE_DENSITY`` allows.
    """
    room = (1 - RESIDUE_DENSITY) * len(folded)
    pos, covered, missed = _GAP.match(folded).end(), 0, 0
    while pos < len(folded):
        end = _TOKEN.match(folded, pos).end()
        m = _unit_at(folded, pos, end)
        if m and m.end() > pos:
            end = m.end()
            covered += sum(map(str.isalnum, m.group()))
        elif folded[pos].isalnum():
            missed += end - pos
            if missed > room:
                return 0.0
        pos = _GAP.match(folded, end).end()
    return covered / (covered + missed) if covered else 0.0


def _garbled_fix(text: str) -> str:
    if "Ã" in text or "â€" in text:
        from tamiz.llm.encoding import repaired

        return repaired(text)
    return text


def is_residue_text(text: str) -> bool:
    """Whether a text without page furniture is only filler, an error message or a notice."""
    return residue_density(fold(text)) >= RESIDUE_DENSITY


def is_residue_quote(text: str | None) -> bool:
    """Case decision for a quote or headline."""
    if not text or not text.strip():
        return False
    if has_placeholder(text):
        return True
    text = _garbled_fix(text)
    return is_residue_text(text)


def is_residue_page(text: str | None) -> bool:
    """Case decision for a page: a placeholder anywhere, or nothing but furniture and residue lines, at least one of the latter."""
    if not text or not text.strip():
        return False
    if has_placeholder(text):
        return True
    from tamiz.llm.boilerplate import is_furniture_line, looks_like_content

    text = _garbled_fix(text)
    residue = False
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    for k, line in enumerate(lines):
        if is_furniture_line(line):
            continue
        if is_residue_text(line) or (k + 1 < len(lines) and is_residue_text(f"{line} {lines[k + 1]}")):
            residue = True
        elif looks_like_content(line):
            return False
    return residue


def residue_rows(df: DataFrame, id_col: str, text_col: str, page: bool) -> DataFrame:
    """Rows of ``df`` whose text is residue: ``id_col`` only. Null and blank texts never are."""
    decide = is_residue_page if page else is_residue_quote

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [decide(t) for t in pdf["__text"]]
            yield pdf.loc[keep, ["__id"]]

    kind = dict(df.dtypes)[id_col]
    return (
        df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .where(F.col("__text").isNotNull())
        .mapInPandas(scan, f"__id {kind}")
        .withColumnRenamed("__id", id_col)
    )


def p1_found(evidencias: DataFrame, prospectos: DataFrame) -> DataFrame:
    """Rows (``tabla``, ``id``) whose text is residue in place of content."""
    a = residue_rows(evidencias, "id", "cita_textual", page=False).select(F.lit("evidencias").alias("tabla"), "id")
    b = residue_rows(prospectos, "id", "discurso_corporativo", page=True).select(F.lit("prospectos").alias("tabla"), "id")
    return a.unionByName(b)
