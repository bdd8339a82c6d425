"""Column functions on texts, addresses and mailboxes: built-in expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters with canonical decomposition and their bases, over the Latin, Greek and Cyrillic ranges."""
    marked, base = [], []
    for lo, hi in ((0xC0, 0x250), (0x370, 0x460), (0x1E00, 0x1F00)):
        for cp in range(lo, hi):
            bare = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
            if len(bare) == 1 and bare != chr(cp):
                marked.append(chr(cp))
                base.append(bare)
    return "".join(marked), "".join(base)


_MARKED, _BASE = _accent_table()


def strip_accents(c: Column) -> Column:
    """Letters without accents; combining marks are removed. Null stays null."""
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), _MARKED, _BASE)


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def company_key(c: Column) -> Column:
    """Name of an organisation for comparison: lower case, white space collapsed; '' for null."""
    return F.coalesce(F.lower(collapse(c)), F.lit(""))


def normal_url(c: Column) -> Column:
    """Address with scheme and host in lower case, without query, fragment and trailing slashes; '' for null."""
    bare = F.regexp_replace(F.trim(c), r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.coalesce(F.regexp_replace(F.concat(F.lower(head), rest), r"/+$", ""), F.lit(""))


def host_of(c: Column) -> Column:
    """Host of an address without user, port and ``www.``; '' if there is none."""
    host = F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def without_outlet(c: Column) -> Column:
    """Title without a trailing `` - Outlet``; unchanged if nothing else would remain."""
    cut = F.trim(F.regexp_replace(c, r"\s+-\s+[^-]+$", ""))
    return F.when(cut == "", c).otherwise(cut)


def normal_title(c: Column) -> Column:
    """Title for comparison: without outlet, accents and punctuation, lower case; '' for null."""
    t = F.lower(strip_accents(without_outlet(c)))
    return F.coalesce(collapse(F.regexp_replace(t, r"[^a-z0-9]+", " ")), F.lit(""))


def content_hash(title: Column) -> Column:
    """sha256 of the normal title, '' if that is empty."""
    t = normal_title(title)
    return F.when(t == "", "").otherwise(F.sha2(t, 256))


def contract_hash(company: Column, url: Column) -> Column:
    """Identity of a record: sha256 of company and normal address."""
    return F.sha2(F.concat_ws("|", company_key(company), normal_url(url)), 256)


def content_key(url: Column, title: Column) -> Column:
    """Key of the content: the normal address, else the title's hash, with a prefix that says which; '' if neither."""
    u, h = normal_url(url), content_hash(title)
    return F.when(u != "", F.concat(F.lit("url:"), u)).when(h != "", F.concat(F.lit("txt:"), h)).otherwise("")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text contains one of the phrases; false for null. The phrases are one constant, so that plans stay small."""
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)), F.lit(False))


def plain_text(html: Column) -> Column:
    """Text of HTML: without scripts, styles, tags and the usual entities; '' for null."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.coalesce(collapse(t), F.lit(""))


def slug(c: Column) -> Column:
    """Letters and digits joined by hyphens, without accents, lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


MAILBOX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# ---- fixed values -------------------------------------------------------------------------------------------------
GENERIC_MAILBOXES = (
    "info", "contact", "contacto", "support", "soporte", "noreply", "no-reply", "no.reply", "hello", "hola", "admin", "webmaster", "press", "prensa", "sales",
    "ventas", "help", "helpdesk", "service", "team", "legal", "hi", "correo", "mail", "careers", "jobs", "empleo", "rrhh", "hr", "newsletter", "notificaciones",
    "seguridad", "privacy", "privacidad", "marketing", "comercial", "reclamaciones", "postmaster", "abuse", "billing", "contactanos", "contactus", "soporte_tecnico",
)
# ---- end of the fixed values --------------------------------------------------------------------------------------
#: Generic local parts, alone or followed by a separator.
GENERIC_LOCAL = "^(" + "|".join(b.replace(".", r"\.") for b in GENERIC_MAILBOXES) + r")([._-].*)?$"


def mailboxes(text: Column) -> Column:
    """Distinct mailboxes in a text, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MAILBOX), 0), F.lower)))


def mailbox_generic(mail: Column) -> Column:
    """Whether the local part names a function, not a person."""
    return F.split_part(mail, F.lit("@"), F.lit(1)).rlike(GENERIC_LOCAL)


def size_band(n: Column) -> Column:
    """Band of a head count; ``indeterminada`` for null and counts below one."""
    return (
        F.when(n.isNull() | (n < 1), "indeterminada").when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 200, "51-200").when(n <= 500, "201-500").otherwise("501+")
    )


_PEOPLE = r"(?:empleados|colaboradores|personas|trabajadores|integrantes|funcionários|employees|people|team\s+members|staff)"
_NUMBER = r"([0-9][0-9.,]*)"


def _whole(x: Column) -> Column:
    return F.regexp_replace(x, "[.,]", "").try_cast("long")


def declared_size(text: Column) -> Column:
    """Head count that a text declares: the upper bound of a range, else the greatest number of people from 1 to 5,000,000; null if none."""
    low = F.lower(text)
    bound = _whole(F.regexp_extract(low, _NUMBER + r"\s*[-–a]\s*" + _NUMBER + r"\s*\+?\s*" + _PEOPLE, 2))
    single = F.transform(F.regexp_extract_all(low, F.lit(_NUMBER + r"\s*\+?\s*" + _PEOPLE), 1), _whole)
    return F.coalesce(F.when(bound > 0, bound), F.array_max(F.filter(single, lambda n: n.between(1, 5_000_000))))


FOUNDED = r"(?:fundad[ao]s?|founded|establecid[ao]s?|cread[ao]s?|nacimos|desde|since|est\.?)[^0-9]{0,12}([0-9]{4})"


def declared_year(text: Column, last: int) -> Column:
    """The first founding year between 1900 and ``last`` that a text declares; null if none."""
    years = F.transform(F.regexp_extract_all(F.lower(text), F.lit(FOUNDED), 1), lambda y: y.try_cast("int"))
    return F.try_element_at(F.filter(years, lambda y: y.between(1900, last)), F.lit(1))


def numbers_before(text: Column, words: str) -> Column:
    """Whole numbers that stand before one of the words (an alternation)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([0-9][0-9.]*)\s+(?:{words})"), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit("."), F.lit("")).try_cast("long"))


# ---- fixed values -------------------------------------------------------------------------------------------------
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "domain.com", "domain.org", "test.com", "test.org", "email.com", "mail.com", "yourdomain.com", "sitioweb.com")
RESERVED_ENDINGS = ("local", "test", "invalid", "localhost", "onion", "example")
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg")
# ---- end of the fixed values --------------------------------------------------------------------------------------


def normal_mailbox(c: Column) -> Column:
    """Mailbox in lower case, without brackets around it and punctuation after it."""
    return F.lower(F.regexp_replace(F.trim(c), r"^[ ;:()<>'\"]+|[ ;:()<>'\",.]+$", ""))


def mailbox_reason(c: Column) -> Column:
    """Why a mailbox can't be used, '' if it can; the first reason counts. Null is invalid."""
    m = normal_mailbox(c)
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    ending = F.regexp_extract(domain, r"\.([^.]+)$", 1)
    return (
        F.when(m.isNull() | ~m.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), "sintaxis").when(domain.isin(*PLACEHOLDER_DOMAINS), "dominio_de_ejemplo").when(ending.isin(*RESERVED_ENDINGS), "terminacion_reservada")
        .when(ending.isin(*IMAGE_ENDINGS), "imagen").when(local.rlike(r"\.\.|^\.|\.$"), "puntos").when(local.rlike(r"^[^a-z]"), "inicio").when(local.rlike(GENERIC_LOCAL), "generico").otherwise("")
    )


def usable_mailboxes(found: Column) -> Column:
    """The usable ones of an array of mailboxes, normalised, each once, in order."""
    return F.array_distinct(F.filter(F.transform(found, normal_mailbox), lambda m: mailbox_reason(m) == ""))


def tried_mailboxes(domain: Column, person: Column, boxes: tuple[str, ...]) -> Column:
    """Candidate mailboxes of a domain, most likely first: patterns of the person's first and last word, then the usual boxes; empty without a domain."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(person, F.lit("")))), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    two = F.array(F.concat(first, F.lit("."), last), F.concat(F.substring(first, 1, 1), last), first, F.concat(first, last))
    none = F.array().cast("array<string>")
    local = F.concat(F.when(F.size(words) >= 2, two).when(F.size(words) == 1, F.array(first)).otherwise(none), F.array(*[F.lit(b) for b in boxes]))
    return F.when(F.contains(domain, F.lit(".")), F.array_distinct(F.transform(local, lambda x: F.concat(x, F.lit("@"), domain)))).otherwise(none)


def detected_company(title: Column, common: tuple[str, ...], sectors: tuple[str, ...]) -> Column:
    """The first word of a headline that looks like a name, null if none does.

    A name has three characters or more, or is an acronym, begins with a capital and is neither a common word nor one of a
    sector. A trailing outlet doesn't count.
    """
    t = F.trim(title)
    bare = F.trim(F.regexp_replace(t, r"\s+[-–|]\s+[^-–|]+$", ""))
    words = F.regexp_extract_all(F.when(bare == "", t).otherwise(bare), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    other = F.array(*[F.lit(w) for w in (*common, *sectors)])
    named = lambda w: (w.rlike(r"^\p{Lu}{2,}$") | ((F.length(w) >= 3) & w.rlike(r"^\p{Lu}"))) & ~F.array_contains(other, F.lower(strip_accents(w)))
    return F.try_element_at(F.filter(words, named), F.lit(1))
