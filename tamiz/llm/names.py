"""Variant spellings of names typed by people (problem 2).

Values are parsed into telling tokens (brand of an organisation; given name and surnames of a person) and common ones
(legal forms, sectors, titles), the latter learned by how many different tokens stand beside them: rare tokens count more.
Values that differ only in case, accents, punctuation, order, legal form or abbreviation meet in one canonical form.
Canonical forms with typing slips are found by a prefix-filtered set-similarity join on the q-grams of their telling
tokens (rarest q-grams first). Every link is verified by soft weighted token similarity (``soft_similarity``): tokens are
matched one to one, equal ones fully, mistyped, abbreviated and pet forms in part; each counts by its rarity among all
values (``rarity``), and tokens that contradict each other (another sector, another given name) count as much as the rarest.
Forms that leave a part out (no sector, one surname, initials, nicknames) are linked only where exactly one entity fits.

Null and blank values, search terms and generic speakers name no entity. Repeated values are taken once. Values of one
entity are returned as all their pairs; an entity has as many values as people found ways to write it, not rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.llm.textutil import fold
from tamiz.session import cut

Q = 3
#: Least share of a q-gram set that two forms that differ by one slip have in common, from PREFIXED grams on; a slip touches Q + 1 grams at most.
SIMILARITY = 0.4
#: From so many q-grams on, n - (Q + 1) of n are at least ceil(SIMILARITY * n).
PREFIXED = 7
#: A token is common (a sector, a given name) when so many different tokens stand beside it, as a share of the names and at least.
COMMON_SHARE, COMMON_LEAST = 0.004, 5

#: Least soft weighted similarity of two names of one entity.
SOFT = 0.72
#: Similarity of an initial and of a pet form to the name that they stand for.
INITIAL, PET = 0.9, 0.95

# ---- fixed values -------------------------------------------------------------------------------------------------
LEGAL_FORMS = re.compile(
    r"[ ,]+(?:s\.? ?a\.?(?: ?de ?c\.? ?v\.?)?|s\.? ?a\.? ?s\.?|s\.? ?l\.?(?: ?u\.?)?|s\.? de r\.? ?l\.?(?: ?de ?c\.? ?v\.?)?|s\.? ?p\.? ?a\.?|s\.? ?r\.? ?l\.?|ltda\.?|ltd\.?|inc\.?|corp\.?|llc|gmbh|cia\.?|e\.? ?i\.? ?r\.? ?l\.?|s\.? ?c\.?)\s*$"
)
GROUP_WORDS = frozenset("grupo gpo gr group".split())
TITLES = frozenset("dr dra sr sra srta lic ing arq mtro mtra prof profa don dona mr mrs ms dipl cp".split())
#: Roles and search words that stand where a name should.
GENERIC = frozenset(
    """
    empresa empresas compania fuentes fuente internas interna vocera vocero voceros portavoz portavoces directivo directiva
    directivos ejecutivo ejecutivos anonimo anonima desconocido redaccion porta voz fontes spokesperson sources company
    startups startup fintech healthtech edtech despidos ronda semilla incubadoras incubadora vc latam venture inversion
    inversiones contratacion aceleradora aceleradoras unicornio unicornios nd na ninguno null none
    """.split()
)
NICKNAMES = {
    "pepe": "jose", "charo": "rosario", "chayo": "rosario", "chelo": "consuelo", "meche": "mercedes", "merche": "mercedes",
    "lola": "dolores", "lolita": "dolores", "beto": "roberto alberto", "berto": "roberto", "vero": "veronica",
    "gaby": "gabriela", "gabi": "gabriela", "quique": "enrique", "kike": "enrique", "max": "maximiliano", "alex": "alejandro",
    "ale": "alejandro", "lupita": "guadalupe", "lupe": "guadalupe", "tere": "teresa", "manolo": "manuel", "manu": "manuel",
    "chabela": "isabel", "isa": "isabel", "betty": "beatriz", "bety": "beatriz", "concha": "concepcion", "conchita": "concepcion",
    "paco": "francisco", "pancho": "francisco", "nacho": "ignacio", "chucho": "jesus", "chuy": "jesus", "tono": "antonio", "rafa": "rafael",
    "leo": "leonardo", "seb": "sebastian", "sebas": "sebastian", "yoli": "yolanda", "cami": "camila", "lalo": "eduardo",
    "edu": "eduardo", "nando": "hernan fernando", "santi": "santiago", "chago": "santiago", "vale": "valentina",
    "juli": "julian", "fabi": "fabiola", "mari": "marisol maria", "will": "wilfrido", "xime": "ximena", "zule": "zulema", "dami": "damian",
}
# ---- end of the fixed values --------------------------------------------------------------------------------------

_CAMEL = re.compile(r"(?<=[a-záéíóúñü])(?=[A-ZÁÉÍÓÚÑ])")
_TOKENS = re.compile(r"[^\W_]+\.?")
_NICK = re.compile(r"[«\"“(]\s*([^\W\d_]+)\s*[»\"”)]")


def org_tokens(value: str) -> list[str]:
    """Folded tokens of an organisation's name without legal form and group word; abbreviations keep their full stop."""
    v = value.strip()
    if v.startswith("@"):
        return ["@" + re.sub(r"\W", "", fold(v))]
    f = fold(_CAMEL.sub(" ", v) if " " not in v else v)
    while (g := LEGAL_FORMS.sub("", " " + f).strip()) != f:
        f = g
    return [t for t in _TOKENS.findall(f.replace("-", " ")) if t.strip(".") not in GROUP_WORDS]


def person_tokens(value: str) -> tuple[list[str], str]:
    """Folded tokens of a person's name without titles, surname first where a comma says so moved behind; and a nickname."""
    nick = ""
    m = _NICK.search(value)
    if m:
        nick = fold(m.group(1))
        value = value[: m.start()] + " " + value[m.end() :]
    if "," in value:
        last, _, first = value.partition(",")
        value = f"{first} {last}"
    tokens = [t for t in _TOKENS.findall(fold(value.replace("-", " "))) if t.strip(".") not in TITLES]
    return tokens, nick


def slip(a: str, b: str) -> bool:
    """Equal up to one inserted, lost, changed or swapped letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def token_slips(a: str, b: str) -> bool:
    """Whether two keys of several tokens are equal up to one slip in each token, or up to one slip over all."""
    if slip(a, b):
        return True
    ta, tb = a.split(" "), b.split(" ")
    return len(ta) == len(tb) > 1 and all(x == y or (min(len(x), len(y)) >= 4 and slip(x, y)) for x, y in zip(ta, tb, strict=True))


def soft_similarity(*tokens: tuple[Column, Column]) -> Column:
    """Soft weighted similarity of two names from (similarity, weight) of their tokens, matched one to one.

    A similarity of null is a token that one name leaves out: it counts neither way. One of 0 is a contradiction and
    weighs 1, as the rarest token does. 0 if nothing matches.
    """
    zero = F.lit(0.0)
    both = [(F.coalesce(sim, F.lit(-1.0)), weight) for sim, weight in tokens]
    gain, total = zero, zero
    for sim, weight in both:
        gain = gain + F.when(sim > 0, sim * weight).otherwise(0.0)
        total = total + F.when(sim > 0, weight).when(sim == 0, 1.0).otherwise(0.0)
    return F.when(total > 0, gain / F.greatest(total, F.lit(1e-9))).otherwise(0.0)


def typed_alike(a: Column, b: Column) -> Column:
    """Similarity of tokens that are equal up to one slip: 1, or less the share of a letter."""
    return F.when(a == b, 1.0).otherwise(1 - 1 / F.greatest(F.length(a), F.length(b), F.lit(1)))


def rarity(names: DataFrame, token: str, total: int) -> DataFrame:
    """(``token``, ``peso``): weight of each token by its inverse frequency among ``total`` names, in (0, 1]; nearly 1 for tokens that occur once."""
    df = names.groupBy(token).agg(F.count("*").alias("n"))
    return df.select(token, (F.log1p(F.lit(float(total)) / F.col("n")) / F.log1p(F.lit(float(max(total, 1))))).alias("peso"))


def abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` is made of letters of ``full`` in order, with the same first letter."""
    if not short or short[0] != full[0] or len(short) >= len(full):
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _sector_of(token: str, sectors: list[str]) -> str | None:
    bare = token.strip(".")
    if bare in sectors:
        return bare
    if token.endswith("."):
        fit = [s for s in sectors if s.startswith(bare)] or [s for s in sectors if abbreviates(bare, s)]
        return fit[0] if fit else None
    if len(bare) >= 4:
        return next((s for s in sectors if slip(bare, s)), None)
    return None


def parse_org(value: str, sectors: list[str]) -> tuple[str, str]:
    """(brand, sector) of an organisation's name; both may be empty."""
    tokens = org_tokens(value)
    if tokens and tokens[0].startswith("@"):
        return tokens[0][1:], ""
    if any(t.strip(".") in GENERIC for t in tokens):
        return "", ""
    brand, sector = [], ""
    exact = [t for t in tokens if t.strip(".") in sectors]
    for t in tokens:
        s = _sector_of(t, sectors) if not exact or t in exact else None
        if s and not sector and len(tokens) > 1:
            sector = s
        else:
            brand.append(t.strip("."))
    return "".join(brand), sector


def parse_person(value: str, given: set[str], nicknames: dict[str, str]) -> tuple[str, str, str]:
    """(given names that fit, separated by blanks; or an initial with a full stop; first surname; second surname or initial)."""
    tokens, nick = person_tokens(value)
    if len(tokens) < 2 or any(t.strip(".") in GENERIC for t in tokens):
        return "", "", ""
    bare = [t.strip(".") for t in tokens]
    at = next((k for k, t in enumerate(bare) if t in given), None)
    if at is None:
        at = next((k for k, t in enumerate(bare) if t in nicknames), None)
    name = ""
    if at is None:
        at = next((k for k, t in enumerate(bare) if len(t) >= 4 and any(slip(t, g) for g in given)), None)
        if at is not None:
            name = next(g for g in sorted(given) if slip(bare[at], g))
    if at is None and len(bare[0]) == 1:
        at, name = 0, bare[0] + "."
    if at is None and len(bare[-1]) == 1 and len(bare) == 2:
        at, name = 1, bare[1] + "."
    if at is None:
        at, name = 0, bare[0]
    name = name or (bare[at] if bare[at] in given else nicknames.get(bare[at], bare[at]))
    if nick and name.endswith("."):
        name = nicknames.get(nick, name)
    rest = [t for k, t in enumerate(bare) if k != at]
    if not rest or len(rest[0]) == 1:
        return "", "", ""
    second = "".join(rest[1:])
    return name, rest[0], second + "." if len(second) == 1 else second


def _grams(s: str) -> list[str]:
    p = "\x02" + s + "\x03"
    return sorted({p[i : i + Q] for i in range(len(p) - Q + 1)})


def _udf(fn, schema: str, *cols: Column) -> Column:
    """A vectorised function of string columns that returns a struct."""

    def run(*series: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(",")]
        return pd.DataFrame([fn(*row) for row in zip(*series, strict=True)], columns=[n.strip() for n in names])

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, schema)(*cols)


def similar_keys(keys: DataFrame) -> DataFrame:
    """(``a`` < ``b``) of the strings of ``keys`` (column ``k``) that differ by one slip; of several tokens, also by one in each, where the q-grams still show it.

    Prefix filter: q-grams are ordered from rare to frequent, and two sets of that similarity share one of their first
    grams; only those are joined. This holds for sets of ``PREFIXED`` grams and more. Strings of fewer grams, and such as
    may be their variants (Q + 1 grams more), are joined on what is left when one letter is taken out, which two strings
    that differ by one slip share. Strings shorter than four letters have no variants.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, g, len(gs)) for k in pdf["k"] for gs in [_grams(k)] for g in gs]
            yield pd.DataFrame(rows, columns=["k", "g", "n"])

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, g) for k in pdf["k"] if len(_grams(k)) < PREFIXED + Q + 1 for g in {k} | {k[:i] + k[i + 1 :] for i in range(len(k))}]
            yield pd.DataFrame(rows, columns=["k", "g"])

    words = cut(keys.select("k").distinct().where(F.length("k") >= 4))
    short = words.mapInPandas(shorten, "k string, g string")
    grams = cut(words.mapInPandas(explode, "k string, g string, n int").where(F.col("n") >= PREFIXED))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("k").orderBy("df", "g"))
    first = grams.join(df, "g").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY) + 1).select("k", "g")

    def joined(on: DataFrame) -> DataFrame:
        pairs = on.select("g", F.col("k").alias("a")).join(on.select("g", F.col("k").alias("b")), "g")
        several = F.when(F.contains("a", F.lit(" ")) & F.contains("b", F.lit(" ")), 2).otherwise(1)
        near = F.when(several == 2, F.levenshtein("a", "b", 4)).otherwise(F.levenshtein("a", "b", 2)) >= 0
        return pairs.where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= several) & near).select("a", "b")

    pairs = joined(first).unionByName(joined(short)).distinct()

    def ok(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_slips(p, q) for p, q in zip(x, y, strict=True)])

    ok.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pairs.where(F.pandas_udf(ok, "boolean")("a", "b"))


def common_tokens(values: DataFrame, tokens) -> list[str]:
    """Tokens that stand beside many different others (a brand has few partners, a sector many).

    At most 1 / COMMON_SHARE times the tokens of a name, so their number is bounded.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v in pdf["valor"]:
                ts = {x.strip(".") for x in tokens(v)}
                rows += [(t, o) for t in ts if len(t) > 2 for o in ts if o != t and len(o) > 2]
            yield pd.DataFrame(rows, columns=["t", "o"])

    n = values.count()
    least = max(COMMON_LEAST, int(n * COMMON_SHARE))
    rows = values.select("valor").mapInPandas(explode, "t string, o string").groupBy("t").agg(F.count_distinct("o").alias("n")).where(F.col("n") >= least).collect()
    return sorted(r.t for r in rows if r.t not in GENERIC)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``nodo``, ``grupo``): least node reachable over undirected ``edges`` (``a``, ``b``); by label propagation to a fixpoint.

    Names of one entity lie one or two steps from its usual form, so a few rounds suffice.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.select(F.col("a").alias("nodo")).distinct().withColumn("grupo", F.col("nodo")))
    while True:
        best = both.join(label, both.b == label.nodo).groupBy("a").agg(F.min("grupo").alias("m"))
        new = cut(label.join(best, label.nodo == best.a).select("nodo", F.least("grupo", "m").alias("grupo"), (F.col("m") < F.col("grupo")).alias("cambio")))
        label = new.select("nodo", "grupo")
        if new.where("cambio").isEmpty():
            break
    return nodes.join(label, "nodo", "left").select("nodo", F.coalesce("grupo", "nodo").alias("grupo"))


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs of values of one entity, in code point order."""
    each = members.groupBy("grupo").agg(F.array_sort(F.collect_set("valor")).alias("v")).where(F.size("v") > 1)
    one = each.select("v", F.posexplode("v").alias("i", "valor_a"))
    return one.select("valor_a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("valor_b"))


def link_orgs(values: DataFrame) -> DataFrame:
    """(``valor_a``, ``valor_b``) of the values (``valor``) that name one organisation."""
    sectors = common_tokens(values, org_tokens)
    parsed = values.select("valor", _udf(lambda v: parse_org(v, sectors), "marca string, sector string", F.col("valor")).alias("p")).select("valor", "p.*")
    parsed = cut(parsed.where("marca <> ''"))
    full = parsed.where("sector <> ''").groupBy("marca", "sector").agg(F.count("*").alias("n"))
    bare = parsed.where("sector = ''").select("marca").distinct()
    slips = cut(similar_keys(parsed.select(F.col("marca").alias("k"))))
    both = slips.unionByName(slips.select(F.col("b").alias("a"), F.col("a").alias("b")))
    key = lambda m, s: F.concat(F.col(m), F.lit("|"), F.col(s))
    other = full.select(F.col("marca").alias("b"), F.col("sector").alias("sb"))
    total = parsed.count()
    brands, sectors_ = rarity(parsed, "marca", total), rarity(parsed.where("sector <> ''"), "sector", total)
    typed = full.select(F.col("marca").alias("a"), F.col("sector").alias("sa")).join(both, "a").join(other, "b").where("a < b")
    typed = typed.join(brands.toDF("a", "wa"), "a").join(brands.toDF("b", "wb"), "b").join(sectors_.toDF("sa", "ws"), "sa")
    alike = soft_similarity((typed_alike(F.col("a"), F.col("b")), F.greatest("wa", "wb")), (F.when(F.col("sa") == F.col("sb"), 1.0).otherwise(0.0), F.col("ws")))
    edges = typed.where(alike >= SOFT).select(key("a", "sa").alias("a"), key("b", "sb").alias("b"))
    # a brand alone belongs to the one organisation of that brand; if it is mistyped, to the one of the brand it resembles
    groups = components(full.select(key("marca", "sector").alias("nodo")), edges)
    owners = full.select("marca", key("marca", "sector").alias("nodo")).join(groups, "nodo")
    one = lambda df: df.groupBy("x").agg(F.count_distinct("grupo").alias("n"), F.min("grupo").alias("grupo")).where("n = 1")
    direct = one(bare.join(owners, "marca").select(F.col("marca").alias("x"), "grupo"))
    had = bare.join(owners.select("marca").distinct(), "marca", "left_anti")
    near = one(had.join(both, had.marca == both.a).join(owners.select(F.col("marca").alias("b"), "grupo"), "b").select(had.marca.alias("x"), "grupo"))
    home = cut(direct.select("x", "grupo").unionByName(near.select("x", "grupo")))
    lone = parsed.where("sector = ''").join(home, parsed.marca == home.x, "left").select("valor", F.coalesce("grupo", F.concat("marca", F.lit("|"))).alias("grupo"))
    whole = parsed.where("sector <> ''").withColumn("nodo", key("marca", "sector")).join(groups, "nodo").select("valor", "grupo")
    return _pairs(whole.unionByName(lone))


def stated_nicknames(values: DataFrame, given: set[str]) -> DataFrame:
    """(``apodo``, ``nombre``): nicknames that stand beside a given name in any value, each pair once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for v in pdf["valor"]:
                tokens, nick = person_tokens(v)
                g = next((t for t in tokens if t in given), None)
                if nick and g:
                    rows.add((nick, g))
            yield pd.DataFrame(sorted(rows), columns=["apodo", "nombre"])

    return values.where(F.col("valor").rlike("[«\"“(]")).select("valor").mapInPandas(scan, "apodo string, nombre string").distinct()


def link_persons(values: DataFrame) -> DataFrame:
    """(``valor_a``, ``valor_b``) of the values (``valor``) that name one person."""
    given = set(common_tokens(values, lambda v: person_tokens(v)[0]))
    seen = {}
    for r in stated_nicknames(values, given).collect():
        seen.setdefault(r.apodo, set()).add(r.nombre)
    nicknames = {k: v for k, v in NICKNAMES.items() if k not in given}
    nicknames |= {k: " ".join(sorted(v | set(NICKNAMES.get(k, "").split()))) for k, v in seen.items() if k not in given}
    parsed = values.select("valor", _udf(lambda v: parse_person(v, given, nicknames), "nombre string, ap1 string, ap2 string", F.col("valor")).alias("p")).select("valor", "p.*")
    parsed = cut(parsed.where("ap1 <> ''"))
    whole = ~F.col("nombre").contains(" ") & ~F.col("nombre").endswith(".") & (F.col("ap2") != "") & ~F.col("ap2").endswith(".")
    full = cut(parsed.where(whole).select("nombre", "ap1", "ap2").distinct())
    key = F.concat_ws("|", "nombre", "ap1", "ap2")
    total = full.count()
    for c, w in (("nombre", "wn"), ("ap1", "w1"), ("ap2", "w2")):
        full = full.join(rarity(full, c, total).toDF(c, w), c)
    full = cut(full)
    names = full.select(F.concat("ap1", F.lit(" "), "ap2").alias("k"), "nombre", "ap1", "ap2", "wn", "w1", "w2", key.alias("nodo"))
    slips = similar_keys(names.select("k"))
    left = names.select(F.col("k").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names.columns if c != "k"])
    right = names.select(F.col("k").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names.columns if c != "k"])
    same_name = F.when(F.col("a_nombre") == F.col("b_nombre"), 1.0).otherwise(0.0)
    part = lambda c, w: (typed_alike(F.col(f"a_{c}"), F.col(f"b_{c}")), F.greatest(f"a_{w}", f"b_{w}"))
    alike = soft_similarity((same_name, F.col("a_wn")), part("ap1", "w1"), part("ap2", "w2"))
    edges = slips.join(left, "a").join(right, "b").where(alike >= SOFT).select(F.col("a_nodo").alias("a"), F.col("b_nodo").alias("b"))
    groups = cut(components(names.select("nodo"), edges))
    people = full.withColumn("nodo", key).join(groups, "nodo").select("nombre", "ap1", "ap2", "wn", "w1", "w2", "grupo")
    # shortened forms go to the one person whom they fit
    part = cut(parsed.where(~whole).select("valor", F.split("nombre", " ").alias("posibles"), "nombre", F.col("ap1").alias("s1"), F.col("ap2").alias("s2")))
    yes = lambda c, sim: F.when(c, sim).otherwise(0.0)
    name_sim = (
        F.when(F.col("p.nombre").endswith("."), yes(F.substring("q.nombre", 1, 1) == F.substring("p.nombre", 1, 1), INITIAL))
        .when(F.col("p.nombre") == F.col("q.nombre"), 1.0).otherwise(yes(F.expr("array_contains(p.posibles, q.nombre)"), PET))
    )
    second_sim = F.when(F.col("p.s2") == "", F.lit(None).cast("double")).when(F.col("p.s2").endswith("."), yes(F.substring("q.ap2", 1, 1) == F.substring("p.s2", 1, 1), INITIAL)).otherwise(yes(F.col("p.s2") == F.col("q.ap2"), 1.0))
    fits = lambda first, second: soft_similarity((name_sim, F.col("q.wn")), (first, F.col("q.w1")), (second, F.col("q.w2"))) >= SOFT
    p, q = part.alias("p"), people.alias("q")
    exact = p.join(q, F.col("p.s1") == F.col("q.ap1")).where(fits(F.lit(1.0), second_sim)).select("p.valor", "grupo")
    once = lambda df: df.groupBy("valor").agg(F.count_distinct("grupo").alias("n"), F.min("grupo").alias("grupo"))
    first = cut(once(exact))
    # mistyped surnames in shortened forms
    rest = part.join(first.select("valor"), "valor", "left_anti")
    two = rest.where("s2 <> '' and not endswith(s2, '.')").withColumn("k", F.concat("s1", F.lit(" "), "s2"))
    known = people.withColumn("k", F.concat("ap1", F.lit(" "), "ap2"))
    one = rest.where("s2 = '' or endswith(s2, '.')").withColumn("k", F.col("s1"))
    typed = similar_keys(known.select("k").unionByName(two.select("k")).unionByName(people.select(F.col("ap1").alias("k"))).unionByName(one.select("k")))
    typed = cut(typed.unionByName(typed.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    found2 = two.join(typed, two.k == typed.a).select("valor", "posibles", "nombre", "s1", "s2", F.col("b").alias("k")).alias("p").join(known.alias("q"), F.col("p.k") == F.col("q.k"))
    found2 = found2.where(fits(typed_alike(F.col("p.s1"), F.col("q.ap1")), typed_alike(F.col("p.s2"), F.col("q.ap2")))).select("p.valor", "grupo")
    found1 = one.join(typed, one.k == typed.a).select("valor", "posibles", "nombre", "s1", "s2", "b").alias("p").join(q, F.col("p.b") == F.col("q.ap1"))
    found1 = found1.where(fits(typed_alike(F.col("p.s1"), F.col("q.ap1")), second_sim)).select("p.valor", "grupo")
    home = first.unionByName(once(found1.unionByName(found2))).where("n = 1").select("valor", "grupo")
    placed = parsed.where(whole).withColumn("nodo", key).join(groups, "nodo").select("valor", "grupo").unionByName(home)
    # short forms of people who never occur in full meet in their own canonical form
    loose = part.join(home, "valor", "left_anti").where(~F.col("nombre").endswith(".") & (F.size("posibles") == 1)).select("valor", F.concat_ws("|", F.lit(""), "nombre", "s1", "s2").alias("grupo"))
    return _pairs(placed.unionByName(loose))


def distinct_values(*columns: DataFrame) -> DataFrame:
    """Distinct values (``valor``) of one-column frames, without null and blank ones."""
    out = None
    for df in columns:
        df = df.toDF("valor")
        out = df if out is None else out.unionByName(df)
    return out.where(F.trim("valor") != "").distinct()


def p2_found(evidencias: DataFrame, prospectos: DataFrame) -> DataFrame:
    """(``tipo``, ``valor_a``, ``valor_b``): pairs of different values that name the same organisation or person."""
    orgs = cut(distinct_values(evidencias.select("empresa_mencionada"), prospectos.select("nombre")))
    persons = cut(distinct_values(evidencias.select("persona_citada")))
    a = link_orgs(orgs).select(F.lit("org").alias("tipo"), "valor_a", "valor_b")
    b = link_persons(persons).select(F.lit("persona").alias("tipo"), "valor_a", "valor_b")
    return a.unionByName(b)
