"""Names, batch deduplication, tokens and packing against brute force and round trips."""

import glob
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.llm import batchdedup as D
from tamiz.llm import names as N
from tamiz.llm import packing as P
from tamiz.llm import sortedruns as S
from tamiz.llm import tokenizer as K

ORGS = [
    ["Lodamor Agro", "LODAMOR AGRO", "Lodamor Agro, S.A. de C.V.", "Agro, Lodamor", "LodamorAgro", "Lodamr Agro", "@lodamor", "Lodamor (Agro)", "Lodamor - Agro"],
    ["Grupo Bener Farcar Salud", "Bener-Farcar Salud", "Bener Farcar Sal. SL", "Gpo. Bener Farcar Salud"],
    ["Plicle Cenfar Agro"], ["Plicle Cenfar Salud", "Plicle Cenfar Salud SAS"], ["fintech México"], ["empresa"], ["Plicle Cenfar"],
]
PEOPLE = [
    ["Isabel Morbengo Langon", "Chabela Morbengo", "I. Morbengo Langon", "Morbengo Langon, Isabel", "ISABEL MORBENGO LANGON", "Isabel Morbengo-Langon", "Isabel Morbengo L.", "Dra. Isabel Morbengo", "Isabel Morbemgo Langon"],
    ["Gabriela Nonchefu Pisan", "Gabriela «Gaby» Nonchefu", "Nonchefu, Gaby"], ["Isabel Nonchefu Pisan"], ["Zulema Zanbogo Norze"], ["Zulema Zanbogo Perpu"], ["Zulema Zanbogo"], ["la vocera"], ["fuentes internas"],
]


def wanted(groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_names(spark):
    filler = [f"{b} {s}" for b in ("Tofer", "Gimlar", "Chodrun", "Zupebra", "Nilvast", "Orquend", "Wexulta") for s in ("Agro", "Salud")]
    e = spark.createDataFrame([(v,) for g in ORGS for v in g] + [(v,) for v in filler] + [(None,), ("",), ("Lodamor Agro",)], "empresa_mencionada string")
    given_filler = [f"{g} {s}" for g in ("Isabel", "Gabriela", "Zulema") for s in ("Rotrax Vilmo", "Cheduna Bosti", "Yumbrel Aquite", "Fostepa Lirgo")]
    people = spark.createDataFrame([(v,) for g in PEOPLE for v in g] + [(v,) for v in given_filler] + [(None,), (" ",)], "persona_citada string")
    both = e.withColumn("persona_citada", F.lit(None).cast("string")).unionByName(people.withColumn("empresa_mencionada", F.lit(None).cast("string")))
    found = N.p2_found(both, spark.createDataFrame([("lodamor agro",)], "nombre string")).collect()
    orgs = {(r.valor_a, r.valor_b) for r in found if r.tipo == "org"}
    assert orgs == wanted([ORGS[0] + ["lodamor agro"], *ORGS[1:]])
    assert {(r.valor_a, r.valor_b) for r in found if r.tipo == "persona"} == wanted(PEOPLE)
    assert len(found) == len({(r.tipo, r.valor_a, r.valor_b) for r in found})


def test_similar_keys_equal_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 8))) for _ in range(150)}
    got = {(r.a, r.b) for r in N.similar_keys(spark.createDataFrame([(w,) for w in words], "k string")).collect()}
    assert got <= {(a, b) for a in words for b in words if a < b and N.slip(a, b)}
    long = {w + "qrstuvwxyz" for w in words}
    got = {(r.a, r.b) for r in N.similar_keys(spark.createDataFrame([(w,) for w in long], "k string")).collect()}
    assert got == {(a, b) for a in long for b in long if a < b and N.slip(a, b)}


def test_similar_keys_of_short_words_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"kavak", "kvaak", "konfio", "kofnio", "loft", "lift", "aaaaaaa", "aaaabaaa"} | {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(150)}
    words |= {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in list(words) for k in [rng.randrange(len(w) - 1)]} | {w * 2 for w in list(words)[:40]}
    got = {(r.a, r.b) for r in N.similar_keys(spark.createDataFrame([(w,) for w in words], "k string")).collect()}
    assert {("kavak", "kvaak"), ("kofnio", "konfio")} <= got == {(a, b) for a in words for b in words if a < b and N.slip(a, b)}


def test_soft_similarity_weighs_by_rarity(spark):
    rows = [(1.0, 0.9, 1.0, 0.2), (1.0, 0.9, 0.0, 0.2), (0.75, 0.9, 1.0, 0.2), (0.8, 0.2, 1.0, 0.9), (0.8, 0.9, 1.0, 0.2), (1.0, 0.9, None, 0.2), (None, 0.9, None, 0.2), (0.0, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s1 double, w1 double, s2 double, w2 double")
    got = [round(r[0], 3) for r in df.select(N.soft_similarity((F.col("s1"), F.col("w1")), (F.col("s2"), F.col("w2")))).collect()]
    assert got == [1.0, 0.474, 0.795, 0.964, 0.836, 1.0, 0.0, 0.5]  # a slip in a rare token costs more; a contradiction decides
    w = {r.t: r.peso for r in N.rarity(spark.createDataFrame([("a",)] * 50 + [("b",)], "t string"), "t", 51).collect()}
    assert w["a"] < 0.2 < 0.99 < w["b"] <= 1
    assert N.token_slips("morbengo langon", "morbemgo lamgon") and not N.token_slips("morbengo langon", "morbemgo lamgom") and not N.token_slips("gil rey", "gal ley")


def test_nicknames_are_learned_from_all_values(spark):
    # more than 20,000 values with marks, of which only the last states the nickname
    filler = spark.range(30_000).select(F.concat(F.lit("Isabel («Isa») Morbengo "), F.col("id").cast("string")).alias("valor"))
    last = [f"Gabriela {s}" for s in ("Nonchefu Pisan", "Rotrax Vilmo", "Cheduna Bosti", "«Gabita» Yumbrel")]
    values = filler.unionByName(spark.createDataFrame([(v,) for v in last], "valor string")).coalesce(1)
    got = {(r.apodo, r.nombre) for r in N.stated_nicknames(values, {"isabel", "gabriela"}).collect()}
    assert got == {("isa", "isabel"), ("gabita", "gabriela")}


def statements(rng, n):
    people = ["Ana Ruiz", "Luis Gil", "Eva Sanz", "Jorge Vera", "Rosa Cano"]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.45:
            t = rng.choice(rows)[2]
            t = rng.choice([t, t.upper(), t + " - El Diario", "Urgente – " + t, t.replace("despide a", "cesa a"), t.replace("ó", "o").replace("á", "a"), t + "!", t.replace(" ", "  "), t.replace("ñ", "Ã±").replace("ó", "Ã³")])
        else:
            t = f"Lodamor despide a {rng.randint(1, 60)} personas en Lima; {rng.choice(people)} pidió más calma al año"
        rows.append((k, rng.choice([None, f"h{rng.randint(0, n)}"]), t))
    return rows


def brute(rows, outlets, common):
    accepted, pairs = [], set()
    for i, h, t in sorted(rows):
        f = D.normal_form(t, outlets)
        hit = [j for j, g, k in accepted if (h and h == g) or (f and (f == k or D.same_statement(k, f, common)))]
        if hit:
            pairs |= {(j, i) for j in hit}
        else:
            accepted.append((i, h, f))
    return pairs


def test_repeats_equal_brute_force_and_batches(spark, tmp_path):
    rows = statements(random.Random(4), 160) + [(900, "x", None), (901, "x", ""), (902, None, None), (903, None, "Error 404: Page not found"), (904, None, "Error 404: Page not found")]
    df = spark.createDataFrame(rows, "id long, hash_dedup string, cita_textual string").withColumn("clase", F.lit("clash"))
    outlets = frozenset({"el diario"})
    common = D.common_words(df, "cita_textual")
    want = brute([r for r in rows if r[0] < 903], outlets, common)
    assert {(r.id_a, r.id_b) for r in D.find_repeats(df, outlets).collect()} == want
    index = D.AcceptedIndex(spark, str(tmp_path / "a"), outlets, common)
    got = set()
    for k, (lo, hi) in enumerate([(0, 60), (60, 130), (130, 1000)]):
        got |= {(r.id_a, r.id_b) for r in index.add_batch(df.where((F.col("id") >= lo) & (F.col("id") < hi))).collect()}
        if k == 1:
            index = index.merge_runs(str(tmp_path / "b"))
    assert got == want
    assert D.find_repeats(df.limit(0), outlets).count() == 0


def test_large_candidate_groups_are_exact(spark, monkeypatch):
    rows = statements(random.Random(9), 90)
    df = spark.createDataFrame(rows, "id long, hash_dedup string, cita_textual string")
    want = {(r.id_a, r.id_b) for r in D.find_repeats(df, frozenset({"el diario"})).collect()}
    monkeypatch.setattr(D, "PAIRWISE", 2)
    assert {(r.id_a, r.id_b) for r in D.find_repeats(df, frozenset({"el diario"})).collect()} == want


def damaged(rng, words, n):
    """``words`` with ``n`` of them mistyped or damaged."""
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        w = out[k]
        at = rng.randrange(1, len(w) - 1)
        out[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "q" + w[at + 1 :], w[:at] + "�" + w[at + 1 :]])
    return out


def near(classes, common):
    run = D.SortedRuns(classes.sparkSession, D.index_folder(classes.sparkSession))
    D.write_forest(run, classes, common)
    return D.near_classes(classes, common, run)


def test_short_labels_with_slips_equal_brute_force(spark):
    rng = random.Random(3)
    common = frozenset("la el de en que pide mientras".split())
    rows = []
    for k in range(240):
        names = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(2 + k % 7)]
        words = lambda names, k=k: ["la", *names, "pide", "en", "el", str(k % 5), *(["de", "que", "mientras"] if len(names) < 3 else [])]
        other = damaged(rng, names, min(len(names) - 1, 3))
        rows += [(2 * k, " ".join(words(names))), (2 * k + 1, " ".join(words(other)))]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and D.same_statement(x, y, common)}
    classes = spark.createDataFrame(rows, "clase long, forma string")
    assert len(want) >= 230 and {(r.a, r.b) for r in near(classes, common)[0].collect()} == want


def test_rejected_leader_of_large_group_keeps_links(spark, monkeypatch):
    # the leader repeats an accepted row by its hash; what it took is accepted or not among itself
    name = "lodamor bener farcar gimlar tofer plicle".split()
    form = lambda *more: " ".join([*name, *more, "7"])
    common = frozenset("de la el en que con por su al lo".split())
    texts = ["nada que ver con 9", form("de", "la", "el", "en"), form("de", "la", "el", "que", "con"), form("de", "la", "el", "que", "con", "por"), form("de", "la", "el", "que", "con", "por", "su")]
    rows = spark.createDataFrame([(k, "h" if k < 2 else None, k, t) for k, t in enumerate(texts)], "id long, hash_dedup string, clase long, forma string")
    classes = rows.select("clase", "forma")
    want = {(0, 1), (2, 3), (2, 4)}
    for size in (64, 2):
        monkeypatch.setattr(D, "PAIRWISE", size)
        links, large, tested = near(classes, common)
        assert (large is None) == (size == 64)
        assert {(r.id_a, r.id_b) for r in D.settled(rows, classes, common, links, large, tested).collect()} == want


def test_prefixes_are_widened_to_the_recall_target():
    found = lambda similarity, depth: 1 - (1 - similarity**depth) ** D.TREES
    d = D.prefix_depth()
    assert d < D.LABEL and found(D.SIMILARITY, d) >= D.RECALL > found(D.SIMILARITY, d + 1)
    assert D.prefix_depth(D.SAME_WORDS) == 2 and found(D.SAME_WORDS, 2) >= D.RECALL


def test_recall_of_similar_labels(spark):
    # pairs that share no exact key: long labels of which a fifth of the words differ
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    rows, want = [], set()
    for k in range(150):
        names = [word() for _ in range(36)]
        other = damaged(rng, names, 4)
        rows += [(2 * k, " ".join(names)), (2 * k + 1, " ".join(other))]
        want.add((2 * k, 2 * k + 1))
    got = {(r.a, r.b) for r in near(spark.createDataFrame(rows, "clase long, forma string"), frozenset())[0].collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_leader_that_repeats_by_hash(spark):
    # an unrelated row and the leader of a large group share a hash; the group's other wordings are linked among themselves
    common = "de la el en que con por su al lo le les una uno".split()
    rows = [(0, "h", "Nada que ver con 9"), (1, "h", "Lodamor Bener Farcar Gimlar Tofer Plicle 7 " + " ".join(common[:6]))]
    rows += [(k, None, "Lodamor Bener Farcar Gimlar Tofer Plicle 7 " + " ".join([*common[:6], *[common[6 + j] for j in range(8) if (k >> j) & 1][:4]])) for k in range(2, 67)]
    lower = [(1000 + k, None, f"Nota {k} {' '.join(common)} xx") for k in range(3)]  # so that these words are common
    df = spark.createDataFrame(rows + lower, "id long, hash_dedup string, cita_textual string")
    words = D.common_words(df, "cita_textual")
    assert set(common) <= words
    got = {(r.id_a, r.id_b) for r in D.find_repeats(df, frozenset()).collect()}
    assert got == brute(rows + lower, frozenset(), words) and len(got) >= 60


def test_batch_opens_matching_row_groups_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 12)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    texts = [" ".join(word() for _ in range(8)) + f" {k}" for k in range(3000)]
    rows = spark.createDataFrame([(k, f"h{k}", t) for k, t in enumerate(texts)], "id long, hash_dedup string, cita_textual string")
    index = D.AcceptedIndex(spark, str(tmp_path / "c"), frozenset(), frozenset())
    assert index.add_batch(rows).count() == 0
    index.leidos.value = index.guardados.value = 0
    late = spark.createDataFrame([(5000, "x", texts[7].upper()), (5001, "h9", "Otra cosa 1"), (5002, "y", "Sin par 2")], "id long, hash_dedup string, cita_textual string")
    assert {(r.id_a, r.id_b) for r in index.add_batch(late).collect()} == {(7, 5000), (9, 5001)}
    assert 0 < index.leidos.value < 0.35 * index.guardados.value
    assert not glob.glob(str(tmp_path / "c" / "lote-*")) and len(glob.glob(str(tmp_path / "c" / "bosque" / "*"))) == 2


def test_search_of_sorted_runs_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 12)
    rng = random.Random(11)
    runs = S.SortedRuns(spark, str(tmp_path / "r"))
    data = []
    for r in range(2):
        rows = [(rng.choice([rng.randrange(-500, 500), 7, 7, -(1 << 62)]), 1000 * r + k) for k in range(900)]
        runs.add(spark.createDataFrame(rows, "k long, v long").repartition(3), "v")
        data += rows
    runs.add(spark.createDataFrame([], "k long, v long"), "v")
    asked = [(lo, lo + rng.randrange(0, 30), q) for q, lo in enumerate(rng.randrange(-600, 600) for _ in range(60))] + [(-(1 << 62), -(1 << 62), 100), (900, 999, 101)]
    want = {(q, v) for lo, hi, q in asked for k, v in data if lo <= k <= hi}
    ranges = spark.createDataFrame(asked, "lo long, hi long, q long")
    take = lambda a, f: pd.DataFrame({"q": a["q"], "v": f["v"]})
    assert {(r.q, r.v) for r in runs.search(ranges, ["v"], take, "q long, v long").collect()} == want
    sizes = {q: sum(lo <= k <= hi for k, _ in data) for lo, hi, q in asked}
    full = lambda a: pd.DataFrame({"q": a["q"], "v": -1})
    got = {(r.q, r.v) for r in runs.search(ranges, ["v"], take, "q long, v long", 40, full).collect()}
    assert got == {(q, v) for q, v in want if sizes[q] <= 40} | {(q, -1) for q, n in sizes.items() if n > 40}
    one = runs.merge(str(tmp_path / "m"), "v")
    assert one.runs == 1 and sorted(map(tuple, one.rows().select("k", "v").collect())) == sorted(data)
    assert {r.k for r in S.lookup(one, spark.createDataFrame([(7,), (12345,)], "k long"), ["v"], "v long").collect()} == {7}
    runs.drop()
    assert not glob.glob(str(tmp_path / "r" / "*"))


@pytest.fixture(scope="module")
def codec():
    return K.codec(K.vocabulary_path(), K._pattern())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_equal_reference_and_round_trip(text):
    import public_tokenizers
    import tiktoken

    c = K.codec(K.vocabulary_path(), K._pattern())
    ids = c.encode(text)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=K.read_ranks(K.vocabulary_path()), special_tokens={})
    assert ids == own.encode_ordinary(text) and c.decode(ids) == text


def test_tokens_frame(spark, codec):
    df = spark.createDataFrame([(1, "La marca <|endoftext|> apareció"), (2, None), (3, ""), (4, "a" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: list(r.ids) for r in K.p8_ids(df).collect()}
    assert got[2] == [] and got[3] == [] and 50256 not in got[1] and codec.decode(got[4]) == "a" * 100_000
    back = K.p8_ids(df).select("doc_id", K.token_texts(F.col("ids")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back}[1] == "La marca <|endoftext|> apareció"
    assert K.p8_ids(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_is_whole_and_fits(sizes):
    counts = P.Counter(sizes) if hasattr(P, "Counter") else {x: sizes.count(x) for x in sizes}
    plan = P.make_plan(dict(counts), 40)
    used: dict[int, int] = {}
    for pattern, n in plan.runs:
        assert sum(a * k for a, k in pattern) <= 40
        for a, k in pattern:
            used[a] = used.get(a, 0) + k * n
    assert used == {k: v for k, v in dict(counts).items() if v}
    assert plan.containers <= len(sizes)


def test_packing_frame(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("hola" for _ in range(rng.choice([3, 3, 3, 7, 9, 20, 45])))) for k in range(120)] + [(500, None), (501, ""), (502, "hola " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("contenedor", F.lit("clash")).repartition(3)
    caps = spark.createDataFrame([("a", "byte_bpe_50k", 32), ("b", "byte_bpe_50k", 100)], "perfil string, tokenizador string, capacidad int")
    got = P.p9_asignacion(docs, caps).collect()
    size = {r.doc_id: len(r.ids) for r in K.p8_ids(docs).collect()}
    for name, cap in (("a", 32), ("b", 100)):
        mine = [r for r in got if r.perfil == name]
        load: dict[int, int] = {}
        total: dict[int, int] = {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            if r.contenedor is None:
                assert r.tokens == 0
            else:
                load[r.contenedor] = load.get(r.contenedor, 0) + r.tokens
        assert total == size and max(load.values()) <= cap and set(load) == set(range(len(load)))
        assert all(sum(r.doc_id == d for r in mine) == max(1, -(-n // cap)) for d, n in size.items())
        assert len(load) <= -(-sum(size.values()) // cap) + 2
    assert P.p9_resumen(docs, caps).count() == 2
    assert P.p9_asignacion(docs.limit(0), caps).count() == 0
