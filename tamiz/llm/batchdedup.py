"""Duplicates of new batches against all accepted history (problem 5).

Statements are brought to a normal form (garbling repaired, labels and outlet names removed, case, accents, punctuation
and spacing folded). Equal forms are one class, found by aggregation. The classes are kept in a prefix-tree hash forest: for
each of ``TREES`` permutation families a statement has a label of ``LABEL`` minimum hashes over its telling words (figures, names
and other words that aren't common). Tree, figures and label are one sortable number; the numbers are persisted as sorted
runs (``sortedruns``), one run a batch. The entries near a batch entry are those in the range of its label's prefix; a search
opens only the row groups that overlap a range. Prefixes are widened, from the whole label on, until the trees together
find pairs of the least similarity with the probability ``RECALL`` (``prefix_depth``).
Slips and damaged letters make telling words differ, which weighs most in short labels; so each statement also has exact
keys, the figures with each few of its other telling words (``exact_keys``), and statements with hardly any telling words
are in trees over all their words, too, with the depth for ``SAME_WORDS``.
Every candidate is verified: figures in the same order, the same names (up to damaged letters and one typing slip), and
most of the other words. Rows arrive in order of ``id``; a row is accepted unless it repeats an accepted one.

Defined results: null and blank texts repeat nothing by wording, only by equal ``hash_dedup``; a null hash equals none.
Ties can't occur, as ``id`` is unique. Groups of equal forms are never expanded into pairs: each repeat is linked to
what it repeats among the accepted rows, which is at most one row per class and one per hash.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tamiz.llm.encoding import repaired
from tamiz.llm.residue import is_residue_quote
from tamiz.llm.sortedruns import SortedRuns, lookup, placed
from tamiz.llm.textutil import fold
from tamiz.session import cut, ensure_checkpoint_dir

TREES, LABEL = 8, 6
#: Least similarity of the telling words of two forms of one statement, and the share of such pairs to be found.
SIMILARITY, RECALL = 0.8, 0.95
#: Least share of words that two forms have in common (multiset Jaccard).
SAME_WORDS = 0.6
#: Telling words of an exact key: so many, for statements with that many telling words besides figures (least, most).
EXACT = ((1, 1, 4), (2, 2, 5), (3, 3, 1 << 30))
#: So many telling words of a longer statement may be missing from the other one, and an exact key is still shared.
MISSING = 3
#: Statements with so many telling words besides figures at most are in the trees over all words, with prefixes of two values.
FEW = 2
#: Least share of the rows that have a common word in lower case.
COMMON_SHARE = 1e-5
#: Least share of lower case among the occurrences of a common word (a word may often begin sentences or names).
LOWER_SHARE = 0.002
#: The entries of ranges up to this size are compared pairwise; of larger ones with their leaders, round by round, then with what was accepted.
PAIRWISE = 64
#: The forest's entries: sortable number and class.
FOREST = "k long, clase long"
#: Classes on which the ranges of keys are found into which a run is parted, and the entries that a part is to have.
PARTING, PART_ROWS = 20_000, 32_000_000
#: Numbers of the trees of exact keys and of record hashes; trees over all words follow those over telling words.
EXACT_TREE, HASH_TREE = 2 * TREES, 2 * TREES + 1
#: Bits of the number: the tree, the figures with the first two values of the label, then so many for each further value.
TREE_BITS, CELL_BITS, VALUE_BITS = 5, 27, 8

_LABEL = re.compile(
    r"^\W*(?:urgente|lo ultimo|lo último|ultima hora|última hora|breaking|exclusiva|exclusivo|video|vídeo|foto|fotos|audio|en vivo|ao vivo|live|ahora|agora|alerta|update|actualizado|atualizado)\s*[.:|)\]–—-]+\s+", re.I
)
_SUFFIX = re.compile(r"\s+[|–—-]\s+((?:(?!\s+[|–—-]\s)[^\n]){3,60}?)[\s.!?]*$")
_SIC = re.compile(r"[\[(]\s*sic\s*[\])]", re.I)
_WORD = re.compile("[^\\W_]*�[^\\W_]*(?:�[^\\W_]*)*|[^\\W_]+")
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * LABEL, dtype=np.uint64)


def prefix_depth(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest label prefix with which ``trees`` trees still find a pair of that similarity with that probability."""
    depth = LABEL
    while depth > 2 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def normal_form(text: str | None, outlets: frozenset[str]) -> str:
    """Words of a statement, folded, without labels and outlet names; damaged letters stay as U+FFFD. Empty for null."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", _SIC.sub(" ", repaired(text)))
    while (cutoff := _LABEL.sub("", text)) != text:
        text = cutoff
    while (m := _SUFFIX.search(text, max(0, len(text) - 80))) and fold(m.group(1)) in outlets:
        text = text[: m.start()]
    words = _WORD.findall(fold(text))
    out = []
    for w in words:
        if w.strip("�") == "":
            continue
        out += ("de", "el") if w == "del" else ("a", "el") if w == "al" else (w,)
    return " ".join(out)


def telling_words(words: list[str], common: frozenset[str]) -> list[str]:
    """Figures, names and rare words without damaged letters; all words if there are none."""
    return [w for w in words if w not in common and "�" not in w] or words


def names_of(form: str, common: frozenset[str]) -> set[str]:
    """The telling words of a normal form besides figures; may be empty."""
    return {w for w in form.split(" ") if w not in common and "�" not in w and not w[:1].isdigit()}


def exact_keys(form: str, common: frozenset[str]) -> list[int]:
    """Hashes of the subsets of telling words besides figures under which a statement is looked up exactly.

    Of two statements with the same figures, one such key is shared if at most all but one of up to four, or ``MISSING``
    of more telling words are missing from the other one, on either side: taken in one order, the first three
    that they share stand among the first three and ``MISSING`` of both.
    """
    h = sorted((c ^ (c >> 15)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for c in (zlib.crc32(w.encode()) for w in names_of(form, common)))
    return [sum(x) * 0xD6E8FEB86659FD93 + size & 0xFFFFFFFFFFFFFFFF for size, least, most in EXACT if least <= len(h) <= most for x in combinations(h[: size + MISSING], size)]


def label_matrix(forms: list[str], common: frozenset[str]) -> np.ndarray:
    """Minimum hashes of normal forms: for each, ``TREES`` labels of ``LABEL`` values of 16 bits. Worked out for many forms at once."""
    out = np.empty((len(forms), TREES * LABEL), dtype=np.uint16)
    for lo in range(0, len(forms), 2000):
        words = [sorted(set(telling_words(f.split(" "), common))) for f in forms[lo : lo + 2000]]
        starts = np.cumsum([0] + [len(w) for w in words])[:-1]
        x = np.array([zlib.crc32(w.encode()) for ws in words for w in ws], dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = (x[:, None] ^ _B[None, :]) * _A[None, :]  # wraps around, so that small codes don't win in every permutation
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        out[lo : lo + 2000] = (np.minimum.reduceat(h, starts, axis=0) & np.uint64(0xFFFF)).astype(np.uint16)
    return out.reshape(len(forms), TREES, LABEL)


def _slip(a: str, b: str) -> bool:
    """Whether two words are equal up to damaged letters, or up to one inserted, lost, changed or swapped letter."""
    if "�" in a or "�" in b:
        if "�" in b and "�" not in a:
            a, b = b, a
        return bool(re.fullmatch("".join("[^\\W_]{0,2}" if c == "�" else re.escape(c) for c in a), b)) if "�" not in b else a == b
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def same_statement(a: str, b: str, common: frozenset[str]) -> bool:
    """Whether two normal forms are the same statement in the same wording, apart from form."""
    wa, wb = a.split(" "), b.split(" ")
    if [w for w in wa if w[:1].isdigit()] != [w for w in wb if w[:1].isdigit()]:
        return False
    ca, cb = Counter(wa), Counter(wb)
    both = sum((ca & cb).values())
    only_a, only_b = list((ca - cb).elements()), list((cb - ca).elements())
    rare_b = [w for w in only_b if w not in common]
    for w in [w for w in only_a if w not in common]:
        hit = next((x for x in only_b if _slip(w, x)), None)
        if hit is None:
            return False
        only_a.remove(w)
        only_b.remove(hit)
        if hit in rare_b:
            rare_b.remove(hit)
        both += 1
    for w in rare_b:
        hit = next((x for x in only_a if _slip(w, x)), None)
        if hit is None:
            return False
        only_a.remove(hit)
        only_b.remove(w)
        both += 1
    return both >= SAME_WORDS * (both + len(only_a) + len(only_b))


def common_words(rows: DataFrame, text_col: str) -> frozenset[str]:
    """Words that are also written in lower case, which names never are. Counted over all rows, in texts of mixed case, outside addresses.

    A word must occur in ``COMMON_SHARE`` of the rows (twice at least), so that their number is bounded.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lower: Counter[str] = Counter()
        other: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                if t.islower() or t.isupper():
                    continue
                if "/" in t or "@" in t:
                    t = _ADDRESS.sub(" ", t)
                for w in set(_PLAIN.findall(t)):
                    (lower if w.islower() else other)[w] += 1
        total: dict[str, list[int]] = {}
        for k, c in enumerate((lower, other)):
            for w, n in c.items():
                total.setdefault(fold(w), [0, 0])[k] += n
        yield pd.DataFrame([(w, a, b) for w, (a, b) in total.items()], columns=["w", "a", "b"])

    n = rows.count()
    words = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).mapInPandas(count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return frozenset(r.w for r in words.where((F.col("a") >= LOWER_SHARE * F.col("b")) & (F.col("a") >= max(2, int(COMMON_SHARE * n)))).select("w").collect())


_ADDRESS = re.compile(r"\S*[/@]\S*")
_PLAIN = re.compile(r"[^\W\d_]+")


def forms(rows: DataFrame, outlets: frozenset[str], skip_residue: bool = True) -> DataFrame:
    """(``id``, ``hash_dedup``, ``forma``) of the rows, without residue rows if asked."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if skip_residue:
                pdf = pdf[[not is_residue_quote(t) for t in pdf["texto"]]]
            yield pd.DataFrame({"id": pdf["id"], "hash_dedup": pdf["hash_dedup"], "forma": [normal_form(t, outlets) for t in pdf["texto"]]})

    return rows.select(F.col("id").cast("long").alias("id"), "hash_dedup", F.col("cita_textual").alias("texto")).mapInPandas(scan, "id long, hash_dedup string, forma string")


def figures_key(form: str) -> int:
    """Hash of the figures of a normal form, in order. Forms with different figures are never the same statement."""
    return zlib.crc32(" ".join(w for w in form.split(" ") if w[:1].isdigit()).encode())


def _numbers(tree: np.ndarray | int, figures: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Sortable numbers of labels (one row each); labels of two values fill the number, longer ones are ordered by prefix."""
    whole = labels.shape[-1] == 2
    cell = figures.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(2):
            cell = (cell ^ labels[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            cell ^= cell >> np.uint64(29)
    k = cell >> np.uint64(64 - CELL_BITS if not whole else TREE_BITS)
    for j in range(2, labels.shape[-1]):
        k = (k << np.uint64(VALUE_BITS)) | (labels[..., j].astype(np.uint64) & np.uint64((1 << VALUE_BITS) - 1))
    return ((np.asarray(tree, dtype=np.uint64) << np.uint64(64 - TREE_BITS)) | k).view(np.int64)


def forest(classes: DataFrame, common: frozenset[str], bounds: np.ndarray | None = None) -> DataFrame:
    """The forest's entries (``FOREST``) of ``clase`` and ``forma``: one per tree, and one per exact key; with ``bounds`` also their ``parte``.

    The figures stand before the label, so that the range of a prefix holds only entries with the same figures.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts, ids = pdf["forma"].tolist(), pdf["clase"].to_numpy()
            figures = np.array([figures_key(f) for f in texts], dtype=np.uint64)
            few = np.array([k for k, f in enumerate(texts) if len(names_of(f, common)) <= FEW], dtype=np.int64)
            order = np.arange(TREES, dtype=np.uint64)[None, :]
            trees = _numbers(order, figures[:, None], label_matrix(texts, common)).reshape(-1)
            more = _numbers(order + np.uint64(TREES), figures[few][:, None], label_matrix([texts[k] for k in few], _NONE)[:, :, :2]).reshape(-1)
            exact = [exact_keys(f, common) for f in texts]
            sizes = [len(x) for x in exact]
            with np.errstate(over="ignore"):
                e = (np.array([y for x in exact for y in x], dtype=np.uint64) ^ np.repeat(figures, sizes)) * np.uint64(0x9E3779B97F4A7C15)
            e = ((e ^ (e >> np.uint64(29))) >> np.uint64(TREE_BITS) | np.uint64(EXACT_TREE << 64 - TREE_BITS)).view(np.int64)
            out = pd.DataFrame({"k": np.concatenate([trees, more, e]), "clase": np.concatenate([np.repeat(ids, TREES), np.repeat(ids[few], TREES), np.repeat(ids, sizes)])})
            yield out if bounds is None else out.assign(parte=placed(out["k"].to_numpy(), out["clase"].to_numpy(), bounds))

    return classes.select("clase", "forma").mapInPandas(scan, FOREST if bounds is None else f"{FOREST}, parte int")


def write_forest(run: SortedRuns, classes: DataFrame, common: frozenset[str]) -> None:
    """Write the forest of ``classes`` as a run.

    The ranges of its parts come from about ``PARTING`` classes, chosen by hash: they only balance the parts, so that the
    entries needn't be worked out twice.
    """
    n = max(classes.count(), 1)
    some = classes.where(F.pmod(F.xxhash64("clase"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, PARTING / n)))
    keys = np.sort(np.array([r.k for r in forest(some, common).select("k").collect()], dtype=np.int64))
    asked = min(n, PARTING)
    parts = max(classes.sparkSession.sparkContext.defaultParallelism, -(-len(keys) * n // (asked * PART_ROWS)))
    bounds = keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else keys
    run.add(forest(classes, common, bounds), "clase", parts)


def hash_entries(rows: DataFrame, id_col: str) -> DataFrame:
    """The forest's entries of record hashes (``hash_dedup``), looked up exactly; null hashes have none."""
    top = (HASH_TREE << 64 - TREE_BITS) - (1 << 64)
    k = F.xxhash64("hash_dedup").bitwiseAND(F.lit((1 << 64 - TREE_BITS) - 1)).bitwiseOR(F.lit(top))
    return rows.where("hash_dedup is not null").select(k.alias("k"), F.col(id_col).alias("clase"))


def ranges_of(entries: DataFrame) -> DataFrame:
    """The ranges (``lo``, ``hi``) in which a search looks for what is near the entries: the prefix in trees over telling words, one number elsewhere."""
    free = (1 << VALUE_BITS * (LABEL - prefix_depth())) - 1
    label = F.shiftrightunsigned("k", 64 - TREE_BITS) < TREES
    return entries.select(F.when(label, F.col("k").bitwiseAND(F.lit(~free))).otherwise(F.col("k")).alias("lo"), F.when(label, F.col("k").bitwiseOR(F.lit(free))).otherwise(F.col("k")).alias("hi"), "clase")


_NONE: frozenset[str] = frozenset()


def _verified(pairs: DataFrame, classes: DataFrame, common: frozenset[str]) -> DataFrame:
    """Of (``a``, ``b``) class pairs those that are the same statement."""
    one = classes.select(F.col("clase").alias("a"), F.col("forma").alias("fa"))
    two = classes.select(F.col("clase").alias("b"), F.col("forma").alias("fb"))
    texts = pairs.join(one, "a").join(two, "b")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[same_statement(x, y, common) for x, y in zip(pdf["fa"], pdf["fb"], strict=True)], ["a", "b"]]

    return texts.select("a", "b", "fa", "fb").mapInPandas(scan, "a long, b long")


def near_classes(classes: DataFrame, common: frozenset[str], run: SortedRuns) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Links (``a`` < ``b``) between classes that are forms of one statement; all there are in ranges of up to ``PAIRWISE`` entries.

    ``run``: the classes' own sorted run, in which each of its entries is searched. Larger ranges are compared with their leaders here, twice as
    many each round, and returned (``k``, ``clase``) with the pairs that were compared, for ``settled``; None and None if
    there are no such ranges.
    """

    def pairs_of(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        a, b = asked["clase"].to_numpy(), found["clase"].to_numpy()
        take = b < a  # the other one's search finds the pair, too
        return pd.DataFrame({"grande": False, "a": b[take], "b": a[take]}).drop_duplicates()

    def crowd(asked: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grande": True, "a": asked["lo"].to_numpy(), "b": asked["hi"].to_numpy()}).drop_duplicates()

    own = W.partitionBy("k")
    hits = cut(run.search(ranges_of(run.rows()), ["clase"], pairs_of, "grande boolean, a long, b long", PAIRWISE, crowd).distinct())
    links = _verified(hits.where("not grande").select("a", "b"), classes, common)
    wide = hits.where("grande").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    if wide.isEmpty():
        return links.distinct(), None, None
    member = lambda asked, found: pd.DataFrame({"lo": asked["lo"], "hi": asked["hi"], "clase": found["clase"]})
    members = run.search(wide, ["clase"], member, "lo long, hi long, clase long").distinct()
    large = cut(members.select(F.xxhash64("lo", "hi").alias("k"), "clase"))
    rest, tested, leaders = large, None, 1
    while not rest.isEmpty():
        # each member against its group's leaders; the group goes on without the leaders and what they took
        ranked = cut(rest.withColumn("r", F.row_number().over(own.orderBy("clase"))))
        first = ranked.where(F.col("r") <= leaders).select("k", F.col("clase").alias("a"))
        pairs = cut(first.join(ranked.select("k", F.col("clase").alias("b")), "k").where("a < b"))
        asked = pairs.select("a", "b").distinct()
        tested = asked if tested is None else tested.unionByName(asked)
        found = cut(_verified(asked, classes, common))
        links = links.unionByName(found)
        taken = pairs.join(found, ["a", "b"], "left_semi").select("k", F.col("b").alias("clase")).distinct()
        rest = cut(ranked.where(F.col("r") > leaders).select("k", "clase").join(taken, ["k", "clase"], "left_anti"))
        leaders *= 2
    return links.distinct(), large, tested.distinct()


def settled(rows: DataFrame, classes: DataFrame, common: frozenset[str], links: DataFrame, large: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """What ``_accept`` gives with all links of the large groups, too, though only those to accepted rows are looked for.

    After each acceptance the classes of accepted rows are compared with all members of their large groups; new links may
    change what is accepted. When none is new, every link that acceptance or the result asks for is known.
    """
    found = _accept(rows, links)
    while large is not None:
        found = cut(found)
        kept = rows.join(found.select(F.col("id_b").alias("id")).distinct(), "id", "left_anti").select("clase").distinct()
        one = large.join(kept, "clase").select("k", F.col("clase").alias("x"))
        pairs = one.join(large, "k").where("x <> clase").select(F.least("x", "clase").alias("a"), F.greatest("x", "clase").alias("b")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        new = cut(_verified(pairs, classes, common))
        if new.isEmpty():
            break
        tested = cut(tested.unionByName(pairs))
        links = cut(links.unionByName(new).distinct())
        found = _accept(rows, links)
    return found


def _accept(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(``id_a``, ``id_b``): each repeat with the accepted rows it repeats.

    ``rows``: ``id``, ``hash_dedup``, ``clase``. A row announces its hash and its class and listens to these and to the
    linked classes; it is accepted when no undecided row before it announces what it listens to and none accepted does.
    """
    short = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), c)))  # noqa: E731  # 16 bytes to shuffle, whatever the key
    tell = rows.select("id", F.explode(F.array(short("h", F.col("hash_dedup")), short("c", F.col("clase").cast("string")))).alias("k")).where("k is not null")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = rows.join(both, rows.clase == both.a).select("id", short("c", F.col("b").cast("string")).alias("k"))
    hear = tell.unionByName(near)
    # only keys that two rows share matter, and only rows that hear such a key
    shared = hear.groupBy("k").agg(F.count_distinct("id").alias("n")).where("n > 1").select("k")
    hear = cut(hear.join(shared, "k").distinct())
    tell = cut(tell.join(shared, "k").distinct())
    open_ = hear.select("id").distinct()
    accepted = None
    while True:
        first = tell.join(open_, "id").groupBy("k").agg(F.min("id").alias("primero"))
        blocked = hear.join(open_, "id").join(first, "k").where("primero < id").select("id").distinct()
        new = cut(open_.join(blocked, "id", "left_anti"))
        accepted = new if accepted is None else accepted.unionByName(new)
        took = tell.join(new, "id").select("k", F.col("id").alias("id_a"))
        repeats = hear.join(open_, "id").join(took, "k").where("id_a < id").select("id").distinct()
        open_ = cut(open_.join(new, "id", "left_anti").join(repeats, "id", "left_anti"))
        if open_.isEmpty():
            break
    by = tell.join(accepted, "id").select("k", F.col("id").alias("id_a"))
    out = hear.join(accepted, "id", "left_anti").join(by, "k").where("id_a < id")
    return out.select("id_a", F.col("id").alias("id_b")).distinct()


def outlets_of(medios: DataFrame) -> frozenset[str]:
    """Folded names of the outlets (a fixed small table)."""
    return frozenset(fold(r.nombre_medio) for r in medios.select("nombre_medio").collect() if r.nombre_medio)


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal normal forms, named by their least id: (``huella``, ``clase``), and (``clase``, ``forma``) of each class once.

    Forms are compared by their md5, so that texts aren't shuffled to be grouped.
    """
    digest = F.unhex(F.md5("forma"))
    some = rows.where("forma <> ''").select("id", digest.alias("huella"), "forma")
    named = some.groupBy("huella").agg(F.min("id").alias("clase"))
    return named, some.join(named.select(F.col("clase").alias("id")), "id", "left_semi").select(F.col("id").alias("clase"), "forma")


def named_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(``id``, ``hash_dedup``, ``clase``); rows without words are classes of their own."""
    n = rows.select("id", "hash_dedup", F.when(F.col("forma") != "", F.unhex(F.md5("forma"))).alias("huella"))
    return n.join(named, "huella", "left").select("id", "hash_dedup", F.coalesce("clase", "id").alias("clase"))


def index_folder(spark: SparkSession) -> str:
    """A new folder for runs beside the checkpoints, in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/bosque-{uuid.uuid4().hex}"


def find_repeats(rows: DataFrame, outlets: frozenset[str]) -> DataFrame:
    """(``id_a``, ``id_b``) over all rows (``id``, ``hash_dedup``, ``cita_textual``), taken in order of ``id`` as one batch for an empty index."""
    return AcceptedIndex(rows.sparkSession, index_folder(rows.sparkSession), outlets, common_words(rows, "cita_textual")).add_batch(rows, last=True)


class AcceptedIndex:
    """The persisted forest over accepted rows, for batches that arrive one by one.

    Two sets of sorted runs in a shared folder, each batch adding one run to both: the forest with the record hashes, and the
    accepted rows by ``id`` with their normal forms. A batch is normalised, written as a sorted run of its own and searched
    in that run and, by the same ranges, in the forest's; forms and hashes are read only of what the search found. Neither
    the history's texts nor row groups of the forest without a range are read (``leidos`` and ``guardados`` count the
    bytes of row groups opened, and of all there were to search). ``merge_runs`` sorts all runs into one.
    """

    def __init__(self, spark: SparkSession, path: str, outlets: frozenset[str], common: frozenset[str]):
        self.spark, self.path, self.outlets, self.common = spark, path, outlets, common
        self.bosque, self.aceptados = SortedRuns(spark, f"{path}/bosque"), SortedRuns(spark, f"{path}/aceptados")
        self.leidos, self.guardados = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def _near(self, own: SortedRuns, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Accepted rows near the batch (``id``, ``hash_dedup``, ``forma``), and (``a`` accepted, ``b`` class of the batch) by the ranges."""
        counts = (self.leidos, self.guardados)
        found = lambda asked, rows: pd.DataFrame({"a": rows["clase"], "b": asked["clase"]}).drop_duplicates()
        near = cut(self.bosque.search(ranges_of(own.rows()), ["clase"], found, "a long, b long", counts=counts).distinct())
        hashes = ranges_of(hash_entries(new.select("hash_dedup").distinct().withColumn("id", F.lit(0).cast("long")), "id"))
        same = self.bosque.search(hashes, ["clase"], found, "a long, b long", counts=counts)
        ids = near.select(F.col("a").alias("k")).unionByName(same.select(F.col("a").alias("k"))).distinct()
        return cut(lookup(self.aceptados, ids, ["hash_dedup", "forma"], "hash_dedup string, forma string", counts).withColumnRenamed("k", "id")), near

    def add_batch(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Accept what is new in ``batch`` and return (``id_a``, ``id_b``) of what repeats accepted rows or the batch itself.

        After the ``last`` batch nothing is kept.
        """
        new = cut(forms(batch, self.outlets))
        named, fresh = classes_of(new)
        named, fresh = cut(named), cut(fresh)
        own = SortedRuns(self.spark, f"{self.path}/lote-{self.bosque.runs}")
        write_forest(own, fresh, self.common)
        links, large, tested = near_classes(fresh, self.common, own)
        rows = named_rows(new, named)
        if self.bosque.runs:
            old, near = self._near(own, new)
            pool = fresh.unionByName(old.where("forma <> ''").select(F.col("id").alias("clase"), "forma"))
            links = links.unionByName(_verified(near, pool, self.common)).distinct()
            rows = rows.unionByName(old.select("id", "hash_dedup", F.col("id").alias("clase")))
        own.drop()  # what was found in it is materialised
        found = settled(rows, fresh, self.common, cut(links), large, tested)
        if last:
            return found
        found = cut(found.join(new.select(F.col("id").alias("id_b")), "id_b", "left_semi").select("id_a", "id_b"))
        keep = cut(new.join(found.select(F.col("id_b").alias("id")).distinct(), "id", "left_anti"))
        self.aceptados.add(keep.select(F.col("id").alias("k"), "hash_dedup", "forma"), "hash_dedup")
        self.bosque.add(forest(keep.where("forma <> ''").select(F.col("id").alias("clase"), "forma"), self.common).unionByName(hash_entries(keep, "id")), "clase")
        return found

    def merge_runs(self, path: str) -> AcceptedIndex:
        """One sorted run in a new folder, equal to all runs so far."""
        out = AcceptedIndex(self.spark, path, self.outlets, self.common)
        out.bosque, out.aceptados = self.bosque.merge(f"{path}/bosque", "clase"), self.aceptados.merge(f"{path}/aceptados", "hash_dedup")
        return out


def p5_found(evidencias: DataFrame, medios: DataFrame) -> DataFrame:
    """(``id_a``, ``id_b``): ``id_b`` repeats the accepted row ``id_a``; residue rows are left out."""
    return find_repeats(evidencias.select("id", "hash_dedup", "cita_textual"), outlets_of(medios))
