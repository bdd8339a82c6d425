"""Filling containers of fixed capacity with items of varying length (problem 9).

Items of equal length are interchangeable, so the plan is made on the histogram of lengths, which is bounded by the
capacity: patterns of few documents that fill a container almost exactly are enumerated, how often each is used is
fitted to the histogram by non-negative least squares, the fit is rounded down, and what remains is packed by
best-fitting runs. The plan is then applied to the items in parallel: the k-th item of a length has its container by
arithmetic, so no group of equal lengths is ever gathered.

A text longer than the capacity is cut into parts of exactly the capacity and a remainder; no other text is cut. Texts
of zero tokens (empty and null ones) take no room and have no container. Repeated documents are separate items.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.tokenizer import token_counts
from tamiz.session import cut

#: Waste that a pattern may leave, as a share of the capacity; partners tried for each length; patterns kept for each leading length, those that waste least; sweeps of the fit.
WASTE, PARTNERS, KEPT, SWEEPS = 0.004, 4, 128, 25

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


@dataclass
class Plan:
    """``runs``: patterns with the number of containers filled so, in order of the container numbers."""

    capacity: int
    runs: list[tuple[Pattern, int]]

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.runs)

    def ranges(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: where each run's slots begin, the run's first container, and slots per container."""
        raw: dict[int, tuple[list[int], list[int], list[int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for pattern, n in self.runs:
            for length, k in pattern:
                begin, base, per = raw.setdefault(length, ([], [], []))
                begin.append(taken.get(length, 0))
                base.append(first)
                per.append(k)
                taken[length] = taken.get(length, 0) + k * n
            first += n
        return {length: tuple(np.array(x, dtype=np.int64) for x in v) for length, v in raw.items()}  # type: ignore[misc]


def enumerate_patterns(lengths: list[int], capacity: int) -> list[Pattern]:
    """Patterns of two to four documents, led by each long length, that waste almost nothing: the ``KEPT`` best of each.

    The patterns of one leading length are worked out together, level by level: a row is a pattern, its documents in
    falling order; each is extended by the longest lengths that still fit and by the longest below two thirds of the room.
    """
    known = np.array(sorted(lengths), dtype=np.int64)
    slack = max(0, int(capacity * WASTE))
    out: list[Pattern] = []

    def extend(parts: np.ndarray, room: np.ndarray, most: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray]:
        """All patterns of ``parts`` with one more document, of the ``tries`` longest lengths up to ``most``."""
        at = np.searchsorted(known, most, side="right")[:, None] - 1 - np.arange(tries)[None, :]
        row, col = np.nonzero(at >= 0)
        one = known[at[row, col]]
        return np.column_stack([parts[row], one]), room[row] - one

    for x in known[4 * known >= capacity].tolist():
        parts, room = np.array([[x]]), np.array([capacity - x])
        done: list[tuple[int, tuple[int, ...]]] = [(capacity - x, (x,))] if capacity - x <= slack else []
        for more in (3, 2, 1):
            top = np.minimum(room, parts[:, -1])
            grown = [extend(parts, room, top, PARTNERS if more > 1 else 2)]
            if more > 1:
                grown.append(extend(parts, room, np.minimum(parts[:, -1], room * 2 // 3), PARTNERS))
            parts, room = np.concatenate([g[0] for g in grown]), np.concatenate([g[1] for g in grown])
            full = np.flatnonzero(room <= slack)
            best = full[np.argsort(room[full], kind="stable")[: 4 * KEPT]]
            done += [(int(room[k]), tuple(parts[k].tolist())) for k in best]
            if not len(parts):
                break
        for _, p in sorted(set(done))[:KEPT]:
            out.append(tuple((n, p.count(n)) for n in sorted(set(p), reverse=True)))
    return sorted(set(out), reverse=True)


def fit_counts(patterns: list[Pattern], counts: dict[int, int]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to use each pattern so that the lengths come out.

    A pattern has four lengths at most, so a step touches four numbers.
    """
    index = {length: k for k, length in enumerate(sorted(counts))}
    rest = [float(counts[length]) for length in sorted(counts)]
    cols = [[(index[length], float(k)) for length, k in p] for p in patterns]
    norms = [sum(k * k for _, k in c) for c in cols]
    x = [0.0] * len(patterns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(cols):
            step = sum(k * rest[i] for i, k in c) / norms[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for i, k in c:
                    rest[i] -= step * k
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for a histogram of lengths (all between 1 and ``capacity``)."""
    left = {length: n for length, n in counts.items() if n > 0}
    runs: list[tuple[Pattern, int]] = []
    if left.get(capacity):
        runs.append((((capacity, 1),), left.pop(capacity)))
    if left:
        patterns = enumerate_patterns(list(left), capacity)
        x = fit_counts(patterns, left) if patterns else np.zeros(0)
        waste = [capacity - sum(a * k for a, k in p) for p in patterns]
        for j in sorted(range(len(patterns)), key=lambda j: (waste[j], -patterns[j][0][0])):
            n = min([int(x[j]), *(left[length] // k for length, k in patterns[j])])
            if n > 0:
                runs.append((patterns[j], n))
                for length, k in patterns[j]:
                    left[length] -= k * n
    runs += _residuals({k: v for k, v in left.items() if v}, capacity)
    return Plan(capacity, runs)


def _residuals(left: dict[int, int], capacity: int) -> Iterator[tuple[Pattern, int]]:
    """Best-fitting runs: the longest that remain, filled up with the longest that fit, as often as the counts allow."""
    lengths = sorted(left)
    while lengths:
        pattern: dict[int, int] = {}
        room = capacity
        while room >= lengths[0]:
            k = bisect_right(lengths, room) - 1
            while k >= 0 and left[lengths[k]] <= pattern.get(lengths[k], 0):
                k -= 1
            if k < 0:
                break
            exact = _exact_pair(lengths, left, pattern, room) if pattern else None
            if exact:
                for length in exact:
                    pattern[length] = pattern.get(length, 0) + 1
                room -= sum(exact)
                break
            length = lengths[k]
            n = min(room // length, left[length] - pattern.get(length, 0)) if 8 * length < capacity else 1
            if room - n * length > 0 and n > 1:
                n -= 1
            pattern[length] = pattern.get(length, 0) + n
            room -= n * length
        n = min(left[length] // k for length, k in pattern.items())
        yield tuple(sorted(pattern.items(), reverse=True)), n
        for length, k in pattern.items():
            left[length] -= k * n
        lengths = [x for x in lengths if left[x]]


def _exact_pair(lengths: list[int], left: dict[int, int], pattern: dict[int, int], room: int) -> list[int] | None:
    """One or two of the remaining lengths that fill the room exactly."""
    free = lambda x, need=1: left.get(x, 0) - pattern.get(x, 0) >= need
    if free(room):
        return [room]
    hi = bisect_right(lengths, room)
    if room > 2 * lengths[-1]:
        return None
    for k in range(hi - 1, -1, -1):
        x = lengths[k]
        if 2 * x < room:
            break
        if free(x) and free(room - x, 2 if 2 * x == room else 1):
            return [x, room - x]
    return None


def plans_of(histogram: DataFrame, capacities: dict[str, int]) -> dict[str, Plan]:
    """The plan of each group (``g``) from its histogram of lengths (``x``, ``n``): one task a group, whose histogram has at most as many rows as its capacity."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].iloc[0]
        plan = make_plan(dict(zip(pdf["x"].tolist(), pdf["n"].tolist(), strict=True)), capacities[g])
        rows = [(g, k, length, per, n) for k, (pattern, n) in enumerate(plan.runs) for length, per in pattern]
        return pd.DataFrame(rows, columns=["g", "k", "x", "por", "n"])

    runs: dict[str, dict[int, tuple[list[tuple[int, int]], int]]] = {g: {} for g in capacities}
    spread = histogram.repartition(8 * max(1, len(capacities)), "g")  # a fixed number of parts, so that the groups aren't put together
    for r in spread.groupBy("g").applyInPandas(one, "g string, k int, x long, por int, n long").collect():  # bounded by the sum of the capacities
        runs[r.g].setdefault(r.k, ([], r.n))[0].append((r.x, r.por))
    return {g: Plan(capacities[g], [(tuple(sorted(p, reverse=True)), n) for _, (p, n) in sorted(by.items())]) for g, by in runs.items()}


def pack(items: DataFrame, group: str, length: str, capacities: dict[str, int]) -> DataFrame:
    """``items`` with ``contenedor``, numbered from 0 within each ``group``; ``length`` lies between 1 and the capacity.

    ``capacities``: capacity of each group (a small fixed set). The items are materialised once, because their order
    within partitions numbers them.
    """
    base = cut(items.withColumn("__pid", F.spark_partition_id()))
    kinds = dict(items.dtypes)
    per = cut(base.groupBy(group, length, "__pid").agg(F.count("*").alias("__n")))
    histogram = per.groupBy(F.col(group).alias("g"), F.col(length).alias("x")).agg(F.sum("__n").alias("n"))
    plans = {g: plan.ranges() for g, plan in plans_of(histogram, capacities).items()}
    from pyspark.sql import Window as W

    before = W.partitionBy(group, length).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(group, length, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    cols = items.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}
        for pdf in batches:
            k = pdf.groupby([group, length], sort=False).cumcount().to_numpy(dtype=np.int64)
            keys = list(zip(pdf[group], pdf[length], strict=True))
            k += np.fromiter((seen.get(x, 0) for x in keys), dtype=np.int64, count=len(keys))
            for x, n in pdf.groupby([group, length], sort=False).size().items():
                seen[x] = seen.get(x, 0) + int(n)
            yield pdf.assign(__k=k)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols)
    numbered = base.mapInPandas(number, f"{schema}, __pid int, __k long").join(offsets, [group, length, "__pid"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty(len(pdf), dtype=np.int64)
            k = (pdf["__k"] + pdf["__off"]).to_numpy()
            for (g, x), at in pdf.groupby([group, length], sort=False).indices.items():
                begin, first, slots = plans[g][x]
                j = np.searchsorted(begin, k[at], side="right") - 1
                out[at] = first[j] + (k[at] - begin[j]) // slots[j]
            yield pdf[cols].assign(contenedor=out)

    return numbered.select(*cols, "__k", "__off").mapInPandas(place, f"{schema}, contenedor long")


def p9_asignacion(documents: DataFrame, capacidades: DataFrame) -> DataFrame:
    """Every part of every document with its container, for each capacity: (``perfil``, ``doc_id``, ``parte``, ``tokens``, ``contenedor``).

    ``parte`` counts from 0; documents without tokens have one row with 0 tokens and no container.
    """
    caps = {r.perfil: int(r.capacidad) for r in capacidades.select("perfil", "capacidad").collect()}  # a fixed table of three
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("perfil"), F.lit(c).cast("long").alias("cap")) for p, c in sorted(caps.items())]))
    sizes = cut(documents.select("doc_id", token_counts(F.col("text")).alias("n")))
    rows = sizes.select("doc_id", "n", each.alias("e")).select("doc_id", "n", "e.perfil", "e.cap")
    parts = rows.where("n > 0").withColumn("parte", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("cap")).cast("long"))))
    items = parts.select("perfil", "doc_id", "parte", F.least("cap", F.col("n") - F.col("parte") * F.col("cap")).alias("tokens"))
    packed = pack(items, "perfil", "tokens", caps)
    none = rows.where("n = 0").select("perfil", "doc_id", F.lit(0).cast("long").alias("parte"), F.col("n").alias("tokens"), F.lit(None).cast("long").alias("contenedor"))
    return packed.unionByName(none)


def p9_resumen(documents: DataFrame, capacidades: DataFrame) -> DataFrame:
    """For each capacity: items, tokens, containers, the least number of containers that could do, and the share filled."""
    a = p9_asignacion(documents, capacidades).where("contenedor is not null")
    s = a.groupBy("perfil").agg(F.count("*").alias("partes"), F.sum("tokens").alias("tokens"), (F.max("contenedor") + 1).alias("contenedores"))
    s = s.join(capacidades.select("perfil", F.col("capacidad").cast("long").alias("capacidad")), "perfil")
    return s.select(
        "perfil", "capacidad", "partes", "tokens", "contenedores", F.ceil(F.col("tokens") / F.col("capacidad")).alias("minimo"), F.round(F.col("tokens") / (F.col("contenedores") * F.col("capacidad")), 6).alias("uso")
    )
