"""Sorted runs of a table in a shared folder, searched by key ranges.

A run is a set of Parquet files, range-partitioned and sorted by a 64-bit key ``k``. Beside it stands its index: the least
and the greatest key of each file. A search looks its ranges up in the index, then in the footers of the files that
overlap one, and opens only the row groups that do; neither the rest of the run nor its other columns are read, and no run
is shuffled. Files are opened where the tasks run, through the file system that the folder's address names, so a lost
executor's task starts anew. ``merge`` makes one run of all.

Tasks get sent the index: one entry a file, of which there are as many as whoever writes a run parts it into, and at most
``MOST_FILES`` (some 100 MB); beyond that a search stops with an error, and merging runs into larger parts is the remedy.
An empty run has no row groups; an empty set of ranges finds nothing; equal keys may lie in several row groups.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of row groups in the files of a run.
GROUP_BYTES = 1 << 22
#: Most files of all runs of a search.
MOST_FILES = 1_000_000
#: Row groups and files that a task keeps open; rows that it makes at a time.
OPEN_GROUPS, CHUNK = 16, 200_000
INDEX = "archivo string, filas long, bytes long, lo long, hi long"


def _open(uri: str):
    """The Parquet file at ``uri``, a path or an address of a shared file system."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return pq.ParquetFile(unquote(at.path), memory_map=False)
    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


def _footer(file: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least key, greatest key and bytes of each row group of an open file, from its footer."""
    meta = file.metadata
    rows = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        at = next(c for c in range(group.num_columns) if group.column(c).path_in_schema == "k")
        s = group.column(at).statistics
        rows.append((s.min, s.max, group.total_byte_size))
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 3).T)  # type: ignore[return-value]


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries of files: rows, bytes and extremes of the key, from the files' footers."""
    for pdf in batches:
        rows = []
        for uri in pdf["archivo"]:
            file = _open(uri)
            least, greatest, size = _footer(file)
            if len(least):
                rows.append((uri, file.metadata.num_rows, int(size.sum()), int(least[0]), int(greatest[-1])))
        yield pd.DataFrame(rows, columns=["archivo", "filas", "bytes", "lo", "hi"])


class SortedRuns:
    """Runs ``0``, ``1`` ... of rows with a long key ``k`` in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.runs = spark, path, 0

    def add(self, rows: DataFrame, then: str, parts: int | None = None) -> None:
        """Write ``rows`` as a new run, sorted by ``k`` and ``then`` (by which a key with many rows is split, too).

        With ``parts``, the rows say themselves in ``parte`` to which of so many ranges of keys they belong, in the order of
        the keys (``placed``); otherwise ranges are found by sampling, for which the rows are worked out twice.
        """
        out = f"{self.path}/{self.runs}"
        placed = rows.repartitionByRange("k", then) if parts is None else rows.repartitionById(parts, "parte").drop("parte")
        placed.sortWithinPartitions("k", then).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{out}/filas")
        files = self.spark.read.parquet(f"{out}/filas").inputFiles()
        names = self.spark.createDataFrame([(f,) for f in files], "archivo string")
        names.repartition(max(1, min(len(files), 64))).mapInPandas(_files, INDEX).write.parquet(f"{out}/indice")
        self.runs += 1

    def drop(self) -> None:
        """Remove the folder with all runs, through the file system that its address names."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.runs = 0

    def rows(self) -> DataFrame:
        """All rows of all runs."""
        return self.spark.read.parquet(*[f"{self.path}/{r}/filas" for r in range(self.runs)])

    def index(self) -> list[list[tuple[str, int, int, int]]]:
        """(file, bytes, least key, greatest key) of the files of each run, in order."""
        out = []
        for r in range(self.runs):
            entries = self.spark.read.parquet(f"{self.path}/{r}/indice").orderBy("lo", "hi").limit(MOST_FILES + 1).collect()
            out.append([(e.archivo, e.bytes, e.lo, e.hi) for e in entries])
        if sum(map(len, out)) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files in the runs of {self.path}: merge them into larger parts")
        return out

    def search(
        self, ranges: DataFrame, columns: list[str], emit: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
        most: int | None = None, crowded: Callable[[pd.DataFrame], pd.DataFrame] | None = None, counts: tuple[Any, Any] | None = None,
    ) -> DataFrame:
        """Rows of the runs whose key lies in one of the ``ranges`` (``lo`` and ``hi``, inclusive, and more columns).

        ``emit(asked, found)`` makes output rows of ranges and rows found in them (``columns`` of the run), one by one beside each
        other, at most ``CHUNK`` at a time. Ranges with more than ``most`` rows go to ``crowded`` instead, once each.
        ``counts``: two accumulators, for the bytes of row groups opened and of all there are.
        """
        index = self.index()
        # equal keys may straddle files and row groups, so both extremes rise, but not strictly
        runs = [([e[0] for e in run], np.array([e[2] for e in run], dtype=np.int64), np.array([e[3] for e in run], dtype=np.int64)) for run in index]
        if counts is not None:
            counts[1].add(sum(e[1] for run in index for e in run))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: OrderedDict[tuple[str, int], pd.DataFrame] = OrderedDict()
            files: OrderedDict[str, tuple[Any, tuple[np.ndarray, np.ndarray, np.ndarray]]] = OrderedDict()

            def opened(uri: str) -> tuple[Any, tuple[np.ndarray, np.ndarray, np.ndarray]]:
                if uri not in files:
                    file = _open(uri)
                    files[uri] = (file, _footer(file))
                    if len(files) > OPEN_GROUPS:
                        files.popitem(last=False)
                files.move_to_end(uri)
                return files[uri]

            def load(uri: str, group: int) -> pd.DataFrame:
                if (uri, group) not in held:
                    file, footer = opened(uri)
                    held[uri, group] = file.read_row_group(group, columns=list(dict.fromkeys(["k", *columns]))).to_pandas()
                    if counts is not None:
                        counts[0].add(int(footer[2][group]))
                    if len(held) > OPEN_GROUPS:
                        held.popitem(last=False)
                held.move_to_end((uri, group))
                return held[uri, group]

            for pdf in batches:
                if not len(pdf):
                    continue
                lo, hi = pdf["lo"].to_numpy(dtype=np.int64), pdf["hi"].to_numpy(dtype=np.int64)
                sizes = np.zeros(len(pdf), dtype=np.int64)
                places = []
                for names, least, greatest in runs:
                    first, last = np.searchsorted(greatest, lo, side="left"), np.searchsorted(least, hi, side="right")
                    for f in _touched(first, last):
                        mine = np.flatnonzero((first <= f) & (last > f))
                        low, high, _ = opened(names[f])[1]
                        begin, end = np.searchsorted(high, lo[mine], side="left"), np.searchsorted(low, hi[mine], side="right")
                        for g in _touched(begin, end):
                            at = mine[(begin <= g) & (end > g)]
                            keys = load(names[f], g)["k"].to_numpy(dtype=np.int64)
                            a, b = np.searchsorted(keys, lo[at], side="left"), np.searchsorted(keys, hi[at], side="right")
                            sizes[at] += b - a
                            places.append(((names[f], g), at, a, b - a))
                wide = sizes > (most if most is not None else np.iinfo(np.int64).max)
                if crowded is not None and wide.any():
                    yield crowded(pdf[wide])
                for group, at, a, n in places:
                    n = np.where(wide[at], 0, n)
                    ends = np.cumsum(n)
                    for c in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                        flat = np.arange(c, min(c + CHUNK, int(ends[-1])))
                        which = np.searchsorted(ends, flat, side="right")
                        rows = load(*group).iloc[a[which] + flat - (ends[which] - n[which])]
                        yield emit(pdf.iloc[at[which]].reset_index(drop=True), rows.reset_index(drop=True))

        return ranges.mapInPandas(scan, schema)

    def merge(self, path: str, then: str) -> SortedRuns:
        """One run in a new folder, equal to all runs so far."""
        out = SortedRuns(self.spark, path)
        if self.runs:
            out.add(self.rows(), then)
        return out


def placed(keys: np.ndarray, salt: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each key between ascending ``bounds``; a key that several bounds equal is spread over the ranges they part, by ``salt``."""
    lo, hi = np.searchsorted(bounds, keys, side="left"), np.searchsorted(bounds, keys, side="right")
    return (lo + salt.astype(np.int64) % (hi - lo + 1)).astype(np.int32)


def _touched(first: np.ndarray, last: np.ndarray) -> list[int]:
    """Numbers from ``first`` up to, not including, ``last`` of any range, each once, in order."""
    if not len(first):
        return []
    marks = np.zeros(int(last.max(initial=0)) + 2, dtype=np.int64)
    some = last > first
    np.add.at(marks, first[some], 1)
    np.add.at(marks, last[some], -1)
    return np.flatnonzero(np.cumsum(marks) > 0).tolist()


def lookup(runs: SortedRuns, keys: DataFrame, columns: list[str], schema: str, counts: tuple[Any, Any] | None = None) -> DataFrame:
    """(``k``, ``columns``) of the rows of the runs whose key is one of ``keys`` (column ``k``)."""
    asked = keys.select(F.col("k").alias("lo"), F.col("k").alias("hi")).distinct()
    return runs.search(asked.sort("lo"), columns, lambda asked, found: found[["k", *columns]], f"k long, {schema}", counts=counts)
