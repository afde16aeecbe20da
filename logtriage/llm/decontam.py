"""Benchmark decontamination by greedy string tiling.

Words are runs of bytes other than ASCII white space, punctuation around them cut off, in lower case. A document and a
benchmark item are compared if they share a *seed*, a run of ``seed`` words. Greedy string tiling then repeats: among the
runs of unmarked words that both have, find the longest with running Karp-Rabin fingerprints, mark it on both sides as a
tile, until no common run of ``seed`` words is left. Tiles never overlap and may come in any order, so a passage whose
sentences were shuffled is covered as well as one copied whole. The pair is reported if tiles cover at least ``threshold``
of the item's words. An item of fewer words than ``seed`` is searched as one run.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text; documents are scanned once for each block, so the
seeds that are sent to the executors have a bound whatever the benchmark's size. Documents are never shuffled.

Cases: null or empty texts on either side match nothing; repeated rows are separate documents or items; a null id is
carried along; an empty table on either side gives no row. Only the named columns are read.
"""

from __future__ import annotations

import functools
import string
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm.common import rows_where, stored, texts
from logtriage.llm.shingles import Runs, runs

#: Bound on the benchmark text that one scan of the documents looks for.
BLOCK_BYTES = 8_000_000

_PUNCTUATION = string.punctuation.encode()


def word_list(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends; a word of punctuation only is left out."""
    return [w for w in (x.strip(_PUNCTUATION) for x in text.lower().split()) if w]


class Items:
    """Benchmark items of one block, their words numbered, their seeds indexed."""

    def __init__(self, items: list[tuple[int | None, bytes]], seed: int) -> None:
        self.seed, self.words = seed, {}
        self.rows, self.runs = [], []
        found: dict[int, set[int]] = defaultdict(set)
        self.short: set[int] = set()  # lengths of items with fewer words than a seed
        for item_id, text in items:
            own = word_list(text)
            if not own:
                continue
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in own], dtype=np.uint64)
            for h in runs(ids, seed).tolist():  # an item with fewer words is one run
                found[h].add(len(self.rows))
            if len(ids) < seed:
                self.short.add(len(ids))
            self.rows.append((item_id, ids))
            self.runs.append(runs(ids, seed))
        self.seeds = {h: tuple(sorted(x)) for h, x in found.items()}
        self.known = np.array(sorted(self.seeds), dtype=np.uint64)

    def number(self, text: bytes) -> np.ndarray:
        """Words as numbers; 0 for words that no item has."""
        own = word_list(text)
        get = self.words.get
        return np.fromiter((get(w, 0) for w in own), dtype=np.uint64, count=len(own))

    def candidates(self, ids: np.ndarray, threshold: float = 0.0) -> set[int]:
        """Items that share a seed with the document, as far as all shared seeds together cover enough of the item."""
        hit: set[int] = set()
        shared = []
        for n in {self.seed, *self.short}:
            if n > len(ids) or not len(self.known):
                continue
            hashes = runs(ids, n)
            hashes = hashes[_unbroken(ids, n)]
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            shared.append(np.unique(hashes[self.known[at] == hashes]))
            for h in shared[-1].tolist():
                hit.update(self.seeds[h])
        return {k for k in hit if self._reach(k, np.concatenate(shared)) >= threshold * len(self.rows[k][1])}

    def _reach(self, k: int, shared: np.ndarray) -> int:
        """Words of an item that lie in a seed which the document has too: tiles cannot cover more."""
        n = len(self.rows[k][1])
        starts = np.flatnonzero(np.isin(self.runs[k], shared))
        if n <= self.seed:
            return n if len(starts) else 0
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.seed, -1)
        return int((np.cumsum(edges)[:n] > 0).sum())

    def matches(self, text: bytes, threshold: float) -> Iterator[tuple[int | None, int, int, int]]:
        """Item id, words, covered words and tiles of every item that a document covers far enough."""
        ids = self.number(text)
        for k in sorted(self.candidates(ids, threshold)):
            item_id, item = self.rows[k]
            found = tiles(ids, item, self.seed)
            covered = sum(n for _, _, n in found)
            if covered >= threshold * len(item):
                yield item_id, len(item), covered, len(found)


def _unbroken(ids: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` hold no unknown word."""
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    return unknown[n:] == unknown[:-n]


def longest_common(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Start in ``a``, start in ``b`` and length of the longest common run of unmarked words, the first of equals.

    A length is possible only if all shorter ones are, so it is found by bisection over Karp-Rabin fingerprints.
    """
    runs_a, runs_b = Runs(a), Runs(b)

    def common(n: int) -> tuple[int, int] | None:
        if n > min(len(a), len(b)):
            return None
        left, right = runs_a.of(n), runs_b.of(n)
        free_a, free_b = np.flatnonzero(_unbroken(a, n)), np.flatnonzero(_unbroken(b, n))
        _, at_b, at_a = np.intersect1d(right[free_b], left[free_a], return_indices=True)
        if not len(at_b):
            return None
        k = int(free_b[at_b].argmin())
        return int(free_a[at_a][k]), int(free_b[at_b][k])

    found, low, high = common(least), least, min(len(a), len(b))
    if found is None:
        return None
    while low < high:
        middle = (low + high + 1) // 2
        if place := common(middle):
            found, low = place, middle
        else:
            high = middle - 1
    return (*found, low)


def tiles(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the document, start in the item, length), longest first. 0 marks used or unknown words."""
    a, b, found = document.copy(), item.copy(), []
    least = min(least, len(item))
    while tile := longest_common(a, b, least):
        i, j, n = tile
        a[i : i + n] = 0
        b[j : j + n] = 0
        found.append(tile)
    return found


def blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    held, size = [], 0
    for row in texts(benchmark, key, text).toLocalIterator():
        own = row.text.encode()
        if held and size + len(own) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row.doc_id, own))
        size += len(own)
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8, key: str = "item_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words`` (of the item), ``n_covered``, ``n_tiles``, ``coverage``: reported pairs."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, n_words bigint, n_covered bigint, n_tiles int, coverage double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(own: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, item_id, n, covered, many, covered / n)
                for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)
                for item_id, n, covered, many in own.matches(data.as_py(), threshold)
            ]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    found = spark.createDataFrame([], schema)
    for own, is_last in _sent(spark, blocks(benchmark, key, text), seed):
        part = texts(docs).mapInArrow(functools.partial(_scan, scan, own), schema)
        if not is_last:  # an earlier block's pairs are written, so that its seeds need not stay on the executors
            part = stored(part, "contaminated")
            own.unpersist()
        found = found.unionByName(part)
    return found


def _sent(spark: SparkSession, found: Iterator[list], seed: int) -> Iterator[tuple[Broadcast, bool]]:
    """The broadcast items of every block, and whether it is the last one."""
    block = next(found, None)
    while block is not None:
        after = next(found, None)
        yield spark.sparkContext.broadcast(Items(block, seed)), after is None
        block = after


def _scan(scan: Callable, shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return scan(shared.value, batches)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` whose id matches no item; rows with a null id stay, since an id does not tell them apart."""
    hits = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(hits, docs["doc_id"] == hits["hit"], "left_anti")


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8, key: str = "item_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text matches no item, as they are: each row is judged by itself, in one scan a block."""
    found = docs
    for own, is_last in _sent(docs.sparkSession, blocks(benchmark, key, text), seed):
        found = rows_where(found, functools.partial(_is_clean, own, threshold))
        if not is_last:
            found = stored(found, "decontaminated")
            own.unpersist()
    return found


def _is_clean(own: Broadcast, threshold: float, text: bytes) -> bool:
    return next(own.value.matches(text, threshold), None) is None
