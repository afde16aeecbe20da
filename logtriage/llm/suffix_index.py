"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds every repeated string of ``length`` bytes.

**Sparse suffixes.** Of the ``length - seed + 1`` seeds (``seed`` bytes) in a string of ``length`` bytes, the one whose
scrambled hash is least is its anchor. Equal strings have equal anchors, so only suffixes that start at anchors are kept:
about one in ``(length - seed) / 2`` positions. Strings with the same anchor are neighbours and form a *run*; a suffix
row holds the fingerprint of its seed (the sort key: the order only has to bring equal seeds together), the fingerprint
of its whole run, and where the run starts.

**Index family.** A new batch gets its sorted suffix rows. They are merge-scanned by key against all levels of the index:
keys that the batch shares with a level, or that it holds twice, are reported. Then the batch becomes a level, and two
levels of equal rank merge into one of the next, so a row is rewritten a logarithmic number of times.

**Exact spans.** Rows with a reported key are looked at closely: a run that occurs twice as a whole is repeated as a
whole. What is left under the same keys is compared string by string (64-bit fingerprints): the texts of a key's runs meet
in one task if they are few, else all their strings are counted with map-side combining, so no key gathers in one task.
Rows meet what is told of their key in as many tasks as their number asks for, and levels are cut by key and place, so
the rows of one very frequent string are shared out too.

Cases: a null text is an empty one; texts shorter than ``length`` have no suffix rows; a long text is scanned in blocks;
rows that repeat (``doc_id``, text) are separate documents and therefore repeat each other; a null ``doc_id`` is carried
along; an empty table gives no row. Only the two named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm.common import forget, partitions, stored, texts
from logtriage.llm.shingles import mixed
from logtriage.session import new_folder

#: Strings whose anchors are found at a time; bounds memory for long texts.
BLOCK = 1 << 18
#: Runs under one key, at about ``1.3 * length`` bytes each, that are compared in one task.
FEW_RUNS = 4096
#: Rows of one key that are joined in one task; more are dealt to several.
MANY_ROWS = 1 << 14
_PLACE = np.uint64((1 << 19) - 1)
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)

SUFFIXES = "key bigint, run bigint, row bigint, first int, strings int"


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    one = np.ones(1, dtype=np.uint64)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    return tuple(np.concatenate([one, np.multiply.accumulate(x)]) for x in (up, down))


class Fingerprints:
    """Fingerprints of all substrings of one block."""

    def __init__(self, data: np.ndarray, room: int) -> None:
        up, self.down = _powers(room)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        yield at, data[at : at + BLOCK + length - 1]


def suffix_rows(text: bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """``key``, ``run``, ``first``, ``strings`` of every run of one text."""
    found = []
    for at, data in blocks(np.frombuffer(text, dtype=np.uint8), length):
        prints = Fingerprints(data, BLOCK + length)
        place = np.arange(len(data) - seed + 1)
        keys = prints.of(place, place + seed)
        ordered = (mixed(keys) & ~_PLACE) | place.astype(np.uint64)
        anchor = (least_in_windows(ordered, length - seed + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        strings = np.diff(np.append(first, len(anchor)))
        run = prints.of(first, first + strings - 1 + length) + mixed(strings.astype(np.uint64))
        found.append((keys[anchor[first]].astype(np.int64), run.astype(np.int64), first + at, strings))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def addressed(docs: DataFrame) -> DataFrame:
    """``row`` (64 bits that stand for (``doc_id``, text)), ``doc_id``, ``text``."""
    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def joined(rows: DataFrame, told: DataFrame, keys: list[str], times: str, many: int | None = None) -> DataFrame:
    """Inner join of ``rows`` (with ``row``, ``first``) with ``told``, a stored table of one row for each of ``keys`` and about
    how many rows it has (``times``). Keys with over ``many`` rows are named to all tasks, one in ``many`` rows at most."""
    parts = F.ceil(F.col(times) / F.lit(many or MANY_ROWS)).cast("int")
    frequent = told.select(*keys, parts.alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("row", "first"), F.col("parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(frequent), keys, "left").withColumn("part", part).drop("parts")
    copies = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "part"]).drop("part")


class SuffixIndex:
    """Levels of sorted suffix rows under the shared folder; level ranks are distinct after every batch."""

    def __init__(self, spark: SparkSession, length: int, seed: int) -> None:
        self.spark, self.length, self.seed = spark, length, seed
        self.levels: list[tuple[int, str]] = []

    def suffixes(self, docs: DataFrame) -> DataFrame:
        """Suffix rows of a batch."""
        length, seed = self.length, self.seed

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    key, run, first, strings = suffix_rows(text.as_py(), length, seed)
                    if len(key):
                        columns = [key, run, np.full(len(key), row), first.astype(np.int32), strings.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], ["key", "run", "row", "first", "strings"]
                        )

        return addressed(docs).select("row", "text").mapInArrow(scan, SUFFIXES)

    def level(self, path: str) -> DataFrame:
        return self.spark.read.schema(SUFFIXES).parquet(path)

    def write(self, rows: DataFrame) -> str:
        path = new_folder(self.spark, "suffixes")
        rows.sortWithinPartitions("key").write.parquet(path)
        return path

    def rows(self) -> DataFrame:
        found = self.spark.createDataFrame([], SUFFIXES)
        for _, path in self.levels:
            found = found.unionByName(self.level(path))
        return found

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; return the keys that it holds twice or shares with an earlier level, and its rows (``key``, ``own``)."""
        path = self.write(self.suffixes(docs))
        new = self.level(path).groupBy("key").agg(F.count(F.lit(1)).alias("own"))
        old = self.rows().select("key").withColumn("own", F.lit(0)).distinct()
        scan = new.unionByName(old.select("key", F.col("own").cast("bigint"))).groupBy("key")
        scan = scan.agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("places"))
        matches = stored(scan.where("own > 1 or own = 1 and places > 1").select("key", "own"), "matches")
        self.levels.append((0, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = self.level(a).unionByName(self.level(b))
            both = both.repartitionByRange(partitions(self.spark), "key", "row", "first")
            self.levels.append((rank + 1, self.write(both)))
            forget(self.spark, a)
            forget(self.spark, b)
        return matches


def covered(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered stretches of ``found`` (start, end)."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def _run_texts(addressed_docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """``key``, ``row``, ``first``, ``data`` (bytes) of the runs in ``asked`` (``row``, ``key``, ``first``, ``strings``)."""
    runs = asked.groupBy("row").agg(F.collect_list(F.struct("key", "first", "strings")).alias("runs"))  # of one text

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts_, runs_ = batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()
            for row, text, own in zip(batch.column(0).to_pylist(), texts_, runs_, strict=True):
                text = text.as_py()
                data = [text[r["first"] : r["first"] + r["strings"] - 1 + length] for r in own]
                keys, firsts = ([r[c] for r in own] for c in ("key", "first"))
                columns = [pa.array(keys, pa.int64()), pa.array([row] * len(own), pa.int64())]
                columns += [pa.array(firsts, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "first", "data"])

    met = addressed_docs.join(runs, "row").select("row", "doc_id", "text", "runs")
    return met.mapInArrow(read, "key bigint, row bigint, first int, data binary")


def _prints(data: bytes, length: int) -> np.ndarray:
    """Fingerprints of all strings of a run."""
    start = np.arange(len(data) - length + 1)
    return Fingerprints(np.frombuffer(data, dtype=np.uint8), BLOCK + length).of(start, start + length)


def _spans_by_key(run_texts: DataFrame, length: int) -> DataFrame:
    """``row``, ``start``, ``end`` of the strings that runs of one key share; a key's runs are few."""

    def share(own: pa.Table) -> pa.Table:
        rows, firsts, data = (own.column(c).to_pylist() for c in ("row", "first", "data"))
        prints = [_prints(x, length) for x in data]
        _, place, times = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        twice, at, found = times[place] > 1, 0, []
        for row, first, own_prints in zip(rows, firsts, prints, strict=True):
            starts = np.flatnonzero(twice[at : at + len(own_prints)])
            at += len(own_prints)
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > length) + 1
                for part in np.split(starts, breaks):
                    found.append((row, first + int(part[0]), first + int(part[-1]) + length))
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["row", "start", "end"])

    return run_texts.groupBy("key").applyInArrow(share, "row bigint, start int, end int")


def _spans_by_string(run_texts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many runs: every string is counted, so no key gathers in one task."""

    def fingerprint(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints = [_prints(x.as_py(), length).astype(np.int64) for x in batch.column(3)]
            columns = [batch.column(1), batch.column(2), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "first", "prints"])

    strings = run_texts.mapInArrow(fingerprint, "row bigint, first int, prints array<bigint>")
    each = stored(strings, "strings").select("row", "first", F.posexplode("prints").alias("k", "print"))
    twice = stored(each.groupBy("print").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "prints")
    start = (F.col("first") + F.col("k")).alias("start")
    met = joined(each, twice, ["print"], "times")
    return met.select("row", start, (F.col("first") + F.col("k") + length).alias("end"))


def repeated_spans(
    docs: DataFrame, length: int = 400, seed: int = 96, batches: int = 4, few: int = FEW_RUNS
) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (maximal stretches of bytes covered by repeated strings, as [start, end] pairs;
    null for none) of all documents; the documents arrive in ``batches``, dealt by their ids."""
    spark = docs.sparkSession
    index = SuffixIndex(spark, length, seed)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    plain = texts(docs)
    matched = [index.add(plain.where(turn == k)) for k in range(batches)]
    keys = functools.reduce(DataFrame.unionByName, matched).groupBy("key").agg(F.sum("own").alias("own"))
    live = stored(joined(index.rows(), stored(keys, "keys"), ["key"], "own").drop("own"), "live")
    for _, path in index.levels:
        forget(spark, path)
    whole = live.groupBy("key", "run").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first")).alias("one"))
    whole = stored(whole, "runs")
    kinds = whole.groupBy("key").agg(F.min("times").alias("least"), F.count(F.lit(1)).alias("runs"))
    kinds = stored(kinds.where("least = 1 and runs > 1").select("key", "runs"), "kinds")  # else no string is left to compare
    own = [F.col(c) for c in ("row", "key", "first", "strings")]
    judged = joined(live, whole, ["key", "run"], "times")
    told = judged.where("times > 1").select("row", F.col("first").alias("start"), (own[2] + own[3] - 1 + length).alias("end"))
    shown = judged.where((F.col("times") == 1) | (F.struct("row", "first") == F.col("one")))  # one of each run
    shown = stored(joined(shown.select(*own), kinds, ["key"], "runs"), "shown")
    placed = addressed(docs)
    by_key = _spans_by_key(_run_texts(placed, shown.where(F.col("runs") <= few), length), length)
    by_string = _spans_by_string(_run_texts(placed, shown.where(F.col("runs") > few), length), length)
    marks = told.unionByName(by_key).unionByName(by_string)
    marks = marks.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("marks"))  # of one text

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            spans = [covered([(m["start"], m["end"]) for m in own]) for own in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "spans"])

    spans = marks.mapInArrow(merge, "row bigint, spans array<array<int>>")
    # The same exchange of the texts serves this join and the ones that read runs.
    return placed.join(spans, "row", "left").select("doc_id", "text", "spans")


def without_repeats(docs: DataFrame, length: int = 400, **options: int) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans``, ``kept`` (the remaining bytes) of all documents."""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            size, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                text, at, rest = text.as_py(), 0, []
                for start, end in spans or []:
                    rest.append(text[at:start])
                    at = end
                rest.append(text[at:])
                kept.append(b"".join(rest))
                size.append(len(text))
                removed.append(len(text) - len(kept[-1]))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
            )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<int>>, kept binary"
    return repeated_spans(docs, length, **options).mapInArrow(cut, schema)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns: the remaining bytes as their SHA-256."""
    spans = F.coalesce(F.size("spans"), F.lit(0)).cast("bigint")
    n_spans = F.greatest(spans, F.lit(0)).alias("n_spans")
    return result.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))
