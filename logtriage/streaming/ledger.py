"""A sink of batches that are visible once each: a folder of rows per attempt, and a ledger that names the folders that count.

An attempt at a batch writes to a folder of its own. Then a file that names this folder is renamed into the ledger under the
batch number; renaming onto an existing name fails, so of several attempts one commits. Rows of an attempt that broke off
before are named nowhere and never read; an attempt that is repeated afterwards finds the ledger file and writes nothing.

``compact`` joins the committed batches into one folder under the same rules, so neither the ledger nor the number of folders grows
without bound; ``sweep`` removes folders that nothing names. Any file system that Spark writes to will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_JOINED = "upto-"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, fmt: str = "json") -> None:
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str) -> object:
        return self._fs.Path("/".join([self.path, *parts]))

    def _files(self) -> object:
        return self._at().getFileSystem(self._conf)

    def _has(self, *parts: str) -> bool:
        return self._files().exists(self._at(*parts))

    def _named(self) -> dict[str, str]:
        """Ledger files and the folders they name."""
        if not self._has("ledger"):
            return {}
        rows = self.spark.read.text(f"{self.path}/ledger").select(F.col("_metadata.file_name").alias("name"), "value")
        return {r.name: r.value for r in rows.collect()}

    def _committed(self) -> dict[int, tuple[str, bool]]:
        """Batch number to folder, and whether it holds all batches up to that number."""
        named = self._named()
        joined = max((int(name.removeprefix(_JOINED)) for name in named if name.startswith(_JOINED)), default=None)
        found = {int(n): (folder, False) for n, folder in named.items() if not n.startswith(_JOINED)}
        if joined is not None:
            found = {n: x for n, x in found.items() if n > joined} | {joined: (named[f"{_JOINED}{joined:019d}"], True)}
        return dict(sorted(found.items()))

    def last(self) -> int | None:
        return max(self._committed(), default=None)

    def holds(self, number: int) -> bool:
        """Whether a batch is committed, by itself or joined with others."""
        return self._has("ledger", f"{number:019d}") or any(
            joined and number <= n for n, (_, joined) in self._committed().items()
        )

    def _commit(self, name: str, folder: str) -> bool:
        made = self._at("attempts", folder)
        stream = self._files().create(made, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        self._files().mkdirs(self._at("ledger"))
        kinds = getattr(self._fs, "Options$Rename")
        strict = self.spark._sc._gateway.new_array(kinds, 1)
        strict[0] = kinds.NONE
        try:
            self._fs.FileContext.getFileContext(made.toUri(), self._conf).rename(made, self._at("ledger", name), strict)
        except Py4JJavaError as raised:
            self._files().delete(made, False)
            if "FileAlreadyExists" in str(raised.java_exception):
                return False
            raise
        return True

    def append(self, batch: DataFrame, number: int) -> bool:
        """Write and commit a batch; false if it has been committed before, by this attempt or another."""
        if self.holds(number):
            return False
        folder = f"{number:019d}-{uuid.uuid4().hex}"
        batch.write.format(self.fmt).save(f"{self.path}/rows/{folder}")
        return self._commit(f"{number:019d}", folder)

    def read(self, schema: StructType | str, only: int | None = None) -> DataFrame:
        """Rows of all committed batches, or of one."""
        found = self._committed()
        folders = [folder for n, (folder, _) in found.items() if only in (None, n)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.fmt).load([f"{self.path}/rows/{f}" for f in folders])

    def compact(self, schema: StructType | str) -> bool:
        """Join all committed batches; readers see the same rows before, meanwhile and after."""
        found = self._committed()
        if len(found) < 2:
            return False
        last = max(found)
        folder = f"{_JOINED}{last:019d}-{uuid.uuid4().hex}"
        self.read(schema).write.format(self.fmt).save(f"{self.path}/rows/{folder}")
        if not self._commit(f"{_JOINED}{last:019d}", folder):
            return False
        for n, (_, joined) in found.items():
            if not (joined and n == last):
                self._files().delete(self._at("ledger", f"{_JOINED if joined else ''}{n:019d}"), False)
        return True

    def sweep(self) -> int:
        """Remove row folders that nothing names: attempts that broke off, and batches that were joined.

        Call it while no batch is being written and no reader holds an older view.
        """
        kept = {folder for folder, _ in self._committed().values()}
        gone = 0
        if self._has("rows"):
            for status in self._files().listStatus(self._at("rows")):
                if status.getPath().getName() not in kept:
                    self._files().delete(status.getPath(), True)
                    gone += 1
        return gone


def _started(writer: object, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


def write_once(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = False, fmt: str = "json"
) -> StreamingQuery:
    """Append the rows of a stream to a ledger: each batch once, repeated or broken off as it may be."""

    def batch(found: DataFrame, number: int) -> None:
        Ledger(found.sparkSession, path, fmt).append(found, number)

    return _started(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch), available_now)


def write_totals(
    rows: DataFrame, keys: list[str], path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Running totals by ``keys``: the counts are the query's state; every batch commits all of them, the last one counts."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))

    def batch(found: DataFrame, number: int) -> None:
        Ledger(found.sparkSession, path, "parquet").append(found, number)

    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return _started(writer, available_now)


def read_totals(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    ledger = Ledger(spark, path, "parquet")
    return ledger.read(schema, only=ledger.last())


def write_windows(
    rows: DataFrame,
    time: str,
    width: str,
    late: str,
    keys: list[str],
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Counts by time window and ``keys``; rows later than ``late`` behind the newest are left out, and state is dropped then.

    Every batch commits the windows it changed, with its number, so a reader takes the last count of each window.
    """
    window = F.window(time, width)
    counts = rows.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows")

    def batch(found: DataFrame, number: int) -> None:
        Ledger(found.sparkSession, path, "parquet").append(found.withColumn("batch", F.lit(number).cast("bigint")), number)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return _started(writer, available_now)


def read_windows(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """``start``, ``end``, ``keys``, ``rows``: the last count of each window. ``schema`` is that of the keys."""
    whole = f"start timestamp, end timestamp, {schema}, rows bigint, batch bigint"
    found = Ledger(spark, path, "parquet").read(whole).groupBy("start", "end", *keys)
    return found.agg(F.max_by("rows", "batch").alias("rows"))


def write_last(
    rows: DataFrame,
    order: Callable[[], list[Column]],
    n: int,
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """The first ``n`` rows in ``order`` (descending time: the last ``n``) of all batches so far.

    A batch commits the best of its own rows and those of the batch before; a repeated batch starts from the same ones.
    """

    def batch(found: DataFrame, number: int) -> None:
        ledger = Ledger(found.sparkSession, path, "parquet")
        if ledger.holds(number):
            return
        earlier = ledger.last()
        held = found if earlier is None else found.unionByName(ledger.read(found.schema, only=earlier))
        ledger.append(held.orderBy(*order()).limit(n), number)

    return _started(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch), available_now)
