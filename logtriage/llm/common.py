"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.session import checkpoint_root, new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no lineage, no second computation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that an operator itself has written under the shared folder."""
    if not path.startswith(checkpoint_root(spark).rstrip("/")):
        raise ValueError(f"not under the shared folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing that is still to be computed reads them."""
    for table in tables:
        forget(table.sparkSession, table.stored_at)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``key`` and ``text`` (as ``doc_id``, ``text``), a null text as an empty one."""
    return df.select(df[key].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))


def digested(df: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``text``: id and digest together find a row again, whatever its id."""
    return texts(df).select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(folds) == 0


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of its numbered forms that no column of ``df`` has."""
    taken, found, k = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def rows_where(docs: DataFrame, keep: Callable[[bytes], bool], text: str = "text") -> DataFrame:
    """The rows whose text (a null one is empty) is to be kept, as they are, judged in one scan.

    Only texts go to the Python workers and only flags come back; the other columns stay where they are.
    """

    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([keep(x.as_py() or b"") for x in part.cast(pa.binary())], pa.bool_())

    judged.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(judged, "boolean")(docs[text]))


def sieved(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose key (a bigint) may be among the wanted ones, before a join that settles it.

    The wanted keys leave marks in a map of ``2 ** bits`` bits, a fixed size however many there are: few of them keep most
    other rows from being shuffled, and with very many of them every row passes. No wanted row is lost.
    """
    bit = F.pmod(wanted_key, F.lit(1 << bits)).alias("bit")
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("mask")
    marks = wanted.select(bit).groupBy(F.expr("bit div 64").alias("word")).agg(mask).toArrow()  # 2 ** (bits - 6) rows at most
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[marks.column("word").to_numpy()] = marks.column("mask").to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(words)

    def marked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            at = part.to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
            found = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            yield pa.array(found.astype(bool))

    marked.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.where(F.arrow_udf(marked, "boolean")(key))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of every row, and the key's name.

    Rows of Parquet files are told by their file and place there, so nothing is written; other rows are written down first.
    """
    name = fresh_name(docs, "row_key")
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))), name
    except AnalysisException:
        return keyed(stored(docs, "keyed-rows"))
