"""Labelled CSV files that are split between tasks, with rows that do not fit set aside.

A quoted cell may hold line breaks, so a line of a file need not be a row. Whether a line begins inside quotes is told by the
number of quotes before it in the file: odd or even. Blocks of a file are read apart, each counts its quotes and the lines
that begin outside of them under either assumption, and the counts are added up along the blocks of the file. From then on
every line knows the row it belongs to. Rows inside a block are put together by the task that reads it; only the lines of rows
that run across a border are shuffled, and put together by their number.

Rows are then parsed one by one: a row with too few or too many cells, with quotes in the wrong place or with a label that is no
integer goes to a side table with its file, line, text and reason. A row of more than ``most_lines`` lines can only come
from a quote that is never closed; its lines are set aside one by one and never gathered.

A file begins with its header; headers may order the columns differently and hold more of them. A missing column raises.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtriage.schema import DATASET_COLUMNS
from logtriage.session import cut_lineage, new_folder

#: Lines that one row can have.
MOST_LINES = 10_000

#: Different headers that files may have between them; more raise.
MOST_HEADERS = 100

REASONS = ("cells", "label", "unclosed quote")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in their blocks; a carriage return at a line's end stays."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("text"),
    )


def _odd(c: Column) -> Column:
    """Whether a text holds an odd number of quotes."""
    return (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2


def _runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of the rows that follow each other with equal values."""
    n, differs = len(columns[0]), np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        differs |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(differs) + 1), n] if n else []
    return zip(at[:-1], at[1:], strict=True)


def _block_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of (``file``, ``block``, ``odd``): lines that end inside quotes, lines, and those that begin outside.

    A task reads a block in order and whole, so its lines need no shuffle.
    """
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        odd = batch.column(2).to_numpy()
        for begin, end in _runs(batch.column(0), batch.column(1)):
            sums = held.setdefault((batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()), [0, 0, 0])
            own = odd[begin:end]
            inside = (sums[0] + np.cumsum(own) - own) % 2
            sums[0], sums[1], sums[2] = sums[0] + int(own.sum()), sums[1] + len(own), sums[2] + int((1 - inside).sum())
    files, blocks = ([key[k] for key in held] for k in (0, 1))
    odd, lines, outside = ([sums[k] for sums in held.values()] for k in (0, 1, 2))
    yield pa.RecordBatch.from_arrays(
        [pa.array(files, pa.string()), *(pa.array(x, pa.int64()) for x in (blocks, odd, lines, outside))],
        ["file", "block", "odd", "lines", "outside"],
    )


def block_starts(lines: DataFrame) -> DataFrame:
    """Of each block: whether it begins inside quotes (``flip``), rows and lines before it, whether it ends outside (``closed``)."""
    sizes = lines.select("file", "block", _odd(F.col("text")).cast("bigint").alias("odd"))
    sizes = sizes.mapInArrow(_block_sizes, "file string, block bigint, odd bigint, lines bigint, outside bigint")
    # Along the blocks of a file (one small row each): parity first, then what it makes of the counts.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("flip", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    rows = F.when(F.col("flip") == 0, F.col("outside")).otherwise(F.col("lines") - F.col("outside"))
    return sizes.select(
        "file",
        "block",
        "flip",
        F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
        ((F.col("flip") + F.col("odd")) % 2 == 0).alias("closed"),
    )


def _joined(most_lines: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lie in one block put together (``whole``), and the single lines of those that do not or that are very long."""
    block, inside, record, line, closed = None, 0, 0, 0, True
    held: list[str] = []
    single = False  # the row's lines are handed on one by one
    found: tuple[list, ...] = ([], [], [], [], [])

    def put(at: int, text: str, whole: bool) -> None:
        for column, value in zip(found, (block[0], record, at, text, whole), strict=True):
            column.append(value)

    def lines_apart() -> None:
        for k, text in enumerate(held):
            put(line - len(held) + k + 1, text, False)
        held.clear()

    def row_ends(whole: bool) -> None:
        if held and whole:
            put(line - len(held) + 1, "\n".join(held), True)
            held.clear()
        lines_apart()

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        arrays = [pa.array(x, t) for x, t in zip(found, kinds, strict=True)]
        for column in found:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, ["file", "record", "line", "text", "whole"])

    for own in batches:
        names = own.schema.names
        for begin, end in _runs(own.column(0), own.column(1)):
            first = own.slice(begin, 1).to_pylist()[0]
            if block != (first["file"], first["block"]):
                if block:
                    row_ends(closed)
                block, inside = (first["file"], first["block"]), first["flip"]
                record, line, closed, single = first["rows_before"], first["lines_before"], first["closed"], inside == 1
            part = own.slice(begin, end - begin)
            odds = part.column(names.index("odd")).to_pylist()
            for text, odd in zip(part.column(names.index("text")).to_pylist(), odds, strict=True):
                if not inside:
                    row_ends(True)
                    record, single = record + 1, False
                line += 1
                held.append(text)
                if single or len(held) > most_lines:
                    lines_apart()
                    single = True
                inside ^= odd
        if found[0]:
            yield batch()
    if block:
        row_ends(closed)
        yield batch()


def _row(text: str) -> Column:
    """A row's text without the carriage return at its end."""
    return F.when(F.contains(F.right(text, F.lit(3)), F.lit("\r")), F.regexp_replace(text, "\r$", "")).otherwise(F.col(text))


def _stored(rows: DataFrame) -> DataFrame:
    path = new_folder(rows.sparkSession, "csv-rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _records(lines: DataFrame, most_lines: int) -> tuple[DataFrame, DataFrame]:
    """Rows put together, and the lines of rows that are too long for it.

    Only lines of rows that run over the border of a block, or are too long, are shuffled.
    """
    own = lines.withColumn("odd", _odd(F.col("text")))
    # A task's lines must stay in order; there is one small row for each block that Spark's own plan of the scan lists.
    own = own.join(F.broadcast(block_starts(lines)), ["file", "block"])
    kinds = "file string, record bigint, line bigint, text string, whole boolean"
    own = own.mapInArrow(functools.partial(_joined, most_lines), kinds)
    own = _stored(own.withColumn("text", F.when(F.col("whole"), _row("text")).otherwise(F.col("text"))))
    apart = own.where("not whole").drop("whole")
    sizes = apart.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n"))
    long = sizes.where(F.col("n") > most_lines).select("file", "record")
    fine = apart.join(long, ["file", "record"], "left_anti").groupBy("file", "record")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    met = _stored(fine.agg(F.min("line").alias("line"), text.alias("text")).withColumn("text", _row("text")))
    rows = own.where("whole").select("file", "record", "line", "text").unionByName(met)
    return rows, apart.join(long, ["file", "record"], "left_semi")


def _cells(text: Column, width: int) -> Column:
    """The cells of a row as ``c0``, ``c1``, ..., and ``bad`` for a row of another width."""
    schema = ", ".join(f"c{k} string" for k in range(width)) + ", bad string"
    options = {"escape": '"', "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return F.from_csv(text, F.lit(schema), options)


def read_labelled(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """Rows of labelled CSV files, and (``file``, ``line``, ``text``, ``reason``) of those that do not fit."""
    rows, long = _records(_lines(spark, path), most_lines)
    rows = rows.where(F.trim("text") != "")
    # One row for each file, so that joins with it leave the rows where they are.
    first = cut_lineage(rows.groupBy("file").agg(F.min("record").alias("first")))
    heads = rows.join(F.broadcast(first), "file").where(F.col("record") == F.col("first")).select("file", "first", "text")
    heads = cut_lineage(heads)
    told = [r.text for r in heads.select("text").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(told) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    one = spark.range(1)
    kinds = {text: one.select(F.from_csv(F.lit(text), F.lit(_wide(text)), {"escape": '"'}).alias("x")).first().x for text in told}
    heads = F.broadcast(heads.select(F.col("file").alias("f"), "first", F.col("text").alias("header")))
    body = rows.join(heads, F.col("file") == F.col("f"))
    body = body.where(F.col("record") > F.col("first"))
    good, bad = [], []
    for header, cells in kinds.items():
        names = [str(c or "").strip().lstrip("﻿") for c in cells]
        missing = [c for c in DATASET_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        own = body.where(F.col("header") == header).withColumn("cells", _cells(F.col("text"), len(names)))
        label = F.expr("try_cast(trim(cells.c%d) AS int)" % names.index("label"))
        reason = F.when(F.col("cells").isNull() | F.col("cells.bad").isNotNull(), F.lit(REASONS[0])).when(label.isNull(), F.lit(REASONS[1]))
        own = own.withColumn("reason", reason)
        bad.append(own.where(F.col("reason").isNotNull()).select("file", "line", "text", "reason"))
        columns = [label.alias("label") if c == "label" else F.col(f"cells.c{names.index(c)}").alias(c) for c in DATASET_COLUMNS]
        others = [F.col(f"cells.c{k}").alias(c) for k, c in enumerate(names) if c not in DATASET_COLUMNS and names.index(c) == k and c]
        good.append(own.where(F.col("reason").isNull()).select(*columns, *others))
    set_aside = long.select("file", "line", "text", F.lit(REASONS[2]).alias("reason"))
    if not good:
        empty = rows.where("false").select(*[F.lit(None).cast("int" if c == "label" else "string").alias(c) for c in DATASET_COLUMNS])
        return empty, set_aside
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good).na.fill("", ["raw_log", "normalized_log"])
    return found, reduce(DataFrame.unionByName, [*bad, set_aside])


def _wide(header: str) -> str:
    return ", ".join(f"c{k} string" for k in range(header.count(",") + 1))
