"""Log files, feed files and packet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtriage.functions.text import WS, split_lines
from logtriage.schema import PACKET_SCHEMA

# Line boundaries the text reader leaves inside a line: VT, FF, FS, GS, RS, NEL, LS, PS.
_INNER_BREAK = r"[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def scan_lines(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Numbered lines of whole texts held in a column."""
    lines = df.select(*keys, F.posexplode(split_lines(F.make_valid_utf8(F.col(col)))).alias("_pos", "raw_log"))
    return lines.select(*keys, (F.col("_pos") + 1).alias("line"), "raw_log")


def non_blank(df: DataFrame, col: str = "raw_log") -> DataFrame:
    return df.filter(F.col(col).rlike(rf"[^{WS}]"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, raw_log)`` of text files of any size; invalid UTF-8 becomes U+FFFD.

    Large files are read in blocks. A line number is the number of lines in the file's earlier blocks plus
    the place inside the block, so no file passes through one task. The block table has one row per block.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.split(F.make_valid_utf8("value"), _INNER_BREAK, -1).alias("_pieces"),
    )
    return _numbered(text)


def _numbered(text: DataFrame) -> DataFrame:
    block = ["file", "_block"]
    sizes = text.groupBy(*block).agg(F.sum(F.size("_pieces")).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    # Rows of one block stay in reading order: the row id grows within a task.
    inside = Window.partitionBy(*block).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = text.withColumn("_before", F.coalesce(F.sum(F.size("_pieces")).over(inside), F.lit(0)))
    lines = placed.join(offsets, block).select(
        "file", F.col("_offset"), F.col("_before"), F.posexplode("_pieces").alias("_pos", "raw_log")
    )
    return lines.select("file", (F.col("_offset") + F.col("_before") + F.col("_pos") + 1).alias("line"), "raw_log")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed lines with their line number."""
    return read_log_lines(spark, path)


def request_columns(c: Column) -> Column:
    """The six packet columns of a tab-separated line; missing ones are empty, extra ones are dropped."""
    cells = F.split(c, "\t", -1)
    names = PACKET_SCHEMA.fieldNames()
    return F.struct(
        *[F.coalesce(F.try_element_at(cells, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    )


def read_request_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Packet rows with their line number."""
    lines = read_log_lines(spark, path)
    return lines.select("file", "line", request_columns(F.col("raw_log")).alias("_r")).select("file", "line", "_r.*")


def write_scan(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write scan results; CSV holds lists and maps as JSON text."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({name: F.to_json(name) for name in nested})
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
