"""Follow log files, classify each line, append alerts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtriage.functions.signature import status_tag
from logtriage.functions.text import strip
from logtriage.operators.detect import alerts, detect
from logtriage.sources.alerts import alert_rows


def read_log_stream(
    spark: SparkSession, folder: str, since: datetime | None = None, max_files: int | None = None
) -> DataFrame:
    """Lines of files that appear in ``folder``.

    The file source sees new files, not bytes added to a known file: point it at rotated segments. With ``since``, only
    files that were modified then or later count: a monitor that passes its own start scores no backlog.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder)
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return lines.select(strip(F.make_valid_utf8("value")).alias("raw_log"))


def read_topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """New messages of a topic, from now on: the equivalent of starting at the end of a file."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
    )
    return stream.select(strip(F.make_valid_utf8(F.col("value").cast("string"))).alias("raw_log"))


def monitored(stream: DataFrame, model: str = "signature", learned: dict[str, str] | None = None) -> DataFrame:
    """Stateless classification with a status tag per line."""
    return detect(stream, "raw_log", model, learned).withColumn("status", status_tag(F.col("risk_level")))


def write_alerts(
    detected: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    shape: Callable[[DataFrame], DataFrame] = alert_rows,
) -> StreamingQuery:
    """Append suspicious and critical rows as JSON lines; the checkpoint makes restarts exact."""
    writer = (
        shape(alerts(detected))
        .writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")
    return writer.start()


def replay(lines: DataFrame, folder: str, alerts_path: str, checkpoint: str) -> StreamingQuery:
    """Land a fixed set of lines as files, line breaks inside them included, and run them through the monitor once."""
    landed = lines.select("raw_log")
    landed.write.mode("overwrite").parquet(folder)
    stream = lines.sparkSession.readStream.schema(landed.schema).parquet(folder)
    return write_alerts(monitored(stream), alerts_path, checkpoint, available_now=True)
