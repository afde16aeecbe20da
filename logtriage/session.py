"""Session helpers: checkpoint folder and scratch tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def built_once(fn: Callable[..., T]) -> Callable[..., T]:
    """Keep the columns a function builds from names, per running application.

    A column over names is a recipe that fits any table, and building one takes thousands of calls to the JVM.
    """
    kept: dict[tuple, T] = {}

    @functools.wraps(fn)
    def build(*args: object) -> T:
        context = SparkSession.active().sparkContext
        key = (context.applicationId, id(context), args)
        if key not in kept:
            kept[key] = fn(*args)
        return kept[key]

    return build


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in for it in a local session only: on a cluster, executors do not share one.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="logtriage-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder; nothing is created yet."""
    return f"{checkpoint_root(spark).rstrip('/')}/logtriage/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
