"""Land a table as log files that grow, for replays: every file is extended a few times, and lines are cut anywhere."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.session import new_folder

_STEP = 1 << 22


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _extend(whole: str, folder: str, ends: list[tuple[str, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the files of this task up to their ends; a file keeps what it had, so a repeated task does no harm."""
    (source, at), (files, root) = _opened(whole), _opened(folder)
    for batch in batches:
        for number in batch.column(0).to_pylist():
            name, left = ends[number]
            if left:
                files.create_dir(root, recursive=True)
                with source.open_input_stream(f"{at}/{name}") as lines, files.open_output_stream(f"{root}/part-{number:05d}.log") as out:
                    while left:
                        data = lines.read(min(left, _STEP))
                        if not data:
                            raise EOFError(f"{name} ends {left} bytes early")
                        out.write(data)
                        left -= len(data)
        yield batch


def land_growing(lines: DataFrame, keys: list[str], folder: str, appends: int) -> Iterator[int]:
    """Extend one file per partition in ``appends`` equal steps; each line is its keys and its text, blanks between.

    The lines are computed and written once, aside; a step copies bytes. The position of a step is told to the caller, who reads
    the files before the next one.
    """
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartition(n, keys[0]).sortWithinPartitions(*keys).select(F.concat_ws(" ", *keys, "raw_log").alias("row"))
    whole = new_folder(spark, "landed-lines")
    placed.write.options(compression="none", lineSep="\n").text(whole)
    files, root = _opened(whole)
    found = (x for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-"))
    sizes = sorted((x.base_name, x.size) for x in found)  # one name and number for each file
    for step in range(1, appends + 1):
        ends = [(name, size * step // appends) for name, size in sizes]
        numbers = spark.range(0, len(sizes), 1, max(1, len(sizes)))
        numbers.mapInArrow(functools.partial(_extend, whole, folder, ends), "id bigint").write.format("noop").mode("overwrite").save()
        yield step
