"""Follow growing log files: a streaming source whose position is a byte in every file.

``spark.readStream.format("growing_logs").option("path", folder).load()`` gives ``file``, ``start`` (the byte a line begins
at) and ``raw_log`` for every line, each exactly once, whatever happens between two polls:

* bytes are appended: the next batch begins at the byte where the last one ended;
* the last line is half written: it is left for the poll that sees its line feed;
* a file is renamed by rotation, or copied and truncated: a file is known by its first bytes, so its position moves along
  to the new name, and what stands at the old name counts as a new file;
* the query is restarted: the position is Spark's own checkpointed offset; a batch that was planned before a rename
  is read from the new name.

Options: ``path`` (a folder, or one file, whose rotated siblings are followed too), ``pattern`` (names in the folder, ``*``),
``rotated`` (names whose files no longer grow, so a last line without line feed counts; ``*.[0-9]*``), ``startingOffsets``
(``latest``, as a monitor starts at the end of a file, or ``earliest``), ``blockBytes`` (a larger range is dealt to several tasks;
a line belongs to the block that it starts in). Paths may have any scheme that pyarrow's file systems know.

Two files are told apart by their first ``HEAD`` bytes only where one of them is renamed. A batch whose file is gone fails: lines
are never skipped silently. Lines are split at LF, CR LF and CR; invalid UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_logs"
#: Bytes at a file's beginning that tell it from others.
HEAD = 1024
#: Bytes of the beginning that are kept as they are, to compare with a file that was shorter when last seen.
SHOWN = 96
_STEP = 1 << 16
_BATCH = 1 << 22


class Range(InputPartition):
    """Lines of one file that begin in ``[start, stop)`` of a range that ends at ``end``."""

    def __init__(self, name: str, head: str, print_: str | None, first: int, start: int, stop: int, end: int) -> None:
        self.name, self.head, self.print_ = name, head, print_
        self.first, self.start, self.stop, self.end = first, start, stop, end


def same_file(old: dict, new: dict) -> bool:
    """Whether a file that is now ``new`` began as ``old``."""
    if new["byte"] < old["byte"] or not new["head"].startswith(old["head"]):
        return False
    return old["print"] is None or old["print"] == new["print"]


def ranges(start: dict, end: dict, block: int) -> list[Range]:
    """What lies between two positions; a file without earlier position begins at its first byte."""
    known = dict(start["files"])
    begins = {}
    for name, new in end["files"].items():
        if name in known and same_file(known[name], new):
            begins[name] = known.pop(name)["byte"]
    for name, new in end["files"].items():
        if name not in begins:
            # The furthest position first, should several files that are gone have had the same beginning.
            moved = [old for old in known if known[old]["head"] and same_file(known[old], new)]
            begins[name] = known.pop(max(moved, key=lambda old: known[old]["byte"]))["byte"] if moved else 0
    found = []
    for name, new in sorted(end["files"].items()):
        for at in range(begins[name], new["byte"], block):
            stop = min(at + block, new["byte"])
            found.append(Range(name, new["head"], new["print"], begins[name], at, stop, new["byte"]))
    return found


class Folder:
    """The files that are followed, on any file system."""

    def __init__(self, options: dict[str, str]) -> None:
        uri = options["path"].rstrip("/")
        self.files, self.root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        self.pattern = options.get("pattern", "*")
        if self.files.get_file_info(self.root).type == fs.FileType.File:
            self.root, name = posixpath.split(self.root)
            self.pattern = f"{name}*"
        self.rotated = options.get("rotated", "*.[0-9]*")
        self.ends: dict[str, tuple[int, int]] = {}

    def names(self) -> Iterator[tuple[str, int]]:
        if self.files.get_file_info(self.root).type != fs.FileType.Directory:
            return
        for info in self.files.get_file_info(fs.FileSelector(self.root)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                yield info.base_name, info.size

    def begin(self, name: str, size: int) -> tuple[str, str | None]:
        with self.files.open_input_file(f"{self.root}/{name}") as file:
            head = file.read(min(size, HEAD))
        told = hashlib.sha1(head).hexdigest() if len(head) == HEAD else None
        return head[:SHOWN].decode("latin-1"), told

    def complete(self, name: str, size: int) -> int:
        """The byte after the last line feed."""
        if fnmatch.fnmatch(name, self.rotated):
            return size
        if self.ends.get(name, (-1, 0))[0] != size:
            at = size
            with self.files.open_input_file(f"{self.root}/{name}") as file:
                while at:
                    step = min(at, _STEP)
                    file.seek(at - step)
                    last = file.read(step).rfind(b"\n")
                    if last >= 0:
                        at += last + 1 - step
                        break
                    at -= step
            self.ends[name] = size, at
        return self.ends[name][1]

    def position(self) -> dict:
        found = {}
        for name, size in self.names():
            try:
                head, told = self.begin(name, size)
                found[name] = {"byte": self.complete(name, size), "head": head, "print": told}
            except FileNotFoundError:  # renamed since it was listed: the next poll sees it under its new name
                continue
        return {"files": found}

    def find(self, wanted: Range) -> str:
        """The name that a planned file has now."""
        sizes = dict(self.names())
        for name in sorted(sizes, key=lambda n: n != wanted.name):
            if sizes[name] >= wanted.end:
                head, told = self.begin(name, sizes[name])
                if head.startswith(wanted.head) and wanted.print_ in (None, told):
                    return name
        raise FileNotFoundError(f"{wanted.name} is gone before bytes {wanted.start} to {wanted.end} were read")


def _lines(data: bytes) -> list[bytes]:
    return data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.block = int(options.get("blockBytes", 64 << 20))
        self.earliest = options.get("startingOffsets", "latest") == "earliest"
        self.folder: Folder | None = None

    def _folder(self) -> Folder:
        if self.folder is None:
            self.folder = Folder(self.options)
        return self.folder

    def __getstate__(self) -> dict:
        return {**self.__dict__, "folder": None}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}} if self.earliest else self._folder().position()

    def latestOffset(self) -> dict:  # noqa: N802
        return self._folder().position()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.block)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done."""

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        folder = self._folder()
        name = folder.find(partition)
        with folder.files.open_input_file(f"{folder.root}/{name}") as file:
            at = partition.start
            if at > partition.first:  # a line that begins before the block belongs to the one before
                file.seek(at - 1)
                at = self._after_line(file, at - 1, partition.end)
            while at < partition.stop:
                file.seek(at)
                data = file.read(min(_BATCH, partition.end - at))
                cut = data.rfind(b"\n", 0, partition.stop - at) + 1
                if cut == 0 or data[partition.stop - at - 1 : partition.stop - at] not in (b"\n", b""):
                    # The last line of the block, or one longer than a batch, runs on to its own end.
                    begin = cut if cut and at + len(data) >= partition.stop else 0
                    if begin or not cut:
                        end = self._after_line(file, at + begin, partition.end)
                        file.seek(at)
                        data = file.read(end - at)
                        cut = len(data)
                yield self._batch(partition.name, at, data[:cut])
                at += cut

    @staticmethod
    def _after_line(file: object, at: int, end: int) -> int:
        """The byte after the first line feed from ``at`` on."""
        file.seek(at)
        while at < end:
            data = file.read(min(_STEP, end - at))
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return end

    @staticmethod
    def _batch(name: str, at: int, data: bytes) -> pa.RecordBatch:
        body = data[:-1] if data.endswith(b"\n") else data
        starts, texts = [], []
        for line in body.split(b"\n"):
            inner = _lines(line.removesuffix(b"\r"))
            starts += [at] * len(inner)
            texts += [x.decode("utf-8", "replace") for x in inner]
            at += len(line) + 1
        columns = [pa.array([name] * len(texts), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "start", "raw_log"])


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, start bigint, raw_log string"

    def streamReader(self, schema: object) -> GrowingReader:  # noqa: N802
        return GrowingReader(self.options)


def follow_logs(spark: SparkSession, path: str, **options: object):
    """A streaming DataFrame of the lines that are added under ``path``."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format(NAME).option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
