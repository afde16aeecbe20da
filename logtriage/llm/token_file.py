"""Token-ID / binary output with Elias-Fano document boundaries.

A *segment* is one self-contained binary: a header, the boundaries of its documents as an Elias-Fano sequence, and
the ids of all its documents one after the other. Boundaries take about ``2 + log2(ids / documents)`` bits each; the
upper bits come with a sampled select structure, so that one document is found without decoding the others and
without a table of 64-bit offsets. Ids take two bytes where the vocabulary allows it, else four.

Segments are rows of Parquet files (``part``, ``seq``, ``doc_ids``, ``n_ids``, ``data``), ordered by ``part`` and
``seq``: any file system that Spark writes to can hold them, and a lost task writes its files again whole.

Cases: a null text is an empty one (its ids are the end id alone); a null ``doc_id`` sorts first; repeated ``doc_id``
rows are separate documents in the order of their texts; a document is never split, so a very long text makes one large
segment; an empty table gives no segment. Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtriage.llm.common import partitions, texts
from logtriage.llm.tokens import encode

#: Fixed values of the format: magic, version, and how many ones lie between two select samples.
MAGIC = b"EFTK"
VERSION = 1
SAMPLE = 64
HEADER = struct.Struct("<4sHHIQBxxxIII")  # magic, version, bytes an id, documents, ids, low bits, sizes of three parts

SEGMENTS = "part int, seq int, doc_ids array<bigint>, n_ids bigint, data binary"
#: A segment is closed once it holds so many ids.
SEGMENT_IDS = 1 << 19


class EliasFano:
    """A non-decreasing sequence of ``n`` integers: low bits packed, high bits in unary with sampled select."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int) -> None:
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        return cls(low_bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4"), n)

    def select(self, i: int) -> int:
        """Value ``i``: the place of the one numbered ``i``, from the sample before it, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (count := bits.bit_count()) <= left:
            left -= count
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        value = place - i << self.low_bits
        first = i * self.low_bits
        for k in range(self.low_bits):
            value |= (int(self.low[(first + k) // 8]) >> (first + k) % 8 & 1) << k
        return value

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pack_segment(documents: list[bytes], id_bytes: int) -> bytes:
    """One segment from the ids (little-endian unsigned 32-bit) of its documents."""
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in documents])])
    ids = np.frombuffer(b"".join(documents), dtype="<u4")
    if len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
        raise ValueError(f"id {int(ids.max())} does not fit {id_bytes} bytes")
    ef = EliasFano.build(bounds)
    parts = [x.tobytes() for x in (ef.low, ef.high, ef.samples)]
    head = HEADER.pack(MAGIC, VERSION, id_bytes, len(documents), len(ids), ef.low_bits, *map(len, parts))
    return b"".join([head, *parts, ids.astype(f"<u{id_bytes}").tobytes()])


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes) -> None:
        magic, version, id_bytes, self.n_docs, self.n_ids, low_bits, *sizes = HEADER.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a segment of this version")
        views, at = [], HEADER.size
        for size in sizes:
            views.append(np.frombuffer(data, dtype=np.uint8, count=size, offset=at))
            at += size
        self.bounds = EliasFano(low_bits, views[0], views[1], views[2].view("<u4"), self.n_docs + 1)
        self.ids = np.frombuffer(data, dtype=f"<u{id_bytes}", count=self.n_ids, offset=at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def token_segments(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int = 2, segment_ids: int = SEGMENT_IDS
) -> DataFrame:
    """Segments of all documents in ascending ``doc_id`` order.

    Documents are dealt by ranges of (``doc_id``, hash of the text, row), so a repeated id cannot gather in one task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, encoded, held = TaskContext.get().partitionId(), 0, [], [], 0

        def segment() -> pa.RecordBatch:
            rows = [[part], [seq], [keys], [held], [pack_segment(encoded, id_bytes)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)],
                ["part", "seq", "doc_ids", "n_ids", "data"],
            )

        for batch in batches:
            found = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = encode(tokenizer_path, text.as_py(), end_id)
                keys.append(doc_id)
                encoded.append(ids)
                held += len(ids) // 4
                if held >= segment_ids:
                    yield segment()
                    seq, keys, encoded, held = seq + 1, [], [], 0
        if keys:
            yield segment()

    order = ["doc_id", "h", "row"]
    ranged = (
        texts(docs)
        .withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return ranged.mapInArrow(write, SEGMENTS)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, **options: int) -> None:
    """Encode ``docs`` and write their segments under ``path``."""
    token_segments(docs, tokenizer_path, end_id, **options).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(``part``, ``seq``, ``base``): ids of all segments before each one; reads no ids.

    Running sums are taken inside each part; only one total for each part meets in a single task.
    """
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = sizes.withColumn("inner", inner).join(parts, "part")
    return placed.select("part", "seq", (F.col("inner") + F.col("before")).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: ``doc_id``, ``start`` (over all files), ``n_tokens``, ``ids``."""
    return _documents(spark, path, "ids array<int>", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_tokens`, with the crc32 of the ids (little-endian unsigned 32-bit) in their place."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return _documents(spark, path, "ids_crc32 bigint", pa.int64(), crc)


def _documents(spark: SparkSession, path: str, column: str, kind: pa.DataType, shown: object) -> DataFrame:
    name = column.split()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, keys, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                segment = Segment(data.as_py())
                n, bounds = segment.n_docs, segment.bounds.values().astype(np.int64)
                found = [shown(segment.ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([seq.as_py()] * n, pa.int32()),
                        pa.array(keys.as_py(), pa.int64()),
                        pa.array(bounds[:-1], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(found, kind),
                    ],
                    ["part", "seq", "doc_id", "inner", "n_tokens", name],
                )

    schema = f"part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, {column}"
    segments = read_segments(spark, path)
    rows = segments.select("part", "seq", "doc_ids", "data").mapInArrow(read, schema)
    placed = rows.join(segment_starts(segments), ["part", "seq"])
    return placed.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", name)
