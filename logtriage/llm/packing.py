"""Best-fit packing of token pieces into sequences of a fixed capacity, by a configuration linear program.

1. Documents are encoded and cut only where they are longer than a sequence.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the input) goes to the driver.
3. A configuration is a multiset of lengths that fits one sequence. The linear program "fewest configurations that
   cover the histogram" is solved by multiplicative weights: every length has a price, a knapsack dynamic program finds
   for each length the dearest configuration that holds it, each of these gets a share, and lengths that have been
   covered too often become cheaper.
4. Shares of the solution are rounded down, never beyond what is left of a length, and the rest is filled in by best
   fit, longest first; the share that needs the fewest sequences is kept. All of it works on counts of lengths, so its
   cost does not depend on the number of pieces.
5. Pieces take the places of their length in turn. A piece's number within its length is its number within its task plus
   the counts of earlier tasks, so no length gathers in one task.

Cases: a null text is an empty one (one piece, the end id); repeated ``doc_id`` rows are separate documents; a null
``doc_id`` stays null; an empty table gives no row. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtriage.llm.common import stored, texts
from logtriage.llm.tokens import encode

#: Rounds of multiplicative weights and how strongly coverage lowers a price.
ROUNDS = 40
STEP = 0.5
#: Room that a configuration may leave when it is rounded down; emptier ones are left to best fit.
WASTE = 0
#: Shares of the solution that are tried in rounding.
SHARES = (1.0, 0.9, 0.7, 0.4)

Plan = list[tuple[tuple[int, ...], int]]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, the ``task`` and the piece's ``rank`` in it among
    pieces of its length; ``ids`` on request."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    if with_ids:
        schema, kinds = schema + ", ids array<int>", [*kinds, pa.list_(pa.int32())]
    names = [x.strip().split()[0] for x in schema.split(",")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            found = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = encode(tokenizer_path, text.as_py(), end_id)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    row = (doc_id, piece, at // 4, length, zlib.crc32(own), task, ranks[length])
                    rows.append((*row, np.frombuffer(own, dtype="<i4")) if with_ids else row)
                    ranks[length] += 1
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return texts(docs).mapInArrow(cut, schema)


def dearest(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for every capacity the value of the dearest filling and a length to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = prices[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(value.argmax())
        best[c], take[c] = (value[k], k + 1) if value[k] > best[c - 1] else (best[c - 1], -1)
    return best, take


def filling(take: np.ndarray, room: int) -> list[int]:
    found = []
    while room > 0 and take[room]:
        if take[room] < 0:
            room -= 1
        else:
            found.append(int(take[room]))
            room -= found[-1]
    return found


def fractional(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations and their fractional numbers; together they cover every length's count at least once."""
    lengths = np.flatnonzero(histogram)
    counts = histogram[lengths].astype(float)
    logs, cover = np.zeros(len(lengths)), np.zeros(len(lengths))
    x: dict[tuple[int, ...], float] = Counter()
    place = {int(length): k for k, length in enumerate(lengths)}
    for _ in range(rounds):
        # A unit of length is worth its size; lengths that are covered beyond the others lose value.
        prices = np.full(capacity + 1, -1.0)
        prices[lengths] = lengths * np.exp(logs - logs.max())
        _, take = dearest(prices, capacity)
        got = np.zeros(len(lengths))
        for k in np.argsort(-lengths):
            short = counts[k] - got[k]
            if short <= 0:
                continue
            config = tuple(sorted([int(lengths[k]), *filling(take, capacity - int(lengths[k]))], reverse=True))
            held = Counter(config)
            share = short / held[int(lengths[k])]
            x[config] += share / rounds
            for length, n in held.items():
                got[place[length]] += n * share
        cover += got / counts
        logs = -STEP * (cover - cover.min())
    return x


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first, by counts: sequences with the same contents are handled together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def add(contents: tuple[int, ...], n: int) -> None:
        room = capacity - sum(contents)
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, room)
        groups[room].append((contents, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n and (fits := [r for r in rooms if r >= length]):
            room = min(fits)
            contents, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.remove(room)
            used = min(n, times)
            add((*contents, length), used)
            if times > used:
                add(contents, times - used)
            n -= used
        each = capacity // length
        if n // each:
            add((length,) * each, n // each)
        if n % each:
            add((length,) * (n % each), 1)
    return [x for own in groups.values() for x in own]


def rounded(histogram: np.ndarray, capacity: int, ordered: list[tuple[tuple[int, ...], float]], share: float) -> Plan:
    """``share`` of the solution rounded down, never beyond what is left of a length; best fit for the rest."""
    left, found = histogram.astype(np.int64).copy(), []
    for config, x in ordered:
        held = Counter(config)
        n = min(int(share * x), *(int(left[length]) // k for length, k in held.items()))
        if n:
            found.append((config, n))
            for length, k in held.items():
                left[length] -= k * n
    return found + best_fit(left, capacity)


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """Contents (longest first) of the sequences and how many have each, for ``histogram[length]`` pieces.

    The solution is rounded with several shares; the one that needs the fewest sequences is kept.
    """
    if not histogram.any():
        return []
    solution = fractional(histogram, capacity).items()
    ordered = sorted((cx for cx in solution if sum(cx[0]) >= capacity - WASTE), key=lambda cx: (-cx[1], cx[0]))
    found = (rounded(histogram, capacity, ordered, share) for share in SHARES)
    return min(found, key=lambda p: sum(n for _, n in p))


def places(found: Plan) -> dict[str, np.ndarray]:
    """For every (length, contents): the first place among those of the length, and where it lies."""
    rows, first, filled = [], 0, Counter()
    for contents, times in found:
        offset = 0
        for length, each in sorted(Counter(contents).items(), reverse=True):
            rows.append((length, filled[length], first, each, offset))
            filled[length] += each * times
            offset += each * length
        first += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "place", "sequence", "each", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (stored rows of :func:`token_pieces`) with ``sequence_id`` and ``offset``."""
    held = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    held = stored(held, "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row for each length
        histogram[row.length] = row.n
    table = places(plan(histogram, capacity))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(held.withColumn("earlier", earlier).drop("n"), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).drop("task", "earlier")
    start = np.searchsorted(table["length"], np.arange(capacity + 2))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.zeros(len(length), dtype=np.int64)
            for own in np.unique(length):
                a, b = start[own], start[own + 1]
                mine = length == own
                at[mine] = a + np.searchsorted(table["place"][a:b], rank[mine], side="right") - 1
            k = rank - table["place"][at]
            each = table["each"][at]
            new = {"sequence_id": table["sequence"][at] + k // each, "offset": table["offset"][at] + k % each * length}
            kept = [c for c in batch.schema.names if c != "rank"]
            arrays = [*(batch.column(c) for c in kept), *(pa.array(v, pa.int64()) for v in new.values())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *new])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(put, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, with_ids: bool = False
) -> DataFrame:
    """Encode, cut and pack; texts are encoded once."""
    return pack(stored(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``doc_ids``, ``ids``: the packed sequences themselves, from rows that hold ``ids``."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(own.alias("own"))
        .select("sequence_id", F.col("own.doc_id").alias("doc_ids"), F.flatten("own.ids").alias("ids"))
    )
