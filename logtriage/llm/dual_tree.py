"""Vector code compression: product codes by Lloyd rounds over pairs of trees.

A vector is cut into equal parts; each part position has a codebook of few entries. A round assigns every part to the
nearest entry and moves each entry to the floor of the mean of its parts.

* Blocks of vectors are written down once. For every part position a block holds its parts in the order of a tree: median
  splits on the widest side, and for each node a tight box and the sum of its parts.
* A round walks this tree and a tree over the entries together, level by level. Two nodes have a least and a greatest
  distance, both exact integers. Entry nodes that lie farther than another one's greatest distance are pruned; a node of
  parts that is left with one entry is assigned whole, by its cached sum and count.
* Leaves that are still uncertain are compared with the entries they are left with, in integers; ties go to the lower index.
* Tasks return sums and counts of entries only; Spark adds them up. The driver holds the codebooks, whose size the
  parameters bound.

Everything is integer arithmetic, so the result depends neither on the blocks nor on the order of rows.

Cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped; without a usable row there is no
result row. Rows that repeat a ``vec_id`` are separate; among the first ones that seed the codebooks, ties are broken by the
vector, and a null ``vec_id`` comes last. With fewer rows than entries there are as many entries as rows. All kept
vectors must have one length, a multiple of the number of parts, and scaled components that keep squared distances within a
long (2^27 at 64 components); anything else raises ``ValueError`` in its task. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import drop_stored, stored

#: Vectors of one block, and the least number of parts in a leaf.
BLOCK_ROWS = 2048
LEAF = 16
#: Rows that the total of one label is spread over when it is joined back.
SALTS = 16


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Borders of the nodes of every level over ``n`` ordered rows: halves of halves, none of them empty."""
    found = [np.array([0, n], dtype=np.int64)]
    for _ in range(int(math.log2(n / leaf)) if n > leaf else 0):
        old = found[-1]
        cuts = np.empty(2 * len(old) - 1, dtype=np.int64)
        cuts[::2], cuts[1::2] = old, (old[:-1] + old[1:]) // 2
        found.append(cuts)
    return found


def split_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of a tree that halves every node on its widest side."""
    order = np.arange(len(points))
    for cuts, halves in zip(levels(len(points), leaf), levels(len(points), leaf)[1:], strict=False):
        for a, b, half in zip(cuts[:-1], cuts[1:], halves[1::2], strict=True):
            own = points[order[a:b]]
            side = int(np.ptp(own, axis=0).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, side], half - a)]
    return order


def node_table(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (least corner, then greatest) and sums of all nodes, the root first; ``points`` in tree order."""
    boxes, sums = [], []
    for cuts in levels(len(points), leaf):
        at = cuts[:-1]
        corners = [f.reduceat(points, at, axis=0) for f in (np.minimum, np.maximum)]
        boxes.append(np.concatenate(corners, axis=1))
        sums.append(np.add.reduceat(points, at, axis=0))
    return np.concatenate(boxes), np.concatenate(sums)


class Shelf:
    """A tree over the entries of one codebook, down to single entries; an entry that is alone stays a node."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.levels = [[np.arange(len(entries))]]
        while max(map(len, self.levels[-1])) > 1:
            below = []
            for own in self.levels[-1]:
                if len(own) > 1:
                    side = int(np.ptp(entries[own], axis=0).argmax())
                    own = own[np.argsort(entries[own, side], kind="stable")]
                    below += [own[: len(own) // 2], own[len(own) // 2 :]]
                else:
                    below.append(own)
            self.levels.append(below)
        self.low = [np.array([entries[x].min(axis=0) for x in nodes]) for nodes in self.levels]
        self.high = [np.array([entries[x].max(axis=0) for x in nodes]) for nodes in self.levels]

    def below(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every node of a level: its first child on the next one, and how many it has."""
        many = np.array([min(len(x), 2) for x in self.levels[level]])
        return np.cumsum(many) - many, many


def assign(points: np.ndarray, boxes: np.ndarray, sums: np.ndarray, shelf: Shelf, leaf: int = LEAF):
    """The nearest entry of every part (in tree order), counts and sums of the entries' parts, and parts assigned by node."""
    n, width = points.shape
    size = len(shelf.entries)
    found = np.full(n, -1, dtype=np.int64)
    count, total = np.zeros(size, dtype=np.int64), np.zeros((size, width), dtype=np.int64)
    tree, whole, base = levels(n, leaf), 0, 0
    node = other = np.zeros(1, dtype=np.int64)
    depth = 0
    for step in range(max(len(tree), len(shelf.levels))):
        level = min(step, len(tree) - 1)
        if 0 < step < len(tree):
            base += len(tree[step - 1]) - 1
            node = np.repeat(node * 2, 2) + np.tile([0, 1], len(node))
            other = np.repeat(other, 2)
        if step and depth + 1 < len(shelf.levels):
            first, many = shelf.below(depth)
            depth += 1
            node, start = np.repeat(node, many[other]), np.repeat(first[other], many[other])
            turn = np.arange(len(start)) - np.repeat(np.cumsum(many[other]) - many[other], many[other])
            other = start + turn
        own = boxes[base + node]
        low, high = own[:, :width], own[:, width:]
        gap = np.maximum(np.maximum(shelf.low[depth][other] - high, low - shelf.high[depth][other]), 0)
        reach = np.maximum(high - shelf.low[depth][other], shelf.high[depth][other] - low)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        bound = np.full(len(tree[level]) - 1, np.iinfo(np.int64).max)
        np.minimum.at(bound, node, most)
        near = least <= bound[node]
        node, other = node[near], other[near]
        alone = np.array([len(x) == 1 for x in shelf.levels[depth]])[other]
        sure = alone & (np.bincount(node, minlength=len(bound))[node] == 1)
        for k, e in zip(node[sure], other[sure], strict=True):
            a, b = tree[level][k], tree[level][k + 1]
            entry = shelf.levels[depth][e][0]
            found[a:b] = entry
            count[entry] += b - a
            total[entry] += sums[base + k]
            whole += int(b - a)
        node, other = node[~sure], other[~sure]
        if not len(node):
            return found, count, total, whole
    a, b = tree[-1][node], tree[-1][node + 1]
    row = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    entry = np.repeat(np.array([x[0] for x in shelf.levels[depth]])[other], b - a)
    apart = points[row] - shelf.entries[entry]
    far = np.full((n, size), np.iinfo(np.int64).max)
    far[row, entry] = (apart * apart).sum(axis=1)
    open_rows = found < 0
    found[open_rows] = far[open_rows].argmin(axis=1)  # the first of equal ones
    mine = (found[None, open_rows] == np.arange(size)[:, None]).astype(np.int64)
    return found, count + mine.sum(axis=1), total + mine @ points[open_rows], whole


def usable(table: DataFrame, vector: str) -> DataFrame:
    """``vec_id``, ``label``, ``x`` of the rows that take part."""
    x = table[vector].cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    rows = table.select(table["vec_id"].cast("bigint").alias("vec_id"), table["label"].alias("label"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)


def _scaled(flat: np.ndarray, scale: int, width: int) -> np.ndarray:
    found = np.floor(flat * scale)
    if len(found) and np.abs(found).max() >= math.isqrt((1 << 61) // width):
        raise ValueError("a scaled component is too large for exact distances in 64 bits")
    return found.astype(np.int64).reshape(-1, width)


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Part position, row, position within the part."""
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def blocks(rows: DataFrame, parts: int, scale: int, width: int) -> DataFrame:
    """Blocks of vectors with a tree for every part position, written down."""

    def as_list(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(at, BLOCK_ROWS)
                x = own.column("x")
                if set(x.value_lengths().to_pylist()) != {width}:
                    raise ValueError(f"vectors must have one length, here {width}")
                vectors = _scaled(x.flatten().to_numpy(zero_copy_only=False), scale, width)
                held = {"orders": [], "points": [], "boxes": [], "sums": []}
                for part in _parts(vectors, parts):
                    order = split_order(part, LEAF)
                    boxes, sums = node_table(part[order], LEAF)
                    held["orders"].append(order.astype(np.int32).tobytes())
                    held["points"].append(part[order].astype(np.int32).tobytes())
                    held["boxes"].append(boxes.astype(np.int32).tobytes())
                    held["sums"].append(sums.tobytes())
                columns = [as_list(own.column("vec_id")), as_list(own.column("label"))]
                columns += [pa.array([held[name]], pa.list_(pa.binary())) for name in held]
                yield pa.RecordBatch.from_arrays(columns, ["vec_ids", "labels", *held])

    label = rows.schema["label"].dataType.simpleString()
    trees = ", ".join(f"{name} array<binary>" for name in ("orders", "points", "boxes", "sums"))
    schema = f"vec_ids array<bigint>, labels array<{label}>, {trees}"
    return stored(rows.mapInArrow(build, schema), "vector-blocks")


def _trees(block: dict, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shapes = (("points", np.int32, width), ("boxes", np.int32, 2 * width), ("sums", np.int64, width))
    read = (np.frombuffer(block[name][part], dtype=t).reshape(-1, w).astype(np.int64) for name, t, w in shapes)
    return tuple(read)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: part position, entry, position."""
    parts, size, width = books.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves = [Shelf(book) for book in books]
        n, total = np.zeros((parts, size), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in ("points", "boxes", "sums")}
                for part in range(parts):
                    _, own, moved, _ = assign(*_trees(block, part, width), shelves[part])
                    n[part] += own
                    total[part] += moved
        place = np.arange(books.size)
        columns = [place, np.repeat(n.ravel(), width), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "n", "total"])

    sums = trees.select("points", "boxes", "sums").mapInArrow(count, "place bigint, n bigint, total bigint")
    sums = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    moved = books.copy().reshape(-1)
    for place, n, total in sums.collect():  # one row for each component of the codebooks
        moved[place] = total // n
    return moved.reshape(books.shape)


def _coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error`` of every vector."""
    parts, _, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves = [Shelf(book) for book in books]
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in ("orders", "points", "boxes", "sums")}
                ids, labels = (batch.column(name)[row].values for name in ("vec_ids", "labels"))
                codes, error = np.zeros((len(ids), parts), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for part in range(parts):
                    order = np.frombuffer(block["orders"][part], dtype=np.int32)
                    points, boxes, sums = _trees(block, part, width)
                    found = assign(points, boxes, sums, shelves[part])[0]
                    apart = points - books[part][found]
                    codes[order, part] = found
                    error[order] += (apart * apart).sum(axis=1)
                columns = [ids, labels, pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = trees.schema["labels"].dataType.elementType.simpleString()
    return trees.mapInArrow(code, f"vec_id bigint, label {label}, code string, error bigint")


def compress(
    table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding"
) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every usable row."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    rows = usable(table, vector)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        empty = "code string, error bigint, label_error bigint, codebooks_sha256 string"
        return rows.select("vec_id", "label", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in empty.split(", ")))
    width = len(first[0].x)
    if width % parts or any(len(r.x) != width for r in first):
        raise ValueError(f"vectors must have one length that {parts} divides")
    books = _parts(_scaled(np.array([r.x for r in first]).ravel(), scale, width), parts)
    trees = blocks(rows, parts, scale, width)
    for _ in range(rounds):
        moved = _round(trees, books)
        if (moved == books).all():  # a fixed point: later rounds change nothing
            break
        books = moved
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(_coded(trees, books), "vector-codes")
    drop_stored(trees)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
