"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Texts with equal shingle sets form a class; from here on a class stands for all its copies.
2. A class posts its ``COORDINATES`` MinHash values as (coordinate, value) tokens. Links of the wanted similarity agree
   in at least ``matches_needed`` of them (but for a chance of 1e-6 a link), so two such lists, each sorted rarest token
   first, already meet within the first ``COORDINATES - needed + 1`` tokens: only this prefix is joined, and the long
   posting lists of common shingles are skipped.
3. Collisions in short posting lists give pairs. Byte-wide copies of the signatures travel along and count the matching
   coordinates; pairs under the match threshold go.
4. A long posting list is a family of copies. It is not expanded into pairs: its members meet in blocks of bounded size,
   full sets at hand, and yield the links of a spanning forest only, which is all that components need.
5. Every link is confirmed on full sets. Components come from large and small stars.

In a family whose members are not linked to its centre, the comparisons inside a block pair grow with the square of
the block. A member's hashes are shuffled once for each long list and block pair it is in.

Cases: a null or empty text, or one of white space only, has no shingles and is linked with nothing; rows that repeat a
``doc_id`` are separate texts, and equal texts are linked whatever their ids; a null ``doc_id`` can be linked but is
never the smallest id while another one is there; an empty table gives no row. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import digested, drop_stored, stored
from logtriage.llm.components import components
from logtriage.llm.shingles import mixed, shingles

#: Five longs of seven bytes hold one byte of each coordinate.
COORDINATES = 35
MISSED = 1e-6
#: Posting lists up to this length are joined into pairs, longer ones are handled in blocks.
SHORT = 16
#: Bounds of one block: members, and hashes in their sets.
BLOCK_ROWS = 8192
BLOCK_HASHES = 2_000_000

_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64)
_LOW, _HIGH = 0x7F7F7F7F7F7F7F, 0x80808080808080


def matches_needed(percent: int) -> int:
    """The most matching coordinates that a link of this similarity reaches but for a chance of ``MISSED``."""
    p, tail = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        tail += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if tail > MISSED:
            return max(t, 1)
    return COORDINATES


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each coordinate's permuted hashes, to 32 bits."""
    found = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]
        np.minimum(found, (part ^ (part >> np.uint64(29))).min(axis=0), out=found)
    return found >> np.uint64(32)


def class_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    first, second = mixed(hashes).sum(dtype=np.uint64), mixed(~hashes).sum(dtype=np.uint64)
    return (int(first) << 64 | int(second)).to_bytes(16, "big")


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: ``doc_id``, ``digest`` of its text, ``n`` (set size), ``cls`` (null for an empty set), tokens and
    byte-wide signature."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        byte = np.uint64(1) << (np.arange(COORDINATES, dtype=np.uint64) % np.uint64(7) * np.uint64(8))
        for batch in batches:
            sizes, keys, tokens, narrow = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                own = shingles(text.as_py(), words)
                sizes.append(len(own))
                if len(own):
                    signed = signature(own)
                    keys.append(class_key(own))
                    tokens.append((signed | place).astype(np.int64))
                    low = (signed & np.uint64(0xFF)) * byte
                    narrow.append(low.reshape(5, 7).sum(axis=1, dtype=np.uint64).astype(np.int64))
                else:
                    keys.append(None), tokens.append(None), narrow.append(None)
            longs = pa.list_(pa.int64())
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            columns += [pa.array(tokens, longs), pa.array(narrow, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "cls", "tokens", "narrow"])

    plain = digested(docs)
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, n bigint, cls binary, tokens array<bigint>, narrow array<bigint>"
    return plain.mapInArrow(profile, schema)


def postings(classes: DataFrame, needed: int) -> DataFrame:
    """``cls``, ``n``, ``narrow``, ``token``: the tokens of each class's prefix that another class posts as well."""
    posted = classes.select("cls", F.explode("tokens").alias("token"))
    seen = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(seen, "token").groupBy("cls").agg(F.collect_list(F.struct("df", "token")).alias("own"))
    alone = F.lit(COORDINATES) - F.size("own")  # tokens of one class only come first in the order of rarity
    room = F.greatest(F.lit(COORDINATES - needed + 1) - alone, F.lit(0))
    prefix = shared.select("cls", F.explode(F.slice(F.array_sort("own"), F.lit(1), room)).alias("x"))
    return prefix.select("cls", F.col("x.token").alias("token")).join(classes.select("cls", "n", "narrow"), "cls")


def _unlike(a: Column, b: Column) -> Column:
    """Coordinates in which two byte-wide signatures differ."""
    total = F.lit(0)
    for k in range(5):
        x = a[k].bitwiseXOR(b[k])
        total += F.bit_count(((x.bitwiseAND(_LOW) + F.lit(_LOW)).bitwiseOR(x)).bitwiseAND(_HIGH))
    return total


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return common * 100 >= (a + b - common) * percent


def short_pairs(short: DataFrame, needed: int, percent: int) -> DataFrame:
    """Distinct pairs of classes that collide in a short list, agree in enough coordinates and can be so similar."""
    left = short.select("token", *(F.col(c).alias(f"{c}_a") for c in ("cls", "n", "narrow")))
    right = short.select("token", *(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "narrow")))
    met = left.join(right, (left.token == right.token) & (F.col("cls_a") < F.col("cls_b")))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    met = met.where(fits & (_unlike(F.col("narrow_a"), F.col("narrow_b")) <= COORDINATES - needed))
    return met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among ``sets`` that connect all that links connect.

    The member that shares most is compared with all; those that it is linked to need no row of their own, since the rows
    of all others hold every link that is left.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(values, return_inverse=True, return_counts=True)
    kept = df[token] > 1
    token, owner = token[kept], owner[kept]
    order = np.argsort(token, kind="stable")
    posted, ends = owner[order], np.cumsum(np.bincount(token, minlength=len(df)))
    by_owner = np.argsort(owner, kind="stable")
    own_token, own_end = token[by_owner], np.cumsum(np.bincount(owner, minlength=n))

    def linked(k: int) -> np.ndarray:
        mine = own_token[own_end[k - 1] if k else 0 : own_end[k]]
        lists = [posted[ends[t] - df[t] : ends[t]] for t in mine]
        common = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, dtype=np.int64)
        found = common * 100 >= (sizes + sizes[k] - common) * percent
        found[k] = False
        return np.flatnonzero(found)

    centre = int(np.bincount(owner, weights=df[token], minlength=n).argmax()) if len(owner) else 0
    root = np.arange(n)
    edges = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    first = linked(centre)
    for k in [centre, *np.setdiff1d(np.arange(n), [*first, centre])]:
        for other in first if k == centre else linked(int(k)):
            a, b = find(int(k)), find(int(other))
            if a != b:
                root[b] = a
                edges.append((int(k), int(other)))
    return edges


def block_links(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside long lists: every two blocks of a list meet in one task."""
    size = long.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
    placed = long.select("token", "cls").join(size.select("token", blocks.alias("blocks")), "token")
    mine = placed.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = mine.withColumn("other", F.explode(every)).select(
        "token", "cls", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )

    def compare(_: tuple, own: pa.Table) -> pa.Table:
        keys, column = own.column("cls").to_pylist(), own.column("hashes").combine_chunks()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        found = forest([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], percent)
        a, b = ([keys[e[side]] for e in found] for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    joined = meets.join(sets.select("cls", "hashes"), "cls")
    return joined.groupBy("token", "i", "j").applyInArrow(compare, "a binary, b binary")


def class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cls``, ``n``, ``hashes`` of the classes in ``wanted`` (``cls``, ``row``: id and digest of a row that has the text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py(), words) for text in batch.column(0).cast(pa.binary())]
            keys = [class_key(x) if len(x) else None for x in found]
            columns = [batch.column(1), pa.array(keys, pa.binary()), pa.array([len(x) for x in found], pa.int64())]
            columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["wanted", "cls", "n", "hashes"])

    plain = digested(docs)
    same = (plain.digest == F.col("row.digest")) & plain.doc_id.eqNullSafe(F.col("row.doc_id"))
    rows = plain.join(wanted.withColumnRenamed("cls", "wanted"), same)
    read_back = rows.select("text", "wanted").mapInArrow(read, "wanted binary, cls binary, n bigint, hashes array<bigint>")
    return read_back.where("cls = wanted").select("cls", "n", "hashes").dropDuplicates(["cls"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (is it this one).

    Two texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more.
    """
    needed = matches_needed(percent)
    profile = stored(profiles(docs, words), "profiles")
    classes = profile.where("cls is not null").groupBy("cls")
    same = (F.first(c).alias(c) for c in ("n", "tokens", "narrow"))  # equal in all rows of a class
    classes = classes.agg(F.min(F.struct("doc_id", "digest")).alias("row"), *same)
    classes = stored(classes, "classes")
    posted = stored(postings(classes, needed), "postings")
    length = posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    prefix = posted.join(length, "token")
    short, long = prefix.where(F.col("length") <= SHORT), prefix.where(F.col("length") > SHORT)
    pairs = stored(short_pairs(short, needed, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(long.select("cls")).distinct()
    sets = stored(class_sets(docs, wanted.join(classes.select("cls", "row"), "cls"), words), "sets")
    of = lambda side: sets.select(*(F.col(c).alias(f"{c}_{side}") for c in ("cls", "n", "hashes")))
    full = pairs.join(of("a"), F.col("a") == F.col("cls_a")).join(of("b"), F.col("b") == F.col("cls_b"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    links = full.where(_similar(common, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    links = links.unionByName(block_links(long, sets, percent))
    roots = components(links)
    drop_stored(classes, posted, pairs, sets)
    grouped = profile.where("cls is not null").select("doc_id", "n", "cls")
    grouped = grouped.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = grouped.join(least, "root").select("doc_id", "n", "component_id")
    alone = profile.where("cls is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)
