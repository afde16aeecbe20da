"""N-gram Jaccard join over parity sketches.

A set of shingles is written as a bit sketch: every shingle flips one bit, so a bit holds the parity of the shingles that
fall on it. Two sketches differ in at most as many bits as their sets differ in elements (the symmetric difference), and
a Jaccard similarity of ``percent`` bounds that difference by D = (a + b) (100 - percent) / (100 + percent).

1. Sizes are cut into bands. The sketch of a band has more segments than any link whose larger set lies in the band has
   differences, so at least one segment is equal in both (pigeonhole). A set posts its segments in its own band, and in the
   band above where a partner there can be similar enough.
2. A band has ``slack`` segments more than needed, so more than ``slack`` segments of a link are equal. A set with at most
   ``slack`` empty segments leaves these out: a link then still shares another one, and empty segments, the only
   ones that unrelated sets have in common, make no long posting lists.
3. Sets with equal segments are candidates. Folded sketches of few words are compared next: more differing bits than D
   rule a pair out. What is left is confirmed on the full sets.
4. Equal sets form a class and post once. In a long posting list only the member with the most company (the leader) is
   compared with all others. Lists whose members are in one component then are done, for no link is missing between
   components. In the others sketches meet in blocks of bounded size: a member names the ``NEAREST`` members of other
   components that its sketch allows; these are confirmed, components grow, and the next round names others, until no member
   has anyone left to name. After ``ROUNDS`` rounds all that are left are named at once.

Sets are read again from the texts of classes that need them, found by id and digest of the text; postings and sketches are
what lists are made of. Posting lists, families and components are never gathered in one task or on the driver.

Cases: a null or empty text, or one of white space only, has no shingles and is linked with nothing; rows that repeat a
``doc_id`` are separate texts, and equal texts are linked whatever their ids; a null ``doc_id`` can be linked but is never the
smallest id while another one is there; an empty table gives no row. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.llm.common import digested, drop_stored, sieved, stored
from logtriage.llm.components import components
from logtriage.llm.near_dups import class_key
from logtriage.llm.shingles import mixed, shingles

#: Posting lists up to this length are joined into pairs; longer ones are compared with leaders.
SHORT = 12
#: Members of other components that a member of an open list names in a round, and rounds of a bounded number of names.
NEAREST = 3
ROUNDS = 8
#: Members of one block of an open list.
BLOCK_ROWS = 4096
#: Bits of the map of open classes that keeps the sketches of others from being shuffled; a fixed size.
SIEVE_BITS = 22
#: Bits of one segment of a sketch.
SEGMENT_BITS = 20


class Bands:
    """Borders of the size bands of a similarity, with the segments, slack and folded words of their sketches."""

    def __init__(self, percent: int) -> None:
        if not 50 < percent <= 100:
            raise ValueError("a similarity of more than 50 and at most 100 percent")
        self.percent = percent
        ratio = max(1.5, 100 / percent)
        first = (100 + percent) // (2 * (100 - percent)) + 1 if percent < 100 else 1 << 62
        self.borders = [1, first]  # sets below the second border differ in nothing from what they are linked to
        while self.borders[-1] < 1 << 40:
            self.borders.append(math.ceil(self.borders[-1] * ratio) + 1)

    def differences(self, total: int) -> int:
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """Bands that a set of this size posts in: its own first; none if it is linked to equal sets only."""
        own = int(np.searchsorted(self.borders, n, side="right")) - 1
        found = [own] if own > 0 else []
        if own + 1 < len(self.borders) and n * 100 >= self.percent * self.borders[own + 1]:
            found.append(own + 1)
        return found

    def shape(self, band: int) -> tuple[int, int, int]:
        """Segments, slack, and 64-bit words of the folded sketch."""
        most = self.differences(2 * (self.borders[band + 1] - 1))
        slack = 1 + most // 16
        return most + 1 + slack, slack, 4 + most // 8


def sketch(hashes: np.ndarray, band: int, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Posting tokens of a set's segments in a band, and the folded sketch."""
    segments, slack, words = shape
    segment = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(segments)) >> np.uint64(32)
    bit = (segment << np.uint64(SEGMENT_BITS)) | (hashes >> np.uint64(64 - SEGMENT_BITS))
    flipped = mixed(bit + np.uint64(1))
    parity = np.zeros(segments, dtype=np.uint64)
    np.bitwise_xor.at(parity, segment.astype(np.int64), flipped)  # two shingles on one bit cancel
    folded = np.bincount((flipped % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    empty = parity == 0
    place = mixed(np.arange(segments, dtype=np.uint64) + np.uint64(band << 40))
    tokens = mixed(parity ^ place)
    return tokens[~empty] if empty.sum() <= slack else tokens, np.packbits(folded.astype(np.uint8)).view(np.uint64)


@functools.lru_cache(maxsize=4)
def _bands(percent: int) -> Bands:
    return Bands(percent)


def profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each row: ``doc_id``, ``digest`` of its text, ``n``, ``cls`` and ``c`` (null without shingles), sketches."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(percent)
        for batch in batches:
            found = {name: [] for name in ("n", "cls", "c", "tokens", "band", "folds")}
            for text in batch.column(2).cast(pa.binary()):
                own = shingles(text.as_py(), words)
                key = class_key(own) if len(own) else None
                posts = [(b, *sketch(own, b, bands.shape(b))) for b in bands.of(len(own))] if len(own) else []
                row = (
                    len(own),
                    key,
                    None if key is None else int.from_bytes(key[:8], "big", signed=True),
                    [t.view(np.int64) for _, t, _ in posts],
                    posts[0][0] if posts else 0,
                    [f.view(np.int64) for _, _, f in posts],
                )
                for name, value in zip(found, row, strict=True):
                    found[name].append(value)
            longs = pa.list_(pa.int64())
            types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(longs), pa.int32(), pa.list_(longs))
            columns = [pa.array(x, t) for x, t in zip(found.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "digest", *found])

    plain = digested(docs)
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, n bigint, cls binary, c bigint, tokens array<array<bigint>>, band int, "
    return plain.mapInArrow(profile, schema + "folds array<array<bigint>>")


def class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``c``, ``cls``, ``n``, ``hashes`` of the classes in ``wanted`` (``c``, ``cls``, ``row``: id and digest of one of its rows)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column("text").cast(pa.binary())]
            n = pa.array([len(x) for x in sets], pa.int64())
            hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("cls"), n, hashes], ["c", "cls", "n", "hashes"])

    at = F.xxhash64("row.doc_id", "row.digest").alias("row_at")
    wanted = wanted.select("c", "cls", F.col("row.digest").alias("row_digest"), at)
    rows = digested(docs).select("digest", "text", F.xxhash64("doc_id", "digest").alias("at"))
    rows = sieved(rows, F.col("at"), wanted, F.col("row_at"))
    found = rows.join(wanted, (F.col("at") == F.col("row_at")) & (F.col("digest") == F.col("row_digest")))
    # Rows that repeat both id and text are the only ones that come twice; they already are together.
    found = found.dropDuplicates(["at", "digest", "cls"]).select("c", "cls", "text")
    return found.mapInArrow(read, "c bigint, cls binary, n bigint, hashes array<bigint>")


def _unlike(a: Column, b: Column) -> Column:
    """Bits in which two folded sketches differ."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sizes and folded sketches allow the similarity."""
    of = lambda side: classes.select(*(F.col(c).alias(f"{c}_{side}") for c in ("c", "n", "band", "folds")))
    met = pairs.join(of("a"), F.col("a") == F.col("c_a")).join(of("b"), F.col("b") == F.col("c_b"))
    met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    # Both have a sketch in the upper one of their bands: the first of two, or the only one.
    fold = lambda side, other: F.when(
        F.col(f"band_{side}") >= F.col(f"band_{other}"), F.col(f"folds_{side}")[0]
    ).otherwise(F.get(f"folds_{side}", F.lit(1)))
    most = F.call_function("div", (F.col("n_a") + F.col("n_b")) * (100 - percent), F.lit(100 + percent))
    return met.where(_unlike(fold("a", "b"), fold("b", "a")) <= most).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""
    of = lambda side: sets.select(*(F.col(c).alias(f"{c}_{side}") for c in ("c", "n", "hashes")))
    full = pairs.join(of("a"), F.col("a") == F.col("c_a")).join(of("b"), F.col("b") == F.col("c_b"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("bigint")
    return full.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def posting_lists(classes: DataFrame) -> DataFrame:
    """``c``, ``k``, ``token`` and ``length`` of the lists of several members; postings are shuffled once."""
    posted = classes.select("c", F.posexplode("tokens").alias("k", "own")).select("c", "k", F.explode("own").alias("token"))
    length = F.count(F.lit(1)).over(Window.partitionBy("token")).alias("length")
    return posted.select("c", "k", "token", length).where("length > 1")


def leader_pairs(long: DataFrame) -> DataFrame:
    """Pairs of the member of each list (``token``, ``c``, ``company``) that has the most company, and all others."""
    lead = long.groupBy("token").agg(F.max(F.struct("company", "c")).alias("lead"))
    met = long.join(lead.select("token", F.col("lead.c").alias("leader")), "token").where(F.col("c") != F.col("leader"))
    return met.select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b"))


def open_lists(long: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists with members of several components; every member with its component (``root``)."""
    found = long.join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).drop("node")
    spread = found.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return found.join(spread.select("token"), "token", "left_semi")


def nearest(lists: DataFrame, known: DataFrame, named: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (``a`` names ``b``) of members of one list and different components whose sketches allow a link.

    A member names at most ``most`` others in a block, the least unlike ones first, and nobody it has named before. ``known`` has the
    classes in the lists.
    """
    size = lists.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")
    before = named.groupBy("a").agg(F.collect_set("b").alias("named"))  # at most ``most`` a round and block
    about = known.join(before, F.col("c") == F.col("a"), "left").drop("a")
    rows = lists.join(size.select("token", blocks), "token").join(about, "c")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    fold = F.get("folds", F.col("k")).alias("fold")
    meets = rows.select("token", "c", "root", "n", fold, "named", "mine", every)
    meets = meets.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("mine", "other")

    def compare(_: tuple, own: pa.Table) -> pa.Table:
        a, b = _allowed(own, percent, most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meets.groupBy("token", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _allowed(own: pa.Table, percent: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    c, root, n = (own.column(x).to_numpy() for x in ("c", "root", "n"))
    folds = np.stack([np.asarray(x, dtype=np.int64) for x in own.column("fold").to_pylist()]).view(np.uint64)
    named = own.column("named").to_pylist()
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(c)):
        apart = np.bitwise_count(folds ^ folds[k]).sum(axis=1, dtype=np.int64)
        bound = (n + n[k]) * (100 - percent) // (100 + percent)
        fits = (apart <= bound) & (root != root[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent)
        if named[k]:
            fits &= ~np.isin(c, named[k])
        at = np.flatnonzero(fits)
        if most is not None and len(at) > most:
            at = at[np.argsort(apart[at] - bound[at], kind="stable")[:most]]
        found_a.append(np.full(len(at), c[k]))
        found_b.append(c[at])
    return np.concatenate(found_a), np.concatenate(found_b)


def jaccard_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id reachable over links of this similarity."""
    spark = docs.sparkSession
    profile = stored(profiles(docs, words, percent), "parity-profiles")
    some = profile.where("cls is not null")
    same = (F.first(x).alias(x) for x in ("c", "n", "band", "folds", "tokens"))  # equal in all rows of a class
    rep = [F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("row")]
    classes = stored(some.groupBy("cls").agg(*rep, *same), "parity-classes")
    lists = stored(posting_lists(classes), "parity-postings")
    short = lists.where(F.col("length") <= SHORT).select("token", "c")
    other = short.select(F.col("token").alias("same"), F.col("c").alias("b"))
    pairs = short.join(other, (F.col("token") == F.col("same")) & (F.col("c") < F.col("b")))
    pairs = pairs.select(F.col("c").alias("a"), "b")

    long = lists.where(F.col("length") > SHORT)
    company = long.groupBy("c").agg(F.sum("length").alias("company"))
    first = leader_pairs(long.join(company, "c"))
    known = classes.select("c", "n", "band", "folds")
    open_pairs = stored(candidates(pairs.unionByName(first).distinct(), known, percent), "parity-pairs")
    wanted = open_pairs.select(F.col("a").alias("c")).union(open_pairs.select("b")).union(long.select("c")).distinct()
    wanted = stored(classes.select("c", "cls", "row").join(wanted, "c", "left_semi"), "parity-wanted")
    sets = stored(class_sets(docs, wanted, words), "parity-sets")
    links = stored(confirmed(open_pairs, sets, percent), "parity-links")
    roots = components(links)
    named = spark.createDataFrame([], "a bigint, b bigint")
    still, about = long.select("token", "c", "k"), known
    for turn in range(ROUNDS + 1):
        # Components only grow: a list that is done stays done, so a round reads those that the one before found open.
        before = [] if turn == 0 else [still, about]
        still = stored(open_lists(still.select("token", "c", "k"), roots), "parity-open-lists")
        members = still.select("c").distinct()
        about = about if turn else sieved(about, F.col("c"), members, F.col("c"), SIEVE_BITS)
        about = stored(about.join(members, "c", "left_semi"), "parity-open-classes")
        drop_stored(*before)
        found = stored(nearest(still, about, named, percent, NEAREST if turn < ROUNDS else None), "parity-nearest")
        if found.isEmpty():
            break
        named = stored(named.unionByName(found), "parity-named")
        fresh = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # A round names few: the sets of others are not shuffled again.
        touched = found.select(F.col("a").alias("c")).union(found.select("b")).distinct()
        near = stored(sets.join(touched, "c", "left_semi"), "parity-near")
        more = stored(confirmed(fresh, near, percent), "parity-links")
        drop_stored(found, near)
        if not more.isEmpty():
            links = stored(links.unionByName(more), "parity-links")
            roots = components(links)
    drop_stored(lists, open_pairs, wanted, sets)

    reps = classes.select("c", "least")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = reps.join(linked, F.col("c") == F.col("node")).groupBy("root").agg(F.min("least").alias("found")).join(linked, "root")
    placed = reps.join(linked.select("node", "found", F.lit(True).alias("is_linked")), F.col("c") == F.col("node"), "left")
    component = F.when(F.col("is_linked"), F.col("found")).otherwise(F.col("least")).alias("component_id")
    placed = stored(placed.select(F.col("c").alias("of"), component), "parity-components")
    grouped = some.select("doc_id", "n", "c").join(placed, F.col("c") == F.col("of")).select("doc_id", "n", "component_id")
    alone = profile.where("cls is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
