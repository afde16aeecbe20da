"""Source divergence audit: how the words of a source differ from those of other sources and of its whole language.

Late string materialization: a term is a fixed-width digest until the end.

1. Every task digests the terms of its documents, some texts at a time, by prefix sums over their bytes. It writes one row for each
   (lang, source, digest) it holds, with occurrences and documents, and one row for each digest and text. The counting
   that follows reads no texts. Python workers outlive their tasks: what they have held is given back at the end.
2. Only digests are shuffled, by (lang, source, digest) and then, pre-aggregated, by (lang, digest). A digest whose terms are
   together in too few documents goes; two terms behind one digest can only be too many here, never too few.
3. The distinct texts behind the digests that are left are fetched: they show whether a digest stands for several terms.
   Only then documents are read again and the terms of those few digests are counted by text.
4. The sum over all terms for every two sources is taken in blocks of a language's terms, so that no language and no term
   is one group. A block holds a matrix of sources and terms and adds one row for each two sources.
5. Ranks need texts for ties only. The value at the wanted rank is found on counts of equal values; what lies below it goes,
   then texts are joined, and the rest is ranked with a limit in every task before the shuffle.

Values are exact: p = 1 + floor(10^9 (count + 1) / (N + V)) comes from decimals, f = floor((p - q)^2 / q) fits a long.

Cases: null text, lang and source count as ''. A group without terms takes part with counts of zero. Without kept terms in a
language its pairs have the value 0 and it has no ``term`` rows; a source that is alone in its language has no ``pair``
rows. Rows are counted as they are, repeated ones and null ids included; an empty table gives no row. Only the three named columns
are read. A very long text is handled whole, as one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.llm.common import stored
from logtriage.llm.suffix_index import Fingerprints

#: Documents of a language that a term must be in.
MIN_DOCS = 3
#: Entries (counts of a group's term, texts) that a task holds before it writes them; a bound on memory only.
HELD_TERMS = 2_000_000
#: Bytes of texts whose terms are digested at a time; a bound on memory only.
CHUNK = 1 << 18
#: Rows of a batch that goes back to Spark.
WRITTEN_ROWS = 100_000
#: Cells of the matrix of one block of terms, and ordered pairs of sources that one task adds up for a block.
BLOCK_CELLS = 50_000
BLOCK_PAIRS = 500_000
SCALE = 1_000_000_000

COLUMNS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)
PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

_UPPER = range(0x41, 0x5B)
_LOWER = range(0x61, 0x7B)
#: Bytes of terms stay, A-Z in lower case; every other one becomes a blank.
_TERMS = bytes(b + 0x20 if b in _UPPER else b if b in _LOWER or b >= 0x80 else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about ``CHUNK`` bytes that cut no term."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The parts of ``data`` with these starts and sizes."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _terms_of(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Of each term of a few texts: digest and the text's place in the list; and the distinct (``digest``, ``term``).

    Terms of one digest are compared with the first of them byte by byte, so a digest of several terms is never overlooked.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    letters = data != 0x20
    flips = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    start, end = flips[::2], flips[1::2]
    size = end - start
    digest = Fingerprints(data, max(2 * CHUNK, 1 << len(data).bit_length())).of(start, end)
    digest = (digest >> np.uint64(64 - bits)).view(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.cumsum(sizes + 1) - sizes), append=len(start)) if texts else 0)
    coded = pa.array(digest).dictionary_encode()
    code, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    like = first[code]
    at = np.flatnonzero(letters)
    differs = data[np.minimum(at + np.repeat(start[like] - start, size), len(data) - 1)] != data[at]
    other = size != size[like]
    if differs.any():
        other |= np.logical_or.reduceat(differs, np.cumsum(size) - size)
    shown = np.concatenate([first, np.flatnonzero(other)])
    return digest, text, pa.table({"digest": digest[shown], "term": _binary(data, start[shown], size[shown])})


def _text_counts(digest: np.ndarray, text: np.ndarray) -> pa.Table:
    """``digest``, ``text`` and ``n`` of every digest in every text."""
    coded = pa.array(digest).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    key = np.sort(text * kinds + coded.indices.to_numpy())
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key))
    return pa.table({"digest": coded.dictionary.to_numpy()[key[first] % kinds], "text": key[first] // kinds, "n": n})


def _merged(tables: list[pa.Table], keys: list[str], sums: list[str]) -> list[pa.Table]:
    """The tables as one, with one row for each key."""
    if not tables:
        return []
    found = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
    return [found.rename_columns([x.removesuffix("_sum") for x in found.column_names])]


def _summed(tables: list[pa.Table]) -> list[pa.Table]:
    """Counts as one table, with one row for each digest and group: sorted, which takes less memory than hashing."""
    if not tables:
        return []
    digest, group, *sums = (pa.concat_tables(tables).column(c).to_numpy() for c in ("digest", "group", "n", "docs"))
    order = np.lexsort((group, digest))
    digest, group = digest[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (group[1:] != group[:-1])])[: len(digest)])
    n, docs = (np.add.reduceat(x[order], first) if len(first) else x for x in sums)
    return [pa.table({"group": group[first], "digest": digest[first], "n": n, "docs": docs})]


def _counts_of(texts: list[bytes], bits: int) -> tuple[pa.Table, pa.Table]:
    """``digest``, ``text``, ``n`` of a few texts or of one of any length, and the distinct (``digest``, ``term``)."""
    counts, terms = [], []
    for part in [texts] if len(texts) > 1 else [[x] for x in _pieces(texts[0])] or [texts]:
        digest, text, shown = _terms_of(part, bits)
        counts.append(_text_counts(digest, text))
        terms.append(shown)
    if len(counts) > 1:  # pieces of one text
        return _merged(counts, ["digest", "text"], ["n"])[0], _merged(terms, ["digest", "term"], [])[0]
    return counts[0], terms[0]


def _slices(tables: list[pa.Table]) -> Iterator[pa.Table]:
    for t in tables:
        for at in range(0, t.num_rows, WRITTEN_ROWS):
            yield t.slice(at, WRITTEN_ROWS)


def _batches(*columns: object) -> Iterator[pa.RecordBatch]:
    """Rows of ``COLUMNS``; a column that is not given is null."""
    size = max(len(c) for c in columns if c is not None)
    columns = [pa.nulls(size, t) if c is None else c for c, t in zip(columns, COLUMNS.types, strict=True)]
    yield from pa.table(columns, COLUMNS.names).cast(COLUMNS).to_batches(WRITTEN_ROWS)


def _counted(bits: int):
    """Counts of a task: rows with ``n`` for (lang, source, digest), rows without for the texts of digests.

    A row without a digest names its group.
    """

    def chunks(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, str]], list[bytes]]]:
        """Groups and texts, about ``CHUNK`` bytes at a time; a longer text comes alone."""
        groups, held, size = [], [], 0
        for own in found:
            texts = own.column(2).cast(pa.binary())
            for group, text in zip(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True), texts, strict=True):
                text = text.as_py().translate(_TERMS)
                if held and size + len(text) > CHUNK:
                    yield groups, held
                    groups, held, size = [], [], 0
                groups.append(group)
                held.append(text)
                size += len(text) + 1
        if held:
            yield groups, held

    def written(groups: dict[tuple[str, str], int], counts: list[pa.Table], terms: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        none = np.zeros(len(groups), dtype=np.int64)
        yield from _batches(langs, sources, None, None, none, none)
        for t in _slices(_summed(counts)):
            group = t.column("group")
            yield from _batches(langs.take(group), sources.take(group), t.column("digest"), None, t.column("n"), t.column("docs"))
        for t in _slices(_merged(terms, ["digest", "term"], [])):
            yield from _batches(None, None, t.column("digest"), t.column("term"), None, None)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        counts, terms, fresh = [], [], 0
        for told, texts in chunks(found):
            own, shown = _counts_of(texts, bits)
            group = np.array([groups.setdefault(g, len(groups)) for g in told])[own.column("text").to_numpy()]
            one = np.ones(len(group), dtype=np.int64)
            counts.append(pa.table({"group": group, "digest": own.column("digest"), "n": own.column("n"), "docs": one}))
            terms.append(shown)
            fresh += len(group)
            if fresh >= HELD_TERMS // 4:
                counts, terms, fresh = _summed(counts), _merged(terms, ["digest", "term"], []), 0
                if sum(t.num_rows for t in counts + terms) + len(groups) >= HELD_TERMS:
                    yield from written(groups, counts, terms)
                    groups, counts, terms = {}, [], []
        if groups:
            yield from written(groups, counts, terms)
        pa.default_memory_pool().release_unused()  # a worker that is kept for other tasks would keep it

    return count


def _counted_by_text(bits: int):
    """Counts of every text's terms, with the terms."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in found:
            for lang, source, text in zip(*(own.column(k) for k in (0, 1, 2)), strict=True):
                n = Counter(text.cast(pa.binary()).as_py().translate(_TERMS).split())
                terms = b" ".join(n)
                digest = np.concatenate([np.zeros(0, np.int64), *(_terms_of([x], bits)[0] for x in _pieces(terms))])
                same = ([x.as_py()] * len(n) for x in (lang, source))
                if n:
                    yield from _batches(*same, digest, pa.array(n, pa.binary()), list(n.values()), np.ones(len(n), np.int64))

    return count


def term_counts(docs: DataFrame, bits: int = 64, with_text: bool = False) -> DataFrame:
    """Pre-aggregated counts and texts of each task; with ``with_text`` every text's counts, each with its term."""
    plain = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    schema = "lang string, source string, digest bigint, term string, n bigint, docs bigint"
    return plain.mapInArrow((_counted_by_text if with_text else _counted)(bits), schema)


def kept_terms(docs: DataFrame, raw: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The kept terms of each language, as (counts by group, texts).

    The first has ``lang``, ``source``, ``digest``, ``text`` (empty, but for digests of several terms), ``n``; the second ``lang``,
    ``digest``, ``text``, ``term``.
    """
    counts = raw.where("n > 0").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "digest-counts")
    often = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    often = stored(often.select("lang", "digest"), "kept-digests")
    # Texts of kept digests only: more than one over all tasks tell a digest of several terms.
    known = raw.where("n is null").select("digest", "term")
    known = known.join(often.select("digest").distinct(), "digest", "left_semi").distinct()
    known = stored(known, "kept-texts")
    kept = counts.select("lang", "source", "digest", "n").join(often, ["lang", "digest"], "left_semi")
    texts = often.join(known, "digest").select("lang", "digest", F.lit("").alias("text"), "term")
    unclear = known.groupBy("digest").agg(F.count(F.lit(1)).alias("terms")).where("terms > 1").select("digest")
    several = often.join(unclear, "digest", "left_semi")
    if not unclear.isEmpty():
        key = ["lang", "digest", "term"]
        split = term_counts(docs, bits, with_text=True).where("n > 0").join(several, ["lang", "digest"], "left_semi")
        split = stored(split, "split-counts")
        enough = split.groupBy(*key).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select(*key)
        by_text = split.join(enough, key, "left_semi").groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"))
        kept = kept.join(several, ["lang", "digest"], "left_anti").withColumn("text", F.lit(""))
        kept = kept.unionByName(by_text.withColumnRenamed("term", "text"))
        texts = texts.join(several, ["lang", "digest"], "left_anti")
        texts = texts.unionByName(enough.select("lang", "digest", F.col("term").alias("text"), "term"))
    else:
        kept = kept.withColumn("text", F.lit(""))
    return stored(kept.select("lang", "source", "digest", "text", "n"), "group-counts"), texts


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact."""
    top = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)")
    return F.when(terms > 0, F.call_function("div", top, below) + 1)


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _blocks(sources: Column, terms: Column) -> Column:
    """Blocks that a language's terms are dealt to."""
    return F.greatest(F.ceil(sources * terms / BLOCK_CELLS), F.lit(1)).cast("int")


def _pair_sums(_: tuple, own: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of a block for every ordered pair of a language's sources."""
    if not groups.num_rows:
        return pa.table({"lang": [], "source": [], "item": [], "value": []}, PAIRS)
    sources = groups.column("source").to_pylist()
    place = {s: k for k, s in enumerate(sources)}
    column: dict[tuple[int, str], int] = {}
    told = zip(own.column("digest").to_pylist(), own.column("text").to_pylist(), strict=True)
    terms = [column.setdefault(term, len(column)) for term in told]
    slices = groups.column("slices")[0].as_py()
    part = groups.column("slice")[0].as_py()
    shares = np.repeat(groups.column("p0").to_numpy()[:, None], len(column), axis=1)
    shares[[place[s] for s in own.column("source").to_pylist()], terms] = own.column("p").to_numpy()
    values, mine = [np.zeros(0, dtype=np.int64)], range(part, len(sources), slices)
    for k in mine:
        apart = shares[k] - shares
        values.append((apart * apart // shares).sum(axis=1, dtype=np.int64))
    lang, n = groups.column("lang")[0].as_py(), len(mine) * len(sources)
    columns = [[lang] * n, [sources[k] for k in mine for _ in sources], sources * len(mine), np.concatenate(values)]
    return pa.table([pa.array(x, t) for x, t in zip(columns, PAIRS.types, strict=True)], PAIRS)


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: every other source of the language, all kept terms summed."""
    term = F.struct("digest", "text")
    own = shares.withColumn("block", F.pmod(F.xxhash64(term, F.lit(7)), F.col("blocks")).cast("int"))
    slices = F.ceil(F.col("sources") * F.col("sources") / BLOCK_PAIRS).cast("int").alias("slices")
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    own = own.select("lang", "block", "source", "p", "digest", "text", slices).select("*", each).drop("slices")
    every = F.explode(F.sequence(F.lit(0), _blocks(F.col("sources"), F.col("terms")) - 1)).alias("block")
    spread = groups.select("lang", every, "source", F.coalesce("p0", F.lit(1)).alias("p0"), slices).select("*", each)
    met = own.groupBy("lang", "block", "slice").cogroup(spread.groupBy("lang", "block", "slice"))
    sums = met.applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    summed = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.where("source <> item")


def term_values(shares: DataFrame, texts: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` of the terms that a source uses more than its language does.

    Every row is there whose value is not below that of the rank asked for.
    """
    key = ["lang", "digest", "text"]
    of_lang = shares.groupBy(*key).agg(F.sum("n").alias("n")).join(totals, "lang")
    of_lang = of_lang.select(*key, _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    over = shares.select(*key, "source", "p").join(of_lang, key).where("p > q")
    over = stored(over.select(*key, "source", _value(F.col("p"), F.col("q")).alias("value")), "term-values")
    equal = over.groupBy("lang", "source", "value").agg(F.count(F.lit(1)).alias("rows"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    before = F.coalesce(F.sum("rows").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = equal.withColumn("before", before).where(F.col("before") < ranks)
    least = least.groupBy("lang", "source").agg(F.min("value").alias("least"))
    near = over.join(least, ["lang", "source"]).where("value >= least")
    return near.join(texts, key).select("lang", "source", F.col("term").alias("item"), "value")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = 200, bits: int = 64) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``, as the module states.

    ``bits`` is the width of a digest; fewer bits give more digests that stand for several terms, and equal results.
    """
    raw = stored(term_counts(docs, bits), "term-counts")
    kept, texts = kept_terms(docs, raw, min_docs, bits)
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total"))
    terms = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    every = raw.where("n = 0").select("lang", "source").distinct()
    sources = every.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = sources.join(terms, "lang", "left").join(totals, "lang", "left")
    langs = langs.select("lang", "sources", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "total")))
    groups = every.join(sizes, ["lang", "source"], "left").join(langs, "lang")
    groups = groups.withColumn("group_total", F.coalesce("group_total", F.lit(0)))
    p0 = _share(F.lit(0), F.col("group_total"), F.col("terms")).alias("p0")
    groups = stored(groups.select("lang", "source", "sources", "terms", "total", "group_total", p0), "groups")
    about = groups.select("lang", "source", "group_total", "terms", "sources")
    share = _share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p")
    blocks = _blocks(F.col("sources"), F.col("terms")).alias("blocks")
    shares = kept.join(about, ["lang", "source"])
    shares = shares.select("lang", "source", "digest", "text", "n", share, "sources", blocks)
    pairs = pair_values(shares, groups).withColumn("part", F.lit("pair"))
    of_langs = groups.select("lang", "terms", "total").distinct()
    single = term_values(shares, texts, of_langs, ranks).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    pairs = pairs.select(*columns, rank)
    single = single.select(*columns, rank).where(F.col("rank") <= ranks)
    return pairs.unionByName(single)
