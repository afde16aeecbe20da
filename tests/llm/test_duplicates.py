"""Near-duplicates, suffix index and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtriage.llm import decontam, near_dups, suffix_index
from logtriage.llm.components import components
from logtriage.llm.queries import QUERIES


def shingle_set(text, k):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for own in groups.values():
        ids = [sets[i][0] for i in own if sets[i][0] is not None]
        for i in own:
            least[i] = min(ids) if ids else None
    return sorted(
        ((d, len(s), least[i], d == least[i]) for i, (d, s) in enumerate(sets)), key=lambda r: tuple(map(repr, r))
    )


def got_components(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(repr, r)))


def family(rng, size, words=80):
    """A base text and copies with more and more edits, and copies of copies."""
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    found = [base]
    for _ in range(size):
        copy = list(rng.choice(found if rng.random() < 0.3 else [base]))
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(60)}"
        found.append(copy)
    return [" ".join(x) for x in found]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs_of, words, percent):
    rng = random.Random(words)
    texts = family(rng, 150) + family(rng, 12) + family(rng, 3, 6)
    texts += ["a b", "A  B", "a b c", "a", "", " \t", None, "x " * 4000, "y " * 4000 + "z"]
    texts += [" ".join(rng.choices("the of and to in".split(), k=6)) for _ in range(80)]
    rows = [(k if k % 9 else (k // 9) % 4 or None, t) for k, t in enumerate(texts)] + [(3, texts[0])] * 3
    found = near_dups.near_duplicates(docs_of(rows, clash=True), words, percent)
    assert got_components(found) == brute_components(rows, words, percent)


def test_blocks_of_long_lists_lose_no_link(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dups, "SHORT", 2)
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 20)
    rows = list(enumerate(family(random.Random(1), 120)))
    assert got_components(near_dups.near_duplicates(docs_of(rows), 3, 85)) == brute_components(rows, 3, 85)


def test_near_duplicates_of_nothing(spark, docs_of):
    assert near_dups.near_duplicates(docs_of([]), 3, 85).count() == 0


def test_near_duplicate_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got_components(QUERIES["op5_near_duplicates"](spark, sf)) == brute_components(rows, 3, 85)


def test_match_threshold():
    assert near_dups.matches_needed(100) == near_dups.COORDINATES
    assert 15 <= near_dups.matches_needed(85) <= 20 and near_dups.matches_needed(80) < near_dups.matches_needed(85)


def test_forest_connects_what_links_connect():
    rng = random.Random(3)
    sets = [np.unique([rng.randrange(40) for _ in range(rng.randrange(1, 25))]).astype(np.int64) for _ in range(120)]
    links = {
        (i, j)
        for i in range(120)
        for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
    }
    found = near_dups.forest(sets, 60)
    assert all((max(e), min(e)) in links for e in found) and len(found) < 120

    def parts(edges):
        root = list(range(120))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(k for k in range(120) if find(k) == find(i)) for i in range(120)}

    assert parts(found) == parts(links)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(chain, "a int, b int")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 150)} | {201: 200}
    assert components(df.where("a = b")).count() == 0


def brute_removal(rows, length):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    found = []
    for d, b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        found.append((d, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def suffix_texts():
    rng = random.Random(8)
    words = [f"{a}{b}é" for a in "abcdef" for b in "uvwxyz"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = make(60), make(15)
    texts = [make(30) + passage + make(20), passage, make(5) + passage[3:] + other, other + make(50) + other, make(40)]
    texts += [passage[:200] + make(10) + passage[150:], "ab" * 300, "x" * 90, "x" * 700, make(100), "", None]
    texts += [texts[9], texts[9][:250] + "!" + texts[9][251:]]
    return [(k % 11 or None, t) for k, t in enumerate(texts)] + [(4, "same row " * 12)] * 2


@pytest.mark.parametrize("few", [1 << 12, 0])
def test_suffix_dedup(spark, docs_of, few):
    rows = suffix_texts()
    found = suffix_index.without_repeats(docs_of(rows, clash=True), 60, seed=20, few=few)
    got = sorted((tuple(r) for r in suffix_index.digest(found).collect()), key=repr)
    assert got == brute_removal(rows, 60)
    for r in found.collect():
        assert r.n_bytes - r.n_removed == len(r.kept) and r.n_removed == sum(b - a for a, b in r.spans or [])


def test_suffix_blocks_of_long_texts(spark, docs_of, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choices("abcd", k=2500))
    rows = [(1, long), (2, long[700:1500] + "!" + long[200:900]), (3, long[::-1])]
    monkeypatch.setattr(suffix_index, "BLOCK", 256)
    monkeypatch.setattr(suffix_index, "_PLACE", np.uint64((1 << 19) - 1))
    for _, text in rows:
        key, run, first, strings = suffix_index.suffix_rows(text.encode(), 60, 20)
        assert strings.sum() == len(text) - 59 and (np.diff(first) == strings[:-1]).all()


def test_suffix_levels_are_logarithmic(spark, docs_of):
    index = suffix_index.SuffixIndex(spark, 60, 20)
    batches = [docs_of([(k, t)]) for k, (_, t) in enumerate(suffix_texts()[:6])]
    sizes = []
    for batch in batches:
        index.add(batch)
        sizes.append([rank for rank, _ in index.levels])
    assert sizes == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    assert index.rows().count() == sum(index.suffixes(b).count() for b in batches)
    assert suffix_index.digest(suffix_index.without_repeats(docs_of([]))).count() == 0


def test_rows_of_one_frequent_seed_are_dealt_to_several_tasks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix_index, "MANY_ROWS", 25)
    rng = random.Random(6)
    seen = "one seed that all texts hold".ljust(30, "!")
    rows = [(k, "".join(rng.choices("abcd ", k=45)) + seen + "".join(rng.choices("abcd ", k=45))) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(60)]
    index = suffix_index.SuffixIndex(spark, 60, 20)
    for k in range(2):
        asked = index.add(docs_of(rows[k::2]))
    level = index.level(index.levels[0][1])
    hot = level.groupBy("key").count().orderBy("count", ascending=False).first()
    assert hot["count"] > 100
    own = level.where(level["key"] == hot["key"])
    assert len(own.select("_metadata.file_path").distinct().collect()) > 1
    keys = suffix_index.stored(level.groupBy("key").agg(F.count("*").alias("own")), "keys")
    assert {r.key for r in asked.collect()} <= {r.key for r in keys.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = suffix_index.joined(own, keys, ["key"], "own").withColumn("task", F.spark_partition_id())
        counts = [r["count"] for r in met.groupBy("task").count().collect()]
        assert sum(counts) == hot["count"] and len(counts) > 1
        found = suffix_index.digest(suffix_index.without_repeats(docs_of(rows), 60, seed=20, few=4))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_removal(rows, 60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_suffix_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()), key=repr) == brute_removal(rows, 400)


def brute_tiles(a, b, least):
    """Greedy string tiling by plain comparison: the first longest run in the item wins."""
    a, b, found = list(a), list(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != 0:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return found
        i, j, n = best
        a[i : i + n] = [0] * n
        b[j : j + n] = [0] * n
        found.append(best)


@pytest.mark.parametrize("seed", range(6))
def test_tiles(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 6, n).astype(np.uint64) for n in (60, 30))
    b[b == 0] = 5
    got, want = decontam.tiles(a, b, 3), brute_tiles(a.tolist(), b.tolist(), 3)
    assert [n for _, _, n in got][:1] == [n for _, _, n in want][:1]
    for tiles in (got, want):
        for i, j, n in tiles:
            assert a[i : i + n].tolist() == b[j : j + n].tolist()
    assert abs(sum(n for *_, n in got) - sum(n for *_, n in want)) <= 3


def test_reordered_passages_are_found(spark, docs_of):
    rng = random.Random(4)
    item = [f"t{rng.randrange(10**6)}" for _ in range(40)]
    parts = [item[k : k + 10] for k in range(0, 40, 10)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    join = lambda *x: " ".join(w for p in x for w in p)
    rows = [
        (1, join(filler(9), parts[2], filler(5), parts[0], parts[3], filler(3), parts[1])),
        (2, join(filler(30), parts[0], parts[1], filler(10))),
        (3, join(filler(80))),
        (4, join(item[:20], ["other"], item[20:])),
        (None, join(item).upper()),
        (5, None), (6, ""), (7, "tiny item"), (7, "a tiny item here"),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "Tiny, item!")], "item_id int, text string")
    found = decontam.contaminated(docs_of(rows, clash=True), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 10), (4, 10), (None, 10), (7, 13)}
    assert {r.doc_id: r.n_tiles for r in found}[1] == 4 and all(r.coverage == 1.0 for r in found)
    kept = decontam.decontaminated(docs_of(rows, clash=True), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, None, 5, 6} and "cls" in kept.columns
    clean = decontam.clean_rows(docs_of(rows, clash=True), bench)
    assert {r.doc_id for r in clean.collect()} == {2, 3, 5, 6} and clean.columns == kept.columns
    assert decontam.clean_rows(docs_of(rows), bench.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs_of([]), bench).count() == 0
    assert decontam.contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_long_items(spark, docs_of):
    """Items far longer than any of the tables: copied whole, reordered, and sharing one seed only."""
    rng = random.Random(9)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    item, other = words(420), words(65)
    parts = [item[k : k + 105] for k in range(0, 420, 105)]
    rows = [
        (1, words(7) + item + words(9)),
        (2, parts[3] + words(5) + parts[1] + parts[0] + words(70) + parts[2]),
        (3, words(200) + item[200:205] + words(200)),
        (4, other),
        (5, item[:400]),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other))], "item_id int, text string")
    found = decontam.contaminated(docs_of([(d, " ".join(w)) for d, w in rows]), bench).collect()
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_covered, r.n_tiles) for r in found}
    assert got == {(1, 10): (420, 420, 1), (2, 10): (420, 420, 4), (4, 11): (65, 65, 1), (5, 10): (420, 400, 1)}


def test_benchmark_blocks(spark, sf, monkeypatch):
    whole = {tuple(r) for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert {tuple(r) for r in QUERIES["op6_decontamination"](spark, sf).collect()} == whole
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    planted = {(d, i) for i, x in items.items() for d, t in docs.items() if x in t}
    assert planted <= {(r[0], r[1]) for r in whole}


def test_clean_rows_in_blocks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    whole = {r.doc_id for r in decontam.clean_rows(docs, bench).collect()}
    hits = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert whole == {r.doc_id for r in docs.collect()} - hits
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert {r.doc_id for r in decontam.clean_rows(docs, bench).collect()} == whole


def test_null_ids_read_their_texts_once(spark, docs_of):
    """Many rows without an id: texts are fetched by id and digest, so the rows that are read stay as many as the rows."""
    data = [(None, f"{k} one text of many that has no id of its own") for k in range(2000)] + [(None, "a b c d")] * 50
    docs = docs_of(data)
    profile = near_dups.profiles(docs, 3)
    classes = profile.where("cls is not null").groupBy("cls").agg({"digest": "first"})
    wanted = classes.selectExpr("cls", "named_struct('doc_id', cast(null as bigint), 'digest', `first(digest)`) AS row")
    assert near_dups.class_sets(docs, wanted, 3).count() == 2001
