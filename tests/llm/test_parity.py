"""Parity-sketch join against brute force: sketches, bands, leaders, blocks and odd rows."""

import random

import numpy as np
import pytest
from test_duplicates import brute_components, family, got_components

from logtriage.llm import parity


def got(df):
    return sorted(((d, n, c, d == c) for d, n, c in got_components(df)), key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_links_share_a_token_and_pass_the_sketch(percent):
    rng = np.random.default_rng(percent)
    bands = parity.Bands(percent)
    for size in [*range(1, 60), 200, 900, 5000]:
        base = rng.integers(0, 1 << 63, size * 2, dtype=np.uint64)
        for _ in range(6):
            common = int(rng.integers(max(1, size * percent // 100), size + 1))
            more = int(rng.integers(0, size - common + 1))
            a, b = base[:size], np.concatenate([base[:common], base[size : size + more]])
            if 100 * common < percent * (size + more):
                continue
            shared = set(bands.of(len(a))) & set(bands.of(len(b)))
            if not shared:
                assert common == size and not more
                continue
            band = max(bands.of(len(a))[0], bands.of(len(b))[0])
            assert band in shared
            (mine, fold), (other, fold_b) = (parity.sketch(x, band, bands.shape(band)) for x in (a, b))
            assert set(mine.tolist()) & set(other.tolist())
            apart = int(np.bitwise_count(fold ^ fold_b).sum())
            assert apart <= size + more - common <= bands.differences(len(a) + len(b))


def rows(seed, families, size):
    rng = random.Random(seed)
    found = []
    for _ in range(families):
        found += family(rng, size)
    found += [" ".join(f"u{rng.randrange(900)}" for _ in range(rng.randrange(90))) for _ in range(40)]
    found += [None, "", " \t", "one", "one two", "ONE two", "one two three", "x " * 30_000, ("x " * 30_000).upper(), "É é É", "é É é"]
    found += found[:25]
    return [(k % 300 if k % 11 else None, t) for k, t in enumerate(found)]


@pytest.mark.parametrize("seed, short, rounds, percent", [(1, 12, 8, 90), (2, 2, 2, 90), (3, 1, 0, 80)])
def test_components(spark, docs_of, seed, short, rounds, percent, monkeypatch):
    monkeypatch.setattr(parity, "SHORT", short)
    monkeypatch.setattr(parity, "ROUNDS", rounds)
    monkeypatch.setattr(parity, "NEAREST", 1)
    monkeypatch.setattr(parity, "BLOCK_ROWS", 9)
    data = rows(seed, 6, 25)
    found = parity.jaccard_classes(docs_of(data, clash=True), words=3, percent=percent)
    expected = brute_components(data, 3, percent)
    assert got(found) == expected
    assert len({(r[2]) for r in expected}) < len(expected) - 40


def test_a_family_without_a_centre(spark, docs_of, monkeypatch):
    monkeypatch.setattr(parity, "SHORT", 2)
    monkeypatch.setattr(parity, "ROUNDS", 2)
    words = [f"w{k}" for k in range(400)]
    data = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(60)]  # each is like its neighbours only
    assert got(parity.jaccard_classes(docs_of(data), 3, 90)) == brute_components(data, 3, 90)


def test_repeated_null_ids_stay_linear(spark, docs_of):
    data = [(None, f"same words in every text but {k % 2}") for k in range(600)] + [(7, "same words in every text but 0")]
    found = parity.jaccard_classes(docs_of(data), 3, 90).groupBy("component_id").count().collect()
    assert sorted((r[0] is None, r[1]) for r in found) == [(False, 301), (True, 300)]
    profile = parity.profiles(docs_of(data), 3, 90).where("cls is not null")
    picked = profile.groupBy("c", "cls").agg({"digest": "first"}).selectExpr(
        "c", "cls", "named_struct('doc_id', cast(null as bigint), 'digest', `first(digest)`) AS row"
    )
    assert parity.class_sets(docs_of(data), picked, 3).count() == 2


def test_empty_table(spark, docs_of):
    assert parity.jaccard_classes(docs_of([(1, "x")]).limit(0)).collect() == []


def test_similarity_out_of_range():
    with pytest.raises(ValueError, match="similarity"):
        parity.Bands(40)


def test_sieve_keeps_all_that_is_wanted(spark):
    from pyspark.sql import functions as F

    from logtriage.llm.common import sieved

    rows = spark.range(-500, 500)
    for bits, most in ((6, 1000), (26, 120)):
        wanted = rows.where("id % 10 = 0")
        found = {r.id for r in sieved(rows, F.xxhash64("id"), wanted, F.xxhash64("id"), bits).collect()}
        assert set(range(-500, 500, 10)) <= found and len(found) <= most
    assert sieved(rows, F.xxhash64("id"), rows.limit(0), F.xxhash64("id")).count() == 0


def test_postings_are_shuffled_once(spark):
    """Lists of several members with their lengths, from one shuffle of the postings and no join."""
    from logtriage.llm.parity import posting_lists

    data = [(1, [[7, 8], [9]]), (2, [[7], [9]]), (3, [[7, 5]]), (4, [[4]])]
    lists = posting_lists(spark.createDataFrame(data, "c bigint, tokens array<array<bigint>>"))
    found = sorted((r.token, r.c, r.k, r.length) for r in lists.collect())
    assert found == [(7, 1, 0, 3), (7, 2, 0, 3), (7, 3, 0, 3), (9, 1, 1, 2), (9, 2, 1, 2)]
    plan = lists._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sets_are_not_shuffled_to_drop_repeated_rows(spark, docs_of):
    data = [(k % 9 if k % 3 else None, f"some words that repeat {k % 5}") for k in range(60)]
    profile = parity.profiles(docs_of(data), 3, 90)
    picked = profile.groupBy("c", "cls").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id")
    picked = profile.join(picked, ["c", "cls", "doc_id"]).selectExpr("c", "cls", "struct(doc_id, digest) AS row").distinct()
    picked = spark.createDataFrame(picked.collect(), picked.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = parity.class_sets(docs_of(data), picked, 3)
        assert sorted(r.c for r in sets.collect()) == sorted(r.c for r in picked.collect())
        plan = sets._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
