"""Metrics against brute force on tied and skewed scores."""

import random

import pytest
from pyspark.sql import functions as F

from logtriage.operators import metrics as M
from logtriage.operators.ordered import first_distinct, number_rows, running_totals, shuffle, tail


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(y for y, _ in rows)
    if not total or total == len(rows):
        return None
    score, before = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        score += (sum(hit) / total - before) * sum(hit) / len(hit)
        before = sum(hit) / total
    return score


def brute_threshold(rows, preferred):
    step = (0.95 - 0.05) / 180
    swept = []
    for i in range(181):
        t = 0.05 + i * step
        tp = sum(1 for y, s in rows if y and s >= t)
        fp = sum(1 for y, s in rows if not y and s >= t)
        fn = sum(1 for y, s in rows if y and s < t)
        swept.append((t, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0))
    best = max(f for _, f in swept)
    close = [t for t, f in swept if abs(f - best) <= 1e-8 + 1e-5 * abs(best)]
    return min(close, key=lambda t: (abs(t - preferred), t))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = {}
    for g in range(4):
        data[f"g{g}"] = [(y := int(rng.random() < 0.3), round(min(1, max(0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)) for _ in range(300)]
    data["grid"] = [(i % 2, 0.05 + i * ((0.95 - 0.05) / 180)) for i in range(181)]
    data["one_class"] = [(1, 0.2), (1, 0.9)]
    data["tie"] = [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]
    rows = [(g, y, float(s)) for g, points in data.items() for y, s in points]
    # One group holds most rows, with few distinct scores.
    data["hot"] = [(i % 3 // 2, [0.0, 0.45, 0.95][i % 7 % 3]) for i in range(4000)]
    rows += [("hot", y, float(s)) for y, s in data["hot"]]
    return data, spark.createDataFrame(rows, "model string, label int, score double")


def test_ranking_metrics(scored):
    data, df = scored
    for row in M.ranking_metrics(df, ["model"]).collect():
        for got, want in ((row.roc_auc, brute_auc(data[row.model])), (row.pr_auc, brute_ap(data[row.model]))):
            assert (got is None and want is None) or got == pytest.approx(want, abs=1e-12)


def test_calibration(scored):
    data, df = scored
    got = {r.model: r.threshold for r in M.calibrate(df, ["model"], 0.5).collect()}
    assert got == {g: brute_threshold(points, 0.5) for g, points in data.items()}
    assert 0.21 <= got["tie"] <= 0.80


def test_binary_metrics_with_empty_sides(scored):
    _, df = scored
    rows = {r.model: r for r in M.binary_metrics(df, ["model"], 0.5).collect()}
    one = rows["one_class"]
    assert (one.tp, one.fn, one.fpr, one.recall, one.metric_note) == (1, 1, 0.0, 0.5, M.SINGLE_CLASS_NOTE)
    assert rows["tie"].f1 == 1.0 and rows["tie"].metric_note == ""
    none = M.binary_metrics(df.filter("model = 'one_class'").withColumn("label", F.lit(0)), ["model"], 2.0).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert {r.label: r.class_weight for r in M.class_weights(df).collect()} == {1: 2.0, 0: pytest.approx(4 / 6)}
    assert sorted(r.class_weight for r in M.with_class_weight(df).collect())[-1] == 2.0


def test_numbering_and_running_totals_over_many_ranges(spark):
    df = spark.range(5000).withColumn("k", F.md5(F.col("id").cast("string"))).withColumn("g", F.col("id") % 3)
    numbered = number_rows(df, [F.col("k")], "n").collect()
    assert [r.k for r in sorted(numbered, key=lambda r: r.n)] == sorted(r.k for r in numbered)
    assert sorted(r.n for r in numbered) == list(range(1, 5001))
    sums = running_totals(df.withColumn("v", F.lit(1)), ["g"], [F.col("k").desc()], ["v"]).collect()
    for g in range(3):
        rows = sorted((r for r in sums if r.g == g), key=lambda r: r.k, reverse=True)
        assert [r.cum_v for r in rows] == list(range(1, len(rows) + 1))


def test_first_distinct_shuffle_and_tail(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "line int, t string")
    assert [r.t for r in first_distinct(df, "t", 2, F.col("line")).orderBy("first_seen").collect()] == ["b", "a"]
    assert [r.line for r in tail(df, F.col("line"), 2).collect()] == [4, 5]
    one, two = (sorted((r.position, r.line) for r in shuffle(df, "line", 1).collect()) for _ in range(2))
    assert one == two and [p for p, _ in one] == [1, 2, 3, 4, 5]


def test_latency_is_measured_over_scored_lines(spark):
    from logtriage.operators.evaluation import measured_latency

    lines = spark.range(500)
    found = measured_latency(lines, {"all": lambda df: df, "none": lambda df: df.where("id < 0")})
    assert set(found) == {"all"} and 0 < found["all"] < 1000


def test_class_weight_of_counted_rows(spark):
    """A row that stands for several equal lines weighs as much as they do together."""
    lines = [("a", 1), ("a", 1), ("a", 1), ("b", 0), ("c", 0), ("c", 0), ("d", 1)]
    single = M.with_class_weight(spark.createDataFrame(lines, "t string, label int")).collect()
    counted = spark.createDataFrame(lines, "t string, label int").groupBy("t", "label").agg(F.count("*").alias("rows"))
    found = {r.t: r.class_weight for r in M.with_class_weight(counted).collect()}
    for t in "abcd":
        assert found[t] == pytest.approx(sum(r.class_weight for r in single if r.t == t))
