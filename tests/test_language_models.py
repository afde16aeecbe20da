"""Character language models against a plain recomputation; epochs with early stopping."""

import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logtriage.operators import charlm as LM
from logtriage.operators import epochs as EP
from logtriage.plans.queries import QUERIES
from logtriage.plans.request_logs import request_logs

TRAIN = [
    (1, "${jndi:ldap://h/a}", 1), (2, "${jndi:rmi://x/b}", 1), (3, "GET /index HTTP/1.1", 0), (4, "GET /a?b=c HTTP/1.1", 0),
    (5, "", 0), (6, None, 1), (7, "£ß日本 jndi", None), (8, "%24%7Bjndi:dns://q%7D", 1), (9, "POST /login", 0),
]
OTHER = [(20, "${jndi:ldap://other}", 1), (21, "GET /other", 0), (22, "日本語", 0), (23, "", 1)]


@pytest.fixture(scope="module")
def lines(spark):
    build = lambda rows: LM.with_features(spark.createDataFrame(rows, "log_id bigint, raw_log string, label int"))
    return build(TRAIN), build(OTHER)


def trigrams(text):
    padded = "\x02\x02" + (text or "") + "\x03"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def plain_weights():
    counts = [Counter(), Counter()]
    for _, text, label in TRAIN:
        if label is not None:
            counts[label].update(trigrams(text))
    weights, lower = {}, None
    for n in (1, 2, 3):
        own = [Counter(), Counter()]
        for k in (0, 1):
            for gram, c in counts[k].items():
                own[k][gram[3 - n :]] += c
        p = {}
        for gram in own[0] | own[1]:
            total = [sum(c for g, c in own[k].items() if g[: n - 1] == gram[: n - 1]) for k in (0, 1)]
            below = [1 / 256] * 2 if lower is None else lower[gram[1:]]
            p[gram] = [(own[k][gram] + 2 * below[k]) / (total[k] + 2) for k in (0, 1)]
            weights[gram] = round((math.log(p[gram][1]) - math.log(p[gram][0])) * 1e6)
        lower = p
    return weights


def test_weights_and_scores_equal_plain_ones(spark, lines, tmp_path):
    model = LM.fit(lines[0], "raw")
    expected = plain_weights()
    assert {r.gram: r.weight for r in model.weights.collect()} == expected
    LM.save(model, f"{tmp_path}/model")
    again = LM.load(spark, f"{tmp_path}/model", "raw")
    found = {r.log_id: (r.total, r.n) for r in LM.totals(lines[1], again, ["log_id"]).collect()}
    for log_id, text, _ in OTHER:
        own = trigrams(text)
        total = sum(next((expected[g] for g in (t, t[1:], t[2:]) if g in expected), 0) for t in own)
        assert found[log_id] == (total, len(own))
    scores = {r.log_id: r.score_raw for r in LM.score_columns(lines[1], [model], ["log_id"]).collect()}
    assert scores[20] > 0.5 > scores[21]


def test_signals_add_their_weights(lines):
    text, signal = LM.fit(lines[0], "normalized"), LM.fit(lines[0], "signal")
    names = {r.gram for r in signal.weights.where("length(gram) > 3").collect()}
    assert len(names) == 26 and "1:has_jndi" in names
    a, b = ({r.log_id: r for r in LM.totals(lines[1], m, ["log_id"]).collect()} for m in (text, signal))
    assert all(b[k].n == a[k].n + 13 for k in a) and b[20].total > a[20].total and b[21].total < a[21].total


def table(spark, rows):
    return LM.with_features(spark.createDataFrame(rows, "log_id bigint, raw_log string, label int"))


def made(n, start, flip=False):
    bad, good = "${jndi:ldap://host%d/a}", "GET /page/%d HTTP/1.1"
    return [(start + k, (bad if k % 2 else good) % k, (k % 2) ^ int(flip)) for k in range(n)]


@pytest.mark.parametrize("variant", ["raw", "signal"])
def test_epochs_keep_the_best(spark, variant, tmp_path):
    train, val = table(spark, made(120, 0)), table(spark, made(40, 1000))
    model = EP.fit_epochs(train, val, variant, "log_id", epochs=4, bits=10)
    losses = [v for _, _, v in model.history]
    assert model.best == 1 + int(np.argmin(losses)) and losses[-1] < losses[0]
    scored = EP.score_epochs(val, model, "score").collect()
    assert all((r.score >= 0.5) == (r.label == 1) for r in scored)
    EP.save_epochs(spark, model, str(tmp_path / "m"))
    again = EP.load_epochs(spark, str(tmp_path / "m"))
    assert (again.weights == model.weights).all() and again.history == model.history and again.best == model.best


def test_early_stop_when_validation_gets_worse(spark):
    train, val = table(spark, made(120, 0)), table(spark, made(40, 1000, flip=True))
    model = EP.fit_epochs(train, val, "raw", "log_id", epochs=9, patience=2, bits=10)
    assert model.best == 1 and len(model.history) == 3
    assert EP.history(spark, model).where("chosen").count() == 1


def test_epochs_need_both_labels_and_a_validation_split(spark):
    rows = table(spark, made(10, 0))
    for train, val in ((rows.where("label = 1"), rows), (rows, rows.limit(0))):
        with pytest.raises(ValueError, match="both labels"):
            EP.fit_epochs(train, val, "raw", "log_id", bits=8)


def test_lookups_equal_joins_and_move_no_rows(spark, sf):
    """Sums that tasks look up are those of the join with the table of weights, and scoring has no shuffle."""
    logs = LM.with_features(request_logs(spark, sf)).cache()
    odd = ["", None, "x", "é", chr(0x1F600) * 3 + "ab", "\x02\x02\x03", "never seen: ÿþý", "GET /" + "a" * 5000]
    texts = spark.createDataFrame(list(enumerate(odd, start=10**6)), "log_id bigint, text string")
    first = logs.orderBy("log_id").limit(1).select("signals").crossJoin(texts)
    rows = first.select("log_id", F.col("text").alias("raw_log"), F.col("text").alias("normalized_log"), "signals")
    rows = rows.unionByName(logs.where("log_id % 20 = 0").select(rows.columns))
    for variant in LM.VARIANTS:
        model = LM.fit(logs.where("split = 'train'"), variant)
        found = LM.totals(rows, model, ["log_id"])
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, LM.joined_totals(rows, model, ["log_id"]).collect()))
        plan = LM.totals(logs, model, ["log_id"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Join" not in plan.split("InMemoryRelation")[0]


def test_an_epoch_reads_lines_once(spark, lines, monkeypatch):
    """The pass that measures an epoch takes the next one's steps: n epochs are n + 1 passes."""
    passes = []
    once = EP._passed
    monkeypatch.setattr(EP, "_passed", lambda *args: passes.append(1) or once(*args))
    train, other = lines
    model = EP.fit_epochs(train, other, "signal", "log_id", epochs=3, patience=3)
    assert len(model.history) == 3 and len(passes) == 4
    ids = train.select("raw_log", EP.feature_ids("raw").alias("ids")).collect()
    room = (1 << EP.BITS)
    assert all(len(set(r.ids)) == len(r.ids) <= len(set(trigrams(r.raw_log))) for r in ids)
    assert all(13 <= i < room for r in ids for i in r.ids)


def test_lines_are_kept_as_packed_cells(spark, monkeypatch):
    """Passes read cells of bytes that hold many lines, and find in them the record batches that were packed, in order."""
    kept = []
    cut = EP.cut_lineage
    monkeypatch.setattr(EP, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    odd = [(2000, "", 1), (2001, None, 0), (2002, "日本語" + chr(0x1F600), 1), (2003, "long " + "x" * 9000, 0), (2004, "no label", None)]
    train, val = table(spark, made(400, 0) + odd), table(spark, made(40, 1000))
    EP.fit_epochs(train, val, "signal", "log_id", epochs=1)
    cells = kept[0]
    assert cells.count() < 100 and max(len(r.cell) for r in cells.collect()) <= EP.CELL
    assert cells.agg(*[F.sum(c) for c in EP.COUNTS]).first() == (20, 20, 202, 202)
    batch = pa.RecordBatch.from_pydict(
        {"is_train": [True, False], "label": [1, 0], "text": ["abc" * 3000, ""], "told": pa.array([5, 0], pa.int32())}
    )
    packed = [c for b in (batch, batch.slice(1)) for c in EP._packed(14, iter([b]))]
    found = list(EP._unpacked(14, iter(c.slice(k, 1) for c in packed for k in range(len(c)))))
    assert [b.column("label").to_pylist() for b in found] == [[1, 0], [0]]
    ids = found[0].column("ids").to_pylist()
    assert ids[0][:2] == [0, 2] and all(i > 12 for i in ids[0][2:]) and len(ids[1]) == 1 and found[1].column("ids").to_pylist() == ids[1:]


def test_places_are_the_distinct_hashes(spark):
    """Sorting finds the distinct places that a set finds, and does not take the way over hash tables."""
    texts = ["", "abab" * 50, "GET /a?b=c", "日本語" * 3]
    ids = EP._places(pa.array(texts), pa.array([0, 1 << 12, 3, 0], pa.int32()), 14).to_pylist()
    assert all(i == sorted(set(i)) for i in ids)
    assert [len([x for x in i if x < 13]) for i in ids] == [0, 1, 2, 0]
    assert [len([x for x in i if x > 12]) for i in ids] == [len(set(trigrams(t))) for t in texts]


def test_steps_work_on_the_own_type_of_numpy(monkeypatch):
    """Weights reach a task by pickle, which gives them a type that ``subtract.at`` is slow with."""
    found = []
    monkeypatch.setattr(EP, "_step_batch", lambda own, *rest: found.append(own.dtype))
    weights = pickle.loads(pickle.dumps(np.zeros((1 << 10) + 1)))
    batch = pa.RecordBatch.from_pydict({"is_train": [True], "label": [1], "ids": [[13, 14]]})
    list(EP._pass(weights, (1.0, 1.0), 0.5, 1e-5, iter([batch])))
    assert found[0] is np.dtype(np.float64)


def test_scores_after_reading_meet_without_a_join(spark, monkeypatch, tmp_path):
    """The check of the weights that were read scores each line twice in its row; lines of one id are compared with each other."""
    fit, scored, texts = EP.fit_epochs, EP.score_epochs, []
    monkeypatch.setattr(EP, "fit_epochs", lambda *args: fit(*args, epochs=2))
    monkeypatch.setattr(EP, "score_epochs", lambda df, *args: texts.append(df.columns) or scored(df, *args))
    ts = F.timestamp_seconds(F.col("event_id")).alias("ts")
    pages = spark.range(5).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example/p"), "id").alias("url"))
    for n in (1, 2):  # lines of an id, which differ in their host
        events = spark.range(600 * n).select(F.floor(F.col("id") / n).alias("event_id"), (F.col("id") % 7).alias("user_id"))
        events.select("event_id", ts, "user_id").write.parquet(f"{tmp_path}/{n}/events.parquet")
        pages.write.parquet(f"{tmp_path}/{n}/pages.parquet")
        found = QUERIES["training_history"](spark, f"{tmp_path}/{n}")
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
        assert {r.model for r in rows} == set(LM.VARIANTS) and all(r.same_after_reading == (n == 1) and r.chosen == 1 for r in rows)
    assert [("first" in t) for t in texts] == [False, True] * 6
