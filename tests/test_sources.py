"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from logtriage.operators.detect import detect, scan_samples
from logtriage.schema import DATASET_COLUMNS, validate_schema
from logtriage.sources import alerts as A
from logtriage.sources import config, datasets, logs


def test_numbered_lines_of_large_and_small_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    big = [f"line {n} " + "x" * (n % 50) for n in range(4000)]
    (tmp_path / "logs" / "big.log").write_text("\n".join(big) + "\n", encoding="utf-8")
    (tmp_path / "logs" / "small.log").write_bytes(b"a\x0bb\r\n\xff\xfe\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = logs.read_log_lines(spark, f"{tmp_path}/logs").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.line, r.raw_log) for r in rows if r.file.endswith("big.log"))
    assert got == list(enumerate(big, start=1))
    small = sorted((r.line, r.raw_log) for r in rows if r.file.endswith("small.log"))
    bad = chr(0xFFFD)
    assert small == [(1, "a"), (2, "b"), (3, bad * 2), (4, ""), (5, "last")]


def dataset(spark):
    row = {c: c for c in DATASET_COLUMNS}
    row |= {"raw_log": 'GET /?a="b",c\n2', "label": 1}
    rows = [dict(row, id=str(n), split=s) for n, s in enumerate(["train", "val", "test", "train"])]
    return spark.createDataFrame([tuple(r[c] for c in DATASET_COLUMNS) for r in rows], ", ".join(f"{c} {'int' if c == 'label' else 'string'}" for c in DATASET_COLUMNS))


def test_dataset_round_trips(spark, tmp_path):
    df = dataset(spark)
    datasets.write_split_csv(df, f"{tmp_path}/csv")
    back = datasets.read_dataset(spark, f"{tmp_path}/csv")
    assert sorted(back.select(*DATASET_COLUMNS).collect()) == sorted(df.collect())
    datasets.write_dataset(df, f"{tmp_path}/table")
    train, val = datasets.train_val(spark, f"{tmp_path}/table")
    assert (train.count(), val.count()) == (2, 1)
    assert "PartitionFilters: [split" in train._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "")
    assert {r.split for r in datasets.missing_splits(df, ["train", "gone"]).collect()} == {"gone"}
    with pytest.raises(FileNotFoundError):
        datasets.require_splits(df, ["gone"])
    with pytest.raises(ValueError, match="raw_log"):
        validate_schema(df.drop("raw_log"))


def test_thresholds(spark, tmp_path):
    (tmp_path / "flat.json").write_text('{"raw": 0.4}')
    flat = config.read_thresholds(spark, f"{tmp_path}/flat.json").first()
    assert flat.binary_thresholds == {"signature": 0.7, "raw": 0.4, "normalized": 0.5, "signal": 0.5}
    assert flat.calibrated_thresholds == flat.binary_thresholds and flat.risk_bands["malicious_min"] == 0.7
    missing = config.read_thresholds(spark, f"{tmp_path}/none.json").first()
    assert missing.binary_thresholds["raw"] == 0.5 and missing.generated_at is None
    nested = {"binary_thresholds": {"signature": 0.7}, "validation_metrics": {"signature": {"f1": 1.0}}}
    (tmp_path / "nested.json").write_text(json.dumps(nested, indent=2))
    read = config.read_thresholds(spark, f"{tmp_path}/nested.json").first()
    assert read.binary_thresholds == {"signature": 0.7} and read.validation_metrics["signature"]["f1"] == 1.0
    found = spark.createDataFrame([("raw", 0.55)], "model string, threshold double")
    measured = spark.createDataFrame([("raw", 0.9, 3)], "model string, f1 double, tp long")
    config.write_thresholds(config.config_from_calibration(found, measured, "now"), f"{tmp_path}/out")
    again = config.read_thresholds(spark, f"{tmp_path}/out").first()
    assert again.binary_thresholds["raw"] == 0.55 and again.calibrated_thresholds == {"raw": 0.55}
    assert again.validation_metrics == {"raw": {"f1": 0.9, "tp": 3.0}}
    table = {tuple(r) for r in config.threshold_table(config.default_config(spark)).collect()}
    assert ("signature", 0.7) in table
    assert config.load_thresholds(config.default_config(spark))["signal"] == 0.5


def test_alerts_of_both_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"label":"x","recommendation":"r"}\n{"label":"y","source":"demo"}\n')
    got = {(r.label, r.recommendation, r.source) for r in A.read_alerts(spark, f"{tmp_path}/a.jsonl").collect()}
    assert got == {("x", "r", None), ("y", None, "demo")}


def test_samples_packets_and_results(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "n", "group": "Benign", "log": "GET /", "expected": "benign", "story": ""}]))
    samples = A.read_samples(spark, f"{tmp_path}/s.json")
    assert A.by_group(samples, ["Other"]).count() == 0
    row = scan_samples(samples).first()
    assert (row.sample, row.expected, row.label, row.patterns) == ("n", "benign", "benign", "")
    (tmp_path / "p.tsv").write_text("t\t1.2.3.4\tGET\n")
    packet = logs.read_request_tsv(spark, f"{tmp_path}/p.tsv").first()
    assert (packet.line, packet.frame_time, packet.method, packet.uri) == (1, "t", "GET", "")
    found = detect(spark.createDataFrame([("${jndi:ldap://h/a}",)], "raw_log string"))
    logs.write_scan(found, f"{tmp_path}/scan")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/scan").first()
    assert json.loads(back.detected_patterns) == ["jndi", "ldap", "lookup_syntax"] and json.loads(back.model_scores) == {"signature": 0.95}
    logs.write_scan(found, f"{tmp_path}/scan_pq", "parquet")
    datasets.write_results(found.select("label", "score"), f"{tmp_path}/res")
    assert spark.read.parquet(f"{tmp_path}/scan_pq").count() == 1


def test_stats_document(spark, tmp_path):
    from logtriage.operators.evaluation import dataset_stats

    datasets.write_stats(dataset_stats(dataset(spark)), f"{tmp_path}/stats")
    text = spark.read.text(f"{tmp_path}/stats").first()[0]
    document = json.loads(text)
    assert document["total_rows"] == 4 and document["by_split"] == {"train": 2, "val": 1, "test": 1}
    datasets.write_source_meta(spark.createDataFrame([("s", 1)], "source string, rows int"), f"{tmp_path}/meta")
    assert spark.read.json(f"{tmp_path}/meta").filter(F.col("rows") == 1).count() == 1


def test_rewriting_one_split_keeps_the_others(spark, tmp_path):
    from logtriage.operators.corpus import merge_types
    from logtriage.schema import DATASET_COLUMNS

    def rows(*parts):
        made = [{**{c: c for c in DATASET_COLUMNS}, "id": i, "label": n % 2, "split": s} for n, (i, s) in enumerate(parts)]
        return spark.createDataFrame(made, datasets.DATASET_SCHEMA)

    root = f"{tmp_path}/rows"
    datasets.write_dataset(rows(("a", "train"), ("b", "train"), ("c", "val"), ("d", "test")), root)
    before = {(r.split, r.file) for r in datasets.split_files(spark, root).collect()}
    datasets.rewrite_split(rows(("x", "val"), ("y", "val")), root, "val")
    after = {(r.split, r.file) for r in datasets.split_files(spark, root).collect()}
    assert {f for f in before if f[0] != "val"} == {f for f in after if f[0] != "val"}
    assert not {f for f in before if f[0] == "val"} & after
    assert sorted(r.id for r in datasets.read_split(spark, root, "val").collect()) == ["x", "y"]
    with pytest.raises(Exception, match="not of val"):
        datasets.rewrite_split(rows(("z", "train")), root, "val")
    assert datasets.read_split(spark, root, "train").count() == 2

    types = "obfuscation_type string, description string"
    old = spark.createDataFrame([("a", "old a"), ("b", "old b"), ("n", None)], types)
    new = spark.createDataFrame([("b", "new b"), ("c", "new c"), ("n", None)], types)
    merged = {r.obfuscation_type: r.description for r in merge_types(old, new).collect()}
    assert merged == {"a": "old a", "b": "new b", "c": "new c", "n": None}
