"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Results hold scalar columns only; lists are joined, so that any engine compares them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.functions import signals as S
from logtriage.functions import signature as G
from logtriage.functions import text as X
from logtriage.functions.html import html_unescape
from logtriage.operators import charlm as LM
from logtriage.operators import corpus as C
from logtriage.operators import epochs as EP
from logtriage.operators import evaluation as E
from logtriage.operators import ingest as I
from logtriage.operators import learned as L
from logtriage.operators import metrics as M
from logtriage.operators import ordered as O
from logtriage.operators.canonical import canonicalize
from logtriage.operators.detect import alerts, detect, final_score, score_map, score_table, signature
from logtriage.operators.features import encode_chars, fit_vocab, signal_array
from logtriage.plans import reports as R
from logtriage.plans import templates as T
from logtriage.plans.request_logs import (
    feed_lines,
    from_events,
    packet_rows,
    page_hosts,
    read_table,
    request_logs,
    scored_logs,
)
from logtriage.schema import DATASET_COLUMNS, SIGNAL_KEYS
from logtriage.session import cut_lineage, new_folder
from logtriage.sources import datasets as D
from logtriage.sources.alerts import alert_rows
from logtriage.sources.follow import follow_logs
from logtriage.sources.logs import non_blank, scan_lines
from logtriage.sources.quoted import read_labelled
from logtriage.streaming.landing import land_growing
from logtriage.streaming.ledger import Ledger, read_totals, read_windows, write_last, write_once, write_totals, write_windows
from logtriage.streaming.monitor import monitored, replay, write_alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = "2026-01-01"
MODELS = ["signature", "raw", "normalized", "signal"]
#: Line shapes rotate with the sample number; twelve samples show all of them.
EXPANSION_SAMPLES = 12
#: Share of the lines of each split and label that a trained model has to get right, held-out splits included.
LEARNED_SHARE = 0.75


def register(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return E.predictions(scored_logs(spark, sf), MODELS)


def narrow_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without texts, computed once for reports that read them several times."""
    return cut_lineage(preds(spark, sf).drop("raw_log", "normalized_log", "source"))


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return E.evaluate(preds(spark, sf), ranking=False)


# -- scans and text functions -------------------------------------------------------------------


@register
def scan_lines_query(spark, sf):
    return non_blank(scan_lines(documents(spark, sf), "text", ["doc_id"]))


@register
def split_filter(spark, sf):
    return request_logs(spark, sf).filter(F.col("split") == "val").select("log_id", "split", "raw_log")


@register
def missing_splits(spark, sf):
    return D.missing_splits(request_logs(spark, sf))


@register
def percent_decode(spark, sf):
    return request_logs(spark, sf).select("log_id", X.percent_decode(F.col("raw_log")).alias("decoded"))


@register
def url_passes(spark, sf):
    found = request_logs(spark, sf).select("log_id", X.percent_decode_n(F.col("raw_log")).alias("r"))
    return found.select("log_id", F.col("r.text").alias("decoded"), F.col("r.passes").alias("passes"))


@register
def html_numeric(spark, sf):
    return request_logs(spark, sf).select("log_id", html_unescape(F.col("raw_log")).alias("decoded"))


@register
def html_pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", html_unescape(F.col("html")).alias("decoded"))


@register
def unicode_unescape(spark, sf):
    return request_logs(spark, sf).select("log_id", X.unicode_unescape(F.col("raw_log")).alias("decoded"))


@register
def resolve_lookups(spark, sf):
    return request_logs(spark, sf).select("log_id", X.resolve_lookups(F.col("raw_log")).alias("resolved"))


@register
def cleanup(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.cleanup(F.col("text")).alias("cleaned"))


@register
def percent_encode(spark, sf):
    return request_logs(spark, sf).select("log_id", X.percent_encode_n(F.col("raw_log"), 2).alias("encoded"))


@register
def percent_u_encode(spark, sf):
    return request_logs(spark, sf).select("log_id", X.percent_u_encode(F.col("raw_log")).alias("encoded"))


@register
def entity_encode(spark, sf):
    return request_logs(spark, sf).select("log_id", X.entity_encode(F.col("raw_log")).alias("encoded"))


@register
def base64(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.base64_text(F.col("text")).alias("encoded"))


# -- canonical form and signals -------------------------------------------------------------------


@register
def canonicalize_query(spark, sf):
    return canonicalize(request_logs(spark, sf)).select(
        "log_id", "normalized_log", joined("detected_patterns").alias("detected_patterns"), "obfuscation_type"
    )


@register
def canonicalize_texts(spark, sf):
    """Whole documents and conversation turns, which hold no lookups."""
    docs = documents(spark, sf).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.lit(0).alias("turn"), "text"
    )
    turns = read_table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("key"), F.col("turn").cast("int").alias("turn"), "text"
    )
    found = canonicalize(docs.unionByName(turns), "text")
    return found.select("kind", "key", "turn", F.md5("normalized_log").alias("normalized_md5"), "obfuscation_type")


@register
def signals(spark, sf):
    return canonicalize(request_logs(spark, sf)).select(
        "log_id", *[F.col(f"signals.{k}").alias(k) for k in SIGNAL_KEYS], joined("detected_patterns").alias("patterns")
    )


@register
def obfuscation_type(spark, sf):
    found = canonicalize(request_logs(spark, sf))
    return found.groupBy("family", "obfuscation_type").agg(F.count(F.lit(1)).alias("rows"))


@register
def signal_vector(spark, sf):
    found = canonicalize(request_logs(spark, sf))
    return found.select("log_id", joined(signal_array().cast("array<int>").cast("array<string>")).alias("vector"))


# -- detection --------------------------------------------------------------------------------------


@register
def signature_matches(spark, sf):
    return signature(request_logs(spark, sf)).select("log_id", joined("matched_patterns").alias("matched"))


@register
def signature_score(spark, sf):
    return signature(request_logs(spark, sf)).select("log_id", "sig_score")


@register
def signature_label(spark, sf):
    found = signature(request_logs(spark, sf))
    at = {f"label_at_{int(t * 100)}": G.signature_label(F.col("sig_score"), t) for t in (0.3, 0.45, 0.7, 0.95)}
    return found.withColumns(at).groupBy("family", *at).agg(F.count(F.lit(1)).alias("rows"))


@register
def risk_bands(spark, sf):
    scored = scored_logs(spark, sf)
    return scored.select(
        "log_id",
        "score_raw",
        G.risk_level(F.col("score_raw")).alias("risk_level"),
        G.label_from_score(F.col("score_raw")).alias("label_band"),
    )


@register
def explain(spark, sf):
    found = detect(request_logs(spark, sf))
    return found.groupBy("family", "label", "explanation").agg(F.count(F.lit(1)).alias("rows"))


@register
def detect_query(spark, sf):
    found = detect(request_logs(spark, sf))
    return found.select(
        "log_id",
        "label",
        "score",
        "risk_level",
        "normalized_log",
        joined("detected_patterns").alias("detected_patterns"),
        "explanation",
        F.col("model_scores")["signature"].alias("signature_score"),
        F.size("model_scores").alias("model_count"),
        "latency_ms",
    )


@register
def detect_by_family(spark, sf):
    """Flagship: lines and average score by family and risk level."""
    found = detect(request_logs(spark, sf))
    return found.groupBy("family", "risk_level").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.avg("score"), 6).alias("avg_score")
    )


@register
def model_fallback(spark, sf):
    """Asked model where it has a score, else the raw-text model, else the signature."""
    scored = scored_logs(spark, sf)
    gone = F.lit(None).cast("double")
    scored = scored.withColumns(
        {
            "score_normalized": F.when(F.col("log_id") % 2 == 0, F.col("score_normalized")).otherwise(gone),
            "score_raw": F.when(F.col("log_id") % 3 == 0, F.col("score_raw")).otherwise(gone),
        }
    )
    scores = {m: F.col(f"score_{m}") for m in ("signature", "raw", "normalized")}
    return scored.select(
        "log_id",
        final_score(scores, "normalized").alias("asked_normalized"),
        final_score(scores, "signal").alias("asked_missing"),
        final_score(scores, "signature").alias("asked_signature"),
        F.size(score_map(scores)).alias("model_count"),
    )


@register
def score_table_query(spark, sf):
    scored = scored_logs(spark, sf)
    scores = {m: F.col(f"score_{m}") for m in MODELS}
    scored = scored.withColumn("model_scores", score_map(scores))
    return score_table(scored, ["log_id"], {"raw": 0.49999999999999994})


@register
def alerts_query(spark, sf):
    found = alert_history(spark, sf).withColumn("status", G.status_tag(F.col("risk_level")))
    shown = alert_rows(found, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), keep=["log_id", "status"])
    return shown.withColumn("detected_patterns", joined("detected_patterns"))


def alert_history(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(detect(request_logs(spark, sf)))


@register
def alert_kpis(spark, sf):
    return R.alert_kpis(alert_history(spark, sf))


@register
def alert_tail(spark, sf):
    found = O.tail(alert_history(spark, sf), F.struct("ts", "log_id"), 50)
    return found.select("log_id", "risk_level", "raw_log")


# -- feeds --------------------------------------------------------------------------------------------


@register
def header_filter(spark, sf):
    found = feed_lines(spark, sf)
    return found.select("line", I.is_header_like(F.col("raw_log")).alias("is_header"))


@register
def request_shape(spark, sf):
    found = feed_lines(spark, sf)
    return found.select("line", I.is_request_shaped(F.col("raw_log")).alias("is_request"))


@register
def flatten_json(spark, sf):
    found = I.candidates(feed_lines(spark, sf))
    return found.select("line", "pos", "candidate")


@register
def extract_token(spark, sf):
    return request_logs(spark, sf).select("log_id", I.extract_token(F.col("raw_log")).alias("token"))


@register
def extract_observation(spark, sf):
    return I.extract_observation(feed_lines(spark, sf)).select("line", "observation")


@register
def import_feed(spark, sf):
    return I.import_feed(feed_lines(spark, sf), I.HONEYPOT_FEED, DAY)


@register
def import_requests(spark, sf):
    return I.import_requests(packet_rows(spark, sf), DAY)


@register
def request_observations(spark, sf):
    return I.request_observations(packet_rows(spark, sf), "line", 40)


@register
def first_distinct(spark, sf):
    return I.first_observations(feed_lines(spark, sf), F.col("line"), 80)


@register
def benign_candidates(spark, sf):
    lines = request_logs(spark, sf)
    return I.benign_candidates(lines, F.col("log_id"), 200).select("candidate", "first_seen")


@register
def indicators(spark, sf):
    lines = scan_lines(read_table(spark, sf, "documents"), "text", ["source", "doc_id"])
    found = I.indicator_preview(lines, F.struct("doc_id", "line"), "source")
    return found.select("source", "rows", joined("indicator_preview").alias("indicator_preview"))


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds: observations of the feed lines, and a feed of benign lines that yields nothing."""
    seen = I.first_observations(feed_lines(spark, sf), F.col("line"), None).select(F.col("observation").alias("raw_log"))
    silent = I.extract_observation(read_table(spark, sf, "conversations"), "text")
    silent = silent.filter(F.col("observation").isNotNull()).select(F.col("observation").alias("raw_log"))

    def rows(name: str) -> DataFrame:
        return spark.createDataFrame([(text,) for text in T.FEED_FALLBACKS[name]], "raw_log string")

    return I.with_fallback(seen, rows("honeypot"), "honeypot").unionByName(
        I.with_fallback(silent, rows("simulation"), "simulation")
    )


@register
def feed_fallback(spark, sf):
    return _feeds(spark, sf)


@register
def source_meta(spark, sf):
    return I.source_meta(_feeds(spark, sf), ["honeypot", "simulation"])


# -- corpus ---------------------------------------------------------------------------------------------


def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.expand_payloads(page_hosts(spark, sf), T.MALICIOUS)
    return C.assign_split(C.contextualize(C.replicate(rows, EXPANSION_SAMPLES)))


def _evasion(spark: SparkSession, sf: str) -> DataFrame:
    hosts = page_hosts(spark, sf)
    train = C.expand_payloads(hosts, T.EVASION_TRAIN).withColumn("split", F.lit("train"))
    test = C.expand_payloads(hosts, T.EVASION_TEST).withColumn("split", F.lit("adversarial_evasion_test"))
    return C.contextualize(C.replicate(train.unionByName(test), EXPANSION_SAMPLES))


def _hard_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.expand_hard_negatives(page_hosts(spark, sf))
    return O.number_rows(rows, [F.col("host_no"), F.col("tpl_no")], "pool_no", start=0)


def _plain_pool(spark: SparkSession) -> DataFrame:
    """Benign template lines of the plain families, numbered from 0."""
    lines = [line for line in T.BENIGN if line[1] in T.PLAIN_BENIGN_FAMILIES]
    rows = [(k, text, family) for k, (text, family) in enumerate(lines)]
    return spark.createDataFrame(rows, "pool_no bigint, raw_log string, family string")


@register
def corpus_expand(spark, sf):
    return _synthetic(spark, sf).select("host_no", "tpl_no", "sample_no", "family", "payload")


@register
def contextualize(spark, sf):
    return _evasion(spark, sf).select("host_no", "tpl_no", "sample_no", "split", "field", "raw_log")


@register
def assign_split(spark, sf):
    return _synthetic(spark, sf).groupBy("family", "split").agg(F.count(F.lit(1)).alias("rows"))


@register
def hard_negatives(spark, sf):
    return C.expand_hard_negatives(page_hosts(spark, sf)).select("host_no", "tpl_no", "family", "raw_log")


@register
def ood_set(spark, sf):
    rows = C.ood_rows(page_hosts(spark, sf), T.OOD_MALICIOUS, T.OOD_BENIGN)
    return rows.select("id", "label", "family", "field", "raw_log")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All sources as rows with a total order (source_no, host_no, tpl_no, sample_no)."""
    synthetic = _synthetic(spark, sf).withColumns({"source": F.lit("synthetic"), "label": F.lit(1)})
    evasion = _evasion(spark, sf).withColumns(
        {"source": F.lit("adversarial_evasion"), "label": F.lit(1), "override": F.col("family")}
    )
    quoted = C.replicate(C.expand_hard_negatives(page_hosts(spark, sf)), 2).withColumns(
        {
            "source": F.lit("hard_negative"),
            "label": F.lit(0),
            "field": F.lit("mixed"),
            "split": C.pick(["train", "hard_negative_test"], F.col("sample_no")),
        }
    )
    tag = F.concat(F.lit("hardneg-"), F.col("split"))
    quoted = quoted.withColumn("raw_log", C.with_trace_id(F.col("raw_log"), tag, F.col("sample_no")))
    plain = C.sample_quota(_plain_pool(spark), T.PLAIN_QUOTAS).select(
        F.col("draw_no").cast("bigint").alias("host_no"), "raw_log", "family", "split"
    )
    plain = plain.withColumns({"source": F.lit("benign_logs"), "label": F.lit(0), "field": F.lit("mixed")})
    blind = spark.createDataFrame(list(enumerate(T.BLIND_LINES)), "host_no bigint, raw_log string")
    blind = blind.withColumns(
        {
            "family": F.lit("blind_manual"),
            "split": F.lit("blind_manual_test"),
            "source": F.lit("blind_manual"),
            "label": F.lit(1),
            "field": F.lit("manual"),
        }
    )
    feed = I.first_observations(feed_lines(spark, sf), F.col("line"), None).select(
        F.col("first_seen").alias("host_no"), F.col("observation").alias("raw_log")
    )
    feed = feed.withColumns(
        {
            "family": F.lit("honeypot"),
            "split": F.lit(I.HONEYPOT_FEED.split),
            "source": F.lit(I.HONEYPOT_FEED.source),
            "label": F.lit(1),
            "field": F.lit(I.HONEYPOT_FEED.field),
        }
    )
    packets = I.request_observations(packet_rows(spark, sf), "line", None).select(
        F.col("first_seen").alias("host_no"), "raw_log"
    )
    packets = packets.withColumns(
        {
            "family": F.lit("packet"),
            "split": F.lit("external_foxit_pcap_test"),
            "source": F.lit("foxit_pcap_http"),
            "label": F.lit(1),
            "field": F.lit("pcap_http"),
        }
    )
    single = {"tpl_no": F.lit(0), "sample_no": F.lit(0)}
    parts = [synthetic, evasion, quoted, *(part.withColumns(single) for part in (plain, blind, feed, packets))]
    # Evasion rows repeat template numbers across their two splits, so the split belongs to the order.
    return C.union_all([part.withColumn("source_no", F.lit(n)) for n, part in enumerate(parts)])


CORPUS_ORDER = ["source_no", "split", "host_no", "tpl_no", "sample_no"]


@register
def records(spark, sf):
    rows = C.assign_ids(_corpus(spark, sf), [F.col(c) for c in CORPUS_ORDER])
    return C.to_records(rows, DAY)


def _corpus_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records without ids, for statistics: no ordering needed."""
    return C.to_records(_corpus(spark, sf).withColumn("id", F.lit("")), DAY)


@register
def corpus_stats(spark, sf):
    return E.dataset_stats(_corpus_records(spark, sf))


@register
def split_matrix(spark, sf):
    return E.split_label_matrix(_corpus(spark, sf))


@register
def top_families(spark, sf):
    return R.top_families(_corpus_records(spark, sf), 14)


@register
def leakage(spark, sf):
    return C.leakage_checked(
        _corpus_records(spark, sf), "train", ["unseen_obfuscation_test", "adversarial_evasion_test"]
    )


@register
def quota_sample(spark, sf):
    rows = C.sample_quota(_hard_pool(spark, sf), T.HARD_NEGATIVE_QUOTAS)
    return rows.select("split", "draw_no", "family", "raw_log")


@register
def hard_negative_set(spark, sf):
    return C.to_records(C.hard_negative_set(_hard_pool(spark, sf)), DAY)


@register
def shuffle(spark, sf):
    return O.shuffle(request_logs(spark, sf), "log_id", 31415).select("log_id", "position")


@register
def sample_limit(spark, sf):
    return O.sample_limit(request_logs(spark, sf), "log_id", 500).select("log_id", "label")


# -- metrics, evaluation and reports ------------------------------------------------------------------


@register
def binary_metrics(spark, sf):
    rows = preds(spark, sf).withColumnRenamed("true_label", "label")
    return M.binary_metrics(rows, ["model", "test_set"], F.col("threshold"))


def _quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels scored by document length, per language: many distinct scores and some ties."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id").select(
        "lang", "label", (F.least(F.col("n_chars"), F.lit(5000)) / F.lit(5000.0)).alias("score")
    )


@register
def roc_auc(spark, sf):
    rows = preds(spark, sf).select("model", F.col("true_label").alias("label"), "score")
    scored = rows.unionByName(_quality_scores(spark, sf).withColumnRenamed("lang", "model"))
    return M.roc_auc(scored, ["model"]).withColumn("roc_auc", F.round("roc_auc", 9))


@register
def avg_precision(spark, sf):
    rows = preds(spark, sf).select("model", F.col("true_label").alias("label"), "score")
    scored = rows.unionByName(_quality_scores(spark, sf).withColumnRenamed("lang", "model"))
    return M.average_precision(scored, ["model"]).withColumn("pr_auc", F.round("pr_auc", 9))


@register
def calibrate(spark, sf):
    rows = preds(spark, sf).select("model", F.col("true_label").alias("label"), "score")
    rows = rows.unionByName(_quality_scores(spark, sf).withColumnRenamed("lang", "model"))
    preferred = F.when(F.col("model") == R.SIGNATURE, F.lit(0.70)).otherwise(F.lit(0.50))
    found = M.calibrate(rows.withColumn("preferred", preferred), ["model", "preferred"], F.col("preferred"))
    return found.withColumn("best_f1", F.round("best_f1", 9))


@register
def evaluate(spark, sf):
    models = [*R.HEATMAP_MODELS, "Attention"]
    table = E.evaluate(preds(spark, sf), models)
    return table.withColumns({"roc_auc": F.round("roc_auc", 9), "pr_auc": F.round("pr_auc", 9)})


@register
def evaluation_warnings(spark, sf):
    return E.unavailable(E.evaluate(preds(spark, sf), [*R.HEATMAP_MODELS, "Attention"], ranking=False))


@register
def error_analysis(spark, sf):
    return E.error_analysis(preds(spark, sf))


@register
def error_counts(spark, sf):
    return E.error_counts(E.error_analysis(preds(spark, sf)))


@register
def first_errors(spark, sf):
    """The first 200 errors by model, split and id."""
    found = E.error_analysis(preds(spark, sf)).select("model", "test_set", "id", "error_type", "score")
    return O.head(found, [F.col("model"), F.col("test_set"), F.col("id")], 200)


@register
def ablation(spark, sf):
    rows = narrow_preds(spark, sf)
    return R.ablation(E.evaluate(rows, ranking=False), E.mismatches(rows))


@register
def family_recall(spark, sf):
    return R.family_recall(preds(spark, sf), "adversarial_evasion_test", R.CHALLENGE_MODELS)


@register
def family_recall_joined(spark, sf):
    # Lines are scored once; both sides of the join read that.
    scored = cut_lineage(scored_logs(spark, sf))
    dataset = scored.select("split", "label", "obfuscation_type")
    errors = E.error_analysis(E.predictions(scored, MODELS))
    return R.family_recall_joined(dataset, errors, "adversarial_evasion_test", R.CHALLENGE_MODELS)


@register
def missed_families(spark, sf):
    return R.missed_families(R.family_recall(preds(spark, sf), "unseen_obfuscation_test", R.HEATMAP_MODELS))


@register
def family_rates(spark, sf):
    return E.family_rates(preds(spark, sf)).withColumn("rate", F.round("rate", 9))


@register
def metric_lookup(spark, sf):
    return R.metric_value(comparison(spark, sf), R.RAW, "ood_stress_test", "f1")


@register
def overview(spark, sf):
    present = cut_lineage(preds(spark, sf).select("model", "test_set").distinct())
    return R.overview_kpis(request_logs(spark, sf), present)


@register
def model_ranking(spark, sf):
    return R.model_ranking(comparison(spark, sf))


@register
def split_counts(spark, sf):
    return R.split_counts(request_logs(spark, sf))


@register
def split_order(spark, sf):
    return R.split_order(preds(spark, sf))


@register
def other_splits(spark, sf):
    return R.other_splits(preds(spark, sf))


@register
def f1_heatmap(spark, sf):
    table = R.f1_heatmap(comparison(spark, sf))
    return table.select("test_set", "place", *[F.col(m).alias(m.lower().replace(" ", "_")) for m in R.HEATMAP_MODELS])


@register
def evasion_pivot(spark, sf):
    return R.evasion_pivot(comparison(spark, sf))


@register
def evasion_duel(spark, sf):
    return R.evasion_duel(comparison(spark, sf))


@register
def ood_view(spark, sf):
    return R.ood_view(comparison(spark, sf))


@register
def challenge_summary(spark, sf):
    return R.challenge_summary(comparison(spark, sf))


# -- features and learned detectors -----------------------------------------------------------------------


@register
def class_weights(spark, sf):
    return M.class_weights(request_logs(spark, sf))


@register
def char_vocab(spark, sf):
    lines = canonicalize(request_logs(spark, sf)).select("raw_log", "normalized_log")
    docs = documents(spark, sf).select(F.col("text").alias("raw_log"), F.lit("").alias("normalized_log"))
    return fit_vocab(lines.unionByName(docs), ["raw_log", "normalized_log"])


@register
def encode_chars_query(spark, sf):
    """Ids under the vocabulary of the training split, so other splits hold unknown characters."""
    logs = request_logs(spark, sf)
    vocab = fit_vocab(logs.filter(F.col("split") == "train"), ["raw_log"])
    encoded = encode_chars(logs, vocab, "raw_log")
    return encoded.select("log_id", F.array_join(F.col("char_ids").cast("array<string>"), ",").alias("ids"))


def _learned(spark: SparkSession, sf: str, variant: str) -> DataFrame:
    # Equal lines have equal features: each counts with its number. Training reads the features many times, so they are computed once.
    lines = request_logs(spark, sf).groupBy("raw_log", "split", "label").agg(F.count(F.lit(1)).alias("rows"))
    table = cut_lineage(L.feature_table(lines))
    known = F.col("split").isin("train", "val")
    model = L.train(table.filter(known), variant, max_iter=10)
    return _shares(L.score(table, model, "score"))


def _shares(scored: DataFrame) -> DataFrame:
    """Lines by split and label, and whether the wanted share of them is on the right side; every split is scored."""
    right = ((F.col("score") >= G.LEARNED_THRESHOLD).cast("int") == F.col("label")).cast("int")
    rows = F.col("rows") if "rows" in scored.columns else F.lit(1)
    counts = scored.groupBy("split", "label").agg(F.sum(rows).alias("rows"), F.sum(right * rows).alias("right"))
    return counts.select("split", "label", "rows", (F.col("right") >= F.col("rows") * LEARNED_SHARE).alias("learned"))


@register
def learned_raw(spark, sf):
    return _learned(spark, sf, "raw")


@register
def learned_normalized(spark, sf):
    return _learned(spark, sf, "normalized")


@register
def learned_signal(spark, sf):
    return _learned(spark, sf, "signal")


def _charlm(spark: SparkSession, sf: str) -> tuple[DataFrame, list[LM.CharModel]]:
    """Lines with canonical text and signals, computed once, and the models of the training split."""
    logs = cut_lineage(LM.with_features(request_logs(spark, sf)))
    train = logs.filter(F.col("split") == "train")
    return logs, [LM.fit(train, variant) for variant in LM.VARIANTS]


def _charlm_totals(spark: SparkSession, sf: str) -> DataFrame:
    logs, models = _charlm(spark, sf)
    parts = [
        LM.totals(logs, model, ["log_id", "split", "label"]).withColumn("model", F.lit(model.variant)) for model in models
    ]
    return C.union_all(parts)


@register
def charlm_scores(spark, sf):
    """Sum of weights of every line under every language model."""
    return _charlm_totals(spark, sf).select("log_id", "model", "total", "n")


@register
def charlm_splits(spark, sf):
    """Lines on the right side of every split and label, trained on one split and scored on all."""
    right = ((F.col("total") >= 0).cast("int") == F.col("label")).cast("int")
    found = _charlm_totals(spark, sf).groupBy("model", "split", "label")
    return found.agg(F.count(F.lit(1)).alias("rows"), F.sum(right).alias("right"))


@register
def charlm_auc(spark, sf):
    """ROC-AUC and average precision by model over all held-out splits, and by model and split where both labels occur."""
    rows = _charlm_totals(spark, sf).where("split NOT IN ('train', 'val')")
    rows = rows.select("model", "split", "label", (F.col("total") / F.col("n")).alias("score"))
    rows = cut_lineage(rows.unionByName(rows.withColumn("split", F.lit("held out"))))
    area = M.roc_auc(rows, ["model", "split"]).withColumn("roc_auc", F.round("roc_auc", 9))
    precision = M.average_precision(rows, ["model", "split"]).withColumn("pr_auc", F.round("pr_auc", 9))
    return area.join(precision, ["model", "split"]).select("model", "split", "roc_auc", "pr_auc")


@register
def charlm_evaluate(spark, sf):
    """Trained scores through the prediction table and the evaluation report."""
    logs, models = _charlm(spark, sf)
    scores = LM.score_columns(logs, models, ["log_id", "split", "label"])
    kept = scores.select(
        F.col("log_id").alias("id"), "split", "label", *[f"score_{v}" for v in LM.VARIANTS],
        *[F.lit(None).cast("string").alias(c) for c in ("raw_log", "normalized_log", "obfuscation_type", "source")],
    )
    return E.evaluate(E.predictions(kept, list(LM.VARIANTS)), ranking=False).drop("roc_auc", "pr_auc", "latency_ms", "throughput_lps")


def _trained_epochs(spark: SparkSession, sf: str) -> tuple[DataFrame, list[EP.Epochs]]:
    # Written by columns: each model's training reads the one text that it needs, and the others' bytes stay unread.
    at = new_folder(spark, "epochs-lines")
    made = LM.with_features(request_logs(spark, sf)).select("log_id", "split", "label", "raw_log", "normalized_log", "signals")
    made.write.parquet(at)
    logs = spark.read.schema(made.schema).parquet(at)
    train, val = (logs.filter(F.col("split") == split) for split in ("train", "val"))
    # No model waits for another: tasks of one take the cores that the last tasks of another's pass leave idle.
    fit = inheritable_thread_target(spark)(lambda variant: EP.fit_epochs(train, val, variant, "log_id"))
    with ThreadPoolExecutor(len(LM.VARIANTS)) as threads:
        return logs, list(threads.map(fit, LM.VARIANTS))


@register
def training_splits(spark, sf):
    """Models trained by epochs with early stopping, on every split."""
    logs, models = _trained_epochs(spark, sf)
    return C.union_all([_shares(EP.score_epochs(logs, m, "score")).withColumn("model", F.lit(m.variant)) for m in models])


@register
def training_history(spark, sf):
    """Bounds on the epochs of each model, whose weights go through a write and a read: losses fall, the least is chosen."""
    logs, models = _trained_epochs(spark, sf)
    found = []
    for model in models:
        path = new_folder(spark, "epochs")
        EP.save_epochs(spark, model, path)
        again = EP.load_epochs(spark, path)
        # Each score of an id is compared with each other one: their ends tell, so no line meets another in a join.
        p = EP.score_epochs(EP.score_epochs(logs, model, "first"), again, "again").where("log_id IS NOT NULL")
        ends = [f(c).alias(f"{k}_{c}") for c in ("first", "again") for k, f in (("least", F.min), ("most", F.max))]
        apart = F.greatest(F.col("most_again") - F.col("least_first"), F.col("most_first") - F.col("least_again"))
        same = p.groupBy("log_id").agg(*ends).agg((F.max(apart) == 0).alias("same")).select("same").scalar()
        losses = EP.history(spark, again)
        first, last = (F.min_by("train_loss", F.col("epoch")), F.max_by("train_loss", F.col("epoch")))
        found.append(
            losses.agg(
                (F.count(F.lit(1)) > 1).alias("several_epochs"),
                (last < first).alias("train_loss_falls"),
                (F.min("val_loss") == F.min(F.when(F.col("chosen"), F.col("val_loss")))).alias("least_is_chosen"),
                F.count_if("chosen").alias("chosen"),
            ).select(F.lit(model.variant).alias("model"), "*", same.alias("same_after_reading"))
        )
    return C.union_all(found)


def _stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Request lines as rows of a labelled dataset."""
    empty = [c for c in DATASET_COLUMNS if c not in ("id", "source", "raw_log", "label", "obfuscation_type", "split")]
    return request_logs(spark, sf).select(
        F.format_string("LS-%09d", "log_id").alias("id"),
        F.concat(F.lit("source "), (F.col("log_id") % 3).cast("string")).alias("source"),
        "raw_log",
        F.col("label").cast("int").alias("label"),
        F.col("family").alias("obfuscation_type"),
        "split",
        *[F.lit("").alias(c) for c in empty],
    )


@register
def split_rewrite(spark, sf):
    """One split of a stored dataset is replaced and its statistics with it; the other splits keep files and statistics."""
    at = new_folder(spark, "split-rewrite")
    rows = _stored_lines(spark, sf)
    D.write_dataset(rows, f"{at}/rows")
    D.write_split_cells(E.stats_cells(rows), f"{at}/cells")
    before = cut_lineage(D.split_files(spark, f"{at}/rows"))
    fresh = rows.where("split = 'ood_stress_test' AND label = 1")
    fresh = fresh.withColumns({"obfuscation_type": F.concat("obfuscation_type", F.lit(" again")), "source": F.lit("again")})
    D.rewrite_split(fresh, f"{at}/rows", "ood_stress_test")
    D.write_split_cells(E.stats_cells(D.read_split(spark, f"{at}/rows", "ood_stress_test")), f"{at}/cells")
    merged = E.stats_of_cells(spark.read.parquet(f"{at}/cells"))
    kept = before.join(D.split_files(spark, f"{at}/rows"), ["split", "file", "rows"])
    untouched = kept.groupBy("split").agg(F.sum("rows").alias("rows"))
    return merged.unionByName(untouched.select(F.lit("files kept").alias("statistic"), F.col("split").alias("value"), "rows"))


@register
def taxonomy_merge(spark, sf):
    """Type descriptions of the training split, merged with those of all splits."""
    types = request_logs(spark, sf).groupBy("split", F.col("family").alias("obfuscation_type")).agg(F.count(F.lit(1)).alias("n"))
    said = lambda df, word: df.groupBy("obfuscation_type").agg(
        F.concat(F.lit(word), F.sum("n").cast("string"), F.lit(" lines")).alias("description")
    )
    return C.merge_types(said(types.where("split <> 'test'"), "before: "), said(types.where("split IN ('train', 'test')"), "now: "))


@register
def labelled_csv(spark, sf):
    """Documents written as labelled CSV with line breaks in cells, every tenth row broken, read by blocks: good and bad rows."""
    at = new_folder(spark, "labelled-csv")
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.coalesce("text", F.lit(""))
    label = F.when(F.col("doc_id") % 20 == 10, F.lit("many")).otherwise((F.col("doc_id") % 2).cast("string"))
    cells = [F.col("doc_id").cast("string"), F.lit("2026"), F.lit("s"), cell(text), F.lit("n"), label, F.lit("f"), F.lit("t"),
             F.lit("x"), F.lit("train"), F.lit("low")]
    row = F.concat_ws(",", *cells)
    row = F.when(F.col("doc_id") % 20 == 0, F.concat(row, F.lit(",more,cells"))).otherwise(row)
    header = F.lit(",".join(DATASET_COLUMNS) + "\n")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(spark, sf).repartition(tasks, "doc_id")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task, which writes one file
    rows.select(F.when(first, F.concat(header, row)).otherwise(row).alias("value")).write.text(at)
    good, bad = read_labelled(spark, at)
    kept = good.select(F.col("id").cast("bigint").alias("doc_id"), "label", F.md5("raw_log").alias("digest"), F.lit("").alias("reason"))
    lost = bad.select(
        F.split("text", ",")[0].cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("label"),
        F.lit(None).cast("string").alias("digest"), "reason",
    )
    return kept.unionByName(lost)


@register
def evaluate_timed(spark, sf):
    """The evaluation of the signature and a trained model with measured times: whether each is filled and fits the other."""
    logs, models = _charlm(spark, sf)
    raw = models[0]
    keys = ["log_id", "split", "label"]
    scorers = {
        R.SIGNATURE: lambda df: signature(df).select(*keys, F.col("sig_score").alias("score_signature")),
        R.RAW: lambda df: LM.score_columns(df, [raw], keys),
    }
    times = E.measured_latency(logs.select(*keys, "raw_log"), scorers)
    scores = scorers[R.SIGNATURE](logs.select(*keys, "raw_log")).join(scorers[R.RAW](logs), keys)
    empty = [F.lit(None).cast("string").alias(c) for c in ("raw_log", "normalized_log", "obfuscation_type", "source")]
    rows = scores.select(F.col("log_id").alias("id"), "split", "label", "score_signature", "score_raw", *empty)
    table = E.evaluate(E.predictions(rows, ["signature", "raw"]), latency_ms=times, ranking=False)
    speed = F.abs(F.col("throughput_lps") * F.col("latency_ms") - 1000) < 1e-6
    return table.select("model", "test_set", "tp", "fp", (F.col("latency_ms") > 0).alias("timed"), speed.alias("fits"))


# -- streaming ----------------------------------------------------------------------------------------------


@register
def stream_detect(spark, sf):
    """Classify a stream of events joined with the page table; the sink is read back."""
    # As a pattern, the path may be one file or a folder of part files; a plain path to one file is refused for streams.
    events = spark.readStream.schema(read_table(spark, sf, "events").schema).parquet(f"{sf}/{{events}}.parquet")
    found = monitored(from_events(events, read_table(spark, sf, "pages")))
    shown = found.select("log_id", "label", "score", "risk_level", "status", "normalized_log")
    out = new_folder(spark, "stream-detect")
    query = (
        shown.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(shown.schema).parquet(f"{out}/rows")


@register
def stream_alerts(spark, sf):
    """Replay the request lines through the monitor and read the alert sink."""
    out = new_folder(spark, "stream-alerts")
    lines = request_logs(spark, sf).select("raw_log")
    replay(lines, f"{out}/lines", f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    from logtriage.sources.alerts import read_alerts

    stored = read_alerts(spark, f"{out}/alerts")
    return stored.groupBy("label", "risk_level", "risk_score").agg(F.count(F.lit(1)).alias("rows"))


#: Appends that the lines of the documents are landed in; they cut lines anywhere.
APPENDS = 3


@register
def stream_follow(spark, sf):
    """Lines of the documents, landed as growing files in three appends and followed by a query that restarts after each."""
    lines = non_blank(scan_lines(documents(spark, sf), "text", ["doc_id"]))
    out = new_folder(spark, "stream-follow")
    for _ in land_growing(lines, ["doc_id", "line"], f"{out}/logs", APPENDS):
        query = (
            follow_logs(spark, f"{out}/logs", startingOffsets="earliest")
            .writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    cells = F.split("raw_log", " ", 3)
    stored = spark.read.schema("file string, start bigint, raw_log string").parquet(f"{out}/rows")
    return stored.select(
        cells[0].cast("bigint").alias("doc_id"), cells[1].cast("int").alias("line"), cells[2].alias("raw_log")
    )


#: Triggers in which streams take the request lines that are landed for them.
TRIGGERS = 3


def _landed(spark: SparkSession, sf: str, out: str) -> DataFrame:
    """Request lines as a stream of ``TRIGGERS`` triggers, with the time of the event they stand for.

    A trigger takes one file for each task: a single file would be classified in one task, however many lines it holds.
    """
    logs = request_logs(spark, sf).select("log_id", "raw_log")
    logs = logs.withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("log_id") % 6000))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs.repartition(TRIGGERS * tasks, "log_id").write.parquet(f"{out}/lines")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", tasks).parquet(f"{out}/lines")
    return alerts(detect(stream))


@register
def stream_ledger(spark, sf):
    """Alerts of a stream through the ledger sink, with one batch broken off and repeated, then joined."""
    out = new_folder(spark, "stream-ledger")
    found = _landed(spark, sf, out).select("log_id", "label", "risk_level", "score")
    ledger = Ledger(spark, f"{out}/alerts")
    schema = found.schema
    # A folder that nothing names stands for a batch that broke off before its commit.
    spark.createDataFrame([(-1, "none", "none", 0.0)], schema).write.json(f"{out}/alerts/rows/0000000000000000000-broken")
    write_once(found, f"{out}/alerts", f"{out}/checkpoint", available_now=True).awaitTermination()
    ledger.append(ledger.read(schema), ledger.last())  # a batch that comes again
    ledger.compact(schema)
    ledger.sweep()
    return ledger.read(schema).groupBy("label", "risk_level", "score").agg(F.count(F.lit(1)).alias("rows"))


@register
def stream_totals(spark, sf):
    """Alert totals, totals by ten minutes and the last 50 alerts, kept by streams over three triggers."""
    out = new_folder(spark, "stream-totals")
    found = _landed(spark, sf, out).select("log_id", "seen_at", "risk_level")
    write_totals(found, ["risk_level"], f"{out}/totals", f"{out}/cp-totals", available_now=True).awaitTermination()
    write_windows(
        found, "seen_at", "10 minutes", "2 hours", ["risk_level"], f"{out}/windows", f"{out}/cp-windows", available_now=True
    ).awaitTermination()
    newest = lambda: [F.col("seen_at").desc(), F.col("log_id").desc()]
    write_last(found, newest, 50, f"{out}/last", f"{out}/cp-last", available_now=True).awaitTermination()
    totals = read_totals(spark, f"{out}/totals", "risk_level string, rows bigint").withColumns(
        {"part": F.lit("total"), "place": F.lit(None).cast("bigint")}
    )
    windows = read_windows(spark, f"{out}/windows", ["risk_level"], "risk_level string").select(
        "risk_level", "rows", F.lit("window").alias("part"), F.unix_timestamp("start").alias("place")
    )
    ledger = Ledger(spark, f"{out}/last", "parquet")
    last = ledger.read(found.schema, only=ledger.last()).select(
        "risk_level", F.lit(1).cast("bigint").alias("rows"), F.lit("last").alias("part"), F.col("log_id").alias("place")
    )
    return totals.unionByName(windows).unionByName(last)
