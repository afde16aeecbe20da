"""Toxicity, exact search, and the operators that SQL can restate."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logtriage.llm import kd_search, line_templates, statements, token_rollups, toxicity, url_templates
from logtriage.llm.queries import QUERIES
from logtriage.session import new_folder


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(statements.ORACLES))
def test_query_equals_sql(spark, sf, duck_over, name):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(duck_over(sf), statements.ORACLES[name])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(found[d].score, y) for d, y in labels.items() if found[d].held_out]
    ones, zeros = ([s for s, y in known if y == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros)
    assert auc > 0.85


def test_counterfactual_pull_clears_group_names():
    rng = random.Random(1)
    filler = [f"wort{k}" for k in range(40)]

    def text(*more):
        return " ".join([*rng.choices(filler, k=12), *more])

    rows = [(text("awful"), 1) for _ in range(60)] + [(text(), 0) for _ in range(120)]
    rows += [(text("muslim", "awful"), 1) for _ in range(60)] + [(text("christian"), 0) for _ in range(60)]
    plain, pulled = (toxicity.fit(rows, pull=p) for p in (0.0, 5.0))
    assert pulled.gap < 0.25 * plain.gap
    neutral = text("muslim")
    assert pulled.score(neutral) < plain.score(neutral) and pulled.score(neutral) < 0.5
    assert pulled.score(text("awful")) > 0.5 > pulled.score(text())


def test_toxicity_cases(spark, docs_of):
    rows = [(k, f"calm words number {k % 7}") for k in range(60)] + [(100 + k, f"vile words number {k % 7}") for k in range(60)]
    rows += [(None, "vile"), (500, None), (501, ""), (502, "vile " * 20000), (1, "calm"), (1, "calm")]
    labels = spark.createDataFrame(
        [(k, None, 0) for k in range(60)] + [(100 + k, None, 1) for k in range(60)] + [(None, None, 1), (502, None, None), (9999, None, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    found = toxicity.toxicity(docs_of(rows, clash=True), labels).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[502].predicted == 1 and by[None].predicted == 1 and by[1].predicted == 0
    assert 0 <= by[500].score == by[501].score < 0.9
    none = toxicity.toxicity(docs_of(rows), labels.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    sample = toxicity.labelled_sample(docs_of(rows), labels, 10)
    assert 0 < len(sample) <= 10 and sample == toxicity.labelled_sample(docs_of(rows), labels, 10)


def brute_top(vectors, asked, k, scale):
    usable = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for q, a in usable:
        if asked(q):
            scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b)]
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def test_search_cases(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 64)
    monkeypatch.setattr(kd_search, "QUERY_ROWS", 8)
    rng = random.Random(6)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(300)]
    vectors += [(1000 + k, [0.5, 0.25, -1.0, 0.0, 2.0]) for k in range(200)]  # one vector many times
    vectors += [(5, None), (6, []), (7, [None, 1.0]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (None, [1.0, 2.0])]
    vectors += [(2000, [1.0, 2.0]), (2001, [3.0, -1.0]), (2010, [9.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, shard string")
    got = kd_search.top_k(df, F.col("vec_id") % 10 == 0, k=10, scale=1024)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, lambda i: i % 10 == 0, 10, 1024)
    assert kd_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_search_of_huge_components(spark):
    vectors = [(k, [float(1 << 40) * k, -1.5]) for k in range(6)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") == 0, k=3, scale=1024).collect())
    assert got == brute_top(vectors, lambda i: i == 0, 3, 1024)
    found = kd_search.top_k(df, F.col("vec_id") == 5, k=3, scale=1024).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3] and found[0].score == (1 << 63) - 1


def test_urls_cases(spark, duck_over, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://x.com/fr/1", "http://x.com/FR/1", "ftp://com/de/a?b#c"]
    urls += ["http://WWW.Example.ORG/es/1", "http://notexample.org/es/1", "http://example.org", "http://example.org/en/12/3"]
    urls += ["http://a.com/x?u=http://b.org/", "http://a.com#f/fr/", "http://éa.com/fr/ü 1", "a://b://c/d", "http://x.net/a/b/c/d/e/7"]
    urls += [f"http://hot.net/{'en' if k % 3 else 'shop'}/{k}" for k in range(300)]
    urls += [f"http://mix.com/{'fr' if k % 2 else 'de'}/{k}/p" for k in range(100)] + [f"http://mix.com/es/{k}" for k in range(9)]
    rows = [(k if k % 50 else None, u, "h", "h2") for k, u in enumerate(urls)] + [(3, urls[5], "h", "h2")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    own = duck_over(str(tmp_path))
    assert rows_of(url_templates.judge_urls(df)) == sql_rows(own, statements.ORACLES["op8_url_templates"])
    assert url_templates.judge_urls(df.limit(0)).count() == 0
    by = {r.page_id: r for r in url_templates.judge_urls(df).collect()}
    assert (by[8].host, by[8].rule, by[8].verdict) == ("www.example.org", "example.org/es/", "block")
    assert by[9].rule == "org/" and by[10].rule is None and by[11].rule == "example.org/en/1"
    tree = url_templates.template_verdicts(
        spark.createDataFrame([("h", "/a/*", 1)] * 30 + [("h", "/b/*", 0)] * 30 + [("h", "/c", None)], "host string, masked string, label int")
    ).collect()
    assert {(r.masked, r.template, r.method) for r in tree} == {("/a/*", "/a/*", "allow"), ("/b/*", "/b/*", "block"), ("/c", "/*", "allow")}


def test_urls_split_below_the_third_segment(spark):
    rows = [("h", "/a/b/c/good/*", 1)] * 30 + [("h", "/a/b/c/bad/*/x", 0)] * 30 + [("h", "/a/b/c/new", None)]
    rows += [("h", f"/a/b/d/k{k}/{'bad' if k % 2 else 'good'}/u{k}/v", 1 - k % 2) for k in range(60)]
    rows += [("h", "/a/b/d/other/bad/u/w", None), ("h", "/a/b/d/k0/" + "/".join("abcdefghij"), None)]
    rows += [("one", "/" + "/".join("s" * k), 1) for k in range(40)]
    df = spark.createDataFrame(rows, "host string, masked string, label int")
    tree = {(r.host, r.masked): (r.template, r.method) for r in url_templates.template_verdicts(df).collect()}
    root = "/*/*/*"
    assert tree["h", "/a/b/c/bad/*/x"][1] == "block" and tree["h", "/a/b/c/good/*"][1] == "allow"
    assert tree["h", "/a/b/d/k1/bad/u1/v"][1] == "block" == tree["h", "/a/b/d/other/bad/u/w"][1]
    assert tree["h", "/a/b/d/k2/good/u2/v"][1] == "allow"
    assert tree["h", "/a/b/c/bad/*/x"][0] == f"{root}/bad/**" and tree["h", "/a/b/c/new"][0] == f"{root}/**"
    assert tree["h", "/a/b/d/k1/bad/u1/v"][0] == f"{root}/**/bad/**"
    assert {t for (h, _), (t, _) in tree.items() if h == "one"} == {"", "/*", "/*/*", root, f"{root}/**"}


def test_lines_cases(spark, docs_of, duck_over, tmp_path):
    rng = random.Random(9)
    words = [f"wort{c}" for c in "abcdefghijklmnop"]
    boiler = " ".join(words[:10])
    rows = []
    for k in range(40):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(3)]
        if k % 2:
            lines.insert(1, f"Read {k} times on day {k * 7} by user{k}")
        if k % 3:
            lines += ["", boiler if k % 4 else boiler.replace("wortc", f"x{chr(97 + k % 20)}y")]
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one\r\ntab\tx"), (104, boiler), (104, boiler), (105, ("z " * 9 + "\n") * 3000)]
    df = docs_of(rows, clash=True)
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = sql_rows(duck_over(str(tmp_path)), statements.ORACLES["op9_line_dedup"])
    assert rows_of(line_templates.line_digest(df)) == want
    assert any(r[2] for r in want[1])
    kept = line_templates.drop_recurring(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    by = {r.doc_id: r for r in kept.collect()}
    assert by[100].text is None and by[105].text == rows[-1][1] and by[105].n_chars == len(rows[-1][1])
    assert "times on day" in by[1].text and "times on day" not in by[3].text and by[3].n_chars == len(by[3].text)
    assert line_templates.drop_recurring(df.limit(0)).count() == 0


def test_null_ids_keep_lines_first(spark, docs_of):
    rows = [(None, "same old line"), *((k, "same old line") for k in range(6))]
    kept = {r.doc_id: r.text for r in line_templates.drop_recurring(docs_of(rows)).collect()}
    assert kept == {None: "same old line"} | dict.fromkeys(range(6), "")


def change(spark, rows):
    return spark.createDataFrame(
        rows, "op string, doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint"
    ).withColumn("live", F.lit("x"))


def test_rollup(spark):
    rollup = token_rollups.TokenRollup(spark, new_folder(spark, "rollup-test"))
    totals = lambda: {tuple(r) for r in rollup.totals().collect()}
    assert totals() == set()
    first = change(spark, [("insert", 1, "a", "s", "en", 10), ("insert", 2, "a", "s", None, 5), ("insert", None, "a", None, None, None)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert totals() == {("s", "en", "a", 1, 10), ("s", None, "a", 1, 5), (None, None, "a", 1, 0)}
    assert rollup.commit("b2", change(spark, [("revise", 1, "a", "t", "en", 12), ("insert", 1, "b", "s", "en", 3), ("insert", 1, "b", "s", "en", 3)]))
    assert totals() == {("t", "en", "a", 1, 12), ("s", "en", "b", 1, 3), ("s", None, "a", 1, 5), (None, None, "a", 1, 0)}
    assert rollup.commit("b3", change(spark, [("delete", 1, None, None, None, None), ("delete", 77, "a", None, None, None)]))
    assert rollup.commit("b4", change(spark, []))
    assert totals() == {("s", None, "a", 1, 5), (None, None, "a", 1, 0)}
    # A batch that broke off before its deltas were complete leaves no trace, and its rerun counts once.
    half = change(spark, [("insert", 3, "a", "s", "en", 7), ("delete", None, "a", None, None, None)])
    half.limit(0).select("doc_id").write.parquet(f"{rollup.path}/ledger/4-b5")
    assert len(totals()) == 2
    assert rollup.commit("b5", half)
    assert totals() == {("s", None, "a", 1, 5), ("s", "en", "a", 1, 7)}
    assert rollup.commit("b6", change(spark, [("insert", 2, "a", "s", None, 1), ("delete", 2, "a", None, None, None)]))
    assert totals() == {("s", "en", "a", 1, 7)}


def test_rollup_counts_every_row(spark, duck_over, tmp_path):
    """Null and repeated ids, equal rows, labels for some of them."""
    texts = ["a b, 1 2", "a b, 1 2", "c d!", None, "", "x 9 y"]
    ids = [1, 1, 2, None, None, 3, 3, 3, 4, None]
    rows = [(d, texts[k % 6], "s" if k % 3 else None, "en") for k, d in enumerate(ids * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = token_rollups.corpus_rollup(docs, labels, new_folder(spark, "rollup-rows"))
    assert rows_of(got) == sql_rows(duck_over(str(tmp_path)), statements.ORACLES["op10_token_rollups"])
    assert got.where("tokenizer = 'marks'").agg(F.sum("n_docs")).first()[0] == 27
