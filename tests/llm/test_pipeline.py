"""The stages of the pipeline, each against a plain version of what it stands for."""

import corpus_pipeline
import __spark_entry__ as entry
from logtriage.llm import decontam, line_templates, near_dups, toxicity
from logtriage.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        found = stored(stage(spark, docs, sf), "stage")
        after = {r.doc_id: r for r in found.collect()}
        assert found.schema == schema and after.keys() <= before.keys() and found.count() == len(after)
        if name == "line dedup":
            assert after.keys() == before.keys()
            plain = {r.doc_id: r.n_dropped for r in line_templates.line_digest(docs).collect()}
            assert {d for d, r in after.items() if r.text != before[d].text} == {d for d, n in plain.items() if n}
        else:
            assert all(after[d] == before[d] for d in after)
        if name == "toxicity":
            judged = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert after.keys() == {r.doc_id for r in judged if not r.predicted}
        if name == "near-duplicates":
            groups = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, 5, 80).collect()}
            assert after.keys() == set(groups.values())
        if name == "decontamination":
            hits = decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
            assert after.keys() == before.keys() - {r.doc_id for r in hits}
        docs = found
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_stages_decide_for_rows(spark, sf, docs_of, tmp_path):
    """Null and repeated ids: what a row is decides, not what another row of its id is."""
    left = lambda stage, df, at: sorted(((r.doc_id, r.text) for r in stage(spark, df, at).collect()), key=repr)
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(7, a), (7, a), (None, b), (None, b), (None, c), (3, "d " * 9), (None, "d " * 9), (5, ""), (5, ""), (7, c + " z")]
    want = sorted([(7, a), (None, b), (7, c + " z"), (3, "d " * 9), (5, ""), (5, "")], key=repr)
    assert left(corpus_pipeline.keep_one_of_each, docs_of(rows), sf) == want

    spark.createDataFrame([(1, a)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, b), (None, f"x {a}"), (None, c), (None, None), (2, f"{a} y"), (2, f"{a} y")]
    want = sorted([(1, b), (None, c), (None, None)], key=repr)
    assert left(corpus_pipeline.drop_contaminated, docs_of(rows), str(tmp_path)) == want

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).select("doc_id", "predicted")
    of = {p: judged.where(f"predicted = {p}").join(docs, "doc_id").first().text for p in (0, 1)}
    added = [(i, of[p]) for i in (None, None, 1 << 40, 1 << 40) for p in (0, 1)]
    found = left(corpus_pipeline.reject_toxic, docs.unionByName(docs_of(added).select(docs.columns)), sf)
    assert [r for r in found if r[0] in (None, 1 << 40)] == sorted([r for r in added if r[1] == of[0]], key=repr)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [s for s, _ in corpus_pipeline.STAGES][0] == "toxicity" and corpus_pipeline.ORACLE_SQL is None


CLASHES = "id row key row_key row_key_1 _row_key _metadata file cls n place label hit doc_id_1 root kept gone".split()


def odd_rows():
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    return [(1, a), (None, a), (None, None), (2, ""), (2, ""), (3, b), (3, b), (4, " \n \n"), (5, "long " * 60_000), (6, b + " z")]


def test_stages_keep_clashing_columns(spark, sf, docs_of, tmp_path):
    plain = docs_of(odd_rows())
    wide = plain.selectExpr("*", *(f"concat('{c}', coalesce(doc_id, 0)) AS {c}" for c in CLASHES))
    wide.write.parquet(f"{tmp_path}/wide")
    for docs in (wide, spark.read.parquet(f"{tmp_path}/wide")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, sf)
            assert found.columns == wide.columns, name
            rows = found.collect()
            assert all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in CLASHES), name
            bare = stage(spark, docs.select(plain.columns), sf)
            assert sorted(map(repr, (r[:2] for r in rows))) == sorted(map(repr, (r[:2] for r in bare.collect()))), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > len(odd_rows())


def test_stages_on_empty_tables(spark, sf, docs_of, tmp_path):
    empty = docs_of([])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for at in (sf, str(tmp_path)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, at).count() == 0
    rows = docs_of(odd_rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, str(tmp_path)).count()
        assert found == (5 + 2 if name == "near-duplicates" else len(odd_rows())), name


def test_run_drops_what_it_wrote(spark, sf, monkeypatch):
    dropped = []
    monkeypatch.setattr(corpus_pipeline, "drop_stored", lambda df: dropped.append(df.stored_at))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(set(dropped)) == len(corpus_pipeline.STAGES) - 2
