"""Source divergence audit against its SQL, with digests of several terms, small blocks and odd rows."""

import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from logtriage.llm import divergence
from logtriage.llm.statements import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Été", "ÉTÉ", "straße", "日本", "a b"]
    found = []
    for k in range(120):
        text = " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(40)))
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        found.append((k % 50 or None, rng.choice([text, text.upper(), text.replace(" ", "_9")]), lang, f"s{rng.randrange(7)}"))
    found += [(1, None, "en", "silent"), (2, "", "en", "silent"), (3, "only once", "xx", "a"), (4, "", "xx", "b")]
    found += [(5, "same same", "yy", s) for s in ("b", "a", None) for _ in range(3)] + [(6, "x" * 100_000, "en", "s1")]
    found += [(7, "alone alone", "zz", "one")] * 4
    return [(d, t, lang, s, None) for d, t, lang, s in found]


def compared(spark, duck_over, folder, data, **options):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    df.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS digest", "2 AS term", "3 AS n", "4 AS p0")
    ours = sorted(map(tuple, divergence.source_divergence(docs, **options).collect()))
    names = "lang, source, part, item, value, rank"
    sql = f"SELECT {names} FROM ({ORACLES['op13_source_divergence']})"
    assert ours == sorted(duck_over(folder).execute(sql).fetchall())
    return ours


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_equals_sql(spark, duck_over, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 150)
    monkeypatch.setattr(divergence, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(divergence, "HELD_TERMS", 60)
    found = compared(spark, duck_over, tmp_path, rows(bits), bits=bits)
    assert {r[2] for r in found} == {"pair", "term"} and {r[0] for r in found} == {"", "en", "fr", "xx", "yy"}
    assert [r[3:] for r in found if r[:3] == ("xx", "a", "pair")] == [("b", 0, 1)]


def test_only_the_first_ranks_and_ties_by_text(spark, duck_over, tmp_path):
    words = [f"{a}{b}{c}" for a in "zyx" for b in "qponmlk" for c in "abcdefghijklmn"]
    data = [(k, " ".join(words), "en", "all", None) for k in range(4)] + [(9, "other words", "en", "few", None)] * 3
    found = [r for r in compared(spark, duck_over, tmp_path, data) if r[1:3] == ("all", "term")]
    assert [r[3] for r in sorted(found, key=lambda r: r[5])] == sorted(words)[:200]


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_of_texts_cut_into_pieces(monkeypatch):
    """A long text is digested in pieces that cut no term, in one document's count; terms of one digest are told apart."""
    monkeypatch.setattr(divergence, "CHUNK", 40)
    rng = random.Random(5)
    words = [f"w{'abc'[k % 3] * (k // 3)}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=n)).encode() for n in (60, 0, 3, 1, 200)]
    batch = pa.table({"l": ["en"] * 5, "s": ["x"] * 5, "t": [t.decode() for t in texts]}).to_batches()[0]
    for bits in (64, 2):
        found = pa.Table.from_batches(divergence._counted(bits)(iter([batch]))).to_pylist()
        told = {(r["digest"], r["term"]) for r in found if r["n"] is None}
        assert {t for _, t in told} == {w.decode() for t in texts for w in t.split()}
        assert sum(r["n"] or 0 for r in found) == sum(len(t.split()) for t in texts)
        if bits == 64:
            names = dict(told)
            n = {names[r["digest"]]: (r["n"], r["docs"]) for r in found if r["n"]}
            assert n == {w.decode(): (sum(t.split().count(w) for t in texts), sum(w in t.split() for t in texts)) for t in texts for w in t.split()}


def test_counts_of_several_merges(monkeypatch):
    """Counts that are merged again and again, and written when too many are held, add up to those of all texts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(6))) for _ in range(200)]
    rows = pa.table({"l": ["en", "fr"] * 100, "s": ["x", "y", "y", "x"] * 50, "t": texts})
    monkeypatch.setattr(divergence, "CHUNK", 10)
    monkeypatch.setattr(divergence, "WRITTEN_ROWS", 3)
    for held in (12, 10_000):
        monkeypatch.setattr(divergence, "HELD_TERMS", held)
        found = pa.Table.from_batches(divergence._counted(64)(iter(rows.to_batches(70)))).to_pylist()
        names = {r["digest"]: r["term"] for r in found if r["n"] is None}
        total = {}
        for r in found:
            if r["n"]:
                key = (r["lang"], r["source"], names[r["digest"]])
                total[key] = [a + b for a, b in zip(total.get(key, (0, 0)), (r["n"], r["docs"]), strict=True)]
        expected = {}
        for r in rows.to_pylist():
            for word in set(r["t"].split()):
                key = (r["l"], r["s"], word)
                expected[key] = [a + b for a, b in zip(expected.get(key, (0, 0)), (r["t"].split().count(word), 1), strict=True)]
        assert total == expected


KEEPS = """
import re, sys
import numpy as np, pyarrow as pa
from logtriage.llm import divergence

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = np.random.default_rng(1)
    for _ in range(10):
        words = rng.integers(0, 1_000_000, (700, 200)) + 10_000_000
        texts = ["w" + " w".join(map(str, row)) for row in words]
        texts = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]
        yield pa.record_batch([["en"] * 700, ["s"] * 700, texts], ["l", "s", "t"])

start, rows = mb(), 0
for batch in divergence._counted(64)(batches()):
    rows += batch.num_rows
del batch
print(rows, round(mb() - start))
"""


def test_an_idle_worker_keeps_little_memory():
    """Python workers outlive their tasks, so what a task leaves behind stands beside the executor's heap from then on."""
    root = Path(divergence.__file__).parents[2]
    said = subprocess.run([sys.executable, "-c", KEEPS], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 1_500_000 and int(said[1]) < 150
