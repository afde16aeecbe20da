"""Registered queries against their SQL at the smallest scale."""

import json
import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from logtriage.plans.queries import QUERIES
from oracle.statements import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "scan_lines",
    "canonicalize_texts",
    "detect",
    "alerts",
    "score_table",
    "extract_observation",
    "feed_fallback",
    "records",
    "quota_sample",
    "evaluate",
    "calibrate",
    "ablation",
    "family_recall_joined",
    "encode_chars",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(shown(row[names.index(c)]) for c in cols) for row in found.fetchall())
    ours = sorted(tuple(shown(row[c]) for c in cols) for row in df.collect())
    assert ours == theirs


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["family", "risk_level", "lines", "avg_score"] and df.count() > 12


def test_detection_plans_shuffle_only_where_stated(spark, sf):
    for name, exchanges in (("canonicalize", 1), ("detect", 1)):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        # The fixture spreads its small file; the detector itself adds no exchange.
        assert plan.count("Exchange") <= exchanges, plan


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_library_without_the_corpus_operators(tmp_path, gone):
    root = pathlib.Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *gone))
    told = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", told], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    queries, sql = json.loads(done.stdout)
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(sql) and "pipeline" not in queries
    if "llm" in gone:
        assert set(queries) == set(QUERIES)


def test_a_pipeline_of_another_folder_is_not_taken(tmp_path):
    root = pathlib.Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "corpus_pipeline.py"))
    told = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    env = os.environ | {"PYTHONPATH": str(root)}
    done = subprocess.run([sys.executable, "-c", told], cwd=copy, env=env, capture_output=True, text=True, timeout=120, check=True)
    queries = json.loads(done.stdout)
    assert "pipeline" not in queries and "op2_suffix_dedup" in queries
