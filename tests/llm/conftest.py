import os

import duckdb
import pytest

NAMES = "documents embeddings pages benchmark labels conversations events".split()
#: Names that operators use inside; tables that carry them must not disturb.
CLASHES = "row key n cls start end run template first spans score hit id label row_no text_ vec h _row _lines _all".split()


@pytest.fixture(scope="session")
def duck_over():
    """A DuckDB connection with views over Parquet tables of a folder."""

    def over(folder):
        con = duckdb.connect()
        for name in NAMES:
            path = f"{folder}/{name}.parquet"
            if os.path.exists(path):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        return con

    return over


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns of clashing names on request."""

    def build(rows, clash=False):
        rows = [(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if clash:
            df = df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHES))
        return df.repartition(3)

    return build
