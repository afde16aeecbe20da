"""Vector codes: the walk over two trees against plain distances, and whole results against their SQL."""

import numpy as np
import pytest

from logtriage.llm import dual_tree
from logtriage.llm.statements import ORACLES

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n, size, spread", [(1, 1, 9), (5, 3, 2), (400, 16, 1), (3000, 16, 4000), (2000, 7, 30), (500, 256, 3)])
def test_assignment_equals_plain_distances(n, size, spread):
    rng = np.random.default_rng(n + size)
    centres = rng.integers(-1000, 1000, (12, 8))
    points = centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, 8))
    entries = np.concatenate([points[rng.integers(0, n, size - size // 3)], centres[rng.integers(0, 12, size // 3)]])
    points = points[dual_tree.split_order(points, 16)]
    boxes, sums = dual_tree.node_table(points, 16)
    found, count, total, whole = dual_tree.assign(points, boxes, sums, dual_tree.Shelf(entries))
    plain = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (found == plain).all() and (count == np.bincount(plain, minlength=size)).all()
    assert all((total[e] == points[plain == e].sum(axis=0)).all() for e in range(size))
    assert 0 <= whole <= n and (n != 3000 or spread > 100 or whole > n / 2)


def test_nodes_are_assigned_whole_where_data_lie_in_clusters():
    rng = np.random.default_rng(5)
    centres = rng.integers(-9000, 9000, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 41, (4000, 8))
    points = points[dual_tree.split_order(points, 16)]
    boxes, sums = dual_tree.node_table(points, 16)
    assert dual_tree.assign(points, boxes, sums, dual_tree.Shelf(centres))[3] > 2500


def tables():
    rng = np.random.default_rng(3)
    some = lambda n, first, width=16: [
        (first + k, rng.normal(size=width).round(2).tolist(), int(rng.integers(0, 3)) if k % 7 else None) for k in range(n)
    ]
    odd = [(None, [0.5] * 16, 1), (7, None, 1), (8, [], 1), (9, [None] + [0.1] * 15, 1), (10, [NAN] * 16, 2), (11, [-INF] * 16, 2)]
    return {
        "many": some(300, 100) + odd,
        "few": some(5, 0) + odd,
        "equal": [(1, [0.25] * 16, 4)] * 40 + [(2, [0.25] * 16, None)] * 3,
        "repeats": [(k % 3, v, c) for k, v, c in some(60, 0)],
        "one": some(1, 4),
        "wide": some(40, 0, 64),
    }


@pytest.mark.parametrize("name", list(tables()))
def test_equals_sql(spark, duck_over, tmp_path, name, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK_ROWS", 50)
    spark.createDataFrame(tables()[name], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("*", "1 AS x", "2 AS code", "3 AS salt", "4 AS of")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    ours = sorted(map(repr, (tuple(r) for r in dual_tree.compress(table).select(names).collect())))
    assert ours and ours == sorted(map(repr, duck_over(tmp_path).execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op12_vector_codes']})").fetchall()))


def test_nothing_usable(spark):
    for rows in ([], [(1, None, 1), (2, [], 1), (3, [NAN] * 8, None)]):
        assert dual_tree.compress(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_lengths_that_do_not_fit_raise(spark):
    for rows in ([(1, [1.0] * 7, 1)], [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]):
        with pytest.raises(ValueError, match="one length"):
            dual_tree.compress(spark.createDataFrame(rows, SCHEMA))
