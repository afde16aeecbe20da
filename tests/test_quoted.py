"""Labelled CSV read by blocks: rows over many lines and blocks, headers in any order, rows that do not fit."""

import csv
import io
import random

import pytest

from logtriage.schema import DATASET_COLUMNS
from logtriage.sources.quoted import read_labelled


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "150")
    spark.conf.set(names[1], "0")
    yield
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def row(k, text, label=1):
    return {**{c: f"{c}{k}" for c in DATASET_COLUMNS}, "raw_log": text, "label": label}


def written(rows, columns=DATASET_COLUMNS, **extra):
    out = io.StringIO()
    writer = csv.DictWriter(out, columns, **extra)
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def test_blocks_give_what_one_reader_gives(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    pieces = ["a", '"', ",", "\n", "\r\n", "é", " ", '""', "x" * 60]
    rows = [row(k, "".join(rng.choices(pieces, k=rng.randrange(12))), k % 2) for k in range(120)]
    turned = ["extra", *reversed(DATASET_COLUMNS)]
    (tmp_path / "a.csv").write_text(written(rows[:70]), newline="", encoding="utf-8")
    (tmp_path / "b.csv").write_text(written([{**r, "extra": "e"} for r in rows[70:]], turned), newline="", encoding="utf-8")
    good, bad = read_labelled(spark, str(tmp_path))
    assert bad.count() == 0
    found = {r.id: (r.raw_log, r.label, r.extra) for r in good.collect()}
    assert found == {r["id"]: (r["raw_log"], r["label"], None if k < 70 else "e") for k, r in enumerate(rows)}
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_bad_rows_are_set_aside_with_their_place(spark, tmp_path, small_blocks):
    head, good = written([row(1, "one\ntwo")]).split("\r\n", 1)
    text = f"{head}\r\n{good}only,three,cells\r\n" + written([row(2, "x", "many"), row(3, "y", 0)]).split("\r\n", 1)[1]
    (tmp_path / "a.csv").write_text(text, newline="")
    (tmp_path / "b.csv").write_text(head + "\r\n", newline="")
    good, bad = read_labelled(spark, str(tmp_path))
    assert sorted(r.id for r in good.collect()) == ["id1", "id3"]
    assert [(r.line, r.reason) for r in bad.orderBy("line").collect()] == [(4, "cells"), (5, "label")]


def test_a_quote_that_is_never_closed(spark, tmp_path, small_blocks):
    head, one = written([row(1, "fine")]).split("\r\n", 1)
    lost = "".join(f"line {k}\n" for k in range(50))
    (tmp_path / "a.csv").write_text(f'{head}\n{one}"open,cell\n{lost}', newline="")
    good, bad = read_labelled(spark, str(tmp_path), most_lines=20)
    assert [r.id for r in good.collect()] == ["id1"]
    assert bad.count() == 51 and {r.reason for r in bad.collect()} == {"unclosed quote"}
    assert min(r.line for r in bad.collect()) == 3


def test_a_missing_column_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text(written([row(1, "x")], [c for c in DATASET_COLUMNS if c != "split"], extrasaction="ignore"))
    with pytest.raises(ValueError, match="split"):
        read_labelled(spark, str(tmp_path))


def test_only_rows_over_a_border_are_shuffled(spark, tmp_path):
    """Rows inside a block are put together where they are read; a row of too many lines is never gathered."""
    from logtriage.sources import quoted

    rows = [row(k, f"one {k}\ntwo\n\"three\"" if k % 3 else "\n" * 30, k % 2) for k in range(60)]
    (tmp_path / "a.csv").write_text(written(rows), newline="", encoding="utf-8")
    found, long = quoted._records(quoted._lines(spark, str(tmp_path)), 20)
    assert found.count() == 1 + 40 and long.groupBy("record").count().count() == 20
    lines = quoted._lines(spark, str(tmp_path)).withColumn("odd", quoted._odd(quoted.F.col("text")))
    given = lines.join(quoted.F.broadcast(quoted.block_starts(lines)), ["file", "block"]).toArrow().to_batches()
    parts = [x for b in quoted._joined(20, iter(given)) for x in b.to_pylist()]
    assert {x["whole"] for x in parts if x["text"].startswith("id1,")} == {True}
    assert sum(not x["whole"] for x in parts) == 20 * 31
