"""The ledger sink: batches that break off or come again, joined batches, totals, windows and last rows over restarts."""

import pytest
from pyspark.sql import functions as F

from logtriage.streaming import ledger as L
from logtriage.streaming.ledger import Ledger

SCHEMA = "id bigint, kind string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in ids], SCHEMA)


def ids(ledger, **options):
    return sorted(r.id for r in ledger.read(SCHEMA, **options).collect())


def test_batches_count_once(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "sink"))
    assert ledger.last() is None and ids(ledger) == [] and not ledger.compact(SCHEMA)
    assert ledger.append(rows(spark, 1, 2), 0)
    with monkeypatch.context() as broken:
        broken.setattr(Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed before the commit")))
        with pytest.raises(OSError, match="killed"):
            ledger.append(rows(spark, 3), 1)
    assert ids(ledger) == [1, 2]
    assert ledger.append(rows(spark, 3), 1) and ids(ledger) == [1, 2, 3]
    assert not ledger.append(rows(spark, 3), 1) and ids(ledger) == [1, 2, 3]
    assert ids(ledger, only=1) == [3]


def test_one_of_two_attempts_commits(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "sink"))
    name = f"{5:019d}"
    rows(spark, 1).write.json(f"{ledger.path}/rows/a")
    rows(spark, 1).write.json(f"{ledger.path}/rows/b")
    assert ledger._commit(name, "a") and not ledger._commit(name, "b")
    assert ids(ledger) == [1] and ledger.sweep() == 1 and ids(ledger) == [1]


def test_joined_batches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "sink"), "parquet")
    for n in range(4):
        ledger.append(rows(spark, n, n + 10), n)
    before = ids(ledger)
    assert ledger.compact(SCHEMA) and ids(ledger) == before and ledger.last() == 3
    assert ledger.holds(2) and not ledger.append(rows(spark, 2), 2)
    assert ledger.append(rows(spark, 99), 4) and ledger.compact(SCHEMA) and ids(ledger) == [*before, 99]
    assert ledger.sweep() == 6 and ids(ledger) == [*before, 99]


def files(spark, folder, *batches):
    for n, own in enumerate(batches):
        spark.createDataFrame(own, "id bigint, at timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{folder}")
    return lambda: spark.readStream.schema("id bigint, at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_totals_windows_and_last_rows_over_restarts(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1)
    own = lambda *minutes: [(m, start + timedelta(minutes=m), "odd" if m % 2 else "even") for m in minutes]
    source, at = f"{tmp_path}/in", lambda name: (f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}")
    for batch in (own(1, 2, 3), own(4, 25), own(26, 500), own(5, 501)):
        stream = files(spark, source, batch)
        L.write_totals(stream(), ["kind"], *at("totals"), available_now=True).awaitTermination()
        L.write_windows(stream(), "at", "10 minutes", "1 hour", ["kind"], *at("windows"), available_now=True).awaitTermination()
        L.write_last(stream(), lambda: [F.desc("id")], 3, *at("last"), available_now=True).awaitTermination()
        L.write_once(stream().select("id", "kind"), *at("once"), available_now=True).awaitTermination()
    totals = L.read_totals(spark, at("totals")[0], "kind string, rows bigint").collect()
    assert {r.kind: r.rows for r in totals} == {"odd": 5, "even": 4}
    last = Ledger(spark, at("last")[0], "parquet")
    assert sorted(r.id for r in last.read("id bigint", only=last.last()).collect()) == [26, 500, 501]
    assert ids(Ledger(spark, at("once")[0])) == [1, 2, 3, 4, 5, 25, 26, 500, 501]
    windows = L.read_windows(spark, at("windows")[0], ["kind"], "kind string").collect()
    found = {(round((r.start - start).total_seconds() / 60), r.kind): r.rows for r in windows}
    # Row 5 came long after row 500 had moved the watermark past its window.
    assert found == {(0, "odd"): 2, (0, "even"): 2, (20, "odd"): 1, (20, "even"): 1, (500, "even"): 1, (500, "odd"): 1}


def test_triggers_are_shared_out(spark, sf, tmp_path):
    """A trigger of the landed lines is classified by several tasks, not read from one file by one."""
    from logtriage.plans import queries as Q

    tasks = []
    found = Q._landed(spark, sf, str(tmp_path)).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
    query = found.foreachBatch(lambda batch, _: tasks.append(batch.rdd.getNumPartitions())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(tasks) == Q.TRIGGERS and min(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
