"""Following growing files: appended bytes, half lines, rotation and restarts give every line exactly once."""

import os
import random
import shutil

import pytest

from logtriage.sources import follow as F
from logtriage.sources.follow import GrowingReader, follow_logs


def put(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


class Follower:
    """A reader as Spark drives it: plan, read, remember the position."""

    def __init__(self, folder, **options):
        self.options = {"path": str(folder), "startingOffsets": "earliest", **options}
        self.at = self.reader().initialOffset()
        self.seen = []

    def reader(self):
        return GrowingReader(self.options)  # a new one each time, as after a restart

    def poll(self, between=lambda: None):
        reader = self.reader()
        end = reader.latestOffset()
        parts = reader.partitions(self.at, end)
        between()
        found = [text for part in parts for batch in self.reader().read(part) for text in batch.column(2).to_pylist()]
        self.at = end
        self.seen += found
        return sorted(found)


@pytest.mark.parametrize("seed", range(12))
def test_appends_cut_anywhere(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(F, "_BATCH", rng.choice([7, 50, 1 << 20]))
    monkeypatch.setattr(F, "_STEP", rng.choice([3, 64, 1 << 16]))
    lines = [bytes(rng.choices(b"abc\xff \xc3\xa9", k=rng.randrange(40))) for _ in range(80)]
    data = b"".join(x + b"\n" for x in lines)
    follower, at = Follower(tmp_path, blockBytes=str(rng.choice([1, 9, 1000]))), 0
    while at < len(data):
        step = rng.randrange(1, 150)
        put(tmp_path / "a.log", data[at : at + step])
        at += step
        follower.poll()
    assert sorted(follower.seen) == sorted(x.decode("utf-8", "replace") for x in lines)


def test_half_line_waits_for_its_end(tmp_path):
    follower = Follower(tmp_path)
    put(tmp_path / "a.log", b"one\ntw")
    assert follower.poll() == ["one"]
    assert follower.poll() == []
    put(tmp_path / "a.log", b"o\r\n\nthree")
    assert follower.poll() == ["", "two"]


def test_rotation_by_rename(tmp_path):
    follower = Follower(tmp_path)
    put(tmp_path / "a.log", b"first line\nsecond\n")
    assert follower.poll() == ["first line", "second"]
    put(tmp_path / "a.log", b"third\nlast without feed")
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    put(tmp_path / "a.log", b"a new file\n")
    assert follower.poll() == ["a new file", "last without feed", "third"]
    os.rename(tmp_path / "a.log.1", tmp_path / "a.log.2")
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    assert follower.poll() == []


def test_rotation_by_copy_and_truncate(tmp_path):
    follower = Follower(tmp_path)
    put(tmp_path / "a.log", b"x" * 2000 + b"\nsecond\n")
    assert len(follower.poll()) == 2
    put(tmp_path / "a.log", b"third\n")
    shutil.copy(tmp_path / "a.log", tmp_path / "a.log.1")
    put(tmp_path / "a.log", b"y\n", "wb")
    assert follower.poll() == ["third", "y"]


def test_renamed_between_plan_and_read(tmp_path):
    follower = Follower(tmp_path)
    put(tmp_path / "a.log", b"one\ntwo\n")

    def rotate():
        os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
        put(tmp_path / "a.log", b"new\n")

    assert follower.poll(rotate) == ["one", "two"]
    assert follower.poll() == ["new"]
    put(tmp_path / "a.log", b"more\n")
    with pytest.raises(FileNotFoundError, match="is gone"):
        follower.poll(lambda: os.remove(tmp_path / "a.log"))


def test_one_file_and_start_at_its_end(tmp_path):
    put(tmp_path / "a.log", b"backlog\nhalf")
    put(tmp_path / "other.log", b"not followed\n")
    follower = Follower(tmp_path / "a.log", startingOffsets="latest")
    assert follower.poll() == []
    put(tmp_path / "a.log", b" line\nnew\n")
    put(tmp_path / "other.log", b"still not\n")
    assert follower.poll() == ["half line", "new"]
    assert Follower(tmp_path / "nowhere").poll() == []


def test_query_restarts_over_rotations(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()

    def run():
        query = follow_logs(spark, str(logs), startingOffsets="earliest").writeStream.format("parquet")
        query = query.option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.raw_log for r in spark.read.parquet(f"{out}/rows").collect())

    put(logs / "a.log", b"1\n2\n3 ha")
    assert run() == ["1", "2"]
    put(logs / "a.log", b"lf\n")
    put(logs / "b.log", b"b1\n")
    assert run() == ["1", "2", "3 half", "b1"]
    os.rename(logs / "a.log", logs / "a.log.1")
    put(logs / "a.log.1", b"4\n")
    put(logs / "a.log", b"5\n")
    assert run() == ["1", "2", "3 half", "4", "5", "b1"]
    assert run() == ["1", "2", "3 half", "4", "5", "b1"]


def test_lines_are_computed_once_for_all_appends(spark, tmp_path):
    """Files that grow are copied from lines that were written once: rows that tie must not change places between appends."""
    from pyspark.sql import functions as S

    from logtriage.streaming.landing import land_growing

    computed = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            computed.add(part.num_rows)
            yield part

    lines = spark.range(300).select((S.col("id") % 7).alias("k"), S.concat(S.lit("é line "), S.col("id")).alias("raw_log"))
    before, sizes = {}, []
    for _ in land_growing(lines.mapInArrow(counted, lines.schema), ["k"], str(tmp_path / "logs"), 3):
        now = {p.name: p.read_bytes() for p in (tmp_path / "logs").iterdir()}
        assert all(now[name].startswith(data) for name, data in before.items())
        before = now
        sizes.append(sum(map(len, now.values())))
    assert computed.value == 300
    assert sizes[0] < sizes[1] < sizes[2]
    found = b"".join(before.values()).decode().splitlines()
    assert sorted(found) == sorted(f"{k % 7} é line {k}" for k in range(300))


def test_blank_lines_of_all_kinds(spark):
    from logtriage.sources.logs import non_blank

    texts = ["", " ", "\t  ", "​", " x ", "x\n", "\n", "\x1c\x85", None]
    found = non_blank(spark.createDataFrame([(t,) for t in texts], "raw_log string"))
    assert [r.raw_log for r in found.collect()] == [t for t in texts if t and t.strip()]
