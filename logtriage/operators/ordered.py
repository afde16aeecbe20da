"""Order-dependent operators without a single-task sort.

Global numbering and running totals work on range partitions: sort into ranges, checkpoint so that the
ranges stay fixed, total each range, and add the totals of the ranges before it. Every task sees one range.
Numbering shuffles rows once: a row's place in its range is written down before the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.session import cut_lineage

_RANGE = "_lt_range"


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned by ``order`` with its range number; keys must be unique for even ranges."""
    placed = cut_lineage(df.repartitionByRange(*order))
    return placed.withColumn(_RANGE, F.spark_partition_id())


def running_totals(df: DataFrame, group: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Add ``cum_<value>``: the sum of ``value`` over the group's rows up to and including this one.

    ``group`` and ``order`` together identify a row.
    """
    ranged = _ranges(df, [*[F.col(g) for g in group], *order])
    totals = ranged.groupBy(*group, _RANGE).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # One row per range and group present in it: as many rows as there are tasks, plus the groups.
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, _RANGE, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy(*group, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_s_{v}": F.sum(v).over(inside) for v in values})
    joined = summed.join(offsets, [*group, _RANGE])
    return joined.withColumns({f"cum_{v}": F.col(f"_s_{v}") + F.col(f"_o_{v}") for v in values}).drop(
        _RANGE, *[f"_s_{v}" for v in values], *[f"_o_{v}" for v in values]
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", start: int = 1) -> DataFrame:
    """Dense numbers from ``start`` in ``order`` over the whole table. ``order`` must identify a row."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits tell the task, the lower 33 the place in it.
    ranged = placed.withColumns({_RANGE: F.shiftright("_at", 33), "_s": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n"))
    # One row per task of the range sort, so this window and the broadcast are small whatever the table holds.
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = ranged.join(F.broadcast(offsets), _RANGE)
    return numbered.withColumn(name, F.col("_s") + F.col("_o") + F.lit(start)).drop(_RANGE, "_at", "_s", "_o")


def first_distinct(df: DataFrame, col: str, n: int | None, order: Column, keep: list[str] | None = None) -> DataFrame:
    """Distinct values of ``col`` in order of first appearance, the first ``n`` of them (all when None).

    A hash aggregate with map-side combine; the limit becomes a bounded top-n.
    """
    order = order.alias("first_seen")
    firsts = [F.min_by(k, order).alias(k) for k in keep or []]
    seen = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("first_seen"), *firsts)
    return seen if n is None else seen.orderBy("first_seen").limit(n)


def head(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, order: Column, n: int = 50) -> DataFrame:
    """Last ``n`` rows, oldest first."""
    return df.orderBy(order.desc()).limit(n).orderBy(order.asc())


def seeded_key(key: str, seed: int) -> Column:
    """Order key of a seeded shuffle, the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a seeded random order, with their position."""
    return number_rows(df.withColumn("_k", seeded_key(key, seed)), [F.col("_k"), F.col(key)], "position").drop("_k")


def sample_limit(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded random order: the quick-training sample."""
    return df.orderBy(seeded_key(key, seed), F.col(key)).limit(n)


def quick_training_sample(train: DataFrame, val: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``n`` training rows and a quarter as many, at least 32, validation rows."""
    return sample_limit(train, key, n, seed), sample_limit(val, key, max(n // 4, 32), seed)
