"""Training by epochs with early stopping: distributed gradient steps, validation after each epoch, the best one kept.

Lines are binary features: hashed trigrams of their characters and, for the ``signal`` variant, the signals that are set. In an
epoch every task runs stochastic gradient steps over its own lines from the same weights; the tasks' weights are averaged by
their number of lines, in Spark. The loss of the training and the validation split is measured under the averaged
weights, in the pass that takes the steps of the next epoch. Training stops when ``patience`` epochs have brought no lower validation loss; the weights of the best epoch are returned.

The driver holds weights, whose number ``bits`` bounds, never lines. Lines stay in the partitions that they are dealt to by their
key, in its order, so a repeated or lost task takes the same steps. Their features are hashed once, in that partition, and kept
as packed record batches in cells of at most ``CELL`` bytes: a pass reads bytes, not one array a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.operators.charlm import ORDER, VARIANTS, trigram_keys
from logtriage.schema import SIGNAL_KEYS
from logtriage.session import cut_lineage

BITS = 14
#: Lines of one gradient step.
STEP_ROWS = 32
#: Bytes of a cell; Spark hands a task at most 10,000 of them at once.
CELL = 1 << 12
#: Places in the order of the counts of lines: validation and training, each with label 0 and 1.
COUNTS = ("val_0", "val_1", "train_0", "train_1")


@dataclass
class Epochs:
    """Weights of the best epoch (the bias last), and the losses of all epochs."""

    variant: str
    weights: np.ndarray
    best: int
    history: list[tuple[int, float, float]] = field(default_factory=list)


def _inputs(variant: str) -> list[Column]:
    """The text that is hashed, and the signals that are set as bits: none but in the ``signal`` variant."""
    text = F.make_valid_utf8(F.coalesce(F.col(VARIANTS[variant]), F.lit("")))
    told = F.lit(0)
    if variant == "signal":
        for k, key in enumerate(SIGNAL_KEYS):
            told += F.when(F.col(f"signals.{key}"), F.lit(1 << k)).otherwise(F.lit(0))
    return [text.alias("text"), told.alias("told")]


def _places(texts: pa.Array, told: pa.Array, bits: int) -> pa.Array:
    """Distinct places of every line's features, ascending: its signals, then its hashed trigrams from thirteen on."""
    kind = np.min_scalar_type((1 << bits) - 1)
    if not len(texts):
        return pa.array([], pa.list_(pa.from_numpy_dtype(kind)))
    keys, own = trigram_keys(texts)
    keys = keys[np.arange(own.sum()) + np.repeat(np.arange(len(own)) * (ORDER - 1), own)].astype(np.uint64)
    keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    hashed = ((keys >> np.uint64(32)) % np.uint64((1 << bits) - len(SIGNAL_KEYS))).astype(np.int64) + len(SIGNAL_KEYS)
    set_ = told.to_numpy(zero_copy_only=False)
    line, signal = np.nonzero(set_[:, None] >> np.arange(len(SIGNAL_KEYS)) & 1) if set_.any() else (set_[:0], set_[:0])
    # ``np.unique`` puts integers into a hash table, which takes far longer than a sort.
    found = np.sort(np.concatenate([np.repeat(np.arange(len(own)), own) << 32 | hashed, line.astype(np.int64) << 32 | signal]))
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    ends = np.concatenate([[0], np.cumsum(np.bincount(found >> 32, minlength=len(own)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((found & 0xFFFFFFFF).astype(kind)))


def feature_ids(variant: str, bits: int = BITS) -> Column:
    """Distinct places of a line's features; signals take the first thirteen. Trigrams are cut and hashed a batch at a time."""

    def placed(texts: pa.Array, told: pa.Array) -> pa.Array:
        return _places(texts, told, bits).cast(pa.list_(pa.int32()))

    placed.__annotations__ = {"texts": pa.Array, "told": pa.Array, "return": pa.Array}
    return F.arrow_udf(placed, "array<int>")(*_inputs(variant))


def _lines_schema(bits: int) -> pa.Schema:
    kind = pa.from_numpy_dtype(np.min_scalar_type((1 << bits) - 1))
    return pa.schema([("is_train", pa.bool_()), ("label", pa.int8()), ("ids", pa.list_(kind))])


def _packed(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their features as messages of Arrow, cut into cells; the last cell of each says what lines it held."""
    schema = _lines_schema(bits)
    for batch in batches:
        if not len(batch):
            continue
        is_train, label = batch.column("is_train"), batch.column("label").cast(pa.int8())
        ids = _places(batch.column("text"), batch.column("told"), bits)
        message = pa.RecordBatch.from_arrays([is_train, label, ids], schema=schema).serialize()
        cells = [message.slice(at, min(CELL, message.size - at)).to_pybytes() for at in range(0, message.size, CELL)]
        held = np.bincount(is_train.to_numpy(zero_copy_only=False) * 2 + label.to_numpy(), minlength=len(COUNTS))
        empty = [0] * (len(cells) - 1)
        columns = [pa.array(cells, pa.binary()), pa.array([*[False] * len(empty), True])]
        yield pa.RecordBatch.from_arrays(
            [*columns, *[pa.array([*empty, n], pa.int64()) for n in held.tolist()]], ["cell", "last", *COUNTS]
        )


def _unpacked(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The record batches that were packed, in their order."""
    schema, parts = _lines_schema(bits), []
    for batch in batches:
        for cell, last in zip(batch.column("cell"), batch.column("last").to_pylist()):
            parts.append(cell.as_py())
            if last:
                yield pa.ipc.read_record_batch(pa.py_buffer(b"".join(parts)), schema)
                parts = []


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and features as one array with the borders of the lines."""
    ids = batch.column("ids")
    return batch.column("label").to_numpy().astype(float), ids.flatten().to_numpy(), ids.offsets.to_numpy()


def _roots(ends: np.ndarray) -> np.ndarray:
    """Binary features of lines of different length are scaled, so that a long line does not saturate."""
    return np.sqrt(np.maximum(np.diff(ends), 1))


def _logits(weights: np.ndarray, flat: np.ndarray, begins: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Every line has a feature, the trigram of its end mark at least, so no two lines begin at one place."""
    return np.add.reduceat(weights[flat], begins) / roots + weights[-1] if len(begins) else np.zeros(0)


def _step_batch(own: np.ndarray, balance: tuple[float, float], rate: float, ridge: float, batch: pa.RecordBatch) -> None:
    y, flat, ends = _columns(batch)
    ends, keep = ends - ends[0], 1 - rate * ridge
    sizes, roots, weight = np.diff(ends), _roots(ends), np.where(y == 1, balance[1], balance[0])
    for at in range(0, len(y), STEP_ROWS):
        part = slice(at, min(at + STEP_ROWS, len(y)))
        ids, root = flat[ends[part.start] : ends[part.stop]], roots[part]
        z = _logits(own, ids, ends[part] - ends[part.start], root)
        p = 1 / (1 + np.exp(-np.minimum(np.maximum(z, -30), 30)))
        slope = (p - y[part]) * weight[part]
        own[:-1] *= keep
        np.subtract.at(own, ids, np.repeat(slope / root * (rate / np.sqrt(len(slope))), sizes[part]))
        own[-1] -= rate * slope.sum() / len(slope)


def _loss(weights: np.ndarray, balance: tuple[float, float], batch: pa.RecordBatch) -> np.ndarray:
    """Sum of losses and of weights of the lines of both splits: validation, training."""
    y, flat, ends = _columns(batch)
    z = np.clip(_logits(weights, flat, ends[:-1] - ends[0], _roots(ends)), -30, 30)
    weight = np.where(y == 1, balance[1], balance[0])
    loss = weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)
    split = batch.column("is_train").to_numpy(zero_copy_only=False).astype(int)
    return np.stack([np.bincount(split, loss, 2), np.bincount(split, weight, 2)])


def _pass(
    weights: np.ndarray, balance: tuple[float, float], rate: float | None, ridge: float, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """A task's part of a pass: the losses under ``weights`` (places -2 and -1) and, with a rate, its weights after its steps."""
    # The type of an array that came by pickle is equal to numpy's own float, but not the same object: ``subtract.at`` then takes
    # a path that is twenty times slower. A cast gives the array numpy's own type, a copy would not.
    own, rows, losses = weights.astype(np.float64), 0, np.zeros((2, 2))
    for batch in batches:
        losses += _loss(weights, balance, batch)
        if rate is not None:
            train = batch.filter(batch.column("is_train"))
            _step_batch(own, balance, rate, ridge, train)
            rows += len(train)
    place, sums, counts = [np.array([-2, -1])], [losses[0]], [losses[1]]
    if rows:
        place, sums = [*place, np.arange(len(own))], [*sums, own * rows]
        counts.append(np.full(len(own), float(rows)))
    columns = [pa.array(np.concatenate(x)) for x in (place, sums, counts)]
    yield pa.RecordBatch.from_arrays(columns, ["place", "sum", "rows"])


def _passed(
    rows: DataFrame, weights: np.ndarray, balance: tuple[float, float], rate: float | None, ridge: float
) -> tuple[dict[bool, float], np.ndarray]:
    """Losses of both splits under ``weights``, and the averaged weights after the steps of the next epoch, read at once."""
    bits = (len(weights) - 1).bit_length() - 1
    parts = rows.select("cell", "last").mapInArrow(
        lambda batches: _pass(weights, balance, rate, ridge, _unpacked(bits, batches)), "place bigint, sum double, rows double"
    )
    table = parts.groupBy("place").agg((F.try_divide(F.sum("sum"), F.sum("rows"))).alias("weight")).toArrow()  # one row a weight
    place, value = table.column("place").to_numpy(), table.column("weight").to_numpy()
    found = weights.copy()
    found[place[place >= 0]] = value[place >= 0]
    return {bool(k + 2): float(value[place == k][0]) for k in (-2, -1)}, found


def fit_epochs(
    train: DataFrame,
    val: DataFrame,
    variant: str,
    key: str,
    epochs: int = 12,
    patience: int = 2,
    rate: float = 0.5,
    ridge: float = 1e-5,
    bits: int = BITS,
) -> Epochs:
    """Weights of the epoch with the least validation loss. Rows need ``key``, ``label``, ``signals`` and the variant's text."""
    spark = train.sparkSession
    columns = [F.col("label").cast("int").alias("label"), *_inputs(variant), F.col(key).alias("key")]
    both = [df.where(F.col("label").isin(0, 1)).select(*columns, F.lit(t).alias("is_train")) for df, t in ((train, True), (val, False))]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Lines are dealt by key and lie in the order of its hash, so that the labels of a step are mixed.
    rows = both[0].unionByName(both[1]).repartition(tasks, "key").sortWithinPartitions(F.xxhash64("key"), "key")
    schema = f"cell binary, last boolean, {', '.join(f'{name} bigint' for name in COUNTS)}"
    rows = rows.select("is_train", "label", "text", "told").mapInArrow(lambda batches: _packed(bits, batches), schema)
    rows = cut_lineage(rows)
    v0, v1, n0, n1 = rows.agg(*[F.coalesce(F.sum(name), F.lit(0)) for name in COUNTS]).first()
    if not n0 or not n1 or not v0 + v1:
        raise ValueError("training needs lines of both labels, and a validation split")
    balance = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1))
    weights = np.zeros((1 << bits) + 1)
    best = Epochs(variant, weights, 0)
    least = np.inf
    # The pass that measures an epoch takes the steps of the next one, from the same weights.
    _, weights = _passed(rows, weights, balance, rate, ridge)
    for epoch in range(1, epochs + 1):
        ahead = rate / np.sqrt(epoch + 1) if epoch < epochs else None
        loss, stepped = _passed(rows, weights, balance, ahead, ridge)
        best.history.append((epoch, loss[True], loss[False]))
        if loss[False] < least:
            least, best.best, best.weights = loss[False], epoch, weights
        elif epoch - best.best >= patience:
            break
        weights = stepped
    return best


def score_epochs(df: DataFrame, model: Epochs, name: str) -> DataFrame:
    """Add the probability of the malicious class; rows are not moved, and features do not leave the task that hashes them."""
    weights = model.weights
    bits = (len(weights) - 1).bit_length() - 1

    def scored(texts: pa.Array, told: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        ids = _places(texts, told, bits)
        ends = ids.offsets.to_numpy()
        # Differences of running sums: the last digits of a score depend on where its line lies in the batch.
        sums = np.concatenate([[0.0], np.cumsum(weights[ids.flatten().to_numpy()])])
        z = (sums[ends[1:]] - sums[ends[:-1]]) / _roots(ends) + weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    scored.__annotations__ = {"texts": pa.Array, "told": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(scored, "double")(*_inputs(model.variant)))


def history(spark: SparkSession, model: Epochs) -> DataFrame:
    """``model``, ``epoch``, ``train_loss``, ``val_loss``, ``chosen``."""
    rows = [(model.variant, e, float(t), float(v), e == model.best) for e, t, v in model.history]
    return spark.createDataFrame(rows, "model string, epoch int, train_loss double, val_loss double, chosen boolean")


def save_epochs(spark: SparkSession, model: Epochs, path: str) -> None:
    """Weights that are not zero, and the history, as tables."""
    at = np.flatnonzero(model.weights)
    table = pa.table({"place": at, "weight": model.weights[at]})
    size = pa.table({"place": [-1], "weight": [float(len(model.weights))]})
    spark.createDataFrame(pa.concat_tables([table, size])).write.mode("overwrite").parquet(f"{path}/weights")
    history(spark, model).write.mode("overwrite").parquet(f"{path}/history")


def load_epochs(spark: SparkSession, path: str) -> Epochs:
    table = spark.read.parquet(f"{path}/weights").toArrow()
    place, weight = table.column("place").to_numpy(), table.column("weight").to_numpy()
    weights = np.zeros(int(weight[place == -1][0]))
    weights[place[place >= 0]] = weight[place >= 0]
    rows = spark.read.parquet(f"{path}/history").orderBy("epoch").collect()
    best = next((r.epoch for r in rows if r.chosen), 0)
    return Epochs(rows[0].model if rows else "raw", weights, best, [(r.epoch, r.train_loss, r.val_loss) for r in rows])
