"""Order-aware detectors: one character language model for each class, and the ratio of what they make of a line.

A model counts the trigrams of the training lines of its class, with marks before the first and after the last character. The
probability of a character after two others is interpolated with the one after the last of them, that with the one of
the character alone, and that with an even share: each order adds ``mass`` observations of the order below. The weight of a
trigram is the logarithm of the ratio of both probabilities, in whole millionths; an n-gram that no training line holds has
the weight of its last characters. The score of a line is the sum of its weights, so it depends on the order of characters,
not on the share of lines of each class. A sum of integers is the same in whatever order it is added up.

The ``signal`` variant reads canonical text and adds the weights of its thirteen signals, each set or not.

Counting is one aggregation with map-side combining. Counts of lower orders are sums of the higher ones. The table of weights
holds distinct n-grams of the training lines. Up to ``LOOKUP`` of them are sent to the tasks that read the lines, where a line's
sum is looked up in sorted arrays and no row moves; with more, the trigrams of lines are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.operators.canonical import canonicalize
from logtriage.schema import SIGNAL_KEYS
from logtriage.session import new_folder

#: Text column of each variant.
VARIANTS = {"raw": "raw_log", "normalized": "normalized_log", "signal": "normalized_log"}
ORDER = 3
START, END = "\x02", "\x03"
#: Observations that each order takes from the order below, and how many characters share evenly at the bottom.
MASS, ALPHABET = 2, 256
MICRO = 1_000_000
#: Weights that a task holds, 16 bytes each.
LOOKUP = 4_000_000

MODEL_SCHEMA = "variant string, gram string, weight bigint"


@dataclass(frozen=True)
class CharModel:
    """A table of weights; signals are rows named ``1:key`` (set) and ``0:key``."""

    variant: str
    weights: DataFrame


def grams(text: Column) -> Column:
    """The trigram that ends at every character of a text and at its end mark."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def _weight(above: Column, below: Column) -> Column:
    return F.round((F.log(above) - F.log(below)) * MICRO).cast("bigint")


def _rates(counts: DataFrame, n: int, lower: DataFrame | None) -> DataFrame:
    """``gram``, counts ``n0``, ``n1``, and both probabilities ``p0``, ``p1`` of its last character after the others."""
    seen = counts.groupBy(F.substring("gram", ORDER - n + 1, n).alias("gram"))
    seen = seen.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    before = F.substring("gram", 1, n - 1)
    totals = seen.groupBy(before.alias("before")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    found = seen.join(totals, before == F.col("before"))
    if lower is None:
        even = F.lit(1.0) / F.lit(float(ALPHABET))
        found = found.withColumns({"b0": even, "b1": even})
    else:
        less = lower.select(F.col("gram").alias("less"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        found = found.join(less, F.substring("gram", 2, n - 1) == F.col("less"))
    rates = [((F.col(f"n{k}") + F.col(f"b{k}") * MASS) / (F.col(f"t{k}") + MASS)).alias(f"p{k}") for k in (0, 1)]
    return found.select("gram", "n0", "n1", *rates)


def _signal_weights(train: DataFrame) -> DataFrame:
    """``gram``, ``weight`` of every signal, set and not set, with one line added on either side."""
    label, held = F.col("label") == 1, lambda key: F.col(f"signals.{key}")
    sums = [F.count_if(label).alias("t1"), F.count_if(~label).alias("t0")]
    for key in SIGNAL_KEYS:
        sums += [F.count_if(label & held(key)).alias(f"{key}_1"), F.count_if(~label & held(key)).alias(f"{key}_0")]
    pairs = []
    for key in SIGNAL_KEYS:
        one, zero = F.col(f"{key}_1"), F.col(f"{key}_0")
        set_ = _weight((one + 1) / (F.col("t1") + 2), (zero + 1) / (F.col("t0") + 2))
        not_ = _weight((F.col("t1") - one + 1) / (F.col("t1") + 2), (F.col("t0") - zero + 1) / (F.col("t0") + 2))
        pairs += [F.struct(F.lit(f"1:{key}").alias("gram"), set_.alias("weight"))]
        pairs += [F.struct(F.lit(f"0:{key}").alias("gram"), not_.alias("weight"))]
    return train.agg(*sums).select(F.inline(F.array(*pairs)))


def fit(train: DataFrame, variant: str) -> CharModel:
    """Both classes' models over labelled rows with ``signals`` and the text of the variant; rows without label are left out."""
    rows = train.where(F.col("label").isin(0, 1))
    text = F.coalesce(F.col(VARIANTS[variant]), F.lit(""))
    one = (F.col("label") == 1).cast("bigint")
    counts = rows.select(F.col("label"), F.explode(grams(text)).alias("gram")).groupBy("gram")
    counts = counts.agg(F.sum(1 - one).alias("n0"), F.sum(one).alias("n1"))
    spark, at = train.sparkSession, new_folder(train.sparkSession, "charlm")
    counts.write.parquet(f"{at}/counts")
    counts = spark.read.schema("gram string, n0 bigint, n1 bigint").parquet(f"{at}/counts")
    lower, found = None, []
    for n in range(1, ORDER + 1):
        lower = _rates(counts, n, lower)
        found.append(lower.select("gram", _weight(F.col("p1"), F.col("p0")).alias("weight")))
    if variant == "signal":
        found.append(_signal_weights(rows))
    weights = reduce(DataFrame.unionByName, found).select(F.lit(variant).alias("variant"), "gram", "weight")
    weights.write.parquet(f"{at}/weights")
    return load(spark, f"{at}/weights", variant)


def save(model: CharModel, path: str) -> None:
    model.weights.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, variant: str) -> CharModel:
    return CharModel(variant, spark.read.schema(MODEL_SCHEMA).parquet(path).where(F.col("variant") == variant))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _sorted_weights(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ascending keys and weights of the n-grams of each length; a key is the code points side by side."""
    found = []
    for n in range(1, ORDER + 1):
        own = table.filter(pc.equal(pc.utf8_length(table.column("gram")), n))
        codes = _codes("".join(own.column("gram").to_pylist())).reshape(-1, n)
        keys = sum(codes[:, i] << 21 * (n - 1 - i) for i in range(n))
        order = np.argsort(keys)
        found.append((keys[order], own.column("weight").to_numpy()[order]))
    return found


def _weights_of(keys: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of n-grams, of their last characters where they are not known."""
    if not tables:
        return np.zeros(len(keys), np.int64)
    known, weights = tables[-1]
    place = np.searchsorted(known, keys)
    place[place == len(known)] = 0
    hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
    found = np.where(hit, weights[place], 0) if len(known) else np.zeros(len(keys), np.int64)
    missed = np.flatnonzero(~hit)
    if len(missed):
        found[missed] = _weights_of(keys[missed] & ((1 << 21 * (len(tables) - 1)) - 1), tables[:-1])
    return found


def trigram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points side by side of the trigrams of texts that lie one after the other, and the number of each text's own.

    Between the trigrams of two texts stand two that belong to none.
    """
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + ORDER)
    padded = np.full(ends[-1], ord(START), np.int64)
    padded[ends - 1] = ord(END)
    padded[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) * ORDER + ORDER - 1, sizes)] = _codes("".join(texts.to_pylist()))
    return padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:], sizes + 1


def _sums(texts: pa.Array, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the weights of the trigrams of every text."""
    if not len(texts):
        return np.zeros(0, np.int64)
    keys, own = trigram_keys(texts)
    sums = np.concatenate([[0], np.cumsum(_weights_of(keys, tables))])
    begins = np.cumsum(own + ORDER - 1) - own - ORDER + 1
    return sums[begins + own] - sums[begins]


def totals(df: DataFrame, model: CharModel, keys: list[str]) -> DataFrame:
    """``keys``, ``total`` (sum of weights) and ``n`` (its terms) of every row; ``keys`` tell the rows apart."""
    if model.weights.count() > LOOKUP:
        return joined_totals(df, model, keys)
    table = model.weights.select("gram", "weight").toArrow()
    tables = _sorted_weights(table)

    def summed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(_sums(texts, tables))

    summed.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.make_valid_utf8(F.coalesce(F.col(VARIANTS[model.variant]), F.lit("")))
    total, n = F.arrow_udf(summed, "bigint")(text), F.length(text).cast("bigint") + 1
    if model.variant == "signal":
        of = dict(zip(table.column("gram").to_pylist(), table.column("weight").to_pylist()))
        for key in SIGNAL_KEYS:
            total += F.when(F.col(f"signals.{key}"), F.lit(of[f"1:{key}"])).otherwise(F.lit(of[f"0:{key}"]))
        n += len(SIGNAL_KEYS)
    return df.select(*keys, total.alias("total"), n.alias("n"))


def joined_totals(df: DataFrame, model: CharModel, keys: list[str]) -> DataFrame:
    """``totals`` by joins with the table of weights, of any size. A text's trigrams leave their task as one sum."""
    text = F.coalesce(F.col(VARIANTS[model.variant]), F.lit(""))
    terms = grams(text)
    if model.variant == "signal":
        told = [F.concat(F.col(f"signals.{key}").cast("int").cast("string"), F.lit(f":{key}")) for key in SIGNAL_KEYS]
        terms = F.concat(terms, F.array(*told))
    long = df.select(*keys, F.explode(terms).alias("_gram"))
    for n in range(ORDER, 0, -1):  # the whole n-gram (or signal), then its last characters
        own = F.length("gram") >= n if n == ORDER else F.length("gram") == n
        of = model.weights.where(own).select(F.col("gram").alias(f"_g{n}"), F.col("weight").alias(f"_w{n}"))
        ending = F.col("_gram") if n == ORDER else F.substring("_gram", -n, n)
        long = long.join(of, ending == F.col(f"_g{n}"), "left")
    weight = F.coalesce("_w3", "_w2", "_w1", F.lit(0))
    return long.groupBy(*keys).agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("n"))


def probability(total: Column, n: Column) -> Column:
    """The score of a detector: 0.5 where both models find a line equally likely, by its mean weight."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total / n) / F.lit(float(MICRO))))


def with_features(df: DataFrame) -> DataFrame:
    return df if "signals" in df.columns else canonicalize(df)


def score_columns(df: DataFrame, models: list[CharModel], keys: list[str]) -> DataFrame:
    """``keys`` and ``score_<variant>`` of every model."""
    found = None
    for model in models:
        name = f"score_{model.variant}"
        own = totals(df, model, keys).select(*keys, probability(F.col("total"), F.col("n")).alias(name))
        found = own if found is None else found.join(own, keys)
    return found
