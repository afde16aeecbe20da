"""Character vocabulary, character ids and signal vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.operators.canonical import hold
from logtriage.schema import SIGNAL_KEYS

# Reserved ids.
PAD_ID, FIRST_ID = 0, 2


def characters(c: Column) -> Column:
    """Characters of a text; empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def fit_vocab(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct characters of the given columns with ids from 2 in code-point order.

    Each row sheds its repeated characters before the explode. The result cannot exceed the size of
    Unicode, which bounds the final numbering.
    """
    texts = F.array_distinct(F.flatten(F.array(*[characters(F.coalesce(F.col(c), F.lit(""))) for c in cols])))
    chars = df.select(F.explode(texts).alias("ch")).distinct()
    number = F.row_number().over(Window.orderBy("ch")) + (FIRST_ID - 1)
    return chars.withColumn("id", number)


def encode_chars(
    df: DataFrame, vocab: DataFrame, col: str, name: str = "char_ids", length: int | None = None
) -> DataFrame:
    """Add the ids of all characters; unknown ones are 1. With ``length``, texts are cut or padded with 0 to it.

    The vocabulary arrives as one text of its characters in the order of their ids, from a scalar subquery. The place of
    a character in it tells the id, and the place of an unknown one is 0.
    """
    listed = F.array_sort(F.collect_list(F.struct("id", "ch")))
    known = vocab.agg(F.array_join(F.transform(listed, lambda x: x["ch"]), "").alias("known")).select("known").scalar()
    df = hold(df.withColumn("_known", known), ["_known"])
    text = F.coalesce(F.col(col), F.lit(""))
    chars = characters(text if length is None else F.substring(text, 1, length))
    found = F.transform(chars, lambda ch: F.position(ch, F.col("_known")) + F.lit(FIRST_ID - 1))
    if length is not None:
        found = F.concat(found, F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.size(chars)))
    return df.withColumn(name, found).drop("_known")


def signal_array(signals: str = "signals") -> Column:
    return F.array(*[F.col(f"{signals}.{key}").cast("double") for key in SIGNAL_KEYS])


def signal_vector(df: DataFrame, signals: str = "signals", name: str = "signal_vector") -> DataFrame:
    """The thirteen signals as an ML vector in fixed order."""
    return df.withColumn(name, array_to_vector(signal_array(signals)))
