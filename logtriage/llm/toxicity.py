"""Toxicity: a linear classifier over words, regularised on counterfactual pairs.

A labelled text that names a group (an identity term) gets a counterfactual: each term is swapped for the next one of its
family. Training minimises the log-loss of the labels plus ``pull`` times the squared change of the score's logit between
a text and its counterfactual, plus a small ridge. A word that merely names a group therefore cannot carry a label on its
own, and neutral mentions are not rejected.

The classifier is fitted on a bounded sample: the ``sample`` labelled rows that come first in the order of a hash of their
id. Everything else covers all rows: a text is scored as a whole, wherever its words stand.

A text's features are its distinct lower-case words of letters and beginnings of them, as far as ``least_texts`` sample
texts hold them. The logit is the sum of their weights and a bias.

Cases: a null or empty text, or one without known words, gets the bias' score; labels that are null or belong to no text
are not used; rows that repeat are scored each, and repeated labelled rows count as often as they occur in the sample; a
null ``doc_id`` is scored and never learned from; without any usable label, or with one class only, every score is the share
of the toxic ones (0.0 without any); an empty table gives no row. Other columns than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import drop_stored, held_out, partitions, rows_where, stored, texts

WORD = re.compile(r"[^\W\d_]+")

#: Families of identity terms: swapping one for another of its family must not change a score.
IDENTITY_FAMILIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("american", "mexican", "chinese", "russian", "indian", "german", "french", "spanish"),
    ("young", "old", "elderly"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétien", "musulman", "juif", "athée"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristiano", "musulmán", "judío", "ateo"),
)
SWAP = {term: family[(k + 1) % len(family)] for family in IDENTITY_FAMILIES for k, term in enumerate(family)}


#: Beginnings of a word that count as features of their own, so that unseen forms of a known stem are recognised.
STEMS = range(4, 9)
#: Words whose features a worker keeps; a bound on memory only.
KEPT_WORDS = 100_000
#: Texts whose features a task counts before it writes the counts; a bound on memory only.
COUNTED_TEXTS = 100


def word_features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in STEMS if k < len(word))]


class Vocabulary(dict):
    """Known feature ids of a word."""

    def __init__(self, place: dict[str, int]) -> None:
        super().__init__()
        self.place = place

    def __reduce__(self) -> tuple:
        return Vocabulary, (self.place,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = tuple(self.place[f] for f in word_features(word) if f in self.place)
        return found

    def ids(self, words_: set[str]) -> np.ndarray:
        """Distinct feature ids of a text, in ascending order, so that sums do not depend on the worker."""
        found: set[int] = set()
        found.update(*map(self.__getitem__, words_))
        return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


@dataclass
class Model:
    """Weights of the vocabulary, a bias and, for reports, the mean absolute logit change on the counterfactual pairs."""

    bias: float = 0.0
    vocabulary: Vocabulary = field(default_factory=lambda: Vocabulary({}))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None
    gap: float = 0.0

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        logit = self.bias + self.weights[self.vocabulary.ids(words(text))].sum()
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _flat(known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature ids of a sparse matrix of ones."""
    return np.repeat(np.arange(len(known)), [len(x) for x in known]), np.concatenate([np.zeros(0, np.int64), *known])


def swapped(own: set[str]) -> set[str] | None:
    """The words of a text's counterfactual; none for a text that names no group."""
    return None if own.isdisjoint(SWAP) else {SWAP.get(w, w) for w in own}


def counted(rows: list[tuple[set[str], int]]) -> dict[str, list[int]]:
    """Of every feature: in how many texts and counterfactuals it is, and in how many toxic texts."""
    found: dict[str, list[int]] = {}
    for own, label in rows:
        for words_, toxic in ((own, label), (swapped(own), 0)):
            for f in {f for w in words_ or () for f in word_features(w)}:
                counts = found.setdefault(f, [0, 0])
                counts[0] += 1
                counts[1] += toxic
    return found


def telling(names: list[str], seen: np.ndarray, toxic: np.ndarray, n1: int, n0: int, least_z: float) -> list[str]:
    """Features whose shares among the two classes differ by ``least_z`` standard errors, and the identity terms."""
    share = np.clip(seen / (n1 + n0), 1e-9, 1 - 1e-9)
    z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return sorted(f for f, x in zip(names, z, strict=True) if abs(x) >= least_z or f in SWAP)


def train(
    vocabulary: Vocabulary,
    y: np.ndarray,
    own: list[np.ndarray],
    other: dict[int, np.ndarray],
    pull: float = 1.0,
    ridge: float = 1e-3,
    steps: int = 300,
    rate: float = 0.1,
) -> Model:
    """Adam on the whole sample: log-loss, counterfactual pull, ridge.

    ``own`` are the feature ids of each text, ``other`` those of the counterfactuals, by the number of their text.
    """
    row, col = _flat(own)
    swapped_row, swapped_col = _flat(list(other.values()))
    first = np.array(list(other), dtype=np.int64)
    n, m, width = len(y), len(other), len(vocabulary.place)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, bias = np.zeros(width), 0.0
    moment, power = np.zeros(width + 1), np.zeros(width + 1)
    change = np.zeros(m)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(row, weights=w[col], minlength=n)
        slope = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        if m:
            change = logit[first] - bias - np.bincount(swapped_row, weights=w[swapped_col], minlength=m)
            tug = 2 * pull * change / m
            slope_w = np.bincount(swapped_col, weights=-tug[swapped_row], minlength=width)
            slope_own = slope + np.bincount(first, weights=tug, minlength=n)
        else:
            slope_w, slope_own = np.zeros(width), slope
        slope_w += np.bincount(col, weights=slope_own[row], minlength=width) + ridge * w
        gradient = np.append(slope_w, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        power = 0.999 * power + 0.001 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    gap = float(np.abs(change).mean()) if m else 0.0
    return Model(float(bias), vocabulary, w, gap=gap)


def fit(labelled: list[tuple[str, int]], least_texts: int = 3, least_z: float = 3.0, **options: float) -> Model:
    """A model of (text, label) rows that are at hand."""
    y = np.array([label for _, label in labelled], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    rows = [(words(text), label) for text, label in labelled]
    counts = {f: c for f, c in counted(rows).items() if c[0] >= least_texts}
    seen, toxic = np.array(list(counts.values()), dtype=float).reshape(-1, 2).T
    told = telling(list(counts), seen, toxic, int(y.sum()), int(len(y) - y.sum()), least_z)
    vocabulary = Vocabulary({f: k for k, f in enumerate(told)})
    other = {k: vocabulary.ids(x) for k, (own, _) in enumerate(rows) if (x := swapped(own)) is not None}
    return train(vocabulary, y, [vocabulary.ids(own) for own, _ in rows], other, **options)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, label: str = "toxic") -> DataFrame:
    """At most ``sample`` rows (``text``, ``label``, ``place``) outside the held-out fold, the first by a hash of their id.

    The labels are chosen before any text is touched, so no more than ``sample`` of them are sent to the scan of the texts,
    and no text but theirs is moved.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    place = F.xxhash64("id", "text")
    return rows.orderBy(place, "id", "label").limit(sample).select("text", "label", place.alias("place"))  # ids may repeat


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, label: str = "toxic") -> list[tuple[str, int]]:
    """The sample's (text, label) rows, on the driver."""
    return [(r.text, r.label) for r in sample_rows(docs, labels, sample, label).toLocalIterator()]


def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        logit = self.bias + self.weights[self.vocabulary.ids(words(text))].sum()
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _flat(known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature ids of a sparse matrix of ones."""
    return np.repeat(np.arange(len(known)), [len(x) for x in known]), np.concatenate([np.zeros(0, np.int64), *known])


def swapped(own: set[str]) -> set[str] | None:
    """The words of a text's counterfactual; none for a text that names no group."""
    return None if own.isdisjoint(SWAP) else {SWAP.get(w, w) for w in own}


def counted(rows: list[tuple[set[str], int]]) -> dict[str, list[int]]:
    """Of every feature: in how many texts and counterfactuals it is, and in how many toxic texts."""
    found: dict[str, list[int]] = {}
    for own, label in rows:
        for words_, toxic in ((own, label), (swapped(own), 0)):
            for f in {f for w in words_ or () for f in word_features(w)}:
                counts = found.setdefault(f, [0, 0])
                counts[0] += 1
                counts[1] += toxic
    return found


def telling(names: list[str], seen: np.ndarray, toxic: np.ndarray, n1: int, n0: int, least_z: float) -> list[str]:
    """Features whose shares among the two classes differ by ``least_z`` standard errors, and the identity terms."""
    share = np.clip(seen / (n1 + n0), 1e-9, 1 - 1e-9)
    z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return sorted(f for f, x in zip(names, z, strict=True) if abs(x) >= least_z or f in SWAP)


def train(
    vocabulary: Vocabulary,
    y: np.ndarray,
    own: list[np.ndarray],
    other: dict[int, np.ndarray],
    pull: float = 1.0,
    ridge: float = 1e-3,
    steps: int = 300,
    rate: float = 0.1,
) -> Model:
    """Adam on the whole sample: log-loss, counterfactual pull, ridge.

    ``own`` are the feature ids of each text, ``other`` those of the counterfactuals, by the number of their text.
    """
    row, col = _flat(own)
    swapped_row, swapped_col = _flat(list(other.values()))
    first = np.array(list(other), dtype=np.int64)
    n, m, width = len(y), len(other), len(vocabulary.place)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, bias = np.zeros(width), 0.0
    moment, power = np.zeros(width + 1), np.zeros(width + 1)
    change = np.zeros(m)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(row, weights=w[col], minlength=n)
        slope = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        if m:
            change = logit[first] - bias - np.bincount(swapped_row, weights=w[swapped_col], minlength=m)
            tug = 2 * pull * change / m
            slope_w = np.bincount(swapped_col, weights=-tug[swapped_row], minlength=width)
            slope_own = slope + np.bincount(first, weights=tug, minlength=n)
        else:
            slope_w, slope_own = np.zeros(width), slope
        slope_w += np.bincount(col, weights=slope_own[row], minlength=width) + ridge * w
        gradient = np.append(slope_w, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        power = 0.999 * power + 0.001 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    gap = float(np.abs(change).mean()) if m else 0.0
    return Model(float(bias), vocabulary, w, gap=gap)


def fit(labelled: list[tuple[str, int]], least_texts: int = 3, least_z: float = 3.0, **options: float) -> Model:
    """A model of (text, label) rows that are at hand."""
    y = np.array([label for _, label in labelled], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    rows = [(words(text), label) for text, label in labelled]
    counts = {f: c for f, c in counted(rows).items() if c[0] >= least_texts}
    seen, toxic = np.array(list(counts.values()), dtype=float).reshape(-1, 2).T
    told = telling(list(counts), seen, toxic, int(y.sum()), int(len(y) - y.sum()), least_z)
    vocabulary = Vocabulary({f: k for k, f in enumerate(told)})
    other = {k: vocabulary.ids(x) for k, (own, _) in enumerate(rows) if (x := swapped(own)) is not None}
    return train(vocabulary, y, [vocabulary.ids(own) for own, _ in rows], other, **options)


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, label: str = "toxic") -> DataFrame:
    """At most ``sample`` rows (``text``, ``label``, ``place``) outside the held-out fold, the first by a hash of their id.

    The labels are chosen before any text is touched, so no more than ``sample`` of them are sent to the scan of the texts,
    and no text but theirs is moved.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    place = F.xxhash64("id", "text")
    return rows.orderBy(place, "id", "label").limit(sample).select("text", "label", place.alias("place"))  # ids may repeat


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, label: str = "toxic") -> list[tuple[str, int]]:
    """The sample's (text, label) rows, on the driver."""
    return [(r.text, r.label) for r in sample_rows(docs, labels, sample, label).toLocalIterator()]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, label: str = "toxic") -> list[tuple[str, int]]:
    """At most ``sample`` (text, label) rows outside the held-out fold, of the labels that come first by a hash of their id.

    The labels are chosen before any text is touched, so no more than ``sample`` of them are sent to the scan of the texts,
    and no text but theirs is moved.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    first = rows.orderBy(F.xxhash64("id", "text"), "id", "label").limit(sample)  # an id may have many texts
    return [(r.text, r.label) for r in first.select("text", "label").toLocalIterator()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(text) for text in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64())]
            columns.append(pa.array([int(x >= 0.5) for x in found], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    plain = texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return plain.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, as they are: judged and passed on in one scan."""
    return rows_where(docs, lambda text: model.score(text.decode("utf-8", "replace")) < 0.5)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (own.slice(at, COUNTED_TEXTS) for own in batches for at in range(0, own.num_rows, COUNTED_TEXTS)):
        rows = zip(map(words, batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True)
        found = counted(list(rows))
        columns = [pa.array(list(found), pa.string()), *(pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "seen", "toxic"])


def trained(
    docs: DataFrame, labels: DataFrame, sample: int = 6_000, least_texts: int = 3, least_z: float = 3.0, **options: float
) -> Model:
    """Fit on a bounded sample of labelled rows of ``docs``. The driver sees feature counts and ids, never texts."""
    rows = stored(sample_rows(docs, labels, sample).repartition(partitions(docs.sparkSession)), "toxicity-sample")
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n1 < n:
        drop_stored(rows)
        return Model(constant=n1 / n if n else 0.0)
    counts = rows.select("text", "label").mapInArrow(_count_features, "feature string, seen bigint, toxic bigint")
    counts = counts.groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    often = counts.where(F.col("seen") >= least_texts).toArrow()  # as many as the bounded sample has
    seen, toxic = (often.column(c).to_numpy().astype(float) for c in ("seen", "toxic"))
    told = telling(often.column("feature").to_pylist(), seen, toxic, n1, n - n1, least_z)
    vocabulary = Vocabulary({f: k for k, f in enumerate(told)})

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            own = [words(text) for text in batch.column(0).to_pylist()]
            other = [None if (x := swapped(w)) is None else vocabulary.ids(x) for w in own]
            columns = [pa.array([vocabulary.ids(w) for w in own], longs), pa.array(other, longs)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], ["own", "other", "label", "place"])

    schema = "own array<bigint>, other array<bigint>, label int, place bigint"
    found = rows.select("text", "label", "place").mapInArrow(ids, schema).toArrow()
    found = found.sort_by([("place", "ascending"), ("label", "ascending")])
    drop_stored(rows)
    y = found.column("label").to_numpy().astype(float)
    own = [x.values.to_numpy() for x in found.column("own")]
    other = {k: x.values.to_numpy() for k, x in enumerate(found.column("other")) if x.is_valid}
    return train(vocabulary, y, own, other, **options)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6_000, **options: float) -> DataFrame:
    """Fit on a bounded sample of labelled rows of ``docs`` and score all of them."""
    return score(docs, trained(docs, labels, sample, **options))
