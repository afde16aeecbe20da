"""Token counts as rollups that are maintained by deltas.

A change feed says what happened to documents' counts: ``insert`` or ``revise`` (the document now has ``n_tokens`` under
``tokenizer``, in ``source`` and ``lang``) and ``delete``. Where ids may be null or repeat, a column ``row`` tells rows of
one id apart; a feed without it has one row for each id. A commit looks up what the ledger has for the same rows,
and writes signed deltas: minus what was counted, plus what is counted now, summed by source, language and tokenizer
version. Totals are the sums of all deltas; no commit reads texts or totals again.

Commits are idempotent. A batch has an id; its ledger rows are written first, its deltas after them, each under a folder
of the id, and Spark's ``_SUCCESS`` file of the deltas is the commit. A batch that is committed already changes nothing, one
that broke off is written anew, and readers look at committed batches only.

Cases: several changes of one row and tokenizer in a batch count as one, a delete before others, else the one with the
most tokens; a delete of what is not there is allowed, and a delete without tokenizer or with a null ``row`` is one for each
tokenizer or row of the document that is there; a null ``row`` of another change, and of a feed without the column, is
row 0; a null ``doc_id`` is an id like others; null sources and languages are groups of their own; null counts are
0; an empty batch commits nothing but its id. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm.common import stored

LEDGER = "doc_id bigint, row bigint, tokenizer string, source string, lang string, n_tokens bigint, live boolean, turn int"
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
CHANGES = ["op", "doc_id", "row", "tokenizer", "source", "lang", "n_tokens"]

#: Token patterns by tokenizer version (white space is ASCII).
WORDS = r"[^ \t\n\x0B\f\r]+"
MARKS = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
LETTERED = r"[^ \t\n\x0B\f\r]*\p{L}[^ \t\n\x0B\f\r]*"


class TokenRollup:
    """Ledger and deltas under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self) -> list[tuple[int, str]]:
        """(turn, id) of the committed batches, in order; one folder for each, whatever its size."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top)]
        done = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(top, f"{n}/_SUCCESS"))]
        return sorted((int(turn), batch) for turn, _, batch in (n.partition("-") for n in done))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{turn}-{batch}" for turn, batch in self._committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def ledger(self) -> DataFrame:
        """What is counted now: the last entry of each document, row and tokenizer, if it is live."""
        columns = ("source", "lang", "n_tokens", "live")
        last = F.max_by(F.struct(*columns), "turn").alias("last")
        rows = self._read("ledger", LEDGER).groupBy("doc_id", "row", "tokenizer").agg(last)
        return rows.select("doc_id", "row", "tokenizer", "last.*").where("live").drop("live")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of ``changes``; False if it was committed before."""
        done = self._committed()
        if batch_id in (batch for _, batch in done):
            return False
        turn = len(done)
        if "row" not in changes.columns:
            changes = changes.withColumn("row", F.lit(0).cast("bigint"))
        feed = changes.select(*CHANGES).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint"))
        now = self.ledger().select(F.col("doc_id").alias("id"), F.col("row").alias("place"), F.col("tokenizer").alias("version"))
        wide = F.col("op").eqNullSafe("delete") & (F.col("tokenizer").isNull() | F.col("row").isNull())
        meets = F.col("doc_id").eqNullSafe(F.col("id"))
        meets &= F.coalesce(F.col("row") == F.col("place"), F.lit(True))
        meets &= F.coalesce(F.col("tokenizer") == F.col("version"), F.lit(True))
        found = {"row": F.col("place"), "tokenizer": F.col("version")}
        spread = feed.where(wide).join(now, meets).select(*(found.get(c, F.col(c)).alias(c) for c in CHANGES))
        feed = feed.where(~wide & F.col("tokenizer").isNotNull()).withColumn("row", F.coalesce("row", F.lit(0))).unionByName(spread)
        order = F.struct((F.col("op") == "delete").alias("gone"), "n_tokens", "source", "lang")
        rows = feed.groupBy("doc_id", "row", "tokenizer").agg(F.max(order).alias("x"))
        live = (~F.col("x.gone")).alias("live")
        rows = rows.select("doc_id", "row", "tokenizer", "x.source", "x.lang", "x.n_tokens", live, F.lit(turn).alias("turn"))
        own = f"{turn}-{batch_id}"
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/{own}")
        new = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{own}")
        old = self.ledger().withColumnsRenamed({"doc_id": "id", "row": "place", "tokenizer": "version"})
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("place")) & (F.col("tokenizer") == F.col("version"))
        minus = old.join(new.select("doc_id", "row", "tokenizer"), same, "left_semi")
        minus = minus.select("source", "lang", F.col("version").alias("tokenizer"), F.lit(-1).alias("sign"), "n_tokens")
        plus = new.where("live").select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "n_tokens")
        counts = [F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")]
        deltas = plus.unionByName(minus).groupBy("source", "lang", "tokenizer").agg(*counts)
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/{own}")
        return True

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` of what is counted now."""
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens")]
        found = self._read("deltas", DELTAS).groupBy("source", "lang", "tokenizer").agg(*sums)
        return found.where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``doc_id``, ``row`` (a number of each row, written down), ``source``, ``lang`` and the matches of each pattern."""
    text = F.coalesce("text", F.lit(""))
    counts = (F.regexp_count(text, F.lit(p)).cast("bigint").alias(c) for c, p in patterns.items())
    row = F.monotonically_increasing_id().alias("row")
    return stored(docs.select("doc_id", row, "source", "lang", *counts), "token-counts")


def corpus_rollup(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Load the corpus under two tokenizer versions, revise the counts of low quality, delete what is toxic; the first
    batch arrives twice. Texts are read once; every row counts, whatever its id."""
    rollup = TokenRollup(docs.sparkSession, path)
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    flags = flags.withColumnRenamed("doc_id", "labelled")
    counts = counted(docs, {"words": WORDS, "marks": MARKS, "lettered": LETTERED})

    def feed(op: str, tokenizer: str, column: str) -> DataFrame:
        return counts.select(
            F.lit(op).alias("op"), "doc_id", "row", F.lit(tokenizer).alias("tokenizer"), "source", "lang", F.col(column).alias("n_tokens")
        )

    first = feed("insert", "words", "words")
    rollup.commit("load-words", first)
    rollup.commit("load-words", first)
    rollup.commit("load-marks", feed("insert", "marks", "marks"))
    revised = feed("revise", "words", "lettered")
    rollup.commit("revise", revised.join(flags.where("quality = 0"), F.col("doc_id") == F.col("labelled"), "left_semi"))
    gone = flags.where("toxic = 1").select(
        F.lit("delete").alias("op"),
        F.col("labelled").alias("doc_id"),
        F.lit(None).cast("bigint").alias("row"),
        *(F.lit(None).cast("string").alias(c) for c in ("tokenizer", "source", "lang")),
        F.lit(None).cast("bigint").alias("n_tokens"),
    )
    rollup.commit("delete", gone)
    return rollup.totals()
