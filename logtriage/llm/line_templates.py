"""Line dedup with a log-template tree; DataFrame and SQL functions only.

A line is parsed at fixed depth: its token count, then its ``LEADING`` first tokens, then a leaf. Tokens with a digit are
variable fields and become ``<*>`` first. A leaf's templates generalise further fields: next to the template of the whole
line, a line of ``GENERALISED`` tokens or more has one template for each half of the tokens after the leading ones, in
which that half is variable. Lines that differ only in fields of one half so share a template, and the constant part is
never less than half of the line.

A template that occurs in ``min_docs`` documents or more is recurring; its lines are dropped in all documents but the one
with the smallest ``doc_id``, which keeps the text once. Templates are counted as 64-bit hashes with map-side combining;
texts are shuffled once, to meet what is dropped from them.

Cases: a null text is an empty one; blank lines are never dropped; repeated lines of one document count once and are kept
or dropped together; rows that repeat are separate documents; a null ``doc_id`` comes before all others; an empty table
gives no row. Other columns are not read, or carried along by :func:`drop_recurring`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import stored

LEADING = 2
GENERALISED = 8

_MASKED = r"regexp_replace(trim(regexp_replace(l, '[ \\t\\r\\x0B\\f]+', ' ')), '[^ ]*[0-9][^ ]*', '<*>')"


def _half(first: str, last: str) -> str:
    """Template in which the tokens from ``first`` to before ``last`` are variable."""
    return (
        f"xxhash64(concat_ws('|', p.n, '{first}', substring_index(p.m, ' ', {first}), substring_index(p.m, ' ', {last} - p.n)))"
    )


_MIDDLE = f"({LEADING} + (p.n - {LEADING}) div 2)"
#: For every line the hashes of its templates; none for a blank line.
TEMPLATES = f"""
transform(
  transform(transform(_lines, l -> {_MASKED}), m -> named_struct('m', m, 'n', cast(size(split(m, ' ')) as int))),
  p -> CASE WHEN p.m = '' THEN array()
            WHEN p.n < {GENERALISED} THEN array(xxhash64(concat_ws('|', p.n, p.m)))
            ELSE array(xxhash64(concat_ws('|', p.n, p.m)),
                       {_half(str(LEADING), f"cast({_MIDDLE} as int)")},
                       {_half(f"cast({_MIDDLE} as int)", "p.n")}) END)
"""


def _parsed(docs: DataFrame) -> DataFrame:
    """Own columns only, under names of their own: ``_id``, ``_row``, ``_lines``, ``_templates``."""
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(docs["doc_id"].alias("_id"), F.xxhash64(docs["doc_id"], text).alias("_row"), text.alias("_text"))
    own = own.withColumn("_lines", F.split("_text", "\n"))
    return own.withColumn("_templates", F.expr(TEMPLATES))


def recurring(posted: DataFrame, min_docs: int) -> DataFrame:
    """``template``, ``n_docs``, ``first`` (smallest ``doc_id``) of the templates that are in enough documents.

    ``posted`` has a row for every document (``_id``) and template (``_template``) in it.
    """
    first = F.min(F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id"))).alias("first")
    counted = posted.groupBy(F.col("_template").alias("template")).agg(F.count(F.lit(1)).alias("n_docs"), first)
    return counted.where(F.col("n_docs") >= min_docs).select("template", "n_docs", F.col("first._id").alias("first"))


def _kept(docs: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id``, ``text``, ``_all`` (the whole row), ``_lines``, ``_flags`` (which of them stay; null: all) and ``_stay``
    (those that stay, in order)."""
    # Parsing is the dear part: templates are computed once and written down, as 64-bit hashes.
    parsed = stored(_parsed(docs).select("_id", "_row", "_templates"), "line-templates")
    posted = parsed.select("_id", "_row", F.explode(F.array_distinct(F.flatten("_templates"))).alias("_template"))
    found = recurring(posted, min_docs)
    gone = posted.join(found, F.col("_template") == F.col("template")).where(~F.col("_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("_row").agg(F.collect_set("_template").alias("_gone"))  # bounded by the lines of one text
    flags = F.transform("_templates", lambda own: ~F.arrays_overlap(own, F.col("_gone"))).alias("_flags")
    flags = parsed.join(gone, "_row").select("_row", flags).groupBy("_row").agg(F.first("_flags").alias("_flags"))
    own = docs.select("doc_id", "text", F.struct("*").alias("_all"))  # other columns keep their names in there
    text = F.coalesce("text", F.lit(""))
    own = own.withColumns({"_key": F.xxhash64("doc_id", text), "_lines": F.split(text, "\n")})
    pairs = F.filter(F.arrays_zip("_lines", "_flags"), lambda x: x["_flags"])
    stay = F.when(F.col("_flags").isNull(), F.col("_lines")).otherwise(F.transform(pairs, lambda x: x["_lines"]))
    return own.join(flags, F.col("_key") == F.col("_row"), "left").withColumn("_stay", stay)


def line_digest(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256`` (of the lines that stay, joined again) of every document."""
    found = _kept(docs.select("doc_id", "text"), min_docs)
    n, stay = F.size("_lines").cast("bigint"), F.size("_stay").cast("bigint")
    digest = F.sha2(F.array_join("_stay", "\n").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", n.alias("n_lines"), (n - stay).alias("n_dropped"), digest)


def drop_recurring(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """``docs`` with the lines that stay as ``text`` and, where there is such a column, their length as ``n_chars``."""
    found = _kept(docs, min_docs)
    same, joined = F.col("_flags").isNull(), F.array_join("_stay", "\n")
    new = {c: F.col("_all")[c] for c in docs.columns}
    new["text"] = F.when(same, F.col("text")).otherwise(joined)
    if "n_chars" in new:
        new["n_chars"] = F.when(same, new["n_chars"]).otherwise(F.length(joined)).cast(docs.schema["n_chars"].dataType)
    return found.select(*(column.alias(c) for c, column in new.items()))
