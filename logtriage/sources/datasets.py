"""Labelled datasets, statistics and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtriage.schema import DATASET_COLUMNS, DATASET_SCHEMA, REQUIRED_SPLITS, validate_schema


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV files; columns may come in any order, extra ones pass, missing ones raise.

    So do files whose headers differ, and labels that are no numbers. Quoted cells may hold line breaks, which is why a
    file is not split; :func:`write_dataset` writes a form that is.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    header = reader.csv(path).columns
    reader = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    by_name = {f.name: f for f in DATASET_SCHEMA.fields}
    schema = StructType([by_name[n] if n in by_name else _text_field(n) for n in header])
    df = reader.schema(schema).csv(path)
    validate_schema(df)
    return df.na.fill("", ["raw_log", "normalized_log"])


def _text_field(name: str):
    from pyspark.sql.types import StringType, StructField

    return StructField(name, StringType())


def write_dataset(df: DataFrame, root: str) -> None:
    """One Parquet table with a folder per split."""
    validate_schema(df)
    df.select(*DATASET_COLUMNS).write.mode("overwrite").partitionBy("split").parquet(root)


def rewrite_split(df: DataFrame, root: str, split: str) -> None:
    """Replace one split of a table that :func:`write_dataset` wrote; the files of all others stay as they are.

    Rows lie in the order of their ids, so that files cover narrow ranges of it. Rows of another split raise.
    """
    validate_schema(df)
    rows = df.select(*DATASET_COLUMNS).withColumn(
        "split", F.when(F.col("split") == split, F.col("split")).otherwise(F.raise_error(F.lit(f"a row is not of {split}")))
    )
    writer = rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(root)


def split_files(spark: SparkSession, root: str) -> DataFrame:
    """``split``, ``file`` of a table by split."""
    files = spark.read.parquet(root).select("split", F.col("_metadata.file_path").alias("file"))
    return files.groupBy("split", "file").agg(F.count(F.lit(1)).alias("rows"))


def write_split_cells(cells: DataFrame, root: str) -> None:
    """Statistics of each split in its own folder; only the splits that occur are replaced."""
    writer = cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("split").parquet(root)


def write_split_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_split(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """The named splits; other folders are pruned."""
    return spark.read.parquet(root).filter(F.col("split").isin(*names)).select(*DATASET_COLUMNS)


def train_val(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read_split(spark, root, "train"), read_split(spark, root, "val")


def missing_splits(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Required splits the table does not hold."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(name,) for name in required or REQUIRED_SPLITS], "split string")
    return wanted.join(df.select("split").distinct(), "split", "left_anti")


def require_splits(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    missing = sorted(row["split"] for row in missing_splits(df, required).collect())
    if missing:
        raise FileNotFoundError(f"missing processed datasets: {missing}")
    return df


def stats_document(stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON document from ``dataset_stats`` rows: a map per statistic, the total and the schema."""
    facets = ["by_split", "by_label", "by_source", "by_obfuscation_type"]
    maps = [
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("statistic") == name, F.struct("value", "rows"))))
        ).alias(name)
        for name in facets
    ]
    total = F.max(F.when(F.col("statistic") == "total_rows", F.col("rows"))).alias("total_rows")
    listed = F.array(*[F.lit(c) for c in columns or DATASET_COLUMNS]).alias("schema")
    return stats.agg(*maps, total).select(*facets, "total_rows", listed)


def write_stats(stats: DataFrame, path: str, columns: list[str] | None = None) -> None:
    document = stats_document(stats, columns)
    document.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_source_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
