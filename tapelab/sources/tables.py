"""Readers and writers: multi-file tapes, JSON-lines ledgers, sorted parquet, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_tape(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All tape files as one table, columns matched by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, on_malformed: str = "fail") -> DataFrame:
    """A JSON-lines ledger. A missing path is an empty ledger; blank lines are skipped.

    ``on_malformed``: "fail" stops on a bad line, "drop" leaves such lines out.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[on_malformed]
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_ledger_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_ledger, keeping bad lines in ``_corrupt`` so that they can be counted."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    return (spark.read.schema(with_corrupt).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def append_ledger(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append rows to a ledger; committed files are never rewritten."""
    df.write.mode("append").format(fmt).save(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None,
                 mode: str = "overwrite") -> None:
    """Range-sorted zstd parquet, so that readers prune files and row groups by key.

    Range bounds come from the whole sort key, so one hot leading key spreads over many files.
    """
    cols = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode(mode).option("compression", "zstd").parquet(path)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, keys: list[str] | None = None,
                rebuild: bool = False) -> DataFrame:
    """Read ``path`` if a finished copy is there, else build and write it first."""
    if rebuild or not path_exists(spark, path.rstrip("/") + "/_SUCCESS"):
        if keys:
            write_sorted(build(), path, keys)
        else:
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, on whatever file system the path names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, limit: int) -> str:
    """Markdown for the first ``limit`` rows of an ordered report, with a last line that says how many rows there are."""
    def text(v: object) -> str:
        return f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    head = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in row) + " |" for row in head]
                     + ["", f"{len(head)} of {df.count()} rows"]) + "\n"
