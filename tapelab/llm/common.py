"""Helpers that the operators of this package share: staged tables in the shared folder, and whole tables by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapelab.session import ensure_checkpoint_dir

#: ASCII white space parts words; everything else belongs to them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the folder that all executors share, and read back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_within(df: DataFrame, group: str, part: str, order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each ``group`` from 0 without gaps, as column ``name``.

    ``part`` cuts every group into bounded pieces (the task that read a row): rows are numbered inside (group, part) and shifted by
    the sizes of the parts before, so no task ever sorts a whole group.
    """
    local = df.withColumn("__n", F.row_number().over(W.partitionBy(group, part).orderBy(*order)) - 1)
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sizes = (df.groupBy(group, part).agg(F.count(F.lit(1)).alias("__c"))
             .select(group, part, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before")))
    return (local.join(sizes, [group, part]).withColumn(name, (F.col("__before") + F.col("__n")).cast("long"))
            .drop("__n", "__before"))


def join_split(left: DataFrame, right: DataFrame, key: str, support: int = 1000) -> DataFrame:
    """``left`` inner-joined with ``right`` (one row per ``key``), where some keys may hold a large part of ``left``.

    Keys with at least 1 / support of all rows are at most ``support`` many: their rows of ``right`` are broadcast. The other keys
    are joined by a shuffle. Null keys match nothing. Both sides are read twice and should be staged.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__t"))
    hot = counts.join(F.broadcast(total), F.col("__c") * support >= F.col("__t")).select(key)
    known = F.broadcast(stage(hot.where(F.col(key).isNotNull()), "hot"))
    frequent = left.join(F.broadcast(right.join(known, key, "left_semi")), key)
    return frequent.unionByName(left.join(known, key, "left_anti").join(right, key))
