"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass (``DataFrame.freqItems``) names every digest that may hold a given share of the rows. Their exact sizes and winners
are computed, and those that do hold the share are broadcast: their rows are settled where they are read. All other digests are each
a small share, and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.llm.common import stage, table

#: A digest with this share of all rows or more is settled without a shuffle. At most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.002


def digest(text: Column) -> Column:
    """Texts are equal when identical; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def frequent(rows: DataFrame, n: int, support: float) -> DataFrame:
    """Digests with at least ``support`` of the rows, their size and winning row; at most 1 / support rows."""
    named = (rows.freqItems(["text_sha256"], support)
             .select(F.explode(F.array_distinct("text_sha256_freqItems")).alias("text_sha256")))
    exact = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(*_winner())
    return stage(exact.where(F.col("group_size") >= support * n), "frequent")


def _winner() -> list[Column]:
    return [F.max(F.struct("id", "row_tag")).alias("best"), F.count(F.lit(1)).alias("group_size")]


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; among repeated rows with that id one stays (which is a free choice). Null ids are
    smaller than any other. An empty table gives an empty result.
    """
    rows = stage(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"),
                           F.monotonically_increasing_id().alias("row_tag")), "digests")
    heavy = frequent(rows, rows.count(), support)
    few = F.broadcast(heavy)
    settled = rows.join(few, "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    ordinary = rest.join(rest.groupBy("text_sha256").agg(*_winner()), "text_sha256")
    return settled.unionByName(ordinary).select(
        F.col("id").alias(id_col), F.col("best")["id"].alias("keep_id"), "group_size",
        (F.col("row_tag") == F.col("best")["row_tag"]).alias("kept"), "text_sha256")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; other columns may have any name.

    Losers of frequent digests go where they are read; the rest meet the winner of their digest in a shuffle join. Rows that repeat
    the winning id are told apart by a further aggregation, which only sees such rows.
    """
    rows = stage(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"),
                           F.monotonically_increasing_id().alias("row_tag")), "digests")
    few = F.broadcast(frequent(rows, rows.count(), support).select("text_sha256"))

    def winners(part: DataFrame) -> DataFrame:
        best = (part.groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("same"))
                .groupBy("text_sha256").agg(F.max(F.struct("id", "same")).alias("best")))
        return best.select(F.col("text_sha256").alias("__digest"), F.col("best")["id"].alias("__keep"), F.col("best")["same"].alias("__same"))

    heavy = stage(winners(rows.join(few, "text_sha256", "left_semi")), "frequent")
    light = winners(rows.join(few, "text_sha256", "left_anti"))
    full = df.withColumn("__digest", digest(F.col(text_col)))
    mine = F.col(id_col).eqNullSafe(F.col("__keep"))
    frequent_rows = full.join(F.broadcast(heavy), "__digest").where(mine)
    other = full.join(F.broadcast(heavy.select("__digest")), "__digest", "left_anti").join(light, "__digest").where(mine)
    both = frequent_rows.unionByName(other)
    single = both.where("__same = 1")
    repeated = both.where("__same > 1").dropDuplicates(["__digest"])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
