"""Exact top-k search by inner product: one KD-tree per shard, best-first traversal with box bounds and a propagated k-th score.

A shard holds a bounded number of vectors. Its tree splits at medians along the widest side and keeps tight boxes; no vector of a box scores
above sum(max(q * low, q * high)). Every query first searches the shard in which it lies; its k-th best score there goes with it to all
other shards, where boxes below that score are never opened.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import stage, table

#: Fixed values of the registered query.
K, EVERY, SCALE = 20, 20, 64
SHARD_ROWS = 16_384
QUERY_BLOCK = 2_048
LEAF = 256
NO_SCORE = np.iinfo(np.int64).min


class KDTree:
    """Boxes over rows of an integer matrix; node i has children left[i], right[i], or rows order[begin[i]:end[i]] if it is a leaf."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.order = vectors, np.arange(len(vectors))
        self.low, self.high, self.left, self.right, self.begin, self.end = [], [], [], [], [], []
        todo = [(0, len(vectors), -1, False)]
        while todo:
            b, e, parent, is_right = todo.pop()
            own = vectors[self.order[b:e]]
            node = len(self.low)
            low, high = own.min(axis=0), own.max(axis=0)
            for column, value in ((self.low, low), (self.high, high), (self.left, -1), (self.right, -1), (self.begin, b), (self.end, e)):
                column.append(value)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            side = int((high - low).argmax()) if len(low) else 0
            if e - b > leaf and len(low) and high[side] > low[side]:  # equal vectors are never split
                half = (e - b) // 2
                self.order[b:e] = self.order[b:e][np.argpartition(own[:, side], half)]
                todo += [(b + half, e, node, True), (b, b + half, node, False)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score that any vector of each node can have, per query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, place: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best but row ``own``, best first, ties to smaller ``place``; rows below ``least`` may be left out."""
        heap, best_rows, best = [(-bound[0], 0)], np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            rows = self.order[self.begin[node]: self.end[node]]
            score = self.vectors[rows] @ query
            keep = (score >= least) & (rows != own)
            if keep.any():
                best_rows, best = np.concatenate((best_rows, rows[keep])), np.concatenate((best, score[keep]))
                rank = np.lexsort((place[best_rows], -best))[:k]
                best_rows, best = best_rows[rank], best[rank]
                if len(best) == k:
                    least = max(least, best[-1])
        return best_rows, best


def exact(rows: list, *, others: np.ndarray | None = None) -> np.ndarray:
    """Integer vectors as a matrix whose products are exact: doubles while all sums stay below 2**53, else Python's integers."""
    m = np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), -1)
    largest = float(np.abs(m.astype(float)).max(initial=0))
    other = largest if others is None else float(np.abs(others.astype(float)).max(initial=0))
    return m.astype(np.float64) if largest * max(other, 1.0) * max(1, m.shape[1]) < 2**52 else m.astype(object)


def top_in_shard(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Candidates of each query (query, vec, least) in one shard (row, vec_id, no_id, vec). Queries and candidates are named by row tags."""
    out_query, out_row, out_score = [], [], []
    if len(shard) and len(queries):
        vectors = exact(list(shard["vec"]))
        asked = exact(list(queries["vec"]), others=vectors)
        if object in (vectors.dtype, asked.dtype):
            vectors, asked = vectors.astype(np.int64).astype(object), asked.astype(np.int64).astype(object)
        tree, tags = KDTree(vectors), shard["row"].to_numpy()
        place = np.empty(len(shard), np.int64)
        place[np.lexsort((tags, shard["vec_id"].to_numpy(), shard["no_id"].to_numpy()))] = np.arange(len(shard))
        at = {tag: i for i, tag in enumerate(tags.tolist())}
        for b in range(0, len(asked), 256):
            for q, bound, tag, least in zip(asked[b: b + 256], tree.bounds(asked[b: b + 256]), queries["query"][b: b + 256], queries["least"][b: b + 256]):
                found, score = tree.search(q, bound, place, at.get(tag, -1), k, -math.inf if least <= NO_SCORE + 1 else int(least))
                out_query += [tag] * len(found)
                out_row += found.tolist()
                out_score += [min(max(int(s), NO_SCORE + 1), 2**63 - 1) for s in score]
    rows = np.array(out_row, np.int64)
    ids = {c: shard[c].to_numpy()[rows] if len(rows) else np.zeros(0, t) for c, t in (("row", np.int64), ("vec_id", np.int64), ("no_id", bool))}
    return pd.DataFrame({"query": np.array(out_query, np.int64), **ids, "score": np.array(out_score, np.int64)})


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null, empty, or has a null or non-finite component."""
    wide = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(wide(x)) | (F.abs(wide(x)) == F.lit(float("inf"))))
    # Components beyond a long stop at its range.
    numbers = F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * wide(x), F.lit(9e18)), F.lit(-9e18))).cast("long"))
    return F.when(~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0), numbers)


def top_k(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
          query_block: int = QUERY_BLOCK, scale: int = SCALE) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k rows with the highest inner product for every row that is a query, but itself.

    Vectors that are null, empty, or hold null or non-finite components take no part. Every other row is a candidate of every query row but
    itself, also rows that repeat an id or have none: rows that repeat a query's id are queries of their own, each with its own ranks, and rows
    without id come last among equal scores. A vector meets only vectors of its own length. Scores beyond a long stop at its range. An
    empty table gives an empty result. ``is_query`` is over ``vec_id``; null counts as false.
    """
    clean = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("vec")).where("vec is not null")
    rows = stage(clean.withColumn("row", F.monotonically_increasing_id()).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
                 # Tags and numbers without nulls keep whole numbers whole in pandas.
                 .withColumn("no_id", F.col("vec_id").isNull()).withColumn("vec_id", F.coalesce("vec_id", F.lit(0).cast("long"))), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-rows.where("is_query").count() // query_block))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("size", F.size("vec"))
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(blocks)).cast("int")
    queries = placed.where("is_query").select(F.col("row").alias("query"), F.when(~F.col("no_id"), F.col("vec_id")).alias("query_id"), "vec", "size", "shard",
                                              block.alias("block"))
    candidates = placed.select("row", "vec_id", "no_id", "vec", "size", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = "query long, row long, vec_id long, no_id boolean, score long"
    key = ["size", "shard", "block"]
    run = lambda shard, asked: top_in_shard(shard, asked, k)

    def search(asked: DataFrame) -> DataFrame:
        # New names for the same columns: both sides come from one table.
        return candidates.groupBy(*key).cogroup(asked.drop("query_id").toDF(*[c for c in asked.columns if c != "query_id"]).groupBy(*key)).applyInPandas(run, schema)

    home = stage(search(queries.withColumn("least", F.lit(int(NO_SCORE)).cast("long"))), "home")
    if shards == 1:
        merged = home
    else:
        kth = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        away = (queries.join(kth, "query", "left").withColumn("least", F.coalesce("kth", F.lit(int(NO_SCORE)).cast("long"))).drop("kth")
                .withColumn("home", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home"))
        merged = home.unionByName(search(away))
    place = W.partitionBy("query").orderBy(F.col("score").desc(), "no_id", "vec_id", "row")
    best = merged.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.join(queries.select("query", "query_id"), "query").select(
        "query_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS tag, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.tag, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.tag <> c.tag AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
