"""N-gram Jaccard join by MinHash banding.

Every text becomes its set of word 5-grams. Texts with equal sets are one class and are compared once. Classes that agree in a band of
MinHash values meet in that band's bucket, where their full n-gram sets are compared; band and row counts follow from the threshold and the
target recall. Results are one row per document, never a list of all pairs in a group: buckets with the same members are compared once, a
pair is counted in the first band in which it meets, large buckets are cut into blocks that meet pairwise, and a bucket sends out a spanning
forest of its links and link counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.llm.common import stage, table
from tapelab.llm.components import components
from tapelab.llm.words import RUN_BASE, U, Chunk, chunks, mix, run_sums, signed

NGRAM = 5
THRESHOLD = 0.8
#: Share of pairs at the threshold that must meet in a bucket; pairs above it meet more surely.
RECALL = 0.99999
#: More MinHash values than this per text are not made; within it, rows per band are as many as possible.
MAX_HASHES = 160
#: Members of a bucket in one block.
BLOCK = 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance meetings, with which the recall is reached."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within the limit")
    return best


def shingle_sets(c: Chunk, n: int = NGRAM) -> list[np.ndarray]:
    """Hashes of the distinct n-grams of each text, sorted. A text of fewer words has one n-gram, all its words; none has none."""
    at, value = c.runs(n)
    cut = np.searchsorted(at, c.word_from)
    out = [np.unique(value[b:e]) for b, e in zip(cut[:-1], cut[1:])]
    for i in np.flatnonzero((c.counts > 0) & (c.counts < n)):
        b, e = c.word_from[i: i + 2]
        out[i] = mix(run_sums(c.hashes[b:e], np.array([0]), np.array([e - b]), RUN_BASE), int(e - b))
    return out


def signatures(df: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """doc_id, sig (hash of the text), h1, h2 (hash of the n-gram set), n (its size), bands (one hash per band)."""
    factors = [U(int(x) | 1) for x in mix(np.arange(bands * rows, dtype=U), 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                sets = shingle_sets(c, n)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                begin = np.concatenate(([0], np.cumsum(size[full])))[:-1]
                every = np.concatenate(sets) if len(full) else np.zeros(0, U)
                h, band = np.zeros((2, len(sets)), U), np.zeros((len(full), bands), U)
                if len(full):
                    for k in (0, 1):
                        h[k, full] = np.add.reduceat(mix(every, 11 + k), begin)
                    for b in range(bands):
                        value = np.full(len(full), b, U)
                        for f in factors[b * rows: (b + 1) * rows]:
                            value = mix(value ^ np.minimum.reduceat(every * f, begin), 3)
                        band[:, b] = value
                ends = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, k), batch.column(2).slice(c.first, k), pa.array(signed(h[0])), pa.array(signed(h[1])),
                     pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(band.reshape(-1))))],
                    ["doc_id", "sig", "h1", "h2", "n", "bands"])

    return df.mapInArrow(run, "doc_id long, sig long, h1 long, h2 long, n long, bands array<long>")


def linked(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (i, partners) for pairs i in ``first``, j in ``second[i]`` whose sets reach the threshold. Exact, on whole sets.

    n-grams of one set only matter by their number; the others become bits, so a comparison is an AND and a bit count.
    """
    size = np.array([len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = shared[column]
    bit = place[column[keep]]
    bits = np.zeros((len(sets), max(1, -(-int(shared.sum()) // 64))), U)
    np.bitwise_or.at(bits, (owner[keep], bit // 64), U(1) << (bit % 64).astype(U))
    up, down = threshold.numerator, threshold.denominator
    for i, js in zip(first, second):
        both = np.bitwise_count(bits[i] & bits[js]).sum(axis=1, dtype=np.int64)
        good = js[both * down >= up * (size[i] + size[js] - both)]
        if len(good):
            yield i, good


def verify(group: pd.DataFrame, threshold: Fraction, n: int) -> list[tuple[int, int, int]]:
    """(node, smallest node linked to it here, documents linked to it here) of one pair of blocks of one bucket."""
    group = group.drop_duplicates("node").reset_index(drop=True)
    m = len(group)
    if m < 2:
        return []
    band, lo, hi = (int(group[c].iloc[0]) for c in ("band", "lo", "hi"))
    signature = np.stack(group["bands"].to_numpy())[:, :band]
    block, count, copies, node = (group[c].to_numpy() for c in ("block", "n", "copies", "node"))
    first, second = [], []
    for i in range(m):
        if block[i] != lo:
            continue
        js = np.arange(i + 1, m) if lo == hi else np.flatnonzero(block == hi)
        small, large = np.minimum(count[i], count[js]), np.maximum(count[i], count[js])
        js = js[small * threshold.denominator >= large * threshold.numerator]
        if band and len(js):
            js = js[~(signature[js] == signature[i]).any(axis=1)]
        if len(js):
            first.append(i)
            second.append(js)
    if not first:
        return []
    used = np.unique(np.concatenate([np.array(first), *second]))
    sets: list[np.ndarray] = [np.zeros(0, U)] * m
    texts = pa.array(group["text"].iloc[used].tolist(), pa.large_string())
    for c in chunks(texts):
        for k, s in enumerate(shingle_sets(c, n)):
            sets[used[c.first + k]] = s
    links, label = np.zeros(m, np.int64), np.arange(m)
    for i, js in linked(sets, first, second, threshold):
        links[i] += copies[js].sum()
        links[js] += copies[i]
        together = np.unique(label[np.append(js, i)])
        if len(together) > 1:
            label[np.isin(label, together)] = together[0]
    out = []
    for i in np.flatnonzero(links):
        out.append((int(node[i]), int(node[label == label[i]].min()) if m < 8 else -1, int(links[i])))
    if m >= 8:
        smallest = pd.Series(node).groupby(label).min()
        out = [(a, int(smallest[label[i]]), c) for (a, _, c), i in zip(out, np.flatnonzero(links))]
    return out


def verified(tasks: DataFrame, threshold: Fraction, n: int) -> DataFrame:
    """Streams blocks, sorted by bucket, through ``verify``: node, root, links."""
    key = ["bh", "band", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[pd.DataFrame] = []

        def close(groups: list[pd.DataFrame]) -> pd.DataFrame:
            rows = [r for g in groups for r in verify(g, threshold, n)]
            return pd.DataFrame(rows, columns=["node", "root", "links"]).astype("int64")

        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            at = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(pdf)]))
            done = []
            for b, e in zip(at[:-1], at[1:]):
                part = pdf.iloc[b:e]
                if open_group and (open_group[-1][key].iloc[-1].to_numpy() != keys[b]).any():
                    done.append(pd.concat(open_group) if len(open_group) > 1 else open_group[0])
                    open_group = []
                open_group.append(part)
            yield close(done)
        if open_group:
            yield close([pd.concat(open_group)])

    return tasks.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "node long, root long, links long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_rows(df: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, id_col: str = "doc_id",
                 text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: doc_id, sig, class_id, n_links, n, label.

    ``class_id``: the smallest doc_id of all documents connected by links; ``n_links``: other documents whose n-gram sets reach the
    threshold with this one, copies counted each; ``label``: the class itself, also where ids are null or repeat. Null, empty and
    blank texts have no n-gram, no link, no label and a class of their own. Repeated rows are documents too. An empty table gives an
    empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    exact = Fraction(str(threshold))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(F.col(text_col)).alias("sig"))
    sigs = stage(signatures(docs, bands, rows, n), "signatures")
    classes = sigs.where("n > 0").groupBy("h1", "h2", "n").agg(
        F.min(F.struct("doc_id", "sig")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Buckets with at least two classes; of those with the same members the one of the first band.
    in_band = classes.select("node", F.posexplode("bands").alias("band", "bh"))
    buckets = in_band.groupBy("bh", "band").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                                F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1")
    buckets = stage(buckets.groupBy("members", "x", "y").agg(F.min(F.struct("band", "bh")).alias("b")).select("b.band", "b.bh", "members"), "buckets")
    members = stage(in_band.join(buckets, ["bh", "band"]).select("bh", "band", "members", "node"), "members")
    wanted = members.select("node").distinct().join(classes, "node").select("node", "first", "copies", "n", "bands")
    same = F.col("doc_id").eqNullSafe(F.col("first")["doc_id"]) & (F.col("sig") == F.col("first")["sig"])
    texts = (docs.join(wanted, same).groupBy("node").agg(*[F.first(c).alias(c) for c in ("text", "copies", "n", "bands")]))
    cuts = F.ceil(F.col("members") / block).cast("int")
    tasks = (members.withColumn("cuts", cuts).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .select("bh", "band", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    found = stage(verified(tasks.join(texts, "node"), exact, n), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = (classes.select("node", "h1", "h2", "n", "copies", F.col("first")["doc_id"].alias("least_id")).join(links, "node", "left").join(label, "node", "left")
              .withColumn("label", F.coalesce("label", "node")))
    joined = stage(joined, "classes")
    least = stage(joined.groupBy("label").agg(F.min("least_id").alias("class_id")), "least")
    verdict = stage(joined.join(least, "label").select("h1", "h2", "n", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "verdict")
    return sigs.select("doc_id", "sig", "h1", "h2", "n").join(verdict, ["h1", "h2", "n"], "left").select(
        "doc_id", "sig", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n", "label")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """Rows of ``df`` without the documents whose class has a smaller doc_id; texts without n-grams all stay.

    Other columns may have any name. Where the smallest id repeats in a class, the row with the smallest text hash stays, once. Classes
    are told apart by their label, so unlinked documents with null or equal ids all stay.
    """
    rows = similar_rows(df, id_col=id_col, text_col=text_col, **kwargs)
    own = rows.where("n > 0").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id", "sig").agg(F.count(F.lit(1)).alias("same"))
    best = own.groupBy("label").agg(F.min(F.struct("sig", "same", "doc_id")).alias("b")).select(F.col("b.doc_id").alias("__id"), F.col("b.sig").alias("__sig"), F.col("b.same").alias("__same"))
    blank = rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), F.lit(1).cast("long").alias("__same")).distinct()
    chosen = stage(best.unionByName(blank), "kept")
    kept = df.withColumn("__hash", text_hash(F.col(text_col))).join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__sig")))
    once = kept.where("__same > 1").dropDuplicates(["__id", "__sig"])
    return kept.where("__same = 1").unionByName(once).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_rows(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM docs, range(1, greatest(len(words) - 4, least(len(words), 1)) + 1) t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)) AS class_id, (SELECT count(*) FROM links WHERE x = doc_id) AS n_links
FROM documents
"""
