"""Substring dedup on a de Bruijn graph of token k-mers, compacted into paths.

A window of 35 words is an edge between the 34-word runs at its ends. Consecutive windows of a text that share their minimizer (the smallest
hash of a 10-word run inside) form a path, which is one row from the start: about one per 13 edges. Equal windows have equal minimizers, so
paths meet by minimizer in Spark joins:

* minimizers met once hold no repeated window and drop out;
* a path met again with the same words is repeated as a whole (a nonbranching stretch of the graph), and its edges are never listed;
* only where different paths share a minimizer, i.e. where the graph branches, are paths listed edge by edge (equal paths once), and
  edges are counted exactly.

Path and edge marks return to their source coordinates (document, first word), where overlapping spans grow together and are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.llm.common import stage, table
from tapelab.llm.words import RUN_BASE, U, Chunk, chunks, mix, run_sums, signed

#: Fixed values of the registered query: words in a window. A minimizer is a run of so many words in it.
WINDOW = 35
MINIMIZER = 10


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size: width - size + n])


@dataclass
class Paths:
    """Paths of a chunk: text, first word (in the chunk), number of windows, minimizer, hash of all words; ``folded`` if the
    minimizer stands more than once inside, so that a window may repeat within the path."""

    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    minimizer: np.ndarray
    path: np.ndarray
    folded: np.ndarray

    def edges(self, c: Chunk, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of some paths: path index, first word in the chunk, hash."""
        n = self.windows[which]
        index = np.repeat(which, n)
        first = self.first[index] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return index, first, mix(run_sums(c.hashes, first, first + window, RUN_BASE), 5)


def paths(c: Chunk, window: int = WINDOW, k: int = MINIMIZER) -> Paths | None:
    at, value = c.runs(k)
    words = len(c.hashes)
    if words < window:
        return None
    run_hash = np.full(words, 2**64 - 1, U)
    run_hash[at] = value
    first = np.arange(words - window + 1)
    inside = c.text_of[first] == c.text_of[first + window - 1]
    first = first[inside]
    if not len(first):
        return None
    low = sliding_min(run_hash, window - k + 1)[first]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (first[1:] != first[:-1] + 1)))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first))
    b, e = first[begin], first[end - 1] + window
    n = end - begin
    # Where the minimizer stands in a path: runs equal to it that begin in the path's words.
    spot = np.concatenate(([0], np.cumsum(n + window - k)))
    runs = np.repeat(b - spot[:-1], n + window - k) + np.arange(spot[-1])
    hits = np.concatenate(([0], np.cumsum(run_hash[runs] == np.repeat(low[begin], n + window - k))))
    return Paths(c.text_of[b], b, n, low[begin], mix(run_sums(c.hashes, b, e, RUN_BASE) ^ mix(n.astype(U), 13)), hits[spot[1:]] - hits[spot[:-1]] > 1)


def lists(batch: pa.RecordBatch, i: int, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A list column for the texts of a chunk: text and value of every entry; null lists are empty."""
    part = [x or () for x in batch.column(i).slice(c.first, len(c.end)).to_pylist()]
    return np.repeat(np.arange(len(part)), [len(x) for x in part]), np.array([v for x in part for v in x], np.int64)


def among(text: np.ndarray, value: np.ndarray, owner: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Whether each value is in its text's list."""
    key = lambda t, v: mix(v ^ mix(t.astype(U), 17))
    return np.isin(key(text, value), key(owner, given.view(U)))


def tag(id_col: Column, text_col: Column) -> Column:
    """Row identity by content; rows that repeat share it, which is harmless: what holds for one holds for the other."""
    return F.xxhash64(id_col, F.coalesce(text_col, F.lit("")))


def path_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                if (p := paths(c, window, k)) is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(p.minimizer)), pa.array(signed(p.path)), pa.array(tags[c.first + p.text]), pa.array(np.where(p.folded, 2, 1).astype(np.int8))],
                        ["minimizer", "path", "tag", "weight"])

    return docs.select("tag", "text").mapInArrow(run, "minimizer long, path long, tag long, weight byte")


def edge_rows(marked: DataFrame, window: int, k: int) -> DataFrame:
    """Windows of listed paths: minimizer, edge, tag, at (word in the document), open (not known to repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                if (p := paths(c, window, k)) is None:
                    continue
                alone = np.flatnonzero(among(p.text, p.path, *lists(batch, 2, c)))
                shown = np.flatnonzero(among(p.text, p.path, *lists(batch, 3, c)))
                shown = shown[np.unique(np.stack((p.text[shown].astype(U), p.path[shown])), axis=1, return_index=True)[1]] if len(shown) else shown
                which = np.concatenate((alone, shown))
                if not len(which):
                    continue
                index, first, edge = p.edges(c, which, window)
                text = p.text[index]
                is_open = np.repeat(np.arange(len(which)) < len(alone), p.windows[which])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(p.minimizer[index])), pa.array(signed(edge)), pa.array(tags[c.first + text]),
                     pa.array((first - c.word_from[text]).astype(np.int32)), pa.array(is_open)], ["minimizer", "edge", "tag", "at", "open"])

    return marked.select("tag", "text", "alone", "shown").mapInArrow(run, "minimizer long, edge long, tag long, at int, open boolean")


def cut_rows(marked: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 from (doc_id, text, whole: repeated paths, single: first words of repeated windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                n = len(c.end)
                step = np.zeros(len(c.hashes) + 1, np.int64)
                owner, whole = lists(batch, 2, c)
                if len(whole) and (p := paths(c, window, k)) is not None:
                    hit = np.flatnonzero(among(p.text, p.path, owner, whole))
                    np.add.at(step, p.first[hit], 1)
                    np.add.at(step, p.first[hit] + p.windows[hit] - 1 + window, -1)
                owner, single = lists(batch, 3, c)
                np.add.at(step, single + c.word_from[owner], 1)
                np.add.at(step, single + c.word_from[owner] + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                removed = np.bincount(c.text_of[gone], minlength=n)
                digest = kept_digests(c, ~gone)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, n), pa.array(c.counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                                                  pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.select("doc_id", "text", "whole", "single").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_digests(c: Chunk, keep: np.ndarray) -> list[str]:
    """SHA-256 of each text's kept words joined by one space."""
    begin, end = (x[keep] for x in c.spans)
    size = end - begin + 1
    total = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(begin - total[:-1], size) + np.arange(total[-1])
    out = c.data[np.minimum(source, max(0, len(c.data) - 1))] if len(source) else np.zeros(0, np.uint8)
    out[total[1:] - 1] = 0x20
    upto = total[np.concatenate(([0], np.cumsum(np.bincount(c.text_of[keep], minlength=len(c.end)))))]
    raw = memoryview(out.tobytes())
    return [hashlib.sha256(raw[b: max(b, e - 1)]).hexdigest() for b, e in zip(upto[:-1].tolist(), upto[1:].tolist())]


def marks(docs: DataFrame, window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """tag, whole, single: repeated paths and first words of other repeated windows, per document that has any."""
    rows = stage(path_rows(docs, window, k), "paths")
    met = stage(rows.groupBy("minimizer").agg(F.sum("weight").alias("n")).where("n > 1").select("minimizer"), "met")
    rows = stage(rows.join(met, "minimizer"), "paths-met")
    per_path = stage(rows.groupBy("minimizer", "path").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("shown_by")), "per-path")
    branches = stage(per_path.groupBy("minimizer").agg(F.count(F.lit(1)).alias("paths")), "branches")
    state = stage(per_path.join(branches, "minimizer"), "state")
    told = rows.join(state, ["minimizer", "path"]).select(
        "tag", F.when(F.col("n") > 1, F.col("path")).alias("whole"), F.when(F.col("n") == 1, F.col("path")).alias("alone"),
        F.when((F.col("n") > 1) & (F.col("paths") > 1) & (F.col("tag") == F.col("shown_by")), F.col("path")).alias("shown"))
    told = stage(told.groupBy("tag").agg(*[F.collect_set(c).alias(c) for c in ("whole", "alone", "shown")]), "told")
    listed = told.where("size(alone) > 0 or size(shown) > 0").select("tag", "alone", "shown").join(docs.select("tag", "text"), "tag")
    edges = stage(edge_rows(listed, window, k), "path-edges")
    again = stage(edges.groupBy("minimizer", "edge").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open")).where("n > 1 and any_open").select("minimizer", "edge"), "edges-again")
    single = edges.where("open").select("minimizer", "edge", "tag", "at").join(again, ["minimizer", "edge"]).groupBy("tag").agg(F.collect_set("at").alias("single"))
    return stage(told.where("size(whole) > 0").select("tag", "whole").join(single, "tag", "full"), "marks")


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = MINIMIZER) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window over it stands anywhere else too, in this text or another; windows are judged on the input. Null and short
    texts lose nothing. Repeated rows are documents too, so all their windows repeat. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), tag(F.col(id_col), F.col(text_col)).alias("tag"))
    return cut_rows(docs.join(marks(docs, window, k), "tag", "left"), window, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM docs, range(1, len(words) - 33) t(i)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS spot FROM windows SEMI JOIN again USING (h)),
cut AS (SELECT doc_id, list(spot) AS spots FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(coalesce(spots, [])) AS n_removed,
       sha256(array_to_string(CASE WHEN spots IS NULL THEN words ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(spots, j)] END, ' ')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
