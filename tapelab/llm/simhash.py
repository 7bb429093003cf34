"""Near-duplicates by SimHash: fingerprints within a few bits of each other, found through a segment-popcount embedding.

A 64-bit fingerprint is cut into short segments and mapped to the number of bits set in each. One differing bit changes one of these
counts by one, so the Manhattan distance of the counts never exceeds the Hamming distance. Candidates come from a range join in a grid of
counts: the segments are dealt into groups, and of ``d`` differing bits some group holds at most ``d // groups``. In that group the two
points lie so close that the cells around them overlap: every point is copied to its own cell and to those within half that distance, and
points that share a cell meet there. Pairs are then held against the Manhattan distance over all segments, and against the fingerprints.

Counts are kept in unary (the bits of every segment sorted), so a Manhattan distance is a bit count of an exclusive or. Equal fingerprints
are one point; crowded cells are cut into blocks that meet pairwise; a block sends out a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapelab.llm.common import join_split, stage, table
from tapelab.llm.components import components
from tapelab.llm.words import IS_WORD, U, Chunk, chunks, mix, signed

#: Fixed values of the registered query.
SHINGLE, DISTANCE, SEED = 4, 4, 42
BITS = 64
#: Points of one cell in a block.
BLOCK = 1024
#: Rows made at once by a task.
ROWS = 1 << 19
#: Cost of a copied point and of a compared pair, in one unit; only their ratio matters.
COPY_COST, PAIR_COST = 200.0, 1.0


@dataclass(frozen=True)
class Grid:
    """Bits per segment, groups of segments, and the reach of a point: steps to the cells that it is copied to."""

    width: int
    groups: int
    reach: int

    @property
    def segments(self) -> list[np.ndarray]:
        """Segments of each group."""
        return np.array_split(np.arange(BITS // self.width), self.groups)

    def masks(self) -> list[int]:
        one = (1 << self.width) - 1
        return [sum(one << int(s) * self.width for s in g) for g in self.segments]


def unary(fp: np.ndarray, width: int) -> np.ndarray:
    """The counts of all segments, each as that many low bits set in its segment."""
    out = np.zeros_like(fp)
    one = U((1 << width) - 1)
    for at in range(0, BITS, width):
        count = np.bitwise_count((fp >> U(at)) & one).astype(U)
        out |= ((U(1) << count) - U(1)) << U(at)
    return out


def choose_grid(points: int, distance: int = DISTANCE) -> Grid:
    """The grid with the least work for so many points: copies made, and pairs that meet by chance if bits are even and independent.

    The result of the join does not depend on it. More points take finer cells, and pay with more copies. ``distance`` is 1 or more.
    """
    best = None
    for width in (2, 4):
        p = np.array([math.comb(width, k) for k in range(width + 1)]) / 2**width
        apart = np.zeros(width + 1)
        for i in range(width + 1):
            for j in range(width + 1):
                apart[abs(i - j)] += p[i] * p[j]
        steps = 2 - p[0] - p[-1]  # neighbours of a count, on average
        for groups in range(1, distance + 1):  # at least one step in a group: a range, not an equality
            near = distance // groups
            grid = Grid(width, groups, -(-near // 2))
            copies = meet = 0.0
            for part in grid.segments:
                total = np.array([1.0])
                for _ in part:
                    total = np.convolve(total, apart)
                meet += total[: 2 * grid.reach + 1].sum()
                n = len(part) * steps
                copies += (1, 1 + n, 1 + n + n * n / 2)[min(grid.reach, 2)]
            if grid.reach > 2:
                continue
            cost = points * copies * COPY_COST + points * points / 2 * meet * PAIR_COST
            if best is None or cost < best[0]:
                best = (cost, grid)
    return best[1]


def around(code: np.ndarray, part: np.ndarray, width: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cells within ``reach`` steps in the segments ``part``: (move, rows, their codes). Equal moves mean equal steps from home."""
    every = np.arange(len(code))
    yield 0, every, code

    def steps(at: np.ndarray, first: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        for s in part[part >= first].tolist():
            base, field = U(s * width), (at >> U(s * width)) & U((1 << width) - 1)
            count = np.bitwise_count(field).astype(U)
            for up in (0, 1):
                ok = np.flatnonzero(count < U(width) if up else count > U(0))
                bit = U(1) << (base + count[ok] - U(0 if up else 1))
                yield s, up, 2 * s + up, ok, at[ok] ^ bit

    if reach >= 1:
        for s, up, move, rows, cell in steps(code, 0):
            yield 1 + move, rows, cell
            if reach >= 2:
                for s2, up2, move2, rows2, cell2 in steps(cell, s):
                    if s2 > s or up2 == up:
                        yield (1 + move) * (2 * BITS + 1) + 1 + move2, rows[rows2], cell2


def cells(points: DataFrame, grid: Grid) -> DataFrame:
    """cell, move (0: at home), fp: every point in the cells that it reaches. A cell is a hash of its counts and its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = ROWS // (1, 64, 2048)[grid.reach]
        for batch in batches:
            whole = np.ascontiguousarray(batch.column(0).to_numpy()).view(U)
            for i in range(0, len(whole), at_once):
                fp = whole[i: i + at_once]
                code = unary(fp, grid.width)
                for g, (part, mask) in enumerate(zip(grid.segments, grid.masks())):
                    made = [(move, rows, mix(cell, g + 1)) for move, rows, cell in around(code & U(mask), part, grid.width, grid.reach)]
                    rows = np.concatenate([r for _, r, _ in made])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate([c for *_, c in made]))), pa.array(np.repeat(np.array([m for m, *_ in made], np.int32), [len(r) for _, r, _ in made])),
                         pa.array(signed(fp[rows]))], ["cell", "move", "fp"])

    return points.select("fp").mapInArrow(run, "cell long, move int, fp long")


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels in place until rows i and j have the same; a label is a row with its own label."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links(key: np.ndarray, move: np.ndarray, block: np.ndarray, alone: np.ndarray, fp: np.ndarray, width: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (fp, fp) among rows with equal ``key`` (rows are sorted by it). Work is one comparison per pair, in vectors.

    Points of one home cell are compared there only. Rows of two different blocks are compared where these meet, rows of one where it
    stands ``alone``.
    """
    code, label = unary(fp, width), np.arange(len(key))
    at, k = np.arange(len(key)), 0
    while len(at):
        k += 1
        at = at[at + k < len(key)]
        at = at[key[at] == key[at + k]]
        to = at + k
        asked = np.where(move[at] == move[to], move[at] == 0, True) & (alone[at] | (block[at] != block[to]))
        i, j = at[asked], to[asked]
        near = np.bitwise_count(code[i] ^ code[j]) <= distance
        i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        join_labels(label, i[near], j[near])
    moved = np.flatnonzero(label != np.arange(len(key)))
    return fp[moved], fp[label[moved]]


def linked(points: DataFrame, grid: Grid, distance: int, block: int) -> DataFrame:
    """(a, b): forest edges between fingerprints at most ``distance`` bits apart."""
    spread = cells(points, grid)
    crowded = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block)
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = (spread.join(crowded.select("cell", blocks.alias("blocks")), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    meet = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")))
    tasks = dealt.select(meet.alias("key"), "move", "block", (F.col("block") == F.col("other")).alias("alone"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def close(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links(*rows[:4], np.ascontiguousarray(rows[4]).view(U), grid.width, distance)
            return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                new = [np.concatenate(x) for x in zip(rest, new)]
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            rest = [c[cut:] for c in new]
            if cut:
                yield close([c[:cut] for c in new])
        if rest is not None and len(rest[0]):
            yield close(rest)

    return tasks.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def shingle_spans(c: Chunk, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z lowered and one space between, with text, begin and end of every run of ``n`` words in order.

    A text of fewer words has one run, all its words; one without words has none.
    """
    b, e = c.spans
    data = c.data + np.where((c.data >= 65) & (c.data <= 90), 32, 0).astype(np.uint8)
    keep = IS_WORD[c.data]
    inner = b[1:][c.text_of[1:] == c.text_of[:-1]] - 1
    keep[inner], data[inner] = True, 0x20
    place = np.concatenate(([0], np.cumsum(keep)))
    begin, end = place[b], place[e]
    first = np.arange(len(b))
    last = first + n - 1
    full = np.zeros(len(b), bool)
    if len(b) >= n:
        full[: len(b) - n + 1] = c.text_of[: len(b) - n + 1] == c.text_of[n - 1:]
    short = np.flatnonzero((c.counts > 0) & (c.counts < n))
    full[c.word_from[short]] = True
    last[c.word_from[short]] = c.word_from[short + 1] - 1
    run = np.flatnonzero(full)
    return data[keep].tobytes(), c.text_of[run], begin[run], end[last[run]]


def chunk_fingerprints(c: Chunk, n: int = SHINGLE, seed: int = SEED, at_once: int = 1 << 15) -> np.ndarray:
    """One fingerprint per text: a bit is set if it is in over half the hashes of the text's runs. Whole texts, in bounded memory."""
    from xxhash import xxh64_intdigest

    joined, owner, begin, end = shingle_spans(c, n)
    ones, total = np.zeros((len(c.end), BITS), np.int64), np.bincount(owner, minlength=len(c.end))
    for i in range(0, len(owner), at_once):
        own = owner[i: i + at_once]
        spans = zip(begin[i: i + at_once].tolist(), end[i: i + at_once].tolist())
        h = np.fromiter((xxh64_intdigest(joined[s:t], seed) for s, t in spans), U, len(own))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(U).reshape(-1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                fp = chunk_fingerprints(c, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(fp)), pa.array(signed(fp))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(df: DataFrame, distance: int = DISTANCE, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                    grid: Grid | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts without a word (null, empty, blank) have fingerprint zero and link like any other. Repeated rows are documents of their own
    with the same component. A component whose documents all have a null id has a null component_id. Other columns do not matter. An
    empty table gives an empty result.
    """
    docs = stage(fingerprints(df, id_col, text_col, n), "fingerprints")
    points = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    edges = stage(linked(points, grid or choose_grid(points.count(), distance), distance, block), "links")
    label = components(edges)
    named = points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stage(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stage(named.join(least, "label").select("fp", "component_id"), "components")
    return join_split(docs, found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
