"""Packing documents into sequences of a fixed number of tokens by non-negative least squares.

Each document is cut into full windows, one piece of whole grains (64 tokens) and one piece of what is left, so there are few lengths:
31 numbers of grains and 63 remainders. Shallow combinations that fill a grain from remainders, and a window from grains, are
enumerated; least squares finds how often each is repeated to use up the histogram; counts are rounded down, and what remains is packed
greedily by decreasing length. All of this works on counts per length. Pieces then find their place by their number within
their length, so no piece ever meets another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import stage, table
from tapelab.llm.tokens import encoder

WINDOW, GRAIN = 2048, 64
#: Fixed values of the registered query: the id that ends a document.
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, window: int = WINDOW, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    full, rest = divmod(n, window)
    return [window] * full + [x for x in (rest - rest % grain, rest % grain) if x]


def combinations(total: int, most: int, largest: int | None = None) -> Iterator[tuple[int, ...]]:
    """Ways to write ``total`` as at most ``most`` parts in decreasing order."""
    if total == 0:
        yield ()
    elif most > 0:
        for part in range(min(total, largest or total), (total - 1) // most, -1):
            for more in combinations(total - part, most - 1, part):
                yield (part, *more)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x of least |ax - b|, by an active set: columns enter by gradient, and leave when they would turn negative."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(6 * n):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if gain.max() <= 1e-9 * scale:
            break
        free[gain.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if trial[free].min() > 0:
                break
            down = free & (trial <= 0)
            step = (x[down] / np.maximum(x[down] - trial[down], 1e-300)).min()
            x = x + step * (trial - x)
            free &= x > 1e-12 * scale
            x[~free] = 0
            if not free.any():
                break
        x = np.where(free, trial, 0) if free.any() else x
    return x


@dataclass
class Plan:
    """Where the n-th piece of a length goes: per length, first numbers of ranges, and the sequence and offset each starts at."""

    ranges: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0
    #: Slots of one grain made of remainders: the same, per remainder, with slots in place of sequences.
    slot_ranges: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    slot_used: dict[int, int] = field(default_factory=dict)

    def place(self, pattern: list[int], times: int) -> None:
        """``times`` sequences that hold these lengths in this order."""
        at = 0
        for length in pattern:
            begin = self.used.get(length, 0)
            self.ranges.setdefault(length, []).append((begin, self.sequences, at))
            self.used[length] = begin + times
            at += length
        self.sequences += times


def repeats(parts: list[tuple[int, ...]], left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: least squares against the counts ``left``, rounded down, which are lowered by that."""
    sizes = sorted(s for s, n in left.items() if n > 0)
    row = {s: i for i, s in enumerate(sizes)}
    usable = [p for p in parts if all(s in row for s in p)]
    if not usable:
        return []
    a = np.zeros((len(sizes), len(usable)))
    for j, p in enumerate(usable):
        for s in p:
            a[row[s], j] += 1
    x = nnls(a, np.array([left[s] for s in sizes], float))
    out = []
    for p, v in sorted(zip(usable, x), key=lambda t: -t[1]):
        times = min([int(v + 1e-6), *(left[s] // p.count(s) for s in p)])
        if times > 0:
            out.append((p, times))
            for s in p:
                left[s] -= times
    return out


def plan_windows(counts: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = 4, slot_depth: int = 3) -> Plan:
    """A plan for ``counts`` pieces per length. Works on counts only, so its cost does not depend on the number of pieces."""
    plan = Plan()
    if counts.get(window):
        plan.place([window], counts[window])
    rest = {r: counts.get(r, 0) for r in range(1, grain)}
    slots = 0
    for parts, times in repeats(list(combinations(grain, slot_depth)), rest):
        at = 0
        for r in parts:
            begin = plan.slot_used.get(r, 0)
            plan.slot_ranges.setdefault(r, []).append((begin, slots, at))
            plan.slot_used[r] = begin + times
            at += r
        slots += times
    grains = {k: counts.get(k * grain, 0) for k in range(1, window // grain)}
    grains[1] = grains.get(1, 0) + slots
    for parts, times in repeats(list(combinations(window // grain, depth)), grains):
        plan.place([k * grain for k in parts], times)
    # Greedy: fill a window with the longest pieces that fit, and repeat that as often as the counts allow.
    left = {k * grain: n for k, n in grains.items() if n > 0} | {r: n for r, n in rest.items() if n > 0}
    while left:
        pattern, room = [], window
        for length in sorted(left, reverse=True):
            take = min(left[length], room // length)
            pattern += [length] * take
            room -= take * length
        times = min(left[length] // pattern.count(length) for length in set(pattern))
        for r in set(pattern):
            if r < grain:  # numbers before these stand in slots
                plan.used.setdefault(r, plan.slot_used.get(r, 0))
        plan.place(pattern, times)
        left = {length: n - times * pattern.count(length) for length, n in left.items()}
        left = {length: n for length, n in left.items() if n > 0}
    return plan


def find(ranges: dict[int, list[tuple[int, int, int]]], length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (or slot) and offset of pieces of one length by their numbers."""
    first, base, offset = map(np.array, zip(*sorted(ranges[length])))
    i = np.searchsorted(first, number, side="right") - 1
    return base[i] + number - first[i], offset[i]


def locate(plan: Plan, length: np.ndarray, number: np.ndarray, own_grains: int, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. ``own_grains``: pieces of one grain, which stand before the slots."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for size in np.unique(length).tolist():
        of = np.flatnonzero(length == size)
        n = number[of]
        in_slot = n < plan.slot_used.get(size, 0)
        if in_slot.any():
            slot, inner = find(plan.slot_ranges, size, n[in_slot])
            s, o = find(plan.ranges, grain, own_grains + slot)
            sequence[of[in_slot]], offset[of[in_slot]] = s, o + inner
        if not in_slot.all():
            sequence[of[~in_slot]], offset[of[~in_slot]] = find(plan.ranges, size, n[~in_slot])
    return sequence, offset


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of a few rows at a time, so that only these stand in memory as Python strings."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int = END_ID) -> DataFrame:
    """Cuts every document; pieces are numbered per length within their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, numbers = encoder(path), TaskContext.get().partitionId(), {}
        for docs, texts in slices(batches):
            at = 0
            for ids, ends in encode.batches(texts):
                rows, begin = [], 0
                for end in ends.tolist():
                    own = np.append(ids[begin:end], end_id).astype("<u4")
                    begin, start = end, 0
                    doc = docs[at].as_py()
                    at += 1
                    for length in cut(len(own)):
                        number = numbers.get(length, 0)
                        numbers[length] = number + 1
                        rows.append((doc, start, length, zlib.crc32(own[start: start + length]), len(own), part, number))
                        start += length
                names, kinds = zip(*(x.split() for x in PIECES.split(", ")))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(zip(*rows), kinds)], list(names))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and one end id, so null and empty texts are one token long. Repeated rows are documents of their own. Every id
    lies in one piece; pieces of a sequence follow each other without gaps, padding only at its end. An empty table gives an empty result.
    """
    cut_docs = stage(pieces(df, path or tokenizer_path(), id_col, text_col), "pieces")
    cells = cut_docs.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length, 95 at most
    plan, own_grains = plan_windows(counts), counts.get(GRAIN, 0)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = cut_docs.join(offsets, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = locate(plan, batch.column(2).to_numpy(), batch.column(5).to_numpy(), own_grains)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
