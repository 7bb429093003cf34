"""Words of whole Arrow batches as numpy arrays: where they stand, 64-bit hashes of them and of runs of them.

A batch's texts lie one after another in one buffer, so words and runs of words are found and hashed for all texts of a chunk at once.
Hashes are polynomials modulo 2**64 followed by a mixing step; equal runs have equal hashes.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one text is never cut).
CHUNK_BYTES = 1 << 18

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

U = np.uint64
#: Odd multipliers, any would do.
BASE, RUN_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads every input bit over the word; one to one."""
    x = x + U((0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def worker_store() -> dict:
    """A store that lasts as long as the worker process. Functions travel by value, so the globals of this module end with a task."""
    return sys.modules.setdefault("_tapelab_worker", types.ModuleType("_tapelab_worker")).__dict__


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n."""
    store = worker_store()
    if len(store.get(base, ((),))[0]) < n:
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(1 << max(18, int(n).bit_length()), b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        store[base] = made
    return store[base][0][:n], store[base][1][:n]


def run_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Sum over i in [begin, end) of values[i] * base**(i - begin), modulo 2**64."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[end] - total[begin]) * down[begin]


@dataclass
class Chunk:
    """Texts ``first`` .. of a batch: bytes of all, and where each begins and ends."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word."""
        w = IS_WORD[self.data]
        full = self.end > self.begin
        before, after = np.zeros_like(w), np.zeros_like(w)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[self.begin[full]] = False
        after[self.end[full] - 1] = False
        return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1

    @cached_property
    def text_of(self) -> np.ndarray:
        """Index of each word's text in the chunk."""
        return np.searchsorted(self.end, self.spans[0], side="right")

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text_of, minlength=len(self.end))

    @cached_property
    def word_from(self) -> np.ndarray:
        """First word of each text, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    @cached_property
    def hashes(self) -> np.ndarray:
        b, e = self.spans
        return mix(run_sums(self.data.astype(U) + U(1), b, e, BASE) ^ mix((e - b).astype(U), 7))

    def runs(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words inside one text, and hashes of the runs."""
        words = self.hashes
        at = np.arange(max(0, len(words) - n + 1))
        if len(at):
            at = at[self.text_of[at] == self.text_of[at + n - 1]]
        return at, mix(run_sums(words, at, at + n, RUN_BASE), seed)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        base = at[i]
        yield Chunk(i, raw[base: at[j]], at[i:j] - base, at[i + 1: j + 1] - base)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
