"""Token ids of whole batches of texts, equal to those of the byte-level BPE in a ``tokenizers`` file.

Such a tokenizer first cuts a text into pieces (a run of letters, digits or other signs with the space before it, or white space) and
encodes each piece by itself. Texts of Latin script are cut here with numpy for a whole chunk; only pieces not met before go through the
tokenizer, and their ids are kept by a 64-bit hash of the piece. Any other text (other scripts, control characters, apostrophes, which
have rules of their own) goes through the tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from tapelab.llm.words import BASE, U, mix, run_sums, worker_store

#: Code points below this are cut here.
LATIN = 0x250
SPACE, LETTER, DIGIT, OTHER, ODD = 0, 1, 2, 3, 4
CHUNK_CHARS = 1 << 18
#: Pieces kept per worker process; beyond it the store starts anew, which changes no result.
KEPT_PIECES = 1_000_000
SLOT_BITS = 21


def _classes() -> np.ndarray:
    import regex

    table = np.full(LATIN + 1, ODD, np.uint8)
    for i in range(LATIN):
        c = chr(i)
        if c in "\t\n\x0b\x0c\r ":
            table[i] = SPACE
        elif i < 0x20 or 0x7F <= i <= 0xA0 or c == "'":
            continue
        else:
            table[i] = LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER
    return table


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << SLOT_BITS, U), np.zeros(1 << SLOT_BITS, np.int32), 0
        self.at, self.count = np.zeros(KEPT_PIECES, np.int32), np.zeros(KEPT_PIECES, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def batches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of texts in order: all their ids, and where each text's ids end."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
                size += len(texts[j])
                j += 1
            yield self._group(texts[i:j])
            i = j

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.concatenate(([0], np.cumsum(self.classes[np.minimum(codes, LATIN)] == ODD)))
        ends = np.cumsum(lengths)
        whole = odd[ends] > odd[ends - lengths]
        plain = [t for t, w in zip(texts, whole) if not w]
        ids, upto = self._latin(plain)
        if not whole.any():
            return ids, upto
        parts, begin = [], 0
        slow = iter(self._encode([t for t, w in zip(texts, whole) if w]))
        fast = iter(upto)
        for w in whole:
            if w:
                parts.append(np.array(next(slow), np.uint32))
            else:
                end = next(fast)
                parts.append(ids[begin:end])
                begin = end
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not joined:
            return np.zeros(0, np.uint32), ends
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[codes]
        n = len(codes)
        edge = np.zeros(n + 1, bool)  # where a text begins
        edge[np.concatenate(([0], ends))] = True
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank = kind == SPACE
        # The last white space before a sign begins a piece: alone, or with what follows if it is a space.
        before_sign = np.zeros(n, bool)
        before_sign[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:-1]
        after_space = np.zeros(n, bool)
        after_space[1:] = before_sign[:-1] & (codes[:-1] == 0x20)
        begin = np.flatnonzero((change & ~after_space) | before_sign)
        end = np.append(begin[1:], n)
        which = self._look_up(joined, mix(run_sums(codes.astype(U) + U(1), begin, end, BASE) ^ mix((end - begin).astype(U), 11)), begin, end)
        count = self.count[which]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.at[which] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, ends, side="left")]

    def _look_up(self, joined: str, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = self._find(key)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first = np.unique(key[missing], return_index=True)
            if self.n + len(fresh) > KEPT_PIECES:
                self._forget()
                missing = np.arange(len(key))
                fresh, first = np.unique(key, return_index=True)
            b, e = begin[missing[first]], end[missing[first]]
            for k, ids in zip(fresh.tolist(), self._encode([joined[i:j] for i, j in zip(b.tolist(), e.tolist())])):
                self._keep(k, ids)
            found[missing] = self._find(key[missing])
        return found

    def _find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int64)
        slot = (key >> U(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _keep(self, key: int, ids: list[int]) -> None:
        slot = key >> (64 - SLOT_BITS)
        while self.keys[slot]:
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)))
        if self.n >= len(self.at):
            self.at, self.count = np.resize(self.at, 2 * self.n), np.resize(self.count, 2 * self.n)
        self.keys[slot], self.values[slot] = key, self.n
        self.at[self.n], self.count[self.n] = self.used, len(ids)
        self.ids[self.used: self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += 1


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    store = worker_store()
    if store.get("encoder_path") != path:
        store["encoder_path"], store["encoder"] = path, Encoder(path)
    return store["encoder"]
