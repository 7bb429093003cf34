"""MinHash join, components and span dedup against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tapelab.llm import minhash_join, repeated_spans
from tapelab.llm.components import components
from tapelab.llm.words import chunks
from tests.llm.fixtures import DOCS, messy, messy_rows, with_clashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_runs():
    texts = ["a b", None, "", " \n", "same words here", "x same words here y", "a\x85b é\x1fc", "b"]
    seen, runs = [], collections.defaultdict(set)
    for c in chunks(pa.array(texts), limit=8):
        b, e = c.spans
        seen += [bytes(c.data[i:j]).decode() for i, j in zip(b, e)]
        at, h = c.runs(3)
        for i, x in zip(at, h):
            runs[int(x)].add(c.first + int(c.text_of[i]))
    assert seen == [w for t in texts for w in WORD.findall(t or "")]
    assert {4, 5} in runs.values()


def brute_similar(rows, threshold=0.8):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= round(10 * threshold) * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), str(least.get(root(k))), links[k]) for k, (i, *_) in enumerate(rows))


def near_copies(n, seed, length=60):
    rng = random.Random(seed)
    base = words(rng, length, 5000).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(length)] = f"new{rng.randrange(10**6)}"
        out.append((1000 * seed + k, " ".join(w), "en", "a", 1))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_similar_documents(spark, block):
    rows = messy_rows() + near_copies(25, 1) + near_copies(3, 2) + near_copies(40, 3, 30)
    got = minhash_join.similar_rows(with_clashes(messy(spark, rows)), block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_similar(rows)


def test_one_of_each_group_stays(spark):
    rows = messy_rows() + near_copies(12, 1)
    df = with_clashes(messy(spark, rows))
    got = minhash_join.keep_one(df)
    assert got.columns == df.columns
    want = sorted({i for i, c, _ in brute_similar(rows) if i == c and i != "None"} | {"None"})
    assert sorted(str(r.doc_id) for r in got.collect()) == want
    assert minhash_join.keep_one(df.limit(0)).count() == 0


def test_unlinked_documents_with_null_or_equal_ids_stay(spark):
    rng = random.Random(12)
    alone = [(i, words(rng, 30, 9000), "en", "a", 1) for i in [None] * 6 + [5] * 4 + [7]]
    copies = [(i, f"{t} end{k}", "en", "a", 1) for i, t in ((None, words(rng, 100, 9000)), (5, words(rng, 100, 9000))) for k in range(4)]
    got = [(r.doc_id, r.text) for r in minhash_join.keep_one(messy(spark, alone + copies + alone[:2])).collect()]
    assert len(got) == len(set(got)) == len(alone) + 2
    assert {(i, t) for i, t, *_ in alone} <= set(got)


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.99999), (0.5, 0.99), (0.95, 0.999)):
        b, r = minhash_join.choose_bands(t, recall)
        assert b * r <= minhash_join.MAX_HASHES and 1 - (1 - t**r) ** b >= recall
    with pytest.raises(ValueError):
        minhash_join.choose_bands(0.05, 0.99999)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, window):
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    count = collections.Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def cut(df, window, k):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeated_spans.cut_repeats(df, window=window, k=k).collect())


def test_spans_of_messy_rows(spark):
    rows = messy_rows()
    assert cut(with_clashes(messy(spark, rows)), 35, 10) == brute_cut(rows, 35)
    assert repeated_spans.cut_repeats(messy(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed,vocabulary,window,k", [(1, 2, 6, 2), (2, 3, 8, 3), (3, 30, 5, 2), (4, 1, 7, 3), (5, 5, 12, 4)])
def test_spans_branch_everywhere(spark, seed, vocabulary, window, k):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(0, 60), vocabulary), None, None, None) for i in range(60)]
    passage = words(rng, 3 * window, 10**6)
    rows += [(100 + i, f"{words(rng, 9, 999)} {passage} {words(rng, rng.randrange(9), 999)}", None, None, None) for i in range(20)]
    assert cut(messy(spark, rows), window, k) == brute_cut(rows, window)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 26, 200):
        assert repeated_spans.sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(len(x) - w + 1)]
