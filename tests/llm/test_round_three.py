"""Spelling variants, SimHash and the prefix trie against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tapelab.llm import chat, prefix_trie, simhash, spelling
from tests.llm.fixtures import DOCS, messy, messy_rows, with_clashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


# ---- spelling -------------------------------------------------------------------------------------------------------
def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_grouped(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if v != w and is_near(w, v)]
        best = min(near, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (n, len(near), -best[0] if forms[w] else None)
    rows = []
    for w, (n, k, fn) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, k, fn))
    return sorted(rows)


def brute_counts(rows, least_length=7, least_count=2):
    found = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def test_variants_of_texts(spark):
    rng = random.Random(5)
    base = ["Organisation", "organization", "Éclairage", "éclairage", "aaaaaaaa", "straße×÷", "colourful"]
    text = lambda: " ".join("".join(c for c in w if rng.random() > 0.02) for w in rng.choices(base, [60, 5, 9, 3, 9, 9, 40], k=rng.randrange(60)))
    rows = messy_rows() + [(100 + i, text(), "en", "a", 1) for i in range(120)] + [(None, "organisation Organisation1organisatio", "en", "a", 1)] * 2
    rows += [(500 + k, "x" * 3000 + "yz"[k % 2] + "w" * 2000, "en", "a", 1) for k in range(8)]
    got = sorted((tuple(r) for r in spelling.variants(with_clashes(messy(spark, rows))).collect()), key=lambda r: r[0])
    want = brute_grouped(brute_counts(rows))
    assert got == want and any(r[1] for r in got) and any(len(r[0]) > 5000 and r[4] for r in got)
    assert spelling.variants(messy(spark).limit(0)).count() == 0


@pytest.mark.parametrize("most", [2, 9, 2000])
def test_crowded_parts_are_dealt_again(spark, most):
    rng = random.Random(most)
    counts = {}
    for _ in range(160):
        counts["prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "suffix"])] = rng.randrange(2, 400)
    vocab = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = sorted((tuple(r) for r in spelling.grouped(vocab, most=most).collect()), key=lambda r: r[0])
    assert got == brute_grouped(counts)


def test_composition_lists_every_pair_once():
    for seed in range(60):
        rng = random.Random(seed)
        ws = sorted({"".join(rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 40))})
        places = rng.choice([1, 2, 3, 99])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        got = sorted(tuple(sorted((h + a + x, h + b + x))) for h, a, b, x in spelling.OneEdit(spelling.Acceptor(ws)).pairs(places))
        assert got == sorted((a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if is_near(a, b) and common(a, b) < places)


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("", "ing", "ings", "s")))
    assert len(a.arcs) == 9  # start, after a, after c, after e, one for all three heads, then n, g, s and the end


# ---- SimHash --------------------------------------------------------------------------------------------------------
def brute_fingerprint(t):
    w = WORD.findall((t or "").translate(LOWER))
    runs = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance):
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(root(k)))) for k, ((i, *_), f) in enumerate(zip(rows, fp)))


def almost_equal(n, seed, length=400, most=6):
    rng = random.Random(seed)
    base = words(rng, length, 5000).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(length)] = f"New{rng.randrange(10**6)}"
        out.append((1000 * seed + k, " ".join(w), "en", "a", 1))
    return out


@pytest.mark.parametrize("grid,block", [(None, 1024), (simhash.Grid(2, 1, 2), 1024), (simhash.Grid(4, 3, 1), 4), (simhash.Grid(8, 4, 1), 16)])
def test_near_duplicates(spark, grid, block):
    rows = messy_rows() + almost_equal(40, 1) + almost_equal(30, 2, 200) + [(9000, "\t NO  id\nHERE \x0b", "en", "a", 1), (9001, "no id here", "en", "b", 1)]
    got = simhash.near_duplicates(with_clashes(messy(spark, rows)), grid=grid, block=block).collect()
    want = brute_components(rows, 4)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert 10 < len({c for *_, c in want}) < len(rows) - 20


def test_no_documents(spark):
    assert simhash.near_duplicates(messy(spark).limit(0)).count() == 0


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for width in (2, 4, 8):
        counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(i)) & np.uint64(2**width - 1)) for i in range(0, 64, width)], 1).astype(int)
        b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
        manhattan = np.abs(counts(a) - counts(b)).sum(1)
        assert (np.bitwise_count(simhash.unary(a, width) ^ simhash.unary(b, width)) == manhattan).all()
        assert (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("grid", [simhash.Grid(2, 2, 1), simhash.Grid(2, 1, 2), simhash.Grid(4, 2, 1), simhash.Grid(4, 4, 1)])
def test_close_fingerprints_share_a_cell(spark, grid):
    rng = random.Random(4)
    pairs = []
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            y ^= 1 << b
        pairs.append((x, y))
    sign = lambda v: v - 2**64 if v >= 2**63 else v
    points = spark.createDataFrame([(sign(v),) for p in pairs for v in p], "fp long")
    held = collections.defaultdict(set)
    for r in simhash.cells(points, grid).collect():
        held[r.fp].add(r.cell)
    assert all(held[sign(x)] & held[sign(y)] for x, y in pairs)
    got = {frozenset((r.a, r.b)) for r in simhash.linked(points.distinct(), grid, 4, 8).collect()}
    assert {frozenset((sign(x), sign(y))) for x, y in pairs} <= got


def test_finer_cells_for_more_points():
    grids = [simhash.choose_grid(10**k) for k in (3, 6, 9, 11)]
    assert [g.width for g in grids] == sorted((g.width for g in grids), reverse=True) and grids[-1].reach == 2


# ---- prefix trie ----------------------------------------------------------------------------------------------------
CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute_trie(rows, family=20, heads=4):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = own.get(c - int(np.fmod(c, family)), [])
        made[c] = base[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        tokens = (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += tokens
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted(((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], digest(p)) for p, cs in members.items()),
                  key=lambda r: (r[0], r[1]))


def trie(df, **kwargs):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **kwargs).collect()), key=lambda r: (r[0], r[1]))


def talk(seed, n, most, vocabulary=3):
    rng = random.Random(seed)
    return [(c, t, ("user", "assistant")[t % 2], words(rng, rng.randrange(3), vocabulary)) for c in range(n) for t in range(rng.randrange(most))]


def odd_talk():
    rows = talk(7, 60, 9)
    rows += [(None, 0, "user", "nobody"), (3, None, None, None), (3, None, "user", "first"), (5, 2, None, "x y"), (5, 2, "user", None)]
    rows += [(80, 1, "user", "again")] * 3 + [(-23, t, "user", f"below {t}") for t in range(3)] + [(-20, 0, "user", "base of below")]
    rows += [(99, t, "user", "long") for t in range(700)] + [(2**60 + 21, 0, "user", "far"), (1009, 0, "user", words(random.Random(1), 9000))]
    return rows


def test_trie_of_odd_conversations(spark):
    rows = odd_talk()
    df = with_clashes(spark.createDataFrame(rows, CONVERSATIONS)).repartition(5)
    assert trie(df) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_many_members_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(2 if c % 3 else 1)]
    assert trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(4)) == brute_trie(rows)


def random_tree(kind, n, rng):
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "star":
        return [None] + [0] * (n - 1)
    if kind == "caterpillar":
        return [None] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, n)]
    if kind == "broom":
        return [None] + [i - 1 if i < n // 2 else n // 2 - 1 for i in range(1, n)]
    return [None] + [rng.randrange(max(0, i - rng.choice([1, 3, n])), i) for i in range(1, n)]


@pytest.mark.parametrize("kind", ["one", "chain", "star", "caterpillar", "broom", "random"])
def test_subtree_sums(spark, kind):
    rng = random.Random(kind)
    parent = random_tree(kind, 1 if kind == "one" else 120, rng)
    value = [(rng.randrange(9), rng.randrange(-5, 5)) for _ in parent]
    total = [list(v) for v in value]
    for i in range(len(parent) - 1, 0, -1):
        for k in (0, 1):
            total[parent[i]][k] += total[i][k]
    tree = spark.createDataFrame([(i, p, *v) for i, (p, v) in enumerate(zip(parent, value))], "key long, parent long, a long, b long")
    got = {r.key: [r.a, r.b] for r in prefix_trie.subtree_sums(tree, ["a", "b"]).collect()}
    assert got == dict(enumerate(total))


def test_sums_of_no_tree(spark):
    assert prefix_trie.subtree_sums(spark.createDataFrame([], "key long, parent long, a long"), ["a"]).count() == 0


# ---- chat ids -------------------------------------------------------------------------------------------------------
def test_chat_keeps_large_ids_beside_null(spark):
    ids = [2**60 + 1, 2**60 + 3, None, -5]
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} <#\\\\") for c in ids for t in range(3)]
    got = chat.digests(chat.read_back(chat.segments(spark.createDataFrame(rows, CONVERSATIONS).coalesce(1)))).collect()
    told = lambda c: "".join(f"{r}\n{x}\n" for k, _, r, x in rows if k == c)
    assert {r.conv_id: r.turns_sha256 for r in got} == {c: hashlib.sha256(told(c).encode()).hexdigest() for c in ids}
    assert {r.conv_id: r.loss_sha256 for r in got} == {c: hashlib.sha256(f"text {c} 1 <#\\\\".encode()).hexdigest() for c in ids}
    assert chat.digests(chat.read_back(chat.segments(spark.createDataFrame([], CONVERSATIONS)))).count() == 0
