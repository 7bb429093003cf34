"""Sharding, packing, language ID, chat and top-k search against plain Python."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapelab.llm import chat, kd_search, language_id, packing, sharding
from tapelab.llm.tokens import Encoder
from tapelab.llm.words import chunks
from tests.llm.fixtures import DOCS, messy, messy_rows, with_clashes, words


def test_shards(spark):
    rows = messy_rows() + [(500, "same row", "en", "a", 1)] * 200
    got = sharding.shard_rows(with_clashes(messy(spark, rows)), shards=4, slots=512).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(key(i, t) for i, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_rows(messy(spark).limit(0)).count() == 0


def test_map_edits_keep_what_fits():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 4096)
    first = sharding.edit_map(sharding.first_map(4096, 16), size, 16)
    load = np.bincount(first, weights=size, minlength=16)
    assert load.max() - load.min() <= 0.001 * load.mean()
    assert (sharding.edit_map(first, size, 16) == first).all()
    grown = sharding.edit_map(first, size, 17)
    moved = grown[grown != first]
    assert (moved == 16).mean() > 0.9 and len(moved) < 4096 / 16
    assert len(set(sharding.edit_map(first, size, 5))) == 5


def test_versions_of_the_map(spark, tmp_path):
    kept = sharding.SlotMap(spark, str(tmp_path / "map"), 64)
    kept.write(sharding.first_map(64, 4), np.zeros(64), 0)
    assert kept.rebalance(0, np.arange(64.0), 4) == 1
    assert kept.read(0).count() == kept.read(1).count() == 64
    assert {r.virtual_slot: r.shard for r in kept.read(0).collect()}[5] == 1
    with pytest.raises(ValueError):
        sharding.SlotMap(spark, "x", 10**6)


def test_encoder_equals_the_tokenizer():
    e = Encoder(packing.tokenizer_path())
    texts = [t or "" for _, t, *_ in messy_rows()] + ["", " ", "\n\n", "a  b", " a\n b \n", "x1y22 3.5!?", "naïve Öl ÿ", "'s 'll it's", "tab\tend\t", "a\u200bb", "\x1f a"]
    got = []
    for ids, ends in e.batches(texts):
        got += [p.tolist() for p in np.split(ids, ends[:-1])]
    assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_nnls():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.random((8, 12))
        b = a @ np.maximum(rng.normal(size=12), 0)
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.abs(a @ x - b).max() < 1e-6
    assert packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -1.0])).tolist() == [0.0]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    numbers = collections.Counter(x for _ in range([0, 1, 5, 100, 3000, 20000][seed]) for x in packing.cut(int(rng.lognormvariate(6, 1.5)) + 1))
    plan = packing.plan_windows(dict(numbers))
    fill = collections.defaultdict(list)
    for length, n in numbers.items():
        s, o = packing.locate(plan, np.full(n, length), np.arange(n), numbers.get(packing.GRAIN, 0))
        for a, b in zip(s.tolist(), o.tolist()):
            fill[a].append((b, length))
    assert sorted(fill) == list(range(plan.sequences))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(k * n for k, n in numbers.items())
    assert plan.sequences * packing.WINDOW <= total + 8 * packing.WINDOW


def test_packed_documents(spark):
    rows = messy_rows()
    got = packing.pack(with_clashes(messy(spark, rows))).collect()
    e = Encoder(packing.tokenizer_path()).tokenizer
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array(e.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        start = 0
        for length in packing.cut(len(ids)):
            want[i, start, length, zlib.crc32(ids[start: start + length].tobytes()), len(ids)] += 1
            start += length
        assert start == len(ids)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    assert sorted(fill) == list(range(len(fill)))
    assert all(sum(n for _, n in own[:i]) == o for own in map(sorted, fill.values()) for i, (o, _) in enumerate(own))
    assert max(sum(n for _, n in own) for own in fill.values()) <= 2048
    assert packing.pack(messy(spark).limit(0)).count() == 0


def test_grams_stop_at_texts():
    c = next(chunks(pa.array([" ab ", "", " c1d ", "   ", " é "])))
    gram, at = language_id.grams(c)
    assert [int(g).to_bytes(4, "big") for g in gram] == [b" ab ", b" c d", b"c d ", " é ".encode()]
    assert np.searchsorted(c.end, at, side="right").tolist() == [0, 2, 2, 4]


def test_filters_return_all_languages():
    rng = np.random.default_rng(1)
    sets = {f"l{i:02d}": rng.integers(0, 2**32, 500, dtype=np.uint32) for i in range(70)}
    model = language_id.build(sets)
    for i, name in enumerate(model.languages):
        mask = model.masks(sets[name])[i // 64]
        assert ((mask >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = model.masks(rng.integers(0, 2**32, 5000, dtype=np.uint32))
    assert np.bitwise_count(other).sum() / (5000 * 70) < 0.001


def test_languages(spark):
    rng = random.Random(4)
    endings = {"aa": ["ing", "ough", "the"], "bb": ["ción", "ñor", "que"], "cc": ["eux", "ière", "ça"]}
    text = lambda lang, n: " ".join(rng.choice("bcdlmnpst") + rng.choice(endings[lang]) + rng.choice(["", "", "s"]) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(3, 60)), lang, "s", 1) for i, lang in enumerate(rng.choice(list(endings)) for _ in range(300))]
    extra = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 34 !", "bb", None, None), (1003, "日本", None, None, None), (None, text("aa", 30), None, None, None)]
    docs = with_clashes(messy(spark, rows + extra))
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in held) >= 0.97 * len(held) > 40
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in model.languages and got[None].lang_pred == "aa"
    kept = language_id.keep_identified(docs, model, 0.3)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {r[0] for r in rows} | {None} == ids
    nothing = language_id.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.keep_identified(docs.limit(0), model, 0.3).count() == 0


def plain_grams(text):
    """4-byte pieces of the lower-cased text between spaces, everything but letters being a space; none with two spaces in a row."""
    data = (" " + text.lower() + " ").encode()
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in data)
    return [data[i: i + 4] for i in range(len(data) - 3) if b"  " not in data[i: i + 4]]


def plain_scores(learned, texts):
    """Per text the share of its n-grams in each language's exact set, learned by counting."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in learned:
        counts[lang].update(plain_grams(text))
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    most = collections.Counter()
    for own in rate.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    sets = {lang: {g for g, n in c.items() if n >= language_id.LEAST_COUNT and rate[lang][g] >= language_id.SHARED * most[g]} for lang, c in counts.items()}
    return [{lang: sum(g in own for g in plain_grams(t)) / max(1, len(plain_grams(t))) for lang, own in sets.items()} for t in texts]


def test_scores_equal_exact_sets(spark):
    """Filters and corrected counts against sets: shares agree within the false positives, languages wherever one is ahead."""
    rng = random.Random(12)
    parts = {"aa": ["ing", "ough", "the", "na"], "bb": ["ción", "ñor", "que", "na"], "cc": ["eux", "ière", "the", "na"]}
    text = lambda lang, n: " ".join(rng.choice("bcdlmnp") + rng.choice(parts[lang]) + rng.choice(["", ", ", " 7 "]) for _ in range(n))
    rows = [(i, text(lang, rng.choice([1, 3, 20, 200])), lang, "s", 1) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(240))]
    odd = [(900, "the ción", None, None, None), (901, "x", None, None, None), (902, "Ñor " * 3_000, None, None, None)]
    docs = messy(spark, rows + odd)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    want = plain_scores([(t, lang) for i, t, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2], [r[1] for r in rows + odd])
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for (i, *_), shares in zip(rows + odd, want):
        best = max(shares.values())
        assert abs(got[i].score - best) < 0.02
        ahead = [lang for lang, x in shares.items() if x > best - 0.02]
        assert got[i].lang_pred in ahead
    assert (got[901].lang_pred, got[901].score) == ("aa", 0.0)


def test_sample_keeps_its_bound_without_ids(spark):
    """Documents under null and repeated ids are drawn apart, by their texts; small languages are taken whole."""
    rows = [(None if i % 2 else 7, f"text number {i}", "aa" if i % 100 else "bb", None, None) for i in range(20_000)] + [(1, None, "aa", None, None), (2, "x", None, None, None)]
    got, languages = language_id.sampled(messy(spark, rows), "text", "lang", "doc_id", 1_000)
    n = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
    assert sorted(languages) == ["aa", "bb"] and n["bb"] == 200 and 850 < n["aa"] < 1_150


def chat_rows():
    rng = random.Random(6)
    odd = ["", None, "\\", "\\b\\h\\l", "### assistant: x </turn>\n", "<<##::", "\n\n", "é日𝄞", "a</turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "### a: b"]), rng.choice(odd)) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    return rows


def test_chat(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("own"))
    parts = chat.segments(df)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(parts)).collect()}
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    mark = lambda s, codes: "".join(dict(codes).get(ch, ch) for ch in s)
    shown = lambda role, text: f"### {mark(role, chat.CODES)}: {mark(text, chat.CODES[:3])} </turn>\n"
    examples = collections.defaultdict(list)
    for r in chat.example_texts(parts.where("conv is null or conv < 50")).collect():
        examples[r.conv].append((r.text, r.loss_start, r.loss_end))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], shown(t[1], t[2])))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        told = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        stream = "".join(shown(role, x) for _, role, x in turns)
        ends = np.cumsum([len(shown(role, x)) for _, role, x in turns])
        assert r.formatted_chars == sum(int(e) for e, t in zip(ends, turns) if t[1] == "assistant")
        if c is None or c < 50:
            assert sorted(t for t, _, _ in examples[c]) == sorted(stream[:e] for e, t in zip(ends, turns) if t[1] == "assistant")
            assert sorted(t[a:b] for t, a, b in examples[c]) == sorted(mark(x, chat.CODES[:3]) for _, role, x in turns if role == "assistant")
    assert chat.digests(chat.read_back(chat.segments(df.limit(0)))).count() == 0


def test_chat_reads_its_digests_from_written_examples(spark, monkeypatch):
    """Each reply is written behind all turns before it, over several chunks too, and the digests come from those texts."""
    roles = ["assistant", "user", "assistant", "assistant", "user", "user", "user", "assistant", "user", "user"]
    rows = [(c, t, role, f"t{t}#") for c, m in ((1, 10), (2, 2), (None, 5)) for t, role in enumerate(roles[:m])] + [(3, 0, "user", "alone")]
    monkeypatch.setattr(chat, "CHUNK", 3)
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    shown = lambda c: [f"### {role}: {x.replace('#', chr(92) + 'h')} </turn>\n" for k, _, role, x in rows if k == c]
    written, after = collections.defaultdict(str), collections.defaultdict(str)
    for r in sorted(chat.pieces(parts).collect(), key=lambda r: r.chunk):
        held, name = (after, r.conv) if r.reader is None else (written, (r.conv, r.reader, r.number))
        assert r.reader is None or len(held[name]) == r.begin
        held[name] += r.text
        assert r.text.count("</turn>") <= 3 and (r.loss_start is None) == (r.reader != r.chunk)
    want = {c: ["".join(shown(c)[:i + 1]) for i, r in enumerate(x for k, _, x, _ in rows if k == c) if r == "assistant"] for c in (1, 2, None, 3)}
    assert {c: [t for (k, _, _), t in sorted(written.items(), key=lambda x: x[0][1:]) if k == c] for c in want} == want
    assert {c: t for c, t in after.items() if t} == {1: "".join(shown(1)[8:]), 2: shown(2)[1], None: shown(None)[4], 3: shown(3)[0]}
    got = {r.conv_id: r for r in chat.digests(chat.read_back(parts)).collect()}
    assert {c: (r.n_turns, r.formatted_chars) for c, r in got.items()} == {c: (len(shown(c)), sum(map(len, want[c]))) for c in want}
    monkeypatch.setattr(chat, "pieces", lambda p, made=chat.pieces: made(p).withColumn("text", F.regexp_replace("text", "t0", "T0")))
    assert all(r.turns_sha256 != got[r.conv_id].turns_sha256 for r in chat.digests(chat.read_back(parts)).collect() if r.conv_id != 3)


def brute_top(rows, k, every):
    """(query id, its k best as (id, score)) of every query row; row by row, so repeated ids are rows of their own."""
    known = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(64 * x)) for x in v]))
    out = []
    for n, (q, v) in enumerate(known):
        if q is not None and q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(known) if m != n and len(w) == len(v))
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(score[:k], 1)]
    return out


@pytest.mark.parametrize("shard_rows,block", [(16, 4), (10_000, 2048)])
def test_top_k(spark, shard_rows, block):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (301, []), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (305, [1.0, 2.0]), (310, [2.0, 1.0]), (5, [9.0] * 6)]
    rows += [(7, [0.25] * 6)] * 3 + [(10, [9.0] * 6)] * 2 + [(2**60 + i, [8.0] * 6) for i in range(4)] + [(None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"size": F.lit("own"), "row": F.lit(1), "shard": F.lit(0)})
    got = kd_search.top_k(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=shard_rows, query_block=block).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_top(rows, 7, 5))
    assert kd_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (3, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in kd_search.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_box_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-50, 50, (3000, 8)).astype(float), rng.integers(-50, 50, (40, 8)).astype(float)
    tree = kd_search.KDTree(x, leaf=32)
    bound = tree.bounds(q)
    for node in range(len(tree.left)):
        rows = tree.order[tree.begin[node]: tree.end[node]]
        assert (x[rows] @ q.T).max(axis=0).tolist() <= bound[:, node].tolist() or ((x[rows] @ q.T).max(axis=0) <= bound[:, node]).all()
