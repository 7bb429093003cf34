"""Heavy-hitter dedup, URL cascade and source mixing against plain Python."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tapelab.llm import heavy_dedup, mixing, url_cascade
from tests.llm.fixtures import DOCS, messy, messy_rows, with_clashes


def test_dedup_decisions(spark):
    rows = messy_rows() + [(100 + i % 7, "hot", "en", "a", 1) for i in range(400)]
    got = [r.asDict() for r in heavy_dedup.decisions(messy(spark, rows), support=0.1).collect()]
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(-1 if i is None else i)
    assert len(got) == len(rows)
    for r in got:
        own = groups[r["text_sha256"]]
        assert (r["group_size"], -1 if r["keep_id"] is None else r["keep_id"]) == (len(own), max(own))
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == {h: 1 for h in groups}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("support", [0.1, 1e-4])
def test_dedup_rows_keep_their_columns(spark, support):
    rows = messy_rows() + [(100 + i % 7, "hot", "en", "a", 1) for i in range(400)]
    df = with_clashes(messy(spark, rows))
    got = heavy_dedup.keep_one(df, support=support)
    assert got.columns == df.columns
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.key) for r in got.collect()) == sorted((i, t, "own key") for t, i in best.items())


def test_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert heavy_dedup.decisions(empty).count() == 0 and heavy_dedup.keep_one(empty).columns == empty.columns


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.Org", "xexample.org", "com", "b.com", "", ".", "a..org", "com.", "org:80", "ÉX.org"]
    urls = [None, "", "org/", "http:/org/", "://", "://org", "x://y://org/fr/", "http://org?x", "http://org#/", "http://a.org\n/b"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es', '/en/1', '/en/12?q', '/fr/x', '/de/', '/de#', '/FR/'])}" for _ in range(300)]
    df = with_clashes(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id long, url string"))
    for rules in (url_cascade.RULES, []):
        got = url_cascade.judge_urls(df, rules)
        assert got.count() == len(urls) + 1
        for r in got.collect():
            assert (r.host, r.path, r["rule"], r.verdict) == judge(r.url, rules), r.url
            assert r.key == "own key"
    assert url_cascade.judge_urls(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.substring(F.md5("key"), 1, 1) == "0")
    c = url_cascade.build_cascade(listed, universe)
    assert len(c.levels) > 2
    wrong = universe.where(c.contains(F.col("key")) != (F.substring(F.md5("key"), 1, 1) == "0")).count()
    assert wrong == 0
    assert sum(level.bits for level in c.levels) < 40 * listed.count()
    assert url_cascade.build_cascade(listed.limit(0), universe).levels == ()


def test_word_counts(spark):
    rows = messy_rows()
    got = {r.doc_id: r.n for r in messy(spark, rows).select("doc_id", mixing.n_words(F.col("text")).alias("n")).collect()}
    for i, t, *_ in rows:
        assert got[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), i


def test_targets(spark):
    rng = random.Random(5)
    for case in ([("a", 10), ("b", 1000), (None, 5)], [("a", 0), ("b", 0)], [(f"s{i:02d}", rng.randrange(1000)) for i in range(17)], [("z", 7)]):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(case, "source string, source_size long")).collect()}
        order = sorted((s for s, _ in case), key=lambda s: (s is None, s or ""))
        weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
        size = dict(case)
        total, full = Fraction(3, 2) * sum(size.values()), set()
        while True:
            left = total - sum(2 * size[s] for s in full)
            free = sum(weight[s] for s in size if s not in full)
            more = {s for s in size if s not in full and 2 * size[s] <= weight[s] * left / free} if free else set()
            if not more:
                break
            full |= more
        for s in size:
            want = 2 * size[s] if s in full else weight[s] * left / free
            assert got[s] == pytest.approx(float(want)), (case, s)


def test_apportion_equals_ranked_quotients(spark):
    rng = random.Random(7)
    cells = [(g, i, v) for g, k in (("a", 12), ("b", 1), ("c", 5)) for i, v in enumerate([rng.choice([0, 1, 1, 50, 1000]) for _ in range(k)])]
    seats = {"a": 97, "b": 3, "c": 1}
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in cells], "g string, i long, v long, s long")
    got = {(r.g, r.i): r.won for r in mixing.apportion(df, "v", F.col("s"), "won", ["g"], ["i"]).collect()}
    for g in seats:
        own = [(i, v) for h, i, v in cells if h == g]
        quotients = sorted((-v / (2 * j + 1), i, j) for i, v in own for j in range(seats[g]) if v > 0)[: seats[g]]
        want = collections.Counter(i for _, i, _ in quotients)
        assert {i: got[g, i] for i, _ in own} == {i: want[i] for i, _ in own}


def test_mix(spark):
    rows = messy_rows() + [(1000 + i, "x " * (i % 50), None, "hot", 1) for i in range(600)]
    df = with_clashes(messy(spark, rows))
    kwargs = dict(rows_per_shard=30, shard_groups=4)
    got = mixing.mix(df, **kwargs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), **kwargs).collect()))
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    per_source = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        s = per_source[r.source_size]
        s[0] += r.taken
        s[1] = r.target
        s[2] += r.size
    for size, (taken, target, own) in per_source.items():
        assert own % size == 0 if size else own == 0
        assert abs(taken - target * (own // size if size else 1)) <= 16 * 30
    out = mixing.mixed_documents(df, **kwargs)
    assert out.columns == df.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_small_sources_reach_their_targets(spark):
    """One text a cell would round 5 words up to a block of 16 and leave a short source at half its target."""
    rows = [(i, "a b c d e", "en", "short", 1) for i in range(60)] + [(100 + i, "", "en", "short", 0) for i in range(300)]
    rows += [(1000 + i, "x " * 40, "en", "long", 1) for i in range(1500)]
    got = mixing.mix(messy(spark, rows), weights=(1,), share=3.0, rows_per_shard=60).collect()
    assert len(got) == len(rows)
    for source in (range(60), range(1000, 2500)):
        own = [r for r in got if r.doc_id in source]
        assert own[0].target == 2 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.03 * own[0].target
    assert all(r.taken == 0 for r in got if r.size == 0)


def test_registered_mix_equals_its_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 9), "en", rng.choice(["a", "b", "b", "b", None]), 1) for i in range(9000)]
    rows += [(9000 + i, "five words are in it", "en", "small", 1) for i in range(60)] + [(9100, None, "en", "small", 1), (9101, "", None, None, None)]
    messy(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    got = mixing.query(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == want


def test_groups_of_shards_equal_the_sql(spark, tmp_path):
    """Two shard groups and shards of 100 rows, in the query and in the text of its SQL."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "b", "b", "b", None]), 1) for i in range(3000)]
    rows += [(3000 + i, "five words are in it", "en", "small", 1) for i in range(60)]
    messy(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = mixing.SQL.replace("% 1024", "% 2").replace("4000.0", "100.0")
    want = sorted((i, taken) for i, taken in con.execute(f"SELECT doc_id, taken FROM ({sql})").fetchall())
    out = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet")), rows_per_shard=100, shard_groups=2).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == want


def test_small_source_reaches_its_target(spark):
    """60 texts of 5 words beside 6,000 long ones in 61 shards of the table."""
    rows = [(i, "five words are in it", "en", "small", 1) for i in range(60)]
    rows += [(100 + i, "w " * 40, "en", "big", 1) for i in range(6000)]
    got = mixing.mix(messy(spark, rows), rows_per_shard=100)
    per = {r.size: (r.target, r.taken) for r in got.groupBy("size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    for target, taken in per.values():
        assert abs(taken - target) <= 0.03 * target
