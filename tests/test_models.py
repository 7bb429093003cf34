"""Entry models: they learn, repeat under a seed, survive a save, and their reports hang together."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapelab.operators import boosting as B, models as M
from tapelab.plans import models as Q


SMALL = B.Params(rounds=8, leaves=6, least=10)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        c = None if rng.random() < 0.2 else rng.random()
        rows.append((f"m{i:04d}", i * 1_000_000, i * 1_000_000 + 400_000, a, b, c, (0.4 if a > 0.6 else -0.1) + rng.gauss(0, 0.02), "TIMEOUT", i % 2 == 0))
    return spark.createDataFrame(rows, "mint string, entry_us long, exit_us long, a double, b double, c double, pnl_sol double, exit_reason string, flag boolean").cache()


@pytest.fixture(scope="module")
def model(frame):
    return M.fit_entry_model(frame.where("entry_us < 500000000"), ["a", "b", "c", "flag"], params=SMALL)


def test_learns_and_repeats(frame, model):
    train = frame.where("entry_us < 500000000")
    again = M.fit_entry_model(train, ["a", "b", "c", "flag"], params=SMALL)
    rows = lambda m: [(r["mint"], r["prediction"]) for r in m.score(train).orderBy("mint").select("mint", "prediction").collect()]
    assert rows(model) == rows(again)
    assert model.score(frame).select(F.corr("prediction", "pnl_sol")).first()[0] > 0.9


def test_save_and_load(spark, frame, model, tmp_path):
    M.save_model(spark, model, {"version": "t", "threshold": 0.1}, str(tmp_path / "m"))
    back, config = M.load_model(spark, str(tmp_path / "m"))
    assert config["threshold"] == 0.1 and back.features == model.features
    pick = lambda m: [r[0] for r in m.score(frame).orderBy("mint").select("prediction").collect()]
    assert pick(back) == pick(model)


def test_threshold_choice_and_test(frame, model):
    train, val, test = (frame.where(c) for c in ("entry_us < 500000000", "entry_us BETWEEN 500000000 AND 699999999", "entry_us >= 700000000"))
    grid = M.threshold_grid(model.score(train))
    sweep = M.sweep_thresholds(model.score(val), grid)
    chosen = M.choose(sweep)
    row = chosen.first()
    assert row["accepted_trades"] >= 10 and row["pnl_sol"] > 0
    assert row["pnl_sol"] == pytest.approx(max(r["pnl_sol"] for r in sweep.collect()))
    out = M.evaluate(model.score(test), chosen).first()
    assert out["pnl_sol"] > 0 and out["replayable"] == model.score(test).where(F.col("prediction") >= row["threshold"]).count()
    assert M.evaluate(model.score(test), chosen.where("false")).isEmpty()


def test_importance_finds_the_driver(frame, model):
    imp = {r["feature"]: r["importance"] for r in M.permutation_importance(model, frame.where("entry_us >= 500000000")).collect()}
    assert max(imp, key=imp.get) == "a" and set(imp) == {"a", "b", "c", "flag"}


def test_ablation_and_parity(frame):
    parts = [frame.where(c) for c in ("entry_us < 500000000", "entry_us BETWEEN 500000000 AND 699999999", "entry_us >= 700000000")]
    rows = {r["feature_set"]: r for r in M.ablate(*parts, {"driver": ["a"], "noise": ["b"]}, params=SMALL).collect()}
    assert rows["driver"]["test_pnl_sol"] > 0 and rows["driver"]["features"] == 1
    p = M.feature_parity(frame, frame.where("mint <> 'm0000'").withColumn("a", F.col("a") + 0.5), ["mint"], ["a", "b"])
    got = {r["feature"]: r for r in p.collect()}
    assert got["a"]["max_abs_diff"] == pytest.approx(0.5) and got["b"]["max_abs_diff"] == 0 and got["a"]["one_sided"] == 1


@pytest.mark.parametrize("name", ["entry_model_scores", "threshold_sweep", "untouched_test", "event_ownership_scores", "permutation_importance", "feature_ablation", "stream_scores"])
def test_registered_queries_fit_in_full(spark, monkeypatch, name):
    class Reached(Exception):
        pass

    def stop(train, models, label, params, *more):
        raise Reached(params)

    monkeypatch.setattr(M, "fit", stop)
    with pytest.raises(Reached) as e:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    p = e.value.args[0]
    assert (p.rounds, p.leaves, p.least, p.l2, p.step, p.bins) == (250, 15, 40, 2.0, 0.05, 255)


# ---- the learner against plain Python --------------------------------------------------------------------------------
def plain_cuts(values, bins=255):
    seen = sorted({v for v in values if not math.isnan(v)})
    return [(a + b) / 2 for a, b in zip(seen, seen[1:])]


def plain_boost(x, y, p):
    """Best-first histogram boosting, one row and one leaf at a time."""
    cuts = [plain_cuts([r[j] for r in x]) for j in range(len(x[0]))]
    binned = [[None if math.isnan(v) else sum(c < v for c in cuts[j]) for j, v in enumerate(r)] for r in x]
    pred = [sum(y) / len(y)] * len(y)
    part = lambda g, n: g * g / (n + p.l2)

    def find(rows, res):
        best = None
        total = sum(res[i] for i in rows)
        for j in range(len(cuts)):
            lost = [i for i in rows if binned[i][j] is None]
            by_bin = {}
            for i in rows:
                if binned[i][j] is not None:
                    by_bin.setdefault(binned[i][j], []).append(i)
            for b in sorted(by_bin):
                base = [i for k in by_bin if k <= b for i in by_bin[k]]
                for side in (0, 1) if lost else (0,):
                    left = base + lost * side
                    if p.least <= len(left) <= len(rows) - p.least:
                        gl = sum(res[i] for i in left)
                        gain = part(gl, len(left)) + part(total - gl, len(rows) - len(left)) - part(total, len(rows))
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, left)
        return best

    for _ in range(p.rounds):
        res = [a - b for a, b in zip(y, pred)]
        leaves = [(list(range(len(y))), find(range(len(y)), res))]
        while len(leaves) < p.leaves:
            open_ = [k for k, (_, s) in enumerate(leaves) if s]
            if not open_:
                break
            k = max(open_, key=lambda k: leaves[k][1][0])
            rows, (_, left) = leaves.pop(k)
            for part_rows in (left, [i for i in rows if i not in set(left)]):
                leaves.append((part_rows, find(part_rows, res)))
        for rows, _ in leaves:
            v = p.step * sum(res[i] for i in rows) / (len(rows) + p.l2)
            for i in rows:
                pred[i] += v
    return pred


def noisy(n, seed):
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(n):
        a, b, c = rng.random(), float(rng.randrange(5)), rng.gauss(0, 1)
        y.append((0.7 if a > 0.4 else -0.3) + 0.1 * b + (0.5 if c < -0.2 else 0.0) + rng.gauss(0, 0.1))
        x.append([a, b, math.nan if rng.random() < 0.25 else c, math.nan])
    return x, y


COLS = ["a", "b", "c", "never"]


@pytest.mark.parametrize("tasks_of", [10**6, 40])
def test_boosting_equals_plain_python(spark, tasks_of):
    x, y = noisy(160, 5)
    params = B.Params(rounds=6, leaves=5, least=12, step=0.3)
    df = spark.createDataFrame([(*[None if math.isnan(v) and k % 2 else v for k, v in enumerate(r)], t) for r, t in zip(x, y)], "a double, b double, c double, never double, y double")
    models = B.fit(df, {"all": COLS, "two": ["c", "a"]}, "y", params, rows_per_task=tasks_of)
    assert models["all"].predict(np.array(x)).tolist() == pytest.approx(plain_boost(x, y, params), abs=1e-9)
    two = [[r[2], r[0]] for r in x]
    assert models["two"].predict(np.array(two)).tolist() == pytest.approx(plain_boost(two, y, params), abs=1e-9)
    for m in models.values():
        for t in m.trees:
            assert (t.feature < 0).sum() <= 5


def test_one_task_or_many_give_one_model(spark):
    x, y = noisy(300, 6)
    df = spark.createDataFrame([(*r, t) for r, t in zip(x, y)], "a double, b double, c double, never double, y double")
    params = B.Params(rounds=30, leaves=7, least=8)
    one, many = (B.fit(d, {"m": COLS}, "y", params, rows_per_task=k)["m"] for d, k in ((df, 10**6), (df.repartition(7), 50)))
    assert one.cuts == many.cuts and one.base == many.base and len(one.trees) == len(many.trees) == 30
    for s, t in zip(one.trees, many.trees):
        assert all(np.array_equal(getattr(s, f), getattr(t, f)) for f in ("feature", "bin", "missing_left", "left", "right", "value"))


def test_many_values_share_bins(spark):
    rows = [(float(v * v % 9973), float(v % 7)) for v in range(5000)]
    cuts = B.bin_cuts(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], bins=20)
    a = sorted(r[0] for r in rows)
    counts = np.bincount(np.searchsorted(cuts[0], a), minlength=20)
    assert len(cuts[0]) == 19 and counts.max() - counts.min() <= 4 and cuts[1] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan"))], "a double, y double")
    assert B.fit(df, {"m": ["a"]}, "y")["m"].predict(np.array([[1.0], [math.nan]])).tolist() == [0.0, 0.0]
    same = spark.createDataFrame([(float(i), 2.5) for i in range(200)], "a double, y double")
    assert B.fit(same, {"m": ["a"]}, "y", B.Params(rounds=3))["m"].predict(np.array([[7.0]])).tolist() == pytest.approx([2.5])


def test_untouched_test_needs_ten_validation_trades(spark, frame, model, monkeypatch):
    split = F.when(F.col("entry_us") < 500_000_000, "train").when(F.col("entry_us") < 700_000_000, "validation").otherwise("test")
    whole = frame.withColumn("split", split)
    few = whole.where("split <> 'validation' OR entry_us < 512000000")
    monkeypatch.setattr(M, "fit_entry_model", lambda *a, **k: model)
    for rows, tested in ((whole, True), (few, False)):
        monkeypatch.setattr(Q, "candidate_trades", lambda *a, rows=rows: rows)
        assert entry.queries()["untouched_test"](spark, "").isEmpty() != tested


def test_linear_queries_choose_and_test_on_real_limits(spark, frame, monkeypatch):
    split = F.when(F.col("entry_us") < 500_000_000, "train").when(F.col("entry_us") < 700_000_000, "validation").otherwise("test")
    whole = frame.withColumn("split", split).withColumns({"buys_2s": F.floor(F.col("a") * 1000), "buyer_seconds_5s": F.lit(None).cast("double")})
    monkeypatch.setattr(Q, "candidate_trades", lambda *a: whole)
    run = lambda name: entry.queries()[name](spark, "").collect()
    sweep, chosen, tested = run("linear_threshold_sweep"), run("linear_choice"), run("linear_untouched_test")
    good = [r for r in sweep if r["accepted_trades"] >= 10 and r["pnl_sol"] > 0 and (r["largest_profit_share"] or 0) <= 0.60 and r["max_drawdown_sol"] <= 1.5]
    assert len(sweep) > 20 and len(chosen) == 1 and chosen[0]["k"] == max(good, key=lambda r: (r["pnl_sol"], -r["k"]))["k"]
    assert len(tested) == 1 and tested[0]["split"] == "test" and tested[0]["accepted_trades"] > 0
