"""The screen of a file run and its two reports, on a few bars."""

from pyspark.sql import functions as F

from tapelab.functions.bar_amm import Costs
from tapelab.pipeline import Screen, TapeRun

DAY = 86_400


def features(spark):
    """One token per rise and fall: bars a minute apart, the pool's price moves by ``step`` per bar."""
    rows = []
    for i, (day, step) in enumerate([(0, 1.3), (1, 1.3), (2, 0.7), (4, 1.3), (6, 1.3), (9, 1.3)]):
        for k in range(4):
            rows.append((f"m{i}", day * DAY + 1 + 60 * k, 10.0 + k, 30.0 * step**k, 30.0 * step**k, 1e9))
    cols = "mint string, s long, curve_close double, mc_close double, v_sol_close double, v_tokens_close double"
    return spark.createDataFrame(rows, cols).withColumn("bucket", F.timestamp_seconds("s")).drop("s")


def hits(spark, feats):
    """Two configurations: one takes every token, the other only the falling one."""
    first = feats.groupBy("mint").agg(F.min("bucket").alias("bucket"))
    return first.select(F.lit("absorb-000").alias("config"), "mint", "bucket").union(first.where("mint = 'm2'").select(F.lit("absorb-001"), "mint", "bucket"))


def test_screen_and_reports(spark, tmp_path):
    grids = {"absorb": {"sell_sol_5s": (0.05, 0.20, 0.9), "buys_2s": (1,)}}
    screen = Screen(grids, tp=0.2, sl=-0.2, hold_us=3_600_000_000, min_trades=1, top=2, costs=Costs(0.01, 0.0, 0.0))
    run = TapeRun(str(tmp_path / "out"), screen=screen)
    feats = features(spark)
    results = run.results(spark, feats, hits(spark, feats))
    got = {r["config"]: r for r in results.collect()}
    assert sorted(got) == ["absorb-000", "absorb-001", "absorb-002"]
    every, falling, silent = (got[c] for c in sorted(got))
    # The token of day 9 is after the window and belongs to no split.
    assert (every["train_trades"], every["validation_trades"], every["test_trades"]) == (3, 1, 1)
    assert falling["train_pnl_sol"] < 0 < every["train_pnl_sol"] and (silent["train_trades"], silent["rank"]) == (0, None)
    assert (every["rank"], falling["rank"], every["survives"]) == (1, 2, False)  # one validation trade is too few
    doc = run.report(spark, feats, results).first()
    assert (doc["configurations"], doc["processed_tokens"], doc["protocol"]["take_profit"]) == (3, 6, 0.2)
    assert [r["config"] for r in doc["frozen_finalists"]] == ["absorb-000", "absorb-001"] and doc["validation_survivors"] == [] and len(doc["all_results"]) == 3
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/report_md").coalesce(1).collect())
    assert text.startswith("# Rule screen") and text.index("| 1 | absorb-000 |") < text.index("| 2 | absorb-001 |") < text.index("## Validation survivors")
    assert text.rstrip().endswith("0 of 0 rows")


def test_reports_of_nothing(spark, tmp_path):
    run = TapeRun(str(tmp_path / "out"))
    feats = features(spark).limit(0)
    results = run.results(spark, feats, hits(spark, feats))
    doc = run.report(spark, feats, results).first()
    assert (doc["configurations"], doc["processed_tokens"], doc["start"]) == (132, 0, None)
    assert doc["frozen_finalists"] == doc["validation_survivors"] == [] and len(doc["all_results"]) == 132
