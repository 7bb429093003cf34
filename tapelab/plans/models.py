"""Entry-model queries. Learned numbers have no SQL twin; what can be checked exactly (features, parity) has one."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapelab.operators import models as M, outcomes as O, ownership as W
from tapelab.operators.signals import first_match
from tapelab.plans import oracle_sql as S, replay as RQ, wallets as WQ
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.plans.screen import HOLD_H, SL, TP, _GATE, split_of
from tapelab.plans.tape import derived_table, feature_table, staged_tape, token_table
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A



def candidate_trades(spark, d, tape=None):
    """First gated bar per mint with its features and labelled outcome, and the split of its entry."""
    feats = cut_lineage(feature_table(spark, d, tape))
    hit = first_match(feats, {"base": _GATE.batch()}).select("mint", "bucket")
    cand = hit.join(feats, ["mint", "bucket"]).withColumn("signal_us", F.unix_micros("bucket"))
    labelled = O.label_trades(cand, feats, TP, SL, HOLD_H * A.HOUR_US)
    cols = list(dict.fromkeys([*M.DYNAMIC, *M.STATIC]))
    out = labelled.join(cand.select("mint", "signal_us", *cols), ["mint", "signal_us"])
    return M.numeric_features(out.withColumn("split", split_of(feats)), cols)


_CAND = WQ._OWN + S.label_ctes("(SELECT mint, bucket_s AS signal_s FROM cand)", TP, SL, HOLD_H * A.HOUR_S).replace(", ent AS (", ", ent_l AS (").replace(
    " ent ", " ent_l ").replace("ent.", "ent_l.")
_C_COLS = ["age_seconds", "curve_close", "buy_sol_5s", "return_5s", "initial_gini", "is_mayhem_mode"]


@query("candidate_trades", f"""WITH {_CAND} SELECT l.mint, l.signal_s, l.entry_s, l.exit_s, exit_reason, {r('pnl_sol', 'pnl_sol')},
  {', '.join(r(f'c.{c}', c) for c in _C_COLS)}, {S.split_case('l.entry_s', '(SELECT min(bucket_s) FROM bars)', 16, 4)} AS split
FROM labelled l JOIN cand c ON c.mint = l.mint AND c.bucket_s = l.signal_s""")
def candidate_trades_q(spark, d):
    return candidate_trades(spark, d).select("mint", *[(F.col(f"{c}_us") / 1_000_000).cast("long").alias(f"{c}_s") for c in ("signal", "entry", "exit")],
                                             "exit_reason", "split", r6("pnl_sol").alias("pnl_sol"), *[r6(c).alias(c) for c in _C_COLS])


def splits(frame):
    return [frame.where(F.col("split") == s) for s in ("train", "validation", "test")]


@query("entry_model_scores")
def entry_model_scores(spark, d):
    frame = cut_lineage(candidate_trades(spark, d))
    model = M.fit_entry_model(splits(frame)[0], [*M.DYNAMIC, *M.STATIC])
    return M.with_pass(model.score(frame), 0.0).select("mint", "split", "pnl_sol", "prediction", "passed")


@query("threshold_sweep")
def threshold_sweep(spark, d):
    frame = cut_lineage(candidate_trades(spark, d))
    train, val, _ = splits(frame)
    model = M.fit_entry_model(train, M.OWNERSHIP)
    grid = cut_lineage(M.threshold_grid(model.score(train)))
    return M.sweep_thresholds(model.score(val), grid)


@query("untouched_test")
def untouched_test(spark, d):
    """Threshold chosen on validation, then one run on the test split; no row where no threshold is acceptable."""
    frame = cut_lineage(candidate_trades(spark, d))
    train, val, test = splits(frame)
    model = M.fit_entry_model(train, M.OWNERSHIP)
    sweep = M.sweep_thresholds(model.score(val), cut_lineage(M.threshold_grid(model.score(train))))
    best = cut_lineage(M.choose(sweep))
    return M.evaluate(model.score(test), best)


@query("event_ownership_scores")
def event_ownership_scores(spark, d):
    """The model on ownership rebuilt from trades as of the signal."""
    tape = staged_tape(spark, d)
    frame = cut_lineage(candidate_trades(spark, d, tape))
    rich = cut_lineage(W.enrich_ownership(frame, token_table(tape), tape))
    model = M.fit_entry_model(rich.where(F.col("split") == "train"), M.EVENT_OWNERSHIP)
    return model.score(rich).select("mint", "split", "pnl_sol", "prediction")


@query("permutation_importance")
def permutation_importance(spark, d):
    frame = cut_lineage(candidate_trades(spark, d))
    train, val, _ = splits(frame)
    return M.permutation_importance(M.fit_entry_model(train, M.OWNERSHIP), val)


@query("feature_ablation")
def feature_ablation(spark, d):
    train, val, test = splits(cut_lineage(candidate_trades(spark, d)))
    return M.ablate(train, val, test, M.FEATURE_SETS)


_GRID_LIST = "[" + ", ".join(str(0.80 + (0.995 - 0.80) * i / 29) for i in range(30)) + "]"


@query("threshold_quantiles", f"""WITH {S.FEATURES}, q AS (SELECT DISTINCT unnest(quantile_cont(return_5s, {_GRID_LIST})) AS t FROM derived)
SELECT row_number() OVER (ORDER BY t) - 1 AS k, {r('t', 'threshold', 9)} FROM q""")
def threshold_quantiles(spark, d):
    """Exact quantile thresholds of a score column, here the five-bar return."""
    scored = cut_lineage(derived_table(spark, d).select(F.col("return_5s").alias("prediction")))
    return M.threshold_grid(scored).select(F.col("k").cast("long").alias("k"), r6("threshold", 9).alias("threshold"))


# ---- the stages after the score, on a score that SQL can compute ----------------------------------------------------
_LINEAR = "CAST(3.0 * coalesce(buys_2s, 0) + coalesce(buyer_seconds_5s, 0) AS DOUBLE)"
_SCORED = _CAND + f""", scored AS (
  SELECT l.mint, l.entry_s * 1000000 AS entry_us, l.exit_s * 1000000 AS exit_us, pnl_sol, exit_reason, {_LINEAR} AS prediction,
    {S.split_case('l.entry_s', '(SELECT min(bucket_s) FROM bars)', 16, 4)} AS split
  FROM labelled l JOIN cand c ON c.mint = l.mint AND c.bucket_s = l.signal_s
), grid AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, t AS threshold FROM (
  SELECT DISTINCT unnest(quantile_cont(prediction, {_GRID_LIST})) AS t FROM scored WHERE split = 'train'))"""
_SWEPT = _SCORED + RQ.admit_ctes("(SELECT grid.k, scored.* FROM scored JOIN grid ON prediction >= threshold WHERE split = 'validation')", ["k"], 3.0, 3, "0.5032::DOUBLE") + RQ._REPORT.format(k="k", cap=3.0)
_CHOSEN = _SWEPT + """, chosen AS (
  SELECT k, threshold, accepted_trades, pnl_sol FROM report JOIN grid USING (k)
  WHERE accepted_trades >= 10 AND pnl_sol > 0 AND coalesce(largest_profit_share, 0) <= 0.60 AND max_drawdown_sol <= 1.5 ORDER BY pnl_sol DESC, k LIMIT 1)"""
_TESTED = _CHOSEN + re.sub(r"\b(ordered|acct|admitted|acc_eq|acc_dd|report)\b", r"\1_test", RQ.admit_ctes(
    "(SELECT scored.* FROM scored, chosen WHERE prediction >= chosen.threshold AND split = 'test')", ["split"], 3.0, 3, "0.5032::DOUBLE") + RQ._REPORT.format(k="split", cap=3.0))


def linear(spark, d):
    """Candidate trades with the linear score, and validation results per threshold."""
    score = 3.0 * F.coalesce("buys_2s", F.lit(0.0)) + F.coalesce("buyer_seconds_5s", F.lit(0.0))
    frame = cut_lineage(candidate_trades(spark, d).withColumn("prediction", score))
    train, val, test = splits(frame)
    grid = cut_lineage(M.threshold_grid(train))
    return cut_lineage(M.sweep_thresholds(val, grid)), test


@query("linear_threshold_sweep", f"WITH RECURSIVE {_SWEPT} SELECT k, {r('threshold', 'threshold')}, {', '.join(RQ._REP_L)}, {', '.join(r(c, c) for c in RQ._REP_D)} FROM report JOIN grid USING (k)")
def linear_threshold_sweep(spark, d):
    swept, _ = linear(spark, d)
    return RQ.report_cols(swept, [F.col("k").cast("long").alias("k"), r6("threshold").alias("threshold")])


@query("linear_choice", f"WITH RECURSIVE {_CHOSEN} SELECT k, {r('threshold', 'threshold')}, accepted_trades, {r('pnl_sol', 'pnl_sol')} FROM chosen")
def linear_choice(spark, d):
    return M.choose(linear(spark, d)[0]).select(F.col("k").cast("long").alias("k"), r6("threshold").alias("threshold"), "accepted_trades", r6("pnl_sol").alias("pnl_sol"))


@query("linear_untouched_test", f"WITH RECURSIVE {_TESTED} SELECT split, {', '.join(RQ._REP_L)}, {', '.join(r(c, c) for c in RQ._REP_D)} FROM report_test")
def linear_untouched_test(spark, d):
    """The threshold chosen on validation, then one run on the test split."""
    swept, test = linear(spark, d)
    return RQ.report_cols(M.evaluate(test, cut_lineage(M.choose(swept))), ["split"])
