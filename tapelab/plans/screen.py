"""Rule screen, exit sweep, cohort sweep: signals -> outcomes -> metrics -> finalists."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from tapelab.functions import gates as G
from tapelab.operators import evaluate as V, outcomes as O, signals as Sg
from tapelab.plans import oracle_sql as S
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.plans.tape import derived_table, feature_table
from tapelab.session import cut_lineage
from tapelab.sources.adapters import HOUR_S, HOUR_US

# The rule families with thresholds for hourly bars of the given tables.
LIM = G.Limits(age_low=3_600, age_high=72_000, curve_low=5, curve_high=82)
GRIDS = {
    "crowd": {"buys_2s": (1, 2, 3), "buyers_5s": (2, 4), "buy_sol_5s": (0.10, 0.30), "pressure": (1.5, 3.0)},
    "quiet": {"buys_2s": (1, 2, 3), "prior_buys_max": (1, 3, 6), "buy_sol_2s": (0.15, 0.50)},
    "reclaim": {"drawdown": (-0.005, -0.02, -0.05), "bounce": (0.005, 0.02), "buys_2s": (1, 2), "pressure": (1.5, 3.0)},
    "absorb": {"sell_sol_5s": (0.05, 0.20), "buys_2s": (1, 2, 3)},
    "breadth": {"current_buyers": (1, 2, 3), "return_5s": (0.005, 0.02), "buy_sol_2s": (0.15, 0.50)},
    "manual": {"age_max": (36_000, 72_000), "curve_min": (30, 36), "buys_2s": (1, 2), "buy_sol_5s": (0.10, 0.20, 0.40),
               "pressure": (1.2, 2.5)},
}
TP, SL, HOLD_H = 0.03, -0.04, 6
TPS, SLS, HOLDS = (0.005, 0.01, 0.02, 0.04, 0.08), (-0.02, -0.03, -0.05, -0.10), (1, 2, 4, 8, 15)
TRAIN_D, VALID_D, TOTAL_D = 16, 4, 28


def grids(only: str | None = None) -> dict:
    return {k: v for k, v in GRIDS.items() if only in (None, k)}


def config_names(only: str | None = None) -> list[str]:
    return [c.config for c in G.rule_configs(grids(only))]


def signals_of(feats, only: str | None = None):
    hits = Sg.grid_first_match(feats, grids(only), G.common_gate(LIM))
    return hits.select("config", "mint", F.unix_micros("bucket").alias("signal_us"))


def staged_features(spark, d):
    """Hourly features, written once: signals, replay and split bounds all read the copy, partitioned by mint."""
    return cut_lineage(derived_table(spark, d))


def split_of(bars, total_days: int | None = None):
    start = bars.agg(F.min(F.unix_micros("bucket"))).scalar()
    return V.split_col(F.col("entry_us"), start, TRAIN_D, VALID_D, total_days)


def screen_trades(feats, only: str | None = None):
    """(config, split, trade) for every rule; each distinct (mint, signal bar) is replayed once."""
    sig = signals_of(feats, only)
    labelled = O.label_trades(sig, feats, TP, SL, HOLD_H * HOUR_US)
    return sig.join(labelled, ["mint", "signal_us"]).withColumn("split", split_of(feats))


def screen_metrics(feats, only: str | None = None):
    return V.trade_metrics(screen_trades(feats, only), ["config", "split"])


def config_table(spark, names: list[str]):
    return spark.createDataFrame([(n,) for n in names], "config string")


METRIC_DOUBLES = ["pnl_sol", "average_pnl_sol", "win_rate", "largest_profit_share", "max_drawdown_sol"]
METRIC_LONGS = ["trades", "take_profits", "stop_losses"]
_M_SQL = ", ".join(METRIC_LONGS) + ", " + ", ".join(r(c, c) for c in METRIC_DOUBLES)
_HITS = S.FEATURES + S.rule_hit_ctes(GRIDS, LIM)
_START = "(SELECT min(bucket_s) FROM bars)"
_FIRST = _HITS + ", first_hits AS (SELECT config, mint, min(bucket_s) AS signal_s FROM hits GROUP BY ALL)"
_TRADES = _FIRST + S.label_ctes("first_hits", TP, SL, HOLD_H * HOUR_S) + f""", trades AS (
  SELECT h.config, l.*, {S.split_case('l.entry_s', _START, TRAIN_D, VALID_D)} AS split
  FROM first_hits h JOIN labelled l ON l.mint = h.mint AND l.signal_s = h.signal_s)"""
_METRICS = _TRADES + S.metric_ctes("trades", "config, split")


_CONFIG_VALUES = ", ".join(f"('{s}-{i:03d}')" for s, g in GRIDS.items() for i in range(prod(len(v) for v in g.values())))


@query("rule_hits", f"""WITH {_HITS}
SELECT v.config, count(h.mint) AS hits FROM (VALUES {_CONFIG_VALUES}) v(config) LEFT JOIN hits h ON h.config = v.config GROUP BY v.config""")
def rule_hits(spark, d):
    hits = Sg.grid_hits(derived_table(spark, d), GRIDS, G.common_gate(LIM))
    return config_table(spark, config_names()).join(hits, "config", "left").fillna({"hits": 0})


@query("rule_first_match", f"WITH {_FIRST} SELECT config, mint, signal_s AS bucket_s FROM first_hits")
def rule_first_match(spark, d):
    hits = Sg.grid_first_match(derived_table(spark, d), GRIDS, G.common_gate(LIM))
    return hits.select("config", "mint", F.unix_seconds("bucket").alias("bucket_s"))


# The smallest full slice: two buys in two bars, next-bar entry.
_SLICE = S.FEATURES + ", first_hits AS (SELECT mint, min(bucket_s) AS signal_s FROM trails WHERE buys_2s >= 2 GROUP BY mint)"


@query("labelled_trades", f"""WITH {_SLICE} {S.label_ctes('first_hits', TP, SL, HOLD_H * HOUR_S)}
SELECT mint, signal_s, entry_s, exit_s, {r('pnl_sol', 'pnl_sol')}, {r('100 * pnl_sol / 0.5032', 'return_pct')}, {r('peak_pnl_sol', 'peak_pnl_sol')},
  {r('trough_pnl_sol', 'trough_pnl_sol')}, exit_reason, {r('entry_mc', 'entry_market_cap_sol')}, {r('exit_mc', 'exit_market_cap_sol')} FROM labelled""")
def labelled_trades(spark, d):
    feats = staged_features(spark, d)
    sig = Sg.first_match(feats, {"slice": F.col("buys_2s") >= 2}).withColumn("signal_us", F.unix_micros("bucket"))
    out = O.label_trades(sig, feats, TP, SL, HOLD_H * HOUR_US)
    return out.select("mint", *[(F.col(f"{c}_us") / 1_000_000).cast("long").alias(f"{c}_s") for c in ("signal", "entry", "exit")],
                      "exit_reason", *[r6(c).alias(c) for c in ("pnl_sol", "return_pct", "peak_pnl_sol", "trough_pnl_sol",
                                                                "entry_market_cap_sol", "exit_market_cap_sol")])


_IN_TIME = f"l.entry_s - {_START} <= {TOTAL_D * 86_400}"


@query("rule_screen_bounded", f"""WITH {_TRADES}, in_time AS (SELECT l.* FROM trades l WHERE {_IN_TIME}) {S.metric_ctes("in_time", "config, split")}
SELECT config, split, {_M_SQL} FROM metrics""")
def rule_screen_bounded(spark, d):
    """The screen's own splits: the test ends with the window, and later trades belong to no split."""
    feats = staged_features(spark, d)
    trades = screen_trades(feats).drop("split").withColumn("split", split_of(feats, TOTAL_D)).where(F.col("split").isNotNull())
    metrics = V.trade_metrics(trades, ["config", "split"])
    return metrics.select("config", "split", *METRIC_LONGS, *[r6(c).alias(c) for c in METRIC_DOUBLES])


@query("rule_screen", f"WITH {_METRICS} SELECT config, split, {_M_SQL} FROM metrics")
def rule_screen(spark, d):
    return screen_metrics(staged_features(spark, d)).select("config", "split", *METRIC_LONGS, *[r6(c).alias(c) for c in METRIC_DOUBLES])


_FREEZE_SQL = f""", wide AS (
  SELECT config, coalesce(max(trades) FILTER (WHERE split = 'train'), 0) AS train_trades,
    coalesce(max(pnl_sol) FILTER (WHERE split = 'train'), 0.0) AS train_pnl_sol,
    coalesce(max(trades) FILTER (WHERE split = 'validation'), 0) AS validation_trades,
    coalesce(max(pnl_sol) FILTER (WHERE split = 'validation'), 0.0) AS validation_pnl_sol,
    max(largest_profit_share) FILTER (WHERE split = 'validation') AS validation_largest_profit_share,
    coalesce(max(pnl_sol) FILTER (WHERE split = 'test'), 0.0) AS test_pnl_sol
  FROM metrics GROUP BY config
), frozen AS (SELECT * FROM wide WHERE train_trades >= 20 ORDER BY train_pnl_sol DESC, config LIMIT 15)"""
_WIDE_COLS = ["train_trades", "validation_trades"]
_WIDE_DOUBLES = ["train_pnl_sol", "validation_pnl_sol", "validation_largest_profit_share", "test_pnl_sol"]


def frozen_rules(spark, d):
    wide = V.by_split(screen_metrics(staged_features(spark, d)), ["config"], config_table(spark, config_names()))
    return V.freeze(wide, 20, 15, ["config"])


@query("frozen_finalists", f"WITH {_METRICS} {_FREEZE_SQL} SELECT config, {', '.join(_WIDE_COLS)}, {', '.join(r(c, c) for c in _WIDE_DOUBLES)} FROM frozen")
def frozen_finalists(spark, d):
    return frozen_rules(spark, d).select("config", *_WIDE_COLS, *[r6(c).alias(c) for c in _WIDE_DOUBLES])


@query("validation_survivors", f"""WITH {_METRICS} {_FREEZE_SQL} SELECT config, {', '.join(_WIDE_COLS)}, {', '.join(r(c, c) for c in _WIDE_DOUBLES)} FROM frozen
WHERE validation_trades >= 5 AND validation_pnl_sol > 0 AND coalesce(validation_largest_profit_share, 0) <= 0.60""")
def validation_survivors(spark, d):
    return V.survivors(frozen_rules(spark, d)).select("config", *_WIDE_COLS, *[r6(c).alias(c) for c in _WIDE_DOUBLES])


_GATE = G.BaseGate(age_low=3_600, age_high=72_000, curve_low=25, curve_high=82, min_buys_2s=1, min_buy_sol_5s=0.05)
_GATE_SQL = ("age_seconds BETWEEN 3600 AND 72000 AND curve_close BETWEEN 25 AND 82 AND buys_2s >= 1 AND buy_sol_5s >= 0.05 "
             "AND return_5s BETWEEN -0.20 AND 0.80 AND initial_top10_pct_corrected IS NOT NULL AND dev_buy_pct_corrected IS NOT NULL")


@query("base_gate", f"WITH {S.FEATURES} SELECT mint, min(bucket_s) AS bucket_s FROM features WHERE {_GATE_SQL} GROUP BY mint")
def base_gate(spark, d):
    return (Sg.first_match(feature_table(spark, d), {"base": _GATE.batch()})
            .select("mint", F.unix_seconds("bucket").alias("bucket_s")))


@query("finalist_gate", f"""WITH {S.FEATURES} SELECT mint, min(bucket_s) AS bucket_s FROM derived WHERE age_seconds BETWEEN 3600 AND 36000
  AND curve_close BETWEEN 30 AND 82 AND buys_2s >= 1 AND buy_sol_5s >= 0.1 AND buy_sol_5s >= 1.2 * greatest(sell_sol_5s, 0.10)
  AND return_5s BETWEEN 0.02 AND 0.60 AND drawdown_from_60s_peak >= -0.20 GROUP BY mint""")
def finalist_gate(spark, d):
    return (Sg.first_match(derived_table(spark, d), {"finalist": G.finalist_gate({"age_max": 36_000, "curve_min": 30, "buys_2s": 1, "buy_sol_5s": 0.1, "pressure": 1.2}, LIM)})
            .select("mint", F.unix_seconds("bucket").alias("bucket_s")))


def exit_case_sql(tps=TPS, sls=SLS, holds=HOLDS, keys: str = "mint, signal_s") -> str:
    """Outcomes of the exit grid by walking steps per setting."""
    return f""", exits AS (
  SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS exit_id, tp, sl, hold FROM
    (SELECT unnest({list(tps)}) AS tp, generate_subscripts({list(tps)}, 1) AS i) CROSS JOIN
    (SELECT unnest({list(sls)}) AS sl, generate_subscripts({list(sls)}, 1) AS j) CROSS JOIN
    (SELECT unnest({list(holds)}) AS hold, generate_subscripts({list(holds)}, 1) AS k)
), walked AS (
  SELECT {keys}, entry_s, exit_id, tp, sl, max(rn) AS last_rn,
    min(rn) FILTER (WHERE pnl / 0.5032 >= tp OR pnl / 0.5032 <= sl OR elapsed >= hold * 3600) AS hit_rn
  FROM steps, exits GROUP BY ALL
), swept AS (
  SELECT w.mint, w.signal_s, w.entry_s, w.exit_id, s.bucket_s AS exit_s, s.pnl AS pnl_sol,
    CASE WHEN s.pnl / 0.5032 >= w.tp THEN 'TAKE_PROFIT' WHEN s.pnl / 0.5032 <= w.sl THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS exit_reason
  FROM walked w JOIN steps s ON s.mint = w.mint AND s.signal_s = w.signal_s AND s.rn = coalesce(w.hit_rn, w.last_rn)
)"""


_MANUAL = "manual"
# The screen table also has a `metrics` CTE; the sweep's own is named sweep_metrics.
_FINALISTS = _METRICS + """, manual_wide AS (
  SELECT config, coalesce(max(trades) FILTER (WHERE split = 'train'), 0) AS train_trades,
    coalesce(max(pnl_sol) FILTER (WHERE split = 'train'), 0.0) AS train_pnl_sol FROM metrics WHERE config LIKE 'manual%' GROUP BY config
), finalists AS (SELECT config FROM manual_wide WHERE train_trades >= 20 ORDER BY train_pnl_sol DESC, config LIMIT 12)"""
_STEPS_180 = S.path_ctes("first_hits", max_elapsed_s=18 * HOUR_S).replace("path AS", "path2 AS").replace("path ", "path2 ").replace(
    " ent ", " ent2 ").replace(", ent AS", ", ent2 AS").replace("ent.", "ent2.").replace(" stop ", " stop2 ").replace(
    ", stop AS", ", stop2 AS").replace(", steps AS", ", steps2 AS")


def swept_finalists(spark, d):
    """Exit grid over the best state-anticipation rules of the screen; identical signals are replayed once."""
    feats = staged_features(spark, d)
    sig = cut_lineage(signals_of(feats, _MANUAL))
    labelled = O.label_trades(sig, feats, TP, SL, HOLD_H * HOUR_US)
    trades = sig.join(labelled, ["mint", "signal_us"]).withColumn("split", split_of(feats))
    wide = V.by_split(V.trade_metrics(trades, ["config", "split"]), ["config"], config_table(spark, config_names(_MANUAL)))
    best = V.freeze(wide, 20, 12, ["config"]).select("config")
    chosen = sig.join(best, "config", "left_semi")
    swept = O.sweep_exits(chosen, feats, TPS, SLS, HOLDS, HOUR_US, 18 * HOUR_US)
    return chosen.join(swept, ["mint", "signal_us"]).withColumn("split", split_of(feats))


@query("exit_sweep", f"""WITH {_FINALISTS} {_STEPS_180} {exit_case_sql().replace('FROM steps,', 'FROM steps2,').replace('JOIN steps ', 'JOIN steps2 ')}, sweep_trades AS (
  SELECT h.config, w.exit_id, w.mint, w.exit_s, w.pnl_sol, w.exit_reason, {S.split_case('w.entry_s', _START, TRAIN_D, VALID_D)} AS split
  FROM first_hits h JOIN finalists USING (config) JOIN swept w ON w.mint = h.mint AND w.signal_s = h.signal_s)
{S.metric_ctes('sweep_trades', 'config, exit_id, split', 'sweep_metrics')}
SELECT config, exit_id, split, {_M_SQL} FROM sweep_metrics""")
def exit_sweep(spark, d):
    m = V.trade_metrics(swept_finalists(spark, d), ["config", "exit_id", "split"])
    return m.select("config", F.col("exit_id").cast("long").alias("exit_id"), "split", *METRIC_LONGS, *[r6(c).alias(c) for c in METRIC_DOUBLES])
