"""The research run over parquet files, written to and read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapelab.pipeline import Screen, TapeRun
from tapelab.plans import oracle_sql as S, screen as Q
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.plans.tape import DAY_S, RULES
from tapelab.session import ensure_checkpoint_dir
from tapelab.sources import adapters as A

_LAST_DAYS = S.FEATURES.replace("ANTI JOIN rejected USING (id))", "ANTI JOIN rejected USING (id) WHERE event_us >= (SELECT max(event_us) - 7 * 86400000000 FROM raw_tape))")


def trade_files(spark, d, folder: str) -> list[str]:
    raw = A.raw_tape(spark, d)
    for i in (0, 1):
        raw.where(F.col("id") % 2 == i).write.parquet(f"{folder}/trades-{i}")
    return [f"{folder}/trades-{i}" for i in (0, 1)]


def run_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query("tape_run", f"""WITH {_LAST_DAYS} SELECT mint, bucket_s, buys_2s, initial_holder_count, {r('buy_sol_5s', 'buy_sol_5s')}, {r('mc_close', 'mc_close')},
  (SELECT count(*) FROM tape) AS trades FROM features""")
def tape_run(spark, d):
    """Feature bars of the whole run over two trade files."""
    w = run_folder(spark)
    got = TapeRun(f"{w}/out", 7, A.HOUR_S, DAY_S, RULES).run(spark, trade_files(spark, d, w), A.token_source)
    trades = got["manifest"].select("trades").scalar()
    return got["features"].select("mint", F.unix_seconds("bucket").alias("bucket_s"), "buys_2s", "initial_holder_count",
                                  r6("buy_sol_5s").alias("buy_sol_5s"), r6("mc_close").alias("mc_close"), trades.alias("trades"))


SCREEN = Screen(Q.GRIDS, Q.LIM, Q.TP, Q.SL, Q.HOLD_H * A.HOUR_US, Q.TRAIN_D, Q.VALID_D, Q.TOTAL_D)
_REPORT_DOUBLES = ["train_pnl_sol", "validation_pnl_sol", "test_pnl_sol"]


@query("tape_report", f"""WITH {Q._TRADES}, in_time AS (SELECT l.* FROM trades l WHERE {Q._IN_TIME}) {S.metric_ctes("in_time", "config, split")} {Q._FREEZE_SQL}
SELECT row_number() OVER (ORDER BY train_pnl_sol DESC, config) AS rank, config, train_trades, validation_trades, {', '.join(r(c, c) for c in _REPORT_DOUBLES)},
  validation_trades >= 5 AND validation_pnl_sol > 0 AND coalesce(validation_largest_profit_share, 0) <= 0.60 AS survives,
  (SELECT count(DISTINCT mint) FROM features) AS processed_tokens, (SELECT count(*) FROM (VALUES {Q._CONFIG_VALUES}) v(config)) AS configurations FROM frozen""")
def tape_report(spark, d):
    """Finalists as the JSON report of a file run lists them, over a month of trades in two files."""
    w = run_folder(spark)
    got = TapeRun(f"{w}/out", 366, A.HOUR_S, DAY_S, RULES, SCREEN).run_screen(spark, trade_files(spark, d, w), A.token_source)
    rows = got["report"].select("processed_tokens", "configurations", F.explode("frozen_finalists").alias("f"))
    return rows.select(F.col("f.rank"), "f.config", "f.train_trades", "f.validation_trades", *[r6(f"f.{c}").alias(c) for c in _REPORT_DOUBLES],
                       "f.survives", "processed_tokens", "configurations")
