"""Ledger, report, snapshot, size-sweep and cohort queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tapelab.functions.exprs import floor_div
from tapelab.operators import evaluate as V, ledger as L, outcomes as O, replay as R, signals as Sg, snapshots as N, wallets as J
from tapelab.operators.asof import asof_forward
from tapelab.plans import oracle_sql as S, replay as RQ, wallets as WQ
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.plans.screen import HOLDS, METRIC_DOUBLES, METRIC_LONGS, SLS, TPS, TRAIN_D, VALID_D, _M_SQL, exit_case_sql, split_of, staged_features
from tapelab.plans.tape import staged_tape
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A


# ---- ledgers built from the matched accounts, with seeded duplicates, ghosts and invalidations -------------------
_LEDGER = RQ.CLOSED + """, l_dec AS (
  SELECT pool, submitted_ms AS at_ms, 0 AS seq, decision FROM dec2
  UNION ALL SELECT pool, submitted_ms + 1000, 1, CASE WHEN decision = 'QUALIFY' THEN 'SKIP' ELSE 'QUALIFY' END FROM dec2 WHERE decision_seq % 6 = 0
), l_entries AS (SELECT pool || ':' || entry_seq AS id, pool, entry_seq FROM fills WHERE account = 'SAFE-1000'),
l_exits AS (
  SELECT pool || ':' || entry_seq AS id, pool, pnl_sol FROM closed WHERE account = 'SAFE-1000'
  UNION ALL SELECT 'ghost:' || pool, pool, pnl_sol FROM closed WHERE account = 'FAST-170' AND entry_seq % 2 = 0
), l_void AS (SELECT id FROM l_entries WHERE entry_seq % 7 = 0), l_skips AS (SELECT pool FROM taken WHERE account = 'SAFE-1000' AND status <> 'FILLED'),
l_first AS (SELECT pool, arg_min(decision, struct_pack(a := at_ms, b := seq)) AS decision, min(at_ms) AS at_ms, count(*) - 1 AS duplicates FROM l_dec GROUP BY pool),
l_split AS (
  SELECT x.*, coalesce(f.decision = 'QUALIFY', false) AND x.id IN (SELECT id FROM l_entries) AND x.id NOT IN (SELECT id FROM l_void) AS valid
  FROM l_exits x LEFT JOIN l_first f USING (pool)
)"""


def ledgers(spark, d):
    sw = RQ.staged_swaps(spark, d)
    dec = cut_lineage(RQ.decided(spark, d, sw))
    tried = cut_lineage(RQ.land(dec, sw, RQ.ACCOUNTS[:2]))
    closed = cut_lineage(RQ.within_capacity(cut_lineage(RQ.exited(tried.where(F.col("status") == "FILLED"), sw))))
    took = closed.select("pool", "account", F.lit(True).alias("took"))
    refused = (F.col("status") == "FILLED") & F.col("took").isNull()
    land = tried.join(took, ["pool", "account"], "left").withColumn("status", F.when(refused, "CAPACITY").otherwise(F.col("status"))).drop("took")
    fills = land.where(F.col("status") == "FILLED")
    first = dec.select("pool", F.col("submitted_ms").alias("at"), F.lit(0).alias("decision_seq"), "decision")
    flip = F.when(F.col("decision") == "QUALIFY", "SKIP").otherwise("QUALIFY")
    again = dec.where(F.col("decision_seq") % 6 == 0).select("pool", (F.col("submitted_ms") + 1000).alias("at"), F.lit(1).alias("decision_seq"), flip.alias("decision"))
    key = F.concat_ws(":", "pool", "entry_seq")
    entries = fills.where(F.col("account") == "SAFE-1000").select(key.alias("id"), "pool", "entry_seq")
    ghosts = closed.where((F.col("account") == "FAST-170") & (F.col("entry_seq") % 2 == 0)).select(F.concat(F.lit("ghost:"), F.col("pool")).alias("id"), "pool", "pnl_sol")
    exits = closed.where(F.col("account") == "SAFE-1000").select(key.alias("id"), "pool", "pnl_sol").unionByName(ghosts)
    return {"decisions": first.unionByName(again), "entries": entries, "exits": exits, "invalidated": entries.where(F.col("entry_seq") % 7 == 0).select("id"),
            "skips": land.where((F.col("account") == "SAFE-1000") & (F.col("status") != "FILLED")).select("pool"), "landed": land, "closed": closed, "dec": dec, "swaps": sw}


@query("first_decisions", f"WITH RECURSIVE {_LEDGER} SELECT pool, at_ms AS at, decision, duplicates FROM l_first")
def first_decisions(spark, d):
    return L.first_decisions(ledgers(spark, d)["decisions"]).select("pool", "at", "decision", "duplicates")


def split(g):
    return L.split_exits(g["exits"], L.first_decisions(g["decisions"]), g["entries"], g["invalidated"])


@query("valid_exits", f"WITH RECURSIVE {_LEDGER} SELECT id, pool, valid, {r('pnl_sol', 'pnl_sol')} FROM l_split")
def valid_exits(spark, d):
    return split(ledgers(spark, d)).select("id", "pool", "valid", r6("pnl_sol").alias("pnl_sol"))


@query("corrections", f"WITH RECURSIVE {_LEDGER} SELECT CAST(0 AS BIGINT) AS at, 'EXCLUDED_EXIT' AS type, id, pool, {r('pnl_sol', 'pnl_sol')}, 'DUPLICATE_MIGRATION_REDECISION' AS reason FROM l_split WHERE NOT valid")
def corrections(spark, d):
    return L.corrections(split(ledgers(spark, d)), F.lit(0).cast("long")).withColumn("pnl_sol", r6("pnl_sol"))


@query("rebuilt_account", f"""WITH RECURSIVE {_LEDGER} SELECT count(*) AS completed_trades, {r('coalesce(sum(pnl_sol), 0)', 'realized_pnl_sol')}, count(*) FILTER (WHERE pnl_sol > 0) AS wins,
  count(*) FILTER (WHERE pnl_sol <= 0) AS losses, {r('3.0 + coalesce(sum(pnl_sol), 0)', 'available_bankroll_sol')}, (SELECT count(*) FROM l_first) AS decisions,
  (SELECT CAST(sum(duplicates) AS BIGINT) FROM l_first) AS duplicate_decisions, (SELECT count(DISTINCT pool) FROM l_entries) AS entered,
  (SELECT count(*) FROM l_first WHERE decision = 'SKIP') + (SELECT count(*) FROM l_skips) AS skipped,
  (SELECT count(*) FROM (SELECT id FROM l_void UNION SELECT id FROM l_split WHERE NOT valid)) AS invalidated_trades FROM l_split WHERE valid""")
def rebuilt_account(spark, d):
    g = ledgers(spark, d)
    out = L.rebuild_account(split(g), L.first_decisions(g["decisions"]), g["entries"], g["invalidated"], g["skips"], 3.0)
    return out.withColumns({c: r6(c) for c in ("realized_pnl_sol", "available_bankroll_sol")})


@query("open_positions", f"WITH RECURSIVE {_LEDGER} SELECT id, pool FROM l_entries WHERE id NOT IN (SELECT id FROM l_exits WHERE id NOT IN (SELECT id FROM l_entries WHERE entry_seq % 3 = 0)) AND id NOT IN (SELECT id FROM l_void)")
def open_positions(spark, d):
    g = ledgers(spark, d)
    pending = g["entries"].where(F.col("entry_seq") % 3 == 0)
    return L.open_positions(g["entries"], g["exits"].join(pending, "id", "left_anti"), g["invalidated"]).select("id", "pool")


@query("size_shadow_report", f"""WITH RECURSIVE {RQ.CLOSED}, t AS (SELECT size_sol, pnl_sol, entry_seq % 7 = 0 AS void FROM closed WHERE account <> 'FAST-170'), rep AS (
  SELECT size_sol, count(*) FILTER (WHERE NOT void) AS completed_trades, CAST(0 AS BIGINT) AS open_positions, count(*) FILTER (WHERE NOT void AND pnl_sol > 0) AS wins,
    count(*) FILTER (WHERE NOT void AND pnl_sol <= 0) AS losses, coalesce(sum(pnl_sol) FILTER (WHERE NOT void), 0.0) AS realized_pnl_sol,
    avg(pnl_sol) FILTER (WHERE NOT void) AS average_pnl_sol, count(*) FILTER (WHERE void) AS invalidated_trades FROM t GROUP BY size_sol)
SELECT size_sol, completed_trades, open_positions, wins, losses, invalidated_trades, {r('realized_pnl_sol', 'realized_pnl_sol')}, {r('average_pnl_sol', 'average_pnl_sol')},
  {r('100 * wins / nullif(completed_trades, 0)', 'win_rate_pct')}, {r('least(100, 100 * completed_trades / 10)', 'minimum_progress_pct')},
  {r('least(100, 100 * completed_trades / 40)', 'target_progress_pct')},
  CASE WHEN (SELECT min(completed_trades) FROM rep) >= 40 THEN 'TARGET_REACHED' WHEN (SELECT min(completed_trades) FROM rep) >= 10 THEN 'MINIMUM_REACHED' ELSE 'COLLECTING' END AS status FROM rep""")
def size_shadow_report(spark, d):
    closed = RQ.closed_trades(spark, d, RQ.staged_swaps(spark, d), RQ.ACCOUNTS[1:])
    out = L.shadow_report(closed.select("size_sol", "pnl_sol", (F.col("entry_seq") % 7 == 0).alias("invalidated")), 10, 40)
    return out.withColumns({c: r6(c) for c in ("realized_pnl_sol", "average_pnl_sol", "win_rate_pct", "minimum_progress_pct", "target_progress_pct")})


@query("latency_report", f"""WITH RECURSIVE {RQ.CLOSED}, a AS (SELECT account, entry_delay_ms AS target_delay_ms, count(*) AS matched_signals, count(*) FILTER (WHERE status = 'FILLED') AS entered,
    count(*) FILTER (WHERE status <> 'FILLED') AS skipped FROM taken WHERE size_sol = 0.5 GROUP BY ALL),
t AS (SELECT account, count(*) AS n, sum(pnl_sol) AS p, count(*) FILTER (WHERE pnl_sol > 0) AS w, count(*) FILTER (WHERE pnl_sol <= 0) AS l FROM closed GROUP BY account)
SELECT account, target_delay_ms, matched_signals, entered, skipped, coalesce(n, 0) AS completed_trades, coalesce(w, 0) AS wins, coalesce(l, 0) AS losses,
  {r('coalesce(p, 0)', 'realized_pnl_sol')}, {r('3 + coalesce(p, 0)', 'bankroll_sol')}, entered - coalesce(n, 0) AS open_positions FROM a LEFT JOIN t USING (account)""")
def latency_report(spark, d):
    g = ledgers(spark, d)
    return L.latency_report(g["closed"], g["landed"], 3.0).withColumns({c: r6(c) for c in ("realized_pnl_sol", "bankroll_sol")})


@query("daily_account_summary", f"""WITH RECURSIVE {RQ.CLOSED}, dly AS (SELECT account, exit_target_ms // 86400000 AS d, count(*) AS n, sum(pnl_sol) AS p, count(*) FILTER (WHERE pnl_sol > 0) AS w
  FROM closed WHERE size_sol = 0.5 GROUP BY ALL)
SELECT account, CAST(CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS VARCHAR) AS day, n AS completed_trades, {r('p', 'realized_pnl_sol')}, {r('100 * w / n', 'win_rate_pct')},
  {r('3 + sum(p) OVER (PARTITION BY account ORDER BY d)', 'bankroll_sol')} FROM dly""")
def daily_account_summary(spark, d):
    closed = RQ.closed_trades(spark, d, RQ.staged_swaps(spark, d), RQ.ACCOUNTS[:2])
    out = L.account_summary(closed.withColumn("exit_ms", F.col("exit_target_ms")), 3.0)
    return out.withColumns({c: r6(c) for c in ("realized_pnl_sol", "win_rate_pct", "bankroll_sol")})


@query("case_studies", f"""WITH RECURSIVE {RQ.CLOSED} SELECT c.pool, c.account, m.symbol, m.blockTime * 1000 AS migration_block_ms, m.blockTime * 1000 + 200 AS log_received_ms,
  m.blockTime * 1000 + 450 AS resolved_ms, submitted_ms, entry_ms, trigger_ms, exit_target_ms AS exit_ms, 200 AS block_to_log_ms, 250 AS log_to_resolved_ms,
  submitted_ms - m.blockTime * 1000 - 450 AS resolved_to_signal_ms, entry_ms - submitted_ms AS signal_to_entry_ms, exit_target_ms - trigger_ms AS trigger_to_exit_ms,
  {r('(exit_target_ms - entry_ms) / 1000.0', 'hold_seconds')}, trigger_reason, {r('pnl_sol', 'pnl_sol')}, {r('return_pct', 'return_pct')}
FROM closed c JOIN migrations m USING (pool)""")
def case_studies(spark, d):
    sw = RQ.staged_swaps(spark, d)
    out = L.case_studies(RQ.closed_trades(spark, d, sw), A.migrations(sw))
    return out.withColumns({c: r6(c) for c in ("hold_seconds", "pnl_sol", "return_pct")})


@query("skip_summary", f"""WITH RECURSIVE {RQ.SKIPPED} SELECT account, count(*) AS skipped_candidates, count(*) FILTER (WHERE status = 'CLOSED') AS closed,
  count(*) FILTER (WHERE status = 'CLOSED' AND pnl_sol > 0) AS wins, count(*) FILTER (WHERE status = 'CLOSED' AND pnl_sol <= 0) AS losses,
  count(*) FILTER (WHERE status <> 'CLOSED') AS not_closed, {r("coalesce(sum(round(pnl_sol, 6)) FILTER (WHERE status = 'CLOSED'), 0)", 'total_pnl_sol')}
FROM skipped WHERE status <> 'ACTUALLY_ENTERED' GROUP BY account""")
def skip_summary(spark, d):
    return L.skip_summary(RQ.skipped(spark, d, RQ.staged_swaps(spark, d))).withColumn("total_pnl_sol", r6("total_pnl_sol"))


@query("skip_statuses", f"WITH RECURSIVE {RQ.SKIPPED} SELECT account, status, count(*) AS n FROM skipped WHERE status <> 'ACTUALLY_ENTERED' GROUP BY ALL")
def skip_statuses(spark, d):
    return L.skip_statuses(RQ.skipped(spark, d, RQ.staged_swaps(spark, d)))


@query("skip_winners", f"""WITH RECURSIVE {RQ.SKIPPED} SELECT s.pool, s.account, m.symbol, CASE WHEN l.status IS NOT NULL THEN 'LANDING_GUARD' ELSE 'SELECTOR' END AS skip_stage,
  CASE WHEN l.status IS NOT NULL THEN l.status ELSE array_to_string(d.reasons, '; ') END AS skip_reason, {r('s.pnl_sol', 'pnl_sol')}
FROM skipped s JOIN dec2 d USING (pool) JOIN migrations m USING (pool) LEFT JOIN (SELECT pool, account, status FROM taken WHERE status <> 'FILLED') l
  ON l.pool = s.pool AND l.account = s.account WHERE s.status = 'CLOSED' AND s.pnl_sol > 0""")
def skip_winners(spark, d):
    g = ledgers(spark, d)
    skips = g["landed"].where(F.col("status") != "FILLED").select("pool", "account", F.col("submitted_ms").alias("at"), F.col("status").alias("reason"))
    out = L.skip_winners(RQ.skipped(spark, d, g["swaps"]), g["dec"], A.migrations(g["swaps"]), skips)
    return out.select("pool", "account", "symbol", "skip_stage", "skip_reason", r6("pnl_sol").alias("pnl_sol"))


@query("promotion_gate", f"""WITH RECURSIVE {RQ.CLOSED}, t AS (SELECT account, pnl_sol, entry_seq % 7 = 0 AS void FROM closed WHERE size_sol = 0.5), a AS (
  SELECT count(*) FILTER (WHERE account = 'SAFE-1000' AND NOT void) AS signals, sum(pnl_sol) FILTER (WHERE account = 'SAFE-1000' AND NOT void) AS b,
    sum(pnl_sol) FILTER (WHERE account = 'FAST-170' AND NOT void) AS s, max(pnl_sol) FILTER (WHERE account = 'SAFE-1000' AND NOT void) AS m, count(*) FILTER (WHERE void) AS gaps FROM t)
SELECT signals, {r('b', 'base_pnl_sol')}, {r('s', 'shadow_pnl_sol')}, {r('CASE WHEN b > 0 THEN m / b END', 'largest_profit_share')}, gaps AS data_gaps, signals >= 200 AS enough_signals,
  coalesce(b, 0) > 0 AS base_positive, coalesce(s, 0) > 0 AS shadow_positive, coalesce(CASE WHEN b > 0 THEN m / b END <= 0.25, false) AS not_concentrated, gaps = 0 AS no_data_gaps,
  signals >= 200 AND coalesce(b, 0) > 0 AND coalesce(s, 0) > 0 AND coalesce(CASE WHEN b > 0 THEN m / b END <= 0.25, false) AND gaps = 0 AS promote FROM a""")
def promotion_gate(spark, d):
    t = RQ.closed_trades(spark, d, RQ.staged_swaps(spark, d), RQ.ACCOUNTS[:2]).select("account", "pnl_sol", (F.col("entry_seq") % 7 == 0).alias("invalidated"))
    return V.promotion_gate(t, "SAFE-1000", "FAST-170").withColumns({c: r6(c) for c in ("base_pnl_sol", "shadow_pnl_sol", "largest_profit_share")})


# ---- size sweep ------------------------------------------------------------------------------------------------
SIZES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0]
POOL_FEE = 0.003
_SWEEP = RQ.CLOSED.replace("WITH ", "") + f""", sw_t AS (
  SELECT c.pool || ':' || c.entry_seq AS id, c.pool, c.pnl_sol AS recorded, c.size_sol, c.tokens / 1e6 AS tokens, e.base / 1e6 AS base, e.quote / 1e9 AS quote,
    c.entry_ms // 1000 AS entry_s, c.exit_target_ms // 1000 AS exit_s,
    (SELECT count(*) FROM swaps s WHERE s.pool = c.pool AND s.receivedSequence > c.entry_seq AND s.receivedSequence <= c.exit_seq) AS n
  FROM closed c JOIN st e ON e.pool = c.pool AND e.receivedSequence = c.entry_seq WHERE c.account = 'SAFE-1000' AND c.entry_seq % 11 <> 0
), sw_e AS (
  SELECT t.id, s.side, s.quoteAmountRaw / 1e9 AS q, s.baseAmountRaw / 1e6 AS b, t.n, row_number() OVER (PARTITION BY t.id ORDER BY s.receivedAtMs DESC, s.receivedSequence DESC) AS back,
    s.receivedAtMs, s.receivedSequence FROM sw_t t JOIN swaps s ON s.pool = t.pool AND s.ts_s BETWEEN t.entry_s AND t.exit_s
), sw_k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY receivedAtMs, receivedSequence) AS i FROM sw_e WHERE n = 0 OR back <= n),
sw_ok AS (SELECT t.*, z.size AS sweep FROM sw_t t, (SELECT unnest({SIZES}) AS size) z WHERE coalesce((SELECT count(*) FROM sw_k k WHERE k.id = t.id), 0) = t.n),
sw_fold AS (
  SELECT id, sweep, 0::BIGINT AS i, (base + tokens) - ((base + tokens) * (sweep * {1 - POOL_FEE})) / ((quote - size_sol * {1 - POOL_FEE}) + sweep * {1 - POOL_FEE}) AS b,
    (quote - size_sol * {1 - POOL_FEE}) + sweep * {1 - POOL_FEE} AS q, ((base + tokens) * (sweep * {1 - POOL_FEE})) / ((quote - size_sol * {1 - POOL_FEE}) + sweep * {1 - POOL_FEE}) AS got FROM sw_ok
  UNION ALL
  SELECT f.id, f.sweep, k.i, CASE WHEN k.side = 'buy' THEN f.b - f.b * (k.q * {1 - POOL_FEE}) / (f.q + k.q * {1 - POOL_FEE}) ELSE f.b + k.b * {1 - POOL_FEE} END,
    CASE WHEN k.side = 'buy' THEN f.q + k.q * {1 - POOL_FEE} ELSE f.q - f.q * (k.b * {1 - POOL_FEE}) / (f.b + k.b * {1 - POOL_FEE}) END, f.got
  FROM sw_fold f JOIN sw_k k ON k.id = f.id AND k.i = f.i + 1
), sized AS (
  SELECT o.id, o.sweep AS sweep_size, o.size_sol, o.recorded, f.q * (f.got * {1 - POOL_FEE}) / (f.b + f.got * {1 - POOL_FEE}) AS proceeds_sol
  FROM sw_ok o JOIN sw_fold f ON f.id = o.id AND f.sweep = o.sweep AND f.i = o.n
), sized2 AS (SELECT *, proceeds_sol - sweep_size - 0.0064 AS pnl FROM sized)"""


def size_replays(spark, d):
    g = ledgers(spark, d)
    safe = g["closed"].where(F.col("account") == "SAFE-1000")
    sw = g["swaps"]
    spans = safe.select("pool", "account", F.col("entry_ms").alias("lo_ms"), F.col("exit_target_ms").alias("hi_ms"), F.col("entry_seq").alias("lo_seq"), F.col("exit_seq").alias("hi_seq"))
    n = R.competition(spans, sw, ["pool", "account"]).select("pool", F.col("observed_events").alias("external_swaps"))
    key = F.concat_ws(":", "pool", "entry_seq")
    exits = safe.join(n, "pool").select(key.alias("id"), "pool", floor_div(F.col("entry_ms"), 1000).alias("entry_s"),
                                        floor_div(F.col("exit_target_ms"), 1000).alias("exit_s"), "external_swaps", "pnl_sol")
    st = F.col("entry_state")
    entries = safe.select(key.alias("id"), (st["base"] / 1e6).alias("base"), (st["quote"] / 1e9).alias("quote"), (F.col("tokens_raw") / 1e6).alias("tokens"), "size_sol")
    corr = safe.where(F.col("entry_seq") % 11 == 0).select(key.alias("id"), F.lit("EXCLUDED_EXIT").alias("type"))
    return R.replay_sizes(R.usable_exits(exits, entries, corr), sw, SIZES, POOL_FEE, RQ.COST)


@query("size_replays", f"WITH RECURSIVE {_SWEEP} SELECT id, sweep_size, {r('proceeds_sol', 'proceeds_sol')}, {r('pnl', 'pnl_sol')}, {r('100 * pnl / sweep_size', 'return_pct')} FROM sized2")
def size_replays_q(spark, d):
    return size_replays(spark, d).select("id", "sweep_size", *[r6(c).alias(c) for c in ("proceeds_sol", "pnl_sol", "return_pct")])


@query("size_summary", f"""WITH RECURSIVE {_SWEEP} SELECT sweep_size, count(*) AS trades, {r('sum(pnl)', 'total_pnl_sol')}, {r('avg(pnl)', 'average_pnl_sol')},
  {r('avg(100 * pnl / sweep_size)', 'average_return_pct')}, count(*) FILTER (WHERE pnl > 0) AS wins, {r('sum(pnl) - max(pnl)', 'no_best_trade_pnl_sol')},
  {r('max(abs(pnl - recorded)) FILTER (WHERE sweep_size = size_sol)', 'max_replay_error_sol')} FROM sized2 GROUP BY sweep_size""")
def size_summary(spark, d):
    return R.size_summary(size_replays(spark, d)).select("sweep_size", "trades", "wins", *[r6(c).alias(c) for c in (
        "total_pnl_sol", "average_pnl_sol", "average_return_pct", "no_best_trade_pnl_sol", "max_replay_error_sol")])


# ---- wallet cohorts --------------------------------------------------------------------------------------------
COHORTS = [{"top_n": n, "confirmations": k, "window_s": w} for n in (3, 5, 10, 15, 20)
           for k, w in [(1, None), *product((2, 3), (10_800, 36_000, 72_000))]]
_COHORT_VALUES = ", ".join(f"({i}, {c['top_n']}, {c['confirmations']}, {c['window_s'] or 'NULL'}::BIGINT)" for i, c in enumerate(COHORTS))
_COHORT = WQ._POS + f""", ranked AS (SELECT wallet, row_number() OVER (ORDER BY pnl_sol DESC, wallet) AS wallet_rank FROM selected),
cohorts AS (SELECT * FROM (VALUES {_COHORT_VALUES}) v(cohort, top_n, k, w)), numbered AS (
  SELECT c.*, f.mint, f.first_buy_us, row_number() OVER (PARTITION BY c.cohort, f.mint ORDER BY f.first_buy_us, r.wallet_rank) AS n
  FROM cohorts c JOIN ranked r ON r.wallet_rank <= c.top_n JOIN first_buys f ON f.wallet = r.wallet
), cohort_signals AS (
  SELECT cohort, mint, max(first_buy_us) AS signal_us FROM numbered WHERE n <= k GROUP BY cohort, mint, k, w
  HAVING count(*) = k AND (k = 1 OR max(first_buy_us) - min(first_buy_us) <= w * 1000000)
)"""


def cohort_signals(spark, d):
    tape = staged_tape(spark, d)
    sel = cut_lineage(WQ.selected(spark, d, tape))
    return Sg.cohort_signals(J.first_buys(tape, sel), J.wallet_ranks(sel), COHORTS)


@query("cohort_signals", f"WITH {_COHORT} SELECT cohort, mint, signal_us FROM cohort_signals")
def cohort_signals_q(spark, d):
    return cohort_signals(spark, d).select("cohort", "mint", F.unix_micros("signal_time").alias("signal_us"))


_COHORT_AT = _COHORT + """, at_bar AS (
  SELECT s.cohort, s.mint, min(b.bucket_s) AS signal_s FROM cohort_signals s JOIN bars b ON b.mint = s.mint AND b.bucket_s * 1000000 >= s.signal_us GROUP BY s.cohort, s.mint)"""


@query("cohort_sweep", f"""WITH {_COHORT_AT} {S.path_ctes('at_bar', max_elapsed_s=18 * A.HOUR_S)} {exit_case_sql()}, co_trades AS (
  SELECT a.cohort, w.exit_id, w.mint, w.exit_s, w.pnl_sol, w.exit_reason, {S.split_case('w.entry_s', '(SELECT min(bucket_s) FROM bars)', TRAIN_D, VALID_D)} AS split
  FROM at_bar a JOIN swept w ON w.mint = a.mint AND w.signal_s = a.signal_s) {S.metric_ctes('co_trades', 'cohort, exit_id, split', 'co_metrics')}
SELECT cohort, exit_id, split, {_M_SQL} FROM co_metrics""")
def cohort_sweep(spark, d):
    """Cohort signals enter at the second bar at or after the signal, then run through the whole exit grid."""
    feats = staged_features(spark, d)
    sig = cohort_signals(spark, d).withColumn("sig_us", F.unix_micros("signal_time"))
    bars = feats.select("mint", F.unix_micros("bucket").alias("b"))
    at = asof_forward(sig.select("cohort", "mint", "sig_us"), bars, ["mint"], F.col("sig_us"), F.col("b"), [], "bar")
    at = cut_lineage(at.select("cohort", "mint", F.col("bar.b").alias("signal_us")).where(F.col("signal_us").isNotNull()))
    swept = O.sweep_exits(at, feats, TPS, SLS, HOLDS, A.HOUR_US, 18 * A.HOUR_US)
    trades = at.join(swept, ["mint", "signal_us"]).withColumn("split", split_of(feats))
    m = V.trade_metrics(trades, ["cohort", "exit_id", "split"])
    return m.select("cohort", F.col("exit_id").cast("long").alias("exit_id"), "split", *METRIC_LONGS, *[r6(c).alias(c) for c in METRIC_DOUBLES])


# ---- snapshots -------------------------------------------------------------------------------------------------

def raw_snapshots(spark, d):
    """One capture document per order, its lines as pool entries, at most eight lines per document."""
    li = A.table(spark, d, "lineitem")
    entry = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.concat(F.lit("pool"), F.col("l_partkey")).alias("pool"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit("other")).otherwise(F.lit("pumpswap")).alias("dex"), F.concat(F.lit("solana_mint"), F.col("l_partkey")).alias("mint"),
        F.when(F.col("l_quantity") > 45, F.lit("solana_usd")).otherwise(F.lit(f"solana_{N.WRAPPED_SOL}")).alias("quoteMint"),
        (F.col("l_partkey") * 1000).alias("poolCreatedAt"), F.col("l_extendedprice").alias("priceSol"))
    docs = li.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 8).alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return docs.select((F.lit(1_700_000_000_000) + F.col("l_orderkey") * 1000 + F.col("page")).alias("capturedAt"), "entries")


_SNAP = """snap AS (
  SELECT 1700000000000 + l_orderkey * 1000 + l_linenumber // 8 AS capturedAt, 'pool' || l_partkey AS pool, l_partkey, l_linenumber, l_quantity, l_extendedprice,
    CASE WHEN l_suppkey % 4 = 0 THEN 'other' ELSE 'pumpswap' END AS dex, l_quantity > 45 AS usd FROM lineitem
), universe AS (
  SELECT capturedAt, pool, 'mint' || l_partkey AS mint, l_partkey * 1000 AS poolCreatedAt, l_extendedprice AS priceSol, (capturedAt - l_partkey * 1000) / 1000.0 AS ageSeconds, l_partkey
  FROM snap WHERE dex = 'pumpswap' AND NOT usd QUALIFY row_number() OVER (PARTITION BY capturedAt, pool ORDER BY l_linenumber DESC, l_quantity DESC) = 1
), flagged AS (SELECT *, coalesce(l_partkey % 3 = 0 AND l_partkey % 2 = 0, false) AS canonical FROM universe),
firsts AS (SELECT pool, arg_min(canonical, capturedAt) AS canonical, min(capturedAt) AS capturedAt FROM flagged GROUP BY pool)"""


def universe(spark, d):
    pools = N.snapshot_universe(raw_snapshots(spark, d))
    p = A.table(spark, d, "part")
    coins = p.select(F.concat(F.lit("mint"), F.col("p_partkey")).alias("mint"), (F.col("p_partkey") % 3 == 0).alias("complete"),
                     F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("pool"), F.col("p_partkey"))).alias("poolAddress"), F.col("p_name").alias("symbol"))
    return N.flag_canonical(pools, coins)


@query("snapshot_universe", f"WITH {_SNAP} SELECT capturedAt, pool, mint, poolCreatedAt, {r('priceSol', 'priceSol')}, {r('ageSeconds', 'ageSeconds')}, canonical FROM flagged")
def snapshot_universe(spark, d):
    return universe(spark, d).select("capturedAt", "pool", "mint", "poolCreatedAt", r6("priceSol").alias("priceSol"), r6("ageSeconds").alias("ageSeconds"), "canonical")


@query("first_seen_pools", f"WITH {_SNAP} SELECT pool, capturedAt, canonical FROM firsts WHERE pool NOT IN (SELECT 'pool' || p_partkey FROM part WHERE p_size > 40)")
def first_seen_pools(spark, d):
    seen = A.table(spark, d, "part").where("p_size > 40").select(F.concat(F.lit("pool"), F.col("p_partkey")).alias("pool"))
    return N.first_seen(universe(spark, d), "pool", ["capturedAt"], seen).select("pool", "capturedAt", "canonical")


@query("coverage_report", f"""WITH {_SNAP} SELECT (SELECT count(DISTINCT capturedAt) FROM snap) AS snapshots, (SELECT count(*) FROM firsts) AS unique_pools,
  (SELECT count(*) FROM firsts WHERE canonical) AS canonical_pools, (SELECT min(capturedAt) FROM snap) AS first_capture, (SELECT max(capturedAt) FROM snap) AS latest_capture""")
def coverage_report(spark, d):
    raw = raw_snapshots(spark, d)
    return N.coverage_report(raw.select("capturedAt"), N.first_seen(universe(spark, d), "pool", ["capturedAt"]))
