"""Event replay queries: stress scenarios, matched delayed accounts, skipped signals, competition, gaps, curve fills, size sweep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tapelab.functions.gates import BaseGate
from tapelab.operators import admission as AD, pools as PO, replay as R, signals as Sg
from tapelab.plans import oracle_sql as S, pools as PQ
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.plans.screen import HOLD_H, SL, TP, _FIRST, _GATE, _GATE_SQL, signals_of, staged_features
from tapelab.plans.tape import feature_table, staged_tape
from tapelab.operators import outcomes as O
from tapelab.operators.asof import salted_join
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A

COST = 0.0032

# ---- stress scenarios ------------------------------------------------------------------------------------------
S_TP, S_SL, S_HOLD_US = 0.02, -0.05, 6 * A.HOUR_US
_SCEN_VALUES = ", ".join(f"('{x['scenario']}', {x['latency_ms']}::BIGINT, {x['fee_rate']}::DOUBLE, {x['tx_cost']}::DOUBLE, {x['ahead_sol']}::DOUBLE)" for x in R.SCENARIOS)
_SIG = S.FEATURES + f", sig AS (SELECT mint, min(bucket_s) AS signal_s FROM features WHERE {_GATE_SQL} GROUP BY mint)"
_STRESS = _SIG + f""", scen AS (SELECT * FROM (VALUES {_SCEN_VALUES}) v(scenario, latency_ms, fee, cost, ahead)),
want AS (SELECT *, signal_s * 1000000 + 3600000000 + latency_ms * 3600000 AS target FROM sig, scen),
land AS (
  SELECT w.*, t.id AS entry_id, t.event_us AS entry_us, t.curve_pct_depleted AS ec, t.market_cap_sol AS entry_mc,
    t.v_sol_bonding_curve / 1e9 AS q, t.v_tokens_bonding_curve / 1e6 AS k
  FROM want w JOIN tape t ON t.mint = w.mint AND t.event_us >= w.target
  QUALIFY row_number() OVER (PARTITION BY w.mint, w.scenario ORDER BY t.event_us, t.id) = 1
), entq AS (
  SELECT *, CASE WHEN ahead > 0 THEN q + ahead * (1 - fee) ELSE q END AS q2, CASE WHEN ahead > 0 THEN q * k / (q + ahead * (1 - fee)) ELSE k END AS k2 FROM land WHERE ec < 95
), ent AS (SELECT *, k2 - q2 * k2 / (q2 + 0.5 * (1 - fee)) AS tokens FROM entq),
stop AS (SELECT e.mint, e.scenario, min(struct_pack(t := t.event_us, i := t.id)) AS stop FROM ent e JOIN tape t ON t.mint = e.mint AND t.curve_pct_depleted >= 95
  AND (t.event_us, t.id) > (e.entry_us, e.entry_id) GROUP BY ALL),
steps AS (
  SELECT e.mint, e.scenario, e.signal_s, e.entry_us, e.entry_mc, e.cost, t.event_us, t.id, t.market_cap_sol,
    ((t.v_sol_bonding_curve / 1e9 + 0.5 * (1 - fee)) - (t.v_sol_bonding_curve / 1e9 + 0.5 * (1 - fee)) * (t.v_tokens_bonding_curve / 1e6 - tokens)
      / ((t.v_tokens_bonding_curve / 1e6 - tokens) + tokens)) * (1 - fee) - 0.5 - 2 * e.cost AS pnl,
    row_number() OVER (PARTITION BY e.mint, e.scenario ORDER BY t.event_us, t.id) AS n
  FROM ent e JOIN tape t ON t.mint = e.mint AND (t.event_us, t.id) > (e.entry_us, e.entry_id)
  LEFT JOIN stop s ON s.mint = e.mint AND s.scenario = e.scenario
  WHERE tokens > 0 AND t.v_tokens_bonding_curve / 1e6 - tokens > 0 AND (s.stop IS NULL OR struct_pack(t := t.event_us, i := t.id) < s.stop)
), ex AS (
  SELECT mint, scenario, coalesce(min(n) FILTER (WHERE pnl / (0.5 + cost) >= {S_TP} OR pnl / (0.5 + cost) <= {S_SL} OR event_us - entry_us >= {S_HOLD_US}), max(n)) AS xn
  FROM steps GROUP BY ALL
), stressed AS (
  SELECT s.mint, s.scenario, max(s.signal_s) AS signal_s, max(entry_us) AS entry_us, max(event_us) FILTER (WHERE n = xn) AS exit_us, max(pnl) FILTER (WHERE n = xn) AS pnl_sol,
    max(pnl) AS peak_pnl_sol, min(pnl) AS trough_pnl_sol, max(entry_mc) AS entry_mc,
    CASE WHEN max(pnl / (0.5 + cost)) FILTER (WHERE n = xn) >= {S_TP} THEN 'TAKE_PROFIT' WHEN max(pnl / (0.5 + cost)) FILTER (WHERE n = xn) <= {S_SL} THEN 'STOP_LOSS'
      ELSE 'TIMEOUT' END AS exit_reason
  FROM steps s JOIN ex USING (mint, scenario) WHERE n <= xn GROUP BY s.mint, s.scenario
)"""


def stressed(spark, d):
    tape = staged_tape(spark, d)
    sig = Sg.first_match(feature_table(spark, d, tape), {"base": _GATE.batch()}).select("mint", F.unix_micros("bucket").alias("signal_us"))
    return R.stress_replay(cut_lineage(sig), tape, R.SCENARIOS, 0.5, S_TP, S_SL, S_HOLD_US, A.HOUR_US, 3_600_000)


@query("stress_replay", f"""WITH {_STRESS} SELECT mint, scenario, entry_us, exit_us, exit_reason, {r('pnl_sol', 'pnl_sol')}, {r('peak_pnl_sol', 'peak_pnl_sol')},
  {r('trough_pnl_sol', 'trough_pnl_sol')}, {r('entry_mc', 'entry_market_cap_sol')} FROM stressed""")
def stress_replay(spark, d):
    return stressed(spark, d).select("mint", "scenario", "entry_us", "exit_us", "exit_reason", *[r6(c).alias(c) for c in (
        "pnl_sol", "peak_pnl_sol", "trough_pnl_sol", "entry_market_cap_sol")])


# ---- account admission -----------------------------------------------------------------------------------------

def admit_ctes(trades: str, keys: list[str], capital: float, max_open: int, required: str) -> str:
    """admitted(keys, mint, entry_us, exit_us, pnl_sol, exit_reason, accepted): one trade at a time, per account."""
    k = ", ".join(keys)
    on = " AND ".join(f"o.{x} = a.{x}" for x in keys)
    return f""", ordered AS (SELECT *, {required} AS required, row_number() OVER (PARTITION BY {k} ORDER BY entry_us, mint) AS n FROM {trades}
), acct AS (
  SELECT {k}, 0::BIGINT AS n, false AS accepted, CAST([] AS STRUCT(x BIGINT, p DOUBLE)[]) AS slots, 0.0::DOUBLE AS gained FROM ordered GROUP BY ALL
  UNION ALL
  SELECT {', '.join(f'z.{x}' for x in keys)}, z.n, z.ok, CASE WHEN z.ok THEN list_append(z.left_slots, {{'x': z.exit_us, 'p': z.pnl_sol}}) ELSE z.left_slots END, z.gained2
  FROM (SELECT y.*, len(y.left_slots) < {max_open} AND {capital} + y.gained2 - y.required * len(y.left_slots) >= y.required AS ok FROM (
    SELECT {', '.join(f'a.{x}' for x in keys)}, o.n, o.exit_us, o.pnl_sol, o.required, list_filter(a.slots, lambda s: s.x > o.entry_us) AS left_slots,
      a.gained + coalesce(list_sum(list_transform(list_filter(a.slots, lambda s: s.x <= o.entry_us), lambda s: s.p)), 0.0) AS gained2
    FROM acct a JOIN ordered o ON {on} AND o.n = a.n + 1) y) z
), admitted AS (SELECT o.*, a.accepted FROM ordered o JOIN acct a ON {on} AND o.n = a.n)"""


_REPORT = """, acc_eq AS (SELECT *, sum(pnl_sol) OVER (PARTITION BY {k} ORDER BY exit_us, entry_us, mint ROWS UNBOUNDED PRECEDING) AS eq FROM admitted WHERE accepted
), acc_dd AS (SELECT {k}, max(greatest(0, pk) - eq) AS dd FROM (SELECT *, max(eq) OVER (PARTITION BY {k} ORDER BY exit_us, entry_us, mint ROWS UNBOUNDED PRECEDING) AS pk FROM acc_eq) GROUP BY {k}
), report AS (
  SELECT {k}, count(*) AS replayable, count(*) FILTER (WHERE accepted) AS accepted_trades, coalesce(sum(pnl_sol) FILTER (WHERE accepted), 0.0) AS pnl_sol,
    {cap} + coalesce(sum(pnl_sol) FILTER (WHERE accepted), 0.0) AS ending_bankroll_sol,
    count(*) FILTER (WHERE accepted AND pnl_sol > 0) / nullif(count(*) FILTER (WHERE accepted), 0) AS win_rate, coalesce(max(dd), 0.0) AS max_drawdown_sol,
    CASE WHEN sum(pnl_sol) FILTER (WHERE accepted) > 0 THEN max(pnl_sol) FILTER (WHERE accepted) / sum(pnl_sol) FILTER (WHERE accepted) END AS largest_profit_share,
    count(*) FILTER (WHERE accepted AND exit_reason = 'TAKE_PROFIT') AS take_profits, count(*) FILTER (WHERE accepted AND exit_reason = 'STOP_LOSS') AS stop_losses,
    count(*) FILTER (WHERE accepted AND exit_reason = 'TIMEOUT') AS timeouts
  FROM admitted LEFT JOIN acc_dd USING ({k}) GROUP BY {k})"""
_REP_L = ["replayable", "accepted_trades", "take_profits", "stop_losses", "timeouts"]
_REP_D = ["pnl_sol", "ending_bankroll_sol", "win_rate", "max_drawdown_sol", "largest_profit_share"]


def report_cols(df, keys):
    return df.select(*keys, *_REP_L, *[r6(c).alias(c) for c in _REP_D])


@query("account_admission", f"""WITH RECURSIVE {_FIRST} {S.label_ctes('first_hits', TP, SL, HOLD_H * A.HOUR_S)}, acct_trades AS (
  SELECT h.config, l.mint, l.entry_s * 1000000 AS entry_us, l.exit_s * 1000000 AS exit_us, l.pnl_sol, l.exit_reason FROM first_hits h JOIN labelled l
    ON l.mint = h.mint AND l.signal_s = h.signal_s)
{admit_ctes('acct_trades', ['config'], 3.0, 3, '0.5032::DOUBLE')} {_REPORT.format(k='config', cap=3.0)}
SELECT config, {', '.join(_REP_L)}, {', '.join(r(c, c) for c in _REP_D)} FROM report""")
def account_admission(spark, d):
    feats = staged_features(spark, d)
    sig = signals_of(feats)
    trades = sig.join(O.label_trades(sig, feats, TP, SL, HOLD_H * A.HOUR_US), ["mint", "signal_us"])
    admitted = cut_lineage(AD.admit(trades, ["config"], 3.0, 3, 0.5032, extra=["exit_reason"]))
    return report_cols(AD.account_report(admitted, ["config"], 3.0), ["config"])


@query("stress_accounts", f"""WITH RECURSIVE {_STRESS} {admit_ctes('(SELECT s.*, c.cost FROM stressed s JOIN scen c USING (scenario))', ['scenario'], 3.0, 3, '0.5 + cost')}
{_REPORT.format(k='scenario', cap=3.0)} SELECT scenario, {', '.join(_REP_L)}, {', '.join(r(c, c) for c in _REP_D)} FROM report""")
def stress_accounts(spark, d):
    trades = cut_lineage(stressed(spark, d))
    parts = []
    for cost in sorted({x["tx_cost"] for x in R.SCENARIOS}):
        names = [x["scenario"] for x in R.SCENARIOS if x["tx_cost"] == cost]
        parts.append(AD.admit(trades.where(F.col("scenario").isin(names)), ["scenario"], 3.0, 3, 0.5 + cost, extra=["exit_reason"]))
    admitted = reduce(DataFrame.unionByName, parts)
    return report_cols(AD.account_report(cut_lineage(admitted), ["scenario"], 3.0), ["scenario"])


# ---- matched accounts ------------------------------------------------------------------------------------------
FAST_MS, SAFE_MS, WAIT_MS = 612_000, 3_600_000, 18_000_000
ACCOUNTS = [
    {"account": "FAST-170", "entry_delay_ms": FAST_MS, "exit_delay_ms": FAST_MS, "size_sol": 0.5},
    {"account": "SAFE-1000", "entry_delay_ms": SAFE_MS, "exit_delay_ms": SAFE_MS, "size_sol": 0.5},
    *[{"account": f"{s:g}-SOL", "entry_delay_ms": SAFE_MS, "exit_delay_ms": SAFE_MS, "size_sol": s} for s in (1.0, 1.5, 2.0)],
]
PLAN = R.ExitPlan(1.0, -6.0, 6 * A.HOUR_MS)


def internal_for(spend: int) -> int:
    """Brute force for the comparison SQL: the largest amount whose cost with four rounded-up fees stays within spend."""
    cost = lambda q: q + sum(-(-q * b // 10_000) for b in (20, 5, 0, 95))
    q = spend
    q = spend * 10_000 // 10_120 + 20
    while cost(q) > spend:
        q -= 1
    return q


def decided(spark, d, swaps):
    return R.decisions(PQ.decided(spark, d, swaps), swaps, PQ.WINDOW_S)


def guards(swaps):
    return R.guard_at_events(swaps, A.migrations(swaps), PQ.GUARD)


def land(dec, swaps, accounts):
    """Landings of qualified pools; only their swaps are looked up and guarded."""
    theirs = salted_join(swaps, dec.where(F.col("decision") == "QUALIFY").select("pool"), ["pool"], ["receivedSequence"], how="left_semi")
    return R.land_entries(dec, theirs, accounts, SAFE_MS, WAIT_MS, COST, guards(theirs))


def landed(spark, d, swaps, accounts=ACCOUNTS):
    return land(cut_lineage(decided(spark, d, swaps)), swaps, accounts)


def exited(fills, swaps):
    """Filled positions with their exits, whatever the account could pay for."""
    return R.delayed_exits(fills, swaps, ["pool", "account"], PLAN, F.col("exit_delay_ms"), F.col("size_sol"), COST)


def admissions(trades):
    """Trades of the two matched accounts with ``accepted``; positions of other sizes are shadows and take no capacity."""
    base = trades.where(F.col("size_sol") == 0.5).select(
        "account", F.col("pool").alias("mint"), (F.col("entry_ms") * 1000).alias("entry_us"), (F.col("exit_target_ms") * 1000).alias("exit_us"), "pnl_sol",
        F.col("trigger_reason").alias("exit_reason"))
    return AD.admit(base, ["account"], 3.0, 3, 0.5032, extra=["exit_reason"])


def within_capacity(trades):
    """Trades the account took: its own admitted ones, and the size shadows of those that SAFE-1000 took."""
    ok = cut_lineage(admissions(trades)).where("accepted")
    shadows = F.array(*[F.lit(x["account"]) for x in ACCOUNTS if x["size_sol"] != 0.5])
    kept = ok.select("account", F.col("mint").alias("pool")).unionByName(
        ok.where(F.col("account") == "SAFE-1000").select(F.explode(shadows).alias("account"), F.col("mint").alias("pool")))
    return trades.join(kept, ["account", "pool"], "left_semi")


def closed_trades(spark, d, swaps, accounts=ACCOUNTS):
    """Positions that all accounts took, with their exits."""
    fills = cut_lineage(landed(spark, d, swaps, accounts)).where(F.col("status") == "FILLED")
    return within_capacity(cut_lineage(exited(fills, swaps)))


def staged_swaps(spark, d):
    """Swaps written once; the replays look them up several times."""
    return cut_lineage(A.pool_swaps(spark, d))


_ACC_VALUES = ", ".join(f"('{a['account']}', {a['entry_delay_ms']}, {a['exit_delay_ms']}, {a['size_sol']}::DOUBLE, {internal_for(int(a['size_sol'] * 1e9))})" for a in ACCOUNTS)
_MARK = lambda size, toks="tokens", p="": f"({S.sell_net_sql(toks, f'{p}base', f'{p}quote', f'{p}vq')} / 1e9 - {size} - 0.0064)"
DECIDED = PQ._SELECT + f""", st AS (SELECT *, {S.pool_after_sql()} FROM swaps), dec AS (
  SELECT p.pool, p.reasons, CASE WHEN len(p.reasons) = 0 THEN 'QUALIFY' ELSE 'SKIP' END AS decision, m.blockTime, m.logSeq,
    greatest(m.blockTime * 1000 + 7200000, m.blockTime * 1000 + 450) AS submitted_ms FROM picked p JOIN migrations m USING (pool)
), dec2 AS (
  SELECT d.pool, any_value(d.reasons) AS reasons, any_value(d.decision) AS decision, any_value(d.submitted_ms) AS submitted_ms, any_value(blockTime) AS blockTime,
    coalesce(arg_max(s.receivedSequence, struct_pack(a := s.receivedAtMs, b := s.receivedSequence)), any_value(logSeq)) AS decision_seq
  FROM dec d LEFT JOIN swaps s ON s.pool = d.pool AND s.receivedAtMs <= d.submitted_ms GROUP BY d.pool
)"""
LANDED = DECIDED + f""", pk AS (
  SELECT s.pool, s.receivedSequence, {S.spot_mcap_sql()} AS mcap,
    max({S.spot_mcap_sql()}) OVER (PARTITION BY s.pool ORDER BY receivedAtMs, receivedSequence ROWS UNBOUNDED PRECEDING) AS peak
  FROM st s JOIN migrations m USING (pool) WHERE s.ts_s >= m.blockTime
), flow AS (
  SELECT a.pool, a.receivedSequence, coalesce(sum(coalesce(b.userQuoteAmountRaw, b.quoteAmountRaw)) FILTER (WHERE b.side = 'buy'), 0) / 1e9 AS buy_sol,
    coalesce(sum(coalesce(b.userQuoteAmountRaw, b.quoteAmountRaw)) FILTER (WHERE b.side = 'sell'), 0) / 1e9 AS sell_sol
  FROM swaps a JOIN swaps b ON b.pool = a.pool AND b.receivedAtMs >= a.receivedAtMs - 3600000 AND (b.receivedAtMs, b.receivedSequence) <= (a.receivedAtMs, a.receivedSequence)
  GROUP BY ALL
), grd AS (
  SELECT f.pool, f.receivedSequence, (coalesce(100 * (peak - mcap) / peak, 0) >= 1.0 AND sell_sol > buy_sol)
    OR (sell_sol >= 0.1 AND (buy_sol = 0 OR sell_sol / buy_sol >= 2)) AS hit FROM flow f LEFT JOIN pk USING (pool, receivedSequence)
), acc AS (SELECT * FROM (VALUES {_ACC_VALUES}) v(account, entry_delay_ms, exit_delay_ms, size_sol, internal)),
want AS (SELECT d.pool, d.submitted_ms, d.decision_seq, a.* FROM dec2 d, acc a WHERE d.decision = 'QUALIFY'),
landq AS (
  SELECT w.*, s.receivedAtMs AS entry_ms, s.receivedSequence AS entry_seq, s.base, s.quote, s.vq, s.supply
  FROM want w LEFT JOIN st s ON s.pool = w.pool AND s.receivedAtMs >= w.submitted_ms + w.entry_delay_ms
  QUALIFY row_number() OVER (PARTITION BY w.pool, w.account ORDER BY s.receivedAtMs, s.receivedSequence) = 1
), landed AS (
  SELECT l.*, CAST({S.buy_tokens_sql('internal')} AS BIGINT) AS tokens,
    CASE WHEN entry_ms IS NULL OR entry_ms > submitted_ms + {SAFE_MS} + {WAIT_MS} THEN 'NO_FILL' WHEN g.hit THEN 'GUARD' ELSE 'FILLED' END AS status
  FROM landq l LEFT JOIN grd g ON g.pool = l.pool AND g.receivedSequence = l.entry_seq
)"""


def exit_ctes(fills: str, delay: str, size: str, name: str) -> str:
    """``name``: trigger and delayed exit for fills(pool, account, entry_ms, entry_seq, tokens, size)."""
    return f""", {name}_walk AS (
  SELECT f.pool, f.account, s.receivedAtMs AS ms, s.receivedSequence AS seq, 100 * {_MARK('f.' + size, 'f.tokens', 's.')} / f.{size} AS ret
  FROM {fills} f JOIN st s ON s.pool = f.pool AND s.receivedAtMs BETWEEN f.entry_ms AND f.entry_ms + {PLAN.timeout_ms}
    AND (s.receivedAtMs, s.receivedSequence) > (f.entry_ms, f.entry_seq)
), {name}_trig AS (
  SELECT pool, account, min(struct_pack(ms := ms, seq := seq, ret := ret)) AS x FROM {name}_walk WHERE ret >= {PLAN.take_profit} OR ret <= {PLAN.stop_loss} GROUP BY ALL
), {name}_best AS (
  SELECT w.pool, w.account, max(w.ret) AS b FROM {name}_walk w LEFT JOIN {name}_trig t USING (pool, account) WHERE t.x IS NULL OR (w.ms, w.seq) <= (t.x.ms, t.x.seq) GROUP BY ALL
), {name}_trg AS (
  SELECT f.*, coalesce(t.x.ms, f.entry_ms + {PLAN.timeout_ms}) AS trigger_ms, t.x.ret AS trigger_ret,
    CASE WHEN t.x.ret >= {PLAN.take_profit} THEN 'TAKE_PROFIT' WHEN t.x.ret <= {PLAN.stop_loss} THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS trigger_reason,
    greatest(100 * {_MARK('f.' + size, 'f.tokens', 'f.')} / f.{size}, b.b) AS max_ret
  FROM {fills} f LEFT JOIN {name}_trig t USING (pool, account) LEFT JOIN {name}_best b USING (pool, account)
), {name} AS (
  SELECT t.* EXCLUDE (base, quote, vq, supply), t.trigger_ms + t.{delay} AS exit_target_ms, s.receivedSequence AS exit_seq,
    {_MARK('t.' + size, 't.tokens', 's.')} AS pnl_sol, 100 * {_MARK('t.' + size, 't.tokens', 's.')} / t.{size} AS return_pct,
    ({S.sell_net_sql('t.tokens', 's.base', 's.quote', 's.vq')} / 1e9) / (t.tokens / 1e6) * 1e9 AS exit_mcap
  FROM {name}_trg t JOIN st s ON s.pool = t.pool AND s.receivedAtMs <= t.trigger_ms + t.{delay}
  QUALIFY row_number() OVER (PARTITION BY t.pool, t.account ORDER BY s.receivedAtMs DESC, s.receivedSequence DESC) = 1
)"""


_MATCH_TRADES = "(SELECT pool AS mint, account, entry_ms * 1000 AS entry_us, exit_target_ms * 1000 AS exit_us, pnl_sol, trigger_reason AS exit_reason FROM exits_all WHERE size_sol = 0.5)"
# What an account refuses for want of slots or cash has no exit, no shadow and no PnL.
CLOSED = (LANDED + ", filled AS (SELECT * FROM landed WHERE status = 'FILLED')" + exit_ctes("filled", "exit_delay_ms", "size_sol", "exits_all")
          + admit_ctes(_MATCH_TRADES, ["account"], 3.0, 3, "0.5032::DOUBLE") + """, kept AS (
  SELECT account, mint AS pool FROM admitted WHERE accepted
  UNION ALL SELECT e.account, e.pool FROM exits_all e JOIN admitted a ON a.mint = e.pool AND a.account = 'SAFE-1000' AND a.accepted WHERE e.size_sol <> 0.5
), closed AS (SELECT * FROM exits_all SEMI JOIN kept USING (account, pool)), fills AS (SELECT * FROM filled SEMI JOIN kept USING (account, pool)),
taken AS (SELECT l.* REPLACE (CASE WHEN l.status = 'FILLED' AND k.pool IS NULL THEN 'CAPACITY' ELSE l.status END AS status) FROM landed l LEFT JOIN kept k USING (account, pool))""")


@query("landed_entries", f"""WITH {LANDED} SELECT pool, account, submitted_ms, decision_seq, status, entry_ms, entry_seq, CASE WHEN entry_ms IS NOT NULL THEN tokens END AS tokens_raw,
  entry_ms - submitted_ms AS landing_delay_ms, {r('size_sol / (tokens / 1e6) * (supply / 1e6)', 'entry_mcap_sol')} FROM landed""")
def landed_entries(spark, d):
    return landed(spark, d, staged_swaps(spark, d)).select(
        "pool", "account", "submitted_ms", "decision_seq", "status", "entry_ms", "entry_seq", "tokens_raw", "landing_delay_ms", r6("entry_mcap_sol").alias("entry_mcap_sol"))


@query("matched_accounts", f"""WITH RECURSIVE {CLOSED} SELECT pool, account, entry_seq, trigger_reason, trigger_ms, exit_target_ms, exit_seq, {r('pnl_sol', 'pnl_sol')},
  {r('return_pct', 'return_pct')}, {r('max_ret', 'max_ret')} FROM closed""")
def matched_accounts(spark, d):
    return closed_trades(spark, d, staged_swaps(spark, d)).select(
        "pool", "account", "entry_seq", "trigger_reason", "trigger_ms", "exit_target_ms", "exit_seq", *[r6(c).alias(c) for c in ("pnl_sol", "return_pct", "max_ret")])


@query("matched_account_capacity", f"""WITH RECURSIVE {CLOSED} {_REPORT.format(k='account', cap=3.0)} SELECT account, {', '.join(_REP_L)}, {', '.join(r(c, c) for c in _REP_D)} FROM report""")
def matched_account_capacity(spark, d):
    sw = staged_swaps(spark, d)
    fills = landed(spark, d, sw, ACCOUNTS[:2]).where(F.col("status") == "FILLED")
    return report_cols(AD.account_report(cut_lineage(admissions(exited(fills, sw))), ["account"], 3.0), ["account"])


# ---- skipped signals -------------------------------------------------------------------------------------------
DELAYS = [{"account": "FAST-170", "delay_ms": FAST_MS}, {"account": "SAFE-1000", "delay_ms": SAFE_MS}]
SKIPPED = CLOSED + f""", entered AS (SELECT pool, account FROM closed WHERE size_sol = 0.5), cands AS (
  SELECT d.pool, d.submitted_ms AS signal_ms, a.account, a.delay_ms, 0.5::DOUBLE AS size_sol, e.account IS NOT NULL AS was_entered
  FROM dec2 d CROSS JOIN (VALUES ('FAST-170', {FAST_MS}), ('SAFE-1000', {SAFE_MS})) a(account, delay_ms) LEFT JOIN entered e ON e.pool = d.pool AND e.account = a.account
), sk AS (
  SELECT c.*, s.receivedAtMs AS entry_ms, s.receivedSequence AS entry_seq, s.base, s.quote, s.vq, s.supply,
    CAST({S.buy_tokens_sql(str(internal_for(500_000_000)), 's.base', 's.quote', 's.vq')} AS BIGINT) AS tokens
  FROM cands c LEFT JOIN st s ON s.pool = c.pool AND s.receivedAtMs >= c.signal_ms + c.delay_ms
  QUALIFY row_number() OVER (PARTITION BY c.pool, c.account ORDER BY s.receivedAtMs, s.receivedSequence) = 1
), live AS (SELECT * FROM sk WHERE NOT was_entered AND entry_ms IS NOT NULL)
""" + exit_ctes("live", "delay_ms", "size_sol", "skip_exits") + """, cap AS (SELECT max(receivedAtMs) AS capture_end FROM swaps), skipped AS (
  SELECT k.pool, k.account, k.signal_ms, k.entry_ms, k.tokens, k.supply, c.trigger_reason, c.max_ret, c.exit_target_ms, c.exit_mcap, c.pnl_sol, c.return_pct,
    CASE WHEN k.was_entered THEN 'ACTUALLY_ENTERED' WHEN k.entry_ms IS NULL THEN 'NO_EXECUTABLE_POST_TARGET_EVENT'
      WHEN c.trigger_ret IS NULL AND capture_end < k.entry_ms + %d + k.delay_ms THEN 'INCOMPLETE_FORWARD_WINDOW'
      WHEN capture_end < c.exit_target_ms THEN 'INCOMPLETE_EXIT_WINDOW' ELSE 'CLOSED' END AS status
  FROM sk k CROSS JOIN cap LEFT JOIN skip_exits c ON c.pool = k.pool AND c.account = k.account
)""" % PLAN.timeout_ms


def skipped(spark, d, swaps):
    dec = cut_lineage(decided(spark, d, swaps))
    fills = land(dec, swaps, ACCOUNTS[:2]).where(F.col("status") == "FILLED")
    # At most one name per account enters this list.
    entered = within_capacity(cut_lineage(exited(fills, swaps))).groupBy("pool").agg(F.collect_set("account").alias("entered"))
    cands = dec.join(entered, "pool", "left").select("pool", F.col("submitted_ms").alias("signal_ms"),
                                                      F.coalesce("entered", F.array().cast("array<string>")).alias("entered"))
    end = swaps.agg(F.max("receivedAtMs")).scalar()
    return R.replay_skipped(cut_lineage(cands), swaps, DELAYS, end, 0.5, COST, PLAN)


@query("skipped_replay", f"""WITH RECURSIVE {SKIPPED} SELECT pool, account, status, entry_ms, entry_ms - signal_ms AS entry_delay_ms, trigger_reason,
  {r("max_ret", 'maximum_return_pct')}, CASE WHEN status = 'CLOSED' THEN exit_target_ms END AS exit_ms,
  {r("CASE WHEN status = 'CLOSED' THEN pnl_sol END", 'pnl_sol')}, {r("CASE WHEN status = 'CLOSED' THEN return_pct END", 'return_pct')},
  {r("CASE WHEN status = 'CLOSED' THEN exit_mcap END", 'exit_mcap_sol')} FROM skipped""")
def skipped_replay(spark, d):
    return skipped(spark, d, staged_swaps(spark, d)).select(
        "pool", "account", "status", "entry_ms", "entry_delay_ms", "trigger_reason", "exit_ms",
        *[r6(c).alias(c) for c in ("maximum_return_pct", "pnl_sol", "return_pct", "exit_mcap_sol")])


# ---- competition, gaps -----------------------------------------------------------------------------------------
_COMP_L = ["observed_events", "observed_buys", "observed_sells", "independent_buyers", "queue_position"]
_COMP_D = ["buy_sol", "sell_sol", "largest_buy_sol", "largest_sell_sol"]


def comp_ctes(spans: str, lo: str, hi: str) -> str:
    return f""", seen AS (
  SELECT f.pool, f.account, s.side, s.usr, s.receivedAtMs, s.receivedSequence, s.signature, coalesce(s.userQuoteAmountRaw, s.quoteAmountRaw) / 1e9 AS sol
  FROM {spans} f JOIN swaps s ON s.pool = f.pool AND s.receivedSequence > f.{lo} AND s.receivedSequence <= f.{hi}
), comp AS (
  SELECT f.pool, f.account, count(s.side) AS observed_events, count(*) FILTER (WHERE side = 'buy') AS observed_buys, count(*) FILTER (WHERE side = 'sell') AS observed_sells,
    count(DISTINCT usr) FILTER (WHERE side = 'buy') AS independent_buyers, count(*) FILTER (WHERE side = 'buy') + 1 AS queue_position,
    coalesce(sum(sol) FILTER (WHERE side = 'buy'), 0) AS buy_sol, coalesce(sum(sol) FILTER (WHERE side = 'sell'), 0) AS sell_sol,
    coalesce(max(sol) FILTER (WHERE side = 'buy'), 0) AS largest_buy_sol, coalesce(max(sol) FILTER (WHERE side = 'sell'), 0) AS largest_sell_sol
  FROM {spans} f LEFT JOIN seen s ON s.pool = f.pool AND s.account = f.account GROUP BY ALL
), tops AS (
  SELECT pool, account, string_agg(usr, ',' ORDER BY rk) FILTER (WHERE side = 'buy') AS top_buyers, string_agg(usr, ',' ORDER BY rk) FILTER (WHERE side = 'sell') AS top_sellers
  FROM (SELECT pool, account, side, usr, row_number() OVER (PARTITION BY pool, account, side ORDER BY sum(sol) DESC, usr) AS rk FROM seen GROUP BY pool, account, side, usr)
  WHERE rk <= 5 GROUP BY ALL
), sigs AS (
  SELECT pool, account, string_agg(signature, ',' ORDER BY rk) AS signatures FROM (
    SELECT *, row_number() OVER (PARTITION BY pool, account ORDER BY receivedAtMs, receivedSequence) AS rk FROM seen) WHERE rk <= 50 GROUP BY ALL
)"""


_COMP_SELECT = f"""SELECT c.pool, c.account, {', '.join(_COMP_L)}, {', '.join(r(c, c) for c in _COMP_D)}, coalesce(top_buyers, '') AS top_buyers,
  coalesce(top_sellers, '') AS top_sellers, coalesce(signatures, '') AS signatures
FROM comp c LEFT JOIN tops USING (pool, account) LEFT JOIN sigs USING (pool, account)"""


def comp_out(df):
    names = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), lambda x: x["wallet"]), ","), F.lit(""))
    return df.select("pool", "account", *_COMP_L, *[r6(c).alias(c) for c in _COMP_D], names("top_buyers").alias("top_buyers"),
                     names("top_sellers").alias("top_sellers"), F.coalesce(F.array_join("signatures", ","), F.lit("")).alias("signatures"))


@query("competition_before_entry", f"WITH {LANDED}, fills AS (SELECT * FROM landed WHERE status = 'FILLED') {comp_ctes('fills', 'decision_seq', 'entry_seq')} {_COMP_SELECT}")
def competition_before_entry(spark, d):
    sw = staged_swaps(spark, d)
    fills = cut_lineage(landed(spark, d, sw)).where(F.col("status") == "FILLED")
    spans = fills.select("pool", "account", F.col("decision_event_ms").alias("lo_ms"), F.col("entry_ms").alias("hi_ms"),
                         F.col("decision_seq").alias("lo_seq"), F.col("entry_seq").alias("hi_seq"))
    return comp_out(R.competition(spans, sw, ["pool", "account"]))


@query("holding_flow", f"WITH RECURSIVE {CLOSED} {comp_ctes('closed', 'entry_seq', 'exit_seq')} {_COMP_SELECT}")
def holding_flow(spark, d):
    sw = staged_swaps(spark, d)
    done = cut_lineage(closed_trades(spark, d, sw))
    spans = done.select("pool", "account", F.col("entry_ms").alias("lo_ms"), F.col("exit_target_ms").alias("hi_ms"),
                        F.col("entry_seq").alias("lo_seq"), F.col("exit_seq").alias("hi_seq"))
    return comp_out(R.competition(spans, sw, ["pool", "account"]))


_GAPS = ", gaps AS (SELECT DISTINCT receivedAtMs AS gap_ms FROM swaps WHERE receivedSequence % 97 = 0)"


@query("gap_invalidation", f"""WITH RECURSIVE {CLOSED} {_GAPS.replace('gaps AS', 'outages AS')}, x AS (SELECT c.pool, c.account, c.entry_ms, c.exit_target_ms, min(g.gap_ms) AS gap_ms FROM closed c
  LEFT JOIN outages g ON g.gap_ms >= c.entry_ms AND g.gap_ms < c.exit_target_ms GROUP BY ALL) SELECT pool, account, gap_ms IS NOT NULL AS invalidated, gap_ms FROM x""")
def gap_invalidation(spark, d):
    sw = staged_swaps(spark, d)
    gaps = sw.where(F.col("receivedSequence") % 97 == 0).select(F.col("receivedAtMs").alias("gap_ms")).distinct()
    out = R.invalidate_gaps(closed_trades(spark, d, sw).select("pool", "account", "entry_ms", F.col("exit_target_ms").alias("exit_ms")), gaps)
    return out.select("pool", "account", "invalidated", "gap_ms")


# ---- curve fills -----------------------------------------------------------------------------------------------
LIVE_GATE = BaseGate(age_low=3_600, age_high=72_000, curve_low=25, curve_high=82, min_buys_2s=1, min_buy_sol_5s=0.05)
LIVE_GATE_SQL = "age_seconds BETWEEN 3600 AND 72000 AND curve_close BETWEEN 25 AND 82 AND buys_2s >= 1 AND buy_sol_5s >= 0.05 AND return_5s BETWEEN -0.20 AND 0.80"
CURVE_ACCOUNTS = [{"account": "base-670ms", "delay_ms": 670 * 3_600}, {"account": "shadow-1170ms", "delay_ms": 1_170 * 3_600}]
CURVE_PLAN = R.ExitPlan(0.01, -0.05, 6 * A.HOUR_MS)


def live_passes(spark, d, events):
    feats = PO.event_features(events, A.HOUR_MS)
    hit = feats.where(LIVE_GATE.live()).groupBy("mint").agg(F.min(F.struct("receivedAtMs", "receivedSequence")).alias("h"))
    return hit.select("mint", F.col("h.receivedAtMs").alias("ready_ms"), F.col("h.receivedSequence").alias("signal_seq"))


_C_BUY = "CAST(least((CAST({q} AS HUGEINT) * vTok) // (vSol + {q}), realTok) AS BIGINT)"
_C_RAW = "CAST((CAST(f.tokens AS HUGEINT) * (s.vSol + f.internal)) // s.vTok AS BIGINT)"
_C_PNL = f"(({_C_RAW} - {S.ceil_fee(_C_RAW, 's.feeBps')} - {S.ceil_fee(_C_RAW, 's.creatorBps')}) / 1e9 - 0.5 - 0.0064)"


_CURVE = f"""{PQ.LIVE}, passes AS (
  SELECT mint, arg_min(receivedAtMs, struct_pack(a := receivedAtMs, b := receivedSequence)) AS ready_ms FROM live_features WHERE {LIVE_GATE_SQL} GROUP BY mint
), want AS (SELECT * FROM passes, (VALUES ('base-670ms', {670 * 3_600}), ('shadow-1170ms', {1_170 * 3_600})) v(account, delay_ms)),
land AS (
  SELECT w.*, s.receivedAtMs AS entry_ms, s.receivedSequence AS entry_seq, (499999999 * 10000::BIGINT) // (10000 + feeBps + creatorBps) AS internal,
    {_C_BUY.format(q='((499999999 * 10000::BIGINT) // (10000 + feeBps + creatorBps))')} AS tokens
  FROM want w JOIN live s ON s.mint = w.mint AND s.receivedAtMs >= w.ready_ms + w.delay_ms
  QUALIFY row_number() OVER (PARTITION BY w.mint, w.account ORDER BY s.receivedAtMs, s.receivedSequence) = 1
), walk AS (
  SELECT f.mint, f.account, s.receivedAtMs AS ms, s.receivedSequence AS seq, {_C_PNL} AS pnl FROM land f JOIN live s ON s.mint = f.mint
    AND s.receivedAtMs <= f.entry_ms + {CURVE_PLAN.timeout_ms} AND (s.receivedAtMs, s.receivedSequence) >= (f.entry_ms, f.entry_seq)
), trig AS (SELECT w.mint, w.account, min(struct_pack(ms := ms, seq := seq, pnl := pnl)) AS x FROM walk w JOIN land f USING (mint, account)
  WHERE w.seq <> f.entry_seq AND (pnl / 0.5032 >= 0.01 OR pnl / 0.5032 <= -0.05) GROUP BY ALL),
lastw AS (SELECT mint, account, max(struct_pack(ms := ms, seq := seq, pnl := pnl)) AS y FROM walk GROUP BY ALL)"""


@query("curve_fills", f"""WITH {_CURVE}
SELECT f.mint, f.account, f.ready_ms, f.entry_ms, f.entry_seq, coalesce(x.ms, y.ms) AS exit_ms,
  CASE WHEN x.pnl / 0.5032 >= 0.01 THEN 'TAKE_PROFIT' WHEN x.pnl / 0.5032 <= -0.05 THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS exit_reason,
  {r('coalesce(x.pnl, y.pnl)', 'pnl_sol')}, {r('100 * coalesce(x.pnl, y.pnl) / 0.5032', 'return_pct')}
FROM land f LEFT JOIN trig USING (mint, account) JOIN lastw USING (mint, account)""")
def curve_fills(spark, d):
    ev = cut_lineage(PQ.live_curve(spark, d))
    out = R.curve_paper(cut_lineage(live_passes(spark, d, ev)), ev, CURVE_ACCOUNTS, 0.5, COST, CURVE_PLAN)
    return out.select("mint", "account", "ready_ms", "entry_ms", "entry_seq", "exit_ms", "exit_reason", r6("pnl_sol").alias("pnl_sol"), r6("return_pct").alias("return_pct"))


_OUTAGE = 197
_ACCOUNTED = f"""{_CURVE}, fills AS (
  SELECT f.mint, f.account, f.ready_ms, f.entry_ms, coalesce(x.ms, f.entry_ms + {CURVE_PLAN.timeout_ms}) AS closed_ms, coalesce(x.pnl, y.pnl) AS pnl,
    CASE WHEN x.pnl / 0.5032 >= 0.01 THEN 'TAKE_PROFIT' WHEN x.pnl / 0.5032 <= -0.05 THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS exit_reason
  FROM land f LEFT JOIN trig USING (mint, account) JOIN lastw USING (mint, account)
), outages AS (SELECT DISTINCT receivedAtMs AS gap_ms FROM live WHERE receivedSequence % {_OUTAGE} = 0
), waited AS (
  SELECT f.mint, f.account, min(o.gap_ms) FILTER (WHERE o.gap_ms < f.entry_ms) AS lost_ms, min(o.gap_ms) FILTER (WHERE o.gap_ms >= f.entry_ms) AS hit_ms
  FROM fills f JOIN outages o ON o.gap_ms >= f.ready_ms AND o.gap_ms < f.closed_ms GROUP BY ALL
), marked AS (SELECT f.*, lost_ms, hit_ms FROM fills f LEFT JOIN waited USING (mint, account)
), orders AS (
  SELECT mint, account, entry_ms * 1000 AS entry_us, coalesce(hit_ms, closed_ms) * 1000 AS exit_us, CASE WHEN hit_ms IS NULL THEN pnl ELSE 0 END AS pnl_sol,
    CASE WHEN hit_ms IS NULL THEN exit_reason ELSE 'INVALIDATED' END AS exit_reason
  FROM marked WHERE lost_ms IS NULL)""" + admit_ctes("orders", ["account"], 3.0, 3, "0.5032::DOUBLE") + """, accounted AS (
  SELECT m.*, CASE WHEN lost_ms IS NOT NULL THEN 'DROPPED_BY_GAP' WHEN NOT a.accepted THEN 'SKIP_CAPACITY' WHEN hit_ms IS NOT NULL THEN 'INVALIDATED' ELSE 'CLOSED' END AS status
  FROM marked m LEFT JOIN admitted a ON a.mint = m.mint AND a.account = m.account)"""


def accounted(spark, d):
    """Curve fills as the accounts take them; outages are moments drawn from the event sequence."""
    ev = cut_lineage(PQ.live_curve(spark, d))
    fills = R.curve_paper(cut_lineage(live_passes(spark, d, ev)), ev, CURVE_ACCOUNTS, 0.5, COST, CURVE_PLAN)
    gaps = ev.where(F.col("receivedSequence") % _OUTAGE == 0).select(F.col("receivedAtMs").alias("gap_ms")).distinct()
    return R.curve_accounts(cut_lineage(fills), gaps)


@query("curve_account_trades", f"""WITH RECURSIVE {_ACCOUNTED} SELECT mint, account, status, entry_ms, exit_reason, coalesce(lost_ms, CASE WHEN status = 'INVALIDATED' THEN hit_ms END) AS gap_ms,
  CASE status WHEN 'INVALIDATED' THEN hit_ms WHEN 'CLOSED' THEN closed_ms END AS end_ms,
  {r("CASE status WHEN 'INVALIDATED' THEN 0 WHEN 'CLOSED' THEN pnl END", 'pnl_sol')} FROM accounted""")
def curve_account_trades(spark, d):
    return accounted(spark, d).select("mint", "account", "status", "entry_ms", "exit_reason", "gap_ms", "end_ms", r6("pnl_sol").alias("pnl_sol"))


_C_STATUS = {"closed": "CLOSED", "invalidated": "INVALIDATED", "skipped_capacity": "SKIP_CAPACITY", "dropped_by_gap": "DROPPED_BY_GAP"}


@query("curve_account_report", f"""WITH RECURSIVE {_ACCOUNTED} {_REPORT.format(k='account', cap=3.0)}, counted AS (
  SELECT account, {', '.join(f"count(*) FILTER (WHERE status = '{v}') AS {k}" for k, v in _C_STATUS.items())} FROM accounted GROUP BY account)
SELECT account, {', '.join(_C_STATUS)}, {', '.join(_REP_L)}, {', '.join(r(c, c) for c in _REP_D)} FROM counted JOIN report USING (account)""")
def curve_account_report(spark, d):
    done = cut_lineage(accounted(spark, d))
    counted = done.groupBy("account").agg(*[F.count(F.when(F.col("status") == v, 1)).alias(k) for k, v in _C_STATUS.items()])
    landed_orders = done.where("status <> 'DROPPED_BY_GAP'")
    ok = F.col("status").isin("CLOSED", "INVALIDATED")
    trades = landed_orders.select("account", "mint", (F.col("entry_ms") * 1000).alias("entry_us"), (F.col("end_ms") * 1000).alias("exit_us"), "pnl_sol",
                                  F.when(F.col("status") == "INVALIDATED", "INVALIDATED").otherwise(F.col("exit_reason")).alias("exit_reason"), ok.alias("accepted"))
    return report_cols(AD.account_report(trades, ["account"], 3.0), ["account"]).join(counted, "account")
