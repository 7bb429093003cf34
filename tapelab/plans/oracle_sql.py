"""Shared SQL fragments (DuckDB dialect) for the comparison queries: the same adapters as sources.adapters."""

from __future__ import annotations


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


BASE = """
ev AS (
  SELECT event_id AS id, epoch_us(ts) AS t_us, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS k20,
         strftime(ts, '%Y%m%d') AS day, user_id,
         event_type IN ('purchase', 'click', 'signup') AS is_buy,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
), ev2 AS (
  SELECT *, 'm' || k20 || '-' || day AS mint, (CASE WHEN is_buy THEN cents ELSE -cents END) * 100000 AS delta FROM ev
), ev3 AS (
  SELECT *, CAST(30000000000 + sum(delta) OVER (PARTITION BY mint ORDER BY t_us, id) AS BIGINT) AS v_sol,
         min(t_us) OVER (PARTITION BY mint) AS launch_us FROM ev2
), base AS (
  SELECT *, v_sol - delta AS v_sol_before,
         CAST(CAST('32190000000000000000000000' AS HUGEINT) // v_sol AS BIGINT) AS v_tok,
         CAST(CAST('32190000000000000000000000' AS HUGEINT) // (v_sol - delta) AS BIGINT) AS v_tok_before,
         k20 * 1000 + CAST(day AS BIGINT) % 100 AS tok
  FROM ev3
)"""

RAW = BASE + """, raw_tape AS (
  SELECT id, mint, 's' || id AS tx_signature, t_us AS event_us,
    CASE WHEN id % 113 = 17 THEN -5.0 ELSE (t_us - launch_us) / 1e6 END AS seconds_since_launch,
    is_buy,
    CASE WHEN id % 101 <> 7 THEN cents / 10000.0 END AS sol_amount,
    floor((cents / 10000.0) / price) * (CASE WHEN id % 107 = 11 THEN 100000.0 ELSE 1.0 END) AS token_amount,
    CASE WHEN user_id % 50 = 49 THEN 'system' ELSE 'w' || user_id END AS user_wallet,
    v_tok AS v_tokens_bonding_curve, v_sol AS v_sol_bonding_curve,
    price * 1e9 AS market_cap_sol,
    CASE WHEN id % 103 = 9 THEN 0.0 ELSE price END AS price_sol,
    CASE WHEN id % 109 = 13 THEN 140.0 ELSE v_sol / 85e9 * 100 END AS curve_pct_depleted,
    tok
  FROM (SELECT *, (v_sol / 1e9) / (v_tok / 1e6) AS price FROM base)
)"""

# Rows out, one set per cause; what no cause names is the tape. A comparison with a missing value names no row, so gaps have a set of their own.
REJECTS = [
    "user_wallet = 'system'",
    "sol_amount IS NULL OR price_sol IS NULL OR token_amount IS NULL",
    "least(sol_amount, token_amount, price_sol) <= 0",
    "abs(log10(sol_amount / nullif(token_amount * price_sol, 0))) > 2",
    "curve_pct_depleted NOT BETWEEN 0 AND 100",
    "seconds_since_launch < 0",
]

TAPE = RAW + ", rejected AS (" + " UNION ".join(f"SELECT id FROM raw_tape WHERE {c}" for c in REJECTS) + """
), tape AS (SELECT * FROM raw_tape ANTI JOIN rejected USING (id))"""

TOKEN_SOURCE = TAPE + """, token_source AS (
  SELECT mint, detected_us, 'Token ' || tok AS name, 'T' || tok AS symbol, tok % 5 = 0 AS is_mayhem_mode, creator,
    tok % 7 AS creator_past_tokens, tok % 3 AS creator_past_rugs, initial_buy_sol, initial_market_cap_sol,
    tok % 40 + 2 AS initial_holder_count, tok % 13 + 1.5::DOUBLE AS initial_top1_pct_corrected,
    (tok % 13 + 1.5::DOUBLE) * 2 AS initial_top5_pct_corrected,
    CASE WHEN tok % 23 <> 0 THEN (tok % 13 + 1.5::DOUBLE) * 2.5 END AS initial_top10_pct_corrected,
    CAST(tok % 9 AS DOUBLE) AS dev_buy_pct_corrected, (tok % 17) / 20.0 AS initial_gini,
    tok % 2 = 0 AS is_cashback_enabled, CASE WHEN tok % 4 <> 0 THEN tok % 11 = 0 END AS top10_pct_suspect
  FROM (
    SELECT mint, tok, min(event_us) AS detected_us,
      arg_min(user_wallet, struct_pack(t := event_us, i := id)) FILTER (WHERE is_buy) AS creator,
      arg_min(sol_amount, struct_pack(t := event_us, i := id)) FILTER (WHERE is_buy) AS initial_buy_sol,
      arg_min(market_cap_sol, struct_pack(t := event_us, i := id)) AS initial_market_cap_sol
    FROM tape GROUP BY mint, tok)
), tokens AS (
  SELECT * EXCLUDE (top10_pct_suspect) FROM token_source
  WHERE NOT coalesce(top10_pct_suspect, false) AND mint IN (SELECT DISTINCT mint FROM tape)
)"""

def _of(rows: str, column: str) -> str:
    return f"list_transform({rows}, lambda x: x.{column})"


# Hourly bars from each hour's trades as one ordered list; ages up to one day.
BARS = TOKEN_SOURCE + """, hours AS (
  SELECT mint, event_us // 3600000000 AS hour, list(tape ORDER BY event_us, id) AS every FROM tape WHERE seconds_since_launch <= 86400 GROUP BY ALL
), sided AS (
  SELECT *, list_filter(every, lambda x: x.is_buy) AS bought, list_filter(every, lambda x: NOT x.is_buy) AS sold FROM hours
), bars AS (
  SELECT mint, hour * 3600 AS bucket_s, """ + ", ".join([
    f"list_min({_of('every', 'seconds_since_launch')}) AS age_seconds",
    *[f"len({rows}) AS {name}s, CAST(list_unique({_of(rows, 'user_wallet')}) AS BIGINT) AS {name}ers, "
      f"CASE WHEN len({rows}) > 0 THEN list_sum({_of(rows, 'sol_amount')}) END AS {name}_sol, list_max({_of(rows, 'sol_amount')}) AS largest_{name}_sol"
      for rows, name in (("bought", "buy"), ("sold", "sell"))],
    "every[1].market_cap_sol AS mc_open", "every[-1].market_cap_sol AS mc_close",
    f"list_max({_of('every', 'market_cap_sol')}) AS mc_high", f"list_min({_of('every', 'market_cap_sol')}) AS mc_low",
    *[f"every[-1].{c} AS {name}" for c, name in (("curve_pct_depleted", "curve_close"), ("v_tokens_bonding_curve", "v_tokens_close"),
                                                  ("v_sol_bonding_curve", "v_sol_close"), ("event_us", "last_event_us"))]]) + """
  FROM sided
)"""

# Trailing frames: every bar joined to the bars of its mint up to it, told apart by their distance in hours.
_SUMS = {"buys": "buys", "sells": "sells", "buyer_seconds": "buyers", "seller_seconds": "sellers", "buy_sol": "coalesce(o.buy_sol, 0)", "sell_sol": "coalesce(o.sell_sol, 0)"}
_HOURS = {2: 1, 5: 4, 15: 14, 60: 59}


def _within(seconds: int) -> str:
    return f"FILTER (WHERE h <= {_HOURS[seconds]})"


def _frame_sum(name: str, seconds: int) -> str:
    total = f"sum({_SUMS[name] if 'coalesce' in _SUMS[name] else 'o.' + _SUMS[name]}) {_within(seconds)}"
    return f"{total if name.endswith('_sol') else f'CAST({total} AS BIGINT)'} AS {name}_{seconds}s"


FEATURES = BARS + """, near AS (
  SELECT b.mint, b.bucket_s, (b.bucket_s - o.bucket_s) // 3600 AS h, o.* EXCLUDE (mint, bucket_s) FROM bars b JOIN bars o ON o.mint = b.mint AND o.bucket_s <= b.bucket_s
), frames AS (
  SELECT mint, bucket_s, """ + ", ".join([
    *[_frame_sum(n, s) for s in (2, 5, 15) for n in _SUMS if (n, s) != ("seller_seconds", 15)],
    f"max(mc_high) {_within(60)} AS peak_mc_60s", f"min(mc_low) {_within(15)} AS low_mc_15s",
    *[f"max_by(mc_open, h) {_within(s)} AS mc_{s}s_ago" for s in (5, 15)],
    "min_by(mc_close, h) FILTER (WHERE h > 0) AS previous_mc_close"]) + """
  FROM near o GROUP BY mint, bucket_s
), trails AS (SELECT * FROM bars JOIN frames USING (mint, bucket_s)
), derived AS (
  SELECT *, """ + ", ".join([
    *[f"{n}_15s - {n}_5s AS prior_{n}_5_to_15s" for n in ("buys", "buyer_seconds", "buy_sol", "sell_sol")],
    *[f"mc_close / nullif({c}, 0) - 1 AS {name}" for c, name in (
        ("mc_5s_ago", "return_5s"), ("mc_15s_ago", "return_15s"), ("peak_mc_60s", "drawdown_from_60s_peak"), ("low_mc_15s", "bounce_from_15s_low"),
        ("previous_mc_close", "one_bar_return"))]]) + """
  FROM trails
), features AS (
  SELECT derived.*, COLUMNS(t.* EXCLUDE (mint, detected_us, name, symbol, creator)) FROM derived LEFT JOIN tokens t ON t.mint = derived.mint
)"""

SWAPS = BASE + """, swaps AS (
  SELECT 's' || id AS signature, t_us // 1000 AS receivedAtMs, id AS receivedSequence,
    CASE WHEN is_buy THEN 'buy' ELSE 'sell' END AS side, t_us // 1000000 AS ts_s,
    abs(v_tok - v_tok_before) AS baseAmountRaw, v_tok_before AS baseReserveRaw, v_sol_before AS quoteReserveRaw,
    abs(delta) AS quoteAmountRaw,
    CASE WHEN id % 5 <> 0 THEN abs(delta) END AS quoteReserveDeltaRaw,
    CASE WHEN id % 7 <> 0 THEN abs(delta) END AS userQuoteAmountRaw,
    2000000000 AS virtualQuoteReservesRaw,
    CASE WHEN id % 3 <> 0 THEN 1000000000000000 END AS baseSupplyRaw,
    mint AS pool, 'w' || user_id AS usr
  FROM base
), migrations AS (
  SELECT pool, min(ts_s) AS blockTime, min(receivedSequence) AS logSeq, 'sym-' || pool AS symbol FROM swaps GROUP BY pool
)"""

CURVE = BASE + """, curve_events AS (
  SELECT t_us // 1000 AS receivedAtMs, id AS receivedSequence, mint,
    CASE WHEN user_id % 50 = 49 THEN 'system' ELSE 'w' || user_id END AS usr, is_buy AS isBuy,
    abs(delta) AS solAmountRaw, v_sol AS vSol, v_tok AS vTok, v_sol - 30000000000 AS realSol,
    v_tok - 279900000000000 AS realTok, 95 AS feeBps, CASE WHEN tok % 2 = 0 THEN 5 ELSE 30 END AS creatorBps,
    tok % 5 = 0 AS mayhem
  FROM base
)"""


def path_ctes(signals: str, size: float = 0.5, fee: float = 0.0125, cost: float = 0.0032, max_elapsed_s: int | None = None) -> str:
    """Entry and quotable path rows for ``signals`` (mint, signal_s)."""
    eff = f"({size} * (1 - {fee}))"
    bound = f"AND b.bucket_s - e.entry_s <= {max_elapsed_s}" if max_elapsed_s else ""
    return f""", path AS (
  SELECT mint, bucket_s, row_number() OVER (PARTITION BY mint ORDER BY bucket_s) AS rn, curve_close, mc_close,
    v_sol_close / 1e9 AS q, v_tokens_close / 1e6 AS t FROM bars
), ent AS (
  SELECT s.mint, s.signal_s, e.rn AS entry_rn, e.bucket_s AS entry_s, e.mc_close AS entry_mc,
    e.t - e.q * e.t / (e.q + {eff}) AS tokens
  FROM (SELECT DISTINCT mint, signal_s FROM {signals}) s
  JOIN path p ON p.mint = s.mint AND p.bucket_s = s.signal_s JOIN path e ON e.mint = p.mint AND e.rn = p.rn + 1
  WHERE e.curve_close < 95
), stop AS (
  SELECT ent.mint, ent.signal_s, min(c.rn) AS stop_rn FROM ent JOIN path c ON c.mint = ent.mint AND c.rn > ent.entry_rn
  WHERE c.curve_close >= 95 GROUP BY ALL
), steps AS (
  SELECT e.mint, e.signal_s, e.entry_s, e.entry_mc, b.rn, b.bucket_s, b.mc_close, b.bucket_s - e.entry_s AS elapsed,
    ((b.q + {eff}) - (b.q + {eff}) * (b.t - e.tokens) / ((b.t - e.tokens) + e.tokens)) * (1 - {fee}) - {size} - 2 * {cost} AS pnl
  FROM ent e JOIN path b ON b.mint = e.mint AND b.rn > e.entry_rn
  LEFT JOIN stop s ON s.mint = e.mint AND s.signal_s = e.signal_s
  WHERE e.tokens > 0 AND b.t - e.tokens > 0 AND (s.stop_rn IS NULL OR b.rn < s.stop_rn) {bound}
)"""


def label_ctes(signals: str, tp: float, sl: float, hold_s: int, size: float = 0.5, fee: float = 0.0125, cost: float = 0.0032) -> str:
    basis = f"({size} + {cost})"
    return path_ctes(signals, size, fee, cost) + f""", fired AS (
  SELECT *, pnl / {basis} AS ret,
    row_number() OVER (PARTITION BY mint, signal_s ORDER BY rn) AS k,
    (pnl / {basis} >= {tp} OR pnl / {basis} <= {sl} OR elapsed >= {hold_s}) AS hit FROM steps
), exit_k AS (
  SELECT mint, signal_s, coalesce(min(k) FILTER (WHERE hit), max(k)) AS xk FROM fired GROUP BY ALL
), labelled AS (
  SELECT f.mint, f.signal_s, max(f.entry_s) AS entry_s, max(f.entry_mc) AS entry_mc,
    max(f.bucket_s) FILTER (WHERE k = xk) AS exit_s, max(pnl) FILTER (WHERE k = xk) AS pnl_sol,
    max(mc_close) FILTER (WHERE k = xk) AS exit_mc,
    max(pnl) AS peak_pnl_sol, min(pnl) AS trough_pnl_sol,
    CASE WHEN max(ret) FILTER (WHERE k = xk) >= {tp} THEN 'TAKE_PROFIT'
         WHEN max(ret) FILTER (WHERE k = xk) <= {sl} THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS exit_reason
  FROM fired f JOIN exit_k x ON x.mint = f.mint AND x.signal_s = f.signal_s WHERE f.k <= x.xk GROUP BY f.mint, f.signal_s
)"""


def split_case(t: str, start: str, train_days: int = 16, validation_days: int = 4) -> str:
    return (f"CASE WHEN {t} < {start} + {train_days} * 86400 THEN 'train' "
            f"WHEN {t} < {start} + {train_days + validation_days} * 86400 THEN 'validation' ELSE 'test' END")


def metric_ctes(trades: str, keys: str, name: str = "metrics") -> str:
    """Metrics per key from (keys, mint, exit_s, pnl_sol, exit_reason)."""
    return f""", eq_{name} AS (
  SELECT *, sum(pnl_sol) OVER (PARTITION BY {keys} ORDER BY exit_s, mint ROWS UNBOUNDED PRECEDING) AS eq FROM {trades}
), dd_{name} AS (
  SELECT *, greatest(0, max(eq) OVER (PARTITION BY {keys} ORDER BY exit_s, mint ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM eq_{name}
), {name} AS (
  SELECT {keys}, count(*) AS trades, sum(pnl_sol) AS pnl_sol, sum(pnl_sol) / count(*) AS average_pnl_sol,
    count(*) FILTER (WHERE pnl_sol > 0) / count(*) AS win_rate,
    CASE WHEN sum(pnl_sol) > 0 THEN max(pnl_sol) / sum(pnl_sol) END AS largest_profit_share,
    max(dd) AS max_drawdown_sol,
    count(*) FILTER (WHERE exit_reason = 'TAKE_PROFIT') AS take_profits,
    count(*) FILTER (WHERE exit_reason = 'STOP_LOSS') AS stop_losses
  FROM dd_{name} GROUP BY {keys}
)"""


_FAMILY_SQL = {
    "crowd": "f.buys_2s >= p.buys_2s AND f.buyer_seconds_5s >= p.buyers_5s AND f.buy_sol_5s >= p.buy_sol_5s AND f.buy_sol_5s >= p.pressure * greatest(f.sell_sol_5s, 0.03) AND f.buys_5s > f.prior_buys_5_to_15s * 0.5",
    "quiet": "f.buys_2s >= p.buys_2s AND f.prior_buys_5_to_15s <= p.prior_buys_max AND f.buy_sol_2s >= p.buy_sol_2s AND f.buy_sol_2s >= 2 * greatest(f.sell_sol_2s, 0.02)",
    "reclaim": "f.drawdown_from_60s_peak <= p.drawdown AND f.drawdown_from_60s_peak >= -0.65 AND f.bounce_from_15s_low >= p.bounce AND f.buys_2s >= p.buys_2s AND f.buy_sol_2s >= p.pressure * greatest(f.sell_sol_2s, 0.02)",
    "absorb": "f.one_bar_return >= -0.08 AND f.drawdown_from_60s_peak >= -0.40 AND f.sell_sol_5s >= p.sell_sol_5s AND f.buys_2s >= p.buys_2s AND f.buy_sol_2s >= 0.15",
    "breadth": "f.buyers >= p.current_buyers AND f.return_5s >= p.return_5s AND f.buy_sol_2s >= p.buy_sol_2s AND f.buy_sol_2s >= 1.5 * greatest(f.sell_sol_2s, 0.02)",
    "manual": "f.age_seconds <= p.age_max AND f.curve_close >= p.curve_min AND f.buys_2s >= p.buys_2s AND f.buy_sol_5s >= p.buy_sol_5s AND f.buy_sol_5s >= p.pressure * greatest(f.sell_sol_5s, 0.10) AND f.return_5s BETWEEN 0.02 AND 0.60 AND f.drawdown_from_60s_peak >= -0.20",
}


def rule_hit_ctes(families: dict, lim, only: tuple[str, ...] | None = None) -> str:
    """hits(config, mint, bucket_s): every bar that satisfies each configuration."""
    from itertools import product
    parts = []
    for short, grid in families.items():
        if only and short not in only:
            continue
        rows = ", ".join(f"('{short}-{i:03d}', " + ", ".join(f"{float(v)}::DOUBLE" for v in vals) + ")"
                         for i, vals in enumerate(product(*grid.values())))
        parts.append(f"SELECT p.config, f.mint, f.bucket_s FROM derived f JOIN (VALUES {rows}) p(config, {', '.join(grid)}) ON "
                     f"f.age_seconds BETWEEN {lim.age_low} AND {lim.age_high} AND f.curve_close BETWEEN {lim.curve_low} AND {lim.curve_high} "
                     f"AND f.mc_close > 0 AND f.return_5s <= {lim.max_return_5s} AND {_FAMILY_SQL[short]}")
    return ", hits AS (" + " UNION ALL ".join(parts) + ")"


def ceil_fee(amount: str, bps: str) -> str:
    return f"((CAST({amount} AS HUGEINT) * {bps} + 9999) // 10000)"


def pool_after_sql() -> str:
    """Columns base, quote, vq, supply of the state after each swap."""
    return """CASE WHEN side = 'buy' THEN baseReserveRaw - baseAmountRaw ELSE baseReserveRaw + baseAmountRaw END AS base,
    CASE WHEN side = 'buy' THEN quoteReserveRaw + coalesce(quoteReserveDeltaRaw, quoteAmountRaw)
         ELSE quoteReserveRaw - coalesce(quoteReserveDeltaRaw, quoteAmountRaw) END AS quote,
    virtualQuoteReservesRaw AS vq, coalesce(baseSupplyRaw, 1000000000000000) AS supply"""


# Macro-like expressions over columns base, quote, vq, supply with fee rates 20, 5, 0, 95.
def spot_mcap_sql(base="base", quote="quote", vq="vq", supply="supply") -> str:
    return f"(CASE WHEN {base} > 0 THEN CAST((CAST({quote} + {vq} AS HUGEINT) * {supply}) // {base} AS DOUBLE) / 1e9 END)"


def buy_internal_sql(spend: int) -> str:
    """Largest internal amount whose total with rounded-up fees stays within spend, by search over a wide range."""
    cost = "q + " + " + ".join(f"(q * {b} + 9999) // 10000" for b in (20, 5, 0, 95))
    lo = spend * 10_000 // 10_120 - 50
    return f"(SELECT max(q) FROM range({lo}, {lo + 101}) t(q) WHERE {cost} <= {spend})"


def buy_tokens_sql(internal: str, base="base", quote="quote", vq="vq") -> str:
    return f"(CAST({base} AS HUGEINT) * ({internal} - 1)) // (CAST({quote} AS HUGEINT) + {vq} + {internal} - 1)"


def sell_raw_sql(tokens: str, base="base", quote="quote", vq="vq") -> str:
    return f"((CAST({quote} AS HUGEINT) + {vq}) * {tokens}) // (CAST({base} AS HUGEINT) + {tokens})"


def sell_net_sql(tokens: str, base="base", quote="quote", vq="vq") -> str:
    raw = sell_raw_sql(tokens, base, quote, vq)
    return f"({raw} - " + " - ".join(ceil_fee(f"({raw})", str(b)) for b in (20, 5, 0, 95)) + ")"
