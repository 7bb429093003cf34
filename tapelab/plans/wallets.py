"""Wallet, ownership and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.operators import asof as AO, ownership as W, signals as Sg, wallets as J
from tapelab.plans import oracle_sql as S
from tapelab.plans import oracle_sql, registry
from tapelab.plans.registry import query
from tapelab.plans.screen import _GATE, _GATE_SQL
from tapelab.plans.tape import clean, derived_table, feature_table, staged_tape, token_table
from tapelab.session import cut_lineage
from tapelab.sources import adapters as A

# Averages and medians of money and time end in a 5 at the seventh digit too often to round at six.
r = lambda expr, alias: oracle_sql.r(expr, alias, 9)
r6 = lambda c: registry.r6(c, 9)



def wallet_tape(spark, d, tape=None):
    """The tape with the day dropped from mints, so that wallets come back to them."""
    return (clean(spark, d) if tape is None else tape).withColumn("mint", F.substring_index("mint", "-", 1))


def _until(tape):
    return tape.agg(F.min("event_time")).scalar() + F.make_dt_interval(days=F.lit(20))


def closed(spark, d, tape=None):
    tape = wallet_tape(spark, d, staged_tape(spark, d) if tape is None else tape)
    return J.closed_positions(J.positions(tape, _until(tape)), 0.2, 5.0)


def _side(name: str, is_buy: str, columns: str) -> str:
    """One side of every wallet's dealings in a token, within the first 20 days."""
    return f"""{name} AS (SELECT user_wallet AS wallet, split_part(mint, '-', 1) AS mint, {columns} FROM tape
  WHERE {is_buy} AND event_us - (SELECT min(event_us) FROM tape) < 20 * 86400000000 GROUP BY 1, 2)"""


# Positions: buys and sells are summed apart and meet in a join. Wallets are rolled up over lists of their closed positions.
_POS = ", ".join([
    S.FEATURES,
    _side("bought", "is_buy", "min(event_us) AS first_buy_us, count(*) AS buys, sum(sol_amount) AS buy_sol, sum(token_amount) AS bought_tokens, "
          "stddev_samp(sol_amount) AS buy_size_std, sum(sol_amount) / count(*) AS average_buy_sol"),
    _side("sold", "NOT is_buy", "max(event_us) AS last_sell_us, count(*) AS sells, sum(sol_amount) AS sell_sol, sum(token_amount) AS sold_tokens"),
    """positions AS (SELECT * REPLACE (coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells) FROM bought FULL JOIN sold USING (wallet, mint))""",
    """closed AS (
  SELECT wallet, mint, sell_sol - buy_sol - 0.0032 * (buys + sells) AS pnl_sol, (last_sell_us - first_buy_us) / 1e6 AS hold_seconds,
    average_buy_sol AS mean, CASE WHEN average_buy_sol <> 0 AND buys > 1 THEN buy_size_std / average_buy_sol ELSE 0 END AS cv
  FROM bought JOIN sold USING (wallet, mint)
  WHERE first_buy_us < last_sell_us AND sold_tokens >= 0.2 * bought_tokens AND sold_tokens <= 5.0 * bought_tokens AND bought_tokens <> 0)""",
    """listed AS (SELECT wallet, list(closed ORDER BY mint) AS c FROM closed GROUP BY wallet)""",
    """rollup_ AS (
  SELECT wallet, len(c) AS closed_positions, list_sum([x.pnl_sol FOR x IN c]) AS pnl_sol, len([x FOR x IN c IF x.pnl_sol > 0]) / len(c) AS win_rate,
    list_median([x.hold_seconds FOR x IN c]) AS median_hold_seconds, list_median([x.mean FOR x IN c]) AS median_buy_sol,
    list_avg([x.cv FOR x IN c]) AS mean_buy_size_cv, list_max([x.pnl_sol FOR x IN c]) AS largest_position_pnl,
    coalesce(list_sum([x.pnl_sol FOR x IN c IF x.pnl_sol > 0]), 0) AS gross_profit, coalesce(list_sum([x.pnl_sol FOR x IN c IF x.pnl_sol < 0]), 0) AS gross_loss,
    CAST(list_unique([x.mint FOR x IN c]) AS BIGINT) AS distinct_mints FROM listed)""",
    """selected AS (
  SELECT *, CASE WHEN gross_profit <> 0 THEN largest_position_pnl / gross_profit END AS largest_profit_share,
    CASE WHEN gross_loss <> 0 THEN -gross_profit / gross_loss END AS profit_factor
  FROM rollup_ SEMI JOIN (SELECT wallet FROM rollup_ WHERE closed_positions >= 3 AND closed_positions <= 250 AND median_hold_seconds >= 3600
      AND median_hold_seconds <= 1000000 AND mean_buy_size_cv >= 0.10 AND pnl_sol > 0 AND largest_position_pnl <= 0.80 * gross_profit) USING (wallet)
  QUALIFY row_number() OVER (ORDER BY pnl_sol DESC, wallet) <= 250)""",
    """first_buys AS (
  SELECT DISTINCT ON (user_wallet, mint) user_wallet AS wallet, mint, event_us AS first_buy_us, sol_amount AS first_buy_sol
  FROM tape SEMI JOIN selected ON wallet = user_wallet WHERE is_buy ORDER BY user_wallet, mint, event_us, id)"""])
_P_D = ["buy_sol", "sell_sol", "bought_tokens", "sold_tokens", "buy_size_std", "average_buy_sol"]


@query("wallet_positions", f"WITH {_POS} SELECT wallet, mint, first_buy_us, last_sell_us, buys, sells, {', '.join(r(c, c) for c in _P_D)} FROM positions")
def wallet_positions(spark, d):
    tape = wallet_tape(spark, d)
    return J.positions(tape, _until(tape)).select(
        "wallet", "mint", F.unix_micros("first_buy_at").alias("first_buy_us"), F.unix_micros("last_sell_at").alias("last_sell_us"),
        "buys", "sells", *[r6(c).alias(c) for c in _P_D])


@query("closed_positions", f"WITH {_POS} SELECT wallet, mint, {r('pnl_sol', 'pnl_sol')}, {r('hold_seconds', 'hold_seconds')} FROM closed")
def closed_positions(spark, d):
    return closed(spark, d).select("wallet", "mint", r6("pnl_sol").alias("pnl_sol"), r6("hold_seconds").alias("hold_seconds"))


_R_D = ["pnl_sol", "win_rate", "median_hold_seconds", "median_buy_sol", "mean_buy_size_cv", "largest_position_pnl", "gross_profit", "gross_loss"]


@query("wallet_rollup", f"WITH {_POS} SELECT wallet, closed_positions, distinct_mints, {', '.join(r(c, c) for c in _R_D)} FROM rollup_")
def wallet_rollup(spark, d):
    return J.wallet_rollup(cut_lineage(closed(spark, d))).select("wallet", "closed_positions", "distinct_mints", *[r6(c).alias(c) for c in _R_D])


def selected(spark, d, tape=None):
    return J.select_wallets(cut_lineage(closed(spark, d, tape)), 3, 250, (3_600, 1_000_000), 0.10, 0.80, 250)


_SEL_D = _R_D + ["largest_profit_share", "profit_factor"]


@query("selected_wallets", f"WITH {_POS} SELECT wallet, closed_positions, {', '.join(r(c, c) for c in _SEL_D)} FROM selected")
def selected_wallets(spark, d):
    return selected(spark, d).select("wallet", "closed_positions", *[r6(c).alias(c) for c in _SEL_D])


@query("first_buys", f"WITH {_POS} SELECT wallet, mint, first_buy_us, {r('first_buy_sol', 'first_buy_sol')} FROM first_buys")
def first_buys(spark, d):
    tape = staged_tape(spark, d)
    return J.first_buys(tape, selected(spark, d, tape)).select(
        "wallet", "mint", F.unix_micros("first_buy_at").alias("first_buy_us"), r6("first_buy_sol").alias("first_buy_sol"))


_ASOF = _POS + """, matched AS (
  SELECT f.wallet, f.mint, f.first_buy_us, b.bucket_s, b.age_seconds, b.curve_close, b.buys_2s, b.buyer_seconds_5s, b.buy_sol_5s, b.return_5s,
    b.drawdown_from_60s_peak
  FROM first_buys f ASOF JOIN derived b ON f.mint = b.mint AND f.first_buy_us >= b.bucket_s * 1000000
  WHERE f.first_buy_us - b.bucket_s * 1000000 <= 7200000000
)"""
_MATCH_COLS = ["age_seconds", "curve_close", "buys_2s", "buyer_seconds_5s", "buy_sol_5s", "return_5s", "drawdown_from_60s_peak"]


def matched(spark, d):
    tape = staged_tape(spark, d)
    buys = J.first_buys(tape, selected(spark, d, tape))
    return J.bars_at_first_buy(buys, derived_table(spark, d, tape), 2 * A.HOUR_US, _MATCH_COLS, width_us=A.HOUR_US)


@query("asof_first_buy_bars", f"WITH {_ASOF} SELECT wallet, mint, first_buy_us, bucket_s, buys_2s, {r('age_seconds', 'age_seconds')}, {r('curve_close', 'curve_close')} FROM matched")
def asof_first_buy_bars(spark, d):
    return matched(spark, d).select("wallet", "mint", F.unix_micros("first_buy_at").alias("first_buy_us"),
                                    (F.col("bucket_us") / 1_000_000).cast("long").alias("bucket_s"), "buys_2s",
                                    r6("age_seconds").alias("age_seconds"), r6("curve_close").alias("curve_close"))


_MED = ["age_seconds", "curve_close", "buys_2s", "buyer_seconds_5s", "buy_sol_5s", "return_5s", "drawdown_from_60s_peak"]
_QS = (0.1, 0.25, 0.5, 0.75, 0.9)
_QCOLS = ["age_seconds", "curve_close", "buys_2s", "buy_sol_5s"]


@query("behavior_profile", f"""WITH {_ASOF} SELECT count(*) AS first_buys, {', '.join(r(f'median({c})', f'median_{c}') for c in _MED)},
  {', '.join(r(f'quantile_cont({c}, {q})', f'{c}_q{i}') for c in _QCOLS for i, q in enumerate(_QS))} FROM matched""")
def behavior_profile(spark, d):
    out = J.behavior_profile(cut_lineage(matched(spark, d)), _MED, {c: _QS for c in _QCOLS})
    return out.select("first_buys", *[r6(f"median_{c}").alias(f"median_{c}") for c in _MED],
                      *[r6(F.col(f"{c}_quantiles")[i]).alias(f"{c}_q{i}") for c in _QCOLS for i in range(len(_QS))])


@query("asof_next_event", f"""WITH {S.FEATURES}, sig AS (SELECT mint, bucket_s FROM trails WHERE buys_2s >= 2)
SELECT s.mint, s.bucket_s, t.id AS event_id, t.event_us FROM sig s ASOF LEFT JOIN
  (SELECT mint, max_by(event_us, id) AS event_us, min(id) AS id FROM tape GROUP BY mint, event_us) t
  ON s.mint = t.mint AND s.bucket_s * 1000000 + 3670000000 <= t.event_us""")
def asof_next_event(spark, d):
    """First tape event at or after the close of each signal bar plus a delay."""
    staged = staged_tape(spark, d)
    sig = derived_table(spark, d, staged).where(F.col("buys_2s") >= 2).select("mint", F.unix_seconds("bucket").alias("bucket_s"))
    tape = staged.select("mint", "id", F.unix_micros("event_time").alias("event_us"))
    out = AO.asof_forward(sig, tape, ["mint"], F.col("bucket_s") * 1_000_000 + 3_670_000_000, F.col("event_us"), [F.col("id")],
                          "e")
    return out.select("mint", "bucket_s", F.col("e.id").alias("event_id"), F.col("e.event_us").alias("event_us"))


# ---- swap tape -------------------------------------------------------------------------------------------------

def swaps(spark, d):
    return J.valid_swaps(A.pool_swaps(spark, d))


_RANKS = S.SWAPS + """, firsts AS (SELECT pool, usr, min(struct_pack(a := receivedAtMs, c := receivedSequence)) AS f FROM swaps WHERE side = 'buy' GROUP BY ALL),
ranks AS (SELECT pool, usr, row_number() OVER (PARTITION BY pool ORDER BY f) AS rank FROM firsts)"""


@query("buyer_ranks", f'WITH {_RANKS} SELECT pool, usr AS "user", rank FROM ranks')
def buyer_ranks(spark, d):
    return J.buyer_ranks(swaps(spark, d)).select("pool", "user", "rank")


_PROFILE = _RANKS + """, per_pool AS (
  SELECT usr, pool, count(*) AS events, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells,
    min(receivedAtMs) FILTER (WHERE side = 'buy') AS fb, max(receivedAtMs) FILTER (WHERE side = 'sell') AS ls,
    sum(CASE WHEN side = 'sell' THEN quoteAmountRaw ELSE -quoteAmountRaw END) / 1e9 AS flow FROM swaps GROUP BY ALL
), pool_first AS (SELECT pool, min(receivedAtMs) AS pf FROM swaps GROUP BY pool), pp AS (
  SELECT p.*, r.rank, p.fb - f.pf AS delay_ms, CASE WHEN ls >= fb THEN (ls - fb) / 1000.0 END AS hold_s
  FROM per_pool p LEFT JOIN ranks r ON r.pool = p.pool AND r.usr = p.usr JOIN pool_first f ON f.pool = p.pool
), ent AS (
  SELECT usr, -sum(c / n * log2(c / n)) AS bits FROM (
    SELECT usr, c, sum(c) OVER (PARTITION BY usr) AS n FROM (
      SELECT usr, floor(quoteAmountRaw / 1e9 * 100 + 0.5) AS b, count(*)::DOUBLE AS c FROM swaps WHERE side = 'buy' GROUP BY ALL)) GROUP BY usr
), msize AS (SELECT usr, median(quoteAmountRaw / 1e9) AS median_buy_sol FROM swaps WHERE side = 'buy' GROUP BY usr), prof AS (
  SELECT pp.usr, sum(events) AS events, count(*) AS distinct_pools, sum(buys) AS buys, sum(sells) AS sells, count(hold_s) AS round_trips,
    count(*) FILTER (WHERE rank <= 20) AS early_pools, sum(flow) AS flow, median(rank) AS mrank, median(delay_ms) AS mdelay, median(hold_s) AS mhold
  FROM pp GROUP BY pp.usr
), profile AS (
  SELECT p.usr AS "user", CAST(events AS BIGINT) AS events, distinct_pools, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, round_trips,
    early_pools, CASE WHEN buys > 0 THEN early_pools / distinct_pools ELSE 0.0 END AS early_pool_rate, mrank AS median_first_buy_rank,
    mdelay AS median_first_buy_delay_ms, m.median_buy_sol, coalesce(e.bits, 0) AS buy_size_entropy_bits, mhold AS median_hold_seconds,
    flow AS gross_quote_flow_sol, flow - events * 0.0032 AS estimated_net_flow_sol,
    greatest(0, least(1, 0.45 * least(1, coalesce(e.bits, 0) / 2.5) + 0.25 * least(1, coalesce(mhold, 0) / 90)
      + 0.15 * least(1, round_trips / greatest(1, distinct_pools)) + 0.15 * (CASE WHEN buys >= 3 THEN 1 ELSE 0 END))) AS manual_likelihood
  FROM prof p LEFT JOIN ent e ON e.usr = p.usr LEFT JOIN msize m ON m.usr = p.usr
)"""
_W_L = ["events", "distinct_pools", "buys", "sells", "round_trips", "early_pools"]
_W_D = ["early_pool_rate", "median_first_buy_rank", "median_first_buy_delay_ms", "median_buy_sol", "buy_size_entropy_bits",
        "median_hold_seconds", "gross_quote_flow_sol", "estimated_net_flow_sol", "manual_likelihood"]


def profile(spark, d):
    return J.wallet_tape_profile(cut_lineage(swaps(spark, d)))


@query("wallet_tape_profile", f"""WITH {_PROFILE} SELECT "user", {', '.join(_W_L)}, {', '.join(r(c, c) for c in _W_D)} FROM profile
WHERE distinct_pools >= 2 AND buys >= 2 ORDER BY early_pools DESC, distinct_pools DESC, round(manual_likelihood, 9) DESC, "user" LIMIT 250""")
def wallet_tape_profile(spark, d):
    return J.rank_wallets(profile(spark, d)).select("user", *_W_L, *[r6(c).alias(c) for c in _W_D])


@query("size_entropy", f'WITH {_PROFILE} SELECT usr AS "user", {r("bits", "buy_size_entropy_bits")} FROM ent')
def size_entropy(spark, d):
    return J.size_entropy(swaps(spark, d)).select("user", r6("buy_size_entropy_bits").alias("buy_size_entropy_bits"))


@query("swap_tape_summary", f"""WITH {_PROFILE} SELECT (SELECT count(*) FROM swaps) AS event_count, (SELECT min(receivedAtMs) FROM swaps) AS observed_start_ms,
  (SELECT max(receivedAtMs) FROM swaps) AS observed_end_ms, count(*) AS wallet_count, count(*) FILTER (WHERE distinct_pools >= 2 AND buys >= 2) AS eligible_count FROM profile""")
def swap_tape_summary(spark, d):
    sw = cut_lineage(swaps(spark, d))
    return J.swap_tape_summary(sw, sw.groupBy("user").agg(
        F.countDistinct("pool").alias("distinct_pools"), F.count(F.when(F.col("side") == "buy", 1)).alias("buys")))


# ---- ownership -------------------------------------------------------------------------------------------------

def candidates(spark, d, tape=None):
    """First bar per mint passing the base gate, with its signal time."""
    feats = cut_lineage(feature_table(spark, d, tape))
    hit = Sg.first_match(feats, {"base": _GATE.batch()})
    return hit.select("mint", "bucket").join(feats, ["mint", "bucket"]).withColumn("signal_us", F.unix_micros("bucket"))


# Concentration: holdings as lists in falling order, Gini as the mean absolute difference over all pairs of holders.
_OWN = S.FEATURES + f""", cand AS (
  SELECT DISTINCT ON (mint) features.*, creator, 1e9 * (1 + coalesce(features.is_mayhem_mode, false)::INTEGER) AS supply
  FROM features LEFT JOIN (SELECT mint, creator FROM tokens) USING (mint) WHERE {_GATE_SQL} ORDER BY mint, bucket_s
), deals AS (
  SELECT cand.mint, user_wallet, token_amount * (CASE WHEN is_buy THEN 1 ELSE -1 END) AS change FROM tape JOIN cand USING (mint) WHERE event_us <= 1000000 * bucket_s
), balances AS (SELECT mint, user_wallet, sum(change) AS balance FROM deals GROUP BY ALL
), falling AS (SELECT mint, list(balance ORDER BY balance DESC) AS held FROM balances WHERE balance > 0 GROUP BY mint
), spread AS (
  SELECT a.mint, sum(abs(a.balance - b.balance)) / 2 AS gaps FROM balances a JOIN balances b USING (mint) WHERE a.balance > 0 AND b.balance > 0 GROUP BY a.mint
), own AS (SELECT cand.mint, sum(balance) AS dev FROM balances JOIN cand ON cand.mint = balances.mint AND creator = user_wallet WHERE balance > 0 GROUP BY ALL
), ownership AS (
  SELECT mint, len(held) AS event_holder_count, {', '.join(f'100 * list_sum(held[1:{k}]) / supply AS event_top{k}_pct' for k in (1, 5, 10))},
    100 * coalesce(dev, 0) / supply AS event_dev_pct, gaps / (len(held) * list_sum(held)) AS event_gini
  FROM falling JOIN cand USING (mint) JOIN spread USING (mint) LEFT JOIN own USING (mint)
)"""
_OWN_D = ["event_top1_pct", "event_top5_pct", "event_top10_pct", "event_dev_pct", "event_gini"]


@query("balances_at_signal", f"WITH {_OWN} SELECT mint, user_wallet, CAST(balance AS BIGINT) AS balance FROM balances")
def balances_at_signal(spark, d):
    tape = staged_tape(spark, d)
    return W.balances_at(candidates(spark, d, tape), tape).select("mint", "user_wallet", F.col("balance").cast("long").alias("balance"))


@query("ownership_concentration", f"""WITH {_OWN} SELECT mint, event_holder_count, {', '.join(r(c, c) for c in _OWN_D)} FROM ownership JOIN cand USING (mint)
WHERE event_holder_count >= 2 AND event_gini IS NOT NULL""")
def ownership_concentration(spark, d):
    tape = staged_tape(spark, d)
    out = W.enrich_ownership(candidates(spark, d, tape), token_table(tape), tape)
    return out.select("mint", "event_holder_count", *[r6(c).alias(c) for c in _OWN_D])


@query("snapshot_concentration", f"""WITH {S.TAPE}, bal AS (
  SELECT mint, tok % 5 = 0 AS mayhem, user_wallet AS address, CAST(sum(CASE WHEN is_buy THEN token_amount ELSE -token_amount END) AS BIGINT) AS amount,
    CAST(substr(user_wallet, 2) AS BIGINT) % 10 = 3 AS curve, CAST(substr(user_wallet, 2) AS BIGINT) % 10 = 4 AS creator
  FROM tape GROUP BY ALL
), held AS (SELECT *, CASE WHEN mayhem THEN 2000000000000000 ELSE 1000000000000000 END AS supply FROM bal WHERE amount > 0),
hum AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY amount DESC) AS rd, row_number() OVER (PARTITION BY mint ORDER BY amount) AS ra
  FROM held WHERE NOT curve),
agg AS (SELECT mint, count(*) AS n, sum(amount)::DOUBLE AS total, sum(ra * amount)::DOUBLE AS w, sum(amount) FILTER (WHERE rd <= 1) AS t1,
  sum(amount) FILTER (WHERE rd <= 5) AS t5, sum(amount) FILTER (WHERE rd <= 10) AS t10 FROM hum GROUP BY mint)
SELECT h.mint, count(*) AS initial_holder_count, coalesce(any_value(a.n), 0) AS human_accounts, bool_or(curve) AS curve_account_excluded,
  {r("CAST(coalesce(any_value(t1), 0) * 10000000::HUGEINT // any_value(supply) AS DOUBLE) / 100000", "initial_top1_pct_corrected")},
  {r("CAST(coalesce(any_value(t5), 0) * 10000000::HUGEINT // any_value(supply) AS DOUBLE) / 100000", "initial_top5_pct_corrected")},
  {r("CAST(coalesce(any_value(t10), 0) * 10000000::HUGEINT // any_value(supply) AS DOUBLE) / 100000", "initial_top10_pct_corrected")},
  {r("CAST(coalesce(sum(amount) FILTER (WHERE creator), 0) * 10000000::HUGEINT // any_value(supply) AS DOUBLE) / 100000", "dev_buy_pct_corrected")},
  {r("CASE WHEN any_value(a.n) >= 2 THEN 2 * any_value(w) / (any_value(a.n) * any_value(total)) - (any_value(a.n) + 1.0) / any_value(a.n) END", "initial_gini")}
FROM held h LEFT JOIN agg a ON a.mint = h.mint GROUP BY h.mint""")
def snapshot_concentration(spark, d):
    out = W.snapshot_concentration(A.holder_balances(clean(spark, d)))
    pct = ["initial_top1_pct_corrected", "initial_top5_pct_corrected", "initial_top10_pct_corrected", "dev_buy_pct_corrected", "initial_gini"]
    return out.select("mint", "initial_holder_count", "human_accounts", "curve_account_excluded", *[r6(c).alias(c) for c in pct])
