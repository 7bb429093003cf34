"""Streaming queries: the given events table read as a stream, run to completion, compared with batch SQL over the same rows.

Streams price events without running reserves: reserves are a function of the event's own amount.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapelab.functions import curve_amm as K
from tapelab.functions.exprs import floor_div
from tapelab.functions.gates import BaseGate
from tapelab.operators import models as M, replay as R
from tapelab.operators.pools import event_features
from tapelab.plans import models as MQ, pools as PQ
from tapelab.plans.oracle_sql import r
from tapelab.plans.registry import query, r6
from tapelab.session import cut_lineage, ensure_checkpoint_dir
from tapelab.sources import adapters as A
from tapelab.sources.tables import append_ledger, read_ledger
from tapelab.streaming import jobs as J


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return J.file_stream(spark, d, schema, "parquet", "events.parquet")


def curve_rows(ev: DataFrame) -> DataFrame:
    """Curve events whose reserves depend on the event alone; works on streams and tables."""
    k = F.get_json_object("props", "$.k").cast("long")
    t_us = A.ntz_micros(F.col("ts"))
    cents = F.round(F.col("value") * 100).cast("long")
    v_sol = F.lit(A.START_LAMPORTS).cast("long") + cents * 500_000
    rows = ev.select(
        F.concat(F.lit("m"), k % 20, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("mint"), F.timestamp_micros(t_us).alias("event_time"),
        floor_div(t_us, 1000).alias("receivedAtMs"), F.col("event_id").alias("receivedSequence"), F.concat(F.lit("w"), F.col("user_id")).alias("user"),
        F.col("event_type").isin("purchase", "click", "signup").alias("isBuy"), (cents * A.LAMPORTS_PER_CENT).alias("solAmountRaw"),
        v_sol.alias("virtualSolReservesRaw"), A.curve_tokens(v_sol).alias("virtualTokenReservesRaw"),
        (A.curve_tokens(v_sol) - A.CURVE_LOCKED_TOKENS).alias("realTokenReservesRaw"), F.lit(95).alias("feeBasisPoints"),
        F.lit(5).alias("creatorFeeBasisPoints"), F.lit(False).alias("mayhemMode"))
    c = K.curve_after()
    return rows.withColumns({"market_cap_sol": K.curve_mcap(c), "curve_close": K.curve_pct(c)})


_SEV = """sev AS (
  SELECT 'm' || (CAST(json_extract(props, '$.k') AS BIGINT) % 20) || '-' || strftime(ts, '%Y%m%d') AS mint, epoch_us(ts) AS t_us, epoch_us(ts) // 1000 AS receivedAtMs,
    event_id AS receivedSequence, event_type IN ('purchase', 'click', 'signup') AS isBuy, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events
), scv AS (SELECT *, cents * 100000 AS solAmountRaw, 30000000000 + cents * 500000 AS vSol,
    CAST('32190000000000000000000000'::HUGEINT // (30000000000 + cents * 500000) AS BIGINT) AS vTok FROM sev
), sc AS (SELECT *, CAST((vSol::HUGEINT * 1000000000000000) // vTok AS DOUBLE) / 1e9 AS mcap, vSol / 85e9 * 100 AS curve FROM scv)"""


# Keys seen by the stream, first row forever.
@query("stream_first_seen", f"WITH {_SEV} SELECT mint, min(receivedAtMs) AS receivedAtMs, arg_min(receivedSequence, struct_pack(a := receivedAtMs, b := receivedSequence)) AS receivedSequence FROM sev GROUP BY mint")
def stream_first_seen(spark, d):
    rows = curve_rows(events_stream(spark, d)).select("mint", "receivedAtMs", "receivedSequence")
    w = work_dir(spark)
    J.run_batches(rows, J.first_seen_sink(f"{w}/out", "mint", ["receivedAtMs", "receivedSequence"], rows.schema, f"{w}/ckpt"), f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out").select("mint", "receivedAtMs", "receivedSequence")


@query("stream_opening_join", """WITH x AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id, event_type, epoch_us(ts) AS t FROM events)
SELECT m.event_id AS migration_id, s.event_id AS swap_id, 'p' || m.k AS pool FROM x m JOIN x s ON s.k = m.k AND s.t BETWEEN m.t - 120000000 AND m.t + 7200000000
WHERE m.event_type = 'signup' AND s.event_type IN ('purchase', 'click')""")
def stream_opening_join(spark, d):
    def side(kinds):
        ev = events_stream(spark, d).where(F.col("event_type").isin(*kinds))
        return ev.select(F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("pool"), "event_id", F.timestamp_micros(A.ntz_micros(F.col("ts"))).alias("at"))
    m = side(["signup"]).withColumnsRenamed({"event_id": "migration_id", "at": "migrated_at"})
    s = side(["purchase", "click"]).withColumnsRenamed({"pool": "swap_pool", "event_id": "swap_id", "at": "swapped_at"})
    w = work_dir(spark)
    J.run_to_files(J.opening_joins(m, s, "2 HOURS", "2 MINUTES", "1 hour").select("pool", "migration_id", "swap_id"), f"{w}/out", f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out")


OPENING_FILES = 3
OPENING_DELAY_S = 3_600
# A window is decided once the watermark has passed its end: the slower side's last time, which is the migrations', less the delay.
_DECIDED = f"o.blockTime + {PQ.WINDOW_S} < (SELECT max(blockTime) FROM migrations) - {OPENING_DELAY_S}"


@query("stream_opening_selector", f"""WITH {PQ._SELECT} SELECT p.pool, p.opening_swaps, p.independent_buyers, {', '.join(r('p.' + c, c) for c in PQ._OPEN_D)},
  array_to_string(p.reasons, ';') AS reasons, CASE WHEN len(p.reasons) = 0 THEN 'QUALIFY' ELSE 'SKIP' END AS decision
FROM picked p JOIN migrations o ON o.pool = p.pool WHERE {_DECIDED}""")
def stream_opening_selector(spark, d):
    """Migrations and swaps arrive in slices of time, and the query is started again for each: windows that span slices are decided once."""
    w = work_dir(spark)
    sw = cut_lineage(A.pool_swaps(spark, d))
    mig = cut_lineage(A.migrations(sw).select("pool", "blockTime"))
    low, high = sw.agg(F.min("timestamp"), F.max("timestamp")).head()
    for i in range(OPENING_FILES if low is not None else 1):
        part = lambda c: F.lit(True) if low is None else F.least(floor_div((F.col(c) - low) * OPENING_FILES, max(high - low, 1)), F.lit(OPENING_FILES - 1)) == i
        sw.where(part("timestamp")).write.mode("append").parquet(f"{w}/swaps")
        mig.where(part("blockTime")).write.mode("append").parquet(f"{w}/migrations")
        m, s = (J.file_stream(spark, f"{w}/{name}", df.schema, "parquet") for name, df in (("migrations", mig), ("swaps", sw)))
        J.run_to_files(J.stream_openings(m, s, PQ.WINDOW_S, f"{OPENING_DELAY_S} SECONDS", PQ.SELECTOR), f"{w}/out", f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out").select("pool", "opening_swaps", "independent_buyers", *[r6(c).alias(c) for c in PQ._OPEN_D],
                                                 F.array_join("reasons", ";").alias("reasons"), "decision")


@query("stream_bars", f"""WITH {_SEV} SELECT mint, t_us // 3600000000 * 3600 AS bucket_s, count(*) FILTER (WHERE isBuy) AS buys, count(*) FILTER (WHERE NOT isBuy) AS sells,
  {r('sum(solAmountRaw / 1e9) FILTER (WHERE isBuy)', 'buy_sol')}, {r('sum(solAmountRaw / 1e9) FILTER (WHERE NOT isBuy)', 'sell_sol')},
  {r('arg_min(mcap, struct_pack(a := t_us, b := receivedSequence))', 'mc_open')}, {r('arg_max(mcap, struct_pack(a := t_us, b := receivedSequence))', 'mc_close')},
  {r('max(mcap)', 'mc_high')}, {r('min(mcap)', 'mc_low')} FROM sc
WHERE t_us // 3600000000 * 3600000000 + 3600000000 <= ((SELECT max(t_us) FROM sc) - 7200000000) // 1000 * 1000 GROUP BY ALL""")
def stream_bars(spark, d):
    rows = curve_rows(events_stream(spark, d)).select("mint", "event_time", F.col("receivedSequence").alias("id"), F.col("isBuy").alias("is_buy"),
                                                      (F.col("solAmountRaw") / 1e9).alias("sol_amount"), "market_cap_sol")
    w = work_dir(spark)
    J.run_to_files(J.stream_bars(rows, "1 hour", "2 hours"), f"{w}/out", f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out").select("mint", F.unix_seconds("bucket").alias("bucket_s"), "buys", "sells", *[r6(c).alias(c) for c in (
        "buy_sol", "sell_sol", "mc_open", "mc_close", "mc_high", "mc_low")])


GATE = BaseGate(age_low=3_600, age_high=72_000, curve_low=35, curve_high=82, min_buys_2s=1, min_buy_sol_5s=0.05)
_GATE_SQL = "age_seconds BETWEEN 3600 AND 72000 AND curve BETWEEN 35 AND 82 AND buys_2s >= 1 AND buy_sol_5s >= 0.05 AND return_5s BETWEEN -0.20 AND 0.80"
_FIRED = _SEV + f""", sf AS (
  SELECT e.mint, e.receivedSequence, any_value(e.receivedAtMs) AS receivedAtMs, any_value(e.receivedAtMs - f.first_ms) / 1000.0 AS age_seconds, any_value(e.curve) AS curve,
    count(*) FILTER (WHERE w.isBuy AND e.receivedAtMs - w.receivedAtMs < 7200000) AS buys_2s, coalesce(sum(w.solAmountRaw) FILTER (WHERE w.isBuy), 0) / 1e9 AS buy_sol_5s,
    any_value(e.mcap) / arg_min(w.mcap, struct_pack(a := w.receivedAtMs, b := w.receivedSequence)) - 1 AS return_5s
  FROM sc e JOIN (SELECT mint, min(receivedAtMs) AS first_ms FROM sc GROUP BY mint) f ON f.mint = e.mint
  JOIN sc w ON w.mint = e.mint AND e.receivedAtMs - w.receivedAtMs < 18000000 AND (w.receivedAtMs, w.receivedSequence) <= (e.receivedAtMs, e.receivedSequence)
  GROUP BY e.mint, e.receivedSequence
), fired AS (SELECT * FROM sf WHERE {_GATE_SQL} QUALIFY row_number() OVER (PARTITION BY mint ORDER BY receivedAtMs, receivedSequence) = 1)"""


def fired_rows(spark, d):
    w = work_dir(spark)
    J.run_to_files(J.gate_once(curve_rows(events_stream(spark, d)), GATE, A.HOUR_MS, "1 hour"), f"{w}/out", f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out")


@query("stream_gate_once", f"""WITH {_FIRED} SELECT mint, receivedAtMs, receivedSequence, buys_2s, {r('age_seconds', 'age_seconds')}, {r('curve', 'curve_close')},
  {r('buy_sol_5s', 'buy_sol_5s')}, {r('return_5s', 'return_5s')} FROM fired""")
def stream_gate_once(spark, d):
    return fired_rows(spark, d).select("mint", "receivedAtMs", "receivedSequence", "buys_2s", *[r6(c).alias(c) for c in ("age_seconds", "curve_close", "buy_sol_5s", "return_5s")])


# The second side is looked up event by event in ordered lists of a mint's receipts.
@query("feature_parity", f"""WITH {_FIRED}, receipts AS (
  SELECT mint, list(struct_pack(t := receivedAtMs, q := receivedSequence, b := isBuy, l := solAmountRaw, c := mcap) ORDER BY receivedAtMs, receivedSequence) AS l FROM sc GROUP BY mint
), upto AS (
  SELECT f.*, l[1].t AS first_ms, [x FOR x IN l IF x.t > f.receivedAtMs - 18000000 AND (x.t < f.receivedAtMs OR (x.t = f.receivedAtMs AND x.q <= f.receivedSequence))] AS near
  FROM fired f JOIN receipts USING (mint)
), again AS (
  SELECT mint, receivedSequence, (receivedAtMs - first_ms) / 1000.0 AS age_seconds, len([x FOR x IN near IF x.b AND x.t > receivedAtMs - 7200000]) AS buys_2s,
    coalesce(list_sum([x.l FOR x IN near IF x.b]), 0) / 1e9 AS buy_sol_5s, near[-1].c / near[1].c - 1 AS return_5s FROM upto
), both_sides AS (
  UNPIVOT (SELECT mint, receivedSequence, age_seconds::DOUBLE AS age_seconds, buys_2s::DOUBLE AS buys_2s, buy_sol_5s::DOUBLE AS buy_sol_5s, return_5s::DOUBLE AS return_5s FROM fired)
  ON age_seconds, buys_2s, buy_sol_5s, return_5s INTO NAME feature VALUE a
), other AS (
  UNPIVOT (SELECT mint, receivedSequence, age_seconds::DOUBLE AS age_seconds, buys_2s::DOUBLE AS buys_2s, buy_sol_5s::DOUBLE AS buy_sol_5s, return_5s::DOUBLE AS return_5s FROM again)
  ON age_seconds, buys_2s, buy_sol_5s, return_5s INTO NAME feature VALUE b
)
SELECT feature, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS compared, {r('max(abs(a - b))', 'max_abs_diff')}, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS one_sided
FROM both_sides FULL JOIN other USING (mint, receivedSequence, feature) GROUP BY feature""")
def feature_parity(spark, d):
    """Features as the stream saw them against the batch operator on the same events."""
    batch = event_features(cut_lineage(curve_rows(A.table(spark, d, "events"))), A.HOUR_MS)
    hit = batch.where(GATE.live()).groupBy("mint").agg(F.min(F.struct("receivedAtMs", "receivedSequence", "age_seconds", "buys_2s", "buy_sol_5s", "return_5s")).alias("h"))
    out = M.feature_parity(hit.select("mint", "h.*"), fired_rows(spark, d), ["mint", "receivedSequence"], ["age_seconds", "buys_2s", "buy_sol_5s", "return_5s"])
    return out.withColumn("max_abs_diff", r6("max_abs_diff"))


@query("stream_scores")
def stream_scores(spark, d):
    """Stream scoring with a model trained on the batch candidates; ownership rows are missing for some mints."""
    frame = cut_lineage(MQ.candidate_trades(spark, d))
    model = M.fit_entry_model(frame.where(F.col("split") == "train"), M.OWNERSHIP)
    w = work_dir(spark)
    fired = J.gate_once(curve_rows(events_stream(spark, d)), GATE, A.HOUR_MS, "1 hour")
    scored = J.score_stream(fired, frame, model, 0.0)
    J.run_batches(scored.select("mint", "receivedAtMs", "decision", "score", "passed"), J.counted_sink(f"{w}/out", f"{w}/health", J.health_counters()), f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out").select("mint", "receivedAtMs", "decision", "score")


HEALTH_FILES = 4


@query("stream_health", f"""WITH {_SEV} SELECT {HEALTH_FILES}::BIGINT AS batches, count(*) AS received, count(*) FILTER (WHERE isBuy) AS passes FROM sev""")
def stream_health(spark, d):
    """Counters per batch of a stream over several files, one file a batch, summed over the stored table of counters."""
    w = work_dir(spark)
    A.table(spark, d, "events").repartition(HEALTH_FILES).write.parquet(f"{w}/in")
    files = J.file_stream(spark, f"{w}/in", spark.read.parquet(f"{w}/in").schema, "parquet", max_files=1)
    rows = curve_rows(files).select("mint", "receivedAtMs", F.col("isBuy").alias("passed"))
    J.run_batches(rows, J.counted_sink(f"{w}/out", f"{w}/health", J.health_counters()), f"{w}/ckpt")
    kept = J.read_counters(spark, f"{w}/health", list(J.health_counters()))
    return kept.agg(F.count(F.lit(1)).alias("batches"), F.sum("received").alias("received"), F.sum("passes").alias("passes"))


ACCOUNTS = [{"account": "base-670ms", "delay_ms": 670 * 3_600}, {"account": "shadow-1170ms", "delay_ms": 1_170 * 3_600}]
PLAN = R.ExitPlan(0.20, -0.25, 4 * A.HOUR_MS)
# Every mint's first event is a pass, ready at that event.
_B = "((499999999 * 10000::BIGINT) // 10100)"
_RAW = f"CAST((CAST(f.tokens AS HUGEINT) * (s.vSol + {_B})) // s.vTok AS BIGINT)"
_PNL = f"(({_RAW} - ({_RAW} * 95 + 9999) // 10000 - ({_RAW} * 5 + 9999) // 10000) / 1e9 - 0.5 - 0.0064)"


@query("stream_delayed_fills", f"""WITH {_SEV}, want AS (SELECT mint, min(receivedAtMs) AS ready_ms, v.account, v.delay_ms FROM sc,
  (VALUES ('base-670ms', {670 * 3_600}), ('shadow-1170ms', {1_170 * 3_600})) v(account, delay_ms) GROUP BY ALL),
land AS (SELECT w.*, s.receivedAtMs AS entry_ms, s.receivedSequence AS entry_seq, CAST(least((CAST({_B} AS HUGEINT) * vTok) // (vSol + {_B}), vTok - 279900000000000) AS BIGINT) AS tokens
  FROM want w JOIN sc s ON s.mint = w.mint AND s.receivedAtMs >= w.ready_ms + w.delay_ms AND s.vTok > 279900000000000
  QUALIFY row_number() OVER (PARTITION BY w.mint, w.account ORDER BY s.receivedAtMs, s.receivedSequence) = 1),
walk AS (SELECT f.mint, f.account, s.receivedAtMs AS ms, s.receivedSequence AS seq, {_PNL} AS pnl FROM land f JOIN sc s ON s.mint = f.mint
  AND s.receivedAtMs <= f.entry_ms + {PLAN.timeout_ms} AND (s.receivedAtMs, s.receivedSequence) >= (f.entry_ms, f.entry_seq)),
trig AS (SELECT w.mint, w.account, min(struct_pack(ms := ms, seq := seq, pnl := pnl)) AS x FROM walk w JOIN land f USING (mint, account)
  WHERE w.seq <> f.entry_seq AND (pnl / 0.5032 >= {PLAN.take_profit} OR pnl / 0.5032 <= {PLAN.stop_loss}) GROUP BY ALL),
lastw AS (SELECT mint, account, max(struct_pack(ms := ms, seq := seq, pnl := pnl)) AS y FROM walk GROUP BY ALL),
done AS (SELECT f.mint, f.account, f.entry_ms, f.entry_seq, coalesce(x.ms, y.ms) AS exit_ms, x.ms IS NULL AS timed, coalesce(x.pnl, y.pnl) AS pnl,
  (SELECT max(receivedAtMs) FROM sc) - 3600000 AS wm, (SELECT count(*) FROM sc s WHERE s.mint = f.mint AND s.receivedAtMs > f.entry_ms + {PLAN.timeout_ms}) AS later,
  CASE WHEN x.pnl / 0.5032 >= {PLAN.take_profit} THEN 'TAKE_PROFIT' WHEN x.pnl / 0.5032 <= {PLAN.stop_loss} THEN 'STOP_LOSS' ELSE 'TIMEOUT' END AS exit_reason
  FROM land f LEFT JOIN trig USING (mint, account) JOIN lastw USING (mint, account))
SELECT account, mint, entry_ms, entry_seq, exit_ms, exit_reason, {r('pnl', 'pnl_sol')} FROM done WHERE NOT timed OR later > 0 OR entry_ms + {PLAN.timeout_ms} + 1 < wm""")
def stream_delayed_fills(spark, d):
    """Timeouts with no later event close once the watermark has passed them."""
    ev = curve_rows(events_stream(spark, d))
    acct = F.explode(F.array(*[F.struct(F.lit(a["account"]).alias("account"), F.lit(a["delay_ms"]).cast("long").alias("delay_ms")) for a in ACCOUNTS])).alias("a")
    cols = [F.col("virtualSolReservesRaw").alias("v_sol"), F.col("virtualTokenReservesRaw").alias("v_tok"), F.col("realTokenReservesRaw").alias("real_tok"),
            F.col("feeBasisPoints").cast("long").alias("fee_bps"), F.col("creatorFeeBasisPoints").cast("long").alias("creator_bps")]
    both = F.explode(F.array(F.lit("pass"), F.lit("event"))).alias("kind")
    rows = (ev.select("mint", "event_time", "receivedAtMs", "receivedSequence", *cols, acct).select("*", both)
            .select("a.account", "mint", "event_time", "kind", "receivedAtMs", "receivedSequence", (F.col("receivedAtMs") + F.col("a.delay_ms")).alias("target_ms"),
                    "v_sol", "v_tok", "real_tok", "fee_bps", "creator_bps"))
    w = work_dir(spark)
    J.run_to_files(J.delayed_fills(rows, 0.5, 0.0032, PLAN.take_profit, PLAN.stop_loss, PLAN.timeout_ms, "1 hour"), f"{w}/out", f"{w}/ckpt")
    return spark.read.parquet(f"{w}/out").withColumn("pnl_sol", r6("pnl_sol"))


@query("jsonl_ledger", f"""WITH {_SEV} SELECT mint, receivedAtMs, receivedSequence, isBuy, solAmountRaw FROM sev JOIN scv USING (mint, receivedAtMs, receivedSequence, isBuy)""")
def jsonl_ledger(spark, d):
    """Journal events as JSON lines, then read the ledger back with its explicit schema."""
    rows = curve_rows(A.table(spark, d, "events")).select("mint", "receivedAtMs", "receivedSequence", "isBuy", "solAmountRaw")
    path = f"{work_dir(spark)}/ledger"
    append_ledger(rows, path)
    return read_ledger(spark, path, rows.schema, "drop")
