"""Structured Streaming forms: typed sources, first-seen sinks, interval joins, bars, keyed features, scoring, delayed fills.

Files and Kafka differ only in the source; every job takes a streaming DataFrame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapelab.functions.exprs import floor_div
from tapelab.functions.gates import BaseGate
from tapelab.operators.models import EntryModel
from tapelab.operators.pools import ZERO_OPENING, opening_totals
from tapelab.operators.signals import select_openings
from tapelab.operators.snapshots import first_seen
from tapelab.sources.tables import path_exists


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """New files under a folder as a typed stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON values of a topic as typed rows (needs the Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def run_to_files(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into a committed parquet sink."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen_sink(target: str, key: str, order: list[str], schema: T.StructType, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that keeps one immutable first row per key, forever.

    Each batch of each query owns one folder and overwrites only that, so a batch that is run again after a failure leaves the same rows.
    The query is known by the id in its checkpoint: a new checkpoint over an old target adds to what is stored, and never replaces it.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = F.get_json_object("value", "$.id").alias("id")
        run = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(query).head()["id"]
        seen = None
        if path_exists(spark, target):
            stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())]))
            seen = stored.parquet(target).where(~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        first_seen(batch, key, order, seen).write.mode("overwrite").parquet(f"{target}/run={run}/batch_id={batch_id}")
    return handle


def dedupe(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """One row per key within the watermark; use first_seen_sink where first must mean forever."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def opening_joins(migrations: DataFrame, swaps: DataFrame, window: str, slack: str, delay: str) -> DataFrame:
    """Migration and swap pairs of a pool inside the opening window, as a stream-stream interval join.

    Time is cut into cells as long as window and slack together. A swap lies in one cell, a migration is copied to the two that its window
    touches, and rows meet by pool and cell: a row is held against those of its cell, not against all that are kept of a busy pool.
    ``migrations``: pool, migrated_at; ``swaps``: swap_pool, swapped_at. Both sides drop state behind the watermark.
    """
    m, s = migrations.withWatermark("migrated_at", delay), swaps.withWatermark("swapped_at", delay)
    low, high = F.col("migrated_at") - F.expr(f"INTERVAL {slack}"), F.col("migrated_at") + F.expr(f"INTERVAL {window}")
    start = F.timestamp_micros(F.lit(0))
    width = F.unix_micros(start + F.expr(f"INTERVAL {window}") + F.expr(f"INTERVAL {slack}"))
    cell = lambda at: floor_div(F.unix_micros(at), F.greatest(width, F.lit(1)))
    cells = m.withColumn("__cell", F.explode(F.sequence(cell(low), F.greatest(cell(low), cell(high)))))
    placed = s.withColumn("__swap_cell", cell(F.col("swapped_at")))
    cond = ((F.col("pool") == F.col("swap_pool")) & (F.col("__cell") == F.col("__swap_cell")) & (F.col("swapped_at") >= low) & (F.col("swapped_at") <= high))
    return cells.join(placed, cond, "inner").drop("__cell", "__swap_cell")


def stream_openings(migrations: DataFrame, swaps: DataFrame, seconds: int, delay: str, cfg: dict) -> DataFrame:
    """The opening selector as one streaming query: interval join, buyers per (pool, user), totals per pool, reasons and decision.

    A migration is decided once, when the watermark has passed the end of its window, so every swap inside the window that is no later
    than ``delay`` counts. The watermark is that of the slower side (Spark's default policy), so the last windows stay open until a later
    migration arrives, unless the session sets ``spark.sql.streaming.multipleWatermarkPolicy`` to max. A migration without swaps is decided too, as one without a reserve state. The join and both aggregations drop
    their state behind the watermark: what is held are the open windows, the rows of one pool being spread over its users in the totals.
    ``migrations``: pool, blockTime (s), once per pool; ``swaps``: pool, timestamp (s), user, side, amounts, reserve and receipt order.
    """
    m = migrations.select("pool", "blockTime", F.timestamp_seconds("blockTime").alias("migrated_at")).withWatermark("migrated_at", delay)
    s = (swaps.select(F.col("pool").alias("swap_pool"), F.timestamp_seconds("timestamp").alias("swapped_at"), "timestamp", "user", "side", "userQuoteAmountRaw",
                      "quoteAmountRaw", "quoteReserveRaw", "receivedAtMs", "receivedSequence").withWatermark("swapped_at", delay))
    cond = ((F.col("pool") == F.col("swap_pool")) & (F.col("swapped_at") >= F.col("migrated_at"))
            & (F.col("swapped_at") <= F.col("migrated_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS")))
    # Later operators follow one event time: the migration's.
    opened = m.join(s, cond, "left_outer").drop("swap_pool", "swapped_at")
    totals = opening_totals(opened, ["migrated_at", "pool", "blockTime"]).fillna(ZERO_OPENING)
    return select_openings(totals.withColumn("net_flow_sol", F.col("buys_sol") - F.col("sells_sol")), cfg)


def stream_bars(trades: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling bars per mint. Late trades are accepted up to the watermark delay; a bar is emitted once it is final.

    ``trades``: mint, event_time, id, is_buy, sol_amount, market_cap_sol.
    """
    at = F.struct("event_time", "id")
    buy = F.col("is_buy")
    return (trades.withWatermark("event_time", delay).groupBy("mint", F.window("event_time", width)).agg(
        F.count(F.when(buy, 1)).alias("buys"), F.count(F.when(~buy, 1)).alias("sells"),
        F.sum(F.when(buy, F.col("sol_amount"))).alias("buy_sol"), F.sum(F.when(~buy, F.col("sol_amount"))).alias("sell_sol"),
        F.min_by("market_cap_sol", at).alias("mc_open"), F.max_by("market_cap_sol", at).alias("mc_close"),
        F.max("market_cap_sol").alias("mc_high"), F.min("market_cap_sol").alias("mc_low"))
        .select("mint", F.col("window.start").alias("bucket"), "buys", "sells", "buy_sol", "sell_sol", "mc_open", "mc_close", "mc_high", "mc_low"))


def health_counters() -> dict[str, Column]:
    """What every batch of a scored stream reports: rows received, rows that passed."""
    return {"received": F.count(F.lit(1)), "passes": F.count(F.when(F.col("passed"), 1))}


def counted_sink(target: str, counters: str, metrics: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that writes each batch's rows to ``target`` and one row of counters to ``counters``, in one pass over the batch.

    Batches own one folder each in both tables and overwrite only that, so the counters of a batch that is run again stand once. Read
    them with ``read_counters``, also while the stream runs.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        row = tuple(int(seen.get[n]) for n in metrics)
        schema = ", ".join(f"{n} long" for n in metrics)
        batch.sparkSession.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch_id={batch_id}")
    return handle


def read_counters(spark: SparkSession, counters: str, metrics: list[str]) -> DataFrame:
    """batch_id and the metrics of every batch so far; no row before the first."""
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in metrics], T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(counters) if path_exists(spark, counters) else spark.createDataFrame([], schema)


# ---- keyed trailing features, fired once per mint ----------------------------------------------------------------

FIRED = T.StructType([T.StructField(n, t) for n, t in (
    ("mint", T.StringType()), ("receivedAtMs", T.LongType()), ("receivedSequence", T.LongType()), ("age_seconds", T.DoubleType()),
    ("curve_close", T.DoubleType()), ("buys_2s", T.LongType()), ("buy_sol_5s", T.DoubleType()), ("return_5s", T.DoubleType()))])
_TRAIL = T.StructType([T.StructField("first_ms", T.LongType()), T.StructField("evaluated", T.BooleanType()), T.StructField("ms", T.ArrayType(T.LongType())),
                       T.StructField("buy", T.ArrayType(T.BooleanType())), T.StructField("raw", T.ArrayType(T.LongType())), T.StructField("mc", T.ArrayType(T.DoubleType()))])


def gate_once(events: DataFrame, gate: BaseGate = BaseGate(), unit_ms: int = 1_000, delay: str = "1 minute") -> DataFrame:
    """Trailing features at each event in receipt order; emits the first event per mint that passes the gate.

    State per mint is the rows of the last five time units, the first receipt and an evaluated flag. A mint that has fired or is past the
    gate's highest age keeps only the first receipt and the flag, for ever: later events neither fire again nor start it anew. The rows of
    one mint in one micro-batch are sorted in one worker; the source's rate limit (``max_files``) bounds them.
    ``events``: mint, event_time (watermark), receivedAtMs, receivedSequence, isBuy, solAmountRaw, market_cap_sol, curve_close.
    """
    cols = ["receivedAtMs", "receivedSequence", "isBuy", "solAmountRaw", "market_cap_sol", "curve_close"]

    def passes(age: float, curve: float, buys: int, sol: float, ret: float | None) -> bool:
        return (gate.age_low <= age <= gate.age_high and gate.curve_low <= curve <= gate.curve_high and buys >= gate.min_buys_2s
                and sol >= gate.min_buy_sol_5s and ret is not None and gate.return_low <= ret <= gate.return_high)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((state.get[0], True, [], [], [], []))
            return
        if state.exists and state.get[1]:
            for _ in batches:  # nothing can fire any more
                pass
            return
        rows = pd.concat(list(batches)).sort_values(["receivedAtMs", "receivedSequence"])
        first, done, *kept = state.get if state.exists else (int(rows["receivedAtMs"].iloc[0]), False, [], [], [], [])
        trail = deque(zip(*kept))
        lamports_5 = sum(raw for _, is_buy, raw, _ in trail if is_buy)
        young = deque()  # receipt times of buys inside two units
        for t, is_buy, _, _ in trail:
            if is_buy:
                young.append(t)
        fired = None
        for now, seq, is_buy, lamports, cap, curve in zip(*(rows[c] for c in cols)):
            now, is_buy, lamports = int(now), bool(is_buy), int(lamports)
            trail.append((now, is_buy, lamports, float(cap)))
            if is_buy:
                young.append(now)
                lamports_5 += lamports
            while now - trail[0][0] >= 5 * unit_ms:
                _, was_buy, raw, _ = trail.popleft()
                lamports_5 -= raw if was_buy else 0
            while young and now - young[0] >= 2 * unit_ms:
                young.popleft()
            age, buys, sol = (now - first) / 1000.0, len(young), lamports_5 / 1e9
            ret = cap / trail[0][3] - 1 if trail[0][3] > 0 else None
            if passes(age, curve, buys, sol, ret):
                fired, done = (key[0], now, int(seq), age, float(curve), buys, sol, ret), True
            elif age > gate.age_high:
                done = True
            if done:
                trail.clear()
                break
        state.update((first, done, *([list(c) for c in zip(*trail)] if trail else [[], [], [], []])))
        if not done:
            state.setTimeoutTimestamp(max(int(first + (gate.age_high + 1) * 1000), state.getCurrentWatermarkMs() + 1))
        if fired:
            yield pd.DataFrame([fired], columns=FIRED.fieldNames())

    keyed = events.withWatermark("event_time", delay).select("mint", "event_time", *cols)
    return keyed.groupBy("mint").applyInPandasWithState(step, FIRED, _TRAIL, "append", GroupStateTimeout.EventTimeTimeout)


def score_stream(fired: DataFrame, ownership: DataFrame, model: EntryModel, threshold: float) -> DataFrame:
    """Decision code per fired mint: SKIP_SNAPSHOT_UNAVAILABLE, SKIP_FEATURE_INCOMPLETE, REJECT_MODEL or PASS.

    ``ownership`` is a stored table, joined stream to static.
    """
    own = ownership.select("mint", F.lit(True).alias("has_snapshot"), *[c for c in model.features if c not in fired.columns])
    scored = model.score(fired.join(own, "mint", "left"), "score")
    decision = (F.when(F.col("has_snapshot").isNull(), "SKIP_SNAPSHOT_UNAVAILABLE").when(F.col("initial_gini").isNull(), "SKIP_FEATURE_INCOMPLETE")
                .when(F.col("score") >= threshold, "PASS").otherwise("REJECT_MODEL"))
    return scored.withColumn("decision", decision).withColumn("passed", F.col("decision") == "PASS")


# ---- delayed entry and exit per (account, mint) -------------------------------------------------------------------

FILLS = T.StructType([T.StructField(n, t) for n, t in (
    ("account", T.StringType()), ("mint", T.StringType()), ("entry_ms", T.LongType()), ("entry_seq", T.LongType()), ("exit_ms", T.LongType()),
    ("exit_reason", T.StringType()), ("pnl_sol", T.DoubleType()))])
_POSITION = T.StructType([T.StructField(n, T.LongType()) for n in ("target", "entry_ms", "entry_seq", "internal", "tokens", "last_ms")]
                         + [T.StructField("last_pnl", T.DoubleType()), T.StructField("stage", T.StringType())])


def _buy_raw(v_sol: int, v_tok: int, real_tok: int, bps: int, spend: int) -> tuple[int, int]:
    internal = (spend - 1) * 10_000 // (10_000 + bps)
    return internal, min(internal * v_tok // (v_sol + internal), real_tok)


def _sell_raw(v_sol: int, v_tok: int, fee: int, creator: int, internal: int, tokens: int) -> int | None:
    sol, tok = v_sol + internal, v_tok - tokens
    if sol <= 0 or tok <= 0:
        return None
    out = tokens * sol // (tok + tokens)
    return out + (-out * fee) // 10_000 + (-out * creator) // 10_000


def delayed_fills(rows: DataFrame, size_sol: float, tx_cost: float, take_profit: float, stop_loss: float, hold_ms: int, delay: str) -> DataFrame:
    """Pending -> open -> closed per (account, mint) on a stream; capacity is applied afterwards in batch.

    ``rows`` mixes passes (kind 'pass', target_ms) and curve events (kind 'event') per account: account, mint, event_time,
    kind, receivedAtMs, receivedSequence, target_ms, v_sol, v_tok, real_tok, fee_bps, creator_bps.
    """
    spend = int(size_sol * 1_000_000_000)
    cols = ["kind", "receivedAtMs", "receivedSequence", "target_ms", "v_sol", "v_tok", "real_tok", "fee_bps", "creator_bps"]

    def close(key: tuple, s: dict, at: int, reason: str, pnl: float) -> tuple:
        s["stage"] = "closed"
        return (key[0], key[1], s["entry_ms"], s["entry_seq"], at, reason, pnl)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _POSITION.fields]
        s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names) | {"stage": "idle"}
        out = []
        if state.hasTimedOut:
            if s["stage"] == "open":
                out.append(close(key, s, s["last_ms"], "TIMEOUT", s["last_pnl"]))
            state.remove()
        else:
            merged = pd.concat(list(batches)).sort_values(["receivedAtMs", "kind", "receivedSequence"], ascending=[True, False, True])
            for kind, now, seq, target, v_sol, v_tok, real, fee, creator in zip(*(merged[c] for c in cols)):
                if kind == "pass":
                    if s["stage"] == "idle":
                        s |= {"stage": "pending", "target": int(target)}
                    continue
                quote = (int(v_sol), int(v_tok), int(fee), int(creator))
                if s["stage"] == "open":
                    if now > s["entry_ms"] + hold_ms:
                        out.append(close(key, s, s["last_ms"], "TIMEOUT", s["last_pnl"]))
                        continue
                    got = _sell_raw(*quote, s["internal"], s["tokens"])
                    if got is not None:
                        pnl = got / 1e9 - spend / 1e9 - 2 * tx_cost
                        s |= {"last_ms": int(now), "last_pnl": pnl}
                        ret = pnl / (spend / 1e9 + tx_cost)
                        if ret >= take_profit or ret <= stop_loss:
                            out.append(close(key, s, int(now), "TAKE_PROFIT" if ret >= take_profit else "STOP_LOSS", pnl))
                elif s["stage"] == "pending" and now >= s["target"] and real > 0:
                    internal, tokens = _buy_raw(int(v_sol), int(v_tok), int(real), int(fee) + int(creator), spend)
                    if tokens > 0:
                        got = _sell_raw(*quote, internal, tokens)
                        s |= {"stage": "open", "entry_ms": int(now), "entry_seq": int(seq), "internal": internal, "tokens": tokens, "last_ms": int(now),
                              "last_pnl": got / 1e9 - spend / 1e9 - 2 * tx_cost}
                    else:
                        s["stage"] = "closed"
            state.update(tuple(s[n] for n in names))
            wait = s["entry_ms"] + hold_ms + 1 if s["stage"] == "open" else int(merged["receivedAtMs"].max()) + hold_ms
            state.setTimeoutTimestamp(max(wait, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=FILLS.fieldNames())

    keyed = rows.withWatermark("event_time", delay).select("account", "mint", "event_time", *cols)
    return keyed.groupBy("account", "mint").applyInPandasWithState(step, FILLS, _POSITION, "append", GroupStateTimeout.EventTimeTimeout)
