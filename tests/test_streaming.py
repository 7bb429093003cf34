"""Streams over several files and restarts give what one batch gives."""

import json

from pyspark.sql import functions as F, types as T

from tapelab.operators.pools import opening_window
from tapelab.operators.signals import select_openings
from tapelab.operators.snapshots import first_seen
from tapelab.streaming import jobs as J

T0 = 1_700_000_000_000
SCHEMA = T.StructType([T.StructField("pool", T.StringType()), T.StructField("at", T.LongType()), T.StructField("v", T.LongType())])


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_first_seen_survives_restarts_and_repeats(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    one = [{"pool": "a", "at": 5, "v": 1}, {"pool": "a", "at": 3, "v": 2}, {"pool": "b", "at": 4, "v": 3}]
    two = [{"pool": "a", "at": 1, "v": 9}, {"pool": "c", "at": 8, "v": 4}]
    sink = J.first_seen_sink(out, "pool", ["at"], SCHEMA, str(tmp_path / "ck"))
    for name, rows in (("1.json", one), ("2.json", two)):
        write(src, name, rows)
        J.run_batches(J.file_stream(spark, str(src), SCHEMA), sink, str(tmp_path / "ck"))
    rows = lambda: sorted((r["pool"], r["at"], r["v"]) for r in spark.read.parquet(out).collect())
    want = [("a", 3, 2), ("b", 4, 3), ("c", 8, 4)]
    assert rows() == want
    sink(spark.createDataFrame([("a", 1, 9), ("c", 8, 4)], SCHEMA), 1)  # the same batch delivered again
    assert rows() == want
    assert first_seen(spark.createDataFrame([("a", 1, 9)], SCHEMA), "pool", ["at"]).count() == 1
    # A new checkpoint over the stored rows reads all files again, and a later one: nothing stored is lost or dated anew.
    write(src, "3.json", [{"pool": "b", "at": 0, "v": 7}, {"pool": "d", "at": 2, "v": 8}])
    J.run_batches(J.file_stream(spark, str(src), SCHEMA), J.first_seen_sink(out, "pool", ["at"], SCHEMA, str(tmp_path / "ck2")), str(tmp_path / "ck2"))
    assert rows() == [*want, ("d", 2, 8)]


def test_gate_fires_once_across_files(spark, tmp_path):
    schema = T.StructType([T.StructField(n, t) for n, t in (("mint", T.StringType()), ("receivedAtMs", T.LongType()), ("receivedSequence", T.LongType()),
                                                            ("isBuy", T.BooleanType()), ("solAmountRaw", T.LongType()), ("market_cap_sol", T.DoubleType()), ("curve_close", T.DoubleType()))])
    src = tmp_path / "in"
    ev = [{"mint": "m", "receivedAtMs": T0 + t, "receivedSequence": i, "isBuy": True, "solAmountRaw": 400_000_000, "market_cap_sol": 50.0 + i, "curve_close": 40.0}
          for i, t in enumerate([0, 7_000, 8_100, 8_500, 8_900, 9_000, 20_000, 600_000, 607_000, 608_100, 608_500, 608_900, 1_300_000])]
    # The last files cross the watermark at which the trail is dropped; the same burst again must not fire.
    for k, part in enumerate((ev[:3], ev[3:5], ev[5:7], ev[7:8], ev[8:10], ev[10:12], ev[12:])):
        write(src, f"{k}.json", part)
        rows = J.file_stream(spark, str(src), schema, max_files=1).withColumn("event_time", F.timestamp_millis("receivedAtMs"))
        J.run_to_files(J.gate_once(rows), str(tmp_path / "out"), str(tmp_path / "ck"))
    fired = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(fired) == 1
    r = fired[0]
    # 8 500 ms is the first event with three buys inside two seconds and at least one SOL bought inside five.
    assert (r["receivedAtMs"] - T0, r["buys_2s"], round(r["buy_sol_5s"], 6)) == (8_500, 3, 1.2)
    assert r["return_5s"] == 53.0 / 51.0 - 1


def test_counters_of_a_batch_stand_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "mint string, passed boolean")
    handle = J.counted_sink(str(tmp_path / "out"), str(tmp_path / "health"), J.health_counters())
    names = list(J.health_counters())
    assert J.read_counters(spark, str(tmp_path / "health"), names).count() == 0
    for batch, batch_id in ((rows, 0), (rows.limit(0), 1), (rows, 0), (rows.where("passed"), 2)):
        handle(batch, batch_id)
    got = sorted((r["batch_id"], r["received"], r["passes"]) for r in J.read_counters(spark, str(tmp_path / "health"), names).collect())
    assert got == [(0, 3, 2), (1, 0, 0), (2, 2, 2)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_openings_on_a_stream_equal_the_batch(spark, tmp_path):
    """Windows that span files and restarts, both ends inclusive, late swaps, repeated buyers, pools without swaps; each decided once."""
    t0, window, delay = 1_700_000_000, 100, 20
    swap_cols = "pool string, timestamp long, user string, side string, userQuoteAmountRaw long, quoteAmountRaw long, quoteReserveRaw long, receivedAtMs long, receivedSequence long"
    mig_schema, swap_schema = T._parse_datatype_string("pool string, blockTime long"), T._parse_datatype_string(swap_cols)
    migs = [("a", t0), ("b", t0 + 30), ("none", t0 + 40), ("c", t0 + 150), ("late", t0 + 1_000), ("end", t0 + 5_000)]
    raw = [("a", -1, "x", "buy", 9), ("a", 0, "x", "buy", 2), ("a", 99, "x", "sell", 1), ("b", 35, "y", "buy", 1), ("b", 30, "x", "buy", None), ("a", 100, "z", "buy", 3),
           ("a", 101, "w", "buy", 8), ("b", 130, "y", "buy", 5), ("b", 131, "q", "buy", 7), ("c", 160, "y", "sell", 4), ("c", 155, None, "buy", 2), ("c", 250, "y", "buy", 1),
           ("orphan", 260, "y", "buy", 1), ("late", 1_010, "x", "buy", 1), ("end", 5_001, "x", "buy", 1)]
    swaps = [(p, t0 + t, u, side, None if q is None else q * 10**9, 4 * 10**9, (30 + i) * 10**9, (t0 + t) * 1_000, i) for i, (p, t, u, side, q) in enumerate(raw)]
    cfg = {"min_quote_reserve_sol": 30, "max_quote_reserve_sol": 40, "max_largest_opening_swap_sol": 4, "min_independent_buyers": 2, "min_opening_swaps": 2}
    out, m_dir, s_dir = (str(tmp_path / n) for n in ("out", "m", "s"))
    for m_part, s_part in ((migs[:2], swaps[:5]), (migs[2:3], swaps[5:9]), (migs[3:5], swaps[9:14]), (migs[5:], swaps[14:]), ([], swaps[:0])):
        spark.createDataFrame(m_part, mig_schema).coalesce(1).write.mode("append").parquet(m_dir)
        spark.createDataFrame(s_part, swap_schema).coalesce(1).write.mode("append").parquet(s_dir)
        stream = J.stream_openings(J.file_stream(spark, m_dir, mig_schema, "parquet"), J.file_stream(spark, s_dir, swap_schema, "parquet"), window, f"{delay} seconds", cfg)
        J.run_to_files(stream, out, str(tmp_path / "ck"))
    got = spark.read.parquet(out).select("pool", "quote_reserve_sol", "opening_swaps", "independent_buyers", "largest_opening_swap_sol", "buys_sol", "sells_sol", "reasons", "decision")
    batch = select_openings(opening_window(spark.createDataFrame(migs, mig_schema), spark.createDataFrame(swaps, swap_schema), window), cfg)
    want = batch.where("pool <> 'end'").select(got.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    by_pool = {r["pool"]: r for r in got.collect()}
    assert by_pool["none"]["reasons"] == ["no_reserve_state", "too_few_buyers", "too_few_swaps"]
    a = by_pool["a"]
    assert (a["opening_swaps"], a["independent_buyers"], a["buys_sol"], a["sells_sol"], a["quote_reserve_sol"], a["decision"]) == (3, 2, 5.0, 1.0, 31.0, "QUALIFY")
    assert by_pool["b"]["quote_reserve_sol"] == 34.0 and by_pool["b"]["largest_opening_swap_sol"] == 5.0  # the earliest receipt, not the first row


def test_opening_join_holds_a_row_against_its_cell_only(spark, tmp_path):
    """All rows of one busy pool meet by time cells: pairs at both ends of the window are found once, and no state key keeps the whole pool."""
    t0, n = 1_700_000_000, 200
    schema = "pool string, id long, s long"
    migs = [("a", i, t0 + 900 * i) for i in range(n)] + [(None, -1, t0), ("a", -2, None), ("a", -3, 1_000), ("b", -4, t0)]
    swaps = [("a", i, t0 + 900 * i + d) for i in range(n) for d in (-120, -121, 7_200)] + [(None, -1, t0), ("a", -2, None), ("a", -3, 880), ("a", -4, 8_200), ("a", -5, 8_201)]
    sides = []
    for name, rows in (("m", migs), ("s", swaps)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        sides.append(J.file_stream(spark, str(tmp_path / name), T._parse_datatype_string(schema), "parquet").withColumn("at", F.timestamp_seconds("s")).drop("s"))
    m = sides[0].withColumnsRenamed({"id": "migration_id", "at": "migrated_at"})
    s = sides[1].withColumnsRenamed({"pool": "swap_pool", "id": "swap_id", "at": "swapped_at"})
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    joined = J.opening_joins(m, s, "2 HOURS", "2 MINUTES", "100000 days")
    assert joined.columns == ["pool", "migration_id", "migrated_at", "swap_pool", "swap_id", "swapped_at"]
    J.run_to_files(joined.select("pool", "migration_id", "swap_id", F.unix_seconds("swapped_at").alias("s")), out, ck)
    got = sorted((r.pool, r.migration_id, r.s) for r in spark.read.parquet(out).collect())
    want = sorted((p, i, t) for p, i, at in migs for q, _, t in swaps if p is not None and p == q and None not in (at, t) and at - 120 <= t <= at + 7_200)
    assert got == want
    kept = spark.read.format("statestore").option("joinSide", "right").load(ck)
    assert kept.groupBy("key").count().agg(F.max("count")).head()[0] <= 3 * 9
