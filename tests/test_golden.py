"""Audited values and seconds-scale cases with the default parameters."""

import pytest
from pyspark.sql import functions as F

from tapelab.functions import curve_amm as K, gates as G, pool_amm as P
from tapelab.operators import pools as PO, replay as R

AUDITED = dict(base=189203138900111, quote=75565184691, virtual_quote=17584505455, supply=10**15)


def pool(df, **values):
    cols = {n: F.lit(v).cast("long") for n, v in {**AUDITED, **values}.items()}
    return P.Pool(cols["base"], cols["quote"], cols["virtual_quote"], cols["supply"], tuple(F.lit(b) for b in (20, 5, 0, 95)))


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def test_sell_quote_is_exact(one):
    r = one.select(P.quote_sell(pool(one), F.lit(154879823962)).alias("q")).first()["q"]
    assert (r["internal_raw"], r["proceeds_raw"], r["fee_bps"]) == (76189050, 75274780, 120)


def test_buy_quote_is_exact(one):
    p = pool(one, base=191426938573151, quote=74485229760)
    r = one.select(P.quote_buy(p, 0.940652722).alias("q")).first()["q"]
    assert r["internal_raw"] == 929498736
    assert abs(r["tokens_raw"] - 1913253364686) < 1000


def test_too_small_or_too_large_orders_are_null(one):
    assert one.select(P.quote_buy(pool(one), 1e-9).alias("q")).first()["q"] is None
    assert one.select(P.quote_sell(pool(one, quote=1, virtual_quote=0), F.lit(1)).alias("q")).first()["q"]["proceeds_raw"] == 0


def test_largest_internal_amount(spark):
    spends = [1_000, 1_013, 10_121, 999_999, 500_000_000, 123_456_789]
    df = spark.createDataFrame([(s,) for s in spends], "spend long")
    p = pool(df)
    got = {r["spend"]: r["q"]["internal_raw"] for r in df.select("spend", P.quote_buy(p, (F.col("spend") + 0.5) / 1e9).alias("q")).collect()}
    for s in spends:
        cost = lambda q: q + sum(-(-q * b // 10_000) for b in (20, 5, 0, 95))
        want = max(q for q in range(max(0, s * 9 // 10), s + 1) if cost(q) <= s) if s < 10**6 else None
        assert cost(got[s]) <= s < cost(got[s] + 1)
        assert want is None or got[s] == want


def test_curve_state_and_round_trip(spark):
    ev = spark.createDataFrame([(42_500_000_000, 757_589_000_000_000, 477_689_000_000_000, 95, 5, False)],
                               "virtualSolReservesRaw long, virtualTokenReservesRaw long, realTokenReservesRaw long, feeBasisPoints int, creatorFeeBasisPoints int, mayhemMode boolean")
    c = K.curve_after()
    ev = ev.withColumn("buy", K.curve_buy(c, 0.5)).withColumn("sell", K.curve_sell(c, F.col("buy.internal_raw"), F.col("buy.tokens_raw")))
    r = ev.select(K.curve_pct(c).alias("pct"), K.curve_mcap(c).alias("mc"),
                  K.round_trip_pnl(F.col("sell.proceeds_sol"), F.col("buy.spend_sol"), 0.0032).alias("pnl")).first()
    assert r["pct"] == 50
    assert abs(r["mc"] - 56.098) < 0.01
    assert -0.03 < r["pnl"] < -0.01


def test_dump_guard(spark):
    df = spark.createDataFrame([(25.0, 0.1, 0.6), (0.0, 0.1, 0.1), (25.0, 0.2, 0.1)], "d double, b double, s double")
    got = [r["x"] for r in df.select(G.DumpGuard().reasons(F.col("d"), F.col("b"), F.col("s")).alias("x")).collect()]
    assert got[0] == ["active_dump_drawdown", "active_dump_pressure"] and got[1] == [] and got[2] == []


SWAP = "pool string, receivedAtMs long, receivedSequence long, timestamp long, side string, user string, signature string, baseAmountRaw long, baseReserveRaw long, " \
       "quoteReserveRaw long, quoteAmountRaw long, quoteReserveDeltaRaw long, userQuoteAmountRaw long, virtualQuoteReservesRaw long, baseSupplyRaw long, " \
       "lpFeeBasisPoints int, protocolFeeBasisPoints int, coinCreatorFeeBasisPoints int, cashbackFeeBasisPoints int"


def swap(ms, seq, side="buy", user="u", sol=0.2, quote=75_000_000_000, base=190_000_000_000_000):
    raw = int(sol * 1e9)
    return ("p", ms, seq, ms // 1000, side, user, f"s{seq}", 0, base, quote, raw, 0, raw, 17_500_000_000, 10**15, 20, 5, 0, 95)


def test_matched_entries_and_delayed_exits(spark):
    swaps = spark.createDataFrame([swap(8_000, 4), swap(10_000, 5, user="buyer-one"), swap(11_000, 6, quote=200_000_000_000)], SWAP)
    dec = spark.createDataFrame([("p", 8_500, 4, 8_000, "QUALIFY")], "pool string, submitted_ms long, decision_seq long, decision_event_ms long, decision string")
    accounts = [{"account": "FAST-170", "entry_delay_ms": 170, "exit_delay_ms": 170, "size_sol": 0.5}] + [
        {"account": a, "entry_delay_ms": 1000, "exit_delay_ms": 1000, "size_sol": s} for a, s in (("SAFE", 0.5), ("1", 1.0), ("1.5", 1.5), ("2", 2.0))]
    land = R.land_entries(dec, swaps, accounts, 1000, 5000, 0.0032)
    rows = {r["account"]: r for r in land.collect()}
    assert {r["entry_seq"] for r in rows.values()} == {5}
    assert all(r["landing_delay_ms"] == 1500 and r["status"] == "FILLED" for r in rows.values())
    done = R.delayed_exits(land, swaps, ["pool", "account"], R.ExitPlan(50, -20, 300_000), F.col("exit_delay_ms"), F.col("size_sol"), 0.0032)
    got = {r["account"]: r for r in done.collect()}
    assert got["SAFE"]["trigger_ms"] == 11_000 and got["SAFE"]["exit_target_ms"] == 12_000
    assert got["FAST-170"]["exit_target_ms"] == 11_170
    assert got["SAFE"]["trigger_reason"] == "TAKE_PROFIT" and got["SAFE"]["pnl_sol"] > 0
    spans = land.select("pool", "account", F.col("decision_event_ms").alias("lo_ms"), F.col("entry_ms").alias("hi_ms"), F.col("decision_seq").alias("lo_seq"),
                        F.col("entry_seq").alias("hi_seq"))
    comp = R.competition(spans, swaps, ["pool", "account"]).where("account = 'SAFE'").first()
    assert comp["observed_buys"] == 1 and comp["buy_sol"] == 0.2 and comp["queue_position"] == 2
    assert [w["wallet"] for w in comp["top_buyers"]] == ["buyer-one"] and comp["signatures"] == ["s5"]


def test_no_fill_after_the_landing_window(spark):
    swaps = spark.createDataFrame([swap(8_000, 4), swap(20_000, 5)], SWAP)
    dec = spark.createDataFrame([("p", 8_500, 4, 8_000, "QUALIFY")], "pool string, submitted_ms long, decision_seq long, decision_event_ms long, decision string")
    acc = [{"account": "S", "entry_delay_ms": 1000, "exit_delay_ms": 1000, "size_sol": 0.5}]
    assert R.land_entries(dec, swaps, acc, 1000, 5000, 0.0032).first()["status"] == "NO_FILL"


def test_first_observation_is_its_own_peak(spark):
    swaps = spark.createDataFrame([swap(100_500, 1)], SWAP)
    m = spark.createDataFrame([("p", 100)], "pool string, blockTime long")
    r = PO.running_drawdown(swaps, m).first()
    assert r["mcap_sol"] == r["peak_mcap_sol"] > 0 and r["drawdown_pct"] == 0
