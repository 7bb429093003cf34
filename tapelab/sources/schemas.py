"""Explicit schemas of the canonical tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_D38 = T.DecimalType(38, 0)


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in spec])


_L, _S, _B, _F, _I, _TS = (T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType(),
                           T.TimestampType())

CURVE_TRADES = _struct([
    ("id", _L), ("mint", _S), ("tx_signature", _S), ("event_time", _TS), ("seconds_since_launch", _F),
    ("is_buy", _B), ("sol_amount", _F), ("token_amount", _F), ("user_wallet", _S),
    ("v_tokens_bonding_curve", _L), ("v_sol_bonding_curve", _L), ("market_cap_sol", _F), ("price_sol", _F),
    ("curve_pct_depleted", _F), ("source", _S),
])

TOKENS = _struct([
    ("mint", _S), ("detected_at", _TS), ("name", _S), ("symbol", _S), ("is_mayhem_mode", _B), ("creator", _S),
    ("creator_past_tokens", _L), ("creator_past_rugs", _L), ("initial_buy_sol", _F),
    ("initial_market_cap_sol", _F), ("initial_holder_count", _L), ("initial_top1_pct_corrected", _F),
    ("initial_top5_pct_corrected", _F), ("initial_top10_pct_corrected", _F), ("dev_buy_pct_corrected", _F),
    ("initial_gini", _F), ("is_cashback_enabled", _B), ("top10_pct_suspect", _B),
])

POOL_SWAPS = _struct([
    ("signature", _S), ("slot", _L), ("receivedAtMs", _L), ("receivedSequence", _L), ("side", _S),
    ("timestamp", _L), ("baseAmountRaw", _D38), ("baseReserveRaw", _D38), ("quoteReserveRaw", _D38),
    ("quoteAmountRaw", _D38), ("quoteReserveDeltaRaw", _D38), ("userQuoteAmountRaw", _D38),
    ("virtualQuoteReservesRaw", _D38), ("baseSupplyRaw", _D38), ("lpFeeBasisPoints", _I),
    ("protocolFeeBasisPoints", _I), ("coinCreatorFeeBasisPoints", _I), ("cashbackFeeBasisPoints", _I),
    ("pool", _S), ("user", _S), ("coinCreator", _S),
])

CURVE_EVENTS = _struct([
    ("signature", _S), ("slot", _L), ("receivedAtMs", _L), ("receivedSequence", _L), ("mint", _S), ("user", _S),
    ("creator", _S), ("quoteMint", _S), ("isBuy", _B), ("timestamp", _L), ("solAmountRaw", _D38),
    ("quoteAmountRaw", _D38), ("tokenAmountRaw", _D38), ("virtualSolReservesRaw", _D38),
    ("virtualTokenReservesRaw", _D38), ("realSolReservesRaw", _D38), ("realTokenReservesRaw", _D38),
    ("feeBasisPoints", _I), ("creatorFeeBasisPoints", _I), ("cashbackFeeBasisPoints", _I),
    ("buybackFeeBasisPoints", _I), ("mayhemMode", _B), ("ixName", _S),
])

MIGRATIONS = _struct([
    ("signature", _S), ("slot", _L), ("blockTime", _L), ("migrationLogReceivedAtMs", _L),
    ("migrationLogReceivedSequence", _L), ("migrationResolvedAtMs", _L), ("migrationResolutionMs", _L),
    ("instruction", _S), ("mint", _S), ("quoteMint", _S), ("pool", _S), ("name", _S), ("symbol", _S),
    ("creator", _S), ("totalSupplyRaw", _D38), ("solUsd", _F), ("tokenCreatedTimestamp", _L),
])

HOLDER_BALANCES = _struct([
    ("mint", _S), ("address", _S), ("amount", _D38), ("is_curve_account", _B), ("is_creator_account", _B),
])

_COIN = _struct([
    ("name", _S), ("symbol", _S), ("creator", _S), ("createdTimestamp", _L), ("lastTradeTimestamp", _L),
    ("marketCapSol", _F), ("usdMarketCap", _F), ("complete", _B), ("poolAddress", _S), ("isCashbackCoin", _B),
    ("replyCount", _F), ("canonicalPumpMigration", _B),
])

SNAPSHOTS = _struct([
    ("capturedAt", _L), ("capturedIso", _S),
    ("entries", T.ArrayType(_struct([
        ("pool", _S), ("dex", _S), ("mint", _S), ("quoteMint", _S), ("poolCreatedAt", _L), ("priceSol", _F),
        ("fdvUsd", _F), ("reserveUsd", _F), ("priceChange", T.MapType(_S, _F)),
        ("transactions", T.MapType(_S, T.MapType(_S, _L))), ("volumeUsd", T.MapType(_S, _F)), ("coin", _COIN),
    ]))),
])

DECISIONS = _struct([
    ("at", _L), ("decisionSequence", _L), ("version", _S), ("decision", _S), ("reasons", T.ArrayType(_S)),
    ("pool", _S), ("mint", _S), ("name", _S), ("symbol", _S), ("migrationTime", _L), ("submittedAtMs", _L),
    ("decisionReceivedSequence", _L), ("quoteReserveSol", _F), ("openingSwaps", _L), ("independentBuyers", _L),
    ("largestOpeningSwapSol", _F), ("openingNetFlowSol", _F),
])
