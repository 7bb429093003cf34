"""Exact bonding-curve quotes on live curve events, as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tapelab.functions.exprs import bind
from tapelab.functions.pool_amm import BPS, LAMPORTS, TOKEN_UNIT, ceil_fee, dec, guarded_div, idiv, lamports_of, lng

# Token supplies by mode, and the SOL level that counts as 100 percent of the curve.
SUPPLY_NORMAL = 1_000_000_000_000_000
SUPPLY_MAYHEM = 2_000_000_000_000_000
FULL_CURVE_LAMPORTS = 85_000_000_000


@dataclass(frozen=True)
class Curve:
    virtual_sol: Column
    virtual_token: Column
    real_token: Column
    fee_bps: Column
    creator_bps: Column
    supply: Column

    def as_struct(self) -> Column:
        return F.struct(*[getattr(self, n).cast("long").alias(n) for n in (
            "virtual_sol", "virtual_token", "real_token", "fee_bps", "creator_bps", "supply")])

    @staticmethod
    def from_struct(s: Column) -> "Curve":
        return Curve(*[s[n] for n in ("virtual_sol", "virtual_token", "real_token", "fee_bps", "creator_bps", "supply")])


def curve_after() -> Curve:
    """State after a curve event row."""
    c = lambda n: F.col(n).cast("long")
    return Curve(c("virtualSolReservesRaw"), c("virtualTokenReservesRaw"), c("realTokenReservesRaw"),
                 F.coalesce(c("feeBasisPoints"), lng(0)), F.coalesce(c("creatorFeeBasisPoints"), lng(0)),
                 F.when(F.col("mayhemMode"), lng(SUPPLY_MAYHEM)).otherwise(lng(SUPPLY_NORMAL)))


def curve_pct(c: Curve) -> Column:
    return c.virtual_sol.cast("double") / F.lit(float(FULL_CURVE_LAMPORTS)) * 100


def curve_mcap(c: Curve) -> Column:
    return F.when(c.virtual_token > 0, guarded_div(dec(c.virtual_sol) * dec(c.supply), dec(c.virtual_token)) / LAMPORTS)


def curve_buy(c: Curve, spend_sol: float | Column) -> Column:
    """struct(spend_sol, internal_raw, tokens_raw, fill_mcap_sol) or NULL; tokens stop at the real reserve."""
    spend = lamports_of(spend_sol)
    spent = spend.cast("double") / LAMPORTS

    def filled(internal: Column, tokens: Column) -> Column:
        mcap = spent / (tokens.cast("double") / TOKEN_UNIT) * (c.supply.cast("double") / TOKEN_UNIT)
        return F.when((internal > 0) & (tokens > 0), F.struct(
            spent.alias("spend_sol"), internal.alias("internal_raw"), tokens.alias("tokens_raw"), mcap.alias("fill_mcap_sol")))

    internal = F.when(spend > 1, idiv(dec(spend - 1) * dec(lng(BPS)), dec(lng(BPS) + c.fee_bps + c.creator_bps)))
    return bind(internal, lambda q: bind(
        F.least(idiv(dec(q) * dec(c.virtual_token), dec(c.virtual_sol) + dec(q)), c.real_token), lambda t: filled(q, t)))


def curve_sell(c: Curve, internal_raw: Column, tokens_raw: Column) -> Column:
    """struct(proceeds_sol, fill_mcap_sol) against a recorded state with our own entry added back, or NULL."""
    sol, tok = dec(c.virtual_sol) + dec(internal_raw), dec(c.virtual_token) - dec(tokens_raw)
    usable = (sol > 0) & (tok > 0)

    def paid(raw: Column) -> Column:
        return bind(raw - ceil_fee(raw, c.fee_bps) - ceil_fee(raw, c.creator_bps), lambda net: F.when(usable, F.struct(
            (net.cast("double") / LAMPORTS).alias("proceeds_sol"),
            ((net.cast("double") / LAMPORTS) / (tokens_raw.cast("double") / TOKEN_UNIT)
             * (c.supply.cast("double") / TOKEN_UNIT)).alias("fill_mcap_sol"))))

    return bind(idiv(dec(tokens_raw) * dec(sol), dec(tok + dec(tokens_raw))), paid)


def round_trip_pnl(proceeds_sol: Column, spend_sol: Column, tx_cost: float) -> Column:
    return proceeds_sol - spend_sol - F.lit(2 * tx_cost)
