"""Floating-point constant-product replay on bar or tape reserves: own size, own impact, fees, fixed costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tapelab.functions.exprs import finite

LAMPORTS = 1e9
TOKEN_UNIT = 1e6


@dataclass(frozen=True)
class Costs:
    size_sol: float = 0.5
    fee_rate: float = 0.0125
    tx_cost: float = 0.0032

    @property
    def basis(self) -> float:
        return self.size_sol + self.tx_cost


def entry_tokens(v_sol: Column, v_tokens: Column, size: float | Column, fee_rate: float | Column,
                 ahead_sol: Column | None = None) -> Column:
    """Tokens bought by ``size`` after the fee; NULL when the reserves give no positive finite amount.

    ``ahead_sol`` lets another buyer of that size move the reserves first.
    """
    quote, token = v_sol / LAMPORTS, v_tokens / TOKEN_UNIT
    fee = fee_rate if isinstance(fee_rate, Column) else F.lit(fee_rate)
    keep = F.lit(1.0) - fee
    if ahead_sol is not None:
        ahead = ahead_sol * keep
        moved = quote + ahead
        token = F.when(ahead > 0, quote * token / F.nullif(moved, F.lit(0.0))).otherwise(token)
        quote = F.when(ahead > 0, moved).otherwise(quote)
    spent = (size if isinstance(size, Column) else F.lit(size)) * keep
    out = token - quote * token / F.nullif(quote + spent, F.lit(0.0))
    return F.when(finite(out) & (out > 0), out)


def liquidation_pnl(v_sol: Column, v_tokens: Column, tokens: Column, size: float | Column, fee_rate: float | Column,
                    tx_cost: float | Column) -> Column:
    """PnL of selling ``tokens`` into reserves that still carry our own buy; NULL when not quotable."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    size, fee, cost = lit(size), lit(fee_rate), lit(tx_cost)
    keep = F.lit(1.0) - fee
    quote = v_sol / LAMPORTS + size * keep
    token = v_tokens / TOKEN_UNIT - tokens
    out = (quote - quote * token / F.nullif(token + tokens, F.lit(0.0))) * keep
    pnl = out - size - F.lit(2.0) * cost
    return F.when((quote > 0) & (token > 0) & finite(pnl), pnl)
