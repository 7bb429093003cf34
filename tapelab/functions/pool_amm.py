"""Exact pool quotes in integer arithmetic, as Columns over whole tables.

Amounts are raw integers (lamports, token units). Products are formed in DECIMAL(38,0); integer division only where
the quotient is known to fit BIGINT. An order that cannot be quoted gives NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tapelab.functions.exprs import bind

BPS = 10_000
LAMPORTS = 1e9
TOKEN_UNIT = 1e6
DEFAULT_SUPPLY = 1_000_000_000_000_000
_BIG = 9.0e18


def dec(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def lng(value: int) -> Column:
    return F.lit(value).cast("long")


def idiv(a: Column, b: Column) -> Column:
    """Truncating integer division; NULL for a zero divisor. The quotient must fit BIGINT."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("decimal(20,0)")))


def guarded_div(a: Column, b: Column) -> Column:
    """Integer division as double where the quotient may exceed BIGINT."""
    approx = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return F.when(approx < _BIG, idiv(a, b).cast("double")).otherwise(F.floor(approx).cast("double"))


def ceil_fee(amount: Column, bps: Column) -> Column:
    """Fee rounded up to a whole unit; whole and remainder parts apart, so BIGINT never overflows."""
    whole, rest = F.call_function("div", amount, lng(BPS)), amount % BPS
    return whole * bps + F.call_function("div", rest * bps + (BPS - 1), lng(BPS))


def lamports_of(sol: float | Column) -> Column:
    c = sol if isinstance(sol, Column) else F.lit(float(sol))
    return F.floor(c * LAMPORTS).cast("long")


@dataclass(frozen=True)
class Pool:
    """A pool at one moment: Columns for reserves, virtual quote, supply and the four fee rates."""

    base: Column
    quote: Column
    virtual_quote: Column
    supply: Column
    bps: tuple[Column, ...]

    @property
    def effective_quote(self) -> Column:
        return dec(self.quote) + dec(self.virtual_quote)

    @property
    def total_bps(self) -> Column:
        out = self.bps[0]
        for b in self.bps[1:]:
            out = out + b
        return out

    def as_struct(self) -> Column:
        names = ("lp", "protocol", "creator", "cashback")
        return F.struct(self.base.cast("long").alias("base"), self.quote.cast("long").alias("quote"),
                        self.virtual_quote.cast("long").alias("virtual_quote"), self.supply.cast("long").alias("supply"),
                        *[b.cast("int").alias(f"{n}_bps") for n, b in zip(names, self.bps)])

    @staticmethod
    def from_struct(s: Column) -> "Pool":
        return Pool(s["base"], s["quote"], s["virtual_quote"], s["supply"],
                    (s["lp_bps"], s["protocol_bps"], s["creator_bps"], s["cashback_bps"]))


def _raw(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), lng(0))


def _fees() -> tuple[Column, ...]:
    return tuple(F.coalesce(F.col(n).cast("int"), F.lit(0)) for n in (
        "lpFeeBasisPoints", "protocolFeeBasisPoints", "coinCreatorFeeBasisPoints", "cashbackFeeBasisPoints"))


def pool_before(fallback_supply: Column | None = None) -> Pool:
    """State a swap row was executed against."""
    fb = lng(DEFAULT_SUPPLY) if fallback_supply is None else fallback_supply
    return Pool(_raw("baseReserveRaw"), _raw("quoteReserveRaw"), _raw("virtualQuoteReservesRaw"),
                F.coalesce(F.col("baseSupplyRaw").cast("long"), fb), _fees())


def pool_after(fallback_supply: Column | None = None) -> Pool:
    """State a swap row leaves behind."""
    b = pool_before(fallback_supply)
    buy = F.col("side") == "buy"
    base_amount = _raw("baseAmountRaw")
    moved = F.coalesce(F.col("quoteReserveDeltaRaw"), F.col("quoteAmountRaw"), lng(0)).cast("long")
    return Pool(F.when(buy, b.base - base_amount).otherwise(b.base + base_amount),
                F.when(buy, b.quote + moved).otherwise(b.quote - moved), b.virtual_quote, b.supply, b.bps)


def quote_sol() -> Column:
    """SOL moved by a swap, as its user saw it."""
    return F.coalesce(F.col("userQuoteAmountRaw"), F.col("quoteAmountRaw")).cast("double") / LAMPORTS


def spot_mcap(p: Pool) -> Column:
    """Market cap in SOL at the spot price; NULL for an empty base side."""
    lam = guarded_div(p.effective_quote * dec(p.supply), dec(p.base))
    return F.when(p.base > 0, lam / LAMPORTS)


def quote_buy(p: Pool, spend_sol: float | Column) -> Column:
    """struct(tokens_raw, spend_sol, internal_raw, fee_bps) for a buy, or NULL.

    The pool receives the largest amount that still leaves room for four fees, each rounded up. Rounding costs at
    most 4 units against the unrounded division, so five candidates settle it without a loop.
    """
    spend = lamports_of(spend_sol)
    eff, base, fees = p.effective_quote, dec(p.base), p.bps

    def cost(q: Column) -> Column:
        out = q
        for b in fees:
            out = out + ceil_fee(q, b)
        return out

    def with_tokens(internal: Column, tokens: Column) -> Column:
        ok = (internal > 1) & (tokens > 0) & (tokens < p.base)
        return F.when(ok, F.struct(tokens.alias("tokens_raw"), (spend / LAMPORTS).alias("spend_sol"),
                                   internal.alias("internal_raw"), p.total_bps.alias("fee_bps")))

    est = idiv(dec(spend) * dec(lng(BPS)), dec(lng(BPS) + p.total_bps))
    internal = bind(est, lambda e: e - F.get(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: cost(e - k) <= spend), F.lit(0)))
    return bind(internal, lambda q: bind(idiv(base * dec(q - 1), eff + dec(q - 1)), lambda t: with_tokens(q, t)))


def quote_sell(p: Pool, tokens_raw: Column) -> Column:
    """struct(proceeds_raw, proceeds_sol, internal_raw, fee_bps) for a sale, or NULL when fees exceed the output."""
    def net_of(raw: Column) -> Column:
        net = raw
        for b in p.bps:
            net = net - ceil_fee(raw, b)
        return bind(net, lambda n: F.when(n >= 0, F.struct(
            n.alias("proceeds_raw"), (n / LAMPORTS).alias("proceeds_sol"), raw.alias("internal_raw"), p.total_bps.alias("fee_bps"))))

    return bind(idiv(p.effective_quote * dec(tokens_raw), dec(p.base) + dec(tokens_raw)), net_of)


def fill_mcap(quote_in_sol: Column, tokens_raw: Column, supply_raw: Column) -> Column:
    """Market cap in SOL at the average fill price."""
    tokens, supply = tokens_raw.cast("double") / TOKEN_UNIT, supply_raw.cast("double") / TOKEN_UNIT
    return F.when((tokens > 0) & (supply > 0), quote_in_sol / F.nullif(tokens, F.lit(0.0)) * supply)


def in_usd(mcap_sol: Column, sol_usd: Column) -> Column:
    return mcap_sol * sol_usd


def mark(p: Pool, tokens_raw: Column, size_sol: float | Column, tx_cost: float) -> Column:
    """struct(proceeds_sol, pnl_sol, return_pct) of closing a position here; the return is on size only."""
    size = size_sol if isinstance(size_sol, Column) else F.lit(float(size_sol))
    fixed = F.lit(2 * tx_cost)
    return bind(quote_sell(p, tokens_raw)["proceeds_sol"], lambda out: F.when(out.isNotNull(), F.struct(
        out.alias("proceeds_sol"), (out - size - fixed).alias("pnl_sol"),
        (F.lit(100.0) * (out - size - fixed) / size).alias("return_pct"))))
