"""Pool snapshots: flatten, filter to the wanted universe, canonical flag, first-seen rows, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapelab.functions.exprs import count_if

# Fixed value: the wrapped SOL mint.
WRAPPED_SOL = "So11111111111111111111111111111111111111112"


def snapshot_universe(raw: DataFrame, dex: str = "pumpswap", quote: str = WRAPPED_SOL, prefix: str = "solana_") -> DataFrame:
    """Pools of the wanted dex and quote, ids without their network prefix; the last row per (capture, pool) wins.

    ``raw``: capturedAt, entries array<struct<pool, dex, mint, quoteMint, poolCreatedAt, priceSol, fdvUsd, reserveUsd, ...>>.
    """
    e = raw.select("capturedAt", F.posexplode("entries").alias("pos", "e"))
    strip = lambda c: F.regexp_replace(c, f"^{prefix}", "")
    rows = e.select("capturedAt", "pos", "e.*").withColumns({"mint": strip(F.col("mint")), "quoteMint": strip(F.col("quoteMint"))})
    rows = rows.where((F.col("dex") == dex) & (F.col("quoteMint") == quote) & (F.col("mint") != quote) & (F.col("mint") != ""))
    rest = [c for c in rows.columns if c not in ("capturedAt", "pool", "pos")]
    last = rows.groupBy("capturedAt", "pool").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("capturedAt", "pool", "r.*")
    return last.withColumn("ageSeconds", (F.col("capturedAt") - F.col("poolCreatedAt")) / 1000.0)


def flag_canonical(pools: DataFrame, coins: DataFrame) -> DataFrame:
    """Adds coin state and whether the pool is the coin's own completed migration. ``coins``: mint, complete, poolAddress, symbol."""
    c = coins.select("mint", "complete", "poolAddress", "symbol")
    return pools.join(c, "mint", "left").withColumn(
        "canonical", F.coalesce(F.col("complete") & (F.col("poolAddress") == F.col("pool")), F.lit(False)))


def first_seen(rows: DataFrame, key: str, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """The first row per key, leaving out keys already stored in ``seen``."""
    new = rows if seen is None else rows.join(seen.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c not in (key, *order)]
    return new.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("f")).select("f.*") if rest else \
        new.groupBy(key).agg(F.min(F.struct(*order)).alias("f")).select(key, "f.*")


def coverage_report(snapshots: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row: captures, unique pools, canonical pools, first and last capture."""
    head = snapshots.agg(F.count(F.lit(1)).alias("snapshots"), F.min("capturedAt").alias("first_capture"), F.max("capturedAt").alias("latest_capture"))
    pools = firsts.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("canonical")).alias("c"))
    return head.withColumns({"unique_pools": pools.select("n").scalar(), "canonical_pools": pools.select("c").scalar()})
