"""First match per entity for many rules at once, cohort signals, opening selectors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.functions.gates import families, reason_list, rule_configs


def first_match(rows: DataFrame, rules: dict[str, Column], key: str = "mint", order: str = "bucket") -> DataFrame:
    """(config, key, order value) of the first row per key that satisfies each of a few rules.

    Every rule is a conditional minimum in a single aggregate on the key: rows are never multiplied, and the
    aggregate reuses the partitioning of the feature windows.
    """
    names = list(rules)
    agg = rows.groupBy(key).agg(*[F.min(F.when(cond, F.col(order))).alias(f"__m{i}")
                                  for i, cond in enumerate(rules.values())])
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("config"), F.col(f"__m{i}").alias("at")) for i, n in enumerate(names)]),
                    lambda s: s["at"].isNotNull())
    return (agg.select(key, F.explode(hits).alias("hit"))
            .select(F.col("hit.config").alias("config"), key, F.col("hit.at").alias(order)))


def _base(grids: dict[str, dict[str, tuple]]) -> int:
    """Base of the level codes: above every level number, so that no dimension runs into the next."""
    return 1 + max(len(values) for short, grid in grids.items() for _, values, _ in families()[short].levels(grid))


def _level_codes(rows: DataFrame, grids: dict[str, dict[str, tuple]], gate: Column, keep: list[str]) -> DataFrame:
    """Rows passing the gate, once per family they pass: (family, code), code = level numbers in one base."""
    fams, base = families(), _base(grids)
    codes = []
    for short, grid in grids.items():
        parts = fams[short].levels(grid)
        code, passes = F.lit(0), fams[short].fixed
        for _, _, level in parts:
            code = code * base + level
            passes = passes & (level > 0)
        codes.append(F.when(passes, F.struct(F.lit(short).alias("family"), code.alias("code"))))
    gated = rows.where(gate)
    return (gated.select(*keep, F.explode(F.array(*codes)).alias("x")).where(F.col("x").isNotNull())
            .select(*keep, "x.family", "x.code"))


def _configs_of(grids: dict[str, dict[str, tuple]]) -> Column:
    """Array of configurations met by a (family, code): all whose thresholds lie at or below the levels."""
    fams, base = families(), _base(grids)
    by_code: dict[str, list[str]] = {}
    for short, grid in grids.items():
        ordered = {dim: values for dim, values, _ in fams[short].levels(grid)}
        names = [(c.config, [ordered[dim].index(v) + 1 for dim, v in c.params.items()])
                 for c in rule_configs({short: grid})]
        for levels in product(*[range(1, len(v) + 1) for v in ordered.values()]):
            code = 0
            for level in levels:
                code = code * base + level
            by_code[f"{short}:{code}"] = [n for n, need in names if all(a >= b for a, b in zip(levels, need))]
    pairs = [x for k, v in by_code.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))]
    return F.element_at(F.create_map(*pairs), F.concat_ws(":", "family", F.col("code").cast("string")))


def grid_first_match(rows: DataFrame, grids: dict[str, dict[str, tuple]], gate: Column, key: str = "mint",
                     order: str = "bucket") -> DataFrame:
    """First matching row per (configuration, key) for whole threshold grids.

    A bar is reduced to one level code per family, minima are taken per (key, family, code), and only those few
    rows are expanded to configurations. The 132-point grid costs six codes per bar instead of 132 predicates.
    """
    codes = _level_codes(rows, grids, gate, [key, order])
    firsts = codes.groupBy(key, "family", "code").agg(F.min(order).alias(order))
    return (firsts.select(key, order, F.explode(_configs_of(grids)).alias("config"))
            .groupBy("config", key).agg(F.min(order).alias(order)))


def grid_hits(rows: DataFrame, grids: dict[str, dict[str, tuple]], gate: Column) -> DataFrame:
    """Matching rows per configuration (configurations without any are absent)."""
    counts = _level_codes(rows, grids, gate, []).groupBy("family", "code").agg(F.count(F.lit(1)).alias("n"))
    return (counts.select("n", F.explode(_configs_of(grids)).alias("config"))
            .groupBy("config").agg(F.sum("n").alias("hits")))


def cohort_signals(first_buys: DataFrame, ranks: DataFrame, cohorts: list[dict]) -> DataFrame:
    """Signal time per (cohort, mint): the k-th first buy among wallets ranked up to top_n.

    For k > 1 the first k buys must fall inside the window. ``first_buys``: mint, wallet, first_buy_at;
    ``ranks``: wallet, wallet_rank. Only the earliest few buys per mint and top_n are kept, with a map-side
    top-k before the shuffle.
    """
    deepest = max(c["confirmations"] for c in cohorts)
    widest = max(c["top_n"] for c in cohorts)
    sizes = sorted({c["top_n"] for c in cohorts})
    ranked = first_buys.join(ranks.where(F.col("wallet_rank") <= widest), "wallet")
    per_size = ranked.withColumn("top_n", F.explode(F.filter(
        F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("wallet_rank"))))
    w = Window.partitionBy("top_n", "mint").orderBy("first_buy_at", "wallet_rank")
    early = per_size.withColumn("n", F.row_number().over(w)).where(F.col("n") <= deepest)
    at = early.groupBy("top_n", "mint").agg(*[F.min(F.when(F.col("n") == i, F.col("first_buy_at"))).alias(f"b{i}")
                                              for i in range(1, deepest + 1)])
    options = []
    for i, c in enumerate(cohorts):
        k = c["confirmations"]
        ok = (F.col("top_n") == c["top_n"]) & F.col(f"b{k}").isNotNull()
        if k > 1:
            ok = ok & (F.unix_micros(f"b{k}") - F.unix_micros("b1") <= int(c["window_s"] * 1_000_000))
        options.append(F.when(ok, F.struct(F.lit(i).alias("cohort"), F.col(f"b{k}").alias("signal_time"))))
    return (at.select("mint", F.explode(F.filter(F.array(*options), lambda s: s.isNotNull())).alias("s"))
            .select("s.cohort", "mint", "s.signal_time"))


def selector_reasons(cfg: dict) -> Column:
    """Why an opening is skipped; an empty array qualifies it."""
    reserve = F.col("quote_reserve_sol")
    return reason_list([
        (reserve.isNull(), "no_reserve_state"),
        (reserve < cfg["min_quote_reserve_sol"], "reserve_below_minimum"),
        (reserve > cfg["max_quote_reserve_sol"], "reserve_above_maximum"),
        (F.col("largest_opening_swap_sol") > cfg["max_largest_opening_swap_sol"], "opening_swap_too_large"),
        (F.col("independent_buyers") < cfg["min_independent_buyers"], "too_few_buyers"),
        (F.col("opening_swaps") < cfg["min_opening_swaps"], "too_few_swaps"),
    ])


def select_openings(openings: DataFrame, cfg: dict) -> DataFrame:
    out = openings.withColumn("reasons", selector_reasons(cfg))
    return out.withColumn("decision", F.when(F.size("reasons") == 0, "QUALIFY").otherwise("SKIP"))
