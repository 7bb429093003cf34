"""Entry models: features, training, thresholds, evaluation, importance, ablation, parity."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.operators.boosting import Booster, Params, Tree, fit
from tapelab.operators.admission import account_report, admit
from tapelab.operators.scan import arrival_rank, exact_quantiles
from tapelab.session import cut_lineage

# The feature lists of the entry models.
DYNAMIC = [
    "age_seconds", "curve_close", "buys_2s", "sells_2s", "buyer_seconds_2s", "seller_seconds_2s", "buy_sol_2s", "sell_sol_2s",
    "buys_5s", "sells_5s", "buyer_seconds_5s", "seller_seconds_5s", "buy_sol_5s", "sell_sol_5s", "buys_15s", "sells_15s",
    "buyer_seconds_15s", "buy_sol_15s", "sell_sol_15s", "prior_buys_5_to_15s", "return_5s", "return_15s",
    "drawdown_from_60s_peak", "bounce_from_15s_low", "one_bar_return", "largest_buy_sol", "largest_sell_sol",
]
STATIC = [
    "is_mayhem_mode", "creator_past_tokens", "creator_past_rugs", "initial_buy_sol", "initial_market_cap_sol",
    "initial_holder_count", "initial_top1_pct_corrected", "initial_top5_pct_corrected", "initial_top10_pct_corrected",
    "dev_buy_pct_corrected", "initial_gini", "is_cashback_enabled",
]
PHASE = ["age_seconds", "curve_close"]
OWNERSHIP = [*PHASE, "initial_holder_count", "initial_top1_pct_corrected", "initial_top5_pct_corrected",
             "initial_top10_pct_corrected", "dev_buy_pct_corrected", "initial_gini"]
CREATOR = [*PHASE, "is_mayhem_mode", "creator_past_tokens", "creator_past_rugs", "initial_buy_sol", "initial_market_cap_sol",
           "is_cashback_enabled"]
EVENT_OWNERSHIP = [*PHASE, "event_holder_count", "event_top1_pct", "event_top5_pct", "event_top10_pct", "event_dev_pct", "event_gini"]
FEATURE_SETS = {"phase_only": PHASE, "ownership_only": OWNERSHIP, "creator_only": CREATOR, "flow_only": DYNAMIC,
                "structure_only": [*PHASE, *STATIC], "combined": [*DYNAMIC, *STATIC]}
SEED = 20260828


def numeric_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Features as doubles; flags become 0/1 and anything missing or not a number stays NULL."""
    def clean(c: str) -> Column:
        d = F.col(c).cast("double")
        return F.when(~F.isnan(d), d)
    return df.withColumns({c: clean(c) for c in cols})


@dataclass
class EntryModel:
    features: list[str]
    model: Booster

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Batch or streaming scores. Anything missing or not a number is missing to the model."""
        return df.withColumn(out, F.get(predictions([self.model])(values_of(self.features)), F.lit(0)))


def values_of(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def rows_of(values: pd.Series) -> np.ndarray:
    """Rows of an array column as a matrix; null becomes NaN."""
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 0))


def predictions(models: list[Booster], columns: list[list[int]] | None = None):
    """A function of one array of feature values to an array with one prediction per model; ``columns`` picks each model's features."""
    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        x = rows_of(values)
        return pd.Series(list(np.stack([m.predict(x if columns is None else x[:, columns[i]]) for i, m in enumerate(models)], 1)))

    return F.pandas_udf(run, "array<double>")


def fit_entry_models(train: DataFrame, sets: dict[str, list[str]], label: str = "pnl_sol", params: Params = Params()) -> dict[str, EntryModel]:
    """Boosted regression trees on PnL for several feature sets, fitted together; see ``boosting``."""
    return {name: EntryModel(sets[name], booster) for name, booster in fit(train, sets, label, params).items()}


def fit_entry_model(train: DataFrame, features: list[str], label: str = "pnl_sol", params: Params = Params()) -> EntryModel:
    return fit_entry_models(train, {"model": features}, label, params)["model"]


def score_all(models: dict[str, EntryModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """feature_set, ``keep`` and prediction: every row once per model, scored in one pass."""
    union = list(dict.fromkeys(c for m in models.values() for c in m.features))
    columns = [[union.index(c) for c in m.features] for m in models.values()]
    names = F.array(*[F.lit(n) for n in models])
    scored = df.select(*keep, F.arrays_zip(names.alias("feature_set"), predictions([m.model for m in models.values()], columns)(values_of(union)).alias("prediction")).alias("s"))
    return scored.select(*keep, F.explode("s").alias("s")).select("s.feature_set", *keep, "s.prediction")


def with_pass(scored: DataFrame, threshold: float | Column) -> DataFrame:
    return scored.withColumn("passed", F.col("prediction") >= threshold)


def threshold_grid(scored: DataFrame, low: float = 0.80, high: float = 0.995, count: int = 30, by: list[str] | None = None) -> DataFrame:
    """Distinct exact quantiles of the predictions: at most ``count`` rows (k, threshold), per model when ``by`` is given."""
    probs = {f"q{i}": low + (high - low) * i / (count - 1) for i in range(count)}
    wide = exact_quantiles(scored, by or [], F.col("prediction"), probs)
    arr = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in probs])))
    return wide.select(*(by or []), F.posexplode(arr).alias("k", "threshold"))


def sweep_thresholds(scored: DataFrame, thresholds: DataFrame, by: list[str] | None = None, capital: float = 3.0, max_open: int = 3,
                     required: float = 0.5032) -> DataFrame:
    """Account report per threshold over trades that score at least that much.

    A group's few thresholds ride along as one array, so trades are copied only to the thresholds they pass.
    ``by`` sweeps several models at once.
    """
    by = by or []
    # At most 30 values per model by construction of the grid.
    grid = thresholds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "threshold"))).alias("g"))
    rows = scored.join(grid, by) if by else scored.withColumn("g", grid.select("g").scalar())
    rows = rows.withColumn("s", F.explode(F.filter("g", lambda x: x["threshold"] <= F.col("prediction"))))
    trades = rows.select(*by, "mint", "entry_us", "exit_us", "pnl_sol", "exit_reason", F.col("s.k").alias("k"))
    admitted = cut_lineage(admit(trades, [*by, "k"], capital, max_open, required, extra=["exit_reason"]))
    return account_report(admitted, [*by, "k"], capital).join(thresholds, [*by, "k"])


def choose(sweep: DataFrame, by: list[str] | None = None, min_trades: int = 10, max_share: float = 0.60, max_drawdown: float = 1.5) -> DataFrame:
    """The best acceptable threshold by PnL, per model when ``by`` is given; none acceptable means no row, and no test is run."""
    ok = ((F.col("accepted_trades") >= min_trades) & (F.col("pnl_sol") > 0)
          & (F.coalesce("largest_profit_share", F.lit(0.0)) <= max_share) & (F.col("max_drawdown_sol") <= max_drawdown))
    best = F.min_by(F.struct("k", "threshold", "accepted_trades", "pnl_sol"), F.struct(-F.col("pnl_sol"), F.col("k"))).alias("b")
    return sweep.where(ok).groupBy(*(by or [])).agg(best).where(F.col("b").isNotNull()).select(*(by or []), "b.*")


def evaluate(scored_test: DataFrame, chosen: DataFrame, by: list[str] | None = None, capital: float = 3.0, max_open: int = 3,
             required: float = 0.5032) -> DataFrame:
    """Account report on the untouched test at the chosen threshold; empty when nothing was chosen."""
    if by:
        scored = scored_test.join(chosen.select(*by, "threshold"), by)
    else:
        scored = scored_test.withColumn("threshold", chosen.select("threshold").scalar())
    keys = [*(by or []), "split"]
    trades = (scored.where(F.col("prediction") >= F.col("threshold"))
              .select(*(by or []), F.lit("test").alias("split"), "mint", "entry_us", "exit_us", "pnl_sol", "exit_reason"))
    return account_report(cut_lineage(admit(trades, keys, capital, max_open, required, extra=["exit_reason"])), keys, capital)


def permutation_importance(model: EntryModel, df: DataFrame, key: str = "mint", label: str = "pnl_sol", repeats: int = 3,
                           seed: int = SEED) -> DataFrame:
    """Rise of the mean squared error when one feature is shuffled, averaged over repeats.

    A shuffle pairs the rows' ranks under two hash orders; ranks come from cells, so no task orders all rows. A row meets the values
    of its partner once; all its variants are made and scored where they meet, never as rows.
    """
    cols, booster = model.features, model.model
    base = cut_lineage(df.select(key, F.col(label).cast("double").alias("label"), values_of(cols).alias("own")))

    def errors(own: pd.Series, other: pd.Series, y: pd.Series) -> pd.Series:
        x, z = rows_of(own), rows_of(other)
        out = [(booster.predict(x) - y.to_numpy()) ** 2] if len(own) else [np.zeros(0)] * (len(cols) + 1)
        for j in range(len(cols)) if len(own) else ():
            mixed = x.copy()
            mixed[:, j] = z[:, j]
            out.append((booster.predict(mixed) - y.to_numpy()) ** 2)
        return pd.Series(list(np.stack(out, 1)), dtype=object)

    squared = F.pandas_udf(errors, "array<double>")
    reps = []
    for rep in range(repeats):
        def ranked(salt: int) -> DataFrame:
            h = F.xxhash64(F.col(key), F.lit(seed + salt))
            return arrival_rank(base.withColumn("__h", h), [], [F.col("__h"), F.col(key)], "__r").drop("__h")
        pair = ranked(2 * rep).join(ranked(2 * rep + 1).select("__r", F.col("own").alias("other")), "__r")
        reps.append(pair.select(F.posexplode(squared("own", "other", "label")).alias("i", "e")).groupBy("i").agg(F.avg("e").alias("mse")).withColumn("rep", F.lit(rep)))
    mse = reps[0]
    for more in reps[1:]:
        mse = mse.unionByName(more)
    mse = cut_lineage(mse)  # a row per repeat and feature
    plain = mse.where("i = 0").select("rep", F.col("mse").alias("base"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i"))
    return mse.where("i > 0").join(plain, "rep").groupBy(name.alias("feature")).agg(F.avg(F.col("mse") - F.col("base")).alias("importance"))


def ablate(train: DataFrame, validation: DataFrame, test: DataFrame, sets: dict[str, list[str]] = FEATURE_SETS, params: Params = Params()) -> DataFrame:
    """Per feature set: the threshold chosen on validation and the untouched test at it.

    All models are fitted in the same passes, and each frame is scored once for all; grids, sweeps and tests run per set as keys.
    """
    by = ["feature_set"]
    trade = ["mint", "entry_us", "exit_us", "pnl_sol", "exit_reason"]
    models = fit_entry_models(train, sets, params=params)
    val, tst = (score_all(models, df, trade) for df in (validation, test))
    grids = cut_lineage(threshold_grid(cut_lineage(score_all(models, train, [])), by=by))
    chosen = cut_lineage(choose(sweep_thresholds(val, grids, by), by))
    tested = evaluate(tst, chosen, by)
    names = train.sparkSession.createDataFrame([(n, len(c)) for n, c in sets.items()], "feature_set string, features int")
    return (names.join(chosen.select("feature_set", "threshold", F.col("accepted_trades").alias("validation_trades"),
                                     F.col("pnl_sol").alias("validation_pnl_sol")), by, "left")
            .join(tested.select("feature_set", F.col("accepted_trades").alias("test_trades"), F.col("pnl_sol").alias("test_pnl_sol")), by, "left"))


NODE = "tree int, node int, feature int, bin int, missing_left boolean, left int, right int, value double"


def save_model(spark: SparkSession, model: EntryModel, config: dict, path: str) -> None:
    """The trees as a table of nodes, and the frozen configuration with features and cut points beside them."""
    m = model.model
    nodes = [(i, j, int(t.feature[j]), int(t.bin[j]), bool(t.missing_left[j]), int(t.left[j]), int(t.right[j]), float(t.value[j]))
             for i, t in enumerate(m.trees) for j in range(len(t.feature))]  # rounds x 29 rows at most
    spark.createDataFrame(nodes, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    body = json.dumps({"config": config, "features": m.features, "cuts": m.cuts, "base": m.base})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[EntryModel, dict]:
    saved = json.loads(spark.read.text(f"{path}/config").first()["value"])
    trees: list[list] = []
    for r in spark.read.schema(NODE).parquet(f"{path}/model").orderBy("tree", "node").collect():
        if r["node"] == 0:
            trees.append([])
        trees[-1].append(r)
    column = lambda t, c: np.array([r[c] for r in t])
    made = [Tree(*[column(t, c) for c in ("feature", "bin", "missing_left", "left", "right", "value")]) for t in trees]
    return EntryModel(saved["features"], Booster(saved["features"], saved["cuts"], saved["base"], made)), saved["config"]


def feature_parity(batch: DataFrame, live: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Per feature: compared rows, largest absolute difference, rows missing on one side."""
    b = batch.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("b"))
    l = live.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("l"))
    both = b.join(l, keys, "full")
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("b")[f].alias("x"), F.col("l")[f].alias("y"))
                                           for f in features])).alias("r")).select("r.*")
    return rows.groupBy("feature").agg(
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("compared"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_diff"),
        F.count(F.when(F.col("x").isNull() != F.col("y").isNull(), 1)).alias("one_sided"))
