"""The research run over files: trades -> clean tape -> feature bars -> first rule hits -> screen and its report, each written once and read back.

A stage whose folder is already complete is not built again, so a run that was stopped goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapelab.functions import gates
from tapelab.functions.bar_amm import Costs
from tapelab.operators import bars as B, clean as C, evaluate as V, outcomes as O, signals as Sg
from tapelab.sources.tables import markdown_table, materialize, read_tape, write_report, write_text


@dataclass(frozen=True)
class Screen:
    """Rules, exit, splits and acceptance of a screen; the defaults are the frozen values."""

    grids: dict = field(default_factory=lambda: gates.GRIDS)
    limits: gates.Limits = gates.Limits()
    tp: float = 0.50
    sl: float = -0.25
    hold_us: int = 60_000_000
    train_days: int = 4
    validation_days: int = 1
    total_days: int = 7
    min_trades: int = 20
    top: int = 15
    costs: Costs = Costs()

    def trades(self, features: DataFrame, first_hits: DataFrame) -> DataFrame:
        """(config, split, trade); each distinct (mint, signal bar) is replayed once, trades after the window are left out."""
        signals = first_hits.select("config", "mint", F.unix_micros("bucket").alias("signal_us"))
        start = features.agg(F.min(F.unix_micros("bucket"))).scalar()
        split = V.split_col(F.col("entry_us"), start, self.train_days, self.validation_days, self.total_days)
        labelled = O.label_trades(signals, features, self.tp, self.sl, self.hold_us, self.costs)
        return signals.join(labelled, ["mint", "signal_us"]).withColumn("split", split).where(F.col("split").isNotNull())

    def results(self, spark: SparkSession, features: DataFrame, first_hits: DataFrame) -> DataFrame:
        """One row per rule configuration with its metrics per split; ``rank`` for the frozen finalists, ``survives`` for those that hold up."""
        configs = spark.createDataFrame([(c.config, c.family) for c in gates.rule_configs(self.grids)], "config string, family string")
        metrics = V.trade_metrics(self.trades(features, first_hits), ["config", "split"])
        wide = configs.join(V.by_split(metrics, ["config"], configs.select("config")), "config")
        ranked = V.freeze(wide, self.min_trades, self.top, ["config"])
        order = Window.orderBy(F.col("train_pnl_sol").desc(), "config")  # at most ``top`` rows
        place = ranked.select("config", F.row_number().over(order).alias("rank"))
        kept = V.survivors(ranked).select("config", F.lit(True).alias("survives"))
        return wide.join(place, "config", "left").join(kept, "config", "left").fillna({"survives": False})


@dataclass(frozen=True)
class TapeRun:
    """Where a run writes, and its settings."""

    out: str
    days: int = 7
    width_s: int = 1
    max_age_s: float = B.MAX_BAR_AGE_S
    rules: C.CleanRules = C.CleanRules()
    screen: Screen = Screen()

    def tape(self, spark: SparkSession, trades: list[str]) -> DataFrame:
        """The last days of all trade files without faulty rows, sorted by token and time."""
        build = lambda: C.clean_tape(C.last_window(read_tape(spark, trades), self.days), self.rules)
        return materialize(spark, build, f"{self.out}/tape", ["mint", "event_time", "id"])

    def features(self, spark: SparkSession, tape: DataFrame, tokens: Callable[[DataFrame], DataFrame]) -> DataFrame:
        build = lambda: B.feature_table(tape, C.token_dim(tokens(tape), tape), self.width_s, self.max_age_s)
        return materialize(spark, build, f"{self.out}/features", ["mint", "bucket"])

    def first_hits(self, spark: SparkSession, features: DataFrame) -> DataFrame:
        build = lambda: Sg.grid_first_match(features, self.screen.grids, gates.common_gate(self.screen.limits))
        return materialize(spark, build, f"{self.out}/first_hits")

    def results(self, spark: SparkSession, features: DataFrame, first_hits: DataFrame) -> DataFrame:
        return materialize(spark, lambda: self.screen.results(spark, features, first_hits), f"{self.out}/results")

    def report(self, spark: SparkSession, features: DataFrame, results: DataFrame) -> DataFrame:
        """Writes report (JSON, one document) and report_md (Markdown, finalists in order of rank and those that survive), returns the document.

        Both are as large as the rule grid, whatever the tape.
        """
        finalists = results.where(F.col("rank").isNotNull())
        listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in results.columns if c != "rank"])))).scalar()
        sc = self.screen
        protocol = {"size_sol": sc.costs.size_sol, "fee_rate": sc.costs.fee_rate, "tx_cost_sol": sc.costs.tx_cost, "take_profit": sc.tp, "stop_loss": sc.sl,
                    "hold_seconds": sc.hold_us / 1e6, "train_days": sc.train_days, "validation_days": sc.validation_days, "total_days": sc.total_days,
                    "min_train_trades": sc.min_trades, "finalists": sc.top}
        doc = features.agg(F.count_distinct("mint").alias("processed_tokens"), F.min("bucket").alias("start")).select(
            F.struct(*[F.lit(v).alias(k) for k, v in protocol.items()]).alias("protocol"), "start", "processed_tokens",
            results.agg(F.count(F.lit(1))).scalar().alias("configurations"), listed(finalists).alias("frozen_finalists"),
            listed(results.where("survives")).alias("validation_survivors"), listed(results).alias("all_results"))
        write_report(doc, f"{self.out}/report")
        cols = ["rank", "config", "family", "train_trades", "train_pnl_sol", "validation_pnl_sol", "test_pnl_sol"]
        tables = [(title, markdown_table(df.orderBy("rank").select(cols), sc.top)) for title, df in (
            ("Frozen training finalists", finalists), ("Validation survivors", results.where("survives")))]
        text = "# Rule screen\n\n" + "\n".join(f"## {title}\n\n{body}" for title, body in tables)
        write_text(spark, text, f"{self.out}/report_md")
        return spark.read.schema(doc.schema).json(f"{self.out}/report")

    def run(self, spark: SparkSession, trades: list[str], tokens: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """All stages up to the first hits and a one-row manifest. ``tokens`` gives the token table that goes with a tape."""
        tape = self.tape(spark, trades)
        features = self.features(spark, tape, tokens)
        write_report(C.tape_manifest(tape), f"{self.out}/manifest")
        return {"tape": tape, "features": features, "first_hits": self.first_hits(spark, features), "manifest": spark.read.json(f"{self.out}/manifest")}

    def run_screen(self, spark: SparkSession, trades: list[str], tokens: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """All stages with the screen's results and its reports."""
        got = self.run(spark, trades, tokens)
        results = self.results(spark, got["features"], got["first_hits"])
        return got | {"results": results, "report": self.report(spark, got["features"], results)}
