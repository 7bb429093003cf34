"""Running aggregates over long ordered groups, split so that no task holds a whole group.

A plain running window puts every row of one key in one task. Keys with more rows than a task should hold are cut into cells along the
order column, at cut points that leave about equal numbers of rows in each, wherever they lie. Rows are scanned inside (key, cell); one
summary row per cell is scanned inside the key; the two are added up. The result equals the plain window for any skew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.session import cut_lineage

_CELL = "__cell"
#: Rows of a key that one task may scan.
CELL_ROWS = 1_000_000
#: Rows that a partition of a sorted table should hold, keys apart that alone have more.
PART_ROWS = 250_000
#: Cells of one key at most; a key with more rows has larger cells.
MOST_CELLS = 1024
#: Tables of cut points up to so many keys are broadcast.
BROADCAST_KEYS = 10_000


def spread(df: DataFrame, rows: int, by: list[str]) -> DataFrame:
    """Deals ``df`` by the columns ``by`` over partitions of about PART_ROWS of ``rows``, so what a task sorts does not grow with the table.

    Left as it is where the session's own number of shuffle partitions is enough.
    """
    parts = math.ceil(rows / PART_ROWS)
    return df.repartition(parts, *by) if by and parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@dataclass(frozen=True)
class Cells:
    """Cut points along an order, for the keys that need more than one cell; ``cuts`` is None where none does. ``rows``: of the table."""

    keys: list[str]
    cuts: DataFrame | None = None
    rows: int = 0

    def _below(self, at: Column) -> Column:
        return F.size(F.filter(F.coalesce("__cuts", F.array().cast(self.cuts.schema["cuts"].dataType)), lambda c: c < at))

    def _beside(self, df: DataFrame) -> DataFrame:
        if not self.keys:
            return df.withColumn("__cuts", self.cuts.select("cuts").scalar())
        return df.join(self.cuts.withColumnRenamed("cuts", "__cuts"), self.keys, "left")

    def number(self, df: DataFrame, at: Column, name: str = _CELL) -> DataFrame:
        """Adds each row's cell, a number monotone in ``at``. Equal values of ``at`` share a cell."""
        if self.cuts is None:
            return df.withColumn(name, F.lit(0))
        return self._beside(df.withColumn("__at", at)).withColumn(name, self._below(F.col("__at"))).drop("__cuts", "__at")

    def touched(self, df: DataFrame, lo: Column, hi: Column, name: str = _CELL) -> DataFrame:
        """Copies each row to every cell from ``lo`` to ``hi``."""
        if self.cuts is None:
            return df.withColumn(name, F.lit(0))
        cut = self._beside(df.withColumns({"__from": lo, "__to": hi}))
        return cut.withColumn(name, F.explode(F.sequence(self._below(F.col("__from")), self._below(F.col("__to"))))).drop("__cuts", "__from", "__to")


def equal_cells(rows: DataFrame, keys: list[str], at: Column, most: int | None = None) -> Cells:
    """Cells of about ``most`` rows per key, from the counts of the keys and a quantile sketch of the large ones.

    Reads ``rows`` once where no key is large, and once more for the sketch where some are. The cut points are written down, so that all
    uses of the cells agree.
    """
    most = most or CELL_ROWS
    given = rows.select(*keys, at.alias("__at"))
    sizes = given.groupBy(*keys).agg(F.count("__at").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    total, biggest = sizes.agg(F.sum("__rows"), F.max("__n")).head()
    if (biggest or 0) <= most:
        return Cells(keys, rows=total or 0)
    slim, large = given.where(F.col("__at").isNotNull()), sizes.where(F.col("__n") > most)
    picked = slim.join(large.select(*keys), keys, "left_semi") if keys else slim
    sketch = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(
        "__at", [i / MOST_CELLS for i in range(1, MOST_CELLS)], 10 * MOST_CELLS).alias("__q"))
    cells = F.least(F.ceil(F.col("__n") / most), F.lit(MOST_CELLS)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), cells - 1), lambda i: F.element_at("__q", F.floor(i * MOST_CELLS / cells).cast("int")))
    made = cut_lineage(sketch.select(*keys, F.array_distinct(cuts).alias("cuts")))
    return Cells(keys, F.broadcast(made) if keys and made.count() <= BROADCAST_KEYS else made, total)


@dataclass(frozen=True)
class Running:
    """One running aggregate: kind is sum, max or min."""

    name: str
    kind: str
    value: Column

    def total(self) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def merge(self, local: Column, carried: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(local + carried, local, carried)
        return (F.greatest if self.kind == "max" else F.least)(local, carried)


def running(df: DataFrame, keys: list[str], order: list[Column], aggs: list[Running], first: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None, cells: Cells | None = None) -> DataFrame:
    """Add inclusive running aggregates per key in the given order, whose first column is a number.

    ``first`` adds whole-key minima (such as the launch time of a token) and ``totals`` whole-key sums. ``cells`` may be shared by scans
    of the same rows; otherwise they are found here.
    """
    first, totals = first or {}, totals or {}
    cells = cells or equal_cells(df, keys, order[0])
    whole = Window.partitionBy(*keys)
    if cells.cuts is None:
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return spread(df, cells.rows, keys).withColumns({**{a.name: a.total().over(upto) for a in aggs}, **{n: F.min(c).over(whole) for n, c in first.items()},
                               **{n: F.sum(c).over(whole) for n, c in totals.items()}})
    rows = spread(cells.number(df, order[0]), cells.rows, [*keys, _CELL])
    local = Window.partitionBy(*keys, _CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.withColumns({f"__l_{a.name}": a.total().over(local) for a in aggs})

    before = Window.partitionBy(*keys).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*keys, _CELL).agg(
        *[a.total().alias(f"__t_{a.name}") for a in aggs],
        *[F.min(c).alias(f"__f_{n}") for n, c in first.items()],
        *[F.sum(c).alias(f"__w_{n}") for n, c in totals.items()],
    )
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    carried = summary.select(
        *keys, _CELL,
        *[kinds[a.kind](f"__t_{a.name}").over(before).alias(f"__c_{a.name}") for a in aggs],
        *[F.min(f"__f_{n}").over(whole).alias(n) for n in first],
        *[F.sum(f"__w_{n}").over(whole).alias(n) for n in totals],
    )
    out = scanned.join(carried, [*keys, _CELL], "inner")
    out = out.withColumns({a.name: a.merge(F.col(f"__l_{a.name}"), F.col(f"__c_{a.name}")) for a in aggs})
    return out.drop(_CELL, *[f"__l_{a.name}" for a in aggs], *[f"__c_{a.name}" for a in aggs])


def max_drawdown(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str = "max_drawdown",
                 cells: Cells | None = None) -> DataFrame:
    """Largest fall of cumulative ``amount`` below its running peak (the peak starts at 0), per key.

    Each cell reduces to (sum, highest prefix, lowest prefix, inner drawdown); cell summaries combine in
    order, so the only per-key work is over cells.
    """
    cells = cells or equal_cells(df, keys, order[0])
    rows = spread(cells.number(df, order[0]).select(*keys, _CELL, amount.alias("__a"), *[o.alias(f"__o{i}") for i, o in enumerate(order)]), cells.rows, [*keys, _CELL])
    inside = (Window.partitionBy(*keys, _CELL).orderBy(*[f"__o{i}" for i in range(len(order))])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pre = rows.withColumn("__p", F.sum("__a").over(inside))
    top = pre.withColumn("__top", F.max("__p").over(inside))
    summary = top.groupBy(*keys, _CELL).agg(
        F.sum("__a").alias("__sum"),
        F.max("__p").alias("__hi"),
        F.min("__p").alias("__lo"),
        F.max(F.col("__top") - F.col("__p")).alias("__dd"),
    )
    before = Window.partitionBy(*keys).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    shifted = summary.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))
    shifted = shifted.withColumn("__abs_hi", F.col("__base") + F.col("__hi"))
    peaked = shifted.withColumn("__peak", F.greatest(F.lit(0.0), F.max("__abs_hi").over(before)))
    return peaked.groupBy(*keys).agg(
        F.max(F.greatest("__dd", F.col("__peak") - (F.col("__base") + F.col("__lo")), F.lit(0.0))).alias(name))


def arrival_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """row_number per key without one task per key."""
    return running(df, keys, order, [Running(name, "sum", F.lit(1).cast("long"))])


# ---- exact quantiles ------------------------------------------------------------------------------------------------
#: Cut points of a sketch inside a bracket.
BRACKET_CUTS = 64


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], most: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per key (or over everything with no keys); no task sorts more than about ``most`` values.

    Equal values are counted first. Keys with few distinct values rank them in one window. For others each wanted rank is bracketed:
    a sketch cuts the bracket, what lies below each cut is counted exactly, and the piece that holds the rank is the next bracket, until
    it is small enough to sort.
    """
    most = most or CELL_ROWS
    counts = cut_lineage(df.select(*keys, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
                         .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")))
    large = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > most).select(*keys, F.lit(True).alias("__large"))
    if large.isEmpty():
        return _sorted_quantiles(counts, keys, probs)
    if not keys:
        return _bracketed_quantiles(counts, keys, probs, most)
    large = cut_lineage(large)
    if large.count() <= BROADCAST_KEYS:
        large = F.broadcast(large)
    return _sorted_quantiles(counts.join(large, keys, "left_anti"), keys, probs).unionByName(
        _bracketed_quantiles(counts.join(large, keys, "left_semi"), keys, probs, most))


def _between(low: Column, high: Column, weight: Column) -> Column:
    return low + (high - low) * weight


def _sorted_quantiles(counts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of counted values that fit a window per key."""
    ranked = running(counts, keys, [F.col("__v")], [Running("__hi", "sum", F.col("__n"))], totals={"__total": F.col("__n")}, cells=Cells(keys))
    lo_rank = F.col("__hi") - F.col("__n")

    def pick(rank: Column) -> Column:
        return F.max(F.when((lo_rank <= rank) & (rank < F.col("__hi")), F.col("__v")))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("__total") - 1) * F.lit(float(p))
        aggs += [pick(F.floor(pos)).alias(f"__a_{name}"), pick(F.ceil(pos)).alias(f"__b_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"__w_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[_between(F.col(f"__a_{n}"), F.col(f"__b_{n}"), F.col(f"__w_{n}")).alias(n) for n in probs])


def _bracketed_quantiles(counts: DataFrame, keys: list[str], probs: dict[str, float], most: int) -> DataFrame:
    """Quantiles by narrowing a bracket (lo, hi] around every wanted rank; at most two ranks per probability and key."""
    pos = {n: (F.col("__total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in pos.values()])))
    totals = cut_lineage(totals)
    # "at" is the last value known to lie below the bracket; the first bracket begins below the smallest value.
    open_ = cut_lineage(totals.select(*keys, F.explode(ranks).alias("__r"), F.lit(None).cast("double").alias("__lo"), F.col("__max").alias("__top"),
                                      F.lit(0).cast("long").alias("__under")))

    def inside(brackets: DataFrame) -> DataFrame:
        """Counted values in each bracket: keys, __r, __under, __v, __n."""
        one = brackets.groupBy(*keys).agg(F.collect_list(F.struct("__r", "__lo", "__top", "__under")).alias("__b"))
        beside = counts.join(one, keys) if keys else counts.withColumn("__b", one.select("__b").scalar())
        held = F.filter("__b", lambda b: (b["__lo"].isNull() | (F.col("__v") > b["__lo"])) & (F.col("__v") <= b["__top"]))
        return beside.withColumn("__x", F.explode(held)).select(*keys, "__v", "__n", "__x.*")

    finished: DataFrame | None = None
    while True:
        rows = inside(open_)
        cuts = cut_lineage(rows.groupBy(*keys, "__r").agg(F.array_distinct(F.percentile_approx(
            "__v", [i / BRACKET_CUTS for i in range(1, BRACKET_CUTS)], 10 * BRACKET_CUTS)).alias("__cuts")))
        piece = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
        pieces = rows.join(cuts, [*keys, "__r"]).groupBy(*keys, "__r", "__lo", "__under", piece.alias("__piece")).agg(
            F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__size"), F.max("__v").alias("__top"))
        order = Window.partitionBy(*keys, "__r").orderBy("__piece")
        upto = F.col("__under") + F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = pieces.withColumns({"__upto": upto, "__low": F.coalesce(F.lag("__top").over(order), F.col("__lo"))})
        found = placed.where((F.col("__upto") - F.col("__n") <= F.col("__r")) & (F.col("__r") < F.col("__upto")))
        found = cut_lineage(found.select(*keys, "__r", F.col("__low").alias("__lo"), "__top", (F.col("__upto") - F.col("__n")).alias("__under"), "__size"))
        small = found.where(F.col("__size") <= most).drop("__size")
        finished = small if finished is None else finished.unionByName(small)
        open_ = found.where(F.col("__size") > most).drop("__size")
        if open_.isEmpty():
            break
    order = Window.partitionBy(*keys, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside(finished).withColumn("__upto", F.col("__under") + F.sum("__n").over(order))
    exact = ranked.where((F.col("__upto") - F.col("__n") <= F.col("__r")) & (F.col("__r") < F.col("__upto")))
    values = exact.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at"))
    both = totals.join(values, keys) if keys else totals.withColumn("__at", values.select("__at").scalar())
    return both.select(*keys, *[_between(F.col("__at")[F.floor(p)], F.col("__at")[F.ceil(p)], p - F.floor(p)).alias(n) for n, p in pos.items()])


def quantiles_of(df: DataFrame, keys: list[str], metrics: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """Exact quantiles of several columns per key in one pass: metric -> (value, {output name: probability}).

    Values are laid out as (key, metric, value), so all metrics share one scan. Keys without any value are absent.
    """
    probs = {f"p{i}": p for i, p in enumerate(sorted({p for _, names in metrics.values() for p in names.values()}))}
    of = {p: n for n, p in probs.items()}
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("__m"), v.cast("double").alias("__x")) for m, (v, _) in metrics.items()])).alias("s"))
    found = exact_quantiles(long.select(*keys, F.col("s.__m").alias("__m"), F.col("s.__x").alias("__x")), [*keys, "__m"], F.col("__x"), probs)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__m") == m, F.col(of[p]))).alias(n) for m, (_, names) in metrics.items() for n, p in names.items()])
