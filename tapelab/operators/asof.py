"""As-of and interval joins that stay linear and split hot keys by time.

Keys with more rows than a task should hold are cut into cells of about equal numbers of rows. Inside (key, cell) the two sides are merged
by one sort and a running "last seen" window, so no pair of rows is ever formed. When a cell holds no match, the nearest non-empty
cell of the key supplies it from a one-row-per-cell summary. Any distance is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapelab.operators.scan import Cells, equal_cells, spread

_RIGHT, _LEFT = 0, 1
#: Events of a key that meet its spans in one cell of an interval join.
SPAN_ROWS = 4_096


def _asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, right_tie: list[Column], payload: str,
          forward: bool, strict: bool, left_tie: list[Column] | None, cells: Cells | None) -> DataFrame:
    left_cols, right_cols = left.columns, right.columns
    ties = [t.cast("long").alias(f"__k{i}") for i, t in enumerate(right_tie)]
    none_tie = [(left_tie[i].cast("long") if left_tie else F.lit(None).cast("long")).alias(f"__k{i}")
                for i in range(len(ties))]
    r = right.select(*keys, right_time.cast("long").alias("__t"), F.lit(_RIGHT).alias("__side"), *ties,
                     F.struct(*right_cols).alias("__pay"))
    l = left.select(*keys, left_time.cast("long").alias("__t"), F.lit(_LEFT).alias("__side"), *none_tie,
                    F.struct(*left_cols).alias("__row"))
    both = r.unionByName(l, allowMissingColumns=True)
    cells = cells or equal_cells(both, keys, F.col("__t"))

    tie_cols = [f"__k{i}" for i in range(len(ties))]
    # A right row at the same instant must be seen before the left row, or after it when strict.
    side = F.col("__side") if not strict else -F.col("__side")
    where_side = [side.asc()]
    if left_tie:
        # Positions are (time, tie): compare ties first, the side only breaks full equality.
        seq = [(F.col(c).desc() if forward else F.col(c).asc()) for c in tie_cols] + where_side
    else:
        seq = where_side + [(F.col(c).desc() if forward else F.col(c).asc()) for c in tie_cols]
    t_order = F.col("__t").desc() if forward else F.col("__t").asc()
    seen = lambda *by: Window.partitionBy(*by).orderBy(t_order, *seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cells.cuts is None:
        near = spread(both, cells.rows, keys).withColumn(payload, F.last("__pay", ignorenulls=True).over(seen(*keys)))
        return near.where(F.col("__side") == _LEFT).select("__row.*", payload)

    both = spread(cells.number(both, F.col("__t"), "__cell"), cells.rows, [*keys, "__cell"])
    near = both.withColumn("__near", F.last("__pay", ignorenulls=True).over(seen(*keys, "__cell")))
    edge = F.when(F.col("__side") == _RIGHT, F.struct("__t", *tie_cols))
    pick = F.min_by if forward else F.max_by
    edges = both.groupBy(*keys, "__cell").agg(pick("__pay", edge).alias("__edge"))
    c_order = F.col("__cell").desc() if forward else F.col("__cell").asc()
    beyond = Window.partitionBy(*keys).orderBy(c_order).rowsBetween(Window.unboundedPreceding, -1)
    far = edges.select(*keys, "__cell", F.last("__edge", ignorenulls=True).over(beyond).alias("__far"))

    # Repeat the key conditions on the join: both sides already sit together by (keys, cell).
    joined = near.where(F.col("__side") == _LEFT).join(far, [*keys, "__cell"], "inner")
    return joined.select("__row.*", F.coalesce("__near", "__far").alias(payload))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column,
                  right_tie: list[Column], payload: str, strict: bool = False, left_tie: list[Column] | None = None,
                  tolerance: int | None = None, cells: Cells | None = None) -> DataFrame:
    """Latest right row at or before each left row (before it when strict); NULL payload when there is none.

    Times are integers in any one unit. With ``left_tie`` positions compare as (time, tie).
    ``tolerance`` drops left rows whose match is further away. ``cells`` may be shared by joins of the same rows.
    """
    out = _asof(left, right.withColumn("__rt", right_time.cast("long")), keys, left_time, right_time, right_tie,
                payload, False, strict, left_tie, cells)
    if tolerance is not None:
        out = out.where((left_time - F.col(payload)["__rt"]) <= F.lit(tolerance))
    return out.withColumn(payload, F.col(payload).dropFields("__rt"))


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column,
                 right_tie: list[Column], payload: str, strict: bool = False, left_tie: list[Column] | None = None,
                 tolerance: int | None = None, cells: Cells | None = None) -> DataFrame:
    """Earliest right row at or after each left row (after it when strict); NULL payload when there is none."""
    out = _asof(left, right.withColumn("__rt", right_time.cast("long")), keys, left_time, right_time, right_tie,
                payload, True, strict, left_tie, cells)
    if tolerance is not None:
        out = out.where((F.col(payload)["__rt"] - left_time) <= F.lit(tolerance))
    return out.withColumn(payload, F.col(payload).dropFields("__rt"))


def interval_join(spans: DataFrame, events: DataFrame, keys: list[str], lo: Column, hi: Column, time: Column,
                  most: int = SPAN_ROWS) -> DataFrame:
    """Pair each event with the spans of its key that contain it (both ends inclusive).

    Keys with more than ``most`` events are cut into cells of that many. Spans are copied to the cells they touch and events carry one
    cell, so a hot key spreads over its cells and every join key is an equality. ``lo``/``hi`` are expressions over ``spans``,
    ``time`` over ``events``.
    """
    ev = events.withColumn("__t", time.cast("long"))
    cells = equal_cells(ev, keys, F.col("__t"), most)
    cut = spans.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")}).where(F.col("__lo") <= F.col("__hi"))
    on = keys
    if cells.cuts is not None:
        cut, ev, on = cells.touched(cut, F.col("__lo"), F.col("__hi"), "__cell"), cells.number(ev, F.col("__t"), "__cell"), [*keys, "__cell"]
    return (ev.join(cut, on, "inner")
            .where(F.col("__t").between(F.col("__lo"), F.col("__hi")))
            .drop("__cell", "__lo", "__hi", "__t"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_on: list[str], salts: int = 16,
                how: str = "inner", rows: int = 0) -> DataFrame:
    """Equality join where one key of ``big`` may hold much of the table and ``small`` has few rows per key.

    Rows of ``big`` spread over ``salts`` sub-keys by a hash of ``spread_on``; rows of ``small`` are copied once
    per sub-key. ``rows``, those of ``big`` where they are known, bounds what a task sorts.
    """
    b = spread(big.withColumn("__salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")), rows, [*keys, "__salt"])
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "__salt"], how).drop("__salt")
