"""Boosted regression trees from histograms: several models over one training table, one Spark pass per tree level for all of them.

Values are binned once (up to 255 bins of equal counts, and one for missing values). A pass sums residuals and rows per (model, leaf,
feature, bin) in the tasks that hold the rows, sums these over the tasks, and picks each leaf's best split where its sums meet; one short
row per leaf reaches the driver. Trees grow leaf by leaf, the best gain first. Splits of all open leaves are asked for together, and so
are those of the children they would get, so a tree takes about as many passes as it is deep. Where one task holds all rows, its sums are
final, and it goes on to the next level itself: one pass per tree.

Residuals are summed as whole numbers of a small unit, so a model does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapelab.operators.scan import Running, running
from tapelab.session import cut_lineage

#: The bin of missing values; all others are below.
MISSING = 255
#: Training rows of a partition.
ROWS_PER_TASK = 200_000
#: Predictions are written anew after so many rounds; until then the trees since then are evaluated in every pass.
ROUNDS_KEPT = 25


@dataclass(frozen=True)
class Params:
    """Fixed values of the entry models: rounds, leaves of a tree, rows of a leaf, L2 term and step."""

    rounds: int = 250
    leaves: int = 15
    least: int = 40
    l2: float = 2.0
    step: float = 0.05
    bins: int = MISSING


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    n_left: int
    g_left: int
    g: int


@dataclass
class Tree:
    """Arrays per node; ``feature`` is -1 in leaves. A row goes left if its bin is at most ``bin``."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == MISSING, self.missing_left[node], b <= self.bin[node])
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)


@dataclass
class Booster:
    """A fitted model: its features, the cut points of each, and trees over their bins."""

    features: list[str]
    cuts: list[list[float]]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions for a matrix of values (NaN: missing), columns in the order of ``features``."""
        bins = to_bins(values, self.cuts)
        out = np.full(len(values), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(bins)]
        return out


def to_bins(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(values[:, j]), MISSING, np.searchsorted(np.array(c), values[:, j], side="left"))
    return out


class Growth:
    """One tree while it grows: nodes whose best split is known, asked for, or not needed."""

    def __init__(self, params: Params, n: int, g: int):
        self.params = params
        self.n, self.g, self.children = [n], [g], [None]
        self.split: list[Split | None] = [None]
        self.known = [n < 2 * params.least]

    def _open(self, node: int) -> tuple[int, int]:
        """The children of a node with a known split, made when first needed."""
        if self.children[node] is None:
            s = self.split[node]
            first = len(self.n)
            for n, g in ((s.n_left, s.g_left), (self.n[node] - s.n_left, self.g[node] - s.g_left)):
                self.n.append(n)
                self.g.append(g)
                self.children.append(None)
                self.split.append(None)
                self.known.append(n < 2 * self.params.least)
            self.children[node] = (first, first + 1)
        return self.children[node]

    def advance(self) -> tuple[list[int], set[int]]:
        """(nodes whose split is to be found next, nodes split so far, best gain first); nothing to find means the tree is done."""
        leaves, chosen = [0], set()
        while len(leaves) < self.params.leaves:
            unknown = [x for x in leaves if not self.known[x]]
            ranked = sorted((x for x in leaves if self.known[x] and self.split[x]), key=lambda x: (-self.split[x].gain, x))
            if unknown:
                room = self.params.leaves - len(leaves)
                ahead = [c for x in ranked[:room] for c in self._open(x) if not self.known[c]]
                return unknown + ahead, chosen
            if not ranked:
                break
            best = ranked[0]
            chosen.add(best)
            leaves.remove(best)
            leaves += self._open(best)
        return [], chosen

    def learn(self, node: int, split: Split | None) -> None:
        self.known[node], self.split[node] = True, split
        if split:
            self.g[node] = split.g

    def tree(self, inner: set[int] | None, scale: float) -> Tree:
        """The tree that splits ``inner`` (None: every node with children), with leaf values."""
        m = len(self.n)
        t = Tree(np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m))
        for i in range(m):
            if self.children[i] is not None and (inner is None or i in inner):
                s = self.split[i]
                t.feature[i], t.bin[i], t.missing_left[i] = s.feature, s.bin, s.missing_left
                t.left[i], t.right[i] = self.children[i]
            t.value[i] = self.params.step * (self.g[i] / scale) / (self.n[i] + self.params.l2)
        return t


def best_split(g: np.ndarray, n: np.ndarray, params: Params, scale: float) -> Split | None:
    """Best split of one leaf from its sums per (feature, bin); features are numbered as in the arrays.

    Missing values are tried on both sides; where there are none, they will follow the larger side. Ties go to the first feature, the
    smallest bin, and missing values on the right.
    """
    total_g, total_n = int(g[0].sum()), int(n[0].sum())
    below_g, below_n = np.cumsum(g[:, :MISSING], axis=1), np.cumsum(n[:, :MISSING], axis=1)
    lost_g, lost_n = g[:, MISSING:], n[:, MISSING:]
    left_g, left_n = np.stack([below_g, below_g + lost_g], 2), np.stack([below_n, below_n + lost_n], 2)
    right_g, right_n = total_g - left_g, total_n - left_n
    part = lambda a, b: (a / scale) ** 2 / (b + params.l2)
    gain = part(left_g, left_n) + part(right_g, right_n) - part(total_g, total_n)
    gain[(left_n < params.least) | (right_n < params.least)] = -1.0
    at = int(gain.argmax())
    f, b, side = np.unravel_index(at, gain.shape)
    if not gain[f, b, side] > 0:
        return None
    nl, gl = int(left_n[f, b, side]), int(left_g[f, b, side])
    missing_left = bool(side) if lost_n[f, 0] else nl > total_n - nl
    return Split(float(gain[f, b, side]), int(f), int(b), missing_left, nl, gl, total_g)


# ---- Spark passes ---------------------------------------------------------------------------------------------------
def bin_cuts(train: DataFrame, features: list[str], bins: int = MISSING) -> list[list[float]]:
    """Cut points per feature: between all values where there are at most ``bins``, else where the running count passes a bin's share.

    Equal values are counted first; at most ``bins`` rows per feature reach the driver.
    """
    long = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("s")).select("s.*")
    counts = cut_lineage(long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
    distinct = {r["f"]: r["c"] for r in counts.groupBy("f").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row per feature
    few = [f for f, c in distinct.items() if c <= bins]
    cuts: list[list[float]] = [[] for _ in features]
    for r in counts.where(F.col("f").isin(few)).groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("v")).collect() if few else []:
        cuts[r["f"]] = [(a + b) / 2 for a, b in zip(r["v"], r["v"][1:])]
    if len(few) < len(distinct):
        many = counts.where(~F.col("f").isin(few))
        ranked = running(many, ["f"], [F.col("v")], [Running("upto", "sum", F.col("n"))], totals={"total": F.col("n")})
        share = lambda c: F.floor(c * bins / F.col("total"))
        passed = ranked.where((share(F.col("upto")) > share(F.col("upto") - F.col("n"))) & (F.col("upto") < F.col("total")))
        for r in passed.groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():
            cuts[r["f"]] = r["v"]
    return cuts


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, dtype, count=len(column) * width, offset=int(at[0])).reshape(len(column), width)


def binary(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    size = values.shape[1] * values.dtype.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def prepared(train: DataFrame, features: list[str], label: str, cuts: list[list[float]], bases: list[float], tasks: int) -> DataFrame:
    """bins, y, pred (one prediction per model), as few partitions as ``tasks``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]], 1) if len(features) else np.zeros((b.num_rows, 0))
            pred = np.tile(np.array(bases), (b.num_rows, 1))
            yield pa.RecordBatch.from_arrays([binary(to_bins(values, cuts)), b.column(0), binary(pred)], ["bins", "y", "pred"])

    rows = train.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return cut_lineage(rows.repartition(tasks).mapInArrow(run, "bins binary, y double, pred binary"))


def with_trees(state: DataFrame, width: int, trees: list[list[Tree]]) -> DataFrame:
    """Predictions with each model's ``trees`` added, written down."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(now(b, width, trees))], ["bins", "y", "pred"])

    return cut_lineage(state.mapInArrow(run, "bins binary, y double, pred binary"))


def now(batch: pa.RecordBatch, width: int, trees: list[list[Tree]]) -> np.ndarray:
    """Current predictions of a batch, one column per model."""
    bins, pred = matrix(batch.column(0), width, np.uint8), matrix(batch.column(2), len(trees), np.float64).copy()
    for m, ts in enumerate(trees):
        for t in ts:
            pred[:, m] += t.value[t.leaf_of(bins)]
    return pred


@dataclass(frozen=True)
class Asked:
    """What one pass looks for in one model: sums of these nodes of this tree over these features."""

    model: int
    features: np.ndarray
    tree: Tree
    nodes: list[int]


def leaf_sums(bins: np.ndarray, residual: np.ndarray, asked: Asked) -> np.ndarray:
    """[node, residual or rows, feature, bin] of one batch, in whole numbers."""
    place = np.full(len(asked.tree.feature), -1)
    place[asked.nodes] = np.arange(len(asked.nodes))
    slot = place[asked.tree.leaf_of(bins)]
    rows = np.flatnonzero(slot >= 0)
    k, f = len(asked.nodes), len(asked.features)
    cell = ((slot[rows, None] * f + np.arange(f)) * 256 + bins[rows][:, asked.features]).ravel()
    count = np.bincount(cell, minlength=k * f * 256)
    g = np.repeat(residual[rows], f)
    high, low = g >> 26, g & ((1 << 26) - 1)  # sums of both halves are exact in doubles
    total = (np.bincount(cell, high.astype(float), k * f * 256).astype(np.int64) << 26) + np.bincount(cell, low.astype(float), k * f * 256).astype(np.int64)
    return np.stack([total.reshape(k, f, 256), count.reshape(k, f, 256)], 1)


SPLIT_COLUMNS = "model int, node int, gain double, feature int, bin int, missing_left boolean, n_left long, g_left long, g long"


def find_splits(state: DataFrame, width: int, trees: list[list[Tree]], asked: list[Asked], scale: float, params: Params, tasks: int) -> dict[tuple[int, int], Split | None]:
    """The best split of every node asked for, and of those asked for next where one task can tell.

    Sums of a task are one row per node; they meet by (model, node).
    """
    shape = {a.model: len(a.features) for a in asked}
    names = {a.model: a.features for a in asked}

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Bins and, per model, residuals of a batch."""
        pred, y = now(b, width, trees), b.column(1).to_numpy()
        return matrix(b.column(0), width, np.uint8), {a.model: np.rint((y - pred[:, a.model]) * scale).astype(np.int64) for a in asked}

    def sums(rows: Iterator[tuple[np.ndarray, dict[int, np.ndarray]]], asked: list[Asked] = asked) -> Iterator[tuple[int, int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        for bins, residual in rows:
            for a in asked:
                s = leaf_sums(bins, residual[a.model], a)
                held[a.model] = held[a.model] + s if a.model in held else s
        for a in asked:
            for i, node in enumerate(a.nodes):
                if a.model in held:
                    yield a.model, node, held[a.model][i]

    def splits(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        rows = []
        for (model, node), s in sorted(found.items()):
            best = best_split(s[0], s[1], params, scale)
            if best:
                rows.append((model, node, best.gain, int(names[model][best.feature]), best.bin, best.missing_left, best.n_left, best.g_left, best.g))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in SPLIT_COLUMNS.split(", ")])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, node, s in sums(map(read, batches)):
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([node], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["model", "node", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for model, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, shape[model], 256)
                found[model, node] = found[model, node] + s if (model, node) in found else s
        yield splits(found)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [read(b) for b in batches]
        found: dict[tuple[int, int], np.ndarray] = {}
        for a in asked:
            growth, nodes = Growth(params, sum(len(bins) for bins, _ in held), 0), a.nodes
            while nodes:
                step = replace(a, tree=growth.tree(None, scale), nodes=nodes)
                for model, node, s in sums(iter(held), [step]):
                    found[model, node] = s
                    best = best_split(s[0], s[1], params, scale)
                    growth.learn(node, best and replace(best, feature=int(a.features[best.feature])))
                nodes = growth.advance()[0]
        yield splits(found)

    if tasks == 1:
        out = state.mapInArrow(at_once, SPLIT_COLUMNS)
    else:
        out = state.mapInArrow(part, "model int, node int, sums binary").repartition("model", "node").mapInArrow(meet, SPLIT_COLUMNS)
    got = {(r[0], r[1]): Split(*r[2:]) for r in out.collect()}
    return {(a.model, node): None for a in asked for node in a.nodes} | got


def fit(train: DataFrame, models: dict[str, list[str]], label: str, params: Params = Params(), rows_per_task: int = ROWS_PER_TASK) -> dict[str, Booster]:
    """Fits all ``models`` (name to features) on ``label``; rows without a label are left out. No rows: models that predict zero.

    Every round adds a tree to every model that can still split. Same rows give the same models, however they are partitioned.
    """
    union = list(dict.fromkeys(c for cols in models.values() for c in cols))
    y = F.col(label).cast("double")
    train = cut_lineage(train.select(label, *union).where(y.isNotNull() & ~F.isnan(y)))
    n, top = train.agg(F.count(label), F.max(F.abs(y))).first()
    # A sum of n residuals, each at most twice the largest label, stays below 2**62.
    scale = 2.0 ** (59 - math.ceil(math.log2(n + 1)) - math.ceil(math.log2(top))) if top else 1.0
    cuts = bin_cuts(train, union, params.bins) if n else [[] for _ in union]
    base = float(train.agg(F.sum(F.rint(y * scale).cast("decimal(38,0)"))).first()[0]) / scale / n if n else 0.0
    out = {name: Booster(cols, [cuts[union.index(c)] for c in cols], base) for name, cols in models.items()}
    if not n:
        return out
    boosters = list(out.values())
    places = [np.array([union.index(c) for c in b.features], np.int64) for b in boosters]
    tasks = -(-n // rows_per_task)
    state = prepared(train, union, label, cuts, [b.base for b in boosters], tasks)
    recent: list[list[Tree]] = [[] for _ in boosters]
    active = {m for m, p in enumerate(places) if len(p)}
    for r in range(params.rounds):
        if r and r % ROUNDS_KEPT == 0:
            state, recent = with_trees(state, len(union), recent), [[] for _ in boosters]
        growing: dict[int, Growth] = {m: Growth(params, n, 0) for m in sorted(active) if n >= 2 * params.least}
        todo, found = {m: [0] for m in growing}, {}
        while todo:
            if tasks > 1 or not found:
                asked = [Asked(m, places[m], growing[m].tree(None, scale), nodes) for m, nodes in todo.items()]
                found = find_splits(state, len(union), recent, asked, scale, params, tasks)
            for m, nodes in todo.items():
                for node in nodes:
                    growing[m].learn(node, found.get((m, node)))
            todo = {m: nodes for m in todo if (nodes := growing[m].advance()[0])}
        for m, growth in growing.items():
            chosen = growth.advance()[1]
            if not chosen:
                active.discard(m)  # no split of any gain: nor will there be one later
                continue
            tree = pruned(growth.tree(chosen, scale), chosen)
            recent[m].append(tree)
            local = np.full(len(union) + 1, -1)
            local[places[m]] = np.arange(len(places[m]))
            boosters[m].trees.append(replace(tree, feature=local[tree.feature]))
    return out


def pruned(tree: Tree, inner: set[int]) -> Tree:
    """The tree without nodes that were looked at but not reached."""
    kept = [0]
    for x in kept:
        if x in inner:
            kept += [int(tree.left[x]), int(tree.right[x])]
    place = {x: i for i, x in enumerate(kept)}
    at = np.array(kept)
    move = lambda c: np.array([place.get(int(x), 0) for x in c[at]])
    return Tree(tree.feature[at], tree.bin[at], tree.missing_left[at], move(tree.left), move(tree.right), tree.value[at])
