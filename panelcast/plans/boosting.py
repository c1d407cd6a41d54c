"""Histogram boosting of several models at once (absolute loss).

The folds of a time-ordered cross-validation and the final model differ only
in the rows they learn from, so they grow together: features are binned once
and stored in blocks of small integers, and every job of the loop works for
all models and all open nodes.

* A tree grows best-first to ``leaves`` leaves.  One job gives the histograms
  of all nodes whose split the next choices could need, so a tree takes about
  as many jobs as it is deep.  Histograms hold counts and signs, whole numbers
  whose sums do not depend on how rows are dealt; of two siblings only the
  smaller is counted, the other is what it leaves of their parent.
* Leaf values are the medians of the leaf's residuals, found exactly.
* Every task sends a histogram per node, so their number follows the cores of
  the cluster and not the rows, and medians are chosen where the tasks' values
  meet: what a job shuffles and what the driver gets do not grow with the table.
* The first job of a tree also gives the validation errors of the last one;
  a model whose error has not fallen for ``patience`` trees drops out of the
  later jobs and keeps the trees up to its best.
* A table whose blocks are one task's anyway needs no sums over tasks: there
  each model goes through the same loop in a task of its own.

Per-row state (each model's prediction, the node a row is in) is a function of
the stored block and the trees so far.  Workers remember it between jobs within a
bound; a worker that does not have it, say after a lost executor, applies the
trees again.  A table whose state is beyond that bound carries its predictions
along in the cached blocks, every ``TAIL`` trees, so that no worker starts from
the first tree.  The loop needs rows side by side as arrays and many short
jobs, so it runs as ``mapPartitions`` over the cached blocks.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ship_package, stored

#: Rows of one stored block, the blocks that are one task's anyway, and the most that a task of many gets.
BLOCK_ROWS = 65_536
BLOCKS_PER_TASK = 8
MOST_BLOCKS = 64
#: Bytes of predictions and node lists that a worker remembers.
MEMO_BYTES = 256 << 20
#: Residuals of a leaf that a task sends at most in one pass of the median.
MEDIAN_VALUES = 4096
#: Trees sent with each job; older ones are broadcast once.
TAIL = 8
#: Accuracy of the quantile sketch that cut points come from (1 / rank error).
SKETCH = 2_000


@dataclass
class BoostParams:
    """Settings of the boosted trees; names say what they are."""

    rounds: int = 1000
    step: float = 0.05
    leaves: int = 31
    l1: float = 0.1
    l2: float = 0.1
    row_share: float = 0.8
    row_share_every: int = 1
    feature_share: float = 0.8
    min_rows: int = 20
    max_bins: int = 255
    max_categories: int = 65_535
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    cat_most: int = 32
    patience: int = 50
    seed: int = 42


@dataclass
class Binning:
    """``cuts`` of numeric features (value <= cut is in its bin or below; bin 0
    holds missing values) and ``values`` of categorical ones (code 0 holds
    null, unseen and the rarest beyond ``max_categories``)."""

    features: list[str]
    cuts: dict[str, list[float]]
    values: dict[str, list[str]]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(self.values[f]) + 1 if f in self.values else len(self.cuts[f]) + 2 for f in self.features], np.int64)

    def column(self, f: str) -> Column:
        return F.col(f).cast("string" if f in self.values else "double")

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """Rows by features, from Arrow columns of the types of :meth:`column`."""
        out = np.empty((len(columns[0]), len(self.features)), np.int32)
        for j, (f, col) in enumerate(zip(self.features, columns)):
            if f in self.values:
                out[:, j] = pc.fill_null(pc.index_in(col, value_set=pa.array(self.values[f], pa.string())), -1).to_numpy() + 1
            else:
                x = col.to_numpy(zero_copy_only=False).astype(float)
                out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(np.array(self.cuts[f]), x, "left") + 1)
        return out


def binning(df: DataFrame, features: list[str], categorical: list[str], params: BoostParams) -> Binning:
    """Cut points at quantiles of the whole table (one aggregation) and
    categories by falling count; the driver gets ``max_bins`` numbers a
    feature and the categories."""
    cats = [f for f in features if f in categorical]
    numbers = [f for f in features if f not in categorical]
    share = [k / params.max_bins for k in range(1, params.max_bins)]
    cuts = {}
    if numbers:
        def known(f):
            return F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        row = df.agg(*[F.percentile_approx(known(f), share, SKETCH).alias(f"_q{i}") for i, f in enumerate(numbers)],
                     *[F.min(known(f)).alias(f"_lo{i}") for i, f in enumerate(numbers)],
                     *[F.max(known(f)).alias(f"_hi{i}") for i, f in enumerate(numbers)]).first()
        for i, f in enumerate(numbers):
            found = sorted({*(row[f"_q{i}"] or []), *([row[f"_lo{i}"]] if row[f"_lo{i}"] is not None else [])})
            cuts[f] = [float(v) for v in found if v < row[f"_hi{i}"]]
    values = {}
    for f in cats:
        rows = (df.groupBy(F.col(f).cast("string").alias("v")).count().where("v is not null")
                .orderBy(F.desc("count"), "v").limit(params.max_categories).collect())
        values[f] = sorted(r["v"] for r in rows)
    return Binning(features, cuts, values)


# ------------------------------------------------------------------ trees


@dataclass
class Tree:
    """Nodes as lists; ``left < 0`` marks a leaf.  A row goes left if its code
    is at most ``cut``, or, where ``cats`` is set, one of them."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    cats: list[list[int] | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, cats: list[int] | None, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.cats[node], self.gain[node] = feature, cut, cats, gain
        ends = []
        for _ in range(2):
            ends.append(len(self.feature))
            for name, blank in (("feature", -1), ("cut", -1), ("cats", None), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0)):
                getattr(self, name).append(blank)
        self.left[node], self.right[node] = ends
        return ends[0], ends[1]

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.left) if n < 0]

    def divide(self, node: int, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a split node that go left and right."""
        c = codes[rows, self.feature[node]]
        goes = np.isin(c, self.cats[node]) if self.cats[node] is not None else c <= self.cut[node]
        return rows[goes], rows[~goes]

    def predict(self, codes: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """Adds the leaf values of ``rows`` to ``out``."""
        todo = [(0, rows)]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.left[node] < 0:
                out[rows] += self.value[node]
            else:
                a, b = self.divide(node, codes, rows)
                todo += [(self.left[node], a), (self.right[node], b)]


@dataclass
class BoostedModel:
    """Trees over binned features; ``base`` is the median of the target."""

    binning: Binning
    base: float
    trees: list[Tree]
    errors: list[float] = field(default_factory=list)      # validation error after each tree that was tried

    @property
    def features(self) -> list[str]:
        return self.binning.features

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(codes), self.base), np.arange(len(codes))
        for tree in self.trees:
            tree.predict(codes, rows, out)
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with its predictions, by an Arrow UDF over the features only."""
        return df.withColumn(output, predictor(df.sparkSession, {0: self})(F.lit(0)))

    def importances(self, kind: str = "split") -> list[float]:
        """Share of all splits (or of their gain) by feature."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g if kind == "gain" else 1.0
        return (total / total.sum() if total.sum() else total).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, json.dumps(asdict(t))) for i, t in enumerate(self.trees)]
        meta = json.dumps({"binning": asdict(self.binning), "base": self.base, "errors": self.errors})
        spark.createDataFrame([(-1, meta), *rows], "place int, content string").coalesce(1).write.parquet(f"{path}/boosted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        rows = spark.read.schema("place int, content string").parquet(f"{path}/boosted").orderBy("place").collect()
        meta = json.loads(rows[0]["content"])
        return cls(Binning(**meta["binning"]), meta["base"], [Tree(**json.loads(r["content"])) for r in rows[1:]], meta["errors"])


def predictor(spark: SparkSession, models: dict[int, BoostedModel]):
    """A function from a column that names the model to the column of its
    predictions (null for a name without one)."""
    ship_package(spark)
    some = next(iter(models.values()))
    sent = spark.sparkContext.broadcast(models)          # bounded by rounds, leaves and categories
    names = some.features

    def predict(batches):
        for which, *columns in batches:
            which = which.to_numpy(zero_copy_only=False).astype(float)
            out = np.full(len(which), np.nan)
            codes = some.binning.codes(columns)
            for k, model in sent.value.items():
                rows = np.flatnonzero(which == k)
                if len(rows):
                    out[rows] = model.predict(codes[rows])
            yield pa.array(out, from_pandas=True)

    from collections.abc import Iterator

    predict.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(predict, "double")
    return lambda which: udf(which.cast("double"), *(some.binning.column(f) for f in names))


# ------------------------------------------------------------------ blocks


def store_blocks(df: DataFrame, bins: Binning, target: str, row_col: str, fold_col: str) -> DataFrame:
    """``df`` as stored blocks: codes (feature after feature), targets, row numbers
    (long, unique) and the fold that a row validates (0: none)."""
    wide = int(bins.sizes.max()) > 65_535

    def block(parts):
        codes, y, row, fold = (np.concatenate(p) for p in zip(*parts))
        return pa.RecordBatch.from_pydict({"n": pa.array([len(y)], pa.int32()), "codes": [codes.T.tobytes()], "y": [y.tobytes()],
                                           "row": [row.tobytes()], "fold": [fold.tobytes()]})

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - n)
                y, row, fold = (part.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                held.append((bins.codes(part.columns[3:]).astype(np.uint32 if wide else np.uint16), y.astype(float), row.astype(np.int64), fold.astype(np.int32)))
                at, n = at + part.num_rows, n + part.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    rows = df.select(F.col(target).cast("double").alias("_y"), F.col(row_col).cast("long").alias("_row"),
                     F.coalesce(F.col(fold_col), F.lit(0)).cast("int").alias("_fold"),
                     *(bins.column(f).alias(f"_f{j}") for j, f in enumerate(bins.features)))
    packed = rows.where("_y is not null").mapInArrow(pack, "n int, codes binary, y binary, row binary, fold binary")
    return stored(packed, "boosting-blocks")


@dataclass
class Block:
    name: str
    codes: np.ndarray
    y: np.ndarray
    row: np.ndarray
    fold: np.ndarray
    score: np.ndarray | None = None    # predictions of all models after ``rounds`` trees, where the block carries them
    rounds: int = 0


def cached_blocks(spark: SparkSession, blocks: DataFrame, n_features: int) -> tuple[RDD, int]:
    """The blocks as cached arrays.  Rows of up to ``BLOCKS_PER_TASK`` full
    blocks are one task's; more are dealt evenly to as many tasks as the
    cluster has cores, or more where a task's share would pass ``MOST_BLOCKS``."""
    n, n_rows = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    full = -(-n_rows // BLOCK_ROWS)
    tasks = 1 if full <= BLOCKS_PER_TASK else min(n, max(2, min(spark.sparkContext.defaultParallelism, full), -(-full // MOST_BLOCKS)))
    rows = blocks.coalesce(1) if tasks == 1 else blocks.repartition(tasks)

    def unpack(r):
        kind = np.uint16 if len(r["codes"]) == 2 * r["n"] * n_features else np.uint32
        row = np.frombuffer(r["row"], np.int64)
        return Block(f"{row[0]}-{len(row)}", np.frombuffer(r["codes"], kind).reshape(n_features, -1).T, np.frombuffer(r["y"]), row,
                     np.frombuffer(r["fold"], np.int32))

    return rows.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK), tasks


def share_of(row: np.ndarray, seed: int, k: int) -> np.ndarray:
    """A number in [0, 1) for every row number and draw ``k``, the same wherever the row lies."""
    x = row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)) * 2.0 ** -53


# ------------------------------------------------------------------ work of a task


@dataclass
class Progress:
    """What a job must know: trees so far (``older`` as broadcasts of equal
    length), the tree that grows and the models still at work."""

    run: str
    params: BoostParams
    folds: list[int]                   # per model: the fold it is validated on, 0 for none
    base: list[float]
    older: list
    tail: list[list[Tree | None]]      # per round, per model
    growing: list[Tree | None]
    stage: str = "grow"                # node numbers of the growing trees hold within a stage

    @property
    def rounds(self) -> int:
        return TAIL * len(self.older) + len(self.tail)

    def round(self, k: int) -> list[Tree | None]:
        return self.older[k // TAIL].value[k % TAIL] if k < TAIL * len(self.older) else self.tail[k - TAIL * len(self.older)]


class _State:
    """Predictions of all models for a block after ``rounds`` trees, and the
    rows of the growing trees' nodes."""

    def __init__(self, block: Block, now: Progress):
        n = len(block.y)
        self.folds, self.nodes, self.bag = now.folds, {}, (-1, None)
        if block.score is not None and block.rounds <= now.rounds:
            self.rounds, self.score = block.rounds, block.score.copy()
        else:
            self.rounds, self.score = 0, np.array([np.full(n, b) for b in now.base])

    @property
    def bytes(self) -> int:
        return self.score.nbytes + self.score.shape[1] + sum(r.nbytes for key, r in self.nodes.items() if key != "stage")

    def fits(self, block: Block, m: int) -> np.ndarray:
        """Rows that a model learns from or is validated on."""
        f = self.folds[m]
        return np.arange(len(block.y), dtype=np.int32) if f == 0 else np.flatnonzero(block.fold <= f).astype(np.int32)

    def forward(self, block: Block, now: Progress) -> None:
        while self.rounds < now.rounds:
            for m, tree in enumerate(now.round(self.rounds)):
                if tree is None:
                    continue
                held = self.nodes if self.nodes.get("stage") == (self.rounds, "values") else {}
                if all((m, leaf) in held for leaf in tree.leaves()):
                    for leaf in tree.leaves():
                        self.score[m][held[m, leaf]] += tree.value[leaf]
                else:
                    tree.predict(block.codes, self.fits(block, m), self.score[m])
            self.rounds += 1
        if self.nodes.get("stage") != (self.rounds, now.stage):
            self.nodes = {"stage": (self.rounds, now.stage)}

    def rows(self, block: Block, m: int, tree: Tree, node: int) -> np.ndarray:
        """Rows in a node of the growing tree; its parent's are let go."""
        if (m, node) not in self.nodes:
            if node == 0:
                self.nodes[m, 0] = self.fits(block, m)
            else:
                up = next(i for i in range(len(tree.left)) if node in (tree.left[i], tree.right[i]))
                a, b = tree.divide(up, block.codes, self.rows(block, m, tree, up))
                self.nodes[m, tree.left[up]], self.nodes[m, tree.right[up]] = a, b
                del self.nodes[m, up]
        return self.nodes[m, node]


_MEMO: OrderedDict = OrderedDict()


def _state(block: Block, now: Progress) -> _State:
    key = (now.run, block.name)
    state = _MEMO.pop(key, None)
    if state is None or state.rounds > now.rounds:
        state = _State(block, now)
    state.forward(block, now)
    _MEMO[key] = state
    while len(_MEMO) > 1 and (next(iter(_MEMO))[0] != now.run or sum(s.bytes for s in _MEMO.values()) > MEMO_BYTES):
        _MEMO.popitem(last=False)
    return state


def _learnt(block: Block, now: Progress, m: int, rows: np.ndarray, in_bag: np.ndarray) -> np.ndarray:
    """The rows among ``rows`` that model ``m`` learns this tree from."""
    good = in_bag[rows]
    return rows[good if now.folds[m] == 0 else good & (block.fold[rows] < now.folds[m])]


def _bag(block: Block, now: Progress, state: _State) -> np.ndarray:
    draw = now.rounds // max(1, now.params.row_share_every)
    if state.bag[0] != draw:
        state.bag = draw, share_of(block.row, now.params.seed, draw) < now.params.row_share
    return state.bag[1]


def histograms(blocks, now: Progress, asked: list[tuple[int, int]], feats: np.ndarray, offsets: np.ndarray, with_errors: bool):
    """Per asked (model, node): rows with negative, zero and positive gradient
    by feature and bin; per model with a fold the sum of validation errors."""
    total: dict = {}
    width = int(offsets[-1]) * 3
    for block in blocks:
        state = _state(block, now)
        bag = _bag(block, now, state)
        if with_errors:
            for m, f in enumerate(now.folds):
                if f and now.growing[m] is not None:
                    rows = block.fold == f
                    total.setdefault(("error", m), []).append((block.name, float(np.abs(block.y[rows] - state.score[m][rows]).sum()), int(rows.sum())))
        for m in sorted({m for m, _ in asked}):
            nodes = [n for k, n in asked if k == m]
            parts = [_learnt(block, now, m, state.rows(block, m, now.growing[m], n), bag) for n in nodes]
            rows = np.concatenate(parts)
            sign = np.sign(state.score[m][rows] - block.y[rows]).astype(np.int64) + 1
            node = np.repeat(np.arange(len(nodes)), [len(p) for p in parts])
            found, slots = np.empty((len(nodes), width), np.int64), {}
            for j, f in enumerate(feats):              # a feature at a time: its counts stay in the processor's cache
                size = 3 * int(offsets[j + 1] - offsets[j])
                if size not in slots:
                    slots[size] = node * size + sign
                place = np.multiply(block.codes[rows, f], 3, dtype=np.int64)
                place += slots[size]
                found[:, 3 * offsets[j]:3 * offsets[j + 1]] = np.bincount(place, minlength=size * len(nodes)).reshape(len(nodes), size)
            for n, h in zip(nodes, found):
                if (m, n) in total:
                    total[m, n] += h
                else:
                    total[m, n] = h
    for key, value in total.items():       # whole numbers below 2^31 travel as such
        yield key, value if isinstance(value, list) else value.astype(np.int32)


def _gain(g, n, l1, l2):
    with np.errstate(invalid="ignore"):          # no rows and no penalty: never allowed as a side
        return np.square(np.maximum(np.abs(g) - l1, 0.0)) / (n + l2)


def best_splits(hist: np.ndarray, feats: np.ndarray, offsets: np.ndarray, is_cat: np.ndarray, params: BoostParams) -> list:
    """``(gain, feature, cut, cats)`` of the best split per node (row of
    ``hist``), or None.  Ties go to the first feature, then the lowest cut;
    categorical features follow the numeric ones."""
    counts = hist.reshape(len(hist), -1, 3)
    g, n = (counts[:, :, 2] - counts[:, :, 0]).astype(float), counts.sum(2).astype(float)
    g_all, n_all = g[:, :offsets[1]].sum(1, keepdims=True), n[:, :offsets[1]].sum(1, keepdims=True)
    whole, nodes = _gain(g_all, n_all, params.l1, params.l2), np.arange(len(hist))
    best, where = np.zeros(len(hist)), np.full((len(hist), 2), -1)
    cats: list = [None] * len(hist)

    def gains(gl, nl, l2, allowed):
        gain = _gain(gl, nl, params.l1, l2) + _gain(g_all - gl, n_all - nl, params.l1, l2) - whole
        gain[(nl < params.min_rows) | (n_all - nl < params.min_rows) | ~allowed] = -np.inf
        return gain

    numbers = np.flatnonzero(~is_cat)
    if len(numbers):
        sizes = np.diff(offsets)[numbers]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bins = np.repeat(offsets[numbers] - starts, sizes) + np.arange(sizes.sum())
        base = np.repeat(starts, sizes)
        cg, cn = (np.concatenate([np.zeros((len(hist), 1)), np.cumsum(v[:, bins], axis=1)], axis=1) for v in (g, n))
        gain = gains(cg[:, 1:] - cg[:, base], cn[:, 1:] - cn[:, base], params.l2, np.ones(1, bool))
        at = gain.argmax(1)
        good = gain[nodes, at] > 1e-9
        j = np.searchsorted(starts, at, "right") - 1
        best = np.where(good, gain[nodes, at], 0.0)
        where = np.where(good[:, None], np.stack([feats[numbers[j]], at - starts[j]], axis=1), -1)
    for j in np.flatnonzero(is_cat):
        gj, nj = g[:, offsets[j]:offsets[j + 1]], n[:, offsets[j]:offsets[j + 1]]
        order = np.argsort(np.where(nj > 0, gj / (nj + params.cat_smooth), np.inf), axis=1, kind="stable")
        seen = (nj > 0).sum(1, keepdims=True)
        steps = np.arange(min(params.cat_most, order.shape[1]))
        for way in (order[:, :len(steps)], np.take_along_axis(order, np.maximum(seen - 1 - steps, 0), axis=1)):
            gl, nl = (np.cumsum(np.take_along_axis(v, way, axis=1), axis=1) for v in (gj, nj))
            gain = gains(gl, nl, params.l2 + params.cat_l2, steps < seen - 1)
            at = gain.argmax(1)
            for k in np.flatnonzero(gain[nodes, at] > np.maximum(best, 1e-9) + 1e-12):
                best[k], where[k], cats[k] = gain[k, at[k]], (feats[j], -1), sorted(way[k, :at[k] + 1].tolist())
    return [(float(v), int(f), int(c), s) if f >= 0 else None for v, (f, c), s in zip(best, where, cats)]


def residuals(blocks, now: Progress, asked: dict[tuple[int, int], tuple[float, float]], most: int):
    """Per asked (model, leaf) and its bracket: rows below it, and the distinct
    residuals in it with the number of rows up to each (all of them, or
    ``most`` evenly spaced ones)."""
    values: dict = {}
    for block in blocks:
        state = _state(block, now)
        bag = _bag(block, now, state)
        for (m, leaf), (lo, hi) in asked.items():
            tree = now.growing[m]
            r = _learnt(block, now, m, state.rows(block, m, tree, leaf) if tree else state.fits(block, m), bag if tree else np.ones(len(bag), bool))
            r = block.y[r] - state.score[m][r]
            below, r = int((r < lo).sum()), r[(r >= lo) & (r <= hi)]
            old = values.get((m, leaf), (0, []))
            values[m, leaf] = (old[0] + below, [*old[1], r])
    for key, (below, parts) in values.items():
        r, count = np.unique(np.concatenate(parts), return_counts=True)
        upto = np.cumsum(count)
        if len(r) <= most:
            yield key, [(below, r, upto, True)]
        else:
            at = np.unique(np.linspace(0, len(r) - 1, most).astype(np.int64))
            yield key, [(below, r[at], upto[at], False)]


def _median(parts: list, total: int):
    """``(value, None)``, or ``(None, (lo, hi))`` where the two middle ones of
    ``total`` values lie."""
    below = sum(p[0] for p in parts)
    low, high = (total - 1) // 2 - below, total // 2 - below      # ranks among the values in the bracket
    at = np.unique(np.concatenate([p[1] for p in parts]))
    least, most = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)    # rows certainly / possibly up to a value
    for _, r, upto, whole in parts:
        k = np.searchsorted(r, at, "right")
        sure = np.concatenate([[0], upto])[k]
        least += sure
        # between two sent values any number of the rows up to the next may lie below
        most += sure if whole else np.where(np.isin(at, r), sure, np.concatenate([upto, upto[-1:]])[k])
    first, last = int(np.searchsorted(most, low + 1)), int(np.searchsorted(least, high + 1))
    if all(p[3] for p in parts):
        return (float(at[first]) + float(at[last])) / 2, None
    # a value that no task sent may lie above the last one that is surely too low
    return None, (float(at[max(first - 1, 0)]), float(at[last]))


# ------------------------------------------------------------------ the loop


def _model_of(key) -> int:
    return key[1] if key[0] == "error" else key[0]


def _with_siblings(found, before: dict, pairs: dict):
    """Histograms of the counted nodes, of their siblings and of the nodes
    before that are still whole; errors as they are."""
    for key, value in found:
        if key in pairs:
            parent, other = pairs[key]
            yield other, before.pop(parent) - value
        yield key, value
    yield from before.items()


class _Spread:
    """Blocks over many tasks: what ``emit`` gives by key in each of them is
    joined and finished off the driver, which gets the finished values.

    The histograms of a tree's nodes stay with the task of their model until
    the tree is done (:meth:`forget`)."""

    def __init__(self, rdd: RDD, tasks: int):
        self.rdd, self.tasks = rdd, tasks
        self.stored, self.carried, self.held, self.old = rdd, 0, None, []
        self.rows: int | None = None

    def run(self, emit, finish) -> dict:
        return dict(self.rdd.mapPartitions(emit).reduceByKey(_add, min(self.tasks, 32)).mapPartitions(finish).collect())

    def grown(self, emit, pairs: dict, finish, models: int) -> dict:
        """As :meth:`run`, for histograms by (model, node): ``pairs`` names the
        parent and the sibling of each counted node."""
        found = self.rdd.mapPartitions(emit).reduceByKey(_add_wide, models, _model_of)
        if self.held is not None:
            def siblings(tagged):
                new, before = [], {}
                for key, (is_new, value) in tagged:
                    if is_new:
                        new.append((key, value))
                    elif key[0] != "error":
                        before[key] = value
                return _with_siblings(new, before, pairs)

            both = found.mapValues(lambda v: (True, v)).union(self.held.mapValues(lambda v: (False, v)))
            found = both.partitionBy(models, _model_of).mapPartitions(siblings, True)     # both lie by model: nothing moves
        self.held = found.persist(StorageLevel.MEMORY_AND_DISK)
        self.old.append(self.held)
        return dict(self.held.mapPartitions(finish).collect())

    def forget(self) -> None:
        for rdd in self.old:
            rdd.unpersist()
        self.held, self.old = None, []

    def keep(self, trees):
        return self.rdd.context.broadcast(trees)

    def carry(self, now: Progress) -> None:
        """Blocks with the predictions so far, where workers cannot remember
        all of them.  Every eighth time from the stored blocks: a lost one is
        worked out again over few steps."""
        if self.rows is None:
            self.rows = self.stored.map(lambda block: len(block.y)).sum()
        if self.rows * len(now.folds) * 8 <= MEMO_BYTES:
            return
        self.carried += 1
        before = self.rdd
        source = self.stored if self.carried % 8 == 0 else before
        self.rdd = source.map(lambda block: _with_scores(block, now)).persist(StorageLevel.MEMORY_AND_DISK)
        self.rdd.foreach(lambda block: None)
        if before is not self.stored:
            before.unpersist()

    def close(self) -> None:
        self.forget()
        if self.rdd is not self.stored:
            self.rdd.unpersist()
            self.rdd = self.stored


@dataclass
class _Kept:
    value: list

    def destroy(self) -> None:
        pass


class _Here:
    """Blocks that are all in this task."""

    def __init__(self, blocks: list[Block]):
        self.blocks, self.held = blocks, {}

    def run(self, emit, finish) -> dict:
        return dict(finish(iter(emit(iter(self.blocks)))))

    def grown(self, emit, pairs: dict, finish, models: int) -> dict:
        found = dict(_with_siblings(emit(iter(self.blocks)), self.held, pairs))
        self.held = {key: value for key, value in found.items() if key[0] != "error"}
        return dict(finish(iter(found.items())))

    def forget(self) -> None:
        self.held = {}

    def keep(self, trees):
        return _Kept(trees)

    def carry(self, now: Progress) -> None:
        pass


def _with_scores(block: Block, now: Progress) -> Block:
    return replace(block, score=_state(block, now).score.copy(), rounds=now.rounds)


class _Trainer:
    """The loop over trees; it holds trees, errors and open splits."""

    def __init__(self, work: _Spread | _Here, bins: Binning, folds: list[int], params: BoostParams):
        self.work, self.folds, self.params = work, folds, params
        self.sizes = bins.sizes
        self.is_cat = np.array([f in bins.values for f in bins.features])
        self.run, self.older, self.tail = uuid.uuid4().hex, [], []
        self.base = [0.0] * len(folds)
        self.trees: list[list[Tree]] = [[] for _ in folds]
        self.errors: list[list[float]] = [[] for _ in folds]

    def progress(self, growing, stage="grow") -> Progress:
        return Progress(self.run, self.params, self.folds, self.base, self.older, self.tail, growing, stage)

    def chosen(self) -> np.ndarray:
        """The features of this round's trees."""
        f = len(self.sizes)
        rng = np.random.default_rng([self.params.seed, len(self.older) * TAIL + len(self.tail)])
        return np.sort(rng.choice(f, max(1, round(self.params.feature_share * f)), replace=False))

    def splits(self, growing, asked, feats, with_errors, siblings) -> dict:
        """Best split per asked (model, node), with the side that gets fewer rows; errors per ``("error", model)``.
        Siblings are asked together; ``siblings`` names the parent and the
        other end of the one to count."""
        pairs = {key: siblings[key] for key in asked if key in siblings}
        counted, wanted = [key for key in asked if key[1] == 0 or key in pairs], set(asked)
        offsets = np.concatenate([[0], np.cumsum(self.sizes[feats])])
        now, is_cat, params = self.progress(growing), self.is_cat[feats], self.params

        def emit(blocks):
            return histograms(blocks, now, counted, feats, offsets, with_errors)

        def finish(found):
            rows = []
            for key, value in found:
                if isinstance(value, list):
                    yield key, value
                elif key in wanted:
                    rows.append((key, value))
            for at in range(0, len(rows), 64):
                part = rows[at:at + 64]
                best = best_splits(np.stack([v for _, v in part]), feats, offsets, is_cat, params)
                yield from ((k, s and (*s, _smaller(v, s, feats, offsets))) for (k, v), s in zip(part, best))

        return self.work.grown(emit, pairs, finish, len(self.folds))

    def medians(self, growing, keys, stage) -> dict[tuple[int, int], float]:
        """Exact median of the residuals of every (model, leaf)."""
        todo, totals, found, most = {k: (-math.inf, math.inf) for k in keys}, {}, {}, MEDIAN_VALUES
        while todo:
            now, asked, known = self.progress(growing, stage), dict(todo), dict(totals)

            def finish(parts_of):
                for key, parts in parts_of:
                    total = known.get(key, sum(int(p[2][-1]) for p in parts if len(p[2])))  # noqa: B023
                    yield key, (total, *(_median(parts, total) if total else (None, None)))

            got = self.work.run(lambda blocks: residuals(blocks, now, asked, most), finish)  # noqa: B023
            todo, most = {}, 2 * most
            for key, (total, value, bracket) in got.items():
                totals[key] = total
                if bracket:
                    todo[key] = bracket
                elif total:
                    found[key] = value
        return found

    def note_errors(self, got: dict, alive: list[int]) -> list[int]:
        """Errors after the trees so far; models past their patience leave."""
        for key, found in got.items():
            if key[0] == "error":
                rows = sum(c for _, _, c in found)
                self.errors[key[1]].append(math.fsum(e for _, e, _ in sorted(found)) / rows if rows else math.nan)
        return [m for m in alive if not self.folds[m] or best_round(self.errors[m][1:], self.params.patience)[1] is False]

    def grow(self, alive: list[int]) -> list[int]:
        """One more tree for the models alive; returns those still alive."""
        growing: list[Tree | None] = [Tree() if m in alive else None for m in range(len(self.folds))]
        feats, known, siblings, first = self.chosen(), {}, {}, True
        while True:
            asked = [(m, n) for m in alive for n in self._best_first(known, m)[1]]
            if not asked:
                break
            got = self.splits(growing, asked, feats, first, siblings)
            if first:
                alive = self.note_errors(got, alive)
            for key in asked:
                split = got.get(key)
                known[key] = None
                if split:
                    gain, feature, cut, cats, fewer = split
                    ends = growing[key[0]].split(key[1], feature, cut, cats, gain)
                    known[key] = gain, ends
                    siblings[key[0], ends[fewer]] = key, (key[0], ends[1 - fewer])
            first = False
        self.work.forget()
        grown = [_pruned(tree, self._best_first(known, m)[0]) if m in alive else None for m, tree in enumerate(growing)]
        values = self.medians(grown, [(m, leaf) for m in alive for leaf in grown[m].leaves()], "values") if alive else {}
        for m in alive:
            for leaf in grown[m].leaves():
                grown[m].value[leaf] = self.params.step * values.get((m, leaf), 0.0)
            self.trees[m].append(grown[m])
        if alive:
            self.tail.append(grown)
            if len(self.tail) == TAIL:
                self.older.append(self.work.keep(self.tail))
                self.tail = []
                self.work.carry(self.progress([None] * len(self.folds)))
        return alive

    def _best_first(self, known: dict, m: int) -> tuple[list[int], list[int]]:
        """Nodes that best-first growth splits, as far as splits are known, and
        the nodes whose best split it has to know first.  Equal gains: the
        node made first."""
        heap, order, unknown, made = [], [], [], 0

        def reach(node):
            nonlocal made
            made += 1
            if (m, node) not in known:
                unknown.append(node)
            elif known[m, node]:
                heapq.heappush(heap, (-known[m, node][0], made, node))

        reach(0)
        while heap and len(order) + len(unknown) < self.params.leaves - 1:
            node = heapq.heappop(heap)[2]
            order.append(node)
            for end in known[m, node][1]:
                reach(end)
        return order, unknown if len(order) + 1 < self.params.leaves else []

    def results(self) -> list[tuple]:
        """Per model: fold, base, trees, errors."""
        return list(zip(self.folds, self.base, self.trees, self.errors))

    def run_all(self) -> None:
        everyone = list(range(len(self.folds)))
        nothing: list[Tree | None] = [None] * len(self.folds)
        found = self.medians(nothing, [(m, 0) for m in everyone], "base")
        self.base = [found.get((m, 0), 0.0) for m in everyone]
        self.run = uuid.uuid4().hex                            # states start anew from the bases
        alive = everyone
        for _ in range(self.params.rounds):
            alive = self.grow(alive)
            if not alive:
                break
        left = [m for m in alive if self.folds[m]]
        if left:
            blank = [Tree() if m in left else None for m in everyone]
            self.note_errors(self.splits(blank, [], self.chosen(), True, {}), left)
            self.work.forget()


def _add(a, b):
    return a + b


def _add_wide(a, b):
    return a + b if isinstance(a, list) else np.add(a, b, dtype=np.int64)


def _smaller(hist: np.ndarray, split: tuple, feats: np.ndarray, offsets: np.ndarray) -> int:
    """The side of a split that gets fewer rows (0 left, 1 right)."""
    _, feature, cut, cats = split
    j = int(np.searchsorted(feats, feature))
    rows = hist.reshape(-1, 3)[offsets[j]:offsets[j + 1]].sum(1, dtype=np.int64)
    left = rows[:cut + 1].sum() if cats is None else rows[cats].sum()
    return int(2 * left > rows.sum())


def one_task_each(rdd: RDD, bins: Binning, jobs: list[tuple[list[int], BoostParams]]) -> list[tuple]:
    """A table whose blocks are one task's: models do not need each other, so
    each (folds, settings) goes through the same loop in a task of its own."""

    def train(given):
        k, blocks = given
        trainer = _Trainer(_Here(list(blocks)), bins, *jobs[k])
        trainer.run_all()
        return k, trainer.results()

    n = len(jobs)
    dealt = rdd.flatMap(lambda block: [(k, block) for k in range(n)]).groupByKey(n, lambda k: k)
    return [r for _, found in sorted(dealt.map(train).collect(), key=lambda x: x[0]) for r in found]


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """Trees up to the lowest error so far, and whether ``patience`` trees
    without a lower one follow it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(df: DataFrame, features: list[str], categorical: list[str], target: str, row_col: str, fold_col: str,
          params: BoostParams = BoostParams(), whole: bool = True) -> dict[int, BoostedModel]:
    """Boosted models of a table with folds: per fold i the one learnt from
    the rows of earlier folds (``fold_col`` under i, or null) and stopped by
    fold i, and (``whole``) under 0 the one of all rows with all ``rounds``.

    ``row_col`` numbers the rows (unique; bags are drawn from it).  Rows
    without a target are left out, missing feature values have a bin of their
    own.  Results do not depend on how the rows are dealt to tasks."""
    spark = df.sparkSession
    ship_package(spark)
    bins = binning(df, features, categorical, params)
    blocks = store_blocks(df, bins, target, row_col, fold_col)
    folds = [r[0] for r in df.where(F.col(target).isNotNull()).groupBy(F.coalesce(F.col(fold_col), F.lit(0)).alias("f")).count().orderBy("f").collect()]
    if not folds:
        raise ValueError("no rows to learn from")
    wanted = [*(int(f) for f in folds if f), *([0] if whole or not any(folds) else [])]
    rdd, tasks = cached_blocks(spark, blocks, len(features))
    if tasks == 1:
        trained = one_task_each(rdd, bins, [([f], params) for f in wanted])
    else:
        trainer = _Trainer(_Spread(rdd, tasks), bins, wanted, params)
        try:
            trainer.run_all()
        finally:
            trainer.work.close()
            rdd.unpersist()
            for kept in trainer.older:
                kept.destroy()
        trained = trainer.results()
    out = {}
    for f, base, trees, errors in trained:
        keep = best_round(errors[1:], params.patience)[0] if f else len(trees)
        out[f] = BoostedModel(bins, base, trees[:keep], errors)
    return out


def _pruned(tree: Tree, keep: list[int]) -> Tree:
    """The tree with only the splits of the nodes ``keep``, nodes numbered in
    the order of those splits."""
    out, at = Tree(), {0: 0}
    for node in keep:
        a, b = out.split(at[node], tree.feature[node], tree.cut[node], tree.cats[node], tree.gain[node])
        at[tree.left[node]], at[tree.right[node]] = a, b
    return out
