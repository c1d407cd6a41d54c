"""Random-forest importances with trees of unlimited depth.

A node with many rows is split level by level: tasks give sums by feature and
bin, and the best candidate cut is found per (tree, node).  As soon as a node's
rows fit a task they go there together, packed, and the task grows the whole subtree
over exact values until targets are equal or no feature separates them.

Bootstrap weights are drawn from a hash of the row's content, so that they
depend neither on partitions nor on a retried task; equal rows are one row
with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.plans.boosting import Tree, share_of
from panelcast.session import ship_package, stored

#: Rows of a node that one task may finish.
FIT_ROWS = 262_144
#: Candidate cuts of a feature in nodes beyond that.
CUTS = 254
#: Trees that are worked on at once (each is a copy of two thirds of the rows).
AT_ONCE = 25

_TIE = 1e-9
GAINS = "tree int, feature int, gain double"
FOUND = "tree int, node int, size long, feature int, cut double, left long, right long, gain double"


def bootstrap(ident: np.ndarray, count: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row (``count`` equal ones) is drawn: Poisson(count)."""
    u = share_of(ident, seed, tree)
    out = np.zeros(len(u))
    big = count > 500
    mean = count[~big].astype(float)
    p = np.exp(-mean)
    total, k, left = p.copy(), np.zeros(len(mean)), u[~big] >= p
    while left.any():
        k[left] += 1
        p[left] *= mean[left] / k[left]
        total[left] += p[left]
        left &= (u[~big] >= total) & (p > 0)
    out[~big] = k
    if big.any():
        from statistics import NormalDist

        z = np.array([NormalDist().inv_cdf(min(max(v, 1e-15), 1 - 1e-15)) for v in u[big]])
        out[big] = np.maximum(np.rint(count[big] + np.sqrt(count[big]) * z), 0)
    return out


def _child(ident: np.ndarray, right: int) -> np.ndarray:
    """Name of a node's child; names seed the order in which equal gains win."""
    return ident * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1 + right)


def _rank(ident: np.ndarray, seed: int, n_features: int) -> np.ndarray:
    """A random number per node name and feature."""
    return np.stack([share_of(ident, seed, 1_000_003 + f) for f in range(n_features)])


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int, root: int) -> np.ndarray:
    """Impurity decrease by feature of a tree grown to the end, a level at a
    time.  Of cuts with equal gain in a feature the lowest wins, of features
    with equal gain the one that the node's name draws."""
    n, k = x.shape
    gains = np.zeros(k)
    node, names = np.zeros(n, np.int64), np.array([root], np.uint64)
    orders = [np.argsort(x[:, f], kind="stable") for f in range(k)]
    wy = w * y
    while len(names):
        # rows of nodes that may still be split, by node then value
        starts_of = np.bincount(node[orders[0]], minlength=len(names))
        first = np.concatenate([[0], np.cumsum(starts_of)[:-1]])
        by_node = orders[0][np.argsort(node[orders[0]], kind="stable")]
        low, high = np.minimum.reduceat(y[by_node], first), np.maximum.reduceat(y[by_node], first)
        weight, total = np.add.reduceat(w[by_node], first), np.add.reduceat(wy[by_node], first)
        best = np.full((k, len(names)), -np.inf)
        cut = np.zeros((k, len(names)))
        for f in range(k):
            rows = orders[f][np.argsort(node[orders[f]], kind="stable")]
            nd, v = node[rows], x[rows, f]
            cw, cs = np.cumsum(w[rows]), np.cumsum(wy[rows])
            lw = cw - np.concatenate([[0.0], cw])[first][nd]
            ls = cs - np.concatenate([[0.0], cs])[first][nd]
            ok = np.zeros(len(rows), bool)
            ok[:-1] = (nd[:-1] == nd[1:]) & (v[:-1] < v[1:])
            rw = weight[nd] - lw
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(ok, ls * ls / lw + (total[nd] - ls) ** 2 / rw - (total * total / weight)[nd], -np.inf)
            top = np.maximum.reduceat(g, first)
            near = ok & (g >= top[nd] - _TIE * np.maximum(np.abs(top[nd]), 1e-300))
            spot = np.flatnonzero(near)
            owner, at = np.unique(nd[spot], return_index=True)
            best[f, owner], cut[f, owner] = g[spot[at]], v[spot[at]]
            orders[f] = rows
        top = best.max(0)
        good = (low < high) & np.isfinite(top)
        rank = np.where(best >= top - _TIE * np.maximum(np.abs(top), 1e-300), _rank(names, seed, k), 2.0)
        pick = rank.argmin(0)
        np.add.at(gains, pick[good], np.maximum(best[pick, np.arange(len(names))][good], 0.0))
        place = np.cumsum(good) - 1
        live = good[node]
        goes_right = x[np.arange(n), pick[node]] > cut[pick[node], node]
        new = 2 * place[node] + goes_right
        node = np.where(live, new, -1)
        names = np.stack([_child(names[good], 0), _child(names[good], 1)], axis=1).ravel()
        orders = [o[live[o]] for o in orders]
    return gains


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    y, c, h, *f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
    return y, c, h, np.stack(f, axis=1) if f else np.zeros((len(y), 0))


def _node_of(top: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of the upper tree that each row is in (cuts are values here)."""
    node = np.zeros(len(x), np.int64)
    left, right = np.array(top.left), np.array(top.right)
    feature, cut = np.array(top.feature), np.array(top.cut, float)
    while True:
        open_ = np.flatnonzero(left[node] >= 0)
        if not len(open_):
            return node
        at = node[open_]
        node[open_] = np.where(x[open_, feature[at]] <= cut[at], left[at], right[at])


def _upper(rows: DataFrame, k: int, trees: list[int], seed: int, fit_rows: int) -> tuple[dict[int, Tree], dict[int, dict[int, int]], list]:
    """The part of each tree whose nodes do not fit a task, the names of its
    nodes, and (tree, feature, gain) of its splits."""
    tops = {t: Tree() for t in trees}
    names = {t: {0: t + 1} for t in trees}
    gains: list[tuple[int, int, float]] = []
    if rows.limit(fit_rows + 1).count() <= fit_rows:
        return tops, names, gains
    row = rows.agg(*[F.percentile_approx(f"_f{f}", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias(f"q{f}") for f in range(k)],
                   *[F.max(f"_f{f}").alias(f"m{f}") for f in range(k)]).first()
    cuts = [np.array(sorted({v for v in row[f"q{f}"] if v < row[f"m{f}"]})) for f in range(k)]
    widths = np.array([len(c) + 1 for c in cuts])
    ends = np.concatenate([[0], np.cumsum(widths)])
    open_ = {(t, 0) for t in trees}
    while open_:
        asked = sorted(open_)

        def sums(batches, asked=asked):
            total: dict = {}
            for batch in batches:
                y, c, h, x = _columns(batch)
                codes = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(k)], axis=1) + ends[:-1]
                for t in sorted({t for t, _ in asked}):
                    w, node = bootstrap(h, c, seed, t), _node_of(tops[t], x)
                    for n in [n for a, n in asked if a == t]:
                        rows_in = np.flatnonzero((w > 0) & (node == n))
                        at = codes[rows_in].ravel()
                        part = np.stack([np.bincount(at, np.repeat(v[rows_in], k), ends[-1]) for v in (np.ones(len(w)), w, w * y)])
                        lo, hi = x[rows_in].min(0, initial=np.inf), x[rows_in].max(0, initial=-np.inf)
                        old = total.get((t, n))
                        total[t, n] = (part, lo, hi, x[rows_in].sum(0)) if old is None else (
                            old[0] + part, np.minimum(old[1], lo), np.maximum(old[2], hi), old[3] + x[rows_in].sum(0))
            for (t, n), (part, *rest) in total.items():
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()),
                                                  "sums": [part.tobytes()], "spans": [np.stack(rest).tobytes()]})

        def choose(key, table):
            t, n = key[0].as_py(), key[1].as_py()
            count, w, s = sum(np.frombuffer(b.as_py()).reshape(3, -1) for b in table["sums"])
            spans = [np.frombuffer(b.as_py()).reshape(3, k) for b in table["spans"]]
            size, weight, total = count[:ends[1]].sum(), w[:ends[1]].sum(), s[:ends[1]].sum()
            best = np.full(k, -np.inf)
            at = np.zeros(k, np.int64)
            for f in range(k):
                part = slice(ends[f], ends[f + 1])
                lc, lw, ls = np.cumsum(count[part])[:-1], np.cumsum(w[part])[:-1], np.cumsum(s[part])[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where((lc > 0) & (lc < size), ls * ls / lw + (total - ls) ** 2 / (weight - lw) - total * total / weight, -np.inf)
                if len(g):
                    at[f] = np.argmax(g >= g.max() - _TIE * max(abs(g.max()), 1e-300))
                    best[f] = g[at[f]]
            top, name = best.max(), np.array([names[t][n]], np.uint64)
            rank = _rank(name, seed, k)[:, 0]
            if np.isfinite(top):
                f = int(np.where(best >= top - _TIE * max(abs(top), 1e-300), rank, 2.0).argmin())
                left, cut, gain = count[ends[f]:ends[f] + at[f] + 1].sum(), cuts[f][at[f]], max(best[f], 0.0)
            else:       # no candidate parts the node: cut a feature that varies at its mean; sizes are looked at next
                low, high = np.min([p[0] for p in spans], 0), np.max([p[1] for p in spans], 0)
                f = int(np.where(low < high, rank, 2.0).argmin())
                cut, gain, left = sum(p[2] for p in spans)[f] / size, 0.0, size
                f, cut = (f, cut if low[f] <= cut < high[f] else low[f]) if low[f] < high[f] else (-1, 0.0)
            return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()), "size": [int(size)], "feature": pa.array([f], pa.int32()),
                             "cut": [float(cut)], "left": [int(left)], "right": [int(size - left) if np.isfinite(top) else int(size)], "gain": [float(gain)]})

        got = rows.mapInArrow(sums, "tree int, node int, sums binary, spans binary").groupBy("tree", "node").applyInArrow(choose, FOUND).collect()
        open_ = set()
        for r in got:
            if r["size"] <= fit_rows or r["feature"] < 0:
                continue
            a, b = tops[r["tree"]].split(r["node"], r["feature"], r["cut"], None, r["gain"])
            name = np.array([names[r["tree"]][r["node"]]], np.uint64)
            names[r["tree"]][a], names[r["tree"]][b] = int(_child(name, 0)[0]), int(_child(name, 1)[0])
            gains.append((r["tree"], r["feature"], r["gain"]))
            open_ |= {(r["tree"], end) for end, size in ((a, r["left"]), (b, r["right"])) if size > fit_rows}
    return tops, names, gains


def importances(df: DataFrame, features: list[str], target: str, trees: int = 100, seed: int = 42, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``feature, importance`` of a forest of ``trees`` regression trees over
    all features: mean over the trees of the shares in their decrease of squared error.

    Rows with a null or NaN feature or target are left out; an empty table, a
    constant target or constant features give no rows."""
    spark = df.sparkSession
    ship_package(spark)
    k = len(features)
    rows = df.select(F.col(target).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)))
    cols = rows.columns
    rows = rows.where(~F.greatest(*[F.coalesce(F.isnan(c), F.lit(True)) | F.col(c).isNull() for c in cols], F.lit(False)))
    rows = stored(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")).select(
        "_y", "_c", F.xxhash64(*cols).alias("_h"), *(f"_f{i}" for i in range(k))), "forest-rows")
    parts = []
    for at in range(0, trees, AT_ONCE):
        now = list(range(at, min(at + AT_ONCE, trees)))
        tops, names, gains = _upper(rows, k, now, seed, fit_rows)

        def deal(batches, now=now, tops=tops):
            for batch in batches:
                y, c, h, x = _columns(batch)
                for t in now:
                    w = bootstrap(h, c, seed, t)
                    drawn = np.flatnonzero(w > 0)
                    node = _node_of(tops[t], x[drawn])
                    for n in np.unique(node):
                        r = drawn[node == n]
                        packed = np.column_stack([h[r].view(float), y[r], w[r], x[r]])
                        yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()), "rows": [packed.tobytes()]})

        def finish(key, table):
            t, n = key[0].as_py(), key[1].as_py()
            m = np.concatenate([np.frombuffer(b.as_py()).reshape(-1, k + 3) for b in table["rows"]])
            m = m[np.lexsort((*m.T[3:], m[:, 1], np.ascontiguousarray(m[:, 0]).view(np.int64)))]
            g = grow(np.ascontiguousarray(m[:, 3:]), m[:, 1].copy(), m[:, 2].copy(), seed, names[t][n])  # noqa: B023
            return pa.table({"tree": pa.array([t] * k, pa.int32()), "feature": pa.array(range(k), pa.int32()), "gain": g})

        parts.append(stored(rows.mapInArrow(deal, "tree int, node int, rows binary").groupBy("tree", "node").applyInArrow(finish, GAINS), "forest-gains"))
        if gains:
            parts.append(spark.createDataFrame(gains, GAINS))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by_tree = stored(found.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")), "forest-sums")
    whole = by_tree.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
    n = whole.count()
    name = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1)
    return (by_tree.join(whole, "tree").groupBy("feature").agg((F.sum(F.col("gain") / F.col("total")) / F.lit(n or 1)).alias("importance"))
            .select(name.alias("feature"), "importance"))
