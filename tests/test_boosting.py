"""Boosted trees and forest against plain versions of the same definition."""

import heapq
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.plans import boosting as bo
from panelcast.plans import forest
from panelcast.plans import training as tr
from panelcast.plans import validation as val


def panel(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.integers(0, 12))
        c = "abcdefgh"[int(rng.integers(0, 8))]
        y = 10 + 3 * (a > 0.3) + b * 0.5 + 4 * (c in "bdg") + float(rng.normal(0, 0.5))
        rows.append((i, a if i % 17 else None, b, c if i % 23 else None, round(y, 1), 0 if i < n // 3 else 1 + (i - n // 3) * 3 // (n - n // 3)))
    return spark.createDataFrame(rows, "row long, a double, b double, c string, y double, fold int")


def plain_split(codes, grad, sizes, feats, cats, p):
    """Best split of a node's rows, candidate by candidate."""
    def score(g, n, l2):
        return max(abs(g) - p.l1, 0.0) ** 2 / (n + l2)
    n, g = len(grad), grad.sum()
    best = (0.0, -1, -1, None)
    for f in feats:
        if f in cats:
            continue
        for cut in range(sizes[f]):
            left = codes[:, f] <= cut
            nl, gl = left.sum(), grad[left].sum()
            if nl < p.min_rows or n - nl < p.min_rows:
                continue
            gain = score(gl, nl, p.l2) + score(g - gl, n - nl, p.l2) - score(g, n, p.l2)
            if gain > best[0] + 1e-9 * (best[1] < 0):
                best = (gain, f, cut, None)
    for f in feats:
        if f not in cats:
            continue
        seen = sorted(set(codes[:, f].tolist()), key=lambda k: (grad[codes[:, f] == k].sum() / ((codes[:, f] == k).sum() + p.cat_smooth), k))
        back = sorted(set(codes[:, f].tolist()), key=lambda k: (-grad[codes[:, f] == k].sum() / ((codes[:, f] == k).sum() + p.cat_smooth), -k))
        for way in (seen, back):
            for m in range(1, min(p.cat_most, len(way) - 1) + 1):
                left = np.isin(codes[:, f], way[:m])
                nl, gl = left.sum(), grad[left].sum()
                if nl < p.min_rows or n - nl < p.min_rows:
                    continue
                l2 = p.l2 + p.cat_l2
                gain = score(gl, nl, l2) + score(g - gl, n - nl, l2) - score(g, n, p.l2)
                if gain > max(best[0], 1e-9) + 1e-12:
                    best = (gain, f, -1, sorted(way[:m]))
    return best if best[1] >= 0 else None


def plain_boost(codes, y, row, fold, which, sizes, cats, p):
    """One model, sequential best-first trees, medians; errors after each tree."""
    learn = fold < which if which else np.ones(len(y), bool)
    base = float(np.median(y[learn]))
    score, trees, errors = np.full(len(y), base), [], []
    valid = fold == which
    for k in range(p.rounds):
        if which:
            errors.append(np.abs(y - score)[valid].mean())
            if k and bo.best_round(errors[1:], p.patience)[1]:
                break
        rng = np.random.default_rng([p.seed, k])
        feats = sorted(rng.choice(codes.shape[1], max(1, round(p.feature_share * codes.shape[1])), replace=False).tolist())
        bag = (bo.share_of(row, p.seed, k) < p.row_share) & learn
        node, splits, made, heap = np.zeros(len(y), int), [], 1, []

        def look(n):
            rows = np.flatnonzero((node == n) & bag)
            s = plain_split(codes[rows], np.sign(score - y)[rows], sizes, feats, cats, p)
            if s:
                heapq.heappush(heap, (-s[0], n, s))
        look(0)
        while heap and len(splits) < p.leaves - 1:
            _, n, s = heapq.heappop(heap)
            splits.append((n, s))
            inside = node == n
            left = np.isin(codes[:, s[1]], s[3]) if s[3] is not None else codes[:, s[1]] <= s[2]
            node[inside & left], node[inside & ~left] = made, made + 1
            made += 2
            look(made - 2)
            look(made - 1)
        for n in np.unique(node):
            r = (y - score)[(node == n) & bag]
            if len(r):
                score[node == n] += p.step * float(np.median(r))
        trees.append(splits)
    else:
        if which:
            errors.append(np.abs(y - score)[valid].mean())
    return base, trees, errors


def test_medians_with_few_and_many_values():
    rng = np.random.default_rng(0)
    for n, values, most in ((1, 9, 4), (10, 2, 2), (1000, 2, 3), (999, 5, 2), (5000, 10 ** 6, 7), (4000, 40, 8), (64, 10 ** 6, 100)):
        tasks = [rng.integers(0, values, n).astype(float) for _ in range(5)]
        lo, hi, limit, passes = -math.inf, math.inf, most, 0
        while True:
            parts = []
            for t in tasks:
                r, c = np.unique(t[(t >= lo) & (t <= hi)], return_counts=True)
                at = np.arange(len(r)) if len(r) <= limit else np.unique(np.linspace(0, len(r) - 1, limit).astype(int))
                parts.append((int((t < lo).sum()), r[at], np.cumsum(c)[at], len(r) <= limit))
            got, bracket = bo._median(parts, 5 * n)
            if bracket is None:
                break
            (lo, hi), limit, passes = bracket, 2 * limit, passes + 1
            assert passes < 30
        assert got == np.median(np.concatenate(tasks))


@pytest.fixture(params=[(16_384, 2, 4096), (70, 1, 4096), (50, 2, 5)], ids=["one task", "many tasks", "medians in several passes"])
def dealt(request, monkeypatch):
    rows, blocks, values = request.param
    monkeypatch.setattr(bo, "BLOCK_ROWS", rows)
    monkeypatch.setattr(bo, "BLOCKS_PER_TASK", blocks)
    monkeypatch.setattr(bo, "MEDIAN_VALUES", values)


def test_all_models_equal_the_plain_booster(spark, dealt):
    df = panel(spark)
    p = bo.BoostParams(rounds=12, leaves=6, min_rows=8, patience=4, step=0.3)
    models = bo.boost(df, ["a", "b", "c"], ["c"], "y", "row", "fold", p)
    assert sorted(models) == [0, 1, 2, 3]
    rows = df.orderBy("row").collect()
    bins = models[0].binning
    import pyarrow as pa

    codes = bins.codes([pa.array([r.a for r in rows]), pa.array([r.b for r in rows]), pa.array([r.c for r in rows], pa.string())])
    assert codes[0, 0] == 0 and codes[0, 2] == 0 and codes.max(0).tolist() <= (bins.sizes - 1).tolist()
    y, row, fold = (np.array([getattr(r, c) for r in rows]) for c in ("y", "row", "fold"))
    for which, model in models.items():
        base, trees, errors = plain_boost(codes, y, row, fold, which, bins.sizes, {2}, p)
        keep = bo.best_round(errors[1:], p.patience)[0] if which else len(trees)
        assert model.base == base and np.allclose(model.errors, errors, atol=1e-12) and len(model.trees) == keep
        for tree, splits in zip(model.trees, trees):
            assert [(f, c, s) for f, c, s in zip(tree.feature, tree.cut, tree.cats) if f >= 0] == \
                [s[1:] for _, s in sorted(splits, key=lambda t: t[0])]


def test_the_work_of_a_job_follows_cores_not_rows(spark, monkeypatch):
    """Tasks (each sends a histogram per node) and what the driver gets: no
    more with more rows; the smaller sibling is counted only; predictions that
    blocks carry along change nothing."""
    df = panel(spark)
    p = bo.BoostParams(rounds=9, leaves=3, min_rows=8, step=0.3, patience=50)
    want = bo.boost(df, ["a", "b", "c"], ["c"], "y", "row", "fold", p)           # one task
    monkeypatch.setattr(bo, "BLOCK_ROWS", 10)
    monkeypatch.setattr(bo, "BLOCKS_PER_TASK", 1)
    tasks, sent, carried, counted = [], [], [], []
    cached, run, carry, grown = bo.cached_blocks, bo._Spread.run, bo._Spread.carry, bo._Spread.grown

    def spy_cached(*args):
        out = cached(*args)
        tasks.append((out[1], out[0].getNumPartitions()))
        return out

    def spy_run(self, *args):
        out = run(self, *args)
        sent.extend(out.values())
        return out

    def spy_carry(self, now):
        carry(self, now)
        carried.append(self.rdd is not self.stored)

    def spy_grown(self, emit, pairs, *args):
        out = grown(self, emit, pairs, *args)
        counted.append((len(pairs), sum(1 for k in out if k[0] != "error" and k[1])))
        return out

    monkeypatch.setattr(bo, "MEMO_BYTES", 0)
    monkeypatch.setattr(bo, "cached_blocks", spy_cached)
    monkeypatch.setattr(bo._Spread, "run", spy_run)
    monkeypatch.setattr(bo._Spread, "carry", spy_carry)
    monkeypatch.setattr(bo._Spread, "grown", spy_grown)
    got = bo.boost(df, ["a", "b", "c"], ["c"], "y", "row", "fold", p)
    assert tasks == [(spark.sparkContext.defaultParallelism,) * 2]
    assert all(len(v) == 3 and not isinstance(v[1], (list, np.ndarray)) for v in sent)        # a median, not residuals
    assert carried == [True]
    assert all(2 * pairs == ends for pairs, ends in counted) and any(pairs for pairs, _ in counted)
    for k in want:
        assert got[k].trees == want[k].trees and got[k].base == want[k].base and np.allclose(got[k].errors, want[k].errors)


def test_patience_is_state_and_keeps_the_best(spark):
    p = bo.BoostParams(rounds=40, leaves=8, min_rows=5, patience=3, step=0.9)
    models = bo.boost(panel(spark, 300), ["a", "b", "c"], ["c"], "y", "row", "fold", p)
    for i in (1, 2, 3):
        best, over = bo.best_round(models[i].errors[1:], 3)
        assert len(models[i].trees) == best and (over or len(models[i].errors) == 41)
    assert any(bo.best_round(models[i].errors[1:], 3)[1] for i in (1, 2, 3)) and len(models[0].trees) == 40


def test_predictions_saved_models_and_odd_rows(spark, tmp_path):
    df = panel(spark, 300)
    models = bo.boost(df, ["a", "b", "c"], ["c"], "y", "row", "fold", bo.BoostParams(rounds=5, leaves=5))
    odd = df.limit(5).union(spark.createDataFrame([(900, None, None, None, None, 0), (901, float("nan"), float("inf"), "new", 1.0, 0)], df.schema))
    got = models[0].transform(odd).collect()
    assert len(got) == 7 and all(r.prediction is not None for r in got)
    models[0].save(spark, str(tmp_path / "m"))
    again = bo.BoostedModel.load(spark, str(tmp_path / "m"))
    assert again == models[0] and [r.prediction for r in again.transform(odd).collect()] == [r.prediction for r in got]
    assert math.isclose(sum(models[0].importances()), 1) and math.isclose(sum(models[0].importances("gain")), 1)
    assert models[0].transform(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bo.boost(df.limit(0), ["a"], [], "y", "row", "fold")


def test_category_sets_do_not_follow_key_cardinality(spark):
    rows = [(i, f"k{i % 700:03d}", float((i % 700) % 2) * 10, 0) for i in range(14_000)]
    df = spark.createDataFrame(rows, "row long, k string, y double, fold int")
    p = bo.BoostParams(rounds=1, leaves=31, feature_share=1.0, row_share=1.0, step=1.0, cat_most=700)
    model = bo.boost(df, ["k"], ["k"], "y", "row", "fold", p)[0]
    bad = model.transform(df).where("abs(prediction - y) > 1e-9").count()
    assert bad == 0                                        # one split by gradient parts odd from even keys


def plain_forest(x, y, c, h, trees, seed):
    """Node by node, cut by cut."""
    k = x.shape[1]
    total = np.zeros(k)
    for t in range(trees):
        w = forest.bootstrap(h, c, seed, t)
        gains, todo = np.zeros(k), [(np.flatnonzero(w > 0), np.array([t + 1], np.uint64))]
        while todo:
            rows, name = todo.pop()
            yy, ww = y[rows], w[rows]
            if yy.min() == yy.max():
                continue
            best = {}
            for f in range(k):
                values = np.unique(x[rows, f])
                found = []
                for v in values[:-1]:
                    a = x[rows, f] <= v
                    s, n = (ww * yy)[a].sum(), ww[a].sum()
                    found.append((s * s / n + ((ww * yy).sum() - s) ** 2 / (ww.sum() - n) - (ww * yy).sum() ** 2 / ww.sum(), v))
                if found:
                    top = max(g for g, _ in found)
                    best[f] = next((g, v) for g, v in found if g >= top - 1e-9 * abs(top))
            if not best:
                continue
            top = max(g for g, _ in best.values())
            rank = forest._rank(name, seed, k)[:, 0]
            f = min((f for f in best if best[f][0] >= top - 1e-9 * abs(top)), key=lambda f: rank[f])
            gains[f] += max(best[f][0], 0)
            a = x[rows, f] <= best[f][1]
            todo += [(rows[a], forest._child(name, 0)), (rows[~a], forest._child(name, 1))]
        if gains.sum():
            total += gains / gains.sum()
    return total / trees


def forest_frame(spark, n=400):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    y = np.round(x[:, 0] + 3 * (x[:, 1] > 0) + rng.normal(0, 0.3, n), 1)
    rows = [(*map(float, v), float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(rows + rows[:30], "a double, b double, c double, y double")


def test_forest_equals_the_plain_one(spark):
    df = forest_frame(spark)
    got = {r.feature: r.importance for r in forest.importances(df, ["a", "b", "c"], "y", trees=7).collect()}
    rows = df.groupBy("y", "a", "b", "c").agg(F.count("*").alias("n")).select("*", F.xxhash64("y", "a", "b", "c").alias("h")).collect()
    x = np.array([[r.a, r.b, r.c] for r in rows])
    want = plain_forest(x, np.array([r.y for r in rows]), np.array([r.n for r in rows]), np.array([r.h for r in rows]), 7, 42)
    assert np.allclose([got[f] for f in "abc"], want, atol=1e-9) and math.isclose(sum(got.values()), 1)
    again = {r.feature: r.importance for r in forest.importances(df.repartition(7), ["a", "b", "c"], "y", trees=7).collect()}
    assert all(math.isclose(again[f], got[f], rel_tol=1e-12) for f in got)
    # nodes that do not fit a task: with a candidate cut per value the upper levels choose the same cuts
    large = {r.feature: r.importance for r in forest.importances(df, ["a", "b", "c"], "y", trees=7, fit_rows=60).collect()}
    assert all(math.isclose(large[f], got[f], rel_tol=1e-9) for f in got)


def test_forest_on_odd_tables(spark):
    df = forest_frame(spark, 30)
    assert forest.importances(df.limit(0), ["a"], "y", 3).collect() == []
    assert forest.importances(df.withColumn("y", F.lit(1.0)), ["a", "b"], "y", 3).collect() == []
    assert forest.importances(df.withColumn("a", F.lit(1.0)), ["a"], "y", 3).collect() == []
    w = forest.bootstrap(np.arange(200_000), np.full(200_000, 1), 1, 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(forest.bootstrap(np.arange(2000), np.full(2000, 900), 1, 0).mean() - 900) < 3


def test_training_queries_on_their_registered_settings(spark):
    """The registered queries, fitted for real on the smallest panel that has
    long enough series: out-of-fold rows, folds, forecasts and registry."""
    from panelcast.plans import q_train

    sf = "/root/testdata/sf0.01"
    cv = {r.fold: r for r in q_train.train_cv_metrics(spark, sf).collect()}
    oof = q_train.oof_predictions(spark, sf)
    assert set(cv) == {0, 1, 2, 3, 4, 5}
    again = val.fold_metrics(oof, "sales", "prediction", "fold").collect()
    for r in again:
        assert math.isclose(r.mae, cv[r.fold].mae, abs_tol=1e-4) and r.n == cv[r.fold].n
    assert Counter(r.fold for r in oof.select("fold").collect()) == {i: cv[i].n for i in range(1, 6)}
    f = q_train.forecast_90d(spark, sf)
    assert f.count() == 30 * 90 and f.where("forecast < 0 or forecast is null").count() == 0
    imp = q_train.top_importances(spark, sf).collect()
    assert len(imp) == 20 and sum(r.importance for r in imp) <= 1 + 1e-6
    assert tr.model_input_columns(q_train.trained(spark, sf)[0].model) == sorted(tr.model_input_columns(q_train.trained(spark, sf)[0].model))


def test_search_scores_equal_separate_fits(spark):
    """Every candidate's error by fold against a fit of its own rows."""
    from panelcast.plans import search

    rng = np.random.default_rng(8)
    x = rng.normal(size=(360, 3)) * [1, 10, 0.1] + [5, -100, 3]
    y = x @ [2, 0.3, 0] + rng.normal(size=360)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double")
    grids = {"line": {"reg": [0.0, 0.05, 0.5, 1.0, 2.0, 4.0], "l1_share": [0.0, 0.3, 0.6, 1.0]}, "tree": {"leaves": [2, 4, 8], "min_rows": [5, 20]}}
    results, cv = search.random_search(spark, df, ["a", "b", "c"], "y", {"line": "elastic_net", "tree": "tree"}, grids, ["i"], n_iter=20)
    got = cv.collect()
    line = [r for r in got if r.model == "line"]
    assert len(line) == 20 and len(got) == 26 and [r.rank for r in line] == list(range(1, 21))     # the draw happens
    import json

    start = 360 - 5 * 60
    for r in line:
        p = json.loads(r.params)
        for fold in range(1, 6):
            n = start + (fold - 1) * 60
            mu, sd = x[:n].mean(0), x[:n].std(0)
            z, t = (x[:n] - mu) / sd, y[:n] - y[:n].mean()
            w = np.zeros(3)
            for _ in range(3000):                       # proximal gradient, another way to the same minimum
                g = z.T @ (z @ w - t) / n + p["reg"] * (1 - p["l1_share"]) * w
                s = w - g / 8
                w = np.sign(s) * np.maximum(np.abs(s) - p["reg"] * p["l1_share"] / 8, 0)
            v = slice(n, n + 60)
            mae = np.abs(y[v] - ((x[v] - mu) / sd @ w + y[:n].mean())).mean()
            assert math.isclose(mae, r.split_mae[fold - 1], rel_tol=1e-6)
    best = results["line"]
    pred = best["best_model"].transform(df.where("a is not null")).orderBy("i").toPandas()["prediction"].to_numpy()
    assert math.isclose(np.abs(pred - y).mean(), best["MAE"], rel_tol=1e-9)
    tree = next(r for r in got if r.model == "tree" and r.rank == 1)
    folded = val.time_series_folds(df.na.drop(), ["i"], 5)
    p = json.loads(tree.params)
    alone = bo.boost(folded, ["a", "b", "c"], [], "y", "row_index", "val_fold",
                     bo.BoostParams(rounds=1, step=1.0, row_share=1.0, feature_share=1.0, l1=0.0, l2=0.0, **p))
    assert np.allclose([alone[i].errors[1] for i in range(1, 6)], tree.split_mae)
    assert math.isclose(sum(results["tree"]["feature_importances"]), 1)
