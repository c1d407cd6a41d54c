"""Seeded random search over time-ordered folds without a fit per candidate
and fold (L11-L13).

Linear models: cross products of a block of rows (the rows that one fold
validates) add up, so one pass over the table gives the Gram matrix of every
fold's training rows as a prefix sum.  Scaling (mean, population standard
deviation of the training rows) and the elastic net of every candidate are
solved from it by coordinate descent; one more pass scores all candidates.

Trees: all candidates and folds grow over the same binned blocks
(:mod:`panelcast.plans.boosting`), each a single tree of absolute loss.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans import boosting as bo
from panelcast.session import ship_package, stored

GRAM = "block int, i int, j int, value double"


def draw(grid: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """All combinations of a grid, or a seeded draw of ``n_iter`` of them."""
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(combos, n_iter) if len(combos) > n_iter else combos


# ------------------------------------------------------------------ linear


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)


def block_grams(rows: DataFrame, features: list[str], target: str, block: str) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Centre of all columns (features, then target), and per block the cross
    products of (1, columns - centre)."""
    ship_package(rows.sparkSession)
    cols = [*features, target]
    k = len(cols)
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch) - centre])
            for b in np.unique(which):
                part = x[which == b]
                total[int(b)] = total.get(int(b), 0) + part.T @ part
        i, j = np.indices((k + 1, k + 1))
        for b, m in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(m.size, b), pa.int32()), "i": pa.array(i.ravel(), pa.int32()),
                                              "j": pa.array(j.ravel(), pa.int32()), "value": m.ravel()})

    found = (rows.select(F.coalesce(F.col(block), F.lit(0)).cast("int").alias("b"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
             .mapInArrow(products, GRAM).groupBy("block", "i", "j").agg(F.sum("value").alias("value")).collect())
    grams: dict[int, np.ndarray] = {}
    for r in found:
        grams.setdefault(r["block"], np.zeros((k + 1, k + 1)))[r["i"], r["j"]] = r["value"]
    return centre, grams


def elastic_net(gram: np.ndarray, centre: np.ndarray, reg: float, l1_share: float, tol: float = 1e-10, most: int = 10_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept, in the columns' own units, of
    ``|y - Xw|^2 / 2n + reg * (l1_share * |w|_1 + (1 - l1_share) / 2 * |w|_2^2)``
    over features scaled by mean and population deviation (a constant one by 1)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(centre[:-1] + mean[:-1]))] = 1.0
    a, b = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    if reg == 0:
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    else:
        w = np.zeros(len(b))
        for _ in range(most):
            step = 0.0
            for j in range(len(w)):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(rest) * max(abs(rest) - reg * l1_share, 0.0) / (a[j, j] + reg * (1 - l1_share)) if a[j, j] + reg * (1 - l1_share) > 0 else 0.0
                step, w[j] = max(step, abs(new - w[j])), new
            if step <= tol * max(1.0, np.abs(w).max(initial=0.0)):
                break
    coef = w / scale
    return coef, float(centre[-1] + mean[-1] - coef @ (centre[:-1] + mean[:-1]))


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        terms = [F.lit(float(c)) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients)]
        return df.withColumn(output, sum(terms, F.lit(float(self.intercept))))


def training_grams(grams: dict[int, np.ndarray], folds: list[int]) -> dict[int, np.ndarray]:
    """Per fold the sum over the blocks before it; 0: over all."""
    out = {f: sum(g for b, g in grams.items() if b < f) for f in folds}
    out[0] = sum(grams.values())
    return out


def linear_errors(rows: DataFrame, features: list[str], target: str, block: str, fits: dict[int, list[tuple[np.ndarray, float]]]) -> dict[int, list[float]]:
    """Mean absolute error of every fold's fits on the rows it validates, in one pass."""
    ship_package(rows.sparkSession)
    weights = {f: (np.column_stack([c for c, _ in ms]), np.array([i for _, i in ms])) for f, ms in fits.items()}

    def errors(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            which, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch)
            for f, (w, i) in weights.items():
                part = x[which == f]
                if len(part):
                    e = np.abs(part[:, -1:] - part[:, :-1] @ w - i).sum(0)
                    total[f] = total.get(f, 0) + np.append(e, len(part))
        for f, e in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([f] * len(e), pa.int32()), "i": pa.array(range(len(e)), pa.int32()),
                                              "j": pa.array([0] * len(e), pa.int32()), "value": e})

    cols = [*features, target]
    found = (rows.where(F.col(block).isNotNull()).select(F.col(block).cast("int").alias("b"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
             .mapInArrow(errors, GRAM).groupBy("block", "i").agg(F.sum("value").alias("value")).collect())
    out = {f: [0.0] * (len(ms) + 1) for f, ms in fits.items()}
    for r in found:
        out[r["block"]][r["i"]] = r["value"]
    return {f: [e / v[-1] if v[-1] else float("nan") for e in v[:-1]] for f, v in out.items()}


def search_linear(rows: DataFrame, features: list[str], target: str, block: str, folds: list[int], combos: list[dict]):
    """Errors by candidate and fold, and a function that fits a candidate on all rows."""
    centre, grams = block_grams(rows, features, target, block)
    train = training_grams(grams, folds)
    fits = {f: [elastic_net(train[f], centre, c.get("reg", 0.0), c.get("l1_share", 0.0)) for c in combos] for f in folds}
    errors = linear_errors(rows, features, target, block, fits)

    def final(params):
        coef, intercept = elastic_net(train[0], centre, params.get("reg", 0.0), params.get("l1_share", 0.0))
        return LinearModel(list(features), coef.tolist(), intercept)

    return [[errors[f][i] for f in folds] for i in range(len(combos))], final


# ------------------------------------------------------------------ trees


def search_trees(rows: DataFrame, features: list[str], target: str, block: str, folds: list[int], combos: list[dict], seed: int):
    """As :func:`search_linear`, for single trees (``leaves``, ``min_rows``, ...)."""
    spark = rows.sparkSession
    ship_package(spark)
    base = bo.BoostParams(rounds=1, step=1.0, row_share=1.0, feature_share=1.0, seed=seed, l1=0.0, l2=0.0)
    params = [replace(base, **c) for c in combos]
    bins = bo.binning(rows, list(features), [], base)
    rdd, tasks = bo.cached_blocks(spark, bo.store_blocks(rows, bins, target, "row_index", block), len(features))
    try:
        if tasks == 1:
            trained = bo.one_task_each(rdd, bins, [([*folds, 0], p) for p in params])       # a copy of the rows per candidate
        else:
            trained = []
            for p in params:
                trainer = bo._Trainer(bo._Spread(rdd, tasks), bins, [*folds, 0], p)
                try:
                    trainer.run_all()
                finally:
                    trainer.work.close()
                trained += trainer.results()
    finally:
        rdd.unpersist()
    each = [trained[i:i + len(folds) + 1] for i in range(0, len(trained), len(folds) + 1)]

    def final(chosen):
        _, start, trees, _ = each[combos.index(chosen)][-1]
        return bo.BoostedModel(bins, start, trees)

    return [[errors[1] for _, _, _, errors in ms[:-1]] for ms in each], final


FAMILIES = {"elastic_net": lambda *a: search_linear(*a[:-1]), "tree": search_trees}


def random_search(spark: SparkSession, df: DataFrame, features, target: str, models: dict[str, str], grids: dict, order_cols,
                  n_iter: int = 20, cv_splits: int = 5, seed: int = 42):
    """Randomised search (L12, L13): per named family ``n_iter`` drawn
    candidates, mean absolute error over time-ordered folds, the best refitted
    on all rows with its in-sample MAE, RMSE and MAPE.  Returns (results dict,
    table of candidates).

    Rows with a null or NaN feature or target are left out."""
    from panelcast.plans import validation as val

    features = list(features)
    clean = df.na.drop(subset=[*features, target])
    folded = stored(val.time_series_folds(clean, order_cols, cv_splits).select(*df.columns, "row_index", "val_fold"), "search-folds")
    folds = list(range(1, cv_splits + 1))
    results, table = {}, []
    for name, family in models.items():
        combos = draw(grids.get(name, {}), n_iter, seed)
        by_split, final = FAMILIES[family](folded, features, target, "val_fold", folds, combos, seed)
        scores = [float(np.mean(s)) for s in by_split]
        ranked = sorted(range(len(combos)), key=lambda j: scores[j])
        import json

        for rank, j in enumerate(ranked, start=1):
            table.append((name, json.dumps(combos[j], sort_keys=True), scores[j], float(np.std(by_split[j])), [float(v) for v in by_split[j]], rank))
        best = combos[ranked[0]]
        model = final(best)
        m = val.metrics(model.transform(folded), target, "prediction").first()
        results[name] = {"best_model": model, "best_params": best, "MAE": float(m["mae"]), "RMSE": float(m["rmse"]), "MAPE": float(m["mape"])}
        if isinstance(model, bo.BoostedModel):
            results[name]["feature_importances"] = model.importances("gain")
    cv = spark.createDataFrame(table, "model STRING, params STRING, mean_mae DOUBLE, std_mae DOUBLE, split_mae ARRAY<DOUBLE>, rank INT")
    return results, cv
