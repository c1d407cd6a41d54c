"""Quality classifier: regularised quadratic discriminant.

A document is a vector of transformed statistics.  Each class has a mean and
a covariance shrunk towards the pooled one and towards a multiple of the unit
matrix; the score is the logistic of the difference of the two classes'
Gaussian log-densities (Mahalanobis distances by the classes' Cholesky
factors, computed once) plus the log ratio of the class shares.

Means and covariances come from per-task sums of ``x`` and ``x xT`` over all
labelled training rows, so fitting needs one pass and one row per task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.textstats import base_stats, slices
from panelcast.session import ship_package, stored

#: The vector's parts, see ``transform``.
FEATURES = ["size", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "variety",
            "line_length", "longest", "ascii"]


def transform(stats: list[int]) -> list[float]:
    """The vector of ``base_stats(text, shape=True)``; shares are taken by
    log so that many small values are told apart and a few large ones bounded."""
    (words, chars, symbols, dup, repeats, n_chars, upper, digits, punct, _, lines, distinct, longest, ascii_) = stats
    w, c = max(words, 1), max(chars, 1)

    def share(n, of, unit=0.01):
        return float(np.log1p(n / of / unit))

    return [float(np.log1p(words)), float(np.log(max(chars, 1) / w)), share(symbols, w), share(dup, max(lines, 1), 0.05),
            share(repeats, w, 0.05), share(upper, c), share(digits, c), share(punct, c), float(np.log(max(distinct, 1) / w ** 0.8)),
            float(np.log1p(w / max(lines, 1))), float(np.log1p(longest)), share(max(n_chars - ascii_, 0), c)]


def with_features(docs: DataFrame, feature_col: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its vector (array of doubles) in the place of the text,
    row by row; a null text has the vector of an empty one."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    rest = [i for i in range(len(docs.columns)) if i != at]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)

    def add(batches):
        for batch in slices(batches):
            vectors = [transform(base_stats(t.as_py(), shape=True)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(vectors, pa.list_(pa.float64()))],
                                             names=[*(batch.schema.names[i] for i in rest), feature_col])

    return docs.mapInArrow(add, f"{fields}`{feature_col}` array<double>")


def held_out_fold(doc_id: str = "doc_id"):
    """Whether crc32 of the id, as text, is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Per class: share, mean, inverse Cholesky factor, log-determinant."""

    log_share: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row."""
        if not len(x):
            return np.zeros(0)
        density = [self.log_share[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) - 0.5 * self.log_det[k]
                   for k in (0, 1)]
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(density[0] - density[1]))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, unit: float = 0.02) -> Model:
    """From each class's ``n``, sum of ``x`` and sum of ``x xT``.

    ``pooled`` and ``unit`` are the weights of the pooled covariance and of
    the unit matrix times its mean variance.  A class without rows takes the
    other's moments (and share one half); without any rows every score is
    one half."""
    d = len(FEATURES)
    n = np.array([sums[k][0] if k in sums else 0.0 for k in (0, 1)])
    total = max(n.sum(), 1.0)
    mean, cov, scatter = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros((d, d))
    for k in (0, 1):
        if n[k]:
            mean[k] = sums[k][1] / n[k]
            cov[k] = sums[k][2] / n[k] - np.outer(mean[k], mean[k])
            scatter += n[k] * cov[k]
    within = scatter / total
    for k in (0, 1):
        if not n[k]:
            mean[k], cov[k] = mean[1 - k], cov[1 - k]
    floor = max(np.trace(within) / d, 1e-3)
    whiten, log_det = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        own = (1 - pooled) * cov[k] + pooled * within
        own = (1 - unit) * own + unit * floor * np.eye(d)
        factor = np.linalg.cholesky((own + own.T) / 2)
        whiten[k] = np.linalg.inv(factor)
        log_det[k] = 2 * np.log(np.diag(factor)).sum()
    share = (n + 1) / (n.sum() + 2) if n.all() else np.array([0.5, 0.5])
    return Model(np.log(share), mean, whiten, log_det)


def class_sums(rows: DataFrame, feature_col: str, label_col: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Each class's moments over all ``rows``: every task adds up its own, and
    Spark adds those; ``2 * (1 + d + d * d)`` numbers come to the driver."""
    d = len(FEATURES)

    def partial(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                if len(own):
                    n, s, q = held.get(k, (0.0, 0.0, 0.0))
                    held[k] = (n + len(own), s + own.sum(0), q + own.T @ own)
        for k, (n, s, q) in held.items():
            yield pa.RecordBatch.from_pydict({"y": [k] * (1 + d + d * d), "i": list(range(1 + d + d * d)),
                                              "v": [float(n), *s.tolist(), *q.ravel().tolist()]},
                                             schema=pa.schema([("y", pa.int32()), ("i", pa.int32()), ("v", pa.float64())]))

    parts = rows.select(feature_col, F.col(label_col).cast("int")).mapInArrow(partial, "y int, i int, v double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():     # 2 * (1 + d + d * d) rows
        out.setdefault(r["y"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return {k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in out.items()}


def train(features: DataFrame, labels: DataFrame, feature_col: str, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Fit on the labelled rows outside the held-out fold.  Rows without a
    label of 0 or 1, or without an id, take no part; a document labelled
    several times counts once for each label."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(
        F.col("__y").isin(0, 1) & ~held_out_fold("__id"))
    rows = features.select(F.col(id_col).cast("long").alias("__id"), feature_col).join(known, "__id")
    return fit(class_sums(rows, feature_col, "__y"))


def score(features: DataFrame, model: Model, feature_col: str, score_col: str) -> DataFrame:
    """``features`` with the chance of class 1, from 0 to 1, as ``score_col``."""
    shipped = features.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    @F.pandas_udf("double")
    def chance(vectors):
        import pandas as pd

        return pd.Series(shipped.value.scores(np.concatenate([np.zeros((0, d)), *[np.asarray(v)[None] for v in vectors]])))

    return features.withColumn(score_col, chance(F.col(feature_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score.  Null and empty texts are scored
    as empty ones; rows that share an id are scored each by its own text; a
    null id is never held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = stored(with_features(rows, "features"), "quality-features")
    model = train(held, labels, "features")
    return score(held, model, "features", "score").select(
        "doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, by a model
    of the labelled rows of ``learn_from`` (``doc_id`` and ``text``).

    Every row is judged by its own text, a null one as an empty one; repeated
    rows and equal ids alike; all columns pass through, whatever their names;
    an empty table stays empty, and without labels every score is one half."""
    ship_package(docs.sparkSession)
    known = learn_from.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(with_features(known, "features"), labels, "features")      # read once: nothing to store
    at = docs.columns.index(text_col)

    def judge(batches):
        for batch in slices(batches):
            vectors = np.array([transform(base_stats(t.as_py(), shape=True)) for t in batch.column(at)], np.float64)
            yield batch.filter(pa.array(model.scores(vectors.reshape(-1, len(FEATURES))) >= threshold))

    return docs.mapInArrow(judge, docs.schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
