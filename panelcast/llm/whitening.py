"""Embedding whitening from polarised covariances.

Entries become whole numbers, so that every sum below is exact.  For each
dimension and each sum of two dimensions the squares of the centred values
are aggregated; ``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2`` gives the
rest of the covariance matrix, which alone comes to the driver for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import ship_package, stored

#: Sums leave a task as ``high * 2**LOW_BITS + low``.
LOW_BITS = 32
_SUMS = pa.schema([("place", pa.int64()), ("high", pa.decimal128(38, 0)), ("low", pa.int64())])
SUMS = "place long, high decimal(38,0), low long"
ROWS = 2048         # rows squared at a time


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with per-dimension ``sums``; ``covariance`` (divisor n) in
    the units of the whole numbers; unit ``components`` as columns, by falling
    ``variances``."""

    scale: int
    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    variances: np.ndarray
    components: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Variances above what rounding alone can leave."""
        v = self.variances
        return v > len(v) * np.finfo(float).eps * (v[0] if len(v) else 0.0)


def whole_numbers(vec: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every entry, as long (a value beyond its range
    becomes the nearest long); null for vectors that are null, empty or hold
    null or non-finite entries."""
    v = vec.cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fit, F.transform(v, lambda c: F.floor(c * scale)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _whole_rows(df: DataFrame, vec_col: str, scale: int, *others: Column) -> tuple[DataFrame, int]:
    """Rows with a usable vector ``x`` of the table's most frequent length."""
    rows = df.select(*others, whole_numbers(F.col(vec_col), scale).alias("_x")).where(F.col("_x").isNotNull())
    most = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 0
    return rows.where(F.size("_x") == dim), dim


class _Exact:
    """Running whole-number sums by place, as high and low parts."""

    def __init__(self, places: int):
        self.high, self.low = np.zeros(places, np.int64), np.zeros(places, np.int64)
        self.beyond = np.zeros(places, object)

    def add(self, at: slice, sums: np.ndarray) -> None:
        if sums.dtype == object:
            self.beyond[at] += sums
        else:
            self.high[at] += sums >> LOW_BITS
            self.low[at] += sums & ((1 << LOW_BITS) - 1)

    def batches(self, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.low), step):
            high, beyond = self.high[k:k + step], self.beyond[k:k + step]
            part = pa.array(high).cast(pa.decimal128(38, 0))
            if beyond.any():
                part = pa.array([int(b >> LOW_BITS) + int(h) for b, h in zip(beyond, high)], pa.decimal128(38, 0))
                self.low[k:k + step] += np.array([int(b) & ((1 << LOW_BITS) - 1) for b in beyond], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(high))), part, pa.array(self.low[k:k + step])], schema=_SUMS)


def _collect_sums(parts: DataFrame) -> dict[int, int]:
    rows = parts.groupBy("place").agg(F.sum("high").alias("h"), F.sum(F.col("low").cast("decimal(38,0)")).alias("l")).collect()
    return {r["place"]: (int(r["h"]) << LOW_BITS) + int(r["l"]) for r in rows}


def dimension_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of ``fit`` and the exact sum of every dimension."""

    def add(batches):
        total = _Exact(dim + 1)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total.add(slice(0, dim), (x >> LOW_BITS).sum(0).astype(object) * (1 << LOW_BITS) + (x & ((1 << LOW_BITS) - 1)).sum(0))
            total.add(slice(dim, dim + 1), np.array([len(x)]))
        yield from total.batches()

    found = _collect_sums(fit.select("_x").mapInArrow(add, SUMS))
    return found.get(dim, 0), [found.get(a, 0) for a in range(dim)]


def squares(y: np.ndarray, a: int) -> np.ndarray:
    """Exact sums over the rows of ``y_a**2`` and of ``(y_a + y_b)**2`` for all b > a."""
    both = y[:, a:] + y[:, a, None]
    both[:, 0] = y[:, a]
    if both.dtype == object:
        return (both * both).sum(0)
    return np.einsum("ij,ij->j", both, both)


def _centred(x: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """``x - mid``, as Python integers where squares of 64 bits cannot hold the sums."""
    high = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, map(int, mid)), default=0)
    return x - mid if (2 * high) ** 2 * ROWS < 1 << 62 else x.astype(object) - mid.astype(object)


def pair_squares(fit: DataFrame, dim: int, mid: np.ndarray) -> dict[int, int]:
    """Exact sums of centred squares; a dimension's place and then those of its
    sums with the later ones follow each other: ``a * dim - a * (a - 1) / 2 + b - a``."""

    def add(batches):
        total = _Exact(dim * (dim + 1) // 2)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for k in range(0, len(x), ROWS):
                y, at = _centred(x[k:k + ROWS], mid), 0
                for a in range(dim):
                    total.add(slice(at, at + dim - a), squares(y, a))
                    at += dim - a
        yield from total.batches()

    return _collect_sums(fit.select("_x").mapInArrow(add, SUMS))


def covariance(n: int, sums: list[int], mid: list[int], square: dict[int, int]) -> np.ndarray:
    """Covariances (divisor n) by polarisation, each rounded once.

    Squares are about the whole number ``mid`` next to the mean; what the mean
    lies off it is taken away exactly."""
    dim = len(sums)
    off = [s - n * m for s, m in zip(sums, mid)]
    place = [a * dim - a * (a - 1) // 2 for a in range(dim)]
    var = [n * square[place[a]] - off[a] ** 2 for a in range(dim)]          # n * n * variance
    out = np.empty((dim, dim))
    for a in range(dim):
        out[a, a] = var[a] / (n * n)
        for b in range(a + 1, dim):
            pair = n * square[place[a] + b - a] - (off[a] + off[b]) ** 2
            out[a, b] = out[b, a] = (pair - var[a] - var[b]) / (2 * n * n)
    return out


def fit(df: DataFrame, vec_col: str = "embedding", scale: int = 256) -> Whitening:
    """Whitening of the distinct vectors of ``df``, in whole numbers
    ``floor(scale * c)``.

    Vectors that are null, empty, of another length than most or hold null or
    non-finite entries are left out; repeated ones count once; without any
    vector the result has no dimension.  The driver holds the matrix of the
    dimensions, nothing that grows with the rows."""
    rows, dim = _whole_rows(df, vec_col, scale)
    return _fit(stored(rows.distinct(), "whitening-fit"), dim, scale)


def _fit(distinct: DataFrame, dim: int, scale: int) -> Whitening:
    ship_package(distinct.sparkSession)
    if not dim:
        return Whitening(scale, 0, (), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    n, sums = dimension_sums(distinct, dim)
    mid = [(2 * s + n) // (2 * n) for s in sums]
    cov = covariance(n, sums, mid, pair_squares(distinct, dim, np.array(mid, np.int64)))
    value, unit = np.linalg.eigh(cov)
    value, unit = value[::-1], unit[:, ::-1]
    unit = unit * np.where(unit[np.abs(unit).argmax(0), range(dim)] < 0, -1.0, 1.0)
    return Whitening(scale, n, tuple(sums), cov, value, unit)


def _project(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """The first ``k`` whitened components of whole-number rows (NaN where a
    component has no variance)."""
    mid = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], np.int64)
    rest = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, mid)])
    y = _centred(x, mid).astype(float) - rest
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.where(model.usable, np.sqrt(np.maximum(model.variances, 0)), np.nan)[:k]
        return (y @ model.components[:, :k]) / spread


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact ``sum((n * x - S)**2)`` of every row; null beyond 64 bits."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    z_top = model.n * top + max(map(abs, model.sums), default=0)
    if z_top ** 2 * x.shape[1] < 1 << 62:
        z = x * model.n - np.array(model.sums, np.int64)
        return (z * z).sum(1).tolist()
    z = x.astype(object) * model.n - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(1)]


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the
    identity, over the usable ones of the first ``k`` components."""
    dim, good = len(model.sums), np.flatnonzero(model.usable[:k])
    if not len(good):
        return 0.0

    def add(batches):
        square, plain, seen = np.zeros((len(good), len(good))), np.zeros(len(good)), False
        for batch in batches:
            w = _project(_matrix(batch.column(0), dim), model, k)[:, good]
            square, plain, seen = square + w.T @ w, plain + w.sum(0), True
        if seen:
            yield pa.RecordBatch.from_pydict({"place": np.arange(square.size + plain.size), "part": np.r_[square.ravel(), plain]})

    rows = distinct.select("_x").mapInArrow(add, "place long, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()
    total = np.zeros(len(good) ** 2 + len(good))
    for r in rows:
        total[r["place"]] = r["s"]
    mean = total[len(good) ** 2:] / model.n
    got = total[:len(good) ** 2].reshape(len(good), -1) / model.n - np.outer(mean, mean)
    return float(np.abs(got - np.eye(len(good))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and whiten all its rows: per row
    and component (from 1) ``<id_col>, component, n, deviation, whitened,
    explained, identity_error``.

    Left out are vectors that are null, empty, of another length than most
    (the longer one on a tie) or hold null or non-finite entries.  Repeated
    rows all return, and count once in the fit.  Vectors with fewer than ``k``
    dimensions give as many components as they have; a component without
    variance has null ``whitened``; a deviation beyond 64 bits is null.  Other
    columns are ignored, a null id stays null, an empty table gives no rows."""
    spark = df.sparkSession
    ship_package(spark)
    rows, dim = _whole_rows(df, vec_col, scale, F.col(id_col).alias("_id"))
    schema = f"_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    distinct = stored(rows.select("_x").distinct(), "whitening-fit")
    model = _fit(distinct, dim, scale)
    k = min(k, dim)
    error = identity_error(distinct, model, k)
    trace = float(np.trace(model.covariance))
    share = model.variances[:k] / trace if trace else np.full(k, np.nan)

    def out(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            w, m = _project(x, model, k), len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, m), from_pandas=True),
                pa.array(np.full(m * k, error))], names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("_id", "_x").mapInArrow(out, schema).withColumnRenamed("_id", id_col)
