"""Quality rules: robust multivariate outliers by language and source.

Documents are vectors of transformed statistics.  For each language and
source, minimum-covariance-determinant estimates of location and scatter are
taken over all documents, and a document whose Mahalanobis distance from its
group's estimate is beyond a cut-off is rejected.

Estimates come from concentration steps that start at the groups' medians and
median deviations: find the distance below which the ``h`` share of a group
lies, take mean and covariance of the documents within it, and again.  Each
step is two grouped aggregations with partial sums in every task (counts by
distance class, then moments), so one group may hold any share of the rows.
Groups are keys of a table throughout; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.joins import few
from panelcast.llm.qda import fresh
from panelcast.llm.textstats import BASE, base_stats, slices
from panelcast.session import ship_package, stored

#: The vector's parts, see ``transform``; a group's spread in a part counts as
#: ``FLOORS`` of it at least, so that a part that hardly varies among clean
#: documents (no symbols, no repeats) rejects only what is plainly odd.
PARTS = ["word_length", "symbols", "repeats", "dup_lines"]
FLOORS = [0.08, 0.25, 0.35, 0.35]
SHARE = 0.75            # h: the share of a group that the estimate rests on
STEPS = 4               # concentration steps
GROUPS = 50_000         # groups whose estimates (15 numbers each) may be sent to all executors
MIN_GROUP = 50          # smaller groups are estimated with others of their language, then with all
CUTOFF = 55.0           # squared distance; far in the chi-square tail of clean documents
CLASSES = 64            # distance classes to a factor of two


def transform(stats: list[int]) -> list[float]:
    """The vector of ``base_stats(text)``."""
    words, chars, symbols, dup, repeats = stats
    w = max(words, 1)
    return [float(np.log(max(chars, 1) / w)), float(np.log1p(20 * symbols / w)), float(np.log1p(5 * repeats / w)),
            float(np.log1p(2 * dup / (w / 20 + 1)))]


def with_stats(docs: DataFrame, prefix: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts (one long column each) and the vector
    (``PARTS``, doubles), names starting with ``prefix``, in the place of the
    text, row by row."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    rest = [i for i in range(len(docs.columns)) if i != at]
    names = [prefix + n for n in [*BASE, *PARTS]]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)
    kinds = ", ".join(f"`{n}` {'long' if i < len(BASE) else 'double'}" for i, n in enumerate(names))

    def add(batches):
        for batch in slices(batches):
            stats = [base_stats(t.as_py()) for t in batch.column(at)]
            s = np.array(stats, np.int64).reshape(-1, len(BASE))
            v = np.array([transform(x) for x in stats], np.float64).reshape(-1, len(PARTS))
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *map(pa.array, s.T), *map(pa.array, v.T)],
                                             names=[*(batch.schema.names[i] for i in rest), *names])

    return docs.mapInArrow(add, f"{fields}{kinds}")


def base_failed(words: Column, repeat_words: Column) -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (words < 10) | (100 * repeat_words > 20 * words)


def group_keys(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``lang, source, key``: the group whose estimate a (language, source)
    uses: its own if that has ``min_group`` rows, or its language's small
    groups together, or all such rest together."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= min_group
    small = n.where(~own).groupBy("lang").agg(F.sum("n").alias("n_small")).withColumnRenamed("lang", "small_lang")
    keyed = n.join(small, F.col("lang").eqNullSafe(F.col("small_lang")), "left")
    text = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    by_lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    return keyed.select("lang", "source", F.when(own, text).when(F.col("n_small") >= min_group, by_lang).otherwise("all").alias("key"))


def _distance(x: list[Column], params: str = "") -> Column:
    """Squared Mahalanobis distance: the residual times the inverse Cholesky
    factor (columns ``m<i>`` and ``w<i>_<j>``), squared and summed."""
    r = [x[i] - F.col(f"{params}m{i}") for i in range(len(x))]
    rows = [reduce(Column.__add__, [F.col(f"{params}w{i}_{j}") * r[j] for j in range(i + 1)]) for i in range(len(x))]
    return reduce(Column.__add__, [v * v for v in rows])


_SCHEMA = "key string, " + ", ".join(
    [f"m{i} double" for i in range(len(PARTS))] + [f"w{i}_{j} double" for i in range(len(PARTS)) for j in range(i + 1)])


def _whitened(moments: DataFrame) -> DataFrame:
    """Estimates from each group's moments: ``n``, ``s<i>``, ``q<i>_<j>`` and
    ``grow`` (a factor on the covariance)."""
    d = len(PARTS)

    def solve(frames):
        for g in frames:
            out = []
            for r in g.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
                cov = np.array([[r[f"q{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"] - np.outer(mean, mean)
                cov = r["grow"] * (cov + cov.T) / 2 + np.diag(np.square(FLOORS))
                w = np.linalg.inv(np.linalg.cholesky(cov))
                out.append([r["key"], *mean, *[w[i, j] for i in range(d) for j in range(i + 1)]])
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _SCHEMA.split(", ")])

    return moments.mapInPandas(solve, _SCHEMA)


def _moments(rows: DataFrame, grow: float) -> DataFrame:
    x = [F.col(p) for p in PARTS]
    return rows.groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.lit(grow).alias("grow"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(len(x))],
        *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(len(x)) for j in range(i + 1)])


def _quantile_class(rows: DataFrame, value: Column, share: float) -> DataFrame:
    """Per key the class of ``value`` within which ``share`` of its rows lie;
    classes are ``CLASSES`` to a factor of two, so counts by class are all
    that is brought together."""
    cls = F.floor(F.log2(F.greatest(value, F.lit(1e-12))) * CLASSES).cast("int")
    counts = rows.groupBy("key", cls.alias("cls")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("key").orderBy("cls")
    run = counts.select("key", "cls", F.sum("n").over(up_to).alias("run"), F.sum("n").over(Window.partitionBy("key")).alias("all"))
    return run.where(F.col("run") >= F.ceil(F.col("all") * share)).groupBy("key").agg(F.min("cls").alias("cls"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations (by class) as a diagonal estimate."""
    d = len(PARTS)
    # values are moved clear of zero: all parts are from about -1 to 10
    mid = None
    for i, p in enumerate(PARTS):
        m = _quantile_class(rows, F.col(p) + 4, 0.5).select("key", (F.pow(F.lit(2.0), (F.col("cls") + 0.5) / CLASSES) - 4).alias(f"m{i}"))
        mid = m if mid is None else mid.join(m, "key")
    mid = stored(mid, "group-medians")
    spread = mid
    far = rows.join(few(mid, GROUPS), "key")
    for i, p in enumerate(PARTS):
        s = _quantile_class(far, F.abs(F.col(p) - F.col(f"m{i}")), 0.5).select(
            "key", F.pow(F.lit(2.0), (F.col("cls") + 0.5) / CLASSES).alias(f"d{i}"))
        spread = spread.join(s, "key")
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2) for i in range(d)]
    return spread.select("key", *[f"m{i}" for i in range(d)],
                         *[(1 / scale[i] if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i in range(d) for j in range(i + 1)])


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """``key`` and its estimate (``m*``, ``w*``), from all ``rows`` (``key``
    and the ``PARTS``)."""
    x = [F.col(p) for p in PARTS]
    now = stored(_start(rows), "group-estimates")
    for step in range(steps):
        at = rows.join(few(now, GROUPS), "key").select("key", *PARTS, _distance(x).alias("d2"))
        limit = _quantile_class(at, F.col("d2"), share).select("key", F.pow(F.lit(2.0), (F.col("cls") + 1.0) / CLASSES).alias("limit"))
        core = at.join(few(stored(limit, "group-limits"), GROUPS), "key").where(F.col("d2") < F.col("limit"))
        # the core of a Gaussian looks narrower than it is: the usual consistency factor for this share
        now = stored(_whitened(_moments(core, _consistency(share, len(PARTS)))), "group-estimates")
    return now


def _consistency(share: float, d: int) -> float:
    """``share / P(chi2(d + 2) <= chi2 quantile(d, share))`` for even ``d``."""
    if d % 2:
        raise ValueError("an even number of parts is needed")

    def below(q: float, k: int) -> float:
        half, term, total = q / 2, 1.0, 0.0
        for i in range(k // 2):
            total += term
            term *= half / (i + 1)
        return 1 - np.exp(-half) * total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, d) < share else (lo, mid)
    return float(share / below(lo, d + 2))


def verdicts(rows: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """``rows`` (``lang, source``, base counts and ``PARTS``; a stored table)
    with ``distance2``, ``base_failed`` and ``kept``.

    Documents that fail the base rules still belong to their groups: the
    estimate is robust against them.  Null languages and sources are groups
    like any other."""
    ship_package(rows.sparkSession)
    keys = stored(group_keys(rows, min_group), "group-keys")

    def with_key(df):
        k = few(keys, GROUPS).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "key")
        return df.join(k, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__lang", "__source")

    found = estimates(with_key(rows).select("key", *PARTS))
    names = [c for c in found.columns if c != "key"]
    at = with_key(rows).join(few(found, GROUPS), "key")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (at.withColumn("distance2", _distance([F.col(p) for p in PARTS])).drop("key", *names)
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("distance2") <= cutoff)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``distance2``,
    ``base_failed``, ``kept``.  A null text has no words and fails; rows that
    share an id are judged each by its own text; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    held = stored(with_stats(rows, ""), "text-statistics")
    return verdicts(held, cutoff).select("doc_id", *BASE, "distance2", "base_failed", "kept")


def keep_regular(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Only statistics are stored, with each row's id, text hash, language and
    source; rows alike in these have one verdict, and ``docs`` is filtered by
    the rejected ones."""
    names = ["__id", "__hash", "__lang", "__source"]
    values = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *[v.alias(n) for v, n in zip(values, names)])
    held = stored(with_stats(rows, "").withColumnsRenamed({"__lang": "lang", "__source": "source"}), "text-statistics")
    rejected = stored(verdicts(held, cutoff).where(~F.col("kept")).select("__id", "__hash", F.col("lang").alias("__lang"), F.col("source").alias("__source"))
                      .distinct(), "rejected-rows")
    own, theirs = ([fresh(docs, side + n) for n in names] for side in ("__own", "__rejected"))
    rejected = rejected.withColumnsRenamed(dict(zip(names, theirs)))
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs)])
    return (docs.withColumns(dict(zip(own, values))).join(few(rejected), same, "left_anti").select(*docs.columns))
