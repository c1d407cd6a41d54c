"""Operators 7 and 10."""

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, texts_of

import __spark_entry__ as entry
from panelcast.llm import mcd, qda, textstats


def plain_stats(text):
    """The base counts by their definition."""
    raw = (text or "").encode()
    words = raw.split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit)]


def test_base_stats_by_definition(spark, edge):
    texts = [t for _, t in texts_of(edge)] + [t for _, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    texts += [" ".join(map(str, np.random.default_rng(k).integers(0, 3, 200))) for k in range(20)]
    texts.append(" ".join(str(i) for i in range(9000)) + " " + " ".join(str(i) for i in range(50)))
    for t in texts:
        assert textstats.base_stats(t) == plain_stats(t)


def test_rules_on_odd_rows(edge, empty):
    rows = mcd.quality_rules(edge).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = Counter()
    for i, t in texts_of(edge):
        s = plain_stats(t)
        want[(i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])] += 1
    assert got == want
    assert all(not r.kept for r in rows if r.base_failed)
    assert mcd.quality_rules(empty).collect() == [] and mcd.keep_regular(empty).columns == empty.columns
    kept = mcd.keep_regular(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)


def plain_estimate(x, share=mcd.SHARE, steps=mcd.STEPS):
    """Concentration steps in memory, with exact order statistics."""
    floors = np.diag(np.square(mcd.FLOORS))
    mid = np.median(x, axis=0)
    spread = 1.4826 * np.median(abs(x - mid), axis=0)
    mean, cov = mid, np.diag(spread ** 2) + floors
    for _ in range(steps):
        r = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        d = (r ** 2).sum(0)
        core = x[d <= np.sort(d)[int(np.ceil(share * len(x))) - 1]]
        mean, cov = core.mean(0), mcd._consistency(share, x.shape[1]) * np.cov(core.T, bias=True) + floors
    return mean, cov


def test_estimate_is_near_the_exact_one_and_finds_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4)) @ np.diag([0.3, 0.5, 0.4, 0.6]) + 1.5
    x[:600] = rng.normal(size=(600, 4)) * 0.1 + 7          # a sixth far away, all in one place
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], ["key", *mcd.PARTS])
    found = mcd.estimates(rows).first()
    mean, cov = plain_estimate(x)
    w = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            w[i, j] = found[f"w{i}_{j}"]
    assert np.allclose([found[f"m{i}"] for i in range(4)], mean, atol=0.02)
    assert np.allclose(np.linalg.inv(w.T @ w), cov, rtol=0.06, atol=0.02)
    d = (((x - mean) @ w.T) ** 2).sum(1)
    assert (d[:600] > mcd.CUTOFF).all() and (d[600:] < mcd.CUTOFF).all()


def test_small_groups_are_estimated_together(spark):
    rows = spark.createDataFrame([("en", "a")] * 60 + [("en", "b")] * 20 + [("en", "c")] * 40 + [("de", "a")] * 3 + [(None, None)] * 2,
                                 "lang string, source string")
    keys = {(r.lang, r.source): r.key for r in mcd.group_keys(rows, 50).collect()}
    assert keys[("en", "a")] == '{"lang":"en","source":"a"}' and keys[("en", "b")] == keys[("en", "c")] == '{"lang":"en"}'
    assert keys[("de", "a")] == keys[(None, None)] == "all"


def test_rules_keep_the_good_and_drop_the_odd(spark):
    sf = SF.replace("0.001", "0.01")
    rows = entry.queries()["op10_robust_outliers"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = entry.queries()["op7_regularised_qda"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == 1000
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


def test_scores_are_the_density_ratio(spark):
    """Against densities worked out directly from the labelled rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {i: np.array(qda.transform(textstats.base_stats(t, shape=True))) for i, t in texts_of(docs)}
    by = [np.array([x[i] for i, y in labels.items() if y == k]) for k in (0, 1)]
    n = np.array([len(b) for b in by])
    own = [np.cov(b.T, bias=True) for b in by]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    floor = np.trace(pooled) / len(pooled)
    density = []
    for k in (0, 1):
        cov = 0.98 * (0.9 * own[k] + 0.1 * pooled) + 0.02 * floor * np.eye(len(pooled))
        density.append({i: np.log((n[k] + 1) / (n.sum() + 2)) - 0.5 * (v - by[k].mean(0)) @ np.linalg.solve(cov, v - by[k].mean(0))
                        - 0.5 * np.linalg.slogdet(cov)[1] for i, v in x.items()})
    for r in qda.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(min(density[0][r.doc_id] - density[1][r.doc_id], 700))), abs=1e-6)


def test_classifier_on_odd_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 0), (11, 1, 0), (77, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = qda.quality_scores(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in qda.quality_scores(edge, labels.limit(0)).collect()] == [0.5] * len(rows)
    assert qda.quality_scores(empty, labels).collect() == []
    kept = qda.keep_good(edge, labels, edge)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in rows)
    assert qda.keep_good(empty, labels, edge).count() == 0
