"""The corpus pipeline: stage by stage against plain Python, and edges."""

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF, texts_of
from pyspark.sql import functions as F
from test_matching import plain_components, plain_lines
from test_tokens import WORD, check_packing, library

import __spark_entry__ as entry
from panelcast.llm import mcd, qda
from panelcast.session import stored


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), "pipeline-test")
        out.append((name, docs, after))
        docs = after
    return out


def test_stage_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "quality classifier", "line dedup", "near dedup", "packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(before.columns == columns for _, before, _ in stages)


def test_quality_stages_apply_their_operators(spark, stages):
    kept = {r.doc_id for r in mcd.quality_rules(stages[0][1]).where("kept").collect()}
    assert {i for i, _ in texts_of(stages[0][2])} == kept and len(kept) < stages[0][1].count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in qda.quality_scores(stages[0][1], labels).where("predicted = 1").collect()}
    assert {i for i, _ in texts_of(stages[1][2])} == kept & good


def test_line_dedup_stage(stages):
    _, before, after = stages[2]
    docs = texts_of(before)
    hashes = {r.text: r.h for r in before.select("text", F.xxhash64("text").alias("h")).collect()}
    want = plain_lines(docs, hashes, 2, 40)
    left = []
    for i, t in docs:
        gone, lines = set(want[i, t][3]), t.split("\n")
        if any(x.strip() and k not in gone for k, x in enumerate(lines)):
            left.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    assert sorted(texts_of(after)) == sorted(left)


def test_near_dedup_stage_keeps_the_first_of_each_group(stages):
    _, before, after = stages[3]
    docs = texts_of(before)
    assert sorted(i for i, _ in texts_of(after)) == sorted({c for _, _, c, _ in plain_components(docs)})
    assert set(texts_of(after)) <= set(docs)


def test_packing_stage(stages):
    _, before, after = stages[4]
    lib = library(WORD)
    ids_of = [(i, lib(t) + [1]) for i, t in texts_of(before)]
    bins = check_packing(after.collect(), ids_of, 4096)
    assert bins <= -(-sum(len(x) for _, x in ids_of) // 4096) + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    rows = entry.queries()["pipeline"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = stages[4][2].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_no_rows(spark, edge, empty, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, empty, SF).collect() == []
    rows = stage(spark, edge, SF)
    n = rows.count()
    assert 0 < n and (k == 4 or (n <= edge.count() and rows.columns == edge.columns))
    assert np.isfinite(n)
