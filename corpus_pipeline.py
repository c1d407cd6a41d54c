"""A training corpus from ``documents``: filter, deduplicate, pack.

Each stage works on what the one before it kept, written as Parquet to the
shared folder and read again; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import binpack, linededup, mcd, qda, simhash
from panelcast.llm.registry import vocabulary_path
from panelcast.session import stored
from panelcast.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's robust estimate reject go."""
    return mcd.keep_regular(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3 go; the model learns from all labelled rows
    of ``documents`` outside the held-out fold (the first stage leaves hardly
    any of the bad ones to learn from)."""
    return qda.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one are cut; a document left without
    lines goes.  ``n_chars`` keeps the source's figure."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all id pieces in sequences of at most 4096 tokens.  Workers
    that serve the other stages too keep no coder."""
    return binpack.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), keep_coder=False)[1]


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("line dedup", line_dedup),
          ("near dedup", near_dedup), ("packing", packing)]

#: No SQL for robust estimates, the classifier, fingerprints and tokenizers: tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
