"""What a Python worker still holds after its tasks."""

import os
import subprocess
import sys

import public_tokenizers

from panelcast.llm import binpack

KEPT = """
import re, pyarrow as pa
from panelcast.llm.textstats import slices

def held():
    with open("/proc/self/smaps_rollup") as fh:
        return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", fh.read()))) // 1024

def batches():
    for i in range(12):          # as a worker gets them: read from a stream
        batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * (40_000 + 7_000 * i)] * 300)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()

before = held()
rows = sum(b.num_rows for b in slices(batches()))
print(rows, held() - before)
"""


def test_batches_that_are_done_give_their_room_back():
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, sys.path))}
    rows, left = map(int, subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True, env=env).stdout.split())
    assert rows == 3600 and left < 80


def remembered(spark) -> set[int]:
    def count(batches):
        import pyarrow as pa

        from panelcast.llm import tokens

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(tokens._coders)]})

    return {r.n for r in spark.range(64, numPartitions=16).mapInArrow(count, "n long").collect()}


def test_packing_leaves_workers_no_coder_if_asked(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(32)], "doc_id long, text string").repartition(8).cache()
    docs.count()
    kept = binpack.encode_pieces(docs, path).orderBy("doc_id", "piece").collect()
    assert max(remembered(spark)) > 0
    # every worker serves a task again
    left = binpack.encode_pieces(docs.repartition(32), path, keep_coder=False).orderBy("doc_id", "piece").collect()
    assert left == kept
    assert remembered(spark) == {0}
    docs.unpersist()
