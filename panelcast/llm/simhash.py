"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it.  Documents with one fingerprint are one class; classes link
at ``max_bits`` or fewer differing bits.

The 64 bits form a ring of ``max_bits + 1`` segments.  If two fingerprints
differ in at most ``max_bits`` bits, then from some segment on the ring every
run of ``l`` consecutive segments differs in at most ``l * max_bits /
(max_bits + 1)`` bits, rounded down to ``l - 1``: none in the first segment,
one in the first two, and so on.  The chain's first two segments are the join
key (probed exactly and with each bit of the second one set), the longer
chains and the full distance are conditions of that join.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.qda import fresh
from panelcast.llm.textstats import slices
from panelcast.session import ship_package, stored

SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    found = (text or "").encode().lower().split()      # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(words, len(found)) - 1:]
    digests = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, map(slice, starts, ends)), itertools.repeat(SEED)))
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    bits = np.empty(64, bool)
    for i in range(8):
        per_byte = np.bincount(rows[:, i], minlength=256)
        bits[8 * i: 8 * i + 8] = 2 * (per_byte @ _BYTE_BITS) > len(rows)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` per row; ``fp`` holds the 64 bits as a signed
    long.  A null or blank text has fingerprint zero."""
    ship_package(docs.sparkSession)

    def hash_texts(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        hash_texts, "doc_id long, text_hash long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the ring's segments."""
    n = max_bits + 1
    ends = [-(-64 * i // n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in itertools.pairwise(ends)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _value(fp: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1).cast("long"))


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs ``(fp, other)`` of distinct fingerprints (column ``fp``) that
    differ in 1 to ``max_bits`` bits, each pair once."""
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be from 1 to 15")
    ring = _segments(max_bits)
    n = len(ring)
    fp = F.col("fp")
    keys, probes = [], []
    for i, segment in enumerate(ring):
        after = ring[(i + 1) % n]
        head = F.lit(i << 58).cast("long").bitwiseOR(F.shiftleft(_value(fp, segment), after[1]))
        tail = _value(fp, after)
        key = head.bitwiseOR(tail)
        keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
        probes.append(key)
        # a pair that differs in one bit there is found from the side without it
        probes += [F.when(tail.bitwiseAND(F.lit(1 << b).cast("long")) == 0, key.bitwiseOR(F.lit(1 << b).cast("long")))
                   for b in range(after[1])]
    index = fps.select(fp.alias("other"), F.explode(F.array(*keys)).alias("k")).select("other", "k.start", "k.key")
    asked = fps.select("fp", F.explode(F.array_compact(F.array(*probes))).alias("probe"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    within = F.bit_count(differ) <= max_bits
    for length in range(3, n):
        masks = [sum(((1 << ring[(i + k) % n][1]) - 1) << ring[(i + k) % n][0] for k in range(length)) for i in range(n)]
        chain = F.element_at(F.array(*map(_signed, masks)), F.col("start") + 1)
        within &= F.bit_count(differ.bitwiseAND(chain)) <= length - 1
    found = asked.join(index, (F.col("probe") == F.col("key")) & (F.col("fp") != F.col("other")) & within)
    return found.select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (smallest ``doc_id`` reachable over links, itself
    included), ``n_links`` (other fingerprints linked to its own directly),
    ``text_hash`` and ``root`` (the component's smallest fingerprint).

    Null texts count as empty, empty texts have fingerprint zero and link like
    any other; rows with equal ids are rows of their own; a component without
    any non-null id has a null ``component_id``.  Other columns are ignored.
    """
    rows = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    pairs = stored(links(classes.select("fp"), max_bits), "fingerprint-links")
    ends = pairs.select("fp").union(pairs.select(F.col("other").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs, "fp", "other").withColumnRenamed("node", "fp")
    classes = (classes.join(roots, "fp", "left").join(ends, "fp", "left")
               .select("fp", "least_id", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    classes = stored(classes, "fingerprint-roots")
    ids = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(ids, "root").select("fp", "root", "n_links", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links", "text_hash", "root")


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    (id, text hash), nulls last; of rows equal in both, any one."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    own_id, own_hash, kept_id, kept_hash, row = (fresh(docs, n) for n in ("__own_id", "__own_hash", "__kept_id", "__kept_hash", "__place"))
    kept = (near_duplicates(docs, words, max_bits, id_col, text_col).groupBy("root").agg(F.min(first).alias("k"))
            .select(F.col("k.doc_id").alias(kept_id), F.col("k.text_hash").alias(kept_hash)))
    kept = stored(kept, "kept-documents")
    own = docs.withColumn(own_id, F.col(id_col).cast("long")).withColumn(own_hash, F.xxhash64(F.col(text_col).cast("string")))
    joined = own.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & F.col(own_hash).eqNullSafe(F.col(kept_hash)))
    one = Window.partitionBy(own_id, own_hash).orderBy(own_hash)
    return joined.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*docs.columns)
