"""Token ids as bit- or byte-plane chunks.

File format: a Parquet table, one row per chunk, so that Spark's committer
writes it to any storage and a lost task is simply written again.

``shard, chunk``  place of the chunk: ids run through shards, then chunks
``first``         ids of the shard before this chunk
``n_ids``         ids in the chunk (``BLOCK``, less in a shard's last one)
``kind``          ``bit`` or ``byte``
``planes``        one zstandard frame per plane, lowest plane first; the
                  planes above the highest one in use are not stored
``docs``          chunk index: the documents with ids in this chunk, as
                  ``(ordinal, doc_id, start, n_tokens)`` within the shard
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.tokens import coder, vocabulary
from panelcast.session import scratch_path, ship_package

BLOCK = 1 << 16
LEVEL = 3

CHUNKS = ("shard int, chunk long, first long, n_ids int, kind string, planes array<binary>, "
          "docs array<struct<ordinal:long, doc_id:long, start:long, n_tokens:long>>")
_DOC = pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()),
                    ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(_DOC))])
PARTS = "shard int, ordinal long, doc_id long, start long, n_tokens long, at long, crc long, part binary"
_PART = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                   ("n_tokens", pa.int64()), ("at", pa.int64()), ("crc", pa.int64()), ("part", pa.binary())])


def _turn_bits(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word as eight bytes of eight bits, rows and columns exchanged."""
    for keep, swap, by in _TURNS:
        x = (x & keep) | ((x & swap) << by) | ((x >> by) & swap)
    return x


#: bits (1, 2, 4 apart) that stay, those that move, and how far
_TURNS = [tuple(map(np.uint64, t)) for t in ((0xAA55AA55AA55AA55, 0x00AA00AA00AA00AA, 7),
                                             (0xCCCC3333CCCC3333, 0x0000CCCC0000CCCC, 14),
                                             (0xF0F0F0F00F0F0F0F, 0x00000000F0F0F0F0, 28))]


def split_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block of ids, compressed; all-zero high planes are left out."""
    if kind not in ("bit", "byte"):
        raise ValueError(f"kind must be bit or byte, not {kind!r}")
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    rows: list[np.ndarray] = [np.ascontiguousarray(raw[:, k]) for k in range(-(-top // 8))]
    if kind == "bit":
        planes = []
        for row in rows:
            words = _turn_bits(np.pad(row, (0, -len(row) % 8)).view("<u8"))
            planes += list(np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8).T))
        rows = planes[:top]
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(row.tobytes()) for row in rows]


def join_planes(planes: list[bytes], n_ids: int, kind: str = "bit") -> np.ndarray:
    """The ids that :func:`split_planes` was given."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n_ids, 4), np.uint8)
    rows = [np.frombuffer(unpack(p), np.uint8) for p in planes]
    if kind == "bit":
        none = np.zeros(-(-n_ids // 8), np.uint8)
        eights = [rows[k:k + 8] for k in range(0, len(rows), 8)]
        rows = [_turn_bits(np.stack([*e, *[none] * (8 - len(e))], axis=1).view("<u8").ravel()).view(np.uint8)[:n_ids] for e in eights]
    for k, row in enumerate(rows):
        raw[:, k] = row
    return raw.view("<u4").ravel()


class _ShardWriter:
    """Cuts a shard's id stream into chunks of ``block`` ids."""

    def __init__(self, shard: int, kind: str, block: int):
        self.shard, self.kind, self.block = shard, kind, block
        self.chunk = self.first = self.total = self.ordinal = 0
        self.held: list[bytes] = []
        self.held_ids = 0
        self.docs: list[dict] = []
        self.ready: list[dict] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        doc = {"ordinal": self.ordinal, "doc_id": doc_id, "start": self.total, "n_tokens": n}
        self.ordinal += 1
        self.total += n
        self.docs.append(doc)
        while self.held_ids + n >= self.block:
            take = self.block - self.held_ids
            self.held.append(ids[: 4 * take])
            self.held_ids += take
            ids, n = ids[4 * take:], n - take
            self.close()
            if n:
                self.docs.append(doc)
        if n:
            self.held.append(ids)
            self.held_ids += n

    def close(self) -> None:
        if not self.docs:
            return
        ids = np.frombuffer(b"".join(self.held), "<u4")
        self.ready.append({"shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": len(ids),
                           "kind": self.kind, "planes": split_planes(ids, self.kind), "docs": self.docs})
        self.chunk += 1
        self.first += len(ids)
        self.held, self.held_ids, self.docs = [], 0, []


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id",
              text_col: str = "text", kind: str = "bit", block: int = BLOCK) -> None:
    """Encode every whole text and write the ids, in ascending id order, as a
    table of plane chunks at ``path``.

    A null text is an empty one; ``end_id`` (if given) follows each document's
    ids.  Rows that share an id follow each other in the order of their
    text's hash, then of their text; a null id comes first.  Other columns
    are ignored.  Rows are range-partitioned by (id, hash), so that not even
    one id with a third of all rows meets in a task; each range is a shard.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocab = vocabulary(spark, tokenizer_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches):
        encoder = coder(vocab.value.decode())
        writer = _ShardWriter(TaskContext.get().partitionId(), kind, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, encoder.encode(text.as_py()) + end)
                if writer.ready:
                    yield pa.RecordBatch.from_pylist(writer.ready, _CHUNK)
                    writer.ready = []
        writer.close()
        if writer.ready:
            yield pa.RecordBatch.from_pylist(writer.ready, _CHUNK)

    (rows.select("doc_id", "text").mapInArrow(encode, CHUNKS)
     .write.option("compression", "uncompressed").parquet(path))


def _pieces(batches):
    """Per chunk: its part of each of its documents.  A document that lies in
    one chunk is done (its crc); one that goes on elsewhere gives its bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            first, n_ids = row["first"], row["n_ids"]
            data = memoryview(join_planes(row["planes"], n_ids, row["kind"]).tobytes())
            out = []
            for d in row["docs"]:
                lo, hi = max(d["start"], first), min(d["start"] + d["n_tokens"], first + n_ids)
                part = data[4 * (lo - first): 4 * (hi - first)]
                whole = hi - lo == d["n_tokens"]
                out.append({**d, "shard": row["shard"], "at": lo, "crc": zlib.crc32(part) if whole else None,
                            "part": None if whole else bytes(part)})
            yield pa.RecordBatch.from_pylist(out, _PART)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a chunk table: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32``.

    Every chunk is decoded on its own; only documents that cross a chunk's
    end have their parts brought together.  The shards' sizes (one row each)
    give the places in the whole stream."""
    ship_package(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sizes.select("shard", F.coalesce(
        F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    join_parts = F.aggregate(F.array_sort(F.col("parts")), F.lit(b""), lambda all_, p: F.concat(all_, p["part"]))
    docs = (
        chunks.mapInArrow(_pieces, PARTS).groupBy("shard", "ordinal")
        .agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"),
             F.max("crc").alias("crc"),
             F.collect_list(F.when(F.col("part").isNotNull(), F.struct("at", "part"))).alias("parts"))
    )
    return docs.join(before, "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens",
        F.coalesce("crc", F.crc32(join_parts)).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: one row per chunk and document, ``shard, ordinal,
    doc_id, at`` (place in the shard) and ``ids array<long>``."""
    ship_package(spark)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first, n = row["first"], row["n_ids"]
                ids = join_planes(row["planes"], n, row["kind"]).astype("i8")
                out = [{"shard": row["shard"], "ordinal": d["ordinal"], "doc_id": d["doc_id"],
                        "at": max(d["start"], first),
                        "ids": ids[max(d["start"] - first, 0): d["start"] + d["n_tokens"] - first]} for d in row["docs"]]
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                        ("ids", pa.list_(pa.int64()))])
    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(
        decode, "shard int, ordinal long, doc_id long, at long, ids array<long>")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = 2, kind: str = "bit") -> DataFrame:
    """Write ``docs`` as plane chunks in the shared scratch folder and read
    the documents' places and checksums back from there."""
    import uuid

    spark = docs.sparkSession
    path = scratch_path(spark, f"token-planes-{uuid.uuid4().hex}")
    write_ids(docs, path, tokenizer_path, end_id, kind=kind)
    return read_documents(spark, path)
