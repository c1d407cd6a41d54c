"""Best-fit packing by minimum bin slack.

Texts become ids, ids become pieces of at most ``max_tokens``, and pieces are
packed into as few sequences of ``max_tokens`` as the search finds.

Per bin, the longest piece left is taken and a bitset dynamic programme over
the available lengths (bit s set: some of them sum to s) finds the fullest
combination for the rest; it is removed, and so on.  Pieces of one length are
alike, so the search needs only the count of each length (at most
``max_tokens`` rows, whatever the corpus), and a combination is removed as
often as the counts allow in one go.  The pieces are then dealt to the
planned places by their rank among the pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.textstats import slices
from panelcast.llm.tokens import coder, forget, vocabulary
from panelcast.session import ship_package, stored

#: Bytes of ids that a task hands on at a time.
HANDED = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary())])


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 4096,
                  id_col: str = "doc_id", text_col: str = "text", keep_coder: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids``: every whole text (null: empty)
    encoded, ``end_id`` appended, cut every ``max_tokens`` ids.  ``ids`` holds
    little-endian unsigned 32-bit integers.  Without ``keep_coder`` a task
    leaves its worker no remembered segments: slower, for jobs where others
    need the room."""
    spark = docs.sparkSession
    ship_package(spark)
    vocab = vocabulary(spark, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        encoder = coder(vocab.value.decode())

        def ready(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

        rows, held = [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                rows += [(doc_id, piece, at // 4, len(ids[at:at + 4 * max_tokens]) // 4, ids[at:at + 4 * max_tokens])
                         for piece, at in enumerate(range(0, len(ids), 4 * max_tokens))]
                held += len(ids)
                if held >= HANDED:
                    yield ready(rows)
                    rows, held = [], 0
        if rows:
            yield ready(rows)
        if not keep_coder:
            del encoder
            forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the fullest sum not above ``room``."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(available, reverse=True):
        if length > room:
            continue
        for _ in range(min(available[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + 1
            left -= length
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(how many of each length, how many such bins)``."""
    left = {length: n for length, n in counts.items() if n > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fullest({k: n for k, n in left.items() if n}, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: pieces ``first, first + 1, ...`` of a length
    go ``per`` to a bin from bin ``bin`` on, from ``offset`` in it."""
    runs, taken, bins = [], {}, 0
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            first = taken.get(length, 0)
            runs.append((length, first, used[length], bins, offset))
            taken[length] = first + used[length] * times
            offset += length * used[length]
        bins += times
    runs.sort()
    length, first, per, bin_, offset = np.array(runs, np.int64).reshape(-1, 5).T
    return {"key": length << 40 | first, "first": first, "per": per, "bin": bin_, "offset": offset}


def assign_sequences(pieces: DataFrame, max_tokens: int = 4096, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    All columns pass through, whatever their names (so keep ids out: join or compute what is needed
    from them before); columns named like the two new ones are replaced.  Lengths must be from 1 to ``max_tokens``; an empty
    table gives an empty one.  The rank of a piece among those of its length
    is counted within (length, hash bucket) and the buckets' counts are
    summed up, so one length may hold any share of the rows.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = pieces.schema
    # names of its own inside, so that columns of any name pass through
    pieces = pieces.toDF(*[f"_p{i}" for i in range(len(given))])
    cols = pieces.columns
    length = F.col(cols[given.names.index(length_col)])
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    counts = stored(dealt.groupBy(length.cast("long").alias("__length"), "__bucket").agg(F.count("*").alias("__n")), "piece-counts")
    by_length = {r["__length"]: r["n"] for r in counts.groupBy("__length").agg(F.sum("__n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_places(plan_bins(by_length, max_tokens)))
    before = counts.select("__length", "__bucket", F.coalesce(F.sum("__n").over(
        Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__length", "__bucket").orderBy(*cols)
    ranked = (
        dealt.withColumn("__length", length.cast("long")).withColumn("__rank", F.row_number().over(within) - 1)
        .join(before, ["__length", "__bucket"])
        .select(*cols, "__length", (F.col("__rank") + F.col("__before")).alias("__rank"))
    )

    def place(batches):
        r = runs.value
        for batch in batches:
            n, rank = (np.asarray(batch.column(len(cols) + i)) for i in (0, 1))
            at = np.searchsorted(r["key"], n << 40 | rank, side="right") - 1
            rank = rank - r["first"][at]
            seq = r["bin"][at] + rank // r["per"][at]
            offset = r["offset"][at] + rank % r["per"][at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(seq), pa.array(offset)],
                                             names=[*cols, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    keep = [(c, f.name) for c, f in zip(cols, given) if f.name not in ("sequence_id", "offset")]
    return placed.select(*(F.col(c).alias(n) for c, n in keep), "sequence_id", "offset")


def packed_sequences(pieces: DataFrame, layout: DataFrame, keys=("doc_id", "piece")) -> DataFrame:
    """The sequences' ids: ``sequence_id, length, ids`` with the pieces' ids
    in the order of their offsets (a sequence holds ``max_tokens`` at most).
    ``keys`` must tell the pieces apart."""
    placed = pieces.select(*keys, "ids").join(layout.select(*keys, "sequence_id", "offset", "length"), list(keys))
    ids = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 4096,
                   keep_coder: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(pieces, layout)``: the stored id pieces of all documents, and for
    each piece its checksum, sequence and offset.

    A null or empty text is one piece that holds the end id; a text of any
    length is cut into full pieces; repeated rows and equal ids are documents
    of their own; an empty table gives empty ones; other columns are ignored."""
    pieces = stored(encode_pieces(docs, tokenizer_path, end_id, max_tokens, keep_coder=keep_coder), "id-pieces")
    narrow = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "piece-digests")
    return pieces, assign_sequences(narrow, max_tokens)
