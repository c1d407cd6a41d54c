"""Merkle manifest of a dataset by butterfly exchange.

Leaves of a group lie in blocks of ``arity ** BLOCK_LEVELS``.  A block hashes
its own subtree.  Then, round by round, ``arity ** ROUND_LEVELS`` aligned
blocks that differ in one digit of their number swap the roots of the subtrees
they stand in, and each hashes the common ancestors for itself: after the
last round every block knows its whole way up, and nothing is sent down.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.joins import few
from panelcast.plans.validation import global_row_index
from panelcast.session import ship_package, stored

BLOCK_LEVELS = 10
ROUND_LEVELS = 4
#: A way up: per level, the digests left and right of the own node within its run.
STEP = "struct<before:string, after:string>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def field(col: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """One digest over all of a proof's siblings."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def levels_of(nodes: list[str], arity: int, levels: int | None = None) -> list[list[str]]:
    """``nodes`` and the levels above: ``levels`` of them (a lone node is
    hashed too), or up to a single node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([sha256("".join(now[i:i + arity]).encode()).hexdigest() for i in range(0, len(now), arity)])
    return out


def way_up(tree: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """Siblings of node ``at`` and of its ancestors below the last level."""
    steps = []
    for now in tree[:-1]:
        first = at - at % arity
        steps.append(("".join(now[first:at]), "".join(now[at + 1:first + arity])))
        at //= arity
    return steps


def _places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``_at``: place of a row within its group, by ``order``; ``_size``: rows
    of the group.  A distributed sort; no group has to fit a task."""
    rows = global_row_index(rows, order, "_row")
    firsts = stored(rows.groupBy(group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size")), "merkle-groups")
    return (rows.join(few(firsts), group).withColumn("_at", F.col("_row") - F.col("_first")).drop("_row", "_first"))


def _blocks(rows: DataFrame, group: str, arity: int, levels: int, carried: list[str]) -> DataFrame:
    """One row per block: its rows in order, its number and the group's blocks."""
    width = arity ** levels
    return stored(
        rows.groupBy(group, F.floor(F.col("_at") / width).alias("_block"))
        .agg(F.ceil(F.first("_size") / width).alias("_n"), F.sort_array(F.collect_list(F.struct("_at", "_leaf", *carried))).alias("_rows")),
        "merkle-blocks")


def _climb(levels: int, arity: int):
    """Roots of a run of subtrees -> the block's new root and its next steps.
    ``_lone`` runs end with their single node; others rise ``levels``."""

    def climb(batches):
        for batch in batches:
            roots, ways = [], []
            for nodes, digit, lone in zip(*(batch.column(c).to_pylist() for c in ("_nodes", "_digit", "_lone"))):
                tree = levels_of(nodes, arity, None if lone else levels)
                roots.append(tree[-1][0])
                ways.append([dict(zip(("before", "after"), s)) for s in way_up(tree, digit, arity)])
            keep = [batch.column(c) for c in ("_g", "_block", "_n")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(roots, pa.string()), pa.array(ways, pa.list_(_STEP))],
                                             names=["_g", "_block", "_n", "_root", "_more"])

    return climb


def butterfly(blocks: DataFrame, arity: int = 2, levels: int = ROUND_LEVELS) -> DataFrame:
    """``_g, _block, _n, _root`` (one row per block, its subtree's root) ->
    the same with the group's root and ``_way``, the steps from block to root.

    In round r a block stands in a subtree of ``fanout ** r`` blocks and swaps
    roots with the blocks in the neighbouring subtrees whose lower digits are
    its own.  A group's last subtree can be short of blocks; each of those
    then also answers for missing ones, so that every block gets all roots.
    Messages stay under twice the blocks per round, groups of them under the fanout."""
    fanout = arity ** levels
    state = blocks.withColumn("_way", F.expr(f"cast(array() as array<{STEP}>)"))
    most = blocks.agg(F.max("_n")).first()[0] or 0
    span = 1
    while span < most:
        sub, low = F.floor(F.col("_block") / span), F.col("_block") % span
        run, digit = F.floor(sub / fanout), sub % fanout
        held = F.least(F.lit(span), F.col("_n") - sub * span)          # blocks of the subtree that exist
        last = F.when(digit > 0, F.lit(span)).otherwise(held)          # lower digits asked for in the run
        todo = state.where(F.col("_n") > span).select("_g", "_block", "_n", "_root", run.alias("_run"), digit.alias("_digit"),
                                                       low.alias("_low"), held.alias("_held"), last.alias("_last"))
        sent = todo.select("_g", "_run", F.explode(F.sequence("_low", F.col("_last") - 1, "_held")).alias("_low"),
                           F.struct("_digit", "_root").alias("_said"))
        heard = sent.groupBy("_g", "_run", "_low").agg(F.sort_array(F.collect_list("_said"))["_root"].alias("_nodes"))
        met = (todo.select("_g", "_block", "_n", "_run", "_low", F.col("_digit").cast("int").alias("_digit"))
               .join(heard, ["_g", "_run", "_low"]).withColumn("_lone", F.col("_n") <= span * fanout))
        risen = met.select("_g", "_block", "_n", "_nodes", "_digit", "_lone").mapInArrow(
            _climb(levels, arity), f"_g string, _block long, _n long, _root string, _more array<{STEP}>")
        state = stored(
            state.select("_g", "_block", "_n", F.col("_root").alias("_old"), "_way")
            .join(risen.select("_g", "_block", "_root", "_more"), ["_g", "_block"], "left")
            .select("_g", "_block", "_n", F.coalesce("_root", "_old").alias("_root"),
                    F.when(F.col("_more").isNull(), F.col("_way")).otherwise(F.concat("_way", "_more")).alias("_way")),
            "merkle-round")
        span *= fanout
    return state


def _forest(blocks: DataFrame, arity: int, block_levels: int, round_levels: int) -> DataFrame:
    """Per block of :func:`_blocks` (group column ``_g``): the group's root
    and the way from the block to it."""

    def roots(batches):
        for batch in batches:
            found = [levels_of(leaves, arity, None if n == 1 else block_levels)[-1][0]
                     for leaves, n in zip(batch.column("_leaves").to_pylist(), batch.column("_n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_g", "_block", "_n")), pa.array(found, pa.string())],
                                             names=["_g", "_block", "_n", "_root"])

    own = blocks.select("_g", "_block", "_n", F.col("_rows._leaf").alias("_leaves")).mapInArrow(
        roots, "_g string, _block long, _n long, _root string")
    return butterfly(stored(own, "merkle-roots"), arity, round_levels)


def _proofs(arity: int, block_levels: int, carried: list[tuple[str, pa.DataType]]):
    """Blocks with the way from block to root -> rows with their whole proof."""

    def proofs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, above = row["_rows"], [*row["_way"], *row["_top"]]
                tree = levels_of([r["_leaf"] for r in rows], arity, None if row["_n"] == 1 else block_levels)
                steps = [[*way_up(tree, i, arity), *((s["before"], s["after"]) for s in above)] for i in range(len(rows))]
                before, after = zip(*(s for way in steps for s in way)) if any(steps) else ((), ())
                ends = pa.array(np.array([0, *accumulate(map(len, steps))], np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_STEP))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["_leaf"] for r in rows], pa.string()), pa.ListArray.from_arrays(ends, pairs),
                     pa.array([row["_sub"]] * len(rows), pa.string()), pa.array([row["_root"]] * len(rows), pa.string()),
                     *(pa.array([r[c] for r in rows], t) for c, t in carried)],
                    names=["leaf", "proof", "subroot", "root", *(c for c, _ in carried)])

    return proofs


def manifest(df: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column] | None = None, arity: int = 2,
             block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """Per row of ``df``: ``leaf`` (digest of ``fields``), ``proof``
    (``array<struct<before, after>>``, from the leaf up), ``subroot`` (of the
    rows with its ``group`` value) and ``root`` (over the subroots, ordered by
    value), then the ``carry`` columns.

    Leaves of a group ascend by ``order``, null first; rows that share it
    follow each other by digest, so repeated rows are leaves of their own.  A
    null group is a group and comes first; nulls and empty texts have digests
    of their own (``-`` and ``0:``); a group of one row has its leaf as
    subroot.  Texts are hashed whole, where they lie.  Other columns are
    ignored; an empty table gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(df.sparkSession)
    carry = carry or {}
    names = [f"_c{i}" for i in range(len(carry))]
    leaves = df.select(field(F.col(group)).alias("_g"), F.col(group).cast("string").alias("_key"), F.col(order).alias("_order"),
                       leaf_digest(*map(F.col, fields)).alias("_leaf"), *(c.alias(n) for n, c in zip(names, carry.values())))
    placed = _places(leaves, "_g", ["_key", "_order", "_leaf"])
    blocks = _blocks(placed, "_g", arity, block_levels, names)
    ways = _forest(blocks, arity, block_levels, round_levels)

    # the subroots are the leaves of one more tree
    tops = leaves.select("_g", "_key").distinct().join(ways.where("_block = 0").select("_g", F.col("_root").alias("_leaf")), "_g")
    top_rows = _places(tops.select(F.lit("all").alias("_all"), F.col("_g").alias("_of"), "_key", "_leaf"), "_all", ["_key"])
    top_blocks = _blocks(top_rows.withColumnRenamed("_all", "_g"), "_g", arity, block_levels, ["_of"])
    top_ways = _forest(top_blocks, arity, block_levels, round_levels)
    schema = f"leaf string, proof array<{STEP}>, subroot string, root string"
    empty = F.expr(f"cast(array() as array<{STEP}>)")
    top = stored(
        top_blocks.join(few(top_ways.select("_g", "_block", "_root", "_way"), 20_000), ["_g", "_block"])
        .select("_n", "_rows", "_way", "_root", empty.alias("_top"), F.lit(None).cast("string").alias("_sub"))
        .mapInArrow(_proofs(arity, block_levels, [("_of", pa.string())]), schema + ", _of string")
        .select(F.col("_of").alias("_g"), F.col("proof").alias("_top"), F.col("root").alias("_root"), F.col("leaf").alias("_sub")), "merkle-tops")

    types = [f for f in placed.schema.fields if f.name in names]
    whole = blocks.join(few(ways.select("_g", "_block", "_way"), 20_000), ["_g", "_block"]).join(few(top, 20_000), "_g")
    rows = whole.select("_n", "_rows", "_way", "_top", "_sub", "_root").mapInArrow(
        _proofs(arity, block_levels, [(f.name, to_arrow_type(f.dataType)) for f in types]),
        ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in types)]))
    return rows.select("leaf", "proof", "subroot", "root", *(F.col(n).alias(c) for n, c in zip(names, carry)))


def verified(df: DataFrame, fields: list[str], group: str, order: str, changed: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """Rows' places in the manifest of ``df`` checked against ``changed``
    columns: ``<order>, leaf, subroot, root, proof_sha256, folded_root``
    (from the changed leaf and the original siblings), ``verified``.

    Rows are handled as :func:`manifest` says."""
    changed = changed or {}
    now = leaf_digest(*(changed.get(f, F.col(f)) for f in fields))
    rows = manifest(df, fields, group, order, {"id": F.col(order), "now": now}, arity)
    folded = rows.select(F.col("id").alias(order), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                         fold(F.col("now"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
