"""Operator 11."""

import zlib
from hashlib import sha256

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelcast.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, arity=2):
    """Root and every leaf's siblings by level, as (before, after)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p // arity * arity
            ways[i].append((nodes[first:p], nodes[p + 1:first + arity]))
            at[i] = p // arity
        nodes = [h(*nodes[k:k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], ways


def plain_manifest(rows, arity=2):
    """The contract's rows from (doc_id, source, lang, n_chars, text) tuples."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h(*map(plain_field, r)), r))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    subs, ways = {}, {}
    for lang in langs:
        groups[lang].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        subs[lang], ways[lang] = plain_tree([t[1] for t in groups[lang]], arity)
    root, tops = plain_tree([subs[k] for k in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        for (i, leaf, r), way in zip(groups[lang], ways[lang]):
            way = way + tops[k]
            tampered = list(r)
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None:
                tampered[3] += 1
            node = h(*map(plain_field, tampered))
            for before, after in way:
                node = h(*before, node, *after)
            out.append((i, leaf, subs[lang], root, h(*(x for b, a in way for x in b + a)), node, node == root))
    return out


def key(row):
    return tuple(map(str, row))


def run(df, **how):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(df, FIELDS, "lang", "doc_id", {"n_chars": tampered}, **how)


def test_query_by_definition(spark):
    got = entry.queries()["op11_butterfly_merkle"](spark, SF).collect()
    want = plain_manifest([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert {r.verified for r in got} == {True, False}


def test_odd_rows(edge, empty):
    want = plain_manifest([tuple(r) for r in edge.select(*FIELDS).collect()])
    assert sorted(map(key, run(edge).collect())) == sorted(map(key, want))
    assert run(empty).collect() == []
    one = edge.where("doc_id = 4")
    row = run(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()


@pytest.mark.parametrize("n, arity, block, rounds", [(37, 2, 1, 1), (64, 2, 1, 2), (65, 2, 2, 1), (40, 3, 1, 1), (23, 2, 0, 3)])
def test_many_small_blocks_and_rounds(spark, n, arity, block, rounds):
    """Ragged groups over several rounds of exchange give the plain tree."""
    rows = [(i, "s", "ab"[i % 7 == 0], i, f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}, arity, block, rounds)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof")))
    want = [(i, leaf, sub, root, proof, root) for i, leaf, sub, root, proof, _, _ in plain_manifest(rows, arity)]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_every_block_meets_all_roots(spark):
    """The exchange alone, with a short last subtree in every round."""
    n = 2 ** 4 + 2 ** 2 + 1
    roots = [h(str(i)) for i in range(n)]
    state = merkle.butterfly(spark.createDataFrame([("g", i, n, r) for i, r in enumerate(roots)], "_g string, _block long, _n long, _root string"), 2, 1)
    root, ways = plain_tree(roots)
    got = {r._block: (r._root, [(s.before, s.after) for s in r._way]) for r in state.collect()}
    assert got == {i: (root, [("".join(b), "".join(a)) for b, a in way]) for i, way in enumerate(ways)}
