"""Operators 1, 3, 8 and 9 against the tokenizer libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF, texts_of
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from panelcast.llm import binpack, planes, prefixcount, suffixpieces, tokens
from panelcast.llm.registry import vocabulary_path

BYTE, WORD, PIECE = map(vocabulary_path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


PARTS = ["a", "The", "'s", "'re", "'really", " ", "  ", "\n", "\t", "\n ", "é", "漢", "😀", "<|endoftext|>", "<|startoftext|>", "!", "...", ".",
         ",", "'", "'l", "12", "3a", " don't", "ing", "́", "<|en", "|>", "%%%", "\nBar", " foo.\n", "ÀB", "ß", "İ", "Σ", "_x_", "\x1c", "▁", "=>"]
odd_texts = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=12).map("".join)


@pytest.fixture(scope="module")
def coders():
    return [(tokens.Coder(open(p, encoding="utf-8").read()), library(p)) for p in (BYTE, WORD)]


@settings(max_examples=400, deadline=None)
@given(text=odd_texts)
def test_coder_is_the_library(coders, text):
    for own, lib in coders:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib(text)


@pytest.fixture(scope="module")
def prefix_counter():
    return prefixcount.PrefixCounter(open(BYTE, encoding="utf-8").read()), library(BYTE)


@settings(max_examples=300, deadline=None)
@given(text=odd_texts)
def test_every_prefix_counts_as_the_library(prefix_counter, text):
    own, lib = prefix_counter
    counts = own.counts(text)
    assert counts.tolist() == [len(lib(text[:i])) for i in range(len(text) + 1)]
    assert (prefixcount.unpack_counts(prefixcount.pack_counts(counts)) == counts).all()


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    proto = open(PIECE, "rb").read()
    return suffixpieces.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(odd_texts, max_size=4))
def test_suffix_array_encoding_is_the_library(sp, texts):
    own, lib = sp
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text)
        assert own.decode(ids) == lib.decode(lib.encode(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("kind", ["bit", "byte"])
@given(ids=st.lists(st.integers(0, 2 ** 32 - 1), max_size=80))
def test_planes_round_trip(kind, ids):
    ids = np.array(ids, "<u4")
    assert (planes.join_planes(planes.split_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind,block", [("bit", 100), ("byte", 7), ("bit", 1 << 16)])
def test_plane_files_hold_all_documents(spark, edge, tmp_path, kind, block):
    path = str(tmp_path / "planes")
    planes.write_ids(edge, path, BYTE, end_id=2, kind=kind, block=block)
    rows = planes.read_documents(spark, path).orderBy("start").collect()
    lib = library(BYTE)
    want = sorted(((i, lib(t) + [2]) for i, t in texts_of(edge)), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i or -1, len(x), crc(x)) for i, x in want)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    parts = defaultdict(list)
    for r in planes.read_ids(spark, path).orderBy("shard", "at").collect():
        parts[r.shard, r.ordinal].append(r.ids)
    assert sorted(crc(sum(p, [])) for p in parts.values()) == sorted(crc(x) for _, x in want)


def test_plane_files_without_end_id_or_rows(spark, edge, empty, tmp_path):
    path = str(tmp_path / "planes")
    planes.write_ids(edge, path, BYTE, end_id=None, block=50)
    rows = planes.read_documents(spark, path).collect()
    lib = library(BYTE)
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in rows) == sorted((i or -1, crc(lib(t))) for i, t in texts_of(edge))
    assert planes.encode_and_read_back(empty, BYTE).collect() == []


def check_packing(rows, ids_of, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) <= capacity
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = sorted((i if i is not None else -1, k, at, len(x[at:at + capacity]), crc(x[at:at + capacity]))
                  for i, x in ids_of for k, at in enumerate(range(0, len(x), capacity)))
    assert got == want
    return len(held)


def test_packing_places_every_piece_once(spark, edge, empty):
    lib = library(WORD)
    ids_of = [(i, lib(t) + [1]) for i, t in texts_of(edge)]
    pieces, layout = binpack.pack_documents(edge, WORD, max_tokens=256)
    n = check_packing(layout.collect(), ids_of, 256)
    assert n <= -(-sum(len(x) for _, x in ids_of) // 256) + 1
    assert binpack.pack_documents(empty, WORD)[1].collect() == []


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces, layout = binpack.pack_documents(docs, WORD)
    total = sum(len(r.ids) // 4 for r in binpack.packed_sequences(pieces, layout).collect())
    assert total == sum(len(r.ids) // 4 for r in pieces.collect())


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 12), max_size=30))
def test_plan_uses_all_lengths_and_fills_best(lengths):
    counts = {k: lengths.count(k) for k in lengths}
    plan = binpack.plan_bins(counts, 12)
    left = defaultdict(int)
    for used, times in plan:
        assert sum(k * n for k, n in used.items()) <= 12 and times > 0
        for k, n in used.items():
            left[k] += n * times
    assert dict(left) == counts
    if counts:
        seed = max(counts)
        rest = {**counts, seed: counts[seed] - 1}
        sums = {0}
        for k, n in rest.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= 12 - seed}
        assert sum(k * n for k, n in plan[0][0].items()) == seed + max(sums)


def test_one_length_may_hold_most_rows(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE CAST(1 + id % 11 AS LONG) END AS length")
    rows = binpack.assign_sequences(df, 16).collect()
    spots = defaultdict(int)
    for r in rows:
        spots[r.sequence_id] += r.length
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000 and max(spots.values()) <= 16
    bins = []                          # first fit decreasing needs no fewer
    for n in sorted((r.length for r in rows), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(16 - n)
        else:
            bins[at] -= n
    assert len(spots) <= len(bins)


def test_token_counts(spark, edge, empty):
    lib = library(BYTE)
    rows = prefixcount.token_counts(edge, BYTE, 20).collect()
    want = [(i or -1, len((t or "").encode()), len(lib(t)), len(lib(t)) > 20) for i, t in texts_of(edge)]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    texts = {(i or -1, len((t or "").encode())): t or "" for i, t in texts_of(edge)}
    for r in rows:
        t = texts[r.doc_id or -1, r.n_bytes]
        assert len(lib(t[:r.kept_chars])) <= 20
        assert r.kept_chars == len(t) or all(len(lib(t[:k])) > 20 for k in range(r.kept_chars + 1, min(len(t), r.kept_chars + 40) + 1))
    assert prefixcount.token_counts(empty, BYTE, 20).collect() == []


def test_piece_round_trip(spark, edge, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = suffixpieces.round_trip(edge, PIECE).collect()
    want = [(i or -1, len(lib.encode(t or "")), crc(lib.encode(t or "")), "▁" not in (t or "")) for i, t in texts_of(edge)]
    assert sorted((r.doc_id or -1, r.n_ids, r.ids_crc32, r.same) for r in rows) == sorted(want)
    assert suffixpieces.round_trip(empty, PIECE).collect() == []


def test_queries_cover_whole_tables(spark):
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    q = entry.queries()
    lib, words = library(BYTE), library(WORD)
    rows = q["op1_bit_planes"](spark, SF).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(rows, sorted(docs), strict=True):
        ids = lib(t) + [2]
        assert tuple(r)[:4] == (i, start, len(ids), crc(ids))
        start += len(ids)
    check_packing(q["op3_min_bin_slack"](spark, SF).collect(), [(i, words(t) + [1]) for i, t in docs], 4096)
    rows = q["op9_prefix_counts"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (i, len(t.encode()), len(lib(t)), len(lib(t)) > 1024) for i, t in docs)
    rows = q["op8_suffix_array_pieces"](spark, SF).collect()
    assert len(rows) == len(docs) and all(r.same for r in rows)


def test_pieces_with_clashing_columns(spark):
    from panelcast.llm import binpack

    rows = [(i, 0, 1 + i % 50, 7, 8, 9, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "__rank long, __bucket int, length int, sequence_id long, offset long, __length long, __before string")
    got = binpack.assign_sequences(df, 64)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 300
    ends = {}
    for r in got.collect():
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_history_walk_equals_merging_afresh():
    """Which piece may follow which, by the walk and by the definition."""
    import random

    from panelcast.llm import suffixpieces
    from panelcast.llm.registry import vocabulary_path

    with open(vocabulary_path("piece_bpe_32k.model"), "rb") as fh:
        model = suffixpieces.Pieces(fh.read())
    rnd, ids = random.Random(2), sorted(model.id_of.values())
    ids = [i for i in ids if model._stands_alone(i)]
    for _ in range(20_000):
        a, b = rnd.choice(ids), rnd.choice(ids if rnd.random() < 0.5 else ids[:600])
        assert model._may_follow(a, b) == (model._merge(model.text[a] + model.text[b]) == [model.text[a], model.text[b]])
