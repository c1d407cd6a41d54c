"""Operator 12."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from conftest import SF, texts_of

import __spark_entry__ as entry
from panelcast.llm import decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, window=10):
    """Words, hit words (numbers) and names by definition."""
    w, hit, names = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        k = min(window, len(own))
        wins = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if k else set()
        at = [i for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in wins]
        hit |= {j for i in at for j in range(i, i + k)}
        if at and name is not None:
            names.add(str(name))
    return len(w), hit, sorted(names)


def expect(rows, items, window=10):
    out = Counter()
    for i, t in rows:
        n, hit, names = plain_hits(t, items, window)
        out[(i, n, len(hit), tuple(names))] += 1
    return out


def got_of(df):
    for r in df.collect():
        assert sum(s.length for s in r.spans) == r.n_hit
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())


def test_query_by_definition(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = Counter()
    for (i, n, hit, names), c in expect(texts_of(docs), items).items():
        want[(i, n, hit, len(names), sha256(",".join(names).encode()).hexdigest(), hit > 0)] += c
    got = Counter(tuple(r) for r in entry.queries()["op12_suffix_decontamination"](spark, SF)
                  .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == want and any(k[-1] for k in want)


def test_odd_rows(spark, edge, empty):
    schema = "item_id string, text string, name string, deal int"
    items = [("a", "the QUICK brown fox, jumps over the lazy dog and"), ("b", "漢字 é"), ("c", None), ("d", " ?! "), ("e", "tail"),
             (None, "second line of ordinary"), ("a", "one"), ("a", "one"), ("f", " ".join(["again"] * 30)),
             ("g", "and then it sleeps a second line of ordinary length follows here with words more and more")]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], schema)
    want = expect(texts_of(edge), items)
    assert got_of(de.document_hits(edge, bench)) == want
    assert got_of(de.document_hits(edge, bench, block_bytes=60)) == want       # many blocks of items
    kept = de.remove_affected(edge, bench)
    assert kept.columns == edge.columns
    assert Counter(texts_of(kept)) == Counter((i, t) for i, t in texts_of(edge) if not plain_hits(t, items)[1])
    assert de.document_hits(empty, bench).collect() == [] and de.longest_matches(empty, bench).collect() == []
    assert got_of(de.document_hits(edge, bench.limit(0))) == expect(texts_of(edge), [])
    assert de.remove_affected(edge, bench.limit(0)).count() == edge.count()


@pytest.mark.parametrize("window", [1, 3, 10])
def test_few_words_many_repeats(spark, window, monkeypatch):
    """Texts of three words: every window, range and stretch repeats; small
    shards and slices change nothing."""
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(f"i{k}", text(rnd.randint(0, 25))) for k in range(12)] + [("z", "a " * 40)]
    rows = [(k, text(rnd.randint(0, 120))) for k in range(60)] + [(99, "a " * 300)]
    tests = de.index_tests(items, window)
    for size in (10, 1 << 20):
        monkeypatch.setattr(de, "SLICE", size)
        shard = de.Shard.build([de.folded(t.encode()) for _, t in rows], tests)
        words, names = shard.hits(tests)
        for d, (_, t) in enumerate(rows):
            n, hit, owners = plain_hits(t, items, window)
            assert shard.n_words[d] == n and set(words.get(d, np.zeros(0)).tolist()) == hit
            assert sorted({tests.names[i] for i in names.get(d, ())}) == owners


def plain_longest(rows, items, window):
    out = {}
    for name, item in items:
        own = words_of(item)
        k = min(window, len(own))
        for s in range(len(own) - k + 1 if k else 0):
            found = []
            for i, t in rows:
                w = words_of(t)
                for p in range(len(w)):
                    n = 0
                    while s + n < len(own) and p + n < len(w) and own[s + n] == w[p + n]:
                        n += 1
                    if n >= k:
                        found.append((n, str(i), p))
            if found:
                n = max(f[0] for f in found)
                best = min((f[1:] for f in found if f[0] == n))
                out[(name, s)] = (n, *best, sum(f[0] == n for f in found))
    return out


def test_longest_matches_by_definition(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    items = [(f"i{k}", text(rnd.randint(1, 20))) for k in range(8)]
    rows = [(k, text(40) + " " + items[k % 8][1] + " " + text(5)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["item"], r["start"]): (r["length"], r["id"], r["place"], r["places"]) for r in de.longest_matches(docs, bench, window=5).collect()}
    assert got == plain_longest(rows, items, 5)
