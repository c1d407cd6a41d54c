"""Operators 2, 4, 5 and 6 against brute force."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SF, texts_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelcast.llm import components, licences, linededup, registry, simhash, vptree

# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text, words=4):
    found = [w.decode() for w in (text or "").encode().lower().split()]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(docs, max_bits=4):
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    links = Counter()
    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(b)] = find(a)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f)), links[f]) for i, f in fps)


def test_near_duplicates_on_odd_rows(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id, r.n_links) for r in rows) == plain_components(texts_of(edge))
    assert simhash.near_duplicates(empty).collect() == []


def test_near_duplicates_of_the_documents(spark):
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = entry.queries()["op2_pigeonring"](spark, SF).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id, r.n_links) for r in rows) == plain_components(docs)


@pytest.mark.parametrize("max_bits", [1, 3, 4, 7])
def test_links_lose_none(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.add(base)
        for _ in range(12):
            f = base
            for b in rng.choice(64, rng.integers(1, max_bits + 3), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.fp, r.other) for r in simhash.links(df, max_bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits}
    assert got == want and len(want) > 100


def test_one_document_of_each_group_stays(edge):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    groups = defaultdict(list)
    for r in simhash.near_duplicates(edge).collect():
        groups[r.root].append(r)
    roots = {(r.doc_id, r.text_hash): r.root for rs in groups.values() for r in rs}
    found = [(r.doc_id, r.h) for r in kept.select("doc_id", F.xxhash64("text").alias("h")).collect()]
    assert sorted(map(str, (roots[k] for k in found))) == sorted(map(str, groups))
    for i, h in found:
        ids = [r.doc_id for r in groups[roots[i, h]] if r.doc_id is not None]
        assert i == (min(ids) if ids else None)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(-5, -7), (-7, -6), (3, 3)]
    rows = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, -5: -7, -7: -7, -6: -7}
    assert len(rows) == 61 + 50 + 3


# -------------------------------------------------------------- line dedup


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_bit_parallel_distance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        a = "".join(rng.choice(list("abcé"), rng.integers(1, 16)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(b) + 1))
            b[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("abcé"), rng.integers(0, 2)))
        if b:
            rows.append((a, "".join(b), plain_edits(a, "".join(b))))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for most in (1, 2, 3, 5):
        near = df.where(F.abs(F.length("a") - F.length("b")) <= most)
        for r in near.select("a", "b", "d", linededup.edit_distance(F.split("a", ""), F.split("b", ""), most).alias("e")).collect():
            assert r.e == r.d if r.d <= most else r.e > most, r


def plain_lines(docs, text_hash, max_edits, min_chars):
    """Removed line numbers and links per (id, text)."""
    order, first, texts = [], {}, {}
    for i, t in set(docs):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                order.append(((i is None, i or 0, text_hash[t], k), line, (i, t)))
    for place, line, _ in sorted(order, key=lambda x: x[0]):
        first.setdefault(line, place)
    long_lines = [x for x in first if len(x) >= min_chars]
    links = {x: [y for y in long_lines if x != y and abs(len(x) - len(y)) <= max_edits and plain_edits(x, y) <= max_edits] for x in long_lines}
    out = defaultdict(lambda: [0, 0, 0, []])
    for place, line, doc in order:
        n = out[doc]
        exact, near = place > first[line], any(first[y] < first[line] for y in links.get(line, []))
        n[0] += exact
        n[1] += near and not exact
        n[2] += len(links.get(line, []))
        if exact or near:
            n[3].append(place[3])
    return out


def test_line_dedup_on_odd_rows(spark, edge, empty):
    base = "abcdefghij klmnopqrst uvwxyz"
    more = [(20 + k, line) for k, line in enumerate([base, base + "x", "Y" + base, base[:12] + base[14:], base.replace("k", "K"), base + "xyz",
            base[1:] + "\n" + base, "short\nshort\nshOrt", base[::-1] + "\r"])]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(extra)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = plain_lines(texts_of(docs), hashes, 2, 10)
    rows = linededup.line_classes(docs, max_edits=2, min_chars=10).collect()
    got = Counter((r.doc_id, r.n_lines, r.n_exact, r.n_near, r.n_links, r.removed) for r in rows)
    expected = Counter()
    for i, t in texts_of(docs):
        n = want[i, t]
        lines = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (t or "").split("\n"))
        expected[(i, lines, n[0], n[1], n[2], ",".join(map(str, sorted(n[3]))))] += 1
    assert got == expected
    kept = linededup.dedup_lines(edge, min_chars=10)
    assert kept.columns == edge.columns
    want = plain_lines(texts_of(edge), hashes, 2, 10)
    left = Counter()
    for i, t in texts_of(edge):
        gone = set(want[i, t][3])
        lines = (t or "").split("\n")
        full = {k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")}
        if not full or full - gone:
            left[(i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))] += 1
    assert Counter(texts_of(kept)) == left
    assert linededup.line_classes(empty).collect() == [] and linededup.dedup_lines(empty).collect() == []


def test_line_candidates_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    """Lines of one family share segments; only pairs that may be links come out of the join."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinotvwk"), 5)) for _ in range(12)]

    def with_word(k):
        word = "".join(rng.choice(list("aeinotvwkxyzfpjq"), 5, replace=False))
        return " ".join([*words[:k], word, *words[k + 1:]])

    family = [with_word(int(rng.integers(12))) for _ in range(40)]
    near = [family[0] + "z", family[1][1:], family[2].replace(words[-1], words[-1][:3] + "é" + words[-1][3:]), family[3], family[0] + "z"]
    docs = spark.createDataFrame(list(enumerate(family + near)), "doc_id long, text string")
    kept, plain = {}, linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = linededup.line_classes(docs).collect()
    assert kept["line-candidates"].count() < 60              # of 780 pairs
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = plain_lines(texts_of(docs), hashes, 2, 40)
    assert {r.doc_id: (r.n_exact, r.n_near, r.n_links) for r in rows} == {i: tuple(want[i, t][:3]) for i, t in texts_of(docs)}
    assert sum(r.n_links for r in rows) >= 6


@pytest.mark.parametrize("edits", [1, 2])
def test_signatures_bound_edits(spark, edits):
    rng, rows = np.random.default_rng(edits), []
    for _ in range(200):
        a = list(rng.choice(list("abcé z日"), int(rng.integers(9, 40))))
        b = list(a)
        for _ in range(edits):
            at, kind = int(rng.integers(len(b))), rng.integers(3)
            b[at:at + (kind != 0)] = [] if kind == 1 else list(rng.choice(list("abcé z日"), 1))
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select(*[f(F.col(c)).alias(f"{n}{c}") for c in "ab" for n, f in (
        ("s", linededup.signature), ("n", linededup.neighbours))])
    for r in df.collect():
        assert ((r.sa ^ r.sb) & (2 ** 64 - 1)).bit_count() <= 2 * edits
        assert sum(((r.na[c] ^ r.nb[c]) & (2 ** 64 - 1)).bit_count() for c in ("lo", "hi")) <= 4 * edits


# ---------------------------------------------------------------- licences


def plain_licences(text):
    import re

    found = {}
    rows = licences.template_bigrams(licences.TEMPLATES, licences.DICE)
    units = [(-1, text)] if "\n" in (text or "") else []
    for k, unit in units + list(enumerate((text or "").split("\n"))):
        words = re.sub("[^A-Za-z0-9]+", " ", unit).strip().lower().split()
        pairs = Counter(zip(words, words[1:]))
        for name in licences.TEMPLATES:
            own = Counter({tuple(r[4].split(" ")): r[5] for r in rows if r[0] == name})
            both, size = sum((pairs & own).values()), sum(pairs.values()) + sum(own.values())
            if pairs and 2 * both / size >= licences.DICE:
                best, line, n = found.get(name, (0, 0, 0))
                found[name] = (max(best, 2 * both / size), k if 2 * both / size > best else line, n + 1)
    return found


def test_licence_scan(spark, edge, empty):
    extra = [(30, licences.TEMPLATES["mit"]), (31, "x y z\n" + licences.TEMPLATES["apache-2.0"].replace("WARRANTIES", "warranty") + "\nend"),
             (32, " ".join(licences.TEMPLATES["isc"].split()[:-6])), (33, "cc by nc 4 0\nLicensed under CC-BY-NC-4.0"),
             (34, "Licensed under\nthe Apache License,\nVersion 2.0"), (35, "released under the mit"), (36, "the " * 500)]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = Counter((i, name, round(d, 9), line, n) for i, t in texts_of(docs) for name, (d, line, n) in plain_licences(t).items())
    got = Counter((r.doc_id, r.template, round(r.dice, 9), r.line_no, r.n_units) for r in licences.scan(docs).collect())
    assert got == want and len({k[1] for k in got}) >= 5
    assert licences.scan(empty).collect() == []
    tagged = licences.with_licences(edge)
    assert tagged.count() == edge.count() and tagged.columns == [*edge.columns, "licences_"]


def test_licence_lines_written_apart_from_the_templates(spark):
    lines = {"All rights reserved.": "all-rights-reserved", "all rights reserved": "all-rights-reserved",
             "Released under the MIT License": "mit-notice", "Licensed under the Apache License, Version 2.0": "apache-2.0-notice",
             "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0-notice",
             "This work is licensed under the GNU General Public License, version 3": "gpl-3.0-notice",
             "Licensed under the Mozilla Public License, version 2.0": "mpl-2.0-notice", "Released under the BSD license": "bsd-notice",
             "// This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
             "distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-2.0"}
    full = {"bsd-2-clause": "disclaimer in the documentation and/or other materials provided with the distribution",
            "bsd-3-clause": "endorse or promote products derived from this software without specific prior written permission",
            "lgpl-2.1": "either version 2.1 of the License", "lgpl-3.0": "GNU Lesser General Public License", "agpl-3.0": "GNU Affero",
            "gpl-2.0": "either version 2 of the License", "unlicense": "free and unencumbered software released into the public domain"}
    flat = {name: " ".join(text.split()) for name, text in licences.TEMPLATES.items()}
    assert all(part in flat[name] for name, part in full.items())
    texts = [*lines, *(flat[name] for name in full)]
    docs = spark.createDataFrame([(i, f"Some prose here.\n{t}\nMore of it.") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in licences.scan(docs).collect()}
    assert not set(enumerate([*lines.values(), *full])) - got


def test_licence_passages_across_and_within_lines(spark):
    flat = {name: text.split() for name, text in licences.TEMPLATES.items()}
    prose = [f"filler{i} word{i % 7} and more{i}" for i in range(400)]

    def wrapped(name, width=9):
        return ["# " + " ".join(flat[name][i:i + width]) for i in range(0, len(flat[name]), width)]

    mit = wrapped("mit")
    texts = ["\n".join(prose + mit + prose[:50]),
             "\n".join(prose[:3] + wrapped("apache-2.0") + prose + wrapped("apache-2.0", 13) + wrapped("apache-2.0")),
             " ".join(prose[:90]) + " All of it. Licensed under the Apache License, Version 2.0. Then " + " ".join(prose[90:180]),
             "\n".join(prose + ["Some text. Released under the", "MIT License. It goes on with", "ordinary words."] + prose),
             "\n".join(prose + mit[:6] + prose),
             "\n".join(prose + ["Released under the MIT License.", "a filler line", "Released under the MIT", "License, and so on and on"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.template): (round(r.dice, 6), r.line_no, r.n_units) for r in licences.scan(docs).collect()}
    assert got == {(0, "mit"): (1.0, 400, 1), (1, "apache-2.0"): (1.0, 3, 3), (1, "apache-2.0-notice"): (0.875, 3, 2), (2, "apache-2.0-notice"): (1.0, 0, 1),
                   (3, "mit-notice"): (1.0, 400, 1), (5, "mit-notice"): (1.0, 400, 2)}


# ------------------------------------------------------------ vector search


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10 ** 6), n=st.integers(1, 300), k=st.integers(1, 30), leaf=st.sampled_from([1, 4, 64]))
def test_tree_is_exact_at_factor_one(seed, n, k, leaf):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, 3)).astype(float)
    x = x[(x != 0).any(1)]
    ids = rng.permutation(5 * len(x))[: len(x)]
    if not len(x):
        return
    tree = vptree.Tree(ids, x, np.sqrt((x ** 2).sum(1)).max(), leaf=leaf)
    for q, (found, score) in enumerate(tree.search(ids, x, k)):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        assert found.tolist() == ids[order].tolist() and score.tolist() == s[order].tolist()


def test_relaxed_factor_keeps_recall(spark):
    v = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").toPandas()
    x, ids = np.stack(v.embedding.values).astype(float), v.vec_id.to_numpy()
    tree = vptree.Tree(ids, x, np.sqrt((x ** 2).sum(1)).max(), leaf=32)
    asked = np.flatnonzero(ids % 20 == 0)
    exact, near = tree.search(ids[asked], x[asked], 20), tree.search(ids[asked], x[asked], 20, factor=0.3)
    assert np.mean([len(set(a) & set(b)) / 20 for (a, _), (b, _) in zip(exact, near)]) >= 0.9


def test_search_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [3.0, -1.0]),
            (8, []), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (20, [2.0, 2.0]), (40, [1.0, 1.0, 1.0]), (60, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("rank", F.lit("y"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (20, 6.0), (0, 2): (1, 5.0), (0, 3): (7, 1.0), (20, 1): (0, 6.0), (20, 2): (1, 6.0), (20, 3): (7, 4.0), (40, 1): (9, 6.0)}
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# ------------------------------------------------------------------ oracles


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(registry.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def tidy(row):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

    assert Counter(map(tidy, df.select(*cols).collect())) == Counter(map(tidy, cur.fetchall()))


@pytest.mark.parametrize("size", [1e200, 1e-200, 3e7])
def test_one_vector_of_another_size(spark, size):
    """A finite vector that is very long or short takes no others' places away."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    x[7] *= size / np.linalg.norm(x[7])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    assert len(got) == 50
    for q in range(0, 200, 20):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(200), -score)) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == order
