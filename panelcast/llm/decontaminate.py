"""Benchmark decontamination with suffix arrays over the training texts.

A shard of documents is turned into word ids of the benchmark's vocabulary;
stretches that hold no window of the benchmark for certain (a word or a pair of
neighbours it does not have) are left out, the rest is indexed by a suffix
array.  Every suffix of every test item at which a window starts is searched
in it, word by word: the range that is left after the window gives all places
of the window, the last range that is not empty the longest match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import ship_package, stored

WINDOW = 10
#: Bytes of test items in one broadcast; more items go in several.
BLOCK_BYTES = 32 << 20
#: Bytes and rows of documents in one shard (a longer document is a shard of its own).
SHARD_BYTES, SHARD_ROWS = 48 << 20, 200_000
#: Bytes split into words at a time.
SLICE = 4 << 20

#: A-Z to a-z, everything below 128 that is no digit or letter to a blank.
_FOLD = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long, length:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def folded(text: bytes | None) -> bytes:
    """The words of a text (in UTF-8) between blanks."""
    return (text or b"").translate(_FOLD)


@dataclass
class Tests:
    """A block of test items as word ids (from 1), each item followed by 0."""

    words: list[bytes]
    ids: np.ndarray            # all items
    starts: np.ndarray         # places at which a window starts
    lengths: np.ndarray        # words of that window
    left: np.ndarray           # words of the item from there on
    items: np.ndarray          # number of the item
    names: list[str | None]

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words, 1)}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of neighbouring words, sorted, and a table of their hashes."""
        a, b = self.ids[:-1].astype(np.int64), self.ids[1:].astype(np.int64)
        codes = np.unique((a * (len(self.words) + 1) + b)[(a > 0) & (b > 0)])
        table = np.zeros(1 << max(16, min(26, int(4 * len(codes)).bit_length())), bool)
        table[_mix(codes) & (len(table) - 1)] = True
        return codes, table


def _mix(codes: np.ndarray) -> np.ndarray:
    return (codes * np.int64(0x1E3779B97F4A7C15)) >> 32


def index_tests(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Tests:
    """Items ``(name, text)`` as word ids; an item of fewer words than
    ``window`` is one window, one of none has none."""
    vocab: dict[bytes, int] = {}
    ids, starts, lengths, left, owner, names, at = [], [], [], [], [], [], 0
    for name, text in items:
        own = [vocab.setdefault(w, len(vocab) + 1) for w in folded((text or "").encode()).split()]
        if not own:
            continue
        size = min(window, len(own))
        for k in range(len(own) - size + 1):
            starts.append(at + k)
            lengths.append(size)
            left.append(len(own) - k)
            owner.append(len(names))
        names.append(name)
        ids += own + [0]
        at += len(own) + 1
    number = lambda x: np.array(x, np.int64)
    return Tests(list(vocab), np.array(ids, np.int32), number(starts), number(lengths), number(left), number(owner), names)


def _word_ids(raw: bytes, vocab: dict[bytes, int]) -> np.ndarray:
    """Id of every word (0: not in the vocabulary), a few MB at a time."""
    parts, at, get = [], 0, vocab.get
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.rfind(b" ", at, at + SLICE) + 1 or raw.find(b" ", at + SLICE) + 1 or len(raw)
        parts.append(np.array(list(map(get, raw[at:end].split(), repeat(0))), np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _stretches(ids: np.ndarray, tests: Tests, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of ``least`` or more words in which every
    word and every pair of neighbours occurs in the tests."""
    if len(ids) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids > 0
    near = np.flatnonzero(known[:-1] & known[1:])
    codes, table = tests.pairs
    code = ids[near].astype(np.int64) * (len(tests.words) + 1) + ids[near + 1]
    good = table[_mix(code) & (len(table) - 1)]
    near, code = near[good], code[good]
    if len(near):
        spot = np.searchsorted(codes, code)
        near = near[codes[np.minimum(spot, len(codes) - 1)] == code]
    joined = np.zeros(len(ids) + 1, bool)
    joined[near + 1] = True                                  # word i goes on from word i - 1
    first = np.flatnonzero(known & ~joined[:-1])
    end = np.flatnonzero(known & ~joined[1:]) + 1
    keep = end - first >= least
    return first[keep], end[keep]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``ids`` (0 between stretches) in the order of the texts from
    there on, to ``depth`` words at least, by prefix doubling."""
    n = len(ids)
    rank, span = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while span < depth:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        values, now = np.unique(rank * (n + 1) + after, return_inverse=True)
        if len(values) == rank.max() + 1:
            break
        rank, span = now.astype(np.int64), 2 * span
    return np.argsort(rank, kind="stable")


def _bisect(array, sa, word, lo, hi, depth, right):
    """First place in ``[lo, hi)`` whose word at ``depth`` is not below
    (``right``: is above) ``word``, for many ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        there = array[sa[mid] + depth]
        down = there <= word[todo] if right else there < word[todo]
        lo[todo[down]] = mid[down] + 1
        hi[todo[~down]] = mid[~down]
        todo = todo[lo[todo] < hi[todo]]
    return lo


@dataclass
class Found:
    """Per test suffix: the suffix-array range of its window (empty: none),
    and length and range of its longest match."""

    lo: np.ndarray
    hi: np.ndarray
    longest: np.ndarray
    far_lo: np.ndarray
    far_hi: np.ndarray


def search(ids: np.ndarray, sa: np.ndarray, tests: Tests) -> Found:
    """Binary search of every test suffix in the suffix array of ``ids``."""
    m = len(tests.starts)
    padded = np.concatenate([ids, np.full(int(tests.left.max(initial=0)) + 1, -1, np.int32)])
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    out = Found(np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), lo.copy(), hi.copy())
    live, depth = np.arange(m), 0
    while len(live):
        word = tests.ids[tests.starts[live] + depth]
        a = _bisect(padded, sa, word, lo[live], hi[live], depth, False)
        b = _bisect(padded, sa, word, a, hi[live], depth, True)
        some = a < b
        live, a, b, depth = live[some], a[some], b[some], depth + 1
        lo[live], hi[live] = a, b
        out.longest[live], out.far_lo[live], out.far_hi[live] = depth, a, b
        whole = live[tests.lengths[live] == depth]
        out.lo[whole], out.hi[whole] = lo[whole], hi[whole]
        live = live[tests.left[live] > depth]
    return out


@dataclass
class Shard:
    """Word ids of some documents' stretches, 0 after each, and their origin."""

    ids: np.ndarray
    place: np.ndarray          # word number in the document
    doc: np.ndarray            # row of the document
    n_words: np.ndarray

    @classmethod
    def build(cls, raws: list[bytes], tests: Tests) -> Shard:
        least = int(tests.lengths.min()) if len(tests.lengths) else 1
        ids, place, doc, n_words = [], [], [], np.zeros(len(raws), np.int64)
        group: list[int] = []

        def close():
            """Documents between borders (id 0), looked through together."""
            each = [_word_ids(raws[d], tests.vocabulary) for d in group]
            border = np.zeros(1, np.int32)
            all_ids = np.concatenate([x for e in each for x in (e, border)])
            ends = np.cumsum([len(e) + 1 for e in each])
            n_words[group] = [len(e) for e in each]
            if len(tests.starts):
                first, end = _stretches(all_ids, tests, least)
                size = end - first + 1                       # with the 0 after it
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                owner = np.searchsorted(ends, first, "right")
                cut = all_ids[at]
                cut[np.cumsum(size) - 1] = 0
                begins = np.concatenate([[0], ends[:-1]])[owner]
                ids.append(cut)
                place.append(at - np.repeat(begins, size))
                doc.append(np.repeat(np.array(group)[owner], size))
            group.clear()

        held = 0
        for d, raw in enumerate(raws):
            group.append(d)
            held += len(raw)
            if held > SLICE:
                close()
                held = 0
        if group:
            close()
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return cls(join(ids, np.int32), join(place, np.int64), join(doc, np.int64), n_words)

    def matches(self, tests: Tests) -> tuple[np.ndarray, Found]:
        """The suffix array of the words and what the search finds in it."""
        sa = suffix_array(self.ids, int(tests.left.max(initial=1)))
        sa = sa[self.ids[sa] > 0] if len(sa) else sa
        return sa, search(self.ids, sa, tests)

    def hits(self, tests: Tests) -> tuple[dict[int, np.ndarray], dict[int, set]]:
        """Per document with a window: the words in any occurrence (sorted
        numbers) and the numbers of the items."""
        words, items = {}, {}
        if not len(self.ids):
            return words, items
        sa, found = self.matches(tests)
        some = np.flatnonzero(found.lo < found.hi)
        if not len(some):
            return words, items
        key, cls = np.unique(np.stack([found.lo[some], found.hi[some], tests.lengths[some]]), axis=1, return_inverse=True)
        cls = cls.ravel()
        marks = np.zeros(len(self.ids) + 1, np.int64)
        met = []
        for c, (lo, hi, size) in enumerate(key.T.tolist()):              # equal windows are looked at once
            at = sa[lo:hi]
            marks[at] += 1
            marks[at + size] -= 1
            met.append(np.stack([np.unique(self.doc[at]), np.full(len(np.unique(self.doc[at])), c)]))
        hit = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
        order = hit[np.lexsort((self.place[hit], self.doc[hit]))]
        docs, first = np.unique(self.doc[order], return_index=True)
        for d, part in zip(docs.tolist(), np.split(self.place[order], first[1:])):
            words[d] = part
        owners = np.split(tests.items[some][np.argsort(cls, kind="stable")], np.cumsum(np.bincount(cls))[:-1])
        owners = [np.unique(o) for o in owners]
        pairs = np.concatenate(met, axis=1)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        docs, first = np.unique(pairs[0], return_index=True)
        for d, classes in zip(docs.tolist(), np.split(pairs[1], first[1:])):
            items[d] = set(np.unique(np.concatenate([owners[c] for c in classes])).tolist())
        return words, items


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows in shards of bounded bytes, with the folded texts of ``column``."""
    held, raws, size = [], [], 0
    for batch in batches:
        first = 0
        for i, text in enumerate(batch.column(column).cast(pa.binary())):
            raws.append(folded(text.as_py()))
            size += len(raws[-1])
            if size >= SHARD_BYTES or len(raws) >= SHARD_ROWS:
                yield [*held, batch.slice(first, i + 1 - first)], raws
                held, raws, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield held, raws


def _items(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The test items in blocks of about ``block_bytes``."""
    text = F.col(text_col).cast("string")
    rows = stored(benchmark.select(F.col(id_col).cast("string").alias("name"), text.alias("text")).distinct()
                  .withColumn("deal", F.xxhash64("name", "text")), "tests")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    for b in range(blocks):
        yield [(r["name"], r["text"]) for r in rows.where(F.pmod("deal", F.lit(blocks)) == b).select("name", "text").toLocalIterator()]


def _sent(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Each block of test items as a broadcast; a task holds one at a time."""
    sc = benchmark.sparkSession.sparkContext
    ship_package(benchmark.sparkSession)
    return [sc.broadcast(index_tests(items, window)) for items in _items(benchmark, id_col, text_col, block_bytes)]


def _look(raws: list[bytes], blocks: list) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, set]]:
    """Words, hit words and item names of a shard's documents over all blocks."""
    words: dict[int, np.ndarray] = {}
    names: dict[int, set] = {}
    n_words = np.zeros(len(raws), np.int64)
    for block in blocks:
        tests = block.value
        shard = Shard.build(raws, tests)
        n_words = shard.n_words
        hit, items = shard.hits(tests)
        for d, part in hit.items():
            words[d] = np.union1d(words[d], part) if d in words else part
        for d, owners in items.items():
            names.setdefault(d, set()).update(tests.names[i] for i in owners)
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)               # read anew for the next shard
    return n_words, words, names


def document_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``<id_col>, n_words, n_hit`` (words inside an
    occurrence of a test window), ``items`` (names of the items with occurring
    windows, sorted as strings) and ``spans`` (the hit words as runs).

    Words are runs of digits, ASCII letters in lower case and characters
    beyond ASCII; a window is ``window`` consecutive words of an item, or the
    whole of a shorter one.  Null and empty texts have no words; items without
    words never occur.  Repeated rows of ``docs`` each get a row; rows of
    ``benchmark`` with one name are one item, one with a null name counts for
    ``n_hit`` only.  Texts are read whole, the longest in slices.  Other
    columns are ignored; an empty table on either side gives no rows or no hits."""
    blocks = _sent(benchmark, item_col, item_text, window, block_bytes)

    def look(batches):
        for held, raws in _shards(batches, "_text"):
            n_words, words, names = _look(raws, blocks)
            spans, ends = [], [0]
            for d in range(len(raws)):
                if d in words:
                    cut = np.flatnonzero(np.diff(words[d]) > 1) + 1
                    spans += [{"start": int(p[0]), "length": len(p)} for p in np.split(words[d], cut)]
                ends.append(len(spans))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.column(0) for b in held]), pa.array(n_words),
                pa.array([len(words.get(d, ())) for d in range(len(raws))], pa.int64()),
                pa.array([sorted(n for n in names.get(d, ()) if n is not None) for d in range(len(raws))], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spans, _SPAN))],
                names=["_id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(look, f"_id {docs.schema[id_col].dataType.simpleString()}, {HITS}").withColumnRenamed("_id", id_col)


def remove_affected(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                    window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns; rows
    are handled as :func:`document_hits` says."""
    blocks = _sent(benchmark, item_col, item_text, window, block_bytes)

    def keep(batches):
        for held, raws in _shards(batches, text_col):
            hit, at = _look(raws, blocks)[1], 0
            for batch in held:
                yield batch.filter(pa.array([at + i not in hit for i in range(batch.num_rows)], pa.bool_()))
                at += batch.num_rows

    return docs.mapInArrow(keep, docs.schema)


MATCHES = "item string, start long, length long, id string, place long, places long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per test suffix (item name, ``start`` word) with a window in ``docs``:
    ``length`` of its longest verbatim match, one location (least document id
    as string, null last, then the first ``place``) and the number of ``places``.

    Every shard answers for itself; answers of equal length are added up.
    Rows are handled as :func:`document_hits` says; items of one name and
    text are one, those without a name are left out."""
    blocks = _sent(benchmark, item_col, item_text, window, block_bytes)

    def look(batches):
        for held, raws in _shards(batches, "_text"):
            ids = pa.concat_arrays([b.column(0) for b in held]).to_pylist()
            for block in blocks:
                tests = block.value
                shard = Shard.build(raws, tests)
                if not len(shard.ids):
                    continue
                sa, found = shard.matches(tests)
                some = np.flatnonzero(found.lo < found.hi)
                begin = {int(i): int(s) for i, s in zip(*np.unique(tests.items, return_index=True))}
                out = []
                for s in some.tolist():
                    at = sa[found.far_lo[s]:found.far_hi[s]]
                    best = min(at.tolist(), key=lambda p: (ids[shard.doc[p]] is None, ids[shard.doc[p]] or "", shard.place[p]))
                    item = int(tests.items[s])
                    out.append({"item": tests.names[item], "start": int(tests.starts[s] - tests.starts[begin[item]]), "length": int(found.longest[s]),
                                "id": ids[shard.doc[best]], "place": int(shard.place[best]), "places": len(at)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                                                                     ("id", pa.string()), ("place", pa.int64()), ("places", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = rows.mapInArrow(look, MATCHES).where("item is not null")
    by_length = (found.groupBy("item", "start", "length")
                 .agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "place")).alias("first"), F.sum("places").alias("places")))
    best = by_length.groupBy("item", "start").agg(F.max_by(F.struct("length", "first", "places"), "length").alias("b"))
    return best.select("item", "start", "b.length", "b.first.id", "b.first.place", "b.places")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
