"""Exact token counts at every prefix of a text (byte-level BPE).

``counts[i]`` is the number of tokens that the tokenizer gives for the first
``i`` characters, so any question about truncation or a token budget is a
look-up, not another encoding.

Within a pre-token the counts come from a dynamic programme over its bytes.
In byte-pair encoding the encoding of a prefix that ends with token ``t`` is
the encoding of the shorter prefix plus ``t``, and ``t`` may follow a token
``p`` only if merging their bytes afresh gives ``p, t`` again.  Exactly one
token ending at a byte passes that test, and its count is one more than the
count where it begins.  Counts add up over pre-tokens; where a cut changes
the pre-tokens themselves (white space, contractions, special strings) the
few characters since the last safe place are taken again.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.tokens import BYTE_LETTERS, LONGEST, segments, vocabulary
from panelcast.session import ship_package, stored

#: Fixed value: how byte-level vocabularies of this kind cut a text.
PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_NEVER = 1 << 60
MEMO = 700_000          # segments, and beginnings of words, that a worker remembers
HEAD = 12               # beginnings of up to so many bytes are remembered
PREFIXES = "doc_id long, n_bytes long, n_tokens long, prefix binary"


class Merges:
    """The merge table of a byte-level BPE file, for tests on token pairs."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file without normaliser is needed")
        letter = {c: b for b, c in BYTE_LETTERS.items()}
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        ids = model["vocab"]
        self.id_of = {bytes(letter[c] for c in s): i for s, i in ids.items() if s not in special}
        self.reach: dict[bytes, int] = {}     # the longest token that ends with these three bytes
        for raw in self.id_of:
            self.reach[raw[-3:]] = max(len(raw), self.reach.get(raw[-3:], 3))
        self.states: dict[bytes, int] = {}    # last token and count of short beginnings
        self.merged, self.born, self.halves = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[a], ids[b], ids[a + b]
            self.merged[a, b] = (rank, whole)
            if whole not in self.halves:
                self.born[whole], self.halves[whole] = rank, (a, b)
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def stands_alone(self, token: int, raw: bytes) -> bool:
        """Whether the token's bytes are encoded as the token itself."""
        known = self.alone.get(token)
        if known is None:
            ids = [self.id_of[raw[i:i + 1]] for i in range(len(raw))]
            while len(ids) > 1:
                rank, i = min((self.merged.get(p, (_NEVER, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
                if rank == _NEVER:
                    break
                ids[i:i + 2] = [self.merged[ids[i], ids[i + 1]][1]]
            known = self.alone[token] = ids == [token]
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` then ``b`` are encoded as ``a, b``.

        Merging runs in rank order, so the two tokens' histories are walked
        back together: at each time one part of ``a`` touches one part of
        ``b`` across the border.  The pair fails if those two merge with each
        other before either is taken up by its own next merge (of equal
        ranks the left one comes first)."""
        known = self.follows.get((a, b))
        if known is not None:
            return known
        x, y, x_until, y_until, ok = a, b, _NEVER, _NEVER, True
        while True:
            rank = self.merged.get((x, y), (_NEVER, 0))[0]
            if rank < x_until and rank <= y_until and rank != _NEVER:
                ok = False
                break
            x_born, y_born = self.born.get(x, -1), self.born.get(y, -1)
            if x_born < 0 and y_born < 0:
                break
            if x_born > y_born:
                x, x_until = self.halves[x][1], x_born
            else:
                y, y_until = self.halves[y][0], y_born
        if len(self.follows) < 4 * MEMO:
            self.follows[a, b] = ok
        return ok

    def byte_counts(self, raw: bytes) -> list[int]:
        """Token counts at every byte of one pre-token, 0 first."""
        find, known, may_follow = self.id_of.get, self.follows.get, self.may_follow
        states, reach = self.states, self.reach.get
        last, counts = [-1], [0]
        for end in range(1, len(raw) + 1):
            if end <= HEAD:
                state = states.get(raw[:end])
                if state is not None:      # words share their beginnings
                    last.append(state >> 8)
                    counts.append(state & 255)
                    continue
            begin = end - reach(raw[end - 3:end], 3) if end > 3 else 0
            for start in range(begin if begin > 0 else 0, end):
                token = find(raw[start:end])
                if token is None:
                    continue
                if start:
                    fits = known((last[start], token))
                    if fits is None:
                        fits = may_follow(last[start], token)
                else:
                    fits = self.stands_alone(token, raw[:end])
                if fits:
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError("no token ends here")
            if end <= HEAD and len(states) < MEMO:
                states[raw[:end]] = last[end] << 8 | counts[end]
        return counts


class _Memo(dict):
    """Counts of the segments met: one byte a character, or an array where
    those are too many."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, segment: str):
        counts = self.count(segment)
        if len(counts) > LONGEST:
            return array("q", counts)
        packed = bytes(counts)
        if len(self) < MEMO:
            self[segment] = packed
        return packed


class PrefixCounter:
    """Counts at every character prefix of whole texts, by segments."""

    def __init__(self, tokenizer_json: str):
        self.merges = Merges(tokenizer_json)
        self.first = _Memo(self._segment)
        self.later = _Memo(lambda word: self._segment(" " + word))
        self.words: dict[str, list[int]] = {}

    def _pre_token(self, token: str) -> list[int]:
        """Counts after each character of a pre-token."""
        known = self.words.get(token)
        if known is not None:
            return known
        raw = token.encode()
        counts = self.merges.byte_counts(raw)[1:]
        if len(raw) > len(token):      # keep the counts at the characters' last bytes
            counts = [c for c, after in zip(counts, raw[1:] + b"a") if after & 0xC0 != 0x80]
        if len(token) <= 3 or len(token) <= LONGEST and len(self.words) < MEMO // 7:
            self.words[token] = counts
        return counts

    def _count(self, text: str) -> int:
        return sum(self._pre_token(t)[-1] for t in PRE_TOKENS.findall(text))

    def _plain(self, text: str) -> list[int]:
        """Counts after each character of a text without special strings."""
        out: list[int] = []
        base = 0
        safe_at, safe_count = 0, 0     # where the white space before a pre-token began
        after_space = False
        for m in PRE_TOKENS.finditer(text):
            token = m.group()
            blank = token.isspace()
            counts = self._pre_token(token)
            if not after_space:
                safe_at, safe_count = m.start(), base
            if blank or (token[0] == "'" and token[1:].isalpha()):
                # a cut inside gives other pre-tokens: white space in one run, an apostrophe by itself
                out += [safe_count + self._count(text[safe_at:i]) for i in range(m.start() + 1, m.end())]
                out.append(safe_count + self._count(text[safe_at:m.end()]) if blank else base + counts[-1])
            elif after_space and token[0] == " ":
                out.append(safe_count + self._count(text[safe_at:m.start() + 1]))
                out += [base + c for c in counts[1:]]
            else:
                out += [base + c for c in counts]
            base += counts[-1]
            after_space = blank
        return out

    def _segment(self, text: str) -> list[int]:
        if not text:
            return []
        if text[1:].isalpha() and text[0] == " ":
            return self._pre_token(text)
        if text[-1] in ".," and text[1:-1].isalpha() and text[0] == " ":
            word = self._pre_token(text[:-1])
            return [*word, word[-1] + 1]
        special = [s for s in self.merges.special if s in text]
        if not special:
            return self._plain(text)
        out: list[int] = []
        base = at = 0
        for m in regex.finditer("|".join(map(regex.escape, special)), text):
            here = self._plain(text[at:m.start()])
            out += [base + c for c in here]
            whole = base + (here[-1] if here else 0) + 1
            out += [base + c for c in self._plain(text[at:m.end() - 1])[m.start() - at:]]
            out.append(whole)
            base, at = whole, m.end()
        return out + [base + c for c in self._plain(text[at:])]

    def counts(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of ``text[:i]``, for ``i`` from 0 on."""
        if not text:
            return np.zeros(1, np.int64)
        parts = segments(text)
        found = [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if set(map(type, found)) == {bytes}:
            local = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
        else:
            local = np.concatenate([np.frombuffer(f, np.uint8) if isinstance(f, bytes) else f for f in found]).astype(np.int64)
        ends = np.cumsum(sizes)
        totals = np.where(sizes > 0, local[ends - 1], 0)
        base = np.cumsum(totals) - totals
        return np.concatenate([[0], local + np.repeat(base, sizes)])


_counters: dict[int, PrefixCounter] = {}


def counter(tokenizer_json: str) -> PrefixCounter:
    key = hash(tokenizer_json)
    if key not in _counters:
        _counters[key] = PrefixCounter(tokenizer_json)
    return _counters[key]


def pack_counts(counts: np.ndarray) -> bytes:
    """Prefix counts as stored: differences (one byte where they fit), compressed."""
    steps = np.diff(counts)
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return zstandard.ZstdCompressor(level=1).compress((b"\1" if small else b"\4") + steps.astype("i1" if small else "<i4").tobytes())


def unpack_counts(prefix: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(prefix)
    steps = np.frombuffer(raw, "i1" if raw[0] == 1 else "<i4", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes`` (UTF-8), ``n_tokens`` and
    ``prefix``, the packed counts at every prefix of the whole text.

    A null text is an empty one (0 bytes, 0 tokens); rows that share an id
    each get their own row; other columns are ignored."""
    spark = docs.sparkSession
    ship_package(spark)
    vocab = vocabulary(spark, tokenizer_path)

    def count(batches):
        own = counter(vocab.value.decode())
        for batch in batches:
            n_bytes, n_tokens, prefix = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = own.counts(text)
                n_bytes.append(len(text.encode()))
                n_tokens.append(int(found[-1]))
                prefix.append(pack_counts(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                              pa.array(prefix, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, PREFIXES)


def longest_within(prefixes: DataFrame, budget: int) -> DataFrame:
    """``prefixes`` with ``kept_chars``: the most characters of the text whose
    encoding has at most ``budget`` tokens (from the stored counts)."""

    def look_up(batches):
        for batch in batches:
            kept = []
            for packed in batch.column(batch.schema.get_field_index("prefix")):
                counts = unpack_counts(packed.as_py())
                kept.append(int(np.flatnonzero(counts <= budget)[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.int64())], names=[*batch.schema.names, "kept_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(look_up, f"{fields}, kept_chars long")


def over_budget(n_tokens: Column, budget: int) -> Column:
    return n_tokens > F.lit(budget)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """Store the prefix counts of all documents and answer ``limit`` from
    them: ``doc_id, n_bytes, n_tokens, over_limit, kept_chars``."""
    held = stored(prefix_counts(docs, tokenizer_path), "prefix-counts")
    return longest_within(held, limit).select(
        "doc_id", "n_bytes", "n_tokens", over_budget(F.col("n_tokens"), limit).alias("over_limit"), "kept_chars")
