"""SentencePiece encoding by suffix-array matching, and decoding.

For a byte-pair model with byte fallback and no text normalisation.  The
segments (a space mark and what follows it) that a batch of texts has and the
worker has not met are joined to one string; its suffix array is built to the
depth of the longest piece; every piece's range of occurrences is found by
binary search; the occurrences, as edges, are sorted by where they end, and
relaxed in that order: an edge holds if its piece may follow the last piece of
the encoding that ends where it starts.  In byte-pair encoding exactly one
edge into each place holds, and the edges back from the end spell the result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.tokens import vocabulary
from panelcast.session import ship_package, stored

SPACE = "\u2581"        # fixed value: how pieces write a space
LONGEST = 48            # longer segments are not remembered
MEMO = 450_000          # segments that a worker remembers
_CLOSING = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
PAIRS = 600_000         # piece pairs that a worker remembers
BATCH = 120_000         # characters to one suffix array, and a segment more at most
TEXTS = 1_500_000       # characters of texts held cut at a time, and a text more at most


def read_model(proto: bytes) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (1 normal, 6 byte, else control) of a model
    file; raises ValueError for models of another sort."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    norm, trainer = model.normalizer_spec, model.trainer_spec
    if (trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces or not norm.escape_whitespaces or norm.precompiled_charsmap):
        raise ValueError("a byte-pair model with byte fallback and identity normalisation is needed")
    kinds = [p.type for p in model.pieces]
    if not set(kinds) <= {1, 2, 3, 6}:
        raise ValueError("user-defined and unused pieces are not handled")
    pieces = [p.piece for p in model.pieces]
    normal = {p for p, k in zip(pieces, kinds) if k == 1}
    if any(SPACE in p.lstrip(SPACE) for p in normal) or not {c for p in normal for c in p} <= normal:
        raise ValueError("pieces must not span words, and each of their characters must be a piece")
    return pieces, [p.score for p in model.pieces], kinds


class Pieces:
    """A worker's encoder and decoder for one model."""

    def __init__(self, proto: bytes):
        pieces, scores, kinds = read_model(proto)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.text = pieces
        self.rank = {p: -scores[i] for p, i in self.id_of.items()}
        self.bytes_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.depth = max(map(len, self.id_of))
        self.touching = {a + b for p in self.id_of for a, b in zip(p, p[1:])}     # neighbours in some piece
        self.follows: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.made_of: dict[str, tuple[str, str]] = {}
        self.memo: dict[str, bytes] = {}
        plain = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()}
        back = {i: b for b, i in self.bytes_ids.items()}
        self.raw = [plain.get(i, bytes([back[i]]) if i in back else b"") for i in range(len(pieces))]
        # pieces as rows of code points, zero after their end
        self.ids = np.array(sorted(self.id_of.values()))
        self.codes = np.zeros((len(self.ids), self.depth), np.uint32)
        self.lengths = np.array([len(pieces[i]) for i in self.ids])
        for row, i in zip(self.codes, self.ids):
            row[: len(pieces[i])] = list(map(ord, pieces[i]))

    # ---------------------------------------------------------------- merges

    def _merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text, by the definition: merge the
        best-ranked neighbours (leftmost of equals) until none are a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == np.inf:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, part: str) -> tuple[str, str]:
        """The two parts that a piece's own encoding merges last."""
        known = self.made_of.get(part)
        if known is None:
            parts, rank = list(part), self.rank
            while len(parts) > 2:
                best, at = min((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == np.inf:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = self.made_of[part] = (parts[0], parts[-1])
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` then ``b`` is encoded as ``a, b``.

        Merging runs by rank, a part's own parts ranking before it, so the two
        histories are walked back together: at each time one part of ``a``
        touches one of ``b`` across the border.  The pair fails if those two
        merge before either is taken up by its own next merge (of equal ranks
        the left one comes first)."""
        known = self._stands_alone(b)
        x, y, rank = self.text[a], self.text[b], self.rank
        x_until = y_until = np.inf
        while known:
            meet = rank.get(x + y, np.inf)
            if meet < x_until and meet <= y_until:
                known = False
                break
            x_born, y_born = rank[x] if len(x) > 1 else -np.inf, rank[y] if len(y) > 1 else -np.inf
            if x_born == y_born == -np.inf:
                break
            if x_born > y_born:
                x, x_until = self._halves(x)[1], x_born
            else:
                y, y_until = self._halves(y)[0], y_born
        if len(self.follows) < PAIRS:
            self.follows[a, b] = known
        return known

    def _stands_alone(self, a: int) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = len(self._merge(self.text[a])) == 1
        return known

    # -------------------------------------------------------------- matching

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece's every occurrence in ``text``
        (code points), by end and then start."""
        letters, ranks = np.unique(text, return_inverse=True)
        bits = int(len(letters) + 1).bit_length()
        per = 63 // bits                       # letters to a key
        rounds = -(-self.depth // per)
        padded = np.concatenate([ranks + 1, np.zeros(per * rounds, np.int64)]).astype(np.int64)
        keys = []
        for r in range(rounds):
            key = np.zeros(len(text), np.int64)
            for k in range(per):
                key = key << bits | padded[r * per + k: r * per + k + len(text)]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])      # sorted to the depth of the longest piece
        # pieces in the same letters; one with a letter that is not there has no occurrence
        at = np.searchsorted(letters, self.codes)
        here = letters[np.minimum(at, len(letters) - 1)] == self.codes
        inside = np.arange(self.depth) < self.lengths[:, None]
        there = (here | ~inside).all(1)
        rows, lengths, ids = np.where(inside, at + 1, 0)[there], self.lengths[there], self.ids[there]
        rows = np.pad(rows, ((0, 0), (0, per * rounds - self.depth)))
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(text), np.int64)
        first = keys[0][suffixes]
        for r in range(rounds):
            used = np.clip(lengths - r * per, 0, per)
            key = np.zeros(len(ids), np.int64)
            for k in range(per):
                key = key << bits | rows[:, r * per + k]
            free = bits * (per - used)         # letters after the piece's end may be any
            top = key | ((np.int64(1) << free) - 1)
            if r == 0:
                low, high = np.searchsorted(first, key, "left"), np.searchsorted(first, top, "right")
            else:
                for p in np.flatnonzero((used > 0) & (low < high)):
                    own = keys[r][suffixes[low[p]:high[p]]]
                    low[p], high[p] = low[p] + np.searchsorted(own, key[p], "left"), low[p] + np.searchsorted(own, top[p], "right")
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(ids)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        start = suffixes[place]
        end = start + lengths[which]
        order = np.lexsort((start, end))
        return start[order], end[order], ids[which][order]

    def match(self, segments: list[str]) -> dict[str, bytes]:
        """The segments' ids as little-endian unsigned 32-bit integers."""
        text = "\0".join(segments) + "\0"      # no piece has the character between them
        start, end, piece = (x.tolist() for x in self._edges(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
        last, source = [-1] * (len(text) + 1), [-1] * (len(text) + 1)
        open_at = [False] * (len(text) + 1)    # a place where any lone piece may start
        follows, may_follow, alone = self.follows.get, self._may_follow, self._stands_alone
        out, edge, begin, n_edges = {}, 0, 0, len(start)
        for segment in segments:
            stop = begin + len(segment)
            open_at[begin] = True
            at = begin
            while at < stop:
                at += 1
                while edge < n_edges and end[edge] < at:
                    edge += 1
                while edge < n_edges and end[edge] == at:
                    s, p = start[edge], piece[edge]
                    edge += 1
                    if s < begin:
                        continue
                    if open_at[s]:
                        fits = alone(p)
                    elif last[s] < 0:
                        continue
                    else:
                        fits = follows((last[s], p))
                        if fits is None:
                            fits = may_follow(last[s], p)
                    if fits:
                        last[at], source[at] = p, s
                        break
                else:
                    if text[at - 1] not in self.id_of:      # written as bytes; merges with nothing
                        source[at], open_at[at] = at - 1, True
                    else:
                        raise ValueError(f"no piece ends at {at - begin} of {segment!r}")
            ids, at = [], stop
            while at > begin:
                if last[at] >= 0:
                    ids.append(last[at])
                else:
                    ids += [self.bytes_ids[b] for b in reversed(text[at - 1].encode())]
                at = source[at]
            out[segment] = np.array(ids[::-1], "<u4").tobytes()
            begin = stop + 1
        return out

    # ------------------------------------------------------- encode / decode

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; a null or empty text has none."""
        cut = [_cut(t) if t else [] for t in texts]
        memo = self.memo
        new, joined = set(), {}
        for s in {s for parts in cut for s in parts if s not in memo}:
            word = s.rstrip(_CLOSING)
            if 0 < len(word) < len(s) and s[len(word) - 1: len(word) + 1] not in self.touching:
                joined[s] = (word, s[len(word):])      # no piece spans the two
            else:
                new.add(s)
        new |= {w for pair in joined.values() for w in pair if w not in memo}
        new = sorted(new)
        more: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and size < BATCH:
                size += len(new[stop])
                stop += 1
            more |= self.match(new[at:stop])
            at = stop
        for s, (word, rest) in joined.items():
            more[s] = (memo.get(word) or more[word]) + (memo.get(rest) or more[rest])
        for s, ids in more.items():
            if len(s) <= LONGEST and len(memo) < MEMO:
                memo[s] = ids
        lookup = memo.get
        return [b"".join([lookup(s) or more[s] for s in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of the ids: pieces and bytes joined, invalid bytes
        replaced, without the space that encoding puts first."""
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")
        return out[1:] if out[:1] == " " else out


def _cut(text: str) -> list[str]:
    """The text, a space mark put first, cut before each run of marks."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return [SPACE + w for w in text.split(" ")]
    return [s.replace(" ", SPACE) for s in re.findall(" *[^ ]+| +", " " + text)]


_known: dict[int, Pieces] = {}


def pieces(proto: bytes) -> Pieces:
    key = hash(proto)
    if key not in _known:
        _known[key] = Pieces(proto)
    return _known[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_chars, text_crc32``: every whole text's ids as
    little-endian unsigned 32-bit integers, its length and checksum.  A null
    text is an empty one; rows that share an id get a row each; other columns
    are ignored."""
    spark = docs.sparkSession
    ship_package(spark)
    model = vocabulary(spark, model_path)

    def run(batches):
        own = pieces(model.value)
        for batch in batches:
            ids, texts, size = [], [], 0
            for text in batch.column(3):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= TEXTS:
                    ids += own.encode_batch(texts)
                    texts, size = [], 0
            ids += own.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(1), batch.column(2)],
                                             names=["doc_id", "ids", "n_chars", "text_crc32"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_chars long, text_crc32 long")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``out_col`` (null for null)."""
    spark = encoded.sparkSession
    ship_package(spark)
    model = vocabulary(spark, model_path)

    def run(batches):
        own = pieces(model.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            text = [None if v is None else own.decode(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every whole text, store the ids, read them back and decode:
    ``doc_id, n_ids, ids_crc32, n_chars, decoded_crc32, same`` (whether
    decoding gave the text again; a space mark in a text comes back as a
    space)."""
    # stored in between, so that a task runs one Python worker at a time
    back = decode(stored(encode(docs, model_path), "piece-ids"), model_path)
    decoded = F.crc32(F.col("decoded").cast("binary"))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "n_chars",
                       decoded.alias("decoded_crc32"),
                       ((decoded == F.col("text_crc32")) & (F.length("decoded") == F.col("n_chars"))).alias("same"))
