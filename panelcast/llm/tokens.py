"""Whole-text encoding with the ``tokenizers`` library, one word at a time.

Both public vocabularies cut a text before a space that has a non-space on
either side, so a text is encoded as the concatenation of its space-separated
segments.  Words repeat, so each Python worker remembers the ids of the
segments it has met (``MEMO_BYTES`` at most; beyond that a segment is simply
encoded again).
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

MEMO_BYTES = 192 << 20  # of segments remembered by a worker, with what a dictionary entry takes
ENTRY = 200
LONGEST = 48            # longer segments are not remembered
_ODD = re.compile(r"\s | \s")
_CLOSING = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str) -> list[str]:
    """``text`` cut at every single space between two non-space characters.
    Joining the segments with a space gives the text back."""
    if _ODD.search(text) or text[:1] == " " or text[-1:] == " ":
        return _CUT.split(text)
    return text.split(" ")


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class _Room:
    """Bytes that memos which share it may still take."""

    def __init__(self):
        self.left = MEMO_BYTES


class _Memo(dict):
    def __init__(self, encode, room):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, segment):
        ids = self.encode(segment)
        if len(segment) <= LONGEST and self.room.left > 0:
            self[segment] = ids
            self.room.left -= ENTRY + len(segment) + len(ids)
        return ids


class Coder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        room = _Room()
        self.first = _Memo(lambda s: self._library(s), room)
        self.later = _Memo(lambda s: self._word(s), room)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``, put together from parts already met
        where a cut between them is one for every such text."""
        above, line, below = word.rpartition("\n")
        if line and above and below and not above[-1].isspace() and not below[0].isspace():
            return self.later[above] + self.first[line] + self.first[below]
        stem = word.rstrip(_CLOSING)
        if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ" and stem.lower().isalpha()):
            if len(stem) < len(word):
                return self.later[stem] + self.first[word[len(stem):]]
            # one run of letters is one pre-token: straight to the merges
            shown = word.lower() if self.lower else " " + word
            return np.array([t.id for t in self.model.tokenize(shown.encode().decode("latin-1").translate(BYTE_LETTERS))], "<u4").tobytes()
        return self._library(" " + word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = segments(text)
        head = self.first[parts[0]]
        if len(parts) == 1:
            return head
        return head + b"".join(map(self.later.__getitem__, parts[1:]))


_coders: dict[int, Coder] = {}


def coder(tokenizer_json: str) -> Coder:
    """The worker's coder for a tokenizer file's content."""
    key = hash(tokenizer_json)
    if key not in _coders:
        _coders[key] = Coder(tokenizer_json)
    return _coders[key]


def forget() -> None:
    """Lets the worker's coders go, with the segments they remember."""
    _coders.clear()
    gc.collect()            # a coder and its memos refer to each other


def vocabulary(spark, path: str):
    """A tokenizer file's content as a broadcast (a few MB by its nature), so
    executors need no copy of the file."""
    with open(path, "rb") as fh:
        return spark.sparkContext.broadcast(fh.read())
