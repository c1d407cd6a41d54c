"""Statistics of whole texts for the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a repeated-window test.
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHAPE = ["n_chars", "n_upper", "n_digits", "n_punct", "n_space", "n_lines", "n_distinct_words", "longest_word", "n_ascii"]


def slices(batches, rows: int = 1024):
    """The batches in pieces of few rows, so that a task holds little at a time.

    Arrow keeps the room of batches that are done for later ones; a reused
    worker would hold the most it ever had, so it goes back after each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code, width = ids[:n], distinct
    for k in range(1, WINDOW):
        if width * distinct >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            width = len(values)
        code = code * distinct + ids[k:k + n]
        width *= distinct
    _, code, count = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[code] > 1)
    if not len(starts):
        return 0
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_stats(text: str | None, shape: bool = False) -> list[int]:
    """The counts named in ``BASE`` (then ``SHAPE``) of a whole text; words are
    runs without ASCII white space, a null text has none."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    blank = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    lines, dup, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            dup += line in lines
            lines.add(line)
    out = [len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), dup, _repeat_words(ids, len(seen))]
    if shape:
        b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, digits = int(b[65:91].sum()), int(b[48:58].sum())
        punct = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        out += [len(text), upper, digits, punct, blank, n_lines, len(seen), max(map(len, words), default=0), int(b[:128].sum())]
    return out
