"""Byte-level tokens of a batch of texts, with numpy.

The texts of a batch are laid end to end (one blank between them); a table of
256 byte classes marks separators (0) and one or more token classes; a token
is a longest run of one class.  Every token gets a 64-bit polynomial hash of
its (case-folded) bytes from one running sum, so no Python object is made per
token.  Bytes of 0x80 and above belong to multi-byte characters; each table
here gives all of them one class, so working on bytes never splits a
character.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Texts are handled in chunks of about this many bytes (one longer text is a
#: chunk of its own), which bounds the arrays of a task.
CHUNK_BYTES = 1 << 18


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"):ord("Z") + 1] += 32
    return t


#: A-Z to a-z, every other byte as it is.
LOWER = _fold()
SAME = np.arange(256, dtype=np.uint8)


def _blank_separated() -> np.ndarray:
    t = np.ones(256, dtype=np.uint8)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return t


def _alphanumeric() -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[a:b + 1] = 1
    return t


def _words_and_marks() -> np.ndarray:
    t = _alphanumeric()
    t[(t == 0) & (_blank_separated() == 1)] = 2
    t[:0x20] = 0
    return t


#: words ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _blank_separated()
#: words ``[0-9A-Za-z\x80-]+``, i.e. ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding
ALPHANUMERIC = _alphanumeric()
#: words (1) and runs of punctuation (2)
WORDS_AND_MARKS = _words_and_marks()

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens(NamedTuple):
    """Tokens of a chunk: ``off[i]:off[i+1]`` are those of text i; ``starts``
    and ``ends`` are byte positions in ``data``, where text i begins at
    ``base[i]``."""

    data: bytes
    hashes: np.ndarray
    kind: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray
    base: np.ndarray
    prefixes: list[np.ndarray] = []


def tokenize(texts: list[bytes], classes: np.ndarray, fold: np.ndarray = LOWER,
             prefix: tuple[int, ...] = ()) -> Tokens:
    """Tokens of the texts; ``prefix``: also hash their first so many bytes."""
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    cls = classes[raw]
    cut = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [n]])
    kind = cls[starts]
    keep = kind > 0
    starts, ends, kind = starts[keep], ends[keep], kind[keep]
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    folded = fold[raw].astype(np.uint64)
    folded += np.uint64(1)
    folded *= power[:n]
    np.cumsum(folded, out=sums[1:])

    def span_hash(stop):
        h = (sums[stop] - sums[starts]) * inverse[starts]
        return mix(h + (stop - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return Tokens(data, span_hash(ends), kind, starts, ends, np.searchsorted(starts, base), base,
                  [span_hash(np.minimum(ends, starts + k)) for k in prefix])


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes together."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values[off[i]:off[i+1]]`` for every i (0 where empty)."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
