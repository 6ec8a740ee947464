"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Every run of ``n`` consecutive words of a benchmark item is a window; an item
of fewer words (but not none) is one window of its own length.  The hash set
of the windows is broadcast in blocks made of at most ``block_bytes`` of
benchmark text (a larger benchmark takes several passes, nothing is skipped).
Every task slides over its texts: rolling hashes of the word windows are
looked up in the set, and each hit is verified word by word.

Defined results
* null texts and texts without words have no windows and no hits;
* item rows with a null id or text are left out; several rows of one item id
  count as one item that has all their windows;
* repeated document rows get equal results row by row, and other columns,
  whatever their names, are kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm import tokens as T
from textlake.llm.common import cut, free_name, utf8

WINDOW = 10
#: Benchmark text whose windows are broadcast at once (about 4 bytes a byte of text).
BLOCK_BYTES = 16 << 20

#: word bytes as they are (A-Z folded), everything else a blank
_WORD_BYTES = bytes(int(T.LOWER[b]) if T.ALPHANUMERIC[b] else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_TABLE_BITS = 20


def normalised(text: bytes) -> bytes:
    """The words of a text with one blank between them."""
    return b" ".join(text.translate(_WORD_BYTES).split())


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of every run of ``length`` word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _MULTIPLIER + h[k:k + n]
    return T.mix(out)


class Windows(NamedTuple):
    """Windows of one length: sorted hashes, a bit table for a quick no, and
    for each hash the item and the byte range of its words there."""

    hashes: np.ndarray
    table: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Block(NamedTuple):
    ids: list[str]
    texts: list[bytes]                 # normalised
    windows: dict[int, Windows]        # by length


def build_block(rows: list[tuple[str, bytes]], n: int) -> Block:
    """The hash set of some benchmark items."""
    ids, texts = [i for i, _ in rows], [normalised(t) for _, t in rows]
    found: dict[int, list[tuple]] = {}
    for k, text in enumerate(texts):
        t = T.tokenize([text], T.ALPHANUMERIC)
        length = min(n, len(t.hashes))
        if length:
            h = window_hashes(t.hashes, length)
            found.setdefault(length, []).append(
                (h, np.full(len(h), k), t.starts[:len(h)], t.ends[length - 1:]))
    windows = {}
    for length, parts in found.items():
        h, item, start, end = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        windows[length] = Windows(h[order], table, item[order], start[order], end[order])
    return Block(ids, texts, windows)


class Hits(NamedTuple):
    n_words: int
    hit: np.ndarray                    # per word of the text
    items: set[str]


def scan(texts: list[bytes], block: Block) -> list[Hits]:
    """Verified occurrences of the block's windows in each text."""
    out: list[Hits] = []
    for lo, hi in T.chunks(texts):
        t = T.tokenize(texts[lo:hi], T.ALPHANUMERIC)
        hit = np.zeros(len(t.hashes), bool)
        items: dict[int, set[str]] = {}
        for length, w in block.windows.items():
            h = window_hashes(t.hashes, length)
            maybe = np.flatnonzero(w.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            doc = np.searchsorted(t.off, maybe, side="right") - 1
            inside = maybe + length <= t.off[doc + 1]
            maybe, doc = maybe[inside], doc[inside]
            first = np.searchsorted(w.hashes, h[maybe], side="left")
            last = np.searchsorted(w.hashes, h[maybe], side="right")
            for i, d, a, b in zip(maybe.tolist(), doc.tolist(), first.tolist(), last.tolist()):
                if a == b:
                    continue
                words = normalised(t.data[t.starts[i]:t.ends[i + length - 1]])
                for k in range(a, b):
                    item = int(w.item[k])
                    if block.texts[item][w.start[k]:w.end[k]] == words:
                        hit[i:i + length] = True
                        items.setdefault(d, set()).add(block.ids[item])
        for d in range(hi - lo):
            own = hit[t.off[d]:t.off[d + 1]]
            out.append(Hits(len(own), own, items.get(d, set())))
    return out


def _blocks(benchmark: DataFrame, n: int, item: str, text: str, block_bytes: int):
    """Broadcast blocks, one at a time; an item is wholly in one of them."""
    rows = (benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull())
            .select(F.col(item).cast("string").alias("id"), utf8(F.col(text)).alias("t")))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == k) if count > 1 else rows
        block = build_block([(r["id"], bytes(r["t"])) for r in part.collect()], n)
        yield k == count - 1, rows.sparkSession.sparkContext.broadcast(block)


_STATE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()),
                    ("items", pa.list_(pa.string()))])
_STATE_DDL = "struct<n_words:long,n_hit:long,hit:binary,items:array<string>>"


def _judge(shared):
    @F.arrow_udf(_STATE_DDL)
    def judge(text: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for f, b in zip(scan(text.to_pylist(), shared.value), before.to_pylist()):
            hit, items = f.hit, f.items
            if b and b["items"]:
                hit = hit | np.unpackbits(np.frombuffer(b["hit"], np.uint8))[:len(hit)].astype(bool)
                items = items | set(b["items"])
            out.append({"n_words": f.n_words, "n_hit": int(hit.sum()),
                        "hit": np.packbits(hit).tobytes() if items else b"", "items": sorted(items)})
        return pa.array(out, _STATE)

    return judge


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
         item: str = "item_id", item_text: str = "text", out: str = "overlap",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``out``: n_words, n_hit, hit (one bit a word; empty
    without hits) and items (ids as strings, sorted).  No shuffle of ``docs``."""
    before = free_name(docs, "_before")
    frame = docs.withColumn(before, F.lit(None).cast(_STATE_DDL))
    for is_last, shared in _blocks(benchmark, n, item, item_text, block_bytes):
        frame = frame.withColumn(before, _judge(shared)(utf8(F.col(text)), F.col(before)))
        if not is_last:
            frame = cut(frame)
    return frame.withColumn(out, F.col(before)).drop(before)


def without_hits(text: bytes, hit: bytes) -> bytes:
    """A text without its runs of hit words (a blank stands for each run)."""
    if not hit:
        return text
    t = T.tokenize([text], T.ALPHANUMERIC)
    bits = np.unpackbits(np.frombuffer(hit, np.uint8))[:len(t.hashes)].astype(bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], bits, [False]])))
    parts, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        parts.append(text[at:t.starts[a]])
        at = t.ends[b - 1]
    return b" ".join([*parts, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW,
           text: str = "text", **names) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``) or with
    the hit words cut out of their texts (``mode="spans"``); same columns."""
    found = free_name(docs, "_overlap")
    frame = find(docs, benchmark, n, text, out=found, **names)
    if mode == "documents":
        return frame.filter(F.col(found)["n_hit"] == 0).drop(found)

    @F.arrow_udf("string")
    def clean(t: pa.Array, hit: pa.Array) -> pa.Array:
        return pa.array([without_hits(a, b).decode("utf-8", "replace")
                         for a, b in zip(t.to_pylist(), hit.to_pylist())], pa.string())

    hit = F.col(found)["hit"]
    return (frame.withColumn(text, F.when(F.col(found)["n_hit"] == 0, F.col(text))
                             .otherwise(clean(utf8(F.col(text)), hit)))
            .drop(found))
