"""Filter interaction audit: what each of five text filters removes, in every order.

One finite-state pass over the UTF-8 bytes of a batch of texts: ``ACTION`` maps a
byte to its class bits, ``NEXT`` maps (state, class) to the next state, and the
states (between words, in a word) give word spans where they change.  The same
pass counts capitals, code points (bytes that begin one) and symbols.  The word
spans go into an open-addressing hash table of (text, word): a word that meets a
taken slot is compared with its owner byte by byte, so equal hashes of different
words cost a probe and never a wrong count.

A text is reduced to five failure bits and a SHA-256 digest; only these small
rows are shuffled.  Per part the documents become counts by failure mask (32 at
most), from which all 120 orders follow: filter f removes, after the filters in
``before``, the masks that hold f and none of ``before``.

Failure conditions: A fewer than ``min_words`` words; B too few distinct words;
C too many capitals; D a symbol; E text identical to that of a smaller id.

Defined results: a null text is the empty text (no words: fails A, passes B, C and
D); a null source is the part ''; a row with a null id never fails E and makes no
other fail it, and has no labels; repeated rows count each, and equal ids don't
fail E against each other; of repeated labels a 1 wins; an empty table gives no
rows; other columns of the documents play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.tokens import chunks, mix, segment_sum

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"

#: Class bits of a byte.
BLANK, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8


class Params(NamedTuple):
    min_words: int = 50
    distinct_percent: int = 65      # of the words, at least
    capital_percent: int = 5        # of the code points, at most


def _action_table() -> np.ndarray:
    t = np.full(256, POINT, np.uint8)
    t[0x80:0xC0] = 0                                   # continuation bytes begin no code point
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] |= BLANK
    t[ord("A"):ord("Z") + 1] |= CAPITAL
    t[list(SYMBOLS)] |= SYMBOL
    return t


ACTION = _action_table()
#: NEXT[state, class]: 0 between words, 1 in a word.
NEXT = np.array([[0 if c & BLANK else 1 for c in range(16)] for _ in (0, 1)], np.uint8)

_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


class Counts(NamedTuple):
    words: np.ndarray
    distinct: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray


def _eights(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The (up to) eight bytes at each position as one number; bytes beyond the word are 0."""
    raw = np.zeros((len(at), 8), np.uint8)
    for k in range(8):
        ok = left > k
        raw[ok, k] = data[at[ok] + k]
    return raw.view(np.uint64).ravel()


def _word_codes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and its first eight bytes."""
    first = _eights(data, starts, np.minimum(sizes, 8))
    h = mix(first ^ (sizes.astype(np.uint64) * _POWER))
    at, more = 8, np.flatnonzero(sizes > 8)
    while len(more):
        part = _eights(data, starts[more] + at, np.minimum(sizes[more] - at, 8))
        h[more] = mix(h[more] * _POWER + part)
        at += 8
        more = more[sizes[more] > at]
    return h, first


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of equal sizes that agree in their first eight bytes are the same."""
    same = np.ones(len(a), bool)
    at, left = 8, np.flatnonzero(size > 8)
    while len(left):
        rest = np.minimum(size[left] - at, 8)
        same[left] = _eights(data, a[left] + at, rest) == _eights(data, b[left] + at, rest)
        at += 8
        left = left[same[left] & (size[left] > at)]
    return same


def distinct_spans(data: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks the first inserted of equal words of one text: an open-addressing
    table, filled in rounds (a round is one probe of all words not yet placed)."""
    n = len(starts)
    new = np.zeros(n, bool)
    if not n:
        return new
    word, first = _word_codes(data, starts, sizes)
    bits = max(4, int(2 * n - 1).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (mix(word + owner.astype(np.uint64) * _POWER) >> np.uint64(64 - bits)).astype(np.int64)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free][::-1]] = todo[free][::-1]       # of several the first stays
        held = table[at]
        mine = held == todo
        new[todo[mine]] = True
        rest, held = todo[~mine], held[~mine]
        equal = (owner[rest] == owner[held]) & (sizes[rest] == sizes[held]) & (first[rest] == first[held])
        equal[equal] = _same_bytes(data, starts[rest[equal]], starts[held[equal]], sizes[rest[equal]])
        todo = rest[~equal]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return new


def transduce(texts: list[bytes]) -> Counts:
    """Counts of every text, from one pass over their bytes laid end to end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    act = ACTION[data]
    state = NEXT[0, act]                               # both rows of NEXT agree: the state follows from the byte
    edge = np.flatnonzero(np.diff(state, prepend=np.uint8(0)))
    starts, ends = edge[::2], edge[1::2]
    off = np.searchsorted(starts, base)
    owner = np.repeat(np.arange(len(texts)), np.diff(off))
    new = distinct_spans(data, owner, starts, ends - starts)

    def total(bit: int) -> np.ndarray:
        return np.add.reduceat((act & bit) != 0, base[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    points = total(POINT) - 1                          # without the blank after the text
    return Counts(np.diff(off), segment_sum(new, off).astype(np.int64), total(CAPITAL), points, total(SYMBOL))


def failures(c: Counts, p: Params) -> np.ndarray:
    """Bits 0 to 3: fails A, B, C, D."""
    return ((c.words < p.min_words) * 1 + (100 * c.distinct < p.distinct_percent * c.words) * 2
            + (100 * c.capitals > p.capital_percent * c.points) * 4 + (c.symbols > 0) * 8).astype(np.int32)


def judge(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row a document: ``id``, ``part``, ``mask`` (bits of the filters that it
    fails, E included) and its counts."""
    small = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                c = transduce(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(failures(c, p)),
                     *(pa.array(x) for x in c),
                     pa.array([hashlib.sha256(t).digest() for t in texts[lo:hi]], pa.binary())],
                    ["id", "part", "low", *Counts._fields, "digest"])

    kind = small.schema["id"].dataType.simpleString()
    rows = small.mapInArrow(scan, f"id {kind}, part string, low int, " + ", ".join(f"{c} long" for c in Counts._fields) + ", digest binary")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    fails_e = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return (rows.join(first, "digest", "left")
            .select("id", "part", (F.col("low") + F.when(fails_e, 16).otherwise(0)).alias("mask"), *Counts._fields))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it)."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k + 1, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """One row per part, order and step: documents ``kept`` after the step, ``removed``
    by it, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``."""
    marks = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    one = lambda c: F.coalesce(F.col(c), F.lit(0))
    cells = (judge(docs, p, id_col, text, part).select("id", "part", "mask").join(marks, "id", "left")
             .groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(one("good")).alias("good"), F.sum(one("toxic")).alias("bad")))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))   # 32 at most
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(b).alias("before"))
                      for o, k, bit, b in _steps()))
    rows = parts.select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(what: str, where) -> F.Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[what]).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    share = lambda m: F.lit(120) / F.bit_count(m)  # noqa: E731  orders in which f comes first of the mask's filters
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("bad", here).alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(
            fails(c["mask"]), c["n"] * share(c["mask"]).cast("long")).otherwise(0)).alias("shapley"))


def audit_sql(p: Params = Params()) -> str:
    """The audit as DuckDB SQL over ``documents`` and ``labels``."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '{word}') AS w FROM d),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
j AS (SELECT w.doc_id, part,
        CASE WHEN len(w) < {p.min_words} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < {p.distinct_percent} * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > {p.capital_percent} * length(w.t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > f.first THEN 16 ELSE 0 END AS mask
      FROM w JOIN f USING (t)),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM j LEFT JOIN l ON j.doc_id = l.doc_id GROUP BY part, mask),
b(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(p.l, q.l, r.l, s.l, u.l) AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
      FROM b p, b q, b r, b s, b u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
st AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before
       FROM o, range(1, 6) x(k)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
      FROM c, st GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
