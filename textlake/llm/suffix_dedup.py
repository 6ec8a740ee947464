"""Suffix-array dedup by a depth-limited radix sort.

The suffixes of all texts (bytes) are ordered only through their first ``depth``
bytes, by passes from the most significant digit on, and a suffix leaves the sort
as soon as its class has no second member.  What is left together after ``depth``
bytes are exactly the repeated windows; every member but the earliest is marked,
and the bytes under marked windows are removed.

Passes
0. A document whose whole text a smaller id has is removed at once, by a digest of its text.
1. The first digit is the ``digit``-byte gram of least hash among the grams inside
   the window (the leftmost of equal ones).  It depends on the window's bytes alone, so equal
   windows agree in it, and neighbouring suffixes mostly share one: a text has about one such
   gram in (depth - digit) / 2 bytes, and only these are counted, not every suffix.
   Grams seen once take their windows out of the sort.
2. The windows around the grams that are left go to buckets by gram, as one piece
   of text around each gram.  There the windows of one gram and one distance to
   it are split by their first eight bytes, then the next eight, and so on through ``depth``;
   a pass sorts only classes that differ in it, and single windows leave.
A gram with more than ``crowd`` occurrences isn't given to one task: its windows
are rows of their own, told apart by all their bytes, and meet in a
partially aggregated group-by and an equality join that Spark can split.

Matches never cross documents.  Documents are ordered by id, rows without an id after
all others; rows of one id (or of none) that differ in text are told apart and ordered by a 64-bit digest of
id and text; equal rows of one id are one document and get equal results.  A null text is empty; texts
shorter than ``depth`` are never touched; an empty table gives no rows; extra columns
stay, whatever their names (outputs of the same names replace them); the kept bytes stand for the text.  Ids are integers.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import free_name
from textlake.llm.tokens import CHUNK_BYTES, _power_tables, chunks, mix

DEPTH = 100
DIGIT = 20
#: Occurrences of one gram that one task may sort.
CROWD = 50_000
#: Bytes of text per bucket of the sort, and windows sorted at once.
BUCKET_BYTES = 8 << 20
SLICE_WINDOWS = 1 << 18

#: What tells documents apart and orders them: id, digest of id and text (which joins use).
_ROW = ["ord", "uid"]


def _least_grams(raw: np.ndarray, off: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start of the texts laid end to end: position of its least
    gram, and the hashes of the grams at all positions."""
    n = len(raw)
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = mix((sums[digit:] - sums[:-digit]) * inverse[:n - digit + 1])
    low = np.uint64(max(1, n).bit_length())
    least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    span, have = depth - digit + 1, 1
    while have < span:                                 # minimum over spans of doubling length
        step = min(have, span - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    return (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), grams


def anchors(texts: list[bytes], depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, gram position, first window, last window), a row for every gram
    that is the least of some windows; positions are within the text.  The windows of a gram are consecutive."""
    texts = [t if len(t) >= depth else b"" for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    if not off[-1]:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    pos, grams = _least_grams(raw, off, depth, digit)
    sizes = np.maximum(np.diff(off) - depth + 1, 0)
    start = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    text = np.repeat(np.arange(len(texts)), sizes)
    pos = pos[start]
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(pos)) - 1
    owner = text[first]
    at = pos[first]
    return owner, grams[at], at - off[owner], start[first] - off[owner], start[last] - off[owner]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The order key of every document, its bytes and its other columns (``row``)."""
    c, body = F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(c, F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(c, body).alias("uid"), body.cast("binary").alias("bytes"),
                       F.struct(*(x for x in docs.columns if x != text)).alias("row"))


def _copies(keyed: DataFrame, depth: int) -> DataFrame:
    """Marks all windows of documents whose whole text a smaller id has: they are out
    of the sort before it begins."""
    ids = keyed.select(*_ROW, F.unhex(F.sha2("bytes", 256)).alias("text"), F.octet_length("bytes").alias("n")).filter(F.col("n") >= depth)
    first = ids.groupBy("text").agg(F.min("ord").alias("least"))
    return (ids.join(first, "text").filter(F.col("ord") > F.col("least"))
            .select(*_ROW, F.lit(0).alias("first"), (F.col("n") - depth).cast("int").alias("last")).distinct())


def _grams(docs: DataFrame, depth: int, digit: int) -> DataFrame:
    """``h``, ``uid``, ``c``: distinct grams of every row, with their number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, uid = b.column(2).to_pylist(), b.column(1).to_numpy()
            for lo, hi in chunks(texts):
                owner, h, *_ = anchors(texts[lo:hi], depth, digit)
                if len(h):
                    order = np.lexsort((h, owner))
                    o, h = owner[order], h[order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[first].view(np.int64)), pa.array(uid[lo:hi][o[first]]),
                         pa.array(np.diff(np.append(first, len(h))))], ["h", "uid", "c"])

    return docs.mapInArrow(scan, "h long, uid long, c long")


def _runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of starts that follow each other in one row, joined: (row, first, last, index of the first)."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)]))
    return row[new], first[new], last[np.append(new[1:], len(last)) - 1], new


def _seen_before(owner: np.ndarray, h: np.ndarray, shift: np.ndarray, piece: list[bytes]) -> np.ndarray:
    """Marks pieces that an earlier piece of their text equals, gram for gram."""
    known = np.zeros(len(piece), bool)
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(piece), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen = set()
    for k in np.flatnonzero(twice).tolist():           # in text order
        key = (owner[k], shift[k], piece[k])
        known[k] = key in seen
        seen.add(key)
    return known


def _pieces(rows: DataFrame, depth: int, digit: int, buckets: int) -> DataFrame:
    """The texts around the grams that are left (``hs`` of every row).

    A piece that the same text holds before (runs of one byte, say) needs no sort: all its
    windows start earlier.  Such pieces are emptied and leave as runs of marked starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                part = b.slice(lo, hi - lo)
                owner, h, pos, first, last = anchors(texts[lo:hi], depth, digit)
                if not len(h):
                    continue
                left = part.column(3)                  # (text, gram) pairs, numbered
                want_o, want_h = np.repeat(np.arange(len(part)), np.diff(left.offsets.to_numpy())), left.flatten().to_numpy().view(np.uint64)
                names, code = np.unique(np.concatenate([want_h, h]), return_inverse=True)
                found = np.isin(owner * len(names) + code[len(want_h):], want_o * len(names) + code[:len(want_h)])
                o, hs, pos, first, last = owner[found], h[found], pos[found], first[found], last[found]
                piece = [texts[lo + t][a:z + depth] for t, a, z in zip(o.tolist(), first.tolist(), last.tolist())]
                known = _seen_before(o, hs, pos - first, piece)
                new = np.flatnonzero(~known)
                run = _runs(o[known], first[known], last[known])
                o, hs, pos = (np.concatenate([x[new], y]) for x, y in ((o, run[0]), (hs, hs[known][run[3]]), (pos - first, run[0] * 0)))
                first, last = np.concatenate([first[new], run[1]]), np.concatenate([last[new], run[2]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((hs % np.uint64(buckets)).astype(np.int64)), pa.array(hs.view(np.int64)),
                     *(part.column(k).take(pa.array(o)) for k in range(2)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                     pa.array(pos.astype(np.int32)), pa.array([piece[k] for k in new] + [b""] * len(run[0]), pa.binary())],
                    ["bucket", "h", *_ROW, "first", "last", "shift", "piece"])

    return rows.mapInArrow(cut, "bucket long, h long, ord long, uid long, first int, last int, shift int, piece binary")


def radix_classes(raw: np.ndarray, at: np.ndarray, cls: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``depth`` bytes at ``at`` that have an equal one in their class:
    (index, class) of those left, classes consecutive.  Passes of eight bytes, most
    significant first; a pass sorts the classes that it splits, and single windows leave."""
    order = np.argsort(cls, kind="stable")
    cls = cls[order]

    def leave(order, cls):
        same = cls[1:] == cls[:-1]
        keep = np.zeros(len(cls), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return order[keep], cls[keep]

    order, cls = leave(order, cls)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8) if len(raw) >= 8 else None
    for d in range(0, depth, 8):
        if not len(order):
            break
        size = min(8, depth - d)
        if words is not None and size == 8:
            digit = np.ascontiguousarray(words[at[order] + d]).view(">u8").ravel().astype(np.uint64)
        else:
            digit = np.zeros(len(order), np.uint64)
            for k in range(size):
                digit = digit << np.uint64(8) | raw[at[order] + d + k].astype(np.uint64)
        head = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        sizes = np.diff(np.append(head, len(cls)))
        group = np.repeat(np.arange(len(head)), sizes)
        split = np.zeros(len(head), bool)
        split[group[digit != digit[head][group]]] = True
        if split.any():
            some = np.flatnonzero(split[group])
            place = some[np.lexsort((digit[some], cls[some]))]
            order[some], digit[some] = order[place], digit[place]       # classes stay where they are
            cls = np.cumsum(np.concatenate([[True], (cls[1:] != cls[:-1]) | (digit[1:] != digit[:-1])]))
            order, cls = leave(order, cls)
    return order, cls


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window number in it) of every window."""
    piece = np.repeat(np.arange(len(sizes)), sizes)
    return piece, np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sort_bucket(table: pa.Table, depth: int) -> pa.Table:
    """Marked windows of a bucket: (ord, uid, first, last) of runs of starts."""
    known = pc.equal(pc.binary_length(table["piece"]), 0)
    marked, table = table.filter(known).select([*_ROW, "first", "last"]), table.filter(pc.invert(known))
    h = table["h"].to_numpy()
    keys = [table[c].to_numpy() for c in _ROW]
    first, shift = table["first"].to_numpy(), table["shift"].to_numpy()
    body = pa.concat_arrays([pa.array([], pa.binary()), *(c.cast(pa.binary()) for c in table["piece"].chunks)])
    # by gram, then earliest first; equal rows of one document once
    order = np.lexsort((first, *keys[::-1], h))
    fresh = np.ones(len(order), bool)
    same = lambda x: x[order][1:] == x[order][:-1]
    fresh[1:] = ~(same(h) & same(first) & np.logical_and.reduce([same(k) for k in keys]))
    order = order[fresh]
    edges = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin, sizes = edges[:-1][order].astype(np.int64), (edges[1:] - edges[:-1])[order].astype(np.int64) - depth + 1
    h, first, shift, keys = h[order], first[order].astype(np.int64), shift[order].astype(np.int64), [k[order] for k in keys]
    gram = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])[gram]
    out, lo = [], 0
    while lo < len(gram) - 1:                          # whole grams, about SLICE_WINDOWS windows together
        hi = int(np.searchsorted(before, before[lo] + SLICE_WINDOWS, "right")) - 1
        hi = min(max(hi, lo + 1), len(gram) - 1)
        a, z = gram[lo], gram[hi]
        piece, number = _windows(sizes[a:z])
        piece += a
        distance = shift[piece] - number               # from the window's start to its gram
        code = np.cumsum(np.concatenate([[0], h[a + 1:z] != h[a:z - 1]]))[piece - a]
        left, cls = radix_classes(data, begin[piece] + number, code * (depth + 1) + distance, depth)
        if len(left):
            # pieces are in document order and a document's in text order: the least index is the earliest
            by = np.lexsort((left, cls))
            left, cls = left[by], cls[by]
            late = np.sort(left[1:][cls[1:] == cls[:-1]])
            start = first[piece[late]] + number[late]
            out.append(_runs(piece[late], start, start)[:3])
        lo = hi
    row, lo_, hi_ = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    found = pa.table([*(k[row] for k in keys), lo_.astype(np.int32), hi_.astype(np.int32)], names=marked.column_names)
    return pa.concat_tables([marked.cast(found.schema), found])


def _crowded(pieces: DataFrame, depth: int) -> DataFrame:
    """Marked windows of grams with too many occurrences for one task, window by window."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(3).to_pylist()
            for lo in range(0, len(body), 2000):
                part = body[lo:lo + 2000]
                sizes = np.array([len(p) - depth + 1 for p in part], np.int64)
                piece, number = _windows(sizes)
                base = np.concatenate([[0], np.cumsum([len(p) for p in part])])[:-1]
                raw = np.frombuffer(b"".join(part), np.uint8)
                windows = np.lib.stride_tricks.sliding_window_view(raw, depth)[base[piece] + number]
                take = pa.array(piece + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.FixedSizeBinaryArray.from_buffers(pa.binary(depth), len(piece), [None, pa.py_buffer(np.ascontiguousarray(windows))]).cast(pa.binary()),
                     *(b.column(k).take(take) for k in range(2)),
                     pa.array((b.column(2).to_numpy()[piece + lo] + number).astype(np.int32))], ["w", *_ROW, "first"])

    at = F.struct(*_ROW, "first")
    known = F.octet_length("piece") == 0
    rows = (pieces.filter(~known).select(*_ROW, "first", "piece")
            .mapInArrow(explode, "w binary, ord long, uid long, first int").withColumn("at", at))
    least = rows.groupBy("w").agg(F.min("at").alias("least"))
    return (rows.join(least, "w").filter(F.col("at") > F.col("least"))
            .select(*_ROW, "first", F.col("first").alias("last")).distinct()
            .unionByName(pieces.filter(known).select(*_ROW, "first", "last")))


def _remove(rows: DataFrame, depth: int, row_type: str) -> DataFrame:
    """The rows with the bytes under marked windows taken out of ``bytes``."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ord_, texts, row, marks = (b.column(k) for k in (0, 2, 3, 4))
            kept, sizes, spans = [], [], []
            for t, m, o in zip(texts.to_pylist(), marks.to_pylist(), ord_.to_pylist()):
                parts, at, n = [], 0, 0
                for lo, hi in sorted((x["first"], x["last"] + depth) for x in m or () if x["ord"] == o):
                    if lo > at or not n:
                        parts.append(t[at:lo])
                        n += 1
                    at = max(at, hi)
                kept.append(b"".join(parts) + t[at:])
                sizes.append(len(t))
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()), pa.array(spans, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(clean, f"row {row_type}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, digit: int = DIGIT, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) in place of the text, and
    ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    digit = min(digit, depth)
    keyed = _keyed(docs, id_col, text)
    size = keyed.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    copies = _copies(keyed, depth)
    # other documents: equal uid and id (the subtraction keeps the join on uid alone, like the others below)
    alone = keyed.join(copies.select(F.col("uid").alias("copy"), F.col("ord").alias("copy_ord")),
                       (F.col("uid") == F.col("copy")) & (F.col("ord") - F.col("copy_ord") == 0), "left_anti")
    grams = _grams(alone.select(*_ROW, "bytes", "row"), depth, digit)
    counts = grams.groupBy("h").agg(F.sum("c").alias("n")).filter("n > 1")

    def around(seen: DataFrame) -> DataFrame:
        """Pieces around the grams of ``seen``; all uses of ``keyed`` share one exchange of the texts."""
        left = grams.select("h", "uid").join(seen.select("h"), "h").groupBy("uid").agg(F.collect_set("h").alias("hs"))
        return _pieces(keyed.join(left, "uid").select(*_ROW, "bytes", "hs", "row"), depth, digit, buckets)   # every column: one exchange

    def sort(table: pa.Table) -> pa.Table:
        return _sort_bucket(table, depth)

    marks = (around(counts.filter(F.col("n") <= crowd)).groupBy("bucket")
             .applyInArrow(sort, "ord long, uid long, first int, last int")
             .unionByName(_crowded(around(counts.filter(F.col("n") > crowd)), depth)))
    marks = marks.unionByName(copies).groupBy("uid").agg(F.collect_list(F.struct("ord", "first", "last")).alias("marks"))
    out = _remove(keyed.join(marks, "uid", "left").select(*_ROW, "bytes", "row", "marks"), depth, keyed.schema["row"].dataType.simpleString())
    new = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != text and c.lower() not in new), *new)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Counts and hash of what stays of every document."""
    return dedup(docs.select(id_col, text), id_col, text, **options).drop("kept")


def digest_sql(depth: int = DEPTH) -> str:
    """The digest as DuckDB SQL over ``documents`` (ids that tell rows apart)."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, b[p:p + {depth - 1}] AS s
      FROM (SELECT doc_id, b, unnest(range(1, n - {depth - 2})) AS p FROM d WHERE n >= {depth})),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w),
r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f WHERE k > 1),
g AS (SELECT doc_id, sum(CASE WHEN q IS NULL OR p > q + {depth} THEN 1 ELSE 0 END) AS n_spans,
             sum(CASE WHEN q IS NULL OR p >= q + {depth} THEN {depth} ELSE p - q END) AS n_removed,
             list(struct_pack(a := coalesce(q + {depth}, 1), z := p - 1) ORDER BY p) FILTER (WHERE p > coalesce(q + {depth}, 1)) AS gaps,
             max(p) + {depth} AS tail
      FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN g.doc_id IS NULL THEN sha256(b)
            ELSE sha256(unhex(concat(coalesce(array_to_string([hex(b[x.a:x.z]) FOR x IN gaps], ''), ''), hex(b[g.tail:])))) END AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
