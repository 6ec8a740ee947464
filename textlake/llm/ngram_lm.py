"""LM scoring: interpolated modified Kneser-Ney bigram model.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end token a
text.  Counting is Spark work in three exchanges of packed, already summed
blocks (a task sums what it reads before it sends anything, so a hot word or
pair crosses once a task):

1. words, by hash range: distinct 64-bit hashes in order with their counts; a
   word's number is its place in that order;
2. pairs (context number << 32 | word number), by a hash of the context and
   four classes of the word, so a hot context is spread over tasks: distinct pairs in
   order with their counts, and how often each count is 1, 2, 3, 4;
3. per word: how often it is a context, with how many followers seen once, twice
   and more often, and after how many different contexts it stands.

Each task writes its part as plain sorted arrays into the model folder, a new
folder below the shared checkpoint folder (written under another name and then
renamed, so a repeated task does no harm).  Scoring workers memory-map the
arrays and look the n-grams of a batch up in sorted order, so a worker touches the
pages it needs and the model needn't fit into memory.  (A folder that can't
be mapped, such as an object store, is read by file instead.)

    p(w | v) = max(c(v, w) - D(c), 0) / c(v) + gamma(v) * p(w)
    p(w)     = max(n(w) - D'(n), 0) / n + gamma' / (V + 1)

with n(w) the number of different contexts of w, n their sum and D, D' the three
modified Kneser-Ney discounts of each order; an unknown word has n(w) = 0, an
unknown context leaves p(w).

Defined results
* null and empty texts are one end token;
* without training texts every token has probability 1 (log 0);
* repeated rows count as often as they occur and get equal scores;
* the word numbers are 32 bits: at most 2**32 - 2 different words.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import tokens as T
from textlake.llm.common import utf8
from textlake.session import checkpoint_dir

END = np.uint64(1)               # hash of the end token
FLUSH = 2_000_000                # tokens a task gathers before it sums them
LOOKUP_BYTES = 4 << 20           # text looked up at once
PAIRS_PER_SHARD = 4_000_000      # tokens a shard of the pair table stands for, at most
SPREAD = np.uint64(4)            # tasks over which a context is spread
WORD_BLOCK = 1 << 16             # word numbers in a block of the word table
WORD_ROW = np.dtype([("total", "<i8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("contexts", "<u4")])


# --- files ------------------------------------------------------------------

def _local(path: str) -> str | None:
    """The path that a worker can open, None for a store it can't map."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    data, path = np.ascontiguousarray(values), _local(folder)
    other = f"{name}.{uuid.uuid4().hex}"
    if path is None:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{root}/{other}") as f:
            f.write(data.tobytes())
        store.move(f"{root}/{other}", f"{root}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{other}", "wb") as f:
        data.tofile(f)
    os.replace(f"{path}/{other}", f"{path}/{name}")


def read_array(folder: str, name: str, kind) -> np.ndarray:
    path = _local(folder)
    if path is None:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{name}") as f:
            return np.frombuffer(f.read(), kind)
    file = f"{path}/{name}"
    return np.memmap(file, kind, "r") if os.path.getsize(file) else np.empty(0, kind)


# --- tokens -----------------------------------------------------------------

def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end tokens included, and the offsets of the texts."""
    parts, counts = [], []
    for lo, hi in T.chunks(texts):
        t = T.tokenize(texts[lo:hi], T.BLANK_SEPARATED)
        n = hi - lo
        seq = np.empty(len(t.hashes) + n, np.uint64)
        doc = np.repeat(np.arange(n), np.diff(t.off))
        seq[np.arange(len(t.hashes)) + doc] = t.hashes
        seq[t.off[1:] + np.arange(n)] = END
        parts.append(seq)
        counts.append(np.diff(t.off) + 1)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their total counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by hash range: a larger hash is never in a smaller shard."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (T.mix((keys >> np.uint64(32)) * SPREAD + keys % SPREAD) % np.uint64(shards)).astype(np.int64)


_BLOCKS = "shard int, ones binary, keys binary, counts binary"


def _pack(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: keys of count 1, and other keys with their counts."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    names, first = np.unique(shard, return_index=True)
    ones, more, numbers = [], [], []
    for a, b in zip(first, [*first[1:], len(shard)]):
        k, c = keys[a:b], counts[a:b]
        ones.append(k[c == 1].tobytes())
        more.append(k[c > 1].tobytes())
        numbers.append(c[c > 1].astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary()), pa.array(numbers, pa.binary())],
        names=["shard", "ones", "keys", "counts"])


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ones = np.frombuffer(b"".join(pdf["ones"]), np.uint64)
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(pdf["counts"]), np.int64)
    return summed(np.concatenate([ones, keys]), np.concatenate([np.ones(len(ones), np.int64), counts]))


# --- the model --------------------------------------------------------------

@dataclass
class Model:
    folder: str
    word_shards: int
    offsets: np.ndarray             # number of the first word of each shard
    n_tokens: int                   # training tokens
    n_words: int                    # distinct ones
    pair_shards: int = 0
    stored: np.ndarray | None = None   # which pair shards hold any pair
    n_pairs: int = 0
    discounts: list[float] = field(default_factory=lambda: [0.0, 0.5, 1.0, 1.5])
    word_discounts: list[float] = field(default_factory=lambda: [0.0, 0.5, 1.0, 1.5])
    word_gamma: float = 1.0


_open: dict[tuple, np.ndarray] = {}


def _mapped(model: Model, name: str, kind) -> np.ndarray:
    """An array of the model, mapped once per worker."""
    key = (model.folder, name)
    if key not in _open:
        if _open and next(iter(_open))[0] != model.folder:
            _open.clear()
        _open[key] = read_array(model.folder, name, kind)
    return _open[key]


def _by_shard(shard: np.ndarray):
    """Ranges of equal values of a sorted array."""
    names, first = np.unique(shard, return_index=True)
    return zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)])


def words_of(model: Model, h: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Word numbers of hashes (-1 for unknown ones) and their counts."""
    u, back = np.unique(h, return_inverse=True)
    ids, number = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
    if model.n_words:
        for s, a, b in _by_shard(range_shard(u, model.word_shards)):
            known = _mapped(model, f"word-{s}.keys", np.uint64)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, u[a:b]), len(known) - 1)
            hit = known[at] == u[a:b]
            ids[a:b][hit] = model.offsets[s] + at[hit]
            if counts:
                number[a:b][hit] = _mapped(model, f"word-{s}.counts", np.int64)[at[hit]]
    return ids[back], number[back] if counts else None


def _contexts(ids: np.ndarray, off: np.ndarray, start: int) -> np.ndarray:
    """Number of the token before each token; ``start`` at the beginning of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[off[:-1]] = start
    return before


def pairs_of(model: Model, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Training counts of pairs (0 for unknown ones)."""
    out = np.zeros(len(word), np.int64)
    both = np.flatnonzero((context >= 0) & (word >= 0))
    if not len(both) or not model.n_pairs:
        return out
    key = (context[both].astype(np.uint64) << np.uint64(32)) | word[both].astype(np.uint64)
    u, back = np.unique(key, return_inverse=True)
    shard = pair_shard(u, model.pair_shards)
    order = np.argsort(shard, kind="stable")
    found = np.zeros(len(u), np.int64)
    for s, a, b in _by_shard(shard[order]):
        if not model.stored[s]:
            continue
        keys = _mapped(model, f"pair-{s}.keys", np.uint64)
        mine = order[a:b]
        at = np.minimum(np.searchsorted(keys, u[mine]), len(keys) - 1)
        hit = keys[at] == u[mine]
        at, mine = at[hit], mine[hit]
        c = _mapped(model, f"pair-{s}.counts", np.uint8)[at].astype(np.int64)
        big = c == 255
        if big.any():
            where, number = _mapped(model, f"pair-{s}.where", np.int64), _mapped(model, f"pair-{s}.large", np.int64)
            c[big] = number[np.searchsorted(where, at[big])]
        found[mine] = c
    out[both] = found[back]
    return out


def word_rows(model: Model, ids: np.ndarray) -> np.ndarray:
    """Rows of the word table; zeros for -1 and for words never met as such."""
    u, back = np.unique(ids, return_inverse=True)
    rows = np.zeros(len(u), WORD_ROW)
    first = int(np.searchsorted(u, 0))
    for s, a, b in _by_shard(u[first:] // WORD_BLOCK):
        table = _mapped(model, f"table-{s}", WORD_ROW)
        rows[first + a:first + b] = table[u[first + a:first + b] - s * WORD_BLOCK]
    return rows[back]


def discounts(n: np.ndarray) -> list[float]:
    """Modified Kneser-Ney discounts [D0=0, D1, D2, D3+] from counts of counts 1 to 4.

    A discount that isn't strictly between 0 and its count (many threefold copies make D2 zero
    or less) would leave nothing for unseen words: half its count stands for it."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2, n3, n4) <= 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(x if 0.0 < x < k else k / 2 for k, x in enumerate(d, 1))]


def _texts(batch) -> list[bytes]:
    return batch.column(0).to_pylist()


def _count_words(texts: DataFrame, model: Model) -> None:
    shards, folder = model.word_shards, model.folder

    def count(batches):
        parts, size = [], 0
        for b in batches:
            h, _ = token_hashes(_texts(b))
            parts.append(h)
            size += len(h)
            if size >= FLUSH:
                k, c = summed(np.concatenate(parts))
                yield _pack(k, c, range_shard(k, shards))
                parts, size = [], 0
        if size:
            k, c = summed(np.concatenate(parts))
            yield _pack(k, c, range_shard(k, shards))

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        k, c = _unpack(pdf)
        write_array(folder, f"word-{s}.keys", k)
        write_array(folder, f"word-{s}.counts", c)
        return pd.DataFrame({"shard": [s], "words": [len(k)], "tokens": [int(c.sum())]})

    got = texts.mapInArrow(count, _BLOCKS).groupBy("shard").applyInPandas(store, "shard int, words long, tokens long").toPandas()
    words = np.zeros(shards, np.int64)
    words[got["shard"].to_numpy(np.int64)] = got["words"].to_numpy(np.int64)
    for s in np.flatnonzero(words == 0).tolist():
        write_array(folder, f"word-{s}.keys", np.empty(0, np.uint64))
        write_array(folder, f"word-{s}.counts", np.empty(0, np.int64))
    model.offsets = np.concatenate([[0], np.cumsum(words)[:-1]])
    model.n_words, model.n_tokens = int(words.sum()), int(got["tokens"].sum())


def _count_pairs(texts: DataFrame, model: Model) -> None:
    shards, folder = model.pair_shards, model.folder

    def count(batches):
        parts, size = [], 0
        for b in batches:
            ts = _texts(b)
            for lo, hi in T.chunks(ts, LOOKUP_BYTES):
                h, off = token_hashes(ts[lo:hi])
                ids, _ = words_of(model, h)
                before = _contexts(ids, off, model.n_words)
                parts.append((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                size += len(h)
                if size >= FLUSH:
                    k, c = summed(np.concatenate(parts))
                    yield _pack(k, c, pair_shard(k, shards))
                    parts, size = [], 0
        if size:
            k, c = summed(np.concatenate(parts))
            yield _pack(k, c, pair_shard(k, shards))

    def per_word(ids: np.ndarray, *values: np.ndarray):
        """Sums per distinct id, a row for each block of word numbers."""
        u, back = np.unique(ids, return_inverse=True)
        sums = [np.bincount(back, v, minlength=len(u)).astype(np.int64) for v in values]
        for s, a, b in _by_shard(u // WORD_BLOCK):
            yield s, (u[a:b] - s * WORD_BLOCK).astype(np.uint32).tobytes(), [v[a:b].astype(np.uint32).tobytes() for v in sums]

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        k, c = _unpack(pdf)
        large = np.flatnonzero(c >= 255)
        write_array(folder, f"pair-{s}.where", large)
        write_array(folder, f"pair-{s}.large", c[large])
        write_array(folder, f"pair-{s}.counts", np.minimum(c, 255).astype(np.uint8))
        write_array(folder, f"pair-{s}.keys", k)
        v, w = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # totals of a context within a shard may pass 32 bits: low and high part
        rows = [(b, "v", ids, [lo, hi, n1, n2, n3]) for b, ids, (lo, hi, n1, n2, n3)
                in per_word(v, c & 0xFFFFF, c >> 20, c == 1, c == 2, c >= 3)]
        rows += [(b, "w", ids, x) for b, ids, x in per_word(w, np.ones(len(w)))]
        of = [int((c == x).sum()) for x in (1, 2, 3, 4)]
        rows.append((-1, "n", np.array([s], np.uint32).tobytes(), [np.array([*of, len(k)], np.int64).tobytes()]))
        return pd.DataFrame(rows, columns=["block", "kind", "ids", "sums"])

    n_words = model.n_words

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["block"].iloc[0])
        if s < 0:
            n = sum(np.frombuffer(x[0], np.int64) for x in pdf["sums"])
            stored = np.frombuffer(b"".join(pdf["ids"]), np.uint32).tolist()
            return pd.DataFrame([("n", n.tolist()), ("stored", stored)], columns=["kind", "n"])
        size = min(WORD_BLOCK, n_words + 1 - s * WORD_BLOCK)
        table = np.zeros(size, WORD_ROW)

        def added(kind, k):
            part = pdf[pdf["kind"] == kind]
            ids = np.frombuffer(b"".join(part["ids"]), np.uint32)
            values = np.frombuffer(b"".join(x[k] for x in part["sums"]), np.uint32)
            return np.bincount(ids, values, minlength=size)

        table["total"] = added("v", 0) + added("v", 1) * (1 << 20)
        table["n1"], table["n2"], table["n3"] = added("v", 2), added("v", 3), added("v", 4)
        table["contexts"] = added("w", 0)
        write_array(folder, f"table-{s}", table)
        c = table["contexts"]
        return pd.DataFrame([("w", [int((c == x).sum()) for x in (1, 2, 3, 4)] + [int((c >= 3).sum())])], columns=["kind", "n"])

    part = (texts.mapInArrow(count, _BLOCKS).groupBy("shard")
            .applyInPandas(store, "block int, kind string, ids binary, sums array<binary>"))
    got = part.groupBy("block").applyInPandas(combine, "kind string, n array<long>").toPandas()
    n = np.zeros((2, 5), np.int64)
    model.stored = np.zeros(shards, bool)
    for kind, x in zip(got["kind"], got["n"]):
        if kind == "stored":
            model.stored[np.asarray(x, np.int64)] = True
        else:
            n[int(kind == "w")] += np.asarray(x, np.int64)
    if not n[0, 4]:
        return
    model.n_pairs = int(n[0, 4])
    model.discounts, model.word_discounts = discounts(n[0, :4]), discounts(n[1, :4])
    d = model.word_discounts
    model.word_gamma = (d[1] * n[1, 0] + d[2] * n[1, 1] + d[3] * n[1, 4]) / model.n_pairs


def train(docs: DataFrame, text: str = "text", shards: int | None = None, folder: str | None = None) -> Model:
    """Count the texts and write the model; ``shards``: parts of the word table,
    by default the shuffle partitions of the session."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder, shards, np.zeros(shards, np.int64), 0, 0)
    texts = docs.select(utf8(F.col(text)).alias("t"))
    _count_words(texts, model)
    if model.n_words >= (1 << 32) - 1:
        raise ValueError("more than 2**32 - 2 different words")
    model.pair_shards = max(shards, -(-model.n_tokens // PAIRS_PER_SHARD))
    _count_pairs(texts, model)
    return model


def scores(texts: list[bytes], model: Model) -> list[dict]:
    """Token counts, base and model log10 probability of each text."""
    out: list[dict] = []
    for lo, hi in T.chunks(texts, LOOKUP_BYTES):
        h, off = token_hashes(texts[lo:hi])
        ids, count = words_of(model, h, counts=True)
        first = off[:-1]
        base = np.log10((count + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))
        d, dw = np.array(model.discounts), np.array(model.word_discounts)
        if model.n_pairs:
            context = _contexts(ids, off, model.n_words)
            c = pairs_of(model, context, ids)
            n = word_rows(model, ids)["contexts"].astype(np.int64)
            p = (n - dw[np.minimum(n, 3)]) / model.n_pairs + model.word_gamma / (model.n_words + 1)
            row = word_rows(model, context)
            total = row["total"].astype(float)
            seen = total > 0
            gamma = d[1] * row["n1"] + d[2] * row["n2"] + d[3] * row["n3"]
            safe = np.where(seen, total, 1.0)
            p = np.where(seen, (c - d[np.minimum(c, 3)]) / safe + gamma / safe * p, p)
            own = np.add.reduceat(np.log10(p), first)
        else:
            own = np.zeros(hi - lo)
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        total_base = np.add.reduceat(base, first)
        out += [{"n_tokens": int(a), "n_known": int(b), "base_score": float(x), "score": float(y)}
                for a, b, x, y in zip(np.diff(off), known, total_base, own)]
    return out


_RESULT = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """``docs`` with a column ``out``: n_tokens, n_known, base_score, score
    (log10 probabilities) and perplexity; no shuffle."""

    @F.arrow_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
    def judge(t: pa.Array) -> pa.Array:
        return pa.array(scores(t.to_pylist(), model), _RESULT)

    return docs.withColumn(out, judge(utf8(F.col(text)))).withColumn(
        out, F.col(out).withField("perplexity", F.pow(F.lit(10.0), -F.col(out)["score"] / F.col(out)["n_tokens"])))


def train_and_score(docs: DataFrame, in_training: Column, text: str = "text", out: str = "lm") -> tuple[DataFrame, Model]:
    model = train(docs.filter(in_training), text)
    return score(docs, model, text, out), model
