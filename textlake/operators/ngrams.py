"""N-gram models, lexicon sentiment, log scoring and character TF-IDF
(AGG-04, TXT-01..05, FLT-05).

All are explode -> join -> groupBy plans.  Token tables (lexicon, tags,
n-gram model) grow with the corpus, so no side is forced to broadcast:
AQE broadcasts them when their measured size is under the threshold and
otherwise runs a shuffled join with skew splitting (a word like "the" is a
hot key).
"""

from __future__ import annotations

import uuid
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import shared as SH
from textlake.session import checkpoint_dir

UNSEEN_LOG_PROB = -100.0    # fixed value: score of an unseen gram
SENTIMENT_ALPHA = 15.0          # fixed value: compound = s / sqrt(s^2 + alpha)
GRAMS_A_ROW = 200_000       # grams of a packed row, and of the rows a task hands on at once
GRAM_GROUP = 8 << 20        # bytes of a row group of packed rows
GRAM_UNIT = 1 << 22         # characters of a unit of texts; inputs of no more than that are joined by gram
LEAST_UNITS = 64            # smaller inputs are dealt to as many units, if these hold LEAST_CHARS
LEAST_CHARS = 1 << 17
ROWS_A_BATCH = 200_000      # rows (key, gram, weight) a task hands on at once
BEST_ROWS = 1 << 21         # rows whose largest weights a task takes at once
CHAR_WS_RE = r"[ \t\n\r\f\x0B]{2,}"


def ngram_model(df: DataFrame, col: str, norm: bool = True) -> DataFrame:
    """AGG-04: (ngram, count, freq) over an array-of-grams column; freq is
    count / total grams (total as a scalar subquery)."""
    c = df.select(F.explode(col).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))
    if not norm:
        return c.withColumn("freq", F.col("count").cast("double"))
    # the total reads the same counts: keep them (small next to the text)
    # instead of running the text pipeline a second time for the subquery
    from pyspark import StorageLevel
    c = c.persist(StorageLevel.MEMORY_AND_DISK)
    total = c.agg(F.sum("count")).first()[0] or 0
    return c.withColumn("freq", F.col("count") / F.lit(float(total)))


def filter_by_tag(df: DataFrame, key: str, col: str, tags: DataFrame, keep: list[str]) -> DataFrame:
    """FLT-05: keep tokens whose tag is in ``keep`` and rejoin them as text.

    Tags come from a (token, tag) table; order is kept by position."""
    words = F.filter(F.split(F.col(col), " ", -1), lambda w: w != "")
    ex = df.select(key, F.posexplode_outer(words).alias("pos", "token"))
    t = tags.filter(F.col("tag").isin(keep)).select("token").distinct().withColumn("_kept", F.lit(True))
    # a left join and one ordered collect: rows that keep no token need no second read
    j = ex.join(t, "token", "left")
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_kept"), F.struct("pos", "token")))).alias("_s"))
    return g.select(key, F.array_join(F.transform("_s", lambda s: s["token"]), " ").alias("text"))


def lexicon_sentiment(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """TXT-01: lexicon valence per text.  Every word token gets its valence
    (0 when not listed); s = sum, compound = s / sqrt(s^2 + 15);
    pos / neg / neu shares as the rule-based scorer forms them."""
    ex = df.select(key, F.explode_outer(T.words(F.lower(F.col(col)))).alias("token"))
    j = ex.join(lexicon.select("token", "valence"), "token", "left")
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    real = F.col("token").isNotNull()
    g = j.groupBy(key).agg(
        F.sum(F.when(real, v).otherwise(0.0)).alias("_s"),
        F.sum(F.when(real & (v > 0), v + 1).otherwise(0.0)).alias("_ps"),
        F.sum(F.when(real & (v < 0), v - 1).otherwise(0.0)).alias("_ns"),
        F.sum(F.when(real & (v == 0), 1.0).otherwise(0.0)).alias("_nu"))
    total = F.col("_ps") + F.abs(F.col("_ns")) + F.col("_nu")
    s = F.col("_s")
    return g.select(
        key,
        F.when(s == 0, 0.0).otherwise(s / F.sqrt(s * s + SENTIMENT_ALPHA)).alias("compound"),
        F.coalesce(F.try_divide(F.col("_ps"), total), F.lit(0.0)).alias("pos"),
        F.coalesce(F.try_divide(F.col("_nu"), total), F.lit(0.0)).alias("neu"),
        F.coalesce(F.try_divide(F.abs(F.col("_ns")), total), F.lit(0.0)).alias("neg"))


def lm_score(df: DataFrame, key: str, col: str, model: DataFrame, n: int = 1) -> DataFrame:
    """TXT-02: log probability of clean_sentence(text) under the n-gram
    model; an unseen gram scores -100, a text without grams 0."""
    grams = T.get_tokens(T.clean_sentence(F.col(col)), n)
    ex = df.select(key, F.explode_outer(grams).alias("ngram"))
    j = ex.join(model.select("ngram", "freq"), "ngram", "left")
    lp = F.when(F.col("ngram").isNull(), 0.0).otherwise(F.coalesce(F.ln("freq"), F.lit(UNSEEN_LOG_PROB)))
    return j.groupBy(key).agg(F.sum(lp).alias("log_prob"))


def _joiner(k: int):
    return lambda s: F.concat(*[s[str(j)] for j in range(k)])


def char_grams(text: Column, minn: int = 3, maxn: int = 7) -> Column:
    """Character n-grams minn..maxn of a text (every start, every length).

    The text is cut once into code points; grams of length k are a zip of k
    shifted slices, so the work is linear in the text length (a positional
    substring on a long UTF-8 string would rescan it for every gram)."""
    def body(chars):
        L = F.size(chars)
        per_len = []
        for k in range(minn, maxn + 1):
            m = F.greatest(L - k + 1, F.lit(0))
            z = F.arrays_zip(*[F.slice(chars, j + 1, m) for j in range(k)])
            per_len.append(F.transform(z, _joiner(k)))
        return F.concat(*per_len)
    return T.let(F.regexp_extract_all(text, F.lit("(?s)."), 0), body)


def _packed_grams(key: str, minn: int, maxn: int):
    """Arrow task: rows (key, _t) with equal keys side by side -> (key, grams, tf), a key's distinct
    grams and their counts, in rows of at most ``GRAMS_A_ROW``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, pa.string())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf, pa.int32()))], [key, "grams", "tf"])
            keys.clear(), grams.clear(), tf.clear(), ends.__setitem__(slice(None), [0])
            return batch

        def pack(k, counts):
            items = list(counts.items())
            for lo in range(0, len(items), GRAMS_A_ROW):
                part = items[lo:lo + GRAMS_A_ROW]
                keys.append(k)
                grams.extend(g for g, _ in part)
                tf.extend(c for _, c in part)
                ends.append(len(grams))
                if len(grams) >= GRAMS_A_ROW:
                    yield flush()

        keys, grams, tf, ends, counts, open_key, key_type = [], [], [], [0], Counter(), None, None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != open_key:
                    yield from pack(open_key, counts)
                    counts, open_key = Counter(), k
                for n in range(minn, min(maxn, len(t or "")) + 1):
                    counts.update(map(t.__getitem__, map(slice, range(len(t) - n + 1), range(n, len(t) + 1))))
        yield from pack(open_key, counts)
        if keys:
            yield flush()
    return run


class Grams:
    """Grams ``minn``..``maxn`` of texts over the sorted code points ``alphabet`` as numbers, shorter ones first; as byte
    strings of equal length, if a number has too few bits for ``maxn`` characters.  Exact: no two grams share a key."""

    def __init__(self, alphabet: list[int], minn: int, maxn: int):
        self.minn, self.maxn, self.bits = minn, maxn, max(len(alphabet).bit_length(), 1)
        self.numbers = self.bits * maxn <= 63
        self.points = np.array([0, *alphabet], np.uint32)
        self.place = np.zeros(int(self.points.max()) + 1, np.int64)
        self.place[self.points[1:]] = np.arange(1, len(self.points))
        self.ascii = not len(alphabet) or alphabet[-1] < 128
        self.widths = 1 + (self.points > 0x7F).astype(np.int64) + (self.points > 0x7FF) + (self.points > 0xFFFF)
        # else digits 1..255 in bytes, which don't end in zeros
        self.digits = 1 if len(self.points) <= 255 else 2 if len(self.points) <= 255 ** 2 else 3

    def of(self, texts: list[str]) -> np.ndarray:
        """Keys of all grams of the texts, sorted."""
        made = []
        for t in texts:
            c = self.place[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
            if self.numbers:
                k = c
                for n in range(1, min(self.maxn, len(c)) + 1):
                    if n > 1:
                        k = (k[:len(c) - n + 1] << self.bits) | c[n - 1:]
                    if n >= self.minn:
                        made.append(k)
            else:
                w = self.digits
                raw = np.stack([c // 255 ** (w - 1 - i) % 255 + 1 for i in range(w)], 1).astype(np.uint8).ravel()
                for n in range(self.minn, min(self.maxn, len(c)) + 1):
                    rows = np.zeros((len(c) - n + 1, self.maxn * w), np.uint8)
                    rows[:, :n * w] = np.lib.stride_tricks.sliding_window_view(raw, n * w)[::w]
                    made.append(rows.view(f"S{self.maxn * w}").ravel())
        keys = np.concatenate(made) if made else np.empty(0, np.int64 if self.numbers else f"S{self.maxn * self.digits}")
        keys.sort()
        return keys

    def _lengths(self, keys: np.ndarray) -> np.ndarray:
        """Lengths of the grams of keys."""
        if self.numbers:
            return np.searchsorted(np.array([1 << (self.bits * n) for n in range(self.maxn)], np.int64), keys, "right")
        return (keys.view(np.uint8).reshape(len(keys), -1) > 0).sum(1) // self.digits

    def bucket(self, keys: np.ndarray, n: int) -> np.ndarray:
        """A bucket of ``n`` by a hash of the first ``minn`` characters: neighbours stay together."""
        if self.numbers:
            h = (keys >> (self.bits * (self._lengths(keys) - self.minn))).astype(np.uint64)
        else:
            h = np.zeros(len(keys), np.uint64)
            for c in keys.view(np.uint8).reshape(len(keys), -1)[:, :self.minn * self.digits].T:
                h = h * np.uint64(0x100000001B3) + c
        return (_spread_bits(h) % np.uint64(n)).astype(np.int64)

    def strings(self, keys: np.ndarray) -> pa.Array:
        """The grams of keys."""
        data, ends, length = [], [], self._lengths(keys)
        for lo in range(0, len(keys), 1 << 18):
            some, n = keys[lo:lo + (1 << 18)], length[lo:lo + (1 << 18)]
            if self.numbers:
                codes = some[:, None] >> (self.bits * np.maximum(n[:, None] - 1 - np.arange(self.maxn), 0)) & ((1 << self.bits) - 1)
            else:
                raw = some.view(np.uint8).reshape(len(some), self.maxn, self.digits).astype(np.int64)
                codes = sum((raw[:, :, i] - 1) * 255 ** (self.digits - 1 - i) for i in range(self.digits))
            real = np.arange(self.maxn) < n[:, None]
            points = self.points[codes[real]]
            data.append(points.astype(np.uint8).tobytes() if self.ascii else points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
            ends.append(n if self.ascii else np.where(real, self.widths[np.where(real, codes, 0)], 0).sum(1))
        offsets = np.r_[0, np.cumsum(np.concatenate(ends))] if ends else np.zeros(1)
        return pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(data)))

    def packed(self, keys: np.ndarray) -> bytes:
        """Sorted keys, compressed."""
        return SH.squeezed(np.diff(keys, prepend=0).astype(np.uint64) if self.numbers else keys)

    def unpacked(self, raw: bytes, n: int) -> np.ndarray:
        if self.numbers:
            return np.cumsum(SH.swollen(raw, n, np.uint64)).astype(np.int64)
        return SH.swollen(raw, n, f"S{self.maxn * self.digits}")


def _spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and how often each stands."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows with equal ``_unit`` (the first column) side by side -> those of every unit."""
    open_unit, held = None, []
    for b in batches:
        unit = b.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)] if len(unit) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and unit[lo] != open_unit:
                yield open_unit, pa.Table.from_batches(held)
                held = []
            open_unit = int(unit[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield open_unit, pa.Table.from_batches(held)


class _Unit:
    """The texts of a unit, equal keys side by side: per key (``firsts``: its first row) the distinct grams and their
    counts; of the unit the distinct grams, the keys that hold each, and their order by bucket."""

    def __init__(self, texts: pa.Table, grams: Grams, buckets: int):
        names, pieces = texts.column(1).to_pylist(), texts.column(2).to_pylist()
        self.firsts = [i for i, k in enumerate(names) if not i or k != names[i - 1]]
        self.docs = [_runs(grams.of([t for t in pieces[lo:hi] if t])) for lo, hi in zip(self.firsts, [*self.firsts[1:], len(names)])]
        every = np.concatenate([k for k, _ in self.docs])
        every.sort()
        self.keys, self.held = _runs(every)
        of = grams.bucket(self.keys, buckets)
        self.order = np.argsort(of.astype(np.uint16) if buckets < 1 << 16 else of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=buckets))
        self.cuts = {b: slice(int(hi - n), int(hi)) for b, (hi, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n}


def _unit_counts(grams: Grams, buckets: int):
    """Arrow task: texts by unit (_unit, key, _t) -> (_unit, _b, n, keys, held): the unit's distinct grams of a bucket
    and how many keys hold each, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts in _units(batches):
            unit = _Unit(texts, grams, buckets)
            rows = [(b, at.stop - at.start, grams.packed(unit.keys[unit.order[at]]), SH.squeezed(unit.held[unit.order[at]].astype(np.uint32)))
                    for b, at in unit.cuts.items()]
            for lo in range(0, len(rows), 256):
                b, n, keys, held = zip(*rows[lo:lo + 256])
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(b), pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64()),
                                                  pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["_unit", "_b", "n", "keys", "held"])
    return run


def _bucket_df(grams: Grams):
    """Arrow task: what the units have of a bucket -> (_unit, _b, n, df): the document frequencies of each unit's grams in their order."""
    def run(rows: pa.Table) -> pa.Table:
        sizes, out = rows["n"].to_pylist(), []
        keys = np.concatenate([grams.unpacked(k, n) for k, n in zip(rows["keys"].to_pylist(), sizes)])
        held = np.concatenate([SH.swollen(h, n, np.uint32) for h, n in zip(rows["held"].to_pylist(), sizes)])
        order = np.argsort(keys, kind="stable")
        head = np.r_[True, keys[order][1:] != keys[order][:-1]]
        df = np.empty(len(keys), np.uint32)
        df[order] = np.add.reduceat(held[order].astype(np.int64), np.flatnonzero(head))[np.cumsum(head) - 1]
        for n, lo in zip(sizes, np.cumsum([0, *sizes])):
            out.append(SH.squeezed(df[lo:lo + n]))
        return rows.select(["_unit", "_b", "n"]).append_column("df", pa.array(out, pa.binary()))
    return run


def _unit_weights(grams: Grams, buckets: int, n_docs: int, key: str):
    """Arrow task: by unit its texts and the document frequencies of its grams (_unit, key, _t, _b, n, df) -> (key, gram, weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _units(batches):
            is_text = pc.is_null(rows["_b"])
            texts, found = rows.filter(is_text), rows.filter(pc.invert(is_text))
            unit = _Unit(texts, grams, buckets)
            df = np.zeros(len(unit.keys), np.int64)
            for b, n, raw in zip(*(found[c].to_pylist() for c in ("_b", "n", "df"))):
                df[unit.order[unit.cuts[b]]] = SH.swollen(raw, n, np.uint32)
            idf, words, names = np.log((1 + n_docs) / (1 + df)) + 1, grams.strings(unit.keys), texts.column(1).combine_chunks()
            names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
            at, weight, of, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                batch = pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(of, [len(x) for x in at]))), words.take(pa.array(np.concatenate(at))),
                                                    pa.array(np.concatenate(weight))], [key, "gram", "weight"])
                at.clear(), weight.clear(), of.clear()
                return batch
            for first, (keys, tf) in zip(unit.firsts, unit.docs):
                place = np.searchsorted(unit.keys, keys)
                w = tf * idf[place]
                w = w / np.sqrt((w * w).sum())
                for lo in range(0, len(keys), ROWS_A_BATCH):
                    at.append(place[lo:lo + ROWS_A_BATCH]), weight.append(w[lo:lo + ROWS_A_BATCH]), of.append(first)
                    size += len(at[-1])
                    if size >= ROWS_A_BATCH:
                        yield made()
                        size = 0
            if at:
                yield made()
    return run


def _code_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: texts (_t) -> the number of rows and characters and the distinct code points of a task."""
    rows, size, met = 0, 0, np.zeros(0x110000, bool)
    for b in batches:
        rows += len(b)
        for lo in range(0, len(b), 256):
            points = np.frombuffer("".join(t or "" for t in b.column(0).slice(lo, 256).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            size += len(points)
            met[points] = True
    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([size]), pa.array([np.flatnonzero(met).astype(np.int32)], pa.list_(pa.int32()))], ["rows", "size", "points"])


def char_tfidf(df: DataFrame, key: str, col: str, minn: int = 3, maxn: int = 7) -> DataFrame:
    """TXT-04: long-form TF-IDF (key, gram, weight) of character n-grams of
    the lower-cased text with blank runs squeezed; smooth idf
    ln((1+N)/(1+df)) + 1 and L2 row norm.  Rows with one key count as one text; a null text has no grams.

    The clean texts are stored once and dealt by key to units of about ``GRAM_UNIT`` characters.  A unit sends the distinct grams of
    all its texts, with the number of texts that hold each, as packed sorted keys; they are added up by bucket, and the
    unit gets the document frequencies back in the same order.  So nothing is sent for a (text, gram); the weights are
    made where the texts are.  Inputs of up to one unit are joined by gram (``_joined_tfidf``)."""
    spark, key_type = df.sparkSession, dict(df.dtypes)[key]
    folder = SH.folder(spark, "texts")
    df.select(key, F.regexp_replace(F.lower(F.col(col)), CHAR_WS_RE, " ").alias("_t")).write.option("compression", "zstd").option(
        "parquet.block.size", str(GRAM_GROUP)).parquet(folder)
    texts = spark.read.schema(f"`{key}` {key_type}, _t string").parquet(folder)
    tasks = texts.select("_t").mapInArrow(_code_points, "rows long, size long, points array<int>").agg(
        F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("points")))).alias("points")).first()
    n_docs, size = tasks["rows"] or 0, tasks["size"] or 0
    if size <= GRAM_UNIT:
        return _joined_tfidf(texts, key, n_docs, minn, maxn)
    grams = Grams(tasks["points"], minn, maxn)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = buckets = max(1, min(LEAST_UNITS, size // LEAST_CHARS), -(-size // GRAM_UNIT))
    numbers = SH.even_numbers(spark, units, parts)
    dealt = texts.withColumn("_k", F.pmod(F.xxhash64(key), F.lit(units)).cast("int")).join(F.broadcast(numbers), "_k").select("_unit", key, "_t")
    with SH.files_dropped(spark):
        counts = dealt.repartition(parts, "_unit").sortWithinPartitions("_unit", key).mapInArrow(
            _unit_counts(grams, buckets), "_unit int, _b int, n long, keys binary, held binary")
        found = counts.groupBy("_b").applyInArrow(_bucket_df(grams), "_unit int, _b int, n long, df binary").checkpoint(eager=True)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("_b", "int"), ("n", "long"), ("df", "binary"))]
    both = dealt.select("*", *none).unionByName(found.select("_unit", F.lit(None).cast(key_type).alias(key), F.lit(None).cast("string").alias("_t"), "_b", "n", "df"))
    both = both.repartition(parts, "_unit").sortWithinPartitions("_unit", "_b", key)
    return both.mapInArrow(_unit_weights(grams, buckets, n_docs, key), f"`{key}` {key_type}, gram string, weight double")


def _joined_tfidf(prep: DataFrame, key: str, n_docs: int, minn: int, maxn: int) -> DataFrame:
    """``char_tfidf`` of clean texts (key, _t) by a join on the gram.

    A text becomes grams once: a task counts those of its texts into packed rows (grams and
    counts), written to the shared checkpoint folder; the document frequencies read its gram column, the
    weights all of it."""
    # the texts are dealt by key before they become grams (about 30 times
    # their size), so counting grams per text needs no further exchange
    spark = prep.sparkSession
    prep = prep.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    key_type = dict(prep.dtypes)[key]
    packed = prep.mapInArrow(_packed_grams(key, minn, maxn), f"{key} {key_type}, grams array<string>, tf array<int>")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    # Spark's reader puts up to 4,096 packed rows side by side, but no more than a row group holds: small row
    # groups bound the grams in a task's memory, whatever the texts' sizes
    packed.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(GRAM_GROUP)).option(
        "parquet.page.size.row.check.min", "1").parquet(folder)
    packed = spark.read.parquet(folder)
    tf = packed.select(key, F.explode(F.arrays_zip("grams", "tf")).alias("_g")).select(
        key, F.col("_g.grams").alias("gram"), F.col("_g.tf").alias("tf"))
    dfreq = packed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # df per gram: aggregate + join (a gram found in every document is a hot
    # key; AQE splits that join partition)
    w = tf.join(dfreq, "gram").withColumn(
        "w", F.col("tf") * (F.ln((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1))
    # row norm: a window per document (bounded by the document's own grams),
    # one shuffle instead of an aggregate plus a join
    from pyspark.sql import Window
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "gram", (F.col("w") / norm).alias("weight"))


def _bucket_of(grams: pa.Array, n: int) -> np.ndarray:
    """A bucket of ``n`` by a hash of the first three bytes: neighbours stay together."""
    data = np.frombuffer(grams.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset:grams.offset + len(grams) + 1].astype(np.int64)
    h = np.zeros(len(grams), np.uint64)
    for i in range(3):
        at = ends[:-1] + i
        there = at < ends[1:]
        h = h * np.uint64(256)
        h[there] += data[at[there]]
    return (_spread_bits(h) % np.uint64(n)).astype(np.int64)


def _best_in_task(buckets: int):
    """Arrow task: (gram, weight) -> (_b, rows): the largest weight of the grams it meets, ``BEST_ROWS`` at a time, as
    compressed tables, one a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = None, [], 0

        def merged() -> pa.Table:
            t = pa.Table.from_batches(held).cast(pa.schema([("gram", pa.string()), ("weight", pa.float64())]))
            t = pa.concat_tables([t, best]) if best is not None else t
            return t.group_by("gram").aggregate([("weight", "max")]).rename_columns(["gram", "weight"])

        def sent() -> Iterator[pa.RecordBatch]:
            t = best.sort_by("gram").combine_chunks()
            of = _bucket_of(pa.concat_arrays(t["gram"].chunks), buckets)
            order = np.argsort(of, kind="stable")
            t, cuts = t.take(pa.array(order)), np.r_[0, np.flatnonzero(np.diff(of[order])) + 1, len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(t.slice(lo, hi - lo).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([of[order[lo]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_b", "rows"])

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= BEST_ROWS:
                best, held, size = merged(), [], 0
                if len(best) >= BEST_ROWS:
                    yield from sent()
                    best = None
        if size:
            best = merged()
        if best is not None and len(best):
            yield from sent()
    return run


def _best_of_bucket(records: pa.Table) -> pa.Table:
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in records["rows"]]
    return pa.concat_tables(tables).group_by("gram").aggregate([("weight", "max")]).rename_columns(["gram", "max_weight"])


def top_grams(tfidf: DataFrame) -> DataFrame:
    """TXT-05: largest weight per gram.  A task sends those of the grams it meets as compressed tables."""
    buckets = 4 * int(tfidf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(tfidf.dtypes)["gram"]
    best = tfidf.select("gram", F.col("weight").cast("double").alias("weight")).mapInArrow(_best_in_task(buckets), "_b int, rows binary")
    return best.groupBy("_b").applyInArrow(_best_of_bucket, f"gram {kind}, max_weight double")
