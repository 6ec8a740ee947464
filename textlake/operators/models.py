"""Model arguments, line features, word dropout and the Spark ML models
(STR-14, MDL-01 words only, MDL-06..10).  The classifier is in
``classifier.py``, sub-word embeddings are in ``embeddings.py``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import hashing as H
from textlake.operators.common import hash_share
from textlake.session import checkpoint_dir


@dataclass
class Args:
    """Training arguments; defaults follow the library's (supervised: lr 0.1,
    dim 100, epoch 5, min count 1, no char n-grams, softmax)."""
    model: str = "supervised"        # supervised | skipgram | cbow
    lr: float = 0.1
    dim: int = 100
    ws: int = 5
    epoch: int = 5
    min_count: int = 1
    min_count_label: int = 1
    neg: int = 5
    word_ngrams: int = 1
    bucket: int = 2_000_000
    minn: int = 0
    maxn: int = 0
    t: float = 1e-4
    label: str = "__label__"
    seed: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.word_ngrams <= 1 and self.maxn == 0:
            self.bucket = 0        # the library's rule: no hashed rows without n-grams


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
LINE_UNIT = 1 << 21      # tokens of a unit of lines; with sub-words an eighth
LINE_TILE = 1 << 8       # lines whose features are put together at once
WORD_CHUNK = 1 << 12     # words of a unit in a row


def whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _flat(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start: start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _coded_units(key: str, unit: int):
    """Arrow task: its lines in units of about ``unit`` tokens (a line stays whole): the lines as numbers of
    the unit's words (``_codes``), and those words with their counts, ``WORD_CHUNK`` a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, lines = TaskContext.get().partitionId() << 32, 0, []

        def coded() -> Iterator[pa.RecordBatch]:
            keys, toks = (pa.concat_arrays([x.column(i) for x in lines]) for i in (0, 1))
            of, flat = pc.list_parent_indices(toks), pc.list_flatten(toks)
            if flat.null_count:
                of, flat = of.filter(flat.is_valid()), flat.drop_null()
            made = flat.dictionary_encode()
            codes, words = made.indices, made.dictionary
            ends = np.r_[0, np.cumsum(np.bincount(of.to_numpy(), minlength=len(keys)))]
            n = np.bincount(codes.to_numpy(), minlength=len(words))
            firsts = np.arange(0, len(words), WORD_CHUNK, dtype=np.int32)
            cuts = pa.array(np.r_[firsts, len(words)].astype(np.int32))
            rows = [[keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), codes), None, None, None],
                    [None, None, pa.array(firsts), pa.ListArray.from_arrays(cuts, words), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int64)))]]
            types = [keys.type, pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
            for cols, size in zip(rows, (len(keys), len(firsts))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, number))] + [pa.nulls(size, t) if c is None else c.cast(t) for c, t in zip(cols, types)],
                    ["_unit", key, "_codes", "_first", "_words", "_counts"])

        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(1)), 0))     # by Spark it would cut the texts twice
            ends, lo = np.cumsum(pc.list_value_length(b.column(1)).to_numpy()), 0
            while lo < len(ends):
                before = ends[lo - 1] if lo else 0
                hi = min(len(ends), int(np.searchsorted(ends, before + unit - held)) + 1)
                lines.append(b.slice(lo, hi - lo))
                held, lo = held + ends[hi - 1] - before, hi
                if held >= unit:
                    yield from coded()
                    number, held, lines = number + 1, 0, []
        if lines:
            yield from coded()
    return run


def coded_lines(df: DataFrame, key: str, tokens: str, args: Args, unit: int | None = None) -> DataFrame:
    """The lines where they lie, in units of about ``unit`` tokens, whose words are numbered inside the unit:
    texts are cut into tokens once, and from here on a word stands once a unit.  One row a line
    (_unit, key, _codes) and rows of words (_unit, _first, _words, _counts); checkpointed, as numbers depend on the
    order of lines."""
    unit = unit or (LINE_UNIT // 8 if args.maxn > 0 else LINE_UNIT)
    checkpoint_dir(df.sparkSession)
    return df.select(key, tokens).mapInArrow(_coded_units(key, unit), f"_unit long, `{key}` {dict(df.dtypes)[key]}, _codes array<int>, "
                            "_first int, _words array<string>, _counts array<bigint>").checkpoint(eager=True)


def _unit_words(coded: DataFrame) -> DataFrame:
    """(_unit, code, word, n): the words of every unit."""
    rows = coded.filter(F.col("_words").isNotNull()).select("_unit", "_first", F.posexplode(F.arrays_zip("_words", "_counts")).alias("_pos", "_w"))
    return rows.select("_unit", (F.col("_first") + F.col("_pos")).alias("code"), F.col("_w._words").alias("word"), F.col("_w._counts").alias("n"))


def word_counts(coded: DataFrame) -> DataFrame:
    """(word, count) of coded lines: the counts of the units added up."""
    return _unit_words(coded).groupBy("word").agg(F.sum("n").alias("count"))


def _unit_features(key: str, args: Args, nwords: int):
    """Arrow task: the coded lines of a unit and the words they hold (code, ids, h, label, plain)
    -> (key, features, labels), in batches of lines."""
    def run(lines: pa.Table, words: pa.Table) -> pa.Table:
        words, lines, out = words.combine_chunks(), lines.combine_chunks(), []
        schema = pa.schema([lines.schema.field(key), ("features", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))])
        place = np.empty(len(words), np.int64)                 # a code stands once, from 0
        place[words["code"].to_numpy()] = np.arange(len(words))
        ids = whole(words["ids"])
        ids, starts, sizes = pc.list_flatten(ids).to_numpy(), ids.offsets.to_numpy()[:-1].astype(np.int64), pc.list_value_length(ids).to_numpy()
        starts = starts - (starts[0] if len(starts) else 0)
        h = words["h"].to_numpy().astype(np.int64).view(np.uint64)
        label, plain = words["label"].to_numpy(), words["plain"].to_numpy()
        for lo in range(0, len(lines), LINE_TILE):
            part = lines.slice(lo, LINE_TILE).combine_chunks()
            codes = whole(part["_codes"])
            of, at = pc.list_parent_indices(codes).to_numpy(), place[pc.list_flatten(codes).to_numpy()]
            word = plain[at]
            line, w = of[word], at[word]
            met = np.bincount(line, minlength=len(part))
            pairs = np.unique(np.stack([of[~word], label[at[~word]]], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            rows = [(line, sizes[w], _flat(ids, starts[w], sizes[w]))]
            gram = h[w]
            for n in range(2, args.word_ngrams + 1 if args.bucket > 0 else 2):
                m = len(line) - n + 1
                if m <= 0:
                    break
                same = line[:m] == line[n - 1:]
                gram = gram[:m] * np.uint64(H.NGRAM_MULT) + h[w][n - 1:]
                rows.append((line[:m][same], np.ones(int(same.sum()), np.int64), (gram[same] % np.uint64(args.bucket)).astype(np.int64) + nwords))
            of_f = np.concatenate([np.repeat(l, s) for l, s, _ in rows])
            order = np.argsort(of_f, kind="stable")
            feats = np.concatenate([v for _, _, v in rows])[order]
            f_ends = np.r_[0, np.cumsum(np.bincount(of_f, minlength=len(part)))]
            l_ends = np.r_[0, np.cumsum(np.bincount(pairs[:, 0], minlength=len(part)))]
            made = pa.RecordBatch.from_arrays(
                [whole(part[key]),
                 pa.ListArray.from_arrays(pa.array(f_ends.astype(np.int32)), pa.array(feats)),
                 pa.ListArray.from_arrays(pa.array(l_ends.astype(np.int32)), pa.array(pairs[:, 1]))], schema=schema)
            out.append(made.filter(pa.array(met > 0)))           # a line of labels alone has no features
        return pa.Table.from_batches(out, schema)
    return run


def coded_features(coded: DataFrame, key: str, vocab: DataFrame, args: Args, nwords: int) -> DataFrame:
    """STR-14 of ``coded_lines``: (key, features, labels).  A unit gets the ids of each word it holds once, and
    the lines are put together inside the task."""
    lines = coded.filter(F.col("_codes").isNotNull()).select(F.col("_unit").alias("_unit"), key, "_codes")
    held = _unit_words(coded).select("_unit", "code", "word")
    grams = args.word_ngrams > 1 and args.bucket > 0
    # sub-word ids and hashes, where they are needed, once per distinct word, not per occurrence
    made = grams or args.maxn > 0
    dw = (held.select("word").distinct() if made else held).join(vocab.select("word", F.col("id").alias("_vid")), "word", "left")
    sub = H.subword_ids(F.col("word"), F.col("_vid"), nwords, max(args.bucket, 1), args.minn, args.maxn) \
        if args.maxn > 0 else F.when(F.col("_vid").isNotNull(), F.array(F.col("_vid").cast("bigint"))).otherwise(
            F.array().cast("array<bigint>"))
    is_label = F.col("word").startswith(args.label)
    feat = dw.select(*([] if made else ["_unit", "code"]), "word", F.when(is_label, F.array().cast("array<bigint>")).otherwise(sub).alias("ids"),
                     (H.as_int32(H.fnv1a(F.col("word"))) if grams else F.lit(0)).cast("bigint").alias("h"),
                     F.coalesce(F.col("_vid") - nwords, F.lit(-1)).cast("bigint").alias("label"), (~is_label).alias("plain"))
    words = (held.join(feat, "word") if made else feat).drop("word")
    return lines.groupBy("_unit").cogroup(words.groupBy("_unit")).applyInArrow(
        _unit_features(key, args, nwords), f"`{key}` {dict(coded.dtypes)[key]}, features array<bigint>, labels array<bigint>")


def line_features(df: DataFrame, key: str, tokens: str, vocab: DataFrame, args: Args, nwords: int,
                  unit: int | None = None) -> DataFrame:
    """STR-14: per line (one row a key) the feature row ids (word id or its sub-words;
    unknown words give their sub-words) followed by word n-gram buckets,
    and the label ids.  Order is kept."""
    return coded_features(coded_lines(df, key, tokens, args, unit), key, vocab, args, nwords)


# ---------------------------------------------------------------------------
# MDL-07 word dropout
# ---------------------------------------------------------------------------
def word_dropout(df: DataFrame, key: str, tokens: str, rate: float, seed: int) -> DataFrame:
    """Whole tokens dropped with chance ``rate`` (clamped to 0..1), no
    rescale; repeatable by md5(seed || key || position)."""
    rate = min(1.0, max(0.0, rate))

    def stays(_, pos):
        return hash_share(seed, F.concat_ws(":", F.col(key).cast("string"), pos.cast("string"))) >= rate

    return df.select(key, F.coalesce(F.filter(F.col(tokens), stays), F.array().cast("array<string>")).alias(tokens))


# ---------------------------------------------------------------------------
# Spark ML models: MDL-01 words-only, MDL-06, MDL-08, MDL-09, MDL-10, QNT-06
# ---------------------------------------------------------------------------
WORD2VEC_UNIT = 1 << 21      # tokens that one task of Word2Vec trains on


def word2vec(df: DataFrame, tokens: str, dim: int = 100, ws: int = 5, min_count: int = 5, seed: int = 0,
             max_iter: int = 1):
    """MDL-01 words only: Spark ML skip-gram (hierarchical softmax).  Up to ``WORD2VEC_UNIT``
    tokens are one task, as Spark ML has it; more are dealt to as many tasks as they need, whose
    vectors Spark ML averages.  The tasks follow the data, not the cluster."""
    from pyspark.ml.feature import Word2Vec
    n = df.agg(F.sum(F.size(tokens))).first()[0] or 0
    return Word2Vec(vectorSize=dim, windowSize=ws, minCount=min_count, seed=seed, inputCol=tokens, outputCol="vec",
                    maxIter=max_iter, numPartitions=max(1, -(-n // WORD2VEC_UNIT))).fit(df)


def dense_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(out, array_to_vector(F.col(vec)))


def train_dan(df: DataFrame, label: str, vec: str, hidden=(300, 300, 300), max_iter: int = 100, seed: int = 0):
    """MDL-06: averaged vectors -> hidden layers -> softmax.  ``hidden=()``
    is the no-hidden-layer bag model (multinomial logistic regression)."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    d = dense_features(df, vec)
    n_in = len(d.select(vec).first()[0])
    n_out = d.select(F.max(label)).first()[0] + 1
    if not hidden:
        return LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter).fit(d)
    layers = [n_in, *hidden, int(n_out)]
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers,
                                          maxIter=max_iter, seed=seed).fit(d)


def grid_search(df: DataFrame, label: str, vec: str, reg=(0.0, 0.01), iters=(10, 25), seed: int = 0):
    """MDL-08: parameter grid, 20 % validation split, best model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
    lr = LogisticRegression(featuresCol="features", labelCol=label)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.maxIter, list(iters)).build()
    tvs = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, trainRatio=0.8, seed=seed,
                               evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
                               parallelism=2)
    return tvs.fit(dense_features(df, vec))


def cluster(df: DataFrame, vec: str, k: int = 19, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """MDL-09: k-means, the cluster attached to every row (JOIN-08 by row)."""
    from pyspark.ml.clustering import KMeans
    d = dense_features(df, vec)
    m = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="features", predictionCol="cluster").fit(d)
    return m.transform(d).drop("features")


def project(df: DataFrame, vec: str, k: int = 3) -> tuple[DataFrame, list]:
    """MDL-10: first k principal components of the centred vectors, and the
    explained variance (ML's PCA does not centre the projection itself)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    d = dense_features(df, vec, "raw")
    sc = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="features").fit(d)
    c = sc.transform(d)
    m = PCA(k=k, inputCol="features", outputCol="pca").fit(c)
    out = m.transform(c).withColumn("pca", vector_to_array("pca")).drop("raw", "features")
    return out, list(m.explainedVariance.toArray())
