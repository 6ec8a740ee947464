"""Softmax text classifier by distributed gradient steps (MDL-03, MDL-04,
MDL-05, MDL-11, QNT-06).

A line's hidden vector is the mean of its feature rows (words, sub-words, word
n-gram buckets); the label rows score it and softmax gives probabilities.
Training is a number of rounds over all lines; the feature rows never leave Spark:

1. lines are dealt once to units of about ``FIT_UNIT`` features (a line stays whole), and a round stores the
   feature rows once in the shared folder, where a unit reads those it needs;
2. the unit sums its lines' vectors, which meet the label rows, a table of (labels x dim) numbers that is
   broadcast, in tiles of labels;
3. it returns one gradient for each of its feature rows and each label row, packed, and those are summed per row.

So what is exchanged follows the distinct (unit, row) pairs, not features x dimension.

A row moves along its gradient summed over all lines, divided by the root of
the mean squares it has gathered so far (Adagrad with one number a row), times
a rate that depends on the round only.  Start values are a hash of seed, row
and dimension.  So the result doesn't depend on partitions, batches or the order of
lines, and text of any length counts in full.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from hashlib import md5
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import evaluation as EV
from textlake.operators import quant as QN
from textlake.operators import shared as SH
from textlake.operators import vectors as VE
from textlake.operators import vocab as V
from textlake.operators.common import dense_index
from textlake.operators.models import Args, coded_features, coded_lines, line_features, whole, word_counts
from textlake.session import checkpoint_dir

EPS = 1e-12


@dataclass
class Classifier:
    args: Args
    vocab: DataFrame             # (id, word, count, type)
    nwords: int
    input: DataFrame             # (row_id, vec): rows that training has moved or was given
    output: DataFrame            # (label_id, label, vec)
    shrunk: bool = False         # only the rows of ``input`` are features
    packed: QN.Packed | None = None      # the rows as codes; prediction reads these instead


def start_vector(row: Column, dim: int, seed: int) -> Column:
    """Values in [-1/dim, 1/dim) from md5(seed:row:block), 16 bits each: a digest makes eight."""
    blocks = range(-(-dim // 8))

    @F.arrow_udf("array<double>")
    def draw(rows: pa.Array) -> pa.Array:
        heads = [f"{seed}:" if r is None else f"{seed}:{r}:" for r in rows.to_pylist()]
        raw = b"".join(md5(f"{head}{b}".encode()).digest() for head in heads for b in blocks)
        bits = np.frombuffer(raw, ">u2").reshape(len(heads), 8 * len(blocks))[:, :dim].astype(np.float64)
        ends = pa.array(np.arange(len(heads) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(ends, pa.array(((bits / 65536.0 * 2 - 1) / dim).ravel()))
    return draw(row.cast("string"))


def start_vector_sql(row: str, dim: int, seed: int) -> str:
    return (f"list_transform(range({dim}), lambda i: (CAST('0x' || substr(md5('{seed}:' || CAST({row} AS VARCHAR) || ':' || "
            f"CAST(i // 8 AS VARCHAR)), CAST((i % 8) * 4 + 1 AS INTEGER), 4) AS BIGINT) / 65536.0 * 2 - 1) / {dim})")


def bags(lines: DataFrame, key: str) -> DataFrame:
    """(key, row_id, w): a line's features with their share of the line."""
    ex = lines.select(key, F.size("features").alias("_n"), F.explode("features").alias("row_id"))
    return ex.groupBy(key, "row_id").agg((F.count(F.lit(1)) / F.first("_n")).alias("w"))


def _columns(dim: int) -> list[str]:
    return [f"v{i}" for i in range(dim)]


def _spread(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    return df.select(*[c for c in df.columns if c != vec], *[F.col(vec)[i].alias(c) for i, c in enumerate(_columns(dim))])


LABEL_TILE = 4096
LINE_TILE = 1024         # lines whose gradients are taken at once
FIT_UNIT = 1 << 22       # features of a unit of lines


def _line_gradients(H: np.ndarray, line: np.ndarray, label: np.ndarray, share: np.ndarray, B: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gradients of the log likelihood by the line vectors ``H``; those by the label rows ``B`` are
    added to ``total``.  ``line``, ``label``, ``share``: the labels that the lines have."""
    top, norm = np.full(len(H), -np.inf), np.zeros(len(H))
    for lo in range(0, len(B), LABEL_TILE):
        z = H @ B[lo:lo + LABEL_TILE].T
        new = np.maximum(top, z.max(1))
        norm = norm * np.exp(top - new) + np.exp(z - new[:, None]).sum(1)
        top = new
    D = np.zeros_like(H)
    for lo in range(0, len(B), LABEL_TILE):
        tile = B[lo:lo + LABEL_TILE]
        d = -np.exp(H @ tile.T - top[:, None]) / norm[:, None]
        here = (label >= lo) & (label < lo + len(tile))
        np.add.at(d, (line[here], label[here] - lo), share[here])
        D += d @ tile
        total[lo:lo + LABEL_TILE] += d.T @ H
    return D


def _places(ids: np.ndarray):
    """Function: row ids -> their positions in ``ids`` (sorted, each once); by a table where ids lie dense."""
    if not len(ids) or ids[0] < 0 or ids[-1] >= 16 * len(ids) + FIT_UNIT:
        return lambda some: np.searchsorted(ids, some)
    table = np.zeros(int(ids[-1]) + 1, np.int32)
    table[ids] = np.arange(len(ids))
    return lambda some: table[some]


def _unit_step(labels, folder: str, files: list[str], key: str, dim: int):
    """Arrow task: the lines of a unit, whose feature rows it reads from ``files`` -> the gradients by those rows
    (kind 0) and by the label rows (kind 1), each summed over the unit, packed."""
    def run(lines: pa.Table) -> pa.Table:
        B, part = labels.value, int(lines["_unit"][0].as_py())
        lines = lines.sort_by(key).combine_chunks()
        ids, _, _, vec = SH.load(folder, files, dim, _once(pc.list_flatten(whole(lines["features"])).to_numpy()), "F")
        X = list(vec.T)
        total, moved, place = np.zeros_like(B), np.zeros((len(ids), dim), order="F"), _places(ids)
        for lo in range(0, len(lines), LINE_TILE):
            some = lines.slice(lo, LINE_TILE).combine_chunks()
            feats, own = whole(some["features"]), whole(some["labels"])
            n = pc.list_value_length(feats).to_numpy()
            of, at = np.repeat(np.arange(len(some)), n), place(pc.list_flatten(feats).to_numpy())
            w = (1.0 / n)[of]
            H = np.stack([np.bincount(of, w * x[at], len(some)) for x in X], 1)
            n = pc.list_value_length(own).to_numpy()
            D = _line_gradients(H, np.repeat(np.arange(len(some)), n), pc.list_flatten(own).to_numpy(), np.repeat(1.0 / n, n), B, total)
            for j in range(dim):
                moved[:, j] += np.bincount(at, w * D[of, j], len(ids))
        made = [*SH.packed_sums(0, part, ids, moved.T), *SH.packed_sums(1, part, np.arange(len(B)), total.T)]
        return pa.Table.from_batches(made, pa.schema(
            [("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary())]))
    return run


def _moved(df: DataFrame, by: str | list[str], dim: int, rate: float) -> DataFrame:
    """(by, v0.., g) and its gradient d0..: one step of every row."""
    square = sum((F.col(f"d{i}") * F.col(f"d{i}") for i in range(dim)), F.lit(0.0)) / dim
    df = df.withColumn("g", F.col("g") + F.coalesce(square, F.lit(0.0)))
    scale = rate / F.sqrt(F.col("g") + EPS)
    return df.select(*([by] if isinstance(by, str) else by), *[(F.col(c) + F.coalesce(F.col(f"d{i}"), F.lit(0.0)) * scale).alias(c)
                           for i, c in enumerate(_columns(dim))], "g")


def feature_ids(lines: DataFrame, *by: str) -> DataFrame:
    """(by, row_id): the feature rows of the lines, each about once a batch of lines with the same ``by`` (long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column(0).to_numpy() if by else np.zeros(len(b), np.int64)
            of, ids = group[pc.list_parent_indices(b.column(len(by))).to_numpy()], pc.list_flatten(b.column(len(by))).to_numpy()
            for g in np.unique(of):
                mine = _once(ids[of == g])
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(mine), g)) for _ in by], pa.array(mine)], [*by, "row_id"])
    return lines.select(*[F.col(c).cast("long").alias(c) for c in by], "features").mapInArrow(
        run, "".join(f"`{c}` long, " for c in by) + "row_id long")


def _once(ids: np.ndarray) -> np.ndarray:
    """The distinct ids; by marks where they lie dense."""
    if not len(ids) or ids.min() < 0 or ids.max() >= 16 * len(ids) + FIT_UNIT:
        return np.unique(ids)
    met = np.zeros(int(ids.max()) + 1, bool)
    met[ids] = True
    return np.flatnonzero(met)


def fit_rows(lines: DataFrame, key: str, start: DataFrame, n_labels: int, args: Args,
             labels: np.ndarray | None = None, unit: int = FIT_UNIT) -> tuple[DataFrame, np.ndarray]:
    """Rounds over (key, features, labels) lines; ``start`` is (row_id, vec)
    for every feature row that occurs.  Returns (row_id, v0.., g) and the label rows."""
    spark, dim = lines.sparkSession, args.dim
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = max(1, -(-(lines.agg(F.sum(F.size("features"))).first()[0] or 0) // unit))
    # dealt once; the cache can be rebuilt from checkpointed lines
    f = lines.filter(F.size("features") > 0).select(F.pmod(F.xxhash64(key), F.lit(units)).cast("long").alias("_unit"), key, "features", "labels")
    f = f.repartition(parts, "_unit").persist(StorageLevel.MEMORY_AND_DISK)
    cs, ds = _columns(dim), [f"d{i}" for i in range(dim)]
    B, G = np.zeros((n_labels, dim)) if labels is None else labels.copy(), np.zeros(n_labels)
    with SH.files_dropped(spark):
        rows = _spread(start, dim).withColumn("g", F.lit(0.0)).checkpoint(eager=True)
        for e in range(args.epoch):
            rate, folder = args.lr * (1 - e / args.epoch), SH.folder(spark, "rows")
            files = SH.stored(rows.select(F.col("row_id").cast("long").alias("id"), F.lit(0).cast("long").alias("share"), F.lit(0.0).alias("keep"), *cs), folder)
            shared = spark.sparkContext.broadcast(B)
            grad = f.groupBy("_unit").applyInArrow(_unit_step(shared, folder, files, key, dim), SH.SUMS)
            grad = grad.groupBy("kind", "block").applyInArrow(SH.added_sums(dim), ", ".join(["kind int, id long", *[f"{x} double" for x in ds]])).checkpoint(eager=True)
            SH.drop(folder, files)
            d = grad.filter("kind = 0").select(F.col("id").alias("row_id"), *ds)
            rows = _moved(rows.join(d, "row_id", "left"), "row_id", dim, rate).checkpoint(eager=True)
            for r in grad.filter("kind = 1").collect():                           # labels x dim numbers
                g, l = np.array([r[x] for x in ds]), r["id"]
                G[l] += (g * g).mean()
                B[l] += rate * g / np.sqrt(G[l] + EPS)
            shared.unpersist()
            del grad, d
            SH.forget(spark)
    f.unpersist()
    return rows, B


def train(df: DataFrame, key: str, text: str, args: Args | None = None, pretrained: DataFrame | None = None) -> Classifier:
    """MDL-03 (+ MDL-04 with ``pretrained``: (word, vec) rows of the model's dimension)."""
    args = args or Args()
    spark = df.sparkSession
    checkpoint_dir(spark)
    toks = df.select(key, T.tokenize_ws(F.col(text)).alias("tokens"))
    coded = coded_lines(toks, key, "tokens", args)
    vocab = V.vocab_of_counts(word_counts(coded), args.min_count, args.min_count_label, args.label)
    if pretrained is not None:
        vocab = with_given_words(vocab, pretrained, args)
    vocab = vocab.checkpoint(eager=True)
    nwords = vocab.filter(F.col("type") == "word").count()
    names = vocab.filter(F.col("type") == "label").select((F.col("id") - nwords).alias("label_id"), F.col("word").alias("label"))
    lines = coded_features(coded, key, vocab, args, nwords).filter(F.size("labels") > 0).checkpoint(eager=True)
    start = feature_ids(lines).distinct()
    start = start.select("row_id", start_vector(F.col("row_id"), args.dim, args.seed).alias("vec"))
    if pretrained is not None:
        given = vocab.join(pretrained.select("word", F.col("vec").alias("_given")), "word").select(F.col("id").alias("row_id"), "_given")
        wrong = given.filter(F.size("_given") != args.dim).limit(1).count()
        if wrong:
            raise ValueError("given vectors must have the model's dimension")
        start = start.join(given, "row_id", "full_outer").select(
            "row_id", F.coalesce(F.col("_given").cast("array<double>"), "vec").alias("vec"))
    rows, B = fit_rows(lines, key, start, names.count(), args)
    output = names.join(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(B)],
                                              "label_id long, vec array<double>"), "label_id")
    return Classifier(args, vocab, nwords, rows.select("row_id", F.array(*_columns(args.dim)).alias("vec")), output)


def with_given_words(vocab: DataFrame, given: DataFrame, args: Args) -> DataFrame:
    """MDL-04: every given word gains one count (a new one starts with it)."""
    c = (vocab.select("word", "count").unionByName(given.select("word").distinct().withColumn("count", F.lit(1).cast("bigint")))
         .groupBy("word").agg(F.sum("count").alias("count")))
    is_label = F.col("word").startswith(args.label)
    c = c.withColumn("type", F.when(is_label, "label").otherwise("word")).withColumn("_t", is_label.cast("int"))
    return dense_index(c, ["_t", F.col("count").desc(), "word"], name="id", start=0).drop("_t").select("id", "word", "count", "type")


def predict(model: Classifier, df: DataFrame, key: str, text: str, k: int = 1, threshold: float = 0.0) -> DataFrame:
    """MDL-05: the k best labels of each text; a feature row that training never
    met has its start value."""
    dim = model.args.dim
    toks = df.select(key, T.tokenize_ws(F.col(text)).alias("tokens"))
    checkpoint_dir(df.sparkSession)
    lines = line_features(toks, key, "tokens", model.vocab, model.args, model.nwords).checkpoint(eager=True)
    from textlake.functions import arrays as A
    if model.packed is not None:
        h = QN.weighted_means(bags(lines, key), key, model.packed)
    else:
        rows = model.input
        if not model.shrunk:
            rows = feature_ids(lines).distinct().join(rows, "row_id", "left")
            rows = rows.withColumn("vec", F.coalesce("vec", start_vector(F.col("row_id"), dim, model.args.seed)))
        h = VE.row_sums(lines, key, "features", rows.select("row_id", "vec", F.lit(1.0).alias("scale")), dim, item="row_id")
        h = h.select(key, A.scale_by(F.col("vec"), F.col("n")).alias("vec"))
    h = df.select(key).join(h, key, "left").select(key, F.coalesce("vec", A.zeros(dim)).alias("vec"))
    return EV.predict(h, key, model.output.select("label", "vec"), k, threshold)


def shrink(model: Classifier, cutoff: int, dsub: int = 2, qnorm: bool = False, qout: bool = False,
           retrain: DataFrame | None = None, key: str = "id", text: str = "text"):
    """QNT-06: keep ``cutoff`` feature rows (the end-of-line word first, then by
    norm), train on with them alone (``retrain``: labelled texts), and
    store the rows as codes, with the norms apart (``qnorm``), and the label rows
    too (``qout``).  Returns (model, codes, codebook); the model predicts from the codes (``packed``),
    and its ``input`` is read back from them."""
    if model.args.model != "supervised":
        raise ValueError("only classifiers can be shrunk")
    spark, args = model.vocab.sparkSession, model.args
    eos = model.vocab.filter(F.col("word") == T.EOS).select("id").first()
    kept = QN.prune_by_norm(model.input, cutoff, eos_key=eos[0] if eos else -1).select("row_id", "vec").checkpoint(eager=True)
    output = model.output
    if retrain is not None:
        toks = retrain.select(key, T.tokenize_ws(F.col(text)).alias("tokens"))
        lines = line_features(toks, key, "tokens", model.vocab, args, model.nwords)
        ids = kept.select("row_id").distinct()
        alone = (lines.filter(F.size("labels") > 0).select(key, "labels", F.posexplode("features").alias("_pos", "row_id"))
                 .join(ids, "row_id").groupBy(key, "labels").agg(F.array_sort(F.collect_list(F.struct("_pos", "row_id"))).alias("_f"))
                 .select(key, "labels", F.transform("_f", lambda x: x["row_id"]).alias("features")).checkpoint(eager=True))
        start = np.array([list(r["vec"]) for r in output.orderBy("label_id").collect()])
        rows, B = fit_rows(alone, key, kept, len(start), args, start)
        kept = rows.select("row_id", F.array(*_columns(args.dim)).alias("vec"))
        output = output.drop("vec").join(spark.createDataFrame(
            [(i, [float(x) for x in v]) for i, v in enumerate(B)], "label_id long, vec array<double>"), "label_id")
    codes, book, back, packed = _coded(kept, dsub, qnorm, "row_id")
    if qout:
        by_id = output.select(F.col("label_id").alias("row_id"), "vec")
        _, _, out_back, _ = _coded(by_id, dsub, qnorm, "row_id")
        output = output.drop("vec").join(out_back.withColumnRenamed("row_id", "label_id"), "label_id")
    return Classifier(args, model.vocab, model.nwords, back, output, shrunk=True, packed=packed), codes, book


def _coded(rows: DataFrame, dsub: int, qnorm: bool, key: str):
    """(codes, codebook, rows read back from the codes, codes packed)."""
    if not qnorm:
        book = QN.pq_train(rows, dsub)
        codes = QN.pq_encode(rows, book, dsub).checkpoint(eager=True)
        return codes, book, QN.pq_decode(codes, book), QN.Packed(QN.pack(codes), book)
    unit, norms = QN.quantize_norms(rows)
    book, norm_book = QN.pq_train(unit, dsub), QN.pq_train(norms, 1)
    codes = QN.pq_encode(unit, book, dsub).checkpoint(eager=True)
    norm_codes = QN.pq_encode(norms, norm_book, 1).checkpoint(eager=True)
    norm = QN.pq_decode(norm_codes, norm_book).select(key, F.col("vec")[0].alias("_n"))
    back = QN.pq_decode(codes, book).join(norm, key).select(key, F.transform("vec", lambda x: x * F.col("_n")).alias("vec"))
    both = codes.join(norm_codes.withColumnRenamed("codes", "_norm"), key).select(key, F.concat("codes", "_norm").alias("codes"))
    return codes, book, back, QN.Packed(QN.pack(both), book, norm_book)


#: Files a table of a saved model is dealt to; a look-up opens those of its keys only.
LOOKUP_PARTS = 64


def _part(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def save(model: Classifier, path: str, parts: int = LOOKUP_PARTS) -> None:
    """MDL-11: a Parquet folder a part.  The feature rows (by ``row_id``) and the vocabulary
    (by ``word``) lie in hash folders, sorted by key, for look-ups."""
    spark = model.vocab.sparkSession
    meta = json.dumps(dict(args=asdict(model.args), nwords=model.nwords, shrunk=model.shrunk, parts=parts,
                           packed=model.packed is not None, norms=model.packed is not None and model.packed.norm_book is not None))
    spark.createDataFrame([(meta,)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/args")
    for name, key in (("vocab", "word"), ("input", "row_id")):
        (getattr(model, name).withColumn("part", _part(key, parts)).repartition(parts, "part").sortWithinPartitions("part", key)
         .write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}"))
    model.output.write.mode("overwrite").parquet(f"{path}/output")
    for name in _packed_tables(json.loads(meta)):
        getattr(model.packed, name).write.mode("overwrite").parquet(f"{path}/packed_{name}")


def _packed_tables(meta: dict) -> list[str]:
    return (["rows", "book"] if meta.get("packed") else []) + (["norm_book"] if meta.get("norms") else [])


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/args").first()[0])


def load(spark: SparkSession, path: str) -> Classifier:
    meta = _meta(spark, path)
    vocab, rows = (spark.read.parquet(f"{path}/{name}").drop("part") for name in ("vocab", "input"))
    packed = {name: spark.read.parquet(f"{path}/packed_{name}") for name in _packed_tables(meta)}
    return Classifier(Args(**meta["args"]), vocab, meta["nwords"], rows, spark.read.parquet(f"{path}/output"), bool(meta.get("shrunk")),
                      QN.Packed(**packed) if packed else None)


def _look_up(spark: SparkSession, path: str, name: str, key: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``key``) beside its rows of a saved table, null where there is none.  Both
    sides agree on the hash folder, so Spark opens only folders that hold wanted keys."""
    parts = _meta(spark, path)["parts"]
    asked = wanted.select(key).distinct().withColumn("part", _part(key, parts))
    return asked.join(spark.read.parquet(f"{path}/{name}"), ["part", key], "left").drop("part")


def word_ids(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """MDL-11: (word, id, count, type) of the given words, -1 for the id of unknown ones."""
    return _look_up(spark, path, "vocab", "word", words).withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))


def input_vectors(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """MDL-11: (row_id, vec) of the given feature rows; one that training never moved has its
    start value, or none (null) in a shrunk model."""
    meta = _meta(spark, path)
    got = _look_up(spark, path, "input", "row_id", rows)
    if meta.get("shrunk"):
        return got
    args = Args(**meta["args"])
    return got.withColumn("vec", F.coalesce("vec", start_vector(F.col("row_id"), args.dim, args.seed)))


def subword_vectors(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """MDL-11: (word, pos, gram, row_id, vec): the own row of a known word and its sub-words' rows."""
    meta = _meta(spark, path)
    args = Args(**meta["args"])
    vocab = word_ids(spark, path, words).filter(F.col("id") >= 0)
    grams = VE.subword_rows(words, vocab, meta["nwords"], args.bucket, args.minn, args.maxn)
    return grams.join(input_vectors(spark, path, grams.select("row_id")), "row_id", "left").select("word", "pos", "gram", "row_id", "vec")


def folder(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
