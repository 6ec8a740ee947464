"""Word / text vectors, nearest neighbours, analogies, rank correlation,
context windows (VEC-01..05, JOIN-05/06/08, AGG-08/09, WIN-07..09).

Nearest neighbours are exact: a given query table and the vectors are cut into blocks of
bounded sizes that meet by an equality join on their numbers; a task finds the best ``k`` of one
block of vectors for one block of queries, and a final per-query top-k runs on
k candidates a block of vectors.  No all-pairs output.
"""

from __future__ import annotations

from typing import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import arrays as A
from textlake.functions import hashing as H
from textlake.operators import shared as SH
from textlake.operators.common import dense_index
from textlake.session import checkpoint_dir

QUERY_NORM_FLOOR = 1e-8       # fixed value: a tinier query norm counts as 1
MAX_QUERY_CHUNK = 65_536      # queries in a block: vectors are sent once for each
VECTOR_BLOCK = 65_536         # vectors in a block
LEAST_TASKS = 16              # fewer blocks are cut into as many, if these hold LEAST_QUERIES
LEAST_QUERIES = 2_048
SUM_UNIT = 1 << 22            # items of a unit of row sums
SUM_TILE = 1 << 15            # rows added up at once inside a task
BAG_TILE = 1 << 9             # bags whose items are looked up at once
ITEM_END = "\0"               # between the joined words of a bag


# ---------------------------------------------------------------------------
# sums of rows
# ---------------------------------------------------------------------------
def _unit_sums(key: str, item: str, dim: int):
    """Arrow task: the bags of one unit and the rows they need -> (key, vec, n).  Rows and the
    items of a bag are sorted first: sums don't depend on the order of arrival."""
    def run(bags: pa.Table, rows: pa.Table) -> pa.Table:
        rows, bags = rows.sort_by(item).combine_chunks(), bags.combine_chunks()
        ids = pc.unique(rows[item])
        X, scale = pc.list_flatten(rows["vec"]).to_numpy().reshape(len(rows), dim), rows["scale"].to_numpy()
        times = np.ones(len(ids), np.int64)
        if len(ids) < len(rows):                     # an item with several rows gives all of them
            place = pc.index_in(rows[item], value_set=ids).to_numpy()
            X = np.add.reduceat(X.astype(np.float64) * scale[:, None], np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), axis=0)
            times, scale = np.bincount(place), np.ones(len(ids))
        total, n = np.zeros((len(bags), dim)), np.zeros(len(bags), np.int64)

        def add(lists, bag: np.ndarray):
            """Adds up item lists, those of the bags numbered ``bag``."""
            of, at = pc.list_parent_indices(lists).to_numpy(), pc.index_in(pc.list_flatten(lists), value_set=ids)
            of, at = bag[of[pc.is_valid(at).to_numpy(zero_copy_only=False)]], at.drop_null().to_numpy()
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            n[:] += np.bincount(of, times[at], len(n)).astype(np.int64)
            for lo in range(0, len(of), SUM_TILE):
                mine, some = of[lo:lo + SUM_TILE], at[lo:lo + SUM_TILE]
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                total[mine[first]] += np.add.reduceat(X[some].astype(np.float64) * scale[some, None], first, axis=0)

        def whole(column) -> pa.Array:
            column = column.combine_chunks()
            return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        for lo in range(0, len(bags), BAG_TILE):
            some = bags.slice(lo, BAG_TILE)
            for name in ("items", "joined") if "joined" in bags.column_names else ("items",):
                here = pc.is_valid(some[name]).to_numpy()
                if here.any():
                    lists = whole(some[name].filter(pa.array(here)))
                    add(lists if name == "items" else pc.split_pattern(lists, ITEM_END), lo + np.flatnonzero(here))
        met = pa.array(np.flatnonzero(n))
        ends = pa.array(np.arange(len(met) + 1, dtype=np.int32) * dim)
        return pa.Table.from_arrays([bags[key].take(met), pa.ListArray.from_arrays(ends, pa.array(total[n > 0].ravel())),
                                     pa.array(n[n > 0])], [key, "vec", "n"])
    return run


def row_sums(bags: DataFrame, key: str, items: str, rows: DataFrame, dim: int, item: str = "word",
             unit: int = SUM_UNIT) -> DataFrame:
    """(key, vec, n): per key the sum of scale x vec over the occurrences of its ``items`` (an array
    column) in ``rows`` (item, vec, scale), and their number; a key without any is left out.

    Bags are dealt by key to units of about ``unit`` items (a longer bag is cut) and a unit gets each row it
    needs once: what is exchanged is the bags, a row for every (unit, item) and one sum a bag, no row an
    occurrence."""
    units = max(1, -(-(bags.agg(F.sum(F.size(items))).first()[0] or 0) // unit))
    size = F.size(items)
    cut = F.transform(F.sequence(F.lit(1), size, F.lit(unit)), lambda i: F.slice(items, i, F.lit(unit)))
    pieces = bags.filter(size > 0).select(key, F.posexplode(F.when(size > unit, cut).otherwise(F.array(items))).alias("_piece", "items"))
    pieces = pieces.select(F.pmod(F.xxhash64(key, "_piece"), F.lit(units)).cast("int").alias("_unit"), key, "items")
    needed = pieces.select(F.col("_unit").alias("_unit"), F.explode("items").alias(item)).distinct()
    sent = needed.join(rows.select(item, "vec", F.col("scale").cast("double").alias("scale")), item)
    if dict(bags.dtypes)[items] == "array<string>":    # words travel as one string, unless one is null or holds the mark
        odd = F.exists("items", lambda x: x.isNull() | F.contains(x, F.lit(ITEM_END)))
        pieces = pieces.select("_unit", key, F.when(odd, F.col("items")).alias("items"),
                               F.when(~odd, F.array_join("items", ITEM_END)).alias("joined"))
    sums = pieces.groupBy("_unit").cogroup(sent.groupBy("_unit")).applyInArrow(
        _unit_sums(key, item, dim), f"`{key}` {dict(bags.dtypes)[key]}, vec array<double>, n long")
    g = sums.groupBy(key).agg(*[F.sum(F.col("vec")[i]).alias(f"v{i}") for i in range(dim)], F.sum("n").alias("n"))
    return g.select(key, F.array(*[f"v{i}" for i in range(dim)]).alias("vec"), "n")


# ---------------------------------------------------------------------------
# VEC-01 / VEC-03 word vectors from sub-word rows
# ---------------------------------------------------------------------------
def subword_rows(words: DataFrame, vocab: DataFrame | None, nwords: int, bucket: int, minn: int, maxn: int,
                 word: str = "word") -> DataFrame:
    """(word, pos, row_id, gram): the input rows a word's vector averages
    (own id when known, then n-gram buckets offset by ``nwords``)."""
    ex = _subwords(words, vocab, nwords, bucket, minn, maxn, word).select(word, F.posexplode_outer("_sub").alias("pos", "s"))
    return ex.select(word, "pos", "s.row_id", "s.gram")


def _subwords(words: DataFrame, vocab: DataFrame | None, nwords: int, bucket: int, minn: int, maxn: int, word: str) -> DataFrame:
    """(word, _sub): the distinct words, each with its (row_id, gram) in order."""
    w = words.select(word).distinct()
    if vocab is not None:
        w = w.join(vocab.select(F.col("word").alias(word), F.col("id").alias("_wid")), word, "left")
    else:
        w = w.withColumn("_wid", F.lit(None).cast("bigint"))
    grams = H.char_ngrams(F.col(word), minn, maxn)
    grams = F.when(F.col(word) == "</s>", F.array().cast("array<string>")).otherwise(grams)
    own = F.when(F.col("_wid").isNotNull(), F.array(F.struct(F.col("_wid").cast("bigint").alias("row_id"),
                                                               F.col(word).alias("gram"))))
    own = F.coalesce(own, F.array().cast("array<struct<row_id:bigint,gram:string>>"))
    sub = F.transform(grams, lambda g: F.struct((H.fnv_bucket(g, bucket) + nwords).alias("row_id"), g.alias("gram")))
    return w.select(word, F.concat(own, sub).alias("_sub"))


def word_vectors(words: DataFrame, rows: DataFrame, dim: int, vocab: DataFrame | None = None, nwords: int = 0,
                 bucket: int = 2_000_000, minn: int = 3, maxn: int = 6, word: str = "word") -> DataFrame:
    """VEC-01: mean of the word's sub-word rows; no rows -> zeros.

    ``rows`` is (row_id, vec).  A row is sent once to a unit of words (``row_sums``)."""
    sw = _subwords(words, vocab, nwords, bucket, minn, maxn, word).select(word, F.transform("_sub", lambda s: s["row_id"]).alias("_ids"))
    checkpoint_dir(words.sparkSession)
    sw = sw.checkpoint(eager=True)                   # read three times, hashed once
    s = row_sums(sw, word, "_ids", rows.select("row_id", "vec", F.lit(1.0).alias("scale")), dim, item="row_id", unit=SUM_UNIT // 8)
    g = s.select(word, F.col("n").alias("_cnt"), A.scale_by(F.col("vec"), F.col("n")).alias("vec"))
    allw = words.select(word).distinct()
    return allw.join(g, word, "left").select(
        word, F.coalesce(F.col("_cnt"), F.lit(0)).alias("n_sub"), F.coalesce(F.col("vec"), A.zeros(dim)).alias("vec"))


def subword_vectors(words: DataFrame, rows: DataFrame, vocab=None, nwords: int = 0, bucket: int = 2_000_000,
                    minn: int = 3, maxn: int = 6, word: str = "word") -> DataFrame:
    """VEC-03: each sub-word of a word with its row vector (zeros if absent)."""
    sw = subword_rows(words, vocab, nwords, bucket, minn, maxn, word)
    return sw.join(rows.select("row_id", "vec"), "row_id", "left")


# ---------------------------------------------------------------------------
# VEC-02 text vectors
# ---------------------------------------------------------------------------
def text_vectors(df: DataFrame, key: str, tokens: str, vectors: DataFrame, dim: int, how: str = "normed") -> DataFrame:
    """VEC-02.  ``normed``: mean of the unit vectors of the known words with
    non-zero norm; ``mean``: mean of the rows of the known words;
    ``sumsq``: sum / (sum . sum), all-zero or empty -> zeros.  A vector is sent
    once to a unit of texts, not to every text (``row_sums``)."""
    if how not in ("normed", "mean", "sumsq"):
        raise ValueError(how)
    rows = vectors.select("word", "vec", F.lit(1.0).alias("scale"))
    if how == "normed":
        rows = rows.withColumn("scale", A.vec_norm(F.col("vec"))).filter("scale > 0").withColumn("scale", 1 / F.col("scale"))
    s = row_sums(df, key, tokens, rows, dim)
    if how == "sumsq":
        d = A.vec_dot(F.col("vec"), F.col("vec"))
        res = s.select(key, F.when(d > 0, A.scale_by(F.col("vec"), d)).otherwise(A.zeros(dim)).alias("vec"))
    else:
        res = s.select(key, A.scale_by(F.col("vec"), F.col("n")).alias("vec"))
    return df.select(key).distinct().join(res, key, "left").select(
        key, F.coalesce("vec", A.zeros(dim)).alias("vec"))


# ---------------------------------------------------------------------------
# VEC-04 / VEC-05 nearest neighbours and analogies
# ---------------------------------------------------------------------------
QUERY_TILE = 512              # queries scored at once inside a task
WORD_TILE = 4096              # vectors they are scored against at once


def _first_copies(V: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and words without those that can't be among the best: of equal vectors the ``most`` last words stay."""
    order = np.argsort(words)[::-1]
    same = np.unique(np.ascontiguousarray(V[order]).view(f"V{V.shape[1] * V.itemsize}").ravel(), return_inverse=True)[1].ravel()
    if not len(same) or same.max() + 1 == len(same):
        return V, words
    by = np.argsort(same, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(same[by]) > 0])
    turn = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    stay = np.sort(order[by[turn < most]])
    return V[stay], words[stay]


def _best_words(q: pd.DataFrame, v: pd.DataFrame, k: int) -> list[tuple]:
    """(qid, word, sim): the best ``k`` words of a block of vectors for every query of a block
    (sim, then word, both falling), in tiles of queries and vectors, whose best words merge.

    Single precision tells which words of a tile may be among the best so far: those that reach the last of them less
    the most by which it can be off.  Only these get their cosine, in double precision."""
    V = np.stack(v["uvec"].to_numpy()).astype(np.float64)
    Q = np.stack(q["qvec"].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(Q, axis=1)
    norm[np.abs(norm) < QUERY_NORM_FLOOR] = 1.0
    bans, out = [set(() if b is None else b) for b in q["ban"]], []
    V, words = _first_copies(V, v["word"].to_numpy(), k + max(map(len, bans), default=0))
    Q /= norm[:, None]
    V4, Q4 = V.astype(np.float32), Q.astype(np.float32)
    # rounding of both, of every product and of the sums, for vectors no longer than 1
    off = 2 * (V.shape[1] + 8) * 2.0 ** -24 * max(1.0, float(np.linalg.norm(V, axis=1).max(initial=0))) * np.linalg.norm(Q, axis=1)
    off = off.astype(np.float32) + np.float32(1e-30)
    for lo in range(0, len(Q), QUERY_TILE):
        mine = slice(lo, lo + QUERY_TILE)
        best = [[] for _ in bans[mine]]
        most = k + max(len(x) for x in bans[mine])
        least = np.full(len(best), -np.inf, np.float32)
        for at in range(0, len(V), WORD_TILE):
            S = Q4[mine] @ V4[at:at + WORD_TILE].T
            if not at:
                spare = min(most, S.shape[1])
                least = np.partition(S, S.shape[1] - spare, axis=1)[:, S.shape[1] - spare]
            bar = least - off[mine]
            some = np.flatnonzero(S.max(axis=1) >= bar)
            of, i = np.nonzero(S[some] >= bar[some, None])
            of, i = some[of], i + at
            for x in range(0, len(of), 1 << 15):
                j, w = of[x:x + (1 << 15)], i[x:x + (1 << 15)]
                for y, word, sim in zip(j.tolist(), words[w], np.einsum("id,id->i", V[w], Q[lo + j])):
                    if word not in bans[lo + y]:
                        best[y].append((sim, word))
            for y in np.unique(of).tolist():
                best[y].sort(reverse=True)
                del best[y][k:]
                if len(best[y]) == k:
                    least[y] = best[y][-1][0]
        out += [(q["qid"].iat[lo + j], w, sim) for j, found in enumerate(best) for sim, w in found]
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Word vectors divided by their norm (zero rows stay zero)."""
    return vectors.select("word", A.normalize_rows(F.col("vec")).alias("uvec"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, chunk: int = MAX_QUERY_CHUNK,
            vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """VEC-04: the k nearest words by cosine for every query of a given table.

    ``queries``: (qid, qvec array, ban array<string>), one row a qid;
    ``vectors``: (word, vec).  Ties by word, descending.  Hash blocks of about
    ``chunk`` queries meet hash blocks of about ``vector_block`` vectors by an equality
    join on the two block numbers: a task holds one block of each and emits k words a query, the plan is the
    same for any number of queries, and nothing passes through the driver.
    Returns (qid, rank, word, sim).
    """
    qid_type = dict(queries.dtypes)["qid"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    n, n_v = queries.count(), max(1, -(-vectors.count() // vector_block))
    n_q = max(1, -(-n // chunk), min(n // LEAST_QUERIES, -(-LEAST_TASKS // n_v)))
    q = queries.select("qid", "qvec", "ban", block("qid", n_q).alias("_qb")).withColumn("_vb", every(n_v))
    v = unit_vectors(vectors).withColumn("_vb", block("word", n_v)).withColumn("_qb", every(n_q))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = _best_words(q, v, k) if len(q) and len(v) else []
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=t)
                             for i, (c, t) in enumerate((("qid", object), ("word", object), ("sim", float)))})

    cand = (q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb"))
            .applyInPandas(best, f"qid {qid_type}, word string, sim double"))
    # k candidates of every block of vectors: Spark keeps k a query in each task before it deals them
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("word").desc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def word_queries(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """Queries for VEC-04: the given words by their own vectors, each banned
    from its own answer; the word is the query's id."""
    src = vectors.join(words.select("word").distinct(), "word", "left_semi")
    return src.select(F.col("word").alias("qid"), A.as_double(F.col("vec")).alias("qvec"), F.array("word").alias("ban"))


def oov_queries(words: DataFrame, rows: DataFrame, dim: int, vocab: DataFrame | None = None, nwords: int = 0,
                bucket: int = 2_000_000, minn: int = 3, maxn: int = 6) -> DataFrame:
    """Queries for VEC-04 by any word, known or not: its vector is that of its
    sub-words (VEC-01); the word is the query's id and banned."""
    v = word_vectors(words, rows, dim, vocab, nwords, bucket, minn, maxn)
    return v.select(F.col("word").alias("qid"), A.as_double(F.col("vec")).alias("qvec"), F.array("word").alias("ban"))


def analogy_queries(triples: DataFrame, vectors: DataFrame, unit: bool = True) -> DataFrame:
    """VEC-05: query b - a + c (unit vectors, the scoring tool's form) or
    A - B + C on raw vectors (``unit=False``, the interactive form with
    a, b, c in that order); all three words banned."""
    v = vectors.select("word", (A.normalize_rows(F.col("vec")) if unit else A.as_double(F.col("vec"))).alias("v"))
    j = (triples.join(v.withColumnRenamed("word", "a").withColumnRenamed("v", "va"), "a")
                .join(v.withColumnRenamed("word", "b").withColumnRenamed("v", "vb"), "b")
                .join(v.withColumnRenamed("word", "c").withColumnRenamed("v", "vc"), "c"))
    if unit:
        qv = A.vec_add(A.vec_sub(F.col("vb"), F.col("va")), F.col("vc"))
    else:
        qv = A.vec_add(A.vec_sub(F.col("va"), F.col("vb")), F.col("vc"))
    return j.select(F.col("qid").cast("bigint").alias("qid"), qv.alias("qvec"), F.array("a", "b", "c").alias("ban"))


def analogy_accuracy(triples: DataFrame, vectors: DataFrame, order_col: str = "qid") -> DataFrame:
    """AGG-08: accuracy per section, semantic (sections 1-5 in file order),
    syntactic (the rest), total, and coverage.  Questions with a word
    outside the vocabulary are not counted."""
    words = vectors.select("word")
    found = triples
    for c in ["a", "b", "c", "d"]:
        found = found.join(words.withColumnRenamed("word", c), c, "left_semi")
    top = nearest(analogy_queries(found, vectors), vectors, k=1)
    res = found.join(top.select("qid", F.col("word").alias("pred")), "qid", "left")
    res = res.withColumn("ok", (F.col("pred") == F.col("d")).cast("int"))
    sec_no = triples.groupBy("section").agg(F.min(order_col).alias("_first"))
    sec_no = dense_index(sec_no, ["_first"], name="sec_no")
    res = res.join(sec_no.select("section", "sec_no"), "section")
    per = res.groupBy("section", "sec_no").agg(F.sum("ok").alias("correct"), F.count(F.lit(1)).alias("n_qs"))
    kind = F.when(F.col("sec_no") <= 5, "semantic").otherwise("syntactic")
    out = per.select(F.col("section").alias("scope"), "correct", "n_qs")
    grp = per.groupBy(kind.alias("scope")).agg(F.sum("correct").alias("correct"), F.sum("n_qs").alias("n_qs"))
    tot = per.agg(F.lit("total").alias("scope"), F.sum("correct").alias("correct"), F.sum("n_qs").alias("n_qs"))
    allq = triples.select(F.count(F.lit(1))).scalar()
    out = out.unionByName(grp).unionByName(tot).select(
        "scope", F.col("correct").cast("bigint").alias("correct"), F.col("n_qs").cast("bigint").alias("n_qs"),
        (F.col("correct") / F.col("n_qs")).alias("accuracy"))
    return out.unionByName(res.agg(F.lit("coverage").alias("scope"), F.lit(None).cast("bigint").alias("correct"),
                                   F.count(F.lit(1)).alias("n_qs"), (F.count(F.lit(1)) / allq).alias("accuracy")))


# ---------------------------------------------------------------------------
# JOIN-05 / JOIN-06 / JOIN-08, WIN-09, AGG-09
# ---------------------------------------------------------------------------
def embedding_matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """JOIN-05: vocabulary -> vector, a missing word gives zeros."""
    j = vocab.join(vectors.select("word", "vec"), "word", "left")
    return j.withColumn("vec", F.coalesce(A.as_double(F.col("vec")), A.zeros(dim)))


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """JOIN-06: cosine for pairs with both words known (zero-norm vectors do
    not count as known); ``known`` marks the rest for the OOV count."""
    v = vectors.filter(A.vec_norm(F.col("vec")) > 0).select("word", "vec")
    j = (pairs.join(v.select(F.col("word").alias("w1"), F.col("vec").alias("v1")), "w1", "left")
              .join(v.select(F.col("word").alias("w2"), F.col("vec").alias("v2")), "w2", "left"))
    known = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return j.select("w1", "w2", "gold", known.alias("known"),
                    F.when(known, A.vec_cosine(F.col("v1"), F.col("v2"))).alias("sim"))


def attach(df: DataFrame, scores: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """JOIN-08: scores beside the source rows by a stable key."""
    return df.join(scores, key, "left")


def avg_rank(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """WIN-09: 1-based rank with ties averaged, without a global window:
    positions from ``dense_index``, then (min + max) / 2 per tied value."""
    name = name or f"{col}_rank"
    ix = dense_index(df.withColumn("_u", F.monotonically_increasing_id()), [col, "_u"], name="_pos")
    ties = ix.groupBy(col).agg(((F.min("_pos") + F.max("_pos")) / 2.0).alias(name))
    return ix.join(ties, col).drop("_pos", "_u")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-09: Spearman correlation x 100 (Pearson on average ranks)."""
    r = avg_rank(avg_rank(df, a, "_ra"), b, "_rb")
    return r.agg((F.corr("_ra", "_rb") * 100).alias("spearman_x100"), F.count(F.lit(1)).alias("n_pairs"))


# ---------------------------------------------------------------------------
# WIN-07 / WIN-08 context windows
# ---------------------------------------------------------------------------
PAIR_UNIT = 1 << 20     # words whose pairs a task sums up at once
PAIR_BUCKET = 1 << 22   # pairs that meet in a task, before those of different units are added up
FREQUENT = 1 << 10      # a word with more than one in so many occurrences is frequent; there are fewer than that


def skipgram_pairs(df: DataFrame, tokens: str, ws: int, summed: bool = False, unit: int = PAIR_UNIT) -> DataFrame:
    """WIN-07: (center, context, dist, weight) for every word and each
    neighbour up to ``ws`` away; weight (ws - d + 1) / ws is the chance the
    library's random reach includes distance d.  Shifted-slice zips keep
    the work linear in the line length.

    ``summed`` gives (center, context, n, weight), one row for each two words with the number and
    the weight of their pairs.  A pair counts alike in both directions, so a task sums up the
    unordered pairs of ``unit`` words at a time and sends them by bucket of their first word, packed: the words
    once, the pairs as steps from one to the next.  They are added up inside the task of a bucket.  A frequent
    word stands second, so no word makes a large bucket."""
    if summed:
        return _summed_pairs(df, tokens, ws, unit)
    t = F.col(tokens)
    L = F.size(t)
    outs = []
    for d in range(1, ws + 1):
        m = F.greatest(L - d, F.lit(0))
        fwd = F.arrays_zip(F.slice(t, 1, m), F.slice(t, d + 1, m))
        outs.append(F.transform(fwd, _pair(d, ws, False)))
        outs.append(F.transform(fwd, _pair(d, ws, True)))
    ex = df.select(F.explode(F.concat(*outs)).alias("p"))
    return ex.select("p.center", "p.context", "p.dist", "p.weight")


def _pair_runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _partners(ws: int, unit: int, frequent: Sequence, buckets: int = 0):
    """Arrow task: rows (tokens) -> (a, b, n, k): a word, its partners that don't stand before it (the
    frequent words stand last), the number of pairs with each and their summed ws - d + 1.  With ``buckets``
    (_b, words, size, pairs, n, k): the same of all words of a bucket, packed."""
    def stream(words: pa.Array) -> bytes:
        sink, t = pa.BufferOutputStream(), pa.table({"w": words})
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    def partners(parts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays(parts)
        line = pc.list_parent_indices(lists).to_numpy()
        coded = pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        last = pc.is_in(coded.dictionary, value_set=pa.array(frequent, coded.dictionary.type)).to_numpy(zero_copy_only=False)[order]
        order = np.r_[order[~last], order[last]]
        words = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        codes = rank[coded.indices.to_numpy()]
        keys = []
        for d in range(1, ws + 1):
            same = line[:-d] == line[d:]
            x, y = codes[:-d][same], codes[d:][same]
            keys.append((np.minimum(x, y) * len(words) + np.maximum(x, y)) * ws + d - 1)
        key = np.concatenate(keys)
        key.sort()
        pair, reach = key // ws, ws - key % ws
        at = _pair_runs(pair)
        n, k = np.diff(np.r_[at, len(pair)]), np.add.reduceat(reach, at) if len(at) else np.zeros(0, np.int64)
        word, hi = np.divmod(pair[at], max(len(words), 1))
        yield from packed(words, word, hi, n, k) if buckets else unpacked(words, word, hi, n, k)

    def unpacked(words: pa.Array, word: np.ndarray, hi: np.ndarray, n: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = _pair_runs(word)
        ends = pa.array(np.r_[head, len(word)].astype(np.int32))
        out = pa.RecordBatch.from_arrays(
            [words.take(pa.array(word[head])), pa.ListArray.from_arrays(ends, words.take(pa.array(hi))),
             pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(k.astype(np.int64)))],
            ["a", "b", "n", "k"])
        for lo in range(0, len(out), 1 << 14):
            yield out.slice(lo, 1 << 14)

    def packed(words: pa.Array, word: np.ndarray, hi: np.ndarray, n: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = np.array([crc32(str(w).encode("utf-8", "surrogatepass")) % buckets for w in words.to_pylist()], np.int64)[word]
        order = np.argsort(of, kind="stable")
        of, word, hi, n, k = (x[order] for x in (of, word, hi, n, k))
        rows, head = [], _pair_runs(of)
        for lo, end in zip(head, np.r_[head[1:], len(of)]):
            mine = slice(lo, end)
            used, place = np.unique(np.r_[word[mine], hi[mine]], return_inverse=True)
            steps = np.diff(place[:end - lo] * len(used) + place[end - lo:], prepend=0)
            rows.append((int(of[lo]), stream(words.take(pa.array(used))), int(end - lo), *(SH.squeezed(x.astype(np.uint64)) for x in (steps, n[mine], k[mine]))))
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo:lo + 64]), (
                pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 3))], ["_b", "words", "size", "pairs", "n", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            lo = 0
            while lo < len(lists):
                hi = max(int(np.searchsorted(ends, ends[lo] + unit - size, "right")) - 1, lo + 1)
                parts.append(lists.slice(lo, hi - lo))
                size += int(ends[hi] - ends[lo])
                lo = hi
                if size >= unit or lo < len(lists):
                    yield from partners(parts)
                    parts, size = [], 0
        if parts:
            yield from partners(parts)
    return run


def _added_pairs(records: pa.Table) -> pa.Table:
    """The packed pairs of a bucket -> (a, b, n, k), one row for each two words."""
    words = [pa.ipc.open_stream(x.as_buffer()).read_all()["w"].combine_chunks() for x in records["words"]]
    words = [w.combine_chunks() if isinstance(w, pa.ChunkedArray) else w for w in words]
    ends, coded = np.cumsum([0, *map(len, words)]), pa.concat_arrays(words).dictionary_encode(null_encoding="encode")
    codes, many, keys = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), []
    sizes = records["size"].to_pylist()
    for lo, hi, raw, size in zip(ends[:-1], ends[1:], records["pairs"], sizes):
        a, b = np.divmod(np.cumsum(SH.swollen(raw.as_py(), size, np.uint64)).astype(np.int64), hi - lo)
        keys.append(codes[lo:hi][a] * many + codes[lo:hi][b])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _pair_runs(key)
    n, k = (np.add.reduceat(np.concatenate([SH.swollen(raw.as_py(), size, np.uint64) for raw, size in zip(records[c], sizes)]).astype(np.int64)[order], at)
            for c in ("n", "k"))
    a, b = np.divmod(key[at], many)
    return pa.table([coded.dictionary.take(pa.array(a)), coded.dictionary.take(pa.array(b)), pa.array(n), pa.array(k)], ["a", "b", "n", "k"])


def _summed_pairs(df: DataFrame, tokens: str, ws: int, unit: int) -> DataFrame:
    lists = df.select(F.col(tokens).alias("t"))
    kind = lists.schema["t"].dataType.elementType.simpleString()
    total = lists.agg(F.sum(F.size("t"))).first()[0] or 0
    words = lists.select(F.explode("t").alias("w")).filter("w is not null").groupBy("w").count()
    frequent = [r["w"] for r in words.filter(F.col("count") * FREQUENT > total).select("w").collect()]
    made = lists.mapInArrow(_partners(ws, unit, frequent, max(1, -(-total * ws // PAIR_BUCKET))),
                            "_b int, words binary, size long, pairs binary, n binary, k binary")
    two = made.groupBy("_b").applyInArrow(_added_pairs, f"a {kind}, b {kind}, n bigint, k bigint")
    own = F.col("a").eqNullSafe(F.col("b"))
    ways = F.when(own, F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context")))).otherwise(
        F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context")), F.struct(F.col("b").alias("center"), F.col("a").alias("context"))))
    times = F.when(own, 2).otherwise(1)     # a word beside itself: once as centre, once as context
    return two.select(F.explode(ways).alias("p"), (F.col("n") * times).alias("n"), (F.col("k") * times / F.lit(float(ws))).alias("weight")).select(
        "p.center", "p.context", "n", "weight")


def _pair(d, ws, back):
    w = (ws - d + 1) / ws
    if back:
        return lambda s: F.struct(s["1"].alias("center"), s["0"].alias("context"), F.lit(d).alias("dist"),
                                  F.lit(w).alias("weight"))
    return lambda s: F.struct(s["0"].alias("center"), s["1"].alias("context"), F.lit(d).alias("dist"),
                              F.lit(w).alias("weight"))


def cbow_bags(tokens: Column, ws: int) -> Column:
    """WIN-08: for every position the bag of neighbours within ``ws``
    (centre excluded).  ``tokens`` must be a column reference."""
    L = F.size(tokens)
    return F.transform(tokens, lambda c, i: F.struct(
        c.alias("center"),
        F.concat(F.slice(tokens, F.greatest(i - ws + 1, F.lit(1)), i - F.greatest(i - ws, F.lit(0))),
                 F.slice(tokens, i + 2, F.least(F.lit(ws), L - i - 1))).alias("context")))
