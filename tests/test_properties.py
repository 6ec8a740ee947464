"""Property tests for operators whose result is not (only) SQL-checkable."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textlake.functions import hashing as H
from textlake.functions import text as T
from textlake.operators import common as C
from textlake.operators import quant as QN
from textlake.operators import vectors as VE


def _fnv(s):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ (b if b < 128 else b + 4294967040)) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv_matches_reference_rule(spark):
    words = ["the", "é", "北京", "a", "über", "</s>", "<ab>"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(H.fnv1a(F.col("w"))).collect()]
    assert got == [_fnv(w) for w in words]


def test_word_ngram_buckets(spark):
    words = ["a", "bb", "ccc", "é", "x"]
    hs = [_fnv(w) - 2 ** 32 if _fnv(w) >= 2 ** 31 else _fnv(w) for w in words]
    exp = []
    for i in range(len(hs)):
        h = hs[i] % 2 ** 64
        for j in range(i + 1, min(len(hs), i + 3)):
            h = (h * 116049371 + hs[j]) % 2 ** 64
            exp.append(h % 1000 + 7)
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(H.word_ngram_buckets(F.transform("w", H.fnv1a), 3, 1000, 7)).first()[0]
    assert sorted(got) == sorted(exp)


def test_char_ngrams_rule(spark):
    df = spark.createDataFrame([("ab",), ("é",)], "w string")
    got = [r[0] for r in df.select(H.char_ngrams(F.col("w"), 1, 3)).collect()]
    assert got[0] == ["<a", "<ab", "a", "ab", "ab>", "b", "b>"]
    assert got[1] == ["<é", "<é>", "é", "é>"]


def _glue_loop(text):
    # runs of two or more capitalised words joined by '-'
    return re.sub(r"[A-Z][\w\-.]*(?: [A-Z][\w\-.]*)+", lambda m: m.group().replace(" ", "-"), text)


@pytest.mark.parametrize("text", ["Monero Dark is Big Apple Inc", "a B C d", "eBay Inc. Ltd x", "X, Y Z", "", "A"])
def test_glue_capitals_equals_loop(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.glue_capitals(F.col("t"))).first()[0]
    assert got == _glue_loop(text)


def test_dense_index_with_hot_group(spark):
    rng = np.random.default_rng(0)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 20, 3000))
    pdf = pd.DataFrame({"g": g, "v": rng.permutation(3000)})
    df = spark.createDataFrame(pdf).repartition(7)
    out = C.dense_index(df, ["v"], group=["g"], name="i").toPandas().sort_values(["g", "v"])
    exp = pdf.sort_values(["g", "v"]).groupby("g").cumcount() + 1
    assert out["i"].tolist() == exp.tolist()


def test_fill_forward_matches_pandas(spark):
    vals = [None, "a", None, None, "b", None, "c", None, None]
    pdf = pd.DataFrame({"o": range(len(vals)), "s": vals})
    df = spark.createDataFrame(pdf, "o long, s string").repartition(3)
    out = C.fill_forward(df, ["o"], "s").toPandas().sort_values("o")
    assert out["s"].tolist() == pdf["s"].ffill().tolist()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    V = rng.normal(size=(300, 8))
    V[5] = V[6]                                   # a tie
    words = [f"w{i:03d}" for i in range(300)]
    vec = spark.createDataFrame(pd.DataFrame({"word": words, "vec": list(V)})).repartition(4)
    q = VE.word_queries(vec, vec)
    got = VE.nearest(q, vec, k=5, chunk=64).withColumnRenamed("qid", "query")
    got = got.toPandas().sort_values(["query", "rank"])
    U = V / np.linalg.norm(V, axis=1, keepdims=True)
    for qi in [0, 5, 6, 123]:
        s = U @ V[qi] / np.linalg.norm(V[qi])
        cand = sorted([(-s[j], words[j]) for j in range(300) if j != qi], key=lambda t: (round(t[0], 12), [-ord(c) for c in t[1]]))
        exp = [w for _, w in cand[:5]]
        assert got[got["query"] == words[qi]]["word"].tolist() == exp


def test_pq_error_falls_with_k(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(600, 8))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(600), "vec": list(X)}))
    errs = []
    for k in (4, 32):
        cb = QN.pq_train(df, 2, ksub=k, niter=5)
        dec = QN.pq_decode(QN.pq_encode(df, cb, 2), cb).toPandas().sort_values("row_id")
        R = np.stack(dec["vec"].to_numpy())
        errs.append(float(((R - X) ** 2).sum(axis=1).mean()))
    assert errs[1] < errs[0]


def _lines(spark, n=120):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        words = [f"w{rng.integers(30)}" for _ in range(rng.integers(3, 12))] + ([f"good{rng.integers(3)}"] if y else [f"bad{rng.integers(3)}"])
        rows.append((i, f"__label__{y} " + " ".join(words)))
    return spark.createDataFrame(rows, "id long, line string")


def _vectors_by(df, key):
    return {r[key]: np.array(r["vec"]) for r in df.collect()}


def test_classifier_does_not_depend_on_partitions(spark):
    from textlake.operators import classifier as K
    from textlake.operators.models import Args
    models = [K.train(_lines(spark).repartition(n), "id", "line", Args(dim=6, epoch=4, lr=0.5, seed=1, word_ngrams=2, bucket=512))
              for n in (1, 8, 64)]
    for part, key in (("input", "row_id"), ("output", "label_id")):
        first = _vectors_by(getattr(models[0], part), key)
        for m in models[1:]:
            other = _vectors_by(getattr(m, part), key)
            assert first.keys() == other.keys() and all(np.allclose(first[k], other[k], atol=1e-9) for k in first)


def test_classifier_learns_and_survives_shrinking(spark):
    from textlake.operators import classifier as K
    from textlake.operators.models import Args
    m = K.train(_lines(spark), "id", "line", Args(dim=6, epoch=8, lr=0.5, seed=1))
    test = spark.createDataFrame([(i, f"w{i} w{i + 1} {'good' if i % 2 else 'bad'}{i % 3}", f"__label__{i % 2}") for i in range(30)],
                                 "id long, line string, y string")
    hits = lambda model: K.predict(model, test, "id", "line").join(test, "id").filter("label = y").count()
    assert hits(m) >= 27
    small, codes, book = K.shrink(m, 20, qnorm=True, qout=True, retrain=_lines(spark), key="id", text="line")
    assert codes.count() == 20 and hits(small) >= 25
    with pytest.raises(ValueError):
        K.shrink(K.Classifier(Args(model="skipgram"), m.vocab, m.nwords, m.input, m.output), 5)


def test_save_load_identity(spark, tmp_path):
    from textlake.operators import classifier as K
    from textlake.operators.models import Args
    m = K.train(_lines(spark, 60), "id", "line", Args(dim=8, epoch=2, lr=0.5, seed=1))
    K.save(m, str(tmp_path / "m"))
    b = K.load(spark, str(tmp_path / "m"))
    for part, key in (("input", "row_id"), ("output", "label_id")):
        one, two = _vectors_by(getattr(m, part), key), _vectors_by(getattr(b, part), key)
        assert one.keys() == two.keys() and all((one[k] == two[k]).all() for k in one)
    assert b.nwords == m.nwords and b.args == m.args


def test_embeddings_bring_shared_contexts_together(spark):
    from textlake.operators import embeddings as EM
    from textlake.operators.models import Args
    rng = np.random.default_rng(2)
    text = lambda: " ".join(rng.choice(["cat", "dog"]) + " eats " + rng.choice(["fish", "meat"]) if rng.random() < .5
                            else rng.choice(["car", "bus"]) + " needs " + rng.choice(["fuel", "oil"]) for _ in range(4))
    df = spark.createDataFrame([(i, "\n".join(text() for _ in range(3))) for i in range(60)], "id long, text string")
    for model in ("skipgram", "cbow"):
        m = EM.train(df, "id", "text", Args(model=model, dim=6, epoch=6, lr=0.3, min_count=1, ws=2, t=1.0, seed=3))
        v = {r["word"]: np.array(r["vec"]) for r in m.vocab.join(m.input, m.vocab["id"] == m.input["row_id"]).collect()}
        cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
        assert cos("cat", "dog") > cos("cat", "bus") and cos("car", "bus") > cos("car", "dog")


def test_codebook_of_few_rows_and_empty_clusters(spark):
    X = np.repeat(np.arange(6.0), 2).reshape(-1, 2)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(6), "vec": list(X)}))
    cb = QN.pq_train(df, 1, ksub=256, niter=3)
    assert cb.count() == 2 * 6                                     # no more centroids than rows
    same = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(40), "vec": [np.array([1.0])] * 39 + [np.array([5.0])]}))
    got = sorted(r["centroid"][0] for r in QN.pq_train(same, 1, ksub=4, niter=5).collect())
    assert len(got) == 4 and abs(got[-1] - 5) < 1e-3 and abs(got[0] - 1) < 1e-3


def test_padding_keeps_the_first_word(spark):
    from textlake.operators import vocab as V
    toks = spark.createDataFrame([(1, ["the", "cat"]), (2, []), (3, ["zzz"])], "id long, t array<string>")
    vocab = spark.createDataFrame([(0, "the"), (1, "cat")], "id long, word string")
    e = V.encode_tokens(toks, "id", "t", vocab, offset=1).select("id", V.pad(F.col("ids"), 4).alias("ids"))
    assert {r["id"]: r["ids"] for r in e.collect()} == {1: [0, 0, 1, 2], 2: [0] * 4, 3: [0] * 4}
    back = {r["id"]: r["words"] for r in V.decode_tokens(e, "id", "ids", vocab).collect()}
    assert back == {1: ["the", "cat"], 2: [], 3: []}


def test_mean_of_known_words_only(spark):
    df = spark.createDataFrame([(1, ["x", "unk", "unk"])], "id long, t array<string>")
    vec = spark.createDataFrame([("x", [3.0, 6.0])], "word string, vec array<double>")
    assert VE.text_vectors(df, "id", "t", vec, 2, "mean").first()["vec"] == [3.0, 6.0]


def test_vector_file_with_header_and_one_number(spark):
    from textlake.sources import files as FI
    rows = [(0, "2 1"), (1, "a 3"), (2, "b 4"), (3, "b 5"), (4, "c 1 2")]
    got = FI.parse_vectors(spark.createDataFrame(rows, "o long, value string"), ["o"])
    assert {r["word"]: r["vec"] for r in got.collect()} == {"a": [3.0], "b": [4.0]}


def test_backfill_with_a_hot_topic_over_many_partitions(spark):
    from textlake.operators import posts as P
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot" if x < .8 else "cold" for x in rng.random(2000)], "o": np.arange(2000),
                        "v": [None if rng.random() < .6 else int(i) for i in range(2000)]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, o long, v long").repartition(16)
    got = P.backfill(df, "v", ["o"], ["k"]).toPandas().sort_values("o")["v"]
    want = pdf.groupby("k")["v"].bfill()
    assert got.fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_replayed_stream_batch_is_written_once(spark, tmp_path):
    from textlake.streaming import stream as ST
    write = ST.append_spam_table(str(tmp_path / "t"))
    batch = spark.createDataFrame([(1,), (2,)], "user_id long")
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_topic_that_keeps_nothing_reports_no_rejected_posts(spark):
    import datetime as dt
    from textlake.plans.trend import trend_matrix
    from textlake.sources import tables as S
    posts = S.posts(spark, "/root/testdata/sf0.001")
    one = posts.select("topic").first()[0]
    young = posts.withColumn("user_age_days", F.when(F.col("topic") == one, 0).otherwise(F.col("user_age_days")))
    for c in ("user_posts_count", "user_follower_count", "user_favorite_count", "tweet_favorite_count", "retweet_count"):
        young = young.withColumn(c, F.when(F.col("topic") == one, F.lit(0)).otherwise(F.col(c)))
    dim = S.topic_ids(spark, "/root/testdata/sf0.001")
    r = trend_matrix(young, dim, mode="T").filter(F.col("name") == one).first()
    assert (r["number_tweets"], r["number_tweets_rejected"]) == (-1, 0)
    assert isinstance(r["start_date"], dt.datetime)


def test_word_vector_is_mean_of_subword_rows(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(50, 4))
    rf = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(50), "vec": list(rows)}))
    words = spark.createDataFrame([("hello",)], "word string")
    wv = VE.word_vectors(words, rf, 4, None, 0, 50, 3, 4).first()["vec"]
    grams = ["<he", "<hel", "hel", "hell", "ell", "ello", "llo", "llo>", "lo>"]
    exp = rows[[_fnv(g) % 50 for g in grams]].mean(axis=0)
    assert np.allclose(wv, exp)


def test_every_word_can_be_a_negative(spark):
    """Draws follow the distribution over the whole vocabulary, neg of them for every example."""
    from textlake.operators import embeddings as EM
    n = 20_000
    dist = spark.range(n).select("id", ((F.col("id") % 4 + 1) / (2.5 * n)).alias("p_negative"))
    cells = EM.draw_cells(dist)
    assert cells[0].count() <= 2 * n
    examples = spark.range(40_000).select((F.col("id") % 7).alias("_bag"), F.col("id").alias("word_id"), (F.col("id") % 3 + 1.0).alias("weight"))
    got = EM.negatives(EM.with_own_range(examples, cells), "_bag", cells, 5, 1)
    rows = got.groupBy((F.col("word_id") % 4).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("d")).orderBy("k").collect()
    assert sum(r["n"] for r in rows) == 200_000 and sum(r["d"] for r in rows) > 19_500
    assert all(abs(r["n"] / 200_000 - (r["k"] + 1) / 10) < 0.01 for r in rows)
    assert abs(got.agg(F.sum("weight")).first()[0] - 5 * examples.agg(F.sum("weight")).first()[0]) < 1e-6


def _region_loop(text):
    """The gate record by record, with its state carried along."""
    import re
    on, out = False, []
    for r in re.findall(r"[^>]*>|[^>]+$", text):
        on = on or "<text " in r
        if re.search("#redirect", r, re.I):
            on = False
        if on:
            out.append(r)
            on = "</text>" not in r
    return out


def test_text_regions_equal_a_loop_over_the_records(spark):
    import random
    from textlake.functions import text as T
    rng = random.Random(5)
    marks = ["<text x>", "</text>", "#REDIRECT", "#redirect [[a]]", "<b>", "word ", ">", "<text ", "", "\n"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(400)] + ["", "<text a>" * 3000 + "</text>" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", T.region_records(F.regexp_extract_all("t", F.lit(T.RECORD_RE), 0)).alias("r")).collect()}
    assert got.pop(-1) is None
    assert got == {i: _region_loop(t) for i, t in enumerate(texts)}


def test_failed_topics_are_kept_apart_and_the_rest_is_unchanged(spark):
    from textlake.plans.trend import split_failed, topic_faults, trend_matrix, trend_run
    from textlake.sources import tables as S
    posts, dim = S.posts(spark, "/root/testdata/sf0.001"), S.topic_ids(spark, "/root/testdata/sf0.001")
    assert topic_faults(posts).count() == 0
    topics = sorted(r["topic"] for r in posts.select("topic").distinct().collect())
    bad = posts.withColumn("compound", F.when(F.col("topic") == topics[0], F.lit(float("nan"))).otherwise(F.col("compound")))
    bad = bad.unionByName(bad.limit(3).withColumn("topic", F.lit(None).cast("string")))
    run = trend_run(bad, dim, "GT", spark.createDataFrame([(topics[0],), ("nobody",)], "topic string"))
    matrix, failed = split_failed(run)
    n = posts.filter(F.col("topic") == topics[0]).count()
    assert {r["name"]: (r["failed_reason"], r["n_faulty"]) for r in failed.collect()} == {
        topics[0]: ("missing compound", n), "nobody": ("no posts", 0), None: ("no topic", 3)}
    whole = trend_matrix(posts, dim, "GT").filter(F.col("name") != topics[0])
    assert sorted(map(str, matrix.collect())) == sorted(map(str, whole.collect()))
    # nothing readable at all, and no posts at all
    blank = posts.withColumn("tweet_created_at", F.lit(None).cast(dict(posts.dtypes)["tweet_created_at"]))
    assert {r["failed_reason"] for r in trend_run(blank, dim, "T").collect()} == {"missing tweet_created_at"}
    assert trend_run(posts.limit(0), dim, "T").count() == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_label_tiles_give_the_same_as_one_matrix(spark, k):
    """More labels than a tile: states of tiles merge into the softmax over all of them."""
    from textlake.operators import evaluation as EV
    rng = np.random.default_rng(1)
    W, H = rng.normal(size=(37, 5)).round(1), rng.normal(size=(60, 5)).round(1)
    W[7] = W[3]                                                   # a tie
    H[0] = 0                                                      # all labels tie
    labels = spark.createDataFrame([(f"l{i:02d}", list(map(float, w))) for i, w in enumerate(W)], "label string, vec array<double>")
    hidden = spark.createDataFrame([(i // 2, list(map(float, h))) for i, h in enumerate(H)], "id long, vec array<double>")
    rows = lambda d: sorted((r["id"], r["rank"], r["label"], round(r["prob"], 9)) for r in d.collect())
    whole = rows(EV.predict(hidden, "id", labels, k))
    assert len(whole) == 60 * min(k, 37)
    assert rows(EV.predict(hidden, "id", labels, k, label_tile=5, row_block=16)) == whole
    assert rows(EV.predict(hidden, "id", labels, k, 0.05, 5, 16)) == rows(EV.predict(hidden, "id", labels, k, 0.05))
    assert EV.predict(hidden.limit(0), "id", labels, k, label_tile=5).count() == 0


def test_word_ngrams_need_no_wide_numbers(spark):
    """Hashes of every sign and size, levels 2 to 5, in 64-bit whole numbers only."""
    rng = np.random.default_rng(3)
    hs = [int(x) for x in rng.integers(0, 2 ** 32, size=40)] + [0, 2 ** 31 - 1, 2 ** 31, 2 ** 32 - 1]
    df = spark.createDataFrame([(hs,)], "h array<bigint>").select(H.word_ngram_buckets(F.col("h"), 5, 2 ** 31 - 1, 3).alias("b"))
    want = []
    for n in range(2, 6):
        for i in range(len(hs) - n + 1):
            h = 0
            for x in hs[i:i + n]:
                h = (h * 116049371 + (x - 2 ** 32 if x >= 2 ** 31 else x)) % 2 ** 64
            want.append(h % (2 ** 31 - 1) + 3)
    assert df.first()["b"] == want
    assert "decimal" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
