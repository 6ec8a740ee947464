"""Embeddings from units of lines: examples and negatives are made inside tasks."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlake.operators import embeddings as EM
from textlake.operators import vectors as VE
from textlake.operators.models import Args

DIM, WORDS = 4, 30


def _lines(spark):
    rng = np.random.default_rng(6)
    lines = [(int(rng.integers(-1 << 62, 1 << 62)), [int(w) for w in rng.zipf(1.5, int(rng.integers(2, 40))) % WORDS]) for _ in range(40)]
    words = [(w, (w + 1.0) / 465, 1.0 / (w + 1)) for w in range(WORDS)]
    return spark.createDataFrame(lines, "_h long, words array<long>"), spark.createDataFrame(words, "id long, p_negative double, keep_prob double")


def test_draws_inside_a_task_are_those_of_the_join(spark):
    _, words = _lines(spark)
    examples = spark.range(300).select((F.col("id") * 7919 - 99).alias("_bag"), (F.col("id") % 31).alias("word_id"), F.lit(1.0).alias("weight"))
    cells = EM.draw_cells(words.select("id", "p_negative"))
    want = EM.negatives(EM.with_own_range(examples, cells), "_bag", cells, 5, 77).groupBy("_bag").agg(F.sort_array(F.collect_list("word_id")).alias("n"))
    rows = [(1, r["id"], max(1, round(r["p_negative"] * EM.SCALE)), 1.0, [0.0] * DIM) for r in words.collect()]
    unit = EM.Unit(pa.table(dict(zip(["kind", "id", "share", "keep", "vec"], map(list, zip(*rows))))), DIM, 5, 77)
    e = examples.toPandas()
    word = e["word_id"].to_numpy()
    own = np.where(word < WORDS, unit.share[word % WORDS], 0)       # word 30 is unknown
    low = np.where(word < WORDS, unit.end[word % WORDS] - own, 0)
    got = unit.drawn(EM.hash_long(word, EM.hash_long(e["_bag"].to_numpy(), unit.start)), own, low)
    assert dict(zip(e["_bag"], map(sorted, got.tolist()))) == {r["_bag"]: r["n"] for r in want.collect()}


@pytest.mark.parametrize("model", ["skipgram", "cbow"])
def test_lines_give_the_rows_of_their_examples(spark, monkeypatch, model):
    """Whatever the units, the tiles and the cuts, and without a table of examples."""
    lines, words = _lines(spark)
    args = Args(model=model, dim=DIM, epoch=3, lr=0.3, neg=3, ws=3, seed=5)
    k = words.select(F.col("id").alias("word_id"), F.col("keep_prob").alias("k"))
    if model == "skipgram":
        p = VE.skipgram_pairs(lines, "words", 3).groupBy(F.col("center").alias("_bag"), F.col("context").alias("word_id")).agg(F.sum("weight").alias("weight"))
        p = p.join(k, "word_id").join(k.select(F.col("word_id").alias("_bag"), F.col("k").alias("k1")), "_bag")
        examples = p.select("_bag", "word_id", (F.col("weight") * F.col("k") * F.col("k1")).alias("weight"))
        bags = words.select(F.col("id").alias("_bag"), F.col("id").alias("row_id"), F.lit(1.0).alias("w"))
    else:
        at = lines.select("_h", F.posexplode(VE.cbow_bags(F.col("words"), 3)).alias("pos", "b"))
        # the hash of the line goes on with the position
        keys = spark.createDataFrame([(r["_h"], r["pos"], int(EM.hash_int(np.array([r["pos"]]), np.array([r["_h"]]).view(np.uint64)).view(np.int64)[0]))
                                      for r in at.collect()], "_h long, pos int, _bag long")
        at = at.join(keys, ["_h", "pos"])
        examples = at.select("_bag", F.col("b.center").alias("word_id")).join(k, "word_id").select("_bag", "word_id", F.col("k").alias("weight"))
        bags = at.select("_bag", F.size("b.context").alias("n"), F.explode("b.context").alias("row_id")).groupBy("_bag", "row_id").agg((F.count("*") / F.first("n")).alias("w"))
    table = lambda df: {r[0]: np.array(r[1]) for r in df.collect()}
    want = [table(x) for x in EM.fit_pairs(bags, examples, "_bag", words.select("id", "p_negative"), args)]
    for unit in (60, 1 << 21):
        if unit == 60:
            monkeypatch.setattr(EM, "LEAST_UNITS", 1)
        for got, w in zip((table(x) for x in EM.fit_lines(lines, None, words, args, unit)), want):
            assert got.keys() == w.keys() and all(np.abs(got[i] - w[i]).max() < 1e-9 for i in w)


def test_units_stay_few_as_the_text_grows():
    """Every unit sends a sum of every word that it draws: 270 million words (about 1 GB) were 129 units."""
    assert EM.lines_units(270_000_000) == 17 and EM.lines_units(4_000_000) == 16 and EM.lines_units(300) == 1


def test_rows_are_stored_once_for_all_units(spark, monkeypatch):
    """Units read the rows of a round from the shared folder: its files hold each row once and go after the round."""
    lines, words = _lines(spark)
    rows, files, store = [], [], EM._stored

    def stored(df, folder):
        rows.append(df.count())
        files.append((folder, store(df, folder)))
        return files[-1][1]
    monkeypatch.setattr(EM, "_stored", stored)
    EM.fit_lines(lines, None, words, Args(model="skipgram", dim=DIM, epoch=2, neg=2, seed=5), 60)
    assert rows == [WORDS] * 4
    for folder, names in files:
        assert names and not any(os.path.exists(f"{EM.SH._at(folder)[1]}/{n}") for n in names)


def test_stored_rows_come_back_sorted_and_only_those_wanted(spark):
    df = spark.range(100).select((100 - F.col("id")).alias("id"), F.col("id").alias("share"), F.lit(0.5).alias("keep"), F.col("id").cast("double").alias("v0"))
    folder = EM.SH.folder(spark, "rows")
    names = EM._stored(df.repartition(7), folder)
    ids, share, keep, vec = EM._load(folder, names, 1)
    assert ids.tolist() == list(range(1, 101)) and share.tolist() == list(range(99, -1, -1)) and vec[:, 0].tolist() == share.tolist()
    ids, share, _, _ = EM._load(folder, names, 1, np.array([3, 50, 777]))
    assert ids.tolist() == [3, 50] and share.tolist() == [97, 50] and set(keep) == {0.5}
