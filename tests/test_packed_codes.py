"""Packed codes: bytes of codes, means from the codebooks, a saved compact model."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import classifier as K
from textlake.operators import quant as QN
from textlake.operators.models import Args


@pytest.mark.parametrize("with_norms", [False, True])
def test_means_from_codes_equal_the_decoded_rows(spark, with_norms):
    rng = np.random.default_rng(6)
    n, widths = 500, [2, 2, 1]
    book = [(s, c, [float(x) for x in rng.normal(size=w)]) for s, w in enumerate(widths) for c in range(256)]
    norms = [(0, c, [float(c) / 16]) for c in range(256)]
    codes = rng.integers(0, 256, (n, 4 if with_norms else 3))
    table = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(codes)], "row_id long, codes array<bigint>")
    packed = QN.Packed(QN.pack(table), spark.createDataFrame(book, "sub int, code bigint, centroid array<double>"),
                       spark.createDataFrame(norms, "sub int, code bigint, centroid array<double>") if with_norms else None)
    assert {r["row_id"]: list(r["code"]) for r in packed.rows.collect()} == {i: list(c) for i, c in enumerate(codes)}
    assert QN.code_bytes(packed) == codes.size
    # "hot" holds a third of all members; row 999 has no code, key "none" has no other
    members = [("hot", int(r), 0.5) for r in rng.integers(0, n, 700)] + [
        (f"k{i % 40}", int(r), float(i % 3 + 1)) for i, r in enumerate(rng.integers(0, n, 1400))] + [("k1", 999, 9.0), ("none", 999, 1.0)]
    C = {(s, c): np.array(v) for s, c, v in book}
    row = lambda i: np.concatenate([C[s, codes[i, s]] for s in range(3)]) * (codes[i, 3] / 16 if with_norms else 1)
    want = {}
    for k in {m[0] for m in members} - {"none"}:
        mine = [(r, w) for key, r, w in members if key == k and r != 999]
        want[k] = sum(w * row(r) for r, w in mine) / sum(w for _, w in mine)
    for parts in (1, 16):
        df = spark.createDataFrame(members, "doc string, row_id long, w double").repartition(parts)
        got = {r["doc"]: np.array(r["vec"]) for r in QN.weighted_means(df, "doc", packed).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
    assert QN.weighted_means(df.limit(0), "doc", packed).count() == 0


def test_saved_compact_model_predicts_the_same(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"__label__{i % 2} w{i % 7} {'good' if i % 2 else 'bad'}{i % 3}") for i in range(60)], "id long, line string")
    small, _, _ = K.shrink(K.train(lines, "id", "line", Args(dim=5, epoch=3, lr=0.5, min_count=1, seed=1)), 8, qnorm=True)
    K.save(small, str(tmp_path / "m"))
    back = K.load(spark, str(tmp_path / "m"))
    assert QN.code_bytes(back.packed) == 8 * (3 + 1)                  # dimension 5: parts of 2, 2 and 1, and the norm
    texts = spark.createDataFrame([(1, "good1 w3"), (2, "bad2"), (3, "nothing known"), (4, ""), (5, None)], "id long, line string")
    answers = [{(r["id"], r["rank"]): (r["label"], round(r["prob"], 9)) for r in K.predict(m, texts, "id", "line", 2).collect()}
               for m in (small, back, replace(small, packed=None))]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 10
