"""Rounds of the classifier by units of lines against a plain loop."""

from __future__ import annotations

import os

import numpy as np
import pytest

from textlake.operators import classifier as K
from textlake.operators import models as M

DIM = 3


@pytest.mark.parametrize("unit", [4, 1 << 20])
def test_rounds_equal_a_plain_loop_for_units_of_any_size(spark, unit):
    rng = np.random.default_rng(2)
    lines = [(k, [int(x) for x in rng.integers(0, 12, size=n)], y) for k, (n, y) in enumerate(
        [(3, [0]), (20, [1]), (1, [2, 0]), (6, [1]), (9, [0, 1, 2]), (4, [2])])]
    start = {i: rng.normal(size=DIM) for i in range(13)}         # 12 is in no line
    args = M.Args(dim=DIM, lr=0.5, epoch=3)
    rows, B = K.fit_rows(spark.createDataFrame(lines, "id long, features array<long>, labels array<long>"), "id",
                         spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "row_id long, vec array<double>"), 3, args, unit=unit)
    got = {r["row_id"]: [r[f"v{i}"] for i in range(DIM)] for r in rows.collect()}
    X, b, gx, gb = np.array([start[i] for i in range(13)]), np.zeros((3, DIM)), np.zeros(13), np.zeros(3)
    for e in range(3):
        rate, dx, db = 0.5 * (1 - e / 3), np.zeros_like(X), np.zeros_like(b)
        for _, f, y in lines:
            h = X[f].mean(0)
            p = np.exp(b @ h) / np.exp(b @ h).sum()
            err = np.array([(1 / len(y) if l in y else 0.0) for l in range(3)]) - p
            db += np.outer(err, h)
            for i in f:
                dx[i] += err @ b / len(f)
        gx, gb = gx + (dx * dx).mean(1), gb + (db * db).mean(1)
        X, b = X + rate * dx / np.sqrt(gx + K.EPS)[:, None], b + rate * db / np.sqrt(gb + K.EPS)[:, None]
    assert np.allclose(B, b) and np.allclose([got[i] for i in range(13)], X)


def test_a_round_stores_the_rows_once_for_all_units(spark, monkeypatch):
    """Units read their rows from files, which go after the round: no exchange of (unit, row)."""
    made, store = [], K.SH.stored

    def stored(df, folder):
        made.append((df.count(), folder, store(df, folder)))
        return made[-1][2]
    monkeypatch.setattr(K.SH, "stored", stored)
    lines = spark.createDataFrame([(k, [0, 1, 2, 3 + k % 4], [k % 2]) for k in range(30)], "id long, features array<long>, labels array<long>")
    start = spark.createDataFrame([(i, [0.1 * i] * DIM) for i in range(7)], "row_id long, vec array<double>")
    rows, _ = K.fit_rows(lines, "id", start, 2, M.Args(dim=DIM, lr=0.5, epoch=2), unit=8)
    assert rows.count() == 7 and [n for n, _, _ in made] == [7, 7]
    assert not any(os.path.exists(f"{K.SH._at(folder)[1]}/{name}") for _, folder, names in made for name in names)
