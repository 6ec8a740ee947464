"""Nearest words inside a task: tiles of vectors merge, and the memory follows the tile."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from textlake.operators import vectors as VE


def test_tiles_merge_and_bound_the_memory():
    rng = np.random.default_rng(4)
    n, m, dim, k = 20_000, 520, 8, 3
    V, Q = rng.normal(size=(n, dim)), rng.normal(size=(m, dim))
    V /= np.linalg.norm(V, axis=1)[:, None]
    V[[5, 4500, 19_000]] = Q[0] / np.linalg.norm(Q[0])          # the best words of one query lie in three tiles
    names = np.array([f"w{i:05d}" for i in range(n)], dtype=object)
    q = pd.DataFrame({"qid": np.arange(m), "qvec": list(Q), "ban": [["w00005"] if i == 0 else None for i in range(m)]})
    v = pd.DataFrame({"word": names, "uvec": list(V)})
    tracemalloc.start()
    got = VE._best_words(q, v, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20                                       # one score matrix of the block takes 82 MB
    S = V @ (Q / np.linalg.norm(Q, axis=1)[:, None]).T
    S[5, 0] = -2
    for j in range(m):
        mine = [(w, s) for qid, w, s in got if qid == j]
        assert {w for w, _ in mine} == set(names[np.argsort(-S[:, j])[:k]])
        assert np.allclose([s for _, s in mine], np.sort(S[:, j])[::-1][:k])


def _plain(V, names, Q, bans, k):
    out = []
    for j, query in enumerate(Q):
        n = np.linalg.norm(query)
        sims = V @ (query / (n if n >= VE.QUERY_NORM_FLOOR else 1.0))
        out.append(sorted(((round(float(s), 13), w) for s, w in zip(sims, names) if w not in bans[j]), reverse=True)[:k])
    return out


def test_close_and_equal_vectors_are_told_apart_in_double_precision(monkeypatch):
    """Vectors closer than single precision can tell, copies of one vector, null queries, bans: the plain answer."""
    monkeypatch.setattr(VE, "QUERY_TILE", 7)
    monkeypatch.setattr(VE, "WORD_TILE", 50)
    rng = np.random.default_rng(2)
    V = rng.normal(size=(400, 64))
    V[100:200] = V[0] + 1e-4 * rng.normal(size=(100, 64))
    V /= np.linalg.norm(V, axis=1)[:, None]
    V[250:320] = V[7]
    V[330:340] = 0
    names = np.array([f"w{int(i)}" for i in rng.permutation(400)], dtype=object)
    Q = np.r_[V[[0, 7, 150, 330]], rng.normal(size=(20, 64)), 1e-9 * rng.normal(size=(2, 64))]
    bans = [[names[0], names[260]] if j % 2 else None for j in range(len(Q))]
    q = pd.DataFrame({"qid": np.arange(len(Q)), "qvec": list(Q), "ban": bans})
    got = VE._best_words(q, pd.DataFrame({"word": names, "uvec": list(V)}), 5)
    for j, want in enumerate(_plain(V, names, Q, [x or () for x in bans], 5)):
        assert [(round(s, 13), w) for qid, w, s in got if qid == j] == want


def test_copies_of_a_vector_are_scored_once(monkeypatch):
    """A table of copies: of equal vectors only as many as can be among the best are scored."""
    V, names = np.repeat(np.eye(8), 500, axis=0), np.array([f"w{i:04d}" for i in range(4000)], dtype=object)
    kept, words = VE._first_copies(V, names, 3)
    assert len(kept) == 24 and sorted(words)[:3] == ["w0497", "w0498", "w0499"]
