"""Approximate nearest neighbours: robust-pruned directed graph per shard.

The vectors are dealt into shards of about ``shard_rows`` by a hash of their
id.  One task builds the graph of one shard: points are added in batches, a
greedy beam search on the graph so far proposes neighbours, and relaxed distance
pruning keeps an edge only if no kept neighbour is ``alpha`` times closer to
its end, so the kept edges point in different directions; edges are also added
backwards and pruned again where a point gets too many.  The graphs are written to the
shared checkpoint folder, one row a shard.  Queries come in blocks of a
bounded size; each block meets each shard in a task and searches it with a beam; the shards' answers
are merged by score.

Nearness is the cosine; the graph works on unit vectors in single precision,
the answers are scored on the original vectors in double precision.  Vectors of
the same direction are one node of a graph (with all its members), so crowds of
equal vectors neither lengthen a search nor crowd out an answer.

Defined results
* null vectors, empty ones, ones with null or non-finite components and zero
  vectors take no part, neither do rows with a null id;
* rows that repeat an id count once (their least vector);
* ties go to the smaller id; fewer candidates than ``k``: all of them;
* vectors are compared within their own number of components;
* an empty table, or no query, gives an empty result;
* other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import cut


@dataclass(frozen=True)
class Params:
    shard_rows: int = 8192
    degree: int = 32            # edges of a node after pruning
    slack: int = 48             # edges a node may gather before it is pruned again
    build_beam: int = 64
    alpha: float = 1.2          # relaxation of the pruning, on distances
    search_beam: int = 128
    expand: int = 4             # nodes expanded in a step
    batch: int = 256            # points added, or queries searched, at once
    query_block: int = 20_000   # queries that a task searches at once


class Graph:
    """Unit vectors, adjacency (padded with -1) and the entry point of a shard."""

    def __init__(self, x: np.ndarray, p: Params):
        self.x, self.p = x, p
        self.adj = np.full((len(x), p.slack), -1, np.int32)
        self.deg = np.zeros(len(x), np.int64)
        self.entry = int(np.argmax(x @ x.mean(0))) if len(x) else -1

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q``: the ``width`` nearest nodes a beam search
        meets and their squared distances (padded with -1 and inf)."""
        n, m, e = len(q), len(self.x), self.p.expand
        seen = np.zeros((n, m), bool)
        ids = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf, np.float32)
        done = np.ones((n, width), bool)
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = 2 - 2 * (q @ self.x[self.entry])
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            d = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(d, e - 1, axis=1)[:, :e] if width > e else np.argsort(d, axis=1)
            chosen = np.take_along_axis(d, pick, 1)
            on = np.isfinite(chosen)
            go = on.any(1)
            live, pick, on = live[go], pick[go], on[go]
            if not len(live):
                break
            rows = live[:, None]
            done[rows, pick] = True
            at = ids[rows, pick]
            nbr = self.adj[np.where(on, at, 0)]
            nbr[~on] = -1
            nbr = nbr.reshape(len(live), -1).astype(np.int64)
            fresh = nbr >= 0
            fresh &= ~seen[rows, np.maximum(nbr, 0)]
            # the same neighbour reached over two of the expanded nodes counts once
            order = np.argsort(np.where(fresh, nbr, m), axis=1, kind="stable")
            nbr, fresh = np.take_along_axis(nbr, order, 1), np.take_along_axis(fresh, order, 1)
            fresh[:, 1:] &= nbr[:, 1:] != nbr[:, :-1]
            most = int(fresh.sum(1).max(initial=0))
            if not most:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            nbr, fresh = np.take_along_axis(nbr, order, 1), np.take_along_axis(fresh, order, 1)
            safe = np.where(fresh, nbr, 0)
            seen[np.broadcast_to(rows, nbr.shape)[fresh], nbr[fresh]] = True
            nd = 2 - 2 * np.matmul(self.x[safe], q[live][:, :, None])[:, :, 0]
            nd[~fresh] = np.inf
            all_d = np.concatenate([dist[live], nd], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, nbr, -1)], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning: up to ``degree`` of each point's candidates (padded with -1)."""
        relax = np.float32(self.p.alpha ** 2)
        ok = (cand >= 0) & (cand != points[:, None])
        safe = np.where(ok, cand, 0)
        xc = self.x[safe]
        d = 2 - 2 * np.matmul(xc, self.x[points][:, :, None])[:, :, 0]
        d[~ok] = np.inf
        left = d.copy()
        out = np.full((len(points), self.p.degree), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(self.p.degree):
            best = left.argmin(1)
            have = np.isfinite(left[rows, best])
            if not have.any():
                break
            out[have, k] = safe[rows, best][have]
            between = 2 - 2 * np.matmul(xc, xc[rows, best][:, :, None])[:, :, 0]
            left[relax * between <= d] = np.inf
            left[rows, best] = np.inf
        return out

    def _set(self, points: np.ndarray, edges: np.ndarray) -> None:
        self.adj[points] = -1
        self.adj[points, :edges.shape[1]] = edges
        self.deg[points] = (edges >= 0).sum(1)

    def _backward(self, points: np.ndarray, edges: np.ndarray) -> None:
        """Add the reverse of point -> edge; prune nodes that overflow."""
        src = np.repeat(points, edges.shape[1])
        dst = edges.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        fits = self.deg[nodes] + count <= self.p.slack
        place = self.deg[dst] + np.arange(len(dst)) - np.repeat(first, count)
        direct = np.repeat(fits, count)
        self.adj[dst[direct], place[direct]] = src[direct]
        self.deg[nodes[fits]] += count[fits]
        over = np.flatnonzero(~fits)
        for lo in range(0, len(over), self.p.batch):
            some = over[lo:lo + self.p.batch]
            cand = np.full((len(some), self.p.slack + int(count[some].max())), -1, np.int64)
            cand[:, :self.p.slack] = self.adj[nodes[some]]
            for r, k in enumerate(some):
                cand[r, self.p.slack:self.p.slack + count[k]] = src[first[k]:first[k] + count[k]]
            self._set(nodes[some], self.prune(nodes[some], cand))

    def build(self) -> "Graph":
        m, p = len(self.x), self.p
        order = np.random.default_rng(7).permutation(m)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        at = 1
        while at < m:
            points = order[at:at + min(p.batch, max(at // 2, 1))]
            ids, _ = self.beam(self.x[points], p.build_beam)
            edges = self.prune(points, ids)
            self._set(points, edges)
            self._backward(points, edges)
            at += len(points)
        return self


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_shard(ids: np.ndarray, raw: np.ndarray, p: Params) -> dict:
    """Graph over the distinct directions; members of node i are
    ``member[start[i]:start[i+1]]`` (row numbers, by id)."""
    x = unit(raw).astype(np.float32) + np.float32(0)
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, node = np.unique(keys, return_index=True, return_inverse=True)
    member = np.lexsort((ids, node))
    start = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(first)))])
    g = Graph(x[first], p).build()
    return {"ids": ids, "raw": raw, "nodes": g.x, "adj": g.adj, "entry": g.entry, "member": member, "start": start}


def search_shard(s: dict, qid: np.ndarray, q: np.ndarray, k: int, p: Params):
    """(query number, vector id, score) of the k best of the shard for each query."""
    g = Graph.__new__(Graph)
    g.x, g.p, g.adj, g.entry = s["nodes"], p, s["adj"], int(s["entry"])
    norm = np.sqrt((s["raw"] * s["raw"]).sum(1))
    out = []
    for lo in range(0, len(q), p.batch):
        part, own = q[lo:lo + p.batch], qid[lo:lo + p.batch]
        ids, _ = g.beam(unit(part).astype(np.float32), p.search_beam)
        for r in range(len(part)):
            near = ids[r][ids[r] >= 0][:4 * k + 4]
            rows = np.concatenate([s["member"][s["start"][i]:s["start"][i + 1]] for i in near])
            rows = rows[s["ids"][rows] != own[r]]
            score = (s["raw"][rows] * part[r]).sum(1) / (norm[rows] * np.sqrt((part[r] * part[r]).sum()))
            best = np.lexsort((s["ids"][rows], -score))[:k]
            out += [(lo + r, int(s["ids"][rows[b]]), float(score[b])) for b in best]
    return out


_PACKED = (("ids", np.int64), ("raw", np.float64), ("nodes", np.float32), ("adj", np.int32),
           ("member", np.int64), ("start", np.int64))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Usable vectors: ``vec_id``, ``v`` (doubles), ``dim``; one row an id."""
    return (df.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
            .groupBy(F.col(vec_id).cast("long").alias("vec_id"))
            .agg(F.min(F.col(embedding).cast("array<double>")).alias("v"))
            .withColumn("dim", F.size("v")))


def build_index(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """One row a shard with its packed graph, in the shared checkpoint folder."""
    n = rows.count()
    shards = max(1, -(-n // p.shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        s = build_shard(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64), p)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "entry": [s["entry"]],
                             **{name: [np.ascontiguousarray(s[name], kind).tobytes()] for name, kind in _PACKED}})

    schema = "shard int, dim int, entry long, " + ", ".join(f"{name} binary" for name, _ in _PACKED)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard", "dim").applyInPandas(build, schema))


def _unpack(row, p: Params) -> dict:
    s = {name: np.frombuffer(row[name], kind) for name, kind in _PACKED}
    dim = int(row["dim"])
    return {"ids": s["ids"], "raw": s["raw"].reshape(-1, dim), "nodes": s["nodes"].reshape(-1, dim),
            "adj": s["adj"].reshape(-1, p.slack), "member": s["member"], "start": s["start"], "entry": row["entry"]}


def search(index: DataFrame, queries: DataFrame, k: int = 5, p: Params = Params()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest of each query
    (``vec_id``, ``v``, ``dim``), itself left out.

    Blocks of queries and shards meet by an equality join on (block, shard), so
    neither passes through the driver and a task holds one block and one shard."""
    blocks = max(1, -(-queries.count() // p.query_block))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    s = index.withColumn("block", every(blocks))

    def answer(q: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(shard):
            qid = q["vec_id"].to_numpy(np.int64)
            own = _unpack(shard.iloc[0], p)
            found = [(int(qid[i]), v, x) for i, v, x in search_shard(own, qid, np.stack(q["v"].to_numpy()).astype(np.float64), k, p)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["block", "shard", "dim"]
    answers = q.groupBy(*key).cogroup(s.groupBy(*key)).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, p: Params = Params(), vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """Index every usable row of ``df`` and search it with the rows where ``is_query``."""
    rows = cut(vectors(df, vec_id, embedding))
    return search(build_index(rows, p), rows.filter(is_query), k, p)
