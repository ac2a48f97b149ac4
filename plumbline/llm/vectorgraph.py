"""Approximate nearest neighbours by inner product: robust-pruned directed graphs over shards of the vectors.

Vectors are dealt by hash into shards of about SHARD. Within a shard equal vectors are one node. Inner products become distances by one more
component, sqrt(M - |x|^2) with M the shard's largest squared norm, so the nearest point of a query (extended by 0) is the one with the largest
inner product. Nodes enter the graph in random order, in batches that double up to BATCH: a greedy beam search from the entry points (the centre
and ENTRIES drawn nodes) proposes neighbours, and robust pruning keeps the nearest candidate, sets those aside that are nearer to it than to the
node, and goes on; when only such are left, those whose distance to every kept neighbour is more than 1 / ALPHA of that to the node follow, DEGREE
edges at most. Edges back are added and pruned the same way once a list is full. A second pass over all nodes refines the lists.

``search`` sends every query to every shard (in blocks of queries), walks its graph with a beam of BEAM, and scores the nodes found on the original
vectors in double precision, component by component from the first, so equal vectors score alike. Recall was measured on vectors of unit length and
of lengths drawn evenly; where a crowd of short vectors outweighs long ones that point elsewhere, a beam of this width can end in the crowd.

Vectors that are NULL, empty, zero or hold a NULL or non-finite component take no part. Rows with equal id and vector are one; rows that share
only the id are candidates of their own, and a query's own row is the one with its id and vector. Rows with a NULL id can be neither query nor
candidate. Vectors meet only vectors of their length. Ties go to the smaller id. Empty tables give no rows; other columns are not read. Nothing is
sampled: every vector is a node of a graph, and the graphs are a stored table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

SHARD = 8192
DEGREE, SLACK, ALPHA, ENTRIES = 28, 48, 1.2, 24
BUILD_BEAM, BEAM = 72, 112
BATCH, AHEAD = 256, 4
QUERIES = 8192

_GRAPH = "shard long, dims long, ids binary, starts binary, vectors binary, edges binary, entries binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


class Graph:
    """A directed graph over the rows of ``points`` (float32); -1 marks a free place in ``edges``."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None, entries: np.ndarray):
        self.points, self.squares = points, _squares(points)
        self.edges = np.full((len(points), SLACK), -1, np.int32) if edges is None else edges
        self.entries = entries

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and squared distances less |query|^2 of a beam search for every query, nearest first."""
        rows = np.arange(len(queries))
        ids = np.full((len(queries), width), -1, np.int64)
        far = np.full((len(queries), width), np.inf, np.float32)
        done = np.ones((len(queries), width), bool)
        seen = np.zeros((len(queries), len(self.points)), bool)
        start = self.squares[self.entries] - 2 * np.einsum("qd,ed->qe", queries, self.points[self.entries])
        order = np.argsort(start, axis=1, kind="stable")[:, :width]
        first = order.shape[1]
        ids[:, :first], done[:, :first] = self.entries[order], False
        far[:, :first] = np.take_along_axis(start, order, 1)
        seen[:, self.entries] = True
        live = rows
        while len(live):
            waiting = ~done[live]
            # the nearest AHEAD unvisited nodes of each beam (the beam is sorted)
            turn = waiting & (np.cumsum(waiting, axis=1) <= AHEAD)
            q, at = np.nonzero(turn)
            done[live[q], at] = True
            near = self.edges[ids[live[q], at]]
            who, what = np.repeat(live[q], near.shape[1]), near.ravel().astype(np.int64)
            ok = what >= 0
            who, what = who[ok], what[ok]
            new = ~seen[who, what]
            who, what = who[new], what[new]
            flat = np.unique(who * len(self.points) + what)
            who, what = flat // len(self.points), flat % len(self.points)
            seen[who, what] = True
            if len(who):
                d = self.squares[what] - 2 * np.einsum("ij,ij->i", self.points[what], queries[who])
                counts = np.bincount(who, minlength=len(queries))
                place = np.arange(len(who)) - (np.cumsum(counts) - counts)[who]
                touched = np.flatnonzero(counts)
                row = np.full(len(queries), -1)
                row[touched] = np.arange(len(touched))
                most = int(counts.max())
                more_ids, more_far = np.full((len(touched), most), -1, np.int64), np.full((len(touched), most), np.inf, np.float32)
                more_ids[row[who], place], more_far[row[who], place] = what, d
                all_far = np.concatenate([far[touched], more_far], axis=1)
                order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
                far[touched] = np.take_along_axis(all_far, order, 1)
                ids[touched] = np.take_along_axis(np.concatenate([ids[touched], more_ids], axis=1), order, 1)
                done[touched] = np.take_along_axis(np.concatenate([done[touched], np.zeros((len(touched), most), bool)], axis=1), order, 1) | (ids[touched] < 0)
            live = rows[(~done).any(axis=1)]
        return ids, far

    def prune(self, nodes: np.ndarray, proposed: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """Robust pruning of the proposed neighbours (-1: none) of every node: (nodes, DEGREE)."""
        own = self.points[nodes]
        proposed = np.sort(proposed, axis=1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        free = (proposed < 0) | (proposed == nodes[:, None])
        there = self.points[proposed]
        d = np.maximum(self.squares[proposed] - 2 * np.einsum("nkd,nd->nk", there, own) + self.squares[nodes][:, None], 0)
        d[free] = np.inf
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        covered = np.zeros_like(d)                   # by how much a kept neighbour is nearer to the candidate than the node is, at best
        for k in range(DEGREE):
            strict = np.where(covered < 1, d, np.inf)
            nearest = strict.argmin(axis=1)
            none = ~np.isfinite(strict[rows, nearest])
            if none.any():
                nearest[none] = np.where(covered[none] < alpha * alpha, d[none], np.inf).argmin(axis=1)
            live = np.isfinite(d[rows, nearest]) & (covered[rows, nearest] < alpha * alpha)
            if not live.any():
                break
            out[live, k] = proposed[rows, nearest][live]
            chosen = there[rows, nearest]
            apart = np.maximum(self.squares[proposed] - 2 * np.einsum("nkd,nd->nk", there, chosen) + _squares(chosen)[:, None], 1e-12)
            ratio = np.where(np.isfinite(d), d / apart, 0)
            covered[live] = np.maximum(covered[live], ratio[live])
            d[rows, nearest] = np.inf
        return out

    def join(self, nodes: np.ndarray) -> None:
        """(Re)computes the edges of ``nodes`` and adds the edges back."""
        found, _ = self.beam(self.points[nodes], BUILD_BEAM)
        kept = self.prune(nodes, np.concatenate([found, self.edges[nodes]], axis=1))
        self.edges[nodes] = -1
        self.edges[nodes, :DEGREE] = kept
        at, k = np.nonzero(kept >= 0)
        source, target = nodes[at], kept[at, k].astype(np.int64)
        known = (self.edges[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        changed, first, count = np.unique(target, return_index=True, return_counts=True)
        used = (self.edges[changed] >= 0).sum(axis=1)
        room = used + count <= SLACK
        place = np.arange(len(target)) - np.repeat(first, count)
        fits = np.repeat(room, count)
        self.edges[target[fits], (np.repeat(used, count) + place)[fits]] = source[fits]
        full = np.flatnonzero(~room)
        for lo in range(0, len(full), BATCH):
            part = full[lo:lo + BATCH]
            new = np.full((len(part), int(count[part].max())), -1, np.int64)
            for i, p in enumerate(part):
                new[i, :count[p]] = source[first[p]:first[p] + count[p]]
            pruned = self.prune(changed[part], np.concatenate([self.edges[changed[part]].astype(np.int64), new], axis=1))
            self.edges[changed[part]] = -1
            self.edges[changed[part], :DEGREE] = pruned

    @classmethod
    def built(cls, points: np.ndarray, seed: int = 7) -> Graph:
        centre = points.mean(axis=0)
        order = np.random.default_rng(seed).permutation(len(points))
        graph = cls(points, None, np.unique(np.r_[np.argmin(_squares(points - centre)), order[:ENTRIES]]))
        for _ in range(2):
            at, size = 0, 1
            while at < len(order):
                graph.join(order[at:at + size])
                at, size = at + size, min(size * 2, BATCH)
            if len(points) <= BUILD_BEAM:
                break
        return graph


def extended(vectors: np.ndarray) -> np.ndarray:
    squares = _squares(vectors.astype(np.float64))
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _one_graph(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of a shard."""
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    ids = rows["id"].to_numpy(np.int64)
    distinct, node = np.unique(vectors + 0.0, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.reshape(-1)))
    starts = np.searchsorted(node.reshape(-1)[order], np.arange(len(distinct) + 1)).astype(np.int64)
    graph = Graph.built(extended(distinct))
    return pd.DataFrame([{"shard": rows["shard"].iloc[0], "dims": vectors.shape[1], "ids": ids[order].tobytes(), "starts": starts.tobytes(),
                          "vectors": distinct.tobytes(), "edges": graph.edges.tobytes(), "entries": graph.entries.astype(np.int64).tobytes()}])


def _vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    own = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return own.where(F.col("id").isNotNull() & usable(F.col("vector")))


def build(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per shard: its vectors and its graph. Store it; ``search`` reads it once per block of queries."""
    own = _vectors(table, vec_id, vector).dropDuplicates()
    shards = int((own.count() + shard - 1) // shard) or 1
    dealt = own.withColumn("shard", F.size("vector").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", "vector"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_one_graph, _GRAPH)


def _search_one(width: int, k: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "copy": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(graphs) or not len(queries):
            return none
        g = graphs.iloc[0]
        ids, starts = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["starts"], np.int64)
        vectors = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dims"])
        graph = Graph(extended(vectors), np.frombuffer(g["edges"], np.int32).reshape(len(vectors), -1), np.frombuffer(g["entries"], np.int64))
        wanted = np.stack(queries["vector"].to_numpy())
        query_id, copy = queries["id"].to_numpy(np.int64), queries["copy"].to_numpy(np.int64)
        out = []
        for lo in range(0, len(wanted), BATCH):
            q = wanted[lo:lo + BATCH]
            found, _ = graph.beam(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), min(max(width, k + 1), len(vectors)))
            at, place = np.nonzero(found >= 0)
            node = found[at, place]
            score = products(vectors[node], q[at])
            size = starts[node + 1] - starts[node]
            # of each node the k + 1 smallest ids can matter
            size = np.minimum(size, k + 1)
            row = np.repeat(np.arange(len(at)), size)
            member = ids[starts[node][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
            who = at[row]
            own = (member == query_id[lo + who]) & (vectors[node[row]] == q[who]).all(axis=1)
            row, member, who = row[~own], member[~own], who[~own]
            order = np.lexsort((member, -score[row], who))
            row, member, who = row[order], member[order], who[order]
            first = np.searchsorted(who, np.arange(len(q)))
            top = np.arange(len(who)) - first[who] < k
            out.append(pd.DataFrame({"query_id": query_id[lo + who[top]], "copy": copy[lo + who[top]], "vec_id": member[top], "score": score[row[top]]}))
        return pd.concat(out) if out else none
    return run


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", width: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every row of ``queries``, its own row left out. ``graphs`` is stored by ``build``."""
    own = _vectors(queries, vec_id, vector).dropDuplicates().withColumn("copy", F.xxhash64("vector"))
    own = stored(own, "graph-queries")
    blocks = int((own.count() + QUERIES - 1) // QUERIES) or 1
    shards = [r["shard"] for r in graphs.select("shard").distinct().collect()]
    # a query visits the shards of its length, a shard every block of queries
    sent = own.withColumn("block", F.pmod(F.xxhash64("id", "copy", F.lit(3)), F.lit(blocks))).withColumn("shard", F.explode(F.filter(
        F.lit(shards).cast("array<long>"), lambda s: F.floor(s / (1 << 32)) == F.size("vector"))))
    met = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = met.groupBy("shard", "block").cogroup(sent.groupBy("shard", F.col("block").cast("long").alias("block"))).applyInPandas(
        _search_one(width, k), "query_id long, copy long, vec_id long, score double")
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Neighbours of every row whose id is divisible by ``every``, among all rows."""
    graphs = stored(build(table, vec_id, vector), "graph")
    return search(graphs, table.where(F.col(vec_id) % every == 0), k, vec_id, vector)
