"""Approximate nearest neighbours by inner product: NN-descent by Spark joins, searched greedily.

Equal vectors are one node. For the graphs each node gets a unit vector in one more dimension, in which the nearest
by angle are the nearest by inner product whatever the norms are. Nodes are dealt by hash into shards of about
``SHARD``; edges stay within a shard, and every query is searched in every shard, so the effort for a query
grows with the table and recall doesn't fall: a shard is as hard to search however many there are.

A graph starts from random cross-polytope leaves, compared within. Then each round is a local join, keyed by the
neighbour in common: a node's neighbours, and up to ``back`` of those that have it as theirs, meet at that node with
their vectors; pairs of which one edge is new since the last round are compared, and what is nearer than a node's
farthest neighbour goes to it. At most ``near`` + ``back`` vectors meet in a group, whatever the table's size, and both
sides of a round are streamed from sorted partitions. Rounds end when fewer than ``DELTA`` of the edges are new.

A search starts at the nodes in the query's own leaves and expands the best nodes not yet expanded until none
of the ``beam`` best is left to expand. The best of all shards are scored again in double precision on the original
vectors: ``spare`` more than asked for, since the search itself scores in single precision.

Parameters of the algorithm, not of its input: neighbours kept (``near``), reverse edges followed per node (``back``;
a hub's are drawn by hash), nodes expanded at once (``width``), the best held (``beam``). They decide recall within a
shard, which the tests measure against brute force; ``exact=True`` scores every node instead. A search that reaches too
few nodes scores all of its shard. Work grows as queries times shards.

Defined results: vectors that are null, empty, zero, of another length than the commonest, or hold null or
non-finite components take no part, neither as queries nor as candidates; null ids neither; equal scores go to the
smaller id; repeated ids are candidates each; an empty table gives an empty one; further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import spool, whole_groups

NEAR, BACK, TREES, LEAF = 16, 8, 6, 256
WIDTH, BEAM, SPARE = 64, 512, 12
#: Share of the edges: a round that changes fewer is the last one.
DELTA = 0.01
#: Nodes in a shard; queries that one task searches it for, and of these, how many at once.
SHARD, QUERIES, BATCH = 16_384, 16_384, 64


def unit(batch: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors of one more dimension."""
    x = batch / largest
    rest = np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))
    return np.concatenate([x, rest], axis=1).astype(np.float32)


def leaves(x: np.ndarray, tree: int, ways: int, levels: int) -> np.ndarray:
    """Leaf of each vector: at each level the random direction, or its opposite, that it is nearest to."""
    leaf = np.zeros(len(x), dtype=np.int64)
    for level in range(levels):
        directions = np.random.default_rng([tree, level]).standard_normal((-(-ways // 2), x.shape[1])).astype(np.float32)
        s = x @ directions.T
        leaf = leaf * (2 * len(directions)) + np.concatenate([s, -s], axis=1).argmax(axis=1)
    return leaf


def rows_of(vectors: pa.Array | pd.Series, dtype: type) -> np.ndarray:
    held = vectors.to_pylist() if isinstance(vectors, pa.Array) else vectors
    return np.frombuffer(b"".join(held), dtype=dtype).reshape(len(held), -1)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


class Graph:
    """The graph of one shard. ``x`` holds unit vectors; nodes are places in it; ``ids`` are each one's neighbours."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, back: int, trees: int, leaf: int):
        self.x, self.back = x, back
        self.ways, self.levels = spread(len(x), leaf)
        self.leaf = np.stack([leaves(x, t, self.ways, self.levels) for t in range(trees)])
        self.members = [np.argsort(row, kind="stable") for row in self.leaf]
        self.around = self._adjacency(ids)

    def _adjacency(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        node, other = np.repeat(np.arange(n, dtype=np.int32), ids.shape[1]), ids.ravel()
        node, other = node[other >= 0], other[other >= 0]
        order = np.lexsort((np.random.default_rng(n).random(len(other)), other))
        node, other = node[order], other[order]
        at = np.arange(len(other)) - np.searchsorted(other, other)
        held = at < self.back
        reverse = np.full((n, self.back), -1, np.int32)
        reverse[other[held], at[held]] = node[held]
        return np.concatenate([ids, reverse], axis=1)

    def scan(self, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of all nodes."""
        s = q @ self.x.T
        best = np.argsort(-s, axis=1, kind="stable")[:, :keep].astype(np.int32)
        return best, np.take_along_axis(s, best, 1)

    def search(self, q: np.ndarray, keep: int, width: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``keep`` best of the shard found for each query, best first, -1 where it has fewer."""
        parts = [self._search(q[a : a + BATCH], keep, width, max(beam, keep)) for a in range(0, len(q), BATCH)]
        return np.concatenate([i for i, _ in parts]), np.concatenate([s for _, s in parts])

    def _search(self, q: np.ndarray, keep: int, width: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(q), len(self.x)
        seen, expanded = np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids, scores = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf, np.float32)
        wanted = np.zeros((m, n), bool)
        for t, order in enumerate(self.members):
            mine = leaves(q, t, self.ways, self.levels)
            known = self.leaf[t][order]
            for k, (low, high) in enumerate(zip(np.searchsorted(known, mine), np.searchsorted(known, mine, "right"), strict=True)):
                wanted[k, order[low:high]] = True
        if n:
            wanted[:, 0] = True
        while True:
            wanted &= ~seen
            seen |= wanted
            row, node = np.nonzero(wanted)
            s = np.einsum("ij,ij->i", self.x[node], q[row])
            n_new = np.bincount(row, minlength=m)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n_new) - n_new, n_new)
            new_ids, new_scores = np.full((m, max(n_new.max(), 1)), -1, np.int32), np.full((m, max(n_new.max(), 1)), -np.inf, np.float32)
            new_ids[row, at], new_scores[row, at] = node, s
            all_ids, all_scores = np.concatenate([ids, new_ids], axis=1), np.concatenate([scores, new_scores], axis=1)
            part = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
            ids, scores = np.take_along_axis(all_ids, part, 1), np.take_along_axis(all_scores, part, 1)
            order = np.argsort(-scores, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            open_ = (ids >= 0) & ~np.take_along_axis(expanded, np.maximum(ids, 0), 1)
            row, place = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= width))
            if not len(row):
                break
            expanded[row, ids[row, place]] = True
            ahead = self.around[ids[row, place]]
            wanted[:] = False
            wanted[np.repeat(row, ahead.shape[1])[ahead.ravel() >= 0], ahead.ravel()[ahead.ravel() >= 0]] = True
        short = np.flatnonzero((ids >= 0).sum(axis=1) < min(keep, n))  # what the graph doesn't reach
        if len(short):
            best, s = self.scan(q[short], beam)
            ids[short, : best.shape[1]], scores[short, : best.shape[1]] = best, s
        self.scored = seen.mean() if n else 0.0
        return ids[:, :keep], scores[:, :keep]


def spread(n: int, leaf: int) -> tuple[int, int]:
    """Ways and levels of a tree that cuts n vectors into leaves of about that many."""
    split = max(1.0, n / leaf)
    levels = max(1, math.ceil(math.log(split, 64) - 1e-9))
    return max(2, math.ceil(split ** (1 / levels))), levels


class Leaves:
    """A row for each node and tree, with its leaf."""

    schema = pa.schema([("node", pa.int64()), ("shard", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int64()), ("g", pa.binary())])

    def __init__(self, trees: int, ways: int, levels: int):
        self.trees, self.ways, self.levels = trees, ways, levels

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column("g"), np.float16).astype(np.float32)
                for t in range(self.trees):
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("shard"), pa.array([t] * len(x), pa.int32()), pa.array(leaves(x, t, self.ways, self.levels)), batch.column("g")], schema=self.schema)


def within(near: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The nearest of each node among those of a part of a leaf."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        x, nodes = rows_of(pdf["g"], np.float16).astype(np.float32), pdf["node"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(near, len(x) - 1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"node": np.repeat(nodes, k), "other": nodes[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel(), "fresh": True})

    return of


class LocalJoin:
    """Pairs that met at a node, where one of the two edges is new, and that one of the pair would take as a neighbour."""

    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("score", pa.float32()), ("fresh", pa.bool_())])

    def __init__(self, most: int):
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("center",), 4 * self.most):
            center = batch.column("center").to_numpy()
            node, fresh, worst = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("member", "fresh", "worst"))
            x = rows_of(batch.column("g"), np.float16).astype(np.float32)
            _, first, size = np.unique(center, return_index=True, return_counts=True)
            for a in range(0, len(first), 512):
                wide = int(size[a : a + 512].max())
                at = np.minimum(first[a : a + 512, None] + np.arange(wide), len(x) - 1)
                real = np.arange(wide) < size[a : a + 512, None]
                s = np.matmul(x[at], x[at].transpose(0, 2, 1))
                joined = real[:, :, None] & real[:, None, :] & (fresh[at][:, :, None] | fresh[at][:, None, :]) & (s > worst[at][:, :, None])
                joined &= node[at][:, :, None] != node[at][:, None, :]
                g, i, j = np.nonzero(joined)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[g, i]]), pa.array(node[at[g, j]]), pa.array(s[g, i, j]), pa.array(np.ones(len(g), bool))], schema=self.schema)


class Keep:
    """The ``near`` best distinct neighbours of each node, from rows sorted by node. An edge that was there stays old.
    Of a node whose rows go on in the next batch only the best so far are held."""

    schema = LocalJoin.schema

    def __init__(self, near: int):
        self.near = near

    def best(self, node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((fresh, other, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        one = np.ones(len(node), bool)
        one[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
        node, other, score, fresh = node[one], other[one], score[one], fresh[one]
        order = np.lexsort((other, -score, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        held = np.arange(len(node)) - np.searchsorted(node, node) < self.near
        return node[held], other[held], score[held], fresh[held]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if batch.num_rows:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "score", "fresh")]
                rest = self.best(*(np.concatenate(x) for x in zip(rest, new, strict=True))) if rest else self.best(*new)
                cut = int(np.searchsorted(rest[0], rest[0][-1]))
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(x[:cut]) for x in rest], schema=self.schema)
                rest = tuple(x[cut:] for x in rest)
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest], schema=self.schema)


EDGES = "node long, other long, score float, fresh boolean"


def kept(candidates: DataFrame, near: int) -> DataFrame:
    return candidates.repartition("node").sortWithinPartitions("node").mapInArrow(Keep(near), EDGES)


def descent(units: DataFrame, n: int, per_shard: int, near: int, back: int, trees: int, leaf: int) -> DataFrame:
    """``node, other, score``: the graph of ``units`` (``node, shard, g``), edges within shards, by rounds of local joins."""
    ways, levels = spread(per_shard, leaf)
    planted = spool(units.select("node", "shard", "g").mapInArrow(Leaves(trees, ways, levels), "node long, shard int, tree int, leaf long, g binary"), "leaves")
    # a leaf that holds many is compared in parts
    size = planted.groupBy("shard", "tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts"))
    divided = planted.join(size, ["shard", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    edges = spool(kept(divided.groupBy("shard", "tree", "leaf", "part").applyInPandas(within(near), EDGES), near), "edges")
    while True:
        worst = edges.groupBy("node").agg(F.when(F.count("*") == near, F.min("score")).otherwise(F.lit(float("-inf")).cast("float")).alias("worst"))
        members = units.select(F.col("node").alias("member"), "g").join(worst.select(F.col("node").alias("member"), "worst"), "member")
        turn = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("node", "other")))
        reverse = edges.select("node", "other", "fresh", turn.alias("turn")).where(F.col("turn") <= back)
        meeting = edges.select(F.col("node").alias("center"), F.col("other").alias("member"), "fresh").unionByName(reverse.select(F.col("other").alias("center"), F.col("node").alias("member"), "fresh"))
        met = meeting.join(members, "member").repartition("center").sortWithinPartitions("center").select("center", "member", "fresh", "worst", "g")
        nearer = met.mapInArrow(LocalJoin(near + back), EDGES)
        edges = spool(kept(edges.withColumn("fresh", F.lit(False)).unionByName(nearer), near), "edges")
        if edges.where("fresh").count() <= DELTA * n * near:
            return edges


def shard_graph(near: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One row for a shard: its nodes, their vectors and their neighbours as places there, packed."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        nodes = pdf["node"].to_numpy()
        ids = np.full((len(nodes), near), -1, np.int32)
        for k, others in enumerate(pdf["others"]):
            if others is not None and len(others):
                ids[k, : len(others)] = np.searchsorted(nodes, others)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "nodes": [nodes.astype("<i8").tobytes()], "g": [b"".join(pdf["f"])], "ids": [ids.astype("<i4").tobytes()]})

    return of


class Search:
    """``node, ids, scores``: the best of a shard for each query of a part, the query's own node left out."""

    schema = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])

    def __init__(self, back: int, trees: int, leaf: int, keep: int, width: int, beam: int, exact: bool):
        self.how, self.keep, self.width, self.beam, self.exact = (back, trees, leaf), keep, width, beam, exact

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                nodes = np.frombuffer(batch.column("nodes")[r].as_py(), "<i8")
                x = np.frombuffer(batch.column("g")[r].as_py(), np.float32).reshape(len(nodes), -1)
                graph = Graph(x, np.frombuffer(batch.column("ids")[r].as_py(), "<i4").reshape(len(nodes), -1), *self.how)
                asked = batch.column("asked")[r].as_py()
                own = np.array([a["node"] for a in asked], np.int64)
                q = np.frombuffer(b"".join(a["q"] for a in asked), np.float32).reshape(len(own), -1)
                for a in range(0, len(own), 1024):
                    part = q[a : a + 1024]
                    ids, scores = graph.scan(part, self.keep + 1) if self.exact else graph.search(part, self.keep + 1, self.width, self.beam)
                    found = np.where(ids < 0, -1, nodes[ids])
                    held = (ids >= 0) & (found != own[a : a + 1024, None])
                    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 1024]), pa.ListArray.from_arrays(ends, pa.array(found[held])), pa.ListArray.from_arrays(ends, pa.array(scores[held].astype(np.float32)))], schema=self.schema)


class Merge:
    """The best of several lists for each node: ``lists`` holds arrays of (ids, scores)."""

    schema = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))])

    def __init__(self, near: int):
        self.near = near

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for a, b in zip(batch.column("ids"), batch.column("scores"), strict=True):
                i, s = top(a.values.to_numpy(), b.values.to_numpy(), self.near)
                ids.append(i)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))], schema=self.schema)


def merged(lists: DataFrame, near: int) -> DataFrame:
    """One row for each node with the best of its lists."""
    one = lists.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))
    return one.mapInArrow(Merge(near), "node long, ids array<long>, scores array<float>")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as arrays of doubles."""
    v = vectors[vector_col].cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    held = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(F.coalesce(whole, F.lit(False)))
    return held.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # minus zero is zero


class Units:
    """Unit vectors in half precision, for comparisons between nodes, and in single precision, for searches."""

    schema = pa.schema([("node", pa.int64()), ("g", pa.binary()), ("f", pa.binary())])

    def __init__(self, largest: float):
        self.largest = largest

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").values.to_numpy().reshape(batch.num_rows, -1)
                u = unit(x, self.largest)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([g.tobytes() for g in u.astype(np.float16)], pa.binary()), pa.array([g.tobytes() for g in u], pa.binary())], schema=self.schema)


class Index:
    """A graph over the distinct usable vectors of a table."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", near: int = NEAR, back: int = BACK, trees: int = TREES, leaf: int = LEAF, shard: int = SHARD):
        held = spool(usable(vectors, id_col, vector_col), "vectors")
        sizes = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dimension = sizes[0]["d"] if sizes else 0
        held = held.where(F.size("v") == self.dimension)
        # the digest stands for the vector; the least ids of equal vectors are all that a query can ever return
        keyed = held.select("vec_id", "v", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256).alias("digest"))
        first = keyed.groupBy("digest").agg(F.min("vec_id").alias("vec_id"))
        distinct = keyed.join(first, ["digest", "vec_id"]).dropDuplicates(["digest"])
        nodes = spool(distinct.select("digest", "v").withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.members = spool(keyed.select("digest", "vec_id").join(nodes.select("digest", "node"), "digest").select("node", "vec_id"), "members")
        self.vectors = nodes.select("node", "v")
        stats = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).collect()[0]
        self.n = stats["n"]
        largest = math.sqrt(stats["m"] or 1.0)
        self.largest = largest
        self.how = (back, trees, leaf)
        self.shards = max(1, -(-self.n // shard))
        units = spool(self.vectors.mapInArrow(Units(largest), "node long, g binary, f binary").withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(self.shards)).cast("int")), "units")
        self.graph = descent(units, self.n, max(1, self.n // self.shards), near, back, trees, leaf).select("node", "other", "score")
        others = self.graph.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("score", "other")), asc=False)["other"].alias("others"))  # ``near`` at most
        self.graphs = spool(units.select("node", "shard", "f").join(others, "node", "left").groupBy("shard").applyInPandas(shard_graph(near), "shard int, nodes binary, g binary, ids binary"), "graphs")

    def search(self, is_query: Column, k: int = 20, width: int = WIDTH, beam: int = BEAM, spare: int = SPARE, exact: bool = False) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the k nearest of each row of which ``is_query`` (over vec_id) holds.
        ``exact`` scores all nodes of all shards."""
        queries = spool(self.members.where(is_query).select(F.col("vec_id").alias("query_id"), "node"), "queries")
        start = queries.select("node").distinct().join(self.vectors, "node")  # equal queries are searched once
        d = self.dimension
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        asked = spool(start.select("node", F.transform("v", lambda x: x / norm).alias("v")).mapInArrow(QueryUnits(d), "node long, q binary"), "asked")
        parts = max(1, -(-asked.count() // QUERIES))
        packed = asked.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("node", "q")).alias("asked"))
        # each shard meets each part of the queries; a row is a shard and a part, so that there are few
        each = self.graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed, "part").repartition(max(self.shards * parts, 1), "shard", "part")
        lists = each.select("nodes", "g", "ids", "asked").mapInArrow(Search(*self.how, k + spare, width, beam, exact), "node long, ids array<long>, scores array<float>")
        reached = merged(lists, k + spare)
        final = reached.select("node", F.explode(F.concat("ids", F.array("node"))).alias("other"))
        # copies: of equal vectors only the least ids can be among the nearest
        place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))  # cut before the shuffle
        least = self.members.select("node", "vec_id", place.alias("place")).where(F.col("place") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
        pairs = final.join(start.select("node", F.col("v").alias("a")), "node").join(self.vectors.select(F.col("node").alias("other"), F.col("v").alias("b")), "other")
        dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        exact = pairs.select("node", "other", dot.alias("score")).join(least.select(F.col("node").alias("other"), "vec_ids"), "other")
        ranked = exact.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "vec_ids", "score"))).alias("groups"))
        flat = F.flatten(F.transform("groups", lambda g: F.transform(g["vec_ids"], lambda i: F.struct(g["by"].alias("by"), i.alias("vec_id"), g["score"].alias("score")))))
        best = ranked.select("node", F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
        mine = queries.join(best, "node").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
        return mine.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


class QueryUnits:
    """Unit query vectors; the dimension that evens the norms out is zero for them."""

    schema = pa.schema([("node", pa.int64()), ("q", pa.binary())])

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").values.to_numpy().reshape(batch.num_rows, self.dimension)
                x = np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([g.tobytes() for g in x], pa.binary())], schema=self.schema)
