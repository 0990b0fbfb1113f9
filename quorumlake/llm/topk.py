"""Exact top-k search by inner product with two cover trees.

Candidates and queries are dealt to blocks by their nearest pivot, so that a
block's vectors lie together; a cover tree is built over each block once, and
kept as a row. A query tree first meets one candidate tree of its own pivot,
which gives a good k-th score for each query. Then the query trees, a bounded
number of them at a time, go to all candidate trees, which stay where they
are. Two trees are descended together, best bound first: a pair of nodes is
pruned if no query below one can reach a candidate below the other with the
worst k-th score of its queries. With covering radii r and angles a around the
centres q and c, and N the largest norms below them, no inner product is above

    <q, c> + r_q |c| + r_c |q| + r_q r_c    nor    N_q N_c cos(angle(q, c) - a_q - a_c)

At the leaves each query and each candidate is held against the bound of the
node opposite before scores are computed.

Defined cases: vectors that are null, empty or hold a null or a non-finite
component take no part, nor do those without an id; vectors of other lengths
than the query's score over no common components and are left out; rows with
the query's own id are its own; candidates that repeat an id and a vector
count once; equal scores go to the smaller vec_id; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import shared_folder, written

#: Points of a leaf, and children of a node: a level that needs more centres covers its points less closely.
LEAF, FANOUT = 64, 12
#: Candidates of a block, queries of a block, and query blocks that are sent to the candidates at a time.
BLOCK, QUERY_BLOCK, SENT = 2048, 512, 32
#: Pivots at most, for each length of vectors, and the rows of the sample that they are fitted on.
PIVOTS, PIVOT_SAMPLE = 64, 4096
NEVER = -np.inf


@dataclass
class Tree:
    """Nodes as arrays, the root first and the children of a node side by side; a node's points are a range of ``points``."""

    points: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    largest: np.ndarray  # norm of a node's points
    child: np.ndarray
    children: np.ndarray  # their number
    norms: np.ndarray  # of the points


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of ``a`` and ``b``; 0 where a row is zero."""
    norm = np.sqrt((a * a).sum(axis=1)) * np.sqrt(b @ b)
    return np.where(norm > 0, np.arccos(np.clip(a @ b / np.where(norm > 0, norm, 1), -1, 1)), 0.0)


def net(points: np.ndarray, first: int, radius: float, most: int = FANOUT) -> np.ndarray:
    """The centre of each point: each next centre is the point covered worst, until all lie within half the radius."""
    nearest, owner, pick = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int64), first
    for k in range(most):
        d = np.sqrt(((points - points[pick]) ** 2).sum(axis=1))
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], k
        pick = int(nearest.argmax())
        if nearest[pick] <= radius / 2:
            break
    return owner


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """A node's centre is the point nearest to the mean of its points; its children are those of a net around them."""
    order = np.arange(len(points))
    low, high, centre, radius, angle, child, children = [0], [len(points)], [], [], [], [], []
    k = 0
    while k < len(low):
        rows = order[low[k] : high[k]]
        own = points[rows]
        first = int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin())
        middle = own[first].copy()
        centre.append(middle)
        radius.append(float(np.sqrt(((own - middle) ** 2).sum(axis=1)).max()))
        angle.append(float(angles(own, middle).max()))
        child.append(len(low)), children.append(0)
        if len(rows) > leaf and radius[k] > 0:
            owner = net(own, first, radius[k])
            order[low[k] : high[k]] = rows[np.argsort(owner, kind="stable")]
            edges = np.cumsum(np.bincount(owner)) + low[k]
            low += [low[k], *edges[:-1].tolist()]
            high += edges.tolist()
            children[k] = len(edges)
        k += 1
    norms = np.sqrt((points[order] ** 2).sum(axis=1))
    largest = np.array([norms[a:b].max() for a, b in zip(low, high, strict=True)])
    return Tree(points[order], ids[order], np.array(low), np.array(high), np.array(centre), np.array(radius), np.array(angle), largest, np.array(child), np.array(children), norms)


class Best:
    """The k best candidates so far of the queries of a tree, and the score that each next one must reach."""

    def __init__(self, queries: Tree, k: int, floors: np.ndarray | None = None) -> None:
        self.queries, self.k, self.scored = queries, k, 0
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in queries.ids]  # (score, -id)
        self.worst = np.full(len(queries.ids), NEVER) if floors is None else floors.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += scores.size
        for i, row in zip(rows.tolist(), scores, strict=True):
            near = np.flatnonzero((row >= self.worst[i]) & (ids != self.queries.ids[i]))
            if len(near) > 4 * self.k:
                near = near[row[near] >= np.partition(row[near], -self.k)[-self.k]]
            heap = self.heaps[i]
            for j in near.tolist():
                entry = (int(row[j]), -int(ids[j]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.worst[i] = max(self.worst[i], heap[0][0])

    def found(self) -> list[tuple[int, int, int]]:
        return [(int(q), s, -j) for q, heap in zip(self.queries.ids, self.heaps, strict=True) for s, j in heap]


def above(bound: np.ndarray) -> np.ndarray:
    """A bound with room for what its floating point may have lost."""
    return bound + np.abs(bound) * 1e-9 + 1e-6


def bounds(a: Tree, i: int, b: Tree, nodes: slice) -> np.ndarray:
    """No inner product of a point below node ``i`` with one below each of ``nodes`` is above this."""
    q, c = a.centre[i], b.centre[nodes]
    q_norm, c_norm = np.sqrt(q @ q), np.sqrt((c * c).sum(axis=1))
    ball = c @ q + a.radius[i] * c_norm + b.radius[nodes] * q_norm + a.radius[i] * b.radius[nodes]
    apart = np.maximum(0, angles(c, q) - a.angle[i] - b.angle[nodes] - 1e-7)
    return above(np.minimum(ball, a.largest[i] * b.largest[nodes] * np.maximum(np.cos(np.minimum(apart, np.pi)), 0)))


def search(best: Best, candidates: Tree) -> None:
    """Add the candidates of this tree to the best of the queries."""
    q, c = best.queries, candidates

    def score(i: int, j: int) -> None:
        a, b = slice(q.low[i], q.high[i]), slice(c.low[j], c.high[j])
        worst = best.worst[a]
        rows = np.flatnonzero(above(q.points[a] @ c.centre[j] + q.norms[a] * c.radius[j]) >= worst)
        if not len(rows):
            return
        columns = np.flatnonzero(above(c.points[b] @ q.centre[i] + c.norms[b] * q.radius[i]) >= worst[rows].min())
        if len(columns):
            best.add(rows + q.low[i], q.points[a][rows] @ c.points[b][columns].T, c.ids[b][columns])

    def descend(i: int, j: int) -> None:
        if not q.children[i] and not c.children[j]:
            score(i, j)
        elif q.children[i] and (not c.children[j] or q.radius[i] > c.radius[j]):
            for x in range(q.child[i], q.child[i] + q.children[i]):
                if bounds(q, x, c, slice(j, j + 1))[0] >= best.worst[q.low[x] : q.high[x]].min():
                    descend(x, j)
        else:
            nodes = slice(c.child[j], c.child[j] + c.children[j])
            most = bounds(q, i, c, nodes)
            for n in np.argsort(-most, kind="stable").tolist():
                if most[n] >= best.worst[q.low[i] : q.high[i]].min():
                    descend(i, nodes.start + n)

    if bounds(q, 0, c, slice(0, 1))[0] >= best.worst.min():
        descend(0, 0)


def fitted_pivots(sample: list[np.ndarray], most: int, rounds: int = 5) -> dict[int, np.ndarray]:
    """For each length of vectors, at most ``most`` means of groups of like ones."""
    out = {}
    for size in sorted({len(v) for v in sample}):
        x = np.array([v for v in sample if len(v) == size], dtype=np.float64)
        first = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        owner = net(x, first, 0.0, min(most, len(x)))
        for _ in range(rounds):
            means = np.array([x[owner == k].mean(axis=0) for k in np.unique(owner)])
            owner = nearest(x, means)
        out[size] = np.array([x[owner == k].mean(axis=0) for k in np.unique(owner)])
    return out


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means * means).sum(axis=1) - 2 * x @ means.T).argmin(axis=1)


def with_pivots(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with size, the length of ``v``, and pivot; -1 for a length that the sample had none of."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors of each length in the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int32)
            start = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            flat, pivot = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.full(len(size), -1, dtype=np.int32)
            for n, means in sent.value.items():
                own = np.flatnonzero(size == n)
                if len(own):
                    pivot[own] = nearest(flat[start[own][:, None] + np.arange(n)], means)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(pivot)], names=[*batch.schema.names, "size", "pivot"])

    return rows.mapInArrow(run, "vec_id long, is_query boolean, v array<long>, size int, pivot int")


def trees(rows: DataFrame, block: int) -> DataFrame:
    """size, pivot, part, parts, tree: a cover tree over each block of about ``block`` rows of a pivot."""
    parts = rows.groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = rows.join(parts, ["size", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        tree = cover_tree(np.array(frame["v"].tolist(), dtype=np.float64), frame["vec_id"].to_numpy())  # exact: scores are below 2**53
        return frame.iloc[:1][["size", "pivot", "part", "parts"]].assign(tree=[pickle.dumps(tree)])

    return written(dealt.groupBy("size", "pivot", "part").applyInPandas(build, "size int, pivot int, part long, parts long, tree binary"))


FOUND = "query_id long, score long, vec_id long"


def first_scores(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Each query tree with its met block's part, the k-th scores there, and the candidates found."""
    of = candidates.select("size", "pivot", F.col("part").alias("met"), F.col("parts").alias("c_parts"), F.col("tree").alias("c_tree"))
    same = (queries["size"] == of["size"]) & (queries["pivot"] == of["pivot"]) & (F.pmod(queries["part"], of["c_parts"]) == of["met"])
    # a pivot may have no candidates: its queries then start without floors
    pairs = queries.join(of, same, "left").select(queries["size"], queries["pivot"], F.coalesce("met", F.lit(-1).cast("long")).alias("met"), "tree", "c_tree")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(len(frame)):
                best = Best(pickle.loads(frame["tree"].iloc[i]), k)
                if frame["c_tree"].iloc[i] is not None:
                    search(best, pickle.loads(frame["c_tree"].iloc[i]))
                floors = best.worst.tobytes()
                yield frame.iloc[i : i + 1][["size", "pivot", "met", "tree"]].assign(floors=[floors], found=[[dict(zip(("query_id", "score", "vec_id"), x, strict=True)) for x in best.found()]])

    return written(pairs.mapInPandas(run, "size int, pivot int, met long, tree binary, floors binary, found array<struct<query_id: long, score: long, vec_id: long>>"))


def searched(candidates: DataFrame, groups: list, k: int) -> DataFrame:
    """The candidates that may be among the k best of the queries of ``groups``, trees that are sent to all blocks."""
    sent = candidates.sparkSession.sparkContext.broadcast(groups)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(size, pivot, met, Best(pickle.loads(tree), k, np.frombuffer(floors))) for size, pivot, met, tree, floors in sent.value]
        for frame in frames:
            for size, pivot, part, tree in zip(frame["size"], frame["pivot"], frame["part"], frame["tree"], strict=True):
                block = pickle.loads(tree)
                for q_size, q_pivot, met, best in own:
                    if q_size == size and (q_pivot, met) != (pivot, part):
                        search(best, block)
        found = [x for *_, best in own for x in best.found()]
        yield pd.DataFrame(found, columns=["query_id", "score", "vec_id"])

    return candidates.select("size", "pivot", "part", "tree").mapInPandas(run, FOUND)


def integral(embedding: Column) -> Column:
    """Components times 1024, rounded down."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest score, ties to the smaller vec_id.

    The pivots only lay like vectors together; they are fitted on ``pivot_sample`` rows at most.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = written(usable.select("vec_id", "is_query", integral(F.col("embedding")).alias("v")).distinct())
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivot_sample).select("v").toPandas()["v"]
    rows = written(with_pivots(rows, fitted_pivots([np.asarray(v) for v in drawn], min(PIVOTS, -(-rows.count() // block)))))
    candidates = trees(rows, block)
    queries = first_scores(trees(rows.filter("is_query"), query_block), candidates, k)
    found = queries.select(F.explode("found").alias("x")).select("x.query_id", "x.score", "x.vec_id")
    folder = f"{shared_folder(vectors.sparkSession)}/{uuid.uuid4().hex}"
    found.write.parquet(folder)
    for groups in batched(queries.select("size", "pivot", "met", "tree", "floors").toLocalIterator(), SENT):
        searched(candidates, [tuple(g) for g in groups], k).write.mode("append").parquet(folder)  # one table, however many rounds
    found = vectors.sparkSession.read.schema(FOUND).parquet(folder)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # each task first keeps its own k of a query
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
