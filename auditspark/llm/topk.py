"""Exact top-k inner-product search with dual cover trees.

The stated queries are cut into blocks of bounded size; a block is indexed as a cover tree on the
driver and sent to every task. A task cuts its own candidates into blocks, indexes each as a cover
tree too, and walks pairs of nodes. For a query node with centre a and radius s and a data node with
centre b and radius r, no product exceeds ``a.b + |a| r + |b| s + r s``: a pair whose bound is below
the worst k-th score of the node's queries is dropped. Ties with that score are kept, so the smaller
id can win. The other queries of the block are candidates as well, and their products give the first
k-th scores. Tasks return at most k rows a query; a window per query merges them.

A cover tree here is the batch form: a node covers its points within its radius; its children are a
greedy net of half that radius, so children's centres lie further apart than it, down to leaves of
a few dozen points. In the query tree small neighbouring children share a leaf. A query node meets
all data nodes that are left for it at once, so bounds and products are matrix operations.

Components become ``floor(256 * x)``. While products stay below 2^53, they are computed as doubles,
which is exact; beyond, as Python integers.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a row is left
out only as its own candidate, so a repeated id can be found; shorter vectors count as padded with
zeros; a null id is never a query and loses ties; an empty table gives an empty result; only the id
and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import stage

SCALE = 256
K = 5
LEAF = 48
QUERY_BLOCK = 4096
DATA_BLOCK = 4096
NO_SCORE = -np.inf

HITS = "q_row long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of the row's own), vec_id and integer components of every vector that takes part."""
    v = F.col("embedding")
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                     & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.coalesce(whole, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


@dataclass
class Tree:
    """Nodes in arrays: centre (a point's place), radius, first and last place in ``order``, children."""

    points: np.ndarray
    order: np.ndarray
    centre: list[int]
    radius: list[float]
    span: list[tuple[int, int]]
    children: list[list[int]]
    bundles: int = 0

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF, bundles: int = 0) -> Tree:
        """``bundles``: neighbouring small children are put together, up to that many points, in a leaf
        around the parent's centre, so that few large groups take the place of many tiny ones."""
        tree = Tree(points, np.arange(len(points)), [], [], [], [], bundles)
        if not len(points):
            return tree
        far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        tree._node(0, float(far.max()), 0, len(points))
        waiting = [(0, float(far.max()))]
        while waiting:
            node, radius = waiting.pop()
            a, b = tree.span[node]
            if b - a <= leaf or radius <= 0:
                continue
            waiting += [(child, tree.radius[child]) for child in tree._split(node, radius / 2)]
        return tree

    def _node(self, centre: int, radius: float, a: int, b: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((a, b))
        self.children.append([])
        return len(self.centre) - 1

    def _split(self, node: int, reach: float) -> list[int]:
        """Children: the node's own centre first, then the first point that none covers yet."""
        a, b = self.span[node]
        left = self.order[a:b].copy()
        centre, at = self.centre[node], a
        while len(left):
            far = np.sqrt(((self.points[left] - self.points[centre]) ** 2).sum(axis=1))
            own = far <= reach
            own |= left == centre
            held = left[own]
            self.order[at:at + len(held)] = held
            self.children[node].append(self._node(centre, float(far[own].max()), at, at + len(held)))
            at += len(held)
            left = left[~own]
            if len(left):
                centre = int(left[0])
        if self.bundles:
            self._bundle(node)
        return self.children[node]

    def _bundle(self, node: int) -> None:
        out, first, last = [], None, None
        for child in [*self.children[node], None]:
            a, b = self.span[child] if child is not None else (0, self.bundles + 1)
            if first is not None and (child is None or b - first > self.bundles or b - a > self.bundles):
                far = self.points[self.order[first:last]] - self.points[self.centre[node]]
                out.append(self._node(self.centre[node], float(np.sqrt((far ** 2).sum(axis=1)).max()), first, last))
                first = None
            if child is not None and b - a > self.bundles:
                out.append(child)
            elif child is not None:
                first, last = a if first is None else first, b
        self.children[node] = out


class Search:
    """The best k of each query of one block, over any number of data blocks."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int, exact: bool):
        self.rows, self.k, self.exact = rows, k, exact
        self.vectors = vectors
        self.tree = Tree.build(vectors.astype(float), LEAF, LEAF)
        self.norm = np.sqrt((self.tree.points ** 2).sum(axis=1))
        self.least = np.full(len(rows), NO_SCORE)
        self.found: list[list[tuple]] = [[] for _ in rows]

    def seed(self) -> None:
        """k-th best products among the block's own queries: lower bounds of the final ones."""
        n = len(self.rows)
        if n > self.k and self.exact:
            for at in range(0, n, 512):
                part = self.tree.points[at:at + 512] @ self.tree.points.T
                part[np.arange(len(part)), np.arange(at, at + len(part))] = NO_SCORE
                self.least[at:at + 512] = np.partition(part, n - self.k, axis=1)[:, n - self.k]

    def offer(self, rows: np.ndarray, ids: list, vectors: np.ndarray) -> None:
        data = Tree.build(vectors.astype(float))
        if not len(ids) or not len(self.rows):
            return
        norm = np.sqrt((data.points ** 2).sum(axis=1))
        slack = 1e-6 * (1.0 + float(norm.max()) * float(self.norm.max()))
        centres, radii, norms = data.points[data.centre], np.array(data.radius), norm[data.centre]

        def kept(q: int, nodes: np.ndarray) -> np.ndarray:
            """Data nodes that may hold a result for query node q, the most promising first."""
            a, s = self.tree.centre[q], self.tree.radius[q]
            bound = centres[nodes] @ self.tree.points[a] + self.norm[a] * radii[nodes] + norms[nodes] * s + radii[nodes] * s
            order = np.argsort(-bound, kind="stable")
            start, end = self.tree.span[q]
            worst = self.least[self.tree.order[start:end]].min()
            return nodes[order][bound[order] + slack >= worst]

        def finer(nodes: np.ndarray, leaves: bool) -> np.ndarray:
            """The children of inner nodes; with ``leaves``, also the leaves among the nodes."""
            out = [c for n in nodes for c in (data.children[n] or ([n] if leaves else []))]
            return np.array(out, np.int64)

        waiting = [(0, np.zeros(1, np.int64))]
        while waiting:
            q, nodes = waiting.pop()
            nodes = kept(q, nodes)
            if self.tree.children[q]:
                below = finer(nodes, True)
                waiting += [(c, below) for c in self.tree.children[q] if len(below)]
                continue
            start, end = self.tree.span[q]
            group = self.tree.order[start:end]
            while len(nodes):
                members = [data.order[slice(*data.span[n])] for n in nodes if not data.children[n]]
                if members:
                    members = np.concatenate(members)
                    for at in range(0, len(members), 512):
                        self._leaf(group, members[at:at + 512], rows, ids, vectors, data)
                nodes = finer(nodes, False)
                nodes = kept(q, nodes) if len(nodes) else nodes

    def _leaf(self, group, members, rows, ids, vectors, data) -> None:
        if self.exact:
            score = self.tree.points[group] @ data.points[members].T
            hit = score >= self.least[group][:, None]
        else:
            score = self.vectors[group].astype(object) @ vectors[members].astype(object).T
            hit = np.ones(score.shape, bool)
        hit &= rows[members][None, :] != self.rows[group][:, None]
        for i in np.flatnonzero(hit.any(axis=1)):
            q = int(group[i])
            more = [(-int(score[i, j]), ids[members[j]] is None, ids[members[j]] or 0, int(rows[members[j]]))
                    for j in np.flatnonzero(hit[i])]
            best = self.found[q] = sorted(self.found[q] + more)[:self.k]
            if len(best) == self.k:
                self.least[q] = max(self.least[q], float(-best[-1][0]))


def padded(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x[:width]
    return out


def search(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK,
           data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every row for which ``is_query`` holds."""
    table = stage(quantized(vectors))
    queries = stage(table.where(is_query))
    shape = table.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"),
                      F.coalesce(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.lit(0)).alias("most")
                      ).first()
    width = shape["width"]
    exact = width * float(shape["most"]) ** 2 < 2.0 ** 52
    blocks = max(1, -(-queries.count() // query_block))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        own = numbered.where(F.col("block") == block).select("row", "v").collect()
        own.sort(key=lambda r: r["row"])
        if not own:
            continue
        state = Search(np.array([r["row"] for r in own], np.int64), padded([r["v"] for r in own], width), k, exact)
        state.seed()
        sent = table.sparkSession.sparkContext.broadcast(state)  # at most about query_block vectors

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state = sent.value
            state.found = [[] for _ in state.rows]
            state.least = state.least.copy()
            held: list[tuple] = []

            def offer() -> None:
                rows, ids, own = zip(*held)
                state.offer(np.array(rows, np.int64), list(ids), padded(list(own), width))
                held.clear()

            start = state.least.copy()
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(row)
                    if len(held) >= data_block:
                        offer()
            if held:
                offer()
            out = [(int(state.rows[q]), None if none else i, -s) for q, best in enumerate(state.found)
                   for s, none, i, _ in best]
            state.least = start  # the worker may run another task with the same broadcast
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q_row", "vec_id", "score"])

        parts.append(stage(table.select("row", "vec_id", "v").mapInArrow(run, HITS)))
        sent.destroy()
    hits = parts[0] if parts else table.sparkSession.createDataFrame([], HITS)
    for part in parts[1:]:
        hits = hits.unionByName(part)
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    names = queries.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"))
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .join(names, "q_row").select("query_id", "rank", "vec_id", "score"))


#: DuckDB SQL of the query over the table ``embeddings``.
TOPK_SQL = f"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, row_number() OVER () AS r,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id AS vec_id,
         CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
