"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances by one more coordinate that lifts every
candidate to the same length (the query's is zero): the nearest candidates are
those with the largest product.  Vectors are dealt to regions around a bounded
number of pivots and to page groups of a bounded size; each group is an M-tree
whose nodes hold routing objects, covering radii and distances to the parent.
A query first searches one group near to it.  With the score reached there, it
visits only groups and nodes whose lower bound on the distance allows better.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stage, table
from tallyforge.llm.vectors import matrix, packed, usable, width_of

SCALE = 1024.0
K = 10
QUERY_STEP = 100
MAX_PIVOTS = 256
GROUP_VECTORS = 4096
QUERIES_PER_BLOCK = 1024
PAGE, FANOUT = 64, 16
HITS = "query_id long, query_v binary, vec_id long, score long"


def lift(v: np.ndarray, square: float) -> np.ndarray:
    """Candidates with the coordinate that makes all squared lengths equal to ``square``."""
    v = v.astype(float)
    rest = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", v, v), 0.0))
    return np.column_stack([v, rest])


class MTree:
    """Pages of a metric tree.  A node is a routing object, a radius and either children or rows."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, square: float) -> None:
        self.ids, self.v, self.point = ids, v, lift(v, square)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        self.to_parent: list[np.ndarray] = []
        self._build(np.arange(len(ids)), 0)

    def _far(self, a: int, rows: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.point[rows] - self.point[a], axis=1)

    def _build(self, rows: np.ndarray, center: int) -> int:
        node = len(self.center)
        away = self._far(center, rows)
        self.center.append(center)
        self.radius.append(float(away.max(initial=0.0)))
        self.children.append(None)
        self.rows.append(None)
        self.to_parent.append(away)
        if len(rows) <= PAGE:
            self.rows[node] = rows
            return node
        if self.radius[node] == 0.0:
            parts = np.array_split(rows, -(-len(rows) // PAGE))
            centers = [int(p[0]) for p in parts]
        else:
            centers, gap = [int(rows[np.argmax(away)])], away
            best = self._far(centers[0], rows)
            owner = np.zeros(len(rows), np.int64)
            while len(centers) < min(FANOUT, -(-len(rows) // PAGE) + 1) and best.max() > 0:
                centers.append(int(rows[np.argmax(best)]))
                gap = self._far(centers[-1], rows)
                owner = np.where(gap < best, len(centers) - 1, owner)
                best = np.minimum(best, gap)
            parts = [rows[owner == k] for k in range(len(centers))]
        below = [self._build(p, c) for p, c in zip(parts, centers) if len(p)]
        self.children[node] = np.array(below)
        self.to_parent[node] = self._far(center, np.array([self.center[b] for b in below]))
        return node

    def search(self, query: np.ndarray, own_id: int, k: int, score: float) -> list[tuple[int, int]]:
        """The k best (score, id) above or equal to ``score``, ties to smaller ids, without the query's own id."""
        q = np.append(query.astype(float), 0.0)
        square = float(np.dot(self.point[0], self.point[0]))
        length = float(np.dot(q, q)) + square
        slack = 1e-6 * (1.0 + length)

        def reach(s: float) -> float:
            return np.sqrt(max(length - 2.0 * s, 0.0) + slack)

        best: list[tuple[int, int]] = []
        limit = reach(score) if np.isfinite(score) else np.inf
        heap = [(0.0, 0, float(np.linalg.norm(q - self.point[self.center[0]])))]
        while heap:
            bound, node, away = heapq.heappop(heap)
            if bound > limit:
                break
            rows = self.rows[node]
            if rows is not None:
                # The stored distance to the routing object rules rows out without computing theirs.
                rows = rows[np.abs(away - self.to_parent[node]) <= limit + slack]
                rows = rows[self.ids[rows] != own_id]
                scores = self.v[rows] @ query
                best += zip(scores.tolist(), (-self.ids[rows]).tolist())
                best.sort(reverse=True)
                del best[k:]
                if len(best) == k:
                    limit = min(limit, reach(float(best[-1][0])))
                continue
            children = self.children[node]
            radius = np.array([self.radius[c] for c in children])
            near = np.abs(away - self.to_parent[node]) - radius <= limit + slack
            for c, r in zip(children[near].tolist(), radius[near].tolist()):
                d = float(np.linalg.norm(q - self.point[self.center[c]]))
                low = max(d - r, 0.0)
                if low <= limit:
                    heapq.heappush(heap, (low, c, d))
        return [(s, -i) for s, i in best]


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (np.einsum("ij,ij->i", points, points)[:, None] - 2 * points @ pivots.T
         + np.einsum("ij,ij->i", pivots, pivots)[None, :])
    return d.argmin(axis=1), np.linalg.norm(points - pivots[d.argmin(axis=1)], axis=1)


def _search(k: int):
    """Search of one block of queries in one stored tree."""
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(pages) and len(queries):
            tree: MTree = pickle.loads(pages.column("pages")[0].as_py())
            raw = queries.column("v").to_pylist()
            for own, q, blob, score in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("v"), "<i8"), raw,
                                           queries.column("score").to_pylist()):
                out += [(own, blob, i, s) for s, i in tree.search(q, own, k, -np.inf if score is None else score)]
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in HITS.split(", ")])
    return run


def top_products(rows: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: float = SCALE,
                 group_vectors: int = GROUP_VECTORS, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """For every query its k candidates with the largest integer inner product.

    Components x count as floor(scale * x).  Queries are the rows whose vec_id
    is divisible by ``query_step``; candidates are all rows with another vec_id.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; fewer than k where there are fewer candidates.  Vectors that are
    null or hold null, NaN or infinite components, and rows with a null vec_id,
    take no part; a shorter vector counts as filled with zeros.  A row that is
    repeated as a whole counts once; a vec_id with several vectors is a query
    for each of them.  Products beyond 64 bits are not defined.  An empty table
    gives no rows.  Other columns are not read.
    """
    spark = rows.sparkSession
    good = usable(rows)
    width = width_of(good)
    result = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], result)
    all_ = stage(packed(good, width, scale).dropDuplicates(["vec_id", "v"]))
    n = all_.count()
    n_pivots = min(MAX_PIVOTS, max(1, n // (2 * group_vectors)))
    # At most MAX_PIVOTS rows come to the driver; the regions' radii are a number per pivot.
    picked = all_.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), "<i8").astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", v, v))], names=["s"])

    square = float(all_.mapInArrow(squares, "s double").agg(F.max("s")).first()[0])
    pivots = lift(np.array([np.frombuffer(r["v"], "<i8") for r in picked]), square)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                region, away = _nearest(lift(matrix(batch.column(1), "<i8"), square), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(away)],
                                                 names=["vec_id", "v", "region", "away"])

    placed = stage(all_.mapInArrow(assign, "vec_id long, v binary, region long, away double"))
    load = {r["region"]: (r["n"], r["radius"]) for r in placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    parts = np.array([max(1, -(-load.get(p, (0, 0))[0] // group_vectors)) for p in range(n_pivots)])
    radius = np.array([load.get(p, (0, -1.0))[1] for p in range(n_pivots)])
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(int(x)) for x in parts]),
                                                      (F.col("region") + 1).cast("int"))).cast("long")

    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
        tree = MTree(group.column("vec_id").to_numpy()[order], matrix(group.column("v"), "<i8")[order], square)
        return pa.table([pa.array([group.column("region")[0].as_py()]), pa.array([group.column("part")[0].as_py()]),
                         pa.array([pickle.dumps(tree)], pa.binary())], names=["region", "part", "pages"])

    trees = stage(placed.withColumn("part", part).select("vec_id", "v", "region", "part")
                  .groupBy("region", "part").applyInArrow(build, "region long, part long, pages binary"))
    queries = all_.filter(F.col("vec_id") % query_step == 0)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = np.column_stack([matrix(batch.column(1), "<i8").astype(float), np.zeros(len(batch))])
                home = _nearest(q, np.where((radius >= 0)[:, None], pivots, np.inf if n_pivots > 1 else 0))[0] if (
                    radius >= 0).all() else np.array([min(np.flatnonzero(radius >= 0), key=lambda p: np.linalg.norm(
                        x - pivots[p])) for x in q])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home), pa.array(batch.column(0).to_numpy() // query_step % parts[home]),
                     pa.nulls(len(batch), pa.int64())], names=["vec_id", "v", "region", "part", "score"])

    asked = "vec_id long, v binary, region long, part long, score long"
    homes = stage(queries.mapInArrow(near, asked))
    blocks = max(1, -(-homes.count() // queries_per_block))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "block", F.col("block").cast("long"))

    def hits(questions: DataFrame) -> DataFrame:
        keys = ["region", "part", "block"]
        return spread.groupBy(*keys).cogroup(questions.withColumn("block", block).groupBy(*keys)).applyInArrow(
            _search(k), HITS)

    first = stage(hits(homes))
    reached = first.groupBy("query_id", "query_v").agg(F.min("score").alias("reached"), F.count(F.lit(1)).alias("n"))
    known = homes.join(reached, (homes["vec_id"] == reached["query_id"]) & (homes["v"] == reached["query_v"]), "left")
    known = known.select("vec_id", "v", "region", "part", F.when(F.col("n") == k, F.col("reached")).alias("score"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, blob, region, at, score in zip(*(c.to_pylist() for c in batch.columns)):
                q = np.append(np.frombuffer(blob, "<i8").astype(float), 0.0)
                length = float(q @ q) + square
                low = np.maximum(np.linalg.norm(pivots - q, axis=1) - radius, 0.0)
                limit = np.inf if score is None else np.sqrt(max(length - 2.0 * score, 0.0) + 1e-6 * (1.0 + length))
                for p in np.flatnonzero((low <= limit) & (radius >= 0)).tolist():
                    out += [(own, blob, p, s, score) for s in range(int(parts[p])) if (p, s) != (region, at)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)],
                                             names=["vec_id", "v", "region", "part", "score"])

    rest = hits(known.mapInArrow(others, asked))
    best = W.partitionBy("query_id", "query_v").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_mtree(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
