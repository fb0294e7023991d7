"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping shards around centres, level by level until
shards are small.  Each shard builds a flat graph: candidates of every vector
are robust-pruned, so that edges point in different directions.  The adjacency
lists of all shards are united.  Every vector then searches the united graph of
its nearest shard: greedily from the closest medoid, then over all neighbours
in range of what is in range.  Links are verified in double precision.

Vectors with many partners in a shard may belong to a group larger than any
shard.  They are compared with all vectors, block by block; what comes back is
a count per vector and the edges of a spanning forest, never all pairs.

The recall is audited against all vectors on a bounded sample; below the wanted
recall, graphs over other centres are added.  If it is still below after the
last round, all vectors are compared with all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stage, table
from tallyforge.llm.components import components
from tallyforge.llm.vectors import matrix, packed, usable, width_of

COSINE = 0.9
SHARD_VECTORS, OVERLAP, LATER_OVERLAP, LEVELS = 4096, 3, 2, 3
#: Graph: candidates and edges per vector, slack of the pruning, random edges, medoids, beam.
CANDIDATES, EDGES, ALPHA, RANDOM_EDGES, MEDOIDS, BEAM = 48, 16, 1.2, 2, 32, 12
AUDIT_VECTORS, WANTED_RECALL, ROUNDS = 100, 0.97, 3
BLOCK = 256
#: A vector with more partners in a shard than this share of it is compared with all vectors.
CROWD_SHARE = 1 / 8


def robust_prune(x: np.ndarray, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edges of ``rows`` out of their candidates ``near`` (closest first); -1 where there are fewer.

    A candidate falls away if a closer kept one is ALPHA times nearer to it
    than the vector itself is.
    """
    there = 2 - 2 * np.einsum("ijk,ik->ij", x[near], x[rows])
    between = 2 - 2 * np.matmul(x[near], x[near].transpose(0, 2, 1))
    alive = np.ones(near.shape, dtype=bool)
    kept = np.zeros(near.shape, dtype=bool)
    for k in range(near.shape[1]):
        take = alive[:, k] & (kept.sum(axis=1) < EDGES)
        kept[:, k] = take
        alive &= ~(take[:, None] & (ALPHA ** 2 * between[:, k] <= there))
    return np.where(kept, near, -1)


def degrees(x: np.ndarray, least: float) -> np.ndarray:
    """Partners of every vector within its shard."""
    return np.concatenate([(x[low:low + BLOCK] @ x.T >= least).sum(axis=1) for low in range(0, len(x), BLOCK)]) - 1


def shard_edges(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of every vector of a shard, both ways, with a few random ones for reach."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    rng = np.random.default_rng(seed)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    heads, tails = [], []
    for low in range(0, n, BLOCK):
        rows = np.arange(low, min(low + BLOCK, n))
        like = x[rows] @ x.T
        like[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1)
        edges = robust_prune(x, rows, near)
        edges = np.column_stack([edges, near[:, 0], rng.integers(0, n, (len(rows), RANDOM_EDGES))])
        head = np.repeat(rows, edges.shape[1])
        use = (edges.ravel() >= 0) & (edges.ravel() != head)
        heads.append(head[use])
        tails.append(edges.ravel()[use])
    head, tail = np.concatenate(heads), np.concatenate(tails)
    pairs = np.unique(np.concatenate([head * n + tail, tail * n + head]))
    cut = np.searchsorted(pairs // n, np.arange(1, n))
    return np.split(pairs % n, cut)


def medoids(x: np.ndarray) -> np.ndarray:
    """Vectors far from each other, the first nearest to the mean."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)) and best.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, edges: list[np.ndarray], queries: np.ndarray, least: float):
    """(query, found) with cosine at least ``least``, by greedy then range-expanding search."""
    n = len(x)
    degree = np.array([len(e) for e in edges], np.int64)
    first = np.cumsum(degree) - degree
    flat = np.concatenate(edges) if n else np.zeros(0, np.int64)
    start = medoids(x)
    found_q, found_v = [], []

    def expand(q: np.ndarray, v: np.ndarray, seen: np.ndarray, base: np.ndarray):
        """Unseen neighbours of v with their cosine to query q; marks them seen."""
        d = degree[v]
        at = np.arange(int(d.sum())) + np.repeat(first[v] - (np.cumsum(d) - d), d)
        key = np.unique(np.repeat(q, d) * n + flat[at])
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        q, v = key // n, key % n
        return q, v, np.einsum("ij,ij->i", x[base[q]], x[v])

    for low in range(0, len(queries), BLOCK):
        base = queries[low:low + BLOCK]
        b = len(base)
        seen = np.zeros((b, n), dtype=bool)
        like = x[base] @ x[start].T
        entry = np.argmax(like, axis=1)
        beam_v = np.full((b, BEAM), -1)
        beam_s = np.full((b, BEAM), -np.inf)
        done = np.zeros((b, BEAM), dtype=bool)
        beam_v[:, 0], beam_s[:, 0] = start[entry], like[np.arange(b), entry]
        seen[np.arange(b), beam_v[:, 0]] = True
        hits = [(np.arange(b), beam_v[:, 0].copy(), beam_s[:, 0].copy())]
        while True:
            open_ = np.where(done | (beam_v < 0), -np.inf, beam_s)
            best = np.argmax(open_, axis=1)
            active = np.flatnonzero(open_[np.arange(b), best] > -np.inf)
            if not len(active):
                break
            done[active, best[active]] = True
            q, v, s = expand(active, beam_v[active, best[active]], seen, base)
            hits.append((q, v, s))
            # The new ones of a query are laid side by side and merged into its beam.
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            wide = int(nth.max(initial=-1)) + 1
            new_v, new_s = np.full((b, wide), -1), np.full((b, wide), -np.inf)
            new_v[q, nth], new_s[q, nth] = v, s
            all_v, all_s = np.column_stack([beam_v, new_v]), np.column_stack([beam_s, new_s])
            all_d = np.column_stack([done, np.zeros((b, wide), dtype=bool)])
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
            beam_v, beam_s, done = (np.take_along_axis(a, order, 1) for a in (all_v, all_s, all_d))
        q, v, s = (np.concatenate(c) for c in zip(*hits))
        inside = s >= least
        q, v = q[inside], v[inside]
        while len(q):
            found_q.append(base[q])
            found_v.append(v)
            q, v, s = expand(q, v, seen, base)
            q, v = q[s >= least], v[s >= least]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    return q[q != v], v[q != v]


def _unit(column: pa.Array) -> np.ndarray:
    x = matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shards(points: DataFrame, salt: int, shard_vectors: int) -> DataFrame:
    """(shard, id, v, home): every vector in its nearest shards, one of them its home."""
    members = points.select(F.lit("").alias("shard"), "id", "v", F.lit(True).alias("home"))
    for level in range(LEVELS):
        members = stage(members)
        load = stage(members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_vectors))
        if load.isEmpty():
            break
        large = members.join(load, "shard")
        order = W.partitionBy("shard").orderBy(F.xxhash64("id", F.lit(salt + level)), "id")
        overlap = OVERLAP if level == 0 else LATER_OVERLAP
        # Twice as many centres as full shards would need: few shards have to be dealt again.
        wanted = F.least(F.lit(64), F.ceil(2 * overlap * F.col("n") / F.lit(shard_vectors)) + 1)
        centres = (large.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 64)
                   .filter(F.col("nth") <= wanted).select("shard", "nth", "v", "n"))
        blocks = F.ceil(F.col("n") / F.lit(shard_vectors))
        part = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("long")
        centres = stage(centres).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))

        def deal(near: pa.Table, centre: pa.Table) -> pa.Table:
            x, c = _unit(near.column("v")), _unit(centre.column("v"))
            names = [f"{near.column('shard')[0].as_py()}/{k}" for k in centre.column("nth").to_pylist()]
            like = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
            row = np.repeat(np.arange(len(x)), like.shape[1])
            home = near.column("home").to_numpy()[row] & (np.arange(len(row)) % like.shape[1] == 0)
            return pa.table([pa.array([names[k] for k in like.ravel()]), near.column("id").take(pa.array(row)),
                             near.column("v").take(pa.array(row)), pa.array(home)], names=["shard", "id", "v", "home"])

        dealt = (large.withColumn("part", part).groupBy("shard", "part")
                 .cogroup(centres.groupBy("shard", "part"))
                 .applyInArrow(deal, "shard string, id long, v binary, home boolean"))
        # A vector may come to a shard by two ways.
        dealt = dealt.groupBy("shard", "id").agg(F.first("v").alias("v"), F.max("home").alias("home"))
        members = members.join(load.select("shard"), "shard", "left_anti").unionByName(dealt)
    # Vectors of one direction lie in one shard whatever the centres: such a shard is cut by hash.
    members = stage(members)
    load = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_vectors)
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.ceil(F.col("n") / F.lit(shard_vectors)))
    return stage(members.join(load, "shard", "left").select(
        F.when(F.col("n").isNull(), F.col("shard")).otherwise(F.concat_ws("#", "shard", part)).alias("shard"),
        "id", "v", "home"))


def graph_links(points: DataFrame, least: float, salt: int = 0,
                shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, DataFrame]:
    """Links (u, v), both ways, that one set of shards and its united graph finds among ``points`` (id, v), and
    the crowded vectors (id), which do not search."""
    members = shards(points, salt, shard_vectors)
    crowd = int(shard_vectors * CROWD_SHARE)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = rows.column("id").to_numpy()
        x = _unit(rows.column("v"))
        edges = shard_edges(x, salt)
        return pa.table([rows.column("id"), pa.array([ids[e] for e in edges], pa.list_(pa.int64())),
                         pa.array(degrees(x, least) > crowd)], names=["id", "near", "crowded"])

    lists = members.select("shard", "id", "v").groupBy("shard").applyInArrow(
        build, "id long, near array<long>, crowded boolean")
    united = stage(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
                                           F.max("crowded").alias("crowded")))

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = rows.column("id").to_numpy()
        near = []
        for own in rows.column("near").to_pylist():
            at = np.searchsorted(ids, np.array(own, np.int64))
            at = np.minimum(at, len(ids) - 1)
            near.append(at[ids[at] == np.array(own, np.int64)])
        asks = rows.column("home").to_numpy() & ~rows.column("crowded").to_numpy()
        q, v = range_search(_unit(rows.column("v")), near, np.flatnonzero(asks), least)
        return pa.table([pa.array(ids[q]), pa.array(ids[v])], names=["u", "v"])

    found = (members.join(united, "id").select("shard", "id", "v", "home", "crowded", "near")
             .groupBy("shard").applyInArrow(search, "u long, v long"))
    links = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return links, united.filter("crowded").select("id")


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a spanning forest of the two-sided graph ``linked``."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in np.flatnonzero(rows_left):
        if not rows_left[first]:
            continue
        rows = np.array([first])
        rows_left[first] = False
        while len(rows):
            columns = np.flatnonzero(columns_left & linked[rows].any(axis=0))
            heads.append(rows[linked[np.ix_(rows, columns)].argmax(axis=0)] if len(columns) else columns)
            tails.append(columns)
            columns_left[columns] = False
            rows = np.flatnonzero(rows_left & linked[:, columns].any(axis=1))
            heads.append(rows)
            tails.append(columns[linked[np.ix_(rows, columns)].argmax(axis=1)] if len(rows) else rows)
            rows_left[rows] = False
    return np.concatenate(heads), np.concatenate(tails)


def _blocks(points: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Points (id, v, copies, crowded) in packed rows of about ``size`` points, and the number of rows."""
    n = -(-points.count() // size)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        return pa.table([rows.column("block").slice(0, 1), pa.array([_unit(rows.column("v")).tobytes()], pa.binary())]
                        + [pa.array([rows.column(c).to_numpy().astype(t).tobytes()], pa.binary())
                           for c, t in (("id", "<i8"), ("copies", "<f8"), ("crowded", "?"))],
                        names=["block", "x", "ids", "copies", "crowded"])

    packed_ = (points.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(n, 1))).cast("int"))
               .groupBy("block").applyInArrow(pack, "block int, x binary, ids binary, copies binary, crowded binary"))
    return stage(packed_), n


def crowd_links(points: DataFrame, crowded: DataFrame, least: float,
                size: int = SHARD_VECTORS) -> tuple[DataFrame, DataFrame]:
    """Exact counts (node, outside) and edges (u, v) of all links with a crowded end.

    A crowded vector counts all rows linked to it, any other one those of
    crowded vectors.  The edges join what the links join.
    """
    marked = points.join(crowded.withColumn("crowded", F.lit(True)), "id", "left").fillna(False, ["crowded"])
    all_, n_all = _blocks(marked, size)
    some, n_some = _blocks(marked.filter("crowded"), size)
    left = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(n_all, 1) - 1))))
    right = all_.withColumnRenamed("block", "other").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(n_some, 1) - 1))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        u, v, n = [none], [none], [none]
        if len(a) and len(b):
            a_id, b_id = (np.frombuffer(t.column("ids")[0].as_py(), "<i8") for t in (a, b))
            a_x, b_x = (np.frombuffer(t.column("x")[0].as_py(), "<f8").reshape(len(i), -1)
                        for t, i in ((a, a_id), (b, b_id)))
            a_n, b_n = (np.frombuffer(t.column("copies")[0].as_py(), "<f8") for t in (a, b))
            plain = ~np.frombuffer(b.column("crowded")[0].as_py(), bool)
            linked = np.empty((len(a_id), len(b_id)), dtype=bool)
            for low in range(0, len(a_id), BLOCK):
                np.greater_equal(a_x[low:low + BLOCK] @ b_x.T, least, out=linked[low:low + BLOCK])
            at = np.minimum(np.searchsorted(b_id, a_id), len(b_id) - 1)
            own = np.flatnonzero(b_id[at] == a_id)
            linked[own, at[own]] = False
            to_b, to_a = np.zeros(len(a_id)), np.zeros(len(b_id))
            for low in range(0, len(a_id), BLOCK):
                part = linked[low:low + BLOCK].astype(float)
                to_b[low:low + BLOCK] = part @ b_n
                to_a += a_n[low:low + BLOCK] @ part
            head, tail = forest(linked)
            u = [a_id[to_b > 0], b_id[plain & (to_a > 0)], a_id[head]]
            v = [np.full(len(u[0]) + len(u[1]), -1), b_id[tail]]
            n = [to_b[to_b > 0], to_a[plain & (to_a > 0)], np.zeros(len(head))]
        n = np.concatenate(n).astype(np.int64)
        return pa.table([pa.array(np.concatenate(u)), pa.array(np.concatenate(v), mask=n > 0), pa.array(n)],
                        names=["u", "v", "n"])

    got = stage(left.groupBy("block", "other").cogroup(right.groupBy("block", "other"))
                .applyInArrow(compare, "u long, v long, n long"))
    return (got.filter("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("outside")),
            got.filter("n = 0").select("u", "v"))


def counted(points: DataFrame, links: DataFrame, crowded: DataFrame, least: float,
            shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(node, outside: other rows linked to it) and edges (u, v) that join what the links join."""
    copies = points.select(F.col("id").alias("v"), F.col("copies").alias("v_copies"))
    crowded = stage(crowded)
    plain = links
    for end in ("u", "v"):
        plain = plain.join(crowded.select(F.col("id").alias(end)), end, "left_anti")
    plain = stage(plain.select("u", "v"))
    count = plain.join(copies, "v").groupBy(F.col("u").alias("node")).agg(F.sum("v_copies").alias("outside"))
    edges = plain.filter("u > v")
    if not crowded.isEmpty():
        more, joined = crowd_links(points, crowded, least, shard_vectors)
        count = count.unionByName(more).groupBy("node").agg(F.sum("outside").alias("outside"))
        edges = edges.unionByName(joined)
    return stage(count), edges


def audit(points: DataFrame, count: DataFrame, least: float, n: int = AUDIT_VECTORS) -> float:
    """Share of the true links of a bounded sample of vectors that were counted."""
    sample = points.orderBy(F.xxhash64("id", F.lit(77)), "id").limit(n).collect()
    if not sample:
        return 1.0
    ids = np.array([r["id"] for r in sample])
    x = np.array([np.frombuffer(r["v"], "<f8") for r in sample])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)

    def true_links(batches):
        total = np.zeros(len(ids))
        for batch in batches:
            if len(batch):
                own = batch.column(0).to_numpy()
                like = _unit(batch.column(1)) @ x.T
                linked = (like >= least) & (own[:, None] != ids[None, :])
                total += batch.column(2).to_numpy().astype(float) @ linked
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true"])

    true = points.select("id", "v", "copies").mapInArrow(true_links, "node long, true double")
    true = true.groupBy("node").agg(F.sum("true").alias("true"))
    all_, got = true.join(count, "node", "left").agg(
        F.sum("true"), F.sum(F.least("true", F.coalesce("outside", F.lit(0))))).first()
    return got / all_ if all_ else 1.0


def near_duplicates(rows: DataFrame, least: float = COSINE, wanted_recall: float = WANTED_RECALL,
                    rounds: int = ROUNDS, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept.

    Rows link where the cosine of their vectors, in double precision, is at
    least ``least``; equal vectors are handled once and counted as often as
    they come.  component_id is the smallest vec_id reachable by links; kept
    says that it is the row's own.  Vectors that are null, zero, or hold null,
    NaN or infinite components, and rows with a null vec_id, link with nothing.
    Rows that share a vec_id are one node of the components.  A shorter vector
    counts as filled with zeros.  An empty table gives no rows.  Other columns
    are not read.
    """
    good = usable(rows)
    width = width_of(good)
    all_ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not width:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                              F.lit(True).alias("kept"))
    nonzero = good.filter(F.exists("embedding", lambda x: x != 0))
    own = stage(packed(nonzero, width))
    points = stage(own.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    # Rows that share an id but not the vector keep the first as the node; the others get numbers of their own.
    order = W.partitionBy("id").orderBy("v")
    points = stage(points.withColumn("nth", F.row_number().over(order))
                   .withColumn("node", F.when(F.col("nth") == 1, F.col("id")).otherwise(
                       F.shiftrightunsigned(F.xxhash64("v"), 2).bitwiseOR(F.lit(1 << 62)))))
    graph = points.select(F.col("node").alias("id"), "v", "copies")
    links, crowded = graph_links(graph, least, 0, shard_vectors)
    links = stage(links)
    count, edges = counted(graph, links, crowded, least, shard_vectors)
    recall = audit(graph, count, least)
    for extra in range(1, rounds):
        if recall >= wanted_recall:
            break
        more, also = graph_links(graph, least, 1000 * extra, shard_vectors)
        links = stage(links.unionByName(more).distinct())
        crowded = crowded.unionByName(also).distinct()
        count, edges = counted(graph, links, crowded, least, shard_vectors)
        recall = audit(graph, count, least)
    if recall < wanted_recall:
        # No graph reaches the wanted recall: every vector is compared with all.
        count, edges = counted(graph, links, graph.select("id"), least, shard_vectors)
    node = own.join(points.select("v", "node", "copies"), "v").join(count, "node", "left").select(
        "vec_id", "node", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    node = stage(node)
    edges = edges.unionByName(node.filter("vec_id <> node").select(
        F.col("node").alias("u"), F.col("vec_id").alias("v")))
    label = components(edges)
    taking = node.join(label, "node", "left").select(
        "vec_id", "n_links", F.coalesce("component", "node").alias("component_id"))
    rest = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .filter(~_takes_part()).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id")))
    return taking.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _takes_part():
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def op6_neighbour_graph(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
