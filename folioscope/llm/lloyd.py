"""Operator 11: k-means by dual-tree Lloyd rounds over integer vectors, exact to the last bit.

Vectors are dealt out in blocks of at most BLOCK. Each block gets a cover tree once, stored beside its vectors: a node is a ball around one of
its points; its children are balls of at most half its radius, whose centres lie further apart than that, the node's own centre among them. Equal
vectors are one point with a weight. Each round the centroids get a tree of the same kind, and each task walks both trees at once: a pair of nodes is
dropped if no vector in the one can be nearer to a centroid in the other than to some centroid that is left. A vector node with one
centroid left goes to it whole, by its stored sum; what remains at the leaves is compared exactly, in integers. So a
round shuffles one row of sums for each task and centroid, and at most k centroids go through the driver.

Vectors whose length isn't `dim`, or with a null, infinite or NaN component, aren't clustered and give no row; nor does a null vector. Repeated rows count as
often as they occur. A null vec_id is clustered but starts no centroid. Equal hashes of repeated vec_ids start in the order of their
components. Fewer vectors than k give fewer centroids; none give an empty table. Components have to be under 2**27 after scaling, as squared distances are
longs; others raise ValueError. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, CENTROIDS, ROUNDS, SCALE, PREFIX = 64, 40, 5, 256, "2:"
BLOCK = 2048
#: Distinct points of a leaf; a leaf's points are compared one by one.
LEAF = 8
MOST = 1 << 27
#: Relative room that bounds leave for rounding of square roots.
SLACK = 1e-9


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances; int64 throughout."""
    diff = points - centre
    return np.einsum("ij,ij->i", diff, diff)


class Tree:
    """Cover tree of distinct integer points, its nodes in arrays.

    Node i covers points lo[i] to hi[i] of `order`, all within radius[i] of point centre[i]; first[i] to first[i] + kids[i] are its children (none: a leaf).
    """

    NAMES = ("order", "lo", "hi", "centre", "radius", "first", "kids")

    def __init__(self, order, lo, hi, centre, radius, first, kids):
        self.order, self.lo, self.hi, self.centre, self.radius, self.first, self.kids = order, lo, hi, centre, radius, first, kids

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(points))
        lo, hi, centre, radius, first, kids = [0], [len(points)], [0], [0.0], [0], [0]
        away = [_squares(points, points[0])]
        radius[0] = float(away[0].max())
        todo = [0]
        for i in todo:
            a, b = lo[i], hi[i]
            dist, away[i] = away[i], None
            if b - a <= leaf or radius[i] == 0.0:
                continue
            # children: balls of half the radius; each new centre lies outside the earlier ones
            part, half, parts = order[a:b], radius[i] / 4.0, []
            c = centre[i]
            while True:
                near = dist <= half
                parts.append((c, part[near], dist[near]))
                part = part[~near]
                if not len(part):
                    break
                c = part[0]
                dist = _squares(points[part], points[c])
            first[i], kids[i] = len(lo), len(parts)
            for c, own, dist in parts:
                order[a : a + len(own)] = own
                lo.append(a)
                hi.append(a + len(own))
                centre.append(c)
                radius.append(float(dist.max()))
                first.append(0)
                kids.append(0)
                away.append(dist)
                todo.append(len(lo) - 1)
                a += len(own)
        return cls(order.astype(np.int32), *(np.array(x, np.int32) for x in (lo, hi, centre)), np.sqrt(np.array(radius)), np.array(first, np.int32), np.array(kids, np.int32))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, k-th of it) for each of counts[which] items."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(whole, own): nodes that go to one centroid whole as (lo, hi, centroid), and for each place in tree.order the centroid, -1 within `whole`.

    points are distinct, as are centroids; of equally near centroids the first counts.
    """
    own, whole = np.full(len(points), -1, np.int64), []
    v, q = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes; all pairs of a vector node stand together
    while len(v):
        diff = points[tree.centre[v]] - centroids[over.centre[q]]
        dist = np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(np.float64))
        rv, rq = tree.radius[v], over.radius[q]
        starts = np.nonzero(np.diff(v, prepend=-1))[0]
        most = np.minimum.reduceat(dist + rv, starts)[np.cumsum(np.diff(v, prepend=-1) != 0) - 1]
        keep = dist - rv - rq <= most + SLACK * (1 + dist + rv + rq)
        v, q, rv, rq = v[keep], q[keep], rv[keep], rq[keep]
        starts = np.nonzero(np.diff(v, prepend=-1))[0]
        group = np.cumsum(np.diff(v, prepend=-1) != 0) - 1
        n = np.bincount(group)
        leaf_q = over.kids[q] == 0
        single = (n == 1) & leaf_q[starts]
        for at in starts[single]:
            whole.append((tree.lo[v[at]], tree.hi[v[at]], over.centre[q[at]]))
        open_q = np.bincount(group, ~leaf_q) > 0
        leaf_v = tree.kids[v[starts]] == 0
        deep_q = open_q & (leaf_v | (np.maximum.reduceat(rq, starts) >= rv[starts]))
        ends = np.append(starts[1:], len(v))
        for g in np.nonzero(leaf_v & ~open_q & ~single)[0]:
            node, near = v[starts[g]], np.sort(over.centre[q[starts[g] : ends[g]]])
            part = tree.order[tree.lo[node] : tree.hi[node]]
            diff = points[part][:, None, :] - centroids[near][None, :, :]
            own[tree.lo[node] : tree.hi[node]] = near[np.einsum("ijk,ijk->ij", diff, diff).argmin(axis=1)]
        # one side of every pair of a vector node is opened: the centroids' or the vectors'
        into_q, into_v = deep_q[group], (~deep_q & ~single & ~leaf_v)[group]
        which, k = _spread(np.where(leaf_q[into_q], 1, over.kids[q[into_q]]))
        v1, q0 = v[into_q][which], q[into_q][which]
        q1 = np.where(over.kids[q0] == 0, q0, over.first[q0] + k)
        which, k = _spread(tree.kids[v[into_v]])
        v2, q2 = tree.first[v[into_v][which]] + k, q[into_v][which]
        v, q = np.concatenate([v1, v2]), np.concatenate([q1, q2])
        by = np.argsort(v, kind="stable")
        v, q = v[by], q[by]
    return whole, own


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id: long, v: array<bigint>) of the vectors that are clustered: floor(scale * x) of each component."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    small = F.forall("x", lambda c: F.abs(c * scale) < MOST)
    return rows.select("vec_id", F.when(small, F.transform("x", lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit(f"a component of {MOST} or more after scaling"))).cast("array<bigint>").alias("v"))


def starting(rows: DataFrame, k: int = CENTROIDS, prefix: str = PREFIX) -> np.ndarray:
    """The k vectors of smallest hash of their vec_id, in its order; they are all that reaches the driver."""
    hashed = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


_BLOCK = "ids binary, nulls binary, point binary, points binary, weight binary, " + ", ".join(f"{n} binary" for n in Tree.NAMES)


def blocks(rows: DataFrame, dim: int = DIM, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of vectors: their ids, which point each is, the distinct points, and the tree over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        held, n = [], 0

        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            ids = whole.column(0).combine_chunks()
            points, point, weight = np.unique(whole.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), axis=0, return_inverse=True, return_counts=True)
            tree = Tree.build(points, leaf)
            arrays = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), point.ravel().astype(np.int32), points.astype(np.int32), weight, *(getattr(tree, x) for x in Tree.NAMES)]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == block:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    return rows.select("vec_id", "v").mapInArrow(run, _BLOCK)


def _read(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tree]:
    of = lambda name, kind: np.frombuffer(row[name], kind)
    tree = Tree(*(of(n, np.float64 if n == "radius" else np.int32) for n in Tree.NAMES))
    return of("ids", np.int64), of("nulls", bool), of("point", np.int32), of("points", np.int32).astype(np.int64).reshape(-1, dim), of("weight", np.int64), tree


def _owners(points: np.ndarray, tree: Tree, distinct: np.ndarray, over: Tree) -> np.ndarray:
    """The centroid of each point, by place in `points`."""
    whole, own = assign(points, tree, distinct, over)
    for lo, hi, c in whole:
        own[lo:hi] = c
    out = np.empty_like(own)
    out[tree.order] = own
    return out


def _over(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Distinct centroids in the order of their smallest numbers, those numbers, and the tree over them."""
    _, numbers = np.unique(centroids, axis=0, return_index=True)
    numbers = np.sort(numbers)
    return centroids[numbers], numbers, Tree.build(centroids[numbers], 1)


def totals(trees: DataFrame, centroids: np.ndarray, dim: int = DIM) -> DataFrame:
    """(cluster, n, sums: array<bigint>): vectors and sums of components of each centroid that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, numbers, over = _over(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, points, weight, tree = _read(row, dim)
                whole, own = assign(points, tree, distinct, over)
                w = weight[tree.order]
                # sums up to each place, so a whole node takes two look-ups
                upto = np.zeros((len(w) + 1, dim), np.int64)
                np.cumsum(points[tree.order] * w[:, None], axis=0, out=upto[1:])
                count = np.append(0, np.cumsum(w))
                for lo, hi, c in whole:
                    n[numbers[c]] += count[hi] - count[lo]
                    sums[numbers[c]] += upto[hi] - upto[lo]
                at = np.nonzero(own >= 0)[0]
                np.add.at(n, numbers[own[at]], w[at])
                np.add.at(sums, numbers[own[at]], points[tree.order[at]] * w[at, None])
        got = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(n[got]), pa.array(list(sums[got]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<bigint>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))


def assigned(trees: DataFrame, centroids: np.ndarray, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, numbers, over = _over(centroids)
        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls, point, points, _, tree = _read(row, dim)
                own = _owners(points, tree, distinct, over)
                diff = points - distinct[own]
                away = np.einsum("ij,ij->i", diff, diff)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(numbers[own[point]], pa.int32()), pa.array(away[point])], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def lloyd(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, prefix: str = PREFIX, dim: int = DIM, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the rows (vec_id, v), and the final centroids."""
    centroids = starting(rows, k, prefix)
    trees = common.materialize(blocks(rows, dim, block), "lloyd-trees")
    for _ in range(rounds if len(centroids) else 0):
        for r in totals(trees, centroids, dim).collect():  # k rows at most
            centroids[r.cluster] = [s // r.n for s in r.sums]
    if not len(centroids):
        return assigned(trees.limit(0), centroids, dim), centroids
    return assigned(trees, centroids, dim), centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, prefix: str = PREFIX, dim: int = DIM, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is clustered."""
    rows = kept(vectors, id_col, vector_col, dim, scale)
    found, centroids = lloyd(rows, k, rounds, prefix, dim, block)
    found = common.materialize(found, "lloyd")
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    named = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in inertia.items()]
    table = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _nearest(vectors: str, centroids: str) -> str:
    """SQL: each vector's centroid, by number and distance."""
    away = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"select rid, vec_id, v, d.c as cluster, d.d as distance from (select x.rid, any_value(x.vec_id) as vec_id, any_value(x.v) as v, min({{'d': ({away})::bigint, 'c': c.c}}) as d from {vectors} x cross join {centroids} c group by x.rid)"


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, prefix: str = PREFIX) -> str:
    """DuckDB SQL for cluster(): the rounds in turn, every vector against every centroid."""
    parts = [
        f"x as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as v from embeddings"
        f" where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = {dim})",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('{prefix}' || vec_id) as h, v from x where vec_id is not null order by h, v limit {k}))",
    ]
    for i in range(rounds):
        mean = "list_transform(s, lambda t: (t - (((t % n) + n) % n)) // n)"
        parts.append(f"a{i} as materialized ({_nearest('x', f'c{i}')})")
        parts.append(f"e{i} as (select cluster, i, sum(e)::bigint as t, count(*) as n from (select cluster, unnest(v) as e, unnest(range(1, {dim + 1})) as i from a{i}) group by cluster, i)")
        parts.append(f"m{i} as (select cluster, any_value(n) as n, list(t order by i) as s from e{i} group by cluster)")
        parts.append(f"c{i + 1} as materialized (select c.c, coalesce({mean}, c.v) as v from c{i} c left join m{i} m on m.cluster = c.c)")
    parts.append(f"f as materialized ({_nearest('x', f'c{rounds}')})")
    sums = "sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia"
    return f"with {', '.join(parts)} select vec_id, cluster::int as cluster, distance, {sums}, sha256(array_to_string(c.v, ',')) as centroid_sha256 from f join c{rounds} c on c.c = f.cluster"
