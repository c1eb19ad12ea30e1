"""Operator 11 against plain k-means in Python integers, and its trees against all pairs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, dim, k, rounds, scale=256):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) of every vector, by all distances."""
    kept = [(i, [math.floor(scale * x) for x in map(float, v)]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            if part := [v for (_, v), o in zip(kept, own) if o == c]:
                cents[c] = [sum(x) // len(part) for x in zip(*part)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {c: sum(d for _, d, o in found if o == c) for c in range(len(cents))}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def test_trees_cover_and_separate():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(-50, 50, (500, 5)), axis=0)
    t = lloyd.Tree.build(points, 4)
    assert sorted(t.order) == list(range(len(points)))
    for i in range(len(t.lo)):
        own = points[t.order[t.lo[i] : t.hi[i]]]
        away = np.sqrt(lloyd._squares(own, points[t.centre[i]]))
        assert len(own) and np.isclose(away.max(), t.radius[i])
        kids = range(t.first[i], t.first[i] + t.kids[i])
        if kids:
            assert [t.lo[k] for k in kids] + [t.hi[i]] == [t.lo[i]] + [t.hi[k] for k in kids]
            assert t.centre[kids[0]] == t.centre[i] and all(t.radius[k] <= t.radius[i] / 2 + 1e-9 for k in kids)
            centres = points[[t.centre[k] for k in kids]]
            assert all(np.linalg.norm(a - b) > t.radius[i] / 2 - 1e-9 for n, a in enumerate(centres) for b in centres[:n])


@pytest.mark.parametrize("dim, spread, n", [(1, 3, 200), (2, 10, 700), (8, 100, 600), (64, 20, 900)])
def test_assign_is_exact(dim, spread, n):
    rng = np.random.default_rng(dim)
    # several blobs, many ties and equal distances on the small grids
    points = np.unique(rng.integers(-spread, spread, (n, dim)) + 4 * spread * rng.integers(0, 4, (n, 1)), axis=0)
    for k in (1, 2, 17, 40):
        cents = points[rng.integers(0, len(points), k)] + rng.integers(-1, 2, (k, dim))
        distinct, numbers, over = lloyd._over(cents)
        got = numbers[lloyd._owners(points, lloyd.Tree.build(points, lloyd.LEAF), distinct, over)]
        want = ((points[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (got == want).all()


def test_nodes_go_whole():
    rng = np.random.default_rng(5)
    points = np.unique(np.concatenate([rng.integers(0, 20, (500, 4)), rng.integers(5000, 5020, (500, 4))]), axis=0)
    distinct, _, over = lloyd._over(np.array([[10] * 4, [5010] * 4]))
    whole, own = lloyd.assign(points, lloyd.Tree.build(points, lloyd.LEAF), distinct, over)
    assert len(whole) < 10 and (own < 0).all()


def test_cluster_against_python(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.normal(rng.integers(0, 5), 0.7, 6).astype(np.float32)], 0) for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 200 + [(1000, [-0.001] * 6, 1), (None, [0.5] * 6, 1)]  # a hot vector, an id of several rows, no id
    rows += [(2000, None, 1), (2001, [1.0] * 5, 1), (2002, [1.0] * 5 + [None], 1), (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 1), (2005, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, block in ((40, 64), (3, 1000)):
        got = sorted((tuple(r) for r in lloyd.cluster(df, k=k, dim=6, block=block).collect()), key=str)
        assert got == plain([(i, v) for i, v, _ in rows], 6, k, lloyd.ROUNDS)


def test_few_none_and_clashing_columns(spark):
    assert lloyd.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    two = spark.createDataFrame([(1, [0.25] * 64, 3), (2, [0.5] * 64, 3)], SCHEMA).withColumns({"v": F.lit("x"), "cluster": F.lit(9), "distance": F.lit(1), "x": F.lit(2)})
    assert sorted(tuple(r)[:5] for r in lloyd.cluster(two).collect()) == plain_two()
    with pytest.raises(Exception, match="after scaling"):
        lloyd.cluster(spark.createDataFrame([(1, [1e30] * 64, 3)], SCHEMA)).collect()


def plain_two():
    return sorted(r[:5] for r in plain([(1, [0.25] * 64), (2, [0.5] * 64)], 64, 40, 5))
