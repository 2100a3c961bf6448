"""Density hierarchies against a plain one over all pairs of points."""

import numpy as np
import pytest

from quillon.operators import cluster, hierarchy


def plain(p, ids, min_size=5, min_samples=3):
    """labels by id, and clusters {(members, stability)}: a full matrix, one tree, recursion from the top."""
    if len(p) < min_size:
        return dict.fromkeys(ids, -1), []
    d = hierarchy.distances(p, p)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    reach = np.maximum(np.maximum(d, core), core[:, None])
    # the tree by Kruskal over all pairs in order of (weight, smaller id, larger id)
    pairs = sorted((reach[i, j], ids[i], ids[j]) if ids[i] < ids[j] else (reach[i, j], ids[j], ids[i]) for i in range(len(p)) for j in range(i))
    group = {i: [i] for i in ids}
    tree = {i: None for i in ids}  # id of a node -> (weight, left, right)
    node, merges = {i: ("p", i) for i in ids}, {}
    for w, u, v in pairs:
        if group[u] is group[v]:
            continue
        a, b = group[u], group[v]
        name = ("m", len(merges))
        merges[name] = (w, node[u], node[v], len(a) + len(b))
        joined = a + b
        for i in joined:
            group[i], node[i] = joined, name
    size = lambda n: 1 if n[0] == "p" else merges[n][3]
    points = lambda n: [n[1]] if n[0] == "p" else points(merges[n][1]) + points(merges[n][2])
    clusters = []

    def grow(n, birth):
        """The cluster that begins at node n: (stability, members, best inside, chosen inside)."""
        members, total, inside = points(n), 0.0, []
        while True:
            w, a, b, _ = merges[n]
            density = 1 / max(w, hierarchy.FLOOR)
            big = [x for x in (a, b) if size(x) >= min_size]
            small = [x for x in (a, b) if size(x) < min_size]
            if len(big) == 2:
                total += (size(a) + size(b)) * (density - birth)
                inside = [grow(a, density), grow(b, density)]
                break
            total += sum(size(x) for x in small) * (density - birth)
            if not big:
                break
            n = big[0]
        below = sum(x[1] for x in inside)
        chosen = [members] if total >= below else [m for x in inside for m in x[2]]
        clusters.append((sorted(members), round(total, 6)))
        return total, max(total, below), chosen, inside

    import sys

    sys.setrecursionlimit(100_000)
    top = grow(("m", len(merges) - 1), 0.0)
    chosen = sorted((sorted(m) for x in top[3] for m in x[2]), key=lambda m: m[0])
    labels = dict.fromkeys(ids, -1) | {i: k for k, m in enumerate(chosen) for i in m}
    return labels, clusters


def frame(spark, groups):
    return spark.createDataFrame([(g, int(i), [float(c) for c in x]) for g, (ids, p) in groups.items() for i, x in zip(ids, p, strict=True)], "g string, id long, p array<double>")


def blobs(rng, centres, each, spread, noise, dims=3):
    c = rng.uniform(-10, 10, (centres, dims))
    p = np.concatenate([rng.normal(m, s, (each, dims)) for m, s in zip(c, rng.uniform(spread / 3, spread, centres), strict=True)] + [rng.uniform(-12, 12, (noise, dims))])
    ids = rng.permutation(3 * len(p))[: len(p)]
    return ids, p


@pytest.mark.parametrize(("block", "most"), [(2_000, 200_000), (60, 150)])
def test_same_as_a_plain_hierarchy(spark, block, most):
    rng = np.random.default_rng(2)
    groups = {"a": blobs(rng, 5, 40, 0.8, 60), "b": blobs(rng, 2, 20, 0.5, 10), "few": blobs(rng, 1, 4, 1.0, 0), "one": (np.array([7]), np.zeros((1, 3))), "same": (np.arange(9), np.ones((9, 3)))}
    ids, p = groups["b"]
    groups["ties"] = (ids, np.round(p))
    labels, clusters = hierarchy.density_topics(frame(spark, groups), block=block, most=most)
    got, tree = {}, {}
    for r in labels.collect():
        got.setdefault(r.g, {})[r.id] = r.topic_id
    for r in clusters.collect():
        tree.setdefault(r.g, []).append((r.size, r.stability, r.within is None))
    for g, (ids, p) in groups.items():
        want, wanted = plain(p, ids.tolist())
        assert got[g] == want, g
        has, should = sorted((n, s) for n, s, top in tree.get(g, []) if not top), sorted((len(m), s) for m, s in wanted if len(m) < len(ids))
        assert [n for n, _ in has] == [n for n, _ in should]
        assert [s for _, s in has] == pytest.approx([s for _, s in should], rel=1e-6, abs=1e-5)
    assert max(got["a"].values()) >= 3


def test_two_thousand_points_in_blocks(spark):
    rng = np.random.default_rng(8)
    ids, p = blobs(rng, 12, 150, 0.6, 200)
    assert len(ids) == 2_000
    labels, _ = hierarchy.density_topics(frame(spark, {"g": (ids, p)}), block=500, most=1_000)
    want, _ = plain(p, ids.tolist())
    assert {r.id: r.topic_id for r in labels.collect()} == want
    assert len(set(want.values())) > 8


def test_odd_points(spark):
    rows = [("g", 1, [1.0]), ("g", 1, [1.0]), ("g", None, [2.0]), (None, 3, [2.0]), ("g", 4, None)]
    df = spark.createDataFrame(rows, "g string, id long, p array<double>")
    labels, clusters = hierarchy.density_topics(df)
    assert [tuple(r) for r in labels.collect()] == [("g", 1, -1)] and clusters.collect() == []
    labels, clusters = hierarchy.density_topics(df.limit(0))
    assert labels.collect() == [] and clusters.collect() == []


def vectors(spark, n=12):
    rng = np.random.default_rng(0)
    rows = [(int(c), k * 4 + c, rng.normal(np.eye(8)[c], 0.01).tolist()) for c in range(3) for k in range(n)]
    odd = [("a", 900, [0.0] * 8), ("a", 901, None), ("a", 902, [1.0]), (None, 1, [1.0] * 8), ("a", None, [1.0] * 8)]
    return spark.createDataFrame([("a", i, v) for _, i, v in rows] + [("b", i, v) for c, i, v in rows if c == 0] + odd, "g string, id long, v array<double>"), {i: c for c, i, _ in rows}


def test_topics_of_vectors_and_their_layout(spark):
    df, kind = vectors(spark)
    whole = {(r.grp, r.id): r for r in cluster.topic_clusters(df, "g", "id", "v").collect()}
    parts = {(r.grp, r.id): r for r in cluster.topic_clusters(df, "g", "id", "v", most=10, edges=20).collect()}
    assert {k: r.topic_id for k, r in parts.items()} == {k: r.topic_id for k, r in whole.items()}
    assert len(whole) == 36 + 12 + 1 and whole[None, 1].topic_id == -1
    found = {(kind[i], r.topic_id) for (g, i), r in whole.items() if g == "a" and r.topic_id >= 0}
    assert len(found) == 3 and len({t for _, t in found}) == 3
    at = {c: np.array([(r.x, r.y) for (g, i), r in whole.items() if g == "a" and kind[i] == c]) for c in range(3)}
    within = max(np.linalg.norm(x - x.mean(axis=0), axis=1).max() for x in at.values())
    between = min(np.linalg.norm(at[a].mean(axis=0) - at[b].mean(axis=0)) for a in range(3) for b in range(a))
    assert between > 3 * within
    every = np.concatenate(list(at.values()))
    assert np.allclose(every.mean(axis=0), 0, atol=1e-4) and np.allclose(every.std(axis=0), 1, atol=1e-4)
