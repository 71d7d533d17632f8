"""Density clusters, refinement and merging against plain code."""

import random

import numpy as np
import pytest

from fairlead.config import Clustering
from fairlead.functions.dtw import dtw
from fairlead.operators import cluster
from fairlead.operators.components import components, numbered


def plain_dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if np.hypot(p[0] - q[0], p[1] - q[1]) <= eps] for p in points]
    labels, label = [-1] * len(points), 0
    core = [len(x) >= least for x in near]
    for i in range(len(points)):
        if labels[i] != -1 or not core[i]:
            continue
        stack, labels[i] = [i], label
        while stack:
            k = stack.pop()
            for j in near[k]:
                if labels[j] == -1:
                    labels[j] = label
                    if core[j]:
                        stack.append(j)
        label += 1
    return labels


@pytest.mark.parametrize("seed", range(3))
def test_dbscan(spark, seed):
    draw = random.Random(seed)
    points = [(draw.randrange(40) * 0.0004, draw.randrange(40) * 0.0004) for _ in range(150)]
    points += points[:6]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "pos long, x double, y double")
    got = {r["pos"]: r["label"] for r in cluster.dbscan(df).collect()}
    assert [got[k] for k in range(len(points))] == plain_dbscan(points, 0.001, 5)


def test_dbscan_of_nothing(spark):
    assert cluster.dbscan(spark.createDataFrame([], "pos long, x double, y double")).count() == 0


def test_components_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30))


def test_numbering_is_gapless(spark):
    df = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "v int")
    assert sorted((r["v"], r["n"]) for r in numbered(df, ["v"], "n").collect()) == [(k, k) for k in range(101)]


def plain_refine(group, paths, rules, depth=0):
    if len(group) <= 1 or depth > rules.max_depth or len(group) < rules.min_size:
        return [(group, group[0], 0.0)]
    d = {(a, b): dtw(paths[a], paths[b]) for a in group for b in group}
    rep = min(group, key=lambda a: (sum(d[a, b] for b in group if b != a), a))
    far = np.array([d[rep, b] for b in group if b != rep])
    with np.errstate(invalid="ignore"):
        limit = far.mean() + rules.split_sigma * far.std()
    out = [b for b in group if b != rep and d[rep, b] > limit]
    if not out:
        return [(group, rep, far.mean())]
    return plain_refine([b for b in group if b not in out], paths, rules, depth + 1) + plain_refine(out, paths, rules, depth + 1)


def test_refine_equals_recursion(spark):
    draw = np.random.default_rng(3)
    paths = {k: np.cumsum(draw.normal(size=(draw.integers(4, 9), 2)), axis=0) + (30 if k % 11 == 0 else 0) for k in range(40)}
    rules = Clustering(split_sigma=1.2)
    groups = {0: [k for k in paths if k % 3 == 0], 1: [k for k in paths if k % 3 == 1], -1: [k for k in paths if k % 3 == 2]}
    wanted = []
    for label, members in sorted(groups.items(), key=lambda x: min(x[1])):
        wanted += [([m], m, 0.0) for m in members] if label == -1 else plain_refine(members, paths, rules)
    rows = [(m, label, label) for label, members in groups.items() for m in members]
    tracks = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in paths.items()], "pos long, path array<struct<lon:double,lat:double>>")
    members, heads = cluster.refine(spark.createDataFrame(rows, "pos long, s_label int, e_label int"), tracks, rules)
    own = {}
    for r in members.collect():
        own.setdefault(r["cluster"], []).append(r["pos"])
    found = {r["cluster"]: (sorted(own[r["cluster"]]), r["rep"], r["intra_avg_dist"]) for r in heads.collect()}
    assert len(found) == len(wanted)
    for k, (group, rep, mean) in enumerate(wanted):
        assert found[k][0] == group and found[k][1] == rep and found[k][2] == pytest.approx(mean, nan_ok=True)


def path(*points):
    return [tuple(map(float, p)) for p in points]


def test_merge_and_flip(spark):
    tracks = spark.createDataFrame([(0, path((0, 0), (1, 0), (2, 0))), (1, path((2, 0.1), (1, 0.1), (0, 0.1))), (2, path((0, 0.05), (1, 0.05), (2, 0.05))), (3, path((50, 50), (51, 50), (52, 50)))], "pos long, path array<struct<lon:double,lat:double>>")
    members = spark.createDataFrame([(k, k) for k in range(4)], "cluster long, pos long")
    heads = spark.createDataFrame([(k, k, 0.0) for k in range(4)], "cluster long, rep long, intra_avg_dist double")
    merged = cluster.merge(members, heads, tracks, Clustering(merge_threshold=1.0))
    assert sorted((r["cluster_id"], r["pos"]) for r in merged.collect()) == [(0, 0), (0, 1), (0, 2), (1, 3)]
    clusters, flips = cluster.finalize(merged, tracks)
    assert {r["cluster_id"]: (r["rep"], r["size"]) for r in clusters.collect()} == {0: (2, 3), 1: (3, 1)}
    assert {r["pos"]: r["flip"] for r in flips.collect()} == {0: False, 1: True, 2: False, 3: False}


def test_infinite_pair_stops_automatic_merging(spark):
    tracks = spark.createDataFrame([(0, path((0, 0), (1, 0))), (1, path((0, 0), (1, 0.1))), (2, path(*[(k, 0) for k in range(9)]))], "pos long, path array<struct<lon:double,lat:double>>")
    heads = spark.createDataFrame([(k, k, 0.0) for k in range(3)], "cluster long, rep long, intra_avg_dist double")
    assert cluster.merge_pairs(heads, tracks).count() == 0
