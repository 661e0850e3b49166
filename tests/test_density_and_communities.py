"""Density clusters against plain DBSCAN, communities against plain Louvain, path centrality."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import network, space

POINTS = "id long, lat double, lon double"


def metres(p, q):
    a, b = (tuple(map(math.radians, x)) for x in (p, q))
    h = math.sin((b[0] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(b[0]) * math.sin((b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def plain_clusters(points, eps, least):
    near = {i: [j for j, *q in points if metres(p, q) <= eps] for i, *p in points}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += [y for y in near[x] if y in core]
    out = dict(label)
    for i in near:
        if i not in core and (found := [label[j] for j in near[i] if j in core]):
            out[i] = min(found)
    return out


def clusters(spark, points, eps, least):
    return {r.id: r.cluster for r in space.density_clusters(spark.createDataFrame(points, POINTS).repartition(4), eps, least).collect()}


@pytest.mark.parametrize("lat,lon", [(13.0, 77.5), (-0.001, 179.999), (75.0, -180.0), (89.995, 10.0)])
def test_same_as_plain_dbscan(spark, lat, lon):
    r, points = random.Random(7), []
    scale = 1 / max(0.02, math.cos(math.radians(lat)))
    for c in range(6):
        y, x = lat + r.uniform(-0.02, 0.004), lon + r.uniform(-0.02, 0.02) * scale
        points += [(y + r.gauss(0, 0.0015), x + r.gauss(0, 0.0015) * scale) for _ in range(r.choice((10, 60, 90)))]
    points += [(lat + r.uniform(-0.02, 0.004), lon + r.uniform(-0.03, 0.03) * scale) for _ in range(60)]
    points = [(i, min(y, 90.0), (x + 180) % 360 - 180) for i, (y, x) in enumerate(points)]
    points += [(len(points) + k, *points[k][1:]) for k in range(10)]
    for eps, least in ((350, 8), (150, 1 if lat < 0 else 4)):
        assert clusters(spark, points, eps, least) == plain_clusters(points, eps, least)


def test_crowded_cells_that_just_touch_or_just_miss(spark, monkeypatch):
    """Two crowds whose nearest points are the only ones within the radius; boxes are halved."""
    monkeypatch.setattr(space, "DIRECT", 16)
    r = random.Random(3)
    for gap, one in ((399.0, True), (401.0, False)):
        step = gap / 6_371_000 * 180 / math.pi
        crowd = [(13.0 - abs(r.gauss(0, 0.0004)), 77.5 + r.uniform(-0.0006, 0.0006)) for _ in range(60)]
        other = [(13.0 + step + abs(r.gauss(0, 0.0004)), 77.5 + r.uniform(-0.0006, 0.0006)) for _ in range(60)]
        points = [(i, *p) for i, p in enumerate([(13.0, 77.5), *crowd, (13.0 + step, 77.5), *other])]
        got = clusters(spark, points, 400, 8)
        assert got == plain_clusters(points, 400, 8) and (len(set(got.values())) == 1) == one


def test_rows_grow_with_points_not_with_pairs(spark):
    """A crowd within a few metres: 60,000 points would be 3.6 billion pairs."""
    p = spark.range(60_000).select("id", (F.lit(13.0) + F.rand(1) * 2e-3).alias("lat"), (F.lit(77.5) + F.rand(2) * 2e-3).alias("lon"))
    got = space.density_clusters(p, 400, 8)
    assert got.agg(F.count("*"), F.countDistinct("cluster")).first()[:] == (60_000, 1)


def test_no_points_and_no_clusters(spark):
    assert space.density_clusters(spark.createDataFrame([], POINTS)).collect() == []
    assert space.density_clusters(spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0)], POINTS)).collect() == []
    with pytest.raises(ValueError):
        space.density_clusters(spark.createDataFrame([], POINTS), 0.01)


def plain_modularity(edges, label):
    total = 2 * sum(w for *_, w in edges)
    k, inside = {}, 0.0
    for a, b, w in edges:
        for x in (a, b):
            k[label[x]] = k.get(label[x], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum((x / total) ** 2 for x in k.values())


def plain_louvain(edges, seed=0):
    """One node after the other, level by level."""
    r, near, loop = random.Random(seed), {}, {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    label = {x: x for x in near}
    total = sum(sum(v.values()) for v in near.values())
    k = {x: sum(v.values()) for x, v in near.items()}
    while True:
        own, sums, moved = {x: x for x in near}, dict(k), True
        while moved:
            moved = False
            for x in r.sample(sorted(near), len(near)):
                sums[own[x]] -= k[x]
                to = {own[x]: 0.0}
                for y, w in near[x].items():
                    to[own[y]] = to.get(own[y], 0.0) + w
                best = max(sorted(to), key=lambda c: (round(to[c] - k[x] * sums[c] / total, 9), c == own[x]))
                moved |= best != own[x]
                own[x] = best
                sums[best] += k[x]
        if len(set(own.values())) == len(near):
            return label
        label = {x: own[c] for x, c in label.items()}
        joined, degree = {}, {}
        for x, v in near.items():
            degree[own[x]] = degree.get(own[x], 0) + k[x]
            joined.setdefault(own[x], {})
            for y, w in v.items():
                if own[x] != own[y]:
                    joined[own[x]][own[y]] = joined[own[x]].get(own[y], 0) + w
        near, k = joined, degree


def planted(seed, groups=8, size=14, p=0.5, q=0.02):
    r = random.Random(seed)
    return [(a, b, r.choice((1, 1, 2, 3))) for a, b in itertools.combinations(range(groups * size), 2) if r.random() < (p if a // size == b // size else q)]


EDGES = "a long, b long, weight long"


def test_known_communities_and_levels(spark):
    edges = planted(1, p=0.7, q=0.004)
    got = {r.node: r.community for r in network.communities(spark.createDataFrame(edges, EDGES)).collect()}
    assert len(set(got.values())) == 8 and all(len({got[g * 14 + i] for i in range(14) if g * 14 + i in got}) == 1 for g in range(8))
    assert all(c <= n for n, c in got.items())
    # a ring of cliques needs a second level: its best communities are pairs of them
    ring = [(6 * c + i, 6 * c + j, 1) for c in range(30) for i, j in itertools.combinations(range(4), 2)] + [(6 * c, 6 * ((c + 1) % 30) + 1, 1) for c in range(30)]
    label = {r.node: r.community for r in network.communities(spark.createDataFrame(ring, EDGES)).collect()}
    assert len(set(label.values())) < 30 and all(len({label[6 * c + i] for i in range(4)}) == 1 for c in range(30))
    assert plain_modularity(ring, label) >= 0.99 * plain_modularity(ring, plain_louvain(ring))


@pytest.mark.parametrize("edges", [planted(2, 6, 20, 0.3, 0.03), planted(3, 3, 40, 0.15, 0.05)])
def test_modularity_of_a_plain_louvain(spark, edges):
    df = spark.createDataFrame(edges, EDGES)
    found = network.communities(df)
    got = {r.node: r.community for r in found.collect()}
    want = sum(plain_modularity(edges, plain_louvain(edges, s)) for s in range(3)) / 3  # its runs differ by the order of nodes
    assert plain_modularity(edges, got) >= 0.99 * want
    assert abs(network.modularity(df, found).first()[0] - plain_modularity(edges, got)) < 1e-6
    assert got == {r.node: r.community for r in network.communities(df.repartition(7)).collect()}  # seeded: the same again


def test_weights_decide_and_empty_graph(spark):
    edges = [(1, 2, 9), (2, 3, 9), (1, 3, 9), (4, 5, 9), (5, 6, 9), (4, 6, 9), (3, 4, 1), (1, 1, 50)]
    got = {r.node: r.community for r in network.communities(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert network.communities(spark.createDataFrame([], EDGES)).collect() == []


def test_path_scores_by_groups_and_by_levels_agree(spark):
    r = random.Random(4)
    edges = [(a, b, 1) for a, b in itertools.combinations(range(30), 2) if r.random() < 0.1] + [(100 + i, 101 + i, 1) for i in range(12)] + [(100, 106, 1)]
    df = spark.createDataFrame(edges, EDGES)
    one = {r.node: r.betweenness for r in network.betweenness(df).collect()}
    levels = {r.node: r.betweenness for r in network.betweenness(df, steps=0).collect()}
    assert one.keys() == levels.keys() and all(abs(one[k] - levels[k]) < 1e-5 for k in one)
    assert network.betweenness(spark.createDataFrame([], EDGES)).collect() == []


def test_labels_are_not_broadcast(spark):
    import re

    e = spark.createDataFrame([(i, i + 1, 1) for i in range(60) if i % 6 != 5], "a long, b long, weight long")
    seen = []
    own = network.materialize
    try:
        network.materialize = lambda df: seen.append(spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")) or own(df)
        found = network.label_communities(e)
    finally:
        network.materialize = own
    assert found.count() == 60 and sum("SortMergeJoin" in p for p in seen) > 1
    assert not any(re.search("BroadcastExchange", p) for p in seen)
