"""What the graph operators send, and that odd rows still count as they did."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratalens.operators import components, network


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_of_degrees_travel_once(spark):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (3, 3), (3, 1), (None, 4), (4, None), (None, None), (5, None), (6, 1)]
    e = spark.createDataFrame(rows, "a long, b long")
    near = defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    got = network.degrees(e)
    assert "Union" not in plan(got) and plan(got).count("hashpartitioning(a#") <= 2  # of both ends' counts and of the total
    want = {k: (len(v), round(len(v) / (len(near) - 1), 6)) for k, v in near.items()}
    found = got.collect()
    assert {r.node: (r.degree, r.centrality) for r in found} == want and len(found) == len(want)
    assert network.degrees(e.where("1 = 0")).count() == 0
    named = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c")], "a string, b string")
    assert {r.node: r.degree for r in network.degrees(named).collect()} == {"a": 2, "b": 1, "c": 1}


def test_cooccurrence_sends_little_of_large_groups(spark):
    sizes = {1: 1, 2: 2, 3: 20, 4: 21, 5: 3000}
    rows = [(g, m * 11 % n) for g, n in sizes.items() for m in range(n)] * 2 + [(None, 1), (6, None), (7, 4), (7, 4), (7, 5)]
    df = spark.createDataFrame(rows, "g long, m long")
    got = network.cooccurrence_by_group(df, "g", "m")
    # a task sends 21 members of a group at most, and no group is counted by an exchange of its own
    assert "WindowGroupLimit" in plan(got) and "LeftSemi" not in plan(got)
    members = defaultdict(set)
    for g, m in rows:
        if g is not None and m is not None:
            members[g].add(m)
    want = Counter((g, a, b) for g, of in members.items() if 2 <= len(of) <= 20 for a in of for b in of if a < b)
    assert Counter(map(tuple, got.collect())) == want and len(want) == 1 + 190 + 1
    assert Counter((g, a) for g, a, _ in map(tuple, network.cooccurrence_by_group(df, "g", "m", 2).collect())) == {(2, 0): 1, (7, 4): 1}


def test_rounds_of_components_shrink(spark, monkeypatch):
    written, kept = [], components.materialize

    def counted(df):
        out = kept(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    n = 1000
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.connected_components(path).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in range(n + 1)} and len(got) == n + 1
    assert sum(written) < 6 * n  # all rounds, not each of them


def test_components_of_odd_links(spark):
    rows = [(5, 4), (4, 5), (5, 4), (9, 9), (None, 3), (3, None), (None, None), (-7, 4), (2**63 - 1, -(2**63)), (0, 2**63 - 1), (8, 6), (6, 10)] + [(100, k) for k in range(101, 160)]
    e = spark.createDataFrame(rows, "a long, b long")
    found = components.connected_components(e, "a", "b")
    assert "Join" not in plan(found)  # a written table: joins with it are planned by its size
    got = found.collect()
    low = {5: -7, 4: -7, -7: -7, 2**63 - 1: -(2**63), -(2**63): -(2**63), 0: -(2**63), 8: 6, 6: 6, 10: 6} | {k: 100 for k in range(100, 160)}
    assert {r.node: r.component for r in got} == low and len(got) == len(low)
    none = components.connected_components(e.where("a = b"), "a", "b")
    assert none.dtypes == [("node", "bigint"), ("component", "bigint")] and none.count() == 0
    with pytest.raises(RuntimeError):
        components.connected_components(e, "a", "b", max_rounds=1)


def test_subgraph_shuffles_no_edges(spark, monkeypatch):
    """The nodes seen are few and known to be: levels and what follows read edges where they lie."""
    plans, kept = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda df: plans.append(plan(df)) or kept(df))
    rows = [(f"e{k:02d}", "s", f"n{k % 9}", True) for k in range(12)] + [(f"f{k}", f"m{k}", f"n{k}", True) for k in range(5)]
    rows += [("g", "m0", "n1", True), ("h", "s", "s", True), ("i", "s", "out", False), ("j", "s", "far", None), ("k", None, "s", True), ("l", "n3", None, True), ("m", "m0", "q", True)]
    e = spark.createDataFrame(rows, "edge_id string, src string, dst string, mine boolean")
    nodes, among, stubs = network.subgraph(e, "s", 2, 12, F.col("mine"))
    assert len(plans) == 4 and not any("SortMergeJoin" in p for p in [*plans, plan(among)])
    found = {r.node: (r.depth, r.place) for r in nodes.collect()}
    assert found == {"s": (0, 0)} | {f"n{k}": (1, k + 1) for k in range(9)} | {"m0": (2, 10), "m1": (2, 11)}
    assert {r.edge_id for r in among.collect()} == {f"e{k:02d}" for k in range(12)} | {"f0", "f1", "g", "h"}
    assert {r.node: (r.more_edges, r.cross_scope) for r in stubs.collect()} == {"n2": (1, 0), "n3": (1, 0), "n4": (1, 0), "s": (0, 2)}
    alone, own, cut = network.subgraph(e, "s", 0, 12, F.col("mine"))
    assert [tuple(r) for r in alone.collect()] == [("s", 0, 0)] and [r.edge_id for r in own.collect()] == ["h"]
    for seed in ("none", None):
        nodes, among, stubs = network.subgraph(e, seed, 2, 12)
        assert [tuple(r) for r in nodes.collect()] == [(seed, 0, 0)] and not among.count() and not stubs.count()
