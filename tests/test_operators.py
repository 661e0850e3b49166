"""Hand-computed fixtures of the case operators."""

import datetime as dt
import pathlib
import re

import pytest
from pyspark.sql import functions as F, types as T

from stratalens.functions import exprs as X
from stratalens.operators import attributes, components, forest, identity, network, series, space, tables
from stratalens.plans import governance
from stratalens.sources import files
from stratalens.streaming.velocity import windowed_counts

ROOT = pathlib.Path(__file__).parent.parent


def test_library_stands_without_the_training_data_operators():
    for p in (ROOT / "stratalens").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|corpus_pipeline", p.read_text()), p


BRIDGE = [(1, 2), (1, 3), (2, 3), (11, 12), (11, 13), (12, 13), (99, 1), (99, 11), (21, 22), (21, 23), (22, 23)]


def test_bridge_world(spark):
    e = spark.createDataFrame([(a, b, 1) for a, b in BRIDGE], "a long, b long, weight long")
    score = {r.node: r.betweenness for r in network.betweenness(e).collect()}
    assert max(score, key=score.get) == 99 and score[99] == 9.0
    assert {r.node: r.degree for r in network.degrees(e).collect()}[1] == 3
    assert {(r.a, r.b): r.jaccard for r in network.jaccard(e).collect()}[1, 2] == 0.25
    c = {r.node: r.component for r in components.connected_components(e, "a", "b").collect()}
    assert set(c.values()) == {1, 21} and c[13] == 1
    com = {r.node: r.community for r in network.communities(e).collect()}
    assert com[21] == com[22] == com[23] and com[1] == com[2] == com[3]
    steps = {r.node: r.depth for r in network.within_steps(e, 99, 2).collect()}
    assert steps == {99: 0, 1: 1, 11: 1, 2: 2, 3: 2, 12: 2, 13: 2}
    assert network.induced(e, network.within_steps(e, 99, 1)).count() == 2


def test_long_chain_and_empty_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3)], "src long, dst long")
    got = components.connected_components(e).collect()
    assert {r.component for r in got} == {0} and len(got) == 301
    assert components.connected_components(e.where("1 = 0")).count() == 0


def test_cooccurrence_cap(spark):
    rows = [(1, i) for i in range(21)] + [(2, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, m long")
    assert network.cooccurrence(df, "g", "m").count() == 3 and network.over_cap(df, "g", "m").count() == 1


def test_identity_fragment_and_decoy(spark):
    rows = [(1, "Ravi Kumar", 29, "M"), (2, "Ravi K", 30, "M"), (3, "Ravi Kumar S", 30, "M"), (4, "Suresh Babu", 24, "M"), (5, "Suresh Babu", 52, "M"), (6, "Ravi Kumar", 29, None), (7, None, 3, "M")]
    df = spark.createDataFrame(rows, "id long, name string, age int, gender string")
    got = identity.candidates(df).collect()
    assert {r.id for r in got} == {1, 2, 3} and len({r.cluster for r in got}) == 1
    top = identity.similar_people(df, "ravi kumar", age=29, gender="M").collect()
    assert top[0].id == 1 and 5 not in {r.id for r in top}


def test_planted_hotspot_and_border(spark):
    pts = [(i, 13.0 + (i % 8) * 1e-4, 77.5 + (i // 8) * 1e-4, "x") for i in range(40)] + [(100, 14.0, 77.0, "y"), (101, 13.0 + 7e-4 + 3e-3, 77.5, "x")]
    p = spark.createDataFrame(pts, "id long, lat double, lon double, kind string")
    got = {r.id: r.cluster for r in space.density_clusters(p, 350, 8).collect()}
    assert set(got) >= set(range(40)) and set(got.values()) == {0} and 100 not in got
    s = space.cluster_summary(p, space.density_clusters(p, 350, 8), "kind").first()
    assert s.n_points == len(got) and s.top_kind == "x"


def test_spike_is_critical(spark):
    day = dt.datetime(2026, 7, 1)
    rows = [("a", day - dt.timedelta(days=7 * w + k)) for w in range(10) for k in range(4)] + [("a", day - dt.timedelta(days=k % 14)) for k in range(22)] + [("b", day - dt.timedelta(days=7 * w)) for w in range(10)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    got = series.trend_alerts(df, ["k"], "ts").collect()
    assert [(r.k, r.severity) for r in got] == [("a", "critical")] and got[0].z >= 4
    assert series.forecast(series.window_features(df, ["k"], "ts")).where("available").count() == 0


def test_lexicon_precedence_and_similarity(spark):
    df = spark.createDataFrame([(1, "two men on a motorcycle carried a gold chain"), (2, "short"), (3, "no one was ever found there")], "id long, t string")
    lex = {"mobility": [("car", "car", 1, 0.7), ("motorcycle", "motorcycle", 2, 0.9)], "target": [("gold chain", "gold_chain", 1, 0.9)]}
    got = {r.id: r for r in attributes.extract(df, "t", lex).collect()}
    assert set(got) == {1, 3} and got[1].mobility.value == "motorcycle" and got[3].target.value == "UNKNOWN"
    assert df.select(attributes.offender_count(F.col("t")).alias("n")).first().n == 2
    v = spark.createDataFrame([(1, "a", "b", "UNKNOWN"), (2, "a", "b", "c"), (3, "a", "x", "c")], "id long, p string, q string, r string")
    assert [tuple(r) for r in attributes.similar_to(v, v.where("id = 1"), {"p": 1.0, "q": 3.0, "r": 1.0}, "id").collect()] == [(2, 2, 1.0)]


def test_forest_flags_the_odd_one(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(300)] + [(999, 60.0, -40.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.isolation for r in forest.isolation_scores(df, ["x", "y"], "id", trees=50).collect()}
    assert max(got, key=got.get) == 999 and got[999] > 0.6
    assert forest.isolation_scores(df.limit(5), ["x", "y"], "id").where("isolation is not null").count() == 0


def test_expressions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    assert abs(val(X.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111194.93) < 0.01
    assert val(X.severity(F.lit(3.6))) == "serious" and val(X.severity(F.lit(1.0))) is None
    assert val(X.hour_distance(F.lit(23), F.lit(1))) == 2 and val(X.percent_change(F.lit(15), F.lit(10))) == 50
    assert val(X.numbers_safe(F.lit("3 of 4"), F.lit("4 3 9"))) and not val(X.numbers_safe(F.lit("5"), F.lit("4")))
    alike = lambda a, b: val(X.name_similarity(F.lit(a), F.lit(b)))
    assert alike("ravi kumar", "ravi k") > 0.82 and alike("ravi kumar", "ravi shetty") == 0.3 and alike("ravi kumar", "ravi") == alike("ravi", "ravi shankar") == alike("ravi kumar s", "ravi shankar") == 0.3
    assert alike("ravi k", "ravi") == 1.0 and alike("anil rao", "ravi rao") == alike("", "ravi") == 0.0 and val(X.partial_similarity(F.lit("rav kum"), F.lit("ravi kumar"))) == 0.9


def test_loading_discipline(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    (tmp_path / "a.csv").write_text("id,v\n1,\n2,x\n")
    assert [tuple(r) for r in files.read_strict_csv(spark, str(tmp_path / "a.csv"), schema).collect()] == [(1, None), (2, "x")]
    (tmp_path / "b.csv").write_text("id,w\n1,\n")
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(tmp_path / "b.csv"), schema)
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, v string")
    old = spark.createDataFrame([(2,)], "id long")
    kept, n = tables.split_new_rows(new, old, "id")
    assert kept.count() == 1 and tuple(n.first()) == (4, 1, 3)
    walk = tables.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 77)], "id long, parent long"))
    got = {(r.id, r.ancestor): r.cycle for r in walk.collect()}
    assert got[1, 3] is False and got[4, 4] is True and not any(k[0] == 6 for k in got)
    assert tables.scoped(new, "id", new, "id", "v", None).count() == 0


def test_runs_and_evidence(spark, tmp_path):
    with governance.recorded_run(spark, str(tmp_path), "TRENDS") as run:
        run.emit("more cases", [1, 2], "modified z")
    with pytest.raises(RuntimeError):
        with governance.recorded_run(spark, str(tmp_path), "TRENDS") as run:
            run.emit("x", [1], "m")
            raise RuntimeError("no")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert {(r.status, r.record_count) for r in runs.collect()} == {("COMPLETED", 1), ("FAILED", 0)}
    assert governance.latest_run(runs, "TRENDS", None).count() == 1 and spark.read.parquet(f"{tmp_path}/evidence").count() == 1
    with pytest.raises(ValueError):
        governance.envelope(runs, "AI_DERIVED", "m", [])


def test_streaming_counts_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("velocity_counts").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM velocity_counts").first()[0] == e.count()


def test_names_without_a_surname_join_nobody(spark):
    rows = [(1, "Ravi", 30, "M"), (2, "Ravi Shankar", 30, "M"), (3, "Ravi Kumar S", 31, "M"), (4, "Ravi Kumar", 31, "M"), (5, "Ravi Kumar", 31, "M"), (6, "ravi kumar", 31, "M")]
    df = spark.createDataFrame(rows, "id long, name string, age int, gender string")
    got = identity.candidates(df).collect()
    assert {r.id for r in got} == {3, 4, 5, 6} and len({r.cluster for r in got}) == 1
    # all pairs, as the links stand for them: three of one name and age, each linked to the longer name
    assert {r.confidence for r in got} == {1.0}


def test_neighbours_at_any_latitude(spark):
    def pairs(points, eps=350):
        df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(points)], "id long, lat double, lon double")
        return {(r.a, r.b) for r in space.neighbour_pairs(df, eps).collect()}

    import math
    import random

    for lat in (0.0, 75.0, -75.0, 89.99, 60.0):
        for lon in (0.0, 10.0, 179.9999, -179.9999, 77.5012):
            step = min(180.0, math.degrees(328 / X.EARTH_M) / math.cos(math.radians(lat)))
            east = (lon + step + 180) % 360 - 180
            assert pairs([(lat, lon), (lat, east)]) == {(0, 1), (1, 0)}, (lat, lon)
    r = random.Random(4)
    points = [(r.uniform(74.9, 75.1), (179.8 + r.uniform(0, 0.4) + 180) % 360 - 180) for _ in range(150)] + [(89.999 + r.uniform(0, 0.001), r.uniform(-180, 180)) for _ in range(30)]

    def metres(p, q):
        (a, o), (b, u) = ([math.radians(v) for v in x] for x in (p, q))
        return 2 * X.EARTH_M * math.asin(math.sqrt(min(1.0, math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((u - o) / 2) ** 2)))

    want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if i != j and metres(p, q) <= 900}
    assert pairs(points, 900) == want and len(want) > 100


def test_long_paths_are_followed(spark):
    n = 64
    e = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "a long, b long, weight long")
    got = {r.node: r.betweenness for r in network.betweenness(e).collect()}
    assert got == {i: float(i * (n - 1 - i)) for i in range(n)}
    units = spark.createDataFrame([(i, i + 1 if i < 24 else None, 7 if i == 24 else None) for i in range(25)] + [(90, 91, None), (91, 90, None), (92, 555, 3)], "id long, parent long, district long")
    assert tables.ancestors(units).where("id = 0").count() == 24
    up = {r.id: (r.district, r.chain_length, r.cycle) for r in tables.inherited(units, ["district"]).collect()}
    assert up[0] == (7, 24, False) and up[24] == (7, 0, False) and up[90] == (None, 1, True) and up[92] == (3, 0, False)


def test_pivots_are_drawn_by_component(spark):
    parts = [(10 * k, 10 * k + j) for k in range(40) for j in (1, 2)] + [(1000 + i, 1001 + i) for i in range(30)]
    e = spark.createDataFrame([(a, b, 1) for a, b in parts], "a long, b long, weight long")
    got = {r.node: r.betweenness for r in network.betweenness(e, pivots=15, exact=10).collect()}
    assert all(got[10 * k] == 1.0 for k in range(40)) and got[1015] > 0


def test_communities_end_settled(spark):
    star = [(i, 100 + j, 1) for i in range(4) for j in range(5)]
    clique = [(a, b, 3) for a in range(200, 206) for b in range(200, a)] + [(200, 0, 1)]
    e = spark.createDataFrame(star + clique, "a long, b long, weight long")
    got = {r.node: r.community for r in network.communities(e).collect()}
    assert len({got[k] for k in range(200, 206)}) == 1 and len(got) == 15
    near = {}
    for a, b, w in star + clique:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for k, links in near.items():
        v = {}
        for x, w in links:
            v[got[x]] = v.get(got[x], 0) + w
        assert v.get(got[k], 0) == max(v.values())


def test_ranks_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 40).select(F.pmod(F.xxhash64("id"), F.lit(37)).alias("x"), "id")
    got = tables.ranked(df, [F.desc("x"), F.col("id")]).collect()
    assert [(r.x, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((r.x, r.id) for r in got), key=lambda v: (-v[0], v[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert tables.ranked(df.where("false"), [F.col("id")]).count() == 0


def test_one_target_only(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id long, p string, q string")
    with pytest.raises(ValueError):
        attributes.similar_to(df, df, {"p": 1.0, "q": 1.0}, "id")
    assert attributes.similar_to(df, df.where("id = 9"), {"p": 1.0, "q": 1.0}, "id").count() == 0


def test_replace_by_run_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    files.replace_by_run({"nodes": df, "edges": df}, f"{tmp_path}/g", "r1")
    files.replace_by_run({"nodes": df.limit(1), "edges": df}, f"{tmp_path}/g", "r2")
    assert files.read_current(spark, f"{tmp_path}/g", "nodes").count() == 1
    with pytest.raises(Exception):
        files.replace_by_run({"nodes": df, "edges": df.select((F.col("id") / F.raise_error(F.lit("no"))).alias("x"))}, f"{tmp_path}/g", "r3")
    assert {r.run_id for r in files.read_current(spark, f"{tmp_path}/g", "edges").collect()} == {"r2"}
    files.write_json(df, f"{tmp_path}/j", "m1")
    good, bad = files.read_versioned_json(spark, f"{tmp_path}/j", "id long, v string, model_version string", "m1", "v is not null")
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        files.read_versioned_json(spark, f"{tmp_path}/j", "id long, v string, model_version string", "m2", "true")


def test_districts_of_cases(spark):
    a = spark.createDataFrame([(1, 44), (1, 12), (1, 44), (2, None), (3, 9)], "case_id long, d long")
    got = tables.districts_of_cases(a, spark.createDataFrame([(1,), (2,), (7,)], "case_id long"), "case_id", "d").collect()
    assert [tuple(r) for r in got] == [(1, [12, 44])]


def test_crowded_cells_are_cut_into_blocks(spark):
    import random

    r = random.Random(5)
    points = [(12 + r.gauss(0, 0.0004), 77 + r.gauss(0, 0.0004)) for _ in range(500)] + [(12 + r.uniform(0, 0.02), 77 + r.uniform(0, 0.02)) for _ in range(100)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lon double")
    far = X.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    want = df.crossJoin(df.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))).where("id < b").where(far <= 60)
    want = {(x.id, x.b): x.m for x in want.select("id", "b", far.alias("m")).collect()}
    for block in (2048, 40, 7):
        got = space.close_pairs(df, 60, block).collect()
        assert len(got) == len(want) > 10_000 and {(x.a, x.b) for x in got} == set(want)
        assert all(abs(x.metres - want[x.a, x.b]) < 1e-4 for x in got)


def test_jaccard_by_packed_lists(spark, monkeypatch):
    import random

    r = random.Random(6)
    pairs = {tuple(sorted(r.sample(range(300), 2))) for _ in range(2500)} | {(5, k) for k in range(6, 250)} | {(7, 1 << 40), (1 << 40, 1 << 41), (-9, 7)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b): round(len(near[a] & near[b]) / len(near[a] | near[b]), 5) for a, b in pairs}
    e = spark.createDataFrame(sorted(pairs), "a long, b long")
    monkeypatch.setattr(network, "jaccard_by_cells", None)
    for links in (1 << 21, 500):
        monkeypatch.setattr(network, "LINKS", links)
        got = network.jaccard(e).collect()
        assert len(got) == len(pairs) and all(abs(x.jaccard - want[x.a, x.b]) < 2e-5 for x in got)


def test_jaccard_sends_lists_in_packed_rows_and_a_task_meets_two_blocks(spark, monkeypatch):
    """Ids without any locality: rows that travel are a few for each two blocks, not one for
    each node and block."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(7)
    pairs = sorted({tuple(sorted(r.sample(range(2000), 2))) for _ in range(20_000)})
    links = pairs + [(b, a) for a, b in pairs] + pairs[:500]  # repeats count once
    r.shuffle(links)
    links.sort(key=lambda x: x[0])
    parts = [links[k : k + 1000] for k in range(0, len(links), 1000)]
    batches = (pa.RecordBatch.from_arrays([pa.array([x[k] for x in p], pa.int64()) for k in (0, 1)], ["a", "b"]) for p in parts)
    lists = list(network._neighbour_lists(batches))
    assert sum(x.column(0)[0].as_py() for x in lists) == 2 * len(pairs)
    sent = list(network._to_blocks(np.array([500, 1000, 1500]))(pa.RecordBatch.from_arrays([x.column(3)], ["held"]) for x in lists))
    assert sum(x.num_rows for x in sent) <= 16 * len(lists) < 200
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    got = [row for x in network._shared_in_pairs(iter(sent)) for row in zip(*(c.to_pylist() for c in x.columns))]
    assert {(a, b): (k, n) for a, b, k, n in got} == {(a, b): (len(near[a] & near[b]), len(near[a] | near[b])) for a, b in pairs}
    assert len(got) == len(pairs)

    # what does not fit the packed lists goes by cells, whole
    by_cells, asked = network.jaccard_by_cells, []
    monkeypatch.setattr(network, "jaccard_by_cells", lambda e: asked.append(1) or by_cells(e))
    turned = spark.createDataFrame([(2, 1), (2, 3), (1, 3)], "a long, b long")
    assert {(x.a, x.b, x.jaccard) for x in network.jaccard(turned).collect()} == {(2, 1, 0.333333), (2, 3, 0.333333), (1, 3, 0.333333)}
    hub = spark.range(1, 60).selectExpr("0L as a", "id as b")
    monkeypatch.setattr(network, "MOST", 20)
    assert {x.jaccard for x in network.jaccard(hub).collect()} == {0.0} and len(asked) == 2


def test_points_of_a_place_travel_together(spark, monkeypatch):
    """Rows that are dealt to tasks grow with the places, not with points times blocks; ids
    may repeat, at one place or at several."""
    import random

    r = random.Random(8)
    places = [(12 + r.uniform(0, 0.001), 77 + r.uniform(0, 0.001)) for _ in range(12)]
    points = [(i, *places[0 if i < 300 else r.randrange(12)]) for i in range(1500)] + [(5, *places[0]), (6, *places[3]), (None, *places[1]), (7, None, 77.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    rows = []
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: rows.append(self.count()) or deal(self, *a))
    got = space.close_pairs(df, 60, digits=3).collect()
    assert len(rows) == 2 and sum(rows) < len(points) / 2
    far = X.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    other = df.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    want = df.join(other, F.col("id") < F.col("b")).where(far <= 60).select("id", "b", F.round(far, 3).alias("m")).collect()
    assert sorted((x.a, x.b, x.metres) for x in got) == sorted((x.id, x.b, x.m) for x in want)
    assert len(got) > 100_000 and min(x.metres for x in got) == 0
    # the same by cut cells
    cut = space.close_pairs(df, 60, 100, 3).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, got))
