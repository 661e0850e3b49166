"""Keyed and monthly tables read what they must and no more; streamed alerts equal the batch's."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalens.functions import exprs as X
from stratalens.operators import network, series, substring
from stratalens.plans import governance
from stratalens.sources import files, keyed
from stratalens.streaming import trends


def plan(df):
    spark, auto = df.sparkSession, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(auto)
    spark.conf.set(auto, "false")  # the planner names the buckets it reads only then
    try:
        again = df.select("*")
        return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(again._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(auto, before)


def test_adjacency_reads_the_buckets_of_its_nodes(spark, tmp_path):
    r = random.Random(1)
    edges = [(f"e{i}", f"n{r.randrange(200)}", f"n{r.randrange(200)}") for i in range(600)] + [("z1", "n3", "n3"), ("z2", "n3", "hub")] + [(f"h{i}", "hub", f"n{i}") for i in range(150)]
    df = spark.createDataFrame(edges, "edge_id string, src string, dst string")
    store = keyed.Adjacency(df, str(tmp_path), 16)
    found = plan(store.around(["n3"]))
    assert "SelectedBucketsCount: 1 out of 16" in found and "PushedFilters" in found
    many = spark.range(200).select(F.concat(F.lit("n"), "id").alias("a")).hint("merge")
    assert plan(store.ends.join(many, "a")).count("Exchange") == 2  # once in the tree, once explained: the other side's
    for seed, depth, limit in (("n3", 2, 40), ("n7", 1, 500), ("hub", 2, 100), ("nobody", 2, 10), ("n3", 0, 5)):
        nodes, among = store.subgraph(seed, depth, limit)
        want, inside, _ = network.subgraph(df, seed, depth, limit)
        assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, among.collect())) == sorted(map(tuple, inside.collect()))
    with pytest.raises(ValueError):
        store.around([str(i) for i in range(1001)])


def test_substring_index_finds_what_contains_finds(spark, tmp_path):
    r = random.Random(2)
    texts = [(i, "".join(r.choice("abAB cé") for _ in range(r.choice((0, 2, 30, 200))))) for i in range(400)] + [(900, None), (901, "Needle in HAYSTACK"), (901, "Needle in HAYSTACK")]
    df = spark.createDataFrame(texts, "id long, text string")
    index = substring.build(df, "id", "text", str(tmp_path), 16)
    for needle in ("needle", "aba", "AbA c", "é b", "ab", "", "zzz", "b" * 4):
        got = sorted(x.id for x in substring.search(df, index, "id", "text", needle).collect())
        assert got == sorted(i for i, t in texts if t is not None and needle.lower() in t.lower())
    assert re.search(r"SelectedBucketsCount: [12] out of 16", plan(substring.candidates(index, "need")))
    assert substring.candidates(index, "ab") is None


def test_substring_index_takes_time_linear_in_a_text(spark, tmp_path):
    import time

    r = random.Random(3)
    long = "".join(chr(r.choice((97, 233, 0x4E2D, 0x1F600)) + r.randrange(20)) for _ in range(400_000))
    df = spark.createDataFrame([("a", long), ("b", long[:200_000]), ("c", None)], "id string, text string")
    began = time.time()
    index = substring.build(df, "id", "text", str(tmp_path), 4)
    assert [x.id for x in substring.search(df, index, "id", "text", long[300_000:300_040]).collect()] == ["a"]
    assert time.time() - began < 60  # a square of the length takes hours
    whole = index.where(F.array_contains("keys", "a")).agg(F.countDistinct("gram")).first()[0]
    assert whole == len({long.lower()[i : i + 3] for i in range(len(long) - 2)})


def test_monthly_tables_prune(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    rows = [(i, day + dt.timedelta(hours=7 * i)) for i in range(2000)] + [(9000, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    files.write_by_month(df, str(tmp_path / "m"), "ts")
    got = files.read_range(spark, str(tmp_path / "m"), "ts", "2025-03-10", "2025-05-01")
    assert sorted(x.id for x in got.collect()) == [i for i, t in rows if t and dt.datetime(2025, 3, 10) <= t < dt.datetime(2025, 5, 1)]
    text = plan(got)
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 2025-03-01[^\]]*month#\d+ <= 2025-05-01", text) or re.search(r"PartitionFilters: \[[^\]]*month", text)
    newest = max(t for _, t in rows if t).date()
    recent = files.recent_rows(spark, str(tmp_path / "m"), "ts", 45)
    assert sorted(x.id for x in recent.collect()) == [i for i, t in rows if t and (newest - t.date()).days < 45]
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= ", plan(recent))
    assert spark.read.parquet(str(tmp_path / "m")).where("month is null").count() == 1
    files.write_by_month(df.limit(0), str(tmp_path / "e"), "ts")


def test_rounding_equals_python(spark):
    r = random.Random(3)
    values = [r.uniform(-1000, 1000) for _ in range(40000)] + [r.uniform(0, 1) * 10 ** r.randint(-9, 9) for _ in range(20000)]
    values += [k / 1000 + 0.0005 for k in range(-10000, 10000)] + [k / 8 for k in range(-10000, 10000)] + [round(r.uniform(-50, 50), 3) for _ in range(20000)] + [0.0, -0.0, 2.675, 1.005, 0.5, 1.5, 2.5, 1e300, float(2**52), 0.1 + 0.2]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    for digits in (0, 1, 2, 3, 4, 6):
        got = df.select("i", X.round_half_even(F.col("x"), digits).alias("v")).collect()
        bad = [(values[g.i], g.v, round(values[g.i], digits)) for g in got if g.v != round(values[g.i], digits)]
        assert not bad, bad[:5]
    assert spark.range(1).select(X.round_half_even(F.lit(None).cast("double"), 2).alias("v")).first().v is None


def test_runs_leave_no_evidence_when_they_fail(spark, tmp_path):
    path = str(tmp_path / "p")
    good = spark.createDataFrame([("a", [1, 2], "m")], "claim string, case_ids array<long>, method string")
    broken = good.withColumn("claim", F.raise_error(F.lit("no")).cast("string"))
    with governance.recorded_run(spark, path, "TRENDS") as run:
        run.emit_all(good)
    with pytest.raises(Exception):
        with governance.recorded_run(spark, path, "TRENDS") as bad:
            bad.emit_all(good)
            bad.emit_all(broken)
    assert {r.run_id for r in spark.read.parquet(f"{path}/evidence").collect()} == {run.run_id}
    # evidence of a run that ended before its row was written is not shown
    good.select(F.lit("lost").alias("run_id"), "claim", "case_ids", "method", F.array().cast("array<string>").alias("limitations")).write.mode("append").parquet(f"{path}/evidence")
    assert {r.run_id for r in governance.completed_evidence(spark, path).collect()} == {run.run_id}


def test_a_failed_replacement_can_be_tried_again(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    path = str(tmp_path)
    files.replace_by_run({"t": one}, path, "r1")
    with pytest.raises(Exception):
        files.replace_by_run({"t": two, "u": two.select(F.raise_error(F.lit("no")).cast("long").alias("id"))}, path, "r2")
    assert files.read_current(spark, path, "t").count() == 3
    files.replace_by_run({"t": two}, path, "r2")
    assert files.read_current(spark, path, "t").count() == 5
    with pytest.raises(ValueError):
        files.replace_by_run({"t": one}, path, "r2")


SERIES = "place string, kind int, ts timestamp"


def arrivals():
    """Batches of rows by time of arrival: steady series, one spike, rows up to ten days late."""
    r, rows = random.Random(6), []
    start = dt.datetime(2025, 1, 2, tzinfo=dt.timezone.utc)
    for day in range(150):
        for place in "abcd":
            n = 1 + (place == "a") + (4 if place == "b" and 90 <= day < 104 else 0)
            rows += [(place, r.randrange(2), start + dt.timedelta(days=day, hours=r.uniform(0, 24)), r.uniform(0, 10)) for _ in range(n)]
    rows += [("short", 1, start + dt.timedelta(days=20, hours=k), 0.0) for k in range(9)] + [(None, 1, start, 0.0)]
    rows.sort(key=lambda x: x[2] + dt.timedelta(days=x[3]))
    return [[x[:3] for x in rows[i : i + 150]] for i in range(0, len(rows), 150)]


def test_streamed_alerts_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    spark.conf.set(*trends.STATE_STORE)
    batches = arrivals()
    (tmp_path / "in").mkdir()

    def write(k, rows):
        spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")

    def run():
        stream = spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in/*")
        found = trends.streamed_alerts(stream, ["place", "kind"], "ts", "11 days", min_z=1.5)
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    half = len(batches) // 2
    for k in range(half):
        write(k, batches[k])
    run()
    early = spark.read.parquet(f"{tmp_path}/out").count()
    for k in range(half, len(batches)):
        write(k, batches[k])
    write(len(batches), [("end", 0, dt.datetime(2025, 9, 1, tzinfo=dt.timezone.utc))])
    run()
    got = sorted((r.place, r.kind, r.week_end, r.recent_total, r.median, r.mad, r.z, r.severity, tuple(r.weekly)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows = spark.createDataFrame([x for b in batches for x in b], SERIES)
    want, end = [], dt.date(2025, 1, 9)
    while end < dt.date(2025, 8, 20):
        batch = series.trend_alerts(rows, ["place", "kind"], "ts", min_z=1.5, as_of=end - dt.timedelta(days=1))
        want += [(r.place, r.kind, end, r.recent_total, r["median"], r.mad, r.z, r.severity, tuple(r.weekly)) for r in batch.collect()]
        end += dt.timedelta(days=7)
    assert got == sorted(want) and 0 < early < len(got) and any(g[0] == "b" and g[7] == "critical" or g[7] == "serious" for g in got)
