"""The engine over planted case tables: what was planted is found, decoys are not."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import anomalies, association, network
from stratalens.plans import governance
from stratalens.plans.engine import Engine
from stratalens.sources import planted
from stratalens.sources.schemas import SPECS

BACKGROUND = 3000
HOT_IDS = set(range(BACKGROUND + 1, BACKGROUND + 61))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cases"))
    planted.write_planted(spark, folder, BACKGROUND)
    return Engine(spark, folder, "parquet")


def test_tables_and_schemas(engine):
    assert len(SPECS) == 26 and [n for n, s in SPECS.items() if s.key is None] == ["ActSectionAssociation", "Section", "CrimeHeadActSection"]
    n = engine.case_count().first().n
    assert n == BACKGROUND + 60 + 104 + 22 + 6 and engine.cases.count() == n
    assert engine.case_page(0, 5, located=True, district_id=44).count() == 5
    row, people = engine.case(n)
    assert row.first().station_id == planted.ODD["unit"] and people.where("role = 'accused'").count() == 6
    assert not {"ReligionID", "CasteID", "OccupationID"} & set(engine.complainants(1).columns)


def test_csv_gives_the_same_tables(spark, engine, tmp_path):
    for name in ("CaseMaster", "Unit"):
        engine.tables(name).write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    other = Engine(spark, str(tmp_path))
    for name in ("CaseMaster", "Unit"):
        assert other.tables(name).exceptAll(engine.tables(name)).isEmpty() and other.tables(name).count() == engine.tables(name).count()


def test_hotspot(engine):
    spots, members = engine.hotspots(subhead_id=71, days=90, eps_m=350)
    top = spots.where("rank = 1").first()
    ids = {r.case_id for r in members.where(F.col("cluster") == top.cluster).collect()}
    assert len(ids & HOT_IDS) >= 54 and len(ids - HOT_IDS) <= 6
    assert top.night_share >= 0.8 and top.station_id == 4430 and sum(top.hours) == top.n_points
    assert engine.hotspots(subhead_id=35, days=90, eps_m=350)[0].count() == 0


def test_trend_anomaly_and_overview(engine):
    first = engine.trends().where("rank = 1").first()
    assert (first.station_id, first.subhead_id, first.severity) == (4430, 71, "critical") and first.z >= 4
    flags = {r.id: r for r in engine.anomalies(max_flags=200).collect()}
    odd = flags[engine.case_count().first().n]
    assert odd.signal == "many_accused" and odd.ml_confirmed and odd.score >= 2.5
    summary, tally, alerts, spots = engine.overview()
    assert summary.first().n_districts == 12 and tally.where("severity = 'critical'").first().n >= 1
    assert alerts.first().subhead_id == 71 and spots.count() <= 5
    assert engine.risk_forecast().where("available").count() == 0 and engine.risk_training().count() > 12
    assert engine.districts().count() == 12 and {r.chart for r in engine.charts().collect()} == {"district", "status", "kind", "age"}


def test_rare_flags_are_merged(spark):
    rows = [(i, "2026-01-01", f"p{i % 3}", "k", 1, 12) for i in range(300)] + [(1000 + i, "2026-06-30", "p9", "other", 1, 12) for i in range(60)] + [(2000 + i, "2026-06-30", "p9", "k", 1, 12) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, ts string, place string, kind string, accused int, hour int").withColumn("ts", F.col("ts").cast("date"))
    got = anomalies.anomaly_flags(df).collect()
    assert [(r.signal, r.id, r.place, r.kind, r.ids) for r in got] == [("rare_offence", 2000, "p9", "k", list(range(2000, 2010)))]


def test_identities_and_persons(engine):
    found = engine.identities()
    named = found.join(engine.people.where("role = 'accused'"), F.col("id") == F.col("record_id"))
    ravi = named.where("name like 'Ravi %'").collect()
    assert len(ravi) == 3 and len({r.cluster for r in ravi}) == 1 and ravi[0].status == "pending_review"
    assert named.where("name = 'Suresh Babu'").count() == 0
    assert engine.person(" suresh babu", 24, "M").count() == 1
    assert engine.similar_persons("Ravi Kumar", 29, "M").first().name == "Ravi Kumar"
    top = engine.ranked_persons(5).collect()
    assert [r.n_cases for r in top] == sorted((r.n_cases for r in top), reverse=True)


def test_associations(engine):
    n = engine.case_count().first().n
    ravi = engine.people.where("name = 'Ravi Kumar'").first()
    e = engine.associations(ravi.case_id).collect()
    assert {x.rel for x in e} >= {"REGISTERED_AT", "OCCURRED_IN", "CLASSIFIED_AS", "ACCUSED_IN"}
    more = engine.associations(ravi.case_id, f"ACCUSED_RECORD:{ravi.record_id}").where("rel = 'SAME_IDENTITY'").collect()
    assert len(more) == 2 and {x.weight for x in more} == {1.0}
    place = engine.associations(n, "CRIME_SUBHEAD:71", limit=10, station_id=4430, date_from="2026-06-17").where("dst = 'CRIME_SUBHEAD:71' and weight < 1")
    assert place.count() == 10 and {x.weight for x in place.collect()} == {0.35}
    assert association.passing(engine.cases, engine.people, name_contains="suresh", age_max=30).count() == 1
    assert engine.associations(-5).count() == 0


def test_profiles(engine):
    p = engine.profiles().where(F.col("case_id").between(BACKGROUND + 1, BACKGROUND + 25))
    row = p.first()
    assert p.count() == 25 and row.mobility.value == "motorcycle" and row.crime_action.value == "snatching" and row.target_type.value == "gold_chain"
    assert row.offender_count.value == "2" and row.escape_direction.value == "the ring road" and row.approach_method.value == "mobile_approach"
    near = engine.similar_cases(BACKGROUND + 1, 50).collect()
    assert {r.case_id for r in near if r.score == 1.0} == set(range(BACKGROUND + 2, BACKGROUND + 26))
    assert engine.profile_page("gold chain", mobility="motorcycle").count() == 25
    assert engine.profile_coverage().first().mobility > 0.9


def test_graph(engine):
    kinds = {r.edge_type for r in engine.edges.select("edge_type").distinct().collect()}
    assert kinds == {"REGISTERED_AT", "OCCURRED_IN", "CLASSIFIED_AS", "ACCUSED_IN", "VICTIM_IN", "SHARES_CASE_WITH", "LINKED_TO_SECTION", "ARRESTED_IN", "PRODUCED_AT"}
    assert engine.graph.skips().count() == 0
    n = engine.case_count().first().n
    assert engine.edges.where(f"edge_type = 'SHARES_CASE_WITH' and case_id = {n}").count() == 15
    nodes, edges, stubs = engine.subgraph(f"CASE:{n}", 2, 12)
    assert nodes.count() == 12 and nodes.where("place = 0").first().node == f"CASE:{n}" and stubs.where("more_edges > 0").count() > 0
    nodes, edges, stubs = engine.subgraph(f"CASE:{n}", 1, 500, district_id=12)
    assert nodes.count() == 1 and edges.count() == 0 and stubs.first().cross_scope > 6
    node, types, cases = engine.node_detail(f"CASE:{n}")
    assert node.count() == 1 and cases.count() == 1 and {r.edge_type: r.n for r in types.collect()}["ACCUSED_IN"] == 6
    assert engine.node_detail(f"CASE:{n}", district_id=12)[0].count() == 0


def test_metrics_of_the_bridge_world(spark):
    rows = [(1, 2, 201), (1, 3, 201), (2, 3, 201), (11, 12, 202), (11, 13, 202), (12, 13, 202), (99, 1, 7), (99, 11, 8), (21, 22, 203), (21, 23, 203), (22, 23, 203)]
    got = {r.node: r for r in network.graph_metrics(spark.createDataFrame(rows, "a long, b long, case_id long")).collect()}
    assert all(got[k].artifact and got[k].interpretation == network.ARTIFACT for k in (21, 22, 23))
    assert {k for k, r in got.items() if r.interpretation == network.BRIDGE} == {1, 11, 99}
    assert not got[99].artifact and got[99].betweenness == 0.6 and got[1].degree == 3 and got[1].co_occurrences == 3


def test_data_quality(engine):
    got = {(r.table, r.check): r.value for r in engine.data_quality().collect()}
    assert got["CaseMaster", "dangling CourtID"] == 5 and ("CaseMaster", "repeated CaseMasterID") not in got
    assert abs(got["CaseMaster", "null latitude"] - 0.04) < 0.015 and abs(got["Victim", "null AgeYear"] - 0.08) < 0.02
    assert got["Unit", "rows"] == 36 and ("Accused", "dangling CaseMasterID") not in got


def test_roles_and_decisions(spark, tmp_path):
    rows = [("u", "INVESTIGATOR", "UNIT", 7), ("u", "SUPERVISOR", "UNIT", 9), ("u", "SUPERVISOR", "DISTRICT", 44), ("v", "SYSTEM_ADMIN", "STATE", None), ("w", "GUEST", "STATE", None), ("x", "INVESTIGATOR", "UNIT", None)]
    got = {r.user_id: r for r in governance.effective_roles(spark.createDataFrame(rows, "user_id string, role string, scope_type string, scope_id int")).collect()}
    assert set(got) == {"u", "v"} and (got["u"].scope_type, got["u"].scope_id) == ("DISTRICT", 44) and got["v"].statewide
    df = spark.createDataFrame([(44, 1), (12, 2)], "district_id int, station_id int")
    assert governance.visible(df, None).count() == 0 and governance.visible(df, got["v"].asDict()).count() == 2 and governance.visible(df, got["u"].asDict()).count() == 1
    for d in ("ACCEPTED", "REJECTED"):
        governance.decide(spark, f"{tmp_path}/d", "id-1", d, "u")
    assert [r.decision for r in governance.decisions(spark.read.parquet(f"{tmp_path}/d")).collect()] == ["REJECTED"]
    with pytest.raises(PermissionError):
        governance.audit(df, "SUPERVISOR")


def test_analytics_leave_evidence(spark, engine, tmp_path):
    for name, options in (("trends", {}), ("anomalies", {"confirm": False}), ("identities", {}), ("hotspots", {"subhead_id": 71, "days": 90, "eps_m": 350})):
        found = engine.recorded(str(tmp_path), name, **options)
        run = governance.latest_run(spark.read.parquet(f"{tmp_path}/runs"), name.upper(), None).first()
        rows = governance.evidence_page(spark.read.parquet(f"{tmp_path}/evidence"), run.run_id, limit=10_000).collect()
        assert run.record_count == len(rows) > 0 and all(r.n_cases > 0 and r.claim for r in rows), name
        if name != "identities":
            assert len(rows) == found.count()
    assert any("Ravi K, Ravi Kumar, Ravi Kumar S" in r.claim for r in spark.read.parquet(f"{tmp_path}/evidence").collect())


def test_risk_reasons(engine):
    got = engine.risk_reasons(lambda f: f.withColumn("expected", F.col("recent") * 2.0)).collect()
    assert len(got) == 12 and all(r.reasons[0].startswith("Forecast up 100% vs the last 30 days") for r in got if r.recent)
    assert all(f"{r.recent} cases in the last 30 days" in r.reasons and r.confidence.level in ("high", "medium", "low") for r in got)
    assert all(not x.startswith("Forecast") for r in engine.risk_reasons().collect() for x in r.reasons)


def test_units_and_arrest_districts(engine):
    got = engine.units().collect()
    assert len(got) == 36 and all(r.StateID == 29 and r.chain_length == 0 and not r.cycle for r in got)
    asked = engine.cases.where("district_id = 44").select("case_id")
    found = engine.arrest_districts(asked).collect()
    assert found and all(r.districts == [44] for r in found)


def test_evidence_of_risk_profiles_and_metrics(engine, tmp_path):
    path = str(tmp_path / "runs")
    n = {a: engine.recorded(path, a).count() for a in ("area_risk", "profiles", "metrics")}
    assert n["area_risk"] == 12 and n["profiles"] > 0
    shown = governance.completed_evidence(engine.spark, path)
    risk = shown.where("method = 'window features'").collect()
    assert len(risk) == 12 and all(0 < len(r.case_ids) <= 6 and "recent" not in r.claim[:3] for r in risk)
    assert shown.where("method = 'stated phrases'").count() > 0 and shown.where("size(case_ids) = 0").count() == 0


def test_risk_model_views_and_members(engine, spark, tmp_path):
    assert engine.risk_predictor(str(tmp_path / "m")) is None
    model = engine.train_risk(str(tmp_path / "m"), "2026-1")
    got = engine.risk_forecast(engine.risk_predictor(str(tmp_path / "m"))).collect()
    assert model.rows > 12 and len(got) == 12 and all(r.available and r.expected >= 0 and r.level for r in got)
    engine.export_risk_training(str(tmp_path / "csv"))
    table = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert table.columns == ["recent", "prior", "prior2", "velocity", "rolling_mean_3", "trend_slope", "month", "target"] and table.count() == engine.risk_training().count()
    for role in ("accused", "victim", "complainant", "employee"):
        assert not {c for c in engine.without_personal_data(role).columns if "Name" in c or "KGID" in c or "DOB" in c}
    flags = {r.consistent for r in engine.subhead_consistency().select("consistent").distinct().collect()}
    assert flags <= {True, False, None} and True in flags
    one = engine.person_index().where("others > 0 and role = 'accused'").first()
    if one is not None:
        members = engine.person_members("accused", one.record_id).collect()
        assert len(members) == one.others + 1 and len({(m.name.strip().lower(), m.age, m.gender) for m in members}) == 1
    v = engine.profiles().where("crime_action.start is not null").first()
    text = engine.cases.where(F.col("case_id") == v.case_id).first().narrative.strip()
    phrase = text[v.crime_action.start : v.crime_action.end]
    seen = engine.profiles(spark.createDataFrame([(v.case_id, [phrase.upper(), ""])], "case_id long, mentions array<string>")).where(F.col("case_id") == v.case_id).first()
    assert abs(seen.crime_action.confidence - min(0.95, v.crime_action.confidence + 0.05)) < 1e-9
