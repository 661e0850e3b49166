"""The case analytics over the 26 case tables, one method for each question.

Every method returns DataFrames; nothing runs before an action, except where an iterative
operator (components, subgraph) says so.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import exprs as X
from ..operators import anomalies, association, attributes, forest, identity, network, regression, series, space, tables as T
from ..operators.projection import Projection
from ..session import materialize
from ..sources.files import read_strict_csv, write_csv
from ..sources.schemas import SPECS
from . import governance

NIGHT = (21, 22, 23, 0, 1, 2)
# The features in their order.
RISK_FEATURES = ["recent", "prior", "prior2", "velocity", "rolling_mean_3", "trend_slope", "month"]


# What analyses may see of persons.
ANALYTIC_VIEWS = {
    "accused": ("Accused", ["AccusedMasterID", "CaseMasterID", "AgeYear", "GenderID", "PersonID"]),
    "victim": ("Victim", ["VictimMasterID", "CaseMasterID", "AgeYear", "GenderID", "VictimPolice"]),
    "complainant": ("ComplainantDetails", ["ComplainantID", "CaseMasterID", "AgeYear", "GenderID"]),
    "employee": ("Employee", ["EmployeeID", "DistrictID", "UnitID", "RankID", "DesignationID"]),
}


class CaseTables:
    """The source tables of a folder: ``Name.csv`` (strict header, blanks are null) or
    ``Name.parquet``."""

    def __init__(self, spark: SparkSession, folder: str, form: str = "csv"):
        self.spark, self.folder, self.form, self._read = spark, folder.rstrip("/"), form, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._read:
            path, schema = f"{self.folder}/{name}.{self.form}", SPECS[name].schema
            if self.form == "csv":
                self._read[name] = read_strict_csv(self.spark, path, schema)
            else:
                self._read[name] = self.spark.read.parquet(path).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))
        return self._read[name]

    def lost_cells(self, name: str) -> DataFrame:
        """``column, n``: cells of a Parquet table that are not of their column's type and
        therefore read as null. (Strict CSV fails on such cells instead.)"""
        raw = self.spark.read.parquet(f"{self.folder}/{name}.{self.form}")
        lost = raw.agg(*(F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in SPECS[name].schema))
        return lost.unpivot([], lost.columns, "column", "n").where("n > 0")


class Engine:
    def __init__(self, spark: SparkSession, folder: str, form: str = "csv"):
        self.spark, self.tables = spark, CaseTables(spark, folder, form)

    # -- frames -----------------------------------------------------------------------

    @cached_property
    def cases(self) -> DataFrame:
        """One row a case with its lookups; what does not resolve is null. The head is the
        sub-head's, not the one the case names."""
        t = self.tables
        c = t("CaseMaster")

        def look(df, column, table, key, **keep):
            parent = t(table).select(F.col(key).alias("_k"), *(F.col(v).alias(k) for k, v in keep.items()))
            return df.join(parent, F.col(column) == F.col("_k"), "left").drop("_k")

        j = look(c, "CrimeMinorHeadID", "CrimeSubHead", "CrimeSubHeadID", head_id="CrimeHeadID", subhead_name="CrimeHeadName")
        j = look(j, "head_id", "CrimeHead", "CrimeHeadID", head_name="CrimeGroupName")
        j = look(j, "PoliceStationID", "Unit", "UnitID", station_name="UnitName", district_id="DistrictID")
        j = look(j, "district_id", "District", "DistrictID", district_name="DistrictName")
        j = look(j, "CaseCategoryID", "CaseCategory", "CaseCategoryID", category="LookupValue")
        j = look(j, "GravityOffenceID", "GravityOffence", "GravityOffenceID", gravity="LookupValue")
        j = look(j, "CaseStatusID", "CaseStatusMaster", "CaseStatusID", status="CaseStatusName")
        return j.select(
            F.col("CaseMasterID").alias("case_id"), F.col("CrimeNo").alias("crime_no"), F.col("CrimeMinorHeadID").alias("subhead_id"), "subhead_name", "head_id", "head_name",
            F.col("PoliceStationID").alias("station_id"), "station_name", "district_id", "district_name", "category", "gravity", "status",
            F.col("CrimeRegisteredDate").alias("registered_date"), F.col("IncidentFromDate").alias("incident_from"), "latitude", "longitude", F.col("BriefFacts").alias("narrative"),
        )

    @cached_property
    def people(self) -> DataFrame:
        """Accused and victims with the district of their case."""
        def role(name, table, key, text):
            return self.tables(table).select(F.lit(name).alias("role"), F.col(key).alias("record_id"), F.col("CaseMasterID").alias("case_id"), F.col(text).alias("name"), F.col("AgeYear").alias("age"), F.col("GenderID").alias("gender"))

        both = role("accused", "Accused", "AccusedMasterID", "AccusedName").unionByName(role("victim", "Victim", "VictimMasterID", "VictimName"))
        at = self.cases.select(F.col("case_id").alias("_case"), "district_id", "district_name")
        return both.join(at, F.col("case_id") == F.col("_case"), "left").drop("_case")

    def _filtered(self, subhead_id=None, district_id=None, station_id=None, date_from=None, date_to=None) -> DataFrame:
        given = {"subhead_id": subhead_id, "district_id": district_id, "station_id": station_id}
        return T.filtered(self.cases, {k: v for k, v in given.items() if v is not None}, "registered_date", date_from, date_to)

    # -- cases and persons ------------------------------------------------------------

    def case_page(self, offset: int = 0, limit: int = 100, located: bool = False, **filters) -> DataFrame:
        c = self._filtered(**filters)
        c = c.where("latitude is not null and longitude is not null") if located else c
        return T.page(c.withColumn("registered", F.date_format("registered_date", "yyyy-MM-dd")).withColumn("incident", F.date_format("incident_from", "yyyy-MM-dd HH:mm")).drop("narrative"), ["case_id"], offset, limit)

    def case_count(self, **filters) -> DataFrame:
        return self._filtered(**filters).agg(F.count("*").alias("n"))

    def case(self, case_id: int) -> tuple[DataFrame, DataFrame]:
        """The case, and the persons in it."""
        return self.cases.where(F.col("case_id") == case_id), self.people.where(F.col("case_id") == case_id)

    def subhead_consistency(self) -> DataFrame:
        """``case_id, consistent``: whether the head that a case names is its sub-head's; null
        where one of them is not known. A flag: nothing is corrected."""
        c = self.tables("CaseMaster").select(F.col("CaseMasterID").alias("case_id"), F.col("CrimeMajorHeadID").alias("named"), F.col("CrimeMinorHeadID").alias("sub"))
        heads = self.tables("CrimeSubHead").select(F.col("CrimeSubHeadID").alias("_s"), F.col("CrimeHeadID").alias("_h"))
        return c.join(heads, F.col("sub") == F.col("_s"), "left").select("case_id", (F.col("named") == F.col("_h")).alias("consistent"))

    def without_personal_data(self, role: str) -> DataFrame:
        """Accused, victims, complainants or employees as analyses may see them: numbers of
        records and places, age and gender; no names, birth dates, health or caste."""
        return self.tables(ANALYTIC_VIEWS[role][0]).select(*ANALYTIC_VIEWS[role][1])

    def person_index(self) -> DataFrame:
        """One row a record: ``role, person`` (digest of name, age and gender, nulls told from
        texts), the record, and ``others``: its further records. Persons with one name, age
        and gender may be different people: an association, not a fact. Members stay rows,
        so a common name is many rows and no long list."""
        p = self.people
        key = F.sha2(F.to_json(F.struct(F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("n"), "age", "gender"), {"ignoreNullFields": "false"}), 256)
        p = p.withColumn("person", key)
        n = p.groupBy(F.col("role").alias("_r"), F.col("person").alias("_p")).agg((F.count("*") - 1).alias("others"))
        return p.join(n, (F.col("role") == F.col("_r")) & (F.col("person") == F.col("_p"))).select("role", "person", "record_id", "case_id", "name", "age", "gender", "district_id", "district_name", "others")

    def person_members(self, role: str, record_id: int) -> DataFrame:
        """All records of the person of one record, with what a list shows of their cases."""
        index = self.person_index().where(F.col("role") == role)
        asked = index.where(F.col("record_id") == record_id).select(F.col("person").alias("_p"))
        cases = self.cases.select(F.col("case_id").alias("_c"), "crime_no", "subhead_name", "registered_date", "status")
        return index.join(asked, F.col("person") == F.col("_p"), "left_semi").join(cases, F.col("case_id") == F.col("_c"), "left").drop("_c").orderBy("record_id")

    def complainants(self, case_id: int) -> DataFrame:
        """Without religion, caste and occupation, which no analysis may use."""
        return self.tables("ComplainantDetails").where(F.col("CaseMasterID") == case_id).select("ComplainantID", "CaseMasterID", "ComplainantName", "AgeYear", "GenderID")

    def person(self, name: str, age: int | None, gender: str | None) -> DataFrame:
        """Records of one exact identity; a missing age or gender equals a missing one."""
        p = self.people
        return p.where((F.lower(F.trim("name")) == name.strip().lower()) & F.col("age").eqNullSafe(F.lit(age)) & F.col("gender").eqNullSafe(F.lit(gender))).orderBy("role", "record_id")

    def ranked_persons(self, limit: int = 50, offset: int = 0) -> DataFrame:
        p = self.people.where("role = 'accused' and trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("key"), "age", "gender")
        g = p.agg(F.min_by("name", "record_id").alias("name"), F.array_join(F.array_sort(F.collect_set("district_name")), ",").alias("districts"), F.countDistinct("case_id").alias("n_cases"))
        return g.orderBy(F.desc("n_cases"), "key", "age", "gender").offset(offset).limit(limit)

    def similar_persons(self, name: str, age: int | None = None, gender: str | None = None, limit: int = 50) -> DataFrame:
        p = self.people.where("role = 'accused'").groupBy("name", "age", "gender").agg(F.min("record_id").alias("id"))
        return identity.similar_people(p, name, age, gender, limit, partial=age is None and not gender)

    def identities(self, district_id=None, min_size: int = 2) -> DataFrame:
        p = self.people.where("role = 'accused'")
        p = p if district_id is None else p.where(F.col("district_id").cast("string") == str(district_id))
        found = identity.candidates(p.select(F.col("record_id").alias("id"), "name", "age", "gender"), min_size)
        return found.withColumn("status", F.lit("pending_review"))

    def arrest_districts(self, cases: DataFrame) -> DataFrame:
        """``case_id, districts`` of the asked cases (column case_id)."""
        a = self.tables("ArrestSurrender").select(F.col("CaseMasterID").alias("case_id"), F.col("ArrestSurrenderDistrictId").alias("district_id"))
        return T.districts_of_cases(a, cases, "case_id", "district_id")

    def units(self) -> DataFrame:
        """``UnitID, DistrictID, StateID, chain_length, cycle``: what a unit lacks it has from
        its nearest ancestor; a state still missing is its district's."""
        u = T.inherited(self.tables("Unit"), ["DistrictID", "StateID"], "UnitID", "ParentUnit")
        d = self.tables("District").select(F.col("DistrictID").alias("_d"), F.col("StateID").alias("_s"))
        return u.join(d, F.col("DistrictID") == F.col("_d"), "left").withColumn("StateID", F.coalesce("StateID", "_s")).drop("_d", "_s")

    # -- analytics --------------------------------------------------------------------

    def hotspots(self, subhead_id=None, district_id=None, days: int | None = None, eps_m: float = 400, min_samples: int = 8) -> tuple[DataFrame, DataFrame]:
        """Ranked clusters, and the cases in them."""
        c = self._filtered(subhead_id=subhead_id, district_id=district_id).where("latitude is not null and longitude is not null")
        if days is not None:
            newest = c.agg(F.max("registered_date").alias("newest"))
            c = c.crossJoin(F.broadcast(newest)).where(F.col("registered_date") >= F.date_sub("newest", days)).drop("newest")
        points = c.select(F.col("case_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("subhead_name").alias("kind"), "district_id", "station_id", F.hour("incident_from").alias("hour"))
        members = materialize(space.density_clusters(points, eps_m, min_samples))
        m = members.join(points, "id")
        more = m.groupBy("cluster").agg(
            F.mode("district_id", True).alias("district_id"), F.mode("station_id", True).alias("station_id"),
            F.round(F.sum(F.col("hour").isin(*NIGHT).cast("int")) / F.count("*"), 3).alias("night_share"),
            F.array(*(F.sum(F.when(F.col("hour") == h, 1).otherwise(0)) for h in range(24))).alias("hours"),
        )
        summary = space.cluster_summary(points, members, "kind").join(more, "cluster")
        return T.ranked(summary, [F.desc("n_points"), F.col("cluster")]), members.withColumnRenamed("id", "case_id")

    def trends(self, level: str = "station", subhead_id=None, district_id=None, **options) -> DataFrame:
        if level not in ("station", "subhead"):
            raise ValueError("level is station or subhead")
        keys = ["station_id", "subhead_id"] if level == "station" else ["subhead_id"]
        found = series.trend_alerts(self._filtered(subhead_id=subhead_id, district_id=district_id), keys, "registered_date", **options)
        return T.ranked(found, [F.desc("z"), *(F.col(k) for k in keys)])

    def anomaly_cases(self) -> DataFrame:
        n = self.tables("Accused").groupBy(F.col("CaseMasterID").alias("_case")).agg(F.count("*").alias("n"))
        levels = T.ranked(self.tables("GravityOffence").select(F.col("LookupValue").alias("_g")).dropna().distinct(), [F.col("_g")], "gravity_rank")
        c = self.cases.join(n, F.col("case_id") == F.col("_case"), "left").join(levels, F.col("gravity") == F.col("_g"), "left")
        return c.select(F.col("case_id").alias("id"), F.col("registered_date").alias("ts"), F.col("station_id").alias("place"), F.col("subhead_id").alias("kind"), F.coalesce("n", F.lit(0)).cast("int").alias("accused"), F.hour(F.coalesce("incident_from", F.col("registered_date").cast("timestamp_ntz"))).alias("hour"), F.coalesce("gravity_rank", F.lit(0)).alias("gravity_rank"))

    def anomalies(self, window_days: int = 30, min_score: float = 2.5, max_flags: int = 25, confirm: bool = True) -> DataFrame:
        """Flags; ``confirm`` adds whether an isolation forest of all history agrees."""
        c = self.anomaly_cases()
        flags = anomalies.anomaly_flags(c, window_days, min_score, max_flags)
        if not confirm:
            return flags
        features = ["accused", "hour", "gravity_rank"]
        usual = c.agg(F.median("hour").alias("usual"))
        x = c.crossJoin(F.broadcast(usual)).withColumn("hour", F.coalesce("hour", "usual"))
        flags = materialize(flags)
        asked = x.join(flags.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
        scored = forest.isolation_scores(asked, features, "id", history=x).select(F.col("id").alias("_id"), (F.coalesce("isolation", F.lit(0.0)) > 0.5).alias("ml_confirmed"))
        return flags.join(scored, F.col("id") == F.col("_id"), "left").drop("_id")

    def risk_features(self, window_days: int = 30) -> DataFrame:
        return series.window_features(self.cases.where("district_id is not null"), ["district_id", "district_name"], "registered_date", window_days)

    def risk_training(self, window_days: int = 30) -> DataFrame:
        f = self.risk_features(window_days)
        return f.crossJoin(F.broadcast(f.agg(F.max("w").alias("last")))).where("w >= 1 and w <= last - 2").drop("last")

    def risk_forecast(self, predictor=None, window_days: int = 30) -> DataFrame:
        return series.forecast(self.risk_features(window_days), predictor)

    def export_risk_training(self, path: str, window_days: int = 30) -> None:
        """Features in their fixed order and the target as CSV, nothing that names a district."""
        write_csv(self.risk_training(window_days), path, [*RISK_FEATURES, "target"])

    def train_risk(self, path: str, version: str, window_days: int = 30) -> regression.LinearModel:
        """Fits the forecast's own model and keeps it in the model table at ``path``."""
        model = regression.fit(self.risk_training(window_days), RISK_FEATURES, "target", version)
        regression.save(self.spark, model, path)
        return model

    def risk_predictor(self, path: str, version: str | None = None):
        """For ``risk_forecast`` and ``risk_reasons``; None without such a model."""
        model = regression.load(self.spark, path, version)
        return None if model is None else regression.predictor(model)

    def districts(self, window_days: int = 30) -> DataFrame:
        return series.group_velocity(self.cases.where("district_id is not null"), ["district_id", "district_name"], "registered_date", window_days).orderBy(F.desc("n_rows"), "district_id")

    def summary(self) -> DataFrame:
        return self.cases.agg(F.count("*").alias("n_cases"), F.min("registered_date").alias("first"), F.max("registered_date").alias("last"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct("district_id").alias("n_districts"), F.array_sort(F.collect_set("status")).alias("statuses"))

    def charts(self) -> DataFrame:
        """``chart, label, n``: cases by district, by status, the ten commonest kinds, and
        the accused by band of age."""
        c = self.cases

        def count(df: DataFrame, chart: str, label: Column) -> DataFrame:
            return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(chart).alias("chart"), "label", "n")

        unknown = F.lit("Unknown")
        kinds = count(c, "kind", F.coalesce("subhead_name", unknown)).orderBy(F.desc("n"), "label").limit(10)
        parts = [count(c.where("district_name is not null"), "district", F.col("district_name")), count(c, "status", F.coalesce("status", unknown)), kinds, count(self.people.where("role = 'accused'"), "age", X.band(F.col("age")))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def overview(self, top: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Summary, tally of alerts by severity, the strongest alerts and hotspots."""
        alerts = materialize(self.trends().drop("rank"))
        order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "serious", 1).otherwise(2)
        spots, _ = self.hotspots(days=90)
        return self.summary(), alerts.groupBy("severity").agg(F.count("*").alias("n")), alerts.orderBy(order, F.desc("z"), "station_id", "subhead_id").limit(top), spots.where(F.col("rank") <= top)

    # -- narratives -------------------------------------------------------------------

    def profiles(self, signals: DataFrame | None = None) -> DataFrame:
        """``signals``: ``case_id, mentions`` (phrases that an outside text service saw)."""
        if signals is None:
            return attributes.profiles(self.cases, "case_id", "narrative")
        seen = signals.groupBy(F.col("case_id").alias("_c")).agg(F.array_distinct(F.flatten(F.collect_list("mentions"))).alias("mentions"))
        return attributes.profiles(self.cases.join(seen, F.col("case_id") == F.col("_c"), "left"), "case_id", "narrative", mentions="mentions")

    def similar_cases(self, case_id: int, limit: int = 20) -> DataFrame:
        v = attributes.profile_values(self.profiles(), "case_id")
        found = attributes.similar_to(v, v.where(F.col("case_id") == case_id), attributes.WEIGHTS, "case_id")
        return found.orderBy(F.desc("score"), F.desc("matched"), "case_id").limit(limit)

    def profile_coverage(self) -> DataFrame:
        return attributes.unknown_rates(attributes.profile_values(self.profiles(), "case_id"), [*attributes.PHRASES, "offender_count"])

    def profile_page(self, text: str | None = None, offset: int = 0, limit: int = 50, **values) -> DataFrame:
        v = attributes.profile_values(self.profiles(), "case_id").join(self.cases.select("case_id", "narrative"), "case_id")
        v = T.filtered(v, {k: x for k, x in values.items() if x is not None})
        if text:
            v = v.where(F.contains(F.col("case_id").cast("string"), F.lit(text.lower())) | F.contains(F.lower("narrative"), F.lit(text.lower())))
        return T.page(v.withColumn("preview", F.substring("narrative", 1, 160)).drop("narrative"), ["case_id"], offset, limit)

    # -- graph ------------------------------------------------------------------------

    @cached_property
    def graph(self) -> Projection:
        return Projection(self.tables)

    @cached_property
    def nodes(self) -> DataFrame:
        """The graph's nodes, built once; ``edges`` likewise."""
        return materialize(self.graph.nodes())

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(self.graph.edges())

    def metrics(self, extra_pairs: DataFrame | None = None) -> DataFrame:
        """Of accused records that share a case; ``extra_pairs`` (a, b, case_id) adds others."""
        a = self.tables("Accused")
        pairs = network.cooccurrence_by_group(a, "CaseMasterID", "AccusedMasterID").select("a", "b", F.col("g").alias("case_id"))
        return network.graph_metrics(pairs if extra_pairs is None else pairs.unionByName(extra_pairs))

    def _in_scope(self, district_id=None, station_id=None) -> DataFrame:
        """Edges with ``_mine``: whether their case is of the district and of the station."""
        mine = self.cases.select(F.col("case_id").alias("_case"), F.lit(True).alias("_mine"), "district_id", "station_id")
        mine = T.filtered(mine, {k: v for k, v in (("district_id", district_id), ("station_id", station_id)) if v is not None}).select("_case", "_mine")
        return self.edges.join(mine, F.col("case_id") == F.col("_case"), "left").drop("_case")

    def subgraph(self, seed: str, depth: int = 2, limit: int = 500, district_id=None, station_id=None):
        """Nodes, edges and stubs around a node; without a scope all cases are in sight."""
        if not 0 <= depth <= 2 or not 1 <= limit <= 500:
            raise ValueError("depth is 0 to 2, limit 1 to 500")
        nodes, edges, stubs = network.subgraph(self._in_scope(district_id, station_id), seed, depth, limit, F.col("_mine"))
        return nodes.join(self.nodes, F.col("node") == F.col("node_id"), "left").select("node", "node_type", "label", "depth", "place"), edges.drop("_mine"), stubs

    def node_detail(self, node: str, district_id=None, station_id=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The node, its edges in scope by type, and their cases. Out of scope: all empty."""
        e = self._in_scope(district_id, station_id).where(F.col("_mine") & ((F.col("src") == node) | (F.col("dst") == node)))
        n = self.nodes.where(F.col("node_id") == node).join(e.select(F.lit(node).alias("_n")).distinct(), F.col("node_id") == F.col("_n"), "left_semi")
        return n, e.groupBy("edge_type").agg(F.count("*").alias("n")), e.select("case_id").distinct()

    @cached_property
    def _clusters(self) -> DataFrame:
        """Identity clusters of all accused, resolved once."""
        return materialize(self.identities().select("id", "cluster"))

    def associations(self, case_id: int, focus: str | None = None, limit: int = 40, offset: int = 0, **filters) -> DataFrame:
        """Edges of the overview, or with ``focus`` of one entity's related cases too."""
        if focus is None:
            return association.seed_edges(self.cases, self.people, case_id)
        same = self._clusters if focus.startswith("ACCUSED_RECORD:") else self.spark.createDataFrame([], "id long, cluster string")
        return association.expanded_edges(self.cases, self.people, same, case_id, focus, limit, offset, **filters)

    # -- runs with their evidence -------------------------------------------------------

    def recorded(self, path: str, analytic: str, **options) -> DataFrame:
        """Runs ``trends``, ``hotspots``, ``anomalies``, ``identities``, ``area_risk``, ``profiles``
        or ``metrics`` as a recorded run: one row of evidence for each finding, with the cases
        it rests on, joined and written by Spark. Returns the findings."""
        makers = {
            "trends": self._trend_evidence, "hotspots": self._hotspot_evidence, "anomalies": self._anomaly_evidence, "identities": self._identity_evidence,
            "area_risk": self._risk_evidence, "profiles": self._profile_evidence, "metrics": self._metric_evidence,
        }
        maker = makers[analytic]
        with governance.recorded_run(self.spark, path, analytic.upper()) as run:
            found, evidence = maker(**options)
            run.emit_all(evidence)
        return found

    def _trend_evidence(self, level: str = "station", **options) -> tuple[DataFrame, DataFrame]:
        keys = ["station_id", "subhead_id"] if level == "station" else ["subhead_id"]
        found = materialize(self.trends(level, **options))
        recent = series.with_latest(self.cases, "registered_date").where(F.col("days_ago") < 7 * options.get("recent_weeks", 2))
        cases = recent.join(found.select(*keys, "z", "recent_total", "median"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"), F.first("z").alias("z"), F.first("recent_total").alias("recent_total"), F.first("median").alias("median"))
        claim = F.format_string("%s: %d recent cases where %.1f a week are usual (z %.2f)", F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), "recent_total", "median", "z")
        return found, cases.select(claim.alias("claim"), "case_ids", F.lit("modified z of weekly counts").alias("method"))

    def _hotspot_evidence(self, **options) -> tuple[DataFrame, DataFrame]:
        found, members = self.hotspots(**options)
        found = materialize(found)
        cases = members.groupBy("cluster").agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"))
        claim = F.format_string("%d cases within %.0f m of (%.4f, %.4f), mostly %s", "n_points", "radius_m", "lat", "lon", "top_kind")
        return found, cases.join(found, "cluster").select(claim.alias("claim"), "case_ids", F.lit("density clusters").alias("method"))

    def _anomaly_evidence(self, **options) -> tuple[DataFrame, DataFrame]:
        found = materialize(self.anomalies(**options))
        return found, found.select(F.col("reason").alias("claim"), F.col("ids").alias("case_ids"), F.lit("robust baselines").alias("method"))

    def _identity_evidence(self, **options) -> tuple[DataFrame, DataFrame]:
        found = materialize(self.identities(**options))
        people = self.people.where("role = 'accused'").select(F.col("record_id").alias("id"), "case_id", "name")
        cases = found.join(people, "id").groupBy("cluster", "confidence").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        claim = F.format_string("possibly one person: %s (%.3f)", "names", "confidence")
        return found, cases.select(claim.alias("claim"), "case_ids", F.lit("blocked name and age scores").alias("method"))

    def _risk_evidence(self, predictor=None, **options) -> tuple[DataFrame, DataFrame]:
        """A district's reasons, with its six newest cases."""
        found = materialize(self.risk_reasons(predictor, **options))
        newest = Window.partitionBy("district_id").orderBy(F.desc("registered_date"), F.desc("case_id"))
        cases = self.cases.where("district_id is not null and registered_date is not null").withColumn("k", F.row_number().over(newest)).where("k <= 6")
        cases = cases.groupBy(F.col("district_id").alias("_d")).agg(F.array_sort(F.collect_list("case_id")).alias("case_ids"))
        claim = F.concat_ws("; ", F.col("district_name"), F.array_join("reasons", "; "))
        j = found.join(cases, F.col("district_id") == F.col("_d"), "left")
        return found, j.select(claim.alias("claim"), F.coalesce("case_ids", F.array().cast("array<long>")).alias("case_ids"), F.lit("window features").alias("method"))

    def _profile_evidence(self, signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """What was read out of each narrative."""
        found = materialize(self.profiles(signals))
        v = attributes.profile_values(found, "case_id")
        said = F.array_compact(F.array(*(F.when(F.col(c) != attributes.UNKNOWN, F.concat(F.lit(f"{c}: "), F.col(c))) for c in v.columns if c != "case_id")))
        return found, v.where(F.size(said) > 0).select(F.array_join(said, ", ").alias("claim"), F.array("case_id").alias("case_ids"), F.lit("stated phrases").alias("method"))

    def _metric_evidence(self) -> tuple[DataFrame, DataFrame]:
        """What is said of a node, with the cases of the record."""
        found = materialize(self.metrics())
        cases = self.tables("Accused").select(F.col("AccusedMasterID").alias("_n"), F.col("CaseMasterID").alias("case_id"))
        claim = F.format_string("%s: %s (degree %d, betweenness %.6f)", F.col("node").cast("string"), "interpretation", "degree", "betweenness")
        j = found.where("interpretation is not null").join(cases, F.col("node") == F.col("_n"))
        return found, j.select(claim.alias("claim"), F.array("case_id").alias("case_ids"), F.lit("case association graph").alias("method"))

    def risk_reasons(self, predictor=None, window_days: int = 30) -> DataFrame:
        """The forecast with ``reasons``: what moves a district's expectation, in sentences,
        and ``confidence`` (level and basis)."""
        f = self.risk_forecast(predictor, window_days)
        recent = series.with_latest(self.cases, "registered_date")
        days = F.col("days_ago")
        top = recent.where((days < window_days) & F.col("subhead_name").isNotNull()).groupBy("district_id", "subhead_name").agg(F.count("*").alias("n"))
        top = top.groupBy("district_id").agg(F.min_by("subhead_name", F.struct(-F.col("n"), "subhead_name")).alias("top_kind"))
        active = recent.groupBy("district_id").agg(F.countDistinct(F.floor(days / window_days)).alias("active"))
        j = f.join(top, "district_id", "left").join(active, "district_id", "left")
        # The sentences, and the bounds of what they call a change.
        ahead, moved = X.percent_change(F.col("expected"), F.col("recent")), X.percent_change(F.col("recent"), F.col("prior"))
        window = F.lit(f"the last {window_days} days")
        forecast = F.when(F.col("expected").isNull(), None).when(ahead >= 10, F.concat(F.lit("Forecast up "), ahead, F.lit("% vs "), window)).when(ahead <= -10, F.concat(F.lit("Forecast down "), -ahead, F.lit("% vs "), window)).otherwise(F.concat(F.lit("Forecast steady vs "), window))
        change = F.when((F.col("prior") > 0) & (F.abs(moved) >= 10), F.concat(F.lit("Cases "), F.when(moved > 0, "rose ").otherwise("fell "), F.abs(moved), F.lit("% over the previous 30 days")))
        count = F.concat(F.col("recent"), F.lit(" cases in "), window)
        kind = F.when(F.col("top_kind").isNotNull(), F.concat(F.lit("Most frequent recent offence: "), F.col("top_kind")))
        level = F.when((F.col("active") >= 6) & (F.col("recent") >= 10), "high").when((F.col("active") >= 3) & (F.col("recent") >= 3), "medium").otherwise("low")
        basis = F.concat(F.coalesce("active", F.lit(0)), F.lit(" active periods of history, "), F.col("recent"), F.lit(" recent cases"))
        return j.select(*f.columns, F.array_compact(F.array(forecast, change, count, kind)).alias("reasons"), F.struct(level.alias("level"), basis.alias("basis")).alias("confidence"))

    # -- quality ----------------------------------------------------------------------

    def data_quality(self) -> DataFrame:
        """``table, column, check, value``: rows, repeated keys, null rates, dangling references."""
        out = None
        for name, spec in SPECS.items():
            df = self.tables(name)
            sums = [F.count("*").cast("double").alias("rows")] + [F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias(f"null {c}") for c, _ in spec.columns]
            if spec.key:
                sums.append((F.count(spec.key) - F.countDistinct(spec.key)).cast("double").alias(f"repeated {spec.key}"))
            one = df.agg(*sums)
            parts = [one.unpivot([], one.columns, "check", "value")]
            for column, parent in spec.references:
                key = SPECS[parent].key
                if key:
                    gone = T.dangling(df, column, self.tables(parent), key).agg(F.sum("n_rows").cast("double").alias("value"))
                    parts.append(gone.select(F.lit(f"dangling {column}").alias("check"), "value"))
            for p in parts:
                p = p.where("value > 0 or check = 'rows'").select(F.lit(name).alias("table"), "check", "value")
                out = p if out is None else out.unionByName(p)
        return out
