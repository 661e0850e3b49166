"""The case tables as a graph of nodes and edges, with counts of what dangles.

Every part is a select over one table with lookups on parents; parts are unioned and nodes
are distinct by id, which decides all their columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .network import cooccurrence_by_group

PAIR_CAP = 20


def node_ref(kind: str, column: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), column.cast("string"))


class Projection:
    """``tables``: name -> DataFrame of the source tables, typed as their schemas say."""

    def __init__(self, tables):
        self.nodes_, self.edges_, self.skips_ = [], [], []
        self.tables = tables
        self._build()

    def _node(self, df: DataFrame, kind: str, column: str, label: Column) -> None:
        ref = F.col(column).cast("string")
        self.nodes_.append(df.where(F.col(column).isNotNull()).select(node_ref(kind, F.col(column)).alias("node_id"), F.lit(kind).alias("node_type"), ref.alias("entity_ref_id"), label.alias("label")))

    def _edge(self, df: DataFrame, rel: str, src: Column, dst: Column, derived: bool = False) -> None:
        said = ("CASE_CO_OCCURRENCE", "DERIVED_METRIC") if derived else ("OBSERVED_FK", "FACT")
        self.edges_.append(df.select(F.lit(rel).alias("edge_type"), src.alias("src"), dst.alias("dst"), F.col("case_id"), F.lit(said[0]).alias("derivation"), F.lit(said[1]).alias("classification")))

    def _skip(self, df: DataFrame, name: str) -> None:
        self.skips_.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("skipped"), "n"))

    def _lookup(self, df: DataFrame, column: str, table: str, key: str, keep: tuple[str, ...], skipped: str) -> DataFrame:
        """Rows whose reference resolves, with the parent's columns; the others are counted."""
        have = df.where(F.col(column).isNotNull())
        parent = self.tables(table).select(F.col(key).alias("_key"), *keep)
        self._skip(have.join(parent.select("_key"), F.col(column) == F.col("_key"), "left_anti"), skipped)
        return have.join(parent, F.col(column) == F.col("_key"))

    def _build(self) -> None:
        t = self.tables
        cases = t("CaseMaster").select(F.col("CaseMasterID").alias("case_id"), "PoliceStationID", "CrimeMajorHeadID", "CrimeMinorHeadID")
        known, case = cases.select(F.col("case_id").alias("_case")), node_ref("CASE", F.col("case_id"))
        named = lambda column, text, key: F.coalesce(F.nullif(F.col(column), F.lit("")), F.concat(F.lit(f"{text} "), F.col(key).cast("string")))
        self._node(cases, "CASE", "case_id", F.concat(F.lit("Case "), F.col("case_id").cast("string")))
        at = self._lookup(cases, "PoliceStationID", "Unit", "UnitID", ("UnitName", "DistrictID"), "REGISTERED_AT:station")
        self._node(at, "POLICE_STATION", "PoliceStationID", named("UnitName", "Unit", "PoliceStationID"))
        self._edge(at, "REGISTERED_AT", case, node_ref("POLICE_STATION", F.col("PoliceStationID")))
        area = self._lookup(at.drop("_key"), "DistrictID", "District", "DistrictID", ("DistrictName",), "OCCURRED_IN:district")
        self._node(area, "DISTRICT", "DistrictID", named("DistrictName", "District", "DistrictID"))
        self._edge(area, "OCCURRED_IN", case, node_ref("DISTRICT", F.col("DistrictID")))
        for column, table, name, kind, text, skipped in (("CrimeMajorHeadID", "CrimeHead", "CrimeGroupName", "CRIME_HEAD", "Crime head", "head"), ("CrimeMinorHeadID", "CrimeSubHead", "CrimeHeadName", "CRIME_SUBHEAD", "Crime sub-head", "subhead")):
            head = self._lookup(cases, column, table, f"{table}ID", (name,), f"CLASSIFIED_AS:{skipped}")
            self._node(head, kind, column, named(name, text, column))
            self._edge(head, "CLASSIFIED_AS", case, node_ref(kind, F.col(column)))
        people = {}
        for table, key, kind, rel, text in (("Accused", "AccusedMasterID", "ACCUSED_RECORD", "ACCUSED_IN", "Accused record"), ("Victim", "VictimMasterID", "VICTIM_RECORD", "VICTIM_IN", "Victim record")):
            rows = t(table).select(F.col(key).alias("person"), F.col("CaseMasterID").alias("case_id"))
            joined = rows.join(known, (F.col("case_id") == F.col("_case")) & F.col("person").isNotNull(), "left")
            self._skip(joined.where("_case is null"), f"{rel}:case")
            people[kind] = ok = joined.where("_case is not null").drop("_case")
            self._node(ok, kind, "person", F.concat(F.lit(f"{text} "), F.col("person").cast("string")))
            self._edge(ok, rel, node_ref(kind, F.col("person")), case)
        pairs = cooccurrence_by_group(people["ACCUSED_RECORD"], "case_id", "person", PAIR_CAP).withColumnRenamed("g", "case_id")
        self._edge(pairs, "SHARES_CASE_WITH", node_ref("ACCUSED_RECORD", F.col("a")), node_ref("ACCUSED_RECORD", F.col("b")), True)
        laws = t("ActSectionAssociation").select(F.col("CaseMasterID").alias("case_id"), F.concat_ws(":", F.col("ActID").cast("string"), F.col("SectionID").cast("string")).alias("law"), (F.col("ActID").isNotNull() & F.col("SectionID").isNotNull()).alias("whole"), "ActID", "SectionID")
        laws = laws.join(known, (F.col("case_id") == F.col("_case")) & F.col("whole"), "left")
        self._skip(laws.where("_case is null"), "LINKED_TO_SECTION")
        laws = laws.where("_case is not null")
        self._node(laws, "SECTION", "law", F.format_string("Act %s Sec %s", F.col("ActID").cast("string"), F.col("SectionID").cast("string")))
        self._edge(laws, "LINKED_TO_SECTION", case, node_ref("SECTION", F.col("law")))
        arrests = t("ArrestSurrender").select(F.col("CaseMasterID").alias("case_id"), F.col("AccusedMasterID").alias("person"), "PoliceStationID", "CourtID")
        arrests = arrests.join(known, (F.col("case_id") == F.col("_case")) & F.col("person").isNotNull(), "left")
        self._skip(arrests.where("_case is null"), "ARRESTED_IN:case_or_accused")
        arrests, who = arrests.where("_case is not null").drop("_case"), people["ACCUSED_RECORD"].select(F.col("person").alias("_who")).distinct()
        self._skip(arrests.join(who, F.col("person") == F.col("_who"), "left_anti"), "ARRESTED_IN:unknown_accused")
        arrests = arrests.join(who, F.col("person") == F.col("_who"), "left_semi")
        for column, table, key, name, kind, rel, text, skipped in (("PoliceStationID", "Unit", "UnitID", "UnitName", "POLICE_STATION", "ARRESTED_IN", "Unit", "station"), ("CourtID", "Court", "CourtID", "CourtName", "COURT", "PRODUCED_AT", "Court", "court")):
            place = self._lookup(arrests, column, table, key, (name,), f"{rel}:{skipped}")
            self._node(place, kind, column, named(name, text, column))
            self._edge(place, rel, node_ref("ACCUSED_RECORD", F.col("person")), node_ref(kind, F.col(column)))

    def nodes(self) -> DataFrame:
        """``node_id, node_type, entity_ref_id, label``; labels carry no names of persons."""
        return reduce(DataFrame.unionByName, self.nodes_).dropDuplicates(["node_id"])

    def edges(self) -> DataFrame:
        """``edge_id, edge_type, src, dst, case_id, derivation, classification``."""
        e = reduce(DataFrame.unionByName, self.edges_)
        return e.withColumn("edge_id", F.concat_ws("|", "edge_type", "src", "dst", F.col("case_id").cast("string"))).dropDuplicates(["edge_id"])

    def skips(self) -> DataFrame:
        """``skipped, n``: references that lead nowhere, by name."""
        return reduce(DataFrame.unionByName, self.skips_).where("n > 0")

    def limitations(self) -> DataFrame:
        """Cases with more accused than give pairs."""
        accused = self.tables("Accused").select(F.col("CaseMasterID").alias("case_id"), F.col("AccusedMasterID").alias("person"))
        return accused.dropna().distinct().groupBy("case_id").agg(F.count("*").alias("members")).where(F.col("members") > PAIR_CAP)
