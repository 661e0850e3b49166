"""Runs, evidence, envelopes and decisions: provenance of derived results."""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = "run_id string, kind string, scope string, status string, record_count long, error string, generated_at timestamp"
EVIDENCE = "run_id string, claim string, case_ids array<long>, method string, limitations array<string>"
CLASSES = ("FACT", "DERIVED_METRIC", "PREDICTION", "AI_DERIVED")


# Roles by precedence, scopes by breadth, who sees the whole state, and who
# may read the audit log.
ROLES = ("SYSTEM_ADMIN", "SCRB_STATE_ANALYST", "SUPERVISOR", "DISTRICT_ANALYST", "INVESTIGATOR")
SCOPES = ("STATE", "DISTRICT", "UNIT")
STATEWIDE, AUDIT_READERS = ROLES[:2], ROLES[:1]
DECISION = "target string, decision string, actor string, note string, decided_at timestamp"


@dataclass
class Run:
    kind: str
    scope: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "RUNNING"
    evidence: list[tuple] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)

    def emit(self, claim: str, case_ids: list[int], method: str, limitations: list[str] | None = None) -> None:
        if self.status != "RUNNING":
            raise ValueError("evidence belongs to a running run")
        if not case_ids and self.kind != "AREA_RISK":
            raise ValueError("evidence names its cases")
        self.evidence.append((self.run_id, claim, list(case_ids), method, limitations or []))


    def emit_all(self, claims: DataFrame) -> None:
        """``claims``: claim, case_ids, method; written as a frame, not through the driver."""
        if self.status != "RUNNING":
            raise ValueError("evidence belongs to a running run")
        named = claims if self.kind == "AREA_RISK" else claims.where("size(case_ids) > 0")
        self.frames.append(named.select(F.lit(self.run_id).alias("run_id"), "claim", F.col("case_ids").cast("array<long>").alias("case_ids"), "method", F.array().cast("array<string>").alias("limitations")))


@contextmanager
def recorded_run(spark: SparkSession, path: str, kind: str, scope: str | None = None):
    """Completed with its evidence, or failed without any; exceptions go on."""
    run, error, count = Run(kind, scope), None, 0
    try:
        yield run
        run.status = "COMPLETED"
        frames = run.frames + ([spark.createDataFrame(run.evidence, EVIDENCE)] if run.evidence else [])
        # evidence first, all of it in one write; a run is completed once its row says so
        if frames:
            reduce(DataFrame.unionByName, frames).write.mode("append").parquet(f"{path}/evidence")
            count = spark.read.parquet(f"{path}/evidence").where(F.col("run_id") == run.run_id).count()
    except Exception as e:
        run.status, error, count = "FAILED", str(e)[:500], 0
        raise
    finally:
        now = dt.datetime.now(dt.timezone.utc)
        spark.createDataFrame([(run.run_id, kind, scope, run.status, count, error, now)], RUN).write.mode("append").parquet(f"{path}/runs")


def completed_evidence(spark: SparkSession, path: str) -> DataFrame:
    """The evidence of completed runs only; what a run left that ended before its row was
    written belongs to no run and is not shown."""
    done = spark.read.schema(RUN).parquet(f"{path}/runs").where("status = 'COMPLETED'").select("run_id")
    return spark.read.schema(EVIDENCE).parquet(f"{path}/evidence").join(done, "run_id", "left_semi")


def latest_run(runs: DataFrame, kind: str, scope: str | None) -> DataFrame:
    """Newest completed run of a kind and scope; no scope is a scope of its own."""
    return runs.where((F.col("status") == "COMPLETED") & (F.col("kind") == kind) & F.col("scope").eqNullSafe(F.lit(scope))).orderBy(F.desc("generated_at"), F.desc("run_id")).limit(1)


def envelope(df: DataFrame, classification: str, method: str, limitations: list[str], model_version: str | None = None) -> DataFrame:
    if classification not in CLASSES or (classification == "AI_DERIVED" and not model_version):
        raise ValueError("classification unknown or without its model version")
    return df.withColumn("envelope", F.struct(F.lit(classification).alias("classification"), F.lit(method).alias("method"), F.array(*map(F.lit, limitations)).alias("limitations"), F.lit(model_version).cast("string").alias("model_version")))


def audit(events: DataFrame, role: str, event_type: str | None = None, actor: str | None = None, limit: int = 200) -> DataFrame:
    if role not in AUDIT_READERS:
        raise PermissionError("the role may not read the audit log")
    out = events if event_type is None else events.where(F.col("event_type") == event_type)
    out = out if actor is None else out.where(F.col("actor") == actor)
    return out.orderBy(F.desc("at"), F.desc("event_id")).limit(limit)


def effective_roles(assignments: DataFrame) -> DataFrame:
    """``assignments``: user_id, role, scope_type, scope_id. The one that holds for each
    user: first role by precedence, then the broadest scope, then the smallest id. Users
    without a valid one are absent, and what is absent is denied."""
    a = assignments.where(F.col("role").isin(*ROLES) & F.col("scope_type").isin(*SCOPES) & (F.col("scope_id").isNull() == (F.col("scope_type") == "STATE")))
    rank = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    best = a.groupBy("user_id").agg(F.min_by(F.struct("role", "scope_type", "scope_id"), F.struct(rank(ROLES, "role"), rank(SCOPES, "scope_type"), F.coalesce("scope_id", F.lit(-1)))).alias("r"))
    return best.select("user_id", "r.*").withColumn("statewide", (F.col("scope_type") == "STATE") | F.col("role").isin(*STATEWIDE))


def visible(rows: DataFrame, role: dict | None, district: str = "district_id", station: str = "station_id") -> DataFrame:
    """Rows that a role (a row of ``effective_roles``) may see: a unit's by station, a
    district's by district; without a role none."""
    if role is None:
        return rows.where("false")
    if role["statewide"]:
        return rows
    return rows.where(F.col(station if role["scope_type"] == "UNIT" else district) == role["scope_id"])


def decide(spark: SparkSession, path: str, target: str, decision: str, actor: str, note: str | None = None) -> None:
    """A decision is a row of a log; the latest of a target holds (``decisions``)."""
    spark.createDataFrame([(target, decision, actor, note, dt.datetime.now(dt.timezone.utc))], DECISION).write.mode("append").parquet(path)


def decisions(log: DataFrame) -> DataFrame:
    """The latest of each target; of equal times the last by decision, actor and note."""
    rest = [c for c in log.columns if c != "target"]
    order = F.struct("decided_at", "decision", "actor", F.coalesce("note", F.lit("")))
    return log.groupBy("target").agg(F.max_by(F.struct(*rest), order).alias("r")).select("target", "r.*")


def evidence_page(evidence: DataFrame, run_id: str, offset: int = 0, limit: int = 50, shown_cases: int = 25) -> DataFrame:
    """A run's evidence with a preview of its cases and their number."""
    e = evidence.where(F.col("run_id") == run_id).withColumn("n_cases", F.size("case_ids")).withColumn("case_ids", F.slice("case_ids", 1, shown_cases))
    return e.orderBy("claim", "method").offset(offset).limit(limit)
