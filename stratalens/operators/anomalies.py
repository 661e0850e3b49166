"""Point anomalies of recent cases against baselines of the whole history.

Three signals: more accused than the kind of case has, an hour far from the usual one, and
a kind of case that is rare at its place. Baselines are grouped aggregates; recent rows
meet them in equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import hour_distance, modified_z, severity
from .series import rare_pairs

MAX_IDS = 10


def count_baseline(df: DataFrame, group: str, value: str, min_n: int = 10) -> DataFrame:
    med = df.groupBy(group).agg(F.median(value).alias("median"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    mad = df.join(med, group).groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return med.join(mad, group).drop("n")


def hour_baseline(df: DataFrame, keys: list[str], hour: str, min_n: int = 8, floor: float = 1.5) -> DataFrame:
    """``keys, centre, sigma`` on the clock of 24 hours."""
    d, turn = df.where(F.col(hour).isNotNull()), 2 * 3.141592653589793 / 24
    mean = d.groupBy(*keys).agg(F.count("*").alias("n"), F.atan2(F.round(F.avg(F.sin(F.col(hour) * turn)), 9), F.round(F.avg(F.cos(F.col(hour) * turn)), 9)).alias("t")).where(F.col("n") >= min_n)
    mean = mean.select(*keys, F.round(F.pmod(F.col("t") / turn, F.lit(24.0)), 6).alias("centre"))
    far = d.join(mean, keys).groupBy(*keys).agg(F.median(hour_distance(F.col(hour), F.col("centre"))).alias("mad"))
    return mean.join(far, keys).select(*keys, "centre", F.greatest(1.4826 * F.col("mad"), F.lit(floor)).alias("sigma"))


def anomaly_flags(cases: DataFrame, window_days: int = 30, min_score: float = 2.5, max_flags: int = 25) -> DataFrame:
    """``cases``: id, ts, place, kind, accused, hour. Flags with their dominant signal, the
    strongest first. Rare kinds at one place are one flag that lists up to ten cases."""
    c = cases.where("ts is not null and place is not null")
    newest = c.agg(F.max(F.to_date("ts")).alias("newest"))
    recent = c.crossJoin(F.broadcast(newest)).where(F.to_date("ts") > F.date_sub("newest", window_days)).drop("newest")
    by_kind = hour_baseline(c, ["kind"], "hour").withColumnsRenamed({"centre": "centre_kind", "sigma": "sigma_kind"})
    rare = rare_pairs(c, "place", "kind").select("place", "kind", "observed", "expected", F.col("z").alias("rare_z"))
    j = recent.join(count_baseline(c, "kind", "accused"), "kind", "left").join(hour_baseline(c, ["place", "kind"], "hour"), ["place", "kind"], "left").join(by_kind, "kind", "left").join(rare, ["place", "kind"], "left")
    centre = F.coalesce("centre", "centre_kind")
    many = F.round(modified_z(F.col("accused"), F.col("median"), F.col("mad")), 2)
    odd = F.round(hour_distance(F.col("hour"), centre) / F.coalesce("sigma", "sigma_kind"), 2)

    def signal(name, order, score, reason):
        return F.when(score >= min_score, F.struct(F.lit(order).alias("order"), (-score).alias("minus"), F.lit(name).alias("signal"), score.alias("score"), reason.alias("reason")))

    signals = F.array_sort(F.array_compact(F.array(
        signal("many_accused", 0, many, F.format_string("%d accused where %.1f are usual", "accused", F.round("median", 1))),
        signal("odd_hour", 0, odd, F.format_string("at %d hours, usually near %.1f", "hour", F.round(centre, 1))),
        signal("rare_offence", 1, F.round("rare_z", 2), F.format_string("%d at this place where %.1f are expected", "observed", F.round("expected", 1))),
    )))
    hit = j.withColumn("signals", signals).where(F.size("signals") > 0)
    top = F.get("signals", F.lit(0))
    hit = hit.select("id", "place", "kind", top["signal"].alias("signal"), top["score"].alias("score"), F.array_join(F.transform("signals", lambda s: s["reason"]), "; ").alias("reason"))
    points = hit.where("signal <> 'rare_offence'").withColumn("ids", F.array("id"))
    group = hit.where("signal = 'rare_offence'")
    # a row number with a bound is cut in every task before the shuffle
    some = group.withColumn("k", F.row_number().over(Window.partitionBy("place", "kind").orderBy("id"))).where(F.col("k") <= MAX_IDS)
    some = some.groupBy("place", "kind").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    merged = group.groupBy("place", "kind").agg(F.min("id").alias("id"), F.max("score").alias("score"), F.min("reason").alias("reason")).join(some, ["place", "kind"])
    flags = points.unionByName(merged.withColumn("signal", F.lit("rare_offence")))
    best = flags.orderBy(F.desc("score"), "id").limit(max_flags)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "place", "kind", "signal", "score", severity(F.col("score")).alias("severity"), "reason", "ids")
