"""Trends, window features and baselines over groups of dated rows.

All are grouped aggregates with map-side combination; the one global value each needs (the
newest date) is a one-row aggregate joined back. Baselines of groups are joined without a
hint: Spark broadcasts them while they are small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import hour_distance, modified_z, severity


def with_latest(df: DataFrame, ts: str, as_of: dt.date | None = None) -> DataFrame:
    """Adds ``days_ago``: whole days to the newest row's date. ``as_of`` puts another date in
    its place; later rows are left out."""
    day = F.to_date(ts)
    if as_of is not None:
        return df.where(day <= F.lit(as_of)).withColumn("latest", F.lit(as_of)).withColumn("days_ago", F.datediff("latest", day))
    latest = df.agg(F.max(day).alias("latest"))
    return df.where(F.col(ts).isNotNull()).crossJoin(F.broadcast(latest)).withColumn("days_ago", F.datediff("latest", day))


def group_velocity(df: DataFrame, keys: list[str], ts: str, window_days: int = 30) -> DataFrame:
    """Counts in the last window and the one before (strict bounds), and their ratio."""
    d = F.col("days_ago")
    out = with_latest(df, ts).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum((d < window_days).cast("long")).alias("recent"), F.sum(((d >= window_days) & (d < 2 * window_days)).cast("long")).alias("prior"))
    return out.withColumn("velocity", F.round(F.col("recent") / F.when(F.col("prior") > 0, F.col("prior")), 2))


def dense_counts(df: DataFrame, keys: list[str], ts: str, days: int, n: int, as_of: dt.date | None = None) -> DataFrame:
    """``keys, counts``: rows per step back from the newest date, zeros included."""
    step = F.floor(F.col("days_ago") / days).cast("int")
    g = with_latest(df, ts, as_of).withColumn("step", step).where(F.col("step") < n).groupBy(*keys, "step").agg(F.count("*").alias("n"))
    m = g.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", F.col("n").cast("long")))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("counts"))


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def trend_alerts(df: DataFrame, keys: list[str], ts: str, baseline_weeks: int = 8, recent_weeks: int = 2, min_z: float = 2.5, min_recent: int = 5, as_of: dt.date | None = None) -> DataFrame:
    """Series whose recent weekly mean stands above the median of the baseline weeks."""
    df = df.dropna(subset=keys)
    s = dense_counts(df, keys, ts, 7, baseline_weeks + recent_weeks, as_of)
    base = F.transform(F.slice("counts", recent_weeks + 1, baseline_weeks), lambda x: x.cast("double"))
    s = s.withColumn("recent_total", F.aggregate(F.slice("counts", 1, recent_weeks), F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("median", array_median(base))
    s = s.withColumn("mad", array_median(F.transform(base, lambda x: F.abs(x - F.col("median")))))
    s = s.withColumn("z", F.round(modified_z(F.col("recent_total") / recent_weeks, F.col("median"), F.col("mad")), 2))
    s = s.where((F.col("recent_total") >= min_recent) & (F.col("z") >= min_z))
    pct = F.round((F.col("recent_total") / recent_weeks - F.col("median")) / F.when(F.col("median") > 0, F.col("median")) * 100, 1)
    return s.select(*keys, "recent_total", "median", "mad", "z", pct.alias("pct_change"), severity(F.col("z")).alias("severity"), F.reverse("counts").alias("weekly"))


def window_features(df: DataFrame, keys: list[str], ts: str, window_days: int = 30) -> DataFrame:
    """Per group and window (0 newest): count, the two before, mean of three, slope,
    velocity, month of the window that follows, and that window's count (the label)."""
    d = with_latest(df, ts).withColumn("w", F.floor(F.col("days_ago") / window_days).cast("int"))
    g = d.groupBy(*keys, "w").agg(F.count("*").alias("n"), F.max("latest").alias("latest"))
    span = d.agg(F.max("w").alias("last"), F.max("latest").alias("latest"))
    grid = d.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, "latest", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("w"))
    full = grid.join(g.drop("latest"), [*keys, "w"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    o = Window.partitionBy(*keys).orderBy("w")
    full = full.select(*keys, "w", F.col("n").alias("recent"), F.lead("n", 1, 0).over(o).alias("prior"), F.lead("n", 2, 0).over(o).alias("prior2"), F.lag("n").over(o).alias("target"), F.month(F.date_sub("latest", (F.col("w") - 1) * window_days)).alias("month"))
    return full.select(
        *keys, "w", "recent", "prior", "prior2", F.round(F.col("recent") / F.greatest("prior", F.lit(1)), 3).alias("velocity"),
        F.round((F.col("recent") + F.col("prior") + F.col("prior2")) / 3, 3).alias("rolling_mean_3"), F.round((F.col("recent") - F.col("prior2")) / 2, 3).alias("trend_slope"), "month", "target",
    )


def forecast(features: DataFrame, predictor=None) -> DataFrame:
    """Risk levels by tertiles of a predictor's numbers. Without a predictor the result
    says so and holds no numbers. ``predictor`` maps a frame to one with ``expected``."""
    now = features.where("w = 0")
    if predictor is None:
        return now.select("*", F.lit(None).cast("double").alias("expected"), F.lit(None).cast("string").alias("level"), F.lit(False).alias("available"))
    p = predictor(now)
    cut = p.agg(F.percentile("expected", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))
    level = F.when(F.col("expected") >= F.col("cut")[1], "high").when(F.col("expected") >= F.col("cut")[0], "medium").otherwise("low")
    return p.crossJoin(F.broadcast(cut)).withColumn("level", level).withColumn("available", F.lit(True)).drop("cut")


def count_outliers(df: DataFrame, group: str, value: str, min_n: int = 10, floor: float = 1.0, min_score: float = 2.5) -> DataFrame:
    """Rows whose value stands out of their group's median by the modified z."""
    med = df.groupBy(group).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    dev = df.join(med, group)
    mad = dev.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    z = modified_z(F.col(value), F.col("median"), F.col("mad"), floor)
    return dev.where(F.col("n") >= min_n).join(mad, group).withColumn("z", F.round(z, 4)).where(F.col("z") >= min_score)


def hour_outliers(df: DataFrame, group: str, hour: str, min_n: int = 8, floor: float = 1.5, min_score: float = 2.5) -> DataFrame:
    """The same on the clock: circular mean and circular deviation."""
    a = F.col(hour) * (2 * 3.141592653589793 / 24)
    mean = df.groupBy(group).agg(F.count("*").alias("n"), F.atan2(F.round(F.avg(F.sin(a)), 9), F.round(F.avg(F.cos(a)), 9)).alias("t"))
    mean = mean.select(group, "n", F.round(F.pmod(F.col("t") * (24 / (2 * 3.141592653589793)), F.lit(24.0)), 6).alias("centre"))
    d = df.join(mean, group).withColumn("distance", hour_distance(F.col(hour), F.col("centre")))
    mad = d.groupBy(group).agg(F.median("distance").alias("mad"))
    score = F.round(F.col("distance") / F.greatest(1.4826 * F.col("mad"), F.lit(floor)), 4)
    return d.where(F.col("n") >= min_n).join(mad, group).withColumn("score", score).where(F.col("score") >= min_score)


def rare_pairs(df: DataFrame, place: str, kind: str, min_total: int = 20, min_share: float = 0.01, min_expected: float = 3.0, at_most: float = 0.4) -> DataFrame:
    """Kinds far rarer at a place than their share of all rows leads to expect."""
    pair = df.groupBy(place, kind).agg(F.count("*").alias("observed"))
    total = pair.groupBy(place).agg(F.sum("observed").alias("place_total"))
    share = pair.groupBy(kind).agg(F.sum("observed").alias("kind_total")).crossJoin(F.broadcast(pair.agg(F.sum("observed").alias("all"))))
    j = pair.join(total, place).join(share, kind)
    j = j.withColumn("share", F.col("kind_total") / F.col("all")).withColumn("expected", F.col("place_total") * F.col("share"))
    j = j.where((F.col("place_total") >= min_total) & (F.col("share") >= min_share) & (F.col("expected") >= min_expected) & (F.col("observed") <= at_most * F.col("expected")))
    return j.select(place, kind, "observed", F.round("expected", 4).alias("expected"), F.round((F.col("expected") - F.col("observed")) / F.sqrt("expected"), 4).alias("z"))
