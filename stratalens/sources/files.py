"""Strict table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.tables import filtered  # noqa: F401


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, blanks_as_null: bool = True) -> DataFrame:
    """Fails on unknown or missing columns and on cells that do not parse."""
    head = spark.read.option("header", True).csv(path).columns
    want = [f.name for f in schema.fields]
    if set(head) != set(want):
        raise ValueError(f"missing {sorted(set(want) - set(head))}, unknown {sorted(set(head) - set(want))}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in head])
    raw = spark.read.schema(text).option("header", True).option("mode", "FAILFAST").csv(path)
    if not blanks_as_null:
        return raw.na.fill("").select(*want)
    return raw.select(*(F.when(F.trim(c) != "", F.col(c)).cast(schema[c].dataType).alias(c) for c in want))


def read_versioned_json(spark: SparkSession, path: str, schema: str, version: str, valid: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted model version, split by a validity predicate."""
    rows = spark.read.schema(schema).json(path)
    other = rows.where(~F.col("model_version").eqNullSafe(F.lit(version)))
    if not other.isEmpty():
        raise ValueError("the file holds another model version")
    ok = F.coalesce(F.expr(valid), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def time_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Half-open, pushed down to the scan."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_by_month(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """One folder a month (``month``: its first day, null for a null time). Rows of a month are
    dealt to several tasks by a hash of their time, so a crowded month is not one file."""
    out = df.withColumn("month", F.trunc(F.to_date(ts), "month"))
    out.repartition("month", F.pmod(F.xxhash64(ts), F.lit(8))).write.mode(mode).partitionBy("month").parquet(path)


def read_range(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """``time_range`` over such a table: only the months of the range are listed and read."""
    first, last = (F.trunc(F.to_date(F.lit(x).cast("timestamp_ntz")), "month") for x in (start, end))
    found = spark.read.parquet(path).where((F.col("month") >= first) & (F.col("month") <= last))
    return time_range(found, ts, start, end).drop("month")


def recent_rows(spark: SparkSession, path: str, ts: str, days: int) -> DataFrame:
    """Rows of the newest ``days`` days. The newest month is known from the folders alone; the
    newest day is looked up in that month, and the bound prunes the months before."""
    rows = spark.read.parquet(path)
    newest = rows.where("month is not null").select("month").distinct().agg(F.max("month").alias("month"))
    day = rows.join(F.broadcast(newest), "month").agg(F.max(F.to_date(ts)).alias("newest")).select(F.date_sub("newest", days - 1).alias("since"), F.trunc(F.date_sub("newest", days - 1), "month").alias("month_since"))
    bound = day.first()  # one row
    if bound["since"] is None:
        return rows.where("false").drop("month")
    return rows.where((F.col("month") >= F.lit(bound["month_since"])) & (F.to_date(ts) >= F.lit(bound["since"]))).drop("month")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).na.fill("").write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str, forbidden: tuple[str, ...] = ("name", "phone", "address")) -> None:
    """Append only; personal fields are refused."""
    bad = [c for c in df.columns if c.lower() in forbidden]
    if bad:
        raise ValueError(f"personal fields {bad}")
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, version: str | None = None) -> None:
    """One JSON object a line; ``version`` is kept as ``model_version`` with every row, as
    ``read_versioned_json`` asks for it. Nulls are written out."""
    out = df if version is None else df.withColumn("model_version", F.lit(version))
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_by_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """All tables of a run or none: they are written to the run's own folder first, and one
    appended row of ``current`` then names the run. A failed write leaves the last run, and
    the same run can be tried again; a run that is named is never written twice."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{path}/current") and not spark.read.parquet(f"{path}/current").where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is complete")
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/runs/{run_id}/{name}")
    spark.createDataFrame([(run_id,)], "run_id string").select("run_id", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/current")


def read_current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the run that was named last."""
    last = spark.read.parquet(f"{path}/current").orderBy(F.desc("at"), F.desc("run_id")).first()
    return spark.read.parquet(f"{path}/runs/{last['run_id']}/{name}")
