"""Session factory and the one place that knows where shared intermediate data goes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stratalens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A local folder is used only where the setting is absent, which is the case for
    local mode (tests, bench), never for a configured cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "stratalens-checkpoints")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; all intermediate data goes there."""
    return f"{shared_dir(spark)}/stratalens-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, whose sizes Spark then knows."""
    spark, path = df.sparkSession, f"{own_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_intermediates(spark: SparkSession) -> None:
    """Deletes this application's intermediate data, once no result needs it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
