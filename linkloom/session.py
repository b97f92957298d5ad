"""Session and table helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", partitions: int = 8, more: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench share, and ``more``."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=more or {})
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name that driver and executors share: below ``spark.checkpoint.dir``, or, only in a local session without that setting, below the machine's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/linkloom-{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame (columns are pruned by Catalyst)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan dealt over all cores, for rows that cost more to work on than to move.

    A file of few row groups is read by few tasks, however many splits it has, so a scan
    stays as it is only if it has several splits for each core and none of them has more
    than half a core's share of the rows; they are counted without reading a column.

    The cores are those known by now; a session that has just begun, or that takes
    executors as work comes, knows few of them. So rows are dealt to as many tasks as a
    shuffle has in any case.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()
    if splits >= 4 * cores:
        counts = rows.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if 2 * cores * (counts["most"] or 0) <= (counts["all"] or 0):
            return rows
    return rows.repartition(max(3 * cores, splits, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
