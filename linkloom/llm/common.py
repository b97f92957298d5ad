"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on this machine alone, as in tests, a
    temporary folder is taken and set; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="linkloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: What has been made and not yet been deleted; the last list is that of the innermost ``settled``.
_MADE: list[list[tuple[str, str]]] = [[]]


def _delete(spark: SparkSession, made: list[tuple[str, str]]) -> None:
    while made:
        kind, name = made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables and folders that operators have made so far; call it when results that read them are stored. It is called at the end of the program."""
    for made in _MADE:
        _delete(spark, made)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if any(_MADE) else None
    if spark is not None and spark.sparkContext._jsc is not None:
        clean_up(spark)


def kept_as(kind: str, name: str) -> str:
    """Notes a table or folder for ``clean_up``."""
    _MADE[-1].append((kind, name))
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = kept_as("folder", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written`` for what ``make`` returns; what was made on the way is deleted then."""
    _MADE.append([])
    try:
        out = written(make(), name)
        _MADE[-2].append(_MADE[-1].pop())
    finally:
        _delete(spark, _MADE.pop())
    return out


def slots(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning: what the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(columns: list[str], stem: str) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``columns``."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def place(doc_id: str = "doc_id") -> Column:
    """A number from 0 to 2**63 - 1 by which documents are drawn."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 1)


def drawn(share: Column) -> Column:
    """Whether a document is among the first ``share`` of all by its place."""
    return F.shiftrightunsigned(place(), 23) < share * F.lit(float(1 << 40))


def first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (doc_id and more, each id once) that come first by their places.

    Only about 16 times as many are sorted, whatever the number of tasks: the others
    are left out by their place alone, which no draw of this size can get wrong.
    """
    total = ids.count()
    return ids.where(drawn(F.lit(min(1.0, 16 * n / max(1, total))))).orderBy(place(), "doc_id").limit(n)


def one_text_each(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each doc_id of ``ids`` (doc_id and more, each id once) that ``docs`` has: doc_id, the more, and ``columns``.

    Of rows that repeat a doc_id the least counts. ``ids`` is broadcast, so its caller
    bounds it, and no more rows than it has come back. Names in ``docs`` cannot clash.
    """
    more = [c for c in ids.columns if c != "doc_id"]
    rows = docs.select(F.col("doc_id").alias("own_id"), F.struct(*columns).alias("own"))
    found = rows.join(F.broadcast(ids), F.col("own_id") == F.col("doc_id")).groupBy("doc_id", *more).agg(F.min("own").alias("own"))
    return found.select("doc_id", *more, *(F.col("own")[c].alias(c) for c in columns))
