"""The stored cache of results: uri, status (text), ts (seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import status as S
from linkloom.functions import uri as U

SCHEMA = "uri string, status string, ts bigint"


def load(cache: DataFrame, now: int, max_age_s: int, excluded_codes: S.Ranges = ()) -> DataFrame:
    """Usable entries, one for each uri (the last of those with the same): fresh, no errors, no excluded codes."""
    kind = S.cache_kind(F.col("status"))
    rows = cache.withColumn("_k", kind).where((F.lit(now) - F.col("ts") < max_age_s) & (F.col("_k.kind") != S.ERROR))
    if excluded_codes:
        rows = rows.where(~S.accepted(F.col("_k.code"), excluded_codes))
    return rows.groupBy("uri").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def latest(cache: DataFrame) -> DataFrame:
    """uri and status, one row for each uri: the last stored one, or without times the greatest."""
    order = F.struct("ts", "status") if "ts" in cache.columns else F.struct("status")
    return cache.groupBy("uri").agg(F.max_by("status", order).alias("status"))


def misses(uris: DataFrame, cache: DataFrame) -> DataFrame:
    return uris.join(cache.select("uri"), "uri", "left_anti")


def hits(uris: DataFrame, cache: DataFrame, ranges: S.Ranges = S.DEFAULT_ACCEPT) -> DataFrame:
    """uri and status of those in the cache."""
    return uris.join(latest(cache).withColumnRenamed("status", "_text"), "uri").withColumn("status", S.from_cache(S.cache_kind(F.col("_text")), ranges)).drop("_text")


def storable(responses: DataFrame, now: int, excluded_codes: S.Ranges = ()) -> DataFrame:
    """Entries to store: no files, exclusions, unsupported or unknown ones, excluded codes, or errors."""
    s = F.col("status")
    rows = responses.where(s["kind"].isin(S.OK) & ~F.coalesce(U.scheme(F.col("uri")) == "file", F.lit(False)))
    if excluded_codes:
        rows = rows.where(~S.accepted(s["code"], excluded_codes))
    return rows.groupBy("uri").agg(F.max(S.cache_text(s)).alias("status")).withColumn("ts", F.lit(now).cast("bigint"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A header-less CSV of (uri, status, ts)."""
    return spark.read.csv(path, schema=SCHEMA, header=False)


def write(entries: DataFrame, path: str) -> None:
    entries.select("uri", "status", "ts").write.mode("overwrite").csv(path, header=False)


def is_stale(modified_ts: float, now: float, max_age_s: float) -> bool:
    """Whether a whole cache file is too old to be read."""
    return now - modified_ts > max_age_s
