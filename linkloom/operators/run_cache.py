"""The cache that a run keeps of its requests: which of them reach the network.

A request is known by its method and its URL without fragment. Its answer is kept unless
its status may be retried (5xx, 408, 429). One that was kept without its body does not
answer a request that needs the body: that one is made, and its answer replaces the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import status as S
from linkloom.functions import uri as U


def run_cache(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per key of requests (method, url, needs_body, seq) with the status that ``outcomes`` (method, url_nofrag, status) gives: method, url_nofrag, host, occurrences, misses, hits, stored.

    One aggregation over the requests, with partial sums in the tasks: of the order in
    which a key is asked for only the first request matters. A key without a status, a
    network error, is not kept.
    """
    keys = ["method", "url_nofrag"]
    asked = requests.select("method", U.strip_fragment(F.col("url")).alias("url_nofrag"), F.coalesce("needs_body", F.lit(False)).alias("needs_body"), "seq")
    asked = asked.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min_by("needs_body", "seq").alias("first"), F.bool_or("needs_body").alias("any"))
    known = outcomes.groupBy(*keys).agg(F.min("status").alias("status"))
    stored = F.col("status").isNotNull() & ~S.retryable_code(F.col("status"))
    rows = asked.join(known, keys, "left").withColumn("stored", stored)
    misses = F.when(F.col("stored"), F.when(F.col("any") & ~F.col("first"), 2).otherwise(1)).otherwise(F.col("occurrences")).cast("bigint")
    return rows.select(*keys, U.host_key(F.col("url_nofrag")).alias("host"), "occurrences", misses.alias("misses"), (F.col("occurrences") - misses).alias("hits"), "stored")


def host_caches(keys: DataFrame) -> DataFrame:
    """Per host of ``run_cache``: host, cache_hits, cache_misses, cache_size, cache_hit_rate. The hosts are the active ones."""
    sums = keys.groupBy("host").agg(F.sum("hits").alias("cache_hits"), F.sum("misses").alias("cache_misses"), F.count_if("stored").alias("cache_size"))
    total = F.col("cache_hits") + F.col("cache_misses")
    return sums.withColumn("cache_hit_rate", F.when(total == 0, F.lit(0.0)).otherwise(F.col("cache_hits") / total))
