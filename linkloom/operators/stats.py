"""Counts over responses and requests. Each is one aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import status as S

MAP_CLASSES = ("success", "error", "timeout", "excluded", "unsupported")


def counters(responses: DataFrame) -> DataFrame:
    """One row: total, unique, redirects, remaps, successful, errors, unknown, timeouts, excludes, unsupported, cached."""
    s = F.col("status")
    c = S.status_class(s)
    return responses.agg(
        F.count("*").alias("total"),
        F.count_distinct("uri").alias("unique"),
        F.count_if(F.col("redirects").isNotNull()).alias("redirects"),
        F.count_if(F.col("remap").isNotNull()).alias("remaps"),
        F.count_if(c == "success").alias("successful"),
        F.count_if(c == "error").alias("errors"),
        F.count_if(c == "unknown").alias("unknown"),
        F.count_if(c == "timeout").alias("timeouts"),
        F.count_if(c == "excluded").alias("excludes"),
        F.count_if(c == "unsupported").alias("unsupported"),
        F.count_if(s["cached"]).alias("cached"),
    )


def per_source(responses: DataFrame, detailed: bool = False) -> DataFrame:
    """Distinct response bodies by source and class: source, class, uri, status, redirects, remap, span, duration_ms.

    Rows, not nested sets, so a source of any size fits. Unknown ones belong to no class;
    success and exclusion count only in detailed mode.
    """
    kept = MAP_CLASSES if detailed else ("error", "timeout", "unsupported")
    rows = responses.withColumn("class", S.status_class(F.col("status"))).where(F.col("class").isin(*kept))
    body = ["uri", "status", "redirects", "remap", "duration_ms"] + (["span"] if "span" in responses.columns else [])
    return rows.select("source", "class", *body).distinct()


def redirects_per_source(responses: DataFrame) -> DataFrame:
    return responses.where("redirects is not null").select("source", "redirects").distinct()


def outcome(responses: DataFrame, accept_timeouts: bool = False) -> DataFrame:
    """One row: success, and exit_code (0 fine, 2 failed links). No responses are a success."""
    c = S.status_class(F.col("status"))
    bad = c == "error" if accept_timeouts else c.isin("error", "timeout")
    return responses.agg(F.coalesce(~F.bool_or(bad), F.lit(True)).alias("success")).withColumn("exit_code", F.when(F.col("success"), 0).otherwise(2))


def host_stats(requests: DataFrame, hits: DataFrame | None = None, exact_median: bool = True) -> DataFrame:
    """Per host from a request log (host, ts, code, duration_ms, event_id; no code: network error) and cache ``hits`` (host, cache_hits).

    Cache hits count as requests and as successes, whatever they gave; each request is a
    miss. An exact median keeps a count for each distinct duration of a host; without
    ``exact_median`` a sketch of fixed size is kept instead.
    """
    code = F.col("code")
    out = requests.groupBy("host").agg(
        F.count("*").alias("requests"),
        F.count_if(code.between(200, 299)).alias("answered"),
        F.count_if(code == 429).alias("rate_limited"),
        F.count_if(code.between(400, 499) & (code != 429)).alias("client_errors"),
        F.count_if(code.between(500, 599)).alias("server_errors"),
        F.count_if(code.isNull()).alias("network_errors"),
        (F.median("duration_ms") if exact_median else F.percentile_approx("duration_ms", 0.5, 10_000)).alias("median_ms"),
        F.avg("duration_ms").alias("average_ms"),
        F.max_by("duration_ms", F.struct("ts", "event_id")).alias("latest_ms"),
        F.max(F.when(code == 429, F.col("ts"))).alias("last_rate_limited"),
    )
    if hits is None:
        out = out.withColumn("cache_hits", F.lit(0).cast("bigint"))
    else:
        out = out.join(hits.groupBy("host").agg(F.sum("cache_hits").alias("cache_hits")), "host", "full_outer").fillna(0, ["requests", "answered", "rate_limited", "client_errors", "server_errors", "network_errors", "cache_hits"])
    total = F.col("requests") + F.col("cache_hits")
    failed = F.col("rate_limited") + F.col("client_errors") + F.col("server_errors") + F.col("network_errors")
    return out.select(
        "host",
        total.alias("total_requests"),
        (F.col("answered") + F.col("cache_hits")).alias("successful_requests"),
        "rate_limited",
        "client_errors",
        "server_errors",
        "network_errors",
        "median_ms",
        "average_ms",
        "latest_ms",
        F.when(total == 0, F.lit(1.0)).otherwise((F.col("answered") + F.col("cache_hits")) / total).alias("success_rate"),
        F.when(total == 0, F.lit(0.0)).otherwise(100.0 * failed / total).alias("error_rate"),
        "cache_hits",
        F.col("requests").alias("cache_misses"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.col("cache_hits") / total).alias("cache_hit_rate"),
        "last_rate_limited",
    )


def status_codes(requests: DataFrame) -> DataFrame:
    """Histogram by host: host, code, n."""
    return requests.where("code is not null").groupBy("host", "code").agg(F.count("*").alias("n"))


def status_code_maps(requests: DataFrame) -> DataFrame:
    """The same with one map for each host."""
    return status_codes(requests).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("status_codes"))


def rate_limited_now(requests: DataFrame, now: Column, window_s: int = 60) -> DataFrame:
    """Hosts and whether their last 429 is less than ``window_s`` ago."""
    last = F.max(F.when(F.col("code") == 429, F.col("ts")))
    return requests.groupBy("host").agg(F.coalesce(last > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_s)), F.lit(False)).alias("rate_limited_now"))


def sorted_hosts(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("total_requests"), "host")


def host_places(stats: DataFrame) -> DataFrame:
    """host, total_requests and place, the number of a host in the order of ``sorted_hosts``.

    Hosts are numbered within each total, and totals by a running sum; there are fewer
    distinct totals than the root of twice the requests, so no task gets all hosts.
    """
    totals = stats.groupBy("total_requests").agg(F.count("*").alias("_n"))
    before = totals.select("total_requests", (F.sum("_n").over(Window.orderBy(F.desc("total_requests"))) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("total_requests").orderBy("host"))
    return stats.select("host", "total_requests", nth.alias("_nth")).join(before, "total_requests").select("host", "total_requests", (F.col("_nth") + F.col("_before")).cast("bigint").alias("place"))


def display_order(*columns: str) -> list[Column]:
    """Case-insensitive order, ties by the exact text."""
    return [x for c in columns for x in (F.lower(c), F.col(c))]


def sorted_by_display(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*display_order(*columns))
