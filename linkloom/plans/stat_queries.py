"""Queries over statistics, orders, reports and hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig
from linkloom.operators import report
from linkloom.operators import stats as ST
from linkloom.plans.join_queries import CHECKED
from linkloom.plans.literals import EVENT_CODE, EVENT_HOST, EXAMPLE, PAGE_LINKS, PAGE_SPANS, page_requests, page_responses, pages, request_log, values
from linkloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


@query(f"""WITH {CHECKED} SELECT count(*) AS total, count(DISTINCT uri) AS unique_uris, CAST(0 AS BIGINT) AS redirects, CAST(0 AS BIGINT) AS remaps, count(*) FILTER (NOT excluded AND code = 200) AS successful, count(*) FILTER (NOT excluded AND code <> 200) AS errors,
  CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS timeouts, count(*) FILTER (excluded) AS excludes, CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS cached FROM checked""")
def ag_01_04_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a run."""
    return ST.counters(page_responses(spark, sf_dir)).withColumnRenamed("unique", "unique_uris")


@query(f"""WITH {CHECKED}, {PAGE_SPANS}, c AS (SELECT DISTINCT source, uri, line, col, CASE WHEN excluded THEN 'excluded' WHEN code = 200 THEN 'success' ELSE 'error' END AS class FROM checked JOIN spans USING (page_id, n))
SELECT source, class, count(*) AS bodies FROM c GROUP BY ALL""")
def ag_05_sets_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct responses of every page, each with its place, by class."""
    return ST.per_source(page_responses(spark, sf_dir), detailed=True).groupBy("source", "class").agg(F.count("*").alias("bodies"))


@query(f"WITH {CHECKED} SELECT NOT bool_or(NOT excluded AND code <> 200) AS success, CASE WHEN bool_or(NOT excluded AND code <> 200) THEN 2 ELSE 0 END AS exit_code FROM checked")
def ag_07_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.outcome(page_responses(spark, sf_dir))


_LOG = f"log AS (SELECT {EVENT_HOST} AS host, ts, event_id, {EVENT_CODE} AS code, value AS ms FROM events)"


@query(f"""WITH {_LOG}, hits AS (SELECT host, count(*) AS h FROM log WHERE code = 200 AND ms < 50 GROUP BY host),
a AS (SELECT host, count(*) AS n, count(*) FILTER (code = 200) AS ok, count(*) FILTER (code = 429) AS rate_limited, count(*) FILTER (code BETWEEN 400 AND 499 AND code <> 429) AS client_errors, count(*) FILTER (code BETWEEN 500 AND 599) AS server_errors, median(ms) AS median_ms, arg_max(ms, {{'t': ts, 'e': event_id}}) AS latest_ms FROM log GROUP BY host)
SELECT host, n + h AS total_requests, ok + h AS successful_requests, rate_limited, client_errors, server_errors, median_ms, latest_ms, round((ok + h) / (n + h), 6) AS success_rate, round(100.0 * (rate_limited + client_errors + server_errors) / (n + h), 6) AS error_rate, round(h / (n + h), 6) AS cache_hit_rate FROM a JOIN hits USING (host)""")
def ag_08_11_host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, times and rates of every host; quick answers are counted as cache hits once more."""
    log = request_log(spark, sf_dir)
    hits = log.where("code = 200 and duration_ms < 50").groupBy("host").agg(F.count("*").alias("cache_hits"))
    s = ST.host_stats(log, hits)
    return s.select("host", "total_requests", "successful_requests", "rate_limited", "client_errors", "server_errors", "median_ms", "latest_ms", F.round("success_rate", 6).alias("success_rate"), F.round("error_rate", 6).alias("error_rate"), F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


@query(f"WITH {_LOG} SELECT host, round(avg(ms), 6) AS average_ms FROM log GROUP BY host")
def ag_10_average_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.host_stats(request_log(spark, sf_dir)).select("host", F.round("average_ms", 6).alias("average_ms"))


@query(f"WITH {_LOG} SELECT host, code, count(*) AS n FROM log GROUP BY host, code")
def ag_12_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of codes by host."""
    return ST.status_codes(request_log(spark, sf_dir))


@query("WITH h AS (SELECT DISTINCT 'h' || CAST(user_id % 10 AS VARCHAR) AS host FROM events) SELECT count(*) AS active_hosts FROM h")
def ag_13_active_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).agg(F.count_distinct("host").alias("active_hosts"))


@query(f"WITH {_LOG}, m AS (SELECT max(ts) AS now FROM log) SELECT host, coalesce(max(ts) FILTER (code = 429) > (SELECT now FROM m) - INTERVAL 2 HOUR, FALSE) AS rate_limited_now FROM log GROUP BY host")
def ag_14_rate_limited_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a 429 in the last two hours of the log."""
    log = request_log(spark, sf_dir)
    now = log.agg(F.max("ts")).first()[0]
    return ST.rate_limited_now(log, F.lit(now), 7200)


@query(f"WITH {_LOG}, n AS (SELECT host, count(*) AS total_requests FROM log GROUP BY host) SELECT host, total_requests, row_number() OVER (ORDER BY total_requests DESC, host) AS place FROM n")
def so_01_hosts_by_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by requests; the place is a column so that the order can be compared."""
    return ST.host_places(ST.host_stats(request_log(spark, sf_dir)))


@query(f"""WITH {CHECKED}, {PAGE_SPANS} SELECT uri, '[' || CASE WHEN excluded THEN 'EXCLUDED' ELSE CAST(code AS VARCHAR) END || '] ' || uri || ' (at ' || line || ':' || col || ')' || CASE WHEN excluded THEN ' | This is due to your ''exclude'' values' WHEN code = 200 THEN '' ELSE ' | Rejected status code: ' || code || ' ' || CASE code WHEN 404 THEN 'Not Found' WHEN 429 THEN 'Too Many Requests' ELSE 'Internal Server Error' END END AS line FROM checked JOIN spans USING (page_id, n)""")
def rp_06_response_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response as a line."""
    rows = page_responses(spark, sf_dir)
    return rows.select("uri", report.response_line("plain", rows.columns).alias("line"))


@query(f"WITH {CHECKED} SELECT uri, CASE WHEN excluded THEN '👻' WHEN code = 200 THEN '✅' ELSE '❌' END AS mark, '- [ ] [' || CASE WHEN excluded THEN 'EXCLUDED' ELSE CAST(code AS VARCHAR) END || ']' AS task FROM checked")
def rp_07_response_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How lines begin in the modes emoji and task."""
    rows = page_responses(spark, sf_dir)
    head = lambda mode, n: F.substring_index(report.response_line(mode, rows.columns), " ", n)
    return rows.select("uri", head("emoji", 1).alias("mark"), head("task", 4).alias("task"))


@query(f"""WITH {CHECKED}, e AS (SELECT * FROM checked WHERE NOT excluded AND code <> 200), d AS (SELECT min(regexp_extract(uri, '^[a-z]+://([^/?#:]*)', 1)) FILTER (code = 429) AS host, count(*) AS n FROM e)
SELECT replace('{report.HINT_RATE_LIMIT}', '{{}}', host) AS hint FROM d WHERE host IS NOT NULL UNION ALL SELECT '{report.HINT_CODES}' FROM d WHERE n > 0""")
def rp_09_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice by what the run has shown."""
    return report.hints(page_responses(spark, sf_dir), LinkCheckConfig())


@query(f"WITH {PAGE_LINKS} SELECT regexp_replace(uri, '^http:', 'https:') AS line FROM requests WHERE NOT {EXAMPLE.format(u='uri')}")
def sc_14_dump_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links after a remap, without the excluded ones."""
    config = LinkCheckConfig(remap=("^http:(.*)$ https:$1",))
    return report.dump_links(page_requests(spark, sf_dir, config), config)


@query(f"WITH {CHECKED} SELECT 'requests' AS part, count(*) AS n FROM checked UNION ALL SELECT 'errors', count(*) FROM checked WHERE FALSE")
def st_02_split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and error rows as two parts."""
    from linkloom.operators.resolve import split_errors

    fine, bad = split_errors(page_requests(spark, sf_dir))
    return fine.agg(F.lit("requests").alias("part"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("errors").alias("part"), F.count("*").alias("n")))


TREND = f"WITH {_LOG} SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, host, count(*) AS requests, count(*) FILTER (code = 200) AS successful, count(*) FILTER (code = 429) AS rate_limited FROM log GROUP BY ALL"


@query(TREND)
def st_host_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by host and five minutes (the plan of the streaming query, on a bounded table)."""
    from linkloom.streaming.hosts import host_counts

    return host_counts(request_log(spark, sf_dir)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
