"""Literal tables that Spark and the SQL oracles share, and the SQL of what both need often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig
from linkloom.functions import uri as U
from linkloom.operators import check as C
from linkloom.operators import resolve
from linkloom.operators.extract.links import extract_links
from linkloom.session import spread, table
from linkloom.sources.inputs import from_table


def frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _shown(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows: Sequence[tuple], columns: str) -> str:
    """The rows as SQL: (VALUES ...) AS t(columns)."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_shown, r)) + ")" for r in rows) + f") AS t({columns})"


# SQL of parts of a URI ``u``.
SCHEME = "nullif(lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"
HOST = r"nullif(lower(regexp_extract({u}, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '')"
PATH = "regexp_extract({u}, '^[^:]+:(?://[^/?#]*)?([^?#]*)', 1)"
EXAMPLE = "coalesce(regexp_matches(" + HOST + r", '^(?:[^.]*\.)?example\.(?:com|org|net|edu)$|\.(?:test|example|invalid|localhost)$'), FALSE)"

#: All links of ``pages`` with their absolute URI (all of them are root-relative).
PAGE_LINKS = r"""links AS (
  SELECT page_id, url AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS text, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)"')) + 1)) AS n FROM pages),
encoded AS (SELECT page_id, n, source, text, replace(replace(replace(replace(replace(replace(url_encode(text), '%2F', '/'), '%3F', '?'), '%3D', '='), '%26', '&'), '%2C', ','), '%23', '#') AS path FROM links),
requests AS (SELECT page_id, n, source, text, regexp_extract(source, '^([a-z]+://[^/?#]*)', 1) || path AS uri FROM encoded)"""
#: Where the links of ``PAGE_LINKS`` stand (a CTE by page_id and n).
PAGE_SPANS = """spans AS (SELECT page_id, n, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(split_part(before, chr(10), -1)) + 1 AS col
  FROM (SELECT page_id, n, array_to_string(parts[1:n], '<a href="') || '<a href="' AS before FROM (SELECT page_id, parts, unnest(range(1, len(parts))) AS n FROM (SELECT page_id, string_split(html, '<a href="') AS parts FROM pages))))"""
#: Code that the made-up snapshot gives for a URI without fragment.
BYTE = "CAST(('0x' || substr(md5({u}), 1, 2)) AS INT)"
CODE = "CASE WHEN " + BYTE + " < 200 THEN 200 WHEN " + BYTE + " < 230 THEN 404 WHEN " + BYTE + " < 245 THEN 429 ELSE 500 END"
#: Code by event type in the request log made from ``events``.
EVENT_CODE = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 500 WHEN 'error' THEN 429 END"
EVENT_HOST = "'h' || CAST(user_id % 10 AS VARCHAR)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spread(table(spark, sf_dir, "pages").select("url", "html")), "url", "html")


def page_requests(spark: SparkSession, sf_dir: str, config: LinkCheckConfig | None = None) -> DataFrame:
    """Requests of all links that the HTML parser finds in ``pages``."""
    config = config or LinkCheckConfig()
    return resolve.to_requests(extract_links(pages(spark, sf_dir)), config.base_url, config.root_dir)


def page_snapshot(requests: DataFrame) -> DataFrame:
    """A made-up snapshot: every URL answers GET with a code that depends on its name alone."""
    url = requests.where("uri is not null").select(U.strip_fragment(F.col("uri")).alias("url_nofrag")).distinct()
    b = F.conv(F.substring(F.md5("url_nofrag"), 1, 2), 16, 10).cast("int")
    code = F.when(b < 200, 200).when(b < 230, 404).when(b < 245, 429).otherwise(500)
    rest = {"error_class": "string", "error_message": "string", "headers": "map<string,string>", "body": "string", "final_url": "string", "redirects": C.REDIRECTS, "duration_ms": "double"}
    return url.select(F.lit("GET").alias("method"), "url_nofrag", code.alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in rest.items()))


_HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """``df`` kept while it is read several times; what was kept before is let go, so a session holds one of them."""
    while _HELD:
        _HELD.pop().unpersist()
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[0]


def page_responses(spark: SparkSession, sf_dir: str, config: LinkCheckConfig | None = None) -> DataFrame:
    config = config or LinkCheckConfig()
    # read three times below: for the made-up snapshot, the distinct URIs and the rows
    requests = held(page_requests(spark, sf_dir, config))
    return C.check(requests, C.Snapshots(http=page_snapshot(requests)), config)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a request log: host, ts, event_id, code, duration_ms."""
    code = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 500).when(F.col("event_type") == "error", 429)
    host = F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"))
    return table(spark, sf_dir, "events").select(host.alias("host"), "ts", "event_id", code.alias("code"), F.col("value").alias("duration_ms"))


URIS = [
    ("https://example.com/a",), ("https://m.example.com/",), ("https://a.b.example.com/",), ("http://myexample.com",), ("https://x.test/",), ("http://localhost:80/x",), ("http://127.0.0.1/",), ("http://10.1.2.3/",), ("http://172.20.0.1/",), ("http://172.32.0.1/",), ("http://192.168.0.9/",), ("http://169.254.1.1/",),
    ("http://[::1]/",), ("http://[fd00::1]/x",), ("http://[fe80::1]/",), ("http://[::ffff:7f00:1]/",), ("mailto:a@myexample.com",), ("mailto:foo@bar.org",), ("tel:123",), ("slack://channel",), ("data:text/plain,x",), ("file:///a/b",), ("https://nottwitter.com/x",), ("https://mobile.twitter.com/x",), ("https://www.w3.org/1999/xhtml",), ("http://schemas.microsoft.com/x",), ("https://ogp.me/ns#",), ("https://wp.org/xmlrpc.php",), ("https://wp.org/xmlrpc.php?x",), ("https://github.com/a/b",), ("HTTPS://UP.org/",),
]
