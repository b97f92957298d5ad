"""Queries over lookups, checks and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig
from linkloom.functions import status as S
from linkloom.functions import uri as U
from linkloom.operators import cache as CA
from linkloom.operators import check as C
from linkloom.operators import files, resolve
from linkloom.operators.run_cache import host_caches, run_cache
from linkloom.plans.literals import BYTE, CODE, EXAMPLE, HOST, PAGE_LINKS, frame, held, page_requests, page_responses, page_snapshot, request_log, values
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


_EX = EXAMPLE.format(u="uri")
CHECKED = f"{PAGE_LINKS}, checked AS (SELECT *, {_EX} AS excluded, {CODE.format(u='uri')} AS code FROM requests)"
SUMMARY = f"""WITH {CHECKED}
SELECT count(*) AS total, count(DISTINCT uri) AS unique_uris, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded AND code = 200) AS ok, count(*) FILTER (NOT excluded AND code <> 200) AS errors FROM checked"""


def _summary(responses: DataFrame) -> DataFrame:
    from linkloom.operators.stats import counters

    c = counters(responses)
    return c.select("total", F.col("unique").alias("unique_uris"), F.col("excludes").alias("excluded"), F.col("successful").alias("ok"), "errors")


@query(SUMMARY)
def link_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all pages: links, distinct targets, excluded, successful and failed ones."""
    return _summary(page_responses(spark, sf_dir))


@query(f"WITH {CHECKED} SELECT source, uri, CASE WHEN excluded THEN 'Excluded' WHEN code = 200 THEN 'Ok' ELSE 'Error' END AS kind, CASE WHEN NOT excluded THEN CAST(code AS VARCHAR) END AS code FROM checked")
def jo_01_snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every link by the snapshot."""
    return page_responses(spark, sf_dir).select("source", "uri", F.col("status.kind").alias("kind"), F.col("status.code").cast("string").alias("code"))


@query(f"WITH {PAGE_LINKS}, n AS (SELECT uri, count(*) AS n FROM requests GROUP BY uri) SELECT source, uri, c.n AS occurrences, c.n - 1 AS cache_hits FROM requests JOIN n AS c USING (uri)")
def jo_02_dedup_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URI is requested once; the rest of its occurrences are cache hits."""
    # read three times below: as requests, as answers and as rows
    links = held(page_requests(spark, sf_dir).select("source", "pos", "uri"))
    keys = run_cache(links.select(F.lit("GET").alias("method"), F.col("uri").alias("url"), F.lit(False).alias("needs_body"), "pos", F.struct("source", "pos").alias("seq")), _answers(links))
    return links.join(keys, U.strip_fragment(F.col("uri")) == F.col("url_nofrag")).select("source", "uri", "occurrences", F.col("hits").alias("cache_hits"))


def _answers(links: DataFrame) -> DataFrame:
    """Every URL is fine."""
    return links.select(F.lit("GET").alias("method"), U.strip_fragment(F.col("uri")).alias("url_nofrag"), F.lit(200).alias("status")).distinct()


NOW = 1_700_000_000
_B = BYTE.format(u="uri")
_CACHE = f"""stored AS (SELECT uri, CASE WHEN {_B} < 100 THEN '200' WHEN {_B} < 120 THEN '404' WHEN {_B} < 125 THEN 'Excluded' ELSE 'junk' END AS status, CAST({NOW} - {_B} * 1000 AS BIGINT) AS ts FROM (SELECT DISTINCT uri FROM requests) WHERE {_B} < 128),
usable AS (SELECT uri, status FROM stored WHERE {NOW} - ts < 86400 AND status IN ('200', 'Excluded'))"""


def _stored(requests: DataFrame) -> DataFrame:
    b = F.conv(F.substring(F.md5("uri"), 1, 2), 16, 10).cast("int")
    text = F.when(b < 100, "200").when(b < 120, "404").when(b < 125, "Excluded").otherwise("junk")
    return requests.select("uri").distinct().where(b < 128).select("uri", text.alias("status"), (F.lit(NOW) - b * 1000).cast("bigint").alias("ts"))


@query(f"WITH {PAGE_LINKS}, {_CACHE} SELECT r.uri, u.status IS NOT NULL AS hit, CASE u.status WHEN '200' THEN 'Ok' WHEN 'Excluded' THEN 'Excluded' END AS kind FROM (SELECT DISTINCT uri FROM requests) r LEFT JOIN usable u ON r.uri = u.uri")
def jo_03_cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which URIs a stored cache answers, and how."""
    # read by the cache and by both lookups
    uris = held(page_requests(spark, sf_dir).select("uri").distinct())
    cache = CA.load(_stored(uris), NOW, 86_400)
    found = CA.hits(uris, cache).select("uri", F.lit(True).alias("hit"), F.col("status.kind").alias("kind"))
    none = CA.misses(uris, cache).select("uri", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("kind"))
    return found.unionByName(none)


@query(f"WITH {PAGE_LINKS}, {_CACHE} SELECT uri, status, max(ts) AS ts FROM stored WHERE {NOW} - ts < 86400 AND status IN ('200', 'Excluded') GROUP BY uri, status")
def ca_02_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable entries: fresh, no errors, no junk."""
    return CA.load(_stored(page_requests(spark, sf_dir)), NOW, 86_400).select("uri", "status", "ts")


TEXTS = [("200",), ("204",), ("404",), ("999",), ("Excluded",), ("Unsupported",), ("Error",), ("",), ("99",), ("1000",)]


@query(f"SELECT status, CASE WHEN status IN ('Excluded', 'Unsupported') THEN status WHEN regexp_matches(status, '^2[0-9][0-9]$') THEN 'Ok' ELSE 'Error' END AS kind, CASE WHEN regexp_matches(status, '^[1-9][0-9][0-9]$') THEN status END AS code FROM {values(TEXTS, 'status')}")
def ca_03_cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored texts stand for."""
    return frame(spark, TEXTS, "status string").select("status", S.cache_kind(F.col("status")).alias("k")).select("status", "k.kind", F.col("k.code").cast("string").alias("code"))


CACHED = [("Ok", 200), ("Ok", 404), ("Error", 404), ("Error", 500), ("Error", None), ("Excluded", None), ("Unsupported", None)]


@query(f"SELECT kind AS stored, CAST(code AS VARCHAR) AS code, CASE WHEN kind = 'Error' AND code = 404 THEN 'Ok' ELSE kind END AS kind FROM {values(CACHED, 'kind, code')}")
def ca_05_cache_hit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error in the cache is fine where its code is accepted now."""
    rows = frame(spark, CACHED, "stored string, code int")
    made = S.from_cache(F.struct(F.col("stored").alias("kind"), "code"), S.parse_ranges("404"))
    return rows.select("stored", "code", made.alias("s")).select("stored", F.col("code").cast("string").alias("code"), F.col("s.kind").alias("kind"))


@query(f"WITH {CHECKED} SELECT DISTINCT uri, '200' AS status FROM checked WHERE NOT excluded AND code = 200")
def ca_06_07_storable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run stores."""
    return CA.storable(page_responses(spark, sf_dir), NOW).select("uri", "status")


@query(f"WITH {PAGE_LINKS} SELECT r.uri, EXISTS (SELECT 1 FROM pages p WHERE p.url = r.uri) AS is_page FROM (SELECT DISTINCT uri FROM requests UNION SELECT url FROM pages) r")
def jo_04_existing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are pages of the table, by semi and anti joins."""
    known = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    # read by both joins
    asked = held(page_requests(spark, sf_dir).select(F.col("uri").alias("path")).unionByName(known).distinct())
    there = files.existing(asked, known).withColumn("is_page", F.lit(True))
    return there.unionByName(files.missing(asked, known).withColumn("is_page", F.lit(False))).select(F.col("path").alias("uri"), "is_page")


FS = [("/s", "s", "", True, 0), ("/s/a.html", "a.html", "html", False, 1), ("/s/b.md", "b.md", "md", False, 2), ("/s/d", "d", "", True, 3), ("/s/d/index.html", "index.html", "html", False, 4), ("/s/e", "e", "", True, 5), ("/s/x/b.md", "b.md", "md", False, 6), ("/s/c.htm", "c.htm", "htm", False, 7)]
FS_SCHEMA = "path string, filename string, ext string, is_dir boolean, walk_order bigint"
FS_SQL = f"fs AS (SELECT * FROM {values(FS, 'path, filename, ext, is_dir, walk_order')})"
PATHS = [("/s/a",), ("/s/a.html",), ("/s/b.html",), ("/s/c",), ("/s/zz",), ("/s/d",)]


@query(f"""WITH {FS_SQL}, p AS (SELECT * FROM {values(PATHS, 'path')}), t AS (SELECT path, -1 AS pos, path AS candidate FROM p UNION ALL SELECT path, 0, regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.html' FROM p UNION ALL SELECT path, 1, regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.md' FROM p)
SELECT t.path, arg_min(candidate, pos) AS found FROM t JOIN fs ON fs.path = candidate GROUP BY t.path""")
def jo_05_fallback_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several extensions with which a file exists."""
    return files.fallback_extensions(frame(spark, PATHS, "path string"), frame(spark, FS, FS_SCHEMA), ["html", "md"]).select("path", "found")


@query(f"WITH {FS_SQL}, t AS (SELECT path, 0 AS pos, path || '/index.html' AS candidate FROM fs WHERE is_dir UNION ALL SELECT path, 1, path FROM fs WHERE is_dir) SELECT t.path, arg_min(candidate, pos) AS found FROM t JOIN fs ON fs.path = candidate GROUP BY t.path")
def jo_06_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files of directories; ``.`` is the directory."""
    index = frame(spark, FS, FS_SCHEMA)
    return files.index_files(index.where("is_dir"), index, ["index.html", "."]).select("path", "found")


WIKI = [("a.html",), ("b",), ("nothing",), ("x/b.md",)]


@query(f"""WITH {FS_SQL}, n AS (SELECT filename, arg_max(path, walk_order) AS file FROM fs WHERE NOT is_dir GROUP BY filename), w AS (SELECT * FROM {values(WIKI, 'target')}),
  t AS (SELECT target, 0 AS pos, split_part(target, '/', -1) AS candidate FROM w UNION ALL SELECT target, 1, split_part(target, '/', -1) || '.md' FROM w)
SELECT w.target, (SELECT arg_min(file, pos) FROM t JOIN n ON n.filename = candidate WHERE t.target = w.target) AS found FROM w""")
def jo_07_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that wikilinks name; of several with a name the last of the walk."""
    return files.wikilinks(frame(spark, WIKI, "target string"), frame(spark, FS, FS_SCHEMA), ["md"])


FILE_URIS = [("file:///s/a",), ("file:///s/d/",), ("file:///s/e",), ("file:///s/zz",), ("file:///s/b.md",)]


@query(f"SELECT uri, CASE WHEN uri = 'file:///s/zz' THEN 'InvalidFilePath' WHEN uri = 'file:///s/e' THEN 'InvalidIndexFile' END AS error_kind, CASE WHEN uri IN ('file:///s/zz', 'file:///s/e') THEN 'Error' ELSE 'Ok' END AS kind FROM {values(FILE_URIS, 'uri')}")
def ck_09_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of file URIs with fallback extensions and index files."""
    config = LinkCheckConfig(fallback_extensions=("html",), index_files=("index.html",))
    out = C.check_files(frame(spark, FILE_URIS, "uri string"), C.Snapshots(http=None, files=frame(spark, FS, FS_SCHEMA)), config)
    return out.select("uri", F.col("status.error_kind").alias("error_kind"), F.col("status.kind").alias("kind"))


BODIES = [("https://h.org/a", '<h1 id="one">T</h1><p>Hello <b>big</b> world</p>'), ("https://h.org/b.md", "# Some Title\n")]
FRAGMENTS = [("https://h.org/a#one", True), ("https://h.org/a#two", False), ("https://h.org/a#TOP", True), ("https://h.org/a#:~:text=big%20world", True), ("https://h.org/a#:~:text=small", False), ("https://h.org/a#one:~:text=Hello,world", True), ("https://h.org/b.md#some-title", True), ("https://h.org/b.md#Some-Title", True), ("https://h.org/b.md#other", False)]


@query(f"SELECT uri, expected AS valid FROM {values(FRAGMENTS, 'uri, expected')}")
def jo_08_09_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and text directives against the documents that they point at (the oracle states what is right)."""
    headers = F.when(F.endswith("url", F.lit(".md")), F.create_map(F.lit("content-type"), F.lit("text/plain; charset=utf-8"))).otherwise(F.create_map(F.lit("content-type"), F.lit("text/html")))
    http = frame(spark, BODIES, "url string, body string").select(F.lit("GET").alias("method"), F.col("url").alias("url_nofrag"), F.lit(200).alias("status"), F.lit("none").alias("error_class"), F.lit(None).cast("string").alias("error_message"), headers.alias("headers"), "body", F.col("url").alias("final_url"), F.lit(None).cast(C.REDIRECTS).alias("redirects"), F.lit(1.0).alias("duration_ms"))
    uris = frame(spark, FRAGMENTS, "uri string, expected boolean").select("uri")
    out = C.check_http(uris, C.Snapshots(http=http), LinkCheckConfig(include_fragments="full"))
    return out.select("uri", (F.col("status.kind") == S.OK).alias("valid"))


HOSTS = [("www.example.com", 2, 100), ("docs.example.org", 5, 10)]


@query(f"WITH h AS (SELECT page_id, {HOST.format(u='url')} AS host FROM pages) SELECT page_id, h.host, coalesce(c.concurrency, 10) AS concurrency, coalesce(c.interval_ms, 50) AS interval_ms FROM h LEFT JOIN {values(HOSTS, 'host, concurrency, interval_ms').replace(' AS t(', ' AS c(')} ON c.host = h.host")
def jo_10_host_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of each page's host: its own or the default ones. The table of hosts is the user's configuration, so it is broadcast."""
    own = F.broadcast(frame(spark, HOSTS, "host string, concurrency int, interval_ms int"))
    rows = table(spark, sf_dir, "pages").select("page_id", U.host_key(F.col("url")).alias("host")).join(own, "host", "left")
    return rows.select("page_id", "host", F.coalesce("concurrency", F.lit(10)).alias("concurrency"), F.coalesce("interval_ms", F.lit(50)).alias("interval_ms"))


MAIL = [("a@b.org", "success", ""), ("c@d.org", "uncertain", "greylisted"), ("e@f.org", "failure", "no such user")]
MAIL_URIS = [("mailto:a@b.org",), ("mailto:c@d.org",), ("mailto:e@f.org?subject=x",), ("mailto:g@h.org",)]


@query(f"""SELECT uri, CASE m.result WHEN 'success' THEN 'Ok' WHEN 'failure' THEN 'Error' ELSE 'UnknownMailStatus' END AS kind, CASE m.result WHEN 'success' THEN '200 OK' WHEN 'failure' THEN m.reason ELSE coalesce(m.reason, 'address is not in the snapshot') END AS details
FROM {values(MAIL_URIS, 'uri')} LEFT JOIN {values(MAIL, 'address, result, reason').replace(' AS t(', ' AS m(')} ON m.address = regexp_extract(uri, '^mailto:([^?#]*)', 1)""")
def jo_12_ck_14_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.check_mail(frame(spark, MAIL_URIS, "uri string"), frame(spark, MAIL, "address string, result string, reason string"))
    return out.select("uri", F.col("status.kind").alias("kind"), F.col("status.details").alias("details"))


@query(f"WITH {CHECKED} SELECT DISTINCT source, uri AS original, 'https://archive.org/web/' || uri AS suggestion FROM checked WHERE NOT excluded AND code = 404")
def jo_13_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived copies of failed links; the made-up archive has those that are gone, each of them twice."""
    responses = page_responses(spark, sf_dir)
    gone = responses.where("status.code = 404").select("uri").distinct()
    archive = gone.unionByName(gone).select(F.col("uri").alias("url"), F.concat(F.lit("https://archive.org/web/"), "uri").alias("suggestion"))
    return C.suggestions(responses, archive)


HOPS = [("u1", "u2", 301), ("u2", "u3", 302), ("u3", "u1", 307), ("v1", "v2", 308)]
STARTS = [("u1",), ("u2",), ("v1",), ("w",)]


@query(f"""WITH RECURSIVE r AS (SELECT * FROM {values(HOPS, 'a, b, code')}), f AS (SELECT url, url AS cur, 0 AS n, '' AS chain FROM {values(STARTS, 'url')}
  UNION ALL SELECT url, b, n + 1, chain || ' ' || code || ' ' || b FROM f JOIN r ON a = cur WHERE n < 4)
SELECT url, arg_max(cur, n) AS final_url, max(n) AS hops, arg_max(chain, n) AS chain FROM f GROUP BY url""")
def jo_14_redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects up to a limit of four."""
    out = C.redirect_chains(frame(spark, STARTS, "url string"), frame(spark, HOPS, "from_url string, to_url string, code int"), 4)
    chain = F.array_join(F.transform("redirects", lambda r: F.concat(F.lit(" "), r["code"].cast("string"), F.lit(" "), r["url"])), "")
    return out.select("url", "final_url", F.size("redirects").alias("hops"), chain.alias("chain"))


LIMITED = [("https://r.org/1", 1), ("https://r.org/10", 10), ("https://r.org/11", 11)]


@query(f"SELECT url AS uri, CASE WHEN n <= 10 THEN 'Ok' ELSE 'Error' END AS kind, CASE WHEN n <= 10 THEN 200 ELSE 302 END AS code FROM {values(LIMITED, 'url, n')}")
def ck_07_redirect_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the limit the redirect itself is the response, which default codes reject."""
    rows = frame(spark, LIMITED, "url string, n int")
    hops = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct(F.concat("url", F.lit("/"), k.cast("string")).alias("url"), F.lit(302).alias("code")))
    http = rows.select(F.lit("GET").alias("method"), F.col("url").alias("url_nofrag"), F.lit(200).alias("status"), F.lit("none").alias("error_class"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"), F.col("url").alias("final_url"), hops.alias("redirects"), F.lit(1.0).alias("duration_ms"))
    out = C.check_http(rows.select(F.col("url").alias("uri")), C.Snapshots(http=http), LinkCheckConfig())
    return out.select("uri", F.col("status.kind").alias("kind"), F.col("status.code").alias("code"))


GH = [("own", "rep", False), ("own", "hidden", True)]
GH_URIS = [("https://github.com/own/rep", 404), ("https://github.com/own/rep/issues", 404), ("https://github.com/own/hidden/x", 404), ("https://github.com/own/none", 404), ("https://github.com/own/fine", 200)]


def _http(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("GET").alias("method"), U.strip_fragment(F.col("uri")).alias("url_nofrag"), "status", F.lit("none").alias("error_class"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"), F.col("uri").alias("final_url"), F.lit(None).cast(C.REDIRECTS).alias("redirects"), F.lit(1.0).alias("duration_ms"))


@query(f"SELECT uri, CASE WHEN status = 200 OR uri IN ('https://github.com/own/rep', 'https://github.com/own/hidden/x') THEN 'Ok' ELSE 'Error' END AS kind FROM {values(GH_URIS, 'uri, status')}")
def jo_15_github_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed GitHub links that the API knows."""
    rows = frame(spark, GH_URIS, "uri string, status int")
    out = C.check_http(rows.select("uri"), C.Snapshots(http=_http(rows), github=frame(spark, GH, "owner string, repo string, private boolean")), LinkCheckConfig())
    return out.select("uri", F.col("status.kind").alias("kind"))


@query(f"""WITH c AS (SELECT DISTINCT url AS uri, regexp_replace(url, '#.*$', '') AS n FROM pages), k AS (SELECT uri, n, {CODE.format(u='n')} AS code, {CODE.format(u="regexp_replace(n, '^http:', 'https:')")} AS twin FROM c)
SELECT uri, CASE WHEN code <> 200 OR (starts_with(uri, 'http:') AND twin = 200) THEN 'Error' ELSE 'Ok' END AS kind, CASE WHEN code <> 200 THEN 'RejectedStatusCode' WHEN starts_with(uri, 'http:') AND twin = 200 THEN 'InsecureURL' END AS error_kind FROM k""")
def jo_16_require_https(spark: SparkSession, sf_dir: str) -> DataFrame:
    """http links whose https twin works are errors."""
    uris = table(spark, sf_dir, "pages").select(F.col("url").alias("uri")).distinct()
    both = uris.unionByName(uris.select(U.to_https(F.col("uri")).alias("uri"))).distinct()
    out = C.check_http(uris, C.Snapshots(http=page_snapshot(both)), LinkCheckConfig(require_https=True))
    return out.select("uri", F.col("status.kind").alias("kind"), F.col("status.error_kind").alias("error_kind"))


METHODS = [("HEAD", "https://m.org/1", 405, None), ("GET", "https://m.org/1", 200, None), ("HEAD", "https://m.org/2", 200, None), ("GET", "https://m.org/2", 500, None), ("HEAD", "https://m.org/3", None, "timeout"), ("GET", "https://m.org/3", 200, None), ("HEAD", "https://m.org/4", 404, None), ("GET", "https://m.org/4", 403, None)]


@query(f"""WITH t AS (SELECT url, CASE method WHEN 'HEAD' THEN 0 ELSE 1 END AS pos, CASE WHEN status IS NULL THEN 'Timeout' WHEN status BETWEEN 200 AND 299 THEN 'Ok' ELSE 'Error' END AS kind, status FROM {values(METHODS, 'method, url, status, error_class')})
SELECT url AS uri, coalesce(arg_min(kind, pos) FILTER (kind IN ('Ok', 'Timeout')), arg_max(kind, pos)) AS kind FROM t GROUP BY url""")
def ck_04_method_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods in order up to a success or a timeout."""
    rows = frame(spark, METHODS, "method string, url_nofrag string, status int, error_class string")
    http = rows.select("*", F.lit(None).cast("string").alias("error_message"), F.lit(None).cast(C.REDIRECTS).alias("redirects"), F.lit(1.0).alias("duration_ms"))
    out = C.check_http(rows.select(F.col("url_nofrag").alias("uri")).distinct(), C.Snapshots(http=http), LinkCheckConfig(method="head,get"))
    return out.select("uri", F.col("status.kind").alias("kind"))


ATTEMPTS = [("GET", "a", 0, 429, None), ("GET", "a", 1, 429, None), ("GET", "a", 2, 200, None), ("GET", "b", 0, 500, None), ("GET", "b", 1, 200, None), ("GET", "c", 0, None, "timeout"), ("GET", "c", 1, None, "timeout"), ("GET", "c", 2, None, "timeout"), ("GET", "c", 3, None, "timeout"), ("GET", "c", 4, 200, None)]


@query(f"""WITH t AS (SELECT *, coalesce(status = 429, TRUE) AS again FROM {values(ATTEMPTS, 'method, url, attempt, status, error_class')} WHERE attempt <= 3)
SELECT url, coalesce(min(attempt) FILTER (NOT again), max(attempt)) AS attempt FROM t GROUP BY url""")
def ck_05_retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that counts: 429s and timeouts are tried again, three times at most; a 500 is not."""
    rows = frame(spark, ATTEMPTS, "method string, url_nofrag string, attempt int, status int, error_class string")
    return C.attempts_outcome(rows, 3, S.DEFAULT_ACCEPT).select(F.col("url_nofrag").alias("url"), "attempt")


_RUN = f"""asked AS (SELECT regexp_replace(uri, '#.*$', '') AS url, row_number() OVER (PARTITION BY regexp_replace(uri, '#.*$', '') ORDER BY source, text) AS n, {BYTE.format(u="source || text")} < 64 AS body FROM requests),
k AS (SELECT url, count(*) AS n, coalesce(min(CASE WHEN body THEN n END), 0) AS b, {CODE.format(u="url")} < 429 AS stored FROM asked GROUP BY url),
keys AS (SELECT *, CASE WHEN NOT stored THEN n WHEN b > 1 THEN 2 ELSE 1 END AS misses FROM k)"""


def _run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = page_requests(spark, sf_dir)
    body = F.conv(F.substring(F.md5(F.concat("source", "text")), 1, 2), 16, 10).cast("int") < 64
    asked = requests.select(F.lit("GET").alias("method"), F.col("uri").alias("url"), body.alias("needs_body"), F.struct("source", "text").alias("seq"))
    return run_cache(asked, page_snapshot(requests).unionByName(page_snapshot(requests)))


@query(f"WITH {PAGE_LINKS}, {_RUN} SELECT url AS url_nofrag, n AS occurrences, CAST(misses AS BIGINT) AS misses, CAST(n - misses AS BIGINT) AS hits, stored FROM keys")
def ck_06_run_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a run makes of each URL and the hits of its cache, which does not keep 5xx, 408 and 429; some requests need the body."""
    return _run_keys(spark, sf_dir).select("url_nofrag", "occurrences", "misses", "hits", "stored")


@query(f"WITH {PAGE_LINKS}, {_RUN} SELECT {HOST.format(u='url')} AS host, CAST(sum(n - misses) AS BIGINT) AS cache_hits, CAST(sum(misses) AS BIGINT) AS cache_misses, count(*) FILTER (stored) AS cache_size, round(sum(n - misses) / sum(n), 9) AS cache_hit_rate FROM keys GROUP BY 1")
def ag_13_host_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hit rate of the cache of every active host."""
    return host_caches(_run_keys(spark, sf_dir)).withColumn("cache_hit_rate", F.round("cache_hit_rate", 9))


@query(f"WITH {CHECKED} SELECT uri, CASE WHEN starts_with(uri, 'http:') THEN 'Ok' ELSE 'Excluded' END AS kind FROM (SELECT DISTINCT uri FROM checked)")
def ck_15_handler_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of one plug-in; what it does not decide is excluded."""
    plain = lambda df: df.withColumn("status", F.when(F.startswith("uri", F.lit("http:")), S.make(S.OK, F.lit(200))))
    out = C.run_chain(page_requests(spark, sf_dir).select("uri").distinct(), [plain])
    return out.select("uri", F.col("status.kind").alias("kind"))


MIXED = [("https://ok.org/", 1), ("mailto:a@b.org", 2), ("tel:1", 3), ("slack://x", 4), ("file:///s/a.html", 5), ("https://gone.org/", 6), ("not a url", 7)]


@query(f"SELECT n, CASE n WHEN 1 THEN 'Ok' WHEN 2 THEN 'Ok' WHEN 3 THEN 'Excluded' WHEN 4 THEN 'Unsupported' WHEN 5 THEN 'Ok' WHEN 6 THEN 'Timeout' ELSE 'RequestError' END AS kind FROM {values(MIXED, 'text, n')}")
def ck_01_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs of all kinds through the whole check."""
    links = frame(spark, MIXED, "text string, n int").withColumn("source", F.lit("<stdin>")).withColumn("source_kind", F.lit("stdin"))
    http = _http(frame(spark, [("https://ok.org/", 200)], "uri string, status int"))
    snapshots = C.Snapshots(http=http, mail=frame(spark, MAIL, "address string, result string, reason string"), files=frame(spark, FS, FS_SCHEMA))
    return C.check(resolve.to_requests(links), snapshots, LinkCheckConfig(include_mail=True)).select("n", F.col("status.kind").alias("kind"))


@query("""WITH log AS (SELECT 'h' || CAST(user_id % 10 AS VARCHAR) AS host, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 500 ELSE 429 END AS code, ts, event_id FROM events)
SELECT host, list_reduce(list(CAST(code AS BIGINT) ORDER BY ts, event_id), lambda b, c: CASE WHEN c BETWEEN 200 AND 299 THEN 0 WHEN c = 429 THEN least(CASE WHEN b = 0 THEN 500 ELSE b * 2 END, 30000) WHEN c BETWEEN 500 AND 599 THEN least(b + 200, 10000) ELSE b END, CAST(0 AS BIGINT)) AS backoff_ms FROM log GROUP BY host""")
def ck_19_backoff_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait that each host asks for at the end of the request log."""
    from linkloom.operators.backoff import host_backoff

    return host_backoff(request_log(spark, sf_dir))
