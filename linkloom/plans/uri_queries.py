"""Queries over URIs: parts, classes, rewriting, filters, status codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import filters as FI
from linkloom.functions import rewrite as R
from linkloom.functions import status as S
from linkloom.functions import uri as U
from linkloom.operators import resolve
from linkloom.plans.literals import CODE, EXAMPLE, HOST, PAGE_LINKS, PATH, SCHEME, URIS, frame, page_requests, values
from linkloom.session import table



def u():
    return F.col("uri")


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"))


def uris(spark: SparkSession) -> DataFrame:
    return frame(spark, URIS, "uri string")


TEXTS = [("http://a.org/x",), ("//a.org/x",), ("/root",), ("local/x",), ("#f",), (" /padded",), ("mailto:x@y.z",), ("?q=1",), ("C:/x",), ("",)]
RELATIVE = "CASE WHEN regexp_matches(ltrim({t}, ' \t\n'), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute' WHEN starts_with(ltrim({t}, ' \t\n'), '//') THEN 'scheme' WHEN starts_with(ltrim({t}, ' \t\n'), '/') THEN 'root' ELSE 'local' END"


@query(f"SELECT text, {RELATIVE.format(t='text')} AS class FROM {values(TEXTS, 'text')} UNION ALL SELECT text, {RELATIVE.format(t='text')} FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS text FROM pages)")
def pr_02_uri_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute, scheme-relative, root-relative or local link texts."""
    rows = frame(spark, TEXTS, "text string").unionByName(page_requests(spark, sf_dir).select("text"))
    return rows.select("text", U.uri_class(F.col("text")).alias("class"))


@query("SELECT page_id, 'full' AS kind, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS origin, regexp_replace(substr(url, length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) + 1), '^/', '') AS path FROM pages")
def pr_03_base_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base of the links of every page."""
    rows = page_urls(spark, sf_dir)
    return rows.select("page_id", resolve.base_of_source(u(), F.lit("url")).alias("b")).select("page_id", "b.kind", "b.origin", "b.path")


@query("SELECT page_id, 'full' AS kind, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) ELSE 'https://base.org' END || '/' AS origin FROM pages")
def pr_05_base_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base URL takes the place of a file's base, not of a page's."""
    kind = F.when(F.col("page_id") % 2 == 0, "url").otherwise("file")
    source = F.when(F.col("page_id") % 2 == 0, u()).otherwise(F.concat(F.lit("file:///x/"), F.col("page_id").cast("string")))
    base = resolve.fallback(resolve.base_of_source(source, kind), resolve.base_from_text("https://base.org/dir/"))
    return page_urls(spark, sf_dir).select("page_id", base.alias("b")).select("page_id", "b.kind", "b.origin")


@query(f"WITH {PAGE_LINKS} SELECT source, text, uri FROM requests")
def pr_06_resolve_root_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute URIs of all links of pages."""
    return page_requests(spark, sf_dir).select("source", "text", "uri")


ROOT_DIR = [("file:///d/a.md", "/x"), ("file:///d/a.md", "x"), ("https://h.org/p/", "/x")]


@query(f"SELECT source, text, CASE WHEN starts_with(source, 'https:') THEN 'https://h.org/x' WHEN text = '/x' THEN 'file:///site/x' ELSE 'file:///d/x' END AS uri FROM {values(ROOT_DIR, 'source, text')}")
def pr_07_root_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root folder holds for root-relative links of files only."""
    rows = frame(spark, ROOT_DIR, "source string, text string").withColumn("source_kind", F.when(F.startswith("source", F.lit("file:")), "file").otherwise("url"))
    return resolve.to_requests(rows, root_dir="/site").select("source", "text", "uri")


FILES = [("file:///a/b/",), ("file:///a/b",), ("file:///",), ("https://a.org/b/",), ("file:///a/b/?q",)]


@query(f"SELECT uri, regexp_replace(uri, '^(file:[^?#]*[^/?#])/($|[?#])', '\\1\\2') AS shown FROM {values(FILES, 'uri')}")
def pr_09_file_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, FILES, "uri string").select("uri", U.without_empty_segment(u()).alias("shown"))


REMAPS = ("^http://(.*)$ https://$1", r"\.example\.com/ .mirror.org/", "#top$ #begin")


@query(r"""SELECT page_id, url AS original, CASE WHEN regexp_matches(url, '^http://(.*)$') THEN regexp_replace(url, '^http://(.*)$', 'https://\1', 'g')
  WHEN regexp_matches(url, '\.example\.com/') THEN regexp_replace(url, '\.example\.com/', '.mirror.org/', 'g')
  WHEN regexp_matches(url, '#top$') THEN regexp_replace(url, '#top$', '#begin', 'g') END AS remapped FROM pages""")
def pr_11_remap_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three rules that matches."""
    rules = [R.parse_remap(r) for r in REMAPS]
    return page_urls(spark, sf_dir).select("page_id", F.col("uri").alias("original"), R.remap(u(), rules).alias("remapped"))


QUIRKY = [("https://www.youtube.com/watch?v=abc&t=1",), ("https://youtube-nocookie.com/embed/xyz",), ("https://www.youtube.com/about",), ("https://youtu.be/id7",), ("https://youtu.be/",), ("https://github.com/u/r/blob/main/a.rs#L10-L20",), ("https://github.com/u/r/blob/main/d/R.md#top",), ("https://github.com/u/r/blob/main/R.md",), ("https://crates.io/crates/x",)]


@query(rf"""SELECT uri, CASE
  WHEN regexp_matches(uri, 'youtube(-nocookie)?\.com/watch') THEN 'https://img.youtube.com/vi/' || regexp_extract(uri, '[?&]v=([^&]*)', 1) || '/0.jpg'
  WHEN regexp_matches(uri, 'youtube(-nocookie)?\.com/embed/') THEN 'https://img.youtube.com/vi/' || regexp_extract(uri, '/embed/(.*)$', 1) || '/0.jpg'
  WHEN regexp_matches(uri, 'youtu\.be/.') THEN 'https://img.youtube.com/vi/' || regexp_extract(uri, 'youtu\.be/(.*)$', 1) || '/0.jpg'
  WHEN regexp_matches(uri, '#L\d+') THEN regexp_replace(uri, '#.*$', '')
  ELSE regexp_replace(uri, '^https://github\.com/(.*?)/(.*?)/blob/(.*?)/(.*\.(?:md|markdown)#.*)$', 'https://raw.githubusercontent.com/\1/\2/\3/\4') END AS asked,
  CASE WHEN regexp_matches(uri, '^(https?://)?(www\.)?crates.io') THEN 'text/html' END AS accept FROM {values(QUIRKY, 'uri')}""")
def pr_12_17_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL that is asked for, and the Accept header that a quirk adds."""
    return frame(spark, QUIRKY, "uri string").select("uri", R.quirks(u()).alias("asked"), F.try_element_at(R.quirk_headers(u()), F.lit("accept")).alias("accept"))


GITHUB = [("https://github.com/own/rep",), ("https://www.github.com/own/rep.git/issues/1",), ("https://github.com/pricing/x",), ("https://github.com/own",), ("https://gitlab.com/own/rep",), ("https://raw.githubusercontent.com/o/r/main/x.md",), ("https://github.com/own/rep/",)]


@query(rf"""WITH s AS (SELECT uri, {HOST.format(u='uri')} AS host, string_split(regexp_replace({PATH.format(u='uri')}, '^/', ''), '/') AS p FROM {values(GITHUB, 'uri')}),
  g AS (SELECT *, host IN ('github.com', 'www.github.com', 'raw.githubusercontent.com') AND len(p) >= 2 AND p[1] NOT IN ('about','collections','events','explore','features','issues','marketplace','new','notifications','pricing','pulls','sponsors','topics','watching') AS ok FROM s)
SELECT uri, CASE WHEN ok THEN p[1] END AS owner, CASE WHEN ok THEN regexp_replace(p[2], '\.git$', '') END AS repo, CASE WHEN ok THEN nullif(array_to_string(p[3:], '/'), '') END AS endpoint FROM g""")
def pr_18_github_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, GITHUB, "uri string").select("uri", U.github(u()).alias("g")).select("uri", "g.owner", "g.repo", "g.endpoint")


@query("SELECT page_id, regexp_replace(url, '^http:', 'https:') AS https FROM pages")
def pr_19_to_https(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select("page_id", U.to_https(u()).alias("https"))


@query(f"SELECT page_id, {HOST.format(u='url')} AS host FROM pages")
def pr_20_host_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select("page_id", U.host_key(u()).alias("host"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url_nofrag FROM pages")
def pr_21_strip_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).select("page_id", U.strip_fragment(u()).alias("url_nofrag"))


SELECTORS = (r"\.example\.com/ ann:secret", "^http: bob:pass")


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '\.example\.com/') THEN 'Basic ' || to_base64('ann:secret'::BLOB) WHEN regexp_matches(url, '^http:') THEN 'Basic ' || to_base64('bob:pass'::BLOB) END AS authorization FROM pages")
def pr_22_basic_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of the first selector that matches."""
    return page_urls(spark, sf_dir).select("page_id", R.basic_auth(u(), [R.parse_basic_auth(s) for s in SELECTORS]).alias("authorization"))


@query(f"SELECT page_id, 'a/1' AS user_agent, CASE WHEN {HOST.format(u='url')} LIKE '%.com' THEN 'host' ELSE 'all' END AS x_one FROM pages")
def pr_23_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom headers, the user agent, and headers of a host on top."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    own = F.when(F.endswith(U.host(u()), F.lit(".com")), F.create_map(F.lit("x-one"), F.lit("host")))
    merged = R.headers({"X-One": "all", "User-Agent": "z"}, "a/1", own)
    return page_urls(spark, sf_dir).select("page_id", merged.alias("h")).select("page_id", F.col("h")["user-agent"].alias("user_agent"), F.col("h")["x-one"].alias("x_one"))


def _flag(name: str, column, sql: str) -> None:
    """A filter as a query over page URLs and literal URIs."""
    rows = f"(SELECT url AS uri FROM pages UNION ALL SELECT uri FROM {values(URIS, 'uri')})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page_urls(spark, sf_dir).select("uri").unionByName(uris(spark)).select("uri", column(u()).alias("excluded"))

    run.__name__ = name
    query(f"SELECT uri, coalesce({sql}, FALSE) AS excluded FROM {rows}")(run)


_host = HOST.format(u="uri")
_flag("fi_01_scheme", lambda c: FI.is_scheme_excluded(c, ["https", "file"]), f"coalesce({SCHEME.format(u='uri')} NOT IN ('https', 'file'), TRUE)")
_flag("fi_02_mail", FI.is_mail, f"{SCHEME.format(u='uri')} = 'mailto'")
_flag("fi_03_tel", FI.is_tel, f"{SCHEME.format(u='uri')} = 'tel'")
_flag("fi_04_localhost", FI.is_local_name, f"{_host} = 'localhost'")
_flag("fi_05_loopback", FI.is_loopback, rf"regexp_matches({_host}, '^127\.\d+\.\d+\.\d+$') OR {_host} = '[::1]'")
_flag("fi_06_private", FI.is_private, rf"regexp_matches({_host}, '^(10\.\d+|172\.(1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+$') OR regexp_matches({_host}, '^\[f[cd][0-9a-f][0-9a-f]:')")
_flag("fi_07_link_local", FI.is_link_local, rf"regexp_matches({_host}, '^169\.254\.\d+\.\d+$') OR regexp_matches({_host}, '^\[fe[89ab]')")
_mail_example = r"regexp_matches(uri, 'example\.(com|org|net|edu)$')"
_flag("fi_09_example", FI.is_example, f"CASE WHEN {SCHEME.format(u='uri')} = 'mailto' THEN {_mail_example} ELSE {EXAMPLE.format(u='uri')} END")
_flag("fi_10_unsupported", FI.is_unsupported, f"ends_with({_host}, 'twitter.com')")
_false_positive = r"regexp_matches(uri, '^https?://(schemas\.(openxmlformats\.org|microsoft\.com|zune\.net)|www\.w3\.org/(1999/xhtml|1999/xlink|2000/svg|2001/XMLSchema-instance)|ogp\.me/ns#)|^https?://(.*)/xmlrpc\.php$')"
_flag("fi_12_false_positive", FI.is_false_positive, _false_positive)
_flag("fi_13_regex_set", lambda c: FI.matches_any(c, ["^http:", r"\.org/"]), r"regexp_matches(uri, '^http:|\.org/')")


TRUTH = [("none", (), ()), ("includes", ("^https:",), ()), ("excludes", (), (r"\.org",)), ("both", (r"\.com",), ("^http:", r"\.org"))]
_hard = f"(CASE WHEN {SCHEME.format(u='uri')} = 'mailto' THEN TRUE ELSE {EXAMPLE.format(u='uri')} END OR coalesce({SCHEME.format(u='uri')} = 'tel', FALSE) OR coalesce(ends_with({_host}, 'twitter.com'), FALSE))"
_rows = f"(SELECT url AS uri FROM pages UNION ALL SELECT uri FROM {values(URIS, 'uri')})"


@query(
    " UNION ALL ".join(
        [
            f"SELECT 'none' AS config, uri, {_hard} OR {_false_positive} AS excluded FROM {_rows}",
            f"SELECT 'includes', uri, {_hard} OR NOT regexp_matches(uri, '^https:') FROM {_rows}",
            rf"SELECT 'excludes', uri, {_hard} OR {_false_positive} OR regexp_matches(uri, '\.org') FROM {_rows}",
            rf"SELECT 'both', uri, {_hard} OR (NOT regexp_matches(uri, '\.com') AND ({_false_positive} OR regexp_matches(uri, '^http:|\.org'))) FROM {_rows}",
        ]
    )
)
def fi_11_filter_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined filter with and without includes and excludes."""
    rows = page_urls(spark, sf_dir).select("uri").unionByName(uris(spark))
    flags = F.array(*(F.struct(F.lit(n).alias("config"), FI.LinkFilter(includes=i, excludes=x).is_excluded(u()).alias("excluded")) for n, i, x in TRUTH))
    return rows.select("uri", F.explode(flags).alias("f")).select("f.config", "uri", "f.excluded")


@query("SELECT code, code BETWEEN 100 AND 103 OR code BETWEEN 200 AND 299 AS by_default, code BETWEEN 200 AND 203 OR code BETWEEN 300 AND 399 OR code = 404 OR code >= 520 AS chosen, code BETWEEN 500 AND 599 OR code IN (408, 429) AS retryable FROM (SELECT unnest(range(100, 600)) AS code)")
def fi_14_17_status_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default and chosen ranges of accepted codes, and codes that are asked for again."""
    code = F.col("id")
    return spark.range(100, 600).select(code.alias("code"), S.accepted(code).alias("by_default"), S.accepted(code, S.parse_ranges("200..204,300..=399,404,520..")).alias("chosen"), S.retryable_code(code).alias("retryable"))


@query(f"""WITH log AS (SELECT event_id, {'CASE event_type' + " WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 500 ELSE 429 END"} AS code FROM events)
SELECT event_id, code, CASE WHEN code = 200 THEN 'success' ELSE 'error' END AS class, code = 429 AS retried FROM log""")
def fi_18_19_retry_and_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each response of the request log, and whether its check is tried again (a rejected 500 is not)."""
    code = F.when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 500).otherwise(429)
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("code")).withColumn("s", S.from_code(F.col("code")))
    return rows.select("event_id", "code", S.status_class(F.col("s")).alias("class"), S.should_retry(F.col("s")).alias("retried"))


@query(f"WITH {PAGE_LINKS}, c AS (SELECT uri, {CODE.format(u='uri')} AS code FROM requests) SELECT uri, code, code = 200 AS ok, CASE WHEN code = 200 THEN '200 OK' ELSE 'Rejected status code: ' || code || ' ' || CASE code WHEN 404 THEN 'Not Found' WHEN 429 THEN 'Too Many Requests' ELSE 'Internal Server Error' END END AS text FROM c")
def ck_02_status_from_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a code, with its text."""
    b = F.conv(F.substring(F.md5("uri"), 1, 2), 16, 10).cast("int")
    rows = page_requests(spark, sf_dir).select("uri", F.when(b < 200, 200).when(b < 230, 404).when(b < 245, 429).otherwise(500).alias("code"))
    return rows.withColumn("s", S.from_code(F.col("code"))).select("uri", "code", S.is_success(F.col("s")).alias("ok"), F.col("s.text").alias("text"))


FAILURES = [("timeout", "x"), ("no_host", "x"), ("builder", "bad"), ("body", "cut"), ("decode", "gz"), ("connect", "tcp: Connection refused (os error 111)"), ("connect", "invalid peer certificate: UnknownIssuer"), ("connect", "certificate has expired"), ("connect", "dns error: failed to lookup address information"), ("connect", "Connection reset by peer"), ("connect", "something else")]


@query(f"""SELECT error_class, message, CASE error_class WHEN 'timeout' THEN 'Timeout' WHEN 'connect' THEN 'Error' ELSE 'Unsupported' END AS kind,
  CASE WHEN error_class = 'connect' THEN CASE WHEN contains(message, 'UnknownIssuer') THEN 'SSL certificate not trusted. Use --insecure if site is trusted' WHEN contains(message, 'expired') THEN 'SSL certificate expired. Site needs to renew certificate'
    WHEN contains(message, 'lookup') THEN 'DNS resolution failed. Check hostname and DNS settings' WHEN contains(message, 'refused') THEN 'Connection refused. Server is not accepting connections (check if service is running)'
    WHEN contains(message, 'reset') THEN 'Connection reset by server. Server forcibly closed connection' ELSE 'Request failed: ' || message END END AS advice FROM {values(FAILURES, 'error_class, message')}""")
def ck_03_17_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of failed requests by class, and advice for network errors by their message."""
    rows = frame(spark, FAILURES, "error_class string, message string").withColumn("s", S.from_failure(F.col("error_class"), F.col("message")))
    return rows.select("error_class", "message", F.col("s.kind").alias("kind"), F.when(F.col("error_class") == "connect", F.col("s.details")).alias("advice"))
