"""Status of requests by joins with snapshots of what the network and disk would say.

``http_snapshot``: method, url_nofrag, status, error_class, error_message, headers, body,
final_url, redirects, duration_ms; others as their functions say. Every distinct URI is
checked once and joined back, so a URI that a third of all links point at is one row on
one side of that join, and AQE splits the other. Predicates that leave links out are
Columns, applied before any join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig
from linkloom.functions import fragments as FR
from linkloom.functions import rewrite as R
from linkloom.functions import status as S
from linkloom.functions import uri as U
from linkloom.operators import files
from linkloom.operators.extract.links import fragment_index, visible

REDIRECTS = "array<struct<url:string,code:int>>"
HTTP_SNAPSHOT = f"method string, url_nofrag string, status int, error_class string, error_message string, headers map<string,string>, body string, final_url string, redirects {REDIRECTS}, duration_ms double"
OUTCOME = f"uri string, status {S.STATUS}, redirects struct<origin:string,redirects:{REDIRECTS}>, duration_ms double"


@dataclass
class Snapshots:
    """What there is to join with; None means that nothing is known."""

    http: DataFrame
    mail: DataFrame | None = None
    github: DataFrame | None = None
    files: DataFrame | None = None
    documents: DataFrame | None = None  # path, file_type, content of local files
    archive: DataFrame | None = None
    cache: DataFrame | None = None
    missing: str = "timeout"  # error class of URLs that the snapshot lacks


def one_each(snapshot: DataFrame, keys: Sequence[str], columns: Sequence[str], later: Column | None = None) -> DataFrame:
    """One row for each key, so that repeated snapshot rows multiply no link: the least one, rows with ``later`` last."""
    order = F.struct((F.lit(False) if later is None else F.coalesce(later, F.lit(False))).alias("_later"), *columns)
    return snapshot.groupBy(*keys).agg(F.min(order).alias("_least")).select(*keys, *(F.col("_least")[c].alias(c) for c in columns))


def prepared(requests: DataFrame, config: LinkCheckConfig) -> DataFrame:
    """Requests with remap applied (uri, remap) and excluded, in this order."""
    out = requests.withColumn("_m", R.remapped(F.col("uri"), config.remaps)).withColumn("uri", F.col("_m.uri")).withColumn("remap", F.col("_m.remap")).drop("_m")
    return out.withColumn("excluded", F.coalesce(config.filter().is_excluded(F.col("uri")), F.lit(False)))


def attempts_outcome(attempts: DataFrame, max_retries: int, ranges: S.Ranges) -> DataFrame:
    """From an attempt log (method, url_nofrag, attempt, status, error_class): the attempt that counts.

    It is the first that is not retried, or that with which the retries end.
    """
    code = F.col("status")
    status = F.when(code.isNotNull(), S.from_code(code, ranges)).otherwise(S.from_failure(F.col("error_class"), F.col("error_class")))
    rows = attempts.where(F.col("attempt") <= max_retries).withColumn("_s", status)
    final = ~S.should_retry(F.col("_s"), F.col("error_class") == "connection_reset")
    best = F.coalesce(F.min_by(F.struct("attempt", "status", "error_class"), F.when(final, F.col("attempt"))), F.max_by(F.struct("attempt", "status", "error_class"), "attempt"))
    return rows.groupBy("method", "url_nofrag").agg(best.alias("b")).select("method", "url_nofrag", "b.*")


def retry_waits(max_retries: int, first_s: float) -> list[float]:
    """Seconds before each further attempt; they double."""
    return [first_s * 2**k for k in range(max_retries)]


def with_status(rows: DataFrame, config: LinkCheckConfig, missing: str = "timeout") -> DataFrame:
    """Snapshot rows (after a left join) with ``checked``, their status."""
    limit = config.get("max_redirects")
    followed = F.coalesce(F.size("redirects"), F.lit(0))
    failed = F.when(F.col("snapshot_method").isNull(), missing).when(F.col("error_class") != "none", F.col("error_class"))
    # beyond the limit the response to the last followed URL is a redirect itself
    code = F.when(followed > limit, F.get(F.col("redirects"), F.lit(limit))["code"]).otherwise(F.col("status"))
    rows = rows.withColumn("_failed", failed).withColumn("_code", code).withColumn("_message", F.coalesce("error_message", "error_class", F.lit("no response")))
    status = F.when(F.col("_failed").isNull(), S.from_code(F.col("_code"), config.accepted)).otherwise(S.from_failure(F.col("_failed"), F.col("_message"), F.col("status")))
    return rows.withColumn("checked", status).drop("_failed", "_code", "_message")


def check_http(uris: DataFrame, snapshots: Snapshots, config: LinkCheckConfig) -> DataFrame:
    """Outcome of distinct http(s) URIs: methods in order up to a success or a timeout, else the last one."""
    methods = config.methods
    asked = uris.select("uri", R.quirks(F.col("uri")).alias("asked")).withColumn("url_nofrag", U.strip_fragment(F.col("asked")))
    tried = asked.select("*", F.posexplode(F.array(*map(F.lit, methods))).alias("pos", "method")) if len(methods) > 1 else asked.withColumn("pos", F.lit(0)).withColumn("method", F.lit(methods[0]))
    # an answer counts before a failure
    snapshot = one_each(snapshots.http, ["method", "url_nofrag"], ["status", "error_class", "error_message", "redirects", "duration_ms"], F.col("status").isNull()).withColumn("snapshot_method", F.col("method"))
    rows = tried.join(snapshot, ["method", "url_nofrag"], "left")
    chain = F.when(F.size("redirects") > 0, F.struct(F.col("asked").alias("origin"), F.slice("redirects", 1, config.get("max_redirects")).alias("redirects")))
    rows = with_status(rows, config, snapshots.missing).withColumn("chain", chain)
    if len(methods) > 1:
        stop = S.is_success(F.col("checked")) | (F.col("checked.kind") == S.TIMEOUT)
        outcome = F.struct("asked", "checked", "chain", "duration_ms", "method")
        best = F.coalesce(F.min_by(outcome, F.when(stop, F.col("pos"))), F.max_by(outcome, "pos"))
        rows = rows.groupBy("uri").agg(best.alias("b")).select("uri", "b.*")
    out = rows.select("uri", "asked", "method", F.col("checked").alias("status"), F.col("chain").alias("redirects"), "duration_ms")
    if snapshots.github is not None:
        out = github_fallback(out, snapshots.github)
    if config.get("require_https"):
        out = require_https(out, snapshots.http, config)
    mode = config.get("include_fragments")
    if mode != "none":
        out = check_web_fragments(out, snapshots.http, mode)
    return out.select("uri", "status", F.when(F.col("asked") == F.col("uri"), F.col("redirects")).alias("redirects"), "duration_ms")


def github_fallback(outcomes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Failed GitHub URIs of a known public repository (owner, repo, private) without an endpoint are fine; else the first status stays."""
    known = repositories.groupBy(F.col("owner").alias("g_owner"), F.col("repo").alias("g_repo")).agg(F.bool_or("private").alias("g_private"))
    rows = outcomes.withColumn("_g", F.when(~S.is_success(F.col("status")), U.github(F.col("uri"))))
    rows = rows.join(known, (F.col("_g.owner") == F.col("g_owner")) & (F.col("_g.repo") == F.col("g_repo")), "left")
    fine = S.make(S.OK, F.lit(200), text=S.code_text(F.lit(200)), details=S.code_text(F.lit(200)))
    found = F.col("g_private").isNotNull() & (F.col("g_private") | F.col("_g.endpoint").isNull())
    return rows.withColumn("status", F.when(found, fine).otherwise(F.col("status"))).select(*outcomes.columns)


def require_https(outcomes: DataFrame, http: DataFrame, config: LinkCheckConfig) -> DataFrame:
    """An http URI that is fine is an error where its https twin is fine too."""
    twins = http.where((F.col("method") == config.methods[0]) & S.accepted(F.col("status"), config.accepted) & (F.coalesce("error_class", F.lit("none")) == "none")).select(F.col("url_nofrag").alias("twin")).distinct()
    plain = S.is_success(F.col("status")) & F.startswith("uri", F.lit("http:"))
    rows = outcomes.withColumn("_t", F.when(plain, U.strip_fragment(U.to_https(F.col("asked"))))).join(twins, F.col("_t") == F.col("twin"), "left")
    text = F.concat(F.lit("Insecure HTTP URL used, where '"), U.to_https(F.col("uri")), F.lit("' can be used instead"))
    return rows.withColumn("status", F.when(F.col("twin").isNotNull(), S.make(S.ERROR, None, F.lit("InsecureURL"), text, text)).otherwise(F.col("status"))).select(*outcomes.columns)


def document_type(headers: Column, url: Column) -> Column:
    """Type of a response whose fragments can be checked, else null."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit("text/html")), F.lit(";"), F.lit(1))))
    is_md = U.path(url).rlike(r"(?i)\.md$")
    return F.when(kind == "text/html", "html").when(kind == "text/markdown", "markdown").when((kind == "text/plain") & is_md, "markdown")


def fragment_verdict(links: DataFrame, documents: DataFrame, anchors: bool, texts: bool) -> DataFrame:
    """Links (link, key, fragment, uri) against documents (key, file_type, content): link and valid.

    Only documents that a link with a fragment asks for are parsed, each once, and the
    body goes to Python in the task that reads it.
    """
    asked = links.where(~FR.passes_always(F.col("fragment")))
    needed = one_each(documents.join(asked.select("key").distinct(), "key", "left_semi"), ["key"], ["file_type", "content"])
    indexed = fragment_index(needed.withColumn("shown", visible(F.when(F.col("file_type") == "html", F.col("content")))) if texts else needed.withColumn("shown", F.lit("")))
    rows = asked.join(indexed.withColumnRenamed("file_type", "doc_type"), "key", "left")
    ids = F.array_compact(F.array(F.lit(None).cast("string")))
    element = FR.element_id(F.col("fragment"))
    wanted = F.coalesce(FR.candidates(F.col("uri"), element, F.coalesce(F.col("doc_type") == "markdown", F.lit(False))), ids)
    anchor = FR.passes_always(element) | ~F.coalesce(F.col("doc_type").isin("html", "markdown"), F.lit(False)) | F.arrays_overlap(wanted, F.coalesce("fragments", ids))
    directives = FR.text_directives(F.col("fragment"))
    text = (F.size(directives) == 0) | ~F.coalesce(F.col("doc_type") == "html", F.lit(False)) | FR.directives_match(directives, F.coalesce("shown", F.lit("")))
    valid = (anchor if anchors else F.lit(True)) & (text if texts else F.lit(True))
    return rows.select("link", F.coalesce(valid, F.lit(False)).alias("valid"))


def _invalid_fragment() -> Column:
    text = F.lit("Cannot find fragment")
    return S.make(S.ERROR, None, F.lit("InvalidFragment"), text, text)


def check_web_fragments(outcomes: DataFrame, http: DataFrame, mode: str) -> DataFrame:
    """Fragments of URIs whose GET was answered 2xx with a document."""
    kind = document_type(F.col("headers"), F.col("url_nofrag"))
    documents = http.where((F.col("method") == "GET") & F.col("status").between(200, 299)).select(F.col("url_nofrag").alias("key"), kind.alias("file_type"), F.col("body").alias("content")).where("file_type is not null")
    links = outcomes.where((F.col("method") == "GET") & S.is_success(F.col("status"))).select(F.col("uri").alias("link"), U.strip_fragment(F.col("asked")).alias("key"), U.fragment(F.col("asked")).alias("fragment"), F.col("asked").alias("uri"))
    verdict = fragment_verdict(links.where("fragment is not null"), documents, mode in ("anchor-only", "full"), mode in ("text-only", "full"))
    rows = outcomes.join(verdict.where("not valid").select(F.col("link").alias("uri"), "valid"), "uri", "left")
    return rows.withColumn("status", F.when(~F.col("valid"), _invalid_fragment()).otherwise(F.col("status"))).select(*outcomes.columns)


def check_files(uris: DataFrame, snapshots: Snapshots, config: LinkCheckConfig) -> DataFrame:
    """Outcome of distinct file URIs by an index of files."""
    rows = uris.withColumn("path", files.path_of(F.col("uri"))).withColumn("fragment", U.fragment(F.col("uri")))
    hits = files.resolve_paths(rows, snapshots.files, config.fallback_extensions, config.index_files)
    rows = rows.join(hits, "path", "left")
    fine = S.make(S.OK, F.lit(200), text=S.code_text(F.lit(200)), details=S.code_text(F.lit(200)))
    names = config.index_files or ()
    how = "Directory links are rejected because index_files is empty" if not names else f"An index file ({names[0] if len(names) == 1 else ', '.join(names[:-1]) + ', or ' + names[-1]}) is required"
    no_file = "File not found. Check if file exists and path is correct"
    no_index = "Cannot find index file within directory"
    status = (
        F.when(F.col("error_kind") == "InvalidFilePath", S.make(S.ERROR, None, F.col("error_kind"), F.lit(no_file), F.lit(no_file)))
        .when(F.col("error_kind") == "InvalidIndexFile", S.make(S.ERROR, None, F.col("error_kind"), F.lit(no_index), F.lit(f"{no_index}: {how}")))
        .otherwise(fine)
    )
    rows = rows.withColumn("status", status)
    if config.get("include_fragments") in ("anchor-only", "full") and snapshots.documents is not None:
        links = rows.where(S.is_success(F.col("status")) & F.col("fragment").isNotNull())
        verdict = fragment_verdict(links.where("not found_is_dir").select(F.col("uri").alias("link"), F.col("found").alias("key"), "fragment", "uri"), snapshots.documents.select(F.col("path").alias("key"), "file_type", "content"), True, config.get("include_fragments") == "full")
        rows = rows.join(verdict.where("not valid").select(F.col("link").alias("uri"), "valid"), "uri", "left")
        # a directory has no ids
        bad = ~F.coalesce("valid", F.lit(True)) | (S.is_success(F.col("status")) & F.col("found_is_dir") & (F.length("fragment") > 0))
        rows = rows.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), _invalid_fragment()).otherwise(F.col("status")))
    return rows.select("uri", "status", F.lit(None).cast(f"struct<origin:string,redirects:{REDIRECTS}>").alias("redirects"), F.lit(None).cast("double").alias("duration_ms"))


def check_mail(uris: DataFrame, mail: DataFrame | None) -> DataFrame:
    """Outcome of distinct mailto URIs by ``mail`` (address, result, reason)."""
    none = F.lit(None).cast(f"struct<origin:string,redirects:{REDIRECTS}>").alias("redirects")
    rows = uris.withColumn("address", U.path(F.col("uri")))
    if mail is None:
        rows = rows.withColumn("result", F.lit("uncertain")).withColumn("reason", F.lit("address is not in the snapshot"))
    else:
        rows = rows.join(one_each(mail, ["address"], ["result", "reason"]), "address", "left").withColumn("reason", F.when(F.col("result").isNull(), "address is not in the snapshot").otherwise(F.col("reason"))).withColumn("result", F.coalesce("result", F.lit("uncertain")))
    return rows.select("uri", S.mail_status(F.col("result"), F.col("reason")).alias("status"), none, F.lit(None).cast("double").alias("duration_ms"))


def unsupported(uris: DataFrame) -> DataFrame:
    """Outcome of URIs of all other schemes."""
    none = F.lit(None).cast(f"struct<origin:string,redirects:{REDIRECTS}>").alias("redirects")
    text = F.concat(F.lit("Unsupported: Failed to create HTTP request client: builder error for url ("), F.col("uri"), F.lit(")"))
    return uris.select("uri", S.make(S.UNSUPPORTED, None, F.lit("BuildRequestClient"), text, text).alias("status"), none, F.lit(None).cast("double").alias("duration_ms"))


Handler = Callable[[DataFrame], DataFrame]


def run_chain(requests: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    """Plug-ins in turn: each gets the requests (with a nullable status) and may set the status of those that have none.

    What no handler has decided is excluded.
    """
    out = requests if "status" in requests.columns else requests.withColumn("status", F.lit(None).cast(S.STATUS))
    for handle in handlers:
        before = out.withColumnRenamed("status", "_before")
        out = handle(before.withColumn("status", F.col("_before"))).withColumn("status", F.coalesce("_before", "status")).drop("_before")
    text, details = F.lit("Excluded"), F.lit("This is due to your 'exclude' values")
    return out.withColumn("status", F.coalesce("status", S.make(S.EXCLUDED, text=text, details=details)))


def check(requests: DataFrame, snapshots: Snapshots, config: LinkCheckConfig) -> DataFrame:
    """Responses of requests (source, source_kind, uri, error_kind, error_text, span and more).

    Adds status, redirects, remap, duration_ms; error rows get the URI ``error:``. The
    requests are read twice, for their distinct URIs and for the rows; where making them
    is costly, pass them as a stored table (``plans.pipeline.check_links(store=...)``).
    """
    from linkloom.operators import cache as C

    rows = prepared(requests, config)
    # the scheme as an aggregate, so that the branches below filter above one exchange, which Spark then makes once
    todo = rows.where("uri is not null and not excluded").groupBy("uri").agg(F.max(U.scheme(F.col("uri"))).alias("scheme"))
    cached = None
    if snapshots.cache is not None:
        hits = todo.select("uri").join(C.latest(snapshots.cache).select("uri", F.col("status").alias("stored")), "uri")
        cached = hits.select("uri", S.from_cache(S.cache_kind(F.col("stored")), config.accepted).alias("status"), F.lit(None).cast(f"struct<origin:string,redirects:{REDIRECTS}>").alias("redirects"), F.lit(None).cast("double").alias("duration_ms"))
        todo = C.misses(todo, snapshots.cache)
    of = lambda test: todo.where(test).select("uri")
    scheme = F.col("scheme")
    parts = [check_http(of(scheme.isin("http", "https")), snapshots, config), check_mail(of(scheme == "mailto"), snapshots.mail)]
    known = ["http", "https", "mailto"]
    if snapshots.files is not None:
        parts.append(check_files(of(scheme == "file"), snapshots, config))
        known.append("file")
    parts.append(unsupported(of(~scheme.isin(known))))
    if cached is not None:
        parts.append(cached)
    outcomes = parts[0]
    for p in parts[1:]:
        outcomes = outcomes.unionByName(p)
    known = outcomes.select(F.col("uri").alias("_uri"), F.col("status").alias("_status"), F.col("redirects").alias("_redirects"), F.col("duration_ms").alias("_duration"))
    joined = rows.join(known, F.col("uri") == F.col("_uri"), "left")
    text, details = F.lit("Excluded"), F.lit("This is due to your 'exclude' values")
    why = F.when((F.col("error_kind") == "ParseUrl") & F.endswith("error_text", F.lit("relative URL without a base")), F.concat("error_text", F.lit(": This relative link was found inside an input source that has no base location"))).otherwise(F.col("error_text"))
    status = (
        F.when(F.col("error_kind").isNotNull(), S.make(S.REQUEST_ERROR, None, F.col("error_kind"), F.col("error_text"), why))
        .when(F.col("excluded"), S.make(S.EXCLUDED, text=text, details=details))
        .otherwise(F.col("_status"))
    )
    out = joined.withColumn("status", status).withColumn("redirects", F.col("_redirects")).withColumn("duration_ms", F.col("_duration"))
    out = out.withColumn("remap", F.when(~F.coalesce(F.col("status.cached"), F.lit(False)), F.col("remap"))).withColumn("uri", F.coalesce("uri", F.lit("error:")))
    return out.drop("_uri", "_status", "_redirects", "_duration", "excluded", "error_kind", "error_text")


def redirect_chains(starts: DataFrame, redirects: DataFrame, max_redirects: int = 10) -> DataFrame:
    """Follows a table (from_url, to_url, code) from each distinct url: url, redirects, final_url. ``max_redirects`` equi joins at most."""
    hops = redirects.groupBy(F.col("from_url").alias("_from")).agg(F.min(F.struct(F.col("to_url").alias("url"), F.col("code").cast("int").alias("code"))).alias("_hop"))
    rows = starts.select("url").distinct().withColumn("redirects", F.array().cast(REDIRECTS)).withColumn("final_url", F.col("url"))
    for _ in range(max_redirects):
        rows = rows.join(hops, F.col("final_url") == F.col("_from"), "left")
        rows = rows.select("url", F.when(F.col("_hop").isNotNull(), F.array_append("redirects", F.col("_hop"))).otherwise(F.col("redirects")).alias("redirects"), F.coalesce("_hop.url", "final_url").alias("final_url"))
    return rows


def suggestions(responses: DataFrame, archive: DataFrame) -> DataFrame:
    """Archived copies (url, suggestion) of failed links: source, original, suggestion. Timeouts, data, mail and file links have none."""
    failed = responses.where(F.col("status.kind").isin(S.ERROR, S.REQUEST_ERROR) & ~F.coalesce(U.scheme(F.col("uri")).isin("data", "mailto", "file"), F.lit(False)) & (F.col("uri") != "error:"))
    found = failed.select("source", F.col("uri").alias("url")).distinct().join(archive.groupBy("url").agg(F.max("suggestion").alias("suggestion")).where("suggestion is not null"), "url")
    return found.select("source", F.col("url").alias("original"), "suggestion")
