"""From raw links to requests: absolute URIs, or an error row with its reason.

Links that parsing would leave as they are never reach Python; the rest go through the
URL parser in one Arrow UDF.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import uri as U
from linkloom.functions import whatwg
from linkloom.functions.whatwg import Url, UrlError
from linkloom.operators.extract.batches import joined, pieces, values
from linkloom.operators.extract.linkfinder import is_email_link

BASE = "struct<kind:string,origin:string,path:string>"
RESOLVED = "struct<uri:string,error_kind:string,error_text:string>"
_RESOLVED = pa.struct([("uri", pa.string()), ("error_kind", pa.string()), ("error_text", pa.string())])
_LEFT: dict[str, str] = {}  # of a text that is left as it is


def base_of_source(source: Column, source_kind: Column) -> Column:
    """Base of the links in a document: none for text and standard input, no root for files, full for URLs."""
    remote = (source_kind == "url") & source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    is_file = source_kind.isin("file", "url") & source.rlike("^file:")
    origin = F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    none = F.lit(None).cast("string")
    return (
        F.when(is_file, F.struct(F.lit("no_root").alias("kind"), source.alias("origin"), F.lit("").alias("path")))
        .when(remote, F.struct(F.lit("full").alias("kind"), F.concat(origin, F.lit("/")).alias("origin"), F.regexp_replace(F.substring(source, F.length(origin) + 1, F.length(source)), "^/", "").alias("path")))
        .otherwise(F.struct(F.lit("none").alias("kind"), none.alias("origin"), none.alias("path")))
    )


def base_from_text(text: str) -> tuple[str, str, str]:
    """A base URL or absolute directory that the user names, as (kind, origin, path)."""
    if text.startswith("/"):
        directory = text if text.endswith("/") else text + "/"
        return "full", str(whatwg.parse("file://" + directory)), ""
    try:
        url = whatwg.parse(text)
    except UrlError as e:
        raise ValueError(f"Invalid base URL or directory: '{text}'. {e}") from None
    if url.opaque:
        raise ValueError(f"Invalid base URL or directory: '{text}'. The given URL cannot be used as a base URL")
    if url.scheme == "file":
        return "no_root", str(url), ""
    root = Url(url.scheme, url.username, url.password, url.host, url.port, ("",))
    return "full", str(root), str(url)[len(str(root)) :]


def with_root_dir(base: tuple[str, str, str] | None, root_dir: str | None) -> tuple[str, str, str] | None:
    """A root folder and a base inside it: the base becomes a path under the root."""
    if base is None or root_dir is None or not base[1].startswith("file:"):
        return base
    root = str(whatwg.parse("file://" + (root_dir if root_dir.endswith("/") else root_dir + "/")))
    path = whatwg.make_relative(whatwg.parse(root), whatwg.parse(base[1]))
    return base if path is None else ("full", root, path)


def fallback(first: Column, second: tuple[str, str, str] | None) -> Column:
    """The better of two bases: full before no_root before none; of equal ones the first."""
    if second is None:
        return first
    other = F.struct(F.lit(second[0]).alias("kind"), F.lit(second[1]).alias("origin"), F.lit(second[2]).alias("path"))
    rank = lambda c: F.when(c["kind"] == "full", 2).when(c["kind"] == "no_root", 1).otherwise(0)
    return F.when(rank(first) >= rank(other), first).otherwise(other)


def _without_empty_segment(url: Url) -> Url:
    if url.scheme == "file" and not url.opaque and len(url.path) > 1 and url.path[-1] == "":
        return whatwg.replace(url, path=url.path[:-1])
    return url


def _base(text: str, known: dict[str, Url]) -> Url:
    """A base parsed once for each batch."""
    if text not in known:
        known[text] = whatwg.parse(text)
    return known[text]


def resolve_text(text: str, kind: str, origin: str | None, path: str | None, root_dir: str | None = None, known: dict[str, Url] | None = None) -> Url:
    """The URL of a link text; raises UrlError, or LookupError for a root-relative link without a root."""
    known = {} if known is None else known
    bare = text.lstrip(" \t\n\f\r")
    if not bare.strip():
        raise UrlError("empty")
    try:
        return whatwg.parse(text)
    except UrlError as e:
        if str(e) != "relative URL without a base":
            raise
        if is_email_link(bare.strip()):
            return whatwg.parse("mailto:" + bare.strip())
    rooted = bare.startswith("/") and not bare.startswith("//")
    if rooted and root_dir and (kind == "none" or (origin or "").startswith("file:")):
        return whatwg.parse("." + bare, _base("file://" + (root_dir if root_dir.endswith("/") else root_dir + "/"), known))
    if kind == "none" or not origin:
        raise UrlError("relative URL without a base")
    start = _base(origin, known)
    if kind == "no_root":
        if rooted:
            raise LookupError(text)
        return whatwg.parse(text, start)
    if rooted and start.scheme == "file":
        return whatwg.parse("." + bare, start)
    return whatwg.parse(text, whatwg.parse(path or "", start))


def _resolved(text, kind, origin, path, root_dir, known) -> dict:
    try:
        if text is None or text == "":
            return {"error_kind": "EmptyUrl", "error_text": "Empty URL found but a URL must not be empty"}
        return {"uri": str(_without_empty_segment(resolve_text(text, kind or "none", origin, path, root_dir, known)))}
    except LookupError:
        return {"error_kind": "RootRelativeLinkWithoutRoot", "error_text": f"Cannot resolve root-relative link '{text}'"}
    except UrlError as e:
        if str(e) == "empty":
            return {"error_kind": "EmptyUrl", "error_text": "Empty URL found but a URL must not be empty"}
        return {"error_kind": "ParseUrl", "error_text": f"Cannot parse '{text}' into a URL: {e}"}


def _resolver(root_dir: str | None):
    def part(known: dict[str, Url], *columns: pa.Array) -> pa.Array:
        found = [_resolved(t, k, o, p, root_dir, known) if todo else _LEFT for t, k, o, p, todo in zip(*map(values, columns), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x.get(f.name) for x in found], f.type) for f in _RESOLVED], fields=list(_RESOLVED))

    def run(texts: pa.Array, kinds: pa.Array, origins: pa.Array, paths: pa.Array, rest: pa.Array) -> pa.Array:
        known: dict[str, Url] = {}
        return joined([part(known, *p) if pc.any(p[-1]).as_py() else pa.nulls(len(p[-1]), _RESOLVED) for p in pieces(texts, kinds, origins, paths, rest)], _RESOLVED)

    return F.arrow_udf(run, RESOLVED)


def resolve_links(rows: DataFrame, text: Column, base: Column, root_dir: str | None = None) -> DataFrame:
    """Rows with uri, error_kind and error_text of their link texts. Each step is a column of its own, so no expression is evaluated twice."""

    columns = rows.columns
    rows = rows.withColumn("_text", text).withColumn("_base", base)
    b = F.col("_base")
    host_root = r"^https?://[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z][a-z0-9-]*[a-z]/$"
    under_root = (b["kind"] == "full") & F.startswith("_text", F.lit("/")) & b["origin"].rlike(host_root)
    rows = rows.withColumn("_quick", F.when(under_root, F.concat(F.rtrim(b["origin"], F.lit("/")), "_text")).otherwise(F.col("_text")))
    # a bare host gets its slash
    rows = rows.withColumn("_quick", F.when(F.col("_quick").rlike(U.CANONICAL), F.regexp_replace("_quick", "^(https?://[^/?#]*)$", "$1/")))
    # marked so that filters on the result are not pushed below it, where the parser would run once more for each of them
    slow = _resolver(root_dir).asNondeterministic()
    todo = F.col("_quick").isNull()  # of the rest, Python sees only that it is left
    rows = rows.withColumn("_slow", slow(*(F.when(todo, c) for c in (F.col("_text"), b["kind"], b["origin"], b["path"])), todo))
    return rows.select(*columns, F.coalesce("_quick", "_slow.uri").alias("uri"), F.when(F.col("_quick").isNull(), F.col("_slow.error_kind")).alias("error_kind"), F.when(F.col("_quick").isNull(), F.col("_slow.error_text")).alias("error_text"))


def to_requests(raw_links: DataFrame, base_url: str | None = None, root_dir: str | None = None) -> DataFrame:
    """Raw links (source, source_kind, text, ...) with uri or error_kind and error_text."""
    own = with_root_dir(base_from_text(base_url), root_dir) if base_url else None
    base = fallback(base_of_source(F.col("source"), F.col("source_kind")), own)
    return resolve_links(raw_links, F.col("text"), base, root_dir)


def split_errors(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a URI, and those that are errors."""
    return requests.where("uri is not null"), requests.where("uri is null")


def parsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with uri, error_kind and error_text of texts that stand alone."""
    none = F.lit(None).cast("string")
    return resolve_links(rows, F.col(text), F.struct(F.lit("none").alias("kind"), none.alias("origin"), none.alias("path")))
