"""Parts and kinds of URIs as Columns (for URIs in the form that ``whatwg.parse`` gives)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URLs that parsing leaves as they are, so no parser has to see them.
CANONICAL = r"^https?://[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z][a-z0-9-]*[a-z](?:/[A-Za-z0-9_~!$&()*+,;=:@-]+(?:\.[A-Za-z0-9_~!$&()*+,;=:@-]+)*)*/?(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?(?:#[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?$"
AUTHORITY = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?"
# Names on GitHub that are no owners.
GITHUB_RESERVED = "about collections events explore features issues marketplace new notifications pricing pulls sponsors topics watching".split()
GITHUB_HOSTS = ("github.com", "www.github.com", "raw.githubusercontent.com")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def scheme(uri: Column) -> Column:
    return _some(F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def host(uri: Column) -> Column:
    """Domain, IPv4 address or bracketed IPv6 address; null without one."""
    return _some(F.lower(F.regexp_extract(uri, AUTHORITY + r"(\[[^\]]*\]|[^/?#:]*)", 1)))


def is_ip(host_: Column) -> Column:
    return host_.rlike(r"^(?:\d+\.\d+\.\d+\.\d+|\[.*\])$")


def domain(uri: Column) -> Column:
    """The host unless it is an address."""
    h = host(uri)
    return F.when(~is_ip(h), h)


def path(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[^:]+:(?://[^/?#]*)?([^?#]*)", 1)


def query(uri: Column) -> Column:
    return F.when(uri.rlike(r"^[^#]*\?"), F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1))


def fragment(uri: Column) -> Column:
    return F.when(F.instr(uri, "#") > 0, F.regexp_extract(uri, r"#(.*)$", 1))


def strip_fragment(uri: Column) -> Column:
    return F.regexp_replace(uri, r"#.*$", "")


def host_key(uri: Column) -> Column:
    """Lower-cased host; null where there is none, which callers report as a missing host."""
    return host(uri)


def to_https(uri: Column) -> Column:
    return F.regexp_replace(uri, "^http:", "https:")


def uri_class(text: Column) -> Column:
    """absolute, scheme (``//x``), root (``/x``) or local, by the text after leading white space."""
    t = F.regexp_replace(text, r"^[ \t\n\f\r]+", "")
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(F.startswith(t, F.lit("//")), "scheme").when(F.startswith(t, F.lit("/")), "root").otherwise("local")


def without_empty_segment(uri: Column) -> Column:
    """``file:`` URIs lose one empty last path segment."""
    return F.regexp_replace(uri, r"^(file:[^?#]*[^/?#])/(?=$|[?#])", "$1")


def github(uri: Column) -> Column:
    """struct(owner, repo, endpoint) of a GitHub URI, null for others."""
    segments = F.split(F.regexp_replace(path(uri), "^/", ""), "/")
    owner, repo = F.get(segments, F.lit(0)), F.regexp_replace(F.get(segments, F.lit(1)), r"\.git$", "")
    rest = F.array_join(F.slice(segments, 3, F.greatest(F.size(segments) - 2, F.lit(0))), "/")
    fits = host(uri).isin(*GITHUB_HOSTS) & (F.size(segments) >= 2) & (F.length(F.get(segments, F.lit(1))) > 0) & ~owner.isin(GITHUB_RESERVED)
    return F.when(fits, F.struct(owner.alias("owner"), repo.alias("repo"), _some(rest).alias("endpoint")))


#: Extensions by the type of their documents.
EXTENSIONS = {
    "markdown": "md markdown mdx qmd rmd mkd mkdn mdwn mdown mkdown".split(),
    "html": ["htm", "html"],
    "css": ["css"],
    "xml": ["xml"],
    "plaintext": ["txt"],
}


def type_of_extension(ext: str) -> str:
    """The type of documents with an extension; plain text if it is unknown."""
    return next((k for k, known in EXTENSIONS.items() if ext.lower().lstrip(".") in known), "plaintext")


def file_type(source: Column) -> Column:
    """Type of a document by its extension; an http(s) URL without a known one is HTML, all else plain text."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(source, r"[?#].*$", ""), r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))
    remote = source.rlike(r"^https?://")
    bare_host = source.rlike(r"^https?://[^/]*/?(?:[?#].*)?$")
    by_extension = F.when(bare_host, "html")
    for kind, known in EXTENSIONS.items():
        by_extension = by_extension.when(ext.isin(known), kind)
    return by_extension.when(remote, "html").otherwise("plaintext")
