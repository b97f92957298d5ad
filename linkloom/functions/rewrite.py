"""Rewriting of URIs and request headers before a check: remap rules, site quirks, credentials, headers."""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import uri as U

# Sites whose URLs are checked by another one.
CRATES = r"^(https?://)?(www\.)?crates.io"
YOUTUBE = r"^(https?://)?(www\.)?youtube(-nocookie)?\.com"
YOUTUBE_SHORT = r"^(https?://)?(www\.)?(youtu\.be)"
GITHUB_LINES = r"^https://github\.com/(.*?)/(.*?)/blob/(.*?)#L\d+(?:-L?\d+)?$"
GITHUB_MARKDOWN = r"^https://github\.com/(.*?)/(.*?)/blob/(.*?)/(.*\.(?:md|markdown)#.*)$"
THUMBNAIL = "https://img.youtube.com/vi/{}/0.jpg"


def java_pattern(pattern: str) -> str:
    """Named groups in the form that Java reads."""
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def java_replacement(target: str) -> str:
    """``$1``, ``${1}``, ``$name`` and ``${name}`` in the form that Java reads; ``$$`` is a dollar sign."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "\\":
            return r"\\"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else "${" + name.replace("_", "") + "}"

    return re.sub(r"\$\$|\\|\$(?:\{(\w+)\}|(\w+))", one, target)


def parse_remap(rule: str) -> tuple[str, str]:
    """``<regex> <target>``: exactly two parts."""
    parts = rule.split()
    if len(parts) != 2:
        raise ValueError(f"Cannot parse into URI remapping, must be a Regex pattern and a URL separated by whitespaces: {rule!r}")
    re.compile(parts[0])
    return parts[0], parts[1]


def remap(uri: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The URI by the first rule that matches, null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    made = [F.when(uri.rlike(java_pattern(p)), F.regexp_replace(uri, F.lit(java_pattern(p)), F.lit(java_replacement(t)))) for p, t in rules]
    return F.coalesce(*made)


def remapped(uri: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(uri, remap): the URI to check, and struct(original, new) where a rule matched."""
    new = remap(uri, rules)
    return F.struct(F.coalesce(new, uri).alias("uri"), F.when(new.isNotNull(), F.struct(uri.alias("original"), new.alias("new"))).alias("remap"))


def _thumbnail(video: Column) -> Column:
    return F.concat(F.lit(THUMBNAIL.split("{}")[0]), F.regexp_replace(video, " ", "%20"), F.lit(THUMBNAIL.split("{}")[1]))


def _youtube(uri: Column) -> Column:
    p = U.path(uri)
    pairs = F.split(F.coalesce(U.query(uri), F.lit("")), "&")
    named = F.filter(pairs, lambda x: x.rlike("^v(=|$)"))
    last = F.get(named, F.size(named) - 1)  # of repeated names the last one counts
    watched = F.try_url_decode(F.regexp_replace(last, "^v=?", ""))
    video = F.when(p == "/watch", watched).when(F.startswith(p, F.lit("/embed/")), F.substring(p, F.lit(8), F.length(p)))
    return F.when(video.isNotNull(), _thumbnail(video)).otherwise(uri)


def _youtube_short(uri: Column) -> Column:
    video = F.regexp_replace(U.path(uri), "^/+", "")
    return F.when(video != "", _thumbnail(video)).otherwise(uri)


def quirks(uri: Column) -> Column:
    """The URL that is requested for a URI: all quirks in turn, each on what the last one left."""
    out = F.when(uri.rlike(YOUTUBE), _youtube(uri)).otherwise(uri)
    out = F.when(out.rlike(YOUTUBE_SHORT), _youtube_short(out)).otherwise(out)
    out = F.when(out.rlike(GITHUB_LINES), U.strip_fragment(out)).otherwise(out)
    return F.regexp_replace(out, GITHUB_MARKDOWN, r"https://raw.githubusercontent.com/$1/$2/$3/$4")


def quirk_headers(uri: Column) -> Column:
    """Headers that a quirk adds."""
    return F.when(uri.rlike(CRATES), F.create_map(F.lit("accept"), F.lit("text/html"))).otherwise(F.create_map().cast("map<string,string>"))


def parse_basic_auth(selector: str) -> tuple[str, str, str]:
    """``<uri-regex> <user>:<password>``: exactly two parts."""
    parts = selector.split(" ")
    if len(parts) != 2 or ":" not in parts[1]:
        raise ValueError(f"a URI pattern, one space and user:password are asked for: {selector!r}")
    user, _, word = parts[1].partition(":")
    re.compile(parts[0])
    return parts[0], user, word


def basic_auth(uri: Column, selectors: Sequence[tuple[str, str, str]]) -> Column:
    """The Authorization value of the first selector that matches, else null."""
    if not selectors:
        return F.lit(None).cast("string")
    value = lambda u, w: "Basic " + base64.b64encode(f"{u}:{w}".encode()).decode()
    return F.coalesce(*(F.when(uri.rlike(java_pattern(p)), F.lit(value(u, w))) for p, u, w in selectors))


def parse_header(text: str) -> tuple[str, str]:
    """``Name: Value``, divided at the first colon."""
    name, colon, value = text.partition(":")
    if not colon or not name.strip():
        raise ValueError(f"Header value must be of the form 'Header: Value': {text!r}")
    return name.strip().lower(), value.strip()


def headers(custom: Mapping[str, str], user_agent: str, per_host: Column | None = None, more: Sequence[Column] = ()) -> Column:
    """Merged headers; later ones override: custom, user agent, per host, ``more``. Needs mapKeyDedupPolicy=LAST_WIN."""
    base = {k.lower(): v for k, v in custom.items()} | {"user-agent": user_agent}
    first = F.create_map(*(F.lit(x) for kv in sorted(base.items()) for x in kv))
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(first, *(F.coalesce(m, empty) for m in ([per_host] if per_host is not None else []) + list(more)))
