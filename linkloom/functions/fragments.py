"""Fragments of URLs: element ids, text directives and the ids that satisfy a link."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import uri as U

DIRECTIVE = "array<struct<prefix:string,start:string,end:string,suffix:string>>"


def percent_decoded(text: Column) -> Column:
    """Decoded text; null where what it encodes is no UTF-8. A stray percent sign stays as it is."""
    kept = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    out = F.try_url_decode(kept)
    return F.when(~F.contains(out, F.lit("�")) | F.contains(text, F.lit("%EF%BF%BD")), out)


def lossily_decoded(text: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def element_id(fragment: Column) -> Column:
    """The part before ``:~:``; null if it is empty and directives follow."""
    head = F.split_part(fragment, F.lit(":~:"), F.lit(1))
    return F.when(F.contains(fragment, F.lit(":~:")) & (head == ""), None).otherwise(head)


def _directive(text: Column) -> Column:
    parts = F.split(text, ",")
    n = F.size(parts)
    has_prefix = (n > 1) & F.endswith(F.get(parts, F.lit(0)), F.lit("-"))
    rest = F.when(has_prefix, F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    m = F.size(rest)
    has_suffix = (m > 1) & F.startswith(F.get(rest, m - 1), F.lit("-"))
    core = F.when(has_suffix, F.slice(rest, 1, F.greatest(m - 1, F.lit(0)))).otherwise(rest)
    return F.struct(
        F.when(has_prefix, lossily_decoded(F.regexp_replace(F.get(parts, F.lit(0)), "-$", ""))).alias("prefix"),
        lossily_decoded(F.get(core, F.lit(0))).alias("start"),
        F.when(F.size(core) > 1, lossily_decoded(F.get(core, F.lit(1)))).alias("end"),
        F.when(has_suffix, lossily_decoded(F.regexp_replace(F.get(rest, m - 1), "^-", ""))).alias("suffix"),
    )


def text_directives(fragment: Column) -> Column:
    """``text=[prefix-,]start[,end][,-suffix]`` directives behind ``:~:``."""
    tail = F.when(F.contains(fragment, F.lit(":~:")), F.regexp_extract(fragment, r":~:(.*)$", 1)).otherwise("")
    texts = F.filter(F.split(tail, "&"), lambda x: F.startswith(x, F.lit("text=")) & (F.length(x) > 5))
    made = F.transform(F.transform(texts, lambda x: F.substring(x, F.lit(6), F.length(x))), _directive)
    return F.filter(made, lambda d: (F.length(d["start"]) > 0) & (F.size(F.array_compact(F.array(d["start"]))) > 0))


def candidates(uri: Column, fragment: Column, markdown: Column) -> Column:
    """Ids one of which the target must have: as written, with GitHub's prefix, percent-decoded (lower case for Markdown)."""
    decoded = F.coalesce(percent_decoded(fragment), fragment)
    decoded = F.when(markdown, F.lower(decoded)).otherwise(decoded)
    github = F.when(F.endswith(U.host(uri), F.lit("github.com")), F.concat(F.lit("user-content-"), fragment))
    return F.array_distinct(F.array_compact(F.array(fragment, github, decoded)))


def passes_always(fragment: Column) -> Column:
    return fragment.isNull() | (F.lower(fragment).isin("", "top"))


def escaped(text: Column) -> Column:
    """White space runs as one space, and all marks of regular expressions escaped."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def directive_pattern(directive: Column) -> Column:
    return F.concat(
        F.coalesce(F.concat(escaped(directive["prefix"]), F.lit(r"\s*")), F.lit("")),
        escaped(directive["start"]),
        F.coalesce(F.concat(F.lit(".+?"), escaped(directive["end"])), F.lit("")),
        F.coalesce(F.concat(F.lit(r"\s*"), escaped(directive["suffix"])), F.lit("")),
    )


def directives_match(directives: Column, text: Column) -> Column:
    """Whether every directive is found in a visible text, case-sensitively."""
    return F.forall(directives, lambda d: F.regexp_like(text, directive_pattern(d)))


def python_pattern(prefix: str | None, start: str, end: str | None, suffix: str | None) -> str:
    """The same pattern for the driver."""
    clean = lambda x: re.escape(" ".join(x.split()))
    return (clean(prefix) + r"\s*" if prefix else "") + clean(start) + (".+?" + clean(end) if end else "") + (r"\s*" + clean(suffix) if suffix else "")
