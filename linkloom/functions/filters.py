"""Which URIs are left out. All predicates are Columns, so Catalyst can push them below joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import uri as U
from linkloom.functions.rewrite import java_pattern

# Reserved example names, domains that cannot be checked, and well-known names that are no links.
EXAMPLE_DOMAINS = ("example.com", "example.org", "example.net", "example.edu")
EXAMPLE_TLDS = (".test", ".example", ".invalid", ".localhost")
UNSUPPORTED_DOMAINS = ("twitter.com",)
FALSE_POSITIVES = (
    r"^https?://schemas\.openxmlformats\.org",
    r"^https?://schemas\.microsoft\.com",
    r"^https?://schemas\.zune\.net",
    r"^https?://www\.w3\.org/1999/xhtml",
    r"^https?://www\.w3\.org/1999/xlink",
    r"^https?://www\.w3\.org/2000/svg",
    r"^https?://www\.w3\.org/2001/XMLSchema-instance",
    r"^https?://ogp\.me/ns#",
    r"^https?://(.*)/xmlrpc\.php$",
)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found anywhere in the text; one scan for all."""
    if not patterns:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{java_pattern(p)})" for p in patterns))


def is_mail(uri: Column) -> Column:
    return F.coalesce(U.scheme(uri) == "mailto", F.lit(False))


def is_tel(uri: Column) -> Column:
    return F.coalesce(U.scheme(uri) == "tel", F.lit(False))


def is_scheme_excluded(uri: Column, schemes: Sequence[str]) -> Column:
    """Schemes that the allow-list lacks; an empty list allows all."""
    return ~F.coalesce(U.scheme(uri).isin([s.lower() for s in schemes]), F.lit(False)) if schemes else F.lit(False)


def is_local_name(uri: Column) -> Column:
    return F.coalesce(U.host(uri) == "localhost", F.lit(False))


def is_loopback(uri: Column) -> Column:
    return F.coalesce(U.host(uri).rlike(r"^(?:127\.\d+\.\d+\.\d+|\[::1\])$"), F.lit(False))


def is_private(uri: Column) -> Column:
    return F.coalesce(U.host(uri).rlike(r"^(?:(?:10\.\d+|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+|\[f[cd][0-9a-f]{2}:.*\])$"), F.lit(False))


def is_link_local(uri: Column) -> Column:
    return F.coalesce(U.host(uri).rlike(r"^(?:169\.254\.\d+\.\d+|\[fe[89ab][0-9a-f]:.*\])$"), F.lit(False))


def is_example(uri: Column) -> Column:
    """Reserved example domains, themselves or with one label more; reserved top-level domains; mail addresses that end in one."""
    names = "|".join(d.replace(".", r"\.") for d in EXAMPLE_DOMAINS)
    tlds = "|".join(t.replace(".", r"\.") for t in EXAMPLE_TLDS)
    web = U.domain(uri).rlike(rf"^(?:[^.]*\.)?(?:{names})$|(?:{tlds})$")
    mail = U.path(uri).rlike(rf"(?:{names})$")
    return F.coalesce(F.when(is_mail(uri), mail).otherwise(web), F.lit(False))


def is_unsupported(uri: Column) -> Column:
    """By the end of the domain, without a boundary before it."""
    d = U.domain(uri)
    return F.coalesce(d.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in UNSUPPORTED_DOMAINS) + ")$"), F.lit(False))


def is_false_positive(uri: Column) -> Column:
    return F.coalesce(matches_any(uri, FALSE_POSITIVES), F.lit(False))


@dataclass(frozen=True)
class LinkFilter:
    """What ``is_excluded`` leaves out."""

    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    schemes: tuple[str, ...] = ()
    include_mail: bool = False
    exclude_private: bool = False
    exclude_link_local: bool = False
    exclude_loopback: bool = False
    exclude_all_private: bool = False
    check_example_domains: bool = False

    def is_excluded(self, uri: Column) -> Column:
        every = self.exclude_all_private
        hard = [is_scheme_excluded(uri, self.schemes), is_tel(uri), is_unsupported(uri)]
        if not self.include_mail:
            hard.append(is_mail(uri))
        if self.exclude_loopback or every:
            hard += [is_local_name(uri), is_loopback(uri)]
        if self.exclude_private or every:
            hard.append(is_private(uri))
        if self.exclude_link_local or every:
            hard.append(is_link_local(uri))
        if not self.check_example_domains:
            hard.append(is_example(uri))
        out = hard[0]
        for h in hard[1:]:
            out = out | h
        included = F.coalesce(matches_any(uri, self.includes), F.lit(False))
        if not self.includes and not self.excludes:
            soft = is_false_positive(uri)
        elif not self.excludes:  # includes restrict only where there are no excludes
            soft = ~included
        else:
            soft = ~included & (is_false_positive(uri) | F.coalesce(matches_any(uri, self.excludes), F.lit(False)))
        return out | soft
