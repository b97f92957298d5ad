"""One configuration object for all operators, its parsers, and how several of them are merged."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from linkloom.functions.filters import LinkFilter
from linkloom.functions.rewrite import parse_basic_auth, parse_header, parse_remap
from linkloom.functions.status import DEFAULT_ACCEPT, parse_ranges

FRAGMENT_MODES = ("none", "anchor-only", "text-only", "full")
TYPE_EXTENSIONS = ("md", "mkd", "mdx", "mdown", "mdwn", "mkdn", "mkdown", "markdown", "html", "htm", "css", "txt", "xml")


@dataclass(frozen=True)
class HostConfig:
    concurrency: int | None = None
    request_interval_ms: int | None = None
    headers: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LinkCheckConfig:
    """Options by group; ``None`` means that the default holds (see ``get``)."""

    # inputs
    files_from: str | None = None
    extensions: tuple[str, ...] | None = None
    default_extension: str | None = None
    glob_ignore_case: bool | None = None
    hidden: bool | None = None
    no_ignore: bool | None = None
    skip_missing: bool | None = None
    exclude_path: tuple[str, ...] = ()
    preprocess: str | None = None
    # extraction
    include_verbatim: bool | None = None
    include_wikilinks: bool | None = None
    include_fragments: str | None = None
    tree_rules: bool | None = None
    # resolution
    base_url: str | None = None
    root_dir: str | None = None
    fallback_extensions: tuple[str, ...] = ()
    index_files: tuple[str, ...] | None = None
    remap: tuple[str, ...] = ()
    # filtering
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_all_private: bool | None = None
    exclude_private: bool | None = None
    exclude_link_local: bool | None = None
    exclude_loopback: bool | None = None
    include_mail: bool | None = None
    scheme: tuple[str, ...] = ()
    offline: bool | None = None
    check_example_domains: bool | None = None
    # checking
    accept: str | None = None
    accept_timeouts: bool | None = None
    method: str | None = None
    timeout_s: float | None = None
    max_redirects: int | None = None
    max_retries: int | None = None
    retry_wait_s: float | None = None
    require_https: bool | None = None
    insecure: bool | None = None
    min_tls: str | None = None
    user_agent: str | None = None
    header: tuple[str, ...] = ()
    basic_auth: tuple[str, ...] = ()
    cookie_jar: str | None = None
    github_token: str | None = None
    max_concurrency: int | None = None
    threads: int | None = None
    host_concurrency: int | None = None
    host_request_interval_ms: int | None = None
    hosts: Mapping[str, HostConfig] = field(default_factory=dict)
    # cache
    cache: bool | None = None
    max_cache_age_s: int | None = None
    cache_exclude_status: str | None = None
    # output
    format: str | None = None
    mode: str | None = None
    output: str | None = None
    dump: bool | None = None
    dump_inputs: bool | None = None
    host_stats: bool | None = None
    suggest: bool | None = None
    archive: str | None = None
    verbose: int | None = None
    no_progress: bool | None = None

    def get(self, name: str):
        """The option or its default."""
        value = getattr(self, name)
        return DEFAULTS.get(name) if value is None else value

    @property
    def accepted(self) -> tuple[tuple[int, int], ...]:
        """Given ranges replace the default ones."""
        return DEFAULT_ACCEPT if self.accept is None else parse_ranges(self.accept)

    @property
    def methods(self) -> tuple[str, ...]:
        return parse_methods(self.get("method"))

    @property
    def remaps(self) -> tuple[tuple[str, str], ...]:
        return tuple(parse_remap(r) for r in self.remap)

    @property
    def credentials(self) -> tuple[tuple[str, str, str], ...]:
        return tuple(parse_basic_auth(s) for s in self.basic_auth)

    @property
    def headers(self) -> dict[str, str]:
        return dict(parse_header(h) for h in self.header)

    @property
    def detailed(self) -> bool:
        """Whether success, exclusion and redirect maps are kept."""
        return self.get("verbose") >= 1

    def filter(self) -> LinkFilter:
        flags = {k: bool(self.get(k)) for k in ("include_mail", "exclude_private", "exclude_link_local", "exclude_loopback", "exclude_all_private", "check_example_domains")}
        schemes = ("file",) if self.get("offline") else self.scheme
        return LinkFilter(includes=self.include, excludes=self.exclude, schemes=schemes, **flags)


#: Defaults of the options that have one.
DEFAULTS = {
    "extensions": TYPE_EXTENSIONS,
    "glob_ignore_case": False,
    "hidden": False,
    "no_ignore": False,
    "skip_missing": False,
    "include_verbatim": False,
    "include_wikilinks": False,
    "include_fragments": "none",
    "tree_rules": False,
    "method": "get",
    "timeout_s": 20.0,
    "max_redirects": 10,
    "max_retries": 3,
    "retry_wait_s": 1.0,
    "require_https": False,
    "insecure": False,
    "user_agent": "linkloom/1.0",
    "max_concurrency": 128,
    "host_concurrency": 10,
    "host_request_interval_ms": 50,
    "cache": False,
    "max_cache_age_s": 86_400,
    "format": "compact",
    "mode": "color",
    "verbose": 0,
}


def parse_methods(text: str) -> tuple[str, ...]:
    parts = [p.strip().upper() for p in text.split(",")]
    if not all(parts):
        raise ValueError(f"empty request method: {text!r}")
    return tuple(parts)


def parse_duration(text: str) -> float:
    """Seconds of ``1d 2h 3m 4s 5ms`` or of a bare number."""
    if re.fullmatch(r"\d+(\.\d+)?", text.strip()):
        return float(text)
    parts = re.findall(r"(\d+)\s*(ms|[smhdw])", text)
    if not parts or re.sub(r"(\d+)\s*(ms|[smhdw])|\s", "", text):
        raise ValueError(f"no duration: {text!r}")
    return sum(int(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[u] for n, u in parts)


def shown_duration(seconds: float, millis: bool = False) -> str:
    """``1h 1m 1s``; with ``millis`` also milliseconds."""
    total = int(round(seconds * 1000)) if millis else int(seconds) * 1000
    out = []
    for unit, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        n, total = divmod(total, size)
        if n:
            out.append(f"{n}{unit}")
    return " ".join(out) or "0s"


def merge(first: LinkCheckConfig, second: LinkCheckConfig) -> LinkCheckConfig:
    """``first`` wins where both set an option; lists are joined; hosts are merged key by key."""
    changes = {}
    for f in fields(LinkCheckConfig):
        a, b = getattr(first, f.name), getattr(second, f.name)
        if f.name == "hosts":
            changes[f.name] = {
                k: HostConfig(
                    x.concurrency if x.concurrency is not None else y.concurrency,
                    x.request_interval_ms if x.request_interval_ms is not None else y.request_interval_ms,
                    {**y.headers, **x.headers},
                )
                for k in {**b, **a}
                for x, y in [(a.get(k, HostConfig()), b.get(k, HostConfig()))]
            }
        elif isinstance(a, tuple) and isinstance(b, tuple) and f.name not in ("extensions", "index_files"):
            changes[f.name] = a + b
        else:
            changes[f.name] = b if a is None else a
    return replace(first, **changes)


def from_mapping(options: Mapping) -> LinkCheckConfig:
    """Options by their long names; unknown ones are refused."""
    known = {f.name for f in fields(LinkCheckConfig)}
    out = {}
    for key, value in options.items():
        name = key.replace("-", "_")
        name = {"timeout": "timeout_s", "retry_wait_time": "retry_wait_s", "max_cache_age": "max_cache_age_s", "host_request_interval": "host_request_interval_ms"}.get(name, name)
        if name not in known:
            raise ValueError(f"unknown option {key!r}")
        if name in ("timeout_s", "retry_wait_s", "max_cache_age_s") and isinstance(value, str):
            value = parse_duration(value)
        if name == "host_request_interval_ms" and isinstance(value, str):
            value = int(parse_duration(value) * 1000)
        if name == "include_fragments" and isinstance(value, bool):
            value = "full" if value else "none"
        if name == "include_fragments" and value not in FRAGMENT_MODES:
            raise ValueError(f"{key} is one of {', '.join(FRAGMENT_MODES)}")
        if name == "hosts":
            value = {h: HostConfig(v.get("concurrency"), int(parse_duration(i) * 1000) if isinstance(i := v.get("request_interval"), str) else i, {k.lower(): x for k, x in v.get("headers", {}).items()}) for h, v in value.items()}
        if name == "header" and isinstance(value, Mapping):
            value = [f"{k}: {v}" for k, v in value.items()]
        if name in ("accept", "cache_exclude_status") and isinstance(value, list):
            value = ",".join(map(str, value))
        if isinstance(value, list):
            value = tuple(value)
        elif isinstance(value, str) and name in ("include", "exclude", "exclude_path", "scheme", "remap", "header", "basic_auth", "fallback_extensions"):
            value = (value,)
        out[name] = value
    return LinkCheckConfig(**out)


def load(path: str, section: tuple[str, ...] = ()) -> LinkCheckConfig:
    """A TOML or JSON file; ``section`` names the tables that lead to the options (as in pyproject.toml or package.json)."""
    with open(path, "rb") as f:
        found = json.load(f) if path.endswith(".json") else tomllib.load(f)
    for name in section:
        found = found.get(name, {})
    return from_mapping(found)
