"""Optional: makes an ``http_snapshot`` by real requests. Nothing else in the engine touches the network.

URLs are dealt out by host, so a host's limits hold in one task: at most
``host_concurrency`` requests at a time, a pause between their starts that grows by
``operators.backoff``, and retries with doubling waits; ``hosts`` in the configuration
sets both for a host of its own. ``max_concurrency`` bounds the tasks, so that all of
them together have no more requests open than that. A very large host is limited by its
own pace, not by the cluster.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import HostConfig, LinkCheckConfig
from linkloom.functions import uri as U
from linkloom.operators.backoff import step

SCHEMA = "method string, url_nofrag string, status int, error_class string, error_message string, headers map<string,string>, body string, final_url string, redirects array<struct<url:string,code:int>>, duration_ms double"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.struct([("url", pa.string()), ("code", pa.int32())])), pa.float64()]
_NAMES = ["method", "url_nofrag", "status", "error_class", "error_message", "headers", "body", "final_url", "redirects", "duration_ms"]
Fetch = Callable[[str, str, dict[str, str], float], dict]


def load_cookies(path: str) -> list[dict]:
    """A cookie jar: a JSON list of name, value, domain, path."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, list) or not all(isinstance(c, dict) and {"name", "value", "domain"} <= c.keys() for c in found):
        raise ValueError("Cookie handling error: a list of cookies is asked for. Check cookie file format")
    return found


def save_cookies(path: str, cookies: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(cookies, f, indent=1)


def cookie_header(cookies: list[dict], host: str, path: str = "/") -> str:
    """The Cookie header for a host: cookies of its domain and of those above it."""
    fit = lambda c: (host == c["domain"].lstrip(".") or host.endswith("." + c["domain"].lstrip("."))) and path.startswith(c.get("path", "/"))
    return "; ".join(f"{c['name']}={c['value']}" for c in cookies if fit(c))


#: Names of the lowest TLS version that is accepted.
TLS_VERSIONS = {"TLSv1_0": "TLSv1", "TLSv1_1": "TLSv1_1", "TLSv1_2": "TLSv1_2", "TLSv1_3": "TLSv1_3"}


def tls_context(insecure: bool, min_tls: str | None):
    """How servers are to prove who they are, and by which TLS version at least."""
    import ssl

    if min_tls is not None and min_tls not in TLS_VERSIONS:
        raise ValueError(f"min_tls is one of {', '.join(TLS_VERSIONS)}")
    context = ssl.create_default_context()
    if insecure:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    if min_tls is not None:
        context.minimum_version = getattr(ssl.TLSVersion, TLS_VERSIONS[min_tls])
    return context


def urllib_fetch(method: str, url: str, headers: dict[str, str], timeout_s: float, insecure: bool = False, min_tls: str | None = None) -> dict:
    """One request with the standard library; gives the columns of a snapshot but the first two."""
    import socket
    import urllib.error
    import urllib.request

    redirects: list[dict] = []

    class Follow(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, hdrs, newurl):
            redirects.append({"url": newurl, "code": code})
            return super().redirect_request(req, fp, code, msg, hdrs, newurl)

    out: dict = {"error_class": "none", "redirects": redirects}
    try:
        try:
            reply = urllib.request.build_opener(Follow, urllib.request.HTTPSHandler(context=tls_context(insecure, min_tls))).open(urllib.request.Request(url, method=method, headers=headers), timeout=timeout_s)
        except urllib.error.HTTPError as e:
            reply = e
        out |= {"status": reply.status, "headers": [(k.lower(), v) for k, v in reply.headers.items()], "final_url": reply.geturl()}
        out["body"] = reply.read().decode("utf-8", "replace")
    except (TimeoutError, socket.timeout) as e:
        out |= {"error_class": "timeout", "error_message": str(e)}
    except ValueError as e:
        out |= {"error_class": "builder", "error_message": str(e)}
    except OSError as e:
        out |= {"error_class": "timeout" if "timed out" in str(e) else "connect", "error_message": str(e)}
    return out


class Pace:
    """One host's limits: requests start one after the other, at least a pause apart that its answers lengthen."""

    def __init__(self, interval_ms: int, sleep: Callable[[float], None]):
        self.interval_ms, self.sleep, self.wait_ms, self.lock = interval_ms, sleep, 0, threading.Lock()

    def start(self) -> None:
        with self.lock:
            self.sleep(max(self.interval_ms, self.wait_ms) / 1000)

    def answered(self, got: dict) -> None:
        with self.lock:
            self.wait_ms = step(self.wait_ms, got.get("status"))


def fetch(urls: DataFrame, config: LinkCheckConfig, get: Fetch | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Snapshot rows of distinct URLs (url, without fragments) for each method of the configuration."""
    timeout_s, retries, first = config.get("timeout_s"), config.get("max_retries"), config.get("retry_wait_s")
    at_once, interval = config.get("host_concurrency"), config.get("host_request_interval_ms")
    most = config.get("max_concurrency")
    headers = {"user-agent": config.get("user_agent")} | config.headers
    cookies = load_cookies(config.cookie_jar) if config.cookie_jar else []
    hosts = dict(config.hosts)
    if get is None:
        tls_context(config.get("insecure"), config.min_tls)  # refuses what it does not know before any task starts
        get = functools.partial(urllib_fetch, insecure=config.get("insecure"), min_tls=config.min_tls)

    def ask(pace: Pace, host: str, method: str, url: str, own: dict[str, str]) -> dict:
        got: dict = {}
        for attempt in range(retries + 1):
            pace.start()
            began = time.monotonic()
            cookie = cookie_header(cookies, host)
            got = get(method, url, own | ({"cookie": cookie} if cookie else {}), timeout_s)
            got["duration_ms"] = (time.monotonic() - began) * 1000
            pace.answered(got)
            if got.get("status") != 429 and got.get("error_class") != "timeout":
                break
            if attempt < retries:
                sleep(first * 2**attempt)
        return {"method": method, "url_nofrag": url} | got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paces: dict[str, Pace] = {}
        for batch in batches:
            for host, part in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
                limits = hosts.get(host, HostConfig())
                pace = paces.setdefault(host, Pace(interval if limits.request_interval_ms is None else limits.request_interval_ms, sleep))
                workers = at_once if limits.concurrency is None else limits.concurrency
                with ThreadPoolExecutor(max(1, min(workers, most))) as pool:
                    rows = list(pool.map(lambda r, p=pace, own=headers | dict(limits.headers): ask(p, *r, own), part))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    url = U.strip_fragment(F.col("url"))
    asked = urls.select(url.alias("url")).distinct().select(F.coalesce(U.host(F.col("url")), F.lit("")).alias("host"), F.explode(F.array(*map(F.lit, config.methods))).alias("method"), "url")
    tasks = max(1, most // max(1, at_once))  # each has one host's requests open at a time
    return asked.repartition(tasks, "host").sortWithinPartitions("host", "url").mapInArrow(run, SCHEMA)
