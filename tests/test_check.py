import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from linkloom.config import HostConfig, LinkCheckConfig
from linkloom.operators import backoff, check, report, stats
from linkloom.plans import pipeline
from linkloom.sources import fetch
from linkloom.sources.inputs import from_table


@pytest.fixture(scope="module")
def world(spark):
    """Two documents, and what the network says about their links."""
    page = '<a href="/ok">1</a><a href="/ok">2</a>\n<a href="/gone">3</a><a href="/slow">4</a><a href="mailto:a@b.org">5</a><a href="slack://x">6</a><a href="https://www.w3.org/2000/svg">7</a><a href="/moved">8</a><a href="/busy">9</a>'
    docs = from_table(spark.createDataFrame([("https://h.org/", page), ("https://h.org/b.md", "[l](ok) and [t](gone#x)")], "url string, body string"), "url", "body")
    answers = [("/ok", 200, None), ("/gone", 404, None), ("/slow", None, "timeout"), ("/moved", 200, None), ("/busy", 429, None)]
    http = spark.createDataFrame([("GET", f"https://h.org{p}", s, e) for p, s, e in answers], "method string, url_nofrag string, status int, error_class string")
    hop = F.when(F.endswith("url_nofrag", F.lit("moved")), F.array(F.struct(F.lit("https://h.org/new").alias("url"), F.lit(301).alias("code"))))
    http = http.select("*", F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("<p id=x>").alias("body"), F.col("url_nofrag").alias("final_url"), hop.cast(check.REDIRECTS).alias("redirects"), F.lit(12.0).alias("duration_ms"))
    mail = spark.createDataFrame([("a@b.org", "success", "")], "address string, result string, reason string")
    return docs, check.Snapshots(http=http, mail=mail)


@pytest.fixture(scope="module")
def responses(world):
    docs, snapshots = world
    return pipeline.check_links(docs, snapshots, LinkCheckConfig(include_mail=True)).cache()


def test_counters(responses):
    c = stats.counters(responses).first().asDict()
    assert c == {"total": 11, "unique": 9, "redirects": 1, "remaps": 0, "successful": 5, "errors": 3, "unknown": 0, "timeouts": 1, "excludes": 1, "unsupported": 1, "cached": 0}
    assert stats.outcome(responses).first() == (False, 2)
    assert stats.outcome(responses.where("status.kind = 'Ok'")).first() == (True, 0)
    assert stats.outcome(responses.where("status.kind = 'Timeout'"), accept_timeouts=True).first()[0]
    assert stats.outcome(responses.where("false")).first() == (True, 0)


def test_same_url_at_two_places_is_two_bodies(responses):
    rows = stats.per_source(responses, detailed=True).where("uri = 'https://h.org/ok' and source = 'https://h.org/'")
    assert rows.count() == 2


def test_compact_report(responses, spark):
    archive = spark.createDataFrame([("https://h.org/gone", "https://old.org/gone")], "url string, suggestion string")
    text = report.compact(responses, check.suggestions(responses, archive), seconds=1.5)
    assert text.startswith("Issues found in 4 inputs. Find details below.\n")
    assert "[404] https://h.org/gone (at 2:10) | Rejected status code: 404 Not Found" in text
    assert "ℹ Suggestions\nhttps://h.org/gone --> https://old.org/gone" in text
    assert text.endswith("🔍 11 Total (in 1s 500ms) 🔗 9 Unique ✅ 5 OK 🚫 3 Errors 👻 1 Excluded ⏳ 1 Timeouts ⛔ 1 Unsupported 🔀 1 Redirects")


def test_other_reports(responses):
    text = report.detailed(responses)
    assert "🔍 Total" in text and "Errors in https://h.org/\n" in text and "Ignored in https://h.org/" in text and "https://h.org/moved --[301]--> https://h.org/new" in text
    md = report.markdown(responses)
    assert "| Status         | Count |" in md and "| ✅ Successful  | 5     |" in md and "* [404] <https://h.org/gone> (at 2:10) | Rejected status code: 404 Not Found" in md and "## Redirects per input" in md
    j = json.loads(report.json_report(responses, detailed=True))
    assert j["total"] == 11 and j["error_map"]["https://h.org/"][0]["status"] == {"text": "Rejected status code: 429 Too Many Requests", "code": 429}
    assert j["timeout_map"]["https://h.org/"][0]["status"] == {"text": "Timeout", "details": "Request timed out"}
    root = ET.fromstring(report.junit(responses))
    cases = root.findall(".//testcase")
    assert len(cases) == 9 and sum(c.find("failure") is not None for c in cases) == 3 and sum(c.find("skipped") is not None for c in cases) == 1


def test_stored_requests_give_the_same(world, responses, tmp_path):
    docs, snapshots = world
    stored = pipeline.check_links(docs, snapshots, LinkCheckConfig(include_mail=True), store=str(tmp_path / "requests"))
    key = lambda df: sorted(map(str, df.select("source", "uri", "status", "span").collect()))
    assert key(stored) == key(responses)


def test_hints(responses):
    got = {r[0] for r in report.hints(responses, LinkCheckConfig()).collect()}
    assert got == {report.HINT_RATE_LIMIT.replace("{}", "h.org"), report.HINT_CODES, report.HINT_REDIRECTS.format(1, "redirect")}
    quiet = LinkCheckConfig(hosts={"h.org": HostConfig(1)}, verbose=1, accept="200", method="head", include_fragments="full")
    assert {r[0] for r in report.hints(responses, quiet).collect()} == {report.HINT_FRAGMENTS.format("HEAD")}


def test_fragments_and_accept(world):
    docs, snapshots = world
    out = pipeline.check_links(docs, snapshots, LinkCheckConfig(include_fragments="anchor-only", accept="200,404,429"))
    kinds = {r["uri"]: r["kind"] for r in out.select("uri", "status.kind").collect()}
    assert kinds["https://h.org/gone"] == "Ok" and kinds["https://h.org/gone#x"] == "Ok" and kinds["mailto:a@b.org"] == "Excluded"


def test_duplicates_are_one_request(spark, world):
    docs = from_table(spark.createDataFrame([("https://h.org/", '<a href="/ok">x</a>' * 100)], "url string, body string"), "url", "body")
    c = stats.counters(pipeline.check_links(docs, world[1])).first()
    assert (c["total"], c["unique"], c["successful"]) == (100, 1, 100)


def test_cache_and_remap(spark, world):
    docs, snapshots = world
    cached = check.Snapshots(http=snapshots.http, mail=snapshots.mail, cache=spark.createDataFrame([("https://h.org/slow", "200"), ("https://h.org/ok", "404")], "uri string, status string"))
    out = pipeline.check_links(docs, cached, LinkCheckConfig(remap=("/moved$ /ok",))).select("uri", "status.*", "remap").collect()
    got = {r["uri"]: r for r in out}
    assert got["https://h.org/slow"]["kind"] == "Ok" and got["https://h.org/slow"]["cached"] and got["https://h.org/slow"]["text"] == "OK (cached)"
    assert got["https://h.org/ok"]["kind"] == "Error" and all(r["remap"] is None for r in out)  # a cache hit loses its remap
    fresh = pipeline.check_links(docs, snapshots, LinkCheckConfig(remap=("/moved$ /ok",)))
    assert stats.counters(fresh).first()["remaps"] == 1


def test_errors_are_rows(spark, world):
    docs = spark.createDataFrame([("<stdin>", "stdin", "html", '<a href="/x"><a href="y"><a href=""><a href="http://a]b">')], "source string, source_kind string, file_type string, content string")
    rows = pipeline.check_links(docs, world[1]).select("uri", "status.*").collect()
    assert {r["uri"] for r in rows} == {"error:"} and {r["kind"] for r in rows} == {"RequestError"}
    assert sum("no base location" in r["details"] for r in rows) == 2
    c = stats.counters(pipeline.check_links(docs, world[1])).first()
    assert (c["total"], c["unique"], c["errors"]) == (4, 1, 4)


def test_host_reports(spark):
    log = spark.createDataFrame([("a", 1, 1, 200, 10.0), ("a", 2, 2, 429, 20.0), ("a", 3, 3, None, 30.0), ("b", 1, 4, 500, 5.0)], "host string, ts int, event_id int, code int, duration_ms double")
    hits = spark.createDataFrame([("a", 3), ("c", 1)], "host string, cache_hits bigint")
    s = {r["host"]: r for r in stats.host_stats(log, hits).collect()}
    assert (s["a"]["total_requests"], s["a"]["successful_requests"], s["a"]["network_errors"], s["a"]["median_ms"], s["a"]["latest_ms"], s["a"]["cache_hit_rate"]) == (6, 4, 1, 20.0, 30.0, 0.5)
    assert s["c"]["success_rate"] == 1.0 and s["c"]["median_ms"] is None and s["b"]["error_rate"] == 100.0
    text = report.host_table(stats.host_stats(log, hits))
    assert "a          │      6 reqs │   66.7% success │     20ms median │   50.0% cached" in text
    assert "| a    | 6        | 66.7%" in report.host_table(stats.host_stats(log, hits), "markdown")
    assert "  Rate limited: 1 (429 Too Many Requests)" in report.host_table(stats.host_stats(log, hits), "detailed")
    assert {r["host"]: r["status_codes"] for r in stats.status_code_maps(log).collect()} == {"a": {200: 1, 429: 1}, "b": {500: 1}}


def test_backoff_fold_is_exact_with_long_logs(spark):
    import random

    rng, rows = random.Random(2), []
    for h in range(12):
        for k in range(rng.choice([1, 30, 300])):
            code = rng.choice([429, 500, 503, 404, None] + [200] * (h % 3))
            rows.append((f"h{h}", k, k, code, rng.choice([None, None, None, 700, 90_000])))
    df = spark.createDataFrame(rows, "host string, ts int, event_id int, code int, reset_ms bigint")
    want = {}
    for h, _, _, code, reset in rows:
        want[h] = backoff.step(want.get(h, 0), code, reset)
    assert {r["host"]: r["backoff_ms"] for r in backoff.host_backoff(df).collect()} == want


def test_fetcher_makes_a_snapshot(spark, world):
    def get(method, url, headers, timeout):
        return {"status": 200 if "ok" in url else 404, "error_class": "none", "body": method, "headers": [("a", headers["user-agent"])], "final_url": url, "redirects": []}

    urls = spark.createDataFrame([("https://h.org/ok#a",), ("https://h.org/ok#b",), ("https://h.org/no",)], "url string")
    rows = {r["url_nofrag"]: r for r in fetch.fetch(urls, LinkCheckConfig(user_agent="me"), get, sleep=lambda s: None).collect()}
    assert len(rows) == 2 and rows["https://h.org/ok"]["status"] == 200 and rows["https://h.org/no"]["headers"] == {"a": "me"}


def test_fetcher_keeps_to_the_limits_of_hosts(spark):
    """No more requests at a time than a host allows, and a pause before each of its own."""
    from linkloom.config import HostConfig

    def get(method, url, headers, timeout):
        import sys
        import threading
        import time

        lock, now, most = sys.__dict__.setdefault("linkloom_test", (threading.Lock(), {}, {}))  # the worker's own
        host = url.split("/")[2]
        with lock:
            now[host] = now.get(host, 0) + 1
            most[host] = max(most.get(host, 0), now[host])
        time.sleep(0.05)
        with lock:
            now[host] -= 1
        return {"status": 200, "error_class": "none", "body": f"{most[host]} {headers.get('x', '')}", "redirects": []}

    urls = spark.createDataFrame([(f"https://{h}/{k}",) for h in ("one.org", "two.org") for k in range(8)], "url string")
    config = LinkCheckConfig(host_concurrency=4, host_request_interval_ms=0, max_concurrency=8, hosts={"one.org": HostConfig(concurrency=1, headers={"x": "y"})})
    got = fetch.fetch(urls, config, get).collect()
    seen = {h: max(int(r["body"].split()[0]) for r in got if h in r["url_nofrag"]) for h in ("one.org", "two.org")}
    assert len(got) == 16 and seen["one.org"] == 1 and 1 < seen["two.org"] <= 4
    assert all(r["body"].endswith("y") == ("one.org" in r["url_nofrag"]) for r in got)


def test_tls_options():
    import ssl

    assert fetch.tls_context(True, None).verify_mode == ssl.CERT_NONE
    assert fetch.tls_context(False, "TLSv1_3").minimum_version == ssl.TLSVersion.TLSv1_3
    with pytest.raises(ValueError):
        fetch.tls_context(False, "SSLv3")


def test_run_cache_by_a_table(spark):
    """Random requests against a dictionary that is asked one by one."""
    import random

    from linkloom.operators.run_cache import host_caches, run_cache

    rng = random.Random(9)
    status = {f"https://h{k % 3}.org/{k}": rng.choice([200, 404, 429, 500, 408, None]) for k in range(30)}
    asked = [(rng.choice(["GET", "HEAD"]), rng.choice(sorted(status)) + rng.choice(["", "#a"]), rng.random() < 0.3, n) for n in range(400)]
    kept, hits, misses = {}, {}, {}
    for method, url, body, _ in asked:
        key = (method, url.split("#")[0])
        if key in kept and (kept[key] or not body):
            hits[key] = hits.get(key, 0) + 1
            continue
        misses[key] = misses.get(key, 0) + 1
        code = status[key[1]]
        if code is not None and code not in (408, 429) and code < 500:
            kept[key] = body
    outcomes = spark.createDataFrame([(m, u, s) for u, s in status.items() for m in ("GET", "HEAD", "GET")], "method string, url_nofrag string, status int")
    keys = run_cache(spark.createDataFrame(asked, "method string, url string, needs_body boolean, seq int"), outcomes)
    got = {(r["method"], r["url_nofrag"]): (r["hits"], r["misses"], r["stored"]) for r in keys.collect()}
    assert got == {k: (hits.get(k, 0), misses[k], k in kept) for k in misses}
    assert sum(r["cache_size"] for r in host_caches(keys).collect()) == len(kept)


def test_cookies(tmp_path):
    jar = tmp_path / "jar.json"
    assert fetch.load_cookies(str(jar)) == []
    fetch.save_cookies(str(jar), [{"name": "a", "value": "1", "domain": ".h.org"}, {"name": "b", "value": "2", "domain": "x.h.org", "path": "/p"}])
    cookies = fetch.load_cookies(str(jar))
    assert fetch.cookie_header(cookies, "x.h.org", "/p/q") == "a=1; b=2" and fetch.cookie_header(cookies, "h.org") == "a=1" and fetch.cookie_header(cookies, "noth.org") == ""
    jar.write_text("{}")
    with pytest.raises(ValueError):
        fetch.load_cookies(str(jar))


def test_reset_headers(spark):
    rows = [(429, {"retry-after": "2"}), (200, {"retry-after": "2"}), (200, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "7"}), (200, {"ratelimit-remaining": "3", "ratelimit-reset": "7"}), (429, {"retry-after": "soon"}), (429, None)]
    df = spark.createDataFrame(rows, "code int, headers map<string,string>")
    assert [r[0] for r in df.select(backoff.reset_ms(F.col("headers"), F.col("code"))).collect()] == [2000, None, 7000, None, None, None]


def test_natural_order():
    assert sorted(["b10", "B9", "a", "b1"], key=report.natural_key) == ["a", "b1", "B9", "b10"]
    assert check.retry_waits(3, 1.0) == [1.0, 2.0, 4.0]


def test_dump(spark, world):
    requests = pipeline.requests_of(world[0], LinkCheckConfig())
    lines = [r[0] for r in report.dump_links(requests, LinkCheckConfig()).collect()]
    assert lines.count("https://h.org/ok") == 3 and "mailto:a@b.org" not in lines
    assert "mailto:a@b.org [excluded]" in [r[0] for r in report.dump_links(requests, LinkCheckConfig(verbose=1)).collect()]


def test_write_report(responses, tmp_path):
    out = tmp_path / "r.json"
    pipeline.write_report(responses, LinkCheckConfig(format="json", output=str(out)))
    assert json.loads(out.read_text())["total"] == 11
    for form in ("compact", "detailed", "markdown", "junit"):
        assert pipeline.write_report(responses, LinkCheckConfig(format=form, mode="emoji"))
