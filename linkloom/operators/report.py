"""Texts for people and machines: response lines, dumps, reports and hints.

Lines are Columns, so a dump of any size is written by the tasks that have the rows.
Reports are sorted by Spark and come in pieces, of which the driver holds one source's
suggestions or redirects and one partition of rows at a time: ``*_parts`` give them, to
be written as they come, and the functions without that ending join them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig, shown_duration
from linkloom.functions import status as S
from linkloom.functions import uri as U
from linkloom.operators import stats as ST
from linkloom.operators.extract.batches import joined, pieces, values

NAME = "link check results"


def redirects_text(redirects: Column) -> Column:
    hops = F.transform(redirects["redirects"], lambda r: F.concat(F.lit(" --["), r["code"].cast("string"), F.lit("]--> "), r["url"]))
    return F.concat(redirects["origin"], F.array_join(hops, ""))


def place_text(columns: Iterable[str]) -> Column:
    """`` (at line:column)`` of a response row, null without a span."""
    if "span" not in columns:
        return F.lit(None).cast("string")
    column = F.coalesce(F.concat(F.lit(":"), F.col("span.column").cast("string")), F.lit(""))
    return F.when(F.col("span").isNotNull(), F.concat(F.lit(" (at "), F.col("span.line").cast("string"), column, F.lit(")")))


def body_text(columns: Iterable[str] = ("span", "remap", "redirects")) -> Column:
    """``uri (at line:column) | details | Remaps: ... | Followed n redirect(s). Redirects: ...`` of a response row."""
    have, uri, s = set(columns), F.col("uri"), F.col("status")
    none = F.lit(None).cast("string")
    at = place_text(have)
    remap = F.when(F.col("remap").isNotNull(), F.concat(F.lit(" | Remaps: "), F.col("remap.original"), F.lit(" --> "), F.col("remap.new"))) if "remap" in have else none
    chain = none
    if "redirects" in have:
        n = F.size(F.col("redirects.redirects"))
        chain = F.when(F.col("redirects").isNotNull(), F.concat(F.lit(" | Followed "), n.cast("string"), F.when(n == 1, " redirect").otherwise(" redirects"), F.lit(". Redirects: "), redirects_text(F.col("redirects"))))
    plain = F.coalesce((s["kind"] == S.OK) & (s["code"] == 200) & ~s["cached"], F.lit(False)) & remap.isNull() & chain.isNull()
    details = F.when(~plain, F.concat(F.lit(" | "), F.coalesce(s["details"], s["text"], F.lit(""))))
    blank = F.lit("")
    return F.concat(uri, F.coalesce(at, blank), F.coalesce(details, blank), F.coalesce(remap, blank), F.coalesce(chain, blank))


def response_line(mode: str = "plain", columns: Iterable[str] = ("span", "remap", "redirects")) -> Column:
    """A response row as one line in one of the modes plain, color, emoji, task."""
    s, body = F.col("status"), body_text(columns)
    code = F.concat(F.lit("["), S.code_shown(s), F.lit("]"))
    k = s["kind"]
    if mode == "emoji":
        mark = F.when(k == S.OK, "✅").when((k == S.EXCLUDED) & ~s["cached"], "👻").when(k.isin(S.EXCLUDED, S.UNSUPPORTED), "🚫").when(k.isin(S.TIMEOUT, S.UNKNOWN_CODE, S.UNKNOWN_MAIL), "⚠️").otherwise("❌")
        return F.concat(mark, F.lit(" "), body)
    if mode == "task":
        return F.concat(F.lit("- [ ] "), code, F.lit(" "), body)
    if mode == "color":
        color = F.when(k == S.OK, "\x1b[32m").when(k.isin(S.EXCLUDED, S.UNSUPPORTED), "\x1b[2m").when(k.isin(S.TIMEOUT, S.UNKNOWN_CODE, S.UNKNOWN_MAIL), "\x1b[33m").otherwise("\x1b[35m")
        # codes are right-aligned to a width of ten
        return F.concat(color, F.lpad(code, F.greatest(F.length(code), F.lit(10)), F.lit(" ")), F.lit("\x1b[0m "), body)
    return F.concat(code, F.lit(" "), body)


def dump_links(requests: DataFrame, config: LinkCheckConfig) -> DataFrame:
    """Lines of a link dump: URIs after remap, without those left out unless verbose; nothing is deduplicated."""
    from linkloom.operators.check import prepared

    rows = prepared(requests.where("uri is not null"), config)
    if config.get("verbose") < 1:
        rows = rows.where(~F.col("excluded") & ~F.coalesce(U.scheme(F.col("uri")) == "data", F.lit(False)))
    return rows.select(F.concat("uri", F.when(F.col("excluded"), F.lit(" [excluded]")).otherwise("")).alias("line"))


def dump_inputs(contents: DataFrame) -> DataFrame:
    """Distinct sources as they are shown."""
    shown = F.when(F.col("source_kind") == "stdin", "<stdin>").when(F.col("source_kind") == "string", "<raw string>").otherwise(F.col("source"))
    return contents.select(shown.alias("source")).distinct()


def natural_key(text: str) -> list:
    """Case-insensitive order in which numbers count by value."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", text.lower())]


ISSUES = ("error", "timeout", "unsupported")
ROWS, SUGGESTIONS, REDIRECTS = range(3)


def _texts(function: Callable[..., str | None], *columns: Column) -> Column:
    """A text made by Python of the columns of each row, in the tasks that have the rows."""

    def run(*batch: pa.Array) -> pa.Array:
        return joined([pa.array([function(*r) for r in zip(*map(values, p), strict=True)], pa.string()) for p in pieces(*batch)], pa.string())

    return F.arrow_udf(run, "string")(*columns)


def _part(rows: DataFrame, section: Column | int, part: int, text: Column, order: Column) -> DataFrame:
    """Rows for a report: section, source, part, text; ``order`` is the order within a source's part."""
    section = F.lit(section) if isinstance(section, int) else section
    return rows.select(section.cast("int").alias("section"), "source", F.lit(part).alias("part"), text.alias("text"), F.lower(order).alias("by"), order.alias("then"))


def _redirects(responses: DataFrame, section: int) -> DataFrame:
    text = redirects_text(F.col("redirects"))
    return _part(ST.redirects_per_source(responses), section, REDIRECTS, text, text)


def _suggested(suggestions: DataFrame, section: int) -> DataFrame:
    text = F.concat("original", F.lit(" --> "), "suggestion")
    return _part(suggestions.select("source", "original", "suggestion").distinct(), section, SUGGESTIONS, text, text)


def _groups(*parts: DataFrame) -> Iterator[tuple[int, str, int, Iterator[str]]]:
    """(section, source, part, texts) in the order of reports; each is to be read before the next. Texts that are no rows are in natural order."""
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.orderBy("section", *ST.display_order("source"), "part", "by", "then").select("section", "source", "part", "text")
    for (section, source, part), found in groupby(rows.toLocalIterator(), key=lambda r: (r[0], r[1], r[2])):
        texts = (r[3] for r in found)
        yield section, source, part, texts if part == ROWS else iter(sorted(texts, key=natural_key))


def compact_parts(responses: DataFrame, suggestions: DataFrame | None = None, mode: str = "plain", seconds: float = 0.0) -> Iterator[str]:
    c = ST.counters(responses).first()
    found = ST.per_source(responses, False).where(F.col("class").isin(*ISSUES))
    if issues := found.select("source", "class").distinct().count():
        yield f"Issues found in {issues} {'input' if issues == 1 else 'inputs'}. Find details below.\n\n"
    parts = [_part(found, 0, ROWS, response_line(mode, found.columns), body_text(found.columns))]
    if suggestions is not None:
        parts.append(_suggested(suggestions, 0))
    shown = None
    for _, source, part, texts in _groups(*parts):
        if part == ROWS:
            if shown is not None:
                yield "\n"
            shown = source
            yield f"[{source}]:\n"
            yield from (f"{x}\n" for x in texts)
        elif source == shown:
            yield "\nℹ Suggestions\n"
            yield from (f"{x}\n" for x in texts)
    if shown is not None:
        yield "\n"
    line = f"🔍 {c['total']} Total (in {shown_duration(seconds, True)}) 🔗 {c['unique']} Unique ✅ {c['successful']} OK 🚫 {c['errors']} {'Error' if c['errors'] == 1 else 'Errors'}"
    for icon, name, key in (("❓", "Unknown", "unknown"), ("👻", "Excluded", "excludes"), ("⏳", "Timeouts", "timeouts"), ("⛔", "Unsupported", "unsupported"), ("🔀", "Redirects", "redirects")):
        if c[key]:
            line += f" {icon} {c[key]} {name}"
    yield line


def compact(responses: DataFrame, suggestions: DataFrame | None = None, mode: str = "plain", seconds: float = 0.0) -> str:
    return "".join(compact_parts(responses, suggestions, mode, seconds))


SUMMARY = (("🔍 Total", "total"), ("🔗 Unique", "unique"), ("✅ Successful", "successful"), ("⏳ Timeouts", "timeouts"), ("🔀 Redirected", "redirects"), ("👻 Excluded", "excludes"), ("❓ Unknown", "unknown"), ("🚫 Errors", "errors"), ("⛔ Unsupported", "unsupported"))
WIDTH = 20


def detailed_parts(responses: DataFrame, suggestions: DataFrame | None = None, mode: str = "plain") -> Iterator[str]:
    c = ST.counters(responses).first()
    yield "\n".join(["📝 Summary", "-" * (WIDTH + 1), *(title + str(c[key]).rjust(WIDTH - len(title), ".") for title, key in SUMMARY)])
    found = ST.per_source(responses, True).where(F.col("class").isin(*ISSUES))
    ignored = F.when(F.col("class") == "unsupported", 1).otherwise(0)
    parts = [_part(found, ignored, ROWS, response_line(mode, found.columns), body_text(found.columns)), _redirects(responses, 0)]
    if suggestions is not None:
        parts.append(_suggested(suggestions, 0))
    shown = None
    for section, source, part, texts in _groups(*parts):
        if part == ROWS:
            shown = source
            yield f"\n\n{'Ignored' if section else 'Errors'} in {source}"
            yield from (f"\n{x}" for x in texts)
        elif source == shown:
            yield f"\n\n{'Suggestions' if part == SUGGESTIONS else 'Redirects'} in {source}\n"
            yield from (f"{x}\n" for x in texts)


def detailed(responses: DataFrame, suggestions: DataFrame | None = None, mode: str = "plain") -> str:
    return "".join(detailed_parts(responses, suggestions, mode))


def _width(text: str) -> int:
    """Columns of a terminal that a text takes."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table(heads: list[str], rows: list[list[str]]) -> str:
    """A Markdown table, left-aligned."""
    wide = [max(_width(r[k]) for r in [heads, *rows]) for k in range(len(heads))]
    line = lambda r: "| " + " | ".join(x + " " * (w - _width(x)) for x, w in zip(r, wide, strict=True)) + " |"
    return "\n".join([line(heads), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows)])


def markdown_parts(responses: DataFrame, suggestions: DataFrame | None = None) -> Iterator[str]:
    c = ST.counters(responses).first()
    yield "# Summary\n\n" + table(["Status", "Count"], [[t, str(c[k])] for t, k in SUMMARY]) + "\n"
    titles = ("Errors", "Timeouts", "Ignored", "Redirects", "Suggestions")
    found = ST.per_source(responses, True).where(F.col("class").isin(*ISSUES))
    section = F.when(F.col("class") == "error", 0).when(F.col("class") == "timeout", 1).otherwise(2)
    why = F.coalesce(F.nullif(F.col("status.details"), F.lit("")), F.col("status.text"), F.lit(""))
    text = F.concat(F.lit("["), S.code_shown(F.col("status")), F.lit("] <"), F.col("uri"), F.lit(">"), F.coalesce(place_text(found.columns), F.lit("")), F.lit(" | "), why)
    parts = [_part(found, section, ROWS, text, body_text(found.columns)), _redirects(responses, 3)]
    if suggestions is not None:
        parts.append(_suggested(suggestions, 4))
    last = None
    for k, source, _, texts in _groups(*parts):
        if k != last:
            yield f"\n## {titles[k]} per input\n"
        last = k
        yield f"\n### {titles[k]} in {source}\n\n"
        yield from (f"* {x}\n" for x in texts)


def markdown(responses: DataFrame, suggestions: DataFrame | None = None) -> str:
    return "".join(markdown_parts(responses, suggestions))


def status_json(status: Column) -> Column:
    """struct(text, code, details): the code where there is one, else the details."""
    return F.struct(status["text"].alias("text"), status["code"].alias("code"), F.when(status["code"].isNull(), status["details"]).alias("details"))


MAPS = ("success", "error", "timeout", "suggestion", "redirect", "excluded", "unsupported")


def _indented(x: object) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False, default=str)


def json_entries(responses: DataFrame, detailed: bool = False) -> DataFrame:
    """Responses as the JSON report shows them, with class and source: the entries of its maps, made where the rows are."""
    found = ST.per_source(responses, detailed)
    body = F.to_json(F.struct(F.col("uri").alias("url"), status_json(F.col("status")).alias("status"), *(F.col(c) for c in ("redirects", "remap", "span", "duration_ms") if c in found.columns)))
    return found.select("class", "source", "uri", _texts(lambda x: _indented(json.loads(x)), body).alias("entry"))


def json_parts(responses: DataFrame, suggestions: DataFrame | None = None, hosts: DataFrame | None = None, seconds: float = 0.0, detailed: bool = False) -> Iterator[str]:
    yield _indented(ST.counters(responses).first().asDict())[:-2]
    found = json_entries(responses, detailed)
    number = F.array_position(F.array(*map(F.lit, MAPS)), F.col("class")) - 1
    parts = [_part(found, number, ROWS, F.col("entry"), F.col("uri"))]
    if detailed:
        parts.append(_redirects(responses, MAPS.index("redirect")))
    if suggestions is not None:
        parts.append(_suggested(suggestions, MAPS.index("suggestion")))
    done, inside = 0, False  # maps that are begun, and whether the last of them holds a source
    for k, source, part, texts in _groups(*parts):
        while done <= k:
            yield ("\n  }" if inside else "}" if done else "") + f',\n  "{MAPS[done]}_map": {{'
            done, inside = done + 1, False
        yield ("," if inside else "") + f"\n    {json.dumps(source, ensure_ascii=False)}: ["
        inside = True
        for n, x in enumerate(texts):
            shown = (x if part == ROWS else _indented(x)).replace("\n", "\n      ")
            yield ("," if n else "") + "\n      " + shown
        yield "\n    ]"
    while done < len(MAPS):
        yield ("\n  }" if inside else "}" if done else "") + f',\n  "{MAPS[done]}_map": {{'
        done, inside = done + 1, False
    yield ("\n  }" if inside else "}") + f',\n  "duration_ms": {round(seconds * 1000)},\n  "detailed_stats": {json.dumps(detailed)}'
    if hosts is not None:
        yield ',\n  "host_stats": {'
        n = 0
        for r in ST.sorted_hosts(hosts).toLocalIterator():
            shown = _indented({k: v for k, v in r.asDict().items() if k != "host"}).replace("\n", "\n    ")
            yield ("," if n else "") + f"\n    {json.dumps(r['host'], ensure_ascii=False)}: {shown}"
            n += 1
        yield "\n  }" if n else "}"
    yield "\n}"


def json_report(responses: DataFrame, suggestions: DataFrame | None = None, hosts: DataFrame | None = None, seconds: float = 0.0, detailed: bool = False) -> str:
    return "".join(json_parts(responses, suggestions, hosts, seconds, detailed))


_CASES = {"error": ("Failed", "failure"), "excluded": ("Excluded", "skipped"), "success": ("Successful", "")}


def _junit_case(kind: str, uri: str, source: str, line: int | None, duration_ms: float | None, body: str) -> str:
    word, tag = _CASES[kind]
    place = "" if line is None else f" line={quoteattr(str(line))}"
    time = "" if duration_ms is None else f" time={quoteattr(f'{duration_ms / 1000:.3f}')}"
    inner = f"<{tag} message={quoteattr(body)}/>" if tag else ""
    return f"<testcase name={quoteattr(f'{word} {uri}')}{time} file={quoteattr(source)}{place}>{inner}<system-out>{escape(body)}</system-out></testcase>"


def junit_cases(responses: DataFrame) -> DataFrame:
    """The test cases of the JUnit report with class, source and body: their XML is made where the rows are."""
    found = ST.per_source(responses, True).where(F.col("class").isin(*_CASES))
    found = found.withColumn("body", body_text(found.columns))
    line = F.col("span.line") if "span" in found.columns else F.lit(None).cast("int")
    return found.select("class", "source", "body", _texts(_junit_case, F.col("class"), F.col("uri"), F.col("source"), line, F.col("duration_ms"), F.col("body")).alias("case"))


def junit_parts(responses: DataFrame) -> Iterator[str]:
    """Errors fail, exclusions are skipped, successes pass; timeouts and unsupported ones are left out."""
    found = junit_cases(responses)
    n = dict.fromkeys(_CASES, 0) | {r[0]: r[1] for r in found.groupBy("class").count().collect()}  # three rows
    counts = f'tests="{sum(n.values())}" errors="0" failures="{n["error"]}"'
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="{NAME}" {counts}>\n    <testsuite name="{NAME}" {counts} disabled="{n["excluded"]}">\n'
    order = F.when(F.col("class") == "error", 0).when(F.col("class") == "excluded", 1).otherwise(2)
    for r in found.orderBy(order, F.lower("source"), "source", "body").select("case").toLocalIterator():
        yield f"        {r[0]}\n"
    yield "    </testsuite>\n</testsuites>"


def junit(responses: DataFrame) -> str:
    return "".join(junit_parts(responses))


def host_table(hosts: DataFrame, form: str = "compact") -> str:
    """Host statistics as compact, detailed or markdown text."""
    rows = list(ST.sorted_hosts(hosts).toLocalIterator())
    ms = lambda r: "N/A" if r["median_ms"] is None else f"{int(r['median_ms'])}ms"
    if form == "markdown":
        heads = ["Host", "Requests", "Success Rate", "Network Errors", "Median Time", "Cache Hit Rate"]
        body = [[r["host"], str(r["total_requests"]), f"{r['success_rate'] * 100:.1f}%", str(r["network_errors"]), ms(r), f"{r['cache_hit_rate'] * 100:.1f}%"] for r in rows]
        return "\n## Per-host Statistics\n\n" + (table(heads, body) if body else "")
    if form == "detailed":
        out = ["\n📊 Per-host Statistics", "-" * 21]
        for r in rows:
            out += [f"\nHost: {r['host']}", f"  Total requests: {r['total_requests']}", f"  Successful: {r['successful_requests']} ({r['success_rate'] * 100:.1f}%)"]
            for key, text in (("rate_limited", "Rate limited: {} (429 Too Many Requests)"), ("client_errors", "Client errors (4xx): {}"), ("server_errors", "Server errors (5xx): {}"), ("network_errors", "Network errors: {}")):
                if r[key]:
                    out.append("  " + text.format(r[key]))
            if r["median_ms"] is not None:
                out.append(f"  Median response time: {ms(r)}")
            if r["cache_hit_rate"] > 0:
                out += [f"  Cache hit rate: {r['cache_hit_rate'] * 100:.1f}%", f"  Cache hits: {r['cache_hits']}, misses: {r['cache_misses']}"]
        return "\n".join(out)
    width = max([10, *(len(r["host"]) + 2 for r in rows)])
    body = [f"{r['host']:<{width}} │ {r['total_requests']:>6} reqs │ {r['success_rate'] * 100:>6.1f}% success │ {ms(r):>8} median │ {r['cache_hit_rate'] * 100:>6.1f}% cached" for r in rows]
    return "\n".join(["\n📊 Per-host Statistics", "─" * 60, *body])


# Advice by what a run has shown.
HINT_RATE_LIMIT = "Encountered rate limit responses. You might be able to work around this by adding `[hosts.\"{}\"]` to the TOML config to adjust the `concurrency` and `request_interval` values."
HINT_GITHUB = "GitHub seems to be rate limiting us. You could try setting a GitHub token with `--github-token`"
HINT_REDIRECTS = "Followed {} {}. You might want to consider replacing redirecting URLs with the resolved URLs. Use verbose mode (`-v`/`-vv`) to see redirection details."
HINT_CODES = "You can configure accepted/rejected response codes with `-a` or `--accept`"
HINT_UNFOLLOWED = "Rejected redirectional status codes. This means some redirects were not followed. You might want to increase the limit for `-m`/`--max-redirects`."
HINT_FRAGMENTS = "Fragments aren't checked for `{}` requests. Use `--method get`."
HINT_ROOT = "Unresolved root-relative links in local files. To resolve these links to a local directory, provide a root dir with `--root-dir`. Alternatively, if the site should be relocatable, consider using directory-relative links instead."


def hints(responses: DataFrame, config: LinkCheckConfig) -> DataFrame:
    """Distinct hints (hint), from one aggregation over all responses."""
    s, kind = F.col("status"), F.col("status.error_kind")
    rejected = (s["kind"] == S.ERROR) & (kind == "RejectedStatusCode") & ~s["cached"]
    code = s["code"]
    a = responses.agg(
        F.min(F.when(rejected & (code == 429), U.domain(F.col("uri")))).alias("limited"),
        F.bool_or(F.endswith(U.domain(F.col("uri")), F.lit("github.com")) & (s["kind"] == S.ERROR) & code.isin(403, 429)).alias("github"),
        F.count_if(F.col("redirects").isNotNull()).alias("redirects"),
        F.bool_or(rejected).alias("rejected"),
        F.bool_or(rejected & code.between(300, 399)).alias("unfollowed"),
        F.bool_or((s["kind"] == S.REQUEST_ERROR) & (kind == "RootRelativeLinkWithoutRoot")).alias("rooted"),
    )
    head, tail = HINT_RATE_LIMIT.split("{}")
    made = []
    if not config.hosts:
        made.append(F.when(F.col("limited").isNotNull(), F.concat(F.lit(head), F.col("limited"), F.lit(tail))))
    if config.github_token is None:
        made.append(F.when(F.col("github"), HINT_GITHUB))
    if config.get("verbose") < 1:
        made.append(F.when(F.col("redirects") > 0, F.format_string(HINT_REDIRECTS.replace("{}", "%s"), F.col("redirects"), F.when(F.col("redirects") == 1, "redirect").otherwise("redirects"))))
    if config.accepted == S.DEFAULT_ACCEPT:
        made.append(F.when(F.col("rejected"), HINT_CODES))
    if config.get("max_redirects") <= 10:
        made.append(F.when(F.col("unfollowed"), HINT_UNFOLLOWED))
    if config.get("include_fragments") != "none" and config.methods[0] != "GET":
        made.append(F.lit(HINT_FRAGMENTS.format(config.methods[0])))
    made.append(F.when(F.col("rooted"), HINT_ROOT))
    return a.select(F.explode(F.array_compact(F.array(*made))).alias("hint")).distinct()
