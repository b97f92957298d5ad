"""The whole check as one plan: contents to links to requests to responses to statistics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import LinkCheckConfig
from linkloom.operators import check as C
from linkloom.operators import report, resolve, stats
from linkloom.operators.extract.links import extract_links


def requests_of(contents: DataFrame, config: LinkCheckConfig) -> DataFrame:
    """Documents to requests; narrow, so a document's links are made where it is read.

    A source that could not be read (error_kind is set) is one request that is an error.
    """
    failed = contents.where("error_kind is not null") if "error_kind" in contents.columns else None
    fine = contents if failed is None else contents.where("error_kind is null").drop("error_kind", "error_text")
    links = extract_links(fine, config.get("include_verbatim"), config.get("include_wikilinks"), config.get("tree_rules"))
    requests = resolve.to_requests(links, config.base_url, config.root_dir)
    if failed is None:
        return requests
    text = F.col("error_text") if "error_text" in contents.columns else F.col("error_kind")
    errors = failed.select("source", "source_kind", "error_kind", F.coalesce(text, "error_kind").alias("error_text"))
    return requests.unionByName(errors, allowMissingColumns=True)


def check_links(contents: DataFrame, snapshots: C.Snapshots, config: LinkCheckConfig | None = None, store: str | None = None) -> DataFrame:
    """Responses of all links in the documents.

    With ``store``, a folder that driver and executors share, the requests are written
    there once as Parquet, so documents are parsed once however often links are read.
    """
    config = config or LinkCheckConfig()
    requests = requests_of(contents, config)
    if store is not None:
        requests.write.mode("overwrite").parquet(store)
        requests = contents.sparkSession.read.schema(requests.schema).parquet(store)
    return C.check(requests, snapshots, config)


def summary(contents: DataFrame, snapshots: C.Snapshots, config: LinkCheckConfig | None = None) -> DataFrame:
    return stats.counters(check_links(contents, snapshots, config))


def report_parts(responses: DataFrame, config: LinkCheckConfig, suggestions: DataFrame | None = None, hosts: DataFrame | None = None, seconds: float = 0.0) -> Iterator[str]:
    """The report in the configured format, in pieces."""
    form = config.get("format")
    if form == "json":
        yield from report.json_parts(responses, suggestions, hosts, seconds, config.detailed)
    elif form == "junit":
        yield from report.junit_parts(responses)
    elif form == "markdown":
        yield from report.markdown_parts(responses, suggestions)
    elif form == "detailed":
        yield from report.detailed_parts(responses, suggestions, config.get("mode"))
    else:
        yield from report.compact_parts(responses, suggestions, config.get("mode"), seconds)
    if hosts is not None and form in ("compact", "detailed", "markdown"):
        yield "\n" + report.host_table(hosts, form)


def write_report(responses: DataFrame, config: LinkCheckConfig, suggestions: DataFrame | None = None, hosts: DataFrame | None = None, seconds: float = 0.0) -> str | None:
    """The report in the configured format. If ``output`` is set it is written there piece by piece, and nothing is returned."""
    parts = report_parts(responses, config, suggestions, hosts, seconds)
    if not config.output:
        return "".join(parts)
    with open(config.output, "w", encoding="utf-8") as f:
        f.writelines(parts)
    return None
