"""How work is dealt out, and what it holds at a time."""

import pytest

from linkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    [
        "ex_08_verbatim",
        "ex_06_link_attributes",
        "pr_04_08_base_and_root",
        "ex_19_nested_blocks",
        "ex_20_embedded_html",
        "ex_08_verbatim_included",
        "ex_15_reference_links",
        "ex_09_rel",
        "pr_01_parse_customers",
        "ex_10_stylesheets",
        "ex_11_mail_values",
        "ex_19_code_and_text",
    ],
)
def test_one_row_group_is_worked_on_by_all_cores(spark, name):
    rows = catalog.QUERIES[name](spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in rows) >= spark.sparkContext.defaultParallelism


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    from linkloom.operators.extract.batches import PIECE, joined, pieces

    texts = pa.array(["x" * (1 << 16)] * 100 + [None], pa.string())
    found = [p for (p,) in pieces(texts)]
    assert all(len(p) * (1 << 16) <= 2 * PIECE for p in found) and joined(found, pa.string()).equals(texts)
    assert joined([x for x, _ in pieces(texts[:0], texts[:0])], pa.string()).equals(texts[:0])


@pytest.mark.parametrize(
    "name",
    [
        "rp_04_junit_cases",
        "rp_03_json_maps",
    ],
)
def test_reports_are_read_where_they_are_made(spark, name):
    """Nothing of a report with a row for each link goes through the driver."""
    assert any("customer" in f for f in catalog.QUERIES[name](spark, SF).inputFiles())


def test_report_is_its_cases_and_entries(spark):
    import json

    from linkloom.operators import report
    from linkloom.plans import run_queries as R

    run = R.responses(spark, SF)
    lines = report.junit(run).split("\n")
    assert sorted(x.strip() for x in lines if "<testcase" in x) == sorted(r[0] for r in report.junit_cases(run).select("case").collect())
    whole = json.loads(report.json_report(run, detailed=True))
    shown = [(m, s, json.dumps(x)) for m in ("success", "error", "timeout", "excluded", "unsupported") for s, found in whole[f"{m}_map"].items() for x in found]
    entries = report.json_entries(run, detailed=True).collect()
    assert sorted(shown) == sorted((r["class"], r["source"], json.dumps(json.loads(r["entry"]))) for r in entries)


def _peak(function, *batch):
    """Bytes of Python objects that a call on a batch holds at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        out = function(*batch)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_links_of_a_batch_are_not_held_at_once(spark):
    import pyarrow as pa

    from linkloom.operators.extract.links import _link_udf

    page = "".join(f'<a href="/p/{k}">x</a>' for k in range(20)) + " " * 3000
    out, peak = _peak(_link_udf(False, False, False).func, pa.array([page] * 10_000), pa.array(["html"] * 10_000))
    assert len(out) == 10_000 and len(out.flatten()) == 200_000 and peak < 20 << 20


def test_resolved_texts_of_a_batch_are_not_held_at_once(spark):
    import pyarrow as pa

    from linkloom.operators.resolve import _resolver

    n = 20_000
    columns = [pa.array(x) for x in ([f"/ä/{k}" + "x" * 500 for k in range(n)], ["full"] * n, ["https://h.org/"] * n, [""] * n, [True] * n)]
    out, peak = _peak(_resolver(None).func, *columns)
    assert out[n - 1].as_py()["uri"].startswith(f"https://h.org/%C3%A4/{n - 1}x") and peak < 8 << 20


def test_pages_are_parsed_by_all_cores(spark):
    from linkloom.plans.literals import page_requests

    spark.catalog.clearCache()
    rows = page_requests(spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in rows) >= spark.sparkContext.defaultParallelism


def _nodes(plan):
    yield plan.nodeName()
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


@pytest.mark.parametrize(
    "name",
    [
        "jo_03_cache_hit_miss",
        "jo_02_dedup_join_back",
        "jo_04_existing_targets",
    ],
)
def test_pages_are_parsed_once(spark, name):
    """What is read several times is kept, so no branch of the plan makes links of its own."""
    spark.catalog.clearCache()
    found = list(_nodes(catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()))
    assert "InMemoryRelation" in found and "Generate" not in found


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that one row group lies in many of them."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "512")
    yield
    spark.conf.set(key, before)


def test_one_row_group_in_many_splits_is_dealt_out(spark, small_splits, tmp_path):
    from linkloom.session import spread

    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "rows.parquet")
    spark.range(20_000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    full = lambda df: [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert scan.rdd.getNumPartitions() >= 4 * cores and len(full(scan)) == 1
    found = full(spread(scan))
    assert len(found) >= cores and sum(found) == 20_000


def test_even_splits_stay_as_they_are(spark, tmp_path):
    from linkloom.session import spread

    path = str(tmp_path / "rows.parquet")
    spark.range(0, 20_000, 1, 4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and spread(scan) is scan
    finally:
        spark.conf.set(key, before)


def test_texts_that_are_left_as_they_are_are_not_walked(spark):
    import pyarrow as pa
    from test_extract import _lines_run

    from linkloom.operators.resolve import _resolver

    n, out = 5_000, []
    columns = [pa.array(x, t) for x, t in ([["/x"] * n, pa.string()], *[[[None] * n, pa.string()]] * 3, [[False] * n, pa.bool_()])]
    run = _resolver(None).func
    assert _lines_run(lambda: out.append(run(*columns))) < 200
    assert len(out[0]) == out[0].null_count == n


@pytest.mark.parametrize("name", ["jo_02_dedup_join_back", "jo_04_existing_targets"])
def test_pages_are_dealt_out_even_if_few_cores_are_known(spark, name):
    """A session that has just begun knows few executors."""
    from linkloom.plans.literals import pages

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(10 * spark.sparkContext.defaultParallelism))
    try:
        assert pages(spark, SF).rdd.getNumPartitions() == 10 * spark.sparkContext.defaultParallelism
        spark.catalog.clearCache()
        catalog.QUERIES[name](spark, SF)
        from linkloom.plans.literals import _HELD

        assert _HELD[0].rdd.getNumPartitions() >= 10 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(key, before)


def test_memory_of_a_batch_of_pages_does_not_grow_with_its_rows(spark):
    """The pages of jo_04_existing_targets: four times the rows in a batch, the same Python objects held."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from linkloom.operators.extract.links import _link_udf

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    run = _link_udf(False, False, False).func
    small, large = (_peak(run, pa.array(pages * n), pa.array(["html"] * n * len(pages)))[1] for n in (4, 16))
    assert large < 2 * small
