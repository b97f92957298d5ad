import datetime as dt

from linkloom.operators.backoff import step
from linkloom.streaming import hosts

SCHEMA = "host string, ts timestamp, event_id bigint, code int, uri string"


def rows():
    start = dt.datetime(2024, 1, 1)
    codes = [429, 429, 500, 200, 503, 429, 404, 429]
    return [(f"h{k % 2}", start + dt.timedelta(minutes=k), k, codes[k % 8], f"u{k % 3}") for k in range(24)]


def run(spark, tmp_path, make, name, mode="append"):
    source = tmp_path / "in"
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_backoff_stream_equals_the_fold(spark, tmp_path):
    got = {r["event_id"]: r["backoff_ms"] for r in run(spark, tmp_path, hosts.backoff, "waits")}
    want, state = {}, {}
    for host, _, event_id, code, _ in rows():
        want[event_id] = state[host] = step(state.get(host, 0), code)
    assert got == want


def test_backoff_stream_with_reset_times(spark, tmp_path):
    from pyspark.sql import functions as F

    reset = F.when(F.col("code").isin(404, 429), F.col("event_id") * 300)
    got = {r["event_id"]: r["backoff_ms"] for r in run(spark, tmp_path, lambda s: hosts.backoff(s.withColumn("reset_ms", reset)), "resets")}
    want, state = {}, {}
    for host, _, event_id, code, _ in rows():
        want[event_id] = state[host] = step(state.get(host, 0), code, event_id * 300 if code in (404, 429) else None)
    assert got == want


def test_distinct_links(spark, tmp_path):
    got = run(spark, tmp_path, hosts.distinct_links, "links")
    assert sorted(r["uri"] for r in got) == ["u0", "u1", "u2"]


def test_windows(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: hosts.host_counts(s, delay="1 minute"), "windows")
    assert got and all(1 <= r["requests"] <= 3 for r in got)
