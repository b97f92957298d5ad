"""Waiting times that a host asks for, as a fold over its responses in order.

A 2xx ends the wait; a 429 doubles it from 500 ms to at most 30 s; a 5xx adds 200 ms up
to 10 s; a reset time in a header is a lower bound, at most 60 s. The fold has a reset
and a cap, so no window function expresses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in milliseconds.
FIRST_429, MOST_429, STEP_5XX, MOST_5XX, MOST_HEADER = 500, 30_000, 200, 10_000, 60_000


def step(backoff: int, code: int | None, reset_ms: int | None = None) -> int:
    """The wait after one response."""
    if reset_ms:
        backoff = max(backoff, min(reset_ms, MOST_HEADER))
    if code is None:
        return backoff
    if 200 <= code < 300:
        return 0
    if code == 429:
        return min(FIRST_429 if backoff == 0 else backoff * 2, MOST_429)
    return min(backoff + STEP_5XX, MOST_5XX) if 500 <= code < 600 else backoff


def _step(b: Column, x: Column) -> Column:
    raised = F.greatest(b, F.least(F.coalesce(x["reset_ms"], F.lit(0)).cast("bigint"), F.lit(MOST_HEADER).cast("bigint")))
    code = x["code"]
    return (
        F.when(code.between(200, 299), F.lit(0).cast("bigint"))
        .when(code == 429, F.least(F.when(raised == 0, F.lit(FIRST_429).cast("bigint")).otherwise(raised * 2), F.lit(MOST_429).cast("bigint")))
        .when(code.between(500, 599), F.least(raised + STEP_5XX, F.lit(MOST_5XX).cast("bigint")))
        .otherwise(raised)
    )


def reset_ms(headers: Column, code: Column) -> Column:
    """Milliseconds until a limit is lifted, by the headers of a response; null where it is not limited.

    ``retry-after`` counts for 429 and 503; else a reset time (seconds to wait) counts
    where no requests remain.
    """
    number = lambda *names: F.coalesce(*(F.try_to_number(F.try_element_at(headers, F.lit(n)), F.lit("9999999999")).cast("bigint") for n in names))
    after = F.when(code.isin(429, 503), number("retry-after"))
    reset = F.when(number("ratelimit-remaining", "x-ratelimit-remaining", "x-rate-limit-remaining") == 0, number("ratelimit-reset", "x-ratelimit-reset", "x-rate-limit-reset"))
    return F.nullif(F.coalesce(after, reset), F.lit(0).cast("bigint")) * 1000


#: After so many 429s and 5xxs in a row the wait is the same whatever it was before:
#: a wait grows by 200 ms a step at least until a cap makes all of them equal.
SETTLED = 64


def host_backoff(requests: DataFrame) -> DataFrame:
    """Per host the wait after its last response: host, backoff_ms.

    Only what follows a host's last 2xx matters, and of that the last ``SETTLED`` 429s
    and 5xxs (the steps), and of the reset times between two steps the greatest. So the
    fold reads at most 129 entries even of a host with most of the rows, and is exact.
    """
    reset = F.col("reset_ms") if "reset_ms" in requests.columns else F.lit(None).cast("bigint")
    rows = requests.select("host", F.struct("ts", "event_id").alias("at"), "code", reset.cast("bigint").alias("reset_ms"))
    last = rows.groupBy("host").agg(F.max(F.when(F.col("code").between(200, 299), F.col("at"))).alias("last_ok"))
    stepping = F.coalesce((F.col("code") == 429) | F.col("code").between(500, 599), F.lit(False))
    tail = rows.where(stepping | F.col("reset_ms").isNotNull()).join(last, "host").where(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))).drop("last_ok")
    recent = tail.where(stepping).withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("at")))).where(F.col("k") <= SETTLED)
    steps = recent.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "code", "reset_ms"))).alias("steps"))
    # reset times on responses that are no steps, by the number of steps before them
    none = F.array().cast(steps.schema["steps"].dataType)
    between = tail.where(~stepping).join(steps, "host", "left").withColumn("steps", F.coalesce("steps", none))
    between = between.select("host", "reset_ms", F.size("steps").alias("n"), F.size(F.filter("steps", lambda x: x["at"] <= F.col("at"))).alias("nth"))
    between = between.where((F.col("nth") > 0) | (F.col("n") < SETTLED)).groupBy("host", "nth").agg(F.max("reset_ms").alias("reset_ms"))
    entry = lambda nth, kind, code, ms: F.struct(nth.cast("int").alias("nth"), F.lit(kind).alias("kind"), code.cast("int").alias("code"), ms.alias("reset_ms"))
    resets = between.groupBy("host").agg(F.collect_list(entry(F.col("nth"), 1, F.lit(None), F.col("reset_ms"))).alias("resets"))
    log = steps.join(resets, "host", "full_outer")
    made = F.transform(F.coalesce("steps", none), lambda x, k: entry(k + 1, 0, x["code"], x["reset_ms"]))
    log = log.select("host", F.array_sort(F.concat(made, F.coalesce("resets", F.array().cast(resets.schema["resets"].dataType)))).alias("log"))
    folded = log.select("host", F.aggregate("log", F.lit(0).cast("bigint"), _step).alias("backoff_ms"))
    return last.select("host").join(folded, "host", "left").fillna(0, ["backoff_ms"])
