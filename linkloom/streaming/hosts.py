"""Continuous mode: links and request logs as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom.operators.backoff import step

BACKOFF = "host string, event_id bigint, backoff_ms bigint"


class Backoff(StatefulProcessor):
    """Keeps each host's wait and gives it after every response; within a batch rows count by (ts, event_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("backoff", "backoff_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        wait = int(self.state.get()[0]) if self.state.exists() else 0
        out = []
        for code, reset in zip(found["code"], found["reset_ms"], strict=True):
            wait = step(wait, None if pd.isna(code) else int(code), None if pd.isna(reset) else int(reset))
            out.append(wait)
        self.state.update((wait,))
        yield pd.DataFrame({"host": key[0], "event_id": found["event_id"].to_numpy(), "backoff_ms": out})

    def close(self) -> None:
        pass


def backoff(requests: DataFrame) -> DataFrame:
    """A stream of requests (host, ts, event_id, code and, if known, reset_ms) to host, event_id, backoff_ms. Needs the RocksDB state store.

    A task holds what one host sends in one trigger, to put it in order; bound the
    triggers (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) where a host may send more.
    """
    reset = F.col("reset_ms") if "reset_ms" in requests.columns else F.lit(None)
    rows = requests.select("host", "ts", "event_id", "code", reset.cast("bigint").alias("reset_ms"))
    return rows.groupBy("host").transformWithStateInPandas(Backoff(), BACKOFF, "append", "None")


def distinct_links(links: DataFrame, key: str = "uri", event_time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Links not seen within ``delay``: state for older ones goes."""
    return links.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def host_counts(requests: DataFrame, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by host and window of event time; late rows count up to ``delay``."""
    code = F.col("code")
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide or window).alias("w"), "host")
        .agg(F.count("*").alias("requests"), F.count_if(code.between(200, 299)).alias("successful"), F.count_if(code == 429).alias("rate_limited"))
        .select(F.col("w.start").alias("window_start"), "host", "requests", "successful", "rate_limited")
    )
