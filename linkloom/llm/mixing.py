"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The documents of a source form blocks of ``block`` documents, in the order of the MD5
of seed and doc_id. Source i has an integer weight w_i of a total Q. Its block j (from
0) is released at slot floor(j Q / w_i) and due by ceil((j + 1) Q / w_i); each slot
takes the released block that is due first. After t slots source i has had t w_i / Q
blocks, give or take less than one block.

The slots repeat after Q of them, so one period, or as many slots as there are blocks,
is simulated on the driver, from the weights and the numbers of blocks alone. With the
slot in which a source's last block stands, the phase ends, and the others go on under
their own weights in a new one: every document gets a place, none is repeated, and the
bound holds in each phase. As only the last slot of a phase can hold a short block,
the places lost before a phase are one number. Only the number of documents of each
source is gathered, a row for each source.

A source may hold any share of the rows: ranks are counted in buckets of the hash
and carried on by the buckets' counts, so no task gets a source as a whole.

Edge cases: a null source is a source of its own; a source without a weight has
``default_weight``; the last block of a source may be short; rows that repeat a
doc_id get places of their own; null texts count like others; a plan (a period for
each source that runs out) of more than ``MAX_PLAN`` slots is refused before anything
is computed: take larger blocks, coarser weights or fewer sources; an empty table
gives an empty result; all columns stay, whatever their names, and the new ones are
renamed if they would clash.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import fresh

BLOCK = 16
#: Production weights; all other sources have weight 1.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
MAX_PLAN = 2_000_000
BUCKET_ROWS = 20_000
BROADCAST_ENTRIES = 200_000


def period(weights: dict[str, int], most: int | None = None) -> list[str]:
    """One period of the schedule, or its first ``most`` slots: the source of each slot, earliest deadline first among released blocks."""
    total = sum(weights.values())
    coming = [(0, k, 0) for k in sorted(weights)]  # (release, source, block)
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    slots = []
    for t in range(total if most is None else min(total, most)):
        while coming and coming[0][0] <= t:
            _, k, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), k, j))
        _, k, j = heapq.heappop(ready)
        slots.append(k)
        if j + 1 < weights[k]:
            heapq.heappush(coming, ((j + 1) * total // weights[k], k, j + 1))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> tuple[dict[str, list[dict]], list[str]]:
    """By source its phases: number, first and last block, first slot, slots of the period, own slots in a period; and the source that each phase ends with."""
    left = {k: n for k, n in blocks.items() if n}
    out: dict[str, list[dict]] = {k: [] for k in left}
    done, ended, at, spent = dict.fromkeys(left, 0), [], 0, 0
    while left:
        divisor = math.gcd(*(weights[k] for k in left))
        own = {k: weights[k] // divisor for k in left}
        total = sum(own.values())
        spent += min(total, sum(left.values()))
        if spent > MAX_PLAN:
            raise ValueError(f"the plan has more than {MAX_PLAN} slots; take larger blocks, coarser weights or fewer sources")
        places: dict[str, list[int]] = {k: [] for k in own}
        for t, k in enumerate(period(own, sum(left.values()))):
            places[k].append(t)
        rounds = min((n - 1) // own[k] for k, n in left.items())  # in which no source runs out
        stop, first = min((places[k][n - rounds * own[k] - 1], k) for k, n in left.items() if n - rounds * own[k] <= len(places[k]))
        for k in left:
            used = rounds * own[k] + bisect.bisect_right(places[k], stop)
            if used:
                out[k].append({"phase": len(ended), "first": done[k], "last": done[k] + used, "at": at, "total": total, "weight": own[k], "places": places[k][: used if not rounds else None]})
                done[k] += used
        ended.append(first)
        at += rounds * total + stop + 1
        left = {k: n - done[k] for k, n in blocks.items() if n > done.get(k, n)}
    return out, ended


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """All rows and columns of ``docs`` with mix_block (of its source), mix_slot (of the schedule) and mix_position (from 0, dense)."""
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    if default_weight < 1 or any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are integers from 1 on")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sizes = {r[0]: r[1] for r in docs.groupBy(source.alias("key")).count().limit(MAX_PLAN + 1).collect()}  # a row for each source
    own = {k: int(weights.get(k[1:], default_weight)) if k else default_weight for k in sizes}
    phases, ended = plan({k: -(-n // block) for k, n in sizes.items()}, own)
    lost = [0]  # places of short blocks before each phase
    for k in ended:
        lost.append(lost[-1] + -sizes[k] % block)

    bits = max(6, math.ceil(math.log2(max(2, sum(sizes.values()) / BUCKET_ROWS))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the columns of docs as one, so that no name of theirs can clash here
    keyed = docs.select(F.struct("*").alias("doc"), source.alias("key"), order.alias("order"))
    keyed = keyed.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint"), 32 - bits))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("key", "bucket").agg(F.count("*").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ties = [F.xxhash64(F.col("doc")[c]) for c in docs.columns if c != "doc_id" and docs.schema[c].dataType.typeName() in ("string", "long", "integer")]
    within = Window.partitionBy("key", "bucket").orderBy("order", F.col("doc.doc_id"), *ties)
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(starts, ["key", "bucket"]).withColumn("rank", F.col("nth") - 1 + F.col("before"))

    rows = [{"key": k, "phases": [p | {"lost": lost[p["phase"]]} for p in v]} for k, v in phases.items()]
    schedule = _local(spark, rows, "key string, phases array<struct<first:bigint,last:bigint,at:bigint,total:bigint,weight:bigint,places:array<bigint>,lost:bigint>>")
    if sum(len(p["places"]) + 6 for v in phases.values() for p in v) <= BROADCAST_ENTRIES:
        schedule = F.broadcast(schedule)
    placed = ranked.join(schedule, "key").withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
    placed = placed.withColumn("p", F.filter("phases", lambda x: (x["first"] <= F.col("block")) & (F.col("block") < x["last"]))[0]).withColumn("j", F.col("block") - F.col("p.first"))
    slot = F.col("p.at") + F.floor(F.col("j") / F.col("p.weight")).cast("bigint") * F.col("p.total") + F.col("p.places")[(F.col("j") % F.col("p.weight")).cast("int")]
    placed = placed.withColumn("slot", slot).withColumn("position", F.col("slot") * block + F.col("rank") % block - F.col("p.lost"))
    return placed.select("doc.*", *(F.col(x).alias(fresh(docs.columns, f"mix_{x}")) for x in ("block", "slot", "position")))


def oracle(weights: dict[str, int] | None = None, default_weight: int = 1, block: int = BLOCK, seed: int = 42) -> str:
    """DuckDB SQL for ``mix``: the slots one after the other, each with the released block that is due first."""
    table = ", ".join(f"('={k}', {w})" for k, w in (WEIGHTS if weights is None else weights).items())
    return f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         row_number() OVER (PARTITION BY source ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
  FROM documents),
sources AS (
  SELECT key, max(coalesce(w, {default_weight})) AS w, (count(*) + {block - 1}) // {block} AS blocks, (-count(*)) % {block} AS lack
  FROM keyed LEFT JOIN (VALUES {table}) AS named(name, w) ON key = name GROUP BY key),
listed AS (SELECT list(struct_pack(key := key, w := w, blocks := blocks, lack := (lack + {block}) % {block}, done := 0, own := 0) ORDER BY key) AS s FROM sources),
steps AS (
  SELECT -1 AS slot, 0 AS t, 0 AS lost, CAST(NULL AS VARCHAR) AS key, 0 AS nth, 0 AS held, s FROM listed
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN 0 ELSE t + 1 END, held, pick.key, pick.done, held + CASE WHEN ends THEN pick.lack ELSE 0 END,
         list_transform(s, lambda x: struct_pack(key := x.key, w := x.w, blocks := x.blocks, lack := x.lack, done := x.done + CAST(x.key = pick.key AS INTEGER),
                                                 own := CASE WHEN ends THEN 0 ELSE x.own + CAST(x.key = pick.key AS INTEGER) END))
  FROM (
    SELECT *, pick.done + 1 = pick.blocks AS ends FROM (
      SELECT slot, t, held, s, list_sort(list_transform(list_filter(s, lambda x: x.done < x.blocks AND (x.own * q) // x.w <= t),
               lambda x: struct_pack(due := ((x.own + 1) * q + x.w - 1) // x.w, key := x.key, done := x.done, blocks := x.blocks, lack := x.lack)))[1] AS pick
      FROM (SELECT *, list_sum(list_transform(list_filter(s, lambda x: x.done < x.blocks), lambda x: x.w)) AS q FROM steps))
    WHERE pick IS NOT NULL))
SELECT k.doc_id, k.source, CAST(k.rank // {block} AS BIGINT) AS mix_block, CAST(slot AS BIGINT) AS mix_slot, CAST(slot * {block} + k.rank % {block} - lost AS BIGINT) AS mix_position
FROM keyed k JOIN steps ON k.key = steps.key AND k.rank // {block} = steps.nth
"""
