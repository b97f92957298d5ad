import random
from collections import Counter

import duckdb
import pytest

from linkloom.llm import mixing as M


def test_period_keeps_every_source_within_a_block():
    weights = {"a": 7, "b": 3, "c": 1, "d": 1}
    slots, total, got = M.period(weights), sum(weights.values()), Counter()
    for t, k in enumerate(slots, 1):
        got[k] += 1
        assert all(abs(got[s] - t * w / total) < 1 for s, w in weights.items())
    assert got == weights


def test_mix_places_every_row_once_and_follows_the_weights(spark):
    rows = [(k, f"src{k % 3}" if k % 5 else "src0", "t") for k in range(900)] + [(2000, None, None), (2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    weights = {"src0": 3, "src1": 2, "src2": 1}
    out = M.mix(docs, weights, block=4).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in out) == Counter(rows)
    blocks = {(r["source"], r["mix_block"]): r["mix_slot"] for r in out}
    assert len(set(blocks.values())) == len(blocks)
    left = Counter(s for s, _ in blocks)
    order, got = sorted(blocks, key=blocks.get), Counter()
    shares = weights | {None: 1}
    for t, (s, _) in enumerate(order, 1):  # until the first source runs out
        got[s] += 1
        assert all(abs(got[k] - t * shares[k] / 7) < 1 for k in shares)
        if any(got[k] == left[k] for k in shares):
            break


def test_same_result_for_any_partitioning(spark):
    docs = spark.createDataFrame([(k, f"s{k % 4}") for k in range(300)], "doc_id bigint, source string")
    a = sorted(map(tuple, M.mix(docs).collect()))
    assert a == sorted(map(tuple, M.mix(docs.repartition(7)).collect()))


def plan_by_hand(blocks, weights):
    """The slots one after the other, with a fresh start after each source's last block."""
    from fractions import Fraction as Q

    done, own, t, out = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0), 0, []
    while live := [k for k in sorted(blocks) if done[k] < blocks[k]]:
        total = sum(weights[k] for k in live)
        ready = [k for k in live if Q(own[k] * total, weights[k]) < t + 1]
        k = min(ready, key=lambda k: (-(Q(-(own[k] + 1) * total, weights[k]) // 1), k))
        out.append((k, done[k]))
        done[k], own[k], t = done[k] + 1, own[k] + 1, t + 1
        if done[k] == blocks[k]:
            own, t = dict.fromkeys(blocks, 0), 0
    return out


def slots_of(blocks, weights):
    phases, ended = M.plan(blocks, weights)
    assert sorted(ended) == sorted(k for k, n in blocks.items() if n)
    found = {}
    for k, n in blocks.items():
        for b in range(n):
            p = next(p for p in phases[k] if p["first"] <= b < p["last"])
            j = b - p["first"]
            found[p["at"] + j // p["weight"] * p["total"] + p["places"][j % p["weight"]]] = (k, b)
    assert sorted(found) == list(range(len(found)))
    return [found[t] for t in range(len(found))]


def test_plan_against_slots_by_hand():
    rng = random.Random(4)
    for _ in range(300):
        names = "abcdefg"[: rng.randint(1, 7)]
        blocks, weights = {k: rng.randint(1, 40) for k in names}, {k: rng.choice((1, 1, 2, 3, 4, 6, 30)) for k in names}
        assert slots_of(blocks, weights) == plan_by_hand(blocks, weights)
    # weights that add up to far more slots than there are blocks
    blocks, weights = {"a": 50, "b": 20, "c": 1}, {"a": 3_000_017, "b": 1_000_003, "c": 12_345}
    assert slots_of(blocks, weights) == plan_by_hand(blocks, weights)


def test_too_large_a_plan_is_refused():
    with pytest.raises(ValueError, match="larger blocks"):
        M.plan({"a": 10**9, "b": 10**9}, {"a": 10**9 + 7, "b": 10**9 + 9})


def test_against_sql(spark):
    """Ties, short blocks, a null source, rows without an id, names that the operator uses itself."""
    rows = [(k, f"src{k % 7}" if k % 3 else "src0", k, "x", [k]) for k in range(500)] + [(900 + k, None, 0, None, None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, k bigint, b string, phases array<int>")
    out = M.mix(docs)
    assert out.columns == [*docs.columns, "mix_block", "mix_slot", "mix_position"]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source").toPandas())
    assert sorted(con.sql(M.oracle()).fetchall(), key=repr) == sorted((tuple(r) for r in out.drop("k", "b", "phases").collect()), key=repr)


def test_clashing_names_and_empty_tables(spark):
    own = ["doc", "key", "order", "bucket", "n", "before", "nth", "rank", "phases", "block", "p", "j", "slot", "position", "k", "b"]
    many = spark.createDataFrame([(k, "a", *[k] * len(own)) for k in range(40)], "doc_id bigint, source string, " + ", ".join(f"`{c}` int" for c in own))
    out = M.mix(many)
    assert out.columns == [*many.columns, "mix_block", "mix_slot", "mix_position"] and sorted(r["mix_position"] for r in out.collect()) == list(range(40))
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id bigint, source string, mix_slot int")
    assert M.mix(docs).columns == ["doc_id", "source", "mix_slot", "mix_block", "mix_slot_", "mix_position"]
    assert M.mix(docs.where("false")).count() == 0
