import hashlib
import random
import re

import pytest

from linkloom.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[i : i + 8]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(4)
    vocabulary = ["What", "is", "the", "Größe", "of", "x1", "tree", "año", "42", "b"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))) for k in range(30)] + [(30, None), (31, "?!"), (None, "seven of nine")]
    docs = []
    for k in range(60):
        parts = [rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts.append((rng.choice(items)[1] or "") + ". ")
        docs.append((k, "".join(parts)))
    return [*docs, (60, None), (61, ""), (62, "..."), (None, "x")], items


@pytest.mark.parametrize("block", [400_000, 40])
def test_matches_brute_force(spark, monkeypatch, block):
    docs, items = fixture()
    monkeypatch.setattr(D.contaminated_runs, "__defaults__", (D.WIDTH, block))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, D.report(d, b).collect()), key=repr) == brute(docs, items)


def test_offsets_point_at_the_original(spark):
    docs = spark.createDataFrame([(1, "Äh: One, two -- three four five six SEVEN eight nine!")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "two three four five six seven eight nine")], "item_id bigint, text string")
    run = D.contaminated_runs(docs, items).first()["run_bytes"][0]
    assert "Äh: One, two -- three four five six SEVEN eight nine!".encode()[run["first"] : run["last"]].decode() == "two -- three four five six SEVEN eight nine"


def test_decontaminate_drops_hits_and_keeps_columns(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "e") for r in docs], "doc_id bigint, text string, linkloom_items string")
    out = D.decontaminate(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert out.columns == d.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in brute(docs, items) if not r[3]), key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert tuple(D.report(d, none).first())[:4] == (1, 2, 0, 0)
    assert D.report(d.where("false"), none).count() == 0


def test_blocks_keep_rows_apart(spark, monkeypatch):
    """Rows with one doc_id, or none, stay rows of their own with several blocks, and clean ones stay when another is dropped."""
    items = [(k, f"start{k} b c d e f g h{k}") for k in range(6)]
    hit = [f"x {items[k][1]} y {items[k + 3][1]} z" for k in range(3)]
    docs = [(1, hit[0]), (1, "clean one"), (1, hit[1]), (1, "clean one"), (None, hit[2]), (None, "clean two"), (None, None), (2, hit[0])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, D.contaminated_runs(d, b).collect()), key=repr)
    assert len(one) == len(docs) and sorted(map(tuple, D.contaminated_runs(d, b, D.WIDTH, 2).collect()), key=repr) == one
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 2)
    monkeypatch.setattr(D.contaminated_runs, "__defaults__", (D.WIDTH, 2))
    assert sorted(map(tuple, D.decontaminate(d, b).collect()), key=repr) == sorted((r for r in docs if r[1] not in hit), key=repr)
