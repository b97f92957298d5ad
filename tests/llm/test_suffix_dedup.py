import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import suffix_dedup as SD

N = SD.LENGTH


def covered(texts, n):
    """Runs of bytes under repeated strings of n bytes, by a table of all such strings."""
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        ends = [k for k in range(len(t) + 1) if (k < len(t) and gone[k]) != (k > 0 and gone[k - 1] == 1)]
        out.append(list(zip(ends[::2], ends[1::2], strict=True)))
    return out


def brute_passages(texts):
    """Runs under strings of PASSAGE bytes with 50 words, counted one by one, or 400 bytes."""
    out = []
    for t, runs in zip(texts, covered(texts, SD.PASSAGE), strict=True):
        words = [m.span() for m in re.finditer(rb"\S+", t)]
        out.append([(a, b) for a, b in runs if b - a >= N or sum(a <= x and y <= b for x, y in words) >= SD.PASSAGE_WORDS])
    return out


def without(t, runs):
    return bytes(c for k, c in enumerate(t) if not any(a <= k < b for a, b in runs))


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, runs, many in zip(rows, texts, covered(texts, N), brute_passages(texts), strict=True):
        out.append((doc_id, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(t, runs)).hexdigest(), len(many), sum(b - a for a, b in many)))
    return sorted(out, key=repr)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    free = lambda n: " ".join(word() for _ in range(n))
    shared = [free(rng.randint(90, 400)) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [free(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(100, len(s))], free(rng.randint(0, 60))]
        rows.append((k, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 399), (103, "y" * 1000), (104, "z" * 400), (105, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (106, "ab" * 900), (107, shared[0] * 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = fixture(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, SD.report(docs).collect()), key=repr) == brute(rows)


def test_removal_keeps_columns_and_cuts_texts(spark):
    rows = [(1, "a" * 500, 9, "k"), (2, "b" * 300, 300, "l"), (3, None, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, key string")
    out = {r["doc_id"]: r for r in SD.without_repeats(docs).collect()}
    assert out[1]["text"] == "" and out[1]["n_chars"] == 0 and out[1]["key"] == "k"
    assert out[2]["text"] == "b" * 300 and out[2]["n_chars"] == 300
    assert out[3]["text"] is None and out[3]["key"] == "m"


@pytest.mark.parametrize("seed", [3, 4])
def test_passages_are_cut_out(spark, seed):
    """Against brute force, with planted passages of 51 to 64 words, most of them under 400 bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 6)))
    free = lambda n: " ".join(word() for _ in range(n))
    planted = [free(n) for n in (51, 52, 55, 60, 64)]
    short = [free(n) for n in (20, 40)]
    rows = []
    for k in range(80):
        own = [free(rng.randint(5, 200)), rng.choice(short), free(rng.randint(5, 50))]
        rows.append((k, " ".join([own[0], planted[k % 5], *own[1:]] if k % 2 else own)))
    rows += [(90, None), (91, ""), (92, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [(t or "").encode() for _, t in rows]
    expected = {i: None if t is None else without(b, runs).decode("utf-8", "ignore") for (i, t), b, runs in zip(rows, texts, brute_passages(texts), strict=True)}
    out = {r["doc_id"]: r["text"] for r in SD.without_repeats(docs).collect()}
    assert out == expected
    assert not any(planted[k % 5] in out[k] for k in range(1, 80, 2)) and all(out[k] == rows[k][1] for k in range(0, 80, 2))


def test_near_copies_of_a_long_text(spark):
    """A large group of copies of one text of 20 kB with a few words changed, in small buckets, and a text of 2 MB."""
    rng = random.Random(5)
    base = [f"{rng.randrange(10**6):x}" for _ in range(600)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = f"w{k}x{rng.random()}"
        rows.append((k, " ".join(own)))
    rows += [(1000, "".join(chr(97 + rng.randrange(26)) for _ in range(2_000_000)) + rows[3][1]), (1001, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [t.encode() for _, t in rows]
    small = [*texts[:150], texts[150][-len(texts[3]) - 300 :], texts[151]]
    expected = {i: sum(b - a for a, b in runs) for (i, _), runs in zip(rows, covered(small, N), strict=True)}
    got = {r["doc_id"]: r["n_removed"] for r in SD.report(docs).collect()}
    assert got == expected


def test_rows_that_repeat_ids_and_texts(spark):
    """Equal rows, null ids with different texts, columns whose names the operator uses itself."""
    rng = random.Random(6)
    a, b = ("".join(chr(97 + rng.randrange(26)) for _ in range(600)) for _ in range(2))
    rows = [(1, a, "p", 1)] * 40 + [(None, b[:390], "q", 2)] + [(None, b[200:] + "é" * 150, "q", 3)] + [(None, None, None, 4)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, bucket int")
    got = SD.report(docs).collect()
    assert len(got) == 45 and sorted(r["n_removed"] for r in got) == [0] * 5 + [600] * 40
    out = SD.without_repeats(docs)
    assert out.columns == docs.columns and sorted(r["bucket"] for r in out.collect()) == [1] * 40 + [2, 3, 4, 4, 4]


def test_sampled_splitters_split_evenly(spark, monkeypatch):
    """Small buckets and a small sample: the same result, and no bucket far over its share."""
    rows = fixture(7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, value in (("BUCKET_ROWS", 200), ("LEAST_TEXTS", 5), ("WHOLE", 300), ("FLUSH", 64)):
        monkeypatch.setattr(SD, name, value)
    assert sorted(map(tuple, SD.report(docs).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert SD.report(docs).count() == 0


def test_quicksort_and_buckets():
    rng = np.random.default_rng(1)
    keys = [rng.integers(-3, 3, 9000) for _ in range(5)]
    order = SD.multikey_quicksort(keys, small=16)
    got = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert got == sorted(zip(*(k.tolist() for k in keys), strict=True))
    cuts = [got[3000], got[6000], got[6001]]
    bucket = SD.bucket_of([np.array(c) for c in zip(*cuts, strict=True)], keys)
    for row, b in zip(zip(*(k.tolist() for k in keys), strict=True), bucket, strict=True):
        assert b == sum(c <= row for c in cuts)
