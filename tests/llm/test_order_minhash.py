import hashlib
import random
from collections import Counter

from linkloom.llm import order_minhash as OM


def test_fingerprints_of_neighbours(spark):
    base = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    rows = [(5, base), (1, base), (9, "ab"), (3, None), (7, "é" * 31), (2, base[:-30] + "another end of the text altogether")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in OM.fingerprints(docs).collect()}
    order = sorted(r[0] for r in rows)
    texts = {k: t or "" for k, t in rows}
    for k, doc_id in enumerate(order):
        following, r = order[(k + 1) % len(order)], found[doc_id]
        text, n = texts[doc_id], len(texts[doc_id])
        new = text[: n - n // 2] + texts[following][: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == OM.shown(OM.fingerprint(text)) and r["edited_fingerprint"] == OM.shown(OM.fingerprint(new))
        assert r["near_next"] == OM.likeness(OM.fingerprint(text), OM.fingerprint(texts[following]))
    assert found[5]["fingerprint"] == found[1]["fingerprint"]
    assert found[1]["near_next"] > 0.6  # nearly the same text


def test_order_matters():
    a, b = "first half of a text, long enough to have many pieces. ", "second part with quite different letters and words! "
    assert OM.likeness(OM.fingerprint(a * 9 + b * 9), OM.fingerprint(b * 9 + a * 9)) < 1


def test_single_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = OM.fingerprints(one).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 6
    assert OM.fingerprints(one.where("false")).count() == 0


def test_repeated_ids_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (1, "a", "x")], "doc_id bigint, text string, fingerprint string")
    assert OM.fingerprints(docs).count() == 4


def slow_fingerprint(text):
    """By the definition: occurrences by a table, all k-mers sorted for each hash function."""
    most, a, b, c = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

    def mixed(x):
        x = (x ^ x >> 32) * c & most
        return x ^ x >> 29

    data, seen, h, numbered = text.encode(), Counter(), [], []
    if not data:
        return "0" * 8 * OM.SKETCHES
    data = data.ljust(OM.K, b"\0")
    for i in range(len(data) - OM.K + 1):
        kmer = data[i : i + OM.K]
        h.append(mixed((int.from_bytes(kmer[:8], "little") * a & most) ^ (int.from_bytes(kmer[8:], "little") * b & most) >> 3))
        numbered.append(mixed(h[-1] + seen[kmer] * b & most))
        seen[kmer] += 1
    out = ""
    for odd in map(int, OM._ODD):
        place = sorted(sorted(range(len(h)), key=lambda k: (numbered[k] * odd & most, k))[: OM.PICKS])
        x = len(place)
        for k in place:
            x = mixed(x * a + h[k] & most)
        out += f"{x >> 32:08x}"
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    free = lambda n: "".join(rng.choice("ab é€𝄞") for _ in range(n))
    rows = [(k * 3 % 41, free(rng.choice((0, 1, 15, 16, 17, 200, 900)))) for k in range(41)] + [(50, "ab" * 3000), (60, free(6000)), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r for r in OM.fingerprints(docs).collect()}
    texts = {k: t or "" for k, t in rows}
    order = sorted(texts)
    prints = {k: slow_fingerprint(t) for k, t in texts.items()}
    alike = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / OM.SKETCHES
    for n, k in enumerate(order):
        text, after = texts[k], order[(n + 1) % len(order)]
        cut = len(text) // 2
        new = (text[:-cut] if cut else text) + texts[after][:cut]
        r = found[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), prints[k], slow_fingerprint(new))
        assert (r["near_edited"], r["near_next"]) == (alike(prints[k], slow_fingerprint(new)), alike(prints[k], prints[after]))
