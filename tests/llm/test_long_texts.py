"""Texts of over 100 kB beside null and empty ones, through the operators that read whole texts."""

import hashlib
import random

from test_decontamination import brute as brute_hits
from test_order_minhash import slow_fingerprint
from test_simhash import brute_fingerprint

from linkloom.llm import decontamination, html_text, order_minhash, simhash


def long_text(seed, n=25_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "x1", "the", "of"]) + str(rng.randrange(300)) for _ in range(n))


def test_fingerprints_of_long_texts(spark):
    texts = {1: long_text(1), 2: None, 3: "", 4: long_text(2, 14_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{brute_fingerprint(t):016x}" for k, t in texts.items()}
    found = {r["doc_id"]: r for r in order_minhash.fingerprints(docs).collect()}
    assert found[4]["fingerprint"] == slow_fingerprint(texts[4]) and found[1]["n_chars"] == len(texts[1])
    new = texts[4][: len(texts[4]) - len(texts[4]) // 2] + texts[1][: len(texts[4]) // 2]  # the first follows the last
    assert found[4]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()


def test_windows_at_the_ends_of_long_texts(spark):
    text = long_text(3)
    words = text.split()
    items = [(1, " ".join(words[:8])), (2, " ".join(words[-20:])), (3, " ".join(words[12_000:12_008]).upper()), (4, "none of this")]
    docs = [(1, text), (2, None), (3, ""), (4, " ".join(words[-8:]))]
    out = decontamination.report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, out.collect()), key=repr) == brute_hits(docs, items)


def test_long_pages():
    parts = [f"<p>Paragraph {k} &amp; more of it.</p>" for k in range(30_000)]
    text = html_text.extract("<body><nav>x</nav><article>" + "".join(parts) + "</article></body>", None)
    assert text.split("\n\n") == [f"Paragraph {k} & more of it." for k in range(30_000)]
    deep = html_text.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000, None)
    assert deep == "deep"
