"""The three trained operators by held-out accuracy, and their edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import language, quality, toxicity
from linkloom.llm.common import read

SF = "/root/testdata/sf0.01"


def test_quality_on_labels_that_it_has_not_seen(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    out = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0 and quality is not null"), "doc_id").collect()
    assert len(out) > 80 and np.mean([r["keep"] == (r["quality"] == 1) for r in out]) > 0.95
    for view in ("content_score", "metadata_score"):
        assert np.mean([(r[view] >= 0.5) == (r["quality"] == 1) for r in out]) > 0.85


def test_quality_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    docs = spark.createDataFrame([(1, None, None, None, None, "s"), (None, "", "en", "x", 0, "s"), (2, "é" * 50_000, "en", "x", 50_000, "s"), (2, "b", "en", "x", 1, "s")], schema)
    labels = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 4 and all(r["keep"] and r["score"] == 1.0 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    real = read(spark, SF, "labels")
    assert quality.classify(docs, real).count() == 4 and quality.classify(docs.where("false"), real).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    scored = toxicity.classify(docs, labels).cache()
    for r in scored.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    out = scored.where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    assert len(out) > 60 and np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.93
    # labels of held-out rows do not matter
    other = labels.withColumn("toxic", F.when(toxicity.remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.classify(docs, other).collect()), key=repr) == sorted(map(tuple, scored.collect()), key=repr)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (3, "!" * 100_000, 0.5), (3, "x", 0.5)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in toxicity.classify(docs, none).collect()] == [0.0] * 4
    real = read(spark, SF, "labels")
    out = toxicity.classify(docs, real).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, np.where(y, 1, -1), np.where(y, -1, 1))
    poor = np.where(rng.random(4000) < 0.6, np.where(y, 1, -1), np.where(y, -1, 1))
    more = np.where(rng.random(4000) < 0.85, np.where(y, 1, -1), 0)
    post, table, _ = toxicity.label_model(np.stack([good, poor, more, good], 1).astype(np.int8), 0.3)
    assert np.mean((post > 0.5) == y) > 0.93
    assert table[0, 1, 2] > table[1, 1, 2]  # P(vote toxic | toxic) of the good voter and the poor one


def test_language_held_out(spark):
    docs = read(spark, SF, "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(out) > 250 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97


def test_language_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language.initial(["a", "b", "c"], 4, rng).items()}
    codes, target = rng.integers(97, 110, (9, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = language.gradients(p32, codes, target)
    for name, at in (("u", (0, 1, 2)), ("o", (1, 2, 1)), ("d", (1,)), ("x", (0, 98, 5)), ("x", (1, 100, 9))):
        a, b = {k: v.copy() for k, v in p32.items()}, {k: v.copy() for k, v in p32.items()}
        a[name][at] += 1e-2
        b[name][at] -= 1e-2
        numeric = (language.gradients(a, codes, target)[0] - language.gradients(b, codes, target)[0]) / 2e-2
        assert abs(numeric - g[name][at]) < 2e-3 + 0.05 * abs(numeric)


def test_language_edge_cases(spark):
    known = next(k for k in range(5, 50) if zlib.crc32(str(k).encode()) % 3 != 1)  # not held out
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "12 !?", "en", 1), (3, "", None, 1), (None, "hello", "en", 1), (known, "hello world", "en", 1), (known, "wörld " * 5000, "en", 1)], "doc_id bigint, text string, lang string, score int")
    out = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, steps=5).collect()), key=repr)
    assert [x for x in out if x[0] in (1, 2, 3)] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert [x[1] for x in out if x[0] == known] == ["en", "en"]
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.where("false")).count() == 0
