import random
from collections import Counter

from test_decontamination import brute as brute_hits
from test_mixing import plan_by_hand
from test_simhash import brute_groups
from test_suffix_dedup import brute_passages, without

import corpus_pipeline as P
from linkloom.llm import mixing
from linkloom.llm.common import clean_up, read, written

SF = "/root/testdata/sf0.001"


def test_stages_and_their_columns(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "repeated_strings", "benchmark_passages", "source_mix"]
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = written(out, name)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] == counts[3]
    assert sorted(r["mix_position"] for r in P.STAGES[-1][1](spark, docs, SF).collect()) == list(range(counts[-1]))


def test_run_is_registered_and_ends_with_the_last_stage(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns[-3:] == ["mix_block", "mix_slot", "mix_position"] and out.count() > 0
    clean_up(spark)


def test_every_operator_is_registered_once(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_empty_documents_pass_all_stages(spark):
    docs = read(spark, SF, "documents").where("false")
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def fixture(folder, spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns that the operators use themselves."""
    rng = random.Random(21)
    words = lambda n, tag: " ".join(f"{tag}{rng.randrange(10**5)}" for _ in range(n))
    passage, item = words(55, "p"), words(12, "q")
    rows = [(k, words(rng.randint(30, 90), "w"), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, words(40, "v") + " " + passage + " " + words(40, "v"), "de", None) for k in range(6)]  # a passage in six documents
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " more", "en", "s1"), (2, rows[2][1], "en", "s2"), (2, rows[2][1], "en", "s2")]  # copies and equal rows
    rows += [(300, words(30, "u") + " " + item, "en", "s0"), (301, "x " + item + " y", None, "s1")]  # benchmark items
    rows += [(None, words(50, "n"), "en", "s0"), (None, words(50, "n"), None, None), (400, None, None, None), (401, "", "en", "s0"), (402, " ".join(f"l{k}" for k in range(20_000)), "en", "s0"), (403, "é " * 30, "fr", "s1")]
    schema = "doc_id bigint, text string, lang string, source string"
    extra = ["row", "key", "spans", "bucket", "id", "q", "k", "b", "phases", "node", "linkloom_row"]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as bigint) AS n_chars", *(f"'{c}' AS {c}" for c in extra))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "?")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    docs = fixture(tmp_path, spark)
    before, after = None, docs
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before, after = after, written(stage(spark, after, str(tmp_path)), name)
        assert after.schema.simpleString() == docs.schema.simpleString()
        kept[name] = [(r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()]
    every = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
    assert Counter(kept["quality_classifier"]) == Counter(every)  # no labels: nothing is rejected
    # near duplicates: one of each group, that with the smallest doc_id, nulls last
    distinct = sorted(set(every), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    root = brute_groups([t for _, t, _ in distinct], 0.8)
    assert Counter(kept["near_duplicates"]) == Counter(distinct[k] for k in sorted(set(root)))
    # passages
    left = kept["near_duplicates"]
    texts = [(t or "").encode() for _, t, _ in left]
    cut = [(i, t if t is None else without(b, runs).decode("utf-8", "ignore"), n, bool(runs)) for (i, t, n), b, runs in zip(left, texts, brute_passages(texts), strict=True)]
    assert sum(c[3] for c in cut) >= 6
    assert Counter(kept["repeated_strings"]) == Counter((i, t, len(t) if changed else n) for i, t, n, changed in cut)
    # benchmark items
    items = [(1, spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id = 1").first()["text"])]
    hit = {i for i, _, _, n, _, _ in brute_hits([(k, t) for k, (_, t, _) in enumerate(kept["repeated_strings"])], items) if n}
    assert Counter(kept["benchmark_passages"]) == Counter(r for k, r in enumerate(kept["repeated_strings"]) if k not in hit) and len(hit) == 2
    # the mixture: every row once, in the slots that a plan by hand gives
    out = P.STAGES[-1][1](spark, after, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out) == Counter(kept["benchmark_passages"])
    assert sorted(r["mix_position"] for r in out) == list(range(len(out)))
    name = lambda s: "" if s is None else f"={s}"
    sizes = Counter(name(r["source"]) for r in out)
    slots = plan_by_hand({k: -(-n // mixing.BLOCK) for k, n in sizes.items()}, {k: mixing.WEIGHTS.get(k[1:], 1) for k in sizes})
    assert {(name(r["source"]), r["mix_block"]): r["mix_slot"] for r in out} == {x: t for t, x in enumerate(slots)}
    clean_up(spark)


def test_what_a_run_makes_is_deleted(spark, tmp_path):
    fixture(tmp_path, spark)
    tables = lambda: {r["tableName"] for r in spark.sql("SHOW TABLES").collect() if r["tableName"].startswith("linkloom_texts")}
    clean_up(spark)
    assert not tables()
    out = P.run(spark, str(tmp_path))
    assert not tables()  # the tables of a stage go when its result is stored
    assert out.count() > 0
    clean_up(spark)
