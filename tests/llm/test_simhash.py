import random

import pytest
import xxhash

from linkloom.llm import simhash as SH


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest id by index, by comparing all pairs."""
    label = list(range(len(fps)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(fps))]


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    out = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append("\t".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return [*out, None, "", " \n", "É é", "one two"]


def test_report_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components(fps)
    for r in SH.report(docs).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == root[r["doc_id"]]


def test_crowded_nodes_are_divided_without_losing_links(spark):
    rng = random.Random(3)
    start = rng.getrandbits(64)
    fps = {start}
    for _ in range(250):  # a chain of close ones below one prefix, and others around
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)))
        fps.add((start & ~0xFFFFFF) | rng.getrandbits(24))
    fps = sorted(fps)
    root = components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = SH.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), max_node=16).collect()
    label = list(range(len(fps)))
    at = {f: k for k, f in enumerate(signed)}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for u, v in edges:
        assert root[at[u]] == root[at[v]]  # a forest row joins members of one component
        a, b = find(at[u]), find(at[v])
        label[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(fps))] == root


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None)], "doc_id bigint, text string")
    out = sorted(map(tuple, SH.report(docs).collect()), key=repr)
    assert len(out) == 4 and {r[2] for r in out if r[0] != 3} == {2}
    assert SH.report(docs.where("false")).count() == 0


def test_near_dedup_by_jaccard(spark):
    rng = random.Random(5)
    rows, group = [], []
    for g in range(25):
        words = [f"g{g}x{rng.randrange(400)}" for _ in range(150)]
        rows.append((len(rows), " ".join(words)))
        group.append(g)
        for _ in range(g % 4):  # two changed words leave a similarity of about 0.87
            copy = list(words)
            for k in rng.sample(range(150), 2):
                copy[k] = "other"
            rows.append((len(rows), " ".join(copy)))
            group.append(g)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, group string")
    out = SH.near_dedup(docs)
    assert out.columns == ["doc_id", "text", "group"]
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == [group.index(g) for g in range(25)]


def test_near_dedup_keeps_one_of_equal_rows(spark):
    rows = [(4, "a b c"), (4, "a b c"), (2, "a b c"), (None, "q r"), (None, "q r"), (None, "Q r"), (9, None), (7, "x y"), (7, "A b c"), (7, "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, key int")
    kept = sorted((r[:2] for r in map(tuple, SH.near_dedup(docs).collect())), key=repr)
    assert len(kept) == 5 and kept[:4] == [(2, "a b c"), (7, "x y"), (7, "z"), (9, None)] and kept[4][0] is None


def test_crowded_nodes_lose_no_link(spark):
    """A passage of 70 of 100 words in all documents: its nodes are crowded, and pairs at about 0.82 must be found all the same."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for g in range(150):
        own = [f"g{g}x{k}" for k in range(34)]
        texts.append(" ".join(passage + own))
        copy = list(own)
        copy[rng.randrange(5, 15)], copy[rng.randrange(20, 29)] = "other", "another"
        texts.append(" ".join(passage + copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    few = {r["member"]["key"]: r["group"]["key"] for r in SH.similar_groups(docs, 5, 0.8, max_node=20).collect()}
    whole = {r["member"]["key"]: r["group"]["key"] for r in SH.similar_groups(docs, 5, 0.8).collect()}
    assert few == whole


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}


def brute_groups(texts, similarity):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("confirm_node", [1024, 10])
def test_similar_groups_are_those_of_brute_force(spark, confirm_node):
    """Copies at every similarity between 0.5 and 0.9, most on the two sides of 0.8."""
    rng = random.Random(12)
    texts = [None, "", "a b c", "A  b c", "a b c d"]
    for g in range(80):
        words = [f"g{g}x{k}" for k in range(124)]
        texts.append(" ".join(words))
        copy = list(words)
        for at in range(5 + g % 4, 120, 12)[: 1 + g % 6]:
            copy[at] = f"other{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
        texts.append(" ".join(words[: rng.randint(70, 110)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["member"]["key"]: r["group"]["key"] for r in SH.similar_groups(docs, 5, 0.8, 20, confirm_node).collect()}
    assert [out[k] for k in range(len(texts))] == brute_groups(texts, 0.8)
