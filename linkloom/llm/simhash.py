"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits; texts link where at most ``BUDGET`` = 3 bits differ, and
a group is a connected component of links.

The self-join works on distinct fingerprints. Of four blocks of 16 bits two linked
fingerprints share at least one, so each fingerprint goes to four tries, one for
each block in front: the node of the first 16 bits is the shuffle key, and below it
the trie is walked in pairs of nodes. A pair carries the bits in which its two
prefixes differ and is dropped beyond the budget; where both nodes are small, their
leaves are compared. A node with more than ``MAX_NODE`` fingerprints is not walked
in one task: its other 48 bits are divided again in four, of which linked ones share
one, and so once more, so a hot prefix is dealt out by ever longer ones.

A node gives back not its pairs but a spanning forest of its links, at most one row
for each fingerprint, which loses no link. Components are found from the forest by
alternating large-star and small-star steps; nothing of them reaches the driver but
counts and checksums.

Edge cases: null and wordless texts have fingerprint zero and link like others;
fewer words than a shingle has are one shingle; repeated rows stay and are one
group; a null doc_id is kept and never is the smallest unless a group has no other;
an empty table gives an empty result; extra columns are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, slots, written

BUDGET = 3
WORDS = 3
SEED = 42
MAX_NODE = 4096
#: Leaves are compared where two nodes have at most so many pairs of them.
LEAF_PAIRS = 64
CHUNK_ROWS = 400_000
PAIRS_AT_ONCE = 2_000_000
ASK_AT_ONCE = 256


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    n = len(found)
    if n <= words:
        return xxh64_intdigest(b" ".join(found), seed)
    line = b" ".join(found)
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - words])]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, n - words + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _flat(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index reached) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        label = _flat(label)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray, agree=None) -> np.ndarray:
    """``_unite`` by the links that ``agree`` passes; rows that are together already are not asked about."""
    if agree is None:
        return _unite(label, i, j)
    while len(i):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        good = agree(i[:ASK_AT_ONCE], j[:ASK_AT_ONCE])
        label = _unite(label, i[:ASK_AT_ONCE][good], j[:ASK_AT_ONCE][good])
        i, j = i[ASK_AT_ONCE:], j[ASK_AT_ONCE:]
    return label


def trie_links(key: np.ndarray, fp: np.ndarray, budget: int = BUDGET, agree=None) -> np.ndarray:
    """Self-joins one trie for each key. With ``agree`` (two arrays of rows to an array of bools) a link has to pass it too. Rows are sorted by key and fingerprint (a row of unsigned words, the first the highest). Gives each row's smallest linked row within its key, itself if none."""
    n = len(key)
    label = np.arange(n)
    if n < 2:
        return label
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    a0, a1 = lo[many], hi[many]
    big = a1 - a0 > 32
    if big.any():  # all of a large trie against its middle leaf: a dense group is united at once
        sizes = (a1 - a0)[big]
        i = np.repeat(a0[big], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        j = np.repeat((a0[big] + a1[big]) // 2, sizes)
        near = _differing(fp, i, j) <= budget
        label = _join(label, i[near], j[near], agree)
    b0, b1, dist = a0.copy(), a1.copy(), np.zeros(len(a0), np.int16)
    for bit in range(64 * fp.shape[1] - 1, -2, -1):
        if not len(a0):
            break
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        small &= ~one
        if small.any():
            label = _compare(fp, label, a0[small], a1[small], b0[small], b1[small], budget, agree)
        rest = ~(small | one)
        a0, a1, b0, b1, dist = a0[rest], a1[rest], b0[rest], b1[rest], dist[rest]
        if not len(a0):
            break
        word = fp[:, fp.shape[1] - 1 - bit // 64]
        ones = np.concatenate([[0], np.cumsum((word >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        # (0, 0), (1, 1), (0, 1) and, of different nodes, (1, 0)
        parts = [(a0, am, b0, bm, dist), (am, a1, bm, b1, dist), (a0, am, bm, b1, dist + 1), (am[other], a1[other], b0[other], bm[other], dist[other] + 1)]
        a0, a1, b0, b1, dist = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (a1 > a0) & (b1 > b0) & (dist <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, dist = a0[live], a1[live], b0[live], b1[live], dist[live]
    return label


def _differing(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(fp[i, 0] ^ fp[j, 0]).astype(np.int16)
    for w in range(1, fp.shape[1]):
        out += np.bitwise_count(fp[i, w] ^ fp[j, w])
    return out


def _compare(fp, label, a0, a1, b0, b1, budget, agree):
    """Compares the leaves of pairs of nodes and unites the linked ones."""
    sizes = (a1 - a0) * (b1 - b0)
    done, total = 0, np.cumsum(sizes)
    while done < len(sizes):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        s = sizes[done:upto]
        pair = np.repeat(np.arange(done, upto), s)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
        width = (b1 - b0)[pair]
        i, j = a0[pair] + k // width, b0[pair] + k % width
        keep = (i < j) | (a0 != b0)[pair]
        i, j = i[keep], j[keep]
        near = _differing(fp, i, j) <= budget
        label = _join(label, i[near], j[near], agree)
        done = upto
    return label


def _walk(rows: DataFrame, width: int, budget: int) -> DataFrame:
    """Links (u, v) of a spanning forest of each trie; rows: node, id, w0 and so on for ``width`` words."""

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        fp = [c.view(np.uint64) for c in cols[2:]]
        order = np.lexsort([*reversed(fp), cols[0]])
        ids = cols[1][order]
        label = trie_links(cols[0][order], np.stack(fp, 1)[order], budget)
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append([batch.column(k).to_numpy() for k in range(width + 2)])
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last node may go on in the next batch
                if cut:
                    yield solve([c[:cut] for c in cols])
                parts, held = [[c[cut:] for c in cols]], held - cut
        if held:
            yield solve([np.concatenate(c) for c in zip(*parts, strict=True)])

    rows = rows.select("node", "id", *(f"w{k}" for k in range(width)))
    return rows.repartition(slots(rows.sparkSession), "node").sortWithinPartitions("node").mapInArrow(run, "u bigint, v bigint")


def _divide(rest: Column, width: int, node: Column | None) -> Column:
    """Four rows (node, rest) for one: each quarter of the ``4 * width`` bits of ``rest`` once in front."""
    out = []
    mask = (1 << width) - 1
    for c in range(4):
        value = F.shiftrightunsigned(rest, c * width).bitwiseAND(F.lit(mask))
        above = F.shiftleft(F.shiftrightunsigned(rest, (c + 1) * width), c * width) if c < 3 else F.lit(0).cast("bigint")
        left = above.bitwiseOR(rest.bitwiseAND(F.lit((1 << (c * width)) - 1)))
        here = F.lit(c << width).cast("bigint").bitwiseOR(value)
        whole = here if node is None else F.shiftleft(node, width + 2).bitwiseOR(here)
        out.append(F.struct(whole.alias("node"), left.alias("rest")))
    return F.explode(F.array(*out))


def links(distinct: DataFrame, max_node: int = MAX_NODE) -> DataFrame:
    """A spanning forest (u, v) of all links between the distinct fingerprints ``fp``."""
    rows = distinct.select("fp", _divide(F.col("fp"), 16, None).alias("d")).select("fp", "d.node", "d.rest")
    out = None
    for width in (12, 9, 0):
        crowded = written(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > max_node).select("node"), "crowded") if width else None
        more = crowded is not None and not crowded.isEmpty()
        part = _walk((rows.join(crowded, "node", "left_anti") if more else rows).select("node", F.col("fp").alias("id"), F.col("fp").alias("w0")), 1, BUDGET)
        out = part if out is None else out.unionByName(part)
        if not more:
            break
        rows = rows.join(crowded, "node", "left_semi").select("fp", _divide(F.col("rest"), width, F.col("node")).alias("d")).select("fp", "d.node", "d.rest")
    return out


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (u, v): node and root, the smallest node that it reaches.

    Rounds go on until the edges stay as they are; their number grows with the square
    of the logarithm of the nodes at most.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: all greater neighbours of a node go to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all smaller neighbours of a node, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, words: int = WORDS, max_node: int = MAX_NODE) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed), component_id."""
    found = written(fingerprints(docs, words), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    reached = written(components(links(distinct, max_node)), "roots")
    linked = distinct.join(reached, F.col("fp") == F.col("node")).select("fp", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(lowest, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    named = distinct.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(F.col("fp").alias("own_fp"), F.coalesce("component_id", "first").alias("component_id"))
    named = written(named, "named")  # a table of its own, so that Spark can split what a common fingerprint brings to the join
    return found.join(named, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """What the contract asks for."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the stage on similarity: words of a fingerprint, and nodes in which a document is looked for.
SIMILAR_WORDS = 4
ROUTES = 6
#: Texts whose shingles are compared in one task: so many, or of so many bytes.
CONFIRM_NODE = 1024
CONFIRM_BYTES = 32_000_000
_ODD = (np.random.default_rng(5).integers(1, 2**63, SIMILAR_WORDS + ROUTES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def similar_budget(similarity: float, bits: int = 64 * SIMILAR_WORDS) -> int:
    """Bits in which two texts of this Jaccard similarity differ, and four standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


def shingles(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles, each once and sorted."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if n <= words:
        h = np.array([xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    else:
        line = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
        h = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1)
    return np.unique(h)  # a set, as for Jaccard similarity


def sketch(text: str | None, words: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A SimHash of ``SIMILAR_WORDS`` words of 64 bits, and the ``ROUTES`` smallest shingles under as many orders."""
    h = shingles(text, words, seed)
    ones = np.zeros(64 * SIMILAR_WORDS, np.int64)
    for k in range(0, len(h), 2048):
        mixed = h[k : k + 2048, None] * _ODD[None, :SIMILAR_WORDS]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
    fp = np.packbits(ones * 2 > len(h)).view(">u8").astype(np.uint64)
    routes = np.array([(h * odd).min() for odd in _ODD[SIMILAR_WORDS:]], np.uint64)
    return fp, routes


def _parts(times: Column) -> Column:
    """Parts of a node so many times too large: two of them together are not, but for chance."""
    return F.greatest(F.lit(3), F.ceil(2 * times)).cast("int")


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` (node, id and more) with each node of ``crowded`` (node, parts) divided: its ids are dealt into parts, and a new node for every two parts holds both, so any two rows still meet."""
    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts").cast("bigint")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != part)
    node = F.transform(others, lambda k: F.xxhash64("node", F.least(part, k), F.greatest(part, k)))
    divided = rows.join(crowded, "node").select(*(c for c in rows.columns if c != "node"), F.explode(node).alias("node")).select(*rows.columns)
    return rows.join(crowded, "node", "left_anti").unionByName(divided)


def _alike(texts: list[str | None], words: int, similarity: float):
    """For ``trie_links``: whether the Jaccard similarity of two texts' shingles is at least ``similarity``."""
    sets: dict[int, np.ndarray] = {}

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k], words)
        return sets[k]

    def one(a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common >= similarity * (len(a) + len(b) - common) - 1e-9

    return lambda i, j: np.fromiter((one(of(a), of(b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))


def _confirmed(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """As ``_walk``, of rows with a text, whose links are confirmed by the shingles of both texts."""
    budget = similar_budget(similarity)

    def solve(held: pa.Table) -> pa.RecordBatch:
        cols = [held.column(k).to_numpy() for k in range(SIMILAR_WORDS + 2)]
        fp = [c.view(np.uint64) for c in cols[2:]]
        order = np.lexsort([*reversed(fp), cols[0]])
        ids, texts = cols[1][order], held.column("text").take(pa.array(order)).to_pylist()
        label = trie_links(cols[0][order], np.stack(fp, 1)[order], budget, _alike(texts, words, similarity))
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.nbytes >= CONFIRM_BYTES:
                nodes = held.column("node").to_numpy()
                cut = int(np.searchsorted(nodes, nodes[-1]))  # the last node may go on in the next batch
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield solve(held)

    rows = rows.select("node", "id", *(f"w{k}" for k in range(SIMILAR_WORDS)), F.col("text").cast("string").alias("text"))
    return rows.repartition(slots(rows.sparkSession), "node").sortWithinPartitions("node").mapInArrow(run, "u bigint, v bigint")


def _confirmed_links(docs: DataFrame, distinct: DataFrame, reached: DataFrame, words: int, similarity: float, max_node: int) -> DataFrame:
    """A spanning forest of the links of at least ``similarity`` within each component of ``reached``, by the texts themselves.

    Only texts in such a component are shuffled. One with too many texts or bytes is dealt out in pairs of parts.
    """
    words_of = [f"w{k}" for k in range(SIMILAR_WORDS)]
    rows = written(distinct.join(reached.select(F.col("node").alias("id"), "root").distinct(), "id").select(F.col("root").alias("node"), "id", "size", "first.*", *words_of), "candidates")
    sizes = rows.groupBy("node").agg((F.count("*") / max_node).alias("n"), (F.sum("size") / CONFIRM_BYTES).alias("b"))
    crowded = written(sizes.where("n > 1 or b > 1").select("node", F.least(_parts(F.greatest("n", "b")), F.greatest(F.lit(3), F.ceil(F.col("n") * max_node))).cast("int").alias("parts")), "crowded")
    keys = ["missing", "key", "th"]
    texts = docs.select(*_member(), "text").join(rows, keys).dropDuplicates(keys).select("node", "id", *words_of, "text")
    return _confirmed(texts if crowded.isEmpty() else _dealt(texts, crowded), words, similarity)


def _member() -> list[Column]:
    """missing, key and th of a row with doc_id and text."""
    doc_id = F.col("doc_id").cast("bigint")
    return [doc_id.isNull().alias("missing"), F.coalesce(doc_id, F.lit(-(2**63)).cast("bigint")).alias("key"), F.xxhash64("text").alias("th")]


def similar_groups(docs: DataFrame, words: int, similarity: float, max_node: int = MAX_NODE, confirm_node: int = CONFIRM_NODE) -> DataFrame:
    """Per row of ``docs``: member and group, the first member of the texts that it reaches over links of at least ``similarity``.

    A member is struct(missing, key, th): whether doc_id is null, doc_id (or the smallest
    number), a hash of the text; so the first one is unique but for equal rows.

    Candidates are pairs whose fingerprints of 256 bits differ in no more bits than four
    standard deviations above what the similarity lets expect. Tries of so wide a budget
    prune late, so texts are put together by shared smallest shingles first: two texts of
    similarity 0.8 share none of six in 1 of 16,000 cases. A node with more than
    ``max_node`` fingerprints is dealt out in pairs of parts, so at any size all pairs in
    it are compared at the same budget. Links are those of the candidates' components
    whose Jaccard similarity, counted from the texts, is at least ``similarity``.
    """
    names = [*(f"w{k}" for k in range(SIMILAR_WORDS)), *(f"r{k}" for k in range(ROUTES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = np.array([np.concatenate(sketch(t, words)) for t in batch.column(4).to_pylist()], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(np.ascontiguousarray(c)) for c in cols.T)], names=["missing", "key", "th", "size", *names])

    found = docs.select(*_member(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), "text").mapInArrow(run, "missing boolean, key bigint, th bigint, size bigint, " + ", ".join(f"{c} bigint" for c in names))
    found = found.select(F.struct("missing", "key", "th").alias("member"), "size", *names)
    found = written(found.withColumn("id", F.xxhash64(*names[:SIMILAR_WORDS])), "sketches")
    distinct = written(found.groupBy("id").agg(F.min("member").alias("first"), F.max("size").alias("size"), *(F.min(c).alias(c) for c in names)), "distinct")
    routes = F.explode(F.array(*(F.xxhash64(F.lit(k), f"r{k}") for k in range(ROUTES))))
    rows = distinct.select("id", *names[:SIMILAR_WORDS], routes.alias("node"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    crowded = written(sizes.where(F.col("n") > max_node).select("node", _parts(F.col("n") / max_node).alias("parts")), "crowded")
    budget = similar_budget(similarity)
    edges = _walk(rows if crowded.isEmpty() else _dealt(rows, crowded), SIMILAR_WORDS, budget)
    proposed = written(components(edges), "proposed")
    edges = _confirmed_links(docs, distinct, proposed, words, similarity, confirm_node)
    reached = written(components(edges), "roots")
    linked = distinct.select("id", "first").join(reached, F.col("id") == F.col("node")).select("id", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("group"))
    linked = linked.join(lowest, "root").select(F.col("id").alias("linked_id"), "group")
    named = distinct.select("id", "first").join(linked, F.col("id") == F.col("linked_id"), "left").select(F.col("id").alias("own_id"), F.coalesce("group", "first").alias("group"))
    named = written(named, "named")
    return found.select("member", "id").join(named, F.col("id") == F.col("own_id")).select("member", "group")


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id (nulls last); all columns stay.

    Of equal rows one stays. Texts are shuffled once, by plain keys: the same partitions
    serve the join with the kept ones and the search for equal rows.
    """
    kept = similar_groups(docs, words, similarity).where(F.col("member") == F.col("group")).select("member.*").distinct()
    names = [fresh(docs.columns, x) for x in ("missing", "key", "th")]
    kept = kept.toDF(*names)
    rows = docs.select("*", *(c.alias(n) for c, n in zip(_member(), names, strict=True)))
    return rows.join(kept, names).dropDuplicates([*names, "text"]).select(*docs.columns)
