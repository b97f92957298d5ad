"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``width`` consecutive words of a benchmark item (the whole item
if it has fewer) is a pattern. A document is normalised to its words with single
spaces, scanned once, and every occurrence is mapped back to word positions and
to byte offsets of the original text.

The benchmark is a query set: its windows are read to the driver in blocks of at
most ``block_windows`` windows and each block is broadcast as one automaton. A
usual benchmark fits one block; a larger one takes more passes over the text, which
is stored once with its rows numbered, and no more memory. Documents are scanned where they lie, without a shuffle (with one
block) and without a limit on length, hits or items.

Edge cases: a null or wordless text has no words, hits or items; items without
words have no windows; equal item ids are one item; a null item id counts as the
item named by the empty string; extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, written

WIDTH = 8
BLOCK_WINDOWS = 400_000
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (c in _KEEP or 65 <= c <= 90) else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The distinct windows of an item, words joined by one space."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def automaton(windows: dict[bytes, tuple[str, ...]]):
    """One automaton over the windows, each between two spaces; a match gives (words, item ids)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, items in windows.items():
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if len(found):
        found.make_automaton()
    return found


def scan(found, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal hit runs [first word, past last word) and the ids of items with windows in a document."""
    if not words or not len(found):
        return [], set()
    text = f" {b' '.join(words).decode('latin-1')} "
    ends, items = [], set()
    for end, (n, ids) in found.iter(text):
        ends.append((end, n))
        items.update(ids)
    if not ends:
        return [], items
    runs: list[tuple[int, int]] = []
    at, k = 0, -1  # the space before word k + 1 is at `at`
    for end, n in sorted(ends):
        while at < end:
            k += 1
            at += len(words[k]) + 1
        first = k - n + 1
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append((first, k + 1))
    return runs, items


def _blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[dict[bytes, tuple[str, ...]]]:
    block: dict[bytes, set[str]] = {}
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = "" if row[0] is None else str(row[0])
        for window in windows_of(row[1], width):
            block.setdefault(window, set()).add(item)
        if len(block) >= block_windows:
            yield {k: tuple(sorted(v)) for k, v in block.items()}
            block = {}
    yield {k: tuple(sorted(v)) for k, v in block.items()}


def contaminated_runs(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs ([first, past last) word positions), run_bytes (the same in the original UTF-8 text), items (sorted ids)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    one, blocks = _one_or_more(_blocks(benchmark, width, block_windows))
    if one is not None:
        return _scanned(rows, docs.sparkSession.sparkContext.broadcast(one)).drop("row")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    return _merged(rows, blocks).drop("row")


def _one_or_more(blocks: Iterator[dict]) -> tuple[dict | None, Iterator[dict]]:
    """The only block, or None and all of them."""
    first = next(blocks)
    second = next(blocks, None)
    return (first, iter(())) if second is None else (None, chain([first, second], blocks))


def _scanned(rows: DataFrame, shared) -> DataFrame:
    """One pass over ``rows`` (doc_id, text and row, if there is one) with the automaton of one block."""
    schema = "row bigint, doc_id bigint, n_words bigint, runs array<struct<first:bigint,last:bigint>>, run_bytes array<struct<first:bigint,last:bigint>>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value)
        for batch in batches:
            counts, runs, spans, items = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                hit, ids = scan(found, words)
                counts.append(len(words))
                runs.append([{"first": a, "last": b} for a, b in hit])
                spans.append(_byte_runs(text, hit) if hit else [])
                items.append(sorted(ids))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "runs", "run_bytes", "items"],
            )

    row = F.col("row") if "row" in rows.columns else F.lit(None).cast("bigint").alias("row")
    return rows.select(row, "doc_id", "text").mapInArrow(run, schema)


def _merged(rows: DataFrame, blocks: Iterator[dict]) -> DataFrame:
    """As ``_scanned``, over several blocks, one after the other; ``row`` numbers the rows, so that a row's hits meet whatever its doc_id is."""
    out = None
    for block in blocks:
        shared = rows.sparkSession.sparkContext.broadcast(block)
        part = _scanned(rows, shared)
        # every row comes from the first pass, and from a later one if it is hit
        part = written(part if out is None else part.where(F.size("items") > 0), "hits")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("run_bytes")).alias("run_bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            united = [pa.array([_union(x) for x in batch.column(k).to_pylist()], batch.schema.field(k).type) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *united, batch.column(5)], schema=batch.schema)

    return merged.mapInArrow(run, merged.schema)


def _union(runs: list[dict]) -> list[dict]:
    """The runs in order; overlapping and touching ones are one."""
    out: list[dict] = []
    for a, b in sorted((r["first"], r["last"]) for r in runs):
        if out and a <= out[-1]["last"]:
            out[-1]["last"] = max(b, out[-1]["last"])
        else:
            out.append({"first": a, "last": b})
    return out


def _byte_runs(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as byte offsets of the original text."""
    import re

    clean = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = [m.span() for m in re.finditer(rb"[^ ]+", clean)]
    return [{"first": at[a][0], "last": at[b - 1][1]} for a, b in runs]


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 2) -> DataFrame:
    """Per document what its contract names; ``contaminated`` from ``min_items`` items on."""
    found = contaminated_runs(docs, benchmark, width)
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(runs, 0L, (s, r) -> s + r.last - r.first)").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 1, min_share: float = 0.0) -> DataFrame:
    """Keeps the documents of which under ``min_items`` items occur; all their columns stay.

    A document also stays if the hit words are less than ``min_share`` of its words.
    The scan keeps every column, so no join is needed; with several blocks rows are numbered, and hit ones go by number.
    """
    spark = docs.sparkSession
    one, blocks = _one_or_more(_blocks(benchmark, width, BLOCK_WINDOWS))
    kept, at = docs, docs.columns.index("text")
    if one is not None:
        shared = spark.sparkContext.broadcast(one)

        def run(batches):
            found = automaton(shared.value)
            for batch in batches:
                keep = []
                for text in batch.column(at).to_pylist():
                    words = words_of(text)
                    hit, ids = scan(found, words)
                    keep.append(not (len(ids) >= min_items and sum(b - a for a, b in hit) >= min_share * len(words)))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return kept.mapInArrow(run, docs.schema)
    row = fresh(docs.columns, "linkloom_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = _merged(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), blocks)
    hits = found.where((F.size("items") >= min_items) & (F.expr("aggregate(runs, 0L, (s, r) -> s + r.last - r.first)") >= min_share * F.col("n_words")))
    return rows.join(hits.select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM lower_docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
