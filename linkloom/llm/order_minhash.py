"""Document fingerprints by Order MinHash.

A text's UTF-8 k-mers are numbered by their occurrence, so a repeated k-mer counts
each time. For each of ``SKETCHES`` hash functions the ``PICKS`` numbered k-mers with
the smallest hashes are chosen, put back into text order, and their contents hashed
as a tuple. Equal components therefore need common k-mers in a common order, which
follows edit distance, not only overlap. The likeness of two fingerprints is the
share of equal components.

Each document is also compared with its edited text (its last half replaced by the
beginning of the next document, in order of doc_id). For that, documents go once to
buckets of doc_id between quantiles, each bucket also gets the first document of the
next one (of the first one after the last), and every bucket is read in order. Only
the quantiles and a first id for each bucket reach the driver.

Edge cases: null texts are empty; a text shorter than a k-mer is one k-mer; all texts
without k-mers have one fingerprint; rows that repeat a doc_id follow one another in
order of their texts; a null doc_id comes first; a single document is its own next
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import slots

K = 16
SKETCHES = 32
PICKS = 2
COLUMNS = 4096
BUCKETS_A_PARTITION = 4
_ODD = (np.random.default_rng(20240229).integers(1, 2**63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x ^= x >> np.uint64(29)
    return x


def kmers(data: bytes) -> np.ndarray:
    """A hash of each k-mer; of the whole text if it is shorter."""
    if not data:
        return np.zeros(0, np.uint64)
    if len(data) < K:
        data = data.ljust(K, b"\0")
    n = len(data) - K + 1
    words = np.ndarray((n + 8,), "<u8", data, 0, (1,)).astype(np.uint64)
    return _mixed(words[:n] * _A ^ (words[8:] * _B >> np.uint64(3)))


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each k-mer has come before."""
    n = np.zeros(len(h), np.uint64)
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if len(again):
        again = np.unique(again)
        at = np.minimum(np.searchsorted(again, h), len(again) - 1)
        where = np.flatnonzero(again[at] == h)
        order = np.argsort(at[where], kind="stable")
        group = at[where][order]
        first = np.r_[True, group[1:] != group[:-1]]
        k = np.arange(len(group))
        n[where[order]] = (k - np.maximum.accumulate(np.where(first, k, 0))).astype(np.uint64)
    return n


def fingerprint(text: str | None) -> np.ndarray:
    """``SKETCHES`` components of 32 bits."""
    h = kmers((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return np.zeros(SKETCHES, np.uint32)
    numbered = _mixed(h + occurrences(h) * _B)
    best, place = [], []
    for at in range(0, len(h), COLUMNS):
        v = numbered[None, at : at + COLUMNS] * _ODD[:, None]
        rows = np.arange(SKETCHES)
        for _ in range(min(PICKS, v.shape[1])):
            k = v.argmin(1)
            best.append(v[rows, k])
            place.append(k + at)
            v[rows, k] = np.uint64(2**64 - 1)
    best, place = np.array(best), np.array(place)
    if len(best) > PICKS:
        chosen = np.argsort(best, axis=0, kind="stable")[:PICKS]
        place = np.take_along_axis(place, chosen, 0)
    place = np.sort(place, axis=0)
    out = np.full(SKETCHES, len(place), np.uint64)
    for row in place:
        out = _mixed(out * _A + h[row])
    return (out >> np.uint64(32)).astype(np.uint32)


def shown(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _row(doc_id, text: str, fp: np.ndarray, following: str, next_fp: np.ndarray) -> tuple:
    new = edited(text, following)
    new_fp = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(fp), shown(new_fp), likeness(fp, new_fp), likeness(fp, next_fp)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _read_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, bucket, extra) in order; an extra row ends its bucket and gives no row of its own."""
    last = None  # (doc_id, text, fingerprint) that waits for the next document
    out: list[tuple] = []
    for batch in batches:
        for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
            for doc_id, text, extra in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                if extra and last is None:  # further rows with the id of a bucket's first document
                    continue
                fp = fingerprint(text)
                if last is not None:
                    out.append(_row(*last, text, fp))
                last = None if extra else (doc_id, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
                out = []


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", lowest))
    parts = slots(spark)
    n = parts * BUCKETS_A_PARTITION
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # two steps of a search among the cuts: the coarse one says which fine ones to look at
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    below = lambda found, key: F.size(F.filter(found, lambda x: x < key))
    if fine:
        coarse = F.lit([f[-1] for f in fine])
        block = below(coarse, F.col("key"))
        table = F.from_json(F.lit(json.dumps([*fine, []])), "array<array<bigint>>")
        bucket = block * F.lit(step) + below(table[block], F.col("key"))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    heads = sorted(rows.groupBy("bucket").agg(F.min("key")).collect())  # a row for each bucket
    into = {str(h[1]): heads[k - 1][0] for k, h in enumerate(heads)}
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    other = F.struct(F.from_json(F.lit(json.dumps(into)), "map<string,int>")[F.col("key").cast("string")].alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("key").isin([h[1] for h in heads]), F.array(own, other)).otherwise(F.array(own)) if heads else F.array(own)
    dealt = rows.select("doc_id", "text", "key", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.extra", "key")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "key", "text")
    return dealt.select("doc_id", "text", "bucket", "extra").mapInArrow(_read_in_order, SCHEMA)
