"""Removal of long repeated strings by a sorted array of sampled suffixes.

Each byte that a string of ``LENGTH`` bytes covers which also starts anywhere else is
removed. Sorting all suffixes would move some hundred times the input (a suffix of 400
bytes for each byte), so suffixes are sorted in three steps, each of which decides most
of what the last one left:

1. Every start i of such a string chooses an anchor: of its first 160 positions that
   with the smallest hash of the ``GRAM`` bytes there, the first of equal ones. Equal
   strings choose the same place in them, and the starts of an anchor form one range,
   so about 1 in 80 suffixes is left. They are sorted by tokens: the first 8 bytes
   that all strings over such a range share, a digest of all that they share, and a
   digest of all bytes that the range sees. If the third token repeats, all starts of
   the range do; if the first two do not, none does.
2. Where the first two tokens repeat with different third ones, as they do at the ends
   of longer repeats, one range for each third token is divided into ranges of up to
   16 starts (in place by their distance to the anchor), and these are sorted.
3. What is open then is divided into single starts, where all tokens are of one string.

Behind its first 8 bytes a suffix is ordered by 64-bit digests and not by its text:
what is needed is that equal strings lie together, and the bytes themselves would be
seven times the input to shuffle. Two different strings with equal digests would be
taken for equal; none is expected below some 10^9 suffixes that share 8 bytes.

One sample sort serves all: splitters from a sample of the token rows range-partition
the suffixes by their leading tokens (with row and position behind them, so a very
common suffix is spread over as many buckets as it fills), each bucket is sorted by a
multikey quicksort, and neighbours are compared. Only the first and last row of a
bucket can depend on another one; those rows, two for each bucket, are compared
across the boundaries. The sample grows with the number of buckets, is sorted in
tasks, and only the splitters, one for about ``BUCKET_ROWS`` rows, reach the driver.

Rows are numbered and texts are shuffled once by that number, which no two rows share,
into a bucketed table, in which each step and the removal find them again by plain
equality, without a shuffle of texts. Texts are read one at a time, and token rows are
passed on in blocks of ``FLUSH``, however long a text is.

A passage is a run covered by repeated strings of ``PASSAGE`` bytes that holds
``PASSAGE_WORDS`` whole words or ``LENGTH`` bytes. ``report`` counts them beside what
its contract names, ``without_repeats`` removes them. Strings of ``LENGTH`` bytes can
only repeat inside such runs, so where both are wanted the longer ones are looked for
there alone.

Edge cases: null texts are empty; texts shorter than the length keep all; equal rows
repeat each other; an empty table gives an empty result; extra columns are kept by
``without_repeats`` and ignored by ``report``. Where a removed run cuts a character
in two, ``without_repeats`` drops the rest of that character.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import kept_as, slots, written

LENGTH = 400
PASSAGE = 256
PASSAGE_WORDS = 50
#: Starts that share a range, in the three steps.
STEPS = (160, 16, 1)
SPAN = STEPS[0]
GRAM = 16
#: Rows of a bucket, about, and sampled rows for each.
BUCKET_ROWS = 500_000
SAMPLED = 100
#: Of texts up to so many bytes some are sampled, and of these one row in ``THIN``; longer ones are all sampled by rows.
WHOLE = 1 << 14
THIN = 16
#: The sample stands for the rows of so many texts at least, if there are.
LEAST_TEXTS = 2_000
BLOCK = 1 << 22
FLUSH = 1 << 16
_LOW = np.uint64((1 << 24) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_NAMES = ["t1", "t2", "t3", "row", "at"]
TOKENS = ", ".join(f"{c} bigint" for c in _NAMES)
#: Room for the length of a span in its packed form.
_WIDE = 12


def _loads(data: bytes) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(np.uint64)


def anchors(data: bytes, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the starts of a text: (position, first start, last start)."""
    n = len(data) - length + 1
    found = []
    for s in range(0, max(n, 0), BLOCK):
        e = min(n, s + BLOCK)
        words = _loads(data[s : e - 1 + span - 1 + GRAM])
        h = words[: e - s + span - 1] * _A ^ (words[8 : 8 + e - s + span - 1] * _B)
        h ^= h >> np.uint64(31)
        h *= _C
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: e - s], key[span - width : span - width + e - s])
        best = (key[: e - s] & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        last = np.r_[cut[1:], e - s] - 1
        found.append(np.stack([best[cut] + s, cut + s, last + s]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3


def ranges(data: bytes, step: int, length: int, within: np.ndarray | None = None) -> np.ndarray:
    """Packed ranges of starts (position << 16 | most << 8 | least bytes before it): those of all anchors of a text, or of its parts ``within`` [first, past last)."""
    out = []
    for a, b in [(0, len(data))] if within is None else within.tolist():
        p, first, last = anchors(data if within is None else data[a:b], length, step)
        out.append((p + a) << 16 | (p - first) << 8 | (p - last))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def divided(ats: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Parts of at most ``step`` starts of packed ranges: position, most, least, and the distance at which each part begins."""
    p, most, least = ats >> 16, ats >> 8 & 255, ats & 255
    n = most // step - least // step + 1
    p, most, least = np.repeat(p, n), np.repeat(most, n), np.repeat(least, n)
    nth = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
    base = (least // step + nth) * step
    return p, np.minimum(most, base + step - 1), np.maximum(least, base), base


def tokens(data: bytes, parts: tuple[np.ndarray, ...], step: int, length: int) -> list[np.ndarray]:
    """Tokens t1, t2, t3 of parts of ranges."""
    from xxhash import xxh3_64_intdigest as digest

    p, most, least, base = parts
    a, n = p - base, len(p)
    t1 = np.frombuffer(data, np.uint8)[a[:, None] + np.arange(8)].view(">i8").ravel().astype(np.int64)
    core = length - step + 1
    t2 = np.fromiter((digest(data[x : x + core]) for x in a.tolist()), np.uint64, n)
    whole = zip((p - most).tolist(), (p - least + length).tolist(), ((most - base) << 8 | (least - base)).tolist(), strict=True)
    t3 = np.fromiter((digest(data[x:y], seed) for x, y, seed in whole), np.uint64, n)
    return [t1, t2.view(np.int64), t3.view(np.int64)]


def multikey_quicksort(keys: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """Order of the rows by the tokens ``keys``: three-way partitions on one token, equal rows go on with the next."""
    order = np.arange(len(keys[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        value = keys[depth][part]
        pivot = np.sort(value[:: max(1, len(value) // 63)])[min(31, len(value) // 2)]
        less, more = value < pivot, value > pivot
        same = ~(less | more)
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def bucket_of(splitters: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of splitters (a column for each key, sorted) that are at or before each row."""
    out = np.searchsorted(splitters[0], keys[0], "right")
    left = np.searchsorted(splitters[0], keys[0], "left")
    some = np.flatnonzero(out > left)  # rows whose first token is a splitter's
    lo, hi, rows = left[some], out[some], [k[some] for k in keys]
    while (live := lo < hi).any():
        mid = np.where(live, (lo + hi) // 2, 0)
        before = np.ones(len(some), bool)
        for cut, row in zip(reversed(splitters), reversed(rows), strict=True):
            before = (cut[mid] < row) | ((cut[mid] == row) & before)
        lo, hi = np.where(live & before, mid + 1, lo), np.where(live & ~before, mid, hi)
    out[some] = lo
    return out.astype(np.int32)


def repeats(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Sorts one bucket and compares neighbours: rows with their state and whether they are its first or last one.

    State 2: all tokens repeat. State 1 (added): the first two tokens repeat with another
    third one, and the row is the first with its tokens. Rows with state 0 are left out.
    """
    order = multikey_quicksort(cols[:3])
    t1, t2, t3 = (c[order] for c in cols[:3])
    n = len(order)
    lead = (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])
    full = lead & (t3[1:] == t3[:-1])
    head = np.r_[True, ~full]  # the first row with its tokens
    run = np.cumsum(np.r_[True, ~lead]) - 1
    mixed = np.bincount(run, head)[run] > 1
    state = (2 * (np.r_[False, full] | np.r_[full, False]) + (head & mixed)).astype(np.int32)
    edge = np.zeros(n, bool)
    edge[[0, -1]] = True
    keep = np.flatnonzero(edge | (state > 0))
    return pa.RecordBatch.from_arrays([*(pa.array(c[order[keep]]) for c in cols), pa.array(state[keep]), pa.array(edge[keep])], names=[*_NAMES, "state", "edge"])


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(k).to_numpy() for k in range(len(_NAMES))] for b in batches if b.num_rows]
    if held:
        yield repeats([np.concatenate(c) for c in zip(*held, strict=True)])


def compared(rows: DataFrame, buckets: int) -> DataFrame:
    """Range partitions of the token rows, sorted and compared: row, at, state of those with a state."""
    dealt = rows.repartitionById(buckets, F.col("bucket")).drop("bucket")
    flagged = written(dealt.mapInArrow(_in_buckets, TOKENS + ", state int, edge boolean"), "repeats")
    # two rows of each bucket, compared across the boundaries
    ends = flagged.where("edge").select(*_NAMES, "state")
    lead = Window.partitionBy("t1", "t2")  # over distinct tokens, so a very common one is a single row of it
    known = ends.groupBy("t1", "t2", "t3").agg(F.count("*").alias("n")).withColumn("m", F.count("*").over(lead))
    across = F.when(F.col("n") > 1, 2).otherwise(0).bitwiseOR(F.when(F.col("m") > 1, 1).otherwise(0))
    ends = ends.join(known, ["t1", "t2", "t3"]).select("row", "at", F.col("state").bitwiseOR(across).alias("state"))
    return flagged.where("not edge").select("row", "at", "state").unionByName(ends).where("state > 0")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of numbers in a column, one after the other."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """The texts in a column, one after the other; null ones are empty."""
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def token_rows(texts: DataFrame, step: int, length: int, splitters: list[np.ndarray] | None = None, rate: float = 1.0, long_rate: float = 1.0) -> DataFrame:
    """Token rows of texts (row, text), of parts of them (row, text, within) or of parts of their open ranges (row, text, ats).

    With ``splitters``, each row's bucket, too. Only a share ``rate`` of the rows is
    given back, of those of texts over ``WHOLE`` bytes a share ``long_rate``.
    """
    more = texts.columns[2] if len(texts.columns) > 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def block() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            bucket = [] if splitters is None else [pa.array(bucket_of(splitters, cols))]
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), *bucket], names=[*_NAMES, *(["bucket"] if bucket else [])])

        waiting = 0
        for batch in batches:
            lists = _lists(batch.column(2)) if more else iter(lambda: None, 0)
            for row, data, own in zip(batch.column(0).to_numpy().tolist(), _bytes(batch.column(1)), lists, strict=False):
                if len(data) < length:
                    continue
                if more == "ats":
                    ats = own
                else:
                    ats = ranges(data, step, length, own.reshape(-1, 2) if more else None)
                some = FLUSH // 16 if more == "ats" else FLUSH
                for k in range(0, len(ats), some):
                    part = ats[k : k + some]
                    parts = divided(part, step) if more == "ats" else (part >> 16, part >> 8 & 255, part & 255, np.zeros(len(part), np.int64))
                    if (share := long_rate if len(data) > WHOLE else rate) < 1:
                        mixed = ((parts[0] - parts[3]).astype(np.uint64) + np.uint64(row * int(_B) % 2**64)) * _A
                        chosen = (mixed ^ (mixed >> np.uint64(29))) * _C >> np.uint64(40) < np.uint64(share * (1 << 24))
                        parts = tuple(x[chosen] for x in parts)
                    p, most, least, base = parts
                    held.append([*tokens(data, parts, step, length), np.full(len(p), row), p << 16 | most << 8 | least])
                    waiting += len(p)
                    if waiting >= FLUSH:
                        yield block()
                        waiting = 0
        if held:
            yield block()

    return texts.mapInArrow(run, TOKENS + (", bucket int" if splitters is not None else ""))


def _splitters(texts: DataFrame, n_texts: int, step: int, length: int) -> list[np.ndarray] | None:
    """Splitters between buckets of about equal size: sorted columns t1, t2, t3, row, at. None if no sampled text has token rows.

    Every token row has the same chance to be in the sample, whatever text it is of, and
    few rows of one text are in it together.
    """
    spark = texts.sparkSession
    rate = min(1.0, max(max(LEAST_TEXTS, 20 * slots(spark)) / max(1, n_texts), SAMPLED / BUCKET_ROWS))
    drawn = min(1.0, THIN * rate)
    if drawn < 1:
        texts = texts.where((F.pmod(F.xxhash64("row"), F.lit(1 << 24)) < int(drawn * (1 << 24))) | (F.octet_length("text") > WHOLE))
    sample = written(token_rows(texts, step, length, rate=rate / drawn, long_rate=rate), "sample")
    n_rows = sample.count()
    buckets = max(slots(spark), int(n_rows / rate / BUCKET_ROWS) + 1)
    every = max(1, n_rows // buckets)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0  # so that no bucket gets more than `every` sampled rows
        for batch in batches:
            yield batch.take(pa.array(np.arange(at, batch.num_rows, every)))
            at = (at - batch.num_rows) % every if at < batch.num_rows else at - batch.num_rows

    chosen = sample.orderBy(*_NAMES).mapInArrow(picked, TOKENS).toPandas().sort_values(_NAMES) if n_rows else None
    return [chosen[c].to_numpy(np.int64) for c in _NAMES] if chosen is not None and len(chosen) else None


def spans(texts: DataFrame, length: int = LENGTH, within: DataFrame | None = None) -> DataFrame:
    """Per text (row, text) with repeats: row and spans, byte ranges first << _WIDE | size in no order, that may overlap.

    ``within`` (row, within): the parts of texts, first and past last one after the other, outside which nothing is looked for.
    """
    texts = texts.select("row", "text")
    rows, open_, out = texts if within is None else texts.join(within, "row").select("row", "text", "within"), within, None
    for step in STEPS:
        cuts = _splitters(rows, (texts if open_ is None else open_).count(), step, length)
        none = [np.zeros(0, np.int64)] * len(_NAMES)
        found = compared(token_rows(rows, step, length, cuts or none), 1 + (len(cuts[0]) if cuts else 0))
        first = F.expr("shiftright(at, 16) - (shiftright(at, 8) & 255)")
        size = F.expr(f"(shiftright(at, 8) & 255) - (at & 255) + {length}")
        sure = found.where("state & 2 = 2").select("row", F.shiftleft(first, _WIDE).bitwiseOR(size).alias("span"))
        out = sure if out is None else out.unionByName(sure)
        if step > 1:
            open_ = written(found.where("state & 1 = 1").groupBy("row").agg(F.collect_list("at").alias("ats")), "open")
            rows = texts.join(open_, "row").select("row", "text", "ats")
    return out.groupBy("row").agg(F.collect_list("span").alias("spans"))


def bucketed(docs: DataFrame) -> DataFrame:
    """The rows, numbered in the order in which their files give them (column row), as a table in buckets of that number."""
    spark = docs.sparkSession
    name, n = kept_as("table", f"linkloom_texts_{uuid.uuid4().hex}"), slots(spark)
    docs.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def merged(packed: np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of the spans; touching ones are one run."""
    if packed is None or not len(packed):
        return []
    x = np.sort(packed)
    a = x >> _WIDE
    b = np.maximum.accumulate(a + (x & ((1 << _WIDE) - 1)))
    cut = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[cut].tolist(), b[np.r_[cut[1:], len(a)] - 1].tolist(), strict=True))


def cut_out(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_words(data: bytes, a: int, b: int) -> int:
    """Words of ``data`` that lie in [a, b) as a whole."""
    n = len(data[a:b].split())
    cut = [x for x in (a, b) if 0 < x < len(data) and not data[x - 1 : x].isspace() and not data[x : x + 1].isspace()]
    return max(0, n - len(cut))


def passages(data: bytes, packed: np.ndarray | None, words: int, length: int) -> list[tuple[int, int]]:
    """The runs that hold so many whole words or so many bytes."""
    return [(a, b) for a, b in merged(packed) if b - a >= length or whole_words(data, a, b) >= words]


def _long_runs(found: DataFrame, length: int) -> DataFrame:
    """row and within: the runs of at least ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[x for a, b in merged(s) if b - a >= length for x in (a, b)] for s in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int64()))], names=["row", "within"])

    return found.select("row", "spans").mapInArrow(run, "row bigint, within array<bigint>").where(F.size("within") > 0)


def report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """What the contract asks for, and n_passages and passage_bytes: how many passages a document holds and their bytes."""
    texts = bucketed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    short = written(spans(texts, passage), "passages")
    found = spans(texts, length, written(_long_runs(short, length), "long"))
    empty = F.array().cast("array<bigint>")
    joined = texts.join(found, "row", "left").join(short.withColumnRenamed("spans", "short"), "row", "left")
    joined = joined.select("doc_id", "text", F.coalesce("spans", empty).alias("spans"), F.coalesce("short", empty).alias("short"))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for data, own, wider in zip(_bytes(batch.column(1)), _lists(batch.column(2)), _lists(batch.column(3)), strict=True):
                runs, many = merged(own), passages(data, wider, words, length)
                row = (len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut_out(data, runs)).hexdigest(), len(many), sum(b - a for a, b in many))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            cols = [pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for c, n in zip(out, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    return joined.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'bigint'}" for n in names))


def without_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """All rows and columns; passages are cut out of ``text`` and ``n_chars``, if it is there, is counted anew where that changed the text."""
    columns = docs.columns
    own = {c: f"c{k}" for k, c in enumerate(columns)}  # no name of theirs can clash here
    texts = bucketed(docs.select(F.col("text").alias("text"), *(F.col(f"`{c}`").alias(own[c]) for c in columns if c != "text")))
    joined = texts.join(spans(texts, passage), "row", "left")
    joined = joined.select(*("text" if c == "text" else own[c] for c in columns), F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns[:-1])
            texts, counts = cols[at], cols[chars].to_pylist() if chars is not None else None
            kept: list[bytes | None] = []
            for k, (data, found) in enumerate(zip(_bytes(texts), _lists(batch.column(batch.num_columns - 1)), strict=True)):
                runs = passages(data, found, words, length)
                if runs:
                    left = cut_out(data, runs).decode("utf-8", "ignore")
                    data = left.encode()
                    if counts is not None:
                        counts[k] = len(left)
                kept.append(data if texts[k].is_valid else None)
            cols[at] = pa.array(kept, pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).view(texts.type)
            if chars is not None:
                cols[chars] = pa.array(counts, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(run, kinds)
