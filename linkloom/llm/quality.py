"""Quality by co-training of a text classifier and a metadata classifier.

The text view sees only the text: shares of kinds of characters and words, marks that
follow one another, and the shape of its lines. The metadata view sees only the other
columns: source, language and length. Each starts from the labelled sample. In every
round each view labels the documents of an unlabelled pool of which it is most
confident, in the proportion of the labels, and the other view learns them too. Both
are then calibrated on labelled documents that were set aside, and a logistic
combination of the two calibrated views, fitted there as well, scores all documents.

Two parameters bound what the fit reads: ``labelled`` documents (``LABELLED``) and, as
teachers' ground only, ``pool`` unlabelled ones (``POOL``), those first in order of a
hash of doc_id; the pool is a sample because it can only move two small linear models,
which a few thousand documents settle. Scoring reads every whole text where it lies,
without a shuffle.

Edge cases: a null or empty text has no shares and one empty line; a null source,
language or length is a value of its own; without labels of both kinds all documents
score 1 and are kept; conflicting labels of a doc_id count by the smallest; of rows
that repeat a doc_id one is learned and all are scored; extra columns, whatever their
names, are kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import drawn, first_ids, one_text_each, place

LABELLED = 6_000
POOL = 3_000
ROUNDS = 4
ASIDE = 4  # one labelled document of so many is set aside
THRESHOLD = 0.5
SOURCE_BINS = 32
LANG_BINS = 8
LENGTH_BINS = 32

#: Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol, 8 part of a longer character.
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"-()?", b"!#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 8


def text_view(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    share = np.bincount(kinds, minlength=9) / n
    words = data.split()
    m = max(1, len(words))
    letters = share[1] + share[2] + share[8] + 1e-3
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    distinct = len(set(words)) / m
    marks = kinds >= 6
    marks &= kinds < 8
    doubled = int((marks[1:] & marks[:-1]).sum()) / m
    lines = data.split(b"\n")
    sizes = np.array([len(x) for x in lines], float)
    ends = [x.rstrip()[-1:] for x in lines]
    ended = sum(x in (b".", b"!", b"?") for x in ends) / len(lines)
    marked = sum(x != b"" and _CLASS[x[0]] == 7 for x in ends) / len(lines)
    return [
        *share[1:].tolist(),
        share[2] / letters,
        share[7] * n / m,
        same,
        distinct,
        float(np.log1p(m)) / 8 * distinct,
        len(data) / m / 10,
        doubled,
        data.count(b"http") / m,
        float(np.log1p(len(lines))) / 5,
        float(np.log1p(sizes.mean())) / 6,
        float(np.log1p(sizes.std())) / 6,
        float((sizes < 40).mean()),
        ended,
        marked,
    ]


def metadata_view(source, lang, n_chars) -> list[float]:
    out = [0.0] * (SOURCE_BINS + LANG_BINS + LENGTH_BINS)
    out[zlib.crc32(repr(source).encode()) % SOURCE_BINS] = 1.0
    out[SOURCE_BINS + zlib.crc32(repr(lang).encode()) % LANG_BINS] = 1.0
    n = max(0.0, float(n_chars or 0))
    size = np.log2(1 + n) * 1.5  # a bin for each third of an octave or so
    out[SOURCE_BINS + LANG_BINS + min(LENGTH_BINS - 1, int(size))] = 1.0
    return [*out, float(size) / 20, float(n_chars is None)]


class Linear:
    """Logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 250):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([np.clip((x - self.mean) / self.std, -8, 8), np.ones(len(x))])
        weight = np.ones(len(y)) if weight is None else weight
        self.w, m, s = np.zeros(z.shape[1]), 0.0, 0.0
        for k in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) / weight.sum() + l2 * np.r_[self.w[:-1], 0]
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            self.w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return z @ self.w[:-1] + self.w[-1]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> dict | None:
    """The calibrated pair of classifiers; ``views`` and ``pool`` hold both views' features."""
    y = np.asarray(y, float)
    aside = np.arange(len(y)) % ASIDE == 0
    if len(y) < 2 * ASIDE or len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        return None
    xs, ys = [[v[~aside]] for v in views], [[y[~aside]], [y[~aside]]]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    share = y.mean()
    models = [Linear(np.concatenate(xs[k]), np.concatenate(ys[k])) for k in (0, 1)]
    each = max(2, len(pool[0]) // (4 * rounds))
    for _ in range(rounds):
        for teacher in (0, 1):  # what one view is sure of, the other learns
            pupil = 1 - teacher
            p = sigmoid(models[teacher].raw(pool[teacher])) if len(pool[0]) else np.zeros(0)
            for label, count, sure in ((1.0, max(1, round(each * share)), p), (0.0, max(1, round(each * (1 - share))), 1 - p)):
                order = np.argsort(-sure, kind="stable")
                order = order[free[pupil][order] & (sure[order] > 0.9)][:count]
                free[pupil][order] = False
                xs[pupil].append(pool[pupil][order])
                ys[pupil].append(np.full(len(order), label))
        models = [Linear(np.concatenate(xs[k]), np.concatenate(ys[k])) for k in (0, 1)]
    raws = [m.raw(v[aside]) for m, v in zip(models, views, strict=True)]
    scales = [Linear(r[:, None], y[aside], steps=400) for r in raws]
    both = np.column_stack([s.raw(r[:, None]) for s, r in zip(scales, raws, strict=True)])
    return {"models": models, "scales": scales, "both": Linear(both, y[aside], l2=1e-4, steps=600)}


def scores(model: dict | None, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated score of each view and the combined one."""
    n = len(views[0])
    if model is None or not n:
        return (np.ones(n),) * 3
    raw = [s.raw(m.raw(v)[:, None]) for s, m, v in zip(model["scales"], model["models"], views, strict=True)]
    return sigmoid(raw[0]), sigmoid(raw[1]), sigmoid(model["both"].raw(np.column_stack(raw)))


def _views(texts, sources, langs, sizes) -> list[np.ndarray]:
    a = np.array([text_view(t) for t in texts]).reshape(len(texts), -1)
    b = np.array([metadata_view(s, g, n) for s, g, n in zip(sources, langs, sizes, strict=True)]).reshape(len(texts), -1)
    return [a, b]


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict | None:
    """Trains on a bounded sample of documents, read to the driver."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    marks = first_ids(marks, labelled)
    # drawn by place first, so that few ids are compared with the labels
    some = docs.select(F.col("doc_id")).where(F.col("doc_id").isNotNull() & drawn(F.lit(min(1.0, 16 * pool / max(1, docs.count())))))
    free = some.distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
    free = free.orderBy(place(), "doc_id").limit(pool).select("doc_id", F.lit(None).cast("int").alias("q"))
    found = one_text_each(docs, marks.unionByName(free), ["text", "source", "lang", "n_chars"])  # at most labelled + pool rows
    rows, views = [], ([], [])
    for r in found.toLocalIterator():
        rows.append((r["doc_id"], r["q"]))
        views[0].append(text_view(r["text"]))
        views[1].append(metadata_view(r["source"], r["lang"], r["n_chars"]))
    order = sorted(range(len(rows)), key=lambda k: (zlib.crc32(str(rows[k][0]).encode()), rows[k][0]))
    known, rest = [k for k in order if rows[k][1] is not None], [k for k in order if rows[k][1] is None]
    if not known:
        return None
    pick = lambda at: [np.array([v[k] for k in at]).reshape(len(at), len(views[i][0])) for i, v in enumerate(views)]
    return co_train(pick(known), np.array([rows[k][1] == 1 for k in known]), pick(rest))


def _scored(docs: DataFrame, model, columns: list[str]):
    at = [columns.index(c) for c in ("text", "source", "lang", "n_chars")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch):
        return scores(shared.value, _views(*(batch.column(k).to_pylist() for k in at)))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, content_score, metadata_score, score, keep."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "lang", "n_chars")
    score = _scored(rows, learn(docs, labels), rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                a, b, c = score(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= threshold)], names=["doc_id", "content_score", "metadata_score", "score", "keep"])

    return rows.mapInArrow(run, "doc_id bigint, content_score double, metadata_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    score = _scored(docs, learn(docs, labels), docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                yield part.filter(pa.array(score(part)[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
