"""Toxicity by weak supervision.

1. Terms (words and word beginnings of four to eight letters) that the labelled
   training rows show mostly in toxic texts form lexicons; with general patterns
   (insults at a reader, shouting, a fixed list of English insults) they are the
   voters. A lexicon voter votes "toxic" or abstains; a pattern voter may also vote
   "clean".
2. A generative label model estimates for every voter how often it votes either way
   on toxic and on clean texts, by expectation maximisation over the votes alone
   (the prior is the share of toxic training labels). Voters whose votes remain
   correlated given the label count as one: each is weighed by one over the sum of
   its correlations.
3. A linear classifier over the terms and pattern counts learns the posterior labels
   and its two calibration constants are fitted to the training labels.

All is learned from at most ``TRAIN_ROWS`` labelled rows, those first in order of a
hash of doc_id, held-out rows excluded. Every whole text is scored where it lies; a
score depends on the text alone, so equal texts have equal scores.

Edge cases: null and empty texts get the score of a text without terms; a null
doc_id is not held out; conflicting labels of a doc_id count by their largest; if no
toxic row was labelled, every score is the share of toxic labels, 0; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import first_ids, one_text_each

TRAIN_ROWS = 8_000
MAX_TERMS = 400
COVER = 5
MAX_TERM_VOTERS = 40
THRESHOLD = 0.3
CACHED_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
#: Insults known beforehand; the other voters are learned.
KNOWN = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb hate kill filthy ugly freak bastard idiota imbecil estupido estupida basura asco asqueroso inutil payaso dummkopf abschaum widerlich dumm wertlos hasse crétin débile ordure nul dégoûtant imbécile minable haine".split())
_AT_READER = re.compile(r"\b(?:you|your|du|dein|tu|toi|eres)\b[^.!?\n]{0,40}\b(?:idiot|moron|stupid|scum|trash|loser|pathetic|worthless|disgusting|clown|dumm|nul|basura)", re.I)
PATTERNS = 6
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def terms_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings that stand for all its forms (marked with a star)."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6, 7, 8) if len(word) >= k))


def patterns_of(text: str, words: Counter) -> list[float]:
    """Counts from patterns: known insults (logarithm, and their kinds), at a reader, shouting, exclamations, words."""
    known = [words[w] for w in words.keys() & KNOWN]
    data = text.encode("utf-8", "surrogatepass")
    return [
        float(np.log1p(sum(known))),
        float(np.log1p(len(known))),
        float(bool(known) and bool(_AT_READER.search(text))),
        1 - len(data.translate(None, _CAPITALS)) / max(1, len(data)),
        float(np.log1p(text.count("!"))) / 4,
        float(np.log1p(sum(words.values()))) / 8,
    ]


def words_in(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def mine(texts: list[str | None], toxic: np.ndarray) -> list[str]:
    """The terms that mark toxic training texts, best first; a term is left out where ``COVER`` before it mark most of its texts, or one marks just the same."""
    docs: dict[str, list[int]] = {}
    clean: Counter[str] = Counter()
    for k, text in enumerate(texts):
        if toxic[k]:
            for t in {t for w in words_in(text) for t in terms_of(w)}:
                docs.setdefault(t, []).append(k)
    for k, text in enumerate(texts):
        if not toxic[k]:
            clean.update({t for w in words_in(text) for t in terms_of(w)} & docs.keys())
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    scored = []
    for t, found in docs.items():
        rate, against = len(found) / n_toxic, (clean[t] + 0.5) / (n_clean + 1)
        if len(found) >= max(4, 0.005 * n_toxic) and rate > 12 * against:
            scored.append((-np.log(rate / against) * np.sqrt(len(found)), len(t), t))
    kept, covered, same = [], Counter(), set()
    for _, _, t in sorted(scored):
        if len(kept) == MAX_TERMS:
            break
        if tuple(docs[t]) not in same and sum(covered[k] < COVER for k in docs[t]) >= max(2, len(docs[t]) / 8):
            kept.append(t)
            covered.update(docs[t])
            same.add(tuple(docs[t]))
    return kept


def features(text: str | None, index: dict[str, int], cache: dict[str, tuple[int, ...]]) -> tuple[list[int], list[float]]:
    """Numbers of the terms in a text, and its pattern counts."""
    words = words_in(text)
    found: set[int] = set()
    for w in words:
        hit = cache.get(w)
        if hit is None:
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            hit = cache[w] = tuple(index[t] for t in terms_of(w) if t in index)
        if hit:
            found.update(hit)
    return sorted(found), patterns_of(text or "", words)


def votes(terms: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Votes of all voters (1 toxic, -1 clean, 0 none); terms: rows by terms, 0 or 1."""
    n = len(terms)
    single = terms[:, :MAX_TERM_VOTERS].astype(np.int8)
    hits = terms.sum(1)
    lexicons = [np.where(terms[:, k::8].any(1), 1, 0) for k in range(8)]
    rules = [
        np.where(hits > 0, 1, -1),
        np.where(hits > 2, 1, np.where(hits == 0, -1, 0)),
        np.where(patterns[:, 0] > 0, 1, 0),
        np.where(patterns[:, 1] > 0.8, 1, np.where((patterns[:, 1] == 0) & (hits == 0), -1, 0)),
        np.where(patterns[:, 2] > 0, 1, 0),
        np.where((patterns[:, 3] > 0.5) & (patterns[:, 4] > 0), 1, 0),
        np.where((patterns[:, 0] == 0) & (patterns[:, 4] == 0) & (hits == 0), -1, 0),
    ]
    return np.column_stack([single.reshape(n, -1), *lexicons, *rules]).astype(np.int8)


def label_model(v: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, P(vote | label) as (voter, label, vote + 1), and each voter's weight for its correlations."""
    n, m = v.shape
    one_hot = np.stack([v == x for x in (-1, 0, 1)], 2).astype(np.float64)
    post = np.clip(0.5 + 0.5 * np.tanh(v.sum(1)), 0.02, 0.98)
    weight = np.ones(m)
    table = np.zeros((m, 2, 3))
    for k in range(rounds):
        for y, p in ((0, 1 - post), (1, post)):
            table[:, y] = (np.einsum("n,nmx->mx", p, one_hot) + 0.1) / (p.sum() + 0.3)
        if k in (5, 20):  # what of the votes the label does not explain
            mean = post[:, None] * (table[:, 1, 2] - table[:, 1, 0]) + (1 - post)[:, None] * (table[:, 0, 2] - table[:, 0, 0])
            rest = v - mean
            rest /= np.maximum(np.sqrt((rest**2).mean(0)), 1e-6)
            weight = 1 / np.maximum(1, np.abs(rest.T @ rest / n).clip(0, 1).sum(1))
        ratio = np.log(table[:, 1] / table[:, 0])
        score = np.einsum("nmx,mx,m->n", one_hot, ratio, weight) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post, table, weight


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on soft labels, by Adam on the whole sample."""
    x = np.column_stack([x, np.ones(len(x))])
    w, m, s = np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + l2 * np.r_[w[:-1], 0]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w


def fit(texts: list[str | None], toxic: np.ndarray) -> dict:
    """The model: terms, their weights, pattern weights, constant."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return {"terms": [], "w": np.zeros(PATTERNS), "b": float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), "constant": share}
    terms = mine(texts, toxic)
    index, cache = {t: k for k, t in enumerate(terms)}, {}
    x, p = np.zeros((len(texts), len(terms))), np.zeros((len(texts), PATTERNS))
    for k, text in enumerate(texts):
        found, p[k] = features(text, index, cache)
        x[k, found] = 1
    post, _, _ = label_model(votes(x, p), float(toxic.mean()))
    count = np.log1p(x.sum(1, keepdims=True))
    w = logistic(np.hstack([x, p, count]), post, 1e-4)
    raw = np.hstack([x, p, count]) @ w[:-1] + w[-1]
    scale = logistic(raw[:, None] / 4, toxic.astype(float), 1e-3)  # calibration on the training labels
    w = np.r_[w[:-1], w[-1]] * scale[0] / 4
    return {"terms": terms, "w": w[:-1], "b": float(w[-1] + scale[1]), "constant": None}


def score(text: str | None, model: dict, index: dict[str, int], cache: dict) -> float:
    if model["constant"] is not None:
        return model["constant"]
    found, patterns = features(text, index, cache)
    w, n = model["w"], len(index)
    raw = model["b"] + sum(w[k] for k in found) + float(np.dot(w[n : n + PATTERNS], patterns)) + w[-1] * np.log1p(len(found))
    return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def remainder(doc_id, n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents that are not held out, to the driver."""
    ids = labels.where((remainder("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic_label"))
    ids = first_ids(ids.where("doc_id is not null"), rows)
    found = sorted(((r[0], r[2] or "", r[1]) for r in one_text_each(docs, ids, ["text"]).toLocalIterator()), key=lambda r: r[:2])
    return [r[1] for r in found], np.array([r[2] == 1 for r in found], bool)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, train_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        index, cache = {t: k for k, t in enumerate(m["terms"])}, {}
        for batch in batches:
            scores = np.array([score(t, m, index, cache) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
