"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the lower-cased text in windows of ``WINDOW``
bytes, one layer forwards and one backwards, labels every position, and a document's
probabilities are the mean over all its positions. Gates are piecewise linear
(clipped), which keeps whole texts affordable in numpy. Training is back-propagation
through time with Adam, from a fixed seed.

It learns from at most ``TRAIN_DOCS`` documents of each language and ``TRAIN_TOTAL`` of
all, those first in order of a hash of doc_id, held-out ones excluded, in random
windows of them; of rows that repeat a doc_id one is learned. Every
byte of every text is read in the prediction; long texts are only cut into windows,
so memory is bounded by a batch of windows.

Edge cases: null texts and texts without a letter get ``und`` with score 0; one
learned language is always predicted, with score 1; without a learned language all
are ``und``; a null doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import drawn, one_text_each, place

WINDOW = 128
HIDDEN = 8
TRAIN_DOCS = 400
TRAIN_TOTAL = 20_000
STEPS = 360
BATCH = 192
TRAIN_WINDOW = 64
BATCH_WINDOWS = 1536
_LETTER = re.compile(r"[^\W\d_]")


def encode(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def initial(langs: list[str], hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters: input tables and recurrent matrices of both directions (first axis), output layer."""
    n = len(langs)
    return {
        "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
        "u": rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(np.float32),
        "c": np.zeros((2, 1, 3 * hidden), np.float32),
        "o": rng.normal(0, 0.3, (2, hidden, n)).astype(np.float32),
        "d": np.zeros(n, np.float32),
    }


def forward(p: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
    """Hidden states (time, direction, batch, hidden) for codes (time, batch); the backward layer's are in its own time order."""
    steps, batch = codes.shape
    h_n = p["u"].shape[1]
    table = np.ascontiguousarray((p["x"] + p["c"]).reshape(512, -1))
    both = np.stack([codes.astype(np.int64), codes[::-1].astype(np.int64) + 256], 1)
    h = np.zeros((2, batch, h_n), np.float32)
    out = np.empty((steps, 2, batch, h_n), np.float32)
    tape = []
    for t in range(steps):
        g = table[both[t]]
        a = h @ p["u"]
        gates = g[..., : 2 * h_n]
        gates += a[..., : 2 * h_n]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[..., :h_n], gates[..., h_n:]
        n = r * a[..., 2 * h_n :]
        n += g[..., 2 * h_n :]
        np.clip(n, -1, 1, out=n)
        if keep:
            tape.append((h, z, r, n, a[..., 2 * h_n :]))
        h = n + z * (h - n)
        out[t] = h
    return out, tape, both


def logits(p: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """Scores (time, batch, language) of every position, in text order."""
    return states[:, 0] @ p["o"][0] + states[::-1, 1] @ p["o"][1] + p["d"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    e /= e.sum(-1, keepdims=True)
    return e


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients, by back-propagation through time."""
    steps, batch = codes.shape
    states, tape, both = forward(p, codes, keep=True)
    probs = softmax(logits(p, states))
    loss = float(-np.log(np.maximum(probs[:, np.arange(batch), target], 1e-9)).mean())
    probs[:, np.arange(batch), target] -= 1
    probs /= steps * batch
    h_n = p["u"].shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["d"] = probs.sum((0, 1))
    g["o"][0] = np.einsum("tbh,tbc->hc", states[:, 0], probs, optimize=True)
    g["o"][1] = np.einsum("tbh,tbc->hc", states[::-1, 1], probs, optimize=True)
    d_states = np.stack([probs @ p["o"][0].T, (probs @ p["o"][1].T)[::-1]], 1)
    table = np.zeros((512, 3 * h_n), np.float32)
    back = np.zeros((2, batch, h_n), np.float32)
    ut = p["u"].transpose(0, 2, 1)
    da = np.empty((2, batch, 3 * h_n), np.float32)
    dg = np.empty((2, batch, 3 * h_n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, an = tape[t]
        dh = back + d_states[t]
        dn = dh * (1 - z) * (np.abs(n) < 1)
        dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
        dr = dn * an * 0.25 * ((r > 0) & (r < 1))
        dg[..., :h_n], dg[..., h_n : 2 * h_n], dg[..., 2 * h_n :] = dz, dr, dn
        da[..., : 2 * h_n] = dg[..., : 2 * h_n]
        da[..., 2 * h_n :] = dn * r
        g["u"] += h.transpose(0, 2, 1) @ da
        np.add.at(table, both[t].reshape(-1), dg.reshape(-1, 3 * h_n))
        back = dh * z + da @ ut
    g["x"] = table.reshape(2, 256, 3 * h_n)
    g["c"] = g["x"].sum(1, keepdims=True)
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Trains on random windows, every language as often as any other."""
    rng = np.random.default_rng(seed)
    p = initial(langs, HIDDEN, rng)
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(langs), BATCH)
        codes = np.full((TRAIN_WINDOW, BATCH), 32, np.uint8)
        for b, k in enumerate(target):
            text = texts[by[k][rng.integers(0, len(by[k]))]]
            at = int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW + 1)))
            part = np.frombuffer(text[at : at + TRAIN_WINDOW], np.uint8)
            codes[: len(part), b] = part
        _, g = gradients(p, codes, target)
        rate = 0.03 * min(1, step / 20) * (0.1 if step > 0.8 * steps else 1)
        for k in p:
            g[k] = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def pooled(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of the languages over all positions of each text (which is not empty)."""
    n = p["d"].shape[0]
    total = np.zeros((len(texts), n))
    owner, start, data = [], [], b"".join(texts)
    at = 0
    for k, text in enumerate(texts):
        cuts = range(0, len(text), WINDOW)
        owner.extend([k] * len(cuts))
        start.extend(at + c for c in cuts)
        at += len(text)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    flat = np.frombuffer(data + b" " * WINDOW, np.uint8)
    owner, start = np.array(owner), np.array(start)
    for k in range(0, len(start), BATCH_WINDOWS):
        o, s = owner[k : k + BATCH_WINDOWS], start[k : k + BATCH_WINDOWS]
        at = s[None, :] + np.arange(WINDOW)[:, None]
        real = at < ends[o][None, :]
        codes = np.where(real, flat[np.minimum(at, len(flat) - 1)], 32).astype(np.uint8)
        states, _, _ = forward(p, codes)
        probs = softmax(logits(p, states))
        np.add.at(total, o, (probs * real[..., None]).sum(0, dtype=np.float64))
    return total / sizes[:, None]


def predict(p: dict[str, np.ndarray], langs: list[str], texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if langs else []
    if known:
        probs = pooled(p, [encode(texts[k]) for k in known])
        for k, row in zip(known, probs, strict=True):
            best = int(row.argmax())
            names[k], scores[k] = langs[best], float(min(1.0, row[best]))
    return names, scores


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, each: int, total: int = TRAIN_TOTAL) -> tuple[list[bytes], np.ndarray, list[str]]:
    """At most ``each`` texts of every language and ``total`` of all, not held out, to the driver."""
    ids = docs.where(F.col("lang").isNotNull() & (remainder(3) != 1)).select("doc_id", F.col("lang").alias("train_lang"))
    # of each language about 16 times as many as are asked for, drawn by place alone, so no task gets a language as a whole
    sizes = ids.groupBy("train_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "train_lang").limit(total)
    ids = ids.join(F.broadcast(sizes), "train_lang").where(drawn(16 * each / F.col("n"))).groupBy("doc_id").agg(F.min("train_lang").alias("train_lang"))
    nth = F.row_number().over(Window.partitionBy("train_lang").orderBy(place(), "doc_id"))
    ids = ids.withColumn("nth", nth).where(F.col("nth") <= each)
    ids = ids.orderBy("nth", place(), "doc_id").limit(total).select("doc_id", "train_lang")  # the first of each language, then the second ones
    rows = [(encode(r[2]), r[1], r[0]) for r in one_text_each(docs, ids, ["text"]).toLocalIterator() if r[2] and _LETTER.search(r[2])]
    rows.sort(key=lambda r: (r[2], r[1], r[0]))
    langs = sorted({r[1] for r in rows})
    return [r[0] for r in rows], np.array([langs.index(r[1]) for r in rows], int), langs


def identify(docs: DataFrame, each: int = TRAIN_DOCS, steps: int = STEPS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    texts, labels, langs = training_rows(docs, each)
    shared = docs.sparkSession.sparkContext.broadcast((train(texts, labels, langs, steps) if langs else {}, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, names = shared.value
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                lang, score = predict(p, names, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
