"""Operator 6, quality: a linear-chain conditional random field labels every line good or bad.

A line's features, and those of the lines before and after it, make its score for good; two-state transitions tie neighbours. Forward-backward
marginals, weighted by line length, give the document's quality. Training takes a document's label for each of its lines.

Defined results: a null or empty text is one empty line; a model without training rows scores 0.5; equal rows each give a row; an empty table
gives an empty result; texts of any length are scored whole, of whatever bytes; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, id_text
from ._labelled import labelled_sample

#: The field is fitted on about so many documents of each label (twice as many at most).
MAX_TRAIN_PER_LABEL = 1500
#: In training, documents are cut into chains of so many lines; scoring runs over whole documents.
CHAIN = 32
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = b".,;:'\"-()?"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGITS + _PLAIN)
N_FEATURES = 14


def line_features(line: bytes) -> tuple[float, ...]:
    n = len(line)
    words = line.split()
    k = len(words)
    if k == 0:
        return (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    upper = n - len(line.translate(None, _UPPER))
    lower = n - len(line.translate(None, _LOWER))
    symbols = n - len(line.translate(None, _SYMBOLS))
    digits = n - len(line.translate(None, _DIGITS))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if k > 1 else 0
    letters = n - k + 1
    return (
        1.0,
        math.log1p(n) / 10,
        upper / max(1, upper + lower),
        min(1.0, 5 * symbols / n),
        min(1.0, 5 * digits / n),
        1 - distinct / k,
        1 - pairs / (k - 1) if k > 1 else 0.0,
        letters / k / 20,
        line.count(b"|") / k,
        line.count(b"!") / k,
        1.0 if words[-1][-1] in b".!?" else 0.0,
        0.0,
        1.0 if words[0][:1].isupper() or words[0][0] > 127 else 0.0,
        1.0 if k < 4 else 0.0,
    )


def chain_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3 N_FEATURES) features with those of both neighbours, and the lines' weights."""
    lines = text.split(b"\n")
    own = np.array([line_features(x) for x in lines], np.float32)
    pad = np.zeros((1, N_FEATURES), np.float32)
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad])]), np.array([max(1, len(x)) for x in lines], float)


def marginals(state: list[float], t: tuple[float, float, float, float]) -> list[float]:
    """P(good) of each line; ``state``: a line's score for good against bad; ``t``: factors of bad-bad, bad-good, good-bad, good-good."""
    n = len(state)
    bb, bg, gb, gg = t
    e = [math.exp(max(-30.0, min(30.0, s))) for s in state]
    fwd = [0.0] * n  # share of good, forward
    p = e[0] / (1 + e[0])
    fwd[0] = p
    for i in range(1, n):
        g = ((1 - p) * bg + p * gg) * e[i]
        b = (1 - p) * bb + p * gb
        p = g / (g + b)
        fwd[i] = p
    out = [0.0] * n
    out[-1] = p
    r = 0.5  # share of good, backward
    for i in range(n - 2, -1, -1):
        g, b = r * e[i + 1], 1 - r
        up, down = gg * g + gb * b, bg * g + bb * b
        r = up / (up + down)
        x, y = fwd[i] * r, (1 - fwd[i]) * (1 - r)
        out[i] = x / (x + y) if x + y > 0 else fwd[i]
    return out


def fit(chains: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores (2 x 2) that maximise the conditional likelihood of constant chains, by Adam over all chains at once."""
    d = 3 * N_FEATURES
    n, steps = len(chains), max(map(len, chains))
    x = np.zeros((n, steps, d), np.float32)
    mask = np.zeros((n, steps), bool)
    for i, c in enumerate(chains):
        x[i, : len(c)] = c
        mask[i, : len(c)] = True
    w, t = np.zeros(d), np.zeros((2, 2))
    m, v = np.zeros(d + 4), np.zeros(d + 4)
    inside = mask[:, 1:]
    y = labels.astype(int)
    for r in range(1, rounds + 1):
        s = np.clip(x @ w.astype(np.float32), -30, 30).astype(float)
        e = np.stack([np.ones_like(s), np.exp(s)], 2)  # bad, good
        a = np.zeros((n, steps, 2))
        b = np.ones((n, steps, 2)) / 2
        T = np.exp(t)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, steps):
            z = (a[:, i - 1] @ T) * e[:, i]
            a[:, i] = np.where(mask[:, i, None], z / z.sum(1, keepdims=True), a[:, i - 1])
        for i in range(steps - 2, -1, -1):
            z = (e[:, i + 1] * b[:, i + 1]) @ T.T
            b[:, i] = np.where(mask[:, i + 1, None], z / z.sum(1, keepdims=True), 0.5)
        p = a * b
        p /= p.sum(2, keepdims=True)
        gap = np.where(mask, y[:, None] - p[:, :, 1], 0) * weights[:, None]
        gw = np.einsum("ns,nsd->d", gap.astype(np.float32), x).astype(float)
        two = a[:, :-1, :, None] * T[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        two /= two.sum((2, 3), keepdims=True)
        seen = np.zeros((2, 2))
        k = inside.sum(1) * weights
        seen[0, 0], seen[1, 1] = k[y == 0].sum(), k[y == 1].sum()
        gt = seen - (two * (inside * weights[:, None])[:, :, None, None]).sum((0, 1))
        g = np.r_[gw, gt.ravel()] / n - ridge * np.r_[w, t.ravel()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, t = w + step[:d], t + step[d:].reshape(2, 2)
    return w, t


def train(docs: DataFrame, labels: DataFrame, usable, max_per_label: int = MAX_TRAIN_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and transition scores, or None if there is no row to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [chain_features(t.as_py() or b"")[0].tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "label"])

    got = labelled_sample(docs, labels, label_col, usable, max_per_label, id_col, text_col).mapInArrow(run, "x binary, label int").toArrow()
    if got.num_rows == 0:
        return None
    chains, y, weights = [], [], []
    tags = got.column("label").to_pylist()
    per_label = [tags.count(0), tags.count(1)]
    for x, label in sorted(zip(got.column("x").to_pylist(), tags)):
        f = np.frombuffer(x, np.float32).reshape(-1, 3 * N_FEATURES)
        for i in range(0, len(f), CHAIN):
            chains.append(f[i : i + CHAIN])
            y.append(label)
            weights.append(1 / (len(f) * max(1, per_label[label]) / len(tags)))
    weights = np.array(weights)
    return fit(chains, np.array(y), weights / weights.mean())


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, lines, bad_lines): one narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model if model else (np.zeros(3 * N_FEATURES), np.zeros((2, 2)))
        factors = tuple(np.exp(t).ravel().tolist())
        for batch in batches:
            score, lines, bad = [], [], []
            for text in batch.column(1):
                x, size = chain_features(text.as_py() or b"")
                p = np.array(marginals((x @ w).tolist(), factors))
                score.append(float(min(1.0, max(0.0, (p * size).sum() / size.sum()))))
                lines.append(len(p))
                bad.append(int((p < 0.5).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(lines, pa.int64()), pa.array(bad, pa.int64())], names=["doc_id", "score", "lines", "bad_lines"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, lines long, bad_lines long")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("__id", 5) != 0)
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "bad_lines"
    )


QUERIES = {"op6_quality": op6_quality}
