"""Operator 9, toxicity: cumulative-link ordinal regression on sparse word features.

A document's distinct words, and their 4- and 5-byte prefixes, are hashed features. P(grade > k) = sigmoid(w.x - threshold_k): the weights are shared by the ordered
thresholds, and the expected severity is the sum of these probabilities. The label is 0 or 1; its grades are made from something that the features, sets of words, can't see: how much
of a toxic text is toxic, by place. A text is cut into passages of ``PASSAGE`` words; the share of passages that hold a word strongly tied to the label gives grade 1 to 3, by terciles.

Defined results: a null or empty text has no feature and the severity of the thresholds alone; a model without rows of both labels gives severity 0;
equal rows each give a row; an empty table gives an empty result; texts of any length are scored whole, of whatever bytes; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text
from ._labelled import labelled_sample

#: The regression is fitted on about so many documents of each label (twice as many at most).
MAX_TRAIN_PER_LABEL = 4000
BUCKETS = 1 << 20
N_SELECTED = 4000
GRADES = 3
#: Words of a passage, for grades.
PASSAGE = 16
WORDS_KEPT = 400_000

#: Anything but letters parts words.
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(_TABLE).split())


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its prefixes where it is longer."""
    out = [zlib.crc32(b"=" + word) % BUCKETS]
    if len(word) > 4:
        out.append(zlib.crc32(b"^" + word[:4]) % BUCKETS)
    if len(word) > 5:
        out.append(zlib.crc32(b"^" + word[:5]) % BUCKETS)
    return tuple(out)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """weights: of the selected features, by hash; thresholds: ascending; cutoff: the score w.x from which a document counts as toxic."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray, cutoff: float):
        self.weights, self.thresholds, self.cutoff = weights, thresholds, cutoff
        self.known: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        s = self.known.get(w)
        if s is None:
            s = sum(self.weights.get(f, 0.0) for f in features_of(w))
            if len(self.known) >= WORDS_KEPT:
                self.known = {}
            self.known[w] = s
        return s

    def score(self, text: bytes) -> float:
        known = self.known
        words = words_of(text)
        try:
            parts = [known[w] for w in words]
        except KeyError:
            parts = [self.word(w) for w in words]
        return float(np.sum(np.sort(parts))) if parts else 0.0  # sorted: the sum is the same for any order of words

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """(documents x grades) P(grade > k)."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def best_cutoff(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap between scores among those that part toxic rows from others with the fewest errors."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], toxic[order]
    gain = np.cumsum(1 - 2 * y)[:-1]  # others under the cut, less toxic rows under it
    gap = np.diff(s)
    gain = np.where(gap > 0, gain, -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return 0.0
    at = np.flatnonzero(gain == gain.max())
    i = at[gap[at].argmax()]
    return float((s[i] + s[i + 1]) / 2)


def select(rows: list[np.ndarray], toxic: np.ndarray, n_selected: int = N_SELECTED) -> tuple[np.ndarray, np.ndarray]:
    """(features tied to the label either way, those strongly tied to toxic rows); ``rows``: feature hashes of each document."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    once = [np.unique(r) for r in rows]
    own, seen = np.repeat(toxic, [len(r) for r in once]), np.concatenate(once)
    df1 = np.bincount(seen, weights=own, minlength=BUCKETS)
    df0 = np.bincount(seen, weights=1 - own, minlength=BUCKETS)
    p1, p0 = (df1 + 0.5) / (n1 + 1), (df0 + 0.5) / (n0 + 1)
    # signed root of the likelihood ratio, which holds for rare features too
    share = (df1 + df0) / (n1 + n0)
    part = lambda o, n: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(n * share, 1e-9)), 0) + np.where(n > o, (n - o) * np.log(np.maximum(n - o, 1e-9) / np.maximum(n * (1 - share), 1e-9)), 0)
    z = np.sign(p1 - p0) * np.sqrt(np.maximum(0, 2 * (part(df1, n1) + part(df0, n0))))
    z[df1 + df0 < 3] = 0
    pick = np.sort(np.argsort(-np.abs(z), kind="stable")[:n_selected])
    pick = pick[np.abs(z[pick]) > 2.5]
    return pick, pick[np.log(p1 / p0)[pick] > 2]


def flagged_share(text: bytes, strong: set[int]) -> float:
    """Share of the text's passages that hold a word with a strong feature."""
    words = text.translate(_TABLE).split()
    tied = {w for w in set(words) if not strong.isdisjoint(features_of(w))}
    passages = range(0, len(words), PASSAGE)
    return sum(not tied.isdisjoint(words[i : i + PASSAGE]) for i in passages) / max(1, len(passages))


def make_grades(share: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, 1 to 3 for those that are, by terciles of their shares."""
    inside = share[toxic == 1]
    q = np.quantile(inside, [1 / 3, 2 / 3]) if len(inside) else np.zeros(2)
    return np.where(toxic == 1, 1 + (share > q[0]) + (share > q[1]), 0)


def loss(w: np.ndarray, t: np.ndarray, doc: np.ndarray, col: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(mean log-likelihood of the cumulative links less the ridge, its gradient over weights and thresholds)."""
    n = len(grades)
    y = (grades[:, None] > np.arange(len(t))[None, :]).astype(float)
    s = np.bincount(doc, weights=w[col], minlength=n)
    p = sigmoid(s[:, None] - t[None, :])
    value = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / n - ridge * (w @ w) / 2
    gap = y - p
    return float(value), np.r_[np.bincount(col, weights=gap.sum(1)[doc], minlength=len(w)) / n - ridge * w, -gap.mean(0)]


def fit(rows: list[np.ndarray], grades: np.ndarray, toxic: np.ndarray, pick: np.ndarray, rounds: int = 500, rate: float = 0.1, ridge: float = 2e-4) -> Model:
    """``rows``: feature hashes of each document, a hash as often as distinct words have it; ``grades``: 0 up; ``pick``: the features that count."""
    size = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    feat = np.concatenate(rows)
    at = np.full(BUCKETS, -1)
    at[pick] = np.arange(len(pick))
    use = at[feat] >= 0
    doc, col = doc[use], at[feat[use]]
    top = int(grades.max())
    w, t = np.zeros(len(pick)), np.linspace(1, 3, top)
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for r in range(1, rounds + 1):
        _, g = loss(w, t, doc, col, grades, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, t = w + step[: len(w)], np.maximum.accumulate(t + step[len(w) :])
    scores = np.bincount(doc, weights=w[col], minlength=len(rows))
    return Model({int(f): float(x) for f, x in zip(pick, w) if x}, t, best_cutoff(scores, toxic))


def train(docs: DataFrame, labels: DataFrame, usable=None, max_per_label: int = MAX_TRAIN_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model of a bounded sample, or None if it lacks a label; features are selected first, and then the shares of flagged passages give the grades."""
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if usable is None else usable, max_per_label, id_col, text_col)

    def rows_of(strong: set[int] | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t.as_py() or b"" for t in batch.column(0)]
                x = [np.array(sorted(f for w in words_of(t) for f in features_of(w)), np.int32).tobytes() for t in texts]
                share = [0.0 if strong is None else flagged_share(t, strong) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), pa.array(share, pa.float64())], names=["x", "label", "share"])

        got = sample.mapInArrow(run, "x binary, label int, share double").toArrow()
        rows = sorted(zip(got.column("x").to_pylist(), got.column("label").to_pylist(), got.column("share").to_pylist()))
        return [np.frombuffer(x, np.int32) for x, _, _ in rows], np.array([y for _, y, _ in rows], float), np.array([s for _, _, s in rows])

    rows, toxic, _ = rows_of(None)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    pick, strong = select(rows, toxic)
    rows, toxic, share = rows_of({int(f) for f in strong})
    return fit(rows, make_grades(share, toxic), toxic, pick)


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): expected severity, P(grade > 0), the number of thresholds more likely passed than not, and 1 from the model's cutoff on."""
    state = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.cutoff) if model else ({}, np.array([35.0]), np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*state.value)
        for batch in batches:
            scores = np.array([own.score(t.as_py() or b"") for t in batch.column(1)], float)
            p = own.exceed(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0].copy()), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array((scores >= own.cutoff).astype(np.int32))],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_toxicity": op9_toxicity}
