"""Operator 5, language ID: each document as a mixture of languages.

A language is a distribution over hashed byte trigrams around letters. Expectation-maximisation estimates a document's language proportions; the set of
languages is the one with the best likelihood less ``penalty * (languages - 1) * ln(trigrams) / 2``, found by dropping the language with the least share as long as that helps.
The prediction is the language with the largest share, and the score is that share.

Defined results: a null text, or one without a letter (Unicode categories L*), is ``und`` with score 0, as is any text when nothing could be learned; ties go to the first
language by name; equal rows each give a row; an empty table gives an empty result; texts of any length are read whole; bytes that aren't UTF-8 count as the replacement character where
letters are looked for, and as they are in trigrams; extra columns, whatever their names, play no part (and stay in ``keep_known_language``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod, id_text, keep_rows

BUCKETS = 1 << 15
#: Profiles are fitted on about so many labelled documents of each language, chosen by hash of the id; on all of a language that has fewer.
MAX_TRAIN_PER_LANGUAGE = 5000
#: Overlapping trigrams count a character three times.
PENALTY = 3.0
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often."""
    a = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    x = a.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    n = np.bincount(h[_LETTERS[a[1:-1]]], minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def mixture(counts: np.ndarray, probs: np.ndarray, rounds: int = 30, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of ``probs``) by expectation-maximisation, and the log-likelihood."""
    share = np.full(len(probs), 1 / len(probs))
    total = counts.sum()
    for _ in range(rounds):
        mix = share @ probs
        new = share * (probs @ (counts / mix)) / total
        done = np.abs(new - share).max() < tol
        share = new
        if done:
            break
    return share, float(counts @ np.log(share @ probs))


def classify(text: bytes, probs: np.ndarray, penalty: float = PENALTY) -> tuple[int, float]:
    """Index of the language with the largest share, and that share."""
    at, counts = trigram_counts(text)
    if len(at) == 0:
        return -1, 0.0
    counts = counts.astype(float)
    p = probs[:, at]
    alone = np.log(p) @ counts
    best = int(alone.argmax())
    if len(p) == 1:
        return best, 1.0
    cost = penalty * np.log(max(counts.sum(), 2)) / 2
    langs = np.arange(len(p))
    share, ll = mixture(counts, p)
    if ll - cost <= alone[best]:  # no larger set can beat the one language
        return best, 1.0
    value = ll - cost * (len(langs) - 1)
    while len(langs) > 1:
        keep = np.delete(langs, share.argmin())
        s, ll = mixture(counts, p[keep]) if len(keep) > 1 else (np.ones(1), alone[keep[0]])
        if ll - cost * (len(keep) - 1) < value:
            break
        langs, share, value = keep, s, ll - cost * (len(keep) - 1)
    if alone[best] >= value:
        return best, 1.0
    k = int(share.argmax())
    return int(langs[k]), float(min(1.0, share[k]))


def train_profiles(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Language names and their (languages x BUCKETS) trigram probabilities, from about ``max_docs`` of the ``usable`` rows of each language: no language is lost, however rare."""
    rows = docs.where(usable & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).alias("draw")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    below = docs.sparkSession.createDataFrame([(r["lang"], (1 << 20) if r["n"] <= max_docs else int((1 << 20) * max_docs / r["n"]) + 1) for r in sizes], "lang string, below long")
    part = rows.join(F.broadcast(below), "lang").where("draw < below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, k = trigram_counts(text.as_py() or b"")
                found.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += k
        for lang, k in found.items():
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(k[at])], names=["lang", "bucket", "n"])

    counts = (
        part.select("lang", "text")
        .mapInArrow(run, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most BUCKETS rows a language
    )
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(names), BUCKETS))
    at = {name: i for i, name in enumerate(names)}
    table[[at[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table += 0.5
    return names, table / table.sum(1, keepdims=True)


def predict_language(docs: DataFrame, names: list[str], probs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score): one narrow pass over whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(probs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            lang, score = [], []
            for t in batch.column(1):
                text = t.as_py() or b""
                k, s = classify(text, p, penalty) if names and LETTER.search(text.decode(errors="replace")) else (-1, 0.0)
                lang.append(names[k] if k >= 0 else UNKNOWN)
                score.append(s if k >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known_language(docs: DataFrame, names: list[str], probs: np.ndarray, min_share: float = 0.35, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are ``und`` or in which no language has ``min_share``; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(probs)

    def make():
        p = model.value

        def test(text: bytes) -> bool:
            return bool(names) and LETTER.search(text.decode(errors="replace")) is not None and classify(text, p)[1] >= min_share

        return test

    return keep_rows(docs, text_col, make)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, probs = train_profiles(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)))
    return predict_language(docs, names, probs).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
