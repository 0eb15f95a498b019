"""Streaming forms: a fitted model's side is static, so stateless operators run as they are; sessions and counts keep bounded state under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def token_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("r"), F.explode(T.words(text_col)).alias("token"))


def session_stream(log: DataFrame, gap: str, lateness: str, user: str = "user", ts: str = "ts") -> DataFrame:
    """(user, first, last, n): a session ends after a gap longer than ``gap``; events later than ``lateness`` are dropped and state is freed."""
    w = F.session_window(F.col(ts), gap)
    return log.withWatermark(ts, lateness).groupBy(F.col(user), w).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).select(user, "first", "last", "n")


def windowed_counts(events: DataFrame, window: str, lateness: str, key: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window), F.col(key)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def score_stream(docs: DataFrame, features: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(r, token, label, part): each token's share of each label's score, for a downstream sum by document; ``features``: (token, idf, feat), ``weights``: (feat, label, w)."""
    toks = token_stream(docs, id_col, text_col)
    return toks.join(features, "token").join(weights, "feat").select("r", "token", "label", (F.col("idf") * F.col("w")).alias("part"))
