"""Sessions of a search log (user, ts, query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(log: DataFrame, gap_seconds: int, user: str = "user", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """``log`` with ``session`` (from 0 for each user): a new one starts when the gap is over ``gap_seconds``; an equal gap stays."""
    order = [ts] + ([tie] if tie else [])
    w = Window.partitionBy(user).orderBy(*order)
    secs = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.when(secs - F.lag(secs).over(w) > gap_seconds, 1).otherwise(0)
    return log.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def session_bounds(with_session: DataFrame, user: str = "user", ts: str = "ts") -> DataFrame:
    return with_session.groupBy(user, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def drop_repeats(with_session: DataFrame, query: str, user: str = "user", ts: str = "ts", tie: str | None = None, least: int = 2) -> DataFrame:
    """Queries equal to the one before them go; then sessions with fewer than ``least`` go."""
    order = [ts] + ([tie] if tie else [])
    w = Window.partitionBy(user, "session").orderBy(*order)
    kept = with_session.withColumn("__last", F.lag(query).over(w)).where(F.col("__last").isNull() | (F.col("__last") != F.col(query))).drop("__last")
    return kept.withColumn("__n", F.count("*").over(Window.partitionBy(user, "session"))).where(F.col("__n") >= least).drop("__n")


def consecutive_pairs(with_session: DataFrame, query: str, user: str = "user", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """(user, session, prev_query, next_query)."""
    order = [ts] + ([tie] if tie else [])
    w = Window.partitionBy(user, "session").orderBy(*order)
    nxt = with_session.withColumn("next_query", F.lead(query).over(w)).where("next_query is not null")
    return nxt.select(user, "session", F.col(query).alias("prev_query"), "next_query")


def split_by_time(df: DataFrame, ts: str, first: str, second: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train (before ``first``), validation (before ``second``) and test."""
    t = F.col(ts)
    a, b = F.lit(first).cast("timestamp"), F.lit(second).cast("timestamp")
    return df.where(t < a), df.where((t >= a) & (t < b)), df.where(t >= b)


def prefix_examples(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(prev_query, prefix, next_query): the prefix has 1 up to all characters, chosen by hash of the pair."""
    n = F.pmod(F.xxhash64("prev_query", "next_query", F.lit(seed)), F.greatest(F.length("next_query"), F.lit(1))) + 1
    return pairs.select("prev_query", F.col("next_query").substr(F.lit(1), n.cast("int")).alias("prefix"), "next_query")
