"""Evaluation of ranked predictions (r, c, v) against truth (r, c)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(truth: DataFrame, pred: DataFrame, n_rows: int, k: int = 10) -> DataFrame:
    """(k, precision, recall) for 1 to ``k``: the denominator of precision is always k, and both are averaged over all ``n_rows`` rows."""
    rank = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("v"), "c"))
    hits = pred.withColumn("rank", rank).where(F.col("rank") <= k).join(truth.select("r", "c").distinct(), ["r", "c"])
    size = truth.select("r", "c").distinct().groupBy("r").agg(F.count("*").alias("n"))
    per_rank = hits.join(size, "r").groupBy("rank").agg(F.count("*").alias("m"), F.sum(1 / F.col("n")).alias("s"))
    ks = pred.sparkSession.range(1, k + 1).select(F.col("id").alias("k"))
    return (
        ks.join(F.broadcast(per_rank), per_rank["rank"] <= ks["k"], "left")  # at most k rows
        .groupBy("k")
        .agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
        .select("k", (F.col("m") / (F.col("k") * n_rows)).alias("precision"), (F.col("s") / n_rows).alias("recall"))
    )


def reciprocal_rank(truth: DataFrame, ranked: DataFrame) -> DataFrame:
    """(r, rr) for each row of ``truth`` (r, c): 1 over the rank of the first hit in ``ranked`` (r, c, rank), else 0."""
    first = ranked.join(truth.select("r", "c").distinct(), ["r", "c"]).groupBy("r").agg(F.min("rank").alias("rank"))
    return truth.select("r").distinct().join(first, "r", "left").select("r", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def bleu(reference: str, candidate: str, order: int = 4) -> float:
    """Sentence BLEU of two token strings; counts of zero are smoothed to a small share."""
    ref, cand = reference.split(), candidate.split()
    if not cand or not ref:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        a = Counter(zip(*(ref[i:] for i in range(n))))
        b = Counter(zip(*(cand[i:] for i in range(n))))
        hit, total = sum((a & b).values()), max(1, sum(b.values()))
        logs += math.log((hit or 0.1) / total)
    brevity = 1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))
    return brevity * math.exp(logs / order)


def rank_weighted_bleu(pairs: DataFrame) -> DataFrame:
    """(r, bleu): over (r, rank, truth, candidate), BLEU weighted by 1/rank."""

    @F.pandas_udf("double")
    def score(truth: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([bleu(a or "", b or "") for a, b in zip(truth, candidate)], dtype="float64")

    scored = pairs.select("r", "rank", score("truth", "candidate").alias("b"))
    return scored.groupBy("r").agg((F.sum(F.col("b") / F.col("rank")) / F.sum(1 / F.col("rank"))).alias("bleu"))


def bucketed(df: DataFrame, key: Column, bounds: list[float], *values: str) -> DataFrame:
    """Mean and deviation of ``values`` by half-open bucket [lo, hi) of ``key``; keys outside all buckets go."""
    bucket = F.lit(None).cast("int")
    for i in range(len(bounds) - 1):
        bucket = F.when((key >= bounds[i]) & (key < bounds[i + 1]), i).otherwise(bucket)
    aggs = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))]
    return df.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), *aggs)


def variation_of_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: H(A|B) + H(B|A), in nats, of two clusterings (id, cluster) of the same elements."""
    both = a.select("id", F.col("cluster").alias("x")).join(b.select("id", F.col("cluster").alias("y")), "id")
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    nx, ny = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    joined = cells.join(nx, "x").join(ny, "y").crossJoin(F.broadcast(cells.agg(F.sum("n").alias("total"))))  # one row
    term = -(F.col("n") / F.col("total")) * (F.log(F.col("n") / F.col("nx")) + F.log(F.col("n") / F.col("ny")))
    return joined.agg(F.sum(term).alias("vi"))


def merge_pseudo_labels(pred: DataFrame, mapper: DataFrame, how: str = "max") -> DataFrame:
    """Labels that stand for an original one, ``mapper`` (c, original), are folded by ``max`` or ``mean``."""
    agg = {"max": F.max, "mean": F.avg}[how]
    return pred.join(mapper, "c").groupBy("r", F.col("original").alias("c")).agg(agg("v").alias("v"))
