"""Ensembles of prediction tables (r, c, v); a model that lacks a label counts as zero for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import sigmoid
from .matrix import add, largest, rank_relevance, softmax_rows


def _longest(parts: tuple[DataFrame, ...]) -> int:
    """Most entries that any row of any model has."""
    counts = [m.groupBy("r").agg(F.count("*").alias("n")) for m in parts]
    return reduce(DataFrame.unionByName, counts).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _mean(parts: list[DataFrame]) -> DataFrame:
    return add(*parts).withColumn("v", F.col("v") / len(parts))


def average(*parts: DataFrame) -> DataFrame:
    return _mean(list(parts))


def rank_average(*parts: DataFrame) -> DataFrame:
    mm = _longest(parts)
    return _mean([rank_relevance(m, mm) for m in parts])


def sigmoid_average(*parts: DataFrame) -> DataFrame:
    return _mean([m.withColumn("v", sigmoid(F.col("v"))) for m in parts])


def softmax_average(*parts: DataFrame) -> DataFrame:
    return _mean([softmax_rows(m) for m in parts])


def round_robin(*parts: DataFrame) -> DataFrame:
    """A label takes its best place in any model; on equal places the earlier model goes first, by a share of a rank."""
    mm, n = _longest(parts), len(parts)
    ranked = [rank_relevance(m, mm).withColumn("v", F.col("v") + (n - i) / (n + 1)) for i, m in enumerate(parts)]
    return largest(*ranked).withColumn("v", F.col("v") / n)


METHODS = {"average": average, "rank_average": rank_average, "sigmoid_average": sigmoid_average, "softmax_average": softmax_average, "round_robin": round_robin}


def ensemble(method: str, *parts: DataFrame) -> DataFrame:
    return METHODS[method](*parts)


def stored_order(m: DataFrame) -> DataFrame:
    """Entries with their rank from 1."""
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("v"), "c")))
