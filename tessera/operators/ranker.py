"""Training pairs and scores for a ranker over (inp_id, lbl_ids, scores) lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_targets(targets: DataFrame) -> DataFrame:
    """(inp_id, pos, lbl_id, score)."""
    return targets.select("inp_id", F.posexplode(F.arrays_zip(F.col("lbl_id").alias("l"), F.col("score").alias("s"))).alias("pos", "t")).select("inp_id", "pos", F.col("t.l").alias("lbl_id"), F.col("t.s").alias("score"))


def _draw(seed: int):
    return F.xxhash64("inp_id", "lbl_id", F.lit(seed))


def pairwise_sample(targets: DataFrame, seed: int = 0) -> DataFrame:
    """(inp_id, better, worse): one pair of unequal scores for each input that has one, drawn by seeded hash."""
    t = explode_targets(targets)
    w = Window.partitionBy("inp_id").orderBy(_draw(seed), "lbl_id")
    best = t.withColumn("least", F.min("score").over(Window.partitionBy("inp_id"))).where("score > least").withColumn("n", F.row_number().over(w)).where("n = 1")
    pos = best.select("inp_id", F.col("lbl_id").alias("better"), F.col("score").alias("s"))
    low = t.join(pos, "inp_id").where("score < s").withColumn("n", F.row_number().over(w)).where("n = 1")
    return low.select("inp_id", "better", F.col("lbl_id").alias("worse"), F.col("s").alias("better_score"), F.col("score").alias("worse_score"))


def listwise_sample(targets: DataFrame, group_size: int, seed: int = 0) -> DataFrame:
    """(inp_id, lbl_ids, scores): a label over the mean first, then ``group_size - 1`` of the others, drawn by seeded hash; inputs with too few go."""
    t = explode_targets(targets).withColumn("mean", F.avg("score").over(Window.partitionBy("inp_id")))
    w = Window.partitionBy("inp_id").orderBy(_draw(seed), "lbl_id")
    pos = t.where("score > mean").withColumn("n", F.row_number().over(w)).where("n = 1").select("inp_id", "lbl_id", "score", F.lit(0).alias("n"))
    neg = t.where("score <= mean").withColumn("n", F.row_number().over(w)).where(F.col("n") < group_size).select("inp_id", "lbl_id", "score", "n")
    both = pos.unionByName(neg.join(pos.select("inp_id"), "inp_id", "left_semi"))
    grouped = both.groupBy("inp_id").agg(F.sort_array(F.collect_list(F.struct("n", "lbl_id", "score"))).alias("g")).where(F.size("g") == group_size)
    return grouped.select("inp_id", F.col("g.lbl_id").alias("lbl_ids"), F.col("g.score").alias("scores"))


def mean_split(targets: DataFrame) -> DataFrame:
    """(inp_id, lbl_id, score, positive): positive where the score is over the input's mean."""
    t = explode_targets(targets)
    return t.select("inp_id", "lbl_id", "score", (F.col("score") > F.avg("score").over(Window.partitionBy("inp_id"))).alias("positive"))


def pad_labels(df: DataFrame, col: str, width: int, pad: int = -1) -> DataFrame:
    """Label arrays cut or padded to ``width``."""
    return df.withColumn(col, F.slice(F.concat(F.col(col), F.array_repeat(F.lit(pad).cast("long"), width)), 1, width))


def join_stores(pairs: DataFrame, inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query and document fields for (inp_id, lbl_id)."""
    return pairs.join(inputs, "inp_id").join(labels, "lbl_id")


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """(inp_id, lbl_id, score) by any scorer over batches of ``columns``."""

    @F.pandas_udf("double")
    def run(cols: pd.DataFrame) -> pd.Series:
        return scorer(cols).astype("float64")

    return pairs.select("inp_id", "lbl_id", run(F.struct(*columns)).alias("score"))
