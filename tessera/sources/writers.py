"""Sinks: matrices, prediction lists, run files, query pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_coords(m: DataFrame, path: str) -> None:
    m.select("r", "c", "v").write.mode("overwrite").parquet(path)


def prediction_lists(pred: DataFrame, items: DataFrame) -> DataFrame:
    """(r, line): a JSON line for each row, items by rank, scores to five significant digits."""
    named = pred.join(items, "c").select("r", "rank", "item", F.format_string("%.5g", "v").cast("double").alias("score"))
    lists = named.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("rank", "item", "score"))).alias("g"))
    written = lambda x: F.to_json(F.array(x["item"]))  # noqa: E731  (["item"], every character escaped as JSON wants it)
    pair = F.transform("g", lambda x: F.concat(F.substr(written(x), F.lit(1), F.length(written(x)) - 1), F.lit(", "), x["score"].cast("string"), F.lit("]")))
    return lists.select("r", F.concat(F.lit('{"schema": ["output_item", "score"], "data": ['), F.array_join(pair, ", "), F.lit("]}")).alias("line"))


def write_predictions(pred: DataFrame, items: DataFrame, path: str) -> None:
    prediction_lists(pred, items).orderBy("r").select("line").write.mode("overwrite").text(path)


def run_lines(scores: DataFrame, tag: str = "run") -> DataFrame:
    """(inp_id, rank, line) of (inp_id, lbl_id, score): ``inp Q0 lbl rank score tag``, ranks from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("inp_id").orderBy(F.desc("score"), "lbl_id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.select("inp_id", "rank", F.concat_ws(" ", "inp_id", F.lit("Q0"), "lbl_id", "rank", "score", F.lit(tag)).alias("line"))


def write_run(scores: DataFrame, path: str, tag: str = "run") -> None:
    run_lines(scores, tag).orderBy("inp_id", "rank").select("line").write.mode("overwrite").text(path)


def write_query_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("prev_query", "prefix", "next_query").write.mode("overwrite").json(path)


def write_chain(chain: DataFrame, path: str) -> None:
    chain.select("layer", "child", "parent").write.mode("overwrite").partitionBy("layer").parquet(path)
