"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text as bytes, label) of about ``max_per_label`` documents of each of the two labels, chosen by hash of the id.

    Never more than twice that, so the chosen ids are broadcast and the texts stay where they are. Null labels and ids are passed over;
    of labels that repeat an id, one counts.
    """
    have = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__id").isNotNull() & F.col("__label").isNotNull())
    have = have.where(usable)
    counts = {r["__label"]: r["n"] for r in have.where(F.col("__label").isin(0, 1)).groupBy("__label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        below = int((1 << 20) * min(1.0, max_per_label / max(counts.get(label, 0), 1))) + 1
        part = have.where((F.col("__label") == label) & (F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < below)).limit(2 * max_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("__id").agg(F.min("__label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "label")
