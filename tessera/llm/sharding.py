"""Operator 7, sharding: near-equal bytes for indivisible groups by Karmarkar-Karp differencing.

Groups of equal texts are bucketed by hash. Within a bucket, differencing turns its groups into one partial partition (a tuple of
``n_shards`` sums); the buckets' partial partitions, a few numbers each, are then combined by the same differencing, so the whole
is one differencing tree whose lower part runs in parallel. Slots come from counts by (shard, block of ids) and a rank within each.

Defined results: null text has size ``overhead`` and is grouped with the empty text; equal rows are kept, each with its own slot;
an empty table gives an empty result; ties are broken by the group's key; texts of any length, of whatever bytes, only count by their size and hashes; extra columns, whatever
their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import join_by_class, materialize
from ._kk import kk_partition, kk_states

GROUPS_PER_BUCKET = 20_000
ROWS_PER_BLOCK = 20_000
#: About so many groups, chosen by hash, are kept back from the buckets and level the whole at the end, where there is more than one bucket.
RESERVE = 5000
#: The second level handles so many partial partitions at once.
FAN_IN = 4096


def _bucket_partition(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        part, sums = kk_partition(pdf["bytes"].to_numpy(), n_shards)
        return pd.DataFrame({"key": pdf["key"], "rows": pdf["rows"], "bucket": pdf["bucket"], "bytes": pdf["bytes"], "part": part.astype("int32")})

    return run


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): rows with equal texts share a shard, shards are near-equal in bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    n_buckets = max(1, -(-total // GROUPS_PER_BUCKET))
    spare = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, total // RESERVE))) == 0 if n_buckets > 1 else F.lit(False)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).withColumn("bucket", F.when(~spare, F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int")))
    groups = materialize(groups, "shard-groups")
    reserve = groups.where("bucket is null")
    parts = materialize(
        groups.where("bucket is not null").groupBy("bucket").applyInPandas(_bucket_partition(n_shards), "key binary, rows long, bucket int, bytes long, part int"),
        "shard-parts",
    )
    # the buckets' partial partitions: n_shards numbers for 20,000 groups
    sums = parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    placed = materialize(_combine(sums, n_shards), "shard-slots")
    last = placed.groupBy("slot").agg(F.sum("bytes").alias("bytes")).select(F.lit(None).cast("binary").alias("key"), "slot", "bytes")
    last = last.unionByName(reserve.select("key", F.lit(None).cast("int").alias("slot"), "bytes"))
    last = materialize(last.groupBy((F.col("bytes") * 0).alias("all")).applyInPandas(_level_with_reserve(n_shards), "key binary, slot int, shard int"), "shard-last")
    placed = placed.join(F.broadcast(last.where("slot is not null").select("slot", "shard")), "slot")  # n_shards rows
    classes = parts.join(placed.select("bucket", "part", "shard"), ["bucket", "part"]).select("key", "rows", "shard")
    classes = classes.unionByName(reserve.select("key", "rows").join(last.where("key is not null").select("key", "shard"), "key").select("key", "rows", "shard"))
    put = join_by_class(rows, classes, "key", "rows", total).select("row", "doc_id", "size", "text_crc32", "shard")
    n_blocks = max(1, -(-total // ROWS_PER_BLOCK))
    put = materialize(put.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")), "shard-put")
    return _slots(put).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _level_with_reserve(n_shards: int):
    """One differencing over the buckets' merged partition (rows with a slot) and the reserve (rows with a key)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["slot"].notna()]
        spare = pdf[pdf["slot"].isna()].sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sums = np.zeros(n_shards, np.int64)
        sums[whole["slot"].astype(int)] = whole["bytes"]
        _, slots = kk_states([sums, *(np.array([b]) for b in spare["bytes"])], n_shards)
        shard = [int(slots[0][s]) for s in whole["slot"].astype(int)] + [int(s[0]) for s in slots[1:]]
        return pd.DataFrame({"key": [None] * len(whole) + list(spare["key"]), "slot": pd.array([*whole["slot"].astype(int), *[None] * len(spare)], dtype="Int32"), "shard": np.array(shard, np.int32)})

    return run


def _combine(sums: DataFrame, n_shards: int) -> DataFrame:
    """(bucket, part, bytes, slot): differencing over the buckets' partial partitions, ``FAN_IN`` of them to a task, level by level."""
    level = sums.select(F.col("bucket"), F.col("part"), "bytes", F.col("bucket").alias("node"), F.col("part").alias("slot"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.groupby(["node", "slot"])["bytes"].sum().unstack(fill_value=0).reindex(columns=range(n_shards), fill_value=0).sort_index()
        _, slots = kk_states(list(wide.to_numpy(np.int64)), n_shards)
        at = {node: s for node, s in zip(wide.index, slots)}
        pdf["slot"] = np.fromiter((at[n][s] for n, s in zip(pdf["node"], pdf["slot"])), np.int32, len(pdf))
        pdf["node"] = pdf["node"] // FAN_IN
        return pdf

    top = sums.agg(F.max("bucket")).first()[0] or 0
    while True:
        level = level.groupBy((F.col("node") / FAN_IN).cast("int").alias("up")).applyInPandas(
            lambda pdf: run(pdf[["bucket", "part", "bytes", "node", "slot"]]), "bucket int, part int, bytes long, node int, slot int"
        )
        top //= FAN_IN
        if top == 0:
            break
    return level.select("bucket", "part", "bytes", "slot")


def _slots(put: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: the rows before the block, and the rank in the block."""
    counts = put.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    ranked = put.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "row")).cast("long") - 1)
    return ranked.join(before, ["shard", "block"]).withColumn("slot", F.col("before") + F.col("rank"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7_sharding}
