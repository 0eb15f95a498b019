"""Operator 1, SimHash near-dedup: fingerprints of word shingles, joined on pigeonhole blocks and verified by Hamming distance.

A fingerprint is cut into ``blocks`` parts. Two fingerprints with at most ``distance`` differing bits agree in ``blocks - distance`` of them, so
every choice of that many blocks is a key; pairs are verified, and kept for their first common key only. Rows with one fingerprint are one class: links are
found between classes, with row counts, and copies are never paired.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; equal rows each give a row and count as near to each other;
a null doc_id is a row like any other, but never a component's id unless it has no other; an empty table gives an empty result; texts of any length are read whole; bytes that aren't
UTF-8 are parts of words; extra columns, whatever their names, play no part (and stay in ``drop_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, join_by_class, materialize
from ._graph import components

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
#: Bits of every byte value, least first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BASE = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.r_[0, ends[:-1]][: n - shingle + 1].tolist()
    return np.array([h(line[i:j], seed) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits set in over half the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    seen = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BASE).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS).ravel()  # byte by byte, least first
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """Signed masks, one for each choice of ``blocks - distance`` blocks."""
    at = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(part[i] for i in c) for c in combinations(range(blocks), blocks - distance))]


def near_pairs(classes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n, fp2, n2), fp < fp2: pairs of distinct fingerprints at most ``distance`` bits apart; ``classes``: (fp, n), each fp once."""
    masks = _masks(blocks, distance)
    keys = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks))))
    keyed = classes.select("fp", "n", keys.alias("key")).select("fp", "n", F.col("key.c").alias("c"), F.col("key.k").alias("k"))
    other = keyed.select(F.col("fp").alias("fp2"), F.col("n").alias("n2"), "c", "k")
    x: Column = F.col("fp").bitwiseXOR(F.col("fp2"))
    first = F.lit(None).cast("int")
    for i in range(len(masks) - 1, -1, -1):
        first = F.when(x.bitwiseAND(F.lit(masks[i]).cast("long")) == 0, F.lit(i)).otherwise(first)
    return keyed.join(other, ["c", "k"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(x) <= distance) & (first == F.col("c"))).select("fp", "n", "fp2", "n2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, n_near, component_id), a row a document."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    total = rows.count()
    classes = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "classes")
    pairs = materialize(near_pairs(classes.select("fp", "n"), distance, blocks), "pairs")
    links = pairs.select("fp", F.col("n2").alias("m")).unionByName(pairs.select(F.col("fp2").alias("fp"), F.col("n").alias("m"))).groupBy("fp").agg(F.sum("m").alias("links"))
    roots = components(pairs, "fp", "fp2")
    linked = roots.withColumnRenamed("node", "fp").join(classes.select("fp", "first_id"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.select("fp", "root").join(least, "root").join(links, "fp").select("fp", "links", "component_id")
    info = classes.join(linked, "fp", "left").select(
        "fp", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return join_by_class(rows, info, "fp", "n", total).select("doc_id", "fp", "n_near", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, the one with the least id (null last); all columns stay.

    The rows are written with a number of their own first, each as one structure, so repeated and null ids are told apart and no column's name clashes with ours.
    """
    fields = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), fields.alias("doc")), "numbered")
    texts = rows.select("row", F.col("doc").getField(text_col).alias("text"))
    found = materialize(near_duplicates(texts, "row", "text").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    # rows of groups of two and more; the hot ones among these are pre-aggregated by min
    ids = rows.select("row", F.coalesce(F.col("doc").getField(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    best = found.join(ids, "row").groupBy("group").agg(F.min(F.struct("id", "row")).alias("b")).select(F.col("b.row").alias("row"))
    return rows.join(best, "row", "left_semi").select("doc.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


QUERIES = {"op1_simhash": op1_simhash}
