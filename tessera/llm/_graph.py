"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, contracted: each node with the least node it is linked to there."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = np.fromiter(up.keys(), np.int64, len(up))
    roots = np.fromiter((find(x) for x in list(up)), np.int64, len(up))
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(roots[i : i + 50_000])], names=["u", "v"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of an edge: root is the least node reachable.

    ``edges`` is contracted task by task, then large-star and small-star steps alternate until nothing changes. Every step
    takes minima with map-side combining and joins them back, so no neighbourhood is gathered in one place.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_forest, "u long, v long").distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
