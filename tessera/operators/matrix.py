"""Sparse matrices as coordinate tables: columns ``r`` (row, long), ``c`` (column, long), ``v`` (value, double).

An absent entry is an implicit zero; a stored zero is an entry. Ties are broken by the smaller column (or row) id everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle

EPS = 1.1920929e-7


def coords(df: DataFrame, r: Column | str, c: Column | str, v: Column | str) -> DataFrame:
    """Duplicate coordinates are summed."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return sum_duplicates(df.select(as_col(r).cast("long").alias("r"), as_col(c).cast("long").alias("c"), as_col(v).cast("double").alias("v")))


#: Bytes of the tables that are read, for each partition that is grouped or sorted in one task.
BYTES_AT_ONCE = 8 << 20


def spread(m: DataFrame, *keys: str) -> DataFrame:
    """``m`` by hash of ``keys``, in as many partitions as the tables that it is read from are large: what a task groups or sorts doesn't grow with them.

    Left to themselves, partitions are joined by their compressed size, which says little of the memory that their rows take.
    """
    leaves = m._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = min(m.sparkSession.sparkContext.defaultParallelism, int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return m.repartition(max(least, min(20_000, -(-size // BYTES_AT_ONCE))), *keys)


def sum_duplicates(m: DataFrame) -> DataFrame:
    return spread(m, "r", "c").groupBy("r", "c").agg(F.sum("v").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def binarize(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.lit(1.0))


def dense_to_coords(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Every cell, zeros included."""
    return df.select(F.col(id_col).cast("long").alias("r"), F.posexplode(vec_col).alias("c", "v")).select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def dense_topk(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """The ``k`` cells of largest magnitude of each row; sorted inside the row, so nothing is shuffled."""
    cells = F.transform(vec_col, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.cast("long").alias("c"), x.cast("double").alias("v")))
    best = F.slice(F.array_sort(cells), 1, k)
    return df.select(F.col(id_col).cast("long").alias("r"), F.explode(best).alias("b")).select("r", "b.c", "b.v")


def select_entries(m: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Entries whose row is in ``rows`` (column r) and whose column is in ``cols`` (column c)."""
    if rows is not None:
        m = m.join(rows.select("r").distinct(), "r", "left_semi")
    return m if cols is None else m.join(cols.select("c").distinct(), "c", "left_semi").select("r", "c", "v")


def gather_rows(m: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows in the order of ``positions`` (pos, r); a row may come more than once."""
    return positions.select("pos", "r").join(m, "r").select(F.col("pos").alias("r"), "c", "v")


def rows_of_columns(m: DataFrame) -> DataFrame:
    """(c, rs): the sorted rows that each column has."""
    return m.groupBy("c").agg(F.sort_array(F.collect_list("r")).alias("rs"))


def columns_of_rows(m: DataFrame) -> DataFrame:
    return m.groupBy("r").agg(F.sort_array(F.collect_list("c")).alias("cs"))


def scale_rows(m: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights``: (r, w)."""
    return m.join(weights, "r").select("r", "c", (F.col("v") * F.col("w")).alias("v"))


def scale_columns(m: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights``: (c, w)."""
    return m.join(weights, "c").select("r", "c", (F.col("v") * F.col("w")).alias("v"))


def at_least(m: DataFrame, t: float) -> DataFrame:
    """Entries of magnitude ``t`` or more."""
    return m.where(F.abs("v") >= t)


def above(m: DataFrame, t: float) -> DataFrame:
    """Entries over ``t``; those equal to it go."""
    return m.where(F.col("v") > t)


def topk_rows(m: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest entries of each row, with their rank from 1."""
    w = Window.partitionBy("r").orderBy(F.desc("v"), "c")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_columns(m: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("c").orderBy(F.desc("v"), "r")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def strongest_weights(w: DataFrame, k: int, bias_row: int | None = None) -> DataFrame:
    """The ``k`` weights of largest magnitude of each column; the bias competes like any other and loses ties."""
    last = F.when(F.col("r") == F.lit(bias_row), 1).otherwise(0) if bias_row is not None else F.lit(0)
    win = Window.partitionBy("c").orderBy(F.desc(F.abs("v")), last, "r")
    return w.withColumn("k", F.row_number().over(win)).where(F.col("k") <= k).drop("k")


def normalize_rows(m: DataFrame, norm: str = "l2", eps: float = 0.0) -> DataFrame:
    """Rows over their l1, l2 or max norm; a row whose norm (for l2: its square) is not over ``eps`` stays as it is."""
    size = {"l1": F.sum(F.abs("v")), "l2": F.sum(F.col("v") * F.col("v")), "max": F.max(F.abs("v"))}[norm].over(Window.partitionBy("r"))
    root = F.sqrt("n") if norm == "l2" else F.col("n")
    return spread(m, "r").withColumn("n", size).select("r", "c", F.when(F.col("n") > eps, F.col("v") / root).otherwise(F.col("v")).alias("v"))


def softmax_rows(m: DataFrame, shifted: bool = True) -> DataFrame:
    """Softmax over the stored entries of each row."""
    w = Window.partitionBy("r")
    e = F.exp(F.col("v") - F.max("v").over(w)) if shifted else F.exp("v")
    m = spread(m, "r").withColumn("e", e)
    return m.select("r", "c", (F.col("e") / F.sum("e").over(w)).alias("v"))


def rank_relevance(m: DataFrame, longest: int | Column | None = None) -> DataFrame:
    """Value -> ``longest`` less the place (from 0) in its row; ``longest`` is the most entries any row has, unless given."""
    w = Window.partitionBy("r").orderBy(F.desc("v"), "c")
    placed = spread(m, "r").withColumn("p", F.row_number().over(w) - 1)
    if longest is None:
        most = m.groupBy("r").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("mm"))
        placed = placed.crossJoin(F.broadcast(most))  # one row
        longest = F.col("mm")
    else:
        longest = F.lit(longest) if isinstance(longest, int) else longest
    return placed.select("r", "c", (longest - F.col("p")).cast("double").alias("v"))


def matmul(x: DataFrame, w: DataFrame, drop_zeros: bool = False) -> DataFrame:
    """X W: an equi-join on the inner index and a sum; partial sums are made before the shuffle, and AQE splits hot inner ids."""
    pairs = x.select("r", F.col("c").alias("k"), F.col("v").alias("a")).join(w.select(F.col("r").alias("k"), "c", F.col("v").alias("b")), "k")
    out = pairs.groupBy("r", "c").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return out.where("v <> 0") if drop_zeros else out


def inner_products(x: DataFrame, w: DataFrame, pairs: DataFrame) -> DataFrame:
    """<row r of X, column c of W> for each of ``pairs`` (r, c), zero where they share nothing."""
    wanted = pairs.select("r", "c").distinct()
    hit = (
        wanted.join(x.select("r", F.col("c").alias("k"), F.col("v").alias("a")), "r")
        .join(w.select(F.col("r").alias("k"), "c", F.col("v").alias("b")), ["k", "c"])
        .groupBy("r", "c")
        .agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    )
    return pairs.join(hit, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def _shift(m: DataFrame, dr: int, dc: int) -> DataFrame:
    return m.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), "v")


def vstack(parts: list[DataFrame], heights: list[int]) -> DataFrame:
    at = [sum(heights[:i]) for i in range(len(parts))]
    return reduce(DataFrame.unionByName, [_shift(m, o, 0) for m, o in zip(parts, at)])


def hstack(parts: list[DataFrame], widths: list[int]) -> DataFrame:
    at = [sum(widths[:i]) for i in range(len(parts))]
    return reduce(DataFrame.unionByName, [_shift(m, 0, o) for m, o in zip(parts, at)])


def block_diagonal(parts: list[DataFrame], shapes: list[tuple[int, int]]) -> DataFrame:
    at = [(sum(h for h, _ in shapes[:i]), sum(w for _, w in shapes[:i])) for i in range(len(parts))]
    return reduce(DataFrame.unionByName, [_shift(m, dr, dc) for m, (dr, dc) in zip(parts, at)])


def add(*parts: DataFrame) -> DataFrame:
    return sum_duplicates(reduce(DataFrame.unionByName, parts))


def largest(*parts: DataFrame) -> DataFrame:
    """Elementwise largest of the stored entries."""
    return spread(reduce(DataFrame.unionByName, parts), "r", "c").groupBy("r", "c").agg(F.max("v").alias("v"))


def concat_features(sparse: DataFrame, dense: DataFrame, sparse_width: int, normalize_dense: bool = True) -> DataFrame:
    """Sparse columns, then the dense ones (rows at length one if asked)."""
    return hstack([sparse, normalize_rows(dense, "l2") if normalize_dense else dense], [sparse_width, 0])


def augment(kind: str, train: DataFrame, document: DataFrame, generated: DataFrame, n_train: int, n_document: int) -> DataFrame:
    """Stack of the parts that ``kind`` names, of ``trn``, ``doc`` and ``d2q``, joined by ``-``."""
    have = {"trn": (train, n_train), "doc": (document, n_document), "d2q": (generated, 0)}
    names = kind.split("-")
    return vstack([have[n][0] for n in names], [have[n][1] for n in names])


def without_pairs(m: DataFrame, known: DataFrame) -> DataFrame:
    return m.join(known.select("r", "c"), ["r", "c"], "left_anti")


def below_degree(m: DataFrame, most: int) -> DataFrame:
    """Edges of the nodes with fewer than ``most``."""
    return m.join(m.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") < most).select("r"), "r", "left_semi")


def degrees(m: DataFrame) -> DataFrame:
    return m.groupBy("r").agg(F.count("*").alias("degree"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("c").agg(F.sum("v").alias("total"))


def row_statistics(m: DataFrame) -> DataFrame:
    """One row: how many rows, and count, mean and deviation of their entries."""
    n = m.groupBy("r").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_entries"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"), F.min("n").alias("least"), F.max("n").alias("most"))


def spectral_scaling(m: DataFrame) -> DataFrame:
    """D1^-1/2 A D2^-1/2 of a non-negative bipartite matrix."""
    by_r, by_c = m.groupBy("r").agg(F.sum("v").alias("dr")), m.groupBy("c").agg(F.sum("v").alias("dc"))
    return m.join(by_r, "r").join(by_c, "c").where("dr > 0 and dc > 0").select("r", "c", (F.col("v") / F.sqrt(F.col("dr") * F.col("dc"))).alias("v"))


def spectral_embedding(m: DataFrame, dim: int, rounds: int = 8, seed: int = 0) -> DataFrame:
    """Co-cluster embedding (c, vec): right singular vectors of the scaled matrix, the first dropped, over the root of the column sums.

    Subspace iteration: products with the matrix are joins, and only ``dim + 1`` by ``dim + 1`` Gram matrices reach the driver.
    """
    import numpy as np

    a = settle(spectral_scaling(m), "scaled")
    k = dim + 1
    q = a.select("c").distinct().select("c", F.array(*(F.randn(seed + i) for i in range(k))).alias("q"))
    weigh = lambda src, key, out: src.groupBy(out).agg(F.array(*(F.sum(F.col("v") * F.col("q")[i]) for i in range(k))).alias("q"))

    def orthonormal(q: DataFrame) -> DataFrame:
        g = q.agg(*(F.sum(F.col("q")[i] * F.col("q")[j]) for i in range(k) for j in range(k))).first()
        vals, vecs = np.linalg.eigh(np.array(g, float).reshape(k, k))
        t = (vecs / np.sqrt(np.maximum(vals, 1e-12)))[:, ::-1]
        return q.withColumn("q", F.array(*(sum((F.col("q")[i] * float(t[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k))))

    for _ in range(rounds):
        q = settle(orthonormal(q), "basis")
        left = weigh(a.join(q, "c"), "c", "r")
        q = settle(weigh(a.join(left, "r"), "r", "c"), "basis")
    q = orthonormal(q)
    total = column_sums(m)
    return q.join(total, "c").select("c", F.transform(F.slice("q", 2, dim), lambda x: x / F.sqrt("total")).alias("vec"))
