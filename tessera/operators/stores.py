"""Key-value and cell lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_map(pairs: DataFrame, order: str | None = None) -> DataFrame:
    """(key, value), one row a key: the last by ``order`` (or the largest value) wins."""
    if order is None:
        return pairs.groupBy("key").agg(F.max("value").alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", order).alias("value"))


def check_fixed_length(pairs: DataFrame, length: int | None = None) -> DataFrame:
    """The pairs; raises when a key is empty or the keys' byte lengths differ (or aren't ``length``)."""
    lo, hi = pairs.agg(F.min(F.octet_length("key")), F.max(F.octet_length("key"))).first()
    if lo is not None and (lo == 0 or lo != hi or length not in (None, lo)):
        raise ValueError("keys must have one length, not zero")
    return pairs


def lookup(keys: DataFrame, table: DataFrame, default: Column | int | None = None) -> DataFrame:
    """``keys`` with ``value`` of the map, ``default`` where there is none."""
    got = keys.join(table, "key", "left")
    return got if default is None else got.withColumn("value", F.coalesce("value", F.lit(default)))


def contains(keys: DataFrame, table: DataFrame) -> DataFrame:
    return keys.join(table.select("key", F.lit(True).alias("found")), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def store_from_dense(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, col, value) of every cell."""
    return df.select(F.col(id_col).cast("long").alias("row"), F.posexplode(vec_col).alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def submatrix(store: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(i, j, value): cells at ``rows`` (i, row) by ``cols`` (j, col); order and repeats are kept."""
    return store.join(rows, "row").join(cols, "col").select("i", "j", "value")


# matrices with string keys: (row_key, col_key, v)


def keyed_from(df: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """Zeros are dropped; repeated cells are summed."""
    return df.groupBy(F.col(row).alias("row_key"), F.col(col).alias("col_key")).agg(F.sum(F.col(val).cast("double")).alias("v")).where("v <> 0")


def keyed_select(m: DataFrame, rows: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    if rows is not None:
        m = m.where(F.col("row_key").isin(rows))
    return m if cols is None else m.where(F.col("col_key").isin(cols))


def keyed_merge(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``replace``: b's cells win; ``add``, ``max``: over both; ``min``: cells of both only. But for ``replace``, results not over zero are dropped."""
    x, y = a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y")
    both = x.join(y, ["row_key", "col_key"], "inner" if how == "min" else "full_outer")
    v = {
        "replace": F.coalesce("y", "x"),
        "add": F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)),
        "min": F.least("x", "y"),
        "max": F.greatest(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))),
    }[how]
    out = both.select("row_key", "col_key", v.alias("v"))
    return out if how == "replace" else out.where("v > 0")


def keyed_append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``b`` whose key ``a`` hasn't are added."""
    return a.unionByName(b.join(a.select("row_key").distinct(), "row_key", "left_anti").select("row_key", "col_key", "v"))


def merge_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, id): names of both, numbered anew in byte order."""
    from .numbering import number_rows

    return number_rows(a.select("name").unionByName(b.select("name")).distinct(), ["name"], "id")


# prefix suggestions


def suggestions(counts: DataFrame, queries: DataFrame, k: int, top_up: bool = True) -> DataFrame:
    """(q, name, rank): for each (q, prefix) the ``k`` most frequent of (name, freq) that start with the prefix.

    A shorter prefix is used where nothing matches, and, if ``top_up``, fills the list up to ``k``. Only the ``k`` best of any prefix are kept before the join.
    """
    spread = counts.select("name", "freq", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.col("name").substr(F.lit(1), n))).alias("p"))
    w = Window.partitionBy("p").orderBy(F.desc("freq"), "name")
    best = spread.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    ask = queries.select("q", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.col("prefix").substr(F.lit(1), n))).alias("p"))
    hits = ask.join(best, "p").withColumn("len", F.length("p"))
    if not top_up:
        hits = hits.withColumn("m", F.max("len").over(Window.partitionBy("q"))).where("len = m")
    hits = hits.groupBy("q", "name").agg(F.max("len").alias("len"), F.max("freq").alias("freq"))
    w = Window.partitionBy("q").orderBy(F.desc("len"), F.desc("freq"), "name")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "name", "rank")
