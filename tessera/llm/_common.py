"""Helpers shared by the text-pipeline operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one key may bring to a task of a join, whatever the size of the table.
HOT_ROWS = 1_000_000

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a folder of our own, in a session without other machines only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            break


atexit.register(_clean)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes); other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def map_columns(docs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``fn``, which keeps the columns; columns go by their place, whatever their names."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(fn, plain.schema).toDF(*docs.columns)


def keep_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[bytes], bool]]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) passes the test that ``make`` builds in each task. All columns stay; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([test(t.as_py() or b"") for t in texts], pa.bool_()))

    return map_columns(docs, run)


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def join_by_class(rows: DataFrame, classes: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``classes`` (one row a key; ``count``: how many rows have the key) without skew.

    A class with over ``HOT_ROWS`` rows, or over a thousandth of all rows, is hot. There are at most 1000 of the latter and one for each ``HOT_ROWS`` rows of the former, so they
    are broadcast. The others meet in a shuffled join in which no key has more than ``HOT_ROWS`` rows.
    """
    hot_if = F.col(count) > F.lit(max(1, min(total // 1000, HOT_ROWS)))
    hot = classes.where(hot_if)
    cold = classes.where(~hot_if)
    big = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    done = big.where(F.col("__hot")).drop("__hot")
    rest = big.where(F.col("__hot").isNull()).select(*rows.columns).join(cold, key)
    return done.unionByName(rest.select(*done.columns))
