"""Scans: matrices, labelled text, corpora, JSON lines, search logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = "r long, c long, v double"


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """A matrix written by ``write_coords``."""
    return spark.read.schema(COORDS).parquet(path)


def import_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A local ``.npy`` (all cells) or ``.npz`` (csr, csc, bsr, dia, coo) matrix file as coordinates; duplicates are summed."""
    r, c, v = load_matrix(path)
    import pyarrow as pa

    table = pa.table({"r": np.asarray(r, np.int64), "c": np.asarray(c, np.int64), "v": np.asarray(v, np.float64)})
    return spark.createDataFrame(table).groupBy("r", "c").agg(F.sum("v").alias("v")) if path.endswith(".npz") else spark.createDataFrame(table)


def load_matrix(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a matrix file."""
    if path.endswith(".npy"):
        x = np.atleast_2d(np.load(path))
        r, c = np.indices(x.shape)
        return r.ravel(), c.ravel(), x.ravel()
    with np.load(path) as z:
        kind = z["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        if kind == "coo":
            return z["row"], z["col"], z["data"]
        if kind in ("csr", "csc"):
            major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
            return (major, z["indices"], z["data"]) if kind == "csr" else (z["indices"], major, z["data"])
        if kind == "bsr":
            data = z["data"]
            br, bc = data.shape[1:]
            major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
            r = (major[:, None, None] * br + np.arange(br)[None, :, None]) + np.zeros((1, 1, bc), int)
            c = (z["indices"][:, None, None] * bc + np.arange(bc)[None, None, :]) + np.zeros((1, br, 1), int)
            return r.ravel(), c.ravel(), data.ravel()
        if kind == "dia":
            rows, cols = z["shape"]
            out = []
            for d, off in zip(z["data"], z["offsets"]):
                c = np.arange(max(0, off), min(cols, rows + off))
                out.append((c - off, c, d[c]))
            return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, int),) * 3
    raise ValueError(f"unknown matrix format: {kind}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): a line's number is the file's order."""
    from ..operators.numbering import number_rows

    lines = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return number_rows(lines, ["at"], "line").select("line", "text")


def parse_labelled(lines: DataFrame, sep: str = "\t", max_split: int = -1, label_pos: int = 0, text_pos: int = 1, with_relevance: bool | None = None) -> DataFrame:
    """(line, text, labels) of (line, text) rows; labels: array of (id, val, rel), written ``id`` or ``id:val:rel`` and comma-separated.

    ``with_relevance`` None: decided by the first line, for all. A missing value is 1.
    """
    parts = F.split("text", r"\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + r"\E", max_split + 1 if max_split > 0 else -1)
    raw = F.trim(F.element_at(parts, label_pos + 1))
    if with_relevance is None:
        first = lines.orderBy("line").select(raw).first()
        with_relevance = bool(first and first[0] and ":" in first[0])
    items = F.filter(F.split(raw, ","), lambda x: x != "")

    def one(tok):
        f = F.split(tok, ":")
        num = lambda i: F.when(F.coalesce(F.get(f, F.lit(i)), F.lit("")) == "", F.lit(1.0)).otherwise(F.get(f, F.lit(i)).cast("double"))
        if not with_relevance:
            return F.struct(F.get(f, F.lit(0)).cast("long").alias("id"), F.lit(1.0).alias("val"), F.lit(1.0).alias("rel"))
        return F.struct(F.get(f, F.lit(0)).cast("long").alias("id"), num(1).alias("val"), num(2).alias("rel"))

    return lines.select("line", F.element_at(parts, text_pos + 1).alias("text"), F.transform(items, one).alias("labels"))


def read_labelled_text(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_labelled(read_lines(spark, path), **kw)


def label_matrix(labelled: DataFrame, value: str = "val") -> DataFrame:
    """(r, c, v) of parsed labels; ``value``: ``val`` or ``rel``."""
    rows = labelled.select(F.col("line").alias("r"), F.explode("labels").alias("l"))
    return rows.groupBy("r", F.col("l.id").alias("c")).agg(F.sum(f"l.{value}").alias("v"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines are dropped; .gz files are read as they are."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    """(user, ts, query) of a tab-separated log with header AnonID, Query, QueryTime; queries cleaned, empty ones dropped."""
    from ..functions.text import clean_query

    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = raw.select(F.col("AnonID").alias("user"), F.col("QueryTime").cast("timestamp").alias("ts"), clean_query("Query").alias("query"))
    return out.where((F.col("query") != "") & F.col("ts").isNotNull())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Ranking records or stores: every Parquet file of a folder."""
    return spark.read.parquet(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def count_records(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def from_pandas(spark: SparkSession, pdf, row: str, col: str, val: str) -> DataFrame:
    from ..operators.stores import keyed_from

    return keyed_from(spark.createDataFrame(pdf[[row, col, val]]), row, col, val)
