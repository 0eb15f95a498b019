"""The corpus pipeline: documents -> language ID -> near-dedup -> decontamination -> secrets -> packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. A stage decides row by row or group by group over all that its predecessor kept:

- language: rows in no known language go;
- near_duplicates: one row of each group of near duplicates stays;
- decontaminate: rows that give away a benchmark item go;
- secrets: secrets are replaced in the text (and ``n_chars``, where there, counts again);
- packing: the kept texts as pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import crc_mod, materialize
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.langid import keep_known_language, train_profiles
from tessera.llm.packing import pack
from tessera.llm.secrets import redact_secrets
from tessera.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, probs = train_profiles(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)))
    return keep_known_language(docs, names, probs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL has no SimHash, tokenizer or model; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
