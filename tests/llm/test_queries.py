"""The registered queries on a driver table: contracts, held-out accuracy, and the pipeline against its stages done by hand."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import packing, registry, secrets, simhash
from tests.llm.test_operators import brute_base, brute_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def tags(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas()


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_language_held_out_accuracy(spark, table):
    got = run(spark, "op5_language").merge(table, on="doc_id")
    assert len(got) == len(table) and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_quality_held_out_accuracy(spark, tags):
    got = run(spark, "op6_quality")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    out = got[got.held_out].merge(tags, on="doc_id")
    assert (out.predicted == out.quality).mean() > 0.95


def test_toxic_documents_are_caught(spark, tags):
    got = run(spark, "op9_toxicity").merge(tags, on="doc_id", suffixes=("_pred", ""))
    assert got[got.toxic == 1].toxic_pred.mean() > 0.85 and got[got.toxic == 0].toxic_pred.mean() < 0.01


def test_secrets_of_a_table(spark, table):
    got = run(spark, "op10_secrets").set_index("doc_id")
    for i, t in zip(table.doc_id, table.text):
        base = brute_base(t)
        assert got.loc[i, "base_sha256"] == secrets.sha256_hex(secrets.join_spans(base))


def test_pipeline_against_its_steps(spark, table):
    bench = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    fps = np.array([brute_fingerprint(t) for t in table.text], np.uint64)
    link = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    comp = np.arange(len(fps))
    while ((new := np.where(link, comp[None, :], 1 << 40).min(1)) != comp).any():
        comp = new
    keep = [i for i in range(len(fps)) if comp[i] == i]
    keep = [i for i in keep if not any(b in " ".join(table.text[i].lower().split()) for b in bench.values())]
    tok = packing.encoder(packing.VOCABULARY).tokenizer
    want = {int(table.doc_id[i]): len(tok.encode(secrets.redact(table.text[i]), add_special_tokens=False).ids) + 1 for i in keep}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want
    assert sum(r["length"] for r in rows) == sum(want.values())


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_unusual_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "the cat and the dog", "en", "s", 1), (2, "the cat and the dog", "en", "s", 1), (2, "the cat and the dog", "en", "s", 1), (3, "12 34", "en", "s", 1), (4, "le chat " * 30000, "fr", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    assert stage(spark, df, "/root/testdata/sf0.001").count() >= 1
    assert stage(spark, df.where("doc_id > 9"), "/root/testdata/sf0.001").count() == 0


def test_least_id_stays(spark):
    df = spark.createDataFrame([(9, "a b c d"), (3, "a b c d"), (None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [3]
