"""Queries on odd rows and on larger copies of the tables, against their SQL or plain numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's, on the given tables."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(folder)), duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted(map(str, rows))
    assert plain(map(tuple, got.select(*cols).collect())) == plain(duck.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["word_tokens", "char_tokens"])
def test_texts_without_a_token(spark, tmp_path, name):
    docs = spark.createDataFrame([(0, ""), (1, "  "), (2, None), (3, "one two"), (4, " ünï "), (5, "\U0001f600x")], "doc_id long, text string")
    against_sql(spark, tmp_path, name, documents=docs)


def test_types_without_a_word(spark, tmp_path):
    parts = spark.createDataFrame([(0, "abc", ""), (1, "", "A B "), (2, "name", "A B")], "p_partkey long, p_name string, p_type string")
    against_sql(spark, tmp_path, "prefixes_suffixes", part=parts)


@pytest.mark.parametrize("cells, full", [(4, 256), (50, 0)])
def test_tree_scores_in_blocks(spark, monkeypatch, cells, full):
    """Blocks of a few rows and children, products a few at a time, against plain products; a row repeats a feature, a child has no weights, a pair is asked twice."""
    from tessera.operators import tree

    for name, value in (("ROWS_AT_ONCE", 3), ("CHILDREN_AT_ONCE", 2), ("CELLS", cells), ("FULL_FEATURES", full)):
        monkeypatch.setattr(tree, name, value)
    rng = np.random.default_rng(3)
    n, parents, kids = 7, 3, 12
    x = rng.normal(size=(n, 6)) * (rng.random((n, 6)) < 0.5)
    w = [rng.normal(size=(parents, 7)), rng.normal(size=(kids, 7)) * (rng.random((kids, 7)) < 0.6)]  # the last: the bias
    w[1][4] = 0
    chain = spark.createDataFrame([(0, p, 0) for p in range(parents)] + [(1, c, c % parents) for c in range(kids)], "layer int, child long, parent long")
    weights = [(la, f if f < 6 else -1, i, float(v)) for la in (0, 1) for (i, f), v in np.ndenumerate(w[la]) if v]
    m = tree.TreeModel(chain, spark.createDataFrame(weights, "layer int, feat long, label long, w double"), tree.TreeParams(2, 4, "sigmoid", 0.5))
    cells_ = [(r, f, float(v)) for (r, f), v in np.ndenumerate(x) if v] + [(r, 0, 0.0) for r in range(n)] + [(0, 3, 0.25)]
    x[0, 3] += 0.25
    xt = spark.createDataFrame(cells_, "r long, c long, v double")
    p0, p1 = (1 / (1 + np.exp(-(x @ v[:, :6].T + 0.5 * v[:, 6]))) for v in w)
    both = p1 * p0[:, np.arange(kids) % parents]
    want = set()
    for r in range(n):
        beam = np.argsort(-p0[r])[:2]
        found = sorted((-both[r, c], c) for c in range(kids) if c % parents in beam)[:4]
        want |= {(r, c, rank, round(-v, 9)) for rank, (v, c) in enumerate(found, 1)}
    assert {(a["r"], a["c"], a["rank"], round(a["v"], 9)) for a in tree.predict(m, xt).collect()} == want
    pairs = [(r, c) for r in range(n) for c in range(kids) if (r + c) % 3 == 0]
    got = tree.predict_selected(m, xt, spark.createDataFrame([*pairs, pairs[0], (99, 0), (0, 99)], "r long, c long"))
    got = sorted((a["r"], a["c"], round(a["v"], 9)) for a in got.collect() if a["r"] < 99)
    assert got == sorted((r, c, round(both[r, c], 9)) for r, c in pairs)


@pytest.mark.parametrize("d", [8, 64])
def test_neighbours_that_lie_together(spark, d):
    """Vectors in tight groups have their collisions together; none of a query's groups may be missed for that."""
    from tessera.llm import neighbours

    rng = np.random.default_rng(0)
    n, k = 6000, 20
    x = rng.standard_normal((50, d))[rng.integers(0, 50, n)] + 0.001 * rng.standard_normal((n, d))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k, rows_per_block=1500).toPandas()
    recall = []
    for i, mine in got.groupby("query_id"):
        s = x @ x[i]
        s[i] = -np.inf
        recall.append((mine.score >= np.sort(s)[-k] - 1e-9).mean())
    assert len(recall) == 60 and np.mean(recall) >= 0.98 and min(recall) >= 0.8


@pytest.mark.parametrize("name", ["matrix_sum", "ensemble_rank_average", "ensemble_softmax_average"])
def test_groups_are_spread_by_the_size_of_the_tables(spark, sf, monkeypatch, name):
    """As many partitions as the tables are large, however well they are compressed."""
    from tessera.operators import matrix

    monkeypatch.setattr(matrix, "BYTES_AT_ONCE", 10_000)
    plan = catalog.QUERIES[name](spark, sf)
    assert plan.rdd.getNumPartitions() >= 10


@pytest.mark.parametrize("name", ["term_frequency", "document_frequency", "tfidf", "tfidf_bigrams", "tfidf_word_regex", "char_in_word_ngrams"])
def test_texts_whose_ids_repeat(spark, tmp_path, name):
    """A document in several rows is one; empty texts and null have no n-gram."""
    texts = ["a b a bb", "bb cc a", "", "a", None, "  cc bb  cc ", "a b", "ünï cc"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    against_sql(spark, tmp_path, name, documents=docs)


@pytest.mark.parametrize("name", ["term_frequency", "tfidf_hashing", "tfidf_word_regex"])
def test_counts_and_norms_need_no_shuffle_of_n_grams(spark, sf, name):
    """Nothing but counts of few columns is exchanged by document."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(r#" in line and ("g#" in line or name != "term_frequency")]


def test_pairwise_neighbours_in_blocks(spark):
    """A label's queries and items in several blocks, equal vectors in many of them."""
    from tessera.operators import knn

    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    x[20:40] = x[3]
    label = np.arange(60) % 2
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vec array<double>")
    rows = spark.createDataFrame([(int(c), i) for i, c in enumerate(label)], "label long, i long")
    asked = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(0, 60, 7)], "q long, label long, vec array<double>")
    for metric in ("ip", "l2"):
        dist = 1 - x @ x.T if metric == "ip" else ((x[:, None] - x[None]) ** 2).sum(2)
        want = {(q, q % 3, i, r) for q in range(0, 60, 7) for r, (_, i) in enumerate(sorted((round(dist[q, i], 9), i) for i in range(60) if label[i] == q % 3)[:5], 1)}
        got = knn.pairwise_knn(asked, rows, items, 5, metric, q_block=2, i_block=9)
        assert {(a["q"], a["label"], a["i"], a["rank"]) for a in got.collect()} == want
