"""Operators against results worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as T
from tessera.operators import calibrate, chains, ensembles, knn, labels, matrix, metrics, numbering, ranker, sessions, solvers, stores, tree
from tessera.plans import tfidf
from tessera.sources import readers, writers
from tessera.streaming import streams


def table(spark, dense):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v], "r long, c long, v double")


def dense(m, shape):
    out = np.zeros(shape)
    for x in m.select("r", "c", "v").collect():
        out[x["r"], x["c"]] = x["v"]
    return out


def test_matmul_and_inner_products(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((4, 6)) * (rng.random((4, 6)) < 0.6), rng.random((6, 5)) * (rng.random((6, 5)) < 0.6)
    assert np.allclose(dense(matrix.matmul(table(spark, x), table(spark, y)), (4, 5)), x @ y)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "r long, c long")
    got = matrix.inner_products(table(spark, x), table(spark, y), pairs)
    assert got.count() == 4 and all(abs(r["v"] - (x @ y)[r["r"], r["c"]]) < 1e-12 for r in got.collect())


A = [[0.5, 0, 0, 1], [0, 0.2, 0, 0.5]]
B = [[1, 0, 0, 0.2], [0, 0, 0.2, 0]]


@pytest.mark.parametrize(
    "name,want",
    [
        ("average", [[0.75, 0, 0, 0.6], [0, 0.1, 0.1, 0.25]]),
        ("rank_average", [[1.5, 0, 0, 1.5], [0, 0.5, 1, 1]]),
        ("sigmoid_average", [[0.67675895, 0, 0, 0.64044629], [0, 0.274917, 0.274917, 0.31122967]]),
        ("round_robin", [[1.16666667, 0, 0, 1.33333333], [0, 0.83333333, 1.16666667, 1.33333333]]),
    ],
)
def test_ensembles(spark, name, want):
    assert np.allclose(dense(ensembles.ensemble(name, table(spark, A), table(spark, B)), (2, 4)), want, atol=1e-6)


def test_softmax_ensemble_of_sigmoids(spark):
    a, b = (m.withColumn("v", S.sigmoid(F.col("v"))) for m in (table(spark, A), table(spark, B)))
    assert np.allclose(dense(ensembles.softmax_average(a, b), (2, 4)), [[0.5090297, 0, 0, 0.4909703], [0, 0.24092582, 0.5, 0.25907418]], atol=1e-6)


def test_sorted_rows(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 2, 3.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 6.0)], "r long, c long, v double")
    got = [(x["v"], x["c"]) for x in matrix.topk_rows(m, 9).orderBy("r", "rank").collect()]
    assert got == [(2, 2), (1, 0), (3, 2), (6, 2), (5, 1), (4, 0)]
    assert [x["c"] for x in matrix.topk_rows(m.withColumn("v", F.lit(1.0)), 1).orderBy("r").collect()] == [0, 2, 0]


def test_stacks(spark):
    a, b = table(spark, A), table(spark, B)
    assert np.allclose(dense(matrix.vstack([a, b], [2, 2]), (4, 4)), np.vstack([A, B]))
    assert np.allclose(dense(matrix.hstack([a, b], [4, 4]), (2, 8)), np.hstack([A, B]))
    assert dense(matrix.block_diagonal([a, b], [(2, 4), (2, 4)]), (4, 8))[2:, 4:].tolist() == B
    assert np.allclose(dense(matrix.add(a, b), (2, 4)), np.array(A) + B)


CORPUS = ["bee cat river", "cat river river river", "ant"]


def vectors(spark, o):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = tfidf.Tfidf.fit(docs, o)
    names = {r["c"]: r["g"] for r in m.features.collect()}
    return [{names[r["c"]]: r["v"] for r in m.transform(docs).where(F.col("r") == i).collect()} for i in range(3)], names


def test_tfidf(spark):
    rows, names = vectors(spark, tfidf.Options(use_idf=False))
    assert [names[i] for i in range(4)] == ["ant", "bee", "cat", "river"]  # by document frequency, then token
    assert rows[0] == pytest.approx({"bee": 0.57735026, "cat": 0.57735026, "river": 0.57735026})
    assert rows[1] == pytest.approx({"cat": 0.31622776, "river": 0.94868326}) and rows[2] == {"ant": 1.0}
    rows, _ = vectors(spark, tfidf.Options(smooth_idf=False))
    assert rows[0] == pytest.approx({"bee": 0.88651040, "cat": 0.32718456, "river": 0.32718456}, abs=1e-6)
    rows, _ = vectors(spark, tfidf.Options(use_idf=False, ngram_range=(2, 2)))
    s = tfidf.SEP
    assert rows[0] == pytest.approx({f"bee{s}cat": 0.70710677, f"cat{s}river": 0.70710677})
    assert rows[1] == pytest.approx({f"cat{s}river": 0.44721360, f"river{s}river": 0.89442720}) and rows[2] == {}


def test_tfidf_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = tfidf.Tfidf.fit(docs)
    m.save(str(tmp_path))
    n = tfidf.Tfidf.load(spark, str(tmp_path))
    assert n.options == m.options and sorted(n.transform(docs).collect()) == sorted(m.transform(docs).collect())


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a  b\tc d e", "é 😀x"])
def test_tokens_and_ngrams(spark, text):
    w = [x for x in text.split(" ") if x]
    df = spark.createDataFrame([(text,)], "text string")
    r = df.select(T.words("text").alias("w"), T.chars("text").alias("c")).select("w", "c", T.ngrams("w", 1, 3).alias("g"), T.positioned_ngrams("w", 2, 2).alias("p")).first()
    assert r["w"] == w and r["c"] == list(text)
    assert r["g"] == [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    assert [(x["g"], x["i"]) for x in r["p"]] == [(w[i : i + 2], i) for i in range(len(w) - 1)]


def test_label_features(spark):
    y = [[1, 1, 0, 1, 0], [1, 1, 0, 1, 1], [0, 1, 1, 1, 1]]
    x, got = table(spark, np.eye(3)), None
    yt = table(spark, y)
    n = np.array(y, float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    want = n.T @ np.eye(3)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = dense(labels.embed("pifa", yt, x), (5, 3))
    assert np.allclose(got, want)
    binary = np.array(y, float).T
    assert np.allclose(dense(labels.embed("pii", yt), (5, 3)), binary / np.linalg.norm(binary, axis=1, keepdims=True))
    with pytest.raises(ValueError):
        labels.embed("other", yt)


CHAIN = [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), *((2, i, i // 2) for i in range(8))]


def test_chains(spark):
    chain = spark.createDataFrame(CHAIN, "layer int, child long, parent long")
    assert chains.check(chain).count() == 0 and chains.depth_of(chain) == 3
    codes = chains.layer_of(chain, 2)
    assert chains.equal(chains.complete(codes, 4, 2, 2), chain)
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 7, 1.0), (1, 2, 1.0)], "r long, c long, v double")
    got = {(r["layer"], r["r"], r["c"]): r["v"] for r in chains.matching_chain({3: m}, chain).collect()}
    assert got == {(2, 0, 0): 2, (2, 0, 3): 1, (2, 1, 1): 1, (1, 0, 0): 2, (1, 0, 1): 1, (1, 1, 0): 1, (0, 0, 0): 3, (0, 1, 0): 1}
    assert chains.depth_of(chains.shorten(chain, 2)) == 2 and chains.depth_of(chains.extend(chain, 5)) == 5


def test_balanced_split(spark):
    v = np.array([[1.0, 0.05], [1.0, -0.05], [0.05, 1.0], [-0.05, 1.0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    for spherical in (True, False):
        code = {r["child"]: r["parent"] for r in chains.balanced_kmeans(df, 3, seed=1, spherical=spherical).collect()}
        assert code[0] == code[1] != code[2] == code[3]
    assert {r["parent"] for r in chains.balanced_kmeans(df, 4).collect()} == {0}


@pytest.mark.parametrize("name", list(solvers.SOLVER_IDS))
def test_solvers_reach_the_optimum(name):
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(60, 4)), np.ones((60, 1))])
    y = np.where(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = rng.uniform(0.5, 2, 60)
    loss = {solvers.DUAL_L2: lambda m: np.maximum(0, 1 - m) ** 2, solvers.PRIMAL_L2: lambda m: np.maximum(0, 1 - m) ** 2, solvers.DUAL_L1: lambda m: np.maximum(0, 1 - m), solvers.LOGISTIC: lambda m: np.logaddexp(0, -m)}[name]
    value = lambda w: 0.5 * w @ w + (cost * loss(y * (x @ w))).sum()
    w = solvers.solve(name, x, y, cost, eps=1e-6, max_iter=1000)
    best = value(w)
    assert all(value(w + rng.normal(size=5) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
    twice = solvers.solve(name, np.vstack([x, x]), np.r_[y, y], np.r_[cost, cost], eps=1e-6, max_iter=1000)
    assert np.allclose(twice, solvers.solve(name, x, y, 2 * cost, eps=1e-6, max_iter=1000), atol=1e-3)  # cost 2 is the row twice


def test_machine_vectors_have_the_score_as_product():
    rng = np.random.default_rng(1)
    x1, x2 = rng.random((40, 5)), rng.random((40, 6))
    p = solvers.factorization_machine(x1, x2, np.where(x1[:, 0] > x2[:, 0], 1.0, -1.0))
    u, v = solvers.machine_vectors(x1, x2, p)
    assert np.allclose((u * v).sum(1), ((x1 @ p[0]) * (x2 @ p[1])).sum(1) + x1 @ p[2] + x2 @ p[3])


def test_platt_recovers_its_parameters(spark):
    rows = spark.createDataFrame([(float(t), 1 / (1 + math.exp(0.25 * t + 3.14))) for t in range(-15, 15)], "f double, t double")
    a, b = calibrate.fit_platt(rows, "f", "t", eps=1e-9, clip_target=False)
    assert abs(a - 0.25) < 1e-6 and abs(b - 3.14) < 1e-6


def test_post_processors(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 0.7, 1.0, 4.0)], "x double")
    f = {"noop": lambda x: x, "sigmoid": lambda x: 1 / (1 + math.exp(-x)), "log-sigmoid": lambda x: -math.log1p(math.exp(-x))}
    for p in range(1, 5):
        f[f"l{p}-hinge"] = lambda x, p=p: math.exp(-max(1 - x, 0) ** p)
        f[f"log-l{p}-hinge"] = lambda x, p=p: -max(1 - x, 0) ** p
    for n in S.PostProcessor.names():
        for r in df.select("x", S.PostProcessor.get(n).transform(F.col("x")).alias("y")).collect():
            assert r["y"] == pytest.approx(f[n](r["x"]))
    with pytest.raises(ValueError):
        S.PostProcessor.get("l-hinge")


def test_metrics(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (2, 5)], "r long, c long")
    pred = spark.createDataFrame([(0, 1, 0.9), (0, 3, 0.8), (0, 2, 0.7), (1, 1, 0.5)], "r long, c long, v double")
    got = {r["k"]: (r["precision"], r["recall"]) for r in metrics.precision_recall(truth, pred, 3, 4).collect()}
    assert got == {k: (pytest.approx(p), pytest.approx(q)) for k, p, q in ((1, 1 / 3, 0.5 / 3), (2, 1 / 6, 0.5 / 3), (3, 2 / 9, 1 / 3), (4, 2 / 12, 1 / 3))}
    rr = {r["r"]: r["rr"] for r in metrics.reciprocal_rank(truth, matrix.topk_rows(pred, 9)).collect()}
    assert rr == {0: 1.0, 2: 0.0}
    assert metrics.bleu("a b c d", "a b c d") == pytest.approx(1) and metrics.bleu("a b", "") == 0
    same = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, cluster long")
    assert metrics.variation_of_information(same, same).first()["vi"] == pytest.approx(0)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(128, 16))
    x[7] = x[9]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, vec array<double>")
    asked = items.where("i < 12").withColumnRenamed("i", "q")
    for metric, d in (("ip", 1 - x @ x.T), ("l2", ((x[:, None] - x[None]) ** 2).sum(2))):
        got = {}
        for r in knn.exact_knn(asked, items, 5, metric, q_block=4, i_block=40).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["i"])
        assert all(got[q] == np.lexsort((np.arange(128), np.round(d[q], 12)))[:5].tolist() for q in range(12))
    hits = {(r["q"], r["i"]) for r in knn.graph_knn(items, asked, 10, metric="l2").collect()}
    best = {(q, i) for q in range(12) for i in np.argsort(((x[q] - x) ** 2).sum(1), kind="stable")[:10]}
    assert len(hits & best) / 120 > 0.95
    coded = {(r["q"], r["i"]) for r in knn.ProductQuantizer.train(items, 4).search(asked, items, 10, 64).collect()}
    assert len(coded & best) / 120 > 0.9


def test_maps_and_stores(spark):
    pairs = spark.createDataFrame([("aaaa", 1, 0), ("aaaa", 2, 1), ("bbbb", 3, 0)], "key string, value long, at int")
    m = stores.build_map(stores.check_fixed_length(pairs), "at")
    keys = spark.createDataFrame([("aaaa",), ("none",)], "key string")
    assert {r["key"]: r["value"] for r in stores.lookup(keys, m, 10).collect()} == {"aaaa": 2, "none": 10}
    assert {r["key"]: r["found"] for r in stores.contains(keys, m).collect()} == {"aaaa": True, "none": False}
    for bad in ([("a", 1), ("bb", 2)], [("", 1)]):
        with pytest.raises(ValueError):
            stores.check_fixed_length(spark.createDataFrame(bad, "key string, value long"))


@pytest.mark.parametrize("how,want", [("replace", {"a": 1, "b": -5, "c": 3}), ("add", {"a": 1, "c": 3}), ("min", {}), ("max", {"a": 1, "b": 2, "c": 3})])
def test_keyed_merge_drops_what_is_not_positive(spark, how, want):
    a = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "row_key string, col_key string, v double")
    b = spark.createDataFrame([("b", "x", -5.0), ("c", "x", 3.0)], "row_key string, col_key string, v double")
    assert {r["row_key"]: r["v"] for r in stores.keyed_merge(a, b, how).collect()} == want


def test_suggestions_back_off_and_top_up(spark):
    counts = spark.createDataFrame([("apple", 5), ("apply", 7), ("ape", 9), ("bat", 20)], "name string, freq long")
    ask = spark.createDataFrame([(1, "appl"), (2, "apx"), (3, "zz")], "q long, prefix string")
    got = {}
    for r in stores.suggestions(counts, ask, 3).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["name"])
    assert got == {1: ["apply", "apple", "ape"], 2: ["ape", "apply", "apple"], 3: ["bat", "ape", "apply"]}
    only = {r["q"] for r in stores.suggestions(counts, ask, 3, top_up=False).where("name = 'ape'").collect()}
    assert only == {2, 3}


def test_sessions_keep_an_equal_gap(spark):
    rows = [("u", "2024-01-01 00:00:00", "a"), ("u", "2024-01-01 00:30:00", "a"), ("u", "2024-01-01 01:00:01", "b"), ("u", "2024-01-01 01:00:02", "c"), ("v", "2024-01-01 00:00:00", "z")]
    log = spark.createDataFrame(rows, "user string, ts string, query string").withColumn("ts", F.col("ts").cast("timestamp"))
    s = sessions.sessions(log, 1800)
    assert [r["session"] for r in s.where("user = 'u'").orderBy("ts").collect()] == [0, 0, 1, 1]
    assert [(r["prev_query"], r["next_query"]) for r in sessions.consecutive_pairs(sessions.drop_repeats(s, "query"), "query").collect()] == [("b", "c")]
    assert all(r["next_query"].startswith(r["prefix"]) and r["prefix"] for r in sessions.prefix_examples(sessions.consecutive_pairs(s, "query")).collect())


def test_ranker_samples(spark):
    t = spark.createDataFrame([(1, [1, 2, 3, 4], [0.9, 0.1, 0.2, 0.1]), (2, [5, 6], [0.5, 0.5])], "inp_id long, lbl_id array<long>, score array<double>")
    p = ranker.pairwise_sample(t).collect()
    assert len(p) == 1 and p[0]["better_score"] > p[0]["worse_score"]
    g = ranker.listwise_sample(t, 3).collect()
    assert [r["inp_id"] for r in g] == [1] and g[0]["lbl_ids"][0] == 1 and len(set(g[0]["lbl_ids"])) == 3
    assert ranker.score_pairs(ranker.explode_targets(t), lambda d: d["score"] + 1, ["score"]).agg(F.sum("score")).first()[0] == pytest.approx(2.3 + 6)


def test_numbering(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "é", "Z", "z", "")], "w string")
    assert [r["w"] for r in numbering.number_rows(df, ["w"], partitions=3).orderBy("id").collect()] == ["", "Z", "a", "b", "z", "é"]
    assert numbering.number_rows(df.where("w = 'no'"), ["w"]).count() == 0


def test_labelled_text(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("1:0.5:2,3::4\tfirst text\n2:1:1\tsecond\n")
    rows = readers.read_labelled_text(spark, str(p)).orderBy("line").collect()
    assert [(x["id"], x["val"], x["rel"]) for x in rows[0]["labels"]] == [(1, 0.5, 2.0), (3, 1.0, 4.0)] and rows[1]["text"] == "second"
    p.write_text("1,2\ta b\n7\tc\n")
    got = readers.label_matrix(readers.read_labelled_text(spark, str(p)))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1.0), (0, 2, 1.0), (1, 7, 1.0)]


def test_matrix_files(spark, tmp_path):
    d = np.array([[0, 2.0, 0], [1, 0, 3]])
    np.save(tmp_path / "d.npy", d)
    assert readers.import_matrix(spark, str(tmp_path / "d.npy")).count() == 6
    np.savez(tmp_path / "s.npz", format=b"csr", shape=(2, 3), data=[2.0, 1, 3], indices=[1, 0, 2], indptr=[0, 1, 3])
    np.savez(tmp_path / "c.npz", format=b"csc", shape=(2, 3), data=[1.0, 2, 3], indices=[1, 0, 1], indptr=[0, 1, 2, 3])
    np.savez(tmp_path / "o.npz", format=b"coo", shape=(2, 3), data=[1.0, 1, 1, 3], row=[0, 0, 1, 1], col=[1, 1, 0, 2])
    np.savez(tmp_path / "i.npz", format=b"dia", shape=(2, 3), data=[[1.0, 0, 0], [0, 2, 3]], offsets=[-1, 1])
    np.savez(tmp_path / "b.npz", format=b"bsr", shape=(2, 3), data=d[None], indices=[0], indptr=[0, 1])
    for n in "scoib":
        assert np.allclose(dense(readers.import_matrix(spark, str(tmp_path / f"{n}.npz")), (2, 3)), d), n
    m = table(spark, d)
    writers.write_coords(m, str(tmp_path / "m"))
    assert sorted(readers.read_coords(spark, str(tmp_path / "m")).collect()) == sorted(m.collect())


def test_prediction_sinks(spark, tmp_path):
    import json

    pred = spark.createDataFrame([(0, 1, 0.123456789, 1), (0, 2, 0.1, 2)], "r long, c long, v double, rank int")
    items = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "c long, item string")
    line = json.loads(writers.prediction_lists(pred, items).first()["line"])
    assert line == {"schema": ["output_item", "score"], "data": [['a "b"', 0.12346], ["c", 0.1]]}
    runs = [r["line"] for r in writers.run_lines(pred.selectExpr("r as inp_id", "c as lbl_id", "v as score")).orderBy("rank").collect()]
    assert runs[1] == "0 Q0 2 2 0.1 run"


def model(spark):
    chain = spark.createDataFrame(CHAIN, "layer int, child long, parent long")
    rng = np.random.default_rng(3)
    w = [(layer, f, n, float(rng.normal())) for layer, n, _ in CHAIN for f in range(-1, 5)]
    return tree.TreeModel(chain, spark.createDataFrame(w, "layer int, feat long, label long, w double"), tree.TreeParams(2, 3, "l3-hinge"))


def scores(df):
    return {(r["r"], r["c"]): round(r["v"], 10) for r in df.collect()}


def test_tree_identities(spark, tmp_path):
    m = model(spark)
    x = table(spark, np.random.default_rng(4).normal(size=(6, 5)))
    every = scores(tree.predict(m, x, beam_size=99, only_topk=99))
    pairs = spark.createDataFrame(list(every), "r long, c long")
    assert len(every) == 48 and scores(tree.predict_selected(m, x, pairs)) == every
    only = spark.createDataFrame([(1,), (6,)], "c long")
    assert scores(tree.predict(tree.constrain(m, only), x, beam_size=99, only_topk=99)) == {k: v for k, v in every.items() if k[1] in (1, 6)}
    top, _ = tree.split(m, 1)
    again = tree.reassemble(top, [(n, tree.subtree(m, 1, n)) for n in (0, 1)], 1)
    assert scores(tree.predict(again, x)) == scores(tree.predict(m, x)) == scores(tree.predict_ranker(m, x, tree.predict(m, x, 2)))
    m.save(str(tmp_path))
    assert scores(tree.predict(tree.TreeModel.load(spark, str(tmp_path)), x)) == scores(tree.predict(m, x))
    for post in S.PostProcessor.names():
        assert len(scores(tree.predict(m, x, post_processor=post))) == 18
    r = tree.subtree(m, 2, 3, reindex=True)
    assert [x["child"] for x in r.chain.orderBy("child").collect()] == [6, 7]


def test_candidates_without_shared_features_score_the_bias(spark):
    m = model(spark)
    x = spark.createDataFrame([(0, 77, 1.0)], "r long, c long, v double")
    w = {(r["layer"], r["label"]): r["w"] for r in m.weights.where("feat = -1").collect()}
    got = scores(tree.predict(m, x, 1, beam_size=9, post_processor="noop"))
    assert got == {(0, n): round(w[(0, n)], 10) for n in (0, 1)}


def test_training_separates_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 10)) * 3
    y = np.arange(80) % 8
    x = table(spark, centres[y] + rng.normal(size=(80, 10)) * 0.3)
    yt = spark.createDataFrame([(i, int(c), 1.0) for i, c in enumerate(y)], "r long, c long, v double")
    chain = spark.createDataFrame(CHAIN, "layer int, child long, parent long")
    for negatives, kw in (("tfn", {}), ("tfn+man", {"solver": "l2svc_primal"})):
        m = tree.train(x, yt, chain, negatives=negatives, params=tree.TreeParams(4, 1), threshold=0.0, **kw)
        assert sum(r["c"] == y[r["r"]] for r in tree.predict(m, x).collect()) >= 78
    two = tree.train_layer(x, tree.candidates(yt, chain, 2, chains.lift(yt, chain, 2)), yt.withColumn("v", F.lit(2.0)), threshold=0.0, eps=1e-4)
    cp = tree.train_layer(x, tree.candidates(yt, chain, 2, chains.lift(yt, chain, 2)), cp=2.0, threshold=0.0, eps=1e-4)
    key = lambda d: {(r["feat"], r["label"]): round(r["w"], 6) for r in d.collect()}
    assert key(two) == key(cp)


def test_streams_agree_with_batches(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2], "text": ["a b a", "c"]})
    src = tmp_path / "in"
    spark.createDataFrame(docs).write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = streams.token_stream(stream).writeStream.format("memory").queryName("tok").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tok").collect())) == [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
