"""Clusters that begin from given ones, labels with many rows, and text helpers, by hand-made results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chains, numbering, solvers, tree
from tessera.sources import readers, writers


def test_weights_are_summed_in_order(spark):
    df = spark.createDataFrame([(i, (7 * i) % 10, 1 + i % 3) for i in range(10)], "id long, k long, w long").repartition(3)
    got = sorted((r["k"], r["w"], r["at"]) for r in numbering.number_rows(df, ["k"], "at", 3, "w").collect())
    assert [a for *_, a in got] == [sum(w for _, w, _ in got[:i]) for i in range(10)]


def test_clusters_are_split_on_their_own(spark):
    rng = np.random.default_rng(2)
    sizes = [1, 3, 9, 20]
    rows = [(i, c, rng.normal(size=4).tolist()) for i, c in enumerate(np.repeat(range(4), sizes).tolist())]
    df = spark.createDataFrame(rows, "id long, node long, vec array<double>")
    codes = chains.pre_clustered_kmeans(df, df.select("id", "node"), max_leaf_size=4, max_iter=2).collect()
    leaf, of = {}, {i: c for i, c, _ in rows}
    for r in codes:
        assert r["cluster"] == of[r["child"]]
        leaf.setdefault(r["parent"], set()).add(r["child"])
    assert set(leaf) == set(range(len(leaf))) and all(len(m) <= 4 and len({of[x] for x in m}) == 1 for m in leaf.values())
    assert [sorted(len(m) for m in leaf.values() if of[next(iter(m))] == c) for c in range(4)] == [[1], [3], [2, 3, 4], [2, 2, 2, 2, 3, 3, 3, 3]]


def test_groups_weigh_as_many_as_they_have_members(spark):
    group = [0] * 6 + [1, 2, 3, 4, 5, 6]
    vec = [[1.0, 0.1 * g] for g in group]
    df = spark.createDataFrame(list(zip(range(12), group, vec)), "id long, group long, vec array<double>")
    codes = {r["child"]: r["parent"] for r in chains.must_link_kmeans(df.select("id", "vec"), df.select("id", "group"), max_leaf_size=6).collect()}
    leaves = [{i for i in codes if codes[i] == p} for p in set(codes.values())]
    assert sorted(map(len, leaves)) == [6, 6] and {*range(6)} in leaves


@pytest.mark.parametrize("solver", [solvers.DUAL_L2, solvers.PRIMAL_L2, solvers.LOGISTIC])
def test_labels_with_many_rows_reach_the_same_optimum(spark, solver):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(3)], "r long, c long, v double")
    rows = spark.createDataFrame([(i, 5, 1 if x[i, 0] + 0.5 * x[i, 1] > 0.1 else -1) for i in range(60)] + [(i, 6, 1 if i % 2 else -1) for i in range(10)], "r long, c long, y int")
    fit = lambda n: {(r["label"], r["feat"]): r["w"] for r in tree.train_layer(cells, rows, solver=solver, threshold=0.0, eps=1e-6, max_iter=200, max_rows=n).collect()}
    one, parts = fit(1000), fit(16)
    assert one.keys() == parts.keys() and all(abs(one[k] - parts[k]) < 1e-3 for k in one)


def test_a_loss_that_is_not_smooth_raises_in_parts(spark):
    with pytest.raises(ValueError):
        solvers.part_loss(solvers.DUAL_L1, solvers.Rows.of(np.ones((2, 2))), np.ones(2), np.ones(2), np.zeros(2))


def test_sparse_rows():
    x = np.array([[0, 2.0, 0], [0, 0, 0], [1, 0, 3]])
    r = solvers.Rows.of(x)
    w, a = np.array([1.0, 2, 3]), np.array([1.0, 5, 7])
    assert (r.dot(w) == x @ w).all() and (r.back(a) == x.T @ a).all() and (r.squares() == (x * x).sum(1)).all()


def test_text_helpers(spark):
    df = spark.createDataFrame([("Élan façade é", "['a', \"b, c\" ,d]", ["x", "?", "y"]), ("", "", []), (None, None, None)], "a string, b string, t array<string>")
    got = df.select(T.strip_accents("a").alias("a"), T.parse_list("b", r",(?![^\"]*\"\s*,)").alias("b"), T.token_ids("t", {"x": 4, "y": 0}).alias("t"), T.joined_ngrams("t", 2, "_").alias("g")).collect()
    assert tuple(got[0]) == ("Elan facade e", ["a", "b, c", "d"], [4, -1, 0], ["x_?", "?_y"])
    assert tuple(got[1]) == ("", [], [], []) and tuple(got[2]) == (None, None, None, None)


def test_separators_are_literal(spark):
    lines = spark.createDataFrame([(0, "1,2|some. text"), (1, "3|more")], "line long, text string")
    got = readers.parse_labelled(lines, "|").orderBy("line").collect()
    assert [r["text"] for r in got] == ["some. text", "more"] and [[x[0] for x in r["labels"]] for r in got] == [[1, 2], [3]]


def test_prediction_lines_are_json(spark):
    items = ['a"b\\c', "line\nbreak\tand \x01"]
    pred = spark.createDataFrame([(0, 0, 2.0, 1), (0, 1, 1.0, 2)], "r long, c long, v double, rank int")
    line = writers.prediction_lists(pred, spark.createDataFrame(list(enumerate(items)), "c long, item string")).first()["line"]
    assert json.loads(line)["data"] == [[items[0], 2.0], [items[1], 1.0]]
