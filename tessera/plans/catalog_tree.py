"""Queries on tree models. The model is fixed by formula over the region -> nation -> customer tree, so SQL can walk it too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, tree
from .catalog import BOUGHT, Tables, query, ranked, rounded

N_FEATS = 8
PARAMS = tree.TreeParams(beam_size=3, only_topk=5, post_processor="sigmoid", bias=1.0)


def model(t: Tables, **params) -> tree.TreeModel:
    """Weight of feature f (bias: -1) at node n of layer l: ((7 f + 13 n + 5 l) mod 11 - 5) / 10; the bias has n / 100000 more, so no two nodes tie."""
    c = t.tree()
    feats = F.explode(F.array(*(F.lit(f).cast("long") for f in range(-1, N_FEATS)))).alias("feat")
    w = c.select("layer", feats, F.col("child").alias("label"))
    return tree.TreeModel(c, w.withColumn("w", (F.pmod(7 * F.col("feat") + 13 * F.col("label") + 5 * F.col("layer"), F.lit(11)) - 5) / 10 + F.when(F.col("feat") == -1, F.col("label") / 100000).otherwise(0.0)), tree.TreeParams(**(PARAMS.__dict__ | params)))


def features(t: Tables) -> DataFrame:
    """Suppliers by features: (s mod (f + 2)) / 4 where that isn't zero."""
    x = t.supplier.select(F.col("s_suppkey").alias("r"), F.explode(F.array(*(F.lit(f).cast("long") for f in range(N_FEATS)))).alias("c"))
    return x.withColumn("v", (F.col("r") % (F.col("c") + 2)) / 4).where("v <> 0")


_BASE = f"""T AS (SELECT 0 AS layer, r_regionkey::BIGINT AS child, 0::BIGINT AS parent FROM region UNION ALL SELECT 1, n_nationkey::BIGINT, n_regionkey::BIGINT FROM nation UNION ALL SELECT 2, c_custkey, c_nationkey::BIGINT FROM customer),
W AS (SELECT layer, f::BIGINT AS feat, child AS label, ((((7 * f + 13 * child + 5 * layer) % 11) + 11) % 11 - 5) / 10.0::DOUBLE + CASE WHEN f = -1 THEN child / 100000.0::DOUBLE ELSE 0 END AS w FROM T, (SELECT UNNEST(range(-1, {N_FEATS})) AS f)),
X AS (SELECT * FROM (SELECT s_suppkey AS r, f::BIGINT AS c, (s_suppkey % (f + 2)) / 4.0::DOUBLE AS v FROM supplier, (SELECT UNNEST(range({N_FEATS})) AS f)) WHERE v <> 0)"""


def _layer_sql(layer: int, prev: str, k: int | None, keep: str = "", chain: str = "T") -> str:
    score = "1 / (1 + exp(-(coalesce((SELECT SUM(X.v * W.w) FROM X JOIN W ON W.feat = X.c WHERE X.r = d.r AND W.layer = {l} AND W.label = d.c), 0) + (SELECT w FROM W WHERE feat = -1 AND layer = {l} AND label = d.c))))".format(l=layer)
    body = f"SELECT d.r, d.c, {'1.0' if layer == 0 else 'd.p'} * {score} AS v FROM (SELECT P.r, t.child AS c, P.v AS p FROM {prev} P JOIN {chain} t ON t.layer = {layer} AND t.parent = P.c {keep}) d"
    return body if k is None else f"SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM ({body}) QUALIFY rank <= {k}"


def _walk(ks: list[int | None], chain: str = "T", keeps: list[str] | None = None) -> str:
    keeps = keeps or ["", "", ""]
    return (
        "P0 AS (SELECT DISTINCT r, 0::BIGINT AS c, 1.0::DOUBLE AS v FROM X), "
        + ", ".join(f"P{i + 1} AS ({_layer_sql(i, f'P{i}', k, keeps[i], chain)})" for i, k in enumerate(ks))
    )


@query("tree_predict", f"WITH {_BASE}, {_walk([3, 3, 5])} SELECT r, c, round(v, 8) AS v, rank FROM P3")
def _(t):
    return ranked(rounded(tree.predict(model(t), features(t)), 8))


@query("tree_match", f"WITH {_BASE}, {_walk([3, 3])} SELECT r, c, round(v, 8) AS v, rank FROM P2")
def _(t):
    return ranked(rounded(tree.predict(model(t), features(t), 2), 8))


@query("tree_match_then_rank", f"WITH {_BASE}, {_walk([3, 3, 5])} SELECT r, c, round(v, 8) AS v, rank FROM P3")
def _(t):
    m, x = model(t), features(t)
    return ranked(rounded(tree.predict_ranker(m, x, tree.predict(m, x, 2)), 8))


_SEL = "S3 AS (SELECT DISTINCT s_suppkey AS r, c_custkey AS c FROM supplier JOIN customer ON c_custkey % 97 = s_suppkey % 97), S2 AS (SELECT DISTINCT r, c_nationkey::BIGINT AS c FROM S3 JOIN customer ON c_custkey = S3.c), S1 AS (SELECT DISTINCT r, n_regionkey::BIGINT AS c FROM S2 JOIN nation ON n_nationkey = S2.c)"


@query(
    "tree_predict_selected",
    f"WITH {_BASE}, {_SEL}, {_walk([None, None, None], keeps=[f'WHERE (P.r, t.child) IN (SELECT r, c FROM S{i})' for i in (1, 2, 3)]).replace('FROM X)', 'FROM S1)', 1)} SELECT r, c, round(v, 8) AS v FROM P3",
)
def _(t):
    # many pairs come of few customers, so these are dealt out first
    customers = t.customer.select(F.col("c_custkey").alias("c")).repartition(8 * t.spark.sparkContext.defaultParallelism, "c")
    pairs = t.supplier.select(F.col("s_suppkey").alias("r")).join(customers, F.col("c") % 97 == F.col("r") % 97)
    return rounded(tree.predict_selected(model(t), features(t), pairs), 8)


_CUT = "C3 AS (SELECT * FROM T WHERE layer = 2 AND child % 5 = 0), C2 AS (SELECT * FROM T WHERE layer = 1 AND child IN (SELECT parent FROM C3)), C1 AS (SELECT * FROM T WHERE layer = 0 AND child IN (SELECT parent FROM C2)), TC AS (SELECT * FROM C1 UNION ALL SELECT * FROM C2 UNION ALL SELECT * FROM C3)"


@query("tree_constrained", f"WITH {_BASE}, {_CUT}, {_walk([3, 3, 5], 'TC')} SELECT r, c, round(v, 8) AS v, rank FROM P3")
def _(t):
    only = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("c"))
    return ranked(rounded(tree.predict(tree.constrain(model(t), only), features(t)), 8))


@query("tree_subtree", "SELECT 0 AS layer, n_nationkey::BIGINT AS child, 0::BIGINT AS parent FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 1, c_custkey, c_nationkey::BIGINT FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def _(t):
    return tree.subtree(model(t), 1, 2).chain


@query("tree_split", "SELECT n_regionkey::BIGINT AS subtree, 1 AS layer, n_nationkey::BIGINT AS child FROM nation UNION ALL SELECT n_regionkey::BIGINT, 2, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    return tree.split(model(t), 1)[1]


@query("tree_reassemble", f"WITH {_BASE}, {_walk([3, 3, 5])} SELECT r, c, round(v, 8) AS v, rank FROM P3")
def _(t):
    m = model(t)
    top, _below = tree.split(m, 1)
    nodes = [r["child"] for r in chains.layer_of(m.chain, 0).orderBy("child").collect()]  # the regions
    return ranked(rounded(tree.predict(tree.reassemble(top, [(n, tree.subtree(m, 1, n)) for n in nodes], 1), features(t)), 8))


@query("tree_submodel", f"WITH {_BASE} SELECT W.feat, W.label, round(W.w, 6) AS w FROM W JOIN T ON T.layer = 2 AND W.layer = 2 AND T.child = W.label WHERE T.parent < 6 AND T.child % 2 = 0")
def _(t):
    codes = t.nation.where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("c"))
    only = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("c"))
    return rounded(tree.submodel(model(t), codes, only).weights.select("feat", "label", "w"), 6, "w")


@query("tree_describe", f"WITH {_BASE} SELECT T.layer, count(DISTINCT child) AS n_nodes, count(DISTINCT child) * {N_FEATS + 1} AS n_weights, {N_FEATS + 1}::BIGINT AS n_features FROM T GROUP BY T.layer")
def _(t):
    return model(t).describe()


@query("tree_inherit_head", f"WITH {_BASE} SELECT W.feat, T.child AS label, round(W.w, 6) AS w FROM T JOIN W ON T.layer = 2 AND W.layer = 1 AND W.label = T.parent")
def _(t):
    m = model(t)
    return rounded(tree.inherit_head(m.weights.where("layer = 1"), m.chain, 2), 6, "w")


@query("tree_workload", f"WITH {BOUGHT} SELECT n_regionkey::BIGINT AS subtree, count(*) AS n FROM B JOIN customer ON c_custkey = B.c JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    m = model(t)
    return tree.workload(t.bought(), tree.split(m, 1)[1].where("layer = 2"))


@query("tree_candidates", f"WITH {BOUGHT}, M AS (SELECT DISTINCT B.r, c_nationkey::BIGINT AS c FROM B JOIN customer ON c_custkey = B.c) SELECT M.r, c_custkey AS c, CASE WHEN B.c IS NULL THEN -1 ELSE 1 END AS y FROM M JOIN customer ON c_nationkey = M.c LEFT JOIN B ON B.r = M.r AND B.c = c_custkey")
def _(t):
    y, chain = t.bought(), t.tree()
    return tree.candidates(y, chain, 2, chains.lift(y, chain, 2))


def trained(t: Tables, solver: str = "l2svc_dual") -> tuple[tree.TreeModel, DataFrame]:
    """A tree over the embeddings' labels, trained on them."""
    y = t.clusters()
    n = y.agg(F.max("c")).first()[0] + 1
    codes = t.spark.range(n).select(F.col("id").alias("child"), F.floor(F.col("id") / 4).alias("parent"))
    chain = chains.complete(codes, -(-n // 4), 1)
    params = tree.TreeParams(beam_size=4, only_topk=3)
    return tree.train(t.cells(), y, chain, params=params, solver=solver, threshold=0.0), t.cells()


@query("tree_train")
def _(t):
    m, x = trained(t)
    return tree.predict(m, x)


@query("tree_train_primal")
def _(t):
    m, x = trained(t, "l2svc_primal")
    return tree.predict(m, x)


@query("layer_train_logistic")
def _(t):
    y = t.clusters()
    all_pairs = t.embeddings.select(F.col("vec_id").alias("r")).join(y.select("c").distinct())  # a fixed, small set of labels
    rows = all_pairs.join(y.select("r", "c", F.lit(1).alias("y")), ["r", "c"], "left").select("r", "c", F.coalesce("y", F.lit(-1)).alias("y"))
    return tree.train_layer(t.cells(), rows, solver="lr_dual", threshold=0.0)


@query("text_to_items")
def _(t):
    from .text_to_items import TextToItems
    from .tfidf import Options

    docs = t.documents
    source = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    y = docs.select(F.col("doc_id").alias("r"), source.alias("c"), F.lit(1.0).alias("v"))
    items = docs.select(source.alias("c"), F.col("source").alias("item")).distinct()
    m = TextToItems.train(docs, y, items, Options(min_df_cnt=2), max_leaf_size=10, solver="l2svc_primal", threshold=0.05)
    return m.predict(docs, topk=3)
