"""Queries over the driver tables, each with the SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scores as S
from ..functions import text as T
from ..operators import chains, ensembles, knn, labels, matrix, metrics, numbering, ranker, sessions, stores
from ..sources import readers, writers
from . import tfidf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self) -> DataFrame:
        """Orders by parts, quantities."""
        return matrix.coords(self.lineitem, "l_orderkey", "l_partkey", "l_quantity")

    def supply(self, flag: str | None = None) -> DataFrame:
        """Suppliers by parts, quantities (of one return flag)."""
        li = self.lineitem if flag is None else self.lineitem.where(F.col("l_returnflag") == flag)
        return matrix.coords(li, "l_suppkey", "l_partkey", "l_quantity")

    def sizes(self) -> DataFrame:
        """Parts by sizes, thousands of the price."""
        return matrix.coords(self.part, "p_partkey", "p_size", F.col("p_retailprice") / 1000)

    def cells(self) -> DataFrame:
        return matrix.dense_to_coords(self.embeddings, "vec_id", "embedding")

    def clusters(self) -> DataFrame:
        """Vectors by their label."""
        return matrix.coords(self.embeddings, "vec_id", "label", F.lit(1.0))

    def tree(self) -> DataFrame:
        """Root -> regions -> nations -> customers."""
        r = self.region.select(F.lit(0).alias("layer"), F.col("r_regionkey").cast("long").alias("child"), F.lit(0).cast("long").alias("parent"))
        n = self.nation.select(F.lit(1).alias("layer"), F.col("n_nationkey").cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
        c = self.customer.select(F.lit(2).alias("layer"), F.col("c_custkey").cast("long").alias("child"), F.col("c_nationkey").cast("long").alias("parent"))
        return r.unionByName(n).unionByName(c)

    def bought(self) -> DataFrame:
        """Priorities by customers, numbers of orders."""
        o = self.orders.select(F.substring("o_orderpriority", 1, 1).cast("long").alias("p"), "o_custkey")
        return matrix.coords(o, "p", "o_custkey", F.lit(1.0))


PARTS = "X AS (SELECT l_orderkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"
SUPPLY = "Q AS (SELECT l_suppkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"
SIZES = "W AS (SELECT p_partkey AS r, p_size::BIGINT AS c, SUM(p_retailprice / 1000)::DOUBLE AS v FROM part GROUP BY 1, 2)"
CELLS = "E AS (SELECT vec_id AS r, i::BIGINT AS c, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, UNNEST(range(len(embedding))) AS i FROM embeddings))"
CLUSTERS = "Y AS (SELECT vec_id AS r, label::BIGINT AS c, SUM(1.0)::DOUBLE AS v FROM embeddings GROUP BY 1, 2)"
BOUGHT = "B AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS r, o_custkey AS c, SUM(1.0)::DOUBLE AS v FROM orders GROUP BY 1, 2)"
FLAGS = "A1 AS (SELECT l_suppkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), A2 AS (SELECT l_suppkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(m: DataFrame, digits: int = 6, col: str = "v") -> DataFrame:
    return m.withColumn(col, F.round(col, digits))


def ranked(m: DataFrame) -> DataFrame:
    return m.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- projections, filters


@query("matrix_build", f"WITH {PARTS} SELECT * FROM X")
def _(t):
    return t.parts()


@query("matrix_transpose_binarize", f"WITH {PARTS} SELECT c AS r, r AS c, 1.0::DOUBLE AS v FROM X")
def _(t):
    return matrix.binarize(matrix.transpose(t.parts()))


@query("dense_cells", f"WITH {CELLS} SELECT * FROM E")
def _(t):
    return t.cells()


@query("dense_topk", f"WITH {CELLS} SELECT r, c, v FROM E QUALIFY row_number() OVER (PARTITION BY r ORDER BY abs(v) DESC, c) <= 5")
def _(t):
    return matrix.dense_topk(t.embeddings, "vec_id", "embedding", 5)


@query("select_rows_columns", f"WITH {PARTS} SELECT * FROM X WHERE r IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND c IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def _(t):
    return matrix.select_entries(t.parts(), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("r")), t.part.where("p_size < 10").select(F.col("p_partkey").alias("c")))


@query("gather_rows", f"WITH {SUPPLY}, P AS (SELECT 2 * s_suppkey AS pos, s_suppkey AS r FROM supplier UNION ALL SELECT 2 * s_suppkey + 1, s_suppkey FROM supplier) SELECT P.pos AS r, Q.c, Q.v FROM P JOIN Q USING (r)")
def _(t):
    s = t.supplier
    pos = s.select((F.col("s_suppkey") * 2).alias("pos"), F.col("s_suppkey").alias("r"))
    return matrix.gather_rows(t.supply(), pos.unionByName(pos.withColumn("pos", F.col("pos") + 1)))


@query("rows_of_columns", f"WITH {PARTS} SELECT c, string_agg(r::VARCHAR, ',' ORDER BY r) AS rs FROM X GROUP BY c")
def _(t):
    return matrix.rows_of_columns(t.parts()).withColumn("rs", F.array_join("rs", ","))


@query("columns_of_rows", f"WITH {PARTS} SELECT r, string_agg(c::VARCHAR, ',' ORDER BY c) AS cs FROM X GROUP BY r")
def _(t):
    return matrix.columns_of_rows(t.parts()).withColumn("cs", F.array_join("cs", ","))


@query("scale_rows", f"WITH {SUPPLY} SELECT r, c, round(v * s_acctbal, 4) AS v FROM Q JOIN supplier ON s_suppkey = r")
def _(t):
    return rounded(matrix.scale_rows(t.supply(), t.supplier.select(F.col("s_suppkey").alias("r"), F.col("s_acctbal").alias("w"))), 4)


@query("scale_columns", f"WITH {SUPPLY} SELECT r, c, round(v * p_retailprice, 4) AS v FROM Q JOIN part ON p_partkey = c")
def _(t):
    return rounded(matrix.scale_columns(t.supply(), t.part.select(F.col("p_partkey").alias("c"), F.col("p_retailprice").alias("w"))), 4)


@query("magnitude_threshold", f"WITH {CELLS} SELECT * FROM E WHERE abs(v) >= 0.2")
def _(t):
    return matrix.at_least(t.cells(), 0.2)


@query("score_threshold", f"WITH {PARTS} SELECT * FROM X WHERE v > 30")
def _(t):
    return matrix.above(t.parts(), 30)


@query("strongest_weights", f"WITH {CELLS} SELECT r, c, v FROM E QUALIFY row_number() OVER (PARTITION BY c ORDER BY abs(v) DESC, CASE WHEN r = 3 THEN 1 ELSE 0 END, r) <= 7")
def _(t):
    return matrix.strongest_weights(t.cells(), 7, 3)


@query("without_known_pairs", f"WITH {SUPPLY}, K AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS c FROM lineitem WHERE l_returnflag = 'R') SELECT Q.* FROM Q ANTI JOIN K USING (r, c)")
def _(t):
    return matrix.without_pairs(t.supply(), t.supply("R"))


@query("degree_filter", f"WITH {PARTS}, D AS (SELECT r, count(*) AS n FROM X GROUP BY r HAVING count(*) < 4) SELECT X.* FROM X JOIN D USING (r)".replace("SELECT X.*", "SELECT X.r, X.c, X.v"))
def _(t):
    return matrix.below_degree(t.parts(), 4)


# ---------------------------------------------------------------- products


@query("matmul", f"WITH {PARTS}, {SIZES} SELECT X.r, W.c, round(SUM(X.v * W.v), 4) AS v FROM X JOIN W ON X.c = W.r GROUP BY 1, 2")
def _(t):
    return rounded(matrix.matmul(t.parts(), t.sizes()), 4)


@query("matmul_gram", f"WITH {CELLS} SELECT a.c AS r, b.c, round(SUM(a.v * b.v), 6) AS v FROM E a JOIN E b ON a.r = b.r GROUP BY 1, 2")
def _(t):
    e = t.cells()
    return rounded(matrix.matmul(matrix.transpose(e), e))


@query(
    "inner_products",
    f"WITH {SUPPLY}, {SIZES}, P AS (SELECT s_suppkey AS r, (s_suppkey % 50)::BIGINT AS c FROM supplier) SELECT P.r, P.c, round(coalesce(SUM(Q.v * W.v), 0), 4) AS v FROM P LEFT JOIN (Q JOIN W ON Q.c = W.r) ON Q.r = P.r AND W.c = P.c GROUP BY 1, 2".replace(
        "LEFT JOIN (Q JOIN W ON Q.c = W.r) ON Q.r = P.r AND W.c = P.c", "LEFT JOIN (SELECT Q.r AS qr, W.c AS wc, Q.v AS qv, W.v AS wv FROM Q JOIN W ON Q.c = W.r) j ON j.qr = P.r AND j.wc = P.c"
    ).replace("Q.v * W.v), 0)", "j.qv * j.wv), 0)"),
)
def _(t):
    pairs = t.supplier.select(F.col("s_suppkey").alias("r"), (F.col("s_suppkey") % 50).alias("c"))
    return rounded(matrix.inner_products(t.supply(), t.sizes(), pairs), 4)


@query("dot_and_distances", "SELECT a.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip_distance, round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 6) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id").select("id", F.round(S.dot("a", "b"), 6).alias("ip"), F.round(S.ip_distance("a", "b"), 6).alias("ip_distance"), F.round(S.l2_distance("a", "b"), 6).alias("l2"))


# ---------------------------------------------------------------- aggregations


@query("degrees", f"WITH {PARTS} SELECT r, count(*) AS degree FROM X GROUP BY r")
def _(t):
    return matrix.degrees(t.parts())


@query("label_frequency", f"WITH {PARTS} SELECT c, SUM(v) AS total FROM X GROUP BY c")
def _(t):
    return matrix.column_sums(t.parts())


@query("row_statistics", f"WITH {PARTS}, N AS (SELECT r, count(*) AS n FROM X GROUP BY r) SELECT count(*) AS n_rows, SUM(n)::BIGINT AS n_entries, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, min(n) AS least, max(n) AS most FROM N")
def _(t):
    return rounded(rounded(matrix.row_statistics(t.parts()), 6, "mean"), 6, "deviation")


@query("spectral_scaling", f"WITH {SUPPLY} SELECT r, c, round(v / sqrt(SUM(v) OVER (PARTITION BY r) * SUM(v) OVER (PARTITION BY c)), 8) AS v FROM Q")
def _(t):
    return rounded(matrix.spectral_scaling(t.supply()), 8)


@query("spectral_embedding")
def _(t):
    return matrix.spectral_embedding(t.supply(), 4)


# ---------------------------------------------------------------- windows, top-k


@query("topk_rows", f"WITH {SUPPLY} SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM Q QUALIFY rank <= 10")
def _(t):
    return ranked(matrix.topk_rows(t.supply(), 10))


@query("topk_columns", f"WITH {SUPPLY} SELECT *, row_number() OVER (PARTITION BY c ORDER BY v DESC, r) AS rank FROM Q QUALIFY rank <= 3")
def _(t):
    return ranked(matrix.topk_columns(t.supply(), 3))


for _norm, _size in (("l1", "SUM(abs(v)) OVER (PARTITION BY r)"), ("l2", "sqrt(SUM(v * v) OVER (PARTITION BY r))"), ("max", "MAX(abs(v)) OVER (PARTITION BY r)")):
    query(f"normalize_{_norm}", f"WITH {SUPPLY} SELECT r, c, round(v / {_size}, 11) AS v FROM Q")(lambda t, n=_norm: rounded(matrix.normalize_rows(t.supply(), n), 11))


@query("softmax_rows", f"WITH {SUPPLY}, M AS (SELECT r, c, exp(v - MAX(v) OVER (PARTITION BY r)) AS e FROM Q) SELECT r, c, round(e / SUM(e) OVER (PARTITION BY r), 8) AS v FROM M")
def _(t):
    return rounded(matrix.softmax_rows(t.supply()), 8)


@query("exp_l1_rows", f"WITH {CELLS} SELECT r, c, round(exp(v) / SUM(exp(v)) OVER (PARTITION BY r), 8) AS v FROM E")
def _(t):
    return rounded(matrix.softmax_rows(t.cells(), shifted=False), 8)


RELEVANCE = "SELECT r, c, ((SELECT max(n) FROM (SELECT count(*) AS n FROM {m} GROUP BY r)) - row_number() OVER (PARTITION BY r ORDER BY v DESC, c) + 1)::DOUBLE AS v FROM {m}"


@query("rank_relevance", f"WITH {SUPPLY} {RELEVANCE.format(m='Q')}")
def _(t):
    return matrix.rank_relevance(t.supply())


@query("number_rows", "SELECT p_name, p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1)::BIGINT AS id FROM part")
def _(t):
    return numbering.number_rows(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"])


# ---------------------------------------------------------------- stacking


@query("vstack", f"WITH {FLAGS} SELECT * FROM A1 UNION ALL SELECT r + 100000, c, v FROM A2")
def _(t):
    return matrix.vstack([t.supply("R"), t.supply("A")], [100000, 100000])


@query("hstack", f"WITH {FLAGS} SELECT * FROM A1 UNION ALL SELECT r, c + 1000000, v FROM A2")
def _(t):
    return matrix.hstack([t.supply("R"), t.supply("A")], [1000000, 1000000])


@query("block_diagonal", f"WITH {FLAGS} SELECT * FROM A1 UNION ALL SELECT r + 100000, c + 1000000, v FROM A2")
def _(t):
    return matrix.block_diagonal([t.supply("R"), t.supply("A")], [(100000, 1000000), (100000, 1000000)])


@query("matrix_sum", f"WITH {FLAGS} SELECT r, c, SUM(v) AS v FROM (SELECT * FROM A1 UNION ALL SELECT * FROM A2) GROUP BY 1, 2")
def _(t):
    return matrix.add(t.supply("R"), t.supply("A"))


@query("matrix_max", f"WITH {FLAGS} SELECT r, c, MAX(v) AS v FROM (SELECT * FROM A1 UNION ALL SELECT * FROM A2) GROUP BY 1, 2")
def _(t):
    return matrix.largest(t.supply("R"), t.supply("A"))


@query("concat_features", f"WITH {CELLS}, {CLUSTERS} SELECT * FROM Y UNION ALL SELECT r, c + 100, round(v / sqrt(SUM(v * v) OVER (PARTITION BY r)), 6) FROM E")
def _(t):
    return rounded(matrix.concat_features(t.clusters(), t.cells(), 100))


@query("augment", f"WITH {FLAGS} SELECT * FROM A1 UNION ALL SELECT r + 100000, c, v FROM A2")
def _(t):
    return matrix.augment("trn-d2q", t.supply("R"), t.supply("N"), t.supply("A"), 100000, 100000)


# ---------------------------------------------------------------- ensembles, evaluation

_PAIR = f"WITH {FLAGS}"
_MM = "(SELECT max(n) FROM (SELECT count(*) AS n FROM A1 GROUP BY r UNION ALL SELECT count(*) FROM A2 GROUP BY r))"
_RANK = lambda m, extra="0": f"SELECT r, c, ({_MM} - row_number() OVER (PARTITION BY r ORDER BY v DESC, c) + 1 + {extra})::DOUBLE AS v FROM {m}"
_MEAN = lambda a, b: f"SELECT r, c, round(SUM(v) / 2, 8) AS v FROM ({a} UNION ALL {b}) GROUP BY 1, 2"
_SOFT = lambda m: f"SELECT r, c, e / SUM(e) OVER (PARTITION BY r) AS v FROM (SELECT r, c, exp(v - MAX(v) OVER (PARTITION BY r)) AS e FROM {m})"
for _name, _sql in (
    ("average", _MEAN("SELECT * FROM A1", "SELECT * FROM A2")),
    ("rank_average", _MEAN(_RANK("A1"), _RANK("A2"))),
    ("sigmoid_average", _MEAN("SELECT r, c, 1 / (1 + exp(-v)) AS v FROM A1", "SELECT r, c, 1 / (1 + exp(-v)) FROM A2")),
    ("softmax_average", _MEAN(_SOFT("A1"), _SOFT("A2"))),
    ("round_robin", f"SELECT r, c, round(MAX(v) / 2, 8) AS v FROM ({_RANK('A1', '2.0 / 3')} UNION ALL {_RANK('A2', '1.0 / 3')}) GROUP BY 1, 2"),
):
    query(f"ensemble_{_name}", f"{_PAIR} {_sql}")(lambda t, n=_name: rounded(ensembles.ensemble(n, t.supply("R"), t.supply("A")), 8))


@query(
    "precision_recall",
    f"""WITH {FLAGS}, P AS (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM A1), N AS (SELECT r, count(*) AS n FROM A2 GROUP BY r),
    H AS (SELECT P.r, P.rank, N.n FROM P JOIN A2 USING (r, c) JOIN N USING (r) WHERE rank <= 10), T AS (SELECT count(*) AS n_rows FROM supplier), K AS (SELECT UNNEST(range(1, 11)) AS k)
    SELECT k, round(count(H.rank) / (k * any_value(n_rows))::DOUBLE, 8) AS precision, round(coalesce(SUM(1.0::DOUBLE / H.n), 0) / any_value(n_rows), 8) AS recall FROM K CROSS JOIN T LEFT JOIN H ON H.rank <= k GROUP BY k""",
)
def _(t):
    out = metrics.precision_recall(t.supply("A"), t.supply("R"), t.supplier.count(), 10)
    return rounded(rounded(out, 8, "precision"), 8, "recall")


_RR = f"WITH {FLAGS}, P AS (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM A1), R AS (SELECT A2.r, coalesce(1.0 / MIN(rank), 0)::DOUBLE AS rr FROM A2 LEFT JOIN P USING (r, c) GROUP BY 1)"


@query("reciprocal_rank", f"{_RR} SELECT r, round(rr, 8) AS rr FROM R")
def _(t):
    return rounded(metrics.reciprocal_rank(t.supply("A"), matrix.topk_rows(t.supply("R"), 1 << 30)), 8, "rr")


@query("bucketed_scores", f"{_RR}, D AS (SELECT r, rr, (SELECT count(*) FROM A2 WHERE A2.r = R.r) AS n FROM R) SELECT CASE WHEN n < 100 THEN 0 WHEN n < 150 THEN 1 ELSE 2 END AS bucket, count(*) AS n, round(avg(rr), 8) AS rr_mean, round(stddev_pop(rr), 8) AS rr_std FROM D WHERE n >= 1 AND n < 1000000 GROUP BY 1")
def _(t):
    rr = metrics.reciprocal_rank(t.supply("A"), matrix.topk_rows(t.supply("R"), 1 << 30)).join(matrix.degrees(t.supply("A")), "r")
    return rounded(rounded(metrics.bucketed(rr, F.col("degree"), [1, 100, 150, 1000000], "rr"), 8, "rr_mean"), 8, "rr_std")


@query("rank_weighted_bleu")
def _(t):
    w = matrix.topk_rows(t.supply("R"), 5).join(t.part.select(F.col("p_partkey").alias("c"), "p_name", "p_type"), "c")
    return metrics.rank_weighted_bleu(w.select("r", "rank", F.col("p_name").alias("truth"), F.concat_ws(" ", "p_name", "p_type").alias("candidate")))


@query(
    "variation_of_information",
    "WITH C AS (SELECT p_brand AS x, p_size AS y, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2) SELECT round(SUM(-(n / (SELECT SUM(n) FROM C)) * (ln(n / nx) + ln(n / ny))), 6) AS vi FROM C JOIN (SELECT x, SUM(n) AS nx FROM C GROUP BY x) USING (x) JOIN (SELECT y, SUM(n) AS ny FROM C GROUP BY y) USING (y)",
)
def _(t):
    p = t.part
    return rounded(metrics.variation_of_information(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")), p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cluster"))), 6, "vi")


for _how, _fn in (("max", "MAX"), ("mean", "AVG")):
    query(f"merge_labels_{_how}", f"WITH {SUPPLY} SELECT r, p_size::BIGINT AS c, round({_fn}(v), 6) AS v FROM Q JOIN part ON p_partkey = c GROUP BY 1, 2".replace("ON p_partkey = c", "ON p_partkey = Q.c"))(
        lambda t, h=_how: rounded(metrics.merge_pseudo_labels(t.supply(), t.part.select(F.col("p_partkey").alias("c"), F.col("p_size").cast("long").alias("original")), h))
    )


# ---------------------------------------------------------------- transforms

_X = "(c_acctbal / 1000)"


def _post_sql(name: str) -> str:
    if name == "noop":
        return _X
    if name == "sigmoid":
        return f"1 / (1 + exp(-{_X}))"
    if name == "log-sigmoid":
        return f"-ln(1 + exp(-{_X}))"
    p = name[-7]
    h = f"power(greatest(1 - {_X}, 0), {p})"
    return f"0 - {h}" if name.startswith("log") else f"exp(-{h})"


@query("score_transforms", "SELECT c_custkey AS id, " + ", ".join(f'round({_post_sql(n)}, 6) + 0.0 AS "{n}"' for n in S.PostProcessor.names()) + " FROM customer")
def _(t):
    x = F.col("c_acctbal") / 1000
    return t.customer.select(F.col("c_custkey").alias("id"), *(F.round(S.PostProcessor.get(n).transform(x), 6).alias(n) for n in S.PostProcessor.names()))


@query("score_combiners", f"SELECT c_custkey AS id, round({_X} + 2, 6) AS plus, round({_X} * 2, 6) AS times, greatest({_X}, 2.0) AS larger, {_X} AS keep, round(2 + 3 * {_X}, 6) AS axpy FROM customer")
def _(t):
    x, two = F.col("c_acctbal") / 1000, F.lit(2.0)
    return t.customer.select(F.col("c_custkey").alias("id"), F.round(S.plus(x, two), 6).alias("plus"), F.round(S.times(x, two), 6).alias("times"), S.larger(x, two).alias("larger"), S.keep(x, two).alias("keep"), F.round(S.axpy(3.0, x, two), 6).alias("axpy"))


@query(
    "losses",
    f"""SELECT c_custkey AS id, round(2.0 * power(greatest(1 - CASE WHEN c_nationkey < 12 THEN {_X} ELSE -{_X} END, 0), 2), 6) AS hinge, round(greatest(0, 1 - {_X} + 0.1), 6) AS margin,
    round(0.3 * greatest(0, 1 - {_X} + 0.1) + 0.7 * (power({_X} - 1, 2) + 1) / 2, 6) AS pair_loss, round(ln(exp({_X}) + exp(1.0) + exp(0.5)) - {_X}, 6) AS listwise FROM customer""",
)
def _(t):
    x = F.col("c_acctbal") / 1000
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.round(S.squared_hinge_loss(x, F.col("c_nationkey") < 12, 2.0), 6).alias("hinge"),
        F.round(S.margin_ranking_loss(x, F.lit(1.0)), 6).alias("margin"),
        F.round(S.blended_pair_loss(x, F.lit(1.0), F.lit(1.0), F.lit(0.0), 0.3), 6).alias("pair_loss"),
        F.round(S.listwise_loss(F.array(x, F.lit(1.0), F.lit(0.5))), 6).alias("listwise"),
    )


@query("inverse_propensity", f"WITH {SUPPLY}, N AS (SELECT c, count(*) AS n FROM Q GROUP BY c) SELECT c, round(1 + (ln(1000.0) - 1) * power(3.6, 0.6) * exp(-0.6 * ln(n + 2.6)), 6) AS p FROM N")
def _(t):
    return matrix.degrees(matrix.transpose(t.supply())).select(F.col("r").alias("c"), F.round(S.inverse_propensity(F.col("degree"), 1000), 6).alias("p"))


@query("platt_calibration")
def _(t):
    from ..operators.calibrate import apply_platt, fit_platt

    rows = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("f"), (F.col("c_acctbal") > 4000).cast("double").alias("t"))
    a, b = fit_platt(rows, "f", "t")
    return rows.select("id", apply_platt(F.col("f"), a, b).alias("p"))


# ---------------------------------------------------------------- text

_WORDS = "W AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)"
_TOKENS = f"{_WORDS}, T AS (SELECT doc_id AS r, UNNEST(w) AS g FROM W)"


@query("word_tokens", f"WITH {_WORDS} SELECT doc_id, len(w) AS n, w[1] AS first, w[len(w)] AS last FROM W")
def _(t):
    w = t.documents.select("doc_id", T.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.size("w") - 1).alias("last"))


@query("char_tokens", "SELECT doc_id, length(text) AS n, substr(text, 1, 1) AS first FROM documents")
def _(t):
    c = t.documents.select("doc_id", T.tokens("text", T.CHAR).alias("c"))
    first = F.when(F.col("c").isNotNull(), F.coalesce(F.get("c", F.lit(0)), F.lit("")))  # of an empty text: empty, as a substring is
    return c.select("doc_id", F.size("c").cast("long").alias("n"), first.alias("first"))


@query("char_in_word_ngrams", f"WITH {_TOKENS}, P AS (SELECT r, ' ' || g || ' ' AS s FROM T), G AS (SELECT r, substr(s, i::BIGINT, 3) AS g FROM (SELECT r, s, UNNEST(range(1, length(s) - 1)) AS i FROM P)) SELECT g, count(*) AS n, count(DISTINCT r) AS df FROM G GROUP BY g")
def _(t):
    return tfidf.gram_totals(t.documents, tfidf.Options(tokenizer=T.CHAR_IN_WORD, ngram_range=(3, 3)), sep="").select("g", "n", "df")


_BIGRAMS = f"{_WORDS}, G AS (SELECT doc_id AS r, UNNEST(w) AS g, 1 AS len FROM W UNION ALL SELECT doc_id, w[i] || chr(1) || w[i + 1], 2 FROM (SELECT doc_id, w, UNNEST(range(1, len(w))) AS i FROM W)), C AS (SELECT r, g, len, count(*) AS n FROM G GROUP BY 1, 2, 3)"


@query("term_frequency", f"WITH {_BIGRAMS} SELECT r, count(*) AS grams, SUM(n)::BIGINT AS total, MAX(n) AS most FROM C GROUP BY r")
def _(t):
    c = tfidf.gram_counts(t.documents, tfidf.Options(ngram_range=(1, 2)))
    return c.groupBy("r").agg(F.count("*").alias("grams"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("document_frequency", f"WITH {_TOKENS} SELECT g, count(DISTINCT r) AS df FROM T GROUP BY g")
def _(t):
    return tfidf.gram_totals(t.documents, tfidf.Options()).select("g", "df")


@query("vocabulary", f"WITH {_TOKENS} SELECT g, (row_number() OVER (ORDER BY g) - 1)::BIGINT AS id FROM (SELECT DISTINCT g FROM T)")
def _(t):
    return numbering.number_rows(t.documents.select(F.explode(T.words("text")).alias("g")).distinct(), ["g"])


@query(
    "tfidf",
    f"""WITH {_TOKENS}, C AS (SELECT r, g, count(*) AS n FROM T GROUP BY 1, 2), D AS (SELECT g, count(*) AS df FROM C GROUP BY g HAVING count(*) >= 2),
    F AS (SELECT g, greatest(ln((SELECT count(*) FROM documents) / (df + 1.0)), 0) AS idf, (row_number() OVER (ORDER BY df, g) - 1)::BIGINT AS c FROM D),
    M AS (SELECT r, c, n * idf AS v FROM C JOIN F USING (g)), N AS (SELECT r, c, v, SUM(v * v) OVER (PARTITION BY r) AS s FROM M) SELECT r, c, round(CASE WHEN s > 1.1920929e-7 THEN v / sqrt(s) ELSE v END, 6) AS v FROM N""",
)
def _(t):
    return rounded(tfidf.Tfidf.fit(t.documents, tfidf.Options(min_df_cnt=2)).transform(t.documents))


@query(
    "tfidf_bigrams",
    f"""WITH {_BIGRAMS}, D AS (SELECT g, len, count(*) AS df FROM C GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) <= round(0.5 * (SELECT count(*) FROM documents))),
    K AS (SELECT * FROM D ORDER BY df DESC, len DESC, g DESC LIMIT 2000),
    F AS (SELECT g, ln((SELECT count(*) FROM documents) / df::DOUBLE) + 1 AS idf, (row_number() OVER (ORDER BY df, len, g) - 1)::BIGINT AS c FROM K),
    M AS (SELECT r, c, (ln(n) + 1) * idf AS v FROM C JOIN F USING (g)) SELECT r, c, round(v / SUM(abs(v)) OVER (PARTITION BY r), 6) AS v FROM M""",
)
def _(t):
    o = tfidf.Options(ngram_range=(1, 2), min_df_cnt=3, max_df_ratio=0.5, max_feature=2000, sublinear=True, smooth_idf=False, add_one_idf=True, norm="l1")
    return rounded(tfidf.Tfidf.fit(t.documents, o).transform(t.documents))


@query(
    "tfidf_stacked",
    """WITH W AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents), A AS (SELECT doc_id AS r, UNNEST(w) AS g FROM W), B AS (SELECT doc_id AS r, UNNEST(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) AS g FROM W),
    AC AS (SELECT r, g, count(*) AS n FROM A GROUP BY 1, 2), AD AS (SELECT g, count(*) AS df FROM AC GROUP BY g HAVING count(*) >= 2), AF AS (SELECT g, 0 + row_number() OVER (ORDER BY df, g) - 1 AS c, greatest(ln((SELECT count(*) FROM documents) / (df + 1.0)), 0) AS idf FROM AD),
    AV AS (SELECT r, c, g, n * idf AS v, SUM(n * idf * n * idf) OVER (PARTITION BY r) AS s FROM AC JOIN AF USING (g)), AX AS (SELECT r, c, g, CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END AS v FROM AV),
    BC AS (SELECT r, g, count(*) AS n FROM B GROUP BY 1, 2), BD AS (SELECT g, count(*) AS df FROM BC GROUP BY g HAVING count(*) >= 2), BF AS (SELECT g, (SELECT count(*) FROM AD) + row_number() OVER (ORDER BY df, g) - 1 AS c, greatest(ln((SELECT count(*) FROM documents) / (df + 1.0)), 0) AS idf FROM BD),
    BV AS (SELECT r, c, g, n * idf AS v, SUM(n * idf * n * idf) OVER (PARTITION BY r) AS s FROM BC JOIN BF USING (g)), BX AS (SELECT r, c, g, CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END AS v FROM BV),
    Z AS (SELECT r, c, v FROM AX UNION ALL SELECT r, c, v FROM BX) SELECT r, c::BIGINT AS c, round(CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END, 6) AS v FROM (SELECT r, c, v, SUM(v * v) OVER (PARTITION BY r) AS s FROM Z)""",
)
def _(t):
    models = tfidf.fit_stacked(t.documents, [tfidf.Options(min_df_cnt=2), tfidf.Options(ngram_range=(2, 2), min_df_cnt=2)])
    return rounded(tfidf.transform_stacked(models, t.documents))


@query(
    "tfidf_word_regex",
    r"""WITH T AS (SELECT doc_id AS r, UNNEST(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS g FROM documents), C AS (SELECT r, g, count(*) AS n FROM T GROUP BY 1, 2), D AS (SELECT g, count(*) AS df FROM C GROUP BY g),
    M AS (SELECT r, (row_number() OVER (ORDER BY g) - 1) AS x, g, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS v FROM C JOIN D USING (g)) SELECT r, g, round(v / sqrt(SUM(v * v) OVER (PARTITION BY r)), 6) AS v FROM M""",
)
def _(t):
    return rounded(tfidf.word_regex_tfidf(t.documents)).select("r", "g", "v")


@query("tfidf_hashing")
def _(t):
    return tfidf.hashing(t.documents)


@query(
    "tfidf_position_weighted",
    """WITH W AS (SELECT p_partkey AS r, string_split(p_name, '') AS t FROM part), N AS (SELECT UNNEST(range(1, 4)) AS n), P AS (SELECT r, n, t, UNNEST(range(0, len(t) - n + 1)) AS i FROM W, N), A AS (SELECT r, n AS len, i, array_to_string(t[i + 1:i + n], chr(1)) AS g FROM P),
    AC AS (SELECT r, g, count(*) AS n FROM A GROUP BY 1, 2), AD AS (SELECT g, count(*) AS df FROM AC GROUP BY g HAVING count(*) >= 0), AF AS (SELECT g, 0 + row_number() OVER (ORDER BY df, len(replace(g, chr(1), '')), g) - 1 AS c, greatest(ln((SELECT count(*) FROM part) / (df + 1.0)), 0) AS idf FROM AD),
    AV AS (SELECT r, c, g, n * idf AS v, SUM(n * idf * n * idf) OVER (PARTITION BY r) AS s FROM AC JOIN AF USING (g)), AX AS (SELECT r, c, g, CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END AS v FROM AV),
    Q AS (SELECT r, g, SUM(1.0::DOUBLE / (i + 1)) AS w FROM A GROUP BY 1, 2), Z AS (SELECT r, c, v * w AS v FROM AX JOIN Q USING (r, g)) SELECT r, c::BIGINT AS c, round(CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END, 6) AS v FROM (SELECT r, c, v, SUM(v * v) OVER (PARTITION BY r) AS s FROM Z)""",
)
def _(t):
    corpus = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return rounded(tfidf.position_weighted(corpus, tfidf.Tfidf.fit(corpus, tfidf.Options(tokenizer=T.CHAR, ngram_range=(1, 3)))))


@query(
    "tfidf_query_prefix",
    """WITH A AS (SELECT p_partkey AS r, UNNEST(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS g FROM part), B AS (SELECT p_partkey AS r, UNNEST(string_split(substr(p_name, 1, 4), '')) AS g FROM part),
    AC AS (SELECT r, g, count(*) AS n FROM A GROUP BY 1, 2), AD AS (SELECT g, count(*) AS df FROM AC GROUP BY g HAVING count(*) >= 0), AF AS (SELECT g, 0 + row_number() OVER (ORDER BY df, g) - 1 AS c, greatest(ln((SELECT count(*) FROM part) / (df + 1.0)), 0) AS idf FROM AD),
    AV AS (SELECT r, c, g, n * idf AS v, SUM(n * idf * n * idf) OVER (PARTITION BY r) AS s FROM AC JOIN AF USING (g)), AX AS (SELECT r, c, g, CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END AS v FROM AV),
    BC AS (SELECT r, g, count(*) AS n FROM B GROUP BY 1, 2), BD AS (SELECT g, count(*) AS df FROM BC GROUP BY g HAVING count(*) >= 0), BF AS (SELECT g, (SELECT count(*) FROM AD) + row_number() OVER (ORDER BY df, g) - 1 AS c, greatest(ln((SELECT count(*) FROM part) / (df + 1.0)), 0) AS idf FROM BD),
    BV AS (SELECT r, c, g, n * idf AS v, SUM(n * idf * n * idf) OVER (PARTITION BY r) AS s FROM BC JOIN BF USING (g)), BX AS (SELECT r, c, g, CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END AS v FROM BV),
    Z AS (SELECT r, c, v FROM AX UNION ALL SELECT r, c, v FROM BX) SELECT r, c::BIGINT AS c, round(CASE WHEN s > 0 THEN v / sqrt(s) ELSE v END, 6) AS v FROM (SELECT r, c, v, SUM(v * v) OVER (PARTITION BY r) AS s FROM Z)""",
)
def _(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("query"), F.substring("p_name", 1, 4).alias("prefix"))
    q = tfidf.Tfidf.fit(rows, tfidf.Options(), "id", "query")
    p = tfidf.Tfidf.fit(rows, tfidf.Options(tokenizer=T.CHAR), "id", "prefix")
    return rounded(tfidf.query_prefix_features(rows, q, p))


@query(
    "clean_query",
    r"SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim(p_type || '. ' || p_brand)), '[\s.]+'), lambda x: regexp_replace(x, '[^a-z0-9_]+', '', 'g')), lambda x: x <> ''), ' ') AS q FROM part",
)
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.clean_query(F.concat_ws(". ", "p_type", "p_brand")).alias("q"))


@query("prefixes_suffixes", "SELECT p_partkey AS id, substr(p_name, 1, 5) AS pre, p_type || '<@@>' || substr(p_name, 1, 3) AS joined, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS n_suffixes, string_split(p_type, ' ')[len(string_split(p_type, ' '))] AS last_suffix FROM part")
def _(t):
    s = T.word_suffixes("p_type")
    return t.part.select(F.col("p_partkey").alias("id"), T.prefix("p_name", 5).alias("pre"), T.join_prefix(F.col("p_type"), F.substring("p_name", 1, 3)).alias("joined"), F.size(s).cast("long").alias("n_suffixes"), F.element_at(F.split("p_type", " "), -1).alias("last_suffix"))


@query("ranker_prompt", "SELECT p_partkey AS id, trim('query: ' || p_type) AS q, trim('passage: ' || replace(p_brand, '-', ' ') || ' ' || p_name) AS p FROM part")
def _(t):
    q, p = T.ranker_prompt(F.col("p_type"), [F.col("p_brand"), F.col("p_name")], "query: ", "passage: ")
    return t.part.select(F.col("p_partkey").alias("id"), q.alias("q"), p.alias("p"))


# ---------------------------------------------------------------- scans and sinks


@query("labelled_text", "SELECT doc_id AS r, quality::BIGINT AS c, 0.5::DOUBLE AS v FROM labels UNION ALL SELECT doc_id, (10 + toxic)::BIGINT, 1.0::DOUBLE FROM labels")
def _(t):
    lines = t.labels.select(F.col("doc_id").alias("line"), F.concat(F.col("quality"), F.lit(":0.5:2,"), F.col("toxic") + 10, F.lit("::3\tsome text")).alias("text"))
    return readers.label_matrix(readers.parse_labelled(lines, with_relevance=True))


@query("labelled_text_relevance", "SELECT doc_id AS r, quality::BIGINT AS c, 2.0::DOUBLE AS v FROM labels UNION ALL SELECT doc_id, (10 + toxic)::BIGINT, 3.0::DOUBLE FROM labels")
def _(t):
    lines = t.labels.select(F.col("doc_id").alias("line"), F.concat(F.col("quality"), F.lit(":0.5:2,"), F.col("toxic") + 10, F.lit("::3\tsome text")).alias("text"))
    return readers.label_matrix(readers.parse_labelled(lines, with_relevance=True), "rel")


@query("run_file", f"WITH {SUPPLY}, R AS (SELECT r, c, v, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM Q) SELECT r AS inp_id, rank, r::VARCHAR || ' Q0 ' || c::VARCHAR || ' ' || rank::VARCHAR || ' ' || v::VARCHAR || ' run' AS line FROM R")
def _(t):
    return ranked(writers.run_lines(t.supply().select(F.col("r").alias("inp_id"), F.col("c").alias("lbl_id"), F.col("v").alias("score"))))


@query(
    "prediction_lists",
    """WITH S AS (SELECT l_suppkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), R AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM S QUALIFY rank <= 5)
    SELECT r, '{"schema": ["output_item", "score"], "data": [' || string_agg('["' || p_name || '", ' || format('{:.5g}', v)::DOUBLE::VARCHAR || ']', ', ' ORDER BY rank) || ']}' AS line FROM R JOIN part ON p_partkey = c GROUP BY r""",
)
def _(t):
    return writers.prediction_lists(matrix.topk_rows(t.supply(), 5), t.part.select(F.col("p_partkey").alias("c"), F.col("p_name").alias("item")))


# ---------------------------------------------------------------- label embeddings

_LY = f"{CLUSTERS}, NY AS (SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) AS v FROM Y)"
_PIFA = f"{CELLS}, {_LY}, S AS (SELECT NY.c AS r, E.c, SUM(NY.v * E.v) AS v FROM NY JOIN E ON NY.r = E.r GROUP BY 1, 2), P AS (SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) AS v FROM S)"
_Z = "Z AS (SELECT label::BIGINT AS r, 0::BIGINT AS c, 1.0::DOUBLE AS v FROM embeddings GROUP BY 1)"


def _z(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("v")).distinct()


@query("label_features", f"WITH {_PIFA} SELECT r, c, round(v, 6) AS v FROM P")
def _(t):
    return rounded(labels.embed("pifa", t.clusters(), t.cells()))


@query("label_features_concat", f"WITH {_PIFA}, {_Z} SELECT r, c, round(v, 6) AS v FROM P UNION ALL SELECT r, c + 64, v FROM Z")
def _(t):
    return rounded(labels.embed("pifa_lf_concat", t.clusters(), t.cells(), _z(t), 64))


@query("label_features_blend", f"WITH {_PIFA}, {_Z} SELECT r, c, round(SUM(v), 6) AS v FROM (SELECT r, c, 0.3 * v AS v FROM P UNION ALL SELECT r, c, 0.7 * v FROM Z) GROUP BY 1, 2")
def _(t):
    return rounded(labels.embed("pifa_lf_convex_combine", t.clusters(), t.cells(), _z(t), alpha=0.3))


@query("label_instances", f"WITH {CLUSTERS} SELECT c AS r, r AS c, round(v / sqrt(SUM(v * v) OVER (PARTITION BY c)), 6) AS v FROM Y")
def _(t):
    return rounded(labels.embed("pii", t.clusters()))


@query(
    "one_hop_features",
    f"""WITH {CELLS}, {CLUSTERS}, A AS (SELECT vec_id AS r, ((label + 1) % 10)::BIGINT AS c, SUM(2.0)::DOUBLE AS v FROM embeddings GROUP BY 1, 2), NY AS (SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) AS v FROM Y),
    S AS (SELECT NY.c AS r, E.c, SUM(NY.v * E.v) AS v FROM NY JOIN E ON NY.r = E.r GROUP BY 1, 2), L AS (SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) AS v FROM S),
    H1 AS (SELECT A.r, L.c, SUM(A.v * L.v) AS v FROM A JOIN L ON A.c = L.r GROUP BY 1, 2), H2 AS (SELECT Y.r, L.c + 64 AS c, SUM(Y.v * L.v) AS v FROM Y JOIN L ON Y.c = L.r GROUP BY 1, 2),
    U AS (SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) AS v FROM H1 UNION ALL SELECT r, c, v / sqrt(SUM(v * v) OVER (PARTITION BY r)) FROM H2) SELECT r, c, round(v / sqrt(SUM(v * v) OVER (PARTITION BY r)), 6) AS v FROM U""",
)
def _(t):
    near = matrix.coords(t.embeddings, "vec_id", (F.col("label") + 1) % 10, F.lit(2.0))
    return rounded(labels.one_hop(near, t.clusters(), labels.embed("pifa", t.clusters(), t.cells()), (64, 64)))


# ---------------------------------------------------------------- chains

_TREE = "T AS (SELECT 0 AS layer, r_regionkey::BIGINT AS child, 0::BIGINT AS parent FROM region UNION ALL SELECT 1, n_nationkey::BIGINT, n_regionkey::BIGINT FROM nation UNION ALL SELECT 2, c_custkey, c_nationkey::BIGINT FROM customer)"


@query(
    "chain_complete",
    """WITH RECURSIVE L AS (SELECT 1 AS level, 25 AS n UNION ALL SELECT level + 1, CASE WHEN n > 2 THEN (n + 1) // 2 ELSE 1 END FROM L WHERE n > 1), D AS (SELECT max(level) AS depth FROM L)
    SELECT (depth - 1)::INTEGER AS layer, c_custkey AS child, c_nationkey::BIGINT AS parent FROM customer, D
    UNION ALL SELECT (depth - 1 - level)::INTEGER, i::BIGINT, CASE WHEN n > 2 THEN (i // 2)::BIGINT ELSE 0 END FROM (SELECT level, n, UNNEST(range(n)) AS i FROM L WHERE n > 1), D""",
)
def _(t):
    return chains.complete(t.customer.select(F.col("c_custkey").alias("child"), F.col("c_nationkey").cast("long").alias("parent")), 25, 2, 2)


@query("chain_check", f"WITH {_TREE} SELECT layer, child FROM T WHERE layer = 0 AND parent <> 0")
def _(t):
    return chains.check(t.tree())


_UP = f"{BOUGHT}, U2 AS (SELECT r, c_nationkey::BIGINT AS c, SUM(v) AS v FROM B JOIN customer ON c_custkey = B.c GROUP BY 1, 2), U1 AS (SELECT r, n_regionkey::BIGINT AS c, SUM(v) AS v FROM U2 JOIN nation ON n_nationkey = U2.c GROUP BY 1, 2), U0 AS (SELECT r, 0::BIGINT AS c, SUM(v) AS v FROM U1 GROUP BY 1)"


@query("label_hierarchy", f"WITH {_UP} SELECT * FROM U1")
def _(t):
    return chains.label_hierarchy(t.bought(), t.tree(), 1)


@query("matching_chain", f"WITH {_UP}, M2 AS (SELECT r, c, SUM(v) AS v FROM (SELECT * FROM U2 UNION ALL SELECT 1, 3, 5.0) GROUP BY 1, 2), M1 AS (SELECT r, n_regionkey::BIGINT AS c, SUM(v) AS v FROM M2 JOIN nation ON n_nationkey = M2.c GROUP BY 1, 2), M0 AS (SELECT r, 0::BIGINT AS c, SUM(v) AS v FROM M1 GROUP BY 1) SELECT 2 AS layer, * FROM M2 UNION ALL SELECT 1, * FROM M1 UNION ALL SELECT 0, * FROM M0")
def _(t):
    own = t.spark.createDataFrame([(1, 3, 5.0)], readers.COORDS)
    return chains.matching_chain({3: t.bought(), 2: own}, t.tree())


@query("relevance_chain", f"WITH {_UP} SELECT 3 AS layer, r, c, round(v / SUM(v) OVER (PARTITION BY r), 8) AS v FROM B UNION ALL SELECT 2, r, c, round(v / SUM(v) OVER (PARTITION BY r), 8) FROM U2 UNION ALL SELECT 1, r, c, round(v / SUM(v) OVER (PARTITION BY r), 8) FROM U1")
def _(t):
    return rounded(chains.relevance_chain({3: t.bought()}, t.tree(), "l1"), 8)


@query("chain_shorten", f"WITH {_TREE} SELECT * FROM T WHERE layer = 0 UNION ALL SELECT 1, c_custkey, n_regionkey::BIGINT FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    return chains.shorten(t.tree(), 2)


@query("chain_extend", f"WITH {_TREE} SELECT * FROM T UNION ALL SELECT 3, c_custkey, c_custkey FROM customer UNION ALL SELECT 4, c_custkey, c_custkey FROM customer")
def _(t):
    return chains.extend(t.tree(), 5)


@query(
    "prefix_chain",
    """WITH P1 AS (SELECT p, (row_number() OVER (ORDER BY p) - 1)::BIGINT AS id FROM (SELECT DISTINCT substr(p_type, 1, 1) AS p FROM part)), P2 AS (SELECT p, (row_number() OVER (ORDER BY p) - 1)::BIGINT AS id FROM (SELECT DISTINCT substr(p_type, 1, 2) AS p FROM part))
    SELECT 0 AS layer, id AS child, 0::BIGINT AS parent FROM P1 UNION ALL SELECT 1, P2.id, P1.id FROM P2 JOIN P1 ON P1.p = substr(P2.p, 1, 1) UNION ALL SELECT 2, p_partkey, P2.id FROM part JOIN P2 ON P2.p = substr(p_type, 1, 2)""",
)
def _(t):
    return chains.prefix_chain(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), 2)


@query(
    "overlapping_clusters",
    f"WITH {BOUGHT}, M AS (SELECT r, c_nationkey::BIGINT AS c, SUM(v) AS v FROM B JOIN customer ON c_custkey = B.c GROUP BY 1, 2), N AS (SELECT B.c AS r, M.c, SUM(B.v * M.v) AS v FROM B JOIN M ON M.r = B.r GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM N QUALIFY rank <= 2",
)
def _(t):
    y = t.bought()
    return ranked(chains.overlapping_clusters(y, chains.lift(y, t.tree(), 2), 2))


@query(
    "bin_labels",
    """SELECT c_nationkey::BIGINT AS cluster, count(*) AS labels, ((count(*) + 4) // 5)::BIGINT AS bins, least(count(*), 5)::BIGINT AS most FROM customer GROUP BY 1""",
)
def _(t):
    """What bins have to be, whatever the shuffle: all labels, as few bins as hold them."""
    bins = chains.bin_labels(t.customer.select(F.col("c_custkey").alias("label"), F.col("c_nationkey").cast("long").alias("cluster")), 5)
    sizes = bins.groupBy("cluster", "bin").agg(F.countDistinct("label").alias("n"))
    return sizes.groupBy("cluster").agg(F.sum("n").alias("labels"), F.count("*").alias("bins"), F.max("n").alias("most"))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(
    "balanced_kmeans",
    """WITH RECURSIVE D AS (SELECT greatest(1, ceil(log2(greatest(2, count(*)) / 100.0)))::BIGINT AS depth, count(*)::BIGINT AS n FROM embeddings), S AS (SELECT 0::BIGINT AS d, 0::BIGINT AS node, n FROM D UNION ALL
    SELECT d + 1, node * 2 + side, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END FROM S, (SELECT UNNEST([0, 1]) AS side) WHERE d < (SELECT depth FROM D)) SELECT node AS leaf, n AS members FROM S WHERE d = (SELECT depth FROM D)""",
)
def _(t):
    """Sizes of the leaves: each layer halves every node exactly."""
    codes = chains.balanced_kmeans(_vectors(t), max_leaf_size=100, max_iter=5)
    return codes.groupBy(F.col("parent").alias("leaf")).agg(F.countDistinct("child").alias("members"))


@query(
    "must_link_kmeans",
    """SELECT vec_id % 100 AS grp, count(*) AS members, 1::BIGINT AS leaves, true AS small FROM embeddings GROUP BY 1""",
)
def _(t):
    """Each group in one leaf, and no leaf of two or more groups over the bound."""
    group = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("group"))
    codes = scratch.settle(chains.must_link_kmeans(_vectors(t), group, max_leaf_size=40, max_iter=3), "codes")
    both = codes.join(group, F.col("child") == F.col("id"))
    leaf = both.groupBy("parent").agg((F.count("*") <= 40) | (F.countDistinct("group") == 1)).toDF("parent", "ok")
    return both.join(leaf, "parent").groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("members"), F.countDistinct("parent").alias("leaves"), F.min("ok").alias("small"))


@query(
    "hybrid_chain",
    """SELECT 'k' || (label::VARCHAR)[1:1] AS prefix, count(*) AS members, true AS balanced, true AS own FROM embeddings GROUP BY 1""",
)
def _(t):
    """Of each prefix: its labels, whether no leaf has more than allowed, and whether none is shared with another prefix."""
    names = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("k"), F.col("label")).alias("name"))
    chain = scratch.settle(chains.hybrid_chain(names, _vectors(t), 2, 40, max_iter=3), "chain")
    last = chains.layer_of(chain, chains.depth_of(chain) - 1).join(names, F.col("child") == F.col("id")).withColumn("prefix", F.substring("name", 1, 2))
    leaf = last.groupBy("parent").agg((F.count("*") <= 40).alias("balanced"), (F.countDistinct("prefix") == 1).alias("own"))
    return last.join(leaf, "parent").groupBy("prefix").agg(F.count("*").alias("members"), F.min("balanced").alias("balanced"), F.min("own").alias("own"))


# ---------------------------------------------------------------- neighbours

_IP = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = lambda d: f"SELECT a.vec_id AS q, b.vec_id AS i, {d} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10"


def _asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))


@query("knn_ip", f"SELECT q, i, round(d, 6) + 0.0 AS dist, rank FROM ({_KNN('1 - ' + _IP)})")
def _(t):
    return ranked(rounded(knn.exact_knn(*_asked(t), 10), 6, "dist"))


@query("knn_l2", f"SELECT q, i, round(d, 6) AS dist, rank FROM ({_KNN('power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)')})")
def _(t):
    return ranked(rounded(knn.exact_knn(*_asked(t), 10, "l2"), 6, "dist"))


@query("pairwise_knn", f"SELECT q, label::BIGINT AS label, i, round(d, 6) + 0.0 AS dist, rank FROM (SELECT a.vec_id AS q, b.vec_id AS i, b.label AS label, 1 - {_IP} AS d, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY 1 - {_IP}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label = a.vec_id % 7 QUALIFY rank <= 5)")
def _(t):
    q, i = _asked(t)
    rows = t.embeddings.select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("i"))
    return ranked(rounded(knn.pairwise_knn(q.withColumn("label", F.col("q") % 7), rows, i, 5), 6, "dist"))


@query("neighbour_vote", f"SELECT q AS r, label::BIGINT AS c, round(SUM(1 - d), 6) AS v FROM ({_KNN('1 - ' + _IP)}) JOIN embeddings ON vec_id = i GROUP BY 1, 2")
def _(t):
    return rounded(knn.neighbour_vote(knn.exact_knn(*_asked(t), 10), t.clusters()))


@query("two_index_blend", f"WITH N AS ({_KNN('1 - ' + _IP)}), V AS (SELECT q AS r, label::BIGINT AS c, SUM(1 - d) AS v FROM N JOIN embeddings ON vec_id = i GROUP BY 1, 2) SELECT r, c, round(SUM(v), 6) AS v FROM (SELECT q AS r, i AS c, 0.4 * (1 - d) AS v FROM N UNION ALL SELECT r, c, 0.6 * v FROM V) GROUP BY 1, 2")
def _(t):
    n = knn.exact_knn(*_asked(t), 10)
    return rounded(knn.two_index_blend(knn.as_predictions(n), knn.neighbour_vote(n, t.clusters()), 0.4))


@query("knn_quantized")
def _(t):
    q, i = _asked(t)
    return knn.ProductQuantizer.train(i, 8).search(q, i, 10, 200)


@query("knn_graph")
def _(t):
    q, i = _asked(t)
    return knn.graph_knn(i, q, 10)


# ---------------------------------------------------------------- stores


@query(
    "map_lookup",
    """SELECT p_partkey AS id, coalesce(n, -1)::BIGINT AS value FROM part LEFT JOIN (SELECT c_custkey, max(c_nationkey) AS n FROM customer GROUP BY 1) ON c_custkey = p_partkey * 2""",
)
def _(t):
    table = stores.build_map(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value")))
    return stores.lookup(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2).alias("key")), table, -1).select("id", "value")


@query(
    "map_contains",
    """SELECT p_partkey AS id, p_partkey * 2 IN (SELECT c_custkey FROM customer) AS found FROM part""",
)
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("key"))
    return stores.contains(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2).alias("key")), table).select("id", "found")


@query("store_submatrix", "SELECT i, j, embedding[col + 1]::DOUBLE AS value FROM (SELECT s_suppkey AS i, s_suppkey * 3 AS row FROM supplier), (SELECT n_nationkey::BIGINT AS j, (24 - n_nationkey)::BIGINT AS col FROM nation), embeddings WHERE vec_id = row".replace(" row ", " rw ").replace("AS row", "AS rw").replace("= row", "= rw"))
def _(t):
    store = stores.store_from_dense(t.embeddings, "vec_id", "embedding")
    rows = t.supplier.select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 3).alias("row"))
    cols = t.nation.select(F.col("n_nationkey").cast("long").alias("j"), (24 - F.col("n_nationkey")).cast("long").alias("col"))
    return stores.submatrix(store, rows, cols).withColumn("value", F.col("value").cast("double"))


_KEYED = "K1 AS (SELECT p_brand AS row_key, p_type AS col_key, SUM(p_size)::DOUBLE AS v FROM part GROUP BY 1, 2), K2 AS (SELECT p_brand AS row_key, l_returnflag AS col_key, SUM(l_quantity)::DOUBLE AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 UNION ALL SELECT p_brand, p_type, SUM(p_retailprice)::DOUBLE FROM part GROUP BY 1, 2)"


def _keyed(t: Tables) -> tuple[DataFrame, DataFrame]:
    shipped = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    second = stores.keyed_from(shipped, "p_brand", "l_returnflag", "l_quantity").unionByName(stores.keyed_from(t.part, "p_brand", "p_type", "p_retailprice"))
    return stores.keyed_from(t.part, "p_brand", "p_type", "p_size"), second


for _how, _expr, _join in (("replace", "coalesce(K2.v, K1.v)", "FULL JOIN"), ("add", "coalesce(K1.v, 0) + coalesce(K2.v, 0)", "FULL JOIN"), ("max", "greatest(coalesce(K1.v, 0), coalesce(K2.v, 0))", "FULL JOIN"), ("min", "least(K1.v, K2.v)", "JOIN")):
    query(f"keyed_{_how}", f"WITH {_KEYED} SELECT row_key, col_key, round({_expr}, 4) AS v FROM K1 {_join} K2 USING (row_key, col_key)")(lambda t, h=_how: rounded(stores.keyed_merge(*_keyed(t), h), 4))


@query("keyed_select", f"WITH {_KEYED} SELECT * FROM K1 WHERE row_key IN ('Brand#11', 'Brand#22')")
def _(t):
    return stores.keyed_select(_keyed(t)[0], ["Brand#11", "Brand#22"])


@query("keyed_append", f"WITH {_KEYED}, N AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Brand#' || (10 + n_nationkey) END AS row_key, r_name AS col_key, n_nationkey + 1.0::DOUBLE AS v FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT row_key, col_key, round(v, 4) AS v FROM K1 UNION ALL SELECT row_key, col_key, v FROM N WHERE row_key NOT IN (SELECT row_key FROM K1)")
def _(t):
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Brand#"), (10 + F.col("n_nationkey")).cast("string")))
    more = stores.keyed_from(named.withColumn("key", key).withColumn("n", F.col("n_nationkey") + 1), "key", "r_name", "n")
    return rounded(stores.keyed_append(_keyed(t)[0], more), 4)


@query("merge_index", "SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS id FROM (SELECT DISTINCT p_brand AS name FROM part UNION SELECT n_name FROM nation)")
def _(t):
    return stores.merge_index(t.part.select(F.col("p_brand").alias("name")), t.nation.select(F.col("n_name").alias("name")))


@query(
    "prefix_suggestions",
    """WITH C AS (SELECT p_type AS name, count(*) AS freq FROM part GROUP BY 1), S AS (SELECT n_nationkey::BIGINT AS q, (SELECT substr(p_type, 1, 2 + n_nationkey % 4) FROM part WHERE p_partkey = n_nationkey + 1) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '!' END AS prefix FROM nation),
    A AS (SELECT q, substr(prefix, 1, i::BIGINT) AS p FROM (SELECT q, prefix, UNNEST(range(0, length(prefix) + 1)) AS i FROM S)), H AS (SELECT q, name, MAX(length(p)) AS len, MAX(freq) AS freq FROM A JOIN C ON starts_with(name, p) GROUP BY 1, 2)
    SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY len DESC, freq DESC, name) AS rank FROM H QUALIFY rank <= 10""",
)
def _(t):
    counts = t.part.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("freq"))
    first = t.part.select((F.col("p_partkey") - 1).alias("k"), "p_type")
    n = F.col("n_nationkey")
    ask = t.nation.join(first, n == F.col("k")).select(n.cast("long").alias("q"), F.concat(F.col("p_type").substr(F.lit(1), 2 + n % 4), F.when(n % 2 == 0, "").otherwise("!")).alias("prefix"))
    return ranked(stores.suggestions(counts, ask, 10))


# ---------------------------------------------------------------- sessions, pairs, ranker

_SESS = "L AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800 * 1000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), S AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM L)"


def _log(t: Tables) -> DataFrame:
    return sessions.sessions(t.events.select("event_id", "user_id", "ts", "event_type"), 1800, "user_id", "ts", "event_id")


@query("sessions", f"WITH {_SESS} SELECT event_id, user_id, session FROM S")
def _(t):
    return _log(t).select("event_id", "user_id", "session")


@query("session_bounds", f"WITH {_SESS} SELECT user_id, session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM S GROUP BY 1, 2")
def _(t):
    b = sessions.session_bounds(_log(t), "user_id", "ts")
    return b.select("user_id", "session", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


_DEDUP = f"{_SESS}, R AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS before FROM S), K AS (SELECT * FROM R WHERE before IS NULL OR before <> event_type), N AS (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS n FROM K)"


@query("session_dedup", f"WITH {_DEDUP} SELECT event_id, user_id, session, event_type FROM N WHERE n >= 2")
def _(t):
    return sessions.drop_repeats(_log(t), "event_type", "user_id", "ts", "event_id").select("event_id", "user_id", "session", "event_type")


@query("query_pairs", f"WITH {_DEDUP}, P AS (SELECT user_id, session, event_type AS prev_query, lead(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS next_query FROM N WHERE n >= 2) SELECT * FROM P WHERE next_query IS NOT NULL")
def _(t):
    return sessions.consecutive_pairs(sessions.drop_repeats(_log(t), "event_type", "user_id", "ts", "event_id"), "event_type", "user_id", "ts", "event_id")


@query("conversation_pairs", "SELECT conv_id, turn, text AS prev_query, nxt AS next_query FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.conversations.withColumn("next_query", F.lead("text").over(w)).where("next_query is not null").select("conv_id", "turn", F.col("text").alias("prev_query"), "next_query")


def _targets(t: Tables) -> DataFrame:
    g = t.parts().groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("g"))
    return g.select(F.col("r").alias("inp_id"), F.col("g.c").alias("lbl_id"), F.col("g.v").alias("score"))


@query("ranker_mean_split", f"WITH {PARTS} SELECT r AS inp_id, c AS lbl_id, v AS score, v > AVG(v) OVER (PARTITION BY r) AS positive FROM X")
def _(t):
    return ranker.mean_split(_targets(t))


@query(
    "ranker_pairs",
    """WITH X AS (SELECT l_orderkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) SELECT r AS inp_id, true AS ordered, true AS known FROM X GROUP BY r HAVING min(v) < max(v)""",
)
def _(t):
    """Inputs that have a pair, whether it is ordered, and whether both labels have the scores that they are given."""
    pairs = ranker.pairwise_sample(_targets(t))
    each = ranker.explode_targets(_targets(t))
    side = lambda c, s: each.select(F.col("inp_id"), F.col("lbl_id").alias(c), F.col("score").alias(s))
    found = pairs.join(side("better", "b"), ["inp_id", "better"]).join(side("worse", "w"), ["inp_id", "worse"])
    return found.select("inp_id", (F.col("better_score") > F.col("worse_score")).alias("ordered"), ((F.col("b") == F.col("better_score")) & (F.col("w") == F.col("worse_score"))).alias("known"))


@query(
    "ranker_lists",
    """WITH X AS (SELECT l_orderkey AS r, l_partkey AS c, SUM(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), M AS (SELECT r, v, AVG(v) OVER (PARTITION BY r) AS m FROM X) SELECT r AS inp_id, 3::INTEGER AS n, true AS first_is_best FROM M GROUP BY r HAVING count(*) FILTER (v > m) >= 1 AND count(*) FILTER (v <= m) >= 2""",
)
def _(t):
    """Inputs that have a list, its length, and whether the first score is over all others."""
    return ranker.listwise_sample(_targets(t), 3).select("inp_id", F.size(F.array_distinct("lbl_ids")).alias("n"), (F.col("scores")[0] > F.array_max(F.slice("scores", 2, 3))).alias("first_is_best"))


@query("ranker_padding", f"WITH {PARTS}, G AS (SELECT r, list(c ORDER BY c) AS l FROM X GROUP BY r) SELECT r AS inp_id, array_to_string(list_transform(range(1, 6), lambda i: coalesce(l[i], -1)), ',') AS lbl_id FROM G")
def _(t):
    return ranker.pad_labels(_targets(t), "lbl_id", 5).select("inp_id", F.array_join("lbl_id", ",").alias("lbl_id"))


@query("ranker_store_join", f"WITH {PARTS} SELECT r AS inp_id, c AS lbl_id, o_orderpriority AS keywords, p_name AS title FROM X JOIN orders ON o_orderkey = r JOIN part ON p_partkey = c".replace("= r JOIN", "= X.r JOIN").replace("p_partkey = c", "p_partkey = X.c"))
def _(t):
    pairs = t.parts().select(F.col("r").alias("inp_id"), F.col("c").alias("lbl_id"))
    out = ranker.join_stores(pairs, t.orders.select(F.col("o_orderkey").alias("inp_id"), F.col("o_orderpriority").alias("keywords")), t.part.select(F.col("p_partkey").alias("lbl_id"), F.col("p_name").alias("title")))
    return out.select("inp_id", "lbl_id", "keywords", "title")


@query(
    "ranker_scores",
    """SELECT l_orderkey AS inp_id, l_partkey AS lbl_id, SUM(l_quantity)::DOUBLE * 2 AS score FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    pairs = t.parts().select(F.col("r").alias("inp_id"), F.col("c").alias("lbl_id"), "v")
    return ranker.score_pairs(pairs, lambda pdf: pdf["v"] * 2, ["v"])