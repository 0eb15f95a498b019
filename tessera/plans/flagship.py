"""Documents similar to benchmark items: scan, tokens, TF-IDF, sparse product, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix
from .catalog import Tables, query, ranked, rounded
from .tfidf import Options, Tfidf

K = 5


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r: item_id, c: doc_id, v: cosine, rank)."""
    t = Tables(spark, sf_dir)
    model = Tfidf.fit(t.documents, Options(max_df_ratio=0.1))
    docs = model.transform(t.documents)
    items = model.transform(t.benchmark, "item_id")
    return ranked(matrix.topk_rows(rounded(matrix.matmul(items, matrix.transpose(docs)), 9), K))


_TF = lambda table, key: f"SELECT {key} AS r, g, count(*) AS n FROM (SELECT {key}, UNNEST(list_filter(string_split(text, ' '), lambda x: x <> '')) AS g FROM {table}) GROUP BY 1, 2"
_VEC = lambda tf: f"SELECT r, g, n * idf / sqrt(SUM(n * idf * n * idf) OVER (PARTITION BY r)) AS v FROM {tf} JOIN F USING (g)"


@query(
    "similar_documents",
    f"""WITH C AS ({_TF('documents', 'doc_id')}), B AS ({_TF('benchmark', 'item_id')}), D AS (SELECT g, count(*) AS df FROM C GROUP BY g HAVING count(*) <= round(0.1 * (SELECT count(*) FROM documents))),
    F AS (SELECT g, greatest(ln((SELECT count(*) FROM documents) / (df + 1.0)), 0) AS idf FROM D), X AS ({_VEC('C')}), Y AS ({_VEC('B')}),
    S AS (SELECT Y.r, X.r AS c, round(SUM(X.v * Y.v), 9) AS v FROM X JOIN Y USING (g) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS rank FROM S QUALIFY rank <= {K}""",
)
def _(t):
    return similar_documents(t.spark, t.dir)
