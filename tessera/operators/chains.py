"""Label trees as one table: (layer, child, parent); layer 0 is just under the root, whose id is 0, and the last layer's children are the labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import dot
from ..scratch import settle
from .matrix import add, matmul, topk_rows, transpose
from .numbering import number_rows


def layer_of(chain: DataFrame, layer: int) -> DataFrame:
    return chain.where(F.col("layer") == layer).select("child", "parent")


def depth_of(chain: DataFrame) -> int:
    return (chain.agg(F.max("layer")).first()[0] or 0) + 1


def complete(codes: DataFrame, n_codes: int, min_codes: int | None = None, nr_splits: int = 16) -> DataFrame:
    """A chain over (child, parent) codes: consecutive codes are grouped by ``nr_splits`` until ``min_codes`` (``nr_splits`` if None) or fewer are left, then the root."""
    least = nr_splits if min_codes is None else min_codes
    sizes = [n_codes]
    while sizes[-1] > max(1, least) and sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // nr_splits))
    if sizes[-1] != 1:
        sizes.append(1)
    depth = len(sizes)
    parts = [codes.select(F.lit(depth - 1).alias("layer"), F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))]
    nodes = codes.sparkSession.range(n_codes).withColumnRenamed("id", "child")
    for level, size in enumerate(sizes[1:], 1):
        whole = size == 1
        parent = F.lit(0).cast("long") if whole else F.floor(F.col("child") / nr_splits)
        parts.append(nodes.select(F.lit(depth - 1 - level).alias("layer"), "child", parent.alias("parent")))
        nodes = codes.sparkSession.range(size).withColumnRenamed("id", "child")
    return reduce(DataFrame.unionByName, parts)


def check(chain: DataFrame) -> DataFrame:
    """(layer, child) of the nodes whose parent is not a child of the layer above (of layer 0: is not the root); none in a sound chain."""
    above = chain.select((F.col("layer") + 1).alias("layer"), F.col("child").alias("parent")).distinct()
    bad = chain.where("layer > 0").join(above, ["layer", "parent"], "left_anti").select("layer", "child")
    return bad.unionByName(chain.where("layer = 0 and parent <> 0").select("layer", "child"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    cols = ["layer", "child", "parent"]
    a, b = a.select(*cols).distinct(), b.select(*cols).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lift(m: DataFrame, chain: DataFrame, layer: int, binary: bool = False) -> DataFrame:
    """M C: entries of the children of ``layer`` summed (or marked) at their parents."""
    up = matmul(m, layer_of(chain, layer).select(F.col("child").alias("r"), F.col("parent").alias("c"), F.lit(1.0).alias("v")))
    return up.withColumn("v", F.lit(1.0)) if binary else up


def label_hierarchy(y: DataFrame, chain: DataFrame, level: int) -> DataFrame:
    """Y summed up to the parents of ``level``."""
    for layer in range(depth_of(chain) - 1, level - 1, -1):
        y = lift(y, chain, layer)
    return y


def matching_chain(by_layer: dict[int, DataFrame], chain: DataFrame) -> DataFrame:
    """(layer, r, c, v): user matches of each layer's parents plus what comes up from below; ``by_layer[depth]``: on labels. Values are counts."""
    depth = depth_of(chain)
    below, parts = by_layer.get(depth), []
    for layer in range(depth - 1, -1, -1):
        up = lift(below, chain, layer) if below is not None else None
        own = by_layer.get(layer)
        below = up if own is None else own if up is None else add(up, own)
        if below is not None:
            below = settle(below, "match")
            parts.append(below.select(F.lit(layer).alias("layer"), "r", "c", "v"))
    return reduce(DataFrame.unionByName, parts)


def relevance_chain(by_layer: dict[int, DataFrame], chain: DataFrame, norm: str | None = None, induce: bool = True) -> DataFrame:
    """(layer, r, c, v): as ``matching_chain``, rows normalized if asked, over all layers but the root's; not lifted if not ``induce``."""
    from .matrix import normalize_rows

    depth = depth_of(chain)
    below, parts = None, []
    for layer in range(depth, 0, -1):
        up = lift(below, chain, layer) if below is not None and induce and layer < depth else None
        own = by_layer.get(layer)
        below = up if own is None else own if up is None else add(up, own)
        if below is not None:
            below = settle(below, "relevance")
            out = normalize_rows(below, norm) if norm else below
            parts.append(out.select(F.lit(layer).alias("layer"), "r", "c", "v"))
    return reduce(DataFrame.unionByName, parts)


def shorten(chain: DataFrame, length: int) -> DataFrame:
    """Bottom layers are composed until ``length`` are left."""
    depth = depth_of(chain)
    if length >= depth:
        return chain
    cur = layer_of(chain, depth - 1)
    for layer in range(depth - 2, length - 2, -1):
        up = layer_of(chain, layer).select(F.col("child").alias("parent"), F.col("parent").alias("top"))
        cur = cur.join(up, "parent").select("child", F.col("top").alias("parent"))
    return chain.where(F.col("layer") < length - 1).unionByName(cur.select(F.lit(length - 1).alias("layer"), "child", "parent"))


def extend(chain: DataFrame, length: int) -> DataFrame:
    """Identity layers under the last until ``length`` are there."""
    depth = depth_of(chain)
    leaves = chain.where(F.col("layer") == depth - 1).select("child").distinct()
    more = [leaves.select(F.lit(d).alias("layer"), "child", F.col("child").alias("parent")) for d in range(depth, length)]
    return reduce(DataFrame.unionByName, [chain, *more])


def concatenate(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom.withColumn("layer", F.col("layer") + depth_of(top)))


def prefix_chain(labels: DataFrame, depth: int) -> DataFrame:
    """Chain over label strings (id, name): nodes are the distinct prefixes of 1 to ``depth`` characters in byte order; labels are the last layer."""
    parts, above = [], None
    for d in range(1, depth + 1):
        pre = labels.select(F.col("name").substr(1, d).alias("p")).distinct()
        ids = number_rows(pre, ["p"], "child")
        parent = F.lit(0).cast("long")
        if above is not None:
            ids = ids.join(above.select(F.col("p").alias("up"), F.col("child").alias("parent")), F.col("p").substr(1, d - 1) == F.col("up"))
            parent = F.col("parent")
        parts.append(ids.select(F.lit(d - 1).alias("layer"), "child", parent.alias("parent")))
        above = ids.select("p", "child")
    last = labels.join(above.withColumnRenamed("child", "parent"), F.col("name").substr(1, depth) == F.col("p"))
    parts.append(last.select(F.lit(depth).alias("layer"), F.col("id").cast("long").alias("child"), "parent"))
    return reduce(DataFrame.unionByName, parts)


def overlapping_clusters(y: DataFrame, m: DataFrame, n_clusters: int) -> DataFrame:
    """(r: label, c: cluster, v: count, rank): each label's ``n_clusters`` most frequent clusters among its instances."""
    return topk_rows(matmul(transpose(y), m), n_clusters)


def bin_labels(cluster_of: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(label, cluster, bin): labels of a cluster, shuffled by seeded hash, ``size`` to a bin."""
    w = Window.partitionBy("cluster").orderBy(F.xxhash64("label", F.lit(seed)), "label")
    return cluster_of.withColumn("bin", F.floor((F.row_number().over(w) - 1) / size))


def sample_rate(layer: int, depth: int, least: float, most: float, warmup: float) -> float:
    """Share of elements that the centres of a layer are fitted on: ``least`` during the warm-up share of layers, then up to ``most`` in a line."""
    warm = math.floor(depth * warmup)
    if layer < warm:
        return least
    return most if depth - 1 <= warm else least + (most - least) * (layer - warm) / (depth - 1 - warm)


#: Nodes whose centres or bounds are broadcast; where there are more, each has few elements, and a shuffled join has no hot key.
BROADCAST_NODES = 20_000


def _with_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` joined with a table of a row a node."""
    nodes = settle(nodes, "nodes")
    return rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node")


def _halves(scored: DataFrame, weighted: bool) -> DataFrame:
    """``side`` 0 or 1 for each element of (id, w, node, score, ...): the half of its node's weight, by score and id, that its middle lies in.

    The order runs over all nodes at once, by range partitions and their sums; no node is brought to one task.
    """
    placed = number_rows(scored, ["node", "score", "id"], "at", weight="w" if weighted else None)
    bounds = placed.groupBy("node").agg(F.min("at").alias("start"), F.sum("w").alias("total"))
    return _with_nodes(placed, bounds).withColumn("side", F.when(F.col("at") - F.col("start") + F.col("w") / 2 < F.col("total") / 2, 0).otherwise(1)).drop("at", "start", "total", "score")


def balanced_kmeans(
    vectors: DataFrame, max_leaf_size: int = 100, max_iter: int = 20, spherical: bool = True, seed: int = 0, id_col: str = "id", vec_col: str = "vec",
    min_sample_rate: float = 1.0, max_sample_rate: float = 1.0, warmup_ratio: float = 1.0, start: DataFrame | None = None, weight: DataFrame | None = None,
) -> DataFrame:
    """Codes (child, parent) of a balanced hierarchical 2-means; child: the element's id, parent: its leaf.

    All nodes of a layer are split together. Each step sums the halves' vectors, scores every element by its product with the difference of its node's two
    centres, and cuts each node at the median: the lower ``floor(n / 2)`` go left, ties by id. A step's result is written, so lineage stays short.

    ``start`` (id, node): clusters to begin with, which are never mixed; ``weight`` (id, w): what an element counts for. With either, only nodes over ``max_leaf_size`` are split, until none is
    left but those of one element.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"))
    rows = rows.join(weight.select("id", F.col("w").cast("long").alias("w")), "id") if weight is not None else rows.withColumn("w", F.lit(1).cast("long"))
    rows = rows.join(start.select("id", F.col("node").cast("long").alias("node")), "id") if start is not None else rows.withColumn("node", F.lit(0).cast("long"))
    state = settle(rows, "kmeans")
    as_needed = start is not None or weight is not None
    n = state.count()
    if n == 0 or not as_needed and max_leaf_size >= n:
        return state.select(F.col("id").alias("child"), F.col("node").alias("parent"))
    dim = state.select(F.size("vec")).first()[0]
    largest = state.groupBy("node").agg(F.sum("w").alias("s")).agg(F.max("s")).first()[0]
    depth = max(1, math.ceil(math.log2(max(2, largest) / max_leaf_size)))
    layer = 0
    while layer < depth or as_needed:
        rate = sample_rate(min(layer, depth - 1), depth, min_sample_rate, max_sample_rate, warmup_ratio)
        idle = None
        active = state
        if as_needed:
            sizes = settle(state.groupBy("node").agg((~((F.sum("w") > max_leaf_size) & (F.count("*") > 1))).alias("done")), "nodes")
            if sizes.where(~F.col("done")).isEmpty():
                break
            both = _with_nodes(state, sizes)
            active, idle = settle(both.where(~F.col("done")).drop("done"), "kmeans"), both.where("done").drop("done")
        # two elements to begin with: one by seeded hash, and the one least like it
        a = active.groupBy("node").agg(F.min_by("vec", F.struct(F.xxhash64("id", F.lit(seed + layer)), "id")).alias("a"))
        begun = settle(_with_nodes(active, a), "kmeans")
        b = begun.groupBy("node").agg(F.min_by("vec", F.struct(dot("vec", "a"), "id")).alias("b"))
        begun = _with_nodes(begun, b).withColumn("score", dot("vec", F.zip_with("b", "a", lambda x, y: x - y))).drop("a", "b")
        now = settle(_halves(begun, weight is not None).select("id", "vec", "w", "node", "side"), "kmeans")
        for _ in range(max_iter):
            fitted = now if rate >= 1 else now.where(F.pmod(F.xxhash64("id", F.lit(seed + layer)), F.lit(1 << 20)) < int(rate * (1 << 20)))
            sums = fitted.groupBy("node", "side").agg(F.array(*(F.sum(F.col("vec")[i]) for i in range(dim))).alias("s"), F.sum("w").alias("k"))
            length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
            size = F.when(length > 0, length).otherwise(F.lit(1.0)) if spherical else F.col("k").cast("double")
            centres = sums.withColumn("s", F.transform("s", lambda x: x / size)).groupBy("node").agg(F.max(F.when(F.col("side") == 1, F.col("s"))).alias("hi"), F.max(F.when(F.col("side") == 0, F.col("s"))).alias("lo"))
            zero = F.array_repeat(F.lit(0.0), dim)
            gap = F.zip_with(F.coalesce("hi", zero), F.coalesce("lo", zero), lambda a, b: a - b)
            scored = _with_nodes(now, centres.select("node", gap.alias("gap")))
            score = F.aggregate(F.zip_with("vec", "gap", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
            new = settle(_halves(scored.withColumnRenamed("side", "old").withColumn("score", score).drop("gap"), weight is not None).select("id", "vec", "w", "node", "old", "side"), "kmeans")
            moved = not new.where("old <> side").isEmpty()
            now = new.drop("old")
            if not moved:
                break
        state = now.select("id", "vec", "w", (F.col("node") * 2 + F.col("side")).alias("node"))
        if idle is not None:
            state = state.unionByName(idle.select("id", "vec", "w", (F.col("node") * 2).alias("node")))
        state = settle(state, "kmeans")
        layer += 1
    return state.select(F.col("id").alias("child"), F.col("node").alias("parent"))


def must_link_kmeans(vectors: DataFrame, group: DataFrame, max_leaf_size: int = 100, **kw) -> DataFrame:
    """As ``balanced_kmeans`` over groups (id, group) whose members stay together: a group is the sum of its vectors and weighs as many as it has members, so leaves are balanced in elements."""
    dim = vectors.select(F.size("vec")).first()[0]
    joined = vectors.join(group, "id")
    groups = settle(joined.groupBy("group").agg(F.array(*(F.sum(F.col("vec")[i]) for i in range(dim))).alias("vec"), F.count("*").alias("w")).withColumnRenamed("group", "id"), "groups")
    codes = balanced_kmeans(groups.select("id", "vec"), max_leaf_size, weight=groups.select("id", "w"), **kw)
    return group.join(codes.select(F.col("child").alias("group"), "parent"), "group").select(F.col("id").alias("child"), "parent")


def pre_clustered_kmeans(vectors: DataFrame, clusters: DataFrame, max_leaf_size: int = 100, **kw) -> DataFrame:
    """Codes (child, parent) under given clusters (id, node): each is split on its own until its leaves are small enough. Parents are dense ids, in the order of clusters."""
    codes = settle(balanced_kmeans(vectors, max_leaf_size, start=clusters, **kw), "codes")
    both = codes.join(clusters.select(F.col("id").alias("child"), F.col("node").alias("cluster")), "child")
    leaves = number_rows(both.select("cluster", "parent").distinct(), ["cluster", "parent"], "leaf")
    return both.join(leaves, ["cluster", "parent"]).select("child", F.col("leaf").alias("parent"), "cluster")


def hybrid_chain(labels: DataFrame, vectors: DataFrame, depth: int, max_leaf_size: int, **kw) -> DataFrame:
    """Prefix chain on top; under it each prefix's labels, clustered among themselves: a prefix with more than ``max_leaf_size`` labels is split at its own medians."""
    top = prefix_chain(labels, depth)
    n_top = depth_of(top)
    leaf = layer_of(top, n_top - 1)
    codes = settle(pre_clustered_kmeans(vectors, leaf.select(F.col("child").alias("id"), F.col("parent").alias("node")), max_leaf_size, **kw), "codes")
    mid = codes.select(F.lit(n_top - 1).alias("layer"), F.col("parent").alias("child"), F.col("cluster").alias("parent")).distinct()
    last = codes.select(F.lit(n_top).alias("layer"), "child", "parent")
    return top.where(F.col("layer") < n_top - 1).unionByName(mid).unionByName(last)
