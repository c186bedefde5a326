"""Forests as tables of nodes: stored, joined to readings and walked by one Column expression.

A node is one row (model_name, tree, node, feature, threshold, left, right, p): ``feature`` is the place of the tested feature
in ``FEATURE_NAMES`` (-1 in a leaf), a value up to ``threshold`` goes ``left``, and ``p`` is the share of class 1 in a leaf.
Nodes of a tree are numbered from 0, the root; ``n`` is the weight of the training rows in a node. A fitted Spark ML forest becomes such a table from
its stored form, without passing the driver. ``packed`` has one row per model, whose size is bounded by
trees x 2^(depth + 1) nodes, whatever the number of readings.

Readings are scored in Arrow batches: a forest goes to the Python workers once (``arrays``) and every tree is walked for a
whole batch at a time (``walk``), so no row carries a copy of the forest. ``probability`` says the same as one Column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import FEATURE_NAMES, RF_MAX_DEPTH

NODES = ("model_name string, tree int, node int, feature int, threshold double, left int, right int, p double, "
         "gain double, n double")


def stored_nodes(spark: SparkSession, path: str, model_name: str) -> DataFrame:
    """Nodes of the Spark ML forest stored in ``path`` (its ``model`` folder)."""
    d = spark.read.parquet(f"{path.rstrip('/')}/data").select("treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    return d.select(
        F.lit(model_name).alias("model_name"), F.col("treeID").cast("int").alias("tree"), F.col("id").cast("int").alias("node"),
        F.col("split.featureIndex").cast("int").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").cast("int").alias("left"),
        F.col("rightChild").cast("int").alias("right"),
        F.when(total > 0, F.get("impurityStats", F.lit(1)) / total).alias("p"), "gain", total.alias("n"))


def grown_nodes(nodes: DataFrame, model_name) -> DataFrame:
    """Node table of nodes as ``grow`` makes them."""
    total = F.col("w0") + F.col("w1")
    return nodes.select((model_name if isinstance(model_name, Column) else F.lit(model_name)).alias("model_name"), "tree", "node", "feature", "threshold", "left",
                        "right", F.when(total > 0, F.col("w1") / total).alias("p"), "gain", total.alias("n"))


def literal_rows(trees: list[list[tuple]]) -> list[tuple]:
    """Node rows without the name of a forest written out: per tree (feature name or None, threshold, left, right, p)."""
    return [(t, i, FEATURE_NAMES.index(f) if f else -1, thr, left, right, p, None, None)
            for t, tree in enumerate(trees) for i, (f, thr, left, right, p) in enumerate(tree)]


def literal_nodes(spark: SparkSession, trees: list[list[tuple]], model_name: str) -> DataFrame:
    """Node table of a forest written out as for ``literal_rows``."""
    return spark.createDataFrame([(model_name, *r) for r in literal_rows(trees)], NODES)


def packed(nodes: DataFrame) -> DataFrame:
    """model_name, trees (arrays of nodes in the order of their numbers), depth: one row per model."""
    node = F.struct("node", "feature", "threshold", "left", "right", "p")
    trees = nodes.groupBy("model_name", "tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return trees.groupBy("model_name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("trees"))


def _leaf(tree: Column, values: Column, depth: int) -> Column:
    """Number of the leaf that ``values`` (the 20 features) reach."""
    def down(i: Column, _: Column) -> Column:
        n = F.get(tree, i)
        return F.when(n["feature"] < 0, i).when(F.get(values, n["feature"]) <= n["threshold"], n["left"]).otherwise(n["right"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)


def probability(trees: Column, values: Column, depth: int = RF_MAX_DEPTH) -> Column:
    """Mean share of class 1 over the trees; null without a forest."""
    p = F.transform(trees, lambda t: F.get(t, _leaf(t, values, depth))["p"])
    p = F.filter(p, lambda x: x.isNotNull())
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)


def feature_array(df: DataFrame) -> Column:
    return F.array(*[F.col(f).cast("double") for f in FEATURE_NAMES])


@dataclass
class NodeForest:
    """One forest as a node table, in the place of a Spark ML model."""
    name: str
    nodes: DataFrame
    depth: int = RF_MAX_DEPTH
    #: (feature, importance) in the order of the features, as far as known.
    given: list[tuple[str, float]] | None = None

    def importances(self) -> list[tuple[str, float]]:
        return self.given if self.given is not None else importances(self.nodes)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` (the 20 features) with the probability ``name``; the forest's nodes, bounded by its trees and depth, are sent to the workers once."""
        from ..session import ship
        spark, depth = df.sparkSession, self.depth
        mine = self.nodes.where(F.col("model_name") == self.name).select("tree", "node", "feature", "threshold", "left", "right", "p").toArrow()
        if not mine.num_rows:
            return df.withColumn(name, F.lit(None).cast("double"))
        ship(spark)
        sent = spark.sparkContext.broadcast(arrays(mine))

        def p(*columns):
            return mean(sent.value, columns, depth)

        from pyspark.sql.functions import arrow_udf
        return df.withColumn(name, arrow_udf(_typed(p, len(FEATURE_NAMES)), "double")(*[F.col(f).cast("double") for f in FEATURE_NAMES]))


def arrays(nodes) -> dict:
    """An Arrow table of one forest's nodes as flat arrays in the order (tree, node); a leaf leads to itself."""
    import numpy as np

    def column(name: str, kind: str):
        import pyarrow.compute as pc
        c = nodes.column(name)
        return (pc.fill_null(pc.cast(c, "float64"), float("nan")) if kind == "float64" else c).to_numpy().astype(kind)

    tree, node = column("tree", "int64"), column("node", "int64")
    by = np.lexsort((node, tree))
    tree = tree[by]
    first = np.flatnonzero(np.diff(tree, prepend=-1))
    begin = np.repeat(first, np.diff(np.append(first, len(tree))))
    at = np.arange(len(tree))
    feature = column("feature", "int64")[by]
    inner = feature >= 0
    left, right = (np.where(inner, begin + column(c, "int64")[by], at) for c in ("left", "right"))
    return {"first": first, "feature": np.where(inner, feature, 0), "threshold": column("threshold", "float64")[by], "left": left, "right": right,
            "p": column("p", "float64")[by]}


def walk(forest: dict, x, depth: int):
    """Mean share of class 1 over the trees for each row of the matrix ``x``, added up in the order of the trees; NaN where no tree has one."""
    import numpy as np
    n, width = x.shape
    flat, row = np.ascontiguousarray(x).reshape(-1), np.arange(n) * width
    total, known = np.zeros(n), np.zeros(n)
    for root in forest["first"].tolist():
        at = np.full(n, root)
        for _ in range(depth):
            below = np.where(flat[row + forest["feature"][at]] <= forest["threshold"][at], forest["left"][at], forest["right"][at])
            if np.array_equal(below, at):
                break
            at = below
        p = forest["p"][at]
        some = ~np.isnan(p)
        total += np.where(some, p, 0.0)
        known += some
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(known > 0, total / known, np.nan)


def mean(forest: dict, columns, depth: int):
    """``walk`` over Arrow columns of doubles; null is as NaN, to the right of every threshold."""
    import numpy as np
    import pyarrow as pa
    x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in columns], axis=1)
    p = walk(forest, x, depth) if len(x) else np.zeros(0)
    return pa.array(p, pa.float64(), mask=np.isnan(p))


def _typed(f, n: int):
    """``f`` with ``n`` named Arrow arguments, as Spark tells the kind of a function by its signature."""
    import inspect

    import pyarrow as pa
    names = [f"c{i}" for i in range(n)]
    f.__signature__ = inspect.Signature([inspect.Parameter(c, inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=pa.Array) for c in names],
                                        return_annotation=pa.Array)
    f.__annotations__ = {**dict.fromkeys(names, pa.Array), "return": pa.Array}
    return f


def importances(nodes: DataFrame) -> list[tuple[str, float]]:
    """Gain times rows per feature, as a share within each tree, then over the forest: 20 numbers."""
    inner = nodes.where("feature >= 0").withColumn("_g", F.col("gain") * F.col("n"))
    per = inner.groupBy("tree", "feature").agg(F.sum("_g").alias("_g"))
    whole = per.groupBy("tree").agg(F.sum("_g").alias("_all"))
    rows = (per.join(whole, "tree").where("_all > 0").groupBy("feature").agg(F.sum(F.col("_g") / F.col("_all")).alias("v"))).collect()
    total = sum(r["v"] for r in rows) or 1.0
    found = {r["feature"]: r["v"] / total for r in rows}
    return [(f, found.get(i, 0.0)) for i, f in enumerate(FEATURE_NAMES)]


def node_rows(rows: DataFrame, forest: NodeForest, label: str = "symptom_label") -> DataFrame:
    """tree, node, n, positives: how many of ``rows``, and how many of class 1, pass each node of the forest.

    Summed inside each task before the shuffle, so the shuffle has a row per node and task at most.
    """
    def path(tree: Column, values: Column) -> Column:
        def down(seen: Column, _: Column) -> Column:
            i = F.element_at(seen, -1)
            n = F.get(tree, i)
            there = F.when(F.get(values, n["feature"]) <= n["threshold"], n["left"]).otherwise(n["right"])
            return F.when(n["feature"] < 0, seen).otherwise(F.concat(seen, F.array(there)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.array(F.lit(0)), down)

    mine = packed(forest.nodes.where(F.col("model_name") == forest.name)).select(F.col("trees").alias("_trees"), F.lit(1).alias("_one"))
    x = rows.withColumn("_x", feature_array(rows)).withColumn("_one", F.lit(1)).join(F.broadcast(mine), "_one")
    paths = F.transform("_trees", lambda t: path(t, F.col("_x")))
    per_tree = x.select(F.col(label).alias("_y"), F.posexplode(paths).alias("tree", "_path"))
    return per_tree.select("tree", "_y", F.explode("_path").alias("node")).groupBy("tree", "node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("positives"))


def with_gains(rows: DataFrame, forest: NodeForest, label: str = "symptom_label") -> DataFrame:
    """The forest's nodes with the rows that pass them and the Gini gain of each test over those rows."""
    def gini(n: Column, pos: Column) -> Column:
        q = pos / n
        return F.when(n > 0, 2.0 * q * (1.0 - q)).otherwise(0.0)

    seen = node_rows(rows, forest, label)
    own = forest.nodes.drop("gain", "n").join(seen, ["tree", "node"], "left").fillna(0, ["n", "positives"])
    child = seen.select("tree", F.col("node").alias("_c"), F.col("n").alias("_n"), F.col("positives").alias("_pos"))
    x = own
    for side in ("left", "right"):
        c = child.select("tree", F.col("_c").alias(side), F.col("_n").alias(f"_n_{side}"), F.col("_pos").alias(f"_p_{side}"))
        x = x.join(c, ["tree", side], "left").fillna(0, [f"_n_{side}", f"_p_{side}"])
    below = sum(F.col(f"_n_{s}") * gini(F.col(f"_n_{s}"), F.col(f"_p_{s}")) for s in ("left", "right"))
    gain = F.when((F.col("feature") >= 0) & (F.col("n") > 0), gini(F.col("n"), F.col("positives")) - below / F.col("n"))
    return x.withColumn("gain", gain).select("model_name", "tree", "node", "feature", "threshold", "left", "right", "p", "gain", "n", "positives")
