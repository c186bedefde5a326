"""Scoring through nodes without a forest in every row."""

from pyspark.sql import functions as F

from pneuma.operators import forest_table as NF
from pneuma.tables import FEATURE_NAMES


def test_scored_rows_carry_no_forest(spark):
    """scoring has no join with the forest; nulls and NaN go right, a null share is no vote, no forest is no probability."""
    trees = [[("pm25", 5.0, 1, 2, None), (None, None, -1, -1, 0.25), (None, None, -1, -1, 0.75)], [(None, None, -1, -1, 0.5)],
             [(None, None, -1, -1, None)]]
    forest = NF.NodeForest("m", NF.literal_nodes(spark, trees, "m"))
    x = spark.createDataFrame([(1.0,), (5.0,), (6.0,), (None,), (float("nan"),)], "pm25 double")
    x = x.withColumns({f: F.lit(0.0) for f in FEATURE_NAMES if f != "pm25"})
    out = forest.score(x, "p")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.p for r in out.collect()] == [0.375, 0.375, 0.625, 0.625, 0.625]
    old = NF.packed(forest.nodes).crossJoin(x).withColumn("p", NF.probability(F.col("trees"), NF.feature_array(x)))
    assert sorted(r.p for r in old.collect()) == [0.375, 0.375, 0.625, 0.625, 0.625]
    assert [r.p for r in NF.NodeForest("none", forest.nodes).score(x, "p").collect()] == [None] * 5
