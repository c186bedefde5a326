"""Forests grown tree by tree, per-user fits in one job and routing in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pneuma.operators import crisis as CR
from pneuma.operators import forest_table as NF
from pneuma.operators import grow as G
from pneuma.tables import FEATURE_NAMES


def _data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, len(FEATURE_NAMES))), 2)
    return x, ((x[:, 0] + x[:, 1] + rng.normal(0, 0.2, n)) > 1).astype(np.uint8)


def _grown(x, y, size, trees=(0, 1, 2), weight=(1.0, 1.5), depth=6):
    t = G.edges(x, np.ones(len(x)))
    b = G.binned(x, t)
    held = [(np.ascontiguousarray(b[:, i:i + size]), y[i:i + size]) for i in range(0, len(y), size)]
    return G.grow(lambda: held, len(y), list(trees), 42, list(weight), t, depth)


def test_blocks_and_company_do_not_change_a_tree():
    """Whole or in blocks, sorted keys or dense sums, alone or beside other trees: the same nodes."""
    x, y = _data(900)
    whole = _grown(x, y, 900)
    for size in (900, 250, 37):
        for trees in ((0, 1, 2), (1,)):
            part = _grown(x, y, size, trees)
            keep = np.isin(whole["tree"], trees)
            for c, v in part.items():
                np.testing.assert_allclose(v, whole[c][keep], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_nodes_are_best_tests_of_their_rows(seed):
    x, y = _data(300, seed)
    g = _grown(x, y, 300, trees=(seed,), depth=4)
    bag = G._bag(42, np.array([seed]), 0, len(y))[0].astype(float)
    w = np.where(y == 1, 1.5, 1.0) * bag

    def impurity(m):
        a, b = w[m & (y == 0)].sum(), w[m & (y == 1)].sum()
        return a + b, 1 - (a * a + b * b) / (a + b) ** 2

    rows = {0: np.ones(len(y), bool)}
    place = {0: 1}
    for i in range(len(g["node"])):
        m = rows[i]
        assert g["n"][i] == bag[m].sum() and abs(g["w1"][i] - w[m & (y == 1)].sum()) < 1e-9
        if g["left"][i] < 0:
            continue
        drawn = G._drawn(42, np.array([seed]), np.array([place[i]], dtype=np.uint64))[0]
        total, own = impurity(m)
        best = 0.0
        for f in drawn:
            for t in G.edges(x, np.ones(len(x)))[f]:
                left, right = m & (x[:, f] <= t), m & (x[:, f] > t)
                if bag[left].sum() >= 5 and bag[right].sum() >= 5:
                    (a, ia), (b, ib) = impurity(left), impurity(right)
                    best = max(best, own - a / total * ia - b / total * ib)
        assert g["feature"][i] in drawn and abs(g["gain"][i] - best) < 1e-9
        go = x[:, g["feature"][i]] <= g["threshold"][i]
        rows[g["left"][i]], rows[g["right"][i]] = m & go, m & ~go
        place[g["left"][i]], place[g["right"][i]] = 2 * place[i], 2 * place[i] + 1
    inner = g["left"] >= 0
    both = [(l, r) for l, r in zip(g["left"][inner], g["right"][inner]) if not inner[l] and not inner[r]]
    assert all(g["prediction"][l] != g["prediction"][r] for l, r in both)


def test_edges_as_in_spark_ml():
    x = np.repeat(np.arange(1000.0), 2)[:, None]
    (t,) = G.edges(x, np.ones(2000))
    assert len(t) == G.BINS - 1 and np.diff(t).min() > 0 and abs(np.diff(t).mean() - 1000 / G.BINS) < 0.1
    (t,) = G.edges(np.array([[3.0], [1.0], [1.0], [2.0]]), np.ones(4))
    assert t.tolist() == [1.5, 2.5] and G.edges(np.ones((5, 1)), np.ones(5))[0].tolist() == []


def _frame(spark, n, seed=3):
    x, y = _data(n, seed)
    rows = [(i, *map(float, a), int(b), 1.0 + 0.5 * int(b)) for i, (a, b) in enumerate(zip(x, y))]
    names = ", ".join(f"{f} double" for f in FEATURE_NAMES)
    return spark.createDataFrame(rows, f"event_id long, {names}, symptom_label int, weight double")


def test_fit_is_a_spark_ml_model_of_the_grown_nodes(spark, monkeypatch):
    df = _frame(spark, 500).repartition(3).cache()
    nodes = CR.fit_forest(df, 500, CR._forest(7, 5, 42))
    model = CR.ml_model(nodes, CR._forest(7, 5, 42))
    assert model.getNumTrees == 7 and model.numFeatures == 20 and model.numClasses == 2 and model.getMaxDepth() == 5
    assert model.totalNumNodes == nodes.count() and abs(sum(model.featureImportances.toArray()) - 1.0) < 1e-9
    ml = CR.probability_col(model.transform(CR._assemble(df))).select("event_id", "proba_crisis", "prediction")
    own = NF.NodeForest("", NF.grown_nodes(nodes, ""), 5).score(df, "p").select("event_id", "p")
    diff = ml.join(own, "event_id").where((F.abs(F.col("p") - F.col("proba_crisis")) > 1e-9)
                                          | ((F.col("p") > 0.5).cast("double") != F.col("prediction")))
    assert diff.isEmpty()
    monkeypatch.setattr(G, "HELD_BYTES", 0)  # blocks are read again for every level
    assert CR.fit_forest(df, 500, CR._forest(7, 5, 42)).exceptAll(nodes).isEmpty()


def test_labels_other_than_two_are_an_error(spark):
    with pytest.raises(Exception, match="labels of a forest are 0 and 1"):
        CR.fit_forest(_frame(spark, 60).withColumn("symptom_label", F.lit(2)), 60, CR._forest(2, 3, 42)).count()


def _users(spark, n_users, rows=60):
    rng = np.random.default_rng(5)
    out = [(u, 1000 * u + i, float(a), float(b), int(a + b > 1)) for u in range(n_users) for i, (a, b) in enumerate(rng.random((rows, 2)))]
    return spark.createDataFrame(out, "user_id long, event_id long, pm25 double, co double, symptom_label int")


def _known(spark):
    return spark.createDataFrame([], "user_id long, n_user_samples long, has_meta boolean")


def test_users_are_fitted_in_one_job(spark):
    """twice as many users need no further job."""
    sc, jobs = spark.sparkContext, []
    for n in (3, 6):
        sc.setJobGroup(f"users{n}", "")
        _, meta, nodes = CR.retrain_all(_users(spark, n), _known(spark), num_trees=4)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"users{n}")))
        assert meta.count() == n and nodes.groupBy("model_name").agg(F.countDistinct("tree").alias("t")).where("t = 4").count() == n
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 0 and abs(jobs[1] - jobs[0]) <= 1, jobs


def test_a_user_of_many_rows_is_fitted_as_the_global_rows_are(spark, monkeypatch):
    monkeypatch.setattr(CR, "USER_ROWS", 100)
    rows = _users(spark, 2).unionByName(_users(spark, 3, 300).where("user_id = 2"))
    _, meta, nodes = CR.retrain_all(rows, _known(spark), num_trees=9)
    got = {r.user_id: (r.n_samples, r.n_trees) for r in meta.collect()}
    assert got == {"0": (60, 9), "1": (60, 9), "2": (300, 9)} and all(r.auc_roc > 0.8 for r in meta.where("user_id = '2'").collect())
    assert {r.model_name: r.t for r in nodes.groupBy("model_name").agg(F.countDistinct("tree").alias("t")).collect()} == {
        f"rf_user_{u}": 9 for u in range(3)}


def test_parts_of_a_users_readings_meet_the_same_forest(spark, monkeypatch):
    nodes = NF.literal_nodes(spark, [[("pm25", 5.0, 1, 2, None), (None, None, -1, -1, 0.25), (None, None, -1, -1, 0.75)]], "rf_user_1")
    rows = [(i % 3 if i % 3 else None, i % 11, float(i % 9)) for i in range(120)]
    x = spark.createDataFrame(rows, "user_id long, event_id long, pm25 double").withColumns(
        {f: F.lit(30.0) for f in FEATURE_NAMES if f != "pm25"})
    whole = CR.crisis_batch_routed(x, nodes)
    monkeypatch.setattr(CR, "ROUTED_ROWS", 7)
    parts = CR.crisis_batch_routed(x, nodes)
    assert whole.count() == parts.count() == 120 and whole.columns == parts.columns
    assert whole.exceptAll(parts).isEmpty() and {r.proba_crisis for r in parts.where("user_id = 1").collect()} == {0.25, 0.75}
    assert {r.model_used for r in parts.where("user_id is null or user_id = 2").collect()} == {"heuristic_fallback"}
