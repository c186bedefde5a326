"""Model operators (rows-only and metric-range checks): K-Means zones, forest, retraining."""

import pytest
from pyspark.sql import functions as F

from pneuma.operators import crisis as CR
from pneuma.operators import zones as Z
from pneuma.plans.q_labels import models_table
from pneuma.sources import views as V

SF = "/root/testdata/sf0.01"


def test_kmeans_zones(spark):
    zm = Z.train_zones(V.measurements(spark, SF), restarts=2, max_iter=50)
    assert len(zm.centroids) == 4 and sorted(zm.labels.values()) == ["A", "B", "C", "D"]
    orig = zm.centroids_original()
    ier = {zm.labels[i]: orig[i][4] for i in range(4)}
    assert ier["A"] <= ier["B"] <= ier["C"] <= ier["D"]  # zones ordered by the centroid index
    assigned = Z.zone_assign(V.measurements(spark, SF).withColumn("ier_score", F.lit(30.0)), zm)
    assert assigned.filter(F.col("zone").isNull()).count() == 0


def test_kmeans_is_a_fixed_point_with_a_good_inertia(spark):
    """From the trained centres numpy's Lloyd does not move, and its own best of many starts is hardly better."""
    import numpy as np

    from pneuma.tables import CLUSTER_FEATURES
    daily = Z.cluster_features(V.measurements(spark, SF))
    zm = Z.train_zones_on(daily, restarts=4)
    x = (daily.select(*CLUSTER_FEATURES).toPandas().to_numpy(float) - np.array(zm.mean)) / np.array(zm.scale)

    def lloyd(c, steps):
        for _ in range(steps):
            near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        return c, float(((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())

    own = np.array(zm.centroids)
    moved, inertia = lloyd(own, 1)
    assert np.abs(moved - own).max() < 1e-2
    rng = np.random.default_rng(0)
    best = min(lloyd(x[rng.choice(len(x), 4, replace=False)], 60)[1] for _ in range(30))
    assert inertia <= 1.05 * best and abs(inertia - zm.meta["inertia"]) < 1e-2 * inertia


def test_silhouette_over_all_rows(spark):
    import numpy as np

    from pneuma.plans.q_models import FIX
    from pneuma.tables import CLUSTER_FEATURES
    d = Z.cluster_features(V.measurements(spark, SF)).select(*CLUSTER_FEATURES)
    x = Z.zone_assign(d, FIX).toPandas()
    z = (x[FIX.features].to_numpy(float) - np.array(FIX.mean)) / np.array(FIX.scale)
    lab = x["cluster_id"].to_numpy()
    d2 = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
    scores = []
    for i in range(len(z)):
        same = lab == lab[i]
        others = [d2[i][lab == c].mean() for c in set(lab) if c != lab[i]]
        if same.sum() < 2 or not others:
            scores.append(0.0)
            continue
        a, b = d2[i][same].sum() / (same.sum() - 1), min(others)
        scores.append((b - a) / max(a, b))
    got = Z.silhouette(d, FIX).first().silhouette
    assert abs(got - np.mean(scores)) < 2e-4
    one = Z.silhouette(d.limit(1), FIX).first().silhouette
    assert one == 0.0


def test_readings_without_all_features_have_no_zone(spark):
    from pneuma.plans.q_models import FIX
    from pneuma.tables import CLUSTER_FEATURES
    good = [20.0, 4.0, 33.0, 9.0, 28.0]
    rows = [tuple(good)] + [tuple(v if i != k else bad for i, v in enumerate(good))
                            for k in range(5) for bad in (None, float("nan"), float("inf"))]
    out = Z.zone_assign(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in CLUSTER_FEATURES)), FIX).collect()
    assert out[0].cluster_id is not None and all(r.cluster_id is None and r.zone is None for r in out[1:])


def test_forest_and_scoring(spark):
    ts = CR.training_set(spark, "synthetic", stations=V.measurements(spark, SF), block_rows=512)
    m = CR.rf_train(ts, cross_validate=False, num_trees=20, max_depth=6)
    assert m.meta["auc_roc"] > 0.5
    scored = CR.crisis_batch(ts, m)
    r = scored.agg(F.min("proba_crisis"), F.max("proba_crisis")).collect()[0]
    assert 0.0 <= r[0] <= r[1] <= 1.0
    top = CR.top_features(spark, m, 8).collect()
    assert len(top) == 8


def test_crisis_realtime_heuristic(spark):
    m = V.measurements(spark, "/root/testdata/sf0.001").withColumn("ier_score", F.lit(65.0)) \
        .withColumn("zone", F.lit("C")).withColumn("symptom_yesterday", F.lit(True))
    out = CR.crisis_realtime(m).select("proba_crisis", "alert_level", "model_used").distinct().collect()
    assert [(r.proba_crisis, r.alert_level, r.model_used) for r in out] == [(0.8, "CRITIQUE", "heuristic_fallback")]


@pytest.mark.slow
def test_retrain_user(spark):
    le = V.labeled_entries(spark, "/root/testdata/sf0.001")
    feats = V.measurements(spark, "/root/testdata/sf0.001").select("event_id", "pm25", "co", "humidity", "temperature")
    lab = le.select("user_id", "event_id", "symptom_label").join(feats, "event_id")
    dec = models_table(spark, "/root/testdata/sf0.001")
    assert dec.count() >= 0
    uid = lab.groupBy("user_id").count().orderBy(F.desc("count")).first().user_id
    one = lab.filter(F.col("user_id") == uid).drop("user_id")
    glob = feats.withColumn("symptom_label", (F.col("pm25") > 40).cast("int"))
    few = CR.retrain_user(one.limit(20), glob, uid, num_trees=3)
    assert not few.retrained and "20/30" in few.reason and few.model is None
    n = one.count()
    forced = CR.retrain_user(one, glob, uid, last_count=n, has_model=True, force=True, num_trees=3)
    assert forced.retrained and forced.model.name == f"rf_user_{uid}" and forced.model.meta["n_user_samples"] == n
    kept = CR.retrain_user(one, glob, uid, last_count=n, has_model=True, num_trees=3)
    assert not kept.retrained and kept.reason.endswith("+0/10")


def _users(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(u, 1000 * u + i, float(a), float(b), int(a + b > 1)) for u, n in ((1, 300), (2, 45), (3, 12))
            for i, (a, b) in enumerate(rng.random((n, 2)))]
    return spark.createDataFrame(rows, "user_id long, event_id long, pm25 double, co double, symptom_label int")


def test_retrain_all_fits_the_due_users(spark):
    import numpy as np

    from pneuma.operators import forest_table as NF
    from pneuma.tables import FEATURE_NAMES
    known = spark.createDataFrame([(2, 44, True)], "user_id long, n_user_samples long, has_meta boolean")
    decisions, meta, nodes = CR.retrain_all(_users(spark), known, num_trees=15)
    assert {r.user_id: r.retrain for r in decisions.collect()} == {1: True, 2: False, 3: False}
    (m,) = meta.collect()
    assert (m.model_name, m.user_id, m.n_user_samples, m.n_samples, m.n_trees) == ("rf_user_1", "1", 300, 300, 15) and m.auc_roc > 0.8
    ab = np.random.default_rng(7).random((400, 2))
    new = spark.createDataFrame([(1, float(a), float(b), int(a + b > 1)) for a, b in ab], "user_id long, pm25 double, co double, y int")
    new = new.withColumns({f: F.lit(0.0) for f in FEATURE_NAMES if f not in ("pm25", "co", "ier_score")}).withColumn("ier_score", F.lit(10.0))
    right = CR.crisis_batch_routed(new, nodes).where((F.col("proba_crisis") > 0.5).cast("int") == F.col("y")).count()
    assert right > 330
    _, none, empty = CR.retrain_all(_users(spark).where("user_id = 3"), known)
    assert none.count() == empty.count() == 0 and NF.packed(empty).count() == 0


def test_routing_keeps_every_row(spark):
    """Repeated and null ids, null users; user forest, then global forest, then heuristic."""
    from pneuma.operators import forest_table as NF
    from pneuma.plans.q_forest import NAME, TREES, fixture
    from pneuma.tables import FEATURE_NAMES
    rows = [(5, 1), (5, 1), (5, 2), (None, 1), (None, None), (6, None)]
    x = spark.createDataFrame(rows, "event_id long, user_id long").withColumns({f: F.lit(30.0) for f in FEATURE_NAMES})
    mine = NF.literal_nodes(spark, [[(None, None, -1, -1, 0.97)]], "rf_user_1")
    out = CR.crisis_batch_routed(x, mine, fixture(spark)).collect()
    assert sorted(map(str, ((r.event_id, r.user_id) for r in out))) == sorted(map(str, rows))
    assert {(r.user_id, r.model_used) for r in out} == {(1, "rf_user_1"), (2, NAME), (None, NAME)}
    assert {r.proba_crisis for r in out if r.user_id == 1} == {0.97} and len({r.proba_crisis for r in out}) == 2
    alone = CR.crisis_batch_routed(x, mine).collect()
    assert {(r.user_id, r.model_used, r.proba_crisis) for r in alone} == {
        (1, "rf_user_1", 0.97), (2, "heuristic_fallback", 0.22), (None, "heuristic_fallback", 0.22)}
    assert len(TREES) == 4


def test_node_table_equals_the_fitted_model(spark, tmp_dir):
    from pneuma.operators import forest_table as NF
    ts = CR.training_set(spark, "synthetic", stations=V.measurements(spark, "/root/testdata/sf0.001"), block_rows=512)
    m = CR.rf_train(ts, cross_validate=False, num_trees=12, max_depth=5)
    m.save(f"{tmp_dir}/rf", spark)
    forest = NF.NodeForest("rf_global", NF.stored_nodes(spark, f"{tmp_dir}/rf/model", "rf_global"), 5)
    both = forest.score(CR._scored(ts, m).withColumnRenamed("_p", "_ml"), "_p")
    assert both.where(F.abs(F.col("_p") - F.col("_ml")) > 1e-9).count() == 0
    assert all(a == b and abs(v - w) < 1e-9 for (a, v), (b, w) in zip(forest.importances(), m.importances()))
    a, b = (CR.crisis_batch(ts, x).select("event_id", "proba_crisis", "alert_level", "should_notify") for x in (m, forest))
    assert a.exceptAll(b).count() == 0
    h = V.measurements(spark, "/root/testdata/sf0.001").withColumn("ier_score", F.lit(65.0))
    a, b = (CR.crisis_realtime(h, x).drop("feature_values") for x in (m, forest))
    assert a.exceptAll(b).count() == 0 and a.first().model_used == "rf_global" and len(a.first().top_contributors) == 5


def test_model_persistence(spark, tmp_dir):
    import os

    from pneuma.plans.pipelines import run_batch, write_batch
    from pneuma.plans.q_models import FIX
    FIX.save(spark, os.path.join(tmp_dir, "zones"))
    back = Z.ZoneModel.load(spark, os.path.join(tmp_dir, "zones"))
    assert back.labels == FIX.labels and back.centroids == FIX.centroids and back.meta == {} and back.bounds is None
    from dataclasses import replace
    full = replace(FIX, meta={"k": 4, "pathologie": "asthme", "inertia": 3.5, "davies_bouldin": 0.5, "silhouette": 0.25},
                   bounds={"pm25": (0.0, 90.0)})
    full.save(spark, os.path.join(tmp_dir, "zones2"))
    again = Z.ZoneModel.load(spark, os.path.join(tmp_dir, "zones2"))
    assert again.meta == full.meta and again.bounds == full.bounds
    ts = CR.training_set(spark, "synthetic", stations=V.measurements(spark, "/root/testdata/sf0.001"), block_rows=512)
    m = CR.rf_train(ts, cross_validate=False, num_trees=5, max_depth=4)
    m.save(os.path.join(tmp_dir, "rf"), spark)
    m2 = CR.CrisisModel.load(spark, os.path.join(tmp_dir, "rf"))
    assert m2.name == "rf_global" and m2.meta["n_samples"] == m.meta["n_samples"]
    scored = run_batch(V.measurements(spark, "/root/testdata/sf0.001").drop("user_id"), "asthme")
    write_batch(scored.withColumn("pathologie", F.lit("asthme")), os.path.join(tmp_dir, "batch"))
    assert spark.read.parquet(os.path.join(tmp_dir, "batch")).filter("pathologie = 'asthme'").count() == scored.count()


def test_registry_publishes_what_the_next_decision_reads(spark, tmp_dir):
    from pneuma.operators.registry import ModelRegistry
    from pneuma.tables import FEATURE_NAMES
    reg, rows = ModelRegistry(spark, f"{tmp_dir}/registry"), _users(spark)
    assert reg.users("long").count() == 0
    first = {r.user_id: r for r in reg.retrain(rows, num_trees=4).collect()}
    assert {u: r.retrain for u, r in first.items()} == {1: True, 2: True, 3: False}
    second = {r.user_id: r for r in reg.retrain(rows, num_trees=4).collect()}
    assert not any(r.retrain for r in second.values()) and second[1].reason.endswith("+0/10") and second[2].reason.endswith("+0/10")
    assert reg.versions.latest() == 1
    more = rows.unionByName(rows.where("user_id = 2").limit(12).withColumn("event_id", F.col("event_id") + 500))
    third = {r.user_id: r for r in reg.retrain(more, num_trees=4).collect()}
    assert third[2].retrain and "+12" in third[2].reason and not third[1].retrain
    assert {(r.model_name, r.n_user_samples) for r in reg.meta().collect()} == {("rf_user_1", 300), ("rf_user_2", 57)}
    assert {(r.model_name, r.n_user_samples) for r in reg.meta(1).collect()} == {("rf_user_1", 300), ("rf_user_2", 45)}
    assert reg.nodes().where("model_name = 'rf_user_2'").select("tree").distinct().count() == 4
    x = rows.drop("symptom_label").withColumns({f: F.lit(0.0) for f in FEATURE_NAMES if f not in ("pm25", "co", "ier_score")})
    out = reg.score(x.withColumn("ier_score", F.lit(10.0)))
    assert {(r.user_id, r.model_used) for r in out.collect()} == {(1, "rf_user_1"), (2, "rf_user_2"), (3, "heuristic_fallback")}


def test_training_set_falls_back_by_path(spark, tmp_dir):
    import os

    from pneuma.operators.labeled import LabeledTable
    from pneuma.sources import files as FS
    sf = "/root/testdata/sf0.001"
    raw, done, lab = (os.path.join(tmp_dir, x) for x in ("raw", "processed", "labeled"))
    os.makedirs(raw)
    with pytest.raises(FileNotFoundError):
        CR.training_set_by_path(spark, "labeled", raw, done, lab)
    FS.save_processed(V.measurements(spark, sf).drop("user_id"), done)
    rows, used = CR.training_set_by_path(spark, "labeled", raw, done, lab)
    assert used == "synthetic" and rows.count() == 1000
    V.health_source(spark, sf).drop("event_id").toPandas().to_csv(os.path.join(raw, "Air_Quality_x.csv"), index=False)
    rows, used = CR.training_set_by_path(spark, "labeled", raw, done, lab)
    assert used == "health" and 0 < rows.count() <= 1000
    LabeledTable(spark, lab).append(V.labeled_entries(spark, sf))
    rows, used = CR.training_set_by_path(spark, "labeled", raw, done, lab)
    assert used == "labeled" and rows.count() == 1000
    assert CR.training_set_by_path(spark, "kaggle", raw, done, lab)[1] == "health"
