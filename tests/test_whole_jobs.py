"""The model queries do their whole jobs (F5-F9) and fits are cut into as many tasks as they need."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pneuma.operators import crisis as CR
from pneuma.tables import RF_FOLDS

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def fits(monkeypatch):
    """Fits of three trees, and how many there were."""
    seen, forest = [], CR._forest

    def small(num_trees=200, max_depth=12, seed=42):
        seen.append(num_trees)
        return forest(3, 4, seed)
    monkeypatch.setattr(CR, "_forest", small)
    return seen


def test_evaluate_k_gives_out_silhouettes():
    assert "silhouette_ok" in E.oracle_sql()["evaluate_k"]


def test_rf_train_cross_validates(spark, fits):
    r = E.queries()["rf_train"](spark, SF).first()
    assert fits == [200] * (1 + RF_FOLDS) and {"f1_ok", "cv_ok"} <= set(r.asDict())


def test_rf_cross_validate_checks_f1_and_deviations(spark, fits):
    r = E.queries()["rf_cross_validate"](spark, SF).first()
    assert fits == [200] * RF_FOLDS and r.f1_ok and r.std_ok


def test_top_features_are_those_of_a_trained_forest(spark, fits):
    rows = E.queries()["top_features"](spark, SF).collect()
    assert fits == [200] and [r["rank"] for r in rows] == list(range(1, 9)) and all(r.known and r.falls and r.sum_ok for r in rows)


def test_routed_readings_meet_trained_forests(spark, fits):
    out = E.queries()["crisis_batch_routed"](spark, SF)
    used = {r[0] for r in out.select("model_used").distinct().collect()}
    assert fits and set(fits) == {200} and len(used - {"heuristic_fallback"}) == len(fits) and out.where("not in_range or not level_ok").count() == 0


def test_scores_of_all_users_in_one_job(spark):
    """AUC and F1 per user equal those of each user's rows alone."""
    from pneuma.operators import metrics as MT
    x = spark.range(240).select((F.col("id") % 3).alias("user_id"), (F.col("id") * 7 % 5 > 2).cast("int").alias("label"),
                                (F.col("id") * 13 % 17 / 16.0).alias("score"))
    x = x.withColumn("prediction", (F.col("score") > 0.5).cast("double"))
    got = {r.user_id: (r.auc_roc, r.f1_score) for r in MT.scores_by(x, "user_id").collect()}
    for u in range(3):
        own = x.where(F.col("user_id") == u)
        f1 = {r["class"]: r.f1 for r in MT.classification_report(own).collect()}["1"]
        assert got[u] == (MT.auc_roc(own).first().auc_roc, f1)


def test_compaction_of_one_users_rows_takes_several_tasks(spark):
    """neither many rows nor one user's many rows are one task of a compaction."""
    from pneuma.operators import labeled
    x = spark.range(4000).select(F.lit(1).alias("user_id"), (F.col("id") % 997).alias("v"))
    per = labeled._tasks(x, 4000, "user_id", 100).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 4000 and max(r["count"] for r in per) < 2000
    assert labeled._tasks(x, 4000, "user_id", 1 << 18).rdd.getNumPartitions() == 1


def test_stream_crisis_stores_what_the_query_gives_out(spark, monkeypatch):
    """histories and feature maps are not stored."""
    from pneuma.streaming import epochs as EP
    seen, write = set(), EP.Epochs.write

    def watched(self, what, epoch, df):
        if what == "table":
            seen.update(df.columns)
        return write(self, what, epoch, df)
    monkeypatch.setattr(EP.Epochs, "write", watched)
    out = E.queries()["stream_crisis"](spark, SF)
    assert seen == set(out.columns) and "history" not in seen
