"""retrain_user reads the global rows once whole, whatever its later steps need."""

from collections import Counter

from pyspark.sql import functions as F

from pneuma.functions.exprs import hash_uniform
from pneuma.operators import crisis as CR
from pneuma.operators import labels as L


def _global(spark, n):
    return spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 97).cast("double").alias("pm25"),
                                 (F.col("id") % 7).cast("double").alias("co"), (F.col("id") % 97 > 40).cast("int").alias("symptom_label"))


def test_global_rows_are_made_once(spark):
    n = 3000
    made = spark.sparkContext.accumulator(0)

    def value(v):
        made.add(1)
        return v
    glob = _global(spark, n)
    counted = glob.withColumn("pm25", F.udf(value, "double")("pm25"))
    r = CR.retrain_user(glob.where("event_id < 100"), counted, 7, num_trees=2)
    assert r.retrained and r.model.meta["n_samples"] == 150 and 50 <= made.value <= n


def test_sample_is_the_run_of_the_permutation(spark):
    """With repeated and absent keys: as many rows as asked for, those that stand next in the order of the draws."""
    keys = [*range(400), *range(50), *range(50), None, None, None]
    glob = spark.createDataFrame([(k, float(i), i % 2) for i, k in enumerate(keys)], "event_id long, pm25 double, symptom_label int")
    users = spark.createDataFrame([(u, 1000 + i, 1.0, 1) for u, n in ((1, 40), (2, 600), (3, 5000)) for i in range(n)],
                                  "user_id long, event_id long, pm25 double, symptom_label int")
    out = [r for r in L.augment_global(users, glob).collect() if r.source == "global"]
    draws = {r.event_id: r.u for r in glob.select("event_id", hash_uniform("event_id", L.SEED, "perm").alias("u")).collect()}
    order = sorted(keys, key=lambda k: (k is None, draws[k] or 0.0, k or 0))
    first = {r.user_id: r.u for r in users.select("user_id", hash_uniform("user_id", L.SEED, "offset").alias("u")).distinct().collect()}
    for u, want in ((1, 50), (2, 180), (3, len(keys))):
        mine = [r for r in out if r.user_id == u]
        at = int(first[u] * len(keys))
        assert Counter(r.event_id for r in mine) == Counter(order[(at + i) % len(keys)] for i in range(want))
        assert len({r.pm25 for r in mine}) == want


def test_training_windows_run_over_many_blocks(spark):
    from pneuma.plans import q_crisis as Q
    x = Q._training(spark, "/root/testdata/sf0.001")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert CR.TRAINING_BLOCK_ROWS < 1 << 20 and f"/ {CR.TRAINING_BLOCK_ROWS}" in plan


def test_weak_labels_of_training_rows_are_those_of_their_readings(spark):
    from pneuma.functions import alerts as A
    from pneuma.functions import index as IX
    from pneuma.plans import q_crisis as Q
    from pneuma.sources import views as V
    sf = "/root/testdata/sf0.001"
    feats = Q._stored_training(spark, sf)
    zone = A.zone_from_ier("ier_score")
    new = L.weak_labels(feats.drop("symptom_label").withColumn("zone", zone)).select("event_id", "symptom_label")
    old = L.weak_labels(V.measurements(spark, sf).withColumn("ier_score", IX.ier_score()).withColumn("zone", zone))
    both = old.select("event_id", F.col("symptom_label").alias("o")).join(new, "event_id")
    assert both.count() == feats.count() and both.where("o <> symptom_label").isEmpty()
