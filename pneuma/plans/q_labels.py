"""Registered queries: labels, sampling, metrics, retraining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..operators import clean as C
from ..operators import labels as L
from ..operators import metrics as MT
from ..operators import retrain as R
from ..operators import zones as Z
from ..sources import views as V
from ..tables import FEATURE_NAMES
from . import sqlfrag as Q
from .catalog import register

SCORED_Z = f"""(SELECT *, {Q.zone_from_ier('ier_score')} AS zone FROM
  (SELECT *, {Q.score()} AS ier_score FROM measurements) s0)"""


def weak_sql(key="event_id"):
    p = (f"least(greatest(CASE WHEN ier_score >= 76 THEN 0.9E0 WHEN ier_score >= 51 THEN 0.55E0 "
         f"WHEN ier_score >= 26 THEN 0.2E0 ELSE 0.05E0 END + CASE WHEN zone IN ('C', 'D') THEN 0.15E0 ELSE 0.0E0 END, "
         f"0.0E0), 1.0E0)")
    base = f"CAST({Q.hash_uniform(key, 42, 'label')} < {p} AS INTEGER)"
    lab = f"CASE WHEN {Q.hash_uniform(key, 42, 'flip')} < 0.08E0 THEN 1 - {base} ELSE {base} END"
    return p, lab


_P, _LAB = weak_sql()
WEAK = f"(SELECT *, {_P} AS label_p, CAST({_LAB} AS INTEGER) AS symptom_label FROM {SCORED_Z} w)"


def _weak_spark(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    return L.weak_labels(m.withColumn("zone", A.zone_from_ier("ier_score")))


@register("weak_labels", V.with_views(f"SELECT event_id, label_p, symptom_label FROM {WEAK} t", "measurements"))
def q_weak_labels(spark, sf):
    return _weak_spark(spark, sf).select("event_id", "label_p", "symptom_label")


AGE_SQL = f"CAST(25 + floor({Q.hash_uniform('event_id', 42, 'age')} * 45) AS INTEGER)"
SMOKER_SQL = f"CAST({Q.hash_uniform('event_id', 42, 'smoker')} < 0.2E0 AS INTEGER)"


@register("symptom_profile_fill", V.with_views(f"""
SELECT event_id, station, {AGE_SQL} AS age, 'general' AS pathologie, {SMOKER_SQL} AS is_smoker, symptom_label,
       CAST(COALESCE(lag(symptom_label) OVER (PARTITION BY station ORDER BY datetime NULLS LAST, event_id), 0)
            AS INTEGER) AS symptom_yesterday
FROM {WEAK} t""", "measurements"))
def q_symptom_profile_fill(spark, sf):
    w = _weak_spark(spark, sf).select("event_id", "station", "datetime", "symptom_label")
    out = L.synthetic_profile(w)
    return out.select("event_id", "station", "age", "pathologie", "is_smoker", "symptom_label", "symptom_yesterday")


HEALTH_LABELED = f"""(SELECT event_id, pm25, co, temperature, humidity, aqi,
       CAST(COALESCE(month(TRY_CAST(date AS TIMESTAMP)), 6) AS INTEGER) AS month,
       CAST(COALESCE(respiratory_admissions >= (SELECT quantile_cont(respiratory_admissions, 0.75) FROM health_raw),
                     false) AS INTEGER) AS symptom_label
FROM health_raw)"""


@register("health_align", V.with_views(f"""
SELECT event_id, 'kaggle_global' AS station, ier_score, {Q.zone_from_ier('ier_score')} AS zone,
       make_timestamp(2020, month, 15, 0, 0, 0.0) AS datetime, {AGE_SQL} AS age, 'asthme' AS pathologie,
       {SMOKER_SQL} AS is_smoker, symptom_label,
       CAST(COALESCE(lag(symptom_label) OVER (ORDER BY event_id), 0) AS INTEGER) AS symptom_yesterday
FROM (SELECT *, {Q.score('asthme')} AS ier_score FROM {HEALTH_LABELED} h) t""", "health_raw"))
def q_health_align(spark, sf):
    h = C.health_label(C.health_calendar(V.health_raw(spark, sf)))
    h = h.select("event_id", "pm25", "co", "temperature", "humidity", "aqi",
                                                   "month", "symptom_label")
    out = L.health_align(h, "asthme")
    return out.select("event_id", "station", "ier_score", "zone", "datetime", "age", "pathologie", "is_smoker",
                      "symptom_label", "symptom_yesterday")


@register("union_sources", V.with_views("""
SELECT event_id, station, pm25, co, humidity, temperature, NULL::DOUBLE AS aqi, 'stations' AS source FROM measurements
UNION ALL
SELECT event_id, NULL::VARCHAR AS station, pm25, co, humidity, temperature, aqi, 'health' AS source FROM health_raw""",
                                        "measurements", "health_raw"))
def q_union_sources(spark, sf):
    a = V.measurements(spark, sf).select("event_id", "station", "pm25", "co", "humidity", "temperature",
                                         F.lit("stations").alias("source"))
    b = V.health_raw(spark, sf).select("event_id", "pm25", "co", "humidity", "temperature", "aqi",
                                       F.lit("health").alias("source"))
    return L.union_sources(a, b)


AUGMENT_SQL = f"""
WITH g AS (SELECT event_id, pm25, symptom_label,
                  row_number() OVER (ORDER BY {Q.hash_uniform('event_id', 42, 'perm')}, event_id) - 1 AS p0
           FROM {WEAK} w),
n AS (SELECT count(*) AS big_n FROM g),
runs AS (SELECT user_id, least(greatest(50, CAST(floor(nu * 0.3E0) AS BIGINT)), big_n) AS k,
                CAST(floor({Q.hash_uniform('user_id', 42, 'offset')} * big_n) AS BIGINT) AS s, big_n
         FROM (SELECT user_id, count(*) AS nu FROM labeled_entries GROUP BY user_id) c CROSS JOIN n)
SELECT user_id, event_id, pm25, symptom_label, 'user' AS source FROM labeled_entries
UNION ALL
SELECT r.user_id, g.event_id, g.pm25, g.symptom_label, 'global' AS source
FROM runs r JOIN g ON ((g.p0 - r.s + r.big_n) % r.big_n) < r.k"""


@register("augment_global", V.with_views(AUGMENT_SQL, "measurements", "labeled_entries"))
def q_augment_global(spark, sf):
    users = V.labeled_entries(spark, sf).select("user_id", "event_id", "pm25", "symptom_label")
    glob = _weak_spark(spark, sf).select("event_id", "pm25", "symptom_label")
    return L.augment_global(users, glob)


def _strat_sql(extra: str) -> str:
    return f"""
SELECT user_id, event_id, symptom_label, {extra} FROM (
  SELECT *, row_number() OVER (PARTITION BY symptom_label ORDER BY {Q.hash_uniform('event_id', 42, 'split')}, event_id)
            AS rk, count(*) OVER (PARTITION BY symptom_label) AS nl
  FROM labeled_entries) t"""


@register("stratified_split", V.with_views(_strat_sql("rk <= round_even(nl * 0.2E0, 0) AS is_test"),
                                           "labeled_entries"))
def q_stratified_split(spark, sf):
    le = V.labeled_entries(spark, sf).select("user_id", "event_id", "symptom_label")
    return L.stratified_split(le)


@register("stratified_folds", V.with_views(_strat_sql("CAST((rk - 1) % 5 AS INTEGER) AS fold"), "labeled_entries"))
def q_stratified_folds(spark, sf):
    le = V.labeled_entries(spark, sf).select("user_id", "event_id", "symptom_label")
    return L.stratified_folds(le)


# --- metrics on a fixed score: label from the survey rows, score = index / 100 -------------------------

SCORED_LABELS = f"""(SELECT l.event_id, l.symptom_label AS label, s.ier_score / 100.0E0 AS score,
       CAST(s.ier_score / 100.0E0 >= 0.35E0 AS INTEGER) AS prediction
FROM labeled_entries l JOIN (SELECT event_id, {Q.score('asthme')} AS ier_score FROM measurements) s USING (event_id))"""


def _scored_labels(spark, sf):
    le = V.labeled_entries(spark, sf).select("event_id", F.col("symptom_label").alias("label"))
    m = V.measurements(spark, sf).select("event_id", IX.ier_score("asthme").alias("ier_score"))
    return le.join(m, "event_id").select("event_id", "label", (F.col("ier_score") / 100.0).alias("score"),
                                         ((F.col("ier_score") / 100.0) >= 0.35).cast("int").alias("prediction"))


@register("positive_rate", V.with_views("""
SELECT count(*) AS n_rows, round_even(CAST(sum(symptom_label) AS DOUBLE) / count(*) * 10000.0E0, 0) / 10000.0E0
       AS positive_rate FROM labeled_entries""", "labeled_entries"))
def q_positive_rate(spark, sf):
    return MT.positive_rate(V.labeled_entries(spark, sf))


@register("class_weights", V.with_views("""
SELECT symptom_label, n_class, CAST(sum(n_class) OVER () AS DOUBLE) / (2.0E0 * n_class) AS weight
FROM (SELECT symptom_label, count(*) AS n_class FROM labeled_entries GROUP BY symptom_label) t""", "labeled_entries"))
def q_class_weights(spark, sf):
    return MT.class_weights(V.labeled_entries(spark, sf))


def _cluster_dist_sql():
    from .q_models import FIX, SCORED, _assign_sql
    return V.with_views(f"""
SELECT cluster_id, n, round_even(CAST(n AS DOUBLE) / t * 100.0E0 * 10.0E0, 0) / 10.0E0 AS pct
FROM (SELECT cluster_id, count(*) AS n, sum(count(*)) OVER () AS t
      FROM {_assign_sql(SCORED, 'event_id', FIX)} z GROUP BY cluster_id) d""", "measurements")


@register("cluster_distribution", _cluster_dist_sql())
def q_cluster_distribution(spark, sf):
    from .q_models import FIX
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    return MT.distribution(Z.zone_assign(m, FIX), "cluster_id")


@register("confusion_matrix", V.with_views(f"""
SELECT l.label, COALESCE(pred_0, 0) AS pred_0, COALESCE(pred_1, 0) AS pred_1
FROM (VALUES (0), (1)) l(label) LEFT JOIN (
  SELECT label, CAST(count_if(prediction = 0) AS BIGINT) AS pred_0, CAST(count_if(prediction = 1) AS BIGINT) AS pred_1 FROM {SCORED_LABELS} s
  GROUP BY label) c USING (label)""", "measurements", "labeled_entries"))
def q_confusion(spark, sf):
    return MT.confusion_matrix(_scored_labels(spark, sf))


def _report_sql() -> str:
    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0E0 END)"
    p1, r1 = div("tp", "tp + fp"), div("tp", "tp + fn")
    p0, r0 = div("tn", "tn + fn"), div("tn", "tn + fp")
    f1 = div(f"2 * {p1} * {r1}", f"{p1} + {r1}")
    f0 = div(f"2 * {p0} * {r0}", f"{p0} + {r0}")
    s1, s0, n = "(tp + fn)", "(tn + fp)", "(tp + fn + tn + fp)"

    def row(cls, p, r, f, s):
        return (f"SELECT '{cls}' AS class, {Q.rround(p, 4) if p else 'NULL::DOUBLE'} AS precision, "
                f"{Q.rround(r, 4) if r else 'NULL::DOUBLE'} AS recall, {Q.rround(f, 4)} AS f1, "
                f"CAST({s} AS BIGINT) AS support FROM c")
    rows = [row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
            row("accuracy", None, None, div("tp + tn", n), n),
            row("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            row("weighted avg", div(f"{p0} * {s0} + {p1} * {s1}", n), div(f"{r0} * {s0} + {r1} * {s1}", n),
                div(f"{f0} * {s0} + {f1} * {s1}", n), n)]
    return (f"""WITH c AS (SELECT CAST(CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS DOUBLE) AS tp,
  CAST(CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS DOUBLE) AS fp, CAST(CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS DOUBLE) AS fn,
  CAST(CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS DOUBLE) AS tn FROM {SCORED_LABELS} s)\n"""
            + "\nUNION ALL\n".join(rows))


@register("classification_report", V.with_views(_report_sql(), "measurements", "labeled_entries"))
def q_report(spark, sf):
    return MT.classification_report(_scored_labels(spark, sf))


@register("auc_roc", V.with_views(f"""
WITH per AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {SCORED_LABELS} s GROUP BY score),
r AS (SELECT *, COALESCE(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM per),
t AS (SELECT sum(pos * (below + (n + 1) / 2.0E0)) AS rank_sum, sum(pos) AS p, sum(n - pos) AS q FROM r)
SELECT CASE WHEN p > 0 AND q > 0 THEN {Q.rround('(rank_sum - p * (p + 1) / 2.0E0) / (p * q)', 6)} END AS auc_roc,
       CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg FROM t""", "measurements", "labeled_entries"))
def q_auc(spark, sf):
    return MT.auc_roc(_scored_labels(spark, sf))


# --- retraining -----------------------------------------------------------------------------------------

MODELS_SQL = """(SELECT user_id, count(*) AS n_user_samples, user_id % 7 <> 0 AS has_meta, max(timestamp) AS trained_at
FROM labeled_entries WHERE user_id % 3 <> 2 AND timestamp < TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id)"""


def models_table(spark, sf):
    """Model meta derived from the survey rows: users with id % 3 != 2 were trained on rows before 2024-01-25."""
    le = V.labeled_entries(spark, sf)
    return (le.filter((F.col("user_id") % 3 != 2) & (F.col("timestamp") < F.lit("2024-01-25 00:00:00")
                                                     .cast("timestamp_ntz")))
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_user_samples"), F.max("timestamp").alias("trained_at"))
              .withColumn("has_meta", F.col("user_id") % 7 != 0))


@register("user_sample_count", V.with_views(
    "SELECT user_id, count(*) AS n_samples FROM labeled_entries GROUP BY user_id", "labeled_entries"))
def q_user_sample_count(spark, sf):
    return R.user_sample_count(V.labeled_entries(spark, sf))


def _retrain_sql() -> str:
    new = "(n_samples - COALESCE(n_last, 0))"
    return f"""
SELECT user_id, n_samples, has_model,
  CASE WHEN n_samples < 30 THEN false WHEN NOT has_model THEN true WHEN NOT COALESCE(has_meta, false) THEN true
       ELSE {new} >= 10 END AS retrain,
  CASE WHEN n_samples < 30 THEN 'Donnees insuffisantes : ' || n_samples || '/30 (' || (30 - n_samples) || ' sondages restants)'
       WHEN NOT has_model THEN 'Premier entrainement (' || n_samples || ' samples disponibles)'
       WHEN NOT COALESCE(has_meta, false) THEN 'Metadata absente - re-entrainement force'
       WHEN {new} >= 10 THEN 'Nouvelles donnees suffisantes : +' || {new} || ' depuis le dernier entrainement'
       ELSE 'Pas assez de nouvelles donnees : +' || {new} || '/10' END AS reason
FROM (SELECT c.user_id, c.n_samples, m.user_id IS NOT NULL AS has_model, m.n_user_samples AS n_last, m.has_meta
      FROM (SELECT user_id, count(*) AS n_samples FROM labeled_entries GROUP BY user_id) c
      LEFT JOIN {MODELS_SQL} m USING (user_id)) t"""


@register("should_retrain", V.with_views(_retrain_sql(), "labeled_entries"))
def q_should_retrain(spark, sf):
    return R.should_retrain(V.labeled_entries(spark, sf), models_table(spark, sf))


@register("training_status", V.with_views(f"""
SELECT user_id, n_samples, 30 AS min_required,
       least(100.0E0, {Q.rround('n_samples / 30.0E0 * 100.0E0', 1)}) AS progress_pct, has_model,
       n_samples >= 30 AS ready_to_train,
       CAST(CASE WHEN has_model THEN greatest(0, 10 - (n_samples - COALESCE(n_last, 0)))
                 ELSE greatest(0, 30 - n_samples) END AS BIGINT) AS next_retrain_in, trained_at AS last_trained
FROM (SELECT c.user_id, c.n_samples, m.user_id IS NOT NULL AS has_model, m.n_user_samples AS n_last, m.trained_at
      FROM (SELECT user_id, count(*) AS n_samples FROM labeled_entries GROUP BY user_id) c
      LEFT JOIN {MODELS_SQL} m USING (user_id)) t""", "labeled_entries"))
def q_training_status(spark, sf):
    return R.training_status(V.labeled_entries(spark, sf), models_table(spark, sf))


@register("model_routing", V.with_views(f"""
SELECT e.event_id, e.user_id, CASE WHEN m.user_id IS NOT NULL THEN 'rf_user_' || CAST(e.user_id AS VARCHAR)
                                   ELSE 'rf_global' END AS model_used
FROM measurements e LEFT JOIN {MODELS_SQL} m USING (user_id)""", "labeled_entries", "measurements"))
def q_model_routing(spark, sf):
    r = V.measurements(spark, sf).select("event_id", "user_id")
    return R.model_routing(r, models_table(spark, sf), has_global=True)


@register("append_labeled", V.with_views(f"""
SELECT user_id, pm25, {', '.join(f'0.0E0 AS {f}' for f in FEATURE_NAMES if f != 'pm25')}, symptom_label, timestamp
FROM labeled_entries""", "labeled_entries"))
def q_append_labeled(spark, sf):
    return R.labeled_projection(V.labeled_entries(spark, sf))


APPEND_SQL = V.with_views(f"""
SELECT user_id, pm25, {', '.join(f'0.0E0 AS {f}' for f in FEATURE_NAMES if f != 'pm25')}, symptom_label, timestamp
FROM labeled_entries""", "labeled_entries")


def _shared(spark, what: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}_{uuid.uuid4().hex}"


@register("load_labeled", APPEND_SQL)
def q_load_labeled(spark, sf):
    """A8 (+A13): append the survey rows to a labeled table in the shared folder, load all users."""
    path = _shared(spark, "labeled")
    R.append_labeled(V.labeled_entries(spark, sf), path)
    return R.load_labeled(spark, path)


@register("stream_labels", APPEND_SQL)
def q_stream_labels(spark, sf):
    """Survey rows streamed into the labeled table, every answer kept, then read back."""
    from ..streaming import streams as ST
    base = _shared(spark, "stream_labels")
    src = V.events_stream(spark, sf).select(
        "user_id", "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("pm25"),
        F.when(F.col("value") + (F.col("event_id") * 7919) % 40 > 70, 1).otherwise(0).cast("int").alias("symptom_label"))
    q = ST.stream_labels(spark, src, f"{base}/table")
    q.awaitTermination()
    return R.load_labeled(spark, f"{base}/table")
