"""Registered queries: model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import features as FX
from ..functions import index as IX
from ..operators import clean as C
from ..operators import features as FT
from ..operators import scoring as S
from ..sources import views as V
from ..tables import FEATURE_NAMES
from . import sqlfrag as Q
from .catalog import register
from .q_clean import RH_VIEW

TWO_PI = "6.283185307179586E0"


def cyc_sql(h: str, m: str) -> str:
    return ", ".join([
        f"{Q.rround(f'sin({TWO_PI} * ({h}) / 24.0E0)', 6)} AS hour_sin",
        f"{Q.rround(f'cos({TWO_PI} * ({h}) / 24.0E0)', 6)} AS hour_cos",
        f"{Q.rround(f'sin({TWO_PI} * ({m}) / 12.0E0)', 6)} AS month_sin",
        f"{Q.rround(f'cos({TWO_PI} * ({m}) / 12.0E0)', 6)} AS month_cos"])


def code_sql(p: str) -> str:
    return (f"COALESCE(CASE lower(trim({p})) WHEN 'asthme' THEN 0 WHEN 'rhinite' THEN 1 WHEN 'bronchite' THEN 2 "
            f"WHEN 'copd' THEN 3 WHEN 'general' THEN 4 END, 4)")


def roll_sql(order: str, part: str = "station") -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"

    def mean(c):
        return Q.rround(f"CAST(sum(CAST({c} AS DECIMAL(38,6))) OVER {w} AS DOUBLE) / "
                        f"CAST(count({c}) OVER {w} AS DOUBLE)", 3)
    return ", ".join([f"{mean('pm25')} AS pm25_mean_24h", f"{mean('co')} AS co_mean_24h",
                      f"{mean('humidity')} AS humidity_mean_24h",
                      f"{Q.rround(f'max(pm25) OVER {w}', 3)} AS pm25_max_24h",
                      f"{Q.rround(f'max(co) OVER {w}', 3)} AS co_max_24h",
                      f"{Q.rround(f'max(ier_score) OVER {w}', 3)} AS ier_max_24h"])


def hist_sql(order: str, part: str = "station") -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    n = f"count(*) OVER {w}"

    def mean(c):
        return (f"CASE WHEN {n} = 0 THEN 0.0E0 ELSE "
                + Q.rround(f"CAST(sum(CAST(COALESCE({c}, 0.0E0) AS DECIMAL(38,6))) OVER {w} AS DOUBLE) / "
                           f"CAST({n} AS DOUBLE)", 3) + " END")

    def mx(c):
        return f"CASE WHEN {n} = 0 THEN 0.0E0 ELSE {Q.rround(f'max(COALESCE({c}, 0.0E0)) OVER {w}', 3)} END"
    return ", ".join([f"{mean('pm25')} AS pm25_mean_24h", f"{mean('co')} AS co_mean_24h",
                      f"{mean('humidity')} AS humidity_mean_24h", f"{mx('pm25')} AS pm25_max_24h",
                      f"{mx('co')} AS co_max_24h", f"{mx('ier_score')} AS ier_max_24h"])


SCORED = f"(SELECT *, {Q.score()} AS ier_score FROM measurements)"


@register("time_cyclical", V.with_views(
    f"SELECT event_id, {cyc_sql('hour(datetime)', 'month(datetime)')} FROM measurements", "measurements"))
def q_cyc(spark, sf):
    m = V.measurements(spark, sf)
    return m.select("event_id", *[e.alias(n) for n, e in FX.time_cyclical(F.hour("datetime"), F.month("datetime"))])


@register("zone_risk", V.with_views(f"""
SELECT event_id, z AS zone, {Q.zone_risk('z')} AS zone_risk_score FROM (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D'
                                     WHEN 4 THEN 'Z' END AS z FROM events) t""", "measurements"))
def q_zone_risk(spark, sf):
    ev = V.read_table(spark, sf, "events")
    m6 = F.col("event_id") % 6
    z = F.when(m6 == 0, "A").when(m6 == 1, "B").when(m6 == 2, "C").when(m6 == 3, "D").when(m6 == 4, "Z")
    return ev.select("event_id", z.alias("zone")).withColumn("zone_risk_score", A.zone_risk("zone"))


@register("profile_encode", V.with_views(f"""
SELECT user_id, age, {code_sql('pathologie')} AS pathologie_encoded, CAST(is_smoker AS INTEGER) AS is_smoker,
       CAST(symptom_yesterday AS INTEGER) AS symptom_yesterday FROM profiles""", "profiles"))
def q_profile_encode(spark, sf):
    p = V.profiles(spark, sf)
    return p.select("user_id", *[e.alias(n) for n, e in FX.profile_columns(
        "age", "pathologie", "is_smoker", "symptom_yesterday")])


PROFILE_JOIN_SQL = f"""
SELECT m.event_id, m.user_id, COALESCE(p.age, 35) AS age, {code_sql('p.pathologie')} AS pathologie_encoded,
       COALESCE(CAST(p.is_smoker AS INTEGER), 0) AS is_smoker,
       COALESCE(CAST(p.symptom_yesterday AS INTEGER), 0) AS symptom_yesterday
FROM measurements m LEFT JOIN profiles p ON m.user_id = p.user_id"""


@register("profile_join", V.with_views(PROFILE_JOIN_SQL, "measurements", "profiles"))
def q_profile_join(spark, sf):
    m = V.measurements(spark, sf).select("event_id", "user_id")
    return FT.profile_join(m, V.profiles(spark, sf))


ORDER = "datetime NULLS LAST, event_id"


@register("rolling_24", V.with_views(
    f"SELECT event_id, station, datetime, {roll_sql(ORDER)} FROM {SCORED} t", "measurements"))
def q_rolling(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", "station", "datetime", "pm25", "co", "humidity", IX.ier_score().alias("ier_score"))
    out = FT.rolling_24(x)
    return out.select("event_id", "station", "datetime", *[n for n, _, _ in FX.HISTORY_SPECS])


@register("history_features", V.with_views(
    f"SELECT event_id, {hist_sql(ORDER)} FROM {SCORED} t", "measurements"))
def q_history(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", "station", "datetime", "pm25", "co", "humidity", IX.ier_score().alias("ier_score"))
    h = FT.with_history(x)
    return FT.history_features(h).select("event_id", *[n for n, _, _ in FX.HISTORY_SPECS])


@register("symptom_lag", V.with_views("""
SELECT user_id, event_id, symptom_label,
       CAST(COALESCE(lag(symptom_label) OVER (PARTITION BY user_id ORDER BY timestamp NULLS LAST, event_id), 0)
            AS INTEGER) AS symptom_yesterday
FROM labeled_entries""", "labeled_entries"))
def q_symptom_lag(spark, sf):
    le = V.labeled_entries(spark, sf).withColumnRenamed("timestamp", "datetime")
    out = FT.symptom_lag(le, group="user_id")
    return out.select("user_id", "event_id", "symptom_label", "symptom_yesterday")


def features_sql(src: str, order: str = ORDER) -> str:
    """H7 over a scored source with zone and profile join."""
    return f"""
SELECT event_id, CAST(pm25 AS DOUBLE) AS pm25, CAST(co AS DOUBLE) AS co, CAST(humidity AS DOUBLE) AS humidity,
       CAST(temperature AS DOUBLE) AS temperature, CAST(ier_score AS DOUBLE) AS ier_score,
       CAST(zone_risk_score AS DOUBLE) AS zone_risk_score,
       hour_sin, hour_cos, month_sin, month_cos, pm25_mean_24h, co_mean_24h, humidity_mean_24h,
       pm25_max_24h, co_max_24h, ier_max_24h, CAST(age AS DOUBLE) AS age,
       CAST(pathologie_encoded AS DOUBLE) AS pathologie_encoded, CAST(is_smoker AS DOUBLE) AS is_smoker,
       CAST(symptom_yesterday AS DOUBLE) AS symptom_yesterday
FROM (SELECT s.*, {Q.zone_risk(Q.zone_from_ier('s.ier_score'))} AS zone_risk_score,
             {cyc_sql('hour(s.datetime)', 'month(s.datetime)')}, {roll_sql(order)},
             COALESCE(p.age, 35) AS age, {code_sql('p.pathologie')} AS pathologie_encoded,
             COALESCE(CAST(p.is_smoker AS INTEGER), 0) AS is_smoker,
             COALESCE(CAST(p.symptom_yesterday AS INTEGER), 0) AS symptom_yesterday
      FROM {src} s LEFT JOIN profiles p ON s.user_id = p.user_id) t"""


def features_spark(x, profiles):
    x = S.add_fallback_zone(x, record=False)
    x = FT.profile_join(x, profiles)
    return FT.features_batch(x)


@register("features_batch", V.with_views(features_sql(SCORED), "measurements", "profiles"))
def q_features_batch(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    return features_spark(m, V.profiles(spark, sf))


@register("feature_select", V.with_views(
    f"SELECT {', '.join(FEATURE_NAMES)} FROM ({features_sql(SCORED)}) f", "measurements", "profiles"))
def q_feature_select(spark, sf):
    return FT.feature_select(q_features_batch(spark, sf))


RAW_SCORED = f"(SELECT *, {Q.score()} AS ier_score FROM {RH_VIEW} r)"


def _finite_sql(c):
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}))"


@register("feature_validity", V.with_views(f"""
SELECT event_id, array_to_string(bad, ',') AS invalid_features, CAST(len(bad) AS INTEGER) AS n_invalid,
       len(bad) = 0 AS is_valid
FROM (SELECT event_id, list_filter([{', '.join(f"CASE WHEN NOT {_finite_sql(f)} THEN '{f}' END" for f in FEATURE_NAMES)}],
                                   lambda x: x IS NOT NULL) AS bad
      FROM ({features_sql(RAW_SCORED)}) f) t""", "measurements_raw", "profiles"))
def q_feature_validity(spark, sf):
    raw = C.relative_humidity(V.measurements_raw(spark, sf)).withColumn("ier_score", IX.ier_score())
    v = FT.feature_validity(features_spark(raw, V.profiles(spark, sf)))
    return v.select("event_id", F.array_join("invalid_features", ",").alias("invalid_features"),
                    F.size("invalid_features").alias("n_invalid"), "is_valid")


@register("finite_mask", V.with_views(f"""
SELECT * FROM ({features_sql(RAW_SCORED)}) f WHERE {' AND '.join(_finite_sql(c) for c in FEATURE_NAMES)}""",
                                      "measurements_raw", "profiles"))
def q_finite_mask(spark, sf):
    raw = C.relative_humidity(V.measurements_raw(spark, sf)).withColumn("ier_score", IX.ier_score())
    return FT.finite_mask(features_spark(raw, V.profiles(spark, sf)))


@register("features_realtime", V.with_views(f"""
SELECT event_id, pm25, co, humidity, temperature, ier_score,
       CAST({Q.zone_risk(Q.zone_from_ier('ier_score'))} AS DOUBLE) AS zone_risk_score,
       {cyc_sql('hour(datetime)', 'month(datetime)')}, {hist_sql(ORDER)},
       35.0E0 AS age, 4.0E0 AS pathologie_encoded, 0.0E0 AS is_smoker, 0.0E0 AS symptom_yesterday
FROM {SCORED} t""", "measurements"))
def q_features_realtime(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    m = m.withColumn("zone", A.zone_from_ier("ier_score"))
    h = FT.with_history(m)
    return FT.features_realtime(h)
