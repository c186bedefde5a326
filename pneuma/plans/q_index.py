"""Registered queries: index, levels, zones, alerts, crisis scalars (C-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..operators import scoring as S
from ..sources import views as V
from ..tables import IER_FEATURES, IER_WEIGHTS
from . import sqlfrag as Q
from .catalog import register

M_COLS = "event_id, station, datetime, pm25, co, humidity, temperature"


def _details_sql(p="general"):
    w = IER_WEIGHTS[p]
    norms = ", ".join(f"{Q.norm(f)} AS {f}_norm_ier" for f in IER_FEATURES)
    contribs = ", ".join(f"{Q.rround(f'{Q.lit(w[f])} * {f}_norm_ier', 3)} AS {f}_contrib" for f in IER_FEATURES)
    return norms, contribs


_norms, _contribs = _details_sql()
IER_BATCH_SQL = V.with_views(f"""
SELECT *, {Q.level('ier_score')} AS ier_level, {Q.action('ier_score')} AS ier_action,
       {Q.color('ier_score')} AS ier_color, {_contribs}
FROM (SELECT {M_COLS}, {_norms}, {Q.score()} AS ier_score FROM measurements) t
""", "measurements")


@register("ier_batch", IER_BATCH_SQL)
def q_ier_batch(spark, sf):
    m = V.measurements(spark, sf).select(*[c.strip() for c in M_COLS.split(",")])
    return S.ier_batch(m, "general", add_details=True)


@register("normalize_minmax", V.with_views(f"""
SELECT event_id, {', '.join(f'{Q.norm(f)} AS {f}_norm' for f in IER_FEATURES)},
       {Q.norm('pm25', 'pm25', {'pm25': (10.0, 10.0)})} AS pm25_norm_flat,
       {Q.norm('pm25', 'pm25', {'pm25': (0.0, 100.0)})} AS pm25_norm_custom
FROM measurements""", "measurements"))
def q_normalize(spark, sf):
    m = V.measurements(spark, sf)
    return m.select("event_id", *[IX.normalize_minmax(f, f).alias(f"{f}_norm") for f in IER_FEATURES],
                    IX.normalize_minmax("pm25", "pm25", {"pm25": (10.0, 10.0)}).alias("pm25_norm_flat"),
                    IX.normalize_minmax("pm25", "pm25", {"pm25": (0.0, 100.0)}).alias("pm25_norm_custom"))


@register("weights_check", V.with_views("""
SELECT p.pathologie, p.n_profiles, round_even(w.weight_sum, 9) AS weight_sum, coalesce(abs(w.weight_sum - 1.0E0) < 1e-9, false) AS valid,
       coalesce(w.n_features, 0) AS n_features
FROM (SELECT lower(trim(pathologie)) AS pathologie, count(*) AS n_profiles FROM profiles GROUP BY 1) p
LEFT JOIN (SELECT pathologie, sum(weight) AS weight_sum, count(*) AS n_features
           FROM (VALUES """ + ", ".join(f"('{p}', '{f}', {Q.lit(w[f])})" for p, w in IER_WEIGHTS.items() for f in IER_FEATURES)
    + """) AS w(pathologie, feature, weight) GROUP BY pathologie) w USING (pathologie)""", "profiles"))
def q_weights_check(spark, sf):
    from ..operators.scoring import weights_check
    return weights_check(V.profiles(spark, sf))


@register("risk_level", V.with_views(f"""
SELECT event_id, s, {Q.level('s')} AS level, {Q.color('s')} AS color, {Q.action('s')} AS action,
       CASE WHEN s <= 25 THEN 'Faible' WHEN s <= 50 THEN 'Modéré' WHEN s <= 75 THEN 'Élevé' ELSE 'Critique' END
         AS level_contiguous
FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ((event_id * 7) % 10500) / 100.0E0 - 2.0E0 END AS s
      FROM events) t""", "measurements"))
def q_risk_level(spark, sf):
    ev = V.read_table(spark, sf, "events")
    s = F.when(F.col("event_id") % 50 == 0, None).otherwise((F.col("event_id") * 7) % 10500 / 100.0 - 2.0)
    x = ev.select("event_id", s.alias("s"))
    return x.select("event_id", "s", IX.risk_level("s").alias("level"), IX.risk_color("s").alias("color"),
                    IX.risk_action("s").alias("action"),
                    IX.risk_level("s", contiguous=True).alias("level_contiguous"))


def _scored_sql(p="general"):
    return f"(SELECT {M_COLS}, {Q.score(p)} AS ier_score FROM measurements)"


@register("zone_from_ier", V.with_views(f"""
SELECT event_id, ier_score, {Q.zone_from_ier('ier_score')} AS zone, -1 AS cluster_id, true AS zone_fallback,
       {Q.zone_field(Q.zone_from_ier('ier_score'), 1)} AS zone_label,
       {Q.zone_field(Q.zone_from_ier('ier_score'), 2)} AS zone_description,
       {Q.zone_field(Q.zone_from_ier('ier_score'), 3)} AS zone_recommendation,
       {Q.zone_field(Q.zone_from_ier('ier_score'), 4)} AS zone_color,
       {Q.zone_field(Q.zone_from_ier('ier_score'), 5)} AS zone_risk_score
FROM {_scored_sql('asthme')} t""", "measurements"))
def q_zone_from_ier(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", IX.ier_score("asthme").alias("ier_score"))
    return S.add_fallback_zone(x)


@register("zone_info", V.with_views(f"""
SELECT user_id, z AS zone, {Q.zone_field('z', 1)} AS zone_label, {Q.zone_field('z', 2)} AS zone_description,
       {Q.zone_field('z', 3)} AS zone_recommendation, {Q.zone_field('z', 4)} AS zone_color,
       CAST({Q.zone_field('z', 5)} AS DOUBLE) AS zone_risk_score
FROM (SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'X' END AS z
      FROM (SELECT DISTINCT user_id FROM events)) t""", "measurements"))
def q_zone_info(spark, sf):
    u = V.read_table(spark, sf, "events").select("user_id").distinct()
    m5 = F.col("user_id") % 5
    z = F.when(m5 == 0, "A").when(m5 == 1, "B").when(m5 == 2, "C").when(m5 == 3, "D").otherwise("X")
    out = S.add_zone_info(u.select("user_id", z.alias("zone")))
    # unknown zones have no risk score: a double column keeps NULL as NaN in both engines' frames
    return out.withColumn("zone_risk_score", F.col("zone_risk_score").cast("double"))


ALERTS_SQL = V.with_views(f"""
SELECT event_id, ier_score, ier_level, ier_action, zone, {Q.alert_cols()}
FROM (SELECT event_id, ier_score, {Q.level('ier_score')} AS ier_level, {Q.action('ier_score')} AS ier_action,
             CASE WHEN event_id % 9 = 0 THEN NULL ELSE {Q.zone_from_ier('ier_score * 1.6E0')} END AS zone
      FROM (SELECT event_id, {Q.score('rhinite')} AS ier_score FROM measurements) a) t""", "measurements")


@register("alerts", ALERTS_SQL)
def q_alerts(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", IX.ier_score("rhinite").alias("ier_score"))
    x = x.select("event_id", "ier_score", IX.risk_level("ier_score").alias("ier_level"),
                 IX.risk_action("ier_score").alias("ier_action"),
                 F.when(F.col("event_id") % 9 == 0, None)
                  .otherwise(A.zone_from_ier(F.col("ier_score") * 1.6)).alias("zone"))
    return S.add_alerts(x)


SCORE_RT_SQL = V.with_views(f"""
SELECT *, {Q.alert_cols(rec='zone_recommendation')}
FROM (SELECT event_id, station, datetime, pm25, co, humidity, temperature, ier_score,
             {Q.level('ier_score')} AS ier_level, {Q.action('ier_score')} AS ier_action,
             {Q.color('ier_score')} AS ier_color,
             {Q.zone_from_ier('ier_score')} AS zone, {Q.zone_field(Q.zone_from_ier('ier_score'), 1)} AS zone_label,
             {Q.zone_field(Q.zone_from_ier('ier_score'), 2)} AS zone_description,
             {Q.zone_field(Q.zone_from_ier('ier_score'), 3)} AS zone_recommendation,
             {Q.zone_field(Q.zone_from_ier('ier_score'), 4)} AS zone_color,
             {Q.zone_field(Q.zone_from_ier('ier_score'), 5)} AS zone_risk_score,
             -1 AS cluster_id, true AS zone_fallback
      FROM {_scored_sql('asthme')} s) t""", "measurements")


@register("score_realtime", SCORE_RT_SQL)
def q_score_realtime(spark, sf):
    m = V.measurements(spark, sf).select(*[c.strip() for c in M_COLS.split(",")])
    return S.score_realtime(m, "asthme")


@register("ier_all_pathologies", V.with_views(f"""
SELECT event_id, pathologie, ier_score, {Q.level('ier_score')} AS ier_level FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT event_id, '{p}' AS pathologie, {Q.score(p)} AS ier_score FROM measurements" for p in IER_WEIGHTS)
    + ") t", "measurements"))
def q_ier_all(spark, sf):
    return S.ier_all_pathologies(V.measurements(spark, sf))


@register("ier_detail", V.with_views(f"""
SELECT event_id, ier_score, {Q.level('ier_score')} AS level, {Q.color('ier_score')} AS color,
       {Q.action('ier_score')} AS action, {", ".join(
           f"{Q.rround(f, 3)} AS {f}_raw, {Q.rround(Q.norm(f), 2)} AS {f}_normalized, "
           f"{Q.lit(IER_WEIGHTS['bronchite'][f])} AS {f}_weight, "
           f"{Q.rround(Q.lit(IER_WEIGHTS['bronchite'][f]) + ' * ' + Q.norm(f), 2)} AS {f}_contribution"
           for f in IER_FEATURES)}, 'bronchite' AS pathologie
FROM (SELECT *, {Q.score('bronchite')} AS ier_score FROM measurements) t""", "measurements"))
def q_ier_detail(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", "pm25", "co", "humidity", "temperature",
                 IX.ier_score("bronchite").alias("ier_score"), IX.ier_detail("bronchite").alias("details"))
    cols = [F.col("event_id"), F.col("ier_score"), IX.risk_level("ier_score").alias("level"),
            IX.risk_color("ier_score").alias("color"), IX.risk_action("ier_score").alias("action")]
    for f in IER_FEATURES:
        for k in ("raw", "normalized", "weight", "contribution"):
            cols.append(F.col("details")[f][k].alias(f"{f}_{k}"))
    cols.append(F.lit("bronchite").alias("pathologie"))
    return x.select(*cols)


CRISIS_SQL = V.with_views(f"""
SELECT event_id, ier_score, zone, symptom_yesterday, p_batch, {Q.crisis_level('p_batch')} AS level_batch,
       p_single, lv AS level_single, {Q.crisis_color('lv')} AS color_single, p_single >= 0.4E0 AS notify_single,
       {Q.crisis_message('p_single', 'lv', "'general'")} AS message_single
FROM (SELECT *, {Q.crisis_level('p_single')} AS lv FROM (
  SELECT event_id, ier_score, zone, symptom_yesterday, {Q.crisis_base('ier_score')} AS p_batch,
         {Q.rround(
             "CASE WHEN symptom_yesterday THEN least(pz + 0.1E0, 1.0E0) ELSE pz END", 4)} AS p_single
  FROM (SELECT *, CASE WHEN zone IN ('C', 'D') THEN least({Q.crisis_base('ier_score')} + 0.15E0, 1.0E0)
                       ELSE {Q.crisis_base('ier_score')} END AS pz
        FROM (SELECT event_id, ier_score, {Q.zone_from_ier('ier_score * 1.3E0')} AS zone,
                     event_id % 4 = 1 AS symptom_yesterday
              FROM (SELECT event_id, {Q.score('asthme')} AS ier_score FROM measurements) a) b) c) d) e
""", "measurements")


@register("crisis_heuristic", CRISIS_SQL)
def q_crisis_heuristic(spark, sf):
    m = V.measurements(spark, sf)
    x = m.select("event_id", IX.ier_score("asthme").alias("ier_score"))
    x = x.select("event_id", "ier_score", A.zone_from_ier(F.col("ier_score") * 1.3).alias("zone"),
                 (F.col("event_id") % 4 == 1).alias("symptom_yesterday"))
    x = x.withColumn("p_batch", A.crisis_heuristic_base("ier_score"))
    x = x.withColumn("level_batch", A.crisis_alert_level("p_batch"))
    x = x.withColumn("p_single", A.crisis_heuristic_single("ier_score", "zone", "symptom_yesterday"))
    x = x.withColumn("level_single", A.crisis_alert_level("p_single"))
    return x.withColumns({
        "color_single": A.crisis_alert_color("level_single"),
        "notify_single": A.crisis_notify("p_single"),
        "message_single": A.crisis_message("p_single", "level_single", F.lit("general")),
    })


def _reading_strings(ev):
    eid = F.col("event_id")
    return ev.select(
        "event_id",
        F.when(eid % 97 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("pm25"),
        F.when(eid % 89 == 0, F.lit(None)).otherwise(((eid * 37) % 5000 / 100.0).cast("string")).alias("co"),
        ((eid * 53) % 1000 / 10.0).cast("string").alias("humidity"),
        F.when(eid % 83 == 0, F.lit("x")).otherwise(((eid * 31) % 700 / 10.0 - 25.0).cast("string"))
         .alias("temperature"))


@register("reading_validation", V.with_views("""
SELECT event_id, TRY_CAST(pm25 AS DOUBLE) AS pm25, TRY_CAST(co AS DOUBLE) AS co,
       TRY_CAST(humidity AS DOUBLE) AS humidity, TRY_CAST(temperature AS DOUBLE) AS temperature,
       NULLIF(concat_ws(';', CASE WHEN miss <> '' THEN 'missing:' || miss END,
                             CASE WHEN bad <> '' THEN 'not_numeric:' || bad END), '') AS reject_reason,
       NULLIF(concat_ws(';', CASE WHEN miss <> '' THEN 'missing:' || miss END,
                             CASE WHEN bad <> '' THEN 'not_numeric:' || bad END), '') IS NULL AS is_valid
FROM (SELECT *, concat_ws(',', CASE WHEN pm25 IS NULL THEN 'pm25' END, CASE WHEN co IS NULL THEN 'co' END,
                          CASE WHEN humidity IS NULL THEN 'humidity' END,
                          CASE WHEN temperature IS NULL THEN 'temperature' END) AS miss,
             concat_ws(',', CASE WHEN pm25 IS NOT NULL AND TRY_CAST(pm25 AS DOUBLE) IS NULL THEN 'pm25' END,
                          CASE WHEN co IS NOT NULL AND TRY_CAST(co AS DOUBLE) IS NULL THEN 'co' END,
                          CASE WHEN humidity IS NOT NULL AND TRY_CAST(humidity AS DOUBLE) IS NULL THEN 'humidity' END,
                          CASE WHEN temperature IS NOT NULL AND TRY_CAST(temperature AS DOUBLE) IS NULL
                               THEN 'temperature' END) AS bad
      FROM (SELECT event_id,
                   CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS pm25,
                   CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(((event_id * 37) % 5000) / 100.0E0 AS VARCHAR) END AS co,
                   CAST(((event_id * 53) % 1000) / 10.0E0 AS VARCHAR) AS humidity,
                   CASE WHEN event_id % 83 = 0 THEN 'x'
                        ELSE CAST(((event_id * 31) % 700) / 10.0E0 - 25.0E0 AS VARCHAR) END AS temperature
            FROM events) s) t""", "measurements"))
def q_reading_validation(spark, sf):
    return S.validate_readings(_reading_strings(V.read_table(spark, sf, "events")))


@register("pathologie_check", V.with_views("""
SELECT lower(trim(pathologie)) AS pathologie, count(*) AS n_rows,
       COALESCE(lower(trim(pathologie)) IN ('asthme', 'rhinite', 'bronchite', 'general'), false) AS has_weights
FROM profiles GROUP BY lower(trim(pathologie))""", "profiles"))
def q_pathologie_check(spark, sf):
    return S.pathologie_check(V.profiles(spark, sf))


@register("sort_series", V.with_views(f"""
SELECT {M_COLS} FROM measurements ORDER BY station, datetime NULLS LAST, event_id""", "measurements"))
def q_sort_series(spark, sf):
    """readings in (station, datetime) order; the sort is the output (range-partitioned, no single task)."""
    m = V.measurements(spark, sf).select(*[c.strip() for c in M_COLS.split(",")])
    return m.orderBy("station", F.col("datetime").asc_nulls_last(), "event_id")


@register("realtime", SCORE_RT_SQL)
def q_realtime(spark, sf):
    """The per-reading pipeline (index, zone fallback, alert) as one projection."""
    return q_score_realtime(spark, sf)
