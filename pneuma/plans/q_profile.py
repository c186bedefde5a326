"""Registered queries: profiles and summaries."""

from __future__ import annotations

from ..functions import index as IX
from ..operators import clean as C
from ..operators import profile as PR
from ..sources import views as V
from ..tables import EXPECTED_STATIONS, STATION_FEATURES, STATION_LIMITS
from . import pipelines as P
from . import sqlfrag as Q
from .catalog import register
from .q_clean import RH_VIEW, limits_sql
from .q_index import M_COLS

RAW_COLS = ["PM2.5", "CO", "TEMP", "DEWP"]


@register("station_load_profile", V.with_views(f"""
SELECT station, count(*) AS n_rows, {', '.join(
    f'CAST(count_if("{c}" IS NULL) AS BIGINT) AS {c.replace(".", "").lower()}_nan' for c in RAW_COLS)}
FROM stations_raw GROUP BY station""", "stations_raw"))
def q_station_load_profile(spark, sf):
    return PR.station_load_profile(V.stations_raw(spark, sf))


_EXP = ", ".join(f"'{s}'" for s in EXPECTED_STATIONS)


@register("station_load_overall", V.with_views(f"""
SELECT count(*) AS n_rows, count(DISTINCT station) AS n_stations,
       array_to_string(list_sort(list_distinct(list(station))), ',') AS stations,
       min(make_timestamp(year, month, day, hour, 0, 0.0)) AS period_start,
       max(make_timestamp(year, month, day, hour, 0, 0.0)) AS period_end,
       CAST(len(list_filter([{_EXP}], lambda s: NOT list_contains(list(station), s))) AS INTEGER) AS n_expected_missing,
       CAST(len(list_filter(list_distinct(list(station)), lambda s: NOT list_contains([{_EXP}], s))) AS INTEGER)
         AS n_unexpected
FROM stations_raw""", "stations_raw"))
def q_station_load_overall(spark, sf):
    return PR.station_load_overall(V.stations_raw(spark, sf))


@register("raw_preview", V.with_views('SELECT * FROM stations_raw ORDER BY "No" LIMIT 5', "stations_raw"))
def q_raw_preview(spark, sf):
    return PR.raw_preview(V.stations_raw(spark, sf))


@register("level_distribution", V.with_views(f"""
SELECT ier_level, count(*) AS count FROM (SELECT {Q.level(Q.score())} AS ier_level FROM measurements) t
GROUP BY ier_level""", "measurements"))
def q_level_distribution(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_level", IX.risk_level(IX.ier_score()))
    return PR.value_counts(m, "ier_level")


@register("null_profile", V.with_views(f"""
SELECT feature, n_null, CASE WHEN n > 0 THEN {Q.rround('CAST(n_null AS DOUBLE) / n * 100.0E0', 2)} END AS pct_null
FROM (SELECT count(*) AS n, {', '.join(f'CAST(count_if({c} IS NULL) AS BIGINT) AS {c}' for c in STATION_FEATURES)} FROM {RH_VIEW} r) a
UNPIVOT (n_null FOR feature IN ({', '.join(STATION_FEATURES)}))""", "measurements_raw"))
def q_null_profile(spark, sf):
    return PR.null_profile(C.relative_humidity(V.measurements_raw(spark, sf)))


def _describe_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, count({c}) AS count, {Q.rround(Q.decimal_avg(c, 6), 3)} AS mean,
  {Q.rround(f'stddev_samp({c})', 3)} AS std, {Q.rround(f'min({c})', 3)} AS min,
  {Q.rround(f'quantile_cont({c}, 0.25)', 3)} AS p25, {Q.rround(f'quantile_cont({c}, 0.5)', 3)} AS p50,
  {Q.rround(f'quantile_cont({c}, 0.75)', 3)} AS p75, {Q.rround(f'max({c})', 3)} AS max FROM {src} s""")
    return "\nUNION ALL\n".join(parts)


@register("describe_stats", V.with_views(_describe_sql(RH_VIEW, STATION_FEATURES), "measurements_raw"))
def q_describe(spark, sf):
    return PR.describe_stats(C.relative_humidity(V.measurements_raw(spark, sf)))


@register("station_summary", V.with_views("""
SELECT station, count(*) AS n_rows, t.* FROM measurements CROSS JOIN
  (SELECT count(*) AS total_rows, count(DISTINCT station) AS n_stations, min(datetime) AS period_start,
          max(datetime) AS period_end FROM measurements) t
GROUP BY station, t.total_rows, t.n_stations, t.period_start, t.period_end""", "measurements"))
def q_station_summary(spark, sf):
    return PR.station_summary(V.measurements(spark, sf))


@register("humidity_summary", V.with_views(f"""
SELECT {Q.rround('min(humidity)', 3)} AS humidity_min, {Q.rround(Q.decimal_avg('humidity', 6), 3)} AS humidity_mean,
       {Q.rround('max(humidity)', 3)} AS humidity_max, min(datetime) AS datetime_min, max(datetime) AS datetime_max
FROM {RH_VIEW} r""", "measurements_raw"))
def q_humidity_summary(spark, sf):
    return PR.feature_summary(C.relative_humidity(V.measurements_raw(spark, sf)), "humidity")


@register("feature_bounds", V.with_views(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max "
                         f"FROM {RH_VIEW} r WHERE {limits_sql(STATION_LIMITS)}" for c in STATION_FEATURES),
    "measurements_raw"))
def q_feature_bounds(spark, sf):
    return PR.feature_bounds(C.remove_outliers(C.relative_humidity(V.measurements_raw(spark, sf))))


def _run_batch_sql():
    from .q_index import _contribs, _norms
    return V.with_views(f"""
SELECT *, {Q.zone_from_ier('ier_score')} AS zone, {Q.zone_field(Q.zone_from_ier('ier_score'), 1)} AS zone_label
FROM (SELECT *, {Q.level('ier_score')} AS ier_level, {Q.action('ier_score')} AS ier_action,
             {Q.color('ier_score')} AS ier_color, {_contribs}
      FROM (SELECT {M_COLS}, {_norms}, {Q.score()} AS ier_score FROM measurements) t) u""", "measurements")


@register("run_batch", _run_batch_sql())
def q_run_batch(spark, sf):
    m = V.measurements(spark, sf).select(*[c.strip() for c in M_COLS.split(",")])
    return P.run_batch(m, "general")


@register("batch_summary", V.with_views(f"""
WITH s AS (SELECT {Q.level(Q.score())} AS ier_level, {Q.zone_from_ier(Q.score())} AS zone FROM measurements)
SELECT dimension, value, count(*) AS count, (SELECT count(*) FROM s) AS total_rows FROM (
  SELECT 'ier_level' AS dimension, ier_level AS value FROM s UNION ALL SELECT 'zone', zone FROM s) t
GROUP BY dimension, value""", "measurements"))
def q_batch_summary(spark, sf):
    m = V.measurements(spark, sf).select(*[c.strip() for c in M_COLS.split(",")])
    return PR.batch_summary(P.run_batch(m, "general"))



from .q_clean import interp_sql  # noqa: E402


@register("null_profile_filled", V.with_views(f"""
SELECT feature, n_null, CASE WHEN n > 0 THEN {Q.rround('CAST(n_null AS DOUBLE) / n * 100.0E0', 2)} END AS pct_null
FROM (SELECT count(*) AS n, {', '.join(f'CAST(count_if({c} IS NULL) AS BIGINT) AS {c}' for c in STATION_FEATURES)}
      FROM {interp_sql(RH_VIEW, ['event_id', 'user_id', 'datetime', 'station'], STATION_FEATURES, 'station',
                       'datetime NULLS LAST, event_id', 24)} r) a
UNPIVOT (n_null FOR feature IN ({', '.join(STATION_FEATURES)}))""", "measurements_raw"))
def q_null_profile_filled(spark, sf):
    """D4 after the limited interpolation (the 'after fill' profile)."""
    x = C.interpolate_station(C.relative_humidity(V.measurements_raw(spark, sf)))
    return PR.null_profile(x)
