"""Registered queries: cleaning of station and health data (B-series, E3, E4, P1, P2)."""

from __future__ import annotations

from ..operators import clean as C
from ..sources import views as V
from ..tables import HEALTH_LIMITS, STATION_FEATURES, STATION_LIMITS
from . import pipelines as P
from . import sqlfrag as Q
from .catalog import register


def rh_sql(t="temperature", td="dewpoint"):
    a, b = "17.625E0", "243.04E0"
    rh = f"100.0E0 * (exp({a} * {td} / ({b} + {td})) / exp({a} * {t} / ({b} + {t})))"
    return Q.rround(Q.clip(rh, 0.0, 100.0), 2)


RH_VIEW = f"""(SELECT event_id, user_id, datetime, station, pm25, co, temperature, {rh_sql()} AS humidity
FROM measurements_raw)"""


def limits_sql(limits, cols=None):
    return " AND ".join(f"{c} BETWEEN {Q.lit(lo)} AND {Q.lit(hi)}" for c, lo, hi in limits
                        if cols is None or c in cols)


def interp_sql(src: str, keep: list[str], cols: list[str], part: str, order: str, limit: int) -> str:
    """Limited forward linear interpolation by row position (DuckDB windows over whole series)."""
    p = f"PARTITION BY {part}" if part else ""
    wp = f"OVER ({p} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wn = f"OVER ({p} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    win = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {wp} AS pr_{c}, "
        f"last_value({c} IGNORE NULLS) {wp} AS pv_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {wn} AS nr_{c}, "
        f"first_value({c} IGNORE NULLS) {wn} AS nv_{c}" for c in cols)
    fill = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pr_{c} IS NULL OR rn - pr_{c} > {limit} THEN NULL "
        f"WHEN nr_{c} IS NULL THEN pv_{c} "
        f"ELSE pv_{c} + (nv_{c} - pv_{c}) / CAST(nr_{c} - pr_{c} AS DOUBLE) * CAST(rn - pr_{c} AS DOUBLE) END AS {c}"
        for c in cols)
    return f"""(SELECT {', '.join(keep)}, {fill} FROM (
  SELECT *, {win} FROM (
    SELECT *, row_number() OVER ({p} ORDER BY {order}) AS rn FROM {src} s0) s1) s2)"""


# ---------------------------------------------------------------------------
# Station data
# ---------------------------------------------------------------------------

@register("rename_datetime", V.with_views("""
SELECT "PM2.5" AS pm25, "CO" AS co, "TEMP" AS temperature, "DEWP" AS dewpoint, station,
       make_timestamp(year, month, day, hour, 0, 0.0) AS datetime
FROM stations_raw""", "stations_raw"))
def q_rename(spark, sf):
    return C.rename_datetime(V.stations_raw(spark, sf))


@register("relative_humidity", V.with_views(f"SELECT * FROM {RH_VIEW} t", "measurements_raw"))
def q_rh(spark, sf):
    return C.relative_humidity(V.measurements_raw(spark, sf))


@register("remove_outliers", V.with_views(
    f"SELECT * FROM {RH_VIEW} t WHERE {limits_sql(STATION_LIMITS)}", "measurements_raw"))
def q_outliers(spark, sf):
    return C.remove_outliers(C.relative_humidity(V.measurements_raw(spark, sf)))


def _first_fail_sql(limits):
    parts = " ".join(f"WHEN NOT COALESCE({c} BETWEEN {Q.lit(lo)} AND {Q.lit(hi)}, false) THEN '{c}'"
                     for c, lo, hi in limits)
    return f"CASE {parts} END"


@register("outlier_counts", V.with_views(f"""
SELECT rows_before, {', '.join(f'removed_{c}' for c, _, _ in STATION_LIMITS)}, removed_total,
       CASE WHEN rows_before > 0 THEN {Q.rround('CAST(removed_total AS DOUBLE) / rows_before * 100.0E0', 2)} END
         AS removed_pct,
       rows_before - removed_total AS rows_after
FROM (SELECT count(*) AS rows_before,
             {', '.join(f"CAST(count_if(f = '{c}') AS BIGINT) AS removed_{c}" for c, _, _ in STATION_LIMITS)},
             count(f) AS removed_total
      FROM (SELECT {_first_fail_sql(STATION_LIMITS)} AS f FROM {RH_VIEW} t) a) b""", "measurements_raw"))
def q_outlier_counts(spark, sf):
    return C.outlier_counts(C.relative_humidity(V.measurements_raw(spark, sf)))


@register("drop_missing", V.with_views(
    f"SELECT * FROM {RH_VIEW} t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in STATION_FEATURES)}",
    "measurements_raw"))
def q_drop_missing(spark, sf):
    return C.drop_missing(C.relative_humidity(V.measurements_raw(spark, sf)))


INTERP_STATION_SQL = V.with_views("SELECT * FROM " + interp_sql(
    RH_VIEW, ["event_id", "user_id", "datetime", "station"], STATION_FEATURES, "station",
    "datetime NULLS LAST, event_id", 24) + " t", "measurements_raw")


@register("interpolate_station", INTERP_STATION_SQL)
def q_interp_station(spark, sf):
    x = C.relative_humidity(V.measurements_raw(spark, sf))
    return C.interpolate_station(x)


PREPROCESS_SQL = V.with_views(f"""
SELECT datetime, station, pm25, co, temperature, humidity
FROM {interp_sql(f'''(SELECT "No" AS event_id, station, make_timestamp(year, month, day, hour, 0, 0.0) AS datetime,
                            "PM2.5" AS pm25, "CO" AS co, "TEMP" AS temperature,
                            {rh_sql('"TEMP"', '"DEWP"')} AS humidity FROM stations_raw)''',
                 ["event_id", "datetime", "station"], STATION_FEATURES, "station", "datetime NULLS LAST, event_id", 24)} t
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in STATION_FEATURES)} AND {limits_sql(STATION_LIMITS)}""",
                              "stations_raw")


@register("preprocess", PREPROCESS_SQL)
def q_preprocess(spark, sf):
    # the day buckets of the row numbering are the interpolation blocks
    return P.preprocess(V.stations_raw(spark, sf))


# ---------------------------------------------------------------------------
# Health data
# ---------------------------------------------------------------------------

@register("health_project", V.with_views("""
SELECT date, "PM2.5" AS pm25, "CO" AS co, temperature, humidity, "AQI" AS aqi, population_density,
       respiratory_admissions FROM health_source""", "health_source"))
def q_health_project(spark, sf):
    return C.health_project(V.health_source(spark, sf))


CAL_SQL = """CAST(COALESCE(month(TRY_CAST(date AS TIMESTAMP)), 6) AS INTEGER) AS month,
       CAST(COALESCE(isodow(TRY_CAST(date AS TIMESTAMP)) - 1, 0) AS INTEGER) AS day_of_week"""


@register("health_calendar", V.with_views(f"""
SELECT event_id, pm25, co, temperature, humidity, aqi, population_density, respiratory_admissions, {CAL_SQL}
FROM health_raw""", "health_raw"))
def q_health_calendar(spark, sf):
    return C.health_calendar(V.health_raw(spark, sf))


LABEL_SQL = """CAST(COALESCE(respiratory_admissions >= (SELECT quantile_cont(respiratory_admissions, 0.75)
                                            FROM health_raw), false) AS INTEGER) AS symptom_label"""


@register("health_label", V.with_views(f"""
SELECT event_id, date, pm25, co, temperature, humidity, aqi, population_density, {LABEL_SQL}
FROM health_raw""", "health_raw"))
def q_health_label(spark, sf):
    return C.health_label(V.health_raw(spark, sf))


@register("health_outliers", V.with_views(
    f"SELECT * FROM health_raw WHERE {limits_sql(HEALTH_LIMITS)}", "health_raw"))
def q_health_outliers(spark, sf):
    return C.health_outliers(V.health_raw(spark, sf))


HEALTH_DOUBLES = ["pm25", "co", "temperature", "humidity", "aqi", "population_density"]
INTERP_GLOBAL_SQL = V.with_views("SELECT * FROM " + interp_sql(
    "health_raw", ["event_id", "date", "respiratory_admissions"], HEALTH_DOUBLES, "", "event_id", 5) + " t",
    "health_raw")


@register("interpolate_global", INTERP_GLOBAL_SQL)
def q_interp_global(spark, sf):
    return C.interpolate_global(V.health_raw(spark, sf), "event_id", 5)


HEALTH_PIPE_BODY = f"""
SELECT * FROM {interp_sql(f'''(SELECT event_id, pm25, co, temperature, humidity, aqi, population_density,
                                      {CAL_SQL}, {LABEL_SQL} FROM health_raw)''',
                          ["event_id", "month", "day_of_week", "symptom_label"], HEALTH_DOUBLES, "", "event_id", 5)} t
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in HEALTH_DOUBLES)} AND {limits_sql(HEALTH_LIMITS)}"""
HEALTH_PIPE_SQL = V.with_views(HEALTH_PIPE_BODY, "health_raw")


@register("health_pipeline", HEALTH_PIPE_SQL)
def q_health_pipeline(spark, sf):
    return C.health_pipeline(V.health_source(spark, sf))

