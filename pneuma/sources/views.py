"""Portable input views derived from the driver tables (``events``, ``customer``).

Each view exists twice: as a Spark DataFrame built with the DataFrame API
(column pruning and filters reach the Parquet scan), and as SQL text that
DuckDB runs over the same Parquet files for the oracle checks. Both forms
define the same rows and types.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite_columns


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _station(user_id: Column) -> Column:
    return F.concat(F.lit("station_"), (user_id % 12).cast("string"))


def _eid_mod(mult: int, mod: int) -> Column:
    return (F.col("event_id") * mult) % mod


#: What a reading's missing value may look like in a file: see ``odd_values``.
_ODD = False


@contextmanager
def odd_values():
    """Inside, the readings hold NaN and infinities as files may, and are read through the sources' normalisation."""
    global _ODD
    _ODD = True
    try:
        yield
    finally:
        _ODD = False


def _as_read(df: DataFrame) -> DataFrame:
    if not _ODD:
        return df
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return finite_columns(df.withColumns({
        "pm25": F.when(F.col("pm25").isNull() | (F.col("event_id") % 50 == 0), nan)
                 .when(F.col("event_id") % 50 == 1, inf).when(F.col("event_id") % 50 == 2, -inf).otherwise(F.col("pm25")),
        "co": F.when(F.col("co").isNull() | (F.col("event_id") % 40 == 3), nan).otherwise(F.col("co"))}))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean hourly-ish readings, no nulls (skips the cleaning stage)."""
    return _as_read(measurements_from(read_table(spark, sf_dir, "events")))


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a streaming file source."""
    schema = read_table(spark, sf_dir, "events").schema
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(sf_dir)


def measurements_from(ev: DataFrame) -> DataFrame:
    """``measurements`` over any events DataFrame (batch or streaming)."""
    return ev.select(
        "event_id", "user_id", F.col("ts").alias("datetime"),
        _station(F.col("user_id")).alias("station"),
        F.col("value").alias("pm25"),
        (_eid_mod(37, 5000) / 100.0).alias("co"),
        (_eid_mod(53, 1000) / 10.0).alias("humidity"),
        (_eid_mod(31, 700) / 10.0 - 25.0).alias("temperature"),
    )


def measurements_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings before cleaning: nulls, a long null run, outliers, dew point."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    uid = F.col("user_id")
    return _as_read(ev.select(
        "event_id", "user_id", F.col("ts").alias("datetime"),
        _station(uid).alias("station"),
        F.when(eid % 7 == 0, None)
         .when((uid % 12 == 3) & F.dayofmonth("ts").between(10, 20), None)
         .otherwise(F.col("value") * 3.0).alias("pm25"),
        F.when(eid % 11 == 0, None).when(eid % 211 == 1, -1.0)
         .otherwise(_eid_mod(37, 5000) / 100.0).alias("co"),
        F.when(eid % 13 == 0, None).when(eid % 101 == 1, 75.0)
         .otherwise(_eid_mod(31, 700) / 10.0 - 25.0).alias("temperature"),
        (_eid_mod(31, 700) / 10.0 - 25.0 - _eid_mod(17, 250) / 10.0).alias("dewpoint"),
    ))


def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw station-file layout (year/month/day/hour, PM2.5, CO, TEMP, DEWP, ...)."""
    m = measurements_raw(spark, sf_dir)
    return m.select(
        F.col("event_id").alias("No"),
        F.year("datetime").alias("year"), F.month("datetime").alias("month"),
        F.dayofmonth("datetime").alias("day"), F.hour("datetime").alias("hour"),
        F.col("pm25").alias("PM2.5"), F.col("co").alias("CO"),
        F.col("temperature").alias("TEMP"), F.col("dewpoint").alias("DEWP"),
        "station",
        (F.col("event_id") % 360).cast("double").alias("PRES"),
        F.lit("NW").alias("wd"),
    )


def health_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health-survey layout in canonical names (order key: event_id)."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        "event_id",
        F.when(eid % 29 == 0, "not-a-date").otherwise(F.col("ts").cast("date").cast("string")).alias("date"),
        F.when((eid % 9).isin(0, 1), None).when(eid % 400 < 12, None).otherwise(F.col("value")).alias("pm25"),
        (_eid_mod(37, 5000) / 100.0).alias("co"),
        (_eid_mod(31, 700) / 10.0 - 15.0).alias("temperature"),
        (_eid_mod(53, 1000) / 10.0).alias("humidity"),
        _eid_mod(19, 520).cast("double").alias("aqi"),
        _eid_mod(23, 9000).cast("double").alias("population_density"),
        F.when(eid % 17 == 0, None).otherwise(_eid_mod(13, 50).cast("double")).alias("respiratory_admissions"),
    )


def health_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``health_raw`` with the source file's column names (PM2.5, CO, AQI)."""
    return health_raw(spark, sf_dir).withColumnsRenamed({"pm25": "PM2.5", "co": "CO", "aqi": "AQI"})


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m6 = k % 6
    return c.select(
        k.alias("user_id"),
        (F.lit(25) + k % 45).cast("int").alias("age"),
        F.when(m6 == 0, "asthme").when(m6 == 1, " Rhinite ").when(m6 == 2, "bronchite")
         .when(m6 == 3, "copd").when(m6 == 4, "general").otherwise("inconnu").alias("pathologie"),
        (k % 5 == 0).alias("is_smoker"),
        (k % 3 == 0).alias("symptom_yesterday"),
    )


def labeled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "user_id", "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("pm25"),
        F.when(F.col("value") + _eid_mod(7919, 40) > 70, 1).otherwise(0).cast("int").alias("symptom_label"),
    )


#: Files of ``arrivals`` come in so many parts, each after the one before.
ARRIVAL_PARTS = 5


def arrival_part(ts: Column, event_id: Column) -> Column:
    """The part in which a reading arrives: six days each; some readings come one or three days late."""
    day = F.dayofmonth(ts) + F.when(event_id % 17 == 0, 3).when(event_id % 29 == 0, 1).otherwise(0)
    return F.least(F.floor((day - 1) / 6), F.lit(ARRIVAL_PARTS - 1)).cast("int")


ARRIVAL_SQL = (f"least(((day(datetime) + CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 29 = 0 THEN 1 ELSE 0 END - 1) // 6)"
               f"::INTEGER, {ARRIVAL_PARTS - 1})")


def write_arrivals(spark: SparkSession, sf_dir: str, folder: str, part: int, files: int = 4) -> None:
    """Write one part of the events as files of a stream's source folder."""
    ev = read_table(spark, sf_dir, "events")
    ev.where(arrival_part(F.col("ts"), F.col("event_id")) == part).repartition(files).write.mode("append").parquet(folder)


def arrivals_stream(spark: SparkSession, sf_dir: str, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Readings (``measurements``) from the files of ``folder``, as they come."""
    r = spark.readStream.schema(read_table(spark, sf_dir, "events").schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return measurements_from(r.parquet(folder))


def messages_from(ev: DataFrame) -> DataFrame:
    """``value``: the readings as raw JSON messages, some broken, some with a field missing, null or not numeric."""
    eid = F.col("event_id")

    def number(c: Column) -> Column:
        return c.cast("decimal(18,2)").cast("string")

    m = measurements_from(ev)
    pm25 = F.when(eid % 23 == 0, F.lit('"n/a"')).when(eid % 31 == 0, F.lit("null")).otherwise(number(F.col("pm25")))
    co = F.when(eid % 19 == 0, F.lit("")).otherwise(F.concat(F.lit(', "co": '), number(F.col("co"))))
    whole = F.concat(
        F.lit('{"event_id": '), eid.cast("string"), F.lit(', "user_id": '), F.col("user_id").cast("string"),
        F.lit(', "station": "'), F.col("station"), F.lit('", "datetime": "'), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"),
        F.lit('", "pm25": '), pm25, co, F.lit(', "humidity": "'), number(F.col("humidity")), F.lit('", "temperature": '),
        number(F.col("temperature")), F.lit("}"))
    broken = F.concat(F.lit('{"event_id": '), eid.cast("string"), F.lit(', "pm25": '))
    return m.select(F.when(eid % 101 == 0, broken).otherwise(whole).alias("value"))


MESSAGES_SQL = """
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN '{"event_id": ' || event_id || ', "pm25": '
  ELSE '{"event_id": ' || event_id || ', "user_id": ' || user_id || ', "station": "' || station || '", "datetime": "'
    || strftime(datetime, '%Y-%m-%d %H:%M:%S') || '", "pm25": '
    || CASE WHEN event_id % 23 = 0 THEN '"n/a"' WHEN event_id % 31 = 0 THEN 'null' ELSE CAST(CAST(pm25 AS DECIMAL(18,2)) AS VARCHAR) END
    || CASE WHEN event_id % 19 = 0 THEN '' ELSE ', "co": ' || CAST(CAST(co AS DECIMAL(18,2)) AS VARCHAR) END
    || ', "humidity": "' || CAST(CAST(humidity AS DECIMAL(18,2)) AS VARCHAR) || '", "temperature": '
    || CAST(CAST(temperature AS DECIMAL(18,2)) AS VARCHAR) || '}' END AS value
FROM measurements"""


ZONE_CENTROIDS = [
    (0, "B", 40.0, 20.0, 50.0, 10.0, 30.0),
    (1, "D", 300.0, 40.0, 80.0, 30.0, 65.0),
    (2, "A", 10.0, 5.0, 30.0, 0.0, 15.0),
    (3, "C", 120.0, 30.0, 70.0, 20.0, 45.0),
]


def zone_centroids(spark: SparkSession) -> DataFrame:
    """Fixed 4-centroid model (original scale) for checkable zone assignment."""
    return spark.createDataFrame(
        ZONE_CENTROIDS,
        "cluster_id int, zone string, pm25 double, co double, humidity double, "
        "temperature double, ier_score double")


# ---------------------------------------------------------------------------
# SQL text of the same views (DuckDB dialect; tables events/customer exist)
# ---------------------------------------------------------------------------

SQL_VIEWS = {
    "measurements": """
SELECT event_id, user_id, ts AS datetime,
       'station_' || CAST(user_id % 12 AS VARCHAR) AS station,
       value AS pm25,
       ((event_id * 37) % 5000) / 100.0E0 AS co,
       ((event_id * 53) % 1000) / 10.0E0 AS humidity,
       ((event_id * 31) % 700) / 10.0E0 - 25.0E0 AS temperature
FROM events""",
    "measurements_raw": """
SELECT event_id, user_id, ts AS datetime,
       'station_' || CAST(user_id % 12 AS VARCHAR) AS station,
       CASE WHEN event_id % 7 = 0 THEN NULL
            WHEN user_id % 12 = 3 AND day(ts) BETWEEN 10 AND 20 THEN NULL
            ELSE value * 3E0 END AS pm25,
       CASE WHEN event_id % 11 = 0 THEN NULL
            WHEN event_id % 211 = 1 THEN -1E0
            ELSE ((event_id * 37) % 5000) / 100.0E0 END AS co,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 101 = 1 THEN 75E0
            ELSE ((event_id * 31) % 700) / 10.0E0 - 25.0E0 END AS temperature,
       ((event_id * 31) % 700) / 10.0E0 - 25.0E0 - ((event_id * 17) % 250) / 10.0E0 AS dewpoint
FROM events""",
    "stations_raw": """
SELECT event_id AS "No", CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month,
       CAST(day(datetime) AS INTEGER) AS day, CAST(hour(datetime) AS INTEGER) AS hour,
       pm25 AS "PM2.5", co AS "CO", temperature AS "TEMP", dewpoint AS "DEWP", station,
       CAST(event_id % 360 AS DOUBLE) AS "PRES", 'NW' AS wd
FROM measurements_raw""",
    "health_raw": """
SELECT event_id,
       CASE WHEN event_id % 29 = 0 THEN 'not-a-date' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
       CASE WHEN event_id % 9 IN (0, 1) THEN NULL WHEN event_id % 400 < 12 THEN NULL ELSE value END AS pm25,
       ((event_id * 37) % 5000) / 100.0E0 AS co,
       ((event_id * 31) % 700) / 10.0E0 - 15.0E0 AS temperature,
       ((event_id * 53) % 1000) / 10.0E0 AS humidity,
       CAST((event_id * 19) % 520 AS DOUBLE) AS aqi,
       CAST((event_id * 23) % 9000 AS DOUBLE) AS population_density,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((event_id * 13) % 50 AS DOUBLE) END AS respiratory_admissions
FROM events""",
    "health_source": """
SELECT event_id, date, pm25 AS "PM2.5", co AS "CO", temperature, humidity, aqi AS "AQI",
       population_density, respiratory_admissions
FROM health_raw""",
    "profiles": """
SELECT c_custkey AS user_id,
       CAST(25 + c_custkey % 45 AS INTEGER) AS age,
       CASE c_custkey % 6 WHEN 0 THEN 'asthme' WHEN 1 THEN ' Rhinite ' WHEN 2 THEN 'bronchite'
                          WHEN 3 THEN 'copd' WHEN 4 THEN 'general' ELSE 'inconnu' END AS pathologie,
       c_custkey % 5 = 0 AS is_smoker,
       c_custkey % 3 = 0 AS symptom_yesterday
FROM customer""",
    "labeled_entries": """
SELECT user_id, event_id, ts AS timestamp, value AS pm25,
       CAST(CASE WHEN value + (event_id * 7919) % 40 > 70 THEN 1 ELSE 0 END AS INTEGER) AS symptom_label
FROM events""",
    "zone_centroids": """
SELECT * FROM (VALUES
  (0, 'B', 40.0E0, 20.0E0, 50.0E0, 10.0E0, 30.0E0),
  (1, 'D', 300.0E0, 40.0E0, 80.0E0, 30.0E0, 65.0E0),
  (2, 'A', 10.0E0, 5.0E0, 30.0E0, 0.0E0, 15.0E0),
  (3, 'C', 120.0E0, 30.0E0, 70.0E0, 20.0E0, 45.0E0)
) AS t(cluster_id, zone, pm25, co, humidity, temperature, ier_score)""",
}

#: Values that ``odd_values`` makes odd, as the NULLs that reading turns them into.
ODD_COLUMNS = ("CASE WHEN event_id % 50 IN (0, 1, 2) THEN NULL ELSE pm25 END AS pm25, "
               "CASE WHEN event_id % 40 = 3 THEN NULL ELSE co END AS co")


def with_odd_values(sql: str) -> str:
    """Oracle text over readings with the odd values missing."""
    for name in ("measurements", "measurements_raw"):
        sql = sql.replace(SQL_VIEWS[name], f"\nSELECT * REPLACE ({ODD_COLUMNS}) FROM ({SQL_VIEWS[name]}) odd")
    return sql


# Dependency order for WITH clauses.
_VIEW_DEPS = {"stations_raw": ["measurements_raw"], "health_source": ["health_raw"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views (and their deps)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
