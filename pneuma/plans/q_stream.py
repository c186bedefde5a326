"""Registered queries: streaming forms (J1-J3, B12, H13), run over all available input (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..operators import scoring as S
from ..session import scratch_path
from ..sources import views as V
from ..streaming import epochs as EP
from ..streaming import streams as ST
from ..tables import CLUSTER_FEATURES
from . import sqlfrag as Q
from .catalog import register
from .q_features import ORDER, SCORED, hist_sql
from .q_forest import CRISIS_FOREST_SQL, crisis_columns, fixture
from .q_index import M_COLS, SCORE_RT_SQL
from .q_models import DAILY_SQL


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@register("stream_score", SCORE_RT_SQL)
def q_stream_score(spark, sf):
    """stream = batch for the stateless per-reading record (C11)."""
    m = V.measurements_from(V.events_stream(spark, sf)).select(*[c.strip() for c in M_COLS.split(",")])
    return ST.run_to_table(spark, ST.stream_score(m, "asthme"), _name("stream_score"))


def _source(spark, sf) -> str:
    """The events as the files of a stream's source, in parts that arrive one after the other, some rows late."""
    folder = scratch_path(spark, "arrivals")
    for part in range(V.ARRIVAL_PARTS):
        V.write_arrivals(spark, sf, folder, part)
    return folder


#: A row may come this late: a part of six days, its files in any order, and three days.
LATENESS_DAYS = 10


@register("stream_history", V.with_views(f"SELECT event_id, station, {hist_sql(ORDER)} FROM {SCORED} t",
                                         "measurements"))
def q_stream_history(spark, sf):
    """State by bucket and block of the series, over many small micro-batches out of order; equals the batch history."""
    m = V.arrivals_stream(spark, sf, _source(spark, sf), 4).withColumn("ier_score", IX.ier_score())
    return EP.stream_history(m, _name("history"), lateness_days=LATENESS_DAYS)


CLOSED_SQL = f"""
WITH p AS (SELECT s.*, {V.ARRIVAL_SQL} AS part FROM {SCORED} s),
w AS (SELECT part, max(max(datetime)) OVER (ORDER BY part) - INTERVAL 1 DAY AS mark FROM p GROUP BY part),
l AS (SELECT p.*, CAST(datetime AS DATE) AS date, coalesce(CAST(datetime AS DATE) + INTERVAL 1 DAY <= w.mark, false) AS late
      FROM p LEFT JOIN w ON w.part = p.part - 1)
"""


def _days(spark, sf):
    """The parts arrive one by one and the query is started anew for each: a micro-batch is a part."""
    folder, base = scratch_path(spark, "arrivals"), scratch_path(spark, "days")
    for part in range(V.ARRIVAL_PARTS):
        V.write_arrivals(spark, sf, folder, part)
        m = V.arrivals_stream(spark, sf, folder).withColumn("ier_score", IX.ier_score())
        days = EP.stream_closed_days(m, lateness="1 DAY", base=base)
    return days


@register("stream_closed_days", V.with_views(CLOSED_SQL + f"""
SELECT station, CAST(date AS VARCHAR) AS date, count(*) AS n_rows, {', '.join(f'{Q.decimal_avg(f, 6)} AS {f}' for f in CLUSTER_FEATURES)}
FROM l WHERE NOT late AND date + INTERVAL 1 DAY <= (SELECT max(mark) FROM w) GROUP BY station, date""", "measurements"))
def q_stream_closed_days(spark, sf):
    """J3 in append mode over restarts: each day once, when the watermark has passed it."""
    return _days(spark, sf).closed.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("stream_late_rows", V.with_views(CLOSED_SQL + f"""
SELECT event_id, station, datetime, {', '.join(CLUSTER_FEATURES)}, 'day_closed' AS reason FROM l WHERE late""", "measurements"))
def q_stream_late_rows(spark, sf):
    """The readings that came after their day was closed."""
    return _days(spark, sf).late


_READ_SQL = f"""
WITH msg AS ({V.MESSAGES_SQL}),
ok AS (SELECT event_id, station, date_trunc('second', datetime) AS datetime, pm25, co, humidity,
         CAST(CAST(temperature AS DECIMAL(18,2)) AS DOUBLE) AS temperature FROM measurements
       WHERE event_id % 101 <> 0 AND event_id % 23 <> 0 AND event_id % 31 <> 0 AND event_id % 19 <> 0)
"""


def _validated(spark, sf):
    m = V.messages_from(V.events_stream(spark, sf, 1))
    return EP.stream_validated(m, lambda x: S.score_realtime(x.drop("user_id"), "asthme"), _name("validated"))


@register("stream_valid_scores", V.with_views(_READ_SQL + f"""
SELECT event_id, station, datetime, pm25, co, humidity, temperature, ier_score, {Q.level('ier_score')} AS ier_level,
  {Q.zone_from_ier('ier_score')} AS zone FROM (SELECT *, {Q.score('asthme')} AS ier_score FROM ok) t""", "measurements"))
def q_stream_valid_scores(spark, sf):
    """B12 on a stream of messages: the valid ones, scored."""
    return _validated(spark, sf)[0].select("event_id", "station", "datetime", "pm25", "co", "humidity", "temperature",
                                           "ier_score", "ier_level", "zone")


@register("stream_rejects", V.with_views(_READ_SQL + """
SELECT CASE WHEN event_id % 101 <> 0 THEN event_id END AS event_id,
  CASE WHEN event_id % 101 = 0 THEN 'unparsable' ELSE concat_ws(';',
    CASE WHEN (event_id % 23 <> 0 AND event_id % 31 = 0) OR event_id % 19 = 0 THEN 'missing:' || concat_ws(',',
      CASE WHEN event_id % 23 <> 0 AND event_id % 31 = 0 THEN 'pm25' END, CASE WHEN event_id % 19 = 0 THEN 'co' END) END,
    CASE WHEN event_id % 23 = 0 THEN 'not_numeric:pm25' END) END AS reject_reason, value AS raw
FROM msg WHERE event_id NOT IN (SELECT event_id FROM ok)""", "measurements"))
def q_stream_rejects(spark, sf):
    """B12 on a stream of messages: the others, with reason and raw message."""
    return _validated(spark, sf)[1]


@register("stream_crisis", CRISIS_FOREST_SQL)
def q_stream_crisis(spark, sf):
    """J2 then H13: history from the state, the user's static profile, a stored forest; equals the batch ``crisis_realtime_forest``."""
    m = V.arrivals_stream(spark, sf, _source(spark, sf), 4).withColumn("ier_score", IX.ier_score("asthme"))
    m = m.withColumn("zone", A.zone_from_ier(F.col("ier_score") * 1.3))
    return EP.stream_crisis(m, V.profiles(spark, sf), fixture(spark), _name("crisis"), lateness_days=LATENESS_DAYS, columns=crisis_columns)


@register("stream_daily_mean", V.with_views(f"""
SELECT station, CAST(date AS VARCHAR) AS date, {', '.join(CLUSTER_FEATURES)} FROM {DAILY_SQL} d""",
                                            "measurements"))
def q_stream_daily(spark, sf):
    """Daily means in update mode; all days equal the batch daily means."""
    m = V.measurements_from(V.events_stream(spark, sf)).withColumn("ier_score", IX.ier_score())
    out = ST.run_to_table(spark, ST.stream_daily_mean(m), _name("stream_daily"), ["station", "date"])
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
