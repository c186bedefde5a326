"""Registered queries: whole runs over stored tables (P1 with A4, A9, D5; P3 with A9, A12, D15; A8, A13, D8 with snapshots)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import features as FX
from ..functions import index as IX
from ..operators import stored
from ..operators.labeled import LabeledTable
from ..session import scratch_path
from ..sources import views as V
from ..tables import STATION_FEATURES, STATION_LIMITS
from . import pipelines as P
from . import sqlfrag as Q
from .catalog import register
from .q_clean import interp_sql, limits_sql, rh_sql
from .q_features import roll_sql
from .q_labels import APPEND_SQL
from .q_models import _learned_sql
from .q_profile import _describe_sql

#: Rows of a block in these queries: small, so that series cross block borders at test scale.
BLOCK_ROWS, BUCKETS = 256, 16

PROCESSED = f"""(SELECT event_id, datetime, station, pm25, co, temperature, humidity
FROM {interp_sql(f'''(SELECT "No" AS event_id, station, make_timestamp(year, month, day, hour, 0, 0.0) AS datetime,
                            "PM2.5" AS pm25, "CO" AS co, "TEMP" AS temperature,
                            {rh_sql('"TEMP"', '"DEWP"')} AS humidity FROM stations_raw)''',
                 ["event_id", "datetime", "station"], STATION_FEATURES, "station", "datetime NULLS LAST, event_id", 24)} t
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in STATION_FEATURES)} AND {limits_sql(STATION_LIMITS)})"""


def _processed(spark, sf) -> P.Processed:
    return P.preprocess_whole(V.stations_raw(spark, sf), scratch_path(spark, "processed"), f"processed_{uuid.uuid4().hex}", BUCKETS, BLOCK_ROWS)


@register("preprocess_rolling", V.with_views(f"""
SELECT event_id, station, datetime, {roll_sql('datetime NULLS LAST, event_id')}
FROM (SELECT *, {Q.score()} AS ier_score FROM {PROCESSED} p) t""", "stations_raw"))
def q_preprocess_rolling(spark, sf):
    """P1 whole, then E1 over the table stored for windows: no exchange after the scan."""
    table = _processed(spark, sf).table.withColumn("ier_score", IX.ier_score())
    return stored.rolling_24(table).select(F.col("_row").alias("event_id"), "station", "datetime", *[n for n, _, _ in FX.HISTORY_SPECS])


@register("preprocess_stats", V.with_views(f"""
WITH p AS {PROCESSED},
b AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi FROM p" for c in STATION_FEATURES)})
SELECT d.*, b.lo, b.hi FROM ({_describe_sql('p', STATION_FEATURES)}) d JOIN b USING (feature)""", "stations_raw"))
def q_preprocess_stats(spark, sf):
    """P1 whole: statistics (D5) and bounds (A9) of the processed table, as stored."""
    p = _processed(spark, sf)
    return p.describe.join(p.bounds.select("feature", F.col("min").alias("lo"), F.col("max").alias("hi")), "feature")


def _batch(spark, sf):
    from ..operators import profile as PR
    path = scratch_path(spark, "batch")
    m = V.measurements(spark, sf)
    PR.save_bounds(PR.feature_bounds(m), f"{path}/bounds")
    return P.run_batch_whole(m, f"{path}/table", "asthme", spark.read.parquet(f"{path}/bounds"))


@register("batch_run", V.with_views(f"SELECT event_id, ier_score, zone, 'asthme' AS pathologie FROM ({_learned_sql()}) t", "measurements"))
def q_batch_run(spark, sf):
    """P3 whole: the stored rows, scored with learned bounds that a one-row table carries."""
    return _batch(spark, sf)[0].select("event_id", "ier_score", "zone", "pathologie")


@register("batch_run_summary", V.with_views(f"""
WITH s AS (SELECT ier_score, zone FROM ({_learned_sql()}) x),
l AS (SELECT {Q.level('ier_score')} AS ier_level, zone FROM s)
SELECT dimension, value, count(*) AS count, (SELECT count(*) FROM l) AS total_rows
FROM (SELECT 'ier_level' AS dimension, ier_level AS value FROM l UNION ALL SELECT 'zone', zone FROM l) t GROUP BY dimension, value""",
                                            "measurements"))
def q_batch_run_summary(spark, sf):
    """P3 whole: the summary (D15) of what was stored."""
    return _batch(spark, sf)[1]


def _labeled(spark, sf) -> LabeledTable:
    """Survey rows in five appends, one tried twice, then compacted, then two more appends."""
    le = V.labeled_entries(spark, sf)
    t = LabeledTable(spark, scratch_path(spark, "labeled"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(7))
    for i in range(7):
        for _ in range(2 if i == 3 else 1):
            t.append(le.where(part == i), batch=f"part-{i}")
        if i == 4:
            t.compact()
    return t


@register("labeled_snapshot", APPEND_SQL)
def q_labeled_snapshot(spark, sf):
    """The rows of the current snapshot after appends, a retry and a compaction."""
    return _labeled(spark, sf).load()


@register("labeled_snapshot_counts", V.with_views("SELECT user_id, count(*) AS n_samples FROM labeled_entries GROUP BY user_id", "labeled_entries"))
def q_labeled_snapshot_counts(spark, sf):
    """D8 from the counts that the appends left; no row is read."""
    return _labeled(spark, sf).user_sample_count().withColumn("n_samples", F.col("n_samples").cast("long"))
