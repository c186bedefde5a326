"""Cleaning operators for station readings and health-survey data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, rround
from ..tables import (
    HEALTH_FEATURES, HEALTH_INTERP_LIMIT, HEALTH_KEEP, HEALTH_LIMITS, HEALTH_RENAME, MAGNUS_A, MAGNUS_B,
    STATION_DROP, STATION_FEATURES, STATION_INTERP_LIMIT, STATION_LIMITS, STATION_RENAME,
)
from . import series


def rename_datetime(df: DataFrame) -> DataFrame:
    """B1: canonical names; datetime from year/month/day/hour when all exist; drop unused columns."""
    out = df.withColumnsRenamed({k: v for k, v in STATION_RENAME.items() if k in df.columns})
    if all(c in out.columns for c in ("year", "month", "day", "hour")):
        out = out.withColumn("datetime", F.make_timestamp_ntz(
            F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0)))
    return out.drop(*[c for c in STATION_DROP if c in out.columns])


def relative_humidity(df: DataFrame) -> DataFrame:
    """B2: Magnus relative humidity from temperature and dew point, clipped 0-100, 2 digits."""
    if "dewpoint" not in df.columns:
        raise KeyError("column 'dewpoint' is missing")
    t, td = F.col("temperature"), F.col("dewpoint")
    a, b = F.lit(MAGNUS_A), F.lit(MAGNUS_B)
    rh = F.lit(100.0) * (F.exp(a * td / (b + td)) / F.exp(a * t / (b + t)))
    return df.withColumn("humidity", rround(clip(rh, 0.0, 100.0), 2)).drop("dewpoint")


def limits_predicate(limits=STATION_LIMITS, present=None):
    cond = F.lit(True)
    for c, lo, hi in limits:
        if present is None or c in present:
            cond = cond & F.col(c).between(lo, hi)
    return cond


def remove_outliers(df: DataFrame, limits=STATION_LIMITS) -> DataFrame:
    """Keep rows with every present feature inside its inclusive limits (NULL fails)."""
    return df.filter(F.coalesce(limits_predicate(limits, df.columns), F.lit(False)))


def outlier_counts(df: DataFrame, limits=STATION_LIMITS) -> DataFrame:
    """Rows removed per feature, cascading in limit order, plus total and percentage.

    One pass: each row is charged to the first limit it fails.
    """
    present = [(c, lo, hi) for c, lo, hi in limits if c in df.columns]
    first_fail = None
    for c, lo, hi in present:
        fails = ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))
        first_fail = F.when(fails, F.lit(c)) if first_fail is None else first_fail.when(fails, F.lit(c))
    x = df.select(first_fail.alias("_fail"))
    aggs = [F.count_if(F.col("_fail") == c).alias(f"removed_{c}") for c, _, _ in present]
    out = x.agg(F.count(F.lit(1)).alias("rows_before"), *aggs, F.count("_fail").alias("removed_total"))
    pct = F.when(F.col("rows_before") > 0,
                 rround(F.col("removed_total") / F.col("rows_before") * 100.0, 2))
    return out.withColumns({"removed_pct": pct,
                            "rows_after": F.col("rows_before") - F.col("removed_total")})


def drop_missing(df: DataFrame, cols=STATION_FEATURES) -> DataFrame:
    """Drop rows with a NULL in any of the present ``cols``."""
    return df.na.drop(subset=[c for c in cols if c in df.columns])


def interpolate_station(df: DataFrame, limit: int = STATION_INTERP_LIMIT,
                        block_rows: int | None = None, order_tiebreak: str = "event_id",
                        cols=STATION_FEATURES, time_bucket: str = "day") -> DataFrame:
    """Per-station linear interpolation by row position, limit 24, order (datetime, tiebreak).

    ``time_bucket`` is the numbering bucket (see ``features.add_series_rn``). By default the
    buckets are also the interpolation blocks (one shuffle); ``block_rows`` switches to
    fixed-size row blocks (a second shuffle, bounded blocks whatever the bucket sizes).
    """
    tb = order_tiebreak if order_tiebreak in df.columns else None
    order = ["datetime"] + ([tb] if tb else [])
    present = [c for c in cols if c in df.columns]
    bucket, level = series.time_bucket("datetime", time_bucket), series.time_level("datetime")
    if block_rows is None:
        # the numbering buckets are the blocks: their windows share one partitioning
        return series.interpolate_bucketed(df, ["station"], order, bucket, present, limit, level)
    x = series.add_row_number(df, ["station"], order, bucket, "_rn", level)
    out = series.interpolate_limited(x, ["station"], "_rn", present, limit, block_rows)
    return out.drop("_rn")


# ---------------------------------------------------------------------------
# Health-survey data
# ---------------------------------------------------------------------------

def health_project(df: DataFrame, keep_extra=()) -> DataFrame:
    """Keep the known columns that exist and rename to canonical names (+ ``keep_extra``)."""
    keep = [c for c in HEALTH_KEEP if c in df.columns]
    return df.select(*keep_extra, *[F.col(f"`{c}`").alias(HEALTH_RENAME.get(c, c)) for c in keep])


def health_calendar(df: DataFrame) -> DataFrame:
    """Parse date (bad -> NULL); month (NULL -> 6); day_of_week Monday=0 (NULL -> 0); drop date."""
    if "date" not in df.columns:
        return df
    d = F.try_to_timestamp(F.col("date"))
    return (df.withColumns({"month": F.coalesce(F.month(d), F.lit(6)).cast("int"),
                            "day_of_week": F.coalesce(F.weekday(d), F.lit(0)).cast("int")})
              .drop("date"))


def health_label(df: DataFrame, percentile: float = 75.0, source: str = "respiratory_admissions",
                 label: str = "symptom_label") -> DataFrame:
    """label = 1 when source >= its percentile (linear interpolation); NULL -> 0.

    The threshold is an exact percentile (a single row), attached
    to every row by a broadcast cross join of that one row.
    """
    from .metrics import percentiles
    if source not in df.columns:
        return df
    thr = percentiles(df, source, [percentile / 100.0]).select(F.col("p0").alias("_thr"))
    out = df.crossJoin(F.broadcast(thr))
    return (out.withColumn(label, F.coalesce(F.col(source) >= F.col("_thr"), F.lit(False)).cast("int"))
               .drop("_thr", source))


def health_outliers(df: DataFrame) -> DataFrame:
    """Inclusive limits on pm25, co, temperature, humidity, aqi."""
    return remove_outliers(df, HEALTH_LIMITS)


def interpolate_global(df: DataFrame, order_col: str = "event_id", limit: int = HEALTH_INTERP_LIMIT,
                       cols=HEALTH_FEATURES, bucket_width: int = 1 << 20,
                       block_rows: int | None = None) -> DataFrame:
    """Interpolation over the whole table in ``order_col`` order (one series).

    The row order is a global one, yet no window sees the whole table: rows are
    numbered through per-bucket counts and interpolated over bounded blocks.
    """
    # integer columns (calendar parts) are never NULL after B7; only doubles need filling
    dtypes = dict(df.dtypes)
    present = [c for c in cols if c in df.columns and dtypes[c] in ("double", "float")]
    bucket = F.floor(F.col(order_col) / F.lit(bucket_width))
    level = F.floor(F.col(order_col) / F.lit(bucket_width * 1024))
    if block_rows is None:
        return series.interpolate_bucketed(df, [], [order_col], bucket, present, limit, level)
    x = series.add_row_number(df, [], [order_col], bucket, "_rn", level)
    out = series.interpolate_limited(x, [], "_rn", present, limit, block_rows)
    return out.drop("_rn")


def health_pipeline(df: DataFrame, percentile: float = 75.0, order_col: str = "event_id",
                    block_rows: int | None = None, bucket_width: int = 1 << 20) -> DataFrame:
    """Project -> calendar -> label (threshold before any drop) -> interpolate -> drop -> limits."""
    x = health_project(df, keep_extra=[order_col] if order_col in df.columns else [])
    x = health_calendar(x)
    x = health_label(x, percentile)
    x = interpolate_global(x, order_col, HEALTH_INTERP_LIMIT, bucket_width=bucket_width, block_rows=block_rows)
    feats = [c for c in HEALTH_FEATURES if c in x.columns]
    x = x.na.drop(subset=feats + ["symptom_label"])
    return health_outliers(x)
