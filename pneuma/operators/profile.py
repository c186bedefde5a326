"""Data profiles and summaries.

Each profile is one aggregation pass with partial (map-side) aggregation;
results are a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import decimal_avg, finite_or_null, rround
from ..tables import EXPECTED_STATIONS, STATION_FEATURES


def station_load_profile(df: DataFrame, cols=("PM2.5", "CO", "TEMP", "DEWP")) -> DataFrame:
    """A2 per station: rows and NULL counts of the raw measurement columns."""
    present = [c for c in cols if c in df.columns]
    return df.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c.replace('.', '').lower()}_nan") for c in present])


def station_load_overall(df: DataFrame, expected=EXPECTED_STATIONS) -> DataFrame:
    """A2 overall: rows, distinct stations, sorted list, period, expected stations missing / extra."""
    ts = "datetime" if "datetime" in df.columns else None
    if ts is None and all(c in df.columns for c in ("year", "month", "day", "hour")):
        df = df.withColumn("datetime", F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0)))
    exp = F.array(*[F.lit(s) for s in expected])
    st = F.sort_array(F.collect_set("station"))  # distinct station names: bounded by the station count
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station").alias("n_stations"),
                 st.alias("_st"), F.min("datetime").alias("period_start"), F.max("datetime").alias("period_end"))
    return out.select("n_rows", "n_stations", F.array_join("_st", ",").alias("stations"), "period_start",
                      "period_end",
                      F.size(F.array_except(exp, F.col("_st"))).alias("n_expected_missing"),
                      F.size(F.array_except(F.col("_st"), exp)).alias("n_unexpected"))


def raw_preview(df: DataFrame, order_by=("No",), n: int = 5) -> DataFrame:
    """A3: the first ``n`` rows in ``order_by`` order (a top-n; only n rows reach the driver)."""
    return df.orderBy(*order_by).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """D3: rows per value of ``col`` (NULLs excluded, as in pandas value_counts)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def null_profile(df: DataFrame, cols=STATION_FEATURES) -> DataFrame:
    """NULL count and percentage (2 digits) per column, one row per column."""
    present = [c for c in cols if c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    stack = ", ".join(f"'{c}', `{c}`" for c in present)
    long = agg.selectExpr("_n", f"stack({len(present)}, {stack}) AS (feature, n_null)")
    return long.select("feature", "n_null",
                       F.when(F.col("_n") > 0, rround(F.col("n_null") / F.col("_n") * 100.0, 2)).alias("pct_null"))


def describe_stats(df: DataFrame, cols=STATION_FEATURES, digits: int = 3) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 % (linear interpolation), max per column.

    Moments come from one aggregation pass, the quartiles from the distributed
    rank method over (column, distinct value); NaN and infinities count as missing.
    """
    from .metrics import percentiles
    present = [c for c in cols if c in df.columns]
    aggs = []
    for c in present:
        v = finite_or_null(c)
        aggs += [F.count(v).alias(f"{c}__count"), decimal_avg(c, 6).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    a = df.agg(*aggs)
    df = df.select(*[finite_or_null(c).alias(c) for c in present])
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in present)
    long = df.selectExpr(f"stack({len(present)}, {stack}) AS (feature, v)")
    q = percentiles(long, "v", [0.25, 0.5, 0.75], group="feature")  # one row per column
    one = ", ".join(f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, CAST(`{c}__min` AS DOUBLE), CAST(`{c}__max` AS DOUBLE)"
                    for c in present)
    wide = a.selectExpr(f"stack({len(present)}, {one}) AS (feature, count, mean, std, min, max)")
    rows = wide.select("feature", "count", *[rround(x, digits).alias(x) for x in ("mean", "std", "min", "max")])
    out = rows.join(F.broadcast(q), "feature", "left")
    return out.select("feature", "count", "mean", "std", "min", rround("p0", digits).alias("p25"),
                      rround("p1", digits).alias("p50"), rround("p2", digits).alias("p75"), "max")


def station_summary(df: DataFrame) -> DataFrame:
    """Rows per station plus the overall total, distinct stations and period on every row."""
    per = df.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"))
    tot = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("station").alias("n_stations"),
                 F.min("datetime").alias("period_start"), F.max("datetime").alias("period_end"))
    return per.crossJoin(F.broadcast(tot))  # one-row table


def feature_summary(df: DataFrame, col: str = "humidity") -> DataFrame:
    """Min / mean / max of one feature with the datetime range."""
    return df.agg(rround(F.min(col), 3).alias(f"{col}_min"), rround(decimal_avg(col, 6), 3).alias(f"{col}_mean"),
                  rround(F.max(col), 3).alias(f"{col}_max"),
                  F.min("datetime").alias("datetime_min"), F.max("datetime").alias("datetime_max"))


def feature_bounds(df: DataFrame, cols=STATION_FEATURES) -> DataFrame:
    """(feature, min, max) of each feature: one aggregate, unpivoted to one row per feature."""
    present = [c for c in cols if c in df.columns]
    a = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
                 for c in present])
    stack = ", ".join(f"'{c}', `{c}`" for c in present)
    return a.selectExpr(f"stack({len(present)}, {stack}) AS (feature, b)").select("feature", "b.min", "b.max")


def bounds_dict(bounds_df: DataFrame) -> dict:
    """Bounds table (a few rows) -> {feature: (min, max)} for the index expressions."""
    return {r.feature: (float(r.min), float(r.max)) for r in bounds_df.collect()}


def save_bounds(bounds_df: DataFrame, path: str) -> None:
    bounds_df.write.mode("overwrite").parquet(path)


def load_bounds(spark, path: str | None) -> dict:
    """A9 load with fallback: a missing path gives the default bounds."""
    from ..functions.index import resolve_bounds
    if path:
        try:
            return resolve_bounds(bounds_dict(spark.read.parquet(path)))
        except Exception as e:  # only "path does not exist" falls back
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    return resolve_bounds(None)


def batch_summary(df: DataFrame, dims=("ier_level", "zone")) -> DataFrame:
    """Total rows and the distribution of each dimension of a scored batch (long form)."""
    present = [d for d in dims if d in df.columns]
    stack = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in present)
    long = df.selectExpr(f"stack({len(present)}, {stack}) AS (dimension, value)")
    dist = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return dist.crossJoin(F.broadcast(tot))
