"""Entry-point compositions (P1-P7) over the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as PR
from ..operators import scoring as S
from ..operators import series, stored
from ..tables import DEFAULT_BOUNDS, IER_FEATURES, STATION_FEATURES


def preprocess(raw: DataFrame, block_rows: int | None = None,
               order_key: str = "No", time_bucket: str = "day", keep_row: bool = False) -> DataFrame:
    """Raw station rows -> clean table (datetime, station, pm25, co, temperature, humidity).

    Humidity is computed before gaps are filled; interpolation runs per station
    in (datetime, original row number) order; then NULL rows and physical
    outliers are dropped. The original row number breaks datetime ties.
    """
    x = raw.withColumnRenamed(order_key, "_row") if order_key in raw.columns else raw
    x = C.rename_datetime(x)
    x = C.relative_humidity(x)
    x = C.interpolate_station(x, block_rows=block_rows, order_tiebreak="_row", time_bucket=time_bucket)
    x = C.drop_missing(x)
    x = C.remove_outliers(x)
    return x.select(*(["_row"] if keep_row else []), "datetime", "station", *STATION_FEATURES)


@dataclass
class Processed:
    """What a whole preprocessing run leaves: the stored table (readings and halo rows), and its bounds, statistics and summary."""
    table: DataFrame
    bounds: DataFrame
    describe: DataFrame
    summary: DataFrame

    @property
    def rows(self) -> DataFrame:
        return stored.rows(self.table)


def preprocess_whole(raw: DataFrame, path: str, table: str, buckets: int = 64, block_rows: int = series.DEFAULT_BLOCK_ROWS,
                     order_key: str = "No") -> Processed:
    """P1 whole: clean, store for windows (A4), learn and store the bounds (A9), describe (D5) and summarise (D6) what is stored.

    Everything after the write reads the stored table. Tables: ``path``/table, bounds, describe, summary.
    """
    spark = raw.sparkSession
    clean = preprocess(raw, order_key=order_key, keep_row=True)
    kept = stored.store(clean, f"{path}/table", table, buckets, block_rows, tiebreak="_row")
    rows = stored.rows(kept)
    out = {"bounds": PR.feature_bounds(rows), "describe": PR.describe_stats(rows), "summary": PR.station_summary(rows)}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return Processed(kept, **{name: spark.read.parquet(f"{path}/{name}") for name in out})


def run_batch(df: DataFrame, pathologie: str = "general", bounds: Mapping | None = None,
              zone_model=None) -> DataFrame:
    """Index with details -> zone (model, else fallback zone + label only)."""
    out = S.ier_batch(df, pathologie, bounds, add_details=True)
    if zone_model is not None:
        from ..operators.zones import zone_assign
        return zone_assign(out, zone_model)
    from ..functions import alerts as A
    return out.withColumn("zone", A.zone_from_ier("ier_score")).withColumn("zone_label", A.zone_label("zone"))


def bounds_row(bounds: DataFrame) -> DataFrame:
    """The bounds table (feature, min, max) as one row of columns ``_lo_<feature>`` and ``_hi_<feature>``."""
    return bounds.agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{n}_{f}") for f in IER_FEATURES for n, c in (("lo", "min"), ("hi", "max"))])


def run_batch_whole(df: DataFrame, path: str, pathologie: str = "general", bounds: DataFrame | None = None,
                    zone_model=None) -> tuple[DataFrame, DataFrame]:
    """P3 whole: score with the learned bounds (A9, attached as a one-row table), store (A12), summarise (D15) what is stored.

    Returns the stored rows of the pathologie and the stored summary. A feature without learned bounds has the default ones. The
    readings are read once; the summary reads the two columns that it counts from the stored rows. (``DataFrame.observe`` would spare
    that, but in Spark 4.1 a session in which something was observed can no longer fit or apply a forest: its observations
    are taken along to tasks and cannot be sent.)
    """
    spark = df.sparkSession
    x, by = df, None
    if bounds is not None:
        x = df.crossJoin(F.broadcast(bounds_row(bounds)))  # one row
        by = {f: (F.coalesce(F.col(f"_lo_{f}"), F.lit(DEFAULT_BOUNDS[f][0])), F.coalesce(F.col(f"_hi_{f}"), F.lit(DEFAULT_BOUNDS[f][1])))
              for f in IER_FEATURES}
    out = run_batch(x, pathologie, by, zone_model)
    out = out.drop(*[c for c in out.columns if c.startswith(("_lo_", "_hi_"))]).withColumn("pathologie", F.lit(pathologie))
    write_batch(out, path)
    rows = spark.read.schema(out.schema).parquet(path).where(F.col("pathologie") == pathologie)
    PR.batch_summary(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}-summary/pathologie={pathologie}")
    return rows, spark.read.parquet(f"{path.rstrip('/')}-summary/pathologie={pathologie}")


def write_batch(df: DataFrame, path: str) -> None:
    """One output per pathologie (partition column), dynamic partition overwrite."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("pathologie").parquet(path))

