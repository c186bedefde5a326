"""Structured Streaming forms of the per-reading operators.

The reference scores one reading per synchronous call with the caller
passing the history; here a stream carries the readings:

* J1 ``stream_score``: the batch Column functions on ``readStream`` (stateless).
* J3 ``stream_daily_mean``: watermarked tumbling 1-day means per station (update mode).
* J4 ``stream_labels``: survey rows appended to the labeled table from
  ``foreachBatch``, one folder per epoch.

Streams that keep tables as their state (J2, H13, closed days, rejects) are in ``epochs``.

Checkpoints go under the session's ``spark.checkpoint.dir`` (shared storage
on a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import decimal_avg
from ..operators import retrain as R
from ..operators import scoring as S
from ..tables import CLUSTER_FEATURES
from .epochs import Epochs


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def stream_score(readings: DataFrame, pathologie: str = "general", bounds: Mapping | None = None,
                 zone_model=None) -> DataFrame:
    """Index, zone and alert per streamed reading (same code as the batch C11)."""
    return S.score_realtime(readings, pathologie, bounds, zone_model)


def stream_daily_mean(readings: DataFrame, lateness: str = "1 day",
                      features=CLUSTER_FEATURES) -> DataFrame:
    """Per (station, day) means; in update mode a day is given out with every batch that changes it."""
    # Watermarks need an instant type: the wall-clock TIMESTAMP_NTZ is read as UTC explicitly,
    # so day windows follow the readings' calendar days whatever the session time zone.
    d = F.col("datetime")
    et = F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d),
                          F.second(d), F.lit("UTC"))  # second precision is enough for a day window
    w = readings.withColumn("_et", et).withWatermark("_et", lateness)
    g = w.groupBy(F.window("_et", "1 day").alias("w"), "station")
    return g.agg(F.min(F.to_date("datetime")).alias("date"), *[decimal_avg(f, 6).alias(f) for f in features]) \
            .select("station", "date", *features)


def stream_labels(spark: SparkSession, entries: DataFrame, table_path: str, checkpoint: str | None = None,
                  user_col: str = "user_id"):
    """Append survey rows to the labeled table: every answer is kept, however late it comes.

    Each micro-batch is one batch folder named by its epoch, so a retried epoch replaces itself. The default
    checkpoint belongs to the table.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        R.append_labeled(batch, table_path, user_col, batch=f"epoch-{epoch_id:012d}")

    ck = checkpoint or f"{table_path.rstrip('/')}-checkpoint"
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, stream_df: DataFrame, name: str, keys: list[str] | None = None,
                 checkpoint: str | None = None) -> DataFrame:
    """Run a streaming query over everything available (availableNow) into Parquet in the shared folder; return it.

    Each epoch is written to a folder of its own, which a retry replaces. With ``keys`` the query runs in
    update mode and each key's row of the last epoch counts; nothing stays behind a watermark then. A source
    without a file gives an empty table.
    """
    epochs, schema = Epochs(spark, name, checkpoint), stream_df.schema
    base = epochs.base

    def write(batch: DataFrame, epoch_id: int) -> None:
        epochs.write("table", epoch_id, batch)

    q = (stream_df.writeStream.foreachBatch(write).outputMode("update" if keys else "append")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return epochs.all("table", schema, keys)
