"""Streams whose state is a table per epoch: J2 (and H13 after it), J3 with late rows, B12 with rejects.

Each micro-batch is a batch job over its rows and the state that the epoch before left in the
shared folder. State, results and rejects of an epoch are folders of their own: a
retried epoch writes them anew, and a restarted query goes on from its checkpoint. State is partitioned like any
table, so a station is never one task; micro-batches are bounded by the source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import crisis as CR
from ..operators import features as FT
from ..operators import scoring as S
from ..operators import series
from ..session import ensure_checkpoint_dir
from ..tables import CLUSTER_FEATURES, HISTORY_TYPE

#: Rows of one block of a series' windows inside a micro-batch.
BLOCK_ROWS = 1 << 16


class Epochs:
    """The tables of one stream, below ``base``: ``<what>/_epoch=<n>``."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        self.spark = spark
        self.base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream_{name}_{uuid.uuid4().hex}"

    def _path(self, *parts: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def write(self, what: str, epoch: int, df: DataFrame) -> DataFrame:
        """Store the epoch's table and give it back as stored."""
        path = f"{self.base}/{what}/_epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def epochs(self, what: str) -> list[int]:
        """Epochs that have a finished table, ascending."""
        fs, path = self._path(what)
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path)]
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in done if "=" in p.getName() and fs.exists(jvm_path(p, "_SUCCESS")))

    def before(self, what: str, epoch: int) -> DataFrame | None:
        """The table that the last epoch before this one left, None at the start."""
        last = [e for e in self.epochs(what) if e < epoch]
        return self.spark.read.parquet(f"{self.base}/{what}/_epoch={last[-1]}") if last else None

    def forget(self, what: str, epoch: int) -> None:
        """Remove the tables of epochs before ``epoch``, which no retry can need."""
        for e in self.epochs(what):
            if e < epoch:
                fs, path = self._path(what, f"_epoch={e}")
                fs.delete(path, True)

    def all(self, what: str, schema, keys: list[str] | None = None) -> DataFrame:
        """Rows of all epochs; with ``keys`` each key's row of the last epoch that gave it out. Empty without an epoch."""
        if not self.epochs(what):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{_ddl(schema)}, _epoch long").parquet(f"{self.base}/{what}")
        if not keys:
            return rows.drop("_epoch")
        others = [f.name for f in schema if f.name not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_epoch").alias("_r"))
        return last.select(*[F.col(f.name) if f.name in keys else F.col(f"_r.{f.name}").alias(f.name) for f in schema])

    def run(self, stream: DataFrame, step: Callable[[DataFrame, int], None], available_now: bool = True):
        """Start ``step`` over the stream's micro-batches; with ``available_now`` return when the present input is done."""
        w = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.base}/checkpoint")
        if not available_now:
            return w.start()
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


# --- J2, H13 ---------------------------------------------------------------------------------------------------

def _station(df: DataFrame):
    return series._gk(["station"])


def history_step(epochs: Epochs, then: Callable[[DataFrame], DataFrame], n: int = 24, lateness_days: int = 2,
                 block_rows: int = BLOCK_ROWS) -> Callable[[DataFrame, int], None]:
    """A micro-batch of J2: ``then`` gets every reading whose history is new or has changed, with the array ``history``.

    The batch's rows join the rows that the state holds; the series is numbered in buckets of time and cut into blocks, and each
    block hands its last ``n`` rows to the next one, so windows are bounded by the block. The state keeps, per station,
    the rows no older than the lateness before its newest, and the ``n`` rows before those. Of rows without
    a time, which come last, it keeps the last ``n``.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_fresh", F.lit(True))
        held = epochs.before("state", epoch)
        if held is not None:
            rows = rows.unionByName(held.select(*batch.columns, F.lit(False).alias("_fresh")))
        numbered = FT.add_series_rn(rows)
        rn = next(c for c in numbered.columns if c not in rows.columns)
        numbered = epochs.write("numbered", epoch, numbered)
        fields = [F.col(f.name).cast("double").alias(f.name) if f.name in batch.columns else F.lit(None).cast("double").alias(f.name)
                  for f in HISTORY_TYPE.elementType.fields]
        seen = series.collect_previous(numbered, ["station"], rn, F.struct(*fields, "_fresh"), n, block_rows, "_seen")
        changed = seen.where(F.col("_fresh") | F.exists("_seen", lambda h: h["_fresh"]))
        history = F.transform("_seen", lambda h: F.struct(*[h[f.name].alias(f.name) for f in HISTORY_TYPE.elementType.fields]))
        epochs.write("table", epoch, then(changed.withColumn("history", history).drop("_seen", "_fresh", rn)))

        key = numbered.withColumn("_gk", _station(numbered))
        newest = key.groupBy("_gk").agg(F.max("datetime").alias("_new"), F.max(rn).alias("_last"))
        first = (key.join(newest, "_gk").where(F.col("datetime") >= F.col("_new") - F.expr(f"INTERVAL {lateness_days} DAYS"))
                 .groupBy("_gk").agg(F.min(rn).alias("_first")))
        edge = newest.join(first, "_gk", "left").select("_gk", "_last", "_first")
        keep = key.join(edge, "_gk").where((F.col("datetime").isNotNull() & (F.col(rn) >= F.col("_first") - n))
                                           | (F.col("datetime").isNull() & (F.col(rn) > F.col("_last") - n)))
        epochs.write("state", epoch, keep.select(*batch.columns))
        for what in ("state", "numbered"):
            epochs.forget(what, epoch - 1)
    return step


def _history_rows(x: DataFrame) -> DataFrame:
    return FT.history_features(x).select("event_id", "station", *[name for name, _, _ in FX.HISTORY_SPECS])


def _stream_series(readings: DataFrame, then, name: str, n: int, lateness_days: int, base: str | None, block_rows: int) -> DataFrame:
    spark = readings.sparkSession
    epochs = Epochs(spark, name, base)
    epochs.run(readings, history_step(epochs, then, n, lateness_days, block_rows))
    empty = spark.createDataFrame([], readings.schema).withColumn("history", F.lit(None).cast(HISTORY_TYPE))
    return epochs.all("table", then(empty).schema, ["event_id"])


def stream_history(readings: DataFrame, name: str = "history", n: int = 24, lateness_days: int = 2, base: str | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The six history features of each reading from the previous ``n`` readings of its station.

    Rows may come in any order within ``lateness_days`` of the station's newest reading; a late row gives out again
    the up to ``n`` readings after it, and the last row given out for an ``event_id`` counts. A reading later than
    that has a history of what is still held. With the same ``base`` the stream goes on where it stopped.
    """
    x = readings.select("event_id", "station", "datetime", "pm25", "co", "humidity", "ier_score")
    return _stream_series(x, _history_rows, name, n, lateness_days, base, block_rows)


def stream_crisis(readings: DataFrame, profiles: DataFrame | None = None, model=None, name: str = "crisis", n: int = 24,
                  lateness_days: int = 2, base: str | None = None, block_rows: int = BLOCK_ROWS,
                  columns: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """J2 then H13: every reading with its history, the static profile of its user and the stored forest's probability.

    Without a model the heuristic scores. A reading whose history changes is scored again. ``columns`` picks what is stored
    of a scored reading (``event_id`` among it), so histories and feature maps that nobody asks for are neither written
    nor shuffled.
    """
    def then(x: DataFrame) -> DataFrame:
        out = CR.crisis_realtime(x if profiles is None else FT.with_profile(x, profiles), model)
        return out if columns is None else columns(out)

    return _stream_series(readings, then, name, n, lateness_days, base, block_rows)


# --- J3 --------------------------------------------------------------------------------------------------------

@dataclass
class Days:
    """What a stream of daily means has given out: closed days once each, rows that came too late, days still open."""
    closed: DataFrame
    late: DataFrame
    open: DataFrame


def _means(sums: DataFrame, features) -> DataFrame:
    return sums.select("station", "date", F.col("_n").alias("n_rows"),
                       *[(F.col(f"_s_{f}").cast("double") / F.col(f"_n_{f}").cast("double")).alias(f) for f in features])


def closed_days_step(epochs: Epochs, lateness: str, features=CLUSTER_FEATURES) -> Callable[[DataFrame, int], None]:
    """A micro-batch of J3: add its rows to the open days, give out the days that the watermark has passed, keep the rest.

    The watermark is the newest time of all batches less the lateness. A row whose day the watermark of
    the batches before had passed goes to the late rows, and so does a row without a time.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mark = epochs.before("watermark", epoch)
        passed = mark.first()["at"] if mark is not None else None  # one row
        end = F.date_add(F.to_date("datetime"), 1).cast("timestamp_ntz")
        late = F.col("datetime").isNull()
        if passed is not None:
            late = late | (end <= F.lit(passed).cast("timestamp_ntz"))
        epochs.write("late", epoch, batch.where(late).withColumn(
            "reason", F.when(F.col("datetime").isNull(), "no_time").otherwise("day_closed")))
        new = batch.where(~late).groupBy("station", F.to_date("datetime").alias("date")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f).cast("decimal(38,6)")).alias(f"_s_{f}") for f in features],
            *[F.count(f).alias(f"_n_{f}") for f in features])
        held = epochs.before("open", epoch)
        if held is not None:
            new = new.unionByName(held)
        sums = epochs.write("sums", epoch, new.groupBy("station", "date").agg(
            F.sum("_n").alias("_n"), *[F.sum(f"_s_{f}").cast("decimal(38,6)").alias(f"_s_{f}") for f in features],
            *[F.sum(f"_n_{f}").alias(f"_n_{f}") for f in features]))
        newest = batch.agg((F.max("datetime") - F.expr(f"INTERVAL {lateness}")).alias("at"))
        both = newest if passed is None else newest.union(spark.createDataFrame([(passed,)], newest.schema))
        mark = epochs.write("watermark", epoch, both.agg(F.max("at").alias("at"))).first()["at"]
        over = F.date_add("date", 1).cast("timestamp_ntz") <= F.lit(mark).cast("timestamp_ntz") if mark is not None else F.lit(False)
        epochs.write("table", epoch, _means(sums.where(over), features))
        epochs.write("open", epoch, sums.where(~over))
        for what in ("open", "sums", "watermark"):
            epochs.forget(what, epoch - 1)
    return step


def stream_closed_days(readings: DataFrame, name: str = "days", lateness: str = "1 DAY", features=CLUSTER_FEATURES,
                       base: str | None = None) -> Days:
    """J3 in append mode: (station, date, n_rows, means) of every closed day once, with the late rows and the open days.

    Rows of closed days, rows of open days and late rows together are all rows.
    """
    spark = readings.sparkSession
    epochs = Epochs(spark, name, base)
    x = readings.select("event_id", "station", "datetime", *features)
    epochs.run(x, closed_days_step(epochs, lateness, features))
    means = "station string, date date, n_rows long, " + ", ".join(f"{f} double" for f in features)
    schema = spark.createDataFrame([], means).schema
    last = epochs.epochs("open")
    still = epochs.before("open", last[-1] + 1) if last else None
    return Days(epochs.all("table", schema),
                epochs.all("late", spark.createDataFrame([], x.schema).withColumn("reason", F.lit("")).schema),
                spark.createDataFrame([], schema) if still is None else _means(still, features))


# --- B12 -------------------------------------------------------------------------------------------------------

def rejects_step(epochs: Epochs, score: Callable[[DataFrame], DataFrame], required) -> Callable[[DataFrame, int], None]:
    """A micro-batch of raw messages: valid readings are scored, the others go to the rejects with reason and message."""
    def step(batch: DataFrame, epoch: int) -> None:
        checked = epochs.write("checked", epoch, S.validate_messages(batch, required))
        epochs.write("table", epoch, score(checked.where("is_valid").drop("is_valid", "reject_reason", "raw")))
        epochs.write("rejects", epoch, checked.where("not is_valid").select("event_id", "reject_reason", "raw"))
        epochs.forget("checked", epoch)
    return step


def stream_validated(messages: DataFrame, score: Callable[[DataFrame], DataFrame] = S.score_realtime, name: str = "validated",
                     required=S.IER_FEATURES, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B12 on a stream of JSON messages (``value``): the scored readings and the rejects (event_id, reject_reason, raw).

    Each message is in exactly one of the two tables, also after a retry.
    """
    spark = messages.sparkSession
    epochs = Epochs(spark, name, base)
    epochs.run(messages, rejects_step(epochs, score, required))
    checked = S.validate_messages(spark.createDataFrame([], messages.schema), required)
    scored = score(checked.where("is_valid").drop("is_valid", "reject_reason", "raw"))
    return epochs.all("table", scored.schema), epochs.all("rejects", checked.select("event_id", "reject_reason", "raw").schema)
