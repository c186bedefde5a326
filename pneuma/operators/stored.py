"""The processed table stored for windows: bucketed and sorted by (station, block), each block with the rows before it.

Numbering and cutting into blocks is paid once, at the write. Windows over the stored table are partitioned as
its buckets are, so they read them without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as FX
from ..tables import HISTORY_TYPE, ROLLING_ROWS
from . import features as FT
from . import series

KEYS = ["station", "_blk"]
#: Rows before a block that it holds as well: the longest look back of the windows below.
HALO = 24


def store(df: DataFrame, path: str, table: str, buckets: int = 64, block_rows: int = series.DEFAULT_BLOCK_ROWS,
          tiebreak: str = "event_id") -> DataFrame:
    """Write ``df`` (station, datetime, tiebreak and readings) as the bucketed table and return it with its halo rows."""
    spark = df.sparkSession
    x = FT.add_series_rn(df, "station", tiebreak)
    rn = next(c for c in x.columns if c not in df.columns)
    x = series._blocks_with_halo(x, rn, block_rows, HALO).withColumnRenamed(rn, "_rn")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (x.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS, "_rn").format("parquet").mode("overwrite")
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def open_table(spark: SparkSession, path: str, table: str, buckets: int = 64) -> DataFrame:
    """The stored table in a session that does not know it yet."""
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        keys = ", ".join(KEYS)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, _rn) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(table)


def rows(table: DataFrame) -> DataFrame:
    """The readings themselves, each once."""
    return table.where("_is_halo = 0").drop("_is_halo", "_blk", "_rn")


def rolling_24(table: DataFrame, window: int = ROLLING_ROWS) -> DataFrame:
    """E1 over the stored table."""
    w = Window.partitionBy(*KEYS).orderBy("_rn").rowsBetween(-(window - 1), 0)
    specs = [s for s in FT.ROLL_SPECS if s[2] in table.columns]
    out = table.select("*", *[e.alias(n) for n, e in series.window_exprs(specs, w, 3)])
    return rows(out).withColumns({n: F.lit(0.0) for n, _, src in FT.ROLL_SPECS if src not in table.columns})


def with_history(table: DataFrame, n: int = HALO, name: str = "history") -> DataFrame:
    """E2's input over the stored table: the previous ``n`` readings."""
    fields = [F.col(f.name).cast("double").alias(f.name) if f.name in table.columns else F.lit(None).cast("double").alias(f.name)
              for f in HISTORY_TYPE.elementType.fields]
    w = Window.partitionBy(*KEYS).orderBy("_rn").rowsBetween(-n, -1)
    return rows(table.withColumn(name, F.collect_list(F.struct(*fields)).over(w)))


def history_features(table: DataFrame) -> DataFrame:
    return with_history(table).withColumns(dict(FX.history_features("history")))


def symptom_lag(table: DataFrame, label: str = "symptom_label", name: str = "symptom_yesterday") -> DataFrame:
    """E5 over the stored table: the label of the reading before, 0 at the start."""
    w = Window.partitionBy(*KEYS).orderBy("_rn")
    return rows(table.withColumn(name, F.when(F.col("_rn") > 1, F.lag(label, 1).over(w)).otherwise(0).cast("int")))
