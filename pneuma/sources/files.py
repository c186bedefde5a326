"""File sources and sinks.

CSV inputs are read as strings and cast with ``try_cast`` so that the many
missing-value spellings of the source files become NULL instead of failing
the job; Parquet is the storage format for everything the package writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite_columns
from ..tables import HEALTH_REQUIRED, STATION_KEEP, require_columns

# FIXED VALUES: tokens read as missing in the CSV sources.
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "-NaN", "-nan", "#N/A"]

STATION_TYPES = {"No": "bigint", "year": "int", "month": "int", "day": "int", "hour": "int",
                 "PM2.5": "double", "CO": "double", "TEMP": "double", "DEWP": "double", "station": "string"}


def _clean_cast(c: str, typ: str):
    v = F.trim(F.col(f"`{c}`"))
    v = F.when(v.isin(*NULL_TOKENS), F.lit(None)).otherwise(v)
    return v.alias(c) if typ == "string" else v.try_cast(typ).alias(c)


def _list_files(spark: SparkSession, pattern: str) -> list[str]:
    """File paths matching a glob, through the Hadoop file system of the session (any storage)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    st = fs.globStatus(path)
    return sorted(str(s.getPath().toString()) for s in (st or []))


def _fields(line: Column) -> Column:
    """Fields of a CSV line; a quoted field may hold commas and doubled quotes."""
    quoted = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'),
                         lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), '""', '"'))
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x)))


def scan_station_csv(spark: SparkSession, raw_dir: str, pattern: str = "PRSA_Data_*.csv") -> tuple[DataFrame, DataFrame]:
    """A1 over any number of files: the readings (10 columns and ``_file``) and the malformed lines (file, line, reason).

    The header of every file is found by a Spark job over the lines: it is the line with at least three of the known column names.
    Files meet their header in a join, and a field is looked up by its name's place in the header, so files may differ in their
    columns and their order. A line with fewer or more fields than its header, or whose number cannot be read, is malformed
    and kept as it stands; a file without a header gives its lines as malformed.
    """
    lines = spark.read.text(f"{raw_dir.rstrip('/')}/{pattern}").select(
        _fields(F.regexp_replace("value", "^\ufeff", "")).alias("_f"), F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name")).where("line != ''")
    known = F.size(F.array_intersect("_f", F.array(*[F.lit(c) for c in STATION_KEEP]))) >= 3
    headers = lines.where(known).groupBy("file").agg(F.min("_f").alias("_h"))
    rows = lines.join(headers, "file", "left").where("_h is null or _f != _h")
    typed, bad = [], F.lit(False)
    for c in STATION_KEEP:
        v = F.get("_f", F.array_position("_h", F.lit(c)).cast("int") - 1)
        v = F.when(v.isin(*NULL_TOKENS), F.lit(None)).otherwise(v)
        if c == "station":
            typed.append(F.coalesce(v, F.regexp_extract("file_name", r"PRSA_Data_([^_]+)_", 1)).alias(c))
        else:
            t = v.try_cast(STATION_TYPES[c])
            bad = bad | (v.isNotNull() & t.isNull())
            typed.append(t.alias(c))
    reason = F.when(F.col("_h").isNull(), "no_header").when(F.size("_f") != F.size("_h"), "fields").when(bad, "not_numeric")
    rows = rows.withColumn("_reason", reason)
    return (rows.where("_reason is null").select(*typed, F.col("file").alias("_file")),
            rows.where("_reason is not null").select("file", "line", F.col("_reason").alias("reason")))


def load_stations(spark: SparkSession, raw_dir: str, pattern: str = "PRSA_Data_*.csv") -> DataFrame:
    """A1: all station CSVs, 10 columns, station taken from the file name when the column is absent.

    Malformed lines are left out here; ``scan_station_csv`` reports them.
    """
    if not _list_files(spark, f"{raw_dir.rstrip('/')}/{pattern}"):
        raise FileNotFoundError(f"no station file matching {pattern} in {raw_dir}")
    return scan_station_csv(spark, raw_dir, pattern)[0].drop("_file")


def save_processed(df: DataFrame, path: str, partition_by: str | None = "station") -> str:
    """A4: write the cleaned table (Parquet, partitioned by station)."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """A4: read the cleaned table, NaN and infinities as NULL; a clear error when it does not exist."""
    if not _list_files(spark, path):
        raise FileNotFoundError(f"processed table not found: {path}")
    return finite_columns(spark.read.parquet(path))


def load_health_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5: health-survey CSV with the required-column check."""
    if not _list_files(spark, path):
        raise FileNotFoundError(f"health file not found: {path}")
    df = spark.read.option("header", True).csv(path)
    require_columns(df, HEALTH_REQUIRED, "health csv")
    typed = [_clean_cast(c, "string" if c == "date" else "double") for c in df.columns]
    return finite_columns(df.select(*typed))


def discover_health_csv(spark: SparkSession, raw_dir: str) -> list[str]:
    """CSV files whose name contains 'air' and 'quality' (case-insensitive), sorted."""
    files = _list_files(spark, f"{raw_dir.rstrip('/')}/*")
    out = []
    for f in files:
        name = f.rsplit("/", 1)[-1].lower()
        if name.endswith(".csv") and "air" in name and "quality" in name:
            out.append(f)
    return out


def save_labeled_global(df: DataFrame, path: str) -> str:
    """The cleaned health table as the global labeled source."""
    df.write.mode("overwrite").parquet(path)
    return path
