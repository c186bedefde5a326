"""Spark session helpers.

On a cluster the session comes from the platform; these helpers only fill
settings that are unset (tests, local runs) and never override cluster values.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only small, checked sides; the default threshold stays as the
    # optimizer's own guard for anything we do not hint.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pneuma") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = SparkSession.getActiveSession()
    given = dict(spark.sparkContext.getConf().getAll()) if spark else {}
    for k, v in DEFAULTS.items():
        if k not in given:
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("PNEUMA_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["PNEUMA_DRIVER_MEMORY"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to shared storage. Only a local session, whose tasks share the
    driver's disk, gets a scratch folder when it is unset; any other master must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a shared folder")
        path = tempfile.mkdtemp(prefix="pneuma-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per Spark context, so that they can import it."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_pneuma_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(sc._temp_dir, "pneuma_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._pneuma_shipped = True


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df, what: str):
    """``df`` written once as a Parquet table in the shared folder and read back: later jobs do not repeat its work."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
