"""The labeled table with snapshots (A8, A13, D8, J4): folders of rows, a manifest that names them, counts per user.

Every append is a folder of rows split by a hash bucket of the user, with a small table of its rows per user beside
it. The manifest lists the folders of the current snapshot and is published as one version, so a reader never sees half
an append or half a compaction. Folders that a snapshot no longer names stay until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite_columns
from ..sources.versions import Versions
from ..tables import LABELED_SCHEMA
from .retrain import labeled_projection, user_bucket


#: Rows that a task of a compaction sorts and writes.
TASK_ROWS = 1 << 18


def _tasks(rows: DataFrame, n: int, user_col: str, task_rows: int) -> DataFrame:
    """``rows`` (``n`` of them) in tasks of about ``task_rows``: by the user's bucket and, where one task is not enough, by a
    salt of the row, so neither many rows nor one user's many rows are one task; eight tasks share a salt."""
    tasks = max(1, -(-n // task_rows))
    salts = -(-tasks // 8)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    return rows.repartition(tasks, user_bucket(F.col(user_col)), *([salt] if salts > 1 else []))


class LabeledTable:
    def __init__(self, spark: SparkSession, path: str, user_col: str = "user_id"):
        self.spark, self.path, self.user_col = spark, path.rstrip("/"), user_col
        self.manifest = Versions(spark, f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A folder of rows and its counts; its name and the number of rows."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", user_bucket(F.col(self.user_col))).write.partitionBy("_bucket").parquet(f"{self.path}/rows/_folder={name}")
        stored = self.spark.read.parquet(f"{self.path}/rows/_folder={name}")
        counts = stored.groupBy(self.user_col).agg(F.count(F.lit(1)).alias("n_samples"))
        counts.write.parquet(f"{self.path}/counts/{name}")
        n = self.spark.read.parquet(f"{self.path}/counts/{name}").agg(F.sum("n_samples")).first()[0] or 0
        return name, int(n)

    def append(self, df: DataFrame, batch: str | None = None) -> int:
        """Add rows; the snapshot's number. A batch named as one before replaces it, so a retried epoch adds nothing twice.

        A batch that a compaction has taken in stays as it is.
        """
        batch = batch or uuid.uuid4().hex
        rows = labeled_projection(df, user_col=self.user_col)
        if rows.isEmpty():
            return self.manifest.publish(lambda old: [f for f in old or [] if f["batches"] != [batch]])
        name, n = self._write(rows)

        def change(old):
            old = old or []
            if any(batch in f["batches"] and len(f["batches"]) > 1 for f in old):
                return old
            return [f for f in old if f["batches"] != [batch]] + [{"folder": name, "rows": n, "batches": [batch], "schema": rows.schema.json()}]
        return self.manifest.publish(change)

    def compact(self, target_rows: int = 1 << 22, keep_last: int = 1, task_rows: int = TASK_ROWS) -> int | None:
        """Join the small folders, but for the last ones that a stream may still retry, into one of at least fewer files.

        Folders of ``target_rows`` or more stay. A task writes about ``task_rows`` rows. Returns the new snapshot's number, None if there is nothing to join.
        """
        now = self.manifest.read() or []
        small = [f for f in now[:len(now) - keep_last] if f["rows"] < target_rows]
        if len(small) < 2:
            return None
        rows = self._read(small)
        name, n = self._write(_tasks(rows, sum(f["rows"] for f in small), self.user_col, task_rows))
        gone = {f["folder"] for f in small}
        batches = sorted({b for f in small for b in f["batches"]})

        def change(old):
            if not gone <= {f["folder"] for f in old or []}:
                raise RuntimeError("the folders to compact have changed; compact again")
            new = {"folder": name, "rows": n, "batches": batches, "schema": rows.schema.json()}
            return [new] + [f for f in old if f["folder"] not in gone]
        return self.manifest.publish(change)

    def _read(self, folders: list[dict]) -> DataFrame:
        import json

        from pyspark.sql.types import StructType
        if not folders:
            return self.spark.createDataFrame([], LABELED_SCHEMA)
        schema = StructType.fromJson(json.loads(folders[-1]["schema"]))
        # one read of all folders; user bucket and folder are partitions, so a filter on them reads no other files
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/rows")
                .parquet(*[f"{self.path}/rows/_folder={f['folder']}" for f in folders]).drop("_folder"))

    def load(self, user_id=None, version: int | None = None) -> DataFrame:
        """Rows of a snapshot (the current one by default), of one user or all; NaN and infinities are NULL."""
        folders = self.manifest.read(version) or []
        rows = self._read(folders)
        if user_id is not None and "_bucket" in rows.columns:
            rows = rows.where((F.col("_bucket") == user_bucket(F.lit(user_id))) & (F.col(self.user_col) == F.lit(user_id)))
        return finite_columns(rows.drop("_bucket"))

    def user_sample_count(self, version: int | None = None) -> DataFrame:
        """D8 of a snapshot from the counts of its folders; the rows are not read."""
        folders = self.manifest.read(version) or []
        if not folders:
            kind = LABELED_SCHEMA[self.user_col].dataType.simpleString() if self.user_col in LABELED_SCHEMA.names else "string"
            return self.spark.createDataFrame([], f"{self.user_col} {kind}, n_samples long")
        counts = self.spark.read.parquet(*[f"{self.path}/counts/{f['folder']}" for f in folders])
        return counts.groupBy(self.user_col).agg(F.sum("n_samples").alias("n_samples"))

    def vacuum(self) -> int:
        """Remove folders that the current snapshot does not name, once no reader uses an older one; how many."""
        sc = self.spark.sparkContext
        named = {f["folder"] for f in self.manifest.read() or []}
        gone = 0
        for what in ("rows", "counts"):
            top = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
            fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
            for s in (fs.listStatus(top) if fs.exists(top) else []):
                if s.getPath().getName().removeprefix("_folder=") not in named:
                    fs.delete(s.getPath(), True)
                    gone += what == "rows"
        return gone
