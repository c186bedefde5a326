"""Model registry (A11, I1, K3): versioned meta and nodes of all models, read by the retraining decision and by routing.

A publication is a folder with the new models' meta rows and node rows; the registry's version names, in order, the publications
that count. A model's newest publication is the one that holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from . import crisis as CR
from .forest_table import NODES, NodeForest


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def publish(self, meta: DataFrame, nodes: DataFrame) -> int:
        """Add models (meta rows as ``crisis.meta_df`` makes them, their nodes); the new version's number."""
        name = uuid.uuid4().hex
        meta.write.parquet(f"{self.path}/meta/{name}")
        nodes.write.parquet(f"{self.path}/nodes/{name}")
        return self.versions.publish(lambda old: [*(old or []), name])

    def _rows(self, what: str, schema: str, version: int | None) -> DataFrame:
        names = self.versions.read(version) or []
        if not names:
            return self.spark.createDataFrame([], f"{schema}, _seq int")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/{n}" for n in names])
        name = F.regexp_extract("_metadata.file_path", f"/{what}/([0-9a-f]+)/", 1)
        return rows.withColumn("_seq", F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int"))

    def _newest(self, version: int | None) -> DataFrame:
        """model_name and the publication that holds."""
        return self._rows("meta", CR.META_SCHEMA, version).groupBy("model_name").agg(F.max("_seq").alias("_seq"))

    def meta(self, version: int | None = None) -> DataFrame:
        """One row per model: its newest meta."""
        return self._rows("meta", CR.META_SCHEMA, version).join(self._newest(version), ["model_name", "_seq"], "left_semi").drop("_seq")

    def nodes(self, version: int | None = None) -> DataFrame:
        """Nodes of every model's newest publication."""
        return self._rows("nodes", NODES, version).join(self._newest(version), ["model_name", "_seq"], "left_semi").drop("_seq")

    def users(self, user_type: str = "string", version: int | None = None) -> DataFrame:
        """(user_id, n_user_samples, has_meta, trained_at) of the users that have a model, as the decision (I1, I2) and routing read them."""
        m = self.meta(version).where("user_id is not null")
        return m.select(F.col("user_id").try_cast(user_type).alias("user_id"), "n_user_samples", F.col("n_user_samples").isNotNull().alias("has_meta"),
                        F.col("timestamp").alias("trained_at"))

    def forest(self, name: str = "rf_global", version: int | None = None) -> NodeForest:
        """One model as a forest of nodes."""
        return NodeForest(name, self.nodes(version).where(F.col("model_name") == name))

    def retrain(self, labeled: DataFrame, global_rows: DataFrame | None = None, force: bool = False, **fit) -> DataFrame:
        """Decide for all users by what is published, fit the due ones and publish their models; the decisions."""
        kind = dict(labeled.dtypes)["user_id"]
        decisions, meta, nodes = CR.retrain_all(labeled, self.users(kind), global_rows, force, **fit)
        if not meta.isEmpty():
            self.publish(meta, nodes)
        return decisions

    def score(self, readings: DataFrame, global_name: str | None = "rf_global") -> DataFrame:
        """Readings through their user's published model, else the global one if published, else the heuristic."""
        nodes = self.nodes()
        mine = nodes.where(F.col("model_name").startswith("rf_user_"))
        known = global_name is not None and not self.meta().where(F.col("model_name") == global_name).isEmpty()
        return CR.crisis_batch_routed(readings, mine, self.forest(global_name) if known else None)
