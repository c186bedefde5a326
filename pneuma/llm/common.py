"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pneuma.session import checkpoint, ensure_checkpoint_dir, ship

#: ASCII white space of the word contracts: [\x20\x09-\x0D].
ASCII_SPACE = "\x20\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pneuma-llm/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later jobs do not repeat the work, and a lost executor costs no
    more than the reading of its files. Use it where a checkpoint would be read in part.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols) -> "F.Column":
    """128-bit key of a row's listed columns as 32 hex digits (nulls are a value of their own)."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("n"))
             for c in cols]
    return F.md5(F.concat(*parts))


def batches_by_bytes(it, column: str, limit: int):
    """Cut Arrow batches so that the texts of one piece hold at most about ``limit`` bytes.

    A single longer text is a piece of its own.
    """
    import numpy as np
    for batch in it:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if batch.nbytes <= limit:
            yield batch
            continue
        import pyarrow.compute as pc
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0).cast("int64")))
        begin = 0
        while begin < n:
            base = size[begin - 1] if begin else 0
            end = int(np.searchsorted(size, base + limit, side="right"))
            end = min(n, max(end, begin + 1))
            yield batch.slice(begin, end - begin)
            begin = end


__all__ = ["ASCII_SPACE", "batches_by_bytes", "checkpoint", "ensure_checkpoint_dir", "materialize", "row_key",
           "shared_path", "ship", "table"]
