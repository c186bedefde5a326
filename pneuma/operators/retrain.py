"""Per-user retraining decisions and model routing.

All users are decided in one job: labeled-row counts per user (partial
aggregation) left-joined with the model meta table (one row per trained model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rround
from ..tables import FEATURE_NAMES, MIN_SAMPLES_USER, RETRAIN_EVERY_N

# FIXED VALUES: decision texts ({n} samples, {left} remaining, {new} new rows).
RETRAIN_REASONS = {
    "too_few": "Donnees insuffisantes : {n}/30 ({left} sondages restants)",
    "first": "Premier entrainement ({n} samples disponibles)",
    "enough_new": "Nouvelles donnees suffisantes : +{new} depuis le dernier entrainement",
    "not_enough_new": "Pas assez de nouvelles donnees : +{new}/10",
    "no_meta": "Metadata absente - re-entrainement force",
}


def user_sample_count(labeled: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Labeled rows per user."""
    return labeled.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_samples"))


def _fill(tpl: str, **cols) -> F.Column:
    from ..functions.alerts import fill_template
    return fill_template(tpl, {k: v.cast("string") for k, v in cols.items()})


def should_retrain(labeled: DataFrame, models: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Per user (retrain, reason).

    ``models``: one row per existing user model with ``n_user_samples`` (rows
    seen at the last training; NULL when the meta is missing).
    < 30 rows -> no; no model -> yes; meta missing -> yes; >= 10 new rows -> yes; else no.
    """
    c = user_sample_count(labeled, user_col)
    m = models.select(user_col, F.lit(True).alias("has_model"), F.col("n_user_samples").alias("_n_last"),
                      F.col("has_meta"))
    j = c.join(m, user_col, "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))
    n = F.col("n_samples")
    new = n - F.coalesce(F.col("_n_last"), F.lit(0))
    retrain = (F.when(n < MIN_SAMPLES_USER, False).when(~F.col("has_model"), True)
                .when(~F.coalesce(F.col("has_meta"), F.lit(False)), True)
                .otherwise(new >= RETRAIN_EVERY_N))
    reason = (F.when(n < MIN_SAMPLES_USER, _fill(RETRAIN_REASONS["too_few"], n=n, left=F.lit(MIN_SAMPLES_USER) - n))
               .when(~F.col("has_model"), _fill(RETRAIN_REASONS["first"], n=n))
               .when(~F.coalesce(F.col("has_meta"), F.lit(False)), F.lit(RETRAIN_REASONS["no_meta"]))
               .when(new >= RETRAIN_EVERY_N, _fill(RETRAIN_REASONS["enough_new"], new=new))
               .otherwise(_fill(RETRAIN_REASONS["not_enough_new"], new=new)))
    return j.select(user_col, "n_samples", "has_model", retrain.alias("retrain"), reason.alias("reason"))


def training_status(labeled: DataFrame, models: DataFrame, user_col: str = "user_id") -> DataFrame:
    """n_samples, min_required, progress_pct (cap 100, 1 digit), has_model, ready, next_retrain_in, last_trained."""
    c = user_sample_count(labeled, user_col)
    m = models.select(user_col, F.lit(True).alias("has_model"), F.col("n_user_samples").alias("_n_last"),
                      F.col("trained_at").alias("last_trained"))
    j = c.join(m, user_col, "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))
    n = F.col("n_samples")
    new = n - F.coalesce(F.col("_n_last"), F.lit(0))
    nxt = F.when(F.col("has_model"), F.greatest(F.lit(0), F.lit(RETRAIN_EVERY_N) - new)) \
           .otherwise(F.greatest(F.lit(0), F.lit(MIN_SAMPLES_USER) - n))
    return j.select(user_col, "n_samples", F.lit(MIN_SAMPLES_USER).alias("min_required"),
                    F.least(F.lit(100.0), rround(n / F.lit(float(MIN_SAMPLES_USER)) * 100.0, 1)).alias("progress_pct"),
                    "has_model", (n >= MIN_SAMPLES_USER).alias("ready_to_train"),
                    nxt.cast("long").alias("next_retrain_in"), "last_trained")


def model_routing(readings: DataFrame, models: DataFrame, has_global: bool, user_col: str = "user_id") -> DataFrame:
    """K3: per reading, the model to use: the user's own, else the global one, else the heuristic."""
    m = models.select(user_col, F.lit(True).alias("_has_user_model"))
    j = readings.join(m, user_col, "left")
    used = (F.when(F.coalesce(F.col("_has_user_model"), F.lit(False)),
                   F.concat(F.lit("rf_user_"), F.col(user_col).cast("string")))
             .otherwise(F.lit("rf_global" if has_global else "heuristic_fallback")))
    return j.withColumn("model_used", used).drop("_has_user_model")


def labeled_projection(df: DataFrame, label: str = "symptom_label", ts: str = "timestamp",
                       user_col: str = "user_id") -> DataFrame:
    """A13 projection: the 20 features (absent or NULL -> 0.0), label as int, timestamp."""
    feats = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns
             else F.lit(0.0).alias(f) for f in FEATURE_NAMES]
    keep = [user_col] if user_col in df.columns else []
    return df.select(*keep, *feats, F.col(label).cast("int").alias("symptom_label"),
                     F.col(ts).alias("timestamp") if ts in df.columns else F.current_timestamp().alias("timestamp"))


#: The labeled table has so many folders, whatever the number of users.
LABEL_BUCKETS = 64


def user_bucket(user: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(LABEL_BUCKETS)).cast("int")


def append_labeled(df: DataFrame, path: str, user_col: str = "user_id", batch: str | None = None) -> DataFrame:
    """Add rows to the labeled table; returns the new row count of each user that was in ``df``.

    The table is one folder per append (``batch``, a fresh name by default), split by a hash
    bucket of the user. Writing the same batch again replaces it, so a retried micro-batch adds nothing twice.
    """
    import uuid
    rows = labeled_projection(df, user_col=user_col)
    name = batch or uuid.uuid4().hex
    # One file per bucket and task at most; the rows are not shuffled for it.
    rows.withColumn("_bucket", user_bucket(F.col(user_col))).write.mode("overwrite").partitionBy("_bucket").parquet(
        f"{path.rstrip('/')}/_batch={name}")
    spark = df.sparkSession
    users = rows.select(user_col).distinct()
    return user_sample_count(load_labeled(spark, path).join(users, user_col, "left_semi"), user_col)


def load_labeled(spark, path: str, user_id=None, schema=None) -> DataFrame:
    """The labeled table, one user (only that user's bucket is read) or all; empty frame with schema when absent.

    NaN and infinities are NULL.
    """
    from ..functions.exprs import finite_columns
    from ..tables import LABELED_SCHEMA
    try:
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema or LABELED_SCHEMA)
        raise
    if user_id is not None:
        if "_bucket" in df.columns:
            df = df.filter(F.col("_bucket") == user_bucket(F.lit(user_id)))
        df = df.filter(F.col("user_id") == F.lit(user_id))
    return finite_columns(df.drop("_bucket", "_batch"))
