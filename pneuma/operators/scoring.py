"""Index scoring operators (DataFrame -> DataFrame): C5, C6, C9, C10, C11.

All of them are projections (one pipelined stage, no shuffle); the only
joins are with fixed 4-row lookup tables, broadcast by construction.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..functions.exprs import clip, rround
from ..tables import IER_FEATURES, IER_WEIGHTS, require_columns


def ier_batch(df: DataFrame, pathologie: str = "general", bounds: Mapping | None = None,
              add_details: bool = False) -> DataFrame:
    """Append ier_score, level, action, color (and details) to every row."""
    require_columns(df, IER_FEATURES, "ier_batch")
    out = df
    for name, expr in IX.ier_columns(pathologie, bounds, add_details):
        out = out.withColumn(name, expr)
    return out.drop("_risk_idx")


def ier_all_pathologies(df: DataFrame, bounds: Mapping | None = None,
                        keep=("event_id",)) -> DataFrame:
    """One output row per (input row, pathologie) with score and level.

    The weights table is a fixed 4-row literal; each input row is expanded by
    ``explode`` of that literal array (no join, no shuffle).
    """
    require_columns(df, IER_FEATURES, "ier_all_pathologies")
    wrows = F.array(*[
        F.struct(F.lit(p).alias("pathologie"), *[F.lit(w[f]).alias(f"w_{f}") for f in IER_FEATURES])
        for p, w in IER_WEIGHTS.items()])
    x = df.select(*keep, *IER_FEATURES, F.explode(wrows).alias("w"))
    total = None
    for f in IER_FEATURES:
        term = F.col(f"w.w_{f}") * IX.normalize_minmax(f, f, bounds)
        total = term if total is None else total + term
    score = rround(clip(total, 0.0, 100.0), 2)
    return x.select(*keep, F.col("w.pathologie").alias("pathologie"),
                    score.alias("ier_score")) \
            .withColumn("ier_level", IX.risk_level("ier_score"))


def add_zone_info(df: DataFrame, zone_col: str = "zone") -> DataFrame:
    """Label, description, recommendation, color, risk_score of the zone."""
    z = F.col(zone_col)
    return df.withColumns({
        "zone_label": A.zone_label(z),
        "zone_description": A.zone_description(z),
        "zone_recommendation": A.zone_recommendation(z),
        "zone_color": A.zone_color(z),
        "zone_risk_score": A.zone_risk_score(z),
    })


def add_fallback_zone(df: DataFrame, score_col: str = "ier_score", record: bool = True) -> DataFrame:
    """Zone from the index alone; record form adds cluster_id=-1, fallback=true and zone info."""
    out = df.withColumn("zone", A.zone_from_ier(score_col))
    if record:
        out = add_zone_info(out).withColumns({"cluster_id": F.lit(-1), "zone_fallback": F.lit(True)})
    return out


def add_alerts(df: DataFrame, zone_col: str = "zone", recommendation_col: str | None = None) -> DataFrame:
    """C10 on scored rows (needs ier_score, ier_level, ier_action, zone)."""
    return df.withColumns(dict(A.alert_columns(zone=zone_col, recommendation=recommendation_col)))


def score_realtime(df: DataFrame, pathologie: str = "general", bounds: Mapping | None = None,
                   zone_model=None) -> DataFrame:
    """C11: index, zone (model when given, else fallback), alert per reading.

    Works unchanged on a streaming DataFrame (every step is a projection).
    """
    out = ier_batch(df, pathologie, bounds)
    if zone_model is not None:
        from .zones import zone_assign
        out = zone_assign(out, zone_model)
        out = add_zone_info(out.drop("zone_label", "zone_color", "zone_recommendation"))
        out = out.withColumn("zone_fallback", F.lit(False))
    else:
        out = add_fallback_zone(out)
    return add_alerts(out, recommendation_col="zone_recommendation")


def weights_check(profiles: DataFrame, col: str = "pathologie") -> DataFrame:
    """Per pathologie that occurs in ``profiles``: profiles, weight sum (9 digits), validity (|sum - 1| < 1e-9), feature count.

    Names without weights have a NULL sum and are not valid.
    """
    key = F.lower(F.trim(F.col(col)))
    seen = profiles.groupBy(key.alias("pathologie")).agg(F.count(F.lit(1)).alias("n_profiles"))
    weights = F.create_map(*[x for p, ws in IER_WEIGHTS.items()
                             for x in (F.lit(p), F.array(*[F.lit(float(ws[f])) for f in IER_FEATURES]))])
    w = F.element_at(weights, F.col("pathologie"))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return seen.select("pathologie", "n_profiles", rround(total, 9).alias("weight_sum"),
                       F.coalesce(F.abs(total - 1.0) < 1e-9, F.lit(False)).alias("valid"),
                       F.coalesce(F.size(w), F.lit(0)).cast("long").alias("n_features"))


def validate_readings(df: DataFrame, required=IER_FEATURES) -> DataFrame:
    """Required fields present and numeric; typed DOUBLE columns plus ``is_valid`` and ``reject_reason``.

    Works on string-typed input (e.g. a stream of raw messages). A missing
    column raises at once (no job); per row, NULL fields are 'missing' and
    unparsable ones 'not_numeric'.
    """
    require_columns(df, required, "reading")
    typed = {f: F.col(f).cast("string").try_cast("double") for f in required}
    missing = F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in required])
    bad = F.concat_ws(",", *[F.when(F.col(f).isNotNull() & typed[f].isNull(), F.lit(f)) for f in required])
    reason = F.concat_ws(";", F.when(missing != "", F.concat(F.lit("missing:"), missing)),
                         F.when(bad != "", F.concat(F.lit("not_numeric:"), bad)))
    out = df.withColumn("reject_reason", F.when(reason != "", reason))
    out = out.withColumns(typed)
    return out.withColumn("is_valid", F.col("reject_reason").isNull())


#: Fields of a reading's message.
MESSAGE_FIELDS = ["event_id", "user_id", "station", "datetime", *IER_FEATURES]


def validate_messages(messages: DataFrame, required=IER_FEATURES, column: str = "value") -> DataFrame:
    """B12 on raw JSON messages: the typed reading, ``raw`` (the message), ``reject_reason`` and ``is_valid``.

    A null message or one that is no JSON object is 'unparsable'; else required fields are missing or not_numeric as in
    ``validate_readings``. Other fields that do not fit their type are NULL.
    """
    fields = ", ".join(f"{f} string" for f in MESSAGE_FIELDS)
    m = messages.select(F.col(column).alias("raw"), F.from_json(
        F.col(column), f"{fields}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("m"))
    broken = F.col("raw").isNull() | F.col("m").isNull() | F.col("_broken").isNotNull()
    checked = validate_readings(m.select("raw", "m", "m.*"), required)
    reason = F.when(broken, F.lit("unparsable")).otherwise(F.col("reject_reason"))
    return checked.select(
        F.col("event_id").try_cast("bigint").alias("event_id"), F.col("user_id").try_cast("bigint").alias("user_id"), "station",
        F.col("datetime").try_cast("timestamp_ntz").alias("datetime"), *[f for f in IER_FEATURES], "raw",
        reason.alias("reject_reason"), reason.isNull().alias("is_valid"))


def pathologie_check(df: DataFrame, col: str = "pathologie") -> DataFrame:
    """C1 for a column: rows per normalised pathologie (lower + strip) and whether it has index weights.

    Unknown values (which the literal form rejects) are reported instead of failing the job.
    """
    from ..tables import IER_WEIGHTS
    key = F.lower(F.trim(F.col(col)))
    return (df.groupBy(key.alias("pathologie")).agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("has_weights", F.coalesce(F.col("pathologie").isin(*IER_WEIGHTS), F.lit(False))))
