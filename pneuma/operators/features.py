"""Feature operators (DataFrame -> DataFrame): E1, E2 windows, E5, H7, H8, K2, B10, B11, B13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import features as FX
from ..functions.exprs import is_finite
from ..tables import FEATURE_NAMES, HISTORY_TYPE, ROLLING_ROWS
from . import series

ROLL_SPECS = [(name, fn, src) for name, fn, src in FX.HISTORY_SPECS]


def rn_name(group: str | None, tiebreak: str | None) -> str:
    """Name of the row-number column of a series (group, datetime, tiebreak) so later steps can reuse it."""
    return f"_rn_{group or 'all'}_{tiebreak or 'none'}"


def add_series_rn(df: DataFrame, group: str | None = "station", tiebreak: str | None = "event_id",
                  time_bucket: str = "day") -> DataFrame:
    """Attach the series row number once; ``rolling_24``, ``with_history`` and ``symptom_lag`` reuse it.

    ``time_bucket`` ('day', 'hour', ...) is the coarse numbering bucket; denser units are cut further.
    """
    x, _, name, _ = _series_rn(df, group, tiebreak, time_bucket)
    return x


def _series_rn(df: DataFrame, group: str | None, tiebreak: str | None, time_bucket: str = "day"):
    """Row number along (datetime, tiebreak) per group (or one global series); reused when present."""
    groups = [group] if group and group in df.columns else []
    tb = tiebreak if tiebreak and tiebreak in df.columns else None
    name = rn_name(groups[0] if groups else None, tb)
    if name in df.columns:
        return df, groups, name, False
    order = (["datetime"] if "datetime" in df.columns else []) + ([tb] if tb else [])
    if not order:
        raise ValueError("an order column (datetime or a tiebreak key) is required")
    first = order[0]
    if first == "datetime":
        bucket, level = series.time_bucket("datetime", time_bucket), series.time_level("datetime")
    elif dict(df.dtypes)[first] in ("int", "bigint", "smallint", "tinyint"):
        bucket, level = F.floor(F.col(first) / F.lit(1 << 16)), F.floor(F.col(first) / F.lit(1 << 26))
    else:  # an order without a coarse unit: the cuts alone make the buckets
        bucket, level = F.lit(0), None
    return series.add_row_number(df, groups, order, bucket, name, level), groups, name, True


def rolling_24(df: DataFrame, group: str = "station", tiebreak: str | None = "event_id",
               rows: int = ROLLING_ROWS, block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """24-row trailing mean (pm25, co, humidity) and max (pm25, co, ier_score), current row included.

    Per station when a station column exists, else one global series; a
    missing source column gives 0.0; 3 digits.
    """
    x, groups, rn, made = _series_rn(df, group, tiebreak)
    specs = [s for s in ROLL_SPECS if s[2] in df.columns]
    out = series.rolling(x, groups, rn, specs, rows, block_rows, digits=3)
    missing = {name: F.lit(0.0) for name, _, src in ROLL_SPECS if src not in df.columns}
    out = out.withColumns(missing)
    return out.drop(rn) if made else out


def with_history(df: DataFrame, group: str = "station", tiebreak: str | None = "event_id", n: int = 24,
                 block_rows: int = series.DEFAULT_BLOCK_ROWS, name: str = "history") -> DataFrame:
    """Attach the previous ``n`` readings of the series as ARRAY<STRUCT<pm25,co,humidity,ier_score>>."""
    x, groups, rn, made = _series_rn(df, group, tiebreak)
    fields = [F.col(f.name).cast("double").alias(f.name) if f.name in df.columns
              else F.lit(None).cast("double").alias(f.name) for f in HISTORY_TYPE.elementType.fields]
    out = series.collect_previous(x, groups, rn, F.struct(*fields), n, block_rows, name)
    return out.drop(rn) if made else out


def history_features(df: DataFrame, history: str = "history") -> DataFrame:
    """E2 applied to a history column."""
    return df.withColumns(dict(FX.history_features(history)))


def symptom_lag(df: DataFrame, label: str = "symptom_label", group: str | None = "station",
                tiebreak: str | None = "event_id", block_rows: int = series.DEFAULT_BLOCK_ROWS,
                name: str = "symptom_yesterday") -> DataFrame:
    """E5: previous row's label in the series (first row -> 0)."""
    x, groups, rn, made = _series_rn(df, group, tiebreak)
    out = series.lag_blocked(x, groups, rn, label, name, default=0, block_rows=block_rows)
    out = out.withColumn(name, F.col(name).cast("int"))
    return out.drop(rn) if made else out


def profile_join(df: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """K2: attach the user profile (left join) and encode it with defaults (C14).

    No broadcast hint: the optimizer broadcasts the profile table only when its
    measured size is under the broadcast threshold, else it shuffles both sides.
    """
    p = profiles.select(key, *[F.col(c).alias(f"_p_{c}") for c in
                               ("age", "pathologie", "is_smoker", "symptom_yesterday") if c in profiles.columns])
    j = df.join(p, on=key, how="left")
    enc = FX.profile_columns(*[F.col(f"_p_{c}") if f"_p_{c}" in j.columns else None
                               for c in ("age", "pathologie", "is_smoker", "symptom_yesterday")])
    return j.withColumns(dict(enc)).drop(*[c for c in j.columns if c.startswith("_p_")])


def with_profile(df: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """The user's profile as it stands (age, pathologie, is_smoker, symptom_yesterday), for ``features_realtime`` to encode."""
    own = [c for c in ("age", "pathologie", "is_smoker", "symptom_yesterday") if c in profiles.columns]
    return df.drop(*own).join(profiles.select(key, *own), key, "left")


def features_batch(df: DataFrame, keep=("event_id",), group: str = "station", tiebreak: str | None = "event_id",
                   block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """H7: the 20 model features per row; id and label columns stay on the row.

    zone -> zone_risk_score (absent -> 1); datetime -> cyclic time (absent -> 0.0);
    24-row rolling per station; profile columns encoded with defaults.
    """
    x = df
    x = x.withColumn("zone_risk_score", A.zone_risk("zone") if "zone" in x.columns else F.lit(1))
    if "datetime" in x.columns:
        x = x.withColumns(dict(FX.time_cyclical(F.hour("datetime"), F.month("datetime"))))
    else:
        x = x.withColumns({c: F.lit(0.0) for c in ("hour_sin", "hour_cos", "month_sin", "month_cos")})
    x = rolling_24(x, group, tiebreak, block_rows=block_rows)
    prof = {c: (F.col(c) if c in x.columns else None) for c in ("age", "pathologie", "is_smoker", "symptom_yesterday")}
    if "pathologie_encoded" not in x.columns:
        x = x.withColumns(dict(FX.profile_columns(**prof)))
    keep = [k for k in keep if k in df.columns] + [c for c in ("symptom_label", "label") if c in df.columns]
    return x.select(*keep, *[F.col(f).cast("double").alias(f) for f in FEATURE_NAMES])


def features_realtime(df: DataFrame, history: str = "history", keep=("event_id",)) -> DataFrame:
    """H8: the 20 features of single readings with the realtime defaults.

    zone A, hour 12, month 6 (or from ``datetime``), history features E2,
    profile defaults; a feature map column ``feature_values`` for the dict form.
    """
    x = df
    zone = F.col("zone") if "zone" in x.columns else F.lit("A")
    hour = F.col("hour") if "hour" in x.columns else (F.hour("datetime") if "datetime" in x.columns else F.lit(12))
    month = F.col("month") if "month" in x.columns else (F.month("datetime") if "datetime" in x.columns else F.lit(6))
    x = x.withColumn("zone_risk_score", A.zone_risk(zone))
    x = x.withColumns(dict(FX.time_cyclical(hour, month)))
    hist = F.col(history) if history in x.columns else F.lit(None).cast(HISTORY_TYPE)
    x = x.withColumns(dict(FX.history_features(hist)))
    prof = {c: (F.col(c) if c in x.columns else None) for c in ("age", "pathologie", "is_smoker", "symptom_yesterday")}
    x = x.withColumns(dict(FX.profile_columns(**prof)))
    keep = [k for k in keep if k in df.columns]
    return x.select(*keep, *[F.col(f).cast("double").alias(f) for f in FEATURE_NAMES])


def feature_map(df: DataFrame, name: str = "feature_values") -> DataFrame:
    """Dict form of the features: MAP<STRING, DOUBLE> in feature order."""
    return df.withColumn(name, F.create_map(*[x for f in FEATURE_NAMES for x in (F.lit(f), F.col(f))]))


def feature_validity(df: DataFrame) -> DataFrame:
    """Per row, the names of features that are NULL, NaN or infinite, and a validity flag."""
    bad = F.array_compact(F.array(*[F.when(~is_finite(f), F.lit(f)) for f in FEATURE_NAMES]))
    return df.withColumn("invalid_features", bad).withColumn("is_valid", F.size("invalid_features") == 0)


def finite_mask(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL/NaN/infinite feature."""
    cond = None
    for f in FEATURE_NAMES:
        cond = is_finite(f) if cond is None else cond & is_finite(f)
    return df.filter(cond)


def feature_select(df: DataFrame) -> DataFrame:
    """The 20 features in model order."""
    return df.select(*FEATURE_NAMES)
