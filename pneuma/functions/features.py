"""Column functions for the crisis-model features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import DEFAULT_AGE, PATHOLOGIE_CODES, PATHOLOGIE_DEFAULT_CODE
from .exprs import col, micro_units, rround

TWO_PI = 2 * math.pi


def time_cyclical(hour, month) -> list[tuple[str, Column]]:
    """sin/cos of hour/24 and month/12, 6 digits."""
    h, m = col(hour), col(month)
    return [
        ("hour_sin", rround(F.sin(F.lit(TWO_PI) * h / F.lit(24.0)), 6)),
        ("hour_cos", rround(F.cos(F.lit(TWO_PI) * h / F.lit(24.0)), 6)),
        ("month_sin", rround(F.sin(F.lit(TWO_PI) * m / F.lit(12.0)), 6)),
        ("month_cos", rround(F.cos(F.lit(TWO_PI) * m / F.lit(12.0)), 6)),
    ]


def pathologie_code(p) -> Column:
    """C14: code of lower(trim(pathologie)); unknown or NULL -> 4."""
    key = F.lower(F.trim(col(p)))
    m = F.create_map(*[x for k, v in PATHOLOGIE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), F.lit(PATHOLOGIE_DEFAULT_CODE))


def profile_columns(age=None, pathologie=None, is_smoker=None, symptom_yesterday=None) -> list[tuple[str, Column]]:
    """C14 with defaults for absent parts: age 35, code 4, smoker 0, symptom 0."""
    return [
        ("age", F.coalesce(col(age).cast("int"), F.lit(DEFAULT_AGE)) if age is not None else F.lit(DEFAULT_AGE)),
        ("pathologie_encoded", pathologie_code(pathologie) if pathologie is not None
         else F.lit(PATHOLOGIE_DEFAULT_CODE)),
        ("is_smoker", F.coalesce(col(is_smoker).cast("int"), F.lit(0)) if is_smoker is not None else F.lit(0)),
        ("symptom_yesterday", F.coalesce(col(symptom_yesterday).cast("int"), F.lit(0))
         if symptom_yesterday is not None else F.lit(0)),
    ]


HISTORY_SPECS = [
    ("pm25_mean_24h", "mean", "pm25"),
    ("co_mean_24h", "mean", "co"),
    ("humidity_mean_24h", "mean", "humidity"),
    ("pm25_max_24h", "max", "pm25"),
    ("co_max_24h", "max", "co"),
    ("ier_max_24h", "max", "ier_score"),
]


def _field_or_zero(field: str):
    def fn(e):
        return F.coalesce(e[field], F.lit(0.0))
    return fn


def history_features(history, window: int = 24) -> list[tuple[str, Column]]:
    """Six features from a history array (oldest first), current row excluded.

    Last ``window`` entries; a missing field counts as 0.0; empty/NULL -> 0.0.
    Means sum exactly (DECIMAL) before one division.
    """
    h = col(history)
    n = F.coalesce(F.size(h), F.lit(0))
    last = F.when(n > window, F.slice(h, n - (window - 1), window)).otherwise(h)
    out = []
    for name, fn, field in HISTORY_SPECS:
        vals = F.transform(last, _field_or_zero(field))
        if fn == "mean":
            # exact sum in micro-units on long arithmetic (same value as a DECIMAL(38,6) sum)
            s = F.aggregate(vals, F.lit(0).cast("long"), lambda acc, x: acc + micro_units(x))
            e = s.cast("double") / F.lit(1e6) / F.size(vals).cast("double")
        else:
            e = F.array_max(vals)
        out.append((name, F.when(F.coalesce(F.size(last), F.lit(0)) > 0, rround(e, 3)).otherwise(F.lit(0.0))))
    return out
