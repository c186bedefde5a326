"""Respiratory risk index (0-100) as Column expressions.

The same expressions serve batch tables, single readings (a one-row
DataFrame) and streams: there is no second code path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import DEFAULT_BOUNDS, IER_FEATURES, IER_WEIGHTS, RISK_LEVELS
from .exprs import clip, col, rround


def get_weights(pathologie: str) -> dict[str, float]:
    """C1 for a literal: lower + strip, unknown -> ValueError."""
    key = pathologie.lower().strip()
    if key not in IER_WEIGHTS:
        raise ValueError(f"unknown pathologie '{key}'; accepted: {list(IER_WEIGHTS)}")
    return IER_WEIGHTS[key]


def resolve_bounds(bounds: Mapping | None) -> dict[str, tuple[float, float]]:
    """Per-feature (min, max); features missing from ``bounds`` use the defaults.

    ``bounds`` may map feature -> (min, max) or feature -> {"min":..,"max":..}.
    """
    out = dict(DEFAULT_BOUNDS)
    for f, b in (bounds or {}).items():
        if isinstance(b, Mapping):
            out[f] = (float(b["min"]), float(b["max"]))
        elif isinstance(b[0], Column):
            out[f] = (b[0], b[1])
        else:
            out[f] = (float(b[0]), float(b[1]))
    return out


def normalize_minmax(c, feature: str, bounds: Mapping | None = None) -> Column:
    """(x - min) / (max - min) * 100 clipped to [0, 100]; 0 when max == min."""
    b = resolve_bounds(bounds)
    if feature not in b:
        raise ValueError(f"unknown feature '{feature}'")
    lo, hi = b[feature]
    if isinstance(lo, Column):  # bounds that stand on the row
        return F.when(hi == lo, F.lit(0.0)).otherwise(clip((col(c) - lo) / (hi - lo) * F.lit(100.0), 0.0, 100.0))
    if hi == lo:
        return F.lit(0.0)
    return clip((col(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(100.0), 0.0, 100.0)


def ier_score(pathologie: str = "general", bounds: Mapping | None = None,
              cols: Mapping[str, str] | None = None) -> Column:
    """C5 score: weighted sum in feature order, clipped, rounded to 2 (half-even)."""
    w = get_weights(pathologie)
    cols = cols or {}
    total = None
    for f in IER_FEATURES:
        term = F.lit(w[f]) * normalize_minmax(cols.get(f, f), f, bounds)
        total = term if total is None else total + term
    return rround(clip(total, 0.0, 100.0), 2)


def ier_score_by_column(pathologie_col, bounds: Mapping | None = None) -> Column:
    """Score with the pathologie taken per row (lower + strip); unknown -> NULL."""
    key = F.lower(F.trim(col(pathologie_col)))
    total = None
    for f in IER_FEATURES:
        wmap = F.create_map(*[x for p, ws in IER_WEIGHTS.items() for x in (F.lit(p), F.lit(ws[f]))])
        term = F.element_at(wmap, key) * normalize_minmax(f, f, bounds)
        total = term if total is None else total + term
    return rround(clip(total, 0.0, 100.0), 2)


def risk_index(score, contiguous: bool = False) -> Column:
    """C7 as a level index 0..3 for a score.

    The score is clamped to [0, 100] (NULL counts as 100); the four inclusive
    integer ranges leave gaps (25 < s < 26 ...) that fall to the last level.
    ``contiguous=True`` closes the gaps (s <= 25, s <= 50, s <= 75).
    """
    s = col(score)
    s2 = F.least(F.greatest(F.coalesce(s, F.lit(100.0)), F.lit(0.0)), F.lit(100.0))
    expr = None
    for i, (lo, hi, *_vals) in enumerate(RISK_LEVELS[:-1]):
        cond = (s2 <= F.lit(float(hi))) if contiguous else s2.between(float(lo), float(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(RISK_LEVELS) - 1))


def level_from_index(idx, field: int) -> Column:
    """Text of level ``idx`` (field 2 level, 3 color, 4 action)."""
    return F.element_at(F.array(*[F.lit(r[field]) for r in RISK_LEVELS]), col(idx) + 1)


def _level_field(score, idx: int, contiguous: bool = False) -> Column:
    return level_from_index(risk_index(score, contiguous), idx)


def risk_level(score, contiguous: bool = False) -> Column:
    return _level_field(score, 2, contiguous)


def risk_color(score, contiguous: bool = False) -> Column:
    return _level_field(score, 3, contiguous)


def risk_action(score, contiguous: bool = False) -> Column:
    return _level_field(score, 4, contiguous)


def ier_columns(pathologie: str = "general", bounds: Mapping | None = None,
                add_details: bool = False, score_col: str = "ier_score") -> list[tuple[str, Column]]:
    """Ordered (name, Column) pairs appended by the batch index operator.

    With ``add_details`` the normalised values (``<f>_norm_ier``) and the
    contributions (``<f>_contrib``, 3 digits) are kept.
    """
    w = get_weights(pathologie)
    out: list[tuple[str, Column]] = []
    if add_details:
        for f in IER_FEATURES:
            out.append((f"{f}_norm_ier", normalize_minmax(f, f, bounds)))
    out.append((score_col, ier_score(pathologie, bounds)))
    out.append(("_risk_idx", risk_index(F.col(score_col))))
    out += [("ier_level", level_from_index("_risk_idx", 2)), ("ier_action", level_from_index("_risk_idx", 4)),
            ("ier_color", level_from_index("_risk_idx", 3))]
    if add_details:
        for f in IER_FEATURES:
            out.append((f"{f}_contrib", rround(F.lit(w[f]) * F.col(f"{f}_norm_ier"), 3)))
    return out


def ier_detail(pathologie: str = "general", bounds: Mapping | None = None) -> Column:
    """C4 per-feature details: MAP<feature, STRUCT<raw, normalized, weight, contribution>>.

    raw 3 digits, normalized 2, contribution 2 (weight as is).
    """
    w = get_weights(pathologie)
    entries = []
    for f in IER_FEATURES:
        n = normalize_minmax(f, f, bounds)
        entries += [F.lit(f), F.struct(
            rround(f, 3).alias("raw"), rround(n, 2).alias("normalized"),
            F.lit(w[f]).alias("weight"), rround(F.lit(w[f]) * n, 2).alias("contribution"))]
    return F.create_map(*entries)
