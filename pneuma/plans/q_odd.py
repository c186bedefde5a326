"""Registered queries over readings with NaN and infinities: the same answers as with missing values."""

from __future__ import annotations

from ..sources import views as V
from . import q_clean, q_features, q_index, q_models, q_profile  # noqa: F401  (their keys are used below)
from .catalog import ORACLE, QUERIES, register


def _register(key: str) -> None:
    @register(f"{key}_odd_values", V.with_odd_values(ORACLE[key]))
    def query(spark, sf):
        with V.odd_values():
            return QUERIES[key](spark, sf)


for _key in ("ier_batch", "rolling_24", "daily_station_mean", "interpolate_station", "describe_stats", "zone_assign"):
    _register(_key)
