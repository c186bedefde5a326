"""Zones from the index, zone texts, index alerts and crisis alert levels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import (
    ALERT_HIGH_ZONES, ALERT_IER_MIN, ALERT_MESSAGES, ALERT_THRESHOLDS, CRISIS_BANDS,
    CRISIS_BASE, CRISIS_MESSAGES, CRISIS_SYMPTOM_BONUS, CRISIS_ZONE_BONUS, ZONE_INFO, ZONE_RISK,
)
from .exprs import col, rround


def zone_from_ier(score) -> Column:
    """<=25 A, <=50 B, <=75 C, else D (NULL -> D)."""
    s = col(score)
    return (F.when(s <= 25.0, "A").when(s <= 50.0, "B").when(s <= 75.0, "C").otherwise("D"))


def _zone_lookup(zone, idx: int) -> Column:
    z = col(zone)
    expr = None
    for row in ZONE_INFO:
        v = F.lit(row[idx])
        expr = F.when(z == row[0], v) if expr is None else expr.when(z == row[0], v)
    return expr


def zone_label(zone) -> Column:
    return _zone_lookup(zone, 1)


def zone_description(zone) -> Column:
    return _zone_lookup(zone, 2)


def zone_recommendation(zone) -> Column:
    return _zone_lookup(zone, 3)


def zone_color(zone) -> Column:
    return _zone_lookup(zone, 4)


def zone_risk_score(zone) -> Column:
    """Zone-table risk score (NULL for an unknown zone)."""
    return _zone_lookup(zone, 5)


def zone_risk(zone) -> Column:
    """A..D -> 1..4; unknown or NULL -> 1."""
    z = col(zone)
    expr = None
    for k, v in ZONE_RISK.items():
        expr = F.when(z == k, F.lit(v)) if expr is None else expr.when(z == k, F.lit(v))
    return F.coalesce(expr, F.lit(1))


def fill_template(tpl: str, values: dict) -> Column:
    """concat() of the literal pieces of ``tpl`` and the Columns named by {key}."""
    parts = []
    for piece in re.split(r"(\{\w+\})", tpl):
        if piece.startswith("{") and piece.endswith("}") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def one_digit(x) -> Column:
    """Text of ``x`` with one decimal after half-even rounding (``:.1f``)."""
    return F.format_string("%.1f", rround(x, 1))


def alert_columns(score="ier_score", level="ier_level", action="ier_action", zone="zone",
                  recommendation=None) -> list[tuple[str, Column]]:
    """Triggered, priority, message for an index reading and its zone.

    A NULL zone counts as 'A'. URGENT if zone D or level Critique; else
    AVERTISSEMENT if triggered (score >= 51 and zone C/D); else INFO.
    """
    z = F.coalesce(col(zone), F.lit("A"))
    s = col(score)
    rec = col(recommendation) if recommendation is not None else zone_recommendation(z)
    triggered = F.coalesce((s >= F.lit(float(ALERT_IER_MIN))) & z.isin(*ALERT_HIGH_ZONES), F.lit(False))
    urgent = (z == "D") | F.coalesce(col(level) == "Critique", F.lit(False))
    stxt = one_digit(s)

    def msg(tpl: str) -> Column:
        return fill_template(tpl, {"s": stxt, "z": z, "a": col(action), "r": F.coalesce(rec, F.lit(""))})

    priority = F.when(urgent, "URGENT").when(triggered, "AVERTISSEMENT").otherwise("INFO")
    message = (F.when(urgent, msg(ALERT_MESSAGES["URGENT"]))
               .when(triggered, msg(ALERT_MESSAGES["AVERTISSEMENT"]))
               .otherwise(msg(ALERT_MESSAGES["INFO"])))
    return [("alert_triggered", triggered), ("alert_priority", priority), ("alert_message", message)]


def crisis_alert_level(p) -> Column:
    """>= .80 CRITIQUE, >= .60 ELEVE, >= .40 MODERE, else FAIBLE."""
    p = col(p)
    expr = None
    for level, thr, _ in ALERT_THRESHOLDS[:-1]:
        expr = F.when(p >= thr, level) if expr is None else expr.when(p >= thr, level)
    return expr.otherwise(ALERT_THRESHOLDS[-1][0])


def crisis_alert_color(level) -> Column:
    lv = col(level)
    expr = None
    for name, _, color in ALERT_THRESHOLDS:
        expr = F.when(lv == name, color) if expr is None else expr.when(lv == name, color)
    return expr


def crisis_notify(p) -> Column:
    return col(p) >= F.lit(0.40)


def crisis_message(p, level, pathologie) -> Column:
    """Message per level; pct = floor(p * 100)."""
    pct = F.floor(col(p) * 100.0).cast("int").cast("string")
    lv = col(level)
    path = col(pathologie)

    def fill(tpl: str) -> Column:
        return fill_template(tpl, {"p": path, "pct": pct})

    expr = None
    for name, tpl in CRISIS_MESSAGES.items():
        expr = F.when(lv == name, fill(tpl)) if expr is None else expr.when(lv == name, fill(tpl))
    return expr


def crisis_heuristic_base(score) -> Column:
    """C17: index -> .88 / .55 / .22 / .06 at 76 / 51 / 26."""
    s = col(score)
    expr = None
    for thr, p in CRISIS_BANDS:
        expr = F.when(s >= float(thr), F.lit(p)) if expr is None else expr.when(s >= float(thr), F.lit(p))
    return expr.otherwise(F.lit(CRISIS_BASE))


def crisis_heuristic_single(score, zone, symptom_yesterday) -> Column:
    """Base + .15 in zone C/D, + .10 after a symptom day, capped at 1, 4 digits."""
    p = crisis_heuristic_base(score)
    p = F.when(col(zone).isin("C", "D"), F.least(p + F.lit(CRISIS_ZONE_BONUS), F.lit(1.0))).otherwise(p)
    p = F.when(F.coalesce(col(symptom_yesterday).cast("boolean"), F.lit(False)),
               F.least(p + F.lit(CRISIS_SYMPTOM_BONUS), F.lit(1.0))).otherwise(p)
    return rround(p, 4)
