"""SQL fragments (DuckDB dialect) for the oracle queries.

They spell out the same arithmetic as the Column functions, term by term,
so both engines evaluate identical IEEE operations.
"""

from __future__ import annotations

from ..tables import (
    ALERT_MESSAGES, CRISIS_MESSAGES, DEFAULT_BOUNDS, IER_FEATURES, IER_WEIGHTS, RISK_LEVELS, ZONE_INFO,
)


def lit(x: float) -> str:
    return f"({float(x)!r}E0)" if "e" not in repr(float(x)) else f"CAST({float(x)!r} AS DOUBLE)"


def rround(e: str, digits: int) -> str:
    s = 10 ** digits
    return f"(round_even(({e}) * {s}.0E0, 0) / {s}.0E0)"


def clip(e: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({e}) < {lit(lo)} THEN {lit(lo)} WHEN ({e}) > {lit(hi)} THEN {lit(hi)} ELSE ({e}) END)"


def norm(f: str, col: str | None = None, bounds=None) -> str:
    lo, hi = (bounds or DEFAULT_BOUNDS)[f]
    if hi == lo:
        return "0.0E0"
    return clip(f"(({col or f}) - {lit(lo)}) / {lit(hi - lo)} * 100.0E0", 0.0, 100.0)


def score(pathologie: str = "general", bounds=None, prefix: str = "") -> str:
    w = IER_WEIGHTS[pathologie]
    terms = " + ".join(f"{lit(w[f])} * {norm(f, prefix + f, bounds)}" for f in IER_FEATURES)
    return rround(clip(terms, 0.0, 100.0), 2)


def _level(s: str, idx: int) -> str:
    s2 = f"(CASE WHEN ({s}) IS NULL THEN 100.0E0 WHEN ({s}) < 0 THEN 0.0E0 WHEN ({s}) > 100 THEN 100.0E0 ELSE ({s}) END)"
    parts = [f"WHEN {s2} BETWEEN {lo} AND {hi} THEN {q(v[idx - 2])}" for lo, hi, *v in RISK_LEVELS[:-1]]
    return f"(CASE {' '.join(parts)} ELSE {q(RISK_LEVELS[-1][idx])} END)"


def level(s: str) -> str:
    return _level(s, 2)


def color(s: str) -> str:
    return _level(s, 3)


def action(s: str) -> str:
    return _level(s, 4)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def zone_from_ier(s: str) -> str:
    return f"(CASE WHEN ({s}) <= 25 THEN 'A' WHEN ({s}) <= 50 THEN 'B' WHEN ({s}) <= 75 THEN 'C' ELSE 'D' END)"


def zone_field(z: str, idx: int) -> str:
    parts = " ".join(f"WHEN ({z}) = '{r[0]}' THEN {q(r[idx]) if isinstance(r[idx], str) else r[idx]}"
                     for r in ZONE_INFO)
    return f"(CASE {parts} END)"


def zone_risk(z: str) -> str:
    return f"COALESCE(CASE ({z}) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 END, 1)"


def one_digit(e: str) -> str:
    return f"printf('%.1f', {rround(e, 1)})"


def fill(tpl: str, values: dict) -> str:
    import re
    parts = []
    for piece in re.split(r"(\{\w+\})", tpl):
        if piece.startswith("{") and piece.endswith("}") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append(q(piece))
    return "(" + " || ".join(parts) + ")"


def alert_cols(s: str = "ier_score", lv: str = "ier_level", act: str = "ier_action", zone: str = "zone",
               rec: str | None = None) -> str:
    z = f"COALESCE({zone}, 'A')"
    rec = rec or zone_field(z, 3)
    trig = f"COALESCE(({s}) >= 51 AND {z} IN ('C', 'D'), false)"
    urg = f"({z} = 'D' OR COALESCE({lv} = 'Critique', false))"
    vals = {"s": one_digit(s), "z": z, "a": act, "r": f"COALESCE({rec}, '')"}
    return (f"{trig} AS alert_triggered, "
            f"CASE WHEN {urg} THEN 'URGENT' WHEN {trig} THEN 'AVERTISSEMENT' ELSE 'INFO' END AS alert_priority, "
            f"CASE WHEN {urg} THEN {fill(ALERT_MESSAGES['URGENT'], vals)} "
            f"WHEN {trig} THEN {fill(ALERT_MESSAGES['AVERTISSEMENT'], vals)} "
            f"ELSE {fill(ALERT_MESSAGES['INFO'], vals)} END AS alert_message")


def crisis_level(p: str) -> str:
    return (f"(CASE WHEN ({p}) >= 0.8E0 THEN 'CRITIQUE' WHEN ({p}) >= 0.6E0 THEN 'ELEVE' "
            f"WHEN ({p}) >= 0.4E0 THEN 'MODERE' ELSE 'FAIBLE' END)")


def crisis_color(lv: str) -> str:
    return (f"(CASE ({lv}) WHEN 'CRITIQUE' THEN '#e74c3c' WHEN 'ELEVE' THEN '#e67e22' "
            f"WHEN 'MODERE' THEN '#f39c12' WHEN 'FAIBLE' THEN '#2ecc71' END)")


def crisis_message(p: str, lv: str, path: str) -> str:
    pct = f"CAST(CAST(floor(({p}) * 100.0E0) AS INTEGER) AS VARCHAR)"
    parts = " ".join(f"WHEN ({lv}) = '{k}' THEN {fill(t, {'p': path, 'pct': pct})}"
                     for k, t in CRISIS_MESSAGES.items())
    return f"(CASE {parts} END)"


def crisis_base(s: str) -> str:
    return f"(CASE WHEN ({s}) >= 76 THEN 0.88E0 WHEN ({s}) >= 51 THEN 0.55E0 WHEN ({s}) >= 26 THEN 0.22E0 ELSE 0.06E0 END)"


def hash_uniform(key_sql: str, seed=42, salt: str = "") -> str:
    prefix = f"{seed}:{salt}:" if salt else f"{seed}:"
    return (f"(('0x' || substr(md5('{prefix}' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"
            f" / 4294967296.0E0)")


def decimal_avg(e: str, scale: int = 4) -> str:
    return f"(CAST(sum(CAST({e} AS DECIMAL(38,{scale}))) AS DOUBLE) / CAST(count({e}) AS DOUBLE))"
