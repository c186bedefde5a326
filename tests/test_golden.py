"""Golden scalar cases (single readings, level boundaries, heuristics, cyclic time)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pneuma.functions import alerts as A
from pneuma.functions import features as FX
from pneuma.functions import index as IX
from pneuma.operators import scoring as S
from pneuma.tables import DEFAULT_BOUNDS, IER_FEATURES, IER_WEIGHTS, RISK_LEVELS

def plain_score(reading, pathologie):
    """The index in plain Python: weighted sum of values scaled into their bounds."""
    total = 0.0
    for f in IER_FEATURES:
        lo, hi = DEFAULT_BOUNDS[f]
        total += IER_WEIGHTS[pathologie][f] * min(100.0, max(0.0, (reading[f] - lo) / (hi - lo) * 100.0))
    return round(min(100.0, max(0.0, total)), 2)


def plain_level(score):
    """The first range that holds the score, ends included; the gaps between the ranges belong to the last one."""
    return next((name for lo, hi, name, *_ in RISK_LEVELS if lo <= score <= hi), RISK_LEVELS[-1][2])


def test_readings_against_plain_python(spark):
    rng = random.Random(17)
    rows = [{"pm25": rng.choice([-4.0, 0.0, 133.25, 500.0, 911.0, rng.uniform(0, 600)]), "co": rng.uniform(-3, 70),
             "humidity": rng.uniform(-10, 120), "temperature": rng.uniform(-45, 66)} for _ in range(60)]
    df = spark.createDataFrame([tuple(r[f] for f in IER_FEATURES) for r in rows], ", ".join(f"{f} double" for f in IER_FEATURES))
    for path in IER_WEIGHTS:
        got = {tuple(r[f] for f in IER_FEATURES): r for r in S.score_realtime(df, path).collect()}
        for r in rows:
            x, score = got[tuple(r[f] for f in IER_FEATURES)], plain_score(r, path)
            assert abs(x.ier_score - score) < 0.0101  # half-way digits may fall either way in the last place
            assert x.ier_level == plain_level(x.ier_score)
            assert x.alert_triggered == (x.zone in ("C", "D")) or x.ier_level == "Critique"
            assert x.cluster_id == -1 and x.zone_fallback


def test_missing_values_have_no_score(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 4.0, 33.0, 9.0), (None, 4.0, 33.0, 9.0), (61.0, 4.0, nan, 9.0)],
                               "pm25 double, co double, humidity double, temperature double")
    assert [(r.ier_score, r.ier_level) for r in S.score_realtime(df, "asthme").collect()] == [(None, "Critique")] * 3


def test_level_boundaries(spark):
    vals = [0.0, 24.999, 25.0, 25.4, 26.0, 37.7, 50.0, 50.2, 51.0, 75.0, 75.9, 76.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (-0.5,), (400.0,)], "s double")
    got = [r.l for r in df.select(IX.risk_level("s").alias("l")).collect()]
    assert got == [plain_level(v) for v in vals] + [plain_level(100), plain_level(0), plain_level(100)]
    closed = [r.l for r in df.select(IX.risk_level("s", contiguous=True).alias("l")).collect()]
    names = [r[2] for r in RISK_LEVELS]
    assert closed[:len(vals)] == [names[sum(v > top for top in (25, 50, 75))] for v in vals]


def test_alert_message_rounding(spark):
    df = spark.createDataFrame([(25.25, "Critique", "x", "D")], "ier_score double, ier_level string, ier_action string, zone string")
    r = df.select(*[e.alias(n) for n, e in A.alert_columns()]).collect()[0]
    assert r.alert_message.startswith("⚠ Alerte critique — IER=25.2 | Zone D. x. ")
    assert r.alert_priority == "URGENT"


def test_crisis_bonuses(spark):
    scores = [3.0, 25.0, 25.5, 44.0, 50.0, 61.0, 75.0, 80.5, 99.0]
    df = spark.createDataFrame([(s, z, y) for s in scores for z in "ABCD" for y in (False, True)],
                               "ier_score double, zone string, symptom_yesterday boolean")
    p = A.crisis_heuristic_single("ier_score", "zone", "symptom_yesterday")
    x = df.select("*", p.alias("p"), A.crisis_heuristic_base("ier_score").alias("base"))
    x = x.withColumn("lvl", A.crisis_alert_level("p"))
    rows = x.select("*", A.crisis_notify("p").alias("n"), A.crisis_message("p", "lvl", F.lit("general")).alias("m")).collect()
    base = {r.ier_score: r.base for r in rows}
    assert all(base[a] <= base[b] for a, b in zip(scores, scores[1:]))
    for r in rows:
        want = min(1.0, r.base + (0.15 if r.zone in "CD" else 0.0))
        want = min(1.0, want + (0.1 if r.symptom_yesterday else 0.0))
        assert abs(r.p - want) < 1e-4 and r.n == (r.p >= 0.4)
        assert f"({int(r.p * 100)}%)" in r.m


def test_cyclic_time(spark):
    df = spark.createDataFrame([(h, m) for h in range(24) for m in range(1, 13)], "h int, m int")
    for r in df.select("h", "m", *[e.alias(n) for n, e in FX.time_cyclical("h", "m")]).collect():
        for name, part, turn in (("hour", r.h, 24), ("month", r.m, 12)):
            assert abs(r[f"{name}_sin"] - math.sin(2 * math.pi * part / turn)) < 1e-6
            assert abs(r[f"{name}_cos"] - math.cos(2 * math.pi * part / turn)) < 1e-6


def test_history_features_window(spark):
    from pneuma.tables import HISTORY_TYPE
    hist = [{"pm25": 8.0, "co": 0.25, "humidity": 41.0, "ier_score": 52.5}, {"pm25": 21.0, "co": 7.0, "humidity": 12.0, "ier_score": 9.0}]
    df = spark.createDataFrame([(hist,), ([],), (None,)], f"h {HISTORY_TYPE.simpleString()}")
    rows = df.select(*[e.alias(n) for n, e in FX.history_features("h")]).collect()
    assert rows[0].pm25_mean_24h == 14.5 and rows[0].co_mean_24h == 3.625 and rows[0].ier_max_24h == 52.5
    assert all(v == 0.0 for v in rows[1]) and all(v == 0.0 for v in rows[2])
    long = [{"pm25": float(i), "co": 0.0, "humidity": 0.0, "ier_score": 0.0} for i in range(30)]
    r = spark.createDataFrame([(long,)], f"h {HISTORY_TYPE.simpleString()}") \
             .select(*[e.alias(n) for n, e in FX.history_features("h")]).collect()[0]
    assert r.pm25_mean_24h == sum(range(6, 30)) / 24 and r.pm25_max_24h == 29.0


def test_profile_codes(spark):
    df = spark.createDataFrame([(" Rhinite ",), ("copd",), ("x",), (None,)], "p string")
    assert [r.c for r in df.select(FX.pathologie_code("p").alias("c")).collect()] == [1, 3, 4, 4]


def test_unknown_pathologie_raises():
    with pytest.raises(ValueError):
        IX.get_weights("copd")
    assert math.isclose(sum(IX.get_weights(" Asthme ").values()), 1.0)


def test_score_by_pathologie_column(spark):
    names = ("bronchite", "General ", " ASTHME", "rhinite", "autre", None)
    rows = [(217.0, 11.0, 38.0, -6.0, p) for p in names]
    df = spark.createDataFrame(rows, "pm25 double, co double, humidity double, temperature double, p string")
    got = [r.s for r in df.select(IX.ier_score_by_column("p").alias("s")).collect()]
    reading = dict(zip(("pm25", "co", "humidity", "temperature"), rows[0]))
    assert got[:4] == [plain_score(reading, p.strip().lower()) for p in names[:4]] and got[4:] == [None, None]
