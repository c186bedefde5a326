"""Blocked per-series operators against pandas on random series (small blocks force halos and carries)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pneuma.operators import series

INTERP_CASES = [
    ([None, 1, None, None, 4, None, None], 24, [None, 1, 2, 3, 4, 4, 4]),
    ([1, None, None, None, None, None, 7], 3, [1, 2, 3, 4, None, None, 7]),
    ([None, None, None], 2, [None, None, None]),
    ([1, None, None, None, None], 2, [1, 1, 1, None, None]),
    ([1, None, None, 5, None, 7], 1, [1, 7 / 3, None, 5, 6, 7]),
]


@pytest.mark.parametrize("vals,limit,expected", INTERP_CASES)
@pytest.mark.parametrize("block", [2, 3, 1000])
def test_interpolate_literals(spark, vals, limit, expected, block):
    df = spark.createDataFrame([(i + 1, None if v is None else float(v)) for i, v in enumerate(vals)],
                               "rn long, v double").withColumn("g", F.lit("s"))
    out = series.interpolate_limited(df, ["g"], "rn", ["v"], limit, block_rows=block)
    got = [r.v for r in out.orderBy("rn").collect()]
    for g, e in zip(got, expected):
        assert (g is None and e is None) or (g is not None and e is not None and abs(g - e) < 1e-12)


def _random_frame(seed=7, n_groups=3, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        ts = np.sort(rng.choice(np.arange(100000), size=n, replace=False))
        for i, t in enumerate(ts):
            v = float(np.round(rng.normal(50, 20), 2))
            if rng.random() < 0.15:
                v = None
            if 40 <= i < 80 and g == 1:
                v = None  # long gap
            rows.append((g * 1000000 + i, f"st{g}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(t)), v))
    return pd.DataFrame(rows, columns=["event_id", "station", "datetime", "x"])


def test_row_number_dense(spark):
    pdf = _random_frame()
    df = spark.createDataFrame(pdf)
    out = series.add_row_number(df, ["station"], ["datetime", "event_id"], F.date_trunc("day", "datetime")).toPandas()
    exp = pdf.sort_values(["station", "datetime", "event_id"]).groupby("station").cumcount() + 1
    got = out.set_index("event_id")["_rn"].loc[pdf.sort_values(["station", "datetime", "event_id"])["event_id"]]
    assert list(got) == list(exp)


@pytest.mark.parametrize("block", [37, 100000])
def test_rolling_and_interpolation_vs_pandas(spark, block):
    pdf = _random_frame()
    df = spark.createDataFrame(pdf)
    x = series.add_row_number(df, ["station"], ["datetime", "event_id"], F.date_trunc("day", "datetime"))
    roll = series.rolling(x, ["station"], "_rn", [("m", "mean", "x"), ("mx", "max", "x")], 24, block, 3).toPandas()
    interp = series.interpolate_limited(x, ["station"], "_rn", ["x"], 24, block).toPandas()
    lag = series.lag_blocked(x, ["station"], "_rn", "x", "prev", default=0.0, block_rows=block).toPandas()
    s = pdf.sort_values(["station", "datetime", "event_id"])
    g = s.groupby("station")["x"]
    exp_m = g.transform(lambda v: v.rolling(24, min_periods=1).mean()).round(3)
    exp_mx = g.transform(lambda v: v.rolling(24, min_periods=1).max()).round(3)
    exp_i = g.transform(lambda v: v.interpolate(method="linear", limit=24))
    exp_l = g.shift(1)
    r = roll.set_index("event_id").loc[s["event_id"]]
    i = interp.set_index("event_id").loc[s["event_id"]]
    lg = lag.set_index("event_id").loc[s["event_id"]]
    assert np.allclose(r["m"].to_numpy(float), exp_m.to_numpy(float), equal_nan=True, atol=1.5e-3)
    assert np.allclose(r["mx"].to_numpy(float), exp_mx.to_numpy(float), equal_nan=True)
    assert np.allclose(i["x"].to_numpy(float), exp_i.to_numpy(float), equal_nan=True, rtol=0, atol=1e-9)
    first = s.groupby("station").cumcount() == 0
    exp_lag = exp_l.where(~first.to_numpy(), 0.0)
    assert np.allclose(lg["prev"].to_numpy(float), exp_lag.to_numpy(float), equal_nan=True)


def test_interpolate_bucketed_vs_pandas(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(3):
        for i in range(400):
            v = None if (rng.random() < 0.3 or (g == 2 and 100 <= i < 180)) else float(np.round(rng.normal(10, 3), 2))
            rows.append((i, f"s{g}", v))
    pdf = pd.DataFrame(rows, columns=["k", "station", "x"])
    df = spark.createDataFrame(pdf)
    out = series.interpolate_bucketed(df, ["station"], ["k"], F.floor(F.col("k") / 37), ["x"], 24).toPandas()
    s = pdf.sort_values(["station", "k"])
    exp = s.groupby("station")["x"].transform(lambda v: v.interpolate(method="linear", limit=24))
    got = out.set_index(["station", "k"]).loc[list(zip(s.station, s.k))]["x"]
    assert np.allclose(got.to_numpy(float), exp.to_numpy(float), equal_nan=True, atol=1e-9)


def test_row_number_nulls_last(spark):
    rows = [(1, "a", "2024-01-02 10:00:00"), (2, "a", None), (3, "a", "2024-01-01 09:00:00"),
            (4, "a", "2024-01-02 08:00:00"), (5, "b", None), (6, "b", "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, station string, ts string") \
              .withColumn("datetime", F.col("ts").cast("timestamp_ntz"))
    out = series.add_row_number(df, ["station"], ["datetime", "event_id"],
                                series.time_bucket("datetime"), "rn", series.time_level("datetime"))
    got = {r.event_id: r.rn for r in out.collect()}
    assert got == {3: 1, 4: 2, 1: 3, 2: 4, 6: 1, 5: 2}


def _adversarial(kind: str) -> pd.DataFrame:
    """Readings whose ids do not follow time: falling, straddling id ranges, text or none; ties, NULL times, one dense minute."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(2):
        for i in range(260):
            t = pd.Timestamp("2024-03-01") + pd.Timedelta(minutes=int(rng.integers(0, 4000)) // 7 * 7)
            if 100 <= i < 180:
                t = pd.Timestamp("2024-03-02 12:00") + pd.Timedelta(seconds=int(rng.integers(0, 60)))
            if i % 65 == 0:
                t = pd.NaT
            v = None if rng.random() < 0.3 else float(np.round(rng.normal(50, 20), 2))
            rows.append([g * 10 ** 7 + i, f"st{g}", t, v])
    pdf = pd.DataFrame(rows, columns=["event_id", "station", "datetime", "pm25"])
    order = pdf["datetime"].rank(method="first", na_option="bottom")
    if kind == "falling":
        pdf["event_id"] = (10 ** 6 - order).astype("int64")
    if kind == "straddling":
        pdf["event_id"] = rng.permutation(len(pdf)) * 700_001 + 3
    if kind == "text":
        pdf["event_id"] = [f"id{x}" for x in rng.permutation(len(pdf))]
    if kind == "none":
        pdf["datetime"] = pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.permutation(len(pdf)), unit="s")
    return pdf


@pytest.mark.parametrize("kind", ["falling", "straddling", "text", "none"])
@pytest.mark.parametrize("split", [3, 1 << 18])
def test_series_operators_with_ids_that_do_not_follow_time(spark, monkeypatch, kind, split):
    from pneuma.operators import clean, features
    monkeypatch.setattr(series, "SPLIT_ROWS", split)
    pdf = _adversarial(kind)
    pdf["co"], pdf["humidity"], pdf["ier_score"] = pdf["pm25"] * 2, pdf["pm25"] / 2, pdf["pm25"].fillna(0.0)
    pdf["symptom_label"] = (pdf["ier_score"] > 50).astype(int)
    df = spark.createDataFrame(pdf).repartition(5)
    tie = None if kind == "none" else "event_id"
    s = pdf.sort_values(["station", "datetime", "event_id"], na_position="last")
    g = s.groupby("station")

    def by_id(out):
        return out.toPandas().set_index("event_id").loc[s["event_id"]]

    roll = by_id(features.rolling_24(df, tiebreak=tie))
    want = g["pm25"].transform(lambda v: v.rolling(24, min_periods=1).mean())
    assert np.allclose(roll["pm25_24h_mean"] if "pm25_24h_mean" in roll else roll[features.ROLL_SPECS[0][0]], want, atol=1.5e-3,
                       equal_nan=True)
    inter = by_id(clean.interpolate_station(df, order_tiebreak=tie or "-", cols=["pm25"]))["pm25"]
    assert np.allclose(inter.astype(float), g["pm25"].transform(lambda v: v.interpolate(method="linear", limit=24)), equal_nan=True)
    lag = by_id(features.symptom_lag(df, tiebreak=tie))["symptom_yesterday"]
    assert list(lag) == list(g["symptom_label"].shift(1).fillna(0).astype(int))
    hist = by_id(features.with_history(df, tiebreak=tie))["history"]
    values = {k: list(v) for k, v in g["ier_score"]}
    at = g.cumcount()
    for h, st, i in zip(hist, s["station"], at):
        assert [x["ier_score"] for x in h] == values[st][max(0, i - 24):i]
