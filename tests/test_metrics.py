"""Exact percentiles and AUC against pandas / brute force."""

import numpy as np
import pandas as pd
import pytest

from pneuma.operators import metrics as MT
from pneuma.operators import series


@pytest.mark.parametrize("split", [2, 1 << 18])
@pytest.mark.parametrize("outlier", [None, 1e12])
def test_percentiles(spark, monkeypatch, split, outlier):
    monkeypatch.setattr(series, "SPLIT_ROWS", split)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900), "x": rng.normal(20, 7, 900).round(2)})
    pdf.loc[::17, "x"] = np.nan
    if outlier:
        pdf.loc[3, "x"] = outlier
    df = spark.createDataFrame(pdf)
    got = MT.percentiles(df, "x", [0.1, 0.5, 0.75], group="g").toPandas()
    for _, r in got.iterrows():
        exp = pdf.loc[pdf.g == r.g, "x"].dropna().quantile([0.1, 0.5, 0.75]).to_numpy()
        assert np.allclose([r.p0, r.p1, r.p2], exp, atol=1e-9)
    one = MT.percentiles(df, "x", [0.25]).collect()[0][0]
    assert abs(one - pdf.x.dropna().quantile(0.25)) < 1e-9


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.2, 2)  # ties on purpose
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    got = MT.auc_roc(df).collect()[0].auc_roc
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - round(brute, 6)) < 1e-9
