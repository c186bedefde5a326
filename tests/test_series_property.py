"""Property test: blocked interpolation / rolling equal pandas for random series and block sizes."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pneuma.operators import series

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, limit=st.integers(1, 6), block=st.integers(7, 25))
def test_blocked_matches_pandas(spark, vals, limit, block):
    pdf = pd.DataFrame({"rn": np.arange(1, len(vals) + 1), "g": "s", "v": vals}).astype({"v": "float64"})
    df = spark.createDataFrame(pdf)
    got_i = series.interpolate_limited(df, ["g"], "rn", ["v"], limit, block).orderBy("rn").toPandas()["v"]
    exp_i = pdf["v"].interpolate(method="linear", limit=limit)
    assert np.allclose(got_i.to_numpy(float), exp_i.to_numpy(float), equal_nan=True, atol=1e-9)
    got_r = series.rolling(df, ["g"], "rn", [("m", "max", "v")], 6, block, None).orderBy("rn").toPandas()["m"]
    exp_r = pdf["v"].rolling(6, min_periods=1).max()
    assert np.allclose(got_r.to_numpy(float), exp_r.to_numpy(float), equal_nan=True)
