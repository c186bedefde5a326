"""Local oracle check: run a registered Spark query and its DuckDB SQL and compare.

Mirrors the driver's gate: row count, column names, and the multiset of rows
(columns sorted by name). Used by tests and while developing.
"""

from __future__ import annotations

import math
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import datetime as dt

    import numpy as np
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT:
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
        return None if math.isnan(v) else v
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, float) and v == 0.0:
        return 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def compare(spark_pdf, duck_pdf) -> dict:
    sc, srows = rows_of(spark_pdf)
    dc, drows = rows_of(duck_pdf)
    res = {"spark_rows": len(spark_pdf), "oracle_rows": len(duck_pdf),
           "columns_match": sc == dc, "values_match": srows == drows}
    if sc != dc:
        res["spark_cols"] = sc
        res["oracle_cols"] = dc
    elif srows != drows:
        only_s = list((srows - drows).elements())[:3]
        only_d = list((drows - srows).elements())[:3]
        res["only_spark"] = only_s
        res["only_oracle"] = only_d
        res["n_diff"] = sum((srows - drows).values())
    res["ok"] = res["columns_match"] and res["values_match"] and len(spark_pdf) == len(duck_pdf)
    return res


def check(spark, key: str, sf_dir: str, con=None) -> dict:
    import importlib.util
    import os
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in sys.path:
        sys.path.insert(0, root)
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    q = mod.queries()[key]
    sql = mod.oracle_sql().get(key)
    spdf = q(spark, sf_dir).toPandas()
    if sql is None:
        return {"key": key, "ok": None, "spark_rows": len(spdf)}
    con = con or duckdb_conn(sf_dir)
    dpdf = con.execute(sql).df()
    r = compare(spdf, dpdf)
    r["key"] = key
    return r
