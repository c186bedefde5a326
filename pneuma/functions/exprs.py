"""Small Column helpers shared by every operator.

* ``rround`` rounds half-to-even on the binary value (numpy/pandas ``round``),
  not HALF_UP on the decimal string as ``F.round`` does.
* ``clip`` passes NULL through (``greatest``/``least`` would turn NULL into a bound).
* ``hash_uniform`` is a portable pseudo-random draw in [0, 1) that Spark and
  SQL engines compute identically from a seed and a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rround(c, digits: int) -> Column:
    """Half-to-even rounding to ``digits`` decimals, NULL-preserving."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL and NaN becomes NULL (it compares above every bound in Spark)."""
    c = nan_to_null(c)
    return F.when(c < F.lit(lo), F.lit(float(lo))).when(c > F.lit(hi), F.lit(float(hi))).otherwise(c)


def nan_to_null(c) -> Column:
    """Normalise a floating NaN (possible in Parquet) to SQL NULL."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def finite_or_null(c) -> Column:
    """``c`` where it is a finite number, else NULL (NaN compares above infinity, so one comparison does)."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def finite_columns(df):
    """Every floating column with NaN and infinities as NULL: the one place where a source normalises them."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def is_finite(c) -> Column:
    """True when ``c`` is neither NULL, NaN nor +-infinity."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def hash_uniform(key, seed: int | str = 42, salt: str = "") -> Column:
    """Deterministic draw in [0, 1): first 32 bits of md5(seed[:salt]:key) / 2^32.

    Identical in Spark and DuckDB (``('0x'||substr(md5(s),1,8))::BIGINT / 2^32``),
    so sampling and synthetic columns can be checked against SQL.
    """
    prefix = f"{seed}:{salt}:" if salt else f"{seed}:"
    s = F.concat(F.lit(prefix), col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sql_hash_uniform(key_sql: str, seed: int | str = 42, salt: str = "") -> str:
    """DuckDB text of :func:`hash_uniform` (for oracle queries)."""
    prefix = f"{seed}:{salt}:" if salt else f"{seed}:"
    return (f"(('0x' || substr(md5('{prefix}' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"
            f" / 4294967296.0E0)")


def decimal_avg(c, scale: int = 4) -> Column:
    """Order-independent mean: exact DECIMAL sum, then one double division.

    Plain ``avg`` sums doubles in task order, so last bits depend on the plan;
    this form gives the same double on every run and in SQL engines. NaN and
    infinities are left out, as NULL is.
    """
    c = finite_or_null(c)
    return (F.sum(c.cast(f"decimal(38,{scale})")).cast("double")
            / F.count(c).cast("double"))


def micro_units(c) -> Column:
    """``c`` as a LONG count of 1e-6 units, rounded half-up to 6 decimals like a DECIMAL(·,6) cast.

    Sums of these are exact and run on long arithmetic; ``sum / 1e6`` equals the
    DECIMAL sum converted to double.
    """
    return F.rint(F.round(finite_or_null(c), 6) * F.lit(1e6)).cast("long")
