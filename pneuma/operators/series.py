"""Ordered per-series operators without one-task-per-series windows.

A plain ``Window.partitionBy('station')`` puts a whole station into one task;
with few stations (or one station holding a third of the rows) that is one
giant sort. Here every window runs over bounded blocks instead:

1. ``add_row_number``: dense 1-based position inside each series. Rows fall
   into buckets that are runs of the order: a coarse bucket of the first order column
   (a day, an id range), cut further at order keys drawn from the data, one in
   ``SPLIT_ROWS``, so a dense day becomes many buckets whatever its ids look
   like. The buckets' offsets are running sums of their counts, in two levels,
   and the position is the offset plus ``row_number`` inside the bucket.
2. Fixed-size row blocks ``(rn - 1) div block_rows`` then bound every window:
   * ``rolling``: n-row frames; the last n-1 rows of each block are also
     emitted into the next block (halo, tagged and dropped after the window).
   * ``lag_blocked``: the same with a one-row halo.
   * ``interpolate_limited``: previous/next valid value per column; inside a
     block from windows, across blocks from a per-block summary table whose
     running last/first valid values are joined back (carry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_null, micro_units
from ..session import stored

DEFAULT_BLOCK_ROWS = 1 << 20
#: One order key in so many becomes a cut between buckets.
SPLIT_ROWS = 1 << 18
#: Rows of a coarse bucket meet its cuts in so many join keys.
_SALTS = 16
#: Buckets that one running sum of the first level covers, where buckets are numbers.
_LEVEL = 1024


def _gk(group_cols: list[str]) -> Column:
    """Internal series key: a struct of the group columns (never NULL itself).

    Struct equality treats NULL fields as equal, so plain equi-joins on it
    keep rows with NULL group values, and the join reuses the (key, block)
    hash partitioning of the windows instead of reshuffling.
    """
    return F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.struct(F.lit(0).alias("g"))


def time_bucket(ts: str, unit: str = "day") -> Column:
    """Coarse bucket of a time order: the time unit, NULL times last."""
    return F.struct(F.col(ts).isNull().alias("n"), F.date_trunc(unit, ts).alias("t"))


def time_level(ts: str) -> Column:
    """First level of the running sums over time buckets: the year."""
    return F.struct(F.col(ts).isNull().alias("n"), F.date_trunc("year", ts).alias("t"))


def _asc(cols):
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in cols]


def _order_key(cols) -> Column:
    """The order as one comparable value, NULLs last."""
    parts = []
    for i, c in enumerate(cols):
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*parts)


def _bucketed(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column, level: Column | None,
              split_rows: int | None = None) -> DataFrame:
    """``df`` with the series ``_gk``, the level ``_lv`` and the bucket ``_bk``: runs of the order.

    Cuts are the order keys whose hash falls into one of ``split_rows`` classes; equal keys share
    their side, so only rows equal in the whole order cannot be told apart. The table of cuts has ``_SALTS`` rows per
    coarse bucket that has any: rows meet it by a salt as well, so a dense bucket is not one join key.
    """
    b = df.withColumns({"_gk": _gk(group_cols), "_b0": F.struct(bucket.isNull().alias("n"), bucket.alias("v")),
                        "_lv": F.lit(0) if level is None else level, "_ok": _order_key(order_cols)})
    cuts = (b.where(F.pmod(F.xxhash64("_ok"), F.lit(split_rows or SPLIT_ROWS)) == 0).groupBy("_gk", "_b0")
            .agg(F.sort_array(F.collect_set("_ok")).alias("_cuts"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_ok"))), F.lit(0))
    j = b.withColumn("_salt", F.pmod(F.hash("_ok"), F.lit(_SALTS))).join(cuts, ["_gk", "_b0", "_salt"], "left")
    return j.withColumn("_bk", F.struct("_b0", F.when(F.col("_cuts").isNull(), 0).otherwise(part).alias("part"))).drop(
        "_b0", "_ok", "_cuts", "_salt")


def _offsets(b: DataFrame, amount: Column | None = None) -> DataFrame:
    """(_gk, _bk, _off): rows (or ``amount``) of the series before each bucket; over levels, then inside each."""
    counts = b.groupBy("_gk", "_lv", "_bk").agg((F.count(F.lit(1)) if amount is None else F.sum(amount)).alias("_n"))
    levels = counts.groupBy("_gk", "_lv").agg(F.sum("_n").alias("_n"))
    wl = Window.partitionBy("_gk").orderBy("_lv").rowsBetween(Window.unboundedPreceding, -1)
    base = levels.select("_gk", "_lv", F.coalesce(F.sum("_n").over(wl), F.lit(0)).alias("_base"))
    wb = Window.partitionBy("_gk", "_lv").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("_gk", "_lv", "_bk", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_in"))
    return inside.join(base, ["_gk", "_lv"]).select("_gk", "_bk", (F.col("_base") + F.col("_in")).alias("_off"))


def _carry(summ: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Last valid (rn, value) before and first valid after each block, per column, from (_gk, _lv, key, _l_*, _f_*).

    Positions rise along the series, so last and first are max and min; levels first, then inside each.
    """
    levels = summ.groupBy("_gk", "_lv").agg(*[F.max(f"_l_{c}").alias(f"_l_{c}") for c in cols],
                                            *[F.min(f"_f_{c}").alias(f"_f_{c}") for c in cols])

    def around(df: DataFrame, part: list[str], order: str, tag: str):
        # Running frames only: an unbounded-following frame is evaluated anew for every row.
        up = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return [*[F.max(f"_l_{c}").over(up).alias(f"_p{tag}_{c}") for c in cols],
                *[F.min(f"_f_{c}").over(down).alias(f"_n{tag}_{c}") for c in cols]]

    outer = levels.select("_gk", "_lv", *around(levels, ["_gk"], "_lv", "o"))
    inner = summ.select("_gk", "_lv", key, *around(summ, ["_gk", "_lv"], key, "i"))
    return inner.join(outer, ["_gk", "_lv"]).select(
        "_gk", key, *[F.coalesce(f"_pi_{c}", f"_po_{c}").alias(f"_ci_{c}") for c in cols],
        *[F.coalesce(f"_ni_{c}", f"_no_{c}").alias(f"_co_{c}") for c in cols])


def add_row_number(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column,
                   name: str = "_rn", level: Column | None = None, split_rows: int | None = None) -> DataFrame:
    """Dense position (1-based) of each row in its group ordered by ``order_cols``.

    ``bucket`` must be non-decreasing along the first order column inside a group (``time_bucket``
    for a time order, ``floor(id / w)`` for an id order), ``level`` along the buckets; NULLs order
    last, as in pandas sorting.
    """
    b = _bucketed(df, group_cols, order_cols, bucket, level, split_rows)
    j = b.join(_offsets(b), ["_gk", "_bk"], "left")
    w2 = Window.partitionBy("_gk", "_bk").orderBy(*_asc(order_cols))
    return j.withColumn(name, F.col("_off") + F.row_number().over(w2)).select(*df.columns, name)


def sum_before(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column, amount: str, name: str,
               split_rows: int | None = None) -> DataFrame:
    """Sum of ``amount`` over the rows of the group that come before each row in ``order_cols`` (unique per group)."""
    b = _bucketed(df, group_cols, order_cols, bucket, None, split_rows)
    j = b.join(_offsets(b, F.col(amount)), ["_gk", "_bk"])
    w = Window.partitionBy("_gk", "_bk").orderBy(*_asc(order_cols)).rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn(name, F.col("_off") + F.coalesce(F.sum(amount).over(w), F.lit(0))).select(*df.columns, name)


def _blocks_with_halo(df: DataFrame, rn: str, block_rows: int, halo: int) -> DataFrame:
    if halo >= block_rows:
        raise ValueError("block_rows must exceed the window length")
    r0 = F.col(rn) - 1
    blk = F.floor(r0 / F.lit(block_rows))
    in_halo = (r0 % F.lit(block_rows)) >= F.lit(block_rows - halo)
    blks = F.when(in_halo, F.array(blk, blk + 1)).otherwise(F.array(blk)) if halo > 0 else F.array(blk)
    return df.select("*", F.posexplode(blks).alias("_is_halo", "_blk"))


def window_exprs(specs: list[tuple[str, str, str]], w, digits: int | None = 3) -> list[tuple[str, Column]]:
    """(name, expression) of each spec over the window ``w``; means sum exactly before one division."""
    outs = []
    for name, fn, src in specs:
        c = finite_or_null(src)
        if fn == "mean":
            # exact sum in micro-units (long arithmetic), one division
            e = (F.sum(micro_units(c)).over(w).cast("double") / F.lit(1e6)
                 / F.count(c).over(w).cast("double"))
        elif fn == "max":
            e = F.max(c).over(w)
        elif fn == "min":
            e = F.min(c).over(w)
        elif fn == "sum":
            e = F.sum(micro_units(c)).over(w).cast("double") / F.lit(1e6)
        else:
            raise ValueError(fn)
        if digits is not None:
            e = F.rint(e * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)
        outs.append((name, e))
    return outs


def rolling(df: DataFrame, group_cols: list[str], rn: str, specs: list[tuple[str, str, str]],
            rows: int = 24, block_rows: int = DEFAULT_BLOCK_ROWS, digits: int | None = 3) -> DataFrame:
    """n-row trailing window (current row included, min_periods 1, NULLs skipped).

    ``specs`` = [(output, function 'mean'|'max'|'min'|'sum', source column)].
    Means sum exactly as DECIMAL before one division so the value does not
    depend on summation order.
    """
    x = _blocks_with_halo(df.withColumn("_gk", _gk(group_cols)), rn, block_rows, rows - 1)
    w = Window.partitionBy("_gk", "_blk").orderBy(rn).rowsBetween(-(rows - 1), 0)
    outs = [e.alias(name) for name, e in window_exprs(specs, w, digits)]
    return x.select(*df.columns, "_is_halo", *outs).filter(F.col("_is_halo") == 0).drop("_is_halo")


def lag_blocked(df: DataFrame, group_cols: list[str], rn: str, src: str, name: str, default=None,
                offset: int = 1, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``lag(src, offset, default)`` per group along ``rn`` over bounded blocks."""
    x = _blocks_with_halo(df.withColumn("_gk", _gk(group_cols)), rn, block_rows, offset)
    w = Window.partitionBy("_gk", "_blk").orderBy(rn)
    e = F.lag(F.col(src), offset).over(w)
    # The first ``offset`` rows of a series have no predecessor inside the halo either.
    e = F.when(F.col(rn) > offset, e).otherwise(F.lit(default))
    return x.select(*df.columns, "_is_halo", e.alias(name)).filter(F.col("_is_halo") == 0).drop("_is_halo")


def interpolate_limited(df: DataFrame, group_cols: list[str], rn: str, cols: list[str], limit: int,
                        block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Forward linear interpolation by row position with a fill limit.

    Same result as pandas ``interpolate(method='linear', limit=limit)`` per
    group: leading NULLs stay, trailing NULLs repeat the last valid value, and
    in a gap only the first ``limit`` rows are filled (with the straight line
    towards the next valid value, however far it is).
    """
    x = df.withColumns({"_gk": _gk(group_cols), "_blk": F.floor((F.col(rn) - 1) / F.lit(block_rows)),
                        **{c: finite_or_null(c) for c in cols}})
    keys = ["_gk", "_blk"]

    def sv(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(rn).alias("r"), F.col(c).alias("v")))

    # Per-block first/last valid (rn, value): a small table, one row per block.
    summ = x.withColumn("_lv", F.floor(F.col("_blk") / F.lit(_LEVEL))).groupBy("_gk", "_lv", "_blk").agg(
        *[F.max(sv(c)).alias(f"_l_{c}") for c in cols], *[F.min(sv(c)).alias(f"_f_{c}") for c in cols])
    carry = _carry(summ, "_blk", cols)
    wp = Window.partitionBy(*keys).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    wn = Window.partitionBy(*keys).orderBy(F.desc(rn)).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select("*", *[F.last(sv(c), ignorenulls=True).over(wp).alias(f"_p_{c}") for c in cols],
                     *[F.last(sv(c), ignorenulls=True).over(wn).alias(f"_n_{c}") for c in cols])
    j = inner.join(carry, keys, "left")
    out = {}
    for c in cols:
        p = F.coalesce(F.col(f"_p_{c}"), F.col(f"_ci_{c}"))
        n = F.coalesce(F.col(f"_n_{c}"), F.col(f"_co_{c}"))
        k = F.col(rn) - p["r"]
        line = p["v"] + (n["v"] - p["v"]) / (n["r"] - p["r"]).cast("double") * k.cast("double")
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                   .when(p.isNull() | (k > limit), F.lit(None))
                   .when(n.isNull(), p["v"])
                   .otherwise(line))
    return j.withColumns(out).select(*df.columns)


def collect_previous(df: DataFrame, group_cols: list[str], rn: str, value: Column, n: int,
                     block_rows: int = DEFAULT_BLOCK_ROWS, name: str = "history") -> DataFrame:
    """Array of ``value`` over the previous ``n`` rows (oldest first, current row excluded)."""
    x = _blocks_with_halo(df.withColumn("_gk", _gk(group_cols)), rn, block_rows, n)
    w = Window.partitionBy("_gk", "_blk").orderBy(rn).rowsBetween(-n, -1)
    return (x.select(*df.columns, "_is_halo", F.collect_list(value).over(w).alias(name))
             .filter(F.col("_is_halo") == 0).drop("_is_halo"))


def interpolate_bucketed(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column, cols: list[str],
                         limit: int, level: Column | None = None, split_rows: int | None = None) -> DataFrame:
    """Limited linear interpolation (as :func:`interpolate_limited`) with the numbering buckets as blocks.

    The dense row number is computed by a window partitioned by (series,
    bucket); the previous / next valid values inside a bucket come from
    windows with that same partitioning (only a re-sort, no new shuffle), and
    across buckets from a small per-bucket carry table. The bucketed rows are stored, so ``df`` is read twice: for
    the cuts and for the rows.
    """
    b = stored(_bucketed(df.withColumns({c: finite_or_null(c) for c in cols}), group_cols, order_cols, bucket, level, split_rows), "buckets")
    keys = ["_gk", "_bk"]
    j = b.join(_offsets(b), keys, "left")
    order = _asc(order_cols)
    x = j.withColumn("_rn", F.col("_off") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def sv(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("r"), F.col(c).alias("v")))

    wp = Window.partitionBy(*keys).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    wn = Window.partitionBy(*keys).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select("*", *[F.last(sv(c), ignorenulls=True).over(wp).alias(f"_p_{c}") for c in cols],
                     *[F.last(sv(c), ignorenulls=True).over(wn).alias(f"_n_{c}") for c in cols])
    # per-bucket first/last valid (rn, value) and the running carry across buckets: small tables
    summ = x.groupBy("_gk", "_lv", "_bk").agg(*[F.max(sv(c)).alias(f"_l_{c}") for c in cols],
                                              *[F.min(sv(c)).alias(f"_f_{c}") for c in cols])
    carry = _carry(summ, "_bk", cols)
    jj = inner.join(carry, keys, "left")
    out = {}
    for c in cols:
        p = F.coalesce(F.col(f"_p_{c}"), F.col(f"_ci_{c}"))
        n = F.coalesce(F.col(f"_n_{c}"), F.col(f"_co_{c}"))
        k = F.col("_rn") - p["r"]
        line = p["v"] + (n["v"] - p["v"]) / (n["r"] - p["r"]).cast("double") * k.cast("double")
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                   .when(p.isNull() | (k > limit), F.lit(None))
                   .when(n.isNull(), p["v"])
                   .otherwise(line))
    return jj.withColumns(out).select(*df.columns)
