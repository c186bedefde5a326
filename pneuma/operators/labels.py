"""Labels, synthetic profile columns and sampling.

Random draws are portable hash draws (``hash_uniform``): deterministic per
row key, identical in SQL engines, and unaffected by partitioning or retries
(a lost executor recomputes the same values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..functions.exprs import hash_uniform
from ..tables import (
    AUGMENT_FRACTION, AUGMENT_MIN, RF_FOLDS, RF_TEST_FRACTION, SEED, SMOKER_RATE, SYNTH_AGE_MAX, SYNTH_AGE_MIN,
    WEAK_LABEL_BANDS, WEAK_LABEL_BASE, WEAK_LABEL_FLIP, WEAK_LABEL_ZONE_BONUS,
)
from . import series


def weak_label_probability(score="ier_score", zone="zone"):
    s = F.col(score)
    p = None
    for thr, v in WEAK_LABEL_BANDS:
        p = F.when(s >= float(thr), F.lit(v)) if p is None else p.when(s >= float(thr), F.lit(v))
    p = p.otherwise(F.lit(WEAK_LABEL_BASE))
    bonus = F.when(F.col(zone).isin("C", "D"), F.lit(WEAK_LABEL_ZONE_BONUS)).otherwise(F.lit(0.0))
    return F.least(F.greatest(p + bonus, F.lit(0.0)), F.lit(1.0))


def weak_labels(df: DataFrame, key: str = "event_id", seed: int = SEED, name: str = "symptom_label") -> DataFrame:
    """Bernoulli(p by index band + 0.15 in zone C/D), then 8 % of labels flipped."""
    p = weak_label_probability("ier_score", "zone") if "zone" in df.columns else \
        weak_label_probability("ier_score", F.lit(None).cast("string"))
    u1 = hash_uniform(key, seed, "label")
    u2 = hash_uniform(key, seed, "flip")
    base = (u1 < p).cast("int")
    lab = F.when(u2 < F.lit(WEAK_LABEL_FLIP), F.lit(1) - base).otherwise(base)
    return df.withColumn("label_p", p).withColumn(name, lab.cast("int"))


def synthetic_profile(df: DataFrame, key: str = "event_id", pathologie: str = "general", seed: int = SEED,
                      label: str = "symptom_label", group: str | None = "station",
                      block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Age 25-69, pathologie, smoker ~ Bernoulli(0.2), symptom_yesterday = previous label in the series."""
    from .features import symptom_lag
    out = df.withColumns({
        "age": (F.lit(SYNTH_AGE_MIN) + F.floor(hash_uniform(key, seed, "age")
                                              * F.lit(SYNTH_AGE_MAX - SYNTH_AGE_MIN + 1))).cast("int"),
        "pathologie": F.lit(pathologie),
        "is_smoker": (hash_uniform(key, seed, "smoker") < F.lit(SMOKER_RATE)).cast("int"),
    })
    return symptom_lag(out, label, group, key, block_rows)


def health_align(df: DataFrame, pathologie: str = "general", key: str = "event_id", seed: int = SEED,
                 bounds=None, block_rows: int = series.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C20: fill the columns the health data lacks, only where absent.

    station constant, index for ``pathologie``, zone from the index, datetime
    2020-MM-15 from month (6 when absent), synthetic profile, previous label
    over the whole table in ``key`` order.
    """
    x = df
    if "station" not in x.columns:
        x = x.withColumn("station", F.lit("kaggle_global"))
    if "ier_score" not in x.columns:
        x = x.withColumn("ier_score", IX.ier_score(pathologie, bounds))
    if "zone" not in x.columns:
        x = x.withColumn("zone", A.zone_from_ier("ier_score"))
    if "datetime" not in x.columns:
        m = F.coalesce(F.col("month"), F.lit(6)) if "month" in x.columns else F.lit(6)
        x = x.withColumn("datetime", F.make_timestamp_ntz(F.lit(2020), m, F.lit(15), F.lit(0), F.lit(0), F.lit(0)))
    adds = {}
    if "age" not in x.columns:
        adds["age"] = (F.lit(SYNTH_AGE_MIN) + F.floor(hash_uniform(key, seed, "age")
                                                     * F.lit(SYNTH_AGE_MAX - SYNTH_AGE_MIN + 1))).cast("int")
    if "pathologie" not in x.columns:
        adds["pathologie"] = F.lit(pathologie)
    if "is_smoker" not in x.columns:
        adds["is_smoker"] = (hash_uniform(key, seed, "smoker") < F.lit(SMOKER_RATE)).cast("int")
    x = x.withColumns(adds)
    if "symptom_yesterday" not in x.columns:
        from .features import symptom_lag
        # one global series in file (key) order, as in the source table
        x = symptom_lag(x.withColumnRenamed("datetime", "_dt"), "symptom_label", None, key, block_rows) \
            .withColumnRenamed("_dt", "datetime")
    return x


def union_sources(*dfs: DataFrame) -> DataFrame:
    """G1: concatenate sources by column name; missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def _permuted(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with the hash draw ``_u`` that orders the permutation and its bucket ``_b``; rows without a key come last."""
    x = df.withColumn("_u", hash_uniform(key, seed, "perm"))
    return x.withColumn("_b", F.coalesce(F.floor(F.col("_u") * F.lit(float(1 << 20))), F.lit(1 << 20)))


def sample_positions(df: DataFrame, key: str, seed: int = SEED, name: str = "_pos") -> DataFrame:
    """Dense position of every row in a hash-random permutation (distributed numbering), and the permutation's bucket ``_b``."""
    level = F.floor(F.col("_b") / F.lit(1 << 10))
    return series.add_row_number(_permuted(df, key, seed), [], ["_u", key], F.col("_b"), name, level).drop("_u")


def augment_global(user_rows: DataFrame, global_rows: DataFrame, user_col: str = "user_id", key: str = "event_id",
                   fraction: float = AUGMENT_FRACTION, minimum: int = AUGMENT_MIN, seed: int = SEED) -> DataFrame:
    """Each user's rows plus a random sample of the global rows, n = max(50, int(0.3 n_user)), capped.

    The global rows get one hash-random permutation; user u takes the run of
    n_u consecutive positions starting at a hash-random offset (mod N). A run
    of a random permutation is a uniform random subset; each user's positions are
    listed and met in one equi-join, whose output is the sample itself. Columns: the
    intersection of both sides, plus ``user_col`` and ``source``.

    The permutation is numbered once, from the keys alone; whole rows are shuffled only of the
    buckets of it that hold a wanted position, and get their positions there again.
    """
    from ..session import stored
    common = [c for c in user_rows.columns if c in global_rows.columns and c != user_col]
    counts = user_rows.groupBy(user_col).agg(F.count(F.lit(1)).alias("_nu"))
    pos = sample_positions(global_rows.select(key), key, seed)
    pos = stored(pos.select("_b", (F.col("_pos") - 1).alias("_p0")), "positions")
    n_glob = pos.agg(F.count(F.lit(1)).alias("_tot"))
    want = F.least(F.greatest(F.lit(minimum), F.floor(F.col("_nu") * F.lit(fraction)).cast("long")), F.col("_tot"))
    start = F.floor(hash_uniform(user_col, seed, "offset") * F.col("_tot")).cast("long")
    runs = counts.crossJoin(F.broadcast(n_glob)).select(user_col, want.alias("_n"), start.alias("_s"), "_tot")
    # one row per wanted position, mod N: exactly the rows that are kept meet in the join
    wanted = runs.filter(F.col("_n") > 0).select(user_col, F.explode(F.sequence(
        F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("_at"), "_tot").select(
        user_col, (F.col("_at") % F.col("_tot")).alias("_p0"))
    buckets = pos.join(wanted.select("_p0").distinct(), "_p0").select("_b").distinct()
    starts = stored(pos.join(buckets, "_b").groupBy("_b").agg(F.min("_p0").alias("_first")), "sampled")
    at = F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy("_u", F.col(key).asc_nulls_last())) - 1
    g = _permuted(global_rows.select(*common), key, seed).join(starts, "_b").withColumn("_p0", at)
    picked = wanted.join(g, "_p0").select(user_col, *common, F.lit("global").alias("source"))
    mine = user_rows.select(user_col, *common, F.lit("user").alias("source"))
    return mine.unionByName(picked)


def stratified_ranks(df: DataFrame, label: str = "symptom_label", key: str = "event_id", seed: int = SEED,
                     group: str | None = None) -> DataFrame:
    """Per-label dense rank of rows in hash order, plus the label's row count; inside each ``group`` if one is named."""
    by = [group, label] if group else [label]
    x = df.withColumn("_u", hash_uniform(key, seed, "split"))
    x = series.add_row_number(x, by, ["_u", key], F.floor(F.col("_u") * F.lit(float(1 << 20))), "_rk")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_nl"))
    return x.join(n if group else F.broadcast(n), by).drop("_u")  # without groups one row per label value


def stratified_split(df: DataFrame, label: str = "symptom_label", key: str = "event_id",
                     test_fraction: float = RF_TEST_FRACTION, seed: int = SEED, group: str | None = None) -> DataFrame:
    """``is_test`` for the first round(0.2 n_label) rows of each label in hash order (of each label in each ``group``)."""
    x = stratified_ranks(df, label, key, seed, group)
    n_test = F.rint(F.col("_nl") * F.lit(test_fraction))
    return x.withColumn("is_test", F.col("_rk") <= n_test).drop("_rk", "_nl")


def stratified_folds(df: DataFrame, label: str = "symptom_label", key: str = "event_id", k: int = RF_FOLDS,
                     seed: int = SEED) -> DataFrame:
    """Fold id 0..k-1 dealt round-robin within each label in hash order."""
    x = stratified_ranks(df, label, key, seed)
    return x.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_rk", "_nl")
