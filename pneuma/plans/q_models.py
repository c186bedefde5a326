"""Registered queries: zones and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import index as IX
from ..functions.exprs import decimal_avg, rround
from ..operators import zones as Z
from ..sources import views as V
from ..tables import CLUSTER_FEATURES, IER_FEATURES, IER_WEIGHTS
from . import sqlfrag as Q
from .catalog import register

SCORED = f"(SELECT *, {Q.score()} AS ier_score FROM measurements)"

# Fixed zone model for the checkable assignment queries: the fixture centroids
# (original scale) with a fixed scaler.
FIX_MEAN = [50.0, 25.0, 50.0, 10.0, 35.0]
FIX_SCALE = [60.0, 15.0, 30.0, 12.0, 20.0]


def fixture_model() -> Z.ZoneModel:
    cents = [[(v - m) / s for v, m, s in zip(row[2:], FIX_MEAN, FIX_SCALE)] for row in V.ZONE_CENTROIDS]
    return Z.ZoneModel(list(CLUSTER_FEATURES), FIX_MEAN, FIX_SCALE, cents,
                       {row[0]: row[1] for row in V.ZONE_CENTROIDS})


def _sql_sq_dists(model: Z.ZoneModel, prefix: str = "") -> list[str]:
    out = []
    for cen in model.centroids:
        terms = []
        for f, m, s, c in zip(model.features, model.mean, model.scale, cen):
            z = f"(({prefix}{f} - {Q.lit(m)}) / {Q.lit(s)})"
            terms.append(f"(({z} - {Q.lit(c)}) * ({z} - {Q.lit(c)}))")
        out.append(" + ".join(terms))
    return out


def _sql_argmin(ds: list[str]) -> str:
    n = len(ds)
    whens = []
    for i in range(n - 1):
        conds = " AND ".join(f"d{i} <= d{j}" for j in range(i + 1, n))
        whens.append(f"WHEN {conds} THEN {i}")
    return f"(CASE WHEN d0 IS NULL THEN NULL {' '.join(whens)} ELSE {n - 1} END)"


def _zone_of(model, cid="cluster_id"):
    parts = " ".join(f"WHEN {i} THEN '{z}'" for i, z in model.labels.items())
    return f"CASE WHEN {cid} IS NOT NULL THEN COALESCE(CASE {cid} {parts} END, 'A') END"


DAILY_SQL = f"""(SELECT station, CAST(datetime AS DATE) AS date,
       {', '.join(f'{Q.decimal_avg(f, 6)} AS {f}' for f in CLUSTER_FEATURES)}
FROM {SCORED} s GROUP BY station, CAST(datetime AS DATE))"""
DAILY_NN = f"(SELECT * FROM {DAILY_SQL} d0 WHERE {' AND '.join(f'{f} IS NOT NULL' for f in CLUSTER_FEATURES)})"


DAILY_OUT = f"SELECT station, CAST(date AS VARCHAR) AS date, {', '.join(CLUSTER_FEATURES)} FROM {DAILY_NN} t"


def _date_str(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register("daily_station_mean", V.with_views(DAILY_OUT, "measurements"))
def q_daily(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    return _date_str(Z.daily_station_mean(m))


@register("cluster_features", V.with_views(DAILY_OUT, "measurements"))
def q_cluster_features(spark, sf):
    return _date_str(Z.cluster_features(V.measurements(spark, sf)))


@register("standardize", V.with_views(f"""
SELECT station, CAST(date AS VARCHAR) AS date, {', '.join(
    Q.rround(f"({f} - m_{f}) / (CASE WHEN s_{f} = 0 THEN 1.0E0 ELSE s_{f} END)", 6) + f' AS {f}_z'
    for f in CLUSTER_FEATURES)}
FROM {DAILY_NN} d CROSS JOIN (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}'
                                                 for f in CLUSTER_FEATURES)} FROM {DAILY_NN} d2) st""",
                                      "measurements"))
def q_standardize(spark, sf):
    d = Z.cluster_features(V.measurements(spark, sf))
    s = Z.standardize(d)
    return _date_str(s).select("station", "date", *[rround(f"{f}_z", 6).alias(f"{f}_z") for f in CLUSTER_FEATURES])


def _assign_sql(src: str, keep: str, model: Z.ZoneModel) -> str:
    ds = _sql_sq_dists(model)
    return f"""(SELECT *, {_zone_of(model)} AS zone FROM (
  SELECT {keep}, {_sql_argmin(ds)} AS cluster_id, d0, d1, d2, d3 FROM (
    SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(ds))} FROM {src} s) a) b)"""


FIX = fixture_model()


@register("zone_assign", V.with_views(f"""
SELECT event_id, cluster_id, zone, {Q.zone_field('zone', 1)} AS zone_label, {Q.zone_field('zone', 4)} AS zone_color,
       {Q.zone_field('zone', 3)} AS zone_recommendation
FROM {_assign_sql(SCORED, 'event_id', FIX)} t""", "measurements"))
def q_zone_assign(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    out = Z.zone_assign(m, FIX)
    return out.select("event_id", "cluster_id", "zone", "zone_label", "zone_color", "zone_recommendation")


def _dist_sql():
    labs = [FIX.labels[i] for i in range(len(FIX.centroids))]
    items = ", ".join(f"{{'distance': {Q.rround(f'sqrt(d{i})', 4)}, 'zone': '{z}'}}" for i, z in enumerate(labs))
    sel = ", ".join(f"s[{k + 1}].zone AS zone_{k + 1}, s[{k + 1}].distance AS distance_{k + 1}" for k in range(len(labs)))
    return f"SELECT event_id, {sel} FROM (SELECT event_id, list_sort([{items}]) AS s FROM {_assign_sql(SCORED, 'event_id', FIX)} t) u"


@register("zone_distances", V.with_views(_dist_sql(), "measurements"))
def q_zone_distances(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    out = m.select("event_id", Z.zone_distances_col(FIX).alias("s"))
    cols = []
    for k in range(len(FIX.centroids)):
        cols += [F.col("s")[k]["zone"].alias(f"zone_{k + 1}"), F.col("s")[k]["distance"].alias(f"distance_{k + 1}")]
    return out.select("event_id", *cols)




@register("rank_centroids", V.with_views(f"""
SELECT cluster_id, zone, {Q.rround('ier_score', 4)} AS ier_score FROM (
  SELECT cluster_id, ier_score,
         CASE row_number() OVER (ORDER BY ier_score, cluster_id) WHEN 1 THEN 'A' WHEN 2 THEN 'B'
              WHEN 3 THEN 'C' WHEN 4 THEN 'D' END AS zone
  FROM (SELECT CAST(substr(station, 9) AS INTEGER) % 4 AS cluster_id,
               {Q.decimal_avg('ier_score', 6)} AS ier_score
        FROM {DAILY_NN} a GROUP BY CAST(substr(station, 9) AS INTEGER) % 4) b) c""",
                                         "measurements"))
def q_rank_centroids(spark, sf):
    d = Z.cluster_features(V.measurements(spark, sf))
    cid = F.substring("station", 9, 8).cast("int") % 4
    cen = d.groupBy(cid.alias("cluster_id")).agg(decimal_avg("ier_score", 6).alias("ier_score"))
    r = Z.rank_centroids(cen)
    return r.join(cen, "cluster_id").select("cluster_id", "zone", rround("ier_score", 4).alias("ier_score"))


def _quality_sql(model: Z.ZoneModel) -> str:
    ds = _sql_sq_dists(model)
    zs = ", ".join(f"(({f} - {Q.lit(m)}) / {Q.lit(s)}) AS z{i}"
                   for i, (f, m, s) in enumerate(zip(model.features, model.mean, model.scale)))
    nf = len(model.features)
    own = "CASE cluster_id " + " ".join(f"WHEN {i} THEN d{i}" for i in range(len(ds))) + " END"
    sq = " + ".join(f"((z{i} - m{i}) * (z{i} - m{i}))" for i in range(nf))
    sqab = " + ".join(f"((a.m{i} - b.m{i}) * (a.m{i} - b.m{i}))" for i in range(nf))
    return f"""
WITH z AS (SELECT {_sql_argmin([f'd{i}' for i in range(len(ds))])} AS cluster_id, * FROM (
             SELECT {', '.join(f'{d} AS d{i}' for i, d in enumerate(ds))}, {zs} FROM {DAILY_NN} d) a),
x AS (SELECT cluster_id, {own} AS d2, {', '.join(f'z{i}' for i in range(nf))} FROM z),
means AS (SELECT cluster_id, {', '.join(f'{Q.decimal_avg(f"z{i}", 6)} AS m{i}' for i in range(nf))}
          FROM x GROUP BY cluster_id),
intra AS (SELECT x.cluster_id, {Q.decimal_avg(f'sqrt({sq})', 6)} AS s FROM x JOIN means USING (cluster_id)
          GROUP BY x.cluster_id),
cm AS (SELECT * FROM means JOIN intra USING (cluster_id)),
sq AS (SELECT cluster_id, count(*) AS n, {Q.decimal_avg(' + '.join(f'z{i} * z{i}' for i in range(nf)), 9)} AS q,
              {', '.join(f'{Q.decimal_avg(f"z{i}", 9)} AS m{i}' for i in range(nf))} FROM x GROUP BY cluster_id),
xn AS (SELECT *, row_number() OVER () AS rid FROM x),
sd AS (SELECT xn.rid, xn.cluster_id, k.cluster_id AS other, k.n,
              greatest({' + '.join(f'xn.z{i} * xn.z{i}' for i in range(nf))} + k.q - 2.0E0 * ({' + '.join(f'xn.z{i} * k.m{i}' for i in range(nf))}), 0E0) AS d
       FROM xn CROSS JOIN sq k),
sp AS (SELECT rid, max(CASE WHEN other = cluster_id AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN other <> cluster_id THEN d END) AS b
       FROM sd GROUP BY rid),
sl AS (SELECT CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0E0 ELSE (b - a) / greatest(a, b) END AS s FROM sp),
r AS (SELECT a.cluster_id AS i, max(CASE WHEN sqrt({sqab}) = 0 THEN NULL ELSE (a.s + b.s) / sqrt({sqab}) END) AS ri
      FROM cm a JOIN cm b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)
SELECT {Q.rround('CAST(sum(CAST(d2 AS DECIMAL(38,6))) AS DOUBLE)', 2)} AS inertia,
       (SELECT {Q.rround(Q.decimal_avg('ri', 9), 4)} FROM r) AS davies_bouldin,
       (SELECT {Q.rround(Q.decimal_avg('s', 9), 4)} FROM sl) AS silhouette, count(*) AS n FROM x"""


@register("cluster_quality", V.with_views(_quality_sql(FIX), "measurements"))
def q_cluster_quality(spark, sf):
    from ..session import checkpoint
    # the daily table is small (stations x days): materialised once for the quality passes
    d = checkpoint(Z.cluster_features(V.measurements(spark, sf)))
    return Z.cluster_quality(d, FIX)


@register("zone_statistics", V.with_views(f"""
SELECT zone, {', '.join(
    f"{Q.rround(Q.decimal_avg(f, 6), 3)} AS {f}_mean, {Q.rround(f'stddev_samp({f})', 3)} AS {f}_std, "
    f"count({f}) AS {f}_count" for f in CLUSTER_FEATURES)}
FROM {_assign_sql(SCORED, 'event_id, ' + ', '.join(CLUSTER_FEATURES), FIX)} t GROUP BY zone""", "measurements"))
def q_zone_statistics(spark, sf):
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    return Z.zone_statistics(m, FIX)


@register("kmeans_train", V.with_views(f"""
SELECT z.zone, true AS has_rows, true AS rises, (SELECT count(*) FROM {DAILY_NN} d) AS n_rows, true AS is_mean
FROM (VALUES ('A'), ('B'), ('C'), ('D')) z(zone)""", "measurements"))
def q_kmeans_train(spark, sf):
    """Zone model trained on the daily station features: clusters that hold rows, zones in index order, and centres that are
    the means of the rows nearest to them, as at the end of Lloyd's iterations."""
    from ..session import checkpoint
    daily = checkpoint(Z.cluster_features(V.measurements(spark, sf)))
    zm = Z.train_zones_on(daily)
    off = None  # largest distance between a centre and the mean of its rows, in standard deviations
    for i, f in enumerate(zm.features):
        own = F.element_at(F.array(*[F.lit(float(c[i])) for c in zm.centroids]), F.first("cluster_id") + 1)
        d = F.abs(F.avg((F.col(f) - F.lit(zm.mean[i])) / F.lit(zm.scale[i])) - own)
        off = d if off is None else F.greatest(off, d)
    per = Z.zone_assign(daily, zm).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), decimal_avg("ier_score", 6).alias("m"),
                                                       (off < 0.01).alias("is_mean"))
    order = Window.orderBy("zone")  # K rows
    per = per.withColumns({"rises": F.coalesce(F.col("m") >= F.lag("m").over(order), F.lit(True)),
                           "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    return per.select("zone", (F.col("n") > 0).alias("has_rows"), "rises", F.col("total").alias("n_rows"), "is_mean")


@register("evaluate_k", V.with_views(f"""
SELECT k::INTEGER AS k, (SELECT count(*) FROM {DAILY_NN} d) AS n_rows, true AS silhouette_ok, true AS inertia_falls,
       1::BIGINT AS n_best, true AS best_is_highest FROM range(2, 9) r(k)""", "measurements"))
def q_evaluate_k(spark, sf):
    """K sweep 2..8: silhouettes in range, inertia falling with K, one best K and it has the highest silhouette."""
    from ..session import checkpoint
    from ..tables import KMEANS_SWEEP
    daily = Z.cluster_features(V.measurements(spark, sf))
    st = Z.standardize_stats(daily).collect()[0]
    mean = [float(st[f"{f}_mean"]) for f in CLUSTER_FEATURES]
    scale = [float(st[f"{f}_scale"]) for f in CLUSTER_FEATURES]
    scaled = checkpoint(Z.standardize(daily))
    res = Z.evaluate_k(scaled, mean, scale, KMEANS_SWEEP)
    bk = Z.best_k(res)
    df = spark.createDataFrame([(r["k"], r["inertia"], r["silhouette"], r["k"] == bk) for r in res],
                               "k int, inertia double, silhouette double, best boolean")
    every = Window.partitionBy(F.lit(0))  # seven rows
    return df.crossJoin(scaled.agg(F.count(F.lit(1)).alias("n_rows"))).select(
        "k", "n_rows", F.col("silhouette").between(-1.0, 1.0).alias("silhouette_ok"),
        F.coalesce(F.col("inertia") <= F.lag("inertia").over(Window.orderBy("k")), F.lit(True)).alias("inertia_falls"),
        F.count_if("best").over(every).alias("n_best"),
        (F.max(F.when(F.col("best"), F.col("silhouette"))).over(every) >= F.max("silhouette").over(every)).alias("best_is_highest"))


@register("run_batch_model", V.with_views(f"""
SELECT event_id, ier_score, cluster_id, zone FROM {_assign_sql(SCORED, 'event_id, ier_score', FIX)} t""", "measurements"))
def q_run_batch_model(spark, sf):
    """P3 with a zone model: index details, then nearest centroid."""
    from .pipelines import run_batch
    m = V.measurements(spark, sf).select("event_id", *[f for f in CLUSTER_FEATURES if f != "ier_score"])
    return run_batch(m, "general", zone_model=FIX).select("event_id", "ier_score", "cluster_id", "zone")


def _learned_sql() -> str:
    terms = " + ".join(f"{Q.lit(IER_WEIGHTS['asthme'][f])} * (CASE WHEN hi_{f} = lo_{f} THEN 0E0 ELSE "
                       f"least(greatest(({f} - lo_{f}) / (hi_{f} - lo_{f}) * 100.0E0, 0E0), 100.0E0) END)" for f in IER_FEATURES)
    return f"""
WITH b AS (SELECT {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in IER_FEATURES)} FROM measurements)
SELECT event_id, ier_score, {Q.zone_from_ier('ier_score')} AS zone FROM (
  SELECT event_id, {Q.rround(f'least(greatest({terms}, 0E0), 100.0E0)', 2)} AS ier_score FROM measurements CROSS JOIN b) t"""


@register("run_batch_learned_bounds", V.with_views(_learned_sql(), "measurements"))
def q_run_batch_learned(spark, sf):
    """Bounds learned from the table (A9, one small row per feature) carried into the index and the batch."""
    from ..operators import profile as PR
    from .pipelines import run_batch
    m = V.measurements(spark, sf)
    bounds = {r.feature: (r.min, r.max) for r in PR.feature_bounds(m).collect()}  # four rows
    return run_batch(m, "asthme", bounds=bounds).select("event_id", "ier_score", "zone")
