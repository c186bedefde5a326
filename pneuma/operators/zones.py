"""Environmental zones A-D: daily features, scaling, K-Means, assignment, quality.

A zone model is tiny (K centroids x 5 features + scaler): it lives on the
driver as literals, so assignment is a projection (no join, no shuffle) and
works the same on batch and streaming DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions.exprs import decimal_avg, is_finite, rround
from ..tables import CLUSTER_FEATURES, KMEANS_K, KMEANS_MAX_ITER, KMEANS_RESTARTS, SEED, ZONE_NAMES, require_columns
from . import scoring as S


@dataclass
class ZoneModel:
    """Centroids in scaled space, the scaler, and cluster -> zone labels."""
    features: list[str]
    mean: list[float]
    scale: list[float]
    centroids: list[list[float]]  # scaled space, index = cluster id
    labels: dict[int, str] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    bounds: dict | None = None  # learned feature bounds the index was computed with

    def centroids_original(self) -> list[list[float]]:
        return [[c * s + m for c, s, m in zip(cen, self.scale, self.mean)] for cen in self.centroids]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A10: one row per cluster (small table, Parquet-friendly)."""
        rows = [(i, self.labels.get(i, "A"), [float(v) for v in c], [float(v) for v in self.mean],
                 [float(v) for v in self.scale], list(self.features), self.meta.get("k"), self.meta.get("pathologie"),
                 self.meta.get("inertia"), self.meta.get("davies_bouldin"), self.meta.get("silhouette"),
                 None if self.bounds is None else {k: [float(x) for x in v] for k, v in self.bounds.items()})
                for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "cluster_id int, zone string, centroid array<double>, mean array<double>, "
                                           "scale array<double>, features array<string>, k int, pathologie string, "
                                           "inertia double, davies_bouldin double, silhouette double, "
                                           "bounds map<string,array<double>>")

    @staticmethod
    def from_df(df: DataFrame) -> "ZoneModel":
        rows = sorted(df.collect(), key=lambda r: r.cluster_id)  # K rows (bounded by the model size)
        r0 = rows[0]
        meta = {k: r0[k] for k in ("k", "pathologie", "inertia", "davies_bouldin", "silhouette")
                if k in r0.__fields__ and r0[k] is not None}
        bounds = r0.bounds if "bounds" in r0.__fields__ else None
        return ZoneModel(list(r0.features), list(r0.mean), list(r0.scale), [list(r.centroid) for r in rows],
                         {r.cluster_id: r.zone for r in rows}, meta, bounds and {k: tuple(v) for k, v in bounds.items()})

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ZoneModel":
        return ZoneModel.from_df(spark.read.parquet(path))


def daily_station_mean(df: DataFrame, features=CLUSTER_FEATURES) -> DataFrame:
    """Mean of the features per (station, date), when both columns exist; rows with a NULL dropped.

    Means are exact DECIMAL sums divided once, so they do not depend on task order.
    """
    if "datetime" not in df.columns or "station" not in df.columns:
        return df.select(*features).na.drop()
    g = df.groupBy("station", F.to_date("datetime").alias("date"))
    return g.agg(*[decimal_avg(f, 6).alias(f) for f in features]).na.drop(subset=list(features))


def cluster_features(df: DataFrame, pathologie: str = "general", bounds=None) -> DataFrame:
    """H1: index if absent, column check, daily station means, NULL rows dropped."""
    if "ier_score" not in df.columns:
        df = S.ier_batch(df, pathologie, bounds)
    require_columns(df, CLUSTER_FEATURES, "cluster_features")
    return daily_station_mean(df)


def standardize_stats(df: DataFrame, features=CLUSTER_FEATURES) -> DataFrame:
    """H2 statistics: mean and population std per feature (one row); zero std -> scale 1."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std")]
    st = df.agg(*aggs)
    return st.withColumns({f"{f}_scale": F.when(F.col(f"{f}_std") == 0, 1.0).otherwise(F.col(f"{f}_std"))
                           for f in features})


def standardize(df: DataFrame, features=CLUSTER_FEATURES, stats: DataFrame | None = None) -> DataFrame:
    """H2: z-score each feature; the one-row statistics table is broadcast (size 1 row)."""
    st = stats if stats is not None else standardize_stats(df, features)
    j = df.crossJoin(F.broadcast(st.select(*[c for f in features for c in (f"{f}_mean", f"{f}_scale")])))
    return j.withColumns({f"{f}_z": (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_scale") for f in features}) \
            .drop(*[c for f in features for c in (f"{f}_mean", f"{f}_scale")])


def _sq_dists(model: ZoneModel, original_cols=True):
    """Squared distances to each centroid, in scaled space, as Column expressions."""
    out = []
    for cen in model.centroids:
        d = None
        for f, m, s, c in zip(model.features, model.mean, model.scale, cen):
            z = (F.col(f) - F.lit(float(m))) / F.lit(float(s))
            t = (z - F.lit(float(c))) * (z - F.lit(float(c)))
            d = t if d is None else d + t
        out.append(d)
    return out


def zone_assign(df: DataFrame, model: ZoneModel, distances: bool = False) -> DataFrame:
    """H5: nearest centroid -> cluster_id, zone (unknown -> A), label, color, recommendation.

    Ties go to the lowest cluster id. A reading with a NULL, NaN or infinite feature has no
    cluster: cluster_id and zone are NULL. With ``distances`` the rounded Euclidean
    distances to every zone are added in ascending order (F5).
    """
    require_columns(df, model.features, "zone_assign")
    d2 = _sq_dists(model)
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("cid")) for i, d in enumerate(d2)]))
    lab = F.create_map(*[x for i, z in model.labels.items() for x in (F.lit(int(i)), F.lit(z))])
    known = None
    for f in model.features:
        known = is_finite(f) if known is None else known & is_finite(f)
    out = df.withColumn("cluster_id", F.when(known, best["cid"]))
    out = out.withColumn("zone", F.when(F.col("cluster_id").isNotNull(),
                                        F.coalesce(F.element_at(lab, F.col("cluster_id")), F.lit("A"))))
    out = out.withColumns({"zone_label": A.zone_label("zone"), "zone_color": A.zone_color("zone"),
                           "zone_recommendation": A.zone_recommendation("zone")})
    if distances:
        out = out.withColumn("zone_distances", zone_distances_col(model))
    return out


def zone_distances_col(model: ZoneModel):
    """ARRAY<STRUCT<distance, zone>> ascending, distances rounded to 4 digits."""
    d2 = _sq_dists(model)
    return F.sort_array(F.array(*[
        F.struct(rround(F.sqrt(d), 4).alias("distance"),
                 F.lit(model.labels.get(i, str(i))).alias("zone")) for i, d in enumerate(d2)]))


def rank_centroids(centroids: DataFrame, sort_col: str = "ier_score", id_col: str = "cluster_id") -> DataFrame:
    """order the K centroids by their original-scale ``sort_col`` (pm25 if absent) -> A, B, C, D."""
    col = sort_col if sort_col in centroids.columns else "pm25"
    w = Window.orderBy(F.col(col), F.col(id_col))  # K rows: a single small partition is intended
    names = F.array(*[F.lit(z) for z in ZONE_NAMES])
    return centroids.select(id_col, F.element_at(names, F.row_number().over(w).cast("int")).alias("zone"))


def _sum_sq(pairs):
    total = None
    for a, b in pairs:
        t = (a - b) * (a - b)
        total = t if total is None else total + t
    return total


def _sum_products(pairs):
    total = None
    for a, b in pairs:
        t = a * b
        total = t if total is None else total + t
    return total


def cluster_quality(df: DataFrame, model: ZoneModel, assigned: bool = False) -> DataFrame:
    """H6: inertia, Davies-Bouldin index and silhouette of the assignment (one row).

    Inertia sums squared distances to the model centroids; Davies-Bouldin uses
    the means of the assigned points (K rows) as cluster centres. Sums are
    DECIMAL so the numbers do not depend on the plan.
    """
    x = (df if assigned else zone_assign(df, model)).where("cluster_id IS NOT NULL")
    sil = silhouette(x, model, assigned=True)
    d2 = _sq_dists(model)
    own = F.element_at(F.array(*d2), F.col("cluster_id") + 1)
    zcols = {f"_z_{f}": (F.col(f) - F.lit(float(m))) / F.lit(float(s))
             for f, m, s in zip(model.features, model.mean, model.scale)}
    x = x.select("cluster_id", own.alias("_d2"), *[e.alias(k) for k, e in zcols.items()])
    # one pass: per-cluster count, squared-distance sum and centre (K rows)
    per = x.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"),
                                      F.sum(F.col("_d2").cast("decimal(38,6)")).alias("_sd2"),
                                      *[decimal_avg(k, 6).alias(f"_m{k}") for k in zcols])
    inertia = per.agg(F.sum("_sd2").cast("double").alias("inertia"), F.sum("_n").alias("n"))
    means = per.select("cluster_id", *[f"_m{k}" for k in zcols])
    # K-row table of centres: broadcast is bounded by K.
    xm = x.join(F.broadcast(means), "cluster_id")
    dist = F.sqrt(_sum_sq([(F.col(k), F.col(f"_m{k}")) for k in zcols]))
    intra = xm.groupBy("cluster_id").agg(decimal_avg(dist, 6).alias("s"))
    cm = means.join(intra, "cluster_id")
    a, b = cm.alias("a"), cm.alias("b")
    # K x K pairs of centres (K = 4..8): bounded by the model, not the data.
    pairs = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id"))
    mij = F.sqrt(_sum_sq([(F.col(f"a._m{k}"), F.col(f"b._m{k}")) for k in zcols]))
    r = pairs.select(F.col("a.cluster_id").alias("i"),
                     F.when(mij == 0, F.lit(None)).otherwise((F.col("a.s") + F.col("b.s")) / mij).alias("r"))
    db = r.groupBy("i").agg(F.max("r").alias("ri")).agg(decimal_avg("ri", 9).alias("davies_bouldin"))
    return inertia.crossJoin(db).crossJoin(sil).select(
        rround("inertia", 2).alias("inertia"), rround("davies_bouldin", 4).alias("davies_bouldin"), "silhouette", "n")


def fit_kmeans(scaled: DataFrame, k: int = KMEANS_K, restarts: int = KMEANS_RESTARTS,
               max_iter: int = KMEANS_MAX_ITER, seed: int = SEED, features=CLUSTER_FEATURES):
    """H3 core: Spark ML K-Means ``restarts`` times (seeds seed..seed+restarts-1), lowest cost wins.

    ``scaled`` holds the standardized ``<f>_z`` columns; it is cached by the caller.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=[f"{f}_z" for f in features], outputCol="_features").transform(scaled)

    def fit(r):
        km = KMeans(k=k, maxIter=max_iter, seed=seed + r, featuresCol="_features", initMode="k-means||")
        m = km.fit(vec)
        return m.summary.trainingCost, r, m

    # the restarts are independent Spark ML jobs: run them concurrently, keep the lowest cost
    with ThreadPoolExecutor(max_workers=min(restarts, 8)) as ex:
        results = list(ex.map(fit, range(restarts)))
    cost, _, best = min(results, key=lambda t: (t[0], t[1]))
    return best, cost


def train_zones(clean: DataFrame, pathologie: str = "general", bounds=None, k: int = KMEANS_K,
                restarts: int = KMEANS_RESTARTS, max_iter: int = KMEANS_MAX_ITER, seed: int = SEED,
                sweep: list[int] | None = None) -> ZoneModel:
    """Clean rows -> daily features -> scaler -> (optional K sweep) -> K-Means -> zone labels."""
    from ..session import checkpoint
    # daily means are small (stations x days): materialise once, every later pass reads them
    daily = checkpoint(cluster_features(clean, pathologie, bounds))
    zm = train_zones_on(daily, pathologie, k, restarts, max_iter, seed, sweep)
    zm.bounds = dict(bounds) if bounds else None
    return zm


def train_zones_on(daily: DataFrame, pathologie: str = "general", k: int = KMEANS_K, restarts: int = KMEANS_RESTARTS,
                   max_iter: int = KMEANS_MAX_ITER, seed: int = SEED, sweep: list[int] | None = None) -> ZoneModel:
    """The training steps of :func:`train_zones` on daily station features that are already stored."""
    from ..session import checkpoint
    spark = daily.sparkSession
    stats = standardize_stats(daily).collect()[0]  # one row
    mean = [float(stats[f"{f}_mean"]) for f in CLUSTER_FEATURES]
    scale = [float(stats[f"{f}_scale"]) for f in CLUSTER_FEATURES]
    scaled = checkpoint(standardize(daily, CLUSTER_FEATURES))
    meta = {}
    if sweep:
        meta["sweep"] = evaluate_k(scaled, mean, scale, sweep, restarts, max_iter, seed)
    model, cost = fit_kmeans(scaled, k, restarts, max_iter, seed)
    zm = ZoneModel(list(CLUSTER_FEATURES), mean, scale, [list(map(float, c)) for c in model.clusterCenters()])
    orig = zm.centroids_original()
    cen = spark.createDataFrame([(i, *c) for i, c in enumerate(orig)],
                                "cluster_id int, " + ", ".join(f"{f} double" for f in CLUSTER_FEATURES))
    zm.labels = {r.cluster_id: r.zone for r in rank_centroids(cen).collect()}  # K rows
    q = cluster_quality(daily, zm).collect()[0]
    zm.meta = {"inertia": float(cost), "davies_bouldin": q.davies_bouldin, "silhouette": q.silhouette, "k": k,
               "pathologie": pathologie, **meta}
    return zm


def evaluate_k(scaled: DataFrame, mean, scale, ks, restarts: int = KMEANS_RESTARTS,
               max_iter: int = KMEANS_MAX_ITER, seed: int = SEED) -> list[dict]:
    """H4: for each K: inertia, Davies-Bouldin and silhouette over all rows."""
    res = []
    for k in ks:
        m, cost = fit_kmeans(scaled, k, restarts, max_iter, seed)
        zm = ZoneModel(list(CLUSTER_FEATURES), mean, scale, [list(map(float, c)) for c in m.clusterCenters()],
                       {i: str(i) for i in range(k)})
        q = cluster_quality(scaled, zm).collect()[0]
        res.append({"k": k, "inertia": round(float(cost), 2), "davies_bouldin": round(q.davies_bouldin, 4),
                    "silhouette": q.silhouette})
    return res


def best_k(results: list[dict]) -> int:
    """K with the highest silhouette (first on ties)."""
    return max(results, key=lambda r: (r["silhouette"], -r["k"]))["k"]


def silhouette(df: DataFrame, model: ZoneModel, assigned: bool = False) -> DataFrame:
    """Mean silhouette of all assigned rows with squared Euclidean distances on the scaled features (one row).

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and sum of
    squares, so one small aggregate (K rows) and one pass over the rows give the exact value: no
    sample, no pairs. A point alone in its cluster, or a single cluster, counts 0. The aggregate is broadcast: K rows.
    """
    x = (df if assigned else zone_assign(df, model)).where("cluster_id IS NOT NULL")
    z = [f"_z{i}" for i in range(len(model.features))]
    x = x.select("cluster_id", *[((F.col(f) - F.lit(float(m))) / F.lit(float(s))).alias(n)
                                 for n, f, m, s in zip(z, model.features, model.mean, model.scale)])
    norm = _sum_products([(F.col(c), F.col(c)) for c in z])
    per = x.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), decimal_avg(norm, 9).alias("q"),
                                      *[decimal_avg(c, 9).alias(f"m{c}") for c in z])
    all_ = per.agg(F.collect_list(F.struct("cluster_id", "n", "q", *[f"m{c}" for c in z])).alias("_k"))
    y = x.crossJoin(F.broadcast(all_)).withColumn("_q", norm)

    def mean_sq(k):  # mean squared distance to the cluster's points
        d = F.col("_q") + k["q"] - F.lit(2.0) * _sum_products([(F.col(c), k[f"m{c}"]) for c in z])
        return F.greatest(d, F.lit(0.0))

    own = F.filter("_k", lambda k: k["cluster_id"] == F.col("cluster_id"))[0]
    near = F.array_min(F.transform(F.filter("_k", lambda k: k["cluster_id"] != F.col("cluster_id")), mean_sq))
    y = y.select(own["n"].alias("n"), mean_sq(own).alias("own"), near.alias("b"))
    a = F.col("own") * F.col("n") / (F.col("n") - 1)  # the point itself is at distance 0
    top = F.greatest("a", "b")
    s = (y.withColumn("a", F.when(F.col("n") > 1, a))
         .select(F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), 0.0)
                 .otherwise((F.col("b") - F.col("a")) / top).alias("s")))
    return s.agg(rround(decimal_avg("s", 9), 4).alias("silhouette"))


def zone_statistics(df: DataFrame, model: ZoneModel | None = None, features=CLUSTER_FEATURES) -> DataFrame:
    """Per zone, mean / sample std / count of the available features, 3 digits.

    Zones are predicted first when the column is absent.
    """
    x = df if "zone" in df.columns else zone_assign(df, model)
    avail = [f for f in features if f in x.columns]
    aggs = []
    for f in avail:
        aggs += [rround(decimal_avg(f, 6), 3).alias(f"{f}_mean"), rround(F.stddev_samp(f), 3).alias(f"{f}_std"),
                 F.count(f).alias(f"{f}_count")]
    return x.groupBy("zone").agg(*aggs)
