"""Crisis-probability model: training set, Random Forest, scoring.

Training uses Spark ML (distributed trees over a cached feature table);
scoring is ``model.transform`` plus Column expressions for levels and
messages, so it runs unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions.exprs import rround
from ..tables import (
    FEATURE_NAMES, MIN_SAMPLES_USER, RF_CV_MIN_ROWS, RF_FOLDS, RF_MAX_DEPTH, RF_MIN_LEAF, RF_TREES, SEED,
)
from . import features as FT
from . import grow as G
from . import labels as L
from . import metrics as MT
from . import scoring as S
from . import series
from .forest_table import NODES, NodeForest, arrays, grown_nodes, mean


#: Rows of a series that one task's windows take in a training set: many more blocks than cores in a large table.
TRAINING_BLOCK_ROWS = 1 << 16
#: Rows of a user that one task holds whole; the forest of a user with more is grown as a global one is, in the same way.
USER_ROWS = 1 << 18
#: Readings of a user that meet the user's forest in one task.
ROUTED_ROWS = 1 << 16
#: Nodes of the forests that are grown at the same time, as the driver holds them.
NODES_AT_ONCE = 1 << 21


@dataclass
class CrisisModel:
    model: object  # pyspark.ml.classification.RandomForestClassificationModel
    name: str
    meta: dict = field(default_factory=dict)

    def importances(self) -> list[tuple[str, float]]:
        imp = self.model.featureImportances.toArray()
        return [(f, float(v)) for f, v in zip(FEATURE_NAMES, imp)]

    def save(self, path: str, spark=None) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        from pyspark.sql import SparkSession
        spark = spark or SparkSession.getActiveSession()
        meta_df(spark, self).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "CrisisModel":
        from pyspark.ml.classification import RandomForestClassificationModel
        m = RandomForestClassificationModel.load(f"{path}/model")
        meta = spark.read.parquet(f"{path}/meta").collect()[0].asDict()  # one row
        return CrisisModel(m, meta["model_name"], meta)


def training_set(spark, source: str, stations: DataFrame | None = None, health: DataFrame | None = None,
                 labeled: DataFrame | None = None, pathologie: str = "general",
                 block_rows: int = TRAINING_BLOCK_ROWS) -> DataFrame:
    """H9: (event_id/key, 20 features, symptom_label) with non-finite rows removed.

    source 'health': cleaned health data (P2) aligned with synthetic profile
    columns (C20); 'labeled': stored survey features (Q7: used as stored);
    'synthetic': scored station rows with weak labels (C19) and a synthetic
    profile (C21). The fallback chain health -> synthetic is decided by which
    inputs are given.
    """
    if source == "labeled" and labeled is not None:
        x = labeled
        return FT.finite_mask(x.select(*[c for c in ("user_id", "event_id") if c in x.columns],
                                       *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in x.columns
                                         else F.lit(0.0).alias(f) for f in FEATURE_NAMES], "symptom_label"))
    if source in ("health", "kaggle") and health is not None:
        from ..session import stored  # the numbering of each series reads its input three times
        h = stored(L.health_align(stored(health, "health"), pathologie, block_rows=block_rows), "aligned")
        feats = FT.features_batch(h, keep=("event_id",), group="station", block_rows=block_rows)
        return FT.finite_mask(feats)
    if stations is None:
        raise ValueError("no input for the training set")
    x = stations if "ier_score" in stations.columns else S.ier_batch(stations, pathologie)
    if "zone" not in x.columns:
        x = x.withColumn("zone", A.zone_from_ier("ier_score"))
    x = L.weak_labels(x)
    x = FT.add_series_rn(x)  # one row numbering serves the symptom lag and the rolling features
    x = L.synthetic_profile(x, pathologie=pathologie, block_rows=block_rows)
    return FT.finite_mask(FT.features_batch(x, keep=("event_id",), block_rows=block_rows))


def training_set_by_path(spark, source: str = "health", raw_dir: str | None = None, processed: str | None = None,
                         labeled: str | None = None, pathologie: str = "general") -> tuple[DataFrame, str]:
    """H9 with the fallback by what the paths hold: the training rows and the source that was used.

    'labeled' falls back to 'health', and that to 'synthetic': the labeled table with a row, the first health file below
    ``raw_dir`` (in the order of its lines), the processed station table. None of them is an error.
    """
    from ..session import stored
    from ..sources import files as FS
    from .clean import health_pipeline
    from .labeled import LabeledTable
    chain = ["labeled", "health", "synthetic"]
    for s in chain[chain.index("health" if source == "kaggle" else source):]:
        if s == "labeled" and labeled:
            rows = LabeledTable(spark, labeled).load()
            if not rows.isEmpty():
                return training_set(spark, "labeled", labeled=rows), s
        if s == "health" and raw_dir:
            found = FS.discover_health_csv(spark, raw_dir)
            if found:
                h = stored(FS.load_health_csv(spark, found[0]).withColumn("event_id", F.monotonically_increasing_id()), "health")
                return training_set(spark, "health", health=health_pipeline(h), pathologie=pathologie), s
        if s == "synthetic" and processed:
            try:
                rows = FS.load_processed(spark, processed)
            except FileNotFoundError:
                continue
            if "event_id" not in rows.columns:
                rows = stored(rows.withColumn("event_id", F.monotonically_increasing_id()), "stations")
            return training_set(spark, "synthetic", stations=rows, pathologie=pathologie), s
    raise FileNotFoundError(f"no input for a training set: {source} (labeled: {labeled}, raw: {raw_dir}, processed: {processed})")


def _assemble(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features", handleInvalid="error").transform(df)


def _forest(num_trees: int = RF_TREES, max_depth: int = RF_MAX_DEPTH, seed: int = SEED):
    from pyspark.ml.classification import RandomForestClassifier
    return RandomForestClassifier(featuresCol="features", labelCol="symptom_label", weightCol="weight",
                                  numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=RF_MIN_LEAF,
                                  featureSubsetStrategy="sqrt", maxBins=G.BINS, seed=seed)


def fit_forest(df: DataFrame, rows: int, forest, at_once: int = 1) -> DataFrame:
    """Nodes of what ``forest`` (of ``_forest``) names, on ``df`` (``rows`` rows; features, label, weight), grown tree by tree and stored."""
    from ..session import scratch_path, stored
    path = scratch_path(df.sparkSession, "binned")
    return stored(G.forest_nodes(df, rows, path, forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed(), at_once), "grown")


def ml_model(nodes: DataFrame, forest):
    """The Spark ML model of grown nodes."""
    from pyspark.ml.classification import RandomForestClassificationModel

    from ..session import scratch_path
    path = scratch_path(nodes.sparkSession, "model")
    G.write_model(nodes, path, forest, forest.getNumTrees())
    return RandomForestClassificationModel.load(path)


def scored_test(nodes: DataFrame, test: DataFrame, max_depth: int) -> DataFrame:
    """symptom_label, proba_crisis and prediction of the test rows by grown nodes, as the Spark ML model of them gives; scored once."""
    from ..session import stored
    p = NodeForest("", grown_nodes(nodes, ""), max_depth).score(test, "proba_crisis")
    return stored(p.select("symptom_label", "proba_crisis", (F.col("proba_crisis") > 0.5).cast("double").alias("prediction")), "tested")


def fits_at_once(spark, rows: int, num_trees: int, max_depth: int, wanted: int) -> int:
    """How many forests over so many rows are grown at the same time, by the cores and by the nodes that the driver then holds."""
    nodes = num_trees * min(2 ** (max_depth + 1), max(1, 2 * rows // RF_MIN_LEAF))
    return max(1, min(wanted, spark.sparkContext.defaultParallelism, NODES_AT_ONCE // nodes))


def probability_col(df: DataFrame, name: str = "proba_crisis") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(name, vector_to_array("probability")[1])


def evaluate(pred: DataFrame) -> dict:
    """AUC (exact, D14) and F1 of class 1 (D13) on a scored test set."""
    auc = MT.auc_roc(pred.select(F.col("symptom_label").alias("label"), F.col("proba_crisis").alias("score"))) \
            .collect()[0].auc_roc
    rep = {r["class"]: r for r in MT.classification_report(
        pred.select(F.col("symptom_label").alias("label"), F.col("prediction").alias("prediction"))).collect()}
    return {"auc_roc": float(auc) if auc is not None else None, "f1_score": float(rep["1"]["f1"])}


def rf_train(train_set: DataFrame, user_id: str | None = None, cross_validate: bool = True,
             num_trees: int = RF_TREES, max_depth: int = RF_MAX_DEPTH, seed: int = SEED) -> CrisisModel:
    """H10 (+H11): stratified 80/20 split, balanced class weights, forest, test metrics, importances.

    Needs at least 30 rows. Cross-validation (5 stratified folds) runs when
    the training part has at least 200 rows.
    """
    from ..session import checkpoint
    n = train_set.count()
    if n < MIN_SAMPLES_USER:
        raise ValueError(f"not enough rows: {n} < {MIN_SAMPLES_USER}")
    key = "event_id" if "event_id" in train_set.columns else None
    if key is None:  # a key from the data: equal rows are told apart by a rank, so no row moves when recomputed
        h = F.xxhash64(*[F.col(c) for c in sorted(train_set.columns)])
        train_set = train_set.withColumn("_h", h).withColumn(
            "event_id", F.xxhash64("_h", F.row_number().over(Window.partitionBy("_h").orderBy("_h")))).drop("_h")
    base = train_set
    split = L.stratified_split(base, "symptom_label", "event_id")
    split = checkpoint(_assemble(MT.with_class_weight(split, "symptom_label")))
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    meta = {}
    n_train = train.count()
    forest = _forest(num_trees, max_depth, seed)
    nodes = fit_forest(train, n_train, forest)
    if cross_validate and n_train >= RF_CV_MIN_ROWS:
        meta.update(cross_validate_forest(train, num_trees, max_depth, seed))
    meta.update(evaluate(scored_test(nodes, test, forest.getMaxDepth())))
    pos = base.agg(F.avg(F.col("symptom_label").cast("double"))).collect()[0][0]
    name = f"rf_user_{user_id}" if user_id is not None else "rf_global"
    meta.update({"model_name": name, "user_id": None if user_id is None else str(user_id), "n_samples": int(n),
                 "n_train": n_train, "positive_rate": round(float(pos or 0.0), 4), "n_features": len(FEATURE_NAMES),
                 "timestamp": _dt.datetime.now()})
    return CrisisModel(ml_model(nodes, forest), name, meta)


def cross_validate_forest(train: DataFrame, num_trees: int, max_depth: int, seed: int) -> dict:
    """5 stratified folds (G4) -> mean and std of AUC and F1; as many folds at once as the driver's memory for nodes allows."""
    import statistics
    from concurrent.futures import ThreadPoolExecutor

    from ..session import checkpoint
    folds = checkpoint(_assemble(L.stratified_folds(train.drop("features"), "symptom_label", "event_id", RF_FOLDS)))
    spark = folds.sparkSession
    n = folds.count()
    at_once = fits_at_once(spark, n, num_trees, max_depth, RF_FOLDS)

    def one(k):
        tr = folds.filter(F.col("fold") != k)
        te = folds.filter(F.col("fold") == k)
        forest = _forest(num_trees, max_depth, seed)
        return evaluate(scored_test(fit_forest(tr, n, forest, at_once), te, forest.getMaxDepth()))

    with ThreadPoolExecutor(at_once) as pool:
        res = list(pool.map(one, range(RF_FOLDS)))
    aucs = [r["auc_roc"] or 0.0 for r in res]
    f1s = [r["f1_score"] for r in res]
    return {"n_folds": len(res), "cv_auc_mean": statistics.fmean(aucs), "cv_auc_std": statistics.pstdev(aucs),
            "cv_f1_mean": statistics.fmean(f1s), "cv_f1_std": statistics.pstdev(f1s)}


META_SCHEMA = ("model_name string, user_id string, n_samples long, n_user_samples long, auc_roc double, f1_score double, "
               "positive_rate double, cv_auc_mean double, cv_auc_std double, cv_f1_mean double, cv_f1_std double, "
               "n_features int, feature_names array<string>, n_trees int, max_depth int, timestamp timestamp_ntz")


def meta_df(spark, model: CrisisModel) -> DataFrame:
    """One row with everything a reader of the saved model needs to know."""
    m = model.meta
    return spark.createDataFrame(
        [(m.get("model_name"), m.get("user_id"), m.get("n_samples"), m.get("n_user_samples", m.get("n_samples")),
          m.get("auc_roc"), m.get("f1_score"), m.get("positive_rate"), m.get("cv_auc_mean"), m.get("cv_auc_std"),
          m.get("cv_f1_mean"), m.get("cv_f1_std"), len(FEATURE_NAMES), list(FEATURE_NAMES),
          int(model.model.getNumTrees), int(model.model.getMaxDepth()), m.get("timestamp"))], META_SCHEMA)


def top_features(spark, model: CrisisModel, n: int = 8) -> DataFrame:
    """the ``n`` most important features (importance 4 digits), ties by feature order."""
    rows = [(i, f, v) for i, (f, v) in enumerate(model.importances())]
    df = spark.createDataFrame(rows, "idx int, feature string, importance double")
    return df.orderBy(F.desc("importance"), "idx").limit(n).select("feature", rround("importance", 4).alias("importance"))


def crisis_batch(df: DataFrame, model: CrisisModel | NodeForest | None = None) -> DataFrame:
    """proba_crisis (4 digits), alert_level (on the unrounded probability), should_notify.

    Without a model: the index heuristic (C17) on ``ier_score``.
    """
    if model is None:
        p = A.crisis_heuristic_base("ier_score")
        return df.withColumns({"proba_crisis": p, "alert_level": A.crisis_alert_level(p),
                               "should_notify": A.crisis_notify(p)})
    return _scored(df, model).withColumns({"proba_crisis": rround("_p", 4), "alert_level": A.crisis_alert_level("_p"),
                                           "should_notify": A.crisis_notify("_p")}).drop("_p")


def _scored(df: DataFrame, model: CrisisModel | NodeForest) -> DataFrame:
    """``df`` with the unrounded probability ``_p`` of a Spark ML forest or of a node table."""
    if isinstance(model, NodeForest):
        return model.score(df, "_p")
    return probability_col(model.model.transform(_assemble(df)), "_p").drop("features", "rawPrediction", "probability", "prediction")


def crisis_realtime(df: DataFrame, model: CrisisModel | NodeForest | None = None, top_n: int = 5,
                    pathologie_col: str | None = "pathologie") -> DataFrame:
    """Per reading: features (H8), validity (B10), probability, level, colour, notify, message, top contributors.

    Without a model the heuristic (C18: zone and previous-day symptom bonuses)
    is used and the message names the 'general' pathologie.
    """
    feats = FT.features_realtime(df, keep=[c for c in df.columns if c not in FEATURE_NAMES])
    x = FT.feature_validity(feats)
    path = F.col(pathologie_col) if pathologie_col and pathologie_col in df.columns else F.lit("general")
    if model is None:
        zone = F.col("zone") if "zone" in df.columns else F.lit("A")
        p = A.crisis_heuristic_single("ier_score", zone, "symptom_yesterday")
        x = x.withColumn("proba_crisis", p).withColumn("model_used", F.lit("heuristic_fallback"))
        lvl = A.crisis_alert_level("proba_crisis")
        return x.withColumns({"alert_level": lvl, "alert_color": A.crisis_alert_color(lvl),
                              "should_notify": A.crisis_notify("proba_crisis"),
                              "message": A.crisis_message("proba_crisis", lvl, F.lit("general"))})
    x = _scored(x.withColumn("_path", path), model)
    lvl = A.crisis_alert_level("_p")
    imp = sorted([(v, -i, f) for i, (f, v) in enumerate(model.importances())], reverse=True)[:top_n]
    top = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(round(v, 4)).alias("importance"),
                             rround(F.col(f), 3).alias("value")) for v, _, f in imp])
    out = x.withColumns({"proba_crisis": rround("_p", 4), "alert_level": lvl, "alert_color": A.crisis_alert_color(lvl),
                         "should_notify": A.crisis_notify("_p"), "message": A.crisis_message("_p", lvl, "_path"),
                         "model_used": F.lit(model.name), "top_contributors": top})
    return FT.feature_map(out).drop("_p", "_path")


@dataclass
class RetrainResult:
    """What a retraining did: the decision with its reason, and the model if there is one."""
    user_id: object
    retrained: bool
    reason: str
    n_user_samples: int = 0
    model: CrisisModel | None = None


def retrain_user(labeled_user: DataFrame, global_rows: DataFrame | None, user_id, last_count: int | None = None,
                 has_model: bool = False, force: bool = False, num_trees: int = RF_TREES, seed: int = SEED) -> RetrainResult:
    """Decide (I1, or ``force``), then user rows (+ global sample with weak labels, G2) -> clean -> forest.

    ``last_count`` is the number of the user's rows at the last training (None: no meta).
    """
    from ..session import stored
    from .retrain import should_retrain
    spark = labeled_user.sparkSession
    mine = labeled_user.withColumn("user_id", F.lit(user_id))
    known = spark.createDataFrame([(user_id, last_count, last_count is not None)] if has_model else [],
                                  f"user_id {dict(mine.dtypes)['user_id']}, n_user_samples long, has_meta boolean")
    row = should_retrain(mine, known).first()
    if row is None:
        return RetrainResult(user_id, False, "no rows")
    if not row.retrain and not force:
        return RetrainResult(user_id, False, row.reason, int(row.n_samples))
    x = labeled_user
    if global_rows is not None:
        x = L.augment_global(mine, global_rows).drop("source")
    # stored features as stored (Q7); absent ones default to 0.0 as in the labeled projection. A user's own row and
    # the same reading in the sample may share an id: they are different training rows.
    x = stored(training_set(spark, "labeled", labeled=x).drop("user_id"), "retrain_rows")  # the fit's steps read it many times
    if x.count() < MIN_SAMPLES_USER:
        return RetrainResult(user_id, False, row.reason, int(row.n_samples))
    m = rf_train(x, user_id=user_id, num_trees=num_trees, seed=seed)
    m.meta["n_user_samples"] = int(row.n_samples)
    return RetrainResult(user_id, True, row.reason, int(row.n_samples), m)


def retrain_all(labeled: DataFrame, models: DataFrame, global_rows: DataFrame | None = None, force: bool = False,
                num_trees: int = RF_TREES, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decide for every user (I1), then fit each due user's forest.

    What comes before and after the fits (the cleaned rows, their split and weights, the test scores) is one job for all users, and so
    are the fits: a task grows the forests of its users one after the other, each from the user's own rows (``grow.fit_user``).
    ``labeled``: stored survey features (user_id, event_id, features, symptom_label). Returns the decisions, one meta row per
    fitted model and the nodes of all fitted forests, three tables; the driver holds the ids of the due users.
    """
    from ..session import checkpoint, scratch_path, ship, stored
    from .retrain import should_retrain, user_bucket
    spark = labeled.sparkSession
    decisions = checkpoint(should_retrain(labeled, models))
    due = decisions.filter(F.lit(force) | F.col("retrain")).select("user_id")
    rows = labeled.join(due, "user_id", "left_semi")
    counts = {r["user_id"]: int(r["n_samples"]) for r in decisions.join(due, "user_id", "left_semi").select("user_id", "n_samples").toLocalIterator()}
    if global_rows is not None:
        rows = L.augment_global(rows, global_rows).drop("source")
    base = scratch_path(spark, "retrain")
    kind = dict(rows.dtypes)["user_id"]
    x = stored(training_set(spark, "labeled", labeled=rows), "retrain_rows")
    per = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("symptom_label").cast("double")).alias("_pos"))
    for r in per.where(F.col("n_samples") < MIN_SAMPLES_USER).limit(1).collect():
        raise ValueError(f"not enough rows: {r['n_samples']} < {MIN_SAMPLES_USER}")
    if "event_id" not in x.columns:  # a key from the data, as in ``rf_train``
        x = x.withColumn("_h", F.xxhash64(*[F.col(c) for c in sorted(x.columns) if c != "user_id"]))
        x = x.withColumn("event_id", F.xxhash64("_h", F.row_number().over(Window.partitionBy("user_id", "_h").orderBy("_h")))).drop("_h")
    x = MT.with_class_weight(L.stratified_split(x, "symptom_label", "event_id", group="user_id"), "symptom_label", group="user_id")
    x = x.withColumn("_bucket", user_bucket(F.col("user_id")))
    x.write.partitionBy("_bucket").parquet(f"{base}/rows")
    # the users that rows are left of, as rf_train is only called for those
    sizes = {r["user_id"]: int(r["n_samples"]) for r in per.select("user_id", "n_samples").toLocalIterator()}
    if set(counts) - set(sizes):
        raise ValueError(f"not enough rows: 0 < {MIN_SAMPLES_USER}")

    if not counts:
        return decisions, spark.createDataFrame([], META_SCHEMA), spark.createDataFrame([], NODES)
    ship(spark)
    x = spark.read.schema(x.schema).parquet(f"{base}/rows")
    large = sorted(u for u, n in sizes.items() if n > USER_ROWS)
    columns = ["user_id", "event_id", *FEATURE_NAMES, "symptom_label", "weight", "is_test"]
    schema = G.user_schema(kind)

    # what each due user's fit is to be: trees, depth, seed
    named = {u: (f.getNumTrees(), f.getMaxDepth(), f.getSeed()) for u in sizes for f in (_forest(num_trees, seed=seed),)}

    def fit(key, table):
        user = key[0].as_py()
        return G.fit_user(table, user, *named[user])

    tasks = max(1, min(len(sizes), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    mine = x.where(~F.col("user_id").isin(large)) if large else x
    mine.select(*columns).repartition(tasks, "user_id").groupBy("user_id").applyInArrow(fit, schema).write.parquet(f"{base}/fits/small")
    for i, user in enumerate(large):
        own = x.where((F.col("_bucket") == user_bucket(F.lit(user))) & (F.col("user_id") == F.lit(user)))
        nodes = stored(G.forest_nodes(own.where(~F.col("is_test")), sizes[user], f"{base}/large/{i}", *named[user]), "nodes")
        test = NodeForest("", grown_nodes(nodes, ""), RF_MAX_DEPTH).score(own.where(F.col("is_test")), "score")
        grown = nodes.withColumns({"is_node": F.lit(True), "label": F.lit(None).cast("int"), "score": F.lit(None).cast("double")})
        grown.unionByName(test.select(F.lit(False).alias("is_node"), F.col("symptom_label").cast("int").alias("label"), "score"), allowMissingColumns=True) \
            .withColumn("user_id", F.lit(user).cast(kind)).write.parquet(f"{base}/fits/large{i}")
    fits = spark.read.schema(schema).parquet(f"{base}/fits/small", *[f"{base}/fits/large{i}" for i in range(len(large))])
    scores = fits.where(~F.col("is_node")).select("user_id", "label", "score", (F.col("score") > 0.5).cast("double").alias("prediction"))
    known = decisions.join(due, "user_id", "left_semi").select("user_id", F.col("n_samples").alias("n_user_samples"))
    meta = per.join(known, "user_id").join(MT.scores_by(scores, "user_id"), "user_id", "left").withColumns({
        "model_name": F.concat(F.lit("rf_user_"), F.col("user_id").cast("string")), "user_id": F.col("user_id").cast("string"),
        "positive_rate": rround(F.coalesce("_pos", F.lit(0.0)), 4), "n_features": F.lit(len(FEATURE_NAMES)),
        "feature_names": F.array(*[F.lit(f) for f in FEATURE_NAMES]), "n_trees": F.lit(num_trees), "max_depth": F.lit(RF_MAX_DEPTH),
        "timestamp": F.lit(_dt.datetime.now()).cast("timestamp_ntz"),
        **{c: F.lit(None).cast("double") for c in ("cv_auc_mean", "cv_auc_std", "cv_f1_mean", "cv_f1_std")}})
    fields = [f.strip().split(" ") for f in META_SCHEMA.split(", ")]
    meta = stored(meta.select(*[F.col(f).cast(t).alias(f) for f, t in fields]), "retrain_meta")
    name = F.concat(F.lit("rf_user_"), F.col("user_id").cast("string"))
    return decisions, meta, grown_nodes(fits.where("is_node"), name)


def crisis_batch_routed(readings: DataFrame, user_nodes: DataFrame, global_model: NodeForest | None = None) -> DataFrame:
    """H12 with the lookup chain: the reading's user model, else the global forest, else the index heuristic.

    ``user_nodes``: nodes of the models named ``rf_user_<id>``. Adds proba_crisis, alert_level, should_notify and model_used
    to every reading (user_id, the 20 features); every row stays one row, whatever its ids. The models are joined
    by the user, so a reading meets its own forest and no other.
    """
    from ..session import ship
    ship(readings.sparkSession)
    # A user's readings are dealt to parts of about ROUTED_ROWS, each of which gets the user's nodes.
    own = F.concat(F.lit("rf_user_"), F.col("user_id").cast("string"))
    counts = readings.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROUTED_ROWS)
    parts = counts.select(own.alias("_name"), F.ceil(F.col("_n") / F.lit(ROUTED_ROWS)).cast("int").alias("_parts"))  # a row per 2^16 readings at most
    known = user_nodes.select(F.col("model_name").alias("_name")).distinct().join(parts, "_name", "left").select(
        F.col("_name").alias("_own"), F.coalesce("_parts", F.lit(1)).alias("_parts"))
    draw = F.xxhash64(*[c for c in (*FEATURE_NAMES, "event_id") if c in readings.columns])
    # Readings without a forest of their own user are spread by themselves.
    x = readings.withColumn("_name", own).join(known, F.col("_name") == F.col("_own"), "left").withColumn(
        "_part", F.pmod(draw, F.coalesce(F.col("_parts"), F.lit(1 << 10)).cast("long")).cast("int")).drop("_name", "_parts")
    nodes = user_nodes.select(F.col("model_name").alias("_name"), "tree", "node", "feature", "threshold", "left", "right", "p").join(
        parts, "_name", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    def score(key, rows, forest):
        import pyarrow as pa
        import pyarrow.compute as pc
        if not rows.num_rows or not forest.num_rows:
            p = pa.nulls(rows.num_rows, pa.float64())
        else:
            p = mean(arrays(forest), [pc.cast(rows.column(f), "float64") for f in FEATURE_NAMES], RF_MAX_DEPTH)
        return rows.drop_columns(["_part"]).append_column("_q", p)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema)
    x = x.groupBy("_own", "_part").cogroup(nodes.groupBy("_name", "_part")).applyInArrow(score, f"{fields}, _own string, _q double")
    x = x.withColumnRenamed("_own", "_used")
    if global_model is not None:
        x = global_model.score(x, "_g").withColumns({"_q": F.coalesce("_q", "_g"), "_used": F.coalesce("_used", F.lit(global_model.name))})
    x = x.withColumns({"_q": F.coalesce(F.col("_q"), A.crisis_heuristic_base("ier_score")),
                       "model_used": F.coalesce(F.col("_used"), F.lit("heuristic_fallback"))})
    return x.withColumns({"proba_crisis": rround("_q", 4), "alert_level": A.crisis_alert_level("_q"),
                          "should_notify": A.crisis_notify("_q")}).drop("_q", "_g", "_used")
