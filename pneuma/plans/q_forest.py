"""Registered queries: forests as node tables (H12, H13, F3, K3) against the same trees spelled out in SQL.

The trees are a small stored forest; the readings, profiles, users and training rows that they score
or are measured on are the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import index as IX
from ..operators import crisis as CR
from ..operators import features as FT
from ..operators import forest_table as NF
from ..sources import views as V
from ..tables import FEATURE_NAMES
from . import sqlfrag as Q
from .catalog import register
from .q_crisis import TRAINING_BODY, _finite_sql, _stored_training
from .q_features import ORDER, SCORED, code_sql, cyc_sql, features_spark, features_sql, hist_sql

#: A stored forest: per tree its nodes (feature, threshold, left, right, share of class 1); leaves have no feature.
TREES = [
    [("pm25", 35.0, 1, 2, None), ("ier_max_24h", 40.0, 3, 4, None), ("co", 22.5, 5, 6, None),
     (None, None, -1, -1, 0.05), (None, None, -1, -1, 0.35), ("age", 52.0, 7, 8, None), (None, None, -1, -1, 0.91),
     (None, None, -1, -1, 0.48), (None, None, -1, -1, 0.77)],
    [("zone_risk_score", 2.0, 1, 2, None), ("humidity_mean_24h", 51.0, 3, 4, None), ("symptom_yesterday", 0.5, 5, 6, None),
     (None, None, -1, -1, 0.12), (None, None, -1, -1, 0.27), (None, None, -1, -1, 0.55), (None, None, -1, -1, 0.86)],
    [("is_smoker", 0.5, 1, 2, None), ("pm25_mean_24h", 48.0, 3, 4, None), ("ier_score", 38.5, 5, 6, None),
     (None, None, -1, -1, 0.18), (None, None, -1, -1, 0.52), (None, None, -1, -1, 0.41), (None, None, -1, -1, 0.83)],
    [("hour_cos", 0.0, 1, 2, None), (None, None, -1, -1, 0.33), ("temperature", 5.0, 3, 4, None),
     (None, None, -1, -1, 0.62), (None, None, -1, -1, 0.24)],
]
NAME = "rf_stored"
DEPTH = 3
#: Importances that the stored forest's meta names.
IMPORTANCES = {"pm25": 0.31, "ier_max_24h": 0.17, "zone_risk_score": 0.16, "ier_score": 0.12, "pm25_mean_24h": 0.09, "co": 0.06,
               "is_smoker": 0.05, "age": 0.04}


def fixture(spark) -> NF.NodeForest:
    return NF.NodeForest(NAME, NF.literal_nodes(spark, TREES, NAME), DEPTH, [(f, IMPORTANCES.get(f, 0.0)) for f in FEATURE_NAMES])


def _tree_sql(tree, node: int = 0, shift: str = "") -> str:
    f, threshold, left, right, p = tree[node]
    if f is None:
        return Q.lit(p)
    return f"CASE WHEN {f} <= {Q.lit(threshold)}{shift} THEN {_tree_sql(tree, left, shift)} ELSE {_tree_sql(tree, right, shift)} END"


def forest_sql(shift: str = "") -> str:
    return "((" + " + ".join(["0.0E0", *(f"({_tree_sql(t, 0, shift)})" for t in TREES)]) + f") / {len(TREES)}.0E0)"


def _out_sql(p: str) -> str:
    return f"{Q.rround(p, 4)} AS proba_crisis, {Q.crisis_level(p)} AS alert_level, ({p}) >= 0.4E0 AS should_notify"


@register("crisis_batch_forest", V.with_views(
    f"SELECT event_id, {_out_sql('p')} FROM (SELECT event_id, {forest_sql()} AS p FROM ({features_sql(SCORED)}) f) t",
    "measurements", "profiles"))
def q_crisis_batch_forest(spark, sf):
    """H12 with a stored forest, walked by a Column expression over every reading's features."""
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    out = CR.crisis_batch(features_spark(m, V.profiles(spark, sf)), fixture(spark))
    return out.select("event_id", "proba_crisis", "alert_level", "should_notify")


_TOP = sorted(((v, -FEATURE_NAMES.index(f), f) for f, v in IMPORTANCES.items()), reverse=True)[:5]
CRISIS_FOREST_SQL = V.with_views(f"""
SELECT event_id, n_invalid, n_invalid = 0 AS is_valid, {Q.rround('p', 4)} AS proba_crisis, lv AS alert_level,
  {Q.crisis_color('lv')} AS alert_color, p >= 0.4E0 AS should_notify, {Q.crisis_message('p', 'lv', "coalesce(pathologie, 'general')")} AS message,
  '{NAME}' AS model_used, pm25_mean_24h, ier_max_24h,
  {', '.join(f"'{f}' AS top{i}_feature, {Q.lit(v)} AS top{i}_importance, {Q.rround(f, 3)} AS top{i}_value" for i, (v, _, f) in enumerate(_TOP, 1))}
FROM (SELECT *, {Q.crisis_level('p')} AS lv FROM (
  SELECT *, {forest_sql()} AS p,
    CAST(len([x FOR x IN [{', '.join(f"CASE WHEN NOT {_finite_sql(f)} THEN 1 END" for f in FEATURE_NAMES)}] IF x IS NOT NULL]) AS INTEGER) AS n_invalid
  FROM (SELECT event_id, pm25, co, humidity, temperature, ier_score, pathologie,
          CAST({Q.zone_risk('zone')} AS DOUBLE) AS zone_risk_score, {cyc_sql('hour(datetime)', 'month(datetime)')}, {hist_sql(ORDER)},
          CAST(COALESCE(own_age, 35) AS DOUBLE) AS age, CAST({code_sql('pathologie')} AS DOUBLE) AS pathologie_encoded,
          CAST(COALESCE(CAST(smoker AS INTEGER), 0) AS DOUBLE) AS is_smoker,
          CAST(COALESCE(CAST(yesterday AS INTEGER), 0) AS DOUBLE) AS symptom_yesterday
        FROM (SELECT a.*, {Q.zone_from_ier('ier_score * 1.3E0')} AS zone, p.age AS own_age, p.pathologie, p.is_smoker AS smoker,
                p.symptom_yesterday AS yesterday
              FROM (SELECT *, {Q.score('asthme')} AS ier_score FROM measurements) a LEFT JOIN profiles p USING (user_id)) b) c) d) e""",
                                 "measurements", "profiles")


def crisis_columns(out):
    """The scored readings with their contributors side by side."""
    top = [x for i in range(1, 6) for x in (
        F.col("top_contributors")[i - 1]["feature"].alias(f"top{i}_feature"), F.col("top_contributors")[i - 1]["importance"].alias(f"top{i}_importance"),
        F.col("top_contributors")[i - 1]["value"].alias(f"top{i}_value"))]
    return out.select("event_id", F.size("invalid_features").alias("n_invalid"), "is_valid", "proba_crisis", "alert_level", "alert_color",
                      "should_notify", "message", "model_used", "pm25_mean_24h", "ier_max_24h", *top)


@register("crisis_realtime_forest", CRISIS_FOREST_SQL)
def q_crisis_realtime_forest(spark, sf):
    """H13 through a model: realtime features with the user's profile, a stored forest, message and top contributors."""
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score("asthme"))
    m = m.withColumn("zone", A.zone_from_ier(F.col("ier_score") * 1.3))
    return crisis_columns(CR.crisis_realtime(FT.with_profile(FT.with_history(m), V.profiles(spark, sf)), fixture(spark)))


# --- H12 with the lookup chain: user forest, else global forest -----------------------------------------------------

def user_forests(spark, sf):
    """Nodes of a forest per user with an odd number: the stored trees with thresholds that depend on the user."""
    users = V.measurements(spark, sf).select("user_id").distinct().where("user_id % 2 = 1")
    names = [x.split()[0] for x in NF.NODES.split(", ")][1:]
    nodes = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r)]) for r in NF.literal_rows(TREES)])
    every = users.select("user_id", F.inline(nodes.cast("array<struct<" + NF.NODES.split(", ", 1)[1].replace(" ", ":").replace(",:", ",") + ">>")))
    return every.select(F.concat(F.lit("rf_user_"), F.col("user_id").cast("string")).alias("model_name"), "tree", "node", "feature",
                        (F.col("threshold") + F.col("user_id") % 5).alias("threshold"), "left", "right", "p", "gain", "n")


@register("crisis_batch_routed_stored", V.with_views(f"""
SELECT event_id, user_id, CASE WHEN user_id % 2 = 1 THEN 'rf_user_' || user_id ELSE '{NAME}' END AS model_used, {_out_sql('p')}
FROM (SELECT f.event_id, m.user_id, CASE WHEN m.user_id % 2 = 1 THEN {forest_sql(' + m.user_id % 5')} ELSE {forest_sql()} END AS p
      FROM ({features_sql(SCORED)}) f JOIN (SELECT event_id, user_id FROM measurements) m USING (event_id)) t""", "measurements", "profiles"))
def q_crisis_batch_routed_stored(spark, sf):
    """Each reading through its user's forest, else the global one; nodes are joined by the user and walked."""
    m = V.measurements(spark, sf).withColumn("ier_score", IX.ier_score())
    x = FT.features_batch(FT.profile_join(m.withColumn("zone", A.zone_from_ier("ier_score")), V.profiles(spark, sf)), keep=("event_id", "user_id"))
    out = CR.crisis_batch_routed(x, user_forests(spark, sf), fixture(spark))
    return out.select("event_id", "user_id", "model_used", "proba_crisis", "alert_level", "should_notify")


# --- F3: importances of a stored forest over the training rows ----------------------------------------------------------

def _paths(tree, node: int = 0, cond: str = "true"):
    """(node, condition under which a row passes it) of every node."""
    yield node, cond
    f, threshold, left, right, _ = tree[node]
    if f is not None:
        yield from _paths(tree, left, f"{cond} AND {f} <= {Q.lit(threshold)}")
        yield from _paths(tree, right, f"{cond} AND {f} > {Q.lit(threshold)}")


def _passed_sql() -> str:
    cols = ", ".join(f"count_if({c}) AS n_{t}_{i}, coalesce(sum(symptom_label) FILTER (WHERE {c}), 0)::BIGINT AS p_{t}_{i}"
                     for t, tree in enumerate(TREES) for i, c in _paths(tree))
    rows = " UNION ALL ".join(
        f"SELECT {t} AS tree, {i} AS node, {Q.q(node[0]) if node[0] else 'NULL'} AS feature, n_{t}_{i}::BIGINT AS n, p_{t}_{i} AS positives, "
        + (", ".join(f"n_{t}_{node[k]}::BIGINT AS n{k}, p_{t}_{node[k]} AS p{k}" for k in (2, 3)) if node[0] else
           "NULL::BIGINT AS n2, NULL::BIGINT AS p2, NULL::BIGINT AS n3, NULL::BIGINT AS p3") + " FROM c"
        for t, tree in enumerate(TREES) for i, node in enumerate(tree))
    return f"c AS (SELECT {cols} FROM train), r AS ({rows})"


def _gini_sql(n: str, p: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN 2.0E0 * ({p}::DOUBLE / {n}) * (1.0E0 - {p}::DOUBLE / {n}) ELSE 0.0E0 END)"


GAINS_SQL = (f"g AS (SELECT *, CASE WHEN feature IS NOT NULL AND n > 0 THEN {_gini_sql('n', 'positives')} - "
             f"(0 + n2 * {_gini_sql('n2', 'p2')} + n3 * {_gini_sql('n3', 'p3')}) / n END AS gain FROM r)")


def _train_sql(select: str) -> str:
    return V.with_views(f"WITH train AS ({TRAINING_BODY}), {_passed_sql()}, {GAINS_SQL}{select}", "measurements")


@register("forest_gains", _train_sql("\nSELECT tree::INTEGER AS tree, node::INTEGER AS node, n, positives, round(gain, 12) AS gain FROM g"))
def q_forest_gains(spark, sf):
    """the training rows that pass each node of the stored forest, their labels and the Gini gain of its test."""
    g = NF.with_gains(_stored_training(spark, sf), fixture(spark))
    return g.select("tree", "node", "n", "positives", F.round("gain", 12).alias("gain"))


@register("top_features_stored", _train_sql(f"""
, t AS (SELECT tree, feature, sum(gain * n) AS g FROM g WHERE feature IS NOT NULL GROUP BY tree, feature),
s AS (SELECT feature, sum(g / w) AS v FROM t JOIN (SELECT tree, sum(g) AS w FROM t GROUP BY tree) USING (tree) WHERE w > 0 GROUP BY feature),
o AS (SELECT feature, v / (SELECT sum(v) FROM s) AS importance FROM s),
e AS (SELECT f.feature, f.idx, coalesce(importance, 0.0E0) AS importance
      FROM (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(FEATURE_NAMES))}) f(feature, idx) LEFT JOIN o USING (feature))
SELECT feature, round_even(importance * 10000.0E0, 0) / 10000.0E0 AS importance FROM e ORDER BY importance DESC, idx LIMIT 8""".lstrip()))
def q_top_features_stored(spark, sf):
    """the 8 most important features of the stored forest, by the gains of its tests over all training rows."""
    f = fixture(spark)
    f.nodes, f.given = NF.with_gains(_stored_training(spark, sf), f), None
    return CR.top_features(spark, f, 8)
