"""Fixed lookup values, schemas and column checks.

Everything under "FIXED VALUES" must stay equal to the behaviour being
reproduced (index weights, level ranges, zone texts, bounds, codes,
thresholds); results depend on them literally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Index weights per pathologie, features in scoring order.
IER_FEATURES = ["pm25", "co", "humidity", "temperature"]
IER_WEIGHTS = {
    "asthme": {"pm25": 0.40, "co": 0.25, "humidity": 0.20, "temperature": 0.15},
    "rhinite": {"pm25": 0.30, "co": 0.20, "humidity": 0.35, "temperature": 0.15},
    "bronchite": {"pm25": 0.35, "co": 0.30, "humidity": 0.20, "temperature": 0.15},
    "general": {"pm25": 0.30, "co": 0.25, "humidity": 0.25, "temperature": 0.20},
}

# Risk levels: inclusive integer ranges (gaps between them fall to the last level).
RISK_LEVELS = [
    (0, 25, "Faible", "#2ecc71", "Aucune action requise"),
    (26, 50, "Modéré", "#f39c12", "Aérer si possible"),
    (51, 75, "Élevé", "#e67e22", "Réduire l'exposition"),
    (76, 100, "Critique", "#e74c3c", "Alerte + précautions urgentes"),
]

# Default normalisation bounds (feature -> min, max).
DEFAULT_BOUNDS = {
    "pm25": (0.0, 500.0),
    "co": (0.0, 50.0),
    "humidity": (0.0, 100.0),
    "temperature": (-30.0, 50.0),
}

# Zone descriptions.
ZONE_INFO = [
    ("A", "Saine", "Air propre, humidité normale", "Sport autorisé", "#2ecc71", 1),
    ("B", "Modérée", "Pollution légère, ventilation correcte", "Surveillance conseillée", "#f39c12", 2),
    ("C", "Risquée", "PM2.5 élevé, CO2 fort", "Éviter l'activité physique", "#e67e22", 3),
    ("D", "Critique", "Pollution forte + humidité élevée", "Alerte urgente — rester à l'intérieur", "#e74c3c", 4),
]
ZONE_RISK = {"A": 1, "B": 2, "C": 3, "D": 4}

# Pathologie codes for the crisis model (copd has a code but no index weights).
PATHOLOGIE_CODES = {"asthme": 0, "rhinite": 1, "bronchite": 2, "copd": 3, "general": 4}
PATHOLOGIE_DEFAULT_CODE = 4

# Crisis probability -> alert level, colour.
ALERT_THRESHOLDS = [
    ("CRITIQUE", 0.80, "#e74c3c"),
    ("ELEVE", 0.60, "#e67e22"),
    ("MODERE", 0.40, "#f39c12"),
    ("FAIBLE", 0.0, "#2ecc71"),
]

# Crisis model feature order (20 features).
FEATURE_NAMES = [
    "pm25", "co", "humidity", "temperature",
    "ier_score", "zone_risk_score",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "pm25_mean_24h", "co_mean_24h", "humidity_mean_24h",
    "pm25_max_24h", "co_max_24h", "ier_max_24h",
    "age", "pathologie_encoded", "is_smoker", "symptom_yesterday",
]

# Physical limits of the cleaned station data (inclusive), in check order.
STATION_LIMITS = [
    ("pm25", 0.0, 999.0),
    ("co", 0.0, 10000.0),
    ("temperature", -30.0, 50.0),
    ("humidity", 0.0, 100.0),
]
STATION_FEATURES = ["pm25", "co", "temperature", "humidity"]

# Physical limits of the health data (inclusive).
HEALTH_LIMITS = [
    ("pm25", 0.0, 999.0),
    ("co", 0.0, 50000.0),
    ("temperature", -30.0, 55.0),
    ("humidity", 0.0, 100.0),
    ("aqi", 0.0, 500.0),
]
# Health CSV: source columns kept, their canonical names, required columns.
HEALTH_KEEP = ["date", "PM2.5", "CO", "temperature", "humidity", "AQI",
               "population_density", "respiratory_admissions"]
HEALTH_RENAME = {"PM2.5": "pm25", "CO": "co", "AQI": "aqi"}
HEALTH_REQUIRED = ["PM2.5", "CO", "temperature", "humidity", "respiratory_admissions"]
HEALTH_FEATURES = ["pm25", "co", "temperature", "humidity", "aqi",
                   "population_density", "month", "day_of_week"]

# Raw station CSV: columns read, renames, columns dropped after datetime build.
STATION_KEEP = ["No", "year", "month", "day", "hour", "PM2.5", "CO", "TEMP", "DEWP", "station"]
STATION_RENAME = {"PM2.5": "pm25", "CO": "co", "TEMP": "temperature", "DEWP": "dewpoint"}
STATION_DROP = ["No", "year", "month", "day", "hour",
                "PM10", "SO2", "NO2", "O3", "PRES", "RAIN", "wd", "WSPM"]
EXPECTED_STATIONS = [
    "Aotizhongxin", "Changping", "Dingling", "Dongsi",
    "Guanyuan", "Gucheng", "Huairou", "Nongzhanguan",
    "Shunyi", "Tiantan", "Wanliu", "Wanshouxigong",
]

# Magnus formula constants for relative humidity.
MAGNUS_A = 17.625
MAGNUS_B = 243.04

# Interpolation limits (rows).
STATION_INTERP_LIMIT = 24
HEALTH_INTERP_LIMIT = 5

# Rolling window length (rows) for the 24h features.
ROLLING_ROWS = 24

# Clustering: features, K, seed, restarts, iterations, sweep, silhouette sample.
CLUSTER_FEATURES = ["pm25", "co", "humidity", "temperature", "ier_score"]
ZONE_NAMES = ["A", "B", "C", "D"]
KMEANS_K = 4
SEED = 42
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
KMEANS_SWEEP = list(range(2, 9))

# Random forest parameters.
RF_TREES = 200
RF_MAX_DEPTH = 12
RF_MIN_LEAF = 5
RF_TEST_FRACTION = 0.20
RF_FOLDS = 5
RF_CV_MIN_ROWS = 200

# Retraining thresholds.
MIN_SAMPLES_USER = 30
RETRAIN_EVERY_N = 10
AUGMENT_FRACTION = 0.3
AUGMENT_MIN = 50

# Weak labels: probability by index band, zone bonus, flip rate.
WEAK_LABEL_BANDS = [(76, 0.90), (51, 0.55), (26, 0.20)]
WEAK_LABEL_BASE = 0.05
WEAK_LABEL_ZONE_BONUS = 0.15
WEAK_LABEL_FLIP = 0.08
SMOKER_RATE = 0.20
SYNTH_AGE_MIN = 25
SYNTH_AGE_MAX = 69

# Crisis heuristic: probability by index band, bonuses.
CRISIS_BANDS = [(76, 0.88), (51, 0.55), (26, 0.22)]
CRISIS_BASE = 0.06
CRISIS_ZONE_BONUS = 0.15
CRISIS_SYMPTOM_BONUS = 0.10

# Alert rule on the index.
ALERT_IER_MIN = 51
ALERT_HIGH_ZONES = ["C", "D"]

# Default profile.
DEFAULT_AGE = 35
DEFAULT_PATHOLOGIE = "general"

# Crisis messages per level ({p} pathologie, {pct} truncated percent).
CRISIS_MESSAGES = {
    "CRITIQUE": "Risque de crise {p} tres eleve ({pct}%). Evitez toute exposition et prenez vos medicaments preventifs.",
    "ELEVE": "Risque de crise {p} eleve ({pct}%). Reduisez votre activite physique et surveillez vos symptomes.",
    "MODERE": "Risque modere ({pct}%). Aerez les espaces interieurs et restez attentif.",
    "FAIBLE": "Risque faible ({pct}%). Conditions acceptables pour votre sante respiratoire.",
}

# Index alert messages ({s} score with one digit, {z} zone, {a} action, {r} recommendation).
ALERT_MESSAGES = {
    "URGENT": "⚠ Alerte critique — IER={s} | Zone {z}. {a}. {r}.",
    "AVERTISSEMENT": "Attention — IER={s} | Zone {z}. {a}.",
    "INFO": "Air acceptable — IER={s} | Zone {z}. {a}.",
}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

HISTORY_TYPE = T.ArrayType(T.StructType([
    T.StructField("pm25", T.DoubleType()),
    T.StructField("co", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("ier_score", T.DoubleType()),
]))

LABELED_SCHEMA = T.StructType(
    [T.StructField("user_id", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURE_NAMES]
    + [T.StructField("symptom_label", T.IntegerType()),
       T.StructField("timestamp", T.TimestampNTZType())]
)


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    """Raise ValueError listing the columns of ``cols`` absent from ``df`` (no job runs)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns in {what}: {missing}")
