"""Fixed values. Results depend on them, so they are stated once, here."""

# Clinical bounds in mg/dL
SEVERE_HYPO_BELOW = 54.0
HYPO_BELOW = 70.0
HYPER_ABOVE = 180.0
SEVERE_HYPER_ABOVE = 250.0

# Zone name -> (critical, message)
ZONES = {
    "severe_hypoglycemia": (True, "CRITICAL: Severe hypoglycemia. Immediate action required."),
    "hypoglycemia": (True, "WARNING: Hypoglycemia detected. Carbohydrate intake recommended."),
    "normal": (False, "OK: Glucose within target range."),
    "hyperglycemia": (False, "WARNING: Hyperglycemia detected. Monitor closely."),
    "severe_hyperglycemia": (
        True,
        "CRITICAL: Severe hyperglycemia. Medical attention may be required.",
    ),
}

# Glucose management indicator: GMI % = intercept + slope * mean glucose (Bergenstal 2018)
GMI_INTERCEPT = 3.31
GMI_SLOPE = 0.02392

# Coefficient of variation below this percentage counts as stable
CV_STABLE_BELOW = 36.0

# Time-in-range bands, percent
TIR_GOOD_FROM = 70.0
TIR_FAIR_FROM = 50.0

# Accepted readings, mg/dL, both ends included
VALID_MIN = 0.0
VALID_MAX = 600.0

UNITS = "mg/dL"

# CSV export
CSV_GLUCOSE_HEADER = "Sensor Glucose (mg/dL)"
CSV_DATE_HEADER = "Date"
CSV_TIME_HEADER = "Time"
CSV_CELL_LIMIT = 131_072  # characters; a longer cell rejects its file
CSV_BROKEN_HEADER = "header without date or time"
CSV_TOO_LONG = "cell or row too long"
SENTINELS = {"Low": 39.0, "High": 401.0}

# Feature table
CADENCE_SECONDS = 300
FILL_LIMIT = 3
ROLLING_ROWS = 12
SPLITS = ("training", "testing")
FEATURES = (
    "glucose_mg_dl",
    "glucose_delta_1",
    "glucose_delta_3",
    "bolus_last_1h",
    "basal_rate",
    "carbs_last_1h",
    "hour_sin",
    "hour_cos",
    "is_hypo",
    "is_hyper",
)
HISTOGRAM_BINS = 60

# Latest-readings window, hours
MIN_HOURS = 1
MAX_HOURS = 168
DEFAULT_HOURS = 24
VIEW_HOURS = (24, 72, 168)
REFRESH_INTERVAL = "5 minutes"
