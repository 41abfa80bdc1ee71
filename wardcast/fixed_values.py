"""Names, thresholds and messages the results have to agree on."""

# Required columns of a training panel (23) and of a scoring request (18).
TRAINING_COLUMNS = [
    "date", "city", "city_id", "hospital_id", "hospital_id_enc", "admissions",
    "lag_1_admissions", "lag_7_admissions", "rolling_14_admissions",
    "aqi", "temp", "humidity", "rainfall", "wind_speed",
    "mobility_index", "outbreak_index", "festival_flag", "holiday_flag",
    "weekday", "is_weekend", "population_density", "hospital_beds", "staff_count",
]
REQUEST_COLUMNS = [
    "date", "admissions", "aqi", "temp", "humidity", "rainfall", "wind_speed",
    "mobility_index", "outbreak_index", "festival_flag", "holiday_flag",
    "weekday", "is_weekend", "population_density", "hospital_beds", "staff_count",
    "city_id", "hospital_id_enc",
]

# Model inputs in their fixed order: 19 base, 8 calendar, 4 air quality, 10 interactions.
BASE_FEATURES = [
    "lag_1_admissions", "lag_7_admissions", "rolling_14_admissions",
    "aqi", "temp", "humidity", "rainfall", "wind_speed",
    "mobility_index", "outbreak_index", "festival_flag", "holiday_flag",
    "weekday", "is_weekend", "population_density", "hospital_beds", "staff_count",
    "city_id", "hospital_id_enc",
]
CALENDAR_FEATURES = [
    "month", "week_of_year", "quarter", "season",
    "day_sin", "day_cos", "month_sin", "month_cos",
]
AIR_FEATURES = ["aqi_above_150", "aqi_above_200", "aqi_above_300", "aqi_severity"]
INTERACTION_FEATURES = [
    "temp_humidity", "rainfall_injury_risk", "aqi_respiratory_ratio", "aqi_temp",
    "mobility_outbreak", "temp_rainfall", "aqi_mobility",
    "lag1_aqi", "lag7_outbreak", "rolling_aqi",
]
FEATURES = BASE_FEATURES + CALENDAR_FEATURES + AIR_FEATURES + INTERACTION_FEATURES

# Columns that stay as they are when continuous features are standardised.
UNSCALED_FEATURES = [
    "festival_flag", "holiday_flag", "is_weekend",
    "aqi_above_150", "aqi_above_200", "aqi_above_300",
    "city_id", "hospital_id_enc", "season", "quarter",
]

# Features whose effect on admissions is expected never to fall.
RISING_FEATURES = [
    "aqi", "outbreak_index", "aqi_above_150", "aqi_above_200", "aqi_above_300",
    "aqi_severity", "aqi_respiratory_ratio", "aqi_temp", "aqi_mobility",
    "lag1_aqi", "rolling_aqi",
]

# Upper edges of the right-closed air quality classes 0..5; below 0 or above the last edge is unclassified.
AIR_CLASS_EDGES = [50, 100, 150, 200, 300, 1000]

# Default admissions level when a request carries no admissions at all.
DEFAULT_ADMISSIONS = 150

# Scaling of corrections: (percentile, multiplier) for batches above SMALL_BATCH rows,
# (absolute level, multiplier) for smaller batches.
SMALL_BATCH = 10
SPIKE_LARGE = [(0.90, 2.0), (0.95, 3.0), (0.99, 4.0)]
SPIKE_SMALL = [(30.0, 2.0), (60.0, 4.0)]
EXTREME_LARGE = [(0.90, 5.0), (0.95, 6.5), (0.99, 8.0)]
EXTREME_SMALL = [(20.0, 5.0), (40.0, 8.0)]
WIDEN_PERCENTILE = 0.90
WIDEN_LEVEL = 200.0
WIDEN_FACTOR = 0.75
BLEND_WEIGHT = 0.6

# Training weights of the two correction stages.
SPIKE_PERCENTILE = 0.70
SPIKE_WEIGHT = 15.0
SPIKE_MINIMUM = 25
RESIDUAL_DOUBLING = [0.85, 0.95, 0.99]
POSITIVE_FACTOR = 1.5
POSITIVE_PERCENTILE = 0.90
EXTREME_PERCENTILE = 0.99
EXTREME_WEIGHT = 200.0
EXTREME_MINIMUM = 10
TOP_RESIDUALS = 5
TOP_WEIGHT = 500.0

# Request defaults.
MODES = ["xgb", "tft", "ensemble"]
DEFAULT_MODE = "ensemble"
DEFAULT_HOSPITAL = "HOSP-001"
DEFAULT_SENSITIVITY = 0.5
DEFAULT_AQI = 100.0

# Decision vocabulary and messages.
ALERT_LEVELS = ["low", "moderate", "high", "critical"]
URGENCIES = ["monitor", "prepare", "activate surge", "emergency"]
FACTOR_HAZARDOUS = "AQI >= 300 (hazardous air quality)"
FACTOR_VERY_UNHEALTHY = "AQI >= 200 (very unhealthy)"
FACTOR_UNHEALTHY = "AQI >= 150 (unhealthy)"
FACTOR_FESTIVAL = "Major festival / crowding risk"
FACTOR_WEATHER = "Adverse weather conditions"
FACTOR_NONE = "No major risk factors detected"
ACTION_NOTIFY = "Notify respiratory teams about alert level %s"
ACTION_OXYGEN = "Stage %d oxygen cylinders near ER"
ACTION_SURGE = "Activate surge bed protocol and inform city EMS"
ACTION_LOCUM = "Call in locum physicians for night shift coverage"
LOCUM_DOCTORS = 40
TRACE_STEPS = [
    ("prediction_api", "Fetched predictions"),
    ("monitor", "Alert %s"),
    ("staffing_planner", "Staffing plan ready"),
    ("supplies_planner", "Supplies plan ready"),
    ("advisory", "Advisory drafted"),
]
NOISE_TOKEN = "end_of_range="
