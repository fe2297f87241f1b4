"""Values that results depend on and that must not be changed."""

# Closed list of building uses, in column order.
PRIMARY_USES = [
    "Education",
    "Entertainment/public assembly",
    "Food sales and service",
    "Healthcare",
    "Lodging/residential",
    "Manufacturing/industrial",
    "Office",
    "Other",
    "Parking",
    "Public services",
    "Religious worship",
    "Services",
]

# Numeric model inputs of a building reading, in column order.
BASE_FEATURES = [
    "meter_reading",
    "site_id",
    "square_feet",
    "year_built",
    "floor_count",
    "air_temperature",
    "cloud_coverage",
    "dew_temperature",
    "precip_depth_1_hr",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
    "air_temperature_mean_lag7",
    "air_temperature_max_lag7",
    "air_temperature_min_lag7",
    "air_temperature_std_lag7",
    "air_temperature_mean_lag73",
    "air_temperature_max_lag73",
    "air_temperature_min_lag73",
    "air_temperature_std_lag73",
    "hour_x",
    "hour_y",
    "month_x",
    "month_y",
    "weekday_x",
    "weekday_y",
    "is_holiday",
    "meter_lag1",
    "meter_lag24",
    "meter_roll_mean_24",
    "meter_roll_std_24",
    "meter_diff_1",
    "meter_diff_24",
    "meter_zscore_24",
]

# Class codes of the grid log labels.
GRID_LABELS = {"Natural": 0, "Attack": 1}

# Names of the two classes in reports.
CLASS_NAMES = {0: "Normal", 1: "Anomaly"}

# Threshold sweep from 0.01 in steps of 0.01, 49 values, all below one half.
SWEEP_STEP = 0.01
SWEEP_COUNT = 49

# Rolling frame, score offset, normalisation offset.
ROLL_ROWS = 24
ZSCORE_EPSILON = 1e-6
NORM_EPSILON = 1e-5

# Metric names averaged after local fits and after evaluations.
FIT_METRICS = ["train_loss", "val_f1"]
EVAL_METRICS = ["f1", "pr_auc", "threshold"]
DEFAULT_THRESHOLD = 0.5

# Keys that dataset metadata must have.
METADATA_KEYS = ["input_dim", "num_classes", "num_samples", "task_type", "data_format"]
