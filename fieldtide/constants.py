"""Fixed values. They must stay equal to the published behaviour for results to match."""

from __future__ import annotations

# Default region (WGS84) and its canonical square grid.
REGION = {"lon_min": -94.7610, "lat_min": 32.8376, "lon_max": -89.5522, "lat_max": 36.6652}
GRID_N = 20

# Five-day bins of a year and the feature sets.
BIN_DAYS = 5
NUM_BINS = 73
FEATURE_SETS = {"ndvi_only": ("NDVI",), "all_indices": ("NDVI", "NDWI", "EVI")}

# Detector settings.
MIN_POINTS = 11
SAVGOL_WINDOW = 11
SAVGOL_POLY = 3
PERSIST_ALPHA = 0.85
PERSIST_K = 3

# Green-up rule.
GREENUP_RULE = "sustained_rise_next3_count2_delta0.01_total0.03"
GREENUP_AHEAD = 3
GREENUP_STEP = 0.01
GREENUP_MIN_STEPS = 2
GREENUP_TOTAL = 0.03

# Scene classification codes.
SCL_BAD = (3, 8, 9, 10, 11)
SCL_KEEP = (4, 5, 7)
SCL_WATER = 6
SCL_CLOUD_ABOVE = 7

# Quality thresholds.
CLOUD_FRAC_MAX = 0.10
BLANK_FRAC_MAX = 0.98

# Wanted dates per calendar month.
DATES_PER_MONTH = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2, 9: 2, 10: 1, 11: 1, 12: 1}

# Map palette.
PALETTE = (
    (0, "Background", 0, 0, 0),
    (1, "Corn", 255, 215, 0),
    (2, "Cotton", 220, 20, 60),
    (3, "Rice", 30, 144, 255),
    (4, "Soybeans", 34, 139, 34),
    (5, "Winter Wheat", 255, 140, 0),
)

# Default sowing windows (start, end, offset in days).
SEEDING_DEFAULTS = {
    "Corn": ("03-15", "04-30", 10),
    "Rice": ("03-20", "04-30", 14),
    "Soybeans": ("04-01", "05-20", 7),
    "Cotton": ("04-15", "05-20", 10),
    "Winter Wheat": ("02-01", "04-25", None),
}

# Date policies and their aliases.
DATE_POLICIES = ("latest", "earliest", "all", "statewide_anchor")
DATE_POLICY_ALIASES = {
    "anchor_latest": "statewide_anchor",
    "statewide_anchor_latest": "statewide_anchor",
    "similar_date": "statewide_anchor",
}

# Band layers of a statewide month.
STATEWIDE_BANDS = (
    "B2", "B3", "B4", "B8", "B5", "B6", "B7", "B8A", "B11", "B12", "SCL", "TCI_R", "TCI_G", "TCI_B",
)

# Overview factors and the smallest side kept.
OVERVIEW_FACTORS = (2, 4, 8, 16, 32)
OVERVIEW_MIN_SIDE = 256

# Model months and the job states that count as running.
MODEL_MONTH_MIN = 6
MODEL_MONTH_MAX = 11
JOB_ACTIVE_STATES = ("queued", "running")
INTERRUPTED_MESSAGE = "API restarted while job was in progress."

# Season summary columns, in file order.
SEASON_SUMMARY_COLUMNS = (
    "Crop", "Date", "NDVI", "NDWI", "EVI", "Harvest", "start_rule", "div_start", "div_end", "IoU",
    "SeedingEvent", "greenup_rule", "greenup_source", "seeding_offset_days",
    "seeding_window_start", "seeding_window_end",
)
FARM_SUMMARY_COLUMNS = (
    "Crop", "FarmID", "HarvestStart", "HarvestEnd", "GreenupStart", "EstimatedSeedingDate",
    "SeedingSource", "SeedingRule", "SeedingOffsetDays", "SeedingWindowStart", "SeedingWindowEnd",
    "SourceCSV",
)
PREDICTION_COLUMNS = (
    "year", "tile", "crop", "pred_start_doy", "pred_end_doy", "num_observations", "model_test_mae_days",
)
