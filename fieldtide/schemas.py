"""Schemas of the tables the operators exchange, as DDL text."""

from __future__ import annotations

PREDICTIONS = (
    "year int, tile string, crop string, pred_start_doy int, pred_end_doy int, num_observations int, "
    "model_test_mae_days double"
)
BBOX_REQUEST = (
    "request_id bigint, year int, lon_min double, lat_min double, lon_max double, lat_max double"
)
OBSERVATIONS = (
    "year int, tile string, crop string, farm_id string, date date, ndvi double, ndwi double, evi double"
)
MASK = ("tile string, row int, col int, label int")
GRID_HEADER = (
    "tile string, height int, width int, x0 double, y0 double, dx double, dy double, crs string"
)
CROPS = ("label int, crop string, is_crop boolean")
WINDOWS = ("crop string, start_md string, end_md string")
SEEDING = ("crop string, window_start string, window_end string, offset_days int")
LEDGER = ("tile string, stage string, status string, updated_at timestamp, error string")
SCENE_DOCUMENT = (
    "id string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
    "properties struct<acquired: string>"
)
JOBS = (
    "job_id string, job_key string, state string, phase string, created_at string, updated_at string, "
    "started_at string, finished_at string, year int, month int, "
    "bbox struct<lon_min: double, lat_min: double, lon_max: double, lat_max: double>, "
    "missing_meta_patches array<string>, "
    "progress struct<total: int, done: int, written: int, skipped: int, failed: int>, "
    "outputs array<struct<meta_patch: string, date: string, status: string, path: string>>, errors array<string>"
)
MODEL_METRICS = (
    "crop string, feature_set string, train_years array<int>, test_years array<int>, num_train int, num_val int, "
    "num_test int, train_metrics struct<mae_start: double, mae_end: double, mae_mean: double, iou_mean: double>, "
    "test_metrics struct<mae_start: double, mae_end: double, mae_mean: double, iou_mean: double>"
)
ARTIFACT_METADATA = (
    "model string, model_name string, trained_years array<int>, evaluated_years array<int>, training_note string, "
    "tile_bounds_wgs84 map<string, array<double>>"
)


def pixels(bands: tuple[str, ...] = ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")) -> str:
    """Pixel table for the chosen bands."""
    return (
        "tile string, date date, row int, col int, " + ", ".join(f"{b} int" for b in bands) + ", scl int"
    )
