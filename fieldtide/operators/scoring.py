"""Applying a user's model to feature records and image chunks in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from fieldtide import constants as C
from fieldtide.functions.dates import decode_doy
from fieldtide.functions.text import safe_model_name

Loader = Callable[[str], Any]
Predictor = Callable[[Any, np.ndarray], np.ndarray]


def score_ready(records: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose crop has a model, crops without one and their record counts)."""
    known = registry.select("crop").distinct()
    ready = records.join(known, "crop", "left_semi")
    skipped = records.join(known, "crop", "left_anti").groupBy("crop").agg(F.count(F.lit(1)).alias("records"))
    return ready, skipped


def _models() -> dict[str, Any]:
    """Models of this worker process, where the package is installed on the workers; else of this task."""
    try:
        from fieldtide.operators.model_cache import MODELS
    except ImportError:
        return {}
    return MODELS


def _fixed_width(column: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length as a matrix over its values; nothing is copied."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if sizes.size > 1:
        raise ValueError(f"tensors of different sizes in one call: {sizes.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score_records(
    records: DataFrame, registry: DataFrame, load_model: Loader, predict: Predictor, partitions: int | None = None,
    salts: int | None = None, bins: int = C.NUM_BINS, batch_size: int = 1024,
) -> DataFrame:
    """Predicted start and end day per record.

    ``registry`` has one row per crop: ``crop, model_path, test_mae_days``. A crop's model is loaded once per worker
    process and kept. Records are hashed by crop and a salt, by default as many salts as shuffle partitions, so a crop
    with a third of all records spreads over all tasks. Tensors, all of one shape, are flattened in the JVM and reach
    ``predict(model, batch)`` as float32 views ``[n, channels, bins]`` of at most ``batch_size`` records; it returns
    ``[n, 2]`` values in 0..1.
    """
    models = registry.select("crop", "model_path", "test_mae_days")
    rows = records.join(models, "crop").select(
        "year", "tile", "crop", "num_observations", "test_mae_days", "model_path", F.flatten("x").cast("array<float>").alias("x")
    )
    n = salts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salt = F.pmod(F.xxhash64("year", "tile"), F.lit(n))
    rows = rows.repartition(partitions, "crop", salt) if partitions else rows.repartition("crop", salt)
    kept = ["year", "tile", "crop", "num_observations", "test_mae_days"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _models()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _fixed_width(batch.column("x"))
            x = x.reshape(len(x), -1, bins)
            paths = batch.column("model_path").dictionary_encode()
            owner, y = paths.indices.to_numpy(zero_copy_only=False), np.empty((len(x), 2))
            for k, path in enumerate(paths.dictionary.to_pylist()):
                if path not in cache:
                    cache[path] = load_model(path)
                here = np.flatnonzero(owner == k)
                whole = here.size == len(x)
                for a in range(0, here.size, batch_size):
                    at = slice(a, a + batch_size) if whole else here[a : a + batch_size]
                    y[at] = predict(cache[path], x[at])
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kept}, "s": y[:, 0], "e": y[:, 1]})

    schema = (
        "year int, tile string, crop string, num_observations int, test_mae_days double, s double, e double"
    )
    out = rows.mapInArrow(run, schema)
    return out.withColumn("_d", decode_doy(F.col("s"), F.col("e"))).select(
        "year", "tile", "crop", F.col("_d.start_doy").alias("pred_start_doy"),
        F.col("_d.end_doy").alias("pred_end_doy"), "num_observations",
        F.col("test_mae_days").alias("model_test_mae_days"),
    )


def model_paths(crops: DataFrame, root: str) -> DataFrame:
    """Registry paths ``root/<crop>/best_model.pt`` with the model folder name of each crop."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), safe_model_name(F.col("crop")), F.lit("/best_model.pt"))
    return crops.select("crop", path.alias("model_path"))


def score_chunks(
    chunks: DataFrame, load_model: Callable[[], Any], predict: Predictor, size: int, bands: int,
    key: Sequence[str] = ("tile",), out_bands: Sequence[str] = ("value",), classes: bool = False, batch_size: int = 16,
    model_name: str | None = None,
) -> DataFrame:
    """Model output per chunk pixel: ``chunk_row, chunk_col, r, c`` plus output bands.

    ``chunks`` is the result of ``chunk_arrays`` on padded chunks. ``predict(model, batch)`` maps ``[n, bands, size,
    size]`` to ``[n, out, size, size]``, ``batch_size`` chunks at a time, whatever the Arrow batch holds; with ``classes``
    the output is scores and the first best class is returned as one band. The kernel returns an array per band, which
    the JVM unfolds; rows outside the real chunk are dropped. Under ``model_name`` a worker process keeps the model, else
    each task loads it.
    """
    outs = list(out_bands)[:1] if classes else list(out_bands)
    names = [*key, "chunk_row", "chunk_col", "h", "w"]
    schema = StructType([chunks.schema[n] for n in names])
    for k in range(len(outs)):
        schema = schema.add(f"_b{k}", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _models() if model_name else {}
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                if model_name not in cache:
                    cache[model_name] = load_model()
                x = _fixed_width(part.column("x")).astype(np.float32, copy=False).reshape(-1, bands, size, size)
                y = np.asarray(predict(cache[model_name], x))
                if classes:
                    y = y.argmax(axis=1)[:, None]
                ends = pa.array(np.arange(len(x) + 1) * size * size, pa.int32())
                layers = {f"_b{k}": pa.ListArray.from_arrays(ends, pa.array(y[:, k].reshape(-1).astype(np.float64))) for k in range(len(outs))}
                yield pa.RecordBatch.from_pydict({**{n: part.column(n) for n in names}, **layers})

    scored = chunks.select(*names, "x").mapInArrow(run, schema)
    pixels = F.posexplode(F.arrays_zip(*[F.col(f"_b{k}").alias(f"v{k}") for k in range(len(outs))])).alias("_at", "_v")
    rows = scored.select(*names, pixels).withColumns({"r": F.floor(F.col("_at") / size).cast("int"), "c": (F.col("_at") % size).cast("int")})
    rows = rows.filter((F.col("r") < F.col("h")) & (F.col("c") < F.col("w")))
    return rows.select(*key, "chunk_row", "chunk_col", "r", "c", *[F.col(f"_v.v{k}").alias(b) for k, b in enumerate(outs)])
