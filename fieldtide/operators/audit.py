"""Incremental runs and completeness audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldtide import constants as C
from fieldtide.functions.dates import date_from_output_name
from fieldtide.operators import spatial

STAGES = ("global", "farm", "summary", "cleanup_npy")


def _options(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pending_work(tiles: DataFrame, ledger: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Tile and stage pairs not recorded as completed. ``tiles`` has ``tile, has_mask``; tiles without mask are skipped.

    Stages are listed on each tile row; an unknown status counts as pending.
    """
    work = tiles.filter("has_mask").select("tile", F.explode(_options(stages)).alias("stage"))
    done = ledger.filter(F.col("status") == "completed").select("tile", "stage")
    return work.join(done, ["tile", "stage"], "left_anti")


def tile_completion(tiles: DataFrame, ledger: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Per tile: number of completed stages and whether all enabled ones are."""
    done = ledger.filter((F.col("status") == "completed") & F.col("stage").isin(*stages)).select("tile", "stage").distinct()
    counts = done.groupBy("tile").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return tiles.select("tile").join(counts, "tile", "left").select(
        "tile", n.cast("int").alias("done"), (n == len(stages)).alias("complete")
    )


def missing_files(dates: DataFrame, files: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Expected (tile, date, band) without a non-empty file."""
    expected = dates.select("tile", "date", F.explode(_options(bands)).alias("band"))
    have = files.filter(F.col("length") > 0).select("tile", "date", "band")
    return expected.join(have, ["tile", "date", "band"], "left_anti")


def needs_download(
    wanted: DataFrame, state: DataFrame, files: DataFrame, bands: Sequence[str], settings: Sequence[str]
) -> DataFrame:
    """Per run: whether it can be skipped, and how many files are missing.

    A run is skipped only if its stored state is complete, its settings are the same (null-safe) and no expected file
    is missing. ``state`` has ``tile, complete, dates`` and the settings columns.
    """
    stored = state.select("tile", "complete", "dates", *[F.col(s).alias(f"_{s}") for s in settings])
    rows = wanted.join(stored, "tile", "left")
    same = F.coalesce("complete", F.lit(False)) & (F.coalesce(F.size("dates"), F.lit(0)) > 0)
    for s in settings:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    rows = rows.withColumn("_same", same)
    expected = rows.filter("_same").select("tile", F.explode("dates").alias("date"))
    gaps = missing_files(expected, files, bands).groupBy("tile").agg(F.count(F.lit(1)).alias("missing"))
    out = rows.join(gaps, "tile", "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("int"))
    return out.select(
        *wanted.columns, F.col("_same").alias("same_run"), "missing", (~F.col("_same") | (F.col("missing") > 0)).alias("run")
    )


def incomplete_outputs(tiles: DataFrame, files: DataFrame, min_mb: float = 120.0, include_missing: bool = True,
                       key: Sequence[str] = ("tile",)) -> DataFrame:
    """Class of each tile's output (or of each ``key``, such as tile and month): ``missing``, ``small`` or ``kept``, and
    whether it should run again."""
    limit = int(round(min_mb * 1024 * 1024))
    sized = files.groupBy(*key).agg(F.max("length").alias("bytes"))
    rows = tiles.select(*key).distinct().join(sized, list(key), "left")
    kind = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < limit, "small").otherwise("kept")
    rows = rows.withColumn("kind", kind)
    again = F.col("kind") == "small"
    if include_missing:
        again = again | (F.col("kind") == "missing")
    return rows.select(*key, F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"), "kind", again.alias("rerun"))


def dedupe_keep_first(rows: DataFrame, key: Sequence[str] = ("tile",), order: str = "position") -> DataFrame:
    """First row per key in list order, as a min over a struct."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(order, F.struct(*rest).alias("_row"))).alias("_m")).select(*key, "_m._row.*")


def existing_outputs(requested: DataFrame, files: DataFrame, policy: str, sidecars: DataFrame | None = None) -> DataFrame:
    """Output files of each requested tile with their date.

    Policy ``all`` matches ``tile_*.tif`` and reads the date from the name; other policies match ``tile.tif`` and read
    it from the sidecar table ``tile, date``.
    """
    name = F.regexp_extract("path", r"([^/]+)\.tif$", 1)
    tagged = files.withColumns({"_tile": F.regexp_extract(name, r"^(\d+_\d+)", 1), "_name": name})
    if policy == "all":
        hits = tagged.filter(F.col("_name").rlike(r"^\d+_\d+_")).withColumn("date", date_from_output_name(F.col("path")))
    else:
        hits = tagged.filter(F.col("_name") == F.col("_tile"))
        if sidecars is not None:
            notes = sidecars.select(F.col("tile").alias("_tile"), "date")
            hits = hits.join(notes, "_tile", "left")
        else:
            hits = hits.withColumn("date", F.lit(None).cast("date"))
    hits = hits.filter(F.col("_tile") != "").select(F.col("_tile").alias("tile"), "path", "date")
    return requested.join(hits, "tile", "left")


def run_progress(outputs: DataFrame, key: Sequence[str] = ("job_id",)) -> DataFrame:
    """Counts by status per job; ``done`` is everything that is no longer pending."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    return outputs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"),
        is_("written", "skipped", "skipped_existing", "failed").alias("done"),
        is_("written").alias("written"), is_("skipped", "skipped_existing").alias("skipped"), is_("failed").alias("failed"),
    )


def interrupted_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs become interrupted: state, phase, message and times; the message is added to their errors."""
    active = F.col("state").isin(*C.JOB_ACTIVE_STATES)
    message = F.lit(C.INTERRUPTED_MESSAGE)
    swap = lambda c, v: F.when(active, v).otherwise(F.col(c))
    errors = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.array(message))
    out = jobs if "phase_message" in jobs.columns else jobs.withColumn("phase_message", F.lit(None).cast("string"))
    return out.withColumns({
        "state": swap("state", F.lit("interrupted")), "phase": swap("phase", F.lit("interrupted")),
        "phase_message": swap("phase_message", message), "updated_at": swap("updated_at", now),
        "finished_at": swap("finished_at", now), "errors": swap("errors", errors),
    })


def request_plan(
    boxes: DataFrame, outputs: DataFrame, jobs: DataFrame, mosaics: DataFrame | None = None, n: int = C.GRID_N,
    region: dict[str, float] = C.REGION,
) -> DataFrame:
    """Decision per request box: ``ready``, ``attach``, ``not_available`` or ``new``.

    ``boxes`` has ``request_id, job_key`` and bounds; ``outputs`` has one row per output tile with its bounds;
    ``jobs`` the latest job per key (``job_key, state``). A request is ready when a mosaic overlaps it, when at least as
    many outputs overlap as it has canonical cells, or when no canonical cell lacks an output.
    """
    cells = spatial.grid_cells_for_bbox(boxes, region, n).select("request_id", "tile")
    wanted = cells.groupBy("request_id").agg(F.count(F.lit(1)).alias("cells"))
    hits = spatial.tiles_intersecting(outputs, boxes).select("request_id", "tile").distinct()
    found = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("outputs"))
    lacking = cells.join(outputs.select("tile").distinct(), "tile", "left_anti").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("missing_cells")
    )
    rows = boxes.select("request_id", "job_key")
    for part in (wanted, found, lacking):
        rows = rows.join(part, "request_id", "left")
    if mosaics is not None:
        over = spatial.tiles_intersecting(mosaics, boxes).select("request_id").distinct().withColumn("_mosaic", F.lit(True))
        rows = rows.join(over, "request_id", "left")
    else:
        rows = rows.withColumn("_mosaic", F.lit(False))
    rows = rows.join(jobs.select("job_key", "state"), "job_key", "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    enough = F.coalesce("_mosaic", F.lit(False)) | ((num("outputs") > 0) & (num("outputs") >= num("cells"))) | (num("missing_cells") == 0)
    decision = (
        F.when(enough, "ready").when(F.col("state").isin(*C.JOB_ACTIVE_STATES), "attach")
        .when(F.col("state") == "completed", "not_available").otherwise("new")
    )
    return rows.select(
        "request_id", num("cells").alias("cells"), num("outputs").alias("outputs"),
        num("missing_cells").alias("missing_cells"), decision.alias("decision"),
    )


def split_audit(records: DataFrame, key: Sequence[str] = ("year", "tile", "crop"), split: str = "split") -> DataFrame:
    """Counts per split and year, records shared by two splits, and records in no split, as one table.

    Shared records are found by one grouping on the record key; splits are never joined with each other.
    """
    k = list(key)
    named = records.filter(F.col(split).isNotNull())
    per_split = named.groupBy(F.col(split).alias("item")).agg(F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit("split"))
    per_year = records.groupBy(F.col("year").cast("string").alias("item")).agg(
        F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit("year"))
    # A record belongs to at most the three named splits, so this set is bounded.
    sets = named.groupBy(*k).agg(F.array_sort(F.collect_set(split)).alias("_s")).filter(F.size("_s") > 1)
    pairs = F.flatten(F.transform("_s", lambda a: F.transform(
        F.filter("_s", lambda b: b > a), lambda b: F.concat_ws("&", a, b))))
    overlap = sets.select(F.explode(pairs).alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit("overlap"))
    free = records.filter(F.col(split).isNull()).groupBy(F.lit("unassigned").alias("item")).agg(
        F.count(F.lit(1)).alias("records")).withColumn("kind", F.lit("unassigned"))
    out = per_split.unionByName(per_year).unionByName(overlap).unionByName(free)
    return out.select("kind", "item", "records")


def shared_records(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present in both tables."""
    return a.select(*key).intersect(b.select(*key))


def months_present(files: DataFrame, months: DataFrame) -> DataFrame:
    """``months`` (year, month) with ``present``: whether any tile has a date in the month. Files meet it as months."""
    seen = files.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct().withColumn("present", F.lit(True))
    return months.join(seen, ["year", "month"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def month_present(files: DataFrame, year: int, month: int) -> bool:
    """Whether any tile has a date in the month; stops at the first hit."""
    hit = files.filter((F.year("date") == year) & (F.month("date") == month))
    return not hit.select(F.lit(1)).limit(1).isEmpty()
