"""Text projections: lenient numbers, names, fingerprints, flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldtide import constants as C
from fieldtide.functions.indices import finite


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def to_double_lenient(text: Column) -> Column:
    return finite(blank_to_null(text).try_cast("double"))


def safe_crop_folder(name: Column) -> Column:
    """``/`` becomes ``-`` and runs of blanks one blank, for folder names."""
    return F.trim(F.regexp_replace(F.replace(name, F.lit("/"), F.lit("-")), r"\s+", " "))


def safe_model_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def normalize_date_policy(text: Column) -> Column:
    """Trimmed lower-case policy with aliases resolved; null when it is not a known policy."""
    low = F.lower(F.trim(text))
    pairs = [F.lit(v) for kv in C.DATE_POLICY_ALIASES.items() for v in kv]
    value = F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)
    return F.when(value.isin(*C.DATE_POLICIES), value)


def tile_i(tile: Column) -> Column:
    return F.split_part(tile, F.lit("_"), F.lit(1)).try_cast("int")


def tile_j(tile: Column) -> Column:
    return F.split_part(tile, F.lit("_"), F.lit(2)).try_cast("int")


def tile_name(i: Column, j: Column) -> Column:
    return F.concat_ws("_", i.cast("string"), j.cast("string"))


def _json_text(value: Column) -> Column:
    """A JSON string literal with ASCII escapes left to plain text (names here are ASCII)."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def canonical_json(fields: dict[str, tuple[str, Column]]) -> Column:
    """Compact JSON with keys in name order. Kinds: ``int``, ``text``, ``bool``, ``raw``, ``texts`` (sorted array)."""
    parts: list[Column] = [F.lit("{")]
    for pos, name in enumerate(sorted(fields)):
        kind, value = fields[name]
        if kind == "texts":
            ordered = F.transform(F.array_sort(value), _json_text)
            rendered = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
        elif kind == "text":
            rendered = F.coalesce(_json_text(value), F.lit("null"))
        elif kind == "bool":
            rendered = F.when(value, "true").when(~value, "false").otherwise("null")
        else:
            rendered = F.coalesce(value.cast("string"), F.lit("null"))
        parts += [F.lit(("," if pos else "") + f'"{name}":'), rendered]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def request_fingerprint(fields: dict[str, tuple[str, Column]]) -> Column:
    """SHA-1 of the canonical JSON, so equal requests share one key whatever their tile order."""
    return F.sha1(canonical_json(fields))


def run_tag(start: Column, end: Column, cloud: Column, mask_water: Column) -> Column:
    """``2024-01-01_2024-01-31_ct20_mw0``; a fractional cloud threshold uses ``p`` for the point."""
    number = F.replace(F.regexp_replace(cloud.cast("double").cast("string"), r"\.0$", ""), F.lit("."), F.lit("p"))
    return F.concat(
        start.cast("string"), F.lit("_"), end.cast("string"), F.lit("_ct"), number,
        F.lit("_mw"), mask_water.cast("int").cast("string"),
    )


def harvest_flag(date: Column, start: Column, end: Column) -> Column:
    """``Start`` or ``End`` or empty; start wins when both fall on the same date."""
    return F.when(date == start, "Start").when(date == end, "End").otherwise("")


def seeding_flag(date: Column, greenup: Column, seeding: Column) -> Column:
    return F.concat_ws(
        ";", F.when(date == greenup, "GreenupStart"), F.when(date == seeding, "EstimatedSeedingDate")
    )


def band_index_rule(names: Column, colours: Column, count: Column) -> Column:
    """One-based (red, green, blue) band positions: by name, then by colour tag, then by band count."""
    def by(labels: Column) -> list[Column]:
        low = F.transform(labels, lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))
        return [F.array_position(low, F.lit(c)).cast("int") for c in ("red", "green", "blue")]

    def full(p: list[Column]) -> Column:
        return (p[0] > 0) & (p[1] > 0) & (p[2] > 0)

    named, tagged = by(names), by(colours)
    return (
        F.when(full(named), F.array(*named))
        .when(full(tagged), F.array(*tagged))
        .when(count >= 6, F.array(F.lit(6), F.lit(4), F.lit(2)))
        .when(count >= 3, F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
