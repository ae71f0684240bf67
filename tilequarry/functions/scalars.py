"""Small scalar helpers: names, paths, rounding, dates, JSON keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilequarry.constants import TILE_SIZE

# Fixed format: <dataset uid>_<hex code>_<col>_<row>.tif
TILE_NAME_PATTERN = r"^(.+)_([0-9a-f]+)_(-?\d+)_(-?\d+)\.tif$"


def path_join(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("/", *cols)


def tile_file_name(dataset_uid: Column, code: Column, col: Column, row: Column) -> Column:
    stem = F.concat_ws("_", dataset_uid, code, col.cast("string"), row.cast("string"))
    return F.concat(stem, F.lit(".tif"))


def parse_tile_name(name: Column) -> dict[str, Column]:
    """Columns dataset_uid, tile_code, col, row_ of a tile file name."""
    def part(i: int) -> Column:
        return F.regexp_extract(name, TILE_NAME_PATTERN, i)
    return {
        "dataset_uid": part(1),
        "tile_code": part(2),
        "col": part(3).try_cast("int"),
        "row_": part(4).try_cast("int"),
    }


def doc_name(tile_name: Column) -> Column:
    """Name of a tile's document: same stem, .json."""
    return F.regexp_replace(tile_name, r"\.[^.]*$", ".json")


def doc_to_tile_path(path: Column) -> Column:
    """Path of the tile a document belongs to: leave the json folder, change the suffix."""
    return F.regexp_replace(path, r"/json/([^/]+)\.json$", "/$1.tif")


def strip_scheme(path: Column) -> Column:
    """Drop a leading URI scheme and keep everything after it, ports included."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")


def has_suffix(name: Column, suffixes: list[str]) -> Column:
    """Name ends in one of the suffixes."""
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.endswith(name, F.lit(s))
    return hit


def floor_count(x: Column, tile_size: int = TILE_SIZE) -> Column:
    return F.floor(x / F.lit(float(tile_size))).cast("int")


def floor_value(x: Column, tile_size: int = TILE_SIZE) -> Column:
    return floor_count(x, tile_size) * F.lit(tile_size)


def ceiling_count(x: Column, tile_size: int = TILE_SIZE) -> Column:
    return F.ceil(x / F.lit(float(tile_size))).cast("int")


def ceiling_value(x: Column, tile_size: int = TILE_SIZE) -> Column:
    return ceiling_count(x, tile_size) * F.lit(tile_size)


def round_half_up(x: Column, places: int) -> Column:
    """Round to ``places`` decimals, halves towards plus infinity."""
    scale = float(10 ** places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def nanos_to_seconds(ns: Column) -> Column:
    return round_half_up(ns.cast("double") / F.lit(1e9), 4)


def bytes_to_unit(n: Column, power: int) -> Column:
    """Bytes to KiB (1), MiB (2), ..., three decimals."""
    return round_half_up(n.cast("double") / F.lit(1024.0 ** power), 3)


def date_label(ts: Column, pattern: str = "yyyy-MMdd-hhmmss") -> Column:
    """Timestamp label; note the 12-hour clock of the default pattern."""
    return F.date_format(ts, pattern)


def json_keys(js: Column) -> Column:
    """Top-level keys of a JSON object; null or invalid text gives an empty array."""
    return F.coalesce(F.json_object_keys(js), F.array().cast("array<string>"))
