"""Opening only the stored tiles that a query's envelope can reach.

Tiles are stored by dataset and along the curve.  An envelope becomes a predicate on plain columns: the datasets it
reaches (folders), for each the runs of the curve that cover its keys (row groups, files), and the four sides (exact, half-open).
All of it reaches the Parquet scan, so bands of other tiles are never read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tilequarry.constants import SFC_HILBERT, SFC_ZORDER
from tilequarry.functions import geometry as geo
from tilequarry.functions import sfc
from tilequarry.operators import coverage as cov

# Datasets that are named in a predicate, at most; with more the four sides decide alone.
NAMED_DATASETS = 64
# Runs of the curve for each dataset.
RANGES = 16
ZORDER_BITS = 31

Envelope = tuple[float, float, float, float]


def envelope_of(regions: DataFrame) -> Envelope | None:
    """The rectangle around all regions: one row, whatever their number; None without a vertex."""
    sides = {"xmin": F.min, "ymin": F.min, "xmax": F.max, "ymax": F.max}
    row = regions.agg(*[fn(F.expr(geo.envelope_side("rings", s))).alias(s) for s, fn in sides.items()]).first()
    return None if None in row else tuple(row)


def key_range(low: float, high: float, size: float) -> tuple[int, int]:
    """First and last tile whose open interval an interval from the grid's origin overlaps."""
    return math.floor(low / size), math.ceil(high / size) - 1


def curve_predicate(layout: Row, envelope: Envelope, curve: str = SFC_HILBERT, most: int = RANGES) -> Column:
    """The tiles of one dataset whose code lies in a run of the curve that the envelope's keys are on."""
    xmin, ymin, xmax, ymax = envelope
    cols = key_range(xmin - layout.x0, xmax - layout.x0, layout.tile_w)
    rows = key_range(layout.y0 - ymax, layout.y0 - ymin, layout.tile_h)
    clipped = [(max(a, low), min(b, high)) for (a, b), low, high in
               ((cols, layout.min_col, layout.max_col), (rows, layout.min_row, layout.max_row))]
    runs = sfc.code_ranges(curve, *clipped, ZORDER_BITS if curve == SFC_ZORDER else layout.bits, most)
    return reduce(or_, [F.col("sfc").between(a, b) for a, b in runs], F.lit(False))


def tiles_under(tiles: DataFrame, envelope: Envelope | None, layouts: DataFrame | None = None, curve: str = SFC_HILBERT) -> DataFrame:
    """Stored tiles that overlap the envelope, touching edges excluded.

    ``layouts`` (``layout.stored_layouts``, kept beside the tiles) is asked for the datasets the envelope reaches;
    up to ``NAMED_DATASETS`` of them are looked at, and the answer is the same with and without.
    """
    if envelope is None:
        return tiles.where(F.lit(False))
    found = cov.tiles_in_extent(tiles, *envelope)
    if layouts is None:
        return found
    near = cov.tiles_in_extent(layouts, *envelope).limit(NAMED_DATASETS + 1).collect()
    if len(near) > NAMED_DATASETS:
        return found
    if not near:
        return tiles.where(F.lit(False))
    runs = [(F.col("dataset_uid") == d.dataset_uid) & curve_predicate(d, envelope, curve) for d in near]
    # Both are said of each dataset and of all, as a scan only takes conjunctions and folders.
    return found.where(F.col("dataset_uid").isin([d.dataset_uid for d in near])).where(reduce(or_, runs))
