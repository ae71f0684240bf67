"""Raster operators on cells (one row per cell) and tiles (one row of arrays per tile).

A tile's ``bands`` is ARRAY<ARRAY<DOUBLE>>, band by band, cells row by row from
the top left; NODATA is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import REGION_SIZE, TILE_SIZE
from tilequarry.functions import projection
from tilequarry.functions.geometry import box_ring, envelope
from tilequarry.operators import coverage as cov
from tilequarry.operators import layout
from tilequarry.operators.layout import TILE_KEY

ORIGIN = ["x0", "y0", "cell_w", "cell_h"]


# --- cutting and stitching -------------------------------------------------------------------

def spread(items: str, at: str, wide: Column, value, gap: Column) -> Column:
    """Values at their places: as many gaps before each as it is away from the one before, and the rest after the last."""
    before = lambda x, k: x[at] - F.coalesce(F.get(F.col(items), k - 1)[at], F.lit(-1)) - 1
    placed = F.flatten(F.transform(items, lambda x, k: F.concat(F.array_repeat(gap, before(x, k)), F.array(value(x)))))
    return F.concat(placed, F.array_repeat(gap, wide - 1 - F.element_at(items, -1)[at]))


def assemble_tiles(cells: DataFrame, bands: list[str], tile_size: int = TILE_SIZE, first_by: str | None = None) -> DataFrame:
    """Cells to tiles of arrays.

    One shuffle by tile; inside it cells become strips of one row, and strips a
    tile, so no list is longer than the tile is wide.  Missing cells are null.
    Where several cells share a place, the first by ``first_by`` with a value wins, band by band.
    """
    order = [first_by] if first_by else []
    cut = layout.cut_to_grid(cells, tile_size).select(
        *TILE_KEY, *ORIGIN, *order,
        (F.col("px") - F.col("col") * tile_size).cast("int").alias("lx"),
        (F.col("py") - F.col("row_") * tile_size).cast("int").alias("ly"),
        *bands,
    ).repartition(*TILE_KEY)

    def merged(band: str) -> Column:
        # Equal cells become one: the least value there is, whatever order they come in.
        value = F.col(band).cast("double")
        if not first_by:
            return F.min(value).alias(band)
        return F.min(F.when(value.isNotNull(), F.struct(first_by, value.alias("v"))))["v"].alias(band)

    cut = cut.groupBy(*TILE_KEY, "ly", "lx").agg(*[merged(b) for b in bands], *[F.min(c).alias(c) for c in ORIGIN])
    cell = F.struct("lx", *bands)
    strips = cut.groupBy(*TILE_KEY, "ly").agg(
        F.sort_array(F.collect_list(cell)).alias("s"),
        *[F.min(c).alias(c) for c in ORIGIN],
    )

    def pad(band: str) -> Column:
        return spread("s", "lx", F.lit(tile_size), lambda c: c[band], F.lit(None).cast("double"))

    padded = strips.select(*TILE_KEY, *ORIGIN, "ly", *[pad(b).alias(b) for b in bands])
    stacked = padded.groupBy(*TILE_KEY).agg(
        F.sort_array(F.collect_list(F.struct("ly", *bands))).alias("strips"),
        *[F.min(c).alias(c) for c in ORIGIN],
    )
    empty = F.array_repeat(F.lit(None).cast("double"), tile_size)

    def stack(band: str) -> Column:
        return F.flatten(spread("strips", "ly", F.lit(tile_size), lambda r: r[band], empty))

    tiles = stacked.select(*TILE_KEY, *ORIGIN, F.array(*[stack(b) for b in bands]).alias("bands"))
    return layout.key_extent(tiles, tile_size).withColumns({
        "tile_w": F.col("cell_w") * tile_size, "tile_h": F.col("cell_h") * tile_size})


def tile_cells(tiles: DataFrame, bands: list[str], tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles of arrays back to cells."""
    zipped = F.arrays_zip(*[F.element_at("bands", i + 1).alias(b) for i, b in enumerate(bands)])
    flat = tiles.select(*TILE_KEY, *ORIGIN, F.posexplode(zipped).alias("i", "v"))
    return layout.cell_center(flat.select(
        "dataset_uid", *ORIGIN,
        (F.col("col") * tile_size + F.col("i") % tile_size).cast("int").alias("px"),
        (F.col("row_") * tile_size + F.floor(F.col("i") / tile_size)).cast("int").alias("py"),
        *[F.col(f"v.{b}").alias(b) for b in bands],
    ))


def tile_digest(tiles: DataFrame, band_no: int) -> DataFrame:
    """Count, nulls, sum, min and max of one band, straight from the arrays."""
    present = F.filter(F.element_at("bands", band_no), lambda v: v.isNotNull())
    return tiles.select(
        *TILE_KEY,
        F.size(F.element_at("bands", band_no)).alias("n_cells"),
        (F.size(F.element_at("bands", band_no)) - F.size(present)).alias("n_null"),
        F.aggregate(present, F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.array_min(present).alias("low"), F.array_max(present).alias("high"),
    )


def mosaic(cells: DataFrame, bands: list[str], x0: float, y0: float, tile_size: int = TILE_SIZE) -> DataFrame:
    """All cells of same-sized grids on one global grid with top-left corner (x0, y0).

    Where datasets overlap, the first by dataset_uid with a value wins, band by
    band.  ``band_row`` groups rows of cells for writing; nothing is gathered.
    """
    keyed = cells.select(
        F.floor((F.col("cx") - x0) / F.col("cell_w")).alias("gx"),
        F.floor((y0 - F.col("cy")) / F.col("cell_h")).alias("gy"),
        "dataset_uid", *bands,
    )
    merged = keyed.groupBy("gx", "gy").agg(*[
        F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col("dataset_uid"))).alias(b) for b in bands
    ])
    return merged.withColumn("band_row", F.floor(F.col("gy") / tile_size))


# --- masking and cropping --------------------------------------------------------------------

def mask_spans(tiles: DataFrame, regions: DataFrame, tile_size: int = TILE_SIZE,
               region_size: float | None = REGION_SIZE, hits: DataFrame | None = None) -> DataFrame:
    """The runs of cells whose centre is inside each region, cut at tile edges.

    Rows (region_id, dataset_uid, col, row_, py, px_from, px_to), the end
    exclusive.  Regions are traced once per grid, whatever the number of datasets
    on it; no band and no cell is read.  ``hits`` keeps only tiles that a search
    found.
    """
    ts = int(tile_size)
    gridded = cov.with_grid(tiles.select(*TILE_KEY, "x0", "y0", "tile_w", "tile_h"))
    # The same grid one level down: cells in place of tiles.
    cell_grids = cov.grids_of(gridded).selectExpr(
        "grid_id", "ox", "oy", f"tile_w / {ts} AS tile_w", f"tile_h / {ts} AS tile_h",
        f"c_min * {ts} AS c_min", f"(c_max + 1) * {ts} - 1 AS c_max",
        f"r_min * {ts} AS r_min", f"(r_max + 1) * {ts} - 1 AS r_max",
    )
    runs = cov.scan_lines(regions, cell_grids, region_size).selectExpr(
        "fid AS region_id", "grid_id", "grow AS line",
        """inline(transform(filter(flips, (c, i) -> i % 2 = 0),
             (c, i) -> named_struct('c_from', c, 'c_to', element_at(flips, int(2 * i + 2)))))""")
    cut = runs.selectExpr(
        "region_id", "grid_id", f"floor(line / {ts}) AS grow", f"pmod(line, {ts}) AS ly", "c_from", "c_to",
        f"explode(sequence(floor(c_from / {ts}), floor((c_to - 1) / {ts}))) AS gcol")
    wanted = gridded if hits is None else gridded.join(hits, TILE_KEY, "left_semi")
    return cut.join(wanted, cov.GRID_KEY).selectExpr(
        "region_id", *TILE_KEY, f"int(row_ * {ts} + ly) AS py",
        f"int(greatest(c_from - gcol * {ts}, 0) + col * {ts}) AS px_from",
        f"int(least(c_to - gcol * {ts}, {ts}) + col * {ts}) AS px_to",
    )


def mask_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells whose centre is inside a region, once per region."""
    keyed = spans.select("region_id", "dataset_uid", "col", "py", "px_from", "px_to")
    return cells.join(keyed, ["dataset_uid", "col", "py"]).where("px >= px_from AND px < px_to").drop("px_from", "px_to")


def mask_runs(spans: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Each tile's mask as ascending runs of cells, counted along the tile's rows: region_id, tile key, runs (a, b)."""
    ts = int(tile_size)
    start = f"(py - row_ * {ts}) * {ts} - col * {ts}"
    return spans.groupBy("region_id", *TILE_KEY).agg(
        F.expr(f"sort_array(collect_list(struct({start} + px_from AS a, {start} + px_to AS b))) AS runs"))


def mask_tiles(tiles: DataFrame, spans: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles of arrays with every cell outside the region set to null, once per region.

    Tiles without a cell inside are dropped.
    """
    return apply_runs(tiles, mask_runs(spans, tile_size), tile_size)


def apply_runs(tiles: DataFrame, runs: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Bands cut to their runs: a gap of nulls and a slice for each.

    Runs are small beside the tiles.  Where they are a stored table, Spark knows their size
    and, up to its limit, hands them to where the tiles are read; beyond it the two are merged.
    """
    n = int(tile_size) ** 2
    gap = "array_repeat(CAST(NULL AS DOUBLE), int({}))"
    before = "coalesce(get(runs, i - 1).b, 0)"
    cut = (f"flatten(transform(runs, (r, i) -> concat({gap.format(f'r.a - {before}')}, slice(band, int(r.a) + 1, int(r.b - r.a)))))")
    masked = f"transform(bands, band -> concat({cut}, {gap.format(f'{n} - element_at(runs, -1).b')}))"
    return tiles.join(runs, TILE_KEY).withColumn("bands", F.expr(masked)).drop("runs")


def crop_cells(cells: DataFrame, tiles: DataFrame, regions: DataFrame, bands: list[str],
               tile_size: int = TILE_SIZE, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Cells whose centre is in a region's envelope; bands are null outside the region itself."""
    boxes = regions.selectExpr("fid", f"{envelope('rings')} AS e").selectExpr(
        "fid", f"array({box_ring('e.xmin', 'e.ymin', 'e.xmax', 'e.ymax')}) AS rings")
    line = ["region_id", *TILE_KEY, "py"]
    box = mask_spans(tiles, boxes, tile_size, region_size)
    shape = mask_spans(tiles, regions, tile_size, region_size).groupBy(*line).agg(
        F.expr("collect_list(struct(px_from AS a, px_to AS b)) AS runs"))
    in_box = mask_cells(cells, box)
    kept = [c for c in in_box.columns if c not in line]
    found = in_box.join(shape, line, "left").selectExpr(
        *line, *kept, "coalesce(exists(runs, r -> px >= r.a AND px < r.b), false) AS in_region")
    return found.withColumns({b: F.when(F.col("in_region"), F.col(b)) for b in bands})


# --- resampling and reprojection -------------------------------------------------------------

def resample_bilinear(cells: DataFrame, bands: list[str], dx: float, dy: float) -> DataFrame:
    """Value at (px + dx, py + dy) in cell units, 0 <= dx, dy < 1, for every cell.

    Each cell hands its weighted value to the four outputs it takes part in, and
    the sums are combined before the one shuffle; there is no self-join.
    Neighbours without a value are left out and the weights rescaled.
    """
    if not (0 <= dx < 1 and 0 <= dy < 1):
        raise ValueError("offsets must be in [0, 1)")
    shares = F.array(*[
        F.struct((F.col("px") - i).alias("tx"), (F.col("py") - j).alias("ty"),
                 F.lit(float((dx if i else 1 - dx) * (dy if j else 1 - dy))).alias("w"),
                 F.lit(not i and not j).alias("own"))
        for i in (0, 1) for j in (0, 1)
    ])
    spread = cells.select("dataset_uid", *bands, F.inline(shares)).where("w > 0")
    sums = []
    for b in bands:
        has = F.col(b).isNotNull()
        sums += [F.sum(F.when(has, F.col(b) * F.col("w"))).alias(b + "_v"),
                 F.sum(F.when(has, F.col("w"))).alias(b + "_w"),
                 F.count(b).alias("n_" + b)]
    out = spread.groupBy("dataset_uid", F.col("tx").alias("px"), F.col("ty").alias("py")).agg(
        F.max("own").alias("own"), *sums)
    return out.where("own").select(
        "dataset_uid", "px", "py", *[(F.col(b + "_v") / F.col(b + "_w")).alias(b) for b in bands],
        *["n_" + b for b in bands],
    )


def projected_layouts(tiles: DataFrame, source: int, target: int, cell_size: float, tile_size: int = TILE_SIZE) -> DataFrame:
    """Box of target cells around what each tile owns, in whole cells of the target grid.

    A tile owns the positions whose upper left neighbour is one of its cells, which reaches
    half a cell beyond its right and lower edges.  That rectangle's border is sampled every
    eight cells, and the box is widened by one target cell for the bend between samples.
    """
    steps = max(4, tile_size // 8)
    border = F.expr(f"""flatten(transform(sequence(0, {steps}), i -> array(
        struct(xmin + (xmax + cell_w / 2 - xmin) * i / {steps} AS bx, ymax AS by),
        struct(xmin + (xmax + cell_w / 2 - xmin) * i / {steps} AS bx, ymin - cell_h / 2 AS by),
        struct(xmin AS bx, ymin - cell_h / 2 + (ymax - ymin + cell_h / 2) * i / {steps} AS by),
        struct(xmax + cell_w / 2 AS bx, ymin - cell_h / 2 + (ymax - ymin + cell_h / 2) * i / {steps} AS by))))""")
    pts = tiles.select(*TILE_KEY, F.inline(border))
    size = F.lit(float(cell_size))
    return projection.project(pts, "bx", "by", source, target, "tx", "ty").groupBy(*TILE_KEY).agg(
        (F.floor(F.min("tx") / size) - 1).alias("t_c1"), (F.ceil(F.max("tx") / size) + 1).alias("t_c2"),
        (F.floor(-F.max("ty") / size) - 1).alias("t_r1"), (F.ceil(-F.min("ty") / size) + 1).alias("t_r2"),
    )


def reproject(cells: DataFrame, bands: list[str], source: int, target: int, cell_size: float,
              tile_size: int = TILE_SIZE) -> DataFrame:
    """Cells on a target-projection grid, by bilinear interpolation of the source.

    Target keys (gx, gy) count whole cells of ``cell_size`` from the target
    projection's origin, rows down.  Each source tile proposes the target cells
    in its projected extent and keeps those whose source position falls in it, so
    every target cell is made once.  Each then asks for its four neighbours by an
    equi-join on the source cell, and the answers are summed.  Positions outside
    the source are left out.
    """
    if source == target:
        raise ValueError("nothing to reproject")
    tiles = layout.footprints(cells, tile_size)
    size = float(cell_size)
    boxes = projected_layouts(tiles, source, target, cell_size, tile_size).join(
        tiles.select(*TILE_KEY, *ORIGIN), TILE_KEY)
    bounds = cells.groupBy("dataset_uid").agg((F.max("px") + 1).alias("nx"), (F.max("py") + 1).alias("ny"))
    wanted = (
        boxes.join(bounds, "dataset_uid")
        .withColumn("gy", F.explode(F.sequence("t_r1", F.col("t_r2") - 1)))
        .withColumn("gx", F.explode(F.sequence("t_c1", F.col("t_c2") - 1)))
    )
    centred = wanted.withColumns({
        "mx": (F.col("gx") + F.lit(0.5)) * size, "my": -(F.col("gy") + F.lit(0.5)) * size})
    # Position in units of cells, measured from the centre of cell (0, 0).
    placed = projection.project(centred, "mx", "my", target, source, "sx", "sy").withColumns({
        "u": (F.col("sx") - F.col("x0")) / F.col("cell_w") - 0.5,
        "v": (F.col("y0") - F.col("sy")) / F.col("cell_h") - 0.5,
    })
    ts = float(tile_size)
    spot = placed.selectExpr(
        "*", "floor(u) AS px0", "floor(v) AS py0", "u - floor(u) AS fx", "v - floor(v) AS fy",
        f"""floor(greatest(u, 0D) / {ts}D) = col AND floor(greatest(v, 0D) / {ts}D) = row_
            AND u >= -0.5D AND u <= nx - 0.5D AND v >= -0.5D AND v <= ny - 0.5D AS owned""")
    asks = ", ".join(
        f"struct(int(px0 + {i}) AS px, int(py0 + {j}) AS py, {'fx' if i else '(1D - fx)'} * {'fy' if j else '(1D - fy)'} AS w)"
        for i in (0, 1) for j in (0, 1))
    # The choice is made inside the generator: as a filter, the optimizer would copy the
    # projection's series into it.
    asked = spot.selectExpr(
        "dataset_uid", "gx", "gy",
        f"inline(if(owned, array({asks}), cast(array() AS array<struct<px:int,py:int,w:double>>)))")
    got = asked.join(cells.select("dataset_uid", "px", "py", *bands), ["dataset_uid", "px", "py"])
    sums = []
    for b in bands:
        has = F.col(b).isNotNull()
        sums += [F.sum(F.when(has, F.col(b) * F.col("w"))).alias(b + "_v"),
                 F.sum(F.when(has, F.col("w"))).alias(b + "_w")]
    out = got.groupBy("dataset_uid", "gx", "gy").agg(*sums)
    return out.select("dataset_uid", "gx", "gy", *[
        F.when(F.col(b + "_w") > 0, F.col(b + "_v") / F.col(b + "_w")).alias(b) for b in bands
    ])
