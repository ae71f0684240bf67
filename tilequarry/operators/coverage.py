"""Which cells of a grid does each polygon touch or contain?  The spatial joins rest on this.

Tiles of datasets whose origins agree modulo the tile size share one *grid*, so
a feature is laid out once per grid rather than once per scene, and matching it
to tiles is an equi-join on (grid_id, gcol, grow).

A polygon is laid out from its edges alone, each handled on its own:

* the closed tiles an edge meets are *boundary* tiles (exact test, no division);
* an edge that crosses the centre line of a tile row flips inside/outside there,
  so it leaves one *flip* at the first tile whose centre lies on or right of it.

Flips at the same place cancel in pairs, before the shuffle.  What is left per
row is at most one entry per grid column; consecutive flips bracket the runs of
tiles that are wholly inside.  The cost is that of the boundary plus the answer,
never vertices times tiles, and a tile or a feature that holds most of the data
is spread over many keys.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import REGION_SIZE
from tilequarry.functions import geometry as geo

# Widens the candidate ranges, in cells; exact tests decide afterwards.
SLACK = 1e-6
# Finest and coarsest level of squares: 4^-12 and 4^24 map units.
LOW_LEVEL, TOP_LEVEL = -12, 24

GRID_KEY = ["grid_id", "gcol", "grow"]
GRID = ["grid_id", "ox", "oy", "tile_w", "tile_h", "c_min", "c_max", "r_min", "r_max"]


def with_grid(tiles: DataFrame) -> DataFrame:
    """Add the shared grid of each tile and its key there.

    Needs x0, y0, tile_w, tile_h, which are constant per dataset.
    """
    return tiles.selectExpr("*", "pmod(x0, tile_w) AS ox", "pmod(y0, tile_h) AS oy").selectExpr(
        "*",
        "concat_ws(':', tile_w, tile_h, ox, oy) AS grid_id",
        "col + bigint(round((x0 - ox) / tile_w)) AS gcol",
        "row_ - bigint(round((y0 - oy) / tile_h)) AS grow",
    )


def grids_of(gridded: DataFrame) -> DataFrame:
    """One row per grid: its geometry and the key range in use."""
    return gridded.groupBy("grid_id", "ox", "oy", "tile_w", "tile_h").agg(
        F.min("gcol").alias("c_min"), F.max("gcol").alias("c_max"),
        F.min("grow").alias("r_min"), F.max("grow").alias("r_max"),
    )


def _level(p: str) -> Column:
    """The level whose squares, 4^level map units wide, are no narrower than a rectangle; points are on the lowest."""
    return F.expr(f"""int(least({TOP_LEVEL}, ceil(log(4D, greatest({p}xmax - {p}xmin, {p}ymax - {p}ymin, pow(4D, {LOW_LEVEL}))))))""")


def envelope_pairs(left: DataFrame, right: DataFrame, condition: str = "true", square: float | None = None,
                   left_levels: list[int] | None = None, right_levels: list[int] | None = None) -> DataFrame:
    """Rows of left and right whose closed rectangles (a_xmin.. and b_xmin..) share a point, each pair once.

    Every rectangle lies in at most four squares of its level and of any coarser one.  Two rectangles meet on the
    coarser of their levels, in the square of the overlap's lower left corner; so squares
    are small where rectangles are, whatever the map's unit, and no distinct follows.  A side is laid out on the
    levels that the other has (looked up if not given).  With ``square``, all squares are of that width instead.
    """
    def squares(df: DataFrame, p: str, other: DataFrame, q: str, levels: list[int] | None) -> DataFrame:
        """A rectangle on its own level and on the coarser ones of the other side."""
        if square:
            at, width = df.withColumn("level", F.lit(0)), f"{float(square)!r}D"
        else:
            used = other.agg(F.collect_set(_level(q)).alias("used")).scalar() if levels is None else F.array(*map(F.lit, levels)).cast("array<int>")
            at = df.withColumns({"levels": used, "own": _level(p)}).withColumn(
                "level", F.explode(F.expr("array_union(array(own), filter(levels, x -> x > own))"))).drop("levels").withColumnRenamed("own", f"{p}level")
            width = "pow(4D, level)"
        for axis in ("x", "y"):
            low, high = f"floor({p}{axis}min / {width})", f"floor({p}{axis}max / {width})"
            at = at.selectExpr("*", f"explode(sequence({low}, {high})) AS r{axis}")
        return at

    width, top = (f"{float(square)!r}D", "true") if square else ("pow(4D, level)", "level = greatest(a_level, b_level)")
    reach = f"""{top} AND a_xmin <= b_xmax AND a_xmax >= b_xmin AND a_ymin <= b_ymax AND a_ymax >= b_ymin
        AND rx = floor(greatest(a_xmin, b_xmin) / {width}) AND ry = floor(greatest(a_ymin, b_ymin) / {width})"""
    met = squares(left, "a_", right, "b_", right_levels).join(squares(right, "b_", left, "a_", left_levels), ["level", "rx", "ry"])
    return met.where(f"{reach} AND ({condition})").drop("level", "rx", "ry", "a_level", "b_level")


def _with_sides(features: DataFrame, p: str) -> DataFrame:
    """fid, rings and the envelope, with a prefix.

    A feature without vertices has no edges either, so its place does not matter; a default
    that is never null keeps null checks on the envelope out of the plan.
    """
    stored = "env" in features.columns
    return features.selectExpr("fid", "rings", *[
        f"coalesce({f'env.{s}' if stored else geo.envelope_side('rings', s)}, 0D) AS {p}{s}" for s in geo.EXTENT])


def match_grids(features: DataFrame, grids: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Pair each feature with the grids its envelope reaches."""
    boxes = grids.selectExpr(
        *GRID,
        "ox + c_min * tile_w AS b_xmin", "ox + (c_max + 1) * tile_w AS b_xmax",
        "oy - (r_max + 1) * tile_h AS b_ymin", "oy - r_min * tile_h AS b_ymax",
    )
    return envelope_pairs(_with_sides(features, "a_"), boxes, square=region_size, left_levels=list(range(LOW_LEVEL, TOP_LEVEL + 1))).select("fid", "rings", *GRID)


UNIQUE = {"unique": True}


def known_unique(features: DataFrame) -> DataFrame:
    """Features whose ids are known to be there and different, as those of a keyed table are; marks the column, checks nothing.

    The mark stays on the column through selections and in stored tables.
    """
    return features.withMetadata("fid", UNIQUE)


def once(features: DataFrame) -> DataFrame:
    """Each feature once, all columns kept.  Every operator on features begins here.

    Rows that repeat a feature become one, since inside is decided by counting edges; an id
    that is null or stands for different geometries fails the job.  Where attributes differ, one row's
    are kept whole.  Without ``rings`` only ids are checked.  Ids marked as unique are left alone, so a table is checked once, when it is stored.
    """
    if features.schema["fid"].metadata.get("unique"):
        return features
    rest = [c for c in features.columns if c != "fid"]
    comparable = [F.to_json(c) if features.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in rest]
    shape = F.xxhash64("rings") if "rings" in rest else F.lit(0)
    one = features.groupBy("fid").agg(
        F.min_by(F.struct(*rest), F.xxhash64(*comparable)).alias("f"), F.min(shape).alias("h1"), F.max(shape).alias("h2"))
    checked = one.selectExpr("""IF(fid IS NULL OR h1 <> h2,
        bigint(raise_error('feature ids must be there and stand for one geometry each')), fid) AS fid""", "f")
    return known_unique(checked.select("fid", "f.*"))


def drawn(features: DataFrame) -> DataFrame:
    """Features as closed rings, each id once.

    An open path goes back the way it came and a point is an edge to itself, so both have a boundary and no inside.
    """
    stored = [c for c in ("env",) if c in features.columns]
    return once(features.select("fid", *stored, "rings")).selectExpr("fid", *stored, """transform(rings, r -> CASE
        WHEN size(r) = 1 THEN concat(r, r)
        WHEN size(r) > 1 AND element_at(r, 1) <> element_at(r, -1) THEN concat(r, slice(reverse(r), 2, size(r) - 1))
        ELSE r END) AS rings""")


def _sequence(low: str, high: str) -> str:
    """low..high, empty when low > high."""
    return f"if({low} <= {high}, sequence({low}, {high}), cast(array() AS array<bigint>))"


def _explode_edges(matched: DataFrame) -> DataFrame:
    kept = [c for c in matched.columns if c != "rings"]
    return matched.selectExpr(*kept, f"inline({geo.edges('rings')})")


def _edge_rows(matched: DataFrame) -> DataFrame:
    """Each edge once per grid row whose closed band it reaches."""
    return _over_rows(_explode_edges(matched))


def _over_rows(one_per_edge: DataFrame) -> DataFrame:
    return one_per_edge.selectExpr(
        "*",
        f"greatest(ceil((oy - greatest(y1, y2)) / tile_h - {SLACK}) - 1, r_min) AS r_first",
        f"least(floor((oy - least(y1, y2)) / tile_h + {SLACK}), r_max) AS r_last",
    ).selectExpr("*", f"explode({_sequence('r_first', 'r_last')}) AS grow")


def _with_column_range(rows: DataFrame) -> DataFrame:
    """Add the grid columns that the edge reaches in row ``grow``, to be tested by ``_touched``.

    Steps are separate columns so that each is computed once.
    """
    return rows.selectExpr(
        "*",
        "oy - grow * tile_h AS top", "oy - grow * tile_h - tile_h AS bottom",
        "(x2 - x1) / nullif(y2 - y1, 0D) AS slope",  # null when level
        "least(y1, y2) AS low", "greatest(y1, y2) AS high",
    ).selectExpr(
        "*",
        f"coalesce(x1 + (least(greatest(bottom - tile_h * {SLACK}, low), high) - y1) * slope, x1) AS xa",
        f"coalesce(x1 + (least(greatest(top + tile_h * {SLACK}, low), high) - y1) * slope, x2) AS xb",
    ).selectExpr(
        "*",
        f"greatest(ceil((least(xa, xb) - ox) / tile_w - {SLACK}) - 1, c_min) AS c_first",
        f"least(floor((greatest(xa, xb) - ox) / tile_w + {SLACK}), c_max) AS c_last",
    )


def _touched() -> str:
    """The grid columns whose closed tile in row ``grow`` the edge meets.

    Written into the generator that spells them out: exploding a column of it would
    make the optimizer repeat the test in a filter below.
    """
    test = geo.edge_meets_box("x1", "y1", "x2", "y2", "(ox + c * tile_w)", "bottom", "(ox + (c + 1) * tile_w)", "top")
    return f"filter({_sequence('c_first', 'c_last')}, c -> {test})"


def _with_flip(rows: DataFrame) -> DataFrame:
    """Add ``flip``: the first column whose centre on the row's centre line is on or right
    of the edge; null where the edge does not cross that line.

    The quotient gives a guess; the crossing test at the guess and its two
    neighbours makes it exact.  Clamped to the grid, one past the end included.
    """
    def right_of(c: str) -> str:
        return f"int({geo.ray_crosses(f'(ox + ({c} + 0.5D) * tile_w)', 'mid')})"

    return rows.selectExpr("*", "oy - (grow + 0.5D) * tile_h AS mid").selectExpr(
        "*",
        """if((y1 > mid) <> (y2 > mid),
              ceil((x1 + (mid - y1) * (x2 - x1) / nullif(y2 - y1, 0D) - ox) / tile_w - 0.5D), NULL) AS guess""",
    ).selectExpr(
        "*",
        f"""if(guess IS NULL, NULL, least(greatest(
              guess - 1 + {right_of('(guess - 1)')} + {right_of('guess')} + {right_of('(guess + 1)')},
              c_min), c_max + 1)) AS flip""",
    )


def coverage(features: DataFrame, grids: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """(fid, grid_id, gcol, grow, is_inside): every grid cell each feature intersects.

    ``is_inside`` cells lie wholly in the feature and meet no edge.  Each cell
    comes once per feature.
    """
    return _cover_rows(_edge_rows(match_grids(drawn(features), grids, region_size)))


def _cover_rows(edge_rows: DataFrame) -> DataFrame:
    """Coverage of the grid rows given; each needs all edges of its features in that row."""
    rows = _with_flip(_with_column_range(edge_rows))
    marks = rows.selectExpr("fid", "grid_id", "grow", f"""inline(concat(
        transform({_touched()}, c -> named_struct('c', c, 'is_flip', false)),
        if(flip IS NULL, cast(array() AS array<struct<c:bigint,is_flip:boolean>>),
           array(named_struct('c', flip, 'is_flip', true)))))""")
    # Combined on the map side; flips that cancel are gone after this.
    marks = marks.groupBy("fid", "grid_id", "grow", "c", "is_flip").agg(F.expr("count(*) % 2 AS odd"))
    per_row = marks.groupBy("fid", "grid_id", "grow").agg(
        F.expr("collect_list(c) FILTER (WHERE NOT is_flip) AS touched"),
        F.expr("sort_array(collect_list(c) FILTER (WHERE is_flip AND odd = 1)) AS flips"),
    )
    return per_row.selectExpr("fid", "grid_id", "grow", """inline(concat(
        transform(touched, c -> named_struct('gcol', c, 'is_inside', false)),
        transform(
          array_except(flatten(transform(filter(flips, (c, i) -> i % 2 = 0),
                                         (c, i) -> sequence(c, element_at(flips, int(2 * i + 2)) - 1))), touched),
          c -> named_struct('gcol', c, 'is_inside', true))))""").select(
        "fid", "grid_id", "gcol", "grow", "is_inside")


def scan_lines(features: DataFrame, grids: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """(fid, grid_id, grow, flips): where each row's centre line enters and leaves a feature.

    A cell centre is inside if an odd number of ``flips`` is at or left of its
    column.  Exact at centres that lie on an edge.
    """
    rows = _explode_edges(match_grids(drawn(features), grids, region_size)).selectExpr(
        "*",
        f"greatest(ceil((oy - greatest(y1, y2)) / tile_h - 0.5D - {SLACK}), r_min) AS r_first",
        f"least(floor((oy - least(y1, y2)) / tile_h - 0.5D + {SLACK}), r_max) AS r_last",
    ).selectExpr("*", f"explode({_sequence('r_first', 'r_last')}) AS grow")
    # Nulls go inside the generator: as a filter, the optimizer would repeat the expression.
    flips = _with_flip(rows).selectExpr(
        "fid", "grid_id", "grow", "explode(filter(array(flip), f -> f IS NOT NULL)) AS flip")
    odd = flips.groupBy("fid", "grid_id", "grow", "flip").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.groupBy("fid", "grid_id", "grow").agg(F.expr("sort_array(collect_list(flip)) AS flips"))


# --- joins of features with tiles ------------------------------------------------------------

def tile_features(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Inner join: one row per tile and feature that intersects its closed rectangle."""
    gridded = with_grid(tiles)
    covered = coverage(features, grids_of(gridded), region_size)
    return covered.join(gridded, GRID_KEY).select("fid", "is_inside", *tiles.columns)


def tiles_with_features(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Left outer join: as tile_features, and tiles without a feature once, with a null fid."""
    gridded = with_grid(tiles)
    covered = coverage(features, grids_of(gridded), region_size)
    return gridded.join(covered, GRID_KEY, "left").select("fid", "is_inside", *tiles.columns)


def features_on_tiles(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Semi join: the features that intersect at least one tile."""
    features = once(features)
    hit = tile_features(tiles, features, region_size).select("fid").distinct()
    return features.join(hit, "fid", "left_semi")


def tiles_without_features(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Anti join: the tiles that no feature intersects."""
    gridded = with_grid(tiles)
    covered = coverage(features, grids_of(gridded), region_size)
    return gridded.join(covered, GRID_KEY, "left_anti").select(*tiles.columns)


def tiles_in_extents(tiles: DataFrame, extents: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Pairs of a tile and a query envelope that overlap, touching edges excluded.

    Each envelope is spelled out as the grid keys it covers, then equi-joined.
    ``extents`` rows: query_id, xmin, ymin, xmax, ymax.
    """
    gridded = with_grid(tiles)
    as_feature = extents.selectExpr(
        "query_id AS fid", f"array(array({geo.point('xmin', 'ymin')}, {geo.point('xmax', 'ymax')})) AS rings")
    keys = (
        match_grids(as_feature, grids_of(gridded), region_size)
        .selectExpr("*", "rings[0][0] AS a", "rings[0][1] AS b")
        .selectExpr(
            "*",
            "greatest(floor((a.x - ox) / tile_w), c_min) AS c_first", "least(ceil((b.x - ox) / tile_w) - 1, c_max) AS c_last",
            "greatest(floor((oy - b.y) / tile_h), r_min) AS r_first", "least(ceil((oy - a.y) / tile_h) - 1, r_max) AS r_last")
        .selectExpr("*", f"explode({_sequence('r_first', 'r_last')}) AS grow")
        .selectExpr("fid AS query_id", "grid_id", "grow", f"explode({_sequence('c_first', 'c_last')}) AS gcol")
    )
    return keys.join(gridded, GRID_KEY).select("query_id", *tiles.columns)


def tiles_in_extent(tiles: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Tiles that overlap one literal envelope; four range predicates that reach the scan."""
    return tiles.where(
        (F.col("xmin") < float(xmax)) & (F.col("xmax") > float(xmin))
        & (F.col("ymin") < float(ymax)) & (F.col("ymax") > float(ymin))
    )


# --- joins of features with features ---------------------------------------------------------

# Pairs of edges up to which two features are compared edge by edge, in one expression.
DIRECT_PAIRS = 1 << 14
# Polygons with up to so many edges and rings have them as columns when they are compared.
FEW_EDGES, FEW_RINGS = 8, 2
# They are compared so if pairs can be this many: compiling the comparison takes longer than a few million of them as arrays.
COMPILED_FROM = 1 << 30
# Bounds of an endless grid, in bins.
FAR = 1 << 40
# When a bin is crowded, and how far it is cut: to about so many edges, at most 2^MAX_SPLIT parts a side.
PAIRS_PER_BIN = 1 << 16
EDGES_PER_BIN = 64
MAX_SPLIT = 10


def _on_bins(features: DataFrame, bin_size: float) -> DataFrame:
    """Features on an endless grid of square bins; no extent is needed, so nothing is joined."""
    return features.selectExpr(
        "fid", "rings", "'bins' AS grid_id", "0D AS ox", "0D AS oy",
        f"{float(bin_size)}D AS tile_w", f"{float(bin_size)}D AS tile_h",
        f"bigint(-{FAR}) AS c_min", f"bigint({FAR}) AS c_max", f"bigint(-{FAR}) AS r_min", f"bigint({FAR}) AS r_max",
    )


def _binned_edges(features: DataFrame, bin_size: float, prefix: str) -> DataFrame:
    rows = _with_column_range(_edge_rows(_on_bins(features, bin_size)))
    return rows.selectExpr(
        f"explode({_touched()}) AS gcol", "grow", *[f"{c} AS {prefix}{c}" for c in ("fid", "x1", "y1", "x2", "y2")])


def _split_hot_bins(a: DataFrame, b: DataFrame, bin_size: float, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Cut the bins in which more than ``pairs`` pairs of edges would be compared.

    A crowded bin becomes 2^n x 2^n smaller ones, so that about ``EDGES_PER_BIN``
    edges of a side stay together; edges keep to the parts they touch.  Without a
    crowded bin the side with the counts is empty and falls out of the plan.
    """
    def counted(edges: DataFrame, name: str) -> DataFrame:
        return edges.groupBy("gcol", "grow").agg(F.count("*").alias(name))

    crowded = counted(a, "n_a").join(counted(b, "n_b"), ["gcol", "grow"]).where(f"n_a * n_b > {int(pairs)}").selectExpr(
        "gcol", "grow",
        f"bigint(pow(2, least({MAX_SPLIT}, greatest(1, ceil(log2(greatest(n_a, n_b) / {EDGES_PER_BIN}) / 2))))) AS parts")

    def split(edges: DataFrame, prefix: str) -> DataFrame:
        size = f"{float(bin_size)}D"
        placed = edges.join(crowded, ["gcol", "grow"], "left").selectExpr(
            "gcol AS bin_col", "grow AS bin_row", f"{prefix}fid",
            *[f"{prefix}{c} AS {c}" for c in ("x1", "y1", "x2", "y2")],
            f"gcol * {size} AS ox", f"-grow * {size} AS oy",
            f"{size} / coalesce(parts, 1L) AS tile_w", f"{size} / coalesce(parts, 1L) AS tile_h", "parts IS NULL AS is_whole",
            "0L AS c_min", "coalesce(parts, 1L) - 1 AS c_max", "0L AS r_min", "coalesce(parts, 1L) - 1 AS r_max")
        return _with_column_range(_over_rows(placed)).selectExpr(
            "bin_col", "bin_row", f"explode(if(is_whole, array(0L), {_touched()})) AS gcol", "grow", f"{prefix}fid",
            *[f"{c} AS {prefix}{c}" for c in ("x1", "y1", "x2", "y2")])

    return split(a, "a_"), split(b, "b_")


def _contained(inner: DataFrame, outer: DataFrame, bin_size: float) -> DataFrame:
    """(inner, outer) pairs where the first vertex of some inner ring is inside outer.

    A vertex in a bin wholly inside is decided by the bin.  In a boundary bin its
    ray is tested against the outer feature's edges in the same row of bins.
    """
    starts = inner.selectExpr(
        "fid AS inner_fid", "posexplode(transform(filter(rings, r -> size(r) > 0), r -> r[0])) AS (ring_no, p)"
    ).selectExpr(
        "inner_fid", "ring_no", "p.x AS vx", "p.y AS vy",
        f"floor(p.x / {float(bin_size)}D) AS gcol", f"floor(-p.y / {float(bin_size)}D) AS grow")
    # A row of bins is decided by the edges in it, so rows without a vertex can go first.
    outer_rows = _edge_rows(_on_bins(outer, bin_size)).join(starts.select("grow"), "grow", "left_semi")
    cover = _cover_rows(outer_rows).selectExpr("fid AS outer_fid", "gcol", "grow", "is_inside")
    near = starts.join(cover, ["gcol", "grow"])
    tested = near.withColumn("on_boundary", F.expr("NOT is_inside")).join(
        outer_rows.selectExpr("fid AS outer_fid", "grow", "x1", "y1", "x2", "y2", "true AS on_boundary"),
        ["outer_fid", "grow", "on_boundary"], "left")
    crossed = F.expr(f"count_if({geo.ray_crosses('vx', 'vy')})")
    return tested.groupBy("inner_fid", "ring_no", "outer_fid").agg(
        F.expr("bool_or(is_inside)").alias("sure"), crossed.alias("n")
    ).where("sure OR n % 2 = 1").select("inner_fid", "outer_fid")


def _share_a_point() -> str:
    """Two polygons (edges ea and eb, rings a_rings and b_rings): an edge of one meets one of the other, or a ring of one starts inside the other."""
    def starts_in(rings: str, edges: str) -> str:
        crossed = f"filter({edges}, f -> {geo.ray_crosses('r[0].x', 'r[0].y', 'f.x1', 'f.y1', 'f.x2', 'f.y2')})"
        return f"exists({rings}, r -> size(r) > 0 AND size({crossed}) % 2 = 1)"

    return (f"(exists(ea, e -> exists(eb, f -> {geo.segments_meet('e.', 'f.')})) OR "
            f"{starts_in('a_rings', 'eb')} OR {starts_in('b_rings', 'ea')})")


def _is_few() -> str:
    """The polygon has few edges in few rings, and no coordinate that is missing or not finite."""
    finite = "p.x BETWEEN -1e300D AND 1e300D AND p.y BETWEEN -1e300D AND 1e300D"
    return (f"coalesce(size(rings) BETWEEN 1 AND {FEW_RINGS} AND {geo.vertex_count('rings')} - size(rings) <= {FEW_EDGES} "
            f"AND forall(rings, r -> size(r) > 1 AND forall(r, p -> {finite})), false)")


def _edge_columns(few: DataFrame, p: str) -> DataFrame:
    """Polygons of few edges with a column for each coordinate of each edge, x1 <= x2, the first edge of every ring in front.

    Places that are left hold the first vertex as an edge to itself, which meets what the polygon meets anyway and crosses no ray.
    """
    keys = [f"{p}{c}" for c in ("fid", *geo.EXTENT, "n", "size")]
    by_ring = few.selectExpr(*keys, f"""transform(rings, r -> transform({geo.edges('array(r)')}, e -> if(
        e.x1 <= e.x2, e, named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1)))) AS by_ring""")
    placed = by_ring.selectExpr(
        *keys, f"size(by_ring) AS {p}starts",
        "concat(transform(by_ring, s -> s[0]), flatten(transform(by_ring, s -> slice(s, 2, size(s) - 1)))) AS e")
    places = [f"coalesce(get(e, {i}).{c}, get(e, 0).{c[0]}1, 0D) AS {p}{c}_{i}" for i in range(FEW_EDGES) for c in ("x1", "y1", "x2", "y2")]
    return placed.selectExpr(*keys, f"{p}starts", f"size(e) AS {p}edges", *places)


def _few_share_a_point() -> str:
    """_share_a_point() of polygons as _edge_columns() has them: no array and no lambda, so all of it is compiled."""
    def any_of(tests: list[str], count: str, at: int = 0) -> str:
        """One of the first ``count`` tests holds."""
        rest = f" OR {any_of(tests, count, at + 1)}" if at + 1 < len(tests) else ""
        return f"({count} > {at} AND ({tests[at]}{rest}))"

    def edge(p: str, i: int) -> list[str]:
        return [f"{p}{c}_{i}" for c in ("x1", "y1", "x2", "y2")]

    def in_reach(i: int) -> str:
        x1, y1, x2, y2 = edge("a_", i)
        return (f"{x1} <= b_xmax AND {x2} >= b_xmin"
                f" AND ({y1} <= b_ymax OR {y2} <= b_ymax) AND ({y1} >= b_ymin OR {y2} >= b_ymin)")

    def starts_in(p: str, q: str) -> str:
        def inside(i: int) -> str:
            x, y = edge(p, i)[:2]
            odd = " <> ".join(["false", *[geo.ray_crosses(x, y, *edge(q, j)) for j in range(FEW_EDGES)]])
            return f"({x} BETWEEN {q}xmin AND {q}xmax AND {y} BETWEEN {q}ymin AND {q}ymax AND ({odd}))"

        return any_of([inside(i) for i in range(FEW_RINGS)], f"{p}starts")

    met = [f"({in_reach(i)} AND {any_of([geo.edges_meet(edge('a_', i), edge('b_', j), True) for j in range(FEW_EDGES)], 'b_edges')})"
           for i in range(FEW_EDGES)]
    return f"({any_of(met, 'a_edges')} OR {starts_in('a_', 'b_')} OR {starts_in('b_', 'a_')})"


def _near(left: DataFrame, right: DataFrame, condition: str, width: float, left_levels: list[int], right_levels: list[int]) -> DataFrame:
    """envelope_pairs() for sides of many rows, of which most have sizes (a_size, b_size) around ``width``.

    Those are all laid out on squares of that width; what is far larger or smaller goes on levels of its own, 4^level times as
    wide.  A pair is looked for on the coarser of its levels only, in the square where the later of the two begins.
    """
    one = left_levels == right_levels and len(left_levels) == 1  # then both sides of a join with itself are one shuffle

    def squares(df: DataFrame, p: str, q: str, levels: list[int]) -> DataFrame:
        if one:
            at = df.withColumn("side", F.lit(width * 4.0 ** levels[0]))
        else:
            at = df.selectExpr("*", f"{_size_level(f'{p}size', width)} AS {p}level").selectExpr(
                "*", f"explode(array({', '.join(map(str, levels))})) AS {q}level")
            at = at.selectExpr("*", f"{width!r}D * pow(4D, greatest(a_level, b_level)) AS side")
        for axis in ("x", "y"):
            at = at.selectExpr("*", f"floor({p}{axis}min / side) AS low", f"floor({p}{axis}max / side) AS high").selectExpr(
                "*", f"explode(sequence(low, high)) AS r{axis}").selectExpr("*", f"r{axis} = low AS {p}first_{axis}").drop("low", "high")
        return at.drop("side", f"{p}size")

    reach = f"""({condition}) AND a_xmin <= b_xmax AND a_xmax >= b_xmin AND a_ymin <= b_ymax AND a_ymax >= b_ymin
        AND (a_first_x OR b_first_x) AND (a_first_y OR b_first_y)"""
    # Many pairs come of few bytes, so neither side is broadcast however small it is: the work would stay in the tasks of the other's files.
    a, b = squares(left, "a_", "b_", right_levels), squares(right, "b_", "a_", left_levels)
    keys = ["rx", "ry"] if one else ["a_level", "b_level", "rx", "ry"]
    return a.hint("merge").join(b, keys).where(reach).drop(*keys)


def _size_level(size: str, width: float) -> str:
    """The level of _near() for rectangles of a size: 0 from an eighth of ``width`` to four times as much."""
    return (f"int(CASE WHEN {size} > {4 * width!r}D THEN least({TOP_LEVEL}, ceil(log(4D, {size} / {4 * width!r}D))) "
            f"WHEN {size} <= {width / 8!r}D THEN greatest({LOW_LEVEL}, ceil(log(4D, {size} / {width / 2!r}D))) ELSE 0 END)")


def _levels_of(octaves: list[int], width: float) -> list[int]:
    """Levels that sizes within the given powers of two can have."""
    def level(size: float) -> int:
        if size > 4 * width:
            return min(TOP_LEVEL, math.ceil(math.log(size / (4 * width), 4)))
        return max(LOW_LEVEL, math.ceil(math.log(size / (width / 2), 4))) if size <= width / 8 else 0

    return sorted({k for o in octaves for k in range(level(2.0 ** o * 0.999), level(2.0 ** (o + 1) * 1.001) + 1)})


def features_intersect(left: DataFrame, right: DataFrame, bin_size: float,
                       pairs_per_bin: int = PAIRS_PER_BIN, direct_pairs: int = DIRECT_PAIRS, ordered: bool = False,
                       compiled_from: int = COMPILED_FROM) -> DataFrame:
    """(left_fid, right_fid) of every pair of polygons that share a point; with ``ordered`` only where left_fid < right_fid.

    Envelopes are paired first.  If there are many, polygons of few edges (``FEW_EDGES``) take them along as columns and are compared
    where envelopes meet.  Two others with up to ``direct_pairs`` pairs of edges are compared as they are, in one expression;
    those with more go by bins (``_by_bins``), where each edge meets only those near it.
    """
    condition = "a_fid < b_fid" if ordered else "true"

    def side(features: DataFrame, p: str) -> DataFrame:
        """Spread over tasks first: the files of many small features are few."""
        stored = [c for c in ("env",) if c in features.columns]
        spread = drawn(features.select("fid", *stored, "rings").repartition("fid"))
        sides = _with_sides(spread, p).selectExpr("*", f"{geo.vertex_count('rings')} AS {p}n", f"{_is_few()} AS few")
        size = f"greatest({p}xmax - {p}xmin, {p}ymax - {p}ymin, pow(4D, {LOW_LEVEL}))"
        return sides.selectExpr(f"fid AS {p}fid", *[p + s for s in geo.EXTENT], f"{p}n", f"{size} AS {p}size", "few", "rings")

    def known_of(df: DataFrame, p: str):
        return df.agg(
            F.max(f"{p}n").alias("most"), F.collect_set(_level(p)).alias("levels"),
            F.expr(f"coalesce(bool_or(NOT few AND {p}n > 0), false)").alias("others"), F.expr(f"count({p}fid) > count(DISTINCT {p}fid)").alias("repeats"),
            F.expr(f"sum(ln({p}size)) FILTER (WHERE few)").alias("logs"), F.expr("count_if(few)").alias("n"),
            F.expr(f"collect_set(int(floor(log2({p}size)))) FILTER (WHERE few)").alias("octaves")).first()

    a, b = side(left, "a_"), side(right, "b_")
    known = [known_of(a, "a_")]
    known.append(known[0] if right is left else known_of(b, "b_"))
    if known[0].n * known[1].n < max(1, compiled_from):
        return functools.reduce(DataFrame.unionByName, _of_many_edges(
            a.withColumn("few", F.lit(False)), b.withColumn("few", F.lit(False)), condition, known, bin_size, pairs_per_bin, direct_pairs))
    repeats = any(k.repeats for k in known)
    if repeats:  # ids that are said to be different and are not: every row of one stands for all of them
        def single(df: DataFrame, p: str) -> DataFrame:
            again = df.groupBy(f"{p}fid").agg((F.count("*") > 1).alias("again"))
            return df.join(again, f"{p}fid").withColumn("few", F.expr("few AND NOT again")).drop("again")

        a, b = single(a, "a_"), single(b, "b_")
    width = 2 ** 0.5 * math.exp((known[0].logs + known[1].logs) / (known[0].n + known[1].n))
    # The partition's number keeps a condition where it is: here, behind the shuffle that spreads the polygons.
    few = [_edge_columns(df.where(f"if(spark_partition_id() < 0, false, few AND {p}fid IS NOT NULL)"), p) for df, p in ((a, "a_"), (b, "b_"))]
    bounded = f"{condition} AND a_n * b_n <= {int(direct_pairs)}" if direct_pairs < (FEW_EDGES + FEW_RINGS) ** 2 else condition
    near = _near(*few, bounded, width, *[_levels_of(k.octaves, width) for k in known])
    # And here, outside the join's compiled function, which the test would make too long; with a lambda beside it, it is cut into short ones.
    met = near.where(f"if(spark_partition_id() < 0, exists(array(a_starts), x -> x < 0), {_few_share_a_point()})")
    parts = [met.select(F.col("a_fid").alias("left_fid"), F.col("b_fid").alias("right_fid"))]
    if repeats or any(k.others for k in known) or known[0].most * known[1].most > direct_pairs:
        parts += _of_many_edges(a, b, condition, known, bin_size, pairs_per_bin, direct_pairs)
    return functools.reduce(DataFrame.unionByName, parts)


def _of_many_edges(a: DataFrame, b: DataFrame, condition: str, known: list, bin_size: float, pairs_per_bin: int, direct_pairs: int) -> list[DataFrame]:
    """The pairs of features_intersect() that are not of two polygons of few edges, and those beyond ``direct_pairs``."""
    counted = [df.select(f"{p}fid", *[p + s for s in geo.EXTENT], f"{p}n", F.col("few").alias(f"{p}few")) for df, p in ((a, "a_"), (b, "b_"))]
    pairs = envelope_pairs(*counted, condition, None, known[0].levels, known[1].levels)
    small = pairs.where(f"a_n * b_n <= {int(direct_pairs)} AND NOT (a_few AND b_few)").select("a_fid", "b_fid")
    rings = [df.select(F.col(f"{p}fid"), F.col("rings").alias(f"{p}rings")) for df, p in ((a, "a_"), (b, "b_"))]
    shapes = small.join(rings[0], "a_fid").join(rings[1], "b_fid").selectExpr(
        "a_fid", "b_fid", "a_rings", "b_rings", f"{geo.edges('a_rings')} AS ea", f"{geo.edges('b_rings')} AS eb")
    # The test is made inside a generator: as a filter, the optimizer would copy the edges into it.
    direct = shapes.selectExpr(f"inline(if({_share_a_point()}, array(struct(a_fid AS left_fid, b_fid AS right_fid)), "
                               "cast(array() AS array<struct<left_fid:bigint,right_fid:bigint>>)))")
    if (known[0].most or 0) * (known[1].most or 0) <= direct_pairs:
        return [direct]
    large = pairs.where(f"a_n * b_n > {int(direct_pairs)}").select(F.col("a_fid").alias("left_fid"), F.col("b_fid").alias("right_fid"))
    left, right = (df.select(F.col(f"{p}fid").alias("fid"), "rings") for df, p in ((a, "a_"), (b, "b_")))
    met = _by_bins(left.join(large, left["fid"] == large["left_fid"], "left_semi"),
                   right.join(large, right["fid"] == large["right_fid"], "left_semi"), bin_size, pairs_per_bin)
    return [direct, met.join(large, ["left_fid", "right_fid"], "left_semi")]


def _by_bins(left: DataFrame, right: DataFrame, bin_size: float, pairs_per_bin: int) -> DataFrame:
    """features_intersect() of drawn features by edges.

    Either two edges meet, found by an equi-join on bins with the exact segment
    test, or one polygon lies inside the other.
    """
    a, b = _split_hot_bins(
        _binned_edges(left, bin_size, "a_"), _binned_edges(right, bin_size, "b_"), bin_size, pairs_per_bin)
    meeting = a.join(b, ["bin_col", "bin_row", "gcol", "grow"]).where(geo.segments_meet("a_", "b_")).selectExpr(
        "a_fid AS left_fid", "b_fid AS right_fid")
    in_right = _contained(left, right, bin_size).selectExpr("inner_fid AS left_fid", "outer_fid AS right_fid")
    in_left = _contained(right, left, bin_size).selectExpr("outer_fid AS left_fid", "inner_fid AS right_fid")
    return meeting.union(in_right).union(in_left).distinct()
