"""GeoTIFF ingest: uncompressed baseline files to cells.

Only headers are read to plan the work.  Each strip or tile of pixels is then a
row of its own, spread over the cluster and read as a byte range, so a file of
any size is never held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.constants import TILE_SIZE
from tilequarry.operators import layout, scenes
from tilequarry.session import kept

# Fixed values of the file format: tag numbers and sizes of field types.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "bands": 277,
    "rows_per_strip": 278, "strip_sizes": 279, "planar": 284, "tile_width": 322, "tile_height": 323,
    "tile_offsets": 324, "tile_sizes": 325, "sample_format": 339, "pixel_scale": 33550, "tie_point": 33922,
    "geo_keys": 34735, "nodata": 42113,
}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4),
         12: ("d", 8)}
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}
PROJECTED_CRS_KEY, GEOGRAPHIC_CRS_KEY = 3072, 2048

BLOCKS = """path string, dataset_uid string, block int, offset bigint, size bigint, px int, py int, width int, height int,
image_width int, image_height int, bands int, planar int, band int, dtype string, nodata double,
x0 double, y0 double, cell_w double, cell_h double, epsg int"""


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per block of pixels of each file."""
    import struct

    from pyarrow import fs

    names = {number: name for name, number in TAGS.items()}

    def header(path: str) -> dict:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            start = f.read(8)
            order = {b"II": "<", b"MM": ">"}.get(start[:2])
            if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
                raise ValueError(f"{path}: not a baseline TIFF file")
            f.seek(struct.unpack(order + "I", start[4:8])[0])
            count = struct.unpack(order + "H", f.read(2))[0]
            entries = f.read(12 * count)
            found = {"order": order}
            for i in range(count):
                tag, kind, n, value = struct.unpack(order + "HHI4s", entries[12 * i:12 * i + 12])
                if tag not in names or kind not in TYPES:
                    continue
                code, width = TYPES[kind]
                if n * width > 4:
                    f.seek(struct.unpack(order + "I", value)[0])
                    value = f.read(n * width)
                if code == "s":
                    found[names[tag]] = value[:n].split(b"\0")[0].decode("ascii")
                else:
                    found[names[tag]] = struct.unpack(f"{order}{n}{code}", value[:n * width])
            return found

    def blocks(path: str, uid: str) -> list[tuple]:
        h = header(path)

        def one(name: str, default: int | None = None) -> int:
            return h[name][0] if name in h else default

        if one("compression", 1) != 1:
            raise ValueError(f"{path}: compressed files are not supported")
        width, height, bands, planar = one("width"), one("height"), one("bands", 1), one("planar", 1)
        bits = set(h.get("bits", (1,)))
        if len(bits) != 1 or bits & {1, 2, 4}:
            raise ValueError(f"{path}: all bands need the same whole number of bytes")
        dtype = h["order"] + SAMPLE_KINDS[one("sample_format", 1)] + str(bits.pop() // 8)
        if "pixel_scale" not in h or "tie_point" not in h:
            raise ValueError(f"{path}: no pixel scale and tie point")
        cell_w, cell_h = h["pixel_scale"][:2]
        col, row, _, x, y, _ = h["tie_point"][:6]
        keys = h.get("geo_keys", ())
        crs = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        epsg = crs.get(PROJECTED_CRS_KEY, crs.get(GEOGRAPHIC_CRS_KEY, 0))
        if "tile_offsets" in h:
            bw, bh, offsets, sizes = one("tile_width"), one("tile_height"), h["tile_offsets"], h["tile_sizes"]
        else:
            bw, bh = width, min(one("rows_per_strip", height), height)
            offsets, sizes = h["strip_offsets"], h["strip_sizes"]
        across, down = -(-width // bw), -(-height // bh)
        rows = []
        for i, (offset, size) in enumerate(zip(offsets, sizes)):
            place = i % (across * down)
            py = place // across * bh
            tall = bh if "tile_offsets" in h else min(bh, height - py)
            rows.append((path, uid, i, offset, size, place % across * bw, py, bw, tall, width, height, bands, planar,
                         i // (across * down), dtype, float(h["nodata"]) if h.get("nodata") else None,
                         x - col * cell_w, y + row * cell_h, cell_w, cell_h, epsg))
        return rows

    columns = [c.split()[0] for c in BLOCKS.replace("\n", " ").split(",")]
    for batch in batches:
        yield pd.DataFrame([r for p, uid in zip(batch["path"], batch["uid"]) for r in blocks(p, uid)], columns=columns)


def _block_values(b):
    """The pixels of a block that lie in its image, (row, column, band) of doubles; NODATA is NaN."""
    import numpy as np
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(b.path)
    with store.open_input_file(inner) as f:
        f.seek(b.offset)
        data = np.frombuffer(f.read(b.size), dtype=b.dtype).astype("float64")
    data = data.reshape(b.height, b.width, b.bands if b.planar == 1 else 1)
    data = data[:b.image_height - b.top, :b.image_width - b.left, :]
    if b.nodata is not None and not np.isnan(b.nodata):
        data = np.where(data == b.nodata, np.nan, data)
    return data


def _read_pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decode blocks: one row per pixel and band."""
    import numpy as np

    for batch in batches:
        for b in batch.itertuples(index=False):
            data = _block_values(b)
            rows, cols, n = data.shape
            ys, xs, bs = np.meshgrid(np.arange(rows), np.arange(cols), np.arange(n), indexing="ij")
            yield pd.DataFrame({
                "dataset_uid": b.dataset_uid, "px": (b.px + xs).ravel().astype("int32"),
                "py": (b.py + ys).ravel().astype("int32"),
                "band": (bs + (0 if b.planar == 1 else b.band)).ravel().astype("int32"),
                "v": data.ravel(), "x0": b.x0, "y0": b.y0, "cell_w": b.cell_w, "cell_h": b.cell_h, "epsg": b.epsg,
            })


FRAGMENTS = """dataset_uid string, scene string, col int, row_ int, x0 double, y0 double, cell_w double, cell_h double,
band int, lx int, ly int, w int, h int, vals array<double>"""


def _fragment_reader(tile_size: int):
    """Decode blocks: a row for each band and tile that a block lies on, its pixels as one array."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FRAGMENTS.replace("\n", " ").split(",")]

        def cuts(start: int, length: int) -> list[tuple[int, int, int]]:
            """(tile, from, to) along one axis, counted in the block."""
            edges = [start, *range((start // tile_size + 1) * tile_size, start + length, tile_size), start + length]
            return [(a // tile_size, a - start, z - start) for a, z in zip(edges, edges[1:])]

        for batch in batches:
            for b in batch.itertuples(index=False):
                data = _block_values(b)
                found = []
                for row, y1, y2 in cuts(b.py, data.shape[0]):
                    for col, x1, x2 in cuts(b.px, data.shape[1]):
                        place = (b.px + x1 - col * tile_size, b.py + y1 - row * tile_size, x2 - x1, y2 - y1)
                        found += [(b.dataset_uid, b.scene, col, row, b.x0, b.y0, b.cell_w, b.cell_h,
                                   (b.band if b.planar != 1 else i) + 1, *place, data[y1:y2, x1:x2, i].ravel())
                                  for i in range(data.shape[2])]
                yield pd.DataFrame(found, columns=names)

    return read


def geotiff_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all .tif files under a path, from their headers alone.

    ``dataset_uid`` is the file's name; where several folders under the path hold files of one
    name, a hash of the whole path follows it.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true")
        .load(path).select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"))
    )
    shared = files.groupBy("name").agg((F.count("*") > 1).alias("shared"))
    named = files.join(shared, "name").select("path", F.when(
        F.col("shared"), F.concat_ws("-", "name", F.substring(F.sha2("path", 256), 1, 12))).otherwise(F.col("name")).alias("uid"))
    return named.mapInPandas(_by_value(_read_headers), BLOCKS)


def block_headers(blocks: DataFrame) -> DataFrame:
    """What ``scenes.common_grid`` needs to know of each scene."""
    return blocks.selectExpr("dataset_uid", "x0", "y0", "cell_w", "cell_h", "image_width AS nx", "image_height AS ny", "epsg").distinct()


def _spread(blocks: DataFrame, partitions: int | None) -> DataFrame:
    """Blocks dealt evenly before any pixel is read; their place in the image is kept beside that on the grid."""
    placed = blocks if "left" in blocks.columns else blocks.withColumns({"left": F.col("px"), "top": F.col("py")})
    return placed.repartition(partitions, "path", "block") if partitions else placed.repartition("path", "block")


def read_geotiff(spark: SparkSession, path: str, n_bands: int, partitions: int | None = None) -> DataFrame:
    """Cells of all .tif files under a path: dataset_uid (see ``geotiff_blocks``), px, py, b1..bN, epsg.

    Blocks are spread evenly before any pixel is read.
    """
    pixels = _spread(geotiff_blocks(spark, path), partitions).mapInPandas(
        _by_value(_read_pixels),
        "dataset_uid string, px int, py int, band int, v double, x0 double, y0 double, cell_w double, cell_h double, epsg int")
    value = F.when(~F.isnan("v"), F.col("v"))
    cells = pixels.groupBy("dataset_uid", "px", "py", "x0", "y0", "cell_w", "cell_h", "epsg").agg(*[
        F.max(F.when(F.col("band") == i, value)).alias(f"b{i + 1}") for i in range(n_bands)
    ])
    return layout.cell_center(cells)


def _fragments(blocks: DataFrame, tile_size: int, partitions: int | None) -> DataFrame:
    read = _spread(blocks, partitions).mapInPandas(_by_value(_fragment_reader(int(tile_size))), FRAGMENTS)
    return read.withColumn("vals", F.transform("vals", lambda v: F.when(~F.isnan(v), v)))


def read_fragments(spark: SparkSession, path: str, tile_size: int = TILE_SIZE, partitions: int | None = None) -> DataFrame:
    """Fragments of all .tif files under a path, each scene on its own grid.

    Blocks are cut at the edges of tiles where they are decoded, so that ``scenes.assemble_fragments``
    moves a few arrays a tile and band, not a row for each pixel.
    """
    blocks = geotiff_blocks(spark, path).withColumn("scene", F.col("dataset_uid"))
    return _fragments(blocks, tile_size, partitions)


def read_layer_fragments(spark: SparkSession, path: str, layer: str, tile_size: int = TILE_SIZE,
                         partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fragments of all .tif files under a path on the one grid that they fit, and that grid.

    The headers are read once and stored; pixels are read once, when the fragments are used.
    """
    blocks = kept(geotiff_blocks(spark, path), "blocks")
    grid = kept(scenes.common_grid(block_headers(blocks), layer, tile_size), "grid")
    placed = scenes.on_grid(blocks.withColumns({"left": F.col("px"), "top": F.col("py")}), grid)
    return _fragments(placed, tile_size, partitions), grid


def _by_value(fn):
    """Ship the function's module with it, so that executors need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[fn.__module__])
    return fn
