"""Raster work over long pixel tables.

A raster is a table of (row, col, value). Lookups go through *blocks*: square
pieces of the raster with a halo, one array per block, so a sample needs one
equi-join row instead of four, and focal filters need no further shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgecast.functions.geo import (
    Grid,
    KM_PER_DEGREE,
    as_col,
    mercator_x,
    mercator_y,
    round_half_up,
    round_pixel,
    tile_bounds_m,
    tile_x,
    tile_y,
)
from ridgecast.session import BROADCAST_BYTES

NODATA_BELOW = -30000.0


def valid_elevation(value: Column | str, above: float = NODATA_BELOW) -> Column:
    """NaN, infinities and nodata codes become NULL."""
    v = as_col(value)
    finite = ~F.isnan(v) & (v < F.lit(float("inf"))) & (v > F.lit(above))
    return F.when(finite, v)


def to_blocks(
    pixels: DataFrame, grid: Grid, value: str, size: int = 32, lead: int = 0, trail: int = 1, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, brow, bcol, vals): every block with ``lead`` pixels before and ``trail`` after it.

    ``vals`` has the stride size+lead+trail; absent pixels are NULL. A group holds at
    most one block, so no group grows with the raster.
    """
    stride = size + lead + trail
    last_row, last_col = (grid.height - 1) // size, (grid.width - 1) // size

    def owners(axis: str, last: int) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - trail) / size).cast("int"))
        high = F.least(F.lit(last), F.floor((F.col(axis) + lead) / size).cast("int"))
        return F.explode(F.sequence(low, high))

    spread = (
        pixels.select(*keys, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).alias("_v"))
        .withColumn("brow", owners("row", last_row))
        .withColumn("bcol", owners("col", last_col))
    )
    index = (F.col("row") - F.col("brow") * size + lead) * stride + (F.col("col") - F.col("bcol") * size + lead)
    gathered = spread.groupBy(*keys, "brow", "bcol").agg(
        F.sort_array(F.collect_list(F.struct(index.alias("i"), F.col("_v").alias("v")))).alias("_cells")
    )
    cells = F.col("_cells")
    filler = F.lit(None).cast(dict(pixels.dtypes)[value])
    before = F.concat(
        F.array(F.struct(F.lit(-1).alias("i"), filler.alias("v"))), F.slice(cells, F.lit(1), F.size(cells) - 1)
    )
    with_gaps = F.flatten(
        F.zip_with(
            cells, before, lambda now, prev: F.concat(F.array_repeat(filler, now["i"] - prev["i"] - 1), F.array(now["v"]))
        )
    )
    dense = F.transform(cells, lambda c: c["v"])
    return gathered.select(
        *keys, "brow", "bcol", F.when(F.size(cells) == stride * stride, dense).otherwise(with_gaps).alias("vals")
    )


@dataclass
class BlockRaster:
    """Blocks of one raster (or one raster per key) ready for lookups."""

    blocks: DataFrame
    grid: Grid
    size: int = 32
    keys: tuple[str, ...] = ()
    small: bool = False

    @staticmethod
    def of(pixels: DataFrame, grid: Grid, value: str = "elev", size: int = 32, keys: tuple[str, ...] = ()) -> BlockRaster:
        # The grid bounds the size of an unkeyed raster, so the broadcast choice is proven.
        small = not keys and grid.width * grid.height * 9 <= BROADCAST_BYTES
        return BlockRaster(to_blocks(pixels, grid, value, size, keys=keys), grid, size, keys, small)

    def persisted(self) -> BlockRaster:
        self.blocks = self.blocks.persist()
        return self

    def _joined(self, points: DataFrame, col0: Column, row0: Column) -> DataFrame:
        """Points with the block that holds pixel (row0, col0); none outside the grid."""
        inside = self.grid.contains(col0, row0)
        # Positions off the grid get scattered keys that match nothing, so they never pile up on one NULL key.
        off = -1 - F.pmod(F.xxhash64(row0, col0), F.lit(4096)).cast("int")
        placed = points.withColumn("_r0", row0).withColumn("_c0", col0)
        placed = placed.withColumn("brow", F.when(inside, F.floor(F.col("_r0") / self.size).cast("int")).otherwise(off))
        placed = placed.withColumn("bcol", F.when(inside, F.floor(F.col("_c0") / self.size).cast("int")).otherwise(F.lit(-1)))
        right = F.broadcast(self.blocks) if self.small else self.blocks
        return placed.join(right, [*self.keys, "brow", "bcol"], "left")

    def _pixel(self, row: Column, col: Column) -> Column:
        stride = self.size + 1
        local = (row - F.col("brow") * self.size) * stride + (col - F.col("bcol") * self.size)
        return F.get(F.col("vals"), local.cast("int")).cast("double")

    _scratch = ("_r0", "_c0", "brow", "bcol", "vals", "_v00", "_v10", "_v01", "_v11", "_fx", "_fy", "_near")

    def nearest(self, points: DataFrame, row: Column, col: Column, out: str) -> DataFrame:
        """Value of an integer pixel."""
        joined = self._joined(points, col.cast("int"), row.cast("int"))
        return joined.withColumn(out, self._pixel(F.col("_r0"), F.col("_c0"))).drop(*self._scratch)

    def bilinear(self, points: DataFrame, row: str, col: str, out: str, rule: str = "shared") -> DataFrame:
        """Weighted mean of four pixels.

        ``shared``: positions beyond the last pixel centre are outside, neighbours are
        clamped, any missing neighbour gives NULL. ``strict``: a neighbour counts only
        when its weight is above zero, and must then exist.
        ``expanded``: as ``shared``, with the product terms written out (last-digit differences).
        ``edge``: as ``expanded`` for a grid-to-grid resampling, nearest pixel on the border.
        """
        w, h = self.grid.width, self.grid.height
        r, c = F.col(row), F.col(col)
        base_r, base_c = F.floor(r).cast("int"), F.floor(c).cast("int")
        if rule in ("shared", "expanded"):
            inside = (c >= 0) & (c <= w - 1) & (r >= 0) & (r <= h - 1)
            base_r, base_c = F.when(inside, base_r).otherwise(-1), F.when(inside, base_c).otherwise(-1)
        elif rule == "edge":
            border = (base_c < 0) | (base_c + 1 >= w) | (base_r < 0) | (base_r + 1 >= h)
            points = points.withColumn("_near", border)
            base_r = F.when(border, round_pixel(r)).otherwise(base_r)
            base_c = F.when(border, round_pixel(c)).otherwise(base_c)
        base_r = F.coalesce(base_r, F.lit(-1))
        base_c = F.coalesce(base_c, F.lit(-1))
        joined = self._joined(points, base_c, base_r)
        r0, c0 = F.col("_r0"), F.col("_c0")
        fx, fy = F.col("_fx"), F.col("_fy")
        r1, c1 = F.least(r0 + 1, F.lit(h - 1)), F.least(c0 + 1, F.lit(w - 1))
        v00, v10, v01, v11 = (F.col(f"_v{k}") for k in ("00", "10", "01", "11"))
        s00, s10, s01, s11 = (self._pixel(*p) for p in ((r0, c0), (r0, c1), (r1, c0), (r1, c1)))
        if rule == "strict":
            right, below = c0 + 1 < w, r0 + 1 < h
            s10 = F.when(fx > 0, F.when(right, s10)).otherwise(s00)
            s01 = F.when(fy > 0, F.when(below, s01)).otherwise(s00)
            s11 = F.when((fx > 0) & (fy > 0), F.when(right & below, s11)).otherwise(s00)
        values = (
            joined.withColumns({"_fx": c - c0, "_fy": r - r0})
            .withColumns({"_v00": s00, "_v10": s10, "_v01": s01, "_v11": s11})
        )
        top, bottom = v00 + (v10 - v00) * fx, v01 + (v11 - v01) * fx
        complete = v00.isNotNull() & v10.isNotNull() & v01.isNotNull() & v11.isNotNull()
        mixed = F.when(complete, top + (bottom - top) * fy)
        if rule in ("edge", "expanded"):
            mixed = F.when(complete, v00 + (v10 - v00) * fx + (v01 - v00) * fy + (v11 - v10 - v01 + v00) * fx * fy)
        if rule == "edge":
            mixed = F.when(F.col("_near"), v00).otherwise(mixed)
        return values.withColumn(out, mixed).drop(*self._scratch)


# --- grids and mosaics -------------------------------------------------------


def pixel_frame(spark, grid: Grid) -> DataFrame:
    """Every (row, col) of a grid."""
    n = F.col("id")
    return spark.range(grid.width * grid.height).select(
        F.floor(n / grid.width).cast("int").alias("row"), (n % grid.width).cast("int").alias("col")
    )


def target_grid(west: float, south: float, east: float, north: float, zoom: int = 12, pixel_deg: float | None = None) -> Grid:
    """Grid of a mosaic: square-degree pixels of 30 m at zoom 12, sizes rounded up."""
    px = pixel_deg or 30 / 1000 / KM_PER_DEGREE * (12 / zoom)
    return Grid(
        px, west, -px, north, max(1, math.ceil((east - west) / px)), max(1, math.ceil((north - south) / px))
    )


def tile_cover(boxes: DataFrame, zoom: int) -> DataFrame:
    """(box columns, zoom, x, y) for every tile that touches a west/south/east/north box."""
    return (
        boxes.withColumn("x", F.explode(F.sequence(tile_x("west", zoom), tile_x("east", zoom))))
        .withColumn("y", F.explode(F.sequence(tile_y("north", zoom), tile_y("south", zoom))))
        .withColumn("zoom", F.lit(zoom))
    )


def mosaic_tiles(tiles: DataFrame, grid: Grid, zoom: int, tile_px: int) -> DataFrame:
    """(row, col, elev): nearest tile pixel for every grid pixel, NULL where no tile has it.

    ``tiles`` is (zoom, x, y, tile_row, tile_col, elev). Grid pixels find their tile
    through Web-Mercator arithmetic and one equi-join.
    """
    spark = tiles.sparkSession
    lon, lat = grid.lon_lat("col", "row")
    frame = pixel_frame(spark, grid).withColumns({"_mx": mercator_x(lon), "_my": mercator_y(lat)})
    n = float(2**zoom)
    world = 2 * 20037508.34
    frame = frame.withColumns(
        {
            "x": F.floor((F.col("_mx") + world / 2) / world * n),
            "y": F.floor((F.lit(world / 2) - F.col("_my")) / world * n),
        }
    )
    edges = tile_bounds_m("x", "y", zoom)
    frame = frame.withColumns(
        {
            "tile_col": F.floor((F.col("_mx") - edges["west"]) / ((edges["east"] - edges["west"]) / tile_px)).cast("int"),
            "tile_row": F.floor((edges["north"] - F.col("_my")) / ((edges["north"] - edges["south"]) / tile_px)).cast("int"),
        }
    )
    west, south, east, north = grid.bounds
    wanted = tiles.filter(F.col("zoom") == zoom).filter(
        F.col("x").between(*_tile_span(west, east, zoom)) & F.col("y").between(*_tile_rows(south, north, zoom))
    )
    joined = frame.join(wanted.drop("zoom"), ["x", "y", "tile_row", "tile_col"], "left")
    return joined.select("row", "col", "elev")


def _tile_span(west: float, east: float, zoom: int) -> tuple[int, int]:
    n = 2**zoom
    return math.floor((west + 180) / 360 * n), math.floor((east + 180) / 360 * n)


def _tile_rows(south: float, north: float, zoom: int) -> tuple[int, int]:
    def row(lat: float) -> int:
        phi = math.radians(lat)
        return math.floor((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * 2**zoom)

    return row(north), row(south)


def resample(source: DataFrame, source_grid: Grid, target: Grid, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, col, value) of a raster on another grid: bilinear, nearest on the border.

    Pixels without a value stay absent. With keys, every key present in the source is resampled.
    """
    spark = source.sparkSession
    lon, lat = target.lon_lat("col", "row")
    sc, sr = source_grid.col_row(lon, lat)
    frame = pixel_frame(spark, target).withColumns({"_sc": sc, "_sr": sr})
    if not keys:
        raster = BlockRaster.of(source, source_grid, value)
        return raster.bilinear(frame, "_sr", "_sc", value, "edge").drop("_sr", "_sc").filter(F.col(value).isNotNull())
    # Keyed rasters: blocks meet the target pixels of their own area, so no key set is spread over pixels.
    size = 32
    keyed = BlockRaster(to_blocks(source, source_grid, value, size, keys=keys), source_grid, size)
    located = keyed.bilinear(frame, "_sr", "_sc", value, "edge")
    return located.select(*keys, "row", "col", value).filter(F.col(value).isNotNull())


def _page_span(start: float, step: float, low: int, size: int) -> tuple[int, int]:
    """First and last row (or column) of a raster that a page from ``low`` degrees, one degree wide, can look at."""
    ends = sorted((v - start) / step for v in (low, low + 1))
    return tuple(max(0, min(size - 1, v)) for v in (math.floor(ends[0]) - 1, math.ceil(ends[1]) + 1))


def resample_page(raster: DataFrame, grid: Grid, page_north: int, page_west: int, samples: int, value: str = "elev") -> DataFrame:
    """One 1-degree page of rounded elevations, (page_row south to north, page_col east to west).

    Positions are clamped to the raster, nodata counts as 0, values stay in -500..9000. Only the part of the raster that
    the page covers is read and filled.
    """
    spark = raster.sparkSession
    step = 1.0 / samples
    page = Grid(step, page_west, step, page_north - 1, samples, samples)
    lon, lat = F.lit(float(page_west)) + (F.col("col") + 0.5) * step, F.lit(page_north - 1.0) + (F.col("row") + 0.5) * step
    sc, sr = grid.col_row(lon, lat)
    frame = pixel_frame(spark, page).withColumns(
        {
            "_sc": F.greatest(F.lit(0.0), F.least(sc, F.lit(float(grid.width - 1)))),
            "_sr": F.greatest(F.lit(0.0), F.least(sr, F.lit(float(grid.height - 1)))),
        }
    )
    rows = _page_span(grid.f, grid.e, page_north - 1, grid.height)
    cols = _page_span(grid.c, grid.a, page_west, grid.width)
    n = cols[1] - cols[0] + 1
    k = F.col("id")
    pixels = spark.range((rows[1] - rows[0] + 1) * n).select((F.floor(k / n) + rows[0]).cast("int").alias("row"), (k % n + cols[0]).cast("int").alias("col"))
    near = raster.filter(F.col("row").between(*rows) & F.col("col").between(*cols))
    pixels = pixels.join(near, ["row", "col"], "left")  # absent is nodata too
    filled = pixels.withColumn(value, F.coalesce(valid_elevation(value, -10000.0), F.lit(0.0)))
    sampled = BlockRaster.of(filled, grid, value).bilinear(frame, "_sr", "_sc", value, "expanded")
    clipped = F.greatest(F.lit(-500.0), F.least(F.lit(9000.0), F.coalesce(F.col(value), F.lit(0.0))))
    return sampled.select(
        F.col("row").alias("page_row"),
        (F.lit(samples - 1) - F.col("col")).cast("int").alias("page_col"),
        round_half_up(clipped).cast("int").alias(value),
    )


def mercator_row_map(spark, grid: Grid) -> DataFrame:
    """(out_row, src_row): the raster row that a Mercator-spaced output row shows."""
    _, south, _, north = grid.bounds
    top, bottom = (math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (north, south))
    y = F.lit(top) + (F.col("id") + 0.5) / grid.height * F.lit(bottom - top)
    lat = F.degrees(2.0 * F.atan(F.exp(y)) - math.pi / 2)
    src = F.floor((F.lit(north) - lat) / abs(grid.e))
    return spark.range(grid.height).select(
        F.col("id").cast("int").alias("out_row"),
        F.greatest(F.lit(0), F.least(src, F.lit(grid.height - 1))).cast("int").alias("src_row"),
    )


def reproject_rows(pixels: DataFrame, grid: Grid, value: str) -> DataFrame:
    rows = mercator_row_map(pixels.sparkSession, grid)
    return pixels.join(rows, pixels["row"] == rows["src_row"]).select("out_row", "col", value)


def disc_offsets(radius: int, stride: int) -> list[tuple[int, int]]:
    """(start relative to the centre, length) of every row run of a disc."""
    runs = []
    for dr in range(-radius, radius + 1):
        half = math.isqrt(radius * radius - dr * dr)
        runs.append((dr * stride - half, 2 * half + 1))
    return runs


def _disc_expressions(grid: Grid, radius: int, size: int) -> tuple[str, str, str]:
    """SQL texts: array index of core pixel k, disc maximum and disc minimum around it."""
    stride = size + 2 * radius
    at = f"((k div {size} + {radius}) * {stride} + k % {size} + {radius})"
    runs = ", ".join(f"named_struct('s', {s + 1}, 'n', {n})" for s, n in disc_offsets(radius, stride))
    peak = f"array_max(transform(array({runs}), o -> array_max(slice(vals, cast({at} + o.s as int), o.n))))"
    return at.replace("k div", "cast(k as int) div"), peak, peak.replace("array_max", "array_min")


def _running_max(rows: np.ndarray, width: int) -> np.ndarray:
    """Maximum over ``width`` cells from each cell on, along rows: block prefixes and suffixes, two passes whatever the width."""
    n = rows.shape[1]
    padded = np.full((rows.shape[0], -(-n // width) * width), -np.inf)
    padded[:, :n] = rows
    blocks = padded.reshape(rows.shape[0], -1, width)
    prefix = np.maximum.accumulate(blocks, 2).reshape(padded.shape)
    suffix = np.maximum.accumulate(blocks[:, :, ::-1], 2)[:, :, ::-1].reshape(padded.shape)
    return np.maximum(suffix[:, : n - width + 1], prefix[:, width - 1 : n])


def _disc_max(cells: np.ndarray, radius: int) -> np.ndarray:
    """Maximum over a disc around every cell that has the whole disc inside: a look at one run a row, 2 * radius + 1 in all."""
    size = cells.shape[0] - 2 * radius
    runs: dict[int, np.ndarray] = {}
    out = np.full((size, size), -np.inf)
    for dr in range(-radius, radius + 1):
        half = math.isqrt(radius * radius - dr * dr)
        if half not in runs:
            runs[half] = _running_max(cells, 2 * half + 1)
        row, col = radius + dr, radius - half
        np.maximum(out, runs[half][row : row + size, col : col + size], out=out)
    return out


def focal_extremes(pixels: DataFrame, grid: Grid, radius: int, value: str = "elev", size: int | None = None) -> DataFrame:
    """(row, col, value, focal_max, focal_min) over a disc; missing pixels are ignored.

    One shuffle builds blocks with a halo of ``radius``; blocks grow with the radius, so halos at most triple a block's
    side until it is 512 pixels. Inside a block every run of a disc's row comes from running maxima, so a pixel costs one lookup for
    each row of the disc.
    """
    size = size or max(32, min(512, radius))
    blocks = to_blocks(pixels, grid, value, size, lead=radius, trail=radius)
    stride = size + 2 * radius
    kind = T.StructField(value, dict((f.name, f.dataType) for f in pixels.schema)[value])
    fields = [T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), kind]
    schema = T.StructType([*fields, *(T.StructField(n, kind.dataType) for n in ("focal_max", "focal_min"))])
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                brow, bcol = (batch.column(c)[k].as_py() for c in (0, 1))
                found = batch.column(2)[k].values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # missing pixels are NaN
                cells = np.full(stride * stride, np.nan)
                cells[: len(found)] = found
                cells = cells.reshape(stride, stride)
                missing = np.isnan(cells)
                high = _disc_max(np.where(missing, -np.inf, cells), radius)
                low = -_disc_max(np.where(missing, -np.inf, -cells), radius)
                own = cells[radius : radius + size, radius : radius + size]
                r, c = np.nonzero(~np.isnan(own))
                columns = (r + brow * size, c + bcol * size, own[r, c], high[r, c], low[r, c])
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    return blocks.select("brow", "bcol", "vals").mapInArrow(work, schema)


def local_maxima(pixels: DataFrame, grid: Grid, radius: int, value: str = "elev", size: int = 64) -> DataFrame:
    """(row, col, value) of pixels that equal the disc maximum and exceed the disc minimum.

    A border of ``radius`` pixels is left out unless it would swallow half the raster.
    Only pixels not below their four neighbours are looked at, and level blocks are skipped whole.
    """
    blocks = to_blocks(pixels, grid, value, size, lead=radius, trail=radius)
    pad = radius if radius < min(grid.height, grid.width) / 2 else 0
    at, high, low = _disc_expressions(grid, radius, size)
    stride = size + 2 * radius
    row, col = f"(brow * {size} + k div {size})", f"(bcol * {size} + k % {size})"

    def pixel(shift: int) -> str:
        return f"get(vals, cast({at} + {shift} as int))"

    not_below = " and ".join(f"{pixel(0)} >= coalesce({pixel(s)}, {pixel(0)})" for s in (-1, 1, -stride, stride))
    in_bounds = f"{row} between {pad} and {grid.height - 1 - pad} and {col} between {pad} and {grid.width - 1 - pad}"
    level = "array_max(vals) = array_min(vals)"
    kept = (
        f"filter(sequence(0, {size * size - 1}), k -> not _level and {pixel(0)} is not null and {in_bounds}"
        f" and {not_below} and {pixel(0)} = {high} and {pixel(0)} > {low})"
    )
    marked = blocks.select("brow", "bcol", "vals", F.expr(level).alias("_level"))
    peaks = marked.select("brow", "bcol", "vals", F.explode(F.expr(kept)).alias("k"))
    return peaks.select(
        F.expr(row).cast("int").alias("row"), F.expr(col).cast("int").alias("col"), F.expr(pixel(0)).alias(value)
    )
