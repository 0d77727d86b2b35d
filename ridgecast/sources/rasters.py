"""Raster readers: elevation tiles and signal tables kept as Parquet pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgecast.operators.raster import valid_elevation


def wanted_tiles(tiles: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """(zoom, x, y, tile_row, tile_col, elev) of the tiles in a cover of (zoom, x, y); nodata is NULL."""
    if cover is not None:
        tiles = tiles.join(cover.select("zoom", "x", "y").distinct(), ["zoom", "x", "y"], "left_semi")
    return tiles.withColumn("elev", valid_elevation("elev"))


def read_tiles(spark: SparkSession, path: str, cover: DataFrame | None = None) -> DataFrame:
    """Tiles kept as Parquet; with folders by zoom and x the join prunes partitions at run time."""
    return wanted_tiles(spark.read.parquet(path), cover)


def finite_signal(signal: DataFrame) -> DataFrame:
    v = F.col("rssi")
    return signal.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, row, col, rssi) without NaN or infinite values."""
    return finite_signal(spark.read.parquet(path))
