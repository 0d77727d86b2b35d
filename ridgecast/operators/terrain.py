"""Profiles, line of sight, viewshed and hilltops over an elevation raster."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgecast.functions.geo import (
    EARTH_RADIUS_KM,
    EFFECTIVE_RADIUS_M,
    Grid,
    along_great_circle,
    haversine_km,
)
from ridgecast.operators.network import suppress_by_distance
from ridgecast.operators.raster import BlockRaster, local_maxima, valid_elevation
from ridgecast.operators.rays import fold_rays, held_blocks, least, lists, whole_rays
from ridgecast.operators.spatial import nearest_by_degrees, sample_lattice
from ridgecast.session import cut_lineage

PROFILE_SAMPLES = 100


def densify(links: DataFrame, fractions: list[float]) -> DataFrame:
    """One row per link and fraction: (links columns, i, frac, lat, lon) on the great circle."""
    steps = F.array(*[F.lit(float(f)) for f in fractions])
    long = links.withColumn("_arc", haversine_km("lat1", "lon1", "lat2", "lon2") / EARTH_RADIUS_KM).select(
        "*", F.posexplode(steps).alias("i", "frac")
    )
    lat, lon = along_great_circle("lat1", "lon1", "lat2", "lon2", "_arc", "frac")
    return long.withColumns({"lat": lat, "lon": lon}).drop("_arc")


def even_fractions(n: int) -> list[float]:
    return [i / (n - 1) for i in range(n)] if n > 1 else [0.0]


def sample_at(points: DataFrame, raster: BlockRaster, out: str = "elev", rule: str = "shared") -> DataFrame:
    """Elevation at (lat, lon) of every row; NULL outside the raster or at nodata."""
    col, row = raster.grid.col_row("lon", "lat")
    placed = points.withColumns({"_pc": col, "_pr": row})
    return raster.bilinear(placed, "_pr", "_pc", out, rule).drop("_pc", "_pr")


def link_samples(links: DataFrame, raster: BlockRaster, n: int = PROFILE_SAMPLES) -> DataFrame:
    return sample_at(densify(links, even_fractions(n)), raster)


def profiles(links: DataFrame, raster: BlockRaster, n: int = PROFILE_SAMPLES, keys: tuple[str, ...] = ("link_id",), once: bool = False) -> DataFrame:
    """Per link: elevations (0 where missing) and distances as arrays of ``n``, total distance, valid-sample statistics.

    ``once``: no two links share their keys. Where the raster is small, a task then finishes its links by itself and nothing is shuffled.
    """
    with_total = links.withColumn("distance_km", haversine_km("lat1", "lon1", "lat2", "lon2"))
    slim = with_total.select(*keys, "lat1", "lon1", "lat2", "lon2", "distance_km")
    fractions = even_fractions(n)
    if once and (held := held_blocks(raster)) is not None:
        return _own_profiles(slim, raster, held, fractions, keys)
    parts = fold_rays(slim, raster, fractions, (*keys, "distance_km"), (), None)
    pieces = F.arrays_zip("i", "z")
    folded = parts.groupBy(*keys, "distance_km").agg(F.sort_array(F.flatten(F.collect_list(pieces))).alias("_p")).withColumn("_z", F.col("_p.z"))
    known = F.filter("_z", lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda x, y: x + y)
    steps = F.array(*[F.lit(f) for f in fractions])
    return folded.select(
        *keys, "distance_km", F.transform("_z", lambda v: F.coalesce(v, F.lit(0.0))).alias("elevations"),
        F.transform(steps, lambda f: f * F.col("distance_km")).alias("distances_km"),
        F.coalesce(F.array_max(known), F.lit(0.0)).alias("max_elev"), F.coalesce(F.array_min(known), F.lit(0.0)).alias("min_elev"),
        F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.0)).alias("avg_elev"),
    )


def _own_profiles(links: DataFrame, raster: BlockRaster, held: Broadcast, fractions: list[float], keys: tuple[str, ...]) -> DataFrame:
    """``profiles`` of links that are there once, with the raster in every task."""
    stats = ("max_elev", "min_elev", "avg_elev")
    fields = [T.StructField("elevations", T.ArrayType(T.DoubleType())), *(T.StructField(name, T.DoubleType()) for name in stats)]

    def make(link: dict[str, np.ndarray], frac: np.ndarray, z: np.ndarray) -> list[pa.Array]:
        known = ~np.isnan(z)
        filled = np.where(known, z, 0.0)
        found = known.sum(axis=1)
        total = np.cumsum(filled, axis=1)[:, -1]  # one after the other, as the rows of a profile are added up elsewhere
        ends = (np.where(found > 0, f.reduce(z, axis=1), 0.0) for f in (np.fmax, np.fmin))
        return [lists(filled), *map(pa.array, ends), pa.array(total / np.maximum(found, 1))]

    made = whole_rays(links, raster, held, fractions, (*keys, "distance_km"), (), fields, make)
    steps = F.array(*[F.lit(f) for f in fractions])
    return made.select(*keys, "distance_km", "elevations", F.transform(steps, lambda f: f * F.col("distance_km")).alias("distances_km"), *stats)


#: Numbers that share one long as its bits.
BITS = 62


def place_in_word(number: str) -> Column:
    return F.coalesce(F.pmod(F.col(number), F.lit(BITS)), F.lit(0)).cast("int")


def verdict_bits(parts: DataFrame, owner: str, number: str) -> DataFrame:
    """(owner, word, met, free, hidden) of (owner, number, value): numbers that are there, with a value above 0, and with one of 0 or less.

    ``word`` is the first of ``BITS`` numbers in a row. A task puts its values together before they are shuffled, as bits.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place_in_word(number))

    def of(values: Column) -> Column:
        return F.coalesce(F.bit_or(values), F.lit(0).cast("long"))

    word = (F.col(number) - F.pmod(F.col(number), F.lit(BITS))).alias("word")
    return parts.groupBy(owner, word).agg(
        of(bit).alias("met"), of(F.when(F.col("value") > 0, bit)).alias("free"), of(F.when(F.col("value") <= 0, bit)).alias("hidden"))


def clear_bit(at: Column) -> Column:
    """Whether the number at a place of its word is free of hidden values; NULL without any value."""
    return F.when(F.getbit("hidden", at) == 1, F.lit(False)).when(F.getbit("free", at) == 1, F.lit(True))


SIGHT = ("elev1", "elev2", "distance_km")


def inner_fractions(n: int) -> list[float]:
    return [i / (n - 1) for i in range(1, n - 1)]


def _clear(link: dict[str, np.ndarray], frac: np.ndarray, z: np.ndarray) -> np.ndarray:
    metres = frac * link["distance_km"] * 1000.0
    sight = link["elev1"] + frac * (link["elev2"] - link["elev1"])
    free = np.where(np.isnan(z), 0.0, z) + metres * metres / (2.0 * EFFECTIVE_RADIUS_M) <= sight + 1e-9
    return np.where(link["distance_km"] * 1000.0 < 1, 1.0, np.where(np.isnan(sight), np.nan, free))


def sight_bits(links: DataFrame, raster: BlockRaster, n: int = PROFILE_SAMPLES) -> DataFrame:
    """``line_of_sight`` as ``verdict_bits`` of (src, dst), whole numbers both."""
    return verdict_bits(fold_rays(links, raster, inner_fractions(n), ("src", "dst"), SIGHT, _clear), "src", "dst")


def own_sight(links: DataFrame, raster: BlockRaster, n: int, keys: tuple[str, ...]) -> DataFrame | None:
    """(keys, los_clear) of links that are there once: a task judges them by itself. None where the raster is not small."""
    held = held_blocks(raster)
    if held is None:
        return None
    value = [T.StructField("value", T.DoubleType())]
    return whole_rays(links, raster, held, inner_fractions(n), keys, SIGHT, value, least(_clear)).select(*keys, (F.col("value") > 0).alias("los_clear"))


def line_of_sight(links: DataFrame, raster: BlockRaster, n: int = PROFILE_SAMPLES, once: bool = False) -> DataFrame:
    """(src, dst, los_clear): terrain plus 4/3-earth drop stays under the straight line between ground heights.

    ``links`` is (src, dst, lat1, lon1, elev1, lat2, lon2, elev2, distance_km), ids whole numbers. Missing terrain
    counts as 0 m, the tolerance is 1e-9 m, links under a metre are clear; links without a height at an end are not judged.
    ``once``: no two links share src and dst, so where the raster is small nothing is shuffled.
    """
    if once and (own := own_sight(links, raster, n, ("src", "dst"))) is not None:
        return own
    places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit("met", k) == 1)
    each = sight_bits(links, raster, n).withColumn("_k", F.explode(places))
    return each.select("src", (F.col("word") + F.col("_k")).cast(links.schema["dst"].dataType).alias("dst"), clear_bit(F.col("_k")).alias("los_clear"))


def viewshed_rank(peaks: DataFrame, raster: BlockRaster, box: tuple[float, float, float, float], density: int = 50) -> DataFrame:
    """(site_id, viewshed_rank): share of an n x n lattice over the box that the ground at the peak sees.

    Nine inner points per ray; missing terrain blocks, compare is strict. A peak off the
    raster sees nothing. The lattice is one for all peaks, so its heights are looked up once.
    """
    west, south, east, north = box
    own = sample_at(peaks.select("site_id", "lat", "lon"), raster, "elev1").filter("elev1 is not null")
    frame = peaks.sparkSession.range(1).select(F.lit(west).alias("west"), F.lit(south).alias("south"), F.lit(east).alias("east"), F.lit(north).alias("north"))
    lattice = sample_at(sample_lattice(frame, density).select("sample", "lat", "lon"), raster, "elev2").filter("elev2 is not null")
    goals = lattice.agg(F.collect_list(F.struct("sample", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "elev2")).alias("_g"))  # density squared entries
    tasks = int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = own.select("site_id", "elev1", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).repartition(tasks, "site_id")
    rays = starts.crossJoin(F.broadcast(goals)).select("*", F.inline("_g")).drop("_g")

    def free(ray: dict[str, np.ndarray], frac: np.ndarray, z: np.ndarray) -> np.ndarray:
        whole = ray["arc"] * EARTH_RADIUS_KM * 1000.0
        metres = frac * whole
        sight = ray["elev1"] + frac * (ray["elev2"] - ray["elev1"])
        with np.errstate(invalid="ignore"):
            return (whole < 1) | (z + metres * metres / (2.0 * EFFECTIVE_RADIUS_M) <= sight)

    parts = fold_rays(rays, raster, [k / 10 for k in range(1, 10)], ("site_id", "sample"), ("elev1", "elev2"), free)
    bits = verdict_bits(parts, "site_id", "sample")
    seen = F.bit_count(F.col("free").bitwiseAND(F.bitwise_not(F.col("hidden"))))
    share = bits.groupBy("site_id").agg((F.sum(seen) / F.lit(float(density * density))).alias("viewshed_rank"))
    return peaks.select("site_id").join(share, "site_id", "left").select(
        "site_id", F.coalesce("viewshed_rank", F.lit(0.0)).alias("viewshed_rank")
    )


# --- hilltops ----------------------------------------------------------------


def focal_radius(grid: Grid, min_distance_km: float) -> int:
    return max(1, math.floor(min_distance_km / grid.pixel_km() + 0.5))


def ordered_peaks(found: DataFrame, grid: Grid, value: str = "elev") -> DataFrame:
    """Peaks with lat/lon and ``ord``, 0 for the highest; ties by row, then column.

    Ranks are partition sizes summed up after a range sort, never one global window.
    """
    spark = found.sparkSession
    lon, lat = grid.lon_lat("col", "row")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = found.repartitionByRange(parts, F.desc(value), "row", "col").sortWithinPartitions(F.desc(value), "row", "col")
    marked = cut_lineage(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select("_p", "_first", before.alias("_before"))  # one row per partition
    return marked.join(F.broadcast(starts), "_p").select(
        (F.col("_before") + F.col("_m") - F.col("_first")).alias("ord"), "row", "col", lat.alias("lat"), lon.alias("lon"),
        F.col(value).cast("double").alias("elev"),
    )


def _lowest_on_paths(paths: DataFrame, raster: BlockRaster, n: int) -> DataFrame:
    """(ord, saddle): per peak the highest of the path minima; paths without terrain do not count."""
    lows = fold_rays(paths, raster, even_fractions(n), ("ord", "target"), (), lambda path, frac, z: z, "strict")
    lows = lows.groupBy("ord", "target").agg(F.min("value").alias("low"))
    return lows.groupBy("ord").agg(F.max("low").alias("saddle"))


def higher_neighbours(peaks: DataFrame, k: int = 31, groups: int = 64) -> DataFrame:
    """(ord, target): the higher ones among the ``k`` nearest peaks, or all higher peaks when none of them is.

    The second branch compares by order alone; its pairs are spread over ``groups`` slices of the
    higher peaks, an equi-join on the slice, so no task sees all of them.
    """
    points = peaks.select(F.col("ord").alias("id"), "lat", "lon")
    near = nearest_by_degrees(points, k)
    higher = near.filter(F.col("other") < F.col("id")).select(F.col("id").alias("ord"), F.col("other").alias("target"))
    lone = peaks.filter("ord > 0").select("ord").join(higher.select("ord").distinct(), "ord", "left_anti")
    asked = lone.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    offered = peaks.select(F.col("ord").alias("target")).withColumn("_g", F.pmod(F.col("target"), F.lit(groups)).cast("int"))
    rest = asked.join(offered, "_g").filter(F.col("target") < F.col("ord")).select("ord", "target")
    return higher.filter("ord > 0").union(rest)


def prominence(peaks: DataFrame, raster: BlockRaster) -> DataFrame:
    """Peaks with ``prominence``: height above the best saddle towards higher ground.

    The highest peak is measured against eight points on the raster's border, the others
    against their higher neighbours. Without any usable path the elevation itself counts.
    """
    grid = raster.grid
    h, w = grid.height, grid.width
    border = [(0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1), (h // 2, 0), (h // 2, w - 1), (0, w // 2), (h - 1, w // 2)]
    corners = F.array(
        *[F.struct(F.lit(-1 - i).alias("t"), F.lit(float(r)).alias("r"), F.lit(float(c)).alias("c")) for i, (r, c) in enumerate(border)]
    )
    first = peaks.filter("ord = 0").withColumn("b", F.explode(corners))
    lon2, lat2 = grid.lon_lat("b.c", "b.r")
    first_paths = first.select(
        "ord", F.col("b.t").cast("long").alias("target"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
        lat2.alias("lat2"), lon2.alias("lon2"),
    )
    pairs = higher_neighbours(peaks)
    start = peaks.select("ord", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    goal = peaks.select(F.col("ord").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    paths = pairs.join(start, "ord").join(goal, "target").select("ord", "target", "lat1", "lon1", "lat2", "lon2")
    saddles = _lowest_on_paths(first_paths, raster, 100).union(_lowest_on_paths(paths, raster, 50))
    drop = F.col("elev") - F.col("saddle")
    measured = F.when(F.col("saddle").isNull(), F.col("elev")).when(
        (F.col("ord") == 0) & (drop <= 0), F.col("elev")
    ).otherwise(drop)
    return peaks.join(saddles, "ord", "left").withColumn("prominence", F.greatest(F.lit(0.0), measured)).drop("saddle")


def hilltops(pixels: DataFrame, grid: Grid, min_prominence: float = 50.0, min_distance_km: float = 0.5) -> DataFrame:
    """(site_id, row, col, lat, lon, elev, prominence) of prominent, well separated summits.

    ``site_id`` is the position by elevation among all local maxima.
    """
    clean = pixels.withColumn("elev", valid_elevation("elev")).persist()
    found = local_maxima(clean, grid, focal_radius(grid, min_distance_km))
    peaks = cut_lineage(ordered_peaks(found, grid))
    raster = BlockRaster.of(clean, grid).persisted()
    prominent = cut_lineage(prominence(peaks, raster).filter(F.col("prominence") >= F.lit(float(min_prominence))))
    kept = suppress_by_distance(prominent, min_distance_km)
    return kept.withColumnRenamed("ord", "site_id")


def scout(pixels: DataFrame, grid: Grid, box=None, min_prominence: float = 50.0, max_peaks: int | None = None, density: int = 50,
          min_distance_km: float = 0.5) -> DataFrame:
    """Hilltops with ``viewshed_rank``: all of them, or the best ``max_peaks`` where a caller wants a top-k report."""
    tops = cut_lineage(hilltops(pixels, grid, min_prominence, min_distance_km))
    raster = BlockRaster.of(pixels.withColumn("elev", valid_elevation("elev")), grid).persisted()
    ranks = viewshed_rank(tops, raster, box or grid.bounds, density)
    return top_candidates(tops.join(ranks, "site_id"), max_peaks)


def top_candidates(candidates: DataFrame, n: int | None) -> DataFrame:
    return candidates if n is None else candidates.orderBy(F.desc("viewshed_rank"), "site_id").limit(n)
