"""Range join, zone join, nearest-neighbour join and candidate grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from ridgecast.functions.geo import (
    EARTH_RADIUS_KM,
    KM_PER_DEGREE,
    KM_PER_DEGREE_RANGE_BOX,
    as_col,
    haversine_km,
)
from ridgecast.session import cut_lineage

# --- range join --------------------------------------------------------------


def _bucket_row(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step).cast("int")


def _lon_cells(row: Column, step: float) -> Column:
    """Number of longitude buckets in a latitude row: each at least one range wide at the row's far edge."""
    far = F.greatest(F.abs(row * step - 90.0), F.abs((row + 1) * step - 90.0))
    cells = F.floor(F.lit(360.0 / step) * F.cos(F.radians(F.least(far, F.lit(90.0)))))
    return F.greatest(F.lit(1), cells.cast("int"))


def range_buckets(max_km: float):
    """Bucket size in degrees: a hair above the range, so neighbours are at most one row away."""
    return min(180.0, math.degrees(max_km / EARTH_RADIUS_KM) * (1 + 1e-9))


#: Points of a bucket that call for one more slice of it, and slices of a bucket at most.
SLICE_POINTS, SLICES = 256, 16


def _on_sphere(df: DataFrame, end: int) -> DataFrame:
    """Columns of a point on the unit sphere; the straight line between two points tells cheaply how far they are apart."""
    phi, theta = F.radians("lat"), F.radians("lon")
    return df.withColumns({f"_x{end}": F.cos(phi) * F.cos(theta), f"_y{end}": F.cos(phi) * F.sin(theta), f"_z{end}": F.sin(phi)})


def _chord_bounds(km: float) -> tuple[float, float]:
    """Squares of straight lines that are surely shorter, and surely longer, than a great circle of ``km``."""
    square = (2.0 * math.sin(min(math.pi, max(0.0, km / EARTH_RADIUS_KM)) / 2)) ** 2
    return square * (1 - 1e-9) - 1e-15, square * (1 + 1e-9) + 1e-15


def pairs_within(left: DataFrame, right: DataFrame, max_km: float, left_cols: dict[str, str], right_cols: dict[str, str],
                 condition: Column | None = None, min_km: float | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` at most ``max_km`` and at least ``min_km`` apart, with ``distance_km``.

    Both sides have ``lat``/``lon``; the mappings name the output columns. Points fall
    into latitude rows and longitude buckets at least one range wide; the left side is
    repeated into the buckets its range touches, wrapping at the antimeridian, and an
    equi-join on the bucket replaces the all-pairs comparison. A crowded bucket is cut into slices: the left side is
    dealt over them, the right side stands in each. So a few buckets make many tasks, also where the tables are small
    and their pairs are not; the join is never a broadcast one, which would leave all pairs to the tasks that read the left side.
    Candidates are judged by straight lines, only those at the very edge of the range by the great circle.
    """
    step = range_buckets(max_km)
    last = int(math.floor(180.0 / step))
    own_row = _bucket_row(F.col("lat"), step)
    spread = left.withColumn(
        "_row",
        F.explode(F.sequence(F.greatest(F.lit(0), own_row - 1), F.least(F.lit(last), own_row + 1))),
    )
    cells = _lon_cells(F.col("_row"), step)
    # Longitude reach of the range at the latitude that is farthest out among the two rows.
    outer = F.least(F.abs(F.col("lat")) + step, F.lit(90.0))
    reach_sin = F.lit(math.sin(min(math.pi / 2, math.radians(step)))) / F.greatest(F.cos(F.radians(outer)), F.lit(1e-12))
    reach = F.when(reach_sin >= 1.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach_sin, F.lit(1.0)))))
    width = F.lit(360.0) / cells
    first_cell = F.floor((F.col("lon") + 180.0 - reach) / width)
    last_cell = F.floor((F.col("lon") + 180.0 + reach) / width)
    span = F.least(last_cell, first_cell + cells - 1)
    spread = spread.withColumn("_cells", cells)
    spread = spread.withColumn("_lon", F.explode(F.sequence(first_cell, span)))
    spread = spread.withColumn("_lon", F.pmod(F.col("_lon"), F.col("_cells")).cast("int"))
    own_cells = _lon_cells(F.col("_row"), step)
    fixed = right.withColumn("_row", _bucket_row(F.col("lat"), step))
    fixed = fixed.withColumn(
        "_lon", F.pmod(F.floor((F.col("lon") + 180.0) / (F.lit(360.0) / own_cells)), own_cells).cast("int")
    )
    crowded = fixed.groupBy("_row", "_lon").agg(F.least(F.lit(SLICES), F.ceil(F.count(F.lit(1)) / SLICE_POINTS)).cast("int").alias("_slices")).filter("_slices > 1")
    slices = F.coalesce("_slices", F.lit(1))
    spread = spread.join(crowded, ["_row", "_lon"], "left").withColumn("_slice", F.pmod(F.xxhash64("lat", "lon", *left_cols), slices).cast("int"))
    fixed = fixed.join(crowded, ["_row", "_lon"], "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    place = ["_row", "_lon", "_slice"]
    a = _on_sphere(spread, 1).select(*place, *[F.col(src).alias(dst) for src, dst in left_cols.items()],
                                     F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"), "_x1", "_y1", "_z1")
    b = _on_sphere(fixed, 2).select(*place, *[F.col(src).alias(dst) for src, dst in right_cols.items()],
                                    F.col("lat").alias("_lat2"), F.col("lon").alias("_lon2"), "_x2", "_y2", "_z2")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, for Spark would put little input into few tasks
    joined = a.repartition(tasks, *place).join(b.repartition(tasks, *place).hint("merge"), place)
    if condition is not None:
        joined = joined.filter(condition)
    km = haversine_km("_lat1", "_lon1", "_lat2", "_lon2")
    lines = [F.col(f"_{c}1") - F.col(f"_{c}2") for c in "xyz"]
    chord = lines[0] * lines[0] + lines[1] * lines[1] + lines[2] * lines[2]
    below, above = _chord_bounds(max_km)
    joined = joined.filter((chord <= above) & ((chord <= below) | (km <= F.lit(float(max_km)))))
    if min_km is not None:
        below, above = _chord_bounds(min_km)
        joined = joined.filter((chord >= above) | ((chord >= below) & (km >= F.lit(float(min_km)))))
    names = [*left_cols.values(), *right_cols.values()]
    return joined.select(*names, km.alias("distance_km"))


def site_pairs(sites: DataFrame, max_km: float, min_km: float = 0.001, carry: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """(src, dst, distance_km, carried columns of both ends) for src < dst within range."""
    left = {"site_id": "src", **{c: f"{c}1" for c in carry}}
    right = {"site_id": "dst", **{c: f"{c}2" for c in carry}}
    return pairs_within(sites, sites, max_km, left, right, F.col("src") < F.col("dst"), min_km)


def stand_once(sites: DataFrame, key: str) -> bool:
    """Whether every key is there, in one row each: then a pair of sites is one row of ``site_pairs`` too."""
    rows, keys = sites.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    return rows == keys


# --- zones -------------------------------------------------------------------


def polygon_edges(polygon: Column) -> Column:
    """array<struct(xi, yi, xj, yj)> of a ring of struct(lon, lat); each vertex with the one before it."""
    n = F.size(polygon)
    before = F.concat(F.slice(polygon, n, F.lit(1)), F.slice(polygon, F.lit(1), n - 1))
    return F.zip_with(
        polygon,
        before,
        lambda p, q: F.struct(p["lon"].alias("xi"), p["lat"].alias("yi"), q["lon"].alias("xj"), q["lat"].alias("yj")),
    )


def inside_edges(lon: Column | str, lat: Column | str, edges: Column | str, before: Column | int = 0) -> Column:
    """Ray casting, half-open on y: an odd number of crossings is inside; ``before`` are crossings counted already."""
    x, y = as_col(lon), as_col(lat)
    crossed = F.filter(
        as_col(edges),
        lambda e: ((e["yi"] > y) != (e["yj"] > y))
        & (x < (e["xj"] - e["xi"]) * (y - e["yi"]) / F.when(e["yj"] == e["yi"], F.lit(1.0)).otherwise(e["yj"] - e["yi"]) + e["xi"]),
    )
    return (F.size(crossed) + before) % 2 == 1


#: Cells of a zone are cut in 4 x 4 at most so many times; a cell that fewer edges touch is tested as it is.
ZONE_ROUNDS, ZONE_EDGES = 4, 8


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(4.0), level))


def _touches(e: Column, box: dict[str, Column]) -> Column:
    """Whether an edge may meet a box: their bounds meet, and the corners are not all on one side of the edge's line."""
    apart = (
        (F.greatest(e["xi"], e["xj"]) < box["x0"]) | (F.least(e["xi"], e["xj"]) > box["x1"])
        | (F.greatest(e["yi"], e["yj"]) < box["y0"]) | (F.least(e["yi"], e["yj"]) > box["y1"])
    )
    sides = [(e["xj"] - e["xi"]) * (box[y] - e["yi"]) - (e["yj"] - e["yi"]) * (box[x] - e["xi"]) for x in ("x0", "x1") for y in ("y0", "y1")]
    slack = (F.abs(e["xj"] - e["xi"]) + F.abs(e["yj"] - e["yi"])) * (box["x1"] - box["x0"] + box["y1"] - box["y0"]) * F.lit(1e-9)
    one_side = (F.least(*sides) > slack) | (F.greatest(*sides) < -slack)
    return ~(apart | one_side)


def zone_cover(zones: DataFrame) -> DataFrame:
    """(zone_id, level, cx, cy, edges, odd): cells of 4 ** level that a zone fills (``edges`` NULL) or that its border touches.

    A quadtree of each zone's own: it starts with the smallest cells of which four hold the zone, and cells on the
    border are cut until few edges touch them. A border cell keeps the edges that can decide about its points: those
    that reach its rows and do not lie wholly left of it. Of those wholly right of it that cross all its rows only the
    number counts, modulo two (``odd``).
    """
    ring = zones.filter(F.size("polygon") >= 3).select("zone_id", polygon_edges(F.col("polygon")).alias("edges"))
    low = {axis: F.array_min(F.col(f"edges.{axis}i")) for axis in "xy"}
    high = {axis: F.array_max(F.col(f"edges.{axis}i")) for axis in "xy"}
    widest = F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(1e-12))
    level = F.ceil(F.log(widest) / math.log(4.0)).cast("int")
    boxed = ring.withColumns({"level": level, "odd": F.lit(0), "_x0": low["x"], "_x1": high["x"], "_y0": low["y"], "_y1": high["y"]})
    now = boxed.select(
        "zone_id", "level", "edges", "odd", F.explode(F.sequence(_cell(F.col("_x0"), F.col("level")), _cell(F.col("_x1"), F.col("level")))).alias("cx"), "_y0", "_y1",
    ).select("zone_id", "level", "edges", "odd", "cx", F.explode(F.sequence(_cell(F.col("_y0"), F.col("level")), _cell(F.col("_y1"), F.col("level")))).alias("cy"))
    settled = None
    for k in range(ZONE_ROUNDS + 1):
        size = F.pow(F.lit(4.0), F.col("level"))
        slack = size * F.lit(1e-9) + F.abs(F.col("cx") + F.col("cy")) * size * F.lit(1e-15)
        box = {"x0": F.col("cx") * size - slack, "x1": (F.col("cx") + 1) * size + slack, "y0": F.col("cy") * size - slack, "y1": (F.col("cy") + 1) * size + slack}
        band = F.filter("edges", lambda e: (F.greatest(e["yi"], e["yj"]) >= F.col("_by0")) & (F.least(e["yi"], e["yj"]) <= F.col("_by1")) & (F.greatest(e["xi"], e["xj"]) >= F.col("_bx0")))
        passed = F.filter("edges", lambda e: (F.least(e["yi"], e["yj"]) <= F.col("_by0")) & (F.greatest(e["yi"], e["yj"]) > F.col("_by1")) & (F.least(e["xi"], e["xj"]) > F.col("_bx1")))
        near = now.withColumns({f"_b{n}": v for n, v in box.items()}).withColumn("edges", band).withColumn("_passed", passed)
        near = near.withColumns({"odd": (F.col("odd") + F.size("_passed")) % 2, "edges": F.filter("edges", lambda e: ~F.array_contains("_passed", e))})
        near = near.withColumn("_touching", F.size(F.filter("edges", lambda e: _touches(e, {n: F.col(f"_b{n}") for n in box}))))
        centre = inside_edges((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, "edges", F.col("odd"))
        known = cut_lineage(near.withColumn("_inside", centre).select("zone_id", "level", "cx", "cy", "edges", "odd", "_touching", "_inside"))
        few = (F.col("_touching") <= ZONE_EDGES) & (F.size("edges") <= 4 * ZONE_EDGES) & F.lit(k > 0)
        done = (F.col("_touching") == 0) | few | F.lit(k == ZONE_ROUNDS)
        ready = known.filter(done & ((F.col("_touching") > 0) | F.col("_inside")))
        ready = ready.select("zone_id", "level", "cx", "cy", F.when(F.col("_touching") > 0, F.col("edges")).alias("edges"), "odd")
        settled = ready if settled is None else settled.union(ready)
        more = known.filter(~done)
        if k == ZONE_ROUNDS or more.isEmpty():
            return settled
        part = F.explode(F.sequence(F.lit(0), F.lit(3)))
        now = more.select("zone_id", (F.col("level") - 1).alias("level"), "edges", "odd", F.col("cx") * 4, F.col("cy") * 4).toDF("zone_id", "level", "edges", "odd", "cx", "cy")
        now = now.withColumn("_p", part).withColumn("cx", F.col("cx") + F.col("_p")).withColumn("_p", part).withColumn("cy", F.col("cy") + F.col("_p")).drop("_p")


def points_in_zones(points: DataFrame, zones: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points with the ``zone_id`` of every zone that holds them.

    ``zones`` is (zone_id, polygon array<struct(lon, lat)>); rings under three vertices hold nothing.
    Every zone is covered by cells of its own size (``zone_cover``). Points meet cells in an equi-join, once for each
    level in use; inside a filled cell they are settled, only border cells are tested, against their few edges.
    """
    cover = cut_lineage(zone_cover(zones))
    levels = [r["level"] for r in cover.select("level").distinct().collect()]  # one for each power of four between the smallest and the largest cell
    if not levels:
        return points.join(zones.select("zone_id").limit(0), F.lit(True))
    placed = points.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    placed = placed.withColumns({"cx": _cell(F.col(x), F.col("level")), "cy": _cell(F.col(y), F.col("level"))})
    met = placed.join(cover, ["level", "cx", "cy"])
    return met.filter(F.col("edges").isNull() | inside_edges(x, y, "edges", F.col("odd"))).drop("level", "cx", "cy", "edges", "odd")


def zone_bounds(zones: DataFrame) -> DataFrame:
    corners = zones.select("zone_id", F.explode("polygon").alias("p"))
    return corners.groupBy("zone_id").agg(
        F.min("p.lon").alias("west"), F.min("p.lat").alias("south"),
        F.max("p.lon").alias("east"), F.max("p.lat").alias("north"),
    )


def range_box(sites: DataFrame, range_km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bounding box of all sites widened by the range (111 km per degree, cosine floor 0.01)."""
    d_lat = range_km * (1.0 / KM_PER_DEGREE_RANGE_BOX)
    cosine = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    d_lon = F.lit(d_lat) / cosine
    return sites.groupBy(*keys).agg(
        F.min(F.col("lon") - d_lon).alias("west"), F.min(F.col("lat") - d_lat).alias("south"),
        F.max(F.col("lon") + d_lon).alias("east"), F.max(F.col("lat") + d_lat).alias("north"),
    )


def degree_snap(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns(
        {"west": F.floor("west").cast("double"), "south": F.floor("south").cast("double"),
         "east": F.ceil("east").cast("double"), "north": F.ceil("north").cast("double")}
    )


# --- candidate grids ---------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _accumulated_axis(start: pd.Series, stop: pd.Series, step: pd.Series) -> pd.Series:
    """start, start+step, ... by repeated addition up to stop (+1e-12)."""
    axes = []
    for low, high, inc in zip(start, stop, step):
        if not (inc > 0 and high > low):
            axes.append(np.empty(0))
            continue
        terms = np.full(int((high - low) / inc) + 3, inc)
        terms[0] = low
        line = np.add.accumulate(terms)
        axes.append(line[line <= high + 1e-12])
    return pd.Series(axes)


def candidate_grid(boxes: DataFrame, spacing_km: float, prefix: str = "Grid", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, grid_row, grid_col, name, lat, lon) on a regular spacing inside each west/south/east/north box.

    The longitude step holds at the middle latitude of the box. Degenerate boxes give nothing.
    Rows are spread over the cluster before columns are generated.
    """
    middle = F.radians((F.col("south") + F.col("north")) / 2.0)
    usable = boxes.filter((F.lit(spacing_km) > 0) & (F.col("north") > F.col("south")) & (F.col("east") > F.col("west")))
    axes = usable.withColumns(
        {
            "_lats": _accumulated_axis("south", "north", F.lit(spacing_km / KM_PER_DEGREE)),
            "_lons": _accumulated_axis("west", "east", F.lit(spacing_km) / (F.lit(KM_PER_DEGREE) * F.cos(middle))),
        }
    )
    rows = axes.select(*keys, "_lons", F.posexplode("_lats").alias("grid_row", "lat"))
    spark = boxes.sparkSession
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grid_row")
    cells = rows.select(*keys, "grid_row", "lat", F.posexplode("_lons").alias("grid_col", "lon"))
    name = F.concat_ws("-", F.lit(prefix), F.col("grid_row").cast("string"), F.col("grid_col").cast("string"))
    return cells.select(*keys, "grid_row", "grid_col", name.alias("name"), "lat", "lon")


def candidate_grid_in_zones(zones: DataFrame, spacing_km: float) -> DataFrame:
    """Grid over the box of every zone, kept where it falls inside that zone."""
    grids = candidate_grid(zone_bounds(zones.filter(F.size("polygon") >= 3)), spacing_km, "Grid", ("zone_id",))
    shapes = zones.select("zone_id", polygon_edges(F.col("polygon")).alias("_edges"))
    return grids.join(shapes, "zone_id").filter(inside_edges("lon", "lat", "_edges")).drop("_edges")


def sample_lattice(boxes: DataFrame, n: int) -> DataFrame:
    """Box columns plus (sample, lat, lon): centres of an n x n division of each box."""
    k = F.col("sample")
    return boxes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumns(
        {
            "lat": F.col("south") + (F.floor(k / n) + 0.5) / n * (F.col("north") - F.col("south")),
            "lon": F.col("west") + (k % n + 0.5) / n * (F.col("east") - F.col("west")),
        }
    )


# --- nearest neighbours ------------------------------------------------------


def nearest_by_degrees(points: DataFrame, k: int, levels: int = 26) -> DataFrame:
    """(id, other, d2): the ``k`` nearest points, itself included, by squared degrees; ties by ``other``.

    Exact in one pass. Points on one spot share one answer, and only the ``k`` lowest ids of a
    spot can be in any answer, so each spot asks once and offers at most ``k`` ids. The edges of square cells
    double from level to level. A spot uses the smallest level whose 3 x 3 cells offer
    ``k`` points; its k-th neighbour is then closer than three cell edges, and the 7 x 7 cells of that
    level hold it. Lone spots use large cells, crowded ones small cells; only per-cell counts
    are compared to decide, so no crowd is ever paired with itself as a whole. The offers of the 7 x 7 cells are brought
    to the cell in the middle, where its spots are answered. Tables of several rows a point look small to Spark, so they are
    kept from being broadcast.
    """
    extent = points.agg(
        F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.min("lon").alias("w"),
        F.count(F.lit(1)).alias("count"),
    ).first()
    if not extent["count"]:
        return points.select("id", F.col("id").alias("other"), F.lit(0.0).alias("d2")).limit(0)
    span = max(extent["n"] - extent["s"], extent["e"] - extent["w"], 1e-9) * (1 + 1e-9)
    k = min(k, extent["count"])
    edge0, south, west = span / 2.0**levels, extent["s"], extent["w"]

    def at(level: Column, axis: str) -> Column:
        base = south if axis == "lat" else west
        return F.floor((F.col(axis) - base) / (F.lit(edge0) * F.pow(F.lit(2.0), level)))

    def around(axis: str, reach: int = 1) -> Column:
        return F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach))

    on_spot = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
    offers = points.select(F.col("id").alias("other"), F.col("id"), "lat", "lon").withColumn("_k", on_spot).filter(F.col("_k") <= k)
    offers = cut_lineage(offers.select("other", "lat", "lon"))
    every_level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    cells = (
        offers.select("lat", "lon", every_level.alias("level"))
        .groupBy("level", at(F.col("level"), "lat").alias("cy"), at(F.col("level"), "lon").alias("cx"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = cut_lineage(cells)
    # levels none of whose 3 x 3 cells can offer k points are passed over; one row a level comes back
    used = [r["level"] for r in cells.groupBy("level").agg(F.max("n").alias("n")).collect() if 9 * r["n"] >= k]
    cells = cells.filter(F.col("level").isin(used))
    # Counts of the 3 x 3 cells, rows first and columns second.
    tall = cells.select("level", around("cy").alias("cy"), "cx", "n").groupBy("level", "cy", "cx").agg(F.sum("n").alias("n"))
    wide = tall.select("level", "cy", around("cx").alias("cx"), "n").groupBy("level", "cy", "cx").agg(F.sum("n").alias("n"))
    ready = wide.filter(F.col("n") >= k).select("level", "cy", "cx")
    spots = offers.select("lat", "lon").distinct()
    cell = ["level", "cy", "cx"]
    probes = spots.select("lat", "lon", F.explode(F.array(*map(F.lit, sorted(used)))).alias("level"))
    probes = probes.withColumns({"cy": at(F.col("level"), "lat"), "cx": at(F.col("level"), "lon")})
    chosen = probes.join(ready.hint("merge"), cell, "left_semi").groupBy("lat", "lon").agg(F.min("level").alias("level"))
    asking = cut_lineage(chosen.withColumns({"cy": at(F.col("level"), "lat"), "cx": at(F.col("level"), "lon")}))
    homes = asking.select("level", F.col("cy").alias("hy"), F.col("cx").alias("hx")).distinct()
    homes = homes.select("*", F.col("hy").alias("cy"), F.col("hx").alias("cx"))
    homes = homes.select("level", "hy", "hx", around("cy", 3).alias("cy"), "cx").select("level", "hy", "hx", "cy", around("cx", 3).alias("cx"))
    offered = offers.select("other", "lat", "lon", F.explode(F.array(*map(F.lit, sorted(used)))).alias("level"))
    offered = offered.withColumns({"cy": at(F.col("level"), "lat"), "cx": at(F.col("level"), "lon")})
    brought = homes.join(offered.hint("merge"), cell).select("level", F.col("hy").alias("cy"), F.col("hx").alias("cx"), "other", "lat", "lon")
    met = asking.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}).join(brought.hint("merge"), cell)
    d_lat, d_lon = F.col("lat") - F.col("_lat"), F.col("lon") - F.col("_lon")
    edge = F.lit(edge0) * F.pow(F.lit(2.0), F.col("level"))
    near = met.select(*cell, "_lat", "_lon", "other", (d_lat * d_lat + d_lon * d_lon).alias("d2")).filter(F.col("d2") <= 9.0 * edge * edge)
    order = Window.partitionBy(*cell, "_lat", "_lon").orderBy("d2", "other")  # a spot has one cell: the rows stay where they met
    answers = near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).select("_lat", "_lon", "other", "d2")
    named = points.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return named.join(answers.hint("merge"), ["_lat", "_lon"]).select("id", "other", "d2")


def nearest_between(left: DataFrame, right: DataFrame, right_id: str, out: str = "nearest_km", out_id: str = "nearest_id",
                    depth: int = 12, leaf: int = 32) -> DataFrame:
    """``left`` (lat, lon, ...) with the great-circle distance to the nearest point of ``right`` (id, lat, lon), and its id.

    Exact, without a search radius. A count pyramid holds the cells of the right side, each with the bounds of its points
    and one of them. A round opens the cells that a left spot still has to look into: the point of a cell bounds the answer
    from above, its bounds from below, and cells that cannot hold a nearer point fall out. Cells of at most ``leaf`` spots
    are left to one equi-join at the end. Points on one spot count once on both sides. Equal distances give the
    lowest id; left rows without a position, and all rows when the right side is empty, get NULL.
    """
    spots = right.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min(right_id).alias("_id"))
    spots = cut_lineage(spots)
    extent = spots.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.count(F.lit(1)).alias("count")).first()
    kind = dict(right.dtypes)[right_id]
    if not extent["count"]:
        return left.withColumns({out: F.lit(None).cast("double"), out_id: F.lit(None).cast(kind)})
    high, wide = max(extent["n"] - extent["s"], 1e-9), max(extent["e"] - extent["w"], 1e-9)
    depth = min(depth, max(1, math.ceil(math.log(max(2, extent["count"]), 4)) + 4))
    finest = 4**depth

    def fine(axis: str, base: float, span: float) -> Column:
        return F.least(F.lit(finest - 1), F.floor((F.col(axis) - base) / span * finest)).cast("long")

    placed = spots.withColumns({"_y": fine("lat", extent["s"], high), "_x": fine("lon", extent["w"], wide)})
    at = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumns(
        {axis: F.floor(F.col(axis) / F.pow(F.lit(4.0), F.lit(depth) - F.col("level"))) for axis in ("_y", "_x")})
    cells = at.groupBy("level", "_y", "_x").agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.min(F.struct("lat", "lon")).alias("one"),
    )
    cells = cut_lineage(cells.withColumn("leaf", (F.col("n") <= leaf) | (F.col("level") == depth)))
    above = (F.floor(F.col(axis) / 4).alias(f"_up{axis}") for axis in ("_y", "_x"))
    children = cells.select("*", *above).withColumn("_parent", F.col("level") - 1)

    d_lat = F.radians(F.greatest(F.col("s") - F.col("_lat"), F.col("_lat") - F.col("t"), F.lit(0.0)))
    turn = F.abs(F.pmod(F.col("_lon") - (F.col("w") + F.col("e")) / 2 + 180.0, F.lit(360.0)) - 180.0) - (F.col("e") - F.col("w")) / 2
    d_lon = F.greatest(turn, F.lit(0.0))
    # the nearest point of a box lies on its nearer meridian; a whole meridian circle is no farther
    across = F.asin(F.least(F.lit(1.0), F.cos(F.radians("_lat")) * F.sin(F.radians(F.least(d_lon, F.lit(180.0))))))
    least = F.greatest(d_lat, across, F.lit(0.0)) * EARTH_RADIUS_KM * (1 - 1e-9) - 1e-9
    most = haversine_km("_lat", "_lon", "one.lat", "one.lon") * (1 + 1e-9) + 1e-9
    asked = left.filter("lat is not null and lon is not null").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    root = cells.filter("level = 0").select("_y", "_x", "leaf")
    now = cut_lineage(asked.crossJoin(F.broadcast(root)).withColumns({"level": F.lit(0), "low": F.lit(0.0), "best": F.lit(float("inf"))}))  # one root cell
    names = ["_lat", "_lon", "level", "_y", "_x", "leaf", "low", "best"]
    per_spot = Window.partitionBy("_lat", "_lon")
    waiting = [now.filter("leaf").select(names)]
    for level in range(depth):
        if now.filter("not leaf").isEmpty():
            break
        keys = now.filter("not leaf").select("_lat", "_lon", "best", F.col("level").alias("_parent"), F.col("_y").alias("_up_y"), F.col("_x").alias("_up_x"))
        opened = keys.join(children.filter(F.col("level") == level + 1).hint("merge"), ["_parent", "_up_y", "_up_x"])
        opened = opened.withColumns({"low": least, "best": F.least(F.min(most).over(per_spot), F.col("best"))}).filter("low <= best")
        now = cut_lineage(opened.select(names))
        waiting.append(now.filter("leaf").select(names))
    ends = waiting[0]
    for part in waiting[1:]:
        ends = ends.union(part)
    ends = ends.withColumn("best", F.min("best").over(per_spot)).filter("low <= best").select("_lat", "_lon", "level", "_y", "_x")
    held = at.hint("merge").join(cells.filter("leaf").select("level", "_y", "_x"), ["level", "_y", "_x"])  # many rows a spot: never broadcast
    near = ends.join(held.hint("merge"), ["level", "_y", "_x"]).select("_lat", "_lon", F.struct(haversine_km("_lat", "_lon", "lat", "lon").alias("km"), F.col("_id").alias("id")).alias("_p"))
    found = near.groupBy("_lat", "_lon").agg(F.min("_p").alias("_p"))
    met = left.join(found, (left["lat"] == found["_lat"]) & (left["lon"] == found["_lon"]), "left")
    return met.select(*left.columns, F.col("_p.km").alias(out), F.col("_p.id").alias(out_id))
