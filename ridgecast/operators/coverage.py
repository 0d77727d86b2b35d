"""Combining, thresholding and summarising signal rasters.

Signal tables are sparse: (site_id, row, col, rssi), and no signal is an absent row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.functions.geo import Grid, as_col, round_half_up
from ridgecast.operators.spatial import polygon_edges
from ridgecast.session import cut_lineage


def clean_signal(signal: DataFrame) -> DataFrame:
    """Drops NaN and infinite values, which would otherwise compare as the largest number."""
    v = F.col("rssi")
    return signal.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def combine(signal: DataFrame, method: str = "best") -> DataFrame:
    """(row, col, rssi) over all sites: strongest, mean or weakest signal per pixel."""
    pick = {"best": F.max, "mean": F.avg, "worst": F.min}[method]
    return signal.groupBy("row", "col").agg(pick("rssi").alias("rssi"))


def at_threshold(signal: DataFrame, threshold: float) -> DataFrame:
    return signal.filter(F.col("rssi") >= F.lit(float(threshold)))


def combine_at_threshold(signal: DataFrame, threshold: float, require: str = "any", n_sites: int | None = None) -> DataFrame:
    """(row, col, covered): covered by any site, or by all ``n_sites`` of them."""
    hit = F.col("rssi") >= F.lit(float(threshold))
    grouped = signal.groupBy("row", "col")
    if require == "any":
        return grouped.agg(F.max(hit).alias("covered"))
    return grouped.agg((F.count_if(hit) == F.lit(n_sites)).alias("covered"))


def block_cells(grid: Grid, block: int) -> int:
    return math.ceil(grid.height / block) * math.ceil(grid.width / block)


def cell_id(grid: Grid, block: int) -> Column:
    across = math.ceil(grid.width / block)
    row, col = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    return (row * across + col).cast("long")


def coverage_matrix(signal: DataFrame, grid: Grid, threshold: float, block: int = 4) -> DataFrame:
    """Distinct (site_id, cell_id): a site covers a cell when any pixel of the block reaches the threshold."""
    return at_threshold(signal, threshold).select("site_id", cell_id(grid, block).alias("cell_id")).distinct()


def downsample_mask(mask: DataFrame, block: int = 4) -> DataFrame:
    """(out_row, out_col, covered) by maximum over block x block pixels."""
    return mask.groupBy(
        F.floor(F.col("row") / block).cast("int").alias("out_row"),
        F.floor(F.col("col") / block).cast("int").alias("out_col"),
    ).agg(F.max("covered").alias("covered"))


def covered_fraction(
    mask: DataFrame, total: int | None = None, cells: DataFrame | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(covered_cells, total_cells, covered_fraction), one row or one per ``keys`` of the cells.

    The denominator is ``total`` pixels of a grid, or the rows of ``cells`` (a zone).
    """
    covered = mask.filter("covered").select("row", "col")
    if cells is None:
        counted = covered.agg(F.count(F.lit(1)).alias("covered_cells")).withColumn("total_cells", F.lit(int(total)).cast("long"))
    else:
        flagged = cells.join(covered.withColumn("_hit", F.lit(1)), ["row", "col"], "left")
        counted = flagged.groupBy(*keys).agg(F.count("_hit").alias("covered_cells"), F.count(F.lit(1)).alias("total_cells"))
    share = F.when(F.col("total_cells") > 0, F.col("covered_cells") / F.col("total_cells")).otherwise(F.lit(0.0))
    return counted.withColumn("covered_fraction", share)


def zone_runs(zones: DataFrame, grid: Grid) -> DataFrame:
    """(zone_id, row, col_from, col_to): the pixels whose corner lies in a zone, as runs of columns, by scanline filling.

    ``zones`` is (zone_id, polygon array<struct(lon, lat)>) in the grid's coordinates; rings under three vertices hold
    nothing. A row of the grid crosses a ring at sorted places; between an odd and the next even one it is inside. The
    ends of a run are compared as positions, so a run holds exactly the pixels that a test of each pixel finds. A
    zone makes rows for its own height alone, never one for a pixel. Grids are not turned.
    """
    if grid.b or grid.d or grid.a <= 0 or grid.e == 0:
        raise ValueError("runs are filled along the rows of a grid that is not turned")
    ring = zones.filter(F.size("polygon") >= 3).select("zone_id", polygon_edges(F.col("polygon")).alias("edges"))
    south, north = F.array_min("edges.yi"), F.array_max("edges.yi")
    ends = [(v - grid.f) / grid.e for v in (south, north)]
    first = F.greatest(F.lit(0), F.floor(F.least(*ends)) - 1).cast("int")
    last = F.least(F.lit(grid.height - 1), F.ceil(F.greatest(*ends)) + 1).cast("int")
    rows = ring.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    rows = rows.select("zone_id", "edges", F.explode(F.sequence("_first", "_last")).alias("row")).withColumn("_y", F.col("row") * grid.e + grid.f)
    y = F.col("_y")
    crossed = F.filter("edges", lambda e: (e["yi"] > y) != (e["yj"] > y))
    places = F.array_sort(F.transform(crossed, lambda e: (e["xj"] - e["xi"]) * (y - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"]))
    marked = rows.select("zone_id", "row", places.alias("_x")).filter(F.size("_x") > 1)
    runs = marked.select("zone_id", "row", F.explode(F.expr("transform(sequence(1, size(_x) div 2), k -> struct(_x[2 * k - 2] as low, _x[2 * k - 1] as high))")).alias("_r"))

    def first_at(place: Column) -> Column:
        """The lowest column at or behind a place."""
        near = F.floor((place - grid.c) / grid.a)
        return F.array_min(F.filter(F.sequence(near - 1, near + 2), lambda k: k * grid.a + grid.c >= place))

    found = runs.select("zone_id", "row", first_at(F.col("_r.low")).alias("a"), (first_at(F.col("_r.high")) - 1).alias("b"))
    clipped = found.select("zone_id", "row", F.greatest(F.lit(0), "a").cast("int").alias("col_from"), F.least(F.lit(grid.width - 1), "b").cast("int").alias("col_to"))
    return clipped.filter("col_from <= col_to")


def merged_runs(runs: DataFrame) -> DataFrame:
    """(row, col_from, col_to) of pixels in any zone: the runs of a row, one list a row, put together where they meet."""
    lists = runs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("col_from", "col_to"))).alias("runs"))
    joined = F.expr("""aggregate(slice(runs, 2, size(runs)), slice(runs, 1, 1), (done, r) -> if(r.col_from <= element_at(done, -1).col_to + 1,
        concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).col_from as col_from, greatest(element_at(done, -1).col_to, r.col_to) as col_to))),
        concat(done, array(r))))""")
    return lists.select("row", F.explode(joined).alias("r")).select("row", "r.col_from", "r.col_to")


def in_runs(pixels: DataFrame, runs: DataFrame, stretch: int = 64) -> DataFrame:
    """Pixels (row, col, ...) with the other columns of the runs that hold them; runs are cut at every ``stretch`` columns to meet them in an equi-join."""
    cut = F.explode(F.sequence(F.floor(F.col("col_from") / stretch), F.floor(F.col("col_to") / stretch)))
    met = pixels.withColumn("_s", F.floor(F.col("col") / stretch)).join(runs.withColumn("_s", cut), ["row", "_s"])
    return met.filter(F.col("col").between(F.col("col_from"), F.col("col_to"))).drop("_s", "col_from", "col_to")


def run_cells(runs: DataFrame, grid: Grid, block: int = 4) -> DataFrame:
    """(cell_id) of the matrix cells that hold a pixel of a run; a run makes one row a cell."""
    across = math.ceil(grid.width / block)
    cells = F.explode(F.sequence(F.floor(F.col("col_from") / block), F.floor(F.col("col_to") / block)))
    return runs.select((F.floor(F.col("row") / block) * across).alias("_r"), cells.alias("_c")).select((F.col("_r") + F.col("_c")).cast("long").alias("cell_id")).distinct()


def zone_fraction(mask: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, covered_cells, total_cells, covered_fraction) of runs; pixels are counted by the runs' lengths, only covered ones are joined."""
    total = runs.groupBy(*keys).agg(F.coalesce(F.sum(F.col("col_to") - F.col("col_from") + 1), F.lit(0)).cast("long").alias("total_cells"))
    hit = in_runs(mask.filter("covered").select("row", "col"), runs.select("row", "col_from", "col_to", *keys))
    covered = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("covered_cells"))
    both = total.join(covered, list(keys), "left") if keys else total.crossJoin(F.broadcast(covered))  # one row each
    both = both.withColumn("covered_cells", F.coalesce("covered_cells", F.lit(0)).cast("long"))
    share = F.when(F.col("total_cells") > 0, F.col("covered_cells") / F.col("total_cells")).otherwise(F.lit(0.0))
    return both.select(*keys, "covered_cells", "total_cells", share.alias("covered_fraction"))


def cover_counts(matrix: DataFrame) -> DataFrame:
    """(cell_id, n_sites): how many sites reach each cell."""
    return matrix.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_sites"))


def redundancy(matrix: DataFrame, n_cells: int, levels: int) -> DataFrame:
    """(level, cells, fraction): cells reached by at least ``level`` sites, level 1..levels."""
    depth = cover_counts(matrix).groupBy(F.least(F.col("n_sites"), F.lit(levels)).alias("depth")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most ``levels`` rows reach this step.
    reached = depth.select(F.explode(F.sequence(F.lit(1), F.col("depth").cast("int"))).alias("level"), "n")
    return reached.groupBy("level").agg(F.sum("n").alias("cells")).withColumn(
        "fraction", F.col("cells") / F.lit(float(n_cells))
    )


def raster_stats(pixels: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.count(value).alias("n_values"),
    )


def percentile_stretch(pixels: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row (n_values, p_low, p_high): elements floor(n*low) and floor(n*high) of the sorted values.

    Ten values or fewer give the first and last. Exact without sorting the raster in one
    task: equal values are counted first, the counts are range-partitioned, and only the
    range that holds a wanted rank is put in order.
    """
    spark = pixels.sparkSession
    counts = pixels.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled, so the assignment is stored once and then only read.
    binned = cut_lineage(counts.repartitionByRange(ranges, "v").withColumn("bin", F.spark_partition_id()))
    per_bin = binned.groupBy("bin").agg(F.sum("n").alias("in_bin"))
    # One row per shuffle partition, so these ordered passes are bounded.
    upto = F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    small = F.col("total") <= 10
    wanted = F.array(
        F.struct(F.lit("p_low").alias("name"), F.when(small, F.lit(0)).otherwise(F.floor(F.col("total") * low)).alias("rank")),
        F.struct(
            F.lit("p_high").alias("name"),
            F.when(small, F.col("total") - 1).otherwise(F.floor(F.col("total") * high)).alias("rank"),
        ),
    )
    located = per_bin.withColumns({"upto": upto, "total": total}).withColumn("w", F.explode(wanted)).select(
        "bin", F.col("w.name").alias("name"), F.col("w.rank").alias("rank"), (F.col("upto") - F.col("in_bin")).alias("below"),
        "upto", "total",
    ).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("upto")))
    run = F.sum("n").over(Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = binned.join(F.broadcast(located), "bin").withColumn("run", F.col("below") + run).filter(
        (F.col("rank") < F.col("run")) & (F.col("rank") >= F.col("run") - F.col("n"))
    )
    return hit.groupBy(F.col("total").alias("n_values")).agg(
        F.max(F.when(F.col("name") == "p_low", F.col("v"))).alias("p_low"),
        F.max(F.when(F.col("name") == "p_high", F.col("v"))).alias("p_high"),
    )


def value_bucket(value, low: float, high: float, visible_from: float | None = None) -> Column:
    """0..255 position of a value in a span; NULL (hidden) below ``visible_from``."""
    v = as_col(value)
    span = high - low if high > low else 1.0
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / span))
    bucket = round_half_up(share * 255.0).cast("int")
    return bucket if visible_from is None else F.when(v >= visible_from, bucket)


def masked_export(signal: DataFrame, threshold: float, fill: float = -9999.0) -> DataFrame:
    v = F.col("rssi")
    return signal.withColumn("rssi", F.when(v >= F.lit(float(threshold)), v).otherwise(F.lit(fill)))


def point_coverage(points: DataFrame, signal: DataFrame, threshold: float) -> DataFrame:
    """Per point of interest: covered flag, strongest site (lowest id on ties), number of covering sites.

    Signal is thinned to the pixels that hold points and folded per pixel before it meets
    them, so many points on one pixel never multiply its signal rows.
    """
    pixels = points.select("row", "col").distinct()
    heard = at_threshold(signal, threshold).join(pixels, ["row", "col"], "left_semi")
    per_pixel = heard.groupBy("row", "col").agg(
        F.max(F.struct(F.col("rssi"), (-F.col("site_id")).alias("neg_id"))).alias("_best"),
        F.count(F.lit(1)).alias("n_sites"),
    )
    return (
        points.join(per_pixel, ["row", "col"], "left")
        .withColumn("covered", F.col("n_sites").isNotNull())
        .withColumn("best_site", (-F.col("_best.neg_id")).cast("long"))
        .withColumn("n_sites", F.coalesce("n_sites", F.lit(0)).cast("long"))
        .drop("_best")
    )


def uncovered_points(points: DataFrame, signal: DataFrame, threshold: float) -> DataFrame:
    reached = at_threshold(signal, threshold).select("row", "col").distinct()
    return points.join(reached, ["row", "col"], "left_anti")


def coverage_gaps(cells: DataFrame, matrix: DataFrame, selection: DataFrame) -> DataFrame:
    """Target cells that no selected site covers."""
    covered = matrix.join(selection.select("site_id"), "site_id", "left_semi").select("cell_id").distinct()
    return cells.join(covered, "cell_id", "left_anti")
