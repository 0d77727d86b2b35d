"""Blocks, focal filters, hilltops, path loss against numpy and published values."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgecast.functions.geo import Grid, range_steps
from ridgecast.operators import raster as rs
from ridgecast.operators import terrain as ter
from ridgecast.operators.network import suppress_by_distance
from ridgecast.operators.spatial import nearest_by_degrees, site_pairs


def pixels(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, elev float")


def gaussian_dem():
    r, c = np.mgrid[0:30, 0:30]
    return 100 + 200 * np.exp(-((r - 10) ** 2 + (c - 10) ** 2) / 8) + 150 * np.exp(-((r - 22) ** 2 + (c - 22) ** 2) / 8)


GRID = Grid.from_bounds(-82.5, 35.5, -82.4, 35.6, 30, 30)


def test_two_summits(spark):
    dem = pixels(spark, gaussian_dem())
    tops = ter.hilltops(dem, GRID, 0.0, 0.01).orderBy("site_id").collect()
    assert [(t["row"], t["col"]) for t in tops] == [(10, 10), (22, 22)]
    assert [round(t["elev"]) for t in tops] == [300, 250]
    assert ter.hilltops(dem, GRID, 180.0, 0.01).count() == 1
    assert ter.hilltops(dem, GRID, 0.0, 10.0).count() == 1


def test_level_and_empty_rasters_have_no_summit(spark):
    assert ter.hilltops(pixels(spark, np.full((20, 20), 7.0)), GRID, 0.0, 0.01).count() == 0
    assert ter.hilltops(pixels(spark, np.full((20, 20), np.nan)), GRID, 0.0, 0.01).count() == 0


def test_local_maxima_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 12, (45, 38)).astype(float)
    z[rng.random(z.shape) < 0.05] = np.nan
    z[5:14, 5:14] = 6.0  # a plateau across blocks
    grid, radius = Grid(0.001, 0, -0.001, 0, 38, 45), 3
    got = {(r["row"], r["col"]) for r in rs.local_maxima(pixels(spark, z), grid, radius, size=8).collect()}
    want = set()
    for r in range(radius, 45 - radius):
        for c in range(radius, 38 - radius):
            disc = [z[r + i, c + j] for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
            if not np.isnan(z[r, c]) and z[r, c] == np.nanmax(disc) and z[r, c] > np.nanmin(disc):
                want.add((r, c))
    assert got == want


def test_bilinear_rules_and_missing_pixels(spark):
    z = np.arange(70 * 70, dtype=float).reshape(70, 70)
    z[40, 40] = np.nan
    grid = Grid(1.0, 0.0, 1.0, 0.0, 70, 70)
    raster = rs.BlockRaster.of(pixels(spark, z).filter("not (row = 10 and col = 12)"), grid)
    rows = [(0, 3.25, 4.5), (1, 69.0, 69.0), (2, 69.2, 3.0), (3, 39.5, 40.0), (4, 10.0, 11.5), (5, -0.1, 0.0), (6, 31.5, 31.5), (7, 39.0, 40.0)]
    points = spark.createDataFrame(rows, "id int, pr double, pc double")
    shared = {r["id"]: r["z"] for r in raster.bilinear(points, "pr", "pc", "z").collect()}
    assert shared[0] == pytest.approx(3.25 * 70 + 4.5) and shared[1] == 69 * 70 + 69 and shared[6] == pytest.approx(31.5 * 71)
    assert shared[2] is None and shared[3] is None and shared[4] is None and shared[5] is None and shared[7] is None
    strict = {r["id"]: r["z"] for r in raster.bilinear(points, "pr", "pc", "z", "strict").collect()}
    assert strict[7] == 39 * 70 + 40 and strict[1] == 69 * 70 + 69 and strict[2] is None and strict[4] is None


def test_broadcast_and_shuffled_lookups_agree(spark):
    z = np.random.default_rng(1).random((50, 50))
    grid = Grid(1.0, 0.0, 1.0, 0.0, 50, 50)
    points = spark.range(400).selectExpr("id", "id % 47 + 0.37 as pr", "(id * 7) % 48 + 0.61 as pc")
    small = rs.BlockRaster.of(pixels(spark, z), grid)
    large = rs.BlockRaster.of(pixels(spark, z), grid)
    large.small = False
    a, b = ({r["id"]: r["z"] for r in x.bilinear(points, "pr", "pc", "z").collect()} for x in (small, large))
    assert small.small and a == b and len(a) == 400


def test_step_counts():
    assert [len(range_steps(k)) for k in (5, 10, 15, 20, 30, 40)] == [24, 50, 75, 100, 150, 199]


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("centre,spread,km", [((35.0, -82.0), 1.0, 20.0), ((10.0, 179.9), 2.0, 60.0), ((89.0, 0.0), 3.0, 80.0), ((0.0, 0.0), 80.0, 3000.0)])
def test_range_join_equals_all_pairs(spark, centre, spread, km):
    rng = np.random.default_rng(7)
    pts = [(i, float(np.clip(centre[0] + rng.uniform(-spread, spread), -90, 90)), float((centre[1] + rng.uniform(-spread, spread) * (30 if centre[0] > 80 else 1) + 180) % 360 - 180)) for i in range(150)]
    sites = spark.createDataFrame(pts, "site_id long, lat double, lon double")
    rows = site_pairs(sites, km).select("src", "dst").collect()
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and 0.001 <= haversine(a[1:], b[1:]) <= km}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_nearest_with_a_crowded_cell(spark):
    rng = np.random.default_rng(8)
    pts = [(i, float(rng.uniform(0, 10)), float(rng.uniform(0, 10))) for i in range(120)]
    pts += [(120 + i, 5 + float(rng.uniform(0, 1e-3)), 5 + float(rng.uniform(0, 1e-3))) for i in range(120)] + [(240, 40.0, 40.0)] + [(241 + i, 7.5, 7.5) for i in range(60)]
    frame = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {}
    for r in nearest_by_degrees(frame, 7).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    for i, lat, lon in pts:
        order = sorted(pts, key=lambda p: ((p[1] - lat) ** 2 + (p[2] - lon) ** 2, p[0]))
        assert got[i] == {p[0] for p in order[:7]}


def test_suppression_equals_sequential_walk(spark):
    rng = np.random.default_rng(4)
    pts = [(i, i, 35 + float(rng.uniform(0, 0.2)), -82 + float(rng.uniform(0, 0.2))) for i in range(150)]
    kept = []
    for _, o, lat, lon in pts:
        if all(haversine((lat, lon), k[1:]) >= 2.0 for k in kept):
            kept.append((o, lat, lon))
    frame = spark.createDataFrame(pts, "site_id long, ord long, lat double, lon double")
    assert {r["ord"] for r in suppress_by_distance(frame, 2.0).collect()} == {k[0] for k in kept}


def test_elevation_fixture_has_all_orders(spark):
    from catalog import fixtures as fx

    sf = "/root/testdata/sf0.001"
    assert fx.fixture(spark, sf, "rough").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    width = fx.dem_width(spark, sf)
    assert fx.fixture(spark, sf, "rough").filter(f"row >= {width} or col >= {width}").isEmpty()


def test_page_counts_absent_pixels_as_zero(spark):
    grid = Grid(0.1, -83.0, -0.1, 36.0, 10, 10)
    one = spark.createDataFrame([(0, 0, 100.0)], "row int, col int, elev float")
    page = rs.resample_page(one, grid, 36, -83, 20).collect()
    assert len(page) == 400 and all(r["elev"] is not None for r in page)
    assert max(r["elev"] for r in page) > 0 and sum(r["elev"] == 0 for r in page) > 390


@pytest.mark.parametrize("radius", [1, 3, 100])
def test_focal_extremes_of_any_radius(spark, radius):
    rng = random.Random(radius)
    h, w = 70, 90
    cells = {(r, c): float(rng.randint(0, 500)) for r in range(h) for c in range(w) if rng.random() > 0.1}
    frame = spark.createDataFrame([(r, c, z) for (r, c), z in cells.items()], "row int, col int, elev double")
    got = {(r["row"], r["col"]): (r["elev"], r["focal_max"], r["focal_min"]) for r in rs.focal_extremes(frame, Grid(0.1, 0.0, -0.1, 1.0, w, h), radius).collect()}
    assert set(got) == set(cells)
    for r, c in rng.sample(sorted(cells), 60):
        near = [z for (i, j), z in cells.items() if (i - r) ** 2 + (j - c) ** 2 <= radius * radius]
        assert got[r, c] == (cells[r, c], max(near), min(near))


def test_samples_off_the_raster_make_few_rows(spark):
    """Rays that miss the raster are carried by a few rows, not one for each sample, and have no value."""
    from ridgecast.operators import rays

    grid = Grid(0.01, 20.0, -0.01, 36.0, 40, 40)
    pixels = spark.createDataFrame([(r, c, float(r + c)) for r in range(40) for c in range(40)], "row int, col int, elev double")
    ends = spark.createDataFrame([(k, 10.0 + k * 0.001, 5.0, 11.0, 6.0) for k in range(1000)] + [(1000, 35.9, 20.1, 35.7, 20.3)], "k long, lat1 double, lon1 double, lat2 double, lon2 double").coalesce(1)
    raster = rs.BlockRaster.of(pixels, grid)
    fractions = [i / 9 for i in range(10)]
    assert rays._packed(ends, raster, fractions, ("k",), "shared").count() <= 20
    found = rays.fold_rays(ends, raster, fractions, ("k",), (), lambda ray, frac, z: z).groupBy("k").agg(F.min("value").alias("low")).collect()
    assert len(found) == 1001 and {r["k"] for r in found if r["low"] is not None} == {1000}


def test_viewshed_rays_are_bits_when_shuffled(spark):
    """No row for each ray is shuffled (F9, F19); samples above the bits of one number count as well."""
    grid = Grid(0.001, -82.0, -0.001, 35.0, 40, 40)
    pixels = spark.createDataFrame([(r, c, 100.0 + (50.0 if c == 20 else 0.0)) for r in range(40) for c in range(40)], "row int, col int, elev double")
    peaks = spark.createDataFrame([(0, 34.99, -81.99), (1, 34.98, -81.98), (1, 34.98, -81.98), (2, 36.0, -81.9)], "site_id long, lat double, lon double")
    ranks = ter.viewshed_rank(peaks, rs.BlockRaster.of(pixels, grid), grid.bounds, 12)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(site_id" in plan and not re.search(r"hashpartitioning\(site_id#\d+L?, sample", plan)
    got = [(r.site_id, r.viewshed_rank) for r in ranks.collect()]
    found = dict(got)
    assert len(got) == 4 and found[2] == 0.0 and found[0] == 0.0 and found[1] == 1.0  # level ground hides itself


def test_sight_is_sent_as_bits(spark):
    """Verdicts of one source share a number when shuffled (F13, F17); negative ids, and links without a height, are kept apart."""
    parts = spark.createDataFrame([(1, -3, 1.0), (1, -3, 0.0), (1, 62, 1.0), (1, 123, None), (1, 124, 1.0), (1, 124, None)], "src long, dst long, value double")
    bits = ter.verdict_bits(parts, "src", "dst")
    assert {(r.word, bin(r.met).count("1")) for r in bits.collect()} == {(-62, 1), (62, 2), (124, 1)}
    at = ter.place_in_word("dst")
    own = parts.select("src", "dst", (F.col("dst") - F.pmod(F.col("dst"), F.lit(ter.BITS))).alias("word")).distinct()
    got = {r.dst: r.clear for r in own.join(bits, ["src", "word"]).select("dst", ter.clear_bit(at).alias("clear")).collect()}
    assert got == {-3: False, 62: True, 123: None, 124: True}


@pytest.mark.parametrize("rule", ["shared", "strict"])
def test_rays_of_a_held_raster_equal_those_met_by_block(spark, monkeypatch, rule):
    """A small raster is held by every task, so a ray is one row and no sample is shuffled (F2, F3, F8, F9); values are those of the blocks."""
    from ridgecast.operators import rays

    rng = random.Random(7)
    grid = Grid(0.01, 20.0, -0.01, 36.0, 75, 50)
    pixels = spark.createDataFrame([(r, c, rng.random() * 500) for r in range(50) for c in range(75) if rng.random() > 0.02], "row int, col int, elev float")
    def place():
        return 36.05 - rng.random() * 0.6, 19.95 + rng.random() * 0.85
    ends = [(k, *place(), *place()) for k in range(300)] + [(300, 36.0, 20.0, 35.9, 20.0), (301, 35.51, 20.74, 35.51, 20.74), (302, None, 20.0, 35.9, 20.0)]
    links = spark.createDataFrame(ends, "link_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    raster, fractions = rs.BlockRaster.of(pixels, grid), [i / 20 for i in range(21)]

    def lows():
        found = rays.fold_rays(links, raster, fractions, ("link_id",), ("lat1",), lambda ray, frac, z: z + ray["lat1"] + frac, rule)
        return found, {r["link_id"]: r["low"] for r in found.groupBy("link_id").agg(F.min("value").alias("low")).collect()}

    held, got = lows()
    monkeypatch.setattr(rays, "BROADCAST_BYTES", 0)
    apart, want = lows()
    assert held.count() == 303 < apart.count() and got == want


def test_links_that_stand_once_are_judged_without_a_shuffle(spark, monkeypatch):
    """Profiles and sight of links that are one row each need no shuffle where the raster is held (F2, F9, F11, F12)."""
    from ridgecast.operators import rays, spatial, sweep

    rng = random.Random(8)
    grid = Grid(0.002, 20.0, -0.002, 36.0, 70, 70)
    pixels = spark.createDataFrame([(r, c, rng.random() * 150) for r in range(70) for c in range(70) if rng.random() > 0.02], "row int, col int, elev float")
    sites = spark.createDataFrame([(k, 36.01 - rng.random() * 0.16, 19.99 + rng.random() * 0.16, None if k == 3 else 150.0) for k in range(25)], "site_id long, lat double, lon double, elev double")
    raster, links = rs.BlockRaster.of(pixels, grid), spatial.cut_lineage(site_pairs(sites, 12.0, carry=("lat", "lon", "elev")))
    assert spatial.stand_once(sites, "site_id") and not spatial.stand_once(sites.union(sites), "site_id")

    def found(once):
        made = [ter.profiles(links, raster, 30, ("src", "dst"), once), ter.line_of_sight(links, raster, 30, once), sweep.connectivity_graph(sites, raster, 12.0, 30)]
        return made, [{(r["src"], r["dst"]): r.asDict() for r in df.collect()} for df in made]

    alone, got = found(True)
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in alone[:2])
    monkeypatch.setattr(rays, "BROADCAST_BYTES", 0)
    _, want = found(False)
    assert got[0] == want[0] and got[1] == want[1] and got[2] == want[2]
    assert {r["los_clear"] for r in got[1].values()} == {True, False, None}
