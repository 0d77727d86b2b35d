"""Zone joins, zone runs and nearest points against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ridgecast import plans, sinks
from ridgecast.functions.geo import Grid
from ridgecast.operators import coverage as cov
from ridgecast.operators import spatial as sp

POLYGON = "zone_id long, polygon array<struct<lon:double,lat:double>>"


def inside(x, y, ring):
    odd = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


def star(draw, x, y, size, n):
    """A ring with inward corners, some of them on round numbers."""
    out = []
    for k in range(n):
        r = size * draw.uniform(0.2, 1.0)
        out.append((round(x + r * math.cos(2 * math.pi * k / n), 2), round(y + r * math.sin(2 * math.pi * k / n), 2)))
    return out


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_zones(spark, seed):
    draw = random.Random(seed)
    rings = [star(draw, draw.uniform(-5, 5), draw.uniform(-5, 5), draw.choice([0.05, 1, 8, 300]), draw.choice([3, 4, 9, 200])) for _ in range(25)]
    rings += [[(0.0, 0.0), (1.0, 1.0)], [], [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, 1.0)] * 4]
    spots = [(draw.uniform(-9, 9), draw.uniform(-9, 9)) for _ in range(300)] + [draw.choice(r) for r in rings if r] + [(float(a), float(b)) for a in range(3) for b in range(3)]
    points = spark.createDataFrame(list(enumerate(spots)), "id long, p struct<lon:double,lat:double>").select("id", "p.*", F.lit(1).alias("size"))
    zones = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], POLYGON)
    got = {(r["id"], r["zone_id"]) for r in sp.points_in_zones(points, zones).select("id", "zone_id").collect()}
    assert got == {(k, z) for k, (x, y) in enumerate(spots) for z, ring in enumerate(rings) if len(ring) > 2 and inside(x, y, ring)}
    assert sp.points_in_zones(points, zones.filter("false")).count() == 0 and sp.points_in_zones(points.filter("false"), zones).count() == 0


def test_a_country_beside_many_blocks(spark):
    """Cells follow each zone's own size: no cell meets more than a few zones, and the inside of the country needs no test."""
    draw = random.Random(3)
    country = star(draw, 50, 50, 60, 300)
    blocks = [[(a, b), (a + 0.009, b), (a + 0.009, b + 0.009), (a, b + 0.009)] for a, b in ((k % 100 * 0.01 + 50, k // 100 * 0.01 + 50) for k in range(10_000))]
    zones = spark.createDataFrame([(-1, country), *enumerate(blocks)], POLYGON)
    cover = sp.zone_cover(zones).cache()
    assert cover.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 9
    whole = cover.filter("zone_id = -1")
    assert whole.filter("edges is null").count() > 20 and whole.agg(F.max(F.size("edges"))).first()[0] < 60
    spots = [(draw.uniform(49.9, 51.1), draw.uniform(49.9, 51.1)) for _ in range(500)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "id long, lon double, lat double")
    got = {(r["id"], r["zone_id"]) for r in sp.points_in_zones(points, zones).select("id", "zone_id").collect()}
    rings = {-1: country, **dict(enumerate(blocks))}
    near = {k: [z for z in (-1, *(i for i in (int((x - 50) * 100 + d) + 100 * int((y - 50) * 100 + e) for d in (-1, 0, 1) for e in (-1, 0, 1)) if 0 <= i < 10_000))] for k, (x, y) in enumerate(spots)}
    assert got == {(k, z) for k, (x, y) in enumerate(spots) for z in near[k] if inside(x, y, rings[z])}


def test_zone_runs(spark):
    draw = random.Random(4)
    grid = Grid(0.25, -4.0, -0.25, 4.0, 40, 30)
    rings = [star(draw, draw.uniform(-4, 6), draw.uniform(-4, 5), draw.choice([0.3, 2, 9]), draw.choice([3, 8, 40])) for _ in range(12)]
    rings += [[(-3.0, 0.0), (0.0, 0.0), (0.0, 3.0), (-3.0, 3.0)], [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)], [(0.0, 0.0), (1.0, 0.0)]]
    zones = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], POLYGON)
    want = {(k, r, c) for k, ring in enumerate(rings) if len(ring) > 2 for r in range(30) for c in range(40) if inside(c * 0.25 - 4.0, r * -0.25 + 4.0, ring)}
    runs = cov.zone_runs(zones, grid).cache()
    assert {(x["zone_id"], x["row"], c) for x in runs.collect() for c in range(x["col_from"], x["col_to"] + 1)} == want
    pixels = {(r, c) for _, r, c in want}
    merged = cov.merged_runs(runs).collect()
    filled = [(x["row"], c) for x in merged for c in range(x["col_from"], x["col_to"] + 1)]
    assert len(filled) == len(pixels) and set(filled) == pixels
    assert {x["cell_id"] for x in cov.run_cells(runs, grid, 4).collect()} == {r // 4 * 10 + c // 4 for r, c in pixels}
    covered = {(r, c) for r in range(30) for c in range(40) if (r * 7 + c * 3) % 5 < 2}
    mask = spark.createDataFrame([(r, c, (r, c) in covered) for r in range(30) for c in range(40)], "row int, col int, covered boolean")
    got = {x["zone_id"]: (x["covered_cells"], x["total_cells"]) for x in cov.zone_fraction(mask, runs, ("zone_id",)).collect()}
    assert got == {k: (sum(1 for z, r, c in want if z == k and (r, c) in covered), sum(1 for z, *_ in want if z == k)) for k in {z for z, *_ in want}}
    none = cov.zone_fraction(mask, runs.filter("false")).first()
    assert tuple(none) == (0, 0, 0.0)


def test_report_of_an_empty_zone(spark):
    signal = spark.createDataFrame([(1, 0, 0, -50.0), (2, 3, 3, -50.0)], "site_id long, row int, col int, rssi double")
    grid = Grid(0.25, -4.0, -0.25, 4.0, 8, 8)
    away = spark.createDataFrame([(1, [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)])], POLYGON)
    row = plans.coverage_report(signal, grid, -80.0, 0.5, zones=away).first()
    assert (row["total_pixels"], row["covered_fraction"]) == (0, 0.0)
    assert plans.coverage_report(signal, grid, -80.0, 0.5, zones=away, zone_target=True).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_between(spark, seed):
    draw = random.Random(seed)
    crowd = [(draw.gauss(10, 0.001), draw.gauss(179.999, 0.001)) for _ in range(300)]
    right = [(k, a, b - 360 if b > 180 else b) for k, (a, b) in enumerate(crowd)]
    if seed > 1:
        right += [(1000 + k, draw.uniform(-90, 90), draw.uniform(-180, 180)) for k in range(100)] + [(2000, 90.0, 0.0), (2001, -90.0, 17.0)]
    right += [(5000 + k, right[0][1], right[0][2]) for k in range(3)] + [(None, 3.0, 3.0)] * 0
    left = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(80)] + [(draw.gauss(10, 0.002), -179.9995) for _ in range(30)] + [right[0][1:], (90.0, 5.0), (-90.0, -180.0), (10.0, 180.0), (10.0, -180.0)]
    asked = spark.createDataFrame([(k, *p) for k, p in enumerate(left)] + [(900, None, 1.0), (901, *left[0])], "site long, lat double, lon double")
    offered = spark.createDataFrame([*right, (7000, None, None)], "poi long, lat double, lon double")
    got = {r["site"]: r for r in sp.nearest_between(asked, offered, "poi", leaf=4).collect()}
    for k, p in enumerate(left):
        best = min(km(p, r[1:]) for r in right)
        assert got[k]["nearest_km"] == pytest.approx(best, abs=1e-6)
        assert km(p, next(r[1:] for r in right if r[0] == got[k]["nearest_id"])) == pytest.approx(best, abs=1e-6)
    assert got[len(left) - 5]["nearest_id"] == 0 and got[900]["nearest_km"] is None and got[901]["nearest_km"] == got[0]["nearest_km"] and len(got) == len(left) + 2
    assert sp.nearest_between(asked, offered.filter("poi < 0"), "poi").filter("nearest_km is not null").count() == 0


def test_far_candidates_get_a_distance(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 5.0, ""), (2, 60.0, -100.0, 5.0, "mast")], "site_id long, lat double, lon double, elev double, notes string")
    poi = spark.createDataFrame([(7, 0.0, 90.0)], "poi_id long, lat double, lon double")
    got = {r["site_id"]: r for r in sinks.candidate_scores(sites, poi).collect()}
    assert got[1]["nearest_poi_km"] == pytest.approx(10007.543, abs=1e-3) and got[2]["nearest_poi_km"] > 10000
    assert got[2]["has_infrastructure"] and not got[1]["has_infrastructure"]


def test_pairs_of_one_bucket_are_spread(spark):
    """A crowd in one bucket, read by one task, is paired by several tasks; pairs at both ends of the range and nulls as by a plain loop."""
    draw = random.Random(4)
    spots = [(35.01 + draw.random() * 0.05, 20.01 + draw.random() * 0.05) for _ in range(900)] + [(35.02, 20.02)] * 2 + [(-89.9, 10.0), (-89.9, -170.0), (0.0, 179.99), (0.0, -179.99)]
    rows = [(k, *p) for k, p in enumerate(spots)] + [(5000, None, 1.0)]
    sites = spark.createDataFrame(rows, "site_id long, lat double, lon double").coalesce(1)
    found = sp.site_pairs(sites, 3.0, 0.05, carry=())
    assert found.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    got = {(r["src"], r["dst"]): r["distance_km"] for r in found.collect()}
    want = {(a, b): d for a, p in enumerate(spots) for b, q in enumerate(spots) if a < b and 0.05 <= (d := km(p, q)) <= 3.0}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)


def test_range_ends_are_exact(spark):
    """Pairs exactly as far apart as the range, or as its lower end, count; the next smaller and larger ranges decide otherwise."""
    sites = spark.createDataFrame([(0, 35.0, 20.0), (1, 35.013, 20.017)], "site_id long, lat double, lon double")
    d = sp.site_pairs(sites, 5.0).first()["distance_km"]
    assert sp.site_pairs(sites, d).count() == 1 and sp.site_pairs(sites, math.nextafter(d, 0)).count() == 0
    assert sp.site_pairs(sites, 5.0, d).count() == 1 and sp.site_pairs(sites, 5.0, math.nextafter(d, 9)).count() == 0


@pytest.mark.parametrize("k", [1, 6, 31])
def test_nearest_by_degrees_of_crowds(spark, k):
    """Crowds, spots with many ids and lone points as by a plain loop, and nothing of many rows a point is broadcast."""
    draw = random.Random(k)
    spots = [(draw.gauss(35, 0.001), draw.gauss(20, 0.001)) for _ in range(150)] + [(draw.uniform(-60, 60), draw.uniform(-170, 170)) for _ in range(60)] + [(35.0, 20.0)] * 40
    frame = spark.createDataFrame([(n, *p) for n, p in enumerate(spots)], "id long, lat double, lon double")
    found = sp.nearest_by_degrees(frame, k)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["other"])
    for n, (a, b) in enumerate(spots):
        assert got[n] == {m for _, m in sorted(((c - a) * (c - a) + (e - b) * (e - b), m) for m, (c, e) in enumerate(spots))[:k]}


def test_pyramid_of_the_nearest_is_not_broadcast(spark):
    """The join with the points of the leaves, that has a row for each point and level, is hinted to be sorted."""
    right = spark.createDataFrame([(k, k * 0.01, k % 7 * 0.02) for k in range(200)], "id long, lat double, lon double")
    left = spark.createDataFrame([(0.5, 0.05), (None, 1.0)], "lat double, lon double")
    found = sp.nearest_between(left, right, "id")
    assert found._jdf.queryExecution().analyzed().toString().count("strategy=merge") >= 2 and {r["nearest_id"] for r in found.collect()} == {None, 51}
