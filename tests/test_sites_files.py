"""Readers, writers, text helpers, validation values."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ridgecast import sinks
from ridgecast.functions import text
from ridgecast.functions.geo import Grid, haversine_km, round_half_up, tile_x, tile_y
from ridgecast.operators import agreement as ag
from ridgecast.operators import coverage as cov
from ridgecast.operators.raster import tile_cover
from ridgecast.operators.spatial import candidate_grid
from ridgecast.sources import dimensions as dim
from ridgecast.sources import sites as src


def test_csv_file(spark, tmp_path):
    body = "\n  Name,LAT,lng,elev,description\nA,35.5abc,-82.5,0,x y \n\nA,35.6,-82.4,12.5,\nB,95,0,1,n\n,1,1,1,n\nC,oops,1,1,n\nD,1\n\"E, F\",3,4,5,n\nG,-1.5,2.5"
    (tmp_path / "s.csv").write_text(body)
    rows = {r["name"]: r for r in src.read_sites_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert set(rows) == {"A", "A (3)", "G"}
    assert rows["A"]["lat"] == 35.5 and rows["A"]["elevation_m"] is None and rows["A"]["notes"] == "x y"
    assert rows["A (3)"]["elevation_m"] == 12.5 and rows["A (3)"]["notes"] is None and rows["G"]["line_no"] == 9


def test_csv_line_numbers_across_file_splits(spark, tmp_path):
    lines = ["name,lat,lon"] + [f"S{i % 50},{i % 80},{i % 170}" for i in range(4000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    (tmp_path / "other.csv").write_text("name,lat,lon\nS1,1,1\nS1,2,2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = src.numbered_lines(spark, str(tmp_path)).filter("file like '%big.csv'")
        assert got.rdd.getNumPartitions() >= 1
        assert {r["line_no"]: r["value"] for r in got.collect()} == dict(enumerate(lines))
        names = src.read_sites_csv(spark, str(tmp_path)).filter("file like '%other.csv'").collect()
        assert {r["name"] for r in names} == {"S1", "S1 (2)"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_without_needed_columns_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("name,lat\nA,1")
    with pytest.raises(PySparkException, match="CSV must have columns"):
        src.read_sites_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_geojson_file(spark, tmp_path):
    point = lambda c, **p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": c}, "properties": p}
    doc = {"type": "FeatureCollection", "features": [point([-82, 35], name="A", elevation_m=0), point([-82, 36], name="A", notes="n"), point([-82, 36]), point([1, 99], name="X"), point(["1", 2], name="Y"), {"type": "Feature", "geometry": None, "properties": {}}, point([3, 4], Name="B", elevation_m=None)]}
    (tmp_path / "s.geojson").write_text(json.dumps(doc, indent=1))
    rows = {r["name"]: r for r in src.read_sites_geojson(spark, str(tmp_path / "s.geojson")).collect()}
    assert set(rows) == {"A", "A (2)", "Site 3", "B"}
    assert rows["A"]["elevation_m"] == 0.0 and rows["A (2)"]["notes"] == "n" and rows["B"]["elevation_m"] == 0.0
    (tmp_path / "t.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(PySparkException, match="FeatureCollection"):
        src.read_sites_geojson(spark, str(tmp_path / "t.geojson")).collect()


def test_map_elements(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "Station"}},
        {"type": "node", "id": 2, "lat": 1.0, "lon": 2.0, "tags": {"name": " Station "}},
        {"type": "way", "id": 3, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"amenity": "fire_station"}},
        {"type": "way", "id": 4, "tags": {}}, {"type": "relation", "id": 5}, {"type": "node", "id": 6, "lat": 1.0, "lon": 2.0},
        {"type": "node", "id": 7, "lat": 1.0, "lon": 2.0, "tags": {"tower:type": "cell"}},
    ]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(e) for e in elements))
    got = src.elements_to_sites(src.read_map_elements(spark, str(tmp_path / "e.json")))
    assert {r["element_id"]: r["name"] for r in got.collect()} == {1: "Station", 2: "Station (2)", 3: "Fire Station (OSM 3)", 6: "OSM Site (OSM 6)", 7: "Cell Tower (OSM 7)"}


def test_tag_resolution(spark):
    got = dim.resolve_tags(spark, ["school", "amenity=school", "man_made = water_tower", "cafe"]).orderBy("pos").collect()
    assert [(r["key"], r["value"], r["label"]) for r in got] == [("amenity", "school", "School"), ("man_made", "water_tower", "Water Tower"), ("amenity", "cafe", "Cafe")]
    assert dim.resolve_tags(spark).count() == 5


def test_numbers_and_rounding(spark):
    row = spark.range(1).select(
        text.number_text(F.lit(35.0)).alias("a"), text.number_text(F.lit(0.00025)).alias("b"), text.number_text(F.lit(-82.55)).alias("c"),
        text.number_text(F.lit(12345678.5)).alias("d"), text.fixed_text(F.lit(0.9205), 3).alias("e"), text.fixed_text(F.lit(0.125), 2).alias("f"),
        round_half_up(F.lit(-2.5)).alias("g"), text.leading_number(F.lit(" -1.5e2x")).alias("h"), text.leading_number(F.lit("x1")).alias("i"),
        text.xml_escape(F.lit('a<b>&"c"')).alias("j"), text.number_text(F.lit(0.0)).alias("k"), text.fixed_text(F.lit(1234.5), 0).alias("l"),
    ).first()
    assert list(row) == ["35", "0.00025", "-82.55", "12345678.5", "0.920", "0.13", -2.0, -150.0, None, "a&lt;b&gt;&amp;&quot;c&quot;", "0", "1235"]


def test_site_writers_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("A", 35.5, -82.0, 10.0, None), ("B", 36.0, -81.25, None, "n")], "name string, lat double, lon double, elevation_m double, notes string")
    sinks.write_site_csv(sites.coalesce(1), str(tmp_path / "csv"))
    back = src.read_sites_csv(spark, str(tmp_path / "csv" / "part-*.csv"))
    assert {tuple(r) for r in back.select("name", "lat", "lon", "elevation_m", "notes").collect()} == {tuple(r) for r in sites.collect()}
    sinks.write_lines(sinks.site_features(sites), "feature", str(tmp_path / "json"))
    features = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {f["properties"]["name"]: f["properties"]["notes"] for f in features} == {"A": None, "B": "n"}


def test_masked_raster_writer(spark, tmp_path):
    signal = spark.createDataFrame([(1, 0, 0, -100.0), (1, 0, 1, -130.0), (2, 0, 0, -90.0)], "site_id long, row int, col int, rssi double")
    sinks.write_masked_raster(signal, -120.0, str(tmp_path / "r"))
    assert sorted(r["rssi"] for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [-9999.0, -100.0, -90.0]


def test_result_table_lines(spark):
    summary = spark.createDataFrame([(0.85, 850, 1000)], "covered_fraction double, covered_cells long, total_cells long")
    chosen = spark.createDataFrame([(1, "Site A")], "rank long, name string")
    lines = [r["line"] for r in sinks.result_table(chosen, summary, 12.5, -120.0).orderBy("pos").collect()]
    assert lines == ['"all",0.8500,850,1000,12.50,-120', '"Site A",,,,12.50,-120']


@pytest.mark.parametrize("mask,n", [(lambda r, c: True, 4), (lambda r, c: False, 0), (lambda r, c: r < 2 and c < 2, 1)])
def test_mask_polygons(spark, mask, n):
    frame = spark.createDataFrame([(r, c, mask(r, c)) for r in range(4) for c in range(4)], "row int, col int, covered boolean")
    assert sinks.coverage_cells(frame, Grid(0.1, 0.0, -0.1, 1.0, 4, 4), 2).count() == n


def quadrants(spark, fn):
    return spark.createDataFrame([(1, r, c, -80.0 if fn(r, c) else -120.5) for r in range(4) for c in range(4)], "site_id long, row int, col int, rssi double")


def test_agreement_values(spark):
    p, r = quadrants(spark, lambda r, c: r < 2), quadrants(spark, lambda r, c: c < 2)
    row = ag.rated(ag.agreement(ag.align(p, r), -120.0)).first()
    assert [row[k] for k in ("tp", "tn", "fp", "fn")] == [4, 4, 4, 4]
    assert [row[k] for k in ag.METRICS] == [0.5, 0.5, 0.5, 0.5, 0.3333] and row["rating"] == "poor"
    names = spark.createDataFrame([(1, "a"), (2, "b")], "site_id long, name string")
    size = spark.createDataFrame([(1, 4, 4)], "site_id long, width long, height long")
    counts = ag.pass_counts(ag.validate_sites(names, p, r, size, size)).first()
    assert tuple(counts) == (2, 0, 2)


def test_validation_of_sizes_and_report(spark):
    """A raster of another size is an error row, sparse pixels are not; the report ends with numbered sites."""
    good = [(s, r, c, -80.0) for s in range(1, 7) for r in range(4) for c in range(4) if s != 5]
    pixels = spark.createDataFrame(good, "site_id long, row int, col int, rssi double")
    sparse = pixels.filter("site_id <> 2 or row < 3")
    names = spark.createDataFrame([(k, f"s{k}") for k in range(1, 8)], "site_id long, name string")
    schema = "site_id long, width long, height long"
    ours = spark.createDataFrame([(k, 4, 4) for k in (1, 2, 3, 4, 5, 6)], schema)
    theirs = spark.createDataFrame([(1, 4, 4), (2, 4, 4), (3, 4, 5), (4, 2, 8), (5, 4, 4), (7, 4, 4)], schema)
    results = ag.validate_sites(names, pixels, sparse, ours, theirs)
    got = {r["site_id"]: r for r in results.collect()}
    assert [got[k]["error"] for k in range(1, 8)] == [
        None, None, "Shape mismatch: predicted length 16 vs reference length 20", "Shape mismatch: predicted 4 x 4 vs reference 2 x 8",
        "No valid (finite) pixels to compare", "Reference raster not found", "Predicted raster not found"]
    assert got[2]["jaccard"] == 1.0 and got[3]["jaccard"] is None and {r["site_id"]: r["same_shape"] for r in ag.shape_check(ours, theirs).collect()} == {
        1: True, 2: True, 3: False, 4: False, 5: True, 6: None, 7: None}
    lines = [r["line"] for r in sinks.validation_report(results, "now").orderBy("pos").collect()]
    assert lines[:9] == ["=" * 60, "Coverage Validation Report", "Generated: now", "Sites validated: 7", "=" * 60, "Passed: 2/7", "Failed: 5/7", "",
                         "  [1] s1: PASS (F1=1.000, Jaccard=1.000, Accuracy=1.000)"]
    assert lines[-1] == "  [7] s7: ERROR - Predicted raster not found" and len(lines) == 15
    assert [r["line"] for r in sinks.validation_report(results.filter("false"), "now").orderBy("pos").collect()][5] == "Passed: 0/0"


def test_grid_and_tiles(spark):
    box = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 1.0, 2.0)], "west double, south double, east double, north double")
    names = sorted(r["name"] for r in candidate_grid(box, 111.32, "Test").collect())
    assert names == ["Test-0-0", "Test-0-1", "Test-1-0", "Test-1-1", "Test-2-0", "Test-2-1"]
    row = spark.range(1).select(tile_x(F.lit(-82.6), 12).alias("x"), tile_y(F.lit(35.7), 12).alias("y"), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()
    assert (row["x"], row["y"]) == (1108, 1612) and row["d"] == pytest.approx(111.195, abs=1e-3)
    cover = tile_cover(spark.createDataFrame([(-82.65, 35.5, -82.45, 35.65)], "west double, south double, east double, north double"), 12)
    got = {(r["x"], r["y"]) for r in cover.collect()}
    assert got == {(x, y) for x in (1107, 1108, 1109) for y in (1613, 1614, 1615)}


@pytest.mark.parametrize("n", [3, 10, 11, 200])
def test_stretch_equals_sorted_array(spark, n):
    values = sorted(float((i * 37) % 23 if i % 3 else 5) for i in range(n))
    got = cov.percentile_stretch(spark.createDataFrame([(v,) for v in values] + [(None,)], "elev double"), "elev").first()
    want = (values[0], values[-1]) if n <= 10 else (values[int(n * 0.02)], values[int(n * 0.98)])
    assert (got["n_values"], got["p_low"], got["p_high"]) == (n, *want)


def test_a_feature_collection_read_by_many_tasks(spark, tmp_path):
    """One file in many splits: braces, quotes and backslashes in texts, nested members, objects and arrays beside the features."""
    names = ["plain", "bra{ce", "clo}se}", 'quo"te', "back\\slash", 'both\\"}{', "[list]", "é ü", "", "x" * 300]
    features = []
    for k in range(240):
        props = {"name": f"{names[k % len(names)]} {k // 3}", "elevation_m": k, "notes": names[(k * 7) % len(names)], "more": {"a": [{"b": 1}, {"c": "}"}]}}
        geometry = {"type": "Point", "coordinates": [k * 0.5 - 60, k * 0.25 - 30]} if k % 9 else {"type": "LineString", "coordinates": []}
        features.append({"type": "Feature", "properties": props, "geometry": geometry})
    whole = {"crs": {"type": "name", "properties": {"name": "features"}}, "other": [{"type": "Feature"}], "type": "FeatureCollection", "features": features, "later": [{"type": "Feature"}], "end": {"a": {}}}
    for name, text in (("one.json", json.dumps(whole)), ("pretty.json", json.dumps(whole, indent=2, ensure_ascii=False)), ("none.json", '{"type": "FeatureCollection", "features": []}')):
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for name in ("one.json", "pretty.json"):
            assert spark.read.option("lineSep", "}").text(str(tmp_path / name)).rdd.getNumPartitions() > 5
            got = src.geojson_features(spark, str(tmp_path / name)).orderBy("feature_no").collect()
            assert [r["feature_no"] for r in got] == list(range(1, 241)) and [json.loads(r["feature"]) for r in got] == features
            sites = src.read_sites_geojson(spark, str(tmp_path / name)).collect()
            assert len(sites) == sum(1 for f in features if f["geometry"]["type"] == "Point")
            assert {r["feature_no"]: r["lon"] for r in sites} == {k + 1: f["geometry"]["coordinates"][0] for k, f in enumerate(features) if k % 9}
        assert src.geojson_features(spark, str(tmp_path / "none.json")).count() == 0
        assert src.geojson_features(spark, str(tmp_path)).count() == 480
        (tmp_path / "bad.json").write_text('{"type": "Feature"}')
        with pytest.raises(PySparkException, match="FeatureCollection"):
            src.read_sites_geojson(spark, str(tmp_path / "bad.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_element_positions_in_files(spark, tmp_path):
    """Positions follow the lines of the files, whatever the splits, and the conditions of a request come as a table."""
    for name, first in (("a.json", 0), ("b.json", 100)):
        lines = [json.dumps({"type": "node", "id": first + k, "lat": 1.0, "lon": 2.0 + k / 100, "tags": {"amenity": "school" if k % 3 else "clinic"}}) for k in range(100)]
        (tmp_path / name).write_text("\n".join(lines[:50]) + "\n\n" + "\n".join(lines[50:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        elements = src.read_map_elements(spark, str(tmp_path))
        got = [(r["element_pos"], r["id"]) for r in elements.orderBy("element_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k + (k >= 50) + 101 * f, k + 100 * f) for f in (0, 1) for k in range(100)]
    specs = spark.createDataFrame([("amenity", "clinic"), ("amenity", "clinic"), ("x", "y")], "key string, value string")
    found = src.elements_with_tags(elements, specs, (2.0, 0.0, 2.305, 2.0))
    assert sorted(r["id"] for r in found.collect()) == [k + f for f in (0, 100) for k in range(0, 31, 3)]
    assert src.elements_with_tags(elements, specs.filter("false"), (2.0, 0.0, 3.0, 2.0)).count() == 0
