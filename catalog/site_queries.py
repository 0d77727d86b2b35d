"""Sites: readers, names, exports, geometry columns, grids, joins, link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import haversine
from catalog.registry import num, query, r6, rnd
from catalog.signal_queries import CELLS, CROSSINGS, POLYGON, inside_sql
from ridgecast import sinks
from ridgecast.functions import geo, radio
from ridgecast.functions.geo import round_half_up
from ridgecast.functions.text import with_unique_names
from ridgecast.operators import network as net
from ridgecast.operators import spatial as sp
from ridgecast.operators.raster import pixel_frame, target_grid, tile_cover
from ridgecast.operators.sweep import links_by_distance, sweep_points
from ridgecast.operators.terrain import densify, even_fractions
from ridgecast.sources import dimensions as dim
from ridgecast.sources import sites as src

R = 6371.0


def sites(spark, sf):
    return fx.fixture(spark, sf, "sites")


# --- readers and names ---------------------------------------------------------


@query("src1_site_csv", f"with {fx.CSV_ORACLE} select * from csv_sites")
def _csv(spark, sf):
    return src.parse_csv_lines(fx.csv_lines(spark, sf))


@query("win1_unique_names", """select p_partkey as part_id, case when row_number() over (partition by p_name order by p_partkey) > 1
  then p_name || ' (' || p_partkey || ')' else p_name end as name from part""")
def _unique(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"))
    return with_unique_names(part, "name", [], "part_id")


@query("src2_site_geojson", """with raw as (select 'doc-' || (site_id // 64) as file, site_id, site_id % 64 + 1 as feature_no,
    case when site_id % 5 = 0 then 'Site ' || (site_id % 64 + 1) else 'Spot ' || (site_id % 40) end as raw_name,
    round(lat, 4) as lat, round(lon, 4) as lon, case site_id % 3 when 0 then 0.0 when 1 then (site_id % 900)::DOUBLE end as elevation_m
  from many_sites where site_id % 11 <> 0 and site_id % 13 <> 0)
  select file, feature_no, case when row_number() over (partition by file, raw_name order by feature_no) > 1 then raw_name || ' (' || feature_no || ')' else raw_name end as name,
    lat, lon, elevation_m, null::VARCHAR as notes from raw""", ("many_sites",))
def _geojson(spark, sf):
    documents = fx.feature_table(spark, sf).select("file", F.from_json("document", src.GEOJSON_SCHEMA).alias("d"))
    return src.parse_geojson(documents.select("file", "d.type", "d.features"))


OSM = f"""{fx.MAP_ORACLE}, named as (select element_pos, id as element_id, coalesce(given, label || ' (OSM ' || id || ')') as raw_name, lat, lon,
    'OSM element ' || id || ' type=' || type as notes from labelled),
  osm_sites as materialized (select element_pos, element_id, case when row_number() over (partition by raw_name order by element_pos) > 1
    then raw_name || ' (' || element_id || ')' else raw_name end as name, lat, lon, notes from named)"""


@query("src3_map_elements", f"with {OSM} select * from osm_sites")
def _osm(spark, sf):
    return src.elements_to_sites(fx.map_elements(spark, sf))


@query("flt5_tagged_elements", f"""with {fx.MAP_ORACLE} select id, type from labelled
  where tag_value in ('school', 'tower', 'hospital') and lat between 35.4 and 35.7 and lon between -82.8 and -82.4""")
def _tagged(spark, sf):
    specs = dim.resolve_tags(spark, ["school", "man_made=tower", "amenity=hospital", "hospital"])
    return src.elements_with_tags(fx.map_elements(spark, sf), specs, (-82.8, 35.4, -82.4, 35.7)).select("id", "type")


@query("flt6_tag_labels", f"with {fx.MAP_ORACLE} select label, count(*) as n from labelled group by 1")
def _labels(spark, sf):
    elements = fx.map_elements(spark, sf).filter("lat is not null or center is not null")
    return elements.groupBy(src.tag_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("flt1_valid_positions", "select site_id, lat + (site_id % 7) * 20 as lat, lon - (site_id % 9) * 20 as lon from many_sites "
       "where lat + (site_id % 7) * 20 between -90 and 90 and lon - (site_id % 9) * 20 between -180 and 180 and name <> ''", ("many_sites",))
def _valid(spark, sf):
    moved = fx.fixture(spark, sf, "many_sites").withColumns(
        {"lat": F.col("lat") + (F.col("site_id") % 7) * 20, "lon": F.col("lon") - (F.col("site_id") % 9) * 20}
    )
    return moved.filter(src.valid_position() & (F.col("name") != "")).select("site_id", "lat", "lon")


@query("set1_append_sites", f"""with {fx.CSV_ORACLE}, {OSM}
  select name, lat, lon, elevation_m, notes from csv_sites union all select name, lat, lon, null, notes from osm_sites""")
def _append(spark, sf):
    a = src.parse_csv_lines(fx.csv_lines(spark, sf)).select("name", "lat", "lon", "elevation_m", "notes")
    b = src.elements_to_sites(fx.map_elements(spark, sf)).select("name", "lat", "lon", "notes")
    return src.append_sites(a, b)


# --- parameters ----------------------------------------------------------------


DEVICE_SQL = "(values " + ", ".join(f"({i}, '{n}', {p}::DOUBLE, {g}::DOUBLE)" for i, (n, p, g) in enumerate(dim.DEVICES)) + ") d(i, device, power, gain)"
BAND_SQL = "(values " + ", ".join(f"({i}, '{b}', {m}::DOUBLE)" for i, (b, m) in enumerate(dim.BANDS.items())) + ") b(i, band, mhz)"
SF_SQL = "(values " + ", ".join(f"({s}, {v}::DOUBLE)" for s, v in radio.SF_SENSITIVITY_DBM.items()) + ") f(sf, dbm)"


def equipped(spark, sf):
    """Customers as sites with a device, a band (some unknown) and a spreading factor (some outside the table)."""
    many = fx.fixture(spark, sf, "many_sites")
    devices = F.array(*[F.lit(d[0]) for d in dim.DEVICES])
    bands = F.array(*[F.lit(b) for b in dim.BANDS])
    k = F.col("site_id")
    return many.select(
        "site_id", F.get(devices, (k % 11).cast("int")).alias("device"), F.get(bands, (k % 8).cast("int")).alias("band"),
        (F.lit(6) + k % 8).cast("int").alias("spreading_factor"),
    ).withColumn("band", F.coalesce("band", F.lit("XX000")))


EQUIPPED_SQL = f"""gear as materialized (select site_id, (6 + site_id % 8) as spreading_factor, case when d.i = 0 then 22.0 else d.power end::DOUBLE as tx_power_dbm,
    case when d.i = 0 then 2.0 else d.gain end::DOUBLE as tx_gain_dbi, coalesce(b.mhz, 915.0)::DOUBLE as frequency_mhz, coalesce(f.dbm, -130.0)::DOUBLE as rx_sensitivity_dbm,
    d.device, coalesce(b.band, 'XX000') as band
  from many_sites join {DEVICE_SQL} on d.i = site_id % 11 left join {BAND_SQL} on b.i = site_id % 8 left join {SF_SQL} on f.sf = 6 + site_id % 8)"""


@query("jn10_resolved_parameters", f"with {EQUIPPED_SQL} select * from gear", ("many_sites",))
def _resolved(spark, sf):
    return dim.resolve_parameters(equipped(spark, sf))


@query("src7_parameter_dimensions", f"with {EQUIPPED_SQL} select device, band, count(*) as n, sum(tx_power_dbm) as power_sum from gear group by 1, 2", ("many_sites",))
def _dims(spark, sf):
    return dim.resolve_parameters(equipped(spark, sf)).groupBy("device", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tx_power_dbm").alias("power_sum")
    )


@query("prj7_range_estimate", f"""with {EQUIPPED_SQL}, b as (select site_id, 32.45 + 20 * log10(frequency_mhz) as ref, tx_power_dbm - 2.0 - rx_sensitivity_dbm - 10.0 - 0.5 as budget from gear)
  select site_id, case when budget <= ref then 0 else {rnd('pow(10::DOUBLE, (budget - ref) / 25.0)', 2)} end as range_km,
    case when budget <= ref then 0 else {rnd('pow(10::DOUBLE, (budget - ref) / 20.0)', 2)} end as free_space_km from b""", ("many_sites",))
def _range(spark, sf):
    gear = dim.resolve_parameters(equipped(spark, sf))
    p = {**radio.literal_params(radio.DEFAULT_PARAMS)}
    for k in ("tx_power_dbm", "tx_gain_dbi", "frequency_mhz", "rx_sensitivity_dbm", "spreading_factor"):
        p[k] = F.col(k)
    return gear.select("site_id", radio.range_estimate_km(p).alias("range_km"), radio.range_estimate_km(p, True).alias("free_space_km"))


@query("prj6_link_budget", f"""with l as (select src, dst, 32.45 + 20 * log10(907.0::DOUBLE) + 20 * log10(distance_km) as loss from pairs),
  b as (select *, 22.0 - loss + 0.0 - 0.5 as rx from l)
  select src, dst, 22.0::DOUBLE as eirp_dbm, {rnd('loss', 1)} as path_loss_db, {rnd('rx', 1)} as rx_power_dbm, -130.0::DOUBLE as rx_sensitivity_dbm,
    {rnd('rx + 130', 1)} as margin_db, rx + 130 >= 10 as feasible from b""", ("pairs",))
def _budget(spark, sf):
    p = radio.literal_params(radio.DEFAULT_PARAMS)
    pairs = fx.fixture(spark, sf, "pairs")
    loss = radio.free_space_loss_db(p["frequency_mhz"], "distance_km")
    return pairs.withColumn("_loss", loss).withColumns(radio.link_budget(p, "_loss")).drop("_loss", "distance_km")


# --- geometry ------------------------------------------------------------------

BEARING = "degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))"
ENDS = """ends as materialized (select p.src, p.dst, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2
  from pairs p join sites a on a.site_id = p.src join sites b on b.site_id = p.dst)"""


def pair_ends(spark, sf):
    return sp.site_pairs(sites(spark, sf), 15.0)


@query("prj1_distance_bearing", f"""with {ENDS}, b as (select *, {BEARING} as raw from ends)
  select src, dst, {rnd(haversine('lat1', 'lon1', 'lat2', 'lon2'))} as distance_km, {rnd('case when raw < 0 then raw + 360 else raw end')} as bearing from b""", ("pairs", "sites"))
def _bearing(spark, sf):
    ends = pair_ends(spark, sf)
    return ends.select("src", "dst", "distance_km", geo.bearing_deg("lat1", "lon1", "lat2", "lon2").alias("bearing")).withColumns(
        r6("distance_km", "bearing")
    )


DESTINATION = f"""asin(sin(radians(lat)) * cos(km / {R}) + cos(radians(lat)) * sin(km / {R}) * cos(radians(angle)))"""
SWEEP = f"""steps as (select i, (list_reduce(list_transform(range(i + 1), lambda x: 0.2::DOUBLE), lambda a, b: a + b))::DOUBLE as km from range({{n}}) t(i)),
  rays as (select s.site_id, s.lat, s.lon, r.r as radial, 360.0::DOUBLE * r.r / {{radials}} as angle, steps.i as step, steps.km
    from {{sites}} s cross join range({{radials}}) r(r) cross join steps),
  reached as (select *, degrees({DESTINATION}) as lat2 from rays),
  points as materialized (select *, degrees(radians(lon) + atan2(sin(radians(angle)) * sin(km / {R}) * cos(radians(lat)), cos(km / {R}) - sin(radians(lat)) * sin(radians(lat2)))) as lon2 from reached)"""


@query("prj2_sweep_destinations", f"with {SWEEP.format(n=24, radials=8, sites='sites')} select site_id, radial, step, {rnd('lat2')} as lat2, {rnd('lon2')} as lon2 from points", ("sites",))
def _destinations(spark, sf):
    whole = geo.Grid(1.0, -180.0, -1.0, 90.0, 361, 181)
    return sweep_points(sites(spark, sf), whole, 5.0, 8).select("site_id", "radial", "step", "lat2", "lon2").withColumns(r6("lat2", "lon2"))


@query("gen4_sweep_pixels", f"""with {SWEEP.format(n=24, radials=12, sites='sites')},
  px as (select site_id, radial, step, floor((lat2 - 35.805) / (-0.51::DOUBLE / w) + 0.5)::BIGINT as row, floor((lon2 - -82.90) / (0.61::DOUBLE / w) + 0.5)::BIGINT as col, w from points cross join dims)
  select site_id, radial, step, row, col from px where row >= 0 and row < w and col >= 0 and col < w""", ("sites", "dims"))
def _sweep(spark, sf):
    return sweep_points(sites(spark, sf), fx.region_grid(spark, sf), 5.0, 12).select("site_id", "radial", "step", "row", "col")


def slerp_sql(ends: str, fraction: str) -> str:
    """Points of ``ends`` (lat1, lon1, lat2, lon2, arc) at a fraction, as lat and lon."""
    a, b = f"(sin((1 - {fraction}) * arc) / sin(arc))", f"(sin({fraction} * arc) / sin(arc))"
    x = f"({a} * cos(radians(lat1)) * cos(radians(lon1)) + {b} * cos(radians(lat2)) * cos(radians(lon2)))"
    y = f"({a} * cos(radians(lat1)) * sin(radians(lon1)) + {b} * cos(radians(lat2)) * sin(radians(lon2)))"
    z = f"({a} * sin(radians(lat1)) + {b} * sin(radians(lat2)))"
    return (
        f"(select *, case when arc < 1e-12 then lat1 else degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))) end as lat, "
        f"case when arc < 1e-12 then lon1 else degrees(atan2({y}, {x})) end as lon from {ends})"
    )


ARCS = f"arcs as materialized (select *, {haversine('lat1', 'lon1', 'lat2', 'lon2')} / 6371.0::DOUBLE as arc from ends)"


@query("prj3_densified_links", f"""with {ENDS}, {ARCS}, f as (select *, i / 10.0::DOUBLE as frac from arcs cross join range(11) t(i))
  select src, dst, i, {rnd('lat')} as lat, {rnd('lon')} as lon from {slerp_sql('f', 'frac')} p""", ("pairs", "sites"))
def _densify(spark, sf):
    return densify(pair_ends(spark, sf), even_fractions(11)).select("src", "dst", "i", "lat", "lon").withColumns(r6("lat", "lon"))


SHEARED = geo.Grid(0.004, -82.95, -0.003, 35.90, 200, 200, b=0.0005, d=0.0002)


@query("prj4_affine_round_trip", f"""with p as (select site_id, lat, lon, (-0.003 * (lon - -82.95) - 0.0005 * (lat - 35.90)) / (0.004::DOUBLE * -0.003 - 0.0005::DOUBLE * 0.0002) as col,
    (0.004 * (lat - 35.90) - 0.0002 * (lon - -82.95)) / (0.004::DOUBLE * -0.003 - 0.0005::DOUBLE * 0.0002) as row from many_sites)
  select site_id, {rnd('col')} as col, {rnd('row')} as row, {rnd('lon')} as lon, {rnd('lat')} as lat from p""", ("many_sites",))
def _affine(spark, sf):
    col, row = SHEARED.col_row("lon", "lat")
    placed = fx.fixture(spark, sf, "many_sites").select("site_id", col.alias("col"), row.alias("row"))
    lon, lat = SHEARED.lon_lat("col", "row")
    return placed.withColumns({"lon": lon, "lat": lat}).withColumns(r6("col", "row", "lon", "lat"))


@query("prj5_mercator_tiles", f"""with t as (select site_id, lat, lon, lon * 20037508.34::DOUBLE / 180 as mx, ln(tan(pi() / 4 + lat * pi() / 360)) * 20037508.34::DOUBLE / pi() as my,
    floor((lon + 180) / 360 * 4096)::BIGINT as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT as y from many_sites),
  b as (select *, 20037508.34::DOUBLE - (y / 4096.0::DOUBLE) * 40075016.68 as north, (x / 4096.0::DOUBLE) * 40075016.68 - 20037508.34::DOUBLE as west from t)
  select site_id, {rnd('mx', 3)} as mx, {rnd('my', 3)} as my, x, y, {rnd('x / 4096.0::DOUBLE * 360 - 180')} as tile_west,
    {rnd('degrees(atan(0.5 * (exp(pi() - 2 * pi() * y / 4096.0) - exp(-(pi() - 2 * pi() * y / 4096.0)))))')} as tile_north,
    floor((mx - west) / (40075016.68::DOUBLE / 4096 / 256))::BIGINT as tile_col, floor((north - my) / (40075016.68::DOUBLE / 4096 / 256))::BIGINT as tile_row from b""", ("many_sites",))
def _mercator(spark, sf):
    many = fx.fixture(spark, sf, "many_sites").select(
        "site_id", geo.mercator_x("lon").alias("mx"), geo.mercator_y("lat").alias("my"), geo.tile_x("lon", 12).alias("x"), geo.tile_y("lat", 12).alias("y")
    )
    edges = geo.tile_bounds_m("x", "y", 12)
    px = (edges["east"] - edges["west"]) / 256
    return many.select(
        "site_id", round_half_up("mx", 3).alias("mx"), round_half_up("my", 3).alias("my"), "x", "y",
        round_half_up(geo.tile_lon("x", 12), 6).alias("tile_west"), round_half_up(geo.tile_lat("y", 12), 6).alias("tile_north"),
        F.floor((F.col("mx") - edges["west"]) / px).alias("tile_col"), F.floor((edges["north"] - F.col("my")) / px).alias("tile_row"),
    )


BOX = """box as materialized (select site_id, lon - 5 / 111.0::DOUBLE / greatest(cos(radians(lat)), 0.01) as west, lat - 5 / 111.0::DOUBLE as south,
  lon + 5 / 111.0::DOUBLE / greatest(cos(radians(lat)), 0.01) as east, lat + 5 / 111.0::DOUBLE as north from sites)"""


@query("agg7_range_box", f"with {BOX} select {rnd('min(west)')} as west, {rnd('min(south)')} as south, {rnd('max(east)')} as east, {rnd('max(north)')} as north from box", ("sites",))
def _range_box(spark, sf):
    return sp.range_box(sites(spark, sf), 5.0).withColumns(r6("west", "south", "east", "north"))


@query("agg7_degree_snap", f"with {BOX} select floor(min(west)) as west, floor(min(south)) as south, ceil(max(east)) as east, ceil(max(north)) as north from box", ("sites",))
def _snap(spark, sf):
    return sp.degree_snap(sp.range_box(sites(spark, sf), 5.0))


@query("agg7_zone_bounds", "select zone_id, min(x) as west, min(y) as south, max(x) as east, max(y) as north from zone_deg group by 1", ("zone_deg",))
def _zone_bounds(spark, sf):
    return sp.zone_bounds(fx.zones(spark, sf, "zone_deg"))


@query("src4_tile_cover", f"""with {BOX}, t as (select site_id, floor((west + 180) / 360 * 4096)::BIGINT as x0, floor((east + 180) / 360 * 4096)::BIGINT as x1,
    floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * 4096)::BIGINT as y0, floor((1 - ln(tan(radians(south)) + 1 / cos(radians(south))) / pi()) / 2 * 4096)::BIGINT as y1 from box)
  select site_id, 12::BIGINT as zoom, x, y from (select site_id, unnest(range(x0, x1 + 1)) as x, y0, y1 from t) u cross join lateral (select unnest(range(y0, y1 + 1)) as y) v""", ("sites",))
def _cover(spark, sf):
    boxes = sp.range_box(sites(spark, sf), 5.0, ("site_id",))
    return tile_cover(boxes, 12).select("site_id", "zoom", "x", "y")


# --- grids ---------------------------------------------------------------------


def axis_sql(name: str, source: str, key: str, low: str, high: str, step: str) -> str:
    """Repeated addition from low to high + 1e-12."""
    return f"""{name}(k, i, v, hi, inc) as (select {key}, 0::BIGINT, {low}, {high}, {step} from {source}
      union all select k, i + 1, v + inc, hi, inc from {name} where v + inc <= hi + 1e-12)"""


def grid_sql(source: str, key: str, spacing: float) -> str:
    lat_step = f"{spacing} / 111.32::DOUBLE"
    lon_step = f"{spacing} / (111.32::DOUBLE * cos(radians((south + north) / 2)))"
    return f"{axis_sql('ys', source, key, 'south', 'north', lat_step)}, {axis_sql('xs', source, key, 'west', 'east', lon_step)}"


@query("gen1_candidate_grid", f"""with recursive {grid_sql('boxes', 'box_id', 2.5)}
  select ys.k as box_id, ys.i as grid_row, xs.i as grid_col, 'Grid-' || ys.i || '-' || xs.i as name, ys.v as lat, {rnd('xs.v')} as lon from ys join xs on xs.k = ys.k""", ("boxes",))
def _grid(spark, sf):
    return sp.candidate_grid(fx.fixture(spark, sf, "boxes"), 2.5, "Grid", ("box_id",)).withColumns(r6("lon"))


@query("gen2_zone_grid", f"""with recursive bounds as (select zone_id, min(x) as west, min(y) as south, max(x) as east, max(y) as north from zone_deg group by 1),
  {grid_sql('bounds', 'zone_id', 1.0)}, {CROSSINGS.format(corners='zone_deg')},
  cells as (select ys.k as home, ys.i as r, xs.i as c, ys.v as y, xs.v as x from ys join xs on xs.k = ys.k)
  select home as zone_id, r as grid_row, c as grid_col, 'Grid-' || r || '-' || c as name from {inside_sql('cells', 'x', 'y', 'p.home, p.r, p.c, p.x, p.y')} z where zone_id = home""", ("zone_deg",))
def _zone_grid(spark, sf):
    return sp.candidate_grid_in_zones(fx.zones(spark, sf, "zone_deg"), 1.0).select("zone_id", "grid_row", "grid_col", "name")


@query("gen3_sample_lattice", f"""select box_id, s as sample, {rnd('south + (s // 10 + 0.5) / 10 * (north - south)')} as lat, {rnd('west + (s % 10 + 0.5) / 10 * (east - west)')} as lon
  from boxes cross join range(100) t(s)""", ("boxes",))
def _lattice(spark, sf):
    return sp.sample_lattice(fx.fixture(spark, sf, "boxes"), 10).select("box_id", "sample", "lat", "lon").withColumns(r6("lat", "lon"))


@query("gen5_target_grid", f"""with b as (select min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from sites),
  g as (select *, greatest(1, ceil((east - west) / 0.005))::BIGINT as wide, greatest(1, ceil((north - south) / 0.005))::BIGINT as high from b)
  select i // wide as row, i % wide as col, {rnd('west + 0.005 * (i % wide)')} as lon, {rnd('north - 0.005 * (i // wide)')} as lat
  from g cross join lateral (select unnest(range(wide * high)) as i) t""", ("sites",))
def _target(spark, sf):
    b = sites(spark, sf).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    grid = target_grid(*b, pixel_deg=0.005)
    lon, lat = grid.lon_lat("col", "row")
    return pixel_frame(spark, grid).withColumns({"lon": lon, "lat": lat}).withColumns(r6("lon", "lat"))


@query("flt2_points_in_polygon", f"""with {CROSSINGS.format(corners='zone_deg')} select site_id from {inside_sql('many_sites', 'lon', 'lat', 'p.site_id, p.lon, p.lat')} z where zone_id = 2""", ("many_sites", "zone_deg"))
def _in_polygon(spark, sf):
    zone = fx.zones(spark, sf, "zone_deg").filter("zone_id = 2")
    return sp.points_in_zones(fx.fixture(spark, sf, "many_sites"), zone).select("site_id")


@query("jn5_points_in_zones", f"""with {CROSSINGS.format(corners='zone_deg')} select site_id, zone_id from {inside_sql('many_sites', 'lon', 'lat', 'p.site_id, p.lon, p.lat')} z""", ("many_sites", "zone_deg"))
def _in_zones(spark, sf):
    return sp.points_in_zones(fx.fixture(spark, sf, "many_sites"), fx.zones(spark, sf, "zone_deg")).select("site_id", "zone_id")


# --- joins and graph -----------------------------------------------------------


@query("jn1_site_pairs", f"""select src, dst, {rnd('km')} as distance_km from (select a.site_id as src, b.site_id as dst, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km
  from many_sites a join many_sites b on a.site_id < b.site_id) p where km <= 6 and km >= 0.001""", ("many_sites",))
def _pairs(spark, sf):
    return sp.site_pairs(fx.fixture(spark, sf, "many_sites"), 6.0, carry=()).withColumns(r6("distance_km"))


@query("srt1_links_by_distance", "select src, dst, distance_km, los_clear from links", ("links",))
def _sorted_links(spark, sf):
    return links_by_distance(fx.fixture(spark, sf, "links")).select("src", "dst", "distance_km", "los_clear")


FOREST = """clear as materialized (select src, dst, distance_km, row_number() over (order by distance_km, src, dst) as k from links where los_clear),
  both_ways as materialized (select src as a, dst as b, k from clear union all select dst, src, k from clear),
  walk(k, node) as (select k, src from clear union select w.k, e.b from walk w join both_ways e on e.a = w.node and e.k < w.k)"""


@query("itr4_spanning_forest", f"with recursive {FOREST} select src, dst, distance_km from clear c where not exists (select 1 from walk w where w.k = c.k and w.node = c.dst)", ("links",))
def _forest(spark, sf):
    return net.spanning_forest(sites(spark, sf), fx.fixture(spark, sf, "links"))[0]


MEMBERS = "members as materialized (select site_id from sites where site_id % 5 in (0, 2))"
REACH = f"""{MEMBERS}, inner_links as materialized (select src as a, dst as b from links where los_clear and src in (select site_id from members) and dst in (select site_id from members)
    union all select dst, src from links where los_clear and src in (select site_id from members) and dst in (select site_id from members)),
  reach(site_id, node) as (select site_id, site_id from members union select r.site_id, l.b from reach r join inner_links l on l.a = r.node),
  comp as materialized (select site_id, min(node) as component from reach group by 1)"""


def member_sites(spark, sf):
    return sites(spark, sf).filter("site_id % 5 in (0, 2)")


def close_links(spark, sf, km=6.0):
    return fx.links_within(spark, sf, km)


CLOSE = REACH.replace("links where", "links where distance_km <= 6 and")
WHOLE = REACH.replace(" where site_id % 5 in (0, 2)", "")


@query("itr5_components", f"with recursive {WHOLE} select * from comp", ("sites", "links"))
def _components(spark, sf):
    return net.connected_components(sites(spark, sf), fx.fixture(spark, sf, "links"))


@query("itr5_connected_flag", f"with recursive {WHOLE} select count(distinct component) as n_components, count(distinct component) <= 1 as connected from comp", ("sites", "links"))
def _connected(spark, sf):
    return net.is_connected(net.connected_components(sites(spark, sf), fx.fixture(spark, sf, "links")))


NEAR = """near as materialized (select candidate, component, min(distance_km) as d from (
    select src as candidate, dst as site_id, distance_km from links where los_clear and distance_km <= 6 union all select dst, src, distance_km from links where los_clear and distance_km <= 6) l
  join comp using (site_id) where candidate not in (select site_id from members) group by 1, 2)"""


@query("jn14_bridging_candidate", f"""with recursive {CLOSE}, {NEAR}, two as (select n.component as a, m.component as b from near n join near m on m.candidate = n.candidate and n.component < m.component order by 1, 2 limit 1)
  select candidate, cost from (select n.candidate, n.d + m.d as cost from near n join near m on m.candidate = n.candidate join two on n.component = two.a and m.component = two.b) t
  order by cost, candidate limit 1""", ("sites", "links"))
def _bridge(spark, sf):
    links = close_links(spark, sf)
    comps = net.cut_lineage(net.connected_components(member_sites(spark, sf), links))
    # the lowest two components that some site outside both hears
    heard = links.filter("los_clear").select(F.explode(F.array(F.struct(F.col("src").alias("site_id"), F.col("dst").alias("other")),
                                                              F.struct(F.col("dst").alias("site_id"), F.col("src").alias("other")))).alias("p")).select("p.*")
    near = heard.join(comps, "site_id").join(comps.select(F.col("site_id").alias("other")), "other", "left_anti").select("other", "component").distinct()
    both = near.join(near.withColumnRenamed("component", "b"), "other").filter("component < b")
    pair = both.orderBy("component", "b").select("component", "b").first()
    return net.bridging_candidate(links, comps, *(pair or (-1, -1)))


@query("itr8_bridged_components")
def _bridged(spark, sf):
    links = close_links(spark, sf)
    return net.bridge_components(links, net.connected_components(member_sites(spark, sf), links))


@query("itr6_distance_suppression", f"""with recursive close as materialized (select b.site_id as i, list(a.site_id) as near from many_sites a join many_sites b on a.site_id < b.site_id
    and abs(a.lat - b.lat) < 0.03 and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 3 group by 1),
  lists as materialized (select site_id as i, coalesce(near, []) as near from many_sites left join close on i = site_id),
  walk(i, kept) as (select 0::BIGINT, [0::BIGINT] union all select w.i + 1, case when list_has_any(w.kept, l.near) then w.kept else list_append(w.kept, w.i + 1) end from walk w join lists l on l.i = w.i + 1),
  kept as (select unnest(kept) as site_id from (select kept from walk order by i desc limit 1) k)
  select site_id, lat, lon from many_sites where site_id in (select site_id from kept)""", ("many_sites",))
def _suppressed(spark, sf):
    peaks = fx.fixture(spark, sf, "many_sites").withColumn("ord", F.col("site_id"))
    return net.suppress_by_distance(peaks, 3.0).select("site_id", "lat", "lon")


@query("jn12_nearest_by_degrees", f"""with d as (select a.site_id as id, b.site_id as other, pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) as d2 from many_sites a join many_sites b on true)
  select id, other, floor(d2 * 1e9 + 0.5) / 1e9 as d2 from (select *, row_number() over (partition by id order by d2, other) as k from d) t where k <= 31""", ("many_sites",))
def _nearest(spark, sf):
    points = fx.fixture(spark, sf, "many_sites").withColumnRenamed("site_id", "id")
    return sp.nearest_by_degrees(points, 31).withColumn("d2", round_half_up("d2", 9))


@query("prj9_candidate_scores", f"""with c as (select site_id, lat, case when site_id % 7 = 3 then lon - 15 else lon end as lon from sites),
  u as (select site_id as poi_id, lat + 0.0017::DOUBLE as lat, lon + 0.0013::DOUBLE as lon from many_sites),
  d as (select c.site_id, poi_id, {haversine('c.lat', 'c.lon', 'u.lat', 'u.lon')} as km from c cross join u),
  s as (select site_id, min(km) as km from d group by 1)
  select site_id, (site_id * 37 % 500)::DOUBLE as elev, {rnd('km')} as nearest_poi_km, site_id % 3 = 0 as has_infrastructure from c left join s using (site_id)""", ("sites", "many_sites"))
def _scores(spark, sf):
    base = sites(spark, sf).select(
        "site_id", "lat", F.when(F.col("site_id") % 7 == 3, F.col("lon") - 15).otherwise(F.col("lon")).alias("lon"),
        (F.col("site_id") * 37 % 500).cast("double").alias("elev"), F.when(F.col("site_id") % 3 == 0, "tower").alias("notes"),
    )
    poi = fx.fixture(spark, sf, "many_sites").select(F.col("site_id").alias("poi_id"), (F.col("lat") + 0.0017).alias("lat"), (F.col("lon") + 0.0013).alias("lon"))
    return sinks.candidate_scores(base, poi).select("site_id", "elev", "nearest_poi_km", "has_infrastructure")


# --- exports -------------------------------------------------------------------


@query("snk1_site_csv", f"""with {fx.CSV_ORACLE} select name, name || ',' || {num('lat')} || ',' || {num('lon')} || ',' || coalesce({num('elevation_m')}, '') || ',' || notes as line from csv_sites""")
def _csv_out(spark, sf):
    return sinks.site_csv_lines(src.parse_csv_lines(fx.csv_lines(spark, sf)))


@query("snk1_site_csv_quoted", f"""with {fx.CSV_ORACLE} select name, '"' || name || '",' || {num('lat')} || ',' || {num('lon')} || ',' || coalesce({num('elevation_m')}, '') as line from csv_sites""")
def _csv_quoted(spark, sf):
    return sinks.site_csv_lines(src.parse_csv_lines(fx.csv_lines(spark, sf)), quoted=True)


FEATURE = f"""'{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {num('lon')} || ',' || {num('lat')} || ']}},"properties":{{"name":' || to_json(name)
  || ',"elevation_m":' || coalesce({num('elevation_m')}, 'null') || ',"notes":' || coalesce(to_json(notes), 'null') || '}}}}'"""


@query("snk2_site_features", f"with {fx.CSV_ORACLE} select name, {FEATURE} as feature from csv_sites")
def _features(spark, sf):
    return sinks.site_features(src.parse_csv_lines(fx.csv_lines(spark, sf)))


@query("set2_all_features", f"""with {fx.CSV_ORACLE}, {CELLS} select {FEATURE} as feature from csv_sites
  union all select {POLYGON} from boxes""", ("signal",))
def _all_features(spark, sf):
    from catalog.signal_queries import G, mask

    return sinks.all_features(src.parse_csv_lines(fx.csv_lines(spark, sf)), sinks.coverage_cells(mask(spark, sf), G))


ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("snk5_site_placemarks", f"""with s as (select 'A&B <' || name || '> "' || site_id || '"' as name, lat, lon, case when site_id % 2 = 0 then (site_id * 3)::DOUBLE end as h from sites)
  select name, '<Placemark><name>' || {ESC.format('name')} || '</name><description>' || lat || ', ' || lon || coalesce(' (' || {num('h')} || ' m)', '')
  || '</description><Point><coordinates>' || lon || ',' || lat || ',0</coordinates></Point></Placemark>' as placemark from s""", ("sites",))
def _site_marks(spark, sf):
    odd = sites(spark, sf).select(
        F.concat(F.lit("A&B <"), "name", F.lit('> "'), F.col("site_id").cast("string"), F.lit('"')).alias("name"), "lat", "lon",
        F.when(F.col("site_id") % 2 == 0, F.col("site_id") * 3.0).alias("elevation_m"),
    )
    return sinks.site_placemarks(odd)


@query("snk8_tree_features", f"""with recursive {FOREST}, tree as (select src, dst from clear c where not exists (select 1 from walk w where w.k = c.k and w.node = c.dst)),
  t as (select t.src, t.dst, coalesce(margin_db, -1) as m from tree t join links l using (src, dst))
  select src, dst, m as margin_db, case when m >= 10 then 'good' when m >= 3 then 'fair' else 'poor' end as quality,
    '{{"type":"Feature","properties":{{"marginDb":' || {num('m')} || '}},"geometry":{{"type":"LineString","coordinates":[[' || a.lon || ',' || a.lat || '],[' || b.lon || ',' || b.lat || ']]}}}}' as feature
  from t join sites a on a.site_id = src join sites b on b.site_id = dst""", ("links", "sites"))
def _tree(spark, sf):
    links = fx.fixture(spark, sf, "links")
    tree, _ = net.spanning_forest(sites(spark, sf), links)
    return sinks.tree_features(net.broadcast_few(tree).join(links.select("src", "dst", "margin_db"), ["src", "dst"]), sites(spark, sf))
