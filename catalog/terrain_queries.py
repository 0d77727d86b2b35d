"""Elevation: tiles, resampling, sampling, profiles, line of sight, hilltops, sweeps, plans."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import haversine
from catalog.registry import query, r6, rnd
from catalog.signal_queries import greedy_sql
from catalog.site_queries import ARCS, ENDS, SWEEP, pair_ends, sites, slerp_sql
from ridgecast import plans
from ridgecast.functions.geo import Grid, round_half_up
from ridgecast.functions.radio import params_with
from ridgecast.operators import coverage as cov
from ridgecast.operators import raster as rs
from ridgecast.operators import sweep as sw
from ridgecast.operators import terrain as ter
from ridgecast.operators.spatial import stand_once
from ridgecast.session import cut_lineage
from ridgecast.sources.rasters import wanted_tiles

FINE = ("-82.90::DOUBLE", "0.0003::DOUBLE", "35.80::DOUBLE", "-0.0003::DOUBLE")
REGION = ("-82.90::DOUBLE", "(0.61::DOUBLE / (select w from dims))", "35.805::DOUBLE", "(-0.51::DOUBLE / (select w from dims))")
W = "(select w from dims)"


def dem(spark, sf, name="dem"):
    return fx.fixture(spark, sf, name)


def fine_raster(spark, sf, name="dem"):
    return rs.BlockRaster.of(dem(spark, sf, name), fx.fine_grid(spark, sf)).persisted()


def region_raster(spark, sf, name="rough"):
    return rs.BlockRaster.of(dem(spark, sf, name), fx.region_grid(spark, sf)).persisted()


def pixel_sql(points: str, grid: tuple[str, str, str, str], extra: str = "*") -> str:
    c, a, f, e = grid
    return f"(select {extra}, (lon - {c}) / {a} as pc, (lat - {f}) / {e} as pr from {points})"


def bilinear_sql(points: str, raster: str, out: str, rule: str = "shared", w: str = W, h: str = W, value: str = "elev", expanded: bool = False) -> str:
    """``points`` (pr, pc) with the interpolated value; four left joins, written apart from the block lookups."""
    if rule == "shared":
        ok = f"pc >= 0 and pc <= {w} - 1 and pr >= 0 and pr <= {h} - 1"
        c1, r1 = f"least(c0 + 1, {w} - 1)", f"least(r0 + 1, {h} - 1)"
        v10, v01, v11 = "b.{v}", "c.{v}", "d.{v}"
    else:
        ok = f"floor(pc) >= 0 and floor(pc) < {w} and floor(pr) >= 0 and floor(pr) < {h}"
        c1, r1 = "c0 + 1", "r0 + 1"
        v10 = "case when fx > 0 then b.{v} else a.{v} end"
        v01 = "case when fy > 0 then c.{v} else a.{v} end"
        v11 = "case when fx > 0 and fy > 0 then d.{v} else a.{v} end"
    v10, v01, v11 = (t.format(v=value) for t in (v10, v01, v11))
    mixed = "(v00 + (v10 - v00) * fx) + ((v01 + (v11 - v01) * fx) - (v00 + (v10 - v00) * fx)) * fy"
    if expanded:
        mixed = "v00 + (v10 - v00) * fx + (v01 - v00) * fy + (v11 - v10 - v01 + v00) * fx * fy"
    return f"""(select * exclude (v00, v10, v01, v11, c0, r0, fx, fy, c1, r1), case when v00 is not null and v10 is not null and v01 is not null and v11 is not null
        then {mixed} end as {out}
      from (select q.*, a.{value}::DOUBLE as v00, ({v10})::DOUBLE as v10, ({v01})::DOUBLE as v01, ({v11})::DOUBLE as v11 from
        (select *, {c1} as c1, {r1} as r1 from (select *, case when {ok} then floor(pc)::INT end as c0, case when {ok} then floor(pr)::INT end as r0, pc - floor(pc) as fx, pr - floor(pr) as fy from {points} z0) z1) q
        left join {raster} a on a.row = q.r0 and a.col = q.c0 left join {raster} b on b.row = q.r0 and b.col = q.c1
        left join {raster} c on c.row = q.r1 and c.col = q.c0 left join {raster} d on d.row = q.r1 and d.col = q.c1) y)"""


# --- elevation values ------------------------------------------------------------


@query("flt3_valid_elevation", """select row::BIGINT as row, col::BIGINT as col, elev::DOUBLE as elev from dem where elev is not null and (row + col) % 9 <> 4""", ("dem",))
def _valid(spark, sf):
    code = F.when(F.col("elev").isNull(), F.lit(-32768.0)).when((F.col("row") + F.col("col")) % 9 == 4, F.lit(float("nan"))).otherwise(F.col("elev"))
    coded = dem(spark, sf).withColumn("elev", code)
    return coded.withColumn("elev", rs.valid_elevation("elev")).filter("elev is not null")


@query("agg12_percentile_stretch", """with v as materialized (select elev::DOUBLE as v, row_number() over (order by elev) - 1 as k, count(*) over () as n from rough where elev is not null)
  select max(n) as n_values, max(v) filter (k = floor(n * 0.02)) as p_low, max(v) filter (k = floor(n * 0.98)) as p_high from v""", ("rough",))
def _stretch(spark, sf):
    return cov.percentile_stretch(dem(spark, sf, "rough"), "elev")


@query("agg11_elevation_stats", f"select min(elev)::DOUBLE as min_value, max(elev)::DOUBLE as max_value, {rnd('avg(elev::DOUBLE)')} as mean_value, count(elev) as n_values from rough", ("rough",))
def _stats(spark, sf):
    return cov.raster_stats(dem(spark, sf, "rough").withColumn("elev", F.col("elev").cast("double")), "elev").withColumns(r6("mean_value"))


# --- tiles -----------------------------------------------------------------------


def tiles(spark, sf):
    """The elevation pixels cut into 32 x 32 tiles, from the tile of the grid's north-west corner on."""
    return dem(spark, sf, "rough").select(
        F.lit(fx.ZOOM).alias("zoom"), (F.lit(1104) + F.floor(F.col("col") / 32)).alias("x"), (F.lit(1611) + F.floor(F.col("row") / 32)).alias("y"),
        (F.col("row") % 32).alias("tile_row"), (F.col("col") % 32).alias("tile_col"), F.coalesce("elev", F.lit(-32768.0)).alias("elev"),
    )


TILES = "tiles as materialized (select 1104 + col // 32 as x, 1611 + row // 32 as y, row % 32 as tile_row, col % 32 as tile_col, elev from rough)"


@query("src5_tile_pixels", f"""with {TILES} select 12::BIGINT as zoom, x::BIGINT as x, y::BIGINT as y, tile_row::BIGINT as tile_row, tile_col::BIGINT as tile_col, elev::DOUBLE as elev
  from tiles where x between 1105 and 1106 and y between 1612 and 1613""", ("rough",))
def _tile_pixels(spark, sf):
    step = 360.0 / 4096
    north, south = (math.degrees(math.atan(math.sinh(math.pi - 2 * math.pi * y / 4096))) for y in (1612.5, 1613.5))
    box = spark.createDataFrame([(1105.5 * step - 180, south, 1106.5 * step - 180, north)], "west double, south double, east double, north double")
    return wanted_tiles(tiles(spark, sf), rs.tile_cover(box, fx.ZOOM))


def mosaic_grid(spark, sf) -> Grid:
    """33 columns and 35 rows for each tile across the elevation table."""
    n = math.ceil(fx.dem_width(spark, sf) / 32)
    return Grid.from_bounds(-82.97, 35.80 - 0.095 * n, -82.97 + 0.0935 * n, 35.80, 33 * n, 35 * n)


@query("jn3_tile_mosaic", f"""with {TILES}, across as (select ((w + 31) // 32)::BIGINT as n from dims),
  g as (select i // (33 * n) as row, i % (33 * n) as col, -82.97::DOUBLE + (i % (33 * n)) * (((-82.97::DOUBLE + 0.0935::DOUBLE * n) - -82.97::DOUBLE) / (33 * n)) as lon,
    35.80::DOUBLE + (i // (33 * n)) * (((35.80::DOUBLE - 0.095::DOUBLE * n) - 35.80::DOUBLE) / (35 * n)) as lat from across cross join lateral (select unnest(range(33 * n * 35 * n)) as i) t),
  m as (select *, lon * 20037508.34::DOUBLE / 180 as mx, ln(tan(pi() / 4 + lat * pi() / 360)) * 20037508.34::DOUBLE / pi() as my from g),
  t as (select *, floor((mx + 20037508.34) / 40075016.68::DOUBLE * 4096) as x, floor((20037508.34 - my) / 40075016.68::DOUBLE * 4096) as y from m),
  p as (select *, floor((mx + 20037508.34 - x / 4096 * 40075016.68) / (40075016.68::DOUBLE / 4096 / 32)) as tile_col, floor((20037508.34 - y / 4096 * 40075016.68 - my) / (40075016.68::DOUBLE / 4096 / 32)) as tile_row from t)
  select p.row, p.col, elev::DOUBLE as elev from p left join tiles using (x, y, tile_row, tile_col)""", ("rough", "dims"))
def _mosaic(spark, sf):
    clean = wanted_tiles(tiles(spark, sf))
    return rs.mosaic_tiles(clean, mosaic_grid(spark, sf), fx.ZOOM, 32)


# --- sampling --------------------------------------------------------------------


def sample_points(spark, sf):
    return fx.fixture(spark, sf, "many_sites").select("site_id", "lat", "lon")


@query("jn2_bilinear_sample", f"""select site_id, {rnd('z')} as elev from {bilinear_sql(pixel_sql('many_sites', REGION, 'site_id'), 'rough', 'z')} t""", ("many_sites", "rough", "dims"))
def _sample(spark, sf):
    return ter.sample_at(sample_points(spark, sf), region_raster(spark, sf)).select("site_id", "elev").withColumns(r6("elev"))


@query("jn2_bilinear_strict", f"""select site_id, {rnd('z')} as elev from {bilinear_sql(pixel_sql('many_sites', REGION, 'site_id'), 'rough', 'z', 'strict')} t""", ("many_sites", "rough", "dims"))
def _strict(spark, sf):
    return ter.sample_at(sample_points(spark, sf), region_raster(spark, sf), rule="strict").select("site_id", "elev").withColumns(r6("elev"))


COARSE = Grid.from_bounds(-82.90, 35.80 - 64 * 0.0003, -82.90 + 64 * 0.0003, 35.80, 90, 70)
EDGE = """px as materialized (select *, floor(sc)::INT as c0, floor(sr)::INT as r0, sc - floor(sc) as fx, sr - floor(sr) as fy,
    floor(sc) < 0 or floor(sc) + 1 >= {w} or floor(sr) < 0 or floor(sr) + 1 >= {h} as edge, floor(sc + 0.5)::INT as nc, floor(sr + 0.5)::INT as nr from src)"""


@query("jn4_resample_signal", f"""with g as (select (i // 90)::BIGINT as row, (i % 90)::BIGINT as col, -82.90::DOUBLE + (i % 90) * ((-82.90::DOUBLE + 64 * 0.0003::DOUBLE - -82.90::DOUBLE) / 90) as lon,
    35.80::DOUBLE + (i // 90) * ((35.80::DOUBLE - 64 * 0.0003::DOUBLE - 35.80::DOUBLE) / 70) as lat from range(90 * 70) t(i)),
  src as (select row, col, (lon - -82.90::DOUBLE) / 0.0003::DOUBLE as sc, (lat - 35.80::DOUBLE) / -0.0003::DOUBLE as sr from g), {EDGE.format(w=64, h=64)},
  v as (select a.site_id, p.*, a.rssi as v00, b.rssi as v10, c.rssi as v01, d.rssi as v11 from px p
    join layers a on a.row = case when edge then nr else r0 end and a.col = case when edge then nc else c0 end
    left join layers b on b.site_id = a.site_id and b.row = r0 and b.col = c0 + 1 left join layers c on c.site_id = a.site_id and c.row = r0 + 1 and c.col = c0
    left join layers d on d.site_id = a.site_id and d.row = r0 + 1 and d.col = c0 + 1)
  select site_id, row, col, {rnd('case when edge then v00 else v00 + (v10 - v00) * fx + (v01 - v00) * fy + (v11 - v10 - v01 + v00) * fx * fy end')} as rssi from v
  where edge or (v10 is not null and v01 is not null and v11 is not null)""", ("layers",))
def _resample(spark, sf):
    return rs.resample(fx.fixture(spark, sf, "layers"), fx.SIGNAL_GRID, COARSE, "rssi", ("site_id",)).withColumns(r6("rssi"))


@query("jn4_resample_page", f"""with g as (select (i // 120)::BIGINT as row, (i % 120)::BIGINT as col, -83::DOUBLE + ((i % 120) + 0.5) * (1::DOUBLE / 120) as lon, 35::DOUBLE + ((i // 120) + 0.5) * (1::DOUBLE / 120) as lat from range(120 * 120) t(i)),
  p as (select row, col, greatest(0, least((lon - -82.90::DOUBLE) / (0.61::DOUBLE / w), w - 1)) as pc, greatest(0, least((lat - 35.805::DOUBLE) / (-0.51::DOUBLE / w), w - 1)) as pr from g cross join dims),
  filled as materialized (select a.row, a.col, coalesce(elev, 0) as elev from (select i // w as row, i % w as col from dims cross join lateral (select unnest(range(w * w)) as i) t) a left join rough using (row, col))
  select row as page_row, 119 - col as page_col, floor(greatest(-500, least(9000, z)) + 0.5)::BIGINT as elev from {bilinear_sql('p', 'filled', 'z', expanded=True)} t""", ("rough", "dims"))
def _page(spark, sf):
    return rs.resample_page(dem(spark, sf, "rough"), fx.region_grid(spark, sf), 36, -83, 120)


# --- focal filters and hilltops ----------------------------------------------------


DISC = "disc as (select x.i as dr, y.i as dc from range(-{r}, {r} + 1) x(i) cross join range(-{r}, {r} + 1) y(i) where x.i * x.i + y.i * y.i <= {r} * {r})"


def focal_sql(raster: str, r: int | str) -> str:
    return f"""focal as materialized (select p.row, p.col, p.elev, max(q.elev) as focal_max, min(q.elev) as focal_min
      from {raster} p cross join disc join {raster} q on q.row = p.row + dr and q.col = p.col + dc and q.elev is not null where p.elev is not null group by 1, 2, 3)"""


def peaks_sql(r: int) -> str:
    pad = f"(case when {r} < {W} / 2.0 then {r} else 0 end)"
    return f"""{DISC.format(r=r)}, {focal_sql('rough', r)}, summits as materialized (select *, row_number() over (order by elev desc, row, col) - 1 as ord from focal
      where elev = focal_max and elev > focal_min and row >= {pad} and row < {W} - {pad} and col >= {pad} and col < {W} - {pad})"""


@query("win2_focal_extremes", f"with {DISC.format(r=3)}, {focal_sql('rough', 3)} select row::BIGINT as row, col::BIGINT as col, elev::DOUBLE as elev, focal_max::DOUBLE as focal_max, focal_min::DOUBLE as focal_min from focal", ("rough",))
def _focal(spark, sf):
    return rs.focal_extremes(dem(spark, sf, "rough"), fx.fine_grid(spark, sf), 3)


@query("win3_local_maxima", f"with {peaks_sql(5)} select row::BIGINT as row, col::BIGINT as col, elev::DOUBLE as elev from summits", ("rough", "dims"))
def _maxima(spark, sf):
    return rs.local_maxima(dem(spark, sf, "rough"), fx.fine_grid(spark, sf), 5)


def peaks(spark, sf, radius=5):
    grid = fx.fine_grid(spark, sf)
    return cut_lineage(ter.ordered_peaks(rs.local_maxima(dem(spark, sf, "rough"), grid, radius), grid))


@query("srt2_peaks_by_elevation", f"with {peaks_sql(5)} select ord, row::BIGINT as row, col::BIGINT as col, elev::DOUBLE as elev, {rnd('35.80 - 0.0003::DOUBLE * row')} as lat, {rnd('-82.90 + 0.0003::DOUBLE * col')} as lon from summits", ("rough", "dims"))
def _ordered(spark, sf):
    return peaks(spark, sf).withColumns(r6("lat", "lon"))


HIGHER = """tops as materialized (select ord, row, col, elev::DOUBLE as elev, -0.0003::DOUBLE * row + 35.80::DOUBLE as lat, 0.0003::DOUBLE * col + -82.90::DOUBLE as lon from summits),
  ranked as (select a.ord, b.ord as target, row_number() over (partition by a.ord order by (b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon), b.ord) as k from tops a cross join tops b),
  near_higher as materialized (select ord, target from ranked where k <= 31 and target < ord),
  higher as materialized (select ord, target from near_higher union all select a.ord, b.ord from tops a join tops b on b.ord < a.ord where a.ord not in (select ord from near_higher))"""


@query("jn12_higher_neighbours", f"with {peaks_sql(5)}, {HIGHER} select ord, target from higher", ("rough", "dims"))
def _higher(spark, sf):
    return ter.higher_neighbours(peaks(spark, sf))


PROMINENCE = f"""corner as (select * from (values (-1, 0, 0), (-2, 0, 1), (-3, 1, 0), (-4, 1, 1), (-5, 2, 0), (-6, 2, 1), (-7, 0, 2), (-8, 1, 2)) v(t, r, c)),
  ends as materialized (select a.ord, h.target, 50 as n, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2 from higher h join tops a on a.ord = h.ord join tops b on b.ord = h.target
    union all select 0, t, 100, a.lat, a.lon, 35.80::DOUBLE + -0.0003::DOUBLE * (case r when 0 then 0 when 1 then w - 1 else w // 2 end), -82.90::DOUBLE + 0.0003::DOUBLE * (case c when 0 then 0 when 1 then w - 1 else w // 2 end)
      from tops a cross join corner cross join dims where a.ord = 0), {ARCS},
  steps as (select *, i / (n - 1)::DOUBLE as frac from (select *, unnest(range(n)) as i from arcs) u),
  walked as materialized (select ord, target, z from {bilinear_sql(pixel_sql(slerp_sql('steps', 'frac'), FINE, 'ord, target'), 'rough', 'z', 'strict')} t),
  saddles as (select ord, max(low) as saddle from (select ord, target, min(z) as low from walked group by 1, 2) l group by 1),
  prominent as materialized (select t.*, greatest(0, case when saddle is null or (t.ord = 0 and elev - saddle <= 0) then elev else elev - saddle end) as prominence from tops t left join saddles s on s.ord = t.ord)"""


@query("job7_prominence", f"with {peaks_sql(5)}, {HIGHER}, {PROMINENCE} select ord, {rnd('prominence', 3)} as prominence from prominent", ("rough", "dims"))
def _prominence(spark, sf):
    return ter.prominence(peaks(spark, sf), fine_raster(spark, sf, "rough")).select("ord", round_half_up("prominence", 3).alias("prominence"))


def hilltop_sql(min_prominence: float, km: float, rounds: int) -> str:
    """Suppression unrolled: each round keeps the highest summit left and drops those too close to it."""
    far = haversine("p.lat", "p.lon", "k.lat", "k.lon")
    parts = [f"s0 as materialized (select * from prominent where prominence >= {min_prominence})", "k0 as (select * from s0 where false)"]
    for i in range(1, rounds + 1):
        parts.append(f"k{i} as materialized (select * from k{i - 1} union all (select * from s{i - 1} order by ord limit 1))")
        parts.append(f"s{i} as materialized (select p.* from s{i - 1} p cross join (select * from s{i - 1} order by ord limit 1) k where p.ord <> k.ord and {far} >= {km})")
    return ", ".join(parts)


ROUGH_KM = 0.16  # five pixels of the fine grid


@query("job8_hilltops", f"with {peaks_sql(5)}, {HIGHER}, {PROMINENCE}, {hilltop_sql(20.0, ROUGH_KM, 120)} select ord as site_id, row::BIGINT as row, col::BIGINT as col, elev, {rnd('prominence', 3)} as prominence from k120", ("rough", "dims"))
def _hilltops(spark, sf):
    tops = ter.hilltops(dem(spark, sf, "rough"), fx.fine_grid(spark, sf), 20.0, ROUGH_KM)
    return tops.select("site_id", "row", "col", "elev", round_half_up("prominence", 3).alias("prominence"))


BOX_SQL = f"(35.80 - 0.0003::DOUBLE * {W})", f"(-82.90 + 0.0003::DOUBLE * {W})"


def viewshed_sql(tops: str, n: int) -> str:
    south, east = BOX_SQL
    own = bilinear_sql(pixel_sql(f"(select site_id, lat, lon, lat as lat1, lon as lon1 from {tops})", FINE, "site_id, lat1, lon1"), "rough", "elev1")
    lattice = (
        f"(select site_id, lat1, lon1, elev1, s as sample, {south} + (s // {n} + 0.5) / {n} * (35.80 - {south}) as lat2, "
        f"-82.90 + (s % {n} + 0.5) / {n} * ({east} - -82.90) as lon2 from own cross join range({n * n}) t(s))"
    )
    target = f"(select *, lat2 as lat, lon2 as lon from {lattice})"
    ends = bilinear_sql(pixel_sql(target, FINE, "site_id, sample, lat1, lon1, elev1, lat2, lon2"), "rough", "elev2")
    return f"""own as materialized (select site_id, lat1, lon1, elev1 from {own} o), ends as materialized (select site_id, sample, lat1, lon1, elev1, lat2, lon2, elev2 from {ends} e where elev1 is not null and elev2 is not null), {ARCS},
      rays as (select *, i / 10.0::DOUBLE as frac from arcs cross join range(1, 10) t(i)),
      met as (select * from {bilinear_sql(pixel_sql(slerp_sql('rays', 'frac'), FINE, 'site_id, sample, frac, arc, elev1, elev2'), 'rough', 'z')} m),
      seen as (select site_id, sample, bool_and(arc * 6371000 < 1 or coalesce(z + pow(frac * arc * 6371000, 2) / (2 * 6371000.0::DOUBLE * 4 / 3) <= elev1 + frac * (elev2 - elev1), false)) as visible from met group by 1, 2),
      ranks as materialized (select t.site_id, coalesce(count(*) filter (visible), 0) / {float(n * n)} as viewshed_rank from {tops} t left join seen s on s.site_id = t.site_id group by 1)"""


@query("job4_viewshed_rank", f"with {peaks_sql(5)}, tops as materialized (select ord as site_id, -0.0003::DOUBLE * row + 35.80::DOUBLE as lat, 0.0003::DOUBLE * col + -82.90::DOUBLE as lon from summits), {viewshed_sql('tops', 50)} select site_id, {rnd('viewshed_rank')} as viewshed_rank from ranks", ("rough", "dims"))
def _viewshed(spark, sf):
    tops = peaks(spark, sf).select(F.col("ord").alias("site_id"), "lat", "lon")
    grid = fx.fine_grid(spark, sf)
    return ter.viewshed_rank(tops, fine_raster(spark, sf, "rough"), grid.bounds, 50).withColumns(r6("viewshed_rank"))


def renamed(sql: str, prefix: str, *names: str) -> str:
    """CTE names moved aside, so that parts with equal names can be put together."""
    for n in names:
        sql = re.sub(rf"\b{n}\b", prefix + n, sql)
    return sql


SCOUT = f"""{peaks_sql(5)}, {HIGHER}, {PROMINENCE.replace('ends as', 'pends as').replace('arcs', 'parcs').replace('from ends', 'from pends').replace('steps', 'psteps')}, {hilltop_sql(20.0, ROUGH_KM, 120)},
  hills as materialized (select ord as site_id, row, col, elev, lat, lon, prominence from k120), {renamed(viewshed_sql('hills', 50), 'v', 'own', 'ends', 'arcs', 'rays', 'met')},
  scouted as materialized (select h.*, viewshed_rank from hills h join ranks using (site_id) )"""


@query("job9_scout", f"with {SCOUT} select site_id, row::BIGINT as row, col::BIGINT as col, {rnd('prominence', 3)} as prominence, {rnd('viewshed_rank')} as viewshed_rank from scouted", ("rough", "dims"))
def _scout(spark, sf):
    best = ter.scout(dem(spark, sf, "rough"), fx.fine_grid(spark, sf), None, 20.0, None, 50, ROUGH_KM)
    return best.select("site_id", "row", "col", round_half_up("prominence", 3).alias("prominence"), round_half_up("viewshed_rank", 6).alias("viewshed_rank"))


@query("agg13_visible_fraction", f"with {peaks_sql(8)}, tops as materialized (select ord as site_id, -0.0003::DOUBLE * row + 35.80::DOUBLE as lat, 0.0003::DOUBLE * col + -82.90::DOUBLE as lon from summits), {viewshed_sql('tops', 50)} select site_id, {rnd('viewshed_rank')} as viewshed_rank from ranks", ("rough", "dims"))
def _visible(spark, sf):
    tops = peaks(spark, sf, 8).select(F.col("ord").alias("site_id"), "lat", "lon")
    return ter.viewshed_rank(tops, fine_raster(spark, sf, "rough"), fx.fine_grid(spark, sf).bounds, 50).withColumns(r6("viewshed_rank"))


@query("srt3_top_candidates", """select site_id, viewshed_rank from (select c_custkey as site_id, floor(abs(c_acctbal)) % 97 / 97.0::DOUBLE as viewshed_rank from customer) c order by viewshed_rank desc, site_id limit 50""")
def _top(spark, sf):
    scored = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), (F.floor(F.abs("c_acctbal")) % 97 / F.lit(97.0)).alias("viewshed_rank"))
    return ter.top_candidates(scored, 50)


# --- profiles and links --------------------------------------------------------------


@query("job1_terrain_profiles", f"""with {ENDS}, {ARCS}, f as (select *, i / 99.0::DOUBLE as frac from arcs cross join range(100) t(i)),
  z as materialized (select * from {bilinear_sql(pixel_sql(slerp_sql('f', 'frac'), REGION, 'src, dst, i, arc'), 'rough', 'z')} q)
  select src, dst, {rnd('max(arc) * 6371')} as distance_km, 100::BIGINT as n, {rnd('sum(coalesce(z, 0) * (i + 1))', 3)} as weighted_sum,
    {rnd('coalesce(max(z), 0)')} as max_elev, {rnd('coalesce(min(z), 0)')} as min_elev, {rnd('coalesce(avg(z), 0)')} as avg_elev from z group by 1, 2""", ("pairs", "sites", "rough", "dims"))
def _profiles(spark, sf):
    made = ter.profiles(pair_ends(spark, sf), region_raster(spark, sf), 100, ("src", "dst"), stand_once(sites(spark, sf), "site_id"))
    folded = F.aggregate(F.zip_with("elevations", F.sequence(F.lit(1), F.lit(100)), lambda z, i: z * i), F.lit(0.0), lambda a, b: a + b)
    return made.select(
        "src", "dst", "distance_km", F.size("elevations").cast("long").alias("n"), round_half_up(folded, 3).alias("weighted_sum"), "max_elev", "min_elev", "avg_elev"
    ).withColumns(r6("distance_km", "max_elev", "min_elev", "avg_elev"))


@query("agg8_profile_stats", f"""with {ENDS}, {ARCS}, f as (select *, i / 19.0::DOUBLE as frac from arcs cross join range(20) t(i)),
  z as materialized (select * from {bilinear_sql(pixel_sql(slerp_sql('f', 'frac'), FINE, 'src, dst, i, arc'), 'dem', 'z')} q)
  select src, dst, {rnd('coalesce(max(z), 0)')} as max_elev, {rnd('coalesce(min(z), 0)')} as min_elev, {rnd('coalesce(avg(z), 0)')} as avg_elev from z group by 1, 2""", ("pairs", "sites", "dem", "dims"))
def _profile_stats(spark, sf):
    made = ter.profiles(pair_ends(spark, sf), fine_raster(spark, sf), 20, ("src", "dst"), stand_once(sites(spark, sf), "site_id"))
    return made.select("src", "dst", "max_elev", "min_elev", "avg_elev").withColumns(r6("max_elev", "min_elev", "avg_elev"))


ELEVATED = f"""raised as materialized (select site_id, lat, lon, coalesce(z, 0) + 60 as elev from {bilinear_sql(pixel_sql('sites', REGION, 'site_id, lat, lon'), 'rough', 'z')} t)"""
LOS = f"""{ELEVATED}, ends as materialized (select p.src, p.dst, a.lat as lat1, a.lon as lon1, a.elev as elev1, b.lat as lat2, b.lon as lon2, b.elev as elev2
    from pairs p join raised a on a.site_id = p.src join raised b on b.site_id = p.dst), {ARCS},
  f as (select *, i / 99.0::DOUBLE as frac from arcs cross join range(1, 99) t(i)),
  z as materialized (select * from {bilinear_sql(pixel_sql(slerp_sql('f', 'frac'), REGION, 'src, dst, frac, arc, elev1, elev2'), 'rough', 'z')} q),
  sight as materialized (select src, dst, max(arc) * 6371 as km, bool_and(arc * 6371000 < 1 or coalesce(z, 0) + pow(frac * arc * 6371000, 2) / (2 * 6371000.0::DOUBLE * 4 / 3) <= elev1 + frac * (elev2 - elev1) + 1e-9) as los_clear from z group by 1, 2)"""
LOS_USES = ("pairs", "sites", "rough", "dims")


def raised_sites(spark, sf, raster):
    located = ter.sample_at(fx.fixture(spark, sf, "sites"), raster)
    return located.withColumn("elev", F.coalesce("elev", F.lit(0.0)) + 60.0)


@query("job2_line_of_sight", f"with {LOS} select src, dst, los_clear from sight", LOS_USES)
def _los(spark, sf):
    from ridgecast.operators.spatial import site_pairs

    raster = region_raster(spark, sf)
    pairs = site_pairs(raised_sites(spark, sf, raster), 15.0, carry=("lat", "lon", "elev"))
    return ter.line_of_sight(pairs, raster, once=stand_once(sites(spark, sf), "site_id"))


@query("job10_connectivity_graph", f"with {LOS} select src, dst, {rnd('km', 1)} as distance_km, los_clear, null::DOUBLE as path_loss_db, null::DOUBLE as margin_db from sight", LOS_USES)
def _graph(spark, sf):
    raster = region_raster(spark, sf)
    return sw.connectivity_graph(raised_sites(spark, sf, raster), raster, 15.0)


# --- sweeps --------------------------------------------------------------------------


FS_SWEEP = """{sweep}, px as (select *, floor((lat2 - 35.805) / (-0.51::DOUBLE / w) + 0.5)::BIGINT as row, floor((lon2 - -82.90) / (0.61::DOUBLE / w) + 0.5)::BIGINT as col from points cross join dims),
  own as (select site_id, floor((lat - 35.805) / (-0.51::DOUBLE / w) + 0.5)::BIGINT as row, floor((lon - -82.90) / (0.61::DOUBLE / w) + 0.5)::BIGINT as col, 22.0::DOUBLE as rssi from {sites} s cross join dims),
  kept as (select * from (select p.*, row_number() over (partition by p.site_id, p.row, p.col order by radial, step) as k from px p where p.row >= 0 and p.row < w and p.col >= 0 and p.col < w) k
    where k = 1 and not exists (select 1 from own o where o.site_id = k.site_id and o.row = k.row and o.col = k.col)),
  far as (select site_id, row, col, {km} as d from kept),
  swept as materialized (select site_id, row, col, rssi from own, dims where row >= 0 and row < w and col >= 0 and col < w union all
    select site_id, row, col, floor((22.0 - floor((32.45 + 20 * log10(907.0::DOUBLE) + 20 * log10(d)) * 10 + 0.5) / 10 + 0.0 - 0.5) * 10 + 0.5) / 10 from far)"""
FREE_SWEEP = FS_SWEEP.format(sweep=SWEEP.format(n=150, radials=360, sites="sites"), sites="sites", km=haversine("lat", "lon", "lat2", "lon2"))


@query("job5_sweep_free_space", f"with {FREE_SWEEP} select site_id, row, col, rssi from swept", ("sites", "dims"))
def _free_sweep(spark, sf):
    return sw.coverage_sweep(fx.fixture(spark, sf, "sites"), fx.region_grid(spark, sf), params_with())


@query("snk7_transmitter_pixels", f"with {FREE_SWEEP} select site_id, row, col, rssi from own, dims where row >= 0 and row < w and col >= 0 and col < w", ("sites", "dims"))
def _own(spark, sf):
    return sw.transmitter_pixels(fx.fixture(spark, sf, "sites"), fx.region_grid(spark, sf), params_with())


GAPS = f"""{{swept}}, cells as (select s.site_id, s.lat as lat1, s.lon as lon1, r.i as row, c.i as col, 35.805 + (-0.51::DOUBLE / w) * r.i as plat, -82.90 + (0.61::DOUBLE / w) * c.i as plon
    from {{sites}} s cross join dims cross join lateral (select unnest(range(w)) as i) r cross join lateral (select unnest(range(w)) as i) c
    where abs(35.805 + (-0.51::DOUBLE / w) * r.i - s.lat) < {{km}} / 110.0 and abs(-82.90 + (0.61::DOUBLE / w) * c.i - s.lon) < {{km}} / 88.0),
  gaps as materialized (select c.*, {haversine('lat1', 'lon1', 'plat', 'plon')} as dist, degrees(atan2(sin(radians(plon - lon1)) * cos(radians(plat)), cos(radians(lat1)) * sin(radians(plat)) - sin(radians(lat1)) * cos(radians(plat)) * cos(radians(plon - lon1)))) as raw
    from cells c where not exists (select 1 from swept x where x.site_id = c.site_id and x.row = c.row and x.col = c.col)),
  turned as (select *, case when raw < 0 then raw + 360 else raw end as bear from gaps where dist <= {{km}} and dist >= 0.001),
  slots as materialized (select *, (floor(bear / (360.0::DOUBLE / {{radials}}))::INT % {{radials}}) * (360.0::DOUBLE / {{radials}}) as la, ((floor(bear / (360.0::DOUBLE / {{radials}}))::INT + 1) % {{radials}}) * (360.0::DOUBLE / {{radials}}) as ra from turned),
  asked as (select site_id, row, col, side, pr as probe, dist + delta as km, case when side = 'l' then la else ra end as angle, lat1 as lat, lon1 as lon from slots cross join (values ('l'), ('r')) sd(side)
    cross join (values (0, 0.0::DOUBLE), (1, 0.2::DOUBLE), (2, -0.2::DOUBLE), (3, 0.4::DOUBLE), (4, -0.4::DOUBLE), (5, 3 * 0.2::DOUBLE), (6, -3 * 0.2::DOUBLE)) pb(pr, delta) where dist + delta >= 0.2 and dist + delta <= {{km}}),
  aimed as (select *, asin(sin(radians(lat)) * cos(km / 6371.0) + cos(radians(lat)) * sin(km / 6371.0) * cos(radians(angle))) as phi from asked),
  landed as (select *, floor((degrees(phi) - 35.805) / (-0.51::DOUBLE / w) + 0.5)::BIGINT as prow,
    floor((degrees(radians(lon) + atan2(sin(radians(angle)) * sin(km / 6371.0) * cos(radians(lat)), cos(km / 6371.0) - sin(radians(lat)) * sin(phi))) - -82.90) / (0.61::DOUBLE / w) + 0.5)::BIGINT as pcol from aimed cross join dims),
  hits as (select l.site_id, l.row, l.col, side, arg_min(x.rssi, probe) as v from landed l join swept x on x.site_id = l.site_id and x.row = l.prow and x.col = l.pcol group by 1, 2, 3, 4),
  pairs_h as materialized (select site_id, row, col, max(v) filter (side = 'l') as lv, max(v) filter (side = 'r') as rv from hits group by 1, 2, 3),
  filled as materialized (select p.site_id, p.row, p.col, case when lv is not null and rv is not null then lv + (rv - lv) * least(1, greatest(0, (bear - la) / (case when ra - la < 0 then ra - la + 360 else ra - la end))) else coalesce(lv, rv) end as rssi
    from pairs_h p join slots s using (site_id, row, col) union all select site_id, row, col, rssi from swept)"""
SWEEP_GAPS = GAPS.format(swept=FREE_SWEEP, sites="sites", km=30.0, radials=360)


@query("jn13_radial_probes", f"with {SWEEP_GAPS} select site_id, row, col, lv as left_rssi, rv as right_rssi from pairs_h", ("sites", "dims"))
def _probes(spark, sf):
    grid, points = fx.region_grid(spark, sf), fx.fixture(spark, sf, "sites")
    swept = sw.coverage_sweep(points, grid, params_with())
    return sw.radial_probes(points, swept, grid, 30.0).select("site_id", "row", "col", "left_rssi", "right_rssi")


@query("job6_gap_fill", f"with {SWEEP_GAPS} select site_id, row, col, {rnd('rssi', 4)} as rssi from filled", ("sites", "dims"))
def _fill(spark, sf):
    grid, points = fx.region_grid(spark, sf), fx.fixture(spark, sf, "sites")
    swept = cut_lineage(sw.coverage_sweep(points, grid, params_with()))
    return sw.fill_gaps(points, swept, grid, 30.0).withColumn("rssi", round_half_up("rssi", 4))


# --- plans ---------------------------------------------------------------------------


def sites_as_candidates(spark, sf):
    """Sites ranked by a made-up share, standing in for a viewshed rank."""
    return fx.fixture(spark, sf, "sites").withColumn("viewshed_rank", F.col("site_id") * 37 % 101 / F.lit(101.0))


CANDIDATES = "chosen as materialized (select * from sites)"
CHOSEN_GAPS = GAPS.format(
    swept=FS_SWEEP.format(sweep=SWEEP.format(n=150, radials=360, sites="chosen"), sites="chosen", km=haversine("lat", "lon", "lat2", "lon2")),
    sites="chosen", km=30.0, radials=360,
)


@query("job11_candidate_matrix", f"with {CANDIDATES}, {CHOSEN_GAPS} select distinct site_id, (row // 4) * ceil(w / 4.0)::BIGINT + col // 4 as cell_id from filled cross join dims where rssi >= -82", ("sites", "dims"))
def _candidate_matrix(spark, sf):
    grid = fx.region_grid(spark, sf)
    return plans.candidate_matrix(sites_as_candidates(spark, sf), grid, params_with(), threshold=-82.0)[0]


def planned(spark, sf):
    return plans.mesh_plan(
        dem(spark, sf, "rough"), fx.fine_grid(spark, sf), params_with(), threshold=-70.0, min_prominence=20.0, min_distance_km=ROUGH_KM,
    )


def fine(sql: str) -> str:
    """Sweep text moved from the region grid to the fine grid."""
    for a, b in (("35.805", "35.80"), ("(-0.51::DOUBLE / w)", "(-0.0003::DOUBLE)"), ("(0.61::DOUBLE / w)", "0.0003::DOUBLE"),
                 ("(-0.51::DOUBLE / w", "(-0.0003::DOUBLE"), ("(0.61::DOUBLE / w", "(0.0003::DOUBLE")):
        sql = sql.replace(a, b)
    return sql


PLAN_SWEEP = fine(GAPS.format(
    swept=FS_SWEEP.format(sweep=SWEEP.format(n=150, radials=360, sites="chosen"), sites="chosen", km=haversine("lat", "lon", "lat2", "lon2")),
    sites="chosen", km=30.0, radials=360,
))
PLAN_LINKS = f"""lends as materialized (select * from (select a.site_id as src, b.site_id as dst, a.lat as lat1, a.lon as lon1, a.elev as elev1, b.lat as lat2, b.lon as lon2, b.elev as elev2,
    {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from scouted a join scouted b on a.site_id < b.site_id) q where km <= 30 and km >= 0.001),
  larcs as materialized (select *, km / 6371.0::DOUBLE as arc from lends), lsteps as (select *, i / 99.0::DOUBLE as frac from larcs cross join range(1, 99) t(i)),
  lz as materialized (select * from {bilinear_sql(pixel_sql(slerp_sql('lsteps', 'frac'), FINE, 'src, dst, frac, arc, km, elev1, elev2'), 'rough', 'z')} q),
  links as materialized (select src, dst, {rnd('max(km)', 1)} as distance_km, bool_and(arc * 6371000 < 1 or coalesce(z, 0) + pow(frac * arc * 6371000, 2) / (2 * 6371000.0::DOUBLE * 4 / 3) <= elev1 + frac * (elev2 - elev1) + 1e-9) as los_clear from lz group by 1, 2)"""
SUMMARY = """picks as materialized (select * from p20 where rank > 0), inner_links as materialized (select src as a, dst as b from links where los_clear and src in (select site_id from picks) and dst in (select site_id from picks)
    union all select dst, src from links where los_clear and src in (select site_id from picks) and dst in (select site_id from picks)),
  reach(site_id, node) as (select site_id, site_id from picks union select r.site_id, l.b from reach r join inner_links l on l.a = r.node),
  comps as (select count(distinct c) as k from (select site_id, min(node) as c from reach group by 1) m)"""


@query("job13_mesh_plan_free_space", f"""with recursive {SCOUT}, {PLAN_LINKS}, chosen as materialized (select * from scouted), {PLAN_SWEEP},
  matrix as materialized (select distinct site_id, (row // 4) * ceil(w / 4.0)::BIGINT + col // 4 as cell_id from filled cross join dims where rssi >= -70),
  ncell as materialized (select (ceil(w / 4.0) * ceil(w / 4.0))::BIGINT as n from dims), {greedy_sql(20, '< (select ceil(0.8 * n) from ncell)', 'gain + 0.3 * {n} * linked', flags=True)}, {SUMMARY}
  select count(*) as n_sites, {rnd('max(covered_after) / (select n from ncell)::DOUBLE')} as covered_fraction, {rnd('1 - max(covered_after) / (select n from ncell)::DOUBLE')} as gap_fraction,
    (select count(*) from scouted) as n_candidates, count(*) - (select k from comps) as n_tree_edges, (select k <= 1 from comps) as connected from picks""", ("rough", "dims"))
def _plan(spark, sf):
    return planned(spark, sf)["summary"].withColumns(r6("covered_fraction", "gap_fraction"))


@query("agg15_plan_summary", f"""with recursive {greedy_sql(16, '< ceil(0.8 * 256)', 'gain + 2.5 * {n} * linked', flags=True)},
  picks as materialized (select * from p16 where rank > 0), inner_links as materialized (select src as a, dst as b from links where los_clear and src in (select site_id from picks) and dst in (select site_id from picks)
    union all select dst, src from links where los_clear and src in (select site_id from picks) and dst in (select site_id from picks)),
  reach(site_id, node) as (select site_id, site_id from picks union select r.site_id, l.b from reach r join inner_links l on l.a = r.node),
  comps as (select count(distinct c) as k from (select site_id, min(node) as c from reach group by 1) m)
  select count(*) as n_sites, max(covered_after) / 256.0::DOUBLE as covered_fraction, 1 - max(covered_after) / 256.0::DOUBLE as gap_fraction, (select count(*) from sites) as n_candidates,
    count(*) - (select k from comps) as n_tree_edges, (select k <= 1 from comps) as connected from picks""", ("matrix", "links", "sites"))
def _plan_summary(spark, sf):
    from catalog.signal_queries import N_CELLS, matrix
    from ridgecast.operators.network import spanning_forest
    from ridgecast.operators.selection import select_mesh_sites

    links = fx.fixture(spark, sf, "links")
    picked = select_mesh_sites(matrix(spark, sf), N_CELLS, 0.8, links, 2.5)
    tree, comps = spanning_forest(picked, links)
    return plans.plan_summary(fx.fixture(spark, sf, "sites"), picked, tree, comps, N_CELLS)
