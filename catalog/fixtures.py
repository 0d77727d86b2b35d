"""Domain tables derived from the supplied tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ridgecast.functions.geo import Grid

SIGNAL_GRID = Grid(0.0003, -82.90, -0.0003, 35.80, 64, 64)
ZOOM, TILE_PX = 12, 32


def idiv(a: str, b: str | int) -> str:
    return f"cast(floor(({a}) / ({b})) as bigint)"


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def site_point(key: str) -> str:
    return (
        f"{d(35.30)} + (({key} * 7919) % 1009) * {d(0.0005)} as lat, "
        f"{d(-82.90)} + (({key} * 104729) % 1013) * {d(0.0006)} as lon"
    )


def _cones() -> str:
    """Cones as (row, col, height, slope) on a 122-pixel raster, scaled with its width."""
    parts = []
    for r, c, h, k in ((30, 30, 500, 1), (80, 90, 350, 1), (95, 25, 250, 1), (60, 60, 180, 2)):
        dr, dc = f"(p_row - {idiv(f'{r} * w', 122)})", f"(p_col - {idiv(f'{c} * w', 122)})"
        parts.append(f"greatest(0, {h} - {k} * ({dr} * {dr} + {dc} * {dc}))")
    return " + ".join(parts)


# name -> (tables and fixtures it reads, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "dims": (("orders",), "select cast(ceil(sqrt(count(*))) as bigint) as w from {orders}"),
    "sites": (("supplier",), f"select cast(s_suppkey as bigint) as site_id, s_name as name, {site_point('s_suppkey')} from {{supplier}}"),
    "many_sites": (("customer",), f"select cast(c_custkey as bigint) as site_id, c_name as name, {site_point('c_custkey')} from {{customer}}"),
    "signal": (("lineitem",), f"""
        select cast(l_suppkey as bigint) as site_id, cast(l_orderkey % 64 as int) as row, cast(l_partkey % 64 as int) as col,
               max(-({d(70.0)} + l_quantity + 5 * l_linenumber)) as rssi
        from {{lineitem}} group by 1, 2, 3"""),
    "ref_signal": (("lineitem",), f"""
        select cast(l_suppkey as bigint) as site_id, cast(l_orderkey % 64 as int) as row, cast(l_partkey % 64 as int) as col,
               max(-({d(75.0)} + l_quantity + 4 * l_linenumber)) as rssi
        from {{lineitem}} where l_suppkey % 17 <> 5 and l_orderkey % 11 <> 3 group by 1, 2, 3"""),
    "layers": (("lineitem",), f"""
        select cast(l_linenumber as bigint) as site_id, cast(l_orderkey % 64 as int) as row, cast(l_partkey % 64 as int) as col,
               max(-({d(70.0)} + l_quantity + 5 * l_linenumber)) as rssi
        from {{lineitem}} group by 1, 2, 3"""),
    "matrix": (("signal",), f"select distinct site_id, {idiv('row', 4)} * 16 + {idiv('col', 4)} as cell_id from signal where rssi >= -85"),
    "pixels": (("orders", "dims"), f"""
        select key, {idiv('key', 'w')} as p_row, key % w as p_col, w
        from (select o_orderkey as key, (select w from dims) as w from {{orders}}) o"""),
    "dem": (("pixels",), f"""
        select cast(p_row as int) as row, cast(p_col as int) as col,
               case when key % 997 = 0 then null else cast(100 + {_cones()} as float) end as elev from pixels"""),
    "rough": (("pixels",), f"""
        select cast(p_row as int) as row, cast(p_col as int) as col,
               case when key % 997 = 0 then null else cast(100 + {_cones()} + (p_row * 7919 + p_col * 104729) % 61 as float) end as elev
        from pixels"""),
    "poi": (("customer",), """
        select cast(c_custkey as bigint) as poi_id, c_mktsegment as priority, cast((c_custkey * 37) % 64 as int) as row,
               cast((c_custkey * 91) % 64 as int) as col from {customer}"""),
    "zone_corners": (("region",), " union all ".join(
        f"select cast(r_regionkey as bigint) as zone_id, {i} as i, cast({4 + dx} + r_regionkey * 9 as double) as x, "
        f"cast({3 + dy} + r_regionkey * 8 as double) as y from {{region}}" for i, (dx, dy) in enumerate(((0, 0), (21, 2), (18, 19), (2, 14)))
    )),
    "zone_deg": (("zone_corners",), f"select zone_id, i, {d(-82.9)} + x * {d(0.01)} as x, {d(35.3)} + y * {d(0.01)} as y from zone_corners"),
    "signal_zone": (("zone_corners",), f"select zone_id, i, {d(-82.9)} + (x - 3) * {d(0.00031)} as x, {d(35.8)} - (y - 2) * {d(0.00029)} as y from zone_corners"),
    "raster_size": (("supplier",), "select cast(s_suppkey as bigint) as site_id, cast(64 as bigint) as width, cast(64 as bigint) as height from {supplier}"),
    "ref_raster_size": (("supplier",), """
        select cast(s_suppkey as bigint) as site_id, cast(case when s_suppkey % 13 = 4 then 32 when s_suppkey % 13 = 7 then 128 else 64 end as bigint) as width,
               cast(case when s_suppkey % 13 = 7 then 32 else 64 end as bigint) as height
        from {supplier} where s_suppkey % 17 <> 5"""),
    "boxes": (("sites",), """
        select site_id % 4 as box_id, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north from sites group by 1"""),
    "links": (("pairs",), f"""
        select src, dst, distance_km, (src + dst) % 3 <> 0 as los_clear,
               case when (src + dst) % 4 = 0 then null else cast((src * 7 + dst * 3) % 19 as double) end as margin_db from pairs"""),
}


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"{d(12742.0)} * asin(sqrt(least({d(1.0)}, greatest({d(0.0)}, {a}))))"


SQL["pairs"] = (("sites",), f"""
    select src, dst, floor(km * 1e6 + 0.5) / 1e6 as distance_km from (
      select a.site_id as src, b.site_id as dst, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km
      from sites a join sites b on a.site_id < b.site_id) p where km <= 15 and km >= 0.001""")


def ctes(names: tuple[str, ...]) -> list[str]:
    """Fixture names in the order their CTEs have to appear."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in SQL and name not in out:
            for dep in SQL[name][0]:
                visit(dep)
            out.append(name)

    for n in names:
        visit(n)
    return out


def duck(body: str, *names: str) -> str:
    """``body`` with the fixtures it names as leading CTEs; further CTEs may start with ``with``."""
    parts = [f"{n} as materialized ({SQL[n][1].format_map(_Same())})" for n in ctes(names)]
    body = body.strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        head, rest = "", body[len("with recursive" if recursive else "with"):]
        return "with recursive " + ", ".join([*parts, rest.strip()]) if parts else body
    return "with " + ", ".join(parts) + " " + body if parts else body


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    class Paths(dict):
        def __missing__(self, key: str) -> str:
            return f"parquet.`{sf}/{key}.parquet`"

    if name == "pairs" or name == "links":
        return _links(spark, sf, name)
    parts = [f"{n} as ({SQL[n][1].format_map(Paths())})" for n in ctes((name,))]
    return spark.sql("with " + ", ".join(parts) + f" select * from {name}")


def links_within(spark: SparkSession, sf: str, km: float) -> DataFrame:
    """The links that are no longer than ``km``."""
    return _links(spark, sf, "links", km)


def _links(spark: SparkSession, sf: str, name: str, km: float = 15.0) -> DataFrame:
    """Pairs come from the bucketed range join, so the link table scales like the operators that use it.

    With ``km`` only the pairs whose rounded distance is no longer are made.
    """
    from pyspark.sql import functions as F
    from ridgecast.functions.geo import round_half_up
    from ridgecast.operators.spatial import site_pairs

    pairs = site_pairs(fixture(spark, sf, "sites"), min(15.0, km + 1e-6), carry=()).select(
        "src", "dst", round_half_up("distance_km", 6).alias("distance_km")
    )
    if km < 15.0:
        pairs = pairs.filter(F.col("distance_km") <= km)
    if name == "pairs":
        return pairs
    total = F.col("src") + F.col("dst")
    return pairs.select(
        "src", "dst", "distance_km", (total % 3 != 0).alias("los_clear"),
        F.when(total % 4 != 0, ((F.col("src") * 7 + F.col("dst") * 3) % 19).cast("double")).alias("margin_db"),
    )


@lru_cache(maxsize=None)
def _width(sf: str, orders: int) -> int:
    return math.ceil(math.sqrt(orders))


def dem_width(spark: SparkSession, sf: str) -> int:
    return _width(sf, table(spark, sf, "orders").count())


def fine_grid(spark: SparkSession, sf: str) -> Grid:
    w = dem_width(spark, sf)
    return Grid(0.0003, -82.90, -0.0003, 35.80, w, w)


def region_grid(spark: SparkSession, sf: str) -> Grid:
    """The same pixels spread over the area of the sites."""
    w = dem_width(spark, sf)
    return Grid(0.61 / w, -82.90, -0.51 / w, 35.805, w, w)


def zones(spark: SparkSession, sf: str, name: str = "zone_corners") -> DataFrame:
    from pyspark.sql import functions as F

    corner = F.struct("i", F.col("x").alias("lon"), F.col("y").alias("lat"))
    ring = F.transform(F.sort_array(F.collect_list(corner)), lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat")))
    return fixture(spark, sf, name).groupBy("zone_id").agg(ring.alias("polygon"))


# --- text and map fixtures, one builder per engine -----------------------------


def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Five CSV files cut from ``part``; some latitudes are text or out of range, names repeat."""
    from pyspark.sql import functions as F

    k = F.col("p_partkey")
    lat = F.when(k % 17 == 0, F.lit("north")).when(k % 19 == 0, F.lit("95.5")).when(
        k % 23 == 0, F.concat(F.format_string("%.4f", 35.3 + (k * 7919 % 1009) * 0.0005), F.lit("abc"))
    ).otherwise(F.format_string("%.4f", 35.3 + (k * 7919 % 1009) * 0.0005))
    lon = F.format_string("%.4f", -82.9 + (k * 104729 % 1013) * 0.0006)
    size = F.when(k % 13 == 0, F.lit("0")).otherwise(F.col("p_size").cast("string"))
    body = table(spark, sf, "part").select(
        F.concat(F.lit("part-"), (k % 5).cast("string")).alias("file"), (F.floor(k / 5) + 1).alias("line_no"),
        F.concat_ws(",", "p_name", lat, lon, size, "p_type").alias("value"),
    )
    header = body.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"),
                                                  F.lit("Name,Latitude,LNG,elevation_m,description").alias("value"))
    return header.union(body)


CSV_ORACLE = """
part_sites as (
  select 'part-' || (p_partkey % 5) as file, p_partkey // 5 + 1 as line_no, p_name as raw_name,
         round(35.3 + (p_partkey * 7919 % 1009) * 0.0005, 4)::DOUBLE as lat,
         round(-82.9 + (p_partkey * 104729 % 1013) * 0.0006, 4)::DOUBLE as lon,
         case when p_partkey % 13 = 0 then null else p_size::DOUBLE end as elevation_m, p_type as notes
  from part where p_partkey % 17 <> 0 and p_partkey % 19 <> 0),
csv_sites as (
  select file, line_no, case when row_number() over (partition by file, raw_name order by line_no) > 1
         then raw_name || ' (' || line_no || ')' else raw_name end as name, lat, lon, elevation_m, notes from part_sites)
"""


def map_elements(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    k = F.col("event_id")
    number = F.get_json_object("props", "$.k").cast("int")
    point = {"lat": F.lit(35.30) + (k * 7919 % 1009) * 0.0005, "lon": F.lit(-82.90) + (k * 104729 % 1013) * 0.0006}
    kind = F.when(k % 10 <= 6, "node").when(k % 10 <= 8, "way").otherwise("relation")
    pair = {
        "error": ("amenity", "fire_station"), "click": ("amenity", "school"), "view": ("amenity", "hospital"),
        "signup": ("man_made", "tower"), "purchase": ("man_made", "water_tower"),
    }
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for event, (tk, tv) in pair.items():
        key = F.when(F.col("event_type") == event, tk).otherwise(key)
        value = F.when(F.col("event_type") == event, tv).otherwise(value)
    base = F.create_map(key, value)
    named = F.when(number % 3 == 0, F.map_concat(base, F.create_map(F.lit("name"), F.concat(F.lit("Place "), number.cast("string")))))
    tower = F.when(k % 7 == 0, F.create_map(F.lit("tower:type"), F.lit("cell_site")))
    none = F.create_map().cast("map<string,string>")
    return table(spark, sf, "events").select(
        k.alias("element_pos"), k.alias("id"), kind.alias("type"),
        F.when(kind == "node", point["lat"]).alias("lat"), F.when(kind == "node", point["lon"]).alias("lon"),
        F.when((kind == "way") & (k % 20 != 7), F.struct(point["lat"].alias("lat"), point["lon"].alias("lon"))).alias("center"),
        F.map_concat(F.coalesce(named, base), F.coalesce(tower, none)).alias("tags"),
    )


MAP_ORACLE = """
elements as (
  select event_id as element_pos, event_id as id,
         case when event_id % 10 <= 6 then 'node' when event_id % 10 <= 8 then 'way' else 'relation' end as type,
         35.30::DOUBLE + (event_id * 7919 % 1009) * 0.0005::DOUBLE as lat, -82.90::DOUBLE + (event_id * 104729 % 1013) * 0.0006::DOUBLE as lon,
         (event_id % 10 in (7, 8) and event_id % 20 = 7) as lost,
         case when event_type in ('error', 'click', 'view') then 'amenity' else 'man_made' end as tag_key,
         case event_type when 'error' then 'fire_station' when 'click' then 'school' when 'view' then 'hospital'
              when 'signup' then 'tower' when 'purchase' then 'water_tower' end as tag_value,
         case when (props->>'$.k')::INT % 3 = 0 then 'Place ' || (props->>'$.k') end as given,
         event_id % 7 = 0 as tower_type
  from events),
labelled as (
  select *, case when tag_key = 'man_made' and tower_type then 'Cell Site ' else '' end ||
         case tag_value when 'fire_station' then 'Fire Station' when 'school' then 'School' when 'hospital' then 'Hospital'
              when 'tower' then 'Tower' when 'water_tower' then 'Water Tower' end as label
  from elements where type <> 'relation' and not lost)
"""


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON documents, one per customer group of up to 64: (file, document)."""
    from pyspark.sql import functions as F

    k = F.col("site_id")
    name = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"name":"Spot '), (k % 40).cast("string"), F.lit('",')))
    height = F.when(k % 3 == 0, F.lit('"elevation_m":null,')).when(k % 3 == 1, F.concat(F.lit('"elevation_m":'), (k % 900).cast("string"), F.lit(","))).otherwise("")
    kind = F.when(k % 11 == 0, "LineString").otherwise("Point")
    lat = F.when(k % 13 == 0, F.lit("95.25")).otherwise(F.format_string("%.4f", F.col("lat")))
    text = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":['),
        F.format_string("%.4f", F.col("lon")), F.lit(","), lat, F.lit(']},"properties":{'), name, height,
        F.lit('"owner":"'), (k % 4).cast("string"), F.lit('"}}'),
    )
    rows = fixture(spark, sf, "many_sites").select(F.floor(k / 64).alias("doc"), (k % 64).alias("n"), text.alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda s: s["t"]), ",")
    return rows.groupBy("doc").agg(joined.alias("t")).select(
        F.concat(F.lit("doc-"), F.col("doc").cast("string")).alias("file"),
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "t", F.lit("]}")).alias("document"),
    )
