"""Signal rasters: combination, thresholds, matrix, selection, validation, reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, r6, rnd
from ridgecast import plans, sinks
from ridgecast.functions.radio import DEFAULT_PARAMS
from ridgecast.operators import agreement as ag
from ridgecast.operators import coverage as cov
from ridgecast.operators import selection as sel
from ridgecast.operators.raster import pixel_frame, reproject_rows
from ridgecast.operators.spatial import points_in_zones
from ridgecast.sources.rasters import finite_signal

G = fx.SIGNAL_GRID
T_MATRIX = -85.0
N_CELLS = 256
TOTAL = 64 * 64


def sig(spark, sf, name="signal"):
    return fx.fixture(spark, sf, name)


for _method, _fn in (("best", "max"), ("mean", "avg"), ("worst", "min")):

    @query(f"agg1_combine_{_method}", f"select row::BIGINT as row, col::BIGINT as col, {rnd(f'{_fn}(rssi)')} as rssi from signal group by 1, 2", ("signal",))
    def _combine(spark, sf, method=_method):
        return cov.combine(sig(spark, sf), method).withColumns(r6("rssi"))


@query("agg2_covered_by_any", "select row::BIGINT as row, col::BIGINT as col, max(rssi) >= -88 as covered from layers group by 1, 2", ("layers",))
def _any(spark, sf):
    return cov.combine_at_threshold(sig(spark, sf, "layers"), -88.0, "any")


@query("agg2_covered_by_all", """select row::BIGINT as row, col::BIGINT as col,
  count(*) filter (rssi >= -140) = (select count(distinct l_linenumber) from lineitem) as covered from layers group by 1, 2""", ("layers",))
def _all(spark, sf):
    layers = sig(spark, sf, "layers")
    n = fx.table(spark, sf, "lineitem").select("l_linenumber").distinct().count()
    return cov.combine_at_threshold(layers, -140.0, "all", n)


@query("agg3_coverage_matrix", "select site_id, cell_id from matrix", ("matrix",))
def _matrix(spark, sf):
    return cov.coverage_matrix(sig(spark, sf), G, T_MATRIX)


def matrix(spark, sf, threshold=T_MATRIX):
    return cov.coverage_matrix(sig(spark, sf), G, threshold)


def mask(spark, sf, threshold=-78.0):
    best = cov.combine(sig(spark, sf), "best")
    return best.select("row", "col", (F.col("rssi") >= threshold).alias("covered"))


MASK = "mask as materialized (select row, col, max(rssi) >= -78 as covered from signal group by 1, 2)"


@query("agg4_downsample_mask", f"with {MASK} select (row // 4)::BIGINT as out_row, (col // 4)::BIGINT as out_col, bool_or(covered) as covered from mask group by 1, 2", ("signal",))
def _down(spark, sf):
    return cov.downsample_mask(mask(spark, sf), 4)


@query("agg5_covered_fraction", f"""with {MASK} select count(*) filter (covered) as covered_cells, 4096::BIGINT as total_cells,
  count(*) filter (covered) / 4096.0::DOUBLE as covered_fraction from mask""", ("signal",))
def _fraction(spark, sf):
    return cov.covered_fraction(mask(spark, sf), total=TOTAL)


CROSSINGS = """edges as materialized (
  select a.zone_id, a.x as xi, a.y as yi, b.x as xj, b.y as yj from {corners} a join {corners} b
  on a.zone_id = b.zone_id and b.i = (a.i + 3) % 4)"""


def inside_sql(points: str, x: str, y: str, columns: str) -> str:
    return f"""(select {columns}, e.zone_id from {points} p join edges e
      on (e.yi > p.{y}) <> (e.yj > p.{y}) and p.{x} < (e.xj - e.xi) * (p.{y} - e.yi) / (e.yj - e.yi) + e.xi
      group by {columns}, e.zone_id having count(*) % 2 = 1)"""


def zone_cells(spark, sf):
    frame = pixel_frame(spark, G).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    return points_in_zones(frame, fx.zones(spark, sf), "x", "y").select("zone_id", "row", "col")


ZONE_CELLS = (
    "grid as materialized (select (i // 64)::DOUBLE as y, (i % 64)::DOUBLE as x from range(4096) t(i)), "
    + CROSSINGS.format(corners="zone_corners")
    + f", zone_cells as materialized (select zone_id, y::BIGINT as row, x::BIGINT as col from {inside_sql('grid', 'x', 'y', 'p.x, p.y')} z)"
)


@query("agg5_zone_fraction", f"""with {MASK}, {ZONE_CELLS}
  select zone_id, count(*) filter (coalesce(covered, false)) as covered_cells, count(*) as total_cells,
         count(*) filter (coalesce(covered, false)) / count(*)::DOUBLE as covered_fraction
  from zone_cells left join mask using (row, col) group by 1""", ("signal", "zone_corners"))
def _zone_fraction(spark, sf):
    return cov.covered_fraction(mask(spark, sf), cells=zone_cells(spark, sf), keys=("zone_id",))


@query("agg6_cover_counts", "select cell_id, count(*) as n_sites from matrix group by 1", ("matrix",))
def _cover_counts(spark, sf):
    return cov.cover_counts(matrix(spark, sf))


@query("agg6_redundancy", """with c as (select cell_id, count(*) as n from matrix group by 1)
  select level, count(*) as cells, count(*) / 256.0::DOUBLE as fraction from c join range(1, 5) l(level) on n >= level group by 1""", ("matrix",))
def _redundancy(spark, sf):
    return cov.redundancy(matrix(spark, sf), N_CELLS, 4)


@query("agg11_raster_stats", f"""select site_id, min(rssi) as min_value, max(rssi) as max_value, {rnd('avg(rssi)')} as mean_value,
  count(*) as n_values from signal group by 1""", ("signal",))
def _stats(spark, sf):
    return cov.raster_stats(sig(spark, sf), "rssi", ("site_id",)).withColumns(r6("mean_value"))


@query("flt4_signal_at_threshold", "select site_id, row::BIGINT as row, col::BIGINT as col, rssi from signal where rssi >= -120", ("signal",))
def _threshold(spark, sf):
    return cov.at_threshold(sig(spark, sf), -120.0)


@query("prj8_value_buckets", """select case when rssi >= -130 then floor(greatest(0, least(1, (rssi + 130) / 60)) * 255 + 0.5)::BIGINT end as bucket,
  count(*) as n from signal group by 1""", ("signal",))
def _buckets(spark, sf):
    bucket = cov.value_bucket("rssi", -130.0, -70.0, -130.0)
    return sig(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("jn6_reproject_rows", f"""with best as materialized (select row, col, max(rssi) as rssi from signal group by 1, 2),
  ends as (select ln(tan(pi() / 4 + radians(35.80) / 2)) as yn, ln(tan(pi() / 4 + radians(35.80 - 64 * 0.0003) / 2)) as ys),
  rows as (select r as out_row, greatest(0, least(63, floor((35.80 - degrees(2 * atan(exp(yn + (r + 0.5) / 64 * (ys - yn))) - pi() / 2)) / 0.0003)))::BIGINT as src_row
           from range(64) t(r) cross join ends)
  select out_row, col::BIGINT as col, rssi from best join rows on row = src_row""", ("signal",))
def _reproject(spark, sf):
    return reproject_rows(cov.combine(sig(spark, sf), "best"), G, "rssi").select("out_row", "col", "rssi")


@query("snk7_masked_raster", "select site_id, row::BIGINT as row, col::BIGINT as col, case when rssi >= -120 then rssi else -9999 end as rssi from signal", ("signal",))
def _masked(spark, sf):
    return cov.masked_export(sig(spark, sf), -120.0)


@query("src6_finite_signal", "select site_id, row::BIGINT as row, col::BIGINT as col, rssi from signal where (row + col) % 7 > 1", ("signal",))
def _finite(spark, sf):
    k = (F.col("row") + F.col("col")) % 7
    dirty = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("rssi"))
    return finite_signal(sig(spark, sf).withColumn("rssi", dirty))


# --- points of interest --------------------------------------------------------


@query("jn9_poi_coverage", """with heard as materialized (select * from signal where rssi >= -90)
  select poi_id, priority, p.row::BIGINT as row, p.col::BIGINT as col, count(site_id) as n_sites, count(site_id) > 0 as covered,
         (array_agg(site_id order by rssi desc, site_id))[1] as best_site
  from poi p left join heard h on p.row = h.row and p.col = h.col group by 1, 2, 3, 4""", ("signal", "poi"))
def _poi(spark, sf):
    return cov.point_coverage(fx.fixture(spark, sf, "poi"), sig(spark, sf), -90.0)


@query("jn9_uncovered_poi", """select poi_id, priority, row::BIGINT as row, col::BIGINT as col from poi p
  where not exists (select 1 from signal s where s.row = p.row and s.col = p.col and rssi >= -82)""", ("signal", "poi"))
def _uncovered(spark, sf):
    return cov.uncovered_points(fx.fixture(spark, sf, "poi"), sig(spark, sf), -82.0).orderBy("priority", "poi_id")


# --- selection -----------------------------------------------------------------


def greedy_sql(rounds: int, stop: str, score: str = "gain", name: str = "matrix", flags: bool = False) -> str:
    """Greedy rounds unrolled into CTEs: picks up to round k are in ``p{k}``."""
    parts = ["p0 as (select 0::BIGINT as rank, -1::BIGINT as site_id, 0::BIGINT as gain, 0::BIGINT as covered_after)"]
    for k in range(1, rounds + 1):
        linked = ("coalesce((select 1 from links l where l.los_clear and ((l.src = m.site_id and l.dst in (select site_id from p{0})) "
                  "or (l.dst = m.site_id and l.src in (select site_id from p{0}))) limit 1), 0)").format(k - 1) if flags else "0"
        parts.append(f"""c{k} as materialized (select distinct cell_id from {name} where site_id in (select site_id from p{k - 1}))""")
        parts.append(f"""g{k} as materialized (select m.site_id, count(*) as gain, {linked} as linked from {name} m
          where cell_id not in (select cell_id from c{k}) and site_id not in (select site_id from p{k - 1})
            and (select max(covered_after) from p{k - 1}) {stop} and (select max(rank) from p{k - 1}) = {k - 1} group by 1)""")
        parts.append(f"""p{k} as materialized (select * from p{k - 1} union all select * from (select {k}::BIGINT, site_id, gain,
          gain + (select max(covered_after) from p{k - 1}) from g{k} order by {score.format(n=k - 1)} desc, site_id limit 1))""")
    return ", ".join(parts)


@query("itr1_greedy_min_sites", f"with {greedy_sql(16, '< ceil(0.8 * 256)')} select * from p16 where rank > 0", ("matrix",))
def _greedy_min(spark, sf):
    return sel.select_min_sites(matrix(spark, sf), N_CELLS, 0.8)


@query("itr2_greedy_max_coverage", f"with {greedy_sql(8, '< 999999')} select * from p8 where rank > 0", ("matrix",))
def _greedy_max(spark, sf):
    return sel.select_max_coverage(matrix(spark, sf), 8)


@query("itr3_mesh_greedy", f"with {greedy_sql(16, '< ceil(0.8 * 256)', 'gain + 2.5 * {n} * linked', flags=True)} select * from p16 where rank > 0", ("matrix", "links"))
def _mesh_greedy(spark, sf):
    return sel.select_mesh_sites(matrix(spark, sf), N_CELLS, 0.8, fx.fixture(spark, sf, "links"), 2.5)


def min_sites(spark, sf):
    return sel.select_min_sites(matrix(spark, sf), N_CELLS, 0.8)


PICKS = greedy_sql(16, "< ceil(0.8 * 256)") + ", picks as materialized (select * from p16 where rank > 0)"


@query("jn8_selected_sites", f"with {PICKS} select rank, p.site_id, name, lat, lon from picks p join sites using (site_id)", ("matrix", "sites"))
def _selected(spark, sf):
    return min_sites(spark, sf).join(fx.fixture(spark, sf, "sites"), "site_id", "left").select("rank", "site_id", "name", "lat", "lon")


@query("jn11_coverage_gaps", f"""with {PICKS}, {ZONE_CELLS},
  cells as (select distinct (row // 4) * 16 + col // 4 as cell_id from zone_cells)
  select cell_id from cells where cell_id not in (select cell_id from matrix where site_id in (select site_id from picks))""", ("matrix", "zone_corners"))
def _gaps(spark, sf):
    cells = zone_cells(spark, sf).select(cov.cell_id(G, 4).alias("cell_id")).distinct()
    return cov.coverage_gaps(cells, matrix(spark, sf), min_sites(spark, sf))


@query("set3_unselected", f"with {PICKS} select site_id, name from sites where site_id not in (select site_id from picks)", ("matrix", "sites"))
def _unselected(spark, sf):
    return fx.fixture(spark, sf, "sites").join(min_sites(spark, sf), "site_id", "left_anti").select("site_id", "name")


def scenario_rows(rounds: int, targets: list[tuple[int, str, float]], p: str) -> str:
    rows = []
    for pos, name, target in targets:
        need = math.ceil(target * N_CELLS)
        rows.append(f"""select {pos}::BIGINT as pos, '{name}' as name, count(*) as n_sites, coalesce(max(covered_after), 0) / 256.0::DOUBLE as covered_fraction,
          case when coalesce(max(covered_after), 0) >= {need} then 'Optimal' else 'Feasible' end as status
          from {p} where rank > 0 and covered_after - gain < {need}""")
    return " union all ".join(rows)


SCEN_TARGETS = [(0, "optimistic", 0.95), (1, "nominal", 0.8), (2, "pessimistic", 0.5)]


def scenarios(spark):
    """Three targets; a second row named ``nominal`` is there to be dropped."""
    rows = [(0, "optimistic", -90.0, 0.95), (1, "nominal", -85.0, 0.8), (2, "pessimistic", -80.0, 0.5), (3, "nominal", -70.0, 0.1)]
    return spark.createDataFrame(rows, sel.SCENARIO_SCHEMA)


@query("itr7_sensitivity", f"with {greedy_sql(22, '< ceil(0.95 * 256)')} {scenario_rows(22, SCEN_TARGETS, 'p22')}", ("matrix",))
def _sensitivity(spark, sf):
    return sel.sensitivity_min_sites(scenarios(spark), N_CELLS, matrix=matrix(spark, sf))


@query("itr7_sensitivity_max_coverage", f"""with {greedy_sql(6, '< 999999')},
  s as (select count(*) as n_sites, max(covered_after) / 256.0::DOUBLE as covered_fraction from p6 where rank > 0)
  select pos, name, n_sites, covered_fraction, 'Optimal' as status from (values (0::BIGINT, 'optimistic'), (1::BIGINT, 'nominal'), (2::BIGINT, 'pessimistic')) v(pos, name) cross join s""", ("matrix",))
def _sensitivity_max(spark, sf):
    return sel.sensitivity_max_coverage(scenarios(spark), N_CELLS, 6, matrix=matrix(spark, sf))


def _rethreshold_sql() -> str:
    parts, rows = [], []
    for pos, name, target, threshold in ((0, "optimistic", 0.95, -90), (1, "nominal", 0.8, -85), (2, "pessimistic", 0.5, -80)):
        text = greedy_sql(14, f"< {math.ceil(target * N_CELLS)}", name=f"m{pos}")
        for k in range(14, -1, -1):
            for letter in "pcg":
                text = text.replace(f"{letter}{k} ", f"{letter}{k}_{pos} ").replace(f"{letter}{k})", f"{letter}{k}_{pos})")
        parts.append(f"m{pos} as materialized (select distinct site_id, (row // 4)::BIGINT * 16 + col // 4 as cell_id from signal where rssi >= {threshold})")
        parts.append(text)
        rows.append(scenario_rows(14, [(pos, name, target)], f"p14_{pos}"))
    return "with " + ", ".join(parts) + " " + " union all ".join(rows)


@query("itr7_sensitivity_rethreshold", _rethreshold_sql(), ("signal",))
def _rethreshold(spark, sf):
    return sel.sensitivity_min_sites(scenarios(spark), N_CELLS, matrix_at=lambda t: matrix(spark, sf, t))


@query("agg14_scenario_spread", f"""with {greedy_sql(22, '< ceil(0.95 * 256)')}, s as ({scenario_rows(22, SCEN_TARGETS, 'p22')})
  select min(covered_fraction) as min_fraction, max(covered_fraction) as max_fraction,
         floor((max(covered_fraction) - min(covered_fraction)) * 1e10 + 0.5) / 1e10 as spread from s""", ("matrix",))
def _spread(spark, sf):
    return sel.scenario_spread(sel.sensitivity_min_sites(scenarios(spark), N_CELLS, matrix=matrix(spark, sf)))


@query("win5_distinct_scenarios", """select c_custkey as pos, c_mktsegment as name, -120.0::DOUBLE as threshold, c_acctbal as target from
  (select *, row_number() over (partition by c_mktsegment order by c_custkey) as k from customer) where k = 1""")
def _distinct(spark, sf):
    scen = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("name"), F.lit(-120.0).alias("threshold"), F.col("c_acctbal").alias("target")
    )
    return sel.distinct_scenarios(scen)


@query("win4_first_touch", """select site_id, row, col, radial, step, rssi from (
  select l_suppkey as site_id, l_orderkey % 64 as row, l_partkey % 64 as col, l_linenumber::BIGINT as radial, l_quantity::BIGINT as step, -l_extendedprice as rssi,
         row_number() over (partition by l_suppkey, l_orderkey % 64, l_partkey % 64 order by l_linenumber, l_quantity, -l_extendedprice) as k
  from lineitem) where k = 1""")
def _first_touch(spark, sf):
    from ridgecast.operators.sweep import first_touch

    points = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site_id"), (F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"),
        F.col("l_linenumber").alias("radial"), F.col("l_quantity").cast("int").alias("step"), (-F.col("l_extendedprice")).alias("rssi"),
    )
    return first_touch(points)


@query("job12_coverage_report", f"""with {PICKS}, best as (select row, col, max(rssi) as rssi from signal group by 1, 2),
  n as (select count(*) filter (rssi >= -85) as c from best)
  select rank, site_id, gain, covered_after, covered_after / 256.0::DOUBLE as selected_fraction, c as covered_pixels, c / 4096.0::DOUBLE as covered_fraction
  from picks cross join n""", ("matrix",))
def coverage_report(spark, sf):
    return plans.coverage_report(sig(spark, sf), G, T_MATRIX, 0.8)


#: Zones of degrees that overlap in part and reach over the raster's border.
SIGNAL_ZONES = CROSSINGS.format(corners="signal_zone") + """, zone_pixels as materialized (select distinct row, col from (
  select g.i // 64 as row, g.i % 64 as col, e.zone_id, count(*) as n from range(4096) g(i) join edges e
    on (e.yi > 35.80::DOUBLE + (g.i // 64) * -0.0003::DOUBLE) <> (e.yj > 35.80::DOUBLE + (g.i // 64) * -0.0003::DOUBLE)
    and -82.90::DOUBLE + (g.i % 64) * 0.0003::DOUBLE < (e.xj - e.xi) * (35.80::DOUBLE + (g.i // 64) * -0.0003::DOUBLE - e.yi) / (e.yj - e.yi) + e.xi group by 1, 2, 3) where n % 2 = 1),
  zone_n as (select count(*) as total, count(*) filter (rssi >= -85) as c from zone_pixels left join (select row, col, max(rssi) as rssi from signal group by 1, 2) using (row, col))"""


@query("job12_zone_report", f"""with {PICKS}, {SIGNAL_ZONES}
  select rank, site_id, gain, covered_after, covered_after / 256.0::DOUBLE as selected_fraction, c as covered_pixels, total as total_pixels, c / total::DOUBLE as covered_fraction
  from picks cross join zone_n""", ("matrix", "signal_zone"))
def _zone_report(spark, sf):
    return plans.coverage_report(sig(spark, sf), G, T_MATRIX, 0.8, zones=fx.zones(spark, sf, "signal_zone"))


@query("job12_zone_target", f"""with {SIGNAL_ZONES}, zone_cells as materialized (select distinct (row // 4) * 16 + col // 4 as cell_id from zone_pixels),
  whole as (select count(*) as cells from zone_cells), near as materialized (select * from matrix where cell_id in (select cell_id from zone_cells)),
  {greedy_sql(16, '< ceil(0.8 * (select cells from whole))', name='near')}, picks as (select * from p16 where rank > 0)
  select rank, site_id, gain, covered_after, covered_after / cells::DOUBLE as selected_fraction, c as covered_pixels, total as total_pixels, c / total::DOUBLE as covered_fraction
  from picks cross join zone_n cross join whole""", ("matrix", "signal_zone"))
def _zone_target(spark, sf):
    return plans.coverage_report(sig(spark, sf), G, T_MATRIX, 0.8, zones=fx.zones(spark, sf, "signal_zone"), zone_target=True)


# --- sinks over coverage and selection -------------------------------------------


CELLS = f"""{MASK}, cells as materialized (select (row // 4)::BIGINT as out_row, (col // 4)::BIGINT as out_col from mask where covered group by 1, 2),
  boxes as materialized (select out_row, out_col, 0.0003::DOUBLE * (out_col * 4) + -82.90::DOUBLE as west, 0.0003::DOUBLE * (out_col * 4 + 4) + -82.90::DOUBLE as east,
    -0.0003::DOUBLE * (out_row * 4) + 35.80::DOUBLE as north, -0.0003::DOUBLE * (out_row * 4 + 4) + 35.80::DOUBLE as south from cells)"""


def ring_sql(sep: str, left: str, right: str, join: str) -> str:
    points = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    return f" || '{join}' || ".join(f"'{left}' || {x}::VARCHAR || '{sep}' || {y}::VARCHAR || '{right}'" for x, y in points)


POLYGON = f"""'{{"type":"Feature","properties":{{}},"geometry":{{"type":"Polygon","coordinates":[[' || {ring_sql(',', '[', ']', ',')} || ']]}}}}'"""


@query("snk3_coverage_polygons", f"with {CELLS} select out_row, out_col, {POLYGON} as feature from boxes", ("signal",))
def _polygons(spark, sf):
    return sinks.coverage_features(sinks.coverage_cells(mask(spark, sf), G))


@query("snk5_coverage_placemarks", f"""with {CELLS} select row_number() over (order by out_row, out_col) as number,
  '<Placemark><name>Coverage Area ' || row_number() over (order by out_row, out_col) || '</name><styleUrl>#coverageStyle</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>'
  || {ring_sql(',', '', ',0', ' ')} || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' as placemark from boxes""", ("signal",))
def _placemarks(spark, sf):
    return sinks.coverage_placemarks(sinks.coverage_cells(mask(spark, sf), G))


@query("snk4_result_table", f"""with {PICKS}, {MASK}, n as (select count(*) filter (covered) as c from mask)
  select 0::BIGINT as pos, '"all",' || format('{{:.4f}}', c / 4096.0) || ',' || c || ',4096,12.50,-78' as line from n
  union all select rank, '"' || name || '",,,,12.50,-78' from picks join sites using (site_id)""", ("signal", "matrix", "sites"))
def _results(spark, sf):
    chosen = min_sites(spark, sf).join(fx.fixture(spark, sf, "sites"), "site_id").select("rank", "name")
    return sinks.result_table(chosen, cov.covered_fraction(mask(spark, sf), total=TOTAL), 12.5, -78.0)


@query("snk6_summary_table", f"""with {PICKS}, {MASK}, n as (select count(*) filter (covered) as c from mask),
  s as (select count(*) as k, max(covered_after) as v from picks)
  select * from (values ('Parameters', 'Frequency', '907 MHz'), ('Parameters', 'Spreading Factor', 'SF10'), ('Parameters', 'TX Power', '22 dBm'),
    ('Parameters', 'TX Height', '1 m'), ('Parameters', 'RX Height', '1.5 m'), ('Parameters', 'Bandwidth', '125 kHz'), ('Parameters', 'Required Margin', '10 dB'),
    ('Parameters', 'RX Sensitivity', '-130 dBm'), ('ITM Propagation', 'Climate', '5'), ('ITM Propagation', 'Polarization', '1'),
    ('ITM Propagation', 'Ground Permittivity', '15'), ('ITM Propagation', 'Ground Conductivity', '0.005 S/m'), ('ITM Propagation', 'Surface Refractivity', '314 N-units'),
    ('Results', 'Total Cells', '4,096')) v(section, key, value)
  union all select 'Results', 'Coverage', format('{{:.1f}}', c / 4096.0 * 100) || '%' from n
  union all select 'Results', 'Covered Cells', format('{{:,}}', c) from n
  union all select 'Results', 'Sites Evaluated', (select count(*) from sites)::VARCHAR
  union all select 'Optimisation', 'Selected Sites', k || ' sites' from s
  union all select 'Optimisation', 'Covered Fraction', format('{{:.1f}}', v / 256.0 * 100) || '%' from s
  union all select 'Optimisation', 'Solver Status', case when v >= 205 then 'Optimal' else 'Feasible' end from s
  union all select 'Optimisation', 'Solver Source', 'greedy'""", ("signal", "matrix", "sites"))
def _summary(spark, sf):
    n = fx.fixture(spark, sf, "sites").count()
    covered = cov.covered_fraction(mask(spark, sf), total=TOTAL).withColumn("n_sites", F.lit(n))
    return sinks.summary_table(DEFAULT_PARAMS, covered, sel.selection_summary(min_sites(spark, sf), N_CELLS, 0.8))


@query("snk6_selected_lines", f"""with {PICKS} select rank, case when p.site_id % 3 = 0 then name
  else name || ': ' || lat || ', ' || lon || case when p.site_id % 2 = 0 then ', ' || (p.site_id * 10) || ' m' else '' end end as line
  from picks p join sites using (site_id)""", ("matrix", "sites"))
def _selected_lines(spark, sf):
    sites = fx.fixture(spark, sf, "sites")
    chosen = min_sites(spark, sf).join(sites.select("site_id", "name"), "site_id").select("rank", "name")
    known = sites.filter("site_id % 3 <> 0").withColumn("elevation_m", F.when(F.col("site_id") % 2 == 0, F.col("site_id") * 10.0))
    return sinks.selected_site_lines(chosen, known)


# --- validation ------------------------------------------------------------------


METRICS_SQL = """pairs_v as materialized (select s.site_id, s.rssi >= -120 as p, r.rssi >= -120 as r from signal s join ref_signal r using (site_id, row, col)),
  counts as materialized (select site_id, count(*) filter (p and r) as tp, count(*) filter (not p and not r) as tn,
    count(*) filter (p and not r) as fp, count(*) filter (not p and r) as fn from pairs_v group by 1),
  ratios as (select *, tp + tn + fp + fn as total_pixels, (tp + tn) / (tp + tn + fp + fn)::DOUBLE as accuracy,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) as recall,
    coalesce(tp / nullif(tp + fp + fn, 0)::DOUBLE, 0) as jaccard from counts),
  metrics as materialized (select site_id, tp, tn, fp, fn, total_pixels, """ + ", ".join(
    f"{rnd(e, 4)} as {n}" for n, e in (
        ("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("jaccard", "jaccard"),
        ("f1_score", "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"))
) + """, -120.0::DOUBLE as threshold_dbm from ratios),
  sound as materialized (select s.site_id, s.name, case when z.site_id is null then 'Reference raster not found'
    when r.width * r.height <> z.width * z.height then 'Shape mismatch: predicted length ' || (r.width * r.height) || ' vs reference length ' || (z.width * z.height)
    when r.width <> z.width then 'Shape mismatch: predicted ' || r.width || ' x ' || r.height || ' vs reference ' || z.width || ' x ' || z.height end as wrong
    from sites s left join raster_size r using (site_id) left join ref_raster_size z using (site_id)),
  rated as materialized (select s.site_id, s.name, m.* exclude (site_id), case when jaccard >= 0.9 then 'excellent' when jaccard >= 0.8 then 'good' when jaccard >= 0.7 then 'acceptable'
    when jaccard is not null then 'poor' end as rating, jaccard >= 0.7 as passed,
    coalesce(wrong, case when jaccard is null then 'No valid (finite) pixels to compare' end) as error
    from sound s left join metrics m on s.site_id = m.site_id and wrong is null)"""

VALIDATION = ("signal", "ref_signal", "sites", "raster_size", "ref_raster_size")


@query("jn7_aligned_pixels", """select site_id, row::BIGINT as row, col::BIGINT as col, s.rssi as predicted, r.rssi as reference
  from signal s join ref_signal r using (site_id, row, col)""", ("signal", "ref_signal"))
def _align(spark, sf):
    return ag.align(sig(spark, sf), sig(spark, sf, "ref_signal"))


@query("jn7_shape_check", """select site_id, p.width as predicted_width, p.height as predicted_height, r.width as reference_width, r.height as reference_height,
  p.width = r.width and p.height = r.height as same_shape from raster_size p full join ref_raster_size r using (site_id)""", ("raster_size", "ref_raster_size"))
def _shape(spark, sf):
    return ag.shape_check(fx.fixture(spark, sf, "raster_size"), fx.fixture(spark, sf, "ref_raster_size"))


@query("agg9_agreement", f"with {METRICS_SQL} select * from metrics", ("signal", "ref_signal", "sites"))
def _agreement(spark, sf):
    return ag.agreement(ag.align(sig(spark, sf), sig(spark, sf, "ref_signal")))


def validated(spark, sf):
    sizes = (fx.fixture(spark, sf, n) for n in ("raster_size", "ref_raster_size"))
    return ag.validate_sites(fx.fixture(spark, sf, "sites"), sig(spark, sf), sig(spark, sf, "ref_signal"), *sizes)


@query("job14_validate_sites", f"with {METRICS_SQL} select * from rated", VALIDATION)
def _validate(spark, sf):
    return validated(spark, sf)


@query("agg10_pass_counts", f"""with {METRICS_SQL} select count(*) as total, count(*) filter (coalesce(passed, false)) as passed,
  count(*) filter (not coalesce(passed, false)) as failed from rated""", VALIDATION)
def _pass(spark, sf):
    return ag.pass_counts(validated(spark, sf))


@query("snk9_validation_report", f"""with {METRICS_SQL}, n as (select count(*) as total, count(*) filter (coalesce(passed, false)) as ok from rated),
  k as (select *, row_number() over (order by site_id) as i from rated)
  select 7 + i as pos, '  [' || i || '] ' || case when error is not null then name || ': ERROR - ' || error
    else name || ': ' || case when passed then 'PASS' else 'FAIL' end || ' (F1=' || format('{{:.3f}}', f1_score) || ', Jaccard=' || format('{{:.3f}}', jaccard)
    || ', Accuracy=' || format('{{:.3f}}', accuracy) || ')' end as line from k
  union all select unnest([0, 1, 2, 3, 4, 5, 6, 7]), unnest([repeat('=', 60), 'Coverage Validation Report', 'Generated: 2024-01-01T00:00:00.000Z', 'Sites validated: ' || total,
    repeat('=', 60), 'Passed: ' || ok || '/' || total, 'Failed: ' || (total - ok) || '/' || total, '']) from n""", VALIDATION)
def _report(spark, sf):
    return sinks.validation_report(validated(spark, sf), "2024-01-01T00:00:00.000Z")
