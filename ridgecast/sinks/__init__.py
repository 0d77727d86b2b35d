"""Export tables: every function gives the rows of a file, ``write_*`` stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.functions.geo import Grid, round_half_up
from ridgecast.functions.text import fixed_text, number_text, xml_escape
from ridgecast.operators.agreement import pass_counts
from ridgecast.operators.coverage import downsample_mask, masked_export
from ridgecast.operators.spatial import nearest_between
from ridgecast.session import cut_lineage


def _json_number(value: Column) -> Column:
    return F.coalesce(number_text(value), F.lit("null"))


def _json_text(value: Column) -> Column:
    """JSON string literal (or null) of a text."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(quoted)


def site_csv_rows(sites: DataFrame) -> DataFrame:
    """name, latitude, longitude, elevation_m, notes as text, empty where missing."""
    blank = F.lit("")
    return sites.select(
        "name", number_text("lat").alias("latitude"), number_text("lon").alias("longitude"),
        F.coalesce(number_text("elevation_m"), blank).alias("elevation_m"), F.coalesce("notes", blank).alias("notes"),
    )


def site_csv_lines(sites: DataFrame, quoted: bool = False) -> DataFrame:
    rows = site_csv_rows(sites)
    if quoted:
        line = F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit('"')), "latitude", "longitude", "elevation_m")
    else:
        line = F.concat_ws(",", "name", "latitude", "longitude", "elevation_m", "notes")
    return rows.select("name", line.alias("line"))


def write_site_csv(sites: DataFrame, path: str) -> None:
    """Plain comma-joined lines; each part file starts with the header."""
    site_csv_rows(sites).write.option("header", True).option("quote", "").option("emptyValue", "").csv(path, mode="overwrite")


def site_features(sites: DataFrame) -> DataFrame:
    """(name, feature): one GeoJSON Point feature per site."""
    text = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), number_text("lon"), F.lit(","), number_text("lat"),
        F.lit(']},"properties":{"name":'), _json_text(F.col("name")), F.lit(',"elevation_m":'),
        _json_number(F.col("elevation_m")), F.lit(',"notes":'), _json_text(F.col("notes")), F.lit("}}"),
    )
    return sites.select("name", text.alias("feature"))


def coverage_cells(mask: DataFrame, grid: Grid, block: int = 4) -> DataFrame:
    """(out_row, out_col, west, south, east, north) of covered cells; a cell counts when any pixel is covered."""
    cells = downsample_mask(mask, block).filter("covered")
    r, c = F.col("out_row") * block, F.col("out_col") * block
    lon0, lat0 = grid.lon_lat(c, r)
    lon1, _ = grid.lon_lat(c + block, r)
    _, lat1 = grid.lon_lat(c, r + block)
    return cells.select(
        "out_row", "out_col", F.least(lon0, lon1).alias("west"), F.least(lat0, lat1).alias("south"),
        F.greatest(lon0, lon1).alias("east"), F.greatest(lat0, lat1).alias("north"),
    )


def _ring(separator: str, opening: str, closing: str, joiner: str) -> Column:
    west, south, east, north = (number_text(k) for k in ("west", "south", "east", "north"))
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    points = [F.concat(F.lit(opening), x, F.lit(separator), y, F.lit(closing)) for x, y in corners]
    return F.concat_ws(joiner, *points)


def coverage_features(cells: DataFrame) -> DataFrame:
    """(out_row, out_col, feature): one polygon per covered cell."""
    head = '{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[['
    text = F.concat(F.lit(head), _ring(",", "[", "]", ","), F.lit("]]}}"))
    return cells.select("out_row", "out_col", text.alias("feature"))


def all_features(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """Site features followed by coverage features, as one table."""
    return site_features(sites).select("feature").unionByName(coverage_features(cells).select("feature"))


def result_table(selection: DataFrame, summary: DataFrame, seconds: float, threshold: float) -> DataFrame:
    """(pos, line): the ``all`` row, then a row per selected site.

    ``selection`` is (rank, name), ``summary`` one row (covered_fraction, covered_cells, total_cells).
    """
    took, level = f"{seconds:.2f}", f"{threshold:g}"
    total = summary.select(
        F.lit(0).cast("long").alias("pos"),
        F.concat_ws(
            ",", F.lit('"all"'), fixed_text("covered_fraction", 4), F.col("covered_cells").cast("string"),
            F.col("total_cells").cast("string"), F.lit(took), F.lit(level),
        ).alias("line"),
    )
    each = selection.select(
        F.col("rank").cast("long").alias("pos"), F.concat(F.lit('"'), "name", F.lit(f'",,,,{took},{level}')).alias("line")
    )
    return total.unionByName(each)


RESULT_HEADER = "site,covered_fraction,covered_cells,total_cells,compute_time_s,threshold_dbm"


def coverage_placemarks(cells: DataFrame) -> DataFrame:
    """(number, placemark): covered cells numbered row by row.

    Numbers are running counts over the rows of the output grid plus the position inside a row,
    so only row totals are put in one order.
    """
    totals = cells.groupBy("out_row").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("out_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = totals.select("out_row", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("out_row").orderBy("out_col"))
    numbered = cells.withColumn("_k", within).join(starts, "out_row").withColumn("number", F.col("_before") + F.col("_k"))
    text = F.concat(
        F.lit("<Placemark><name>Coverage Area "), F.col("number").cast("string"),
        F.lit("</name><styleUrl>#coverageStyle</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        _ring(",", "", ",0", " "), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    return numbered.select("number", text.alias("placemark"))


def site_placemarks(sites: DataFrame) -> DataFrame:
    """(name, placemark): one point per site, texts escaped."""
    lat, lon = number_text("lat"), number_text("lon")
    height = F.coalesce(F.concat(F.lit(" ("), number_text("elevation_m"), F.lit(" m)")), F.lit(""))
    text = F.concat(
        F.lit("<Placemark><name>"), xml_escape("name"), F.lit("</name><description>"),
        xml_escape(F.concat(lat, F.lit(", "), lon, height)), F.lit("</description><Point><coordinates>"),
        lon, F.lit(","), lat, F.lit(",0</coordinates></Point></Placemark>"),
    )
    return sites.select("name", text.alias("placemark"))


def summary_table(params: dict, coverage: DataFrame | None, selection: DataFrame | None) -> DataFrame:
    """(section, key, value): parameters, coverage results and optimisation results, N/A where missing.

    ``coverage`` is one row (covered_fraction, covered_cells, total_cells, n_sites), ``selection`` one row
    (n_sites, covered_fraction, status).
    """
    source = coverage if coverage is not None else selection
    spark = source.sparkSession
    rows = [
        ("Parameters", "Frequency", f"{params['frequency_mhz']:g} MHz"),
        ("Parameters", "Spreading Factor", f"SF{params['spreading_factor']:g}"),
        ("Parameters", "TX Power", f"{params['tx_power_dbm']:g} dBm"),
        ("Parameters", "TX Height", f"{params['tx_height_m']:g} m"),
        ("Parameters", "RX Height", f"{params['rx_height_m']:g} m"),
        ("Parameters", "Bandwidth", f"{params['bandwidth_hz'] / 1000:.0f} kHz"),
        ("Parameters", "Required Margin", f"{params['required_margin_db']:g} dB"),
        ("Parameters", "RX Sensitivity", f"{params['rx_sensitivity_dbm']:g} dBm"),
        ("ITM Propagation", "Climate", f"{params['climate']:g}"),
        ("ITM Propagation", "Polarization", f"{params['polarization']:g}"),
        ("ITM Propagation", "Ground Permittivity", f"{params['permittivity']:g}"),
        ("ITM Propagation", "Ground Conductivity", f"{params['conductivity']:g} S/m"),
        ("ITM Propagation", "Surface Refractivity", f"{params['refractivity']:g} N-units"),
    ]
    out = spark.createDataFrame(rows, "section string, key string, value string")
    percent = F.concat(fixed_text(F.col("covered_fraction") * 100, 1), F.lit("%"))
    parts = [
        ("Results", coverage, {
            "Coverage": percent, "Covered Cells": F.format_number("covered_cells", 0),
            "Total Cells": F.format_number("total_cells", 0), "Sites Evaluated": F.col("n_sites").cast("string")}),
        ("Optimisation", selection, {
            "Selected Sites": F.concat(F.col("n_sites").cast("string"), F.lit(" sites")), "Covered Fraction": percent,
            "Solver Status": F.col("status"), "Solver Source": F.lit("greedy")}),
    ]
    for section, frame, values in parts:
        if frame is None:
            missing = [(section, k, "N/A") for k in values]
            out = out.unionByName(spark.createDataFrame(missing, "section string, key string, value string"))
            continue
        pairs = ", ".join(f"'{k}', `{k}`" for k in values)
        wide = frame.select(*[v.alias(k) for k, v in values.items()])
        out = out.unionByName(wide.selectExpr(f"'{section}' as section", f"stack({len(values)}, {pairs}) as (key, value)"))
    return out


def selected_site_lines(selection: DataFrame, sites: DataFrame) -> DataFrame:
    """(rank, line): selected names with coordinates, the bare name when the site is unknown."""
    known = sites.select("name", "lat", "lon", "elevation_m")
    met = selection.select("rank", "name").join(known, "name", "left")
    height = F.coalesce(F.concat(F.lit(", "), number_text("elevation_m"), F.lit(" m")), F.lit(""))
    full = F.concat(F.col("name"), F.lit(": "), number_text("lat"), F.lit(", "), number_text("lon"), height)
    return met.select(F.col("rank").cast("long").alias("rank"), F.coalesce(full, "name").alias("line"))


def tree_features(tree: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, dst, margin_db, quality, feature): a line per tree edge; margin 10 good, 3 fair, else poor; -1 when unknown."""
    a = sites.select(F.col("site_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = sites.select(F.col("site_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    margin = F.coalesce("margin_db", F.lit(-1.0))
    quality = F.when(margin >= 10, "good").when(margin >= 3, "fair").otherwise("poor")
    text = F.concat(
        F.lit('{"type":"Feature","properties":{"marginDb":'), number_text(margin),
        F.lit('},"geometry":{"type":"LineString","coordinates":[['), number_text("lon1"), F.lit(","), number_text("lat1"),
        F.lit("],["), number_text("lon2"), F.lit(","), number_text("lat2"), F.lit("]]}}"),
    )
    met = tree.join(a, "src").join(b, "dst")
    return met.select("src", "dst", margin.alias("margin_db"), quality.alias("quality"), text.alias("feature"))


def validation_lines(results: DataFrame) -> DataFrame:
    """(site_id, line): PASS or FAIL with three metrics, or the error."""
    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    fine = F.concat(
        F.col("name"), F.lit(": "), status, F.lit(" (F1="), fixed_text("f1_score", 3), F.lit(", Jaccard="),
        fixed_text("jaccard", 3), F.lit(", Accuracy="), fixed_text("accuracy", 3), F.lit(")"),
    )
    bad = F.concat(F.col("name"), F.lit(": ERROR - "), F.col("error"))
    return results.select("site_id", F.when(F.col("error").isNotNull(), bad).otherwise(fine).alias("line"))


def validation_report(results: DataFrame, generated: str) -> DataFrame:
    """(pos, line) of the whole report: title, time ``generated``, totals, then the numbered sites by site_id.

    Numbers are counted range by range, with what earlier ranges hold added.
    """
    spark = results.sparkSession
    stored = cut_lineage(validation_lines(results).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "site_id")
                         .sortWithinPartitions("site_id").withColumn("_m", F.monotonically_increasing_id()))
    held = stored.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = held.select("_p", before.alias("_before"))  # one row a range
    within = F.col("_m").bitwiseAND((1 << 33) - 1)
    numbered = stored.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p").select((F.col("_before") + within + 1).alias("_i"), "line")
    head = pass_counts(results)
    total, rule = F.col("total").cast("string"), F.lit("=" * 60)
    lines = [rule, F.lit("Coverage Validation Report"), F.lit(f"Generated: {generated}"), F.concat(F.lit("Sites validated: "), total), rule,
             F.concat(F.lit("Passed: "), F.col("passed").cast("string"), F.lit("/"), total), F.concat(F.lit("Failed: "), F.col("failed").cast("string"), F.lit("/"), total), F.lit("")]
    top = head.select(F.posexplode(F.array(*lines)).alias("pos", "line")).select(F.col("pos").cast("long").alias("pos"), "line")
    text = F.concat(F.lit("  ["), F.col("_i").cast("string"), F.lit("] "), F.col("line"))
    return top.union(numbered.select((F.col("_i") + 7).alias("pos"), text.alias("line")))


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_masked_raster(signal: DataFrame, threshold: float, path: str) -> None:
    """Masked pixels as Parquet, one folder per site; a large site is written by many tasks."""
    spread = masked_export(signal, threshold).repartition("site_id", F.floor(F.col("row") / 256))
    spread.write.mode("overwrite").partitionBy("site_id").parquet(path)


def candidate_scores(candidates: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Candidates with the distance to the nearest uncovered point, however far it is, and an infrastructure flag.

    ``candidates`` is (site_id, lat, lon, elev, notes), ``uncovered`` (poi_id, lat, lon). Without uncovered points
    the distance is NULL.
    """
    scored = nearest_between(candidates, uncovered, "poi_id", "nearest_poi_km", "nearest_poi")
    return scored.withColumns(
        {
            "nearest_poi_km": round_half_up("nearest_poi_km", 6),
            "has_infrastructure": F.coalesce(F.col("notes") != "", F.lit(False)),
        }
    )
