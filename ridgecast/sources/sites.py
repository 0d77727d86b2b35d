"""Site readers: CSV, GeoJSON, map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgecast.functions.text import leading_number, title_from_snake, with_unique_names
from ridgecast.session import cut_lineage

# Accepted header names per column.
HEADER_ALIASES = {
    "name": ["name"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "longitude", "long"],
    "elevation": ["elevation", "elevation_m", "elev"],
    "notes": ["notes", "description"],
}


def valid_position(lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, numbered from each file's first non-blank line.

    Files stay splittable: lines are counted per file block, block totals are added up, and
    the in-block position comes from the increasing row id, so no file passes through one task.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    blank = F.regexp_replace("value", r"^[\s﻿]+", "") == ""
    per_block = raw.groupBy("file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min(F.when(~blank, F.col("_id"))).alias("_text")
    )
    run = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    starts = per_block.withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    header_at = F.min(F.col("_before") + F.col("_text") - F.col("_first")).over(Window.partitionBy("file"))
    starts = starts.withColumn("_header", header_at).select("file", "_block", "_first", "_before", "_header")
    numbered = raw.join(starts, ["file", "_block"]).withColumn(
        "line_no", F.col("_before") + F.col("_id") - F.col("_first") - F.col("_header")
    )
    trimmed = F.when(F.col("line_no") == 0, F.regexp_replace("value", r"^[\s﻿]+", "")).otherwise(F.col("value"))
    return numbered.filter("line_no >= 0").select("file", "line_no", trimmed.alias("value"))


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, name, lat, lon, elevation_m, notes) from (file, line_no, value), line 0 being the header.

    Plain comma split, aliased headers, lenient numbers; bad rows are skipped, repeated names
    get their line number. A file without name, lat and lon columns fails.
    """
    header = lines.filter("line_no = 0").select("file", F.split(F.lower("value"), ",").alias("_h"))
    for column, aliases in HEADER_ALIASES.items():
        # Only the first header cell with an accepted name counts.
        at = F.array_min(F.array(*[_position("_h", a) for a in aliases]))
        header = header.withColumn(f"_{column}", at)
    complete = F.col("_name").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    # one small job of its own, so the same error comes whatever the parsing plan looks like
    fault = F.raise_error(F.concat(F.lit("CSV must have columns: name, lat, lon in "), F.col("file")))
    header.filter(~complete).limit(1).select(fault.cast("string").alias("fault")).collect()
    header = header.drop("_h")
    cells = lines.filter("line_no > 0 and value <> ''").join(header, "file").withColumn("_c", F.split("value", ","))

    def cell(column: str) -> Column:
        return F.when(F.col(f"_{column}").isNotNull(), F.get("_c", F.col(f"_{column}") - 1))

    elevation = leading_number(cell("elevation"))
    notes = F.regexp_replace(cell("notes"), r"^\s+|\s+$", "")
    parsed = cells.select(
        "file", "line_no", F.regexp_replace(cell("name"), r"^\s+|\s+$", "").alias("name"),
        leading_number(cell("lat")).alias("lat"), leading_number(cell("lon")).alias("lon"),
        F.nullif(elevation, F.lit(0.0)).alias("elevation_m"), F.when(notes != "", notes).alias("notes"),
    ).filter((F.col("name") != "") & valid_position())
    return with_unique_names(parsed, "name", ["file"], "line_no")


def _position(array: str, name: str) -> Column:
    at = F.array_position(array, F.lit(name)).cast("int")
    return F.when(at > 0, at)


def read_sites_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_csv_lines(cut_lineage(numbered_lines(spark, path)))


GEOJSON_SCHEMA = (
    "type string, features array<struct<type string, geometry struct<type string, coordinates array<double>>,"
    " properties map<string,string>>>"
)


def parse_geojson(documents: DataFrame) -> DataFrame:
    """(file, feature_no, name, lat, lon, elevation_m, notes) from (file, type, features).

    Points in range only; names fall back to ``Site n``; repeats get their feature number. A
    document that is not a FeatureCollection fails.
    """
    right = (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    checked = documents.withColumn(
        "features",
        F.when(F.coalesce(right, F.lit(False)), F.col("features")).otherwise(
            F.raise_error(F.lit("Invalid GeoJSON: expected FeatureCollection")).cast(documents.schema["features"].dataType)
        ),
    )
    each = checked.select("file", F.posexplode("features").alias("_pos", "f")).withColumn("feature_no", F.col("_pos") + 1)
    return parse_features(each.select("file", "feature_no", "f.type", "f.geometry", "f.properties"))


def parse_features(features: DataFrame) -> DataFrame:
    """Sites from (file, feature_no, type, geometry, properties)."""
    props = F.coalesce("properties", F.create_map().cast("map<string,string>"))

    def prop(key: str) -> Column:
        return F.try_element_at("_p", F.lit(key))

    points = features.withColumn("_p", props).filter(
        (F.col("type") == "Feature") & (F.col("geometry.type") == "Point")
    )
    elevation = F.when(F.map_contains_key("_p", "elevation_m"), F.coalesce(prop("elevation_m").try_cast("double"),
                       F.when(prop("elevation_m").isNull() | (F.trim(prop("elevation_m")) == ""), F.lit(0.0))))
    notes = F.when(F.map_contains_key("_p", "notes"), F.coalesce(prop("notes"), F.lit("null")))
    named = F.coalesce(prop("name"), prop("Name"), F.concat(F.lit("Site "), F.col("feature_no").cast("string")))
    parsed = points.select(
        "file", "feature_no", named.alias("name"),
        F.get("geometry.coordinates", 1).alias("lat"), F.get("geometry.coordinates", 0).alias("lon"),
        elevation.alias("elevation_m"), notes.alias("notes"),
    ).filter(valid_position())
    return with_unique_names(parsed, "name", ["file"], "feature_no")


FEATURE_SCHEMA = "type string, geometry struct<type string, coordinates array<double>>, properties map<string,string>"
FEATURES_OPEN = r'"features"\s*:\s*\['


def _running(rows: DataFrame, totals: dict[str, Column], keys: tuple[str, ...] = ("file", "_block")) -> DataFrame:
    """Rows with, for each name, the sum of a column over all earlier rows of the file: block totals added up, then counted on inside a block."""
    made = rows.withColumns({f"_v_{n}": c for n, c in totals.items()})
    blocks = made.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    upto = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_b_{n}") for n in totals])
    inside = Window.partitionBy(*keys).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    met = made.join(bases, list(keys))
    found = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in totals}
    return met.withColumns(found).drop(*[f"_{k}_{n}" for n in totals for k in "vb"])


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature_no, feature): the text of every feature of FeatureCollection files, which many tasks read together.

    A file is read in pieces that end with a closing brace, split by split. Whether a piece begins inside a string is the number
    of quotes before it; how deep it begins is the number of braces and brackets before it, strings left out. Both are
    sums over earlier pieces, added up block by block. A feature ends where a brace closes inside the features array
    alone. A file without such an array, or that nowhere says it is a FeatureCollection, fails.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value",
    )
    raw = cut_lineage(raw)
    plain = F.regexp_replace("value", r"\\.", "")

    def count(text: Column, sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    quoted = _running(raw.withColumn("_plain", plain), {"quotes": count(F.col("_plain"), '"')})
    within = F.col("quotes") % 2 == 1
    # text outside strings: what follows the quote that ends an open string, without whole strings and without one that stays open
    rest = F.when(within, F.regexp_extract("_plain", r'(?s)^[^"]*"(.*)$', 1)).otherwise(F.col("_plain"))
    outside = F.regexp_replace(F.regexp_replace(rest, r'"[^"]*"', ""), r'"[^"]*$', "")
    ends_outside = (F.col("quotes") + count(F.col("_plain"), '"')) % 2 == 0
    marked = quoted.withColumns({"_out": outside, "_ends": ends_outside})
    opened, shut = count(F.col("_out"), "{"), F.col("_ends").cast("int")
    brackets = count(F.col("_out"), "[") - count(F.col("_out"), "]")
    placed = cut_lineage(_running(marked, {"depth": opened - shut, "arrays": brackets, "opens": F.col("value").rlike(FEATURES_OPEN).cast("int")}))
    opens = F.col("opens") + F.col("value").rlike(FEATURES_OPEN).cast("int")
    after = {"_depth": F.col("depth") + opened - shut, "_arrays": F.col("arrays") + brackets}
    ended = F.col("_ends") & (F.col("_depth") == 1) & (F.col("_arrays") == 1) & (opens > 0)
    leaves = (F.col("arrays") == 1) & (F.col("depth") == 1) & (F.col("opens") > 0) & F.col("_out").rlike(r"^\s*\]")
    flagged = placed.withColumns(after).withColumns({"_end": ended, "_leave": leaves})
    numbered = _running(flagged, {"done": F.col("_end").cast("int"), "left": F.col("_leave").cast("int")})
    rows = cut_lineage(numbered.filter((F.col("left") == 0) & ~F.col("_leave")).select("file", (F.col("done") + 1).alias("feature_no"), "_block", "_id", "value", "_end"))
    wrong = raw.groupBy("file").agg(F.max(F.col("value").rlike(r'"type"\s*:\s*"FeatureCollection"')).alias("right"), F.max(F.col("value").rlike(FEATURES_OPEN)).alias("list"))
    fault = F.raise_error(F.lit("Invalid GeoJSON: expected FeatureCollection"))
    wrong.filter("not right or not list").limit(1).select(fault.cast("string").alias("fault")).collect()
    texts = rows.groupBy("file", "feature_no").agg(F.max("_end").alias("_end"), F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda p: p["value"]), "}")
    body = F.when(F.col("feature_no") == 1, F.regexp_replace(joined, "(?s)^.*?" + FEATURES_OPEN, "")).otherwise(joined)
    return texts.filter("_end").select("file", "feature_no", F.concat(F.regexp_replace(body, r"^[\s,]+", ""), F.lit("}")).alias("feature"))


def read_sites_geojson(spark: SparkSession, path: str) -> DataFrame:
    parsed = geojson_features(spark, path).withColumn("f", F.from_json("feature", FEATURE_SCHEMA))
    return parse_features(parsed.select("file", "feature_no", "f.type", "f.geometry", "f.properties"))


ELEMENT_SCHEMA = (
    "type string, id long, lat double, lon double, tags map<string,string>, center struct<lat:double,lon:double>"
)


def read_map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements from JSON lines, with their position: the line in the file, on top of the lines of files before it by name."""
    lines = cut_lineage(numbered_lines(spark, path))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))  # one row a file
    placed = lines.filter(F.trim("value") != "").join(starts, "file")
    return placed.select(F.from_json("value", ELEMENT_SCHEMA).alias("e"), (F.col("_start") + F.col("line_no")).alias("element_pos")).select("e.*", "element_pos")


def tag_label(tags: str = "tags") -> Column:
    """Human label: amenity, else tower type with structure, else the first value, else a fixed text."""

    def tag(key: str) -> Column:
        value = F.try_element_at(tags, F.lit(key))
        return F.when(value != "", value)

    amenity, made, tower = tag("amenity"), tag("man_made"), tag("tower:type")
    any_value = F.get(F.filter(F.map_values(tags), lambda v: v != ""), 0)
    structure = F.when(tower.isNotNull(), F.concat_ws(" ", title_from_snake(tower), title_from_snake(made))).otherwise(
        title_from_snake(made)
    )
    return (
        F.when(amenity.isNotNull(), title_from_snake(amenity))
        .when(made.isNotNull(), structure)
        .when(tower.isNotNull(), F.concat(title_from_snake(tower), F.lit(" Tower")))
        .otherwise(F.coalesce(title_from_snake(any_value), F.lit("OSM Site")))
    )


def element_position() -> tuple[Column, Column]:
    """Own position of a node, centre of a way, nothing for other types."""
    kind = F.col("type")
    lat = F.when(kind == "node", F.col("lat")).when(kind == "way", F.col("center.lat"))
    lon = F.when(kind == "node", F.col("lon")).when(kind == "way", F.col("center.lon"))
    return lat, lon


def elements_to_sites(elements: DataFrame) -> DataFrame:
    """(element_pos, element_id, name, lat, lon, notes); later repeats of a name get the element id."""
    lat, lon = element_position()
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    given = F.trim(F.coalesce(F.try_element_at("_t", F.lit("name")), F.lit("")))
    number = F.col("id").cast("string")
    fallback = F.concat(tag_label("_t"), F.lit(" (OSM "), number, F.lit(")"))
    sites = elements.withColumn("_t", tags).select(
        "element_pos", F.col("id").alias("element_id"), F.when(given != "", given).otherwise(fallback).alias("name"),
        lat.alias("lat"), lon.alias("lon"),
        F.concat(F.lit("OSM element "), number, F.lit(" type="), F.col("type")).alias("notes"),
    ).filter("lat is not null and lon is not null")
    return with_unique_names(sites, "name", [], "element_pos", "element_id")


def elements_with_tags(elements: DataFrame, tag_specs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Nodes and ways inside west, south, east, north that meet any tag condition.

    ``tag_specs`` (key, value) is a request of a few conditions; they come to the elements as one row, so an element
    is read once whatever the number of conditions. No conditions meet nothing.
    """
    west, south, east, north = box
    lat, lon = element_position()
    wanted = tag_specs.select("key", "value").distinct().agg(F.collect_list(F.struct("key", "value")).alias("_wanted"))
    near = elements.filter(lat.between(south, north) & lon.between(west, east)).crossJoin(F.broadcast(wanted))  # one row
    hit = F.exists("_wanted", lambda w: F.coalesce(F.try_element_at("tags", w["key"]) == w["value"], F.lit(False)))
    return near.filter(hit).drop("_wanted")


def append_sites(*tables: DataFrame) -> DataFrame:
    """Concatenation of imports; names are not compared across files."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
