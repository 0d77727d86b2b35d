"""Small fixed tables: devices, bands, spreading factors, climates, tag labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgecast.functions.radio import DEFAULT_PARAMS, SF_SENSITIVITY_DBM
from ridgecast.functions.text import title_from_snake

# Device label, transmit power in dBm, antenna gain in dBi.
DEVICES = [
    ("Custom / manual", 22.0, 3.0),
    ("Heltec WiFi LoRa 32 V3", 21.0, 2.0),
    ("Heltec WiFi LoRa 32 V4 (high-power)", 28.0, 2.0),
    ("Heltec WiFi LoRa 32 V2", 20.0, 3.0),
    ("LILYGO T-Beam (SX1262)", 22.0, 2.0),
    ("LILYGO T-Beam Supreme", 22.0, 2.0),
    ("LILYGO T-Echo", 22.0, 1.0),
    ("LILYGO T-Deck", 22.0, 2.0),
    ("RAK WisBlock (RAK4631)", 22.0, 2.0),
    ("Station G2", 30.0, 3.0),
    ("Seeed SenseCAP T1000-E", 22.0, 1.0),
]
# Centre frequency in MHz by band.
BANDS = {"US915": 915.0, "EU868": 868.0, "AU915": 915.0, "AS923": 923.0, "CN470": 470.0, "IN865": 865.0, "KR920": 920.0}
UNKNOWN_BAND_MHZ = 915.0
# Climate names by code.
CLIMATES = {
    1: "Equatorial",
    2: "Continental Subtropical",
    3: "Maritime Subtropical",
    4: "Desert",
    5: "Continental Temperate",
    6: "Maritime Temperate (land)",
    7: "Maritime Temperate (sea)",
}
# Short tag id to key and value.
TAG_IDS = {
    "fire_station": ("amenity", "fire_station"),
    "school": ("amenity", "school"),
    "hospital": ("amenity", "hospital"),
    "tower": ("man_made", "tower"),
    "water_tower": ("man_made", "water_tower"),
}


def device_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEVICES, "device string, device_power_dbm double, device_gain_dbi double")


def band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BANDS.items()), "band string, band_mhz double")


def sensitivity_table(spark: SparkSession) -> DataFrame:
    rows = [(sf, float(dbm)) for sf, dbm in SF_SENSITIVITY_DBM.items()]
    return spark.createDataFrame(rows, "spreading_factor int, sf_sensitivity_dbm double")


def climate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLIMATES.items()), "climate int, climate_name string")


def resolve_tags(spark: SparkSession, tags: list[str] | None = None) -> DataFrame:
    """(pos, key, value, label): short ids, ``key=value`` or an amenity; the first of equal conditions stays."""
    rows = []
    for pos, tag in enumerate(tags or list(TAG_IDS)):
        key, eq, value = tag.partition("=")
        pair = (key.strip(), value.strip()) if eq else TAG_IDS.get(tag, ("amenity", tag))
        rows.append((pos, *pair))
    table = spark.createDataFrame(rows, "pos int, key string, value string")
    first = table.groupBy("key", "value").agg(F.min("pos").alias("pos"))
    return first.select("pos", "key", "value", title_from_snake("value").alias("label"))


def resolve_parameters(sites: DataFrame) -> DataFrame:
    """Sites with radio columns from their ``device``, ``band`` and ``spreading_factor``.

    The three tables are fixed and tiny, so they are broadcast. Custom or unknown devices keep
    the default power and gain, unknown bands use 915 MHz, unknown factors the fallback sensitivity.
    """
    spark = sites.sparkSession
    devices = device_table(spark).filter(F.col("device") != DEVICES[0][0])
    joined = (
        sites.join(F.broadcast(devices), "device", "left")
        .join(F.broadcast(band_table(spark)), "band", "left")
        .join(F.broadcast(sensitivity_table(spark)), "spreading_factor", "left")
    )
    return joined.withColumns(
        {
            "tx_power_dbm": F.coalesce("device_power_dbm", F.lit(DEFAULT_PARAMS["tx_power_dbm"])),
            "tx_gain_dbi": F.coalesce("device_gain_dbi", F.lit(DEFAULT_PARAMS["tx_gain_dbi"])),
            "frequency_mhz": F.coalesce("band_mhz", F.lit(UNKNOWN_BAND_MHZ)),
            "rx_sensitivity_dbm": F.coalesce("sf_sensitivity_dbm", F.lit(-130.0)),
        }
    ).drop("device_power_dbm", "device_gain_dbi", "band_mhz", "sf_sensitivity_dbm")
