"""Prediction against reference: agreement metrics, ratings, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgecast.functions.geo import round_half_up
from ridgecast.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1_score", "jaccard")


def _finite(name: str):
    v = F.col(name)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def align(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(site_id, row, col, predicted, reference) where both are finite."""
    p = predicted.filter(_finite("rssi")).select("site_id", "row", "col", F.col("rssi").alias("predicted"))
    r = reference.filter(_finite("rssi")).select("site_id", "row", "col", F.col("rssi").alias("reference"))
    return p.join(r, ["site_id", "row", "col"])


def shape_check(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Sizes of both rasters of every site, and whether they are the same, from the raster tables (site_id, width, height).

    Pixel tables are sparse, so their counts say nothing about a raster's size. Where one raster is missing, its
    sizes and ``same_shape`` are NULL.
    """
    sides = [t.select("site_id", F.col("width").alias(f"{n}_width"), F.col("height").alias(f"{n}_height")) for t, n in ((predicted, "predicted"), (reference, "reference"))]
    both = sides[0].join(sides[1], "site_id", "full")
    same = (F.col("predicted_width") == F.col("reference_width")) & (F.col("predicted_height") == F.col("reference_height"))
    return both.withColumn("same_shape", same)


def shape_error() -> Column:
    """What is wrong with the sizes of ``shape_check``, else NULL. Rasters of one length but other sides differ too."""
    p, r = ([F.col(f"{n}_width"), F.col(f"{n}_height")] for n in ("predicted", "reference"))
    lengths = [w * h for w, h in (p, r)]
    text = F.concat(F.lit("Shape mismatch: predicted length "), lengths[0].cast("string"), F.lit(" vs reference length "), lengths[1].cast("string"))
    sides = [F.concat(w.cast("string"), F.lit(" x "), h.cast("string")) for w, h in (p, r)]
    turned = F.concat(F.lit("Shape mismatch: predicted "), sides[0], F.lit(" vs reference "), sides[1])
    missing = F.when(r[0].isNull(), "Reference raster not found").when(p[0].isNull(), "Predicted raster not found")
    return missing.when(lengths[0] != lengths[1], text).when(~F.col("same_shape"), turned)


def agreement(pairs: DataFrame, threshold: float = -120.0) -> DataFrame:
    """Confusion counts and five ratios (four decimals) per site; ratios with an empty denominator are 0."""
    p, r = F.col("predicted") >= F.lit(float(threshold)), F.col("reference") >= F.lit(float(threshold))
    counts = pairs.groupBy("site_id").agg(
        F.count_if(p & r).alias("tp"), F.count_if(~p & ~r).alias("tn"),
        F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    exact = counts.withColumns(
        {
            "total_pixels": tp + tn + fp + fn,
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "jaccard": ratio(tp, tp + fp + fn),
        }
    )
    both = F.col("precision") + F.col("recall")
    exact = exact.withColumn("f1_score", ratio(2.0 * F.col("precision") * F.col("recall"), both))
    return exact.withColumns({m: round_half_up(m, 4) for m in METRICS}).withColumn(
        "threshold_dbm", F.lit(float(threshold))
    )


def rated(metrics: DataFrame) -> DataFrame:
    j = F.col("jaccard")
    rating = F.when(j >= 0.9, "excellent").when(j >= 0.8, "good").when(j >= 0.7, "acceptable").otherwise("poor")
    return metrics.withColumns({"rating": rating, "passed": j >= 0.7})


def validate_sites(
    sites: DataFrame, predicted: DataFrame, reference: DataFrame, predicted_sizes: DataFrame, reference_sizes: DataFrame,
    threshold: float = -120.0,
) -> DataFrame:
    """One row per site of ``sites(site_id, name)``: metrics, rating and pass flag, or an error text.

    The raster tables (site_id, width, height) are met first. A site errs when a raster is missing, when the two differ in size,
    or when no pixel is finite on both sides; the pixels of sites that differ in size are not aligned.
    """
    sizes = shape_check(predicted_sizes, reference_sizes)
    checked = cut_lineage(sites.select("site_id", "name").join(sizes, "site_id", "left").withColumn("error", shape_error()).select("site_id", "name", "error"))
    fit = checked.filter("error is null").select("site_id")
    metrics = rated(agreement(align(predicted.join(fit, "site_id", "left_semi"), reference), threshold))
    joined = checked.join(metrics, "site_id", "left")
    names = [c for c in joined.columns if c != "error"]
    return joined.select(*names, F.coalesce("error", F.when(F.col("jaccard").isNull(), "No valid (finite) pixels to compare")).alias("error"))


def pass_counts(results: DataFrame) -> DataFrame:
    """One row (total, passed, failed); sites with an error count as failed."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed")
    ).withColumn("failed", F.col("total") - F.col("passed"))
