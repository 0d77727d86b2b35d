"""End-to-end jobs: coverage report, candidate matrix, mesh plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.functions.geo import Grid
from ridgecast.functions.radio import DEFAULT_PARAMS
from ridgecast.operators import coverage as cov
from ridgecast.operators.network import is_connected, spanning_forest
from ridgecast.operators.raster import BlockRaster, valid_elevation
from ridgecast.operators.selection import (
    greedy_picks,
    select_mesh_sites,
    selection_frame,
    selection_summary,
    target_count,
)
from ridgecast.operators.sweep import connectivity_graph, coverage_sweep, fill_gaps
from ridgecast.operators.terrain import scout, top_candidates
from ridgecast.session import cut_lineage


def coverage_report(
    signal: DataFrame, grid: Grid, threshold: float, target: float, block: int = 4,
    zones: DataFrame | None = None, zone_target: bool = False,
) -> DataFrame:
    """One row per selected site with the coverage of the combined raster beside it.

    Combines all sites, thresholds, measures the covered share, builds the site-by-cell
    matrix and picks sites greedily until the target share of cells is covered. With ``zones``
    (zone_id, polygon) the covered share is that of the pixels in any zone, and ``total_pixels`` says how many these
    are; with ``zone_target`` sites are also picked for the cells of the zones alone.
    """
    clean = cov.clean_signal(signal)
    heard = cut_lineage(cov.at_threshold(clean, threshold).select("site_id", "row", "col"))
    mask = heard.select("row", "col").distinct().withColumn("covered", F.lit(True))
    runs = None if zones is None else cut_lineage(cov.merged_runs(cov.zone_runs(zones, grid)))
    share = cov.covered_fraction(mask, total=grid.width * grid.height) if runs is None else cov.zone_fraction(mask, runs)
    n_cells = cov.block_cells(grid, block)
    matrix = heard.select("site_id", cov.cell_id(grid, block).alias("cell_id")).distinct()
    cells = None
    if runs is not None and zone_target:
        cells = cut_lineage(cov.run_cells(runs, grid, block))
        n_cells = cells.count()
    picks = greedy_picks(matrix, target_cells=target_count(target, n_cells), cells=cells)
    selection = selection_frame(signal.sparkSession, picks)
    found = share.select(F.col("covered_cells").alias("covered_pixels"), F.col("total_cells").alias("total_pixels"), "covered_fraction")
    rest = ["covered_pixels", *(["total_pixels"] if runs is not None else []), "covered_fraction"]
    chosen = F.lit(0.0) if not n_cells else F.col("covered_after") / F.lit(float(n_cells))
    return selection.withColumn("selected_fraction", chosen).crossJoin(F.broadcast(found.select(*rest)))  # one row


def candidate_matrix(
    candidates: DataFrame, grid: Grid, params: dict = DEFAULT_PARAMS, max_km: float = 30.0,
    threshold: float = -120.0, n_radials: int = 360, top_n: int | None = None, block: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(matrix, skipped) for all candidates, or the ``top_n`` of them by viewshed rank.

    Sweep, gap fill, then the site-by-cell matrix. Candidates without any signal row are in
    ``skipped``; when all are, the job fails.
    """
    chosen = cut_lineage(top_candidates(candidates, top_n).select("site_id", "lat", "lon"))
    swept = cut_lineage(coverage_sweep(chosen, grid, params, max_km, n_radials))
    signal = fill_gaps(chosen, swept, grid, max_km, n_radials)
    matrix = cut_lineage(cov.coverage_matrix(signal, grid, threshold, block))
    skipped = chosen.join(swept.select("site_id").distinct(), "site_id", "left_anti")
    if swept.isEmpty() and not chosen.isEmpty():
        raise ValueError("no candidate has a coverage raster, so there is no matrix")
    return matrix, skipped


def mesh_plan(
    pixels: DataFrame, grid: Grid, params: dict = DEFAULT_PARAMS, max_km: float = 30.0, threshold: float = -120.0,
    target: float = 0.8, n_radials: int = 360, min_prominence: float = 50.0, density: int = 50,
    weight: float = 0.3, block: int = 4, min_distance_km: float = 0.5, max_peaks: int | None = None, top_n: int | None = None,
) -> dict[str, DataFrame]:
    """Scout, matrix, links, selection, spanning tree, summary; each a DataFrame keyed by site_id."""
    candidates = cut_lineage(scout(pixels, grid, None, min_prominence, max_peaks, density, min_distance_km))
    matrix, skipped = candidate_matrix(
        candidates, grid, params, max_km, threshold, n_radials, top_n, block
    )
    raster = BlockRaster.of(pixels.withColumn("elev", valid_elevation("elev")), grid).persisted()
    links = cut_lineage(connectivity_graph(candidates, raster, max_km))
    n_cells = cov.block_cells(grid, block)
    selection = select_mesh_sites(matrix, n_cells, target, links, weight)
    tree, components = spanning_forest(selection, links)
    summary = plan_summary(candidates, selection, tree, components, n_cells)
    return {
        "candidates": candidates, "matrix": matrix, "skipped": skipped, "links": links, "selection": selection,
        "tree": tree, "components": components, "summary": summary,
    }


def plan_summary(candidates: DataFrame, selection: DataFrame, tree: DataFrame, components: DataFrame, n_cells: int) -> DataFrame:
    """One row: selected sites, covered and gap share, candidates, tree edges, connected."""
    picked = selection_summary(selection, n_cells).select("n_sites", "covered_fraction")
    return picked.select(
        F.col("n_sites"),
        "covered_fraction",
        (1.0 - F.col("covered_fraction")).alias("gap_fraction"),
        candidates.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_candidates"),
        tree.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_tree_edges"),
        is_connected(components).select("connected").scalar().alias("connected"),
    )
