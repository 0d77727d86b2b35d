"""Greedy site selection over the sparse (site_id, cell_id) matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgecast.session import cut_lineage

SELECTION_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.LongType()),
        T.StructField("site_id", T.LongType()),
        T.StructField("gain", T.LongType()),
        T.StructField("covered_after", T.LongType()),
    ]
)


def greedy_picks(
    matrix: DataFrame,
    target_cells: int | None = None,
    max_sites: int | None = None,
    links: DataFrame | None = None,
    link_weight: float = 0.0,
    batch: int = 16,
    cells: DataFrame | None = None,
) -> list[tuple[int, int, int, int]]:
    """(rank, site_id, gain, covered_after) of the exact greedy order, lowest id on ties.

    ``cells`` (cell_id) are the cells that count, such as those of a zone; without it all do.

    Each pass over the matrix ranks all sites and looks closely at the best ``batch``: the
    cells they reach are counted per combination of those sites (at most 2^(batch+1) rows come
    back). That is enough to continue the greedy order among them, and a pick stands only
    while it beats every score a site outside the batch could still have. Otherwise the
    next pass begins, on the cells that are left. One pass thus usually yields several picks.
    ``links`` are never stored or turned round as a whole: a pass asks for those of a few sites by their ends, a filter
    that Spark takes down to where the links come from.
    """
    reach = matrix.select("site_id", "cell_id").distinct()
    remaining = cut_lineage(reach if cells is None else reach.join(cells.select("cell_id"), "cell_id", "left_semi"))
    picks: list[tuple[int, int, int, int]] = []
    covered = 0
    clear = None if links is None else links.filter("los_clear").select("src", "dst")

    def done() -> bool:
        return (target_cells is not None and covered >= target_cells) or (max_sites is not None and len(picks) >= max_sites)

    while not done():
        chosen = [p[1] for p in picks]
        gains = remaining.groupBy("site_id").agg(F.count(F.lit(1)).alias("gain"))  # a picked site has no cell left
        linked = F.lit(0)
        if links is not None and chosen:
            ahead = clear.filter(F.col("src").isin(chosen)).select(F.col("dst").alias("site_id"))
            reached = ahead.union(clear.filter(F.col("dst").isin(chosen)).select("src")).distinct()
            gains = gains.join(reached.withColumn("_linked", F.lit(1)), "site_id", "left")
            linked = F.coalesce(F.col("_linked"), F.lit(0))
        ranked = gains.select("site_id", "gain", linked.alias("linked")).withColumn(
            "score", F.col("gain") + F.lit(link_weight * len(chosen)) * F.col("linked")
        )
        by_gain = ranked.orderBy(F.desc("gain"), "site_id").limit(batch + 1)
        if links is None:
            leader = top = by_gain.collect()
        else:
            # The leader by score opens the pass; the others are the ones with the most to give.
            both = by_gain.withColumn("lead", F.lit(0)).union(
                ranked.orderBy(F.desc("score"), "site_id").limit(1).withColumn("lead", F.lit(1))
            ).collect()
            leader, top = [r for r in both if r["lead"]], [r for r in both if not r["lead"]]
        if not leader or leader[0]["score"] <= 0:
            break
        top = sorted(top, key=lambda r: (-r["gain"], r["site_id"]))
        head, outside = top[:batch], top[batch] if len(top) > batch else None
        if leader[0]["site_id"] not in {r["site_id"] for r in head}:
            head = [*head, leader[0]]
        ids = [r["site_id"] for r in head]
        slot = F.create_map(*[F.lit(v) for i, s in enumerate(ids) for v in (s, 1 << i)])
        reach = remaining.filter(F.col("site_id").isin(ids)).groupBy("cell_id").agg(
            F.bit_or(slot[F.col("site_id")].cast("long")).alias("mask")
        )
        tally = reach.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()
        masks = np.array([r["mask"] for r in tally], dtype=np.int64)
        counts = np.array([r["n"] for r in tally], dtype=np.int64)
        flags = {r["site_id"]: bool(r["linked"]) for r in head}
        neighbours: dict[int, set[int]] = {}
        if links is not None:
            for r in clear.filter(F.col("src").isin(ids) & F.col("dst").isin(ids)).distinct().collect():
                neighbours.setdefault(r["src"], set()).add(r["dst"])
                neighbours.setdefault(r["dst"], set()).add(r["src"])

        taken = []
        while len(taken) < len(ids) and not done():
            best = None
            for i, site in enumerate(ids):
                if site in taken:
                    continue
                gain = int(counts[(masks >> i) & 1 == 1].sum())
                if gain == 0 and picks:
                    continue
                bonus = link_weight * len(picks) if picks and flags[site] else 0.0
                if best is None or (gain + bonus, -site) > (best[0], -best[1]):
                    best = (gain + bonus, site, gain, i)
            if best is None or best[0] <= 0:
                break
            if taken and outside is not None:
                # A site outside may have lost cells since, never gained any, and may hold the link bonus.
                limit = outside["gain"] + (link_weight * len(picks) if links is not None else 0.0)
                beats = best[0] > limit or (links is None and best[0] == limit and best[1] < outside["site_id"])
                if not beats:
                    break
            score, site, gain, i = best
            covered += gain
            picks.append((len(picks) + 1, site, gain, covered))
            taken.append(site)
            counts = np.where((masks >> i) & 1 == 1, 0, counts)
            for other in neighbours.get(site, ()):
                flags[other] = True
        if not done():
            gone = remaining.filter(F.col("site_id").isin(taken)).select("cell_id").distinct()
            remaining = cut_lineage(remaining.join(gone, "cell_id", "left_anti").select("site_id", "cell_id"))
    return picks


def greedy_runs(matrix: DataFrame, goals: dict[int, tuple[int | None, int | None]], batch: int = 16) -> dict[int, list[tuple[int, int, int, int]]]:
    """Exact greedy orders of several runs in one loop: run to (rank, site_id, gain, covered_after).

    ``matrix`` is (run, site_id, cell_id), ``goals`` the cells to cover and the sites to pick at most, by run. The state,
    cells that are left, is keyed by run; a pass continues every run that is not done, as ``greedy_picks`` does with one, so
    there are as many passes as the longest run needs. At most 2 ** batch rows a run come back.
    """
    spark = matrix.sparkSession
    remaining = cut_lineage(matrix.select(F.col("run").cast("int").alias("run"), "site_id", "cell_id").distinct())
    picks: dict[int, list[tuple[int, int, int, int]]] = {run: [] for run in goals}

    def open_still(run: int) -> bool:
        cells, sites = goals[run]
        covered = picks[run][-1][3] if picks[run] else 0
        return not (cells is not None and covered >= cells or sites is not None and len(picks[run]) >= sites)

    live = {run for run in goals if open_still(run)}
    order = Window.partitionBy("run").orderBy(F.desc("gain"), "site_id")
    while live:
        gains = remaining.groupBy("run", "site_id").agg(F.count(F.lit(1)).alias("gain"))
        found = gains.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= batch + 1).collect()
        tops: dict[int, list] = {run: [] for run in live}
        for r in sorted(found, key=lambda r: r["_k"]):
            if r["run"] in live:
                tops[r["run"]].append((r["site_id"], r["gain"]))
        live = {run for run in live if tops[run]}
        if not live:
            break
        rows = [(run, site, 1 << i) for run in live for i, (site, _) in enumerate(tops[run][:batch])]
        slots = F.broadcast(spark.createDataFrame(rows, "run int, site_id long, bit long"))
        reach = remaining.join(slots, ["run", "site_id"]).groupBy("run", "cell_id").agg(F.bit_or("bit").alias("mask"))
        counted: dict[int, dict[int, int]] = {run: {} for run in live}
        for r in reach.groupBy("run", "mask").agg(F.count(F.lit(1)).alias("n")).collect():
            counted[r["run"]][r["mask"]] = r["n"]
        taken = []
        for run in sorted(live):
            ids = [site for site, _ in tops[run][:batch]]
            outside = tops[run][batch] if len(tops[run]) > batch else None
            masks = np.array(list(counted[run]), dtype=np.int64)
            counts = np.array(list(counted[run].values()), dtype=np.int64)
            free = dict(enumerate(ids))
            while free and open_still(run):
                gain, site, i = max((int(counts[(masks >> i) & 1 == 1].sum()), -site, i) for i, site in free.items())
                site = -site
                if gain == 0 or len(free) < len(ids) and outside is not None and (gain, -site) < (outside[1], -outside[0]):
                    break  # a site outside may give more now; it never gives more than it did
                covered = picks[run][-1][3] if picks[run] else 0
                picks[run].append((len(picks[run]) + 1, site, gain, covered + gain))
                taken.append((run, site))
                del free[i]
                counts = np.where((masks >> i) & 1 == 1, 0, counts)
        live = {run for run in live if open_still(run)}
        if live:
            chosen = F.broadcast(spark.createDataFrame(taken, "run int, site_id long"))
            gone = remaining.join(chosen, ["run", "site_id"]).select("run", "cell_id").distinct()
            kept = remaining.filter(F.col("run").isin(list(live))).join(gone, ["run", "cell_id"], "left_anti")
            remaining = cut_lineage(kept.select("run", "site_id", "cell_id"))
    return picks


def target_count(target: float, n_cells: int) -> int:
    return math.ceil(target * n_cells)


def selection_frame(spark, picks) -> DataFrame:
    return spark.createDataFrame(picks, SELECTION_SCHEMA)


def select_min_sites(matrix: DataFrame, n_cells: int, target: float) -> DataFrame:
    """Fewest sites by greedy until ceil(target * n_cells) cells are covered or nothing gains."""
    return selection_frame(matrix.sparkSession, greedy_picks(matrix, target_cells=target_count(target, n_cells)))


def select_max_coverage(matrix: DataFrame, n_sites: int) -> DataFrame:
    """A fixed number of sites, fewer when nothing gains."""
    return selection_frame(matrix.sparkSession, greedy_picks(matrix, max_sites=n_sites))


def select_mesh_sites(matrix: DataFrame, n_cells: int, target: float, links: DataFrame, weight: float = 0.3) -> DataFrame:
    """Greedy whose score adds weight * picks so far for a clear link to a picked site."""
    picks = greedy_picks(matrix, target_cells=target_count(target, n_cells), links=links, link_weight=weight)
    return selection_frame(matrix.sparkSession, picks)


def selection_summary(selection: DataFrame, n_cells: int, target: float | None = None) -> DataFrame:
    """One row (n_sites, covered_cells, covered_fraction, status)."""
    covered = F.coalesce(F.max("covered_after"), F.lit(0))
    row = selection.agg(F.count(F.lit(1)).alias("n_sites"), covered.alias("covered_cells"))
    row = row.withColumn("covered_fraction", F.col("covered_cells") / F.lit(float(n_cells)) if n_cells else F.lit(0.0))
    reached = F.lit(True) if target is None else F.col("covered_cells") >= target_count(target, n_cells)
    return row.withColumn("status", F.when(reached, "Optimal").otherwise("Feasible"))


# --- sensitivity -------------------------------------------------------------

SCENARIO_SCHEMA = "pos int, name string, threshold double, target double"


def default_scenarios(spark, base_threshold: float = -120.0) -> DataFrame:
    rows = [
        (0, "optimistic", base_threshold - 5, 0.95),
        (1, "nominal", base_threshold, 0.95),
        (2, "pessimistic", base_threshold + 5, 0.95),
    ]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def distinct_scenarios(scenarios: DataFrame) -> DataFrame:
    """The first scenario of each name, in input order."""
    columns = [c for c in scenarios.columns if c != "name"]
    order = ["pos", *[c for c in columns if c != "pos"]]
    first = scenarios.groupBy("name").agg(F.min(F.struct(*order)).alias("s"))
    return first.select("name", "s.*").select(*scenarios.columns)


def _scenario_runs(scenarios: DataFrame, matrix: DataFrame | None, matrix_at) -> tuple[list, dict[float | None, int], DataFrame]:
    """The distinct scenarios, the number of each run, and the matrices of all runs: one for every threshold, or one for all."""
    kept = distinct_scenarios(scenarios).orderBy("pos").collect()
    numbers = {key: n for n, key in enumerate(dict.fromkeys(s["threshold"] if matrix_at else None for s in kept))}
    whole = None
    for key, n in numbers.items():
        part = (matrix_at(key) if matrix_at else matrix).select(F.lit(n).alias("run"), "site_id", "cell_id")
        whole = part if whole is None else whole.union(part)
    return kept, numbers, whole


def sensitivity_min_sites(scenarios: DataFrame, n_cells: int, matrix: DataFrame | None = None, matrix_at=None) -> DataFrame:
    """(pos, name, n_sites, covered_fraction, status) per scenario.

    With ``matrix`` every scenario reuses it and only its target matters; the picks for a
    lower target are a prefix of those for a higher one, so a single greedy run serves all.
    With ``matrix_at(threshold)`` each distinct threshold has its own matrix and run; all runs advance in one loop.
    """
    kept, numbers, whole = _scenario_runs(scenarios, matrix, matrix_at)
    need = {s["pos"]: target_count(s["target"], n_cells) for s in kept}
    goals = {n: (max(need[s["pos"]] for s in kept if not matrix_at or s["threshold"] == key), None) for key, n in numbers.items()}
    runs = greedy_runs(whole, goals) if kept else {}
    out = []
    for s in kept:
        used = [p for p in runs[numbers[s["threshold"] if matrix_at else None]] if p[3] - p[2] < need[s["pos"]]]
        covered = used[-1][3] if used else 0
        out.append((s["pos"], s["name"], len(used), covered / n_cells if n_cells else 0.0, "Optimal" if covered >= need[s["pos"]] else "Feasible"))
    return scenarios.sparkSession.createDataFrame(out, "pos int, name string, n_sites long, covered_fraction double, status string")


def sensitivity_max_coverage(scenarios: DataFrame, n_cells: int, n_sites: int, matrix: DataFrame | None = None, matrix_at=None) -> DataFrame:
    """As above for a fixed number of sites, which is capped at the sites the matrix has."""
    kept, numbers, whole = _scenario_runs(scenarios, matrix, matrix_at)
    runs = greedy_runs(whole, {n: (None, n_sites) for n in numbers.values()}) if kept else {}
    out = []
    for s in kept:
        picks = runs[numbers[s["threshold"] if matrix_at else None]]
        out.append((s["pos"], s["name"], len(picks), picks[-1][3] / n_cells if picks else 0.0, "Optimal"))
    return scenarios.sparkSession.createDataFrame(out, "pos int, name string, n_sites long, covered_fraction double, status string")


def scenario_spread(results: DataFrame) -> DataFrame:
    """One row (min_fraction, max_fraction, spread): spread to ten decimals."""
    low, high = F.min("covered_fraction"), F.max("covered_fraction")
    return results.agg(
        F.coalesce(low, F.lit(0.0)).alias("min_fraction"), F.coalesce(high, F.lit(0.0)).alias("max_fraction")
    ).withColumn("spread", F.floor((F.col("max_fraction") - F.col("min_fraction")) * 1e10 + 0.5) / 1e10)
