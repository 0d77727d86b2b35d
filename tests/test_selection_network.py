"""Greedy selection and graph jobs against hand values and brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ridgecast.operators import network as net
from ridgecast.operators import selection as sel

LINKS = "src long, dst long, distance_km double, los_clear boolean"


def matrix(spark, sites):
    return spark.createDataFrame([(s, c) for s, cells in enumerate(sites) for c in cells], "site_id long, cell_id long")


def links(spark, rows):
    return spark.createDataFrame([(*r, True) if len(r) == 3 else r for r in rows], LINKS)


def ids(selection):
    return [r["site_id"] for r in selection.orderBy("rank").collect()]


def brute_greedy(sites, need, weight=0.0, pairs=()):
    covered, picks = set(), []
    near = {frozenset(p) for p in pairs}
    while len(covered) < need:
        best = None
        for s, cells in enumerate(sites):
            gain = len(set(cells) - covered)
            if s in picks or (gain == 0 and picks):
                continue
            bonus = weight * len(picks) if any(frozenset((s, p)) in near for p in picks) else 0
            if best is None or gain + bonus > best[0]:
                best = (gain + bonus, s)
        if best is None or best[0] <= 0:
            break
        picks.append(best[1])
        covered |= set(sites[best[1]])
    return picks


def test_hand_values(spark):
    m = matrix(spark, [[0, 1], [1, 2, 3], [3, 4]])
    assert ids(sel.select_min_sites(m, 5, 0.8)) == [1, 0]
    assert ids(sel.select_max_coverage(m, 1)) == [1]
    row = sel.selection_summary(sel.select_min_sites(m, 5, 0.8), 5, 0.8).first()
    assert (row["n_sites"], row["covered_fraction"], row["status"]) == (2, 0.8, "Optimal")


def test_linked_site_wins_the_tie(spark):
    m = matrix(spark, [[0, 1], [2, 3, 4], [0, 5]])
    assert ids(sel.select_mesh_sites(m, 6, 0.95, links(spark, [(0, 1, 2.0)])))[:2] == [1, 0]


def test_chain_selection_is_connected(spark):
    m = matrix(spark, [[0], [1], [2, 3], [4, 5, 6]])
    chain = links(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    picked = sel.select_mesh_sites(m, 7, 0.95, chain)
    assert ids(picked) == [3, 2, 1, 0]
    assert net.is_connected(net.connected_components(picked, chain)).first()["connected"]


def test_target_zero_and_unreachable_target(spark):
    m = matrix(spark, [[0], [1]])
    assert ids(sel.select_min_sites(m, 10, 0.0)) == []
    assert sel.selection_summary(sel.select_min_sites(m, 10, 0.9), 10, 0.9).first()["status"] == "Feasible"


@pytest.mark.parametrize("seed,weight", [(1, 0.0), (2, 0.0), (3, 0.3), (4, 2.0)])
def test_batched_greedy_equals_one_at_a_time(spark, seed, weight):
    rng = random.Random(seed)
    sites = [rng.sample(range(80), rng.randint(1, 14)) for _ in range(30)]
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.15]
    table = links(spark, [(a, b, 1.0) for a, b in pairs]) if weight else None
    picks = sel.greedy_picks(matrix(spark, sites), target_cells=70, links=table, link_weight=weight, batch=4)
    assert [p[1] for p in picks] == brute_greedy(sites, 70, weight, pairs if weight else ())


def test_sensitivity_prefix_equals_single_runs(spark):
    rng = random.Random(9)
    sites = [rng.sample(range(40), 8) for _ in range(12)]
    scen = spark.createDataFrame([(0, "a", 0.0, 0.9), (1, "b", 0.0, 0.4), (2, "a", 0.0, 0.1)], sel.SCENARIO_SCHEMA)
    got = {r["name"]: r["n_sites"] for r in sel.sensitivity_min_sites(scen, 40, matrix=matrix(spark, sites)).collect()}
    assert got == {"a": len(brute_greedy(sites, 36)), "b": len(brute_greedy(sites, 16))}


def kruskal(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    tree = set()
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.add((a, b))
    return tree, [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [5, 6])
def test_forest_equals_kruskal(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.06]
    members = spark.createDataFrame([(i,) for i in range(n)], "site_id long")
    tree, comps = net.spanning_forest(members, links(spark, edges))
    want, roots = kruskal(n, edges)
    assert {(r["src"], r["dst"]) for r in tree.collect()} == want
    lowest = {r: min(i for i in range(n) if roots[i] == r) for r in set(roots)}
    assert {r["site_id"]: r["component"] for r in comps.collect()} == {i: lowest[roots[i]] for i in range(n)}


def test_triangle_and_blocked_link(spark):
    members = spark.createDataFrame([(0,), (1,), (2,)], "site_id long")
    tree, _ = net.spanning_forest(members, links(spark, [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 10.0)]))
    assert sorted(r["distance_km"] for r in tree.collect()) == [1.0, 2.0]
    tree, comps = net.spanning_forest(members, links(spark, [(0, 1, 1.0, False), (1, 2, 2.0, True)]))
    assert tree.count() == 1 and comps.select("component").distinct().count() == 2


def brute_bridge(n, edges, comp):
    comp, added = dict(comp), []
    while len(set(comp.values())) > 1:
        best = None
        for c in range(n):
            if c in comp:
                continue
            near = {}
            for a, b, d in edges:
                for x, y in ((a, b), (b, a)):
                    if x == c and y in comp:
                        near[comp[y]] = min(near.get(comp[y], math.inf), d)
            two = sorted(near.values())[:2]
            if len(two) == 2 and (best is None or (sum(two), c) < best[:2]):
                best = (sum(two), c, set(near))
        if best is None:
            break
        low = min(best[2])
        comp = {k: (low if v in best[2] else v) for k, v in comp.items()}
        comp[best[1]] = low
        added.append((best[1], best[0], len(set(comp.values()))))
    return added


def test_bridging_equals_brute_force(spark):
    rng = random.Random(11)
    n = 30
    edges = [(a, b, float(rng.randint(1, 50))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12]
    members = [i for i in range(n) if i % 3 == 0]
    frame = spark.createDataFrame([(i,) for i in members], "site_id long")
    comps = net.connected_components(frame, links(spark, edges))
    comp = {r["site_id"]: r["component"] for r in comps.collect()}
    got = [(r["candidate"], r["cost"], r["n_components"]) for r in net.bridge_components(links(spark, edges), comps).orderBy("step").collect()]
    assert got == brute_bridge(n, edges, comp)
    a, b = sorted(set(comp.values()))[:2]
    best = net.bridging_candidate(links(spark, edges), comps, a, b).collect()
    costs = []
    for c in set(range(n)) - set(members):
        d = {s: min([w for x, y, w in edges for p, q in ((x, y), (y, x)) if p == c and comp.get(q) == s], default=math.inf) for s in (a, b)}
        costs.append((d[a] + d[b], c))
    want = min(costs)
    assert ([(r["cost"], r["candidate"]) for r in best] or [(math.inf, None)])[0][0] == want[0]


@pytest.mark.parametrize("few", [3, 10_000])
def test_forest_of_many_tasks(spark, monkeypatch, few):
    """Edges thinned task by task, with rounds of contraction as long as too many are left."""
    monkeypatch.setattr(net, "FINISH_EDGES", few)
    rng = random.Random(8)
    n = 60
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08] + [(5, 5, 0.1)]
    members = spark.createDataFrame([(i,) for i in range(n + 2)], "site_id long")
    tree, comps = net.spanning_forest(members, links(spark, edges).repartition(5))
    want, roots = kruskal(n + 2, [e for e in edges if e[0] != e[1]])
    assert sorted((r["src"], r["dst"]) for r in tree.collect()) == sorted(want)
    lowest = {r: min(i for i in range(n + 2) if roots[i] == r) for r in set(roots)}
    assert {r["site_id"]: r["component"] for r in comps.collect()} == {i: lowest[roots[i]] for i in range(n + 2)}
    none, alone = net.spanning_forest(members, links(spark, edges).filter("false"))
    assert none.count() == 0 and alone.filter("site_id = component").count() == n + 2


def walk(peaks, km):
    """(ord, lat, lon) kept one after another."""
    kept = []
    for k, lat, lon in sorted(peaks):
        def far(other):
            p, q = math.radians(lat), math.radians(other[1])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(other[2] - lon) / 2) ** 2
            return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))) >= km
        if all(far(o) for o in kept):
            kept.append((k, lat, lon))
    return {k for k, _, _ in kept}


def rounds_of(monkeypatch):
    made = []
    whole = net.cut_lineage
    monkeypatch.setattr(net, "cut_lineage", lambda df: made.append(1) or whole(df))
    return made


def test_suppression_of_a_long_chain(spark, monkeypatch):
    """10,000 peaks that ascend along a line, each near the next two, take few rounds, not thousands."""
    chain = [(k, 10.0, 20.0 + k * 0.004) for k in range(10_000)]
    frame = spark.createDataFrame(chain, "ord long, lat double, lon double").repartition(6)
    made = rounds_of(monkeypatch)
    got = {r["ord"] for r in net.suppress_by_distance(frame, 1.0).collect()}
    step = next(k for k in range(1, 9) if 2 * 6371.0 * math.asin(math.cos(math.radians(10.0)) * math.sin(math.radians(0.002 * k))) >= 1.0)
    assert got == set(range(0, 10_000, step)) and len(made) <= 4


@pytest.mark.parametrize("cell", [5, 20_000])
def test_suppression_everywhere(spark, monkeypatch, cell):
    monkeypatch.setattr(net, "CELL_PEAKS", cell)
    rng = random.Random(cell)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.gauss(89.9, 0.2) % 90, rng.uniform(-180, 180)) for _ in range(80)]
    spots += [(rng.gauss(5, 0.3), (rng.gauss(180, 0.3) + 180) % 360 - 180) for _ in range(200)] + [(1.0, 1.0)] * 5
    peaks = [(k, *p) for k, p in enumerate(rng.sample(spots, len(spots)))]
    frame = spark.createDataFrame(peaks, "ord long, lat double, lon double").repartition(3)
    assert {r["ord"] for r in net.suppress_by_distance(frame, 25.0).collect()} == walk(peaks, 25.0)
    assert net.suppress_by_distance(frame.filter("false"), 25.0).count() == 0 and net.suppress_by_distance(frame, 0.0).count() == len(peaks)


@pytest.mark.parametrize("batch", [2, 16])
def test_runs_advance_together(spark, monkeypatch, batch):
    """Runs over several matrices equal single ones, and the loop is as long as the longest of them."""
    rng = random.Random(batch)
    sites = {run: [rng.sample(range(60), rng.randint(1, 9)) for _ in range(25)] for run in range(3)}
    rows = [(run, s, c) for run, table in sites.items() for s, cells in enumerate(table) for c in cells]
    goals = {0: (50, None), 1: (20, None), 2: (None, 7)}
    passes = []
    whole = sel.cut_lineage
    monkeypatch.setattr(sel, "cut_lineage", lambda df: passes.append(1) or whole(df))
    picks = sel.greedy_runs(spark.createDataFrame(rows, "run int, site_id long, cell_id long"), goals, batch)
    together = len(passes)
    assert [p[1] for p in picks[0]] == brute_greedy(sites[0], 50) and [p[1] for p in picks[1]] == brute_greedy(sites[1], 20)
    assert [p[1] for p in picks[2]] == brute_greedy(sites[2], 60)[:7]
    alone = []
    for run, goal in goals.items():
        passes.clear()
        sel.greedy_runs(spark.createDataFrame([r for r in rows if r[0] == run], "run int, site_id long, cell_id long"), {run: goal}, batch)
        alone.append(len(passes))
    assert together == max(alone)
    assert sel.greedy_runs(spark.createDataFrame([], "run int, site_id long, cell_id long"), {0: (5, None)}) == {0: []}


def test_rethreshold_and_fixed_number(spark):
    rng = random.Random(4)
    tables = {t: [rng.sample(range(30), 5) for _ in range(10)] for t in (-90.0, -80.0)}
    scen = spark.createDataFrame([(0, "a", -90.0, 0.9), (1, "b", -80.0, 0.5), (2, "c", -90.0, 0.3)], sel.SCENARIO_SCHEMA)
    got = {r["name"]: r["n_sites"] for r in sel.sensitivity_min_sites(scen, 30, matrix_at=lambda t: matrix(spark, tables[t])).collect()}
    assert got == {"a": len(brute_greedy(tables[-90.0], 27)), "b": len(brute_greedy(tables[-80.0], 15)), "c": len(brute_greedy(tables[-90.0], 9))}
    fixed = {r["name"]: r["n_sites"] for r in sel.sensitivity_max_coverage(scen, 30, 3, matrix_at=lambda t: matrix(spark, tables[t])).collect()}
    assert fixed == {"a": 3, "b": 3, "c": 3}


def test_links_are_not_stored_for_picking(spark, monkeypatch):
    """Links are asked for by the ends that matter; the table of all of them is never written."""
    rng = random.Random(9)
    sites = [rng.sample(range(40), 6) for _ in range(20)]
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.3]
    stored = []
    whole = sel.cut_lineage
    monkeypatch.setattr(sel, "cut_lineage", lambda df: stored.append(df.columns) or whole(df))
    picks = sel.greedy_picks(matrix(spark, sites), target_cells=36, links=links(spark, [(a, b, 1.0) for a, b in pairs] * 2), link_weight=1.5, batch=3)
    assert [p[1] for p in picks] == brute_greedy(sites, 36, 1.5, pairs) and stored and not any("src" in c for c in stored)


def test_dense_edges_are_left_out_early(monkeypatch):
    """Edges that close a cycle of lesser ones do not reach the next forest, so a dense table costs little more than its forest."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, (2, 400_000))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    edges = pa.table({"ca": a, "cb": b, "distance_km": rng.integers(0, 5000, len(a)) / 10, "src": a, "dst": b}, net._EDGE_SCHEMA)
    seen = []
    whole = net._forest
    want, roots = whole(edges)
    monkeypatch.setattr(net, "_forest", lambda t: seen.append(t.num_rows) or whole(t))
    (got, root), = net._kruskal(edges.to_batches(max_chunksize=10_000), net.FINISH_EDGES)
    assert got.equals(want) and root == roots and sum(seen) < 150_000


def test_suppression_beside_a_crowd_of_the_undecided(monkeypatch):
    """A peak looks for one undecided peak near it, not at all of them."""
    calls = []
    whole = math.asin
    monkeypatch.setattr(net.math, "asin", lambda v: calls.append(1) or whole(v))
    far = [(k, False, net.UNKNOWN, 10.0, 20.0, 6000.0, 100.0, 50.0) for k in range(1500)]
    own = [(1500 + k, True, net.UNKNOWN, 10.0, 20.0, 6000.0, 100.0, 50.0) for k in range(1500)]
    assert list(net._walk([*far, *own], 3.0)) == [(1500 + k, net.UNKNOWN) for k in range(1500)] and len(calls) <= 3000


def test_forest_thinned_by_fewer_tasks(spark, monkeypatch):
    """More edges than one task finishes are thinned by fewer tasks first; the tree stays the same."""
    monkeypatch.setattr(net, "FINISH_EDGES", 400)
    rng = random.Random(12)
    edges = [(a, b, rng.randint(1, 50) / 2) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.9]
    table = links(spark, edges).repartition(8)
    made = rounds_of(monkeypatch)
    members = spark.createDataFrame([(k,) for k in range(60)], "site_id long")
    tree, comps = net.spanning_forest(members, table)
    want, _ = kruskal(60, edges)
    assert sorted((r["src"], r["dst"]) for r in tree.collect()) == sorted(want) and len(made) <= 2
    assert {r["component"] for r in comps.collect()} == {0}


def test_close_links_equal_the_filtered_ones(spark, tmp_path):
    from catalog import fixtures as fx

    spark.createDataFrame([(k, f"s{k}") for k in range(1, 120)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    want = fx.fixture(spark, str(tmp_path), "links").filter("distance_km <= 6").collect()
    got = fx.links_within(spark, str(tmp_path), 6.0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str) and len(want) > 20


def test_one_long_link_does_not_keep_dense_edges(monkeypatch):
    """An end that only a long link reaches leaves the others' edges as easy to leave out (F14, F17, F18, F19)."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, (2, 400_000)) * 1000
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    length = rng.integers(0, 5000, len(a)) / 10
    a, b, length = np.append(5, a), np.append(299_000, b), np.append(900.0, length)
    edges = pa.table({"ca": a, "cb": b, "distance_km": length, "src": a, "dst": b}, net._EDGE_SCHEMA)
    want, roots = net._forest(edges)
    sorted_rows, whole = [], net.pc.sort_indices
    monkeypatch.setattr(net.pc, "sort_indices", lambda t, **how: sorted_rows.append(t.num_rows) or whole(t, **how))
    (got, root), = net._kruskal(edges.to_batches(max_chunksize=10_000), net.FINISH_EDGES)
    assert got.equals(want) and root == roots and len(got) == 300 and sum(sorted_rows) < 150_000
