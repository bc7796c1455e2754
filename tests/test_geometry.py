"""Path functions against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions import paths as p
from fairlead.operators import paths as pt
from fairlead.operators.graph import connected_components


def plain_distance(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def plain_frechet(x, y):
    table = {}
    for i in range(len(x)):
        for j in range(len(y)):
            before = [table[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in table]
            table[i, j] = max(plain_distance(x[i], y[j]), min(before) if before else 0.0)
    return table[len(x) - 1, len(y) - 1]


def plain_path_distance(x, y, alpha):
    turn = lambda q: math.atan2(q[-1][1] - q[0][1], q[-1][0] - q[0][0])
    return (1 - alpha) * plain_frechet(x, y) + alpha * abs(turn(x) - turn(y))


def plain_dbscan(paths, alpha, eps, min_samples):
    n = len(paths)
    near = [[j for j in range(n) if i == j or plain_path_distance(paths[i], paths[j], alpha) <= eps] for i in range(n)]
    core = [len(x) >= min_samples for x in near]
    labels, label = [-1] * n, -1
    for start in range(n):
        if labels[start] != -1 or not core[start]:
            continue
        label += 1
        stack = [start]
        while stack:
            at = stack.pop()
            if labels[at] != -1:
                continue
            labels[at] = label
            if core[at]:
                stack += [j for j in near[at] if labels[j] == -1]
    return labels


def make_paths(seed=3, routes=3, per_route=14, spread=0.0006, noise=6):
    """Jittered copies of a few routes, exact copies, and scattered paths."""
    rng = np.random.default_rng(seed)
    out = []
    for r in range(routes):
        base = np.array([[59 + 0.02 * r, 18.0], [59 + 0.02 * r + 0.004, 18.01], [59 + 0.02 * r + 0.002, 18.03]])
        for k in range(per_route):
            out.append(base + (0 if k % 4 == 0 else rng.normal(0, spread, base.shape)))
    for _ in range(noise):
        out.append(np.array([59.2, 18.2]) + rng.uniform(0, 0.1, (2, 2)))
    rng.shuffle(out)
    return [[tuple(map(float, q)) for q in path] for path in out]


def frame(spark, paths):
    rows = [(i, [q[0] for q in x], [q[1] for q in x]) for i, x in enumerate(paths)]
    return spark.createDataFrame(rows, "path_id long, lat array<double>, lon array<double>").repartition(4)


def test_points(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(59.0), F.lit(18.0), F.lit(59.0), F.lit(18.0)).alias("same"),
        geo.haversine(F.lit(None).cast("double"), F.lit(18.0), F.lit(59.0), F.lit(18.0)).alias("missing"),
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("antipode"),
        geo.bearing(F.lit(59.0), F.lit(18.0), F.lit(59.0), F.lit(18.0)).alias("still"),
        geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("south"),
        geo.cross_track((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(10.0)), (F.lit(1.0), F.lit(5.0))).alias("off"),
    ).first()
    assert row.same == 0 and row.missing is None and row.still == 0 and row.south == 180
    assert row.antipode == pytest.approx(math.pi * 6_371_000)
    assert abs(row.off) == pytest.approx(math.radians(1) * 6_371_000)


def test_simplification_keeps_ends_and_is_strict():
    lat, lon = np.array([0.0, 0.0, 0.0]), np.array([0.0, 5.0, 10.0])
    assert p.kept_points(lat, lon, 1.0) == [0, 2]
    lat = np.array([0.0, 0.01, 0.0])
    far = p.offset(lat, lon, 0, 2)[0]
    assert p.kept_points(lat, lon, far) == [0, 2]
    assert p.kept_points(lat, lon, far * 0.999) == [0, 1, 2]
    assert p.kept_points(lat[:1], lon[:1], 1.0) == [0, 0]


def test_distances_match_plain_loops(spark):
    paths, alpha = make_paths(), 0.3
    found = {(r.i, r.j): r.dist for r in pt.path_distances(frame(spark, paths), alpha, 150.0).collect()}
    want = {(i, j): plain_path_distance(paths[i], paths[j], alpha)
            for i in range(len(paths)) for j in range(i + 1, len(paths))}
    want = {k: v for k, v in want.items() if v <= 150.0}
    assert found.keys() == want.keys() and len(want) > 20
    assert all(found[k] == pytest.approx(v) for k, v in want.items())


def test_crowded_cells_are_split(spark, monkeypatch):
    paths = make_paths()
    whole = pt.path_distances(frame(spark, paths), 0.3, 150.0).count()
    monkeypatch.setattr(pt, "BLOCK_ROWS", 3)
    assert pt.path_distances(frame(spark, paths), 0.3, 150.0).count() == whole


def test_unbounded_arguments_are_refused(spark):
    with pytest.raises(ValueError):
        pt.path_distances(frame(spark, make_paths()), 1.0, 150.0)


def test_date_line_and_poles(spark):
    line = [[(10.0, 179.9999), (10.0, 179.9990)], [(10.0, -179.9999), (10.0, 179.9991)], [(10.0, 170.0), (10.0, 170.001)],
            [(90.0, 12.0), (89.9999, 40.0)], [(90.0, -150.0), (89.9999, 41.0)], [(-90.0, 0.0), (-90.0, 90.0)],
            [(59.0, 18.0), (59.1, 18.1)], [(59.0, 18.0001), (59.1, 18.1001)]]
    got = {(r.i, r.j) for r in pt.path_distances(frame(spark, line), 0.0, 150.0).collect()}
    assert got == {(0, 1), (3, 4), (6, 7)}


@pytest.mark.parametrize("eps,min_samples,seed,crowd", [(100.0, 2, 3, 0), (60.0, 4, 5, 0), (45.0, 3, 8, 32), (60.0, 4, 5, 8)])
def test_clusters_match_plain_dbscan(spark, monkeypatch, eps, min_samples, seed, crowd):
    monkeypatch.setattr(pt, "CROWD", crowd)
    paths = make_paths(seed)
    found = {r.path_id: r.label for r in pt.cluster_paths(frame(spark, paths), 0.3, eps, min_samples, 0.0).collect()}
    want = plain_dbscan(paths, 0.3, eps, min_samples)
    assert [found[i] for i in range(len(paths))] == want
    assert len(set(want)) > 2


def test_dense_cells_touching_only_through_members(spark, monkeypatch):
    """Two heaps of paths whose first members are far apart and whose edges touch."""
    monkeypatch.setattr(pt, "CROWD", 0)
    step = math.degrees(1 / 6_371_000)
    line = lambda north: [(59.0 + north * step, 18.0), (59.0 + north * step, 18.02)]
    paths = [line(m) for m in (0.5, 5, 9, 13, 17)] + [line(m) for m in (172, 160, 158, 157)]
    found = {r.path_id: r.label for r in pt.cluster_paths(frame(spark, paths), 0.0, 140.5, 2, 0.0).collect()}
    assert [found[i] for i in range(len(paths))] == plain_dbscan(paths, 0.0, 140.5, 2)


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(0, 203).withColumnRenamed("id", "node")
    found = connected_components(nodes, edges)
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 201), (201, 1), (202, 1)}


def greedy_ward(points, weights, k):
    """Centres after merging the cheapest pair until k are left."""
    nodes = [(np.array(x, float), float(w)) for x, w in zip(points, weights)]
    cost = lambda a, b: a[1] * b[1] / (a[1] + b[1]) * ((a[0] - b[0]) ** 2).sum()
    while len(nodes) > k:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]))
        (x, v), (y, w) = nodes[i], nodes[j]
        nodes = [n for m, n in enumerate(nodes) if m not in (i, j)] + [((x * v + y * w) / (v + w), v + w)]
    return sorted((*map(float, x), w) for x, w in nodes)


def centres(spark, groups, monkeypatch, nodes):
    """Centres per cluster; groups are (points, weights, k)."""
    monkeypatch.setattr(pt, "TREE_NODES", nodes)
    rows = [(c, float(x[0]), float(x[1]), int(w)) for c, (points, weights, _) in enumerate(groups) for x, w in zip(points, weights)]
    points = spark.createDataFrame(rows, "label long, lat double, lon double, weight long").repartition(3)
    about = spark.createDataFrame([(c, k) for c, (_, _, k) in enumerate(groups)], "label long, k int")
    found = {c: [] for c in range(len(groups))}
    for r in pt.ward_centres(points, about, "label").collect():
        found[r.label].append((r.lat, r.lon, r.weight))
    return [sorted(x) for x in found.values()]


@pytest.mark.parametrize("nodes", [4, 500])
def test_ward_cut(spark, monkeypatch, nodes):
    rng = np.random.default_rng(2)
    heaps = np.concatenate([rng.normal(c, s, (25, 2)) for c, s in (((0, 0), 0.001), ((0.1, 0.3), 0.05), ((2, 2), 0.3))])
    groups = [
        (np.array([[0.0, 0.0], [0.0, 1.0], [10.0, 0.0], [10.0, 1.0], [30.0, 0.0]]), np.ones(5), 3),
        # A heavy pair is dearer to join than a light one at the same distance.
        (np.array([[0.0, 0.0], [0.0, 2.0], [9.0, 0.0], [9.0, 2.0]]), np.array([9, 9, 1, 1]), 3),
        (heaps, rng.integers(1, 40, len(heaps)), 6), (heaps[:30] + 50, np.ones(30), 1), (heaps[:1], np.array([4]), 3),
        (heaps[:4], np.ones(4), 9)]
    for found, group in zip(centres(spark, groups, monkeypatch, nodes), groups):
        assert np.allclose(found, greedy_ward(*group), atol=1e-9)


def test_representative_path(spark):
    paths = make_paths(noise=0, routes=1, spread=0.0001)
    rows = frame(spark, paths).withColumn("label", F.lit(0).cast("long"))
    found = pt.representative_path(rows, "label", 1.0).orderBy("seq").collect()
    simple = [p.kept_points(np.array([q[0] for q in x]), np.array([q[1] for q in x]), 1.0) for x in paths]
    assert len(found) == math.ceil(sum(map(len, simple)) / len(simple)) + 1
    assert found[0].lon == pytest.approx(18.0, abs=1e-3) and found[-1].lon == pytest.approx(18.03, abs=1e-3)


def lane(n, seed=1):
    """Noisy trips of one lane, a few of them much noisier."""
    rng = np.random.default_rng(seed)
    base = np.array([[59.0, 18.0], [59.004, 18.01], [59.002, 18.03]])
    return [base + rng.normal(0, 0.00018, base.shape) * (1 if rng.random() < 0.97 else 3) for _ in range(n)]


def lane_dbscan(paths, alpha, eps, min_samples):
    a = np.array(paths)
    turn = np.arctan2(a[:, -1, 1] - a[:, 0, 1], a[:, -1, 0] - a[:, 0, 0])
    near = []
    for i in range(len(a)):
        one = np.repeat(a[i:i + 1], len(a), 0)
        metres = p.frechet(one[..., 0], one[..., 1], a[..., 0], a[..., 1])
        near.append(np.flatnonzero((1 - alpha) * metres + alpha * np.abs(turn - turn[i]) <= eps))
    labels, label = [-1] * len(a), -1
    for start in range(len(a)):
        if labels[start] == -1 and len(near[start]) >= min_samples:
            label, stack = label + 1, [start]
            while stack:
                at = stack.pop()
                if labels[at] == -1:
                    labels[at] = label
                    stack += [j for j in near[at] if labels[j] == -1] if len(near[at]) >= min_samples else []
    return labels


def test_one_lane_takes_few_distances(spark, monkeypatch):
    """Trips of one lane are told apart by no end point: distances per trip must not grow with the trips."""
    taken = spark.sparkContext.accumulator(0)

    def counted(alpha):
        @F.pandas_udf("double")
        def tally(x: pd.Series) -> pd.Series:
            taken.add(len(x))
            return x
        metres = tally.asNondeterministic()(p.frechet_metres("lat_i", "lon_i", "lat_j", "lon_j"))
        return (1 - alpha) * metres + alpha * F.abs(F.col("dir_i") - F.col("dir_j"))

    monkeypatch.setattr(pt, "_distance", counted)
    monkeypatch.setattr(pt, "FEW", 10)
    share = {}
    for n in (400, 2000):
        paths = [[tuple(map(float, q)) for q in x] for x in lane(n)]
        taken.value = 0
        found = {r.path_id: r.label for r in pt.cluster_paths(frame(spark, paths), 0.3, 60.0, 4, 0.0).collect()}
        share[n] = taken.value / n
        assert [found[i] for i in range(n)] == lane_dbscan(paths, 0.3, 60.0, 4)
    assert share[2000] < 1.5 * share[400] and share[2000] < 80


@pytest.mark.parametrize("first,rounds", [(1, 2), (4, 8)])
def test_cover(spark, monkeypatch, first, rounds):
    monkeypatch.setattr(pt, "CROWD", 3)
    paths = make_paths()
    found = pt.cover(pt.with_direction(frame(spark, paths)), 0.3, 60.0, first, rounds).collect()
    assert sorted(r.path_id for r in found) == list(range(len(paths)))
    for r in found:
        assert r.gap == pytest.approx(plain_path_distance(paths[r.path_id], paths[r.pivot], 0.3), abs=1e-6) and r.gap <= 60.0
    assert {r.pivot for r in found} <= {r.path_id for r in found if r.path_id == r.pivot}


@pytest.mark.parametrize("witnesses,few", [(1, 0), (3, 100)])
def test_clusters_with_few_witnesses(spark, monkeypatch, witnesses, few):
    monkeypatch.setattr(pt, "WITNESSES", witnesses)
    monkeypatch.setattr(pt, "CROWD", 0)
    monkeypatch.setattr(pt, "FEW", few)
    monkeypatch.setattr(pt, "BLOCK_ROWS", 3)
    paths = make_paths(12, routes=2, per_route=25)
    for eps, min_samples in ((70.0, 3), (110.0, 5)):
        found = {r.path_id: r.label for r in pt.cluster_paths(frame(spark, paths), 0.3, eps, min_samples, 0.0).collect()}
        assert [found[i] for i in range(len(paths))] == plain_dbscan(paths, 0.3, eps, min_samples)


def test_meetings_come_once_without_python_for_two_points(spark):
    """Each pair of near paths meets once, also over the date line and around a pole; pairs of ends need no Python."""
    import itertools
    import random

    rng = random.Random(5)
    paths = [(i, [a, a + rng.uniform(-0.01, 0.01)], [o, o + rng.uniform(-0.02, 0.02)]) for i, (a, o) in enumerate(
        (base + rng.uniform(-0.02, 0.02), (at + rng.uniform(-0.04, 0.04) + 180) % 360 - 180)
        for base, at in ((59.0, 18.0), (0.0, 180.0), (89.9, 40.0), (-45.0, -180.0)) for _ in range(30))]
    df = spark.createDataFrame(paths, "path_id long, lat array<double>, lon array<double>")
    rows = pt.path_distances(df, 0.3, 1_500.0)
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    got = [(r.i, r.j) for r in rows.collect()]

    def metres(a, b, k):
        p, q = math.radians(a[1][k]), math.radians(b[1][k])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2][k] - a[2][k]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    turn = lambda a: math.atan2(a[2][1] - a[2][0], a[1][1] - a[1][0])
    want = {(a[0], b[0]) for a, b in itertools.combinations(paths, 2)
            if 0.7 * max(metres(a, b, 0), metres(a, b, 1)) + 0.3 * abs(turn(a) - turn(b)) <= 1_500.0}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_distances_are_taken_where_paths_meet(spark, monkeypatch):
    """No pair of paths becomes a joined row, and a cell may reach over any number of batches and looks."""
    monkeypatch.setattr(pt, "MET", 5)
    monkeypatch.setattr(pt, "POINTS", 20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        paths, alpha = make_paths(), 0.3
        rows = pt.path_distances(frame(spark, paths), alpha, 150.0)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "ArrowEvalPython" not in plan
        found = {(r.i, r.j): r.dist for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(i, j): plain_path_distance(paths[i], paths[j], alpha) for i in range(len(paths)) for j in range(i + 1, len(paths))}
    want = {k: v for k, v in want.items() if v <= 150.0}
    assert found.keys() == want.keys() and len(want) > 20
    assert all(found[k] == pytest.approx(v) for k, v in want.items())


def test_a_large_cluster_is_not_gathered_for_its_grid(spark, monkeypatch):
    """The points of a cluster meet its grid where they lie; they are not brought together by cluster."""
    plans, stored = [], pt.stored

    def noted(df, name):
        if name == "scales":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    rng = np.random.default_rng(4)
    rows = [(0, (a, o), 1, a, o, 1.0) for a, o in rng.uniform(0, 1, (4_000, 2)).tolist()]
    active = stored(spark.createDataFrame(
        rows, "label long, node struct<lat: double, lon: double>, size long, lat double, lon double, weight double"), "nodes")
    large = stored(spark.createDataFrame([(0, 4_000, 1.0)], "label long, n long, least double"), "large")
    monkeypatch.setattr(pt, "stored", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        scale = pt._scales(active, large, None, "label").first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and not any("SortMergeJoin" in line and "Inner" in line for line in plans[0].splitlines())
    assert 0 < scale.level < pt.LEVELS


def test_spans_of_all_paths_are_split_together():
    rng = np.random.default_rng(4)
    n = np.concatenate([[0, 1, 2, 3], rng.integers(0, 25, 60), [0]])
    lat, lon = 59 + rng.random(n.sum()).round(2) / 10, 18 + rng.random(n.sum()) / 10
    lat[rng.integers(0, len(lat), 9)] = np.nan
    for epsilon in (0.0, 900.0, 3_000.0):
        kept, count = p.kept_of_all(lat, lon, n, epsilon)
        parts = np.split(kept, np.cumsum(count)[:-1])
        ends = np.cumsum(n)
        assert [list(x) for x in parts] == [p.kept_points(lat[e - k:e], lon[e - k:e], epsilon) for k, e in zip(n, ends)]


def test_simplification_in_runs(spark, monkeypatch):
    paths = make_paths(4) + [[(59.0, 18.0)], [(59.0 + k / 7 % 0.3, 18.0 + k / 100) for k in range(40)]]
    whole = {r.path_id: (r.lat, r.lon) for r in pt.simplify(frame(spark, paths), 20.0).collect()}
    monkeypatch.setattr(p, "RUN_POINTS", 5)
    assert {r.path_id: (r.lat, r.lon) for r in pt.simplify(frame(spark, paths), 20.0).collect()} == whole
    for i, x in enumerate(paths):
        at = p.kept_points(np.array([q[0] for q in x]), np.array([q[1] for q in x]), 20.0)
        assert whole[i] == ([x[k][0] for k in at], [x[k][1] for k in at])


def test_links_of_a_cell_follow_its_paths(spark):
    """Forty paths within reach of each other have 780 near pairs; 39 of them connect them."""
    rows = pt.with_direction(frame(spark, [[(59.0 + k * 1e-6, 18.0), (59.0 + k * 1e-6, 18.02)] for k in range(40)]))
    grid = pt.Grid(0.3, 100.0)
    met = lambda linking: pt._meetings(rows, rows, grid, once=True, measure=(0.3, 100.0), linking=linking).select(
        F.col("path_id_i").alias("a"), F.col("path_id_j").alias("b"))
    links = met(True)
    assert met(False).count() == 780 and links.count() <= 2 * 40
    parts = connected_components(rows.select(F.col("path_id").alias("node")), links).select("component").distinct().collect()
    assert [r[0] for r in parts] == [0]


def test_clusters_without_crowds_are_components(spark):
    """Few paths in a cell, two samples to a core: the plan without pivots."""
    for seed, eps in ((3, 100.0), (9, 45.0)):
        paths = make_paths(seed)
        found = {r.path_id: r.label for r in pt.cluster_paths(frame(spark, paths), 0.3, eps, 2, 0.0).collect()}
        assert [found[i] for i in range(len(paths))] == plain_dbscan(paths, 0.3, eps, 2)
