"""Shapes with known answers, properties against nested loops, and file round trips."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.functions import colors
from terravox.functions.vectors import scaled_distance
from terravox.operators import blocks, fits, grid, neighborhood, octree, points, spatial, surfaces
from terravox.sources import auto, binary, text, writers


def cloud(spark, rows, extra=""):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"id long, x double, y double, z double{extra}")


def random_points(n, seed=0, scale=1.0):
    return np.random.default_rng(seed).random((n, 3)) * scale


def test_radius_join_is_the_nested_loop(spark):
    p = random_points(150)
    got = {(r.qid, r.nid) for r in spatial.radius_join(cloud(spark, p), cloud(spark, p), 0.2).collect()}
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.2 * 0.2), strict=True)}


def test_unit_grid_counts_and_faces(spark):
    p = [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]
    n = {r.qid: r.neighbours for r in spatial.radius_counts(cloud(spark, p), 1.0).collect()}
    assert n[13] == 7 and n[0] == 4  # centre and corner, the point itself included
    assert cloud(spark, p).where(points.in_box((0, 0, 0), (1, 1, 1))).count() == 8
    assert cloud(spark, p).where(points.in_box((0, 0, 0), (1, 1, 1), half_open=True)).count() == 1


@pytest.mark.parametrize("k", [1, 4, 40])
def test_knn_is_brute_force(spark, k):
    p = np.vstack([random_points(30, 1), random_points(10, 2, 0.01) + 5, [[100, 100, 100]]])
    got = {(r.qid, r["rank"]): r.nid for r in spatial.knn_join(cloud(spark, p), cloud(spark, p), k).collect()}
    for i in range(len(p)):
        d2 = ((p - p[i]) ** 2).sum(1)
        assert [got[i, r + 1] for r in range(k)] == sorted(range(len(p)), key=lambda j: (d2[j], j))[:k]


def test_knn_of_crowds_keeps_few_pairs(spark, monkeypatch):
    """Several blocks, a crowd at one place, a far point, rows without a place; no join, and few rows to be ranked."""
    monkeypatch.setattr(blocks, "MET", 64)
    p = np.vstack([random_points(600, 4), np.full((300, 3), 0.5), random_points(300, 5, 1e-6) + 0.3, [[1e6, 0, 0]]])
    rows = [(i, *map(float, v)) for i, v in enumerate(p)] + [(len(p), None, 0.0, 0.0), (len(p) + 1, math.nan, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    for f, allowed in ((lambda: spatial.knn_join(df, df, 3), lambda i, j, d2: True), (lambda: spatial.knn_join(df, df, 3, but="coincident"), lambda i, j, d2: d2 > 0), (lambda: spatial.knn_join(df, df, 3, but="same"), lambda i, j, d2: i != j)):
        out = f()
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.qid, r["rank"]): r.nid for r in out.collect()}
        assert len(got) == 3 * len(p)
        for i in range(0, len(p), 7):
            d = p - p[i]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            want = sorted((j for j in range(len(p)) if allowed(i, j, d2[j])), key=lambda j: (d2[j], j))[:3]
            assert [got[i, r] for r in (1, 2, 3)] == want


def test_nearest_of_coincident_points(spark):
    p = [(0, 0, 0), (0, 0, 0), (1, 0, 0)]
    other = {r.qid: (r.nid, r.d2) for r in spatial.nearest_other(cloud(spark, p)).collect()}
    apart = {r.qid: (r.nid, r.d2) for r in spatial.nearest_noncoincident(cloud(spark, p)).collect()}
    assert other[0] == (1, 0.0) and apart[0] == (2, 1.0) and apart[2] == (0, 1.0)


def test_subtract_and_match_are_complements(spark):
    a, b = cloud(spark, random_points(120, 3)), cloud(spark, random_points(60, 4))
    assert spatial.eps_subtract(a, b, 0.1).count() + spatial.eps_match(a, b, 0.1).count() == 120
    assert spatial.similarity(a, a, 1e-3).first().percent == 100.0
    none = a.limit(0)
    assert spatial.eps_subtract(a, none, 0.1).count() == 120 and spatial.similarity(none, none, 0.1).first().percent is None


def test_normals_of_a_plane(spark):
    p = [(x / 10, y / 10, 0.3 * x / 10 - 0.2 * y / 10 + 1) for x in range(8) for y in range(8)]
    n = np.array([[r.nx, r.ny, r.nz] for r in neighborhood.normals(cloud(spark, p), radius=0.25).collect()])
    unit = n / np.linalg.norm(n, axis=1)[:, None]
    want = np.array([-0.3, 0.2, 1]) / np.linalg.norm([-0.3, 0.2, 1])
    assert np.allclose(unit, want, atol=1e-6)
    assert neighborhood.normals(cloud(spark, [(0, 0, 0)]), radius=1.0).first().nz == 0


def test_fits_of_known_shapes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 3))
    ball = v / np.linalg.norm(v, axis=1)[:, None] * 2 + [1, 2, 3]
    t, h = rng.random(400) * 2 * math.pi, rng.random(400) * 5
    tube = np.stack([1.5 * np.cos(t) + 1, 1.5 * np.sin(t) - 1, h], axis=1)
    df = cloud(spark, np.vstack([ball, tube])).withColumn("g", (F.col("id") >= 300).cast("int"))
    s = {r.g: r for r in fits.fit_spheres(df, "g").collect()}[0]
    assert np.allclose([s.center_x, s.center_y, s.center_z, s.radius], [1, 2, 3, 2], atol=1e-5) and s.rms < 1e-5
    c = {r.g: r for r in fits.fit_cylinders(df, "g").collect()}[1]
    assert math.isclose(c.radius, 1.5, abs_tol=1e-4) and math.isclose(c.axis_z, 1, abs_tol=1e-4) and c.rms < 1e-4
    line = cloud(spark, [(i, 2 * i, 2 * i) for i in range(10)]).withColumn("g", F.lit(0))
    f = fits.fit_lines(line, "g").first()
    assert np.allclose([f.axis_x, f.axis_y, f.axis_z], [1 / 3, 2 / 3, 2 / 3]) and f.rms < 1e-6 and math.isclose(f.length, 27 * 1.2)
    plane = fits.fit_planes(cloud(spark, [(x, y, 5.0) for x in range(4) for y in range(3)]).withColumn("g", F.lit(0)), "g").first()
    assert math.isclose(plane.nz, 1) and math.isclose(plane.offset, 5) and plane.rms < 1e-9 and plane.n_points == 12


def test_large_selections_are_fitted_by_sums(spark, monkeypatch):
    rng = np.random.default_rng(20)
    v = rng.normal(size=(200, 3))
    ball = v / np.linalg.norm(v, axis=1)[:, None] * 2 + [1, 2, 3] + rng.normal(0, 0.01, (200, 3))
    t, h = rng.random(200) * 2 * math.pi, rng.random(200) * 5
    tube = np.stack([1.5 * np.cos(t) + 1, 1.5 * np.sin(t) - 1, h], axis=1)
    df = cloud(spark, np.vstack([ball, tube, ball[:50]])).withColumn("g", F.when(F.col("id") < 200, 0).when(F.col("id") < 400, 1))  # the last group's key is null
    together = [{r.g: r.asDict() for r in f(df, "g").collect()} for f in (fits.fit_spheres, fits.fit_cylinders)]
    monkeypatch.setattr(fits, "MAX_SELECTION", 60)
    for whole, f, g in zip(together, (fits.fit_spheres, fits.fit_cylinders), (0, 1), strict=True):
        apart = {r.g: r.asDict() for r in f(df.repartition(3).where(F.col("g").eqNullSafe(g) | F.col("g").isNull()), "g").collect()}
        assert set(apart) == {g, None}
        for k in apart:
            assert all(math.isclose(apart[k][n], whole[k][n], abs_tol=1e-5) for n in whole[k] if n != "g")


def test_leaves_cover_every_point_once(spark):
    df = cloud(spark, np.vstack([random_points(300, 6), np.full((50, 3), 0.25)]))
    cube = octree.root_cube(df)
    keyed = df.withColumn("key", octree.octree_key(cube, 6))
    nodes = octree.node_table(keyed, 6, 20)
    leaves = octree.assign_leaves(keyed, nodes, 6)
    assert leaves.count() == 350 and leaves.select("id").distinct().count() == 350
    sizes = leaves.groupBy("node_key").count().where("length(node_key) < 6")
    assert sizes.agg(F.max("count")).first()[0] <= 20  # only at the depth bound may coincident points exceed it
    assert nodes.where("level = 0").first().n == 350
    lod = octree.lod_samples(leaves, nodes, 20)
    assert lod.groupBy("node_key").count().agg(F.max("count")).first()[0] <= 20
    assert lod.where("detail_size > 0").count() > 0
    low, high = (0.2, 0.2, 0.2), (0.6, 0.7, 0.8)
    b = octree.count_bounds(nodes, cube, low, high).first()
    n = df.where(points.in_box(low, high)).count()
    assert b.lower <= n <= b.upper
    assert keyed.where(octree.box_prefixes(cube, low, high, 3) & points.in_box(low, high)).count() == n


def test_grid_reproduces_a_constant(spark):
    pts = cloud(spark, [(x / 4, y / 4, 7.0) for x in range(41) for y in range(41)])
    v = grid.grid_vertices(spark, (1, 1), (9, 9), (1, 1))
    z = [r.z for r in grid.lanczos_grid(v, pts, (1, 1)).collect()]
    assert len(z) == 81 and np.allclose(z, 7)
    sparse = grid.adaptive_grid(v, cloud(spark, [(5, 5, 3.0)]), (1, 1)).collect()
    assert len(sparse) == 81 and any(r.z is not None and math.isclose(r.z, 3) for r in sparse)
    g = grid.grid_gradient(spark.createDataFrame([(x, y, 2.0 * x) for x in range(4) for y in range(3)], "gx int, gy int, z double"), (1, 1))
    assert all(math.isclose(r.nx, -2 / math.sqrt(5)) and r.ny == 0 for r in g.collect())


def test_ground_under_and_above(spark):
    ring = [(0.5 * math.cos(t), 0.5 * math.sin(t), -2.0) for t in np.linspace(0, 2 * math.pi, 12, endpoint=False)]
    df = cloud(spark, [(0, 0, 0), *ring])
    for f in (surfaces.classify_ground, surfaces.ordered_ground):
        got = {r.qid: r.ground for r in f(df, 1.0, 0.0, 270.0).collect()}
        assert not got[0] and all(got[i] for i in range(1, 13))


def brute_ground(p, radius, tolerance, ordered):
    """Ground by all pairs, directions as the two definitions take them."""
    out = []
    for i in range(len(p)):
        dx, dy = p[:, 0] - p[i, 0], p[:, 1] - p[i, 1]
        r2, top = dx * dx + dy * dy, p[i, 2] - tolerance - radius
        hit = (r2 <= radius * radius) & ((p[:, 2] <= top) | (r2 + (p[:, 2] - top) ** 2 <= radius * radius)) & ((dx != 0) | (dy != 0))
        a = np.arctan2(dy[hit], dx[hit])
        if not len(a):
            out.append(True)
        elif ordered:
            turn = np.degrees(np.arctan2(np.sin(a - a[0]), np.cos(a - a[0])))
            out.append(bool(turn.max() - turn.min() < 270))
        else:
            a = np.unique(np.degrees(a))
            out.append(bool(360 - max(np.diff(a).max(initial=0.0), 360 - a[-1] + a[0]) < 270))
    return out


@pytest.mark.parametrize("ordered", [False, True])
def test_ground_keeps_no_pairs(spark, monkeypatch, ordered):
    """Many blocks, brute force, points without a place; and no step that moves or sorts pairs."""
    monkeypatch.setattr(blocks, "SWEPT", 40)
    p = np.vstack([np.random.default_rng(5).normal(0, 0.13, (700, 3)), np.full((9, 3), 0.2)])
    rows = [(i, *map(float, v)) for i, v in enumerate(p)] + [(len(p), None, 0.0, 0.0), (len(p) + 1, math.nan, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    out = (surfaces.ordered_ground if ordered else surfaces.classify_ground)(df, 0.15, 0.01, 270.0)
    got = {r.qid: r.ground for r in out.collect()}
    want = brute_ground(p, 0.15, 0.01, ordered)
    assert got == dict(enumerate([*want, True, True])) and 0 < sum(want) < len(p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_redshift_integral(spark):
    def plain(z):
        return sum(z / 100 / math.sqrt(0.3 * (1 + i * z / 100) ** 3 + 0.7) for i in range(100)) * 3.0e5 / 71

    for z in (0.0, 0.5, 1.0, 3.0):
        assert math.isclose(spark.range(1).select(scaled_distance(F.lit(z)).alias("d")).first().d, plain(z), abs_tol=1e-9)


def test_colours_of_the_reference(spark):
    depth = {0.0: None, -1.0: (239, 254, 255), -525.0: (0, 160, 255), -1050.0: (0, 0, 255), -1575.0: (0, 0, 64), -9999.0: (0, 0, 64), -787.5: (0, 80, 255), -1312.5: (0, 0, 159)}
    for z, want in depth.items():
        if want:
            assert tuple(spark.range(1).select(*colors.bathymetry(F.lit(z))).first()) == want
    for luma, want in ((0.0, (0, 127, 0)), (100.0, (0, 227, 0)), (127.5, (0, 255, 0)), (255.0, (127, 255, 127))):
        assert tuple(spark.range(1).select(*colors.highlight(F.lit(luma))).first()) == want
    assert tuple(spark.range(1).select(*colors.ground_colour(F.lit(100.0), F.lit(True))).first()) == (50, 33, 0)
    assert tuple(spark.range(1).select(*colors.ground_colour(F.lit(100.4), F.lit(False))).first()) == (0, 100, 0)
    for level, want in ((1, (1, 0, 0)), (3, (1, 0.5, 0)), (4, (0.5, 1, 0)), (5, (0, 1, 0)), (9, (0, 1, 0))):
        assert tuple(spark.range(1).select(*colors.category_colour(F.lit(level))).first()) == want


def brute_thin(p, ids, most):
    """Subsampling of one node as the plain loops do it."""
    left, detail = list(range(len(p))), 0.0
    while len(left) > most:
        near = {i: min(math.dist(p[i], p[j]) for j in left if j != i) for i in left}
        gone, count = set(), len(left)
        for i in sorted(left, key=lambda i: (near[i], ids[i])):
            if count <= most:
                break
            if i not in gone:
                detail = max(detail, 1.9 * near[i])
                out = {j for j in left if j != i and j not in gone and math.dist(p[i], p[j]) <= 1.9 * near[i]}
                gone |= out
                count -= len(out)
        left = [i for i in left if i not in gone]
    return left, detail


@pytest.mark.parametrize("shape", ["cube", "sheet", "clusters"])
def test_thinning_is_the_plain_loop(shape):
    p = random_points(400, 11)
    if shape == "sheet":
        p[:, 2] = 0
    if shape == "clusters":
        p = np.vstack([p[:150] * 0.001, p[150:300] + 100, np.full((20, 3), 7.0), [[1e6, 0, 0]]])
    ids = np.random.default_rng(1).permutation(len(p))
    for most in (1, 40, 300, 1000):
        kept, detail = octree.thin(p, ids, most)
        want, size = brute_thin(p.tolist(), ids.tolist(), most)
        assert sorted(kept.tolist()) == want and math.isclose(detail, size)


def test_thinning_of_a_large_group_is_bounded():
    import tracemalloc

    p = random_points(32_768, 12)
    tracemalloc.start()
    kept, _ = octree.thin(p, np.arange(len(p)), 4096)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and 0 < len(kept) <= 4096
    tracemalloc.stop()


def test_thinning_looks_at_few_pairs(monkeypatch):
    """Pairs looked at grow with the points, on a lattice with many equal coordinates."""
    looked, plain_pairs = [], octree._Places.pairs
    monkeypatch.setattr(octree._Places, "pairs", lambda *a: (looked.append(len((out := plain_pairs(*a))[0])), out)[1])
    rng, per_point = np.random.default_rng(2), []
    for n in (4000, 16000):
        looked.clear()
        octree.thin(np.stack([rng.integers(0, 4, n), rng.uniform(0, 4, n), rng.integers(0, 4, n)], axis=1).astype(float), np.arange(n), 500)
        per_point.append(sum(looked) / n)
    assert per_point[1] < 2 * per_point[0]


def lod_tree(spark, n=600):
    df = cloud(spark, np.vstack([random_points(n, 13), random_points(n, 14) * 0.1, np.full((90, 3), 0.7)])).withColumn("shade", (F.col("id") * 3).cast("int"))
    cube = (0.0, 0.0, 0.0, 1.0)
    keyed = df.withColumn("key", octree.octree_key(cube, 5))
    nodes = octree.node_table(keyed, 5, 30)
    leaves = octree.assign_leaves(keyed, nodes, 5)
    return df, cube, nodes, leaves, octree.lod_samples(leaves, nodes, 30)


def test_samples_carry_attributes_and_thin_crowded_leaves(spark):
    df, _, nodes, leaves, lod = lod_tree(spark)
    assert nodes.where("is_leaf and n > 30").count() > 0
    of = {r.id: (r.x, r.y, r.z, r.shade) for r in df.collect()}
    rows = lod.collect()
    assert rows and all((r.x, r.y, r.z, r.shade) == of[r.id] for r in rows)
    below = {}  # bottom up by the plain loop
    own = {}
    for r in leaves.collect():
        own.setdefault(r.node_key, {})[r.id] = (r.x, r.y, r.z)
    for r in nodes.where("is_leaf").collect():
        points_of = own[r.node_key]
        if r.n > 30:
            first = {}
            for i in sorted(points_of):
                first.setdefault(points_of[i], i)
            ids = sorted(first.values())
            kept, _ = brute_thin([points_of[i] for i in ids], ids, 30)
            points_of = {ids[k]: points_of[ids[k]] for k in kept}
        below[r.node_key] = (points_of, 0.0)
    for r in sorted(nodes.where("not is_leaf").collect(), key=lambda r: -r.level):
        some = {i: q for k in "01234567" if r.node_key + k in below for i, q in below[r.node_key + k][0].items()}
        ids = sorted(some)
        kept, detail = brute_thin([some[i] for i in ids], ids, 30)
        below[r.node_key] = ({ids[k]: some[ids[k]] for k in kept}, max([detail, *(below[r.node_key + k][1] for k in "01234567" if r.node_key + k in below)]))
        got = [x for x in rows if x.node_key == r.node_key]
        assert {x.id for x in got} == set(below[r.node_key][0])
        assert all(math.isclose(x.detail_size, below[r.node_key][1]) for x in got)


@pytest.mark.parametrize("focus", [None, ((0.2, 0.2, 0.2), 0.1, 2.0)])
def test_the_cut_is_the_recursion(spark, focus):
    df, cube, nodes, leaves, lod = lod_tree(spark)
    eye, view, threshold, planes = (-0.5, 0.5, 0.5), (1.0, 0.0, 0.0), 0.15, [((0.0, 1.0, 0.0), 0.2), ((0.0, -1.0, 0.3), -0.8)]
    table = {r.node_key: r for r in octree.node_boxes(nodes, cube).collect()}
    detail = {r.node_key: r.detail_size for r in lod.select("node_key", "detail_size").distinct().collect()}
    shown = {}

    def show(key):
        r = table.get(key)
        if r is None:
            return
        low, high = [r.min_x, r.min_y, r.min_z], [r[f"min_{c}"] + r.edge for c in "xyz"]
        for n, o in planes:
            if sum(a * (h if a > 0 else lo) for a, lo, h in zip(n, low, high, strict=True)) <= o:
                return
        centre, radius, weight = focus or (eye, 0, 0)
        q = [min(max(c, lo), h) for c, lo, h in zip(centre, low, high, strict=True)]
        depth = sum((a - b) * c for a, b, c in zip(q, eye, view, strict=True))
        size = detail.get(key, 0.0) / depth if depth > 0 else math.inf
        away = math.dist(q, centre) - r.edge * math.sqrt(3) / 2
        if depth > 0 and weight and away > radius:
            size *= (radius / away) ** weight
        if size >= threshold and not r.is_leaf:
            for k in "01234567":
                show(key + k)
        else:
            shown[key] = size

    show("")
    cut = octree.lod_cut(nodes, lod, cube, eye, view, threshold, planes, focus=focus)
    got = {r.node_key: r.projected for r in cut.collect()}
    assert set(got) == set(shown) and 3 < len(got) < len(table)
    assert all(math.isclose(got[k], shown[k]) for k in got)
    whole = octree.lod_cut(nodes, lod, cube, eye, view, 0.0)  # refined down to the leaves: every point is shown
    assert octree.shown_points(whole, lod, leaves).count() == df.count()
    assert [r.node_key for r in octree.coarsening_order(cut.withColumn("render_pass", F.length("node_key"))).collect()][0] == min(got, key=lambda k: (len(k), got[k], k))


def test_normals_of_samples(spark):
    _, _, _, leaves, lod = lod_tree(spark, 200)
    rng = np.random.default_rng(15)
    rows = [(r.id, *(rng.normal(size=3) * rng.random()).tolist()) for r in leaves.select("id").collect()]
    own = leaves.join(spark.createDataFrame(rows, "id long, nx double, ny double, nz double"), "id")
    got = {(r.node_key, r.id): np.array([r.nx, r.ny, r.nz]) for r in neighborhood.node_normals(own, lod).collect()}
    below = {}
    for r in own.collect():
        below.setdefault(r.node_key, []).append((r.id, np.array([r.x, r.y, r.z]), np.array([r.nx, r.ny, r.nz]), 0.0))
    samples = {}
    for r in lod.collect():
        samples.setdefault(r.node_key, []).append(r)
    assert sum(map(len, samples.values())) == len(got)
    for key in sorted(samples, key=len, reverse=True):
        children = [c for k in "01234567" for c in below.get(key + k, [])]
        for r in samples[key]:
            at = np.array([r.x, r.y, r.z])
            _, _, mine, size = next(c for c in children if c[0] == r.id)
            total = sum(n / np.linalg.norm(n) * (1 if n @ mine >= 0 else -1) for _, p, n, _ in children if ((p - at) ** 2).sum() <= (1.5 * r.detail_size) ** 2)
            want = total / np.linalg.norm(total) * (np.linalg.norm(mine) - size + r.detail_size)
            assert np.allclose(got[key, r.id], want)
            below.setdefault(key, []).append((r.id, at, want, r.detail_size))


def test_ridges_are_brute_force(spark):
    rng = np.random.default_rng(16)
    ridge = np.stack([rng.uniform(-8, 8, 60), rng.normal(0, 0.05, 60), np.full(60, 1.0)], axis=1)
    p = np.vstack([ridge, rng.uniform(-8, 8, (160, 3)) * [1, 1, 0]])
    radius = 4.0
    got = {r.qid: r.ridge for r in neighborhood.ridges(cloud(spark, p), radius).collect()}
    found = 0
    for i in range(len(p)):
        near = p[((p - p[i]) ** 2).sum(1) <= radius**2]
        centre = near.mean(axis=0)
        axes = np.linalg.eigh((near - centre).T @ (near - centre) / len(near))[1]
        n, a, b = axes[:, 0], axes[:, 2], axes[:, 1]
        n = n * (np.sign(n[2]) or 1)
        lines = []
        sides = [near[(near - centre) @ n < 0], near[(near - centre) @ n >= 0]]
        for side in sides:
            if len(side) < 2:
                lines.append((False, 0.0))
                continue
            uv = np.stack([(side - p[i]) @ a, (side - p[i]) @ b], axis=1)
            values, vectors = np.linalg.eigh(np.cov(uv.T, bias=True))
            lines.append((values[1] >= 0.75 * radius and abs(values[0]) <= 0.333 * radius, abs(vectors[:, 0] @ uv.mean(axis=0))))
        want = min(map(len, sides)) >= 2 and lines[0][0] != lines[1][0] and (lines[0][1] if lines[0][0] else lines[1][1]) <= 1.0
        assert got[i] == want
        found += want
    assert 0 < found < len(p)


def test_ridges_keep_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SWEPT", 40)
    test_ridges_are_brute_force(spark)
    rows = [(i, *map(float, v)) for i, v in enumerate(random_points(200, 3))] + [(200, None, 0.0, 0.0)]
    out = neighborhood.ridges(spark.createDataFrame(rows, "id long, x double, y double, z double").where("x is null or x < 2"), 0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(r.qid for r in out.collect()) == list(range(200))


def test_picks_end_with_the_primitives(spark):
    base = dict.fromkeys(binary.PRIMITIVE_COLUMNS)
    rows = [
        {**base, "id": 0, "prim_type": 3, "center_x": 0.0, "center_y": 0.0, "center_z": 0.0, "axis_x": 1.0, "axis_y": 0.0, "axis_z": 0.0, "length": 2.0},
        {**base, "id": 1, "prim_type": 2, "center_x": 0.0, "center_y": 0.0, "center_z": 9.0, "axis_x": 0.0, "axis_y": 0.0, "axis_z": 1.0, "length": 2.0, "radius": 1.0},
        {**base, "id": 2, "prim_type": 0, "nx": 0.0, "ny": 0.0, "nz": 1.0, "offset": 5.0, **{f"corner{i}_{c}": v for i, p in enumerate([(-1, -1, 5), (1, -1, 5), (-1, 1, 5), (1, 1, 5)]) for c, v in zip("xyz", map(float, p), strict=True)}},
    ]
    df = spark.createDataFrame([[r[n] for n in ("id", "prim_type", *binary.PRIMITIVE_COLUMNS)] for r in rows], binary.primitive_schema())
    at = lambda p: {r.id: r.d for r in df.select("id", fits.primitive_distance(p).alias("d")).collect()}
    assert math.isclose(at((4.0, 0, 4.0))[0], 5.0) and math.isclose(at((0.5, 0, 2.0))[0], 2.0)
    assert math.isclose(at((4.0, 0, 14.0))[1], 5.0)
    assert math.isclose(at((0.5, 0.5, 7.0))[2], 2.0) and math.isclose(at((2.5, 0, 5.0))[2], 3.0)  # 1.5 beyond an edge of length 2
    assert fits.pick_primitive(df, (0.0, 0.0, 2.0), 2.0).count() == 0 and fits.pick_primitive(df, (0.0, 0.0, 2.0), 2.01).first().id == 0


def test_planes_meet_as_solved(spark):
    rng = np.random.default_rng(17)
    n = rng.normal(size=(6, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    o = rng.normal(size=6)
    df = spark.createDataFrame([(i, *map(float, n[i]), float(o[i])) for i in range(6)], "id int, nx double, ny double, nz double, offset double")
    for r in fits.plane_pairs(df).collect():
        at, along = np.array([r.px, r.py, r.pz]), np.array([r.dx, r.dy, r.dz])
        assert np.allclose(n[[r.a, r.b]] @ at, o[[r.a, r.b]]) and np.allclose(n[[r.a, r.b]] @ along, 0) and abs(at @ along) < 1e-9
    assert fits.plane_pairs(df).count() == 15 and fits.plane_triples(df).count() == 20
    for r in fits.plane_triples(df).collect():
        assert np.allclose([r.x, r.y, r.z], np.linalg.solve(n[[r.a, r.b, r.c]], o[[r.a, r.b, r.c]]))
    lines = spark.createDataFrame([(7, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0)], "line int, cx double, cy double, cz double, ax double, ay double, az double")
    for r in fits.plane_line(df, lines).collect():
        assert (r.x, r.y) == (0.0, 1.0) and math.isclose(n[r.plane] @ [r.x, r.y, r.z], o[r.plane], abs_tol=1e-9)


def test_selection_and_import(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0)]).withColumns({"r": F.lit(300.0), "g": F.lit(-5.0), "b": F.lit(2.5)})
    r = points.import_points(df, (1, 2, 3), [[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]).orderBy("id").first()
    assert (r.x, r.y, r.z, r.r, r.g, r.b, r.a) == (2.0, 2.0, 3.0, 255, 0, 3, 255)


def test_text_export_keeps_coordinates(spark, tmp_path):
    """100.01234549999 has 14 digits; of 12 the sixth decimal came out one too high."""
    p = [(100.01234549999, -1.5e-12, 0.0), (1 / 3, 1e22, -123456.789012345)]
    df = cloud(spark, p).withColumns({c: F.lit(7) for c in "rgb"})
    writers.write_text(writers.text_lines(df), f"file://{tmp_path}/lines.xyzrgb")
    got = text.read_plain(spark, f"file://{tmp_path}/lines.xyzrgb", colour=True)
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == sorted(p)


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.xyzi").write_text("# c\n1 2 3 4\n\nbad line\n5 6 7 8\n")
    assert [tuple(r) for r in auto.read_points(spark, str(tmp_path / "a.xyzi")).collect()] == [(1, 2, 3, 4, 4, 4), (5, 6, 7, 8, 8, 8)]
    (tmp_path / "b.csv").write_text("h\nx,y,z\n1,2,3\n4,5,6\n7,oops,9\n10,11,12\n")
    assert auto.read_points(spark, str(tmp_path / "b.csv"), (2, 1, 0), header=2).select("x", "y", "z", "r").collect() == [(3, 2, 1, 255), (6, 5, 4, 255)]
    (tmp_path / "c.txt").write_text("2\n1 2 3\n4 5 6\n1\n7 8 9\n5\n1 1\n")
    assert text.read_blocked(spark, str(tmp_path / "c.txt")).count() == 3
    (tmp_path / "d.txt").write_text("1,2 3 9\nno\n4 5,6\n")
    assert text.read_positions(spark, str(tmp_path / "d.txt")).collect() == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "e.csv").write_text('"POINT_X","OTHER","POINT_Y","DamageID1"\n"1","q","2","3"\n')
    assert text.read_attributes(spark, str(tmp_path / "e.csv")).first() == (1, 2, 3)


def test_binary_round_trips(spark, tmp_path):
    df = cloud(spark, random_points(500, 7, 100)).withColumns({"r": F.lit(10), "g": F.lit(20), "b": F.lit(30)})
    p = np.array(sorted(tuple(r)[1:4] for r in df.collect()))
    for kind, tolerance in (("bin", 1e-5), ("binrgb", 1e-5), ("las", 6e-4)):
        path = str(tmp_path / f"a.{kind}")
        writers.write_las(df, path) if kind == "las" else writers.write_bin(df, path, colour=kind == "binrgb")
        got = np.array(sorted(tuple(r)[:3] for r in auto.read_points(spark, path).collect()))
        assert np.allclose(got, p, atol=tolerance)
    assert binary.read_records(spark, str(tmp_path / "a.las"), "las", classes=2).count() == 0
    (tmp_path / "broken.las").write_bytes(b"NOPE" + bytes(300))
    assert auto.read_points(spark, str(tmp_path / "broken.las")).count() == 0
    assert binary.read_records(spark, str(tmp_path / "a.binrgb"), "binrgb").first().g == 20


def test_ply_files(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    rows = [(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)]
    (tmp_path / "a.ply").write_text(head.format("ascii") + "".join(" ".join(map(str, r)) + "\n" for r in rows))
    for order, name in (("<", "little"), (">", "big")):
        (tmp_path / f"{name}.ply").write_bytes(head.format(f"binary_{name}_endian").encode() + b"".join(struct.pack(order + "3f3B", *r) for r in rows))
    for name in ("a", "little", "big"):
        assert sorted(map(tuple, auto.read_points(spark, str(tmp_path / f"{name}.ply")).collect())) == rows


def test_octree_primitives_and_offset_files(spark, tmp_path):
    pts = b"".join(struct.pack("<3f4B", i, 0, 0, 1, 2, 3, 255) for i in range(5))
    (tmp_path / "tree").mkdir()
    leaf = lambda n, at: struct.pack("<QfIQ", 0, 0, n, at)
    (tmp_path / "tree/Index").write_bytes(bytes(28) + struct.pack("<QfIQ", 52, 1, 2, 0) + leaf(2, 0) + leaf(3, 2) + leaf(0, 0) * 6)
    (tmp_path / "tree/Points").write_bytes(struct.pack("<I", 16) + pts)
    assert sorted(r.x for r in auto.read_points(spark, str(tmp_path / "tree")).collect()) == [0, 1, 2, 3, 4]
    planes = spark.createDataFrame([{"id": 0, "prim_type": 4, "center_x": 1.0, "center_y": 2.0, "center_z": 3.0}, {"id": 1, "prim_type": 1, "n_points": 9, "rms": 0.5, "center_x": 0.0, "center_y": 0.0, "center_z": 0.0, "radius": 2.0}], binary.primitive_schema())
    path = str(tmp_path / "p.bin")
    assert writers.write_primitives(planes, path) == 2
    assert binary.read_primitives(spark, path).collect() == planes.collect()
    assert fits.pick_primitive(binary.read_primitives(spark, path), (1.9, 0, 0), 0.5).first().id == 1
    writers.write_offset((1, 2, 3), str(tmp_path / "o"))
    assert binary.read_offset(str(tmp_path / "o")) == (1, 2, 3)
    g = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.5)], "gx int, gy int, z double")
    writers.write_bil(g, (2, 2), (0, 0), (1, 1), str(tmp_path / "g.bil"))
    assert np.frombuffer((tmp_path / "g.bil").read_bytes(), "<u4").tolist() == [0, 2500, 1000, 0]


def test_large_las_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "LAS_MOST", 100)
    df = cloud(spark, random_points(300, 18, 10))
    writers.write_las(df.repartition(3), str(tmp_path / "large.las"))
    raw = (tmp_path / "large.las").read_bytes()
    assert raw[24:26] == b"\1\4" and struct.unpack_from("<Q", raw, 247) == (300,) and len(raw) == 375 + 300 * 20
    got = np.array([tuple(r)[:3] for r in auto.read_points(spark, str(tmp_path / "large.las")).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(np.array([tuple(r)[1:4] for r in df.collect()]), axis=0), atol=6e-4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["large.las"]  # no parts stay


def test_images_with_world_files(spark, tmp_path):
    import zlib

    def png(path, pixels):
        h, w, _ = pixels.shape
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + r.tobytes() for r in pixels)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))

    pixels = np.random.default_rng(19).integers(0, 256, (6, 8, 3), dtype=np.uint8)
    png(tmp_path / "a.png", pixels)
    (tmp_path / "a.tfw").write_text("2.0\n0.0\n0.0\n-2.0\n100.0\n50.0\n")
    images, px = binary.read_images(spark, [str(tmp_path / "a.png")])
    i = images.first()
    assert (i.a, i.d, i.b, i.e, i.c, i.f, i.width, i.height) == (2.0, 0.0, 0.0, -2.0, 100.0, 50.0, 8, 6)
    assert all(tuple(pixels[r["row"], r["col"]]) == (r.r, r.g, r.b) for r in px.collect()) and px.count() == 48
    df = cloud(spark, [(104.0, 46.0, 0.0), (103.0, 46.0, 0.0), (0.0, 0.0, 0.0)]).withColumns({c: F.lit(1).cast("short") for c in "rgb"})
    got = {r.id: (r.img_id, r.r, r.g, r.b) for r in surfaces.raster_colour(df, images, px).collect()}
    assert got[0] == (0, *map(int, pixels[2, 2])) and got[2] == (None, 1, 1, 1)
    assert got[1] == (0, *[math.floor((int(pixels[2, 1][k]) + int(pixels[2, 2][k])) / 2 + 0.5) for k in range(3)])


def test_quality_pictures(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 1.0), (1, 2, 4.0), (2, 0, None)], "gx int, gy int, w double")
    writers.write_pgm(g, (3, 4), "w", str(tmp_path / "q.pgm"))
    raw = (tmp_path / "q.pgm").read_bytes()
    assert raw == b"P5\n3 4\n255\n" + bytes([0, 0, 0, 0, 255, 0, 0, 0, 0, 64, 0, 0])


def test_batches_are_only_ever_bounded_further(spark):
    from terravox.plans.storage import bound_batches

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {n: spark.conf.get(n) for n in (rows, size)}
    try:
        for given, want in (("64m", str(8 << 20)), ("1m", "1m"), ("67108864b", str(8 << 20)), ("4096", "4096")):
            spark.conf.set(rows, "500")
            spark.conf.set(size, given)
            bound_batches(spark)
            assert spark.conf.get(rows) == "500" and spark.conf.get(size).removesuffix("b") in (want, str((1 << 20)) if given == "1m" else want)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
