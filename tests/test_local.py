"""Patches, divergence-free fits, level sets, node sets, moving boundaries and stability, by plain code or exact fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeweave.functions import stability
from nodeweave.operators import boundaries, divfree, levelsets, partition, sampling, solvers, stencils

POINTS = "id long, pos array<double>"


def grid(spark, n=7, kinds=False):
    rows = []
    for i in range(n):
        for j in range(n):
            edge = i in (0, n - 1) or j in (0, n - 1)
            rows.append((n * i + j, [i / (n - 1), j / (n - 1)], "boundary" if edge else "interior"))
    g = spark.createDataFrame(rows, POINTS + ", kind string")
    return g if kinds else g.select("id", "pos")


def by_id(df, value="v"):
    return {r["id"]: r[value] for r in df.collect()}


def test_rules_and_iterated_laplacian():
    assert stencils.accuracy_rule(2, 2, 2) == {"ell": 3, "n": 20, "phs": 5} and stencils.accuracy_rule(2, 1, 2, wls=True) == {"ell": 2, "n": 9, "phs": 3}
    rule = stencils.hyperviscosity_rule(2, 2)
    assert rule == {"ell": 3, "n": 21, "phs": 5}
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, rule["n"], 2))
    w = stencils.rbf_weights(x, x[:, 0], rule["ell"], rule["phs"], ["hyp2"])["hyp2"][0]
    for p in stencils.exponents(2, 3):
        assert abs((w * x[0, :, 0] ** p[0] * x[0, :, 1] ** p[1]).sum()) < 1e-7 * np.abs(w).sum()
    at = rng.normal(size=(4, 2)) / 3
    many = stencils.cardinal(x[0], at, 2, 3, ["interp", "lap", "d1"])
    f = lambda y: 1 + y[..., 0] * y[..., 1] + 2 * y[..., 1] ** 2
    assert many["interp"] @ f(x[0]) == pytest.approx(f(at)) and many["lap"] @ f(x[0]) == pytest.approx([4.0] * 4) and many["d1"] @ f(x[0]) == pytest.approx(at[:, 0] + 4 * at[:, 1])
    assert np.isnan(stencils.cardinal(x[0, :3], at, 2, 3, ["interp"])["interp"]).all()


def test_unity_weights_and_operator(spark):
    g = grid(spark)
    centers = spark.createDataFrame([(0, [0.2, 0.2]), (1, [0.2, 0.8]), (2, [0.8, 0.2]), (3, [0.8, 0.8])], POINTS)
    far = spark.createDataFrame([(100, [3.0, 0.9]), (101, [0.5, 0.5]), (102, [0.21, 0.2])], POINTS)
    w = {}
    for r in partition.unity_weights(far, centers, 0.6, 2).collect():
        w.setdefault(r.q, {})[r.p] = r.w
    assert w[100] == {3: 1.0} and all(sum(x.values()) == pytest.approx(1) for x in w.values())
    assert w[101] == pytest.approx({k: 0.25 for k in range(4)})
    ops = partition.unity_operator(far.where("id > 100"), g, centers, 0.6, 2, ["interp", "lap"]).collect()
    pos = by_id(g, "pos")
    f = lambda p: 2 + p[0] ** 3 - p[0] * p[1] ** 2
    for key, at in ((101, (0.5, 0.5)), (102, (0.21, 0.2))):
        assert sum(r.interp * f(pos[r.col]) for r in ops if r.row == key) == pytest.approx(f(at), abs=1e-9)
        assert sum(r.lap * f(pos[r.col]) for r in ops if r.row == key) == pytest.approx(4 * at[0], abs=1e-7)
    assert partition.unity_operator(far.limit(0), g, centers, 0.6, 2, ["interp"]).count() == 0
    kept = []
    for key, p in sorted(pos.items()):
        if all(math.dist(p, pos[m]) > 0.5 for m in kept):
            kept.append(key)
    assert sorted(r.id for r in partition.patch_centers(g, 0.5, 2).collect()) == kept


def test_transport_and_diffusion_are_exact_on_quadratics(spark):
    g = grid(spark, kinds=True)
    centers = spark.createDataFrame([(0, [0.25, 0.25]), (1, [0.25, 0.75]), (2, [0.75, 0.25]), (3, [0.75, 0.75])], POINTS)
    u = lambda x, y, t: x * x + 2 * y * y + 6 * t  # noqa: E731  (nu = 1: its Laplacian is 6)
    at = lambda p, t: u(p[0], p[1], t)
    start = g.select("id", at(F.col("pos"), 0.0).alias("v"))
    got = by_id(partition.march(g, start, centers, 0.7, 2, 0.1, 2, 1.0, lambda t, p: F.lit(0.0), lambda t, p: at(p, t)))
    assert got == pytest.approx({k: u(*p, 0.2) for k, p in by_id(g, "pos").items()}, abs=1e-8)
    moved = partition.transported(g, start, centers, 0.7, 2, 0.05, 0.05, lambda t, p: [F.lit(1.0), F.lit(-0.5)], inside=lambda p: (p[0] >= 0) & (p[1] <= 1), inflow=lambda p: at(p, 0.0))
    assert by_id(moved) == pytest.approx({k: u(p[0] - 0.05, p[1] + 0.025, 0) for k, p in by_id(g, "pos").items()}, abs=1e-8)


def test_divergence_free_fits(spark):
    rng = np.random.default_rng(5)
    for dim, field in ((2, lambda p: [p[1] ** 2 + 1, p[0] ** 2 - 3]), (3, lambda p: [p[1] * p[2], p[0] ** 2, p[0] * p[1] - 1])):
        x = rng.random((60, dim))
        nodes = spark.createDataFrame([(k, p.tolist(), [float(c) for c in field(p)]) for k, p in enumerate(x)], POINTS + ", u array<double>")
        asked = rng.random((4, dim)) / 2 + 0.25
        got = by_id(divfree.local_fields(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(asked)], POINTS), nodes, 30, dim), "u")
        for k, p in enumerate(asked):
            assert got[k] == pytest.approx(field(p), abs=1e-7)
    wild = spark.createDataFrame([(k, p.tolist(), rng.normal(size=2).tolist()) for k, p in enumerate(rng.random((25, 2)))], POINTS + ", u array<double>")
    at_nodes = by_id(divfree.local_fields(wild.where("id < 3"), wild, 12, 2, degree=1), "u")
    for r in wild.where("id < 3").collect():
        assert at_nodes[r.id] == pytest.approx(r.u, abs=1e-6)
    few = divfree.local_fields(wild.where("id < 1"), wild, 2, 2).first().u
    assert few == pytest.approx(wild.where("id < 1").first().u, abs=1e-6)
    assert divfree.local_fields(wild.limit(0), wild, 2, 2).count() == 0


def test_matrix_kernels(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    y[0] = x[0]
    pairs = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    want = divfree.gram(x, y, 5)
    parts = divfree.mixture(3.0, 2)

    def f(d):  # the scalar mixture, normalised
        r = np.sqrt((d * d).sum())
        return sum(w * (3 + 3 * e * r + (e * r) ** 2) * math.exp(-e * r) for e, w in parts) / (2 * sum(w * e * e for e, w in parts))

    for r in divfree.phs_entries(pairs, 5, 3).collect():
        assert [r[f"k{a}{b}"] for a in range(3) for b in range(3)] == pytest.approx([want[6 * a + r.id, 6 * b + r.id] for a in range(3) for b in range(3)], abs=1e-9)
    for r in divfree.matern_entries(pairs, parts, 3).collect():
        if r.id == 0:
            assert [r[f"k{a}{b}"] for a in range(3) for b in range(3)] == pytest.approx(np.eye(3).ravel().tolist())
            continue
        d, h, e = x[r.id] - y[r.id], 1e-4, np.eye(3)
        second = lambda a, b: (f(d + h * e[a] + h * e[b]) - f(d + h * e[a] - h * e[b]) - f(d - h * e[a] + h * e[b]) + f(d - h * e[a] - h * e[b])) / (4 * h * h)  # noqa: E731, B023
        lap = sum(second(a, a) for a in range(3))
        assert [r[f"k{a}{b}"] for a in range(3) for b in range(3)] == pytest.approx([second(a, b) - (lap if a == b else 0) for a in range(3) for b in range(3)], abs=1e-5)
    with pytest.raises(ValueError):
        divfree.phs_entries(pairs, 4, 3)


def test_level_set_of_a_circle(spark):
    n = 60
    marks = [(k, [math.cos(t), math.sin(t)], [math.cos(t), math.sin(t)]) for k, t in enumerate(2 * math.pi * k / n for k in range(n))]
    m = spark.createDataFrame(marks, POINTS + ", normal array<double>")
    q = spark.createDataFrame([(k, [r * math.cos(t), r * math.sin(t)]) for k, (r, t) in enumerate([(0.95, 0.3), (1.04, 2.0), (1.0, 4.0), (0.92, 5.5)])], POINTS)
    for r in levelsets.evaluated(q, m, 0.1, 2, 20).join(q, "id").collect():
        size = math.hypot(*r.pos)
        assert r.phi == pytest.approx(1 - size, abs=1e-3) and r.g == pytest.approx([-c / size for c in r.pos], abs=0.03)
    for r in levelsets.projected(q, m, 0.1, 2, 20, rounds=2).collect():
        assert math.hypot(*r.pos) == pytest.approx(1, abs=1e-3)


def test_sight_and_neighbours_behind_a_wall(spark):
    phi = lambda p: F.greatest(F.abs(p[0]) - 0.05, p[1] - 0.5)  # noqa: E731  (a wall about x = 0 below y = 0.5)
    s = spark.createDataFrame([(0, [-0.1, 0.0], [0.1, 0.0]), (1, [-0.1, 0.0], [-0.9, 0.2]), (2, [-0.2, 0.7], [0.2, 0.7]), (3, [0.0, 0.0], [0.5, 0.0]), (4, [-0.3, 0.3], [0.3, 0.4])], "id long, a array<double>, b array<double>")
    assert by_id(levelsets.visible(s, phi, 2, 0.1, lipschitz=1.0), "visible") == {0: False, 1: True, 2: True, 3: False, 4: False}
    pts = [[-0.1, 0.0], [0.1, 0.0], [-0.1, 0.3], [-0.45, 0.0], [-0.1, 0.58], [0.1, 0.56], [0.12, -0.3], [-0.6, 0.4]]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(pts)], POINTS)
    got = {r["rank"]: (r["p"], r["d"]) for r in levelsets.wall_knn(p.where("id = 0"), p, 4, 2, phi, 0.1, lipschitz=1.0, wide=2).collect()}
    # 4 and 5 are beyond the wall's top; 5 can be seen from 4, which lies near the wall
    assert [got[k][0] for k in (1, 2, 3, 4)] == [0, 2, 3, 4] and got[4][1] == pytest.approx(0.58)
    six = {r["rank"]: (r["p"], r["d"]) for r in levelsets.wall_knn(p.where("id = 0"), p, 6, 2, phi, 0.1, lipschitz=1.0, wide=2).collect()}
    assert six[5][0] == 7 and six[6][0] == 5 and six[6][1] == pytest.approx(0.58 + math.hypot(0.2, 0.02))


def test_node_sets(spark):
    rng = np.random.default_rng(3)
    x = rng.random((70, 2))
    p = spark.createDataFrame([(k, a.tolist(), float(k % 3)) for k, a in enumerate(x)], POINTS + ", flag double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = (np.where(d <= 0.3, (1 - np.minimum(d, 0.3) / 0.3) ** 8, 0) * ~np.eye(70, dtype=bool)).sum(1)
    assert by_id(sampling.crowding(p, 0.15, 2), "weight") == pytest.approx(dict(enumerate(w)))

    def first_come(order, clash):
        out = []
        for k in order:
            if not any(clash(d[k, m]) for m in out):
                out.append(k)
        return sorted(out)

    assert sorted(r.id for r in sampling.eliminated(p, 0.15, 2).collect()) == first_come(sorted(range(70), key=lambda k: (-w[k], k)), lambda v: v <= 0.15)
    assert sorted(r.id for r in sampling.spaced(p, 0.15, 2).collect()) == first_come(sorted(range(70), key=lambda k: (-(k % 3), k)), lambda v: v < 0.15 * (1 - 1e-12))
    fixed = spark.createDataFrame([(0, [0.5, 0.5], 0.3)], POINTS + ", radius double")
    got = sampling.variable_disks(spark, lambda q: 0.08 + 0.1 * q[0], 0.08, 0.3, [0.0, 0.0], [1.0, 1.0], 7, passes=2, fixed=fixed).collect()
    y, r = np.array([g.pos for g in got]), np.array([g.radius for g in got])
    near = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) + 9 * np.eye(len(y))
    assert len(got) > 20 and (near >= np.maximum(r[:, None], r[None])).all() and (np.sqrt(((y - 0.5) ** 2).sum(-1)) >= 0.3).all() and r == pytest.approx(0.08 + 0.1 * y[:, 0])


def test_lattice_shells_and_seams(spark):
    lattice = {(r.x, r.y) for r in sampling.annulus_lattice(spark, 0.0, 1.0, 0.25, center=True).collect()}
    y = np.array(sorted(lattice - {(0.0, 0.0)}))
    assert (0.0, 0.0) in lattice and (np.hypot(*y.T) < 1).all() and len(y) == pytest.approx(math.pi / (0.25**2 * math.sqrt(3) / 2), rel=0.15)
    near = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)) + 9 * np.eye(len(y))
    assert near.min() == pytest.approx(0.25) and sampling.shell_offsets(0.2, 0.1, 0.1) == []
    n = 200
    ring = spark.createDataFrame([(k, math.cos(t), math.sin(t), math.cos(t), math.sin(t)) for k, t in enumerate(2 * math.pi * k / n for k in range(n))], "seq long, x double, y double, nx double, ny double")
    at = sampling.shell_offsets(0.05, 0.3, 0.1)
    assert at == pytest.approx([0.051, 0.151, 0.251, 0.3])
    layers = {}
    for r in sampling.shells(ring, 0.05, 0.3, 0.1).collect():
        layers.setdefault(r.layer, []).append(math.hypot(r.x, r.y))
    assert {k: len(v) for k, v in layers.items()} == {k: int(2 * n * math.sin(math.pi / n) * (1 - e) / 0.1) for k, e in enumerate(at)}
    assert all(v == pytest.approx([1 - at[k]] * len(v), abs=1e-3) for k, v in layers.items())
    s = 1 / math.sqrt(2)
    loops = [(0, 0, [0.0, 0.0], [0.0, 1.0]), (1, 1, [0.0, 0.0005], [1.0, 0.0]), (2, 0, [1.0, 0.0], [0.0, 1.0]), (3, 1, [1.0, 0.0], [0.001, 1.0]), (4, 1, [5.0, 0.0], [1.0, 0.0]), (5, 0, [9.0, 0.0], [0.0, 1.0]), (6, 1, [9.0, 0.0], [0.0, -1.0])]
    sites = spark.createDataFrame([(10, [0.0, 0.0]), (11, [1.0, 0.0]), (12, [5.0, 0.0]), (13, [9.0, 0.0])], POINTS)
    got = {r.id: (r.normal, r.priority) for r in sampling.seams(sites, spark.createDataFrame(loops, "id long, piece long, pos array<double>, normal array<double>"), 0.1, 2).collect()}
    assert set(got) == {10, 13} and got[10] == (pytest.approx([s, s]), 1) and got[13] == (None, 1)


def test_moving_boundaries(spark):
    ellipse = lambda a, b, n=24: spark.createDataFrame([(k, [a * math.cos(t), b * math.sin(t)]) for k, t in enumerate(-math.pi + 2 * math.pi * k / n for k in range(n))], POINTS)
    curve = boundaries.ClosedBoundary(ellipse(1, 1), 2)
    for r in curve.samples(ellipse(2, 1), 50).collect():
        assert (r.pos[0] / 2) ** 2 + r.pos[1] ** 2 == pytest.approx(1, abs=1e-3)
        want = np.array([r.pos[0] / 4, r.pos[1]])
        assert r.normal == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=0.02)
    x = np.array([r.pos for r in curve.spaced(ellipse(2, 1), 0.3).collect()])
    assert len(x) > 20 and (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + 9 * np.eye(len(x))).min() > 0.9 * 0.3
    n = 80
    z = 1 - 2 * (np.arange(n) + 0.5) / n
    turn = math.pi * (math.sqrt(5) - 1) * np.arange(n)
    seeds = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)
    ball = spark.createDataFrame([(k, (2 * p).tolist()) for k, p in enumerate(seeds)], POINTS)
    for r in boundaries.ClosedBoundary(ball, 3).samples(ball, 40).collect():
        p = np.array(r.pos)
        assert np.linalg.norm(p) == pytest.approx(2, abs=5e-3) and r.normal == pytest.approx((p / 2).tolist(), abs=0.03)
    with pytest.raises(ValueError):
        curve.samples(ellipse(1, 1, 20), 5)


def test_stability(spark):
    modes = [(k, zi, ze) for k, (zi, ze) in enumerate([(-1.0, -0.1), (-0.1, -3.0), (-50.0, 0.0), (0.5, 0.0), (-2.0, 1.0), (-0.01, -0.6), (-3.0, -3.5)])]
    m = spark.createDataFrame(modes, "id long, zi double, ze double")
    growth = by_id(stability.sbdf3_growth(m), "growth")
    assert growth == pytest.approx({k: max(abs(np.roots([11 - 6 * zi, -18 - 18 * ze, 9 + 18 * ze, -2 - 6 * ze]))) for k, zi, ze in modes})
    assert by_id(m.select("id", stability.sbdf3_stable(F.col("zi"), F.col("ze")).alias("s")), "s") == {k: g < 1 for k, g in growth.items()}
    step = stability.largest_stable_step([-4.0, -100.0], 0.0, -1.0, 2, 1.0)  # explicit decay -value^2
    c = lambda dt: max(abs(np.roots([11, -18 + 18 * dt * 1e4, 9 - 18 * dt * 1e4, -2 + 6 * dt * 1e4])))
    assert 0 < step < 1 and c(0.99 * step) <= 1 and c(1.01 * step) > 1
    for ell, eta, power in ((-0.3, 0.7, 2), (-0.3, 0.01, 3), (0.4, -0.2, 4), (-1.0, 2.0, 5)):
        poly = np.array([1.0])
        for f in stability.power_factors(ell, eta, power):
            poly = np.polynomial.polynomial.polymul(poly, [1, -2 * f.real, abs(f) ** 2] if f.imag else [1, -f.real])
        want = np.zeros(power + 1)
        want[[0, 1, power]] = 1, ell, eta
        assert poly == pytest.approx(want, abs=1e-10)


def test_factored_solve_and_eigenvalues(spark):
    m = np.diag([-4.0, -3.0, -2.5, -2.0]) + np.diag([1.0, 0.5, 0.25], 1) + np.diag([1.0, 0.5, 0.25], -1)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(4) if m[i, j]], "row long, col long, val double")
    b = spark.createDataFrame([(k, float(k + 1)) for k in range(4)], "id long, v double")
    got = by_id(solvers.factored_solve(a, b, -0.1, 0.05, 2))
    want = np.linalg.solve(np.eye(4) - 0.1 * m + 0.05 * m @ m, np.arange(1.0, 5))
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-10)
    assert sorted(solvers.arnoldi(a, b, 4).real) == pytest.approx(sorted(np.linalg.eigvalsh(m)), abs=1e-8)
