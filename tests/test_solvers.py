"""Solves against numpy, and manufactured solutions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeweave.operators import solvers


def square(spark, n=9, share=0.5):
    """A grid on [-1, 1]^2 with ghosts share * h outside the boundary."""
    h, rows, ghosts = 2 / (n - 1), [], []
    for i in range(n):
        for j in range(n):
            x, k = [-1 + i * h, -1 + j * h], n * i + j
            v = [float(round(c)) if abs(abs(c) - 1) < 1e-12 else 0.0 for c in x]
            size = math.hypot(*v)
            if size:
                nu = [c / size for c in v]
                rows.append((k, x, "boundary", nu, None))
                ghosts.append((1000 + k, [c + share * h * m for c, m in zip(x, nu)], "ghost", None, k))
            else:
                rows.append((k, x, "interior", None, None))
    return spark.createDataFrame(rows + ghosts, "id long, pos array<double>, kind string, normal array<double>, owner long")


def errors(nodes, got, exact):
    rows = nodes.where("kind <> 'ghost'").join(got, "id").select((F.col("v") - exact(F.col("pos"))).alias("e"))
    return rows.agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0]


@pytest.mark.parametrize("way", [solvers.dense_solve, solvers.bicgstab, lambda a, b: solvers.gmres(a, b, 1e-10, restart=8)], ids=["dense", "bicgstab", "gmres"])
def test_solve_is_numpys(spark, way):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4) + 9 * np.eye(12)
    b = rng.normal(size=12)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12) if m[i, j]], "row long, col long, val double")
    got = way(a, spark.createDataFrame([(k, float(x)) for k, x in enumerate(b)], "id long, v double")).orderBy("id").collect()
    assert [r.v for r in got] == pytest.approx(np.linalg.solve(m, b).tolist(), rel=1e-7, abs=1e-9)


def test_solves_of_nothing(spark):
    a, b = spark.createDataFrame([], "row long, col long, val double"), spark.createDataFrame([], "id long, v double")
    assert solvers.dense_solve(a, b).collect() == [] and solvers.bicgstab(a, b).collect() == []


def test_poisson(spark):
    nodes = square(spark)
    exact = lambda p: F.exp(p[0] + 0.35 * p[1])
    got = solvers.poisson(nodes, lambda p: -(1 + 0.35**2) * exact(p), lambda p, n: exact(p), width=0.8)
    assert errors(nodes, got, exact) < 1e-3


def test_diffusion_is_exact_for_what_is_linear_in_time(spark):
    nodes = square(spark, 7)
    parts = solvers.assembled(nodes, 2, 2, 0.9)
    level = lambda t: nodes.where("kind <> 'ghost'").select("id", (F.col("pos")[0] + t).alias("v"))
    got = solvers.diffusion_step(nodes, parts, [level(0.1), level(0.0)], 0.1, 0.5, lambda p: F.lit(1.0), lambda p, n: p[0] + 0.2)
    assert errors(nodes, got, lambda p: p[0] + 0.2) < 1e-9


def test_many_sides_at_once(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(9, 9))
    m = m @ m.T + 30 * np.eye(9)
    b = rng.normal(size=(9, 3))
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(9)], "row long, col long, val double")
    want = np.linalg.solve(m, b)
    got = solvers.conjugate_gradients(a, spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(b)], "id long, y array<double>")).orderBy("id").collect()
    assert np.array([r.y for r in got]) == pytest.approx(want, abs=1e-9)
    sides = spark.createDataFrame([(k, r, float(b[k, r])) for k in range(9) for r in range(3)], "id long, rhs long, v double")
    got = {(r.id, r.rhs): r.v for r in solvers.dense_solve(a, sides).collect()}
    assert all(got[k, r] == pytest.approx(want[k, r], abs=1e-10) for k in range(9) for r in range(3))


def test_entries_without_a_side_are_refused(spark):
    b = spark.createDataFrame([(0, 1.0), (2, 1.0)], "id long, v double")
    for stray, ways in (((1, 0), (solvers.dense_solve, solvers.bicgstab, solvers.gmres)), ((0, 1), (solvers.dense_solve,)), ((3, 3), (solvers.bicgstab,))):
        a = spark.createDataFrame([(0, 0, 1.0), (2, 2, 1.0), (*stray, 5.0)], "row long, col long, val double")
        for way in ways:
            with pytest.raises(ValueError):
                way(a, b).collect()


def test_accepted(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0), (1, 0, 1.0)], "row long, col long, val double")
    b = spark.createDataFrame([(0, 2.0), (1, 5.0)], "id long, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 1.0)], "id long, v double")
    assert [r.v for r in solvers.accepted(a, x, b).collect()] == [1.0, 1.0]
    assert all(math.isnan(r.v) for r in solvers.accepted(a, x.withColumn("v", F.col("v") * 1.001), b).collect())


PARABOLA = lambda p: p[0] * p[0] + p[1] * p[1]


def largest(nodes, got, exact):
    return nodes.where("kind <> 'ghost'").join(got, "id").agg(F.max(F.abs(F.col("v") - exact(F.col("pos"))))).first()[0]


def test_pure_neumann(spark):
    nodes = square(spark, 7)
    zero = solvers.poisson(nodes, lambda p: F.lit(0.0), lambda p, n: F.lit(0.0), dirichlet=0.0, neumann=1.0)
    assert zero.count() == nodes.count() and zero.agg(F.max(F.abs("v"))).first()[0] < 1e-8
    tilted = solvers.poisson(nodes, lambda p: F.lit(0.0), lambda p, n: n[0] + 2 * n[1], dirichlet=0.0, neumann=1.0)
    assert largest(nodes, tilted, lambda p: p[0] + 2 * p[1]) < 1e-8


def test_variable_poisson(spark):
    nodes = square(spark, 7)
    got = solvers.variable_poisson(nodes, lambda p: -4 - 1.2 * p[0], lambda p: 1 + 0.2 * p[0], lambda p, n: PARABOLA(p))
    assert largest(nodes, got, PARABOLA) < 1e-6


def test_nonlinear_poisson(spark):
    nodes = square(spark, 7)
    got, rounds, change = solvers.nonlinear_poisson(nodes, lambda p, u: -4 - 0.8 * u, lambda p, u: 1 + 0.1 * u, lambda p, n: PARABOLA(p), tolerance=1e-7)
    assert largest(nodes, got, PARABOLA) < 1e-5 and rounds > 1 and change <= 1e-7


def test_march_rises_to_order_three(spark):
    """A solution that is cubic in time and square in space: exact at full order from exact levels, near from one level."""
    nodes, nu, dt = square(spark, 7), 0.25, 0.1
    exact = lambda t: lambda p: (1 + t) ** 3 + PARABOLA(p)
    level = lambda t: nodes.where("kind <> 'ghost'").select("id", exact(t)(F.col("pos")).alias("v"))
    run = lambda **k: solvers.march(nodes, exact(0.0), dt, 2, nu, lambda t, p: F.lit(3 * (1 + t) ** 2 - 4 * nu), lambda t, p, n: exact(t)(p), **k)
    assert largest(nodes, run(past=[level(-dt), level(-2 * dt)]), exact(2 * dt)) < 1e-8
    assert 1e-6 < largest(nodes, run(), exact(2 * dt)) < 0.1


def test_advection_and_reaction(spark):
    """u = (1 + t) (x + 2 y) with velocity (1, -1) and a reaction -u: all three terms are linear in time, so order 2 is exact."""
    nodes, dt = square(spark, 7), 0.1
    exact = lambda t: lambda p: (1 + t) * (p[0] + 2 * p[1])
    forcing = lambda t, p: (p[0] + 2 * p[1]) + (1 + t) * (1 - 2) + exact(t)(p)
    before = nodes.where("kind <> 'ghost'").select("id", exact(-dt)(F.col("pos")).alias("v"))
    got = solvers.march(nodes, exact(0.0), dt, 2, 0.3, forcing, lambda t, p, n: exact(t)(p), order=2, reaction=lambda t, p, u: -u, velocity=lambda t, p: [F.lit(1.0), F.lit(-1.0)], past=[before])
    assert largest(nodes, got, exact(2 * dt)) < 1e-8
