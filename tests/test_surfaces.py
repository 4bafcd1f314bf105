"""Operators on spheres against their known eigenvalues, and steps on them."""

import math

import pytest
from pyspark.sql import functions as F

from nodeweave.operators import series, spatial, stencils, surfaces


@pytest.fixture(scope="module")
def ball(spark):
    s = surfaces.sphere(spark, 300)
    return s, surfaces.operators(s, 4)


def field(s, f):
    return s.select("id", f(F.col("pos")).alias("v"))


def off(s, got, want):
    return s.join(got, "id").agg(F.max(F.abs(F.col("v") - want(F.col("pos"))))).first()[0]


def test_operators_on_a_sphere(ball):
    s, ops = ball
    assert off(s, surfaces.laplacian(ops, field(s, lambda p: p[2])), lambda p: -2 * p[2]) < 2e-2
    g = surfaces.gradient(ops, field(s, lambda p: p[2]))
    for c, want in (("x", lambda p: -p[2] * p[0]), ("z", lambda p: 1 - p[2] * p[2])):
        assert off(s, g.select("id", F.col(c).alias("v")), want) < 1e-2
    assert off(s, surfaces.divergence(ops, g), lambda p: -2 * p[2]) < 5e-2
    h = series.rms_components(surfaces.curvature(ops, s), ["x", "y", "z"]).first()
    assert sum(x * x for x in h) == pytest.approx(4, rel=2e-2)


def test_shrinking_and_heat(spark, ball):
    s, ops = ball
    small = surfaces.curvature_flow_step(s, 0.05)
    r = small.select(F.sqrt(sum(F.col("pos")[k] * F.col("pos")[k] for k in range(3))).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert r[0] == pytest.approx(1 / 1.1, rel=5e-3) and r[1] == pytest.approx(1 / 1.1, rel=5e-3)
    warm = surfaces.adr_step(s, ops, [field(s, lambda p: p[2])], 0.1, 0.5, weights=field(s, lambda p: F.lit(4 * math.pi / 300)), mass=0.0)
    assert off(s, warm, lambda p: p[2] / 1.1) < 1e-2
    fed = surfaces.adr_step(s, ops, [field(s, lambda p: F.lit(2.0))], 0.1, 0.5, rates=[field(s, lambda p: F.lit(3.0))])
    assert off(s, fed, lambda p: F.lit(2.3)) < 1e-8


def test_transfer_and_motion(spark, ball):
    s, _ = ball
    other = surfaces.sphere(spark, 120)
    assert off(other, surfaces.transfer(s, field(s, lambda p: p[0] * p[2]), other), lambda p: p[0] * p[2]) < 1e-2
    turned = surfaces.moved(s, lambda t, p: [-p[1], p[0], F.lit(0.0)], 0.0, 0.1)
    want = s.select("id", (F.col("pos")[0] * math.cos(0.1) - F.col("pos")[1] * math.sin(0.1)).alias("w"))
    assert turned.join(want, "id").agg(F.max(F.abs(F.col("pos")[0] - F.col("w")))).first()[0] < 1e-6
    q = spatial.point_quality(s, 3).first().quality
    assert 1 < q < 2 and surfaces.needs_remap(s, q - 0.01).first().remap and not surfaces.needs_remap(s, q + 0.01).first().remap


def test_tangent_frames():
    import numpy as np

    n = np.array([[0, 0, 2.0], [1, 0, 0], [0, -3, 0], [1, 2, -2], [-5, 1, 1]])
    a, b = stencils.tangent_frames(n)
    unit = n / np.linalg.norm(n, axis=1, keepdims=True)
    m = np.stack([a, b, unit], axis=1)
    assert np.einsum("nij,nkj->nik", m, m) == pytest.approx(np.broadcast_to(np.eye(3), (5, 3, 3)), abs=1e-12)
    assert a[0].tolist() == [1, 0, 0] and a[1].tolist() == [0, 1, 0] and b[1].tolist() == [0, 0, 1]
