"""Geometry, rows, polynomials, learning and readers, by plain code on small tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeweave.functions import polynomials, scalar
from nodeweave.operators import geometry, learning, rows, series
from nodeweave.sources import readers


def chain(spark, points, poly=0):
    return spark.createDataFrame([(poly, k, float(x), float(y)) for k, (x, y) in enumerate(points)], "poly int, seq long, x double, y double")


def test_polygon_with_its_boundary(spark):
    o = chain(spark, [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    inside = [(1, 1), (3.5, 3), (0, 0), (4, 2), (2, 0), (2, 1), (3, 2.5), (0, 4), (2, 0.5)]
    outside = [(2, 2), (-1, 0), (5, 0), (2, 1.0001), (2, 5), (-1e-6, 2), (4, 4.001)]
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(inside + outside)], "id long, x double, y double")
    assert sorted(r.id for r in geometry.in_polygon(p, o).collect()) == list(range(len(inside)))
    on = {2, 3, 4, 5, 6, 7}
    assert sorted(r.id for r in geometry.off_outline(p, o).collect()) == [k for k in range(len(inside + outside)) if k not in on]
    m = geometry.curve_measures(o).first()
    assert m.area == pytest.approx(10.0) and m.length == pytest.approx(12 + 2 * math.hypot(2, 3))
    assert geometry.in_polygon(p, o.limit(0)).count() == 0 and geometry.in_polygon(p.limit(0), o).count() == 0


def test_hulls(spark):
    rng = random.Random(3)
    points = [(rng.random(), rng.random()) for _ in range(200)] + [(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 1.5), (1.0, 0.0)]
    df = spark.createDataFrame(points, "x double, y double").repartition(4)
    assert [(r.x, r.y) for r in geometry.convex_hull(df).orderBy("seq").collect()] == [(0, 0), (2, 0), (2, 1.5), (0, 1.5)]
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.5), (2, 2.1, 1.0), (3, -0.1, 0.0)], "id long, x double, y double")
    assert sorted(r.id for r in geometry.in_hull(p, geometry.convex_hull(df)).collect()) == [0, 1]
    assert geometry.in_hull(p, geometry.convex_hull(df.limit(0))).count() == 0


def test_arc_length(spark):
    got = geometry.resampled(chain(spark, [(0, 0), (1, 0), (1, 0), (1, 1), (0, 1)]), 8).orderBy("k").collect()
    assert np.array([(r.x, r.y) for r in got]) == pytest.approx(np.array([(0, 0), (0.5, 0), (1, 0), (1, 0.5), (1, 1), (0.5, 1), (0, 1), (0, 0.5)]))


def test_boxes_planes_and_normals(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    x = rng.uniform(-1, 1, (400, 3)) * [5, 2, 0] @ turn.T + [1, 2, 3]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, x double, y double, z double")
    box = geometry.oriented_box(df, ["x", "y", "z"])
    assert [h - l for l, h in zip(box["low"], box["high"])] == pytest.approx([10, 4, 0], abs=0.3)
    point, normal = geometry.best_plane(df, ["x", "y", "z"])
    assert np.abs((x - point) @ normal).max() < 1e-9
    points = df.select("id", F.array("x", "y", "z").alias("pos"))
    got = geometry.local_normals(points, 8, list(map(float, np.array(point) - 100 * np.array(normal))), smoothing=1).collect()
    assert len(got) == 400 and all(np.dot(r.normal, normal) == pytest.approx(1, abs=1e-6) for r in got)


def test_orders(spark):
    rng = random.Random(8)
    data = [(k, rng.randint(0, 5)) for k in range(300)]
    df = spark.createDataFrame(data, "id long, priority int").repartition(5)
    got = {r.id: r["rank"] for r in rows.by_priority(df).collect()}
    assert sorted(got, key=got.get) == [k for k, _ in sorted(data, key=lambda r: (-r[1], r[0]))] and sorted(got.values()) == list(range(300))
    parts = [[r.id for r in rows.batch(df, "id", 4, k, 90).collect()] for k in range(4)]
    assert list(map(len, parts)) == [90, 90, 90, 30] and sorted(sum(parts, [])) == list(range(300)) and sorted(parts[0]) != list(range(90))
    index = spark.createDataFrame([(0, 5), (1, 9)], "logical long, physical long")
    assert rows.physical(index.select("logical"), index).count() == 2
    with pytest.raises(Exception, match="no physical row"):
        rows.physical(spark.createDataFrame([(7,)], "logical long"), index).collect()


def test_fingerprint_is_of_the_set(spark):
    a = spark.createDataFrame([(k, k * 0.5) for k in range(50)], "id long, v double")
    one = series.fingerprint(a, ["id", "v"]).first()
    assert one == series.fingerprint(a.repartition(7).orderBy(F.desc("id")), ["id", "v"]).first()
    assert one != series.fingerprint(a.withColumn("v", F.when(F.col("id") == 3, 9.0).otherwise(F.col("v"))), ["id", "v"]).first()


def test_recurrences():
    rng = np.random.default_rng(1)
    x, (a, b) = rng.uniform(-1, 1, 7), polynomials.jacobi_recurrence(6, 0.5, 1.5)
    p = polynomials.values(a, b, x, 5)
    d = (np.array(polynomials.values(a, b, x + 1e-6, 5)) - np.array(polynomials.values(a, b, x - 1e-6, 5))) / 2e-6
    assert np.array(polynomials.values(a, b, x, 5, 1)) == pytest.approx(d, abs=1e-6)
    r = polynomials.ratios(a, b, x, 5)
    assert all(r[k] == pytest.approx(p[k + 1] / p[k]) for k in range(5))
    nodes = np.array(polynomials.gauss_legendre(200))
    w = nodes[:, 1] * (1 - nodes[:, 0]) ** 0.5 * (1 + nodes[:, 0]) ** 1.5
    v = np.array(polynomials.values(a, b, nodes[:, 0], 5))
    assert (v * w) @ v.T == pytest.approx(np.eye(6), abs=1e-3)
    assert polynomials.total_degree(2, 2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    with pytest.raises(ValueError):
        polynomials.hyperbolic_cross(0, 3)


def test_motion_is_of_its_order(spark):
    spin = lambda t, p: [-p[1] * (1 + t), p[0] * (1 + t)]
    df = spark.createDataFrame([(1.0, 0.0)], "x double, y double")
    for step, order in ((scalar.rk3, 3), (scalar.rk4, 4)):
        err = []
        for dt in (0.2, 0.1):
            x, y = df.select(*step([F.col("x"), F.col("y")], 0.5, dt, spin)).first()
            angle = 1.5 * dt + dt * dt / 2
            err.append(math.hypot(x - math.cos(angle), y - math.sin(angle)))
        assert math.log2(err[0] / err[1]) > order + 0.7


def test_kernel_fit_and_prediction(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (24, 3))
    y = np.stack([x[:, 0] + x[:, 1], np.sin(x[:, 2])], 1)
    make = lambda m, ids=None: spark.createDataFrame([(k, list(map(float, r))) for k, r in zip(ids or range(len(m)), m)], "id long, v array<double>")
    inputs, outputs = make(x).withColumnRenamed("v", "pos"), make(y).withColumnRenamed("v", "y")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    k = lambda e, m: np.where(e * m < 1, 3 * (1 - np.minimum(e * m, 1)) ** 6 * (1 + 6 * e * m + 35 * (e * m) ** 2 / 3), 0)
    c = learning.fit(inputs, outputs, 0.5, 0.1)
    assert np.array([r.y for r in c.orderBy("id").collect()]) == pytest.approx(np.linalg.solve(k(0.5, d) + 0.1 * np.eye(24), y), rel=1e-4, abs=1e-5)
    z = rng.uniform(-1, 1, (5, 3))
    got = np.array([r.y for r in learning.predict(make(z).withColumnRenamed("v", "pos"), inputs, c, 0.5).orderBy("id").collect()])
    want = k(0.5, np.sqrt(((z[:, None] - x) ** 2).sum(-1))) @ np.linalg.solve(k(0.5, d) + 0.1 * np.eye(24), y)
    assert got == pytest.approx(want, abs=1e-6)
    weights = np.zeros((5, 24))
    for r in learning.lagrange_map(make(z).withColumnRenamed("v", "pos"), inputs, 0.5, 0.1).collect():
        weights[r.row, r.col] = r.val
    assert weights @ y == pytest.approx(want, abs=1e-6)
    e, s = learning.epsilon_for_sparsity(inputs, 0.6)
    assert abs(s - 0.6) < 2e-2 and s == pytest.approx(1 - (e * d < 1).sum() / 576)
    assert learning.epsilon_for_sparsity(inputs, 0.0)[1] == 0
    with pytest.raises(ValueError):
        learning.epsilon_for_sparsity(inputs.withColumn("pos", F.array(F.lit(1.0))), 0.5)
    flat = learning.normalised_inputs(make(np.column_stack([x[:, :2], np.full(24, 4.0)])).withColumnRenamed("v", "pos")).orderBy("id").collect()
    assert np.array([r.pos for r in flat]) == pytest.approx(np.column_stack([(x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0), np.zeros(24)]))


def test_best_epsilon(spark):
    """A wide kernel reproduces a line that a narrow one, which reaches nobody, does not."""
    table = lambda ids, name, f: spark.createDataFrame([(k, [f(k)]) for k in ids], f"id long, {name} array<double>")
    inputs, outputs = table(range(8), "pos", lambda k: k / 8), table(range(8), "y", lambda k: 1 + k / 8)
    held, truth = table(range(3), "pos", lambda k: (k + 2.5) / 8), table(range(3), "y", lambda k: 1 + (k + 2.5) / 8)
    best, errors = learning.select_epsilon(inputs, outputs, held, truth, [1.0, 20.0], 1e-3)
    assert best == 1.0 and errors[0][1] < 0.05 < errors[1][1]


def test_trajectories(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="faces.csv"):
        (tmp_path / "material.csv").write_text("u_x,u_y,u_z,node_id\n0,0,2,1\n3,4,0,0\n")
        (tmp_path / "diagnostics.csv").write_text("time,step\n0.0,0\n0.5,10\n")
        readers.Trajectory(spark, str(tmp_path))
    (tmp_path / "faces.csv").write_text("a,b,c\n0,1,0\n")
    for step in (0, 10, 20):
        (tmp_path / f"frame_{step:06d}.csv").write_text(f"node_id,x,y,z,u,v,w\n1,{step},0,0,1,1,1\n0,1,{step},0,2,2,2\n")
    t = readers.Trajectory(spark, str(tmp_path))
    assert [(r.id, r.pos) for r in t.sites.orderBy("id").collect()] == [(0, [0.6, 0.8, 0.0]), (1, [0.0, 0.0, 1.0])]
    assert sorted((r.step, r.time, r.id, r.pos[0]) for r in t.frames().collect()) == [(0, 0.0, 0, 1.0), (0, 0.0, 1, 0.0), (10, 0.5, 0, 1.0), (10, 0.5, 1, 10.0)]
    assert sorted((r.id, r.pos[1], r.velocity[0]) for r in t.frame(1).collect()) == [(0, 10.0, 2.0), (1, 0.0, 1.0)]
    with pytest.raises(ValueError, match="q"):
        readers.csv_table(spark, f"{tmp_path}/faces.csv", "a long, q long")


def test_splits_files_and_reports(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, "split string, id long")
    assert sorted(r.id for r in readers.checked_split(make([("train", 1), ("train", 2), ("test", 3)])).collect()) == [0, 1, 2]
    for bad, why in (([("train", 0)], "negative"), ([("train", 2), ("train", 2)], "repeated"), ([("train", 2), ("test", 2)], "two splits")):
        with pytest.raises(ValueError, match=why):
            readers.checked_split(make(bad))
    np.savez(tmp_path / "cloud.npz", points=np.arange(6.0).reshape(3, 2))
    assert [(r.id, r.pos) for r in readers.npz_points(spark, str(tmp_path / "cloud.npz")).orderBy("id").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    df = spark.createDataFrame([(1, 0.5, "a"), (2, None, "b,c")], "n long, x double, t string")
    assert readers.report(df, "markdown") == "| n | x | t |\n| --- | --- | --- |\n| 1 | 5.000000e-01 | a |\n| 2 |  | b,c |\n"
    assert [json.loads(x) for x in readers.report(df, "jsonl").splitlines()] == [{"n": 1, "x": 0.5, "t": "a"}, {"n": 2, "x": None, "t": "b,c"}]
    assert readers.report(df, "csv") == 'n,x,t\n1,0.5,a\n2,,"b,c"\n' and readers.report(df, "latex").startswith("\\begin{tabular}{rrr}\nn & x & t")
    with pytest.raises(ValueError):
        readers.report(df, "markdown", most=1)
    assert readers.selected_rows(df.withColumnRenamed("n", "id"), spark.createDataFrame([(2,), (2,), (9,)], "id long")).count() == 1
