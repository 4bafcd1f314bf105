"""Operators of the numerical part: identities, brute force and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.operators import coo, greedy, series, spatial, stencils


def cloud(spark, n, dim, seed=1):
    rng = random.Random(seed)
    rows = [(k, [rng.random() for _ in range(dim)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, pos array<double>")


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


@pytest.mark.parametrize("dim, width", [(2, 0.05), (3, 0.2), (5, None)])
def test_knn_is_brute_force(spark, dim, width):
    rows, df = cloud(spark, 120, dim)
    got = {(r.q, r.rank): r.p for r in spatial.knn(df, df, 4, dim, width, rows=50).collect()}
    for i, x in rows:
        want = sorted((d2(x, y), j) for j, y in rows)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in want]


def test_periodic_knn(spark):
    rows, df = cloud(spark, 60, 2)
    got = {(r.q, r.rank): r.p for r in spatial.periodic_knn(df, df, 3, [1.0, 1.0], 0.2).collect()}
    wrap = lambda a, b: sum((x - y - round(x - y)) ** 2 for x, y in zip(a, b))
    for i, x in rows:
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in sorted((wrap(x, y), j) for j, y in rows)[:3]]


def test_periodic_knn_goes_as_far_as_it_takes(spark):
    """An axis of length 0 is not periodic: neighbours along it may be further away than the box is wide."""
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.9, 100.0])], "id long, pos array<double>")
    got = sorted((r.q, r.rank, r.p, round(r.d2, 9)) for r in spatial.periodic_knn(df, df, 2, [1.0, 0.0], 0.1).collect())
    assert got == [(0, 1, 0, 0.0), (0, 2, 1, 10000.01), (1, 1, 1, 0.0), (1, 2, 0, 10000.01)]


def test_independent_set_is_the_sequential_one(spark):
    rows, df = cloud(spark, 150, 2)
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and d2(x, y) <= 0.01]
    taken = []
    for i, _ in rows:
        if not any((a, i) in set(pairs) for a in taken):
            taken.append(i)
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(r.id for r in greedy.independent_set(df.select("id", F.col("id").alias("rank")), edges).collect()) == taken
    assert sorted(r.id for r in greedy.thinned(df, 0.1, 2).collect()) == taken


def test_poisson_disk_is_seeded_and_spaced(spark):
    draw = lambda: sorted((r.id, tuple(r.pos)) for r in greedy.poisson_disk(spark, 0.2, [0.0, 0.0], [1.0, 1.0], seed=19, passes=2).collect())
    a = draw()
    assert a == draw() and len(a) > 10
    assert all(d2(x, y) >= 0.04 * (1 - 1e-10) for i, x in a for j, y in a if i < j)


def test_poisson_disk_takes_four_passes(spark, monkeypatch):
    """As many passes and candidates as the reference, a pass that adds nothing being the last."""
    draws, real = [], greedy.box_candidates
    monkeypatch.setattr(greedy, "box_candidates", lambda spark, count, *a: draws.append(count) or real(spark, count, *a))
    kept = [r.id for r in greedy.poisson_disk(spark, 0.1, [0.0, 0.0], [1.0, 1.0], seed=19).collect()]
    assert set(draws) == {1024} and (len(draws) == 4 or max(kept) < 1024 * (len(draws) - 1))
    draws.clear()
    greedy.poisson_disk(spark, 0.5, [0.0, 0.0], [1.0, 1.0], seed=19)
    assert set(draws) == {256}


def test_poisson_disk_keeps_off_fixed_points(spark):
    fixed = spark.createDataFrame([(0, [0.5, 0.5])], "id long, pos array<double>")
    got = greedy.poisson_disk(spark, 0.2, [0.0, 0.0], [1.0, 1.0], seed=3, passes=2, fixed=fixed).collect()
    assert len(got) > 8 and all(d2(r.pos, (0.5, 0.5)) >= 0.04 * (1 - 1e-10) for r in got)


def test_schur_diagonal(spark):
    """Row 2 has no diagonal entry in the first matrix, row 0 one of 0 in the second: both count as 1."""
    for dense, want in (([[2, 0, 1, 0], [0, 4, 0, 2], [3, 0, 0, 0], [0, 5, 0, 11]], [2, 4, -1.5, 8.5]), ([[0, 0, 1, 0], [0, 4, 0, 2], [3, 0, 7, 0], [0, 5, 0, 2.5]], [1, 4, 4, 1])):
        a = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v], "row long, col long, val double")
        assert [r.v for r in coo.schur_diagonal(a, 2, 2).orderBy("id").collect()] == pytest.approx(want)


def test_csr_validity(spark):
    make = lambda rows: spark.createDataFrame(rows, "row long, col long, val double")
    good = [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)]
    verdict = lambda rows: coo.valid_csr(make(rows), 2, 2).first().valid
    assert verdict(good) and verdict([])
    assert not any(map(verdict, ([*good, (1, 1, 0.0)], [*good, (2, 0, 1.0)], [*good, (1, -1, 1.0)], [*good, (1, 0, float("nan"))], [*good, (1, 0, float("inf"))])))


def test_positions_that_are_nowhere(spark):
    """Null, short and non-finite positions have no neighbours and are none; the search ends."""
    nan = float("nan")
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0]), (6, [float("inf"), 0.0])], "id long, pos array<double>")
    for k in (1, 2, 9):
        got = sorted((r.q, r.rank, r.p) for r in spatial.grid_knn(df, df, k, 2).collect())
        assert got == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0)][: 4 if k > 1 else 0] or (k == 1 and got == [(0, 1, 0), (1, 1, 1)])
    assert spatial.grid_knn(df, df.limit(0), 3, 2).count() == 0


def test_ties_between_blocks(spark):
    """Equal distances go to the lower id, whatever block it is in."""
    df = spark.createDataFrame([(k, [float(k % 2), 0.0, 0.0, 0.0]) for k in range(60)], "id long, pos array<double>")
    got = {(r.q, r.rank): r.p for r in spatial.knn(df, df, 3, 4, rows=7).collect()}
    assert all([got[q, k + 1] for k in range(3)] == [q % 2, q % 2 + 2, q % 2 + 4] for q in range(60))


def test_masked_knn_needs_enough(spark):
    _, df = cloud(spark, 20, 2)
    with pytest.raises(ValueError):
        spatial.masked_knn(df, df, "id < 3", 4, 2)


def test_farthest_points(spark):
    import numpy as np

    rows, df = cloud(spark, 40, 3, seed=5)
    x = np.array([p for _, p in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    while len(chosen) < 6:
        chosen.append(int(((x[:, None] - x[chosen]) ** 2).sum(-1).min(1).argmax()))
    assert [r.id for r in greedy.farthest_points(df, 6).orderBy("id").collect()] == sorted(chosen)
    assert greedy.farthest_points(df, 99).count() == 40 and greedy.farthest_points(df.limit(0), 3).count() == 0


def test_signed_components(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, None), (2, -2.0), (3, None), (4, None)], "id long, v double")
    edges = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    assert sorted((r.id, r.label, r.sign) for r in greedy.signed_components(nodes, edges).collect()) == [(0, 0, 1.0), (1, 0, 1.0), (2, 2, -1.0), (3, 2, -1.0), (4, 4, None)]


@pytest.mark.parametrize("phs", [None, 5])
def test_laplacian_of_a_parabola(spark, phs):
    nodes = spark.createDataFrame([(5 * i + j, [i / 2 - 1, j / 2 - 1]) for i in range(5) for j in range(5)], "id long, pos array<double>")
    n = 9 if phs is None else 13
    w = stencils.operators(nodes, nodes, ["lap", "d0"], 2, n, 2, 0.6, phs)
    u = nodes.select("id", (F.col("pos")[0] * F.col("pos")[0] + F.col("pos")[1] * F.col("pos")[1]).alias("v"))
    inside = {5 * i + j for i in range(1, 4) for j in range(1, 4)}
    lap = {r.id: r.v for r in coo.spmv(w.select("row", "col", F.col("lap").alias("val")), u).collect()}
    assert all(abs(lap[k] - 4) < 1e-8 for k in inside)
    slope = {r.id: r.v for r in coo.spmv(w.select("row", "col", F.col("d0").alias("val")), u).collect()}
    assert all(abs(slope[k] - 2 * (k // 5 / 2 - 1)) < 1e-8 for k in inside)


def test_winding_guard(spark):
    """Own cases: what each of the four conditions refuses by itself, and what passes them all on either side."""
    nan, inf = float("nan"), float("inf")
    cases = [
        (0.06, 0.04, True), (0.91, 0.96, True), (0.0, 0.0, True), (1.02, 1.05, True), (-0.03, -0.02, True), (2.05, 2.01, True),
        (0.45, 0.55, False), (0.6, 0.03, False), (0.2, 0.8, False),  # sides
        (-0.6, 0.05, False), (-1.0, 0.02, False), (1.6, 0.95, False), (0.46, 0.05, False),  # the two differ by more than the margin
        (0.3, 0.25, False), (0.82, 0.8, False), (1.5, 1.5, False),  # no whole number
        (nan, 0.0, False), (0.0, nan, False), (inf, 1.0, False), (1.0, -inf, False),
    ]
    df = spark.createDataFrame([(k, c, f) for k, (c, f, _) in enumerate(cases)], "k int, c double, f double")
    got = [r.ok for r in df.select("k", scalar.winding_reliable("c", "f", 0.1).alias("ok")).orderBy("k").collect()]
    assert got == [ok for *_, ok in cases]


def test_transitions(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "id long") for s in ((1, 2, 2), (2, 3)))
    assert {(r.id, r.status) for r in series.transitions(a, b).collect()} == {(1, "entered"), (2, "persisted"), (3, "left")}


def test_queries_and_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_part(tmp_path):
    """A copy without the training-data folders and pipeline imports and keeps its other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/nodeweave", tmp_path / "nodeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries() if k != 'opN'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n = int(out.stdout.split()[0])
    assert n > 80
