"""What larger tables need: no table is broadcast by its size on disk, far queries end in one pass, copies make no pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nodeweave.functions import scalar
from nodeweave.operators import geometry, greedy, partition, spatial

SMALL = "/root/testdata/sf0.001"


def hash_broadcasts(spark, run) -> int:
    """Broadcast hash joins in the plans that `run` has executed, those of its saved tables included."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    texts = [store.executionsList(k, 1).apply(0).physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert texts
    return sum(t.split("\n\n")[0].count("BroadcastHashJoin") for t in texts)


# the query, and its broadcasts of tables that have a bounded number of rows, in the first plan and the final one
@pytest.mark.parametrize("name, bounded", [
    ("crowding", 0),
    ("compact_support", 2),
    ("grid_knn", 0),
    ("greedy_independent_set", 0),
    ("kth_distance", 0),
    ("periodic_knn", 0),
    ("periodic_conflicts", 0),
    ("point_quality", 0),
    ("spmm", 0),
    ("structure_function", 0),
])
def test_tables_are_not_broadcast(spark, name, bounded):
    assert hash_broadcasts(spark, lambda: entry.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()) == bounded


def test_far_queries_are_brute_force(spark):
    """Queries far out on all sides, ties and copies, three in four outside the points' box."""
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(0, 1, (1500, 2)), 2)
    y = np.concatenate([rng.uniform(0, 1, (25, 2)), rng.uniform(-1e4, 1e4, (75, 2)), x[:20] + [1000.0, 0.0]])
    frame = lambda rows: spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(rows)], "id long, pos array<double>")
    for k in (1, 5):
        got = {(r.q, r.rank): r.p for r in spatial.grid_knn(frame(y), frame(x), k, 2).collect()}
        assert len(got) == k * len(y)
        for q, at in enumerate(y):
            d = (at[0] - x[:, 0]) ** 2 + (at[1] - x[:, 1]) ** 2
            assert [got[q, j + 1] for j in range(k)] == list(np.lexsort((np.arange(len(x)), d))[:k])


def test_copies_make_no_pairs(spark, monkeypatch):
    """Of 900 points at three places, two of them within the radius, and two points that lie nowhere."""
    tables = []
    monkeypatch.setattr(greedy, "saved", lambda df, name, keep=greedy.saved: tables.append((name, out := keep(df, name))) or out)
    rows = [(k, [[5.0, 5.0], [0.0, 0.0], [0.5, -0.0]][k % 3]) for k in range(900)] + [(900, [float("nan"), 0.0]), (901, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "id long, pos array<double>")
    assert sorted(r.id for r in greedy.thinned(df, 1.0, 2).collect()) == [0, 1, 900, 901]
    assert sorted(r.id for r in greedy.merged_points(df, 1e-9, 2).collect()) == [0, 1, 2, 900, 901]
    assert max(t.count() for name, t in tables if name == "edges") == 2


def test_periodic_distances_are_of_the_points_themselves(spark):
    """The image of 0.2 in a box of 9000 lies at 9000.2, whose distance from 8999.9 is rounded; the wrapped difference is less so."""
    df = spark.createDataFrame([(0, [0.2, 5.0]), (1, [8999.9, 5.0])], "id long, pos array<double>")
    t = 0.2 - 8999.9
    t += 9000.0
    assert [(r.q, r.p, r.d2) for r in spatial.periodic_pairs(df, df, 1.0, [9000.0, 0.0], ordered=True).collect()] == [(0, 1, t * t)]


def test_one_pass_finds_what_is_far_patches(spark, monkeypatch):
    """Two of three queries have no patch about them."""
    tables = []
    monkeypatch.setattr(spatial, "saved", lambda df, name, keep=spatial.saved: tables.append(name) or keep(df, name))
    near = spark.range(400).select("id", F.array((F.col("id") % 20) * 1.0, F.floor(F.col("id") / 20) * 1.0).alias("pos"))
    far = spark.createDataFrame([(0, [1e6, 3.2]), (1, [-1e7, 7.9]), (2, [3.1, 3.2])], "id long, pos array<double>")
    assert sorted((r.q, r.p) for r in spatial.patches_of(far, near, 0.5, 2).collect()) == [(0, 79), (1, 160), (2, 63)]
    assert len(tables) <= 7


def test_few_blocks_meet_on_a_long_strip(spark, monkeypatch):
    """Points on a strip a hundred times longer than wide, half of the queries beyond its end: boxes of blocks are not long, so a block of
    queries meets a few blocks of points. The share of all distances, from the saved boxes and the bound of `far_knn`."""
    tables = {}
    monkeypatch.setattr(spatial, "saved", lambda df, name, keep=spatial.saved: tables.setdefault(name, keep(df, name)))
    rng = np.random.default_rng(5)
    frame = lambda x: spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "id long, pos array<double>")
    x, y = rng.uniform(0, 1, (8000, 2)) * [1e5, 1e3], rng.uniform(0, 1, (8000, 2)) * [2e5, 1e3]
    assert spatial.far_knn(frame(y), frame(x), 1, 2).count() == 8000
    (an, al, ah), (bn, bl, bh) = [[np.array([r[c] for r in rows]) for c in ("n", "low", "high")] for rows in (tables["askers"].collect(), tables["blocks"].collect())]
    gap = np.maximum(np.maximum(bl[None] - ah[:, None], al[:, None] - bh[None]), 0)
    reach = np.maximum(bh[None] - al[:, None], ah[:, None] - bl[None])
    least, most = (gap**2).sum(axis=2), (reach**2).sum(axis=2)
    met = least <= most.min(axis=1, keepdims=True)
    assert (met * an[:, None] * bn[None]).sum() < 0.4 * 8000 * 8000


def test_patches_are_brute_force(spark):
    """Distances of exactly the radius, ties, copies of a center, queries far out or without a place, blocks of several sizes."""
    rng = np.random.default_rng(11)
    x = np.concatenate([np.round(rng.uniform(0, 40, (900, 2))), [[500.0, 0.0]] * 300])
    y = np.concatenate([np.round(rng.uniform(-5, 45, (1500, 2)) * 2) / 2, rng.uniform(-1e5, 1e5, (60, 2)), [[500.0, 3.0], [502.0, 0.0], [1e200, 0.0]]])
    frame = lambda rows: spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(rows)] + [(9000, None), (9001, [float("nan"), 0.0])], "id long, pos array<double>")
    with np.errstate(over="ignore"):
        d2 = (y[:, None, 0] - x[None, :, 0]) ** 2 + (y[:, None, 1] - x[None, :, 1]) ** 2
    for radius in (0.0, 2.0):
        near = np.sqrt(d2) < radius
        expected = [(q, p) for q, p in zip(*np.nonzero(near))] + [(q, d2[q].argmin()) for q in np.flatnonzero(~near.any(axis=1))]
        assert sorted((r.q, r.p) for r in spatial.patches_of(frame(y), frame(x), radius, 2).collect()) == sorted(expected)
    assert spatial.patches_of(frame(y), frame(x[:0]), 2.0, 2).count() == 0
    assert spatial.patches_of(frame(y[:0]), frame(x), 2.0, 2).count() == 0


def test_one_pass_finds_what_is_far_markers(spark, monkeypatch):
    """Two of three points are far from every marker."""
    tables = []
    monkeypatch.setattr(spatial, "saved", lambda df, name, keep=spatial.saved: tables.append(name) or keep(df, name))
    near = spark.range(400).select("id", F.array((F.col("id") % 20) * 1.0, F.floor(F.col("id") / 20) * 1.0).alias("pos"))
    far = spark.createDataFrame([(0, [1e6, 3.2]), (1, [-1e7, 7.9]), (2, [3.1, 3.2])], "id long, pos array<double>")
    markers = near.withColumn("normal", F.array(F.lit(1.0), F.lit(0.0)))
    assert [r.id for r in geometry.outside_inflated(far, markers, 0.0, 2).orderBy("id").collect()] == [0, 2]
    assert len(tables) <= 6


def test_one_pass_finds_what_is_far_weights(spark, monkeypatch):
    """Two of three queries have no patch about them, and all of the nearest."""
    tables = []
    monkeypatch.setattr(spatial, "saved", lambda df, name, keep=spatial.saved: tables.append(name) or keep(df, name))
    near = spark.range(400).select("id", F.array((F.col("id") % 20) * 1.0, F.floor(F.col("id") / 20) * 1.0).alias("pos"))
    far = spark.createDataFrame([(0, [1e6, 3.2]), (1, [-1e7, 7.9]), (2, [3.1, 3.2])], "id long, pos array<double>")
    assert sorted((r.q, r.p, r.w) for r in partition.unity_weights(far, near, 0.5, 2).collect()) == [(0, 79, 1.0), (1, 160, 1.0), (2, 63, 1.0)]
    assert len(tables) <= 6


def test_large_values_keep_their_size(spark):
    """floor gives a long, which holds no more than 9.2e18, that is 9.2e12 before six digits were added."""
    xs = [1.3e13, -1.3e13, 1.5e300, 9.3e12, 0.25, -0.0000005, 2.0000005]
    got = [r.y for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "id long, x double").select("id", scalar.quantised("x").alias("y")).orderBy("id").collect()]
    assert got == pytest.approx([1.3e13, -1.3e13, 1.5e300, 9.3e12, 0.25, 0.0, 2.000001], rel=1e-15, abs=0)


def test_no_point_lies_beyond_the_last_of_a_sphere(spark):
    x, y, z = scalar.fibonacci_sphere("id", 10)
    rows = spark.range(12).select("id", *[scalar.quantised(c).alias(n) for n, c in zip("xyz", (x, y, z))], scalar.quantised(F.lit(1.0) / F.col("id").cast("double") * float("inf")).alias("inf")).where("id > 0").collect()
    assert [(np.isnan(r.x), np.isnan(r.y), np.isnan(r.z)) for r in rows] == [(k > 9, k > 9, False) for k in range(1, 12)]
    assert all(r.x**2 + r.y**2 + r.z**2 == pytest.approx(1, abs=1e-5) for r in rows[:9]) and {r.inf for r in rows} == {float("inf")}
