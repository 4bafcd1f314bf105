"""Level sets (positive inside): local fits to oriented markers, projection, visibility, and neighbours that respect walls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.functions import scalar
from nodeweave.operators import spatial, stencils
from nodeweave.sources.scratch import saved

Phi = Callable[[list[Column]], Column]


def offsets(markers: DataFrame, h: float) -> DataFrame:
    """(id, pos, v): each marker (id, pos, normal outward, of length 1) at 0, and points h inside (v = h) and outside (v = -h)."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate((0.0, h, -h))])).alias("m")
    m = markers.select("id", "pos", "normal", sides)
    return m.select((3 * F.col("id") + F.col("m.k")).alias("id"), F.zip_with("pos", "normal", lambda p, q: p - q * F.col("m.s")).alias("pos"), F.col("m.s").alias("v"))


def evaluated(queries: DataFrame, markers: DataFrame, h: float, dim: int, n: int, degree: int = 2, phs: int = 3) -> DataFrame:
    """(id, phi, g): the value and gradient of the local fit to the offsets nearest to each query. Meant for a band of a few h;
    further out the fit extrapolates, and a winding number tells the side."""
    points = saved(offsets(markers, h), "offsets")
    names = ["interp", *[f"d{k}" for k in range(dim)]]
    w = stencils.operators(queries, points, names, dim, n, degree, spatial.fitting_width(points, n, dim), phs)
    full = w.join(points.select(F.col("id").alias("col"), "v"), "col")
    sums = full.groupBy("row").agg(*[F.sum(F.col(x) * F.col("v")).alias(x) for x in names])
    return sums.select(F.col("row").alias("id"), F.col("interp").alias("phi"), F.array(*names[1:]).alias("g"))


def projected(queries: DataFrame, markers: DataFrame, h: float, dim: int, n: int, rounds: int = 3, **options) -> DataFrame:
    """(id, pos): the queries moved along the gradient onto the zero level, by Newton steps."""
    at = queries.select("id", "pos")
    for _ in range(rounds):
        f = at.join(evaluated(at, markers, h, dim, n, **options), "id")
        size = F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)
        step = F.when(size > 0, F.col("phi") / size).otherwise(0.0)
        at = saved(f.withColumn("_t", step).select("id", F.zip_with("pos", "g", lambda p, g: p - F.col("_t") * g).alias("pos")), "projected")
    return at


def _coordinates(array: Column, dim: int) -> list[Column]:
    return [array[k] for k in range(dim)]


def visible(segments: DataFrame, phi: Phi, dim: int, h: float, lipschitz: float = 1.5, tolerance: float = 0.05, step: float = 0.1, rounds: int = 400) -> DataFrame:
    """segments (with arrays a, b) and `visible`: whether phi stays above -tolerance * h from a to b.

    Spheres are walked along the segment: where phi is known, nothing within phi / lipschitz is outside; a step is step * h at
    least. What is undecided after `rounds` steps counts as hidden. All in column expressions.
    """
    delta, least = tolerance * h, step * h
    length = scalar.distance("a", "b")
    base = segments.withColumns({"_l": length, "_fa": phi(_coordinates(F.col("a"), dim)), "_fb": phi(_coordinates(F.col("b"), dim))})

    def state(s: Column, z: Column, decided: Column) -> Column:
        return F.struct(s.alias("s"), z.alias("z"), decided.alias("d"))

    first = F.when(F.col("_fa") + F.col("_fb") > lipschitz * F.col("_l"), 1).when((F.col("_fa") < -delta) | (F.col("_fb") < -delta), 2).otherwise(0)

    def walk(now: Column, _) -> Column:
        s = now["s"] + F.greatest(now["z"] / lipschitz, F.lit(least))
        u = s / F.col("_l")
        z = phi([F.col("a")[k] + u * (F.col("b")[k] - F.col("a")[k]) for k in range(dim)])
        on = F.when(z < -delta, 2).when(z + F.col("_fb") > lipschitz * (F.col("_l") - s), 1).otherwise(0)
        return F.when(now["d"] != 0, now).when(s >= F.col("_l"), state(s, now["z"], F.lit(1))).otherwise(state(s, z, on))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(0.0), F.col("_fa"), first), walk)
    return base.withColumn("visible", end["d"] == 1).drop("_l", "_fa", "_fb")


def wall_knn(
    queries: DataFrame, points: DataFrame, k: int, dim: int, phi: Phi, h: float, width: float | None = None, wide: int = 4, bends: int = 8, band: float = 2.0, **options,
) -> DataFrame:
    """(q, rank, p, d): the k nearest of the wide * k Euclidean candidates by paths that stay inside.

    A candidate in sight counts by its distance; a hidden one by the shortest path with one bend at a candidate in sight whose phi
    is below band * h (the `bends` shortest are tried); those that neither reaches come last, by their distance. points: (id, pos,
    and owner, the id of the point whose sight counts, if there are ghosts). Queries whose k nearest are all in sight need no more.
    """
    near = spatial.knn(queries, points, wide * k, dim, width or spatial.fitting_width(points, wide * k, dim))
    own = points.select("id", "pos", (F.col("owner") if "owner" in points.columns else F.col("id")).alias("owner"))
    own = own.withColumn("owner", F.coalesce("owner", "id")).join(points.select(F.col("id").alias("owner"), F.col("pos").alias("t")), "owner")
    full = near.join(own.select(F.col("id").alias("p"), F.col("pos").alias("x"), "t"), "p").join(queries.select(F.col("id").alias("q"), F.col("pos").alias("a")), "q")
    seen = saved(visible(full.withColumn("b", F.col("t")), phi, dim, h, **options).withColumn("d", F.sqrt("d2")).select("q", "rank", "p", "d", "a", "x", "t", "visible"), "seen")
    hard = seen.where((F.col("rank") <= k) & ~F.col("visible")).select("q").distinct()
    easy = seen.where(F.col("rank") <= k).join(hard, "q", "left_anti").select("q", F.col("rank").cast("long").alias("rank"), "p", "d")
    rest = seen.join(hard, "q", "left_semi")
    turn = rest.where(F.col("visible") & (phi(_coordinates(F.col("x"), dim)) < band * h)).select("q", F.col("x").alias("j"), scalar.distance("a", "x").alias("dj"))
    path = rest.where(~F.col("visible")).select("q", "p", "t").join(turn, "q").withColumn("path", F.col("dj") + scalar.distance("j", "t"))
    path = path.withColumn("_n", F.row_number().over(Window.partitionBy("q", "p").orderBy("path"))).where(F.col("_n") <= bends)
    open_ = visible(path.select("q", "p", "path", F.col("j").alias("a"), F.col("t").alias("b")), phi, dim, h, **options).where("visible")
    best = open_.groupBy("q", "p").agg(F.min("path").alias("path"))
    ranked = rest.join(best, ["q", "p"], "left").withColumn("via", F.when(F.col("visible"), F.col("d")).otherwise(F.col("path") + scalar.distance("x", "t")))
    order = Window.partitionBy("q").orderBy(F.col("via").isNull(), F.coalesce("via", "d"), "rank")
    ranked = ranked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return easy.unionByName(ranked.select("q", F.col("_r").cast("long").alias("rank"), "p", F.coalesce("via", "d").alias("d")))
