"""Node sets: elimination by crowding, spacing with priorities, disks of varying radius, lattices, shells and seams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.functions import scalar
from nodeweave.operators import geometry, greedy, spatial
from nodeweave.operators.joins import shuffled
from nodeweave.sources.scratch import saved


def crowding(points: DataFrame, radius: float, dim: int) -> DataFrame:
    """(id, weight): the sum of (1 - d / 2r) ** 8 over the other points at a distance d of at most 2r."""
    near = spatial.ball(points, points, 2 * radius, dim).where("q <> p")
    sums = near.groupBy(F.col("q").alias("id")).agg(F.sum(scalar.power(1 - F.sqrt("d2") / (2 * radius), 8)).alias("weight"))
    return points.select("id").join(shuffled(sums), "id", "left").select("id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def eliminated(points: DataFrame, radius: float, dim: int, flag: Column | None = None) -> DataFrame:
    """points, the most crowded first: none within radius (inclusive) of one taken before. Flagged points come before all; ties
    go to the lesser id."""
    rank = F.struct((~flag if flag is not None else F.lit(True)).alias("late"), (-F.col("weight")).alias("w"), "id")
    nodes = saved(points.join(crowding(points, radius, dim), "id").select("id", rank.alias("rank")), "ranks")
    pairs = spatial.ball(points, points, radius, dim).where((F.col("q") < F.col("p")) & (F.sqrt("d2") <= radius)).select(F.col("q").alias("a"), F.col("p").alias("b"))
    return points.join(greedy.independent_set(nodes, pairs), "id", "left_semi")


def spaced(points: DataFrame, radius: float, dim: int) -> DataFrame:
    """points (id, pos, flag), larger flags first, then by id: none nearer than radius * (1 - 1e-12) to one taken before."""
    if radius <= 0:
        return points
    least = radius * (1 - 1e-12)
    pairs = spatial.ball(points, points, radius, dim).where((F.col("q") < F.col("p")) & (F.sqrt("d2") < least)).select(F.col("q").alias("a"), F.col("p").alias("b"))
    nodes = points.select("id", F.struct((-F.col("flag")).alias("f"), "id").alias("rank"))
    return points.join(greedy.independent_set(nodes, pairs), "id", "left_semi")


def variable_disks(
    spark: SparkSession, radius: Callable[[Column], Column], smallest: float, largest: float, low: list[float], high: list[float], seed: int,
    accept: Column | None = None, passes: int = 4, density: float = 6.0, fixed: DataFrame | None = None,
) -> DataFrame:
    """(id, pos, radius) in a box: two points are no nearer than the larger of their radii, which radius(pos) gives and which lie
    between smallest and largest. fixed (id, pos, radius) stay, keep others off and aren't returned."""
    dim = len(low)
    count = 1 << (max(256, int(density * math.prod(b - a for a, b in zip(low, high)) / smallest**dim)) - 1).bit_length()
    size = F.least(F.greatest(radius(F.col("pos")), F.lit(smallest)), F.lit(largest))
    kept = None
    for turn in range(passes):
        new = greedy.box_candidates(spark, count, low, high, seed * 1000 + turn).withColumn("id", F.col("id") + turn * count).withColumn("radius", size)
        new = saved(new if accept is None else new.where(accept), "draw")
        for old in (x for x in (kept, fixed) if x is not None):
            near = spatial.within(new, old, largest, dim).join(new.select(F.col("id").alias("q"), F.col("radius").alias("rq")), "q")
            near = near.join(old.select(F.col("id").alias("p"), F.col("radius").alias("rp")), "p").where(F.sqrt("d2") < F.greatest("rq", "rp"))
            new = saved(new.join(near.select(F.col("q").alias("id")).distinct(), "id", "left_anti"), "free")
        nodes = new.select("id", F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id").alias("rank"))
        new = saved(new.join(greedy.independent_set(nodes, spatial.conflicts(new, dim, widest=largest)), "id", "left_semi"), "kept")
        if new.isEmpty():
            break
        kept = new if kept is None else kept.unionByName(new)
    return kept if kept is not None else greedy.box_candidates(spark, 0, low, high, seed).withColumn("radius", size)


def annulus_lattice(spark: SparkSession, inner: float, outer: float, spacing: float, shift: tuple[float, float] = (0.5, 0.5), center: bool = False) -> DataFrame:
    """(id, x, y) of a triangular lattice with inner <= r < outer, both less 1e-8; shift: where in a cell it begins, 0.5 for none.
    center: the origin too, with id -1, where inner is 0."""
    step = spacing * math.sqrt(3) / 2
    across, up = math.ceil((2 * outer + 3 * spacing) / spacing), math.ceil((2 * outer + 3 * step) / step)
    j, i = F.floor(F.col("id") / across), F.pmod("id", F.lit(across))
    x = (-outer - spacing) + i * spacing + (shift[0] - 0.5) * spacing + 0.5 * spacing * F.pmod(j, F.lit(2))
    y = (-outer - step) + j * step + (shift[1] - 0.5) * step
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    kept = spark.range(across * up).select("id", x.alias("x"), y.alias("y")).where((r2 < (outer - 1e-8) ** 2) & (r2 >= (inner - 1e-8) ** 2))
    return kept.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))) if center and inner <= 1e-12 else kept


def shell_offsets(clearance: float, depth: float, spacing: float) -> list[float]:
    """Distances from the boundary of the shells between clearance and depth."""
    if depth <= clearance + 1e-12:
        return []
    first = clearance + max(1e-6, 1e-2 * spacing)
    out = [first + k * spacing for k in range(max(0, math.ceil((depth + 0.5 * spacing - first) / spacing)))]
    if not out or abs(out[-1] - depth) > 0.25 * spacing:
        out.append(depth)
    return sorted({min(max(x, first), depth) for x in out})


def shells(outline: DataFrame, clearance: float, depth: float, spacing: float) -> DataFrame:
    """(layer, k, x, y): closed curves parallel to an outline (seq, x, y, nx, ny: normal outward), each with points at equal steps
    of arc length, eight at least. The layers' lengths reach the driver, one number a layer."""
    at = shell_offsets(clearance, depth, spacing)
    if not at:
        return outline.select(F.lit(0).alias("layer"), F.col("seq").cast("long").alias("k"), "x", "y").limit(0)
    layers = outline.select("seq", "x", "y", "nx", "ny", F.posexplode(F.array(*[F.lit(x) for x in at])).alias("poly", "eta"))
    layers = layers.select("poly", "seq", (F.col("x") - F.col("eta") * F.col("nx")).alias("x"), (F.col("y") - F.col("eta") * F.col("ny")).alias("y"))
    out = None
    for row in geometry.curve_measures(layers).select("poly", "length").orderBy("poly").collect():
        one = geometry.resampled(layers.where(F.col("poly") == row["poly"]), max(8, int(row["length"] // max(spacing, 1e-6))))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("poly", "layer")


def seams(sites: DataFrame, loops: DataFrame, h: float, dim: int, share: float = 0.02, degrees: float = 2.0) -> DataFrame:
    """(id, normal, priority) of the sites (id, pos) at which two pieces or more meet at an angle.

    loops: (id, piece, pos, normal of length 1), points on the pieces' rims. A piece meets a site if its nearest loop point lies within
    share * h; the normal is the normalised sum, the priority the number of pieces less one, dim - 1 at most. Sites whose normals
    are within `degrees` of the first piece's are smooth and left out; the normal is null where normals cancel.
    """
    near = spatial.ball(sites, loops, share * h, dim).join(loops.select(F.col("id").alias("p"), "piece", "normal"), "p")
    one = near.groupBy("q", "piece").agg(F.min_by("normal", F.struct("d2", "p")).alias("normal"))
    order = Window.partitionBy("q").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("normal").over(order)
    dot = F.aggregate(F.zip_with("normal", first, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = one.withColumn("dot", dot).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("dot").alias("dot"), *[F.sum(F.col("normal")[k]).alias(f"n{k}") for k in range(dim)])
    size = F.sqrt(sum((F.col(f"n{k}") * F.col(f"n{k}") for k in range(1, dim)), F.col("n0") * F.col("n0")))
    normal = F.when(size >= 1e-8, F.array(*[F.col(f"n{k}") / size for k in range(dim)]))
    return met.where((F.col("n") >= 2) & (F.col("dot") < math.cos(math.radians(degrees)))).select(F.col("q").alias("id"), normal.alias("normal"), F.least(F.col("n") - 1, F.lit(dim - 1)).alias("priority"))
