"""Outlines, hulls, curves and level sets. An outline is a closed chain (poly, seq, x, y); points are (id, x, y).

Chains are walked by windows over one chain each; points meet only the edges of their own strip, so the work follows the
edges near a point, not points times edges.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.operators import spatial
from nodeweave.operators.joins import shuffled


def edges(outline: DataFrame) -> DataFrame:
    """(poly, seq, ax, ay, bx, by): each vertex with the next one, the last with the first."""
    chain = Window.partitionBy("poly").orderBy("seq")
    first = Window.partitionBy("poly").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(chain), F.first(c).over(first))
    return outline.select("poly", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), after("x").alias("bx"), after("y").alias("by"))


def _length() -> Column:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.sqrt(dx * dx + dy * dy)


def curve_measures(outline: DataFrame) -> DataFrame:
    """(poly, length, area, cx, cy): length of the closed chain, signed area, centroid (the vertices' mean where the area is 0)."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    e = edges(outline).withColumns({"l": _length(), "c": cross})
    sums = e.groupBy("poly").agg(
        F.sum("l").alias("length"), F.sum("c").alias("c"), F.avg("ax").alias("mx"), F.avg("ay").alias("my"),
        F.sum((F.col("ax") + F.col("bx")) * F.col("c")).alias("sx"), F.sum((F.col("ay") + F.col("by")) * F.col("c")).alias("sy"),
    )
    flat = F.abs("c") <= 1e-14
    at = lambda m, s: F.when(flat, F.col(m)).otherwise(F.try_divide(F.col(s), 3.0 * F.col("c")))
    return sums.select("poly", "length", (0.5 * F.col("c")).alias("area"), at("mx", "sx").alias("cx"), at("my", "sy").alias("cy"))


def chord_parameter(outline: DataFrame, closed: bool = True) -> DataFrame:
    """(poly, seq, s): the running length before each vertex over the whole length; an open chain has no closing edge."""
    chain = Window.partitionBy("poly").orderBy("seq")
    e = edges(outline).withColumn("l", _length())
    if not closed:
        e = e.withColumn("l", F.when(F.lead("seq").over(chain).isNotNull(), F.col("l")).otherwise(0.0))
    run = F.coalesce(F.sum("l").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("l").over(Window.partitionBy("poly"))
    return e.select("poly", "seq", (run / F.when(total > 0, total).otherwise(1.0)).alias("s"))


def resampled(outline: DataFrame, count: int) -> DataFrame:
    """(poly, k, x, y): count points at equal steps of arc length along each closed chain, from its first vertex on.

    Targets and vertices are put in one order along the chain, and each target takes the last vertex before it.
    """
    chain = Window.partitionBy("poly").orderBy("seq")
    e = edges(outline).withColumn("l", _length())
    e = e.withColumn("at", F.coalesce(F.sum("l").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    vertex = e.select("poly", "at", F.lit(0).alias("kind"), "seq", F.lit(None).cast("long").alias("k"), F.struct("at", "l", "ax", "ay", "bx", "by").alias("v"))
    total = e.groupBy("poly").agg(F.sum("l").alias("total"))
    target = total.select("poly", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("k"))
    target = target.select("poly", (F.col("k") * (F.col("total") / count)).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(e.schema["seq"].dataType).alias("seq"), "k", F.lit(None).cast(vertex.schema["v"].dataType).alias("v"))
    order = Window.partitionBy("poly").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    met = vertex.unionByName(target).withColumn("w", F.last("v", ignorenulls=True).over(order)).where("kind = 1")
    part = (F.col("at") - F.col("w.at")) / F.greatest(F.col("w.l"), F.lit(2.0**-52))
    return met.select("poly", "k", (F.col("w.ax") + part * (F.col("w.bx") - F.col("w.ax"))).alias("x"), (F.col("w.ay") + part * (F.col("w.by") - F.col("w.ay"))).alias("y"))


def _strips(outline: DataFrame, slack: float = 0.0) -> tuple[DataFrame, float]:
    """Edges, once for each strip of y that they touch, and the strips' height: about one edge's extent."""
    e = edges(outline)
    ends = e.agg(F.avg(F.abs(F.col("by") - F.col("ay"))).alias("h"), F.max("ay").alias("hi"), F.min("ay").alias("lo")).first()
    height = max(ends["h"] or 0.0, ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / 4096, 1e-9) + 2 * slack
    low, high = F.floor((F.least("ay", "by") - slack) / height), F.floor((F.greatest("ay", "by") + slack) / height)
    return e.withColumn("strip", F.explode(F.sequence(low, high))), height


def in_polygon(points: DataFrame, outline: DataFrame) -> DataFrame:
    """(id, poly) of the points in each outline, by the even-odd rule; the boundary, within 1e-12 of the edge's length (at least 1), belongs to it."""
    e, height = _strips(outline, 1e-9)
    p = points.select("id", "x", "y").withColumn("strip", F.floor(F.col("y") / height))
    met = p.join(e, "strip")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rx, ry = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    on = (F.abs(dx * ry - dy * rx) <= 1e-12 * F.greatest(F.lit(1.0), F.sqrt(dx * dx + dy * dy)))
    on = on & (rx * dx + ry * dy >= -1e-12) & ((F.col("x") - F.col("bx")) * dx + (F.col("y") - F.col("by")) * dy <= 1e-12)
    over = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < F.col("ax") + ry * dx / F.when(dy != 0, dy).otherwise(1.0))
    sides = met.groupBy("id", "poly").agg(F.sum(over.cast("int")).alias("n"), F.max(on).alias("on"))
    return sides.where("on OR n % 2 = 1").select("id", "poly")


def off_outline(points: DataFrame, outline: DataFrame) -> DataFrame:
    """points that lie on no edge: further than 1e-12 times the outline's extent (at least 1) from each."""
    box = outline.agg(*[f(c).alias(n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        return points
    tolerance = 1e-12 * max(1.0, math.hypot(box["hix"] - box["lox"], box["hiy"] - box["loy"]))
    e, height = _strips(outline, max(tolerance, 1e-9))
    met = points.select("id", "x", "y").withColumn("strip", F.floor(F.col("y") / height)).join(e, "strip")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rx, ry = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rx * dx + ry * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))))
    d2 = (rx - t * dx) * (rx - t * dx) + (ry - t * dy) * (ry - t * dy)
    return points.join(met.where(d2 <= tolerance * tolerance).select("id").distinct(), "id", "left_anti")


def _hull(x: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise from the least (x, y): both chains of the points in order."""
    x = np.unique(x, axis=0)
    if len(x) <= 2:
        return x

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(x) + chain(x[::-1]))


def convex_hull(points: DataFrame) -> DataFrame:
    """(seq, x, y): corners of the hull of points (x, y). Each task sends the corners of its own points only."""

    def run(batches):
        import pandas as pd

        left = np.zeros((0, 2))
        for b in batches:
            left = _hull(np.concatenate([left, b[["x", "y"]].dropna().to_numpy(float)]))
        yield pd.DataFrame({"seq": np.arange(len(left)), "x": left[:, 0], "y": left[:, 1]})

    each = points.select("x", "y").mapInPandas(run, "seq long, x double, y double")
    return each.select("x", "y").repartition(1).mapInPandas(run, "seq long, x double, y double")


def in_hull(points: DataFrame, hull: DataFrame) -> DataFrame:
    """Points on the inner side of all edges of a counterclockwise hull (seq, x, y), or in its box if it has two corners or
    less. A corner list is short: those of n even points are some log n; it is refused above 100,000."""
    corners = [(r["x"], r["y"]) for r in hull.orderBy("seq").limit(100_001).collect()]
    if len(corners) > 100_000:
        raise ValueError("too many corners")
    x, y = F.col("x"), F.col("y")
    if len(corners) <= 2:
        if not corners:
            return points.limit(0)
        (ax, ay), (bx, by) = corners[0], corners[-1]
        return points.where(x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    sides = F.array(*[F.struct(F.lit(float(ax)).alias("x"), F.lit(float(ay)).alias("y"), F.lit(float(bx - ax)).alias("u"), F.lit(float(by - ay)).alias("v")) for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])])
    return points.where(F.forall(sides, lambda e: e["u"] * (y - e["y"]) - e["v"] * (x - e["x"]) >= -1e-12))


def outside_inflated(points: DataFrame, markers: DataFrame, h: float, dim: int) -> DataFrame:
    """Ids of points (id, pos) beyond the markers (id, pos, normal) moved out by 0.75 h: past the nearest one along its normal."""
    out = markers.select("id", F.zip_with("pos", "normal", lambda x, n: x + 0.75 * h * n).alias("pos"), "normal")
    near = spatial.grid_knn(points, out, 1, dim).select(F.col("q").alias("id"), F.col("p"))
    both = points.select("id", "pos").join(shuffled(near), "id").join(shuffled(out.select(F.col("id").alias("p"), F.col("pos").alias("m"), "normal")), "p")
    along = F.aggregate(F.zip_with(F.zip_with("pos", "m", lambda x, y: x - y), "normal", lambda d, n: d * n), F.lit(0.0), lambda s, t: s + t)
    return both.where(along > 1e-12).select("id")


def winding(queries: DataFrame, markers: DataFrame, dim: int, rows: int = 4096) -> DataFrame:
    """(id, w): the winding integral of markers (id, pos, area_normal) about each query (id, pos): the sum of d . n / |d|^dim
    over 2 pi, or 4 pi in three dimensions. By blocks of queries and markers, as the sum is over all of them."""
    turn = 2 * math.pi if dim == 2 else 4 * math.pi
    packed = markers.withColumn("pos", F.concat("pos", "area_normal")).select("id", "pos")

    def run(batches):
        import pandas as pd

        for b in batches:
            for ids, x, y in zip(b["a_ids"], b["a_x"], b["b_x"]):
                x, y = np.stack(list(x)).astype(float), np.stack(list(y)).astype(float)
                for lo in range(0, len(x), 256):
                    d = y[None, :, :dim] - x[lo : lo + 256, None]
                    r = np.maximum(np.sqrt((d * d).sum(-1)), 1e-150)
                    yield pd.DataFrame({"id": np.asarray(ids)[lo : lo + 256], "w": ((d * y[None, :, dim:]).sum(-1) / r**dim).sum(1) / turn})

    pairs = spatial._blocks(queries, rows, "a").crossJoin(spatial._blocks(packed, rows, "b").select("b_x"))
    return pairs.mapInPandas(run, "id long, w double").groupBy("id").agg(F.sum("w").alias("w"))


def measure_inside(spark, low: list[float], high: list[float], inside, count: int = 32) -> DataFrame:
    """One row: the area of the part of a box where inside(x, y) holds, by the share of count x count grid points, ends included."""
    n = count - 1
    at = [F.lit(low[k]) + (F.col("id") % count if k else F.floor(F.col("id") / count)) * ((high[k] - low[k]) / n) for k in range(2)]
    area = (high[0] - low[0]) * (high[1] - low[1])
    return spark.range(count * count).select(inside(*at).cast("double").alias("f")).agg((F.avg("f") * area).alias("measure"))


def covariance(points: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (ddof 0) of the columns: sums of one row reach the driver."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = points.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    mean, cov = np.array([row[f"m_{c}"] or 0.0 for c in columns]), np.zeros((len(columns),) * 2)
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = row[f"c_{a}_{b}"] or 0.0
    return mean, cov


def _axes(cov: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the longest first, each with its largest component positive."""
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(len(cov))])


def oriented_box(points: DataFrame, columns: list[str]) -> dict[str, list]:
    """Mean, principal axes (a list each, the longest first), and least and greatest coordinate along them."""
    mean, cov = covariance(points, columns)
    axes = _axes(cov)
    along = [sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(columns, mean, axis)), F.lit(0.0)) for axis in axes.T]
    row = points.agg(*[f(x).alias(f"{n}{k}") for k, x in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {"mean": mean.tolist(), "axes": axes.T.tolist(), "low": [row[f"lo{k}"] for k in range(len(columns))], "high": [row[f"hi{k}"] for k in range(len(columns))]}


def best_plane(points: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """A point of the least-squares plane and its unit normal."""
    mean, cov = covariance(points, columns)
    return mean.tolist(), _axes(cov)[:, -1].tolist()


def local_normals(points: DataFrame, k: int, reference: list[float], smoothing: int = 0) -> DataFrame:
    """(id, normal) of points (id, pos) in three dimensions: the least principal axis of the k nearest, on the side away from
    the reference point; smoothed by means over the same neighbours as often as asked."""
    from nodeweave.operators import stencils

    got = stencils.gathered(points, points, k, 3, None)

    def run(batches):
        import pandas as pd

        for b in batches:
            x, at = np.array([np.stack(r) for r in b["xs"]], float), np.stack(b["at"].to_list()).astype(float)
            d = x - x.mean(axis=1, keepdims=True)
            normal = np.linalg.eigh(np.einsum("bki,bkj->bij", d, d))[1][:, :, 0]
            side = np.sign(((at - np.array(reference)) * normal).sum(1))
            yield pd.DataFrame({"id": b["q"], "normal": list(normal * np.where(side == 0, 1.0, side)[:, None])})

    out = got.mapInPandas(run, "id long, normal array<double>") if points.take(1) else points.sparkSession.createDataFrame([], "id long, normal array<double>")
    from nodeweave.functions.scalar import normalised
    from nodeweave.sources.scratch import saved

    near = saved(got.select("q", F.explode("ids").alias("p")), "near") if smoothing else None
    for _ in range(smoothing):
        flat = near.join(saved(out, "normals").select(F.col("id").alias("p"), "normal"), "p")
        mean = flat.groupBy(F.col("q").alias("id")).agg(*[F.avg(F.col("normal")[c]).alias(f"_{c}") for c in range(3)])
        out = mean.select("id", normalised(F.array("_0", "_1", "_2")).alias("normal"))
    return out
