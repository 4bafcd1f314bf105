"""Partition of unity: overlapping patches whose local splines are blended by weights that add up to 1.

A patch's system is factored once and evaluated at all points it covers; points of one patch are dealt out in blocks of
FAN, so that a patch that many points lie in is no single task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.functions import scalar
from nodeweave.functions.scalar import BDF
from nodeweave.operators import coo, greedy, solvers, spatial, stencils
from nodeweave.operators.joins import shuffled
from nodeweave.sources.scratch import saved

FAN = 256


def patch_rule(dim: int, xi: int) -> dict[str, int]:
    """Degree, least number of nodes and spline degree of a patch for order xi (fixed values)."""
    ell = max(xi + 1, 2)
    return {"ell": ell, "least": 2 * comb(dim + ell, dim) + 1, "phs": max(5, ell if ell % 2 else ell - 1)}


def patch_centers(points: DataFrame, spacing: float, dim: int) -> DataFrame:
    """Points, in the order of their ids, that no center before them lies within `spacing` of (inclusive)."""
    return greedy.thinned(points, spacing, dim).select("id", "pos")


def unity_weights(queries: DataFrame, centers: DataFrame, radius: float, dim: int) -> DataFrame:
    """(q, p, w): the share of each patch p at q; shares add up to 1. Where the patches' weights add up to 1e-14 at most, the
    nearest patch has all."""
    near = spatial.within(queries, centers, radius, dim, fewer_points=True) if dim <= 3 else spatial.ball(queries, centers, radius, dim)
    near = near.withColumn("raw", scalar.pu_weight(F.sqrt("d2") / radius))
    near = saved(near.withColumn("total", F.sum("raw").over(Window.partitionBy("q"))).where("total > 1e-14"), "shares")
    blend = near.where("raw > 0").select("q", "p", (F.col("raw") / F.col("total")).alias("w"))
    rest = queries.join(shuffled(near.select(F.col("q").alias("id")).distinct()), "id", "left_anti").select("id", "pos")
    one = spatial.knn(rest, centers, 1, dim, spatial.fitting_width(centers, 1, dim) if dim <= 3 else None)
    return blend.unionByName(one.select("q", "p", F.lit(1.0).alias("w")))


def patch_members(centers: DataFrame, nodes: DataFrame, radius: float, least: int, dim: int) -> DataFrame:
    """(p, ids, xs): the nodes within radius of each center, and the `least` nearest in any case."""
    near = spatial.ball(centers, nodes, radius, dim)
    some = spatial.knn(centers, nodes, least, dim, spatial.fitting_width(nodes, least, dim) if dim <= 3 else None)
    both = near.select("q", "p").unionByName(some.select("q", "p")).distinct()
    full = both.join(nodes.select(F.col("id").alias("p"), F.col("pos").alias("x")), "p")
    rows = full.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("s"))
    return rows.select(F.col("q").alias("p"), F.col("s.p").alias("ids"), F.col("s.x").alias("xs"))


def unity_operator(queries: DataFrame, nodes: DataFrame, centers: DataFrame, radius: float, dim: int, ops: list[str], xi: int = 2) -> DataFrame:
    """(row, col, and a column of each operator): at each query, the blend of its patches' local weights."""
    rule = patch_rule(dim, xi)
    shares = unity_weights(queries, centers, radius, dim).join(queries.select(F.col("id").alias("q"), F.col("pos").alias("at")), "q")
    fans = shares.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    dealt = shares.join(fans, "p").withColumn("fan", F.pmod(F.xxhash64("q"), F.col("fans")))
    asked = dealt.groupBy("p", "fan").agg(F.collect_list(F.struct("q", "w", "at")).alias("s"))
    work = asked.join(patch_members(centers, nodes, radius, rule["least"], dim), "p")
    work = work.select("ids", "xs", F.col("s.q").alias("qs"), F.col("s.w").alias("ws"), F.col("s.at").alias("ats"))

    def run(batches):
        import pandas as pd

        for b in batches:
            for ids, xs, qs, ws, ats in zip(b["ids"], b["xs"], b["qs"], b["ws"], b["ats"]):
                w = stencils.cardinal(np.stack(xs).astype(float), np.stack(ats).astype(float), rule["ell"], rule["phs"], ops)
                share = np.asarray(ws, float)[:, None]
                yield pd.DataFrame({"row": np.repeat(qs, len(ids)), "col": np.tile(ids, len(qs))} | {op: (share * w[op]).ravel() for op in ops})

    got = work.mapInPandas(run, "row long, col long, " + ", ".join(f"{op} double" for op in ops))
    return got.groupBy("row", "col").agg(*[F.sum(op).alias(op) for op in ops])


def part(operator: DataFrame, op: str) -> DataFrame:
    return operator.select("row", "col", F.col(op).alias("val"))


def interpolated(queries: DataFrame, nodes: DataFrame, field: DataFrame, centers: DataFrame, radius: float, dim: int, xi: int = 2) -> DataFrame:
    """(id, v) at the queries; a field with a column rhs has several species, and so has the result."""
    rows = part(unity_operator(queries, nodes, centers, radius, dim, ["interp"], xi), "interp")
    return coo.spmm(rows, field) if "rhs" in field.columns else coo.spmv(rows, field)


def feet(nodes: DataFrame, t: float, dt: float, velocity, dim: int) -> DataFrame:
    """(id, pos): where what arrives at each node at t was dt before. velocity(t, coordinates) gives columns."""
    point = [F.element_at("pos", k + 1) for k in range(dim)]
    return nodes.select("id", F.array(*scalar.traced_back(point, t, dt, velocity)).alias("pos"))


def transported(
    nodes: DataFrame, field: DataFrame, centers: DataFrame, radius: float, dim: int, t: float, dt: float, velocity, xi: int = 2,
    inside: Callable[[Column], Column] | None = None, inflow: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The field at t, dt after the given one, by one semi-Lagrangian step: each node takes the value at its foot. Nodes
    whose foot isn't `inside` take inflow(foot)."""
    foot = feet(nodes, t, dt, velocity, dim)
    if inside is None:
        return interpolated(foot, nodes, field, centers, radius, dim, xi)
    if "rhs" in field.columns:
        raise ValueError("an inflow of several species is not defined")
    foot = saved(foot, "feet")
    entered = foot.where(~inside(F.col("pos"))).select("id", inflow(F.col("pos")).alias("v"))
    return interpolated(foot.where(inside(F.col("pos"))), nodes, field, centers, radius, dim, xi).unionByName(entered)


def march(
    nodes: DataFrame, initial: DataFrame, centers: DataFrame, radius: float, dim: int, dt: float, steps: int, nu: float,
    forcing: Callable[[float, Column], Column], edge: Callable[[float, Column], Column], order: int = 1, xi: int = 2, velocity=None, **options,
) -> DataFrame:
    """(id, v) after `steps` steps of du/dt + velocity . grad u = nu Laplacian u + forcing, with values `edge` at boundary nodes.

    nodes: (id, pos, kind); diffusion by backward differences up to `order` on blended patches, advection by feet: level k of
    the history is taken where it was k steps before. The order rises with the levels there are.
    """
    inner = nodes.where("kind = 'interior'")
    lap = saved(part(unity_operator(inner, nodes, centers, radius, dim, ["lap"], xi), "lap"), "laplacian")
    rim = nodes.where("kind = 'boundary'").select("id", "pos")
    levels = [initial.select("id", "v")]
    for n in range(1, steps + 1):
        m, t = min(order, len(levels)), n * dt
        share, weights = BDF[m]
        moved = levels[:m]
        if velocity is not None:
            moved = [interpolated(feet(inner, t, (k + 1) * dt, velocity, dim), nodes, level, centers, radius, dim, xi) for k, level in enumerate(moved)]
        terms = [level.select("id", (c * F.col("v")).alias("v")) for c, level in zip(weights, moved)]
        past = reduce(DataFrame.unionByName, terms).groupBy("id").agg(F.sum("v").alias("_past"))
        right = inner.join(past, "id").select("id", (F.col("_past") + share * dt * forcing(t, F.col("pos"))).alias("v"))
        right = right.unionByName(rim.select("id", edge(t, F.col("pos")).alias("v")))
        system = coo.implicit_system(inner.select("id"), lap, -share * dt * nu).unionByName(coo.identity(rim))
        levels = [saved(solvers.solve(system, right, **options), "level"), *levels][:order]
    return levels[0]
