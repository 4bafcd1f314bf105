"""Operators on surfaces in space: gradients, divergence, Laplacian, curvature, transfer, and implicit steps that follow them.

A surface is (id, pos, normal); its operators are one table (row, col, lap, gx, gy, gz).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.functions.scalar import BDF, EXTRAPOLATION, normalised
from nodeweave.operators import coo, solvers, spatial, stencils
from nodeweave.sources.scratch import saved


def operators(surface: DataFrame, xi: int = 4, width: float | None = None) -> DataFrame:
    """(row, col, lap, gx, gy, gz) on tangent planes, of the order xi."""
    rule = stencils.surface_rule(xi)
    near = stencils.gathered(surface, surface, rule["n"], 3, width)
    return saved(stencils.surface_weights(near, surface, rule["ell"], rule["phs"]), "surface")


def part(ops: DataFrame, name: str) -> DataFrame:
    return ops.select("row", "col", F.col(name).alias("val"))


def gradient(ops: DataFrame, field: DataFrame) -> DataFrame:
    """(id, x, y, z) of a field (id, v): one join for the three components."""
    met = ops.join(field.select(F.col("id").alias("col"), "v"), "col")
    return met.groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col(f"g{c}") * F.col("v")).alias(c) for c in "xyz"])


def divergence(ops: DataFrame, field: DataFrame) -> DataFrame:
    """(id, v) of a vector field (id, x, y, z)."""
    met = ops.join(field.select(F.col("id").alias("col"), "x", "y", "z"), "col")
    return met.groupBy(F.col("row").alias("id")).agg(F.sum(F.col("gx") * F.col("x") + F.col("gy") * F.col("y") + F.col("gz") * F.col("z")).alias("v"))


def laplacian(ops: DataFrame, field: DataFrame) -> DataFrame:
    return coo.spmv(part(ops, "lap"), field)


def curvature(ops: DataFrame, surface: DataFrame) -> DataFrame:
    """(id, x, y, z): the Laplacian of the positions, the mean-curvature vector."""
    met = part(ops, "lap").join(surface.select(F.col("id").alias("col"), "pos"), "col")
    return met.groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("val") * F.col("pos")[k]).alias(c) for k, c in enumerate("xyz")])


def implicit(ops: DataFrame, ids: DataFrame, right: DataFrame, s: float, **options) -> DataFrame:
    """(id, v) of (I - s Laplacian) v = right."""
    return solvers.solve(coo.implicit_system(ids, part(ops, "lap"), -s), right, **options)


def curvature_flow_step(surface: DataFrame, dt: float, xi: int = 4, **options) -> DataFrame:
    """(id, pos) after a step of motion by mean curvature: (I - dt Laplacian) x = x0 for each coordinate, on the surface before."""
    ops, out = operators(surface, xi), surface.select("id")
    for k, c in enumerate("xyz"):
        new = implicit(ops, surface.select("id"), surface.select("id", F.col("pos")[k].alias("v")), dt, **options)
        out = out.join(new.withColumnRenamed("v", c), "id")
    return out.select("id", F.array("x", "y", "z").alias("pos"))


def adr_step(
    surface: DataFrame, ops: DataFrame, history: list[DataFrame], dt: float, nu: float, rates: list[DataFrame] | None = None,
    weights: DataFrame | None = None, mass: float | None = None, **options,
) -> DataFrame:
    """(id, v): a step of dv/dt = nu Laplacian v + rate by backward differences of order len(history) on the points as they are
    now (material points carry their levels along), rates (id, v), newest first, extrapolated. With quadrature weights (id, v)
    and a mass, the result is moved by one number to that mass."""
    from functools import reduce

    share, levels = BDF[len(history)]
    terms = [h.select("id", (c * F.col("v")).alias("v")) for c, h in zip(levels, history)]
    terms += [r.select("id", (share * dt * c * F.col("v")).alias("v")) for c, r in zip(EXTRAPOLATION[len(history)], rates or [])]
    right = reduce(DataFrame.unionByName, terms).groupBy("id").agg(F.sum("v").alias("v"))
    out = implicit(ops, surface.select("id"), right, share * dt * nu, **options)
    if weights is None:
        return out
    from nodeweave.operators import series

    both = saved(out.join(weights.withColumnRenamed("v", "_w"), "id"), "weighted")
    return series.mass_shift(both, "_w", "v", mass).select("id", "v")


def transfer(source: DataFrame, field: DataFrame, target: DataFrame, xi: int = 4) -> DataFrame:
    """(id, v): a field of the source surface at the target's points, by interpolation on the tangent plane of each target."""
    rule = stencils.surface_rule(xi)
    near = stencils.gathered(target, source, rule["n"], 3)
    rows = near.join(target.select(F.col("id").alias("q"), "normal"), "q")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for lo in range(0, len(b), 128):
                some = b.iloc[lo : lo + 128]
                x = np.array([np.stack(r) for r in some["xs"]], float)
                at, nu = (np.stack(some[c].to_list()).astype(float) for c in ("at", "normal"))
                d = x - at[:, None]
                flat = np.stack([(d * e[:, None]).sum(-1) for e in stencils.tangent_frames(nu)], axis=-1)
                w = stencils.rbf_weights(flat, np.zeros((len(at), 2)), rule["ell"], rule["phs"], ["interp"])["interp"]
                yield pd.DataFrame({"row": np.repeat(some["q"].to_numpy(), x.shape[1]), "col": np.concatenate(some["ids"].to_list()), "val": w.ravel()})

    return coo.spmv(rows.mapInPandas(run, "row long, col long, val double"), field)


def moved(surface: DataFrame, velocity, t: float, dt: float) -> DataFrame:
    """The surface's points a step later: (id, pos). velocity(t, [x, y, z]) gives three columns."""
    from nodeweave.functions.scalar import rk4

    return surface.select("id", F.array(*rk4([F.col("pos")[k] for k in range(3)], t, dt, velocity)).alias("pos"))


def sphere(spark, n: int, radius: float = 1.0) -> DataFrame:
    """n even points of a sphere, with outward normals."""
    from nodeweave.functions.scalar import fibonacci_sphere

    unit: Column = F.array(*fibonacci_sphere("id", n))
    return spark.range(n).select("id", F.transform(unit, lambda x: x * radius).alias("pos"), normalised(unit).alias("normal"))


def needs_remap(surface: DataFrame, limit: float) -> DataFrame:
    """One row: the point quality, and whether it has reached the limit."""
    return spatial.point_quality(surface, 3).select("quality", (F.col("quality") >= limit).alias("remap"))
