"""Local operators: stencils of nearest neighbours, their weights, and the sparse operators they make.

Stencils are searched by cells, gathered a center, and solved in Arrow batches: all stencils of a batch go through one
stacked dense solve. A batch holds some hundred stencils, whatever the input.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import ceil, comb, prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.operators import spatial


def solver_rule(xi: int, theta: int, dim: int) -> dict[str, int]:
    """Polynomial degree, stencil size and spline degree for a solver of order xi and operator of order theta (fixed values)."""
    ell = max(xi + theta - 1, 2)
    return {"ell": ell, "n": 2 * comb(ell + dim, dim) + 1, "phs": max(5, ell if ell % 2 else ell - 1)}


def surface_rule(xi: int) -> dict[str, int]:
    ell = xi + 1
    return {"ell": ell, "n": (ell + 1) * (ell + 2) + 1, "phs": max(5, min(11, ell if ell % 2 else ell - 1))}


def accuracy_rule(order: int, derivative: int, dim: int, wls: bool = False, factor: float | None = None) -> dict[str, int]:
    """Degree, size and spline degree for an operator with derivatives of that order, accurate to `order`. Twice as
    many nodes as polynomials for splines, one and a half times for least squares."""
    ell = max(order + derivative - 1, 0)
    terms = comb(ell + dim, dim)
    return {"ell": ell, "n": max(terms + 1, ceil((factor or (1.5 if wls else 2.0)) * terms)), "phs": max(2 * derivative + 1, 3)}


def hyperviscosity_rule(power: int, dim: int) -> dict[str, int]:
    """For the operator "hyp<power>", the Laplacian `power` over: every polynomial that it takes to 0 is in the stencil."""
    ell = 2 * power - 1
    return {"ell": ell, "n": 2 * comb(ell + dim, dim) + 1, "phs": 2 * power + 1}


def exponents(dim: int, degree: int) -> list[tuple[int, ...]]:
    out = []
    for total in range(degree + 1):
        for pick in combinations_with_replacement(range(dim), total):
            out.append(tuple(pick.count(k) for k in range(dim)))
    return out


def monomials(x: np.ndarray, powers: list[tuple[int, ...]], diff: tuple[int, ...] = ()) -> np.ndarray:
    """(..., dim) points to (..., terms) values, differentiated once for each axis in diff."""
    out = []
    for p in powers:
        q, c = list(p), 1.0
        for axis in diff:
            c *= q[axis]
            q[axis] = max(q[axis] - 1, 0)
        out.append(c * np.prod([x[..., k] ** q[k] for k in range(x.shape[-1])], axis=0))
    return np.stack(out, axis=-1)


def _target(op: str, dim: int):
    """Derivatives (factor, axes) whose sum is the operator."""
    if op == "interp":
        return [(1.0, ())]
    if op == "lap":
        return [(1.0, (k, k)) for k in range(dim)]
    if op.startswith("hyp"):
        return [(0.0, ())]  # polynomials below its order, as hyperviscosity_rule has them
    return [(1.0, (int(op[1:]),))]  # d0, d1, d2


def _order(op: str) -> int:
    return 2 * int(op[3:]) if op.startswith("hyp") else {"interp": 0, "lap": 2}.get(op, 1)


def _phs_part(d: np.ndarray, m: int, op: str) -> np.ndarray:
    """The operator on r^m (odd m), as a function of the evaluation point, at differences d."""
    r = np.sqrt((d * d).sum(axis=-1))
    if op == "interp":
        return r**m
    if op == "lap":
        return m * (d.shape[-1] + m - 2) * r ** (m - 2)
    if op.startswith("hyp"):
        times = int(op[3:])
        return prod((m - 2 * s) * (m + d.shape[-1] - 2 - 2 * s) for s in range(times)) * r ** (m - 2 * times)
    return m * r ** (m - 2) * d[..., int(op[1:])]


def rbf_weights(x: np.ndarray, at: np.ndarray, degree: int, phs: int, ops: list[str]) -> dict[str, np.ndarray]:
    """Weights (batch, n) of each operator at `at` (batch, dim) on nodes x (batch, n, dim): splines with polynomials."""
    b, n, dim = x.shape
    scale = np.sqrt(((x - at[:, None]) ** 2).sum(-1)).max(axis=1)[:, None, None]
    z = (x - at[:, None]) / scale
    powers = exponents(dim, degree)
    r = np.sqrt(((z[:, :, None] - z[:, None]) ** 2).sum(-1))
    p = monomials(z, powers)
    q = p.shape[-1]
    system = np.zeros((b, n + q, n + q))
    system[:, :n, :n] = r**phs
    system[:, :n, n:] = p
    system[:, n:, :n] = np.swapaxes(p, 1, 2)
    rhs = np.zeros((b, n + q, len(ops)))
    origin = np.zeros((1, dim))
    for k, op in enumerate(ops):
        order = _order(op)
        rhs[:, :n, k] = _phs_part(-z, phs, op) / scale[:, 0] ** order
        rhs[:, n:, k] = sum(c * monomials(origin, powers, axes) for c, axes in _target(op, dim))[0] / scale[:, 0] ** order
    sound = np.linalg.matrix_rank(p) == q if n >= q else np.zeros(b, bool)
    system[~sound] = np.eye(n + q)
    w = np.linalg.solve(system, rhs)
    w[~sound] = np.nan  # nodes that don't determine the polynomials have no weights
    return {op: w[:, :n, k] for k, op in enumerate(ops)}


def cardinal(x: np.ndarray, at: np.ndarray, degree: int, phs: int, ops: list[str]) -> dict[str, np.ndarray]:
    """Weights (points, n) of each operator at several points on one set of nodes, whose system is factored once. nan where
    the nodes don't determine the polynomials."""
    n, dim = x.shape
    middle = x.mean(axis=0)
    scale = np.sqrt(((x - middle) ** 2).sum(-1)).max() or 1.0
    z, y = (x - middle) / scale, (at - middle) / scale
    powers = exponents(dim, degree)
    p = monomials(z, powers)
    q = p.shape[1]
    if n < q or np.linalg.matrix_rank(p) < q:
        return {op: np.full((len(at), n), np.nan) for op in ops}
    system = np.zeros((n + q, n + q))
    system[:n, :n] = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) ** phs
    system[:n, n:], system[n:, :n] = p, p.T
    rhs = []
    for op in ops:
        poly = sum(c * monomials(y, powers, axes) for c, axes in _target(op, dim))
        rhs.append(np.concatenate([_phs_part(y[:, None] - z[None], phs, op), poly], axis=1).T / scale ** _order(op))
    w = np.linalg.solve(system, np.concatenate(rhs, axis=1))[:n].T
    return {op: w[k * len(at) : (k + 1) * len(at)] for k, op in enumerate(ops)}


def wls_weights(x: np.ndarray, at: np.ndarray, degree: int, ops: list[str]) -> dict[str, np.ndarray]:
    """The same by weighted least squares: Gaussian weights about the center."""
    dim = x.shape[2]
    scale = np.sqrt(((x - at[:, None]) ** 2).sum(-1)).max(axis=1)[:, None, None]
    z = (x - at[:, None]) / scale
    powers = exponents(dim, degree)
    # fixed values: weights exp(-4 r^2), 1e-10 at least
    g = np.sqrt(np.clip(np.exp(-4 * (z * z).sum(-1)), 1e-10, 1))[..., None]
    fit = np.linalg.pinv(g * monomials(z, powers)) * np.swapaxes(g, 1, 2)  # (b, terms, n)
    origin, out = np.zeros((1, dim)), {}
    for op in ops:
        order = _order(op)
        target = sum(c * monomials(origin, powers, axes) for c, axes in _target(op, dim))[0]
        out[op] = np.einsum("t,btn->bn", target, fit) / scale[:, 0] ** order
    return out


def gathered(queries: DataFrame, points: DataFrame, k: int, dim: int, width: float | None = None) -> DataFrame:
    """(q, at, ids, xs): each query with its k nearest points in order."""
    near = spatial.grid_knn(queries, points, k, dim, width)
    full = near.join(points.select(F.col("id").alias("p"), F.col("pos").alias("x")), "p")
    rows = full.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "p", "x"))).alias("s"))
    return rows.join(queries.select(F.col("id").alias("q"), F.col("pos").alias("at")), "q").select("q", "at", F.col("s.p").alias("ids"), F.col("s.x").alias("xs"))


def weights(stencils: DataFrame, ops: list[str], degree: int, phs: int | None = None) -> DataFrame:
    """(row, col, and a column of each operator) from gathered stencils; splines if phs is given, else least squares."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                for n, same in part.groupby(part["ids"].map(len)):  # equal sizes stack
                    x = np.array([np.stack(r) for r in same["xs"]], float)
                    at = np.stack(same["at"].to_list()).astype(float)
                    w = rbf_weights(x, at, degree, phs, ops) if phs else wls_weights(x, at, degree, ops)
                    yield pd.DataFrame({"row": np.repeat(same["q"].to_numpy(), n), "col": np.concatenate(same["ids"].to_list())} | {op: w[op].ravel() for op in ops})

    return stencils.mapInPandas(run, "row long, col long, " + ", ".join(f"{op} double" for op in ops))


def operators(queries: DataFrame, points: DataFrame, ops: list[str], dim: int, n: int, degree: int, width: float | None = None, phs: int | None = None) -> DataFrame:
    return weights(gathered(queries, points, n, dim, width), ops, degree, phs)


#: The two reference axes of a tangent frame, by the axis in which the normal is longest.
_FIRST, _SECOND = np.eye(3)[[1, 0, 0]], np.eye(3)[[2, 2, 1]]


def tangent_frames(normals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit tangents of each normal (n, 3), by projecting the reference axes in turn."""
    nu = normals / np.linalg.norm(normals, axis=1, keepdims=True)
    pick = np.abs(nu).argmax(axis=1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    off = lambda v, e: v - (v * e).sum(1, keepdims=True) * e
    one = unit(off(_FIRST[pick], nu))
    return one, unit(off(off(_SECOND[pick], nu), one))


def surface_weights(stencils: DataFrame, normals: DataFrame, degree: int, phs: int) -> DataFrame:
    """(row, col, lap, gx, gy, gz): operators on the tangent plane of each center. normals: (id, normal)."""
    rows = stencils.join(normals.select(F.col("id").alias("q"), "normal"), "q")

    def run(batches):
        import pandas as pd

        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.iloc[lo : lo + 128]
                x = np.array([np.stack(r) for r in part["xs"]], float)
                at, nu = (np.stack(part[c].to_list()).astype(float) for c in ("at", "normal"))
                e1, e2 = tangent_frames(nu)
                d = x - at[:, None]
                flat = np.stack([(d * e[:, None]).sum(-1) for e in (e1, e2)], axis=-1)
                w = rbf_weights(flat, np.zeros((len(at), 2)), degree, phs, ["lap", "d0", "d1"])
                grad = w["d0"][..., None] * e1[:, None] + w["d1"][..., None] * e2[:, None]
                n = x.shape[1]
                yield pd.DataFrame({"row": np.repeat(part["q"].to_numpy(), n), "col": np.concatenate(part["ids"].to_list()), "lap": w["lap"].ravel()} | {f"g{c}": grad[..., k].ravel() for k, c in enumerate("xyz")})

    return rows.mapInPandas(run, "row long, col long, lap double, gx double, gy double, gz double")
