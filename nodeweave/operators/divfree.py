"""Divergence-free matrix kernels, and local fits of vector fields by them.

The kernel of a radial function f is (-Laplacian I + grad grad') f: each of its columns is a field without divergence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.operators import spatial, stencils


def _differences(x: str, y: str, dim: int) -> list[Column]:
    return [F.element_at(x, k + 1) - F.element_at(y, k + 1) for k in range(dim)]


def _block(pairs: DataFrame, entry, dim: int) -> DataFrame:
    return pairs.select("*", *[entry(a, b).alias(f"k{a}{b}") for a in range(dim) for b in range(dim)])


def phs_entries(pairs: DataFrame, degree: int, dim: int) -> DataFrame:
    """pairs (with arrays x, y) and the entries k<a><b> of the kernel of r ** degree, degree odd and 3 at least; 0 at r = 0."""
    if degree < 3 or degree % 2 == 0 or dim not in (2, 3):
        raise ValueError("an odd degree of 3 at least, in two or three dimensions")
    d = _differences("x", "y", dim)
    r = scalar.distance("x", "y")

    def entry(a: int, b: int) -> Column:
        second = scalar.phs_second(r, d[a], d[b], degree, a == b)
        return second - scalar.phs_laplacian(r, degree, dim) if a == b else second

    return _block(pairs, entry, dim)


def mixture(length: float, modes: int = 5, gamma: float = 8 / 3) -> list[tuple[float, float]]:
    """(inverse length, weight) of lengths halved from mode to mode."""
    return [(2.0**j / length, 2.0 ** (-gamma * j)) for j in range(1, modes + 1)]


def matern_entries(pairs: DataFrame, parts: list[tuple[float, float]], dim: int, normalize: bool = True) -> DataFrame:
    """The same for a mixture of Matern functions w (3 + 3 e r + (e r)^2) exp(-e r); normalized, the diagonal at r = 0 is 1."""
    d = _differences("x", "y", dim)
    r = scalar.distance("x", "y")
    whole = (dim - 1) * sum(w * e * e for e, w in parts) if normalize else 1.0
    decay = [(e, (w / whole) * F.exp(-e * r)) for e, w in parts]
    own = sum((g * ((dim - 1) * e * e * (1 + e * r) - e**4 * r * r) for e, g in decay), F.lit(0.0))
    cross = sum((g * e**4 for e, g in decay), F.lit(0.0))
    return _block(pairs, lambda a, b: cross * d[a] * d[b] + own if a == b else cross * d[a] * d[b], dim)


def gram(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """The kernel of r ** degree between two point sets, component by component."""
    dim = x.shape[1]
    d = x[:, None] - y[None]
    r = np.sqrt((d * d).sum(-1))
    safe = np.where(r > 0, r, 1.0)
    cross = np.where(r > 0, degree * (degree - 2) * safe ** (degree - 4), 0.0)
    own = np.where(r > 0, (degree - degree * (degree + dim - 2)) * safe ** (degree - 2), 0.0)
    return np.block([[cross * d[..., a] * d[..., b] + (own if a == b else 0.0) for b in range(dim)] for a in range(dim)])


def polynomials(x: np.ndarray, degree: int) -> np.ndarray:
    """Curls of monomials: fields without divergence up to `degree`, component by component; not independent in 3-D."""
    dim = x.shape[1]
    powers = stencils.exponents(dim, degree + 1)
    d = [stencils.monomials(x, powers, (k,)) for k in range(dim)]
    if dim == 2:
        return np.concatenate([d[1], -d[0]])
    zero = np.zeros_like(d[0])
    return np.concatenate([np.concatenate(c) for c in ([zero, d[2], -d[1]], [-d[2], zero, d[0]], [d[1], -d[0], zero])], axis=1)


def _value(x: np.ndarray, u: np.ndarray, at: np.ndarray, degree: int, phs: int) -> np.ndarray:
    scale = np.sqrt(((x - at) ** 2).sum(-1)).max() or 1.0
    z, origin = (x - at) / scale, np.zeros((1, len(at)))
    raw = polynomials(z, degree)
    _, size, v = np.linalg.svd(raw, full_matrices=False)
    turn = v[size > 1e-10 * size[0]].T if size[0] > 0 else v[:0].T  # independent combinations
    p = raw @ turn
    n, q = p.shape
    system = np.zeros((n + q, n + q))
    system[:n, :n], system[:n, n:], system[n:, :n] = gram(z, z, phs), p, p.T
    try:
        c = np.linalg.solve(system, np.concatenate([u.T.ravel(), np.zeros(q)]))
    except np.linalg.LinAlgError:
        return np.full(len(at), np.nan)
    return gram(origin, z, phs) @ c[:n] + polynomials(origin, degree) @ turn @ c[n:]


def local_fields(queries: DataFrame, nodes: DataFrame, n: int, dim: int, degree: int = 2, phs: int = 5, width: float | None = None) -> DataFrame:
    """(id, u): at each query the value of the divergence-free fit to its n nearest nodes (id, pos, u array<double>), of splines
    r ** phs and polynomials up to `degree`. Polynomials that the nodes can't tell apart count once; nan where the system is singular."""
    full = spatial.knn(queries, nodes, n, dim, width or spatial.fitting_width(nodes, n, dim)).join(nodes.select(F.col("id").alias("p"), F.col("pos").alias("x"), "u"), "p")
    rows = full.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "u"))).alias("s"))
    rows = rows.join(queries.select(F.col("id").alias("q"), F.col("pos").alias("at")), "q").select("q", "at", F.col("s.x").alias("xs"), F.col("s.u").alias("us"))

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [_value(np.stack(x).astype(float), np.stack(u).astype(float), np.asarray(at, float), degree, phs) for x, u, at in zip(b["xs"], b["us"], b["at"])]
            yield pd.DataFrame({"id": b["q"], "u": out})

    return rows.mapInPandas(run, "id long, u array<double>")

