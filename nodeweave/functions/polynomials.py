"""Orthogonal polynomials by their three-term recurrences, multi-index sets and quadratures.

The recurrence of orthonormal p_n is sqrt(b[n+1]) p[n+1] = (x - a[n]) p[n] - sqrt(b[n]) p[n-1], with p[0] = 1 / sqrt(b[0]).
Values are column expressions or numpy arrays alike; quadratures are small tables made on the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jacobi_recurrence(n: int, alpha: float, beta: float) -> tuple[list[float], list[float]]:
    """The first n coefficients a and b for the weight (1 - x)^alpha (1 + x)^beta; b[0] is its integral."""
    s, a, b = alpha + beta, [], []
    for k in range(n):
        if k == 0:
            a.append((beta - alpha) / (s + 2))
            b.append(math.exp((s + 1) * math.log(2) + math.lgamma(alpha + 1) + math.lgamma(beta + 1) - math.lgamma(s + 2)))
            continue
        a.append((beta * beta - alpha * alpha) / ((2 * k + s) * (2 * k + s + 2)))
        # the general form has a factor k + s over 2 k + s - 1, which cancel at k = 1
        b.append(4 * (k + alpha) * (k + beta) / ((2 + s) ** 2 * (3 + s)) if k == 1 else 4 * k * (k + alpha) * (k + beta) * (k + s) / ((2 * k + s) ** 2 * (2 * k + s + 1) * (2 * k + s - 1)))
    return a, b


def legendre_recurrence(n: int) -> tuple[list[float], list[float]]:
    return jacobi_recurrence(n, 0.0, 0.0)


def chebyshev_recurrence(n: int) -> tuple[list[float], list[float]]:
    return jacobi_recurrence(n, -0.5, -0.5)


def values(a: list[float], b: list[float], x, n: int, derivative: int = 0) -> list:
    """p_0 to p_n at x (a column or an array), or a derivative of them."""
    zero = x * 0.0
    levels = [[zero + 1 / math.sqrt(b[0])]]
    for k in range(n):
        left = levels[0][k - 1] if k else zero
        levels[0].append(((x - a[k]) * levels[0][k] - math.sqrt(b[k]) * left) / math.sqrt(b[k + 1]))
    for d in range(1, derivative + 1):
        now, low = [zero], levels[d - 1]
        for k in range(n):
            left = now[k - 1] if k else zero
            now.append(((x - a[k]) * now[k] + d * low[k] - math.sqrt(b[k]) * left) / math.sqrt(b[k + 1]))
        levels.append(now)
    return levels[derivative]


def ratios(a: list[float], b: list[float], x, n: int) -> list:
    """p_1 / p_0 to p_n / p_{n-1}: where values grow out of range, these don't."""
    out = []
    for k in range(n):
        last = math.sqrt(b[k]) / out[-1] if out else 0.0
        out.append(((x - a[k]) - last) / math.sqrt(b[k + 1]))
    return out


def tensor(a: list[float], b: list[float], point: list, indices: list[tuple[int, ...]]) -> list:
    """Products over axes, one an index, scaled so that degree 0 is 1."""
    top, scale = max(max(i) for i in indices), math.sqrt(b[0])
    per = [[v * scale for v in values(a, b, x, top)] for x in point]
    return [math.prod((per[k][d] for k, d in enumerate(i[1:], 1)), start=per[0][i[0]]) for i in indices]


def centered(x, center: float, scale: float):
    return (x - center) / scale


def total_degree(dim: int, degree: int) -> list[tuple[int, ...]]:
    """Indices of a sum of at most `degree`: by sum, then the first coordinate falling."""
    every = (i for i in itertools.product(range(degree + 1), repeat=dim) if sum(i) <= degree)
    return sorted(every, key=lambda i: (sum(i), *(-x for x in i)))


def hyperbolic_cross(dim: int, degree: int) -> list[tuple[int, ...]]:
    """Indices whose product of (i + 1) is at most degree + 1, in lexicographic order."""
    if dim < 1 or degree < 0:
        raise ValueError("a dimension of at least 1 and a degree of at least 0 are needed")
    return [i for i in itertools.product(range(degree + 1), repeat=dim) if math.prod(x + 1 for x in i) <= degree + 1]


def index_table(spark, indices: list[tuple[int, ...]]) -> DataFrame:
    """(n, a0, a1, ...): indices in order."""
    dim = len(indices[0])
    return spark.createDataFrame([(n, *i) for n, i in enumerate(indices)], "n long, " + ", ".join(f"a{k} long" for k in range(dim)))


def gauss_legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights on [-1, 1]: eigenvalues of the recurrence's matrix, and the squares of its vectors' first entries."""
    a, b = legendre_recurrence(n)
    off = np.sqrt(b[1:])
    nodes, vectors = np.linalg.eigh(np.diag(a) + np.diag(off, 1) + np.diag(off, -1))
    return [(float(x), float(b[0] * v * v)) for x, v in zip(nodes, vectors[0])]


def sphere_quadrature(n: int) -> list[tuple[float, float, float, float]]:
    """(x, y, z, weight) on the unit sphere, exact to degree 2 n - 1: n rings at Gauss heights of 2 n even angles."""
    turns = [math.pi * (k + 0.5) / n for k in range(2 * n)]
    return [(math.sqrt(1 - z * z) * math.cos(t), math.sqrt(1 - z * z) * math.sin(t), z, w * math.pi / n) for z, w in gauss_legendre(n) for t in turns]


def triangle_quadrature(corners: list[tuple[float, float]], n: int) -> list[tuple[float, float, float]]:
    """(x, y, weight) on a triangle: its three quadrilaterals about the centroid, each by a product of n-point rules."""
    p = np.array(corners, float)
    center, middles, rule, out = p.mean(axis=0), [(p[k] + p[(k + 1) % 3]) / 2 for k in range(3)], gauss_legendre(n), []
    for k in range(3):
        quad = np.array([p[k], middles[k], center, middles[k - 1]])
        for (s, ws), (t, wt) in itertools.product(rule, rule):
            shape = np.array([(1 - s) * (1 - t), (1 + s) * (1 - t), (1 + s) * (1 + t), (1 - s) * (1 + t)]) / 4
            ds, dt = np.array([t - 1, 1 - t, 1 + t, -1 - t]) / 4 @ quad, np.array([s - 1, -1 - s, 1 + s, 1 - s]) / 4 @ quad
            out.append((*(shape @ quad), ws * wt * abs(ds[0] * dt[1] - ds[1] * dt[0])))
    return [tuple(map(float, r)) for r in out]


def quadrature_table(spark, rule: list[tuple[float, ...]], names: str) -> DataFrame:
    return spark.createDataFrame(rule, ", ".join(f"{n} double" for n in names.split()))


def integral(rule: DataFrame, f: Column) -> DataFrame:
    """One row: the weighted sum of f over a rule."""
    return rule.agg(F.sum(F.col("w") * f).alias("integral"))
