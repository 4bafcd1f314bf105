"""Stability of implicit-explicit backward differences, and factors of operator polynomials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sbdf3_polynomial(zi, ze) -> list:
    """Coefficients, the highest power first, of one mode's third-order step: zi = dt * implicit part, ze = dt * explicit part."""
    return [11.0 - 6.0 * zi, -18.0 - 18.0 * ze, 9.0 + 18.0 * ze, -2.0 - 6.0 * ze]


def sbdf3_stable(zi: Column, ze: Column) -> Column:
    """Whether all roots for real modes lie inside the unit circle, by the Jury conditions; null where the leading coefficient is 0."""
    lead, *rest = sbdf3_polynomial(zi, ze)
    b1, b2, b3 = [F.try_divide(c, lead) for c in rest]
    return (1 + b1 + b2 + b3 > 0) & (1 - b1 + b2 - b3 > 0) & (F.abs(b3) < 1) & (F.abs(b2 - b1 * b3) < 1 - b3 * b3)


def roots(coefficients: np.ndarray) -> np.ndarray:
    """(n, degree) roots of n polynomials, the highest power first, as eigenvalues of stacked companion matrices."""
    c = np.asarray(coefficients, complex)
    if not np.isfinite(c).all() or (c[:, 0] == 0).any():
        raise ValueError("a polynomial is singular or not finite")
    n, degree = c.shape[0], c.shape[1] - 1
    m = np.zeros((n, degree, degree), complex)
    m[:, np.arange(1, degree), np.arange(degree - 1)] = 1
    m[:, 0] = -c[:, 1:] / c[:, :1]
    return np.linalg.eigvals(m)


def sbdf3_growth(modes: DataFrame) -> DataFrame:
    """(id, growth): the largest modulus of a root for each real mode (id, zi, ze)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                c = np.stack([np.broadcast_to(x, len(b)) for x in sbdf3_polynomial(b["zi"].to_numpy(float), b["ze"].to_numpy(float))], axis=1)
                yield pd.DataFrame({"id": b["id"], "growth": np.abs(roots(c)).max(axis=1)})

    return modes.select("id", "zi", "ze").mapInPandas(run, "id long, growth double")


def largest_stable_step(values, nu: float, gamma: float, power: int, upper: float, rounds: int = 50, slack: float = 1e-10) -> float:
    """The largest dt up to `upper` at which no mode grows, by halving: diffusion nu * value implicit, gamma * value ** power
    explicit, for (complex) eigenvalue estimates. Halving takes the first unstable dt it meets as a bound; 0 if none is found."""
    v = np.atleast_1d(np.asarray(values, complex))

    def stable(dt: float) -> bool:
        c = np.stack([np.broadcast_to(x, v.shape) for x in sbdf3_polynomial(dt * nu * v, dt * gamma * v**power)], axis=1)
        return bool(np.abs(roots(c)).max() <= 1 + slack)

    low, high = 0.0, upper
    if stable(upper):
        return upper
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if stable(middle) else (low, middle)
    return low


def power_factors(ell: float, eta: float, power: int) -> list[complex]:
    """The inverses of the roots of 1 + ell z + eta z ** power, of each conjugate pair the one with positive imaginary part:
    the polynomial is the product of 1 - f z over real f, and of 1 - 2 Re(f) z + |f|^2 z^2 over the others."""
    if power < 2 or not ell or not eta or not np.isfinite([ell, eta]).all():
        raise ValueError("a power of 2 at least and finite coefficients other than 0 are needed")
    c = np.zeros(power + 1)
    c[0], c[-1], c[-2] = eta, 1.0, ell
    found = 1 / roots(c[None])[0]
    near = 2e-10 * np.maximum(1.0, np.abs(found))
    out = [complex(f.real, 0.0) for f, e in zip(found, near) if abs(f.imag) <= e] + [complex(f) for f, e in zip(found, near) if f.imag > e]
    if sum(1 if not f.imag else 2 for f in out) != power:
        raise ValueError("roots are not conjugate within tolerance")
    return out
