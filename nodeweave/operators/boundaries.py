"""Moving boundaries as closed curves and surfaces over fixed parameter sites.

Coordinates are splines of the chord between parameters: r^7 on the circle, r^8 ln r on the sphere (fixed values). Seeds are
few (SEEDS at most) and their dense system is solved once; the many samples are evaluated in parallel from the coefficients.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.operators import greedy

#: Seeds of one boundary at most: their dense system takes 128 MB.
SEEDS = 4000
_EPS = float(np.finfo(float).eps)


def _circle(theta: np.ndarray, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = theta[:, None] - sites[None]
    r = np.sqrt(np.maximum(2 * (1 - np.cos(d)), 0.0)) + _EPS
    return r**7, 7 * np.sin(d) * r**5


def _ball(x: np.ndarray, sites: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, and the factor and differences whose product is the gradient."""
    d = x[:, None] - sites[None]
    r = np.sqrt((d * d).sum(-1))
    log = np.log(r + _EPS)
    return r**8 * log, r**6 * (8 * log + 1), d


def _sites(seeds: DataFrame, dim: int) -> np.ndarray:
    rows = seeds.select("id", "pos").orderBy("id").limit(SEEDS + 1).collect()
    if not rows or len(rows) > SEEDS:
        raise ValueError(f"a boundary has 1 to {SEEDS} seeds")
    x = np.array([r["pos"] for r in rows], float)
    if x.shape[1] != dim or not np.isfinite(x).all():
        raise ValueError("seeds have finite coordinates of the space's dimension")
    return x


class ClosedBoundary:
    """The parameters of a first set of seeds, kept while the seeds move. Seeds (id, pos) are taken in the order of their ids:
    around the curve in the plane; in space, in the directions from their mean."""

    def __init__(self, seeds: DataFrame, dim: int):
        x = _sites(seeds, dim)
        self.dim, self.count = dim, len(x)
        if dim == 2:
            self.parameters = np.linspace(-math.pi, math.pi, len(x), endpoint=False)
            matrix = _circle(self.parameters, self.parameters)[0]
        else:
            d = x - x.mean(axis=0)
            size = np.sqrt((d * d).sum(-1, keepdims=True))
            if (size <= 100 * _EPS * size.max()).any():
                raise ValueError("seeds need directions from their mean")
            self.parameters = d / size
            matrix = _ball(self.parameters, self.parameters)[0]
        self.inverse = np.linalg.inv(matrix)

    def samples(self, seeds: DataFrame, count: int) -> DataFrame:
        """(id, pos, normal outward of length 1) at `count` evenly spread parameters, for the seeds where they are now."""
        x = _sites(seeds, self.dim)
        if len(x) != self.count:
            raise ValueError("the number of seeds has changed")
        c, parameters, dim, mean = self.inverse @ x, self.parameters, self.dim, x.mean(axis=0)
        at = seeds.sparkSession.range(count)
        if dim == 2:
            at = at.select("id", F.array(F.lit(-math.pi) + F.col("id") * (2 * math.pi / count)).alias("at"))
        else:
            at = at.select("id", F.array(*scalar.fibonacci_sphere("id", count)).alias("at"))

        def run(batches):
            import pandas as pd

            for b in batches:
                for lo in range(0, len(b), 1024):
                    part = b.iloc[lo : lo + 1024]
                    u = np.stack(part["at"].to_list())
                    if dim == 2:
                        value, slope = _circle(u[:, 0], parameters)
                        t = slope @ c
                        normal = np.stack([t[:, 1], -t[:, 0]], axis=1)
                        pos = value @ c
                    else:
                        value, factor, d = _ball(u, parameters)
                        jacobian = np.einsum("ms,msk,sj->mkj", factor, d, c)
                        axis = np.where(np.abs(u[:, 2:]) > 0.9, [[1.0, 0, 0]], [[0, 0, 1.0]])
                        one = np.cross(axis, u)
                        one /= np.sqrt((one * one).sum(-1, keepdims=True))
                        two = np.cross(u, one)
                        normal = np.cross(np.einsum("mk,mkj->mj", one, jacobian), np.einsum("mk,mkj->mj", two, jacobian))
                        pos = value @ c
                    normal /= np.maximum(np.sqrt((normal * normal).sum(-1, keepdims=True)), _EPS)
                    if len(part):
                        yield pd.DataFrame({"id": part["id"].to_numpy(), "pos": list(pos), "normal": list(normal)})

        out = at.mapInPandas(run, "id long, pos array<double>, normal array<double>")
        if dim == 2:
            return out
        away = sum(((F.col("pos")[k] - float(mean[k])) * F.col("normal")[k] for k in range(1, 3)), (F.col("pos")[0] - float(mean[0])) * F.col("normal")[0])
        sign = -1.0 if (out.agg(F.avg(away)).first()[0] or 0.0) < 0 else 1.0
        return out.withColumn("normal", F.transform("normal", lambda v: v * sign))

    def spaced(self, seeds: DataFrame, h: float) -> DataFrame:
        """Samples, thinned in their order to distances above 0.9 h; their number before that follows the seeds' box."""
        x = _sites(seeds, self.dim)
        _, axes = np.linalg.eigh(np.cov(x, rowvar=False))
        sides = np.ptp(x @ axes, axis=0)
        if self.dim == 2:
            count = 2 * max(8, int(2 * sides.sum() / h))
        else:
            count = 5 * max(12, int(2 * (sides[0] * sides[1] + sides[1] * sides[2] + sides[0] * sides[2]) / h**2))
        return greedy.thinned(self.samples(seeds, count), 0.9 * h, self.dim)
