"""Linear solves, and stationary and time-dependent diffusion on scattered nodes.

nodes: (id, pos array<double>, kind 'interior' | 'boundary' | 'ghost', normal array<double> of boundary nodes, owner: of a
ghost, the boundary node it belongs to). The equation holds at interior and boundary nodes; each ghost's row holds the
boundary condition of its owner, so there are as many rows as unknowns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.functions.scalar import BDF, EXTRAPOLATION
from nodeweave.functions.stability import power_factors
from nodeweave.operators import coo, stencils
from nodeweave.sources.scratch import saved

#: Systems of at most so many unknowns are solved densely in one task (its matrix takes 128 MB); larger ones by iterations.
DENSE = 4000


def checked(a: DataFrame, b: DataFrame) -> None:
    """Raises if an entry's row or column is no id of b: neither way of solving knows what such an entry means."""
    ids = b.select("id").distinct()
    named = a.select(F.col("row").alias("id")).unionByName(a.select(F.col("col").alias("id"))).distinct()
    stray = named.join(ids, "id", "left_anti").take(1)
    if stray:
        raise ValueError(f"the matrix names {stray[0]['id']}, which has no right-hand side")


def dense_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """A x = b in one task, for systems of DENSE unknowns at most; ids of b are the unknowns. Missing entries are 0.
    Several right-hand sides: b with a column `rhs`, and so the result."""
    checked(a, b)
    many = "rhs" in b.columns
    right_side = b.select(F.col("id").alias("row"), F.lit(None).cast("long").alias("col"), F.col("v").alias("val"), (F.col("rhs") if many else F.lit(0)).cast("long").alias("rhs"))
    rows = a.select("row", "col", "val", F.lit(None).cast("long").alias("rhs")).unionByName(right_side)

    def run(batches):
        import pandas as pd

        whole = pd.concat([*batches, pd.DataFrame({"row": [], "col": [], "val": [], "rhs": []})])
        right = whole[whole["col"].isna()].groupby(["row", "rhs"])["val"].sum().unstack(fill_value=0.0)
        ids = right.index.to_numpy(np.int64)
        left = whole[whole["col"].notna()]
        matrix = np.zeros((len(ids), len(ids)))
        np.add.at(matrix, (np.searchsorted(ids, left["row"].to_numpy(np.int64)), np.searchsorted(ids, left["col"].to_numpy(np.int64))), left["val"].to_numpy(float))
        x = np.linalg.solve(matrix, right.to_numpy()) if len(ids) else np.zeros((0, 0))
        for k, name in enumerate(right.columns):
            yield pd.DataFrame({"id": ids, "rhs": np.full(len(ids), int(name)), "v": x[:, k]})

    out = rows.repartition(1).mapInPandas(run, "id long, rhs long, v double")
    return out if many else out.select("id", "v")


def _apply(a: DataFrame, state: DataFrame, column: str, name: str) -> DataFrame:
    """state with A times its column."""
    got = coo.spmv(a, state.select("id", F.col(column).alias("v"))).withColumnRenamed("v", name)
    return state.join(got, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _dots(state: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    row = state.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"_{k}") for k, (p, q) in enumerate(pairs)]).first()
    return [float(x or 0.0) for x in row]


def bicgstab(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """A x = b by stabilised biconjugate gradients with the diagonal as preconditioner.

    Vectors are columns of one table of unknowns, written to the shared folder each half step; only sums reach the driver.
    Raises if the residual isn't below tolerance times that of 0 after `most` rounds.
    """
    checked(a, b)
    a = saved(coo.coalesce(a), "matrix")
    d = coo.diagonal(a).select("id", F.when(F.col("v") == 0, 1.0).otherwise(F.col("v")).alias("d"))
    zero = F.lit(0.0)
    state = b.groupBy("id").agg(F.sum("v").alias("r")).join(d, "id", "left").withColumn("d", F.coalesce("d", F.lit(1.0)))
    state = saved(state.withColumns({"r0": F.col("r"), "x": zero, "p": zero, "ap": zero}), "krylov")
    (start,) = _dots(state, ("r", "r"))
    goal, rho, alpha, omega = start * tolerance**2, 1.0, 1.0, 1.0
    if start == 0:
        return state.select("id", F.col("x").alias("v"))
    for _ in range(most):
        (now,) = _dots(state, ("r0", "r"))
        if now == 0 or omega == 0:  # a breakdown: begin anew from the residual
            state = saved(state.withColumns({"r0": F.col("r"), "p": zero, "ap": zero}), "krylov")
            rho = alpha = omega = 1.0
            (now,) = _dots(state, ("r0", "r"))
        beta = now / rho * (alpha / omega)
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("ap"))).withColumn("y", F.col("p") / F.col("d"))
        state = saved(_apply(a, state.drop("ap"), "y", "ap"), "krylov")
        (down,) = _dots(state, ("r0", "ap"))
        rho, alpha = now, now / down if down else 0.0
        state = state.withColumn("s", F.col("r") - alpha * F.col("ap")).withColumn("z", F.col("s") / F.col("d"))
        state = saved(_apply(a, state, "z", "az"), "krylov")
        up, down = _dots(state, ("az", "s"), ("az", "az"))
        omega = up / down if down else 0.0
        state = state.withColumns({"x": F.col("x") + alpha * F.col("y") + omega * F.col("z"), "r": F.col("s") - omega * F.col("az")}).drop("s", "y", "z", "az")
        if _dots(state, ("r", "r"))[0] <= goal:
            return state.select("id", F.col("x").alias("v"))
    raise ArithmeticError(f"no solution to {tolerance} after {most} rounds")


def gmres(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, restart: int = 40, most: int = 400, guess: DataFrame | None = None, absolute: float = 1e-10) -> DataFrame:
    """A x = b by restarted GMRES with the diagonal as right preconditioner, orthogonalised twice.

    The basis is an array column of the unknowns' table; a step costs one product and two rows of sums. Ends at a residual of
    max(tolerance |b|, absolute); raises after `most` steps.
    """
    checked(a, b)
    a = saved(coo.coalesce(a), "matrix")
    d = coo.diagonal(a).select("id", F.when(F.col("v") == 0, 1.0).otherwise(F.col("v")).alias("d"))
    start = b.groupBy("id").agg(F.sum("v").alias("b")).join(d, "id", "left").withColumn("d", F.coalesce("d", F.lit(1.0)))
    start = start.join(guess.withColumnRenamed("v", "x"), "id", "left") if guess is not None else start.withColumn("x", F.lit(0.0))
    state = saved(start.withColumn("x", F.coalesce("x", F.lit(0.0))), "krylov")
    goal, done = max(tolerance * _dots(state, ("b", "b"))[0] ** 0.5, absolute), 0
    while True:
        state = saved(_apply(a, state, "x", "ax").select("id", "b", "d", "x", (F.col("b") - F.col("ax")).alias("r")), "krylov")
        beta = _dots(state, ("r", "r"))[0] ** 0.5
        if beta <= goal:
            return state.select("id", F.col("x").alias("v"))
        if done >= most:
            raise ArithmeticError(f"a residual of {beta} is left after {done} steps")
        base = saved(state.select("id", "d", F.array(F.col("r") / beta).alias("q")), "basis")
        h = np.zeros((restart + 1, restart))
        for j in range(restart):
            done += 1
            step = _apply(a, base.withColumn("z", F.element_at("q", -1) / F.col("d")), "z", "w").drop("z")
            step = saved(step, "basis")
            for _ in range(2):
                sums = step.agg(*[F.sum(F.col("q")[k] * F.col("w")).alias(f"_{k}") for k in range(j + 1)]).first()
                c = [float(x) for x in sums]
                h[: j + 1, j] += c
                step = step.withColumn("w", F.col("w") - sum((c[k] * F.col("q")[k] for k in range(1, j + 1)), c[0] * F.col("q")[0]))
            h[j + 1, j] = _dots(step, ("w", "w"))[0] ** 0.5
            right = np.zeros(j + 2)
            right[0] = beta
            y, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], right, rcond=None)
            left = float(np.linalg.norm(right - h[: j + 2, : j + 1] @ y))
            if left <= goal / 2 or h[j + 1, j] <= 1e-14 * beta or done >= most:
                break
            base = step.select("id", "d", F.concat("q", F.array(F.col("w") / float(h[j + 1, j]))).alias("q"))
        correction = base.select("id", (sum((float(y[k]) * F.col("q")[k] for k in range(1, len(y))), float(y[0]) * F.col("q")[0]) / F.col("d")).alias("_c"))
        state = saved(state.join(correction, "id").select("id", "b", "d", (F.col("x") + F.col("_c")).alias("x")), "krylov")


def conjugate_gradients(a: DataFrame, b: DataFrame, tolerance: float = 1e-12, most: int = 1000) -> DataFrame:
    """A x = b for a symmetric positive definite A and several right-hand sides: b and the result are (id, y array<double>).
    Each side has its own step lengths; one product a round serves all."""
    a = saved(coo.coalesce(a), "matrix")
    first = b.first()
    if first is None:
        return b
    n = len(first["y"])
    every = range(n)
    array = lambda f: F.array(*[f(k) for k in every])
    state = saved(b.select("id", array(lambda k: F.lit(0.0)).alias("x"), F.col("y").alias("r"), F.col("y").alias("p")), "krylov")
    sums = lambda df, p, q: [float(x or 0.0) for x in df.agg(*[F.sum(F.col(p)[k] * F.col(q)[k]).alias(f"_{k}") for k in every]).first()]
    now = start = sums(state, "r", "r")
    for _ in range(most):
        if all(x <= tolerance**2 * s for x, s in zip(now, start)):
            return state.select("id", F.col("x").alias("y"))
        wide = a.join(state.select(F.col("id").alias("col"), "p"), "col").groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("val") * F.col("p")[k]).alias(f"_{k}") for k in every])
        step = saved(state.join(wide.select("id", F.array(*[f"_{k}" for k in every]).alias("ap")), "id"), "krylov")
        alpha = [s / d if d else 0.0 for s, d in zip(now, sums(step, "p", "ap"))]
        step = saved(step.select("id", "p", array(lambda k: F.col("x")[k] + alpha[k] * F.col("p")[k]).alias("x"), array(lambda k: F.col("r")[k] - alpha[k] * F.col("ap")[k]).alias("r")), "krylov")
        after = sums(step, "r", "r")
        beta = [x / s if s else 0.0 for x, s in zip(after, now)]
        state, now = step.select("id", "x", "r", array(lambda k: F.col("r")[k] + beta[k] * F.col("p")[k]).alias("p")), after
    raise ArithmeticError(f"no solution to {tolerance} after {most} rounds")


def accepted(a: DataFrame, x: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """x if its backward error holds, |A x - b| <= tolerance (|A| |x| + |b|) in the largest norm, and NaN everywhere otherwise."""
    residual = coo.spmv(a, x).select("id", "v").unionByName(b.select("id", (-F.col("v")).alias("v"))).groupBy("id").agg(F.sum("v").alias("v"))
    largest = lambda df, c: df.agg(F.coalesce(F.max(F.abs(c)), F.lit(0.0)).alias("m"))
    rows = coo.coalesce(a).groupBy("row").agg(F.sum(F.abs("val")).alias("s"))
    m = largest(residual, "v").withColumnRenamed("m", "_r").crossJoin(largest(rows, "s").withColumnRenamed("m", "_a"))
    m = m.crossJoin(largest(x, "v").withColumnRenamed("m", "_x")).crossJoin(largest(b, "v").withColumnRenamed("m", "_b"))  # one row each
    good = m.select((F.col("_r") <= tolerance * (F.col("_a") * F.col("_x") + F.col("_b"))).alias("_ok"))
    return x.crossJoin(F.broadcast(good)).select("id", F.when(F.col("_ok"), F.col("v")).otherwise(float("nan")).alias("v"))


def arnoldi(a: DataFrame, ids: DataFrame, steps: int, seed: int = 0) -> np.ndarray:
    """Ritz values of A from `steps` Arnoldi steps, the largest modulus first; fewer where the space is exhausted. The basis is
    an array column of the unknowns' table, orthogonalised twice; only sums reach the driver."""
    a = saved(coo.coalesce(a), "matrix")
    start = saved(ids.select("id").distinct().withColumn("r", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2000003)) / 1000001.5 - 1.0)), "krylov")
    size = _dots(start, ("r", "r"))[0] ** 0.5
    if size == 0:
        return np.zeros(0, complex)
    base, h = start.select("id", F.array(F.col("r") / size).alias("q")), np.zeros((steps + 1, steps))
    for j in range(steps):
        step = saved(_apply(a, base.withColumn("z", F.element_at("q", -1)), "z", "w").drop("z"), "basis")
        for _ in range(2):
            c = [float(x) for x in step.agg(*[F.sum(F.col("q")[k] * F.col("w")).alias(f"_{k}") for k in range(j + 1)]).first()]
            h[: j + 1, j] += c
            step = step.withColumn("w", F.col("w") - sum((c[k] * F.col("q")[k] for k in range(1, j + 1)), c[0] * F.col("q")[0]))
        h[j + 1, j] = _dots(step, ("w", "w"))[0] ** 0.5
        if h[j + 1, j] <= 1e-12 * max(np.abs(h[: j + 1, : j + 1]).max(), 1e-300):
            steps = j + 1
            break
        base = step.select("id", F.concat("q", F.array(F.col("w") / float(h[j + 1, j]))).alias("q"))
    values = np.linalg.eigvals(h[:steps, :steps])
    return values[np.argsort(-np.abs(values), kind="stable")]


def factored_solve(a: DataFrame, b: DataFrame, ell: float, eta: float, power: int, **options) -> DataFrame:
    """(id, v) with (I + ell A + eta A ** power) v = b, one real factor after the other, so that A ** power is never formed."""
    a, ids = saved(coo.coalesce(a), "matrix"), b.select("id").distinct()
    square, x = None, b.select("id", "v")
    for f in power_factors(ell, eta, power):
        if f.imag:
            square = square if square is not None else saved(coo.matrix_power(a, 2), "square")
            system = coo.scaled_sum([(1.0, coo.identity(ids)), (-2 * f.real, a), (abs(f) ** 2, square)])
        else:
            system = coo.implicit_system(ids, a, -f.real)
        x = saved(solve(system, x, **options), "factor")
    return x


def solve(a: DataFrame, b: DataFrame, dense: int = DENSE, method: str | None = None, **options) -> DataFrame:
    """(id, v). Rows are scaled to a largest magnitude of 1 first. method: dense, gmres or bicgstab; by default dense up to
    `dense` unknowns and bicgstab above, which differ by the tolerance only."""
    top = coo.row_max(a)
    a = coo.equilibrated(a)
    b = b.join(top.withColumnRenamed("v", "_m"), "id", "left").select("id", (F.col("v") / F.coalesce("_m", F.lit(1.0))).alias("v"))
    method = method or ("dense" if b.count() <= dense else "bicgstab")
    return dense_solve(a, b) if method == "dense" else {"gmres": gmres, "bicgstab": bicgstab}[method](a, b, **options)


def assembled(nodes: DataFrame, dim: int, xi: int, width: float | None = None, dirichlet: float = 1.0, neumann: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The Laplacian's rows at interior and boundary nodes, and the rows of dirichlet * u + neumann * du/dn at ghosts."""
    rule = stencils.solver_rule(xi, 2, dim)
    every = nodes.select("id", "pos")
    size = (every, ["lap"], dim, rule["n"], rule["ell"], width, rule["phs"])
    lap = stencils.operators(nodes.where("kind <> 'ghost'").select("id", "pos"), *size)
    edge = nodes.where("kind = 'boundary'")
    slopes = [f"d{k}" for k in range(dim)]
    w = stencils.operators(edge.select("id", "pos"), every, ["interp", *slopes], *size[2:])
    w = w.join(edge.select(F.col("id").alias("row"), "normal"), "row")
    w = w.join(nodes.where("kind = 'ghost'").select(F.col("owner").alias("row"), F.col("id").alias("ghost")), "row")
    along = sum((F.col(c) * F.col("normal")[k] for k, c in enumerate(slopes)), F.lit(0.0))
    rows = w.select(F.col("ghost").alias("row"), "col", (dirichlet * F.col("interp") + neumann * along).alias("val"))
    return saved(lap.select("row", "col", F.col("lap").alias("val")), "laplacian"), saved(rows, "boundary")


def _right(nodes: DataFrame, inside: Column, edge: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, v): `inside` over the columns of nodes at interior and boundary nodes, edge(pos, normal) of the owner at ghosts."""
    own = nodes.where("kind = 'boundary'").select(F.col("id").alias("owner"), edge(F.col("pos"), F.col("normal")).alias("v"))
    ghosts = nodes.where("kind = 'ghost'").select("id", "owner").join(own, "owner").select("id", "v")
    return nodes.where("kind <> 'ghost'").select("id", inside.alias("v")).unionByName(ghosts)


def bordered(system: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A system that fixes its solution up to a constant only, with one more unknown and the sum of the others set to 0."""
    last = (right.agg(F.max("id")).first()[0] or 0) + 1
    one = right.sparkSession.createDataFrame([(last, 0.0)], "id long, v double")
    return coo.gauge(system, right, last), right.unionByName(one)


def poisson(
    nodes: DataFrame, forcing: Callable[[Column], Column], edge: Callable[[Column, Column], Column], dim: int = 2, xi: int = 2,
    width: float | None = None, dirichlet: float = 1.0, neumann: float = 0.0, **options,
) -> DataFrame:
    """(id, v): -Laplacian u = forcing(pos), with dirichlet * u + neumann * du/dn = edge(pos, normal). Without a Dirichlet
    part, u is the solution whose values add up to 0."""
    lap, rows = assembled(nodes, dim, xi, width, dirichlet, neumann)
    return _stationary(nodes, coo.scale(lap, -1.0).unionByName(rows), _right(nodes, forcing(F.col("pos")), edge), dirichlet, options)


def _stationary(nodes: DataFrame, system: DataFrame, right: DataFrame, dirichlet: float, options: dict) -> DataFrame:
    if dirichlet:
        return solve(system, right, **options)
    return solve(*bordered(system, right), **options).join(nodes.select("id"), "id", "left_semi")


def gradients(nodes: DataFrame, dim: int, xi: int, width: float | None) -> DataFrame:
    """(row, col, d0, d1, ...): the slopes at interior and boundary nodes, from all nodes given."""
    rule = stencils.solver_rule(xi, 1, dim)
    slopes = [f"d{k}" for k in range(dim)]
    own = nodes.where("kind <> 'ghost'").select("id", "pos")
    return saved(stencils.operators(own, nodes.select("id", "pos"), slopes, dim, rule["n"], rule["ell"], width, rule["phs"]), "slopes")


def _variable(lap: DataFrame, slopes: DataFrame, coefficient: DataFrame, dim: int) -> DataFrame:
    """The rows of -div(a grad): -a Laplacian - grad a . grad. coefficient: (id, v) at every node, ghosts too."""
    out = [coo.scale(coo.row_scale(lap, coefficient), -1.0)]
    for k in range(dim):
        d = slopes.select("row", "col", F.col(f"d{k}").alias("val"))
        out.append(coo.scale(coo.row_scale(d, coo.spmv(d, coefficient)), -1.0))
    return coo.add(*out)


def variable_poisson(
    nodes: DataFrame, forcing: Callable[[Column], Column], coefficient: Callable[[Column], Column], edge: Callable[[Column, Column], Column],
    dim: int = 2, xi: int = 2, width: float | None = None, dirichlet: float = 1.0, neumann: float = 0.0, **options,
) -> DataFrame:
    """(id, v): -div(coefficient(pos) grad u) = forcing(pos), with boundary conditions as in `poisson`."""
    lap, rows = assembled(nodes, dim, xi, width, dirichlet, neumann)
    a = nodes.select("id", coefficient(F.col("pos")).alias("v"))
    inner = _variable(lap, gradients(nodes, dim, xi, width), a, dim)
    return _stationary(nodes, inner.unionByName(rows), _right(nodes, forcing(F.col("pos")), edge), dirichlet, options)


def nonlinear_poisson(
    nodes: DataFrame, forcing: Callable[[Column, Column], Column], coefficient: Callable[[Column, Column], Column], edge: Callable[[Column, Column], Column],
    dim: int = 2, xi: int = 2, width: float | None = None, tolerance: float = 1e-8, most: int = 50, dirichlet: float = 1.0, neumann: float = 0.0, **options,
) -> tuple[DataFrame, int, float]:
    """-div(coefficient(pos, u) grad u) = forcing(pos, u): the solution (id, v), the rounds taken and the last change, relative
    to the solution's size. Each round solves the problem with coefficient and forcing of the one before; raises if the
    change isn't below tolerance after `most` rounds."""
    lap, rows = assembled(nodes, dim, xi, width, dirichlet, neumann)
    slopes, zero = gradients(nodes, dim, xi, width), F.lit(0.0)
    u = nodes.select("id", zero.alias("v"))
    for turn in range(1, most + 1):
        now = nodes.join(u, "id")
        a = now.select("id", coefficient(F.col("pos"), F.col("v")).alias("v"))
        right = _right(now, forcing(F.col("pos"), F.col("v")), edge)
        new = saved(_stationary(nodes, _variable(lap, slopes, a, dim).unionByName(rows), right, dirichlet, options), "iterate")
        size = new.join(u.withColumnRenamed("v", "w"), "id").agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("d"), F.max(F.abs("v")).alias("m")).first()
        u, change = new, (size["d"] or 0.0) / max(size["m"] or 0.0, 1e-300)
        if change <= tolerance:
            return u, turn, change
    raise ArithmeticError(f"a change of {change} is left after {most} rounds")


def diffusion_step(
    nodes: DataFrame, parts: tuple[DataFrame, DataFrame], history: list[DataFrame], dt: float, nu: float,
    forcing: Callable[[Column], Column], edge: Callable[[Column, Column], Column], explicit: DataFrame | None = None, **options,
) -> DataFrame:
    """One step of du/dt = nu * Laplacian u + forcing by backward differences of order len(history), the newest level first.
    parts: what `assembled` gives; levels are (id, v); forcing and edge hold at the new time; explicit (id, v): further terms
    of the right side, extrapolated to it."""
    share, levels = BDF[len(history)]
    lap, rows = parts
    ids = nodes.where("kind <> 'ghost'").select("id")
    terms = [level.select("id", (c * F.col("v")).alias("v")) for c, level in zip(levels, history)]
    if explicit is not None:
        terms.append(explicit.select("id", (share * dt * F.col("v")).alias("v")))
    past = reduce(DataFrame.unionByName, terms).groupBy("id").agg(F.sum("v").alias("_past"))
    full = nodes.join(past, "id", "left")
    right = _right(full, F.coalesce("_past", F.lit(0.0)) + share * dt * forcing(F.col("pos")), edge)
    return solve(coo.implicit_system(ids, lap, -share * dt * nu).unionByName(rows), right, **options)


def march(
    nodes: DataFrame, initial: Callable[[Column], Column], dt: float, steps: int, nu: float, forcing: Callable[[float, Column], Column],
    edge: Callable[[float, Column, Column], Column], order: int = 3, dim: int = 2, xi: int = 2, width: float | None = None,
    reaction: Callable[[float, Column, Column], Column] | None = None, velocity: Callable[[float, Column], list[Column]] | None = None,
    dirichlet: float = 1.0, neumann: float = 0.0, past: list[DataFrame] | None = None, **options,
) -> DataFrame:
    """(id, v) after `steps` steps of du/dt + velocity . grad u = nu Laplacian u + forcing + reaction(t, pos, u).

    Diffusion is implicit; advection and reaction are extrapolated from the levels before. The order rises with the levels
    there are, up to `order`; past: levels before the initial one, the newest first, to start at full order.
    """
    parts = assembled(nodes, dim, xi, width, dirichlet, neumann)
    slopes = gradients(nodes.where("kind <> 'ghost'"), dim, xi, width) if velocity else None  # levels that are given have no ghosts
    own = saved(nodes.where("kind <> 'ghost'").select("id", initial(F.col("pos")).alias("v")), "level")
    levels = [own, *(past or [])]

    def terms(t: float, level: DataFrame) -> DataFrame:
        at = nodes.where("kind <> 'ghost'").select("id", "pos").join(level, "id")
        rate = reaction(t, F.col("pos"), F.col("v")) if reaction else F.lit(0.0)
        if velocity:
            for k, speed in enumerate(velocity(t, F.col("pos"))):
                d = coo.spmv(slopes.select("row", "col", F.col(f"d{k}").alias("val")), level).withColumnRenamed("v", f"_g{k}")
                at, rate = at.join(d, "id", "left"), rate - speed * F.coalesce(f"_g{k}", F.lit(0.0))
        return saved(at.select("id", rate.alias("v")), "terms")

    moves = reaction is not None or velocity is not None
    rates = [terms(-k * dt, level) for k, level in enumerate(levels)] if moves else []
    for n in range(1, steps + 1):
        m, t = min(order, len(levels)), n * dt
        explicit = None
        if moves:
            explicit = reduce(DataFrame.unionByName, [r.select("id", (c * F.col("v")).alias("v")) for c, r in zip(EXTRAPOLATION[m], rates)]).groupBy("id").agg(F.sum("v").alias("v"))
        got = diffusion_step(nodes, parts, levels[:m], dt, nu, lambda p: forcing(t, p), lambda p, nu_: edge(t, p, nu_), explicit, **options)
        new = saved(got, "level")
        levels = [new, *levels][:order]
        rates = [terms(t, new), *rates][:order] if moves else []
    return levels[0]
