"""Learning maps between functions: compact kernels between training inputs, their fit and predictions.

inputs are (id, pos array<double>), outputs (id, y array<double>). Pairs at a distance of 1 / epsilon or more have a kernel
of 0, so only the others are stored, found by blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.operators import coo, solvers, spatial
from nodeweave.sources.scratch import saved


def normalised_inputs(inputs: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """inputs with each coordinate less its mean and over its deviation (ddof 0) in `fit` (default: inputs); 0 where that is 0."""
    per = (inputs if fit is None else fit).select(F.posexplode("pos").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    one = per.agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("_f"))  # a coordinate each
    to = F.zip_with("pos", "_f", lambda x, f: F.when(f["s"] == 0, 0.0).otherwise((x - f["m"]) / F.when(f["s"] == 0, 1.0).otherwise(f["s"])))
    return inputs.crossJoin(F.broadcast(one)).withColumn("pos", to).drop("_f")


def kernel(queries: DataFrame, inputs: DataFrame, epsilon: float) -> DataFrame:
    """(row, col, val): three times the compact kernel of epsilon times the distance, where it isn't 0."""
    dim = len((inputs.first() or {"pos": []})["pos"])
    near = spatial.ball(queries, inputs, 1 / epsilon, dim).withColumn("s", F.sqrt("d2") * epsilon).where("s < 1")
    return near.select(F.col("q").alias("row"), F.col("p").alias("col"), (3.0 * scalar.wendland_c4("s")).alias("val"))


def training_kernel(inputs: DataFrame, epsilon: float, nugget: float = 0.0) -> DataFrame:
    k = kernel(inputs, inputs, epsilon)
    return k.withColumn("val", F.when(F.col("row") == F.col("col"), F.col("val") + nugget).otherwise(F.col("val")))


def fit(inputs: DataFrame, outputs: DataFrame, epsilon: float, nugget: float = 0.0, **options) -> DataFrame:
    """(id, y): coefficients whose kernel sums reproduce the outputs, all outputs of a sample at once."""
    return saved(solvers.conjugate_gradients(training_kernel(inputs, epsilon, nugget), outputs.select("id", "y"), **options), "coefficients")


def predict(queries: DataFrame, inputs: DataFrame, coefficients: DataFrame, epsilon: float) -> DataFrame:
    """(id, y) of each query; a query that no training input reaches has zeros."""
    first = coefficients.first()
    n = len(first["y"]) if first else 0
    met = kernel(queries, inputs, epsilon).join(coefficients.select(F.col("id").alias("col"), "y"), "col")
    sums = met.groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("val") * F.col("y")[k]).alias(f"_{k}") for k in range(n)])
    return queries.select("id").join(sums, "id", "left").select("id", F.array(*[F.coalesce(f"_{k}", F.lit(0.0)) for k in range(n)]).alias("y"))


def lagrange_map(queries: DataFrame, inputs: DataFrame, epsilon: float, nugget: float = 0.0) -> DataFrame:
    """(row, col, val) of H = K(queries, inputs) K^-1: weights of each training output. Dense: for training sets of up to
    solvers.DENSE inputs, one right-hand side each."""
    k = training_kernel(inputs, epsilon, nugget)
    unit = inputs.select("id", F.col("id").alias("rhs"), F.lit(1.0).alias("v")).crossJoin(inputs.select(F.col("id").alias("o")))
    unit = unit.select(F.col("o").alias("id"), "rhs", F.when(F.col("o") == F.col("rhs"), 1.0).otherwise(0.0).alias("v"))
    inverse = solvers.dense_solve(k, unit).select(F.col("id").alias("row"), F.col("rhs").alias("col"), F.col("v").alias("val"))
    return coo.spgemm(kernel(queries, inputs, epsilon), inverse)


def sparsity(inputs: DataFrame, epsilon: float) -> float:
    """The share of pairs, both orders and a sample with itself included, whose kernel is 0."""
    n = inputs.count()
    return 1 - kernel(inputs, inputs, epsilon).count() / n**2


def epsilon_for_sparsity(inputs: DataFrame, target: float, tolerance: float = 1e-3, rounds: int = 60, upper: float = 1.0) -> tuple[float, float]:
    """(epsilon, its sparsity) by halving, until the sparsity is within tolerance of the target; the best one met if none is.

    Distances of pairs are counted once, in bins of equal ratio, so a step of the search reads a table of bins; the sparsity
    that is returned is counted in full.
    """
    n = inputs.count()
    if not n or not 0 <= target <= 1 - 1 / n:
        raise ValueError("a sparsity between 0 and that of the diagonal alone is needed")
    dim = len(inputs.first()["pos"])
    far = inputs.select(F.posexplode("pos").alias("k", "x")).groupBy("k").agg((F.max("x") - F.min("x")).alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    reach = math.sqrt(far or 0.0)
    if target > 0 and not reach:
        raise ValueError("inputs that coincide make the sparsity unattainable")
    if target == 0:
        best = 0.25 / reach if reach else 1.0
        return best, sparsity(inputs, best)
    d = spatial.ball(inputs, inputs, reach * (1 + 1e-9) + 1e-300, dim).select(F.sqrt("d2").alias("d"))
    fine = 1e-4
    bins = saved(d.groupBy(F.when(F.col("d") > 0, F.floor(F.log("d") / fine)).alias("b")).agg(F.count(F.lit(1)).alias("c")), "bins")
    table = sorted(((-math.inf if r["b"] is None else r["b"] * fine), r["c"]) for r in bins.collect())  # some 10,000 bins an order of magnitude
    below = lambda e: 1 - sum(c for low, c in table if low < -math.log(e)) / n**2
    if target > 1 - sum(c for low, c in table if low == -math.inf) / n**2 + tolerance:
        raise ValueError("inputs that coincide make the sparsity unattainable")
    low, high = 0.0, upper
    while below(high) < target:
        high *= 2
    best = high
    for _ in range(rounds):
        middle = (low + high) / 2
        s = below(middle)
        if abs(s - target) < abs(below(best) - target):
            best = middle
        if abs(s - target) <= tolerance:
            break
        low, high = (middle, high) if s < target else (low, middle)
    return best, sparsity(inputs, best)


def select_epsilon(inputs: DataFrame, outputs: DataFrame, held: DataFrame, truth: DataFrame, choices: list[float], nugget: float = 0.0) -> tuple[float, list[tuple[float, float]]]:
    """The choice with the least mean relative error on held-out samples, and the error of each: (epsilon, error)."""
    found = []
    for e in choices:
        got = predict(held, inputs, fit(inputs, outputs, e, nugget), e).withColumnRenamed("y", "g")
        d2 = scalar.squared_distance("y", "g")
        size = F.aggregate("y", F.lit(0.0), lambda s, t: s + t * t)
        found.append((e, truth.join(got, "id").agg(F.avg(F.sqrt(d2 / size))).first()[0]))
    return min(found, key=lambda x: x[1])[0], found
