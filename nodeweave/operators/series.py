"""Histories, reductions and id sets: windows by entity, global sums, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.functions.scalar import BDF, EXTRAPOLATION


def _combined(value: str, weights: tuple[float, ...], order) -> Column:
    out = F.lit(weights[0]) * F.col(value)
    for k, w in enumerate(weights[1:], 1):
        out = out + F.lit(w) * F.lag(value, k).over(order)
    return out


def bdf_rhs(rows: DataFrame, key: str, by: str, value: str, order: int) -> DataFrame:
    """`rhs`: the known side of a backward difference of the given order, from a row's value and those before it; null while there are too few."""
    return rows.withColumn("rhs", _combined(value, BDF[order][1], Window.partitionBy(key).orderBy(by)))


def extrapolated(rows: DataFrame, key: str, by: str, value: str, order: int) -> DataFrame:
    return rows.withColumn("next", _combined(value, EXTRAPOLATION[order], Window.partitionBy(key).orderBy(by)))


def material_velocity(rows: DataFrame, key: str, by: str, value: str, dt: float, order: int = 3) -> DataFrame:
    """Backward-difference derivative of the newest of each row's levels."""
    implicit, known = BDF[order]
    before = F.lit(known[0]) * F.lag(value, 1).over(Window.partitionBy(key).orderBy(by))
    for k, w in enumerate(known[1:], 2):
        before = before + F.lit(w) * F.lag(value, k).over(Window.partitionBy(key).orderBy(by))
    return rows.withColumn("velocity", (F.col(value) - before) / (implicit * dt))


def observed_rates(errors: DataFrame, h: str = "h", error: str = "error") -> DataFrame:
    """ln(e_{i-1} / e_i) / ln(h_{i-1} / h_i) by falling h. A study has few rows, so one window is enough."""
    w = Window.orderBy(F.desc(h))
    return errors.withColumn("rate", F.log(F.lag(error).over(w) / F.col(error)) / F.log(F.lag(h).over(w) / F.col(h)))


def loglog_slope(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(F.log(y), F.log(x)).alias("slope"))


def normalizer(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of mean_ and std_ (ddof 0, 1 where it is 0) of each column."""
    sd = lambda c: F.stddev_pop(c)
    return rows.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.when(sd(c) == 0, 1.0).otherwise(sd(c)).alias(f"std_{c}") for c in columns])


def normalised(rows: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """The fit has one row, so it is broadcast."""
    out = rows.crossJoin(F.broadcast(fit))
    return out.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}).select(*rows.columns)


def errors(rows: DataFrame, got: str, want: str) -> DataFrame:
    """l2 (root mean square), linf and relative l2 of got against want."""
    e = F.col(got) - F.col(want)
    return rows.agg(F.sqrt(F.avg(e * e)).alias("l2"), F.max(F.abs(e)).alias("linf"), F.sqrt(F.sum(e * e) / F.sum(F.col(want) * F.col(want))).alias("rel_l2"))


def mean_relative(rows: DataFrame, sample: str, got: str, want: str) -> DataFrame:
    e = F.col(got) - F.col(want)
    each = rows.groupBy(sample).agg(F.sqrt(F.sum(e * e) / F.sum(F.col(want) * F.col(want))).alias("r"))
    return each.agg(F.avg("r").alias("mean_relative"))


def mass_shift(rows: DataFrame, weight: str, value: str, target: float) -> DataFrame:
    """value moved by one number so that the weighted sum is target."""
    fix = rows.agg(((F.lit(target) - F.sum(F.col(weight) * F.col(value))) / F.sum(weight)).alias("_shift"))
    return rows.crossJoin(F.broadcast(fix)).withColumn(value, F.col(value) + F.col("_shift")).drop("_shift")


def entered(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    return current.join(previous.select(key).distinct(), key, "left_anti")


def left(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    return entered(previous, current, key)


def persisted(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    return current.join(previous.select(key).distinct(), key, "left_semi")


def transitions(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """(id, status) of every id in either table, from one grouping instead of three joins."""
    both = current.select(key, F.lit(1).alias("c")).unionByName(previous.select(key, F.lit(2).alias("c")))
    seen = both.groupBy(key).agg(F.bit_or("c").alias("c"))
    return seen.select(key, F.when(F.col("c") == 1, "entered").when(F.col("c") == 2, "left").otherwise("persisted").alias("status"))


def disjoint(splits: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are in more than one split."""
    return splits.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(key)


def bounding_box(points: DataFrame, columns: list[str]) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def gaussian_normalizer(rows: DataFrame, column: str, decode: bool = False, eps: float = 1e-7, fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (std + eps) of a column, or back; the mean and std (ddof 0) are those of `fit`, or of rows themselves."""
    one = (rows if fit is None else fit).agg(F.avg(column).alias("_m"), (F.stddev_pop(column) + eps).alias("_s"))
    x = F.col(column)
    to = x * F.col("_s") + F.col("_m") if decode else (x - F.col("_m")) / F.col("_s")
    return rows.crossJoin(F.broadcast(one)).withColumn(column, to).drop("_m", "_s")


def mean_mass(rows: DataFrame, columns: list[str], measure: float) -> DataFrame:
    """One row: measure times the mean of each column."""
    return rows.agg(*[(F.lit(measure) * F.avg(c)).alias(c) for c in columns])


def with_mass(rows: DataFrame, column: str, measure: float, target: float, mode: str | None = None) -> DataFrame:
    """rows whose column is moved along `mode` (default: everywhere by one number) until measure times its mean is target."""
    m = F.col(mode) if mode else F.lit(1.0)
    one = rows.agg((F.lit(measure) * F.avg(column)).alias("_now"), F.greatest(F.abs(F.lit(measure) * F.avg(m)), F.lit(1e-14)).alias("_unit"))
    return rows.crossJoin(F.broadcast(one)).withColumn(column, F.col(column) + m * ((F.lit(target) - F.col("_now")) / F.col("_unit"))).drop("_now", "_unit")


def residual_size(rows: DataFrame, column: str) -> DataFrame:
    """One row: root mean square and largest magnitude, 0 of nothing."""
    x = F.col(column)
    zero = F.lit(0.0)
    return rows.agg(F.coalesce(F.sqrt(F.avg(x * x)), zero).alias("rms"), F.coalesce(F.max(F.abs(x)), zero).alias("largest"))


def divergence(operators: list[DataFrame], velocity: list[DataFrame]) -> DataFrame:
    """(id, v): the sum over axes of an operator's product with that axis' component."""
    from functools import reduce

    from nodeweave.operators import coo

    parts = [coo.spmv(a, u) for a, u in zip(operators, velocity)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("v").alias("v"))


def wall_residual(normals: DataFrame, velocity: DataFrame, prescribed: DataFrame) -> DataFrame:
    """(id, v): normal . velocity - prescribed at wall nodes; normals (id, normal), velocity (id, u: array), prescribed (id, v)."""
    dot = F.aggregate(F.zip_with("normal", "u", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return normals.join(velocity, "id").join(prescribed.withColumnRenamed("v", "_p"), "id", "left").select("id", (dot - F.coalesce("_p", F.lit(0.0))).alias("v"))


def crossings(rows: DataFrame, key: str, by: str, value: str, threshold: float, steps: float) -> DataFrame:
    """rows with `predicted`, the value `steps` further if it goes on as it last rose, and whether that reaches the threshold."""
    from nodeweave.functions.scalar import quality_crossing

    before = F.lag(value).over(Window.partitionBy(key).orderBy(by))
    will, ahead = quality_crossing(F.coalesce(before, F.col(value)), F.col(value), threshold, steps)
    return rows.withColumns({"predicted": ahead, "crosses": will})


def structure_function(pairs: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bin, r, value): the mean of `increment` over the pairs of each of `bins` log-spaced distances `d` from low to high, and
    the bins' geometric middles."""
    import math

    step = math.log(high / low) / bins
    at = pairs.where((F.col("d") >= low) & (F.col("d") < high)).withColumn("bin", F.least(F.floor(F.log(F.col("d") / low) / step), F.lit(bins - 1)))
    return at.groupBy("bin").agg(F.avg("increment").alias("value")).select("bin", (low * F.exp((F.col("bin") + 0.5) * step)).alias("r"), "value")


def rms_components(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the root mean square of each column."""
    return rows.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in columns])


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes with the set of rows and not with their order: their count, and the exclusive or and the sum,
    modulo 2^31, of their hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("total"))
