"""Sparse matrices as tables (row, col, val), vectors as (id, v). Entries may repeat and then add up.

Every operator is joins and sums on row or column keys, pre-aggregated before rows move; none collects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.operators.joins import shuffled


def coalesce(a: DataFrame) -> DataFrame:
    """One entry a position."""
    return a.groupBy("row", "col").agg(F.sum("val").alias("val"))


def scale(a: DataFrame, factor: float | Column) -> DataFrame:
    return a.select("row", "col", (F.col("val") * factor).alias("val"))


def row_scale(a: DataFrame, d: DataFrame) -> DataFrame:
    """diag(d) A; rows without a factor vanish."""
    return a.join(d.select(F.col("id").alias("row"), "v"), "row").select("row", "col", (F.col("val") * F.col("v")).alias("val"))


def add(*matrices: DataFrame) -> DataFrame:
    return coalesce(reduce(DataFrame.unionByName, [m.select("row", "col", "val") for m in matrices]))


def scaled_sum(terms: list[tuple[float, DataFrame]]) -> DataFrame:
    return add(*[scale(a, c) for c, a in terms])


def shift(a: DataFrame, rows: int = 0, cols: int = 0) -> DataFrame:
    return a.select((F.col("row") + rows).alias("row"), (F.col("col") + cols).alias("col"), "val")


def stack(*matrices: DataFrame, heights: list[int]) -> DataFrame:
    """Matrices one below the other."""
    starts = [sum(heights[:k]) for k in range(len(matrices))]
    return reduce(DataFrame.unionByName, [shift(a, s) for a, s in zip(matrices, starts)])


def block(a: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Rows r0 to r1 and columns c0 to c1, ends exclusive, counted from 0 again. The ranges reach the scan as filters."""
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return shift(a.where(inside), -r0, -c0)


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("row = col").groupBy(F.col("row").alias("id")).agg(F.sum("val").alias("v"))


def identity(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def implicit_system(ids: DataFrame, a: DataFrame, s: float) -> DataFrame:
    """I + s A."""
    return add(identity(ids), scale(a, s))


def gauge(a: DataFrame, ids: DataFrame, last: int) -> DataFrame:
    """A bordered by a row and a column of ones at `last`, for systems that fix a solution up to a constant."""
    down = ids.select(F.lit(last).cast("long").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))
    right = ids.select(F.col("id").alias("row"), F.lit(last).cast("long").alias("col"), F.lit(1.0).alias("val"))
    return a.select("row", "col", "val").unionByName(down).unionByName(right)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x as (id, v); rows of A without a match are absent, that is 0."""
    return a.join(x.select(F.col("id").alias("col"), F.col("v").alias("_x")), "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("val") * F.col("_x")).alias("v"))


def spmm(a: DataFrame, x: DataFrame, rhs: str = "rhs") -> DataFrame:
    """A times several vectors at once: x (id, rhs, v)."""
    return a.join(shuffled(x.select(F.col("id").alias("col"), rhs, F.col("v").alias("_x"))), "col").groupBy(F.col("row").alias("id"), rhs).agg(F.sum(F.col("val") * F.col("_x")).alias("v"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B. Both sides are coalesced first, so repeated entries multiply once."""
    left = coalesce(a).withColumnRenamed("col", "_k")
    right = coalesce(b).select(F.col("row").alias("_k"), F.col("col"), F.col("val").alias("_v"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


def edge_products(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(L R^T)[i, j] for the listed (i, j) only; left and right: (id, x array<double>)."""
    a = edges.join(left.select(F.col("id").alias("row"), F.col("x").alias("_l")), "row").join(right.select(F.col("id").alias("col"), F.col("x").alias("_r")), "col")
    dot = F.aggregate(F.zip_with("_l", "_r", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return a.select("row", "col", dot.alias("val"))


def row_max(a: DataFrame) -> DataFrame:
    """The largest magnitude of each row, 1 where it is 0: factors of row equilibration."""
    return a.groupBy(F.col("row").alias("id")).agg(F.max(F.abs("val")).alias("m")).select("id", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")).alias("v"))


def equilibrated(a: DataFrame) -> DataFrame:
    return row_scale(a, row_max(a).select("id", (1.0 / F.col("v")).alias("v")))


def indptr(a: DataFrame, heads: int = 256) -> DataFrame:
    """(row, indptr): entries before each stored row. Totals of row buckets are summed first, so no task sorts all rows."""
    counts = a.groupBy("row").agg(F.count(F.lit(1)).alias("c"))
    span = counts.agg(F.min("row").alias("lo"), F.max("row").alias("hi")).first()
    lo, width = span["lo"] or 0, max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // heads + 1)
    counts = counts.withColumn("_h", F.expr(f"(row - {lo}) div {width}"))
    order = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)  # over `heads` rows
    before = counts.groupBy("_h").agg(F.sum("c").alias("t")).select("_h", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("_h").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(F.broadcast(before), "_h").select("row", (F.col("_b") + F.coalesce(F.sum("c").over(inner), F.lit(0))).alias("indptr"))


def schur_diagonal(a: DataFrame, physical: int, boundary: int = 0) -> DataFrame:
    """Diagonal of a block preconditioner, ids 0 to physical + boundary: that of A11 (block 1 is below `physical`), then
    that of A22 - A21 diag(A11)^-1 A12. Diagonals below the rounding unit, and those of rows without an entry, count as 1."""
    c = coalesce(a)
    sound = lambda x: F.when(F.abs(x) < 2.0**-52, 1.0).otherwise(x)
    d = c.sparkSession.range(physical + boundary).join(diagonal(c), "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))
    d11 = d.where(F.col("id") < physical).select("id", sound(F.col("v")).alias("v"))
    a21 = c.where((F.col("row") >= physical) & (F.col("col") < physical)).select("row", F.col("col").alias("j"), F.col("val").alias("down"))
    a12 = c.where((F.col("row") < physical) & (F.col("col") >= physical)).select(F.col("col").alias("row"), F.col("row").alias("j"), F.col("val").alias("up"))
    less = a21.join(a12, ["row", "j"]).join(d11.select(F.col("id").alias("j"), F.col("v").alias("d")), "j").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("up") * F.col("down") / F.col("d")).alias("s"))
    d22 = d.where(F.col("id") >= physical).join(less, "id", "left").select("id", sound(F.col("v") - F.coalesce("s", F.lit(0.0))).alias("v"))
    return d11.unionByName(d22)


def valid_csr(a: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """One row: whether no position repeats, every value is finite and, where sizes are given, every index lies in them."""
    per = a.groupBy("row", "col").agg(F.count(F.lit(1)).alias("c"), F.max(F.isnan("val") | (F.abs("val") == float("inf"))).alias("bad"))
    inside = (F.col("row") >= 0) & (F.col("col") >= 0)
    for name, n in (("row", rows), ("col", cols)):
        inside = inside if n is None else inside & (F.col(name) < n)
    return per.agg(F.coalesce(F.min((F.col("c") == 1) & ~F.col("bad") & inside), F.lit(True)).alias("valid"))


def selected(a: DataFrame, mask: Column, offset: int = 0) -> DataFrame:
    """Entries that fulfil the mask, their rows moved by offset."""
    return shift(a.where(mask), offset)


def row_totals(a: DataFrame) -> DataFrame:
    """(id, v): each row's entries added up."""
    return a.groupBy(F.col("row").alias("id")).agg(F.sum("val").alias("v"))


def masked_rows(a: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows whose flag (id, flag) is set; rows without a flag vanish."""
    return a.join(flags.where("flag").select(F.col("id").alias("row")), "row", "left_semi").select("row", "col", "val")


def matrix_power(a: DataFrame, n: int, physical: DataFrame | None = None) -> DataFrame:
    """A^n, n >= 1, by products; physical (id): only these rows are kept at each step."""
    keep = (lambda m: m) if physical is None else (lambda m: m.join(physical.select(F.col("id").alias("row")), "row", "left_semi"))
    out = keep(coalesce(a))
    for _ in range(n - 1):
        out = spgemm(out, a)
    return out.select("row", "col", "val")


def overflow(counts: DataFrame, limit: int = 2**31 - 1) -> DataFrame:
    """One row: whether the entries of all rows exceed what an index type holds."""
    return counts.agg((F.coalesce(F.count(F.lit(1)), F.lit(0)) > limit).alias("overflow"), F.count(F.lit(1)).alias("entries"))
