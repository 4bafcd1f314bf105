"""Whole rows: orders, ranks, batches, matches between states, and unions of node kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.sources.scratch import saved


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place, from 0, in a total order. Rows are dealt to tasks by ranges of the order; each task numbers its
    own, and the sizes of the tasks before it are added. Rows that tie in all of `order` come in any order."""
    part = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = part.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    out = inner.join(F.broadcast(sizes.select("_part", before.alias("_base"))), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def by_priority(rows: DataFrame, priority: str = "priority", key: str = "id") -> DataFrame:
    """rows with their rank by falling priority, then key: a stable order."""
    return ranked(rows, F.desc(priority), F.col(key))


def seeded(key: str, seed: int) -> Column:
    """A hash whose order is an epoch's: the same on every partitioning and engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with their rank in an order that the seed sets; what is in one row stays together."""
    hash_ = seeded(key, seed)
    return ranked(rows.withColumn("_h", hash_), F.col("_h"), F.col(key)).drop("_h")


def batch(rows: DataFrame, key: str, seed: int, index: int, size: int) -> DataFrame:
    """Batch `index` of `size` rows of the seed's epoch; the last may be shorter."""
    return shuffled(rows, key, seed).where((F.col("rank") >= index * size) & (F.col("rank") < (index + 1) * size)).drop("rank")


def best(candidates: DataFrame, *by: str) -> DataFrame:
    """The one row that is least by these columns in turn."""
    return candidates.orderBy(*by).limit(1)


def united(**kinds: DataFrame) -> DataFrame:
    """Node tables of several kinds below each other, in the order given: with `kind` and `part`, the kind's number."""
    parts = [df.withColumns({"kind": F.lit(kind), "part": F.lit(k)}) for k, (kind, df) in enumerate(kinds.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def matched(current: DataFrame, previous: DataFrame, key: str = "id", row: str = "row") -> DataFrame:
    """current with the row of its key in previous, -1 where there is none; the least of several."""
    where = previous.groupBy(key).agg(F.min(row).alias("previous_row"))
    return current.join(where, key, "left").withColumn("previous_row", F.coalesce("previous_row", F.lit(-1)))


def lookup(ids: DataFrame, tree: DataFrame, key: str = "id") -> DataFrame:
    """ids with `row` in a tree (key, row, active), -1 where it is absent or inactive."""
    return ids.join(tree.where("active").select(key, "row"), key, "left").withColumn("row", F.coalesce("row", F.lit(-1)))


def reusable(current: DataFrame, previous: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, reuse): whether a row of previous has the same key and, null-safe and with arrays element by element, the same columns."""
    before = previous.select(key, F.struct(*columns).alias("_was"))
    return current.select(key, F.struct(*columns).alias("_is")).join(before, key, "left").select(key, F.coalesce(F.col("_is").eqNullSafe(F.col("_was")), F.lit(False)).alias("reuse"))


def physical(logical: DataFrame, index: DataFrame) -> DataFrame:
    """Logical ids with the physical ones that an index (logical, physical) gives; an id that it lacks raises when read."""
    out = logical.join(index, "logical", "left")
    return out.withColumn("physical", F.coalesce("physical", F.raise_error(F.concat(F.lit("no physical row for "), F.col("logical").cast("string"))).cast("long")))
