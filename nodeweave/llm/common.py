"""What the operators share: scratch folders, heavy-key joins, Spark-side word splitting."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contract, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Where that is unset, a local one on a local
    master (tests), and an error on any other, whose executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="nodeweave-")


def spare(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, whatever the case of its letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and a lost executor takes nothing along."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blank_free(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null or blank ones."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


#: Blocks of a filter: its broadcast side has so many rows of five longs at most (5 MB), whatever the input.
FILTER_BLOCKS = 1 << 17


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, mark: str = "_maybe") -> DataFrame:
    """rows with a mark: false if the key is surely not among keys. A blocked Bloom filter of four words a block, a bit
    in each, built by bit_or; one that fills up only marks more rows. A null key is in no set. rows may have any other
    columns but one named like the mark."""
    masks = [F.expr(f"shiftleft(1L, cast(pmod(shiftright(g, {6 * n}), 64) AS int))").alias(f"m{n}") for n in range(4)]

    def hashed(df: DataFrame, *more) -> DataFrame:
        at = df.select(*more, F.col(key).alias("k"), F.pmod(F.xxhash64(key), F.lit(FILTER_BLOCKS)).alias("b"), F.xxhash64(key, F.lit(1)).alias("g"))
        return at.select("*", *masks)

    blocks = hashed(keys).where("k IS NOT NULL").groupBy("b").agg(*[F.bit_or(f"m{n}").alias(f"f{n}") for n in range(4)])
    found = hashed(rows, F.struct(*rows.columns).alias("row")).join(F.broadcast(blocks), "b", "left")
    all_set = F.col("k").isNotNull()
    for n in range(4):
        all_set = all_set & (F.col(f"f{n}").bitwiseAND(F.col(f"m{n}")) != 0)
    return found.select("row.*", F.coalesce(all_set, F.lit(False)).alias(mark))


def split_by(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among keys, the others)."""
    mark = spare("_maybe", rows)
    marked = maybe_in(rows, keys, key, mark)
    return marked.where(~F.col(mark)).drop(mark), marked.where(F.col(mark)).drop(mark)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, heavy: int = 512) -> DataFrame:
    """rows left-joined with groups (one row a key; size: its number of rows, summing to total at most).

    Keys with over total / heavy rows are fewer than `heavy`, whatever the input: those are broadcast. All other keys hold
    a bounded share, so the shuffled join has no hot partition. Null keys match nothing and pass beside the join.
    """
    least, mark = max(1, total // heavy), spare("_hot", rows, groups)
    hot = F.broadcast(groups.where(F.col(size) > least).withColumn(mark, F.lit(True)))
    rest = groups.where(F.col(size) <= least)
    first = rows.join(hot, key, "left")
    done = first.where(F.col(mark).isNotNull() | F.col(key).isNull()).drop(mark)
    open_ = first.where(F.col(mark).isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(open_.join(rest, key, "left"))
