"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Memtables are bounded: a task of the scan (spark.sql.files.maxPartitionBytes of input) sorts its (digest, id) and flushes
sorted runs of MEMTABLE rows at most (level 0). Compaction merges all runs into level 1: a row a digest, with the
identifier that stays and the number of rows. Lookups go through a blocked Bloom filter of level 1's hits (digests with more than
one row): what it rules out is a group of its own and moves nowhere, the rest is looked up in the hits by an exact join.
Hits are verified byte by byte: a text group whose least and greatest text differ is a digest collision, and is then
grouped by the text itself.

Defined cases: null text counts as empty; null ids rank below all others (a group of null ids only keeps null); rows that
repeat both id and text are one document, so `digested` marks each of them kept, and `exact_dedup` emits one; very long
texts are hashed and compared whole; an empty table gives an empty one; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import maybe_in, spare, split_by, with_groups, written

#: Rows of a run at most.
MEMTABLE = 1 << 20


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def flushed(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Level 0: sorted runs of (digest, doc_id); no shuffle."""
    rows = docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id"))
    return written(rows.sortWithinPartitions("digest"), "runs", maxRecordsPerFile=str(MEMTABLE))


def compacted(runs: DataFrame, keep: str = "max") -> DataFrame:
    """Level 1: (digest, keep_id, group_size), pre-aggregated in each task before its rows move."""
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    level = runs.groupBy("digest").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return written(level.sortWithinPartitions("digest"), "level")


def collisions(docs: DataFrame, level: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests of hits under which there is more than one text. Each task sends a text or two a digest, not a text a row."""
    texts = docs.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    hits = level.where("group_size > 1").select("digest")
    ends = maybe_in(texts, hits, "digest").where("_maybe").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return written(ends.where("low <> high").select("digest"), "collisions")


def looked_up(runs: DataFrame, level: DataFrame, total: int) -> DataFrame:
    """runs with keep_id and group_size. Only rows that the filter lets pass are joined with the hits; the others are alone."""
    hits = level.where("group_size > 1")
    alone, maybe = split_by(runs, hits, "digest")
    met = with_groups(maybe, hits, "digest", "group_size", total)
    found = alone.select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    own = F.col("group_size").isNull()
    return found.unionByName(met.select("digest", "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")))


def digested(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row a document: doc_id, digest, keep_id, group_size, kept."""
    runs = flushed(docs, digest)
    level = compacted(runs, keep)
    total = runs.count()
    clash = collisions(docs, level, digest)
    if clash.isEmpty():
        out = looked_up(runs, level, total)
    else:
        best = F.max("doc_id") if keep == "max" else F.min("doc_id")
        rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("t"))
        inside = rows.join(clash, "digest", "left_semi")
        groups = inside.groupBy("digest", "t").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = inside.join(groups, ["digest", "t"], "left").select("digest", "doc_id", "keep_id", "group_size")
        out = looked_up(runs.join(clash, "digest", "left_anti"), level, total).unionByName(split)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """docs without the rows whose text another row keeps; the columns stay as they are.

    Rows are named by a hash of id and digest, which is compared in full where it decides. Texts move only of rows that the
    filter of lost or repeated names lets pass.
    """
    own, mark = docs.columns, spare("_name", docs)
    name = lambda i, d: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.hex(d))
    every = written(digested(docs, keep).select(name(F.col("doc_id"), F.col("digest")).alias(mark), "kept"), "verdicts")
    lost = every.where("NOT kept").select(mark)  # by id and digest: an id may come with several texts
    again = every.where("kept").groupBy(mark).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(mark)
    free, maybe = split_by(docs.withColumn(mark, name(F.col("doc_id"), sha256(F.col("text")))), lost.unionByName(again), mark)
    rest = maybe.join(lost.distinct(), mark, "left_anti").dropDuplicates([mark])
    return free.unionByName(rest).select(*own)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digested(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE3 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
