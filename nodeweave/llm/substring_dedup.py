"""Substring dedup by hashing of lines, and of passages of WINDOW words.

Units are lines, line feeds included. A unit's digest is that of its words in lower case, joined by single spaces; lines of
fewer than MIN_WORDS words are left alone, unless a removed passage holds them. Of all units with one digest, that of the
least (doc_id, start) stays, null ids last; the others are removed, as code-point offsets of the original text. Spans that
overlap are merged, those that only touch are not.

Passages are runs of at least WINDOW words, wherever they start or end, that an earlier document (of a lesser doc_id, null
ids last) has; all are found, short sentences in them included. A window's least hash of GRAM words names it; neighbouring
windows of one name are a segment. Equal windows have one name, so only segments whose name occurs in several documents are
looked at: those that an earlier document has go whole, and only where segments of one name differ are windows compared.

Defined cases: null text counts as empty; rows that share an id are one document, whose spans are listed once; rows that
repeat an id and text hold one occurrence, so none removes the other; a very long text's units move one by one, its words'
hashes are held at once; an empty table gives an empty one; other columns are not read by `deduplicated` and pass through
`without_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.llm.common import spare, with_groups, written

MIN_WORDS, WINDOW, GRAM = 5, 50, 20
_LINE = re.compile(r"[^\n]+\n*")


def spans_of(text: str, least: int = MIN_WORDS):
    """(start, end, digest) of a text's units, by start."""
    for start, end in (m.span() for m in _LINE.finditer(text)):
        words = text[start:end].lower().split()
        if len(words) >= least:
            yield start, end, hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def units(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, starts, ends, digests = [], [], [], []

            def full():
                return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "stop": pa.array(ends, pa.int64()), "digest": pa.array(digests, pa.binary())})

            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for start, stop, digest in spans_of(text or "", least):
                    ids.append(doc_id), starts.append(start), ends.append(stop), digests.append(digest)
                if len(ids) > 50_000:
                    yield full()
                    ids, starts, ends, digests = [], [], [], []
            yield full()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, stop long, digest binary")


def removed(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, stop) of the units to remove."""
    rows = written(units(docs, least), "units")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("start").alias("at"))
    groups = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = with_groups(rows, written(groups, "repeats"), "digest", "c", rows.count()).where("c IS NOT NULL")
    first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("start") == F.col("first.at"))
    return met.where(~first).select("doc_id", "start", "stop")


class WordHashes(dict):
    """64-bit digests of words in lower case, kept up to a bound."""

    def __missing__(self, word):
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = got = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return got

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes mod 2^64 of any run of a sequence of word hashes."""

    BASE = 0x9E3779B97F4A7C15
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        if len(hashes) >= len(Rolling.powers):
            for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(2 * len(hashes) + 1, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: len(hashes)], dtype=np.uint64)])

    def runs(self, starts, ends) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def segments_of(hashes: np.ndarray, window: int, gram: int):
    """Of a text of `window` words or more: its Rolling, and names, first and last window, and digests of its segments."""
    rolling, n = Rolling(hashes), len(hashes)
    least, width, reach = rolling.runs(np.arange(n - gram + 1), np.arange(gram, n + 1)), 1, window - gram + 1
    while width < reach:
        step = min(width, reach - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.append(0, cuts), np.append(cuts, len(least)) - 1
    return rolling, least[first], first, last, digests(least[first], rolling.runs(first, last + window))


def digests(names: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(n, 16) bytes."""
    return np.stack([names, hashes], 1).view(np.uint8).reshape(-1, 16)


def binary(rows: list):
    """An Arrow column of blocks of 16 bytes."""
    import pyarrow as pa

    data = np.concatenate([np.zeros((0, 16), np.uint8), *rows])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * 16), pa.py_buffer(np.ascontiguousarray(data))])


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for b in batches:
            ids, names, digest = [], [], []

            def full():
                return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "name": pa.array(np.concatenate([np.zeros(0, np.int64), *names])), "digest": binary(digest)})

            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                hashes = known.of(text or "")
                if len(hashes) >= window:
                    _, name, _, _, own = segments_of(hashes, window, gram)
                    ids += [doc_id] * len(name)
                    names.append(name.view(np.int64)), digest.append(own)
                if len(ids) > 50_000:
                    yield full()
                    ids, names, digest = [], [], []
            yield full()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, name long, digest binary")


def spans_and_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Of docs with `s`, digests of segments and whether they go: spans of those (digest null) and all windows of the others."""

    def run(batches):
        import pyarrow as pa

        known, none = WordHashes(), np.zeros(0, np.int64)
        for b in batches:
            ids, starts, ends, digest = [], [], [], []
            gone_ids, gone_starts, gone_ends = [], [], []

            def full():
                cols = {"doc_id": pa.array(ids, pa.int64()), "start": pa.array(np.concatenate([none, *starts])), "stop": pa.array(np.concatenate([none, *ends])), "digest": binary(digest)}
                yield pa.RecordBatch.from_pydict(cols)
                cols = {"doc_id": pa.array(gone_ids, pa.int64()), "start": pa.array(gone_starts, pa.int64()), "stop": pa.array(gone_ends, pa.int64()), "digest": pa.nulls(len(gone_ids), pa.binary())}
                yield pa.RecordBatch.from_pydict(cols)

            for doc_id, text, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("s").to_pylist()):
                hashes = known.of(text or "")
                if len(hashes) < window:
                    continue
                goes = {x["digest"]: x["gone"] for x in s}
                rolling, name, first, last, own = segments_of(hashes, window, gram)
                at = np.array([m.span() for m in re.finditer(r"\S+", text)])
                verdict = [goes.get(x.tobytes()) for x in own]
                for k in (k for k, v in enumerate(verdict) if v):
                    gone_ids.append(doc_id), gone_starts.append(at[first[k], 0]), gone_ends.append(at[last[k] + window - 1, 1])
                for k in (k for k, v in enumerate(verdict) if v is False):
                    x = np.arange(first[k], last[k] + 1)
                    ids += [doc_id] * len(x)
                    starts.append(at[x, 0]), ends.append(at[x + window - 1, 1]), digest.append(digests(np.full(len(x), name[k]), rolling.runs(x, x + window)))
                if len(ids) + len(gone_ids) > 50_000:
                    yield from full()
                    ids, starts, ends, digest = [], [], [], []
                    gone_ids, gone_starts, gone_ends = [], [], []
            yield from full()

    return docs.mapInArrow(run, "doc_id long, start long, stop long, digest binary")


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, stop): spans whose union is all runs of at least `window` words that an earlier document has."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    ends = [F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("c")]
    several = ~F.col("first.id").eqNullSafe(F.col("last.id"))
    later = ~F.col("doc_id").eqNullSafe(F.col("first.id"))

    rows = written(segments(docs, window, gram), "segments")
    names = rows.groupBy("name").agg(*ends, (F.min("digest") < F.max("digest")).alias("differ")).where(several).select("name", "c", "differ")
    met = written(with_groups(rows, written(names, "names"), "name", "c", rows.count()).where("c IS NOT NULL").select("doc_id", "digest", "differ").distinct(), "met")
    firsts = met.groupBy("digest").agg(*ends).select("digest", "first", "c")
    state = with_groups(met, written(firsts, "firsts"), "digest", "c", met.count()).select("doc_id", "digest", "differ", later.alias("gone")).where("gone OR differ")
    lists = state.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("digest", "gone")).alias("s"))
    own = docs.select("doc_id", "text")
    spans = written(spans_and_windows(own.join(lists, own["doc_id"].eqNullSafe(F.col("_id"))).select("doc_id", "text", "s"), window, gram), "windows")

    open_ = spans.where("digest IS NOT NULL")
    found = open_.groupBy("digest").agg(*ends).where(several).select("digest", "first", "c")
    again = with_groups(open_, written(found, "found"), "digest", "c", open_.count()).where(F.col("c").isNotNull() & later)
    return spans.where("digest IS NULL").select("doc_id", "start", "stop").unionByName(again.select("doc_id", "start", "stop"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, stop), those of a document that overlap as one."""
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("long"))
    return new.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def deduplicated(docs: DataFrame, least: int = MIN_WORDS, window: int = 0, gram: int = GRAM) -> DataFrame:
    """A row a document: doc_id, n_removed, removed_chars, spans (start:end, comma-joined). window 0: without passages."""
    spans = removed(docs, least)
    spans = spans.unionByName(passages(docs, window, gram)) if window else spans
    gone = merged(spans.distinct()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_removed"), F.sum(F.col("stop") - F.col("start")).alias("removed_chars"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s")
    )
    ids = docs.select("doc_id").distinct()
    out = ids.join(gone.withColumnRenamed("doc_id", "_id"), ids["doc_id"].eqNullSafe(F.col("_id")), "left")
    text = F.array_join(F.transform("s", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("removed_chars", zero).alias("removed_chars"), F.coalesce(text, F.lit("")).alias("spans"))


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with text cut by its document's spans; n_chars, if there, follows it. Null texts and those of ids with several
    texts, whose spans are not told apart, stay as they are."""
    ids, text = spare("_id", docs), F.coalesce("text", F.lit(""))
    several = docs.groupBy("doc_id").agg(F.min(F.sha2(text, 256)).alias("a"), F.max(F.sha2(text, 256)).alias("b")).where("a < b").select(F.col("doc_id").alias(ids))
    spans = deduplicated(docs, least, window, gram).where("n_removed > 0").select(F.col("doc_id").alias(ids), F.col("spans").alias(spare("_spans", docs)))
    spans = written(spans.join(several.withColumnRenamed(ids, "o"), F.col(ids).eqNullSafe(F.col("o")), "left_anti"), "spans")
    mark = spans.columns[1]
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans[ids]), "left").drop(ids)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t if t is None or not s else _cut(t, s) for t, s in zip(b.column("text").to_pylist(), b.column(mark).to_pylist())]
            names = [n for n in b.schema.names if n != mark]
            b = b.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                n = [old if t is None else len(t) for t, old in zip(texts, b.column("n_chars").to_pylist())]
                b = b.set_column(names.index("n_chars"), "n_chars", pa.array(n, b.schema.field("n_chars").type))
            yield b

    return rows.mapInArrow(run, docs.schema)


def _cut(text: str, spans: str) -> str:
    out, at = [], 0
    for start, stop in (map(int, x.split(":")) for x in spans.split(",")):
        out.append(text[at:start])
        at = stop
    return "".join([*out, text[at:]])


def op2(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=WINDOW)
