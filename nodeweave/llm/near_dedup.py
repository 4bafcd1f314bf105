"""MinHash near-dedup with tensored banding.

Two small collections of TABLES bands each, BAND min-hashes a band, are computed; the key of table (i, j) is the pair of the
left collection's band i and the right one's band j, so TABLES ** 2 keys take 2 * TABLES * BAND min-hashes. Two documents of
similarity s miss each other in all tables with probability at most 2 * (1 - s ** BAND) ** TABLES. At the threshold itself
that is 5.1e-4 for 10 bands of two; at 0.8 it is 7e-5. Candidates are confirmed on full shingle sets.

Only connectivity is asked for, and that keeps the work linear in the copies:
1. Documents with one set are one class (a digest of the whole sorted set); only classes go on.
2. A band value that one class has can't meet another, so its keys are dropped before pairs of bands are formed.
3. In TURNS rounds each class is compared with one center of another component that it shares most keys with, and links
   are contracted; keys whose members are one component are done.
4. Classes with keys that are still open are compared by an exact way: those that share one of their rarest shingles (a
   prefix that any two sets of the threshold's similarity must share), so that common passages and edits of one base bring
   no pairs. Nothing is capped or sampled.

Defined cases: null or blank text, or one without words, has no shingles and is linked with nothing; fewer than five words
are one shingle; null ids have no say in the component's id and get it like others, null if all are null; rows that repeat
an id and text are one class; an id with several texts belongs to several classes and each row has its own; an empty table
gives an empty one; other columns pass through `near_dedup`.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import maybe_in, spare, split_by, with_groups, written

WIDTH, TABLES, BAND = 5, 10, 2
#: The threshold as a ratio of whole numbers, so that it is exact.
OVER, UNDER = 75, 100
#: Rounds in which each class is compared with one center, before what is left open is.
TURNS = 2
#: Words of 64 bits of a set's parity bitmap: it bounds the overlap of two sets from above, most sharply below 500 shingles.
PLANES = 8
#: Comparisons that share one copy of a class's set.
FAN = 256
#: Nodes whose comparisons are dealt out, at most.
WIDE = 1 << 16
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
STORED = 300_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@functools.lru_cache(8)
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word hashes, forgotten above STORED words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: bytes | None, store: Words, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; bytes.lower and bytes.split know ASCII only, as asked."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(store) > STORED:
        store.clear()
    h = np.fromiter(map(store.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)  # shorter texts differ from windows of five by this start
        for k in range(n):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def bands(s: np.ndarray, tables: int = TABLES, band: int = BAND) -> np.ndarray:
    """2 * tables band values of a set: left collection, then right."""
    a, b = _odd(2 * tables * band, 11), _odd(2 * tables * band, 13)
    least = np.full(len(a), _MASK, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 4096):  # bounded memory for very long texts
            x = s[lo : lo + 4096, None] * a + b
            least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
        out = np.zeros(2 * tables, np.uint64)
        for k in range(band):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[k::band])
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parities(s: np.ndarray) -> list[int]:
    """How many shingles fall on each of 64 * PLANES places, modulo two."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * PLANES), minlength=64 * PLANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signed(docs: DataFrame, tables: int = TABLES, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, cls (the set's digest, null without shingles), bands of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        store = Words()
        for b in batches:
            n, cls, keys = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, store)
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
                keys.append(bands(s, tables, band).view(np.int64).tolist() if len(s) else [])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, cls binary, bands array<long>")


def table_keys(classes: DataFrame, tables: int = TABLES) -> DataFrame:
    """(key, node, n) of each class and table in which both band values are shared with another class. Values that one class has
    are filtered before they move."""
    each = classes.select("node", "n", F.posexplode("bands").alias("at", "value"))
    shared = written(each.groupBy("at", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("at", "value"), "shared")
    place = F.xxhash64("at", "value").alias("place")
    some = maybe_in(each.select("node", "n", "at", "value", place), shared.select(place), "place").where("_maybe").drop("_maybe", "place")
    met = some.join(shared, ["at", "value"]).groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "value")).alias("m"))  # 2 * tables a class
    left, right = F.filter("m", lambda x: x["at"] < tables), F.filter("m", lambda x: x["at"] >= tables)
    pairs = met.select("node", "n", right.alias("r"), F.explode(left).alias("l")).select("node", "n", "l", F.explode("r").alias("r"))
    return pairs.select(F.xxhash64("l.at", "l.value", "r.at", "r.value").alias("key"), "node", "n")


def similar_size(a: Column, b: Column) -> Column:
    """Necessary for a link: the smaller set is at least 75 % of the larger."""
    return UNDER * F.least(a, b) >= OVER * F.greatest(a, b)


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, s, bits): the full set of each class as bytes and its parities, read again from a row of it. classes: node, cls, rep (its least id, or null)."""
    reps = classes.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    named = maybe_in(docs.select("doc_id", "text"), reps, "doc_id").where("_maybe").drop("_maybe").join(reps, "doc_id", "left_semi")
    rows = named.unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))

    def run(batches):
        import pyarrow as pa

        store = Words()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                found = [shingles(t, store) for t in b.column("text").slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_pydict({"cls": pa.array([digest(s) for s in found], pa.binary()), "n": pa.array([len(s) for s in found], pa.int64()), "s": pa.array([s.tobytes() for s in found], pa.binary()), "bits": pa.array([parities(s) for s in found], pa.list_(pa.int64()))})

    got = rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "cls binary, n long, s binary, bits array<long>")
    return got.join(classes.select("cls", "node"), "cls").groupBy("node").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("bits").alias("bits"))


def crowded(pairs: DataFrame) -> DataFrame:
    """(b, fans) of the nodes whose pairs are dealt to several tasks. They are WIDE at most, whatever the input, so they can be
    broadcast; any other node has FAN pairs or a share of one in WIDE at most."""
    least = max(FAN, pairs.count() // WIDE)
    return pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > least).select("b", F.ceil(F.col("c") / FAN).cast("int").alias("fans"))


def met_at_b(pairs: DataFrame, right: DataFrame, crowd: DataFrame) -> DataFrame:
    """pairs (a, b) joined with right (b, more), whose row of a crowded node goes once to each FAN pairs."""
    fans = F.coalesce("fans", F.lit(1))
    dealt = pairs.join(F.broadcast(crowd), "b", "left").withColumn("fan", F.pmod(F.xxhash64("a"), fans).cast("int")).drop("fans")
    spread = right.join(F.broadcast(crowd), "b", "left").withColumn("fan", F.explode(F.sequence(F.lit(0), fans - 1))).drop("fans")
    return dealt.join(spread, ["b", "fan"]).drop("fan")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. A hot node is dealt out; sets that no pair names are filtered before they move."""
    right = maybe_in(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), pairs, "b").where("_maybe").drop("_maybe")
    left = maybe_in(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), pairs, "a").where("_maybe").drop("_maybe")
    both = met_at_b(pairs.select("a", "b"), right, crowded(pairs)).join(left, "a").select("a", "b", "sa", "sb")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both_ = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(UNDER * both_ >= OVER * (len(u) + len(v) - both_))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link: the least node it reaches. Labels pass along links, then jump to their label's label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = label.join(near, label["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("via"))
        up = label.select(F.col("node").alias("via"), F.col("comp").alias("top"))
        step = written(low.join(up, "via", "left").select("node", "was", F.least("via", F.coalesce("top", "via")).alias("comp")), "labels")
        label = step.select("node", "comp")
        if step.where("was <> comp").isEmpty():
            return label


def labelled(keys: DataFrame, comps: DataFrame) -> DataFrame:
    return keys.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def open_keys(members: DataFrame) -> DataFrame:
    """Keys with members of different components: (key, members)."""
    span = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
    return span.where("lo <> hi").select("key", "members")


def of_keys(members: DataFrame, keys: DataFrame) -> DataFrame:
    """members with the columns of their keys, for those that keys has. keys: key, members (how many rows it has), more. A
    key with a large share of the rows is broadcast, so no task gets all of its members."""
    return with_groups(members, keys, "key", "members", members.count()).where(F.col("members").isNotNull()).drop("members")


def star(members: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) a node at most: b is the center of most of its open keys.

    In the first turn a key's center is the member whose keys have most members in all, that is the text that the others
    vary; later, the least by a hash of the turn.
    """
    if turn == 0:
        size = members.groupBy("key").agg(F.count(F.lit(1)).alias("members")).withColumn("w", F.col("members"))
        fit = members.join(of_keys(members.select("key", "node"), size).groupBy("node").agg((-F.sum("w")).alias("h")), "node")
    else:
        fit = members.withColumn("h", F.xxhash64("node", F.lit(turn)))
    center = fit.groupBy("key").agg(F.min(F.struct("h", "node", "comp", "n")).alias("m"), F.count(F.lit(1)).alias("members"))
    met = of_keys(members, center).where((F.col("comp") != F.col("m.comp")) & similar_size(F.col("n"), F.col("m.n")))
    votes = met.groupBy(F.col("node").alias("a"), F.col("m.node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("a").agg(F.max(F.struct("c", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def able(n: Column, at: Column, other: Column) -> Column:
    """Whether sets of n and `other` shingles can reach the threshold if the first shared one has place `at` (from 0) in the set of n."""
    return (UNDER + OVER) * (n - at) >= OVER * (n + other)


def able_by_bits() -> Column:
    """Whether sets of na and nb shingles with parities ba and bb can reach the threshold: each place where the parities differ is
    a shingle of one of them alone, which bounds what both can share."""
    apart = sum((F.bit_count(F.col("ba")[k].bitwiseXOR(F.col("bb")[k])) for k in range(1, PLANES)), F.bit_count(F.col("ba")[0].bitwiseXOR(F.col("bb")[0])))
    return (UNDER + OVER) * (F.col("na") + F.col("nb") - apart) >= 2 * OVER * (F.col("na") + F.col("nb"))


def able_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b; an a once) that sizes and parities don't rule out, so that no set moves for the others."""
    small = sets.select("node", "n", "bits")
    right = small.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = met_at_b(pairs, right, crowded(pairs)).join(small.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    return both.where(able_by_bits()).select("a", "b")


def across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, node, n, at, bits, comp) of a key that lie in different components and may be similar."""
    x = members.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("bits").alias("ba"), F.col("comp").alias("ca"))
    y = members.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("bits").alias("bb"), F.col("comp").alias("cb"))
    may = (F.col("ca") < F.col("cb")) & similar_size(F.col("na"), F.col("nb")) & able(F.col("na"), F.col("pa"), F.col("nb")) & able(F.col("nb"), F.col("pb"), F.col("na"))
    may = may & able_by_bits()
    return x.join(y, "key").where(may).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def by_prefix(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Exact candidates among sets: pairs of different components whose first shared shingle, rarest first, comes early
    enough in both for the threshold (at latest at n - ceil(0.75 n); where the other's size is near n, at a seventh of n).

    Counts are over these sets; shingles of one set only take the first places and never move again. What many texts have
    in common comes last, so texts around one passage or one base don't meet on it. Shingles that one component alone has
    are no meeting place, so a large group of copies that is one component brings no pairs of its own.
    """

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            for node, n, s in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("s")):
                values = np.frombuffer(s.as_py(), np.int64)
                for lo in range(0, len(values), 65536):
                    part = values[lo : lo + 65536]
                    yield pa.RecordBatch.from_pydict({"node": np.full(len(part), node, np.int64), "n": np.full(len(part), n, np.int64), "t": part})

    each = sets.select("node", "n", "s").mapInArrow(unpack, "node long, n long, t long")
    counts = written(each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = maybe_in(each, counts, "t").where("_maybe").drop("_maybe").join(counts, "t")
    ranked = shared.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x"))  # a set
    placed = ranked.select("node", "n", (F.col("n") - F.size("x")).alias("own"), F.posexplode("x").alias("at", "x")).withColumn("at", F.col("at") + F.col("own"))
    prefix = placed.where(UNDER * (F.col("n") - F.col("at")) >= OVER * F.col("n")).select(F.col("x.t").alias("key"), "node", "n", "at")
    members = written(labelled(prefix, comps), "prefixes")
    return across(of_keys(members, open_keys(members)).join(sets.select("node", "bits"), "node"))


def linked(docs: DataFrame, tables: int = TABLES, band: int = BAND, turns: int = TURNS) -> DataFrame:
    """A row a document: doc_id, cls, n_shingles, component_id, kept."""
    rows = written(signed(docs, tables, band), "signed")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    every = written(table_keys(classes, tables).withColumn("comp", F.col("node")), "keys")
    members = written(of_keys(every, open_keys(every)), "members")
    sets = written(sets_of(docs, classes.join(members.select("node").distinct(), "node", "left_semi")), "sets")
    links = tried = None
    comps = classes.sparkSession.createDataFrame([], "node long, comp long")
    for turn in range(turns):
        pairs = star(members, turn)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = confirmed(written(able_pairs(pairs, sets), "able"), sets)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        now = written(labelled(members.drop("comp"), comps), "keys")
        members = written(of_keys(now, open_keys(now)), "members")
        if members.isEmpty():
            break
    if not members.isEmpty():
        left = sets.join(members.select("node").distinct(), "node", "left_semi")
        more = by_prefix(left, comps)
        more = written(more.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            comps = components(links.unionByName(confirmed(more, sets)))
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = written(named.select("cls", "rep", "c", "comp"), "named")
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    groups = written(with_groups(named, ids, "comp", "members", named.count()).select("cls", "component_id", "c"), "groups")
    out = with_groups(rows.select("doc_id", "n_shingles", "cls"), groups, "cls", "c", rows.count()).drop("c")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the least id. Documents without shingles all stay.

    An id with several texts goes only if it is kept under none of them; rows that repeat an id and text share the verdict.
    """
    own, mark = docs.columns, spare("_name", docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    lost = written(linked(docs).groupBy(name.alias(mark)).agg(F.max("kept").alias("k")).where("NOT k").select(mark), "lost")
    free, maybe = split_by(docs.withColumn(mark, name), lost, mark)
    return free.unionByName(maybe.join(lost, mark, "left_anti")).select(*own)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked(docs).select("doc_id", "n_shingles", "component_id", "kept")
