"""Best-fit packing by minimum bin slack.

Lengths are 1 to SEQUENCE, so the packing is decided on their histogram (SEQUENCE numbers on the driver, whatever the
input): for each bin the longest open piece is set, a bitset subset-sum over the available lengths finds the fullest
feasible combination, and that is removed - as many times at once as the counts allow. Pieces then look their place up by
their rank among pieces of their length; ranks come from counts a task and length, so no length meets in one task.

Defined cases: null text counts as empty (one piece: the closing id); repeated rows are packed each on its own; null ids
pass through; a text longer than a sequence is cut into whole sequences behind a first piece that may be shorter; pieces of
equal length are interchangeable and take places in order of task and row; an empty table gives an empty one; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.common import written

SEQUENCE, CLOSING, VOCABULARY = 1024, 2, "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def tokenizer(path: str):
    """Loaded once a worker process, which has one core; as the file gives it, so special strings in a text are special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Chunks kept with their ids, a worker, in each of two generations: what isn't met again while one fills is forgotten.
STORED, STORED_LENGTH = 400_000, 64
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: White space besides the space and the line feed; the second, of texts in ASCII.
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_BLANKS = [c for c in _BLANKS if c.isascii()]
_APART = re.compile(rf"[.,](?<![0-9{_LETTER}].)")
_TWO = ("  ", "\n\n", " \n", "\n ")
#: Texts of letters, digits, ASCII signs and common white space only, and the vocabulary's split pattern on those.
_PLAIN = re.compile(rf"[\n\t\r -~{_LETTER}]*")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")


class _Stored(dict):
    """Chunk to ids, encoded when first asked for: split here, then by the library's model alone, as a whole Encoding of it
    takes four times as long. What isn't plain goes through the library as a whole."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize, self.old = tokenizer, tokenizer.model.tokenize, {}
        plain = map(chr, [*range(0x250)])
        self.letters = {ord(c): "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in plain if _PLAIN.fullmatch(c)}

    def of_part(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenize(part.translate(self.letters))]
        return pack(f"<{len(ids)}I", *ids)

    def encoded(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.of_part, _PARTS.findall(text)))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def made(self, chunk: str) -> bytes:
        return self.encoded(chunk if chunk[0] in "\n.," else f" {chunk}")

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key) or self.made(key)
        if len(key) <= STORED_LENGTH:
            if len(self) >= STORED:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _Parts(_Stored):
    """The same for parts of texts, spaces included."""

    made = _Stored.of_part


class Encoder:
    """Ids of texts as little-endian uint32 bytes, by the tokenizers library.

    The vocabulary's split never joins a character that is no white space with white space after it, nor a letter or digit
    with a stop or comma after it. Texts are cut there and each distinct chunk is encoded once while it is stored. A chunk's
    leading space is left out of its key, as only the text's first chunk and those of a line feed, stop or comma have none.
    Texts with doubled white space, or a stop or comma after anything else, are cut by the whole split pattern instead if
    they are plain; all others, and those with the string of a special token, go through the library as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stored, self.parts = _Stored(self.tokenizer), _Parts(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))

    def one(self, t: str) -> bytes:
        if not t:
            return b""
        if any(s in t for s in self.special):
            return np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        other = any(x in t for x in (_ASCII_BLANKS if t.isascii() else _BLANKS))
        if other or t[0] in " \n" or t[-1] in " \n" or any(x in t for x in _TWO) or _APART.search(t):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(t))) if _PLAIN.fullmatch(t) else self.stored.encoded(t)
        first, *rest = t.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
        return self.stored.encoded(first) + b"".join(map(self.stored.__getitem__, rest))


def fullest(room: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """The combination of (length, count) that fills room best: {length: times}. Longer pieces are tried first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in available:
        if length > room:
            continue
        left, k = min(count, room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, end rank, first sequence, pieces a sequence, offset) for all pieces of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    given = dict.fromkeys(left, 0)
    segments, sequence = [], 0
    while left:
        longest = max(left)
        open_ = sorted(((n, c - (n == longest)) for n, c in left.items() if c > (n == longest)), reverse=True)
        bin_ = fullest(size - longest, open_)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[n] // k for n, k in bin_.items())
        offset = 0
        for n in sorted(bin_, reverse=True):
            k = bin_[n]
            segments.append((n, given[n], given[n] + k * times, sequence, k, offset))
            given[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += n * k
        sequence += times
    return segments


def cut(total: int, size: int = SEQUENCE) -> Iterable[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than size."""
    first = (total - 1) % size + 1
    yield 0, first
    for start in range(first, total, size):
        yield start, size


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """A row a piece, with its task and its rank among that task's pieces of its length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        encoder, closing = Encoder(path), np.array([CLOSING], "<u4").tobytes()
        for b in batches:
            ids_of = b.column("doc_id").to_pylist()
            texts = [x or "" for x in b.column("text").to_pylist()]
            rows = []
            for lo in range(0, len(texts), 64):  # few encodings in memory at once
                for doc_id, ids in zip(ids_of[lo : lo + 64], encoder.encode(texts[lo : lo + 64])):
                    ids += closing
                    for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece."""
    rows = written(pieces(docs, path, size), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # size rows at most
    segments = np.array(sorted(plan(histogram, size)) or np.zeros((0, 6)), np.int64).reshape(-1, 6)

    def place(batches):
        import pyarrow as pa

        # segments are in order of (length, first rank); ranks stay below 2 ** 52
        keys = segments[:, 0] * (1 << 52) + segments[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            _, first, _, sequence, k, offset = segments[np.searchsorted(keys, length * (1 << 52) + rank, "right") - 1].T
            into = rank - first
            own = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(sequence + into // k, pa.int64()), pa.array(offset + into % k * length, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = rows.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
