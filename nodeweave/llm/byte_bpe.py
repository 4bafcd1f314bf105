"""Byte-level BPE by the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before encoding: after an ASCII letter or digit that a space or line feed follows.
No match of the pattern spans such a place, and none looks behind it, so the parts' ids joined are the whole text's ids.
A text without such a place stays in one part. Defined cases: null and empty texts have no ids; repeated rows are encoded
each on its own; strings of special tokens are ordinary text; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

from pyspark.sql import DataFrame

RANKS, PART = "byte_bpe_multi_50k.tiktoken", 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def encoding(path: str):
    """Loaded once a worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART):
    """The text in parts of about size characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str, path: str, size: int = PART) -> list[int]:
    enc = encoding(path)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text, size):
        ids += enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], path: str) -> bytes:
    """The raw bytes, whatever they are as text."""
    return encoding(path).decode_bytes(ids)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text); ids too if asked for."""

    def run(batches):
        import pyarrow as pa

        names = None
        for b in batches:
            names = names or [str(i) for i in range(encoding(path).n_vocab)]
            counts, shas, backs, lists = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = encode(text or "", path)
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                backs.append(hashlib.sha256(decode(ids, path)).hexdigest())
                if with_ids:
                    lists.append(ids)
            cols = {"doc_id": b.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(backs, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks_path())
