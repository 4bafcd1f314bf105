"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are bigram models over character classes of a fixed alphabet, trained with add-one smoothing from labelled
samples (text, label: 1 for random). A candidate is a run of at least MIN_LENGTH characters of `[A-Za-z0-9+/_=-]` with a
letter in it; its score is the mean log-likelihood ratio a character, and it is a finding of kind `markov` if the score
exceeds the threshold. A run ends where an assignment begins, which reaches to its end anyway. A run that base spans cover
is no finding; one that they cover in part is scored whole, so that findings may overlap, and else the parts outside them
are, each as a candidate. Base spans always stay.

Defined cases: null text counts as empty; no findings give counts of 0 and empty spans; offsets are code points, the end
exclusive; repeated rows are scanned each on its own; very long texts are scanned whole; an empty table gives an empty one;
other columns pass `redacted`, whatever their names, and are not read by `scanned`.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs: the same as `AKIA[A-Z0-9]+` of 18 characters or more
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_LENGTH, THRESHOLD = 20, 0.35
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_LETTER = re.compile(r"[A-Za-z]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Parts of ordinary identifiers for the default labelled samples.
PARTS = """user name file path read write open close list index count total value key data base type class main test run
start stop begin end first last next prev size length width height color image page line word text string number result
error message request response server client host port session cache queue stack tree node edge graph table column row
record field order item price date time day month year update insert delete select create remove add get set find search
sort filter map reduce join merge split parse format print load save send receive connect config option default version
model train batch step epoch layer weight input output label score rank group member event handler listener callback
article section chapter title author content language country region address street number phone mail account invoice""".split()


def default_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n labelled samples of each kind: strings drawn evenly from usual key alphabets, and identifiers joined from PARTS."""
    rng = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = (upper[:6] + digits, lower + upper + digits, lower + digits, upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-")
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))), 1) for _ in range(n)]
    for _ in range(n):
        own = rng.choices(PARTS, k=rng.randint(3, 6)) + [str(rng.randint(0, 2030))] * rng.randint(0, 1)
        rng.shuffle(own)
        style = rng.randrange(4)
        out.append(("".join(x.capitalize() for x in own) if style == 0 else "_/-"[style - 1].join(own), 0))
    return out


class MarkovPair:
    """Bigram log-likelihood ratios, random against ordinary, as one matrix."""

    def __init__(self, samples: list[tuple[str, int]]):
        n = len(ALPHABET) + 1
        counts = np.ones((2, n, n))
        for text, label in samples:
            at = self.codes(text)
            np.add.at(counts[int(label == 1)], (at[:-1], at[1:]), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    @staticmethod
    @functools.cache
    def _table() -> np.ndarray:
        table = np.full(256, len(ALPHABET), np.int64)
        table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
        return table

    @classmethod
    def codes(cls, text: str) -> np.ndarray:
        return cls._table()[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]

    def score(self, text: str) -> float:
        at = self.codes(text)
        return float(self.ratio[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, model: MarkovPair, threshold: float = THRESHOLD) -> tuple[list, list]:
    """Base spans, and those with the model's added."""
    base = base_spans(text)
    more, k, live = [], 0, []

    def random_at(a: int, b: int) -> bool:
        return b - a >= MIN_LENGTH and _LETTER.search(text, a, b) is not None and model.score(text[a:b]) > threshold

    for m in _RUN.finditer(text):
        start, end = m.span()
        live = [x for x in live if x[2] > start]
        while k < len(base) and base[k][0] < end:
            live, k = live + [base[k]] if base[k][2] > start else live, k + 1
        end = min([end, *(x[0] for x in live if x[1] == 0)])
        parts, at = [], start
        for a, _, b in live:
            if a < end:
                parts.append((at, a))
                at = max(at, b)
        parts = [(a, b) for a, b in [*parts, (at, end)] if a < b]
        if parts:
            whole = [(start, end)] if random_at(start, end) else [x for x in parts if x != (start, end) and random_at(*x)]
            more += [(a, 3, b) for a, b in whole]
    return base, sorted(base + more)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """Overlapping spans become one mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, samples=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of docs (doc_id, text)."""
    model = MarkovPair(samples or default_samples())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts, shas, spans = [[], [], [], []], [], []
            for text in b.column("text").to_pylist():
                base, every = all_spans(text or "", model, threshold)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            cols = {"doc_id": b.column("doc_id").cast(pa.int64())} | {f"n_{n}": pa.array(c, pa.int64()) for n, c in zip(KINDS, counts)}
            yield pa.RecordBatch.from_pydict(cols | {"base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string())})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, samples=None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every finding replaced by a mark; n_chars, if there, follows the text. Null texts stay null."""
    model = MarkovPair(samples or default_samples())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t if t is None else redact(t, all_spans(t, model, threshold)[1]) for t in b.column("text").to_pylist()]
            names = b.schema.names
            b = b.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                n = [old if t is None else len(t) for t, old in zip(texts, b.column("n_chars").to_pylist())]
                b = b.set_column(names.index("n_chars"), "n_chars", pa.array(n, b.schema.field("n_chars").type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scanned(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
