"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. The weights come from preference pairs (a document labelled 1
over one labelled 0) by logistic loss on feature differences; the threshold is the quantile of the strengths of all labelled
rows outside the held-out third, at their share of label 0. A score is the logistic of the distance from that threshold, so 0.5 is the threshold.

Fitting the weights reads FIT_ROWS labelled rows at most, those of the least hash of the id, and PAIRS seeded pairs of them;
threshold and scoring read every row. Defined cases: null text counts as empty and gets a score; a null id is never held out and never labelled;
with one label only, or none, all scores are 0.5 and so predicted 1; repeated rows score alike; of an id with several labels
or texts, one is used in fitting (of the least features) and for the threshold (of the least strength); an empty table gives an empty one; lang, source and doc_id are not features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import words, written

FIT_ROWS, PAIRS, RIDGE = 20_000, 200_000, 1e-3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÑÓÖÚÜ"


def features(docs: DataFrame) -> DataFrame:
    """docs with `f`, an array of doubles, of built-in expressions only."""
    own = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*own, text.alias("_t"), words(F.col("text")).alias("_w"), F.split(text, "\n").alias("_l"))
    n, w = F.greatest(F.length("_t"), F.lit(1)).cast("double"), F.greatest(F.size("_w"), F.lit(1)).cast("double")
    share = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))) / n
    variety = F.size(F.array_distinct("_w")) / w
    measures = [
        F.sqrt(share("#*$%&<>@^~_=+{}[]\\")), F.sqrt(share("|")), F.sqrt(share("!?")), F.sqrt(share("0123456789")),
        F.sqrt(share(CAPITALS)), F.sqrt(share(".,;:")), F.sqrt(share(" ")), F.sqrt(share("\n")), F.sqrt(share("()\"'/-")),
        F.log(w), F.log(n / w), variety, variety * F.log(w), F.size(F.array_distinct("_l")) / F.size("_l"),
        F.when(F.size("_w") < 20, 1.0).otherwise(0.0),
    ]
    return a.select(*own, F.array(*[m.cast("double") for m in measures]).alias("f"))


def bucket(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


class Ranking:
    """Standardised weights; plain numbers, so it can be a column expression."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 5):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = x.shape[1] if x.ndim == 2 else 0
        self.mean, self.weights = np.zeros(d), np.zeros(d)
        if not len(good) or not len(bad):
            return
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        z = (x - self.mean) / np.where(sd > 0, sd, 1)
        rng = np.random.default_rng(seed)
        diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(d)
        for _ in range(25):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = ridge * w - diff.T @ p / pairs
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w / np.where(sd > 0, sd, 1)

    def strength(self, f: Column) -> Column:
        s = F.lit(-float(self.mean @ self.weights))
        for k, w in enumerate(self.weights):
            s = s + F.element_at(f, k + 1) * F.lit(float(w))
        return s


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), a row an id: labels outside the held-out third."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (bucket(F.col("doc_id")) != 1))
    return own.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ranking:
    """Only from usable labels. The broadcast side and what reaches the driver have `rows` rows at most."""
    some = usable(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = features(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("f").alias("f"))
    got = chosen.orderBy("doc_id").toPandas()
    return Ranking(np.array(got["f"].tolist(), float), got["quality"].to_numpy(int))


def quantile(values: DataFrame, share: float, rows: int = FIT_ROWS) -> float:
    """The quantile of column v, exact, with linear interpolation; `rows` distinct values at most reach the driver."""
    left = values.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    n = left.agg(F.sum("c")).first()[0]
    if not n:
        return 0.0
    place = share * (n - 1)
    k = min(int(place), n - 1)
    below = 0  # values under those in left; the k-th and the next one are wanted
    while left.count() > rows:
        cuts = sorted(set(left.agg(F.percentile_approx("v", [j / 50 for j in range(1, 50)])).first()[0]))
        part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col("v")))
        sizes, starts = dict(left.groupBy(part.alias("p")).agg(F.sum("c")).collect()), {}
        at = below
        for p in sorted(sizes):
            starts[p], at = at, at + sizes[p]
        keep = [p for p in starts if starts[p] <= min(k + 1, n - 1) and starts[p] + sizes[p] > k]
        left, below = written(left.where(part.isin(keep)), "quantile"), starts[min(keep)]
    got = sorted(map(tuple, left.collect()))
    ends = np.cumsum([c for _, c in got]) + below
    a, b = (got[int(np.searchsorted(ends, j, side="right"))][0] for j in (k, min(k + 1, n - 1)))
    return float(a + (b - a) * (place - k))


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fitted(docs, labels, rows)
    every = written(features(docs.select("doc_id", "text")).select("doc_id", model.strength(F.col("f")).alias("v")), "strengths")
    known = written(every.join(usable(labels), "doc_id").groupBy("doc_id").agg(F.min("v").alias("v"), F.min("quality").alias("quality")), "known")
    share = known.agg(F.avg(1 - F.col("quality"))).first()[0]
    s = F.col("v") - F.lit(quantile(known.select("v"), share or 0.0, rows))
    score = 1 / (1 + F.exp(-F.greatest(F.least(s, F.lit(30.0)), F.lit(-30.0))))
    out = every.select("doc_id", (bucket(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
