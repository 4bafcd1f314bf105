"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Defined cases: null or blank text has no words and fails; an empty table gives an empty one; repeated rows are judged
each on its own; very long texts are one row's arrays, a few times the text in memory; extra columns pass through
`quality_rules` unless they bear one of its own column names (in letters of either case), in which case the measure
replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import blank_free, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on was as are this by at from or an not",
    "fr": "le la les de des du et un une que qui en dans est pour par sur au pas ne il elle plus avec",
    "de": "der die das und in zu den von mit ist nicht ein eine für im dem auf als auch es an werden aus sich",
    "es": "de la el los las y en un una que se por con del para no su al lo es como más o pero",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= expression <= most; the expression is Spark SQL over the measures."""

    name: str
    expression: str
    least: float | None = None
    most: float | None = None


#: Published heuristics (Gopher, C4 style), loose enough for any of the four languages. All but the first two need words.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeated_windows", "100 * n_repeat_words - 50 * n_words", most=0),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", least=2, most=25),
    Rule("symbols_per_word", "try_divide(n_symbols, n_words)", most=0.25),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", least=0.02),
    Rule("duplicate_lines", "try_divide(n_dup_lines, greatest(n_lines, 1))", most=0.5),
    Rule("shouted_words", "try_divide(n_shouted, n_words)", most=0.7),
)


def compiled(rules: tuple[Rule, ...] = RULES):
    """One Boolean Spark expression out of the table; an undefined ratio (no words) fails."""
    parts = []
    for r in rules:
        parts += [f"({r.expression}) >= {r.least}"] * (r.least is not None) + [f"({r.expression}) <= {r.most}"] * (r.most is not None)
    return F.coalesce(F.expr(" AND ".join(f"({p})" for p in parts) or "true"), F.lit(False))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouted"]


def _others(docs: DataFrame, names) -> list[str]:
    return [c for c in docs.columns if c.lower() not in names]


def measured(docs: DataFrame) -> DataFrame:
    """docs with MEASURES. The input's columns travel in one struct, `row`, so that no name meets another; arrays that
    lambdas read are columns of an earlier projection, so they're built once a row.

    The measures come out of a generator of one row: a filter on them stays above it. Pushed below, it would repeat the
    nested measures in itself until planning never ends.
    """
    own = _others(docs, MEASURES)
    stop = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(F.struct(*own).alias("row"), text.alias("t"), words(F.col("text")).alias("w"), F.split(text, "\n", -1).alias("l"))
    a = a.select(
        "row", "t", "w", F.filter("l", lambda x: blank_free(x) != "").alias("l"),
        F.expr("CASE WHEN size(w) < 3 THEN cast(array() AS array<string>) ELSE transform(slice(w, 1, size(w) - 2), (x, i) -> concat(x, ' ', w[i + 1], ' ', w[i + 2])) END").alias("g"),
    )
    # windows in sorted order, for texts that repeat any
    a = a.withColumn("s", F.expr("CASE WHEN size(g) = size(array_distinct(g)) THEN NULL ELSE sort_array(transform(g, (x, i) -> struct(x AS g, i AS i))) END"))
    at = "sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].g = x.g) OR (k < size(s) - 1 AND s[k + 1].g = x.g)), x -> x.i))"
    covered = f"CASE WHEN s IS NULL THEN 0L ELSE aggregate({at}, struct(0L AS n, -3 AS p), (y, i) -> struct(y.n + least(3, i - y.p) AS n, i AS p), y -> y.n) END"
    measures = [
        F.size("w").cast("long"),
        F.length(blank_free(F.col("t"))).cast("long"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        F.expr(covered),
        F.size("l").cast("long"),
        F.size(F.filter("w", lambda w: F.lower(w).isin(stop))).cast("long"),
        F.size(F.filter("w", lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long"),
    ]
    made = F.struct(*[m.alias(n) for m, n in zip(measures, MEASURES)])
    return a.select("row", F.inline(F.array(made))).select("row.*", *MEASURES)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    rows = measured(docs.select(*_others(docs, ("base_failed", "kept"))))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return rows.select("*", failed.alias("base_failed"), (compiled(rules) & ~failed).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *MEASURES[:5], "base_failed", "kept")


def oracle10() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, w, (g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1)::int AS rep FROM g),
v AS (SELECT r, w, max(rep) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM h),
a AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words, sum((lower(w) IN ({stop}))::int) AS n_stop,
  sum((upper(w) = w AND lower(w) <> w)::int) AS n_shout FROM v GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop, coalesce(n_shout, 0) AS n_shout
  FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed OR n_words = 0 THEN false ELSE word_chars / n_words::DOUBLE BETWEEN 2 AND 25 AND n_symbols / n_words::DOUBLE <= 0.25
    AND n_stop / n_words::DOUBLE >= 0.02 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AND n_shout / n_words::DOUBLE <= 0.7 END AS kept
FROM b"""
