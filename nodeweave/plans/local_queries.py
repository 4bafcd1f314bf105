"""Queries of blended patches, matrix kernels, crowding, lattices and stability on the test tables, with their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nodeweave.functions import stability
from nodeweave.functions.scalar import quantised
from nodeweave.operators import divfree, partition, sampling
from nodeweave.plans.point_queries import _C, _CD, _PATCH, centers
from nodeweave.plans.registry import customers, q, query, table


@query(f"""WITH {_PATCH}, r AS (SELECT q, p, sqrt(d2) / 150 AS s FROM p WHERE sqrt(d2) < 150),
w AS (SELECT q, p, (1-s)**8 * (32*s*s*s + 25*s*s + 8*s + 1) AS raw FROM r), t AS (SELECT *, sum(raw) OVER (PARTITION BY q) AS total FROM w),
n AS (SELECT q, p, raw / total AS w FROM t WHERE total > 1e-14 AND raw > 0)
SELECT q, p, {q('w')} AS w FROM n UNION ALL SELECT q, arg_min(p, (d2, p)), 1.0::DOUBLE FROM p WHERE q NOT IN (SELECT q FROM n) GROUP BY q""")
def unity_weights(spark, d):
    return partition.unity_weights(customers(spark, d), centers(spark, d), 150.0, 2).select("q", "p", quantised("w").alias("w"))


_NEXT = "v AS (SELECT a.c_custkey AS id, (a.c_custkey % 10 - b.c_custkey % 10)::DOUBLE / 10 AS dx, (a.c_acctbal - b.c_acctbal) / 1000 AS dy FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1), r AS (SELECT *, sqrt(dx * dx + dy * dy) AS r FROM v)"


def following(spark, d):
    """Each customer's point x with the next one's, y."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).cast("double").alias("u"), F.col("c_acctbal").alias("v"))
    y = c.select((F.col("id") - 1).alias("id"), F.array(F.col("u") / 10, F.col("v") / 1000).alias("y"))
    return c.select("id", F.array(F.col("u") / 10, F.col("v") / 1000).alias("x")).join(y, "id")


def _entries(df):
    return df.select("id", *[quantised(f"k{a}{b}", 4).alias(f"k{a}{b}") for a in range(2) for b in range(2)])


def _entries_sql(**made: str) -> str:
    return f"WITH {_NEXT} SELECT id, {', '.join(f'floor(({x}) * 10000 + 0.5) / 10000 AS {n}' for n, x in made.items())} FROM r"


@query(_entries_sql(k00="3 * dx * dx / r - 6 * r", k01="3 * dx * dy / r", k10="3 * dx * dy / r", k11="3 * dy * dy / r - 6 * r"))
def divfree_phs(spark, d):
    """(-Laplacian I + grad grad') r^3 in the plane: 3 (I + dd'/r^2) r - 9 r I."""
    return _entries(divfree.phs_entries(following(spark, d), 3, 2))


_PARTS = divfree.mixture(4.0)
_WHOLE = sum(w * e * e for e, w in _PARTS)
_OWN = " + ".join(f"{w / _WHOLE!r}::DOUBLE * exp(-{e!r}::DOUBLE * r) * ({e * e!r}::DOUBLE * (1 + {e!r}::DOUBLE * r) - {e**4!r}::DOUBLE * r * r)" for e, w in _PARTS)
_CROSS = "(" + " + ".join(f"{w / _WHOLE!r}::DOUBLE * exp(-{e!r}::DOUBLE * r) * {e**4!r}::DOUBLE" for e, w in _PARTS) + ")"


@query(_entries_sql(k00=f"{_OWN} + {_CROSS} * dx * dx", k01=f"{_CROSS} * dx * dy", k10=f"{_CROSS} * dx * dy", k11=f"{_OWN} + {_CROSS} * dy * dy"))
def divfree_matern(spark, d):
    return _entries(divfree.matern_entries(following(spark, d), _PARTS, 2))


@query(f"WITH {_C} SELECT a.id, {q(f'coalesce(sum((1 - sqrt({_CD}) / 200) ** 8), 0)')} AS weight FROM c a LEFT JOIN c b ON a.id <> b.id AND sqrt({_CD}) <= 200 GROUP BY a.id")
def crowding(spark, d):
    return sampling.crowding(customers(spark, d), 100.0, 2).select("id", quantised("weight").alias("weight"))


_UP = 0.05 * math.sqrt(3) / 2
_ACROSS, _ROWS = math.ceil((2 + 0.15) / 0.05), math.ceil((2 + 3 * _UP) / _UP)


@query(f"""WITH g AS (SELECT i, j, -1 - 0.05::DOUBLE + i * 0.05::DOUBLE + 0.25 * 0.05::DOUBLE + 0.5 * 0.05::DOUBLE * (j % 2) AS x, -1 - {_UP!r}::DOUBLE + j * {_UP!r}::DOUBLE - 0.2 * {_UP!r}::DOUBLE AS y
FROM (SELECT range AS i FROM range({_ACROSS})), (SELECT range AS j FROM range({_ROWS}))) SELECT j * {_ACROSS} + i AS id, {q('x')} AS x, {q('y')} AS y FROM g WHERE x * x + y * y < (1 - 1e-8)**2 AND x * x + y * y >= (0.3 - 1e-8)**2""")
def annulus_lattice(spark, d):
    """Of fixed size."""
    return sampling.annulus_lattice(spark, 0.3, 1.0, 0.05, (0.75, 0.3)).select("id", quantised("x").alias("x"), quantised("y").alias("y"))


@query("""WITH m AS (SELECT c_custkey AS id, -abs(c_acctbal) / 5000 AS zi, -(c_custkey % 97)::DOUBLE / 60 AS ze FROM customer),
p AS (SELECT id, (-18 - 18 * ze) / (11 - 6 * zi) AS b, (9 + 18 * ze) / (11 - 6 * zi) AS c, (-2 - 6 * ze) / (11 - 6 * zi) AS d FROM m)
SELECT id, 1 + b + c + d > 0 AND 1 - b + c - d > 0 AND abs(d) < 1 AND abs(c - b * d) < 1 - d * d AS stable FROM p""")
def sbdf3_stable(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (-F.abs("c_acctbal") / 5000).alias("zi"), (-(F.col("c_custkey") % 97).cast("double") / 60).alias("ze"))
    return m.select("id", stability.sbdf3_stable(F.col("zi"), F.col("ze")).alias("stable"))
