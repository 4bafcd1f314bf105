"""Queries of outlines, patches, supports and neighbourhoods on the test tables, with their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.functions.scalar import quantised
from nodeweave.operators import geometry, greedy, series, spatial
from nodeweave.operators.joins import shuffled
from nodeweave.plans.registry import customers, q, query, table

# --- chains: the customers of each nation in order of their keys


_CHAIN = "e AS (SELECT c_nationkey::BIGINT AS poly, c_custkey AS seq, c_custkey::DOUBLE AS ax, c_acctbal AS ay, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w)::DOUBLE AS bx, coalesce(lead(c_acctbal) OVER w, first_value(c_acctbal) OVER w) AS b_y FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))"
_LEN = "l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS l FROM e)"


def chains(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("poly"), F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))


@query(f"""WITH {_CHAIN}, {_LEN}, s AS (SELECT poly, sum(l) AS length, sum(ax * b_y - bx * ay) AS c, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy FROM l GROUP BY poly)
SELECT poly, {q('length')} AS length, floor(0.5 * c * 1000 + 0.5) / 1000 AS area, floor(sx / (3 * c) * 1000 + 0.5) / 1000 AS cx, floor(sy / (3 * c) * 1000 + 0.5) / 1000 AS cy FROM s""")
def curve_measures(spark, d):
    m = geometry.curve_measures(chains(spark, d))
    return m.select("poly", quantised("length").alias("length"), *[quantised(c, 3).alias(c) for c in ("area", "cx", "cy")])


@query(f"""WITH {_CHAIN}, {_LEN}, t AS (SELECT poly, seq, coalesce(sum(l) OVER (PARTITION BY poly ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
sum(l) OVER (PARTITION BY poly) AS total, CASE WHEN lead(seq) OVER (PARTITION BY poly ORDER BY seq) IS NULL THEN 0 ELSE l END AS open_l FROM l)
SELECT poly, seq, {q('s / total')} AS closed, {q('s / sum(open_l) OVER (PARTITION BY poly)')} AS open FROM t""")
def chord_parameters(spark, d):
    c = chains(spark, d)
    closed, open_ = geometry.chord_parameter(c), geometry.chord_parameter(c, closed=False).withColumnRenamed("s", "o")
    return closed.join(open_, ["poly", "seq"]).select("poly", "seq", quantised("s").alias("closed"), quantised("o").alias("open"))


@query(f"""WITH {_CHAIN}, {_LEN}, v AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY poly ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM l),
t AS (SELECT poly, range AS k, range * (total / 40) AS pos FROM (SELECT poly, sum(l) AS total FROM l GROUP BY poly), range(40)),
m AS (SELECT t.poly, t.k, t.pos, max(seq) AS seq FROM t JOIN v ON t.poly = v.poly AND v.cum <= t.pos GROUP BY ALL)
SELECT m.poly, m.k, floor((ax + (pos - cum) / greatest(l, 2.220446049250313e-16) * (bx - ax)) * 10000 + 0.5) / 10000 AS x, floor((ay + (pos - cum) / greatest(l, 2.220446049250313e-16) * (b_y - ay)) * 10000 + 0.5) / 10000 AS y FROM m JOIN v USING (poly, seq)""")
def arc_resampling(spark, d):
    return geometry.resampled(chains(spark, d), 40).select("poly", "k", quantised("x", 4).alias("x"), quantised("y", 4).alias("y"))


# --- outlines: two star-shaped chains of the nations' keys, and customers strewn over their box


_STAR = f"""o AS (SELECT p AS poly, n_nationkey::BIGINT AS seq, 5000 + 3000 * p + (3500 + 300 * (n_nationkey % 5)) * cos(n_nationkey * {2 * math.pi / 25!r}::DOUBLE) AS x,
4500 + (3500 + 300 * (n_nationkey % 5)) * sin(n_nationkey * {2 * math.pi / 25!r}::DOUBLE) AS y FROM nation, (SELECT unnest([0, 1]) AS p)),
e AS (SELECT poly, seq, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM o WINDOW w AS (PARTITION BY poly ORDER BY seq)),
c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10000)::DOUBLE AS x, c_acctbal AS y FROM customer)"""


def stars(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.explode(F.array(F.lit(0), F.lit(1))).alias("poly"))
    size, angle = 3500 + 300 * (F.col("seq") % 5), F.col("seq") * (2 * math.pi / 25)
    return n.select("poly", "seq", (5000 + 3000 * F.col("poly") + size * F.cos(angle)).alias("x"), (4500 + size * F.sin(angle)).alias("y"))


def strewn(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 10000).cast("double").alias("x"), F.col("c_acctbal").alias("y"))


@query(f"WITH {_STAR} SELECT id, poly FROM c, e GROUP BY id, poly HAVING sum(((ay > c.y) <> (b_y > c.y) AND c.x < ax + (c.y - ay) * (bx - ax) / (CASE WHEN b_y = ay THEN 1 ELSE b_y - ay END))::INT) % 2 = 1")
def points_in_polygon(spark, d):
    return geometry.in_polygon(strewn(spark, d), stars(spark, d))


@query(f"""WITH {_STAR}, a AS (SELECT id, x, y FROM c UNION ALL SELECT -1 - seq - 100 * poly, x, y FROM o UNION ALL SELECT -1001 - seq - 100 * poly, (ax + bx) / 2, (ay + b_y) / 2 FROM e)
SELECT id FROM a WHERE id >= 0""")
def points_off_outline(spark, d):
    """Vertices and the middles of edges lie on the outline, and no customer does."""
    o = stars(spark, d)
    on = o.select((-1 - F.col("seq") - 100 * F.col("poly")).alias("id"), "x", "y")
    middles = geometry.edges(o).select((-1001 - F.col("seq") - 100 * F.col("poly")).alias("id"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    return geometry.off_outline(strewn(spark, d).unionByName(on).unionByName(middles), o).select("id")


_SUP = "s AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10000)::DOUBLE AS x, s_acctbal AS y FROM supplier)"
_HULL = f"{_SUP}, h AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM s a JOIN s b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM s p WHERE (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0))"


def suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7919) % 10000).cast("double").alias("x"), F.col("s_acctbal").alias("y"))


@query(f"WITH {_HULL} SELECT DISTINCT ax AS x, ay AS y FROM h")
def convex_hull(spark, d):
    return geometry.convex_hull(suppliers(spark, d)).select("x", "y")


@query(f"WITH {_HULL}, c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10000)::DOUBLE AS x, c_acctbal AS y FROM customer) SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE (bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) < -1e-12)")
def points_in_hull(spark, d):
    return geometry.in_hull(strewn(spark, d), geometry.convex_hull(suppliers(spark, d))).select("id")


_MARK = "m AS (SELECT s_suppkey AS p, s_suppkey * 10.0::DOUBLE + 0.75 * 40 * 0.6 AS x, s_acctbal + 0.75 * 40 * 0.8 AS y FROM supplier)"


@query(f"""WITH {_MARK}, c AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_acctbal AS y FROM customer),
n AS (SELECT id, c.x, c.y, arg_min((m.x, m.y), ((c.x - m.x) * (c.x - m.x) + (c.y - m.y) * (c.y - m.y), p)) AS m FROM c, m GROUP BY ALL)
SELECT id FROM n WHERE (x - m[1]) * 0.6 + (y - m[2]) * 0.8 > 1e-12""")
def outside_inflated(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_suppkey") * 10.0, F.col("s_acctbal")).alias("pos"), F.array(F.lit(0.6), F.lit(0.8)).alias("normal"))
    return geometry.outside_inflated(customers(spark, d), m, 40.0, 2)


_RING = f"m AS (SELECT n_nationkey AS k, 4500 + 4000 * cos((n_nationkey + 0.5) * {2 * math.pi / 25!r}::DOUBLE) AS x, 4500 + 4000 * sin((n_nationkey + 0.5) * {2 * math.pi / 25!r}::DOUBLE) AS y, {4000 * 2 * math.pi / 25!r}::DOUBLE * cos((n_nationkey + 0.5) * {2 * math.pi / 25!r}::DOUBLE) AS u, {4000 * 2 * math.pi / 25!r}::DOUBLE * sin((n_nationkey + 0.5) * {2 * math.pi / 25!r}::DOUBLE) AS v FROM nation)"


@query(f"WITH {_RING}, c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10000)::DOUBLE AS x, c_acctbal AS y FROM customer) SELECT id, {q('sum(((m.x - c.x) * u + (m.y - c.y) * v) / ((m.x - c.x)**2 + (m.y - c.y)**2)) / (2 * pi())')} AS w FROM c, m GROUP BY id")
def winding_numbers(spark, d):
    angle = (F.col("n_nationkey") + 0.5) * (2 * math.pi / 25)
    size = 4000 * 2 * math.pi / 25
    ring = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(4500 + 4000 * F.cos(angle), 4500 + 4000 * F.sin(angle)).alias("pos"), F.array(size * F.cos(angle), size * F.sin(angle)).alias("area_normal"))
    c = strewn(spark, d).select("id", F.array("x", "y").alias("pos"))
    return geometry.winding(c, ring, 2).select("id", quantised("w").alias("w"))


@query(f"SELECT {q('64 * avg(f)')} AS measure FROM (SELECT ((i * (8.0::DOUBLE / 31) - 4)**2 / 9 + (j * (8.0::DOUBLE / 31) - 4)**2 / 4 <= 1)::INT::DOUBLE AS f FROM (SELECT range AS i FROM range(32)), (SELECT range AS j FROM range(32)))")
def measure_inside(spark, d):
    """An ellipse of half axes 3 and 2 in the box [-4, 4]^2."""
    return geometry.measure_inside(spark, [-4.0, -4.0], [4.0, 4.0], lambda x, y: x * x / 9 + y * y / 4 <= 1).select(quantised("measure").alias("measure"))


# --- neighbourhoods


_C = "c AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_acctbal AS y, c_nationkey AS n FROM customer)"
_CD = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(f"WITH {_C} SELECT q, p, rank FROM (SELECT a.id AS q, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY {_CD}, b.id) AS rank FROM c a, c b WHERE b.n % 3 = 0) WHERE rank <= 3")
def masked_knn(spark, d):
    c = customers(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n")), "id")
    return spatial.masked_knn(c, c, "n % 3 = 0", 3, 2).select("q", "p", F.col("rank").cast("long").alias("rank"))


_L = 9000.0
_WRAP = "(({0}) - 9000.0::DOUBLE * sign({0}) * floor(abs({0}) / 9000.0::DOUBLE + 0.5::DOUBLE))"
_PC = "c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 9000)::DOUBLE AS x, c_acctbal - 9000.0::DOUBLE * floor(c_acctbal / 9000.0::DOUBLE) AS y FROM customer)"
_PX, _PY = _WRAP.format("a.x - b.x"), _WRAP.format("a.y - b.y")


def wrapped_points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(((F.col("c_custkey") * 7919) % 9000).cast("double"), scalar.wrapped("c_acctbal", _L)).alias("pos"))


@query(f"WITH {_PC} SELECT q, rank, {q('sqrt(d2)')} AS d FROM (SELECT a.id AS q, {_PX} * {_PX} + {_PY} * {_PY} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_PX} * {_PX} + {_PY} * {_PY}, b.id) AS rank FROM c a, c b) WHERE rank <= 3")
def periodic_knn(spark, d):
    c = wrapped_points(spark, d)
    return spatial.periodic_knn(c, c, 3, [_L, _L]).select("q", F.col("rank").cast("long").alias("rank"), quantised(F.sqrt("d2")).alias("d"))


@query(f"WITH {_PC} SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id WHERE sqrt({_PX} * {_PX} + {_PY} * {_PY}) < 1.5 * greatest(50 + a.id % 40, 50 + b.id % 40)")
def periodic_conflicts(spark, d):
    c = wrapped_points(spark, d).withColumn("radius", (50 + F.col("id") % 40).cast("double"))
    return spatial.periodic_conflicts(c, [_L, _L], 1.5)


_PATCH = f"{_C}, s AS (SELECT s_suppkey AS id, s_suppkey * 10.0::DOUBLE AS x, s_acctbal AS y FROM supplier), p AS (SELECT a.id AS q, b.id AS p, {_CD} AS d2 FROM c a, s b)"


def centers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_suppkey") * 10.0, F.col("s_acctbal")).alias("pos"))


@query(f"WITH {_PATCH}, n AS (SELECT q, p FROM p WHERE sqrt(d2) < 150) SELECT q, p FROM n UNION ALL SELECT q, arg_min(p, (d2, p)) FROM p WHERE q NOT IN (SELECT q FROM n) GROUP BY q")
def query_patches(spark, d):
    return spatial.patches_of(customers(spark, d), centers(spark, d), 150.0, 2)


@query(f"WITH {_PATCH} SELECT q, p FROM (SELECT p AS q, q AS p, d2, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rank FROM p) WHERE sqrt(d2) <= 150 OR rank <= 8")
def patch_nodes(spark, d):
    return spatial.patch_nodes(centers(spark, d), customers(spark, d), 150.0, 8).select("q", "p")


@query(f"WITH {_C}, e AS (SELECT a.id AS row, b.id AS col FROM c a, c b WHERE sqrt({_CD}) < 120) SELECT row, col, indptr FROM e JOIN (SELECT row, coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS indptr FROM (SELECT row, count(*) AS n FROM e GROUP BY row)) USING (row)")
def compact_support(spark, d):
    c = customers(spark, d)
    entries, starts = spatial.support_topology(c, 120.0, 2)
    return entries.join(shuffled(starts), "row")


@query("""WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.id AS q, b.id AS p FROM p a, p b WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.1""")
def cap_members(spark, d):
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("pos"))
    return spatial.cap_members(p, p, 0.1)


@query(f"WITH {_C}, s AS (SELECT s_suppkey AS q, s_suppkey * 10.0::DOUBLE - 100 AS lx, s_suppkey * 10.0::DOUBLE + 100 AS hx, s_acctbal - 150 AS ly, s_acctbal + 50 AS hy FROM supplier) SELECT q, id AS p FROM s, c WHERE x >= lx AND x <= hx AND y >= ly AND y <= hy")
def box_members(spark, d):
    s = table(spark, d, "supplier")
    x = F.col("s_suppkey") * 10.0
    boxes = s.select(F.col("s_suppkey").alias("id"), F.array(x - 100, F.col("s_acctbal") - 150).alias("low"), F.array(x + 100, F.col("s_acctbal") + 50).alias("high"))
    return spatial.box_members(customers(spark, d), boxes, 200.0, 2)


@query(f"WITH {_C}, p AS (SELECT a.id AS q, {_CD} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_CD}, b.id) AS rank FROM c a, c b WHERE sqrt({_CD}) <= 200) SELECT q, {q('max(CASE WHEN rank = 5 THEN sqrt(d2) END)')} AS d FROM p GROUP BY q")
def kth_distance(spark, d):
    c = customers(spark, d)
    return spatial.kth_distance(spatial.within(c, c, 200.0, 2), 5).select("q", quantised("d").alias("d"))


@query(f"WITH {_C}, n AS (SELECT a.id, min(sqrt({_CD})) AS d FROM c a JOIN c b ON a.id <> b.id GROUP BY a.id) SELECT {q('max(d) / min(d)')} AS quality FROM n")
def point_quality(spark, d):
    return spatial.point_quality(customers(spark, d), 2).select(quantised("quality").alias("quality"))


@query("SELECT min(c_custkey) AS id FROM customer GROUP BY c_custkey % 50, floor(c_acctbal / 500)")
def merged_points(spark, d):
    """Customers on a coarse grid coincide; the least of each place stays."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_custkey") % 50).cast("double"), F.floor(F.col("c_acctbal") / 500).cast("double")).alias("pos"))
    return greedy.merged_points(c, 1e-9, 2).select("id")


@query(f"""WITH {_C}, p AS (SELECT sqrt({_CD}) AS d, (a.n - b.n) * (a.n - b.n)::DOUBLE AS i FROM c a JOIN c b ON a.id < b.id WHERE sqrt({_CD}) <= 400)
SELECT bin, {q(f'20 * exp((bin + 0.5::DOUBLE) * {math.log(20) / 6!r}::DOUBLE)')} AS r, {q('avg(i)')} AS value FROM (SELECT least(floor(ln(d / 20) / {math.log(20) / 6!r}::DOUBLE)::BIGINT, 5) AS bin, i FROM p WHERE d >= 20 AND d < 400) GROUP BY bin""")
def structure_function(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey").cast("double"), F.col("c_acctbal")).alias("pos"), F.col("c_nationkey").cast("double").alias("n"))
    change = F.col("q_n") - F.col("p_n")
    pairs = spatial.pairs_within(c, 400.0, 2, ("n",)).select(F.sqrt("d2").alias("d"), (change * change).alias("increment"))
    return series.structure_function(pairs, 20.0, 400.0, 6).select("bin", quantised("r").alias("r"), quantised("value").alias("value"))
