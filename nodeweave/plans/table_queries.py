"""Queries of functions, rows, matrices and series on the test tables, with their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nodeweave.functions import polynomials, scalar
from nodeweave.functions.scalar import quantised
from nodeweave.operators import coo, rows, series
from nodeweave.plans.registry import customers, q, query, table


def columns(df, *keys, **made):
    return df.select(*keys, *[quantised(x).alias(n) for n, x in made.items()])


def sql(source: str, *keys: str, **made: str) -> str:
    return f"SELECT {', '.join([*keys, *[f'{q(x)} AS {n}' for n, x in made.items()]])} FROM {source}"


# --- functions of a column


_R = "(SELECT c_custkey AS id, c_acctbal AS b, abs(c_acctbal) / 8000.0::DOUBLE AS r FROM customer)"


def radii(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"), (F.abs("c_acctbal") / 8000.0).alias("r"))


def _matern_sql(p: int, length: float) -> str:
    z = f"(r * ({math.sqrt(2 * p + 1)!r}::DOUBLE / {length}::DOUBLE))"
    terms = {2: f"1 + {z} + {z} * {z} / 3", 3: f"1 + {z} + 2 * {z} * {z} / 5 + {z} * {z} * {z} / 15"}[p]
    return f"exp(-{z}) * ({terms})"


@query(sql(
    _R, "id", phs3="r * r * r", phs4="CASE WHEN r = 0 THEN 0 ELSE r * r * r * r * ln(r + 2e-16::DOUBLE) END", lap3d="12 * r", slope5="5 * r * r * r",
    lap2_5="360 * r", lap2_7="1680 * r * r * r", wendland="CASE WHEN r < 1 THEN (1-r)**6 * (1 + 6*r + 35*r*r/3) ELSE 0 END",
    pu="CASE WHEN r < 1 THEN (1-r)**8 * (32*r*r*r + 25*r*r + 8*r + 1) ELSE 0 END",
))
def kernels(spark, d):
    r = "r"
    return columns(
        radii(spark, d), "id", phs3=scalar.phs(r, 3), phs4=scalar.phs(r, 4), lap3d=scalar.phs_laplacian(r, 3, 3), slope5=scalar.phs_slope(r, 5),
        lap2_5=scalar.phs_iterated_laplacian(r, 5, 3, 2), lap2_7=scalar.phs_iterated_laplacian(r, 7, 3, 2), wendland=scalar.wendland_c4(r), pu=scalar.pu_weight(r),
    )


@query(sql(
    _R, "id", matern52=_matern_sql(2, 0.7), matern72=_matern_sql(3, 1.5), gauss="exp(-(r / 0.4::DOUBLE) * (r / 0.4::DOUBLE) / 2)",
    gate="CASE WHEN r <= 0.5 THEN 1 WHEN r >= 1 THEN 0 ELSE (2*(1-r))**5 * (126 - 420 * (2*(1-r)) + 540 * (2*(1-r))**2 - 315 * (2*(1-r))**3 + 70 * (2*(1-r))**4) END",
))
def covariance_kernels(spark, d):
    return columns(radii(spark, d), "id", matern52=scalar.matern("r", 0.7), matern72=scalar.matern("r", 1.5, 3), gauss=scalar.gaussian("r", 0.4), gate=scalar.compact_gate("r"))


@query(sql(
    _R, "id", same5="5 * r*r*r + 15 * (0.6*r) * (0.6*r) * r", cross5="15 * (0.6*r) * (0.8*r) * r",
    same4="CASE WHEN r > 0 THEN r*r * (1 + 4 * ln(r + 2e-16::DOUBLE)) + (0.6*r) * (0.6*r) * (6 + 8 * ln(r + 2e-16::DOUBLE)) ELSE 0 END",
    cross4="CASE WHEN r > 0 THEN (0.6*r) * (0.8*r) * (6 + 8 * ln(r + 2e-16::DOUBLE)) ELSE 0 END",
))
def second_derivatives(spark, d):
    a, b = 0.6 * F.col("r"), 0.8 * F.col("r")
    made = {f"{n}{m}": scalar.phs_second("r", a, a if n == "same" else b, m, n == "same") for m in (5, 4) for n in ("same", "cross")}
    return columns(radii(spark, d), "id", **made)


_XY = "(SELECT c_custkey AS id, (c_custkey % 97) / 97.0::DOUBLE AS x, c_acctbal / 10000.0::DOUBLE AS y FROM customer)"


def plane(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 97) / 97.0).alias("x"), (F.col("c_acctbal") / 10000.0).alias("y"))


_TAU = "(x - 0.3::DOUBLE)", "(y - 0.2::DOUBLE)"


@query(sql(
    _XY, "id", anisotropic=f"exp(-0.5::DOUBLE * ((2 * {_TAU[0]} + 0.5 * {_TAU[1]})**2 + (1.5 * {_TAU[1]})**2))",
    gibbs=f"sqrt(2 * (0.5 + x) * 0.8::DOUBLE / ((0.5 + x)**2 + 0.64::DOUBLE)) * exp(-({_TAU[0]}**2 + {_TAU[1]}**2) / ((0.5 + x)**2 + 0.64::DOUBLE))",
    mixture=f"0.7 * cos(3 * {_TAU[0]} + 1 * {_TAU[1]}) * (exp(-0.5 * {_TAU[0]}**2 / exp(-2.0::DOUBLE)) + exp(-0.5 * {_TAU[1]}**2 / exp(-2.0::DOUBLE)))"
    f" + 0.2 * cos(0.5 * {_TAU[0]} + 2 * {_TAU[1]}) * (exp(-0.5 * {_TAU[0]}**2) + exp(-0.5 * {_TAU[1]}**2))",
))
def learned_kernels(spark, d):
    p, c = F.array("x", "y"), F.array(F.lit(0.3), F.lit(0.2))
    mix = scalar.spectral_mixture(p, c, [0.7, 0.2], [[3.0, 1.0], [0.5, 2.0]], [-1.0, 0.0])
    return columns(plane(spark, d), "id", anisotropic=scalar.anisotropic_gaussian(p, c, [[2.0, 0.0], [0.5, 1.5]]), gibbs=scalar.gibbs(scalar.squared_distance(p, c), 0.5 + F.col("x"), F.lit(0.8)), mixture=mix)


_AWAY = "sign(b / 777.0::DOUBLE) * floor(abs(b / 777.0::DOUBLE) + 0.5::DOUBLE)"


@query(sql(_R, "id", image=f"b - 777.0::DOUBLE * ({_AWAY})", wrapped="b - 777.0::DOUBLE * floor(b / 777.0::DOUBLE)", ring="sqrt(greatest(2 - 2 * cos(b), 0))", cap="sqrt(greatest(2 - 2 * cos(r), 0))"))
def images(spark, d):
    return columns(radii(spark, d), "id", image=scalar.minimum_image("b", 777.0), wrapped=scalar.wrapped("b", 777.0), ring=scalar.periodic_chord("b"), cap=scalar.sphere_chord(F.cos("r")))


_DIGITS = "list_sum(list_transform(range(0, {n}), lambda k: ((c_custkey // ({b}::BIGINT ** k)::BIGINT) % {b}) / ({b}::DOUBLE ** (k + 1))))"


@query(sql("customer", "c_custkey AS id", base2=_DIGITS.format(b=2, n=32), base3=_DIGITS.format(b=3, n=32)))
def radical_inverses(spark, d):
    return columns(table(spark, d, "customer"), F.col("c_custkey").alias("id"), base2=scalar.radical_inverse("c_custkey", 2), base3=scalar.radical_inverse("c_custkey", 3))


_TURN = repr(2 * math.pi / ((1 + math.sqrt(5)) / 2))


@query(sql(
    f"(SELECT *, sqrt(1 - z * z) * cos(id * {_TURN}::DOUBLE) AS x, sqrt(1 - z * z) * sin(id * {_TURN}::DOUBLE) AS y FROM (SELECT c_custkey AS id, 1 - 2 * (c_custkey + 0.5::DOUBLE) / 40000.0::DOUBLE AS z FROM customer))",
    "id", x="x", y="y", z="z", azimuth="atan2(y, x)", elevation="atan2(z, sqrt(x * x + y * y))", radius="sqrt(x * x + y * y + z * z)",
    flat_x="x / (1 + z)", central_x="x / z", lx="cos(z) * cos(x)", ly="cos(z) * sin(x)", lz="sin(z)",
))
def sphere_maps(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[x.alias(n) for n, x in zip("xyz", scalar.fibonacci_sphere("c_custkey", 40000))])
    azimuth, elevation, radius = scalar.spherical("x", "y", "z")
    lx, ly, lz = scalar.lat_lon("z", "x")
    return columns(p, "id", x="x", y="y", z="z", azimuth=azimuth, elevation=elevation, radius=radius, flat_x=scalar.stereographic("x", "y", -F.col("z"))[0], central_x=scalar.gnomonic("x", "y", "z")[0], lx=lx, ly=ly, lz=lz)


_E2 = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"


@query(sql("embeddings", "vec_id AS id", norm=f"sqrt({_E2})", first=f"embedding[1]::DOUBLE / CASE WHEN {_E2} = 0 THEN 1 ELSE sqrt({_E2}) END", moved="embedding[1]::DOUBLE + 0.5::DOUBLE * embedding[2]::DOUBLE"))
def row_norms(spark, d):
    e = table(spark, d, "embeddings")
    turned = F.concat(F.slice("embedding", 2, 1), F.slice("embedding", 1, 1)).cast("array<double>")
    return columns(e, F.col("vec_id").alias("id"), norm=scalar.norm("embedding"), first=scalar.normalised(F.col("embedding").cast("array<double>"))[0], moved=scalar.ghost(F.slice("embedding", 1, 2).cast("array<double>"), turned, 0.5)[0])


_W = "(SELECT c_custkey AS id, c_acctbal / 9000.0::DOUBLE AS a, c_acctbal / 9000.0::DOUBLE + ((c_custkey % 7) - 3) * 0.03::DOUBLE AS b FROM customer)"


@query(f"SELECT id, (a > 0.5) = (b > 0.5) AND abs(b - 0.5) > abs(a - b) + 0.1::DOUBLE AND abs(b - floor(b + 0.5)) <= 0.1::DOUBLE AS sure FROM {_W}")
def winding_guard(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 9000.0).alias("a"), (F.col("c_acctbal") / 9000.0 + ((F.col("c_custkey") % 7) - 3) * 0.03).alias("b"))
    return c.select("id", scalar.winding_reliable("a", "b", 0.1).alias("sure"))


_M32 = "((({0})::HUGEINT * {1}) % 4294967296)::BIGINT"
_H1 = _M32.format("xor(k, k >> 16)", 0x85EBCA6B)
_H2 = _M32.format("xor(h, h >> 13)", 0xC2B2AE35)


@query(f"SELECT id, xor(g, g >> 16) AS h FROM (SELECT id, {_H2} AS g FROM (SELECT id, {_H1} AS h FROM (SELECT l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 2654435 + l_partkey) % 4294967296 AS k FROM lineitem)))")
def finalised_hash(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), scalar.fmix32(F.col("l_orderkey") * 2654435 + F.col("l_partkey")).alias("h"))


@query("SELECT c_custkey AS id, (abs(round_even(c_custkey / 1000.0::DOUBLE * 1e10::DOUBLE, 0)::HUGEINT + round_even(c_acctbal * 1e10::DOUBLE, 0)::HUGEINT * 104729) % 800000000000000)::BIGINT + 7 AS content FROM customer")
def content_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalar.content_id([F.col("c_custkey") / 1000.0, F.col("c_acctbal")], 7).alias("content"))


def _rotated(t, p):
    """A rotation about the origin that slows down with time."""
    return [-(1 - 0.5 * t) * p[1], (1 - 0.5 * t) * p[0]]


def _rk3_sql(dt: float, t: float) -> str:
    """The same as nested selections: stages as columns."""
    return f"""(SELECT id, x + {dt} * (2 * k1x + 3 * k2x + 4 * k3x) / 9 AS nx, y + {dt} * (2 * k1y + 3 * k2y + 4 * k3y) / 9 AS ny FROM (
SELECT *, -(1 - 0.5 * ({t} + 3 * {dt} / 4)) * (y + 3 * {dt} * k2y / 4) AS k3x, (1 - 0.5 * ({t} + 3 * {dt} / 4)) * (x + 3 * {dt} * k2x / 4) AS k3y FROM (
SELECT *, -(1 - 0.5 * ({t} + {dt} / 2)) * (y + {dt} * k1y / 2) AS k2x, (1 - 0.5 * ({t} + {dt} / 2)) * (x + {dt} * k1x / 2) AS k2y FROM (
SELECT *, -(1 - 0.5 * {t}) * y AS k1x, (1 - 0.5 * {t}) * x AS k1y FROM {_XY}))))"""


@query(f"SELECT id, {q('f.nx')} AS fx, {q('f.ny')} AS fy, {q('b.nx')} AS bx, {q('b.ny')} AS b_y FROM {_rk3_sql('0.1::DOUBLE', '0.2::DOUBLE')} f JOIN {_rk3_sql('(-0.1::DOUBLE)', '0.2::DOUBLE')} b USING (id)")
def traced_points(spark, d):
    p = [F.col("x"), F.col("y")]
    (fx, fy), (bx, by) = scalar.rk3(p, 0.2, 0.1, _rotated), scalar.traced_back(p, 0.2, 0.1, _rotated)
    return columns(plane(spark, d), "id", fx=fx, fy=fy, bx=bx, b_y=by)


_LEG = {0: "sqrt(0.5::DOUBLE)", 1: "sqrt(1.5::DOUBLE) * y", 2: "sqrt(2.5::DOUBLE) * (3 * y * y - 1) / 2", 3: "sqrt(3.5::DOUBLE) * (5 * y * y * y - 3 * y) / 2", 4: "sqrt(4.5::DOUBLE) * (35 * y**4 - 30 * y * y + 3) / 8"}


@query(sql(
    _XY, "id", **{f"p{k}": v for k, v in _LEG.items()}, s3="sqrt(3.5::DOUBLE) * (15 * y * y - 3) / 2", t2="sqrt(2 / pi()) * (2 * y * y - 1)", t3="sqrt(2 / pi()) * (4 * y * y * y - 3 * y)",
    r2="(sqrt(2.5::DOUBLE) * (3 * y * y - 1) / 2) / (sqrt(1.5::DOUBLE) * y)", tensor="sqrt(3::DOUBLE) * x * sqrt(5::DOUBLE) * (3 * y * y - 1) / 2",
).replace("FROM (SELECT", "FROM (SELECT * FROM (SELECT", 1) + " WHERE abs(y) > 0.01)")
def orthogonal_polynomials(spark, d):
    a, b = polynomials.legendre_recurrence(6)
    y = F.col("y")
    leg, slopes, chebyshev = polynomials.values(a, b, y, 4), polynomials.values(a, b, y, 3, 1), polynomials.values(*polynomials.chebyshev_recurrence(5), y, 3)
    (both,) = polynomials.tensor(a, b, [F.col("x"), y], [(1, 2)])
    return columns(plane(spark, d).where("abs(y) > 0.01"), "id", **{f"p{k}": p for k, p in enumerate(leg)}, s3=slopes[3], t2=chebyshev[2], t3=chebyshev[3], r2=polynomials.ratios(a, b, y, 2)[1], tensor=both)


@query("SELECT row_number() OVER (ORDER BY a0, a1) - 1 AS n, a0, a1 FROM (SELECT i AS a0, j AS a1 FROM (SELECT range AS i FROM range(9)), (SELECT range AS j FROM range(9)) WHERE (i + 1) * (j + 1) <= 9)")
def hyperbolic_cross(spark, d):
    return polynomials.index_table(spark, polynomials.hyperbolic_cross(2, 8))


@query("SELECT row_number() OVER (ORDER BY i + j + k, i DESC, j DESC, k DESC) - 1 AS n, i AS a0, j AS a1, k AS a2 FROM (SELECT range AS i FROM range(7)), (SELECT range AS j FROM range(7)), (SELECT range AS k FROM range(7)) WHERE i + j + k <= 6")
def total_degree(spark, d):
    return polynomials.index_table(spark, polynomials.total_degree(3, 6))


@query(f"SELECT {q('2 * sin(1.0::DOUBLE)')} AS line, {q('4 * pi() / 3')} AS sphere, {q('1.0::DOUBLE / 12')} AS triangle")
def quadratures(spark, d):
    """The integrals of cos on [-1, 1], of z^2 on the sphere, and of x^2 on the unit triangle."""
    line = polynomials.integral(polynomials.quadrature_table(spark, polynomials.gauss_legendre(12), "x w"), F.cos("x"))
    sphere = polynomials.integral(polynomials.quadrature_table(spark, polynomials.sphere_quadrature(6), "x y z w"), F.col("z") * F.col("z"))
    triangle = polynomials.integral(polynomials.quadrature_table(spark, polynomials.triangle_quadrature([(0, 0), (1, 0), (0, 1)], 4), "x y w"), F.col("x") * F.col("x"))
    name = lambda df, n: df.select(quantised("integral").alias(n))
    return name(line, "line").crossJoin(name(sphere, "sphere")).crossJoin(name(triangle, "triangle"))  # one row each


_T = "(b / 4000.0::DOUBLE)"


@query(sql(
    _R, "id", ahead="0.5 * 1.5 * 2.5 * r - 0.5 * 2.5 * b + 0.5 * 0.5 * 1.5 * 1.0::DOUBLE", w0=f"({_T} - 0.5) / (0 - 0.5::DOUBLE) * (({_T} - 1) / (0 - 1)) * (({_T} - 2) / (0 - 2))",
    w2=f"({_T} - 0) / (1 - 0) * (({_T} - 0.5) / (1 - 0.5::DOUBLE)) * (({_T} - 2) / (1 - 2))",
))
def temporal_weights(spark, d):
    w = scalar.cardinal_weights([0.0, 0.5, 1.0, 2.0], F.col("b") / 4000.0)
    return columns(radii(spark, d), "id", ahead=scalar.theta_extrapolated(["r", "b", F.lit(1.0)], 0.5), w0=w[0], w2=w[2])


# --- rows


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def priority_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.by_priority(o, "o_totalprice", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || ':11'), o_orderkey) - 1 AS rank FROM orders) WHERE rank >= 200 AND rank < 300")
def epoch_batch(spark, d):
    return rows.batch(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 11, 2, 100)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':3'), o_orderkey) - 1 AS rank FROM orders")
def epoch_order(spark, d):
    return rows.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_returnflag, l_linestatus, n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_discount) AS e FROM lineitem GROUP BY ALL) ORDER BY floor(e * 1e9), n, l_returnflag, l_linestatus LIMIT 1")
def best_candidate(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("l_discount") * 1e9).alias("e"))
    return rows.best(c, "e", "n", "l_returnflag", "l_linestatus").drop("e")


@query("SELECT n_nationkey::BIGINT AS id, 'interior' AS kind, 0 AS part FROM nation UNION ALL SELECT c_custkey, 'boundary', 1 FROM customer UNION ALL SELECT s_suppkey, 'ghost', 2 FROM supplier")
def node_union(spark, d):
    ids = lambda t, c: table(spark, d, t).select(F.col(c).cast("long").alias("id"))
    return rows.united(interior=ids("nation", "n_nationkey"), boundary=ids("customer", "c_custkey"), ghost=ids("supplier", "s_suppkey"))


_OLD = "(SELECT o_custkey AS id, min(o_orderkey) AS previous_row FROM orders WHERE o_totalprice > 50000 GROUP BY ALL)"


@query(f"SELECT c_custkey AS id, coalesce(previous_row, -1) AS previous_row FROM customer LEFT JOIN {_OLD} ON c_custkey = id")
def matched_rows(spark, d):
    old = table(spark, d, "orders").where("o_totalprice > 50000").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("row"))
    return rows.matched(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), old)


@query("SELECT o_orderkey AS id, coalesce(c_nationkey::BIGINT, -1) AS row FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def tree_lookup(spark, d):
    tree = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("row"), (F.col("c_acctbal") > 0).alias("active"))
    return rows.lookup(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")), tree, "k").select("id", "row")


@query("""WITH s AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_partkey) AS ids, sum(l_linenumber) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_partkey) AS ids, sum(l_linenumber) AS c FROM lineitem WHERE l_quantity > 5 GROUP BY ALL)
SELECT s.id, coalesce(s.ids = t.ids AND s.c = t.c, false) AS reuse FROM s LEFT JOIN t ON s.id = t.id""")
def reusable_rows(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    made = lambda x: x.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("l_partkey")).alias("ids"), F.sum("l_linenumber").alias("c"))
    return rows.reusable(made(l), made(l.where("l_quantity > 5")), ["ids", "c"])


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def persisted_ids(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return series.persisted(ids, table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def entered_ids(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return series.entered(o, table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id")))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 30 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def left_ids(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"))
    return series.left(o, table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id")).distinct())


@query("SELECT l_orderkey AS id FROM lineitem GROUP BY ALL HAVING min(l_returnflag) <> max(l_returnflag)")
def shared_splits(spark, d):
    return series.disjoint(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("split")))


# --- matrices


def _matrix(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


@query(f"SELECT l_orderkey AS id, {q('sum(l_quantity)')} AS v FROM lineitem GROUP BY ALL")
def row_totals(spark, d):
    return coo.row_totals(_matrix(spark, d)).select("id", quantised("v").alias("v"))


@query("SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 100000")
def masked_rows(spark, d):
    flags = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 100000).alias("flag"))
    return coo.masked_rows(_matrix(spark, d), flags)


@query("SELECT l_orderkey + 1000 AS row, l_partkey AS col, l_quantity AS val FROM lineitem WHERE l_partkey < 50")
def selected_entries(spark, d):
    return coo.selected(_matrix(spark, d), F.col("col") < 50, 1000)


@query("SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem UNION ALL SELECT l_orderkey + 7000000, l_partkey, 2 * l_quantity FROM lineitem")
def stacked(spark, d):
    m = _matrix(spark, d)
    return coo.stack(m, coo.scale(m, 2.0), heights=[7_000_000, 7_000_000])


@query("SELECT min(c) = 1 AND min(v) > 0 AS valid FROM (SELECT count(*) AS c, min(l_orderkey) AS v FROM lineitem GROUP BY l_orderkey, l_partkey)")
def csr_validity(spark, d):
    return coo.valid_csr(_matrix(spark, d), 2**62, 2**62)


@query("SELECT count(*) > 1000 AS overflow, count(*) AS entries FROM lineitem")
def index_overflow(spark, d):
    return coo.overflow(_matrix(spark, d), 1000)


@query(f"""SELECT l_orderkey AS row, l_partkey AS col, {q('2 * o_totalprice * p_retailprice + l_x')} AS val FROM (SELECT DISTINCT l_orderkey, l_partkey, o_totalprice, p_retailprice, o_custkey::DOUBLE * p_size AS l_x
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""")
def edge_products(spark, d):
    edges = _matrix(spark, d).select("row", "col").distinct()
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(2 * F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("x"))
    right = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("x"))
    return coo.edge_products(edges, left, right).select("row", "col", quantised("val").alias("val"))


_S = 150


@query(f"""WITH a AS (SELECT (l_orderkey % 200) AS r, (l_partkey % 200) AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT i AS id, coalesce(v, 0) AS v FROM (SELECT range AS i FROM range(200)) LEFT JOIN a ON r = i AND c = i),
d1 AS (SELECT id, CASE WHEN abs(v) < 1e-15 THEN 1 ELSE v END AS v FROM d WHERE id < {_S}),
s AS (SELECT x.r AS id, sum(x.v * y.v / d1.v) AS s FROM a x JOIN a y ON x.c = y.r AND y.c = x.r JOIN d1 ON d1.id = x.c WHERE x.r >= {_S} AND x.c < {_S} GROUP BY ALL),
d2 AS (SELECT d.id, d.v - coalesce(s, 0) AS v FROM d LEFT JOIN s USING (id) WHERE d.id >= {_S})
SELECT id, {q('v')} AS v FROM d1 UNION ALL SELECT id, {q('CASE WHEN abs(v) < 1e-15 THEN 1 ELSE v END')} FROM d2""")
def schur_diagonal(spark, d):
    m = _matrix(spark, d).select((F.col("row") % 200).alias("row"), (F.col("col") % 200).alias("col"), "val")
    return coo.schur_diagonal(m, _S, 200 - _S).select("id", quantised("v").alias("v"))


@query(f"""WITH a AS (SELECT (l_suppkey % 40) AS r, (l_linenumber * 5 + l_suppkey % 5) AS c, sum(l_discount) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT x.r, y.c, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.c = y.r GROUP BY ALL)
SELECT x.r AS row, y.c AS col, {q('sum(x.v * y.v)')} AS val FROM b x JOIN a y ON x.c = y.r WHERE x.r < 20 GROUP BY ALL""")
def matrix_cubed(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.select((F.col("l_suppkey") % 40).cast("long").alias("row"), (F.col("l_linenumber") * 5 + F.col("l_suppkey") % 5).cast("long").alias("col"), F.col("l_discount").alias("val"))
    return coo.matrix_power(a, 3, spark.range(20)).select("row", "col", quantised("val").alias("val"))


@query(f"SELECT l_orderkey AS id, l_linenumber::BIGINT AS rhs, {q('sum(l_quantity * p_retailprice * (1 + l_linenumber))')} AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def spmm(spark, d):
    """Seven right-hand sides at once; each order keeps the entries of one line number a side."""
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("rhs"), F.col("p_retailprice").alias("v"))
    x = x.withColumn("v", F.col("v") * (1 + F.col("rhs")))
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    own = coo.spmm(a, x).where("id % 8 = rhs").groupBy(F.expr("id div 8").alias("id"), "rhs").agg(F.sum("v").alias("v"))
    return own.select("id", "rhs", quantised("v").alias("v"))


# --- reductions and histories


@query(f"SELECT o_orderkey, {q('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / ((SELECT stddev_pop(o_totalprice) FROM orders) + 1e-7::DOUBLE)')} AS o_totalprice FROM orders")
def gaussian_normalizer(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return series.gaussian_normalizer(o, "o_totalprice").select("o_orderkey", quantised("o_totalprice").alias("o_totalprice"))


@query(f"SELECT o_orderkey, {q('o_totalprice')} AS o_totalprice FROM orders")
def gaussian_round_trip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    back = series.gaussian_normalizer(series.gaussian_normalizer(o, "o_totalprice"), "o_totalprice", decode=True, fit=o)
    return back.select("o_orderkey", quantised("o_totalprice").alias("o_totalprice"))


@query(f"SELECT {q('avg(r)')} AS mean_relative FROM (SELECT sqrt(sum((l_extendedprice * l_discount)**2) / sum(l_extendedprice**2)) AS r FROM lineitem GROUP BY l_orderkey)")
def mean_relative_error(spark, d):
    l = table(spark, d, "lineitem").withColumn("g", F.col("l_extendedprice") * (1 - F.col("l_discount")))  # noqa: E741
    return series.mean_relative(l, "l_orderkey", "g", "l_extendedprice").select(quantised("mean_relative").alias("mean_relative"))


@query(f"SELECT {q('2.5::DOUBLE * avg(c_acctbal)')} AS c_acctbal FROM customer")
def mean_mass(spark, d):
    return series.mean_mass(table(spark, d, "customer"), ["c_acctbal"], 2.5).select(quantised("c_acctbal").alias("c_acctbal"))


@query(f"SELECT c_custkey, {q('c_acctbal + c_custkey * ((1000.0::DOUBLE - (SELECT 2.5::DOUBLE * avg(c_acctbal) FROM customer)) / (SELECT abs(2.5::DOUBLE * avg(c_custkey)) FROM customer))')} AS c_acctbal FROM customer")
def enforced_mass(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return series.with_mass(c, "c_acctbal", 2.5, 1000.0, "c_custkey").select("c_custkey", quantised("c_acctbal").alias("c_acctbal"))


_DIV = "(SELECT l_orderkey AS id, sum(l_quantity * p_retailprice) + sum(l_discount * p_size) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"SELECT {q('sqrt(avg(v * v))')} AS rms, {q('max(abs(v))')} AS largest FROM {_DIV}")
def divergence_size(spark, d):
    m, p = _matrix(spark, d), table(spark, d, "part")
    other = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_discount").alias("val"))
    part = lambda c: p.select(F.col("p_partkey").alias("id"), F.col(c).cast("double").alias("v"))
    size = series.residual_size(series.divergence([m, other], [part("p_retailprice"), part("p_size")]), "v")
    return size.select(quantised("rms").alias("rms"), quantised("largest").alias("largest"))


@query(f"SELECT c_custkey AS id, {q('0.6 * c_acctbal + 0.8 * c_custkey - c_nationkey')} AS v FROM customer")
def wall_residuals(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    normals = c.select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("normal"))
    got = series.wall_residual(normals, c.select("id", F.array(F.col("c_acctbal"), F.col("id").cast("double")).alias("u")), c.select("id", F.col("c_nationkey").cast("double").alias("v")))
    return got.select("id", quantised("v").alias("v"))


_PREV = "coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), value)"


@query(f"SELECT event_id, {q('p')} AS predicted, p >= 150 AS crosses FROM (SELECT event_id, value + 3 * greatest(0.0::DOUBLE, value - {_PREV}) AS p FROM events)")
def quality_crossings(spark, d):
    got = series.crossings(table(spark, d, "events"), "user_id", "event_id", "value", 150.0, 3.0)
    return got.select("event_id", quantised("predicted").alias("predicted"), "crosses")


@query(f"SELECT n, {q('ln(lag(e) OVER o / e) / ln(lag(h) OVER o / h)')} AS rate FROM (SELECT n, 1.0::DOUBLE / (n + 1) AS h, s / ((n + 1) * (n + 1)) AS e FROM (SELECT c_nationkey::BIGINT AS n, sum(abs(c_acctbal)) AS s FROM customer GROUP BY c_nationkey)) WINDOW o AS (ORDER BY h DESC)")
def observed_rates(spark, d):
    e = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("n")).agg(F.sum(F.abs("c_acctbal")).alias("e"))
    e = e.select("n", (1.0 / (F.col("n") + 1)).alias("h"), (F.col("e") / ((F.col("n") + 1) * (F.col("n") + 1))).alias("error"))
    return series.observed_rates(e).select("n", quantised("rate").alias("rate"))


@query(f"SELECT {q('sqrt(avg(c_acctbal * c_acctbal))')} AS c_acctbal, {q('sqrt(avg(c_custkey::DOUBLE * c_custkey))')} AS c_custkey FROM customer")
def rms_components(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", F.col("c_custkey").cast("double").alias("c_custkey"))
    return columns(series.rms_components(c, ["c_acctbal", "c_custkey"]), c_acctbal="c_acctbal", c_custkey="c_custkey")


@query(f"SELECT event_id, {q('value')} AS o1, {q('2 * value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)')} AS o2 FROM events")
def extrapolations(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    one = series.extrapolated(e, "user_id", "event_id", "value", 1).withColumnRenamed("next", "o1")
    return columns(series.extrapolated(one, "user_id", "event_id", "value", 2), "event_id", o1="o1", o2="next")


_B = "lag(value, {0}) OVER (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT event_id, {q('(value - ((18.0::DOUBLE/11) * ' + _B.format(1) + ' + (-9.0::DOUBLE/11) * ' + _B.format(2) + ' + (2.0::DOUBLE/11) * ' + _B.format(3) + ')) / (6.0::DOUBLE/11 * 0.1::DOUBLE)')} AS velocity FROM events")
def material_velocity3(spark, d):
    return columns(series.material_velocity(table(spark, d, "events"), "user_id", "event_id", "value", 0.1, 3), "event_id", velocity="velocity")


@query("SELECT c_custkey AS id, c_acctbal AS phi FROM customer WHERE c_acctbal >= 450.0 AND c_acctbal <= 8000")
def level_set_inside(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("phi"))
    return c.where(scalar.level_set_kept("phi", True, 50.0, 500.0, high=8000.0))


@query("SELECT c_custkey AS id, c_acctbal AS phi FROM customer WHERE c_acctbal <= -450.0")
def level_set_outside(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("phi"))
    return c.where(scalar.level_set_kept("phi", False, 50.0, 500.0))


@query()
def content_fingerprint(spark, d):
    return series.fingerprint(customers(spark, d), ["id", "pos"])
