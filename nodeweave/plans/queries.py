"""Queries on the test tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.functions import scalar
from nodeweave.functions.scalar import quantised
from nodeweave.operators import coo, greedy, series, spatial, stencils
from nodeweave.plans.registry import ORACLES, QUERIES, customers, q, query, table  # noqa: F401

def matrix(spark, sf_dir: str) -> DataFrame:
    """lineitem as a matrix: order by part, quantity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))


def vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("pos"), "label")


# --- sparse matrices


@query("SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL")
def coo_coalesce(spark, d):
    return coo.coalesce(matrix(spark, d))


@query(f"SELECT l_orderkey AS id, {q('sum(l_quantity * p_retailprice)')} AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def spmv(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return coo.spmv(matrix(spark, d), x).select("id", quantised("v").alias("v"))


@query(f"SELECT l_orderkey AS row, l_partkey AS col, {q('sum(l_quantity * o_totalprice)')} AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def row_scale(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return coo.coalesce(coo.row_scale(matrix(spark, d), f)).select("row", "col", quantised("val").alias("val"))


@query("SELECT row, col, sum(val) AS val FROM (SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 2 * l_quantity FROM lineitem) GROUP BY ALL")
def coo_add(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))
    return coo.scaled_sum([(1.0, matrix(spark, d)), (2.0, b)])


@query(f"""WITH a AS (SELECT l_suppkey AS row, l_orderkey AS k, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS col, sum(l_discount) AS y FROM lineitem GROUP BY ALL)
SELECT row, col, {q('sum(x * y)')} AS val FROM a JOIN b USING (k) GROUP BY ALL""")
def spgemm(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.select(F.col("l_suppkey").alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").alias("val"))
    b = l.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col"), F.col("l_discount").alias("val"))
    return coo.spgemm(a, b).select("row", "col", quantised("val").alias("val"))


@query("""SELECT row, col, sum(val) AS val FROM (SELECT o_orderkey AS row, o_orderkey AS col, 1.0::DOUBLE AS val FROM orders
UNION ALL SELECT l_orderkey, l_partkey, l_quantity * 0.5::DOUBLE FROM lineitem) GROUP BY ALL""")
def implicit_system(spark, d):
    return coo.implicit_system(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), matrix(spark, d), 0.5)


@query("""SELECT n_nationkey::BIGINT AS row, n_regionkey::BIGINT AS col, 1.0::DOUBLE AS val FROM nation
UNION ALL SELECT 1000, n_nationkey, 1.0 FROM nation UNION ALL SELECT n_nationkey, 1000, 1.0 FROM nation""")
def gauge_augment(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_regionkey").cast("long").alias("col"), F.lit(1.0).alias("val"))
    return coo.gauge(a, n.select(F.col("n_nationkey").cast("long").alias("id")), 1000)


@query("SELECT l_orderkey - 100 AS row, l_partkey - 50 AS col, l_quantity AS val FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900 AND l_partkey >= 50 AND l_partkey < 1000")
def extract_block(spark, d):
    return coo.block(matrix(spark, d), 100, 900, 50, 1000)


@query(f"WITH m AS (SELECT l_orderkey AS row, max(abs(l_quantity)) AS m FROM lineitem GROUP BY ALL) SELECT l_orderkey AS row, l_partkey AS col, {q('l_quantity * (1.0::DOUBLE / m)')} AS val FROM lineitem JOIN m ON l_orderkey = row")
def row_equilibrate(spark, d):
    return coo.equilibrated(matrix(spark, d)).select("row", "col", quantised("val").alias("val"))


@query("SELECT row, coalesce(sum(c) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS indptr FROM (SELECT l_orderkey AS row, count(*) AS c FROM lineitem GROUP BY ALL)")
def csr_indptr(spark, d):
    return coo.indptr(matrix(spark, d))


# --- reductions


@query(f"""SELECT {q('avg(l_quantity)')} AS mean_l_quantity, {q('avg(l_discount)')} AS mean_l_discount,
{q('CASE WHEN stddev_pop(l_quantity) = 0 THEN 1 ELSE stddev_pop(l_quantity) END')} AS std_l_quantity,
{q('CASE WHEN stddev_pop(l_discount) = 0 THEN 1 ELSE stddev_pop(l_discount) END')} AS std_l_discount FROM lineitem""")
def normalizer_fit(spark, d):
    fit = series.normalizer(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return fit.select(*[quantised(c).alias(c) for c in fit.columns])


@query(f"SELECT o_orderkey, {q('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)')} AS o_totalprice FROM orders")
def normalizer_transform(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return series.normalised(o, series.normalizer(o, ["o_totalprice"]), ["o_totalprice"]).withColumn("o_totalprice", quantised("o_totalprice"))


@query(f"""WITH e AS (SELECT l_extendedprice AS w, l_extendedprice * (1 - l_discount) AS g FROM lineitem)
SELECT {q('sqrt(avg((g - w) * (g - w)))')} AS l2, {q('max(abs(g - w))')} AS linf, {q('sqrt(sum((g - w) * (g - w)) / sum(w * w))')} AS rel_l2 FROM e""")
def field_errors(spark, d):
    e = series.errors(table(spark, d, "lineitem").withColumn("g", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "g", "l_extendedprice")
    return e.select(*[quantised(c).alias(c) for c in e.columns])


@query(f"SELECT c_custkey, {q('c_acctbal + (1000.0 - (SELECT sum(2 * c_acctbal) FROM customer)) / (SELECT sum(2.0::DOUBLE) FROM customer)')} AS c_acctbal FROM customer")
def mass_shift(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal").withColumn("w", F.lit(2.0))
    return series.mass_shift(c, "w", "c_acctbal", 1000.0).select("c_custkey", quantised("c_acctbal").alias("c_acctbal"))


@query("SELECT min(c_custkey) AS min_c_custkey, max(c_custkey) AS max_c_custkey, min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer")
def bounding_box(spark, d):
    return series.bounding_box(table(spark, d, "customer"), ["c_custkey", "c_acctbal"])


# --- histories


_LAGS = "lag(value, {0}) OVER (PARTITION BY user_id ORDER BY event_id)"
_L1, _L2 = _LAGS.format(1), _LAGS.format(2)


@query(f"SELECT event_id, {q(f'(18.0::DOUBLE/11) * value + (-9.0::DOUBLE/11) * {_L1} + (2.0::DOUBLE/11) * {_L2}')} AS rhs FROM events")
def bdf3_rhs(spark, d):
    return series.bdf_rhs(table(spark, d, "events"), "user_id", "event_id", "value", 3).select("event_id", quantised("rhs").alias("rhs"))


@query(f"SELECT event_id, {q(f'(4.0::DOUBLE/3) * value + (-1.0::DOUBLE/3) * {_L1}')} AS rhs FROM events")
def bdf2_rhs(spark, d):
    return series.bdf_rhs(table(spark, d, "events"), "user_id", "event_id", "value", 2).select("event_id", quantised("rhs").alias("rhs"))


@query(f"SELECT event_id, {q(f'3.0::DOUBLE * value - 3.0::DOUBLE * {_L1} + {_L2}')} AS next FROM events")
def extrapolate3(spark, d):
    return series.extrapolated(table(spark, d, "events"), "user_id", "event_id", "value", 3).select("event_id", quantised("next").alias("next"))


@query(f"SELECT event_id, {q(f'(value - ((4.0::DOUBLE/3) * {_L1} + (-1.0::DOUBLE/3) * {_L2})) / (2.0::DOUBLE/3 * 0.1::DOUBLE)')} AS velocity FROM events")
def material_velocity(spark, d):
    return series.material_velocity(table(spark, d, "events"), "user_id", "event_id", "value", 0.1, 2).select("event_id", quantised("velocity").alias("velocity"))


@query(f"SELECT {q('regr_slope(ln(l_extendedprice), ln(l_quantity))')} AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def ols_slope(spark, d):
    return series.loglog_slope(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(quantised("slope").alias("slope"))


@query("""WITH m AS (SELECT (max(event_id) + min(event_id)) / 2 AS m FROM events), p AS (SELECT DISTINCT user_id FROM events, m WHERE event_id <= m AND event_type <> 'click'),
c AS (SELECT DISTINCT user_id FROM events, m WHERE event_id > m AND event_type <> 'view')
SELECT coalesce(p.user_id, c.user_id) AS id, CASE WHEN p.user_id IS NULL THEN 'entered' WHEN c.user_id IS NULL THEN 'left' ELSE 'persisted' END AS status FROM p FULL JOIN c USING (user_id)""")
def entered_left_persisted(spark, d):
    e = table(spark, d, "events")
    m = e.agg(((F.max("event_id") + F.min("event_id")) / 2).alias("m")).first()["m"]
    side = lambda x: e.where(x).select(F.col("user_id").alias("id"))
    return series.transitions(side((F.col("event_id") > m) & (F.col("event_type") != "view")), side((F.col("event_id") <= m) & (F.col("event_type") != "click")))


# --- neighbours


_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_PAIRS = f"p AS (SELECT a.vec_id AS q, b.vec_id AS p, {_D2} AS d2, a.label AS la, b.label AS lb FROM embeddings a, embeddings b)"


@query(f"WITH {_PAIRS} SELECT q, p, rank, {q('sqrt(d2)')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM p) WHERE rank <= 5")
def knn_embeddings(spark, d):
    v = vectors(spark, d)
    return spatial.knn(v, v, 5, 64).select("q", "p", F.col("rank").cast("long").alias("rank"), quantised(F.sqrt("d2")).alias("d"))


@query(f"WITH {_PAIRS} SELECT q, count(*) AS n FROM p WHERE sqrt(d2) <= 1.2 GROUP BY q")
def radius_neighbors(spark, d):
    v = vectors(spark, d)
    return spatial.ball(v, v, 1.2, 64).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT q, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, p) AS rank FROM p) WHERE sqrt(d2) <= 1.2 OR rank <= 3 GROUP BY q")
def radius_kmin(spark, d):
    v = vectors(spark, d)
    return spatial.ball_or_nearest(v, v, 1.2, 3).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PAIRS}, m AS (SELECT q, arg_min(p, (d2, p)) AS p, min(d2) AS d2 FROM p WHERE la = 0 AND lb <> 0 AND sqrt(d2) <= 1.2 GROUP BY q)
SELECT vec_id AS q, coalesce(m.p, -1) AS p, coalesce({q('sqrt(d2)')}, 'infinity'::DOUBLE) AS d FROM embeddings LEFT JOIN m ON vec_id = q WHERE label = 0""")
def nearest_within(spark, d):
    v = vectors(spark, d)
    return spatial.nearest_within(v.where("label = 0"), v.where("label <> 0"), 1.2, 64).select("q", "p", F.when(F.col("p") < 0, F.col("d")).otherwise(quantised("d")).alias("d"))


@query(f"WITH {_PAIRS} SELECT q AS a, p AS b FROM p WHERE q < p AND sqrt(d2) < greatest(1.15 + 0.01 * la, 1.15 + 0.01 * lb)")
def conflict_graph(spark, d):
    return spatial.conflicts(vectors(spark, d).withColumn("radius", 1.15 + 0.01 * F.col("label")), 64)


_P2 = "c AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_acctbal AS y FROM customer)"


@query(f"WITH {_P2} SELECT q, p, rank FROM (SELECT a.id AS q, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) AS rank FROM c a, c b) WHERE rank <= 4")
def grid_knn(spark, d):
    c = customers(spark, d)
    return spatial.grid_knn(c, c, 4, 2).select("q", "p", F.col("rank").cast("long").alias("rank"))


@query("SELECT floor(c_custkey / 200.0)::BIGINT AS i, floor(c_acctbal / 200.0)::BIGINT AS j, count(*) AS n FROM customer GROUP BY ALL")
def grid_cell_counts(spark, d):
    return spatial.cell_counts(customers(spark, d), 200.0, 2).select(F.col("cell")[0].alias("i"), F.col("cell")[1].alias("j"), "n")


@query("SELECT c_custkey AS id, row_number() OVER (PARTITION BY floor(c_custkey / 200.0), floor(c_acctbal / 200.0) ORDER BY c_custkey) - 1 AS slot FROM customer")
def slot_in_cell(spark, d):
    return spatial.slot_in_cell(customers(spark, d), 200.0, 2).select("id", F.col("slot").cast("long").alias("slot"))


# --- rows only: sets by rounds, and stencils (the residual is in the result)


@query()
def greedy_independent_set(spark, d):
    c = customers(spark, d)
    pairs = spatial.pairs_within(c, 60.0, 2).select(F.col("q").alias("a"), F.col("p").alias("b"))
    return greedy.independent_set(c.select("id", F.col("id").alias("rank")), pairs)


@query()
def poisson_disk(spark, d):
    return greedy.poisson_disk(spark, 0.1, [0.0, 0.0], [1.0, 1.0], seed=19).select("id", "pos")


@query()
def wls_laplacian(spark, d):
    """The Laplacian of x^2 + y^2 at each node of a grid: 4."""
    return _laplacian(spark, None)


@query()
def rbf_laplacian(spark, d):
    return _laplacian(spark, 5)


def _laplacian(spark, phs):
    n = 30
    nodes = spark.range(n * n).select("id", F.array((F.col("id") % n) / float(n), F.floor(F.col("id") / n) / float(n)).alias("pos"))
    w = stencils.operators(nodes, nodes, ["lap"], 2, 13, 2, 0.1, phs)
    u = nodes.select("id", (F.col("pos")[0] * F.col("pos")[0] + F.col("pos")[1] * F.col("pos")[1]).alias("v"))
    return coo.spmv(w.select("row", "col", F.col("lap").alias("val")), u)


# --- supports, rates and solves


@query(f"WITH {_PAIRS} SELECT q, {q('sum((1 - s)**6 * (1 + 6*s + 35*s*s/3))')} AS total FROM (SELECT q, sqrt(d2) / 1.2::DOUBLE AS s FROM p) WHERE s < 1 GROUP BY q")
def wendland_row_sums(spark, d):
    v = vectors(spark, d)
    near = spatial.ball(v, v, 1.2, 64).select("q", (F.sqrt("d2") / 1.2).alias("s")).where("s < 1")
    return near.groupBy("q").agg(quantised(F.sum(scalar.wendland_c4("s"))).alias("total"))


@query(f"WITH {_PAIRS} SELECT {q('1 - (SELECT count(*) FROM p WHERE sqrt(d2) < 1.2)::DOUBLE / ((SELECT count(*) FROM embeddings)::DOUBLE * (SELECT count(*) FROM embeddings))')} AS sparsity")
def support_sparsity(spark, d):
    v = vectors(spark, d)
    held = spatial.ball(v, v, 1.2, 64).where(F.sqrt("d2") < 1.2).agg(F.count(F.lit(1)).cast("double").alias("held"))
    return held.crossJoin(v.agg(F.count(F.lit(1)).cast("double").alias("n"))).select(quantised(1 - F.col("held") / (F.col("n") * F.col("n"))).alias("sparsity"))  # one row each


@query()
def poisson_square(spark, d):
    """u = exp(x + 0.35 y) on [-1, 1]^2 from its Laplacian and its boundary values: (id, v, e), e the error."""
    from nodeweave.operators import solvers

    n, h = 17, 0.125
    at = [F.floor(F.col("id") / n) * h - 1, (F.col("id") % n) * h - 1]
    out = [F.when(x == -1, -1.0).when(x == 1, 1.0).otherwise(0.0) for x in at]
    grid = spark.range(n * n).select("id", F.array(*at).alias("pos"), scalar.normalised(F.array(*out)).alias("normal"))
    grid = grid.withColumns({"kind": F.when(scalar.norm("normal") > 0, "boundary").otherwise("interior"), "owner": F.lit(None).cast("long")})
    ghosts = grid.where("kind = 'boundary'").select((F.col("id") + n * n).alias("id"), scalar.ghost("pos", "normal", 0.5 * h).alias("pos"), F.col("normal"), F.lit("ghost").alias("kind"), F.col("id").alias("owner"))
    exact = lambda p: F.exp(p[0] + 0.35 * p[1])
    nodes = grid.unionByName(ghosts)
    got = solvers.poisson(nodes, lambda p: -1.1225 * exact(p), lambda p, nu: exact(p), width=0.4)
    return nodes.where("kind <> 'ghost'").select("id", "pos").join(got, "id").select("id", "v", (F.col("v") - exact(F.col("pos"))).alias("e"))


from nodeweave.plans import local_queries, point_queries, table_queries  # noqa: E402, F401  (they register theirs)
