"""Every spatial operator as a query over the driver's tables, and DuckDB SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance, kernels
from tessera.operators import bayes, cluster, esda, gw, interpolation, kriging, pointpattern, rates, regression, sampling, spacetime, weights
from tessera.plans import pairs
from tessera.plans.resample import uniform
from tessera.sources import frame, views
from tessera.streaming import hotcells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero: as the SQL rounds."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """Each double column to six decimals under its own name."""
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def cells(df: DataFrame) -> DataFrame:
    return df.select("id", "row", "col")


# The views, as SQL.
PTS = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS v, label AS mark FROM embeddings)"
NAT = """nat AS (SELECT n.n_nationkey AS id, n.n_nationkey // 5 AS row, n.n_nationkey % 5 AS col, n.n_nationkey % 5 + 0.5::DOUBLE AS x, n.n_nationkey // 5 + 0.5::DOUBLE AS y,
  CAST(coalesce(p.pop, 0) AS DOUBLE) AS pop, CAST(coalesce(c.cases, 0) AS DOUBLE) AS cases FROM nation n
  LEFT JOIN (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1) p ON p.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c ON c.c_nationkey = n.n_nationkey)"""
CUST = "cust AS (SELECT c_custkey AS id, c_custkey // 50 AS row, c_custkey % 50 AS col, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey // 50 AS DOUBLE) AS y, c_acctbal AS z, c_mktsegment AS stratum, c_nationkey AS cluster FROM customer)"
EV = "ev AS (SELECT event_id AS id, user_id AS site, CAST(user_id % 5 AS DOUBLE) AS x, CAST(user_id // 5 AS DOUBLE) AS y, CAST(dayofyear(ts) AS INTEGER) AS day, epoch_us(ts) / 86400e6 AS t, value FROM events)"
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def KNN(k: int = 8, name: str = "e", table: str = "pts", weight: str | None = None) -> str:
    return f"{name} AS (SELECT i, j, d, r, {weight or f'1.0::DOUBLE / {k}'} AS w FROM (SELECT a.id AS i, b.id AS j, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM {table} a JOIN {table} b ON a.id <> b.id) WHERE r <= {k})"


def BAND(r: float, name: str = "e", table: str = "pts") -> str:
    return f"{name} AS (SELECT a.id AS i, b.id AS j, {D} AS d, a.x - b.x AS dx, a.y - b.y AS dy, 1.0::DOUBLE AS w FROM {table} a JOIN {table} b ON a.id <> b.id AND {D} <= {r})"


def LATTICE(table: str, rook: bool = False, name: str = "e") -> str:
    near = "abs(a.row - b.row) + abs(a.col - b.col) = 1" if rook else "greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1"
    return f"{name}0 AS (SELECT a.id AS i, b.id AS j FROM {table} a JOIN {table} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND {near}), {name} AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM {name}0)"


def R(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def with_(*parts: str) -> str:
    return f"WITH {', '.join(parts[:-1])} {parts[-1]}"


pts = views.points
nat = views.nations
cust = views.customers


def knn8(spark, sf_dir) -> weights.Weights:
    return weights.knn(pts(spark, sf_dir), 8)


def zed(spark, sf_dir) -> DataFrame:
    return pts(spark, sf_dir).select("id", F.col("z").alias("y"))


def edges_of(w: weights.Weights) -> DataFrame:
    return w.edges.select("i", "j", r6("w").alias("w"))


CZ = "zz AS (SELECT id, z AS y, z - avg(z) OVER () AS z FROM pts), mm AS (SELECT count(*) AS n, sum(z * z) AS m2, sum(z * z * z * z) AS m4 FROM zz)"
EDGES = f"SELECT i, j, {R('w', 'w')} FROM e"


#: Without its last SELECT, which queries_more adds.
MORAN = with_(PTS, KNN(), CZ, f"""s AS (SELECT sum(w) AS s0 FROM e), b AS (SELECT 0.5 * sum(w * w) AS s1 FROM (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e) GROUP BY 1, 2)),
 c AS (SELECT sum(w * w) AS s2 FROM (SELECT k, sum(w) AS w FROM (SELECT i AS k, w FROM e UNION ALL SELECT j, w FROM e) GROUP BY 1)), u AS (SELECT sum(w * p.z * q.z) AS num FROM e JOIN zz p ON p.id = e.i JOIN zz q ON q.id = e.j),
 t AS (SELECT *, -1.0::DOUBLE / (n - 1) AS ei, (m4 / n) / ((m2 / n) * (m2 / n)) AS b2 FROM s, b, c, u, mm),
 vv AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / (1.0::DOUBLE * (n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei * ei AS var FROM t)""",
 f"SELECT {R('n / s0 * num / m2', 'I')}, {R('ei', 'expected_I')}, {R('var', 'var_I')}, n, {R('(n / s0 * num / m2 - ei) / sqrt(var)', 'z_score')} FROM vv")


@query(with_(PTS, KNN(), EDGES))
def w_knn(spark, sf_dir):
    return edges_of(knn8(spark, sf_dir))


@query(with_(PTS, BAND(0.03), f"SELECT i, j, {R('CASE WHEN d = 0 THEN 0 ELSE 1 / d END', 'w')} FROM e"))
def w_distance_band(spark, sf_dir):
    return edges_of(weights.distance_band(pts(spark, sf_dir), 0.03, binary=False, transform="original"))


@query(with_(PTS, BAND(0.05), "f AS (SELECT i, j, power(1 - (d / 0.05) * (d / 0.05), 2) AS w FROM e WHERE d < 0.05)", f"SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM f WHERE w > 0"))
def w_kernel_bisquare(spark, sf_dir):
    return edges_of(weights.kernel_weights(pts(spark, sf_dir), bandwidth=0.05))


@query(with_(PTS, KNN(), "h AS (SELECT i, max(d) AS h FROM e GROUP BY 1), f AS (SELECT e.i, j, power(1 - (d / h) * (d / h), 2) AS w FROM e JOIN h ON h.i = e.i WHERE d < h)", f"SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM f WHERE w > 0"))
def w_kernel_adaptive(spark, sf_dir):
    return edges_of(weights.kernel_weights(pts(spark, sf_dir), k=8, fixed=False))


@query(with_(CUST, LATTICE("cust", True), EDGES))
def w_rook_lattice(spark, sf_dir):
    return edges_of(weights.lattice(cells(cust(spark, sf_dir)), rook=True))


@query(with_(CUST, LATTICE("cust"), EDGES))
def w_queen_lattice(spark, sf_dir):
    return edges_of(weights.lattice(cells(cust(spark, sf_dir))))


@query(with_(NAT, LATTICE("nat"), "SELECT DISTINCT a.i, b.j, 1.0::DOUBLE AS w FROM e a JOIN e b ON a.j = b.i WHERE a.i <> b.j AND NOT EXISTS (SELECT 1 FROM e c WHERE c.i = a.i AND c.j = b.j)"))
def w_higher_order(spark, sf_dir):
    return weights.higher_order(weights.lattice(cells(nat(spark, sf_dir))), 2).edges


@query(with_(NAT, LATTICE("nat"), f"SELECT i, j, {R('1 / sqrt(count(*) OVER (PARTITION BY i))', 'w')} FROM e"))
def w_variance_transform(spark, sf_dir):
    return edges_of(weights.lattice(cells(nat(spark, sf_dir)), transform=None).transformed("variance"))


@query(with_(PTS, BAND(0.01), "SELECT id FROM pts WHERE id NOT IN (SELECT i FROM e)"))
def w_islands(spark, sf_dir):
    return weights.distance_band(pts(spark, sf_dir), 0.01).islands()


@query("WITH RECURSIVE " + ", ".join([PTS, BAND(0.02), "reach(id, n) AS (SELECT id, id FROM pts UNION SELECT r.id, e.j FROM reach r JOIN e ON e.i = r.n)"]) + " SELECT id, min(n) AS component FROM reach GROUP BY 1")
def w_components(spark, sf_dir):
    return weights.distance_band(pts(spark, sf_dir), 0.02).components()


@query(with_(PTS, KNN(), f"SELECT {R('max(abs(d))', 'max_diff')} FROM (SELECT i, j, sum(w) AS d FROM (SELECT i, j, w FROM e UNION ALL SELECT j, i, -w FROM e) GROUP BY 1, 2)"))
def w_symmetry(spark, sf_dir):
    return rounded(knn8(spark, sf_dir).asymmetry())


@query(with_(PTS, KNN(), f"SELECT i AS id, {R('sum(w * z)', 'lag')} FROM e JOIN pts ON pts.id = e.j GROUP BY 1"))
def w_lag(spark, sf_dir):
    return rounded(knn8(spark, sf_dir).lag(zed(spark, sf_dir)))


@query(with_(PTS, BAND(0.02), "SELECT p.id, count(e.j) AS n_neighbours FROM pts p LEFT JOIN e ON e.i = p.id GROUP BY 1"))
def w_cardinalities(spark, sf_dir):
    return weights.distance_band(pts(spark, sf_dir), 0.02).cardinalities()


THIRD = "SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM nat a JOIN nat b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM nat c WHERE c.id <> a.id AND c.id <> b.id AND {})"


@query(with_(NAT, THIRD.format("greatest(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y))) < " + D + " - 1e-12")))
def w_rng_graph(spark, sf_dir):
    return weights.relative_neighbourhood(nat(spark, sf_dir), transform=None).edges


@query(with_(NAT, THIRD.format("power(c.x - (a.x + b.x) / 2, 2) + power(c.y - (a.y + b.y) / 2, 2) < power(" + D + " / 2, 2) - 1e-12")))
def w_gabriel(spark, sf_dir):
    return weights.gabriel(nat(spark, sf_dir), transform=None).edges


@query()
def w_delaunay(spark, sf_dir):
    return weights.delaunay(pts(spark, sf_dir), transform=None).edges


@query(with_(NAT, LATTICE("nat"), EDGES))
def w_queen_polygons(spark, sf_dir):
    n = nat(spark, sf_dir)
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    squares = n.select("id", F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5)).alias("ring"))
    return edges_of(weights.contiguity(squares))


@query(with_(PTS, KNN(), CZ, f"SELECT {R('(SELECT sum(w * (p.y - q.y) * (p.y - q.y)) FROM e JOIN zz p ON p.id = e.i JOIN zz q ON q.id = e.j) / (2 * (SELECT sum(w) FROM e) * m2 / (n - 1))', 'C')}, 1.0::DOUBLE AS \"expected_C\", n FROM mm"))
def geary(spark, sf_dir):
    return rounded(esda.geary(zed(spark, sf_dir), knn8(spark, sf_dir)))


@query(with_(PTS, KNN(), f"SELECT {R('(SELECT sum(w * (p.z + 1) * (q.z + 1)) FROM e JOIN pts p ON p.id = e.i JOIN pts q ON q.id = e.j) / (sum(z + 1) * sum(z + 1) - sum((z + 1) * (z + 1)))', 'G')}, count(*) AS n FROM pts"))
def general_g(spark, sf_dir):
    return rounded(esda.general_g(pts(spark, sf_dir).select("id", (F.col("z") + 1).alias("y")), knn8(spark, sf_dir)))


BV = "bb AS (SELECT id, z - avg(z) OVER () AS zx, v - avg(v) OVER () AS zy FROM pts)"


@query(with_(PTS, KNN(), BV, f"SELECT {R('count(*) / (SELECT sum(w) FROM e) * (SELECT sum(w * p.zx * q.zy) FROM e JOIN bb p ON p.id = e.i JOIN bb q ON q.id = e.j) / sum(zx * zx)', 'I')}, count(*) AS n FROM bb"))
def moran_bv(spark, sf_dir):
    return rounded(esda.moran_bivariate(pts(spark, sf_dir).select("id", F.col("z").alias("zz"), "v"), knn8(spark, sf_dir), "zz", "v"))


@query(with_(PTS, KNN(), "dd AS (SELECT id, (v - z) - avg(v - z) OVER () AS z FROM pts)", f"SELECT {R('count(*) / (SELECT sum(w) FROM e) * (SELECT sum(w * p.z * q.z) FROM e JOIN dd p ON p.id = e.i JOIN dd q ON q.id = e.j) / sum(z * z)', 'I')}, count(*) AS n FROM dd"))
def moran_diff(spark, sf_dir):
    return rounded(esda.moran_difference(pts(spark, sf_dir), knn8(spark, sf_dir), "v", "z").select("I", "n"))


@query(with_(CUST, LATTICE("cust", True), "b AS (SELECT id, CASE WHEN z > 4000 THEN 1 ELSE 0 END AS b FROM cust), s AS (SELECT p.b + q.b AS s FROM e JOIN b p ON p.id = e.i JOIN b q ON q.id = e.j WHERE i < j)", 'SELECT count(*) FILTER (s = 2) AS "BB", count(*) FILTER (s = 0) AS "WW", count(*) FILTER (s = 1) AS "BW" FROM s'))
def join_counts(spark, sf_dir):
    c = cust(spark, sf_dir)
    return esda.join_counts(c.select("id", (F.col("z") > 4000).cast("int").alias("y")), weights.lattice(cells(c), rook=True))


LAG = "lg AS (SELECT i AS id, sum(w * q.z) AS lag FROM e JOIN zz q ON q.id = e.j GROUP BY 1)"
QUAD = "CASE WHEN {0} > 0 AND {1} > 0 THEN 1 WHEN {0} <= 0 AND {1} > 0 THEN 2 WHEN {0} <= 0 AND {1} <= 0 THEN 3 ELSE 4 END AS quadrant"


@query(with_(PTS, KNN(), CZ, LAG, f"SELECT zz.id, {R('z * lag / (m2 / n)', 'Ii')}, {R('z', 'z')}, {R('lag', 'lag')}, {QUAD.format('z', 'lag')} FROM zz JOIN lg ON lg.id = zz.id, mm"))
def lisa(spark, sf_dir):
    return rounded(esda.local_moran(zed(spark, sf_dir), knn8(spark, sf_dir)))


@query(with_(PTS, KNN(), "bb AS (SELECT id, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS zx, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS zy FROM pts)", "lg AS (SELECT i AS id, sum(w * zy) AS lag FROM e JOIN bb ON bb.id = e.j GROUP BY 1)", f"SELECT bb.id, {R('zx * lag', 'Ii')}, {R('zx', 'zx')}, {R('lag', 'lag')}, {QUAD.format('zx', 'lag')} FROM bb JOIN lg ON lg.id = bb.id"))
def lisa_bv(spark, sf_dir):
    return rounded(esda.local_moran_bivariate(pts(spark, sf_dir).select("id", F.col("z").alias("zz"), "v"), knn8(spark, sf_dir), "zz", "v"))


@query(with_(PTS, KNN(), f"SELECT i AS id, {R('sum(w * (p.z - q.z) * (p.z - q.z))', 'Ci')} FROM e JOIN pts p ON p.id = e.i JOIN pts q ON q.id = e.j GROUP BY 1"))
def local_geary(spark, sf_dir):
    return rounded(esda.local_geary(zed(spark, sf_dir), knn8(spark, sf_dir)))


@query(with_(PTS, KNN(), "s AS (SELECT i AS id, sum(w * z) AS wy, sum(w) AS sw, sum(w * w) AS sw2 FROM e JOIN pts ON pts.id = e.j GROUP BY 1), t AS (SELECT count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM pts), u AS (SELECT p.id, wy, sw, sw2, n, (t.s - p.z) / (n - 1) AS m, (q - p.z * p.z) / (n - 1) AS qq FROM pts p JOIN s ON s.id = p.id, t)", f"SELECT id, {R('(wy - m * sw) / sqrt((qq - m * m) * ((n - 1) * sw2 - sw * sw) / (n - 2))', 'z')} FROM u"))
def gi(spark, sf_dir):
    return rounded(esda.local_g(zed(spark, sf_dir), knn8(spark, sf_dir)))


def gi_star_sql(self_weight: str, scale: str) -> str:
    return with_(PTS, KNN(), f"ee AS (SELECT i, j, w * {scale} AS w FROM e UNION ALL SELECT id, id, {self_weight} * {scale} FROM pts), s AS (SELECT i AS id, sum(w * z) AS wy, sum(w) AS sw, sum(w * w) AS sw2 FROM ee JOIN pts ON pts.id = ee.j GROUP BY 1), t AS (SELECT count(*) AS n, avg(z) AS m, avg(z * z) AS q FROM pts)", f"SELECT id, {R('(wy - m * sw) / sqrt((q - m * m) * (n * sw2 - sw * sw) / (n - 1))', 'z')} FROM s, t")


@query(gi_star_sql("1.0::DOUBLE", "1"))
def gi_star(spark, sf_dir):
    return rounded(esda.local_g(zed(spark, sf_dir), knn8(spark, sf_dir), star=True))


@query(gi_star_sql("0.125::DOUBLE", "(8.0::DOUBLE / 9)"))
def hotspot_gi(spark, sf_dir):
    return rounded(esda.hotspots(zed(spark, sf_dir), knn8(spark, sf_dir)).select("id", "z"))


@query("WITH p AS (SELECT p_partkey AS id, p_retailprice / 3000 AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM p), a AS (SELECT id, least(1.0, min(raw) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT id, round(q, 6) + 0.0 AS p_adjusted, q <= 0.5 AS reject FROM a")
def bh_adjust(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 3000).alias("p_value"))
    return rounded(esda.adjusted_p(p, alpha=0.5).select("id", "p_adjusted", "reject"))


PERM = """reps AS (SELECT unnest(range(0, 19)) AS rep), pl AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY id) AS at FROM pts, reps),
 dr AS (SELECT rep, z AS y, row_number() OVER (PARTITION BY rep ORDER BY md5('7:' || rep || ':' || id), id) AS at FROM pts, reps), sm AS (SELECT pl.rep, id, y FROM pl JOIN dr ON pl.rep = dr.rep AND pl.at = dr.at UNION ALL SELECT -1, id, z FROM pts)"""


@query(with_(PTS, KNN(), CZ, PERM, """av AS (SELECT avg(z) AS m FROM pts), st AS (SELECT a.rep, sum(w * (a.y - m) * (b.y - m)) * max(n) / (SELECT sum(w) FROM e) / max(m2) AS s FROM e JOIN sm a ON a.id = e.i JOIN sm b ON b.id = e.j AND a.rep = b.rep, av, mm GROUP BY 1),
 o AS (SELECT s AS observed FROM st WHERE rep = -1), c AS (SELECT observed, avg(s) AS mean_sim, count(*) FILTER (abs(s) >= abs(observed) - 1e-12) AS far, count(*) FILTER (s >= observed - 1e-12) AS up, count(*) FILTER (s <= observed + 1e-12) AS dn FROM st, o WHERE rep >= 0 GROUP BY 1)""",
 f"SELECT {R('observed', 'observed')}, {R('mean_sim', 'mean_sim')}, {R('(far + 1) / 20.0::DOUBLE', 'p_compat')}, {R('least(1.0, 2 * least((1 + up) / 20.0::DOUBLE, (1 + dn) / 20.0::DOUBLE))', 'p_value')} FROM c"))
def moran_perm(spark, sf_dir):
    return rounded(esda.permutation_test(zed(spark, sf_dir), knn8(spark, sf_dir), "moran", 19, 7))


# Point patterns, in the square from -1 to 1.
SQUARE = frame.Window.box(-1, -1, 1, 1)
RS = [0.05, 0.1, 0.15, 0.2]
RG = "rg AS (SELECT unnest([0.05, 0.1, 0.15, 0.2])::DOUBLE AS r)"
NN = "nn AS (SELECT i AS id, d FROM e1)"
B = "least(x + 1, 1 - x, y + 1, 1 - y)"


def pattern(spark, sf_dir) -> frame.PointPattern:
    return frame.PointPattern(pts(spark, sf_dir), SQUARE)


@query(with_(PTS, "c AS (SELECT least(floor((x + 1) / 0.4), 4)::INTEGER AS cx, least(floor((y + 1) / 0.4), 4)::INTEGER AS cy, count(*) AS n FROM pts GROUP BY 1, 2), g AS (SELECT a.cx::INTEGER AS cx, b.cy::INTEGER AS cy FROM (SELECT unnest(range(5)) AS cx) a, (SELECT unnest(range(5)) AS cy) b)", f"SELECT g.cx, g.cy, coalesce(c.n, 0) AS n, {R('(SELECT count(*) FROM pts) / 25.0::DOUBLE', 'expected')} FROM g LEFT JOIN c ON c.cx = g.cx AND c.cy = g.cy"))
def quadrat(spark, sf_dir):
    return rounded(pointpattern.quadrat_counts(pattern(spark, sf_dir)))


QUADRAT = with_(PTS, "c AS (SELECT least(floor((x + 1) / 0.4), 4)::INTEGER AS cx, least(floor((y + 1) / 0.4), 4)::INTEGER AS cy, count(*) AS n FROM pts GROUP BY 1, 2), g AS (SELECT a.cx, b.cy, coalesce(c.n, 0) AS n, (SELECT count(*) FROM pts) / 25.0::DOUBLE AS x FROM (SELECT unnest(range(5)) AS cx) a CROSS JOIN (SELECT unnest(range(5)) AS cy) b LEFT JOIN c ON c.cx = a.cx AND c.cy = b.cy)", f"SELECT {R('sum((n - x) * (n - x) / x)', 'chi2')}, 24.0::DOUBLE AS df, {R('var_samp(n) / avg(n)', 'dispersion')} FROM g")


THEO = R("1 - exp(-(SELECT count(*) FROM pts) / 4.0::DOUBLE * pi() * r * r)", "theo")


@query(with_(PTS, KNN(1, "e1"), RG, f"SELECT {R('r', 'r')}, {R('avg(CASE WHEN d <= r THEN 1.0 ELSE 0 END)', 'est')}, {THEO} FROM rg, (SELECT d FROM e1) GROUP BY r"))
def g_function(spark, sf_dir):
    return rounded(pointpattern.g_function(pattern(spark, sf_dir), RS, "none"))


KM = "km AS (SELECT t, 1 - e / sum(n) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT least(d, b) AS t, sum(CASE WHEN d <= b THEN 1.0::DOUBLE ELSE 0 END) AS e, count(*) AS n FROM db GROUP BY 1))"


@query(with_(PTS, KNN(1, "e1"), RG, f"db AS (SELECT d, {B} AS b FROM e1 JOIN pts ON pts.id = e1.i)", KM, f"SELECT {R('r', 'r')}, {R('1 - coalesce(product(f), 1)', 'est')}, {THEO} FROM rg LEFT JOIN km ON t <= r GROUP BY r"))
def g_function_km(spark, sf_dir):
    return rounded(pointpattern.g_function(pattern(spark, sf_dir), RS, "km"))


FG = "gr AS (SELECT a.i * 100000 + b.i AS id, -1 + (b.i + 0.5::DOUBLE) * 0.2 AS x, -1 + (a.i + 0.5::DOUBLE) * 0.2 AS y FROM (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS i) b), fd AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM gr a, pts b GROUP BY 1)"


@query(with_(PTS, RG, FG, f"SELECT {R('r', 'r')}, {R('avg(CASE WHEN d <= r THEN 1.0 ELSE 0 END)', 'est')}, {THEO} FROM rg, fd GROUP BY r"))
def f_function(spark, sf_dir):
    return rounded(pointpattern.f_function(pattern(spark, sf_dir), RS, "none", 10))


@query(with_(PTS, KNN(1, "e1"), RG, FG, "g AS (SELECT r, avg(CASE WHEN d <= r THEN 1.0::DOUBLE ELSE 0 END) AS g FROM rg, (SELECT d FROM e1) GROUP BY r), f AS (SELECT r, avg(CASE WHEN d <= r THEN 1.0::DOUBLE ELSE 0 END) AS f FROM rg, fd GROUP BY r)", f"SELECT {R('g.r', 'r')}, {R('CASE WHEN 1 - f > 0.001 THEN (1 - g) / (1 - f) END', 'est')}, 1.0::DOUBLE AS theo FROM g JOIN f ON f.r = g.r"))
def j_function(spark, sf_dir):
    return rounded(pointpattern.j_function(pattern(spark, sf_dir), RS, 10, "none"))


TR = "4.0::DOUBLE / greatest(greatest(2 - abs(dx), 0) * greatest(2 - abs(dy), 0), 0.04)"


@query(with_(PTS, BAND(0.2), RG, f"SELECT {R('r', 'r')}, {R('coalesce(sum(w), 0) * 4 / ((SELECT count(*) FROM pts) * ((SELECT count(*) FROM pts) - 1.0::DOUBLE))', 'est')}, {R('pi() * r * r', 'theo')} FROM rg LEFT JOIN e ON d <= r GROUP BY r"))
def ripley_k(spark, sf_dir):
    return rounded(pointpattern.ripley_k(pattern(spark, sf_dir), RS, "none"))


@query(with_(PTS, BAND(0.2), RG, f"SELECT {R('r', 'r')}, {R(f'sqrt(coalesce(sum({TR}), 0) * 4 / ((SELECT count(*) FROM pts) * ((SELECT count(*) FROM pts) - 1.0::DOUBLE)) / pi())', 'est')}, {R('r', 'theo')} FROM rg LEFT JOIN e ON d <= r GROUP BY r"))
def ripley_l(spark, sf_dir):
    return rounded(pointpattern.ripley_l(pattern(spark, sf_dir), RS))


@query(with_(PTS, BAND(0.2), RG, f"ed AS (SELECT d, {B} AS b FROM e JOIN pts ON pts.id = e.i)", f"SELECT {R('r', 'r')}, {R(f'(SELECT count(*) FROM ed WHERE d <= r AND b >= r) * 4.0::DOUBLE / ((SELECT count(*) FROM pts) - 1) / (SELECT count(*) FROM pts WHERE {B} >= r)', 'est')}, {R('pi() * r * r', 'theo')} FROM rg"))
def ripley_k_border(spark, sf_dir):
    return rounded(pointpattern.ripley_k(pattern(spark, sf_dir), RS, "border"))


@query(with_(PTS, BAND(0.25), RG, f"SELECT {R('r', 'r')}, {R(f'coalesce(sum(0.75 * (1 - power((r - d) / 0.05, 2)) / 0.05 * 4 * {TR}), 0) / ((SELECT count(*) FROM pts) * ((SELECT count(*) FROM pts) - 1.0::DOUBLE) * 2 * pi() * r)', 'est')}, 1.0::DOUBLE AS theo FROM rg LEFT JOIN e ON abs(r - d) <= 0.05 GROUP BY r"))
def pair_correlation(spark, sf_dir):
    return rounded(pointpattern.pair_correlation(pattern(spark, sf_dir), RS, 0.05))


@query(with_(PTS, BAND(0.2), RG, "m AS (SELECT count(*) FILTER (mark = 1) AS a, count(*) FILTER (mark = 2) AS b FROM pts), ee AS (SELECT e.* FROM e JOIN pts p ON p.id = e.i AND p.mark = 1 JOIN pts q ON q.id = e.j AND q.mark = 2)", f"SELECT {R('r', 'r')}, {R(f'coalesce(sum({TR}), 0) * 4 / (max(a) * max(b))', 'est')}, {R('pi() * r * r', 'theo')} FROM (SELECT * FROM rg, m) LEFT JOIN ee ON d <= r GROUP BY r"))
def cross_k(spark, sf_dir):
    return rounded(pointpattern.cross_k(pattern(spark, sf_dir), 1, 2, RS))


LAM = f"lm AS (SELECT p.id, greatest(coalesce(s, 0) / (2 * pi() * 0.01), 1e-12 / 4) AS lam FROM pts p LEFT JOIN (SELECT i, sum(exp(-d * d / 0.02)) AS s FROM e4 GROUP BY 1) s ON s.i = p.id)"


@query(with_(PTS, BAND(0.4, "e4"), LAM, f"SELECT id, {R('lam', 'lam')} FROM lm"))
def intensity_loo(spark, sf_dir):
    return rounded(pointpattern.intensity_at_events(pattern(spark, sf_dir), 0.1))


@query(with_(PTS, BAND(0.4, "e4"), BAND(0.2), LAM, RG, "ee AS (SELECT e.*, 1 / (p.lam * q.lam) AS l FROM e JOIN lm p ON p.id = e.i JOIN lm q ON q.id = e.j)", f"SELECT {R('r', 'r')}, {R(f'coalesce(sum(l * {TR}), 0) / 4', 'est')}, {R('pi() * r * r', 'theo')} FROM rg LEFT JOIN ee ON d <= r GROUP BY r"))
def k_inhom(spark, sf_dir):
    return rounded(pointpattern.k_inhomogeneous(pattern(spark, sf_dir), 0.1, RS))


KG = "ax AS (SELECT unnest(range(16)) AS k), kg AS (SELECT a.k::INTEGER AS ix, b.k::INTEGER AS iy, -1 + (a.k + 0.5::DOUBLE) * 0.125 AS gx, -1 + (b.k + 0.5::DOUBLE) * 0.125 AS gy FROM ax a, ax b), ms AS (SELECT a.k, sum(exp(-0.5 * power((a.k - b.k) * 0.125 / 0.2, 2)) / sqrt(2 * pi()) / 0.2 * 0.125) AS m FROM ax a JOIN ax b ON abs(a.k - b.k) * 0.125 <= 0.8 GROUP BY 1)"


def KDE(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT ix, iy, gx, gy, coalesce(sum(exp(-0.5 * power((gx - x) / 0.2, 2)) * exp(-0.5 * power((gy - y) / 0.2, 2)) / (2 * pi()) / 0.04), 0) / (any_value(mx.m) * any_value(my.m)) AS density FROM kg JOIN ms mx ON mx.k = ix JOIN ms my ON my.k = iy LEFT JOIN pts ON abs(gx - x) <= 0.8 AND abs(gy - y) <= 0.8 AND {where} GROUP BY ALL)"


@query(with_(PTS, KG, KDE("kd"), f"SELECT ix, iy, {R('gx', 'x')}, {R('gy', 'y')}, {R('density', 'density')} FROM kd"))
def kde_grid(spark, sf_dir):
    return rounded(pointpattern.kde(pattern(spark, sf_dir), 0.2, 16))


@query(with_(PTS, KG, KDE("ka", "mark = 1"), KDE("kb", "mark = 2"), f"SELECT ka.ix, ka.iy, {R('ka.gx', 'x')}, {R('ka.gy', 'y')}, {R('ka.density / (SELECT count(*) FROM pts WHERE mark = 1) / (kb.density / (SELECT count(*) FROM pts WHERE mark = 2))', 'risk')} FROM ka JOIN kb ON ka.ix = kb.ix AND ka.iy = kb.iy WHERE ka.density > 1e-3 AND kb.density > 1e-3"))
def relative_risk(spark, sf_dir):
    pp = pattern(spark, sf_dir)
    a, b = pp.by_mark(1), pp.by_mark(2)
    risk = pointpattern.relative_risk(a, b, 0.2, 16, log=False)
    dense = lambda p: pointpattern.kde(p, 0.2, 16).where("density > 1e-3").select("ix", "iy")
    return rounded(risk.join(dense(a), ["ix", "iy"]).join(dense(b), ["ix", "iy"]))


@query()
def thomas(spark, sf_dir):
    return pointpattern.thomas(spark, SQUARE, 5, 0.05, 10, seed=3)


@query()
def matern(spark, sf_dir):
    return pointpattern.matern_inhibition(spark, SQUARE, 50, 0.1, seed=3)


# Interpolation: z of the points at a grid of targets.
TG = "tg AS (SELECT a.i * 1000 + b.i AS id, -0.25 + b.i * 0.05::DOUBLE AS x, -0.25 + a.i * 0.05::DOUBLE AS y FROM (SELECT unnest(range(11)) AS i) a, (SELECT unnest(range(11)) AS i) b)"


def targets(spark) -> DataFrame:
    g = spark.range(121).select((F.col("id") % 11).alias("b"), F.floor(F.col("id") / 11).alias("a"))
    return g.select((F.col("a") * 1000 + F.col("b")).alias("id"), (-0.25 + F.col("b") * 0.05).alias("x"), (-0.25 + F.col("a") * 0.05).alias("y"))


TN = f"tn AS (SELECT a.id AS i, b.id AS j, b.z, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM tg a, pts b)"


@query(with_(PTS, TG, TN, f"SELECT i AS id, {R('z', 'pred')} FROM tn WHERE r = 1"))
def nearest(spark, sf_dir):
    return rounded(interpolation.nearest_neighbour(pts(spark, sf_dir), targets(spark)))


@query(with_(PTS, TG, TN, f"SELECT i AS id, {R('sum(z / (d * d)) / sum(1 / (d * d))', 'pred')} FROM tn WHERE r <= 12 GROUP BY 1"))
def idw(spark, sf_dir):
    return rounded(interpolation.idw(pts(spark, sf_dir), targets(spark)))


VG = "SELECT least(floor(d / 0.05), 9)::INTEGER AS bin, {}, {}, count(*) AS n_pairs FROM e JOIN pts p ON p.id = e.i JOIN pts q ON q.id = e.j WHERE i < j GROUP BY 1"


@query(with_(PTS, BAND(0.5), VG.format(R("avg(d)", "lag"), R("0.5 * avg((p.z - q.z) * (p.z - q.z))", "gamma"))))
def variogram(spark, sf_dir):
    return rounded(interpolation.empirical_variogram(pts(spark, sf_dir), 10, 0.5))


IND = "(CASE WHEN p.z >= 0 THEN 1.0 ELSE 0 END - CASE WHEN q.z >= 0 THEN 1.0 ELSE 0 END)"


@query(with_(PTS, BAND(0.5), VG.format(R("avg(d)", "lag"), R(f"0.5 * avg({IND} * {IND})", "gamma"))))
def indicator_variogram(spark, sf_dir):
    return rounded(interpolation.indicator_variogram(pts(spark, sf_dir), 0.0, 10, 0.5))


@query(with_(PTS, BAND(0.5), VG.format(R("avg(d)", "lag"), R("0.5 * avg((p.z - q.z) * (p.v - q.v))", "gamma"))))
def cross_variogram(spark, sf_dir):
    return rounded(interpolation.empirical_variogram(pts(spark, sf_dir), 10, 0.5, other="v"))


@query(with_(PTS, KNN(12), f"SELECT i AS id, {R('any_value(p.z)', 'observed')}, {R('sum(q.z / (d * d)) / sum(1 / (d * d))', 'pred')} FROM e JOIN pts p ON p.id = e.i JOIN pts q ON q.id = e.j GROUP BY 1"))
def cv_idw_loo(spark, sf_dir):
    return rounded(interpolation.cv_idw(pts(spark, sf_dir)))


@query(f"SELECT p_partkey AS id, {R('0.5 * (1 + a) * 1 + 0.5 * (a + b) * 1 + 0.5 * b * 1', 'estimate')} FROM (SELECT p_partkey, greatest(p_size / 50.0::DOUBLE, p_retailprice / 5000) AS a, least(p_size / 50.0::DOUBLE, p_retailprice / 5000) AS b FROM part)")
def etype(spark, sf_dir):
    a, b = F.col("p_size") / 50.0, F.col("p_retailprice") / 5000
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.greatest(a, b).alias("p0"), F.least(a, b).alias("p1"))
    return rounded(interpolation.etype(p, [1.0, 2.0], ["p0", "p1"], 0.0, 3.0))


def squares(spark, sf_dir) -> DataFrame:
    return nat(spark, sf_dir).select("id", (F.col("x") - 0.5).alias("x0"), (F.col("y") - 0.5).alias("y0"), (F.col("x") + 0.5).alias("x1"), (F.col("y") + 0.5).alias("y1"), "pop", (F.col("cases") / F.col("pop")).alias("rate"))


def zones(spark) -> DataFrame:
    return spark.range(9).select("id", ((F.col("id") % 3) * 5 / 3).alias("x0"), (F.floor(F.col("id") / 3) * 5 / 3).alias("y0"), ((F.col("id") % 3 + 1) * 5 / 3).alias("x1"), ((F.floor(F.col("id") / 3) + 1) * 5 / 3).alias("y1"))


ZN = "zn AS (SELECT id, (id % 3) * 5 / 3 AS x0, (id // 3) * 5 / 3 AS y0, (id % 3 + 1) * 5 / 3 AS x1, (id // 3 + 1) * 5 / 3 AS y1 FROM (SELECT unnest(range(9)) AS id)), sq AS (SELECT id, x - 0.5 AS x0, y - 0.5 AS y0, x + 0.5 AS x1, y + 0.5 AS y1, pop, cases / pop AS rate FROM nat), ov AS (SELECT t.id, pop, rate, (least(s.x1, t.x1) - greatest(s.x0, t.x0)) * (least(s.y1, t.y1) - greatest(s.y0, t.y0)) AS a FROM sq s JOIN zn t ON least(s.x1, t.x1) > greatest(s.x0, t.x0) AND least(s.y1, t.y1) > greatest(s.y0, t.y0))"


@query(with_(NAT, ZN, f"SELECT id, {R('sum(pop * a)', 'pop')}, {R('sum(rate * a) / sum(a)', 'rate')} FROM ov GROUP BY 1"))
def areal_weighting(spark, sf_dir):
    return rounded(interpolation.areal_weighting(squares(spark, sf_dir), zones(spark), ("pop",), ("rate",)))


DP = "dp AS (SELECT c_custkey AS pid, (c_custkey * 7 % 5000) / 1000.0::DOUBLE AS x, (c_custkey * 11 % 5000) / 1000.0::DOUBLE AS y, 1.0::DOUBLE AS w FROM customer), bs AS (SELECT dp.*, s.id AS s, s.pop AS v FROM dp JOIN sq s ON dp.x >= s.x0 AND dp.x < s.x1 AND dp.y >= s.y0 AND dp.y < s.y1), tt AS (SELECT s, sum(w) AS t FROM bs GROUP BY 1), dl AS (SELECT z.id, sum(v * w / t) AS value FROM bs JOIN tt ON tt.s = bs.s JOIN zn z ON bs.x >= z.x0 AND bs.x < z.x1 AND bs.y >= z.y0 AND bs.y < z.y1 GROUP BY 1), br AS (SELECT t.id, sum(s.pop * (least(s.x1, t.x1) - greatest(s.x0, t.x0)) * (least(s.y1, t.y1) - greatest(s.y0, t.y0))) AS value FROM sq s JOIN zn t ON least(s.x1, t.x1) > greatest(s.x0, t.x0) AND least(s.y1, t.y1) > greatest(s.y0, t.y0) WHERE s.id NOT IN (SELECT s FROM tt) GROUP BY 1)"


@query(with_(NAT, ZN, DP, f"SELECT zn.id, {R('coalesce((SELECT value FROM dl WHERE dl.id = zn.id), 0) + coalesce((SELECT value FROM br WHERE br.id = zn.id), 0)', 'value')} FROM zn"))
def dasymetric(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7 % 5000) / 1000.0).alias("x"), ((F.col("c_custkey") * 11 % 5000) / 1000.0).alias("y"))
    return rounded(interpolation.dasymetric(squares(spark, sf_dir), zones(spark), c, "pop"))


SPH = (0.001, 0.015, 0.2)


@query()
def ordinary_kriging(spark, sf_dir):
    return kriging.ordinary(pts(spark, sf_dir), targets(spark), "auto", 16)


@query()
def simple_kriging(spark, sf_dir):
    return kriging.simple(pts(spark, sf_dir), targets(spark), SPH, n_neighbors=16)


@query()
def universal_kriging(spark, sf_dir):
    return kriging.universal(pts(spark, sf_dir), targets(spark), SPH, 1, 16)


@query()
def cokriging(spark, sf_dir):
    p = pts(spark, sf_dir)
    return kriging.cokriging({"z": p, "v": p.select("id", "x", "y", F.col("v").alias("z"))}, targets(spark), {("z", "z"): kernels.Variogram("spherical", *SPH), ("v", "v"): kernels.Variogram("spherical", *SPH), ("z", "v"): kernels.Variogram("spherical", 0.0, 0.002, 0.2, True)})


@query()
def indicator_kriging(spark, sf_dir):
    return kriging.indicator(pts(spark, sf_dir), targets(spark), [-0.1, 0.0, 0.1], (0.05, 0.2, 0.2))


@query()
def regression_kriging(spark, sf_dir):
    p = pts(spark, sf_dir)
    t = targets(spark).withColumn("v", F.col("x") * 0.1)
    return kriging.regression_kriging(p, t, ["v", "x"], "linear", SPH)


@query()
def rbf(spark, sf_dir):
    return interpolation.rbf(pts(spark, sf_dir), targets(spark), neighbors=24)


@query()
def tin(spark, sf_dir):
    return interpolation.tin(pts(spark, sf_dir), targets(spark))


@query()
def thiessen(spark, sf_dir):
    return interpolation.thiessen_polygons(pts(spark, sf_dir), list(SQUARE.ring)).select("id", "area")


# Sampling of customers.
@query(with_(CUST, "SELECT id FROM cust ORDER BY md5('5:' || id), id LIMIT 100"))
def srs(spark, sf_dir):
    return sampling.simple_random(cust(spark, sf_dir), 100, 5).select("id")


@query(with_(CUST, "n AS (SELECT count(*) AS n FROM cust), u AS (SELECT (('0x' || md5('5-start:0')[1:13])::UBIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u), o AS (SELECT id, row_number() OVER (ORDER BY z, id) - 1 AS pos FROM (SELECT id, x AS z FROM cust))", "SELECT id, pos::INTEGER AS pos FROM o, n, u WHERE ceil((pos + 1) * (100.0::DOUBLE / n) - u) - ceil(pos * (100.0::DOUBLE / n) - u) > 0"))
def systematic(spark, sf_dir):
    return sampling.systematic(cust(spark, sf_dir), 100, "x", 5).select("id", F.col("pos").cast("int").alias("pos"))


@query(with_(CUST, "SELECT id, stratum FROM (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('5:' || id), id) AS r FROM cust) WHERE r <= 10"))
def stratified(spark, sf_dir):
    c = cust(spark, sf_dir)
    names = [r[0] for r in c.select("stratum").distinct().collect()]
    return sampling.stratified(c, "stratum", 10 * len(names), dict.fromkeys(names, 10), seed=5).select("id", "stratum")


@query(with_(CUST, "k AS (SELECT cluster FROM (SELECT DISTINCT cluster FROM cust) ORDER BY md5('5:cluster:' || cluster), cluster LIMIT 5)", "SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY md5('5:' || id), id) AS r FROM cust WHERE cluster IN (SELECT cluster FROM k)) WHERE r <= 5"))
def two_stage(spark, sf_dir):
    return sampling.two_stage(cust(spark, sf_dir), "cluster", 5, 5, 5).select("id", "cluster")


EST = "s AS (SELECT id, stratum, z, 10.0::DOUBLE / nn AS pi FROM (SELECT id, stratum, z, row_number() OVER (PARTITION BY stratum ORDER BY md5('5:' || id), id) AS r, count(*) OVER (PARTITION BY stratum) AS nn FROM cust) WHERE r <= 10), t AS (SELECT count(*)::DOUBLE AS n, sum(1 / pi) AS nn, sum(z / pi) AS sy FROM s), h AS (SELECT count(*) AS nh, sum(1 / pi) AS wh, var_samp(z) AS v FROM s GROUP BY stratum)"


@query(with_(CUST, EST, f"SELECT {R('any_value(n)', 'n')}, {R('any_value(sy / nn)', 'mean')}, {R('any_value(sy)', 'total')}, {R('sqrt(sum(power(wh / nn, 2) * (1 - nh / wh) * v / nh))', 'se')} FROM t, h"))
def estimate_mean(spark, sf_dir):
    c = cust(spark, sf_dir)
    names = [r[0] for r in c.select("stratum").distinct().collect()]
    s = sampling.stratified(c, "stratum", 10 * len(names), dict.fromkeys(names, 10), seed=5)
    return rounded(sampling.estimate_mean(s, "z", "stratified", "stratum").drop("lo", "hi"))


SB = "s AS (SELECT id, x, y FROM pts ORDER BY md5('5:' || id), id LIMIT 20), nr AS (SELECT i, j, d FROM (SELECT a.id AS i, b.id AS j, {0} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {0}, b.id) AS r FROM pts a, s b) WHERE r = 1), v AS (SELECT s.id, 20.0::DOUBLE / (SELECT count(*) FROM pts) * count(nr.i) AS v FROM s LEFT JOIN nr ON nr.j = s.id GROUP BY 1)".format(D)


@query(with_(PTS, SB, f"SELECT {R('(SELECT avg((v - 1) * (v - 1)) FROM v)', 'balance')}, {R('(SELECT avg(d) FROM nr)', 'mean_distance')}, {R('(SELECT max(d) FROM nr)', 'max_distance')}, {R(f'(SELECT min({D}) FROM s a JOIN s b ON a.id <> b.id)', 'min_spacing')}"))
def coverage(spark, sf_dir):
    p = pts(spark, sf_dir).select("id", "x", "y")
    n = p.count()
    return rounded(sampling.coverage(p.withColumn("pi", F.lit(20 / n)), sampling.simple_random(p, 20, 5).select("id", "x", "y")))


# Rates of nations.
AR = "rt AS (SELECT sum(cases) / sum(pop) AS r FROM nat), ar AS (SELECT id, cases AS o, pop * r AS e FROM nat, rt)"


def areas(spark, sf_dir) -> DataFrame:
    return rates.expected_counts(nat(spark, sf_dir).withColumnRenamed("cases", "O"))


@query(with_(NAT, AR, f"SELECT id, o AS \"O\", {R('e', chr(34) + 'E' + chr(34))} FROM ar"))
def expected_counts(spark, sf_dir):
    return rounded(areas(spark, sf_dir))


@query(with_(NAT, AR, f"SELECT id, {R('o / e', 'smr')} FROM ar"))
def smr(spark, sf_dir):
    return rounded(rates.smr(areas(spark, sf_dir)).select("id", "smr"))


EBM = "m AS (SELECT sum(o) / sum(e) AS m, avg(e) AS me, sum(e) AS se FROM ar), s2 AS (SELECT any_value(m) AS m, sum(e * power(o / e - m, 2)) / any_value(se) - any_value(m) / any_value(me) AS s2 FROM ar, m)"


@query(with_(NAT, AR, EBM, f"SELECT id, {R('o / e', 'raw')}, {R('CASE WHEN s2 > 0 THEN (m * m / s2 + o) / (m / s2 + e) ELSE m END', 'estimate')}, {R('CASE WHEN s2 > 0 THEN (m / s2) / (m / s2 + e) ELSE 1 END', 'shrinkage')} FROM ar, s2"))
def eb_mom(spark, sf_dir):
    return rounded(rates.eb_moments(areas(spark, sf_dir)))


JS = "es AS (SELECT id, o / e AS x, o / (e * e) AS v FROM ar), a AS (SELECT sum(x / v) / sum(1 / v) AS mu, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2, count(*) AS k FROM es), q AS (SELECT greatest(0, (sum(power(x - mu, 2) / v) - (any_value(k) - 1)) / (any_value(sw) - any_value(sw2) / any_value(sw))) AS t FROM es, a), mm AS (SELECT sum(x / (v + t)) / sum(1 / (v + t)) AS m FROM es, q)"


@query(with_(NAT, AR, JS, f"SELECT id, {R('x', 'raw')}, {R('v / (v + t) * m + (1 - v / (v + t)) * x', 'estimate')}, {R('v / (v + t)', 'shrinkage')} FROM es, q, mm"))
def eb_james_stein(spark, sf_dir):
    a = areas(spark, sf_dir).select("id", (F.col("O") / F.col("E")).alias("est"), (F.col("O") / (F.col("E") * F.col("E"))).alias("var"))
    return rounded(rates.james_stein(a))


EBL = "hd AS (SELECT i, j FROM e UNION ALL SELECT id, id FROM nat), m AS (SELECT i, sum(o) / sum(a.e) AS m, sum(a.e) AS se, avg(a.e) AS me FROM hd JOIN ar a ON a.id = hd.j GROUP BY 1), s AS (SELECT hd.i, any_value(m) AS m, sum(a.e * power(o / a.e - m, 2)) / any_value(se) - any_value(m) / any_value(me) AS s2 FROM hd JOIN ar a ON a.id = hd.j JOIN m ON m.i = hd.i GROUP BY 1)"


@query(with_(NAT, AR, LATTICE("nat"), EBL, f"SELECT a.id, {R('o / a.e', 'raw')}, {R('m + CASE WHEN s2 > 0 THEN s2 / (s2 + m / a.e) ELSE 0 END * (o / a.e - m)', 'estimate')} FROM ar a JOIN s ON s.i = a.id"))
def eb_local(spark, sf_dir):
    return rounded(rates.eb_local(areas(spark, sf_dir), weights.lattice(cells(nat(spark, sf_dir)))))


@query()
def eb_mle(spark, sf_dir):
    return rates.eb_mle(areas(spark, sf_dir))


@query()
def bym(spark, sf_dir):
    return bayes.summary(bayes.bym(areas(spark, sf_dir), weights.lattice(cells(nat(spark, sf_dir))), chains=2, draws=50, tune=100, thin=2, seed=1))


# Regression of z on v.
def model_frame(spark, sf_dir) -> DataFrame:
    return pts(spark, sf_dir).select("id", "z", "v", "x", "y")


def small(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in map(lambda u: u.item() if hasattr(u, "item") else u, r)) for r in rows], schema)


@query(with_(PTS, f"SELECT {R('regr_intercept(z, v)', 'intercept')}, {R('regr_slope(z, v)', 'slope')}, {R('regr_r2(z, v)', 'r2')}, {R('sqrt((regr_syy(z, v) - regr_slope(z, v) * regr_sxy(z, v)) / (count(*) - 2) / regr_sxx(z, v))', 'se_slope')} FROM pts"))
def ols(spark, sf_dir):
    f = regression.ols(model_frame(spark, sf_dir), "z", ["v"])
    return rounded(small(spark, [(f.beta[0], f.beta[1], f.stats["r2"], f.se[1])], "intercept double, slope double, r2 double, se_slope double"))


@query(with_(PTS, "c AS (SELECT regr_intercept(z, v) AS a, regr_slope(z, v) AS b FROM pts), r AS (SELECT z - a - b * v AS e FROM pts, c), q AS (SELECT e - avg(e) OVER () AS e FROM r), m AS (SELECT count(*) AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM q), t AS (SELECT m3 / power(m2, 1.5) AS s, m4 / (m2 * m2) AS k, n FROM m)", f"SELECT {R('s', 'skew')}, {R('k', 'kurtosis')}, {R('n / 6.0::DOUBLE * (s * s + (k - 3) * (k - 3) / 4)', 'stat')}, {R('exp(-n / 12.0::DOUBLE * (s * s + (k - 3) * (k - 3) / 4))', 'p_value')} FROM t"))
def jarque_bera(spark, sf_dir):
    m = model_frame(spark, sf_dir)
    return rounded(regression.jarque_bera(regression.residuals(m, regression.ols(m, "z", ["v"]), "z", ["v"])))


@query(with_(PTS, "c AS (SELECT regr_intercept(z, v) AS a, regr_slope(z, v) AS b FROM pts), r AS (SELECT power(z - a - b * v, 2) AS e2, v FROM pts, c)", f"SELECT {R('count(*) * regr_r2(e2, v)', 'stat')} FROM r"))
def breusch_pagan(spark, sf_dir):
    m = model_frame(spark, sf_dir)
    return rounded(small(spark, [(regression.breusch_pagan(m, regression.ols(m, "z", ["v"]), "z", ["v"])[0],)], "stat double"))


LM = """c AS (SELECT regr_intercept(z, v) AS a, regr_slope(z, v) AS b FROM pts), r AS (SELECT id, z - a - b * v AS e, a + b * v AS f, z, v FROM pts, c), l AS (SELECT i AS id, sum(w * e) AS we, sum(w * z) AS wy, sum(w * f) AS wf FROM e JOIN r ON r.id = e.j GROUP BY 1),
 t AS (SELECT (SELECT sum(w * w) FROM e) + (SELECT coalesce(sum(p.w * q.w), 0) FROM e p JOIN e q ON p.i = q.j AND p.j = q.i) AS t), s AS (SELECT sum(e * e) / count(*) AS s2, sum(e * we) AS ewe, sum(e * wy) AS ewy, regr_syy(wf, v) - regr_sxy(wf, v) * regr_sxy(wf, v) / regr_sxx(wf, v) AS mw FROM r JOIN l ON l.id = r.id),
 u AS (SELECT ewe / s2 AS de, ewy / s2 AS dl, mw / s2 + t AS dd, t FROM s, t)"""


@query(with_(PTS, KNN(), LM, f"SELECT {R('dl * dl / dd', 'lm_lag')}, {R('de * de / t', 'lm_error')}, {R('(dl - de) * (dl - de) / (dd - t)', 'rlm_lag')}, {R('power(de - t / dd * dl, 2) / (t * (1 - t / dd))', 'rlm_error')} FROM u"))
def lm_tests(spark, sf_dir):
    t = regression.lm_tests(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"])
    return rounded(small(spark, [(t["LM_lag"][0], t["LM_error"][0], t["RLM_lag"][0], t["RLM_error"][0])], "lm_lag double, lm_error double, rlm_lag double, rlm_error double"))


@query()
def spatial_lag(spark, sf_dir):
    return regression.spatial_lag(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"]).frame(spark)


@query()
def spatial_durbin(spark, sf_dir):
    return regression.spatial_lag(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"], durbin=True).frame(spark)


@query()
def spatial_error(spark, sf_dir):
    return regression.spatial_error(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"]).frame(spark)


@query()
def impacts(spark, sf_dir):
    f = regression.spatial_lag(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"])
    return regression.impact_table(spark, f, ["v"], 200)


# Geographically weighted models of z on v.
GWW = KNN(41, "n0", "pts", "1")
GWE = f"n0 AS (SELECT a.id AS i, b.id AS j, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM pts a, pts b), h0 AS (SELECT i, max(d) AS h FROM n0 WHERE r <= 41 GROUP BY 1), e AS (SELECT n0.i, j, d, power(1 - (d / h) * (d / h), 2) AS w FROM n0 JOIN h0 ON h0.i = n0.i WHERE r <= 41 AND d < h)"


@query(with_(PTS, GWE, "s AS (SELECT i, sum(w) AS s, sum(w * v) AS sx, sum(w * v * v) AS sxx, sum(w * z) AS sy, sum(w * v * z) AS sxy FROM e JOIN pts ON pts.id = e.j GROUP BY 1), b AS (SELECT i, s, sx, sy, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b1 FROM s)", f"SELECT i AS id, {R('(sy - b1 * sx) / s', 'b0')}, {R('b1', 'b1')} FROM b"))
def gwr_simple(spark, sf_dir):
    f = gw.gwr(model_frame(spark, sf_dir), "z", ["v"], 40)
    return rounded(f.select("id", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1")))


GWSS = "m AS (SELECT i, sum(w) AS sw, sum(w * z) / sum(w) AS zm, sum(w * v) / sum(w) AS vm FROM e JOIN pts ON pts.id = e.j GROUP BY 1), q AS (SELECT e.i, any_value(zm) AS zm, any_value(vm) AS vm, sum(w / sw * power(z - zm, 2)) AS z2, sum(w / sw * power(v - vm, 2)) AS v2, sum(w / sw * power(z - zm, 3)) AS z3, sum(w / sw * power(z - zm, 4)) AS z4, sum(w / sw * (z - zm) * (v - vm)) AS c FROM e JOIN pts ON pts.id = e.j JOIN m ON m.i = e.i GROUP BY 1)"


@query(with_(PTS, GWE, GWSS, f"SELECT i AS id, {R('zm', 'z_mean')}, {R('z2', 'z_var')}, {R('sqrt(z2)', 'z_std')}, {R('z3 / power(z2, 1.5)', 'z_skew')}, {R('z4 / (z2 * z2) - 3', 'z_kurt')}, {R('c / sqrt(z2 * v2)', 'z_v_corr')} FROM q"))
def gwss(spark, sf_dir):
    return rounded(gw.gwss(model_frame(spark, sf_dir), ["z", "v"], 40).select("id", "z_mean", "z_var", "z_std", "z_skew", "z_kurt", "z_v_corr"))


GWB = f"n0 AS (SELECT a.id AS i, b.id AS j, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM pts a, pts b), ca AS (SELECT unnest([30, 60, 90]) AS bandwidth), h0 AS (SELECT bandwidth, i, max(d) AS h FROM n0 JOIN ca ON r <= bandwidth + 1 GROUP BY 1, 2), e AS (SELECT bandwidth, n0.i, j, power(1 - (d / h) * (d / h), 2) AS w FROM h0 JOIN n0 ON h0.i = n0.i AND r <= bandwidth + 1 WHERE d < h), s AS (SELECT bandwidth, i, sum(w) AS s, sum(w * v) AS sx, sum(w * v * v) AS sxx, sum(w * z) AS sy, sum(w * v * z) AS sxy, sum(CASE WHEN i = j THEN w END) AS wii FROM e JOIN pts ON pts.id = e.j GROUP BY 1, 2), f AS (SELECT bandwidth, z - (sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s - (s * sxy - sx * sy) / (s * sxx - sx * sx) * v AS e, wii * (sxx - 2 * v * sx + v * v * s) / (s * sxx - sx * sx) AS hat FROM s JOIN pts ON pts.id = s.i), g AS (SELECT bandwidth, sum(e * e) AS rss, sum(hat) AS k, count(*) AS n FROM f GROUP BY 1)"


@query(with_(PTS, GWB, f"SELECT bandwidth, {R('rss', 'rss')}, {R('k', 'trace')}, {R('n * ln(rss / n) + n + k + 2 * k * (k + 1) / greatest(n - k - 1, 1e-6)', 'score')} FROM g"))
def gwr_bandwidth_grid(spark, sf_dir):
    return rounded(gw.gwr_scores(model_frame(spark, sf_dir), "z", "v", [30, 60, 90]))


@query()
def mgwr(spark, sf_dir):
    return gw.mgwr(model_frame(spark, sf_dir), "z", ["v"], [30, 60], 2).select("id", "fitted", "residual")


@query()
def mixed_gwr(spark, sf_dir):
    return gw.mixed_gwr(model_frame(spark, sf_dir), "z", ["v"], [], 40, 2)[1].select("id", "fitted", "residual")


@query()
def gwglm(spark, sf_dir):
    m = model_frame(spark, sf_dir).withColumn("n", F.floor(F.abs("z") * 20).cast("double"))
    return gw.gwglm(m, "n", ["v"], 60).select("id", "fitted")


@query()
def gw_forest(spark, sf_dir):
    n = nat(spark, sf_dir)
    return gw.gw_forest(n, "cases", ["pop", "x"], 12, trees=5, depth=3)


# Clusters.
@query(with_(PTS, KNN(5), f"SELECT i AS id, {R('d', 'd')} FROM e WHERE r = 5"))
def k_distance(spark, sf_dir):
    return rounded(cluster.k_distance(pts(spark, sf_dir), 5))


DB = "co AS (SELECT id FROM pts WHERE (SELECT count(*) FROM e WHERE e.i = pts.id) + 1 >= 5), ci AS (SELECT i, j FROM e WHERE i IN (SELECT id FROM co) AND j IN (SELECT id FROM co)), reach(id, n) AS (SELECT id, id FROM co UNION SELECT r.id, ci.j FROM reach r JOIN ci ON ci.i = r.n), lb AS (SELECT id, min(n) AS c FROM reach GROUP BY 1), tc AS (SELECT e.i AS id, min(c) AS c FROM e JOIN lb ON lb.id = e.j GROUP BY 1)"


@query("WITH RECURSIVE " + ", ".join([PTS, BAND(0.03), DB]) + " SELECT p.id, coalesce(lb.c, tc.c, -1) AS cluster, lb.c IS NOT NULL AS core FROM pts p LEFT JOIN lb ON lb.id = p.id LEFT JOIN tc ON tc.id = p.id")
def dbscan(spark, sf_dir):
    return cluster.dbscan(pts(spark, sf_dir), 0.03, 5)


@query()
def hdbscan(spark, sf_dir):
    return cluster.hdbscan(pts(spark, sf_dir), 10, 5)


SC = f"nn AS (SELECT a.id AS center, b.id AS j, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rank FROM nat a, nat b), tt AS (SELECT sum(o) AS c, sum(e) AS t FROM ar), wi AS (SELECT center, rank, d, lead(d) OVER (PARTITION BY center ORDER BY rank) AS nxt, sum(o) OVER (PARTITION BY center ORDER BY rank) AS co, sum(e) OVER (PARTITION BY center ORDER BY rank) AS ce FROM nn JOIN ar ON ar.id = nn.j)"


@query(with_(NAT, AR, SC, f"SELECT center, rank, {R('CASE WHEN co / ce > (c - co) / (t - ce) THEN co * ln(co / ce) + (c - co) * ln((c - co) / (t - ce)) ELSE 0 END', 'llr')} FROM wi, tt WHERE ce <= 0.5 * t AND co >= 2 AND (nxt IS NULL OR nxt > d)"))
def scan_llr(spark, sf_dir):
    n = nat(spark, sf_dir)
    a = n.select("id", "x", "y").join(areas(spark, sf_dir), "id")
    sums = a.agg(F.sum("O").alias("all_o"), F.sum("E").alias("all_e"))
    w = cluster._cumulated(cluster.scan_windows(a), a.select("id", "O", "E").crossJoin(F.broadcast(sums)), [], 0.5, 2, "high")
    return rounded(w.select("center", "rank", "llr"))


@query()
def scan_mc(spark, sf_dir):
    a = nat(spark, sf_dir).select("id", "x", "y").join(areas(spark, sf_dir), "id")
    return cluster.scan(a, replications=9)[0]


@query()
def skater(spark, sf_dir):
    n = nat(spark, sf_dir)
    return cluster.skater(n, ["pop", "cases"], weights.lattice(cells(n), rook=True), 4, 2)


@query()
def agglomerative(spark, sf_dir):
    n = nat(spark, sf_dir)
    return cluster.agglomerative(n, ["pop", "cases"], weights.lattice(cells(n), rook=True), 4)


@query(f"SELECT {R('count(*) FILTER (p_size > 25 AND p_retailprice > 1400) / count(*) FILTER (p_size > 25 OR p_retailprice > 1400)', 'jaccard')} FROM part")
def jaccard(spark, sf_dir):
    return rounded(cluster.jaccard(views.table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("a"), (F.col("p_retailprice") > 1400).alias("b")), "a", "b"))


PA = "lab AS (SELECT c_nationkey % 3 AS a, c_mktsegment AS b FROM customer), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS m FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS m FROM t GROUP BY 1), nn AS (SELECT sum(n) AS n FROM t), p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS pij, (SELECT sum(m * (m - 1) / 2) FROM ra) AS pa, (SELECT sum(m * (m - 1) / 2) FROM rb) AS pb, (SELECT -sum(m / n * ln(m / n)) FROM ra, nn) AS ha, (SELECT -sum(m / n * ln(m / n)) FROM rb, nn) AS hb, (SELECT sum(t.n / nn.n * ln(t.n * nn.n / (ra.m * rb.m))) FROM t JOIN ra ON ra.a = t.a JOIN rb ON rb.b = t.b, nn) AS mi, n FROM nn)"


@query(with_(PA, f"SELECT {R('(pij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2))', 'ari')}, {R('2 * mi / (ha + hb)', 'nmi')} FROM p"))
def partition_agreement(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("a"), F.col("c_mktsegment").alias("b"))
    return rounded(cluster.partition_agreement(c, "a", "b"))


# Space and time: daily totals of events by site.
PN = "pn AS (SELECT site AS id, day AS period, sum(value) AS y FROM ev GROUP BY 1, 2), si AS (SELECT DISTINCT site AS id, site // 5 AS row, site % 5 AS col FROM ev)"


def panel(spark, sf_dir) -> DataFrame:
    return views.events(spark, sf_dir).groupBy(F.col("site").alias("id"), F.col("day").alias("period")).agg(F.sum("value").alias("y"))


def sites(spark, sf_dir) -> weights.Weights:
    s = views.events(spark, sf_dir).select(F.col("site").alias("id"), F.floor(F.col("site") / 5).alias("row"), (F.col("site") % 5).alias("col")).distinct()
    return weights.lattice(s, transform=None)


E1 = "e AS (SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM si a JOIN si b ON greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1)"


@query(with_(EV, PN, E1, "z AS (SELECT period, id, y - avg(y) OVER (PARTITION BY period) AS z FROM pn), m AS (SELECT period, sum(z * z) AS m2, count(*) AS n FROM z GROUP BY 1), c AS (SELECT a.period, sum(w * a.z * b.z) AS num, sum(w) AS s0 FROM e JOIN z a ON a.id = e.i JOIN z b ON b.id = e.j AND a.period = b.period GROUP BY 1)", f"SELECT m.period, n, {R('n / s0 * num / m2', chr(34) + 'I' + chr(34))} FROM m JOIN c ON c.period = m.period"))
def moran_by_day(spark, sf_dir):
    return rounded(spacetime.moran_by_period(panel(spark, sf_dir), sites(spark, sf_dir)))


@query(with_(EV, "p AS (SELECT id, CAST(id % 97 AS DOUBLE) AS x, CAST(id % 89 AS DOUBLE) AS y, t FROM ev), e AS (SELECT a.t - b.t AS dt FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1)", "SELECT count(*) AS close_space, count(*) FILTER (abs(dt) <= 2) AS close_both FROM e"))
def knox(spark, sf_dir):
    e = views.events(spark, sf_dir).select("id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"), "t")
    return spacetime.knox(e, 1.0, 2.0)


MK = "s AS (SELECT a.id, sum(sign(b.y - a.y)) AS s FROM pn a JOIN pn b ON a.id = b.id AND a.period < b.period GROUP BY 1), n AS (SELECT id, count(*)::DOUBLE AS n FROM pn GROUP BY 1), k AS (SELECT n.id, n, coalesce(s, 0)::DOUBLE AS s, n * (n - 1) * (2 * n + 5) / 18 AS v FROM n LEFT JOIN s ON s.id = n.id)"


@query(with_(EV, PN, MK, f"SELECT id, n, s AS \"S\", {R('v', 'var_S')}, {R('CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(v) END', 'z')} FROM k"))
def mann_kendall(spark, sf_dir):
    return rounded(spacetime.mann_kendall(panel(spark, sf_dir).withColumnRenamed("y", "value")))


@query(with_(PTS, "q AS (SELECT id, x, y, CAST(id % 10 AS DOUBLE) AS t, z FROM pts)", f"p AS (SELECT {D} AS d, abs(a.t - b.t) AS dt, power(a.z - b.z, 2) AS g FROM q a JOIN q b ON a.id < b.id)", f"SELECT least(floor(d / 0.1), 3)::INTEGER AS s_bin, floor(dt / 2)::INTEGER AS t_bin, {R('0.5 * avg(g)', 'gamma')}, count(*) AS n_pairs FROM p WHERE d <= 0.1 * 4 AND dt < 6 GROUP BY 1, 2"))
def st_variogram(spark, sf_dir):
    s = pts(spark, sf_dir).withColumn("t", (F.col("id") % 10).cast("double"))
    return rounded(spacetime.space_time_variogram(s, 0.1, 4, 2.0, 3))


@query(with_(EV, "p AS (SELECT site AS id, day AS period, sum(value) AS y, count(*)::DOUBLE AS x FROM ev GROUP BY 1, 2), d AS (SELECT y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY period) + avg(y) OVER () AS a, x - avg(x) OVER (PARTITION BY id) - avg(x) OVER (PARTITION BY period) + avg(x) OVER () AS b FROM p)", f"SELECT {R('sum(a * b) / sum(b * b)', 'slope')}, count(*) AS n FROM d"))
def two_way_fe(spark, sf_dir):
    p = views.events(spark, sf_dir).groupBy(F.col("site").alias("id"), F.col("day").alias("period")).agg(F.sum("value").alias("v"), F.count("*").cast("double").alias("n_events"))
    return rounded(spacetime.two_way_effects(p, "v", "n_events"))


@query(f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, (user_id % 5) // 2 AS cx, (user_id // 5) // 2 AS cy, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY 1, 2, 3")
def quadrat_hours(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("ts", (F.col("user_id") % 5).cast("double").alias("x"), F.floor(F.col("user_id") / 5).cast("double").alias("y"), "value")
    return rounded(hotcells.counts(e, 2.0).select(F.unix_timestamp("start").alias("start_s"), "cx", "cy", "n", "total"))


KM_ = "2 * 6371.0::DOUBLE * asin(sqrt(least(1, greatest(0, power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))))"


@query(with_(NAT, f"SELECT a.id AS i, b.id AS j, {R(KM_, 'km')} FROM nat a JOIN nat b ON a.id < b.id"))
def haversine(spark, sf_dir):
    n = nat(spark, sf_dir)
    a, b = (n.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("i", "j"))
    km = distance.haversine(F.col("yi"), F.col("xi"), F.col("yj"), F.col("xj"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", r6(km).alias("km"))
