"""More operators as queries: functions of distance, tests with their p-values, permutations, local models, samples, windows, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, distance, kernels
from tessera.operators import bayes, cluster, esda, gw, interpolation, kriging, plots, pointpattern, rates, regression, sampling, spacetime, weights
from tessera.queries import AR, CUST, GWB, KDE, KG, CZ, D, EV, GWE, KNN, LAG, LATTICE, MORAN, NAT, PERM, PN, PTS, QUAD, QUADRAT, QUERIES, R, RG, RS, SQL, SQUARE, TG, areas, cells, cust, knn8, model_frame, nat, panel, pattern, pts, query, r6, rounded, sites, small, squares, targets, with_, zed, zones, E1, BAND
from tessera.sources import datasets, frame, views


# Tails as series of positive terms.
def P2(z: str) -> str:
    """Two-sided normal p-value of a column."""
    return f"(CASE WHEN abs({z}) < 1e-9 THEN 1.0::DOUBLE WHEN abs({z}) > 8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2.0::DOUBLE) + lgamma(k + 1))))) END)"


def PT(t: str, df: str) -> str:
    """Two-sided p-value of Student's t."""
    x = f"({t} * {t} / ({df} + {t} * {t}))"
    return f"(CASE WHEN abs({t}) < 1e-9 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - exp(0.5 * ln({x}) + {df} / 2 * ln(1 - {x}) - ln(0.5::DOUBLE) - lgamma(0.5) - lgamma({df} / 2) + lgamma(0.5 + {df} / 2)) * list_sum(list_transform(range(0, 1500), lambda k: exp(lgamma(0.5 + {df} / 2 + k) - lgamma(0.5 + {df} / 2) - lgamma(1.5 + k) + lgamma(1.5) + k * ln({x}))))) END)"


def CHI(x: str, df: str) -> str:
    """Upper tail of the chi-squared distribution."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 600 + 4 * {df} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - exp({df} / 2.0::DOUBLE * ln({x} / 2) - {x} / 2 - lgamma({df} / 2.0::DOUBLE + 1)) * list_sum(list_transform(range(0, 800), lambda k: exp(k * ln({x} / 2) + lgamma({df} / 2.0::DOUBLE + 1) - lgamma({df} / 2.0::DOUBLE + 1 + k))))) END)"


def BH(p: str, table: str, keep: str) -> str:
    """Benjamini-Hochberg as CTEs raw and bh (``keep``, p, q)."""
    return f"raw AS (SELECT {keep}, {p} AS p, {p} * count(*) OVER () / row_number() OVER (ORDER BY {p}, id) AS raw FROM {table}), bh AS (SELECT {keep}, p, least(1.0::DOUBLE, min(raw) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM raw)"


def U(seed: str, salt: str, *keys: str) -> str:
    """The hashed uniform of ``resample.uniform``."""
    return f"((('0x' || md5('{seed}-{salt}:' || {' || chr(58) || '.join(keys)})[1:13])::UBIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def NORMAL(seed: str, salt: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({U(seed, salt + '-r', *keys)})) * cos(2 * pi() * {U(seed, salt + '-a', *keys)}))"


def orthogonal(source: str, keys: str, columns: list[str], y: str, w: str = "1.0::DOUBLE") -> str:
    """CTEs of weighted least squares of y on a constant and the columns, by taking each column's part along the earlier ones out, for each value of the keys.

    Leaves ``q{p}`` (the source with q0, q1, ...), the steps' coefficients ``k1``, ...
    and ``bb`` with b0, b1, ... along the q's and d0, d1, ..., their sums of squares.
    """
    p = len(columns)
    out = [f"q0 AS (SELECT *, 1.0::DOUBLE AS q0 FROM {source})"]
    for k, c in enumerate(columns, 1):
        terms = ", ".join(f"sum({w} * ({c}) * q{m}) / sum({w} * q{m} * q{m}) AS c{k}_{m}" for m in range(k))
        out.append(f"k{k} AS (SELECT {keys}, {terms} FROM q{k - 1} GROUP BY {keys})")
        out.append(f"q{k} AS (SELECT q.*, ({c}) - {' - '.join(f'c{k}_{m} * q{m}' for m in range(k))} AS q{k} FROM q{k - 1} q JOIN k{k} USING ({keys}))")
    terms = ", ".join(f"sum({w} * {y} * q{m}) / sum({w} * q{m} * q{m}) AS b{m}, sum({w} * q{m} * q{m}) AS d{m}" for m in range(p + 1))
    out.append(f"bb AS (SELECT {keys}, {terms}, sum({w}) AS sw, sum({w} * {y}) AS swy, sum({w} * {y} * {y}) AS swyy FROM q{p} GROUP BY {keys})")
    return ", ".join(out)


def carried(source: str, keys: str, columns: list[str]) -> str:
    """CTEs t0, t1, ...: the q's of other rows (``source``, with the keys) by the steps' coefficients."""
    out = [f"t0 AS (SELECT *, 1.0::DOUBLE AS q0 FROM {source})"]
    for k, c in enumerate(columns, 1):
        out.append(f"t{k} AS (SELECT t.*, ({c}) - {' - '.join(f'c{k}_{m} * q{m}' for m in range(k))} AS q{k} FROM t{k - 1} t JOIN k{k} USING ({keys}))")
    return ", ".join(out)


# Functions of distance and of a column.
PART = "pp AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS d, p_retailprice AS price FROM part)"


def parts(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("d"), F.col("p_retailprice").alias("price"))


@query(with_(PART, f"SELECT id, {R('exp(-power(d / 3, 2))', 'gaussian')}, {R('CASE WHEN d < 3 THEN power(1 - power(d / 3, 2), 2) ELSE 0 END', 'bisquare')}, {R('CASE WHEN d < 3 THEN power(1 - power(d / 3, 3), 3) ELSE 0 END', 'tricube')}, {R('exp(-d / 3)', 'exponential')}, CASE WHEN d <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boxcar, {R('CASE WHEN d < 3 THEN 1 - d / 3 ELSE 0 END', 'triangular')}, {R('exp(-0.5 * d * d) / sqrt(2 * pi())', 'dens_gaussian')}, {R('CASE WHEN abs(d - 3) <= 1 THEN 0.75 * (1 - power(d - 3, 2)) ELSE 0 END', 'dens_epanechnikov')} FROM pp"))
def kernel_functions(spark, sf_dir):
    p, h = parts(spark, sf_dir), F.lit(3.0)
    dens = [kernels.density_1d(F.col("d")).alias("dens_gaussian"), kernels.density_1d(F.col("d") - 3, "epanechnikov").alias("dens_epanechnikov")]
    return rounded(p.select("id", *(kernels.kernel(n)(F.col("d"), h).alias(n) for n in kernels.KERNELS), *dens))


VS = {"spherical": "(1.5 * least(d / 4, 1) - 0.5 * power(least(d / 4, 1), 3))", "exponential": "(1 - exp(-3 * d / 4))", "gaussian": "(1 - exp(-3 * power(d / 4, 2)))"}


@query(with_(PART, f"SELECT id, {', '.join(R(f'0.3 + 1.2 * {s}', n) for n, s in VS.items())}, {', '.join(R(f'1.2 - 1.2 * {s}', n + '_cov') for n, s in VS.items())} FROM pp"))
def variogram_models(spark, sf_dir):
    p = parts(spark, sf_dir)
    models = {n: kernels.Variogram(n, 0.3, 1.2, 4.0) for n in VS}
    return rounded(p.select("id", *(m.gamma_column(F.col("d")).alias(n) for n, m in models.items()), *((m.sill - m.gamma_column(F.col("d"))).alias(f"{n}_cov") for n, m in models.items())))


@query(with_(NAT, f"SELECT a.id AS i, b.id AS j, {R(D, 'euclidean')}, {R('power(a.x - b.x, 2) + power(a.y - b.y, 2)', 'sqeuclidean')}, {R('abs(a.x - b.x) + abs(a.y - b.y)', 'cityblock')}, {R('greatest(abs(a.x - b.x), abs(a.y - b.y))', 'chebyshev')}, {R('sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + 0.25 * power(a.id - b.id, 2))', 'space_time')} FROM nat a JOIN nat b ON a.id < b.id"))
def distance_metrics(spark, sf_dir):
    n = nat(spark, sf_dir)
    a, b = (n.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("i", "j"))
    d = a.join(F.broadcast(b), F.col("i") < F.col("j"))
    xy = [F.col(c) for c in ("xi", "yi", "xj", "yj")]
    st = distance.space_time(xy[0], xy[1], F.col("i"), xy[2], xy[3], F.col("j"), 0.25)
    return rounded(d.select("i", "j", *(distance.metric(m)(*xy).alias(m) for m in ("euclidean", "sqeuclidean", "cityblock", "chebyshev")), st.alias("space_time")))


@query(with_(PTS, f"SELECT id, {R('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())', 'x')}, {R('(y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())', 'y')} FROM pts"))
def normalised_coordinates(spark, sf_dir):
    return rounded(distance.normalised(pts(spark, sf_dir).select("id", "x", "y"), "x", "y"))


@query(with_(PART, "q AS (SELECT quantile_cont(price, 0.2) AS a, quantile_cont(price, 0.4) AS b, quantile_cont(price, 0.6) AS c, quantile_cont(price, 0.8) AS e, min(price) AS lo, max(price) AS hi FROM pp)", "SELECT id, CASE WHEN price <= a THEN 0 WHEN price <= b THEN 1 WHEN price <= c THEN 2 WHEN price <= e THEN 3 ELSE 4 END AS quantiles, least(3, greatest(0, ceil((price - lo) / ((hi - lo) / 4) - 1e-12) - 1))::INTEGER AS equal_interval FROM pp, q"))
def map_classes(spark, sf_dir):
    p = parts(spark, sf_dir)
    a = plots.choropleth(p, "price").select("id", F.col("price_class").alias("quantiles"))
    b = classify.classified(p, "price", "equal_interval", 4).select("id", F.col("price_class").alias("equal_interval"))
    return a.join(b, "id")


# Autocorrelation with p-values.
@query(MORAN.rsplit(" SELECT ", 1)[0] + f", zs AS (SELECT n / s0 * num / m2 AS i, ei, var, n, (n / s0 * num / m2 - ei) / sqrt(var) AS z FROM vv) SELECT {R('i', 'I')}, {R('ei', 'expected_I')}, {R('var', 'var_I')}, n, {R('z', 'z_score')}, {R(P2('z'), 'p_norm')} FROM zs")
def moran(spark, sf_dir):
    """The flagship: with its p-value."""
    return rounded(esda.moran(zed(spark, sf_dir), knn8(spark, sf_dir)))


HOT = "ee AS (SELECT i, j, w * 8.0::DOUBLE / 9 AS w FROM e UNION ALL SELECT id, id, 1.0::DOUBLE / 9 FROM pts), s AS (SELECT i AS id, sum(w * z) AS wy, sum(w) AS sw, sum(w * w) AS sw2 FROM ee JOIN pts ON pts.id = ee.j GROUP BY 1), t AS (SELECT count(*) AS n, avg(z) AS m, avg(z * z) AS q FROM pts), gz AS (SELECT id, (wy - m * sw) / sqrt((q - m * m) * (n * sw2 - sw * sw) / (n - 1)) AS z FROM s, t), gp AS (SELECT id, z, " + P2("z") + " AS p_analytic FROM gz)"


@query(with_(PTS, KNN(), HOT, BH("p_analytic", "gp", "id, z"), f"SELECT id, {R('z', 'z')}, {R('p', 'p_analytic')}, {R('q', 'p_adjusted')}, CASE WHEN q <= 0.2 THEN (CASE WHEN z > 0 THEN 'Hot spot' ELSE 'Cold spot' END) || CASE WHEN q <= 0.02 THEN ' 99%' WHEN q <= 0.1 THEN ' 95%' ELSE ' 90%' END ELSE 'Not significant' END AS label FROM bh"))
def hotspot_labels(spark, sf_dir):
    return rounded(esda.hotspots(zed(spark, sf_dir), knn8(spark, sf_dir), alpha=0.1))


PERM_STAT = "zp AS (SELECT rep, sm.id, y - m AS z FROM sm, (SELECT avg(z) AS m FROM pts)), lp AS (SELECT e.i AS id, q.rep, sum(w * q.z) AS lag, sum(w) AS sw, sum(w * q.z * q.z) AS wzz FROM e JOIN zp q ON q.id = e.j GROUP BY 1, 2)"


def LOCAL(stat: str) -> str:
    return f"ls AS (SELECT zp.rep, zp.id, zp.z, lag, {stat} AS s FROM zp JOIN lp ON lp.id = zp.id AND lp.rep = zp.rep, (SELECT m2 / n AS var FROM mm)), ob AS (SELECT id, z, lag, s AS stat FROM ls WHERE rep = -1), fr AS (SELECT ob.id, any_value(ob.z) AS z, any_value(ob.lag) AS lag, any_value(stat) AS stat, (count(*) FILTER (abs(s) >= abs(stat) - 1e-12) + 1) / 20.0::DOUBLE AS p_sim FROM ls JOIN ob ON ob.id = ls.id WHERE rep >= 0 GROUP BY 1)"


def LABELLED(stat: str) -> str:
    q = "CASE WHEN q > 0.05 THEN 0 WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END"
    return with_(PTS, KNN(), CZ, PERM, PERM_STAT, LOCAL(stat), BH("p_sim", "fr", "id, z, lag, stat"), f"SELECT id, {R('stat', 'stat')}, {R('p', 'p_sim')}, {R('q', 'p_adjusted')}, {q} AS quadrant, (['NS', 'HH', 'LH', 'LL', 'HL'])[{q} + 1] AS label FROM bh")


@query(LABELLED("zp.z * lag / var"))
def lisa_perm_fdr(spark, sf_dir):
    return rounded(esda.local_permutations(zed(spark, sf_dir), knn8(spark, sf_dir), "moran", 19, 7))


@query(LABELLED("zp.z * zp.z * sw - 2 * zp.z * lag + wzz"))
def local_geary_perm(spark, sf_dir):
    return rounded(esda.local_permutations(zed(spark, sf_dir), knn8(spark, sf_dir), "geary", 19, 7))


def GLOBAL(term: str, scale: str, more: str = "", where: str = "") -> str:
    st = f"st AS (SELECT a.rep, sum({term}) * any_value({scale}) AS s FROM e JOIN sm a ON a.id = e.i JOIN sm b ON b.id = e.j AND a.rep = b.rep, mm, (SELECT sum(w) AS s0 FROM e), (SELECT avg(z) AS mean, sum(z) AS sy, sum(z * z) AS syy FROM pts) {where} GROUP BY 1)"
    c = "o AS (SELECT s AS observed FROM st WHERE rep = -1), c AS (SELECT observed, avg(s) AS mean_sim, count(*) FILTER (abs(s) >= abs(observed) - 1e-12) AS far, count(*) FILTER (s >= observed - 1e-12) AS up, count(*) FILTER (s <= observed + 1e-12) AS dn FROM st, o WHERE rep >= 0 GROUP BY 1)"
    return with_(PTS, KNN(), CZ, PERM, st, c, f"SELECT {R('observed', 'observed')}, {R('mean_sim', 'mean_sim')}, {R('(far + 1) / 20.0::DOUBLE', 'p_compat')}, {R('least(1.0, 2 * least((1 + up) / 20.0::DOUBLE, (1 + dn) / 20.0::DOUBLE))', 'p_value')} FROM c")


@query(GLOBAL("w * power(a.y - b.y, 2)", "(n - 1) / (2 * s0 * m2)"))
def geary_perm(spark, sf_dir):
    return rounded(esda.permutation_test(zed(spark, sf_dir), knn8(spark, sf_dir), "geary", 19, 7))


@query(GLOBAL("w * a.y * b.y", "1 / (sy * sy - syy)"))
def general_g_perm(spark, sf_dir):
    return rounded(esda.permutation_test(zed(spark, sf_dir), knn8(spark, sf_dir), "general_g", 19, 7))


def blacks(spark, sf_dir):
    return pts(spark, sf_dir).select("id", (F.col("z") > 0).cast("double").alias("y"))


@query(GLOBAL("CASE WHEN (CASE WHEN a.y > 0 THEN 1 ELSE 0 END) + (CASE WHEN b.y > 0 THEN 1 ELSE 0 END) = 1 THEN 1.0::DOUBLE ELSE 0 END", "1.0::DOUBLE", where="WHERE e.i < e.j"))
def join_counts_perm(spark, sf_dir):
    return rounded(esda.permutation_test(blacks(spark, sf_dir), knn8(spark, sf_dir), "BW", 19, 7))


def CONDITIONAL(table: str, term: str, reps: int, seed: int) -> str:
    """CTEs to ``cn`` (id, seen, up, dn): neighbours redrawn; ``table`` is (id, x, y), ``term`` of a.x and b.y."""
    return f"ow AS (SELECT i, j, w, row_number() OVER (PARTITION BY i ORDER BY j) AS pos FROM e), dr AS (SELECT * FROM (SELECT rep, id AS o, y, row_number() OVER (PARTITION BY rep ORDER BY md5('{seed}:' || rep || ':' || id), id) AS rank FROM {table}, (SELECT unnest(range({reps})) AS rep)) WHERE rank <= (SELECT max(pos) + 1 FROM ow)), pc AS (SELECT r.rep, ow.i, ow.w, ow.pos + CASE WHEN s.rank <= ow.pos THEN 1 ELSE 0 END AS rank FROM ow CROSS JOIN (SELECT unnest(range({reps})) AS rep) r LEFT JOIN dr s ON s.rep = r.rep AND s.o = ow.i), si AS (SELECT pc.rep, pc.i, sum(pc.w * {term}) AS s FROM pc JOIN dr b ON b.rep = pc.rep AND b.rank = pc.rank JOIN {table} a ON a.id = pc.i GROUP BY 1, 2), se AS (SELECT ow.i, sum(w * {term}) AS seen FROM ow JOIN {table} a ON a.id = ow.i JOIN {table} b ON b.id = ow.j GROUP BY 1), cn AS (SELECT se.i AS id, any_value(seen) AS seen, count(*) FILTER (s >= seen - 1e-12) AS up, count(*) FILTER (s <= seen + 1e-12) AS dn FROM si JOIN se ON se.i = si.i GROUP BY 1)"


def PSIM(reps: int) -> str:
    return f"least(1.0::DOUBLE, 2 * least((1 + up) / {reps + 1}.0::DOUBLE, (1 + dn) / {reps + 1}.0::DOUBLE))"


@query(with_(NAT, LATTICE("nat"), "tt AS (SELECT id, cases - avg(cases) OVER () AS x, cases - avg(cases) OVER () AS y FROM nat)", CONDITIONAL("tt", "a.x * b.y", 49, 3), f"SELECT tt.id, {R('seen / (SELECT avg(x * x) FROM tt)', 'Ii')}, {R(PSIM(49), 'p_sim')}, {QUAD.format('x', '(seen / x)')} FROM cn JOIN tt ON tt.id = cn.id"))
def lisa_conditional(spark, sf_dir):
    n = nat(spark, sf_dir)
    return rounded(esda.conditional_permutations(n.select("id", F.col("cases").alias("y")), weights.lattice(cells(n)), 49, 3))


@query(with_(PTS, KNN(), "tt AS (SELECT id, z AS x, z AS y FROM pts)", CONDITIONAL("tt", "power(a.x - b.y, 2)", 19, 5), f"SELECT id, {R('seen', 'Ci')}, {R(PSIM(19), 'p_sim')} FROM cn"))
def local_geary_conditional(spark, sf_dir):
    return rounded(esda.local_geary_test(zed(spark, sf_dir), knn8(spark, sf_dir), 19, 5))


GIZ = "s AS (SELECT i AS id, sum(w * z) AS wy, sum(w) AS sw, sum(w * w) AS sw2 FROM e JOIN pts ON pts.id = e.j GROUP BY 1), t AS (SELECT count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM pts), u AS (SELECT p.id, wy, sw, sw2, n, (t.s - p.z) / (n - 1) AS m, (q - p.z * p.z) / (n - 1) AS qq FROM pts p JOIN s ON s.id = p.id, t), gz AS (SELECT id, (wy - m * sw) / sqrt((qq - m * m) * ((n - 1) * sw2 - sw * sw) / (n - 2)) AS z FROM u)"


@query(with_(PTS, KNN(), "tt AS (SELECT id, 0.0::DOUBLE AS x, z AS y FROM pts)", CONDITIONAL("tt", "b.y", 99, 5), GIZ, f"gp AS (SELECT gz.id, z, {PSIM(99)} AS p_sim FROM gz JOIN cn ON cn.id = gz.id)", BH("p_sim", "gp", "id, z"), f"SELECT id, {R('z', 'z')}, {R('p', 'p_sim')}, {R('q', 'p_adjusted')}, q <= 0.05 AS reject FROM bh"))
def gi_conditional(spark, sf_dir):
    return rounded(esda.local_g_test(zed(spark, sf_dir), knn8(spark, sf_dir), permutations=99, seed=5))


BVQ = "q0 AS (SELECT bh.id, ii, p, q, CASE WHEN q > 0.05 THEN 0 WHEN zx > 0 AND lag > 0 THEN 1 WHEN zx <= 0 AND lag > 0 THEN 2 WHEN zx <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant FROM bh)"


@query(with_(PTS, KNN(), "tt AS (SELECT id, z - avg(z) OVER () AS x, v - avg(v) OVER () AS y FROM pts)", CONDITIONAL("tt", "a.x * b.y", 99, 5), "sd AS (SELECT sqrt(avg(x * x)) AS sx, sqrt(avg(y * y)) AS sy FROM tt)", f"gp AS (SELECT tt.id, x / sx AS zx, seen / x / sy AS lag, seen / sx / sy AS ii, {PSIM(99)} AS p_sim FROM tt JOIN cn ON cn.id = tt.id, sd)", BH("p_sim", "gp", "id, zx, lag, ii"), BVQ, f"SELECT id, {R('ii', 'Ii')}, {R('p', 'p_sim')}, {R('q', 'p_adjusted')}, quadrant, (['NS', 'HH', 'LH', 'LL', 'HL'])[quadrant + 1] AS label FROM q0"))
def lisa_bv_conditional(spark, sf_dir):
    return rounded(esda.local_bivariate_test(pts(spark, sf_dir).select("id", F.col("z").alias("zz"), "v"), knn8(spark, sf_dir), "zz", "v", 99, 5))


HOTZ = HOT.split(", gp AS")[0]


@query(with_(PTS, KNN(), "tt AS (SELECT id, 0.0::DOUBLE AS x, z AS y FROM pts)", CONDITIONAL("tt", "b.y", 99, 5), HOTZ, f"gp AS (SELECT gz.id, z, {PSIM(99)} AS p_sim FROM gz JOIN cn ON cn.id = gz.id)", BH("p_sim", "gp", "id, z"), f"SELECT id, {R('z', 'z')}, {R('p', 'p_sim')}, {R('q', 'p_adjusted')}, CASE WHEN q <= 0.4 THEN (CASE WHEN z > 0 THEN 'Hot spot' ELSE 'Cold spot' END) || CASE WHEN q <= 0.04 THEN ' 99%' WHEN q <= 0.2 THEN ' 95%' ELSE ' 90%' END ELSE 'Not significant' END AS label FROM bh"))
def hotspots_conditional(spark, sf_dir):
    return rounded(esda.hotspots(zed(spark, sf_dir), knn8(spark, sf_dir), alpha=0.2, inference="permutation", permutations=99, seed=5))


@query(with_(PTS, KNN(), CZ, f"{LAG}, pl AS (SELECT zz.id, z, lag FROM zz JOIN lg ON lg.id = zz.id)", f"SELECT {R('regr_slope(lag, z)', 'slope')}, {R('regr_intercept(lag, z)', 'intercept')} FROM pl"))
def moran_scatter_line(spark, sf_dir):
    return rounded(plots.moran_scatter(zed(spark, sf_dir), knn8(spark, sf_dir))[1])


# Weights.
@query(with_(PTS, BAND(0.02), "c AS (SELECT p.id, count(e.j) AS k FROM pts p LEFT JOIN e ON e.i = p.id GROUP BY 1)", f"SELECT count(*) AS n, min(k) AS min_neighbours, {R('avg(k)', 'mean_neighbours')}, max(k) AS max_neighbours, count(*) FILTER (k = 0) AS n_islands, sum(k)::BIGINT AS nnz FROM c"))
def w_summary(spark, sf_dir):
    return rounded(weights.distance_band(pts(spark, sf_dir), 0.02).summary().select("n", "min_neighbours", "mean_neighbours", "max_neighbours", F.col("n_islands").cast("long").alias("n_islands"), "nnz"))


@query(with_(PTS, KNN(), f"SELECT i AS id, len(list(j)) AS n, {R('list_sum(list(w))', 'total')}, list_sort(list(j))[1] AS first FROM e GROUP BY 1"))
def w_lists(spark, sf_dir):
    """To lists and back."""
    lists = knn8(spark, sf_dir).neighbour_lists()
    back = weights.Weights.from_lists(lists)
    return rounded(back.edges.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("j").alias("first")))


# Point patterns.
@query(QUADRAT.rsplit(" SELECT ", 1)[0] + f", ch AS (SELECT sum((n - x) * (n - x) / x) AS c, var_samp(n) / avg(n) AS d FROM g), up AS (SELECT c, d, {CHI('c', '24')} AS u FROM ch) SELECT {R('c', 'chi2')}, 24.0::DOUBLE AS df, {R('least(1.0, 2 * least(u, 1 - u))', 'p_value')}, {R('d', 'dispersion')} FROM up")
def quadrat_test(spark, sf_dir):
    return rounded(pointpattern.quadrat_test(pattern(spark, sf_dir)))


CEX = "ce AS (SELECT count(*)::DOUBLE AS n, avg(d) AS mean_nn, 0.5 * sqrt(4.0 / count(*)) + (0.0514 + 0.041 / sqrt(count(*))) * 8 / count(*) AS expected_nn, sqrt(0.070 * 4 / (count(*) * count(*)) + 0.037 * 8 * sqrt(4 / power(count(*), 5))) AS se FROM e1), cz AS (SELECT *, (mean_nn - expected_nn) / se AS z FROM ce)"


@query(with_(PTS, KNN(1, "e1"), CEX, f"SELECT {R('n', 'n')}, {R('mean_nn', 'mean_nn')}, {R('expected_nn', 'expected_nn')}, {R('mean_nn / expected_nn', chr(34) + 'R' + chr(34))}, {R('z', 'z')}, {R(P2('z'), 'p_value')} FROM cz"))
def clark_evans(spark, sf_dir):
    return rounded(pointpattern.clark_evans(pattern(spark, sf_dir)))


@query(with_(PTS, f"SELECT id, {R('least(x + 1, 1 - x, y + 1, 1 - y)', 'edge')}, x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AS inside, (x + y <= 0 AND x >= -0.5 AND y >= -0.5) AS in_triangle FROM pts"))
def window_places(spark, sf_dir):
    box, tri = frame.Window.box(-0.1, -0.1, 0.1, 0.1), frame.Window(((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5)))
    x, y = F.col("x"), F.col("y")
    return rounded(pts(spark, sf_dir).select("id", SQUARE.boundary_distance(x, y).alias("edge"), box.contains(x, y).alias("inside"), tri.contains(x, y).alias("in_triangle")))


@query(with_(PTS, f"SELECT {R('min(x)', 'x0')}, {R('min(y)', 'y0')}, {R('max(x)', 'x1')}, {R('max(y)', 'y1')}, {R('(max(x) - min(x)) * (max(y) - min(y))', 'area')}, {R('2 * (max(x) - min(x) + max(y) - min(y))', 'perimeter')} FROM pts"))
def window_around(spark, sf_dir):
    w = frame.Window.around(pts(spark, sf_dir))
    return rounded(small(spark, [(*w.bounds, w.area, w.perimeter)], "x0 double, y0 double, x1 double, y1 double, area double, perimeter double"))


@query("WITH g AS (SELECT a.i AS ix, b.i AS iy FROM (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS i) b) SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, round(-1 + (ix + 0.5::DOUBLE) * 0.2, 6) + 0.0 AS x, round(-1 + (iy + 0.5::DOUBLE) * 0.2, 6) + 0.0 AS y FROM g")
def raster_cells(spark, sf_dir):
    return rounded(frame.grid(spark, SQUARE, n_cells=10))


@query("WITH ev AS (SELECT event_id AS id, CAST(user_id % 5 AS DOUBLE) AS x, CAST(user_id // 5 AS DOUBLE) AS y FROM events) SELECT min(id) AS id, x, y, count(*) - 1 AS dropped FROM ev GROUP BY x, y")
def pattern_places(spark, sf_dir):
    """One event of each place, and how many others stand there."""
    e = views.events(spark, sf_dir).select("id", "x", "y")
    pp = frame.PointPattern.of(e)
    n = e.groupBy("x", "y").agg((F.count("*") - 1).alias("dropped"))
    return pp.deduplicated().events.select("id", "x", "y").join(n, ["x", "y"]).select("id", "x", "y", "dropped")


@query(with_(PTS, f"SELECT id, {R('CASE WHEN abs(nx) <= 1 AND abs(ny) <= 1 THEN nx ELSE x END', 'x')}, {R('CASE WHEN abs(nx) <= 1 AND abs(ny) <= 1 THEN ny ELSE y END', 'y')} FROM (SELECT *, x + 0.01 * (2 * {U('4', 'x', 'id')} - 1) AS nx, y + 0.01 * (2 * {U('4', 'y', 'id')} - 1) AS ny FROM pts)"))
def pattern_jitter(spark, sf_dir):
    return rounded(pattern(spark, sf_dir).jittered(0.01, 4).events.select("id", "x", "y"))


SIMS = f"reps AS (SELECT unnest(range(9)) AS rep), nn AS (SELECT count(*) AS n FROM pts), sp AS (SELECT rep, id, -1 + 2 * {U('0', 'x', 'rep', 'id')} AS x, -1 + 2 * {U('0', 'y', 'rep', 'id')} AS y FROM reps, (SELECT unnest(range((SELECT n FROM nn))) AS id) UNION ALL SELECT -1, id, x, y FROM pts)"
CURVES = f"pr AS (SELECT a.rep, {D} AS d FROM sp a JOIN sp b ON a.rep = b.rep AND a.id <> b.id AND abs(a.x - b.x) <= 0.2 AND abs(a.y - b.y) <= 0.2), cv AS (SELECT s.rep, rg.r, sqrt((SELECT count(*) FROM pr WHERE pr.rep = s.rep AND pr.d <= rg.r) * 4.0::DOUBLE / ((SELECT n FROM nn) * ((SELECT n FROM nn) - 1) * pi())) AS l FROM rg, (SELECT DISTINCT rep FROM sp) s), dv AS (SELECT rep, max(abs(l - r)) AS m, sum(power(l - r, 2)) AS q FROM cv GROUP BY 1), pv AS (SELECT (count(*) FILTER (d.m >= o.m) + 1) / 10.0::DOUBLE AS mad, (count(*) FILTER (d.q >= o.q) + 1) / 10.0::DOUBLE AS dclf FROM dv d, (SELECT * FROM dv WHERE rep = -1) o WHERE d.rep >= 0)"


@query(with_(PTS, RG, SIMS, CURVES, f"SELECT {R('r', 'r')}, {R('any_value(l) FILTER (rep = -1)', 'est')}, {R('quantile_cont(l, 0.025) FILTER (rep >= 0)', 'lo')}, {R('quantile_cont(l, 0.975) FILTER (rep >= 0)', 'hi')}, {R('any_value(mad)', 'mad_p')}, {R('any_value(dclf)', 'dclf_p')} FROM cv, pv GROUP BY r"))
def envelope_l(spark, sf_dir):
    return rounded(pointpattern.envelope_l(pattern(spark, sf_dir), 9, RS))


@query(f"WITH g AS (SELECT rep, id FROM (SELECT unnest(range(3)) AS rep), (SELECT unnest(range(50)) AS id)) SELECT rep::INTEGER AS rep, id, {R('-1 + 2 * ' + U('6', 'x', 'rep', 'id'), 'x')}, {R('-1 + 2 * ' + U('6', 'y', 'rep', 'id'), 'y')} FROM g")
def csr(spark, sf_dir):
    return rounded(pointpattern.csr(spark, SQUARE, 50, 3, 6))


# Interpolation.
QUADRATIC = ["x", "y", "x * x", "x * y", "y * y"]


@query(with_(PTS, TG, "src AS (SELECT 0 AS g, * FROM pts), tgt AS (SELECT 0 AS g, * FROM tg)", orthogonal("src", "g", QUADRATIC, "z"), carried("tgt", "g", QUADRATIC), f"SELECT id, {R(' + '.join(f'b{k} * q{k}' for k in range(6)), 'pred')} FROM t5 JOIN bb USING (g)"))
def trend_surface(spark, sf_dir):
    return rounded(interpolation.trend_predict(interpolation.trend_surface(pts(spark, sf_dir), 2), targets(spark)))


@query(with_(PTS, TG, "s AS (SELECT id, x, y, id % 10 AS t, z FROM pts), n AS (SELECT a.id AS i, b.id AS j, b.z, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(0.05 * (5 - b.t), 2)) AS d FROM tg a, s b), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM n)", f"SELECT -i - 1 AS id, {R('coalesce(arg_min(z, j) FILTER (d = 0), sum(z / (d * d)) FILTER (d > 0) / sum(1 / (d * d)) FILTER (d > 0))', 'pred')} FROM r WHERE r <= 12 GROUP BY i"))
def st_idw(spark, sf_dir):
    s = pts(spark, sf_dir).withColumn("t", (F.col("id") % 10).cast("double"))
    return rounded(spacetime.space_time_idw(s, targets(spark).withColumn("t", F.lit(5.0)).withColumn("id", -F.col("id") - 1), 0.05))


# Regression.
WX = "wx AS (SELECT 0 AS g, p.id, p.z, p.v, coalesce(l.wv, 0) AS wv FROM pts p LEFT JOIN (SELECT i, sum(w * v) AS wv FROM e JOIN pts ON pts.id = e.j GROUP BY 1) l ON l.i = p.id)"
SLX = "c AS (SELECT b2, b1 - b2 * c2_1 AS b1, b0 - (b1 - b2 * c2_1) * c1_0 - b2 * c2_0 AS b0, d0, d1, d2, c1_0, c2_0, c2_1, sw - 3 AS df, (swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2) / (sw - 3) AS s2 FROM bb JOIN k1 USING (g) JOIN k2 USING (g)), ro AS (SELECT 'CONSTANT' AS name, b0 AS estimate, sqrt(s2 * (1 / d0 + c1_0 * c1_0 / d1 + power(c2_0 - c2_1 * c1_0, 2) / d2)) AS se, df FROM c UNION ALL SELECT 'v', b1, sqrt(s2 * (1 / d1 + c2_1 * c2_1 / d2)), df FROM c UNION ALL SELECT 'W_v', b2, sqrt(s2 / d2), df FROM c), ts AS (SELECT *, estimate / se AS t FROM ro), pv AS (SELECT *, {} AS p FROM ts)"


def STARS(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} < 0.1 THEN '.' ELSE '' END AS stars"


@query(with_(PTS, KNN(), WX, orthogonal("wx", "g", ["v", "wv"], "z"), SLX.format(PT("t", "df")), f"SELECT name, {R('estimate', 'estimate')}, {R('se', 'se')}, {R('t', 'stat')}, {R('p', 'p_value')}, {STARS('p')} FROM pv"))
def slx(spark, sf_dir):
    f = regression.slx(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"])
    return rounded(f.frame(spark, f.n - 3))


@query(with_(PTS, "src AS (SELECT 0 AS g, * FROM pts)", orthogonal("src", "g", ["v", "x"], "z"), f"SELECT {R('1 - (swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2) / (swyy - swy * swy / sw)', 'r2')}, {R('(swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2) / (sw - 3)', 'sigma2')}, {R('-sw / 2 * (ln(2 * pi()) + ln((swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2) / sw) + 1)', 'loglik')}, {R('((b1 * b1 * d1 + b2 * b2 * d2) / 2) / ((swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2) / (sw - 3))', 'F')} FROM bb"))
def ols_summary(spark, sf_dir):
    f = regression.ols(model_frame(spark, sf_dir), "z", ["v", "x"])
    return rounded(small(spark, [(f.stats["r2"], f.sigma2, f.loglik, f.stats["F"])], "r2 double, sigma2 double, loglik double, F double"))


# Geographically weighted models.
def GSW(columns: list[str]) -> str:
    return f"src AS (SELECT e.i, e.j, e.w, p.* EXCLUDE (id) FROM e JOIN ps p ON p.id = e.j), own AS (SELECT id AS i, * EXCLUDE (id) FROM ps), {orthogonal('src', 'i', columns, 'z', 'w')}, {carried('own', 'i', columns)}"


FIT3 = "ft AS (SELECT i AS id, t.z, b0 * q0 + b1 * q1 + b2 * q2 AS fitted, (q0 * q0 / d0 + q1 * q1 / d1 + q2 * q2 / d2) AS lever, greatest(swyy - b0 * b0 * d0 - b1 * b1 * d1 - b2 * b2 * d2, 0) AS sse, sw, swyy - swy * swy / sw AS sst FROM t2 t JOIN bb USING (i))"


def GWK(k: int) -> str:
    return GWE.replace("41", str(k + 1))


@query(with_(PTS, GWK(60), "ps AS (SELECT id, z, v, x * y AS u FROM pts)", GSW(["v", "u"]), FIT3, f"SELECT id, {R('fitted', 'fitted')}, {R('z - fitted', 'residual')}, {R('lever * (SELECT w FROM e WHERE e.i = ft.id AND e.j = ft.id)', 'hat')}, {R('sse / (sw - 3)', 'sigma2')}, {R('1 - sse / sst', 'local_r2')} FROM ft"))
def gwr_multi(spark, sf_dir):
    m = pts(spark, sf_dir).withColumn("u", F.col("x") * F.col("y"))
    return rounded(gw.gwr(m, "z", ["v", "u"], 60).select("id", "fitted", "residual", "hat", "sigma2", "local_r2"))


STE = "s AS (SELECT id, x, y, id % 7 AS t FROM pts), n0 AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 0.01 * (a.t - b.t) * (a.t - b.t)) AS d FROM s a, s b), n1 AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM n0), h0 AS (SELECT i, max(d) AS h FROM n1 WHERE r <= 41 GROUP BY 1), e AS (SELECT n1.i, j, power(1 - (d / h) * (d / h), 2) AS w FROM n1 JOIN h0 ON h0.i = n1.i WHERE r <= 41 AND d < h)"


@query(with_(PTS, STE, "ps AS (SELECT id, z, v FROM pts)", GSW(["v"]), f"SELECT i AS id, {R('b0 * q0 + b1 * q1', 'fitted')}, {R('t.z - b0 * q0 - b1 * q1', 'residual')} FROM t1 t JOIN bb USING (i)"))
def gtwr(spark, sf_dir):
    m = model_frame(spark, sf_dir).withColumn("t", (F.col("id") % 7).cast("double"))
    return rounded(gw.gtwr(m, "z", ["v"], 40, 0.01).select("id", "fitted", "residual"))


COV = "m AS (SELECT e.i, sum(w) AS sw, sum(w * z) / sum(w) AS zm, sum(w * v) / sum(w) AS vm, sum(w * z * z) AS szz, sum(w * v * v) AS svv, sum(w * z * v) AS szv FROM e JOIN pts ON pts.id = e.j GROUP BY 1), cv AS (SELECT i, szz / sw - zm * zm AS a, svv / sw - vm * vm AS b, szv / sw - zm * vm AS c FROM m), ev AS (SELECT *, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c) AS l FROM cv)"


@query(with_(PTS, GWE, COV, f"SELECT i AS id, {R('l / (a + b)', 'first')}, CASE WHEN abs(c) >= abs(l - a) THEN 'z' ELSE 'v' END AS winner FROM ev"))
def gwpca(spark, sf_dir):
    return rounded(gw.gwpca(model_frame(spark, sf_dir), ["z", "v"], 40).select("id", F.col("explained")[0].alias("first"), "winner"))


@query(with_(PTS, GWE, COV, f"SELECT i AS id, {R('1 / (1 - c * c / (a * b))', 'vif_z')} FROM ev"))
def local_collinearity(spark, sf_dir):
    return rounded(gw.local_collinearity(pts(spark, sf_dir), ["z", "v"], 40).select("id", F.col("vif")[0].alias("vif_z")))


# Space and time.
GIP = "si AS (SELECT DISTINCT site AS id, site // 5 AS row, site % 5 AS col FROM ev), e AS (SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM si a JOIN si b ON greatest(abs(a.row - b.row), abs(a.col - b.col)) <= 1), sm AS (SELECT period, i AS id, sum(w * y) AS wy, sum(w) AS sw, sum(w * w) AS sw2 FROM e JOIN pn ON pn.id = e.j GROUP BY 1, 2), al AS (SELECT period, count(*) AS n, avg(y) AS m, avg(y * y) AS q FROM pn GROUP BY 1), gz AS (SELECT sm.period, id, CASE WHEN (q - m * m) * (n * sw2 - sw * sw) / (n - 1) > 0 THEN (wy - m * sw) / sqrt((q - m * m) * (n * sw2 - sw * sw) / (n - 1)) END AS z FROM sm JOIN al ON al.period = sm.period)"
PN1 = "pn AS (SELECT site AS id, day AS period, sum(value) AS y FROM ev GROUP BY 1, 2)"


@query(with_(EV, PN1, GIP, f"SELECT period, id, {R('z', 'z')} FROM gz"))
def gi_by_day(spark, sf_dir):
    return rounded(spacetime.gi_star_by_period(panel(spark, sf_dir), sites(spark, sf_dir)))


MKZ = "v AS (SELECT id, period, coalesce(z, 0) AS y FROM gz), s AS (SELECT a.id, sum(sign(b.y - a.y)) AS s FROM v a JOIN v b ON a.id = b.id AND a.period < b.period GROUP BY 1), nk AS (SELECT id, count(*)::DOUBLE AS n FROM v GROUP BY 1), k AS (SELECT nk.id, n, coalesce(s, 0)::DOUBLE AS s, n * (n - 1) * (2 * n + 5) / 18 AS var FROM nk LEFT JOIN s ON s.id = nk.id), tr AS (SELECT id, n, CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END AS trend FROM k), hs AS (SELECT id, count(*) FILTER (z > 1.96) AS n_hot, count(*) FILTER (z < -1.96) AS n_cold, count(*) FILTER (z > 1.96 AND period = (SELECT max(period) FROM gz)) AS last_hot FROM gz GROUP BY 1)"


@query(with_(EV, PN1, GIP, MKZ, f"SELECT hs.id, n_hot, last_hot::INTEGER AS last_hot, {R('trend', 'trend')}, CASE WHEN n_hot = 0 THEN 'none' WHEN last_hot = 1 AND n_hot = 1 THEN 'new' WHEN last_hot = 1 AND n_cold > 0 THEN 'oscillating' WHEN n_hot / n >= 0.9 AND trend > 1.96 THEN 'intensifying' WHEN n_hot / n >= 0.9 AND trend < -1.96 THEN 'diminishing' WHEN n_hot / n >= 0.9 THEN 'persistent' ELSE 'sporadic' END AS category FROM hs JOIN tr ON tr.id = hs.id"))
def emerging_hotspots(spark, sf_dir):
    out = spacetime.emerging_hotspots(spacetime.gi_star_by_period(panel(spark, sf_dir), sites(spark, sf_dir)))
    return rounded(out.select("id", F.coalesce("n_hot", F.lit(0)).alias("n_hot"), F.coalesce("last_hot", F.lit(0)).alias("last_hot"), "trend", "category"))


# Kriging with two neighbours, whose system has a closed form.
SPH_TWO = (0.001, 0.015, 0.2)
GAM = "(CASE WHEN {0} = 0 THEN 0 ELSE 0.001 + 0.015 * (1.5 * least({0} / 0.2, 1) - 0.5 * power(least({0} / 0.2, 1), 3)) END)"
TWO = f"tn AS (SELECT a.id AS i, b.id AS j, b.x, b.y, b.z, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM tg a, pts b), tw AS (SELECT p.i, p.z AS z1, q.z AS z2, {GAM.format('p.d')} AS g1, {GAM.format('q.d')} AS g2, {GAM.format('sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))')} AS g12 FROM tn p JOIN tn q ON p.i = q.i AND p.r = 1 AND q.r = 2), lw AS (SELECT *, 0.5 + (g2 - g1) / (2 * g12) AS l FROM tw)"


@query(with_(PTS, TG, TWO, f"SELECT i AS id, {R('l * z1 + (1 - l) * z2', 'pred')}, {R('sqrt(greatest(0, l * g1 + (1 - l) * g2 + g1 - (1 - l) * g12))', 'std')} FROM lw"))
def ordinary_kriging_pair(spark, sf_dir):
    return rounded(kriging.ordinary(pts(spark, sf_dir), targets(spark), SPH_TWO, 2))


SK = "sk AS (SELECT i, z1, z2, 0.016 - g1 AS c1, 0.016 - g2 AS c2, 0.016 - g12 AS c, 0.016::DOUBLE AS s FROM tw), sw AS (SELECT *, (c1 * s - c2 * c) / (s * s - c * c) AS l1, (c2 * s - c1 * c) / (s * s - c * c) AS l2 FROM sk)"


@query(with_(PTS, TG, TWO.rsplit(", lw AS", 1)[0], SK, f"SELECT i AS id, {R('0.1 + l1 * (z1 - 0.1) + l2 * (z2 - 0.1)', 'pred')}, {R('sqrt(greatest(0, s - l1 * c1 - l2 * c2))', 'std')} FROM sw"))
def simple_kriging_pair(spark, sf_dir):
    return rounded(kriging.simple(pts(spark, sf_dir), targets(spark), SPH_TWO, 0.1, 2))


# Samples.
HB = "RECURSIVE pts AS ({0}), bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), hb(id, k, x, y, d) AS (SELECT id, 15, floor((x - x0) / (x1 - x0) * 65535)::BIGINT, floor((y - y0) / (y1 - y0) * 65535)::BIGINT, 0::BIGINT FROM pts, bx UNION ALL SELECT id, k - 1, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN 65535 - y ELSE y END) ELSE x END, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN 65535 - x ELSE x END) ELSE y END, d + (1::BIGINT << (2 * k)) * xor(3 * rx, ry) FROM (SELECT *, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry FROM hb WHERE k >= 0))"


@query("WITH " + HB.format("SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey // 50 AS DOUBLE) AS y FROM customer") + f", o AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos, count(*) OVER () AS n FROM hb WHERE k = -1) SELECT id, pos::INTEGER AS pos FROM o, (SELECT {U('5', 'start', chr(39) + '0' + chr(39))} AS u) WHERE ceil((pos + 1) * (100.0::DOUBLE / n) - u) - ceil(pos * (100.0::DOUBLE / n) - u) > 0")
def systematic_hilbert(spark, sf_dir):
    return sampling.systematic(cust(spark, sf_dir), 100, "hilbert", 5).select("id", F.col("pos").cast("int").alias("pos"))


GR = f"cust AS (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey // 50 AS DOUBLE) AS y, count(*) OVER () AS n FROM customer), bx AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS w FROM cust), ad(id, n, lv, ux, uy, pa, address) AS (SELECT id, n, 0, least(floor((x - x0) / w * 4096), 4095)::BIGINT, least(floor((y - y0) / w * 4096), 4095)::BIGINT, '', '' FROM cust, bx UNION ALL SELECT id, n, lv + 1, ux, uy, pa || dg, address || md5('5:' || lv || ':' || pa || ':' || dg)[1:4] FROM (SELECT *, ((ux >> (11 - lv)) & 1)::VARCHAR || ((uy >> (11 - lv)) & 1)::VARCHAR AS dg FROM ad WHERE lv < 12)), cm AS (SELECT id, 50.0::DOUBLE / n AS pi, row_number() OVER (ORDER BY address, md5('5:' || id), id) * (50.0::DOUBLE / n) AS cum FROM ad WHERE lv = 12), st AS (SELECT {U('5', 'start', chr(39) + '0' + chr(39))} AS u)"


@query(f"WITH RECURSIVE {GR} SELECT id, {R('pi', 'pi')} FROM cm, st WHERE floor(cum - u + 1e-9) - floor(cum - pi - u + 1e-9) > 0")
def grts(spark, sf_dir):
    return rounded(sampling.grts(cust(spark, sf_dir), 50, seed=5).select("id", "pi"))


@query("WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), f(k, id, taken) AS (SELECT 1, id, [id] FROM (SELECT id FROM p ORDER BY md5('5:' || id), id LIMIT 1) UNION ALL SELECT k + 1, nxt, list_append(taken, nxt) FROM (SELECT k, taken, (SELECT a.id FROM p a JOIN p b ON list_contains(f.taken, b.id) GROUP BY a.id ORDER BY min(power(a.x - b.x, 2) + power(a.y - b.y, 2)) DESC, a.id LIMIT 1) AS nxt FROM f WHERE k < 8)) SELECT p.id, x, y FROM p WHERE id IN (SELECT id FROM f)")
def space_filling(spark, sf_dir):
    return sampling.space_filling(pts(spark, sf_dir).select("id", "x", "y"), 8, 5)


@query(with_(CUST, "h AS (SELECT stratum, count(*) AS n, stddev_samp(z) AS s FROM cust GROUP BY 1), sh AS (SELECT stratum, 97 * n * s / sum(n * s) OVER () AS share FROM h), w AS (SELECT stratum, floor(share) AS k, row_number() OVER (ORDER BY floor(share) - share, stratum) AS r, 97 - sum(floor(share)) OVER () AS rest FROM sh)", "SELECT stratum, (k + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS n FROM w"))
def neyman_allocation(spark, sf_dir):
    h = cust(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.stddev_samp("z").alias("s")).collect()
    part = sampling.neyman({r.stratum: r.n for r in h}, {r.stratum: r.s for r in h}, 97)
    return spark.createDataFrame(list(part.items()), "stratum string, n long")


@query("WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey <= 3 THEN 20000.0::DOUBLE ELSE p_retailprice / 10 END AS size FROM part), one AS (SELECT id, size, size * 40 / sum(size) OVER () >= 1 AS sure FROM p), two AS (SELECT id, size, (40 - count(*) FILTER (sure) OVER ()) / sum(CASE WHEN sure THEN 0 ELSE size END) OVER () AS rate, sure FROM one) SELECT id, round(CASE WHEN sure THEN 1 ELSE size * rate END, 6) + 0.0 AS pi FROM two")
def inclusion(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") <= 3, 20000.0).otherwise(F.col("p_retailprice") / 10).alias("size"))
    return rounded(sampling.inclusion_probabilities(p, "size", 40).select("id", "pi"))


DRAWN = "s AS (SELECT id, x, y, z, 30.0::DOUBLE / (SELECT count(*) FROM pts) AS pi FROM pts ORDER BY md5('5:' || id), id LIMIT 30), t AS (SELECT count(*)::DOUBLE AS n, sum(1 / pi) AS nn, sum(z / pi) AS sy, var_samp(z) AS s2 FROM s)"
LO_HI = f"{R('sy / nn - 1.959963984540054 * se', 'lo')}, {R('sy / nn + 1.959963984540054 * se', 'hi')}"


def drawn(spark, sf_dir):
    return sampling.simple_random(pts(spark, sf_dir).select("id", "x", "y", "z"), 30, 5)


@query(with_(PTS, DRAWN, "v AS (SELECT *, sqrt((1 - n / nn) * s2 / n) AS se FROM t)", f"SELECT {R('n', 'n')}, {R('sy / nn', 'mean')}, {R('sy', 'total')}, {R('se', 'se')}, {LO_HI} FROM v"))
def estimate_mean_srs(spark, sf_dir):
    return rounded(sampling.estimate_mean(drawn(spark, sf_dir), "z"))


@query(with_(PTS, DRAWN, f"zz AS (SELECT s.*, (z - sy / nn) / pi / nn AS r FROM s, t), nr AS (SELECT i, r FROM (SELECT a.id AS i, b.r, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS k FROM zz a JOIN zz b ON a.id <> b.id) WHERE k <= 3 UNION ALL SELECT id, r FROM zz), m AS (SELECT i, avg(r) AS m FROM nr GROUP BY 1), v AS (SELECT *, sqrt((SELECT sum((1 - pi) * 4 / 3.0::DOUBLE * power(r - m, 2)) FROM zz JOIN m ON m.i = zz.id)) AS se FROM t)", f"SELECT {R('n', 'n')}, {R('sy / nn', 'mean')}, {R('sy', 'total')}, {R('se', 'se')}, {LO_HI} FROM v"))
def estimate_mean_local(spark, sf_dir):
    return rounded(sampling.estimate_mean(drawn(spark, sf_dir), "z", "local"))


@query(with_(CUST, "k AS (SELECT cluster FROM (SELECT DISTINCT cluster FROM cust) ORDER BY md5('5:cluster:' || cluster), cluster LIMIT 5), s AS (SELECT id, cluster, z, 5.0::DOUBLE / (SELECT count(DISTINCT cluster) FROM cust) * least(5, nn) / nn AS pi FROM (SELECT id, cluster, z, count(*) OVER (PARTITION BY cluster) AS nn, row_number() OVER (PARTITION BY cluster ORDER BY md5('5:' || id), id) AS r FROM cust WHERE cluster IN (SELECT cluster FROM k)) WHERE r <= 5), t AS (SELECT count(*)::DOUBLE AS n, sum(1 / pi) AS nn, sum(z / pi) AS sy FROM s), g AS (SELECT cluster, sum((z - sy / nn) / pi) AS r FROM s, t GROUP BY 1), v AS (SELECT *, sqrt((SELECT count(*) * var_samp(r) FROM g)) / nn AS se FROM t)", f"SELECT {R('n', 'n')}, {R('sy / nn', 'mean')}, {R('sy', 'total')}, {R('se', 'se')}, {LO_HI} FROM v"))
def estimate_mean_cluster(spark, sf_dir):
    return rounded(sampling.estimate_mean(sampling.two_stage(cust(spark, sf_dir), "cluster", 5, 5, 5), "z", "cluster", cluster="cluster"))


def DESIGN(n: int) -> str:
    return f"(SELECT avg(m) - any_value(tr) AS bias, sqrt(avg(power(m - tr, 2))) AS rmse, avg(CASE WHEN abs(m - tr) <= 1.959963984540054 * sqrt((1 - {n} / total) * s2 / {n}) THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM (SELECT rep, avg(z) AS m, var_samp(z) AS s2 FROM (SELECT rep, z, row_number() OVER (PARTITION BY rep ORDER BY md5('2:' || rep || ':' || id), id) AS r FROM pts, (SELECT unnest(range(20)) AS rep)) WHERE r <= {n} GROUP BY 1), (SELECT avg(z) AS tr, count(*)::DOUBLE AS total FROM pts))"


@query(with_(PTS, f"d AS (SELECT 'few' AS design, 10 AS n, * FROM {DESIGN(10)} UNION ALL SELECT 'more', 40, * FROM {DESIGN(40)})", f"SELECT design, n, {R('bias', 'bias')}, {R('rmse', 'rmse')}, {R('coverage', 'coverage')}, {R('power(rmse / (SELECT rmse FROM d WHERE n = 10), 2)', 'deff')} FROM d"))
def compare_designs(spark, sf_dir):
    return rounded(sampling.compare_designs(pts(spark, sf_dir), "z", {"few": 10, "more": 40}, 20, 2))


@query(f"SELECT {R('2.5 / 2.0::DOUBLE', 'deff')}, {R('100 * 0.7 / 1.3::DOUBLE', 'ar1')}, {R('100 / (1 + 99 * 0.3::DOUBLE)', 'equicorrelated')}, ceil(power(1.959963984540054 * 10 / 1.5, 2) * 2 / (1 + power(1.959963984540054 * 10 / 1.5, 2) * 2 / 500))::DOUBLE AS size")
def design_numbers(spark, sf_dir):
    return rounded(small(spark, [(sampling.design_effect(2.5, 2.0), sampling.effective_size(100, 0.3), sampling.effective_size(100, 0.3, "equicorrelated"), sampling.sample_size_mean(10, 1.5, 500, deff=2.0))], "deff double, ar1 double, equicorrelated double, size double"))


# Rates.
POIS = "list_sum(list_transform(range(0, {0}), lambda k: exp(-{1} + k * ln({1}) - lgamma(k + 1))))"


@query("WITH RECURSIVE " + ", ".join([NAT, AR, f"b(id, o, e, k, l0, l1, h0, h1) AS (SELECT id, o, e, 0, 1e-9::DOUBLE, o + 1e-9, o::DOUBLE, 2 * o + 40.0::DOUBLE FROM ar UNION ALL SELECT id, o, e, k + 1, CASE WHEN lt < 0.025 THEN lm ELSE l0 END, CASE WHEN lt < 0.025 THEN l1 ELSE lm END, CASE WHEN ht > 0.025 THEN hm ELSE h0 END, CASE WHEN ht > 0.025 THEN h1 ELSE hm END FROM (SELECT *, (l0 + l1) / 2 AS lm, (h0 + h1) / 2 AS hm, 1 - coalesce({POIS.format('o::BIGINT', '((l0 + l1) / 2)')}, 0) AS lt, {POIS.format('(o + 1)::BIGINT', '((h0 + h1) / 2)')} AS ht FROM b WHERE k < 60))"]) + f" SELECT id, {R('o / e', 'smr')}, {R('CASE WHEN o > 0 THEN (l0 + l1) / 2 / e ELSE 0 END', 'lo')}, {R('(h0 + h1) / 2 / e', 'hi')} FROM b WHERE k = 60")
def garwood(spark, sf_dir):
    return rounded(rates.garwood(areas(spark, sf_dir)))


@query(with_(NAT, AR, f"SELECT id, {R('CASE WHEN o > 0 THEN greatest(0.0::DOUBLE, 1 - ' + POIS.format('o::BIGINT', 'e') + ') ELSE 1 END', 'p_value')} FROM ar"))
def excess_p(spark, sf_dir):
    return rounded(rates.excess_p(areas(spark, sf_dir)))


@query(with_(NAT, AR, "g AS (SELECT e, unnest(range(0, ceil(e + 40 * sqrt(e + 1) + 40)::BIGINT)) AS k FROM (SELECT DISTINCT e FROM ar)), c AS (SELECT e, k, sum(exp(-e + k * ln(e) - lgamma(k + 1))) OVER (PARTITION BY e ORDER BY k) AS p FROM g), l AS (SELECT unnest([0.95, 0.998])::DOUBLE AS level), f AS (SELECT e, level, min(k) FILTER (p >= (1 - level) / 2) / e AS lo, min(k) FILTER (p >= (1 + level) / 2) / e AS hi FROM c, l GROUP BY 1, 2)", f"SELECT {R('f.e', chr(34) + 'E' + chr(34))}, level, {R('lo', 'lo')}, {R('hi', 'hi')} FROM f JOIN ar ON ar.e = f.e"))
def funnel(spark, sf_dir):
    return rounded(rates.funnel(areas(spark, sf_dir)))


def estimated(spark, sf_dir):
    n = nat(spark, sf_dir)
    return n.select("id", (F.col("pop") / 60).alias("truth"), (F.col("cases") / 600).alias("estimate"), (F.col("cases") / F.col("pop") / 10).alias("raw"), F.col("pop").alias("E"))


ESTD = "es AS (SELECT id, pop / 60 AS truth, cases / 600 AS estimate, cases / pop / 10 AS raw, pop AS e FROM nat), rk AS (SELECT *, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY estimate) + (count(*) OVER (PARTITION BY estimate) - 1) / 2.0::DOUBLE AS b FROM es)"


@query(with_(NAT, ESTD, f"SELECT {R('sqrt(avg(power(estimate - truth, 2)))', 'rmse')}, {R('avg(abs(estimate - truth))', 'mae')}, {R('avg(estimate - truth)', 'bias')}, {R('sqrt(sum(e * power(estimate - truth, 2)) / sum(e))', 'weighted_rmse')}, {R('corr(a, b)', 'spearman')} FROM rk"))
def smoothing_errors(spark, sf_dir):
    return rounded(rates.evaluate(estimated(spark, sf_dir)))


@query(with_(NAT, ESTD, f"SELECT id, {R('estimate - raw', 'change')}, {R('(raw - estimate) / nullif(raw - avg(raw) OVER (), 0)', 'share')} FROM es"))
def smoothing_shrinkage(spark, sf_dir):
    return rounded(rates.shrinkage(estimated(spark, sf_dir)))


@query(with_(NAT, AR, f"x AS (SELECT id, o / e AS x, o / (e * e) AS v FROM ar), m AS (SELECT avg(x) AS m, avg(v) AS v, count(*) AS k FROM x), c AS (SELECT any_value(m.m) AS m, greatest(0, 1 - (any_value(k) - 3) * any_value(m.v) / sum(power(x - m.m, 2))) AS c FROM x, m)", f"SELECT id, {R('x', 'raw')}, {R('m + c * (x - m)', 'estimate')}, {R('1 - c', 'shrinkage')} FROM x, c"))
def james_stein(spark, sf_dir):
    a = areas(spark, sf_dir).select("id", (F.col("O") / F.col("E")).alias("est"), (F.col("O") / (F.col("E") * F.col("E"))).alias("var"))
    return rounded(rates.james_stein(a, "james-stein"))


# Chains: the points as draws of four chains.
CH = "ch AS (SELECT 0 AS id, vec_id % 4 AS chain, vec_id // 4 AS draw, CAST(embedding[3] AS DOUBLE) AS theta FROM embeddings)"


def chains(spark, sf_dir):
    return pts(spark, sf_dir).select(F.lit(0).cast("long").alias("id"), (F.col("id") % 4).cast("int").alias("chain"), F.floor(F.col("id") / 4).alias("draw"), F.col("z").alias("theta"))


@query(with_(CH, "h AS (SELECT id, chain, draw >= (SELECT (max(draw) + 1) // 2 FROM ch) AS half, theta FROM ch), e AS (SELECT id, avg(theta) AS m, var_samp(theta) AS s2, count(*) AS n FROM h GROUP BY id, chain, half)", f"SELECT id, {R('sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(s2))', 'rhat')} FROM e GROUP BY id"))
def rhat(spark, sf_dir):
    return rounded(bayes.rhat(chains(spark, sf_dir))).select(F.col("id").cast("int").alias("id"), "rhat")


@query(with_(CH, f"SELECT id, {R('avg(theta)', 'mean')}, {R('stddev_samp(theta)', 'sd')}, {R('quantile_cont(theta, 0.025)', 'lo')}, {R('quantile_cont(theta, 0.5)', 'median')}, {R('quantile_cont(theta, 0.975)', 'hi')}, {R('avg(CASE WHEN theta > 0.05 THEN 1.0::DOUBLE ELSE 0 END)', 'exceedance')} FROM ch GROUP BY id"))
def posterior_summary(spark, sf_dir):
    return rounded(bayes.summary(chains(spark, sf_dir), threshold=0.05)).withColumn("id", F.col("id").cast("int"))


# Regions and flags.
@query(with_(NAT, "z AS (SELECT row, (pop - avg(pop) OVER ()) / stddev_pop(pop) OVER () AS a, (cases - avg(cases) OVER ()) / stddev_pop(cases) OVER () AS b FROM nat), g AS (SELECT sum(a * a) - sum(a) * sum(a) / count(*) + sum(b * b) - sum(b) * sum(b) / count(*) AS w, sum(a * a + b * b) AS t FROM z GROUP BY row)", f"SELECT {R('sum(w)', 'ssw')}, {R('sum(t)', 'sst')}, {R('1 - sum(w) / sum(t)', 'r2')} FROM g"))
def region_fit(spark, sf_dir):
    n = nat(spark, sf_dir)
    return rounded(cluster.evaluate_regions(n, ["pop", "cases"], n.select("id", F.col("row").alias("region"))))


@query("WITH RECURSIVE " + ", ".join([NAT, LATTICE("nat", True), "lb AS (SELECT id, CASE WHEN col = 4 THEN 0 ELSE col END AS region FROM nat), ed AS (SELECT i, j FROM e JOIN lb a ON a.id = i JOIN lb b ON b.id = j AND a.region = b.region), reach(id, n) AS (SELECT id, id FROM lb UNION SELECT r.id, ed.j FROM reach r JOIN ed ON ed.i = r.n), cp AS (SELECT id, min(n) AS c FROM reach GROUP BY 1)"]) + " SELECT region, count(DISTINCT c) = 1 AS contiguous FROM lb JOIN cp ON cp.id = lb.id GROUP BY 1")
def region_contiguity(spark, sf_dir):
    n = nat(spark, sf_dir)
    return cluster.is_contiguous(n.select("id", F.when(F.col("col") == 4, 0).otherwise(F.col("col")).alias("region")), weights.lattice(cells(n), rook=True))


MASKS = {"big": "p_size > 25", "dear": "p_retailprice > 1400", "odd": "p_partkey % 2 = 1"}


@query("WITH m AS (SELECT " + ", ".join(f"{c} AS {n}" for n, c in MASKS.items()) + " FROM part) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'count(*) FILTER ({a} AND {b}) / count(*) FILTER ({a} OR {b})', 'jaccard')} FROM m" for a in MASKS for b in MASKS))
def agreement_matrix(spark, sf_dir):
    m = views.table(spark, sf_dir, "part").select(*(F.expr(c).alias(n) for n, c in MASKS.items()))
    return rounded(cluster.agreement_matrix(m, list(MASKS)))


@query(with_(EV, f"SELECT site AS id, {R('avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END)', 'stability')} FROM ev GROUP BY 1"))
def flag_stability(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("site").alias("id"), F.col("day").alias("run"), (F.col("value") > 50).alias("flag"))
    return rounded(cluster.flag_stability(e))


# Tests by permutation.
BVP = "bb AS (SELECT id, z - avg(z) OVER () AS zx, v - avg(v) OVER () AS zy FROM pts), reps AS (SELECT unnest(range(0, 19)) AS rep), pl AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY id) AS at FROM bb, reps), dr AS (SELECT rep, zy, row_number() OVER (PARTITION BY rep ORDER BY md5('7:' || rep || ':' || id), id) AS at FROM bb, reps), sm AS (SELECT pl.rep, id, zy FROM pl JOIN dr ON pl.rep = dr.rep AND pl.at = dr.at UNION ALL SELECT -1, id, zy FROM bb), st AS (SELECT b.rep, sum(w * a.zx * b.zy) * (SELECT count(*) / sum(zx * zx) FROM bb) / (SELECT sum(w) FROM e) AS s FROM e JOIN bb a ON a.id = e.i JOIN sm b ON b.id = e.j GROUP BY 1), o AS (SELECT s AS observed FROM st WHERE rep = -1), c AS (SELECT observed, count(*) FILTER (s >= observed - 1e-12) AS up, count(*) FILTER (s <= observed + 1e-12) AS dn FROM st, o WHERE rep >= 0 GROUP BY 1)"


@query(with_(PTS, KNN(), BVP, f"SELECT {R('observed', 'observed')}, {R('least(1.0, 2 * least((1 + up) / 20.0::DOUBLE, (1 + dn) / 20.0::DOUBLE))', 'p_value')} FROM c"))
def moran_bv_perm(spark, sf_dir):
    return rounded(esda.moran_bivariate_test(pts(spark, sf_dir).select("id", F.col("z").alias("zz"), "v"), knn8(spark, sf_dir), "zz", "v", 19, 7))


@query(with_(PTS, f"p AS (SELECT id, x, y, id % 30 AS t FROM pts), nr AS (SELECT a.id AS i, b.id AS j, a.t AS ti, b.t AS tj FROM p a JOIN p b ON a.id < b.id AND {D} <= 0.05), reps AS (SELECT unnest(range(0, 19)) AS rep), pl AS (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY id) AS at FROM p, reps), dr AS (SELECT rep, t, row_number() OVER (PARTITION BY rep ORDER BY md5('7:' || rep || ':' || id), id) AS at FROM p, reps), sm AS (SELECT pl.rep, id, t FROM pl JOIN dr ON pl.rep = dr.rep AND pl.at = dr.at), sc AS (SELECT a.rep, count(*) FILTER (abs(a.t - b.t) <= 2) AS s FROM nr JOIN sm a ON a.id = nr.i JOIN sm b ON b.id = nr.j AND a.rep = b.rep GROUP BY 1), o AS (SELECT count(*) AS close_space, count(*) FILTER (abs(ti - tj) <= 2) AS close_both FROM nr)", f"SELECT close_space, close_both, {R('((SELECT count(*) FROM sc WHERE s >= close_both) + 1) / 20.0::DOUBLE', 'p_value')} FROM o"))
def knox_perm(spark, sf_dir):
    return rounded(spacetime.knox(pts(spark, sf_dir).select("id", "x", "y", (F.col("id") % 30).cast("double").alias("t")), 0.05, 2.0, 19, 7))


# Bandwidths of densities and of local models.
@query(with_(PTS, f"SELECT {R('(stddev_samp(x) + stddev_samp(y)) / 2 * power(count(*), -1.0 / 6)', 'h')} FROM pts"))
def bandwidth_scott(spark, sf_dir):
    return rounded(pointpattern.bandwidth_scott(pattern(spark, sf_dir)))


@query(with_(PTS, BAND(0.8), "hs AS (SELECT unnest([0.1, 0.2])::DOUBLE AS h), s AS (SELECT h, i, sum(exp(-d * d / (2 * h * h))) AS s FROM e, hs WHERE d <= 4 * h GROUP BY 1, 2)", f"SELECT hs.h, {R('sum(ln(greatest(coalesce(s, 0) / (2 * pi() * hs.h * hs.h * ((SELECT count(*) FROM pts) - 1)), 1e-300)))', 'score')} FROM hs CROSS JOIN pts LEFT JOIN s ON s.h = hs.h AND s.i = pts.id GROUP BY 1"))
def bandwidth_cv(spark, sf_dir):
    return rounded(pointpattern.bandwidth_cv(pattern(spark, sf_dir), [0.1, 0.2]))


GWB2 = GWB.replace("sum(hat) AS k,", "sum(hat) AS k, avg(power(e / (1 - hat), 2)) AS cv,")


@query(with_(PTS, GWB2, f"SELECT bandwidth, {R('n * ln(rss / n) + 2 * k', 'aic')}, {R('n * ln(rss / n) + k * ln(n)', 'bic')}, {R('cv', 'cv')} FROM g"))
def gwr_criteria(spark, sf_dir):
    fits = gw.gwr_fits(model_frame(spark, sf_dir), "z", "v", [30, 60, 90])
    return rounded(fits.select("bandwidth", *(gw.fit_score(name).alias(name.lower()) for name in ("AIC", "BIC", "CV"))))


GWT = "ft AS (SELECT i AS id, b0 * q0 + b1 * q1 AS fitted, t.z, b1, q0, q1, d0, d1, c1_0, b0, greatest(swyy - b0 * b0 * d0 - b1 * b1 * d1, 0) / (sw - 2) AS s2 FROM t1 t JOIN bb USING (i) JOIN k1 USING (i)), tr AS (SELECT sum((q0 * q0 / d0 + q1 * q1 / d1) * w) AS k FROM ft JOIN e ON e.i = ft.id AND e.j = ft.id), lt AS (SELECT id, 0 AS coefficient, (b0 - b1 * c1_0) / sqrt(s2 * (1 / d0 + c1_0 * c1_0 / d1)) AS t FROM ft UNION ALL SELECT id, 1, b1 / sqrt(s2 / d1) FROM ft), ld AS (SELECT lt.*, (SELECT count(*) FROM pts) - k AS df FROM lt, tr), pv AS (SELECT id, coefficient, t, " + PT("t", "df") + " AS p FROM ld), raw AS (SELECT *, p * count(*) OVER (PARTITION BY coefficient) / row_number() OVER (PARTITION BY coefficient ORDER BY p, id) AS raw FROM pv), bh AS (SELECT *, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY coefficient ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM raw)"


@query(with_(PTS, GWE, "ps AS (SELECT id, z, v FROM pts)", GSW(["v"]), GWT, f"SELECT id, coefficient, {R('t', 't')}, {R('p', 'p_value')}, {R('q', 'p_adjusted')}, q <= 0.05 AS reject FROM bh"))
def gwr_significance(spark, sf_dir):
    f = gw.gwr(model_frame(spark, sf_dir), "z", ["v"], 40)
    return rounded(gw.significance(f, f.count()))


@query(with_(PTS, TG, GWE, "ps AS (SELECT id, z, v FROM pts)", GSW(["v"]), f"bs AS (SELECT i AS id, b0 - b1 * c1_0 AS b0, b1 FROM bb JOIN k1 USING (i)), tn AS (SELECT a.id AS i, b.id AS j, a.x AS v, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM tg a, pts b)", f"SELECT i AS id, {R('b0 + b1 * tn.v', 'pred')} FROM tn JOIN bs ON bs.id = tn.j WHERE r = 1"))
def gwr_predict(spark, sf_dir):
    m = model_frame(spark, sf_dir)
    return rounded(gw.predict(gw.gwr(m, "z", ["v"], 40), m, targets(spark).withColumn("v", F.col("x")), ["v"]))


# Simulated tables.
def SIMULATED(n: int, seed: int, size: float, features: dict, target: str, base: float, waves: dict) -> str:
    named = "".join(f", {m}::DOUBLE + {s}::DOUBLE * {NORMAL(str(seed), f, 'id')} AS {f}" for f, (m, s) in features.items())
    wave = "".join(f" + {c} * (1 + 0.5 * sin({'x' if k % 2 else 'y'} * pi() / {size})) * ({f} - {features[f][0]}) / {features[f][1]}::DOUBLE" for k, (f, c) in enumerate(waves.items()))
    columns = ", ".join(R(c, c) for c in ("x", "y", *features, target))
    return f"WITH b AS (SELECT id, {size}::DOUBLE * {U(str(seed), 'x', 'id')} AS x, {size}::DOUBLE * {U(str(seed), 'y', 'id')} AS y{named} FROM (SELECT unnest(range({n})) AS id)), t AS (SELECT *, {base}::DOUBLE{wave} + {0.1 * abs(base)} * {NORMAL(str(seed), target, 'id')} AS {target} FROM b) SELECT id, {columns} FROM t"


@query(SIMULATED(159, 42, 300.0, {"PctRural": (70, 25), "PctBach": (11, 5), "PctEld": (12, 3), "PctFB": (1.1, 1), "PctPov": (19, 7), "PctBlack": (27, 17)}, "TotPop90", 41.0, {"PctBach": 9, "PctRural": -6, "PctFB": 5, "PctPov": -3, "PctEld": -2, "PctBlack": 1}))
def georgia(spark, sf_dir):
    return rounded(datasets.georgia(spark))


@query(SIMULATED(300, 44, 150.0, {"AOD": (0.6, 0.25), "DEM": (200, 120), "Wind": (2.5, 0.9), "Temperature": (13, 6), "Humidity": (55, 15)}, "PM25", 75.0, {"AOD": 22, "DEM": -9, "Wind": -8, "Humidity": 6, "Temperature": -3}))
def beijing_pm25(spark, sf_dir):
    return rounded(datasets.beijing_pm25(spark))


@query(f"WITH b AS (SELECT id, (id // 8)::INTEGER AS row, (id % 8)::INTEGER AS col, sin((id // 8) * 2 * pi() / 8) + cos((id % 8) * 2 * pi() / 8) + 0.2 * {NORMAL('0', 'z', 'id')} AS z FROM (SELECT unnest(range(64)) AS id)) SELECT id, row, col, col + 0.5::DOUBLE AS x, row + 0.5::DOUBLE AS y, {R('z', 'z')}, (z > (SELECT median(z) FROM b))::INTEGER AS binary FROM b")
def lattice_table(spark, sf_dir):
    return rounded(datasets.lattice(spark))


@query(f"SELECT id, {R(U('1', 'x', 'id'), 'x')}, {R(U('1', 'y', 'id'), 'y')} FROM (SELECT unnest(range(100)) AS id)")
def csr_table(spark, sf_dir):
    return rounded(datasets.csr_points(spark))


# Graphs of points in no lattice, zones as rings, simulated quadrats, densities by period, searches of bandwidths.
THIRD_PTS = "SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM pts a JOIN pts b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.id <> a.id AND c.id <> b.id AND {})"


@query(with_(PTS, THIRD_PTS.format("power(c.x - (a.x + b.x) / 2, 2) + power(c.y - (a.y + b.y) / 2, 2) < power(" + D + " / 2, 2) - 1e-12")))
def w_gabriel_points(spark, sf_dir):
    return weights.gabriel(pts(spark, sf_dir), transform=None).edges


@query(with_(PTS, THIRD_PTS.format("greatest(sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2)), sqrt(power(b.x - c.x, 2) + power(b.y - c.y, 2))) < " + D + " - 1e-12")))
def w_rng_points(spark, sf_dir):
    return weights.relative_neighbourhood(pts(spark, sf_dir), transform=None).edges


def rings(df):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


@query(SQL["areal_weighting"])
def areal_weighting_rings(spark, sf_dir):
    s, t = rings(squares(spark, sf_dir)).select("id", "ring", "pop", "rate"), rings(zones(spark)).select("id", "ring")
    return rounded(interpolation.areal_weighting_polygons(s, t, ("pop",), ("rate",)))


QMC = f"nn AS (SELECT count(*) AS n FROM pts), sp AS (SELECT rep, -1 + 2 * {U('0', 'x', 'rep', 'id')} AS x, -1 + 2 * {U('0', 'y', 'rep', 'id')} AS y FROM (SELECT unnest(range(19)) AS rep), (SELECT unnest(range((SELECT n FROM nn))) AS id) UNION ALL SELECT -1, x, y FROM pts), ct AS (SELECT rep, greatest(0, least(floor((x + 1) / 0.4), 4)) AS cx, greatest(0, least(floor((y + 1) / 0.4), 4)) AS cy, count(*) AS n FROM sp GROUP BY 1, 2, 3), st AS (SELECT rep, sum(power(n - e, 2) / e) + (25 - count(*)) * any_value(e) AS s FROM ct, (SELECT n / 25.0::DOUBLE AS e FROM nn) GROUP BY 1)"


@query(with_(PTS, QMC, f"SELECT {R('o.s', 'chi2')}, {R('((SELECT count(*) FROM st WHERE rep >= 0 AND st.s >= o.s - 1e-9) + 1) / 20.0::DOUBLE', 'p_value')} FROM (SELECT s FROM st WHERE rep = -1) o"))
def quadrat_permutations(spark, sf_dir):
    return rounded(pointpattern.quadrat_test_mc(pattern(spark, sf_dir), 5, 5, 19))


@query(with_(PTS, KG, KDE("ka", "mark = 1"), KDE("kb", "mark = 2"), f"SELECT 1 AS period, ix, iy, {R('gx', 'x')}, {R('gy', 'y')}, {R('density', 'density')} FROM ka UNION ALL SELECT 2, ix, iy, {R('gx', 'x')}, {R('gy', 'y')}, {R('density', 'density')} FROM kb"))
def kde_periods(spark, sf_dir):
    return rounded(pointpattern.kde_by_period(pattern(spark, sf_dir), 0.2, [1, 2], "mark", 16))


SMO = "n0 AS (SELECT a.id AS i, b.id AS j, {0} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {0}, b.id) AS r FROM pts a, pts b), ca AS (SELECT unnest([30, 60]) AS bandwidth), h0 AS (SELECT bandwidth, i, max(d) AS h FROM n0 JOIN ca ON r <= bandwidth + 1 GROUP BY 1, 2), e AS (SELECT bandwidth, n0.i, j, power(1 - (d / h) * (d / h), 2) AS w FROM h0 JOIN n0 ON h0.i = n0.i AND r <= bandwidth + 1 WHERE d < h), s AS (SELECT bandwidth, i, sum(w * v * v) AS xx, sum(w * v * z) AS xr, sum(CASE WHEN i = j THEN w END) AS wii FROM e JOIN pts ON pts.id = e.j GROUP BY 1, 2), f AS (SELECT bandwidth, z - xr / xx * v AS e, wii * v * v / xx AS hat FROM s JOIN pts ON pts.id = s.i), g AS (SELECT bandwidth, sum(e * e) AS rss, sum(hat) AS k, count(*) AS n FROM f GROUP BY 1)".format(D)


@query(with_(PTS, SMO, f"SELECT bandwidth, {R('rss', 'rss')}, {R('k', 'trace')}, {R('n * ln(rss / n) + n + k + 2 * k * (k + 1) / greatest(n - k - 1, 1e-6)', 'score')} FROM g"))
def smooth_scores(spark, sf_dir):
    return rounded(gw.smooth_scores(model_frame(spark, sf_dir), "v", "z", [30, 60]))


GTS = STE.replace("r <= 41", "r <= 31") + f", ps AS (SELECT id, z, v FROM pts), {GSW(['v'])}, ft AS (SELECT i AS id, t.z - b0 * q0 - b1 * q1 AS e, (q0 * q0 / d0 + q1 * q1 / d1) * (SELECT w FROM e WHERE e.i = t.i AND e.j = t.i) AS hat FROM t1 t JOIN bb USING (i)), g AS (SELECT sum(e * e) AS rss, sum(hat) AS k, count(*)::DOUBLE AS n FROM ft)"


@query(with_(PTS, GTS, f"SELECT 30 AS bandwidth, 0.01::DOUBLE AS scale, {R('rss', 'rss')}, {R('k', 'trace')}, {R('n * ln(rss / n) + n + k + 2 * k * (k + 1) / greatest(n - k - 1, 1e-6)', 'score')} FROM g"))
def gtwr_score(spark, sf_dir):
    m = model_frame(spark, sf_dir).withColumn("t", (F.col("id") % 7).cast("double"))
    return rounded(gw.gtwr_scores(m, "z", ["v"], [30], [0.01]))


# Moran's I of residuals, its moments by traces.
MR = "c AS (SELECT regr_intercept(z, v) AS a, regr_slope(z, v) AS b, count(*)::DOUBLE AS n, avg(v) AS mv, regr_sxx(z, v) * 0 + var_pop(v) * count(*) AS sv FROM pts), r AS (SELECT id, z - a - b * v AS e, 1 / sqrt(n) AS q0, (v - mv) / sqrt(sv) AS q1 FROM pts, c), l AS (SELECT i AS id, sum(w * e) AS we, sum(w * q0) AS w0, sum(w * q1) AS w1 FROM e JOIN r ON r.id = e.j GROUP BY 1), tl AS (SELECT j AS id, sum(w * q0) AS t0, sum(w * q1) AS t1 FROM e JOIN r ON r.id = e.i GROUP BY 1), al AS (SELECT r.*, coalesce(we, 0) AS we, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1 FROM r LEFT JOIN l ON l.id = r.id LEFT JOIN tl ON tl.id = r.id), s AS (SELECT sum(e * we) AS ewe, sum(e * e) AS ee, sum(q0 * w0) AS m00, sum(q0 * w1) AS m01, sum(q1 * w0) AS m10, sum(q1 * w1) AS m11, sum(w0 * w0 + w1 * w1) AS ww, sum(t0 * t0 + t1 * t1) AS tt, sum(t0 * w0 + t1 * w1) AS tw FROM al), k AS (SELECT (SELECT sum(w) FROM e) AS s0, (SELECT sum(w * w) FROM e) AS a, (SELECT coalesce(sum(p.w * q.w), 0) FROM e p JOIN e q ON p.i = q.j AND p.j = q.i) AS b), m AS (SELECT *, -(m00 + m11) AS tr, a - ww - tt + m00 * m00 + m01 * m01 + m10 * m10 + m11 * m11 AS mt, b - 2 * tw + m00 * m00 + 2 * m01 * m10 + m11 * m11 AS mm, (SELECT n FROM c) AS n FROM s, k), v AS (SELECT n / s0 * ewe / ee AS i, n / s0 * tr / (n - 2) AS ei, power(n / s0, 2) * ((mt + mm + tr * tr) / ((n - 2) * n) - power(tr / (n - 2), 2)) AS var FROM m), zz AS (SELECT *, (i - ei) / sqrt(var) AS z FROM v)"


@query(with_(PTS, KNN(), MR, f"SELECT {R('i', 'I')}, {R('ei', 'expected_I')}, {R('var', 'var_I')}, {R('z', 'z')}, {R(P2('z'), 'p_value')} FROM zz"))
def moran_residuals(spark, sf_dir):
    m = regression.moran_residuals(model_frame(spark, sf_dir), knn8(spark, sf_dir), "z", ["v"])
    return rounded(small(spark, [(m["I"], m["expected_I"], m["var_I"], m["z"], m["p_value"])], "I double, expected_I double, var_I double, z double, p_value double"))
