"""Classes, simulated tables, readers, tables for drawing, networks and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import classify
from tessera.operators import neural, plots, weights
from tessera.plans import config
from tessera.sources import datasets


def test_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10, 11, 12, 50, 51, 52, None] if v is not None] + [(None,)], "v double")
    assert classify.breaks(df, "v", "natural_breaks", 3) == [3.0, 12.0]
    assert classify.breaks(df, "v", "equal_interval", 3) == pytest.approx([18, 35])
    got = classify.classified(df, "v", "natural_breaks", 3).groupBy("v_class").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 3, 1: 3, 2: 3, None: 1}


def test_simulated_tables(spark):
    assert datasets.lattice(spark, 6).where("binary = 1").count() == 18
    for make, n in ((datasets.georgia, 159), (datasets.london_houses, 500), (datasets.beijing_pm25, 300), (datasets.ncovid, 400)):
        d = make(spark)
        assert d.count() == n and d.dropna().count() == n
    assert datasets.csr_points(spark, 50).where("x < 0 or x > 1 or y < 0 or y > 1").isEmpty()


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("lon,lat,v\n1,2,3\n")
    r = datasets.read_points(spark, str(tmp_path / "p.csv"), "csv", "lon", "lat").first()
    assert (r.x, r.y, r.v) == (1.0, 2.0, 3)
    (tmp_path / "f.geojsonl").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2]},"properties":{"a":"b"}}\n{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]},"properties":{}}\n')
    rows = {r.type: r for r in datasets.read_geojson(spark, str(tmp_path / "f.geojsonl")).collect()}
    assert (rows["Point"].x, rows["Point"].properties["a"]) == (1.5, "b") and len(rows["Polygon"].ring) == 3


def test_tables_for_drawing(spark):
    d = datasets.lattice(spark, 6)
    w, y = weights.lattice(d.select("id", "row", "col")), d.select("id", F.col("z").alias("y"))
    assert plots.lisa_map(y, w, 19).where("colour is null").isEmpty()
    assert plots.hotspot_map(y, w).where("colour is null").isEmpty()
    points, line = plots.moran_scatter(y, w)
    assert points.count() == 36 and line.first().slope > 0
    assert plots.choropleth(d, "z").select("z_class").distinct().count() == 5


def test_networks_beat_the_global_fit(spark):
    rng = np.random.default_rng(0)
    xy, v = rng.uniform(0, 10, (150, 2)), rng.normal(size=150)
    z = (1 + xy[:, 0] / 5) * v
    rows = spark.createDataFrame([(i, *map(float, (*xy[i], v[i], z[i], i % 5))) for i in range(150)], "id long, x double, y double, v double, z double, t double")
    flat = float(((z - np.polyval(np.polyfit(v, z, 1), v)) ** 2).mean())
    for fitted in (neural.gnnwr(rows, "z", ["v"]), neural.gtnnwr(rows, "z", ["v"], "t")):
        assert fitted.agg(F.avg(F.col("residual") * F.col("residual"))).first()[0] < 0.7 * flat


def test_settings(spark):
    before = config.get_options(spark)["spark.sql.shuffle.partitions"]
    config.set_options(spark, 3)
    assert config.get_options(spark)["spark.sql.shuffle.partitions"] == "3" and config.resolve_jobs(spark, 5) == 5
    config.set_options(spark, int(before))
    assert [len(r) for r in config.chunked(7, 3)] == [2, 2, 3]


def test_points_of_polygons(spark):
    from tessera.sources.frame import centroids, representative_points

    corner = "array<struct<x:double,y:double>>"
    shapes = spark.createDataFrame([(0, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]), (1, [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)])], f"id long, ring {corner}")
    c = {r.id: (r.x, r.y) for r in centroids(shapes).collect()}
    assert c[0] == pytest.approx((1.0, 0.5)) and c[1] == pytest.approx((1.1, 1.1))
    p = {r.id: (r.x, r.y) for r in representative_points(shapes).collect()}
    assert p[1][0] < 3 and (p[1][1] <= 1 or p[1][0] <= 1)


def test_permutation_tests_and_comparisons(spark):
    from tessera.operators import esda, kriging, sampling

    d = datasets.lattice(spark, 6)
    w = weights.lattice(d.select("id", "row", "col"))
    bb = esda.permutation_test(d.select("id", F.col("binary").cast("double").alias("y")), w, "BB", 19).first()
    assert bb.observed == esda.join_counts(d.select("id", F.col("binary").alias("y")), w).first().BB and bb.p_value <= 0.1
    b = esda.moran_bivariate_test(d.withColumn("u", F.col("z") * 2), w, "z", "u", 19).first()
    assert b.observed == pytest.approx(2 * esda.moran(d.select("id", F.col("z").alias("y")), w).first().I) and b.p_value <= 0.1
    s = d.withColumn("c", F.sin("x"))
    assert kriging.compare_methods(s, (0.01, 1.0, 3.0), 8).count() == 3
    assert kriging.regression_kriging(s, s, ["c"], "gam", (0.0, 1.0, 3.0), 8).join(s, "id").where("abs(pred - z) > 1e-6").isEmpty()
    assert sampling.compare_designs(s, "z", {"few": 5, "many": 20}, 20).where("design = 'many'").first().deff < 1


def test_graphs_of_points_are_those_of_every_third_point(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.uniform(0, 1, (60, 2)), 0.02 * rng.normal(size=(40, 2)) + 0.5, [[5.0, 5.0], [5.0, 5.0]]])
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    d = np.hypot(*(xy[:, None] - xy).transpose(2, 0, 1))
    for make, blocked in ((weights.gabriel, lambda i, j: ((xy - (xy[i] + xy[j]) / 2) ** 2).sum(1) < (d[i, j] / 2) ** 2 - 1e-12), (weights.relative_neighbourhood, lambda i, j: np.maximum(d[i], d[j]) < d[i, j] - 1e-12)):
        want = {(i, j) for i in range(len(xy)) for j in range(len(xy)) if i != j and not np.delete(blocked(i, j), [i, j]).any()}
        assert {(r.i, r.j) for r in make(p, transform=None).edges.collect()} == want


def test_envelopes_of_any_statistic(spark):
    from tessera.operators import pointpattern
    from tessera.sources.frame import PointPattern, Window

    box = Window.box(0, 0, 1, 1)
    rng = np.random.default_rng(2)
    clustered = spark.createDataFrame([(i, float(np.clip(0.5 + 0.05 * a, 0, 1)), float(np.clip(0.5 + 0.05 * b, 0, 1))) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], "id long, x double, y double")
    pp = PointPattern(clustered, box)
    got = pointpattern.envelope(pp, lambda q: pointpattern.ripley_l(q, [0.05, 0.1]), 9).collect()
    assert len(got) == 2 and all(r.est > r.hi >= r.lo and r.mad_p == 0.1 == r.dclf_p for r in got)
    same = pointpattern.envelope(pp, lambda q: pointpattern.ripley_l(q, [0.05, 0.1]), 3, simulator=lambda k: pp).collect()
    assert all(r.lo == r.est == r.hi and r.mad_p == 1.0 for r in same)
    mc = pointpattern.quadrat_test_mc(pp, 4, 4, 19).first()
    assert mc.p_value == 0.05


def test_risks_with_covariates(spark):
    from tessera.operators import bayes

    rng = np.random.default_rng(6)
    n = 8
    x = rng.normal(size=n * n)
    O = rng.poisson(30 * np.exp(0.5 * x))
    d = datasets.lattice(spark, n)
    areas = spark.createDataFrame([(i, float(O[i]), 30.0, float(x[i])) for i in range(n * n)], "id long, O double, E double, x double")
    w = weights.lattice(d.select("id", "row", "col"))
    draws = bayes.bym(areas, w, chains=2, draws=100, tune=300, thin=2, X=("x",))
    mean = {r.id: r["mean"] for r in bayes.summary(draws).collect()}
    assert len(mean) == n * n + 2 and abs(mean[-2] - 0.5 * x.std()) < 0.12
    s = bayes.shrinkage(draws.where("id >= 0"), areas).toPandas()
    raw = dict(zip(range(n * n), O / 30.0, strict=True))
    assert len(s) == n * n and all(abs(raw[r.id] + r.change - mean[r.id]) < 1e-9 for r in s.itertuples())


def test_bandwidth_searches(spark):
    from tessera.operators import gw

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, float(a), float(b), float(v), float(np.sin(3 * a) * v + 2 * b + 0.05 * e), float(i % 4)) for i, (a, b, v, e) in enumerate(np.column_stack([rng.uniform(0, 3, (90, 2)), rng.normal(size=(90, 2))]))], "id long, x double, y double, v double, z double, t double")
    chosen = gw.select_mgwr(rows, "z", ["v"], [15, 80], 2)
    assert set(chosen) <= {15, 80} and chosen[1] == 15
    b, scale = gw.select_gtwr(rows, "z", ["v"], [15, 60], [0.0, 100.0])
    assert (b, scale) == (15, 0.0) or scale == 0.0
    flags = rows.withColumn("k", (F.col("z") > 3).cast("int"))
    got = gw.gw_classify(flags, "k", ["v"], 60).collect()
    assert len(got) == 90 and np.mean([r.correct for r in got]) > 0.8
    test = gw.variability_test(rows, "z", ["v"], 30, 9).collect()
    assert {r.coefficient for r in test} == {0, 1} and all(0.1 <= r.p_value <= 1 for r in test)


def test_windows_and_kinds_of_geometry(spark):
    from tessera.operators import interpolation
    from tessera.sources.frame import Window, geometry_types

    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    schema = "id long, ring array<struct<x double, y double>>, pop double"
    one = spark.createDataFrame([(1, ring, 10.0)], schema)
    assert Window.of_rings(one).area == pytest.approx(2.0)
    two = one.unionAll(spark.createDataFrame([(2, [(a, b + 1) for a, b in ring], 30.0)], schema))
    assert Window.of_rings(two).area == pytest.approx(4.0)
    assert geometry_types(one) == ["Polygon"] and geometry_types(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "x double, y double")) == ["None", "Point"]
    target = spark.createDataFrame([(7, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)])], "id long, ring array<struct<x double, y double>>")
    got = interpolation.areal_weighting_polygons(two, target, ("pop",)).first()
    assert got["pop"] == pytest.approx(10 * 0.75 + 30 * 0.25)
    with pytest.raises(ValueError):
        interpolation.areal_weighting_polygons(two, target, ("pop",), (), "EPSG:4326", "EPSG:3857")
    dented = spark.createDataFrame([(7, [(0.0, 0.0), (2.0, 0.0), (0.2, 0.2), (0.0, 2.0)])], "id long, ring array<struct<x double, y double>>")
    with pytest.raises(Exception, match="convex"):
        interpolation.areal_weighting_polygons(two, dented, ("pop",)).collect()
