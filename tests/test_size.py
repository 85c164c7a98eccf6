"""What must hold for tables of any size: pairs are summed where they are found, and searches are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import pairs
from tessera.queries_more import QUERIES
from tests.conftest import SMALL

#: Queries that only sum over pairs.
SUMS = ["ripley_k", "k_inhom", "ripley_k_border", "envelope_l", "intensity_loo", "bandwidth_cv"]


@pytest.mark.parametrize("name", SUMS)
def test_pairs_never_become_rows(name, spark, monkeypatch):
    def rows(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(pairs, "within", rows)
    assert QUERIES[name](spark, SMALL).count()


def places(spark, n, seed=1, tasks=1):
    rng = np.random.default_rng(seed)
    xy = np.round(rng.normal(size=(n, 2)), 2)  # with ties and some equal places
    return xy, spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double").coalesce(tasks)


def test_nearest_is_spread_and_exact(spark):
    xy, p = places(spark, 1500)
    found = pairs.nearest(p, p, 6)
    assert found.rdd.getNumPartitions() > 1
    got = {(r.i, r["rank"]): r.j for r in found.collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(xy)):
        assert [got[i, k + 1] for k in range(6)] == np.lexsort((np.arange(len(xy)), d[i]))[:6].tolist()


def test_sums_in_parts(spark, monkeypatch):
    xy, p = places(spark, 700)
    monkeypatch.setattr(pairs, "HELD", 900)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    near = (d <= 0.3) & ~np.eye(len(xy), dtype=bool)
    s = {r.id: r.n for r in pairs.summed(p, p, 0.3, lambda b: (b.near,), ["n"]).collect()}
    assert [s[k] for k in range(len(xy))] == near.sum(1).tolist()
    t = pairs.tallied(p, p, 0.3, lambda b: np.floor(b.d / 0.1), lambda b: (b.d,), 4, ["d"], half=True).orderBy("bin").collect()
    want = np.bincount(np.floor(d[near] / 0.1).astype(int)) // 2
    assert [r.n for r in t] == want[want > 0].tolist()
    assert len({(r.i, r["rank"]) for r in pairs.nearest(p.where(F.col("id") < 50), p, 3).collect()}) == 150


@pytest.mark.parametrize("name", ["gtwr", "gtwr_score", "ordinary_kriging", "tin", "w_delaunay"])
def test_no_bound_on_rows(name, spark, monkeypatch):
    want = {str(r) for r in QUERIES[name](spark, SMALL).collect()}
    monkeypatch.setattr(pairs, "SMALL", 10)
    assert {str(r) for r in QUERIES[name](spark, SMALL).collect()} == want


@pytest.mark.parametrize("name", ["knox", "knox_perm", "variogram", "cross_variogram", "indicator_variogram", "st_variogram", "dbscan"])
def test_these_sum_pairs_too(name, spark, monkeypatch):
    test_pairs_never_become_rows(name, spark, monkeypatch)


def test_a_band_is_summed_without_its_edges(spark):
    from tessera.operators import weights

    xy, p = places(spark, 300)
    band = weights.distance_band(p, 0.1)
    band = weights.Band(band.nodes, None, band.points, band.threshold)  # no edges to look at
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    near = (d <= 0.1) & ~np.eye(len(xy), dtype=bool)
    label = np.arange(len(xy))
    for _ in range(len(xy)):
        label = np.minimum(label, np.where(near, label[None], len(xy)).min(1))
    assert [r.component for r in band.components().orderBy("id").collect()] == label.tolist()
    s = band.summary().first()
    assert (s.nnz, s.n_islands, s.n_components) == (near.sum(), (~near.any(1)).sum(), len(set(label)))


def test_knox_at_shared_places(spark):
    from tessera.operators import spacetime

    rng = np.random.default_rng(3)
    rows = [(k, float(k % 5), float(k % 3), float(rng.integers(0, 40)) / 10) for k in range(400)]
    got = spacetime.knox(spark.createDataFrame(rows, "id long, x double, y double, t double"), 1.0, 0.3).first()
    near = [abs(a[3] - b[3]) <= 0.3 for a in rows for b in rows if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) <= 1]
    assert (got.close_space, got.close_both) == (len(near), sum(near))


def test_triangles_of_a_lattice(spark):
    """Squares are cut once, whichever corner is asked."""
    from tessera.functions.planar import delaunay, triangle_edges
    from tessera.operators import weights

    square = spark.createDataFrame([(k, float(k % 6), float(k // 6)) for k in range(36)], "id long, x double, y double")
    found = {(r.i, r.j) for r in weights.delaunay(square, None).edges.collect()}
    assert len(found) == 2 * (6 * 5 * 2 + 25)
    xy = np.random.default_rng(2).uniform(size=(300, 2))
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    assert {(r.i, r.j) for r in weights.delaunay(p, None).edges.collect() if r.i < r.j} == triangle_edges(delaunay(xy))


def test_lags_by_tasks_are_those_of_joins(spark, monkeypatch):
    from tessera.operators import regression, weights

    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(k, *map(float, rng.normal(size=4))) for k in range(60)], "id long, x double, y double, z double, v double")
    w = weights.knn(d, 4)
    monkeypatch.setattr(regression, "DENSE", 10)
    joins = []
    monkeypatch.setattr(regression, "with_lags", lambda *a, plain=regression.with_lags: joins.append(1) or plain(*a))
    powers = regression.Powers(w, 3, 6)
    rows = d.select("id", F.lit(1.0).alias("c0"), F.col("v").alias("c1"))
    got = powers.traces, powers.sums, powers.information(0.1, rows, ["c0", "c1"], np.array([0.5, 2.0]))
    assert not joins
    monkeypatch.setattr(regression, "LOCAL_EDGES", 0)
    powers = regression.Powers(w, 3, 6)
    want = powers.traces, powers.sums, powers.information(0.1, rows, ["c0", "c1"], np.array([0.5, 2.0]))
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_no_frame_is_read_again_for_each_row(spark):
    plan = QUERIES["bh_adjust"](spark, SMALL)._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_criteria_find_neighbours_once(spark, monkeypatch):
    plain, calls = pairs.nearest, []
    monkeypatch.setattr(pairs, "nearest", lambda *a, **k: calls.append(1) or plain(*a, **k))
    QUERIES["gwr_criteria"](spark, SMALL)
    assert len(calls) == 1
