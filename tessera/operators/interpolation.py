"""Deterministic interpolation, variograms, areal weighting and cross-validation.

Samples are (id, x, y, z), targets (id, x, y); predictions are (id, pred).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.kernels import Variogram
from tessera.plans import pairs


def finite(samples: DataFrame, value: str = "z") -> DataFrame:
    ok = F.lit(True)
    for c in ("x", "y", value):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return samples.where(ok).select("id", "x", "y", F.col(value).alias("z"))


def nearest_neighbour(samples: DataFrame, targets: DataFrame) -> DataFrame:
    near = pairs.nearest(targets, finite(samples), 1, same=False)
    return near.join(samples.select(F.col("id").alias("j"), F.col("z").alias("pred")), "j").select(F.col("i").alias("id"), "pred")


def idw(samples: DataFrame, targets: DataFrame, power: float = 2.0, k: int = 12, radius: float | None = None, smoothing: float = 0.0, same: bool = False) -> DataFrame:
    """Inverse distance weights over the k nearest (within the radius); the datum itself at distance 0; null without neighbours."""
    s = finite(samples)
    near = pairs.nearest(targets, s, k, same=same)
    if radius is not None:
        near = near.where(F.col("d") <= radius)
    near = near.join(s.select(F.col("id").alias("j"), "z"), "j")
    d = F.sqrt(F.col("d") * F.col("d") + smoothing * smoothing)
    w = F.when(d > 0, F.pow(d, F.lit(-float(power))))
    out = near.groupBy("i").agg(F.coalesce(F.min_by(F.when(d == 0, F.col("z")), F.when(d == 0, F.col("j"))), F.sum(w * F.col("z")) / F.sum(w)).alias("pred"))
    return targets.select("id").join(out.withColumnRenamed("i", "id"), "id", "left")


def monomials(x: Column, y: Column, degree: int) -> list[Column]:
    """x^i y^j with i + j up to the degree: by total degree, i falling."""
    return [F.pow(x, F.lit(float(t - j))) * F.pow(y, F.lit(float(j))) for t in range(degree + 1) for j in range(t + 1)]


def trend_surface(samples: DataFrame, degree: int = 1) -> dict:
    """Least squares on the monomials of centred coordinates: one aggregate of sums, then a small solve."""
    from tessera.operators.regression import normal_equations

    s = finite(samples)
    mx, my = s.agg(F.avg("x"), F.avg("y")).first()
    terms = monomials(F.col("x") - mx, F.col("y") - my, degree)
    sums = normal_equations(s, terms, F.col("z"))
    if np.linalg.matrix_rank(sums["xtx"]) < len(terms):
        raise ValueError("the samples do not identify a surface of this degree")
    beta = np.linalg.solve(sums["xtx"], sums["xty"])
    sse = sums["yty"] - beta @ sums["xty"]
    sst = sums["yty"] - sums["sy"] ** 2 / sums["n"]
    return {"beta": beta, "center": (mx, my), "degree": degree, "r2": 1 - sse / sst}


def trend_predict(model: dict, targets: DataFrame) -> DataFrame:
    mx, my = model["center"]
    terms = monomials(F.col("x") - mx, F.col("y") - my, model["degree"])
    return targets.select("id", sum((t * float(b) for t, b in zip(terms, model["beta"], strict=True)), F.lit(0.0)).alias("pred"))


def _local(samples: DataFrame, targets: DataFrame, k: int, solve, schema: str = "id long, pred double") -> DataFrame:
    """``solve(near xy (k, 2), near z, target xy)`` for each target's k nearest samples, in Arrow batches of whole targets."""
    s = finite(samples)
    near = pairs.nearest(targets, s, k, same=False).join(s.select(F.col("id").alias("j"), F.col("x").alias("sx"), F.col("y").alias("sy"), "z"), "j")
    lists = near.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sx", "sy", "z"))).alias("s"))  # k entries
    rows = targets.select("id", "x", "y").join(lists, "id").select("id", "x", "y", "s.sx", "s.sy", "s.z")
    names = [c.split()[0] for c in schema.split(", ")][1:]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [solve(np.column_stack([r.sx, r.sy]), np.array(r.z, float), np.array([r.x, r.y])) for r in pdf.itertuples()]
            yield pd.DataFrame({"id": pdf["id"], **{n: [f[c] for f in found] for c, n in enumerate(names)}})

    return rows.mapInPandas(run, schema)


RBF_KERNELS = {
    "thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0.0),
    "linear": lambda r: -r,
    "cubic": lambda r: r**3,
    "gaussian": lambda r: np.exp(-r * r),
    "multiquadric": lambda r: -np.sqrt(1 + r * r),
    "inverse_multiquadric": lambda r: 1 / np.sqrt(1 + r * r),
    "inverse_quadratic": lambda r: 1 / (1 + r * r),
    "quintic": lambda r: -(r**5),
}


def _rbf_value(xy: np.ndarray, z: np.ndarray, at: np.ndarray, kernel: str, smoothing: float, epsilon: float) -> np.ndarray:
    lo, scale = xy.min(0), np.maximum(np.ptp(xy, axis=0).max(), 1e-12)
    p, q = (xy - lo) / scale, (np.atleast_2d(at) - lo) / scale
    phi = RBF_KERNELS[kernel]
    dist = lambda a, b: np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]) * epsilon
    one = np.column_stack([np.ones(len(p)), p])
    a = np.block([[phi(dist(p, p)) + smoothing * np.eye(len(p)), one], [one.T, np.zeros((3, 3))]])
    coef = np.linalg.lstsq(a, np.concatenate([z, np.zeros(3)]), rcond=None)[0]
    return np.column_stack([phi(dist(q, p)), np.ones(len(q)), q]) @ coef


def rbf(samples: DataFrame, targets: DataFrame, kernel: str = "thin_plate_spline", smoothing: float = 0.0, neighbors: int = 50, epsilon: float = 1.0) -> DataFrame:
    """Radial basis functions with a plane, through each target's nearest samples."""
    if kernel not in RBF_KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    return _local(samples, targets, neighbors, lambda xy, z, at: (float(_rbf_value(xy, z, at, kernel, smoothing, epsilon)[0]),))


def thin_plate_spline(samples: DataFrame, targets: DataFrame, smoothing: float = 0.0, neighbors: int = 50) -> DataFrame:
    return rbf(samples, targets, "thin_plate_spline", smoothing, neighbors)


def tin(samples: DataFrame, targets: DataFrame, fill: str = "nearest") -> DataFrame:
    """Linear on the Delaunay triangle that holds a target, found by itself; outside the nearest sample or null."""
    from tessera.functions.planar import barycentric

    def run(mesh, rows, found):
        at, out = rows[["x", "y"]].to_numpy(float), np.full(len(rows), np.nan)
        z = mesh.index.columns["z"]
        for i, near in found:
            t = mesh.triangle(at[i], near)
            if t is not None:
                out[i] = barycentric(at[i][None], mesh.p[list(t)])[0] @ z[list(t)]
            elif fill == "nearest":
                out[i] = z[near[0]]
        yield pd.DataFrame({"id": rows["id"], "pred": out})

    out = pairs.meshed(targets, finite(samples), run, "id long, pred double", ("z",))
    return out.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))


def thiessen_polygons(samples: DataFrame, ring: list[tuple[float, float]], k: int = 64) -> DataFrame:
    """(id, ring, area): Voronoi cells clipped to a ring, each from its nearest samples; all of them where those don't close the cell."""
    from tessera.functions.planar import ring_area, voronoi_cell

    s = samples.select("id", "x", "y")
    if s.groupBy("x", "y").count().where("count > 1").limit(1).count():
        raise ValueError("samples at one place have no cells of their own")
    if s.limit(pairs.SMALL + 1).count() > pairs.SMALL:
        raise ValueError(f"cells are cut among up to {pairs.SMALL} samples")
    table = s.orderBy("id").toPandas()
    shared = s.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), table[["x", "y"]].to_numpy(), np.array(ring, float)))

    def run(batches):
        import pandas as pd

        ids, xy, region = shared.value
        for pdf in batches:
            cells = [voronoi_cell(int(i), xy, region) for i in np.searchsorted(ids, pdf["id"].to_numpy())]
            yield pd.DataFrame({"id": pdf["id"], "ring": [c.tolist() for c in cells], "area": [ring_area(c) if len(c) > 2 else 0.0 for c in cells]})

    return s.select("id").mapInPandas(run, "id long, ring array<array<double>>, area double")


def _convex(ring) -> np.ndarray:
    """The ring counter-clockwise; it must be convex."""
    r = np.asarray(ring, float)
    r = r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
    x, y = r.T
    r = r if x @ np.roll(y, -1) > y @ np.roll(x, -1) else r[::-1]
    a, b = np.roll(r, -1, 0) - r, np.roll(r, -2, 0) - np.roll(r, -1, 0)
    if (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] < -1e-9 * np.abs(a).max() * np.abs(b).max()).any():
        raise ValueError("target zones must be convex")
    return r


def areal_weighting_polygons(source: DataFrame, target: DataFrame, extensive: tuple[str, ...] = (), intensive: tuple[str, ...] = (), source_crs: str | None = None, target_crs: str | None = None) -> DataFrame:
    """(id, extensive..., intensive...) of simple source rings (id, ring array<struct<x, y>>, values) in convex target ones (id, ring).

    Rings whose boxes meet in a cell of the mean box's size are clipped; a ring is
    in every cell that its box touches, and a pair counts in the first cell of both.
    """
    from tessera.functions.planar import clip_to, ring_area

    if source_crs != target_crs:
        raise ValueError("source and target have different reference systems")
    ends = lambda n: [getattr(F, f)(F.transform("ring", lambda p: p[c])).alias(f"{n}{c}{k}") for c in "xy" for k, f in (("0", "array_min"), ("1", "array_max"))]  # noqa: B023, E731
    s = source.select(F.col("id").alias("s"), F.col("ring").alias("sr"), *extensive, *intensive, *ends("s"))
    t = target.select("id", F.col("ring").alias("tr"), *ends("t"))
    size = max(t.agg(F.avg(F.greatest(F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")))).first()[0] or 0.0, s.agg(F.avg(F.greatest(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")))).first()[0] or 0.0, 1e-12)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    spread = lambda d, n: d.withColumn("cx", F.explode(F.sequence(cell(f"{n}x0"), cell(f"{n}x1")))).withColumn("cy", F.explode(F.sequence(cell(f"{n}y0"), cell(f"{n}y1"))))
    both = spread(s, "s").join(spread(t, "t"), ["cx", "cy"]).where((F.col("cx") == F.greatest(cell("sx0"), cell("tx0"))) & (F.col("cy") == F.greatest(cell("sy0"), cell("ty0"))))
    both = both.where("sx0 < tx1 and tx0 < sx1 and sy0 < ty1 and ty0 < sy1")

    @F.pandas_udf("struct<own:double,common:double>")
    def areas(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for r, q in zip(a, b, strict=True):
            r, q = ([(p["x"], p["y"]) for p in ring] for ring in (r, q))
            common = clip_to(np.array(r), _convex(q))
            out.append((ring_area(r), ring_area(common) if len(common) > 2 else 0.0))
        return pd.DataFrame(out, columns=["own", "common"])

    both = both.withColumn("a", areas("sr", "tr")).where("a.common > 0")
    sums = [F.sum(F.col(c) * F.col("a.common") / F.col("a.own")).alias(c) for c in extensive] + [(F.sum(F.col(c) * F.col("a.common")) / F.sum("a.common")).alias(c) for c in intensive]
    return both.groupBy("id").agg(*sums)


def empirical_variogram(samples: DataFrame, n_lags: int = 15, max_dist: float | None = None, min_pairs: int = 1, other: str | None = None, value: str = "z") -> DataFrame:
    """(bin, lag, gamma, n_pairs): half the mean product of differences by equal bins of distance, up to half the largest.

    ``other`` makes it the cross-variogram with another column.
    """
    s = samples.select("id", "x", "y", F.col(value).cast("double").alias("_a"), F.col(other or value).cast("double").alias("_b"))
    if max_dist is None:
        max_dist = largest_distance(s) / 2
    step = max_dist / n_lags
    # Pairs with a missing value count, but have no part in the mean.
    whole = s.select(F.coalesce("_a", F.lit(0.0)).alias("_a"), F.coalesce("_b", F.lit(0.0)).alias("_b"), "id", "x", "y", (F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("double").alias("_ok"))
    gaps = not s.where("_a is null or _b is null").isEmpty()
    columns = (("_a", "_b") if other else ("_a",)) + (("_ok",) if gaps else ())

    def terms(v):
        out = v.left("_a") - v.right("_a")
        out = out * (v.left("_b") - v.right("_b") if other else out)
        known = v.left("_ok") * v.right("_ok") if gaps else None
        return (v.d, out * known, known) if gaps else (v.d, out)

    bin_of = lambda v: np.minimum(np.floor(v.d / step), n_lags - 1)
    names = ["d", "p"] + (["m"] if gaps else [])
    out = pairs.tallied(whole, whole, max_dist, bin_of, terms, n_lags, names, columns, columns, half=True)
    m = F.when(F.col("m") > 0, F.col("m")) if gaps else F.col("n")
    out = out.select("bin", (F.col("d") / F.col("n")).alias("lag"), (0.5 * F.col("p") / m).alias("gamma"), F.col("n").alias("n_pairs"))
    return out.where(F.col("n_pairs") >= min_pairs)


def largest_distance(points: DataFrame) -> float:
    """Between any two rows: it is one of the corners of their hull, of which each task sends its own."""
    from tessera.functions.planar import convex_hull

    def run(batches):
        left = np.zeros((0, 2))
        for pdf in batches:
            xy = pdf[["x", "y"]].to_numpy(float)
            left = convex_hull(np.vstack([left, xy[np.isfinite(xy).all(1)]]))
        yield pd.DataFrame(left, columns=["x", "y"])

    corners = convex_hull(points.select("x", "y").mapInPandas(run, "x double, y double").toPandas().to_numpy(float))
    return max((float(np.sqrt(((corners - c) ** 2).sum(1)).max()) for c in corners), default=0.0)


def indicator(value: Column, threshold: float, at_least: bool = True) -> Column:
    return F.when(value >= threshold if at_least else value <= threshold, 1.0).otherwise(0.0)


def indicator_variogram(samples: DataFrame, threshold: float, n_lags: int = 15, max_dist: float | None = None, at_least: bool = True, min_pairs: int = 1) -> DataFrame:
    i = samples.withColumn("z", indicator(F.col("z"), threshold, at_least))
    if i.select("z").distinct().count() < 2:
        raise ValueError("the indicator is constant")
    return empirical_variogram(i, n_lags, max_dist, min_pairs)


def etype(probabilities: DataFrame, thresholds: list[float], columns: list[str], z_min: float = 0.0, z_max: float | None = None) -> DataFrame:
    """(id, estimate): integral of P(Z >= t): linear tails to ``z_min`` and ``z_max``, trapezoids between."""
    t = list(map(float, thresholds))
    z_max = t[-1] + (t[-1] - t[0]) / max(len(t) - 1, 1) if z_max is None else z_max
    p = [F.col(c) for c in columns]
    out = F.lit(float(z_min)) + 0.5 * (1 + p[0]) * (t[0] - z_min)
    for a, b, pa_, pb in zip(t, t[1:], p, p[1:], strict=False):
        out = out + 0.5 * (pa_ + pb) * (b - a)
    return probabilities.select("id", (out + 0.5 * p[-1] * (z_max - t[-1])).alias("estimate"))


def areal_weighting(source: DataFrame, target: DataFrame, extensive: tuple[str, ...] = (), intensive: tuple[str, ...] = ()) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) to boxes by shares of area: sums of extensive, area-weighted means of intensive columns, for every target.

    An interval-overlap join; the candidates meet in grid cells of the size of
    the largest source box.
    """
    size = float(source.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0) or 1.0
    cells = lambda df: df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    s = cells(source.select(F.col("id").alias("sid"), "x0", "y0", "x1", "y1", *extensive, *intensive))
    t = cells(target.select(F.col("id").alias("tid"), *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1"))).withColumns({c: F.col(f"t{c}") for c in ("x0", "y0", "x1", "y1")})).drop("x0", "y0", "x1", "y1")
    w = F.least("x1", "tx1") - F.greatest("x0", "tx0")
    h = F.least("y1", "ty1") - F.greatest("y0", "ty0")
    # A pair is counted in the cell that holds the lower left corner of its overlap.
    own = (F.col("_cx") == F.floor(F.greatest("x0", "tx0") / size)) & (F.col("_cy") == F.floor(F.greatest("y0", "ty0") / size))
    both = s.join(t, ["_cx", "_cy"]).where((w > 0) & (h > 0) & own).withColumn("a", w * h)
    share = F.col("a") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    sums = [F.sum(F.col(c) * share).alias(c) for c in extensive] + [(F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(c) for c in intensive]
    out = both.groupBy(F.col("tid").alias("id")).agg(*sums)
    return target.select("id").join(out, "id", "left")


def dasymetric(source: DataFrame, target: DataFrame, points: DataFrame, extensive: str, weight: str | None = None) -> DataFrame:
    """(id, value): a source's total dealt to its points by weight and summed over the target boxes that hold them.

    Sources without points go by area. A point on a border belongs to the box
    above and right of it.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = points.select(F.col("id").alias("pid"), "x", "y", w.alias("w"))
    box = lambda df, n: df.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = lambda n: (F.col("x") >= F.col(f"{n}_x0")) & (F.col("x") < F.col(f"{n}_x1")) & (F.col("y") >= F.col(f"{n}_y0")) & (F.col("y") < F.col(f"{n}_y1"))

    def place(df, boxes, n):
        size = float(boxes.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0) or 1.0
        b = box(boxes, n).withColumn("_cx", F.explode(F.sequence(F.floor(F.col(f"{n}_x0") / size), F.floor(F.col(f"{n}_x1") / size)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col(f"{n}_y0") / size), F.floor(F.col(f"{n}_y1") / size))))
        return df.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)}).join(b, ["_cx", "_cy"]).where(inside(n)).drop("_cx", "_cy")

    by_source = place(p, source, "s")
    totals = by_source.groupBy("s").agg(F.sum("w").alias("total")).where("total > 0")
    shares = place(by_source.select("pid", "x", "y", "w", "s"), target, "t").groupBy("s", "t").agg(F.sum("w").alias("w")).join(totals, "s")
    value = source.select(F.col("id").alias("s"), F.col(extensive).alias("v"))
    dealt = shares.join(value, "s").select(F.col("t").alias("id"), (F.col("v") * F.col("w") / F.col("total")).alias("value"))
    bare = source.join(totals.select(F.col("s").alias("id")), "id", "left_anti")
    rest = areal_weighting(bare, target, (extensive,)).select("id", F.col(extensive).alias("value")).where("value is not null") if bare.limit(1).count() else dealt.limit(0)
    out = dealt.unionByName(rest).groupBy("id").agg(F.sum("value").alias("value"))
    return target.select("id").join(out, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def cv_scores(observed: DataFrame) -> DataFrame:
    """One row from (observed, pred): rmse, mae, me, r2, corr over the finite predictions, n_failed."""
    ok = F.col("pred").isNotNull() & ~F.isnan("pred")
    e = F.when(ok, F.col("pred") - F.col("observed"))
    o = F.when(ok, F.col("observed"))
    return observed.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("me"),
        (1 - F.sum(e * e) / (F.sum(o * o) - F.sum(o) * F.sum(o) / F.count(o))).alias("r2"),
        F.corr(o, F.when(ok, F.col("pred"))).alias("corr"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_failed"),
    )


def folds(samples: DataFrame, method: str = "kfold", k: int = 10, block_size: float | None = None, seed: int = 0) -> DataFrame:
    """``samples`` with ``fold``: loo (its id), kfold or spatial_block (blocks of a fifth of the extent dealt to folds), by hash."""
    from tessera.plans.resample import ticket

    deal = lambda *keys: F.pmod(F.conv(F.substring(ticket(seed, *keys), 1, 8), 16, 10).cast("long"), F.lit(k))
    if method == "loo":
        return samples.withColumn("fold", F.col("id"))
    if method == "kfold":
        return samples.withColumn("fold", deal("id"))
    if method != "spatial_block":
        raise ValueError(f"unknown method {method!r}")
    x0, y0, x1, y1 = samples.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    size = block_size or 0.2 * max(x1 - x0, y1 - y0)
    return samples.withColumn("fold", deal(F.floor((F.col("x") - x0) / size), F.floor((F.col("y") - y0) / size)))


def cv_idw(samples: DataFrame, power: float = 2.0, k: int = 12, method: str = "loo", n_folds: int = 10, seed: int = 0) -> DataFrame:
    """(id, observed, pred): IDW from the samples of the other folds, all folds in one plan."""
    s = finite(samples)
    if method == "loo":
        return s.select("id", F.col("z").alias("observed")).join(idw(s, s, power, k, same=True), "id")
    f = folds(s, method, n_folds, seed=seed)
    each = [idw(f.where(F.col("fold") != i), f.where(F.col("fold") == i), power, k) for i in range(n_folds)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return s.select("id", F.col("z").alias("observed")).join(out, "id")


def grid_search(samples: DataFrame, powers: list[float], ks: list[int]) -> DataFrame:
    """(power, k, rmse, mae, ...) of leave-one-out IDW for each pair of parameters, best first."""
    rows = [cv_scores(cv_idw(samples, p, k)).select(F.lit(p).alias("power"), F.lit(k).alias("k"), "*") for p in powers for k in ks]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.orderBy("rmse")


def fit_variogram(empirical, model: str = "spherical", fit_nugget: bool = True, range_: float | None = None, signed: bool = False) -> Variogram:
    """Weighted least squares of (lag, gamma, n_pairs), residuals scaled by sqrt(n) / gamma of the model, in bounds.

    For a range the sills enter linearly; the range is searched on a fine grid
    and then by golden section, and the weights follow the fit.
    """
    table = empirical.orderBy("lag").toPandas() if isinstance(empirical, DataFrame) else empirical
    h, g, n = (table[c].to_numpy(float) for c in ("lag", "gamma", "n_pairs"))
    if len(h) < 3:
        raise ValueError("a variogram needs three bins at least")
    scale = np.abs(g).max()

    def at(r):
        shape = Variogram(model, 0, 1, r).shape(h)
        a = np.column_stack([np.ones(len(h)), shape]) if fit_nugget else shape[:, None]
        w, best = np.sqrt(n) / np.maximum(np.abs(g), 1e-12 * scale), None
        for _ in range(12):
            b = np.linalg.lstsq(a * w[:, None], g * w, rcond=None)[0]
            if not signed and (b < 0).any():
                if fit_nugget and b[0] < 0:
                    b = np.array([0.0, max(((shape * w) @ (g * w)) / ((shape * w) @ (shape * w)), 1e-12)])
                else:
                    b = np.array([max(np.average(g, weights=w * w), 0), 1e-12]) if fit_nugget else np.array([1e-12])
            fitted = a @ b
            w = np.sqrt(n) / np.maximum(np.abs(fitted), 1e-6 * scale)
            best = b, float((((g - fitted) * w) ** 2).sum())
        return best

    if range_ is None:
        tries = np.geomspace(0.1 * h.min() if h.min() > 0 else 1e-3 * h.max(), 3 * h.max(), 80)
        costs = [at(r)[1] for r in tries]
        i = int(np.argmin(costs))
        lo, hi = tries[max(i - 1, 0)], tries[min(i + 1, len(tries) - 1)]
        for _ in range(40):
            a, b = hi - 0.6180339887 * (hi - lo), lo + 0.6180339887 * (hi - lo)
            lo, hi = (lo, b) if at(a)[1] < at(b)[1] else (a, hi)
        range_ = (lo + hi) / 2
    b = at(range_)[0]
    return Variogram(model, float(b[0]) if fit_nugget else 0.0, float(b[-1]), float(range_), signed)


def fit_variogram_auto(empirical, models: tuple[str, ...] = ("spherical", "exponential", "gaussian")) -> Variogram:
    """The model of least weighted squared error."""
    table = empirical.orderBy("lag").toPandas() if isinstance(empirical, DataFrame) else empirical
    h, g, n = (table[c].to_numpy(float) for c in ("lag", "gamma", "n_pairs"))

    def error(v):
        m = v.gamma(h)
        return float((n * ((g - m) / np.maximum(m, 1e-12)) ** 2).sum())

    return min((fit_variogram(table, m) for m in models), key=error)
