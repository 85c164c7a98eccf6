"""Space-time workflows: statistics by period, the Knox test, trends, panels. Rows are (id, x, y, t, value) or by site and period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.esda import safe
from tessera.operators.weights import Weights
from tessera.plans import pairs
from tessera.plans.graph import cut
from tessera.plans.resample import permuted


def moran_by_period(panel: DataFrame, w: Weights) -> DataFrame:
    """(period, n, I) of (id, period, y): one W, all periods in one plan."""
    mean = panel.groupBy("period").agg(F.avg("y").alias("m"))
    z = panel.join(F.broadcast(mean), "period").select("period", "id", (F.col("y") - F.col("m")).alias("z"))
    moments = z.groupBy("period").agg(F.sum(F.col("z") * F.col("z")).alias("m2"), F.count("*").alias("n"))
    e = w.edges.join(z.select("period", F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select("period", F.col("id").alias("j"), F.col("z").alias("zj")), ["period", "j"])
    cross = e.groupBy("period").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0"))
    return moments.join(cross, "period").select("period", "n", safe(F.col("n") / F.col("s0") * F.col("num"), F.col("m2")).alias("I"))


def knox(events: DataFrame, space: float, time: float, permutations: int = 0, seed: int = 0) -> DataFrame:
    """One row: close_space, close_time_space and, from times permuted over events, p_value; ``events`` is (id, x, y, t)."""
    times = ["t", *(f"t{rep}" for rep in range(permutations))]
    whole = events.select("id", "x", "y", F.col("t").cast("double").alias(times[0]))
    if permutations:
        sims = permuted(events.select("id", F.col("t").cast("double").alias("y")), permutations, seed)
        whole = cut(whole.join(sims.groupBy("id").agg(*(F.first(F.when(F.col("rep") == r, F.col("y")), ignorenulls=True).alias(f"t{r}") for r in range(permutations))), "id"))
    elif whole.select("x", "y").distinct().count() * 4 < whole.count():
        return _knox_places(whole, space, time)

    def fold(b):
        r, c = np.nonzero(b.near)
        return [len(r), *(int((np.abs(b.left(t)[r, 0] - b.right(t)[0, c]) <= time).sum()) for t in times)]

    names = ["seen", *(f"n{rep}" for rep in range(permutations))]
    out = pairs.counted(whole, space, fold, ["close_space", *names], tuple(times))
    if not permutations:
        return out.select("close_space", F.col("seen").alias("close_both"))
    up = sum((F.when(F.col(n) >= F.col("seen"), 1).otherwise(0) for n in names[1:]), F.lit(0))
    return out.select("close_space", F.col("seen").alias("close_both"), ((up + 1) / (permutations + 1.0)).alias("p_value"))


def _close_times(a: np.ndarray, b: np.ndarray, time: float) -> int:
    """Pairs of the rising ``a`` and ``b`` whose difference is no more than ``time``, as it is rounded."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    lo, hi = np.searchsorted(b, a - time, "left"), np.searchsorted(b, a + time, "right")
    shifts = [(lo, -1, -1, lambda v: a - v <= time), (lo, 0, 1, lambda v: a - v > time), (hi, 0, 1, lambda v: v - a <= time), (hi, -1, -1, lambda v: v - a > time)]
    for at, look, step, wrong in shifts:
        while True:
            p = at + look
            move = (p >= 0) & (p < len(b)) & wrong(b[np.clip(p, 0, len(b) - 1)])
            if not move.any():
                break
            at += step * move
    return int((hi - lo).sum())


def _knox_places(events: DataFrame, space: float, time: float) -> DataFrame:
    """The counts where many events share a place: places are paired, and their times, in order, counted by search."""
    places = cut(events.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sort_array(F.collect_list("t")).alias("ts")))

    def fold(b):
        space_, both = 0, 0
        for r, c in zip(*np.nonzero(b.near), strict=True):
            space_ += int(b.left("n")[r, 0]) * int(b.right("n")[0, c])
            if len(b.left("ts")[r, 0]) and len(b.right("ts")[0, c]):
                both += _close_times(b.left("ts")[r, 0], b.right("ts")[0, c], time)
        return space_, both

    def own(batches):
        for pdf in batches:
            both = [(_close_times(t, t, time) - len(t)) // 2 if len(t) else 0 for t in pdf["ts"]]
            yield pd.DataFrame({"close_space": [int((pdf["n"] * (pdf["n"] - 1) // 2).sum())], "close_both": [sum(both)]})

    ok = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    apart = pairs.counted(places, space, fold, ["close_space", "close_both"], ("n", "ts"))
    together = places.where(ok).select("n", "ts").mapInPandas(own, "close_space long, close_both long")
    return apart.unionByName(together).agg(F.coalesce(F.sum("close_space"), F.lit(0)).alias("close_space"), F.coalesce(F.sum("close_both"), F.lit(0)).alias("close_both"))


def mann_kendall(series: DataFrame) -> DataFrame:
    """(id, n, S, var_S, z) of (id, period, value), without a correction for ties."""
    a, b = series.select("id", F.col("period").alias("p1"), F.col("value").alias("v1")), series.select("id", F.col("period").alias("p2"), F.col("value").alias("v2"))
    s = a.join(b, "id").where("p1 < p2").groupBy("id").agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).alias("S"))
    n = series.groupBy("id").agg(F.count("*").cast("double").alias("n"))
    out = n.join(s, "id", "left").fillna(0.0, ["S"]).withColumn("var_S", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    return out.withColumn("z", F.when(F.col("S") == 0, 0.0).otherwise(safe(F.col("S") - F.signum("S"), F.sqrt("var_S"))))


def gi_star_by_period(panel: DataFrame, w: Weights) -> DataFrame:
    """(period, id, z) of Gi* with self weight 1, all periods in one plan."""
    edges = w.with_self(1.0).edges
    e = edges.join(panel.select("period", F.col("id").alias("j"), "y"), "j")
    sums = e.groupBy("period", F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    all_ = panel.groupBy("period").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.avg(F.col("y") * F.col("y")).alias("q"))
    t = sums.join(F.broadcast(all_), "period")
    s2 = F.col("q") - F.col("m") * F.col("m")
    spread = s2 * (F.col("n") * F.col("sw2") - F.col("sw") * F.col("sw")) / (F.col("n") - 1)
    return t.select("period", "id", safe(F.col("wy") - F.col("m") * F.col("sw"), F.sqrt(F.when(spread > 0, spread))).alias("z"))


def emerging_hotspots(z: DataFrame, threshold: float = 1.96) -> DataFrame:
    """(id, n_hot, last_hot, trend, category) of (period, id, z)."""
    mk = mann_kendall(z.select("id", "period", F.coalesce("z", F.lit(0.0)).alias("value"))).select("id", F.col("z").alias("trend"), "n")
    last = z.agg(F.max("period").alias("_last"))
    hot = (F.col("z") > threshold).cast("int")
    cold = (F.col("z") < -threshold).cast("int")
    s = z.crossJoin(F.broadcast(last)).groupBy("id").agg(F.sum(hot).alias("n_hot"), F.sum(cold).alias("n_cold"), F.max(F.when(F.col("period") == F.col("_last"), hot).otherwise(0)).alias("last_hot"))
    t = s.join(mk, "id")
    share = F.col("n_hot") / F.col("n")
    category = (
        F.when(F.col("n_hot") == 0, "none")
        .when((F.col("last_hot") == 1) & (F.col("n_hot") == 1), "new")
        .when((F.col("last_hot") == 1) & (F.col("n_cold") > 0), "oscillating")
        .when((share >= 0.9) & (F.col("trend") > 1.96), "intensifying")
        .when((share >= 0.9) & (F.col("trend") < -1.96), "diminishing")
        .when(share >= 0.9, "persistent")
        .otherwise("sporadic")
    )
    return t.select("id", "n_hot", "last_hot", "trend", category.alias("category"))


def space_time_variogram(samples: DataFrame, space_step: float, n_space: int, time_step: float, n_time: int) -> DataFrame:
    """(s_bin, t_bin, gamma, n_pairs) of (id, x, y, t, z)."""
    s = samples.select("id", "x", "y", F.col("t").cast("double").alias("t"), F.col("z").cast("double").alias("z")).where("t is not null")
    whole = s.select("id", "x", "y", "t", F.coalesce("z", F.lit(0.0)).alias("z"), F.col("z").isNotNull().cast("double").alias("ok"))

    def bins(v):
        dt = np.abs(v.left("t") - v.right("t"))
        s_bin = np.minimum(np.floor(v.d / space_step), n_space - 1)
        return np.where(dt < time_step * n_time, s_bin * n_time + np.minimum(np.floor(dt / time_step), n_time - 1), -1)

    def terms(v):
        known = v.left("ok") * v.right("ok")
        return (v.left("z") - v.right("z")) ** 2 * known, known

    out = pairs.tallied(whole, whole, space_step * n_space, bins, terms, n_space * n_time, ["g", "m"], ("t", "z", "ok"), ("t", "z", "ok"), half=True)
    s_bin, t_bin = F.floor(F.col("bin") / n_time).cast("int"), (F.col("bin") % n_time).cast("int")
    return out.select(s_bin.alias("s_bin"), t_bin.alias("t_bin"), (0.5 * F.col("g") / F.when(F.col("m") > 0, F.col("m"))).alias("gamma"), F.col("n").alias("n_pairs"))


def space_time_idw(samples: DataFrame, targets: DataFrame, scale: float, power: float = 2.0, k: int = 12) -> DataFrame:
    """(id, pred): inverse distance weights on sqrt(ds^2 + (scale dt)^2) of the k nearest; up to ``pairs.SMALL`` samples are broadcast."""
    if samples.limit(pairs.SMALL + 1).count() > pairs.SMALL:
        raise ValueError(f"space-time neighbours among more than {pairs.SMALL} samples")
    a = targets.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("t").alias("ti"))
    b = samples.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("t").alias("tj"), "z")
    dx, dy, dt = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"), scale * (F.col("ti") - F.col("tj"))
    d = a.join(F.broadcast(b), F.col("i") != F.col("j")).select("i", "j", "z", F.sqrt(dx * dx + dy * dy + dt * dt).alias("d"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k)
    w = F.when(F.col("d") > 0, F.pow("d", F.lit(-power)))
    return near.groupBy(F.col("i").alias("id")).agg(F.coalesce(F.min_by(F.when(F.col("d") == 0, F.col("z")), F.when(F.col("d") == 0, F.col("j"))), F.sum(w * F.col("z")) / F.sum(w)).alias("pred"))


def two_way_effects(panel: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope and n of y on x with means of entity (id) and period taken out."""
    dm = lambda c: F.col(c) - F.avg(c).over(Window.partitionBy("id")) - F.avg(c).over(Window.partitionBy("period"))
    whole = panel.agg(F.avg(y).alias("_gy"), F.avg(x).alias("_gx"))
    d = panel.withColumns({"_dy": dm(y), "_dx": dm(x)}).crossJoin(F.broadcast(whole)).select((F.col("_dy") + F.col("_gy")).alias("a"), (F.col("_dx") + F.col("_gx")).alias("b"))
    return d.agg((F.sum(F.col("a") * F.col("b")) / F.sum(F.col("b") * F.col("b"))).alias("slope"), F.count("*").alias("n"))
