"""Geographically weighted models: a pair table with kernel weights, sums by focal row, small batched solves.

Rows are (id, x, y, covariates, response). An adaptive bandwidth is a number of
neighbours: the kernel's h is the distance of that neighbour, so bisquare gives
it the weight 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions.kernels import COMPACT, kernel
from tessera.plans import pairs


def anisotropic(points: DataFrame, angle: float = 0.0, ratio: float = 1.0) -> DataFrame:
    """Coordinates turned by ``angle`` with the minor axis stretched by 1 / ratio, so that distances become anisotropic."""
    c, s = float(np.cos(angle)), float(np.sin(angle))
    u, v = c * F.col("x") + s * F.col("y"), (-s * F.col("x") + c * F.col("y")) / ratio
    return points.withColumns({"_u": u, "_v": v}).withColumns({"x": F.col("_u"), "y": F.col("_v")}).drop("_u", "_v")


def pair_weights(points: DataFrame, bandwidth: float, fixed: bool = False, name: str = "bisquare", targets: DataFrame | None = None) -> DataFrame:
    """(i, j, d, w) with w > 0, the focal row among its own neighbours."""
    f, targets = kernel(name), targets if targets is not None else points
    if fixed:
        found = pairs.within(targets, points, bandwidth, same=False) if name in COMPACT else pairs.every(targets, points, same=False)
        w = f(F.col("d"), F.lit(float(bandwidth)))
        return found.select("i", "j", "d", w.alias("w")).where("w > 0")
    k = int(bandwidth) + 1  # the row itself is the nearest
    near = pairs.nearest(targets, points, k, same=False, ranks=(k,))
    h = F.when(F.col(f"h{k}") > 0, F.col(f"h{k}")).otherwise(1.0)
    if name in COMPACT:
        return near.select("i", "j", "d", f(F.col("d"), h).alias("w")).where("w > 0")
    far = near.where("rank = 1").select("i", h.alias("h"))
    return pairs.every(targets, points, same=False).join(far, "i").select("i", "j", "d", f(F.col("d"), F.col("h")).alias("w")).where("w > 0")


def _sums(weights: DataFrame, rows: DataFrame, X: list[str], y: str | None, constant: bool = True) -> tuple[DataFrame, int]:
    """By focal row: sw, its own weight wii, the upper triangle of X'WX, X'Wy and y'Wy."""
    terms = ([F.lit(1.0)] if constant else []) + [F.col(c).cast("double") for c in X]
    p = len(terms)
    right = rows.select(F.col("id").alias("j"), *(t.alias(f"t{a}") for a, t in enumerate(terms)), *([F.col(y).cast("double").alias("yy")] if y else []))
    joined = weights.join(right, "j")
    w, t = F.col("w"), [F.col(f"t{a}") for a in range(p)]
    aggs = [F.sum(w).alias("sw"), F.sum(F.when(F.col("i") == F.col("j"), w)).alias("wii")] + [F.sum(w * t[a] * t[b]).alias(f"a{a}_{b}") for a in range(p) for b in range(a, p)]
    if y:
        aggs += [F.sum(w * t[a] * F.col("yy")).alias(f"b{a}") for a in range(p)] + [F.sum(w * F.col("yy") * F.col("yy")).alias("c")]
    return joined.groupBy("i").agg(*aggs), p


def _matrices(pdf: pd.DataFrame, p: int) -> np.ndarray:
    out = np.empty((len(pdf), p, p))
    for a in range(p):
        for b in range(a, p):
            out[:, a, b] = out[:, b, a] = pdf[f"a{a}_{b}"].to_numpy(float)
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses, with a small ridge where a matrix is singular."""
    scale = np.maximum(np.abs(a).max((1, 2), keepdims=True), 1e-300)
    bad = np.linalg.cond(a / scale) > 1e12
    return np.linalg.inv(np.where(bad[:, None, None], a + 1e-8 * scale * np.eye(a.shape[1]), a))


def gwr(rows: DataFrame, y: str, X: list[str], bandwidth: float, fixed: bool = False, name: str = "bisquare", weights: DataFrame | None = None) -> DataFrame:
    """(id, beta, se, t, fitted, residual, hat, sigma2, local_r2): weighted least squares at every row."""
    weights = weights if weights is not None else pair_weights(rows, bandwidth, fixed, name)
    sums, p = _sums(weights, rows, X, y)
    own = rows.select(F.col("id").alias("i"), F.array(F.lit(1.0), *(F.col(c).cast("double") for c in X)).alias("xi"), F.col(y).cast("double").alias("yi"))
    joined = sums.join(own, "i")

    def solve(batches):
        for pdf in batches:
            inv = _inverse(_matrices(pdf, p))
            b = pdf[[f"b{a}" for a in range(p)]].to_numpy(float)
            beta = np.einsum("nab,nb->na", inv, b)
            sw, c = pdf["sw"].to_numpy(float), pdf["c"].to_numpy(float)
            sse = np.maximum(c - (beta * b).sum(1), 0)
            s2 = sse / np.maximum(sw - p, 1e-10)
            se = np.sqrt(np.maximum(s2[:, None] * np.einsum("naa->na", inv), 0))
            x = np.stack(pdf["xi"].to_numpy())
            fitted = (x * beta).sum(1)
            hat = np.einsum("na,nab,nb->n", x, inv, x) * pdf["wii"].fillna(0).to_numpy(float)
            sst = c - b[:, 0] ** 2 / sw
            yield pd.DataFrame({"id": pdf["i"], "beta": list(beta), "se": list(se), "t": list(beta / np.where(se > 0, se, np.nan)), "fitted": fitted, "residual": pdf["yi"].to_numpy(float) - fitted, "hat": hat, "sigma2": s2, "local_r2": np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), 0.0)})

    return joined.mapInPandas(solve, "id long, beta array<double>, se array<double>, t array<double>, fitted double, residual double, hat double, sigma2 double, local_r2 double")


def aicc(rss: Column, n: Column, k: Column) -> Column:
    return n * F.log(rss / n) + n + k + 2 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1e-6))


def aic(rss: Column, n: Column, k: Column) -> Column:
    return n * F.log(rss / n) + 2 * k


def bic(rss: Column, n: Column, k: Column) -> Column:
    return n * F.log(rss / n) + k * F.log(n)


CRITERIA = {"AICc": aicc, "AIC": aic, "BIC": bic}


def _candidates(rows: DataFrame, columns: dict[str, str], candidates: list[int], name: str) -> DataFrame:
    """(bandwidth, i, j, w, columns of j): every candidate takes its share of the widest bandwidth's neighbours, found once."""
    values = rows.select("id", "x", "y", *(F.col(c).cast("double").alias(f"_{n}") for n, c in columns.items()))
    near = pairs.nearest(values, values, max(candidates) + 1, same=False, columns=tuple(f"_{n}" for n in columns), ranks=tuple(c + 1 for c in candidates))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("b"), F.col(f"h{c + 1}").alias("h")) for c in candidates))).alias("c")
    named = (F.col(f"_{n}").alias(n) for n in columns)
    joined = near.select("i", "j", "d", "rank", *named, each).where(F.col("rank") <= F.col("c.b") + 1)
    w = kernel(name)(F.col("d"), F.when(F.col("c.h") > 0, F.col("c.h")).otherwise(1.0))
    return joined.select(F.col("c.b").alias("bandwidth"), "i", "j", *columns, w.alias("w")).where("w > 0")


def gwr_fits(rows: DataFrame, y: str, x: str, candidates: list[int], name: str = "bisquare") -> DataFrame:
    """(bandwidth, rss, trace, n, cv) of one-covariate models for every adaptive bandwidth at once.

    The candidates are rows, and the closed form of two coefficients keeps every
    step in Columns. A row's neighbours come together, so they are summed before
    anything is shuffled.
    """
    w, xj, yj = F.col("w"), F.col("xj"), F.col("yj")
    s = _candidates(rows, {"xj": x, "yj": y}, candidates, name).groupBy("bandwidth", "i").agg(F.sum(w).alias("s"), F.sum(w * xj).alias("sx"), F.sum(w * xj * xj).alias("sxx"), F.sum(w * yj).alias("sy"), F.sum(w * xj * yj).alias("sxy"), F.sum(F.when(F.col("i") == F.col("j"), w)).alias("wii"))
    own = rows.select(F.col("id").alias("i"), F.col(x).cast("double").alias("xi"), F.col(y).cast("double").alias("yi"))
    d = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    b1 = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / d
    b0 = (F.col("sy") - b1 * F.col("sx")) / F.col("s")
    hat = F.col("wii") * (F.col("sxx") - 2 * F.col("xi") * F.col("sx") + F.col("xi") * F.col("xi") * F.col("s")) / d
    e = s.join(own, "i").select("bandwidth", (F.col("yi") - b0 - b1 * F.col("xi")).alias("e"), hat.alias("hat"))
    return e.groupBy("bandwidth").agg(F.sum(F.col("e") * F.col("e")).alias("rss"), F.sum("hat").alias("trace"), F.count("*").cast("double").alias("n"), F.avg(F.pow(F.col("e") / (1 - F.col("hat")), 2)).alias("cv"))


def fit_score(criterion: str) -> Column:
    """A criterion of ``gwr_fits``."""
    return F.col("cv") if criterion == "CV" else CRITERIA[criterion](F.col("rss"), F.col("n"), F.col("trace"))


def gwr_scores(rows: DataFrame, y: str, x: str, candidates: list[int], name: str = "bisquare", criterion: str = "AICc") -> DataFrame:
    """(bandwidth, rss, trace, score) of one-covariate models for every adaptive bandwidth at once."""
    return gwr_fits(rows, y, x, candidates, name).select("bandwidth", "rss", "trace", fit_score(criterion).alias("score"))


def select_bandwidth(rows: DataFrame, y: str, X: list[str], fixed: bool = False, name: str = "bisquare", criterion: str = "AICc", low: float | None = None, high: float | None = None, tries: int = 20) -> float:
    """The bandwidth of the least score: candidates in one plan for one covariate, else golden section over the range."""
    n = rows.count()
    low = low or (max(len(X) + 2, 5) if not fixed else 0.0)
    if not fixed and len(X) == 1:
        candidates = sorted({int(v) for v in np.linspace(low, high or n - 1, min(tries, n))})
        return float(gwr_scores(rows, y, X[0], candidates, name, criterion).orderBy("score", "bandwidth").first()["bandwidth"])
    if fixed and high is None:
        x0, y0, x1, y1 = rows.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        high = float(np.hypot(x1 - x0, y1 - y0))
        low = low or high / 20
    high = high or n - 1
    seen: dict[float, float] = {}

    def score(b):
        b = float(b) if fixed else float(round(b))
        if b not in seen:
            e = gwr(rows, y, X, b, fixed, name)
            r = e.agg(F.sum(F.col("residual") * F.col("residual")).alias("rss"), F.sum("hat").alias("k"), F.count("*").cast("double").alias("n"))
            seen[b] = r.select(CRITERIA[criterion](F.col("rss"), F.col("n"), F.col("k"))).first()[0]
        return seen[b]

    for _ in range(tries):
        a, b = high - 0.6180339887 * (high - low), low + 0.6180339887 * (high - low)
        low, high = (low, b) if score(a) < score(b) else (a, high)
        if high - low < (1e-3 * high if fixed else 1):
            break
    return min(seen, key=seen.get)


def predict(fitted: DataFrame, rows: DataFrame, targets: DataFrame, X: list[str]) -> DataFrame:
    """(id, pred) with the coefficients of the nearest calibrated row."""
    near = pairs.nearest(targets, rows, 1, same=False).select("i", "j").join(fitted.select(F.col("id").alias("j"), "beta"), "j")
    x = targets.select(F.col("id").alias("i"), F.array(F.lit(1.0), *(F.col(c).cast("double") for c in X)).alias("x"))
    dot = F.aggregate(F.zip_with("beta", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return near.join(x, "i").select(F.col("i").alias("id"), dot.alias("pred"))


def significance(fitted: DataFrame, n: int, alpha: float = 0.05, correction: str = "bh") -> DataFrame:
    """(id, coefficient, t, p_value, p_adjusted, reject) for each coefficient, on n minus the trace of the hat matrix."""
    from tessera.operators.esda import adjusted_p
    from tessera.plans.graph import cut

    fitted = cut(fitted.select("id", "t", "hat"))
    trace = fitted.agg(F.sum("hat").alias("_k"))
    long = fitted.select("id", F.posexplode("t").alias("coefficient", "t")).crossJoin(F.broadcast(trace))
    p = long.withColumn("p_value", special.as_column(special.t_two_sided, F.col("t"), n - F.col("_k"))).drop("_k")
    p = cut(p)
    m = fitted.select(F.size("t")).first()[0]
    each = [adjusted_p(p.where(F.col("coefficient") == c), "p_value", "fdr" if correction == "bh" else "none", alpha) for c in range(m)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def gwss(rows: DataFrame, columns: list[str], bandwidth: float, fixed: bool = False, name: str = "bisquare", quantile: bool = False) -> DataFrame:
    """(id, and for each column mean, var, std, skew, kurt; for each pair corr; with ``quantile`` median and iqr by value)."""
    weights = pair_weights(rows, bandwidth, fixed, name)
    right = rows.select(F.col("id").alias("j"), *(F.col(c).cast("double").alias(c) for c in columns))
    joined = weights.join(right, "j")
    mean = joined.groupBy("i").agg(F.sum("w").alias("_sw"), *((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"{c}_mean") for c in columns))
    both = joined.join(mean, "i").withColumn("p", F.col("w") / F.col("_sw"))
    z = {c: F.col(c) - F.col(f"{c}_mean") for c in columns}
    aggs = [F.sum(F.col("p") * F.pow(z[c], k)).alias(f"{c}_m{k}") for c in columns for k in (2, 3, 4)]
    duos = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    aggs += [F.sum(F.col("p") * z[a] * z[b]).alias(f"{a}_{b}_cov") for a, b in duos]
    m = both.groupBy("i", *(f"{c}_mean" for c in columns)).agg(*aggs)
    out = [F.col("i").alias("id")]
    for c in columns:
        m2, sd = F.col(f"{c}_m2"), F.sqrt(f"{c}_m2")
        some = F.when(m2 > 0, m2)
        out += [F.col(f"{c}_mean"), m2.alias(f"{c}_var"), sd.alias(f"{c}_std"), (F.col(f"{c}_m3") / F.pow(some, F.lit(1.5))).alias(f"{c}_skew"), (F.col(f"{c}_m4") / (some * some) - 3).alias(f"{c}_kurt")]
    out += [(F.col(f"{a}_{b}_cov") / F.sqrt(F.when(F.col(f"{a}_m2") * F.col(f"{b}_m2") > 0, F.col(f"{a}_m2") * F.col(f"{b}_m2")))).alias(f"{a}_{b}_corr") for a, b in duos]
    found = m.select(*out)
    if quantile:
        from pyspark.sql.window import Window

        for c in columns:
            run = F.sum("p").over(Window.partitionBy("i").orderBy(c, "j").rowsBetween(Window.unboundedPreceding, 0))
            cum = both.select("i", "j", c, "p").withColumn("_c", run)
            q = lambda t: F.min(F.when(F.col("_c") >= t - 1e-12, F.col(c)))  # noqa: B023, E731
            found = found.join(cum.groupBy(F.col("i").alias("id")).agg(q(0.5).alias(f"{c}_median"), (q(0.75) - q(0.25)).alias(f"{c}_iqr")), "id")
    return found


def st_pair_weights(rows: DataFrame, bandwidth: int, scale: float, name: str = "bisquare") -> DataFrame:
    """(i, j, d, w) by adaptive bandwidth on the space-time distance; ``rows`` has t."""
    placed, k = rows.select("id", "x", "y", F.col("t").cast("double").alias("t")), int(bandwidth) + 1
    near = pairs.nearest(placed, placed, k, same=False, time=float(scale), ranks=(k,))
    h = F.when(F.col(f"h{k}") > 0, F.col(f"h{k}")).otherwise(1.0)
    return near.select("i", "j", "d", kernel(name)(F.col("d"), h).alias("w")).where("w > 0")


def gtwr(rows: DataFrame, y: str, X: list[str], bandwidth: int, scale: float = 1.0, name: str = "bisquare") -> DataFrame:
    """GWR on space-time distances sqrt(ds^2 + scale dt^2)."""
    return gwr(rows, y, X, bandwidth, False, name, st_pair_weights(rows, bandwidth, scale, name))


def gtwr_scores(rows: DataFrame, y: str, X: list[str], bandwidths: list[int], scales: list[float], name: str = "bisquare", criterion: str = "AICc") -> DataFrame:
    """(bandwidth, scale, rss, trace, score) of every bandwidth with every weight of time in the distance."""
    out = None
    for scale in scales:
        for b in bandwidths:
            e = gtwr(rows, y, X, b, scale, name).agg(F.sum(F.col("residual") * F.col("residual")).alias("rss"), F.sum("hat").alias("trace"), F.count("*").cast("double").alias("n"))
            one = e.select(F.lit(int(b)).alias("bandwidth"), F.lit(float(scale)).alias("scale"), "rss", "trace", CRITERIA[criterion](F.col("rss"), F.col("n"), F.col("trace")).alias("score"))
            out = one if out is None else out.unionByName(one)
    return out


def select_gtwr(rows: DataFrame, y: str, X: list[str], bandwidths: list[int], scales: list[float], name: str = "bisquare", criterion: str = "AICc") -> tuple[int, float]:
    best = gtwr_scores(rows, y, X, bandwidths, scales, name, criterion).orderBy("score", "bandwidth", "scale").first()
    return best.bandwidth, best.scale


def smooth_scores(rows: DataFrame, x: str, r: str, candidates: list[int], name: str = "bisquare") -> DataFrame:
    """(bandwidth, rss, trace, score): AICc of r on x alone, without a constant, for every adaptive bandwidth in one plan."""
    w, xj, rj = F.col("w"), F.col("xj"), F.col("rj")
    s = _candidates(rows, {"xj": x, "rj": r}, candidates, name).groupBy("bandwidth", "i").agg(F.sum(w * xj * xj).alias("xx"), F.sum(w * xj * rj).alias("xr"), F.sum(F.when(F.col("i") == F.col("j"), w)).alias("wii"))
    own = rows.select(F.col("id").alias("i"), F.col(x).cast("double").alias("xi"), F.col(r).cast("double").alias("ri"))
    some = F.when(F.col("xx") > 0, F.col("xx"))
    e = s.join(own, "i").select("bandwidth", (F.col("ri") - F.coalesce(F.col("xr") / some, F.lit(0.0)) * F.col("xi")).alias("e"), F.coalesce(F.col("wii") * F.col("xi") * F.col("xi") / some, F.lit(0.0)).alias("hat"))
    out = e.groupBy("bandwidth").agg(F.sum(F.col("e") * F.col("e")).alias("rss"), F.sum("hat").alias("trace"), F.count("*").cast("double").alias("n"))
    return out.select("bandwidth", "rss", "trace", aicc(F.col("rss"), F.col("n"), F.col("trace")).alias("score"))


def select_mgwr(rows: DataFrame, y: str, X: list[str], candidates: list[int], sweeps: int = 3, name: str = "bisquare") -> list[int]:
    """A bandwidth for each coefficient (the intercept first): back-fitting in which each term takes the candidate of the least AICc for what the others leave."""
    from tessera.plans.graph import cut

    terms = ["_c0", *X]
    start = gwr(rows, y, X, select_bandwidth(rows, y, X, name=name, tries=6), False, name).select("id", *(F.col("beta")[k].alias(f"b{k}") for k in range(len(terms))))
    state = cut(rows.select("id", "x", "y", F.lit(1.0).alias("_c0"), *(F.col(c).cast("double").alias(f"_{c}") for c in X), F.col(y).cast("double").alias("_y")).join(start, "id"))
    columns, chosen = ["_c0", *(f"_{c}" for c in X)], [0] * len(terms)
    for _ in range(sweeps):
        before = list(chosen)
        for k, c in enumerate(columns):
            part = F.col("_y") - sum((F.col(f"b{m}") * F.col(t) for m, t in enumerate(columns) if m != k), F.lit(0.0))
            now = state.withColumn("_r", part)
            chosen[k] = int(smooth_scores(now, c, "_r", candidates, name).orderBy("score", "bandwidth").first()["bandwidth"])
            right = now.select(F.col("id").alias("j"), F.col(c).alias("xj"), "_r")
            s = pair_weights(rows, chosen[k], False, name).join(right, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("xj") * F.col("_r")) / F.sum(F.col("w") * F.col("xj") * F.col("xj"))).alias("new"))
            state = cut(state.join(s.withColumnRenamed("i", "id"), "id").withColumn(f"b{k}", F.coalesce("new", F.lit(0.0))).drop("new"))
        if chosen == before:
            break
    return chosen


def mgwr(rows: DataFrame, y: str, X: list[str], bandwidths: list[float], sweeps: int = 5, tol: float = 1e-5, name: str = "bisquare") -> DataFrame:
    """(id, beta): back-fitting, each coefficient (the intercept first) with its own adaptive bandwidth; every sweep is cut into the checkpoint folder."""
    from tessera.plans.graph import cut

    terms = ["_c0", *X]
    weights = [pair_weights(rows, b, False, name).select("i", "j", "w") for b in bandwidths]
    base = rows.select("id", F.lit(1.0).alias("_c0"), *(F.col(c).cast("double").alias(c) for c in X), F.col(y).cast("double").alias("_y"))
    state = base.select("id", *terms, "_y", *(F.lit(0.0).alias(f"b{k}") for k in range(len(terms))))
    for _ in range(sweeps):
        before = state
        for k, c in enumerate(terms):
            part = F.col("_y") - sum((F.col(f"b{m}") * F.col(t) for m, t in enumerate(terms) if m != k), F.lit(0.0))
            right = state.select(F.col("id").alias("j"), F.col(c).alias("xj"), part.alias("rj"))
            s = weights[k].join(right, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("xj") * F.col("rj")) / F.sum(F.col("w") * F.col("xj") * F.col("xj"))).alias("new"))
            state = state.join(s.withColumnRenamed("i", "id"), "id").withColumn(f"b{k}", F.coalesce("new", F.lit(0.0))).drop("new")
        state = cut(state)
        moved = state.select("id", *(F.col(f"b{k}").alias(f"n{k}") for k in range(len(terms)))).join(before.select("id", *(f"b{k}" for k in range(len(terms)))), "id")
        change = moved.agg(sum((F.sum(F.pow(F.col(f"n{k}") - F.col(f"b{k}"), 2)) for k in range(len(terms))), F.lit(0.0))).first()[0]
        if change < tol:
            break
    fitted = sum((F.col(f"b{k}") * F.col(t) for k, t in enumerate(terms)), F.lit(0.0))
    return state.select("id", F.array(*(f"b{k}" for k in range(len(terms)))).alias("beta"), fitted.alias("fitted"), (F.col("_y") - fitted).alias("residual"))


def mixed_gwr(rows: DataFrame, y: str, fixed_vars: list[str], varying: list[str], bandwidth: float, rounds: int = 5, name: str = "bisquare") -> tuple[dict[str, float], DataFrame]:
    """Global coefficients of ``fixed_vars`` and local ones of ``varying``, by turns of local and global least squares."""
    from tessera.operators.regression import normal_equations
    from tessera.plans.graph import cut

    beta = np.zeros(len(fixed_vars))
    local = None
    for _ in range(rounds):
        rest = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(fixed_vars, beta, strict=True)), F.lit(0.0))
        local = cut(gwr(rows.withColumn("_rest", rest), "_rest", varying, bandwidth, False, name))
        if not fixed_vars:
            break
        both = rows.join(local.select("id", F.col("fitted").alias("_f")), "id")
        s = normal_equations(both, [F.col(c) for c in fixed_vars], F.col(y) - F.col("_f"))
        beta = np.linalg.solve(s["xtx"], s["xty"])
    return dict(zip(fixed_vars, map(float, beta), strict=True)), local


def _grouped(rows: DataFrame, columns: list[str], weights: DataFrame) -> DataFrame:
    """(i, w array, values array of arrays): each focal row's neighbours, as many as the bandwidth allows."""
    right = rows.select(F.col("id").alias("j"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))
    e = weights.join(right, "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w", "v"))).alias("e"))
    return e.select("i", F.col("e.w").alias("w"), F.col("e.v").alias("v"))


def gwglm(rows: DataFrame, y: str, X: list[str], bandwidth: float, family: str = "poisson", fixed: bool = False, name: str = "bisquare", rounds: int = 50, tol: float = 1e-8) -> DataFrame:
    """(id, beta, se, fitted): local iteratively weighted least squares; gaussian, poisson (log) or binomial (logit)."""
    links = {"gaussian": (lambda e: e, lambda m: np.ones_like(m)), "poisson": (lambda e: np.exp(np.clip(e, -20, 20)), lambda m: np.maximum(m, 1e-10)), "binomial": (lambda e: 1 / (1 + np.exp(-np.clip(e, -30, 30))), lambda m: np.maximum(m * (1 - m), 1e-10))}
    inverse, variance = links[family]
    data = _grouped(rows, [*X, y], pair_weights(rows, bandwidth, fixed, name))
    own = rows.select(F.col("id").alias("i"), F.array(F.lit(1.0), *(F.col(c).cast("double") for c in X)).alias("xi"))

    def solve(batches):
        for pdf in batches:
            out = []
            for i, w, v, xi in zip(pdf["i"], pdf["w"], pdf["v"], pdf["xi"], strict=True):
                v, w, xi = np.stack(v), np.asarray(w), np.asarray(xi)
                x, t = np.column_stack([np.ones(len(v)), v[:, :-1]]), v[:, -1]
                beta = np.zeros(x.shape[1])
                if family == "poisson":
                    beta[0] = np.log(max(np.average(t, weights=w), 1e-10))
                for _ in range(rounds if family != "gaussian" else 1):
                    eta = x @ beta
                    mu = inverse(eta)
                    vv = variance(mu)
                    z = eta + (t - mu) / vv if family != "gaussian" else t
                    a = (x * (w * vv)[:, None]).T @ x + 1e-8 * np.eye(x.shape[1])
                    new = np.linalg.solve(a, x.T @ (w * vv * z))
                    done = np.abs(new - beta).max() < tol
                    beta = new
                    if done:
                        break
                mu = inverse(x @ beta)
                inv = np.linalg.inv((x * (w * variance(mu))[:, None]).T @ x + 1e-8 * np.eye(x.shape[1]))
                scale = (w * (t - mu) ** 2).sum() / max(w.sum() - x.shape[1], 1e-10) if family == "gaussian" else 1.0
                out.append((i, beta, np.sqrt(scale * np.diag(inv)), float(inverse(xi @ beta))))
            yield pd.DataFrame(out, columns=["id", "beta", "se", "fitted"])

    return data.join(own, "i").mapInPandas(solve, "id long, beta array<double>, se array<double>, fitted double")


def gw_classify(rows: DataFrame, y: str, X: list[str], bandwidth: float, threshold: float = 0.5, name: str = "bisquare") -> DataFrame:
    """(id, probability, label, correct) of a 0/1 response by local logistic regression."""
    p = gwglm(rows, y, X, bandwidth, "binomial", name=name).select("id", F.col("fitted").alias("probability"))
    label = (F.col("probability") >= threshold).cast("int")
    return p.join(rows.select("id", F.col(y).cast("int").alias("_y")), "id").select("id", "probability", label.alias("label"), (label == F.col("_y")).alias("correct"))


def gwpca(rows: DataFrame, columns: list[str], bandwidth: float, components: int = 2, fixed: bool = False, name: str = "bisquare", robust: bool = False) -> DataFrame:
    """(id, eigenvalues, explained, loadings, winner): local weighted covariances; ``robust`` centres them by the global medians."""
    centre = None
    if robust:
        centre = rows.agg(*(F.percentile(c, 0.5).alias(c) for c in columns)).first()
    sums, p = _sums(pair_weights(rows, bandwidth, fixed, name), rows, columns, None)

    def solve(batches):
        for pdf in batches:
            m = _matrices(pdf, p)
            sw = m[:, 0, 0]
            mean = m[:, 0, 1:] / sw[:, None]
            c = np.tile(np.array(centre, float), (len(pdf), 1)) if centre is not None else mean
            cov = m[:, 1:, 1:] / sw[:, None, None] - mean[:, :, None] * c[:, None, :] - c[:, :, None] * mean[:, None, :] + c[:, :, None] * c[:, None, :]
            value, vector = np.linalg.eigh(cov)
            value, vector = value[:, ::-1], vector[:, :, ::-1]
            total = np.maximum(value.sum(1, keepdims=True), 1e-300)
            yield pd.DataFrame({"id": pdf["i"], "eigenvalues": list(value[:, :components]), "explained": list((value / total)[:, :components]), "loadings": [v[:, :components].T.ravel() for v in vector], "winner": [columns[int(np.abs(v[:, 0]).argmax())] for v in vector]})

    return sums.mapInPandas(solve, "id long, eigenvalues array<double>, explained array<double>, loadings array<double>, winner string")


def local_collinearity(rows: DataFrame, X: list[str], bandwidth: float, fixed: bool = False, name: str = "bisquare") -> DataFrame:
    """(id, condition, vif): condition number of X'WX and weighted variance inflation of each covariate."""
    sums, p = _sums(pair_weights(rows, bandwidth, fixed, name), rows, X, None)

    def solve(batches):
        for pdf in batches:
            m = _matrices(pdf, p)
            sw = m[:, 0, 0]
            mean = m[:, 0, 1:] / sw[:, None]
            cov = m[:, 1:, 1:] / sw[:, None, None] - mean[:, :, None] * mean[:, None, :]
            sd = np.sqrt(np.maximum(np.einsum("naa->na", cov), 1e-300))
            corr = cov / sd[:, :, None] / sd[:, None, :]
            yield pd.DataFrame({"id": pdf["i"], "condition": np.linalg.cond(m), "vif": list(np.einsum("naa->na", np.linalg.pinv(corr)))})

    return sums.mapInPandas(solve, "id long, condition double, vif array<double>")


def variability_test(rows: DataFrame, y: str, X: list[str], bandwidth: float, n: int = 19, seed: int = 0) -> DataFrame:
    """(coefficient, variance, p_value): variances of the local coefficients against models with the locations permuted.

    The neighbours of the locations are found once; each replicate deals the
    rows' values to them anew.
    """
    from tessera.plans.graph import cut
    from tessera.plans.resample import permuted

    var = lambda f: f.select(F.posexplode("beta").alias("coefficient", "b")).groupBy("coefficient").agg(F.var_pop("b").alias("v"))
    weights = cut(pair_weights(rows, bandwidth))
    seen = var(gwr(rows, y, X, bandwidth, weights=weights)).withColumnRenamed("v", "variance")
    dealt = cut(permuted(rows.select("id", F.col("id").alias("y")), n, seed)).withColumnRenamed("y", "source")
    values = rows.select(F.col("id").alias("source"), y, *X)
    sims = None
    for s in range(n):
        moved = dealt.where(F.col("rep") == s).join(values, "source").select("id", y, *X)
        one = var(gwr(moved, y, X, bandwidth, weights=weights))
        sims = one if sims is None else sims.unionByName(one)
    both = sims.join(seen, "coefficient").groupBy("coefficient", "variance").agg(F.sum(F.when(F.col("v") >= F.col("variance"), 1).otherwise(0)).alias("up"))
    return both.select("coefficient", "variance", ((F.col("up") + 1) / (n + 1.0)).alias("p_value"))


def f3_test(fitted: DataFrame) -> DataFrame:
    """(coefficient, F, p_value): variance of a coefficient over the rows against the error variance."""
    e = fitted.agg(F.sum(F.col("residual") * F.col("residual")).alias("rss"), F.sum("hat").alias("k"), F.count("*").cast("double").alias("n"))
    v = fitted.select(F.posexplode("beta").alias("coefficient", "b")).groupBy("coefficient").agg(F.var_samp("b").alias("v"))
    out = v.crossJoin(F.broadcast(e)).withColumn("F", F.col("v") / (F.col("rss") / (F.col("n") - F.col("k"))))
    return out.withColumn("p_value", special.as_column(special.f_sf, F.col("F"), F.col("n") - 1, F.col("n") - F.col("k"))).select("coefficient", "F", "p_value")


def network_distances(nodes: DataFrame, edges: DataFrame, points: DataFrame, most_hops: int = 100) -> DataFrame:
    """(i, j, d): hops between points snapped to their nearest nodes, by breadth-first joins."""
    snapped = pairs.nearest(points, nodes, 1, same=False).select(F.col("i").alias("id"), F.col("j").alias("node"))
    both = edges.select("i", "j").union(edges.select("j", "i")).distinct()
    start = snapped.select("node").distinct()
    seen = start.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("d"))
    front = seen
    from tessera.plans.graph import cut

    for hop in range(1, most_hops + 1):
        step = front.join(both, front["b"] == both["i"]).select("a", F.col("j").alias("b")).distinct()
        front = cut(step.join(seen, ["a", "b"], "left_anti").withColumn("d", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionAll(front))
    i, j = (snapped.select(F.col("id").alias(n), F.col("node").alias(m)) for n, m in (("i", "a"), ("j", "b")))
    return seen.join(i, "a").join(j, "b").select("i", "j", F.col("d").cast("double").alias("d"))


def network_gwr(rows: DataFrame, y: str, X: list[str], nodes: DataFrame, edges: DataFrame, bandwidth: float, name: str = "bisquare") -> DataFrame:
    """GWR with a fixed bandwidth in hops."""
    d = network_distances(nodes, edges, rows.select("id", "x", "y"))
    w = d.select("i", "j", "d", kernel(name)(F.col("d"), F.lit(float(bandwidth))).alias("w")).where("w > 0")
    return gwr(rows, y, X, bandwidth, True, name, w)


def moran_of_residuals(fitted: DataFrame, rows: DataFrame, k: int = 8) -> DataFrame:
    from tessera.operators.esda import moran
    from tessera.operators.weights import knn

    return moran(fitted.select("id", F.col("residual").alias("y")), knn(rows.select("id", "x", "y"), k))


def _tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, rng, n_features: int):
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return float(np.average(y, weights=w))
    best = None
    for f in rng.choice(x.shape[1], n_features, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        xs, ws, ys = x[order, f], w[order], y[order]
        cw, cy, cyy = np.cumsum(ws), np.cumsum(ws * ys), np.cumsum(ws * ys * ys)
        at = np.arange(least - 1, len(ys) - least)
        at = at[xs[at] < xs[at + 1]]
        if not len(at):
            continue
        rw = np.maximum(cw[-1] - cw[at], 1e-300)
        sse = cyy[-1] - cy[at] ** 2 / np.maximum(cw[at], 1e-300) - (cy[-1] - cy[at]) ** 2 / rw
        k = int(sse.argmin())
        if best is None or sse[k] < best[0]:
            best = sse[k], f, (xs[at[k]] + xs[at[k] + 1]) / 2
    if best is None:
        return float(np.average(y, weights=w))
    _, f, cut_ = best
    left = x[:, f] <= cut_
    return f, cut_, _tree(x[left], y[left], w[left], depth - 1, least, rng, n_features), _tree(x[~left], y[~left], w[~left], depth - 1, least, rng, n_features)


def _tree_predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut_, a, b = tree
    left = x[:, f] <= cut_
    out = np.empty(len(x))
    out[left], out[~left] = _tree_predict(a, x[left]), _tree_predict(b, x[~left])
    return out


def gw_forest(rows: DataFrame, y: str, X: list[str], bandwidth: int, trees: int = 20, depth: int = 6, local_weight: float = 0.5, boosting: bool = False, rate: float = 0.1, name: str = "bisquare", seed: int = 0) -> DataFrame:
    """(id, local, global, pred): a weighted forest (or boosted trees) about every row, blended with one global model of pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    v = VectorAssembler(inputCols=X, outputCol="_features").transform(rows.select("id", *(F.col(c).cast("double").alias(c) for c in X), F.col(y).cast("double").alias("_label")))
    kind = dict(featuresCol="_features", labelCol="_label", maxDepth=depth, seed=seed)
    model = GBTRegressor(maxIter=trees, stepSize=rate, **kind) if boosting else RandomForestRegressor(numTrees=trees, **kind)
    world = model.fit(v).transform(v).select("id", F.col("prediction").alias("global"))
    data = _grouped(rows, [*X, y], pair_weights(rows, bandwidth, False, name))
    own = rows.select(F.col("id").alias("i"), F.array(*(F.col(c).cast("double") for c in X)).alias("xi"))

    def solve(batches):
        for pdf in batches:
            out = []
            for i, w, t, xi in zip(pdf["i"], pdf["w"], pdf["v"], pdf["xi"], strict=True):
                t, w, xi = np.stack(t), np.asarray(w), np.asarray(xi)[None]
                keep = w / w.max() > 0.01
                x, z, w = t[keep, :-1], t[keep, -1], w[keep]
                rng = np.random.default_rng((seed, int(i)))
                if boosting:
                    base = float(np.average(z, weights=w))
                    f, here = np.full(len(z), base), base
                    for _ in range(trees):
                        tree = _tree(x, z - f, w, min(depth, 3), 2, rng, x.shape[1])
                        f, here = f + rate * _tree_predict(tree, x), here + rate * float(_tree_predict(tree, xi)[0])
                    out.append((i, here))
                else:
                    some = max(1, round(np.sqrt(x.shape[1])))
                    draws = [rng.integers(len(z), size=len(z)) for _ in range(trees)]
                    out.append((i, float(np.mean([_tree_predict(_tree(x[d], z[d], w[d], depth, 2, rng, some), xi)[0] for d in draws]))))
            yield pd.DataFrame(out, columns=["id", "local"])

    local = data.join(own, "i").mapInPandas(solve, "id long, local double")
    return local.join(world, "id").withColumn("pred", local_weight * F.col("local") + (1 - local_weight) * F.col("global"))
