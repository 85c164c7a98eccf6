"""Rates of small areas: standardisation, exact limits, empirical Bayes, evaluation. Areas are (id, O, E)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators.esda import safe
from tessera.operators.weights import Weights


def checked(areas: DataFrame) -> DataFrame:
    if areas.where("O is null or E is null or O < 0 or E <= 0").limit(1).count():
        raise ValueError("counts must be at least 0 and expected counts positive")
    return areas


def expected_counts(areas: DataFrame, population: str = "pop", observed: str = "O", stratum: str | None = None) -> DataFrame:
    """(id, O, E): the overall rate (of each stratum) times the population, summed by id."""
    keys = [stratum] if stratum else []
    rate = areas.groupBy(*keys).agg((F.sum(observed) / F.sum(population)).alias("_rate"))
    joined = areas.join(F.broadcast(rate), keys) if keys else areas.crossJoin(F.broadcast(rate))
    return joined.groupBy("id").agg(F.sum(F.col(observed).cast("double")).alias("O"), F.sum(F.col(population) * F.col("_rate")).alias("E"))


def smr(areas: DataFrame) -> DataFrame:
    return areas.select("id", "O", "E", (F.col("O") / F.col("E")).alias("smr"))


def garwood(areas: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(id, smr, lo, hi): exact limits."""
    return areas.select("id", (F.col("O") / F.col("E")).alias("smr"), special.as_column(lambda o, e: special.garwood(o, e, alpha)[0], F.col("O"), F.col("E")).alias("lo"), special.as_column(lambda o, e: special.garwood(o, e, alpha)[1], F.col("O"), F.col("E")).alias("hi"))


def excess_p(areas: DataFrame) -> DataFrame:
    """(id, p_value): P(X >= O) for a Poisson X of mean E."""
    return areas.select("id", special.as_column(lambda o, e: np.where(o > 0, special.poisson_sf(o - 1, e), 1.0), F.col("O"), F.col("E")).alias("p_value"))


def funnel(expected: DataFrame, levels: tuple[float, ...] = (0.95, 0.998)) -> DataFrame:
    """(E, level, lo, hi): Poisson limits of O / E."""
    e = expected.select("E", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    lo = special.as_column(lambda m, p: special.poisson_ppf((1 - p) / 2, m) / m, F.col("E"), F.col("level"))
    hi = special.as_column(lambda m, p: special.poisson_ppf((1 + p) / 2, m) / m, F.col("E"), F.col("level"))
    return e.select("E", "level", lo.alias("lo"), hi.alias("hi"))


def eb_moments(areas: DataFrame) -> DataFrame:
    """(id, raw, estimate, shrinkage): Marshall's moments of a gamma prior; without variance between areas the mean."""
    m = areas.agg((F.sum("O") / F.sum("E")).alias("m"), F.avg("E").alias("mean_e"), F.sum("E").alias("se"))
    r = areas.crossJoin(F.broadcast(m))
    s2 = r.agg((F.sum(F.col("E") * F.pow(F.col("O") / F.col("E") - F.col("m"), 2)) / F.max("se") - F.max("m") / F.max("mean_e")).alias("s2"))
    r = r.crossJoin(F.broadcast(s2))
    a, b = F.col("m") * F.col("m") / F.col("s2"), F.col("m") / F.col("s2")
    est = F.when(F.col("s2") > 0, (a + F.col("O")) / (b + F.col("E"))).otherwise(F.col("m"))
    return r.select("id", (F.col("O") / F.col("E")).alias("raw"), est.alias("estimate"), F.when(F.col("s2") > 0, b / (b + F.col("E"))).otherwise(1.0).alias("shrinkage"))


def eb_mle(areas: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(id, raw, estimate, lo, hi): gamma prior by maximum likelihood.

    The likelihood is summed in Spark for a whole grid of parameters at once,
    and the grid closes in on the best.
    """
    import math

    row = areas.agg(F.sum("O") / F.sum("E"), F.count("*")).first()
    la, lm, width = 1.0, math.log(max(row[0], 1e-9)), 4.0
    lgamma = lambda c: special.as_column(special._lgamma, c)
    spark = areas.sparkSession
    for _ in range(6):
        grid = spark.createDataFrame([(math.exp(la + width * a / 4), math.exp(lm + width * b / 4)) for a in range(-4, 5) for b in range(-4, 5)], "a double, m double")
        t = areas.crossJoin(F.broadcast(grid)).withColumn("b", F.col("a") / F.col("m"))
        ll = lgamma(F.col("O") + F.col("a")) - lgamma(F.col("a")) + F.col("a") * F.log(F.col("b") / (F.col("b") + F.col("E"))) + F.col("O") * F.log(F.col("E") / (F.col("b") + F.col("E")))
        best = t.withColumn("ll", ll).groupBy("a", "m").agg(F.sum("ll").alias("ll")).orderBy(F.desc("ll"), "a", "m").first()
        la, lm, width = math.log(best["a"]), math.log(best["m"]), width / 3
    a, b = math.exp(la), math.exp(la - lm)
    shape, rate = a + F.col("O"), b + F.col("E")
    q = lambda p: special.as_column(lambda s, r: special.gamma_ppf(np.full(len(s), p), s, r), shape, rate)
    return areas.select("id", (F.col("O") / F.col("E")).alias("raw"), (shape / rate).alias("estimate"), q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi"))


def james_stein(estimates: DataFrame, method: str = "normal", positive: bool = True) -> DataFrame:
    """(id, raw, estimate, shrinkage) of (id, est, var): James and Stein's single factor, or a normal prior by DerSimonian and Laird."""
    x, v = F.col("est"), F.col("var")
    if method == "james-stein":
        m = estimates.agg(F.avg("est").alias("m"), F.avg("var").alias("v"), F.count("*").alias("k"))
        s = estimates.crossJoin(F.broadcast(m)).agg(F.sum(F.pow(x - F.col("m"), 2)).alias("ss"), F.max("m").alias("m"), F.max("v").alias("v"), F.max("k").alias("k"))
        c = 1 - (F.col("k") - 3) * F.col("v") / F.col("ss")
        c = F.greatest(F.lit(0.0), c) if positive else c
        t = estimates.crossJoin(F.broadcast(s.withColumn("c", c).select("m", "c")))
        return t.select("id", x.alias("raw"), (F.col("m") + F.col("c") * (x - F.col("m"))).alias("estimate"), (1 - F.col("c")).alias("shrinkage"))
    if method != "normal":
        raise ValueError(f"unknown method {method!r}")
    w = 1 / v
    m = estimates.agg((F.sum(x * w) / F.sum(w)).alias("mu"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.count("*").alias("k"))
    q = estimates.crossJoin(F.broadcast(m)).agg(F.sum(w * F.pow(x - F.col("mu"), 2)).alias("q"), F.max("sw").alias("sw"), F.max("sw2").alias("sw2"), F.max("k").alias("k"))
    tau = q.select(F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / (F.col("sw") - F.col("sw2") / F.col("sw"))).alias("tau2"))
    t = estimates.crossJoin(F.broadcast(tau))
    star = 1 / (v + F.col("tau2"))
    mean = t.agg((F.sum(x * star) / F.sum(star)).alias("m"))
    t = t.crossJoin(F.broadcast(mean)).withColumn("b", v / (v + F.col("tau2")))
    return t.select("id", x.alias("raw"), (F.col("b") * F.col("m") + (1 - F.col("b")) * x).alias("estimate"), F.col("b").alias("shrinkage"))


def eb_local(areas: DataFrame, w: Weights, include_self: bool = True) -> DataFrame:
    """(id, raw, estimate): Marshall's estimate towards the mean of the neighbourhood; islands towards the overall one."""
    hood = w.edges.where("i != j").select("i", "j")
    alone = w.islands().select(F.col("id").alias("i"))
    if include_self:
        hood = hood.unionAll(w.nodes.select(F.col("id").alias("i"), F.col("id").alias("j")))
    right = areas.select(F.col("id").alias("j"), "O", "E")
    h = hood.join(right, "j")
    m = h.groupBy("i").agg((F.sum("O") / F.sum("E")).alias("m"), F.sum("E").alias("se"), F.avg("E").alias("me"))
    s = h.join(m, "i").groupBy("i", "m").agg((F.sum(F.col("E") * F.pow(F.col("O") / F.col("E") - F.col("m"), 2)) / F.max("se") - F.max("m") / F.max("me")).alias("s2"))
    whole = areas.agg((F.sum("O") / F.sum("E")).alias("gm"), F.avg("E").alias("ge"), F.sum("E").alias("gs"))
    g = areas.crossJoin(F.broadcast(whole)).agg(F.max("gm").alias("gm"), (F.sum(F.col("E") * F.pow(F.col("O") / F.col("E") - F.col("gm"), 2)) / F.max("gs") - F.max("gm") / F.max("ge")).alias("gs2"))
    t = areas.join(s.withColumnRenamed("i", "id"), "id", "left").join(alone.select(F.col("i").alias("id"), F.lit(True).alias("_alone")), "id", "left").crossJoin(F.broadcast(g))
    mean = F.when(F.col("_alone"), F.col("gm")).otherwise(F.col("m"))
    s2 = F.when(F.col("_alone"), F.col("gs2")).otherwise(F.col("s2"))
    raw = F.col("O") / F.col("E")
    c = F.when(s2 > 0, s2 / (s2 + mean / F.col("E"))).otherwise(0.0)
    return t.select("id", raw.alias("raw"), (mean + c * (raw - mean)).alias("estimate"))


def evaluate(table: DataFrame) -> DataFrame:
    """One row from (truth, estimate, raw, E): rmse, mae, bias, weighted rmse, spearman."""
    from pyspark.sql.window import Window

    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    e = F.col("estimate") - F.col("truth")
    r = table.withColumns({"_a": rank("truth"), "_b": rank("estimate")})
    return r.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.sum(F.col("E") * e * e) / F.sum("E")).alias("weighted_rmse"), F.corr("_a", "_b").alias("spearman"))


def shrinkage(table: DataFrame) -> DataFrame:
    """(id, change, share): what smoothing moved, as a share of the distance to the mean of the raw rates."""
    m = table.agg(F.avg("raw").alias("_m"))
    t = table.crossJoin(F.broadcast(m))
    return t.select("id", (F.col("estimate") - F.col("raw")).alias("change"), safe(F.col("raw") - F.col("estimate"), F.col("raw") - F.col("_m")).alias("share"))
