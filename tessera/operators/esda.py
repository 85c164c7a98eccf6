"""Global and local spatial autocorrelation.

``values`` tables are (id, y); results are one-row tables for global and tables
by id for local statistics. Undefined statistics are null.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import special
from tessera.operators.weights import Weights
from tessera.plans.resample import first_drawn, p_values, permuted, replicates


def safe(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is 0."""
    return numerator / F.when(denominator != 0, denominator)


def _centred(values: DataFrame, value: str = "y") -> DataFrame:
    """(id, y, z, n, m2, m4): deviations with the moments; one small aggregate is broadcast."""
    v = values.select("id", F.col(value).alias("y"))
    mean = v.agg(F.avg("y").alias("_m"))
    z = v.crossJoin(F.broadcast(mean)).select("id", "y", (F.col("y") - F.col("_m")).alias("z"))
    moments = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("m2"), F.sum(F.pow("z", 4)).alias("m4"))
    return z.crossJoin(F.broadcast(moments))


def _ends(w: Weights, values: DataFrame, *columns: str) -> DataFrame:
    """Edges with both ends' columns, as c_i and c_j."""
    named = lambda n: values.select(F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in columns))
    return w.edges.select("i", "j", "w").join(named("i"), "i").join(named("j"), "j")


def weight_sums(w: Weights) -> DataFrame:
    """One row: n, s0, s1, s2."""
    both = w.edges.select("i", "j", "w").unionAll(w.reversed()).groupBy("i", "j").agg(F.sum("w").alias("w"))
    s1 = both.agg((0.5 * F.sum(F.col("w") * F.col("w"))).alias("s1"))
    marginal = w.edges.select(F.col("i").alias("id"), "w").unionAll(w.edges.select(F.col("j").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("w"))
    s2 = marginal.agg(F.sum(F.col("w") * F.col("w")).alias("s2"))
    return w.edges.agg(F.sum("w").alias("s0")).crossJoin(s1).crossJoin(s2).crossJoin(w.nodes.agg(F.count("*").alias("n")))


def _moran_parts(values: DataFrame, w: Weights) -> DataFrame:
    c = _centred(values)
    e = _ends(w, c, "z")
    cross = e.agg(F.sum(F.col("w") * F.col("z_i") * F.col("z_j")).alias("num"))
    moments = c.agg(F.max("m2").alias("m2"), F.max("m4").alias("m4"))
    return cross.crossJoin(moments).crossJoin(weight_sums(w))


def moran(values: DataFrame, w: Weights) -> DataFrame:
    """One row: I, expected_I, var_I (randomisation), z_score, p_norm, n."""
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    b2 = (F.col("m4") / n) / F.pow(F.col("m2") / n, 2)
    e = -1 / (n - 1)
    a = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
    b = b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    var = F.greatest(F.lit(0.0), (a - b) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e)
    out = _moran_parts(values, w).select(safe(n / s0 * F.col("num"), F.col("m2")).alias("I"), e.alias("expected_I"), var.alias("var_I"), "n")
    out = out.withColumn("z_score", safe(F.col("I") - F.col("expected_I"), F.sqrt("var_I")))
    return out.withColumn("p_norm", special.as_column(lambda z: 2 * special.normal_sf(abs(z)), F.col("z_score")))


def moran_bivariate(values: DataFrame, w: Weights, x: str = "x", y: str = "y") -> DataFrame:
    """One row: I of x with the lag of y."""
    zx, zy = (_centred(values, c).select("id", F.col("z").alias(n)) for c, n in ((x, "zx"), (y, "zy")))
    z = zx.join(zy, "id")
    e = w.edges.join(zx.withColumnRenamed("id", "i"), "i").join(zy.withColumnRenamed("id", "j"), "j")
    parts = e.agg(F.sum(F.col("w") * F.col("zx") * F.col("zy")).alias("num"), F.sum("w").alias("s0"))
    m = z.agg(F.sum(F.col("zx") * F.col("zx")).alias("m2"), F.count("*").alias("n"))
    return parts.crossJoin(m).select(safe(F.col("n") / F.col("s0") * F.col("num"), F.col("m2")).alias("I"), "n")


def moran_bivariate_test(values: DataFrame, w: Weights, x: str, y: str, permutations: int = 99, seed: int = 0) -> DataFrame:
    """One row: observed, p_value (two-sided by rank) with y reordered over the ids and x kept."""
    c = _centred(values, x).select("id", F.col("z").alias("zx"), "n", "m2")
    zy = _centred(values, y).select("id", F.col("z").alias("y"))
    sims = zy.select(F.lit(-1).alias("rep"), "id", "y").unionAll(permuted(zy, permutations, seed))
    s0 = w.edges.agg(F.sum("w").alias("s0"))
    e = w.edges.join(c.withColumnRenamed("id", "i"), "i").join(sims.select("rep", F.col("id").alias("j"), F.col("y").alias("yj")), "j").crossJoin(F.broadcast(s0))
    each = e.groupBy("rep").agg(F.sum(F.col("w") * F.col("zx") * F.col("yj") * F.col("n") / F.col("s0") / F.col("m2")).alias("s"))
    seen = each.where("rep = -1").select(F.col("s").alias("observed"))
    n = lambda k: F.sum(F.when(k, 1).otherwise(0))
    counts = each.where("rep >= 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(n(F.col("s") >= F.col("observed") - 1e-12).alias("up"), n(F.col("s") <= F.col("observed") + 1e-12).alias("down"))
    return counts.select("observed", p_values(F.col("observed"), F.col("up"), F.col("down"), permutations).alias("p_value"))


def moran_difference(values: DataFrame, w: Weights, later: str, earlier: str) -> DataFrame:
    return moran(values.select("id", (F.col(later) - F.col(earlier)).alias("y")), w)


def geary(values: DataFrame, w: Weights) -> DataFrame:
    """One row: C, expected_C, n."""
    c = _centred(values)
    e = _ends(w, c, "y").agg(F.sum(F.col("w") * F.pow(F.col("y_i") - F.col("y_j"), 2)).alias("num"), F.sum("w").alias("s0"))
    m = c.agg(F.max("m2").alias("m2"), F.max("n").alias("n"))
    return e.crossJoin(m).select(safe(F.col("num"), 2 * F.col("s0") * F.col("m2") / (F.col("n") - 1)).alias("C"), F.lit(1.0).alias("expected_C"), "n")


def general_g(values: DataFrame, w: Weights) -> DataFrame:
    """One row: G, n."""
    e = _ends(w, values, "y").where("i != j").agg(F.sum(F.col("w") * F.col("y_i") * F.col("y_j")).alias("num"))
    s = values.agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.count("*").alias("n"))
    return e.crossJoin(s).select(safe(F.col("num"), F.col("s") * F.col("s") - F.col("q")).alias("G"), "n")


def join_counts(values: DataFrame, w: Weights) -> DataFrame:
    """One row: BB, WW, BW over the edges with i < j; the larger of the two values is black."""
    top = values.agg(F.max("y").alias("_top"), F.count_distinct("y").alias("_kinds"))
    black = values.crossJoin(F.broadcast(top)).select("id", (F.col("y") == F.col("_top")).cast("int").alias("b"))
    e = _ends(w, black, "b").where("i < j")
    total = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    s = F.col("b_i") + F.col("b_j")
    return e.agg(total(s == 2).alias("BB"), total(s == 0).alias("WW"), total(s == 1).alias("BW"))


def permutation_test(values: DataFrame, w: Weights, statistic: str = "moran", permutations: int = 99, seed: int = 0) -> DataFrame:
    """One row: observed, mean_sim, p_compat (both tails by distance from 0) and p_value (two-sided by rank).

    ``statistic`` is moran, geary, general_g, or a join count (BB, WW, BW).
    Every replicate is a group of one plan: y is reordered over the ids by a
    hash, and the statistic is summed by replicate.
    """
    c = _centred(values)
    const = c.agg(F.max("n").alias("n"), F.max("m2").alias("m2"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.avg("y").alias("mean")).crossJoin(w.edges.agg(F.sum("w").alias("s0")))
    real = values.select(F.lit(-1).alias("rep"), "id", "y")
    sims = real.unionAll(permuted(values, permutations, seed))
    a = sims.select("rep", F.col("id").alias("i"), F.col("y").alias("yi"))
    b = sims.select("rep", F.col("id").alias("j"), F.col("y").alias("yj"))
    e = w.edges.join(a, "i").join(b, ["rep", "j"]).crossJoin(F.broadcast(const))
    if statistic == "moran":
        term, scale = (F.col("yi") - F.col("mean")) * (F.col("yj") - F.col("mean")), F.col("n") / F.col("s0") / F.col("m2")
    elif statistic == "geary":
        term, scale = F.pow(F.col("yi") - F.col("yj"), 2), (F.col("n") - 1) / (2 * F.col("s0") * F.col("m2"))
    elif statistic == "general_g":
        term, scale = F.when(F.col("i") != F.col("j"), F.col("yi") * F.col("yj")).otherwise(0.0), 1 / (F.col("sy") * F.col("sy") - F.col("syy"))
    elif statistic in ("BB", "WW", "BW"):
        top = values.agg(F.max("y").alias("_top"))
        e = e.where("i < j").crossJoin(F.broadcast(top)).withColumn("w", F.lit(1.0))
        black = (F.col("yi") == F.col("_top")).cast("int") + (F.col("yj") == F.col("_top")).cast("int")
        term, scale = (black == {"BB": 2, "WW": 0, "BW": 1}[statistic]).cast("double"), F.lit(1.0)
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    each = e.groupBy("rep").agg(F.sum(F.col("w") * term * scale).alias("s"))
    seen = each.where("rep = -1").select(F.col("s").alias("observed"))
    sim = each.where("rep >= 0").crossJoin(F.broadcast(seen))
    tiny = 1e-12
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = sim.groupBy("observed").agg(F.avg("s").alias("mean_sim"), n(F.abs("s") >= F.abs("observed") - tiny).alias("far"), n(F.col("s") >= F.col("observed") - tiny).alias("up"), n(F.col("s") <= F.col("observed") + tiny).alias("down"))
    return counts.select("observed", "mean_sim", ((F.col("far") + 1) / (permutations + 1.0)).alias("p_compat"), p_values(F.col("observed"), F.col("up"), F.col("down"), permutations).alias("p_value"))


def adjusted_p(table: DataFrame, p: str = "p_value", method: str = "fdr", alpha: float = 0.05, key: str = "id") -> DataFrame:
    """``table`` with p_adjusted (fdr: Benjamini-Hochberg; bonferroni; none) and reject.

    The step-up minimum is taken over ranks; ranks and their running minimum
    are found in slices of the p range, so no task sorts all rows.
    """
    if method == "none":
        return table.withColumn("p_adjusted", F.col(p)).withColumn("reject", F.col(p) <= alpha)
    n = table.where(F.col(p).isNotNull()).agg(F.count("*").alias("_total"))
    if method == "bonferroni":
        out = table.crossJoin(F.broadcast(n)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_total")))
        return out.drop("_total").withColumn("reject", F.col("p_adjusted") <= alpha)
    if method != "fdr":
        raise ValueError(f"unknown correction {method!r}")
    # Slices of p: equal values share one, and there are 1,024 of them at most.
    sliced = table.withColumn("_slice", F.floor(F.col(p) * 1023).cast("int"))
    sizes = sliced.where(F.col(p).isNotNull()).groupBy("_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_slice", before.alias("_before"))
    inner = Window.partitionBy("_slice").orderBy(p, key)
    ranked = sliced.join(F.broadcast(sizes), "_slice", "left").withColumn("_rank", F.row_number().over(inner) + F.col("_before")).crossJoin(F.broadcast(n))
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_total") / F.col("_rank"))
    least = ranked.groupBy("_slice").agg(F.min("_raw").alias("_m"))
    after = F.min("_m").over(Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1))
    least = least.where("_slice is not null").select("_slice", after.alias("_after"))
    # From above: a frame without an end is read again for each of its rows.
    upward = F.min("_raw").over(Window.partitionBy("_slice").orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranked.withColumn("_own", upward).join(F.broadcast(least), "_slice", "left")
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_own"), F.coalesce("_after", F.lit(1.0))))
    return out.withColumn("p_adjusted", adjusted).withColumn("reject", F.col("p_adjusted") <= alpha).select(*table.columns, "p_adjusted", "reject")


def quadrant(z: Column, lag: Column) -> Column:
    """1 high-high, 2 low-high, 3 low-low, 4 high-low."""
    return F.when((z > 0) & (lag > 0), 1).when((z <= 0) & (lag > 0), 2).when((z <= 0) & (lag <= 0), 3).otherwise(4)


LABELS = {0: "NS", 1: "HH", 2: "LH", 3: "LL", 4: "HL"}


def quadrant_label(q: Column) -> Column:
    out = F.lit("NS")
    for k, name in LABELS.items():
        out = F.when(q == k, name).otherwise(out)
    return out


def local_moran(values: DataFrame, w: Weights) -> DataFrame:
    """(id, Ii, z, lag, quadrant)."""
    c = _centred(values)
    lag = w.lag(c, "z")
    out = c.join(lag, "id").select("id", safe(F.col("z") * F.col("lag"), F.col("m2") / F.col("n")).alias("Ii"), "z", "lag")
    return out.withColumn("quadrant", quadrant(F.col("z"), F.col("lag")))


def local_moran_bivariate(values: DataFrame, w: Weights, x: str = "x", y: str = "y") -> DataFrame:
    """(id, Ii, zx, lag, quadrant) with both standardised by the population deviation."""
    std = lambda c, n: _centred(values, c).select("id", safe(F.col("z"), F.sqrt(F.col("m2") / F.col("n"))).alias(n))
    zx, zy = std(x, "zx"), std(y, "zy")
    out = zx.join(w.lag(zy, "zy"), "id").select("id", (F.col("zx") * F.col("lag")).alias("Ii"), "zx", "lag")
    return out.withColumn("quadrant", quadrant(F.col("zx"), F.col("lag")))


def local_geary(values: DataFrame, w: Weights) -> DataFrame:
    """(id, Ci): sum of w (yi - yj)^2."""
    c = _ends(w, values, "y").groupBy("i").agg(F.sum(F.col("w") * F.pow(F.col("y_i") - F.col("y_j"), 2)).alias("Ci"))
    return w.nodes.join(c, w.nodes["id"] == c["i"], "left").select("id", F.coalesce("Ci", F.lit(0.0)).alias("Ci"))


def local_g(values: DataFrame, w: Weights, star: bool = False, self_weight: str = "one") -> DataFrame:
    """(id, z): Gi over the others, or Gi* with the row itself.

    ``self_weight`` of Gi*: 'one', or 'mean' of the row's weights (1 for
    islands) with the row standardised again. Islands have no Gi.
    """
    if star and self_weight == "one":
        w = w.with_self(1.0)
    elif star:
        own = w.edges.where("i != j").groupBy("i").agg(F.avg("w").alias("m"))
        own = w.nodes.join(own, w.nodes["id"] == own["i"], "left").select(F.col("id").alias("i"), F.col("id").alias("j"), F.coalesce("m", F.lit(1.0)).alias("w"))
        w = Weights(w.nodes, w.edges.where("i != j").select("i", "j", "w").unionAll(own)).transformed("row")
    v = values.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    edges = w.edges if star else w.edges.where("i != j")
    sums = edges.join(v, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("yj")).alias("wy"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    all_ = values.agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    t = values.join(sums, values["id"] == sums["i"], "left").crossJoin(F.broadcast(all_))
    n = F.col("n")
    if star:
        mean = F.col("s") / n
        s2 = F.col("q") / n - mean * mean
        spread = s2 * (n * F.col("sw2") - F.col("sw") * F.col("sw")) / (n - 1)
    else:
        mean = (F.col("s") - F.col("y")) / (n - 1)
        s2 = (F.col("q") - F.col("y") * F.col("y")) / (n - 1) - mean * mean
        spread = s2 * ((n - 1) * F.col("sw2") - F.col("sw") * F.col("sw")) / (n - 2)
    return t.select("id", safe(F.col("wy") - mean * F.col("sw"), F.sqrt(F.when(spread > 0, spread))).alias("z"))


def local_permutations(values: DataFrame, w: Weights, statistic: str = "moran", permutations: int = 99, seed: int = 0) -> DataFrame:
    """(id, stat, p_sim, p_adjusted, quadrant, label): full permutations, pseudo p of |stat|, BH, labels of adjusted p."""
    c = _centred(values)
    sims = values.select(F.lit(-1).alias("rep"), "id", "y").unionAll(permuted(values, permutations, seed))
    mean = c.agg(F.avg("y").alias("mean"), (F.max("m2") / F.max("n")).alias("var"))
    z = sims.crossJoin(F.broadcast(mean)).select("rep", "id", (F.col("y") - F.col("mean")).alias("z"), "var")
    e = w.edges.join(z.select("rep", F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    lag = e.groupBy("rep", "i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("zj") * F.col("zj")).alias("wzz"))
    both = z.join(lag.withColumnRenamed("i", "id"), ["rep", "id"], "left").fillna(0.0, ["lag", "sw", "wzz"])
    if statistic == "moran":
        stat = safe(F.col("z") * F.col("lag"), F.col("var"))
    elif statistic == "geary":
        stat = F.col("z") * F.col("z") * F.col("sw") - 2 * F.col("z") * F.col("lag") + F.col("wzz")
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    both = both.withColumn("s", stat)
    seen = both.where("rep = -1").select("id", F.col("s").alias("stat"), "z", "lag")
    far = both.where("rep >= 0").join(seen.select("id", "stat"), "id").groupBy("id").agg(F.sum(F.when(F.abs("s") >= F.abs("stat") - 1e-12, 1).otherwise(0)).alias("far"))
    out = seen.join(far, "id").withColumn("p_sim", (F.col("far") + 1) / (permutations + 1.0))
    out = adjusted_p(out, "p_sim")
    q = F.when(F.col("p_adjusted") <= 0.05, quadrant(F.col("z"), F.col("lag"))).otherwise(0)
    return out.select("id", "stat", "p_sim", "p_adjusted", q.alias("quadrant"), quadrant_label(q).alias("label"))


#: Rows of drawn values handed to every task up to this number (24 bytes each); beyond it edges are joined to them.
DRAWN_BROADCAST = 1_000_000


def conditional_counts(values: DataFrame, w: Weights, term, permutations: int = 99, seed: int = 0) -> DataFrame:
    """(id, seen, up, down): a row's sum over its neighbours against as many others drawn at random, the row itself kept.

    ``values`` is (id, y) with a column x of the row itself; ``term`` gives what a
    neighbour of value y adds to the sum of a row of x. Each replicate has one
    random order of all rows, of which a row takes the first others, as many as it
    has neighbours: the work grows with edges and replicates, not with pairs. ``up``
    and ``down`` count the replicates whose sum is at least and at most the real one.
    """
    from tessera.plans.graph import cut

    x = values.select(F.col("id").alias("i"), F.col("x").alias("xi"))
    own = w.edges.where("i != j").withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy("j"))).select("i", "j", "pos", "w")
    most = own.agg(F.max("pos")).first()[0]
    if most is None:
        return values.select("id", F.lit(0.0).alias("seen"), F.lit(permutations).cast("long").alias("up"), F.lit(permutations).cast("long").alias("down"))
    rows = permutations * (most + 1)
    drawn = cut(first_drawn(values, permutations, most + 1, seed))
    few = F.broadcast if rows <= DRAWN_BROADCAST else (lambda d: d)
    seen = own.join(values.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").join(x, "i").groupBy("i").agg(F.sum(F.col("w") * term(F.col("xi"), F.col("yj"))).alias("seen"))
    many = replicates(own.join(x, "i").select("i", "xi", "pos", "w"), permutations)
    itself = drawn.select("rep", F.col("o").alias("i"), F.col("rank").alias("_skip"))
    placed = many.join(few(itself), ["rep", "i"], "left").withColumn("rank", F.col("pos") + F.when(F.col("_skip") <= F.col("pos"), 1).otherwise(0))
    sims = placed.join(few(drawn.select("rep", "rank", F.col("y").alias("yj"))), ["rep", "rank"]).groupBy("rep", "i").agg(F.sum(F.col("w") * term(F.col("xi"), F.col("yj"))).alias("s"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = sims.join(seen, "i").groupBy("i").agg(F.max("seen").alias("seen"), n(F.col("s") >= F.col("seen") - 1e-12).alias("up"), n(F.col("s") <= F.col("seen") + 1e-12).alias("down"))
    return counts.withColumnRenamed("i", "id")


def _tested(table: DataFrame, counts: DataFrame, statistic: str, permutations: int) -> DataFrame:
    """``table`` with p_sim (two-sided by rank); null for rows without neighbours."""
    p = p_values(F.col(statistic), F.col("up"), F.col("down"), permutations)
    return table.join(counts.select("id", "up", "down"), "id", "left").withColumn("p_sim", F.when(F.col("up").isNotNull(), p)).drop("up", "down")


def conditional_permutations(values: DataFrame, w: Weights, permutations: int = 99, seed: int = 0) -> DataFrame:
    """(id, Ii, p_sim, quadrant): local Moran, each row's neighbours redrawn from the others, as many as it has, itself kept."""
    c = _centred(values).select("id", F.col("z").alias("y"), F.col("z").alias("x"))
    counts = conditional_counts(c, w, lambda x, y: x * y, permutations, seed)
    return _tested(local_moran(values, w), counts, "Ii", permutations).select("id", "Ii", "p_sim", "quadrant")


def local_bivariate_test(values: DataFrame, w: Weights, x: str = "x", y: str = "y", permutations: int = 99, seed: int = 0, alpha: float = 0.05, correction: str = "fdr") -> DataFrame:
    """(id, Ii, p_sim, p_adjusted, quadrant, label): bivariate local Moran, the neighbours' y redrawn and x kept; quadrants of adjusted p."""
    check_resolution(permutations, values.count(), alpha, correction)
    seen = local_moran_bivariate(values, w, x, y)
    both = _centred(values, x).select("id", F.col("z").alias("x")).join(_centred(values, y).select("id", F.col("z").alias("y")), "id")
    counts = conditional_counts(both, w, lambda a, b: a * b, permutations, seed)
    out = adjusted_p(_tested(seen, counts, "Ii", permutations), "p_sim", correction, alpha)
    q = F.when(F.col("p_adjusted") <= alpha, F.col("quadrant")).otherwise(0)
    return out.select("id", "Ii", "p_sim", "p_adjusted", q.alias("quadrant"), quadrant_label(q).alias("label"))


def local_geary_test(values: DataFrame, w: Weights, permutations: int = 99, seed: int = 0) -> DataFrame:
    """(id, Ci, p_sim): local Geary, the neighbours redrawn and the row kept."""
    c = values.select("id", "y", F.col("y").alias("x"))
    counts = conditional_counts(c, w, lambda x, y: F.pow(x - y, 2), permutations, seed)
    return _tested(local_geary(values, w), counts, "Ci", permutations).select("id", "Ci", "p_sim")


def local_g_test(values: DataFrame, w: Weights, star: bool = False, self_weight: str = "one", permutations: int = 99, seed: int = 0, alpha: float = 0.05, correction: str = "fdr") -> DataFrame:
    """(id, z, p_sim, p_adjusted, reject): Gi or Gi*, the neighbours redrawn and the row kept; given the row, z grows with the neighbours' sum alone."""
    check_resolution(permutations, values.count(), alpha, correction)
    counts = conditional_counts(values.select("id", "y", F.lit(0.0).alias("x")), w, lambda x, y: y, permutations, seed)
    return adjusted_p(_tested(local_g(values, w, star, self_weight), counts, "z", permutations), "p_sim", correction, alpha)


def check_resolution(permutations: int, n: int, alpha: float = 0.05, correction: str = "fdr") -> None:
    """Warns where so few permutations can't give p-values that outlive the correction."""
    if correction == "none" or permutations <= 0:
        return
    least, enough = 2 / (permutations + 1), -(-2 * n // alpha)
    if correction == "bonferroni" and least > alpha / n:
        warnings.warn(f"{permutations} permutations can't reach {alpha / n:.3g}; it takes {enough:.0f}", stacklevel=3)
    elif correction == "fdr" and least > alpha:
        warnings.warn(f"{permutations} permutations can't reach {alpha}", stacklevel=3)
    elif correction == "fdr" and -(-least * n // alpha) > 3:
        warnings.warn(f"with {permutations} permutations {-(-least * n // alpha):.0f} of {n} rows must have the least p-value for any to be found; {enough:.0f} permutations need no such crowd", stacklevel=3)


def hotspots(values: DataFrame, w: Weights, star: bool = True, correction: str = "fdr", alpha: float = 0.05, inference: str = "analytic", permutations: int = 999, seed: int = 0) -> DataFrame:
    """(id, z, p_analytic or p_sim, p_adjusted, label): Gi* with the mean self weight; tiers at alpha / 5, alpha and 2 alpha."""
    if inference == "permutation":
        out = local_g_test(values, w, star, "mean", permutations, seed, alpha, correction).drop("reject")
    elif inference == "analytic":
        z = local_g(values, w, star, "mean")
        p = z.withColumn("p_analytic", special.as_column(lambda x: 2 * special.normal_sf(abs(x)), F.col("z")))
        out = adjusted_p(p, "p_analytic", correction, alpha).drop("reject")
    else:
        raise ValueError(f"unknown inference {inference!r}")
    side = F.when(F.col("z") > 0, "Hot spot").otherwise("Cold spot")
    tier = F.when(F.col("p_adjusted") <= alpha / 5, " 99%").when(F.col("p_adjusted") <= alpha, " 95%").when(F.col("p_adjusted") <= 2 * alpha, " 90%")
    return out.withColumn("label", F.coalesce(F.concat(side, tier), F.lit("Not significant")))


def moran_scatter(values: DataFrame, w: Weights) -> DataFrame:
    """(id, z, lag) of the Moran scatter plot."""
    return local_moran(values, w).select("id", "z", "lag")
