"""Spatial sampling: designs, estimators, balance. Draws are hashes, so samples are the same in any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import special
from tessera.plans import pairs
from tessera.plans.resample import ticket, uniform


def check_n(n: int, total: int) -> None:
    if not 1 <= n <= total:
        raise ValueError(f"a sample of {n} from {total}")


def simple_random(frame: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``frame`` rows with pi and weight: the n first by hash."""
    total = frame.count()
    check_n(n, total)
    return frame.orderBy(ticket(seed, "id"), "id").limit(n).withColumns({"pi": F.lit(n / total), "weight": F.lit(total / n)})


def hilbert_index(x: Column, y: Column, order: int = 16) -> Column:
    """Position on the Hilbert curve of integer coordinates below 2 ** order."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s, k):
        side = F.pow(F.lit(2.0), k).cast("long")
        rx = (s["x"].bitwiseAND(side) > 0).cast("long")
        ry = (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * ((3 * rx).bitwiseXOR(ry))
        turn = (ry == 0) & (rx == 1)
        fx = F.when(turn, F.lit((1 << order) - 1) - s["x"]).otherwise(s["x"])
        fy = F.when(turn, F.lit((1 << order) - 1) - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), state, step)["d"]


def ordered(frame: DataFrame, kind: str = "hilbert", order: int = 16) -> DataFrame:
    """``frame`` with pos, 0 on, along the Hilbert curve over the bounding box, or by x or y; ties by id.

    Positions are counted by slices of the order, so no task sorts the table.
    """
    if kind == "hilbert":
        ends = frame.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
        side = (1 << order) - 1
        unit = lambda c: F.floor((F.col(c) - F.col(f"_{c}0")) / F.when(F.col(f"_{c}1") > F.col(f"_{c}0"), F.col(f"_{c}1") - F.col(f"_{c}0")).otherwise(1.0) * side)
        keyed = frame.crossJoin(F.broadcast(ends)).withColumn("_key", hilbert_index(unit("x"), unit("y"), order).cast("double")).drop("_x0", "_y0", "_x1", "_y1")
        slices = keyed.withColumn("_slice", F.floor(F.col("_key") / float(4 ** (order - 5))).cast("int"))
    elif kind in ("x", "y"):
        ends = frame.agg(F.min(kind).alias("_lo"), F.max(kind).alias("_hi"))
        keyed = frame.crossJoin(F.broadcast(ends)).withColumn("_key", F.col(kind))
        slices = keyed.withColumn("_slice", F.floor((F.col("_key") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * 1023).cast("int")).drop("_lo", "_hi")
    else:
        raise ValueError(f"unknown order {kind!r}")
    sizes = slices.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_slice", before.alias("_before"))
    inner = Window.partitionBy("_slice").orderBy("_key", "id")
    return slices.join(F.broadcast(sizes), "_slice").withColumn("pos", F.row_number().over(inner) - 1 + F.col("_before")).drop("_slice", "_before", "_key")


def systematic(frame: DataFrame, n: int, kind: str = "hilbert", seed: int = 0) -> DataFrame:
    """Every (N / n)-th row along the order, from a random start."""
    total = frame.count()
    check_n(n, total)
    start = uniform(seed, "start", F.lit("0"))
    # Row p is taken if some floor((i + u) N / n) is p.
    hit = F.ceil((F.col("pos") + 1) * (n / total) - start) - F.ceil(F.col("pos") * (n / total) - start)
    return ordered(frame, kind).where(hit > 0).withColumns({"pi": F.lit(n / total), "weight": F.lit(total / n)})


def neyman(sizes: dict, sds: dict, n: int, least: int = 2) -> dict:
    """Allocation in proportion to size times deviation."""
    return allocate({k: sizes[k] * sds[k] for k in sizes}, sizes, n, least)


def allocate(scores: dict, sizes: dict, n: int, least: int = 0) -> dict:
    """Shares of n in proportion to the scores, between ``least`` and the size; what rounding leaves goes by the largest remainders."""
    low = {k: min(least, sizes[k]) for k in sizes}
    if not sum(low.values()) <= n <= sum(sizes.values()):
        raise ValueError("the strata cannot hold such a sample")
    fixed: dict = {}
    while True:
        free = [k for k in sizes if k not in fixed]
        rest, total = n - sum(fixed.values()), sum(scores[k] for k in free)
        share = {k: rest * (scores[k] / total if total > 0 else 1 / len(free)) for k in free}
        out = {k: low[k] if share[k] < low[k] else sizes[k] for k in free if share[k] < low[k] or share[k] > sizes[k]}
        if not out:
            break
        under = {k: v for k, v in out.items() if v == low[k] and share[k] < low[k]}
        fixed |= under or out
        if len(fixed) == len(sizes):
            return fixed
    whole = {k: math.floor(share[k]) for k in free}
    left = rest - sum(whole.values())
    for k in sorted(free, key=lambda k: (-(share[k] - whole[k]), str(k))):
        if left and whole[k] < sizes[k]:
            whole[k] += 1
            left -= 1
    return {**fixed, **whole}


def stratified(frame: DataFrame, stratum: str, n: int, allocation: str | dict = "proportional", sds: dict | None = None, least: int = 2, seed: int = 0) -> DataFrame:
    """The first n_h of each stratum by hash, with pi = n_h / N_h."""
    sizes = {r[0]: r[1] for r in frame.groupBy(stratum).count().collect()}
    if isinstance(allocation, dict):
        part = allocation
    elif allocation == "proportional":
        part = allocate(sizes, sizes, n, least)
    elif allocation == "equal":
        part = allocate(dict.fromkeys(sizes, 1), sizes, n, least)
    elif allocation == "neyman":
        part = neyman(sizes, sds, n, least)
    else:
        raise ValueError(f"unknown allocation {allocation!r}")
    table = frame.sparkSession.createDataFrame([(k, part[k], sizes[k]) for k in sizes], frame.select(stratum).schema.add("_take", "long").add("_have", "long"))
    order = Window.partitionBy(stratum).orderBy(ticket(seed, "id"), "id")
    out = frame.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(table), stratum).where(F.col("_rank") <= F.col("_take"))
    return out.withColumns({"pi": F.col("_take") / F.col("_have"), "weight": F.col("_have") / F.col("_take")}).drop("_rank", "_take", "_have")


def two_stage(frame: DataFrame, cluster: str, n_clusters: int, n_each: int, seed: int = 0) -> DataFrame:
    """Clusters by hash, then up to ``n_each`` rows of each by hash."""
    sizes = frame.groupBy(cluster).agg(F.count("*").alias("_N"))
    m = sizes.count()
    check_n(n_clusters, m)
    drawn = sizes.orderBy(ticket(seed, F.lit("cluster"), cluster), cluster).limit(n_clusters)
    order = Window.partitionBy(cluster).orderBy(ticket(seed, "id"), "id")
    out = frame.join(F.broadcast(drawn), cluster).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_each)
    pi = n_clusters / m * F.least(F.lit(n_each), F.col("_N")) / F.col("_N")
    return out.withColumn("pi", pi).withColumn("weight", 1 / F.col("pi")).drop("_rank", "_N")


def inclusion_probabilities(frame: DataFrame, size: str, n: int) -> DataFrame:
    """``frame`` with pi in proportion to ``size``, capped at 1 and dealt again until none is over."""
    certain, left = frame.where(F.lit(False)).select("id"), frame
    rest, k = float(n), 0
    while True:
        total = left.agg(F.sum(size)).first()[0]
        over = left.where(F.col(size) * (rest / total) >= 1).select("id")
        more = over.count()
        if not more:
            break
        certain = certain.unionAll(over)
        left = left.join(over, "id", "left_anti")
        k += more
        rest = n - k
    flags = certain.withColumn("_one", F.lit(True))
    return frame.join(flags, "id", "left").withColumn("pi", F.when(F.col("_one"), 1.0).otherwise(F.col(size) * (rest / total))).drop("_one")


def grts(frame: DataFrame, n: int, size: str | None = None, seed: int = 0, depth: int = 12) -> DataFrame:
    """Generalised random tessellation: quadtree addresses with digits permuted by hash for each parent, then systematic selection along them."""
    total = frame.count()
    check_n(n, total)
    base = inclusion_probabilities(frame, size, n) if size else frame.withColumn("pi", F.lit(n / total))
    ends = frame.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("_w")).select("*")
    t = base.crossJoin(F.broadcast(ends))
    unit = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_w") * (1 << depth)), F.lit((1 << depth) - 1)).cast("long")
    t = t.withColumns({"_ux": unit("x"), "_uy": unit("y")})
    parent, address = F.lit(""), F.lit("")
    for level in range(depth):
        shift = depth - 1 - level
        digit = F.concat(F.shiftright("_ux", shift).bitwiseAND(F.lit(1)).cast("string"), F.shiftright("_uy", shift).bitwiseAND(F.lit(1)).cast("string"))
        # The four children of a parent are ordered by their hashes.
        address = F.concat(address, F.substring(ticket(seed, F.lit(f"{level}"), parent, digit), 1, 4))
        parent = F.concat(parent, digit)
    t = t.withColumn("_address", address).drop("_ux", "_uy", "_x0", "_y0", "_w")
    # Cumulated in slices of the address.
    t = t.withColumn("_slice", F.substring("_address", 1, 8))
    sums = t.groupBy("_slice").agg(F.sum("pi").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("_slice", before.alias("_before"))
    inner = Window.partitionBy("_slice").orderBy("_address", ticket(seed, "id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(F.broadcast(sums), "_slice").withColumn("_cum", F.sum("pi").over(inner) + F.col("_before"))
    start = uniform(seed, "start", F.lit("0"))
    hit = F.floor(F.col("_cum") - start + 1e-9) - F.floor(F.col("_cum") - F.col("pi") - start + 1e-9)
    return t.where(hit > 0).withColumn("weight", 1 / F.col("pi")).drop("_address", "_slice", "_before", "_cum")


def grid_points(spark, window, spacing: float, seed: int = 0, hexagonal: bool = False) -> DataFrame:
    """(id, x, y): a square or hexagonal grid with a random origin, inside the window."""
    x0, y0, x1, y1 = window.bounds
    dy = spacing * (math.sqrt(3) / 2 if hexagonal else 1)
    nx, ny = math.ceil((x1 - x0) / spacing) + 2, math.ceil((y1 - y0) / dy) + 2
    cells = spark.range(nx * ny).select("id", (F.col("id") % nx).alias("a"), F.floor(F.col("id") / nx).alias("b"))
    ox, oy = uniform(seed, "ox", F.lit("0")), uniform(seed, "oy", F.lit("0"))
    shift = F.when(F.col("b") % 2 == 1, 0.5).otherwise(0.0) if hexagonal else F.lit(0.0)
    out = cells.select("id", (x0 + (F.col("a") - 1 + ox + shift) * spacing).alias("x"), (y0 + (F.col("b") - 1 + oy) * dy).alias("y"))
    return out.where(window.contains(F.col("x"), F.col("y")))


def space_filling(frame: DataFrame, n: int, seed: int = 0, method: str = "maximin") -> DataFrame:
    """``maximin``: greedily the row farthest from those taken, n passes over the table; ``kmeans``: the row nearest each of n centres."""
    check_n(n, frame.count())
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(frame.select("id", "x", "y"))
        centres = KMeans(k=n, seed=seed).fit(v).clusterCenters()
        c = frame.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(centres)], "id long, x double, y double")
        near = pairs.nearest(c, frame, 1, same=False).select(F.col("j").alias("id")).distinct()
        return frame.join(near, "id", "left_semi")
    first = frame.orderBy(ticket(seed, "id"), "id").select("id", "x", "y").first()
    taken = [tuple(first)]
    while len(taken) < n:
        d = F.least(*(F.pow(F.col("x") - a, 2) + F.pow(F.col("y") - b, 2) for _, a, b in taken), F.lit(float("inf")))
        taken.append(tuple(frame.select("id", "x", "y", d.alias("d")).orderBy(F.desc("d"), "id").select("id", "x", "y").first()))
    return frame.where(F.col("id").isin([t[0] for t in taken]))


def clhs(frame: DataFrame, covariates: list[str], n: int, iterations: int = 5000, seed: int = 0, most_rows: int = 100_000) -> DataFrame:
    """Conditioned Latin hypercube by simulated annealing in one task, for tables of ``most_rows`` rows at most."""
    import numpy as np

    total = frame.count()
    check_n(n, total)
    if total > most_rows:
        raise ValueError(f"annealing holds up to {most_rows} rows in one task")
    rows = frame.select("id", *covariates).orderBy(ticket(seed, "id"), "id").toPandas()
    x, rng = rows[covariates].to_numpy(float), np.random.default_rng(seed)
    bins = np.column_stack([np.clip(np.searchsorted(np.quantile(c, np.linspace(0, 1, n + 1))[1:-1], c, "right"), 0, n - 1) for c in x.T])
    target = np.corrcoef(x.T) if len(covariates) > 1 else None

    def cost(s):
        spread = sum(np.abs(np.bincount(bins[s, c], minlength=n) - 1).sum() for c in range(x.shape[1]))
        return spread + (np.abs(np.corrcoef(x[s].T) - target).sum() if target is not None and n > 2 else 0)

    chosen = rng.choice(len(x), n, replace=False)
    now, heat = cost(chosen), 1.0
    best, least = chosen.copy(), now
    for _ in range(iterations):
        new = chosen.copy()
        new[rng.integers(n)] = rng.choice(np.setdiff1d(np.arange(len(x)), chosen, assume_unique=True)) if len(x) > n else new[0]
        c = cost(new)
        if c <= now or rng.random() < np.exp((now - c) / heat):
            chosen, now = new, c
            if c < least:
                best, least = new.copy(), c
        heat *= 0.999
    return frame.where(F.col("id").isin(rows["id"].to_numpy()[best].tolist()))


def estimate_mean(sample: DataFrame, value: str, variance: str = "srs", stratum: str | None = None, cluster: str | None = None, k: int = 4, conf: float = 0.95, total: int | None = None) -> DataFrame:
    """One row: mean (Hajek), total, se, lo, hi. ``variance`` is srs, stratified, local or cluster."""
    y, wt = F.col(value), 1 / F.col("pi")
    base = sample.agg(F.count("*").cast("double").alias("n"), F.sum(wt).alias("total_n"), F.sum(y * wt).alias("sum_y"), F.var_samp(y).alias("s2"))
    base = base.withColumn("mean", F.col("sum_y") / F.col("total_n"))
    if variance == "srs":
        var = base.select("*", ((1 - F.col("n") / F.col("total_n")) * F.col("s2") / F.col("n")).alias("var"))
    elif variance == "stratified":
        h = sample.groupBy(stratum).agg(F.count("*").alias("taken"), F.sum(wt).alias("held"), F.var_samp(y).alias("sh2"))
        v = h.crossJoin(F.broadcast(base.select("total_n"))).agg(F.sum(F.pow(F.col("held") / F.col("total_n"), 2) * (1 - F.col("taken") / F.col("held")) * F.col("sh2") / F.col("taken")).alias("var"))
        var = base.crossJoin(v)
    elif variance == "cluster":
        r = sample.crossJoin(F.broadcast(base.select("mean", "total_n"))).groupBy(cluster, "total_n").agg(F.sum((y - F.col("mean")) * wt).alias("r"))
        v = r.groupBy("total_n").agg((F.count("*") * F.var_samp("r")).alias("v")).select((F.col("v") / (F.col("total_n") * F.col("total_n"))).alias("var"))
        var = base.crossJoin(v)
    elif variance == "local":
        z = sample.crossJoin(F.broadcast(base.select("mean", "total_n"))).select("id", "x", "y", "pi", ((F.col(value) - F.col("mean")) * wt / F.col("total_n")).alias("z"))
        var = base.crossJoin(local_mean_variance(z, k))
    else:
        raise ValueError(f"unknown variance {variance!r}")
    q = float(special.normal_ppf(0.5 + conf / 2))
    out = var.withColumn("se", F.sqrt("var"))
    return out.select("n", "mean", F.col("sum_y").alias("total"), "se", (F.col("mean") - q * F.col("se")).alias("lo"), (F.col("mean") + q * F.col("se")).alias("hi"))


def local_mean_variance(z: DataFrame, k: int = 4) -> DataFrame:
    """One row var: sum of (1 - pi) k / (k - 1) (z - local mean)^2 over the k nearest, the row itself among them."""
    near = pairs.nearest(z, z, k - 1).select("i", "j").unionAll(z.select(F.col("id").alias("i"), F.col("id").alias("j")))
    mean = near.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy(F.col("i").alias("id")).agg(F.avg("zj").alias("m"))
    return z.join(mean, "id").agg(F.sum((1 - F.col("pi")) * (k / (k - 1)) * F.pow(F.col("z") - F.col("m"), 2)).alias("var"))


def design_effect(var_design: float, var_srs: float) -> float:
    return var_design / var_srs


def effective_size(n: int, rho: float, kind: str = "ar1") -> float:
    if kind == "ar1":
        return n * (1 - rho) / (1 + rho)
    if kind == "equicorrelated":
        return n / (1 + (n - 1) * rho)
    raise ValueError(f"unknown kind {kind!r}")


def sample_size_mean(sd: float, margin: float, total: int | None = None, conf: float = 0.95, deff: float = 1.0) -> int:
    n = (float(special.normal_ppf(0.5 + conf / 2)) * sd / margin) ** 2 * deff
    return math.ceil(n / (1 + n / total) if total else n)


def spatial_balance(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: balance, the mean squared deviation from 1 of the pi that is nearest each sampled row; ``frame`` has pi."""
    near = pairs.nearest(frame, sample, 1, same=False).join(frame.select(F.col("id").alias("i"), "pi"), "i")
    v = near.groupBy("j").agg(F.sum("pi").alias("v"))
    all_ = sample.select(F.col("id").alias("j")).join(v, "j", "left").select(F.coalesce("v", F.lit(0.0)).alias("v"))
    return all_.agg(F.avg(F.pow(F.col("v") - 1, 2)).alias("balance"))


def coverage(frame: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: balance, mean_distance and max_distance to the sample, min_spacing in it."""
    d = pairs.nearest(frame, sample, 1, same=False).agg(F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))
    s = pairs.nearest(sample, sample, 1).agg(F.min("d").alias("min_spacing"))
    return spatial_balance(frame, sample).crossJoin(d).crossJoin(s)


def compare_designs(frame: DataFrame, value: str, sizes: dict[str, int], reps: int = 100, seed: int = 0) -> DataFrame:
    """(design, n, bias, rmse, coverage, deff): random samples of several sizes, deff against the first by mean squared error."""
    rows = [evaluate_design(frame, value, n, reps, seed).select(F.lit(k).alias("design"), F.lit(n).alias("n"), "*") for k, n in sizes.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    first = rows[0].select(F.col("rmse").alias("_first"))
    return out.crossJoin(F.broadcast(first)).withColumn("deff", F.pow(F.col("rmse") / F.col("_first"), 2)).drop("_first")


def evaluate_design(frame: DataFrame, value: str, n: int, reps: int = 100, seed: int = 0) -> DataFrame:
    """One row: bias, rmse and coverage of simple random samples' means over replicates, all in one plan."""
    from tessera.plans.resample import replicates

    total = frame.count()
    truth = frame.agg(F.avg(value).alias("truth"))
    order = Window.partitionBy("rep").orderBy(ticket(seed, "rep", "id"), "id")
    s = replicates(frame.select("id", value), reps).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    each = s.groupBy("rep").agg(F.avg(value).alias("m"), F.var_samp(value).alias("s2")).withColumn("se", F.sqrt((1 - n / total) * F.col("s2") / n)).crossJoin(F.broadcast(truth))
    hit = (F.abs(F.col("m") - F.col("truth")) <= 1.959963984540054 * F.col("se")).cast("double")
    return each.agg((F.avg("m") - F.max("truth")).alias("bias"), F.sqrt(F.avg(F.pow(F.col("m") - F.col("truth"), 2))).alias("rmse"), F.avg(hit).alias("coverage"))
