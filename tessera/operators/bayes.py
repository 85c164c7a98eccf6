"""Bayesian disease mapping: Poisson counts with spatial and unstructured effects, one Spark task for each chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.weights import Weights

#: Areas that a chain's task holds at most.
AREAS = 20_000


def colouring(neighbours: list[list[int]]) -> np.ndarray:
    """Greedy colours: areas of one colour touch none of the same and are updated together."""
    colour = np.full(len(neighbours), -1)
    for i in sorted(range(len(neighbours)), key=lambda i: (-len(neighbours[i]), i)):
        taken = {colour[j] for j in neighbours[i]}
        colour[i] = next(c for c in range(len(neighbours) + 1) if c not in taken)
    return colour


def icar_scale(adjacency: np.ndarray) -> float:
    """Geometric mean of the generalised inverse's diagonal."""
    q = np.diag(adjacency.sum(1)) - adjacency
    d = np.diag(np.linalg.pinv(q))
    return float(np.exp(np.log(d[d > 1e-12]).mean()))


def chain(O: np.ndarray, E: np.ndarray, neighbours: list[list[int]], component: np.ndarray, model: str, draws: int, tune: int, thin: int, seed, a: float = 1.0, b: float = 0.1, X: np.ndarray | None = None) -> dict:
    """Random-walk steps of the log risk, normal draws of u by colour, centred in each component, and of the coefficients of a constant and ``X``, gamma draws of the precisions."""
    rng, n = np.random.default_rng(seed), len(O)
    colour, degree = colouring(neighbours), np.array([len(x) for x in neighbours])
    spatial = (degree > 0) & (model != "iid")
    design = np.column_stack([np.ones(n), *([] if X is None else [X])])
    root = np.linalg.cholesky(np.linalg.inv(design.T @ design))
    beta, u, v = np.zeros(design.shape[1]), np.zeros(n), np.zeros(n)
    beta[0] = np.log(max(O.sum(), 0.5) / E.sum())
    tau_u, tau_v = 10.0, 10.0
    scale, accepted = np.full(n, 0.3), np.zeros(n)
    flat = np.concatenate([np.array(x, int) for x in neighbours]) if degree.sum() else np.zeros(0, int)
    owner = np.repeat(np.arange(n), degree)
    rank = sum((component == c).sum() - 1 for c in np.unique(component[spatial])) if spatial.any() else 0
    alpha = design @ beta
    omega = alpha + u + v
    kept, betas, taus = [], [], []
    for step in range(tune + draws * thin):
        if model == "icar":  # the unstructured part is a narrow one
            tau_v = 1e4
        proposal = omega + scale * rng.normal(size=n)
        mean = alpha + u
        ratio = O * (proposal - omega) - E * (np.exp(proposal) - np.exp(omega)) - tau_v / 2 * ((proposal - mean) ** 2 - (omega - mean) ** 2)
        yes = np.log(rng.random(n)) < ratio
        omega = np.where(yes, proposal, omega)
        accepted += yes
        if spatial.any():
            for c in range(colour[spatial].max() + 1):
                at = np.flatnonzero(spatial & (colour == c))
                total = np.bincount(owner, u[flat], n)[at]
                precision = tau_v + tau_u * degree[at]
                u[at] = (tau_v * (omega[at] - alpha[at]) + tau_u * total) / precision + rng.normal(size=len(at)) / np.sqrt(precision)
            for c in np.unique(component[spatial]):
                here = spatial & (component == c)
                u[here] -= u[here].mean()
            between = ((u[owner] - u[flat]) ** 2).sum() / 2
            tau_u = rng.gamma(a + rank / 2, 1 / (b + between / 2))
        beta = root @ (root.T @ (design.T @ (omega - u)) + rng.normal(size=len(beta)) / np.sqrt(tau_v))
        alpha = design @ beta
        v = omega - alpha - u
        if model != "icar":
            tau_v = rng.gamma(a + n / 2, 1 / (b + (v**2).sum() / 2))
        if step < tune and step % 50 == 49:
            scale *= np.exp(accepted / 50 - 0.44)
            accepted[:] = 0
        if step >= tune and (step - tune) % thin == 0:
            kept.append(np.exp(omega).astype(np.float32))
            betas.append(beta)
            taus.append((tau_u, tau_v))
    return {"theta": np.array(kept), "beta": np.array(betas), "tau": np.array(taus)}


def bym(areas: DataFrame, w: Weights, model: str = "bym", chains: int = 4, draws: int = 250, tune: int = 500, thin: int = 4, seed: int = 0, X: tuple[str, ...] = ()) -> DataFrame:
    """(chain, draw, id, theta): posterior relative risks of (id, O, E); model bym, icar or iid, with the covariates ``X`` if there are any.

    Covariates are standardised. Rows of an id below 0 are the draws of their
    coefficients: -1 the constant, -2 the first covariate and so on.
    A chain needs every area at once: the graph, of up to ``AREAS`` areas, is
    broadcast and each chain is a task.
    """
    if model not in ("bym", "icar", "iid"):
        raise ValueError(f"unknown model {model!r}")
    if areas.limit(AREAS + 1).count() > AREAS:
        raise ValueError(f"a chain holds up to {AREAS} areas")
    table = areas.select("id", F.col("O").cast("double"), F.col("E").cast("double"), *(F.col(c).cast("double").alias(c) for c in X)).orderBy("id").toPandas()
    design = None
    if X:
        raw = table[list(X)].to_numpy(float)
        design = (raw - raw.mean(0)) / np.where(raw.std(0) > 0, raw.std(0), 1)
        if np.linalg.matrix_rank(np.column_stack([np.ones(len(raw)), design])) < len(X) + 1:
            raise ValueError("the covariates are collinear")
    at = {v: k for k, v in enumerate(table["id"])}
    neighbours: list[list[int]] = [[] for _ in at]
    for i, j in sorted((at[r.i], at[r.j]) for r in w.symmetric_edges().collect()):
        neighbours[i].append(j)
    comp = {r.id: r.component for r in w.components().collect()}
    component = np.array([comp[i] for i in table["id"]])
    spark = areas.sparkSession
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(), table["O"].to_numpy(), table["E"].to_numpy(), neighbours, component, design))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, O, E, near, comps, covariates = shared.value
        c = int(pdf["chain"].iloc[0])
        found = chain(O, E, near, comps, model, draws, tune, thin, (seed, c), X=covariates)
        theta = found["theta"]
        if covariates is not None:
            names = -1 - np.arange(covariates.shape[1] + 1)
            ids, theta = np.concatenate([names, ids]), np.concatenate([found["beta"], theta], 1)
        return pd.DataFrame({"chain": c, "draw": np.repeat(np.arange(draws), len(ids)), "id": np.tile(ids, draws), "theta": theta.ravel().astype(float)})

    return spark.range(chains).select(F.col("id").cast("int").alias("chain")).groupBy("chain").applyInPandas(run, "chain int, draw long, id long, theta double")


def summary(draws: DataFrame, alpha: float = 0.05, threshold: float = 1.0) -> DataFrame:
    """(id, mean, sd, lo, median, hi, exceedance)."""
    q = lambda p: F.percentile("theta", p)
    return draws.groupBy("id").agg(F.avg("theta").alias("mean"), F.stddev_samp("theta").alias("sd"), q(alpha / 2).alias("lo"), q(0.5).alias("median"), q(1 - alpha / 2).alias("hi"), F.avg((F.col("theta") > threshold).cast("double")).alias("exceedance"))


def shrinkage(draws: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, change, share): how far the posterior means lie from the raw ratios."""
    from tessera.operators import rates

    mean = draws.groupBy("id").agg(F.avg("theta").alias("estimate"))
    return rates.shrinkage(areas.select("id", (F.col("O") / F.col("E")).alias("raw")).join(mean, "id"))


def rhat(draws: DataFrame) -> DataFrame:
    """(id, rhat) of split chains."""
    half = draws.agg((F.max("draw") + 1).alias("_n"))
    d = draws.crossJoin(F.broadcast(half)).withColumn("_half", (F.col("draw") >= F.floor(F.col("_n") / 2)).cast("int"))
    each = d.groupBy("id", "chain", "_half").agg(F.avg("theta").alias("m"), F.var_samp("theta").alias("s2"), F.count("*").alias("n"))
    w = each.groupBy("id").agg(F.avg("s2").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return w.select("id", F.when(F.col("w") > 0, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.col("w"))).otherwise(1.0).alias("rhat"))


def ess(draws: DataFrame) -> DataFrame:
    """(id, ess): Geyer's initial monotone pairs of the averaged autocorrelations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["chain", "draw"])["theta"].to_numpy().reshape(pdf["chain"].nunique(), -1)
        m, n = x.shape
        z = x - x.mean(1, keepdims=True)
        f = np.fft.rfft(z, 2 * n, axis=1)
        acov = np.fft.irfft(f * f.conj(), 2 * n, axis=1)[:, :n].mean(0) / n
        if acov[0] <= 0:
            return pd.DataFrame({"id": [pdf["id"].iloc[0]], "ess": [float(m * n)]})
        var = acov[0] * n / (n - 1) * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0)
        rho = 1 - (acov[0] - acov) / max(var, 1e-300)
        pairs_ = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
        end = int(np.argmax(pairs_ <= 0)) if (pairs_ <= 0).any() else len(pairs_)
        total = np.minimum.accumulate(pairs_[:end]).sum() if end else 0.5
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "ess": [float(m * n / max(2 * total - 1, 1e-6))]})

    return draws.groupBy("id").applyInPandas(run, "id long, ess double")


def simulate_risk(w: Weights, sigma: float = 0.35, strength: float = 0.95, seed: int = 0) -> DataFrame:
    """(id, theta): exp of sigma times the standardised (I - c W)^-1 z."""
    from tessera.operators.regression import dense_weights

    W, ids = dense_weights(w.transformed("row"))
    x = np.linalg.solve(np.eye(len(ids)) - strength * W, np.random.default_rng(seed).normal(size=len(ids)))
    theta = np.exp(sigma * (x - x.mean()) / x.std())
    return w.nodes.sparkSession.createDataFrame([(i, float(t)) for i, t in zip(ids, theta, strict=True)], "id long, theta double")
