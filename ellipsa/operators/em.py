"""Expectation-maximization of full-covariance mixtures: one Spark job a sweep."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmeans
from .dataset import covariance_trace, rows_by_hash
from .model import Mixture, MixtureError, log_joint
from .partials import lists, matrix, merged, slot, spread, tasks_of


def log_sum_exp(joint: np.ndarray) -> np.ndarray:
    top = joint.max(axis=1)
    return top + np.log(np.exp(joint - top[:, None]).sum(axis=1))


def posterior_table(df: DataFrame, model: Mixture) -> DataFrame:
    """row_id, log_density of the mixture, gamma (K posteriors) and cluster: the largest, of equal ones the lowest k."""
    inverse, logdet = model.factors()
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.means, inverse, logdet))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                joint = log_joint(matrix(batch.column(1)), *sent.value)
                lse = log_sum_exp(joint)
                gamma = np.exp(joint - lse[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lse), lists(gamma), pa.array(joint.argmax(axis=1).astype(np.int32))], ["row_id", "log_density", "gamma", "cluster"])

    return df.select("row_id", "features").mapInArrow(part, "row_id long, log_density double, gamma array<double>, cluster int")


@dataclass
class Moments:
    """Sums of a sweep: total log-likelihood, and about the old means the zeroth, first and second moments of each component."""

    log_likelihood: float
    n: np.ndarray
    first: np.ndarray
    second: np.ndarray


def moments(df: DataFrame, model: Mixture, tasks: int | None = None) -> Moments:
    """E-step and sufficient statistics in one pass.

    A task emits one row per component; rows are merged by component on the executors in a tree, so the driver gets K rows
    and a worker a few of them at once, whatever the number of ``tasks``. Moments are taken about the old means, which keeps cancellation small.
    """
    inverse, logdet = model.factors()
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.means, inverse, logdet))
    k, d = model.k, model.d

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mu, inv, ld = sent.value
        ll, n, s, q = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(at, 4096))
                joint = log_joint(x, w, mu, inv, ld)
                lse = log_sum_exp(joint)
                gamma = np.exp(joint - lse[:, None])
                ll += lse.sum()
                n += gamma.sum(axis=0)
                for c in range(k):
                    z = x - mu[c]
                    g = z * gamma[:, c : c + 1]
                    s[c] += g.sum(axis=0)
                    q[c] += g.T @ z
        if n.any():
            yield _packed(np.full(k, ll), n, s, q)

    try:
        rows = merged(df.select("features").mapInArrow(part, _KIND), ("ll", "n"), ("s", "q"), tasks).collect()
    finally:
        sent.destroy()
    if not rows:
        raise MixtureError("no rows")
    return Moments(rows[0]["ll"], *_unpacked(rows, k, d))


_KIND = "k int, slot long, ll double, n double, s array<double>, q array<double>"


def _packed(ll: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    k, d = s.shape
    upper = np.triu_indices(d)
    columns = [pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, slot())), pa.array(ll), pa.array(n), lists(s), lists(q[:, upper[0], upper[1]])]
    return pa.RecordBatch.from_arrays(columns, ["k", "slot", "ll", "n", "s", "q"])


def _unpacked(rows: list, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, second = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for r in rows:
        n[r["k"]], first[r["k"]] = r["n"], r["s"]
        second[r["k"]][np.triu_indices(d)] = r["q"]
    return n, first, second + np.transpose(np.triu(second, 1), (0, 2, 1))


def maximize(model: Mixture, m: Moments) -> Mixture:
    """New weights, means, and covariances about the new means."""
    if not (m.n > 0).all():
        raise MixtureError(f"components without rows: {np.flatnonzero(~(m.n > 0)).tolist()}")
    delta = m.first / m.n[:, None]
    covs = m.second / m.n[:, None, None] - delta[:, :, None] * delta[:, None, :]
    return Mixture(m.n / m.n.sum(), model.means + delta, covs)


@dataclass
class EMParams:
    max_sweeps: int = 1_000_000
    eps: float = 1e-5
    abort_condition: float = 1e5
    regularization: float = 0.0
    check_condition: bool = True


@dataclass
class EMResult:
    model: Mixture
    log_likelihood: float  # of the parameters before the last maximization
    history: list[dict] = field(default_factory=list)


def _checked(model: Mixture, p: EMParams) -> Mixture:
    model = model.regularized(p.regularization)
    model.factors()
    if p.check_condition and (worst := model.condition_numbers().max()) > p.abort_condition:
        raise MixtureError(f"condition number {worst:.3g} is over {p.abort_condition:.3g}")
    return model


def fit(df: DataFrame, start: Mixture, params: EMParams | None = None) -> EMResult:
    """Sweeps until the relative change of the log-likelihood is under eps; a decrease stops too and is flagged."""
    p = params or EMParams()
    model, before, history = _checked(start, p), -np.finfo(float).max, []
    df = spread(df.select("features"))
    tasks = tasks_of(df)
    try:
        for _ in range(p.max_sweeps):
            m = moments(df, model, tasks)
            model = _checked(maximize(model, m), p)
            change = abs((m.log_likelihood - before) / m.log_likelihood) if m.log_likelihood else 0.0
            fell = m.log_likelihood < before
            history.append({"log_likelihood": m.log_likelihood, "change": change, "ll_decreased": fell})
            before = m.log_likelihood
            if fell or change < p.eps:
                break
    finally:
        df.unpersist()
    return EMResult(model, before, history)


def jain(df: DataFrame, k: int, seed: int | None = None) -> Mixture:
    """Equal weights, hash-random rows as means, a tenth of the mean column variance as spherical covariance."""
    rows = rows_by_hash(df, k, seed)
    means = np.array([r["features"] for r in rows])
    d = means.shape[1]
    trace = covariance_trace(df).first()[0]
    return Mixture(np.full(k, 1 / k), means, np.repeat((trace / d / 10 * np.eye(d))[None], k, axis=0))


def hard_moments(df: DataFrame, centroids: np.ndarray, regularization: float = 0.0) -> Mixture:
    """Weights and covariances about the centroids, divisor n - 1, of the nearest-centroid clusters."""
    k, d = centroids.shape
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, q = sent.value, np.zeros(k), np.zeros((k, d, d))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                mine, _ = kmeans.numpy_nearest(x, c)
                for j in np.unique(mine):
                    z = x[mine == j] - c[j]
                    n[j] += len(z)
                    q[j] += z.T @ z
        if n.any():
            yield _packed(np.zeros(k), n, np.zeros((k, d)), q)

    try:
        rows = merged(df.select("features").mapInArrow(part, _KIND), ("ll", "n"), ("s", "q")).collect()
    finally:
        sent.destroy()
    n, _, second = _unpacked(rows, k, d)
    if (n < 2).any():
        raise MixtureError(f"clusters of fewer than two rows: {np.flatnonzero(n < 2).tolist()}")
    return Mixture(n / n.sum(), centroids, second / (n - 1)[:, None, None]).regularized(regularization)


def kmeans_start(df: DataFrame, k: int, seeds: str = "forgy", regularization: float = 0.0, seed: int | None = 1) -> Mixture:
    """K-means from Forgy or K-means|| seeds, at most 29 steps, then the clusters' moments."""
    df = spread(df.select("row_id", "features"))
    try:
        first = kmeans.forgy(df, k, seed) if seeds == "forgy" else kmeans.parallel_seeds(df, k, 1.4, seed or 1)
        return hard_moments(df, kmeans.run(df, first, 29, 1e-4).centroids, regularization)
    finally:
        df.unpersist()


STARTS = {"jain": jain, "kmeans": kmeans_start, "kmeansoror": lambda df, k, **o: kmeans_start(df, k, "parallel", **o)}


def start(df: DataFrame, k: int, name: str = "jain", **options) -> Mixture:
    if name not in STARTS:
        raise ValueError(f"unknown start {name!r}; known: {sorted(STARTS)}")
    return STARTS[name](df, k, **options)


def mahalanobis(df: DataFrame, model: Mixture) -> DataFrame:
    """row_id, k, maha2: the squared Mahalanobis distance of each row to each component."""
    inverse, _ = model.factors()
    sent = df.sparkSession.sparkContext.broadcast((model.means, inverse))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, inv = sent.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                z = np.stack([(((x - m) @ i.T) ** 2).sum(axis=1) for m, i in zip(means, inv, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(z)], ["row_id", "z"])

    found = df.select("row_id", "features").mapInArrow(part, "row_id long, z array<double>")
    return found.select("row_id", F.posexplode("z").alias("k", "maha2"))


def component_log_likelihood(df: DataFrame, model: Mixture) -> DataFrame:
    """k, ll: the posterior-weighted sum of each component's log joint density."""
    # gamma_k > 0 gives l_k = ln gamma_k + log density
    found = posterior_table(df, model).select("log_density", F.posexplode("gamma").alias("k", "g"))
    part = F.when(F.col("g") > 0, F.col("g") * (F.ln("g") + F.col("log_density"))).otherwise(0.0)
    return found.groupBy("k").agg(F.sum(part).alias("ll"))


def posterior_gram(posteriors: DataFrame, k: int) -> DataFrame:
    """k1, k2, g: sums of products of posteriors: a K x K table per task, merged in a tree."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                gamma = matrix(batch.column(0))
                total += gamma.T @ gamma
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(1, np.int32)), pa.array([slot()]), lists(total.reshape(1, -1))], ["k", "slot", "g"])

    sums = merged(posteriors.select("gamma").mapInArrow(part, "k int, slot long, g array<double>"), (), ("g",))
    return sums.select(F.posexplode("g").alias("i", "g")).select(F.floor(F.col("i") / k).cast("int").alias("k1"), (F.col("i") % k).cast("int").alias("k2"), "g")
