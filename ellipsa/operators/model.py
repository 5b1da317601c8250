"""Model tables: centroids and Gaussian mixtures. They are small; their algebra is numpy on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession


class MixtureError(ValueError):
    """A mixture that can't be factorised or whose component has no rows."""


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray  # K
    means: np.ndarray  # K x d
    covs: np.ndarray  # K x d x d

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def d(self) -> int:
        return self.means.shape[1]

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(inverse triangular factors, log determinants); only the lower triangles of the covariances count."""
        low = np.tril(self.covs)
        full = low + np.transpose(np.tril(self.covs, -1), (0, 2, 1))
        try:
            chol = np.linalg.cholesky(full)
        except np.linalg.LinAlgError as e:
            raise MixtureError("a covariance isn't positive definite; regularize it") from e
        inverse = np.stack([np.linalg.solve(c, np.eye(self.d)) for c in chol]) if self.k else chol
        return inverse, 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """ln w_k + ln N(x; mean_k, cov_k), rows by components."""
        inverse, logdet = self.factors()
        return log_joint(x, self.weights, self.means, inverse, logdet)

    def regularized(self, g: float) -> Mixture:
        """(1 - g) cov + g trace / d I."""
        trace = np.trace(self.covs, axis1=1, axis2=2)
        return replace(self, covs=(1 - g) * self.covs + (g * trace / self.d)[:, None, None] * np.eye(self.d))

    def condition_numbers(self) -> np.ndarray:
        """|largest / smallest eigenvalue| of each covariance."""
        values = np.linalg.eigvalsh(self.covs)
        return np.abs(values[:, -1] / values[:, 0])

    def traces(self) -> np.ndarray:
        return np.trace(self.covs, axis1=1, axis2=2)

    def normalized(self) -> Mixture:
        return replace(self, weights=self.weights / self.weights.sum())

    def split(self, i: int, first: tuple, second: tuple) -> Mixture:
        """Component i replaced by the first (weight, mean, cov), the second added at the end."""
        w, m, c = (np.concatenate([x, [y]]) for x, y in zip((self.weights, self.means, self.covs), second, strict=True))
        w[i], m[i], c[i] = first
        return Mixture(w, m, c)

    def merged(self, i: int, j: int, made: tuple) -> Mixture:
        """Component i replaced by (weight, mean, cov), component j gone."""
        w, m, c = self.weights.copy(), self.means.copy(), self.covs.copy()
        w[i], m[i], c[i] = made
        keep = np.arange(self.k) != j
        return Mixture(w[keep], m[keep], c[keep])


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, inverse: np.ndarray, logdet: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(weights)))
    with np.errstate(divide="ignore"):
        const = np.log(weights) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + logdet)
    for k in range(len(weights)):
        z = (x - means[k]) @ inverse[k].T
        out[:, k] = const[k] - 0.5 * np.einsum("ij,ij->i", z, z)
    return out


def bhattacharyya(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    """Distance of two normal densities, by log determinants, never negative."""
    s, diff = (c1 + c2) / 2, m1 - m2
    dets = [np.linalg.slogdet(c)[1] for c in (s, c1, c2)]
    return max(0.0, float(diff @ np.linalg.solve(s, diff) / 8 + 0.5 * (dets[0] - (dets[1] + dets[2]) / 2)))


def mixture_table(spark: SparkSession, m: Mixture) -> DataFrame:
    """k, weight, mean, cov, and the trace and condition number of the covariance."""
    worst, traces = m.condition_numbers(), m.traces()
    rows = [(k, float(m.weights[k]), m.means[k].tolist(), m.covs[k].tolist(), float(traces[k]), float(worst[k])) for k in range(m.k)]
    return spark.createDataFrame(rows, "k int, weight double, mean array<double>, cov array<array<double>>, trace double, condition double")


def from_table(df: DataFrame) -> Mixture:
    rows = df.orderBy("k").collect()
    return Mixture(*(np.array([r[c] for r in rows], float) for c in ("weight", "mean", "cov")))


def centroids_of(df: DataFrame) -> np.ndarray:
    """The matrix of a table of centroids."""
    return np.array([r["centroid"] for r in df.orderBy("k").collect()], float)


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "k int, centroid array<double>")
