"""Files of mixtures and centroids: models are small, so the driver reads and writes them.

Little-endian. Mixture: int32 K, int32 d; for each component the d x d covariance by rows, the mean and the weight in double precision; then one
double, the log-likelihood. Centroids: int32 K, int32 d, K x d doubles.
"""

from __future__ import annotations

import struct

import numpy as np

from ellipsa.operators.model import Mixture

from .files import FormatError, located


def _read(path: str) -> tuple[int, int, np.ndarray]:
    system, name = located(path)
    with system.open_input_file(name) as f:
        data = f.read()
    if len(data) < 8 or len(data) % 8:
        raise FormatError(f"{path}: {len(data)} bytes aren't a header and doubles")
    k, d = struct.unpack_from("<ii", data)
    if k < 1 or d < 1:
        raise FormatError(f"{path}: {k} components of {d} dimensions")
    return k, d, np.frombuffer(data, "<f8", offset=8)


def _write(path: str, k: int, d: int, values: np.ndarray) -> None:
    system, name = located(path)
    with system.open_output_stream(name) as f:
        f.write(struct.pack("<ii", k, d) + np.ascontiguousarray(values, "<f8").tobytes())


def write_mixture(path: str, model: Mixture, log_likelihood: float = 0.0) -> None:
    each = np.concatenate([model.covs.reshape(model.k, -1), model.means, model.weights[:, None]], axis=1)
    _write(path, model.k, model.d, np.append(each.ravel(), log_likelihood))


def read_mixture(path: str) -> tuple[Mixture, float]:
    """The mixture and its log-likelihood."""
    k, d, values = _read(path)
    if len(values) != k * (d * d + d + 1) + 1:
        raise FormatError(f"{path}: {len(values)} values for {k} components of {d} dimensions")
    each = values[:-1].reshape(k, -1)
    return Mixture(each[:, -1].copy(), each[:, d * d : -1].copy(), each[:, : d * d].reshape(k, d, d).copy()), float(values[-1])


def write_centroids(path: str, centroids: np.ndarray) -> None:
    _write(path, *centroids.shape, centroids.ravel())


def read_centroids(path: str, k: int | None = None, d: int | None = None) -> np.ndarray:
    """Centroids, checked against the numbers wanted."""
    has_k, has_d, values = _read(path)
    if len(values) != has_k * has_d or (k or has_k, d or has_d) != (has_k, has_d):
        raise FormatError(f"{path}: {len(values)} values, {has_k} centroids of {has_d} dimensions")
    return values.reshape(has_k, has_d).copy()
