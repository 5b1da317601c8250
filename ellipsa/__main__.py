"""Command line: ``python -m ellipsa start`` makes a first mixture of a dataset, ``python -m ellipsa em`` fits one.

A dataset is a binary vector file or folder, or a Parquet table with row_id and features.
"""

from __future__ import annotations

import argparse
import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ellipsa.operators import em, kmeans
from ellipsa.operators.dataset import vectors
from ellipsa.operators.model import Mixture
from ellipsa.sources import binary, models


def load(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return vectors(spark.read.parquet(path), "row_id", "features")
    return vectors(binary.read_vectors(spark, path), "row_id", "features")


def first_mixture(df: DataFrame, k: int, name: str, seed: int = 1) -> Mixture:
    """By the name of a start, from a mixture file, or by k-means from a centroid file; a file must have ``k`` components unless k is 1."""
    if name in em.STARTS:
        return em.start(df, k, name, seed=seed)
    if name.endswith(".centroids"):
        centroids = models.read_centroids(name, None if k == 1 else k)
        return em.hard_moments(df, kmeans.run(df, centroids, 29, 1e-4).centroids)
    model, _ = models.read_mixture(name)
    if k not in (1, model.k):
        raise ValueError(f"{name} has {model.k} components, not {k}")
    return model


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ellipsa", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    start, fit = sub.add_parser("start"), sub.add_parser("em")
    for p, init in ((start, "kmeans"), (fit, "jain")):
        p.add_argument("dataset")
        p.add_argument("-c", "--components", type=int, default=1)
        p.add_argument("-I", "--init", default=init, help=f"{', '.join(em.STARTS)}, a mixture file, or a file of centroids named *.centroids")
        p.add_argument("-g", "--regularization", type=float, default=0.0)
        p.add_argument("-r", "--seed", type=int, default=1)
        p.add_argument("-o", "--output", help="mixture file to write")
    fit.add_argument("-m", "--max-sweeps", type=int, default=1_000_000)
    fit.add_argument("-f", "--eps", type=float, default=1e-5)
    fit.add_argument("-a", "--abort-condition", type=float, default=1e5)
    fit.add_argument("-b", "--burn-in", type=int, default=0, help="sweeps before the timed fit, thrown away")
    fit.add_argument("-S", "--no-condition-check", action="store_true")
    fit.add_argument("-v", "--verbose", action="store_true", help="a line for each sweep")
    fit.add_argument("-O", "--classes", help="folder to write each row's component to")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    top = parser()
    a = top.parse_args(argv)
    if a.components < 1 or not 0 <= a.regularization <= 1:
        top.error("components must be positive, regularization from 0 to 1")
    if a.command == "em" and (a.eps <= 0 or a.abort_condition < 1 or a.max_sweeps < 0 or a.burn_in < 0):
        top.error("eps must be positive, the condition limit 1 or more, sweeps not negative")
    spark = spark or SparkSession.builder.appName("ellipsa").getOrCreate()
    began = time.perf_counter()
    df = load(spark, a.dataset)
    model = first_mixture(df, a.components, a.init, a.seed)
    report: dict = {"components": model.k, "dimensions": model.d, "start_seconds": round(time.perf_counter() - began, 3)}
    likelihood = 0.0
    if a.command == "start":
        model = model.regularized(a.regularization)
    else:
        params = em.EMParams(a.max_sweeps, a.eps, a.abort_condition, a.regularization, not a.no_condition_check)
        if a.burn_in:
            em.fit(df, model, em.EMParams(a.burn_in, 1e-300, a.abort_condition, a.regularization, not a.no_condition_check))
        began = time.perf_counter()
        found = em.fit(df, model, params)
        if a.verbose:
            for i, h in enumerate(found.history):
                print(json.dumps({"sweep": i + 1, **{n: bool(v) if isinstance(v, (bool, np.bool_)) else float(v) for n, v in h.items()}}))
        took, model, likelihood = time.perf_counter() - began, found.model, found.log_likelihood
        sweeps = len(found.history)
        report |= {"sweeps": sweeps, "seconds": round(took, 3), "ms_per_sweep": round(1000 * took / max(1, sweeps), 1), "log_likelihood": likelihood}
        if a.classes:
            binary.write_classes(em.posterior_table(df, model).select("row_id", "cluster"), a.classes)
    if a.output:
        models.write_mixture(a.output, model, likelihood)
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
