"""Vector datasets: (row_id, features) tables, their statistics and row access."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ellipsa.functions.vectors import as_doubles

from .partials import lists, matrix, merged, slot


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """(row_id, features): doubles, all dimensions or the first ``dims``."""
    features = as_doubles(F.col(vector_col))
    return df.select(F.col(id_col).cast("long").alias("row_id"), (F.slice(features, 1, dims) if dims else features).alias("features"))


def from_columns(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def header(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).alias("n_cols"))


def column_statistics(df: DataFrame) -> DataFrame:
    """pos (from 0), mean, std, variance (sample), min and max of each column: six numbers a column from each task, merged in a tree.

    The mean is that of SQL: values are added one row after the other, sums of tasks in a fixed order, and divided once, so a mean whose rounding is a tie
    falls as SQL's does if one task holds the table. Squared deviations of parts are combined without cancellation, about means of their own. An empty table gives no
    rows; one row has no variance.
    """
    arrays = ("total", "mean", "m2", "low", "high")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                mean = x.mean(axis=0)
                before = np.zeros((1, x.shape[1])) if found is None else found["total"]
                total = np.cumsum(np.concatenate([before, x]), axis=0)[-1:]  # one row after the other, unlike sum()
                own = {"n": np.array([float(len(x))]), "total": total, "mean": mean[None], "m2": ((x - mean) ** 2).sum(axis=0)[None], "low": x.min(axis=0)[None], "high": x.max(axis=0)[None]}
                found = own if found is None else {c: np.asarray(v)[None] for c, v in _combined({c: np.concatenate([found[c], own[c]]) for c in own}).items()}
                found["total"] = total
        if found is not None:
            columns = [pa.array(np.zeros(1, np.int32)), pa.array([slot()]), pa.array(found["n"]), *[lists(found[c]) for c in arrays]]
            yield pa.RecordBatch.from_arrays(columns, ["k", "slot", "n", *arrays])

    kind = ", ".join(["k int, slot long, n double", *[f"{c} array<double>" for c in arrays]])
    total = merged(df.select("features").mapInArrow(part, kind), ("n",), arrays, merge=_combined)
    each = total.select("n", F.posexplode(F.arrays_zip("total", "m2", "low", "high")).alias("pos", "c"))
    variance = F.when(F.col("n") > 1, F.col("c.m2") / (F.col("n") - 1))
    return each.select("pos", (F.col("c.total") / F.col("n")).alias("mean"), F.sqrt(variance).alias("std"), variance.alias("variance"), F.col("c.low").alias("min"), F.col("c.high").alias("max"))


def _combined(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Statistics of all parts: sums in their order, squared deviations about the common mean."""
    n = c["n"].sum()
    mean = (c["n"][:, None] * c["mean"]).sum(axis=0) / n
    m2 = c["m2"].sum(axis=0) + (c["n"][:, None] * (c["mean"] - mean) ** 2).sum(axis=0)
    return {"n": n, "total": np.cumsum(c["total"], axis=0)[-1], "mean": mean, "m2": m2, "low": c["low"].min(axis=0), "high": c["high"].max(axis=0)}


def covariance_trace(df: DataFrame) -> DataFrame:
    return column_statistics(df).agg(F.sum("variance").alias("trace_cov"))


def standardized(df: DataFrame) -> DataFrame:
    """z-scores by the sample deviation; a constant column becomes 0. The d statistics are a constant of the plan."""
    stats = column_statistics(df).orderBy("pos").collect()
    mean = F.array(*[F.lit(r["mean"]) for r in stats])
    std = F.array(*[F.lit(r["std"] or 1.0) for r in stats])
    centred = F.zip_with("features", mean, lambda x, m: x - m)
    return df.select("row_id", F.zip_with(centred, std, lambda x, s: x / s).alias("features"))


def layout(df: DataFrame, parts: int) -> DataFrame:
    """part, start, n: a balanced split of the rows, the first parts one row larger."""
    n = df.count()
    spark = df.sparkSession
    i = F.col("id")
    return spark.range(parts).select(i.cast("int").alias("part"), (i * (n // parts) + F.least(i, F.lit(n % parts))).cast("long").alias("start"), (F.lit(n // parts) + (i < n % parts).cast("int")).cast("long").alias("n"))


def partition_counts(df: DataFrame) -> DataFrame:
    """part, n: how many rows each partition holds; empty ones have no row."""
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))


def from_array(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    """A dataset of the rows of a matrix that the driver holds; row_id is the row's number."""
    rows = np.asarray(rows, float)
    return spark.createDataFrame(pa.table([pa.array(np.arange(len(rows))), lists(rows)], ["row_id", "features"]))


def select_rows(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """pos, row_id, features: the rows asked for, in order, repeats kept. The ids are joined, so there may be any number of them."""
    asked = df.sparkSession.createDataFrame(pa.table([pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(np.asarray(ids, np.int64))], ["pos", "row_id"]))
    return df.join(asked, "row_id").select("pos", "row_id", "features")


def fetch_row(df: DataFrame, row_id: int) -> np.ndarray:
    """The vector of one row; an error if there is no such row."""
    found = df.where(F.col("row_id") == int(row_id)).select("features").head()
    if found is None:
        raise KeyError(row_id)
    return np.array(found["features"])


def rows_by_hash(df: DataFrame, k: int, seed: int | None = None) -> list:
    """The k rows of least md5 of row_id, after the seed if there is one: a random pick without replacement that every engine repeats."""
    key = F.col("row_id").cast("string")
    return df.orderBy(F.md5(key if seed is None else F.concat(F.lit(f"{seed}:"), key)), "row_id").limit(k).collect()
