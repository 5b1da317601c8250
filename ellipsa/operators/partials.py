"""Merging of what tasks have summed up: a tree, so that no worker gets more than a few tables of moments at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial rows of one key that a merging call gets, about, for up to ``FAN`` ** (len(LEVELS) + 1) tasks.
FAN = 64
LEVELS = (FAN**2, FAN)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column, without a Python number."""
    rows = np.ascontiguousarray(rows, np.float64)
    ends = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[: len(rows) + 1]), pa.array(rows.ravel()))


def slot() -> int:
    """The number of the task that sums up; it decides the order of sums, not the order of arrival."""
    return TaskContext.get().partitionId()


Merge = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def added(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of all columns."""
    return {name: values.sum(axis=0) for name, values in columns.items()}


def merged(parts: DataFrame, numbers: Sequence[str], vectors: Sequence[str], tasks: int | None = None, merge: Merge = added) -> DataFrame:
    """One row per ``k`` of ``parts`` (k int, slot long, doubles ``numbers``, arrays of doubles ``vectors``).

    Rows of a key meet by ``slot`` modulo the levels of the tree, then all together. ``tasks``, where it is known, leaves out levels that
    aren't needed.
    """
    schema = ", ".join(["k int, slot long", *[f"{c} double" for c in numbers], *[f"{c} array<double>" for c in vectors]])

    def meet(table: pa.Table) -> pa.Table:
        order = np.argsort(table["slot"].to_numpy(), kind="stable")
        columns = {c: table[c].to_numpy()[order] for c in numbers}
        columns |= {c: matrix(table[c].combine_chunks())[order] for c in vectors}
        out = merge(columns)
        made = [pa.array([table["k"][0].as_py()], pa.int32()), pa.array([int(table["slot"].to_numpy().min())])]
        made += [pa.array([float(out[c])]) for c in numbers] + [lists(out[c][None]) for c in vectors]
        return pa.table(made, ["k", "slot", *numbers, *vectors])

    for modulus in LEVELS:
        if tasks is None or tasks > modulus:
            parts = parts.groupBy("k", F.pmod("slot", F.lit(modulus)).alias("of")).applyInArrow(meet, schema)
    return parts.groupBy("k").applyInArrow(meet, schema)


def tasks_of(df: DataFrame) -> int:
    """Partitions of a persisted table."""
    return df.rdd.getNumPartitions()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` persisted; dealt out anew first if it has fewer partitions than ``least`` (the cores), as a file of one row group has."""
    df = df.persist()
    least = least or df.sparkSession.sparkContext.defaultParallelism
    if tasks_of(df) >= least:
        return df
    out = df.repartition(least).persist()
    out.count()
    df.unpersist()
    return out
