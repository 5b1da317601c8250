"""K-means: assignment, its aggregates, Lloyd steps with repair of empty clusters, and seeding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ellipsa.functions.vectors import squared_distance, uniform

from .dataset import column_statistics, from_array, rows_by_hash
from .partials import lists, matrix, merged, slot, spread, tasks_of

#: Numbers of a table of distances that is computed at once.
BLOCK = 1 << 21


def numpy_nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, d2) of the nearest centroid of each row; of equally near ones the lowest k.

    A matrix product finds those that may be nearest; their distances are then summed from the first dimension to the last, in every case, so
    the result depends neither on the number of centroids nor on how rows come in batches.
    """
    if len(x) * len(c) > BLOCK and len(x) > 1:
        step = max(1, BLOCK // len(c))
        parts = [numpy_nearest(x[i : i + step], c) for i in range(0, len(x), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    mean = c.mean(axis=0)  # products of centred vectors lose fewer digits
    y, m = x - mean, c - mean
    norms, size = (y * y).sum(axis=1), (m * m).sum(axis=1)
    about = size[None, :] - 2 * (y @ m.T)
    may = about <= about.min(axis=1, keepdims=True) + (1e-10 * (norms + size.max()) + 1e-300)[:, None]
    i, k = np.nonzero(may | np.isnan(about))
    d2 = np.zeros(len(i))
    for j in range(x.shape[1]):
        diff = x[i, j] - c[k, j]
        d2 += diff * diff
    first = np.searchsorted(i, np.arange(len(x)))
    least = np.minimum.reduceat(d2, first) if len(x) else d2
    hit = np.flatnonzero(d2 == least[i]) if len(x) else first
    hit = hit[np.searchsorted(i[hit], np.arange(len(x)))] if len(x) else hit
    return k[hit], d2[hit]


def _with_nearest(df: DataFrame, centroids: np.ndarray, names: tuple[str, str]) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(centroids)  # K x d numbers, which the driver holds anyway
    at = df.columns.index("features")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, d2 = numpy_nearest(matrix(batch.column(at)), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32)), pa.array(d2)], [*batch.schema.names, *names])

    return df.mapInArrow(part, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{names[0]}` int, `{names[1]}` double")


def assign(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``df`` with cluster and d2: no join and no shuffle."""
    return _with_nearest(df, centroids, ("cluster", "d2"))


def mean_squared_error(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    return assign(df, centroids).agg(F.avg("d2").alias("mse"))


def cluster_totals(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sse of every cluster, empty ones too."""
    found = assign(df, centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("sse"))
    every = df.sparkSession.range(len(centroids)).select(F.col("id").cast("int").alias("cluster"))
    return every.join(F.broadcast(found), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sse", F.lit(0.0)).alias("sse"))


def error_of(df: DataFrame, centroids: np.ndarray, label: str) -> DataFrame:
    """mse: the mean squared distance to the centroid that the column ``label`` names. Rows without a label don't count."""
    there = _centroid_each(df.where(F.col(label).isNotNull()).select("features", F.col(label).cast("int").alias("k")), centroids)
    return there.agg(F.avg(squared_distance(F.col("features"), F.col("centroid"))).alias("mse"))


def _centroid_each(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``df`` with the centroid that its column k, the last one, names."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(sent.value[batch.columns[-1].to_numpy()])], [*batch.schema.names, "centroid"])

    return df.mapInArrow(part, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", centroid array<double>")


def centroid_distances(centroids: np.ndarray) -> list[tuple[int, int, float]]:
    """(k1, k2, d2) of each pair of centroids."""
    return [(i, j, float(((centroids[i] - centroids[j]) ** 2).sum())) for i in range(len(centroids)) for j in range(i + 1, len(centroids))]


def shifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Squared way of each centroid."""
    return ((after - before) ** 2).sum(axis=1)


def rows_of_cluster(assigned: DataFrame, cluster: int) -> DataFrame:
    """The ids of a cluster's rows, ascending."""
    return assigned.where(F.col("cluster") == cluster).select("row_id").orderBy("row_id")


def group_means(df: DataFrame, label: str) -> DataFrame:
    """label, pos, mean for each whole number in the column ``label``; rows without one don't count. A task emits a row per label and batch."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                order = np.argsort(k, kind="stable")
                found, first, n = np.unique(k[order], return_index=True, return_counts=True)
                columns = [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), slot())), pa.array(n.astype(float)), lists(np.add.reduceat(x[order], first, axis=0))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "slot", "n", "s"])

    known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("k"), "features")
    sums = merged(known.mapInArrow(part, "k int, slot long, n double, s array<double>"), ("n",), ("s",))
    return sums.select(F.col("k").alias(label), "n", F.posexplode("s").alias("pos", "x")).select(label, "pos", (F.col("x") / F.col("n")).alias("mean"))


def quantized(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each row's vector replaced by its centroid."""
    found = _centroid_each(assign(df.select("row_id", "features"), centroids).select("row_id", "cluster"), centroids)
    return found.select("row_id", "cluster", F.col("centroid").alias("features"))


def sorted_centroids(centroids: np.ndarray) -> np.ndarray:
    """Descending, first coordinate first."""
    return np.array(sorted(centroids.tolist(), reverse=True))


@dataclass
class Step:
    centroids: np.ndarray
    counts: np.ndarray
    fit: float  # mean squared distance to the centroids before the step
    changed: int = 0
    position: int = 0  # where the next repair goes on


_KIND = "k int, slot long, n double, fit double, moved double, s array<double>"


def lloyd_step(df: DataFrame, centroids: np.ndarray, repair: str = "first", seed: int = 1, before: np.ndarray | None = None, position: int = 0, tasks: int | None = None) -> Step:
    """One step in one job: a row per cluster and task is merged by cluster, K rows reach the driver.

    Empty clusters become the next rows in order of id, from ``position`` on and round again (``first``), or hash-random rows (``random``). ``before``: the
    centroids of the step before, to count the rows that changed cluster; without it all rows were in cluster 0.
    """
    sent = df.sparkSession.sparkContext.broadcast((centroids, before))
    k, d = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, old), n, s, fit, moved = sent.value, np.zeros(k), np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                mine, d2 = numpy_nearest(x, c)
                n += np.bincount(mine, minlength=k)
                fit += np.bincount(mine, d2, k)
                moved += np.bincount(mine, mine != (numpy_nearest(x, old)[0] if old is not None else 0), k)
                order = np.argsort(mine, kind="stable")
                found, first = np.unique(mine[order], return_index=True)
                s[found] += np.add.reduceat(x[order], first, axis=0)
        on = np.flatnonzero(n)
        columns = [pa.array(on.astype(np.int32)), pa.array(np.full(len(on), slot())), pa.array(n[on]), pa.array(fit[on]), pa.array(moved[on]), lists(s[on])]
        yield pa.RecordBatch.from_arrays(columns, ["k", "slot", "n", "fit", "moved", "s"])

    try:
        rows = merged(df.select("features").mapInArrow(part, _KIND), ("n", "fit", "moved"), ("s",), tasks).collect()
    finally:
        sent.destroy()
    out, counts, fit, changed = centroids.copy(), np.zeros(k, np.int64), 0.0, 0
    for r in sorted(rows, key=lambda r: r["k"]):
        out[r["k"]], counts[r["k"]] = np.array(r["s"]) / r["n"], int(r["n"])
        fit, changed = fit + r["fit"], changed + int(r["moved"])
    total = int(counts.sum())
    if not total:
        raise ValueError("no rows")
    if (empty := np.flatnonzero(counts == 0)).size:
        out[empty] = _repairs(df, len(empty), total, repair, seed, position)
        position = (position + len(empty)) % total
    return Step(out, counts, fit / total, changed, position)


def _repairs(df: DataFrame, n: int, total: int, repair: str, seed: int, position: int) -> np.ndarray:
    """``n`` rows that empty clusters become."""
    if repair == "random":
        pick = df.orderBy(uniform(F.col("row_id"), f"{seed}:{position}"), "row_id").limit(n).collect()
    elif repair == "first":
        position %= total
        pick = df.orderBy("row_id").offset(position).limit(n).collect()
        if len(pick) < min(n, total):  # round again
            pick += df.orderBy("row_id").limit(min(n, total) - len(pick)).collect()
    else:
        raise ValueError(f"unknown repair {repair!r}; known: first, random")
    return np.array([pick[i % len(pick)]["features"] for i in range(n)])


@dataclass
class KMeansResult:
    centroids: np.ndarray
    fit: float
    history: list[float] = field(default_factory=list)
    changed: list[int] = field(default_factory=list)

    def report(self) -> list[tuple[int, float, int]]:
        """(step, mean squared distance before it, rows that changed cluster; -1 where they weren't counted) of each step."""
        moved = self.changed or [-1] * len(self.history)
        return [(i + 1, f, m) for i, (f, m) in enumerate(zip(self.history, moved, strict=True))]


def run(df: DataFrame, centroids: np.ndarray, max_iter: int = 100, min_rel: float = -1.0, **step) -> KMeansResult:
    """Lloyd steps while the fit gets strictly better, at most ``max_iter``; stops once the relative gain is under a positive ``min_rel``."""
    best, history, position = np.inf, [], 0
    df = spread(df.select("row_id", "features"))
    tasks = tasks_of(df)
    try:
        for _ in range(max_iter):
            done = lloyd_step(df, centroids, position=position, tasks=tasks, **step)
            centroids, position = done.centroids, done.position
            history.append(done.fit)
            gain = (best - done.fit) / best if np.isfinite(best) else np.inf
            if not done.fit < best:
                break
            best = done.fit
            if 0 < min_rel and gain < min_rel:
                break
    finally:
        df.unpersist()
    return KMeansResult(centroids, float(best), history)


def run_until_stable(df: DataFrame, centroids: np.ndarray, max_iter: int = 100, **step) -> KMeansResult:
    """Steps until no row changes its cluster, at most ``max_iter``."""
    before, history, changed, position = None, [], [], 0
    df = spread(df.select("row_id", "features"))
    tasks = tasks_of(df)
    try:
        for i in range(max_iter):
            done = lloyd_step(df, centroids, before=before, position=position, tasks=tasks, **step)
            before, centroids, position = centroids, done.centroids, done.position
            history.append(done.fit)
            changed.append(done.changed)
            if i and not done.changed:
                break
    finally:
        df.unpersist()
    return KMeansResult(centroids, history[-1] if history else 0.0, history, changed)


def drawn(text: str) -> float:
    """U[0, 1) of a text: the driver's form of ``vectors.uniform``, the same number in every run and engine."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def normal(text: str, mean: float = 0.0, deviation: float = 1.0) -> float:
    """A normal number of a text, by the polar form of two uniform ones."""
    return mean + deviation * float(np.sqrt(-2 * np.log(1 - drawn(text + ":0"))) * np.cos(2 * np.pi * drawn(text + ":1")))


def cauchy(text: str, median: float = 0.0, scale: float = 1.0) -> float:
    """A Cauchy number of a text, by the inverse distribution function."""
    return median + scale * float(np.tan(np.pi * (drawn(text) - 0.5)))


def perturbed(centroids: np.ndarray, std: np.ndarray, temperature: float, key: str) -> np.ndarray:
    """Each number moved by up to half its column's deviation times the root of the temperature, by a draw of key, cluster and column."""
    noise = np.array([[drawn(f"{key}:{k}:{j}") - 0.5 for j in range(centroids.shape[1])] for k in range(len(centroids))])
    return centroids + noise * std * np.sqrt(temperature)


def run_relaxed(df: DataFrame, centroids: np.ndarray, steps: int, seed: int = 1) -> KMeansResult:
    """Steps each followed by noise of the columns' deviations that cools down with the fourth power, by a budget of steps."""
    df = spread(df.select("row_id", "features"))
    history, position = [], 0
    try:
        std = np.array([r["std"] or 0.0 for r in column_statistics(df).orderBy("pos").collect()])
        for t in range(steps):
            done = lloyd_step(df, centroids, position=position, tasks=tasks_of(df))
            position = done.position
            history.append(done.fit)
            centroids = perturbed(done.centroids, std, (1 - (t + 1) / steps) ** 4, f"{seed}:{t}")
    finally:
        df.unpersist()
    return KMeansResult(centroids, history[-1] if history else 0.0, history)


def forgy(df: DataFrame, k: int, seed: int | None = None) -> np.ndarray:
    return np.array([r["features"] for r in rows_by_hash(df, k, seed)])


def random_partition(df: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """Means of a hash-random partition of the rows."""
    part = F.least(F.floor(uniform(F.col("row_id"), seed) * k), F.lit(k - 1)).cast("int")
    rows = group_means(df.withColumn("part", part), "part").collect()
    out = np.full((k, 1 + max(r["pos"] for r in rows)), np.nan)
    for r in rows:
        out[r["part"], r["pos"]] = r["mean"]
    return out


def min_dist(df: DataFrame, k: int, trials: int = 16, seed: int | None = None) -> np.ndarray:
    """Of ``trials`` candidate rows: first the one nearest the mean, then the ones farthest from those chosen; ties to the earlier candidate."""
    mean = np.array([r["mean"] for r in column_statistics(df).orderBy("pos").collect()])
    found = np.array([r["features"] for r in rows_by_hash(df, trials * k, seed)])
    first = found[:trials]
    chosen = [first[((first - mean) ** 2).sum(axis=1).argmin()]]
    for i in range(1, k):
        some = found[i * trials : (i + 1) * trials]
        some = some if len(some) else found
        chosen.append(some[np.min([((some - c) ** 2).sum(axis=1) for c in chosen], axis=0).argmax()])
    return np.array(chosen)


def plus_plus(points: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """Weighted D2 sampling over a candidate table on the driver; the first centre is uniform. Draws are those of ``drawn``: seed and step."""
    weights = np.ones(len(points)) if weights is None else np.asarray(weights, float)
    if len(np.unique(points, axis=0)) < k:
        raise ValueError(f"{k} centres need as many distinct candidates")
    chosen = [points[int(drawn(f"{seed}:0") * len(points))]]
    d2 = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = np.cumsum(d2 * weights)
        at = int(np.searchsorted(mass / mass[-1], drawn(f"{seed}:{len(chosen)}"), side="left"))
        while not d2[at] * weights[at]:  # a draw of 0 names the first row of some mass
            at += 1
        chosen.append(points[at])
        d2 = np.minimum(d2, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def closest_update(df: DataFrame, new: np.ndarray, first_k: int) -> DataFrame:
    """Carried (closest_d2, closest_k) against new centres only, numbered from ``first_k``; an old one wins ties."""
    found = _with_nearest(df, new, ("_k", "_d2"))
    better = F.col("_d2") < F.col("closest_d2")
    return found.select(
        *[c for c in df.columns if not c.startswith("closest_")],
        F.when(better, F.col("_d2")).otherwise(F.col("closest_d2")).alias("closest_d2"),
        F.when(better, F.col("_k") + first_k).otherwise(F.col("closest_k")).cast("int").alias("closest_k"),
    )


def cost(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    return assign(df, centroids).agg(F.sum("d2").alias("cost"))


def parallel_seeds(df: DataFrame, k: int, oversample: float = 1.4, seed: int = 1) -> np.ndarray:
    """K-means||: a few rounds that keep each row with probability min(1, oversample K D2 / cost), then weighted k-means++.

    Each row's random number is a hash of seed, round and id, so runs repeat whatever the partitioning. A row carries its distance to the nearest
    candidate, so a round measures it against the round's new candidates only. About 1 + rounds x oversample x K candidates reach the driver.
    """
    df = spread(df.select("row_id", "features"))
    held = [df]
    try:
        found = np.array([r["features"] for r in df.orderBy(uniform(F.col("row_id"), seed), "row_id").limit(1).collect()])
        now = _with_nearest(df, found, ("closest_k", "closest_d2")).persist()
        held.append(now)
        for r in range(10 if oversample <= 0.1 else 5):
            total = now.agg(F.sum("closest_d2")).first()[0]
            if not total:
                break
            keep = now.where(uniform(F.col("row_id"), seed * 1000 + r + 1) < F.least(F.lit(1.0), F.col("closest_d2") * (oversample * k / total)))
            new = [x["features"] for x in keep.select("row_id", "features").orderBy("row_id").collect()]
            if new:
                now = closest_update(now, np.array(new), len(found)).persist()
                held.append(now)
                found = np.concatenate([found, np.array(new)])
        counts = {r["closest_k"]: r["count"] for r in now.groupBy("closest_k").count().collect()}  # a row per candidate
    finally:
        for table in held:
            table.unpersist()
    return plus_plus(found, k, np.array([counts.get(i, 0) for i in range(len(found))], float), seed)


def weight_table(candidates: DataFrame) -> DataFrame:
    """candidates (id, mass) with cdf: the running share of the mass by id. For candidate tables, which are small."""
    w = Window.orderBy("id")
    return candidates.select("id", "mass", (F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("mass").over(Window.partitionBy())).alias("cdf"))


def pick(table: DataFrame, r: float) -> DataFrame:
    """The first row whose cdf reaches r."""
    return table.where(F.col("cdf") >= r).orderBy("id").limit(1)
