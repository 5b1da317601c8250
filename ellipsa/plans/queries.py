"""The library's queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ellipsa.functions.vectors import dot, squared_distance, squared_norm
from ellipsa.operators import dataset, em, kmeans
from ellipsa.operators.model import Mixture, bhattacharyya, centroid_table, centroids_of, mixture_table
from ellipsa.operators.partials import spread
from ellipsa.session import own_dir, read_table
from ellipsa.sources import binary, models

from .registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]

K = 5


def r6(c) -> F.Column:
    return (F.round(c, 6) + F.lit(0.0)).cast("double")


def vecs(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    return dataset.vectors(read_table(spark, d, "embeddings"), dims=dims)


def seeds(df: DataFrame, k: int = K) -> np.ndarray:
    return kmeans.forgy(df, k)


def x(i: int):
    return F.element_at("features", i)


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# SQL building blocks

R = "round({}, 6) + 0.0"
X = "x AS MATERIALIZED (SELECT vec_id AS row_id, embedding::DOUBLE[] AS f FROM embeddings)"
X2 = "x AS MATERIALIZED (SELECT vec_id AS row_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS f FROM embeddings)"


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def draw(text: str) -> str:
    """U[0, 1) of a text, as ``vectors.uniform`` and ``kmeans.drawn`` have it."""
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0::DOUBLE)"


def seeded(k: int = K, first: int = 0, name: str = "s", seed: int | None = None) -> str:
    key = "cast(row_id AS varchar)" if seed is None else f"'{seed}:' || row_id"
    return f"{name} AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY h, row_id) - 1 - {first} AS integer) AS k, f FROM (SELECT md5({key}) AS h, row_id, f FROM x) QUALIFY row_number() OVER (ORDER BY h, row_id) BETWEEN {first + 1} AND {first + k})"


def assigned(centroids: str = "s", name: str = "a") -> str:
    return f"{name} AS MATERIALIZED (SELECT row_id, f, k AS cluster, d2 FROM (SELECT x.row_id, x.f, c.k, {d2('x.f', 'c.f')} AS d2 FROM x, {centroids} c) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d2, k) = 1)"


def stepped(before: str, a: str, name: str) -> str:
    """Means of the clusters of ``a``; an empty one stays, which the repair query alone meets."""
    return f"""{name}_m AS MATERIALIZED (SELECT cluster, i, avg(f[i]) AS m FROM {a}, (SELECT unnest(range(1, len(f) + 1)) AS i FROM (SELECT f FROM x LIMIT 1)) GROUP BY cluster, i),
{name} AS MATERIALIZED (SELECT {before}.k, coalesce((SELECT list(m ORDER BY i) FROM {name}_m WHERE cluster = {before}.k), {before}.f) AS f FROM {before})"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# scans and statistics


@register("query_header", "SELECT count(*) AS n_rows, cast(max(len(embedding)) AS integer) AS n_cols FROM embeddings")
def query_header(spark, d):
    return dataset.header(vecs(spark, d))


@register("row_range_scan", f"SELECT vec_id AS row_id, {R.format('embedding[1]::DOUBLE')} AS x1 FROM embeddings WHERE vec_id BETWEEN 100 AND 199")
def row_range_scan(spark, d):
    return vecs(spark, d).where(F.col("row_id").between(100, 199)).select("row_id", r6(x(1)).alias("x1"))


@register("partition_layout", "SELECT cast(p - 1 AS integer) AS part, min(rn) AS start, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY vec_id) AS p, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings) GROUP BY p")
def partition_layout(spark, d):
    return dataset.layout(vecs(spark, d), 7)


@register("select_rows", f"SELECT cast(pos AS integer) AS pos, vec_id AS row_id, {R.format('embedding[2]::DOUBLE')} AS x2 FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 250)) t(pos, id) JOIN embeddings ON vec_id = id")
def select_rows(spark, d):
    return dataset.select_rows(vecs(spark, d), [5, 3, 5, 250]).select("pos", "row_id", r6(x(2)).alias("x2"))


_columns = "v AS (SELECT cast(i - 1 AS integer) AS pos, f[i] AS v FROM x, (SELECT unnest(range(1, len(f) + 1)) AS i FROM (SELECT f FROM x LIMIT 1)))"


@register("column_stats", with_(X, _columns) + f"SELECT pos, {R.format('avg(v)')} AS mean, {R.format('stddev_samp(v)')} AS std, {R.format('var_samp(v)')} AS variance, {R.format('min(v)')} AS min, {R.format('max(v)')} AS max FROM v GROUP BY pos")
def column_stats(spark, d):
    return dataset.column_statistics(vecs(spark, d)).select("pos", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "variance", "min", "max")])


@register("cov_trace", with_(X, _columns) + f"SELECT {R.format('sum(s)')} AS trace_cov FROM (SELECT var_samp(v) AS s FROM v GROUP BY pos)")
def cov_trace(spark, d):
    return dataset.covariance_trace(vecs(spark, d)).select(r6(F.col("trace_cov")).alias("trace_cov"))


@register("lineitem_stats", f"SELECT cast(pos AS integer) AS pos, {R.format('avg(v)')} AS mean, {R.format('var_samp(v)')} AS variance FROM (SELECT unnest([0, 1, 2]) AS pos, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS v FROM lineitem) GROUP BY pos")
def lineitem_stats(spark, d):
    df = dataset.from_columns(read_table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_discount", "l_tax"])
    return dataset.column_statistics(df).select("pos", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


@register("standardize", with_(X2) + f"SELECT row_id, {R.format('(x1 - avg(x1) OVER ()) / stddev_samp(x1) OVER ()')} AS z1, {R.format('(x2 - avg(x2) OVER ()) / stddev_samp(x2) OVER ()')} AS z2 FROM x")
def standardize(spark, d):
    return dataset.standardized(vecs(spark, d, 2)).select("row_id", r6(x(1)).alias("z1"), r6(x(2)).alias("z2"))


# scalar kernels


def neighbours(spark, d):
    a = vecs(spark, d)
    return a.join(a.select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("other")), "row_id")


_next = " FROM x JOIN x y ON y.row_id = x.row_id + 1"


@register("sqdist_rows", with_(X) + f"SELECT x.row_id, {R.format(d2('x.f', 'y.f'))} AS d2" + _next)
def sqdist_rows(spark, d):
    return neighbours(spark, d).select("row_id", r6(squared_distance(F.col("features"), F.col("other"))).alias("d2"))


@register("dot_rows", with_(X) + f"SELECT x.row_id, {R.format('list_sum(list_transform(list_zip(x.f, y.f), lambda p: p[1] * p[2]))')} AS dot" + _next)
def dot_rows(spark, d):
    return neighbours(spark, d).select("row_id", r6(dot(F.col("features"), F.col("other"))).alias("dot"))


@register("row_norms", with_(X) + f"SELECT row_id, {R.format('list_sum(list_transform(f, lambda v: v * v))')} AS norm2 FROM x")
def row_norms(spark, d):
    return vecs(spark, d).select("row_id", r6(squared_norm(F.col("features"))).alias("norm2"))


@register("centroid_pairs", with_(X, seeded()) + f"SELECT a.k AS k1, b.k AS k2, {R.format(d2('a.f', 'b.f'))} AS d2 FROM s a JOIN s b ON a.k < b.k")
def centroid_pairs(spark, d):
    c = seeds(vecs(spark, d))
    return rows(spark, kmeans.centroid_distances(c), "k1 int, k2 int, d2 double").select("k1", "k2", r6(F.col("d2")).alias("d2"))


@register("centroid_shift", with_(X, seeded(), assigned(), stepped("s", "a", "t")) + f"SELECT s.k, {R.format(d2('s.f', 't.f'))} AS shift2 FROM s JOIN t USING (k)")
def centroid_shift(spark, d):
    df = vecs(spark, d)
    c = seeds(df)
    moved = kmeans.shifts(c, kmeans.lloyd_step(df, c).centroids)
    return rows(spark, [(k, float(v)) for k, v in enumerate(moved)], "k int, v double").select("k", r6(F.col("v")).alias("shift2"))


@register("squared_centroid_norms", with_(X, seeded()) + f"SELECT k, {R.format('list_sum(list_transform(f, lambda v: v * v))')} AS norm2 FROM s")
def squared_centroid_norms(spark, d):
    return rows(spark, [(k, float((c**2).sum())) for k, c in enumerate(seeds(vecs(spark, d)))], "k int, v double").select("k", r6(F.col("v")).alias("norm2"))


# assignment and its aggregates


@register("classify", with_(X, seeded(), assigned()) + "SELECT row_id, cluster FROM a")
def classify(spark, d):
    df = vecs(spark, d)
    return kmeans.assign(df, seeds(df)).select("row_id", "cluster")


@register("classify_dist", with_(X, seeded(), assigned()) + f"SELECT row_id, cluster, {R.format('d2')} AS d2 FROM a")
def classify_dist(spark, d):
    df = vecs(spark, d)
    return kmeans.assign(df, seeds(df)).select("row_id", "cluster", r6(F.col("d2")).alias("d2"))


@register("mse", with_(X, seeded(), assigned()) + f"SELECT {R.format('avg(d2)')} AS mse FROM a")
def mse(spark, d):
    df = vecs(spark, d)
    return kmeans.mean_squared_error(df, seeds(df)).select(r6(F.col("mse")).alias("mse"))


@register("mse_assigned", with_(X, seeded(10)) + f"SELECT {R.format('avg(' + d2('x.f', 's.f') + ')')} AS mse FROM x JOIN embeddings ON vec_id = row_id JOIN s ON s.k = label")
def mse_assigned(spark, d):
    df = vecs(spark, d)
    given = df.join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label"), "row_id")
    return kmeans.error_of(given, seeds(df, 10), "label").select(r6(F.col("mse")).alias("mse"))


@register("cluster_sse", with_(X, seeded(), assigned()) + f"SELECT s.k AS cluster, {R.format('coalesce(sum(d2), 0)')} AS sse FROM s LEFT JOIN a ON a.cluster = s.k GROUP BY s.k")
def cluster_sse(spark, d):
    df = vecs(spark, d)
    return kmeans.cluster_totals(df, seeds(df)).select("cluster", r6(F.col("sse")).alias("sse"))


@register("cluster_counts", with_(X, seeded(), assigned()) + "SELECT s.k AS cluster, count(a.row_id) AS n FROM s LEFT JOIN a ON a.cluster = s.k GROUP BY s.k")
def cluster_counts(spark, d):
    df = vecs(spark, d)
    return kmeans.cluster_totals(df, seeds(df)).select("cluster", F.col("n").cast("long").alias("n"))


@register("centers_by_label", with_("v AS (SELECT label, cast(i - 1 AS integer) AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))") + f"SELECT label, pos, {R.format('avg(v)')} AS mean FROM v GROUP BY label, pos")
def centers_by_label(spark, d):
    df = read_table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("features"))
    return kmeans.group_means(df, "label").select("label", "pos", r6(F.col("mean")).alias("mean"))


@register("objects_in_cluster", with_(X, seeded(), assigned()) + "SELECT row_id FROM a WHERE cluster = 2")
def objects_in_cluster(spark, d):
    df = vecs(spark, d)
    return kmeans.rows_of_cluster(kmeans.assign(df, seeds(df)), 2)


@register("quantize", with_(X, seeded(), assigned()) + f"SELECT row_id, cluster, {R.format('s.f[1]')} AS q1, {R.format('s.f[64]')} AS q64 FROM a JOIN s ON s.k = a.cluster")
def quantize(spark, d):
    df = vecs(spark, d)
    return kmeans.quantized(df, seeds(df)).select("row_id", "cluster", r6(x(1)).alias("q1"), r6(x(64)).alias("q64"))


@register("sort_centroids", with_(X, seeded()) + f"SELECT cast(row_number() OVER (ORDER BY f DESC) - 1 AS integer) AS place, {R.format('f[1]')} AS c1, {R.format('f[2]')} AS c2 FROM s")
def sort_centroids(spark, d):
    c = kmeans.sorted_centroids(seeds(vecs(spark, d)))
    return rows(spark, [(i, float(v[0]), float(v[1])) for i, v in enumerate(c)], "place int, a double, b double").select("place", r6(F.col("a")).alias("c1"), r6(F.col("b")).alias("c2"))


# Lloyd steps


def centroid_rows(spark, c: np.ndarray) -> DataFrame:
    return rows(spark, [(k, j, float(v)) for k, r in enumerate(c) for j, v in enumerate(r)], "k int, pos int, v double").select("k", "pos", r6(F.col("v")).alias("value"))


def _centroids(name: str) -> str:
    return f"SELECT k, cast(i - 1 AS integer) AS pos, {R.format('f[i]')} AS value FROM {name}, range(1, 65) t(i)"


@register("lloyd_step", with_(X, seeded(), assigned(), stepped("s", "a", "t")) + _centroids("t"))
def lloyd_step(spark, d):
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.lloyd_step(df, seeds(df)).centroids)


_three = with_(X, seeded(), assigned("s", "a0"), stepped("s", "a0", "t1"), assigned("t1", "a1"), stepped("t1", "a1", "t2"), assigned("t2", "a2"), stepped("t2", "a2", "t3"))


@register("lloyd_n", _three + _centroids("t3"))
def lloyd_n(spark, d):
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.run(df, seeds(df), 3).centroids)


@register("lloyd_fit", _three + f"SELECT cast(step AS integer) AS step, {R.format('fit')} AS fit FROM (SELECT 1 AS step, avg(d2) AS fit FROM a0 UNION ALL SELECT 2, avg(d2) FROM a1 UNION ALL SELECT 3, avg(d2) FROM a2)")
def lloyd_fit(spark, d):
    df = vecs(spark, d)
    found = kmeans.run(df, seeds(df), 3).history
    return rows(spark, [(i + 1, float(v)) for i, v in enumerate(found)], "step int, v double").select("step", r6(F.col("v")).alias("fit"))


@register("lloyd_changed", _three + "SELECT cast(step AS integer) AS step, n > 0 AS changed FROM (SELECT 1 AS step, count(*) AS n FROM a0 WHERE cluster <> 0 UNION ALL SELECT 2, count(*) FROM a0 JOIN a1 USING (row_id) WHERE a0.cluster <> a1.cluster)")
def lloyd_changed(spark, d):
    df = vecs(spark, d)
    first = kmeans.lloyd_step(df, seeds(df))
    second = kmeans.lloyd_step(df, first.centroids, before=seeds(df))
    return rows(spark, [(1, first.changed > 0), (2, second.changed > 0)], "step int, changed boolean")


@register("det_repair", with_(X, "s AS MATERIALIZED (SELECT cast(k AS integer) AS k, f FROM (SELECT 0 AS k, f FROM x WHERE row_id = 7 UNION ALL SELECT 1, f FROM x WHERE row_id = 7))", assigned(), "t AS (SELECT 0 AS k, list(m ORDER BY i) AS f FROM (SELECT i, avg(f[i]) AS m FROM a, range(1, 65) t(i) GROUP BY i) UNION ALL SELECT 1, f FROM x WHERE row_id = (SELECT min(row_id) FROM x))") + f"SELECT cast(k AS integer) AS k, cast(i - 1 AS integer) AS pos, {R.format('f[i]')} AS value FROM t, range(1, 65) u(i)")
def det_repair(spark, d):
    df = vecs(spark, d)
    same = np.array(df.where("row_id = 7").first()["features"])
    return centroid_rows(spark, kmeans.lloyd_step(df, np.stack([same, same])).centroids)


_twin = "s AS MATERIALIZED (SELECT cast(i AS integer) AS k, f FROM x, range({n}) t(i) WHERE row_id = 7)"


def _repaired(n: int, places: str) -> str:
    """``n`` equal seeds: the first gets all rows, the others become the rows of ``places`` (k, f)."""
    return with_(X, f"t AS (SELECT 0 AS k, list(m ORDER BY i) AS f FROM (SELECT i, avg(f[i]) AS m FROM x, range(1, 65) u(i) GROUP BY i) UNION ALL {places})") + f"SELECT cast(k AS integer) AS k, cast(i - 1 AS integer) AS pos, {R.format('f[i]')} AS value FROM t, range(1, 65) u(i)"


def equal_seeds(df: DataFrame, n: int) -> np.ndarray:
    return np.stack([dataset.fetch_row(df, 7)] * n)


@register("det_repair_next", _repaired(3, "(SELECT row_number() OVER (ORDER BY row_id) - 3 AS k, f FROM x QUALIFY row_number() OVER (ORDER BY row_id) IN (4, 5))"))
def det_repair_next(spark, d):
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.lloyd_step(df, equal_seeds(df, 3), position=3).centroids)


@register("random_repair", _repaired(3, f"(SELECT row_number() OVER (ORDER BY {draw(chr(39) + '4:0:' + chr(39) + ' || row_id')}, row_id) AS k, f FROM x QUALIFY row_number() OVER (ORDER BY {draw(chr(39) + '4:0:' + chr(39) + ' || row_id')}, row_id) <= 2)"))
def random_repair(spark, d):
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.lloyd_step(df, equal_seeds(df, 3), repair="random", seed=4).centroids)


def _lloyd(n: int) -> list[str]:
    parts = [X, seeded(name="t0")]
    for i in range(n):
        parts += [assigned(f"t{i}", f"a{i}"), stepped(f"t{i}", f"a{i}", f"t{i + 1}")]
    return parts


@register("kmeans_without_mse", with_(*_lloyd(20)) + _centroids("t20"))
def kmeans_without_mse(spark, d):
    """Stable after fewer than 20 steps, which further steps leave alone."""
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.run_until_stable(df, seeds(df), 20).centroids)


@register("lloyd_report", with_(*_lloyd(3)) + f"SELECT cast(step AS integer) AS step, {R.format('fit')} AS fit, changed FROM (SELECT 1 AS step, avg(d2) AS fit, count(*) FILTER (WHERE cluster <> 0) AS changed FROM a0 UNION ALL SELECT 2, avg(a1.d2), count(*) FILTER (WHERE a0.cluster <> a1.cluster) FROM a0 JOIN a1 USING (row_id) UNION ALL SELECT 3, avg(a2.d2), count(*) FILTER (WHERE a1.cluster <> a2.cluster) FROM a1 JOIN a2 USING (row_id))")
def lloyd_report(spark, d):
    df = vecs(spark, d)
    found = kmeans.run_until_stable(df, seeds(df), 3).report()
    return rows(spark, found, "step int, fit double, changed long").select("step", r6(F.col("fit")).alias("fit"), "changed")


@register("kmeans_from_file", with_(*_lloyd(2)) + _centroids("t2"))
def kmeans_from_file(spark, d):
    df = vecs(spark, d)
    path = _file(spark, "centroids")
    models.write_centroids(path, seeds(df))
    return centroid_rows(spark, kmeans.run(df, models.read_centroids(path, K, 64), 2).centroids)


def _relaxed(steps: int) -> str:
    parts = [X, "sd AS MATERIALIZED (SELECT list(s ORDER BY i) AS sd FROM (SELECT i, stddev_samp(f[i]) AS s FROM x, range(1, 65) t(i) GROUP BY i))", seeded(name="t0")]
    for i in range(steps):
        noise = draw(f"'1:{i}:' || k || ':' || (i - 1)")
        parts += [assigned(f"t{i}", f"a{i}"), stepped(f"t{i}", f"a{i}", f"m{i}")]
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT k, list_transform(range(1, 65), lambda i: f[i] + ({noise} - 0.5) * sd[i] * sqrt(pow(1 - {i + 1}::DOUBLE / {steps}, 4))) AS f FROM m{i}, sd)")
    return with_(*parts) + _centroids(f"t{steps}")


@register("kmeans_relaxed", _relaxed(4))
def kmeans_relaxed(spark, d):
    df = vecs(spark, d)
    return centroid_rows(spark, kmeans.run_relaxed(df, seeds(df), 4).centroids)


_numbers = "k AS (SELECT cast(i AS integer) AS i, 'n' || i AS t FROM range(20) r(i))"


@register("random_numbers", with_(_numbers) + f"SELECT i, {R.format(draw('t'))} AS uniform, {R.format('2 + 3 * sqrt(-2 * ln(1 - ' + draw(chr(116) + ' || chr(58) || chr(48)') + ')) * cos(2 * pi() * ' + draw(chr(116) + ' || chr(58) || chr(49)') + ')')} AS normal, {R.format('1 + 2 * tan(pi() * (' + draw('t') + ' - 0.5))')} AS cauchy FROM k")
def random_numbers(spark, d):
    made = [(i, kmeans.drawn(f"n{i}"), kmeans.normal(f"n{i}", 2.0, 3.0), kmeans.cauchy(f"n{i}", 1.0, 2.0)) for i in range(20)]
    return rows(spark, made, "i int, a double, b double, c double").select("i", r6(F.col("a")).alias("uniform"), r6(F.col("b")).alias("normal"), r6(F.col("c")).alias("cauchy"))


# row access and tables of the driver


@register("fetch_row", "SELECT cast(i - 1 AS integer) AS pos, " + R.format("embedding[i]::DOUBLE") + " AS value FROM embeddings, range(1, 65) t(i) WHERE vec_id = 17")
def fetch_row(spark, d):
    v = dataset.fetch_row(vecs(spark, d), 17)
    return rows(spark, [(i, float(a)) for i, a in enumerate(v)], "pos int, v double").select("pos", r6(F.col("v")).alias("value"))


@register("in_memory", with_(X, seeded(8)) + f"SELECT cast(k AS bigint) AS row_id, {R.format('f[1]')} AS x1, {R.format('f[64]')} AS x64 FROM s")
def in_memory(spark, d):
    df = dataset.from_array(spark, seeds(vecs(spark, d), 8))
    return df.select("row_id", r6(x(1)).alias("x1"), r6(x(64)).alias("x64"))


@register("centroid_dataset", with_(X, seeded()) + f"SELECT cast(k AS bigint) AS row_id, {R.format('list_sum(list_transform(f, lambda v: v * v))')} AS norm2 FROM s")
def centroid_dataset(spark, d):
    table = centroid_table(spark, seeds(vecs(spark, d)))
    df = dataset.from_array(spark, centroids_of(table))
    return df.select("row_id", r6(squared_norm(F.col("features"))).alias("norm2"))


@register("partition_counts", "SELECT 0 AS part, count(*) AS n FROM embeddings")
def partition_counts(spark, d):
    return dataset.partition_counts(vecs(spark, d).coalesce(1))


# seeding

_closest = with_(X, seeded(2), seeded(3, 2, "n"), assigned("s", "a"), assigned("n", "b"), "c AS MATERIALIZED (SELECT row_id, least(a.d2, b.d2) AS d2, cast(CASE WHEN b.d2 < a.d2 THEN b.cluster + 2 ELSE a.cluster END AS integer) AS k FROM a JOIN b USING (row_id))")


def carried(spark, d):
    df = vecs(spark, d)
    c = seeds(df)
    first = kmeans.assign(df, c[:2]).withColumnsRenamed({"d2": "closest_d2", "cluster": "closest_k"})
    return kmeans.closest_update(first, c[2:], 2)


@register("closest_update", _closest + f"SELECT row_id, {R.format('d2')} AS closest_d2, k AS closest_k FROM c")
def closest_update(spark, d):
    return carried(spark, d).select("row_id", r6(F.col("closest_d2")).alias("closest_d2"), "closest_k")


@register("kmeanspar_cost", _closest + f"SELECT {R.format('sum(d2)')} AS cost FROM c")
def kmeanspar_cost(spark, d):
    return carried(spark, d).agg(F.sum("closest_d2").alias("v")).select(r6(F.col("v")).alias("cost"))


@register("kmeanspar_weights", _closest + "SELECT closest_k, count(*) AS weight FROM (SELECT k AS closest_k FROM c) GROUP BY closest_k")
def kmeanspar_weights(spark, d):
    return carried(spark, d).groupBy("closest_k").agg(F.count(F.lit(1)).alias("weight"))


_mass = with_(X, seeded(40), "m AS MATERIALIZED (SELECT k AS id, " + d2("s.f", "(SELECT f FROM s WHERE k = 0)") + " * (k + 1) AS mass FROM s)", "t AS (SELECT id, mass, sum(mass) OVER (ORDER BY id) / sum(mass) OVER () AS cdf FROM m)")


def mass_table(spark, d):
    c = seeds(vecs(spark, d), 40)
    mass = ((c - c[0]) ** 2).sum(axis=1) * np.arange(1, 41)
    return kmeans.weight_table(rows(spark, [(i, float(m)) for i, m in enumerate(mass)], "id int, mass double"))


@register("pp_cdf", _mass + f"SELECT id, {R.format('cdf')} AS cdf FROM t")
def pp_cdf(spark, d):
    return mass_table(spark, d).select("id", r6(F.col("cdf")).alias("cdf"))


@register("pp_pick", _mass + "SELECT min(id) AS id FROM t WHERE cdf >= 0.37")
def pp_pick(spark, d):
    return kmeans.pick(mass_table(spark, d), 0.37).select("id")


@register("forgy", with_(X, seeded()) + _centroids("s"))
def forgy(spark, d):
    return centroid_rows(spark, seeds(vecs(spark, d)))


@register("random_partition_init", with_(X, "p AS (SELECT f, cast(least(floor(('0x' || substr(md5('1:' || row_id), 1, 8))::bigint / 4294967296.0 * 4), 3) AS integer) AS k FROM x)") + f"SELECT k, cast(i - 1 AS integer) AS pos, {R.format('avg(f[i])')} AS value FROM p, range(1, 65) t(i) GROUP BY k, i")
def random_partition_init(spark, d):
    return centroid_rows(spark, kmeans.random_partition(vecs(spark, d), 4))


_trial = "c AS MATERIALIZED (SELECT cast((k - k % 16) / 16 AS integer) AS round, k % 16 AS n, f FROM s)"


def _min_dist(seed: int | None = None) -> str:
    first = with_(X, seeded(48, seed=seed), _trial, "g AS (SELECT list(m ORDER BY i) AS f FROM (SELECT i, avg(f[i]) AS m FROM x, range(1, 65) t(i) GROUP BY i))")[:-1]
    return f"""{first},
c0 AS MATERIALIZED (SELECT c.f FROM c, g WHERE round = 0 ORDER BY {d2('c.f', 'g.f')}, n LIMIT 1),
c1 AS MATERIALIZED (SELECT c.f FROM c, c0 WHERE round = 1 ORDER BY {d2('c.f', 'c0.f')} DESC, n LIMIT 1),
c2 AS MATERIALIZED (SELECT c.f FROM c, c0, c1 WHERE round = 2 ORDER BY least({d2('c.f', 'c0.f')}, {d2('c.f', 'c1.f')}) DESC, n LIMIT 1),
z AS (SELECT 0 AS k, f FROM c0 UNION ALL SELECT 1, f FROM c1 UNION ALL SELECT 2, f FROM c2)
SELECT cast(k AS integer) AS k, cast(i - 1 AS integer) AS pos, {R.format('f[i]')} AS value FROM z, range(1, 65) t(i)"""


@register("mindist_init", _min_dist())
def mindist_init(spark, d):
    return centroid_rows(spark, kmeans.min_dist(vecs(spark, d), 3))


@register("mindist_seed", _min_dist(9))
def mindist_seed(spark, d):
    return centroid_rows(spark, kmeans.min_dist(vecs(spark, d), 3, seed=9))


def _plus_plus(candidates: str, k: int, seed: int) -> tuple[list[str], str]:
    """CTEs of the weighted choice of ``k`` of the candidates (id, f, w), and the query of the chosen centres."""
    first = f"p0 AS MATERIALIZED (SELECT f FROM {candidates} WHERE id = floor({draw(f"'{seed}:0'")} * (SELECT count(*) FROM {candidates})))"
    parts = [first, f"d0 AS MATERIALIZED (SELECT id, c.f, w, {d2('c.f', 'p0.f')} AS d FROM {candidates} c, p0)"]
    for i in range(1, k):
        parts.append(f"p{i} AS MATERIALIZED (SELECT f FROM (SELECT id, f, sum(d * w) OVER (ORDER BY id) / sum(d * w) OVER () AS cdf FROM d{i - 1}) WHERE cdf >= {draw(f"'{seed}:{i}'")} ORDER BY id LIMIT 1)")
        parts.append(f"d{i} AS MATERIALIZED (SELECT id, c.f, w, least(d, {d2('c.f', f'p{i}.f')}) AS d FROM d{i - 1} c, p{i})")
    parts.append("z AS (" + " UNION ALL ".join(f"SELECT cast({i} AS integer) AS k, f FROM p{i}" for i in range(k)) + ")")
    return parts, _centroids("z")


_pp, _pp_out = _plus_plus("c", 4, 3)


@register("plus_plus_init", with_(X, seeded(40), "c AS MATERIALIZED (SELECT cast(k AS integer) AS id, f, k + 1 AS w FROM s)", *_pp) + _pp_out)
def plus_plus_init(spark, d):
    return centroid_rows(spark, kmeans.plus_plus(seeds(vecs(spark, d), 40), 4, np.arange(1, 41), seed=3))


def _parallel(k: int, seed: int, rounds: int = 5) -> str:
    key = f"'{seed}:' || row_id"
    parts = [X, f"f0 AS MATERIALIZED (SELECT 0 AS id, f FROM x ORDER BY {draw(key)}, row_id LIMIT 1)", f"n0 AS MATERIALIZED (SELECT row_id, x.f, {d2('x.f', 'f0.f')} AS d, 0 AS c FROM x, f0)"]
    for r in range(rounds):
        key = f"'{seed * 1000 + r + 1}:' || row_id"
        parts.append(f"v{r} AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY row_id) - 1 + (SELECT count(*) FROM f{r}) AS integer) AS id, f FROM n{r} WHERE {draw(key)} < least(1, d * (1.4::DOUBLE * {k} / (SELECT sum(d) FROM n{r}))))")
        parts.append(f"f{r + 1} AS MATERIALIZED (SELECT * FROM f{r} UNION ALL SELECT * FROM v{r})")
        parts.append(f"b{r} AS MATERIALIZED (SELECT row_id, id, d FROM (SELECT n.row_id, v.id, {d2('n.f', 'v.f')} AS d FROM n{r} n, v{r} v) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, id) = 1)")
        parts.append(f"n{r + 1} AS MATERIALIZED (SELECT n.row_id, n.f, least(n.d, coalesce(b.d, n.d)) AS d, CASE WHEN b.d < n.d THEN b.id ELSE n.c END AS c FROM n{r} n LEFT JOIN b{r} b USING (row_id))")
    parts.append(f"cand AS MATERIALIZED (SELECT id, f, (SELECT count(*) FROM n{rounds} WHERE c = id) AS w FROM f{rounds})")
    chosen, out = _plus_plus("cand", k, seed)
    return with_(*parts, *chosen) + out


@register("kmeans_parallel_init", _parallel(K, 1))
def kmeans_parallel_init(spark, d):
    return centroid_rows(spark, kmeans.parallel_seeds(vecs(spark, d), K))


@register("kmeans_parallel_seed", _parallel(3, 7))
def kmeans_parallel_seed(spark, d):
    return centroid_rows(spark, kmeans.parallel_seeds(vecs(spark, d), 3, seed=7))


@register("forgy_seed", with_(X, seeded(seed=5)) + _centroids("s"))
def forgy_seed(spark, d):
    return centroid_rows(spark, kmeans.forgy(vecs(spark, d), K, seed=5))


def mixture_rows(spark, m: Mixture) -> DataFrame:
    """k, weight, mean and the lower triangle of the covariance of two-dimensional components."""
    found = [(k, float(m.weights[k]), *map(float, m.means[k]), float(m.covs[k][0, 0]), float(m.covs[k][1, 0]), float(m.covs[k][1, 1])) for k in range(m.k)]
    names = ("weight", "m1", "m2", "c11", "c12", "c22")
    return rows(spark, found, "k int, " + ", ".join(f"{n} double" for n in names)).select("k", *[r6(F.col(n)).alias(n) for n in names])


def _mixture(name: str) -> str:
    return f"SELECT k, {', '.join(R.format(c) + ' AS ' + c for c in ('weight', 'm1', 'm2', 'c11', 'c12', 'c22'))} FROM {name}"


# two-dimensional mixtures in SQL

def _start(seed: int | None = None) -> str:
    return f"{seeded(3, seed=seed)}, tr AS MATERIALIZED (SELECT (var_samp(x1) + var_samp(x2)) / 20 AS v FROM x), g0 AS MATERIALIZED (SELECT k, 1.0::DOUBLE / 3 AS weight, f[1] AS m1, f[2] AS m2, v AS c11, 0.0::DOUBLE AS c12, v AS c22 FROM s, tr)"


START = _start()


def estep(model: str, name: str) -> str:
    det = "(c11 * c22 - c12 * c12)"
    maha = f"(c22 * (x1 - m1) * (x1 - m1) - 2 * c12 * (x1 - m1) * (x2 - m2) + c11 * (x2 - m2) * (x2 - m2)) / {det}"
    return f"""{name}_l AS MATERIALIZED (SELECT row_id, x1, x2, k, {maha} AS maha, ln(weight) - ln(2 * pi()) - 0.5 * ln({det}) - 0.5 * {maha} AS l FROM x, {model}),
{name} AS MATERIALIZED (SELECT *, mx + ln(sum(exp(l - mx)) OVER (PARTITION BY row_id)) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY row_id) AS mx FROM {name}_l))"""


def mstep(e: str, name: str, g: float = 0.001) -> str:
    return f"""{name}_m AS MATERIALIZED (SELECT k, sum(exp(l - lse)) AS n, sum(exp(l - lse) * x1) / sum(exp(l - lse)) AS m1, sum(exp(l - lse) * x2) / sum(exp(l - lse)) AS m2 FROM {e} GROUP BY k),
{name}_c AS MATERIALIZED (SELECT m.k, any_value(m.n) AS n, any_value(m.m1) AS m1, any_value(m.m2) AS m2, sum(exp(l - lse) * (x1 - m.m1) * (x1 - m.m1)) / any_value(m.n) AS a, sum(exp(l - lse) * (x1 - m.m1) * (x2 - m.m2)) / any_value(m.n) AS b, sum(exp(l - lse) * (x2 - m.m2) * (x2 - m.m2)) / any_value(m.n) AS c FROM {e} JOIN {name}_m m USING (k) GROUP BY m.k),
{name} AS MATERIALIZED (SELECT k, n / (SELECT count(*) FROM x) AS weight, m1, m2, (1 - {g}::DOUBLE) * a + {g}::DOUBLE * (a + c) / 2 AS c11, (1 - {g}::DOUBLE) * b AS c12, (1 - {g}::DOUBLE) * c + {g}::DOUBLE * (a + c) / 2 AS c22 FROM {name}_c)"""


def sweeps(n: int) -> str:
    parts = []
    for i in range(n):
        parts += [estep(f"g{i}", f"e{i}"), mstep(f"e{i}", f"g{i + 1}")]
    return with_(X2, START, *parts)


def fitted(df: DataFrame, n: int) -> em.EMResult:
    return em.fit(df, em.jain(df, 3), em.EMParams(max_sweeps=n, eps=1e-300, regularization=0.001))


def one(spark, d) -> tuple[DataFrame, Mixture]:
    df = vecs(spark, d, 2)
    return df, fitted(df, 1).model


_one = sweeps(1)[:-1]


@register("jain_init", with_(X2, START) + _mixture("g0"))
def jain_init(spark, d):
    return mixture_rows(spark, em.jain(vecs(spark, d, 2), 3))


@register("jain_seed", with_(X2, _start(6)) + _mixture("g0"))
def jain_seed(spark, d):
    return mixture_rows(spark, em.jain(vecs(spark, d, 2), 3, seed=6))


@register("em_sweep", sweeps(1) + _mixture("g1"))
def em_sweep(spark, d):
    return mixture_rows(spark, one(spark, d)[1])


@register("em_fit_2d", sweeps(5) + _mixture("g5"))
def em_fit_2d(spark, d):
    return mixture_rows(spark, fitted(vecs(spark, d, 2), 5).model)


@register("em_log_likelihood", sweeps(3) + "SELECT cast(sweep AS integer) AS sweep, round(ll, 5) + 0.0 AS log_likelihood FROM (" + " UNION ALL ".join(f"SELECT {i + 1} AS sweep, sum(lse) AS ll FROM e{i} WHERE k = 0" for i in range(3)) + ")")
def em_log_likelihood(spark, d):
    found = fitted(vecs(spark, d, 2), 3).history
    return rows(spark, [(i + 1, float(h["log_likelihood"])) for i, h in enumerate(found)], "sweep int, v double").select("sweep", (F.round("v", 5) + F.lit(0.0)).alias("log_likelihood"))


@register("estep_2d", _one + ",\n" + estep("g1", "e") + f"\nSELECT row_id, k, {R.format('exp(l - lse)')} AS gamma FROM e")
def estep_2d(spark, d):
    return em.posterior_table(*one(spark, d)).select("row_id", F.posexplode("gamma").alias("k", "g")).select("row_id", "k", r6(F.col("g")).alias("gamma"))


@register("posteriors", _one + ",\n" + estep("g1", "e") + f"\nSELECT row_id, {', '.join(R.format(f'max(exp(l - lse)) FILTER (WHERE k = {k})') + f' AS g{k}' for k in range(3))} FROM e GROUP BY row_id")
def posteriors(spark, d):
    return em.posterior_table(*one(spark, d)).select("row_id", *[r6(F.col("gamma")[k]).alias(f"g{k}") for k in range(3)])


@register("mixture_density", _one + ",\n" + estep("g1", "e") + f"\nSELECT row_id, {R.format('lse')} AS log_density, {R.format('exp(lse)')} AS density FROM e WHERE k = 0")
def mixture_density(spark, d):
    return em.posterior_table(*one(spark, d)).select("row_id", r6(F.col("log_density")).alias("log_density"), r6(F.exp("log_density")).alias("density"))


@register("gmm_classify", _one + ",\n" + estep("g1", "e") + "\nSELECT row_id, k AS cluster FROM e QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY l DESC, k) = 1")
def gmm_classify(spark, d):
    return em.posterior_table(*one(spark, d)).select("row_id", "cluster")


@register("mahalanobis_2d", _one + ",\n" + estep("g1", "e") + f"\nSELECT row_id, k, {R.format('maha')} AS maha2 FROM e")
def mahalanobis_2d(spark, d):
    return em.mahalanobis(*one(spark, d)).select("row_id", "k", r6(F.col("maha2")).alias("maha2"))


@register("component_ll", _one + ",\n" + estep("g1", "e") + "\nSELECT k, round(sum(exp(l - lse) * l), 5) + 0.0 AS ll FROM e GROUP BY k")
def component_ll(spark, d):
    return em.component_log_likelihood(*one(spark, d)).select("k", (F.round("ll", 5) + F.lit(0.0)).alias("ll"))


@register("posterior_gram", _one + ",\n" + estep("g1", "e") + f"\nSELECT a.k AS k1, b.k AS k2, {R.format('sum(exp(a.l - a.lse) * exp(b.l - b.lse))')} AS g FROM e a JOIN e b USING (row_id) GROUP BY a.k, b.k")
def posterior_gram(spark, d):
    return em.posterior_gram(em.posterior_table(*one(spark, d)), 3).select("k1", "k2", r6(F.col("g")).alias("g"))


@register("mstep_means", with_(X2, START, estep("g0", "e"), mstep("e", "g")) + f"SELECT k, {R.format('n')} AS n, {R.format('m1')} AS m1, {R.format('m2')} AS m2 FROM g_m")
def mstep_means(spark, d):
    df = vecs(spark, d, 2)
    model = em.jain(df, 3)
    m = em.moments(df, model)
    means = em.maximize(model, m).means
    return rows(spark, [(k, float(m.n[k]), *map(float, means[k])) for k in range(3)], "k int, a double, b double, c double").select("k", r6(F.col("a")).alias("n"), r6(F.col("b")).alias("m1"), r6(F.col("c")).alias("m2"))


@register("mstep_covs", with_(X2, START, estep("g0", "e"), mstep("e", "g", 0.0)) + _mixture("g"))
def mstep_covs(spark, d):
    df = vecs(spark, d, 2)
    model = em.jain(df, 3)
    return mixture_rows(spark, em.maximize(model, em.moments(df, model)))


@register("estep_spherical", with_(X, seeded(3), "v AS (SELECT sum(s) / 64 / 10 AS v FROM (SELECT var_samp(f[i]) AS s FROM x, range(1, 65) t(i) GROUP BY i))", f"l AS MATERIALIZED (SELECT row_id, k, ln(1.0::DOUBLE / 3) - 32 * ln(2 * pi() * v) - {d2('x.f', 's.f')} / (2 * v) AS l FROM x, s, v)", "e AS (SELECT *, mx + ln(sum(exp(l - mx)) OVER (PARTITION BY row_id)) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY row_id) AS mx FROM l))") + f"SELECT row_id, k, {R.format('exp(l - lse)')} AS gamma FROM e")
def estep_spherical(spark, d):
    df = vecs(spark, d)
    found = em.posterior_table(df, em.jain(df, 3)).select("row_id", F.posexplode("gamma").alias("k", "g"))
    return found.select("row_id", "k", r6(F.col("g")).alias("gamma"))


# model tables


@register("regularize", _one + f"\nSELECT k, {R.format('0.75 * c11 + 0.25 * (c11 + c22) / 2')} AS c11, {R.format('0.75 * c12')} AS c12, {R.format('0.75 * c22 + 0.25 * (c11 + c22) / 2')} AS c22 FROM g1")
def regularize(spark, d):
    return mixture_rows(spark, one(spark, d)[1].regularized(0.25)).select("k", "c11", "c12", "c22")


_root = "sqrt((c11 - c22) * (c11 - c22) + 4 * c12 * c12)"


@register("cond_2d", _one + f"\nSELECT k, {R.format(f'abs((c11 + c22 + {_root}) / (c11 + c22 - {_root}))')} AS cond FROM g1")
def cond_2d(spark, d):
    return rows(spark, [(k, float(v)) for k, v in enumerate(one(spark, d)[1].condition_numbers())], "k int, v double").select("k", r6(F.col("v")).alias("cond"))


@register("model_table", _one + f"\nSELECT k, {R.format('weight')} AS weight, {R.format('c11 + c22')} AS trace, {R.format(f'abs((c11 + c22 + {_root}) / (c11 + c22 - {_root}))')} AS condition FROM g1")
def model_table(spark, d):
    return mixture_table(spark, one(spark, d)[1]).select("k", *[r6(F.col(c)).alias(c) for c in ("weight", "trace", "condition")])


@register("max_cond_2d", _one + f"\nSELECT {R.format(f'max(abs((c11 + c22 + {_root}) / (c11 + c22 - {_root})))')} AS cond FROM g1")
def max_cond_2d(spark, d):
    return cond_2d(spark, d).agg(F.max("cond").alias("cond"))


@register("min_trace", _one + f"\nSELECT {R.format('min(c11 + c22)')} AS trace FROM g1")
def min_trace(spark, d):
    return rows(spark, [(float(one(spark, d)[1].traces().min()),)], "v double").select(r6(F.col("v")).alias("trace"))


@register("bhatt_2d", _one + ",\np AS (SELECT a.k AS k1, b.k AS k2, a.m1 - b.m1 AS d1, a.m2 - b.m2 AS d2, (a.c11 + b.c11) / 2 AS s11, (a.c12 + b.c12) / 2 AS s12, (a.c22 + b.c22) / 2 AS s22, a.c11 * a.c22 - a.c12 * a.c12 AS da, b.c11 * b.c22 - b.c12 * b.c12 AS db FROM g1 a JOIN g1 b ON a.k < b.k)" + f"\nSELECT k1, k2, {R.format('greatest(0, (s22 * d1 * d1 - 2 * s12 * d1 * d2 + s11 * d2 * d2) / (s11 * s22 - s12 * s12) / 8 + 0.5 * (ln(s11 * s22 - s12 * s12) - 0.5 * (ln(da) + ln(db))))')} AS distance FROM p")
def bhatt_2d(spark, d):
    m = one(spark, d)[1]
    found = [(i, j, bhattacharyya(m.means[i], m.covs[i], m.means[j], m.covs[j])) for i in range(3) for j in range(i + 1, 3)]
    return rows(spark, found, "k1 int, k2 int, v double").select("k1", "k2", r6(F.col("v")).alias("distance"))


@register("normalize_weights", with_(X2, START) + f"SELECT k, {R.format('w / sum(w) OVER ()')} AS weight FROM (SELECT k, weight * (k + 1) AS w FROM g0)")
def normalize_weights(spark, d):
    m = em.jain(vecs(spark, d, 2), 3)
    m = Mixture(m.weights * np.arange(1, 4), m.means, m.covs).normalized()
    return rows(spark, [(k, float(w)) for k, w in enumerate(m.weights)], "k int, v double").select("k", r6(F.col("v")).alias("weight"))


@register("split_component", _one + ",\nz AS (SELECT k, CASE WHEN k = 1 THEN weight / 2 ELSE weight END AS weight, CASE WHEN k = 1 THEN m1 + 0.1 ELSE m1 END AS m1, m2, c11, c12, c22 FROM g1 UNION ALL SELECT 3, weight / 2, m1 - 0.1, m2, c11, c12, c22 FROM g1 WHERE k = 1)\n" + _mixture("z"))
def split_component(spark, d):
    m = one(spark, d)[1]
    half, shift = m.weights[1] / 2, np.array([0.1, 0.0])
    return mixture_rows(spark, m.split(1, (half, m.means[1] + shift, m.covs[1]), (half, m.means[1] - shift, m.covs[1])))


@register("merge_components", _one + ",\nz AS (SELECT cast(CASE WHEN k = 2 THEN 1 ELSE 0 END AS integer) AS k, CASE WHEN k = 2 THEN weight ELSE (SELECT sum(weight) FROM g1 WHERE k < 2) END AS weight, m1, m2, c11, c12, c22 FROM g1 WHERE k <> 1)\n" + _mixture("z"))
def merge_components(spark, d):
    m = one(spark, d)[1]
    return mixture_rows(spark, m.merged(0, 1, (m.weights[0] + m.weights[1], m.means[0], m.covs[0])))


@register("kmeans_mixture", with_(X2, seeded(3), assigned("s", "a0"), *[p for i in range(2) for p in (stepped(f"{'s' if i == 0 else f't{i}'}", f"a{i}", f"t{i + 1}"), assigned(f"t{i + 1}", f"a{i + 1}"))], "z AS (SELECT k, count(*) / (SELECT count(*) FROM x) AS weight, any_value(t2.f[1]) AS m1, any_value(t2.f[2]) AS m2, sum((a2.f[1] - t2.f[1]) * (a2.f[1] - t2.f[1])) / (count(*) - 1) AS c11, sum((a2.f[1] - t2.f[1]) * (a2.f[2] - t2.f[2])) / (count(*) - 1) AS c12, sum((a2.f[2] - t2.f[2]) * (a2.f[2] - t2.f[2])) / (count(*) - 1) AS c22 FROM a2 JOIN t2 ON t2.k = a2.cluster GROUP BY k)") + _mixture("z"))
def kmeans_mixture(spark, d):
    df = vecs(spark, d, 2)
    return mixture_rows(spark, em.hard_moments(df, kmeans.run(df, seeds(df, 3), 2).centroids))


@register("em_1d_single", f"SELECT 0 AS k, 1.0::DOUBLE AS weight, {R.format('avg(value)')} AS mean, {R.format('var_pop(value)')} AS variance FROM events")
def em_1d_single(spark, d):
    df = dataset.from_columns(read_table(spark, d, "events"), "event_id", ["value"])
    m = em.fit(df, em.jain(df, 1), em.EMParams(max_sweeps=1)).model
    return rows(spark, [(0, float(m.weights[0]), float(m.means[0, 0]), float(m.covs[0, 0, 0]))], "k int, weight double, a double, b double").select("k", "weight", r6(F.col("a")).alias("mean"), r6(F.col("b")).alias("variance"))


@register("em_fit_64d")
def em_fit_64d(spark, d):
    df = vecs(spark, d)
    m = em.fit(df, em.jain(df, 3), em.EMParams(max_sweeps=5, eps=1e-11, regularization=0.001)).model
    found = [(k, float(m.weights[k]), m.means[k].tolist(), float(m.traces()[k])) for k in range(3)]
    return rows(spark, found, "k int, weight double, mean array<double>, trace double")


@register("em_kmeansoror_64d")
def em_kmeansoror_64d(spark, d):
    df = vecs(spark, d)
    m = em.fit(df, em.kmeans_start(df, 3, "parallel", 0.01), em.EMParams(max_sweeps=3, regularization=0.01)).model
    return rows(spark, [(k, float(m.weights[k]), float(m.traces()[k])) for k in range(3)], "k int, weight double, trace double")


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def measures(spark, d, key: str, id_col) -> DataFrame:
    df = dataset.from_columns(read_table(spark, d, "lineitem").withColumn("id", id_col), key, MEASURES)
    return spread(df)


@register("em_lineitem")
def em_lineitem(spark, d):
    """Three components over four standardized columns of all line items; the long table of the bench."""
    df = measures(spark, d, "id", F.xxhash64("*"))
    z = spread(dataset.standardized(df))
    m = em.fit(z, em.jain(z, 3), em.EMParams(max_sweeps=5, eps=1e-300, regularization=0.001)).model
    z.unpersist(), df.unpersist()
    return rows(spark, [(k, float(m.weights[k]), m.means[k].tolist()) for k in range(3)], "k int, weight double, mean array<double>")


def _four(n: int, g: float = 0.001) -> str:
    """``n`` sweeps over the four measures in SQL, from equal weights, the means of the return flags and a tenth of the variance."""
    z = ", ".join(f"({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / stddev_samp({c}::DOUBLE) OVER () AS x{i + 1}" for i, c in enumerate(MEASURES))
    four, low = range(1, 5), [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
    parts = [f"x AS MATERIALIZED (SELECT row_number() OVER () AS row_id, l_returnflag AS flag, {z} FROM lineitem)"]
    parts.append("tr AS MATERIALIZED (SELECT (" + " + ".join(f"var_samp(x{i})" for i in four) + ") / 40 AS v FROM x)")
    parts.append("g0 AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY flag) - 1 AS integer) AS k, 1.0::DOUBLE / 3 AS weight, " + ", ".join(f"avg(x{i}) AS m{i}" for i in four) + ", " + ", ".join(("any_value(v)" if i == j else "0.0::DOUBLE") + f" AS c{i}{j}" for i, j in low) + " FROM x, tr GROUP BY flag)")
    for s in range(n):
        steps = []
        for i, j in [(i, j) for j in four for i in range(j, 5)]:
            rest = "".join(f" - l{i}{m} * l{j}{m}" for m in range(1, j))
            steps.append(f"sqrt(c{i}{i}{rest}) AS l{i}{i}" if i == j else f"(c{i}{j}{rest}) / l{j}{j} AS l{i}{j}")
        parts.append(f"h{s} AS MATERIALIZED (SELECT *, {', '.join(steps)} FROM g{s})")
        zs = [f"(x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(1, i)) + f") / l{i}{i} AS z{i}" for i in four]
        parts.append(f"e{s} AS MATERIALIZED (SELECT *, exp(l - mx) / sum(exp(l - mx)) OVER (PARTITION BY row_id) AS w FROM (SELECT *, max(l) OVER (PARTITION BY row_id) AS mx FROM (SELECT row_id, k, x1, x2, x3, x4, {', '.join(zs)}, ln(weight) - 2 * ln(2 * pi()) - ln(l11 * l22 * l33 * l44) - 0.5 * (z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4) AS l FROM x, h{s})))")
        parts.append(f"m{s} AS MATERIALIZED (SELECT k, sum(w) AS n, " + ", ".join(f"sum(w * x{i}) / sum(w) AS m{i}" for i in four) + f" FROM e{s} GROUP BY k)")
        parts.append(f"v{s} AS MATERIALIZED (SELECT k, any_value(n) AS n, " + ", ".join(f"any_value(m{i}) AS m{i}" for i in four) + ", " + ", ".join(f"sum(w * (x{i} - m{i}) * (x{j} - m{j})) / any_value(n) AS s{i}{j}" for i, j in low) + f" FROM e{s} JOIN m{s} USING (k) GROUP BY k)")
        trace = " + ".join(f"s{i}{i}" for i in four)
        parts.append(f"g{s + 1} AS MATERIALIZED (SELECT k, n / (SELECT count(*) FROM x) AS weight, m1, m2, m3, m4, " + ", ".join(f"(1 - {g}::DOUBLE) * s{i}{j}" + (f" + {g}::DOUBLE * ({trace}) / 4" if i == j else "") + f" AS c{i}{j}" for i, j in low) + f" FROM v{s})")
    return with_(*parts) + f"SELECT k, {', '.join(R.format(c) + ' AS ' + c for c in ('weight', 'm1', 'm2', 'm3', 'm4', 'c11', 'c21', 'c33', 'c44'))} FROM g{n}"


@register("em_lineitem_flags", _four(3))
def em_lineitem_flags(spark, d):
    """Three sweeps over all line items, started from the return flags."""
    flags = read_table(spark, d, "lineitem").select("l_returnflag").distinct().orderBy("l_returnflag").collect()
    where = F.lit(0)
    for i, r in enumerate(flags):
        where = F.when(F.col("l_returnflag") == r[0], i).otherwise(where)
    df = measures(spark, d, "id", where.cast("long"))  # the id is the flag's number
    z = spread(dataset.standardized(df))
    means = np.full((len(flags), 4), np.nan)
    for r in kmeans.group_means(z, "row_id").collect():
        means[r["row_id"], r["pos"]] = r["mean"]
    trace = dataset.covariance_trace(z).first()[0]
    start = Mixture(np.full(3, 1 / 3), means, np.repeat((trace / 40 * np.eye(4))[None], 3, axis=0))
    m = em.fit(z, start, em.EMParams(max_sweeps=3, eps=1e-300, regularization=0.001)).model
    z.unpersist(), df.unpersist()
    found = [(k, float(m.weights[k]), *map(float, m.means[k]), *(float(m.covs[k][i, j]) for i, j in ((0, 0), (1, 0), (2, 2), (3, 3)))) for k in range(3)]
    names = ("weight", "m1", "m2", "m3", "m4", "c11", "c21", "c33", "c44")
    return rows(spark, found, "k int, " + ", ".join(f"{n} double" for n in names)).select("k", *[r6(F.col(n)).alias(n) for n in names])


# binary files: each table is written to the shared folder and read again


def _file(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, d: str) -> str:
    path = _file(spark, "vectors")
    binary.write_vectors(vecs(spark, d), path)
    return path


@register("vecbin_scan", f"SELECT vec_id AS row_id, {R.format('embedding[1]::DOUBLE')} AS x1, {R.format('embedding[64]::DOUBLE')} AS x64 FROM embeddings")
def vecbin_scan(spark, d):
    df = dataset.vectors(binary.read_vectors(spark, stored(spark, d)), "row_id", "features")
    return df.select("row_id", r6(x(1)).alias("x1"), r6(x(64)).alias("x64"))


@register("vecbin_range", f"SELECT vec_id AS row_id, {R.format('embedding[2]::DOUBLE')} AS x2 FROM embeddings WHERE vec_id BETWEEN 100 AND 199")
def vecbin_range(spark, d):
    df = dataset.vectors(binary.read_vectors(spark, stored(spark, d), 100, 100, 4), "row_id", "features")
    return df.select("row_id", r6(x(2)).alias("x2"))


@register("vecbin_header", "SELECT count(*) AS n_rows, cast(max(len(embedding)) AS integer) AS n_cols FROM embeddings")
def vecbin_header(spark, d):
    return rows(spark, [binary.query_header(stored(spark, d))], "n_rows long, n_cols int")


@register("class_file", ORACLE["classify"])
def class_file(spark, d):
    path = _file(spark, "classes")
    binary.write_classes(classify(spark, d), path)
    return binary.read_classes(spark, path)


@register("gmm_class_file", ORACLE["gmm_classify"])
def gmm_class_file(spark, d):
    path = _file(spark, "classes")
    binary.write_classes(gmm_classify(spark, d), path)
    return binary.read_classes(spark, path)


@register("mixture_file", ORACLE["em_sweep"])
def mixture_file(spark, d):
    path = _file(spark, "mixture")
    models.write_mixture(path, one(spark, d)[1])
    return mixture_rows(spark, models.read_mixture(path)[0])


@register("centroid_file", ORACLE["forgy"])
def centroid_file(spark, d):
    path = _file(spark, "centroids")
    models.write_centroids(path, seeds(vecs(spark, d)))
    return centroid_rows(spark, models.read_centroids(path, K, 64))
