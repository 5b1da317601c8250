"""Approximate nearest neighbours by shifted space-filling curves.

1. Equal vectors become one representative with its least ids, so a vector that fills a third of the table is one point.
2. Several Hilbert orderings, each of its own random projection and shift, are range-partitioned by key in Spark. The sorted table gives each
   representative its exact place on each curve, whatever the borders of the partitions.
3. How many orderings are used and how wide the windows on them are is fitted: a bounded sample of the queries is searched exhaustively, and the
   cheapest setting is taken that finds the wanted share of its true neighbours.
4. Places are cut into blocks of equal size. A query goes to every block that its windows touch, is compared with the rows in them, and its nearest of all
   blocks and orderings are merged and reranked by exact distance.

Vectors of few intrinsic dimensions need narrow windows. Where the neighbours of a vector are hardly nearer than the rest, no index that
keeps the wanted recall is narrow: then the windows grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Orderings at most, the numbers of them that are tried, projected dimensions of each, and bits of a dimension.
ORDERINGS, TRIED, DIMS, CURVE_BITS = 16, (2, 4, 8, 16), 15, 4
#: Rows on each side of a query on a curve, at least.
WINDOW = 512
#: Queries of the fitting sample, and the share of their neighbours that windows must hold.
SAMPLE, RECALL = 128, 0.94
#: Rows of a range partition, about; rows of a block at least and at most: what a task holds.
RANGE_ROWS, BLOCK = 50_000, (4096, 65536)
#: Queries of one pass of the exhaustive search, and lengths of vectors in one table.
PASS, LENGTHS = 4096, 16


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows x dimensions), by the transpose method of Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs; squares are added in the order of the dimensions, in double precision."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - x[:, j]
        total += d * d
    return np.sqrt(total)


def _nearest(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, distance) the ``k`` least of each query by distance, then id; a pair counts once."""
    query, ids, d = pairs
    order = np.lexsort((ids, d, query))
    query, ids, d = query[order], ids[order], d[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, d = query[new], ids[new], d[new]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)])) < k
    return query[keep], ids[keep], d[keep]


def _closest(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, x: np.ndarray, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, id, distance) of the ``k`` nearest rows of each query; ``far`` marks pairs that don't count. Candidates by matrix product, then exactly."""
    norms = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
    about = norms - 2 * (q @ x.T)
    if far is not None:
        about[far] = np.inf
    last = np.partition(about, k - 1, axis=1)[:, k - 1] if about.shape[1] > k else np.full(len(q), np.finfo(float).max)
    i, j = np.nonzero(about <= (last + 1e-9 * norms.max(axis=1))[:, None])
    near = np.isfinite(about[i, j])
    i, j = i[near], j[near]
    return _nearest((qid[i], rid[j], distances(q[i], x[j])), k)


_PAIRS = "query long, rid long, d double"


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "rid", "d"])


def representatives(rows: DataFrame, k: int, every: int) -> DataFrame:
    """(rid, vector, ids, asked): one row per distinct usable vector; rid is its least id, ids its ``k`` + 1 least, asked whether an id is a query.

    Usable: the id isn't null and the vector has only finite components and one that isn't 0.
    """
    good = rows.where(F.col("id").isNotNull() & F.expr("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"))
    good = good.select("id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(3), "vector").alias("k2"))
    spread = good.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))  # a hot vector's ids meet in 256 parts first
    part = spread.agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.bool_or(F.col("id") % every == 0).alias("asked"))
    ids = part.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.bool_or("asked").alias("asked"))
    least = ids.select(F.element_at("ids", 1).alias("id"), "k1", "k2", "ids", "asked")
    return good.join(least, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select(F.col("id").alias("rid"), "vector", "ids", "asked")


def _curves(dim: int, orderings: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(dim, DIMS)] for _ in range(orderings)]


def places(reps: DataFrame, n: int, dim: int, orderings: int, seed: int) -> DataFrame:
    """(curve, place, rid): where each representative is on each curve, places from 0 to ``n`` - 1."""
    curves = _curves(dim, orderings, seed)
    width = min(dim, DIMS)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                y = x @ np.hstack(curves)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(y.shape[1])), pa.array(np.full(y.shape[1], float(len(y)))), pa.array(y.sum(axis=0)), pa.array((y**2).sum(axis=0))], ["at", "n", "s", "q"])

    sums = reps.select("vector").mapInArrow(bounds, "at long, n double, s double, q double").groupBy("at").agg(F.sum("s") / F.sum("n"), F.sum("q") / F.sum("n")).orderBy("at").collect()
    mean = np.array([r[1] for r in sums])
    reach = 2.5 * np.sqrt(np.maximum(np.array([r[2] for r in sums]) - mean**2, 1e-300))  # cells lie within; what is farther out is in the outermost ones
    shift = np.random.default_rng(seed + 1).uniform(0, 0.5, len(mean))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for o, c in enumerate(curves):
                at = slice(o * width, (o + 1) * width)
                unit = ((x @ c - mean[at]) / (2 * reach[at]) + 0.5 + shift[at]) / 1.5
                cells = np.clip(unit * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), pa.array(hilbert_key(cells, CURVE_BITS)), batch.column(0)], ["curve", "key", "rid"])

    keys = reps.select("rid", "vector").mapInArrow(keyed, "curve int, key long, rid long")
    parts = max(2, -(-n * orderings // RANGE_ROWS), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(parts, "curve", "key", "rid").sortWithinPartitions("curve", "key", "rid")
    ordered = materialise(ordered.select("curve", "rid", F.monotonically_increasing_id().alias("i")), "curves")
    part, within = F.shiftright("i", 33), F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect())  # one row per range partition
    before = np.cumsum([0, *[c for _, c in sizes]])[:-1].tolist()
    offsets = keys.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=True)], "part long, before long")
    found = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return found.select("curve", (F.col("before") + within - F.col("curve") * n).alias("place"), "rid")


def _exhaustive(reps: DataFrame, queries: list, k: int) -> DataFrame:
    """(query, rid, d): the nearest of ``queries`` (rid, vector), at most ``PASS``, among all rows."""
    sent = reps.sparkSession.sparkContext.broadcast((np.array([q[0] for q in queries]), np.array([q[1] for q in queries], np.float64)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        best: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                rid, x = some.column(0).to_numpy(), _matrix(some.column(1))
                for b in range(0, len(q), 512):
                    found = _closest(qid[b : b + 512], q[b : b + 512], rid, x, k + 1)
                    best = [np.concatenate(c) for c in zip(best, found, strict=True)]
                best = list(_nearest(tuple(best), k + 1))
        yield _batch(best)

    found = reps.select("rid", "vector").mapInArrow(part, _PAIRS)
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("d", "rid")
    return found.dropDuplicates(["query", "rid"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")


def fitted(reps: DataFrame, placed: DataFrame, n: int, k: int, orderings: int, window: int, sample: int, recall: float) -> tuple[int, int]:
    """(orderings, window): the least number of rows compared with a query that holds ``recall`` of the neighbours of the ``sample`` queries of least id hash."""
    some = reps.where("asked").orderBy(F.xxhash64("rid"), "rid").limit(sample).select("rid", "vector").collect()
    if not some or n <= window:
        return min(TRIED), window
    true = _exhaustive(reps, some, k)
    at = placed.withColumnRenamed("place", "at").withColumnRenamed("rid", "query")
    pairs = true.join(F.broadcast(placed.join(F.broadcast(true.select("rid").distinct()), "rid")), "rid")
    pairs = pairs.where("rid != query").join(at.join(F.broadcast(true.select("query").distinct()), "query"), ["query", "curve"])
    got = pairs.select("query", "rid", "curve", F.abs(F.col("place") - F.col("at")).alias("gap")).toArrow()  # sample x (k + 1) x orderings rows
    gaps = np.full((len(some) * (k + 1), orderings), n)
    _, row = np.unique(np.stack([got["query"].to_numpy(), got["rid"].to_numpy()]), axis=1, return_inverse=True)
    gaps[row, got["curve"].to_numpy()] = got["gap"].to_numpy()
    gaps = gaps[: row.max() + 1] if len(row) else gaps[:0]
    best = (orderings, n)
    for t in [x for x in TRIED if x <= orderings]:
        least = np.sort(gaps[:, :t].min(axis=1)) if len(gaps) else np.zeros(1, np.int64)
        width = max(window, int(least[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)]))
        if t * min(width, n) < best[0] * min(best[1], n):
            best = (t, width)
    return best


def searched(reps: DataFrame, placed: DataFrame, n: int, k: int, window: int) -> DataFrame:
    """(query, rid, d): the nearest of the windows of each query on all curves of ``placed``.

    A group has the rows of one block and the queries whose windows touch it: (block + 2 windows) / block times its share of them.
    """
    size = min(max(BLOCK[0], window // 4), BLOCK[1])
    there = placed.join(reps.select("rid", "vector", "asked"), "rid")
    rows = there.select("curve", F.floor(F.col("place") / size).alias("block"), "place", "rid", "vector", F.lit(False).alias("asks"))
    first, last = F.greatest(F.col("place") - window, F.lit(0)), F.least(F.col("place") + window, F.lit(n - 1))
    blocks = F.explode(F.sequence(F.floor(first / size), F.floor(last / size))).alias("block")
    asking = there.where("asked").select("curve", blocks, "place", "rid", "vector", F.lit(True).alias("asks"))

    def near(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        place, rid, x = table["place"].to_numpy(), table["rid"].to_numpy(), table["vector"].combine_chunks()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = []
        mine, vectors = rid[r], _matrix(x.take(pa.array(r)))
        for b in range(0, len(q) if len(r) else 0, 512):
            some = q[b : b + 512]
            far = np.abs(place[some][:, None] - place[r][None, :]) > window
            found.append(_closest(rid[some], _matrix(x.take(pa.array(some))), mine, vectors, k + 1, far))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c) for c in columns], ["query", "rid", "d"])

    return _best(rows.unionByName(asking).groupBy("curve", "block").applyInArrow(near, _PAIRS), k)


def nearest(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    orderings: int = ORDERINGS,
    window: int = WINDOW,
    recall: float = RECALL,
    sample: int = SAMPLE,
    seed: int = 11,
    exhaustive: bool = False,
) -> DataFrame:
    """query_id, rank, the neighbour's id as vec_id, and score: the ``k`` nearest rows found of each row whose id is divisible by ``every``.

    score is the Euclidean distance in double precision; ties go to the smaller id; fewer than ``k`` other rows give all of them. Rows with
    a null id, a null or zero vector or a null or non-finite component take no part. Vectors of several lengths, at most ``LENGTHS``, are searched among those of
    their own. Rows that repeat an id are that row. Other columns are ignored. Up to ``window`` + 1 distinct vectors the answer is exact; above, windows hold
    ``recall`` of the neighbours of the ``sample`` queries they are fitted on. With ``exhaustive`` every query is compared with every row, ``PASS`` queries at a
    time, without the curves. An empty table gives no rows.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    reps = materialise(representatives(source, k, every), "vectors")
    sizes = reps.groupBy(F.size("vector").alias("dim")).count().orderBy("dim").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    found = None
    for dim, n in sizes:
        alike = reps.where(F.size("vector") == dim)
        if exhaustive:
            near = _all_queries(alike, k)
        else:
            placed = materialise(places(alike, n, dim, orderings, seed), "places")
            t, width = fitted(alike, placed, n, k, orderings, window, sample, recall)
            near = searched(alike, placed.where(F.col("curve") < t), n, k, width)
        near = materialise(near, "nearest")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = found.join(reps.select("rid", "ids"), "rid").select("query", "d", F.explode("ids").alias("vec_id"))
    top = members.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("found"))  # k + 1 each
    keys = reps.where("asked").select("rid", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(3), "vector").alias("k2"))
    asking = source.where(F.col("id") % every == 0).select("id", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(3), "vector").alias("k2")).distinct()
    answers = asking.join(keys.join(lists, F.col("rid") == F.col("query")), ["k1", "k2"])
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("id")), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score"))


def _all_queries(reps: DataFrame, k: int) -> DataFrame:
    asked = materialise(reps.where("asked").select("rid", "vector", F.pmod(F.xxhash64("rid"), F.lit(1 << 20)).alias("slot")), "asked")
    passes = -(-asked.count() * 5 // (4 * PASS)) or 1
    found = None
    for b in range(passes):
        mine = asked.where(F.floor(F.col("slot") * passes / (1 << 20)) == b).select("rid", "vector").collect()
        near = _exhaustive(reps, mine, k) if mine else reps.sparkSession.createDataFrame([], _PAIRS)
        near = materialise(near, "pass")
        found = near if found is None else found.unionByName(near)
    return found
