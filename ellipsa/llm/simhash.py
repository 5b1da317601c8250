"""SimHash fingerprints and near-duplicate groups.

Links are found between distinct fingerprints, never between documents. Two fingerprints that differ in at
most ``MAX_BITS`` = 2 bits share at least six of their eight bytes by position.

The inverted index lists each fingerprint under 14 postings, one for each set of four byte positions whose numbers have XOR 0
(lists by single bytes would grow with the square of the corpus). Any three positions lie in exactly one such set,
so two fingerprints with m equal positional bytes share 14 postings for m = 8, 7 for m = 7, 3 for m = 6 and at most one for fewer: a
pair's tally over the index tells its equal bytes, and three shared postings are the guaranteed minimum. Pairs from postings
of at most ``POSTING`` fingerprints are tallied, those that reach the minimum are verified bit
by bit. Longer postings, which groups of near copies make, are not cut: their fingerprints go an exact linear
way. Each emits itself and its 64 one-bit neighbours; two fingerprints differ in at most 2 bits exactly if
they emit a common value, at most 65 distinct fingerprints can emit one value, and each is linked to the
least of them. A pair within 2 bits either has all its shared postings among the short ones, and is tallied in full, or is in a long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, by_bytes, materialise, release, row_key, sole_tables, unboxed

MAX_BITS = 2
#: Postings that two fingerprints within ``MAX_BITS`` share at least.
MIN_SHARED = 3
#: Fingerprints of a posting whose pairs are tallied one by one.
POSTING = 32
#: The most fingerprints that are ever broadcast.
HEAVY = 8192
_UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 bits of a text; bit i is set if it is in over half the shingle hashes."""
    words = (text or "").encode().translate(_UP).split()
    if not words:
        return 0
    if len(words) < shingle:
        return _HASH(b" ".join(words))
    hashes = np.fromiter(map(_HASH, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, the fingerprint as a signed long."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_tables("simhash", lambda: None)  # it has none, and needs none of another tool
        for batch in batches:
            for piece in by_bytes(batch, 1):
                found = np.array([fingerprint(t) for t in piece.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
            release()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(part, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _byte_sets() -> list[tuple[int, ...]]:
    """The 14 sets of four byte positions whose numbers have XOR 0."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def _postings(fps: DataFrame) -> DataFrame:
    """(fp, key): a key is the set's number and the four bytes."""
    keys = []
    for n, places in enumerate(_byte_sets()):
        key = F.lit(n << 32)
        for k, i in enumerate(places):
            key = key + F.shiftleft(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF)), 8 * k)
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, posting: int = POSTING) -> DataFrame:
    """(a, b) with a < b: verified links between the distinct fingerprints of column fp, enough to connect each group."""
    index = _postings(fps)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = materialise(index.join(sizes, "key").select("key", "fp", "n"), "postings")
    light = listed.where(F.col("n") <= posting).select("key", "fp")
    pairs = light.withColumnRenamed("fp", "a").join(light.withColumnRenamed("fp", "b"), "key").where("a < b")
    tallied = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= MIN_SHARED)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    heavy = listed.where(F.col("n") > posting).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    emitted = heavy.select("fp", F.explode(F.array(*near)).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))  # at most 65 rows
    close = emitted.select(least.alias("a"), F.col("fp").alias("b")).where("a < b").distinct()
    return verified.unionByName(close)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge (a, b): the least node it can reach, by alternating large and small stars."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))), F.lit(0))).first())

    edges = materialise(edges.select("a", "b"), "links")
    before = state(edges)
    for _ in range(max_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = materialise(large, "large-star")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialise(small.where("a < b").distinct(), "small-star")
        if (now := state(edges)) == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("the groups aren't connected yet; raise max_rounds")
    roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def _by_fingerprint(found: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """``found`` with the columns of ``table`` (fp, n, ...), n being the rows of a fingerprint.

    Those of more than ``total / HEAVY`` rows are fewer than ``HEAVY`` and are broadcast, so no fingerprint makes a partition uneven.
    """
    heavy = F.broadcast(table.where(F.col("n") > total / HEAVY).drop("n"))
    light = table.where(F.col("n") <= total / HEAVY).drop("n")
    return found.join(heavy, "fp").unionByName(found.join(heavy.select("fp"), "fp", "left_anti").join(light, "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of ``docs``.

    component_id is the least doc_id that links of at most 2 differing bits reach. Texts without words, and null ones,
    have fingerprint zero and are linked like any other. Repeated rows are copies like any others; null ids are reported and never
    chosen while the group has another. Other columns are ignored. An empty table gives no rows.
    """
    found = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    groups = materialise(connected(links(fps.select("fp"), posting)), "groups")
    named = groups.join(fps, groups.node == fps.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    ids = groups.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    classes = fps.join(ids, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    classes = materialise(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return _by_fingerprint(found, classes, total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of least id, null ids last, of rows with one id the one of least content hash.

    Groups are those of texts, whatever the ids: different texts that share an id, or have none, each stay. Rows that are equal in
    every column (maps aside) are copies of one text. All columns come back as they are, whatever their names. An empty table gives an empty one.
    """
    kinds = dict(docs.dtypes)
    keys = row_key(*[F.col("row").getField(c) for c in docs.columns if "map<" not in kinds[c]])
    keyed = boxed(docs, {"id": id_col, "text": text_col}).select("id", "text", *keys)
    named = keyed.select(F.struct(F.col("id").isNull().alias("none"), "id", "_k1", "_k2").alias("doc_id"), "text")
    found = materialise(fingerprints(named), "fingerprints")
    fps = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    groups = materialise(connected(links(fps.select("fp"), posting)), "groups")
    rooted = fps.join(groups, groups.node == fps.fp, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2")
    # equal rows meet within each task first, so that many of them make one row a task; the join needs no shuffle of texts of its own
    once = boxed(docs, {}).select("row", *keys).groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return unboxed(once.join(chosen, ["_k1", "_k2"], "left_semi"), docs, ())
