"""Removal of lines that many documents share.

Plan, all of it built-in Spark expressions:

1. one pass over the texts hashes each normalised line to 128 bits and stores the hashes (about a
   tenth of the input) in the shared folder;
2. each document's hashes are made distinct by its id, then counted with a map-side combine, so a line that every
   document holds costs one row per task;
3. hashes in at least ``min_docs`` documents find their positions again. The very common ones
   are a list with a proven bound (``pairs / HEAVY`` occurrences each leaves at most ``HEAVY`` of them)
   and are broadcast; all others occur too rarely to make a partition uneven and are joined
   by hash;
4. dropped positions, gathered per row, meet the texts in one hash join, in which rows that repeat very often are dealt
   over ``SALTS`` partitions, and the lines that stay are put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lower_az, materialise, row_key, strip_ascii, unboxed

#: The most hashes that are ever broadcast: 16 bytes each.
HEAVY = 8192
#: Partitions over which the copies of one very common row are dealt.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(lines: Column, min_chars: int) -> Column:
    keys = F.transform(lines, lambda line: lower_az(strip_ascii(line)))
    return F.transform(
        keys,
        lambda key: F.when(F.length(key) >= max(1, min_chars), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))),
    )


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", counted: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` less the lines whose key ``min_docs`` documents or more hold, and ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under
    ``min_chars`` code points (at least 1) are never dropped. Rows of one id are one document, a row without an id, or each row where there is
    no column ``id_col``, is a document by itself; a line repeated in a document counts once. A null or empty text is one empty line and comes back empty. Rows that are
    equal in every column are alike in the result too. All columns come back, whatever their names;
    existing columns named n_lines or n_dropped are replaced, or left alone and none added if not ``counted``. An empty table gives an empty table.
    """
    kinds = dict(docs.dtypes)
    keys = row_key(*[F.col("row").getField(c) for c in docs.columns if "map<" not in kinds[c]])
    known = id_col in docs.columns
    keyed = boxed(docs, {"text": text_col} | ({"id": id_col} if known else {})).select("row", "text", F.col("id") if known else F.lit(None).cast("long").alias("id"), *keys)
    alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("alone")  # fixed once it is written
    hashed = materialise(keyed.select("id", alone, "_k1", "_k2", _hashes(_lines(F.col("text")), min_chars).alias("h")), "line-hashes")
    pairs = hashed.select("id", "alone", F.explode(F.array_distinct("h")).alias("h")).where("h is not null").select("id", "alone", "h.a", "h.b")
    counts = pairs.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    common = materialise(counts.where(F.col("n") >= min_docs), "common-lines")
    total = common.agg(F.sum("n")).first()[0] or 0
    limit = total / HEAVY
    at = hashed.select("_k1", "_k2", F.posexplode("h").alias("pos", "h")).where("h is not null").select("_k1", "_k2", "pos", "h.a", "h.b")
    heavy = common.where(F.col("n") > limit).select("a", "b")  # fewer than HEAVY: each has over total / HEAVY of total
    light = common.where(F.col("n") <= limit).select("a", "b")
    found = at.join(F.broadcast(heavy), ["a", "b"], "left_semi").unionByName(
        at.join(F.broadcast(heavy), ["a", "b"], "left_anti").join(light, ["a", "b"], "left_semi")
    )
    dropped = found.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("drop"))
    sizes = hashed.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    often = materialise(sizes.where(F.col("n") > HEAVY).orderBy(F.desc("n"), "_k1", "_k2").limit(HEAVY).select("_k1", "_k2", F.lit(SALTS).alias("salts")), "common-rows")
    none = F.array().cast("array<int>")
    salted = keyed.select("row", "_k1", "_k2").join(F.broadcast(often), ["_k1", "_k2"], "left")
    salted = salted.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    right = dropped.join(F.broadcast(often), ["_k1", "_k2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    joined = salted.select("row", "_k1", "_k2", "salt").join(right.select("_k1", "_k2", "salt", "drop").hint("shuffle_hash"), ["_k1", "_k2", "salt"], "left")
    split = joined.select("row", _lines(F.col("row").getField(text_col)).alias("lines"), F.coalesce("drop", none).alias("drop"))
    kept = split.withColumn("keep", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"))
    text = F.array_join(F.transform("keep", lambda i: F.get(F.col("lines"), i)), "\n")
    made = kept.withColumns({"n_lines": F.size("lines").cast("long"), "n_dropped": F.size("drop").cast("long")})
    return unboxed(made, docs, ("n_lines", "n_dropped") if counted else (), {text_col: text})
