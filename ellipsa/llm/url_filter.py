"""URL verdicts from path rules and a Bloom filter cascade over the keys of hosts and addresses.

A cascade is a list of Bloom filters. The first encodes the listed keys, the second those
unlisted keys of the universe that the first lets through, the third those listed keys that the
second lets through, and so on until nothing is let through wrongly. A key of the universe is
judged by the first level that doesn't hold it: exact, without a join. Keys are 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, lower_az, materialise, unboxed

#: (action, host, path): the contract's fixed rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: An address of a page of fewer characters of HTML is listed.
THIN_CHARS = 1500
#: Bytes of one cascade that may be broadcast; a larger key list is split into shards.
MAX_BYTES = 64 << 20
#: Key sets up to this many rows finish on the driver: 16 bytes each.
LOCAL_KEYS = 1 << 16
MAX_LEVELS = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in 64-bit words, ``probes`` of them per key."""

    number: int
    bits: int
    probes: int
    words: np.ndarray

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _positions(self.number, self.bits, self.probes, a, b)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, bool)
        at = self.positions(a, b)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @property
    def size_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for keys of the universe."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        out, open_ = np.full(len(a), len(self.levels) % 2 == 1), np.arange(len(a))
        for k, level in enumerate(self.levels):
            inside = level.holds(a[open_], b[open_])
            out[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(number: int, bits: int, probes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        start, step = _mix(a + np.uint64(number + 1) * _GOLDEN), _mix(b + np.uint64(number + 1) * _GOLDEN) | np.uint64(1)
        return (start[None, :] + np.arange(probes, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(bits)


def _shape(inside: int, outside: int, first: bool) -> tuple[int, int]:
    """Bits and probes of a level; the first aims at about as many false positives as there are listed keys."""
    rate = min(0.5, max(1, inside) * math.sqrt(0.5) / max(1, outside)) if first else 0.5
    probes = max(1, math.ceil(math.log2(1 / rate)))
    return max(64, math.ceil(inside * probes * 1.4427 / 64) * 64), probes


def _encode_local(number: int, bits: int, probes: int, a: np.ndarray, b: np.ndarray) -> Level:
    words = np.zeros(bits // 64, np.uint64)
    at = _positions(number, bits, probes, a, b).ravel()
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return Level(number, bits, probes, words)


def _encode(keys: DataFrame, number: int, bits: int, probes: int) -> Level:
    """A level from a table of keys: tasks combine bits to words, words are combined by index."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            at = _positions(number, bits, probes, a, b).ravel()
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(value, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], ["i", "w"])

    rows = keys.mapInArrow(part, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[rows["i"].to_numpy()] = rows["w"].to_numpy().view(np.uint64)
    return Level(number, bits, probes, words)


def _passing(keys: DataFrame, levels: Sequence[Level], sent: list) -> DataFrame:
    """The keys that all of ``levels`` hold; the broadcast is added to ``sent``, for its end."""
    known = keys.sparkSession.sparkContext.broadcast(list(levels))
    sent.append(known)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            keep = np.ones(len(a), bool)
            for level in known.value:
                keep[keep] = level.holds(a[keep], b[keep])
            yield batch.filter(pa.array(keep))

    return keys.mapInArrow(part, "a long, b long")


def build_cascade(keys: DataFrame, local_keys: int = LOCAL_KEYS) -> Cascade:
    """The cascade of ``keys``: columns a, b (the halves of a key's hash) and listed; every key once."""
    sides = [keys.where("listed").select("a", "b"), keys.where("not listed").select("a", "b")]
    sizes = [0, 0]
    for row in keys.groupBy("listed").count().collect():  # two rows at most
        sizes[0 if row["listed"] else 1] = row["count"]
    cascade = Cascade()
    held: list = [None, None]  # a side on the driver, once it is small
    sent: list = []
    for number in range(MAX_LEVELS):
        mine, other = number % 2, 1 - number % 2
        if not sizes[mine]:
            return cascade
        bits, probes = _shape(sizes[mine], sizes[other], number == 0)
        if held[mine] is None and sizes[mine] <= local_keys:
            got = _passing(sides[mine], cascade.levels[other::2], sent).toArrow()
            held[mine] = [got[c].to_numpy().view(np.uint64) for c in ("a", "b")]
        if held[mine] is not None:
            level = _encode_local(number, bits, probes, *held[mine])
        else:
            level = _encode(_passing(sides[mine], cascade.levels[other::2], sent), number, bits, probes)
        cascade.levels.append(level)
        if held[other] is not None:
            keep = level.holds(*held[other])
            held[other] = [x[keep] for x in held[other]]
            sizes[other] = int(keep.sum())
        else:
            sizes[other] = _passing(sides[other], cascade.levels[mine::2], sent).count()
        while sent:
            sent.pop().destroy()
    raise ValueError("the cascade doesn't end: a listed and an unlisted key share a 128-bit hash")


def key_hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def build_shards(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES, local_keys: int = LOCAL_KEYS) -> list[Cascade]:
    """Cascades over the keys of ``universe``, sharded by hash so that none is larger than ``max_bytes``.

    Both tables have one string column, key. Listed keys outside the universe are never asked for and are left out.
    """
    rows = universe.select(*(h.alias(n) for h, n in zip(key_hash(F.col("key")), "ab", strict=True)), F.lit(False).alias("on"), F.lit(True).alias("in"))
    rows = rows.unionByName(listed.where("key is not null").select(*(h.alias(n) for h, n in zip(key_hash(F.col("key")), "ab", strict=True)), F.lit(True).alias("on"), F.lit(False).alias("in")))
    keys = rows.groupBy("a", "b").agg(F.bool_or("on").alias("listed"), F.bool_or("in").alias("in")).where("in").select("a", "b", "listed")
    keys = materialise(keys, "url-keys")
    n_listed, n_all = keys.agg(F.count_if("listed"), F.count(F.lit(1))).first()
    need = _shape(n_listed, n_all - n_listed, True)[0] // 8 + n_listed  # later levels: about a byte for each listed key
    shards = max(1, math.ceil(need / max_bytes))
    return [build_cascade(keys if shards == 1 else keys.where(F.pmod(F.col("a"), F.lit(shards)) == s), local_keys) for s in range(shards)]


def _judge(sent):
    @F.arrow_udf("boolean")
    def judge(a: pa.Array, b: pa.Array) -> pa.Array:
        tree, mine, n = sent.value
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (a, b)]
        hit = tree.listed(*flat) & (flat[0] % n == mine)
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        return pa.array(sums[ends] > sums[np.concatenate([[0], ends[:-1]])] if len(ends) else [], pa.bool_())

    return judge


def listed_any(df: DataFrame, keys: str, out: str, shards: Sequence[Cascade]) -> DataFrame:
    """``df`` with the boolean ``out``: whether any key of the array column ``keys`` is listed.

    A column of that name is replaced, all others stay. One pass per shard; between passes the result so far is written, so a task holds one cascade at a time.
    """
    like = df
    halves = F.transform("keys", lambda k: key_hash(k)[0]).alias("a"), F.transform("keys", lambda k: key_hash(k)[1]).alias("b")
    df = boxed(df, {"keys": keys}).select("row", *halves, F.lit(False).alias(out))
    for s, cascade in enumerate(shards):
        judge = _judge(df.sparkSession.sparkContext.broadcast((cascade, s, len(shards))))
        df = df.withColumn(out, F.col(out) | judge("a", "b"))
        if s + 1 < len(shards):
            df = materialise(df, "url-pass")
    return unboxed(df, like, (out,))


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains; none for an empty host."""
    labels = F.size(F.split(host, r"\."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", host, F.lit("."), -i)))


def _under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def address_of(host: Column, path: Column) -> Column:
    """Host and path as one key, ``/`` for an empty path; it has a slash, which host keys don't."""
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def thin_addresses(pages: DataFrame, least: int = THIN_CHARS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key: the addresses at which a page has fewer than ``least`` characters of HTML; null HTML has none, empty hosts are left out.

    One row per task and address is shuffled, so an address of very many pages is no heavier than others.
    """
    host, path = host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`"))
    thin = pages.where((host != "") & (F.length(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))) < least))
    return thin.select(address_of(host, path).alias("key")).distinct()


def judge_urls(pages: DataFrame, blocked: DataFrame | Sequence[str], rules: Iterable[tuple[str, str, str]] = RULES, url_col: str = "url", **build) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    The longest rule that fits decides; else a page is blocked if its host, a parent domain or its address (``address_of``) is among
    ``blocked`` (a sequence, or a table with a column key, of any size), judged by a cascade over all
    such keys of ``pages``. Null urls and urls without ``://`` have an empty host and path, fit no rule and are
    allowed. Of equally long rules the first in text order wins. Repeated rows are judged alike; an empty table gives an empty
    table.
    """
    spark = pages.sparkSession
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(x,) for x in blocked], "key string")
    made = ("host", "path", "rule", "verdict")
    if not blocked.columns == ["key"]:
        blocked = blocked.select("key")
    parts = boxed(pages, {"url": url_col}).select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    address = F.when(F.col("host") != "", address_of(F.col("host"), F.col("path")))
    universe = parts.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    universe = universe.unionByName(parts.select(address.alias("key")).where("key is not null").distinct())
    lower = F.concat(lower_az(F.substring_index("key", "/", 1)), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))  # of an address, the host alone
    shards = build_shards(universe, blocked.select(lower.alias("key")), **build)
    keys = F.concat(suffixes(F.col("host")), F.array_compact(F.array(address)))
    judged = listed_any(parts.withColumn("keys", keys), "keys", "listed", shards)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(x) for x in r[1] + r[2]])):
        fits = _under(F.col("host"), host) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return unboxed(judged.withColumns({"rule": rule, "verdict": verdict}), pages, made)
