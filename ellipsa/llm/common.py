"""Expressions and helpers that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from threading import RLock, Timer

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ellipsa.session import materialise, read_table, shared_dir

__all__ = ["LOWER", "SPACES", "UPPER", "boxed", "bucket_below", "by_bytes", "crc_mod", "lower_az", "materialise", "one_text_each", "read_table", "release", "row_key", "shared_dir", "sole_tables", "strip_ascii", "unboxed", "using_tables", "words_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space that separates words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def strip_ascii(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def row_key(*cols: Column) -> list[Column]:
    """128 bits that name a row by content; equal rows have equal keys, null is a value like any other."""
    marked = [c for x in cols for c in (x.isNull(), x)]
    return [F.xxhash64(*marked).alias("_k1"), F.xxhash64(F.lit(7919), *marked).alias("_k2")]


def bucket_below(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(20011), key), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text and the columns of ``sample`` (doc_id once each, and others): one row per id, its text of least content hash."""
    others = [c for c in sample.columns if c != "doc_id"]
    joined = docs.select("doc_id", "text").join(sample, "doc_id")
    chosen = joined.groupBy("doc_id", *others).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return chosen.select("doc_id", F.col("least.text").alias("text"), *others)


def boxed(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """All columns of ``df`` in the struct ``row``, and copies of some under names of ours, so that no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def unboxed(df: DataFrame, like: DataFrame, made: Sequence[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``like`` out of ``row`` with those in ``replaced`` anew, then the columns ``made``, which win over columns of their names."""
    taken = {c.lower() for c in made}
    old = [(replaced or {}).get(c, F.col("row").getField(c)).alias(c) for c in like.columns if c.lower() not in taken]
    return df.select(*old, *made)


#: How to empty the tables of the tool that this worker process ran last.
_holder: dict[str, Callable[[], None]] = {}


def sole_tables(name: str, clear: Callable[[], None]) -> None:
    """Called by a tool that remembers words: worker processes outlive stages, so what another tool has remembered is let go first."""
    others = [_holder.pop(x, None) for x in list(_holder) if x != name]
    for let_go in filter(None, others):
        let_go()
    if others:
        release()
    _holder[name] = clear


#: Seconds after which a tool that no task uses lets its tables go.
IDLE_S = 2.0
_lock = RLock()
_users = 0
_timer: Timer | None = None


@contextmanager
def using_tables(name: str, clear: Callable[[], None]) -> Iterator[None]:
    """``sole_tables`` for a task or a batch; if no other follows for ``IDLE_S``, the tables go too, as an idle worker would hold them through stages of the JVM alone."""
    global _users, _timer

    def let_go() -> None:
        with _lock:
            if not _users and (held := _holder.pop(name, None)):
                held()
                release()

    with _lock:
        _users += 1
        if _timer:
            _timer.cancel()
        sole_tables(name, clear)
    try:
        yield
    finally:
        with _lock:
            _users -= 1
            _timer = Timer(IDLE_S, let_go)
            _timer.daemon = True
            _timer.start()


def release() -> None:
    """What Arrow and the C library hold unused in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def by_bytes(batch, column: int, most: int = 4 << 20):
    """Slices of an Arrow record batch whose texts hold about ``most`` bytes each; a longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()  # no text is copied
    total, first = 0, 0
    for i, size in enumerate(sizes):
        total += size + 64
        if total >= most:
            yield batch.slice(first, i + 1 - first)
            total, first = 0, i + 1
    if first < batch.num_rows:
        yield batch.slice(first)
