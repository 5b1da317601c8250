"""Packing of tokenized documents into sequences of bounded length.

Only the histogram of piece lengths, at most ``max_len`` numbers, reaches the driver. Patterns of few documents, of exact lengths where few
lengths are in use and of length classes otherwise, are enumerated if they can fill a sequence; non-negative least squares fits
how often each is repeated; the rounded repeats are filled with the exact lengths that fill a sequence best, in several rounds, each fitted to what the
rounds before left. What remains is packed best-fit, longest first, and so is the room that a pattern leaves. The plan says, for each length, which of
its pieces (by rank) go to which sequences and offsets; pieces get ranks by windows over small buckets and take their places by a
broadcast range join. No text and no token is shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, by_bytes, materialise, release, unboxed, using_tables

MAX_LEN = 4096
#: Added after each document.
END_ID = 1
#: Chunks of a worker's table; at the bound a new one begins, which takes from the old one what is met again.
MAX_CHUNKS = 500_000
#: Texts of Latin-1 characters, which are composed and where lower-casing goes character by character, without controls that some take for
#: white space; marks that end a chunk after a letter.
LATIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\xff]*").fullmatch
AFTER_WORD = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])[.,;:!?*#$%&]+(?=\\s|$)")
#: Length classes, exact lengths that are used instead where there are no more, and documents of a pattern at most.
CLASSES, EXACT, PATTERN = 64, 24, 4
#: Settings that are tried until one reaches the least possible number; the plan of fewest sequences counts. Each: the shortest length of a pattern, as a share of a sequence (shorter pieces close
#: sequences), and for each round of fitting the share of a sequence that a pattern may leave open.
SETTINGS = ((1 / 16, (0.0, 0.0, 0.002)), (1 / 3, (0.0, 0.0)), (1 / 16, (0.0, 0.0, 0.0, 0.0, 0.002, 0.005, 0.01, 0.02, 0.03)))
#: Rows of a length that one window sorts, about.
BUCKET = 2048


class ChunkTokenizer:
    """Token ids by the tokenizers library, remembered by chunk between ASCII blanks.

    For tokenizers that compose, lower-case, drop white space and split there and between letters and marks, as ``word_bpe_49k.json`` does: a
    chunk's ids don't depend on its neighbours, and Latin-1 texts may be lower-cased and marks taken off words beforehand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        plain = [(n, a.content) for n, a in sorted(self.tool.get_added_tokens_decoder().items()) if not (a.lstrip or a.rstrip or a.single_word or a.normalized)]
        self.mark, self.added = plain[0][0] if plain else None, [a for _, a in plain]
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def clear(self) -> None:
        self.chunks, self.older = {}, {}

    def _encode(self, listed: list[str]) -> None:
        """Chunks go to the library many at a time, parted by an added token, at which the library cuts before all else."""
        other = [c for c in listed if any(a in c for a in self.added)] if self.added else listed
        easy = list(set(listed).difference(other)) if other else listed
        groups = [easy[i : i + 64] for i in range(0, len(easy), 64)] if self.added else []
        for k in range(0, len(groups), 64):
            some = groups[k : k + 64]
            for group, e in zip(some, self.tool.encode_batch_fast([self.added[0].join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts, found, first = np.flatnonzero(ids == self.mark).tolist(), ids.tobytes(), 0
                for c, last in zip(group, [*cuts, len(ids)], strict=True):
                    self.chunks[c], first = found[4 * first : 4 * last], last + 1
        for c in other:
            self.chunks[c] = np.array(self.tool.encode(c, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        low = text.lower()
        if LATIN(text) and all(low.count(a) == text.count(a) for a in self.added):
            return AFTER_WORD.sub(r" \g<0>", low).split()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self._split(t or "") for t in texts]
        new: set[str] = set()
        for chunks in split:
            new.update(filterfalse(self.chunks.__contains__, chunks))
        if new:
            if len(self.chunks) + len(new) > MAX_CHUNKS:
                self.chunks, self.older, new = {}, self.chunks, {c for chunks in split for c in chunks}
            known = new & self.older.keys()
            self.chunks.update((c, self.older[c]) for c in known)
            self._encode(list(new - known))
        get = self.chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenize_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document with ``end_id``, cut only where it is longer than ``max_len``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tool, end = _tokenizer(path), np.array([end_id], "<u4").tobytes()
        with using_tables("packing", tool.clear):
            for batch in batches:
                for some in by_bytes(batch, 1, 1 << 19):
                    rows, cuts = [], []
                    for i, ids in enumerate(tool(some.column(1).to_pylist())):
                        ids += end
                        for n, at in enumerate(range(0, len(ids), 4 * max_len)):
                            cut = ids[at : at + 4 * max_len]
                            rows.append((i, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
                            cuts.append(cut)
                    at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                    out = [some.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                    if with_ids:
                        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cuts), "<u4").astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])
                release()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(part, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 of least |a x - b|, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    limit = tolerance * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(3 * min(a.shape)):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= limit:
            break
        free[j] = True
        while True:
            on = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            free[on[low & (x[on] <= 1e-12)]] = False
            free[on[np.argmin(np.where(low, x[on], np.inf))]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def _patterns(low: Sequence[int], high: Sequence[int], least: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
    """Non-increasing tuples of up to ``parts`` class numbers whose lengths, each from ``low`` to ``high``, can add up to ``least`` to ``most``."""

    def grow(chosen: tuple[int, ...], at_least: int, at_most: int) -> Iterator[tuple[int, ...]]:
        if chosen and at_most >= least:
            yield chosen
        if len(chosen) < parts:
            for c in range(chosen[-1] if chosen else len(low) - 1, -1, -1):
                # the rest can't be longer than this one
                if at_least + low[c] <= most and at_most + (parts - len(chosen)) * high[c] >= least:
                    yield from grow((*chosen, c), at_least + low[c], at_most + high[c])

    yield from grow((), 0, 0)


def fit_patterns(counts: np.ndarray, max_len: int, open_share: float = 0.0, shortest: float = 1 / 16, classes: int = CLASSES, exact: int = EXACT, parts: int = PATTERN) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and their whole repeats. ``counts[n]``: pieces of length n. A pattern is a list of (shortest, longest) lengths."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths >= shortest * max_len]
    if not len(lengths):
        return []
    if len(lengths) <= exact:
        low = high = lengths.tolist()
    else:
        width = max(1, max_len // classes)
        used = np.unique((lengths - 1) // width)
        low, high = (used * width + 1).tolist(), np.minimum((used + 1) * width, max_len).tolist()
    patterns = list(_patterns(low, high, int(np.ceil(max_len * (1 - open_share))), max_len, parts))
    if not patterns:
        return []
    a = np.zeros((len(low), len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            a[c, j] += 1
    held = np.array([counts[x : y + 1].sum() for x, y in zip(low, high, strict=True)], float)
    # a pattern of classes is full on average if their middles add up to a sequence: one more equation, of little weight
    middles = (np.array(low) + np.array(high)) / 2
    off = np.abs(middles @ a - max_len) / max_len
    weight = np.sqrt(middles / max_len)  # short documents fit anywhere, so what the patterns leave of them weighs less
    scale = max(1.0, held.max())
    repeats = nnls(np.vstack([a * weight[:, None], off]), np.append(held * weight / scale, 0.0)) * scale
    return [([(low[c], high[c]) for c in patterns[j]], max(1, int(repeats[j]))) for j in np.argsort(-repeats, kind="stable") if repeats[j] > 0.5]


def plan_packing(counts: np.ndarray, max_len: int = MAX_LEN, report: dict | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, pieces of it), ...]) until every piece of the histogram has a place: the best of several settings.

    ``report`` gets the number of pieces that patterns placed. Each run uses up a length or a pattern, so the plan is bounded by ``max_len``.
    """
    least, tried = -(-int(np.arange(len(counts)) @ np.asarray(counts, np.int64)) // max_len), []
    for setting in SETTINGS:
        plan, placed = _plan(counts, max_len, *setting)
        tried.append((sum(run for run, _ in plan), placed, plan))
        if tried[-1][0] <= least:
            break
    _, placed, plan = min(tried, key=lambda t: t[0])
    if report is not None:
        report["by_patterns"] = placed
    return plan


def _plan(counts: np.ndarray, max_len: int, shortest: float, rounds: Sequence[float]) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    left = np.asarray(counts, np.int64).copy()
    lengths = np.flatnonzero(left).tolist()  # those not used up
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    placed = 0

    def emit(start: list[int], most: int) -> int:
        """One run of equal sequences that starts with the given lengths; returns how many."""
        used: dict[int, int] = {}
        for n in start:
            used[n] = used.get(n, 0) + 1
        room = max_len - sum(start)
        while room > 0 and (k := bisect_right(lengths, room)):
            while k and left[lengths[k - 1]] <= used.get(lengths[k - 1], 0):
                k -= 1
            if not k:
                break
            n = lengths[k - 1]
            times = min(room // n, int(left[n]) - used.get(n, 0))
            used[n] = used.get(n, 0) + times
            room -= n * times
        run = min([most, *(int(left[n]) // t for n, t in used.items())])
        for n, t in used.items():
            left[n] -= run * t
            if not left[n]:
                lengths.remove(n)
        plan.append((run, sorted(used.items(), reverse=True)))
        return run

    def fullest(pattern: list[tuple[int, int]], least: int) -> list[int] | None:
        """Lengths within the pattern's classes, still there, that add up to the most up to ``max_len``, at least ``least``; first the longest."""
        *few, last = pattern
        there = np.zeros(max_len + 1, np.int64)
        there[last[0] : last[1] + 1] = np.where(left[last[0] : last[1] + 1] > 0, np.arange(last[0], last[1] + 1), 0)
        there = np.maximum.accumulate(there)  # the longest of the last class up to a length
        sums, chosen = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        for k, (x, y) in enumerate(few):
            here = np.arange(y, x - 1, -1)
            here = here[left[here] > 0]
            if k == 0:
                here = here[:1]
            if not len(here):
                return None
            sums, chosen = (sums[:, None] + here).ravel(), np.column_stack([np.repeat(chosen, len(here), axis=0), np.tile(here, len(sums))])
            keep = sums <= max_len
            sums, chosen = sums[keep], chosen[keep]
        if not len(sums):
            return None
        close = there[max_len - sums]
        whole = np.where(close > 0, sums + close, 0)
        # of equally full ones that of the most frequent lengths, which leaves most choice
        for i in np.lexsort((-np.minimum(left[close], left[chosen].min(axis=1, initial=1 << 60)), -whole))[:8]:
            if whole[i] < max(least, 1):
                break
            found = [*chosen[i].tolist(), int(close[i])]
            if all(left[n] >= found.count(n) for n in found):
                return found
        return None

    for share in rounds:
        for pattern, repeats in fit_patterns(left, max_len, share, shortest):
            while repeats > 0 and (start := fullest(pattern, int(np.ceil(max_len * (1 - share))))):
                before = int(left.sum())
                repeats -= emit(start, repeats)
                placed += before - int(left.sum())
    while lengths:
        emit([lengths[-1]], 1 << 60)
    return plan, placed


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for run, used in plan:
        offset = 0
        for n, times in used:
            first = taken.get(n, 0)
            taken[n] = first + run * times
            out.append((n, first, taken[n], times, sequence, offset))
            offset += n * times
        sequence += run
    return out


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset, which replace columns of these names.

    Repeated rows are packed each for itself; which of several pieces of one length takes which place is of no account, so ties are no matter; no row is
    lost. All other columns come back as they are, whatever their names. An empty table gives an empty one. The plan has at most a few rows per length, so its
    size is bounded by ``max_len``.
    """
    spark = pieces.sparkSession
    # equal rows get different slots, which are fixed once they are written
    slot = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("slot")
    rows = boxed(pieces, {c: c for c in ("doc_id", "piece", "length")}).select("row", "length", slot)
    rows = materialise(rows, "pieces")
    counts = np.zeros(max_len + 1, np.int64)
    for row in rows.groupBy("length").count().collect():  # max_len rows at most
        counts[row["length"]] = row["count"]
    places = _places(plan_packing(counts, max_len))
    # by Arrow, as rows of Python objects would go through Python workers of their own, which stay beside those that tokenize
    names = ["of", "lo", "hi", "times", "sequence", "at"]
    table = spark.createDataFrame(pa.table([pa.array([p[i] for p in places], pa.int64()) for i in range(len(names))], names=names))
    buckets = int(-(-counts.sum() // BUCKET)) or 1
    spread = rows.withColumn("bucket", F.floor(F.col("slot") * buckets / (1 << 30)).cast("long"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("slot")) - 1)
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    placed = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    joined = placed.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    made = joined.select(
        "row",
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
    return unboxed(made, pieces, ("sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; null and empty texts are the end id alone. Other columns of ``docs`` are left out."""
    return pack(tokenize_pieces(docs, path, id_col, text_col, max_len, end_id, with_ids), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the packed token sequences themselves, from a table packed with ids. A sequence is bounded, and so is each group."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))
