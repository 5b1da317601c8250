"""Byte-level BPE by speculation and verification.

A word's tokens are proposed by greedy longest match. Whether they are what merging gives is a local matter: they are,
exactly if each adjacent pair of tokens is compatible, that is if no merge across their border would have come
before a merge that builds the tokens. One pass of an automaton over all new words of a batch proposes; the pairs are tested at
once with numpy; words with a pair that fails are merged exactly, lowest rank first, many at a time. Results are kept by word and by
chunk of text, in bounded tables of the worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, sole_tables

#: Unicode white space, as the pattern's \s has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The published pre-tokenizer pattern of byte-level BPE, with \s spelt out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Pieces of the pattern never cross these chunks.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Entries of each of a worker's tables; at the bound a new one begins, which takes from the old one what is met again.
MAX_KNOWN = 250_000
#: Bytes of a word up to which failing words are merged side by side; longer ones go one by one.
SIDE_BY_SIDE = 48
_NEVER = np.int64(1) << 40
#: Parts the words in front of the automaton; no token holds it.
_PART = "\u0100"


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in published byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known:
    """A bounded table in two generations: what isn't met again goes with the older one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, seen: set) -> list:
        """Those of ``seen`` that must be computed; from now on all others are in ``new``."""
        if fresh := seen - self.new.keys():
            if len(self.new) + len(fresh) > self.most:
                self.old, self.new, fresh = self.new, {}, seen
            met = fresh & self.old.keys()
            self.new.update((x, self.old[x]) for x in met)
            return list(fresh - met)
        return []


class ByteBpe:
    """The encoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[bytes, int] = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([model["vocab"][m[k]] for m in pairs], np.int64) for k in (0, 1))
        made = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        self.size = size
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; bytes have none
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank[made[::-1]] = np.arange(len(pairs))[::-1]
        first = self.rank[made] == np.arange(len(pairs))
        self.left[made[first]], self.right[made[first]] = left[first], right[first]
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs))[order], made[order]
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.byte_pair = self._lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))[0].reshape(256, 256)
        self.merges = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._find = regex.compile(PATTERN).findall
        self.chunks, self.pieces = Known(MAX_KNOWN), Known(MAX_KNOWN)
        self.words: dict[str, int] = {"proposed": 0, "merged": 0}

    def clear(self) -> None:
        self.chunks, self.pieces = Known(MAX_KNOWN), Known(MAX_KNOWN)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the merge of each pair; the rank is ``_NEVER`` where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    @cached_property
    def offered(self) -> dict[bytes, int]:
        """Tokens that greedy matching may propose: those that merging their own bytes gives."""
        tokens = np.array(sorted(self.ids.values()), np.int64)
        whole = tokens[self.rank[tokens] >= 0]
        good = self.compatible(self.left[whole], self.right[whole], self.rank[whole])
        reached = dict(zip(whole.tolist(), good.tolist(), strict=True))
        for t in sorted(whole.tolist(), key=lambda t: self.rank[t]):  # parts come before the whole
            reached[t] = reached[t] and reached.get(int(self.left[t]), True) and reached.get(int(self.right[t]), True)
        return {b: i for b, i in self.ids.items() if reached.get(i, True)}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the longest offered token at a place, then goes on behind it. A byte is a letter of the same number."""
        found = ahocorasick.Automaton()
        for b, i in self.offered.items():
            found.add_word(b.decode("latin-1"), i)
        found.add_word(_PART, -1)
        found.make_automaton()
        return found

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one word after another, and where each word's tokens end."""
        text = _PART.join([w.decode("latin-1") for w in words]) + _PART
        found = np.fromiter((t for _, t in self.automaton.iter_long(text)), np.int64)
        parts = np.flatnonzero(found < 0)
        return found[found >= 0], parts - np.arange(len(parts))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, that no merge across the border comes first.

        Walks back in time along the right edge of a and the left edge of b. A merge of the pieces x and y at the border,
        of rank q, comes first if x is merged into its parent later than q and y not before q: of equal ranks
        the merge further left is done first. ``before`` is the rank at which a and b themselves are merged.
        """
        x, y = a.copy(), b.copy()
        until_x = np.full(len(x), _NEVER) if before is None else before.copy()
        until_y = until_x.copy() if before is None else before - 1
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            xs, ys = x[open_], y[open_]
            q, _ = self._lookup(xs, ys)
            clash = (q < until_x[open_]) & (q <= until_y[open_])
            good[open_[clash]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            back_x = rx > ry  # of equal ranks the right one was made later
            stay = ~clash & (np.maximum(rx, ry) >= 0)
            mx, my = open_[stay & back_x], open_[stay & ~back_x]
            until_x[mx], x[mx] = self.rank[x[mx]], self.right[x[mx]]
            until_y[my], y[my] = self.rank[y[my]], self.left[y[my]]
            open_ = open_[stay]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, of equal ranks the leftmost."""
        tokens = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(tokens)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(r[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := merges.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j], k = merges[a, b][1], -1, after[j]
            after[i] = k
            if k < n:
                ahead[k] = i
                if r := merges.get((tokens[i], tokens[k])):
                    heapq.heappush(heap, (r[0], i, tokens[i], tokens[k]))
            if (h := ahead[i]) >= 0 and (r := merges.get((tokens[h], tokens[i]))):
                heapq.heappush(heap, (r[0], h, tokens[h], tokens[i]))
        return [t for t in tokens if t >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words, in step: each step does one merge in every word that has one left. The ids come as 32-bit numbers."""
        out: list = [None] * len(words)
        order = np.argsort([len(w) for w in words], kind="stable")
        for k in range(0, len(order), 4096):
            mine = order[k : k + 4096]
            sizes, width = np.array([len(words[i]) for i in mine]), len(words[mine[-1]])
            raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in mine]), np.uint8).reshape(len(mine), width)
            tokens, place = self.byte_id[raw], np.arange(width)
            ranks = np.full((len(mine), width), _NEVER)
            ranks[:, :-1] = np.where(place[1:] < sizes[:, None], self.byte_pair[raw[:, :-1], raw[:, 1:]], _NEVER)
            at, sizes, rows = np.arange(len(mine)), sizes.copy(), mine
            while True:
                best = ranks.argmin(axis=1)  # the leftmost of the lowest
                more = ranks[at, best] < _NEVER
                done = np.flatnonzero(~more)
                raw, first = tokens[done].astype("<u4").tobytes(), 4 * width * np.arange(len(done))
                for i, a, b in zip(rows[done].tolist(), first.tolist(), (first + 4 * sizes[done]).tolist(), strict=True):
                    out[i] = raw[a:b]
                if not more.any():
                    break
                tokens, ranks, sizes, rows, best = tokens[more], ranks[more], sizes[more] - 1, rows[more], best[more]
                at = np.arange(len(rows))
                made = self._lookup(tokens[at, best], tokens[at, best + 1])[1]
                move = np.minimum(place + (place > best[:, None]), width - 1)
                tokens, ranks = np.take_along_axis(tokens, move, 1), np.take_along_axis(ranks, move, 1)
                ranks[:, -1] = _NEVER
                tokens[at, best] = made
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best + 1 < sizes)
                ranks[at, best] = _NEVER
                ranks[right, best[right]] = self._lookup(made[right], tokens[right, best[right] + 1])[0]
                ranks[left, best[left] - 1] = self._lookup(tokens[left, best[left] - 1], made[left])[0]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as 32-bit numbers: proposed for all, tested together, merged exactly where the test fails."""
        if not words:
            return []
        flat, ends = self.propose(words)
        border = np.ones(len(flat), bool)
        border[ends - 1] = False  # no pair starts at a word's last token
        at = np.flatnonzero(border)
        keys, where = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True) if len(at) else (np.empty(0, np.int64), at)
        good = self.compatible(keys // self.size, keys % self.size)
        bad = np.zeros(len(words), bool)
        bad[np.searchsorted(ends, at[~good[where]], side="right")] = True
        raw, cuts = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        out = [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        failed = np.flatnonzero(bad).tolist()
        short = [i for i in failed if len(words[i]) <= SIDE_BY_SIDE]
        for i, found in zip(short, self.merge_all([words[i] for i in short]), strict=True):
            out[i] = found
        for i in failed:
            if len(words[i]) > SIDE_BY_SIDE:
                out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        self.words["proposed"] += len(words)
        self.words["merged"] += len(failed)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """The ids of new chunks, put together from their words; only words that aren't known are encoded."""
        split = [self._find(c) for c in chunks]
        new = self.pieces.missing({p for ps in split for p in ps})
        for some in (new[k : k + (1 << 16)] for k in range(0, len(new), 1 << 16)):
            self.pieces.new.update(zip(some, self.encode_words([p.encode() for p in some]), strict=True))
        get = self.pieces.new.__getitem__
        self.chunks.new.update((c, get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))) for c, ps in zip(chunks, split, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; null is empty."""
        split: list[list] = []
        for text in texts:
            parts = self._split_special.split(text or "") if self._split_special else [text or ""]
            split.append([self.special[p] if i % 2 else _CHUNK.findall(p) for i, p in enumerate(parts)])
        seen: set[str] = set()
        for parts in split:
            for p in parts:
                if isinstance(p, list):
                    seen.update(p)
        if new := self.chunks.missing(seen):
            self._learn(new)
        get = self.chunks.new.__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else np.array([p], "<u4").tobytes() for p in parts]) for parts in split]

    @cached_property
    def _token_bytes(self) -> pa.Array:
        return pa.array(self.bytes, pa.large_binary())

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of consecutive runs of ids, ``ends`` (from 0) apart: the tokens' bytes laid end to end and cut."""
        joined = self._token_bytes.take(pa.array(ids))
        starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(ids) + 1]
        cuts = (starts[ends] - starts[0]) if len(ids) else np.zeros(len(ends), np.int64)
        data = joined.buffers()[2]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts + (starts[0] if len(ids) else 0)).tobytes()), data if data is not None else pa.py_buffer(b"")])
        try:
            return whole.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded, the text that the ids give back; one row per row of ``docs``.

    A null or empty text has no ids and decodes to the empty text. Special tokens written in a text are encoded as such. Repeated
    rows are encoded alike; other columns are ignored; an empty table gives no rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(path)
        sole_tables("bpe", tool.clear)
        for batch in batches:
            for piece in by_bytes(batch, 1, 2 << 20):
                encoded = tool.encode_batch(piece.column(1).to_pylist())
                ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), tool.decode_batch(ids, ends)], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(part, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
