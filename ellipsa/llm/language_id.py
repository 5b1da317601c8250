"""Language identification with spans of mixed-language text.

A word's script, by ranges of code points, narrows the languages to those that were seen in it; hashed character n-grams
give the word a score for each; Viterbi over the words with a penalty for switching labels spans. The text's
language is the one that labels most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, bucket_below, by_bytes, crc_mod, sole_tables, unboxed
from .ngrams import hashed

#: First code points of script ranges, in ascending order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0F00, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
#: Labelled documents of each language that the model is fitted on, about.
PER_LANGUAGE = 1500
#: Languages that a model may have: it holds 2 ** BITS numbers of each.
MAX_LANGUAGES = 200
BITS, LOW, HIGH = 16, 1, 4
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
#: N-grams overlap, so their sum is scaled; the cost of a change of language, on that scale.
SCALE, SWITCH = 0.35, 9.0
MAX_WORDS = 300_000
_STARTS = np.array([s for s, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # bucket x language: log probabilities
    scripts: np.ndarray  # script x language: whether the language is written in it


@lru_cache(maxsize=1 << 16)
def _letters(word: str) -> tuple[int, int]:
    """How many letters a word has, and the script of most of them; of equally many the first in the list."""
    points = [ord(c) for c in word if c.isalpha()]
    if not points:
        return 0, -1
    return len(points), int(np.bincount(_SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]).argmax())


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def fit(docs: DataFrame, label_col: str = "lang", folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the non-null labels of ``docs`` (doc_id, text, label) whose crc32(doc_id as text) mod ``folds`` isn't ``held``.

    About ``per_language`` documents of each language are read, chosen by id hash: all of them where there are fewer. Only counts
    by language and bucket reach the driver. More than ``MAX_LANGUAGES`` labels are an error. An empty table gives a model without languages.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    sizes = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values of {label_col}")
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(label_col) == name, min(1.0, per_language / n)).otherwise(share)
    chosen = rows.where(bucket_below(F.col("doc_id"), share)).select(F.col(label_col).alias("lang"), "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1):
                for lang in set(some.column(0).to_pylist()):
                    counts = np.zeros((1 << BITS) + len(NAMES))
                    mine = [t for x, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if x == lang]
                    words, times = np.unique(np.array([w for t in mine for w in _words(t)] or [""], dtype=object), return_counts=True)
                    ids, at = hashed(words.tolist(), LOW, HIGH, BITS)
                    counts[: 1 << BITS] = np.bincount(ids, times[at], 1 << BITS)
                    for w, n in zip(words.tolist(), times.tolist(), strict=True):
                        letters, script = _letters(w)
                        if letters:
                            counts[(1 << BITS) + script] += letters * n
                    on = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on), pa.array(counts[on])], ["lang", "bucket", "n"])

    counted = chosen.mapInArrow(part, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(sizes))
    n = np.zeros(((1 << BITS) + len(NAMES), len(languages)))
    where = {x: i for i, x in enumerate(languages)}
    n[counted["bucket"].to_numpy(), [where[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    grams, letters = n[: 1 << BITS], n[1 << BITS :]
    smooth = grams + 0.5
    weights = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    return Model(languages, weights - weights.mean(axis=1, keepdims=True) if languages else weights, letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0, keepdims=True), 1))


class Labeller:
    """Labels the words of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def _learn(self, words: list[str]) -> None:
        first, n = len(self.row), len(words)
        while len(self.letters) < first + n:
            self.scores, self.letters = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        for k in range(0, n, 1 << 14):
            some = words[k : k + (1 << 14)]
            ids, at = hashed(some, LOW, HIGH, BITS)
            score = np.stack([np.bincount(at, self.model.weights[ids, j], len(some)) for j in range(len(self.model.languages))], axis=1) * SCALE
            letters, script = (np.array(x) for x in zip(*map(_letters, some), strict=True))
            may = self.model.scripts[script] & (script >= 0)[:, None]
            may[~may.any(axis=1)] = True  # a script that no language was seen in narrows nothing
            score = np.where(may, score, score.min(axis=1, keepdims=True) - 1000.0)
            score[letters == 0] = 0
            self.scores[first + k : first + k + len(some)], self.letters[first + k : first + k + len(some)] = score, letters
        self.row.update(zip(words, range(first, first + n), strict=True))

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the language number and the letters of each word."""
        split = [_words(t) for t in texts]
        seen = {w for words in split for w in words}
        if new := seen - self.row.keys():
            if len(self.row) + len(new) > MAX_WORDS:
                self._clear()
                new = seen
            self._learn(list(new))
        get = self.row.__getitem__
        rows = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
        return self._viterbi(rows), [self.letters[r] for r in rows]

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each text; all texts go in step, longest first, so a step is a prefix of them."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        sizes = np.array([len(rows[i]) for i in order], np.int64)
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts with a word at each step
        first = np.concatenate([[0], np.cumsum(active)])
        text = np.repeat(np.arange(len(order)), sizes)
        place = first[np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text]] + text  # of each word, ordered by step
        by_step = np.empty(len(text), np.int64)
        by_step[place] = np.concatenate([rows[i] for i in order]) if len(text) else text
        scores, n_languages = self.scores[by_step], len(self.model.languages)
        value, best, stays = np.zeros((len(rows), n_languages)), np.zeros(len(text), np.int16), np.zeros((len(text), n_languages), bool)
        for t in range(steps):
            n, now = active[t], slice(first[t], first[t + 1])
            if t:
                v = value[:n]
                best[now] = top = v.argmax(axis=1)
                least = v[np.arange(n), top][:, None] - SWITCH
                stays[now] = v >= least
                np.maximum(v, least, out=v)
            value[:n] += scores[now]
        path, state = np.zeros(len(text), np.int16), value.argmax(axis=1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            n, now = active[t], slice(first[t], first[t + 1])
            path[now] = mine = state[:n].copy()
            if t:
                state[:n] = np.where(stays[now][np.arange(n), mine], mine, best[now])
        ends = np.cumsum(sizes)
        found = path[place]
        out: list = [None] * len(rows)
        for k, i in enumerate(order):
            out[i] = found[ends[k] - sizes[k] : ends[k]]
        return out


_known: dict[int, Labeller] = {}


def _judge(sent, key: int):
    kind = "struct<lang_pred:string,score:double,spans:array<struct<first:int,words:int,lang:string>>>"

    @F.arrow_udf(kind)
    def judge(text: pa.Array) -> pa.Array:
        sole_tables("languages", _known.clear)
        if key not in _known:
            _known.clear()
            _known[key] = Labeller(Model(*sent.value))
        tool, out = _known[key], []
        names = tool.model.languages
        for some in by_bytes(pa.RecordBatch.from_arrays([text], ["text"]), 0):
            texts = some.column(0).to_pylist()
            paths, letters = tool.label(texts) if names else ([], [])
            for path, n in zip(paths, letters, strict=True):
                total = np.bincount(path, n, len(names)) if len(path) else np.zeros(1)
                if not total.sum():
                    out.append({"lang_pred": "und", "score": 0.0, "spans": []})
                    continue
                cuts = np.flatnonzero(np.diff(path)) + 1
                begins, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(path)]
                spans = [{"first": a, "words": b - a, "lang": names[path[a]]} for a, b in zip(begins, ends, strict=True)]
                out.append({"lang_pred": names[int(total.argmax())], "score": float(total.max() / total.sum()), "spans": spans})
            if not names:
                out += [{"lang_pred": "und", "score": 0.0, "spans": []}] * len(texts)
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])))]))

    return judge


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and spans; columns of these names are replaced.

    spans: first word (from 0), number of words and language of each stretch; words are the parts between white space. score: the share of the
    text's letters that lang_pred labels. Texts that are null or have no letter are ``und`` with score 0 and no spans, and so are all if no language
    was learned. Of languages with equally many letters the first in text order wins. Repeated rows are judged alike; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.scripts))  # 2 ** BITS numbers per language
    judge = _judge(sent, hash((model.languages, float(np.abs(model.weights).sum()))))
    judged = boxed(docs, {"text": text_col}).withColumn("found", judge("text"))
    return unboxed(judged.select("row", "found.*"), docs, ("lang_pred", "score", "spans"))
