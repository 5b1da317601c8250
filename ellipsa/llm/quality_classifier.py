"""A supervised text classifier of averaged subword embeddings.

A document is the mean of the vectors of its hashed words and character n-grams, and of one that stands for a word that is the same as the word
before it, whatever the word; a softmax layer over the mean gives the score. Vectors
and layer are trained together by stochastic gradient descent in numpy on a bounded labelled sample. With two
classes the trained model is one number per bucket, so a word's part of the score is computed once and
remembered, and scoring a text is one sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, by_bytes, crc_mod, materialise, one_text_each, release, unboxed, using_tables
from .ngrams import hashed

#: The most labelled documents that the model is trained on, and the most distinct buckets of theirs together: 8 bytes each.
MAX_LABELLED, MAX_BUCKETS = 2000, 16 << 20
#: The buckets that the driver fetches at once, about; the bags of one document come together.
FETCHED = 1 << 20
BITS, LOW, HIGH = 16, 2, 4
#: The bucket of a repeated word.
AGAIN = 1 << BITS
DIM, EPOCHS, RATE = 8, 6, 0.8
#: Steps at least, so that a small sample is gone through more often.
STEPS = 6000
#: Words that a worker remembers; at the bound the table starts anew.
MAX_WORDS = 300_000


@dataclass(frozen=True)
class Model:
    """``weights``: what each bucket adds to the difference of the two outputs before averaging."""

    weights: np.ndarray
    bias: float


def _again(words: list[str]) -> int:
    """Words that are the same as the one before."""
    return sum(map(eq, words, islice(words, 1, None)))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often it has each."""
    listed = (text or "").split()
    if not listed:
        return np.empty(0, np.int64), np.empty(0)
    words, times = np.unique(np.array(listed, dtype=object), return_counts=True)
    ids, at = hashed(words.tolist(), LOW, HIGH, BITS)
    counts = np.bincount(ids, times[at], AGAIN + 1)
    counts[AGAIN] = _again(listed)
    found = np.flatnonzero(counts)
    return found, counts[found]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """One pass of gradient steps per epoch in a shuffled order, with a rate that falls to zero. No rows give a model that scores 0.5."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (AGAIN + 1, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    rows = [(i, c, y) for (i, c), y in zip(bags, labels, strict=True) if len(i)]
    epochs = max(epochs, -(-STEPS // max(1, len(rows)))) if rows else 0
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, counts, y = rows[k]
            share = counts.astype(np.float64)  # made for each step, as all of them at once are larger than the bags
            share /= share.sum()
            mean = share @ vectors[ids]
            out = mean @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y] -= 1.0
            lr = rate * (1 - step / steps)
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * p
            vectors[ids] -= (lr * len(ids) ** 0.5) * np.outer(share, back)
            step += 1
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def labelled_bags(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, most: int = MAX_LABELLED, buckets: int = MAX_BUCKETS) -> tuple[list, list]:
    """Bags and labels of at most ``most`` documents whose crc32(doc_id as text) mod ``folds`` isn't 0: the labels of least id hash.

    They come in order of that hash, and end before their distinct buckets are more than ``buckets`` in all, so what the driver holds is bounded: 8 bytes
    for each, fetched ``FETCHED`` at a time, as the driver's JVM has each part several times over while it passes through.
    A document labelled both ways counts as 0; null ids and labels are ignored. Of rows with one id the text of least content hash counts.
    Whole texts are used; null and empty ones give empty bags. Other columns are ignored. Empty tables give no rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != 0))
    sample = known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = one_text_each(docs, F.broadcast(sample))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1):
                found = [bag(t) for t in some.column(1).to_pylist()]
                ids, counts = pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), ids, counts], ["doc_id", "label", "ids", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    bags = materialise(rows.mapInArrow(part, f"doc_id {kind}, label int, ids array<int>, counts array<float>").withColumn("h", F.xxhash64("doc_id")), "bags")
    sizes = bags.select("h", "doc_id", F.size("ids").alias("n")).orderBy("h", "doc_id").collect()  # ``most`` rows at most
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), buckets, side="right")) if sizes else 0
    pairs: list = []
    given: list = []
    for some in _parts(sizes[:fits]):
        part_of = bags.where(F.col("h").between(some[0]["h"], some[-1]["h"])).orderBy("h", "doc_id").limit(len(some)).toArrow()
        pairs += [(i.values.to_numpy(), c.values.to_numpy()) for i, c in zip(part_of["ids"], part_of["counts"], strict=True)]
        given += part_of["label"].to_pylist()
    return pairs, given


def _parts(sizes: list) -> Iterator[list]:
    """Runs of rows (h, n) of about ``FETCHED`` in all, cut where h changes."""
    run: list = []
    total = 0
    for r in sizes:
        if run and total + r["n"] > FETCHED and r["h"] != run[-1]["h"]:
            yield run
            run, total = [], 0
        run.append(r)
        total += r["n"]
    if run:
        yield run


_known: dict[int, tuple[Model, dict[str, complex]]] = {}


def _scores(model: Model, texts: list[str | None], known: dict[str, complex]) -> np.ndarray:
    """A word's sum of weights and its number of features are the two parts of one complex number."""
    split = [(t or "").split() for t in texts]
    seen = {w for words in split for w in words}
    if new := seen - known.keys():
        if len(known) + len(new) > MAX_WORDS:
            known.clear()
            new = seen
        listed = list(new)
        for k in range(0, len(listed), 1 << 13):
            some = listed[k : k + (1 << 13)]
            ids, at = hashed(some, LOW, HIGH, BITS)
            values = np.bincount(at, model.weights[ids], len(some)) + 1j * np.bincount(at, minlength=len(some))
            known.update(zip(some, values.tolist(), strict=True))
    get = known.__getitem__
    again = complex(model.weights[AGAIN], 1)
    sums = np.array([sum(map(get, words)) + again * _again(words) for words in split], complex)
    x = model.bias + sums.real / np.maximum(sums.imag, 1)
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _scored(docs: DataFrame, model: Model, text_col: str, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2 ** BITS + 1 numbers
    key = hash((float(model.weights.sum()), model.bias))

    @F.arrow_udf("double")
    def judge(text: pa.Array) -> pa.Array:
        with using_tables("classifier", _known.clear):
            if key not in _known:
                _known.clear()
                _known[key] = (Model(*sent.value), {})
            batch = pa.RecordBatch.from_arrays([text], ["text"])
            found = np.concatenate([_scores(_known[key][0], x.column(0).to_pylist(), _known[key][1]) for x in by_bytes(batch, 0, 2 << 20)] or [np.empty(0)])
        release()
        return pa.array(found)

    return boxed(docs, {"text": text_col}).withColumn("score", judge("text")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted; columns of these names are replaced.

    Words are the text's parts between white space. A null or empty text has the score of the bias alone. Repeated rows score alike; an empty table gives an
    empty table.
    """
    return unboxed(_scored(docs, model, text_col, threshold), docs, ("score", "predicted"))


def keep_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with their own columns and no others."""
    return unboxed(_scored(docs, model, text_col, threshold).where("predicted = 1"), docs, ())
