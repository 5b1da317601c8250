"""Quality rules: text statistics and a decision list learned from labelled documents.

Statistics and verdicts are Spark expressions. The list is learned on the driver by sequential covering:
each rule grows, on two thirds of a bounded labelled sample, by the threshold that gains most, is
pruned on the last third, and becomes one branch of an ordered conditional expression.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, crc_mod, one_text_each, unboxed, words_of

#: The most labelled documents that a list is learned from: each is seven numbers.
MAX_LABELLED = 6000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


def _repeat_words(text: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the array column _words: words in a 3-word window that the text holds twice."""
    n = F.size("_words")
    windows = F.when(
        n > 3,
        F.expr("transform(sequence(1, size(_words) - 2), i -> xxhash64(element_at(_words, i), element_at(_words, i + 1), element_at(_words, i + 2)))"),
    ).otherwise(F.array().cast("array<bigint>"))
    text = text.withColumn("_h", windows)
    # equal hashes are told apart by the words themselves
    ordered = F.expr("array_sort(transform(_h, (h, i) -> struct(h, slice(_words, i + 1, 3) as w, i + 1 as i)))")
    text = text.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    twice = F.expr(
        """filter(_s, (x, k) -> (k > 0 and element_at(_s, greatest(k, 1)).h = x.h and element_at(_s, greatest(k, 1)).w = x.w)
           or (k + 1 < size(_s) and element_at(_s, least(k + 2, size(_s))).h = x.h and element_at(_s, least(k + 2, size(_s))).w = x.w))"""
    )
    text = text.withColumn("_t", F.when(F.col("_s").isNotNull(), twice))
    covered = F.expr("size(array_distinct(flatten(transform(_t, x -> array(x.i, x.i + 1, x.i + 2)))))")
    return text.withColumn("n_repeat_words", F.when(F.col("_t").isNull(), 0).otherwise(covered).cast("long")).drop("_h", "_s", "_t")


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """row, the columns of ``docs`` in a struct, and the columns of ``COUNTS``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = boxed(docs, {"text": text_col}).withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_bangs": F.regexp_count(text, F.lit(r"!")).cast("long"),
        }
    )
    return _repeat_words(out).select("row", *COUNTS)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the long columns of ``COUNTS``, which replace columns of those names.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and counts 0 throughout. Lines are split at
    \\n; one without a word is never a duplicate.
    """
    return unboxed(_counted(docs, text_col), docs, COUNTS)


#: The features of a rule: name and its terms, so that driver and Spark divide the same numbers.
FEATURES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("dup_lines_per_word", "n_dup_lines", "n_words"),
    ("repeated_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("bangs_per_word", "n_bangs", "n_words"),
    ("words", "n_words", None),
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        _, top, under = next(f for f in FEATURES if f[0] == self.feature)
        value = F.col(top).cast("double") / (F.greatest(F.col(under), F.lit(1)).cast("double") if under else F.lit(1.0))
        return value > self.threshold if self.above else value <= self.threshold

    def __call__(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def feature_row(counts: dict[str, int]) -> dict[str, float]:
    return {name: float(counts[top]) / (float(max(counts[under], 1)) if under else 1.0) for name, top, under in FEATURES}


def _thresholds(values: Sequence[float], most: int = 64) -> list[float]:
    found = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(found, found[1:], strict=False)]
    return mids[:: max(1, math.ceil(len(mids) / most))]


def _covered(rule: Rule, rows: list[dict[str, float]]) -> list[dict[str, float]]:
    return [r for r in rows if all(c(r) for c in rule)]


def _grow(bad: list[dict], good: list[dict], most: int) -> Rule:
    """Adds the condition of highest information gain until no good document is covered or nothing gains."""
    rule: Rule = ()
    while good and bad and len(rule) < most:
        base, best = math.log2(len(bad) / (len(bad) + len(good))), (1e-9, None)
        for name, _, _ in FEATURES:
            marked = sorted([(r[name], 1) for r in bad] + [(r[name], 0) for r in good])
            cuts, k, b, g = _thresholds([v for v, _ in marked]), 0, 0, 0
            for cut in cuts:
                while k < len(marked) and marked[k][0] <= cut:
                    b, g, k = b + marked[k][1], g + 1 - marked[k][1], k + 1
                for above, p, n in ((False, b, g), (True, len(bad) - b, len(good) - g)):
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, Condition(name, above, cut))
        if best[1] is None:
            break
        rule += (best[1],)
        bad, good = _covered(rule, bad), _covered(rule, good)
    return rule


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> float:
    p, n = len(_covered(rule, bad)), len(_covered(rule, good))
    return (p - n) / (p + n) if p + n else -1.0


def learn_decision_list(rows: Sequence[tuple[dict[str, float], int]], min_worth: float = 0.8, max_rules: int = 16, max_conditions: int = 4) -> list[Rule]:
    """Ordered rules that mark low quality, from (features, label) rows; label 1 is good.

    Every third row is kept for pruning. A rule whose pruned form is worth less than ``min_worth`` there, (p - n) / (p + n), ends the
    list. No rows, or rows of one label only, give an empty list, which keeps every document.
    """
    parts: dict = {(label, prune): [] for label in (0, 1) for prune in (False, True)}
    seen = {0: 0, 1: 0}
    for features, label in rows:
        parts[label, seen[label] % 3 == 2].append(features)
        seen[label] += 1
    bad, bad_prune, good, good_prune = parts[0, False], parts[0, True], parts[1, False], parts[1, True]
    rules: list[Rule] = []
    while bad and good and len(rules) < max_rules:
        rule = _grow(bad, good, max_conditions)
        if not rule:
            break
        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, bad_prune, good_prune))
        if _worth(best, bad_prune, good_prune) < min_worth:
            break
        rules.append(best)
        bad, bad_prune, good, good_prune = ([r for r in part if not all(c(r) for c in best)] for part in (bad, bad_prune, good, good_prune))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """True unless a rule fires, as one ordered conditional expression."""
    out: Column | None = None
    for rule in rules:
        fires = rule[0].column()
        for c in rule[1:]:
            fires = fires & c.column()
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, most: int = MAX_LABELLED) -> list[tuple[dict[str, float], int]]:
    """Features and labels of at most ``most`` documents whose crc32(doc_id as text) mod ``folds`` isn't 0.

    The sample is the labels of smallest id hash, so it has a proven bound and may be broadcast. A document labelled
    both ways counts as 0; null ids and labels are ignored. Of rows with one id the text of least content hash counts. Empty tables give no rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != 0))
    sample = known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = one_text_each(docs, F.broadcast(sample))
    got = text_statistics(joined).select(F.xxhash64("doc_id").alias("_hash"), "_label", *COUNTS).collect()  # ``most`` rows at most
    return [(feature_row(r.asDict()), r["_label"]) for r in sorted(got, key=lambda r: tuple(r))]


def _judged(docs: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    counted = _counted(docs, text_col).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def apply_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed and kept; columns of these names are replaced.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike; an empty table gives an empty table.
    """
    return unboxed(_judged(docs, rules, text_col), docs, (*COUNTS, "base_failed", "kept"))


def keep_documents(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with their own columns and no others."""
    # the observed count also keeps the optimiser from copying the statistics into the filter, once for each use
    judged = _judged(docs, rules, text_col).observe(f"quality rules {uuid.uuid4().hex}", F.count_if("kept").alias("kept"))
    return unboxed(judged.where("kept"), docs, ())
