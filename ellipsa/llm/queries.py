"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ann, bpe, chat_format, language_id, line_dedup, packing, quality_classifier, quality_rules, simhash, sql, url_filter
from .common import crc_mod, materialise, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(sql.ORACLE)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), url_filter.thin_addresses(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_decision_list(quality_rules.labelled_rows(docs, read_table(spark, sf_dir, "labels")))
    judged = quality_rules.apply_rules(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], turns.schema))
    chats = chat_format.format_chats(turns)
    found = chats.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.line_dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(*quality_classifier.labelled_bags(docs, read_table(spark, sf_dir, "labels")))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts, without the learned verdict: SQL can express it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.apply_rules(docs, [])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@query
def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: each document whole, no sequence too long, no gap and no overlap."""
    packed = materialise(op9_packing(spark, sf_dir), "packed")
    ends = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))  # a sequence has max_len pieces at most
    places = packed.select((F.col("offset") != F.coalesce(ends, F.lit(0))).alias("off"), (F.col("offset") + F.col("length") > packing.MAX_LEN).alias("over"))
    wrong = places.agg(F.count_if("off").alias("misplaced"), F.count_if("over").alias("too_long"))
    docs = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), (F.max("piece") + 1).alias("pieces"), F.count(F.lit(1)).alias("rows"))
    whole = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("end")) | (F.col("pieces") != F.col("rows"))).alias("torn"))
    both = wrong.unionByName(whole, allowMissingColumns=True)  # a row each
    return both.agg(*[F.sum(c).alias(c) for c in ("misplaced", "too_long", "documents", "torn")])
