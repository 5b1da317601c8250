"""The corpus pipeline: each stage works on all that the stage before kept.

quality rules, quality classifier, line dedup, SimHash near-dedup, best-fit packing. Each stage is written as
Parquet to the shared folder and read again, so a lost executor costs tasks of one stage only; what it wrote on the way is deleted once it has ended.

All stages but the last return the rows they keep with the columns of ``docs`` and their values untouched, whatever the columns' names; only line
dedup changes texts (and n_chars, if there is one). Null and empty texts have no words, so the rules reject them; stages that get such rows all the same keep them
by the operators' own rules. Rows that repeat an id, or have none, are judged each by its text. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ellipsa.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from ellipsa.llm.common import materialise, read_table
from ellipsa.session import scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep; equal rows are judged alike."""
    rules = quality_rules.learn_decision_list(quality_rules.labelled_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.keep_documents(docs, rules)


def stage_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; equal rows are judged alike.

    It is trained on labelled rows of the whole table, as the rules leave few that are labelled bad.
    """
    known = quality_classifier.labelled_bags(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_classifier.keep_documents(docs, quality_classifier.train(*known))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that ten documents or more share; n_chars is counted anew. Every row stays; a null text becomes the empty one."""
    out = line_dedup.line_dedup(docs, counted=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of least id, of equal ids that of least content hash. Different texts of one id, or of none, each stay."""
    return simhash.keep_one(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; other columns go. Rows that repeat an id are packed each for itself."""
    packed = packing.pack_documents(docs, TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", stage_rules),
    ("quality classifier", stage_classifier),
    ("line dedup", stage_lines),
    ("simhash near-dedup", stage_near_duplicates),
    ("best-fit packing", stage_packing),
]
#: A learned classifier and SimHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            after = stage(spark, docs, sf_dir)
            docs = materialise(after, name.replace(" ", "-"), kept=True)
    return docs
