"""Documents to packed sequences: five stages, each written as Parquet and read again.

Bad documents go, one document of each group of near copies stays, long repeated word
sequences are cut out of the texts, documents that leak the benchmark go, and what is
left is tokenised and packed.  Every stage but the last returns the columns of
``documents``.

Defined cases: a null or empty text is judged as an empty document by the classifier, is no near copy,
and packs as its end id alone; texts of any length are read whole; of near copies, and so of repeated rows, the one
with the smallest id stays; equal ids with unlike texts are documents of their own; an empty table gives
no rows; extra columns, whatever their names, go through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, decontaminate, jaccard, packing, quality, substrings
from spindrift.llm.queries import QUALITY_THRESHOLD, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier accepts."""
    labels = common.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, quality.QualityConfig(), ~quality.held_out("doc_id", 5, 0))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles are similar."""
    return jaccard.one_of_each(docs, jaccard.JaccardConfig())


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows."""
    return substrings.without_repeats(docs, substrings.SubstringConfig())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"), decontaminate.TilingConfig())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    out = packing.pack(docs, packing.PackingConfig(tokenizer_path()))
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.workspace(spark) as keep:  # a stage's own tables go with it
            after = keep(stage(spark, docs, sf_dir), name)
        common.drop_stored(docs)
        docs = after
    return docs
