"""documents to packed training sequences: toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Defined results, of each stage on its own input: a null or empty text is clean, is one empty line, has no
near-duplicate and is packed as its end token alone; rows that repeat an identifier are one document to line
dedup and near-dedup, which keep or drop them together, and are scored and packed each; a null identifier
matches nothing and stays; of equal lines or alike documents that of the smallest identifier stays; very long
texts are read whole; columns beside doc_id, text, source and n_chars pass through, whatever their names; an
empty table passes all stages and gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, minhash, packing, queries, toxicity
from quillon.llm._common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), queries.CATEGORIES))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 code points and more stay in the smallest document that holds them; n_chars follows."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8."""
    return minhash.keep_one(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, queries.WORD_TOKENIZER, with_ids=False).drop("ids")


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL can't express the classifier, the components or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
