"""A training corpus from documents: five stages, each written as Parquet before the next reads it.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but
the last return the columns of documents.  The stages fit models and count words, so SQL gives no
oracle; tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphsearch.llm import decontaminate, merges, minhash, substring, toxicity
from graphsearch.llm.tables import read, stored

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of documents, calls toxic go."""
    labels = read(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8, the one with the least id stays."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that an earlier document has are cut; documents without any stay as they are."""
    return substring.cut_repeats(docs, length="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, lossless."""
    return merges.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
