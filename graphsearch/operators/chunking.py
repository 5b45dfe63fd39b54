"""Documents as overlapping windows of sentences within a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.functions import text

MOST, LEAST, OVERLAP = 1500, 200, 2


def windows(sentences: list[str], most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[str]:
    """A window takes sentences while they fit (one always does); the next begins overlap sentences before its end, one further at least; short windows are left out."""
    ends = [0, *accumulate(len(s) + 1 for s in sentences)]
    out, at = [], 0
    while at < len(sentences):
        to = at + 1
        while to < len(sentences) and ends[to + 1] - 1 - ends[at] <= most:
            to += 1
        if ends[to] - 1 - ends[at] >= least:
            out.append(" ".join(sentences[at:to]))
        at += max(1, to - at - overlap)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: windows(list(s)) if s is not None else [])


def chunk_documents(documents: DataFrame, id: str = "id", title: str = "title", content: str = "content", strategy: str = "sentence_window") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, chunk_text): the windows with the title before each; a document without any has the first characters of its content."""
    head = F.array(F.substring(content, 1, MOST))
    body = head if strategy == "full" else _windows(text.sentences(F.col(content)))
    cut = documents.select(F.col(id).alias("doc_id"), F.col(title).alias("t"), F.when(F.size(body) > 0, body).otherwise(head).alias("parts"))
    made = cut.select("doc_id", "t", F.posexplode("parts").alias("chunk_index", "part"))
    return made.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.when(F.col("t") != "", F.concat_ws(". ", "t", "part")).otherwise(F.col("part")).alias("chunk_text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(n_docs, n_chunks, per_doc)."""
    return chunks.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks")).withColumn("per_doc", F.col("n_chunks") / F.greatest("n_docs", F.lit(1)))


def chunks_by_document(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ids) in order: the other way round of chunks' doc_id."""
    return chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))  # of one document
