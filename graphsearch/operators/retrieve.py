"""Retrieval: nearest chunks, documents from chunks, graph boost, reranking, decay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphsearch.functions import dates, vectors

FETCH, BOOST, CHUNKS_PER_DOC = 50, 0.15, 2
#: Queries that are compared with all chunks in one pass; more go pass by pass.
QUERIES_AT_ONCE = 1024


def _rows(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _best_products(ids: pa.Array, vectors: np.ndarray, id: str, vector: str, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.round(_rows(batch.column(vector)) @ vectors.T, digits)
            n = len(batch)
            least = np.partition(s, n - k, axis=0)[n - k] if n > k else np.full(len(ids), -np.inf)
            row, q = np.nonzero(s >= least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(id).take(pa.array(row)), pa.array(s[row, q])], ["qid", id, "score"])

    return run


def nearest_chunks(chunks: DataFrame, queries: DataFrame, k: int = FETCH, id: str = "chunk_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """Of queries(qid, q): (qid, id, score, place) of the k largest inner products, rounded to so many digits; ties go to the smaller id.

    A block of queries, of a fixed number, goes to every chunk where it lies, as one matrix product a
    batch; a batch passes on its k best of each query.  Null vectors take no part.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERIES_AT_ONCE))
    base = chunks.select(F.col(id), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    fields = [queries.schema["qid"], base.schema[id], T.StructField("score", T.DoubleType())]
    found = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r["qid"], r["q"]) for r in some.select("qid", F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL").collect()]
        if not rows:
            continue
        names = pa.array([q.asDict() if isinstance(q, Row) else q for q, _ in rows], to_arrow_type(fields[0].dataType))
        part = base.mapInArrow(_best_products(names, np.array([v for _, v in rows]), id, vector, k, digits), T.StructType(fields))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return base.select(F.lit(None).cast(fields[0].dataType).alias("qid"), id, F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), id)
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _nearest_cells(centroids: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :m]


def kmeans(vectors: DataFrame, cells: int, id: str = "chunk_id", vector: str = "embedding", steps: int = 8) -> np.ndarray:
    """Centroids of at most so many cells (256 by rule), by steps of assignment to the largest inner product and normalised means.

    A step is one pass whose partial sums have a row for each cell and component; an empty cell keeps
    its centroid.  It begins with the vectors of least hash of their id.
    """
    base = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    now = np.array([r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(cells).collect()])
    for _ in range(steps if len(now) else 0):

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                if len(batch):
                    x = _rows(batch.column("v"))
                    np.add.at(total, _nearest_cells(now, x, 1)[:, 0], x)
            cell, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[cell, place])], ["cell", "place", "total"])

        new = np.zeros_like(now)
        for r in base.mapInArrow(sums, "cell bigint, place bigint, total double").groupBy("cell", "place").agg(F.sum("total").alias("total")).collect():
            new[r["cell"], r["place"]] = r["total"]
        norm = np.sqrt((new * new).sum(axis=1))
        now = np.where(norm[:, None] > 0, new / np.where(norm > 0, norm, 1)[:, None], now)
    return now


def ivf_nearest(chunks: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = FETCH, probes: int = 32, id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """As nearest_chunks, in the cells of each query's nearest centroids only: an equality join on the cell.

    A cell is found by one matrix product a batch, so that no vector is copied before the join.
    """

    def place(m: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cells = _nearest_cells(centroids, _rows(batch.column("v")), m)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

        return run

    put = lambda df, m: df.mapInArrow(place(m), T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]))
    placed = put(chunks.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL"), 1).select("id", "v", F.explode("cells").alias("cell"))
    asked = put(queries.select("qid", F.col("q").cast("array<double>").alias("v")).where("v IS NOT NULL"), probes).select("qid", F.col("v").alias("q"), F.explode("cells").alias("cell"))
    scored = placed.join(asked, "cell").select("qid", "id", F.round(vectors.dot(F.col("v"), F.col("q")), 9).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).withColumnRenamed("id", id)


def cell_count(n: int, exact_upto: int = 50_000) -> int:
    """Cells of an index over n vectors; none (an exact scan) up to 50,000."""
    return 0 if n <= exact_upto else min(256, int(n**0.5))


#: Cells that a query is compared with.
PROBES = 32


def document_candidates(hits: DataFrame, chunks: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Of hits(qid, chunk_id, score, place): a document's best chunk, (qid, doc_id, chunk_id, vector_score, graph_boost, retrieval_score, n_chunks)."""
    joined = hits.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    best = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "place")
    kept = joined.withColumn("n", F.row_number().over(best)).where(F.col("n") <= CHUNKS_PER_DOC)
    docs = kept.groupBy("qid", "doc_id").agg(F.min_by("chunk_id", "n").alias("chunk_id"), F.max("score").alias("vector_score"), F.count("*").alias("n_chunks"))
    if boosts is None:
        docs = docs.withColumn("graph_boost", F.lit(0.0))
    else:
        docs = docs.join(boosts, ["qid", "doc_id"], "left").withColumn("graph_boost", F.coalesce("graph_boost", F.lit(0.0)))
    return docs.withColumn("retrieval_score", F.col("vector_score") * (1 + BOOST * F.col("graph_boost")))


def graph_boosts(candidates: DataFrame, links: DataFrame, scores: DataFrame, top: int = 3) -> DataFrame:
    """Of candidates(qid, doc_id), links(doc_id, entity) and scores(qid, entity, score): (qid, doc_id, graph_boost), the mean of a document's best entity scores, absent scores as 0."""
    each = candidates.select("qid", "doc_id").distinct().join(links.select("doc_id", "entity").distinct(), "doc_id").join(scores, ["qid", "entity"], "left")
    best = F.slice(F.sort_array(F.collect_list(F.coalesce("score", F.lit(0.0))), asc=False), 1, top)
    return each.groupBy("qid", "doc_id").agg(best.alias("best")).select("qid", "doc_id", (F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")).alias("graph_boost"))


def document_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Document mode: of hits(qid, doc_id, score, place) on whole documents, those that documents has, with its columns; one a document."""
    best = hits.groupBy("qid", "doc_id").agg(F.max("score").alias("vector_score"), F.min("place").alias("place"))
    return best.join(documents, "doc_id").withColumn("graph_boost", F.lit(0.0)).withColumn("retrieval_score", F.col("vector_score"))


def merge_variants(hits: DataFrame) -> DataFrame:
    """Of hits(qid, variant_ord, doc_id, score): a document's best score, of the first variant that has it."""
    return hits.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.min_by("variant_ord", F.struct(-F.col("score"), "variant_ord")).alias("variant_ord"))


def rerank_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """The part of a query's distinct tokens that a text has: the stand-in for a cross-encoder."""
    q = F.array_distinct(query_tokens)
    return F.size(F.array_intersect(q, text_tokens)) / F.greatest(F.size(q), F.lit(1))


def with_decay(hits: DataFrame, day: Column, as_of: Column, score: str = "retrieval_score") -> DataFrame:
    return hits.withColumn("date_decay_weight", dates.decay(day, as_of)).withColumn(score, dates.decayed(F.col(score), day, as_of))


def top_hits(hits: DataFrame, k: int = 10, score: str = "retrieval_score") -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def snippet(chunk_text: Column, most: int = 160) -> Column:
    line = F.replace(chunk_text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)
