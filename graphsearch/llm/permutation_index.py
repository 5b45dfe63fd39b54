"""Nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Vectors are dealt into shards of a bounded
size; a shard posts each vector in the inverted file of every pivot of its prefix, with the pivot's
place.  A query adds up the footrule distance over the files of its own prefix (a pivot that one of the
two lacks counts as the place after the prefix), and the nearest part of each shard is ranked again by
exact inner products; the shards' best are merged.

Queries are a table too.  They are dealt into blocks, and each block meets each shard as one bounded
group, so neither side is broadcast or held whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsearch.llm.tables import read, stored

#: Pivots (the distinct vectors with the least hash of their id), and pivots of a prefix.
PIVOTS, PREFIX = 64, 24
#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 4096, 2048
#: Part of each shard that is ranked again, and at least so many for each neighbour that is asked for.
RERANKED, LEAST_RERANKED = 0.5, 15


def clean_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector of double) of vectors that can take part.

    Null ids, null and empty vectors, vectors with null or non-finite components, zero vectors, and
    vectors of another length than most (the shorter, of equally many) take none.  Of rows that
    repeat an id the least vector stays: an id names one vector, and is what queries are kept apart by.
    """
    v = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    size = v.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    v = v.where(F.size("vector") == (size["n"] if size else 0))
    return v.groupBy("id").agg(F.min("vector").alias("vector"))


class Shard:
    """Inverted files of a shard: for each pivot the vectors that have it in their prefix, and its place there."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.prefix = min(prefix, len(pivots))
        order = _orders(vectors, pivots, self.prefix)
        n = len(vectors)
        by = np.argsort(order.ravel(), kind="stable")
        self.member = (by // self.prefix).astype(np.int32)
        self.place = (by % self.prefix).astype(np.int32)
        self.begin = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        self.n = n
        #: Distance to a query that shares no pivot, without the query's part.
        self.alone = self.prefix * (self.prefix + 1) // 2

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distances of all vectors to a query with this prefix of pivots."""
        total = np.full(self.n, 2 * self.alone, np.int32)
        for place, pivot in enumerate(order):
            a, z = self.begin[pivot], self.begin[pivot + 1]
            theirs = self.place[a:z]
            total[self.member[a:z]] += np.abs(theirs - place) - (self.prefix - theirs) - (self.prefix - place)
        return total


def _orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    near = vectors @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each added up from the first component to the last: equal vectors have equal ones."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += vectors[:, k] * query[k]
    return total


def _search(pivots: np.ndarray, prefix: int, k: int, part: float):
    def run(rows: pa.Table) -> pa.Table:
        is_query = np.asarray(rows.column("query").combine_chunks())
        ids = np.asarray(rows.column("id").combine_chunks(), dtype=np.int64)
        flat = rows.column("vector").combine_chunks()
        vectors = np.asarray(flat.flatten()).reshape(len(ids), -1)
        own, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        out_q, out_v, out_s = [], [], []
        if len(own) and len(asked):
            order = np.argsort(ids[own], kind="stable")  # ties go to the smaller id
            own = own[order]
            base, base_ids = vectors[own], ids[own]
            shard = Shard(base, pivots, prefix)
            most = min(len(own), max(k + 1, LEAST_RERANKED * k, int(np.ceil(part * len(own)))))
            for q, places in zip(asked, _orders(vectors[asked], pivots, shard.prefix), strict=True):
                distance = shard.footrule(places)
                near = np.sort(np.argsort(distance, kind="stable")[:most])
                near = near[base_ids[near] != ids[q]]
                rough = base[near] @ vectors[q]
                if len(near) > k:  # a product's last bits depend on its row, so those about as good as the k-th are summed up again
                    near = near[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
                score = exact(base[near], vectors[q])
                best = np.argsort(-score, kind="stable")[:k]
                out_q.append(np.full(len(best), ids[q]))
                out_v.append(base_ids[near[best]])
                out_s.append(score[best])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(cat(out_q, np.int64), pa.int64()), "vec_id": pa.array(cat(out_v, np.int64), pa.int64()), "score": pa.array(cat(out_s, np.float64), pa.float64())})

    return run


def _pivots(base: DataFrame, most: int) -> DataFrame:
    """At most so many distinct vectors, those with the least hash of an id; copies would fill prefixes with ties."""
    return base.groupBy("vector").agg(F.min(F.struct(F.xxhash64("id").alias("hash"), "id")).alias("least")).orderBy("least").limit(most).select("vector")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each of queries the k vectors with the largest inner products that the index finds, never the query's own id.

    See clean_vectors for what takes part; queries of another length than the vectors find nothing.
    Fewer vectors than k give as many rows as there are; no vector gives none.  Ties go to the
    smaller vec_id.
    """
    base = stored(clean_vectors(vectors, id, vector))
    asked = stored(clean_vectors(queries, id, vector))
    drawn = _pivots(base, pivots).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not drawn:
        return base.sparkSession.createDataFrame([], empty)
    at = np.array([r["vector"] for r in drawn])
    asked = asked.where(F.size("vector") == at.shape[1])
    n, m = base.count(), asked.count()
    shards, blocks = -(-n // SHARD), max(1, -(-m // BLOCK))
    dealt = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    tiles = base.select("id", "vector", F.lit(False).alias("query"), dealt(shards, 1).alias("shard"), each(blocks).alias("block")).unionByName(
        asked.select("id", "vector", F.lit(True).alias("query"), each(shards).alias("shard"), dealt(blocks, 2).alias("block"))
    )
    found = tiles.groupBy("shard", "block").applyInArrow(_search(at, prefix, k, reranked), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows from each shard
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def brute_force(rows: list[tuple[int, list[float]]], queries: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    out = {}
    for q, x in queries:
        scored = sorted((-float(np.dot(np.asarray(x, float), np.asarray(y, float))), i) for i, y in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out
