"""Queries on vectors and retrieval, evaluation, and streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from graphsearch import storage
from graphsearch.functions import dates, text, vectors
from graphsearch.operators import evaluate, retrieve, training
from graphsearch.operators import query as queries_
from graphsearch.plans.corpus import _CHUNKS, _TOK, chunks_of
from graphsearch.plans.registry import query, streamed, table
from graphsearch.sources import tables
from graphsearch.streaming import ingest

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_HITS = f"{_V}, hits AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, list_dot_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 9) DESC, v.vec_id) AS place FROM v, v q WHERE q.vec_id % 50 = 0 QUALIFY place <= 50)"


def _asked(spark, sf):
    """The queries of all searches: every vector whose id is divisible by 50."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))


def _hits(spark, sf):
    return retrieve.nearest_chunks(table(spark, sf, "embeddings"), _asked(spark, sf), 50, "vec_id")


@query(f"WITH {_HITS} SELECT qid, vec_id, round(score, 6) AS score, place FROM hits")
def vector_topk(spark, sf):
    return _hits(spark, sf).select("qid", "vec_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_V}, n AS (SELECT sqrt(list_dot_product(e, e)) AS n FROM v) SELECT round(avg((n >= 1e-6)::INT), 6) AS coverage, round(avg(n) FILTER (n >= 1e-6), 6) AS mean, round(stddev_pop(n) FILTER (n >= 1e-6), 6) AS std, round(min(n) FILTER (n >= 1e-6), 6) AS min, round(max(n) FILTER (n >= 1e-6), 6) AS max FROM n")
def vector_stats(spark, sf):
    n = table(spark, sf, "embeddings").select(vectors.norm(F.col("embedding")).alias("n"))
    real = F.when(F.col("n") >= 1e-6, F.col("n"))
    return n.agg(F.round(F.avg((F.col("n") >= 1e-6).cast("int")), 6).alias("coverage"), F.round(F.avg(real), 6).alias("mean"), F.round(F.stddev_pop(real), 6).alias("std"), F.round(F.min(real), 6).alias("min"), F.round(F.max(real), 6).alias("max"))


@query(f"WITH {_HITS}, intra AS (SELECT avg(score) AS i FROM hits WHERE place = 2), q AS (SELECT vec_id, e FROM v WHERE vec_id % 50 = 0) SELECT round(i, 6) AS intra_top, round((SELECT avg(list_cosine_similarity(a.e, b.e)) FROM q a JOIN q b ON a.vec_id < b.vec_id), 6) AS inter_mean FROM intra")
def intra_inter_sim(spark, sf):
    intra = _hits(spark, sf).where("place = 2").agg(F.avg("score").alias("i"))
    # The mean over all pairs of unit vectors, from their sum alone: |sum|^2 is the number of vectors and twice all pairs' cosines.
    parts = _asked(spark, sf).select("qid", F.posexplode(vectors.normalized(F.col("q"))).alias("i", "x"))
    sums = parts.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n"))
    mean = (F.col("s2") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return intra.crossJoin(sums).select(F.round("i", 6).alias("intra_top"), F.round(mean, 6).alias("inter_mean"))


@query(f"WITH {_HITS} SELECT qid, vec_id, round(score, 4) AS sim FROM hits WHERE vec_id <> qid AND round(score, 4) >= 0.3 AND place <= 6")
def similar_items(spark, sf):
    return _hits(spark, sf).where("vec_id <> qid AND place <= 6").select("qid", "vec_id", F.round("score", 4).alias("sim")).where("sim >= 0.3")


@query(f"WITH {_V}, c AS (SELECT a.vec_id, b.vec_id AS linked, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON b.vec_id < a.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4) SELECT vec_id, first(linked ORDER BY s DESC, linked) AS linked, round(max(s), 6) AS sim FROM c GROUP BY vec_id")
def embedding_link(spark, sf):
    from graphsearch.operators import graph

    e = graph.similarity_edges(table(spark, sf, "embeddings"), 0.4)
    return e.groupBy(F.col("obj").alias("vec_id")).agg(F.min_by("subj", F.struct(-F.col("cosine"), "subj")).alias("linked"), F.round(F.max("cosine"), 6).alias("sim"))


@query()
def ivf_topk(spark, sf):
    """An inverted file of k-means cells; tests hold it against the exact search, which it is when all cells are probed."""
    e = table(spark, sf, "embeddings")
    cells = retrieve.cell_count(e.count(), exact_upto=0)
    return retrieve.ivf_nearest(e, _asked(spark, sf), retrieve.kmeans(e, cells, "vec_id"), 50, retrieve.PROBES, "vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "place")


@query("""
WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_id, o_totalprice / 1e6 AS score, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders),
b AS (SELECT o_custkey AS doc_id, count(*) AS n_chunks0 FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n FROM h),
g AS (SELECT doc_id, list_sum(list_slice(list_reverse_sort(list(score)), 1, 3)) / least(3, count(*)) AS boost FROM h GROUP BY doc_id)
SELECT doc_id, first(chunk_id ORDER BY n) AS chunk_id, round(max(score), 6) AS vector_score, least(2, count(*)) AS n_chunks, round(max(score) * (1 + 0.15 * any_value(boost)), 6) AS retrieval_score FROM r JOIN g USING (doc_id) GROUP BY doc_id
""")
def chunk_to_doc_candidates(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") / 1e6).alias("score"))
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3)
    boosts = o.groupBy("doc_id").agg(best.alias("b")).select(F.lit(0).alias("qid"), "doc_id", (F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b")).alias("graph_boost"))
    hits = o.select(F.lit(0).alias("qid"), "chunk_id", "score", F.col("chunk_id").alias("place"))
    d = retrieve.document_candidates(hits, o.select("chunk_id", "doc_id"), boosts)
    return d.select("doc_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "n_chunks", F.round("retrieval_score", 6).alias("retrieval_score"))


@query(f"WITH {_HITS}, s AS (SELECT qid // 150 AS qid, (qid // 50) % 3 AS variant_ord, vec_id AS doc_id, round(score, 6) AS score FROM hits WHERE place <= 20) SELECT qid, doc_id, max(score) AS score, first(variant_ord ORDER BY score DESC, variant_ord) AS variant_ord FROM s GROUP BY ALL")
def multi_query_merge(spark, sf):
    """Three queries in a row count as variants of one; each has its 20 best."""
    h = _hits(spark, sf).where("place <= 20")
    return retrieve.merge_variants(h.select(F.floor(F.col("qid") / 150).alias("qid"), F.floor(F.col("qid") / 50) % 3, F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score")).toDF("qid", "variant_ord", "doc_id", "score"))


@query("SELECT o_orderkey, round(1 - 0.08 * (1 - CASE WHEN o_orderkey % 20 = 0 THEN 0.85 ELSE exp(-greatest(date_diff('day', o_orderdate::DATE, DATE '2024-12-31'), 0) / 365.0) END), 6) AS score FROM orders")
def date_decay(spark, sf):
    s = F.when(F.col("o_orderkey") % 20 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(dates.decayed(F.lit(1.0), dates.to_day(s), F.lit("2024-12-31").cast("date")), 6).alias("score"))


def _bm25_sql(k: int) -> str:
    return rf"""t AS (SELECT doc_id, {_TOK.format(x="coalesce(text, '')")} AS t FROM documents), z AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
qt AS (SELECT qid, term, count(*) AS q_tf FROM (SELECT item_id AS qid, unnest({_TOK.format(x="text")}) AS term FROM benchmark) GROUP BY ALL),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)) * q_tf) AS score FROM po JOIN df USING (term) JOIN qt USING (term), z GROUP BY ALL),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM sc WHERE score > 0 QUALIFY place <= {k})"""


def _bm25(spark, sf, k):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return training.bm25(table(spark, sf, "documents"), q, k)


@query(f"WITH {_bm25_sql(20)} SELECT qid, doc_id, round(score, 6) AS score, place FROM bm")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 20).select("qid", "doc_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_bm25_sql(20)}, l AS (SELECT qid, doc_id, place FROM bm WHERE place > 1) SELECT qid, doc_id, place FROM l QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 3")
def hard_negatives(spark, sf):
    h = _bm25(spark, sf, 20).persist()
    return training.hard_negatives(h.select("qid", "doc_id", "place"), h.where("place = 1").select("qid", "doc_id")).select("qid", "doc_id", "place")


@query(rf"WITH {_bm25_sql(20)} SELECT bm.qid, bm.doc_id, round(len(list_filter(list_distinct({_TOK.format(x='b.text')}), lambda w: list_contains(t.t, w))) / len(list_distinct({_TOK.format(x='b.text')})), 6) AS overlap FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN t USING (doc_id)")
def rerank_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), text.tokens(F.col("text")).alias("q"))
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return _bm25(spark, sf, 20).join(b, "qid").join(d, "doc_id").select("qid", "doc_id", F.round(retrieve.rerank_overlap(F.col("q"), F.col("t")), 6).alias("overlap"))


@query(f"""WITH {_HITS}, rel AS (SELECT q.vec_id AS qid, d.vec_id AS id FROM v q JOIN v d ON q.label = d.label WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id), n AS (SELECT qid, count(*) AS r FROM rel GROUP BY qid),
h AS (SELECT hits.qid, place, (rel.id IS NOT NULL)::INT AS hit FROM hits LEFT JOIN rel ON rel.qid = hits.qid AND rel.id = hits.vec_id WHERE place <= 20), s AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY place) AS seen FROM h), ks AS (SELECT unnest([5, 10, 20]) AS k),
m AS (SELECT k, qid, any_value(r) AS r, sum(hit) FILTER (place <= k) AS f, min(place) FILTER (hit = 1 AND place <= k) AS p1, sum(hit / log2(place + 1)) FILTER (place <= k) AS dcg, sum(hit * seen / place) AS ap FROM s JOIN n USING (qid), ks GROUP BY ALL)
SELECT k, round(avg(f / r), 6) AS recall, round(avg(f / k), 6) AS precision, round(avg(coalesce(1 / p1, 0)), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(k, r) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(ap / r), 6) AS map FROM m GROUP BY k""")
def ranking_metrics(spark, sf):
    e = table(spark, sf, "embeddings")
    rel = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("qid <> id").select("qid", "id")
    m = evaluate.ranking_metrics(_hits(spark, sf).where("place <= 20").select("qid", F.col("vec_id").alias("id"), "place"), rel)
    return m.select("k", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "map")))


@query(f"WITH {_HITS} SELECT qid, count(*) AS n, bool_and(isfinite(score)) AS finite, count(*) = 50 AS full FROM hits GROUP BY qid")
def smoke_check(spark, sf):
    return _hits(spark, sf).groupBy("qid").agg(F.count("*").alias("n"), F.bool_and(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"), (F.count("*") == 50).alias("full"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS m FROM events GROUP BY event_type) SELECT event_type, round(m, 6) AS mean, v[floor(len(v) * 0.5)::INT + 1] AS median, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[-1] AS max FROM s")
def percentile_index(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("WITH r AS (SELECT c_acctbal + 1000 AS v, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer) SELECT round(sum((2 * i - n - 1) * v) / (any_value(n) * sum(v)), 6) AS gini FROM r")
def gini(spark, sf):
    return evaluate.gini(table(spark, sf, "customer").select((F.col("c_acctbal") + 1000).alias("v")), "v").select(F.round("gini", 6).alias("gini"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    w = ingest.windowed_counts(table(spark, sf, "events"), "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + interval 1 day <= (SELECT max(ts) - interval 1 hour FROM events) GROUP BY ALL")
def stream_dedup_window(spark, sf):
    """The batch's events as a stream: each event once, counted in windows that the watermark has closed."""
    folder = storage.new_path(spark)
    stream = streamed(spark, sf, "events")
    counted = ingest.windowed_counts(ingest.first_seen_stream(stream, "event_id", delay="1 hour"), "event_type", delay=None)
    q = counted.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_SEARCH_SQL = rf"""WITH RECURSIVE {_CHUNKS}, ch AS (SELECT doc_id, chunk_index, CASE WHEN title <> '' THEN title || '. ' || part ELSE part END AS x FROM c),
ct AS (SELECT doc_id, chunk_index, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS slot, ln(1 + count(*)) AS val FROM (SELECT doc_id, chunk_index, unnest({_TOK.format(x="x")}) AS tok FROM ch) GROUP BY doc_id, chunk_index, slot),
cv AS (SELECT doc_id, chunk_index, slot, val / sqrt(sum(val * val) OVER (PARTITION BY doc_id, chunk_index)) AS val FROM ct),
qt AS (SELECT item_id AS qid, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS slot, ln(1 + count(*)) AS val FROM (SELECT item_id, unnest({_TOK.format(x="text")}) AS tok FROM benchmark) GROUP BY qid, slot),
qv AS (SELECT qid, slot, val / sqrt(sum(val * val) OVER (PARTITION BY qid)) AS val FROM qt),
dots AS (SELECT qid, doc_id, chunk_index, round(sum(cv.val * qv.val), 6) AS score FROM cv JOIN qv USING (slot) GROUP BY ALL),
fe AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id || '_chunk_' || lpad(chunk_index::VARCHAR, 6, '0')) AS place FROM dots QUALIFY place <= 50),
be AS (SELECT qid, doc_id, max(score) AS score FROM fe GROUP BY ALL)
SELECT qid, doc_id, score AS retrieval_score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM be QUALIFY place <= 10"""


_saved: set[str] = set()


def saved_once(spark, sf: str, name: str, build, again: bool = False) -> str:
    """Where build(path) has saved something of a folder's tables; it is called once for an application, or again."""
    path = f"{storage.folder(spark)}/{name}-{hashlib.sha1(sf.encode()).hexdigest()}"
    if again or path not in _saved:
        build(path)
        _saved.add(path)
    return path


def _vectors(spark, sf, again: bool = False):
    """The index of the corpus's chunks: encoded and saved once, then read."""
    c = chunks_of(spark, sf)
    e = c.select("doc_id", F.concat("doc_id", F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("chunk_id"), vectors.encode(F.col("chunk_text")).alias("embedding"))
    path = saved_once(spark, sf, "vectors", lambda path: tables.save_index({"vectors": e}, path), again)
    return tables.load_index(spark, path, "vectors")["vectors"]


@query("SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, true AS unit FROM c".join([f"WITH RECURSIVE {_CHUNKS} ", ""]))
def index_build(spark, sf):
    """Chunks, encoded and saved."""
    v = _vectors(spark, sf, again=True)
    return v.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.bool_and((F.abs(vectors.norm(F.col("embedding")) - 1) < 1e-9) | (vectors.norm(F.col("embedding")) == 0)).alias("unit"))


@query(_SEARCH_SQL)
def search_flagship(spark, sf):
    """Chunks and queries by the same encoder, the 50 best chunks, their documents, and the 10 best of these, for all items."""
    e = _vectors(spark, sf)
    q = queries_.analyse(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")))
    hits = retrieve.nearest_chunks(e, q.select("qid", vectors.encode(F.col("query")).alias("q")), 50, digits=6)
    docs = retrieve.document_candidates(hits, hits.select("chunk_id", F.regexp_extract("chunk_id", "^(.*)_chunk_", 1).cast("bigint").alias("doc_id")).distinct())
    return retrieve.top_hits(docs).select("qid", "doc_id", "retrieval_score", "place")
