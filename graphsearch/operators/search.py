"""One call for an index and one for a search.

An index is a set of tables, written and read by sources.tables: documents, chunks, vectors, links
(entities of documents), nodes, edges, scores and aliases.  A search takes a table of queries: they are
analysed, expanded over the graph, answered by one or several variants each, boosted, reranked and
decayed, all queries in one plan.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsearch import storage
from graphsearch.functions import dates, text, vectors
from graphsearch.operators import chunking, clean, graph, linking, ner, query, rank, retrieve
from graphsearch.sources import tables

#: Plug-ins by name: a text column to a vector, and (query, text) columns to a score.
ENCODERS: dict[str, Callable[[Column], Column]] = {"hashed": vectors.encode}
RERANKERS: dict[str, Callable[[Column, Column], Column] | None] = {"none": None, "overlap": lambda q, t: retrieve.rerank_overlap(text.tokens(q), text.tokens(t))}
SIMILAR = 0.75


def register_encoder(name: str, encode: Callable[[Column], Column]) -> None:
    ENCODERS[name] = encode


def register_reranker(name: str, score: Callable[[Column, Column], Column] | None) -> None:
    RERANKERS[name] = score


def build_index(articles: DataFrame, path: str, annotator: str = "capitals", encoder: str = "hashed", triples: DataFrame | None = None, min_ratio: float | None = 0.05, strategy: str = "sentence_window") -> dict[str, DataFrame]:
    """Builds all tables of articles (ord, url, title, content, date, category, source), writes them, and reads them again."""
    spark = articles.sparkSession
    # Written first: the filter and both sides of first_seen would each clean the texts again.
    built = clean.first_seen(storage.stored(clean.build_documents(articles, min_ratio)).where("reason IS NULL"), "url", "ord").drop("reason")
    tables.save_index({"documents": built}, path)
    documents = tables.load_index(spark, path, "documents")["documents"]
    found = ner.mentions(ner.annotate(documents, annotator, "full_text"), "id")
    linked = linking.link_mentions(found.join(documents.select(F.col("id").alias("doc_id"), F.col("ord").alias("doc_ord")), "doc_id"), order=("doc_ord", "mention_ord"))
    merged = linking.merge_links(linked.select("doc_id", "entity_id", "canonical", "type", "text", "match_type", F.col("similarity").alias("score"), F.col("mention_ord").alias("ord")))
    names = linked.groupBy("entity_id").agg(F.min("canonical").alias("entity"))
    links = merged.join(names, "entity_id").join(documents.select(F.col("id").alias("doc_id"), "date", F.col("ord").alias("doc_ord")), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("entity_id", "type")
    tables.save_index({"links": links.withColumn("ord", F.row_number().over(order).cast("bigint")), "aliases": linking.aliases_of(linked)}, path)
    links = tables.load_index(spark, path, "links")["links"]
    g = graph.build(links, triples)
    chunks = chunking.chunk_documents(documents, strategy=strategy)
    tables.save_index({"nodes": g["nodes"], "occurrences": g["occurrences"], "chunks": chunks}, path)
    chunks = tables.load_index(spark, path, "chunks")["chunks"].where("chunk_text <> ''")
    encode = ENCODERS[encoder]
    tables.save_index({"vectors": chunks.select("chunk_id", "doc_id", encode(F.col("chunk_text")).alias("embedding"))}, path)
    nodes = tables.load_index(spark, path, "nodes")["nodes"]
    occurrences = tables.load_index(spark, path, "occurrences")["occurrences"]
    edges = graph.edges(occurrences)
    similar = graph.similar_entities(nodes, edges, SIMILAR, encode)
    tables.save_index({"edges": edges.unionByName(similar)}, path)
    edges = tables.load_index(spark, path, "edges")["edges"]
    tables.save_index({"scores": rank.importance(nodes, rank.pagerank(rank.semantic(edges), nodes=nodes))}, path)
    tables.save_state(spark, path, encoder=encoder, annotator=annotator)
    return tables.load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; vectors that are missing are encoded again from the chunks."""
    index = tables.load_index(spark, path, *(n for n in tables.INDEX if n != "vectors"))
    try:
        index |= tables.load_index(spark, path, "vectors")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        encode = ENCODERS[tables.load_state(spark, path)["encoder"]]
        tables.save_index({"vectors": index["chunks"].where("chunk_text <> ''").select("chunk_id", "doc_id", encode(F.col("chunk_text")).alias("embedding"))}, path)
        index |= tables.load_index(spark, path, "vectors")
    return index


def analyse(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """query.analyse, with entities: the known names that a query's mentions have."""
    q = query.analyse(queries.select("qid", "query"))
    found = q.select("qid", F.posexplode(F.array_distinct(F.regexp_extract_all("normalized", F.lit(linking.NAME), F.lit(0)))).alias("seed_ord", "text"))
    linked = linking.exact_link(found, index["aliases"]).where("entity_id IS NOT NULL")
    names = index["aliases"].groupBy("entity_id").agg(F.min_by("canonical", "ord").alias("entity"))
    entities = linked.join(names, "entity_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seed_ord", "entity"))).alias("e"))  # of one query's text
    return q.join(entities, "qid", "left").withColumn("entities", F.array_distinct(F.transform(F.coalesce("e", F.expr("cast(array() as array<struct<seed_ord:int,entity:string>>)")), lambda x: x["entity"]))).drop("e")


def expand(index: dict[str, DataFrame], analysed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants(qid, variant_ord, variant), seeds(qid, seed_ord, seed), scores(qid, entity, score)) of analysed queries.

    A query without entities has its first three keywords for seeds, and one without entities that
    the gate also turns away is not expanded.
    """
    seeds_of = F.when(F.size("entities") > 0, F.slice("entities", 1, query.SEEDS)).otherwise(F.slice("keywords", 1, 3))
    gate = query.should_expand(F.size("entities"), F.size("keywords"), F.col("intent"))
    q = storage.stored(analysed.withColumn("seeds", seeds_of).withColumn("open", gate | (F.size("entities") > 0)))
    seeds = storage.stored(q.where("open").select("qid", F.posexplode("seeds").alias("seed_ord", "seed")))
    scores = storage.stored(rank.query_time_scores(index["nodes"], index["edges"], seeds.select("qid", F.col("seed").alias("entity"))))
    expansion = query.expand(seeds, index["edges"], scores)
    return storage.stored(query.variants(q.select("qid", F.col("normalized").alias("query")), expansion)), seeds, scores


def retrieve_variants(index: dict[str, DataFrame], variants: DataFrame, scores: DataFrame, k: int, encoder: str = "hashed", documents_mode: bool = False) -> DataFrame:
    """(qid, doc_id, chunk_id, retrieval_score): each document's best over the variants, the earliest of equals; of several variants, each passes on its 2k best."""
    encode = ENCODERS[encoder]
    one = variants.select(F.struct("qid", "variant_ord").alias("qid"), encode(F.col("variant")).alias("q"))
    hits = retrieve.nearest_chunks(index["vectors"].select("chunk_id", "embedding"), one, retrieve.FETCH)
    found = storage.stored(hits.select(F.col("qid.qid").alias("qid"), F.col("qid.variant_ord").alias("variant_ord"), "chunk_id", "score", "place").join(index["vectors"].select("chunk_id", "doc_id"), "chunk_id"))
    boosts = retrieve.graph_boosts(found, index["links"], scores)
    pairs = found.withColumn("q", F.struct("qid", "variant_ord")).select(F.col("q").alias("qid"), "chunk_id", "score", "place")
    wide = boosts.join(variants.select("qid", "variant_ord"), "qid").select(F.struct("qid", "variant_ord").alias("qid"), "doc_id", "graph_boost")
    docs = retrieve.document_candidates(pairs, found.select("chunk_id", "doc_id").distinct(), None if documents_mode else wide)
    n = variants.groupBy("qid").agg(F.count("*").alias("n_variants"))
    flat = docs.select("qid.qid", "qid.variant_ord", "doc_id", "chunk_id", "retrieval_score").join(n, "qid")
    order = Window.partitionBy("qid", "variant_ord").orderBy(F.desc("retrieval_score"), "doc_id")
    kept = flat.withColumn("place", F.row_number().over(order)).where((F.col("n_variants") == 1) | (F.col("place") <= 2 * k))
    best = kept.groupBy("qid", "doc_id").agg(F.min(F.struct((-F.col("retrieval_score")).alias("s"), "variant_ord", "chunk_id")).alias("b"))
    return best.select("qid", "doc_id", "b.chunk_id", (-F.col("b.s")).alias("retrieval_score"))


def finish(index: dict[str, DataFrame], queries: DataFrame, candidates: DataFrame, k: int, as_of: str, reranker: str = "none") -> DataFrame:
    """The k best of candidates after reranking (of the 50 best, whose scores it replaces) and decay, with their documents; a document that is missing has nulls."""
    order = Window.partitionBy("qid").orderBy(F.desc("retrieval_score"), "doc_id")
    pool = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= retrieve.FETCH).drop("place")
    pool = pool.join(index["chunks"].select("chunk_id", "chunk_text"), "chunk_id")
    score = RERANKERS[reranker]
    if score is not None:
        pool = pool.join(queries.select("qid", "query"), "qid").withColumn("retrieval_score", score(F.col("query"), F.col("chunk_text")).cast("double")).drop("query")
    pool = pool.join(index["documents"].select(F.col("id").alias("doc_id"), "title", "url", "date", "category"), "doc_id", "left")
    decayed = retrieve.with_decay(pool, dates.to_day(F.coalesce("date", F.lit(""))), F.lit(as_of).cast("date"))
    return retrieve.top_hits(decayed.withColumn("retrieval_score", F.round("retrieval_score", 9)), k)


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, as_of: str = "1970-01-01", reranker: str = "none", encoder: str = "hashed", expansion: bool = True) -> DataFrame:
    """Of queries(qid, query): (qid, place, doc_id, retrieval_score, chunk_id, chunk_text, title, url, date, category)."""
    q = analyse(index, queries)
    if expansion:
        variants, _, scores = expand(index, q)
    else:
        variants = q.select("qid", F.lit(0).alias("variant_ord"), F.col("normalized").alias("variant"))
        scores = index["scores"].limit(0).select(F.lit(0).cast("bigint").alias("qid"), "entity", "score")
    found = retrieve_variants(index, variants, scores, k, encoder)
    hits = finish(index, q.select("qid", F.col("normalized").alias("query")), found, k, as_of, reranker)
    return hits.select("qid", "place", "doc_id", "retrieval_score", "chunk_id", "chunk_text", "title", "url", "date", "category")


def search_expanded(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, as_of: str = "1970-01-01", reranker: str = "none", encoder: str = "hashed") -> DataFrame:
    """search by the one expanded string of each query instead of its variants."""
    q = analyse(index, queries)
    variants, seeds, scores = expand(index, q)
    named = query.expand(seeds, index["edges"], scores).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"]).alias("names"))  # at most MOST a query
    one = q.join(named, "qid", "left").select("qid", F.lit(0).alias("variant_ord"), query.expanded_query(F.col("normalized"), F.coalesce("names", F.expr("cast(array() as array<string>)"))).alias("variant"))
    found = retrieve_variants(index, one, scores, k, encoder)
    return finish(index, q.select("qid", F.col("normalized").alias("query")), found, k, as_of, reranker)


def timed(index: dict[str, DataFrame], text_: str, k: int = 10, **options) -> tuple[list[dict], float]:
    """The results of one query, and the seconds that it took."""
    began = time.time()
    spark = index["documents"].sparkSession
    rows = search(index, spark.createDataFrame([(0, text_)], "qid bigint, query string"), k, **options).orderBy("place").collect()
    return [r.asDict() for r in rows], time.time() - began


def render(hits: list[dict]) -> str:
    """Results as text: rank and title, url, date · category · score, and a snippet of 160 characters."""
    out = []
    for h in hits:
        line = (h["chunk_text"] or "").replace("\n", " ")
        out.append(f"{h['place']}. {h['title'] or ''}\n   {h['url'] or ''}\n   {h['date'] or ''} · {h['category'] or ''} · {h['retrieval_score']:.4f}\n   {line[:160] + ('...' if len(line) > 160 else '')}")
    return "\n".join(out)
