"""Queries on loading, linking, building graphs and indexes, training data, evaluation, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphsearch import storage
from graphsearch.functions import dates, text, vectors
from graphsearch.operators import chunking, clean, graph, linking, ner, rank, retrieve, search, training
from graphsearch.plans import graphs
from graphsearch.plans.corpus import _CHUNKS, _FIRST, _LINK, _REST, _STOP, _TOK, _WS, _norm, chunks_of
from graphsearch.plans.registry import ORACLES, query, streamed, table
from graphsearch.sources import fetch, tables
from graphsearch.streaming import ingest


@query(f"""WITH a AS (SELECT {_norm(_FIRST)} AS title, {_norm(_REST)} AS content FROM documents)
SELECT CASE WHEN title = '' THEN 'missing_title' WHEN content = '' THEN 'missing_content' ELSE 'loaded' END AS outcome, count(*) AS n FROM a GROUP BY outcome""")
def load_counters(spark, sf):
    return clean.load_stats(clean.build_documents(clean.documents_as_articles(table(spark, sf, "documents")), None))


@query("SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents)")
def documents_of_source(spark, sf):
    d = table(spark, sf, "documents")
    return clean.where_equal(d, "source", d.agg(F.min("source")).first()[0]).select("doc_id", "lang")


@query(f"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '{_WS}', ' ', 'g'))) AS form_md5 FROM documents WHERE text IS NOT NULL")
def nfc_forms(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.composed(F.col("text"))).alias("form_md5"))


_SPANS = r"""r AS (SELECT item_id, regexp_extract_all(text, '{runs}') AS r FROM benchmark),
p AS (SELECT item_id, i, r[i] AS s, coalesce(list_sum(list_transform(r[1:i - 1], lambda x: length(x))), 0) AS upto FROM r, unnest(range(1, len(r) + 1)) AS u(i)),
q AS (SELECT item_id, i, trim(s, chr(9) || chr(10) || chr(13) || ' ') AS t, upto + length(s) - length(ltrim(s, chr(9) || chr(10) || chr(13) || ' ')) AS a, regexp_full_match(s, '[{ends}]') AS mark FROM p)"""


@query(f"WITH {_SPANS.format(runs='[^.!?…]+[.!?…]?|[.!?…]', ends='.!?…')} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS sentence_id, a::INT AS \"start\", (a + length(t))::INT AS \"end\", t AS text FROM q WHERE NOT mark AND length(t) >= 10")
def sentence_spans(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(text.sentence_spans(F.col("text"))).alias("s")).select("item_id", "s.*")


@query(f"WITH {_SPANS.format(runs='[^.!?]+[.!?]?|[.!?]', ends='.!?')}, n AS (SELECT *, (sum((NOT mark)::INT) OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS k FROM q) SELECT item_id, k AS sentence_id, a::INT AS \"start\", (a + length(t))::INT AS \"end\", t AS text FROM n WHERE NOT mark AND t <> ''")
def numbered_spans(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(text.numbered_spans(F.col("text"))).alias("s")).select("item_id", "s.*")


@query(rf"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]?'), lambda s: trim(s, chr(9) || chr(10) || chr(13) || ' ')), lambda s: length(s) > 10)) AS s FROM documents),
e AS (SELECT doc_id, s, regexp_extract_all(s, '{linking.NAME}') AS names FROM s)
SELECT doc_id, md5(s) AS sentence_md5, len(names)::BIGINT AS n FROM e WHERE len(names) > 0 AND len(list_filter(names, lambda x: length(x) < 8)) = 0
""")
def silver_filter(spark, sf):
    """Names of eight characters or more count as sure here, since the corpus has few of two words."""
    s = table(spark, sf, "documents").select("doc_id", F.explode(text.sentence_runs(F.coalesce("text", F.lit("")), ".!?", 11)).alias("sentence"))
    s = s.withColumn("entities", F.regexp_extract_all("sentence", F.lit(linking.NAME), F.lit(0)))
    return training.silver(s, sure=lambda e: F.when(F.length(e) >= 8, 0.88).otherwise(0.82)).select("doc_id", F.md5("sentence").alias("sentence_md5"), F.size("entities").cast("bigint").alias("n"))


@query(f"{graphs._TYPED} SELECT entity, score, type FROM typed WHERE contains(lower(entity), substr((SELECT lower(min(n_name)) FROM nation), 1, 3)) ORDER BY score DESC, entity LIMIT 10")
def entity_search(spark, sf):
    part = table(spark, sf, "nation").agg(F.min("n_name")).first()[0][:3].upper()
    return rank.search_entities(graphs._typed(spark, sf), part, 10)


@query(f"{graphs._TYPED} SELECT * FROM (SELECT entity, type, score, 'of type' AS filter FROM typed WHERE type = 'R1' ORDER BY score DESC, entity LIMIT 3) UNION ALL SELECT * FROM (SELECT entity, type, score, 'but types' AS filter FROM typed WHERE type NOT IN ('R1', 'R2') ORDER BY score DESC, entity LIMIT 4)")
def typed_top_k(spark, sf):
    typed = storage.stored(graphs._typed(spark, sf))
    scores, nodes = typed.select("entity", "score"), typed.select("entity", "type")
    return rank.top_k(scores, nodes, 3, "R1").withColumn("filter", F.lit("of type")).unionByName(rank.top_k(scores, nodes, 4, exclude=("R1", "R2")).withColumn("filter", F.lit("but types"))).select("entity", "type", "score", "filter")


@query(f"{graphs._TYPED}, b AS (SELECT score FROM typed ORDER BY score DESC LIMIT 10) SELECT max(score) AS top_1, round(avg(score), 6) AS mean_of_top FROM b")
def score_distribution(spark, sf):
    return rank.score_distribution(graphs._typed(spark, sf)).select("top_1", F.round("mean_of_top", 6).alias("mean_of_top"))


@query(graphs._GLOBAL + " SELECT entity, round(rank / max(rank) OVER (), 6) AS pagerank FROM ranks")
def pagerank_joined(spark, sf):
    """The form for large graphs, on the same edges as pagerank."""
    return rank.max_normalized(rank.pagerank(graphs.trade_of(spark, sf), small=0), "rank").select("entity", F.round("rank", 6).alias("pagerank"))


@query(graphs._power_sql(graphs._ALL, "SELECT n_nationkey - 3 AS qid, n_name AS entity FROM nation WHERE n_nationkey IN (3, 4)", 24) + ", t AS (SELECT qid, entity FROM ranks QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9) DESC, entity) <= 3), c AS (SELECT entity, count(*) AS n FROM t GROUP BY entity) SELECT max(n) < 2 AS disjoint, sum((n < 2)::INT) > 0 AS differ FROM c")
def personal_ranks_differ(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").where("n_nationkey IN (3, 4)").orderBy("n_nationkey").collect()]
    return rank.separation(graphs.trade_of(spark, sf), *names)


@query(graphs._power_sql(graphs._ALL, "SELECT 1 AS qid, n_name AS entity FROM nation WHERE n_nationkey = 3", 24) + f", {graphs._renamed(graphs._GLOBAL)} SELECT qid::BIGINT AS qid, entity, round(rank, 6) AS rank FROM ranks UNION ALL SELECT 7::BIGINT, entity, round(rank, 6) FROM q_ranks")
def ranks_without_known_seed(spark, sf):
    """A query whose seeds are no nodes has the global ranks."""
    seeds = table(spark, sf, "nation").where("n_nationkey = 3").select(F.lit(1).cast("bigint").alias("qid"), F.col("n_name").alias("entity")).unionAll(spark.createDataFrame([(7, "nowhere")], "qid bigint, entity string"))
    return rank.pagerank(graphs.trade_of(spark, sf), seeds).select("qid", "entity", F.round("rank", 6).alias("rank"))


_SOLD = """l AS (SELECT l_orderkey AS doc_id, 'p' || l_partkey AS entity, l_returnflag AS type, 1 - l_discount AS link_score, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS ord, l_tax, l_suppkey FROM lineitem),
said AS (SELECT doc_id, 's' || l_suppkey AS subj, 'supplies' AS relation, entity AS obj, round(0.5 + l_tax * 4, 4) AS confidence, ord FROM l
 UNION ALL SELECT doc_id, first(entity) OVER (PARTITION BY doc_id ORDER BY ord), 'sold_with', entity, round(0.52 + l_tax * 4, 4), ord FROM l),
ok AS (SELECT * FROM said WHERE confidence >= 0.6 AND subj <> obj)"""


def _build(spark, sf):
    li = table(spark, sf, "lineitem")
    links = graphs.links_of(spark, sf).withColumns({"doc_ord": F.col("doc_id"), "date": F.lit("")})
    item = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), "l_partkey").alias("entity"), F.concat(F.lit("s"), "l_suppkey").alias("supplier"), "l_tax", (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("ord"))
    # Of first entities with equal ord, which the SQL's order leaves open, the least name: rows don't change from run to run.
    head = F.first("entity").over(Window.partitionBy("doc_id").orderBy("ord", "entity"))
    row = lambda df, subj, relation, base: df.select("doc_id", F.col("doc_id").alias("doc_ord"), F.lit("").alias("date"), subj.alias("subj"), F.lit(relation).alias("relation"), F.col("entity").alias("obj"), F.round(base + F.col("l_tax") * 4, 4).alias("confidence"), "ord", F.concat(F.lit("line "), F.col("ord") % 3).alias("sentence"))
    triples = row(item, F.col("supplier"), "supplies", 0.5).unionAll(row(item.withColumn("head", head), F.col("head"), "sold_with", 0.52))
    return graph.build(links, triples)


@query(f"""WITH {_SOLD}, f AS (SELECT entity, type, link_score, doc_id, ord FROM l UNION ALL SELECT entity, 'MISC', 1.0, min(doc_id), -1 FROM (SELECT subj AS entity, doc_id FROM ok UNION ALL SELECT obj, doc_id FROM ok) WHERE entity NOT IN (SELECT entity FROM l) GROUP BY entity),
v AS (SELECT entity, type, count(*) AS n, min((doc_id, ord)) AS f FROM f GROUP BY entity, type)
SELECT f.entity, (SELECT first(type ORDER BY n DESC, f) FROM v WHERE v.entity = f.entity) AS type, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs, round(sum(link_score), 4) / count(*) AS avg_link_score FROM f GROUP BY f.entity""")
def graph_build_nodes(spark, sf):
    return _build(spark, sf)["nodes"].withColumn("avg_link_score", F.round(F.col("avg_link_score") * F.col("frequency"), 4) / F.col("frequency"))


@query(f"""WITH {_SOLD}, pairs AS (SELECT a.doc_id, a.entity AS e1, b.entity AS e2, a.link_score * b.link_score AS score FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.entity <> b.entity WHERE a.link_score >= 0.7 AND b.link_score >= 0.7
 AND (a.doc_id, a.entity, b.entity) NOT IN (SELECT doc_id, subj, obj FROM ok) AND (a.doc_id, b.entity, a.entity) NOT IN (SELECT doc_id, subj, obj FROM ok)),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, e1 DESC, e2 DESC) <= 5),
o AS (SELECT e1 AS subj, e2 AS obj, 'co_occurrence' AS relation, 0.5 AS confidence FROM top UNION ALL SELECT subj, obj, relation, confidence FROM ok)
SELECT subj, obj, relation, round(sum(confidence), 6)::DOUBLE AS weight, count(*) AS occurrences, max(confidence)::DOUBLE AS max_confidence FROM o GROUP BY ALL""")
def graph_build_edges(spark, sf):
    """Edges of a graph built from documents; pairs that a triple names don't co-occur."""
    return graph.edges(_build(spark, sf)["occurrences"]).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_SOLD} SELECT DISTINCT subj, obj, relation, 'line ' || (ord % 3) AS sentence FROM ok")
def edge_sentences(spark, sf):
    return graph.edge_sentences(_build(spark, sf)["occurrences"])


@query(f"WITH {_SOLD}, d AS (SELECT DISTINCT entity, doc_id FROM l) SELECT entity AS query, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc_id) <= 20")
def synthetic_qrels(spark, sf):
    found = _build(spark, sf)["node_documents"].where("entity LIKE 'p%'")
    return graph.synthetic_qrels(found.select("entity").distinct(), found)


@query(f"WITH {_SOLD}, {graphs._TRIPLES}, e AS (SELECT DISTINCT subj, obj, relation FROM triples WHERE confidence >= 0.6) SELECT 'p1' AS entity, (SELECT count(*) FROM l WHERE entity = 'p1') AS frequency, (SELECT count(*) FROM e WHERE obj = 'p1') AS degree, (SELECT count(*) FROM e WHERE obj = 'p1') AS in_degree, 0::BIGINT AS out_degree")
def entity_info(spark, sf):
    edges = graph.edges(graph.accepted_triples(graphs.triples_of(spark, sf)))
    return graph.entity_info(graph.nodes(graphs.links_of(spark, sf)), edges, "p1").select("entity", "frequency", "degree", "in_degree", "out_degree")


@query(ORACLES["graph_edges"])
def index_roundtrip(spark, sf):
    """Edges that were saved as part of an index and loaded again."""
    path = storage.new_path(spark)
    pairs = graph.cooccurrence_pairs(graphs.links_of(spark, sf)).select(F.col("e1").alias("subj"), F.col("e2").alias("obj"), F.lit("co_occurrence").alias("relation"), F.lit(graph.CO_OCCURRENCE).alias("confidence"))
    tables.save_index({"occurrences": pairs.unionAll(graph.accepted_triples(graphs.triples_of(spark, sf)).select("subj", "obj", "relation", "confidence"))}, path)
    return graph.edges(tables.load_index(spark, path, "occurrences")["occurrences"]).withColumn("weight", F.round("weight", 6))


@query()
def link_cascade(spark, sf):
    """Every mention of the corpus, linked; tests hold it against one-by-one linking."""
    m = linking.regex_mentions(table(spark, sf, "documents"))
    return linking.link_mentions(m, linking.seed_aliases(spark)).select("doc_id", "mention_ord", "text", "entity_id", "canonical", F.round("similarity", 4).alias("similarity"), "match_type")


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) BETWEEN 7 AND 12)) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_filter(w, lambda x: length(x) % 4 <> 0)) AS t FROM w), p AS (SELECT doc_id, unnest(list_filter(w, lambda x: length(x) % 4 <> 1)) AS t FROM w),
b AS (SELECT coalesce(g.t, p.t) AS t, (g.t IS NOT NULL AND p.t IS NOT NULL)::INT AS tp, (g.t IS NULL)::INT AS fp, (p.t IS NULL)::INT AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.t = p.t),
k AS (SELECT CASE WHEN length(t) < 9 THEN 'PER' WHEN length(t) < 11 THEN 'LOC' ELSE 'ORG' END AS type, tp, fp, fn FROM b), s AS (SELECT coalesce(type, 'micro') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k GROUP BY ROLLUP (type)),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM s) SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def ner_prf(spark, sf):
    """Entities of each document matched greedily; single words of seven letters or more only match themselves, so SQL can say how."""
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x).between(7, 12))
    entities = lambda left: F.transform(F.filter(w, lambda x: F.length(x) % 4 != left), lambda x: F.struct(F.upper(x).alias("text"), F.when(F.length(x) < 9, "PER").when(F.length(x) < 11, "LOC").otherwise("ORG").alias("type")))
    samples = table(spark, sf, "documents").select(entities(0).alias("gold"), entities(1).alias("predicted"))
    from graphsearch.operators import evaluate

    return evaluate.entity_prf(ner.match_counts(samples)).select("type", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(r"""WITH w AS (SELECT item_id, string_split_regex(trim(text), '\s+') AS w FROM benchmark), k AS (SELECT item_id, w, list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x)))) AS best FROM w)
SELECT item_id, list_transform(w, lambda x, i: CASE WHEN i = best THEN 'B-LOC' ELSE 'O' END) AS labels FROM k""")
def bio_labels(spark, sf):
    words = F.split(F.trim("text"), r"\s+")
    longest = F.array_max(F.transform(words, lambda x: F.length(x)))
    name = F.filter(words, lambda x: F.length(x) == longest)[0]
    return table(spark, sf, "benchmark").select("item_id", ner.bio_column(F.col("text"), F.array(F.struct(name.alias("text"), F.lit("LOC").alias("type")))).alias("labels"))


_TAGS = "CASE WHEN length(x) >= {a} THEN 'B-LOC' WHEN length(x) >= {b} THEN 'B-PER' WHEN length(x) >= 5 THEN 'I-PER' ELSE 'O' END"


def _runs_sql(name: str, a: int, b: int) -> str:
    return f"""{name}g AS (SELECT doc_id, i, {_TAGS.format(a=a, b=b)} AS tag FROM t),
{name}s AS (SELECT *, tag <> 'O' AND (tag LIKE 'B-%' OR coalesce(lag(tag) OVER w, 'O') = 'O' OR substr(lag(tag) OVER w, 3) <> substr(tag, 3)) AS new FROM {name}g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{name}r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM {name}s),
{name} AS (SELECT doc_id, min(i) AS a, max(i) AS z, first(substr(tag, 3) ORDER BY i) AS type FROM {name}r WHERE tag <> 'O' GROUP BY doc_id, run HAVING first(tag ORDER BY i) LIKE 'B-%')"""


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM (SELECT item_id AS doc_id, string_split(text, ' ') AS w FROM benchmark)), {_runs_sql('g', 9, 7)}, {_runs_sql('p', 9, 8)},
b AS (SELECT coalesce(g.type, p.type) AS type, (g.type IS NOT NULL AND p.type IS NOT NULL)::INT AS tp, (g.type IS NULL)::INT AS fp, (p.type IS NULL)::INT AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.a = p.a AND g.z = p.z AND g.type = p.type),
s AS (SELECT coalesce(type, 'micro') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM b GROUP BY ROLLUP (type)), m AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM s)
SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def token_metrics(spark, sf):
    w = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ")).alias("i", "x"))
    tag = lambda a, b: F.when(F.length("x") >= a, "B-LOC").when(F.length("x") >= b, "B-PER").when(F.length("x") >= 5, "I-PER").otherwise("O")
    return ner.token_metrics(w.select("doc_id", "i", tag(9, 7).alias("gold"), tag(9, 8).alias("predicted"))).select("type", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(count(*) / count(DISTINCT doc_id), 6) AS per_doc FROM c")
def chunk_stats(spark, sf):
    return chunking.chunk_stats(chunks_of(spark, sf)).withColumn("per_doc", F.round("per_doc", 6))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, list(doc_id || '_chunk_' || chunk_index ORDER BY chunk_index) AS chunk_ids FROM c GROUP BY doc_id")
def chunks_by_document(spark, sf):
    return chunking.chunks_by_document(chunks_of(spark, sf))


@query("""WITH m AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(ts) FROM events)), timestamp '2024-04-10 12:00:00', interval 1 month)) AS f),
c AS (SELECT unnest(['thoi-su', 'the-gioi']) AS category, unnest([1001005, 1001002]) AS category_id) SELECT category, category_id, f AS "from" FROM m, c""")
def crawl_frontier(spark, sf):
    r = table(spark, sf, "events").agg(F.min("ts").cast("timestamp").alias("a"))
    m = r.select(F.explode(dates.month_ranges(F.col("a"), F.lit("2024-04-10 12:00:00").cast("timestamp"))).alias("m")).select(F.col("m.from").cast("timestamp_ntz").alias("from"))
    return fetch.categories(spark).where("category IN ('thoi-su', 'the-gioi')").crossJoin(m).select("category", "category_id", "from")  # fourteen categories at most


@query(f"SELECT conv_id, turn, list_slice(list_filter(string_split({_LINK.format(x='text')}, ' '), lambda t: NOT list_contains([{_STOP}], t) AND length(t) > 1), 1, 3) AS seeds FROM conversations WHERE role = 'user'")
def seed_fallback(spark, sf):
    none = F.expr("cast(array() as array<string>)")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.seeds_or_keywords(none, text.keywords(F.col("text"))).alias("seeds"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(replace(text, chr(10), ' '), 1, 160) || '...' ELSE replace(text, chr(10), ' ') END AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", retrieve.snippet(F.col("text")).alias("snippet"))


@query("SELECT l_orderkey AS doc_id, list('p' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'R') AS names FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def entity_json_roundtrip(spark, sf):
    """Entities as structs, through JSON and back, those of one type."""
    li = table(spark, sf, "lineitem")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.concat(F.lit("p"), "l_partkey").alias("text"), F.col("l_returnflag").alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("score"), F.lit(0).alias("sentence_id")).alias("e"))
    lists = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("entities"))  # of one order
    back = lists.select("doc_id", ner.entities_from_json(ner.entities_json(F.col("entities"))).alias("entities"))
    return back.select("doc_id", ner.texts_of_type(F.col("entities"), "R").alias("names")).where("size(names) > 0")


_DOC_SQL = rf"""WITH ct AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS slot, ln(1 + count(*)) AS val FROM (SELECT doc_id, unnest({_TOK.format(x="text")}) AS tok FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, slot),
cv AS (SELECT doc_id, slot, val / sqrt(sum(val * val) OVER (PARTITION BY doc_id)) AS val FROM ct),
qt AS (SELECT item_id AS qid, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS slot, ln(1 + count(*)) AS val FROM (SELECT item_id, unnest({_TOK.format(x="text")}) AS tok FROM benchmark) GROUP BY qid, slot),
qv AS (SELECT qid, slot, val / sqrt(sum(val * val) OVER (PARTITION BY qid)) AS val FROM qt),
dots AS (SELECT qid, doc_id, round(sum(cv.val * qv.val), 6) AS score FROM cv JOIN qv USING (slot) GROUP BY ALL)
SELECT qid, doc_id, score AS retrieval_score, lang, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM dots JOIN documents USING (doc_id) QUALIFY place <= 10"""


@query(_DOC_SQL)
def document_search(spark, sf):
    """Document mode: whole documents are encoded, and each hit has its document's columns."""
    d = table(spark, sf, "documents")
    e = d.where("text IS NOT NULL").select("doc_id", vectors.encode(F.col("text")).alias("embedding"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), vectors.encode(F.col("text")).alias("q"))
    hits = retrieve.nearest_chunks(e, q, retrieve.FETCH, "doc_id", digits=6)
    return retrieve.top_hits(retrieve.document_hits(hits, d.select("doc_id", "lang")).drop("place")).select("qid", "doc_id", "retrieval_score", "lang", "place")


@query("SELECT conv_id, turn, regexp_matches(lower(text), '[\\p{L}\\p{N}_]') AS known FROM conversations WHERE text IS NOT NULL")
def query_cache(spark, sf):
    """Each distinct query is encoded once."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    encode = lambda d: d.withColumn("known", vectors.norm(vectors.encode(F.col("text"))) > 0)
    return tables.annotate_once(c, "text", encode).select("conv_id", "turn", "known")


def _index(spark, sf):
    from graphsearch.plans.search import saved_once

    def build(path):
        a = clean.documents_as_articles(table(spark, sf, "documents")).where("length(content) > 0")
        search.build_index(a, path, min_ratio=None)

    return search.load_index(spark, saved_once(spark, sf, "whole-index", build))


@query()
def search_facade(spark, sf):
    """The whole search, with expansion and reranking, of all items over an index of the corpus that is built once."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.search(_index(spark, sf), q, 10, "2024-12-31", "overlap").select("qid", "place", "doc_id", "retrieval_score", "title")


@query()
def search_expanded(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.search_expanded(_index(spark, sf), q, 10, "2024-12-31").select("qid", "place", "doc_id", "retrieval_score", "title")


def _corpus(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 50")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.substring(F.trim("text"), 1, 1000).alias("text"), F.col("lang").alias("category"))


@query()
def training_pairs(spark, sf):
    """Questions with their passages and a random other one."""
    return training.training_pairs(_corpus(spark, sf))


@query()
def training_pairs_hard(spark, sf):
    return training.training_pairs(_corpus(spark, sf), epoch=2, most_articles=200)


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents QUALIFY i < 500) SELECT i::VARCHAR AS doc_id, trim(split_part(text, chr(10), 1)) AS title, md5(substr(trim(text), 1, 1000)) AS text_md5 FROM o WHERE length(trim(text)) > 50 AND trim(split_part(text, chr(10), 1)) <> ''")
def head_corpus(spark, sf):
    """The first 500 articles, as a sample for training."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return training.head_corpus(d, 500).select("doc_id", "title", F.md5("text").alias("text_md5"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append(spark, sf):
    """A stream appended to files with a checkpoint, in two runs of the same query."""
    path, state = storage.new_path(spark), storage.new_path(spark)
    for _ in range(2):
        stream = streamed(spark, sf, "events")
        ingest.append_stream(stream.select("event_id", "user_id", "event_type"), path, state).awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(path)


@query(f"WITH {graphs._TRIPLES} SELECT subj, obj, relation, count(*) AS occurrences, max(confidence)::DOUBLE AS max_confidence FROM triples GROUP BY ALL")
def stream_upsert_edges(spark, sf):
    """Occurrences as a stream; a batch that is written twice counts once."""
    path = storage.new_path(spark)
    stream = streamed(spark, sf, "lineitem")
    said = stream.select(F.concat(F.lit("s"), "l_suppkey").alias("subj"), F.concat(F.lit("p"), "l_partkey").alias("obj"), F.lit("supplies").alias("relation"), F.round(0.5 + F.col("l_tax") * 4, 4).alias("confidence"))

    def twice(batch, number):
        ingest.upsert_occurrences(batch, number, path)
        ingest.upsert_occurrences(batch, number, path)

    said.writeStream.foreachBatch(twice).option("checkpointLocation", storage.new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return ingest.edges_of(spark, path).drop("weight")


@query("SELECT doc_id, sha1(coalesce(text, '')) AS text_key, text IS NULL AS none FROM documents")
def stream_annotations(spark, sf):
    """Annotations as JSON lines, batch by batch; what is left after a first part is annotated later."""
    d = table(spark, sf, "documents")
    path = storage.new_path(spark)
    stream = streamed(spark, sf, "documents")
    ingest.annotate_stream(stream.where("doc_id % 3 = 0"), path, storage.new_path(spark)).awaitTermination()
    done = spark.read.schema("doc_id bigint, text_key string, entities string").json(path).select("doc_id", "text_key", "entities")
    rest = ingest.resume_annotation(d.select("doc_id", "text"), done).select("doc_id", "text_key", F.to_json("entities").alias("entities"))
    return done.unionByName(rest).join(d.select("doc_id", F.col("text").isNull().alias("none")), "doc_id").select("doc_id", "text_key", "none")
