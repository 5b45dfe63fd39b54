"""Queries on the entity graph: orders are documents, parts their entities; nations trade by revenue."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphsearch.functions.constants import NO_RELATION, OTHER_RELATION, RELATION_WEIGHTS
from graphsearch.operators import graph, rank
from graphsearch.operators import query as queries_
from graphsearch.plans.registry import query, table

_LINKS = "links AS (SELECT l_orderkey AS doc_id, 'p' || l_partkey AS entity, l_returnflag AS type, 1 - l_discount AS link_score, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS ord FROM lineitem)"


def links_of(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), "l_partkey").alias("entity"), F.col("l_returnflag").alias("type"), (1 - F.col("l_discount")).alias("link_score"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("ord"))


@query(f"""
WITH {_LINKS}, v AS (SELECT entity, type, count(*) AS n, min((doc_id, ord)) AS f FROM links GROUP BY entity, type)
SELECT entity, (SELECT first(type ORDER BY n DESC, f) FROM v WHERE v.entity = l.entity) AS type, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs, round(sum(link_score), 4) / count(*) AS avg_link_score FROM links l GROUP BY entity
""")
def graph_nodes(spark, sf):
    return graph.nodes(links_of(spark, sf)).withColumn("avg_link_score", F.round(F.col("avg_link_score") * F.col("frequency"), 4) / F.col("frequency"))


_PAIRS = """pairs AS (SELECT a.doc_id, a.entity AS e1, b.entity AS e2, a.link_score * b.link_score AS score FROM links a JOIN links b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.entity <> b.entity WHERE a.link_score >= 0.7 AND b.link_score >= 0.7),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, e1 DESC, e2 DESC) <= 5)"""


@query(f"WITH {_LINKS}, {_PAIRS} SELECT doc_id, e1, e2, round(score, 9) AS score FROM top")
def cooccurrence_topk(spark, sf):
    return graph.cooccurrence_pairs(links_of(spark, sf)).select("doc_id", "e1", "e2", F.round("score", 9).alias("score"))


_TRIPLES = "triples AS (SELECT l_orderkey AS doc_id, 's' || l_suppkey AS subj, 'p' || l_partkey AS obj, 'supplies' AS relation, round(0.5 + l_tax * 4, 4) AS confidence FROM lineitem)"


def triples_of(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), "l_suppkey").alias("subj"), F.concat(F.lit("p"), "l_partkey").alias("obj"), F.lit("supplies").alias("relation"), F.round(0.5 + F.col("l_tax") * 4, 4).alias("confidence"))


@query(f"""WITH {_LINKS}, {_PAIRS}, {_TRIPLES},
o AS (SELECT e1 AS subj, e2 AS obj, 'co_occurrence' AS relation, 0.5 AS confidence FROM top UNION ALL SELECT subj, obj, relation, confidence FROM triples WHERE confidence >= 0.6 AND subj <> obj)
SELECT subj, obj, relation, round(sum(confidence), 6)::DOUBLE AS weight, count(*) AS occurrences, max(confidence)::DOUBLE AS max_confidence FROM o GROUP BY ALL""")
def graph_edges(spark, sf):
    pairs = graph.cooccurrence_pairs(links_of(spark, sf)).select(F.col("e1").alias("subj"), F.col("e2").alias("obj"), F.lit("co_occurrence").alias("relation"), F.lit(graph.CO_OCCURRENCE).alias("confidence"))
    said = graph.accepted_triples(triples_of(spark, sf)).select("subj", "obj", "relation", "confidence")
    return graph.edges(pairs.unionAll(said)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_TRIPLES}, e AS (SELECT subj, obj, relation, count(*) AS occurrences, max(confidence) AS max_confidence FROM triples WHERE confidence >= 0.6 GROUP BY ALL) SELECT subj, obj, relation, occurrences, max_confidence FROM e WHERE max_confidence >= 0.65")
def triple_filter(spark, sf):
    return graph.prune(graph.edges(graph.accepted_triples(triples_of(spark, sf)))).drop("weight")


_TRADE = """trade AS (SELECT sn.n_name AS subj, cn.n_name AS obj, CASE WHEN sn.n_regionkey = cn.n_regionkey THEN 'cooperates_with' WHEN sn.n_nationkey % 2 = 0 THEN 'supports' ELSE 'trades_with' END AS relation, sum(l_extendedprice * (1 - l_discount)) AS weight, count(*) AS occurrences, max(1 - l_discount) AS max_confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
WHERE sn.n_nationkey <> cn.n_nationkey AND (sn.n_nationkey * 7 + cn.n_nationkey * 3) % 11 < 3 {more} GROUP BY ALL)"""
_ALL, _SINKS = _TRADE.format(more=""), _TRADE.format(more="AND sn.n_regionkey <> 2")


def trade_of(spark, sf, sinks=False):
    n = table(spark, sf, "nation")
    side = lambda p: n.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(p), F.col("n_regionkey").alias(f"{p}_region"))
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), (1 - F.col("l_discount")).alias("c"))
    # Sums by supplier and order first: the graph has few nodes and lineitem many rows.
    j = li.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.groupBy("s_nationkey", "c_nationkey").agg(F.sum("revenue").alias("weight"), F.count("*").alias("occurrences"), F.max("c").alias("max_confidence"))
    j = j.join(side("subj"), F.col("s_nationkey") == F.col("subj_key")).join(side("obj"), F.col("c_nationkey") == F.col("obj_key")).where("subj_key <> obj_key AND (subj_key * 7 + obj_key * 3) % 11 < 3")
    if sinks:
        j = j.where("subj_region <> 2")
    relation = F.when(F.col("subj_region") == F.col("obj_region"), "cooperates_with").when(F.col("subj_key") % 2 == 0, "supports").otherwise("trades_with")
    return j.select("subj", "obj", relation.alias("relation"), "weight", "occurrences", "max_confidence")


@query(f"""WITH {_ALL}, b AS (SELECT subj AS u, obj AS v FROM trade UNION SELECT obj, subj FROM trade), seeds AS (SELECT n_name AS seed FROM nation WHERE n_nationkey < 5),
one AS (SELECT seed, v AS entity FROM seeds JOIN b ON seed = u), two AS (SELECT DISTINCT seed, v AS entity FROM one JOIN b ON entity = u WHERE v <> seed)
SELECT seed, entity, 1 AS hop FROM one UNION ALL SELECT seed, entity, 2 FROM (SELECT * FROM two EXCEPT SELECT * FROM one)""")
def neighbors_2hop(spark, sf):
    return graph.neighbours(trade_of(spark, sf).where(graph.valid_edge()), table(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("seed")))


@query(f"WITH {_ALL} SELECT relation, subj || ' → ' || obj AS direction, occurrences, max_confidence FROM trade WHERE (subj, obj) IN (SELECT subj, obj FROM trade ORDER BY subj, obj LIMIT 1) OR (obj, subj) IN (SELECT subj, obj FROM trade ORDER BY subj, obj LIMIT 1)")
def pair_relations(spark, sf):
    t = trade_of(spark, sf).persist()
    first = t.orderBy("subj", "obj").select("subj", "obj").first()
    return graph.relations_between(t, first["subj"], first["obj"])


_OCC = "occ AS (SELECT 'c' || (o_custkey % 7) AS subj, 'c' || (o_custkey % 5 + 2) AS obj, o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders)"


@query(f"WITH {_OCC} SELECT doc_id, date, subj || ' → ' || obj AS direction FROM occ WHERE ((subj = 'c3' AND obj = 'c4') OR (subj = 'c4' AND obj = 'c3')) AND (date = '' OR (date >= '1994-01-01' AND date <= '2023-06-30'))")
def temporal_relations(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("subj"), F.concat(F.lit("c"), F.col("o_custkey") % 5 + 2).alias("obj"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return graph.temporal_relations(o, "c3", "c4", "1994-01-01", "2023-06-30").select("doc_id", "date", "direction")


@query(f"WITH {_ALL}, x AS (SELECT subj AS entity, 1 AS o, 0 AS i FROM trade UNION ALL SELECT obj, 0, 1 FROM trade) SELECT entity, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY entity")
def degree_stats(spark, sf):
    return graph.degrees(trade_of(spark, sf))


@query(f"WITH {_LINKS}, {_TRIPLES}, n AS (SELECT type, count(DISTINCT entity) AS n FROM links GROUP BY type), e AS (SELECT relation, count(*) AS n FROM (SELECT DISTINCT subj, obj, relation FROM triples WHERE confidence >= 0.6) GROUP BY relation) SELECT 'nodes' AS kind, type AS name, n FROM n UNION ALL SELECT 'nodes', '*', sum(n)::BIGINT FROM n UNION ALL SELECT 'edges', relation, n FROM e UNION ALL SELECT 'edges', '*', sum(n)::BIGINT FROM e UNION ALL SELECT 'totals', 'semantic', sum(n)::BIGINT FROM e UNION ALL SELECT 'top_relations', relation, n FROM e")
def graph_stats(spark, sf):
    nodes = links_of(spark, sf).select("entity", "type").distinct()
    return graph.stats(nodes, graph.edges(graph.accepted_triples(triples_of(spark, sf))))


def _power_sql(trade: str, seeds: str | None, steps: int) -> str:
    base = "SELECT 0 AS qid, entity, 1.0::DOUBLE / n AS p FROM names, size" if seeds is None else f"SELECT q.qid, names.entity, 0.1::DOUBLE / n + CASE WHEN s.entity IS NULL THEN 0 ELSE 0.9 / count(s.entity) OVER (PARTITION BY q.qid) END AS p FROM names CROSS JOIN size CROSS JOIN (SELECT DISTINCT qid FROM seeds) q LEFT JOIN seeds s ON s.qid = q.qid AND s.entity = names.entity"
    parts = [trade, "flat AS (SELECT subj, obj, sum(weight) AS w FROM trade GROUP BY ALL)", "step AS (SELECT subj, obj, w / sum(w) OVER (PARTITION BY subj) AS share FROM flat)", "names AS (SELECT subj AS entity FROM flat UNION SELECT obj FROM flat)", "size AS (SELECT count(*) AS n FROM names)"]
    if seeds:
        parts.append(f"seeds AS ({seeds})")
    parts += [f"base AS MATERIALIZED ({base})", "it0 AS MATERIALIZED (SELECT qid, entity, 1.0::DOUBLE / n AS rank FROM base, size)"]
    for k in range(steps):
        parts.append(f"it{k + 1} AS MATERIALIZED (SELECT b.qid, b.entity, 0.85 * (coalesce(g.got, 0) + coalesce(l.lost, 0) * b.p) + 0.15 * b.p AS rank FROM base b LEFT JOIN (SELECT qid, obj AS entity, sum(rank * share) AS got FROM it{k} JOIN step ON subj = entity GROUP BY ALL) g ON g.qid = b.qid AND g.entity = b.entity LEFT JOIN (SELECT qid, sum(rank) AS lost FROM it{k} WHERE entity NOT IN (SELECT subj FROM step) GROUP BY qid) l ON l.qid = b.qid)")
    # The first step that changes a query's ranks by less than the tolerance a node is its last.
    every = " UNION ALL ".join(f"SELECT {k} AS k, qid, entity, rank FROM it{k}" for k in range(steps + 1))
    parts += [f"every AS ({every})", f"stop AS (SELECT qid, min(k) AS k FROM (SELECT b.qid, b.k, sum(abs(b.rank - a.rank)) AS d FROM every b JOIN every a ON a.k = b.k - 1 AND a.qid = b.qid AND a.entity = b.entity GROUP BY ALL), size WHERE d < n * {1e-6 if seeds is None else 1e-4} GROUP BY qid)", "ranks AS MATERIALIZED (SELECT qid, entity, rank FROM every JOIN stop USING (qid, k))"]
    return "WITH " + ",\n".join(parts)


_GLOBAL, _DANGLING = _power_sql(_ALL, None, 24), _power_sql(_SINKS, None, 24)
_SEED_SQL = "SELECT n_nationkey % 2 AS qid, n_name AS entity FROM nation WHERE n_nationkey IN (2, 3, 6)"
_PPR = _power_sql(_ALL, _SEED_SQL, 24)


def _seeds(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey IN (2, 3, 6)").select((F.col("n_nationkey") % 2).cast("bigint").alias("qid"), F.col("n_name").alias("entity"))


@query(_GLOBAL + " SELECT entity, round(rank / max(rank) OVER (), 6) AS pagerank FROM ranks")
def pagerank(spark, sf):
    return rank.max_normalized(rank.pagerank(trade_of(spark, sf)), "rank").select("entity", F.round("rank", 6).alias("pagerank"))


@query(_DANGLING + " SELECT entity, round(rank, 6) AS pagerank FROM ranks")
def pagerank_dangling(spark, sf):
    return rank.pagerank(trade_of(spark, sf, True)).select("entity", F.round("rank", 6).alias("pagerank"))


@query(_PPR + " SELECT qid::BIGINT AS qid, entity, round(rank, 6) AS ppr FROM ranks")
def personalized_pagerank(spark, sf):
    return rank.pagerank(trade_of(spark, sf), _seeds(spark, sf)).select("qid", "entity", F.round("rank", 6).alias("ppr"))


_IMPORTANCE = """n AS (SELECT entity, count(*) AS f, avg(c) AS q FROM (SELECT subj AS entity, max_confidence AS c FROM trade UNION ALL SELECT obj, max_confidence FROM trade) GROUP BY entity),
m AS (SELECT entity, 0.5 * coalesce(rank / (SELECT max(rank) FROM ranks), 0) + 0.15 * f / max(f) OVER () + 0.05 * q / max(q) OVER () AS s FROM n LEFT JOIN ranks USING (entity)),
imp AS (SELECT entity, s / max(s) OVER () AS score FROM m)"""


def importance_of(spark, sf):
    t = trade_of(spark, sf)
    ends = t.select(F.col("subj").alias("entity"), "max_confidence").unionAll(t.select("obj", "max_confidence"))
    nodes = ends.groupBy("entity").agg(F.count("*").alias("frequency"), F.avg("max_confidence").alias("avg_link_score"))
    return rank.importance(nodes, rank.pagerank(t))


def _typed(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.concat(F.lit("R"), "n_regionkey").alias("type"))
    return importance_of(spark, sf).select("entity", F.round("score", 6).alias("score")).join(n, "entity")


_TYPED = f"{_GLOBAL}, {_IMPORTANCE}, typed AS (SELECT entity, round(score, 6) AS score, 'R' || n_regionkey AS type FROM imp JOIN nation ON n_name = entity)"


@query(f"{_GLOBAL}, {_IMPORTANCE} SELECT entity, round(score, 6) AS score FROM imp")
def importance_blend(spark, sf):
    return importance_of(spark, sf).select("entity", F.round("score", 6).alias("score"))


def _renamed(sql: str) -> str:
    """The parts of a power iteration under other names, after those of another one."""
    for name in ("flat", "step", "names", "size", "base", "every", "stop", "ranks", *(f"it{k}" for k in range(24, -1, -1))):
        sql = re.sub(rf"\b{name}\b", f"q_{name}", sql)
    return sql[sql.index("q_flat AS") :]


@query(f"""{_GLOBAL}, {_IMPORTANCE}, {_renamed(_PPR)}, bl AS (SELECT qid, entity, 0.6 * score + 0.4 * coalesce(rank / (max(rank) OVER (PARTITION BY qid)), 0) AS s FROM imp JOIN q_ranks USING (entity))
SELECT qid::BIGINT AS qid, entity, round(s / max(s) OVER (PARTITION BY qid), 6) AS score FROM bl""")
def query_blend(spark, sf):
    return rank.query_blend(importance_of(spark, sf), rank.pagerank(trade_of(spark, sf), _seeds(spark, sf))).select("qid", "entity", F.round("score", 6).alias("score"))


@query(f"{_TYPED} SELECT entity, score, type FROM typed ORDER BY score DESC, entity LIMIT 7")
def top_entities(spark, sf):
    return rank.top_entities(_typed(spark, sf), 7)


@query(f"{_TYPED} SELECT entity, score, type, row_number() OVER (PARTITION BY type ORDER BY score DESC, entity) AS place FROM typed QUALIFY place <= 2")
def rank_report(spark, sf):
    return rank.rank_report(_typed(spark, sf), 2)


@query(f"{_TYPED}, t AS (SELECT * FROM typed ORDER BY score DESC, entity LIMIT 16), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, entity) AS k FROM t) SELECT entity, score, type FROM r WHERE k <= 3 ORDER BY score DESC, entity LIMIT 8")
def suggest(spark, sf):
    return rank.suggest(_typed(spark, sf))


@query(f"""{_TYPED}, b AS (SELECT entity, score FROM typed ORDER BY score DESC, entity LIMIT 12), i AS (SELECT subj, obj FROM trade WHERE subj IN (SELECT entity FROM b) AND obj IN (SELECT entity FROM b)),
d AS (SELECT entity, count(*) AS degree FROM (SELECT subj AS entity FROM i UNION ALL SELECT obj FROM i) GROUP BY entity) SELECT entity, score, degree, round(greatest(8, least(40, 8 + score * 32)), 4) AS size FROM b JOIN d USING (entity)""")
def graph_display(spark, sf):
    nodes, _ = graph.induced_subgraph(_typed(spark, sf), trade_of(spark, sf), 12, "score")
    return nodes.select("entity", "score", "degree", F.round(F.greatest(F.lit(8), F.least(F.lit(40), 8 + F.col("score") * 32)), 4).alias("size"))


@query(f"""{_TYPED}, b AS (SELECT entity FROM typed ORDER BY score DESC, entity LIMIT 12) SELECT subj, obj, relation, occurrences FROM trade WHERE subj IN (SELECT entity FROM b) AND obj IN (SELECT entity FROM b)""")
def induced_subgraph(spark, sf):
    return graph.induced_subgraph(_typed(spark, sf), trade_of(spark, sf), 12, "score")[1].select("subj", "obj", "relation", "occurrences")


_WEIGHT = "CASE relation " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in RELATION_WEIGHTS.items()) + f" ELSE {OTHER_RELATION} END"


@query(f"""{_GLOBAL}, {_IMPORTANCE}, sc AS (SELECT entity, round(score, 6) AS score FROM imp),
seeds AS (SELECT n_nationkey % 2 AS qid, row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY n_nationkey) - 1 AS seed_ord, n_name AS seed FROM nation WHERE n_nationkey IN (2, 3, 6, 11)),
fw AS (SELECT subj AS u, obj AS v, ({_WEIGHT})::DOUBLE AS w FROM trade), wt AS (SELECT u, v, max(w) AS w FROM (SELECT * FROM fw UNION ALL SELECT v, u, w FROM fw) GROUP BY ALL),
near AS (SELECT qid, seed_ord, seed, v AS entity, w FROM seeds JOIN wt ON seed = u),
h1 AS (SELECT qid, seed_ord, seed, entity FROM near LEFT JOIN sc USING (entity) QUALIFY row_number() OVER (PARTITION BY qid, seed_ord ORDER BY coalesce(score, 0) * w DESC, entity DESC) <= 4),
far AS (SELECT DISTINCT n.qid, n.seed_ord, n.seed, t.v AS entity FROM near n JOIN wt t ON n.entity = t.u WHERE t.v <> n.seed AND (n.qid, n.seed_ord, t.v) NOT IN (SELECT qid, seed_ord, entity FROM near)),
h2 AS (SELECT qid, seed_ord, far.entity FROM far LEFT JOIN sc USING (entity) LEFT JOIN wt ON wt.u = seed AND wt.v = far.entity QUALIFY row_number() OVER (PARTITION BY qid, seed_ord ORDER BY coalesce(score, 0) * coalesce(w, {NO_RELATION}) DESC, far.entity DESC) <= 3),
h2k AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.qid = h2.qid AND h1.entity = h2.entity AND h1.seed_ord <= h2.seed_ord) AND (qid, entity) NOT IN (SELECT qid, seed FROM seeds)),
ti AS (SELECT qid, entity, min(tier) AS tier FROM (SELECT qid, seed AS entity, 0 AS tier FROM seeds UNION ALL SELECT qid, entity, 1 FROM h1 UNION ALL SELECT qid, entity, 2 FROM h2k) GROUP BY ALL)
SELECT qid::BIGINT AS qid, entity, tier, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY tier, coalesce(score, 0) DESC, entity) AS place FROM ti LEFT JOIN sc USING (entity) QUALIFY place <= 12""")
def query_expansion(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "nation").where("n_nationkey IN (2, 3, 6, 11)")
    qid = (F.col("n_nationkey") % 2).cast("bigint")
    seeds = n.select(qid.alias("qid"), (F.row_number().over(Window.partitionBy(qid).orderBy("n_nationkey")) - 1).alias("seed_ord"), F.col("n_name").alias("seed"))
    scores = importance_of(spark, sf).select("entity", F.round("score", 6).alias("score")).persist()
    each = scores.crossJoin(F.broadcast(seeds.select("qid").distinct())).select("qid", "entity", "score")
    return queries_.expand(seeds, trade_of(spark, sf), each).select("qid", "entity", "tier", "score", "place")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.id AS subj, b.id AS obj, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4""")
def similarity_edges(spark, sf):
    return graph.similarity_edges(table(spark, sf, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 6))

