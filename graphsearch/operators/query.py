"""Queries: analysis, and expansion over the graph, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsearch.functions import text
from graphsearch.functions.constants import NO_RELATION, OTHER_RELATION, RELATION_WEIGHTS

SEEDS, HOP_1, HOP_2, MOST = 5, 4, 3, 12


def analyse(queries: DataFrame, query: str = "query") -> DataFrame:
    """The columns of queries, and normalized, keywords, topic, year_filter, intent."""
    q = text.normalize(F.coalesce(query, F.lit("")))
    return queries.withColumns({"normalized": q, "keywords": text.keywords(q), "topic": text.topic(q), "year_filter": text.year(q), "intent": text.intent(q)})


def should_expand(n_entities: Column, n_keywords: Column, intent: Column) -> Column:
    return (n_entities >= 1) & (n_entities / F.greatest(n_keywords, F.lit(1)) >= 0.20) & (intent != "temporal_query")


def relation_weight(relation: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, relation), F.lit(OTHER_RELATION))


def expand(seeds: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Of seeds(qid, seed_ord, seed) and scores(qid, entity, score): (qid, entity, tier, score), at most MOST an id.

    Tier 0 are the seeds, 1 the best neighbours of each seed, 2 the best neighbours' neighbours that
    no seed up to then has as a first neighbour.  Neighbours rank by score times the largest weight
    of a relation with the seed, names descending.  An entity has its least tier.
    """
    flat = edges.where("relation <> 'co_occurrence'").select(F.col("subj").alias("u"), F.col("obj").alias("v"), relation_weight(F.col("relation")).alias("w"))
    weights = flat.unionAll(flat.select("v", "u", "w")).where("u <> v").groupBy("u", "v").agg(F.max("w").alias("w"))
    seeds = seeds.where(F.col("seed_ord") < SEEDS)
    value = lambda df: df.join(scores, ["qid", "entity"], "left").withColumn("value", F.coalesce("score", F.lit(0.0)) * F.coalesce("w", F.lit(NO_RELATION)))
    best = Window.partitionBy("qid", "seed_ord").orderBy(F.desc("value"), F.desc("entity"))
    near = seeds.join(weights, F.col("seed") == F.col("u")).select("qid", "seed_ord", "seed", F.col("v").alias("entity"), "w")
    hop_1 = value(near).withColumn("place", F.row_number().over(best)).where(F.col("place") <= HOP_1).select("qid", "seed_ord", "seed", "entity")
    far = near.select("qid", "seed_ord", "seed", F.col("entity").alias("middle")).join(weights, F.col("middle") == F.col("u")).select("qid", "seed_ord", "seed", F.col("v").alias("entity")).distinct().where("entity <> seed")
    far = far.join(near.select("qid", "seed_ord", "entity"), ["qid", "seed_ord", "entity"], "left_anti").join(weights.select(F.col("u").alias("seed"), F.col("v").alias("entity"), "w"), ["seed", "entity"], "left")
    hop_2 = value(far).withColumn("place", F.row_number().over(best)).where(F.col("place") <= HOP_2).select("qid", "seed_ord", "entity")
    earlier = hop_1.select("qid", F.col("seed_ord").alias("by"), "entity")
    hop_2 = hop_2.alias("h").join(earlier.alias("e"), (F.col("h.qid") == F.col("e.qid")) & (F.col("h.entity") == F.col("e.entity")) & (F.col("e.by") <= F.col("h.seed_ord")), "left_anti").select("h.qid", "h.entity")
    hop_2 = hop_2.join(seeds.select("qid", F.col("seed").alias("entity")), ["qid", "entity"], "left_anti")
    tiers = seeds.select("qid", F.col("seed").alias("entity"), F.lit(0).alias("tier")).unionAll(hop_1.select("qid", "entity", F.lit(1))).unionAll(hop_2.select("qid", "entity", F.lit(2)))
    merged = tiers.groupBy("qid", "entity").agg(F.min("tier").alias("tier")).join(scores, ["qid", "entity"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy("tier", F.desc("score"), "entity")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)


def variants(queries: DataFrame, expansion: DataFrame, each: int = 3) -> DataFrame:
    """(qid, variant_ord, variant): the query, and the query with the best entities of tier 1 and of tier 2; equal ones once."""
    best = lambda t: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct((-F.col("score")).alias("s"), "entity")))), 1, each), lambda x: x["entity"])
    tiers = expansion.groupBy("qid").agg(best(1).alias("one"), best(2).alias("two"))
    joined = queries.join(tiers, "qid", "left")
    with_names = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.concat_ws(" ", "query", F.array_join(c, " ")))
    every = F.array_distinct(F.filter(F.array(F.col("query"), with_names("one"), with_names("two")), lambda x: x.isNotNull() & (x != "")))
    return joined.select("qid", F.posexplode(every).alias("variant_ord", "variant"))


def expanded_query(query: Column, entities: Column) -> Column:
    """The query and the lower-cased entities that are no token of it, each once."""
    have = F.split(F.lower(query), r"\s+")
    more = F.filter(F.array_distinct(F.transform(entities, lambda e: F.lower(e))), lambda e: ~F.array_contains(have, e))
    return F.array_join(F.concat(F.array(query), more), " ")


def search_text(keywords: Column, entities: Column) -> Column:
    return F.array_join(F.array_sort(F.array_union(keywords, entities)), " ")
