"""Measures of rankings, of extracted entities, and of distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20)


def ranking_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Of hits(qid, id, place) and qrels(qid, id): (k, recall, precision, mrr, ndcg, map), means over the queries of qrels; map is over all hits at every k."""
    relevant = qrels.select("qid", "id").distinct()
    totals = relevant.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    flagged = hits.join(relevant.withColumn("hit", F.lit(1)), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    running = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("seen", F.sum("hit").over(running))
    cuts = hits.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    ap = flagged.groupBy("qid").agg(F.sum(F.col("hit") * F.col("seen") / F.col("place")).alias("ap"))
    at_k = flagged.crossJoin(F.broadcast(cuts)).where(F.col("place") <= F.col("k"))
    per = at_k.groupBy("qid", "k").agg(F.sum("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"), F.sum(F.col("hit") / F.log2(F.col("place") + 1.0)).alias("dcg"))
    every = totals.crossJoin(F.broadcast(cuts)).join(per, ["qid", "k"], "left").join(ap, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("k"), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    found = F.coalesce("found", F.lit(0))
    return every.groupBy("k").agg(
        F.avg(found / F.col("n_relevant")).alias("recall"),
        F.avg(found / F.col("k")).alias("precision"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
        F.avg(F.coalesce("ap", F.lit(0.0)) / F.col("n_relevant")).alias("map"),
    )


def greedy_matches(gold: list[str], predicted: list[str], match) -> int:
    """Each prediction, in order, takes the first gold text that is left and matches."""
    left, n = list(gold), 0
    for p in predicted:
        for k, g in enumerate(left):
            if match(p, g):
                del left[k]
                n += 1
                break
    return n


def entity_prf(counts: DataFrame) -> DataFrame:
    """Of counts(type, tp, fp, fn): (type, precision, recall, f1), and micro for all."""
    sums = counts.rollup("type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return sums.select(F.coalesce("type", F.lit("micro")).alias("type"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def latency(values: DataFrame, by: str, value: str) -> DataFrame:
    """mean, upper median, 95th by index, max of each group, from counts of distinct values."""
    counts = values.groupBy(by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(by)
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(total))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value)))
    return placed.groupBy(by).agg((F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(value).alias("max"))


def gini(values: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a column.

    Ranks come from counts of distinct values in two steps (totals of ranges, then within a range),
    so no one task orders all rows.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("part").agg(F.sum("c").alias("size"))  # as many rows as partitions
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "part").withColumn("i", F.col("before") + F.coalesce(F.sum("c").over(within), F.lit(0)))
    # Places i+1 … i+c add up to c*i + c(c+1)/2.
    s = placed.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.sum(F.col("v") * (F.col("c") * F.col("i") + F.col("c") * (F.col("c") + 1) / 2)).alias("weighted"))
    return s.select(((2 * F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))).alias("gini"))
