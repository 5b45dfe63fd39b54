"""Scores of entities: PageRank, personalised for many queries at once, and blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsearch.storage import stored


#: Edges, and edges times queries, up to which power iteration is one task's work; the join form gives the same ranks.
SMALL_EDGES, SMALL_WORK = 200_000, 4_000_000
#: Damping, tolerance and most iterations of global and of personalised ranks; the part of the latter's start that is uniform.
DAMPING, GLOBAL, PERSONAL, UNIFORM = 0.85, (1e-6, 100), (1e-4, 50), 0.1


def max_normalized(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Divided by the largest (of each group); unchanged where that is 0."""
    top = df.groupBy(*(by or [])).agg(F.max(score).alias("top_score"))
    joined = df.join(top, by) if by else df.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn(score, F.when(F.col("top_score") > 0, F.col(score) / F.col("top_score")).otherwise(F.col(score))).drop("top_score")


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = DAMPING, iterations: int | None = None, tolerance: float | None = None, uniform: float = UNIFORM, nodes: DataFrame | None = None, small: int = SMALL_EDGES) -> DataFrame:
    """(qid, entity, rank): global ranks (qid 0), or those of all queries of seeds(qid, entity) in one job.

    Weights of parallel edges(subj, obj, weight) add up.  nodes(entity) are further nodes, without edges.  A query
    stops by itself when its ranks change by less than the tolerance a node.  Global ranks that do not
    get there in so many iterations are weighted in-degrees; personalised ones are their start.  A
    query without a seed that is a node has the global ranks.
    """
    tol, most = GLOBAL if seeds is None else PERSONAL
    found = power_iteration(edges, seeds, damping, iterations or most, tol if tolerance is None else tolerance, uniform, nodes, small)
    if seeds is None:
        incoming = edges.groupBy(F.col("obj").alias("entity")).agg(F.sum("weight").alias("incoming"))
        return found.join(incoming, "entity", "left").select("qid", "entity", F.when(F.col("converged"), F.col("rank")).otherwise(F.coalesce("incoming", F.lit(0.0))).alias("rank"))
    own = found.select("qid", "entity", F.when(F.col("converged"), F.col("rank")).otherwise(F.col("start")).alias("rank"))
    lost = seeds.select(F.col("qid").cast("bigint").alias("qid")).distinct().join(own.select("qid").distinct(), "qid", "left_anti")
    everyone = pagerank(edges, None, damping, nodes=nodes, small=small).select("entity", "rank")
    return own.unionByName(lost.crossJoin(everyone).select("qid", "entity", "rank"))  # a row for each node and such query, as for all others


def semantic(edges: DataFrame) -> DataFrame:
    """The edges that ranks run on: all but co-occurrences; nodes are left alone."""
    return edges.where("relation <> 'co_occurrence'")


def power_iteration(edges: DataFrame, seeds: DataFrame | None, damping: float, iterations: int, tolerance: float, uniform: float = UNIFORM, nodes: DataFrame | None = None, small: int = SMALL_EDGES) -> DataFrame:
    """(qid, entity, rank, start, converged) of power iteration; start is the personalisation, to which the rank of nodes without out-edges goes.

    Queries without a seed among the nodes have no row.  Each iteration joins on the node and sums by
    (query, node), and is written; a small graph, for few queries, is one task's arrays instead.
    """
    flat = stored(edges.groupBy("subj", "obj").agg(F.sum("weight").alias("w")))
    alone = (nodes.select("entity") if nodes is not None else flat.select(F.col("subj").alias("entity")).limit(0)).distinct()
    n_edges = flat.count()
    n_queries = 1 if seeds is None else seeds.select("qid").distinct().count()
    if n_edges <= small and (n_edges + alone.count()) * n_queries <= SMALL_WORK:
        return stored(_small(flat, seeds, alone, damping, iterations, tolerance, uniform))  # blends read it many times
    out = flat.groupBy("subj").agg(F.sum("w").alias("out"))
    step = stored(flat.join(out, "subj").select(F.col("subj").alias("entity"), "obj", (F.col("w") / F.col("out")).alias("share")))
    names = stored(flat.select(F.col("subj").alias("entity")).unionAll(flat.select("obj")).unionAll(alone).distinct())
    n = names.count()
    if seeds is None:
        base = names.select(F.lit(0).cast("bigint").alias("qid"), "entity", F.lit(1.0 / max(n, 1)).alias("start"))
    else:
        known = seeds.select(F.col("qid").cast("bigint").alias("qid"), "entity").distinct().join(names, "entity")
        share = known.groupBy("qid").agg(F.count("*").alias("k"))
        extra = known.join(share, "qid").select("qid", "entity", ((1 - uniform) / F.col("k")).alias("extra"))
        base = names.crossJoin(share.select("qid")).join(extra, ["qid", "entity"], "left").select("qid", "entity", (F.lit(uniform / max(n, 1)) + F.coalesce("extra", F.lit(0.0))).alias("start"))
    sinks = names.join(out, names["entity"] == out["subj"], "left_anti").withColumn("sink", F.lit(True))
    base = stored(base.join(sinks, "entity", "left").select("qid", "entity", "start", F.coalesce("sink", F.lit(False)).alias("sink")))
    active = base.select("qid", "entity", F.lit(1.0 / max(n, 1)).alias("rank"), "start", "sink")
    finished = None
    for _ in range(iterations):
        moved = active.join(step, "entity").groupBy("qid", F.col("obj").alias("entity")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = active.where("sink").groupBy("qid").agg(F.sum("rank").alias("lost"))
        rank = damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("start")) + (1 - damping) * F.col("start")
        new = stored(active.withColumnRenamed("rank", "was").join(moved, ["qid", "entity"], "left").join(lost, "qid", "left").select("qid", "entity", rank.alias("rank"), "was", "start", "sink"))
        over = stored(new.groupBy("qid").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change")).where(F.col("change") < n * tolerance).select("qid"))
        done = new.join(over, "qid", "left_semi").select("qid", "entity", "rank", "start", F.lit(True).alias("converged"))
        finished = done if finished is None else finished.unionAll(done)
        active = new.join(over, "qid", "left_anti").select("qid", "entity", "rank", "start", "sink")
        if active.isEmpty():
            return finished
    rest = active.select("qid", "entity", "rank", "start", F.lit(False).alias("converged"))
    return rest if finished is None else finished.unionAll(rest)


def _small(flat: DataFrame, seeds: DataFrame | None, alone: DataFrame, damping: float, iterations: int, tolerance: float, uniform: float) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    personal = seeds is not None

    def run(rows: pa.Table) -> pa.Table:
        subj, obj, w, qid = (rows.column(c).to_pylist() for c in ("subj", "obj", "w", "qid"))
        edge = [(s, o, x) for s, o, x in zip(subj, obj, w, strict=True) if o is not None]
        names = sorted({e[0] for e in edge} | {e[1] for e in edge} | {s for s, o, q in zip(subj, obj, qid, strict=True) if o is None and q is None})
        at = {x: k for k, x in enumerate(names)}
        n = len(names)
        i, j, x = np.array([at[e[0]] for e in edge], int), np.array([at[e[1]] for e in edge], int), np.array([e[2] for e in edge], float)
        out = np.bincount(i, x, n).astype(float)
        share = x / out[i]
        sink = out == 0
        wanted: dict[int, set[int]] = {} if personal or not n else {0: set()}
        for s, o, q in zip(subj, obj, qid, strict=True):
            if q is not None and s in at:
                wanted.setdefault(q, set()).add(at[s])
        qids, ranks, starts, converged = [], [], [], []
        for q, mine in sorted(wanted.items()):
            p = np.full(n, (uniform if mine else 1.0) / n)
            p[sorted(mine)] += (1 - uniform) / max(len(mine), 1)
            rank, change = np.full(n, 1.0 / n), np.inf
            for _ in range(iterations):
                new = damping * (np.bincount(j, rank[i] * share, n).astype(float) + rank[sink].sum() * p) + (1 - damping) * p
                change = np.abs(new - rank).sum()
                rank = new
                if change < n * tolerance:
                    break
            qids.append(np.full(n, q))
            ranks.append(rank)
            starts.append(p)
            converged.append(np.full(n, change < n * tolerance))
        cat = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
        return pa.table({"qid": cat(qids, np.int64), "entity": pa.array(names * len(qids), pa.string()), "rank": cat(ranks, np.float64), "start": cat(starts, np.float64), "converged": cat(converged, bool)})

    none = lambda t: F.lit(None).cast(t)
    rows = flat.select(none("bigint").alias("qid"), "subj", "obj", F.col("w").cast("double").alias("w")).unionAll(alone.select(none("bigint"), "entity", none("string"), none("double")))
    if seeds is not None:
        rows = rows.unionAll(seeds.select(F.col("qid").cast("bigint"), "entity", none("string"), none("double")))
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "qid bigint, entity string, rank double, start double, converged boolean")  # at most SMALL_EDGES edges


def importance(nodes: DataFrame, pagerank: DataFrame, weights: tuple[float, float, float] = (0.50, 0.15, 0.05)) -> DataFrame:
    """(entity, score): blend of PageRank, frequency and mean link score, each divided by its largest, as is the blend."""
    pr = max_normalized(pagerank.select("entity", F.col("rank").alias("pr")), "pr")
    parts = nodes.select("entity", F.col("frequency").cast("double").alias("f"), F.col("avg_link_score").alias("q"))
    parts = max_normalized(max_normalized(parts, "f"), "q")
    blend = parts.join(pr, "entity", "left").select("entity", (weights[0] * F.coalesce("pr", F.lit(0.0)) + weights[1] * F.col("f") + weights[2] * F.col("q")).alias("score"))
    return max_normalized(blend, "score")


def query_blend(importance: DataFrame, personalised: DataFrame, weights: tuple[float, float] = (0.60, 0.40)) -> DataFrame:
    """(qid, entity, score): 0.6 importance and 0.4 personalised rank, normalised by query."""
    ppr = max_normalized(personalised.select("qid", "entity", F.col("rank").alias("ppr")), "ppr", ["qid"])
    queries = ppr.select("qid").distinct()
    every = importance.crossJoin(F.broadcast(queries)).join(ppr, ["qid", "entity"], "left")
    return max_normalized(every.select("qid", "entity", (weights[0] * F.col("score") + weights[1] * F.coalesce("ppr", F.lit(0.0))).alias("score")), "score", ["qid"])


def query_time_scores(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Of nodes(entity, frequency, avg_link_score), edges with relations and seeds(qid, entity): (qid, entity, score), the blend of importance and personalised rank; without seeds, importance alone (qid 0)."""
    flat = semantic(edges)
    base = stored(importance(nodes, pagerank(flat, nodes=nodes)))
    if seeds.isEmpty():
        return base.select(F.lit(0).cast("bigint").alias("qid"), "entity", "score")
    return query_blend(base, stored(pagerank(flat, seeds, nodes=nodes)))


def top_k(scores: DataFrame, nodes: DataFrame, k: int, type: str | None = None, exclude: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """(entity, type, score) of the k best of one type, or of all but some types."""
    typed = scores.join(nodes.select("entity", "type"), "entity")
    if type is not None:
        typed = typed.where(F.col("type") == type)
    if exclude:
        typed = typed.where(~F.col("type").isin(*exclude))
    return top_entities(typed, k, score)


def separation(edges: DataFrame, one: str, other: str, k: int = 3) -> DataFrame:
    """(differ): whether the k best personalised ranks of two seeds name different entities."""
    spark = edges.sparkSession
    ranks = pagerank(edges, spark.createDataFrame([(0, one), (1, other)], "qid bigint, entity string"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("rank", 9)), "entity")
    top = ranks.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return top.groupBy("entity").agg(F.count_distinct("qid").alias("seeds")).agg((F.max("seeds") < 2).alias("disjoint"), (F.sum((F.col("seeds") < 2).cast("int")) > 0).alias("differ"))


def score_distribution(scores: DataFrame, score: str = "score", k: int = 10) -> DataFrame:
    """(top_1, mean_of_top): the best score, and the mean of the k best."""
    return scores.orderBy(F.desc(score)).limit(k).agg(F.max(score).alias("top_1"), F.avg(score).alias("mean_of_top"))


def top_entities(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(score), "entity").limit(k)


def search_entities(scores: DataFrame, part: str, k: int = 10, score: str = "score") -> DataFrame:
    return top_entities(scores.where(F.contains(F.lower("entity"), F.lit(part.lower()))), k, score)


def rank_report(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each type."""
    order = Window.partitionBy("type").orderBy(F.desc(score), "entity")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def suggest(scores: DataFrame, n: int = 8, per_type: int = 3, score: str = "score") -> DataFrame:
    """The n best entities with at most so many of a type, among the 2n best."""
    near = top_entities(scores, 2 * n, score)
    return rank_report(near, per_type, score).drop("place").orderBy(F.desc(score), "entity").limit(n)
