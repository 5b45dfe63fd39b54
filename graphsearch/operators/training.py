"""Training data: term statistics, hard negatives, samples and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsearch.functions import text

K1, B = 1.5, 0.75


def bm25(documents: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", body: str = "text") -> DataFrame:
    """Of queries(qid, query): (qid, doc_id, score, place) of the k best scores above 0.

    Postings hold only terms that some query has; the statistics cover all documents.
    """
    docs = documents.select(F.col(id).alias("doc_id"), text.tokens(F.coalesce(body, F.lit(""))).alias("t"))
    asked = queries.select("qid", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("q_tf"))
    terms = asked.select("term").distinct()
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_dl"))
    postings = docs.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighed = postings.join(df, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avg_dl", F.lit(1e-9))))
    scored = weighed.withColumn("part", part).join(asked, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("part") * F.col("q_tf")).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.where("score > 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(hits: DataFrame, own: DataFrame, k: int = 3) -> DataFrame:
    """Of hits(qid, doc_id, place): the first k that are not the query's own(qid, doc_id)."""
    left = hits.join(own, ["qid", "doc_id"], "left_anti")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("n") <= k)


def hash_part(key: Column, parts: int) -> Column:
    """A stable number below parts."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def stratified_sample(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """About n rows, each group's share (one at least), by a stable order of hashes."""
    total = df.count()
    sizes = df.groupBy(by).agg(F.count("*").alias("size"))
    quota = sizes.select(F.col(by).alias("g"), F.greatest(F.lit(1), F.floor(F.col("size") * n / max(total, 1) + 0.5)).alias("quota"))
    order = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("place", F.row_number().over(order)).join(F.broadcast(quota), F.col(by).eqNullSafe(F.col("g"))).where(F.col("place") <= F.col("quota")).drop("g")


def mix(gold: DataFrame, silver: DataFrame, key: str, times: int = 3) -> DataFrame:
    """gold repeated so often, without a tenth that is held out, and half of silver."""
    kept = gold.where(hash_part(F.col(key), 10) != 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).unionByName(silver.where(hash_part(F.col(key), 2) == 0).withColumn("copy", F.lit(0)))


def several_words(name: Column) -> Column:
    """How sure a name is: 0.88 for several words, 0.82 for one."""
    return F.when(F.contains(name, F.lit(" ")), 0.88).otherwise(0.82)


def silver(sentences: DataFrame, least: float = 0.85, sure=several_words) -> DataFrame:
    """Sentences with entities, all of them sure."""
    return sentences.where((F.size("entities") > 0) & F.forall(F.transform("entities", sure), lambda c: c >= least))


def bio(words: Column, first: Column, last: Column, type: Column) -> Column:
    """Labels of words for one span [first, last]."""
    return F.transform(words, lambda _, i: F.when(i == first, F.concat(F.lit("B-"), type)).when((i > first) & (i <= last), F.concat(F.lit("I-"), type)).otherwise(F.lit("O")))


def bio_spans(tags: DataFrame) -> DataFrame:
    """Of tags(doc_id, i, tag): (doc_id, start, end, type) of runs that a B- begins; an I- of another type, or first, begins none."""
    w = Window.partitionBy("doc_id").orderBy("i")
    kind = F.substring("tag", 3, 100)
    starts = (F.col("tag") != "O") & (F.startswith("tag", F.lit("B-")) | (F.coalesce(F.lag("tag").over(w), F.lit("O")) == "O") | (F.substring(F.coalesce(F.lag("tag").over(w), F.lit("O")), 3, 100) != kind))
    runs = tags.withColumn("kind", kind).withColumn("new", starts.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("tag <> 'O'")
    return runs.groupBy("doc_id", "run").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.first("kind").alias("type"), F.min_by("tag", "i").alias("head")).where("head LIKE 'B-%'").drop("run", "head")


def head_corpus(articles: DataFrame, most: int, order: str = "ord", body: str = "text", title: str = "title") -> DataFrame:
    """(doc_id, title, text) of the first so many articles by order that have a title and over 50 characters of text; ids are places from 0 among all, texts at most 1000 characters."""
    first = articles.orderBy(order).limit(most)
    numbered = first.withColumn("doc_id", F.row_number().over(Window.orderBy(order)) - 1)  # at most so many rows
    return numbered.where((F.length(F.trim(body)) > 50) & (F.trim(title) != "")).select(F.col("doc_id").cast("string").alias("doc_id"), F.trim(title).alias("title"), F.substring(F.trim(body), 1, 1000).alias("text"))


def random_negatives(queries: DataFrame, corpus: DataFrame, seed: int = 42) -> DataFrame:
    """Of queries(qid, doc_id): (qid, negative), one other document of corpus(doc_id) drawn by a hash of the query; none if the corpus has no other."""
    numbered = corpus.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    parts = max(1, corpus.count() // 16)  # of about so many documents, however large the corpus
    # Documents have a part by their hash, and a query the least hash from a drawn place on within its part; a part without another document falls back to the corpus's least.
    drawn = queries.select("qid", "doc_id", F.pmod(F.xxhash64(F.lit(seed + 1), "qid"), F.lit(parts)).alias("part"), F.xxhash64(F.lit(seed + 2), "qid").alias("from"))
    pool = numbered.withColumn("part", F.pmod("h", F.lit(parts))).groupBy("part").agg(F.array_sort(F.collect_set(F.struct("h", "doc_id"))).alias("pool"))
    other = lambda own: F.filter("pool", lambda d: d["doc_id"] != own)
    joined = drawn.join(pool, "part", "left").withColumn("others", other(F.col("doc_id")))
    least = F.broadcast(numbered.orderBy("h", "doc_id").limit(2).agg(F.array_sort(F.collect_list(F.struct("h", "doc_id"))).alias("least")))  # two documents
    joined = joined.crossJoin(least).withColumn("others", F.when(F.size(F.coalesce("others", F.array())) > 0, F.col("others")).otherwise(F.filter("least", lambda d: d["doc_id"] != F.col("doc_id"))))
    return joined.where(F.size("others") > 0).select("qid", F.col("others")[F.pmod("from", F.size("others").cast("bigint")).cast("int")]["doc_id"].alias("negative"))


def training_pairs(corpus: DataFrame, triples: DataFrame | None = None, answers: DataFrame | None = None, epoch: int = 1, negatives: int = 3, most_triples: int = 50_000, most_articles: int = 5_000, seed: int = 42) -> DataFrame:
    """(query, passage, label) from ranking triples (two rows each), answers(question, context), and pseudo queries of corpus(doc_id, title, text, category).

    Epoch 1 has a random negative for each question, later ones hard negatives by BM25, never a
    question's own text.  Passages have at most 512 characters.  Limits are those of the mix: rows by
    least hash.
    """
    cut = lambda c: F.substring(c, 1, 512)
    asked = corpus.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_articles)
    pseudo = asked.select("doc_id", F.explode(F.slice(text.pseudo_queries(F.col("title"), F.col("text"), F.coalesce("category", F.lit(""))), 1, 2)).alias("query"), cut("text").alias("passage"))
    questions = pseudo
    if answers is not None:
        questions = questions.unionByName(answers.select(F.lit(None).cast(corpus.schema["doc_id"].dataType).alias("doc_id"), F.col("question").alias("query"), cut("context").alias("passage")))
    questions = questions.withColumn("qid", F.xxhash64("query", "passage")).dropDuplicates(["qid"])
    if epoch == 1:
        wrong = random_negatives(questions.select("qid", F.coalesce("doc_id", F.lit("")).alias("doc_id")), corpus, seed).withColumnRenamed("negative", "doc_id")
    else:
        hits = bm25(corpus, questions.select("qid", "query"), 20)
        own = hits.join(questions.select("qid", F.col("doc_id").alias("own"), "passage"), "qid").join(corpus.select("doc_id", cut("text").alias("theirs")), "doc_id")
        wrong = hard_negatives(hits, own.where("own = doc_id OR passage = theirs").select("qid", "doc_id"), negatives).select("qid", "doc_id")
    negative = wrong.join(corpus.select("doc_id", cut("text").alias("negative")), "doc_id").where("negative <> ''").join(questions.select("qid", "query"), "qid")
    pairs = questions.select("query", "passage", F.lit(1).alias("label")).unionAll(negative.select("query", "negative", F.lit(0)))
    if triples is not None:
        some = triples.orderBy(F.xxhash64(F.lit(seed), "query", "positive", "negative")).limit(most_triples)
        pairs = pairs.unionAll(some.select("query", cut("positive"), F.lit(1))).unionAll(some.select("query", cut("negative"), F.lit(0)))
    return pairs
