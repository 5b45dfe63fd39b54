"""Loading articles: projection, rejects, first-wins dedup, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsearch.functions import dates, text


def documents_as_articles(documents: DataFrame) -> DataFrame:
    """Raw articles of a plain text table: the first line is the title, the rest the content."""
    body = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("ord"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"),
        F.lit("").alias("date"),
        F.col("lang").alias("category"),
        F.substring_index(body, "\n", 1).alias("title"),
        F.when(F.instr(body, "\n") > 0, F.substr(body, F.instr(body, "\n") + F.lit(1))).otherwise(F.lit("")).alias("content"),
        "source",
    )


def doc_key(url: Column, title: Column) -> Column:
    """A stable id from the url, or the title without one."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.coalesce(F.nullif(url, F.lit("")), title), 256), 1, 16))


def build_documents(articles: DataFrame, min_ratio: float | None = 0.05) -> DataFrame:
    """The columns of a document and reason: null, or the first of missing_title, missing_content, lang_filter."""
    made = articles.select(
        "ord",
        "url",
        text.normalize(F.coalesce("title", F.lit(""))).alias("title"),
        text.normalize(text.strip_byline(F.coalesce("content", F.lit("")))).alias("content"),
        dates.parse_date(F.coalesce("date", F.lit(""))).alias("date"),
        F.coalesce(F.nullif("source", F.lit("")), text.guess_source(F.coalesce("url", F.lit("")))).alias("source"),
        F.lower(F.coalesce("category", F.lit(""))).alias("category"),
    )
    full = F.concat_ws(". ", "title", "content")
    reason = F.when(F.col("title") == "", "missing_title").when(F.col("content") == "", "missing_content")
    if min_ratio is not None:
        reason = reason.when(text.viet_ratio(full) < min_ratio, "lang_filter")
    return made.withColumn("full_text", full).withColumn("id", doc_key(F.col("url"), F.col("title"))).withColumn("reason", reason)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; rows with an empty or null key all stay.

    Grouped by a minimum, which is combined before the shuffle, and joined back: a key of a third of
    all rows is no one task's work.
    """
    first = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.xxhash64(key).alias("h"), F.col(key).alias("k")).agg(F.min(order).alias("first"))
    return df.withColumn("h", F.xxhash64(key)).join(first, "h", "left").where("first IS NULL OR k <> `" + key + "` OR `" + order + "` = first").drop("h", "k", "first")


def load_stats(built: DataFrame) -> DataFrame:
    return built.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n"))


def fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """One value for a set of ids, whatever their order: how many, and the sum of parts of their hashes."""
    part = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 12), 16, 10).cast("decimal(20,0)")
    return ids.agg(F.count("*").alias("n"), F.sum(part).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def summary(documents: DataFrame, by: str) -> DataFrame:
    return documents.groupBy(by).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def where_equal(documents: DataFrame, column: str, value: str) -> DataFrame:
    """Documents of one category, source, or whatever the column names."""
    return documents.where(F.col(column) == value)
