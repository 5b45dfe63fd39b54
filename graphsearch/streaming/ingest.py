"""Arrivals as streams: first-seen within a watermark, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch import storage
from graphsearch.operators import clean, graph, linking, ner


def first_seen_stream(events: DataFrame, key: str, time: str = "ts", delay: str = "1 day") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: str, time: str = "ts", size: str = "1 day", delay: str | None = "1 hour") -> DataFrame:
    """(start, by, n, total) of tumbling windows; on a stream they are final once the watermark has passed them.

    delay is the watermark's, None if events have one.
    """
    timed = events if events.schema[time].dataType == T.TimestampType() else events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming and delay is not None:
        timed = timed.withWatermark(time, delay)
    return timed.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def upsert_occurrences(batch: DataFrame, number: int, path: str) -> None:
    """A foreachBatch sink: a batch's occurrences replace those that the same batch wrote before, so that a batch that is run again counts once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def edges_of(spark, path: str) -> DataFrame:
    """The edges of all occurrences that have come so far."""
    return graph.edges(spark.read.parquet(path))


def append_stream(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet", **trigger):
    """A query that appends rows to files and, started again, goes on after the last batch that is complete."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def ingest_articles(stream: DataFrame, min_ratio: float | None = 0.05) -> DataFrame:
    """Raw articles as they arrive (ord, url, title, content, date, category, source): valid documents, each url once."""
    made = clean.build_documents(stream, min_ratio).where("reason IS NULL").drop("reason")
    return made.dropDuplicates(["url"])


def annotate_stream(stream: DataFrame, path: str, checkpoint: str, annotator: str = "capitals", id: str = "doc_id", body: str = "text"):
    """Documents' entities, batch by batch, in files of JSON lines; a batch that is run again replaces its own."""

    def sink(batch: DataFrame, number: int) -> None:
        ner.annotate(batch, annotator, body).select(id, "text_key", F.to_json("entities").alias("entities")).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume_annotation(documents: DataFrame, done: DataFrame | None, annotator: str = "capitals", id: str = "doc_id", body: str = "text") -> DataFrame:
    """Annotates the documents that done(doc_id) lacks."""
    left = documents if done is None else documents.join(done.select(id).distinct(), id, "left_anti")
    return ner.annotate(left, annotator, body)


def link_batch(mentions: DataFrame, aliases: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """A batch's mentions linked with what is known so far, and the aliases with those that the batch has added."""
    linked = storage.stored(linking.link_mentions(mentions, aliases, **options))
    fresh = linking.aliases_of(linked).join(aliases.select("norm").distinct(), "norm", "left_anti")
    return linked, storage.stored(aliases.unionByName(fresh.select(*aliases.columns)))
