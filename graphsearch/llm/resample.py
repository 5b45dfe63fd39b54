"""Quality by importance resampling.

Two generative models of hashed word n-grams, one of target texts and one of all texts, are counted in
one pass.  A text's log weight is the log ratio of its probabilities under the two.  Gumbel noise,
keyed by the row's id, is added, and the rows with the largest sums are a sample without replacement
in proportion to the weights.  The last of them is found by refining a histogram, so that neither a
global sort nor the sample passes through one machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsearch.llm.tables import map_arrow, read, stored
from graphsearch.llm.wordbytes import SPACED_FOLDED, Words, grams, inside, pieces

BUCKETS, LONGEST = 10_000, 2
PRIOR = 100.0
#: Part of the rows that is sampled.
FRACTION, SEED = 0.8, 11
#: Keys that are compared one by one at the end of the histogram's refinement.
FEW = 5_000


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram."""
    words = Words(texts, SPACED_FOLDED)
    docs, values = [], []
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(inside(words, n))
        docs.append(words.doc[at])
        values.append((grams(words.hash, n)[at] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for piece in pieces(batch, "text"):
            doc, bucket = _ngrams(piece.column("text"))
            target = np.asarray(piece.column("target"))[doc]
            counts[0] += np.bincount(bucket[target], minlength=BUCKETS)
            counts[1] += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "target", "raw"])


def log_ratios(docs: DataFrame, targets: DataFrame, id: str, text: str) -> np.ndarray:
    """Of each bucket, from all texts of docs and those whose id is in targets(id).

    The raw model is add-one smoothed, and the target's is drawn towards it by PRIOR n-grams, so that
    buckets without evidence weigh nothing.
    """
    # The targets grow with the input: they are joined by sorted partitions at every size, never broadcast.
    flagged = docs.hint("merge").select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(targets.select(F.col(f"`{id}`").alias("id"), F.lit(True).alias("t")).distinct(), "id", "left")
    counted = map_arrow(flagged.select("text", F.coalesce("t", F.lit(False)).alias("target")), _count, "bucket bigint, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS), np.ones(BUCKETS)
    for r in counted.collect():  # BUCKETS rows, whatever the input
        target[r["bucket"]] += r["target"]
        raw[r["bucket"]] += r["raw"]
    raw /= raw.sum()
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR)) - np.log(raw)


def weights(docs: DataFrame, targets: DataFrame, seed: int = SEED, temperature: float = 1.0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id, log_weight, key (log_weight divided by the temperature, with its noise).

    A log weight is a sum over the text's n-grams, so that long texts have large ones beside which
    the noise (a standard deviation of 1.3) is small; a temperature above 1 gives it more say.

    Null and empty texts have log weight 0.  Rows that repeat an id share their noise; rows without
    id share one.  Without targets, all log weights are 0.
    """
    ratio = log_ratios(docs, targets, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                doc, bucket = _ngrams(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("u"), pa.array(np.bincount(doc, ratio[bucket], len(piece)).astype(float))], ["id", "u", "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id}`")), 11) + 0.5) / float(1 << 53)
    source = docs.select(F.col(f"`{id}`").alias("id"), uniform.alias("u"), F.col(f"`{text}`").alias("text"))
    weighed = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, u double, log_weight double")
    return weighed.select(F.col("id").alias(id), "log_weight", (F.col("log_weight") / temperature - F.log(-F.log("u"))).alias("key"))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column key, 1 <= k <= number of rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / 1024
        inner = keys.where(F.col("key").between(low, high))
        if not width or low + width == low:
            break
        bins = inner.select(F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("bin"), "key").groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= FEW:
            return sorted((r["key"] for r in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)[k - above - 1]
    return high


def resample(docs: DataFrame, targets: DataFrame, fraction: float = FRACTION, seed: int = SEED, temperature: float = 1.0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, log_weight, key, kept) of the sampled rows: ceil(fraction * rows), and rows that tie with the last; kept is true."""
    keys = stored(weights(docs, targets, seed, temperature, id, text))
    k = int(np.ceil(fraction * keys.count()))
    if not k:
        return keys.limit(0).withColumn("kept", F.lit(True))
    return keys.where(F.col("key") >= kth_largest(keys, k)).withColumn("kept", F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))
