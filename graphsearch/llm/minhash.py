"""Near-duplicate documents by MinHash, with every link confirmed on full shingle sets.

1. Each text becomes its set of word shingles, a fingerprint of the set, and 128 minima of universal
   hashes (a*x + b mod 2^64) in 32 bands of 4.  Texts with equal sets are one class; the class's
   least id stands for it, and only these go on.
2. Representatives that agree in a band share a bucket.  No bucket is ever expanded into its pairs:
   each member is first compared with the two likeliest of its buckets' centres (least id, least hash
   of the id), signatures first, then whole sets.
3. Confirmed links become components (large-star, small-star).
4. What is left are links between different components that share a bucket.  They are found by
   prefixes: the shingles of the sets in such buckets are put in one order, rarest first, and two sets
   that reach the limit share one of their first few.  A text with many shingles of its own so leaves
   without meeting the group that it almost belongs to.  Pairs that do meet are decided by signatures,
   then whole sets, and new links join components once more.

A band key or a shingle that holds more than one in HOT of all its table's rows is hot.  Fewer than HOT can
be, so their list is broadcast; rows of a hot key are dealt by a hash of their id, and what is joined to them
is repeated for every share.

A pair at similarity 0.8 misses all bands with a probability of 5e-8, and falls under the signature
limit (five standard deviations below) with 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsearch.llm.components import connected_components
from graphsearch.llm.tables import map_arrow, read, stored, without
from graphsearch.llm.wordbytes import SPACED_FOLDED, Words, grams, mix, pieces

BANDS, ROWS = 32, 4
#: A key with more than one in HOT of all rows is dealt into SALTS shares.
HOT, SALTS = 10_000, 64
_A, _B = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one more at the end).

    A text of fewer than n words, but not none, has the sequence of all its words as one shingle.
    """
    out, sizes = [], np.zeros(words.n_docs, np.int64)
    g = grams(words.hash, n)
    for d in range(words.n_docs):
        a, z = words.first[d], words.first[d + 1]
        if a == z:
            continue
        s = np.sort(g[a : z - n + 1]) if z - a >= n else grams(words.hash[a:z], int(z - a))
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        s = s[keep]
        sizes[d] = len(s)
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def minima(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS minima for each text with shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    if len(starts):
        for k in range(BANDS * ROWS):
            out[k] = np.minimum.reduceat(sets * _A[k] + _B[k], starts)
    return out.T


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets, first = shingle_sets(Words(piece.column("text"), SPACED_FOLDED), n)
                sizes = np.diff(first)
                some = sizes > 0
                mins = minima(sets, first)
                marks = np.zeros((2, len(piece)), np.uint64)
                if len(mins):
                    starts = first[:-1][some]
                    marks[0, some] = np.add.reduceat(mix(sets), starts)
                    marks[1, some] = np.add.reduceat(mix(sets ^ _Q), starts)
                keys = mins.reshape(-1, BANDS, ROWS)
                key = keys[:, :, 0].copy()
                for r in range(1, ROWS):
                    key = key * _Q + keys[:, :, r]
                key = mix(key + np.arange(BANDS, dtype=np.uint64) * _Q).view(np.int64)
                signature = (mix(mins) >> np.uint64(48)).astype(np.uint16)
                null = ~some
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * BANDS)), pa.int32()), pa.array(key.ravel()))
                whole = np.empty(len(piece), object)
                whole[some] = [s.tobytes() for s in signature]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(sizes), pa.array(marks[0].view(np.int64), mask=null), pa.array(marks[1].view(np.int64), mask=null), bands, pa.array(whole, pa.binary())],
                    ["id", "n_shingles", "mark_a", "mark_b", "bands", "signature"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets, first = shingle_sets(Words(piece.column("text"), SPACED_FOLDED), n)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([sets[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "shingles"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, one, two) with two signatures: (a, b, equal minima)."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("one", "two"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((one == two).sum(axis=1, dtype=np.int32))], ["a", "b", "agree"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("one"), batch.column("two"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y) or not len(x):
                    continue
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                both = int((y[place] == x).sum())
                found[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(found), batch.column("b").filter(found)], ["a", "b"])

    return run


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    one = table.select(F.col("id").alias("a"), F.col(value).alias("one"))
    two = table.select(F.col("id").alias("b"), F.col(value).alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
        sizes = np.array([len(s) for s in sets], np.int64)
        take = pa.array(np.repeat(np.arange(len(batch)), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("component").take(take), pa.array(sizes).take(take), pa.array([int(s.sum()) for s in sets], pa.int64()).take(take), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["id", "component", "n", "mark", "token"])


def _hot(keys: DataFrame, key: str, n: str) -> DataFrame:
    """Of keys, a row each with its number of rows: those with more than one in HOT of all, fewer than HOT."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    return keys.where(F.col(n) > total / HOT).select(key, F.lit(True).alias("hot"))


def _dealt(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows, with the share of its key that each is in."""
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", share).drop("hot")


def _for_shares(keys: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """keys, a row for every share of each."""
    shares = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return keys.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(shares)).drop("hot")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Of (id, component, shingles): the first shingles of each set, rarest first, as many as any link needs; place counts from 1."""
    tokens = stored(map_arrow(sets.select("id", "component", "shingles"), _tokens, "id bigint, component bigint, n bigint, mark bigint, token bigint"))
    counts = stored(tokens.groupBy("token").agg(F.count("*").alias("times")))
    hot = _hot(counts, "token", "times")
    order = Window.partitionBy("id", "n", "mark").orderBy("times", "token")
    placed = _dealt(tokens, hot, "token").join(_for_shares(counts, hot, "token"), ["token", "salt"]).withColumn("place", F.dense_rank().over(order))  # a repeated row shares its places
    return placed.where(F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).where("times > 1").select("token", "id", "component", "n", "place")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id (bigint), n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles
    (A-Z folded, words between white space).  component_id is the least id that can be reached,
    kept is id = component_id.  Null and empty texts, and texts of white space, have no shingle, are
    linked with nothing and kept.  A row without id takes no part: component_id null, kept.  Rows
    that repeat an id are one node of the graph, and each is judged by its own text's class.
    Ids are whole numbers.  A shingle is known by 64 bits of its words, a whole set by 128 bits and
    its size.  Other columns of docs are not read.
    """
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    sketched = stored(map_arrow(source, _sketch(words), "id bigint, n_shingles bigint, mark_a bigint, mark_b bigint, bands array<bigint>, signature binary"))
    kind = ["mark_a", "mark_b", "n_shingles"]
    classes = sketched.where("id IS NOT NULL AND n_shingles > 0").groupBy(*kind).agg(F.min("id").alias("rep"))
    classed = stored(sketched.select("id", *kind).join(classes, kind, "left").select("id", "n_shingles", "rep"))
    ours = sketched.where("n_shingles > 0").join(classed.where("id = rep").select("id").distinct(), "id")

    in_band = ours.select("id", F.explode("bands").alias("key"))
    centres = stored(in_band.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.min_by("id", F.xxhash64("id")).alias("other")).where("least < most").drop("most"))
    hot = _hot(centres, "key", "n")
    members = stored(_dealt(in_band, hot, "key").join(_for_shares(centres.drop("n"), hot, "key"), ["key", "salt"]))
    candidates = stored(members.select("id").distinct())
    signatures = stored(ours.join(candidates, "id").select("id", "signature"))
    limit = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def alike(pairs: DataFrame) -> DataFrame:
        agreed = map_arrow(_with_both(pairs, signatures, "signature"), _agreement, "a bigint, b bigint, agree int")
        return agreed.where(F.col("agree") >= int(limit * BANDS * ROWS))

    to_centre = members.select(F.col("id").alias("a"), F.explode(F.array("least", "other")).alias("b")).where("a <> b").distinct()
    best = Window.partitionBy("a").orderBy(F.desc("agree"), "b")  # a has at most two centres a band
    first = stored(alike(to_centre).withColumn("place", F.row_number().over(best)).where("place <= 2").select("a", "b"))

    whole = stored(map_arrow(source.where("id IS NOT NULL").join(candidates, "id", "left_semi"), _sets(words), "id bigint, shingles binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return map_arrow(_with_both(pairs.select("a", "b"), whole, "shingles"), _confirm(percent), "a bigint, b bigint").distinct()

    links = stored(confirmed(first))
    component = stored(connected_components(links))

    placed = members.select("key", "salt", "id").join(component, F.col("id") == F.col("node"), "left").select("key", "salt", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    placed = stored(placed.join(_for_shares(mixed, hot, "key"), ["key", "salt"]))
    largest = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    outside = placed.join(_for_shares(largest, hot, "key"), ["key", "salt"]).where("component <> largest").select("id").distinct()
    ranked = stored(_prefixes(whole.join(placed.select("id", "component").distinct(), "id"), percent))
    # Two sets of sizes n and m that reach the limit share at least this many shingles, so one of the first size - share + 1 of each.
    share = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / (100 + percent))
    one = ranked.join(outside, "id").select("token", F.col("id").alias("x"), F.col("n"), F.col("place").alias("x_place"), F.col("component").alias("x_component"))
    two = ranked.select("token", "id", F.col("n").alias("m"), "place", "component")
    met = one.join(two, (one["token"] == two["token"]) & (F.col("component") != F.col("x_component")) & (F.col("x_place") <= F.col("n") - share + 1) & (F.col("place") <= F.col("m") - share + 1))
    rest = _pair(met, "x", "id").distinct().join(_pair(first, "a", "b"), ["a", "b"], "left_anti")
    more = stored(confirmed(alike(rest)))
    if not more.isEmpty():
        component = stored(connected_components(component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)))
    reached = classed.join(component, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    return reached.select(F.col("id").alias(id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; one id of each component stays."""
    return without(docs, id, near_duplicates(docs, words, percent, id, text).where("NOT kept").select(id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


def brute_force(docs: list[tuple[int | None, str | None]], words: int, percent: int = 80) -> list[tuple]:
    """The rows of near_duplicates for distinct ids, from all pairs of sets."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(docs):
        for j in range(i):
            e = docs[j][0]
            if None not in (d, e) and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(docs, sets, strict=True)]


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS k FROM w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
