"""Benchmark decontamination with suffix arrays of the training text.

A shard is a run of whole documents.  Each shard's words become a suffix array; every suffix of every
benchmark item is binary-searched in it, which gives all places that share its window (its first words),
and each is followed to the end of its verbatim match.  These maximal matches, with their places, decide
which words and which items of a document are hit, and with that which documents go.  Shards are
independent of each other: nothing is shuffled and a lost shard is built again from its documents.

The array is sparse: it holds the suffixes that begin as some benchmark suffix does, with the same
first words, since no other can match a window.  Words are compared one by one, each by 64 bits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsearch.llm.tables import map_arrow, read, stored, without
from graphsearch.llm.wordbytes import ALNUM_FOLDED, Words, grams, inside, pieces

WINDOW = 8
#: Text bytes of benchmark items that go to every executor at once; more are searched block by block.
BLOCK_BYTES = 32 << 20
#: Text bytes of a shard; one longer document is a shard by itself.
SHARD_BYTES = 4 << 20
#: Places of suffixes in a shard that are followed at once (or those of one suffix).
MOST_PAIRS = 1 << 18
_SEED = 3


@dataclass
class Block:
    """Items that are searched together: their words one after another, each item closed by a 0."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray
    #: Where windows begin, and their lengths.
    at: np.ndarray
    length: np.ndarray
    longest: int
    seed_words: int
    seeds: np.ndarray


def make_block(items: list[tuple[object, str | None]], window: int) -> Block:
    words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM_FOLDED)
    n = len(words)
    place = np.arange(n) + words.doc
    flat = np.zeros(n + len(items), np.uint64)
    flat[place] = words.hash
    item = np.zeros(len(flat), np.int64)
    item[place] = words.doc
    count = words.count[words.doc] if n else np.zeros(0, np.int64)
    offset = np.arange(n) - words.first[words.doc] if n else np.zeros(0, np.int64)
    size = np.minimum(count, window)
    begins = offset + size <= count
    at, length = place[begins], size[begins]
    seed_words = int(min(_SEED, length.min())) if len(length) else 0
    seeds = np.unique(grams(flat, seed_words)[at]) if len(at) else np.zeros(0, np.uint64)
    return Block([str(i) for i, _ in items], flat, item, at, length, int(words.count.max()) if len(items) else 0, seed_words, seeds)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array of."""
    bits = 20
    table = np.zeros(1 << bits, bool)
    table[(of >> np.uint64(64 - bits)).astype(np.int64)] = True
    found = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
    maybe = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(of, values[maybe]), len(of) - 1)
    found[maybe] = of[place] == values[maybe]
    return found


class SuffixArray:
    """The sorted suffixes at some places of a text; 0 ends a suffix and sorts first."""

    def __init__(self, text: np.ndarray, places: np.ndarray, depth: int):
        self.text = text
        order = np.asarray(places, np.int64)
        group = np.zeros(len(order), np.int64)  # number of the run of suffixes that are equal so far
        open_ = np.arange(len(order))
        step = 0
        while len(open_) and step < depth:
            width = 8
            part = order[open_]
            keys = [self.word(part + step + k) for k in range(width)]
            by = np.lexsort([*reversed(keys), group[open_]])
            order[open_] = part[by]
            differs = np.zeros(len(by), bool)
            differs[0] = True
            g = group[open_][by]
            differs[1:] |= g[1:] != g[:-1]
            for key in keys:
                k = key[by]
                differs[1:] |= k[1:] != k[:-1]
            ended = keys[-1][by] == 0
            run = np.cumsum(differs)
            group[open_] = run
            single = np.bincount(run, minlength=run[-1] + 1)[run] == 1
            open_ = open_[~(single | ended)]
            step += width
        self.order = order

    def word(self, place: np.ndarray) -> np.ndarray:
        """The word there; 0 beyond the end."""
        out = self.text[np.minimum(place, len(self.text) - 1)]
        out[place >= len(self.text)] = 0
        return out

    def bound(self, other: np.ndarray, at: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """For each suffix other[at:at+length], how many suffixes sort before it, or with after also those that begin with it."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        while (busy := np.flatnonzero(low < high)).size:
            middle = (low[busy] + high[busy]) // 2
            place = self.order[middle]
            sign = np.zeros(len(busy), np.int8)
            todo, k = np.arange(len(busy)), 0
            while len(todo):
                todo = todo[k < length[busy[todo]]]
                if not len(todo):
                    break
                mine, its = self.word(place[todo] + k), other[at[busy[todo]] + k]
                sign[todo[mine < its]] = -1
                sign[todo[mine > its]] = 1
                todo = todo[mine == its]
                k += 1
            lower = sign < 0 if not after else sign <= 0
            low[busy[lower]] = middle[lower] + 1
            high[busy[~lower]] = middle[~lower]
        return low


@dataclass
class Shard:
    words: Words
    text: np.ndarray
    place: np.ndarray
    #: Document and number of the word at each place of text.
    number: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Shard:
        words = Words(texts, ALNUM_FOLDED)
        place = np.arange(len(words)) + words.doc
        text = np.zeros(len(words) + words.n_docs, np.uint64)
        text[place] = words.hash
        number = np.full(len(text), -1, np.int64)
        number[place] = np.arange(len(words))
        return cls(words, text, place, number)

    def array(self, block: Block) -> SuffixArray:
        if not block.seed_words or len(self.words) < block.seed_words:
            return SuffixArray(self.text, np.zeros(0, np.int64), 0)
        starts = grams(self.words.hash, block.seed_words)
        near = np.flatnonzero(inside(self.words, block.seed_words))
        found = near[_member(starts[near], block.seeds)]
        return SuffixArray(self.text, self.place[found], block.longest)


@dataclass
class Matches:
    """Maximal matches: document, item, first word in the document and in the item, words."""

    doc: np.ndarray
    item: np.ndarray
    doc_word: np.ndarray
    item_word: np.ndarray
    size: np.ndarray


def search_shard(shard: Shard, block: Block) -> Matches:
    """Every verbatim match of at least a window that can't be made longer.

    Each benchmark suffix is binary-searched for its window; of the places that begin with it, those
    that go on from a match of the suffix before it are left out, and the others are followed to the
    match's end.
    """
    array = shard.array(block)
    parts: list[tuple[np.ndarray, ...]] = []
    if len(array.order):
        low = array.bound(block.words, block.at, block.length, False)
        high = array.bound(block.words, block.at, block.length, True)
        ends = np.flatnonzero(block.words == 0)
        rest = ends[np.searchsorted(ends, block.at)] - block.at
        some = np.flatnonzero(high > low)
        upto = np.cumsum((high - low)[some])
        k = 0
        while k < len(some):
            z = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + MOST_PAIRS, side="right")))
            mine = some[k:z]
            times = (high - low)[mine]
            which = np.repeat(mine, times)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
            place, at = array.order[rank], block.at[which]
            before = np.where(place > 0, shard.text[place - 1], 0)
            fresh = (before == 0) | (at == 0) | (before != block.words[at - 1])
            which, rank, place, at = which[fresh], rank[fresh], place[fresh], at[fresh]
            size = block.length[which].copy()
            todo = np.arange(len(which))
            while len(todo := todo[size[todo] < rest[which[todo]]]):
                todo = todo[array.word(place[todo] + size[todo]) == block.words[at[todo] + size[todo]]]
                size[todo] += 1
            parts.append((shard.number[place], at, size))
            k = z
    number, at, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    doc, item = shard.words.doc[number], block.item[at]
    first = np.append(0, np.flatnonzero(block.words == 0) + 1)
    return Matches(doc, item, number - shard.words.first[doc], at - first[item], size)


def covered(shard: Shard, found: Matches) -> np.ndarray:
    """Which of the shard's words are in a match."""
    hit = np.zeros(len(shard.words) + 1, np.int64)
    number = found.doc_word + shard.words.first[found.doc]
    np.add.at(hit, number, 1)
    np.add.at(hit, number + found.size, -1)
    return np.cumsum(hit[:-1]) > 0


def longest(found: Matches, names: list[str], n_docs: int) -> list[list[dict]]:
    """For each document its items, by name: words of the longest match, its first word in the item, and all its places in the document."""
    out: list[dict[str, dict]] = [{} for _ in range(n_docs)]
    for k in np.lexsort([found.doc_word, found.item_word, -found.size]).tolist():
        mine, item = out[found.doc[k]], names[found.item[k]]
        known = mine.get(item)
        if known is None:
            mine[item] = {"item": item, "n_words": int(found.size[k]), "item_word": int(found.item_word[k]), "doc_words": [int(found.doc_word[k])]}
        elif known["n_words"] == found.size[k] and found.doc_word[k] not in known["doc_words"][-1:]:
            known["doc_words"].append(int(found.doc_word[k]))
    for mine in out:
        for known in mine.values():
            known["doc_words"] = sorted(set(known["doc_words"]))
    return [[mine[i] for i in sorted(mine)] for mine in out]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> list:
    """Broadcasts of blocks of the items; each block is loaded at its bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    parts = [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]
    return [spark.sparkContext.broadcast(pickle.dumps(make_block(sorted((r["item"], r["text"]) for r in part.collect()), window))) for part in parts]


_SPANS = "array<struct<from:bigint,to:bigint>>"
_LONGEST = "array<struct<item:string,n_words:bigint,item_word:bigint,doc_words:array<bigint>>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, spans (array of [from, to) word numbers that matches cover), longest (for each item with a match of a window, sorted as strings: item, n_words, item_word, doc_words).

    longest gives the words of the item's longest verbatim match with the document, where it begins
    in the item (first place), and every word of the document where it begins.  Null and empty texts
    have no words.  Items without words, without text or without id take no part; items of fewer
    words than the window are windows as a whole; items that repeat an id count once for it.  An
    empty benchmark leaves every document clean.  Only the two named columns of docs are read.
    """
    blocks = _blocks(benchmark, item, item_text, window)
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    id_type = source.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, n_words bigint, spans {_SPANS}, longest {_LONGEST}"
    span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    longest_type = pa.list_(pa.struct([("item", pa.string()), ("n_words", pa.int64()), ("item_word", pa.int64()), ("doc_words", pa.list_(pa.int64()))]))

    def run(block_bytes):
        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = pickle.loads(block_bytes.value)
            for batch in batches:
                for piece in pieces(batch, "text", SHARD_BYTES):
                    shard = Shard.of(piece.column("text"))
                    found = search_shard(shard, block)
                    hit = covered(shard, found)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    inner = np.flatnonzero(hit[1:] & hit[:-1] & (shard.words.doc[1:] != shard.words.doc[:-1])) + 1 if len(hit) else edge
                    edge = np.sort(np.concatenate([edge, inner, inner]))
                    begin, end = edge[::2], edge[1::2]
                    doc = shard.words.doc[begin]
                    base = shard.words.first[doc]
                    span = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["from", "to"])
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(piece) + 1)), pa.int32()), span).cast(span_type)
                    yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(shard.words.count), spans, pa.array(longest(found, block.ids, len(piece)), longest_type)], ["id", "n_words", "spans", "longest"])

        return map_arrow(source_keyed, shards, schema)

    if len(blocks) == 1:
        source_keyed = source
        return run(blocks[0]).withColumnRenamed("id", id)
    # Several blocks: what each found is put together by row; an item is in one block.
    source_keyed = stored(source.select(F.struct("id", F.monotonically_increasing_id().alias("row")).alias("id"), "text"))
    schema = f"id struct<id:{id_type.simpleString()},row:bigint>, n_words bigint, spans {_SPANS}, longest {_LONGEST}"
    found = run(blocks[0])
    for block in blocks[1:]:
        found = found.unionAll(run(block))
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast(_SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["to"] >= s["from"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], s["to"]).alias("to")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return found.groupBy("id").agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.flatten(F.collect_list("longest"))).alias("longest")).select(F.col("id.id").alias(id), "n_words", "spans", "longest")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each item with a match of a window: item (as text), n_words, item_word, id, doc_word of its longest match over all documents, a row for each of its places."""
    found = search(docs, benchmark, window, id, text, item, item_text).select(F.col(f"`{id}`").alias("doc"), F.explode("longest").alias("m"))
    flat = found.select("m.item", "m.n_words", "m.item_word", "doc", F.explode("m.doc_words").alias("doc_word"))
    best = flat.groupBy("item").agg(F.max("n_words").alias("n_words"))
    return flat.join(best, ["item", "n_words"]).select(F.col("item").alias(item), "n_words", "item_word", F.col("doc").alias(id), "doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows in which so many items have a match of a window, by default any; all its columns stay, whatever their names, and rows with a null or empty text.

    A row of docs goes if its id is not null and is the id of an affected row.
    """
    hits = search(docs.select(id, text), benchmark, window, id, text).where(F.size("longest") >= min_items)
    return without(docs, id, hits.select(id))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the contract, and the words of the document's longest match and where it first begins (null without one)."""
    found = search(docs, benchmark)
    words_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    items = F.transform("longest", lambda m: m["item"])
    most = F.array_max(F.transform("longest", lambda m: m["n_words"]))
    at = F.array_min(F.flatten(F.transform(F.filter("longest", lambda m: m["n_words"] == F.array_max(F.transform("longest", lambda n: n["n_words"]))), lambda m: m["doc_words"])))
    return found.select(
        "doc_id", "n_words", words_hit.alias("n_hit"), F.size("longest").cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("longest") >= 2).alias("contaminated"), F.coalesce(most, F.lit(0).cast("bigint")).alias("longest_words"), at.alias("longest_at"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The rows of digest, by comparing every window with every place."""
    import re

    def split(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = [(str(i), tuple(w[k : k + window])) for i, t in items if i is not None for w in [split(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc, t in docs:
        words, hit, names = split(t), set(), set()
        for name, window_words in windows:
            n = len(window_words)
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == window_words:
                    hit.update(range(k, k + n))
                    names.add(name)
        runs = []
        for name, t in items:
            theirs = split(t) if name is not None else []
            for i in range(len(words)):
                for j in range(len(theirs)):
                    n = 0
                    while i + n < len(words) and j + n < len(theirs) and words[i + n] == theirs[j + n]:
                        n += 1
                    if n and n >= min(window, len(theirs)):
                        runs.append((-n, i))
        best = min(runs, default=(0, None))
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2, -best[0], best[1]))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS k FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id),
bj AS (SELECT DISTINCT item_id, i AS j, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS k FROM b, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS r(i) WHERE len(w) > 0),
same AS (SELECT doc_id, item_id, i, j, dw.n FROM dw JOIN bj ON dw.n = bj.n AND dw.k = bj.k),
steps AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM same),
runs AS (SELECT doc_id, count(*) + any_value(n) - 1 AS size, min(i) - 1 AS place FROM steps GROUP BY doc_id, item_id, i - j, run),
best AS (SELECT doc_id, max(size) AS longest_words, arg_min(place, (-size, place)) AS longest_at FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
       coalesce(longest_words, 0)::BIGINT AS longest_words, longest_at::BIGINT AS longest_at
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""
