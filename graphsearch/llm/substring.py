"""Substring dedup: words in windows that an earlier document already has are removed.

Suffix automata of reference shards give, for every window of a document, the earliest document that
has it.  The reference is the corpus itself and has no size bound, so automata are not broadcast:
both reference and queries are routed to the shard that can matter.

1. Each window has a minimiser: the least hash of the runs of SHORT words in it.  It depends on the
   window's words alone, so equal windows have equal minimisers.  Minimisers that one document alone
   has rule their windows out; only these hashes are shuffled, about two for seven words.  Rows with
   equal texts count as one document here, since all but the least id of them go as a whole.
2. What is left of each text is cut into segments of windows with one minimiser.  Equal segments
   become one, with the least id that has it.
3. All segments with one minimiser are a reference shard.  Its automaton is built in order of ids, so
   a state's label is the least document that has its strings.  The same segments stream through it,
   and the state of the last WINDOW words names the earliest document of that window.
   A minimiser with more than MOST_SEGMENTS segments would make a large shard: its segments are taken
   apart into windows, and those that are equal, routed by all their words, are a shard of their own.
4. Spans whose earliest document is before their own go back to the rows and are cut out.

A whole text or segment is known by 128 bits of hashes and its length; a minimiser's owner by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.llm.tables import map_arrow, partitions, read, release, stored
from graphsearch.llm.wordbytes import SPACED, Words, grams, inside, mix, pieces, span_hashes

WINDOW = 13
SHORT = 8
#: Segments of one shard, windows of one segment: they bound an automaton.
MOST_SEGMENTS = 2048
MOST_WINDOWS = 64
_MANY = np.iinfo(np.int64).min
#: What tells a text from others.
_SAME = ["mark", "other", "size"]


def _minimisers(words: Words, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which windows begin, and each window's minimiser."""
    at = np.flatnonzero(inside(words, window))
    g = grams(words.hash, short)
    least = g[at]
    for k in range(1, window - short + 1):
        np.minimum(least, g[at + k], out=least)
    return at, least


def _runs(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive places with equal values begin."""
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = at[1:] != at[:-1] + 1
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _packed(marks: np.ndarray, values: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, marks, values) of pairs; a mark's group is fixed."""
    group = (marks.view(np.uint64) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort([marks, group])
    cut = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cut)):
        some = order[cut[g] : cut[g + 1]]
        yield int(g), marks[some], values[some]


def _offer(window: int, short: int, buckets: int, groups: int):
    """Rows for each bucket: minimisers and the mark of the one text of this run of rows that has each, or _MANY; and rows with the marks and minimisers that are shared within the run, by group of marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), SPACED)
                at, least = _minimisers(words, window, short)
                ids, kind = np.unique(np.asarray(piece.column("mark"), dtype=np.int64), return_inverse=True)
                doc = kind[words.doc[at]]
                first = _runs(at, least, words.doc[at])
                value, doc = least[first], doc[first]
                order = np.lexsort([doc, value])
                value, doc = value[order], doc[order]
                keep = np.ones(len(value), bool)
                keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                value, doc = value[keep], doc[keep]
                begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
                times = np.diff(np.append(begin, len(value)))
                many = np.repeat(times > 1, times)
                owner = np.where(times > 1, _MANY, ids[doc[begin]])
                key = value[begin]
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort([owner, bucket])
                key, owner, bucket = key[order], owner[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(b, None, key[a:z].tobytes(), owner[a:z].tobytes()) for b, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
                rows += [(g, m.tobytes(), v.tobytes(), None) for g, m, v in _packed(ids[doc[many]], value[many], groups)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "marks", "hashes", "owners"])

    return run


def _answer(groups: int):
    """Of a part's rows: (group, marks, hashes) of the minimisers that more texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners = [], []
        names = ["bucket", "marks", "hashes"]
        for batch in batches:
            ready = pc.is_valid(batch.column("marks"))
            own = batch.filter(ready)
            if len(own):
                yield own.select(names)
            for h, o in zip(*(batch.filter(pc.invert(ready)).column(c) for c in ("hashes", "owners")), strict=True):
                hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
                owners.append(np.frombuffer(o.as_buffer(), np.int64))
        if not hashes:
            return
        value, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        shared = np.zeros(len(value), bool)
        shared[1:] |= same
        shared[:-1] |= same
        wanted = shared & (owner != _MANY)
        for g, m, v in _packed(owner[wanted], value[wanted], groups):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's rows (group, marks, hashes): (mark, shared), one row for each mark."""
    marks, hashes = [], []
    for batch in batches:
        for m, h in zip(batch.column("marks"), batch.column("hashes"), strict=True):
            marks.append(np.frombuffer(m.as_buffer(), np.int64))
            hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
    if not marks:
        return
    mark, value = np.concatenate(marks), np.concatenate(hashes)
    order = np.argsort(mark, kind="stable")
    mark, value = mark[order], value[order]
    cut = np.append(np.flatnonzero(np.append(True, mark[1:] != mark[:-1])), len(mark))
    for k in range(0, len(cut) - 1, 4096):
        ends = cut[k : k + 4097]
        yield pa.RecordBatch.from_arrays([pa.array(mark[ends[:-1]]), pa.array([value[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["mark", "shared"])


def _segments(window: int, short: int):
    """Of (id, mark, size, text, hashes of its shared minimisers): the segments that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), SPACED)
                at, least = _minimisers(words, window, short)
                left = np.zeros(len(at), bool)
                cut = np.searchsorted(words.doc[at], np.arange(len(piece) + 1))
                for d, blob in enumerate(piece.column("shared")):
                    shared = np.sort(np.frombuffer(blob.as_buffer(), np.uint64))
                    mine = least[cut[d] : cut[d + 1]]
                    place = np.searchsorted(shared, mine)
                    place[place == len(shared)] = 0
                    left[cut[d] : cut[d + 1]] = shared[place] == mine
                at, least = at[left], least[left]
                doc = words.doc[at]
                first = _runs(at, least, doc)
                size = np.diff(np.append(first, len(at)))
                if (size > MOST_WINDOWS).any():
                    starts = [np.arange(f, f + n, MOST_WINDOWS) for f, n in zip(first, size, strict=True)]
                    first = np.concatenate(starts)
                    size = np.diff(np.append(first, len(at)))
                    size = np.minimum(size, MOST_WINDOWS)
                begin = at[first]
                end = begin + size + window - 1
                one = span_hashes(words.hash, begin, end)
                two = span_hashes(mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)), begin, end)
                data = words.data.tobytes()
                content = [b" ".join(data[words.start[b] : words.end[e - 1]].split()) for b, e in zip(begin, end, strict=True)]
                doc = doc[first]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c).take(take) for c in ("id", "mark", "other", "size")), pa.array(begin - words.first[doc]), pa.array(size), pa.array(least[first].view(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(content, pa.binary())],
                    ["id", "mark", "other", "size", "at", "n", "route", "one", "two", "content"],
                )

    return run


class SuffixAutomaton:
    """Of several word sequences, added in order of their labels: a state's label is the first that has its strings."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.label = [0]

    def _state(self, step: dict[bytes, int], link: int, length: int, label: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.label.append(label)
        return len(self.link) - 1

    def add(self, words: list[bytes], label: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word, label)

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the strings that end in p's longest and word; q itself, or its copy."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.label[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes, label: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, known, word)
        new = self._state({}, 0, self.length[last] + 1, label)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def earliest(self, words: list[bytes], window: int) -> list[int | None]:
        """By matching statistics: the label of each window of words, None where no sequence has it."""
        found: list[int | None] = []
        state, matched = 0, 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if k >= window - 1:
                found.append(self.label[state] if matched >= window else None)
        return found


def _label(window: int):
    """Of distinct segments, sorted by route and earliest document: each one's earliest document by window, null if it is the segment's own for all."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1 and rows[0][3] == rows[0][4]:
            return  # one document has all of the shard
        automaton = SuffixAutomaton()
        split = [row[-1].split(b" ") for row in rows]
        for (_, _, _, first, _, _), words in zip(rows, split, strict=True):
            automaton.add(words, first)
        for (_, one, two, first, last, _), words in zip(rows, split, strict=True):
            firsts = automaton.earliest(words, window)
            if any(f < last for f in firsts):
                yield one, two, first, None if all(f == first for f in firsts) else firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["one", "two", "first_id", "firsts"])
            done.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("route", "one", "two", "first_id", "last_id", "content")), strict=True):
                if held and held[0][0] != row[0]:
                    done.extend(shard(held))
                    held = []
                held.append(row)
            if done:
                yield flush()
        if held:
            done.extend(shard(held))
        if done:
            yield flush()

    return run


def _windows(window: int):
    """Of distinct segments: a row for each window, with hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("content").cast(pa.large_binary()).cast(pa.large_string()), SPACED)
            at = np.flatnonzero(inside(words, window))
            doc = words.doc[at]
            take = pa.array(doc)
            one, two = (grams(h, window)[at].view(np.int64) for h in (words.hash, mix(words.hash ^ np.uint64(0x5851F42D4C957F2D))))
            data = words.data.tobytes()
            content = [b" ".join(data[a:z].split()) for a, z in zip(words.start[at].tolist(), words.end[at + window - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("one", "two", "first_id", "last_id")), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(one), pa.array(two), pa.array(content, pa.binary())],
                ["one", "two", "first_id", "last_id", "k", "w_one", "w_two", "content"],
            )

    return run


def _cut(window: int, extra: list[str]):
    """Of (id, text, first_id, spans of windows' beginnings): n_words, n_removed and the words that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, "text")):
            total, gone, kept = [], [], []
            for id, text, first, spans in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("first_id").to_pylist(), batch.column("spans"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total.append(len(words))
                if id is not None and first is not None and first < id:
                    words = words if len(words) < window else []
                elif id is not None and spans.is_valid and len(spans):
                    mark = np.zeros(len(words) + 1, np.int64)
                    begin, end = (np.asarray(spans.values.field(k), dtype=np.int64) for k in (0, 1))
                    np.add.at(mark, begin, 1)
                    np.add.at(mark, end + window - 1, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *(batch.column(c) for c in extra)], ["id", "n_words", "n_removed", "kept_text", *extra])

    return run


def _source(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    """id, text, and mark, other and size, which tell its text from others."""
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.xxhash64(body).alias("mark"), F.xxhash64(F.lit("other"), body).alias("other"), F.length(body).alias("size"), body.alias("text"), *more)


def _left_over(source: DataFrame, window: int) -> DataFrame:
    """Segments of the first row of each text, without windows that no other text can have."""
    spark = source.sparkSession
    short, parts = min(SHORT, window), partitions(spark)
    offered = map_arrow(source.select("mark", "text"), _offer(window, short, 4 * parts, 4 * parts), "bucket int, marks binary, hashes binary, owners binary")
    answered = map_arrow(offered.repartition(2 * parts, "bucket"), _answer(4 * parts), "bucket int, marks binary, hashes binary")
    shared = map_arrow(answered.repartition(2 * parts, "bucket"), _gather, "mark bigint, shared binary")
    wanted = source.groupBy(*_SAME).agg(F.min("id").alias("id")).join(shared, "mark")
    return stored(map_arrow(source.join(wanted, [*_SAME, "id"]), _segments(window, short), "id bigint, mark bigint, other bigint, size int, at bigint, n bigint, route bigint, one bigint, two bigint, content binary"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(mark, other, size, first_id, spans) for each text that several ids have, or with windows that an earlier id has.

    first_id is the least id with the text; spans are [from, to) numbers of the words at which
    windows begin that a smaller id has.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    source = _source(docs, id, text).where("id IS NOT NULL AND text IS NOT NULL")
    segments = _left_over(source, window)
    release(spark)
    labels = "one bigint, two bigint, first_id bigint, firsts array<bigint>"
    hot = stored(segments.select("route", "one", "two").distinct().groupBy("route").agg(F.count("*").alias("n_segments")).where(F.col("n_segments") > MOST_SEGMENTS).select("route"))
    distinct = stored(segments.groupBy("one", "two").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.first("route").alias("route"), F.first("content").alias("content")))
    release(spark)
    sharded = map_arrow(distinct.join(hot, "route", "left_anti").select("route", "one", "two", "first_id", "last_id", "content").repartition(parts, "route").sortWithinPartitions("route", "first_id"), _label(window), labels)
    taken = stored(map_arrow(distinct.join(hot, "route", "left_semi").select("one", "two", "first_id", "last_id", "content"), _windows(window), "one bigint, two bigint, first_id bigint, last_id bigint, k int, w_one bigint, w_two bigint, content binary"))
    single = taken.groupBy("w_one", "w_two").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.first("content").alias("content"))
    single = single.select(F.col("w_one").alias("route"), F.col("w_one").alias("one"), F.col("w_two").alias("two"), "first_id", "last_id", "content")
    earliest = map_arrow(single.repartition(parts, "route").sortWithinPartitions("route", "first_id"), _label(window), labels).select(F.col("one").alias("w_one"), F.col("two").alias("w_two"), F.col("first_id").alias("known"))
    large = taken.join(earliest, ["w_one", "w_two"], "left").withColumn("first", F.coalesce("known", "first_id")).groupBy("one", "two").agg(F.min("first_id").alias("first_id"), F.transform(F.array_sort(F.collect_list(F.struct("k", "first"))), lambda w: w["first"]).alias("firsts"))
    labelled = sharded.unionByName(large)
    found = segments.select("id", *_SAME, "at", "n", "one", "two").join(labelled, ["one", "two"])
    span = "array<struct<from:bigint,to:bigint>>"
    each = F.filter(F.transform("firsts", lambda w, k: F.when(w < F.col("id"), F.struct((F.col("at") + k).alias("from"), (F.col("at") + k + 1).alias("to")))), lambda s: s.isNotNull()).cast(span)
    whole = F.array(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n")).alias("to"))).cast(span)
    spans = F.when(F.col("firsts").isNull(), F.when(F.col("first_id") < F.col("id"), whole)).otherwise(each)
    spans = found.select(*_SAME, spans.alias("spans")).where(F.size("spans") > 0).groupBy(*_SAME).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    texts = source.groupBy(*_SAME).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return stored(texts.join(spans, _SAME, "left").where("first_id < last_id OR spans IS NOT NULL").select(*_SAME, "first_id", "spans"))


def _removed(docs: DataFrame, window: int, id: str, text: str, extra: list[str]) -> DataFrame:
    """id, n_words, n_removed, kept_text, and the columns in extra as extra_0, extra_1, …"""
    spans = repeated_spans(docs, window, id, text)
    release(docs.sparkSession)
    names = [f"extra_{k}" for k in range(len(extra))]
    rows = _source(docs, id, text, *(F.col(f"`{c}`").alias(n) for c, n in zip(extra, names, strict=True)))
    joined = rows.join(spans, _SAME, "left").select("id", "text", "first_id", "spans", *names)
    fields = T.StructType.fromDDL("id bigint, n_words bigint, n_removed bigint, kept_text string").fields + [T.StructField(n, docs.schema[c].dataType) for c, n in zip(extra, names, strict=True)]
    return map_arrow(joined, _cut(window, names), T.StructType(fields))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    Words are runs of anything but ASCII white space, compared as they are.  A word goes if a window
    of so many words covers it whose words also begin somewhere in a row with a smaller id; windows
    are judged on the input.  Null texts have no words and an empty kept_text.  A row without id is
    kept whole and removes nothing; rows that repeat an id do not touch each other.  Ids are whole
    numbers.  No other column of docs is read.
    """
    return _removed(docs, window, id, text, []).select(F.col("id").alias(id), "n_words", "n_removed", "kept_text")


def cut_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """docs with the text that remove_repeats leaves where it takes words, and as it was where it takes none; length is a column that counts the text's characters.

    All columns and rows stay, whatever their names.
    """
    names = docs.columns
    cut = _removed(docs, window, id, text, names)
    changed = F.col("n_removed") > 0
    columns = []
    for k, c in enumerate(names):
        value = F.col(f"extra_{k}")
        if c == text:
            value = F.when(changed, F.col("kept_text")).otherwise(value)
        elif c == length:
            value = F.when(changed, F.length("kept_text")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return cut.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """(id, n_words, n_removed, kept_text) from a table of every window."""
    split = [(t or "").encode().split() for _, t in docs]
    least: dict[tuple, int] = {}
    for (d, _), w in zip(docs, split, strict=True):
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = {p for k in range(len(w) - window + 1) if d is not None and least[tuple(w[k : k + window])] < d for p in range(k, k + window)}
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
h AS (SELECT DISTINCT x.doc_id, p FROM x JOIN f ON x.k = f.k AND f.first < x.doc_id, unnest(range(i, i + 13)) AS r(p)),
g AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g.gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(g.gone, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
