"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda, best score first, then leftmost.  With dropout, each candidate that is
taken from the agenda is skipped with the same probability, by a hash of (seed, document, the word's
place in it): the hash gives how many candidates pass before the next skip, so that every occurrence of a
word has its own skips.  The pieces then are others, of the same vocabulary, and decode to the same text.

No piece of the vocabulary has a space mark after another character, so a text is encoded by words,
each with the spaces before it.  The agendas of many words are processed at once, a step of all of them
together: a table of costs has a row for each word, and a step takes the least cost of each row.  Words
that are met more than once in a run of text share the agenda without skips; an occurrence whose first
skip lies within it has an agenda of its own.  Nothing is remembered between runs of text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.llm.tables import map_arrow, read
from graphsearch.llm.wordbytes import mix, span_hashes
from graphsearch.llm.wordbytes import pieces as runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240601
#: Characters that are encoded at once, and symbols of a table of agendas.
RUN, TABLE = 1 << 19, 1 << 18
#: Words of at most so many characters are rows of a table with so many columns; longer ones have an agenda as a heap.
WIDTHS = (8, 16, 32, 64)
_NEVER = np.int32(2**31 - 1)
_WORD = re.compile(" +[^ ]*|[^ ]+")
_BETWEEN = re.compile("(?<=[^ ]) ")
_MARK = "▁"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M = (1 << 64) - 1
#: Characters that the vocabulary lacks have numbers from here on, until they become bytes.
_LACKING = 1 << 21


class Vocabulary:
    """Pieces with plain spaces for their space marks, costs (the rank of the score, best first), the ids of bytes, and the merges."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int]):
        special = {i for i, s in enumerate(pieces) if re.fullmatch(r"<unk>|</?s>|<0x[0-9A-F]{2}>", s)}
        ids = self.ids = {s.replace(_MARK, " "): i for i, s in enumerate(pieces) if i not in special}
        if any(" " in s.lstrip(" ") for s in ids):
            raise ValueError("a piece goes on after a space: texts can't be encoded by words")
        self.bytes_at = np.array(bytes_at, np.int32)
        self.text = [b"" if i in special else s.replace(_MARK, " ").encode() for i, s in enumerate(pieces)]
        for value, i in enumerate(bytes_at):
            self.text[i] = bytes([value])
        #: The symbol of each character.
        self.symbol = np.arange(_LACKING, _LACKING + 0x110000, dtype=np.int32)
        for s, i in ids.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        rank = {x: k for k, x in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        self.cost = np.array([rank.get(x, 0) for x in scores], np.int32)
        number = lambda s: ids.get(s, _LACKING + ord(s) if len(s) == 1 else None)
        merges = [(a, b, i) for s, i in ids.items() for k in range(1, len(s)) if (a := number(s[:k])) is not None and (b := number(s[k:])) is not None]
        self._index(np.array(merges, np.int64).reshape(-1, 3))
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)

    def _index(self, merges: np.ndarray) -> None:
        """A table of merges by hash of the two symbols, at most a quarter full; the next place is tried where one is taken."""
        bits = max(4, int(4 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.into = np.zeros(1 << bits, np.int32)
        key = merges[:, 0] << 32 | merges[:, 1]
        at, left = self._place(key), np.arange(len(key))
        while len(left):
            free = self.key[at[left]] < 0
            self.key[at[left[free]]] = key[left[free]]  # of several for one place, one is written
            stays = self.key[at[left]] == key[left]
            self.into[at[left[stays]]] = merges[left[stays], 2]
            left = left[~stays]
            at[left] = (at[left] + 1) & (len(self.key) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def merged(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The piece of two symbols, -1 where there is none."""
        key = one.astype(np.int64) << 32 | two
        at = self._place(key)
        found = self.key[at]
        out = np.where(found == key, self.into[at], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            found = self.key[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.into[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def price(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged < 0, _NEVER, self.cost[merged])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.get_piece_size())
        return cls([p.id_to_piece(i) for i in every], [p.get_score(i) for i in every], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Lists:
    """Runs of values, all in one array: run k has count[k] values from begin[k]."""

    def __init__(self, values: np.ndarray, count: np.ndarray):
        self.values, self.count = values, count
        self.begin = np.cumsum(count) - count


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, … count[k] of them, for each k."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.0, seed: int = 0):
        self.v = vocabulary
        self.seed = seed
        self.dropout = dropout
        self.log_passed = math.log1p(-dropout) if dropout < 1 else -math.inf

    def passed(self, occurrence: np.ndarray, skip: int | np.ndarray) -> np.ndarray:
        """How many candidates of occurrences pass between their skips of this number and the ones before."""
        if not self.dropout:
            return np.full(len(occurrence), 1 << 31, np.int64)
        drawn = mix(occurrence + (np.atleast_1d(skip).astype(np.uint64) + np.uint64(1)) * _ODD) >> np.uint64(11)
        return np.minimum(np.log((drawn + np.uint64(1)) * 2.0**-53) / self.log_passed, 1 << 31).astype(np.int64)

    def agendas(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, occurrence: np.ndarray | None) -> tuple[Lists, np.ndarray]:
        """The symbols that words of at most WIDTHS[-1] symbols end with, and how many candidates each took; without occurrences, none is skipped."""
        n = len(begin)
        left, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(mine), max(1, TABLE // width)):
                some = mine[k : k + max(1, TABLE // width)]
                table, length, taken[some] = self._table(symbols, begin[some], size[some], width, None if occurrence is None else occurrence[some])
                left[some] = length
                found.append((some, table))
        out = Lists(np.zeros(int(left.sum()), np.int32), left)
        for some, values in found:
            out.values[spread(out.begin[some], left[some])] = values
        return out, taken

    def _table(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, occurrence: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agendas of words of at most width symbols: their last symbols one word after another, how many of each word, and candidates taken."""
        n, v = len(begin), self.v
        column = np.arange(width)
        alive = column < size[:, None]
        # The column beyond the last stands for the end of any word; its symbol merges with none.
        symbol = np.full((n, width + 1), -2, np.int32)
        symbol[:, :width][alive] = symbols[spread(begin, size)]
        row, at = np.nonzero(column < size[:, None] - 1)
        merged = v.merged(symbol[row, at], symbol[row, at + 1])
        into, cost = np.full((n, width), -1, np.int32), np.full((n, width), _NEVER, np.int32)
        into[row, at], cost[row, at] = merged, v.price(merged)
        after = np.where(column + 1 < size[:, None], column + 1, width).astype(np.int8)
        before = np.broadcast_to(np.append(column - 1, 0), (n, width + 1)).astype(np.int8)
        ended = np.zeros((n, width), np.int32)
        taken, rows = np.zeros(n, np.int64), np.arange(n)  # rows: the words that the tables still hold
        skip = np.zeros(n, np.int64)
        until = None if occurrence is None else self.passed(occurrence, 0)
        live = rows
        while True:
            i = (cost if len(live) == len(cost) else cost[live]).argmin(axis=1)
            more = cost[live, i] != _NEVER
            live, i = live[more], i[more]
            if not len(live):
                break
            taken[rows[live]] += 1
            act = live
            if until is not None:
                skipped = until[live] == 0
                until[live] -= 1
                if skipped.any():
                    gone = live[skipped]
                    cost[gone, i[skipped]] = _NEVER
                    skip[gone] += 1
                    until[gone] = self.passed(occurrence[rows[gone]], skip[gone])
                    act, i = live[~skipped], i[~skipped]
            if len(act):
                piece = into[act, i]
                j = after[act, i]
                k = after[act, j]
                h = before[act, i]
                symbol[act, i] = piece
                alive[rows[act], j] = False
                cost[act, j] = _NEVER
                after[act, i] = k
                before[act, k] = i
                # The new piece may merge with the symbol after it, and the symbol before with the piece.
                later = h >= 0
                act_h, h = act[later], h[later]
                merged = v.merged(np.concatenate([piece, symbol[act_h, h]]), np.concatenate([symbol[act, k], piece[later]]))
                price, m = v.price(merged), len(act)
                into[act, i], cost[act, i] = merged[:m], price[:m]
                into[act_h, h], cost[act_h, h] = merged[m:], price[m:]
            if 2 * len(live) < len(cost):  # words that have ended leave the tables
                over = np.ones(len(cost), bool)
                over[live] = False
                ended[rows[over]] = symbol[over, :width]
                symbol, cost, into, after, before, rows, skip = symbol[live], cost[live], into[live], after[live], before[live], rows[live], skip[live]
                until = None if until is None else until[live]
                live = np.arange(len(rows))
        ended[rows] = symbol[:, :width]
        return ended[alive], alive.sum(axis=1), taken

    def _by_heap(self, word: str, occurrence: np.uint64 | None) -> list[int]:
        """The same for one word of any length, in n log n steps."""
        v = self.v
        ids, cost = v.ids, v.cost
        symbol: list[str | None] = list(word)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(int(cost[m]), i, word[i : i + 2]) for i in range(n - 1) if (m := ids.get(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        skips = self._skips(occurrence)
        until = next(skips)
        while agenda:
            _, i, merged = heapq.heappop(agenda)
            left = symbol[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbol[j]) != len(merged):
                continue  # one of the two has grown meanwhile
            if until == 0:
                until = next(skips)
                continue
            until -= 1
            symbol[i], symbol[j] = merged, None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                longer = merged + symbol[j]
                if (m := ids.get(longer)) is not None:
                    heapq.heappush(agenda, (int(cost[m]), i, longer))
            h = before[i]
            if h >= 0:
                longer = symbol[h] + merged
                if (m := ids.get(longer)) is not None:
                    heapq.heappush(agenda, (int(cost[m]), h, longer))
        return [ids[s] if s in ids else _LACKING + ord(s) for s in symbol if s is not None]

    def _skips(self, occurrence: np.uint64 | None) -> Iterator[int]:
        """How many candidates pass before each skip."""
        at = 0
        while True:
            if occurrence is None or not self.dropout:
                yield 1 << 62
                continue
            yield from self.passed(np.array([occurrence]), np.arange(at, at + 64)).tolist()
            at += 64

    def document(self, keys: np.ndarray) -> np.ndarray:
        return mix(mix(np.array([self.seed & _M], np.uint64)) ^ keys)

    def encode_run(self, text: str, first: np.ndarray, document: np.ndarray, place: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many of each.

        Text k is text[first[k] : first[k + 1]] and begins with the space that goes before any text, or goes on, at
        its word number place, with a word.
        """
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        space = chars == 32
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[first[:-1]] = True
        begin = np.flatnonzero(starts)
        size = np.diff(np.append(begin, len(chars)))
        word = np.searchsorted(begin, first)  # each text's first word
        number = np.arange(len(begin)) - np.repeat(word[:-1], np.diff(word)) + place
        occurrence = mix(np.repeat(document, np.diff(word)) + number.astype(np.uint64) * _ODD)
        symbols = self.v.symbol[chars]
        # Equal words, by hash, then by their characters.
        hashes = span_hashes(mix(chars.astype(np.uint64) + np.uint64(1)), begin, begin + size)
        _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        as_one = size == size[one][kind]
        same = np.zeros(len(chars), bool)
        where = spread(begin[as_one], size[as_one])
        same[where] = chars[where] == chars[spread(begin[one][kind[as_one]], size[as_one])]
        as_one &= np.add.reduceat(same, begin, dtype=np.int64) == size if len(begin) else as_one
        long = size > WIDTHS[-1]
        short_one = np.flatnonzero(~long[one])
        plain, taken = self.agendas(symbols, begin[one[short_one]], size[one[short_one]], None)
        at = np.full(len(one), -1)
        at[short_one] = np.arange(len(short_one))
        at = at[kind]
        own = ~long & (~as_one | (self.passed(occurrence, 0) < taken[np.maximum(at, 0)])) if len(taken) else ~long
        apart, _ = self.agendas(symbols, begin[own], size[own], occurrence[own])
        by_heap = [np.array(self._by_heap(text[begin[k] : begin[k] + size[k]], occurrence[k]), np.int32) for k in np.flatnonzero(long)]
        heaps = Lists(np.concatenate(by_heap) if by_heap else np.zeros(0, np.int32), np.array([len(x) for x in by_heap], np.int64))
        begin_of, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        shared = ~(own | long)
        begin_of[shared], count[shared] = plain.begin[at[shared]], plain.count[at[shared]]
        begin_of[own], count[own] = len(plain.values) + apart.begin, apart.count
        begin_of[long], count[long] = len(plain.values) + len(apart.values) + heaps.begin, heaps.count
        ids = np.concatenate([plain.values, apart.values, heaps.values])[spread(begin_of, count)]
        ends = np.append(0, np.cumsum(count))[word]
        lacking = ids >= _LACKING
        if lacking.any():
            ids, ends = self._as_bytes(ids, lacking, ends)
        return ids, np.diff(ends)

    def _as_bytes(self, ids: np.ndarray, lacking: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that the vocabulary lacks as the pieces of their UTF-8 bytes."""
        char = np.where(lacking, ids - _LACKING, 0)
        times = 1 + (lacking & (char >= 0x80)) + (lacking & (char >= 0x800)) + (lacking & (char >= 0x10000))
        first = np.cumsum(times) - times
        out = np.repeat(ids, times)
        for k in np.unique(times[lacking]):
            some = np.flatnonzero(lacking & (times == k))
            c = char[some]
            for b in range(k):
                value = c >> 6 * (k - 1 - b)
                lead = value | (0, 0, 0xC0, 0xE0, 0xF0)[k] if b == 0 else 0x80 | value & 0x3F
                out[first[some] + b] = self.v.bytes_at[lead]
        return out, np.append(0, np.cumsum(times))[ends]

    def encode_all(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many of each; of the empty text none.  keys tell documents apart."""
        document = self.document(keys)
        out, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        held: list[int] = []
        length = 0

        def flush() -> None:
            if held:
                ids, n = self.encode_run("".join(" " + texts[k] for k in held), np.append(0, np.cumsum([len(texts[k]) + 1 for k in held])), document[held])
                out.append(ids)
                sizes[held] = n
                held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            if length + len(text) > RUN:
                flush()
                length = 0
            if len(text) <= RUN:
                held.append(k)
                length += len(text) + 1
                continue
            whole, at, place = " " + text, 0, 0
            while at < len(whole):  # a long text is cut between words
                cut = _BETWEEN.search(whole, at + RUN)
                to = cut.start() if cut else len(whole)
                part = whole[at:to]
                ids, n = self.encode_run(part, np.array([0, len(part)]), document[k : k + 1], place)
                out.append(ids)
                sizes[k] += n[0]
                place += len(_WORD.findall(part))
                at = to
        flush()
        return np.concatenate(out), sizes

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_all([text], np.array([key & _M], np.uint64))[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, one after another, and how many of each; each text but the empty one begins with the space that encoding puts before it."""
        size = self.v.sizes[ids]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))]
        return self.v.flat[spread(self.v.begin[ids], size)], np.diff(ends)

    def decode(self, ids) -> str:
        return b"".join(map(self.v.text.__getitem__, ids)).decode()[1:]

    def lossless(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each text is what its ids decode to."""
        found, n = self.decode_all(ids, sizes)
        want = [(" " + t).encode() if t else b"" for t in texts]
        length = np.array([len(w) for w in want], np.int64)
        begin = np.cumsum(n) - n
        whole = n == length
        if whole.all():
            wrong = np.append(0, np.cumsum(found != np.frombuffer(b"".join(want), np.uint8)))
            return wrong[begin + n] == wrong[begin]
        for k in np.flatnonzero(whole):
            whole[k] = found[begin[k] : begin[k] + n[k]].tobytes() == want[k]
        return whole


def encode_texts(docs: DataFrame, vocabulary: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id, ids (array of int), n_tokens, lossless (whether the ids decode to the text).

    Every row's ids are decoded and compared with its text.  Null texts have null ids, count 0 tokens
    and are lossless; the empty text has no id.  What is skipped in a word depends on the row's id and
    the word's place; rows without id count as one document.  White space, characters beyond the
    vocabulary (as bytes) and the space mark itself all come back.  No row gives no row, repeated rows
    are each answered, and no other column of docs is read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))  # of the vocabulary's fixed size
    source = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.xxhash64(F.col(f"`{id}`")), F.lit(0)).alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        for batch in batches:
            for piece in runs(batch, "text", 4 * RUN):
                texts = [value or "" for value in piece.column("text").to_pylist()]
                ids, sizes = encoder.encode_all(texts, np.asarray(piece.column("key"), dtype=np.int64).view(np.uint64))
                whole = encoder.lossless(texts, ids, sizes)
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=piece.column("text").is_null())
                yield pa.RecordBatch.from_arrays([piece.column("id"), lists, pa.array(sizes), pa.array(whole)], ["id", "ids", "n_tokens", "lossless"])

    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("ids array<int>, n_tokens bigint, lossless boolean").fields])
    return map_arrow(source, run, schema).withColumnRenamed("id", id)


def decode_ids(encoded: DataFrame, vocabulary: str = MODEL, ids: str = "ids") -> DataFrame:
    """The columns of encoded and text (one of that name is left out); null ids have a null text, and ids beyond the vocabulary no text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    source = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c != "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        n = len(encoder.v.text)
        for batch in batches:
            texts = [None if x is None else encoder.decode([i for i in x if i is not None and 0 <= i < n]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return map_arrow(source, run, T.StructType([*source.schema.fields, T.StructField("text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"))


def brute_force(vocabulary: Vocabulary, text: str, key: int, dropout: float, seed: int) -> list[int]:
    """The ids of one text, word by word, each with a list of its pairs that is searched for the best at every step."""
    encoder = Encoder(vocabulary, dropout, seed)
    document = encoder.document(np.array([key & _M], np.uint64))
    out: list[int] = []
    for place, word in enumerate(_WORD.findall(" " + text) if text else []):
        skips = encoder._skips(mix(document + np.array([place], np.uint64) * _ODD)[0])
        symbols, dropped = list(word), [False] * len(word)
        until = next(skips)
        while True:
            open_ = [(int(vocabulary.cost[vocabulary.ids[p]]), i) for i in range(len(symbols) - 1) if not dropped[i] and (p := symbols[i] + symbols[i + 1]) in vocabulary.ids]
            if not open_:
                break
            _, i = min(open_)
            if until == 0:
                dropped[i], until = True, next(skips)
                continue
            until -= 1
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            dropped[i : i + 2] = [False]
            if i:
                dropped[i - 1] = False
        for s in symbols:
            out += [vocabulary.ids[s]] if s in vocabulary.ids else [int(vocabulary.bytes_at[b]) for b in s.encode()]
    return out
