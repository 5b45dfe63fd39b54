"""Chat formatting: quoted passages are linked to the messages they come from, and taken out.

Lines are split into levels by their marks (>).  Each run of lines of one level, without a line that
introduces a deeper one, is a passage; its text, normalised, is hashed and joined within the conversation
to the last earlier message that says it: a message's whole own text, each of its own runs between quotations, and each of their paragraphs, lines and
sentences count as sayings.  A passage that nobody says as a whole is linked by its own paragraphs, lines and
sentences: each is looked up, and the turn that says the most of the passage is taken.  Messages that
are linked follow their root, so that (conversation, root, turn) is reply order.

A passage that is often said and often quoted is never expanded into its pairs: the last earlier turn
is looked up in blocks of WIDTH turns, then in blocks of blocks, so that no group has more than WIDTH
rows, whatever a conversation holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphsearch.llm.tables import map_arrow, read, stored
from graphsearch.llm.wordbytes import pieces

_MARKS = re.compile(r"^((?:[ \t]{0,3}>)*)[ \t]?(.*)$", re.S)
_SPACE = re.compile(r"\s+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Lines that introduce a quotation.
_INTRODUCTION = re.compile(r"^\s*(on\b.*\bwrote:|.*\ba écrit\s*:|.*\bschrieb\b.*:|.*\bescribió:)\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """(level, text) of each line."""
    out = []
    for line in text.split("\n"):
        marks, rest = _MARKS.match(line).groups()
        out.append((marks.count(">"), rest if marks else line))
    return out


def normal(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def key(text: str) -> bytes:
    return hashlib.blake2b(normal(text).encode(), digest_size=16).digest()


def parts(text: str) -> list[str]:
    """The text, its paragraphs, lines and sentences, each once."""
    paragraphs = _PARAGRAPH.split(text)
    found = [text, *paragraphs, *text.split("\n"), *(s for p in paragraphs for s in _SENTENCE.split(p))]
    return list(dict.fromkeys(s for s in map(normal, found) if s))


def parse(text: str) -> tuple[str, list[tuple[int, str]], list[str]]:
    """The text without quotations and their introductions; the quoted passages (level, text); what the message says: the parts of its own text and of each own run, normalised."""
    lines = levels(text)
    quoted: list[tuple[int, str]] = []
    own: list[str] = []
    own_runs: list[str] = []
    at = 0
    while at < len(lines):
        to = at
        while to < len(lines) and lines[to][0] == lines[at][0]:
            to += 1
        run = [s for _, s in lines[at:to]]
        if to < len(lines) and lines[to][0] > lines[at][0]:  # what is quoted next may be introduced here
            while run and not run[-1].strip():
                run.pop()
            if run and _INTRODUCTION.match(run[-1]):
                run.pop()
        if lines[at][0]:
            passage = "\n".join(run)
            if normal(passage):
                quoted.append((lines[at][0], passage))
        else:
            own.extend(run)
            own_runs.append("\n".join(run))
        at = to
    message = "\n".join(own).strip("\n") if quoted else text
    said = dict.fromkeys(s for t in ([message, *own_runs] if len(own_runs) > 1 else [message]) for s in parts(t))
    return message, quoted, list(said)


_QUOTE = pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("parts", pa.list_(pa.struct([("hash", pa.binary()), ("size", pa.int64())])))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in pieces(b, "text")):
        messages, quotes, said = [], [], []
        for text in batch.column("text").to_pylist():
            if text is None:
                messages.append(None)
                quotes.append([])
                said.append([])
                continue
            message, quoted, sayings = parse(text)
            messages.append(message)
            quotes.append([{"level": n, "hash": key(q), "parts": [{"hash": key(x), "size": len(x)} for x in parts(q)]} for n, q in quoted])
            said.append(list(dict.fromkeys(map(key, sayings))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array(messages, pa.string()), pa.array(quotes, pa.list_(_QUOTE)), pa.array(said, pa.list_(pa.binary()))],
            ["conv", "turn", "role", "message", "quotes", "said"],
        )


#: Turns of a block, and blocks of a block of the next level.
WIDTH = 1024


def last_earlier(asked: DataFrame, said: DataFrame) -> DataFrame:
    """Of (conv, hash, turn) and (conv, hash, turn): asked's distinct rows with said_turn, the greatest turn of said that is less; rows without one are left out."""
    events = asked.select("conv", "hash", "turn", F.lit(None).cast("bigint").alias("said"), F.lit(True).alias("asks")).unionAll(
        said.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").select("conv", "hash", "turn", F.col("turn").alias("said"), F.lit(False).alias("asks"))
    )
    group = ["conv", "hash"]
    level = stored(events.groupBy(*group, F.col("turn").alias("block")).agg(F.max("said").alias("said"), F.max("asks").alias("asks")))
    low, high = level.agg(F.min("block"), F.max("block")).first()
    levels = []
    while low is not None:
        top = high - low < WIDTH
        within = Window.partitionBy(*group, *([] if top else ["parent"])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("parent", F.floor(F.col("block") / WIDTH))
        levels.append(stored(level.where("asks").select(*group, "block", "parent").join(level.select(*group, "block", F.max("said").over(within).alias("before")), [*group, "block"])))
        if top:
            break
        level = stored(level.groupBy(*group, F.col("parent").alias("block")).agg(F.max("said").alias("said"), F.max("asks").alias("asks")))
        low, high = low // WIDTH, high // WIDTH
    if not levels:
        return asked.select(*group, "turn", F.col("turn").alias("said_turn")).limit(0)
    found = levels.pop().drop("parent")
    for finer in reversed(levels):  # what a block has not seen, the blocks before it may have
        above = found.select(*group, F.col("block").alias("parent"), F.col("before").alias("above"))
        found = finer.join(above, [*group, "parent"], "left").select(*group, "block", F.coalesce("before", "above").alias("before"))
    return found.where("before IS NOT NULL").select(*group, F.col("block").alias("turn"), F.col("before").alias("said_turn"))


def link(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, root_turn, turn, role, message, n_quotes, n_linked, reply_to: a row for each row of conversations.

    message is the text without quotations; reply_to is the last earlier turn that says the first
    linked passage of the lowest level, as a whole or else by most characters of its parts (then the
    later turn, where two say as much), null if no passage is linked; root_turn is where following
    reply_to ends (the turn itself without a link).  Sorting by the first three columns is reply order.
    Null texts have a null message and no quotation.  Rows without a conversation or turn keep their
    message and are not linked.  Rows that repeat a turn share what any of them says.
    """
    source = conversations.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").alias("text"))
    parsed = stored(map_arrow(source, _parse, "conv bigint, turn bigint, role string, message string, quotes array<struct<level:int,hash:binary,parts:array<struct<hash:binary,size:bigint>>>>, said array<binary>"))
    passage = ["conv", "turn", "n", "level", "passage"]
    quoted = parsed.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.posexplode("quotes").alias("n", "q")).select("conv", "turn", "n", "q.level", F.col("q.hash").alias("passage"), F.explode("q.parts").alias("p"))
    quoted = stored(quoted.select(*passage, "p.hash", "p.size").distinct())
    sayings = parsed.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", F.explode("said").alias("hash"), "turn")
    found = quoted.join(last_earlier(quoted.select("conv", "hash", "turn"), sayings), ["conv", "hash", "turn"])
    by_turn = found.groupBy(*passage, "said_turn").agg(F.max(F.col("hash") == F.col("passage")).alias("whole"), F.sum("size").alias("size"))
    found = by_turn.groupBy(*passage).agg(F.max_by("said_turn", F.struct("whole", "size", "said_turn")).alias("said_turn"))
    links = stored(found.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.min_by("said_turn", F.struct("level", "n")).alias("reply_to")))
    # Pointer jumping: every round halves the way to the root.
    up = stored(links.select("conv", "turn", F.col("reply_to").alias("root")))
    while True:
        step = up.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        ahead = stored(up.join(step, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            break
        up = ahead.drop("moved")
    rows = parsed.select("conv", "turn", "role", "message", F.size("quotes").alias("n_quotes"))
    out = rows.join(links.join(up, ["conv", "turn"]), ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv), F.coalesce("root", "turn").alias("root_turn"), F.col("turn").alias(turn), F.col("role").alias(role), "message", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations"))
