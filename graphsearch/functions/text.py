"""Text functions as columns; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphsearch.functions import constants as K

LETTER = r"[A-Za-zÀ-ỹĐđ]"


def normalize(c: Column) -> Column:
    """Without control characters, white space as single spaces, trimmed."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))


def strip_byline(c: Column) -> Column:
    """Without a last line that looks like an author or a byline; lines are trimmed and blank ones go."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    tail = F.try_element_at(lines, F.lit(-1))
    tokens = F.split(tail, r"(?U)\s+")
    name = F.forall(tokens, lambda t: t.rlike(r"^[A-ZÀ-ỸĐ][A-Za-zÀ-ỹĐđ.-]*$") | ((F.upper(t) == t) & t.rlike(r"\p{Lu}")))
    author = (F.length(tail) <= 60) & (F.size(tokens) <= 6) & ~tail.rlike(r"[.!?]$") & name
    byline = tail.rlike(r"^(?:Theo|theo)(?U:\s+)[A-ZÀ-ỸĐ].{1,50}$")
    kept = F.when(author | byline, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.when(F.size(lines) < 2, F.trim(c)).otherwise(F.array_join(kept, "\n"))


def viet_ratio(c: Column) -> Column:
    """Accented Vietnamese letters among all letters; 0 without letters."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[{K.ACCENTED}]")) / F.nullif(F.regexp_count(c, F.lit(LETTER)), F.lit(0)), F.lit(0.0))


def link_form(c: Column) -> Column:
    """Lower case, anything but word characters as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def unmarked(c: Column) -> Column:
    return F.translate(c, K.MARKED, K.UNMARKED)


def entity_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(unmarked(link_form(c)), " ", "_"), r"[^A-Za-z0-9_]", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("entity"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(c: Column, least: int = 10) -> Column:
    """Split after . ! ? … and white space; short ones go."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?…])(?U:\s+)"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def loose_sentences(c: Column) -> Column:
    """Split after . ! ? and white space, as they are."""
    return F.split(F.trim(c), r"(?<=[.!?])(?U:\s+)")


def sentence_runs(c: Column, ends: str = ".!?…", least: int = 10) -> Column:
    """Runs up to an end mark, trimmed, with at least so many characters."""
    found = F.regexp_extract_all(c, F.lit(f"[^{ends}]+[{ends}]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) >= least)


def sentence_spans(c: Column, ends: str = ".!?…", least: int = 10) -> Column:
    """(sentence_id, start, end, text) of the runs up to an end mark; ids are dense, offsets those of the trimmed text."""
    empty = F.expr("cast(array() as array<struct<sentence_id:int,start:int,end:int,text:string>>)")
    found = F.regexp_extract_all(c, F.lit(f"[^{ends}]+[{ends}]?|[{ends}]"), F.lit(0))

    def step(a: Column, s: Column) -> Column:
        lead = F.length(s) - F.length(F.regexp_replace(s, r"(?U)^\s+", ""))
        body = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
        one = F.struct(F.size(a["out"]).alias("sentence_id"), (a["at"] + lead).cast("int").alias("start"), (a["at"] + lead + F.length(body)).cast("int").alias("end"), body.alias("text"))
        real = (F.length(body) >= least) & ~s.rlike(f"^[{ends}]$")
        return F.struct((a["at"] + F.length(s)).alias("at"), F.when(real, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def keywords(c: Column) -> Column:
    """Tokens but stopwords and single characters, in order."""
    stop = F.array(*(F.lit(w) for w in K.STOPWORDS))
    words = F.split(link_form(c), " ")
    return F.filter(words, lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))


def topic(c: Column) -> Column:
    """The topic with most words that occur anywhere in the text; the first of equals, null without any."""
    low = F.lower(c)
    scored = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("topic")) for k, (name, words) in enumerate(K.TOPICS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["topic"])


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)\b(20\d{2}|19\d{2})\b", 1), F.lit(""))


def intent(c: Column) -> Column:
    timely = c.rlike(rf"(?iU)\b(?:{K.TEMPORAL})\b")
    brief = year(c).isNotNull() & (F.size(F.split(F.trim(c), r"(?U)\s+")) <= 3)
    return F.when(timely | brief, F.lit("temporal_query")).otherwise(F.lit("news_search"))


def guess_source(url: Column) -> Column:
    return F.when(F.contains(F.lower(url), F.lit("vnexpress.net")), F.lit("VnExpress")).otherwise(F.lit(""))


def soft_match(a: Column, b: Column) -> Column:
    """Of normalised texts: equal, the one with fewer tokens inside the other if it has two or more, or a token of it if it is one of at most 6 characters."""
    n_a, n_b = F.size(F.split(a, " ")), F.size(F.split(b, " "))
    short, long, n = F.when(n_a <= n_b, a).otherwise(b), F.when(n_a <= n_b, b).otherwise(a), F.least(n_a, n_b)
    return (a != "") & (b != "") & ((a == b) | (F.contains(long, short) & (n >= 2)) | ((n == 1) & (F.length(short) <= 6) & F.array_contains(F.split(long, " "), short)))


def soft_match_by_length(a: Column, b: Column) -> Column:
    """Of normalised texts: equal, or the one of fewer characters inside the other if it has two tokens or more."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | (F.contains(long, short) & (F.size(F.split(short, " ")) >= 2)))


def pseudo_queries(title: Column, text: Column, category: Column) -> Column:
    """Questions that an article answers: its title, first sentence, and its title with an object asked for; distinct but for case, in order."""
    lead = F.trim(F.split(F.trim(text), r"\.")[0])
    asked = [
        F.when(title.rlike(r"(?iU)ký kết|hợp tác|thỏa thuận"), F.regexp_replace(title, r"(?U)(ký kết|hợp tác|thỏa thuận)\s+\S+", "$1 gì?")),
        F.when(title.rlike(r"(?U)tăng\s+[\d,]+%?"), F.regexp_replace(title, r"(?U)tăng\s+[\d,]+%?", "tăng bao nhiêu?")),
        F.when(title.rlike(r"(?iU)bổ nhiệm|bầu|phong|chọn"), F.regexp_replace(title, r"(?U)(bổ nhiệm|bầu|phong|chọn)\s+\S+", "$1 ai?")),
        F.when(category != "", F.concat_ws(" ", title, category)),
    ]
    every = F.array(F.when(F.length(title) > 5, title), F.when((F.length(lead) > 10) & (lead != title), lead), *asked)
    given = F.filter(F.transform(every, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    low = F.transform(given, lambda q: F.lower(q))
    return F.filter(given, lambda q, i: F.array_position(low, F.lower(q)) == i + 1)


@lru_cache
def _normal(form: str):
    @F.arrow_udf("string")
    def normal(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in c.to_pylist()], pa.string())

    return normal


def composed(c: Column) -> Column:
    """NFC, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_normal("NFC")(c), r"(?U)\s+", " "))


def evaluation_form(c: Column) -> Column:
    """NFKC, lower case, anything but word characters as spaces, single spaces."""
    return link_form(_normal("NFKC")(c))


def unmarked_any(c: Column) -> Column:
    """Without combining marks after decomposition, whatever the script; letters that don't decompose stay."""
    return F.regexp_replace(_normal("NFKD")(c), r"\p{M}+", "")


def segment(c: Column, tool=None) -> Column:
    """Words of several syllables joined by underscores, by an Arrow function of a plug-in; as it is without one."""
    return c if tool is None else tool(c)


def desegment(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def numbered_spans(c: Column) -> Column:
    """(sentence_id, start, end, text) of all runs up to . ! or ?, trimmed, of any length; ids count blank runs, which are left out."""
    empty = F.expr("cast(array() as array<struct<sentence_id:int,start:int,end:int,text:string>>)")
    # Runs of marks alone belong to no sentence but take up room.
    found = F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]?|[.!?]"), F.lit(0))

    def step(a: Column, s: Column) -> Column:
        lead = F.length(s) - F.length(F.regexp_replace(s, r"(?U)^\s+", ""))
        body = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
        run = ~s.rlike(r"^[.!?]$")
        one = F.struct(a["id"].alias("sentence_id"), (a["at"] + lead).cast("int").alias("start"), (a["at"] + lead + F.length(body)).cast("int").alias("end"), body.alias("text"))
        return F.struct((a["at"] + F.length(s)).alias("at"), (a["id"] + run.cast("int")).alias("id"), F.when(run & (body != ""), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit(0).alias("id"), empty.alias("out")), step, lambda a: a["out"])


def seeds_or_keywords(entities: Column, keywords: Column, most: int = 5, fallback: int = 3) -> Column:
    """The first entities, or without any the first keywords."""
    return F.when(F.size(entities) > 0, F.slice(entities, 1, most)).otherwise(F.slice(keywords, 1, fallback))


def explain(row: dict) -> str:
    """An analysed and expanded query as lines of text."""
    lines = [f"query: {row.get('normalized') or ''}"]
    lines += [f"{name}: {', '.join(map(str, row[name]))}" for name in ("keywords", "entities", "seeds", "hop1", "hop2") if row.get(name)]
    lines += [f"{name}: {row[name]}" for name in ("topic", "year_filter", "intent") if row.get(name)]
    return "\n".join(lines)
