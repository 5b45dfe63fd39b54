"""Mentions, and the entities that they name.

Every surface form is registered when it is first met, so what a form is matched with depends only on
the forms before it.  Linking is then a chain of joins over distinct forms: by normal form, by form
without marks, by spelling within blocks, and pointers are followed to their root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsearch.functions import text, vectors
from graphsearch.functions.constants import NEVER_MATCHED, SEED_ALIASES
from graphsearch.operators import graph
from graphsearch.storage import stored

NAME = r"\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*"


def regex_mentions(documents: DataFrame, id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, mention_ord, text, type, score): runs of capitalised words, each distinct one once by document, in order."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(NAME), F.lit(0)))
    return documents.select(F.col(id).alias("doc_id"), F.posexplode(found).alias("mention_ord", "text")).select("doc_id", F.col("mention_ord").cast("bigint").alias("mention_ord"), "text", F.lit("MISC").alias("type"), F.lit(0.70).alias("score"))


def seed_aliases(spark) -> DataFrame:
    rows = [(a, c, k) for k, (a, c) in enumerate(SEED_ALIASES)]
    df = spark.createDataFrame(rows, "alias string, canonical string, ord int")
    return df.select(text.link_form(F.col("alias")).alias("norm"), text.unmarked(text.link_form(F.col("alias"))).alias("nodiac"), "canonical", text.entity_slug(F.col("canonical")).alias("entity_id"), "ord")


def exact_link(mentions: DataFrame, aliases: DataFrame, surface: str = "text") -> DataFrame:
    """Mentions with entity_id and match_type by normal form, else by form without marks (the alias registered last)."""
    by_norm = aliases.groupBy("norm").agg(F.max_by("entity_id", "ord").alias("by_norm"))
    by_plain = aliases.groupBy("nodiac").agg(F.max_by("entity_id", "ord").alias("by_plain"))
    m = mentions.withColumn("norm", text.link_form(F.col(surface))).withColumn("nodiac", text.unmarked(F.col("norm")))
    joined = m.join(by_norm, "norm", "left").join(by_plain, "nodiac", "left")
    return joined.select(*mentions.columns, F.coalesce("by_norm", "by_plain").alias("entity_id"), F.when(F.col("by_norm").isNotNull(), "exact").when(F.col("by_plain").isNotNull(), "exact_nodiac").alias("match_type"))


def spelled_alike(form: Column, other: Column) -> Column:
    """Within the number of edits that lengths allow: 1 below 8 characters, 2 from there."""
    longest = F.greatest(F.length(form), F.length(other))
    return F.when((F.length(form) >= 4) & (F.length(other) >= 4) & (F.abs(F.length(form) - F.length(other)) <= 2), F.levenshtein(form, other, 2).between(0, 2) & (F.levenshtein(form, other, 2) <= F.when(longest < 8, 1).otherwise(2))).otherwise(F.lit(False))


def fuzzy_pairs(forms: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Of forms(form, ord): (form, matched, distance): the earlier form that is spelled most alike (least distance, largest similarity, least ord); of wanted(form, ord) among them only, if that is given.

    Two forms within two edits share their first character by rule, and one of the three parts of
    either by need: both make equality keys, so that a frequent first letter is no one block.
    """
    # A string within 2 edits keeps one of its 3 parts, moved by 2 places at most.
    n = F.length("form")
    third = lambda k: F.floor(n * k / 3).cast("int")
    part = lambda k: F.struct(F.lit(k).alias("part"), third(k).alias("at"), F.substr(F.col("form"), third(k) + 1, third(k + 1) - third(k)).alias("piece"))
    long_enough = lambda df: df.where(n >= 4).withColumn("first", F.substring("form", 1, 1)).withColumn("n", n)
    pieces = long_enough(forms).select(F.col("form").alias("other"), F.col("ord").alias("other_ord"), "first", "n", F.explode(F.array(part(0), part(1), part(2))).alias("p")).select("other", "other_ord", "first", "n", "p.part", "p.piece")
    lengths = long_enough(forms if wanted is None else wanted).select("form", "ord", "first", F.explode(F.sequence(F.greatest(F.col("n") - 2, F.lit(4)), F.col("n") + 2)).alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    # Every piece of the probing form that could be a part of a form of length n.
    probes = lengths.select("form", "ord", "first", "n", k.alias("part"))
    begin, end = F.floor(F.col("n") * F.col("part") / 3).cast("int"), F.floor(F.col("n") * (F.col("part") + 1) / 3).cast("int")
    probes = probes.select("form", "ord", "first", "n", "part", (end - begin).alias("size"), F.explode(F.sequence(F.greatest(begin - 2, F.lit(0)), begin + 2)).alias("from"))
    probes = probes.select("form", "ord", "first", "n", "part", F.substr(F.col("form"), F.col("from") + 1, F.col("size")).alias("piece")).distinct()
    pairs = pieces.join(probes, ["first", "n", "part", "piece"]).where("other_ord < ord AND form <> other").where(spelled_alike(F.col("form"), F.col("other")))
    both = pairs.select("form", "ord", "other", "other_ord").distinct()
    never = forms.sparkSession.createDataFrame([(a, b) for a, b in NEVER_MATCHED] + [(b, a) for a, b in NEVER_MATCHED], "a string, b string").select(text.link_form(F.col("a")).alias("form"), text.link_form(F.col("b")).alias("other"))
    alike = both.join(never, ["form", "other"], "left_anti")
    scored = alike.withColumn("distance", F.levenshtein("form", "other")).withColumn("sim", 1 - F.col("distance") / F.greatest(F.length("form"), F.length("other")))
    return scored.groupBy("form").agg(F.min_by("other", F.struct("distance", -F.col("sim"), "other_ord")).alias("matched"), F.min("distance").cast("bigint").alias("distance"))


SIMILAR = 0.80


def vector_pairs(forms: DataFrame, least: float = SIMILAR, encode=vectors.encode) -> DataFrame:
    """Of forms(form, ord): (form, matched, cosine): the earlier form whose vector is nearest, with at least that cosine; the earliest of equals.

    Forms with one vector are compared as one, by their first, and all but the first are matched
    with it or an earlier form in its direction.  So the work is that of distinct vectors.
    """
    numbered = stored(forms.select("form", "ord", encode(F.col("form")).alias("embedding")).withColumn("id", F.xxhash64("embedding")))
    first = F.min(F.struct("ord", "form")).alias("f")
    classes = stored(numbered.groupBy("id").agg(first, F.first("embedding").alias("embedding")).select("id", "f.ord", "f.form", "embedding"))
    near = graph.similarity_edges(classes, least, "id")
    pairs = near.unionAll(near.select("obj", "subj", "cosine"))
    side = lambda p: classes.select(F.col("id").alias(f"{p}_id"), F.col("form").alias(p), F.col("ord").alias(f"{p}_ord"))
    met = pairs.join(side("form"), F.col("subj") == F.col("form_id")).join(side("other"), F.col("obj") == F.col("other_id")).where("other_ord < form_ord")
    one = lambda cosine, o, matched: F.struct((-F.round(cosine, 9)).alias("d"), F.col(o).alias("o"), F.col(matched).alias("matched"))
    best = met.groupBy("form_id").agg(F.min(one(F.col("cosine"), "other_ord", "other")).alias("earlier"))
    v = vectors.normalized(F.col("embedding"))
    own = F.when(vectors.dot(v, v) >= least, one(vectors.dot(v, v), "ord", "form"))
    found = classes.join(best, F.col("id") == F.col("form_id"), "left").select("id", F.col("form").alias("head"), "earlier", F.least(own, "earlier").alias("later"))
    b = F.when(F.col("form") == F.col("head"), F.col("earlier")).otherwise(F.col("later"))
    return numbered.select("form", "id").join(found, "id").withColumn("b", b).where("b IS NOT NULL").select("form", "b.matched", (-F.col("b.d")).alias("cosine"))


def _followed(up: DataFrame) -> DataFrame:
    """Of (form, root): root as the end of the chain; every round halves the way and is written."""
    while True:
        step = up.select(F.col("form").alias("root"), F.col("root").alias("next"))
        ahead = stored(up.join(step, "root", "left").select("form", F.col("root").alias("was"), F.coalesce("next", "root").alias("root")))
        up = ahead.drop("was")
        if ahead.where("was <> root").isEmpty():
            return up


def _chains(heads: DataFrame, least: float | None, encode) -> DataFrame:
    """Of heads(head, ord): (head, root, how, similarity): what each is matched with first (by vector, then by spelling), and the end of its chain."""
    forms = stored(heads.select(F.col("head").alias("form"), "ord"))
    if least is not None:
        matched = stored(forms.join(vector_pairs(forms, least, encode).select("form", F.col("matched").alias("by_vector"), "cosine"), "form", "left"))
        wanted = matched.where("by_vector IS NULL").select("form", "ord")
    else:
        matched = forms.withColumns({"by_vector": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
        wanted = None
    spelled = fuzzy_pairs(forms, wanted).select("form", F.col("matched").alias("by_spelling"), "distance")
    matched = matched.join(spelled, "form", "left")
    how = F.when(F.col("by_vector").isNotNull(), "embedding").when(F.col("by_spelling").isNotNull(), "levenshtein").otherwise("new")
    longest = F.greatest(F.length("form"), F.length("by_spelling"))
    similarity = F.when(F.col("by_vector").isNotNull(), F.round("cosine", 4)).when(F.col("by_spelling").isNotNull(), 1 - F.col("distance") / longest).otherwise(F.lit(1.0))
    first = stored(matched.select("form", F.coalesce("by_vector", "by_spelling", "form").alias("root"), how.alias("how"), similarity.alias("similarity")))
    return _followed(first.select("form", "root")).join(first.select("form", "how", "similarity"), "form").withColumnRenamed("form", "head")


def link_forms(mentions: DataFrame, surface: str = "text", order: tuple[str, ...] = ("doc_id", "mention_ord")) -> DataFrame:
    """(form, root): each distinct normal form and the form whose entity it names, by exact forms and by spelling."""
    forms = mentions.select(text.link_form(F.col(surface)).alias("form"), F.struct(*order).alias("ord")).where("form <> ''").groupBy("form").agg(F.min("ord").alias("ord"))
    plain = stored(forms.withColumn("plain", text.unmarked(F.col("form"))))
    heads = plain.groupBy("plain").agg(F.min_by("form", "ord").alias("head"), F.min("ord").alias("ord"))
    return plain.join(heads.select("plain", "head"), "plain").join(_chains(heads, None, None), "head").select("form", "root")


def link_mentions(mentions: DataFrame, aliases: DataFrame | None = None, least: float | None = SIMILAR, encode=vectors.encode, surface: str = "text", order: tuple[str, ...] = ("doc_id", "mention_ord")) -> DataFrame:
    """mentions with entity_id, canonical, similarity, match_type; mentions without a letter or digit go.

    As if mentions came one by one: the first with a form is matched by vector (embedding), else by
    spelling (levenshtein), with an earlier form or a known alias (canonical, norm, entity_id, ord), else it is
    new and gives the entity its name; any later one, and one of a known alias, is exact.
    """
    m = mentions.withColumn("norm", text.link_form(F.col(surface))).where("norm <> ''").withColumn("plain", text.unmarked(F.col("norm")))
    m = stored(m.withColumn("ord", F.struct(F.lit(1).alias("later"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))))
    types = [f.dataType for f in m.schema["ord"].dataType.fields]
    met = m.select("plain", "norm", "ord", F.trim(surface).alias("name"), F.lit(None).cast("string").alias("known_id"))
    if aliases is not None:
        at = F.lpad(F.col("ord").cast("string"), 10, "0")
        place = F.struct(F.lit(0).alias("later"), at.cast(types[1]).alias("o0"), *(F.lit(0).cast(t).alias(f"o{k + 1}") for k, t in enumerate(types[2:])))
        met = met.unionByName(aliases.select(F.col("nodiac").alias("plain"), "norm", place.alias("ord"), F.col("canonical").alias("name"), F.col("entity_id").alias("known_id")))
    heads = stored(met.groupBy("plain").agg(F.min(F.struct("ord", "norm", "name", "known_id")).alias("f")).select("plain", "f.ord", F.col("f.norm").alias("head"), "f.name", "f.known_id"))
    chains = _chains(heads, least, encode)
    names = heads.select(F.col("head").alias("root"), F.col("name").alias("canonical"), F.coalesce("known_id", text.entity_slug(F.col("name"))).alias("entity_id"))
    resolved = heads.select("plain", "head", F.col("ord").alias("first")).join(chains, "head").join(names, "root")
    joined = m.join(resolved, "plain")
    fresh = F.col("ord") == F.col("first")
    return joined.select(*(F.col(f"`{c}`") for c in mentions.columns), "entity_id", "canonical", F.when(fresh, F.col("similarity")).otherwise(F.lit(1.0)).alias("similarity"), F.when(fresh, F.col("how")).otherwise("exact").alias("match_type"))


def aliases_of(linked: DataFrame, surface: str = "text") -> DataFrame:
    """(norm, nodiac, canonical, entity_id, ord): the alias table that linked mentions leave; seeds come first."""
    norm = text.link_form(F.col(surface))
    made = linked.groupBy(norm.alias("norm")).agg(F.min(F.struct("entity_id", "canonical")).alias("e"))
    made = made.select("norm", text.unmarked(F.col("norm")).alias("nodiac"), "e.canonical", "e.entity_id", (F.abs(F.xxhash64("norm")) % 1_000_000_000 + 1_000).cast("int").alias("ord"))
    return seed_aliases(linked.sparkSession).select("norm", "nodiac", "canonical", "entity_id", "ord").unionByName(made)


def add_alias(aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """aliases with one more, of the entity that the canonical name has."""
    spark = aliases.sparkSession
    last = aliases.agg(F.max("ord").alias("last"))
    one = spark.createDataFrame([(alias, canonical)], "alias string, canonical string").crossJoin(last)
    norm = text.link_form(F.col("alias"))
    return aliases.unionByName(one.select(norm.alias("norm"), text.unmarked(norm).alias("nodiac"), "canonical", text.entity_slug(F.col("canonical")).alias("entity_id"), (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("ord")))


def merge_links(linked: DataFrame) -> DataFrame:
    """Of (doc_id, entity_id, type, text, score, match_type, ord): one row for each entity and type of a document: its first text and match type, largest score, and the distinct texts in order (ord, text, match type)."""
    order = F.struct("ord", "text", "match_type")
    first = F.array_sort(F.collect_list(order))
    return linked.groupBy("doc_id", "entity_id", "type").agg(
        F.min(order).alias("f"), F.max("score").alias("link_score"), F.array_distinct(F.transform(first, lambda x: x["text"])).alias("aliases")
    ).select("doc_id", "entity_id", "type", "f.text", "link_score", "f.match_type", "aliases")
