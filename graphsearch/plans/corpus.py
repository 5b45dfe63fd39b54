"""Queries on texts: cleaning, splitting, chunks, mentions, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphsearch import storage
from graphsearch.functions import constants as K
from graphsearch.functions import dates, text, vectors
from graphsearch.operators import chunking, clean, linking, training
from graphsearch.plans.registry import query, table
from graphsearch.sources import html, tables

#: DuckDB's form of the articles of documents, cleaned.
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x{0085}]+"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '{_WS}', ' ', 'g'))"


_FIRST = "split_part(coalesce(text, ''), chr(10), 1)"
_REST = "CASE WHEN contains(text, chr(10)) THEN text[position(chr(10) IN text) + 1:] ELSE '' END"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 10)"


@query(f"""
WITH a AS (SELECT doc_id AS ord, source || '/' || doc_id AS url, {_norm(_FIRST)} AS title, {_norm(_REST)} AS content FROM documents)
SELECT ord, title, content, 'doc_' || substr(sha256(url), 1, 16) AS id, CASE WHEN title = '' THEN 'missing_title' WHEN content = '' THEN 'missing_content' END AS reason FROM a
""")
def clean_normalize(spark, sf):
    a = clean.documents_as_articles(table(spark, sf, "documents"))
    return a.select("ord", text.normalize(F.col("title")).alias("title"), text.normalize(F.col("content")).alias("content"), "url").select(
        "ord", "title", "content", clean.doc_key(F.col("url"), F.col("title")).alias("id"), F.when(F.col("title") == "", "missing_title").when(F.col("content") == "", "missing_content").alias("reason")
    )


_ACC = f"[{K.ACCENTED}]"


@query(f"""
WITH r AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '{_ACC}')) AS a, len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ỹĐđ]')) AS b FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (b > 0 AND a / b >= 0.05) AS n_kept, round(avg(CASE WHEN b > 0 THEN a / b ELSE 0 END), 6) AS mean_ratio FROM r GROUP BY lang
""")
def lang_ratio_filter(spark, sf):
    d = table(spark, sf, "documents").select("lang", text.viet_ratio(F.coalesce("text", F.lit(""))).alias("r"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("r") >= 0.05).alias("n_kept"), F.round(F.avg("r"), 6).alias("mean_ratio"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first_seen(spark, sf):
    return clean.first_seen(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "source")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_summary(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("summary_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM summary_documents GROUP BY GROUPING SETS ((lang), (source), ())")


_NAMES = [("Câu một.\nNguyễn Văn A", "a"), ("Câu một.\nTheo Reuters", "b"), ("Nguyễn Văn A", "c"), ("Câu một.\n\n  Hai dòng. \nMột câu dài hơn.", "d")]


@query(
    r"""WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '') AS l, coalesce(text, '') AS t FROM documents),
tails AS (SELECT *, l[-1] AS tail, string_split_regex(l[-1], '\s+') AS tok FROM lines),
f AS (SELECT *, len(tail) <= 60 AND len(tok) <= 6 AND NOT regexp_matches(tail, '[.!?]$') AND len(list_filter(tok, lambda x: NOT (regexp_full_match(x, '[A-ZÀ-ỸĐ][A-Za-zÀ-ỹĐđ.-]*') OR (upper(x) = x AND regexp_matches(x, '\p{Lu}'))))) = 0 AS author,
  regexp_full_match(tail, '(?:Theo|theo)\s+[A-ZÀ-ỸĐ].{1,50}') AS byline FROM tails)
SELECT doc_id, CASE WHEN len(l) < 2 THEN 0 WHEN author OR byline THEN 1 ELSE 0 END AS n_stripped, md5(CASE WHEN len(l) < 2 THEN trim(t) WHEN author OR byline THEN array_to_string(l[1:len(l) - 1], chr(10)) ELSE array_to_string(l, chr(10)) END) AS body_md5 FROM f"""
)
def byline_strip(spark, sf):
    body = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    kept = text.strip_byline(body)
    n = F.when(F.size(lines) < 2, 0).otherwise(F.size(lines) - F.size(F.split(kept, "\n")))
    return table(spark, sf, "documents").select("doc_id", n.alias("n_stripped"), F.md5(kept).alias("body_md5"))


@query("""
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, 'Thứ sáu, %-d/%-m/%Y, 18:15 (GMT+7)') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE 'hôm qua' END AS s, o_orderdate FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'hôm qua' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM o
""")
def date_parse(spark, sf):
    d = F.col("o_orderdate")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Thứ sáu, "), F.dayofmonth(d), F.lit("/"), F.month(d), F.lit("/"), F.year(d), F.lit(", 18:15 (GMT+7)")))
    s = s.when(F.col("o_orderkey") % 3 == 1, F.concat_ws("-", F.year(d), F.month(d), F.dayofmonth(d))).otherwise("hôm qua")
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(s).alias("parsed"))


@query("SELECT page_id, 'doc_' || substr(sha256(url), 1, 16) AS id, sha1(url) AS cache_key FROM pages")
def doc_id_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean.doc_key(F.col("url"), F.lit("")).alias("id"), F.sha1("url").alias("cache_key"))


@query("SELECT count(*) AS n, (sum(('0x' || substr(md5(page_id::VARCHAR), 1, 12))::BIGINT))::VARCHAR AS fingerprint FROM pages")
def corpus_fingerprint(spark, sf):
    return clean.fingerprint(table(spark, sf, "pages"), "page_id")


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES.format(x="coalesce(text, '')")} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS all_md5 FROM s""")
def sentence_split_chunker(spark, sf):
    s = text.sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("all_md5"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]?'), lambda s: trim(s, chr(9) || chr(10) || chr(13) || ' ')), lambda s: length(s) > 10) AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS all_md5 FROM s""")
def sentence_runs(spark, sf):
    s = text.sentence_runs(F.coalesce("text", F.lit("")), ".!?", 11)
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("all_md5"))


_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_LINK = r"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, list_filter(string_split({_LINK.format(x='text')}, ' '), lambda t: NOT list_contains([{_STOP}], t) AND length(t) > 1) AS keywords FROM conversations WHERE role = 'user'")
def keywords(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.keywords(F.col("text")).alias("keywords"))


_ASKED = ["giá vàng 2024", "chiến tranh nga ukraine 2024", "NATO", "tin mới nhất về covid", "bầu cử tổng thống hôm nay", "AI và startup", "học sinh đại học", "trong 3 ngày qua có gì", "kinh tế 1999 thị trường"]
_TOPIC_SQL = ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in K.TOPICS.values())
_TOPIC_NAMES = ", ".join(f"'{t}'" for t in K.TOPICS)


@query(rf"""
WITH q AS (SELECT conv_id AS qid, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - (i - 1), x FROM (SELECT unnest([{", ".join(f"'{q}'" for q in _ASKED)}]) AS x, unnest(range(1, {len(_ASKED) + 1})) AS i)),
n AS (SELECT qid, q, list_transform([{_TOPIC_SQL}], lambda ws: len(list_filter(ws, lambda w: contains(lower(q), w)))) AS c FROM q)
SELECT qid, q, CASE WHEN list_max(c) > 0 THEN [{_TOPIC_NAMES}][list_position(c, list_max(c))] END AS topic,
  nullif(regexp_extract(q, '(?:^|[^\p{{L}}\p{{N}}_])(20\d{{2}}|19\d{{2}})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS year,
  CASE WHEN regexp_matches(lower(q), '(?:^|[^\p{{L}}\p{{N}}_])(?:{K.TEMPORAL})(?:$|[^\p{{L}}\p{{N}}_])') OR (regexp_matches(q, '(?:^|[^\p{{L}}\p{{N}}_])(20\d{{2}}|19\d{{2}})(?:$|[^\p{{L}}\p{{N}}_])') AND len(string_split_regex(trim(q), '\s+')) <= 3) THEN 'temporal_query' ELSE 'news_search' END AS intent
FROM n
""")
def topic_year_intent(spark, sf):
    extra = spark.createDataFrame([(-1 - k, q) for k, q in enumerate(_ASKED)], "qid bigint, q string")
    q = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("qid"), F.col("text").alias("q")).unionAll(extra)
    return q.select("qid", "q", text.topic(F.col("q")).alias("topic"), text.year(F.col("q")).alias("year"), text.intent(F.col("q")).alias("intent"))


_PLAIN = f"translate({{x}}, '{K.MARKED}', '{K.UNMARKED}')"
_PLACES = ["Đà Nẵng", "Liên Hợp Quốc", "!!!", "SARS-CoV-2"]


@query(rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '\p{{Lu}}\p{{L}}+')) AS name FROM documents UNION SELECT unnest([{", ".join(f"'{p}'" for p in _PLACES)}])),
f AS (SELECT name, {_LINK.format(x="name")} AS form FROM w)
SELECT name, form, {_PLAIN.format(x="form")} AS plain, coalesce(nullif(regexp_replace(replace({_PLAIN.format(x="form")}, ' ', '_'), '[^A-Za-z0-9_]', '', 'g'), ''), 'entity') AS slug FROM f
""")
def entity_slug(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("name"))
    w = w.unionAll(spark.createDataFrame([(p,) for p in _PLACES], "name string")).distinct()
    form = text.link_form(F.col("name"))
    return w.select("name", form.alias("form"), text.unmarked(form).alias("plain"), text.entity_slug(F.col("name")).alias("slug"))


_MENTIONS = rf"m AS (SELECT doc_id, u.i - 1 AS mention_ord, u.t AS text FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{linking.NAME}') AS all_names FROM documents), LATERAL (SELECT row_number() OVER (ORDER BY min(p)) AS i, t FROM (SELECT unnest(all_names) AS t, generate_subscripts(all_names, 1) AS p) GROUP BY t) u)"


@query(f"WITH {_MENTIONS} SELECT doc_id, mention_ord::BIGINT AS mention_ord, text, 'MISC' AS type, 0.7::DOUBLE AS score FROM m")
def mentions_regex(spark, sf):
    return linking.regex_mentions(table(spark, sf, "documents"))


_SEEDS = ", ".join(f"('{a}', '{c}', {k})" for k, (a, c) in enumerate(K.SEED_ALIASES))
_SURFACES = ["hà nội", "Ha Noi", "HANOI", "usa", "Hoa Ky", "Nga", "Covid", "liên hợp quốc", "un", "Vladimir  Putin"]


@query(rf"""
WITH a AS (SELECT {_LINK.format(x="alias")} AS norm, {_PLAIN.format(x=_LINK.format(x="alias"))} AS plain, coalesce(nullif(regexp_replace(replace({_PLAIN.format(x=_LINK.format(x="canonical"))}, ' ', '_'), '[^A-Za-z0-9_]', '', 'g'), ''), 'entity') AS entity_id, ord FROM (VALUES {_SEEDS}) AS t(alias, canonical, ord)),
m AS (SELECT x AS text, {_LINK.format(x="x")} AS norm, {_PLAIN.format(x=_LINK.format(x="x"))} AS plain FROM (SELECT unnest([{", ".join(f"'{s}'" for s in _SURFACES)}]) AS x)),
j AS (SELECT m.text, (SELECT arg_max(entity_id, ord) FROM a WHERE a.norm = m.norm) AS e1, (SELECT arg_max(entity_id, ord) FROM a WHERE a.plain = m.plain) AS e2 FROM m)
SELECT text, coalesce(e1, e2) AS entity_id, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'exact_nodiac' END AS match_type FROM j
""")
def exact_link(spark, sf):
    return linking.exact_link(spark.createDataFrame([(s,) for s in _SURFACES], "text string"), linking.seed_aliases(spark))


_ALIKE = "abs(length(a.form) - length(b.form)) <= 2 AND levenshtein(a.form, b.form) <= CASE WHEN greatest(length(a.form), length(b.form)) < 8 THEN 1 ELSE 2 END"
_NEVER = " OR ".join(f"(a.form = '{x.lower()}' AND b.form = '{y.lower()}') OR (a.form = '{y.lower()}' AND b.form = '{x.lower()}')" for x, y in K.NEVER_MATCHED)
_WORDS = "f AS (SELECT lower(w) AS form, min(item_id) AS ord FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) GROUP BY 1)"


@query(f"""
WITH {_WORDS},
o AS (SELECT form, row_number() OVER (ORDER BY ord, form) AS ord FROM f),
c AS (SELECT a.form, b.form AS other, levenshtein(a.form, b.form) AS d, 1 - levenshtein(a.form, b.form) / greatest(length(a.form), length(b.form)) AS sim, b.ord FROM o a JOIN o b ON b.ord < a.ord AND substr(a.form, 1, 1) = substr(b.form, 1, 1) AND length(a.form) >= 4 AND length(b.form) >= 4 WHERE {_ALIKE} AND NOT ({_NEVER}))
SELECT form, first(other ORDER BY d, -sim, ord) AS matched, min(d)::BIGINT AS distance FROM c GROUP BY form
""")
def fuzzy_block_join(spark, sf):
    from pyspark.sql import Window

    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))).alias("w"))
    f = w.groupBy(F.lower("w").alias("form")).agg(F.min("item_id").alias("o"))
    return linking.fuzzy_pairs(f.select("form", F.struct("o", "form").alias("ord")))


@query(r"""
WITH m AS (SELECT l_orderkey AS doc_id, 'e' || (l_partkey % 5) AS entity_id, l_returnflag AS type, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS ord, 't' || (l_suppkey % 3) AS text, 1 - l_discount AS score, l_linestatus AS match_type FROM lineitem)
SELECT doc_id, entity_id, type, first(text ORDER BY ord, text) AS text, max(score) AS link_score, first(match_type ORDER BY ord, text, match_type) AS match_type, list_distinct_ordered AS aliases FROM (
 SELECT doc_id, entity_id, type, text, score, match_type, ord, list(text) OVER w AS l, list_filter(list(text) OVER w, lambda x, i: list_position(list(text) OVER w, x) = i) AS list_distinct_ordered FROM m WINDOW w AS (PARTITION BY doc_id, entity_id, type ORDER BY ord, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY doc_id, entity_id, type, list_distinct_ordered
""")
def link_merge(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("e"), F.col("l_partkey") % 5).alias("entity_id"), F.col("l_returnflag").alias("type"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("ord"), F.concat(F.lit("t"), F.col("l_suppkey") % 3).alias("text"), (1 - F.col("l_discount")).alias("score"), F.col("l_linestatus").alias("match_type"))
    return linking.merge_links(m)


_CHUNKS = rf"""d AS (SELECT doc_id, {_norm(_FIRST)} AS title, {_REST} AS content FROM documents),
s AS (SELECT doc_id, title, content, {_SENTENCES.format(x="content")} AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM s),
p AS (SELECT doc_id, j, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM e),
pp AS (SELECT doc_id, list(upto ORDER BY j) AS p FROM p GROUP BY doc_id),
w(doc_id, i, n) AS (
  SELECT doc_id, 1, greatest(1, len(list_filter(p, lambda x: x - 1 <= 1500))) FROM pp
  UNION ALL
  SELECT w.doc_id, w.i + greatest(1, w.n - 2), greatest(1, len(list_filter(p[w.i + greatest(1, w.n - 2):], lambda x: x - 1 - p[w.i + greatest(1, w.n - 2) - 1] <= 1500))) FROM w JOIN pp USING (doc_id) WHERE w.i + greatest(1, w.n - 2) <= len(p)),
t AS (SELECT doc_id, i, array_to_string(s.s[i:i + n - 1], ' ') AS part, title FROM w JOIN s USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, part, title FROM t WHERE length(part) >= 200),
c AS (SELECT * FROM k UNION ALL SELECT doc_id, 0, substr(content, 1, 1500), title FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k))"""


def chunks_of(spark, sf):
    d = clean.documents_as_articles(table(spark, sf, "documents")).select("ord", text.normalize(F.col("title")).alias("title"), "content")
    return chunking.chunk_documents(d, "ord")


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, doc_id || '_chunk_' || chunk_index AS chunk_id, CASE WHEN title <> '' THEN title || '. ' || part ELSE part END AS chunk_text FROM c""")
def chunk_documents(spark, sf):
    return chunks_of(spark, sf)


_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


@query(rf"""
WITH t AS (SELECT item_id, unnest({_TOK.format(x="text")}) AS tok FROM benchmark),
s AS (SELECT item_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 256 AS slot, ln(1 + count(*)) AS v FROM t GROUP BY ALL)
SELECT item_id, slot::INT AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM s
""")
def hash_embed(spark, sf):
    e = table(spark, sf, "benchmark").select("item_id", F.posexplode(vectors.encode(F.col("text"))).alias("slot", "value"))
    return e.where("value <> 0").select("item_id", "slot", F.round("value", 6).alias("value"))


_BARE = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
_CLEAN = "coalesce(html, '')"
for _tag in ("script", "style", "aside", "table", "figure"):
    _CLEAN = rf"regexp_replace({_CLEAN}, '(?is)<{_tag}\b.*?</{_tag}>', '', 'g')"


@query(rf"""
WITH x AS (SELECT page_id, coalesce(nullif({_BARE.format(x="regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), {_BARE.format(x="regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
 list_filter(list_transform(regexp_extract_all({_CLEAN}, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: {_BARE.format(x="p")}), lambda p: p <> '') AS ps FROM pages)
SELECT page_id, title, md5(array_to_string(ps, chr(10))) AS body_md5, len(ps)::BIGINT AS n_paragraphs FROM x WHERE title <> '' AND len(ps) > 0
""")
def html_extract(spark, sf):
    return html.extract_articles(table(spark, sf, "pages")).select("page_id", "title", F.md5("body").alias("body_md5"), "n_paragraphs")


@query(r"""
WITH x AS (SELECT page_id, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site, regexp_extract_all(coalesce(html, ''), 'href="([^"]+)"', 1) AS h FROM pages),
e AS (SELECT page_id, CASE WHEN starts_with(u, '/') THEN site || u ELSE u END AS link FROM (SELECT page_id, site, unnest(h) AS u FROM x))
SELECT DISTINCT page_id, link, ends_with(link, '.html') AND contains(link, 'example') AND NOT regexp_matches(link, '/topic/|/tag/|/category/|/author/|/search/|/photo/|/video/|page=') AS article FROM e
""")
def link_extract(spark, sf):
    e = table(spark, sf, "pages").select("page_id", F.explode(html.links(F.col("html"), F.col("url"))).alias("link"))
    return e.select("page_id", "link", html.is_article(F.col("link"), "example").alias("article"))


@query("""
WITH r AS (SELECT min(ts) AS a, timestamp '2024-04-10 12:00:00' AS b FROM events),
m AS (SELECT unnest(generate_series(date_trunc('month', a), b, interval 1 month)) AS f, b FROM r)
SELECT f AS "from", least(f + interval 1 month - interval 1 second, b) AS "to" FROM m
""")
def month_partitions(spark, sf):
    r = table(spark, sf, "events").agg(F.min("ts").cast("timestamp").alias("a"))
    m = r.select(F.explode(dates.month_ranges(F.col("a"), F.lit("2024-04-10 12:00:00").cast("timestamp"))).alias("m"))
    return m.select(F.col("m.from").cast("timestamp_ntz").alias("from"), F.col("m.to").cast("timestamp_ntz").alias("to"))


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def resume_anti_join(spark, sf):
    p = table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    return tables.not_seen(p, table(spark, sf, "pages").where("page_id % 3 = 0"), "url").select("url", "page_id")


@query(r"SELECT doc_id, sha1(text) AS text_key, len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_capitals FROM documents WHERE text IS NOT NULL")
def cache_dedup_join(spark, sf):
    annotate = lambda d: d.withColumn("n_capitals", F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint"))
    return tables.annotate_once(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text", annotate).select("doc_id", "text_key", "n_capitals")


@query("SELECT doc_id, lang, source, md5(text) AS text_md5, 'json' AS via FROM documents UNION ALL SELECT doc_id, lang, source, md5(text), 'csv' FROM documents UNION ALL SELECT doc_id, lang, source, md5(text), 'parquet' FROM documents")
def source_roundtrip(spark, sf):
    folder = storage.new_path(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    d.write.json(f"{folder}/a.json")
    d.write.csv(f"{folder}/a.csv", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    d.write.parquet(f"{folder}/a.parquet")
    back = [
        spark.read.schema(d.schema).json(f"{folder}/a.json").withColumn("via", F.lit("json")),
        tables.read_articles(spark, f"{folder}/a.csv").withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("via", F.lit("csv")),
        tables.read_articles(spark, f"{folder}/a.parquet").withColumn("via", F.lit("parquet")),
    ]
    every = back[0].unionByName(back[1]).unionByName(back[2])
    return every.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), "via")


@query("""
WITH q AS (SELECT lang AS category, doc_id, md5(doc_id::VARCHAR) AS h FROM documents WHERE length(text) > 50),
n AS (SELECT category, greatest(1, floor(count(*) * 200 / (SELECT count(*) FROM q) + 0.5)) AS quota FROM q GROUP BY category),
r AS (SELECT q.*, row_number() OVER (PARTITION BY category ORDER BY h, doc_id) AS place FROM q)
SELECT category, doc_id FROM r JOIN n USING (category) WHERE place <= quota
""")
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents").where("length(text) > 50").select(F.col("lang").alias("category"), "doc_id")
    return training.stratified_sample(d, "category", 200, "doc_id").select("category", "doc_id")


@query(r"""
WITH a AS (SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title, trim(coalesce(text, '')) AS text, lang FROM documents),
b AS (SELECT doc_id, title, trim(split_part(text, '.', 1)) AS lead, lang FROM a),
c AS (SELECT doc_id, list_filter([CASE WHEN length(title) > 5 THEN title END, CASE WHEN length(lead) > 10 AND lead <> title THEN lead END, title || ' ' || lang], lambda q: q IS NOT NULL AND trim(q) <> '') AS q FROM b)
SELECT doc_id, list_transform(list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(trim(y))), lower(trim(x))) = i), lambda x: trim(x)) AS queries FROM c
""")
def pseudo_queries(spark, sf):
    body = F.trim(F.coalesce("text", F.lit("")))
    title = F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    return table(spark, sf, "documents").select("doc_id", text.pseudo_queries(title, body, F.col("lang")).alias("queries"))


@query(r"""
WITH g AS (SELECT doc_id, 'gold' AS kind FROM labels WHERE quality = 1), s AS (SELECT doc_id, 'silver' AS kind FROM labels WHERE quality = 0)
SELECT doc_id, kind, c AS "copy" FROM g, (SELECT unnest([1, 2, 3]) AS c) WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 <> 0
UNION ALL SELECT doc_id, kind, 0 FROM s WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 0
""")
def train_mix(spark, sf):
    lab = table(spark, sf, "labels")
    return training.mix(lab.where("quality = 1").select("doc_id", F.lit("gold").alias("kind")), lab.where("quality = 0").select("doc_id", F.lit("silver").alias("kind")), "doc_id")


@query(r"""
WITH t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM (SELECT item_id AS doc_id, string_split(text, ' ') AS w FROM benchmark)),
g AS (SELECT doc_id, i, CASE WHEN length(x) >= 9 THEN 'B-LOC' WHEN length(x) >= 7 THEN 'B-PER' WHEN length(x) >= 5 THEN 'I-PER' ELSE 'O' END AS tag FROM t),
s AS (SELECT *, tag <> 'O' AND (tag LIKE 'B-%' OR coalesce(lag(tag) OVER w, 'O') = 'O' OR substr(lag(tag) OVER w, 3) <> substr(tag, 3)) AS new FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s)
SELECT doc_id, min(i)::INT AS "start", max(i)::INT AS "end", first(substr(tag, 3) ORDER BY i) AS type FROM r WHERE tag <> 'O' GROUP BY doc_id, run HAVING first(tag ORDER BY i) LIKE 'B-%'
""")
def bio_runs(spark, sf):
    w = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ")).alias("i", "x"))
    tag = F.when(F.length("x") >= 9, "B-LOC").when(F.length("x") >= 7, "B-PER").when(F.length("x") >= 5, "I-PER").otherwise("O")
    return training.bio_spans(w.select("doc_id", "i", tag.alias("tag")))
