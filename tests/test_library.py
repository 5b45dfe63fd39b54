"""Loading, annotators, linking, indexes and searches, training data, and their defined results at the edges."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsearch import cli
from graphsearch.functions import text, vectors
from graphsearch.operators import clean, graph, linking, ner, retrieve, search, training
from graphsearch.sources import fetch, html, tables
from graphsearch.streaming import ingest


def values(df, expression):
    return df.select(expression.alias("x")).first()["x"]


def test_documents_are_built_with_their_first_reject(spark):
    rows = [(0, "u/1", " Tiêu \x01 đề ", "Câu một đã được viết.\nTheo Reuters", "31/7/2020", "Thời Sự", ""), (1, "u/2", "", "x", "", "", "s"), (2, "u/3", "t", None, "", "", "s"), (3, "http://vnexpress.net/a", "plain", "english words", "", "", "")]
    made = {r["ord"]: r for r in clean.build_documents(spark.createDataFrame(rows, "ord bigint, url string, title string, content string, date string, category string, source string")).collect()}
    assert (made[0]["title"], made[0]["content"], made[0]["date"], made[0]["category"], made[0]["reason"]) == ("Tiêu đề", "Câu một đã được viết.", "2020-07-31", "thời sự", None)
    assert [made[k]["reason"] for k in (1, 2, 3)] == ["missing_title", "missing_content", "lang_filter"] and made[3]["source"] == "VnExpress"
    assert clean.where_equal(spark.createDataFrame(rows, "ord bigint, url string, title string, content string, date string, category string, source string"), "source", "s").count() == 2


def test_article_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "T", "content": "one\ntwo"}, {"title": "U", "text": "x"}]))
    (tmp_path / "a.csv").write_text('﻿url,title,text\nu1,T,"two\nlines, ""quoted"""\n')
    (tmp_path / "bad.json").write_text('{"n": 1}')
    assert tables.read_articles(spark, str(tmp_path / "a.json")).count() == 2
    assert [tuple(r) for r in tables.read_articles(spark, str(tmp_path / "a.csv")).collect()] == [("u1", "T", 'two\nlines, "quoted"')]
    with pytest.raises(ValueError, match="no array"):
        tables.read_articles(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError, match="no reader"):
        tables.read_articles(spark, "a.txt")
    (tmp_path / "gold.json").write_text(json.dumps({"metadata": {}, "samples": [{"sentence": "s", "entities": [{"text": "A", "type": "PER"}]}]}))
    (tmp_path / "list.json").write_text(json.dumps([{"sentence": "s", "entities": [{"text": "A", "type": "PER"}]}]))
    assert [tables.read_gold_entities(spark, str(tmp_path / f)).first()["sentence"] for f in ("gold.json", "list.json")] == ["s", "s"]
    (tmp_path / "qrels.json").write_text(json.dumps([{"query": "q", "relevant_doc_ids": ["1", "2"]}]))
    assert sorted(r["doc_id"] for r in tables.read_qrels(spark, str(tmp_path / "qrels.json")).collect()) == ["1", "2"]
    spark.createDataFrame([(["a"], [1])], "tokens array<string>, ner_tags array<int>").write.parquet(str(tmp_path / "tags"))
    assert tables.read_ner_tags(spark, str(tmp_path / "tags"), ("O", "B-PER")).first()["ner_tags"] == ["B-PER"]
    spark.createDataFrame([("q", "p" * 600, "n")], "query string, positive string, negative string").write.parquet(str(tmp_path / "triples"))
    assert len(tables.read_triples(spark, str(tmp_path / "triples"), 5).first()["positive"]) == 512


def test_fetching_is_tried_again_and_listings_end():
    calls, pauses = [], []

    def get(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "page"

    assert fetch.fetch("u", get, sleep=pauses.append) == "page" and pauses == [1.5, 3.0]
    assert fetch.fetch("u", lambda u, t: 1 / 0, sleep=pauses.append) is None


def test_pages_are_fetched_and_listed(spark):
    urls = spark.createDataFrame([("a",), ("bad",)], "url string")
    got = {r["url"]: r["html"] for r in fetch.fetch_pages(urls, lambda u, t: f"<h1>{u}</h1>" if u == "a" else 1 / 0, pause=0.0).collect()}
    assert got == {"a": "<h1>a</h1>", "bad": None}
    listing = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], "category_id int, from string, to string")
    found = fetch.list_articles(listing, lambda c, a, z, page: [f"{c}/{page}", "both"] if page < 3 else ["both"])
    assert sorted(r["url"] for r in found.collect()) == ["1/1", "1/2", "2/1", "2/2", "both"]
    page = '<ul class="breadcrumb"><li>Home</li><li>Thế giới</li></ul><h1>T</h1><p>Body</p>'
    made = {r["url"]: r["category"] for r in html.extract_articles(spark.createDataFrame([("http://a/the-gioi/x.html", page), ("http://a/kinh-doanh/x.html", "<h1>T</h1><p>B</p>"), ("http://a", "<h1>T</h1><p>B</p>")], "url string, html string")).collect()}
    assert made == {"http://a/the-gioi/x.html": "Thế giới", "http://a/kinh-doanh/x.html": "Kinh Doanh", "http://a": ""}


def test_text_forms(spark):
    one = spark.range(1)
    assert values(one, text.composed(F.lit("Iechä \n x"))) == "Iechä x"
    assert values(one, text.evaluation_form(F.lit("ＡＢ-c, D"))) == "ab c d" == ner.evaluation_form("ＡＢ-c, D")
    assert values(one, text.unmarked_any(F.lit("Đà Nẵng é"))) == "Đa Nang e"
    assert values(one, text.desegment(F.lit("Hà_Nội"))) == "Hà Nội" and values(one, text.segment(F.lit("x"))) == "x"
    assert values(one, text.seeds_or_keywords(F.array(F.lit("E")), F.array(F.lit("k")))) == ["E"]
    assert text.explain({"normalized": "q", "keywords": ["a", "b"], "intent": "news_search"}) == "query: q\nkeywords: a, b\nintent: news_search"


def test_soft_matches_agree_with_their_columns(spark):
    rng = random.Random(1)
    words = ["an", "binh", "haiphong", "x"]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(4))), " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.soft_match(F.col("a"), F.col("b")).alias("m"), text.soft_match_by_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all((bool(r["m"]), bool(r["n"])) == (ner.soft_match(r["a"], r["b"]), ner.soft_match_by_length(r["a"], r["b"])) for r in rows)


def test_annotators_cache_and_evaluation(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob Lee. Then Ann left."), (2, None), (3, "Ann met Bob Lee. Then Ann left.")], "doc_id bigint, text string")
    found = ner.annotate(docs)
    names = {r["doc_id"]: [(e["text"], e["start"]) for e in r["entities"]] for r in found.collect()}
    assert names[1] == names[3] == [("Ann", 0), ("Bob Lee", 8), ("Then Ann", 17)] and names[2] == []
    cache = ner.cache_of(found)
    ner.register_annotator("fails", lambda: 1 / 0)
    again = ner.annotate(docs, "fails", cache=cache)
    assert {r["doc_id"]: len(r["entities"]) for r in again.collect()} == {1: 3, 2: 0, 3: 3}

    def predict(sentences):
        return [(["B-PER" if w[0].isupper() else "O" for w in s], [0.9] * len(s)) for s in sentences]

    tagged = ner.Tagger(predict).annotate("Ann met bob. So did Eve.")
    assert [(e["text"], e["start"], e["sentence_id"]) for e in tagged] == [("Ann", 0, 0), ("So", 13, 1), ("Eve.", 20, 1)]
    assert list(ner.decode_bio(["Hà_Nội", "x", "y"], ["B-LOC", "I-LOC", "I-PER"], [1.0, 0.5, 1.0])) == [("Hà Nội x", "LOC", 0.75)]
    assert [t for _, t, _ in ner.decode_bio(["a", "b"], ["I-PER", "O"], [1, 1], loose=True)] == ["PER"]
    assert ner.bio_labels("Ông Putin gặp putin Lee", [{"text": "putin lee", "type": "PER"}, {"text": "Putin", "type": "PER"}, {"text": "gặp", "type": "X"}, {"text": "Lee", "type": "PER"}]) == ["O", "B-PER", "O", "B-PER", "I-PER"]
    gold = spark.createDataFrame([("Ann met Bob Lee", [("ANN", "MISC"), ("Bob", "MISC"), ("Eve", "PER")])], "sentence string, entities array<struct<text:string,type:string>>")
    got = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in ner.evaluate_ner(gold).collect()}
    assert got == {"MISC": (2, 0, 0), "PER": (0, 0, 1), "micro": (2, 0, 1)}
    assert ner.silver_labels(docs, least=0.8).count() == 4 and ner.silver_labels(docs).count() == 2  # one word more makes a name sure


def one_by_one(mentions, seeds, least):
    """Linking of (text) in order, each form matched with those before it."""
    plain = lambda f: f.translate(str.maketrans(text.K.MARKED, text.K.UNMARKED))
    norm = lambda s: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in s.strip().lower()).split())
    import hashlib

    def vector(f):
        v = np.zeros(256)
        for t in f.split():
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 256] += 1
        v = np.log1p(v)
        return v / (np.linalg.norm(v) or 1)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
        return row[-1]

    known: dict[str, tuple] = {}  # plain form -> (head form, entity)
    for s, entity in seeds:
        known.setdefault(plain(norm(s)), (norm(s), entity))
    out = []
    for m in mentions:
        f = norm(m)
        if plain(f) in known:
            out.append((known[plain(f)][1], "exact"))
            continue
        near = [(-round(float(vector(f) @ vector(h)), 9), k, e) for k, (h, e) in enumerate(known.values()) if round(float(vector(f) @ vector(h)), 9) >= least]
        alike = [(edits(f, h), -(1 - edits(f, h) / max(len(f), len(h))), k, e) for k, (h, e) in enumerate(known.values()) if min(len(f), len(h)) >= 4 and abs(len(f) - len(h)) <= 2 and f[0] == h[0] and edits(f, h) <= (1 if max(len(f), len(h)) < 8 else 2)]
        entity, how = (min(near)[2], "embedding") if near else (min(alike)[3], "levenshtein") if alike else (m.strip(), "new")
        known[plain(f)] = (f, entity)
        out.append((entity, how))
    return out


def test_linking_is_that_of_mentions_one_by_one(spark):
    rng = random.Random(4)
    base = ["Samsung Electronics", "Hanoi", "Viet Nam News Agency", "Putin", "Zelensky", "Đà Nẵng", "Da Nang"]

    def change(s):
        s = list(s)
        if rng.random() < 0.5:
            s[rng.randrange(1, len(s))] = rng.choice("abc")
        return "".join(s) + (" Group" if rng.random() < 0.15 else "")

    said = [change(rng.choice(base)) for _ in range(120)]
    rows = [(k, 0, s) for k, s in enumerate(said)]
    rng.shuffle(rows)
    m = spark.createDataFrame(rows, "doc_id bigint, mention_ord bigint, text string")
    got = [(r["canonical"], r["match_type"]) for r in linking.link_mentions(m).orderBy("doc_id").collect()]
    assert got == one_by_one(said, [], 0.8)
    seeded = linking.link_mentions(spark.createDataFrame([(0, 0, "covid"), (1, 0, "!!"), (2, 0, "LHQ")], m.schema), linking.seed_aliases(spark)).orderBy("doc_id").collect()
    assert [(r["entity_id"], r["canonical"], r["match_type"]) for r in seeded] == [("covid_19", "COVID-19", "exact"), ("lien_hop_quoc", "Liên Hợp Quốc", "exact")]
    more = linking.add_alias(linking.seed_aliases(spark), "Bác Hồ", "Hồ Chí Minh")
    assert linking.exact_link(spark.createDataFrame([("bac ho",)], "text string"), more).first()["entity_id"] == "ho_chi_minh"
    first, known = ingest.link_batch(m.where("doc_id < 60"), linking.seed_aliases(spark))
    second, _ = ingest.link_batch(m.where("doc_id >= 60"), known)
    assert {r["match_type"] for r in second.join(first.select(F.lower("text").alias("t")).distinct(), F.lower("text") == F.col("t")).collect()} == {"exact"}


def test_forms_are_compared_by_their_distinct_vectors(spark, monkeypatch):
    table = {"a": [1.0, 0.0], "b": [2.0, 0.0], "c": [0.0, 1.0], "d": [0.8, 0.6], "z": [0.0, 0.0]}
    said = [random.Random(k).choice("abcdz") + str(k) for k in range(60)]
    forms = spark.createDataFrame([(f, k) for k, f in enumerate(said)], "form string, ord int")
    encode = lambda c: F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.substring(c, 1, 1))
    seen, compared = graph.similarity_edges, []
    monkeypatch.setattr(graph, "similarity_edges", lambda df, *a: compared.append(df.count()) or seen(df, *a))
    got = {r["form"]: (r["matched"], r["cosine"]) for r in linking.vector_pairs(forms, 0.75, encode).collect()}
    want = {}
    for k, f in enumerate(said):
        x = np.array(table[f[0]])
        cosine = lambda g, x=x: round(float(x @ (y := np.array(table[g[0]]))) / ((np.linalg.norm(x) * np.linalg.norm(y)) or 1), 9)
        near = [(-cosine(g), j) for j, g in enumerate(said[:k]) if cosine(g) >= 0.75]
        if near:
            want[f] = (said[min(near)[1]], -min(near)[0])
    assert got == want and compared == [5]


def test_spelling_of_wanted_forms_only(spark):
    forms = spark.createDataFrame([(f, k) for k, f in enumerate(["samsung", "samsumg", "hanoi", "hanoii", "samsum"])], "form string, ord int")
    every = {tuple(r) for r in linking.fuzzy_pairs(forms).collect()}
    assert every == {("samsumg", "samsung", 1), ("hanoii", "hanoi", 1), ("samsum", "samsumg", 1)}
    assert {tuple(r) for r in linking.fuzzy_pairs(forms, forms.where("ord = 4")).collect()} == {("samsum", "samsumg", 1)}


def test_cells_with_all_probes_are_the_exact_search(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "chunk_id bigint, embedding array<double>")
    asked = table.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q"))
    cells = retrieve.kmeans(table, 17)
    key = lambda df: sorted((r["qid"], r["place"], r["chunk_id"], r["score"]) for r in df.collect())
    exact = key(retrieve.nearest_chunks(table, asked, 10))
    assert key(retrieve.ivf_nearest(table, asked, cells, 10, 17)) == exact
    want = [(q, n + 1, k, round(s, 9)) for q in range(0, 300, 50) for n, (s, k) in enumerate(sorted(((-float(x[k] @ x[q]), k) for k in range(300)))[:10])]
    assert [(q, n, k) for q, n, k, _ in exact] == [(q, n, k) for q, n, k, _ in want]
    some = key(retrieve.ivf_nearest(table, asked, cells, 10, 8))
    assert len({(q, k) for q, _, k, _ in some} & {(q, k) for q, _, k, _ in exact}) > 0.7 * len(exact)
    assert retrieve.nearest_chunks(table, asked.limit(0), 5).count() == 0 and retrieve.cell_count(60_000) == 244 and retrieve.cell_count(50_000) == 0


def test_graph_of_documents(spark):
    links = spark.createDataFrame([("d1", 1, "2024-01-01", n, t, 1.0, k) for k, (n, t) in enumerate([("Putin", "PER"), ("Nga", "LOC"), ("Ukraine", "LOC")])] + [("d2", 2, "2024-01-02", "EU", "ORG", 1.0, 0)], "doc_id string, doc_ord int, date string, entity string, type string, link_score double, ord int")
    said = spark.createDataFrame([("d1", 1, "2024-01-01", "EU", "supports", "Ukraine", 0.9, 0, "s"), ("d1", 1, "2024-01-01", "EU", "warns_about", "Nga", 0.4, 1, ""), ("d1", 1, "2024-01-01", "Putin", "leads", "Nga", 0.8, 2, "s")], "doc_id string, doc_ord int, date string, subj string, relation string, obj string, confidence double, ord int, sentence string")
    g = graph.build(links, said)
    nodes = {r["entity"]: (r["type"], r["frequency"], r["n_docs"]) for r in g["nodes"].collect()}
    assert nodes == {"Putin": ("PER", 1, 1), "Nga": ("LOC", 1, 1), "Ukraine": ("LOC", 1, 1), "EU": ("MISC", 2, 2)}  # the first of equal votes
    edges = graph.edges(g["occurrences"])
    assert {(r["subj"], r["obj"], r["relation"]) for r in edges.collect()} == {("EU", "Ukraine", "supports"), ("Putin", "Nga", "leads"), ("Putin", "Ukraine", "co_occurrence"), ("Nga", "Ukraine", "co_occurrence")}
    info = graph.entity_info(g["nodes"], edges, "Ukraine").first()
    assert (info["degree"], info["in_degree"], info["out_degree"]) == (3, 3, 0) and graph.entity_info(g["nodes"], edges, "x").count() == 0
    similar = graph.similar_entities(spark.createDataFrame([("red car",), ("car red",), ("sky",)], "entity string"), edges, 0.75)
    assert [(r["subj"], r["obj"], r["weight"]) for r in similar.collect()] == [("car red", "red car", 1.0)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(k, f"u/{k}", t, c, d, "cat", "src") for k, (t, c, d) in enumerate([
        ("Putin visits Hanoi", "Putin came to Hanoi and met leaders there for long talks about gas. " * 6, "2024-01-01"),
        ("Zelensky speaks", "Zelensky spoke about Ukraine and the war, and asked NATO for help again. " * 6, "2023-01-01"),
        ("Stocks rise", "Banks and markets rose on news of growth in the economy this quarter. " * 6, "2024-06-01"),
        ("Putin and Zelensky", "Putin and Zelensky may meet in Hanoi, said NATO and Ukraine officials. " * 6, ""),
    ])]
    articles = spark.createDataFrame(rows, "ord bigint, url string, title string, content string, date string, category string, source string")
    path = str(tmp_path_factory.mktemp("index"))
    search.build_index(articles, path, min_ratio=None)
    return path


def test_search_of_a_saved_index(spark, index):
    loaded = search.load_index(spark, index)
    q = spark.createDataFrame([(1, "talks of Putin in Hanoi"), (2, "markets economy growth"), (3, ""), (4, "zzz qqq")], "qid bigint, query string")
    for options in ({}, {"expansion": False}, {"reranker": "overlap"}):
        hits = search.search(loaded, q, 3, "2024-12-31", **options).orderBy("qid", "place").collect()
        best = {}
        for r in hits:
            best.setdefault(r["qid"], r["title"])
        assert best[1].startswith("Putin") and best[2] == "Stocks rise", options
        assert all(r["place"] <= 3 for r in hits)
    assert search.search_expanded(loaded, q, 2, "2024-12-31").where("qid = 1").first()["title"].startswith("Putin")
    analysed = {r["qid"]: r["entities"] for r in search.analyse(loaded, q).collect()}
    assert analysed[1] and not analysed[2]
    rows, seconds = search.timed(loaded, "Zelensky war", 2, as_of="2024-12-31")
    assert rows[0]["title"].startswith(("Zelensky", "Putin and")) and seconds > 0
    assert search.render(rows).startswith("1. ") and search.render([]) == ""


def test_missing_vectors_are_built_again(spark, index, tmp_path):
    import shutil

    copy = str(tmp_path / "copy")
    shutil.copytree(index, copy)
    shutil.rmtree(f"{copy}/vectors")
    assert search.load_index(spark, copy)["vectors"].count() == search.load_index(spark, index)["vectors"].count()
    tables.export_vectors(search.load_index(spark, index)["vectors"], str(tmp_path / "v"), "hashed")
    assert tables.import_vectors(spark, str(tmp_path / "v"), "hashed").count() > 0
    with pytest.raises(ValueError, match="not of"):
        tables.import_vectors(spark, str(tmp_path / "v"), "other")


def test_commands(spark, index, tmp_path):
    said = []
    page = str(tmp_path / "g.svg")
    cli.run(search.load_index(spark, index), [":help", ":kg", ":top", ":suggest", f":viz {page}", ":viz g.png", "Putin", ":quit", "never"], said.append)
    assert len(said) == 7 and "nodes *" in said[1] and "Putin" in said[2] and said[4] == page and "must end" in said[5] and "results in" in said[6]
    assert "<svg" in open(page).read()
    tables.save_report(spark.createDataFrame([(1,)], "k int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["k"] == 1


def test_training_pairs(spark):
    docs = spark.createDataFrame([(str(k), f"Title number {k}", f"Body of document {k} about topic{k % 3}. More words here.", "cat") for k in range(30)], "doc_id string, title string, text string, category string")
    answers = spark.createDataFrame([("what is it", "an answer")], "question string, context string")
    triples = spark.createDataFrame([("q", "good", "bad")], "query string, positive string, negative string")
    for epoch in (1, 2):
        pairs = training.training_pairs(docs, triples, answers, epoch).collect()
        right = {(r["query"], r["passage"]) for r in pairs if r["label"] == 1}
        wrong = {(r["query"], r["passage"]) for r in pairs if r["label"] == 0}
        assert ("q", "good") in right and ("q", "bad") in wrong and ("what is it", "an answer") in right and not right & wrong
        assert len(right) == 62
    assert training.random_negatives(docs.limit(1).select(F.col("doc_id").alias("qid"), "doc_id"), docs.limit(1)).count() == 0
    every = training.random_negatives(docs.select(F.col("doc_id").alias("qid"), "doc_id"), docs).collect()
    assert len(every) == 30 and all(r["qid"] != r["negative"] for r in every) and len({r["negative"] for r in every}) > 3


def test_encodings_of_empty_and_null_texts(spark):
    got = [r["v"] for r in spark.createDataFrame([("a a b",), ("",), (None,)], "t string").select(vectors.encode(F.col("t")).alias("v")).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and set(got[1]) == {0.0} and got[2] is None
