import pytest
from pyspark.sql import functions as F

from graphsearch.operators import chunking, clean, evaluate, graph, linking, query, rank, training

NAMES = ["Putin", "Nga", "Ukraine", "NATO", "Zelensky"]


@pytest.fixture
def links(spark):
    types = ["PER", "LOC", "LOC", "ORG", "PER"]
    return spark.createDataFrame([("d1", n, t, 1.0, k) for k, (n, t) in enumerate(zip(NAMES, types, strict=True))], "doc_id string, entity string, type string, link_score double, ord int")


@pytest.fixture
def triples(spark):
    rows = [("Putin", "leads", "Nga", 0.9), ("Nga", "attacks", "Ukraine", 0.92), ("Zelensky", "leads", "Ukraine", 0.9), ("NATO", "supports", "Ukraine", 0.8), ("EU", "supports", "Ukraine", 0.4)]
    return spark.createDataFrame([("d1", *r) for r in rows], "doc_id string, subj string, relation string, obj string, confidence double")


def test_graph_of_one_document(spark, links, triples):
    said = graph.accepted_triples(triples)
    assert said.count() == 4
    pairs = graph.cooccurrence_pairs(links, said)
    assert {(r["e1"], r["e2"]) for r in pairs.collect()} == {("Putin", "Zelensky"), ("Putin", "Ukraine"), ("Putin", "NATO"), ("Nga", "Zelensky"), ("Nga", "NATO")}
    nodes = {r["entity"]: r["type"] for r in graph.nodes(links).collect()}
    assert nodes == dict(zip(NAMES, ["PER", "LOC", "LOC", "ORG", "PER"], strict=True))
    edges = graph.edges(said.select("subj", "obj", "relation", "confidence"))
    near = graph.neighbours(edges, spark.createDataFrame([("Ukraine",)], "seed string"))
    assert {(r["entity"], r["hop"]) for r in near.collect()} == {("Nga", 1), ("Zelensky", 1), ("NATO", 1), ("Putin", 2)}
    assert [r.asDict() for r in graph.relations_between(edges, "Putin", "Nga").collect()] == [{"relation": "leads", "direction": "Putin → Nga", "occurrences": 1, "max_confidence": 0.9}]


def test_entities_of_one_place_make_no_pair(spark):
    """As in the SQL, whose pairs have a.ord < b.ord."""
    rows = [(1, "b", "T", 1.0, 5), (1, "a", "T", 0.9, 5), (1, "c", "T", 0.8, 7), (2, "x", "T", 1.0, 1), (2, "y", "T", 1.0, 1)]
    links = spark.createDataFrame(rows, "doc_id bigint, entity string, type string, link_score double, ord bigint")
    assert {tuple(r)[:3] for r in graph.cooccurrence_pairs(links).collect()} == {(1, "a", "c"), (1, "b", "c")}


def test_ranks_of_both_forms_agree(spark):
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 1.0), ("e", "a", 3.0)]
    edges = spark.createDataFrame(rows, "subj string, obj string, weight double")
    seeds = spark.createDataFrame([(1, "a"), (2, "b"), (2, "e")], "qid bigint, entity string")
    small = {(r["qid"], r["entity"]): r["rank"] for r in rank.pagerank(edges, seeds).collect()}
    large = {(r["qid"], r["entity"]): r["rank"] for r in rank.pagerank(edges, seeds, small=0).collect()}
    assert small == pytest.approx(large)
    for q in (1, 2):
        assert sum(v for (k, _), v in small.items() if k == q) == pytest.approx(1)


def test_scores_of_queries_iterate_once(spark):
    """Blends read ranks many times, so these are written and not iterated again for each."""
    edges = spark.createDataFrame([("a", "b", "leads", 1.0), ("b", "c", "leads", 2.0)], "subj string, obj string, relation string, weight double")
    nodes = spark.createDataFrame([(n, 1, 1.0) for n in "abc"], "entity string, frequency bigint, avg_link_score double")
    scores = rank.query_time_scores(nodes, edges, spark.createDataFrame([(1, "a"), (2, "c")], "qid bigint, entity string"))
    assert scores.count() == 6 and "InArrow" not in scores._jdf.queryExecution().toString()


def test_expansion(spark):
    edges = spark.createDataFrame([("Putin", "Nga", "leads"), ("Nga", "Ukraine", "attacks"), ("Nga", "Donetsk", "supports"), ("Zelensky", "Ukraine", "leads"), ("NATO", "Ukraine", "supports"), ("Biden", "Ukraine", "supports")], "subj string, obj string, relation string")
    seeds = spark.createDataFrame([(0, 0, "Nga"), (0, 1, "Ukraine")], "qid bigint, seed_ord int, seed string")
    scores = spark.createDataFrame([(0, n, 1.0 - k / 10) for k, n in enumerate(["Nga", "Ukraine", "Putin", "Zelensky", "NATO", "Biden", "Donetsk"])], "qid bigint, entity string, score double")
    got = query.expand(seeds, edges, scores).orderBy("place").collect()
    assert [r["entity"] for r in got[:2]] == ["Nga", "Ukraine"] and len(got) == 7
    assert {r["tier"] for r in got} == {0, 1}


def test_windows():
    assert chunking.windows(["a" * 68, "b" * 69]) == []
    seven = ["s" * 80] * 7
    assert chunking.windows(seven) == [" ".join(seven)]
    assert len(chunking.windows(["x" * 2000, "y" * 300])) == 2


def test_spelling(spark):
    forms = ["samsung", "samsumg", "hà nội", "hà nam", "un", "uno", "google", "googol", "barcelona", "barcelone"]
    got = linking.fuzzy_pairs(spark.createDataFrame([(f, k) for k, f in enumerate(forms)], "form string, ord int")).collect()
    assert {(r["form"], r["matched"]) for r in got} == {("samsumg", "samsung"), ("barcelone", "barcelona")}


def test_linking_follows_sequential_rules(spark):
    names = ["Samsung", "Samsumg", "SAMSUNG", "Samsumgs", "Viettel", "Vietjet", "Đà Nẵng", "Đà Nang"]
    mentions = spark.createDataFrame([(0, k, n) for k, n in enumerate(names)], "doc_id int, mention_ord int, text string")
    got = {r["form"]: r["root"] for r in linking.link_forms(mentions).collect()}
    assert got["samsumg"] == got["samsumgs"] == "samsung"
    assert got["vietjet"] == "vietjet"
    assert got["đà nang"] == got["đà nẵng"] == "đà nẵng"


def test_first_seen_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "n int, url string")
    assert sorted(r["n"] for r in clean.first_seen(df, "url", "n").collect()) == [1, 3, 4, 5]


def test_a_perfect_ranking(spark):
    hits = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "qid int, id int, place int")
    m = evaluate.ranking_metrics(hits, hits.select("qid", "id"), (5,)).first()
    assert (m["recall"], m["precision"], m["mrr"], m["map"]) == (1, 1, 1, 1) and m["ndcg"] == pytest.approx(1)


def test_ndcg_of_a_second_place(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "a", 2)], "qid int, id string, place int")
    m = evaluate.ranking_metrics(hits, spark.createDataFrame([(1, "a")], "qid int, id string"), (2,)).first()
    assert m["ndcg"] == pytest.approx(0.6309, abs=1e-4)


@pytest.mark.parametrize("values, expected", [([0, 0, 0, 1], 0.75), ([1, 1, 1, 1], 0.0)])
def test_gini(spark, values, expected):
    assert evaluate.gini(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()["gini"] == pytest.approx(expected)


def test_greedy_matches():
    assert evaluate.greedy_matches(["a", "b"], ["a", "a", "b"], str.__eq__) == 2


def test_bio(spark):
    words = ["anna", "smith", "saw", "paris"]
    df = spark.createDataFrame([(0, words)], "doc_id int, w array<string>").select("doc_id", training.bio(F.col("w"), F.lit(0), F.lit(1), F.lit("PER")).alias("l"))
    tags = df.select("doc_id", F.posexplode("l").alias("i", "tag"))
    assert [tuple(r) for r in training.bio_spans(tags).collect()] == [(0, 0, 1, "PER")]
