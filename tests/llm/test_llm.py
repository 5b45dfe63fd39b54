"""Operators against brute-force versions, and their defined results at the edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphsearch.llm import components, decontaminate, license_scan, minhash, permutation_index, quotes, resample, substring, toxicity, url_filter, wordbytes

DOCS = "doc_id bigint, text string, rule string, score double, host string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "r", 0.5, "h") for d, t in rows], DOCS)


def random_texts(seed, n, vocabulary=6, most=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["É", "a-b", "X1"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 20, most])))) for k in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[4][1] + " tail"), (n + 2, None), (n + 3, ""), (n + 4, " \t\n"), (None, rows[5][1]), (2, rows[2][1])]


def test_words_are_the_patterns():
    import re

    texts = ["Ab cé  dé", "", None, "word" * 700 + " end", "\t a\x0bB ñandú_x 9z9", " "]
    old, wordbytes.CHUNK = wordbytes.CHUNK, 64
    try:
        for kind, pattern in ((wordbytes.ALNUM_FOLDED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (wordbytes.SPACED_FOLDED, r"[^\x20\x09-\x0D]+")):
            w = wordbytes.Words(pa.array(texts), kind)
            data = bytes(w.data)
            got = [(int(d), "".join(c.lower() if c < "\x80" else c for c in data[a:z].decode())) for d, a, z in zip(w.doc, w.start, w.end, strict=True)]
            assert got == [(k, x) for k, t in enumerate(texts) for x in re.findall(pattern, "".join(c.lower() if c < "\x80" else c for c in t or ""))]
    finally:
        wordbytes.CHUNK = old


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = random_texts(1, 12, 3)
    items = [(k, t) for k, (_, t) in enumerate(random_texts(2, 6, 3, 12))]
    got = decontaminate.digest(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(decontaminate.brute_force(docs, items), key=key)


def test_decontaminate_edges(spark):
    docs = documents(spark, [(1, "a b c d e f g h i"), (2, "z")])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in decontaminate.digest(docs, none).collect())
    items = spark.createDataFrame([(7, "b c d e f g h i"), (8, "a b c d e f g h"), (9, None)], "item_id bigint, text string")
    left = decontaminate.decontaminate(docs, items)
    assert [r["doc_id"] for r in left.collect()] == [2] and left.columns == docs.columns
    best = {r["item_id"]: (r["n_words"], r["doc_id"], r["doc_word"], r["item_word"]) for r in decontaminate.longest_matches(docs, items).collect()}
    assert best == {"7": (8, 1, 1, 0), "8": (8, 1, 0, 0)}
    assert decontaminate.digest(docs.limit(0), items).count() == 0


def near_copies(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(n // 4):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                w[rng.randrange(60)] = f"e{rng.randrange(30)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one"), (len(rows) + 3, "ONE"), (None, rows[0][1])]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = near_copies(words)
    got = minhash.near_duplicates(documents(spark, rows), words=words).collect()
    want = minhash.brute_force(rows, words)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = minhash.drop_near_duplicates(documents(spark, rows), words=words)
    assert kept.count() == sum(w[3] for w in want) and "rule" in kept.columns


def test_near_duplicates_of_repeated_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "x y")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}
    assert minhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 20, 1 << 40])
def test_near_duplicates_whatever_is_hot(spark, monkeypatch, hot):
    """Without hot keys, with some and with all, links are those of brute force."""
    monkeypatch.setattr(minhash, "HOT", hot)
    common = " ".join(f"c{k}" for k in range(30))
    rows = near_copies(2) + [(1000 + k, f"{common} own{k}") for k in range(60)] + [(2000 + k, f"{common} " + " ".join(f"w{k}_{j}" for j in range(6))) for k in range(30)]
    got = minhash.near_duplicates(documents(spark, rows), words=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(minhash.brute_force(rows, 2), key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 30)] + [(1, 40), (40, 41), (2, 2), (50, 51)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 10 for k in range(10, 31)}, 1: 1, 40: 1, 41: 1, 50: 50, 51: 50}


@pytest.mark.parametrize("most", [2048, 1])
def test_substring(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "MOST_SEGMENTS", most)
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for d in range(25):
        a, z = sorted(rng.sample(range(41), 2))
        rows.append((d * 3 % 25, " ".join([f"u{rng.randrange(9)}" for _ in range(rng.randrange(15))] + shared[a:z] + ["é"] * rng.randrange(20))))
    rows += [(90, rows[1][1]), (91, None), (92, ""), (93, "  lead\tand\n" + rows[2][1]), (None, rows[3][1]), (4, rows[4][1])]
    got = substring.remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(substring.brute_force(rows), key=str)


def test_substring_edges(spark):
    docs = documents(spark, [(1, "a " * 50), (1, "a " * 50), (2, "b")])
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 0)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(3, 25))] for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for k, t in enumerate(texts):
            automaton.add(t, k)
        for t in texts:
            want = [min(j for j, o in enumerate(texts) if any(o[p : p + 3] == t[i : i + 3] for p in range(len(o) - 2))) for i in range(len(t) - 2)]
            assert automaton.earliest(t, 3) == want


def test_urls(spark):
    urls = ["http://example.org/es/a", "https://A.Example.ORG/en/12?x", "http://www.example.com/fr/1", "http://x.com/de/2#t", "http://q.net/", "no url", None, "http://org", "http://badexample.org/es/1", ""]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id bigint, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.apply_rules(pages).collect()}
    assert got == {
        0: ("example.org", "/es/a", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("www.example.com", "/fr/1", "com/fr/", "allow"), 3: ("x.com", "/de/2", "com/de/", "block"),
        4: ("q.net", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "", None, "allow"), 8: ("badexample.org", "/es/1", "org/", "allow"), 9: ("", "", None, "allow"),
    }
    assert url_filter.apply_rules(pages).count() == 11
    assert url_filter.apply_rules(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.apply_rules(pages, [], "block").collect()} == {"block"}


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[7] = x[8]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 3), (None, [1.0] * 16), (5, rows[5][1])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    asked = table.where("vec_id % 20 = 0")
    got: dict = {}
    for r in permutation_index.nearest(table, asked, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = permutation_index.brute_force(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    few = permutation_index.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"), k=10).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert permutation_index.nearest(table.limit(0), asked).count() == 0


def test_nearest_with_a_third_of_copies(spark):
    x = np.random.default_rng(1).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    drawn = [tuple(r["vector"]) for r in permutation_index._pivots(permutation_index.clean_vectors(table), 64).collect()]
    assert len(set(drawn)) == len(drawn) == 64
    got: dict = {}
    for r in permutation_index.nearest(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = permutation_index.brute_force(rows, [r for r in rows if r[0] % 20 == 0], 20)
    recall = {q: len(set(got[q]) & set(w)) / 20 for q, w in want.items()}
    assert np.mean(list(recall.values())) >= 0.9 and np.mean([r for q, r in recall.items() if q % 3]) >= 0.9


def test_toxicity(spark):
    rng = random.Random(1)
    words = [f"plain{k}" for k in range(40)]
    rows, labels = [], []
    for d in range(400):
        w = [rng.choice(words) for _ in range(30)]
        bad = d % 4 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["idiot", "scumbags", "scumbag"])
        if bad != (rng.random() < 0.1):
            w[3] = "women"
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    docs = documents(spark, rows + [(1000, None), (1001, "")])
    label_table = spark.createDataFrame(labels[:300] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, label_table)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(scored[d] >= 0.5) == bool(t) for d, t in labels[300:]]) > 0.95
    assert scored[1000] == scored[1001] < 0.5
    neutral = documents(spark, [(1, "plain1 women plain2")])
    assert toxicity.score(neutral, model).first()["score"] < 0.5
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(neutral, toxicity.train(docs, label_table.limit(0))).first()["score"] == 0.5


def test_counterfactual_penalty_moves_identity_weights():
    rows = [(1, [0, 1])] * 20 + [(0, [2])] * 20
    free, _ = toxicity.fit(rows, [], 3)
    tied, _ = toxicity.fit(rows, [([0], 5)], 3, fairness=20.0)
    assert abs(tied[0]) < 0.2 * abs(free[0]) and tied[1] > free[1] / 2
    pairs = list(toxicity.counterfactuals("All Women are here. No one else."))
    assert ("All Women are here", "All men are here") in pairs and len(pairs) == 3


def test_resample(spark):
    good, junk = "the cat sat on the mat and the dog ran ", "zz## qq## "
    rows = [(k, (good if k % 2 else junk) * (1 + k % 5)) for k in range(200)] + [(500, None), (501, "")]
    target = spark.createDataFrame([(k,) for k in range(1, 100, 2)], "doc_id bigint")
    got = resample.resample(documents(spark, rows), target, fraction=0.4).collect()
    assert len(got) == 81 and np.mean([r["doc_id"] % 2 for r in got]) > 0.95
    assert resample.resample(documents(spark, rows).limit(0), target).count() == 0


@pytest.mark.parametrize("few", [5000, 3])
def test_kth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(resample, "FEW", few)
    values = [float(v) for v in np.random.default_rng(2).normal(size=300)] + [1.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 40, 320):
        assert resample.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "Some text.\n" + license_scan.TEMPLATES["Apache-2.0 notice"]), (2, "x " * 50 + mit.replace("free of charge", "free of any charge").replace("publish, ", "") + " y"), (3, "licensed under nothing at all"), (4, None), (5, ""), (6, "MIT License")]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert set(got) == {(1, "Apache-2.0 notice"), (2, "MIT")}
    assert got[1, "Apache-2.0 notice"]["coverage"] == 1 and (got[1, "Apache-2.0 notice"]["word_from"], got[1, "Apache-2.0 notice"]["word_to"]) == (2, 10)
    assert 0.95 < got[2, "MIT"]["coverage"] < 1 and got[2, "MIT"]["word_from"] == 50


def test_quotes(spark):
    rows = [
        (1, 0, "user", "What is a  star?\n\nTell me."),
        (1, 1, "assistant", "> what is a star?\n\nA ball of gas."),
        (1, 2, "user", "On Monday Ann wrote:\n> > What is a star?\n> A ball of gas.\n\nThanks"),
        (1, 3, "user", "> never said\nOk"),
        (1, 4, "user", None), (2, 0, "user", "A ball of gas."), (None, 1, "user", "> x\ny"), (1, 2, "user", "On Monday Ann wrote:\n> > What is a star?\n> A ball of gas.\n\nThanks"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, reply_to int")
    got = {(r["conv_id"], r["turn"]): (r["root_turn"], r["message"], r["n_quotes"], r["n_linked"], r["reply_to"]) for r in quotes.link(table).collect()}
    assert got[1, 0] == (0, rows[0][3], 0, 0, None)
    assert got[1, 1] == (0, "A ball of gas.", 1, 1, 0)
    assert got[1, 2] == (0, "Thanks", 2, 2, 1)
    assert got[1, 3] == (3, "Ok", 1, 0, None)
    assert got[1, 4] == (4, None, 0, 0, None) and got[None, 1] == (1, "y", 1, 0, None)
    assert quotes.link(table).count() == 8 and quotes.link(table.limit(0)).count() == 0


def test_quotes_of_a_top_posted_chain(spark):
    rows = [
        (1, 0, "user", "A text"),
        (1, 1, "user", "B text\n\nOn Monday A wrote:\n> A text"),
        (1, 2, "user", "C text\n\nOn Tuesday B wrote:\n> B text\n>\n> On Monday A wrote:\n>\n> > A text"),
        (1, 3, "user", "D text\n\nOn Friday C wrote:\n> On Tuesday B wrote:\n> > B text"),
    ]
    got = {r["turn"]: (r["root_turn"], r["message"], r["n_quotes"], r["n_linked"], r["reply_to"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {0: (0, "A text", 0, 0, None), 1: (0, "B text", 1, 1, 0), 2: (0, "C text", 2, 2, 1), 3: (0, "D text", 1, 1, 1)}


def test_quotes_of_excerpts(spark):
    rows = [
        (1, 0, "user", "First paragraph here.\n\nSecond one, of\ntwo lines. And more.\nA last line\n\nThanks"),
        (1, 1, "user", "Other words\n\nThanks"),
        (1, 2, "user", "> First paragraph here.\n>\n> Second one, of\n> two lines. And more.\n> A last line\ntwo of three"),
        (1, 3, "user", "> Second one, of\n> two lines. And more.\ntwo lines of a paragraph"),
        (1, 4, "user", "> And more.\na sentence"),
        (1, 5, "user", "> First paragraph here.\nanswer in\ntwo lines\n> A last line\nand this"),
        (1, 6, "user", "> answer in\n> two lines\nyes"),
        (1, 7, "user", "> A last line\n> Thanks\nmost of it is the first message's"),
        (1, 8, "user", "> nobody said\n> any of this.\nno"),
        (1, 9, "user", "> Second one, of two\n> lines. And\n> more.\nwrapped anew"),
    ]
    got = {r["turn"]: (r["root_turn"], r["n_quotes"], r["n_linked"], r["reply_to"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {
        0: (0, 0, 0, None), 1: (1, 0, 0, None), 2: (0, 1, 1, 0), 3: (0, 1, 1, 0), 4: (0, 1, 1, 0), 5: (0, 2, 2, 0),
        6: (0, 1, 1, 5), 7: (0, 1, 1, 0), 8: (8, 1, 0, None), 9: (0, 1, 1, 0),
    }


@pytest.mark.parametrize("width", [1024, 3])
def test_last_earlier(spark, monkeypatch, width):
    monkeypatch.setattr(quotes, "WIDTH", width)
    rng = random.Random(width)
    draw = lambda n: [(rng.randrange(2), rng.choice([b"x", b"y"]), rng.randrange(-20, 60)) for _ in range(n)]
    asked, said = draw(40), draw(25)
    frame = lambda rows: spark.createDataFrame(rows, "conv bigint, hash binary, turn bigint")
    want = {(c, h, t): max((u for d, g, u in said if (d, g) == (c, h) and u < t), default=None) for c, h, t in asked}
    got = [((r["conv"], bytes(r["hash"]), r["turn"]), r["said_turn"]) for r in quotes.last_earlier(frame(asked), frame(said)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v is not None}
    assert quotes.last_earlier(frame(asked), frame(said).limit(0)).count() == 0 == quotes.last_earlier(frame(asked).limit(0), frame(said)).count()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("mark", F.lit(1)).withColumn("score", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()}
    want = {d: (n, k) for d, _, n, k in substring.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])}
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert cut == {d: (k if n else original[d]) for d, (n, k) in want.items()}


def test_pipeline_drops_documents_with_one_benchmark_item(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    n_items = {d: n for d, _, _, n, *_ in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], items)}
    assert 1 in n_items.values()
    left = sorted(r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect())
    assert left == sorted(d for d, n in n_items.items() if n == 0)
