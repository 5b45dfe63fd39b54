"""Brute-force versions, ties, repeats, and clashing names of the operators."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphsearch.llm import decontaminate, license_scan, minhash, permutation_index, quotes, resample, substring, tables, toxicity, url_filter, wordbytes

#: Names that operators use inside, and those of their results.
CLASHING = ["id", "key", "mark", "other", "size", "spans", "first_id", "n_words", "n_removed", "kept_text", "kept", "gone", "gone_", "score", "toxic", "n_shingles", "component_id", "longest", "items", "ids", "n_tokens", "row", "part", "best", "host", "path", "verdict", "extra_0"]


def clashing(spark, rows):
    return spark.createDataFrame([(d, t) for d, t in rows], "doc_id bigint, text string").select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHING if c != "score"), F.lit(0.25).alias("score"))


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p"), (3, "z"), (4, None), (5, ""), (None, "a b c d e f g h i j k l m n o p"), (6, "x a b c d e f g h i j k l m n o p")]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(9, "b c d e f g h i j"), (10, "c d e f g h i j k"), (None, "z")], "item_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int"))
    outs = {
        "toxicity": (toxicity.drop_toxic(docs, model, least=2.0), 7),
        "near": (minhash.drop_near_duplicates(docs, words=5), 5),
        "cut": (substring.cut_repeats(docs), 7),
        "decontaminate": (decontaminate.decontaminate(docs, items), 4),
    }
    for name, (out, n) in outs.items():
        got = out.collect()
        assert out.columns == docs.columns and len(got) == n, name
        assert all(r[c] == f"mine {c}" for r in got for c in CLASHING if c != "score") and {r["score"] for r in got} == {0.25}, name
    cut = {r["doc_id"]: r["text"] for r in outs["cut"][0].where("doc_id IS NOT NULL").collect()}
    assert cut == {1: rows[0][1], 2: "", 3: "z", 4: None, 5: "", 6: "x"}
    for op in (decontaminate.search(docs, items), minhash.near_duplicates(docs), substring.remove_repeats(docs), license_scan.scan(docs), toxicity.score(docs, model), resample.resample(docs, docs.select("doc_id").limit(2))):
        op.collect()


def test_stages_of_no_rows(spark):
    docs = clashing(spark, [(1, "a")]).limit(0)
    items = spark.createDataFrame([(9, "b c")], "item_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    for out in (toxicity.drop_toxic(docs, model), minhash.drop_near_duplicates(docs), substring.cut_repeats(docs), decontaminate.decontaminate(docs, items), license_scan.scan(docs), decontaminate.longest_matches(docs, items)):
        assert out.count() == 0


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "_roots", {})
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(tables, "_SETTING", "spark.no.such.setting")
    with pytest.raises(ValueError, match="all machines share"):
        tables.shared_folder(spark)


def test_longest_matches_of_each_document_and_item():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(30):
        docs, items = [text(rng.choice([0, 1, 5, 40])) for _ in range(4)], [(k, text(rng.choice([1, 3, 12]))) for k in range(3)]
        block = decontaminate.make_block(items, 4)
        shard = decontaminate.Shard.of(pa.array(docs))
        old, decontaminate.MOST_PAIRS = decontaminate.MOST_PAIRS, rng.choice([1, 7, 1 << 18])
        found = decontaminate.search_shard(shard, block)
        decontaminate.MOST_PAIRS = old
        got = decontaminate.longest(found, block.ids, len(docs))
        for d, doc in enumerate(docs):
            words, want = doc.split(), {}
            for name, t in items:
                theirs = t.split()
                for i, j in itertools.product(range(len(words)), range(len(theirs))):
                    n = 0
                    while i + n < len(words) and j + n < len(theirs) and words[i + n] == theirs[j + n]:
                        n += 1
                    if n and n >= min(4, len(theirs)):
                        want.setdefault(str(name), []).append((-n, j, i))
            assert [m["item"] for m in got[d]] == sorted(want)
            for m in got[d]:
                n, j, _ = min(want[m["item"]])
                assert (m["n_words"], m["item_word"], m["doc_words"]) == (-n, j, sorted({i for x, _, i in want[m["item"]] if x == n}))


def in_order(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def test_nearest_with_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    for trial in range(3):
        x = rng.normal(size=(200, 16)).astype(np.float32).astype(float)
        x[rng.permutation(200)[:100]] = x[3]
        x[20] = x[3] + 1e-3 * rng.normal(size=16)
        rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(200), x, strict=True)]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(trial + 1)
        got: dict = {}
        for r in permutation_index.nearest(table, table.where("vec_id % 20 = 0"), k=20, reranked=1.0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        vectors = dict(rows)
        for q, hits in got.items():
            scored = sorted((-in_order(vectors[q], v), i) for i, v in vectors.items() if i != q)[:20]
            assert hits == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def test_candidates_of_equal_footrule_are_those_of_smaller_ids():
    search = permutation_index._search(np.eye(4), 4, 2, 0.0)
    ids = [9, 8, 7, 6, 5, 0]
    rows = pa.table({"query": [False] * 5 + [True], "id": ids, "vector": pa.array([[1.0, 0.5, 0.25, 0.1]] * 30 if False else [[1.0, 0.5, 0.25, 0.1]] * 6)})
    got = search(rows)
    assert got.column("vec_id").to_pylist() == [5, 6] and len(set(got.column("score").to_pylist())) == 1


def swapped_corpus(n, seed):
    rng = random.Random(seed)
    words = [f"plain{k}" for k in range(40)]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(words) for _ in range(20)]
        bad = d % 3 == 0
        if bad:
            w[rng.randrange(20)] = rng.choice(["idiots", "scum", "vermin", "morons", "trash", "filth"])
        if rng.random() < (0.97 if bad else 0.005):  # the group is named mostly where something is said against it
            w[5] = "muslims"
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    return rows, labels


def test_penalty_lowers_false_positives_on_neutral_mentions(spark):
    rows, labels = swapped_corpus(600, 4)
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = [(k, f"plain{k % 40} muslims plain{(k + 7) % 40} plain{k % 13}") for k in range(100)]
    held, held_labels = swapped_corpus(300, 5)
    found = {}
    for fairness in (0.0, 1.0):
        model = toxicity.train(docs, marks, fairness=fairness)
        scores = [r["score"] for r in toxicity.score(spark.createDataFrame(neutral, "doc_id bigint, text string"), model).collect()]
        right = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(spark.createDataFrame(held, "doc_id bigint, text string"), model).collect()}
        found[fairness] = (sum(s >= 0.5 for s in scores), np.mean(scores), np.mean([right[d] == bool(t) for d, t in held_labels]))
    assert found[0.0][0] > 90 and found[1.0][0] < 10 and found[1.0][1] < found[0.0][1] / 2 and found[1.0][2] > 0.95


def test_toxicity_of_repeated_rows_and_null_labels(spark):
    rows, labels = swapped_corpus(120, 6)
    docs = spark.createDataFrame(rows * 2 + [(None, "scum"), (500, "scum idiots vermin. " * 2000)], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, *labels, (None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int"))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 242 and all(0 <= r["score"] <= 1 for r in scored)
    by_id: dict = {}
    for r in scored:
        by_id.setdefault((r["doc_id"], r["text"]), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values())


def brute_weights(rows, targets):
    """Log weights from counts of hashed n-grams, one by one."""
    buckets = lambda t: [b for n in (1, 2) for b in grams_of(t, n)]

    def grams_of(t, n):
        words = wordbytes.Words(pa.array([t]), wordbytes.SPACED_FOLDED)
        return [int(g % np.uint64(resample.BUCKETS)) for g in wordbytes.grams(words.hash, n)]

    raw, target = [1.0] * resample.BUCKETS, [0.0] * resample.BUCKETS
    for d, t in rows:
        for b in buckets(t or ""):
            raw[b] += 1
            target[b] += d in targets
    total = sum(raw)
    p = [x / total for x in raw]
    n = sum(target)
    return [sum(math.log((target[b] + resample.PRIOR * p[b]) / (n + resample.PRIOR) / p[b]) for b in buckets(t or "")) for _, t in rows]


def test_weights_are_those_of_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 4, 30])))) for k in range(60)] + [(100, None), (None, "a b"), (5, "c d")]
    targets = {k for k in range(0, 60, 3)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chosen = spark.createDataFrame([(k,) for k in targets], "doc_id bigint")
    got = sorted(round(r["log_weight"], 9) for r in resample.weights(docs, chosen).collect())
    assert got == pytest.approx(sorted(brute_weights(rows, targets)), abs=1e-8)
    keys = sorted((r["key"] for r in resample.weights(docs, chosen).collect()), reverse=True)
    kept = [r["key"] for r in resample.resample(docs, chosen, fraction=0.5).collect()]
    assert sorted(kept, reverse=True) == keys[: len(kept)] and len(kept) == math.ceil(0.5 * len(rows))
    none = resample.weights(docs, chosen.limit(0)).collect()
    assert all(abs(r["log_weight"]) < 1e-9 for r in none)


def test_equal_weights_are_drawn_evenly(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(4000)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in resample.resample(docs, docs.where("doc_id < 0").select("doc_id"), fraction=0.25).collect()}
    assert len(kept) == 1000
    for part in (lambda k: k % 2, lambda k: k >= 2000, lambda k: k // 10 % 2):
        assert 420 < sum(map(part, kept)) < 580
    assert kept != {r["doc_id"] for r in resample.resample(docs, docs.limit(0).select("doc_id"), fraction=0.25, seed=12).collect()}


def test_a_temperature_lets_light_texts_in(spark):
    rows = [(k, "good words " * (50 if k % 2 else 1) + ("junk ## " * 50 if k % 3 == 0 else "")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(k,) for k in range(600) if k % 3], "doc_id bigint")
    cold, warm = ({r["doc_id"] for r in resample.resample(docs, target, fraction=0.3, temperature=t).collect()} for t in (1.0, 1e6))
    assert all(k % 2 for k in cold) and 60 < sum(1 for k in warm if k % 2 == 0) < 120


def brute_licenses(text, templates, least):
    """Names of templates of which a run of the text, anywhere, has enough words in order, and so many in a row that a fingerprint is sure."""
    words = [w.lower() for w in text.split()]
    found = set()
    n = license_scan.GRAM + license_scan.WINNOW - 1
    for name, t in templates.items():
        theirs = t.lower().split()
        if not {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} & {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)}:
            continue
        row = [0] * (len(theirs) + 1)
        best = 0
        for start in range(len(words)):
            row = [0] * (len(theirs) + 1)
            for w in words[start : start + len(theirs) + license_scan.BAND]:
                before = 0
                for j, x in enumerate(theirs):
                    kept = row[j + 1]
                    row[j + 1] = before + 1 if w == x else max(row[j + 1], row[j])
                    before = kept
            best = max(best, row[-1])
        if best >= least * len(theirs):
            found.add(name)
    return found


def test_licenses_are_those_of_full_alignment(spark):
    rng = random.Random(1)
    templates = {f"T{k}": " ".join(f"{rng.choice('abcdef')}{j % 7}" for j in range(rng.choice([6, 12, 25]))) for k in range(5)}
    texts = []
    for _ in range(60):
        words = rng.choice(list(templates.values())).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zz"], [words[at], "yy"]])
            words = words or ["q"]
        texts.append(" ".join([*(f"n{j}" for j in range(rng.randrange(9))), *words, *(f"m{j}" for j in range(rng.randrange(9)))]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got: dict = {}
    for r in license_scan.scan(docs, templates).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert [got.get(k, set()) for k in range(60)] == [brute_licenses(t, templates, license_scan.LEAST_COVERAGE) for t in texts]


def test_licenses_repeated_in_one_text(spark):
    notice = license_scan.TEMPLATES["Apache-2.0 notice"]
    docs = spark.createDataFrame([(1, f"{notice} between {notice}"), (1, f"{notice} between {notice}"), (None, notice)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["word_from"], r["word_to"]) for r in license_scan.scan(docs).collect())
    n = len(license_scan.Index(license_scan.TEMPLATES).words[0])
    assert got == [(0, 0, n), (1, 0, n), (1, 0, n), (1, n + 1, 2 * n + 1), (1, n + 1, 2 * n + 1)]
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.scan(docs, {"short": "two words"})


def thread(rng, n):
    """Messages of a conversation, and for each the turn that its quotation comes from."""
    texts, sources = [], []
    for turn in range(n):
        own = "\n\n".join(f"Turn {turn} says thing {k} of {rng.randrange(1000)}.\nAnd a second line {turn} {k}." for k in range(rng.randrange(1, 4)))
        if turn and rng.random() < 0.7:
            at = rng.randrange(turn)
            said = texts[at][1]
            how = rng.randrange(4)
            part = said if how == 0 else rng.choice(said.split("\n\n")) if how == 1 else rng.choice([x for x in said.split("\n") if x]) if how == 2 else "\n\n".join(said.split("\n\n")[:2])
            quoted = "\n".join(("> " + x).rstrip() for x in part.split("\n"))
            if how == 0 and sources[at] is not None and rng.random() < 0.5:
                quoted += "\n>\n> On Friday Z wrote:\n" + "\n".join(("> > " + x).rstrip() for x in texts[sources[at]][1].split("\n"))
            head = rng.choice(["", "On Monday X wrote:\n"])
            texts.append((f"{head}{quoted}\n\n{own}" if rng.random() < 0.5 else f"{own}\n\n{head}{quoted}", own))
            sources.append(at)
        else:
            texts.append((own, own))
            sources.append(None)
    return texts, sources


def test_generated_threads_are_linked_to_where_their_quotations_come_from(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(25):
        texts, sources = thread(rng, 9)
        for turn, ((text, own), source) in enumerate(zip(texts, sources, strict=True)):
            rows.append((conv, turn, "user", text))
            root = turn
            while sources[root] is not None:
                root = sources[root]
            want[conv, turn] = (own, source, root)
    rng.shuffle(rows)
    got = {(r["conv_id"], r["turn"]): (r["message"], r["reply_to"], r["root_turn"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def brute_rule(host, path, rules):
    fits = [(-len(h) - len(p), -len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[2:] if fits else (None, "allow")


@pytest.mark.parametrize("block", [20_000, 3])
def test_rules_of_any_number(spark, monkeypatch, block):
    monkeypatch.setattr(url_filter, "MOST_RULES", block)
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "c"])
    rules = sorted({(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))) for _ in range(60)})
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(6)))}" for _ in range(200)] + ["http://a.b/xy"] * 100
    pages = spark.createDataFrame([(k, u, "mine", 1) for k, u in enumerate(urls)], "page_id bigint, url string, part string, best int")
    got = url_filter.apply_rules(pages, rules)
    assert got.columns == ["page_id", "url", "part", "best", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 300
    for r in rows:
        assert (r["rule"], r["verdict"]) == brute_rule(r["host"], r["path"], rules), r
