"""The pipeline's stages against brute force, and the whole of it."""

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphsearch.llm import decontaminate, merges, minhash, substring, toxicity, wordbytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@functools.cache
def features_of(word):
    words = wordbytes.Words(pa.array([word]), wordbytes.ALNUM_FOLDED, toxicity.PREFIXES)
    return {int(h[0]) for h in (words.hash, *words.prefixes)} - {0}


def test_documents_that_score_as_toxic_go(spark):
    sf = "/root/testdata/sf0.01"  # of the smallest tables no document is toxic
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(map(int, model.features), model.weights, strict=True))
    want = set()
    for r in docs.collect():
        found = set().union(*(features_of(w) for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")))))
        if 1 / (1 + math.exp(-(sum(weight.get(f, 0.0) for f in found) + model.bias))) < 0.5:
            want.add(r["doc_id"])
    left = [r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()]
    assert len(left) == len(set(left)) and set(left) == want and len(want) < docs.count()


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(d for d, _, _, kept in minhash.brute_force(rows, 5) if kept)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == want and len(want) < len(rows)


def test_texts_are_encoded(spark, docs):
    vocabulary = merges.Vocabulary.load(merges.MODEL)
    short = docs.where("length(text) < 800")
    keys = {r["doc_id"]: r["key"] for r in short.selectExpr("doc_id", "xxhash64(doc_id) AS key").collect()}
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    got = corpus_pipeline.encode(spark, short, SF).collect()
    assert len(got) == len(texts) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    for r in got[:30]:
        assert r["ids"] == merges.brute_force(vocabulary, texts[r["doc_id"]], keys[r["doc_id"]], merges.DROPOUT, merges.SEED)


def test_the_whole_is_its_stages_one_after_another(spark, docs):
    vocabulary = merges.Vocabulary.load(merges.MODEL)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()]
    kept = {d for d, _, _, k in minhash.brute_force(left, 5) if k}
    left = [(d, t) for d, t in left if d in kept]
    cut = {d: text if n else None for d, _, n, text in substring.brute_force(left)}
    left = [(d, t if cut[d] is None else cut[d]) for d, t in left]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, _, n, *_ in decontaminate.brute_force(left, items) if n}
    want = {d: t for d, t in left if d not in hit}
    decoder = merges.Encoder(vocabulary)
    got = {r["doc_id"]: (decoder.decode(r["ids"]) if r["ids"] is not None else None, r["lossless"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: (t, True) for d, t in want.items()} and np.mean([d in want for d, _ in left]) > 0.5
