"""SentencePiece encoding with merge-dropout: the public library, a brute-force agenda, round trips."""

import random

import numpy as np
import pytest

from graphsearch.llm import merges

TEXTS = ["hello world", "  two  spaces ", "日本語 ①\n\tx", "é́ ﬁ", "x" * 300, " ", "", "The quick brown fox, 12345!", "a▁b ▁", "\0\x01 \U0001f600", "word" * 40 + " end"]


@pytest.fixture(scope="module")
def vocabulary():
    return merges.Vocabulary.load(merges.MODEL)


def drawn(seed, n, most=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("thearin.é▁日") for _ in range(rng.choice([1, 3, 8, 9, 17, 30, 64, 65, most]))) for _ in range(40)]
    return [(" " * rng.choice([1, 1, 1, 2, 5])).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60]))) + " " * rng.randrange(3) for _ in range(n)]


def test_without_dropout_pieces_are_the_librarys(vocabulary):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=merges.MODEL)
    plain = merges.Encoder(vocabulary)
    texts = [t for t in TEXTS if "▁" not in t and "\0" not in t]
    ids, sizes = plain.encode_all(texts, np.zeros(len(texts), np.uint64))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [p.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("run", [1 << 19, 40])
def test_pieces_are_those_of_brute_force(vocabulary, monkeypatch, dropout, run):
    monkeypatch.setattr(merges, "RUN", run)
    monkeypatch.setattr(merges, "TABLE", 1 << 8 if run == 40 else 1 << 18)
    encoder = merges.Encoder(vocabulary, dropout, 7)
    texts = TEXTS + drawn(run, 25)
    keys = np.arange(len(texts), dtype=np.uint64)
    ids, sizes = encoder.encode_all(texts, keys)
    each = np.split(ids, np.cumsum(sizes)[:-1])
    for k, (t, got) in enumerate(zip(texts, each, strict=True)):
        assert got.tolist() == merges.brute_force(vocabulary, t, k, dropout, 7), t
        assert encoder.decode(got.tolist()) == t
    assert encoder.lossless(texts, ids, sizes).all()
    if len(texts[0]) and dropout == 0.1:
        changed = [*texts[:-1], texts[-1] + "!"]
        assert encoder.lossless(changed, ids, sizes).tolist() == [True] * (len(texts) - 1) + [False]


def test_every_occurrence_has_its_own_skips(vocabulary):
    encoder = merges.Encoder(vocabulary, 0.3, 7)
    assert len({encoder.encode("international", key).tobytes() for key in range(300)}) > 20
    one = encoder.encode("international " * 300, 1)
    assert encoder.encode("international " * 300, 1).tolist() == one.tolist() and encoder.decode(one.tolist()) == "international " * 300
    assert merges.Encoder(vocabulary, 0.3, 8).encode("international " * 300, 1).tolist() != one.tolist()
    passed = encoder.passed(np.arange(100_000, dtype=np.uint64), 0)
    assert all(abs(np.mean(passed >= n) - 0.7**n) < 0.01 for n in range(6))


def test_words_of_equal_hash_keep_their_own_pieces(vocabulary, monkeypatch):
    monkeypatch.setattr(merges, "span_hashes", lambda h, a, z: np.zeros(len(a), np.uint64))
    encoder = merges.Encoder(vocabulary, 0.1, 7)
    for k, t in enumerate(TEXTS):
        assert encoder.encode(t, k).tolist() == merges.brute_force(vocabulary, t, k, 0.1, 7)


def documents(spark, rows):
    return spark.createDataFrame([(d, t, [d or 0], 5) for d, t in rows], "doc_id bigint, text string, ids array<bigint>, key int")


def test_encode_texts(spark):
    docs = documents(spark, [(1, "some words here"), (2, None), (3, ""), (None, "x"), (1, "some words here"), (4, "a▁b \n日")])
    encoded = merges.encode_texts(docs)
    rows = encoded.collect()
    assert len(rows) == 6 and rows[0]["ids"] == rows[4]["ids"] and all(r["lossless"] for r in rows)
    assert [r["ids"] for r in rows][1] is None and [r["ids"] for r in rows][2] == []
    back = {(r["doc_id"], r["text"], r["n_tokens"] > 0) for r in merges.decode_ids(encoded).collect()}
    assert back == {(1, "some words here", True), (2, None, False), (3, "", False), (None, "x", True), (4, "a▁b \n日", True)}
    assert merges.encode_texts(docs.limit(0)).count() == 0 and merges.decode_ids(encoded.limit(0)).count() == 0


def test_every_row_is_decoded(spark, monkeypatch):
    docs = documents(spark, [(1, "two  words "), (2, None), (3, ""), (4, "a▁b \n日")])
    load = merges.Vocabulary.load

    def wrong(path):
        vocabulary = load(path)
        vocabulary.flat = np.where(vocabulary.flat == ord("a"), np.uint8(ord("b")), vocabulary.flat)
        return vocabulary

    monkeypatch.setattr(merges.Vocabulary, "load", wrong)
    assert {r["doc_id"]: r["lossless"] for r in merges.encode_texts(docs, dropout=1.0).collect()} == {1: True, 2: True, 3: True, 4: False}
