"""Toxicity: a logistic classifier that identity terms alone must not move.

Features are the words of a text and the beginnings of its words, present or not.  Those that tell
the labels apart are chosen from counts, and weights are fitted by gradient descent on the logistic
loss, a ridge, and a counterfactual penalty: in labelled sentences that name a group, the group's name
is swapped for others of its kind, and the squared difference of the two scores counts as loss.

Only the fit is bounded: MOST_LABELLED labelled rows (those with the least hash of their id, all of
them if there are fewer).  Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.llm.tables import fresh, map_arrow, read, stored
from graphsearch.llm.wordbytes import ALNUM_FOLDED, Words, pieces

#: Labelled rows that are fitted at most, and features of the fit.
MOST_LABELLED = 8000
MOST_FEATURES = 2048
PREFIXES = (4, 5, 6, 7, 8)
#: Standard errors between the shares of toxic and other rows with a feature.
LEAST_CONTRAST = 4.5
#: Weight of the counterfactual penalty, and characters of sentences and their swapped copies that are read at once.
FAIRNESS, SWAPPED_AT_ONCE = 1.0, 1 << 20

#: Names of groups, by kind; a name is swapped for the others of its line.
IDENTITY_TERMS = """
women men girls boys
woman man girl boy
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
black white asian latino african european arab
gay straight lesbian bisexual transgender
immigrant refugee foreigner native
immigrants refugees foreigners natives
deaf blind disabled
femmes hommes filles garçons
femme homme fille garçon
musulman chrétien juif bouddhiste
noir blanc arabe africain
frauen männer mädchen jungen
muslime christen juden
mujeres hombres chicas chicos
musulmanes cristianos judíos
"""
_SWAPS = {w: [x for x in line.split() if x != w] for line in IDENTITY_TERMS.split("\n") for w in line.split()}
_SENTENCE = re.compile(r"[^.!?\n]+")
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, _SWAPS), key=len, reverse=True)) + r")(?!\w)", re.I)


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def _features(texts: pa.Array, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, by text and feature; with within, numbers of its sorted features alone."""
    words = Words(texts, ALNUM_FOLDED, PREFIXES)
    docs, values = [], []
    table = None
    if within is not None:
        table = np.zeros(1 << 16, bool)
        table[(within >> np.uint64(48)).astype(np.int64)] = True
    for h in (words.hash, *words.prefixes):
        at = np.flatnonzero(h if table is None else table[(h >> np.uint64(48)).astype(np.int64)] & (h > 0))
        value = h[at]
        if within is not None:
            place = np.searchsorted(within, value)
            place[place == len(within)] = 0
            same = within[place] == value if len(within) else np.zeros(0, bool)
            at, value = at[same], place[same].astype(np.uint64)
        docs.append(words.doc[at])
        values.append(value)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort([value, doc])
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            doc, value = _features(piece.column("text"))
            toxic = np.asarray(piece.column("toxic"))[doc]
            feature, number = np.unique(value, return_inverse=True)
            n = np.bincount(number, minlength=len(feature))
            n1 = np.bincount(number, toxic, len(feature)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["feature", "n1", "n0"])


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """Sentences with a group's name, and the same sentences with other names of the kind."""
    for m in _SENTENCE.finditer(text):
        sentence = m[0]
        for term in dict.fromkeys(x.lower() for x in _TERM.findall(sentence)):
            for other in _SWAPS[term]:
                yield sentence, re.sub(rf"(?<!\w){re.escape(term)}(?!\w)", other, sentence, flags=re.I)


def _examples(features: np.ndarray):
    """Of labelled texts: toxic and its features' numbers; and of each counterfactual pair (toxic null) those of one side only, minus one where it is the swapped one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                doc, number = _features(piece.column("text"), features)
                cut = np.searchsorted(doc, np.arange(len(piece) + 1))
                rows = [(t, number[a:z].astype(np.int64).tolist()) for t, a, z in zip(piece.column("toxic").to_pylist(), cut[:-1], cut[1:], strict=True)]
                yield _example_rows(rows)
                held, size = [], 0
                for p in (p for t in piece.column("text").to_pylist() if t for p in counterfactuals(t)):
                    held.append(p)
                    size += len(p[0]) + len(p[1])
                    if size > SWAPPED_AT_ONCE:
                        yield _example_rows(_moved(held, features))
                        held, size = [], 0
                if held:
                    yield _example_rows(_moved(held, features))

    return run


def _example_rows(rows: list[tuple[int | None, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["toxic", "numbers"])


def _moved(pairs: list[tuple[str, str]], features: np.ndarray) -> list[tuple[None, list[int]]]:
    doc, number = _features(pa.array([t for p in pairs for t in p], pa.large_string()), features)
    cut = np.searchsorted(doc, np.arange(2 * len(pairs) + 1))
    sides = [set(number[a:z].astype(np.int64).tolist()) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    moved = [sorted(one - two) + sorted(-1 - x for x in two - one) for one, two in zip(sides[::2], sides[1::2], strict=True)]
    return [(None, m) for m in moved if m]


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], int]], n_features: int, ridge: float = 1e-3, fairness: float = FAIRNESS, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias; rows and pairs as _examples gives them, each distinct pair with its number."""
    y = np.array([t for t, _ in rows], float)
    w = np.zeros(n_features)
    share = (y.sum() + 0.5) / (len(y) + 1)
    b = float(np.log(share / (1 - share)))
    if not len(y) or not n_features:
        return w, b
    col = np.array([x for _, xs in rows for x in xs], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(xs) for _, xs in rows])
    p_col = np.array([x if x >= 0 else -1 - x for xs, _ in pairs for x in xs], np.int64)
    p_sign = np.array([1.0 if x >= 0 else -1.0 for xs, _ in pairs for x in xs])
    p_row = np.repeat(np.arange(len(pairs)), [len(xs) for xs, _ in pairs])
    p_share = np.array([n for _, n in pairs], float) / max(1, sum(n for _, n in pairs))
    # Steps no longer than the loss is smooth: the mean number of features and of swapped ones bounds it.
    rate = 1.0 / (1 + np.sqrt(max(1, np.bincount(row, minlength=1).mean() if len(row) else 1)) / 4 + fairness * (np.bincount(p_row).max() if len(p_row) else 0))
    dw, db = np.zeros(n_features), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -40, 40)))
        gap = p - y
        grad = np.bincount(col, gap[row], n_features) / len(y) + ridge * w
        if len(pairs):
            shift = np.bincount(p_row, w[p_col] * p_sign, len(pairs)) * p_share
            grad += fairness * np.bincount(p_col, shift[p_row] * p_sign, n_features)
        dw, db = 0.9 * dw + grad, 0.9 * db + gap.mean()
        w, b = w - rate * dw, b - rate * db
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED, fairness: float = FAIRNESS) -> Model:
    """A model of labels (id, label 0 or 1) on the texts of docs; fairness is the weight of the counterfactual penalty.

    The driver gets the examples' features (at most so many rows) and the distinct differences that
    swaps make: these come from the fixed list of terms and the chosen features, and don't grow with
    the texts.

    Null ids and labels, labels beyond 0 and 1, ids with both labels, and labels of no document
    count for nothing.  With no labelled text the model has no feature and scores 0.5.
    """
    own = labels.select(F.col(f"`{id}`").alias("key"), F.col(f"`{label}`").cast("int").alias("toxic")).where("key IS NOT NULL AND toxic IN (0, 1)")
    own = own.groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("key", "toxic")
    sample = F.broadcast(own.orderBy(F.xxhash64("key"), "key").limit(most))  # at most so many rows of two numbers
    texts = stored(docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").join(sample, "key").select("text", "toxic"))
    total = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    n1 = total["n1"] or 0
    n0 = total["n"] - n1
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(bias=float(np.log(share / (1 - share))))
    counted = map_arrow(texts, _counts, "feature bigint, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    spread = F.sqrt((F.col("n1") + F.col("n0") + 1) / F.lit(float(n1 + n0)) * F.lit(1 / n1 + 1 / n0))
    contrast = F.abs(F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))) / spread
    chosen = counted.withColumn("contrast", contrast).where(F.col("contrast") > LEAST_CONTRAST).orderBy(F.desc("contrast"), "feature").limit(MOST_FEATURES)
    features = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64).view(np.uint64))
    examples = map_arrow(texts, _examples(features), "toxic int, numbers array<bigint>").groupBy("toxic", "numbers").agg(F.count("*").alias("n")).collect()
    examples = sorted((r["toxic"] is None, r["toxic"] or 0, r["numbers"], r["n"]) for r in examples)
    weights, bias = fit([(toxic, numbers) for swapped, toxic, numbers, n in examples if not swapped for _ in range(n)], [(numbers, n) for swapped, _, numbers, n in examples if swapped], len(features), fairness=fairness)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The columns of docs (but one with that name) and the score, 0 to 1; null and empty texts have the score of no feature.  Repeated rows are each scored."""
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    source = docs.select(*(F.col(f"`{c}`") for c in columns))
    sorted_features, weights, bias = model.features, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                doc, number = _features(piece.column(text), sorted_features)
                total = np.bincount(doc, weights[number.astype(np.int64)], len(piece)) + float(bias)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))))], [*columns, name])

    return map_arrow(source, run, T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id: str) -> Column:
    return F.crc32(F.col(f"`{id}`").cast("string")) % 5 == 0


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least, with all their columns, whatever their names."""
    name = fresh(docs, "score")
    return score(docs, model, text, name).where(F.col(f"`{name}`") < least).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").where(~held_out("doc_id")))
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
