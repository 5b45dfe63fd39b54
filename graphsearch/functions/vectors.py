"""Vectors as arrays: products, norms and hashed encodings."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsearch.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if one is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    n = norm(a)
    # The norm is a field of a row of one, so it is computed once and not for each component.
    once = F.array(F.struct(a.alias("v"), F.when(n > 0, n).otherwise(F.lit(1e-8)).alias("n")))
    return F.transform(once, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def token_slot(token: Column, width: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % width).cast("int")


@lru_cache
def _unit(width: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(words: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int64)
        # A batch's distinct tokens are hashed once, as token_slot does.
        coded = words.flatten().dictionary_encode()
        slot = np.array([int.from_bytes(md5(w).digest()[:4], "big") % width for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
        place = np.repeat(np.arange(len(words)) * width, size) + slot[np.asarray(coded.indices, dtype=np.int64)]
        values = np.log1p(np.bincount(place, minlength=len(words) * width).astype(float)).reshape(len(words), width)
        norm = np.sqrt((values * values).sum(axis=1))
        values /= np.where(norm > 0, norm, 1e-8)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * width), pa.array(values.ravel()), mask=words.is_null())

    return unit


def encode(text: Column, width: int = 256) -> Column:
    """A unit vector of log token counts by slot: the stand-in for a sentence encoder.  Null for null."""
    return _unit(width)(tokens(text))
