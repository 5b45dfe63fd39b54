"""Queries against their SQL on texts that are null, empty, or hold what a file format sets apart."""

import os

import pytest

import compare
from graphsearch.plans import catalog

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "\r\n", '"', '""', 'a"', "\\", '\\"', ",", "null", "﻿", "\0", '\0"', 'a"\0', '"\0"', "\0\n", '",\n"', "a\rb"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd"))
    for t in compare.TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{sf}/{t}.parquet")
    columns = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    texts = [(x, "en", "s") for x in ODD] + [("a", x, "s") for x in ODD] + [("a", "en", x) for x in ODD] + [(x, x, x) for x in ODD]
    spark.createDataFrame([(i, *t, 0) for i, t in enumerate(texts)], columns).coalesce(1).write.parquet(f"{sf}/made")
    part = next(f for f in os.listdir(f"{sf}/made") if f.endswith(".parquet"))
    os.rename(f"{sf}/made/{part}", f"{sf}/documents.parquet")
    return sf


def test_odd_texts_survive_files(spark, odd):
    names, got = compare.rows_of(spark, catalog.QUERIES["source_roundtrip"], odd)
    assert len(got) == 3 * 4 * len(ODD) and (names, got) == compare.oracle_rows(catalog.ORACLES["source_roundtrip"], odd)
