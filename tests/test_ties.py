"""Queries against their SQL on lines of an order whose places are equal, as they come with part keys from 100,000."""

import os

import pytest

import compare
from graphsearch.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tied"))
    for t in compare.TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", f"{sf}/{t}.parquet")
    columns = spark.read.parquet(f"{SF}/lineitem.parquet").schema
    lines = [(o, p, 10 * p % 7 * 10, n, 1.0, 1.0, discount, 0.05, "N", "O", None) for o in (1, 2) for n, p, discount in [(1, o, 0.1), (1, 150_000, 0.0), (2, 50_000, 0.0), (3, 7, 0.1), (3, 8, 0.2)]]
    spark.createDataFrame(lines, columns).coalesce(1).write.parquet(f"{sf}/made")
    part = next(f for f in os.listdir(f"{sf}/made") if f.endswith(".parquet"))
    os.rename(f"{sf}/made/{part}", f"{sf}/lineitem.parquet")
    return sf


@pytest.mark.parametrize("name", ["cooccurrence_topk", "graph_build_edges", "graph_edges", "index_roundtrip"])
def test_lines_of_one_place(spark, tied, name):
    names, got = compare.rows_of(spark, catalog.QUERIES[name], tied)
    assert got and (names, got) == compare.oracle_rows(catalog.ORACLES[name], tied)
