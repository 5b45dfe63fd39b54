"""Streams of tables that are folders of files."""

import os

import pytest

import compare
from graphsearch.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("folders"))
    for t in compare.TABLES:
        if t in ("documents", "events", "lineitem"):
            spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{sf}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{sf}/{t}.parquet")
    return sf


@pytest.mark.parametrize("name", ["stream_annotations", "stream_append", "stream_upsert_edges", "stream_dedup_window"])
def test_streams_of_folders(spark, folders, name):
    names, got = compare.rows_of(spark, catalog.QUERIES[name], folders)
    assert got and (names, got) == compare.oracle_rows(catalog.ORACLES[name], SF)
