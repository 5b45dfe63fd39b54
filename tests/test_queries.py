"""Queries against their SQL at the smallest scale."""

import pytest

import compare
from graphsearch.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_are_the_oracles(spark, name):
    names, got = compare.rows_of(spark, catalog.QUERIES[name], SF)
    assert (names, got) == compare.oracle_rows(catalog.ORACLES[name], SF)


def test_the_index_finds_most(spark):
    got = catalog.QUERIES["ivf_topk"](spark, SF).collect()
    exact = {(r["qid"], r["vec_id"]) for r in catalog.QUERIES["vector_topk"](spark, SF).where("place <= 10").collect()}
    assert len({(r["qid"], r["vec_id"]) for r in got} & exact) >= 0.85 * len(exact)


def test_the_stream_counts_closed_windows(spark):
    batch = {(r["start"], r["event_type"], r["n"]) for r in catalog.QUERIES["event_windows"](spark, SF).collect()}
    stream = catalog.QUERIES["stream_dedup_window"](spark, SF).collect()
    assert stream and {(r["start"], r["event_type"], r["n"]) for r in stream} <= batch
