"""Graphs of orders whose first lines share their place, which the SQL's order leaves open."""

import compare
from graphsearch.plans import catalog

SF = "/root/testdata/sf0.001"
LINES = [(o, p, 0, n, 1.0, 1.0, 0.0, 0.05, "N", "O", None) for o in (1, 2, 3) for n, p in [(1, 150_000), (2, 50_000), (3, 7)]]


def test_rows_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    columns, found = spark.read.parquet(f"{SF}/lineitem.parquet").schema, []
    for k, lines in enumerate((LINES, LINES[::-1])):
        spark.createDataFrame(lines, columns).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        found.append(compare.rows_of(spark, catalog.QUERIES["graph_build_edges"], f"{tmp_path}/{k}"))
    assert found[0][1] and found[0] == found[1]
    assert any("'p150000'" in r and "'p50000'" in r and "'sold_with'" in r for r in found[0][1])
