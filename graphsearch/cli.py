"""Commands for an index: python -m graphsearch.cli INDEX_PATH, then queries or :kg :top :suggest :viz PATH :help :quit."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from graphsearch.operators import graph, rank, search
from graphsearch.session import build_session
from graphsearch.sources import tables

HELP = ":kg numbers of the graph  :top best entities  :suggest entities to ask for  :viz PATH a drawing (.html or .svg)  :quit"


def drawing(index: dict, k: int = 60) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of the k best entities, with sizes and widths."""
    nodes, edges = graph.induced_subgraph(index["nodes"].join(index["scores"], "entity"), rank.semantic(index["edges"]), k, "score")
    size = F.greatest(F.lit(8), F.least(F.lit(40), 8 + F.col("score") * 32))
    width = F.greatest(F.lit(1), F.least(F.lit(5), F.floor("weight")))
    return (
        [r.asDict() for r in nodes.select("entity", "type", size.alias("size")).orderBy("entity").collect()],
        [r.asDict() for r in edges.select("subj", "obj", F.when(F.length("relation") < 20, F.col("relation")).alias("label"), width.alias("width")).orderBy("subj", "obj", "label").collect()],
    )


def command(index: dict, line: str) -> str | None:
    """The answer to one line; None ends the session."""
    spark = index["documents"].sparkSession
    word, _, rest = line.strip().partition(" ")
    if word in (":quit", ":q"):
        return None
    if word == ":help" or not word:
        return HELP
    if word == ":kg":
        return "\n".join(f"{r['kind']} {r['name']}: {r['n']}" for r in graph.stats(index["nodes"], index["edges"]).orderBy("kind", "name").collect())
    scored = index["scores"].join(index["nodes"].select("entity", "type"), "entity")
    if word == ":top":
        return "\n".join(f"{r['entity']} ({r['type']}) {r['score']:.4f}" for r in rank.top_entities(scored, 20).collect())
    if word == ":suggest":
        return "\n".join(r["entity"] for r in rank.suggest(scored).collect())
    if word == ":viz":
        return tables.visualize(spark, *drawing(index), rest.strip()) or "the path must end in .html or .svg"
    hits, seconds = search.timed(index, line.strip())
    return f"{search.render(hits)}\n{len(hits)} results in {seconds:.2f} s"


def run(index: dict, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    for line in lines:
        answer = command(index, line)
        if answer is None:
            return
        say(answer)


if __name__ == "__main__":
    run(search.load_index(build_session(), sys.argv[1]), sys.stdin)
