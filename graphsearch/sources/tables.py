"""Reading and writing article files, labelled sets and indexes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of an index.
INDEX = ("documents", "chunks", "vectors", "links", "nodes", "edges", "occurrences", "scores", "aliases")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and quoted lines, or a JSON array, by the path's end."""
    if path.endswith(".csv"):
        # Nothing is null and "" is empty, since no text is the mark of a null; a quote is the escape of a quote's escape, or NUL would be.
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex, encoding="UTF-8")
        return df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if path.endswith(".json"):
        return _array(spark.read.json(path, multiLine=True), path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def _array(df: DataFrame, path: str) -> DataFrame:
    """df, if the file held an array of articles and not something else."""
    if not {"title", "content", "text"} & set(df.columns):
        raise ValueError(f"{path} holds no array of articles")
    return df


def read_ner_tags(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(tokens, ner_tags) of an exported labelled set; tags that are numbers get names."""
    df = spark.read.parquet(path).select("tokens", "ner_tags")
    if names is None or df.schema["ner_tags"].dataType.simpleString() == "array<string>":
        return df
    known = F.array(*(F.lit(n) for n in names))
    return df.select("tokens", F.transform("ner_tags", lambda t: known[t.cast("int")]).alias("ner_tags"))


def read_triples(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(query, positive, negative) of an exported ranking set, passages of at most 512 characters."""
    df = spark.read.parquet(path).select("query", F.substring("positive", 1, 512).alias("positive"), F.substring("negative", 1, 512).alias("negative"))
    return df if most is None else df.orderBy(F.xxhash64("query", "positive", "negative")).limit(most)


def read_gold_entities(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, entities) of an array, or of an object with samples."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("samples").alias("s")).select("s.*") if "samples" in df.columns else df


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select("query", F.explode("relevant_doc_ids").alias("doc_id"))


def not_seen(frontier: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    """Rows of the frontier, one for each key, that the sink lacks."""
    return frontier.dropDuplicates([key]).join(sink.select(key).distinct(), key, "left_anti")


def annotate_once(df: DataFrame, text: str, annotate) -> DataFrame:
    """Annotates each distinct text once, by its hash, and joins the result back; annotate takes (key, text) and adds columns."""
    keyed = df.withColumn("text_key", F.sha1(text))
    once = keyed.groupBy("text_key").agg(F.first(text).alias("text"))
    return keyed.join(annotate(once).drop("text"), "text_key")


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    unknown = set(tables) - set(INDEX)
    if unknown:
        raise ValueError(f"no tables of an index: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names or INDEX}


def save_state(spark: SparkSession, path: str, **state: str) -> None:
    """Names of plug-ins and the like, beside an index's tables."""
    spark.createDataFrame(sorted(state.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_state(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/state").collect()}


def export_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """A vector table with the name of the model that made it."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    save_state(vectors.sparkSession, path, model=model)


def import_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    if (made := load_state(spark, path)["model"]) != model:
        raise ValueError(f"vectors of {made}, not of {model}")
    return spark.read.parquet(f"{path}/vectors")


def save_report(metrics: DataFrame, path: str) -> None:
    """An evaluation's rows as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One file, in any store that Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def graph_svg(nodes: list[dict], edges: list[dict], size: int = 800) -> str:
    """The drawing of graph_html as a still picture."""
    import math
    from html import escape

    at = {n["entity"]: (size / 2 + 0.375 * size * math.cos(2 * math.pi * k / len(nodes)), size / 2 + 0.375 * size * math.sin(2 * math.pi * k / len(nodes))) for k, n in enumerate(nodes)}
    parts = [f'<line x1="{at[e["subj"]][0]:.1f}" y1="{at[e["subj"]][1]:.1f}" x2="{at[e["obj"]][0]:.1f}" y2="{at[e["obj"]][1]:.1f}" stroke="#999" stroke-width="{e["width"]}"/>' for e in edges if e["subj"] in at and e["obj"] in at]
    parts += [f'<circle cx="{at[n["entity"]][0]:.1f}" cy="{at[n["entity"]][1]:.1f}" r="{n["size"]}"/><text x="{at[n["entity"]][0] + 8:.1f}" y="{at[n["entity"]][1]:.1f}">{escape(n["entity"])}</text>' for n in nodes]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{"".join(parts)}</svg>'


def visualize(spark: SparkSession, nodes: list[dict], edges: list[dict], path: str) -> str | None:
    """Writes a page or a picture, by the path's end, and returns the path; None for another end."""
    draw = {"html": graph_html, "svg": graph_svg}.get(path.rsplit(".", 1)[-1])
    if draw is None:
        return None
    write_text(spark, path, draw(nodes, edges))
    return path


def graph_html(nodes: list[dict], edges: list[dict]) -> str:
    """A page that draws nodes(entity, type, size) and edges(subj, obj, label, width) as they are; for bounded subgraphs."""
    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False).replace("</", "<\\/")
    rows = "n.nodes.map((x,i)=>{let a=6.283*i/n.nodes.length;x.x=400+300*Math.cos(a);x.y=400+300*Math.sin(a);return x})"
    return f"""<!doctype html><meta charset="utf-8"><svg id="g" width="800" height="800"></svg><script>
const n={data};{rows};const at=Object.fromEntries(n.nodes.map(x=>[x.entity,x]));let s="";
for(const e of n.edges){{const a=at[e.subj],b=at[e.obj];if(a&&b)s+=`<line x1="${{a.x}}" y1="${{a.y}}" x2="${{b.x}}" y2="${{b.y}}" stroke="#999" stroke-width="${{e.width}}"/>`}}
for(const x of n.nodes)s+=`<circle cx="${{x.x}}" cy="${{x.y}}" r="${{x.size}}"/>`;
const g=document.getElementById("g");g.innerHTML=s;for(const x of n.nodes){{const t=document.createElementNS("http://www.w3.org/2000/svg","text");t.setAttribute("x",x.x+8);t.setAttribute("y",x.y);t.textContent=x.entity;g.append(t)}}
</script>"""
